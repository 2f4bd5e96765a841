"""Folders, files and batch helpers that several operators share."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import shared_dir

CHUNK_BYTES = 1 << 20


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this run inside the shared folder of the session."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends at those files."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def put_file(uri: str, payload: bytes) -> None:
    """Write a whole file under its final name in one step, so a repeated task does no harm."""
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{os.getpid()}-{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as out:
        out.write(payload)
    where.move(draft, path)


def release_memory() -> None:
    """Give freed memory back to the system: Python workers are reused and would keep it through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a partition, with its memory released at the end."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return wrapped


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls: a null text counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.string()), "")


def row_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += int(n)
    if lo < len(sizes):
        yield lo, len(sizes)


def byte_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each text begins (one entry more than texts)."""
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names and types (``name="column:type"``)."""
    out = []
    for name, spec in columns.items():
        column, _, kind = spec.partition(":")
        col = F.col(f"`{column}`")
        out.append((col.cast(kind) if kind else col).alias(name))
    return df.select(*out)


class UnitCache:
    """Id runs of text units (words), kept in one pool, and looked up for many texts at once.

    ``learn`` gets new units and calls ``add`` for each. The cache is emptied between calls when it holds
    more than ``limit`` units, so its memory is bounded.
    """

    def __init__(self, learn, limit: int = 250_000):
        self.learn, self.limit = learn, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.ends = np.zeros(1 << 12, np.int64)

    def add(self, unit: str, ids) -> None:
        n = len(ids)
        while self.used + n > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        self.pool[self.used : self.used + n] = ids
        self.used += n
        # Unit number k has the ids from ends[k] up to ends[k + 1].
        self.known[unit] = at = len(self.known)
        if at + 1 == len(self.ends):
            self.ends = np.r_[self.ends, np.zeros_like(self.ends)]
        self.ends[at + 1] = self.used

    def extend(self, units: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add several units at once, with their ids on end."""
        first, more = len(self.known), len(units)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        while first + more >= len(self.ends):
            self.ends = np.r_[self.ends, np.zeros_like(self.ends)]
        self.pool[self.used : self.used + len(ids)] = ids
        self.ends[first + 1 : first + more + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.known.update(zip(units, range(first, first + more)))

    def encode(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as lists of units, on end; and how many each text has."""
        if len(self.known) > self.limit:
            self.clear()
        flat = [u for units in split for u in units]
        new = list(set(flat).difference(self.known))
        if new:
            self.learn(self, new)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        start = self.ends[at]
        length = self.ends[at + 1] - start
        total = np.r_[0, np.cumsum(length)]
        ids = self.pool[np.arange(total[-1]) + np.repeat(start - total[:-1], length)]
        n_units = np.r_[0, np.cumsum([len(units) for units in split])].astype(np.int64)
        return ids, np.diff(total[n_units])
