"""Token ids of a corpus in binary files with Elias-Fano coded document boundaries.

The corpus is one long id array in ascending ``doc_id`` order, cut into segments of bounded size at
document boundaries. A segment file holds its ids as 16- or 32-bit integers and two Elias-Fano
sequences: where each document ends, and the document ids. ``select`` finds the i-th value by a sampled
directory, so a reader needs no table of 64-bit offsets. The place of a segment in the whole array comes
from a manifest with one row per file.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import UnitCache, partitions, plain, put_file, row_chunks, text_column, work_folder

MAGIC = b"SWTOK1\0\0"
SAMPLE = 64
_HEAD = struct.Struct("<8sBxxxxxxxQQQq")


class EliasFano:
    """A non-decreasing sequence in about ``2 + log2(universe / n)`` bits a value."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high = n, universe, low_bits, low, high
        self._ones: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if bits:
            planes = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(planes.astype(np.uint8).ravel(), bitorder="little")
        upper = (values >> np.uint64(bits)).astype(np.int64)
        marks = np.zeros(n + (int(upper[-1]) if n else 0) + 1, np.uint8)
        marks[upper + np.arange(n)] = 1
        return cls(n, universe, bits, low, np.packbits(marks, bitorder="little"))

    def _directory(self) -> np.ndarray:
        """Bit positions of every ``SAMPLE``-th one in the upper bits."""
        if self._ones is None:
            per_byte = np.unpackbits(self.high.reshape(-1, 1), axis=1).sum(axis=1)
            self._before = np.r_[0, np.cumsum(per_byte)]
            wanted = np.arange(0, self.n, SAMPLE)
            self._ones = np.searchsorted(self._before, wanted, "right") - 1
        return self._ones

    def select(self, i: int) -> int:
        """The ``i``-th value, by the directory and a scan of a few bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte = int(self._directory()[i // SAMPLE])
        while self._before[byte + 1] <= i:
            byte += 1
        bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        upper = byte * 8 + int(bits[i - self._before[byte]]) - i
        low = 0
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            low |= (int(self.low[at >> 3]) >> (at & 7) & 1) << b
        return upper << self.low_bits | low

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits]
            planes = bits.reshape(self.n, self.low_bits).astype(np.uint64)
            out |= (planes << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQBxxxxxxxQQ", self.n, self.universe, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        shape = struct.Struct("<QQBxxxxxxxQQ")
        n, universe, bits, n_low, n_high = shape.unpack_from(data, at)
        at += shape.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        return cls(n, universe, bits, low, high), at + n_low + n_high


def pack_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment file. Null document ids come first and are only counted."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    width = 2 if len(ids) == 0 or int(ids.max()) < 1 << 16 else 4
    head = _HEAD.pack(MAGIC, width, len(doc_ids), len(ids), len(doc_ids) - len(known), base)
    ends = EliasFano.encode(np.cumsum(lengths))
    names = EliasFano.encode(known.astype(np.uint64) - np.array(base, np.int64).astype(np.uint64))
    return head + ends.to_bytes() + names.to_bytes() + ids.astype(f"<u{width}").tobytes()


class Segment:
    """A segment file, read."""

    def __init__(self, data: bytes):
        magic, width, self.n_docs, self.n_tokens, self.n_null, self.base = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.ends, at = EliasFano.from_bytes(data, _HEAD.size)
        self.names, at = EliasFano.from_bytes(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", self.n_tokens, at)

    def doc_ids(self) -> list[int | None]:
        known = self.names.decode() + np.array(self.base, np.int64).astype(np.uint64)
        return [None] * self.n_null + known.astype(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        """Ids of the ``i``-th document of the segment, by two select calls."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


class WordTokens:
    """Ids of texts by way of their words, which a tokenizer without context across spaces allows.

    Words are what stands between blanks, tabs and line feeds. New words are encoded together, with a
    special token between them that no other input gives, and kept in a cache of bounded size.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark, self.mark_id = next(((t.content, i) for i, t in added.items()), (None, -1))
        self.cache = UnitCache(self._learn)

    def _learn(self, cache: UnitCache, new: list[str]) -> None:
        odd = [w for w in new if self.mark is None or self.mark[0] in w]
        if odd:
            new = [w for w in new if self.mark is not None and self.mark[0] not in w]
            for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
                cache.add(w, e.ids)
        joint = f" {self.mark} "
        groups = [new[i : i + 512] for i in range(0, len(new), 512)]
        texts = [joint.join(g) for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) + 1 != len(group):
                raise ValueError("the special token does not keep words apart")
            cache.extend(group, ids[ids != self.mark_id], np.diff(np.r_[-1, cuts, len(ids)]) - 1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and the number of each text's ids."""
        return self.cache.encode([t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts])


_ENCODERS: dict[str, WordTokens] = {}


def _encoder(path: str) -> WordTokens:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordTokens(path)
    return _ENCODERS[path]


_MANIFEST = "part int, segment int, file string, first_id long, n_docs long, n_tokens long"


def _writer(folder: str, tokenizer_path: str, end_id: int, segment_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        held: list = []
        rows, size, number = [], 0, 0

        def flush():
            nonlocal held, size, number
            docs = [d for h in held for d in h[0]]
            lengths = np.concatenate([h[1] for h in held])
            ids = np.concatenate([h[2] for h in held])
            name = f"part-{part:06d}-{number:06d}.tok"
            put_file(f"{folder}/{name}", pack_segment(docs, lengths, ids))
            rows.append((part, number, name, docs[0], len(docs), len(ids)))
            held, size, number = [], 0, number + 1

        for batch in batches:
            texts, names = text_column(batch, "text"), batch.column(0).to_pylist()
            for lo, hi in row_chunks(texts, 1 << 20):
                ids, n = encoder.encode(texts.slice(lo, hi - lo).to_pylist())
                ends = np.cumsum(n)
                ids, n = np.insert(ids, ends, end_id), n + 1
                held.append((names[lo:hi], n, ids))
                size += len(ids)
                if size >= segment_tokens:
                    flush()
        if held:
            flush()
        columns = list(zip(*rows)) if rows else [[] for _ in range(6)]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        fields = ["part", "segment", "file", "first_id", "n_docs", "n_tokens"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=fields)

    return write


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    end_id: int = 2,
    segment_tokens: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each and write segment files into ``folder``.

    Returns the manifest (part, segment, file, first_id, n_docs, n_tokens, start), also kept as
    ``folder``/manifest: ``start`` counts the ids before a segment. Order: ``doc_id``, nulls first, and
    a hash of the text for repeated ids. A null or empty text has only its end id. A segment ends with
    the first megabyte of text that takes it to ``segment_tokens`` ids. An empty table gives no file.
    Other columns of ``docs`` are not read. The tokenizer must not carry context across blanks.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    (
        plain(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(n, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .mapInArrow(_writer(folder, tokenizer_path, end_id, segment_tokens), _MANIFEST)
        .write.parquet(f"{folder}/written")
    )
    written = spark.read.parquet(f"{folder}/written")
    # One row per range partition, whose number is a setting, is all that meets in one task here.
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("part_start")
    )
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    written.join(parts, "part").withColumn("start", start).drop("part_start").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            segment = Segment(bytes(content))
            ends = segment.ends.decode().astype(np.int64)
            starts = np.r_[0, ends[:-1]]
            ids = segment.ids.astype("<u4")
            yield pd.DataFrame(
                {
                    "file": path.rpartition("/")[2],
                    "doc_id": pd.array(segment.doc_ids(), "Int64"),
                    "local": starts,
                    "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist())],
                }
            )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian 32-bit ids)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    docs = files.select("path", "content").mapInPandas(
        _read, "file string, doc_id long, local long, n_tokens long, ids_crc32 long"
    )
    places = spark.read.parquet(f"{folder}/manifest").select("file", F.col("start").alias("base"))
    return docs.join(places, "file").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_store(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs`` into a new shared folder and list the documents from them."""
    spark = docs.sparkSession
    folder = work_folder(spark, "tokens")
    if write_tokens(docs, tokenizer_path, folder, end_id).isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, folder)
