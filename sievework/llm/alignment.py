"""Alignment of two tokenizations of the same texts, and how often their ids are linked corpus-wide.

The tokens of both sides are laid on one byte axis. A dictionary per side maps every cumulative end to its
token; the ends that both dictionaries have, sorted, cut both id lists into groups, and in every group the
tokens whose byte ranges overlap are linked. Texts are worked on in blocks of a few megabytes. A block sends
each of its distinct id pairs once to be counted, gets the corpus-wide counts back by a join on the pair, and
sums them for its documents: no row is made for a single link, and a frequent pair has one row a block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import plain, releasing, row_chunks, stored, text_column, work_folder

CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 1 << 22
#: Bytes of the axis that share one pair of dictionaries; a longer text is passed through several.
AXIS_BYTES = 1 << 16
# Fixed value: how byte-level tokenizers split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteSide:
    """Ids and token bytes by a byte-level BPE file; the file's merges and ids are the same order.

    Texts with very long runs of white space go to the slower of two encoders, which cuts them without recursion.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.blanks = re.compile(r"\s{4096}")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"]}
        letters = _byte_letters()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if i not in special}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        self.encoding = tiktoken.Encoding("byte_side", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def _ids(self, text: str) -> list[int]:
        if len(text) >= 4096 and self.blanks.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.encoding.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._ids(" " + t) if t else [] for t in texts]


class PieceSide:
    """Ids and token bytes by a SentencePiece model that puts a blank before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


class _Side:
    """What a chunk of texts is on one side: ids on end, and where each token ends on the axis."""

    def __init__(self, sizes: np.ndarray, ids: list[list[int]]):
        self.n = np.array([len(x) for x in ids], np.int64)
        self.ids = np.fromiter(chain.from_iterable(ids), np.int64, int(self.n.sum()))
        self.ends = np.cumsum(sizes[self.ids])
        self.cut = np.r_[0, np.cumsum(self.n)]

    def ends_between(self, lo: int, hi: int) -> tuple[int, pd.Index]:
        """Dictionary of the ends after ``lo`` up to ``hi``: a hash table from an end to its token, less the first."""
        first, behind = np.searchsorted(self.ends, [lo, hi], "right").tolist()
        return first, pd.Index(self.ends[first:behind])


def common_cuts(a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side stand before each end that both sides have (0 comes first)."""
    last = int(a.ends[-1]) if len(a.ends) else 0
    of_a, of_b = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for lo in range(0, last, AXIS_BYTES):
        (first_a, in_a), (first_b, in_b) = (x.ends_between(lo, lo + AXIS_BYTES) for x in (a, b))
        common = np.sort(in_a.to_numpy()[in_b.get_indexer(in_a) >= 0])
        of_a.append(in_a.get_indexer(common) + first_a + 1)
        of_b.append(in_b.get_indexer(common) + first_b + 1)
    return np.concatenate(of_a), np.concatenate(of_b)


def links_in_slices(a: _Side, b: _Side, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (of a, of b) of all links, slice by slice.

    In a slice of p and q tokens the first tokens are linked, and every inner end of either side begins one
    more link, so it has p + q - 1 links.
    """
    p, q = np.diff(cut_a), np.diff(cut_b)
    total = int((p + q - 1).sum())
    if total == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner_a, inner_b = np.ones(len(a.ends), bool), np.ones(len(b.ends), bool)
    inner_a[cut_a[1:] - 1] = inner_b[cut_b[1:] - 1] = False
    # A link begins at the start of a slice or at an inner end; a step says which side moves on there.
    at = np.r_[a.ends[cut_a[1:] - 1], a.ends[inner_a], b.ends[inner_b]]
    step_a = np.r_[np.zeros(len(p), np.int64), np.ones(inner_a.sum(), np.int64), np.zeros(inner_b.sum(), np.int64)]
    step_b = np.r_[np.zeros(len(p) + inner_a.sum(), np.int64), np.ones(inner_b.sum(), np.int64)]
    ends_slice = np.arange(total) < len(p)
    order = np.argsort(at, kind="stable")
    after, step_a, step_b = ends_slice[order], step_a[order], step_b[order]
    # Behind the end of a slice both sides move on.
    step_a, step_b = step_a + after, step_b + after
    return np.r_[0, np.cumsum(step_a)[:-1]], np.r_[0, np.cumsum(step_b)[:-1]]


class Aligner:
    """Two tokenizers and what aligning their ids needs."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteSide(byte_path), PieceSide(piece_path)
        self.size_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.size_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.width = len(self.b.bytes)
        # What an id looks like before the next one of its list, and at the end of its list.
        self.more_a = [f"{i}," for i in range(len(self.a.bytes))]
        self.last_a = [f"{i}|" for i in range(len(self.a.bytes))]
        self.more_b = [f"{i}," for i in range(self.width)]
        self.last_b = [f"{i};" for i in range(self.width)]
        self.shown = [*self.more_a, *self.last_a, *self.more_b, *self.last_b]

    def _whole(self, text: str, x: list[int], y: list[int]) -> bool:
        raw = (" " + text).encode()
        return b"".join(map(self.a.bytes.__getitem__, x)) == raw and b"".join(map(self.b.bytes.__getitem__, y)) == raw

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list[str]]:
        """Per text n_a, n_b, n_groups, n_links and groups; of all links the id pairs, text by text."""
        ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
        for k, t in enumerate(texts):
            if not t or not self._whole(t, ids_a[k], ids_b[k]):
                ids_a[k], ids_b[k] = [], []
        a, b = _Side(self.size_a, ids_a), _Side(self.size_b, ids_b)
        cut_a, cut_b = common_cuts(a, b)
        link_a, link_b = links_in_slices(a, b, cut_a, cut_b)

        # Both lists of a group, one behind the other: its b tokens follow its a tokens.
        group_a = np.repeat(np.arange(len(cut_a) - 1), np.diff(cut_a))
        group_b = np.repeat(np.arange(len(cut_b) - 1), np.diff(cut_b))
        order = np.empty(len(a.ids) + len(b.ids), np.int64)
        in_last_a, in_last_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
        in_last_a[cut_a[1:] - 1] = in_last_b[cut_b[1:] - 1] = True
        order[np.arange(len(a.ids)) + cut_b[group_a]] = a.ids + in_last_a * len(self.more_a)
        order[np.arange(len(b.ids)) + cut_a[group_b + 1]] = (
            2 * len(self.more_a) + b.ids + in_last_b * self.width
        )
        words = list(map(self.shown.__getitem__, order.tolist()))
        at = (a.cut + b.cut).tolist()
        groups = ["".join(words[s:t])[:-1] for s, t in zip(at, at[1:])]
        first = np.searchsorted(link_a, a.cut)
        return {
            "n_a": a.n,
            "n_b": b.n,
            "n_groups": np.diff(np.searchsorted(cut_a[1:], a.cut, "right")),
            "n_links": np.diff(first),
            "groups": groups,
            "pairs": a.ids[link_a] * self.width + b.ids[link_b],
        }


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(*paths: str) -> Aligner:
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


_BLOCK = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, shas array<string>, links binary, pairs array<long>, times array<long>"
)


def _block_row(block: int, held: list[tuple[list, dict]]) -> pa.RecordBatch:
    """One block: its distinct pairs, and for every document the sorted places of its links' pairs among them."""
    keys = np.concatenate([h["pairs"] for _, h in held])
    n_links = np.concatenate([h["n_links"] for _, h in held])
    pairs, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(n_links)), n_links)
    place = place[np.lexsort((place, doc))]
    steps = np.diff(place, prepend=0).astype("<i4")
    shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for _, h in held for g in h["groups"]]
    per_doc = {k: np.concatenate([h[k] for _, h in held]) for k in ("n_a", "n_b", "n_groups")}
    columns = [
        pa.array([block], pa.int64()),
        pa.array([[d for ids, _ in held for d in ids]], pa.list_(pa.int64())),
        *(pa.array([per_doc[k]], pa.list_(pa.int64())) for k in ("n_a", "n_b", "n_groups")),
        pa.array([n_links], pa.list_(pa.int64())),
        pa.array([shas], pa.list_(pa.string())),
        pa.array([pa.compress(steps.tobytes(), "zstd", asbytes=True)], pa.binary()),
        pa.array([pairs], pa.list_(pa.int64())),
        pa.array([times], pa.list_(pa.int64())),
    ]
    names = [field.split(" ")[0] for field in _BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _blocks(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = _aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32
        held: list = []
        size = 0
        for batch in batches:
            texts, names = text_column(batch, "text"), batch.column(0)
            for lo, hi in row_chunks(texts, CHUNK_BYTES):
                strings = texts.slice(lo, hi - lo).to_pylist()
                held.append((names.slice(lo, hi - lo).to_pylist(), aligner.align(strings)))
                size += sum(map(len, strings)) + 64 * len(strings)
                if size >= BLOCK_BYTES:
                    yield _block_row(block, held)
                    held, size, block = [], 0, block + 1
        if held:
            yield _block_row(block, held)

    return run


_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _sum_counts(blocks: pa.Table, counted: pa.Table) -> pa.Table:
    """The documents of one block, with the corpus-wide counts of its pairs."""
    row = {name: blocks.column(name)[0] for name in blocks.column_names}
    n_links = np.array(row["n_links"].as_py(), np.int64)
    order = np.argsort(counted.column("pair").to_numpy())
    count = counted.column("n").to_numpy()[order]
    best = counted.column("best").to_numpy()[order].astype(np.int64)
    steps = np.frombuffer(pa.decompress(row["links"].as_py(), 4 * int(n_links.sum()), "zstd", asbytes=True), "<i4")
    place = np.cumsum(steps.astype(np.int64))
    cut = np.r_[0, np.cumsum(n_links)]
    sums = [np.r_[0, np.cumsum(x[place])][cut] if len(place) else np.zeros(len(cut), np.int64) for x in (best, count)]
    columns = [row[k].values for k in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
    columns += [pa.array(np.diff(s)) for s in sums] + [row["shas"].values]
    names = [field.split(" ")[0] for field in _RESULT.split(", ")]
    return pa.Table.from_arrays(columns, names=names)


def aligned_blocks(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """The blocks of ``docs`` (see ``_BLOCK``), written to the shared folder and read back."""
    spark = docs.sparkSession
    folder = work_folder(spark, "aligned")
    blocks = plain(docs, doc_id="doc_id:long", text="text:string").mapInArrow(
        releasing(_blocks(byte_path, piece_path)), _BLOCK
    )
    # A row holds megabytes, and Parquet keeps the rows of an open file in memory.
    blocks.write.option("maxRecordsPerFile", 8).parquet(folder)
    return spark.read.schema(blocks.schema).parquet(folder)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair and n: how many links of all blocks hold a pair, which is ``a * (number of b ids) + b``."""
    one = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    return one.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))


def align_tokens(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    Side a encodes a blank and the text by a byte-level BPE file, side b the text by a SentencePiece model
    that puts the blank itself; strings of special tokens are plain text. Null and empty texts, and texts
    whose bytes a side does not give back, have no tokens: zeros and ''. Rows are independent but for the
    counts, to which repeated rows add; a null doc_id is carried along; other columns are not read; an
    empty table gives no rows. A text of any length is one part of one block.
    """
    width = _aligner(byte_path, piece_path).width
    blocks = aligned_blocks(docs, byte_path, piece_path)
    counts = stored(pair_counts(blocks), "pair-counts")
    highest = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("b", F.col("pair") % width).join(highest, "b").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")
    )
    asked = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
    answered = asked.join(counts, "pair").select("of", "pair", "n", "best")
    whole = blocks.drop("pairs", "times")
    return whole.groupBy("block").cogroup(answered.groupBy("of")).applyInArrow(_sum_counts, _RESULT)
