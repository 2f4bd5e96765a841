"""Removal of lines that many documents share.

The hash space of line keys is cut into slices. Of a line that its task has met in one document only, a four-byte
code and the document's name go to the slice; a key that a task has met in several documents sends one mark for
all of them. A slice puts the codes into two Bloom filters, one of what was seen once and one of what was seen
twice, and answers with the documents of codes that the second filter holds. Only the lines behind these answers
are digested and shuffled, to be counted exactly, and the document that keeps its lines is chosen there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import byte_buffer, partitions, plain, releasing, row_chunks, stored, text_column
from sievework.llm.hashing import SpanHasher, lines, mix

#: Distinct (key, document) entries that a task holds before it sends them.
HELD_ENTRIES = 1 << 20
BITS_PER_ENTRY = 16
PROBES = 4
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INK = np.ones(256, bool)
_INK[[32, 9, 10, 11, 12, 13]] = False


class BloomFilter:
    """A set of 32-bit codes in a bit array; it never forgets a code."""

    def __init__(self, entries: int):
        size = max(1024, BITS_PER_ENTRY * entries)
        self.mask = _U((1 << (size - 1).bit_length()) - 1)
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)

    def _places(self, codes: np.ndarray) -> np.ndarray:
        h = mix(codes.astype(_U) + _U(1))
        step = (h >> _U(32)) | _U(1)
        return (h + np.arange(PROBES, dtype=_U)[:, None] * step) & self.mask

    def add(self, codes: np.ndarray) -> None:
        at = self._places(codes).ravel()
        np.bitwise_or.at(self.bits, at >> _U(3), np.uint8(1) << (at & _U(7)).astype(np.uint8))

    def has(self, codes: np.ndarray) -> np.ndarray:
        at = self._places(codes)
        return ((self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1).all(axis=0)


class KeyedLines:
    """The lines of a chunk of texts whose keys are long enough: text and line number, hash and bytes of the key."""

    def __init__(self, texts: pa.Array, min_chars: int):
        buf, self.offsets = byte_buffer(texts)
        self.buf, self.low = buf, _LOWER[buf]
        start, end, doc = lines(buf, self.offsets)
        ink = np.flatnonzero(_INK[buf])
        first, behind = np.searchsorted(ink, start), np.searchsorted(ink, end)
        some = behind > first
        start, doc, first, behind = start[some], doc[some], first[some], behind[some]
        lo, hi = ink[first], ink[behind - 1] + 1
        chars = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
        long = chars[hi] - chars[lo] >= min_chars
        self.start, self.doc, self.lo, self.hi = start[long], doc[long], lo[long], hi[long]
        self.hashes = SpanHasher(self.low).spans(self.lo, self.hi)

    def breaks(self) -> np.ndarray:
        """How many line ends stand before each byte."""
        return np.r_[0, np.cumsum(self.buf == 10)]

    def among(self, hashes: np.ndarray, lists: pa.ListArray, to: int = 64) -> np.ndarray:
        """Which lines have a hash, cut to ``to`` bits, in the list of their text."""
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        wanted = mix(mix(lists.flatten().to_numpy().astype(np.int64).view(_U)) + owner.astype(_U))
        return np.isin(mix(mix(hashes >> _U(64 - to)) + self.doc.astype(_U)), wanted)


def named(docs: DataFrame) -> DataFrame:
    """name, known and text: rows without a doc_id go by a hash of their text."""
    docs = plain(docs, doc_id="doc_id:long", text="text:string")
    return docs.select(
        F.coalesce("doc_id", F.xxhash64("text")).alias("name"), F.col("doc_id").isNotNull().alias("known"), "text"
    )


# What a row of codes is for: to be put into the filters and asked about, marked as seen twice, asked about only;
# or an answer that needs no filter.
PUT, MARK, ASK, FOUND = range(4)
_CODES = "slice int, kind int, codes binary, names binary"


def _code_rows(prefix: np.ndarray, name: np.ndarray, known: np.ndarray) -> Iterator[tuple]:
    """Rows (slice, kind, codes, names) of distinct (prefix, name) entries; a prefix is slice and code."""
    order = np.lexsort((name, ~known, prefix))
    prefix, name, known = prefix[order], name[order], known[order]
    fresh = np.r_[True, (prefix[1:] != prefix[:-1]) | (name[1:] != name[:-1]) | (known[1:] != known[:-1])]
    prefix, name, known = prefix[fresh], name[fresh], known[fresh]
    first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
    in_docs = np.add.reduceat(known.astype(np.int64), first)
    several = np.repeat(in_docs >= 2, np.diff(np.r_[first, len(prefix)]))
    if several.any():
        yield -1, FOUND, prefix[several & known], name[several & known]
        if (several & ~known).any():
            yield -2, FOUND, prefix[several & ~known], name[several & ~known]
    marked = prefix[first[in_docs >= 2]]
    for kind, codes, names in (
        (PUT, prefix[known & ~several], name[known & ~several]),
        (ASK, prefix[~known & ~several], name[~known & ~several]),
        (MARK, marked, np.zeros(0, np.int64)),
    ):
        if len(codes):
            part = (codes >> 32).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            for a, b in zip(cuts, cuts[1:]):
                yield int(part[a]), kind, codes[a:b].astype("<u4"), names[a:b]


def _codes(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = list(_code_rows(*(np.concatenate(x) for x in zip(*held))))
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int32()),
                    pa.array(columns[1], pa.int32()),
                    pa.array([c.tobytes() for c in columns[2]], pa.binary()),
                    pa.array([n.astype("<i8").tobytes() for n in columns[3]], pa.binary()),
                ],
                names=["slice", "kind", "codes", "names"],
            )

        for batch in batches:
            texts = text_column(batch, "text")
            name, known = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in row_chunks(texts):
                found = KeyedLines(texts.slice(lo, hi - lo), min_chars)
                if len(found.doc):
                    prefix = (found.hashes >> _U(32 - bits)).astype(np.int64)
                    held.append((prefix, name[lo + found.doc], known[lo + found.doc]))
                    size += len(prefix)
                if size >= HELD_ENTRIES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


_SUSPECT = "name long, known boolean, prefix long"


def _suspect_batch(names: np.ndarray, known: bool | np.ndarray, prefixes: np.ndarray) -> pa.RecordBatch:
    known = np.broadcast_to(known, len(names))
    arrays = [pa.array(names.astype(np.int64)), pa.array(known), pa.array(prefixes.astype(np.int64))]
    return pa.RecordBatch.from_arrays(arrays, names=["name", "known", "prefix"])


def _ask_filters(rows: pa.Table) -> pa.Table:
    """The entries of a slice whose code was seen twice, according to the filters."""
    part, kinds = rows.column("slice")[0].as_py(), rows.column("kind").to_pylist()
    codes = [np.frombuffer(c.as_py(), "<u4") for c in rows.column("codes")]
    entries = sum(map(len, codes))
    once, twice = BloomFilter(entries), BloomFilter(entries)
    for kind, c in zip(kinds, codes):
        if kind == PUT:
            twice.add(c[once.has(c)])
            once.add(c)
        elif kind == MARK:
            twice.add(c)
    out = [_suspect_batch(np.zeros(0), False, np.zeros(0))]
    for kind, c, names in zip(kinds, codes, rows.column("names")):
        if kind != MARK:
            hit = twice.has(c)
            out.append(_suspect_batch(np.frombuffer(names.as_py(), "<i8")[hit], kind == PUT, c[hit].astype(np.int64) | part << 32))
    return pa.Table.from_batches(out)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries that a task has found to be repeated by itself."""
    for batch in batches:
        for part, codes, names in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            yield _suspect_batch(np.frombuffer(names.as_py(), "<i8"), part == -1, np.frombuffer(codes.as_py(), "<i8"))


def suspected(docs: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """(name, known, prefix) of every line of named ``docs`` whose key may be in a second document.

    A prefix is the leading ``bits`` + 32 bits of the key's hash. No line of a repeated key is missing.
    """
    rows = stored(docs.mapInArrow(releasing(_codes(bits, min_chars)), _CODES), "line-codes")
    asked = rows.where(F.col("slice") >= 0).groupBy("slice").applyInArrow(_ask_filters, _SUSPECT)
    found = rows.where(F.col("slice") < 0).select("slice", "codes", "names").mapInArrow(_answers, _SUSPECT)
    return asked.union(found)


def _digests(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "text")
            for lo, hi in row_chunks(texts):
                found = KeyedLines(texts.slice(lo, hi - lo), min_chars)
                at = np.flatnonzero(found.among(found.hashes, batch.column(3).slice(lo, hi - lo), bits + 32))
                order = at[np.lexsort((found.hashes[at], found.doc[at]))]
                doc, h = found.doc[order], found.hashes[order]
                if len(order):
                    order = order[np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]]
                data, whole = found.low.data, [(a, b) for a, b in zip(found.lo[order].tolist(), found.hi[order].tolist())]
                rows = pa.array(lo + found.doc[order])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(found.hashes[order].view(np.int64)),
                        pa.array([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in whole], pa.binary()),
                    ],
                    names=["name", "known", "hash", "digest"],
                )

    return run


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(name, known, hashes) of named ``docs``: the line keys, as 64-bit hashes, that a document loses.

    Keys are counted by 128-bit digests of their whole bytes, over documents with an id; the largest id keeps.
    """
    bits = max(1, (partitions(docs.sparkSession) - 1).bit_length())
    suspects = suspected(docs, bits, min_chars).groupBy("name", "known").agg(F.collect_list("prefix").alias("prefixes"))
    lines_of = stored(
        docs.join(suspects, ["name", "known"]).select("name", "known", "text", "prefixes").mapInArrow(
            releasing(_digests(bits, min_chars)), "name long, known boolean, hash long, digest binary"
        ),
        "line-digests",
    )
    counted = lines_of.where("known").select("digest", "name").distinct()
    often = counted.groupBy("digest").agg(F.count("*").alias("n"), F.max("name").alias("keeper"))
    # Written, so that the join below deals both sides anew and can split the key of a very common line.
    often = stored(often.where(F.col("n") >= min_docs).drop("n"), "common-lines")
    lost = lines_of.join(often, "digest").where(~F.col("known") | (F.col("name") != F.col("keeper")))
    return lost.groupBy("name", "known").agg(F.collect_set("hash").alias("hashes"))


def _drop(min_chars: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "text")
            names = pc.if_else(batch.column(1), batch.column(0), pa.scalar(None, pa.int64()))
            for lo, hi in row_chunks(texts):
                chunk, lists = texts.slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo)
                found = KeyedLines(chunk, min_chars)
                gone = found.among(found.hashes, lists)
                breaks, at = found.breaks(), found.offsets
                n_lines = breaks[at[1:]] - breaks[at[:-1]] + 1
                n_gone = np.bincount(found.doc[gone], minlength=hi - lo)
                number = (breaks[found.start] - breaks[at[found.doc]])[gone]
                cut = np.r_[0, np.cumsum(n_gone)]
                data, kept = found.buf.tobytes(), []
                for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                    text = data[a:b]
                    if n_gone[k]:
                        drop = set(number[cut[k] : cut[k + 1]].tolist())
                        text = b"\n".join([line for j, line in enumerate(text.split(b"\n")) if j not in drop])
                    kept.append(hashlib.sha256(text).hexdigest() if digests else text.decode())
                yield pa.RecordBatch.from_arrays(
                    [names.slice(lo, hi - lo), pa.array(n_lines), pa.array(n_gone.astype(np.int64)), pa.array(kept, pa.string())],
                    names=["doc_id", "n_lines", "n_dropped", "kept_sha256" if digests else "text"],
                )

    return run


def _without(docs: DataFrame, min_chars: int, min_docs: int, digests: bool) -> DataFrame:
    docs = named(docs)
    lost = repeated_lines(docs, min_chars, min_docs)
    last = "kept_sha256" if digests else "text"
    return docs.join(lost, ["name", "known"], "left").select("name", "known", "text", "hashes").mapInArrow(
        releasing(_drop(min_chars, digests)), f"doc_id long, n_lines long, n_dropped long, {last} string"
    )


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and text of every row of ``docs``, without the lines that many documents share.

    A line's key is the line without blanks, tabs and other ASCII white space at its ends, A-Z lower-cased. Keys of
    at least ``min_chars`` code points in at least ``min_docs`` documents lose all their lines but those of the
    largest doc_id that has them; what is left is joined by line feeds. Texts are split at line feeds alone; a null
    or empty text is one empty line. Rows that repeat a doc_id are one document in the count and keep or lose their
    lines together; rows without a doc_id count for no key and lose their lines of repeated keys. Other columns are
    not read, and an empty table gives no rows.
    """
    return _without(docs, min_chars, min_docs, False)


def dropped_line_digests(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """As ``drop_lines``, with the lower-case hex SHA-256 of the remaining UTF-8 bytes instead of the text."""
    return _without(docs, min_chars, min_docs, True)
