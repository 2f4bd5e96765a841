"""Exact removal of byte strings that a document shares with a document of smaller id.

Windows of 50 bytes are never shuffled one by one. The least hash of the 16-byte strings in a window names it;
neighbouring windows mostly share that name and make a run. Equal windows hold equal named strings, and the 15
bytes to the left or to the right of it as well, so (1) runs of which neither 35-byte string occurs in another
document are ruled out first, by hashes alone, (2) only the bytes of the other runs go to shards by name, where (3) equal runs are matched whole and the rest by suffix order and common prefixes from
induced sorting, and (4) covered spans return to their documents. What a batch can settle by itself is settled
there, so a passage in very many documents costs a shard one entry a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import byte_buffer, partitions, plain, release_memory, releasing, row_chunks, text_column
from sievework.llm.hashing import SpanHasher
from sievework.llm.induced_sort import suffix_order

WINDOW = 50
GRAM = 16
BESIDE = (WINDOW - GRAM) // 2
SHARD_BYTES = 4 << 20
# A task holds about 200 bytes for each byte of a chunk; smaller chunks also stay in the cache.
BATCH_BYTES = 4 << 20
CHUNK = 1 << 19
OPEN = 1 << 31
_U = np.uint64


def anchor_runs(buf: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Runs of windows named by one string: text number, first window in the text, number of windows, name, and
    where the naming string stands in the buffer (of equal ones in a window it is the leftmost)."""
    none = np.zeros(0, np.int64)
    n = len(buf) - window + 1
    if n <= 0:
        return none, none, none, none.astype(_U), none
    least = gram_hashes(buf, gram)
    place = np.arange(len(least), dtype=np.int32)
    width, done = window - gram + 1, 1
    while done < width:
        step = min(done, width - done)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        done += step
    size = np.diff(offsets)
    change = np.zeros(n + 1, np.int8)
    full = size >= window
    np.add.at(change, offsets[:-1][full], 1)
    np.add.at(change, offsets[1:][full] - window + 1, -1)
    new = np.cumsum(change[:-1]) > 0
    new[1:] &= place[1:] != place[:-1]
    new[offsets[:-1][full]] = True
    start = np.flatnonzero(new)
    doc = np.searchsorted(offsets, start, "right") - 1
    stop = np.minimum(np.r_[start[1:], n], offsets[doc + 1] - window + 1)
    return doc, start - offsets[doc], stop - start, least[start], place[start].astype(np.int64)


def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position."""
    at = np.arange(len(buf) - gram + 1)
    return SpanHasher(buf).spans(at, at + gram)


def run_hashes(buf, offsets, doc, begin, size, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a run's named string with the bytes to its left, with those to its right (three bytes of each
    hash; near the ends of a text as many bytes as there are), and of the whole run."""
    hasher = SpanHasher(buf)
    left = hasher.spans(np.maximum(at - BESIDE, offsets[doc]), at + GRAM)
    right = hasher.spans(at, np.minimum(at + GRAM + BESIDE, offsets[doc + 1]))
    short = [(x >> _U(40)).astype(np.uint32) for x in (left, right)]
    return *short, hasher.spans(begin, begin + size)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of numbers, first all lowest ones, so that a block codec finds the empty high ones."""
    return x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _low3(x: np.ndarray) -> bytes:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _from_low3(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by keys (the first one leads), and where a new key begins in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _in_several(owner: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row whether its group has rows of different owners."""
    out = np.zeros(len(order), bool)
    if len(order):
        o = owner[order]
        several = np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)
        out[order] = np.repeat(several, np.diff(np.r_[first, len(order)]))
    return out


_NAMES = "shard int, known boolean, ids binary, ties binary, owner binary, hashes binary, item binary"


def _name_rows(shards: int):
    """Rows for the shards: names with their document and run; ``known`` ones are repeated for certain."""

    def pack(ids, ties, owner, run, name, left, right, whole, known):
        shard = (name % _U(shards)).astype(np.int64)
        order, first = _groups(known.astype(np.int64), shard, owner, run)
        cut = np.flatnonzero(np.r_[True, np.diff(shard[order] * 2 + known[order]) != 0]) if len(order) else []
        for rows in np.split(order, cut[1:]) if len(order) else []:
            used, local = np.unique(owner[rows], return_inverse=True)
            hit = bool(known[rows[0]])
            yield {
                "shard": int(shard[rows[0]]),
                "known": hit,
                "ids": _planes(np.diff(ids[used], prepend=0)),
                "ties": _planes(ties[used]),
                "owner": _planes(np.diff(local.astype("<u4"), prepend=np.zeros(1, "<u4"))),
                "hashes": b"" if hit else _low3(left[rows]) + _low3(right[rows]) + whole[rows].tobytes(),
                "item": _planes(run[rows].astype("<u4")),
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for ids, ties, texts in _gathered(batches):
            found, base = [], 0
            for lo, hi in row_chunks(texts, CHUNK):
                buf, offsets = byte_buffer(texts.slice(lo, hi - lo))
                doc, first, n, name, at = anchor_runs(buf, offsets)
                begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
                nth = np.arange(len(doc)) - np.repeat(begins, np.diff(np.r_[begins, len(doc)]))
                hashes = run_hashes(buf, offsets, doc, offsets[doc] + first, n + WINDOW - 1, at)
                found.append(((doc + base).astype(np.int32), nth.astype(np.int32), name, *hashes))
                base += hi - lo
            owner, nth, name, left, right, whole = (np.concatenate(x) for x in zip(*found))
            del found
            # A whole run that a smaller document of the batch has is settled; that one speaks for both.
            known = ids[owner] > _least(whole, name, ids[owner])
            rows = []
            for part, flag in ((~known, False), (known, True)):
                columns = (x[part] for x in (owner, nth, name, left, right, whole))
                rows += pack(ids, ties, *columns, np.full(int(part.sum()), flag))
            yield pd.DataFrame(rows, columns=["shard", "known", "ids", "ties", "owner", "hashes", "item"])

    return _as_arrow(run, _NAMES)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Batches (doc_id, tie, text, ...) joined or cut to at most ``BATCH_BYTES`` of text; a longer text is alone."""
    held, size = [], 0

    def out():
        ids, ties, texts = zip(*held)
        return np.concatenate(ids), np.concatenate(ties), pa.concat_arrays(texts)

    for batch in batches:
        texts = text_column(batch, "text").cast(pa.large_string())
        ids, ties = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("doc_id", "tie"))
        sizes = pc.binary_length(texts).to_numpy()
        for lo, hi in row_chunks(texts, BATCH_BYTES):
            more = int(sizes[lo:hi].sum())
            if held and size + more > BATCH_BYTES:
                yield out()
                held, size = [], 0
            held.append((ids[lo:hi], ties[lo:hi], texts.slice(lo, hi - lo)))
            size += more
    if held:
        yield out()


_KINDS = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _as_arrow(run, schema: str):
    fields = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in schema.split(", ")])

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(batches):
            for lo in range(0, len(frame), 2000):
                yield pa.RecordBatch.from_pandas(frame.iloc[lo : lo + 2000], schema=fields, preserve_index=False)

    return releasing(wrapped)


_RUNS = "doc_id long, tie long, item binary"


def _by_document(ids: np.ndarray, ties: np.ndarray, items: np.ndarray) -> pd.DataFrame:
    """One row a document with its items (rows of numbers)."""
    order, first = _groups(ids, ties)
    cut = np.r_[first, len(order)]
    return pd.DataFrame(
        {
            "doc_id": ids[order[first]],
            "tie": ties[order[first]],
            "item": [items[order[a:b]].astype("<u4").tobytes() for a, b in zip(cut, cut[1:])],
        }
    )


def _repeated_names(shard: pd.DataFrame) -> pd.DataFrame:
    """Runs that a smaller document has whole, and with ``OPEN`` added those whose bytes must be seen.

    Bytes are needed of the runs of the least document that has them, if another run and another document share
    the named string and the bytes on one side.
    """
    parts = []
    for row in shard.itertuples():
        own = np.cumsum(_from_planes(row.owner, "<u4"), dtype=np.int64)
        n, data = len(own), row.hashes
        if row.known:
            hashes = np.zeros(n, "<u4"), np.zeros(n, "<u4"), np.zeros(n, "<u8")
        else:
            hashes = _from_low3(data[: 3 * n]), _from_low3(data[3 * n : 6 * n]), np.frombuffer(data[6 * n :], "<u8")
        parts.append(
            (
                np.cumsum(_from_planes(row.ids, "<i8"))[own],
                _from_planes(row.ties, "<i8")[own],
                _from_planes(row.item, "<u4"),
                *hashes,
                np.full(n, row.known),
            )
        )
    ids, ties, items, left, right, whole, covered = (np.concatenate(x) for x in zip(*parts))
    tested = np.flatnonzero(~covered)
    covered[tested] = ids[tested] > _least(whole[tested], whole[tested], ids[tested])
    open_ = np.zeros(len(ids), bool)
    for side in (left, right):
        order, first = _groups(side[tested])
        open_[tested] |= _in_several(whole[tested], order, first) & _in_several(ids[tested], order, first)
    open_ &= ~covered
    keep = covered | open_
    found = _by_document(ids[keep], ties[keep], items[keep] | np.where(open_[keep], OPEN, 0).astype("<u4"))
    release_memory()
    return found


_PIECES = "shard int, known boolean, ids binary, ties binary, start binary, size binary, name binary, bytes binary"


def _piece_rows(shards: int):
    """Bytes of the listed runs for the shards; whole runs that a smaller document of the batch has are known."""

    def pack(ids, ties, start, size, name, begin, buf, known):
        shard = (name % _U(shards)).astype(np.int64)
        order = np.lexsort((start, ids, shard, known))
        cut = np.flatnonzero(np.r_[True, np.diff(shard[order] * 2 + known[order]) != 0]) if len(order) else []
        for rows in np.split(order, cut[1:]) if len(order) else []:
            hit, n = bool(known[rows[0]]), size[rows]
            total = np.cumsum(n)
            at = np.arange(total[-1]) + np.repeat(begin[rows] - (total - n), n)
            yield {
                "shard": int(shard[rows[0]]),
                "known": hit,
                "ids": _planes(ids[rows]),
                "ties": _planes(ties[rows]),
                "start": _planes(start[rows].astype("<u4")),
                "size": _planes(n.astype("<u4")),
                "name": b"" if hit else name[rows].tobytes(),
                "bytes": b"" if hit else buf[at].tobytes(),
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.filter(batch.column(batch.schema.get_field_index("items")).is_valid())
            texts, listed = text_column(batch, "text"), batch.column(batch.schema.get_field_index("items"))
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            all_ties = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in row_chunks(texts, CHUNK):
                buf, offsets = byte_buffer(texts.slice(lo, hi - lo))
                doc, start, n, name, _ = anchor_runs(buf, offsets)
                begins = np.searchsorted(doc, np.arange(hi - lo))
                use, covered = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
                for k in range(hi - lo):
                    for part in listed[lo + k].as_py():
                        item = np.frombuffer(part, "<u4")
                        mine = begins[k] + (item & (OPEN - 1)).astype(np.int64)
                        use[mine] = True
                        covered[mine[item < OPEN]] = True
                doc, start, size = doc[use], start[use], n[use] + WINDOW - 1
                name, covered = name[use], covered[use]
                begin = offsets[doc] + start
                ids, ties = all_ids[lo:hi][doc], all_ties[lo:hi][doc]
                whole = SpanHasher(buf).spans(begin, begin + size)
                covered |= ids > _least(whole, name, ids)
                rest = ~covered
                # Covered runs that touch are one span.
                c_doc, a, b = doc[covered], start[covered], (start + size)[covered]
                new = np.flatnonzero(np.r_[True, (c_doc[1:] != c_doc[:-1]) | (a[1:] > b[:-1])][: len(a)])
                last = np.r_[new[1:], len(a)][: len(new)] - 1
                spans = (ids[covered][new], ties[covered][new], a[new], b[last] - a[new], name[covered][new])
                rows = list(pack(*spans, begin[covered][new], buf, np.ones(len(new), bool)))
                open_ = (x[rest] for x in (ids, ties, start, size, name, begin))
                rows += pack(*open_, buf, np.zeros(int(rest.sum()), bool))
                yield pd.DataFrame(
                    rows, columns=["shard", "known", "ids", "ties", "start", "size", "name", "bytes"]
                )

    return _as_arrow(run, _PIECES)


def _least(whole: np.ndarray, name: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the least document id that has an equal run."""
    order, first = _groups(whole, name)
    out = np.zeros(len(order), np.int64)
    if len(order):
        out[order] = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.r_[first, len(order)]))
    return out


def covered_windows(pieces: np.ndarray, bounds: np.ndarray, ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which byte positions begin a window that also begins in a piece of smaller document id.

    ``pieces``: bytes on end; piece ``k`` lies between ``bounds[k]`` and ``bounds[k + 1]``.
    """
    n = len(bounds) - 1
    size = np.diff(bounds)
    text = np.zeros(len(pieces) + n, np.uint16)
    where = np.arange(len(pieces)) + np.repeat(np.arange(n), size)
    text[where] = pieces.astype(np.uint16) + 1
    order, share = suffix_order(text, window)
    begin = bounds[:-1] + np.arange(n)
    piece = np.searchsorted(begin, order, "right") - 1
    is_window = order + window <= begin[piece] + size[piece]
    group = np.cumsum(share < window)[is_window]
    order, piece = order[is_window], piece[is_window]
    out = np.zeros(len(pieces), bool)
    if len(order):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        least = np.repeat(np.minimum.reduceat(ids[piece], first), np.diff(np.r_[first, len(group)]))
        hit = ids[piece] > least
        out[(order - piece)[hit]] = True
    return out


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def _match_pieces(shard: pd.DataFrame) -> pd.DataFrame:
    """Covered spans (first byte, end) by document."""
    ids, ties, start, size, name, data, passed = [], [], [], [], [], [], []
    for row in shard.itertuples():
        n = _from_planes(row.size, "<u4").astype(np.int64)
        ids.append(_from_planes(row.ids, "<i8"))
        ties.append(_from_planes(row.ties, "<i8"))
        start.append(_from_planes(row.start, "<u4").astype(np.int64))
        size.append(n)
        name.append(np.zeros(len(n), "<u8") if row.known else np.frombuffer(row.name, "<u8"))
        data.append(row.bytes)
        passed.append(np.full(len(n), row.known))
    ids, ties, start, size, name, passed = map(np.concatenate, (ids, ties, start, size, name, passed))
    out = [(ids[passed], ties[passed], start[passed], (start + size)[passed])]
    live = ~passed
    ids, ties, start, size, name = ids[live], ties[live], start[live], size[live], name[live]
    buf = np.frombuffer(b"".join(data), np.uint8)
    end = np.cumsum(size)
    begin = end - size
    whole = SpanHasher(buf).spans(begin, end)
    least = _least(whole, name, ids)
    later = ids > least
    out.append((ids[later], ties[later], start[later], (start + size)[later]))

    # One of each distinct run goes on, if its name has several.
    order, first = _groups(name, whole)
    one = order[first]
    n_order, n_first = _groups(name[one])
    several = np.zeros(len(one), bool)
    if len(one):
        count = np.diff(np.r_[n_first, len(one)])
        several[n_order] = np.repeat(count > 1, count)
    one = one[several]
    if len(one):
        n = size[one]
        bounds = np.r_[0, np.cumsum(n)]
        at = np.arange(bounds[-1]) + np.repeat(begin[one] - bounds[:-1], n)
        flags = covered_windows(buf[at], bounds, least[one])
        # All runs equal to it in its document share what was found.
        by_whole = {}
        for k, (w, m) in enumerate(zip(whole[one].tolist(), name[one].tolist())):
            by_whole[w, m] = k
        mine = np.flatnonzero(~later)
        for e in mine.tolist():
            k = by_whole.get((int(whole[e]), int(name[e])))
            if k is None:
                continue
            piece = flags[bounds[k] : bounds[k + 1]]
            if piece.any():
                a, b = _spans(piece)
                m = len(a)
                out.append(
                    (np.full(m, ids[e]), np.full(m, ties[e]), start[e] + a, start[e] + b + WINDOW - 1)
                )
    ids, ties, lo, hi = (np.concatenate(x) for x in zip(*out))
    found = _by_document(ids, ties, np.column_stack([lo, hi]))
    release_memory()
    return found


def _assemble(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, listed = text_column(batch, "text"), batch.column(batch.schema.get_field_index("items"))
            n_bytes, removed, spans, digest, kept_texts = [], [], [], [], []
            for text, items in zip(texts, listed):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                cover = np.zeros(len(raw) + 1, np.int32)
                for part in items.as_py() or []:
                    pairs = np.frombuffer(part, "<u4").reshape(-1, 2)
                    np.add.at(cover, pairs[:, 0], 1)
                    np.add.at(cover, pairs[:, 1], -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept = raw[~gone].tobytes()
                n_bytes.append(len(raw))
                removed.append(int(gone.sum()))
                spans.append(len(_spans(gone)[0]))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept)
            arrays = [
                batch.column(0),
                batch.column(1),
                pa.array(n_bytes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array(digest, pa.string()),
            ]
            names = ["doc_id", "tie", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(kept_texts, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return releasing(run)


def _with_spans(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, tie, text and others) with ``items``, the spans to remove of each row.

    Both joins keep all rows and columns of the texts, so that one exchange of the texts serves both.
    """
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = max(partitions(spark), -(-total // SHARD_BYTES))
    names = texts.where("doc_id is not null").select("doc_id", "tie", "text").mapInArrow(_name_rows(shards), _NAMES)
    runs = names.groupBy("shard").applyInPandas(_repeated_names, _RUNS)
    listed = runs.groupBy("doc_id", "tie").agg(F.collect_list("item").alias("items"))
    pieces = texts.join(listed, ["doc_id", "tie"], "left").mapInArrow(_piece_rows(shards), _PIECES)
    spans = pieces.groupBy("shard").applyInPandas(_match_pieces, _RUNS)
    found = spans.groupBy("doc_id", "tie").agg(F.collect_list("item").alias("items"))
    return texts.join(found, ["doc_id", "tie"], "left")


def _tie(docs: DataFrame, text: Column) -> Column:
    """What tells rows of one id apart: nothing, unless an id is repeated."""
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count()
    # Not a literal: the two joins of the texts are to have the same keys and so share one exchange.
    same = F.xxhash64(text) if repeated else F.xxhash64("doc_id").bitwiseAND(F.lit(0))
    # Rows without an id match nothing and are spread by their text.
    return F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(same)


def dedup_spans(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes left) of every row of ``docs``.

    A byte goes if it lies in a string of 50 bytes that also starts in a document of smaller ``doc_id``; all is
    judged on the input. Null and empty texts have no bytes. A null id is neither smaller nor greater: nothing is
    removed there, and nothing elsewhere for it. Rows that share an id do not remove from each other; repeated rows
    give repeated results. Other columns are not read. An empty table gives no rows.
    """
    texts = plain(docs, doc_id="doc_id:long", text="text:string")
    texts = texts.withColumn("tie", _tie(docs, F.col("text")))
    schema = "doc_id long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    rows = _with_spans(texts.select("doc_id", "tie", "text")).mapInArrow(
        _assemble(with_text), schema + (", kept binary" if with_text else "")
    )
    return rows.drop("tie")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the repeated bytes cut from ``text``; all columns stay, ``n_chars`` is counted anew.

    A cut may leave part of a character; such bytes are dropped. A document of which nothing is left goes.
    """
    columns = docs.columns
    rest = [f"x{k}" for k in range(len(columns))]
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _tie(docs, F.col("text").cast("string")).alias("tie"),
        F.col("text").cast("string").alias("text"),
        F.struct(*(F.col(f"`{c}`").alias(r) for c, r in zip(columns, rest) if c != "text")).alias("row"),
    )
    cut = _with_spans(named)
    left = F.pandas_udf(_left_text, "string")(F.col("text"), F.col("items"))
    done = cut.withColumn("text", F.when(F.col("items").isNull(), F.col("text")).otherwise(left))
    done = done.where("items is null or text != ''")
    out = [F.col("text") if c == "text" else F.col(f"row.{r}").alias(c) for c, r in zip(columns, rest)]
    result = done.select(*out)
    return result.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else result


def _left_text(text: pd.Series, items: pd.Series) -> pd.Series:
    out = []
    for t, parts in zip(text, items):
        if t is None or parts is None or len(parts) == 0:
            out.append(t)
            continue
        raw = np.frombuffer(t.encode(), np.uint8)
        keep = np.ones(len(raw), bool)
        for part in parts:
            for a, b in np.frombuffer(part, "<u4").reshape(-1, 2):
                keep[a:b] = False
        out.append(raw[keep].tobytes().decode("utf-8", "ignore"))
    return pd.Series(out)
