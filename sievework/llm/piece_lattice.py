"""SentencePiece encoding by suffix-array matching, and decoding.

The units of a batch (a run of blanks and the word behind it) are laid on end and indexed by a suffix array
as deep as the longest piece. Every piece is looked up by binary search; the positions in its range are
edges of the lattice. Sorted by where they end, the edges are relaxed from left to right. For a BPE model the
relaxation keeps, at each position, the one edge that byte-pair merging would leave last there: an edge fits
behind the best edge of its start if no merge across the seam comes before the merges on either side.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.llm.common import UnitCache, plain, releasing, row_chunks, text_column

SPACE = "▁"
CHUNK_BYTES = 1 << 19
GROUP = 12_000
_NEVER = np.int64(1 << 40)


class PieceModel:
    """The pieces of a BPE model file and what merging needs to know of them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        is_byte = [sp.is_byte(i) for i in range(n)]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if b else b"" if s else p.encode()
            for p, b, s in zip(self.pieces, is_byte, special)
        ]
        self.byte_id = np.zeros(256, np.uint32)
        for i in range(n):
            if is_byte[i]:
                self.byte_id[self.bytes[i][0]] = i
        self.normal = [i for i in range(n) if not special[i] and not is_byte[i]]
        self.ids = {self.pieces[i]: i for i in self.normal}
        # Merge order: the highest score first. Equal scores belong to one piece, or keep their id order.
        by_score = sorted(self.normal, key=lambda i: (-sp.get_score(i), i))
        self.rank = np.full(n + 1, _NEVER, np.int64)
        self.rank[by_score] = np.arange(len(by_score))
        for i in self.normal:
            if any(c == SPACE for c in self.pieces[i].lstrip(SPACE)):
                raise ValueError("a piece has a blank behind other characters")
        self.unknown = n
        self._pairs()
        self._spines()
        self._keys()

    def _pairs(self) -> None:
        """All ways to make a piece of two pieces: sorted keys, and the rank of what they make."""
        keys, ranks = [], []
        for i in self.normal:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ranks.append(self.rank[i])
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ranks = np.array(ranks, np.int64)[order]
        self.pair_of = dict(zip(keys, ranks))

    def _merged(self, piece: str):
        """The merges of a piece on its own: ([left, right, made], ...), and whether it becomes one."""
        parts = [self.ids[c] if c in self.ids else -1 for c in piece]
        by_rank = {}
        done = []
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                r = self.pair_of.get(parts[k] << 20 | parts[k + 1]) if min(parts[k], parts[k + 1]) >= 0 else None
                if r is not None and (best is None or r < best[0]):
                    best = (r, k)
            if best is None:
                break
            r, k = best
            if r not in by_rank:
                by_rank[r] = self.ids[self.pieces[parts[k]] + self.pieces[parts[k + 1]]]
            done.append((parts[k], parts[k + 1], by_rank[r], k, k + 2 == len(parts)))
            parts[k : k + 2] = [by_rank[r]]
        return done, len(parts) == 1

    def _spines(self) -> None:
        """For each piece the parts that touch its left and right end, from the character up."""
        n, depth = len(self.pieces) + 1, 18
        self.right = np.full((n, depth), self.unknown, np.int64)
        self.left = np.full((n, depth), self.unknown, np.int64)
        self.self_made = np.zeros(n, bool)
        for i in self.normal:
            p = self.pieces[i]
            done, self.self_made[i] = self._merged(p)
            lefts = [self.ids.get(p[0], self.unknown)] + [m for _, _, m, k, _ in done if k == 0]
            rights = [self.ids.get(p[-1], self.unknown)] + [m for _, _, m, _, last in done if last]
            self.left[i, : len(lefts)] = lefts
            self.right[i, : len(rights)] = rights
        # When a part is taken up by the next one; the piece itself never is.
        self.left_rank, self.right_rank = self.rank[self.left], self.rank[self.right]

    def _keys(self) -> None:
        """Characters as 16-bit codes, and the pieces as byte strings in them."""
        chars = sorted({c for i in self.normal for c in self.pieces[i]})
        if len(chars) >= 0xFFFE:
            raise ValueError("too many characters for 16-bit codes")
        self.deep = max(len(self.pieces[i]) for i in self.normal)
        # 0 ends a unit, 1 stands for every character that no piece has.
        self.code = np.ones(0x110000, np.uint16)
        self.code[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
        self.order = np.array(self.normal, np.int32)
        self.size = np.array([len(self.pieces[i]) for i in self.normal], np.int32)
        low = np.zeros((len(self.order), self.deep), ">u2")
        high = np.full((len(self.order), self.deep), 0xFFFF, ">u2")
        for k, i in enumerate(self.normal):
            codes = self.code[[ord(c) for c in self.pieces[i]]]
            low[k, : len(codes)] = high[k, : len(codes)] = codes
        self.low, self.high = low.view(f"S{2 * self.deep}").ravel(), high.view(f"S{2 * self.deep}").ravel()
        # In the order of the suffix array, so that neighbouring look-ups meet the same part of it.
        sort = np.argsort(self.low, kind="stable")
        self.order, self.size, self.low, self.high = self.order[sort], self.size[sort], self.low[sort], self.high[sort]

    def _across(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether merging ``before + piece`` leaves just these two.

        Both sides merge on their own until the seam is the next to merge. Of equal merges the leftmost
        comes first: one left of the seam wins over it, one right of it does not.
        """
        out = self.self_made[piece] | (piece == self.unknown)
        live = np.flatnonzero(out & (before != self.unknown) & (piece != self.unknown))
        i, j = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        while len(live):
            p, q = before[live], piece[live]
            next_left, next_right = self.right_rank[p, i + 1], self.left_rank[q, j + 1]
            seam = self._across(self.right[p, i], self.left[q, j])
            bad = (seam < next_left) & (seam <= next_right) & (seam < _NEVER)
            out[live[bad]] = False
            go = ~bad & ((next_left < _NEVER) | (next_right < _NEVER))
            step = next_left <= next_right
            i, j, live = (i + step)[go], (j + ~step)[go], live[go]
        return out

    def units(self, text: str) -> list[str]:
        """A text as units that no piece crosses; the blank put before every text is included."""
        if not text:
            return []
        if SPACE not in text and "  " not in text and " \n" not in text and text[0] not in " \n" and text[-1] != " ":
            # A unit that begins with a line feed has no blank of its own.
            return text.replace("\n", " \n").split(" ")
        marked = SPACE + text.replace(" ", SPACE)
        return ["\0" + u for u in re.findall(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", marked)]

    def learn(self, cache: UnitCache, new: list[str]) -> None:
        for lo in range(0, len(new), GROUP):
            group = new[lo : lo + GROUP]
            spelled = [u[1:] if u[:1] == "\0" else u if u[:1] == "\n" else SPACE + u for u in group]
            cache.extend(group, *self.encode_units(spelled))

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units on end, and the number of each unit's ids."""
        joined = "\0".join(units) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.array([len(u) for u in units])
        end = np.cumsum(size + 1) - 1
        start = end - size
        codes = self.code[points]
        codes[end] = 0
        n = len(codes)

        padded = np.r_[codes, np.zeros(self.deep, np.uint16)].astype(">u2")
        deep = np.lib.stride_tricks.sliding_window_view(padded, self.deep)[:n]
        keys = np.ascontiguousarray(deep).view(f"S{2 * self.deep}").ravel()
        suffixes = np.argsort(keys, kind="stable").astype(np.int32)
        ordered = keys[suffixes]
        lo, hi = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        total = int(count.sum())
        nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        begin = suffixes[np.repeat(lo[found], count) + nth]
        token, length = np.repeat(self.order[found], count), np.repeat(self.size[found], count)
        odd = np.flatnonzero(codes == 1).astype(np.int32)
        begin = np.r_[begin, odd]
        token = np.r_[token, np.full(len(odd), self.unknown, np.int32)]
        length = np.r_[length, np.ones(len(odd), np.int32)]

        unit = np.repeat(np.arange(len(units), dtype=np.int32), size + 1)
        owner = unit[begin]
        stop = begin + length
        step = (stop - start[owner]).astype(np.int32)
        # Numbers of 16 bits are sorted by their digits.
        order = np.argsort(step.astype(np.uint16) if size.max(initial=0) < 1 << 16 else step, kind="stable")
        begin, token, stop, step, owner = begin[order], token[order], stop[order], step[order], owner[order]
        cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]) if len(step) else np.zeros(0, np.int64)
        best = np.full(n + 1, -1, np.int64)
        for a, b in zip(cuts, np.r_[cuts[1:], len(step)]):
            s, t = begin[a:b], token[a:b]
            first = s == start[owner[a:b]]
            prev = np.where(first, self.unknown, best[s])
            ok = np.flatnonzero(prev >= 0)
            ok = ok[self.fits(prev[ok], t[ok])]
            best[stop[a:b][ok]] = t[ok]

        sizes = np.ones(self.unknown + 1, np.int64)
        sizes[self.order] = self.size
        at, live, left = end.copy(), np.flatnonzero(size > 0), np.full(n, -1, np.int64)
        while len(live):
            piece = best[at[live]]
            if (piece < 0).any():
                raise ValueError("no way through a unit")
            at[live] -= sizes[piece]
            left[at[live]] = piece
            live = live[at[live] > start[live]]
        where = np.flatnonzero(left >= 0)
        who, what = unit[where], left[where]
        odd = np.flatnonzero(what == self.unknown)
        if len(odd):
            # A character that no piece has becomes its bytes.
            spelled = [chr(p).encode() for p in points[where[odd]].tolist()]
            times = np.ones(len(what), np.int64)
            times[odd] = [len(x) for x in spelled]
            first = np.cumsum(times)[odd] - times[odd]
            who, what = np.repeat(who, times), np.repeat(what, times)
            held = np.frombuffer(b"".join(spelled), np.uint8)
            nth = np.arange(len(held)) - np.repeat(np.cumsum(times[odd]) - times[odd], times[odd])
            what[np.repeat(first, times[odd]) + nth] = self.byte_id[held]
        return what, np.bincount(who, minlength=len(units))

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are joined to characters, the blank put in front is taken off."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


_MODELS: dict[str, tuple[PieceModel, UnitCache]] = {}


def _model(path: str) -> tuple[PieceModel, UnitCache]:
    if path not in _MODELS:
        model = PieceModel(path)
        _MODELS[path] = (model, UnitCache(model.learn))
    return _MODELS[path]


def _encoded(batch: pa.RecordBatch, path: str) -> Iterator[tuple[int, int, list[str], list[np.ndarray]]]:
    model, cache = _model(path)
    texts = text_column(batch, "text")
    for lo, hi in row_chunks(texts, CHUNK_BYTES):
        strings = texts.slice(lo, hi - lo).to_pylist()
        ids, n = cache.encode([model.units(t) for t in strings])
        cut = np.r_[0, np.cumsum(n)]
        yield lo, hi, strings, [ids[a:b] for a, b in zip(cut, cut[1:])]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and n_pieces of every row of ``docs``, from the whole text.

    The model is a SentencePiece BPE model with byte fallback that puts a blank before a text and
    normalises nothing else. Null and empty texts have no ids. Rows are independent: repeated rows give
    repeated results, other columns are not read, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, ids in _encoded(batch, model_path):
                cut = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(flat)),
                        pa.array(np.diff(cut).astype(np.int64)),
                    ],
                    names=["doc_id", "ids", "n_pieces"],
                )

    return plain(docs, doc_id="doc_id:long", text="text:string").mapInArrow(
        releasing(run), "doc_id long, ids array<int>, n_pieces long"
    )


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of encoded rows (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)[0]
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return plain(encoded, doc_id="doc_id:long", ids="ids:array<int>").mapInArrow(run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids) and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)[0]
        for batch in batches:
            for lo, hi, strings, ids in _encoded(batch, model_path):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array([model.decode(x.tolist()) == t.replace(SPACE, " ") for x, t in zip(ids, strings)]),
                    ],
                    names=["doc_id", "n_pieces", "ids_crc32", "round_trip"],
                )

    return plain(docs, doc_id="doc_id:long", text="text:string").mapInArrow(
        releasing(run), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean"
    )
