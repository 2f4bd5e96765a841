"""Quality rules: statistics of whole texts, a hard base rule, and boosted trees over the statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import boosting
from sievework.llm.common import byte_buffer, plain, releasing, row_chunks, text_column
from sievework.llm.hashing import SpanHasher, lines, mix, shingles, words

WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[list(range(65, 91)) + list(range(97, 123)) + list(range(0xC3, 0xF5))] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Feature and direction in which it may move the log-odds of good quality (0: any).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "alpha_share": 0,
    "digit_share": 0,
    "upper_share": 0,
    "stop_share": 0,
    "words_per_line": 0,
    "sd_word": 0,
}


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(key: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(key)
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.zeros(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts and features of each text (no nulls)."""
    buf, offsets = byte_buffer(texts)
    n = len(texts)
    start, end, doc = words(buf, offsets)
    hasher = SpanHasher(buf)
    hashes = hasher.spans(start, end)
    out = {"n_words": np.bincount(doc, minlength=n)}
    in_word = np.zeros(len(buf) + 1, np.int8)
    in_word[start] += 1
    in_word[end] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    head = (buf & 0xC0) != 0x80
    out["word_chars"] = _per_text(in_word & head, offsets)
    out["n_symbols"] = _per_text(_SYMBOL[buf], offsets)

    l_start, l_end, l_doc = lines(buf, offsets)
    wordy = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
    l_start, l_end, l_doc = l_start[wordy], l_end[wordy], l_doc[wordy]
    salt = mix(np.arange(n, dtype=np.uint64))
    line_key = hasher.spans(l_start, l_end) + salt[l_doc]
    n_lines = np.bincount(l_doc, minlength=n)
    _, first = np.unique(line_key, return_index=True)
    out["n_dup_lines"] = n_lines - np.bincount(l_doc[first], minlength=n)

    grams, owner = shingles(hashes, doc, WINDOW, short=False)
    begins = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :]) if len(doc) >= WINDOW else []
    begins = np.asarray(begins, np.int64)[_repeats(grams + salt[owner])]
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, begins, 1)
    np.add.at(cover, begins + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)

    w, chars = np.maximum(out["n_words"], 1), np.maximum(out["word_chars"], 1)
    _, first = np.unique(hashes + salt[doc], return_index=True)
    c = np.r_[0, np.cumsum(head)]
    size = (c[end] - c[start]).astype(float)
    mean = np.bincount(doc, size, n) / w
    out["log_words"] = np.log(w)
    out["mean_word"] = mean
    out["sd_word"] = np.sqrt(np.maximum(np.bincount(doc, size * size, n) / w - mean * mean, 0))
    out["symbol_share"] = out["n_symbols"] / chars
    out["dup_line_share"] = out["n_dup_lines"] / np.maximum(n_lines, 1)
    out["repeat_share"] = out["n_repeat_words"] / w
    out["distinct_share"] = np.bincount(doc[first], minlength=n) / w
    for name, table in (("alpha", _ALPHA), ("digit", _DIGIT), ("upper", _UPPER), ("stop", _STOP)):
        out[f"{name}_share"] = _per_text(table[buf], offsets) / chars
    out["words_per_line"] = np.log(w / np.maximum(n_lines, 1))
    return out


def _all_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    parts = [statistics(texts.slice(lo, hi - lo)) for lo, hi in row_chunks(texts)]
    if not parts:
        parts = [statistics(texts)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.column_stack([stats[f] for f in FEATURES]).astype(float)


def _judge(stats: dict[str, np.ndarray], forest: boosting.Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])
    score = np.zeros(len(failed)) if forest is None else forest.score(_matrix(stats))
    return failed, score, ~failed & (score >= 0)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> boosting.Forest | None:
    """Boosted trees for ``labels.quality`` on at most ``max_rows`` labelled documents.

    The sample, ordered by a hash of the id, is the only thing that is bounded, and all that reaches the
    driver. None, which accepts every text that passes the base rule, if there are no labels of both kinds.
    """
    picked = (
        plain(labels, doc_id="doc_id:long", quality="quality:int")
        .where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # max_rows pairs of integers: their size has a bound.
    chosen = plain(docs, doc_id="doc_id:long", text="text:string").join(F.broadcast(picked), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _all_statistics(text_column(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(stats[f].astype(float)) for f in FEATURES)],
                names=["doc_id", "quality", *FEATURES],
            )

    schema = "doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = (
        chosen.select("doc_id", "text", "quality")
        .mapInArrow(releasing(measure), schema)
        .orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES)
        .limit(max_rows)
        .toPandas()
    )
    if rows["quality"].nunique() < 2:
        return None
    return boosting.fit(
        rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy(float), list(FEATURES.values())
    )


def score_documents(docs: DataFrame, forest: boosting.Forest | None) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score (log-odds) of every row of ``docs``.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged each; other
    columns are not read; an empty table gives no rows.
    """
    schema = (
        "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _all_statistics(text_column(batch, "text"))
            failed, score, kept = _judge(stats, forest)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(stats[c].astype(np.int64)) for c in COUNTS),
                    pa.array(failed),
                    pa.array(kept),
                    pa.array(score),
                ],
                names=["doc_id", *COUNTS, "base_failed", "kept", "score"],
            )

    return plain(docs, doc_id="doc_id:long", text="text:string").mapInArrow(releasing(judge), schema)


def keep_documents(docs: DataFrame, forest: boosting.Forest | None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, in one pass."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_judge(_all_statistics(text_column(batch, "text")), forest)[2]))

    return docs.mapInArrow(releasing(keep), docs.schema)
