"""Masked pseudo-likelihood of documents under a bidirectional window network.

Each word is predicted from the words on both sides of it. The vocabulary is the most frequent words of the
whole corpus and hash buckets for all others, in classes of equal size; the network predicts the class, then
the word in its class. It grows with the number of distinct words. A word outside it has the probability of its
bucket times its share of the bucket's count, from the counts of all words. Every document trains the network once: the corpus is dealt into rounds, in a round
each partition runs its own gradient steps from the common parameters, and these are averaged by tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import byte_buffer, plain, row_chunks, stored, text_column
from sievework.llm.hashing import mix, word_hashes

SIDE = 2
# The smallest network; ``classes_for`` gives the size of larger ones.
CLASSES = 32
PER_CLASS = 32
VOCABULARY = CLASSES * PER_CLASS
KNOWN = VOCABULARY - PER_CLASS
WIDTH = 8
HIDDEN = 16
BLOCK = 16_384
GROUP = 512
CHUNK_TEXT = 1 << 24
OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]


def shapes(classes: int = CLASSES, per_class: int = PER_CLASS) -> dict[str, tuple[int, ...]]:
    return {
        "embed": (classes * per_class + 1, WIDTH),
        "w1": (len(OFFSETS) * WIDTH, HIDDEN),
        "b1": (HIDDEN,),
        "wc": (HIDDEN, classes),
        "bc": (classes,),
        "wo": (classes, HIDDEN, per_class),
        "bo": (classes, per_class),
    }


def n_parameters(classes: int = CLASSES, per_class: int = PER_CLASS) -> int:
    return sum(int(np.prod(s)) for s in shapes(classes, per_class).values())


N_PARAMETERS = n_parameters()


def classes_for(distinct: int) -> int:
    """Number of classes, and of words in each: the vocabulary is four times the root of the distinct words."""
    return max(CLASSES, int(np.ceil(2 * distinct**0.25)))


@dataclass
class Network:
    """Parameters as one vector, with a view for each part."""

    flat: np.ndarray
    classes: int = CLASSES
    per_class: int = PER_CLASS

    def __post_init__(self):
        at = 0
        for name, shape in shapes(self.classes, self.per_class).items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n


def initial(class_counts: np.ndarray, word_counts: np.ndarray, seed: int = 3) -> Network:
    """Small random weights; the biases start at the log frequencies of classes and words."""
    rng = np.random.default_rng(seed)
    classes, per_class = len(class_counts), len(word_counts) // len(class_counts)
    flat = rng.normal(0, 0.15, n_parameters(classes, per_class)).astype(np.float32)
    net = Network(flat, classes, per_class)
    net.b1[:] = 0
    net.bc[:] = np.log((class_counts + 1) / (class_counts.sum() + classes))
    words = word_counts.reshape(classes, per_class) + 1.0
    net.bo[:] = np.log(words / words.sum(axis=1, keepdims=True))
    return net


def contexts(tokens: np.ndarray, offsets: np.ndarray, outside: int = VOCABULARY) -> np.ndarray:
    """For each token the tokens around it; past the ends of its document stands ``outside``."""
    n = len(tokens)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.full((n, len(OFFSETS)), outside, np.int64)
    for k, o in enumerate(OFFSETS):
        src, dst = (slice(0, n + o), slice(-o, n)) if o < 0 else (slice(o, n), slice(0, n - o))
        same = doc[src] == doc[dst]
        out[dst, k][same] = tokens[src][same]
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    """Softmax of each column, in the place of ``x``."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of one entry of each column; ``x`` is overwritten."""
    x -= x.max(axis=0)
    picked = x[at, np.arange(x.shape[1])]
    return picked - np.log(np.exp(x, out=x).sum(axis=0))


def _by_class(cls: np.ndarray, classes: int) -> tuple[np.ndarray, list[list[tuple[int, slice]]]]:
    """Order of the tokens by class, and the place of each class that has any, in groups that fit the cache."""
    cuts = np.r_[0, np.cumsum(np.bincount(cls, minlength=classes))].tolist()
    groups, full = [], 0
    for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            if b > full:
                groups.append([])
                full = a + GROUP
            groups[-1].append((c, slice(a, b)))
    return np.argsort(cls, kind="stable"), groups


def _hidden(net: Network, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, hidden values and scores of the classes; a column a token in the last two."""
    x = net.embed.take(context, axis=0).reshape(len(context), -1)
    h = net.w1.T @ x.T
    h += net.b1[:, None]
    np.tanh(h, out=h)
    by_class = net.wc.T @ h
    by_class += net.bc[:, None]
    return x, h, by_class


def _in_class(net: Network, h: np.ndarray, group: list[tuple[int, slice]]) -> np.ndarray:
    """Scores of the words of its class for each token of a group of classes."""
    first = group[0][1].start
    out = np.empty((net.per_class, group[-1][1].stop - first), h.dtype)
    for c, at in group:
        np.add(net.wo[c].T @ h[:, at], net.bo[c][:, None], out=out[:, at.start - first : at.stop - first])
    return out


def log_probabilities(net: Network, context: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Log-probability of each token given the words on both sides."""
    order, groups = _by_class(tokens // net.per_class, net.classes)
    cls, word = np.divmod(tokens[order], net.per_class)
    _, h, by_class = _hidden(net, context[order])
    logs = _log_softmax_at(by_class, cls).astype(float)
    for group in groups:
        at = slice(group[0][1].start, group[-1][1].stop)
        logs[at] += _log_softmax_at(_in_class(net, h, group), word[at])
    out = np.empty(len(tokens))
    out[order] = logs
    return out


def gradient(net: Network, context: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Mean gradient of the negative log-probability, as a vector."""
    n = len(tokens)
    grad = Network(np.zeros(len(net.flat), np.float32), net.classes, net.per_class)
    order, groups = _by_class(tokens // net.per_class, net.classes)
    context = context[order]
    cls, word = np.divmod(tokens[order], net.per_class)
    x, h, dc = _hidden(net, context)
    _softmax(dc)[cls, np.arange(n)] -= 1
    with_bias = np.ones((HIDDEN + 1, n), h.dtype)  # the last row gives the biases' gradients in the same product
    with_bias[:-1] = h
    both = with_bias @ dc.T
    grad.wc[:], grad.bc[:] = both[:-1], both[-1]
    dh = net.wc @ dc
    for group in groups:
        first, last = group[0][1].start, group[-1][1].stop
        dw = _softmax(_in_class(net, h, group))
        dw[word[first:last], np.arange(last - first)] -= 1
        for c, at in group:
            d = dw[:, at.start - first : at.stop - first]
            both = with_bias[:, at] @ d.T
            grad.wo[c], grad.bo[c] = both[:-1], both[-1]
            dh[:, at] += net.wo[c] @ d
    dh *= 1 - h * h
    grad.w1[:], grad.b1[:] = x.T @ dh.T, dh.sum(axis=1)
    dx = dh.T @ net.w1.T
    near, dx = context.ravel(), dx.reshape(-1, WIDTH)
    for k in range(WIDTH):
        grad.embed[:, k] = np.bincount(near, dx[:, k], len(grad.embed))
    grad.flat /= n
    return grad.flat


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all parts, and the sums of their counts."""
    h, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return h, np.bincount(back, np.concatenate([n for _, n in parts]), len(h)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word hash occurs in this task, handed on whenever many are held."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    size = loose = 0

    def out():
        h, n = _merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in batches:
        texts = text_column(batch, "text")
        for lo, hi in row_chunks(texts):
            h, n = np.unique(word_hashes(*byte_buffer(texts.slice(lo, hi - lo)))[0], return_counts=True)
            parts.append((h, n))
            loose += len(h)
            # Only when as many have come as are held, so that each is sorted few times.
            if loose > max(size, 200_000):
                parts = [_merged(parts)]
                size, loose = len(parts[0][0]), 0
            if size > 2_000_000:
                yield out()
                parts, size = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    yield out()


def _bucket(hashes: np.ndarray, per_class: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(per_class)).astype(np.int64)


def _place(words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash stands among the sorted ``words``, and whether it does."""
    if not len(words):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return at, words[at] == h


def _bucket_counts(words: np.ndarray, per_class: int):
    """words: sorted hashes of the known words. How often the other words of each bucket occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(per_class, np.int64)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            rare = ~_place(words, h)[1]
            np.add.at(total, _bucket(h[rare], per_class), batch.column(1).to_numpy()[rare])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(per_class)), pa.array(total)], names=["bucket", "n"])

    return run


def _tokenise(words: np.ndarray, place: np.ndarray, per_class: int, known: int):
    """words: sorted hashes of the known words, place: their token.

    The first row of each block of texts has the hashes of all other words of the block, ``rare``, and where
    those of each row begin, ``cuts``. Blocks that follow each other share a chunk of about CHUNK_TEXT bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        chunk, size = row, 0
        for batch in batches:
            texts = text_column(batch, "text")
            for lo, hi in row_chunks(texts):
                buf, ends = byte_buffer(texts.slice(lo, hi - lo))
                if size + len(buf) > CHUNK_TEXT:
                    chunk, size = row, 0
                size += len(buf)
                h, doc = word_hashes(buf, ends)
                token = known + _bucket(h, per_class)
                at, hit = _place(words, h)
                if len(words):
                    token[hit] = place[at[hit]]
                each = np.arange(hi - lo + 1)
                cut, rare_cut = np.searchsorted(doc, each), np.searchsorted(doc[~hit], each)
                short, rest = token.astype("<u4"), [None] * (hi - lo - 1)
                rare = h[~hit].astype("<u8").tobytes() or None
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + hi - lo)),
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([short[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                        pa.array([rare, *rest], pa.binary()),
                        pa.array([rare_cut.astype("<i8").tobytes() if rare else None, *rest], pa.binary()),
                        pa.array(np.full(hi - lo, chunk)),
                    ],
                    names=["row", "doc_id", "tokens", "rare", "cuts", "chunk"],
                )
                row += hi - lo

    return run


def _chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each rare word of a chunk once."""

    def blocks():
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield chunk, np.unique(np.frombuffer(packed.as_buffer(), "<u8"))

    for chunk, some in groupby(blocks(), key=lambda block: block[0]):
        words = np.unique(np.concatenate([w for _, w in some])).view(np.int64)
        for at in range(0, len(words), 100_000):
            part = words[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part)], names=["chunk", "word"])


def _chunk_logs(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """Sum of the log counts of the rare words of each row; a word that is not in ``counts`` occurs once."""
    known = counts["word"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    known, known_logs = known[order], np.log(counts["n"].to_numpy()[order])
    rows, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
    for row, packed, ends in zip(blocks["row"].to_pylist(), blocks["rare"], blocks["cuts"]):
        words, cuts = np.frombuffer(packed.as_buffer(), "<u8"), np.frombuffer(ends.as_buffer(), "<i8")
        at, hit = _place(known, words)
        logs = np.zeros(len(words) + 1)
        logs[:-1][hit] = known_logs[at[hit]]
        sums.append(np.add.reduceat(logs, cuts[:-1]) * (np.diff(cuts) > 0))
        rows.append(row + np.arange(len(cuts) - 1))
    return pa.table({"row": np.concatenate(rows), "logs": np.concatenate(sums)})


def _token_chunks(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, their tokens on end and where each row begins."""
    column = batch.column(batch.schema.get_field_index("tokens"))
    sizes = np.array([len(v.as_buffer()) for v in column]) // 4
    lo = 0
    while lo < len(sizes):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), limit, "right")))
        raw = b"".join(v.as_py() for v in column.slice(lo, hi - lo))
        yield lo, hi, np.frombuffer(raw, "<u4").astype(np.int64), np.r_[0, np.cumsum(sizes[lo:hi])]
        lo = hi


def _train(flat: np.ndarray, side: int, rate: float, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, squares, seen = Network(flat.copy(), side, side), np.full(len(flat), 1e-6, np.float32), 0
        for batch in batches:
            for _, _, tokens, offsets in _token_chunks(batch, 200_000):
                context = contexts(tokens, offsets, side * side)
                order = np.random.default_rng(len(tokens)).permutation(len(tokens))
                for at in range(0, len(tokens), step):
                    rows = order[at : at + step]
                    g = gradient(net, context[rows], tokens[rows])
                    size = g * g
                    squares += size
                    g *= rate
                    g /= np.sqrt(squares, out=size)
                    net.flat -= g
                seen += len(tokens)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(flat), dtype=np.int32)),
                    pa.array(net.flat.astype(float) * seen),
                    pa.array(np.full(len(flat), float(seen))),
                ],
                names=["at", "total", "weight"],
            )

    return run


def _score(flat: np.ndarray, side: int, log_sizes: np.ndarray):
    """log_sizes: for each token the log count that its words share, 0 for known words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(flat, side, side)
        for batch in batches:
            for lo, hi, tokens, offsets in _token_chunks(batch, 100_000):
                total = np.zeros(len(tokens) + 1)
                for at in range(0, len(tokens), BLOCK):
                    a, b = max(0, at - SIDE), min(len(tokens), at + BLOCK + SIDE)
                    near = contexts(tokens[a:b], np.clip(offsets, a, b) - a, side * side)
                    mine = slice(at - a, min(at + BLOCK, len(tokens)) - a)
                    logs = log_probabilities(net, near[mine], tokens[a:b][mine])
                    total[at + 1 : at + 1 + len(logs)] = logs
                n = np.diff(offsets)
                sums, shared = (
                    np.add.reduceat(np.r_[v, 0.0], offsets[:-1]) * (n > 0) for v in (total[1:], log_sizes[tokens])
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(lo, hi - lo) for k in (0, 1)),
                        pa.array(n.astype(np.int64)),
                        pa.array(sums),
                        pa.array(shared),
                    ],
                    names=["row", "doc_id", "n_tokens", "symbols", "shared"],
                )

    return run


def _scored(docs: DataFrame, rounds: int, rate: float, step: int) -> DataFrame:
    """doc_id, n_tokens, symbols (log-probability of the vocabulary's symbols) and share (log share of the rare
    words in their buckets) of every row."""
    texts = plain(docs, doc_id="doc_id:long", text="text:string")
    parts = texts.mapInArrow(_count, "word long, n long")
    counts = stored(parts.groupBy("word").agg(F.sum("n").alias("n")), "counts")
    sizes = counts.agg(F.count("*").alias("distinct")).first()
    side = classes_for(sizes.distinct)
    known = side * side - side
    top = counts.orderBy(F.desc("n"), "word").limit(known).toPandas()
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    words = words[order]
    buckets = counts.mapInArrow(_bucket_counts(words, side), "bucket long, n long").groupBy("bucket")
    buckets = buckets.agg(F.sum("n").alias("n")).toPandas()
    word_counts = np.zeros(side * side)
    word_counts[: len(top)] = top["n"]
    word_counts[known + buckets["bucket"].to_numpy(np.int64)] = buckets["n"]
    log_sizes = np.zeros(side * side)
    log_sizes[known:] = np.log(np.maximum(word_counts[known:], 1))

    tokens = stored(
        texts.mapInArrow(_tokenise(words, order, side, known), "row long, doc_id long, tokens binary, rare binary, cuts binary, chunk long"),
        "tokens",
    )
    flat = initial(word_counts.reshape(side, side).sum(axis=1), word_counts).flat
    dealt = tokens.withColumn("round", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(rounds)))
    for r in range(rounds):
        trained = dealt.where(F.col("round") == r).select("tokens").mapInArrow(
            _train(flat, side, rate, step), "at int, total double, weight double"
        )
        mean = trained.groupBy("at").agg((F.sum("total") / F.sum("weight")).alias("v")).toPandas()
        if len(mean):
            flat = mean.sort_values("at")["v"].to_numpy(np.float32)
    scored = tokens.select("row", "doc_id", "tokens").mapInArrow(
        _score(flat, side, log_sizes), "row long, doc_id long, n_tokens long, symbols double, shared double"
    )
    chunks = tokens.where("rare is not null").select("chunk", "row", "rare", "cuts")
    asked = chunks.select("chunk", "rare").mapInArrow(_chunk_words, "chunk long, word long")
    often = asked.join(counts.where("n > 1"), "word").groupBy("chunk")
    logs = chunks.groupBy("chunk").cogroup(often).applyInArrow(_chunk_logs, "row long, logs double")
    share = F.coalesce("logs", F.lit(0.0)) - F.col("shared")
    return scored.join(logs, "row", "left").select("doc_id", "n_tokens", "symbols", share.alias("share"))


def _per_token(scored: DataFrame, value: Column) -> DataFrame:
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", value.alias("log_likelihood")).withColumn("per_token", mean)


def word_likelihood(docs: DataFrame, rounds: int = 3, rate: float = 0.05, step: int = 4096) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over tokens) and per_token (mean; null without tokens) of every row.

    As ``pseudo_likelihood``, but a word outside the vocabulary has the probability of its bucket times its share
    of all words counted there, so every distinct word has a probability of its own.
    """
    return _per_token(_scored(docs, rounds, rate, step), F.col("symbols") + F.col("share"))


def pseudo_likelihood(docs: DataFrame, rounds: int = 3, rate: float = 0.05, step: int = 4096) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over tokens) and per_token (mean; null without tokens) of every row.

    Scores the symbols of the vocabulary: all words of a bucket count as one. ``word_likelihood`` tells them apart.

    Words are runs of bytes other than ASCII white space. Word counts and training cover all documents;
    ``rounds`` only deals them out by a hash of id and text. What reaches the driver grows with the root of the
    number of distinct words: the most frequent words and the parameter vector of each round. Parameters follow
    the way rows lie in partitions, so scores differ slightly when the same rows are partitioned otherwise.

    Null and empty texts have no tokens and a sum of 0. Repeated rows count and are scored each; other
    columns are not read; an empty table gives no rows.
    """
    return _per_token(_scored(docs, rounds, rate, step), F.col("symbols"))
