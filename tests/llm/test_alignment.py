"""Token alignment against a brute-force version that compares every token with every other."""

from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sievework.llm.alignment import Aligner, align_tokens

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
TEXTS = [
    None,
    "",
    "a",
    "plain words, twice: plain words",
    "plain words, twice: plain words",
    "<|endoftext|> and <s> are </s> text",
    "▁x ▁",
    "  two  spaces \n\n\t x  ",
    "\x00 null, é and 日本語 😀👩‍👩‍👧, ﬁ ｆ",
    "don't I'LL 've ١٢٣ ²½",
    " " * 6000 + "end",
    "x" * 3000,
]


def spans(ids, size):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(size[i])))
        at += len(size[i])
    return out


def brute(texts):
    a_side, b_side = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_side.encode_special_tokens = True
    known = Aligner(*PATHS)
    rows, counts = [], Counter()
    for text in texts:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if text and (b"".join(known.a.bytes[i] for i in a) != raw or b"".join(known.b.bytes[i] for i in b) != raw):
            a, b = [], []
        at_a, at_b = spans(a, known.a.bytes), spans(b, known.b.bytes)
        links = [(i, j) for i, (s, e) in zip(a, at_a) for j, (u, v) in zip(b, at_b) if s < v and u < e]
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups = [
            ",".join(str(i) for i, (_, e) in zip(a, at_a) if lo < e <= hi)
            + "|"
            + ",".join(str(i) for i, (_, e) in zip(b, at_b) if lo < e <= hi)
            for lo, hi in zip([0, *cuts], cuts)
        ]
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return [
        (n_a, n_b, n_g, len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k),
         sha256(g.encode()).hexdigest() if g else "")
        for n_a, n_b, n_g, k, g in rows
    ]


def test_equals_brute_force(spark):
    rows = [(i, t, "n", 5) for i, t in enumerate(TEXTS)] + [(None, "plain words", "n", 5), (3, TEXTS[3], "n", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair string, block int").repartition(3)
    got = sorted((str(r[0]), *r[1:]) for r in align_tokens(docs, *PATHS).collect())
    want = sorted((str(r[0]), *x) for r, x in zip(rows, brute([r[1] for r in rows])))
    assert got == want


def test_axis_in_parts_changes_nothing(monkeypatch):
    texts = [t or "" for t in TEXTS if t != " " * 6000 + "end"]
    whole = Aligner(*PATHS).align(texts)
    monkeypatch.setattr("sievework.llm.alignment.AXIS_BYTES", 7)
    parts = Aligner(*PATHS).align(texts)
    assert whole["groups"] == parts["groups"] and whole["pairs"].tolist() == parts["pairs"].tolist()


def test_blocks_of_any_size_give_one_result(spark, odd, monkeypatch):
    whole = sorted(map(str, align_tokens(odd, *PATHS).collect()))
    monkeypatch.setattr("sievework.llm.alignment.BLOCK_BYTES", 100)
    assert sorted(map(str, align_tokens(odd.repartition(1), *PATHS).collect())) == whole


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty_table(spark, schema):
    assert align_tokens(spark.createDataFrame([], schema), *PATHS).collect() == []
