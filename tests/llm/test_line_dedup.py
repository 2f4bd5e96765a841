"""Line dedup against a plain version that counts every key."""

from hashlib import sha256

import numpy as np
import pytest

from sievework.llm import line_dedup
from sievework.llm.line_dedup import BloomFilter, dropped_line_digests, drop_lines

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
LONG = "A line that is long enough"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_docs=3):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20 and doc is not None:
                holders.setdefault(key(line), set()).add(doc)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [p for p in parts if key(p) not in keeper or keeper[key(p)] == doc]
        out.append((doc, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


def rows():
    rng = np.random.default_rng(3)
    pool = [f"{LONG} {k}" for k in range(12)] + ["short", "", " \t ", "é" * 20, "É" * 20, "x" * 19]
    out = []
    for doc in range(40):
        picked = rng.choice(pool, rng.integers(1, 9)).tolist()
        out.append((doc, "\n".join(("  " if rng.random() < 0.3 else "") + p.upper() * (rng.random() < 0.2) or p for p in picked)))
    out += [(None, f"{LONG} 1\nown"), (None, f"{LONG} 1\nown"), (None, None), (41, ""), (42, "\n\n"), (5, f"{LONG} 2\r\n z")]
    out += [(50 + k, f"{LONG} of two\n" if k < 2 else "only a null id shares this line") for k in range(4)]
    out += [(None, "only a null id shares this line"), (60, "y" * 200_000), (61, "y" * 200_000), (62, "Y" * 200_000 + "\n")]
    return out


@pytest.mark.parametrize("held", [1 << 20, 5])
def test_equals_plain_version(spark, monkeypatch, held):
    monkeypatch.setattr(line_dedup, "HELD_ENTRIES", held)
    data = rows()
    docs = spark.createDataFrame([(d, t, "n", True) for d, t in data], "doc_id long, text string, name string, known boolean")
    got = sorted(map(repr, map(tuple, drop_lines(docs.repartition(5)).collect())))
    assert got == sorted(map(repr, brute(data)))
    assert sum(r[2] for r in brute(data)) > 20
    digests = [(d, n, m, sha256(t.encode()).hexdigest()) for d, n, m, t in brute(data)]
    assert sorted(map(repr, map(tuple, dropped_line_digests(docs).collect()))) == sorted(map(repr, digests))


def test_odd_rows_and_empty_table(spark, odd):
    data = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = sorted(map(repr, map(tuple, drop_lines(odd, min_docs=2).collect())))
    assert got == sorted(map(repr, brute(data, 2)))
    assert drop_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bloom_filter_never_forgets():
    codes = np.random.default_rng(1).integers(0, 1 << 32, 20_000, np.uint64).astype(np.uint32)
    known = BloomFilter(10_000)
    known.add(codes[:10_000])
    assert known.has(codes[:10_000]).all() and known.has(codes[10_000:]).mean() < 0.02
