"""Memory of the suffix dedup: what is held at once does not follow the batches that Spark sends."""

import numpy as np
import pyarrow as pa

from sievework.llm import suffix_dedup


def _batch(ids, texts):
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(np.zeros(len(ids), np.int64)), pa.array(texts, pa.string())],
        names=["doc_id", "tie", "text"],
    )


def test_large_batches_are_cut(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 1000)
    texts = ["a" * (k % 90) for k in range(500)]
    texts[7], texts[9] = None, "b" * 3000
    batches = [_batch(range(300), texts[:300]), _batch(range(300, 310), texts[300:310]), _batch(range(310, 500), texts[310:])]
    parts = list(suffix_dedup._gathered(iter(batches)))
    assert [i for ids, _, _ in parts for i in ids] == list(range(500))
    assert [t for _, _, found in parts for t in found.to_pylist()] == [t or "" for t in texts]
    sizes = [(len(ids), sum(len(t) for t in found.to_pylist())) for ids, _, found in parts]
    assert all(n == 1 or size <= 1000 for n, size in sizes)
    assert len(parts) < 40  # small batches are joined


def test_a_chunk_without_covered_runs(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 200)
    texts = ["".join(chr(97 + (k * k * (d + 3) + k // 7) % 26) for k in range(150)) for d in range(2)]
    items = [[np.array([item], "<u4").tobytes()] for item in (suffix_dedup.OPEN, 0)]
    batch = pa.RecordBatch.from_arrays(
        [*_batch([1, 2], texts).columns, pa.array(items, pa.list_(pa.binary()))], names=["doc_id", "tie", "text", "items"]
    )
    rows = pa.Table.from_batches(suffix_dedup._piece_rows(4)(iter([batch]))).to_pylist()
    assert [(r["known"], r["ids"][:1]) for r in rows] == [(False, b"\x01"), (True, b"\x02")]
