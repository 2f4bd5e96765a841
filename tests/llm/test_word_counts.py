"""Counting words: the words held are not sorted again for every megabyte of text."""

import numpy as np
import pyarrow as pa

from sievework.llm import pseudo_lm


def test_counts_are_merged_few_times(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60_000, 20_000)) for _ in range(80)]
    sorted_rows, unique = [], np.unique

    def counted(x, *args, **options):
        sorted_rows.append(len(x))
        return unique(x, *args, **options)

    monkeypatch.setattr(np, "unique", counted)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    (out,) = pseudo_lm._count(iter([batch]))
    words = sum(len(t.split()) for t in texts)
    assert sum(sorted_rows) < 1.6 * words  # 1.8 times when every chunk is merged with all words before it
    h, n = out.column(0).to_numpy(), out.column(1).to_numpy()
    assert len(h) == len(set(h.tolist())) == len({w for t in texts for w in t.split()})
    assert n.sum() == words
