"""Only texts that share a shingle with an item are shuffled by the decontamination."""

from sievework.llm import decontaminate


def test_texts_without_a_hit_are_not_shuffled(spark, monkeypatch):
    plans, stored = {}, decontaminate.stored

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(decontaminate, "stored", watched)
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(i, f"plain text number {i} of many that match nothing at all") for i in range(50)] + [(99, f"so {passage} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    found = decontaminate.contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.start) for r in found] == [(99, 1, 1)]
    join = next(line for line in plans["hit-texts"].splitlines() if "LeftSemi" in line)
    assert "broadcast" in join
