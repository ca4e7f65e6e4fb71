"""Spans are told apart by counting their hashes; only those of repeated hashes travel with their places."""

from tierlens.llm import substring_dedup
from tierlens.llm.tables import Scratch


def test_spans_are_counted_by_hash_alone(spark, monkeypatch):
    plans, keep = [], Scratch.keep

    def recorded(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df)

    monkeypatch.setattr(Scratch, "keep", recorded)
    passage = " ".join(f"w{i}" for i in range(60))
    own = [" ".join(f"x{d}y{i}" for i in range(40)) for d in range(30)]
    docs = spark.createDataFrame([(d, f"{own[d]}. {passage}. {passage}.") for d in range(30)], "doc_id long, text string")
    got = {r.doc_id: (r.clean_text, r.n_removed) for r in substring_dedup.drop_repeated_spans(docs).collect()}
    assert "SortAggregate" not in plans[1] and "ObjectHashAggregate" not in plans[1]
    assert got[0][0].count("w30") == 1 and all("w30" not in got[d][0] for d in range(1, 30))
    assert all(text.startswith(own[d][:100]) and n for d, (text, n) in got.items())
