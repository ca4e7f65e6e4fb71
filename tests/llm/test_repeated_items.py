"""Blocks of a benchmark stay bounded when it repeats an item."""

from tierlens.llm import decontamination


def test_a_repeated_item_is_one_segment(spark, monkeypatch):
    sizes, scan = [], decontamination._scan

    def watched(name, shared, window):
        sizes.append(sum(len(words.split()) for _, words in shared.value))
        return scan(name, shared, window)

    monkeypatch.setattr(decontamination, "_scan", watched)
    same = "one two three four five six seven eight nine ten"
    items = [(7, same)] * 200 + [(100 + i, f"item{i} " * 12) for i in range(40)]
    docs = spark.createDataFrame([(1, f"zero {same} eleven"), (2, "nothing here")], "doc_id long, text string")
    found = decontamination.scan_documents(docs, spark.createDataFrame(items, "item_id long, text string"), words_per_block=200)
    got = {r.id: (r.n_hit, r["items"]) for r in found.collect()}
    assert got == {1: (10, ["7"]), 2: (0, [])}
    assert max(sizes) <= 600, sizes
