"""Each operator's query: its contract, and its SQL where there is one; the pipeline stage by stage."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
import __spark_entry__
from tierlens.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_line_dedup": ["doc_id", "n_lines", "n_removed", "removed_lines"],
    "op4_substring_dedup": ["doc_id", "clean_text", "n_sentences", "n_removed"],
    "op5_license_scan": ["doc_id", "license", "coverage", "first_word", "last_word", "start", "end"],
    "op6_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op7_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op8_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op9_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op11_conversation_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op12_code_compression": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op13_topk_search": ["query_id", "rank", "vec_id", "score"],
}


def test_every_operator_is_registered():
    assert set(COLUMNS) == set(QUERIES)
    assert set(COLUMNS) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    assert out.columns == COLUMNS[name]
    got = out.toPandas()
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "labels", "benchmark", "conversations", "embeddings"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
        want = con.execute(ORACLES[name]).df()[COLUMNS[name]]
        got, want = (x.sort_values(COLUMNS[name]).reset_index(drop=True) for x in (got, want))
        for c in COLUMNS[name]:
            if got[c].dtype.kind == "f":
                assert np.allclose(got[c], want[c], rtol=1e-9, equal_nan=True)
            else:
                assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
    if name == "op1_mix_sources":
        assert (got.taken <= 2 * got["size"]).all() and (got.target <= 2 * got.source_size + 1e-6).all()
    if name == "op9_sharding":
        sizes = got.groupby("shard").size()
        assert sizes.max() - sizes.min() <= 1 and sizes.index.tolist() == list(range(40))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns
        kept, given = after.toPandas(), before.toPandas()
        assert set(kept.doc_id) <= set(given.doc_id) and len(kept)
        if name != "mixing":
            assert len(kept) <= len(given)
        if name == "decontamination":
            hit = QUERIES["op7_decontamination"](spark, sf_dir).toPandas().set_index("doc_id").contaminated
            assert set(kept.doc_id) == {i for i in given.doc_id if not hit[i]}
        if name == "language_id":
            assert len(kept) == sum(any(map(str.isalpha, t)) for t in given.text)
        before = spark.createDataFrame(kept, docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() == before.count()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) and sizes.max() - sizes.min() <= 1
