"""Operators on awkward tables and against brute force."""

import hashlib
import re
import zlib
from collections import Counter as Tally

import numpy as np
import pytest
from cases import LONG, all_null, awkward, groups, nothing
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlens.llm import decontamination, embedding_dedup, language_id, license_scan, line_dedup, mixing, sharding, simhash_dedup, substring_dedup, token_counts
from tierlens.llm.grouping import components, tile_units
from tierlens.llm.queries import QUERIES
from tierlens.llm.shingles import shingle_hashes, simhash
from tierlens.llm.tables import Scratch


def bench(spark, rows=((1, "the lazy dog near the river bank today and more words here"), (2, None), (3, "é"), (3, "é"), (None, "!!"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500, x) for x in range(501, 700)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    want = groups(700, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_tile_units_bring_every_pair_of_a_bucket_together(spark):
    rows = [(1, i) for i in range(100)] + [(2, 200), (2, 201), (3, 300)]
    units = tile_units(spark.createDataFrame(rows, "bucket long, h long"), Scratch(spark, "t"), "h", 16).collect()
    by_unit = {}
    for r in units:
        by_unit.setdefault(r.unit, set()).add(r.h)
    met = {(a, b) for v in by_unit.values() for a in v for b in v if a < b}
    assert met == {(a, b) for a in range(100) for b in range(a + 1, 100)} | {(200, 201)}
    assert max(map(len, by_unit.values())) <= 60


# ---- 1 -----------------------------------------------------------------------

def test_mix_rows_by_hand(spark):
    docs = awkward(spark)
    out = mixing.mix_rows(docs, quality=mixing.text_quality())
    assert out.columns == docs.columns
    copies = Tally(r.doc_id for r in out.collect())
    assert copies == Tally(r.doc_id for r in mixing.mix_rows(docs.repartition(5), quality=mixing.text_quality()).collect())
    assert all(n <= 4 for n in copies.values())  # doc 1 stands in the table twice
    assert mixing.mix_rows(nothing(spark)).count() == 0
    assert mixing.mix_rows(all_null(spark)).count() == 0


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 0)], "source string, source_size long")
    keyed = sizes.select(F.coalesce("source", F.lit("")).alias("src_key"), F.col("source").isNull().alias("src_null"), "source_size")
    got = {r.src_key: r.target for r in mixing.source_targets(keyed).collect()}
    # 1665 words: a and c stop at twice their size, b takes the rest
    assert got == pytest.approx({"a": 20.0, "b": 1445.0, "c": 200.0, "": 0.0})


def test_mix_prefers_quality(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"), (F.col("id") % 2 == 0).alias("good"))
    got = mixing.mix_sizes(rows, quality=F.when(F.col("good"), 9.0).otherwise(1.0), share=0.25).groupBy((F.col("id") % 2 == 0).alias("good")).agg(F.sum("copies").alias("n")).collect()
    n = {r.good: r.n for r in got}
    assert n[True] + n[False] == 1000 and n[True] > 6 * n[False]


# ---- 2 -----------------------------------------------------------------------

def test_language_id(spark, documents):
    given = spark.createDataFrame(documents)
    found = language_id.identify(given).toPandas().merge(documents, left_on="id", right_on="doc_id")
    held = found[found.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.id]).all() and len(held) > 20
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_language_counts_by_hand():
    text = "aé" * 200_000 + "!" + "Z"  # longer than one block
    got = Tally()
    for _, feature, n in language_id.sparse_counts([text, None, ""]):
        for f, k in zip(feature, n):
            got[int(f)] += int(k)
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    grams = sum(any(c != " " for c in low[i:i + n]) for n in language_id.ORDERS for i in range(len(low) - n + 1))
    assert sum(got.values()) == grams


def test_language_edges(spark):
    got = {(r.id, r.lang_pred == "und") for r in language_id.identify(awkward(spark)).collect()}
    assert {(2, True), (3, True), (4, True), (5, True), (6, False), (9, False)} <= got
    assert language_id.identify(nothing(spark)).count() == 0
    assert {r.lang_pred for r in language_id.identify(all_null(spark)).collect()} == {"und"}
    kept = language_id.keep_identified(awkward(spark))
    assert kept.columns == awkward(spark).columns and {r.doc_id for r in kept.collect()} >= {1, 6, 7, 8}
    assert not {2, 3, 4, 5} & {r.doc_id for r in kept.collect()}
    assert language_id.keep_identified(nothing(spark)).count() == 0


# ---- 3 -----------------------------------------------------------------------

def test_line_dedup_against_brute_force(spark, documents):
    """Edit similarity alone says which lines belong together."""
    got = {r.id: r.removed for r in line_dedup.repeated_lines(spark.createDataFrame(documents)).collect() if r.removed}
    places = [(i, n, line_dedup.normal_line(x)) for i, t in zip(documents.doc_id, documents.text) for n, x in enumerate(t.split("\n"))]
    places = [p for p in places if p[2]]
    lines = sorted({p[2] for p in places}, key=lambda x: (len(x), x))
    letters = sorted(set("".join(lines)))
    number = {c: k for k, c in enumerate(letters)}
    counts, size = np.zeros((len(lines), len(letters)), np.int16), np.array(list(map(len, lines)))
    for n, x in enumerate(lines):
        np.add.at(counts[n], [number[c] for c in x], 1)
    links = []
    for i in range(len(lines)):
        # an edit changes at most one letter to another: what no order of letters can mend is left out
        j = np.arange(i + 1, np.searchsorted(size, size[i] / 0.85, side="right") if size[i] else i + 1)
        apart = np.abs(counts[j] - counts[i]).sum(axis=1)
        j = j[(apart + (size[j] - size[i])) / 2 <= 0.15 * size[j] + 1e-9]
        links += [(i, k) for k in j if line_dedup.edit_distance(lines[i], lines[k]) <= 0.15 * len(lines[k])]
    root, seen, want = dict(zip(lines, groups(len(lines), links))), set(), {}
    for i, n, x in places:
        if root[x] in seen:
            want.setdefault(i, []).append(n)
        seen.add(root[x])
    assert got == want and len(want) > 10 and len(links) > 20


def test_line_dedup_edges(spark):
    docs = spark.createDataFrame(
        [(1, "One line of words here.\n\nSecond line stays."), (2, "one LINE of words, here\nother"), (3, None), (4, ""), (5, "a\na"), (5, "a\na"), (None, "x"), (6, "\n \n")],
        "doc_id long, text string")
    found = line_dedup.repeated_lines(docs)
    assert {(r.id, r.n_lines, tuple(r.removed)) for r in found.collect()} == {(1, 2, ()), (2, 2, (0,)), (5, 2, (1,)), (None, 1, ())}
    clean = [(r.doc_id, r.text) for r in line_dedup.without_lines(docs, found).collect()]
    assert sorted(clean, key=str) == sorted([
        (1, "One line of words here.\n\nSecond line stays."), (2, "other"), (3, None), (4, ""), (5, "a"), (5, "a"), (None, "x"), (6, "\n \n")], key=str)
    assert line_dedup.repeated_lines(nothing(spark)).count() == line_dedup.repeated_lines(all_null(spark)).count() == 0
    wide = line_dedup.without_lines(awkward(spark), line_dedup.repeated_lines(awkward(spark)))
    assert wide.columns == awkward(spark).columns and wide.count() == awkward(spark).count()


# ---- 4 -----------------------------------------------------------------------

def test_substring_dedup_against_brute_force(spark, documents):
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.clean_text) for r in substring_dedup.drop_repeated_spans(spark.createDataFrame(documents)).collect()}
    seen, covered = set(), {}
    for i, t in zip(documents.doc_id, documents.text):
        for h, a, b in sorted(substring_dedup.spans_of(t), key=lambda s: s[1:]):
            if h in seen:
                covered.setdefault(i, set()).update(range(a, b + 1))
            seen.add(h)
    for i, t in zip(documents.doc_id, documents.text):
        parts = substring_dedup.sentences_of(t)
        gone = covered.get(i, set())
        assert got[i] == (len(parts), len(gone), "".join(t[s:e] for k, (s, e, _) in enumerate(parts) if k not in gone))
    assert covered


def test_substring_edges(spark):
    docs = awkward(spark)
    out = substring_dedup.drop_repeated_spans(docs, keep=docs.columns)
    rows = {r.doc_id: r for r in out.collect() if r.doc_id != 1}
    assert out.count() == docs.count() and rows[2].clean_text is None and rows[3].clean_text == ""
    assert rows[6].n_removed < rows[6].n_sentences and rows[7].clean_text.strip() in ("", "tail") or rows[7].n_removed > 0
    assert substring_dedup.drop_repeated_spans(nothing(spark)).count() == 0
    assert [r.n_removed for r in substring_dedup.drop_repeated_spans(all_null(spark)).collect()] == [0, 0, 0]


# ---- 5 -----------------------------------------------------------------------

def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT"]
    changed = mit.replace("merge, publish, ", "").replace("Software", "Program")
    docs = spark.createDataFrame(
        [(1, "Intro. Released under the MIT License. Tail"), (2, f"x\n{changed}\ny"), (3, "No licence at all"), (4, None), (5, ""),
         (6, LONG + " licensed under CC BY-NC 4.0 " + LONG), (1, "Intro. Released under the MIT License. Tail")], "doc_id long, text string")
    got = sorted((r.id, r.license, round(r.coverage, 2), r.first_word) for r in license_scan.scan_licenses(docs).collect())
    assert [g[:2] for g in got] == [(1, "MIT-notice"), (1, "MIT-notice"), (2, "MIT"), (6, "CC-BY-NC-4.0-notice")]
    assert got[0][2] == 1.0 and got[0][3] == 1 and 0.85 < got[2][2] < 1.0
    assert license_scan.scan_licenses(nothing(spark)).count() == 0 and license_scan.scan_licenses(awkward(spark)).count() == 0


# ---- 6 -----------------------------------------------------------------------

def test_simhash_components_against_brute_force(spark, documents):
    docs = spark.createDataFrame(documents)
    prints = [int(simhash(shingle_hashes(t.encode(), 3))[0]) for t in documents.text]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = groups(len(prints), links)
    got = simhash_dedup.simhash_components(docs, tile_rows=4).toPandas().sort_values("id")
    assert got.component.tolist() == documents.doc_id.to_numpy()[want].tolist()
    assert [x % (1 << 64) for x in got.fp] == prints


def test_simhash_edges(spark):
    got = [(r.id, r.fp, r.component) for r in simhash_dedup.simhash_components(awkward(spark)).collect()]
    assert len(got) == awkward(spark).count()
    assert {c for i, f, c in got if i in (2, 3, 4)} == {2} and {f for i, f, c in got if i in (2, 3, 4)} == {0}
    assert {c for i, _, c in got if i in (8, None)} == {8}
    assert simhash_dedup.simhash_components(nothing(spark)).count() == 0
    assert {r.component for r in simhash_dedup.simhash_components(all_null(spark)).collect()} == {None}


def test_near_duplicates_against_brute_force(spark, documents):
    kept = {r.doc_id for r in simhash_dedup.drop_near_duplicates(spark.createDataFrame(documents), tile_rows=4).collect()}
    sets = [set(shingle_hashes(t.encode(), 5).tolist()) for t in documents.text]
    links = [(i, j) for i in range(len(sets)) for j in range(i)
             if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = {int(documents.doc_id[g]) for g in groups(len(sets), links)}
    assert kept == want and len(kept) < len(documents)


def test_near_duplicates_catch_edits_and_leave_others(spark):
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(5000)])
    base = [" ".join(rng.choice(words, 200)) for _ in range(30)]
    rows = list(enumerate(base))
    for i, t in enumerate(base[:20]):  # three changed words of 200: about 0.86 of the shingles stay
        w = t.split()
        for at in (20, 90, 160):
            w[at] = "changed"
        rows += [(1000 + i, " ".join(w)), (2000 + i, t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash_dedup.drop_near_duplicates(docs).collect()} == set(range(30))


def test_near_duplicate_edges(spark):
    out = simhash_dedup.drop_near_duplicates(awkward(spark))
    assert out.columns == awkward(spark).columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(1) == 1 and 6 in ids and 7 not in ids and len({None, 8} & set(ids)) == 1
    assert simhash_dedup.drop_near_duplicates(nothing(spark)).count() == 0
    assert simhash_dedup.drop_near_duplicates(all_null(spark)).count() == 1


# ---- 7 -----------------------------------------------------------------------

@pytest.mark.parametrize("words_per_block", [200_000, 60])
def test_decontamination_against_brute_force(spark, documents, sf_dir, words_per_block):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.scan_documents(
        spark.createDataFrame(documents[:60]), items, words_per_block=words_per_block).collect()}
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for r in items.collect():
        w = cut.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        for i in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[i:i + 10]), set()).add(str(r.item_id))
    sizes = {len(p) for p in windows}
    for i, t in zip(documents.doc_id[:60], documents.text[:60]):
        w = cut.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        assert got[i] == (len(w), len(hit), sorted(found))


def test_decontamination_edges(spark):
    docs = awkward(spark)
    got = {r.id: (r.n_hit, r["items"]) for r in decontamination.scan_documents(docs, bench(spark)).collect()}
    assert got[2] == got[3] == got[4] == (0, []) and got[9] == (1, ["3"]) and got[1] == (0, [])
    kept = decontamination.drop_contaminated(docs, bench(spark))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert decontamination.drop_contaminated(docs, bench(spark, ((1, None),))).count() == docs.count()
    assert decontamination.scan_documents(nothing(spark), bench(spark)).count() == 0
    assert decontamination.scan_documents(all_null(spark), spark.createDataFrame([], "item_id long, text string")).count() == 3


def test_long_items_keep_every_window(spark):
    item = [f"w{i}" for i in range(2500)]
    docs = [(i, " ".join(item[s:s + 10])) for i, s in enumerate(range(0, 2491, 83))] + [(900, " ".join(item[5:14]))]
    got = decontamination.scan_documents(spark.createDataFrame(docs, "doc_id long, text string"), bench(spark, ((7, " ".join(item)),)), words_per_block=700)
    assert {r.id: r.n_hit for r in got.collect()} == {i: 10 for i, _ in docs[:-1]} | {900: 0}


# ---- 8 -----------------------------------------------------------------------

def test_embedding_links_and_recall(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(600, 64))
    near = []
    for angle in np.linspace(0.0, 0.5, 12):  # cosines from 1 down to 0.88
        for _ in range(40):
            v = base[rng.integers(0, 600)]
            v = v / np.linalg.norm(v)
            w = rng.normal(size=64)
            w -= (w @ v) * v
            near.append(np.cos(angle) * v + np.sin(angle) * w / np.linalg.norm(w))
    x = np.concatenate([base, near, np.repeat(base[:1], 300, 0) + rng.normal(size=(300, 64)) * 0.05]).astype(np.float32)
    labels = rng.integers(0, 2, len(x))
    rows = [(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, labels))]
    schema = "vec_id long, embedding array<float>, label int"
    got = embedding_dedup.embedding_links(spark.createDataFrame(rows, schema), tile_rows=64).toPandas().sort_values("id")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    assert (got.n_links.to_numpy() <= want).all()
    assert got.n_links.sum() >= 0.98 * want.sum() and want.sum() > 10_000
    roots = groups(len(x), [(int(i), int(j)) for i, j in np.argwhere(linked) if i > j])
    assert (got.component.to_numpy() == roots).mean() > 0.98
    assert (got.kept == (got.id == got.component)).all()


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, node string, cap string"
    e1 = [1.0] + [0.0] * 7
    rows = [(1, e1, 0), (2, e1, 0), (3, e1, 1), (4, e1, None), (5, None, 0), (6, [0.0] * 8, 0), (7, [float("nan")] + [0.0] * 7, 0),
            (8, [None] + [1.0] * 7, 0), (9, [2e30] + [0.0] * 7, 0), (None, e1, 0), (10, [1e-30] + [0.0] * 7, 1)]
    got = {r.id: (r.n_links, r.component, r.kept) for r in embedding_dedup.embedding_links(spark.createDataFrame([(*r, "x", "y") for r in rows], schema)).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 9: (3, 1, False), 3: (1, 3, True), 10: (1, 3, False), 4: (0, 4, True), 5: (0, 5, True),
                   6: (0, 6, True), 7: (0, 7, True), 8: (0, 8, True), None: (3, 1, False)}
    # copies, repeated ids and rows without an id count like any other row
    copies = [(1, e1, 0), (1, e1, 0), (2, e1, 0), (None, e1, 0), (None, [0.0] + e1[:-1], 0), (None, [0.0] + e1[:-1], 0), (7, [0.0, 0.0] + e1[:-2], 0)]
    found = [(r.id, r.n_links, r.component, r.kept) for r in embedding_dedup.embedding_links(spark.createDataFrame([(*r, "x", "y") for r in copies], schema)).collect()]
    assert sorted(found, key=str) == sorted([(1, 3, 1, True)] * 2 + [(2, 3, 1, False), (None, 3, 1, False)] + [(None, 1, None, False)] * 2 + [(7, 0, 7, True)], key=str)
    assert embedding_dedup.embedding_links(spark.createDataFrame([], schema)).count() == 0
    assert embedding_dedup.embedding_links(spark.createDataFrame([(None, None, None, None, None)] * 2, schema)).count() == 2


# ---- 9 -----------------------------------------------------------------------

def test_sharding(spark):
    n = {"a": 997, "b": 211, None: 40, "c": 3}
    rows = [(f"{s}{i}", s, "x", 1) for s, k in n.items() for i in range(k)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string, slot int").drop("slot")
    out = sharding.shard_rows(docs, 7).toPandas()
    assert len(out) == len(rows) and out.doc_id.is_unique
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 7
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    for s in ("a", "b"):
        share = out[out.source == s].groupby("shard").size()
        assert share.max() - share.min() <= 2
    again = sharding.shard_rows(docs.repartition(3), 7).toPandas()
    assert out.sort_values("doc_id").equals(again.sort_values("doc_id")) or (
        out.sort_values("doc_id").reset_index(drop=True).fillna("") == again.sort_values("doc_id").reset_index(drop=True).fillna("")).all().all()


def test_sharding_edges(spark):
    docs = awkward(spark).drop("shard")
    out = sharding.shard_rows(docs, 40)
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() == docs.count()
    assert {r.slot for r in out.collect()} == {0}
    assert sharding.shard_rows(nothing(spark).drop("shard"), 40).count() == 0
    assert sorted((r.shard, r.slot) for r in sharding.shard_rows(all_null(spark).drop("shard"), 2).collect()) == [(0, 0), (0, 1), (1, 0)]


# ---- 10 ----------------------------------------------------------------------

def test_token_count_edges(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = [(r.id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(awkward(spark), path).collect()]
    want = []
    for r in awkward(spark).collect():
        k = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), k, k > 512))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.token_counts(nothing(spark), path).count() == 0


# ---- queries -----------------------------------------------------------------

def test_items_digest_column(spark, sf_dir):
    rows = QUERIES["op7_decontamination"](spark, sf_dir).where("n_items = 0").limit(1).collect()
    assert rows[0].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_scratch_needs_no_setting_only_on_one_machine(spark):
    assert T.LongType() == awkward(spark).schema["doc_id"].dataType
    kept = Scratch(spark, "t").keep(spark.range(3))
    assert kept.count() == 3
