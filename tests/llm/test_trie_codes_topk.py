"""Conversation trie, vector codes and top-k search against brute force, and on awkward tables."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tierlens.llm import code_compression, conversation_trie, topk_search
from tierlens.llm.conversation_trie import RangeMinimum
from tierlens.llm.vectors import numbered_blocks
from tierlens.llm.tables import Scratch

TALK = "conv_id long, turn long, role string, text string, c string, depth string, piece string, n string"
VECTORS = "vec_id long, embedding array<float>, label int, v string, id string, part string, score string, query string, member string"


# ---- 11 ----------------------------------------------------------------------

def rebuilt(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    host = lambda c: c - int(np.fmod(c, 100))
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(host(c), [])[:h[c]] + turns[h[c]:] for c, turns in own.items()}


def brute_trie(rows):
    convs = rebuilt(rows)
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) if below else 1
        saved[p] = sum(saved[k] for k in below) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], TALK)


def trie_rows(df):
    assert df.columns == ["member", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def random_talk(n=260, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(-120, n):
        if rng.random() < 0.15:
            continue
        for t in range(rng.integers(1, 12)):
            rows.append((c, t if rng.random() < 0.9 else None, ["user", "assistant", None][rng.integers(3)], ["", "a", "é€", None, "bb"][rng.integers(5)]))
    long = [("user", f"turn {i % 7}") for i in range(150)]
    for c in (1000, 1001, 1050, 1100, 1199):  # long ones that share long beginnings
        cut = [150, 149, 64, 128, 90][c % 5]
        rows += [(c, t, *x) for t, x in enumerate(long[:cut])] + ([(c, 500, "user", "other")] if c != 1000 else [])
    return rows


@pytest.mark.parametrize("slab, piece_rows", [(64, 1 << 18), (3, 20), (1, 7)])
def test_trie_against_brute_force(spark, slab, piece_rows):
    rows = random_talk()
    got = trie_rows(conversation_trie.prefix_trie(talk(spark, rows).repartition(5), slab=slab, piece_rows=piece_rows))
    assert got == brute_trie(rows)


def test_trie_hot_conversation_and_copies(spark):
    rows = [(1200 + i, t, "user", f"same {t}") for i in range(300) for t in range(8)]  # one content, a third of all turns
    rows += [(7, t, "user", f"long {t}") for t in range(2400)]  # one conversation, a third
    rows += [(9, None, "user", "again")] * 2400  # equal rows of one conversation
    assert trie_rows(conversation_trie.prefix_trie(talk(spark, rows), slab=16, piece_rows=64)) == brute_trie(rows)


def test_trie_edges(spark):
    assert trie_rows(conversation_trie.prefix_trie(talk(spark, []))) == []
    assert trie_rows(conversation_trie.prefix_trie(talk(spark, [(None, None, None, None)] * 3))) == []
    for rows in (
        [(0, None, None, None)], [(0, 1, "user", "a")] * 3, [(c, 0, None, None) for c in range(30)],  # some end up without turns
        [(5, 0, "user", "x" * 3_000_000), (5, 1, None, "y"), (None, 3, "user", "z"), (-5, 0, "user", "x")],
    ):
        assert trie_rows(conversation_trie.prefix_trie(talk(spark, rows))) == brute_trie(rows)


def test_range_minimum():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, 97)
    table = RangeMinimum(x)
    for start in range(97):
        for depth in range(7):
            left = right = start
            while left > 0 and x[left] >= depth:
                left -= 1
            while right + 1 < 97 and x[right + 1] >= depth:
                right += 1
            assert table.left(np.array([start]), np.array([depth]))[0] == left
            assert table.right(np.array([start]), np.array([depth]))[0] == right
    a = rng.integers(0, 97, 200)
    b = np.minimum(96, a + rng.integers(0, 50, 200))
    assert (table.least_at(a, b) == [x[i:j + 1].min() for i, j in zip(a, b)]).all()


# ---- 12 ----------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], VECTORS)


def kept_integers(rows, scale, dims=None):
    kept = [(r[0], r[2], [int(np.floor(scale * float(np.float32(x)))) for x in r[1]]) for r in rows
            if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    dims = dims or max((len(v) for *_, v in kept), default=0)
    return [(i, k, v + [0] * (dims - len(v))) for i, k, v in kept]


def brute_codes(rows, parts=8, rounds=6):
    widest = max((len(r[1]) for r in rows if r[1] is not None), default=0)
    width = max(1, -(-widest // parts))
    kept = kept_integers(rows, 4096, parts * width)
    cut = lambda v: [v[p * width:(p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], np.int32).tobytes()))[:16]
    books = [[cut(v)[p] for *_, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min((far(x, e), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for *_, v in kept:
                groups.setdefault(nearest(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if n in groups else e for n, e in enumerate(books[p])]
    out, per_label = [], {}
    for i, k, v in kept:
        found = [nearest(x, b) for x, b in zip(cut(v), books)]
        error = sum(d for d, _ in found)
        per_label[k] = per_label.get(k, 0) + error
        out.append((i, k, bytes(n for _, n in found), error))
    return sorted([(i, k, c, e, per_label[k]) for i, k, c, e in out], key=str), books


def code_rows(df):
    assert df.columns == ["id", "label", "code", "error", "label_error"]
    return sorted([(r.id, r.label, bytes(r.code), r.error, r.label_error) for r in df.collect()], key=str)


def random_vectors(n=300, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dims)) * 0.2).astype(np.float32)
    x[n // 2:2 * n // 3] = x[0]  # copies
    return [(i, [float(c) for c in v], None if i % 7 == 0 else i % 3) for i, v in enumerate(x)]


ODD = [(1000, None, 1), (1001, [None] * 16, 1), (1002, [float("nan")] * 16, None), (1003, [float("inf")] + [0.0] * 15, 1), (None, [0.25] * 16, 1),
       (None, [0.25] * 16, 1), (3, [0.5] * 16, 2), (3, [0.5] * 16, 2), (1004, [0.0] * 16, None), (1005, [0.1] * 5, 0), (1006, [], 0), (1050, [0.25] * 16, 1)]


def test_codes_against_brute_force(spark):
    for rows in (random_vectors() + ODD, random_vectors(10), random_vectors(40, 64)):
        codes, books = code_compression.compress_vectors(vectors(spark, rows).repartition(3))
        want, want_books = brute_codes(rows)
        assert books.books.tolist() == want_books and code_rows(codes) == want


def test_code_edges(spark):
    for rows in ([], [(None, None, None)] * 3, [(1, [None, 1.0], 1)]):
        codes, books = code_compression.compress_vectors(vectors(spark, rows))
        assert code_rows(codes) == [] and books.sha256() == hashlib.sha256(b"").hexdigest()
    same = [(7, [0.5, -0.5], 1)] * 40
    codes, books = code_compression.compress_vectors(vectors(spark, same))
    assert code_rows(codes) == brute_codes(same)[0]
    with pytest.raises(Exception, match="32 bits"):
        code_compression.compress_vectors(vectors(spark, [(1, [1e30], 1)]))


def test_memo_leaves_out_only_dominated_entries():
    rng = np.random.default_rng(2)
    x, book = rng.integers(-2000, 2000, (3000, 4)), rng.integers(-2000, 2000, (16, 4))
    far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    for cell, most in ((128, 1 << 15), (700, 50), (10_000, 1 << 15)):
        memo = code_compression.CellMemo(book, cell, most)
        entry, error = memo.nearest(x)
        assert (entry == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
        again = memo.evaluated
        assert (memo.nearest(x[::-1])[0] == entry[::-1]).all() and memo.evaluated == 2 * again
    few = code_compression.CellMemo(book, 128)
    few.nearest(x)
    assert few.evaluated < 0.5 * far.size


# ---- 13 ----------------------------------------------------------------------

def brute_search(rows, k=5):
    kept = kept_integers(rows, 256)
    out = []
    for n, (i, _, q) in enumerate(kept):
        if i is not None and i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, (j, _, v) in enumerate(kept) if m != n)
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def found_rows(df):
    assert df.columns == ["query_id", "rank", "id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("lists, block", [(2, 16_384), (1, 3), (4, 2), (16, 5)])
def test_top_k_against_brute_force(spark, lists, block):
    rows = random_vectors(400, 16, 4) + ODD + [(50, [0.25] * 16, 1)] * 2 + [(-100, [-0.125] * 16, 1)]
    got = topk_search.top_k_search(vectors(spark, rows).repartition(3), F.col("vec_id") % 50 == 0, lists=lists, block=block)
    assert found_rows(got) == brute_search(rows)


def test_top_k_edges(spark):
    asks = F.col("vec_id") % 50 == 0
    for rows in ([], [(None, None, None)] * 3, [(1, [1.0], 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (0, [1.0], 1), (1, [-1.0], 1)],
                 [(0, [], 1), (1, [0.5], 1)], [(50, [30_000.0] * 8, 1), (1, [30_000.0] * 8, 1)], [(0, [0.5], 1)] * 30):
        assert found_rows(topk_search.top_k_search(vectors(spark, rows), asks)) == brute_search(rows)


def test_cutoffs_are_safe_and_sharp():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int32)
    rows = pa.table({"id": np.arange(4000), "member": np.arange(4000), "v": pa.array([r.tobytes() for r in x], pa.binary())})
    queries = topk_search.Queries(rows.slice(0, 300), 64, 2, np.float32)

    class Shared:
        value = queries

    class Cutoffs:
        pass

    true = x[:300].astype(np.int64) @ x.T.astype(np.int64)
    true[np.arange(300), np.arange(300)] = -2 ** 60
    fifth = np.sort(true, axis=1)[:, -5]
    gathered = list(topk_search._gather(Shared, 64, 5, np.float32)(iter(rows.to_batches(1000))))[0].to_pandas()
    assert (gathered.groupby("query").size() == 5).all() and len(gathered) == 1500
    Cutoffs.value = gathered.groupby("query").score.min().to_numpy()
    assert (Cutoffs.value <= fifth).all() and (Cutoffs.value > 0.6 * fifth).all()
    parts, own = queries.partial_scores(0, 256, np.arange(4000), x.astype(np.float32))
    enough = np.logical_or.reduce([p >= np.ceil(Cutoffs.value[:256, None] / 2) for p in parts]) & ~own
    assert enough.mean() < 0.1 and (true[:256] < fifth[:256, None])[~enough].all()


def test_blocks_hold_what_they_promise(spark):
    rows = Scratch(spark, "t").keep(spark.range(1000).repartition(7).withColumn("number", F.monotonically_increasing_id()))
    blocks = numbered_blocks(rows, "number", 64)
    counts = [rows.where(F.col("number").between(a, b)).count() for a, b in blocks]
    assert counts == [64] * 15 + [40]
