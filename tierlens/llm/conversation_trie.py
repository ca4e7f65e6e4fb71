"""The prefix trie of conversations, from sorted sequences (operator 11).

Sorted by their sequences of turns, the conversations that share a prefix stand side by side.  With the length of the
common prefix (LCP) of every neighbouring pair, the members of a prefix of depth d are the widest interval around one
of them in which no LCP is below d.  A sparse table of range minima lets every candidate prefix find the left and the
right end of that interval by binary search, each candidate for itself; no stack walks over the order.

So that no conversation has to fit into one row, depths are cut into slabs of ``slab`` turns.  A conversation stands
once in every slab it reaches, below a 128-bit hash of all its turns before the slab; rows of a slab share a node
exactly if they share that hash and the turns inside the slab.  Equal rows are folded first.  The order is range
partitioned; an interval that crosses partitions is found in parts, which know their common left end from a summary of
one row per partition and are added up by it.

Let Q(c) be the code points in the prefix that conversation c shares with a smaller conversation.  A node with n
members, least member m and p code points above its own turn saves sum(Q) - Q(m) - (n - 1) p in its whole subtree, so
sums over intervals replace sums over subtrees; leaves are counted in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import running
from .grouping import sorted_runs
from .tables import Scratch

HOST_SPAN, HOST_TURNS = 100, 6  # a conversation starts with up to 5 turns of the first of its hundred
_IDS_AT_ONCE = 1024
_PREFIX = ["g1", "g2", "g3", "g4"]


# ---- turns in order, and what each conversation becomes ----------------------

def numbered_turns(conversations: DataFrame, scratch: Scratch, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, at, t1, t2, size): turns numbered from 0 inside their conversation.

    Order: turn number (NULL first), then role and text.  The table is range partitioned by that order, so that a
    conversation of any length is spread; t1 and t2 are hashes of role and text, size counts the text's code points.
    """
    said = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text)]
    rows = conversations.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("long").alias("c"), F.col(turn).alias("turn"), said[0].alias("role"), said[1].alias("text"))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    spread = rows.withColumn("copy", F.monotonically_increasing_id())  # copies of one row may be many
    placed = spread.repartitionByRange(*order, "copy").sortWithinPartitions(*order, "copy").select(
        F.spark_partition_id().alias("piece"), "c", F.xxhash64(F.lit(1), "role", "text").alias("t1"),
        F.xxhash64("text", F.lit(2), "role").alias("t2"), F.length("text").cast("long").alias("size"))
    local = scratch.keep(placed.mapInArrow(_count_up, "piece int, c long, t1 long, t2 long, size long, at long"))
    ends = local.groupBy("c", "piece").agg(F.max("at").alias("last"))
    # only conversations that go on from an earlier piece: at most one row per piece
    before = F.sum(F.col("last") + 1).over(W.partitionBy("c").orderBy("piece").rowsBetween(W.unboundedPreceding, -1))
    goes_on = ends.withColumn("before", before).where("before > 0").select("c", "piece", "before")
    joined = local.join(F.broadcast(goes_on), ["c", "piece"], "left")
    return joined.select("c", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "t1", "t2", "size")


def _count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``at``: the place of a row inside its run of equal ``c``."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column("c").to_numpy()
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        at = np.arange(len(c)) - np.repeat(starts, np.diff(np.r_[starts, len(c)]))
        if c[0] == last:
            at[:starts[1] if len(starts) > 1 else len(c)] += seen
        last, seen = c[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "at"])


def hosted(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conversations (c, length), turns (c, p, t1, t2, size) with p from 1) after rebuilding.

    Conversation c starts with the first h turns of the first conversation of its hundred (all if it has fewer, none
    if it does not exist), h = crc32(decimal c) % 6; its own turns after the first h follow.
    """
    shared = F.crc32(F.col("c").cast("string").cast("binary")) % HOST_TURNS
    lengths = scratch.keep(turns.groupBy("c").agg((F.max("at") + 1).alias("own")).withColumns(
        {"h": shared, "host": F.col("c") - F.col("c") % HOST_SPAN}))
    host_lengths = lengths.where("c = host").select(F.col("c").alias("host"), F.col("own").alias("host_own"))
    taken = F.least("h", F.coalesce("host_own", F.lit(0)))
    known = scratch.keep(lengths.join(host_lengths, "host", "left").withColumn("taken", taken))
    heads = turns.where((F.col("c") % HOST_SPAN == 0) & (F.col("at") < HOST_TURNS - 1)).withColumnRenamed("c", "host")
    given = known.where("taken > 0").select("c", "host", "taken").join(heads, "host").where("at < taken")
    own = turns.join(known.select("c", "h", "taken"), "c").where("at >= h")
    columns = ["t1", "t2", "size"]
    rebuilt = given.select("c", (F.col("at") + 1).alias("p"), *columns).unionByName(
        own.select("c", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("p"), *columns))
    return known.select("c", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), rebuilt


# ---- slabs -------------------------------------------------------------------

def _key(depth: Column, sums: list[Column]) -> list[Column]:
    """128 bits that name a prefix: its depth and the sums of its turns' hashes."""
    return [F.xxhash64(depth, *sums), F.xxhash64(F.lit(3), *reversed(sums), depth)]


def slab_rows(rebuilt: DataFrame, scratch: Scratch, slab: int) -> DataFrame:
    """(c, s, b1, b2, k1, k2, depth, above, ids, sizes): one row per conversation and slab it reaches.

    b1, b2 name the prefix before the slab, k1, k2 the one up to the row's last turn (at ``depth``); ``above`` counts
    the code points before the slab.  Turns are hashed with their depth, so a prefix is known by sums of hashes, which
    running sums over slabs give.
    """
    low, high = F.lit(0xFFFFFFFF), 32
    x = [F.xxhash64(F.lit(1), "p", "t1", "t2"), F.xxhash64("t2", "p", F.lit(2), "t1")]
    pieces = [y for v in x for y in (v.bitwiseAND(low), F.shiftrightunsigned(v, high))]
    turns = rebuilt.select("c", "p", "t1", "t2", "size", ((F.col("p") - 1) / slab).cast("long").alias("s"),
                           *[piece.alias(g) for piece, g in zip(pieces, _PREFIX)])
    # at most ``slab`` turns each
    rows = scratch.keep(turns.groupBy("c", "s").agg(
        F.array_sort(F.collect_list(F.struct("p", "t1", "t2", "size"))).alias("turns"),
        *[F.sum(g).alias(g) for g in _PREFIX], F.sum("size").alias("size")))
    # slabs of one conversation are added up in runs of 1024
    upto = running(rows, "s", sums={f"{g}_upto": g for g in (*_PREFIX, "size")}, keys=["c"], bucket=(F.col("s") / 1024).cast("long").cast("double"))
    start, end = F.col("s") * slab, F.col("s") * slab + F.size("turns")
    before, through = [F.col(f"{g}_upto") - F.col(g) for g in _PREFIX], [F.col(f"{g}_upto") for g in _PREFIX]
    names = dict(zip(("b1", "b2"), _key(start, before))) | dict(zip(("k1", "k2"), _key(end, through)))
    ids = F.flatten(F.transform("turns", lambda t: F.array(t["t1"], t["t2"])))
    return upto.select("c", "s", *[v.alias(k) for k, v in names.items()], end.alias("depth"), (F.col("size_upto") - F.col("size")).alias("above"),
                       ids.alias("ids"), F.col("turns.size").alias("sizes"))


# ---- sorted order and common prefixes ----------------------------------------

_ORDERED = ("piece int, at long, s long, b1 long, b2 long, k1 long, k2 long, depth long, above long, sizes array<long>, "
            "n long, least long, ends long, lcp long, ids array<long>, tails array<long>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _common_turns(x: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """How many leading turns (two longs each) agree between x[a:a_end] and x[b:b_end], for many pairs at once."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        i, j = a[live] + 2 * out[live], b[live] + 2 * out[live]
        inside = (i < a_end[live]) & (j < b_end[live])
        live, i, j = live[inside], i[inside], j[inside]
        same = (x[i] == x[j]) & (x[i + 1] == x[j + 1])
        live = live[same]
        out[live] += 1
    return out


def _neighbours(slab: int):
    """Adds to sorted rows the LCP with the row before (-1: no common slab; the first row of a piece gets -1 for now).

    The first and the last row of a piece keep their ids; the last also says how many rows before it and with it share
    its first 1, 2, ... turns of the slab (``tails``).
    """
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, held, seen = None, None, 0
        run = np.zeros(slab, np.int64)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            head = np.stack([batch.column(c).to_numpy() for c in ("s", "b1", "b2")], axis=1)
            x, offsets = _flat(batch.column("ids"))
            lcp = np.full(rows, -1)
            same = np.flatnonzero((head[1:] == head[:-1]).all(axis=1)) + 1
            lcp[same] = head[same, 0] * slab + _common_turns(x, offsets[same - 1], offsets[same], offsets[same], offsets[same + 1])
            if previous is not None and (previous[0] == head[0]).all():
                pair = np.concatenate([previous[1], x[offsets[0]:offsets[1]]])
                ends = np.array([len(previous[1])]), np.array([len(pair)])
                lcp[0] = head[0, 0] * slab + _common_turns(pair, np.array([0]), ends[0], ends[0], ends[1])[0]
            # rows up to the last one that share its first j turns: back to the last LCP below that depth
            depth = head[-1, 0] * slab + 1 + np.arange(slab)
            back = np.searchsorted(-np.minimum.accumulate(lcp[::-1]), -depth, side="right")
            run = np.where(back < rows, back + 1, run + rows)
            previous = head[-1], x[offsets[-2]:offsets[-1]].copy()
            if held is not None:
                yield held
            keep = np.zeros(rows, bool)
            keep[0] = seen == 0
            base = [batch.column(c) for c in ("piece", "s", "b1", "b2", "k1", "k2", "depth", "above", "sizes", "n", "least", "ends")]
            held = _ordered(base, seen, lcp, batch.column("ids"), keep, None)
            parts, last_ids = (base, seen, lcp, batch.column("ids")), keep.copy()
            last_ids[-1] = True
            last = parts, last_ids
            seen += rows
        if held is not None:
            yield _ordered(*last[0], last[1], run)

    return compute


def _ordered(base, seen: int, lcp: np.ndarray, ids: pa.Array, keep: np.ndarray, run: np.ndarray | None) -> pa.RecordBatch:
    rows = len(lcp)
    kept = pa.array([v if k else None for v, k in zip(_rare(ids, keep), keep)], pa.list_(pa.int64()))
    tails = pa.array([None] * (rows - 1) + [None if run is None else run.tolist()], pa.list_(pa.int64()))
    piece, *rest = base
    return pa.RecordBatch.from_arrays(
        [piece, pa.array(np.arange(seen, seen + rows)), *rest, pa.array(lcp), kept, tails],
        ["piece", "at", "s", "b1", "b2", "k1", "k2", "depth", "above", "sizes", "n", "least", "ends", "lcp", "ids", "tails"])


def _rare(ids: pa.Array, keep: np.ndarray) -> list:
    return [ids[i].as_py() if k else None for i, k in enumerate(keep)]


class Pieces:
    """One entry per piece of the order, for what no piece can see alone: where its rows stand in the whole order, its
    first row's LCP with the piece before, and how far to the left a prefix of its first row goes."""

    def __init__(self, edges: list, least: dict[int, int], slab: int):
        self.slab = slab
        last = {r.piece: r for r in edges if r.tails is not None}
        first = {r.piece: r for r in edges if r.at == 0}
        order = sorted(first)
        self.place = {piece: q for q, piece in enumerate(order)}
        self.size = [last[p].at + 1 for p in order]
        self.offset = np.concatenate([[0], np.cumsum(self.size)]).tolist()
        self.slab_of_last = [last[p].s for p in order]
        self.tails = [last[p].tails for p in order]
        self.boundary = [-1] * len(order)
        for q in range(1, len(order)):
            a, b = last[order[q - 1]], first[order[q]]
            if (a.s, a.b1, a.b2) == (b.s, b.b1, b.b2):
                x = np.array([*a.ids, *b.ids])
                ends = np.array([len(a.ids)])
                self.boundary[q] = a.s * slab + int(_common_turns(x, np.array([0]), ends, ends, np.array([len(x)]))[0])
        # the least LCP of all rows of a piece with the row before
        self.lowest = RangeMinimum(np.array([min(b, least.get(p, b)) for p, b in zip(order, self.boundary)]))

    def left_end(self, q: int, depth: int) -> int:
        """Place of the first row that shares its first ``depth`` turns with the first row of piece q."""
        if self.boundary[q] < depth:
            return self.offset[q]
        t = int(self.lowest.left(np.array([q - 1]), np.array([depth]))[0])  # pieces t+1 .. q-1 are shared whole
        return self.offset[t + 1] - self.tails[t][depth - self.slab_of_last[t] * self.slab - 1]


class RangeMinimum:
    """Sparse table: minima of all runs of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def left(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Least l such that values[l + 1 .. start] all reach ``depth``."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            to = at - (1 << k)
            ok = to >= 0
            ok[ok] = self.levels[k][to[ok] + 1] >= depth[ok]
            at[ok] = to[ok]
        return at

    def right(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Greatest r such that values[start + 1 .. r] all reach ``depth``."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            ok = at + (1 << k) < len(self.values)
            ok[ok] = self.levels[k][at[ok] + 1] >= depth[ok]
            at[ok] += 1 << k
        return at

    def least_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """min(values[left .. right])"""
        k = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        out = np.empty(len(left), self.values.dtype)
        for level in np.unique(k):
            at = k == level
            table = self.levels[level]
            out[at] = np.minimum(table[left[at]], table[right[at] + 1 - (1 << level)])
        return out


# ---- nodes -------------------------------------------------------------------

_NODES = ("first long, depth long, up long, b1 long, b2 long, k1 long, k2 long, n long, least long, ends long, children long, "
          "above long, saved long, leaves long, least_saved long")


def _piece_nodes(rows: pa.Table, pieces: Pieces) -> pa.RecordBatch:
    """The part of every node that lies in one piece of the order (see ``_NODES``; ``first`` is its left end)."""
    slab = pieces.slab
    col = lambda name: rows.column(name).combine_chunks().to_numpy(zero_copy_only=False)
    q = pieces.place[rows.column("piece")[0].as_py()]
    offset, boundary = pieces.offset[q], pieces.boundary[q]
    depth, lcp, base = col("depth"), col("lcp").copy(), col("s") * slab
    lcp[0] = -1  # inside the piece nothing lies before
    common = RangeMinimum(lcp)
    # candidates: at every row the depths at which it is the first of the piece
    low = np.maximum(lcp, base)
    count = depth - low
    start = np.cumsum(count) - count
    i = np.repeat(np.arange(len(depth)), count)
    d = low[i] + 1 + np.arange(len(i)) - start[i]
    left, right = common.left(i, d), common.right(i, d)
    upto = {c: np.concatenate([[0], np.cumsum(col(c))]) for c in ("n", "saved", "leaves")}
    inside = {c: v[right + 1] - v[left] for c, v in upto.items()}
    # least member, and what it saves: ranks of the members, so that one table of minima finds both
    ranked = np.argsort(col("least"), kind="stable")
    rank = np.empty(len(ranked), np.int64)
    rank[ranked] = np.arange(len(ranked))
    at = ranked[RangeMinimum(rank).least_at(left, right)]
    # a neighbouring pair that parts at depth d starts one more child of the node of that depth
    children = np.zeros(len(i), np.int64)
    parting = np.flatnonzero((lcp > base) & (np.arange(len(lcp)) > 0))
    owner = common.left(parting, lcp[parting])
    np.add.at(children, start[owner] + lcp[parting] - low[owner] - 1, 1)
    edge = (left == 0) & (d <= boundary)  # goes on to the left of the piece
    children += np.where(edge, d == boundary, depth[left] > d)

    place = offset + left
    for at_edge in np.flatnonzero(edge):
        place[at_edge] = pieces.left_end(q, int(d[at_edge]))
    up = offset + common.left(i, d - 1)
    edge_up = (up == offset) & (d - 1 <= boundary) & (d - 1 > base[i])
    for shorter in np.unique(d[edge_up] - 1):
        up[edge_up & (d - 1 == shorter)] = pieces.left_end(q, int(shorter))
    top, own = d == base[i] + 1, depth[left] == d
    sizes, offsets = _flat(rows.column("sizes").combine_chunks())
    summed = np.concatenate([[0], np.cumsum(sizes)])
    above = col("above")[i] + summed[offsets[i] + d - base[i] - 1] - summed[offsets[i]]
    null = lambda values, where: pa.array(values, mask=~where)
    deep = top & (base[i] > 0)
    arrays = [
        pa.array(place), pa.array(d), null(up, ~top), null(col("b1")[i], deep), null(col("b2")[i], deep),
        null(col("k1")[left], own), null(col("k2")[left], own), pa.array(inside["n"]), pa.array(col("least")[at]),
        pa.array(np.where(own, col("ends")[left], 0)), pa.array(children), pa.array(above),
        pa.array(inside["saved"]), pa.array(inside["leaves"]), pa.array(col("least_saved")[at])]
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _NODES.split(", ")])


def _nodes(shared):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, "piece", 1 << 18):
            piece = run.column("piece").to_numpy()
            cuts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True])
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield _piece_nodes(run.slice(a, b - a), shared.value)

    return compute


def _intervals(ordered: DataFrame, shared) -> DataFrame:
    """Nodes, their parts in several pieces added up."""
    columns = ["piece", "at", "s", "b1", "b2", "k1", "k2", "depth", "above", "sizes", "n", "least", "ends", "lcp", "saved", "leaves", "least_saved"]
    parts = ordered.select(*columns).repartition("piece").sortWithinPartitions("piece", "at").mapInArrow(_nodes(shared), _NODES)
    same = [F.first(c, ignorenulls=True).alias(c) for c in ("up", "b1", "b2", "k1", "k2", "above")]
    added = [F.sum(c).alias(c) for c in ("n", "ends", "children", "saved", "leaves")]
    least = F.min(F.struct("least", "least_saved")).alias("m")
    return parts.groupBy("first", "depth").agg(*same, *added, least).select(
        "first", "depth", "up", "b1", "b2", "k1", "k2", "above", "n", "ends", "children", "saved", "leaves", "m.*")


# ---- digests of members that end at a node -----------------------------------

def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per (e1, e2) over sorted pieces of text, comma-joined; holds one state and one batch."""
    key, state = None, None

    def ended():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], ["e1", "e2", "sha"])

    for batch in batches:
        done = []
        for e1, e2, text in zip(*(batch.column(c).to_pylist() for c in ("e1", "e2", "text"))):
            if state is None or (e1, e2) != key:
                if state is not None:
                    done.append(ended())
                key, state = (e1, e2), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield from done
    if state is not None:
        yield ended()


def end_digests(ends: DataFrame) -> DataFrame:
    """(e1, e2, sha) of (c, e1, e2): SHA-256 of the decimal c of each key, numerically ascending, comma-joined.

    Runs of ids become texts first (a run spans 1,024 numbers), so a key that ends a third of all conversations is a
    stream of few rows.
    """
    runs = ends.groupBy("e1", "e2", F.floor(F.col("c") / _IDS_AT_ONCE).alias("run")).agg(F.sort_array(F.collect_list("c")).alias("c"))
    texts = runs.select("e1", "e2", "run", F.array_join(F.col("c").cast("array<string>"), ",").alias("text"))
    return texts.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "run").select("e1", "e2", "text").mapInArrow(
        _digest, "e1 long, e2 long, sha string")


# ---- the operator ------------------------------------------------------------

def _where_known(rows: DataFrame, key: str, tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left joins of the rows whose ``key`` is known; the others pass by, or a join would send them all to one task."""
    known = rows.where(F.col(key).isNotNull())
    for table, on in tables:
        known = known.join(table, on, "left")
    return known.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def prefix_trie(
    conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    slab: int = 64, piece_rows: int = 1 << 18,
) -> DataFrame:
    """(member, depth, parent, n_convs, n_children, n_leaves, saved, ends_sha256): one row per distinct prefix.

    Conversations are rebuilt as :func:`hosted` says; their distinct prefixes of d turns are the nodes of depth d, from
    the root (depth 0, whose members are all conversations, also those without turns).  ``member`` is the least member,
    ``parent`` that of the node one turn shorter, ``saved`` the code points that storing each turn of the subtree once
    saves, ``ends_sha256`` the digest of the members that end at the node.  Turns are ordered by number, NULL first,
    equal numbers by role and text; NULL roles and texts count as empty.  Repeated rows are turns of their own.  Rows
    without a conversation id are left out; without conversations there are no nodes.  Turns and prefixes are known by
    128-bit hashes.  Further columns are not read, whatever their names.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "trie")
    turns = scratch.keep(numbered_turns(conversations, scratch, conversation, turn, role, text))
    lengths, rebuilt = hosted(turns, scratch)
    lengths = scratch.keep(lengths)
    members = scratch.keep(slab_rows(rebuilt, scratch, slab))
    last = F.col("length") == F.col("depth")
    folded = scratch.keep(members.join(lengths, "c").groupBy("k1", "k2").agg(
        *[F.first(c).alias(c) for c in ("s", "b1", "b2", "depth", "above", "sizes", "ids")],
        F.count("*").alias("n"), F.min("c").alias("least"), F.sum(last.cast("long")).alias("ends")))
    order = ["s", "b1", "b2", "ids"]
    pieces = max(spark.sparkContext.defaultParallelism, -(-folded.count() // piece_rows))
    placed = folded.repartitionByRange(pieces, *order).sortWithinPartitions(*order).withColumn("piece", F.spark_partition_id())
    ordered = scratch.keep(placed.mapInArrow(_neighbours(slab), _ORDERED))
    # the first and the last row of each piece, and its least LCP
    edges = ordered.where("ids is not null").select("piece", "at", "s", "b1", "b2", "ids", "tails").collect()
    least = {r.piece: r.low for r in ordered.where("at > 0").groupBy("piece").agg(F.min("lcp").alias("low")).collect()}
    shared = spark.sparkContext.broadcast(Pieces(edges, least, slab))

    # what each conversation shares with a smaller one ends where it is the least member for the first time
    nothing = {c: F.lit(0).cast("long") for c in ("saved", "leaves", "least_saved")}
    plain = _intervals(ordered.withColumns(nothing), shared)
    per_least = plain.groupBy("least").agg(
        F.min(F.struct("depth", "above")).alias("top"), F.max((F.col("n") == F.col("ends")).cast("long")).alias("leaf"))
    per_least = scratch.keep(per_least.select(F.col("least").alias("c"), F.col("top.above").alias("shared"), "leaf"))
    whole = members.groupBy("c").agg(F.max(F.col("above") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("whole"))
    worth = scratch.keep(lengths.join(whole, "c", "left").join(per_least, "c", "left").select(
        "c", "length", F.coalesce("shared", "whole", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf")))
    weights = members.select("c", "k1", "k2").join(worth.drop("length"), "c").groupBy("k1", "k2").agg(
        F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"), F.min(F.struct("c", "saved"))["saved"].alias("least_saved"))
    nodes = scratch.keep(_intervals(ordered.join(scratch.keep(weights), ["k1", "k2"]), shared))

    # children and parents across slabs meet by the prefix's name, inside a slab by its left end
    below = nodes.where("b1 is not null").groupBy(F.col("b1").alias("k1"), F.col("b2").alias("k2")).agg(F.count("*").alias("below"))
    in_slab = nodes.select(F.col("first").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent"))
    before = nodes.where("k1 is not null").select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("least").alias("parent_before"))
    ending = members.join(lengths, "c").where(last).select("c", F.col("k1").alias("e1"), F.col("k2").alias("e2"))
    turnless = worth.where("length = 0").select("c", F.lit(None).cast("long").alias("e1"), F.lit(None).cast("long").alias("e2"))
    digests = scratch.keep(end_digests(ending.unionByName(turnless)))
    top = worth.agg(F.min("c").alias("least"), F.count("*").alias("n"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves")).first()
    none = hashlib.sha256(b"").hexdigest()
    roots = []
    if top.n:
        at_root = digests.where("e1 is null").first()
        roots = [(top.least, 0, None, top.n, nodes.where("depth = 1").count(), max(top.leaves, 1), top.saved, at_root.sha if at_root else none)]
    root = spark.createDataFrame(roots, "member long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends_sha256 string")
    named = _where_known(nodes, "k1", [(below, ["k1", "k2"]), (digests.withColumnsRenamed({"e1": "k1", "e2": "k2"}), ["k1", "k2"])])
    named = _where_known(_where_known(scratch.keep(named), "up", [(in_slab, ["up", "depth"])]), "b1", [(before, ["b1", "b2"])])
    parent = F.when(F.col("depth") == 1, F.lit(top.least)).otherwise(F.coalesce("parent", "parent_before"))
    saved = F.col("saved") - F.col("least_saved") - (F.col("n") - 1) * F.col("above")
    result = root.unionByName(named.select(
        F.col("least").alias("member"), "depth", parent.cast("long").alias("parent"), F.col("n").alias("n_convs"),
        (F.col("children") + F.coalesce("below", F.lit(0))).alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved"),
        F.coalesce("sha", F.lit(none)).alias("ends_sha256")))
    out = scratch.keep(result)
    scratch.drop_but(out)
    return out
