"""One query per operator, on the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    code_compression, conversation_trie, decontamination, embedding_dedup, language_id, license_scan, line_dedup, mixing, sharding, simhash_dedup,
    substring_dedup, token_counts, topk_search)
from .tables import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op6_simhash_near_dedup")
def op6(spark, sf_dir):
    found = simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def _mix_quality(spark, sf_dir: str, documents: DataFrame) -> DataFrame:
    """``documents`` with ``_quality``: 2 for labelled good, 1/2 for labelled poor, 1 without a label."""
    scratch = Scratch(spark, "quality")
    labels = scratch.keep(table(spark, sf_dir, "labels").where("doc_id is not null").groupBy(F.col("doc_id").alias("_labelled")).agg(
        F.max("quality").alias("_good")))
    weight = F.when(F.col("_good") > 0, 2.0).when(F.col("_good") == 0, 0.5).otherwise(1.0)
    return documents.join(labels, F.col("doc_id") == F.col("_labelled"), "left").withColumn("_quality", weight).drop("_labelled", "_good")


@query("op1_mix_sources", """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
quality as (select doc_id, max(quality) as good from labels where doc_id is not null group by doc_id),
drawn as (
  select s.doc_id, s.source, s.size,
    -ln((('0x' || substr(md5('42|' || coalesce(s.doc_id::varchar, 'null') || '|' || s.size), 1, 13))::bigint + 0.5) / 4503599627370496.0)
      / (case when good > 0 then 2.0 when good = 0 then 0.5 else 1.0 end) as draw
  from sized s left join quality q on s.doc_id = q.doc_id),
sources as (
  select source, sum(size) as source_size,
    [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
  from drawn group by source),
ratio as (select *, 2.0::double * source_size as cap, row_number() over (order by 2.0 * source_size / weight, source nulls last) as place from sources),
level as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by place rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by place rows between current row and unbounded following) as level from ratio),
chosen as (select arg_min(level, place) as level from level where level * weight < cap),
targets as (
  select s.source, s.source_size, coalesce(least(s.cap, c.level * s.weight), s.cap) as target
  from ratio s cross join chosen c),
plan as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from targets),
summed as (
  select d.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size as rest,
    sum(d.size) over (partition by d.source order by d.draw, d.doc_id, d.size range between unbounded preceding and current row) as upto,
    sum(d.size) over (partition by d.source, d.draw, d.doc_id, d.size) as own
  from drawn d join plan p on d.source is not distinct from p.source)
select doc_id, size, source_size::bigint as source_size, target,
  (size * (epochs + case when 2 * upto - own <= 2 * rest then 1 else 0 end))::bigint as taken
from summed
""")
def op1(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    mixed = mixing.mix_sizes(_mix_quality(spark, sf_dir, sizes), quality=F.col("_quality"))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op2_language_id")
def op2(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op7_decontamination", """
with words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as length, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as passage
  from item_words, lateral (select unnest(range(1, len(w) - least(len(w), 10) + 2)) as i) where len(w) > 0),
places as (
  select doc_id, i, length, array_to_string(w[i:i + length - 1], ' ') as passage
  from words, (select distinct length from windows) lengths, lateral (select unnest(range(1, len(w) - length + 2)) as i)),
found as (select p.doc_id, p.i, p.length, w.item_id from places p join windows w using (length, passage)),
hits as (select doc_id, count(distinct j) as n_hit from (select distinct doc_id, i, length from found), lateral (select unnest(range(i, i + length)) as j) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as listed from found group by doc_id)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hits using (doc_id) left join items using (doc_id)
""")
def op7(spark, sf_dir):
    found = decontamination.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op9_sharding")
def op9(spark, sf_dir):
    body = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = sharding.shard_rows(rows, 40, identity=[F.col("doc_id"), F.col("text_crc32")])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_token_counts")
def op10(spark, sf_dir):
    import public_tokenizers

    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumnRenamed("id", "doc_id")


@query("op8_embedding_near_dedup")
def op8(spark, sf_dir):
    found = embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query("op3_line_dedup")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = line_dedup.repeated_lines(docs)
    return found.select(
        F.col("id").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), F.col("removed").alias("removed_lines"))


@query("op4_substring_dedup")
def op4(spark, sf_dir):
    return substring_dedup.drop_repeated_spans(table(spark, sf_dir, "documents"))


@query("op5_license_scan")
def op5(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _crc32_table() -> str:
    """DuckDB list of the 256 remainders of the reflected CRC-32 polynomial, by its rule."""
    step = "case when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end"
    return f"list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: {step}))"


@query("op11_conversation_trie", f"""
with recursive crc_table as (select {_crc32_table()} as t),
ids as (select distinct conv_id as c, conv_id - conv_id % 100 as host, conv_id::varchar as name from conversations where conv_id is not null),
hashed as (
  select c, host, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(name)), lambda i: ascii(name[i + 1])::bigint)),
    lambda crc, byte: xor(crc // 256, t[(xor(crc, byte) % 256) + 1])), 4294967295::bigint) % 6 as h
  from ids, crc_table),
turns as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null),
mixed as (
  select h.c, 0 as own, t.pos, t.role, t.text from hashed h join turns t on t.c = h.host and t.pos < h.h
  union all select h.c, 1, t.pos, t.role, t.text from hashed h join turns t on t.c = h.c and t.pos >= h.h),
listed as (select c, list(struct_pack(role := role, text := text) order by own, pos) as turns from mixed group by c),
rebuilt as (select ids.c, coalesce(turns, []) as turns from ids left join listed using (c)),
prefixes as (select c, d, turns[1:d] as prefix, len(turns) = d as ends from rebuilt, lateral (select unnest(range(0, len(turns) + 1)) as d)),
nodes as (
  select d, prefix, min(c) as conv_id, count(*) as n, string_agg(case when ends then c::varchar end, ',' order by c) as ending,
    case when d > 0 then length(prefix[d].text) else 0 end as size
  from prefixes group by d, prefix),
children as (select d - 1 as d, prefix[1:d - 1] as prefix, count(*) as n_children from nodes where d > 0 group by 1, 2),
below as (
  select u.d, u.prefix, count(*) filter (where ch.n_children is null) as n_leaves, sum((v.n - 1) * v.size) as saved
  from nodes v left join children ch on ch.d = v.d and ch.prefix = v.prefix,
    lateral (select unnest(range(0, v.d + 1)) as d, v.prefix[1:d] as prefix) u group by 1, 2)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(ch.n_children, 0) as n_children,
  b.n_leaves, b.saved::bigint as saved_tokens, sha256(coalesce(n.ending, '')) as ends_sha256
from nodes n left join nodes p on p.d = n.d - 1 and p.prefix = n.prefix[1:n.d - 1]
  left join children ch on ch.d = n.d and ch.prefix = n.prefix join below b on b.d = n.d and b.prefix = n.prefix
""")
def op11(spark, sf_dir):
    nodes = conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))
    return nodes.select(
        F.col("member").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), "ends_sha256")


def _codebook_rounds(rounds: int) -> str:
    """SQL of ``rounds`` refinements: b0 .. b<rounds> are codebooks, a0 .. a<rounds> the parts assigned to them."""
    whole = "((s - ((s % n) + n) % n) // n)"  # floor, also below zero
    out = []
    for r in range(rounds + 1):
        out.append(f"""
a{r} as materialized (
  select row, part, arg_min(entry, far * 16 + entry) as entry, min(far) as far from (
    select q.row, q.part, entry, list_sum(list_transform(list_zip(q.x, book), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as far
    from parted q join b{r} using (part)) group by row, part)""")
        if r < rounds:
            out.append(f"""
s{r} as (
  select part, entry, count(*) as n, list_transform(range(1, max(len(x)) + 1), lambda j: list_sum(list_transform(list(x), lambda v: v[j]))::bigint) as total
  from a{r} join parted using (row, part) group by part, entry),
b{r + 1} as materialized (
  select part, entry, coalesce(list_transform(total, lambda s: {whole}), book) as book from b{r} left join s{r} using (part, entry))""")
    return ",".join(out)


@query("op12_code_compression", f"""
with kept as (
  select row_number() over (order by vec_id nulls last) as row, vec_id, label, list_transform(embedding, lambda x: floor(4096.0::double * x)::bigint) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parted as materialized (select row, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] as x from kept, lateral (select unnest(range(8)) as part)),
b0 as materialized (select part, (row - 1)::int as entry, x as book from parted where row <= 16),{_codebook_rounds(6)},
coded as (select row, string_agg(lower(printf('%02x', entry)), '' order by part) as code, sum(far)::bigint as error from a6 group by row),
digest as (select sha256(string_agg(array_to_string(book, ','), ',' order by part, entry)) as sha from b6)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, sha as codebooks_sha256
from kept join coded using (row), digest
""")
def op12(spark, sf_dir):
    codes, books = code_compression.compress_vectors(table(spark, sf_dir, "embeddings"))
    return codes.select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


@query("op13_topk_search", """
with kept as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256.0::double * x)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.row, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from kept q join kept c on q.row <> c.row where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by row order by score desc, vec_id nulls last) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
""")
def op13(spark, sf_dir):
    found = topk_search.top_k_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")
