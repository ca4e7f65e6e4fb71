"""Strict JSON documents, Parquet tables, manifests and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.fingerprints import multiset_fingerprint
from ..plans.lineage import cut_lineage
from .digests import PACKED, sequential_sha256
from .text import read_text_files
from ..records import (
    ATTACHMENT_SCHEMA, CALCULATION_SCHEMA, OBSERVABLE_SCHEMA, REVIEW_SCHEMA, SCHEMA_VERSION, STRUCTURE_SCHEMA,
    STUDY_ROW_SCHEMA,
)

# fixed values: columns a run manifest must have
MANIFEST_COLUMNS = (
    "system_id", "reaction_class", "charge", "multiplicity", "mlip_model", "dft_method", "basis",
    "high_level_method", "decision_type",
)

# fixed values: units of study tables
STUDY_ENERGY_UNIT, COST_UNIT = "kcal/mol", "relative"

TABLE_SCHEMAS = {
    "structure": STRUCTURE_SCHEMA, "observable": OBSERVABLE_SCHEMA, "calculation": CALCULATION_SCHEMA,
    "study_row": STUDY_ROW_SCHEMA, "attachment": ATTACHMENT_SCHEMA, "review": REVIEW_SCHEMA,
}


def _ddl(schema: T.DataType) -> str:
    """Schema with free JSON fields read as VARIANT."""
    return schema.simpleString()


def strict_variant(text) -> Column:
    """VARIANT of a JSON text; duplicate keys, NaN and malformed input fail the query."""
    return F.parse_json(text)


def json_problem(text) -> Column:
    """Reason why a text is not strict JSON, or NULL."""
    return F.when(F.try_parse_json(text).isNull(), F.lit("not strict JSON"))


def read_documents(spark: SparkSession, path) -> DataFrame:
    """(path, doc VARIANT) for whole-file JSON documents, each checked for the schema version."""
    return check_documents(read_text_files(spark, path))


def check_documents(texts: DataFrame) -> DataFrame:
    """The same for (path, text) rows that are already in a table."""
    raw = texts.select("path", strict_variant(F.col("text")).alias("doc"))
    version = F.try_variant_get("doc", "$.schema_version", "string")
    return raw.withColumn("doc", F.when(version == SCHEMA_VERSION, F.col("doc")).otherwise(
        F.raise_error(F.concat(F.lit("unsupported schema version in "), F.col("path")))))


def _unpack(documents: DataFrame, field: str, schema: T.StructType) -> DataFrame:
    rows = F.variant_get("doc", f"$.{field}", f"array<variant>")
    exploded = documents.select(F.explode(rows).alias("_r"))
    return exploded.select(*[
        F.variant_get("_r", f"$.{f.name}", _ddl(f.dataType)).alias(f.name) for f in schema.fields
    ])


def load_dataset(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(structures, observables) of one or many dataset documents."""
    return unpack_dataset(read_documents(spark, path))


def unpack_dataset(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _unpack(documents, "structures", STRUCTURE_SCHEMA), _unpack(documents, "observables", OBSERVABLE_SCHEMA)


def load_calculations(spark: SparkSession, paths) -> DataFrame:
    """Union of calculation documents; use ``duplicate_keys`` for the uniqueness rule."""
    return _unpack(read_documents(spark, paths), "calculations", CALCULATION_SCHEMA)


def load_study_table(spark: SparkSession, path) -> DataFrame:
    """Rows of one or many study documents (see :func:`unpack_study_table`)."""
    return unpack_study_table(read_documents(spark, path))


def unpack_study_table(documents: DataFrame) -> DataFrame:
    """Study rows with what a study needs to know of where they stood.

    ``duplicate_of``: the mark in a row's metadata, if any; ``ord``: the row's place, documents one after the other by
    path; ``cost_unit``: that of its document.  An energy unit other than that of study tables, or an empty cost unit,
    is an error.
    """
    field = lambda name, default: F.coalesce(F.variant_get("doc", f"$.{name}", "string"), F.lit(default))
    unit, energy = field("cost_unit", COST_UNIT), field("energy_unit", STUDY_ENERGY_UNIT)
    wrong = F.raise_error(F.concat(F.lit("study tables are in kcal/mol and name a cost unit: "), F.col("path")))
    opened = documents.select(
        "path", F.when((energy == STUDY_ENERGY_UNIT) & (F.length(unit) > 0), unit).otherwise(wrong).alias("cost_unit"),
        F.variant_get("doc", "$.rows", "array<variant>").alias("_rows"))
    # one narrow row per document
    sizes = opened.select(F.col("path").alias("_path"), F.size("_rows").cast("long").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_path").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    placed = opened.select("path", "cost_unit", F.posexplode("_rows").alias("_at", "_r")).join(starts, F.col("path") == F.col("_path"))
    return placed.select(
        *[F.variant_get("_r", f"$.{f.name}", _ddl(f.dataType)).alias(f.name) for f in STUDY_ROW_SCHEMA.fields],
        F.try_variant_get("_r", "$.metadata.duplicate_of", "string").alias("duplicate_of"), (F.col("_before") + F.col("_at")).alias("ord"), "cost_unit")


def load_records(spark: SparkSession, path, kind: str) -> DataFrame:
    """A bare JSON list of attachments or reviews."""
    raw = spark.read.text(path, wholetext=True).select(strict_variant(F.col("value")).alias("doc"))
    rows = raw.select(F.explode(F.variant_get("doc", "$", "array<variant>")).alias("_r"))
    return rows.select(*[
        F.variant_get("_r", f"$.{f.name}", _ddl(f.dataType)).alias(f.name) for f in TABLE_SCHEMAS[kind].fields])


def dataset_violations(structures: DataFrame, observables: DataFrame) -> DataFrame:
    """(rule, violations) of the rules that span records (balance is ``balance_report``)."""
    def repeats(df, rule):
        return df.groupBy("id").agg(F.count("*").alias("n")).agg(
            F.lit(rule).alias("rule"), F.count(F.when(F.col("n") > 1, 1)).alias("violations"))

    def empty(df, rule):
        return df.agg(F.lit(rule).alias("rule"), F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("violations"))

    spread = observables.where(F.col("decision_group").isNotNull()).groupBy("decision_group").agg(
        F.count_distinct("group_id").alias("k"))
    return (
        empty(structures, "no_structures").unionByName(empty(observables, "no_observables"))
        .unionByName(repeats(structures, "duplicate_structure")).unionByName(repeats(observables, "duplicate_observable"))
        .unionByName(spread.agg(F.lit("decision_group_crosses_groups").alias("rule"),
                                F.count(F.when(F.col("k") > 1, 1)).alias("violations")))
    )


# ---- bulk tables and sinks ---------------------------------------------------

def save_table(df: DataFrame, path: str, partition_by=()) -> None:
    """Parquet, never overwriting an existing result."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def load_table(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    reader = spark.read if kind is None else spark.read.schema(TABLE_SCHEMAS[kind])
    return reader.parquet(path)


# fixed values: columns of the decision sink
DECISION_COLUMNS = (
    "policy", "row_id", "group_id", "action", "prediction", "cost", "ran_dft", "ran_high_level", "reason",
    "absolute_error", "correct", "abstained",
)


def write_decisions(decisions: DataFrame, path: str) -> None:
    decisions.select(*DECISION_COLUMNS).write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def merge_calculations(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


# ---- manifests ---------------------------------------------------------------

def scan_manifest(spark: SparkSession, path) -> DataFrame:
    """A run manifest CSV; raises before use if a required column or every row is missing."""
    df = spark.read.option("header", True).csv(path)
    missing = sorted(set(MANIFEST_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"manifest lacks columns {missing}")
    if df.isEmpty():
        raise ValueError("manifest has no systems")
    return df


def file_manifest(spark: SparkSession, path, block_bytes: int = 1 << 28) -> DataFrame:
    """(path, bytes, sha256) of every input file; no task reads much more than ``block_bytes`` of a file."""
    files = spark.read.format("binaryFile").load(path)
    # known from the listing, so that nothing is read of the others
    whole = (F.col("_metadata.file_size") <= block_bytes) | F.lower("_metadata.file_name").rlike(PACKED)
    digests = files.where(whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    long = cut_lineage(files.where(~whole).select("path", F.col("length").alias("bytes"), F.col("_metadata.file_path").alias("located")))
    if long.isEmpty():
        return digests
    return digests.unionByName(long.join(sequential_sha256(spark, path, long, block_bytes), "located").select("path", "bytes", "sha256"))


def table_manifest(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(path, rows, fingerprint) per file of a table as Spark reads it: a changed file names itself.

    Rows are digested where they are read and added up per file, so a large file is the work of many tasks and has no
    size limit; neither the order of rows nor how they are split matters.
    """
    columns = list(columns or table.columns)
    located = table.select(F.col("_metadata.file_path").alias("path"), *columns)
    return multiset_fingerprint(located, columns, ["path"])


def protocol_digest(manifest: DataFrame, config_json: str) -> DataFrame:
    """One row: digest of a configuration together with the (path, sha256) multiset it was frozen with."""
    from ..operators.fingerprints import multiset_fingerprint

    inputs = multiset_fingerprint(manifest, ["path", "sha256"])
    return inputs.select(
        "rows", F.sha2(F.concat_ws("|", F.lit(config_json), F.col("fingerprint")), 256).alias("protocol_sha256"),
        F.current_timestamp().alias("created_utc"))
