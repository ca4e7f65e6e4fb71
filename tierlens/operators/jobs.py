"""Job plans as tables: content-addressed planning, verification, import and pending work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_true
from ..sources.run_logs import demand_correlation_pattern, extract_gradients, extract_run_logs

_STRUCTURE = ("charge", "id", "multiplicity", "positions_angstrom", "source", "symbols")


def _job_id() -> Column:
    content = F.struct(F.col("config"), F.struct(*[F.col(c) for c in _STRUCTURE]).alias("structure"))
    return F.sha2(F.to_json(content), 256)


def plan_jobs(structures: DataFrame, configs: Sequence[dict]) -> DataFrame:
    """One job per structure and configuration; ``job_id`` is the digest of its content.

    Configurations are a handful of literals, so they are exploded from an array rather than joined.
    """
    names = sorted({k for c in configs for k in c})
    if not configs or any("method_id" not in c for c in configs):
        raise ValueError("every configuration needs a method_id")
    literal = F.array(*[F.struct(*[F.lit(c.get(n)).alias(n) for n in names]) for c in configs])
    jobs = structures.withColumn("config", F.explode(literal))
    return jobs.select(_job_id().alias("job_id"), "config", *_STRUCTURE)


def verify_plan(plan: DataFrame) -> DataFrame:
    """(job_id, problem) for changed or repeated jobs."""
    checked = plan.select("job_id", (F.col("job_id") == _job_id()).alias("_same"))
    return checked.groupBy("job_id").agg(F.count("*").alias("_n"), F.min("_same").alias("_same")).select(
        "job_id", F.when(~F.col("_same"), "content differs from id").when(F.col("_n") > 1, "repeated job").alias("problem")
    ).where(F.col("problem").isNotNull())


def import_results(
    plan: DataFrame, logs: DataFrame, inputs: DataFrame | None = None, gradients: DataFrame | None = None,
    correlation_pattern: str | None = None,
) -> DataFrame:
    """Calculations for every planned job; a job without a log stays as a failed record.

    ``logs``/``gradients``: (job_id, text).  ``inputs``: (job_id, expected_sha256, actual_sha256) — a mismatch
    sets ``input_problem`` instead of importing the numbers.  There is a log per job, and its size says nothing about
    that of the tables it came from, so the joins are never broadcasts that pass the driver.
    """
    joined = plan.withColumn("atom_count", F.size("symbols")).join(logs.select("job_id", "text").hint("merge"), "job_id", "left")
    parsed = extract_run_logs(joined)
    if correlation_pattern is not None:
        parsed = demand_correlation_pattern(parsed.withColumn("fidelity", F.col("config.fidelity")), correlation_pattern)
    absent = F.col("text").isNull()
    if inputs is None:
        parsed = parsed.withColumn("input_problem", F.lit(None).cast("string"))
    else:
        parsed = parsed.join(inputs.hint("merge"), "job_id", "left").withColumn("input_problem", F.when(
            F.col("text").isNotNull() & ~is_true(F.col("expected_sha256") == F.col("actual_sha256")),
            "input missing or changed"))
    if gradients is not None:
        parsed = extract_gradients(parsed.join(gradients.select("job_id", F.col("text").alias("_grad")).hint("merge"), "job_id", "left"), "_grad")
    else:
        parsed = parsed.withColumn("forces_ev_angstrom", F.lit(None).cast("array<array<double>>"))
    clean = ~absent & F.col("input_problem").isNull()
    ok = clean & (F.col("status") == "succeeded")
    kept = lambda c: F.when(clean, F.col(c)).alias(c)
    return parsed.select(
        "job_id", F.col("id").alias("structure_id"), F.col("config.method_id").alias("method_id"),
        F.when(clean, F.col("status")).otherwise("failed").alias("status"),
        F.when(ok, F.col("energy_hartree")).alias("energy"), F.lit("hartree").alias("energy_unit"),
        F.when(ok, F.col("forces_ev_angstrom")).alias("forces_ev_angstrom"),
        kept("scf_cycles"), kept("spin_contamination"), kept("fod"), kept("homo_lumo_gap_ev"), kept("software_version"),
        F.when(absent, "output missing").when(F.col("input_problem").isNotNull(), F.col("input_problem"))
        .otherwise(F.col("message")).alias("message"),
        F.sha2("text", 256).alias("raw_sha256"),
    )


def pending_jobs(plan: DataFrame, results: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Jobs still to run: never run, marked pending, or failed with attempts left.

    ``results``: (job_id, status, attempts), one row per job that was ever started.
    """
    if max_attempts < 1:
        raise ValueError("max_attempts must be positive")
    settled = results.where((F.col("status").isin("succeeded", "running"))
                            | ((F.col("status") == "failed") & (F.col("attempts") >= max_attempts)))
    return plan.join(settled.select("job_id"), "job_id", "left_anti")


def status_counts(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Number of planned jobs per status; jobs without a result are pending."""
    return plan.select("job_id").join(results.select("job_id", "status"), "job_id", "left").groupBy(
        F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count("*").alias("jobs"))
