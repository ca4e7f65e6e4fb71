"""Reference reaction lists and the dataset they describe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_true, settle
from ..operators.enrich import mark_duplicates
from ..operators.ordered import running, value_edges
from ..plans.lineage import cut_lineage
from .text import to_number, words_of

# fixed values: grammar of one row, "$tmer a/$f b/$f x c1 c2 $w reference"
ROW_MARKS = ("$tmer", "${tmer}")
WEIGHT_MARKS = ("$w", "${w}")
SPECIES_PATTERN = r"^([A-Za-z0-9][A-Za-z0-9_+.-]*)/\$(?:f|\{f\})$"


def parse_reaction_lines(lines: DataFrame) -> DataFrame:
    """Rows (…, source_line, terms, reference, problem) for every data line of (list keys, line, text).

    Other lines are preamble and dropped.  Text is only split, never evaluated; a line outside the grammar
    (quotes and escapes included) keeps its ``problem`` instead of terms.
    """
    keys = [c for c in lines.columns if c != "text"]
    stripped = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    df = lines.select(*keys, stripped.alias("source_line")).where(
        F.col("source_line").startswith(ROW_MARKS[0]) | F.col("source_line").startswith(ROW_MARKS[1]))
    df = df.withColumn("_w", words_of(F.regexp_replace("source_line", "#.*$", "")))
    df = df.withColumns({
        "_x": F.array_position("_w", F.lit("x")).cast("int"),
        "_xs": F.size(F.filter("_w", lambda t: t == "x")),
    })
    one = F.col("_xs") == 1
    df = df.withColumns({
        "_species": F.when(one, F.slice("_w", 2, F.greatest(F.col("_x") - 2, F.lit(0)))),
        "_tail": F.when(one, F.slice("_w", F.col("_x") + 1, F.size("_w"))),
    })
    df = df.withColumns({
        "_names": F.transform("_species", lambda s: F.regexp_extract(s, SPECIES_PATTERN, 1)),
        "_coefs": F.transform(F.slice("_tail", 1, F.greatest(F.size("_tail") - 2, F.lit(0))), to_number),
        "_mark": F.try_element_at("_tail", F.lit(-2)),
        "reference": to_number(F.try_element_at("_tail", F.lit(-1))),
    })
    pairs = F.arrays_zip("_names", "_coefs")
    merged = F.transform(F.array_distinct("_names"), lambda n: F.struct(
        n.alias("structure_id"),
        F.aggregate(F.filter(pairs, lambda p: p["_names"] == n), F.lit(0.0), lambda a, p: a + p["_coefs"]).alias("coefficient")))
    df = df.withColumn("terms", F.filter(merged, lambda t: t["coefficient"] != 0))
    problem = (
        F.when(~F.col("_w")[0].isin(*ROW_MARKS) | ~one | F.col("source_line").rlike("[\"'\\\\]"), "unsupported grammar")
        .when(F.exists("_names", lambda n: (n == "") | n.contains("..")), "unsupported species token")
        .when((F.size("_coefs") != F.size("_names")) | ~is_true(F.col("_mark").isin(*WEIGHT_MARKS)), "coefficient count mismatch")
        .when(F.exists("_coefs", lambda c: c.isNull()) | F.col("reference").isNull(), "not a number")
        .when(F.size("terms") < 2, "degenerate row")
    )
    df = df.withColumn("problem", problem)
    good = F.col("problem").isNull()
    return settle(df.select(*keys, "source_line", F.when(good, F.col("terms")).alias("terms"),
                            F.when(good, F.col("reference")).alias("reference"), "problem"))


def reaction_observables(parsed: DataFrame, subset: str, kind: str = "barrier", order_by: str = "line") -> DataFrame:
    """Observables of one list: id from the data row, split group from the positive species, duplicates marked.

    Data rows are numbered from 1 in the order of ``order_by``.
    """
    numbered = running(parsed.withColumn("_one", F.lit(1)), order_by, sums={"_row": "_one"}, edges=value_edges(parsed, order_by))
    good = numbered.where(F.col("problem").isNull())
    terms = F.transform("terms", lambda t: F.struct(
        F.concat(F.lit(subset + ":"), t["structure_id"]).alias("structure_id"), t["coefficient"].alias("coefficient")))
    df = good.withColumn("terms", terms)
    positive = F.array_sort(F.transform(F.filter("terms", lambda t: t["coefficient"] > 0), lambda t: t["structure_id"]))
    df = df.select(
        F.format_string(f"{subset}:%03d", F.col("_row").cast("long")).alias("id"),
        F.concat(F.lit(f"{subset}:ts-"), F.substring(F.sha2(F.to_json(positive), 256), 1, 16)).alias("group_id"),
        F.lit(kind).alias("kind"), "terms",
        F.struct(
            F.col("reference").alias("value"), F.lit("kcal/mol").alias("unit"),
            F.lit("published reference list").alias("method"),
            F.concat(F.lit(f"{subset}#L"), F.col(order_by).cast("string")).alias("source"),
            F.lit("unreviewed").alias("quality"), F.lit(None).cast("double").alias("uncertainty"), F.lit("").alias("review_note"),
        ).alias("reference"),
        F.col(order_by).alias("source_row"),
    )
    return mark_duplicates(cut_lineage(df), order_by="source_row")


def attach_sidecars(geometries: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Geometries (species, …) with charge and multiplicity from (species, name, text) integer side files.

    Missing files (no row, or a NULL text) mean charge 0 and no unpaired electron; anything but an integer, or a
    negative count, is a ``sidecar_problem``.
    """
    sidecars = sidecars.where(F.col("text").isNotNull())
    number = F.when(F.trim("text").rlike(r"^[+-]?\d+$"), F.trim("text").try_cast("int"))
    per = sidecars.groupBy("species").agg(
        F.max(F.when(F.col("name") == ".CHRG", number)).alias("_charge"),
        F.max(F.when(F.col("name") == ".UHF", number)).alias("_unpaired"),
        F.count(F.when(number.isNull() | ((F.col("name") == ".UHF") & (number < 0)), 1)).alias("_bad"))
    return geometries.join(per, "species", "left").select(
        *geometries.columns,
        F.coalesce("_charge", F.lit(0)).alias("charge"), (F.coalesce("_unpaired", F.lit(0)) + 1).alias("multiplicity"),
        F.when(F.col("_bad") > 0, "invalid side file").alias("sidecar_problem"))


def subset_structures(parsed: DataFrame, geometries: DataFrame, sidecars: DataFrame, subset: str):
    """(structures, missing, rejects) of a parsed list that is read several times; see :func:`import_subset`."""
    named = cut_lineage(parsed.where(F.col("problem").isNull()).select(F.explode("terms.structure_id").alias("species")).distinct())
    described = attach_sidecars(geometries, sidecars)
    found = named.join(described, "species").withColumn("id", F.concat(F.lit(subset + ":"), F.col("species")))
    bad_rows = parsed.where(F.col("problem").isNotNull()).select(F.lit("row").alias("what"), F.col("source_line").alias("item"), "problem")
    bad_species = found.where(F.col("sidecar_problem").isNotNull()).select(
        F.lit("species").alias("what"), F.col("id").alias("item"), F.col("sidecar_problem").alias("problem"))
    structures = found.where(F.col("sidecar_problem").isNull()).select(
        "id", "symbols", "positions_angstrom", "charge", "multiplicity", "source")
    missing = named.join(geometries, "species", "left_anti").select(F.concat(F.lit(subset + ":"), F.col("species")).alias("id"))
    return structures, missing, bad_rows.unionByName(bad_species)


def import_subset(lines: DataFrame, geometries: DataFrame, sidecars: DataFrame, subset: str, kind: str = "barrier"):
    """(structures, observables, missing, rejects) of one reaction list.

    ``geometries``: (species, symbols, positions_angstrom, source).  Only species some row names are kept;
    ``missing`` lists named species without a geometry.  ``rejects`` (what, item, problem) holds every row outside
    the grammar and every named species with an invalid side file; such structures are not returned.
    """
    parsed = cut_lineage(parse_reaction_lines(lines))
    structures, missing, rejects = subset_structures(parsed, geometries, sidecars, subset)
    return structures, reaction_observables(parsed, subset, kind), missing, rejects
