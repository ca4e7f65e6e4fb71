"""Geometry texts to and from (symbols, positions) as native expressions; bad files keep a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_true
from ..records import ANGSTROM_PER_BOHR
from .text import lines_of, to_number, words_of


def _coordinates(words: Column, first: int, scale: Column) -> Column:
    """n x 3 array from token arrays, starting at 1-based token ``first``."""
    return F.transform(words, lambda w: F.transform(F.slice(w, first, 3), lambda t: to_number(t) * scale))


def _complete(positions: Column) -> Column:
    return F.forall(positions, lambda p: F.forall(p, lambda v: v.isNotNull()))


def parse_xyz(files: DataFrame) -> DataFrame:
    """(path, symbols, positions_angstrom, problem) from XYZ texts: count, comment, one atom per line."""
    lines = lines_of("text")
    df = files.select("path", lines.alias("_lines")).withColumn("_n", F.trim(F.element_at("_lines", 1)).try_cast("int"))
    df = df.withColumns({
        "_words": F.when(F.col("_n") >= 1, F.transform(F.slice("_lines", 3, F.greatest(F.col("_n"), F.lit(0))), words_of)),
        "_rest": F.when(F.col("_n") >= 1, F.slice("_lines", F.col("_n") + 3, F.size("_lines"))),
    }).withColumn("_pos", _coordinates(F.col("_words"), 2, F.lit(1.0)))
    problem = (
        F.when(F.size("_lines") < 3, "too short")
        .when(F.col("_n").isNull(), "first line is not an atom count")
        .when((F.col("_n") < 1) | (F.size("_lines") < F.col("_n") + 2) | ~F.forall("_rest", lambda l: F.trim(l) == ""),
              "atom count mismatch or several frames")
        .when(~F.forall("_words", lambda w: F.size(w) == 4), "an atom line needs four columns")
        .when(~is_true(_complete(F.col("_pos"))), "a coordinate is not a number")
    )
    return _result(df.withColumn("problem", problem), F.transform("_words", lambda w: w[0]))


def parse_coord_block(files: DataFrame) -> DataFrame:
    """Same result from texts with one ``$coord`` block (bohr unless marked ``angs``), element last."""
    block = F.regexp_extract("text", r"(?ims)^\s*\$coord[^\n]*\n(.*?)(?=^\s*\$|\z)", 1)
    header = F.regexp_extract("text", r"(?im)^\s*\$coord\S*[ \t]*([^\r\n]*)", 1)
    useful = F.filter(lines_of(block), lambda l: (F.trim(l) != "") & ~F.trim(l).startswith("#"))
    df = files.select("path", F.regexp_count("text", F.lit(r"(?im)^\s*\$coord")).alias("_blocks"),
                      F.lower(F.trim(header)).alias("_unit"), F.transform(useful, words_of).alias("_words"))
    scale = F.when(F.col("_unit") == "angs", 1.0).otherwise(F.lit(ANGSTROM_PER_BOHR))
    df = df.withColumn("_pos", _coordinates(F.col("_words"), 1, scale))
    problem = (
        F.when(F.col("_blocks") != 1, "exactly one coordinate block is required")
        .when(~F.col("_unit").isin("", "angs", "bohr"), "unsupported coordinate unit")
        .when(F.size("_words") == 0, "empty coordinate block")
        .when(~F.forall("_words", lambda w: F.size(w) == 4), "an atom line needs four columns")
        .when(~is_true(_complete(F.col("_pos"))), "a coordinate is not a number")
    )
    return _result(df.withColumn("problem", problem), F.transform("_words", lambda w: F.initcap(w[3])))


def _result(df: DataFrame, symbols: Column) -> DataFrame:
    good = F.col("problem").isNull()
    return df.select("path", F.when(good, symbols).alias("symbols"),
                     F.when(good, F.col("_pos")).alias("positions_angstrom"), "problem")


def render_xyz(structures: DataFrame) -> DataFrame:
    """(id, text): XYZ text of every structure."""
    pairs = F.arrays_zip("symbols", "positions_angstrom")
    atoms = F.transform(pairs, lambda a: F.concat_ws(
        " ", a["symbols"], *[a["positions_angstrom"][i].cast("string") for i in range(3)]))
    title = F.format_string("%s charge=%d multiplicity=%d", "id", "charge", "multiplicity")
    return structures.select("id", F.concat(F.concat_ws(
        "\n", F.size("symbols").cast("string"), title, F.concat_ws("\n", atoms)), F.lit("\n")).alias("text"))


def interpolate_pairs(pairs: DataFrame, images: int = 7, minimum_distance: float = 0.1) -> DataFrame:
    """Linear images between ``start`` and ``end`` structures (structs of the structure schema).

    One row per (pair_id, image): positions, or ``problem`` for incompatible endpoints and close nuclei.
    ``mapping_verified`` must be true: atom order is never guessed.
    """
    if images < 3 or minimum_distance <= 0:
        raise ValueError("at least three images and a positive distance are needed")
    a, b = F.col("start"), F.col("end")
    t = F.col("image") / F.lit(float(images - 1))
    moved = F.zip_with(a["positions_angstrom"], b["positions_angstrom"],
                       lambda p, q: F.zip_with(p, q, lambda x, y: (1 - t) * x + t * y))
    same = (a["symbols"] == b["symbols"]) & (a["charge"] == b["charge"]) & (a["multiplicity"] == b["multiplicity"])
    df = pairs.withColumn("image", F.explode(F.sequence(F.lit(0), F.lit(images - 1)))).withColumn("_same", same)
    df = df.withColumn("_pos", F.when(F.col("_same"), moved))
    atoms = F.col("_pos")

    def gap(p: Column, q: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))

    # inside one record: nearest later atom of every atom
    nearest = F.array_min(F.transform(atoms, lambda p, i: F.array_min(
        F.transform(F.slice(atoms, i + 2, F.size(atoms)), lambda q: gap(p, q)))))
    df = df.withColumn("closest", nearest)
    problem = (
        F.when(~is_true(F.col("mapping_verified")), "atom mapping not verified")
        .when(~is_true(F.col("_same")), "endpoints differ in atoms, charge or multiplicity")
        .when(F.col("closest") < minimum_distance, "image has close or coincident nuclei")
    )
    return df.withColumn("problem", problem).select(
        "pair_id", "image", F.when(F.col("problem").isNull(), atoms).alias("positions_angstrom"), "closest", "problem")
