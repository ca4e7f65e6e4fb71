"""Lines, words and numbers of texts: what patterns say, without a pattern where a plain function does."""

import itertools
import re

from pyspark.sql import functions as F

from tierlens.sources.text import NUMBER, lines_of, to_number, words_of


def test_lines_words_numbers_are_those_of_the_patterns(spark):
    texts = ["".join(x) for n in range(6) for x in itertools.product("a\r\n", repeat=n)]
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines_of("t").alias("x")).collect()}
    assert got == {t: re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", t)) for t in texts}

    lines = ["".join(x) for n in range(6) for x in itertools.product("a \t\x0b", repeat=n)]
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in lines], "t string").select("t", words_of(F.col("t")).alias("x")).collect()}
    assert got == {t: re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ").split(" ") for t in lines}

    tokens = ["".join(x) for n in range(6) for x in itertools.product("1.-eD", repeat=n)]
    tokens += ["nan", "NaN", "inf", "Infinity", "-Infinity", "1f", "1d", "1D", "0x1p3", "1_0", " 1", "1\x00", "+.5d-2", "１", "1e400", "1L"]
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", to_number(F.col("t")).alias("x")).collect()}
    assert got == {t: float(re.sub("[Dd]", "E", t)) if re.fullmatch(NUMBER, t, re.ASCII) else None for t in tokens}


def test_lines_are_split_without_patterns(spark):
    plan = spark.createDataFrame([("a\n",)], "t string").select(lines_of("t"))._jdf.queryExecution().analyzed().toString()
    assert "regexp" not in plan and "\\r?" not in plan
