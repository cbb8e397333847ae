import math
import random

import pytest
from pyspark.sql import functions as F

from optara.functions import exact
from optara.functions.schedule import schedule


def py_fmt(v):
    return f"{v:.0f}" if v >= 100 else f"{v:.1f}".rstrip("0").rstrip(".")


def test_tenths_match_exact_rounding(spark):
    rng = random.Random(1)
    values = [k / 20 for k in range(0, 4000)] + [rng.random() * 5000 for _ in range(3000)] + [math.nextafter(k / 20, d) for k in range(1, 2000) for d in (0, 9e9)] + [0.25, 0.15, 0.35, 0.05, 0.45, 0.04, 99.95, 99.949999, 100.5, 101.5, -0.04, -1.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", exact.round1(F.col("v")).alias("r"), exact.fmt(F.col("v")).alias("t"), exact.printed(F.col("v")).alias("p"), exact.fmt_all(F.array("v"))[0].alias("a")).collect()
    for r in got:
        assert r["r"] == round(r["v"], 1) and r["t"] == r["a"] == py_fmt(r["v"]) and r["p"] == float(py_fmt(r["v"])), r


def test_percent_and_plain(spark):
    df = spark.createDataFrame([(0.98773, 3.0), (0.5, 0.0), (1.0, 2.5), (None, 900.0), (0.0005, 1.0)], "a double, b double")
    got = df.select(exact.percent(F.col("a")), exact.fmt_plain(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("98.8", "3"), ("50.0", "0"), ("100.0", "2.5"), ("", "900"), (f"{0.05:.1f}", "1")]


@pytest.mark.parametrize("hits,n,want", [(2861, 3000, 0.9455), (2975, 3000, 0.9877), (2906, 3000, 0.9618), (0, 0, 0.0), (0, 10, 0.0)])
def test_wilson(spark, hits, n, want):
    got = spark.range(1).select(exact.wilson_lower(F.lit(hits), F.lit(n))).first()[0]
    assert round(got, 4) == want


def test_wilson_published_value(spark):
    assert spark.range(1).select(exact.wilson_lower(F.lit(2975), F.lit(3000))).first()[0] == pytest.approx(0.9877267647794391, abs=1e-15)


def test_numbers(spark):
    cases = {"1e3": 1000.0, " 1.5 ": 1.5, "1_000": 1000.0, "1.5f": None, "1.5d": None, "nan": None, "": None, "abc": None, "-.5": -0.5, "5.": 5.0, "inf": math.inf, "-Infinity": -math.inf, "1 2": None, "_1": None, "0x1": None, "1e": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: r[1] for r in df.select("t", exact.to_number(F.col("t"))).collect()}
    assert got == cases


def test_draws_do_not_depend_on_partitions(spark):
    one = spark.range(500, numPartitions=1).select("id", exact.draw(F.lit(7), F.col("id").cast("string")).alias("u"))
    many = spark.range(500, numPartitions=9).select("id", exact.draw(F.lit(7), F.col("id").cast("string")).alias("u"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    u = [r["u"] for r in one.collect()]
    assert 0.4 < sum(u) / len(u) < 0.6 and 0 <= min(u) and max(u) < 1


def test_schedule(spark):
    got = {r["id"]: r["r"] for r in spark.range(1001).select("id", schedule(F.col("id"), 1000, 100).alias("r")).where("id in (0, 100, 1000)").collect()}
    assert got[0] == pytest.approx(0.01) and got[100] == pytest.approx(1.0) and got[1000] == pytest.approx(0.1)
    assert spark.range(1).select(schedule(F.lit(5), 10, 0)).first()[0] == 1.0
