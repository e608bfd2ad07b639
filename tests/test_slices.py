"""Sliced windows equal plain windows, whatever the slice borders."""

import pandas as pd
import pytest
from conftest import at
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seawake.functions.geo import seconds
from seawake.plans.sliced import asof_around, asof_within, chain, link_within, number_runs, running_sum, time_slice

TIMES = [0, 10, 59, 60, 61, 119, 120, 300, 301, 302, 900, 1000, 1001, 4000]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, at(t + 7 * k), float(t)) for k in (1, 2) for t in TIMES]
    return spark.createDataFrame(data, "k long, ts timestamp, v double")


@pytest.mark.parametrize("slice_s", [1, 60, 10_000])
def test_chain_equals_plain_window(rows, slice_s):
    w = W.partitionBy("k").orderBy("ts")
    step = lambda a, b: b["v"] - a["v"]
    got = chain(rows, ["k"], ["ts"], ["ts", "v"], time_slice("ts", slice_s), {"way": step})
    got = got.select("k", "ts", "prev.v", F.col("next.v").alias("n"), "way", "way_before", "way_total")
    want = rows.select(
        "k", "ts", F.lag("v").over(w).alias("v"), F.lead("v").over(w).alias("n"), F.col("v").alias("way"),
        F.coalesce(F.lag("v").over(w), F.lit(0.0)).alias("way_before"), F.lit(4000.0).alias("way_total"),
    )
    key = ["k", "ts"]
    pd.testing.assert_frame_equal(
        got.toPandas().sort_values(key, ignore_index=True), want.toPandas().sort_values(key, ignore_index=True)
    )


@pytest.mark.parametrize("reach", [1, 59, 60, 600])
@pytest.mark.parametrize("slices", [1, 3])
def test_link_within(rows, reach, slices):
    w = W.partitionBy("k").orderBy("ts")
    got = link_within(rows, ["k"], "ts", ["ts", "v"], reach, slices).select("k", "v", F.col("prev.v").alias("p"), F.col("next.v").alias("n"))
    far = lambda other: F.abs(F.col("v") - other) > reach
    lag, lead = F.lag("v").over(w), F.lead("v").over(w)
    want = rows.select("k", "v", F.when(~far(lag), lag).alias("p"), F.when(~far(lead), lead).alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_number_runs_and_running_sum(rows):
    linked = link_within(rows, ["k"], "ts", ["ts", "v"], 60)
    runs = number_runs(linked, ["k"], ["ts"], F.col("prev").isNull(), "run").where("k = 1").orderBy("ts")
    # a gap of exactly 60 seconds does not break: 301 follows 300, 1000 is 100 after 900
    assert [r["run"] for r in runs.collect()] == [1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 3, 4, 4, 5]
    total = running_sum(rows, ["k"], ["ts"], {"s": F.col("v")}, time_slice("ts", 100)).where("k = 2").orderBy("ts")
    assert [r["s"] for r in total.collect()] == list(pd.Series(TIMES, dtype=float).cumsum())


def test_asof(spark, rows):
    asked = [0, 5, 58, 60, 299, 1500, 3999, 9000]
    q = spark.createDataFrame([(1, at(t + 7)) for t in [-5, *asked]], "k long, ts timestamp")
    back = lambda t, reach: max((x for x in TIMES if t - reach <= x <= t), default=None)
    got = asof_within(q, rows, ["k"], "ts", "ts", ["v"], 100, slices=2).select(seconds("ts").alias("t"), "hit.v")
    base = at(7).timestamp()
    assert {r["t"] - base: r["v"] for r in got.collect()} == {t: back(t, 100) for t in [-5, *asked]}
    both = asof_around(q, rows, ["k"], "ts", "ts", ["v"], slice_s=50).select(
        seconds("ts").alias("t"), F.col("hit.v").alias("h"), F.col("ahead.v").alias("a")
    )
    want = {t: (back(t, 1e9), min((x for x in TIMES if x > t), default=None)) for t in [-5, *asked]}
    assert {r["t"] - base: (r["h"], r["a"]) for r in both.collect()} == want
