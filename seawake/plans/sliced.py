"""Ordered per-key computations that do not need a key to fit in one task.

A plain ``Window.partitionBy('mmsi')`` puts a whole vessel into one task, so one busy
vessel (or one garbage identifier) sets the run time of the job.  Here every key is cut
into slices, by default one hour of event time.  Rows are shuffled by (key, slice),
the window runs inside a slice, and one summary row per slice carries state across
slice borders:

    rows      -> Exchange(key, slice) -> Window ------------------+-> join -> result
                                           \\-> slice edges         |
                                                -> Exchange(key)   |
                                                -> Window ---------+

Only the summary is gathered per key: at most one row per hour and key.  The join adds
no shuffle on the row side, which is already partitioned by (key, slice).  Keys must be
non-NULL (the join back uses plain equality).

Where only neighbours within a known time matter (a gap ends a trip), ``link_within`` and
``asof_within`` need no summary at all: rows near a slice border are copied across it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SLICE_S = 3600

Step = Callable[[Column, Column], Column]


def time_slice(ts: Column | str, slice_s: int = SLICE_S) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c) / F.lit(slice_s * 1_000_000))


def link_within(
    df: DataFrame, keys: Sequence[str], ts: str, payload: Sequence[str], reach_s: float, slices: int = 12
) -> DataFrame:
    """Neighbours that are at most ``reach_s`` away, in one pass and without a join.

    Adds ``slice`` and the structs ``prev`` and ``next`` of the ``payload`` (which must hold ``ts``) of
    the adjacent rows, NULL when they are farther than ``reach_s``.  Such a neighbour is in the
    same slice or just across its border, so rows near a border are also copied to the slice
    behind it; with slices of ``slices * reach_s`` that is a small share.
    """
    keys = list(keys)
    reach, width = F.lit(int(reach_s * 1_000_000)), F.lit(int(reach_s * slices * 1_000_000))
    us = F.unix_micros(ts)
    row = F.struct(*payload)
    d = df.withColumn("_own", F.floor(us / width)).withColumn(
        "slice", F.explode(F.sequence(F.floor((us - reach) / width), F.floor((us + reach) / width)))
    )
    w = W.partitionBy(*keys, "slice").orderBy(ts)
    d = d.withColumn("_p", F.lag(row).over(w)).withColumn("_n", F.lead(row).over(w)).where("slice = _own")
    return (
        d.withColumn("prev", F.when(us - F.unix_micros(F.col("_p")[ts]) <= reach, F.col("_p")))
        .withColumn("next", F.when(F.unix_micros(F.col("_n")[ts]) - us <= reach, F.col("_n")))
        .drop("_own", "_p", "_n")
    )


def number_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, name: str) -> DataFrame:
    """Number rows 1, 1, 2, … per key, one up at every row where ``starts`` holds; needs ``slice``."""
    return running_sum(df, keys, order, {name: starts.cast("long")}, "slice")


def chain(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    slice_by: Column,
    steps: dict[str, Step] | None = None,
) -> DataFrame:
    """Link every row to its neighbours within ``keys``, however far they are.

    Adds ``slice`` and the structs ``prev`` and ``next`` of the ``payload`` columns of the adjacent
    rows.  For each of ``steps`` it adds the sum of ``step(prev, row)`` from the first row of
    the key up to this one (``name``), up to the row before (``name_before``, bit for bit
    that row's value), and over the whole key (``name_total``).
    """
    keys, steps = list(keys), steps or {}
    row = F.struct(*payload)
    w = W.partitionBy(*keys, "slice").orderBy(*order)
    d = (
        df.withColumn("slice", slice_by)
        .withColumn("_p", F.lag(row).over(w))
        .withColumn("_n", F.lead(row).over(w))
    )
    for name, step in steps.items():
        inner = F.when(F.col("_p").isNotNull(), step(F.col("_p"), row)).otherwise(F.lit(0.0))
        d = d.withColumn("_s", inner).withColumn(
            f"_c_{name}", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
        )
        d = d.withColumn(f"_l_{name}", F.lag(f"_c_{name}").over(w)).drop("_s")

    at = lambda border, value: F.first(F.when(F.col(border).isNull(), value), ignorenulls=True)
    edges = (
        d.where(F.col("_p").isNull() | F.col("_n").isNull())
        .groupBy(*keys, "slice")
        .agg(
            at("_p", row).alias("_head"),
            at("_n", row).alias("_tail"),
            *[at("_n", F.col(f"_c_{n}")).alias(f"_t_{n}") for n in steps],
        )
    )
    we = W.partitionBy(*keys).orderBy("slice")
    edges = edges.withColumn("_pt", F.lag("_tail").over(we)).withColumn("_nh", F.lead("_head").over(we))
    carried = ["_pt", "_nh"]
    for name, step in steps.items():
        cross = F.when(F.col("_pt").isNotNull(), step(F.col("_pt"), F.col("_head"))).otherwise(F.lit(0.0))
        edges = (
            edges.withColumn("_s", cross + F.lag(f"_t_{name}", 1, 0.0).over(we))
            .withColumn(f"_b_{name}", F.sum("_s").over(we.rowsBetween(W.unboundedPreceding, W.currentRow)))
            .withColumn("_s", F.col(f"_b_{name}") + F.col(f"_t_{name}"))
            .withColumn(f"_e_{name}", F.lag("_s", 1, 0.0).over(we))
            .withColumn(f"{name}_total", F.max("_s").over(W.partitionBy(*keys)))
            .drop("_s")
        )
        carried += [f"_b_{name}", f"_e_{name}", f"{name}_total"]
    out = d.join(edges.select(*keys, "slice", *carried), [*keys, "slice"])
    for name in steps:
        before = F.when(F.col("_p").isNull(), F.col(f"_e_{name}")).otherwise(F.col(f"_b_{name}") + F.col(f"_l_{name}"))
        out = out.withColumn(name, F.col(f"_b_{name}") + F.col(f"_c_{name}")).withColumn(f"{name}_before", before)
    out = out.withColumn("prev", F.coalesce("_p", "_pt")).withColumn("next", F.coalesce("_n", "_nh"))
    return out.drop("_p", "_n", "_pt", "_nh", *[f"{x}{n}" for n in steps for x in ("_c_", "_l_", "_b_", "_e_")])


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], slice_by: Column | str
) -> DataFrame:
    """Inclusive running sums per key; ``values`` maps result name to summand.

    ``slice_by`` is an expression, or the name of a slice column the rows are already
    partitioned by.
    """
    keys = list(keys)
    sl = slice_by if isinstance(slice_by, str) else "_sl"
    d = df if isinstance(slice_by, str) else df.withColumn(sl, slice_by)
    w = W.partitionBy(*keys, sl).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    for name, value in values.items():
        d = d.withColumn(f"_v_{name}", value)
    totals = d.groupBy(*keys, sl).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    we = W.partitionBy(*keys).orderBy(sl).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *keys, sl, *[F.coalesce(F.sum(f"_t_{n}").over(we), F.lit(0)).alias(f"_b_{n}") for n in values]
    )
    for name in values:
        d = d.withColumn(f"_s_{name}", F.sum(f"_v_{name}").over(w))
    out = d.join(totals, [*keys, sl])
    for name in values:
        out = out.withColumn(name, F.col(f"_s_{name}") + F.col(f"_b_{name}"))
    return out.drop("_sl", *[f"{p}{n}" for n in values for p in ("_v_", "_s_", "_b_")])


def _union_in_time(queries, facts, keys, query_ts, fact_ts, payload) -> DataFrame:
    """Facts (``_hit``) and queries (``_q``) as one frame with time ``_t``; facts sort first at equal times."""
    asked = F.struct(*[c for c in queries.columns if c not in keys])
    f = facts.select(*keys, F.col(fact_ts).alias("_t"), F.lit(0).alias("_kind"), F.struct(*payload).alias("_hit"))
    q = queries.select(*keys, F.col(query_ts).alias("_t"), F.lit(1).alias("_kind"), asked.alias("_q"))
    return f.unionByName(q, allowMissingColumns=True)


def asof_within(
    queries: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    query_ts: str,
    fact_ts: str,
    payload: Sequence[str],
    reach_s: float,
    slices: int = 12,
) -> DataFrame:
    """For each query row the last fact of the key at or before it, at most ``reach_s`` back, as ``hit``.

    A union and a running ``last`` replace the inequality join.  Facts near the end of a slice
    are copied to the next one, so one pass suffices.
    """
    keys = list(keys)
    reach, width = F.lit(int(reach_s * 1_000_000)), F.lit(int(reach_s * slices * 1_000_000))
    us = F.unix_micros("_t")
    last = F.floor((us + F.when(F.col("_kind") == 0, reach).otherwise(F.lit(0))) / width)
    u = _union_in_time(queries, facts, keys, query_ts, fact_ts, [*payload, F.col(fact_ts).alias("_at")])
    u = u.withColumn("_sl", F.explode(F.sequence(F.floor(us / width), last)))
    w = W.partitionBy(*keys, "_sl").orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, 0)
    d = u.withColumn("hit", F.last("_hit", ignorenulls=True).over(w)).where("_kind = 1")
    near = us - F.unix_micros("hit._at") <= reach
    return d.select(*keys, "_q.*", F.when(near, F.col("hit")).alias("hit"))


def asof_around(
    queries: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    query_ts: str,
    fact_ts: str,
    payload: Sequence[str],
    slice_s: int = SLICE_S,
) -> DataFrame:
    """For each query row the last fact at or before it (``hit``) and the first after it (``ahead``).

    However far they are: the facts around a slice are carried over from its summary.
    """
    keys = list(keys)
    u = _union_in_time(queries, facts, keys, query_ts, fact_ts, payload)
    u = u.withColumn("_sl", time_slice("_t", slice_s))
    run = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    by = W.partitionBy(*keys, "_sl")
    up, down = by.orderBy("_t", "_kind"), by.orderBy(F.desc("_t"), F.desc("_kind"))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    d = u.withColumn("_in", last("_hit", run(up))).withColumn("_out", last("_hit", run(down)))
    edges = d.groupBy(*keys, "_sl").agg(
        F.max(F.when(F.col("_kind") == 0, F.struct("_t", "_hit"))).alias("_z"),
        F.min(F.when(F.col("_kind") == 0, F.struct("_t", "_hit"))).alias("_a"),
    )
    we = W.partitionBy(*keys)
    edges = edges.select(
        *keys,
        "_sl",
        last("_z", we.orderBy("_sl").rowsBetween(W.unboundedPreceding, -1)).alias("_z"),
        last("_a", we.orderBy(F.desc("_sl")).rowsBetween(W.unboundedPreceding, -1)).alias("_a"),
    )
    out = d.where("_kind = 1").join(edges, [*keys, "_sl"])
    return out.select(
        *keys, "_q.*", F.coalesce("_in", "_z._hit").alias("hit"), F.coalesce("_out", "_a._hit").alias("ahead")
    )
