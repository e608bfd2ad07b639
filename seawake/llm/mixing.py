"""Mixing sources by temperature, in DataFrame functions only.

The token share of a source is raised to an exponent - 0 makes all sources alike, 1 leaves them as they
are, more sharpens them - and normalised.  The exponent is bisected - a grid of them per round, each judged
by one aggregate over the table of sources - to the one that meets a target entropy; where that would repeat
a source more often than allowed, to the nearest one that does not.  Where no exponent meets the target, as
with sources all alike, the shares stay as they are and a warning says so.

A weight is realised as whole epochs and a part of one.  Documents have a place in a permutation, a
seeded hash; its leading bits are the block, so blocks come in permuted order and a document's place
within its block is permuted too.  The partial epoch takes blocks in order while the source's budget
lasts: sums per block say in which block it ends, and only the documents of that block are sorted.
No source has to fit a task, whatever its share.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seawake.llm.common import stored
from seawake.plans.joins import sized_broadcast

BLOCK_BITS = 12
GRID, ROUNDS = 32, 5
#: exponents above 1 that bracket the one sought, up to about 1600
SHARPER = [2 ** (i / 3) for i in range(GRID + 1)]


@dataclass(frozen=True)
class Recipe:
    """What a mix shall meet.

    ``entropy``: target entropy of the weights, as a share of that of equal weights.
    ``repeats``: how many epochs of a source are allowed at most.
    ``budget``: tokens of the mix; None for the least budget at which every source gets a whole epoch.
    """

    entropy: float = 0.95
    repeats: float = 4.0
    budget: int | None = None
    seed: int = 1


def word_tokens(text: str = "text") -> Column:
    """Words between ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: str = "source") -> Column:
    """The source as a join key that tells NULL from every name."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _place(seed: int) -> Column:
    """A document's place in the permutation, 0 to 2**63 - 1.  Rows alike in id and text share it."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))), 1)


def _judged(sources: DataFrame, top: float, alphas: list[float]) -> list:
    """For each exponent: entropy, and the most and least epochs per token of budget.  Powers are of shares of ``top``."""
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))
    x = sources.select("share", grid.alias("alpha")).withColumn("x", F.pow(F.col("share") / F.lit(top), F.col("alpha")))
    sums = x.groupBy("alpha").agg(
        F.sum("x").alias("z"),
        F.sum(F.col("x") * F.log("x")).alias("xlx"),
        F.max(F.col("x") / F.col("share")).alias("most"),
        F.min(F.col("x") / F.col("share")).alias("least"),
    )
    return sums.orderBy("alpha").collect()


def _between(lo: float, hi: float) -> list[float]:
    return [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]


def exponent(sources: DataFrame, recipe: Recipe, tokens: int) -> tuple[float, float, float, float]:
    """(exponent, sum of the powers, budget, greatest share) for ``sources (key, tokens, share)`` with ``tokens`` in all."""
    n, top, low = sources.agg(F.count("*"), F.max("share"), F.min("share")).first()

    def budget(r) -> float:
        if recipe.budget is not None:
            return float(recipe.budget)
        return tokens * r["z"] / r["least"] if r["least"] else math.inf

    def even(r) -> bool:
        return math.log(r["z"]) - r["xlx"] / r["z"] > recipe.entropy * math.log(max(n, 1)) + 1e-12

    def often(r) -> bool:
        return budget(r) / tokens * r["most"] / r["z"] > recipe.repeats + 1e-9

    # up to 1 entropy and repetition fall as the exponent grows: the least that fits
    alphas = _between(0.0, 1.0)
    for _ in range(ROUNDS):
        rows = _judged(sources, top, alphas)
        first = next((i for i, r in enumerate(rows) if not even(r) and not often(r)), len(rows) - 1)
        chosen = rows[first]
        if first == 0:
            break
        alphas = _between(rows[first - 1]["alpha"], chosen["alpha"])

    # beyond 1 entropy falls and repetition grows: the least that meets the target, or the last before one too often
    if chosen["alpha"] == 1.0 and even(chosen) and not often(chosen):
        natural, alphas = chosen, SHARPER
        for _ in range(ROUNDS if low < top else 0):
            rows = _judged(sources, top, alphas)
            first = next((i for i, r in enumerate(rows) if not even(r) or often(r)), 0)
            if first == 0:
                break
            chosen = rows[first - 1] if often(rows[first]) else rows[first]
            alphas = _between(rows[first - 1]["alpha"], rows[first]["alpha"])
        if chosen is natural:
            warnings.warn(f"no exponent brings the entropy of {n} sources down to {recipe.entropy}; their shares stay as they are", stacklevel=2)
    return chosen["alpha"], chosen["z"], budget(chosen), top


def plan_mix(docs: DataFrame, recipe: Recipe, tokens: Column) -> DataFrame:
    """Per source: ``key, tokens, weight, epochs, cutoff``.

    A document gets ``epochs`` copies, and one more if its place is at most ``cutoff``.
    """
    slim = stored(
        docs.select(source_key().alias("key"), tokens.alias("tokens"), _place(recipe.seed).alias("place")), "mixing"
    )
    sums = slim.groupBy("key").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    total = sums.agg(F.sum("tokens").alias("t")).first()["t"]
    if not total:
        return sums.select("key", "tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("epochs"), F.lit(-1).cast("long").alias("cutoff"))
    sources = stored(sums.withColumn("share", F.col("tokens") / F.lit(float(total))), "mixing-sources")
    alpha, z, budget, top = exponent(sources, recipe, total)
    weighted = sources.withColumn("weight", F.pow(F.col("share") / F.lit(top), F.lit(alpha)) / F.lit(z))
    rate = F.col("weight") * F.lit(budget) / F.col("tokens")
    goal = weighted.withColumn("epochs", F.floor(rate + 1e-9).cast("long"))
    goal = goal.withColumn("rest", F.greatest(F.col("weight") * F.lit(budget) - F.col("epochs") * F.col("tokens"), F.lit(0.0)))

    # the block in which the partial epoch ends, and what is taken before it
    block = F.shiftrightunsigned("place", 63 - BLOCK_BITS).cast("int")
    blocks = slim.withColumn("block", block).groupBy("key", "block").agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, 0))
    ends = blocks.withColumn("upto", upto).join(goal.select("key", "rest"), "key").where("upto >= rest")
    ends = ends.groupBy("key").agg(F.min(F.struct("block", (F.col("upto") - F.col("n")).alias("before"), "rest")).alias("e"))
    ends = stored(ends.select("key", "e.*"), "mixing-blocks")
    last = slim.withColumn("block", block).join(ends, ["key", "block"])
    inside = F.sum("tokens").over(W.partitionBy("key").orderBy("place").rangeBetween(W.unboundedPreceding, 0))
    taken = last.withColumn("upto", F.col("before") + inside).where("upto <= rest").groupBy("key").agg(F.max("place").alias("at"))
    start = F.shiftleft(F.col("block").cast("long"), 63 - BLOCK_BITS) - 1
    cut = ends.join(taken, "key", "left").select("key", F.coalesce("at", start).alias("cutoff"))
    out = goal.join(cut, "key", "left").select("key", "tokens", "weight", "epochs", F.coalesce("cutoff", F.lit(-1)).alias("cutoff"))
    return stored(out, "mixing-plan")


def mix(docs: DataFrame, recipe: Recipe = Recipe(), tokens: Column | None = None) -> DataFrame:
    """The documents of the mix: all columns, and ``epoch, block, place, weight``.

    Each copy of a document has its ``epoch`` (from 0), the ``block`` of that epoch's permutation and
    its ``place`` in it; ordering by the three gives the realised sequence.  Columns of those names are
    replaced.  A NULL source is a source of its own.  Sources without any token have no weight: their
    documents come once.  Rows alike in id and text are taken together.  An empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("epoch", "block", "place", "weight")]
    plan = plan_mix(docs, recipe, word_tokens() if tokens is None else tokens)
    side = sized_broadcast(plan.select("key", "weight", "epochs", "cutoff"))
    # the given columns travel in one, so that none can clash with those of the plan
    placed = docs.select(F.struct(*names).alias("row"), source_key().alias("_key"), _place(recipe.seed).alias("_place"))
    joined = placed.join(side, placed["_key"] == side["key"], "left")
    extra = F.when(F.col("_place") <= F.col("cutoff"), 1).otherwise(0)
    copies = F.coalesce((F.col("epochs") + extra).cast("int"), F.lit(1))
    dealt = joined.withColumn("_n", copies).where("_n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    # a whole epoch has a permutation of its own, the partial one that of the plan
    own = F.shiftrightunsigned(F.xxhash64("epoch", "_place"), 1)
    place = F.when(F.col("epoch") == F.col("epochs"), F.col("_place")).otherwise(own)
    return dealt.withColumn("place", place).select(
        "row.*",
        "epoch",
        F.shiftrightunsigned("place", 63 - BLOCK_BITS).cast("int").alias("block"),
        "place",
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
    )
