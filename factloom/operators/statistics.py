"""Paired comparisons, exact tests and dominance."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.staging import dropped, staged


def paired(control: DataFrame, treatment: DataFrame, key: str, value: str) -> DataFrame:
    """key, control, treatment: both arms side by side. An id that one arm lacks raises, as a missing case is no tie."""
    c, t = control.select(key, F.col(value).alias("control"), F.lit(True).alias("_c")), treatment.select(key, F.col(value).alias("treatment"), F.lit(True).alias("_t"))
    both = c.join(t, key, "full_outer")
    whole = F.when(F.col("_c").isNull() | F.col("_t").isNull(), F.raise_error(F.concat(F.lit("an arm lacks "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return both.filter(whole).select(key, "control", "treatment")


def _log_factorial(x: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(x, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X <= k) for n fair coins, as exp of sums of logs, so large n don't overflow."""
    return F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda s, i: s + F.exp(_log_factorial(n) - _log_factorial(i) - _log_factorial(n - i) - n * math.log(2)))


def sign_test(pairs: DataFrame, group: str, difference: Column) -> DataFrame:
    """wins, losses, p: the exact two-sided sign test over groups, by the sign of each group's summed difference; sums of
    zero drop out, and without any sign p is 1."""
    sums = pairs.groupBy(group).agg(F.sum(difference).alias("d"))
    signs = sums.agg(F.count_if(F.col("d") > 0).cast("int").alias("wins"), F.count_if(F.col("d") < 0).cast("int").alias("losses"))
    n = F.col("wins") + F.col("losses")
    p = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(F.least("wins", "losses"), n)))
    return signs.select("wins", "losses", p.alias("p"))


def sign_test_powers(cases: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``cases`` (groups, share) with ``power``: the chance that so many groups, each a win with that probability, give a
    significant two-sided sign test. Each possible number of wins is a row."""
    n = F.col("groups").cast("int")
    wins = cases.withColumn("_k", F.explode(F.sequence(F.lit(0), n))).withColumn("_p", F.least(F.lit(1.0), 2 * binomial_tail(F.least(F.col("_k"), n - F.col("_k")), n)))
    share, k = F.col("share"), F.col("_k")
    chance = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)) * F.pow(share, k) * F.pow(1 - share, n - k)
    return wins.groupBy("groups", "share").agg(F.coalesce(F.sum(F.when(F.col("_p") <= alpha, chance)), F.lit(0.0)).alias("power"))


def two_proportions(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column) -> Column:
    """z of the difference of two shares with a pooled variance; null where it has none."""
    pool = (hits_a + hits_b) / (n_a + n_b)
    return (hits_a / n_a - hits_b / n_b) / F.nullif(F.sqrt(pool * (1 - pool) * (1 / n_a + 1 / n_b)), F.lit(0.0))


def pareto(df: DataFrame, keys: list[str], more: str, less: str) -> DataFrame:
    """Rows that no row of the same keys dominates: none has at least as much of ``more`` for at most as much of ``less``
    and differs. One ordered pass over the best of each cost: it survives if it has more than all that cost less."""
    best = df.groupBy(*keys, less).agg(F.max(more).alias(more))
    cheaper = F.max(more).over(Window.partitionBy(*keys).orderBy(less).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_c", cheaper).filter(F.col("_c").isNull() | (F.col(more) > F.col("_c"))).drop("_c")
    return df.join(front, [*keys, less, more], "left_semi")


def verdict(pairs: DataFrame) -> DataFrame:
    """verdict over pairs (control, treatment, control_cost, treatment_cost): incomplete, then lost, gained, cheaper, keep."""
    x = pairs.agg(
        F.count_if(F.col("control").isNull() | F.col("treatment").isNull()).alias("missing"), F.count_if(F.col("control") & ~F.col("treatment")).alias("lost"), F.count_if(~F.col("control") & F.col("treatment")).alias("gained"),
        F.sum("control_cost").alias("c"), F.sum("treatment_cost").alias("t"),
    )
    ladder = F.when(F.col("missing") > 0, "incomplete").when(F.col("lost") > 0, "refuse").when(F.col("gained") > 0, "accept").when(F.col("t") < F.col("c"), "accept_cheaper").otherwise("keep")
    return x.select("missing", "lost", "gained", ladder.alias("verdict"))


def backed_off(rows: DataFrame, entity: str, family: str, tiers: list[list[str]], hits: str, tries: str) -> DataFrame:
    """``rows`` (sums ``hits`` and ``tries``) with tier, support and rate by the other entities: of the contexts ``tiers``, the most
    particular first, the first in which another entity has tried the row's family; tier is its place, null if there is none. What the
    others have is the context's sum less the entity's own, so no row meets another."""
    out, tier, support, hit = rows, F.lit(None).cast("int"), F.lit(0).cast("long"), F.lit(0).cast("long")
    for k, context in reversed(list(enumerate(tiers))):
        whole, own = Window.partitionBy(family, *context), Window.partitionBy(family, *context, entity)
        out = out.withColumn(f"_n{k}", F.sum(tries).over(whole) - F.sum(tries).over(own)).withColumn(f"_h{k}", F.sum(hits).over(whole) - F.sum(hits).over(own))
        some = F.col(f"_n{k}") > 0
        tier, support, hit = F.when(some, k).otherwise(tier), F.when(some, F.col(f"_n{k}")).otherwise(support), F.when(some, F.col(f"_h{k}")).otherwise(hit)
    out = out.withColumn("tier", tier).withColumn("support", support).withColumn("rate", F.when(support > 0, hit / support))
    return out.drop(*[f"_{c}{k}" for c in "nh" for k in range(len(tiers))])


#: Cuts of a group's values in each round.
_CUTS = 32


def order_statistic(df: DataFrame, keys: list[str], value: str, fraction: float, name: str) -> DataFrame:
    """``keys`` and ``name``: of each group's n values in order the one at place floor(n * fraction), from 0 (at most the last), exactly.
    The fraction is the decimal that it is written as, so 0.7 of 90 are 63 (62.99 as doubles). Nulls don't count; a group without
    values has no row.

    Each round cuts the values that are left by approximate quantiles and counts, exactly, how many are at each cut and between
    neighbours; then only those between the two around the place are left, or the cut is the value. No group is gathered."""
    rows = staged(df.select(F.struct(*keys).alias("g"), F.col(value).alias("v")).filter("v IS NOT NULL"))
    place = F.least(F.floor(F.col("n") * F.lit(Decimal(repr(fraction)))), F.col("n") - 1).cast("long")
    wanted = staged(rows.groupBy("g").agg(F.count("*").alias("n")).select("g", place.alias("k")))
    found = None
    while True:
        # the least and the greatest are cuts too, so that something is counted at a cut in every round
        cuts = rows.groupBy("g").agg(F.array_sort(F.array_distinct(F.concat(F.percentile_approx("v", [i / _CUTS for i in range(_CUTS + 1)], 1000), F.array(F.min("v"), F.max("v"))))).alias("cuts"))
        at = 2 * F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")
        binned = staged(rows.join(cuts, "g").select("g", "v", at.alias("at")))
        counts = binned.groupBy("g", "at").agg(F.count("*").alias("n"), F.min("v").alias("least"))  # twice the cuts a group at most
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("at"))
        here = counts.withColumn("upto", upto).join(wanted, "g").filter((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k")))
        here = staged(here.select("g", "at", "least", (F.col("k") - (F.col("upto") - F.col("n"))).alias("k")))
        hit = here.filter("at % 2 = 1").select("g.*", F.col("least").alias(name))
        found = hit if found is None else found.unionByName(hit)
        wanted = here.filter("at % 2 = 0").select("g", "k")
        after = staged(binned.join(here.filter("at % 2 = 0").select("g", "at"), ["g", "at"], "left_semi").select("g", "v"))
        dropped(binned)
        dropped(rows)
        if after.isEmpty():
            return found
        rows = after
