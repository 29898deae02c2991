"""Mined facts held against declared layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What can come of a fact, in the order in which it is asked for.
OUTCOMES = ("no_signature", "param_not_struct", "struct_unknown", "negative_offset", "offset_uncovered", "offset_in_padding", "bulk_copy_excluded", "agree", "subfield_read", "disagree")


def held_against_layouts(facts: DataFrame, signatures: DataFrame, layouts: DataFrame) -> DataFrame:
    """``facts`` with struct, widths and outcome, one of :data:`OUTCOMES`: the first that holds.

    ``facts`` has func, param, offset, width, is_load and copied; ``signatures`` has func, param (each pair once) and struct,
    null where the parameter is none; ``layouts`` has struct, offset, width and padding, with several rows for an offset that
    a union gives several widths. An offset that only padding describes says nothing of a width. A load that is narrower
    than the widest field at its offset reads a part of it. Facts without a width take no part; a null offset is not covered,
    null flags are false. The tables are joined by their keys, layouts after they are brought to one row an offset.
    """
    at = layouts.groupBy("struct", "offset").agg(F.sort_array(F.collect_set(F.when(~F.coalesce("padding", F.lit(False)), F.col("width")))).alias("widths"))
    known = layouts.filter("struct is not null").select("struct").distinct().withColumn("is_known", F.lit(True))
    typed = signatures.join(known, "struct", "left").select("func", "param", "struct", "is_known", F.lit(True).alias("signed"))
    out = facts.filter("width is not null").join(typed, ["func", "param"], "left").join(at, ["struct", "offset"], "left")
    inside = F.array_contains("widths", F.col("width"))
    tests = (
        F.col("signed").isNull(),
        F.col("struct").isNull(),
        F.col("is_known").isNull(),
        F.col("offset") < 0,
        F.col("widths").isNull(),
        F.size("widths") == 0,
        F.coalesce("copied", F.lit(False)),
        inside,
        F.coalesce("is_load", F.lit(False)) & (F.col("width") < F.array_max("widths")),
    )
    outcome = F.lit(OUTCOMES[-1])
    for name, test in reversed(list(zip(OUTCOMES, tests))):
        outcome = F.when(test, name).otherwise(outcome)
    return out.withColumn("outcome", outcome).drop("is_known", "signed")


def census(held: DataFrame) -> DataFrame:
    """outcome, n, and accuracy_milli: of all facts that a layout could prove wrong, how many in a thousand agree (null if none)."""
    n = held.groupBy("outcome").agg(F.count("*").alias("n"))
    one = n.agg(*[F.coalesce(F.sum(F.when(F.col("outcome") == c, F.col("n"))), F.lit(0)).alias(c) for c in ("agree", "subfield_read", "disagree")])
    checked = F.col("agree") + F.col("subfield_read") + F.col("disagree")
    right = F.when(checked > 0, F.floor(1000 * F.col("agree") / checked))
    return n.crossJoin(F.broadcast(one.select(right.alias("accuracy_milli"))))  # one row
