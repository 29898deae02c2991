"""Collects a module's queries with the DuckDB SQL of each."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, name: str, oracle: str | None = None):
        """Register the decorated function (spark, sf_dir) -> DataFrame."""

        def put(f):
            if name in self.queries:
                raise ValueError(f"query registered twice: {name}")
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return put

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """Register a query that is one SQL text, and its twin: the same text if both engines take it."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return statement(spark, sf_dir, text)

        self.add(name, oracle or text)(run)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_NAMED = re.compile(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b")


def statement(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run one SQL text in which FROM and JOIN name tables of ``sf_dir``; no view is left behind in the session."""
    used = {m.group(2) for m in _NAMED.finditer(text)}
    return spark.sql(_NAMED.sub(r"\1 {\2}", text), **{t: table(spark, sf_dir, t) for t in used})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
