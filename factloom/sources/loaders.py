"""Readers and writers of text, JSON lines and generated rows, with the checks that a load has to pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.intervals import as_of
from factloom.sources.store import Refused


def non_empty(df: DataFrame, what: str) -> DataFrame:
    """A filter that matches nothing is an error, not a small result."""
    if df.isEmpty():
        raise Refused(f"{what}: no rows")
    return df


def unique_by(df: DataFrame, key: list[str], what: str) -> DataFrame:
    twice = df.groupBy(*key).count().filter("count > 1").limit(3).collect()
    if twice:
        raise Refused(f"{what}: repeated keys {[tuple(r)[:-1] for r in twice]}")
    return df


def json_lines(spark: SparkSession, path: str, schema: str, key: list[str] | None = None) -> DataFrame:
    """JSON lines by a schema; lines that aren't JSON are left out, repeated keys are refused."""
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    good = spark.read.text(path).select(parsed.alias("r")).filter("r._bad IS NULL").select("r.*").drop("_bad")
    return unique_by(good, key, path) if key else good


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """name, addr, kind from lines such as ``name = 0x80001000; // type:func``."""
    line = spark.read.text(path)
    pick = lambda g: F.regexp_extract("value", r"^\s*(\w+)\s*=\s*0x([0-9A-Fa-f]+)\s*;(?:.*type:(\w+))?", g)
    out = line.select(pick(1).alias("name"), F.conv(pick(2), 16, 10).cast("long").alias("addr"), F.nullif(pick(3), F.lit("")).alias("kind"))
    return out.filter("name <> ''")


def sections(spark: SparkSession, path: str) -> DataFrame:
    """object_path, section, addr, size from a linker map: a section line belongs to the object that it names, sizes and
    addresses are hexadecimal."""
    pick = lambda g: F.regexp_extract("value", r"^\s+(\.\w+)\s+0x([0-9A-Fa-f]+)\s+0x([0-9A-Fa-f]+)\s+(\S+\.o)\s*$", g)
    rows = spark.read.text(path).select(pick(4).alias("object_path"), pick(1).alias("section"), F.conv(pick(2), 16, 10).cast("long").alias("addr"), F.conv(pick(3), 16, 10).cast("long").alias("size"))
    return rows.filter("section <> ''")


def map_symbols(spark: SparkSession, path: str) -> DataFrame:
    """file, name, addr, object_path, section of the symbol lines of linker maps (an address and a name): a symbol belongs to the
    section line last above it in its file, and symbols above the first one to none. Lines are numbered by the block of the file that
    they are read in and their place in it, so a large map is read by several tasks."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
    lines = spark.read.text(path).select(*place, "value")
    part = lambda g: F.regexp_extract("value", r"^\s+(\.\w+)\s+0x([0-9A-Fa-f]+)\s+0x([0-9A-Fa-f]+)\s+(\S+)\s*$", g)
    name = lambda g: F.regexp_extract("value", r"^\s+0x([0-9A-Fa-f]+)\s+([^\s=]+)\s*$", g)
    rows = lines.select("file", "_block", "_at", F.nullif(part(4), F.lit("")).alias("object_path"), F.nullif(part(1), F.lit("")).alias("section"), F.nullif(name(2), F.lit("")).alias("name"), F.conv(name(1), 16, 10).cast("long").alias("addr"))
    above = Window.partitionBy("file").orderBy("_block", "_at").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("object_path").isNotNull(), F.struct("object_path", "section")), ignorenulls=True).over(above)
    rows = rows.filter("object_path IS NOT NULL OR name IS NOT NULL").withColumn("_last", last)
    return rows.filter("name IS NOT NULL").select("file", "name", "addr", F.col("_last.object_path").alias("object_path"), F.col("_last.section").alias("section"))


def symbol_identity(files: DataFrame) -> DataFrame:
    """name, status, addr: one address, a conflict, or unresolved, over all files (name, addr)."""
    found = files.groupBy("name").agg(F.count_distinct("addr").alias("n"), F.min("addr").alias("addr"))
    return found.select("name", F.when(F.col("n") == 0, "unresolved").when(F.col("n") == 1, "resolved").otherwise("conflict").alias("status"), F.when(F.col("n") == 1, F.col("addr")).alias("addr"))


def source_files(spark: SparkSession, path: str, pattern: str, excluded: list[str]) -> DataFrame:
    """path, text of files below a folder, without those in excluded folders."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.filter(~F.col("path").rlike("/(" + "|".join(excluded) + ")/")) if excluded else files


def without_overlaps(new: DataFrame, known: DataFrame, group: str, low: str, high: str, bucket: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Rows of the groups of which no interval [low, high) meets a known one, and the refused groups. Intervals meet in
    buckets, by an equality join."""
    deal = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor((F.greatest(F.col(high) - 1, F.col(low))) / bucket))))
    k = deal(known.select(F.col(low).alias("_l"), F.col(high).alias("_h")).withColumnRenamed("_l", low).withColumnRenamed("_h", high)).select("_b", F.col(low).alias("_kl"), F.col(high).alias("_kh"))
    refused = deal(new).join(k, "_b").filter((F.col(low) < F.col("_kh")) & (F.col("_kl") < F.col(high))).select(group).distinct()
    return new.join(refused, group, "left_anti"), refused


# What parts the records of a written history, their fields, and the message from the changes.
RECORD, FIELD, MESSAGE_END = "\x1e", "\x1f", "\x1d"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """sha, authored_at, author, message, changes (array of status, old_path, path) of a history that was written as text by
    ``git log --name-status --format=%x1e%H%x1f%aI%x1f%an%x1f%B%x1d``. Records without all fields and lines without a path
    are left out; a commit without changes has an empty array."""
    outer = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    record = F.split("value", MESSAGE_END, 2)
    field = F.split(record[0], FIELD, 4)
    whole = spark.read.option("lineSep", RECORD).text(path).filter(F.contains("value", F.lit(MESSAGE_END))).select(field.alias("f"), record[1].alias("changed")).filter(F.size("f") == 4)
    lines = F.transform(F.split("changed", r"\r?\n"), lambda line: F.split(line, "\t"))
    moved = lambda c: c[0].rlike("^[RC]") & (F.size(c) >= 3)
    change = lambda c: F.struct(c[0].alias("status"), F.when(moved(c), c[1]).alias("old_path"), F.when(moved(c), F.get(c, 2)).otherwise(c[1]).alias("path"))
    changes = F.transform(F.filter(lines, lambda c: F.size(c) >= 2), change)
    return whole.select(outer(F.col("f")[0]).alias("sha"), outer(F.col("f")[1]).alias("authored_at"), outer(F.col("f")[2]).alias("author"), outer(F.col("f")[3]).alias("message"), changes.alias("changes"))


# The first four bytes of an image in each byte order, and the bytes of a word in that order.
IMAGE_ORDERS = {"80371240": ("z64", 1), "37804012": ("v64", 2), "40123780": ("n64", 4)}


@F.pandas_udf(T.BinaryType())
def _swapped(content: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([raw if w == 1 else np.frombuffer(raw, f"u{w}").byteswap().tobytes() for raw, w in zip(content, width)])


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the binary files at ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def image_headers(files: DataFrame) -> DataFrame:
    """path, byte_order, size, sha1, entry, title, game_code, content (most significant byte first) of images (path, content).

    An image of an unknown byte order, an incomplete last word or without a whole header is an error, as is a null content."""
    magic = F.hex(F.substring("content", 1, 4))
    orders = F.create_map(*[F.lit(v) for k, (order, _) in IMAGE_ORDERS.items() for v in (k, order)])
    widths = F.create_map(*[F.lit(v) for k, (_, n) in IMAGE_ORDERS.items() for v in (k, n)])
    size, width = F.octet_length("content"), F.element_at(widths, magic)
    sound = F.coalesce((size >= 64) & (size % width == 0), F.lit(False))
    refused = F.raise_error(F.concat(F.lit("not an image: "), F.coalesce("path", F.lit("no path"))))
    known = files.select("path", "content", F.element_at(orders, magic).alias("byte_order"), F.when(sound, width).otherwise(refused.cast("int")).alias("_width"))
    plain = known.select("path", "byte_order", _swapped("content", "_width").alias("content"))
    ascii_at = lambda first, length: F.decode(F.substring("content", first, length), "US-ASCII")
    return plain.select(
        "path", "byte_order", F.octet_length("content").cast("long").alias("size"), F.sha1("content").alias("sha1"), F.conv(F.hex(F.substring("content", 9, 4)), 16, 10).cast("long").alias("entry"),
        F.trim(ascii_at(33, 20)).alias("title"), ascii_at(60, 4).alias("game_code"), "content",
    )


def values_of_key(rows: DataFrame, column: str, key: str) -> DataFrame:
    """value: every scalar under ``key`` at any depth of a JSON text."""
    pattern = rf'"{key}"\s*:\s*("(?:[^"\\]|\\.)*"|-?[0-9.eE+-]+|true|false|null)'
    return rows.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("value")).withColumn("value", F.trim(F.regexp_replace("value", '^"|"$', "")))


def generated(spark: SparkSession, rows: int, seed: int, families: int = 8, largest: int = 500) -> DataFrame:
    """id, family, size: rows that depend on the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    part = lambda start, n: F.conv(F.substring(digest, start, n), 16, 10).cast("long")
    return spark.range(rows).select("id", (part(1, 4) % families).alias("family"), (part(5, 6) % largest + 1).alias("size"))


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """path, addr, word, op, args, function of listings of decoded instructions: lines ``addr <name>:`` that begin a function
    and lines ``addr: word op args``. A line of a file belongs to the function that begins at or last before its address; other
    lines are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    number = lambda c: F.conv(c, 16, 10).cast("long")
    head, line = r"^([0-9a-f]{1,15}) <(.+)>:$", r"^\s*([0-9a-f]{1,15}):\s+([0-9a-f]{8})\s+(\S+)(?:\s+(\S.*))?$"
    get = lambda pattern, k: F.regexp_extract("value", pattern, k)
    begins = lines.filter(F.col("value").rlike(head)).select("path", number(get(head, 1)).alias("addr"), get(head, 2).alias("name"))
    rows = lines.filter(F.col("value").rlike(line)).select("path", number(get(line, 1)).alias("addr"), get(line, 2).alias("word"), get(line, 3).alias("op"), get(line, 4).alias("args"))
    return as_of(rows, begins, ["path"], "addr", "name", "function")


def report(df: DataFrame, title: str, rows: int) -> str:
    """The first rows as a Markdown table."""
    lines = [f"## {title}", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect()])


def latest_versions(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the highest ``order`` for each key, for tables that are updated by appending."""
    by = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")
