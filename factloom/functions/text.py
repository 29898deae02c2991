"""Column functions over text: tokens, windows, hashes and normal forms. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case runs of a-z, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != "")


def windows(tokens: Column, width: int) -> Column:
    """Every ``width`` tokens in a row, joined by spaces; all of them as one if there are fewer, none for none."""
    n = F.size(tokens)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, width), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(many)


def sketch(tokens: Column, width: int = 5, keep: int = 96) -> Column:
    """The ``keep`` smallest distinct hashes of the windows, as 16 hexadecimal digits, which order as the numbers do."""
    hashes = F.transform(windows(tokens, width), lambda g: F.substring(F.md5(g), 1, 16))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, keep)  # array_sort would call a comparator for each pair


def overlap(a: Column, b: Column) -> Column:
    """Shared members by the smaller set: 1 if both are empty, 0 if one is."""
    x, y = F.size(a), F.size(b)
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(x, y))


def jaccard(a: Column, b: Column) -> Column:
    """Shared members by all members; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def hash_bucket(value: Column, digits: int, modulus: int) -> Column:
    """The first hexadecimal digits of the value's SHA-256, as a number, modulo ``modulus``."""
    return F.conv(F.substring(F.sha2(value, 256), 1, digits), 16, 10).cast("long") % modulus


def sealed(salt: str, group: Column, fraction: float) -> Column:
    """Whether a group is set apart: the first byte of its salted hash is below the fraction of 256."""
    return hash_bucket(F.concat(F.lit(salt + ":"), group), 2, 256) < int(fraction * 256)


def plain_message(message: Column, length: int = 110) -> Column:
    """A message without what differs from case to case: place, quoted names, addresses, blanks; then cut."""
    out = F.regexp_replace(message, r"^\S+:\d+(:\d+)?:\s*", "")
    out = F.regexp_replace(out, r"'[^']*'", "'X'")
    out = F.regexp_replace(out, r"0x[0-9a-fA-F]+", "0xN")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, length)


def l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def log_signed(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def half_even(x: Column, digits: int) -> Column:
    """A double rounded to decimal digits, halves to the even one, by scaled doubles; ``bround`` rounds the shortest decimal that
    names the double, which is another number where the product with the power of ten rounds up to a half or off it."""
    rounded = F.rint(x * 10.0**digits) / 10.0**digits
    return F.when(F.isnan(rounded) | (F.abs(rounded) == float("inf")), x).otherwise(rounded)


def name_tokens(line: Column) -> Column:
    """Runs of letters, digits, dots, dollars and underlines, and every other character for itself."""
    return F.regexp_extract_all(line, F.lit(r"([A-Za-z_0-9.$]+|[^A-Za-z_0-9.$])"), F.lit(1))


def renamed_jointly(old: Column, new: Column, names: str, floats: str) -> Column:
    """Two arrays of lines as one text in which names are numbered by their first use over both (R0, R1, ...; F for those that
    match ``floats``). Pairs that differ by a bijection of their names, and no others, become equal."""
    tokens = name_tokens(F.concat_ws(" => ", F.array_join(old, " ; "), F.array_join(new, " ; ")))
    plain = lambda t: F.regexp_replace(t, r"^\$", "")
    used = F.array_distinct(F.transform(F.filter(tokens, lambda t: t.rlike(names)), plain))
    number = lambda t: F.concat(F.when(t.rlike(floats), "F").otherwise("R"), F.array_position(used, plain(t)) - 1)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(names), number(t)).otherwise(t)), "")
