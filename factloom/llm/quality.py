"""Quality rules by distribution divergence, in DataFrame expressions only.

A document is compared with its language's reference in two histograms: character classes, and the language's most
common words (all other words are one more bin). The comparison is the Jensen-Shannon distance (the square root of the
divergence in bits, 0 to 1). Short documents are not judged, nor are those of languages with too few documents for a
reference. The references come from all documents of a language that pass the base rule: the median share of each character
class, and the mean share of each common word. Every document counts alike, so neither long ones nor a minority of junk
moves a reference. Shares are held as whole numbers, so reruns agree exactly.

Words are told by 64-bit hashes, here and in the windows of three. A language's common words are looked up in a table of
slots, of a size at which no two of them meet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import packed, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Character classes of the histogram, in the order in which they are counted; everything else is the last bin.
CLASSES = {
    "lower": "[a-z]",
    "space": "[ \\t-\\r]",
    "upper": "[A-Z]",
    "stop": "[.,;:!?\\'\"()-]",
    "digit": "[0-9]",
    "symbol": "[#*$%&|<>]",
}
_AT = list(CLASSES).index


@dataclass(frozen=True)
class Rules:
    common_words: int = 32
    #: Documents that a language needs for a reference; documents of others are judged by the base rule alone.
    least_documents: int = 50
    #: Words that a document needs to be judged by its words, and characters to be judged by its characters.
    least_words: int = 50
    least_chars: int = 200
    #: Distances above which a document is rejected.
    most_class_distance: float = 0.18
    most_word_distance: float = 0.42


_WORDS = r"array_remove(split(coalesce(text, ''), '[ \\t-\\r]+'), '')"


def common_words(docs: DataFrame, rules: Rules) -> DataFrame:
    """lang, common: for each language with enough documents the hashes of the words of letters only that most documents
    have, ties to the smaller word."""
    enough = docs.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= rules.least_documents).select(F.col("lang").alias("_lang"))
    words = docs.select("lang", F.explode(F.array_distinct(F.expr(_WORDS))).alias("word"))
    seen = words.groupBy("lang", "word").agg(F.count("*").alias("n")).filter(F.col("word").rlike(r"^\p{L}+$"))
    seen = seen.join(enough, F.col("lang").eqNullSafe(F.col("_lang")), "left_semi")
    # a language's words are first cut down in parts, so that no task ranks them all
    order = [F.desc("n"), F.asc("word")]
    part = Window.partitionBy("lang", F.pmod(F.hash("word"), F.lit(64))).orderBy(*order)
    top = seen.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= rules.common_words)
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("r") <= rules.common_words)
    return top.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list("word")), lambda w: F.xxhash64(w)).alias("common"))  # of so many words


def _slots(commons: DataFrame) -> DataFrame:
    """``commons`` with the size of a table in which no two common words meet, and each slot's place in ``common``, -1 for none."""
    sizes = "filter(sequence(1001, 1501, 2), m -> size(array_distinct(transform(common, x -> pmod(x, m)))) = size(common))"
    out = commons.withColumn("slots", F.coalesce(F.expr(f"get({sizes}, 0)"), F.expr("raise_error('common words that meet in every table')")))
    return out.withColumn("slot", F.expr("transform(sequence(0, slots - 1), s -> CAST(array_position(transform(common, x -> pmod(x, slots)), s) - 1 AS INT))"))


def measures(docs: DataFrame, rules: Rules) -> DataFrame:
    """row, lang, text of ``docs`` in counts: its base measures, its two histograms (``words`` null where the language has no
    reference) and its number of characters."""
    commons = stage(_slots(stage(common_words(docs, rules), "common-words")), "common-slots")
    own = commons.select(F.col("lang").alias("_lang"), "common", "slots", "slot")
    rows = docs.withColumn("t", F.coalesce("text", F.lit(""))).withColumn("w", F.expr(_WORDS)).withColumn("n_words", F.size("w").cast("long"))
    rows = rows.withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    # equal 3-word windows have equal hashes
    rows = rows.withColumn("g", F.expr("transform(slice(h, 1, greatest(size(h) - 2, 0)), (x, i) -> xxhash64(x, get(h, i + 1), get(h, i + 2)))"))
    rows = rows.withColumn("s", F.expr("CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(transform(g, (x, i) -> struct(x, i))) END"))
    twice = "array_distinct(flatten(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> CASE WHEN a.x = b.x THEN array(a.i, b.i) ELSE CAST(array() AS array<int>) END)))"
    rows = rows.withColumn("n_repeat_words", F.expr(f"CASE WHEN s IS NULL THEN 0L ELSE CAST(size(array_distinct(flatten(transform({twice}, p -> array(p, p + 1, p + 2))))) AS BIGINT) END"))
    rows = rows.withColumn("lines", F.expr(r"filter(split(t, '\\n'), l -> l rlike '[^ \\t-\\r]')"))
    rows = rows.withColumn("n_dup_lines", F.expr("CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)"))
    # each class is taken out of what the ones before it have left
    rows = rows.withColumn("t0", F.col("t"))
    for k, one in enumerate(CLASSES.values()):
        rows = rows.withColumn(f"t{k + 1}", F.expr(f"regexp_replace(t{k}, '{one}+', '')"))
    lengths = [F.char_length(f"t{k}").cast("long") for k in range(len(CLASSES) + 1)]
    rows = rows.withColumn("classes", F.array(*[a - b for a, b in zip(lengths, lengths[1:])], lengths[-1])).withColumn("chars", lengths[0])
    rows = rows.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    # places of the words among the common ones, sorted, with each place once more: counts are the distances of places
    last = rules.common_words
    place = "get(slot, CAST(pmod(x, slots) AS INT))"
    rows = rows.withColumn("at", F.expr(f"sort_array(concat(transform(h, x -> CASE WHEN get(common, {place}) = x THEN {place} ELSE {last} END), sequence(0, {last + 1})))"))
    counts = [F.expr(f"array_position(at, {k + 1}) - array_position(at, {k}) - 1") for k in range(last + 1)]
    rows = rows.withColumn("words", F.when(F.col("common").isNotNull(), F.array(*counts)))
    classes = F.col("classes")
    return rows.select(
        "row", "lang", "n_words", (F.col("chars") - classes[_AT("space")]).alias("word_chars"), classes[_AT("symbol")].alias("n_symbols"),
        "n_dup_lines", "n_repeat_words", "chars", "classes", "words",
    )


def references(measured: DataFrame, rules: Rules) -> DataFrame:
    """For each language the reference histograms: ``cref`` in thousandths, ``wref`` in sums of millionths."""
    total = "aggregate({0}, 0L, (s, y) -> s + y)"
    share = measured.select("lang", F.posexplode(F.expr(f"transform(classes, x -> CAST(1000 * x DIV {total.format('classes')} AS INT))")).alias("pos", "share"))
    counts = share.groupBy("lang", "pos", "share").agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang", "pos")
    counts = counts.withColumn("upto", F.sum("n").over(by.orderBy("share"))).withColumn("all", F.sum("n").over(by))
    medians = counts.filter("2 * upto >= all").groupBy("lang", "pos").agg(F.min("share").alias("m"))
    classes = medians.groupBy("lang").agg(F.expr("transform(array_sort(collect_list(struct(pos, m))), x -> x.m)").alias("cref"))  # of the classes
    parts = measured.select("lang", F.expr(f"transform(words, x -> CAST(1000000 * x DIV {total.format('words')} AS BIGINT))").alias("p"))
    words = parts.groupBy("lang").agg(F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(rules.common_words + 1)]).alias("wref"))
    return classes.withColumnRenamed("lang", "_lang").join(words, F.col("_lang").eqNullSafe(F.col("lang"))).select("_lang", "cref", "wref")


def distance(p: str, q: str) -> str:
    """SQL for the Jensen-Shannon distance of two arrays of counts; null where either is empty."""

    def share(a: str) -> str:
        return f"transform({a}, x -> x / nullif(aggregate({a}, 0D, (s, y) -> s + y), 0))"

    term = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (a + b)) ELSE 0D END"
    # abs, as rounding can leave a sum just below zero
    return f"sqrt(abs(aggregate(zip_with({share(p)}, {share(q)}, (a, b) -> ({term.format('a')} + {term.format('b')}) / 2), 0D, (s, x) -> s + x)))"


def judged(docs: DataFrame, rules: Rules = Rules(), carried: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns of ``docs``, or of ``carried`` alone), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, class_distance, word_distance and kept of every row of ``docs`` (text, lang and any others).

    A null text is empty; it fails the base rule. A null language is a language like any other. Repeated rows stay.
    A distance is null where the document or its reference is too short to be judged, and then rejects nothing.
    An empty table gives none.
    """
    narrow = docs.select(packed(docs.select(*carried) if carried else docs), "text", "lang")
    measured = measures(narrow, rules).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    measured = stage(measured, "quality-measures")
    reference = stage(references(measured.filter("NOT base_failed AND words IS NOT NULL"), rules), "quality-references")
    rows = measured.join(reference, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    rows = rows.withColumn("class_distance", F.when(F.col("chars") >= rules.least_chars, F.expr(distance("classes", "cref"))))
    rows = rows.withColumn("word_distance", F.when(F.col("n_words") >= rules.least_words, F.expr(distance("words", "wref"))))
    far = (F.coalesce("class_distance", F.lit(0.0)) > rules.most_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > rules.most_word_distance)
    kept = ~F.col("base_failed") & ~far
    return rows.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", kept.alias("kept"))
