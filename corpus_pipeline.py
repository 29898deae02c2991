"""A corpus through the operators, one stage after another: reject, one document of each near-duplicate group, repeated
passages out, sources mixed to their targets, and the tokens of what is left."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, mixing, quality, repeats, simhash
from factloom.llm.shared import documents, stage

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


#: Bytes of a repeated string that the passage stage cuts, and words that a cut stretch has at least.
PASSAGES, PASSAGE_WORDS = repeats.Strings(200), 50


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts are too short and go. Repeated rows are judged each for
    itself. An empty table gives none. Other columns pass unchanged, whatever their names."""
    return quality.judged(docs).filter("kept").select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (sets of 5-word shingles with a similarity of 0.8 or more): the one with
    the smallest id, null last. Rows with the same id are told apart by their texts; of equal rows one stays. Null, empty and
    wordless texts are one group. An empty table gives none. Other columns pass unchanged, whatever their names."""
    found = simhash.similar_groups(docs).filter("first")
    return found.dropDuplicates(["id", "digest"]).select("row.*")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that are repeated anywhere in the corpus, in the same text or another: stretches that
    strings of 200 bytes with a twin cover, if they have 50 words or more. A document that was nothing else goes, and so
    equal rows of such a length all go. Null and empty texts stay as they are. An empty table gives none. Other columns pass
    unchanged, whatever their names, but for n_chars of documents that were cut."""
    cut = repeats.without_repeats(docs, PASSAGES, PASSAGE_WORDS)
    left = cut.filter((F.col("n_removed") == 0) | (F.trim("row.text") != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("row.text").cast("long")).otherwise(F.col("row.n_chars"))
    return left.select(*[n_chars.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, twice at most. A null source is a source like any other; null, empty and
    wordless texts have no size and are not taken. Repeated rows are taken each for itself. An empty table gives none. Other
    columns pass unchanged, whatever their names."""
    mixed = mixing.mixed(docs).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the tokens and of what they decode to, for each row of the mix, repeated ones too. A
    null text is empty. An empty table gives none. Other columns are not read."""
    return bpe.round_trip_digests(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]
#: Shingle sets, suffixes and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents table, each on the staged result of the one before."""
    docs = documents(spark, sf_dir)
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
