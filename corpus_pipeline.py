"""A training corpus from the documents table, in five stages: language ID, near-dedup, substring dedup, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps of docs, with the
columns of documents (the last one returns pieces of token sequences). Every stage's rows are written as Parquet and
read again before the next, so a lost executor costs one stage at most. Empty tables pass through as such.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegrid.llm import language_id, mixing, near_dedup, packing, substring_dedup
from ripplegrid.llm.common import removed, scratch, written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose two nearest language codewords are about equally near.

    A document without lang gets the one predicted; if no language can be learned, nothing goes but texts without a letter."""
    model = language_id.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model).where((F.col("lang_pred") != language_id.UNDETERMINED) & ~F.col("ambiguous"))
    return found.select(*[F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays (of several, that of the smallest hash of its text;
    rows without an id come last). Texts of different groups that share an id all stay."""
    found = near_dedup.groups(docs.select("doc_id", "text"), keys=True)
    first = found.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.text_key").alias("__key"))
    own = docs.withColumn("__text_key", F.xxhash64(F.col("text").cast("string")))
    kept = own.join(first, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__text_key"]).select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that stand in a document with a smaller id are cut; texts without one keep their
    white space; documents of which nothing is left go."""
    found = substring_dedup.repeats(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    made = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))}
    return found.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: texts come as often as the mix takes them, the last time perhaps in part."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens that hold the sources in the proportions of the mix."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("substring dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot state the classifiers, signatures and tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):  # what a stage has written goes with it, and so does the stage before
            kept, docs = docs, written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), keep=True)
        if i:
            removed(kept)
    return STAGES[-1][1](spark, docs, sf_dir)
