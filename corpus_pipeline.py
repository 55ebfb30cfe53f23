"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept.  All but the last return the columns of ``docs``.

1. language_id: fits the classifiers on the labelled rows and drops documents
   without a letter, and those whose language stays open (a score under one half).
   Without labelled rows every text with a letter stays.
2. simhash_near_dedup: documents whose five-word shingles have a Jaccard similarity
   of 0.8 or more are linked, every such pair: SimHash fingerprints give candidates, which
   are checked exactly, and a join finds the links that fingerprints cannot promise
   (see ``jaccard``); of each linked group the document with the smallest id stays.
3. benchmark_decontamination: documents with a benchmark passage go.
4. personal_data: personal data and what reveals it are replaced in the texts.
5. sentencepiece: the ids of each text and the text that they decode to.

Null texts: dropped by the first stage.  Null ids are ids like any other for the
later stages; rows that are alike in id and text are one document.  Stages keep
extra columns as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coloom.llm import decontaminate, jaccard, language, pieces, pii
from coloom.llm.common import content_key, raw, table
from coloom.session import cut

OPEN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coder = language.learn(docs, "doc_id", "text", "lang")
    if not coder.languages:
        return docs.where(language.letter_column("text"))
    named = docs.select(F.struct("*").alias("own"), language.predict_column(coder, "text").alias("p"))
    return named.where((F.col("p.lang") != language.UND) & (F.col("p.score") >= OPEN)).select("own.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A row is known by its id and text.
    key = [F.xxhash64(*salt, raw("text"), "doc_id").alias(n) for n, salt in (("r1", []), ("r2", [F.lit(1)]))]
    own = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), *key)
    labelled = jaccard.near_groups(docs.select(own.alias("row"), "text"), "row", "text")
    kept = labelled.select("component_id.r1", "component_id.r2").distinct()
    rows = docs.select(F.struct("*").alias("own"), *key).join(kept, ["r1", "r2"], "left_semi")
    same = Window.partitionBy("r1", "r2").orderBy(F.lit(0))
    return rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") == 1).select("own.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = content_key(raw("text"))
    found = decontaminate.matches(docs, key, table(spark, sf_dir, "benchmark"))
    hit = found.where(F.size("spans") > 0).select("key.*").distinct()
    return docs.select(F.struct("*").alias("own"), *key).join(hit, ["k1", "k2"], "left_anti").select("own.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = pieces.in_pieces(spark, docs.select("doc_id", "lang", "source", "text"), "text")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids", F.col("text").cast("string").alias("text"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the classifier, the fingerprints or the best paths.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
