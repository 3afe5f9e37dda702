"""From raw documents to a training mix, in five written stages.

1. language: documents whose language cannot be told are dropped (text that is
   null or has no letter, or a posterior under ``MIN_SCORE``); labels held for
   training are those of ``documents``.
2. near_duplicates: of each class of linked documents the one with the smallest
   id stays, and of repeated rows one; documents without words link with
   nothing and stay.
3. decontaminate: documents that hold a passage of ``benchmark`` are dropped.
4. sanitise: personal data and terms that disclose it are replaced in the text.
5. mix: documents are taken to the target weights of their sources; the result
   has a row per document taken, with its text and its number of copies.

Each stage reads all that the one before kept, written as Parquet. Rows with a
null id stay up to the mix. An empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellpath.llm import decontaminate, langid, mixing, sanitise, shingle_join
from fellpath.llm._tables import fresh_path, materialise, table

MIN_SCORE = 0.5
#: Ids up to this count are broadcast to drop documents; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, where=~langid.held_out())
    scored = docs.withColumn("__judged", langid.judged(docs, model))
    kept = (F.col("__judged.label") != langid.UNDETERMINED) & (F.col("__judged.score") >= MIN_SCORE)
    return scored.where(kept).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = materialise(shingle_join.near_duplicates(docs), "classes")
    later = classes.where("component_id < doc_id").select(F.col("doc_id").alias("__later")).distinct()
    if later.count() <= BROADCAST_IDS:
        later = F.broadcast(later)
    kept = docs.join(later, docs["doc_id"] == F.col("__later"), "left_anti")
    if not classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).union(kept.where("doc_id is null"))
    return kept


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.where(decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")) == 0)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = sanitise.sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken, with their text; the mix itself moves ids and sizes only.

    Texts stay where they are: what was taken is broadcast to them, if it is few
    rows. Only of rows that are repeated, which count together, one is looked for."""
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    mixed = mixing.mix(keyed, keep=["__key"])
    told = mixed.groupBy("doc_id", "__key", "source", "size", "source_size", "target").agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken"), F.count("*").alias("__rows"))
    told = materialise(told.where("copies > 0"), "taken")
    few = told.count() <= BROADCAST_IDS
    texts = keyed.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__own"), F.col("source").alias("__from"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__own")) & F.col("source").eqNullSafe(F.col("__from"))
    out = texts.join(F.broadcast(told) if few else told, same)
    once, again = out.where("__rows = 1"), out.where("__rows > 1").dropDuplicates(["__id", "__own", "__from"])
    out = once if told.where("__rows > 1").isEmpty() else once.unionByName(again)
    return out.select("doc_id", "text", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("sanitise", sanitised),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
