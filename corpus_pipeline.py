"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on every document its predecessor kept;
``run`` writes what a stage returns as Parquet to the folder all executors share and
hands the next one what it reads back.  All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.

Ids need not name rows.  Language and quality are found for each row by itself and stand
beside it; the two dedup stages run on the place of a row in the files of the stage
before, so what a stage decides about a row holds for that row alone.

Defined cases: a row with a null id is kept or dropped by its text like any other (it is
no labelled row); rows that share an id and differ in text each have their own fate; of
repeated rows (same id, same text) exactly one leaves ``exact_dedup``; among equal texts
the most code points, then the smallest id (a null id last) stays, among near copies the
smallest id (a null id last); texts without words are no near copies of each other.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.llm import dedup, jaccard, language, packing, quality
from slotwise.llm.store import written
from slotwise.llm.vocabulary import vocabulary_path

# A text whose longest matches with every learned language are shorter is in none of them.
LEAST_LETTERS_PER_PHRASE = 2.0
NUMBER = "row_number_of_stage"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no learned language, go."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", "lang", F.col("doc_id").cast("long").alias("doc_id"))
    found = language.identified(rows, carried=["row"])
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("letters_per_phrase") >= LEAST_LETTERS_PER_PHRASE)
    return found.filter(known).select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled rows among them, finds poor go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    return quality.classified(rows, labels, carried=["row"]).filter("predicted = 1").select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    rows = _numbered(docs)
    found = dedup.dedup(rows, dedup.fresh_index(spark), id_col=NUMBER)
    longer = -F.length(F.coalesce(F.col("text"), F.lit("")))
    return _first(docs, rows, found.select("doc_id", F.col("keep_id").alias("group")), longer)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8 or more) stays: the first."""
    rows = _numbered(docs)
    found = jaccard.jaccard_components(rows, jaccard.Rule(words=5, percent=80), id_col=NUMBER)
    return _first(docs, rows, found.select("doc_id", F.col("component_id").alias("group")), F.lit(0))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's tokens in sequences of 4096."""
    return packing.packed_documents(docs, vocabulary_path("word_bpe_49k.json"))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, which it keeps however often it is read.

    Rows of Parquet files have their place there: the number of the file, in order of
    names, and of the row.  Other rows are written with a number.
    """
    file, row = "file_of_stage", "place_in_file_of_stage"
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return written(docs.withColumn(NUMBER, F.monotonically_increasing_id()), "numbered")
    order = F.row_number().over(Window.orderBy(file)).cast("long")  # a row for each file
    files = written(placed.select(file).distinct().withColumn("file_number_of_stage", order), "files")
    number = F.shiftleft("file_number_of_stage", 40).bitwiseOR(F.col(row))
    return placed.join(files, file).withColumn(NUMBER, number).drop(file, row, "file_number_of_stage")


def _first(docs: DataFrame, rows: DataFrame, found: DataFrame, least: Column) -> DataFrame:
    """Of the numbered rows one of each group of ``found`` (doc_id: the number, group): least, then by id."""
    ids = rows.select(NUMBER, least.alias("least"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"))
    ranked = found.withColumnRenamed("doc_id", NUMBER).join(ids, NUMBER)
    best = ranked.groupBy("group").agg(F.min(F.struct("least", "nameless", "id", NUMBER)).alias("best"))
    return rows.join(best.select(F.col(f"best.{NUMBER}").alias(NUMBER)), NUMBER, "left_semi").select(*docs.columns)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("best_fit_packing", best_fit_packing),
]

# Suffix automata and a trained network are no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
