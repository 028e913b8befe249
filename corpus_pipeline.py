"""The corpus pipeline: quality, exact copies, near copies, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of ``documents`` and drop rows. Stages are written as Parquet and read again in
between, so that a lost executor never costs an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitloom.llm.bpe import encode_texts
from transitloom.llm.common import if_small, text_or_empty, written
from transitloom.llm.exact_dedup import find_copies
from transitloom.llm.mixing import mix_corpus
from transitloom.llm.near_dedup import find_near_copies
from transitloom.llm.quality import fit_quality, judge


#: Workers outlive a stage: what the last one remembers has to leave room for the next run's first.
WORKER_CACHE = 60_000
ROW = "pipeline_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """(pipeline_row, doc): the documents with a number for each row, which holds whatever task runs again; ids may be null or repeat.

    Rows read straight from files are numbered by their file and their place in it, so nothing
    is written for that; others are written first.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    if not docs._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation"):
        docs = written(docs, "pipeline-rows")
    placed = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), whole)
    # a row a file, from footers alone
    files = sorted(r.file for r in placed.select("file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame([(f, k) for k, f in enumerate(files)], "file string, number long")
    return placed.join(F.broadcast(numbers), "file").select((F.shiftleft("number", 40) + F.col("at")).alias(ROW), "doc")


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The numbered documents but for those of these numbers, without their numbers."""
    numbers = written(dropped.select(ROW), "pipeline-dropped")
    return rows.join(if_small(numbers, 16), ROW, "left_anti").select("doc.*")


def _place(number: Column) -> Column:
    """Orders the rows of a group: by id, those without one last, then by number."""
    return F.struct(F.col("doc.doc_id").isNull().alias("no_id"), F.col("doc.doc_id").alias("id"), number.alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: every row is judged by itself, whatever its id or source."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    host, path = F.col("source"), F.col("lang")
    model = fit_quality(docs, labels, host=host, path=path)
    return judge(docs, model, host=host, path=path, text=text_or_empty("text")).filter("good").select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the smallest id's, of those that repeat it the first one.

    Rows without an id stay only where their text is nowhere else or has no row with an id; a
    repeated id is no reason to drop a row. Null and empty texts are one group. An empty table
    stays empty.
    """
    rows = _numbered(docs)
    found = find_copies(rows.select(_place(F.col(ROW)).alias("place"), "doc.text"), id_col="place")
    return _without(rows, found.filter("not kept").select(F.col("place.row").alias(ROW)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: five words, a similarity of 0.8.

    Rows are compared whatever their ids are; of a component the smallest id's row stays, rows
    without an id only where no row has one. Rows without words are linked with nothing and
    stay. An empty table stays empty.
    """
    rows = _numbered(docs)
    found = find_near_copies(rows.select(ROW, "doc.text"), id_col=ROW).select(ROW, "component_id")
    members = written(found.filter(F.col(ROW) != F.col("component_id")), "pipeline-members")
    # the row that names a component is its smallest number; the others are summed up to their first by id
    linked = members.union(members.select(F.col("component_id").alias(ROW), "component_id").distinct())
    placed = rows.select(ROW, "doc.doc_id").join(if_small(written(linked, "pipeline-linked"), 24), ROW).withColumn("doc", F.struct("doc_id"))
    placed = written(placed.select("component_id", _place(F.col(ROW)).alias("place")), "pipeline-places")
    stay = placed.groupBy("component_id").agg(F.min("place").alias("stays")).select(F.col("stays.row").alias(ROW))
    return _without(rows, placed.select(F.col("place.row").alias(ROW)).join(if_small(written(stay, "pipeline-stay"), 16), ROW, "left_anti"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents that holds a stated share of their tokens and meets the target weights as far as those reach.

    Rows of equal id, or without one, share their draw within a cell. Rows without tokens stay.
    """
    return mix_corpus(docs).filter("kept").select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the text decoded from them; a row for each row."""
    return encode_texts(docs, keep_decoded=False, cache_entries=WORKER_CACHE)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: A trained classifier, signatures and merges have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
