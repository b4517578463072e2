"""A corpus made ready for training: harmless, without repeated lines, near copies and benchmark text, packed.

Each stage takes (spark, docs, sf_dir) and reads what the stage before it kept.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, lines, packing, toxicity
from tidemark.llm.frames import cut, load, remove, shared_folder

#: Repeated ids, of 8 bytes, that are sent to all tasks; more are joined in a shuffle.
MAX_BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels table, scores at 0.5 or more go.

    Null and empty texts score as harmless ones and stay; of repeated rows all stay or all go; without labels of both
    classes nothing goes.
    """
    texts, toxic = toxicity.labelled(docs, load(spark, sf_dir, "labels"))
    return toxicity.reject(docs, toxicity.fit(texts, toxic))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; every document stays, and n_chars follows its text (null for a null text)."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least doc_id stays, and every row without an id.

    Of rows equal in doc_id and text one stays. A doc_id whose rows have different texts stays while one of them does.
    Null and empty texts are classes of their own and stay.
    """
    found = jaccard.jaccard_join(docs).where("doc_id is not null")
    seen = cut(found.groupBy("doc_id").agg(F.max(F.col("class_id") == F.col("doc_id")).alias("stays"), F.count(F.lit(1)).alias("rows")))
    # no id meets a null one, so rows without an id are among the first
    once = docs.join(seen.where("not stays or rows > 1").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = seen.where("stays and rows > 1").select("doc_id")
    repeated = F.broadcast(repeated) if repeated.count() <= MAX_BROADCAST_IDS else repeated
    return once.unionByName(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go. Null, empty and wordless texts stay; repeated rows share their fate."""
    return decontaminate.reject(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of token sequences (see packing). Null and empty texts are packed as their end id alone; repeated rows as often as they come."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier and the token ids can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes Parquet to the shared folder and the next one reads that.

    What a stage read is deleted once its own rows are written, so one stage's rows are kept at a time. The last
    stage's result reads the rows before it when it is used, so these are deleted when the driver's Python ends.
    """
    docs = load(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, folder)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


def _forget(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session can't reach the folder any more
        remove(spark, folder)
