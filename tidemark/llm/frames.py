"""What the operators share: Arrow maps, cut lineage, and the settings they read."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow one batch at a time. f sees columns of one batch and keeps nothing between batches."""
    find_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(run, schema)


def map_partitions(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    find_package(df.sparkSession)
    return df.mapInArrow(f, schema)


def find_package(spark: SparkSession) -> None:
    """Python workers that start from another folder find this package beside the driver's own path.

    On a cluster the package is shipped (--py-files or an image); there this path is just absent.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{_ROOT}:{have}" if have else _ROOT


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all machines share.

    It is ``spark.checkpoint.dir``. Where that is unset on one machine (a local master, as in tests) a temporary
    folder is set; on a cluster that would be a folder of the driver's own, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder; what follows no longer depends on how they were made."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """As cut, for rows that are soon replaced by others: they are a table in the shared folder, which remove() deletes."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(n).type) for n, x in ((f.name, columns[f.name]) for f in schema)], schema=schema)


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right on a long column that both have, so that a hot key's rows can be dealt to several tasks.

    Over the key itself, the partitioning that an aggregation left on the right would be taken as it is, and then
    adaptive execution doesn't split skewed partitions. So both sides are joined on the key with some bits turned.
    """
    turned = F.col(key).bitwiseXOR(F.lit(0x5BD1E995))
    return left.withColumn("_turned", turned).join(right.withColumn("_turned", turned).drop(key), "_turned", how).drop("_turned")


#: A key with more than one in HOT_SHARES of all rows is hot, so there are never more hot keys than that.
HOT_SHARES = 2048


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """left joined with right (inner), which has a row for each combination of keys and, as ``weight``, how many rows of left have it.

    Hot keys, at most HOT_SHARES of them however large the data, are sent to all tasks, so their rows stay where they
    are; the others' rows are shuffled, and no key brings more than one in HOT_SHARES of them to a task. Both sides
    are read twice. The weight is left out.
    """
    limit = (right.agg(F.sum(weight)).first()[0] or 0) / HOT_SHARES
    hot, cold = (right.where(which).drop(weight) for which in (F.col(weight) > limit, F.col(weight) <= limit))
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
