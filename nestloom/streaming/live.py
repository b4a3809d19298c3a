"""The live state of a stream of events: each micro-batch folds into a table of the latest event of every key.

Keys are dealt to buckets by hash, and a batch writes only the buckets that it touches. A manifest for each batch names the
version of every bucket; a repeated batch writes its own version again from the manifest before it, so nothing is folded
twice. Versions that neither the last manifest nor the one before it names are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


def folded(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The latest event of each key, deletes included, so that a late older put can't bring a document back."""
    all_events = state.unionByName(batch.select(*state.columns))
    rest = [c for c in state.columns if c != "key"]
    last = all_events.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("seq", "event_id")).alias("last"))
    return last.select("key", *[F.col(f"last.{c}").alias(c) for c in rest]).select(*state.columns)


def _system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, folder: str, number: int) -> dict[int, int] | None:
    """Versions by bucket after a batch; None if there is no such batch."""
    path, system = _system(spark, f"{folder}/manifest/{number}")
    if not system.exists(path):
        return None
    return {int(k): v for k, v in json.loads("".join(r.value for r in spark.read.text(f"{folder}/manifest/{number}").collect())).items()}


def _put_manifest(spark: SparkSession, folder: str, number: int, versions: dict[int, int]) -> None:
    mine, system = _system(spark, f"{folder}/manifest/.{number}")
    out = system.create(mine, True)
    out.write(bytearray(json.dumps(versions).encode()))
    out.close()
    path, _ = _system(spark, f"{folder}/manifest/{number}")
    system.delete(path, False)
    system.rename(mine, path)


def _read(spark: SparkSession, folder: str, schema: T.StructType, versions: dict[int, int]) -> DataFrame:
    paths = [f"{folder}/v{v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The latest events of all keys; live documents are those whose kind is put."""
    path, system = _system(spark, f"{folder}/manifest")
    if not system.exists(path):
        return spark.createDataFrame([], schema)
    numbers = [int(n) for f in system.listStatus(path) if (n := f.getPath().getName()).isdigit()]
    return _read(spark, folder, schema, _manifest(spark, folder, max(numbers)) or {} if numbers else {})


def fold_batch(batch: DataFrame, number: int, folder: str, buckets: int = BUCKETS) -> None:
    spark, schema = batch.sparkSession, batch.schema
    before = _manifest(spark, folder, number - 1) or {} if number else {}
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    touched = sorted(r.b for r in batch.select(bucket.alias("b")).distinct().collect())
    after = before | dict.fromkeys(touched, number)
    if touched:
        state = _read(spark, folder, schema, {b: v for b, v in before.items() if b in touched})
        folded(state, batch).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v{number}")
    _put_manifest(spark, folder, number, after)
    for b, v in (_manifest(spark, folder, number - 2) or {}).items() if number > 1 else ():
        if v not in (before.get(b), after.get(b)):
            path, system = _system(spark, f"{folder}/v{v}/bucket={b}")
            system.delete(path, True)


def follow(events: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS):
    """Starts a query that keeps the state of all events seen in the folder."""
    return events.writeStream.foreachBatch(lambda batch, number: fold_batch(batch, number, folder, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
