"""Documents to packed training windows in five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import common, decontaminate, langid, packing, secrets, simhash

STAGES = [
    ("language_id", langid.stage),
    ("simhash_dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("secret_scan", secrets.stage),
    ("packing", packing.stage),
]

#: Fitted centroids, connected components and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table of documents. Empty table: no rows.

    A stage's input is deleted from the shared folder once its output is whole, so two stages lie there at most.
    """
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _delete(spark, before)
        before = path
    return docs
