"""What the operators of this subpackage share: Arrow batch mapping and lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import cut_estimates, cut_lineage, shared_dir, ship

__all__ = ["append", "buckets_for", "cut_estimates", "cut_lineage", "id_text", "if_small", "join_keyed", "shared_dir", "table"]

#: Bytes of one Arrow batch sent to a Python worker, so that batches of very long texts stay small.
BATCH_BYTES = "8m"
#: Rows of ids up to which a join may broadcast them (16 MB of two longs a row).
BROADCAST_ROWS = 1_000_000


def append(df: DataFrame, fn: Callable[[pa.RecordBatch], list], ddl: str) -> DataFrame:
    """df with further columns: fn turns each Arrow batch into one array (or list) for each field of ddl."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    extra = StructType.fromDDL(ddl)
    schema = StructType(df.schema.fields + extra.fields)
    kinds = _arrow_types(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(fn(batch), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *extra.names])

    return df.mapInArrow(run, schema)


def _arrow_types(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, so that no other column's name can clash."""
    return df.select(F.col(id_col), F.col(text_col).alias("__text"))


def if_small(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """ids (a few longs a row, lineage cut) marked for broadcast if they have at most rows rows; else left to a shuffle."""
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """rows left-joined with keyed (one row a key, lineage cut; column count holds the rows of the key), without a hot key.

    keyed is broadcast if it is small. Else the keys that hold over a share-th of those rows, which are under share keys, are
    broadcast, and the rest is shuffled.
    """
    if keyed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed), key, "left")
    bound = keyed.agg(F.sum(count)).first()[0] // share
    hot, cold = keyed.filter(F.col(count) > bound), keyed.filter(F.col(count) <= bound)
    are = hot.select(F.col(key), F.lit(True).alias("__hot"))
    told = rows.join(F.broadcast(are), key, "left")
    return told.filter("__hot").drop("__hot").join(F.broadcast(hot), key, "left").unionByName(told.filter("__hot IS NULL").drop("__hot").join(cold, key, "left"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_for(rows: int, per_bucket: int = 20_000) -> int:
    """Hash buckets so that each holds about per_bucket rows at most: what is sorted together stays bounded. At least 512,
    so that a hot group is dealt over many tasks of a small table too."""
    return max(512, -(-rows // per_bucket))
