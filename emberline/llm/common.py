"""Small helpers that the operators of this package share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.sources.storage import work_folder

#: Bytes of one Arrow batch handed to Python, so that very long texts do not pile up in a worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, *sort: str) -> DataFrame:
    """``df`` written as Parquet to the shared work folder and read again.

    Cuts the lineage: what follows re-reads a table that outlives any executor.
    """
    folder = f"{work_folder(df.sparkSession)}/table"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Applications whose workers have this package.
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, as ``--py-files`` would, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/emberline", "zip", root, "emberline")
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def map_batches(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes, unless the session sets its own bound.

    The bound is a setting of the session, which a plan reads when it runs, so it stays set.
    """
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))) > 64 << 20:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not any("." in name for name in [*df.columns, *schema.names]):
        return df.mapInArrow(each, schema)
    # names with dots would be read as paths, so columns go by number through Python
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])

    def numbered(batches):
        return (b.rename_columns(plain.names) for b in each(batches))

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(numbered, plain).toDF(*schema.names)


def col(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def keep_listed(docs: DataFrame, keys: dict[str, Column], listed: DataFrame, twins: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` stand in ``listed``; one row of each key in ``twins``.

    ``keys`` names expressions over ``docs``; ``listed`` (distinct keys) and ``twins`` (those
    keys that several rows share) have columns of these names. Null keys match null keys. Only
    ``listed`` and full rows meet in one shuffle on the keys; repeated rows, which are rare, are
    reduced by a partial aggregation.
    """
    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), *[e.alias(k) for k, e in keys.items()])

    def same(left, right):
        met = None
        for k in keys:
            one = left[k].eqNullSafe(right[k])
            met = one if met is None else met & one
        return met

    kept = packed.join(listed, same(packed, listed), "left_semi")
    if not twins.isEmpty():
        repeated = kept.join(twins, same(kept, twins), "left_semi").groupBy(*keys).agg(F.first("row").alias("row"))
        kept = kept.join(twins, same(kept, twins), "left_anti").select("row").unionByName(repeated.select("row"))
    return kept.select("row.*")
