"""Tables in the cluster's shared folder that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that spark.checkpoint.dir names and read again.

    Where that is unset a local session gets a temporary folder, as in tests; on a cluster it is an error, since
    executors do not share a machine's folders.
    """
    path = _place(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, name: str, key: str, there: bool = False) -> DataFrame:
    """Like saved(), as a table with a bucket a shuffle partition: joins and groups by the key move its rows no more.

    there: df already is in partitions(spark) hash partitions by the key.
    """
    spark = df.sparkSession
    n = partitions(spark)
    path = _place(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    (df if there else df.repartition(n, key)).write.bucketBy(n, key).option("path", path).saveAsTable(table, format="parquet")
    out = spark.table(table)
    out._saved_path, out._saved_table = path, table
    return out


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        folder = getattr(spark.sparkContext, "_shared_folder", None) or tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext._shared_folder = folder
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def forget(*tables: DataFrame) -> None:
    """Delete tables that saved() and dealt() made, once no plan reads them any more."""
    for df in tables:
        if hasattr(df, "_saved_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._saved_table}")
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
