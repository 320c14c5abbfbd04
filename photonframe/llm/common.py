"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one that the cluster names in
    ``spark.checkpoint.dir``. Only where that is unset and all runs on this machine, an own one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write a table into the shared folder and read it back. It cuts the lineage and
    survives the loss of any executor."""
    path = table_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path  # for discard()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables from the shared folder, once everything that reads them
    has been written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns are not read."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs: it does so when the driver collects
    what refers to them, which may otherwise come late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
