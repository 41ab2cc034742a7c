"""Sessions, and tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: dict[str, str] = {}


def session(master: str | None = None, app: str = "plumbline") -> SparkSession:
    """A session with adaptive execution on; everything else comes from the cluster's own settings."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    return (builder.master(master) if master else builder).getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset on a local master, as in tests, one of our own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own_root.setdefault("root", tempfile.mkdtemp(prefix="plumbline-"))
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/plumbline-{name}-{uuid.uuid4().hex}"


def read_by_streams(spark: SparkSession) -> None:
    """Parquet's vectored reads off in this session: each thread keeps direct buffers as large as the column chunks that it has read, outside the heap."""
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors and is computed once."""
    spark = df.sparkSession
    read_by_streams(spark)
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
