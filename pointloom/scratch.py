"""Tables that a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local = ""


def scratch_dir(spark: SparkSession) -> str:
    """The folder from spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _local
    _local = _local or tempfile.mkdtemp(prefix="spark-")
    return f"file://{_local}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Asks Spark to remove a query's shuffle files when it ends, rather than when the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet to the scratch folder and read it again, which cuts the lineage. What was shuffled for it goes.
    Settings of the session hold while it is written, where Spark knows them."""
    conf, path = df.sparkSession.conf, scratch_path(df.sparkSession, name)
    wanted = {k: v for k, v in ((settings or {}) | {_CLEAN_UP: "true"}).items() if conf.isModifiable(k)}
    before = {k: conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)
