"""Point clouds from the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import global_index
from ..operators.spectrum import FIELDS, as_cloud

_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User, hour, day and value of each event."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return as_cloud(rows.select(F.col("event_id").alias("point_index"), F.col("user_id").alias("x"), F.hour("ts").alias("y"), F.dayofmonth("ts").alias("z"), F.col("value").alias("mass")))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three numbers of each vector, and the fourth as a mass."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = [F.get("embedding", F.lit(i)) for i in range(4)]
    return as_cloud(rows.select(F.col("vec_id").alias("point_index"), e[0].alias("x"), e[1].alias("y"), e[2].alias("z"), (F.lit(150.0) + F.lit(300.0) * e[3].cast("double")).alias("mass")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, discount, tax and price of each line, beside all its columns."""
    fields = {"x": F.col("l_quantity"), "y": F.col("l_discount") + 0.0, "z": F.col("l_tax") + 0.0, "mass": F.col("l_extendedprice") / 350}
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_LINE, *[v.cast("float").alias(k) for k, v in fields.items()])


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each line, numbered by all its columns, as no fewer tell lines apart. It is read several times, so it is
    numbered once and written."""
    return as_cloud(global_index(_lines(spark, sf_dir), _LINE, FIELDS))


def lineitem_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the piece that each point is read from, for what reads points in order."""
    rows = global_index(_lines(spark, sf_dir), _LINE, FIELDS, piece="piece")
    return rows.select(*as_cloud(rows).columns, "piece")


def lineitem_unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same points without a number, for what doesn't ask for their order: nothing is sorted or written."""
    return _lines(spark, sf_dir).select(*FIELDS)


EVENTS_SQL = "SELECT event_id AS point_index, user_id::FLOAT AS x, hour(ts)::FLOAT AS y, day(ts)::FLOAT AS z, value::FLOAT AS mass FROM events"
EMBEDDINGS_SQL = "SELECT vec_id AS point_index, embedding[1]::FLOAT AS x, embedding[2]::FLOAT AS y, embedding[3]::FLOAT AS z, (150::DOUBLE + 300::DOUBLE * embedding[4]::DOUBLE)::FLOAT AS mass FROM embeddings"
LINEITEM_SQL = f"SELECT row_number() OVER (ORDER BY {', '.join(_LINE)}) - 1 AS point_index, l_quantity::FLOAT AS x, (l_discount + 0.0::DOUBLE)::FLOAT AS y, (l_tax + 0.0::DOUBLE)::FLOAT AS z, (l_extendedprice / 350)::FLOAT AS mass FROM lineitem"
