"""Reading and writing of domain tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATEMENT = "user_id long, card_id long, ts timestamp, category string, amount long, _corrupt_record string"
CATALOGUE = (
    "id int, name string, issuer string, type string, network string, annualFee int, minSpending int, maxBenefit int, rating double, reviews int, "
    "popularity int, `rank` int, views int, clicks int, tags array<string>, color string, gradient string, "
    "benefits array<struct<icon: string, category: string, description: string, discountRate: double, type: string, maxMonthly: int, condition: string>>, "
    "eventBenefits array<string>"
)


def read_tables(spark: SparkSession, source: dict[str, str] | str, names: list[str], partition_column: str | None = None, num_partitions: int | None = None) -> dict[str, DataFrame]:
    """Tables by name: from a folder of parquet tables, or by JDBC where ``source`` holds JDBC options.

    With a partition column a JDBC table is read in so many ranges between the column's ends, which one aggregate in the
    database tells; rows with a null there come with the first range. An empty table, or one that has nulls only, is read
    in one part. Filters and columns that a query asks for reach the database.
    """
    if isinstance(source, str):
        return {n: spark.read.parquet(f"{source}/{n}.parquet") for n in names}
    out = {}
    for name in names:
        more = {}
        if partition_column and num_partitions:
            column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(source["url"]).quoteIdentifier(partition_column)
            ends = spark.read.format("jdbc").options(**source, query=f"SELECT min({column}) AS lo, max({column}) AS hi FROM {name}").load().first()
            if ends is not None and ends[0] is not None:
                more = {"partitionColumn": partition_column, "lowerBound": ends[0], "upperBound": ends[1], "numPartitions": num_partitions}
        out[name] = spark.read.format("jdbc").options(**source, **more, dbtable=name).load()
    return out


def read_statements_csv(spark: SparkSession, path: str) -> DataFrame:
    """Statements with a header; a row that does not fit is kept in ``_corrupt_record``."""
    return spark.read.schema(STATEMENT).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)


def read_statements_json(spark: SparkSession, path: str) -> DataFrame:
    """Statements as JSON lines; a line that does not fit is kept in ``_corrupt_record``."""
    return spark.read.schema(STATEMENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def scan_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The nested catalogue by its explicit schema, one card a line; a large file is split among many tasks. A line that is no card is in ``_corrupt_record``."""
    return spark.read.schema(f"{CATALOGUE}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_catalogue(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """The nested catalogue, parsed once with all its columns and stored, so that every reader of it agrees on which lines are damaged.

    ``lines=False`` reads a file that is one JSON array, in one task a file.
    """
    if not lines:
        return spark.read.schema(CATALOGUE).option("multiLine", True).json(path)
    return stored(scan_catalogue(spark, path), "catalogue")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, form: str = "parquet", user_buckets: int | None = None) -> None:
    """Parquet or JSON. ``user_buckets`` adds a folder level by hash of ``user_id``, with one shuffle, for per-user histories."""
    by = list(partition_by or [])
    if user_buckets:
        df = df.withColumn("user_bucket", F.pmod(F.xxhash64("user_id"), F.lit(user_buckets))).repartition("user_bucket")
        by.append("user_bucket")
    df.write.mode("overwrite").partitionBy(*by).format(form).save(path)


def bucketed(df: DataFrame, name: str, path: str, buckets: int, by: str = "user_id") -> DataFrame:
    """``df`` as an external table in ``buckets`` files by hash of ``by``, sorted by it, and read from there.

    Rows are dealt out as the table is, so each bucket is one file. Tables with the same column and number of buckets are
    joined and grouped by that column without an exchange.
    """
    df.repartition(buckets, by).write.mode("overwrite").option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(name)
    return df.sparkSession.table(name)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; only on one machine and without that setting, in a temporary folder that is made once."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def scratch_table(spark: SparkSession, label: str) -> tuple[str, str]:
    """A new table name and a path for it in the shared folder."""
    path = scratch_path(spark, label)
    return path.rpartition("/")[2].replace("-", "_"), path


def scratch_database(spark: SparkSession) -> str:
    """The URL of a new, empty database in this machine's memory, for sessions of one machine; a cluster needs a server that all its executors reach."""
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("a database in memory is not seen by executors on other machines")
    return f"jdbc:derby:memory:scratch{uuid.uuid4().hex};create=true"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once into a table in the shared folder, and read from there: what it says about its partitions stays true."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
