"""Sources and sinks: keyed parquet, CSV, nested JSON, macro series, results with provenance."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def put(df: DataFrame, root: str, namespace: str, key: str) -> str:
    path = f"{root}/{namespace}/{key}.parquet"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def put_bucketed(df: DataFrame, root: str, namespace: str, key: str, by: str, buckets: int, dealt: bool = False) -> str:
    """``df`` as a catalog table in buckets of column ``by``, its files under ``root``; returns the table's name.

    Windows, groupings and joins on ``by`` then read it without an exchange.  Rows that are ``dealt``
    already, to as many partitions by the same column, are written where they are.
    """
    name = f"{namespace}_{key}_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, by)  # a file a bucket
    rows.write.bucketBy(buckets, by).sortBy(by).option("compression", "zstd").option("path", f"{root}/{namespace}/{key}").format("parquet").saveAsTable(name)
    return name


def get(spark: SparkSession, root: str, namespace: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{namespace}/{key}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def has(spark: SparkSession, root: str, namespace: str, key: str) -> bool:
    return exists(spark, f"{root}/{namespace}/{key}.parquet")


def scan_prices(prices: DataFrame, tickers: DataFrame, start, columns: Sequence[str]) -> DataFrame:
    """Projected scan from a date on, for the tickers of a table."""
    return prices.where(F.col("date") >= F.lit(start)).select(*columns).join(tickers.select("ticker").distinct(), "ticker", "left_semi")


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType) -> DataFrame:
    """CSV with a header as ZSTD parquet, typed; all strings if a value doesn't fit its type."""
    plain = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])).csv(source, header=True)
    cast = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields}
    misfit = reduce(lambda a, b: a | b, (F.col(f"`{n}`").isNotNull() & c.isNull() for n, c in cast.items()))
    typed = plain.select(*(c.alias(n) for n, c in cast.items()))
    (plain if plain.where(misfit).head(1) else typed).write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def csv_and_rejects(spark: SparkSession, source: str, target: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """CSV with a header as typed ZSTD parquet, and the rejects: ``line`` of each row that doesn't fit.

    A row with a value that isn't of its type, or with too many or too few of them, is rejected
    whole; all others are typed.  The file is read once: both parts are written side by side.
    """
    line = T.StructField("__line", T.StringType())
    read = spark.read.schema(T.StructType([*schema.fields, line])).csv(source, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=line.name)
    read.withColumn("__rejected", F.col(line.name).isNotNull()).write.mode("overwrite").partitionBy("__rejected").option("compression", "zstd").parquet(target)
    both = spark.read.schema(T.StructType([*schema.fields, line, T.StructField("__rejected", T.BooleanType())])).parquet(target)
    return both.where("NOT __rejected").select(*schema.names), both.where("__rejected").select(F.col(line.name).alias("line"))


FACT_ENTRY = "struct<end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>"
FACTS_JSON = f"cik long, ticker string, facts map<string,map<string,struct<label:string,units:map<string,array<{FACT_ENTRY}>>>>>"


def facts_json(raw: DataFrame) -> DataFrame:
    """Long fact rows of nested documents (taxonomy -> tag -> unit -> entries), entries without date or value left out."""
    tags = raw.select("cik", "ticker", F.explode("facts").alias("taxonomy", "tags")).select("cik", "ticker", F.explode("tags").alias("tag", "body"))
    units = tags.select("cik", "ticker", "tag", F.explode("body.units").alias("unit", "entries")).select("cik", "ticker", "tag", "unit", F.explode("entries").alias("e"))
    rows = units.select("ticker", "cik", "tag", F.col("e.val").alias("value"), F.try_to_date("e.end").alias("period_end"), F.try_to_date("e.filed").alias("filed"), "e.form", "e.fy", "e.fp", "unit")
    return rows.where("filed IS NOT NULL AND value IS NOT NULL")


def filer_trades(raw: DataFrame, fields: Sequence[str], filer: Sequence[str]) -> DataFrame:
    """One row for each trade of nested filer documents, the filer's fields attached, one row an id."""
    each = raw.select(*(F.col(f"filer.{f}").alias(f"filer_{f}") for f in filer), F.explode("trades").alias("t"))
    return each.select(*(f"filer_{f}" for f in filer), *(F.col(f"t.{f}").alias(f) for f in fields)).dropDuplicates(["id"])


def macro_csv(raw: DataFrame, series_id: str, realtime: Sequence[str], start, end) -> DataFrame:
    """series_id, date, value, is_realtime of a two-column file of strings; a dot is no value."""
    rows = raw.select(F.lit(series_id).alias("series_id"), F.try_to_date("date").alias("date"), F.expr("try_cast(value AS double)").alias("value"), F.lit(series_id in realtime).alias("is_realtime"))
    return rows.where(F.col("date").between(start, end) & F.col("value").isNotNull())


def price_contract(raw: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """A source's price table (contract name -> source column of strings) as numbers; rows without adjusted close go."""
    numbers = [F.expr(f"try_cast(`{src}` AS double)").alias(name) for name, src in names.items() if name not in ("ticker", "date")]
    rows = raw.select(F.col(names["ticker"]).alias("ticker"), F.try_to_date(F.col(names["date"]).cast("string")).alias("date"), *numbers)
    return rows.dropna(subset=["ticker", "date", "close_adj"])


def actions(splits: DataFrame, dividends: DataFrame, start, end) -> DataFrame:
    """Splits and dividends as one sparse table."""
    return splits.unionByName(dividends, allowMissingColumns=True).where(F.col("date").between(start, end))


def profile(table: DataFrame, name: str, date: str, key: str) -> DataFrame:
    """name, n_rows, first, last, n_keys of a table."""
    day = F.col(date).cast("date")
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("first"), F.max(day).alias("last"), F.countDistinct(key).alias("n_keys")).select(F.lit(name).alias("name"), "*")


def provenance(table: DataFrame, name: str) -> DataFrame:
    """name, n_rows, n_columns, fields: what a stored table's record holds."""
    return table.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(table.columns)).alias("n_columns"), F.lit(",".join(sorted(table.columns))).alias("fields"))


def feature_record(features: DataFrame, family: str, specs: Mapping[str, str], panel: DataFrame, panel_name: str) -> DataFrame:
    """One row that says how a stored family of features was made: when, its columns and their specs (with
    what is done where a value is missing), and the panel that its keys are from, with that one's rows and names."""
    source = panel.agg(F.count(F.lit(1)).alias("panel_rows"), F.countDistinct("ticker").alias("panel_names"))
    normal = ",".join(f"{c}{x}" for c in specs for x in ("_z", "_rank"))
    own = features.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(family).alias("family"), F.current_timestamp().alias("built"), "n_rows", F.lit(",".join(specs)).alias("feature_columns"), F.lit(normal).alias("normalized_columns"),
        F.lit("; ".join(f"{c}: {text}" for c, text in specs.items())).alias("specs"), F.lit(panel_name).alias("panel"),
    )
    return own.join(F.broadcast(source))  # one row each


def put_results(spark: SparkSession, root: str, parts: Mapping[str, DataFrame], schema: str) -> DataFrame:
    """Writes each part of a result as JSON lines in a folder of its own, and reads all of them back with their ``part``."""
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{root}/results/part={name}")
    return spark.read.schema(f"{schema}, part string").json(f"{root}/results")


def provenance_mismatch(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Records whose row count isn't the table's."""
    now = actual.select("name", F.col("n_rows").alias("n_now"))
    return recorded.join(now, "name", "left").where(F.coalesce("n_now", F.lit(-1)) != F.col("n_rows")).select("name", "n_rows", "n_now")
