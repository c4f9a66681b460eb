"""Readers for landed query results and price history, inline dimensions and the result sink."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from tidewell.sources.schemas import SCHEMAS


def snake(name: str) -> str:
    """``CoinID``, ``BLOCK_TIMESTAMP`` and ``Block Timestamp`` all become snake_case."""
    name = re.sub(r"[^0-9A-Za-z]+", "_", name.strip())
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    return re.sub(r"_+", "_", name).strip("_").lower()


def upper_camel(name: str, abbreviations: Sequence[str] = ("ID",)) -> str:
    fixed = {a.lower(): a for a in abbreviations}
    return "".join(fixed.get(p, p.capitalize()) for p in snake(name).split("_"))


def normalize_names(df: DataFrame, case: str = "snake") -> DataFrame:
    style = {"snake": snake, "upper_camel": upper_camel}[case]
    return df.toDF(*[style(c) for c in df.columns])


def read_dataset(
    spark: SparkSession,
    name: str,
    path: str,
    fmt: str = "parquet",
    field_case: str = "upper",
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """A landed dataset under its declared schema.

    Columnar files may name fields otherwise: ``columns`` maps declared names to the (normalized)
    names in the files, and declared fields that are neither there nor mapped are NULL.

    ``json`` expects one object per line, which Spark can split; ``json_array`` takes the
    payload of a query endpoint (one array per file), which it cannot, so land such payloads as
    many files or convert them to parquet once. JSON fields are told apart by case: query
    endpoints write them in upper case, ``field_case`` may say ``lower``.
    """
    declared = StructType.fromDDL(SCHEMAS[name])
    if fmt in ("json", "json_array"):
        spelled = StructType(
            [StructField(getattr(f.name, field_case)(), f.dataType, f.nullable) for f in declared.fields]
        )
        raw = (
            spark.read.schema(spelled)
            .option("mode", "FAILFAST")
            .option("multiLine", fmt == "json_array")
            .json(path)
        )
        return raw.toDF(*declared.names)
    if fmt == "csv":
        return spark.read.schema(declared).option("mode", "FAILFAST").option("header", True).csv(path)
    df = normalize_names(spark.read.format(fmt).load(path))
    if columns is None:
        return df.select(*[F.col(f.name).cast(f.dataType) for f in declared.fields])
    found = {f.name: columns.get(f.name, f.name) for f in declared.fields}
    return df.select(
        *[(F.col(found[f.name]) if found[f.name] in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared.fields]
    )


def read_prices(
    spark: SparkSession,
    path: str,
    coin_ids: str | Iterable[str],
    days: int,
    as_of: date | str,
    vs_currency: str = "usd",
    fmt: str = "parquet",
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Long price rows of the chosen coins for the ``days`` days up to ``as_of``.

    Plain comparisons only, so the coin list and the look-back reach the scan (and prune
    directories when the files are partitioned by coin or day).
    """
    as_of = date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    coins = [coin_ids] if isinstance(coin_ids, str) else list(coin_ids)
    first = as_of - timedelta(days=days)
    return read_dataset(spark, "price_history", path, fmt, columns=columns).where(
        F.col("coin_id").isin(coins)
        & (F.col("vs_currency") == vs_currency)
        & (F.col("timestamp") >= F.lit(first).cast("timestamp_ntz"))
        & (F.col("timestamp") < F.lit(as_of + timedelta(days=1)).cast("timestamp_ntz"))
    )


def land_prices(prices: DataFrame, path: str) -> None:
    """Price history in folders by coin and month, so that a reader of some coins and months opens no other file.

    Rows are dealt out by folder first, which gives each folder the files of one task.
    """
    landed = prices.withColumn("month", F.date_trunc("month", "timestamp").cast("date"))
    landed.repartition("coin_id", "month").write.mode("overwrite").partitionBy("coin_id", "month").parquet(path)


def read_landed_prices(
    spark: SparkSession, path: str, coin_ids: str | Iterable[str], days: int, as_of: date | str, vs_currency: str = "usd"
) -> DataFrame:
    """``read_prices`` of what ``land_prices`` wrote; coins and months prune the folders."""
    as_of = date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    first = as_of - timedelta(days=days)
    columns = StructType.fromDDL(SCHEMAS["price_history"])
    kept = StructType([f for f in columns.fields if f.name != "coin_id"] + [columns["coin_id"], StructField("month", DateType())])
    rows = spark.read.schema(kept).parquet(path).where(F.col("month").between(F.lit(first.replace(day=1)), F.lit(as_of)))
    coins = [coin_ids] if isinstance(coin_ids, str) else list(coin_ids)
    return rows.where(
        F.col("coin_id").isin(coins)
        & (F.col("vs_currency") == vs_currency)
        & (F.col("timestamp") >= F.lit(first).cast("timestamp_ntz"))
        & (F.col("timestamp") < F.lit(as_of + timedelta(days=1)).cast("timestamp_ntz"))
    ).select(*columns.names)


def dim(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A dimension written out in code. Its size is fixed, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def write_result(
    df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "table":
        writer.saveAsTable(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def refresh_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Write rows into folders by ``day``, in place of what the days in ``df`` held; all other days stay as they are.

    Writing the same days again gives the same table, so a daily job can be repeated.
    """
    df.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names, which all executors share."""
    context = spark.sparkContext
    named = context._jsc.sc().getCheckpointDir()
    base = named.get() if named.isDefined() else context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidewell-")
    return f"{base}/{uuid.uuid4().hex}"
