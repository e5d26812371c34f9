"""Readers and writers of the job tables.

Parquet between stages; CSV and JSON at the edges. Texts in CSV files may hold
line breaks inside quotes; a file is read by many tasks all the same, see ``csv_records``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv_records import records

RAW_SCHEMA = "headline string, url string, source string, category string"
PROCESSED_SCHEMA = (
    "headline string, clean_headline string, url string, source string, category string, "
    "bias string"
)
PAGE_SCHEMA = "page_id bigint, url string, html string"
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all CSV files under ``path``; each has a heading. Empty strings come back as null.

    The records are read at once into a stored table; only their columns are cut out later.
    """
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"} | {"multiLine": "true"}
    rows = records(spark, path).select(F.from_csv("record", schema, options).alias("r")).select("r.*")
    return rows.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in rows.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS, quoteAll="true").csv(path)


def _read(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema)
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unknown format {fmt!r}")


def _write(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "csv":
        write_csv(df, path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, RAW_SCHEMA, fmt)


def write_raw(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(df.select("headline", "url", "source", "category"), path, fmt)


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, PROCESSED_SCHEMA, fmt)


def write_processed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    columns = ["headline", "clean_headline", "url", "source", "category", "bias"]
    _write(df.select(*columns), path, fmt)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """One folder per model; a new run replaces only the models it reports on."""
    (
        report.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model")
        .json(path)
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "label string, precision double, recall double, f1 double, support bigint, model string"
    ).json(path)
