"""CSV tables: dialect, reading with all columns as text, and the collapsed-table guard."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = ",;\t|"


def sniff(sample: str) -> str:
    """The delimiter of a sample of at most 64,000 characters; a comma if none fits."""
    try:
        return csv.Sniffer().sniff(sample[:64_000], DELIMITERS).delimiter
    except csv.Error:
        return ","


def looks_like_csv(sample: str) -> bool:
    """Whether the first 20 lines have a delimiter, three columns or more, and mostly one width."""
    lines = [x for x in sample.splitlines()[:20] if x.strip()]
    if len(lines) < 2:
        return False
    widths = [len(next(csv.reader([x], delimiter=sniff(sample)))) for x in lines]
    return widths[0] >= 3 and sum(w == widths[0] for w in widths) >= 0.8 * len(widths)


def collapsed(columns: list[str]) -> bool:
    """One column whose header is a sentence: a table that lost its delimiters, to be read as text."""
    return len(columns) == 1 and len(columns[0].split()) >= 8


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The table with every column as text, null cells as empty text, and NUL characters removed."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(200).collect())
    df = spark.read.csv(path, header=True, sep=sniff(head), quote='"', escape='"', multiLine=True, mode="PERMISSIVE")
    return df.select([F.coalesce(F.translate(F.col(f"`{c}`"), "\x00", ""), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.csv(path, header=True, sep=sep, quote='"', escape='"')
