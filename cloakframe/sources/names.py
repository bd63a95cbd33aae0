"""Lists of given and family names as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Beginnings of the names of files, by what they hold (fixed values).
PREFIXES = {"given": ("nomi", "first_name", "firstname", "given", "names"), "family": ("cognomi", "last_name", "lastname", "surname", "family")}


def read_names(spark: SparkSession, *folders: str) -> DataFrame:
    """(name, role): the distinct names, in lower case, of the text files in the folders, which say by their own names what they list.  A line
    is a name, or has one before its first comma, semicolon or tab; comments (#), prose and markup are passed over."""
    lines = spark.read.text(list(folders), pathGlobFilter="*.txt").select(F.lower(F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("file"), F.lower(F.btrim(F.element_at(F.split("value", "[,;\\t]"), 1))).alias("name"))
    starts = lambda role: F.col("file").rlike("^(?:" + "|".join(PREFIXES[role]) + ")")
    role = F.when(starts("given"), "given").when(starts("family"), "family")
    named = lines.select("name", role.alias("role")).where("role IS NOT NULL")
    return named.where(F.col("name").rlike(r"^\p{L}[\p{L}'-]{1,39}$")).distinct()
