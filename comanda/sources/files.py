"""File sources and sinks: CSV, JSON arrays, JSON lines, nested backups, columnar weather documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; quotes are doubled, as spreadsheets have it, and null differs from empty."""
    rows.write.option("header", True).option("escape", '"').option("nullValue", "\\N").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\\N").csv(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that holds one JSON array, a row for each element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A row for each line that is a document; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def to_backup(mapping: DataFrame) -> DataFrame:
    """target, state: for each target one JSON object of source to its [raw name, variant] pairs, from
    ``mapping(target, source, raw, variant)``."""
    pairs = mapping.groupBy("target", "source").agg(F.sort_array(F.collect_list(F.array("raw", "variant"))).alias("pairs"))
    return pairs.groupBy("target").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "pairs"))))).alias("state"))


def from_backup(backup: DataFrame) -> DataFrame:
    """``mapping`` of a backup."""
    sources = backup.select("target", F.explode(F.from_json("state", "map<string, array<array<string>>>")).alias("source", "pairs"))
    return sources.select("target", "source", F.explode("pairs").alias("p")).select("target", "source", F.col("p")[0].alias("raw"), F.col("p")[1].alias("variant"))


def weather_document(weather: DataFrame) -> DataFrame:
    """One row with a JSON document of parallel arrays, as weather services send it."""
    days = weather.agg(F.sort_array(F.collect_list(F.struct(F.col("day").cast("string").alias("time"), "temp_max", "rain_sum"))).alias("d"))
    return days.select(F.to_json(F.struct(F.struct(F.col("d.time").alias("time"), F.col("d.temp_max").alias("temp_max"), F.col("d.rain_sum").alias("rain_sum")).alias("daily"))).alias("document"))


WEATHER = "struct<daily: struct<time: array<string>, temp_max: array<double>, rain_sum: array<double>>>"


def weather_rows(documents: DataFrame) -> DataFrame:
    """A row a day from documents of parallel arrays."""
    d = documents.select(F.from_json("document", WEATHER).alias("d")).select("d.daily.*")
    return d.select(F.inline(F.arrays_zip("time", "temp_max", "rain_sum"))).select(F.col("time").cast("date").alias("day"), "temp_max", "rain_sum")


def temperature_on(documents: DataFrame, days: DataFrame) -> DataFrame:
    """``days(day)`` with the temperature that the document has for it, by a map of its arrays."""
    d = documents.select(F.from_json("document", WEATHER).alias("d")).select(F.map_from_arrays("d.daily.time", "d.daily.temp_max").alias("m"))
    return days.join(F.broadcast(d)).select("day", F.try_element_at("m", F.col("day").cast("string")).alias("temp_max"))  # one document
