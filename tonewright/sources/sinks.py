"""Tables, exports and the event log as files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.functions.paths import extension
from tonewright.sources.events import at_least

# Columns of exports, and the formats whose tags can be written.
CSV_COLUMNS = {"path": "src_path", "artist": "tag_artist", "album": "tag_album", "title": "tag_title", "track": "tag_track", "disc": "tag_disc", "format": "format", "codec": "codec", "bitrate_kbps": "bitrate_kbps", "duration_ms": "duration_ms", "lossless": "lossless", "size_bytes": "size_bytes"}
TAGGED = (".mp3", ".m4a", ".flac", ".ogg", ".opus", ".wma", ".wav", ".aiff", ".ape", ".wv", ".tta", ".mpc")


class ReplaceError(OSError):
    """A table could not be replaced; the old one is still there."""


def can_write_tags(path: Column) -> Column:
    return extension(path).isin(*TAGGED)


def upserted(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of both by key, the new one where both have it but for the columns to keep."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.col("_new").desc())
    first = Window.partitionBy(key).orderBy("_new").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = rows.withColumns({c: F.first(c, ignorenulls=True).over(first) for c in keep}) if keep else rows
    return kept.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place", "_new")


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the table, put the old folder aside and the new one in its place; if that fails the old one comes back."""
    spark = df.sparkSession
    beside, aside = (f"{path}.{uuid.uuid4().hex}" for _ in range(2))
    df.write.parquet(beside)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside, aside))
    fs = target.getFileSystem(conf)
    there = fs.exists(target)
    if there and not fs.rename(target, old):
        raise ReplaceError(f"cannot put {path} aside")
    if not fs.rename(fresh, target):
        if there:
            fs.rename(old, target)
        raise ReplaceError(f"cannot put {beside} in place of {path}")
    if there:
        fs.delete(old, True)


def append_events(events: DataFrame, path: str, least: str = "info") -> None:
    """Events at or above a level as lines of JSON; empty values are left out of the line."""
    wanted = at_least(events, least)
    texts = {c: F.nullif(c, F.lit("")) for c, kind in wanted.dtypes if kind == "string"}
    stamped = wanted if "ts" in wanted.columns else wanted.select(F.current_timestamp().alias("ts"), *wanted.columns)
    stamped.withColumns(texts).write.mode("append").json(path)


def csv_rows(library: DataFrame) -> DataFrame:
    """The twelve columns of an export, in their order."""
    return library.select(*(F.col(c).alias(n) for n, c in CSV_COLUMNS.items()))


def json_rows(library: DataFrame) -> DataFrame:
    """The thirteen keys of a line of an export."""
    return library.select(*(F.col(c).alias(n) for n, c in sorted({"file_id": "file_id", **CSV_COLUMNS}.items())))


def export_csv(df: DataFrame, path: str) -> None:
    csv_rows(df).write.mode("overwrite").option("header", True).csv(path)


def export_jsonl(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def writer_arguments(c: dict[str, Column]) -> Column:
    """Arguments that would write a row's tags into a copy of its file."""
    pairs = [("artist", "tag_artist"), ("album", "tag_album"), ("title", "tag_title"), ("album_artist", "tag_albumartist"), ("date", "tag_date")]
    named = [F.when(c[f] != "", F.array(F.lit("-metadata"), F.concat(F.lit(f"{k}="), c[f]))) for k, f in pairs]
    named += [F.when(c[f] > 0, F.array(F.lit("-metadata"), F.concat(F.lit(f"{k}="), c[f].cast("string")))) for k, f in (("track", "tag_track"), ("disc", "tag_disc"))]
    return F.flatten(F.array_compact(F.array(*named)))
