"""The library: one row per file with its tags, where '' and 0 stand for missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.sources.tables import table

TEXTS = ("format", "codec", "container", "tag_artist", "tag_album", "tag_title", "tag_albumartist", "tag_date", "musicbrainz_recording_id", "musicbrainz_release_id", "raw_tags_json")
NUMBERS = ("duration_ms", "sample_rate", "bit_depth", "channels", "bitrate_kbps", "tag_disc", "tag_disc_total", "tag_track", "tag_track_total")
FLAGS = ("lossless", "tag_compilation")
FILE_TEXTS = ("file_key", "src_path", "sha1", "status", "error")


def latest_files(spark: SparkSession, folder: str, only: DataFrame | None = None) -> DataFrame:
    """One row per file: of several scans the latest, equal times by status, error and path. ``only``: the file_ids wanted."""
    f = table(spark, folder, "files", "file_id", *FILE_TEXTS, "size_bytes", "mtime_unix", "first_seen_at", "last_update_at").where("file_id is not null")
    if only is not None:
        f = f.join(only, "file_id", "left_semi")
    order = Window.partitionBy("file_id").orderBy(F.col("last_update_at").desc_nulls_last(), *(F.coalesce(c, F.lit("")) for c in ("status", "error", "src_path", "file_key", "sha1")))
    one = f.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    return one.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in FILE_TEXTS} | {c: F.coalesce(F.col(c), F.lit(0)) for c in ("size_bytes", "mtime_unix")})


def one_metadata(spark: SparkSession, folder: str, tests: Sequence[Column] = ()) -> DataFrame:
    """One row per file with its tags; rows of one file are taken as equal. ``tests`` see the table as it is, so they reach the scan."""
    m = table(spark, folder, "metadata", "file_id", *TEXTS, *NUMBERS, *FLAGS).where("file_id is not null")
    for test in tests:
        m = m.where(test)
    filled = {c: F.coalesce(F.col(c), F.lit("")) for c in TEXTS} | {c: F.coalesce(F.col(c), F.lit(0)) for c in NUMBERS} | {c: F.coalesce(F.col(c), F.lit(False)) for c in FLAGS}
    return m.withColumns(filled).dropDuplicates(["file_id"])


def library(spark: SparkSession, folder: str, tests: Sequence[Column] = ()) -> DataFrame:
    """Files joined with their tags; ``tests`` on the tags are applied before anything is shuffled."""
    tags = one_metadata(spark, folder, tests)
    wanted = None
    if tests:
        wanted = table(spark, folder, "metadata")
        for test in tests:
            wanted = wanted.where(test)
        wanted = wanted.select("file_id")
    return latest_files(spark, folder, wanted).join(tags, "file_id")


def columns(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in df.columns}
