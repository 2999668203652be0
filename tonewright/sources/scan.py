"""New files of a directory tree, probe output, and merging of two readings of the same tags."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from tonewright.functions.paths import extension
from tonewright.functions.scores import is_lossless

# Audio file extensions.
EXTENSIONS = (".mp3", ".flac", ".m4a", ".aac", ".ogg", ".opus", ".wav", ".aiff", ".aif", ".wma", ".ape", ".wv", ".mpc")

PROBE = "struct<streams: array<struct<codec_name: string, codec_type: string, sample_rate: string, channels: int, bits_per_sample: string, bits_per_raw_sample: string>>, format: struct<format_name: string, duration: string, bit_rate: string, tags: map<string, string>>>"


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """(file_key, src_path, size_bytes, mtime_unix) of the audio files under a root; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    files = found.where(extension(F.col("path")).isin(*EXTENSIONS))
    size, mtime = F.col("length"), F.unix_timestamp("modificationTime")
    named = files.select(F.regexp_replace("path", "^file:/*", "/").alias("src_path"), size.alias("size_bytes"), mtime.alias("mtime_unix"))
    return named.select(file_key(device_and_inode("src_path"), F.col("size_bytes"), F.col("mtime_unix")).alias("file_key"), "src_path", "size_bytes", "mtime_unix")


@arrow_udf(StringType())
def device_and_inode(paths: pa.Array) -> pa.Array:
    """'device:inode' of each path; null where the file system doesn't tell."""
    out = []
    for path in paths.to_pylist():
        try:
            found = os.stat(path)
            out.append(f"{found.st_dev}:{found.st_ino}" if found.st_ino else None)
        except (OSError, TypeError, ValueError):
            out.append(None)
    return pa.array(out, pa.string())


def file_key(place: Column, size: Column, mtime: Column) -> Column:
    """SHA-1 of device, inode, size and time; of size and time where there is no place."""
    return F.sha1(F.concat_ws(":", place, size.cast("string"), mtime.cast("string")).cast("binary"))


def is_known(known: DataFrame, path: str) -> bool:
    """Whether a single file's key is known already; False for a file that isn't there."""
    spark = known.sparkSession
    try:
        found = os.stat(path)
    except OSError:
        return False
    one = spark.createDataFrame([(f"{found.st_dev}:{found.st_ino}", found.st_size, int(found.st_mtime))], "place string, size long, mtime long")
    return not known.join(one.select(file_key(F.col("place"), F.col("size"), F.col("mtime")).alias("file_key")), "file_key", "left_semi").isEmpty()


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Found files whose key isn't known, one per key (the first path)."""
    fresh = found.join(known.select("file_key"), "file_key", "left_anti")
    return fresh.groupBy("file_key").agg(F.min(F.struct("src_path", "size_bytes", "mtime_unix")).alias("f")).select("file_key", "f.*")


PIECE = 1 << 20


@arrow_udf(StringType())
def content_hash(paths: pa.Array) -> pa.Array:
    """SHA-1 of each file, read piece by piece, so a file of any size fits; null where it can't be read."""
    out = []
    for path in paths.to_pylist():
        try:
            sha1 = hashlib.sha1(usedforsecurity=False)
            with open(path, "rb") as file:
                while piece := file.read(PIECE):
                    sha1.update(piece)
            out.append(sha1.hexdigest())
        except (OSError, TypeError, ValueError):
            out.append(None)
    return pa.array(out, pa.string())


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha1) of the files under a root that all executors see."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    return found.select("path", content_hash("path").alias("sha1"))


def probed(rows: DataFrame) -> DataFrame:
    """Metadata columns of rows of (file_id, probe): probe output as JSON; audio values come from the first audio stream."""
    p = rows.select("file_id", F.from_json("probe", PROBE).alias("p"))
    audio = F.filter("p.streams", lambda s: s.codec_type == "audio")
    p = p.withColumn("s", F.coalesce(F.get(audio, F.lit(0)), F.get("p.streams", F.lit(0)))).withColumn("t", F.coalesce("p.format.tags", F.create_map().cast("map<string,string>")))
    tag = lambda *names: F.coalesce(*(F.nullif(F.element_at("t", n), F.lit("")) for n in names), F.lit(""))
    number = lambda text: F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    bits = [F.when(F.col(f"s.{c}").try_cast("int") > 0, F.col(f"s.{c}").try_cast("int")) for c in ("bits_per_sample", "bits_per_raw_sample")]
    return p.select(
        "file_id", F.coalesce("p.format.format_name", F.lit("")).alias("container"), F.coalesce("s.codec_name", F.lit("")).alias("codec"), F.coalesce((F.col("p.format.duration").try_cast("double") * 1000).cast("int"), F.lit(0)).alias("duration_ms"),
        F.coalesce(F.col("s.sample_rate").try_cast("int"), F.lit(0)).alias("sample_rate"), F.coalesce(*bits, F.lit(0)).alias("bit_depth"), F.coalesce("s.channels", F.lit(0)).alias("channels"), F.coalesce(F.floor(F.col("p.format.bit_rate").try_cast("int") / 1000).cast("int"), F.lit(0)).alias("bitrate_kbps"),
        F.coalesce(is_lossless(F.col("s.codec_name")), F.lit(False)).alias("lossless"), tag("artist", "ARTIST").alias("tag_artist"), tag("album", "ALBUM").alias("tag_album"), tag("title", "TITLE").alias("tag_title"), tag("album_artist", "ALBUM_ARTIST", "albumartist").alias("tag_albumartist"), tag("date", "DATE", "year", "YEAR").alias("tag_date"),
        number(tag("disc", "DISC")).alias("tag_disc"), number(tag("track", "TRACK")).alias("tag_track"), tag("compilation", "COMPILATION", "Compilation").isin("1", "true").alias("tag_compilation"),
    )


TEXT_TAGS = ("tag_artist", "tag_album", "tag_title", "tag_albumartist", "tag_date")


def merged(tags: DataFrame, probe: DataFrame) -> DataFrame:
    """One row per file of either reading: tags where they are filled, else the probe's; audio values from the probe."""
    t = tags.select("file_id", *(F.col(c).alias(f"_{c}") for c in (*TEXT_TAGS, "tag_track", "tag_disc")))
    both = probe.join(t, "file_id", "full_outer")
    texts = {c: F.coalesce(F.nullif(f"_{c}", F.lit("")), c, F.lit("")) for c in TEXT_TAGS}
    numbers = {c: F.when(F.coalesce(F.col(f"_{c}"), F.lit(0)) > 0, F.col(f"_{c}")).otherwise(F.coalesce(c, F.lit(0))) for c in ("tag_track", "tag_disc")}
    return both.withColumns(texts | numbers).drop(*(f"_{c}" for c in (*TEXT_TAGS, "tag_track", "tag_disc")))
