"""Cluster, score, plan: winners by an aggregation over keys, collisions by a window over the winners' paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.functions.paths import destination, folder, stem
from tonewright.functions.scores import duration_bucket, quality_score
from tonewright.functions.text import artist_key, title_key, version_kind
from tonewright.sources.checkpoints import cut
from tonewright.sources.library import columns, library

ROOT = "/dest"
ACTIONS = ("copy", "move", "hardlink", "symlink")


def with_cluster_key(lib: DataFrame) -> DataFrame:
    """artist|title|version|seconds|discN|trackN; files without artist and title go by their file name."""
    name = stem(F.col("src_path"))
    keyed = lib.withColumns({"_artist": artist_key(F.col("tag_artist")), "_title": title_key(F.col("tag_title")), "_name": title_key(name), "_stem": name})
    bare = (F.col("_artist") == "") & (F.col("_title") == "")
    title = F.when(~bare, F.col("_title")).when(F.col("_name") != "", F.col("_name")).otherwise(F.concat(F.lit("file_"), folder(F.col("src_path"))))
    parts = (F.when(bare, "unknown").otherwise(F.col("_artist")), title, version_kind(F.when(bare, F.col("_stem")).otherwise(F.col("tag_title"))), duration_bucket(F.col("duration_ms")).cast("string"), F.concat(F.lit("disc"), F.col("tag_disc").cast("string")), F.concat(F.lit("track"), F.col("tag_track").cast("string")))
    return keyed.withColumn("key", F.concat_ws("|", *parts)).drop("_artist", "_title", "_name", "_stem")


def with_score(lib: DataFrame) -> DataFrame:
    return lib.withColumn("score", quality_score(columns(lib)))


def winner_order() -> Column:
    """Best score, then larger, older, first path; the file id leaves no tie. The least is the winner."""
    return F.struct((-F.col("score")).alias("score"), (-F.col("size_bytes")).alias("size"), "mtime_unix", "src_path", "file_id")


def winners(scored: DataFrame) -> DataFrame:
    """(key, file_id, score) of the winner of each key, by an aggregation that combines before its shuffle."""
    best = scored.groupBy("key").agg(F.min(winner_order()).alias("best"))
    return best.select("key", "best.file_id", (-F.col("best.score")).alias("score"))


def compilations(lib: DataFrame) -> DataFrame:
    """(tag_album) of the albums with three or more artists; aggregated before any join."""
    return lib.where("tag_album <> '' and tag_artist <> ''").groupBy("tag_album").agg(F.countDistinct(F.lower("tag_artist")).alias("artists")).where("artists >= 3").select("tag_album")


def with_destination(lib: DataFrame, root: str = ROOT, albums: DataFrame | None = None) -> DataFrame:
    """``albums``: the compilations, where lib is but part of the library."""
    many = (compilations(lib) if albums is None else albums).select(F.col("tag_album").alias("_album"), F.lit(True).alias("_many"))
    # files without an album have no partner: a key of their own spreads them over the tasks
    own = F.when(F.col("tag_album") != "", F.col("tag_album")).otherwise(F.concat(F.lit("\n"), F.col("file_id").cast("string")))
    flagged = lib.withColumn("_album", own).join(many, "_album", "left")
    return flagged.withColumn("compilation", F.coalesce("_many", F.lit(False))).withColumn("dest_path", destination(root, columns(lib), F.col("compilation"))).drop("_many", "_album")


def plans(lib: DataFrame, action: str = "copy", case_sensitive: bool = False, root: str = ROOT) -> DataFrame:
    """(file_id, key, score, action, dest_path, reason, collided): winners are placed, losers and collisions skipped.

    Winners are found by an aggregation; only they get a destination and pass the window over paths.
    """
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action}")
    needed = ("file_id", "src_path", "size_bytes", "mtime_unix", "tag_artist", "tag_albumartist", "tag_album", "tag_title", "tag_date", "tag_track", "tag_track_total", "tag_disc", "tag_disc_total", "key", "score")
    scored = cut(with_score(with_cluster_key(lib)).select(*needed))
    marked = scored.join(winners(scored).select("file_id", F.lit(True).alias("won")), "file_id", "left")
    placed = with_destination(marked.where("won"), root, compilations(scored))
    path = F.col("dest_path") if case_sensitive else F.lower("dest_path")
    per_path = Window.partitionBy("_path").orderBy(F.col("score").desc(), F.col("file_id"))
    ranked = placed.withColumn("_path", path).withColumn("kept", F.row_number().over(per_path) == 1)
    taken = ranked.select("file_id", "key", "score", F.when(F.col("kept"), action).otherwise("skip").alias("action"), F.when(F.col("kept"), F.col("dest_path")).otherwise("").alias("dest_path"), F.when(F.col("kept"), "best quality").otherwise("path collision").alias("reason"), (~F.col("kept")).alias("collided"))
    lost = marked.where("won is null").select("file_id", "key", "score", F.lit("skip").alias("action"), F.lit("").alias("dest_path"), F.lit("duplicate").alias("reason"), F.lit(False).alias("collided"))
    return taken.unionByName(lost)


def meta_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).where("status = 'meta_ok'")
