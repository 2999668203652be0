"""Problem 5: the best representative of each duplicate group.

Members are reduced to one row per group and file, ranked by quality, losslessness, bitrate,
completeness, trust and recency with the file id as the last tie-break, and the top of a window is
kept. Before the window ranks anything, rows that agree in all ranked values are counted together,
and Spark's window group limit keeps one row per group and task before the shuffle, so a group
with a third of all rows costs no more than its share.

Defined results: a missing value (null, '' or 0 in tag_track and bitrate_kbps) is worst; members
without a metadata row count as files without tags; repeated rows are one member, with the better
value where they differ; a null cluster_key or file_id is no member; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.sources.checkpoints import cut
from tonewright.sources.tables import table

TEXTS = ("tag_artist", "tag_album", "tag_title", "tag_albumartist", "tag_date")
RANKED = ("q", "l", "b", "filled")


def filled(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False)).cast("int")


def file_values(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file_id of metadata with the values that are ranked; a repeated file keeps its best values."""
    m = table(spark, folder, "metadata", "file_id", "lossless", "bitrate_kbps", "tag_track", *TEXTS)
    count = sum((filled(t) for t in TEXTS), F.coalesce(F.col("tag_track") != 0, F.lit(False)).cast("int"))
    rows = m.select("file_id", F.coalesce(F.col("lossless").cast("int"), F.lit(-1)).alias("l"), F.when(F.col("bitrate_kbps") != 0, F.col("bitrate_kbps")).alias("b"), count.alias("filled"))
    return rows.groupBy("file_id").agg(F.max("l").alias("l"), F.max(F.coalesce("b", F.lit(-1))).alias("b"), F.max("filled").alias("filled"))


def file_times(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, changed): when a file was last changed, by its latest scan; null where no scan tells."""
    f = table(spark, folder, "files", "file_id", "mtime_unix", "last_update_at").where("file_id is not null and mtime_unix is not null and last_update_at is not null")
    return f.groupBy("file_id").agg(F.max_by("mtime_unix", F.struct("last_update_at", "mtime_unix")).alias("changed"))


def members(spark: SparkSession, folder: str) -> DataFrame:
    """One row per cluster_key and file_id: q, l, b, filled (missing is worst) and preferred."""
    c = table(spark, folder, "cluster_members", "cluster_key", "file_id", "quality_score", "preferred").where(F.col("cluster_key").isNotNull() & F.col("file_id").isNotNull())
    worst = F.lit(float("-inf"))
    score = F.when(F.isnan("quality_score"), worst).otherwise(F.coalesce("quality_score", worst))
    one = c.groupBy("file_id", "cluster_key").agg(F.max(score).alias("q"), F.max(F.coalesce("preferred", F.lit(False))).alias("preferred"))
    joined = one.join(file_values(spark, folder), "file_id", "left")
    return joined.select("cluster_key", "file_id", "q", F.coalesce("l", F.lit(-1)).alias("l"), F.coalesce("b", F.lit(-1)).alias("b"), F.coalesce("filled", F.lit(0)).alias("filled"), "preferred")


def recent_members(spark: SparkSession, folder: str) -> DataFrame:
    """The members with the time of their last change; a missing time is the oldest."""
    joined = members(spark, folder).join(file_times(spark, folder), "file_id", "left")
    return joined.withColumn("changed", F.coalesce("changed", F.lit(-(1 << 62))))


def best_member(rows: DataFrame, *trust: str) -> DataFrame:
    """The top row of each cluster_key: the ranked values, then the columns of trust and recency, then the smallest file_id."""
    order = Window.partitionBy("cluster_key").orderBy(*(F.col(c).desc() for c in (*RANKED, *trust)), F.col("file_id"))
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The file that is no worse than each other file of its cluster in all four values and better than each in one."""
    # files that agree in all four values count together, before any shuffle by cluster
    values = cut(members(spark, folder).groupBy("cluster_key", *RANKED).agg(F.min("file_id").alias("file_id"), F.count("*").alias("n")))
    top = best_member(values)
    groups = values.groupBy("cluster_key").agg(*(F.max(c).alias(f"most_{c}") for c in RANKED), F.sum("n").alias("files"))
    best = top.join(groups, "cluster_key").where("n = 1 and files > 1")
    for c in RANKED:
        best = best.where(F.col(c) == F.col(f"most_{c}"))
    return best.select("cluster_key", "file_id")


def p5_survivor(spark: SparkSession, folder: str) -> DataFrame:
    """One surviving file for every cluster_key that has members, with the values it won by; missing values are null."""
    top = best_member(recent_members(spark, folder), "preferred", "changed")
    none = F.lit(None)
    return top.select("cluster_key", "file_id", F.when(F.col("q") != float("-inf"), F.col("q")).otherwise(none).alias("quality_score"), F.when(F.col("l") >= 0, F.col("l") == 1).otherwise(none).alias("lossless"), F.when(F.col("b") >= 0, F.col("b").cast("bigint")).otherwise(none).alias("bitrate_kbps"), F.col("filled").cast("bigint").alias("filled"), "preferred")


def p5_record(spark: SparkSession, folder: str) -> DataFrame:
    """One record for every cluster_key, built field by field: each tag from the best-ranked file that has it."""
    fields = (*TEXTS, "tag_track")
    m = table(spark, folder, "metadata", "file_id", *fields)
    tags = m.groupBy("file_id").agg(*(F.max(F.when(F.col(c) != (0 if c == "tag_track" else ""), F.col(c))).alias(c) for c in fields))
    rows = recent_members(spark, folder).join(tags, "file_id", "left")
    rank = F.struct("q", "l", "b", "filled", "preferred", "changed", (-F.col("file_id")).alias("at"))
    return rows.groupBy("cluster_key").agg(F.count("*").alias("files"), F.max_by("file_id", rank).alias("file_id"), *(F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in fields)).withColumn("tag_track", F.col("tag_track").cast("bigint"))


QUERIES = {"p5_found": p5_found, "p5_survivor": p5_survivor, "p5_record": p5_record}

_FILES = """files_of as (select file_id, max(coalesce(lossless::int, -1)) l, max(case when bitrate_kbps <> 0 then bitrate_kbps else -1 end) b_, max(
 (coalesce(tag_artist, '') <> '')::int + (coalesce(tag_album, '') <> '')::int + (coalesce(tag_title, '') <> '')::int + (coalesce(tag_albumartist, '') <> '')::int
 + (coalesce(tag_date, '') <> '')::int + (coalesce(tag_track, 0) <> 0)::int) filled from metadata group by file_id),
 one as (select cluster_key, file_id, max(coalesce(quality_score, '-infinity'::double)) q, bool_or(coalesce(preferred, false)) preferred from cluster_members
 where cluster_key is not null and file_id is not null group by all),
 times as (select file_id, arg_max(mtime_unix, (last_update_at, mtime_unix)) changed from files where file_id is not null and mtime_unix is not null and last_update_at is not null group by 1),
 mem as (select cluster_key, one.file_id, q, coalesce(l, -1) l, coalesce(b_, -1) b, coalesce(filled, 0) filled, preferred, coalesce(changed, -4611686018427387904) changed from one left join files_of using (file_id) left join times using (file_id))"""

SQL = {
    "p5_found": f"""with {_FILES} select cluster_key, file_id from mem x where exists (select 1 from mem y where y.cluster_key = x.cluster_key and y.file_id <> x.file_id)
 and not exists (select 1 from mem y where y.cluster_key = x.cluster_key and y.file_id <> x.file_id and not
 (x.q >= y.q and x.l >= y.l and x.b >= y.b and x.filled >= y.filled and (x.q > y.q or x.l > y.l or x.b > y.b or x.filled > y.filled)))""",
    "p5_survivor": f"""with {_FILES} select cluster_key, file_id, case when q <> '-infinity'::double then q end quality_score, case when l >= 0 then l = 1 end lossless,
 case when b >= 0 then b::bigint end bitrate_kbps, filled::bigint filled, preferred from mem
 qualify row_number() over (partition by cluster_key order by q desc, l desc, b desc, filled desc, preferred desc, changed desc, file_id) = 1""",
    "p5_record": f"""with {_FILES}, tags as (select file_id, max(nullif(tag_artist, '')) tag_artist, max(nullif(tag_album, '')) tag_album, max(nullif(tag_title, '')) tag_title,
 max(nullif(tag_albumartist, '')) tag_albumartist, max(nullif(tag_date, '')) tag_date, max(nullif(tag_track, 0)) tag_track from metadata group by file_id),
 r as (select mem.*, tag_artist, tag_album, tag_title, tag_albumartist, tag_date, tag_track from mem left join tags using (file_id)),
 o as (select *, row_number() over (partition by cluster_key order by q desc, l desc, b desc, filled desc, preferred desc, changed desc, file_id) place from r)
 select cluster_key, count(*) files, arg_min(file_id, place) file_id, arg_min(tag_artist, place) filter (tag_artist is not null) tag_artist,
 arg_min(tag_album, place) filter (tag_album is not null) tag_album, arg_min(tag_title, place) filter (tag_title is not null) tag_title,
 arg_min(tag_albumartist, place) filter (tag_albumartist is not null) tag_albumartist, arg_min(tag_date, place) filter (tag_date is not null) tag_date,
 (arg_min(tag_track, place) filter (tag_track is not null))::bigint tag_track from o group by cluster_key""",
}
