"""Rescans, listings, checks and the summary over a library and its plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.functions.paths import parent

AUDIO = ("container", "codec", "duration_ms", "sample_rate", "bit_depth", "bitrate_kbps", "channels", "lossless")


def rescan_candidates(files: DataFrame, errors_only: bool = False) -> DataFrame:
    """The files whose tags are to be read again: those read before and those that failed, or only the latter."""
    return files.where(F.col("status").isin(*(("error",) if errors_only else ("error", "meta_ok"))))


def reread(tags: DataFrame, probe: DataFrame) -> DataFrame:
    """One row per file of either reading: tags as the tag reader found them, empty or not, with the probe's audio values;
    files that only the probe could read keep its tags."""
    sounds = probe.select("file_id", F.lit(True).alias("_probed"), *(F.col(c).alias(f"_{c}") for c in AUDIO))
    read = tags.join(sounds, "file_id", "left").withColumns({c: F.when(F.col("_probed"), F.col(f"_{c}")).otherwise(F.col(c) if c in tags.columns else F.lit(None)) for c in AUDIO}).drop("_probed", *(f"_{c}" for c in AUDIO))
    return read.unionByName(probe.join(tags.select("file_id"), "file_id", "left_anti"), allowMissingColumns=True)


def in_folder(files: DataFrame, folder: str, statuses: tuple[str, ...] = ("meta_ok", "discovered")) -> DataFrame:
    """The files right in a folder, not in those below it."""
    return files.where((parent(F.col("src_path")) == folder.rstrip("/")) & F.col("status").isin(*statuses))


def listing(members: DataFrame, files: DataFrame, tags: DataFrame, plans: DataFrame, duplicates_only: bool = False, winners_only: bool = False) -> DataFrame:
    """Members with their file, tags and plan, one join for each; optionally only of keys with several files, and of
    those only the preferred member where there is one. A member without a file or plan isn't shown."""
    m = members.groupBy("cluster_key", "file_id").agg(F.max(F.coalesce("preferred", F.lit(False))).alias("preferred"), F.max("quality_score").alias("quality_score"))
    sizes = m.groupBy("cluster_key").agg(F.count("*").alias("size"), F.min(F.when(F.col("preferred"), F.col("file_id"))).alias("winner"))
    m = m.join(sizes, "cluster_key")
    if duplicates_only:
        m = m.where("size > 1")
    if winners_only:
        m = m.where("size = 1 or winner is null or file_id = winner")
    out = m.join(files.select("file_id", "src_path", "size_bytes"), "file_id").join(plans.select("file_id", "action", "dest_path", "reason"), "file_id").join(tags.select("file_id", "codec", "bitrate_kbps", "lossless"), "file_id", "left")
    return out.select("cluster_key", "file_id", "preferred", "quality_score", "size", "src_path", "size_bytes", "codec", "bitrate_kbps", "lossless", "action", "dest_path", "reason")


def first_errors(executions: DataFrame, most: int = 10) -> DataFrame:
    """(file_id, error, more) of the first failed executions; more: how many others failed."""
    failed = executions.where("error <> ''")
    total = failed.agg(F.lit(1).alias("_one"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return failed.orderBy("file_id").limit(most).select("file_id", "error", F.lit(1).alias("_one")).join(total, "_one").drop("_one")


def by_completion(executions: DataFrame) -> DataFrame:
    """Executions, the latest first."""
    return executions.orderBy(F.col("completed_at").desc_nulls_last(), "file_id")


def children(tree: DataFrame) -> DataFrame:
    """(parent, name, place) for rows of (prefix, is_file): folders before files, then by name without case."""
    t = tree.select(F.when(F.contains("prefix", F.lit("/")), parent(F.col("prefix"))).otherwise("").alias("parent"), F.regexp_extract("prefix", r"([^/]*)\z", 1).alias("name"), "is_file")
    return t.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy("is_file", F.lower("name"), "name")))


def summary(files: DataFrame, plans: DataFrame, executions: DataFrame) -> DataFrame:
    """One row with the figures of a run, one aggregation for each table."""
    f = files.agg(F.lit(1).alias("_one"), F.count_if(F.col("status").isin("discovered", "meta_ok", "error", "executed")).alias("files_scanned"), F.count_if(F.col("status").isin("meta_ok", "executed")).alias("files_valid"), F.count_if(F.col("status") == "error").alias("files_with_errors"))
    keys = plans.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("action") != "skip").alias("kept"))
    k = keys.agg(F.lit(1).alias("_one"), F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 1).alias("duplicates"), F.coalesce(F.sum("kept"), F.lit(0)).alias("winners_planned"), F.coalesce(F.sum(F.col("n") - F.col("kept")), F.lit(0)).alias("skipped"))
    e = executions.agg(F.lit(1).alias("_one"), F.count_if("verify_ok").alias("files_executed"), F.count_if(~F.col("verify_ok") & (F.col("error") != "")).alias("files_failed"), F.coalesce(F.sum(F.when(F.col("verify_ok"), F.col("bytes_written"))), F.lit(0)).alias("bytes_written"))
    return f.join(k, "_one").join(e, "_one").drop("_one")


def report(files: DataFrame, plans: DataFrame, executions: DataFrame, tops: dict[str, DataFrame], most: int = 20) -> str:
    """The summary as Markdown: overview, clustering, planning, execution, then the top lists given."""
    s = summary(files, plans, executions).first().asDict()
    sections = {"Overview": ("files_scanned", "files_valid", "files_with_errors"), "Clustering": ("clusters", "singletons", "duplicates"), "Planning": ("winners_planned", "skipped"), "Execution": ("files_executed", "files_failed", "bytes_written")}
    out = ["# Summary"]
    for name, figures in sections.items():
        out += ["", f"## {name}", "", *(f"- **{x.replace('_', ' ').capitalize()}**: {s[x]}" for x in figures)]
    for name, df in tops.items():
        rows = df.limit(most).collect()
        if rows:
            out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(str(v).replace("|", "\\|") for v in r) + " |" for r in rows)]
    return "\n".join(out) + "\n"


def checks(files: DataFrame, tags: DataFrame, members: DataFrame) -> DataFrame:
    """(check, level, n): what is wrong between the tables; ok where n is 0."""
    ids, tagged = files.select("file_id").distinct(), tags.select("file_id").distinct()
    found = [
        ("files without a path", files.where("src_path = ''"), "error"),
        ("files with errors", files.where("status = 'error'"), "warning"),
        ("read files without tags", files.where("status = 'meta_ok'").select("file_id").join(tagged, "file_id", "left_anti"), "error"),
        ("tags without a file", tagged.join(ids, "file_id", "left_anti"), "error"),
        ("members without a file", members.select("file_id").distinct().join(ids, "file_id", "left_anti"), "error"),
        ("keys without a preferred member", members.groupBy("cluster_key").agg(F.max(F.coalesce("preferred", F.lit(False))).alias("p")).where("not p"), "warning"),
    ]
    out = None
    for name, rows, level in found:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.when(F.col("n") > 0, level).otherwise("ok").alias("level"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def stale(files: DataFrame, members: DataFrame) -> bool:
    """Whether the newest read file changed more than a second after the oldest clustered one, so keys are to be made anew."""
    ok = files.where("status = 'meta_ok'")
    oldest = ok.join(members.select("file_id").distinct(), "file_id", "left_semi").agg(F.min("last_update_at").alias("t")).first().t
    newest = ok.agg(F.max("last_update_at").alias("t")).first().t
    return bool(oldest and newest and (newest - oldest).total_seconds() > 1)


def cleared(spark: SparkSession, path: str) -> None:
    """Empty a table but keep its columns."""
    from tonewright.sources.sinks import replace_table

    replace_table(spark.read.parquet(path).limit(0), path)
