"""Ad-hoc queries, roll-ups, top lists, the destination tree and simulated execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.sources.checkpoints import cut
from tonewright.sources.library import library

SORTS = {"path": ("src_path",), "artist": ("tag_artist", "tag_album", "tag_track"), "album": ("tag_album", "tag_track"), "title": ("tag_title",), "duration": ("-duration_ms",), "bitrate": ("-bitrate_kbps",)}


def _tests(artist: str = "", album: str = "", title: str = "", path: str = "", file_format: str = "", codec: str = "", lossless: bool = False, lossy: bool = False, empty_artist: bool = False, empty_album: bool = False, empty_title: bool = False, errors: bool = False) -> tuple[list[Column], list[Column]]:
    """Conditions on the tags, which hold for the table as it is as well, and on the files."""
    tags: list[Column] = []
    if artist:
        tags.append((F.col("tag_artist") == artist) | (F.col("tag_albumartist") == artist))
    tags += [F.col(c) == v for c, v in (("tag_album", album), ("format", file_format), ("codec", codec)) if v]
    tags += [F.col("tag_title").ilike(f"%{title}%")] if title else []
    tags += [F.col("lossless")] * lossless + [F.col("lossless").isNull() | ~F.col("lossless")] * lossy
    tags += [F.col(c).isNull() | (F.col(c) == "") for c, on in (("tag_artist", empty_artist), ("tag_album", empty_album), ("tag_title", empty_title)) if on]
    files = [F.col("src_path").ilike(f"%{path}%")] * bool(path) + [F.col("status") == "error"] * errors
    return tags, files


def query(lib: DataFrame, *, sort: str = "path", limit: int = 0, **conditions) -> DataFrame:
    """The files that meet all the conditions given; title and path are patterns of LIKE without case."""
    for test in (t for tests in _tests(**conditions) for t in tests):
        lib = lib.where(test)
    order = [F.col(c[1:]).desc() if c[0] == "-" else F.col(c) for c in SORTS.get(sort, SORTS["path"])]
    out = lib.orderBy(*order, "file_id")
    return out.limit(limit) if limit > 0 else out


def query_library(spark: SparkSession, folder: str, **arguments) -> DataFrame:
    """The same over the tables: conditions on tags reach the scan, and only the files that meet them are shuffled."""
    tags, _ = _tests(**{k: v for k, v in arguments.items() if k not in ("sort", "limit")})
    return query(library(spark, folder, tags), **arguments)


def placed(ordered: DataFrame) -> DataFrame:
    """The rows of a sorted table with their place from 1; one row per partition is brought together, never the table."""
    rows = cut(ordered.withColumn("_row", F.monotonically_increasing_id()))  # the partition above 33 bits of position
    sizes = rows.groupBy(F.shiftrightunsigned("_row", 33).alias("_part")).count()
    before = F.sum("count").over(Window.orderBy("_part")) - F.col("count")
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    place = F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumn("_part", F.shiftrightunsigned("_row", 33)).join(starts, "_part").withColumn("place", place).drop("_row", "_part", "_before")


def prefixes(paths: DataFrame, column: str = "dest_path", depth: int = 0) -> DataFrame:
    """(prefix, level, is_file, files) of the tree that the paths form, cut at a depth if one is given."""
    parts = F.filter(F.split(column, "/"), lambda p: (p != "") & (p != "."))
    every = paths.where(F.col(column) != "").select(parts.alias("parts")).withColumn("deep", F.size("parts"))
    last = F.when(F.lit(depth) > 0, F.least("deep", F.lit(depth))).otherwise(F.col("deep")) if depth else F.col("deep")
    rows = every.where("deep > 0").select("parts", "deep", F.explode(F.sequence(F.lit(1), last)).alias("level"))
    named = rows.select(F.array_join(F.slice("parts", F.lit(1), F.col("level")), "/").alias("prefix"), "level", (F.col("level") == F.col("deep")).alias("is_file"))
    return named.groupBy("prefix", "level").agg(F.min("is_file").alias("is_file"), F.count("*").alias("files"))


def executed(plans: DataFrame, files: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The executions a run would write: every placed file that isn't verified yet, its size, and whether it verifies."""
    todo = plans.where("action <> 'skip'")
    if done is not None:
        todo = todo.join(done.where("verify_ok").select("file_id"), "file_id", "left_anti")
    ran = todo.join(files.select("file_id", "size_bytes", "status", "error"), "file_id")
    fine = F.col("status") != "error"
    return ran.select("file_id", "action", "dest_path", F.when(fine, F.col("size_bytes")).otherwise(0).alias("bytes_written"), fine.alias("verify_ok"), F.when(fine, "").otherwise(F.col("error")).alias("error"))


def verified(source: DataFrame, target: DataFrame, mode: str = "size") -> DataFrame:
    """(file_id, verify_ok) of copies against their sources by size or hash; a missing copy fails. Mode none takes all as fine."""
    if mode not in ("size", "hash", "none"):
        raise ValueError(f"unknown verification {mode}")
    if mode == "none":
        return source.select("file_id", F.lit(True).alias("verify_ok"))
    column = "size_bytes" if mode == "size" else "sha1"
    copies = target.select("file_id", F.col(column).alias("_copy"))
    return source.join(copies, "file_id", "left").select("file_id", F.coalesce(F.col(column) == F.col("_copy"), F.lit(False)).alias("verify_ok"))


def doctor(tables: dict[str, DataFrame], needed: dict[str, tuple[str, ...]]) -> list[tuple[str, str, str]]:
    """(table, level, message): whether each table is there with the columns it needs."""
    out = []
    for name, columns in needed.items():
        missing = [c for c in columns if c not in tables[name].columns] if name in tables else list(columns)
        out.append((name, "error" if missing else "ok", ("no table" if name not in tables else "lacks " + ", ".join(missing)) if missing else f"{len(columns)} columns"))
    return out


def duplicate_sets(members: DataFrame, top: int = 20) -> DataFrame:
    """The keys with most losers."""
    return members.groupBy("key").agg((F.count("*") - 1).alias("losers")).where("losers > 0").orderBy(F.col("losers").desc(), "key").limit(top)


def top_errors(files: DataFrame, top: int = 10) -> DataFrame:
    return files.where("error <> ''").groupBy("error").count().orderBy(F.col("count").desc(), "error").limit(top).withColumnRenamed("count", "n")


def markdown(title: str, frames: dict[str, DataFrame], most: int = 50) -> str:
    """A report of small frames as Markdown."""
    out = [f"# {title}"]
    for name, df in frames.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(v) for v in row) + " |" for row in df.limit(most).collect()]
    return "\n".join(out) + "\n"
