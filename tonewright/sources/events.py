"""Events of the pipeline, one kind for each step, with their levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels in rising order, and the kinds of events.
LEVELS = {"debug": 0, "info": 1, "warning": 2, "error": 3}
KINDS = ("scan", "meta", "cluster", "score", "plan", "execute", "skip", "duplicate", "conflict", "error", "auto_heal")
FIELDS = {"file_key": "string", "src_path": "string", "dest_path": "string", "cluster_key": "string", "quality_score": "double", "action": "string", "reason": "string", "bytes_written": "bigint", "error": "string", "extra": "map<string,string>"}


def event(rows: DataFrame, kind: str | Column, level: str | Column, extra: dict[str, Column] | None = None, **fields: Column) -> DataFrame:
    """One event per row: level, event and the fields given, all others null."""
    if isinstance(kind, str) and kind not in KINDS:
        raise ValueError(f"unknown event {kind}")
    if isinstance(level, str) and level not in LEVELS:
        raise ValueError(f"unknown level {level}")
    if unknown := set(fields) - set(FIELDS):
        raise ValueError(f"unknown fields {sorted(unknown)}")
    more = F.create_map(*(x for k, v in extra.items() for x in (F.lit(k), v.cast("string")))) if extra else F.lit(None)
    given = {**fields, "extra": more}
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(as_column(level).alias("level"), as_column(kind).alias("event"), *(given.get(f, F.lit(None)).cast(t).alias(f) for f, t in FIELDS.items()))


def scans(files: DataFrame) -> DataFrame:
    return event(files, "scan", "info", {"size_bytes": F.col("size_bytes")}, file_key=F.col("file_key"), src_path=F.col("src_path"))


def readings(library: DataFrame) -> DataFrame:
    """Files whose tags were read; those with an error at the level of errors."""
    return event(library, "meta", F.when(F.col("error") != "", "error").otherwise("info"), {"codec": F.col("codec"), "lossless": F.col("lossless")}, file_key=F.col("file_key"), src_path=F.col("src_path"), error=F.nullif("error", F.lit("")))


def clusterings(members: DataFrame) -> DataFrame:
    """``members``: file_key, src_path, key and size, the number of files of the key."""
    return event(members, "cluster", "info", {"member_count": F.col("size")}, file_key=F.col("file_key"), src_path=F.col("src_path"), cluster_key=F.col("key"))


def scorings(members: DataFrame) -> DataFrame:
    """``members``: file_key, src_path, key, score and preferred; only winners at the level of information."""
    return event(members, "score", F.when(F.col("preferred"), "info").otherwise("debug"), {"preferred": F.col("preferred")}, file_key=F.col("file_key"), src_path=F.col("src_path"), cluster_key=F.col("key"), quality_score=F.col("score"))


def plannings(plans: DataFrame) -> DataFrame:
    """``plans``: file_key, src_path, action, dest_path and reason."""
    return event(plans, F.when(F.col("action") == "skip", "skip").otherwise("plan"), "info", file_key=F.col("file_key"), src_path=F.col("src_path"), dest_path=F.nullif("dest_path", F.lit("")), action=F.col("action"), reason=F.col("reason"))


def executions(done: DataFrame) -> DataFrame:
    """``done``: file_key, src_path, dest_path, action, bytes_written and error."""
    return event(done, "execute", F.when(F.col("error") != "", "error").otherwise("info"), file_key=F.col("file_key"), src_path=F.col("src_path"), dest_path=F.col("dest_path"), action=F.col("action"), bytes_written=F.col("bytes_written"), error=F.nullif("error", F.lit("")))


def duplicates(sets: DataFrame) -> DataFrame:
    """``sets``: key, winner_path, losers and score of each key with more than one file."""
    return event(sets, "duplicate", "warning", {"loser_count": F.col("losers")}, src_path=F.col("winner_path"), cluster_key=F.col("key"), quality_score=F.col("score"))


def conflicts(plans: DataFrame) -> DataFrame:
    """``plans``: src_path, dest_path and reason of the winners that lost their path."""
    return event(plans, "conflict", "warning", src_path=F.col("src_path"), dest_path=F.col("dest_path"), reason=F.col("reason"))


def at_least(events: DataFrame, level: str = "info") -> DataFrame:
    """The events at or above a level."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}")
    rank = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    return events.where(F.element_at(rank, F.col("level")) >= LEVELS[level])
