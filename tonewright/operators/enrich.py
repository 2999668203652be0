"""Filling missing tags from file names, folders and siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions.paths import base_name, folder, parent, stem
from tonewright.functions.text import trimmed

DISC_FOLDER = r"(?i)^(disc|cd|disk)\s*\d+\z"
SPECIAL_FOLDERS = ("_Singles", "Various Artists", "Unknown Artist", "Unknown Album", ".", "..")


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def parsed_filename(path: Column) -> dict[str, Column]:
    """track, artist, title and confidence from the file name: 'n - artist - title', 'n - title', 'artist - title', else the name."""
    name = stem(path)
    full, short, pair = r"^(\d+)\s*[-_.]\s*(.+?)\s*[-_.]\s*(.+)\z", r"^(\d+)\s*[-_.]\s*(.+)\z", r"^(.+?)\s*[-_.]\s*(.+)\z"
    is_full, is_short, is_pair = name.rlike(full), name.rlike(short), name.rlike(pair)
    get = lambda p, g: trimmed(F.regexp_extract(name, p, g))
    track = F.when(is_full, _number(get(full, 1))).when(is_short, _number(get(short, 1))).otherwise(0)
    artist = F.when(is_full, get(full, 2)).when(is_short, "").when(is_pair, get(pair, 1)).otherwise("")
    title = F.when(is_full, get(full, 3)).when(is_short, get(short, 2)).when(is_pair, get(pair, 2)).otherwise(name)
    title = F.when(title == "", name).otherwise(title)
    base = F.when(is_full, 0.8).when(is_short, 0.7).when(is_pair, 0.5).otherwise(0.2)
    apart = F.contains(name, F.lit(" - ")) | F.contains(name, F.lit(" _ "))
    sure = F.least(F.lit(1.0), F.least(F.lit(1.0), base + F.when(track > 0, 0.15).otherwise(0.0)) + F.when(apart, 0.05).otherwise(0.0))
    return {"track": track, "artist": artist, "title": title, "confidence": F.round(sure, 2)}


def inferred_from_path(path: Column) -> dict[str, Column]:
    """album, artist, year and disc from the folders, a disc folder skipped."""
    one, two, three = folder(path, 0), folder(path, 1), folder(path, 2)
    is_disc = one.rlike(DISC_FOLDER)
    raw = F.when(is_disc, two).otherwise(one)
    before, behind = r"^(\d{4})\s*[-_.]\s*(.+)\z", r"^(.+?)\s*\((\d{4})\)\z"
    album = F.when(raw.rlike(before), trimmed(F.regexp_extract(raw, before, 2))).when(raw.rlike(behind), trimmed(F.regexp_extract(raw, behind, 1))).otherwise(raw)
    year = F.when(raw.rlike(before), F.regexp_extract(raw, before, 1)).when(raw.rlike(behind), F.regexp_extract(raw, behind, 2)).otherwise("")
    return {"album": album, "artist": F.when(is_disc, three).otherwise(two), "year": year, "disc": _number(F.regexp_extract(one, r"(?i)(disc|cd|disk)\s*(\d+)", 2))}


def year_album(c: Column) -> dict[str, Column]:
    p = r"^(\d{4})\s*-\s*(.+)\z"
    return {"album": trimmed(F.regexp_extract(c, p, 2)), "year": F.regexp_extract(c, p, 1)}


def disc_number(c: Column) -> Column:
    """The first of 'cd n', 'disc n' and 'disk n' in that order, else 0."""
    found = [F.regexp_extract(c, rf"(?i){word}\s*(\d+)", 1).try_cast("int") for word in ("cd", "disc", "disk")]
    return F.coalesce(*found, F.lit(0))


def track_filename(name: Column) -> dict[str, Column]:
    """Track and title of 'n - t', 'n t', 'track n - t' and 'x - n - t'; 0 and '' where none fits."""
    base = F.regexp_replace(name, r"\.[^.]*\z", "")
    patterns = (r"^(\d{1,3})\s*-\s*(.+)\z", r"^(\d{1,3})\s+(.+)\z", r"(?i)track\s+(\d{1,3})\s*-\s*(.+)\z", r"-\s*(\d{1,3})\s*-\s*(.+)\z")
    track, title = F.lit(0), F.lit("")
    for p in reversed(patterns):
        hit = base.rlike(p)
        track = F.when(hit, F.regexp_extract(base, p, 1).try_cast("int")).otherwise(track)
        title = F.when(hit, trimmed(F.regexp_extract(base, p, 2))).otherwise(title)
    return {"track": track, "title": title}


def is_numeric_folder(c: Column) -> Column:
    return c.rlike(r"^\d+\z")


def is_special_folder(c: Column) -> Column:
    return c.isin(*SPECIAL_FOLDERS)


def enriched(lib: DataFrame) -> DataFrame:
    """Missing tags from the file name where it is sure enough, else from the folders; filled lists what was filled."""
    name, path = parsed_filename(F.col("src_path")), inferred_from_path(F.col("src_path"))
    out = lib.withColumns({f"_n_{k}": v for k, v in name.items()} | {f"_p_{k}": v for k, v in path.items()})
    sure = F.col("_n_confidence")
    artist = F.when(F.col("_n_artist") != "", F.col("_n_artist")).otherwise(F.col("_p_artist"))
    fills = {
        "tag_artist": ((F.col("tag_artist") == "") & (sure >= 0.5) & (artist != ""), artist),
        "tag_title": ((F.col("tag_title") == "") & (sure >= 0.3) & (F.col("_n_title") != ""), F.col("_n_title")),
        "tag_album": ((F.col("tag_album") == "") & (F.col("_p_album") != ""), F.col("_p_album")),
        "tag_date": ((F.col("tag_date") == "") & (F.col("_p_year") != ""), F.col("_p_year")),
        "tag_track": ((F.col("tag_track") == 0) & (F.col("_n_track") > 0), F.col("_n_track")),
        "tag_disc": ((F.col("tag_disc") == 0) & (F.col("_p_disc") > 0), F.col("_p_disc")),
    }
    filled = F.concat_ws(",", *(F.when(hit, F.lit(c)) for c, (hit, _) in fills.items()))
    return out.withColumns({"filled": filled} | {f"_v_{c}": F.when(hit, v).otherwise(F.col(c)) for c, (hit, v) in fills.items()}).withColumns({c: F.col(f"_v_{c}") for c in fills}).drop(*(f"_v_{c}" for c in fills), *(f"_n_{k}" for k in name), *(f"_p_{k}" for k in path))


def enriched_from_folders(lib: DataFrame) -> DataFrame:
    """Missing tags from the two folders above the file and its name; filled lists what was filled, in order."""
    album_part, artist_part = folder(F.col("src_path"), 0), folder(F.col("src_path"), 1)
    named, numbered = year_album(F.col("_album")), track_filename(base_name(F.col("src_path")))
    plain = ~is_numeric_folder(F.col("_album")) & ~is_special_folder(F.col("_album")) & (F.col("_album") != "")
    out = lib.withColumns({"_album": album_part, "_artist": artist_part}).withColumns({"_named": named["album"], "_year": named["year"], "_track": numbered["track"], "_title": numbered["title"]})
    artist = (F.col("tag_artist") == "") & (F.col("_artist") != "") & ~is_numeric_folder(F.col("_artist")) & ~is_special_folder(F.col("_artist"))
    album = (F.col("tag_album") == "") & ((F.col("_named") != "") | plain)
    year = (F.col("tag_album") == "") & (F.col("_named") != "") & (F.col("tag_date") == "")
    disc = (F.col("tag_disc") == 0) & (disc_number(F.col("_album")) > 0)
    track = (F.col("tag_track") == 0) & (F.col("_track") > 0)
    title = (F.col("tag_title") == "") & (F.col("_title") != "")
    hits = {"artist_from_path": artist, "album_from_path": album, "year_from_path": year, "disc_from_path": disc, "track_from_filename": track, "title_from_filename": title}
    filled = F.concat_ws(",", *(F.when(hit, F.lit(name)) for name, hit in hits.items()))
    values = {"tag_artist": (artist, "_artist"), "tag_album": (album, F.when(F.col("_named") != "", F.col("_named")).otherwise(F.col("_album"))), "tag_date": (year, "_year"), "tag_disc": (disc, disc_number(F.col("_album"))), "tag_track": (track, "_track"), "tag_title": (title, "_title")}
    new = {f"_v_{c}": F.when(hit, F.col(v) if isinstance(v, str) else v).otherwise(F.col(c)) for c, (hit, v) in values.items()}
    return out.withColumns({"filled": filled} | new).withColumns({c: F.col(f"_v_{c}") for c in values}).drop(*new, "_album", "_artist", "_named", "_year", "_track", "_title")


def majority(lib: DataFrame, value: str) -> DataFrame:
    """(folder, value): of each folder the value that more than half of its files with one share."""
    counted = lib.where(F.col(value) != "").groupBy(parent(F.col("src_path")).alias("folder"), value).count()
    totals = counted.groupBy("folder").agg(F.sum("count").alias("total"), F.max_by(value, F.struct("count", value)).alias(value), F.max("count").alias("n"))
    return totals.where(F.col("n") * 2 > F.col("total")).select("folder", value, "n", "total")


def file_name(path: Column) -> Column:
    return base_name(path)
