"""Paths: parts of file names, destinations and their display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewright.functions.text import canonical_artist, let, planned_album, trimmed


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*\z", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def folder(path: Column, above: int = 0) -> Column:
    """The name of the folder that holds the file, or of one further up; '' if there is none."""
    return F.coalesce(F.get(F.reverse(F.split(path, "/")), F.lit(1 + above)), F.lit(""))


def first_bytes(c: Column, most: int) -> Column:
    """As many whole characters from the start as fit in that many bytes of UTF-8."""
    data = F.encode(c, "UTF-8")
    return F.when(F.octet_length(c) <= most, c).otherwise(F.coalesce(*(F.try_validate_utf8(F.substring(data, 1, most - k).cast("string")) for k in range(min(4, most + 1)))))


def last_bytes(c: Column, most: int) -> Column:
    """As many whole characters from the end as fit in that many bytes of UTF-8."""
    data, size = F.encode(c, "UTF-8"), F.octet_length(c)
    return F.when(size <= most, c).otherwise(F.coalesce(*(F.try_validate_utf8(F.substring(data, size - F.lit(most - k - 1), F.lit(most)).cast("string")) for k in range(min(4, most + 1)))))


def clean_path(c: Column) -> Column:
    """The shortest path that means the same: no empty or '.' parts, '..' taken back; '.' for none."""
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    rooted = F.startswith(c, F.lit("/"))

    def step(kept: Column, part: Column) -> Column:
        last = F.coalesce(F.get(kept, F.size(kept) - 1), F.lit(""))
        back = (part == "..") & (F.size(kept) > 0) & (last != "..")
        return F.when(back, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when((part == "..") & rooted, kept).otherwise(F.array_append(kept, part))

    path = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), path)).otherwise(F.when(path == "", ".").otherwise(path))


def normal_path(c: Column, case_sensitive: bool = False) -> Column:
    """A path as file systems compare it."""
    return clean_path(c) if case_sensitive else F.lower(clean_path(c))


def same_path(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    return normal_path(a, case_sensitive) == normal_path(b, case_sensitive)


def path_component(c: Column) -> Column:
    """A name without characters that file systems refuse; 'Unknown' if nothing is left."""

    def made(v: Column) -> Column:
        x = F.regexp_replace(F.translate(v, '/\\:*?"<>|!#@', "_" * 12), "_{2,}", "_")
        x = F.regexp_replace(trimmed(F.regexp_replace(x, "^_+", "")), r"^[.]+|[.]+\z", "")
        return F.regexp_replace(x, r"_+\z", "")

    def checked(y: Column) -> Column:
        cut = F.when(F.octet_length(y) > 200, F.regexp_replace(first_bytes(y, 200), r"[ _.]+\z", "")).otherwise(y)
        return F.when(y == "", "Unknown").otherwise(cut)

    return let(c, lambda v: F.when((v == "") | (v == "_Singles"), v).otherwise(let(made(v), checked)))


def year_of(date: Column) -> Column:
    return F.regexp_extract(date, r"(19\d\d|20\d\d)", 1)


def two_digits(n: Column) -> Column:
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def destination(root: str, c: dict[str, Column], compilation: Column) -> Column:
    """root/artist/[year - ]album/[Disc nn/][nn - ][artist - ]title.ext for the columns of a library row."""
    missing = lambda x, other: let(x, lambda y: F.when(y == "", other).otherwise(y))
    owner = canonical_artist(missing(c["tag_albumartist"], missing(c["tag_artist"], F.lit("Unknown Artist"))))
    artist = path_component(F.when(compilation, "Various Artists").otherwise(owner))
    album = missing(planned_album(c["tag_album"]), F.lit("_Singles"))
    year = let(year_of(c["tag_date"]), lambda y: F.when(y == "", "").otherwise(F.concat(y, F.lit(" - "))))
    album = path_component(F.concat(year, album))
    track, total = c["tag_track"], c["tag_track_total"]
    number = F.when((total >= 100) & (track < 100), F.concat(F.lit("0"), two_digits(track))).otherwise(two_digits(track))
    prefix = F.when(track > 0, F.concat(number, F.lit(" - "))).otherwise(F.lit(""))
    credit = F.when(compilation, F.concat(path_component(canonical_artist(missing(c["tag_artist"], F.lit("Unknown Artist")))), F.lit(" - "))).otherwise(F.lit(""))
    name = F.concat(prefix, credit, path_component(missing(c["tag_title"], stem(c["src_path"]))), extension(c["src_path"]))
    disc = F.when((c["tag_disc_total"] > 1) & (c["tag_disc"] > 0), F.concat(F.lit("Disc "), two_digits(c["tag_disc"]), F.lit("/"))).otherwise(F.lit(""))
    return F.concat(F.lit(root + "/"), artist, F.lit("/"), album, F.lit("/"), disc, name)


def shortened(path: Column, most: int) -> Column:
    """The middle of a path of too many bytes left out; a character that would be cut is left out as well."""
    keep = most // 2 - 2
    return F.when(F.octet_length(path) <= most, path).otherwise(F.concat(first_bytes(path, keep), F.lit("..."), last_bytes(path, keep)))


def byte_size(n: Column) -> Column:
    """1536 as '1.5 KB'."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate("KMGTPE", 1):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", F.bround(n / F.lit(float(1024**power)), 1)), F.lit(f" {unit}B"))).otherwise(out)
    return out


def minutes(ms: Column) -> Column:
    seconds = F.floor(ms / 1000).cast("bigint")
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), two_digits(seconds % 60))
