"""Text rules for tags, as columns. Every step reads its input once, so that chains stay small."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewright.functions.unicode import nfc

WS = r"[\s\x0B\x85\p{Z}]"

# Words that mark a version in a title.
VERSION_WORDS = "remix|live|acoustic|demo|instrumental|radio|edit|extended|version|mix|remaster|deluxe|bonus|anniversary|edition|unplugged|session|concert|recording|alternate|original|single|album|explicit|clean|vocal|karaoke|cover"
TRAILING_WORDS = "remastered|remix|live|acoustic|demo|instrumental|unplugged"
VERSION_KINDS = {
    "live": ("live", "concert", "session"),
    "acoustic": ("acoustic", "unplugged"),
    "remix": ("remix", " mix", "edit", "dub", "bootleg", "mashup", "radio", "club", "extended"),
    "demo": ("demo", "rough", "alternate", "outtake", "unreleased"),
    "instrumental": ("instrumental", "karaoke", "backing track"),
}
# Artists written in capitals, words that stay small, endings and marks of releases.
CAPITAL_ARTISTS = {"ac/dc": "AC/DC", "acdc": "AC/DC", "ac_dc": "AC/DC", "abba": "ABBA", "mgmt": "MGMT", "mstrkrft": "MSTRKRFT", "unkle": "UNKLE"}
SMALL_WORDS = ("a", "an", "the", "and", "or", "but", "of", "in", "on", "at", "to", "for", "feat", "feat.", "ft", "ft.", "vs", "vs.")
PLAN_MARKERS = ("-WEB", "_WEB", " WEB", "(WEB)", "[WEB]", "-VINYL", "_VINYL", " VINYL", "(VINYL)", "[VINYL]", "(CD)", "[CD]")
INGEST_MARKERS = (*PLAN_MARKERS, " CD", "-EP", "_EP")
URL_MARKS = ("_soundcloud_", "_facebook_", "_myspace_", "www_", "blogspot", "djsoundtop")
COMPILATION_PATHS = ("various artists", "variousartists", "various_artists", "compilation", "mixed by", "compiled by", "compiled & mixed", "_singles")
COMPILATION_ALBUMS = ("various", "compilation", "mixed by")
TRANSIENT_ERRORS = ("timeout", "timed out", "connection reset", "connection refused", "connection aborted", "broken pipe", "no route to host", "network is unreachable", "network is down", "host is down", "temporary failure", "resource temporarily unavailable", "i/o error", "too many open files")


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def has_any(c: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(c, F.lit(part))
    return found


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def one_space(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(c, r"\s+", " "))


def without_punctuation(c: Column) -> Column:
    return F.replace(F.translate(c, "-_.,!?'\":;/", "  "), F.lit("&"), F.lit("and"))


def folded(c: Column) -> Column:
    """NFC, lower-cased and trimmed: what all comparisons of names start from."""
    return trimmed(F.lower(nfc(c)))


def artist_key(c: Column) -> Column:
    return one_space(without_punctuation(F.regexp_replace(folded(c), r"(?s)^(.*), the\z", "the $1")))


def without_version(c: Column) -> Column:
    for pattern in (rf"\s*\([^)]*?({VERSION_WORDS}).*?\)", rf"\s*\[[^\]]*?({VERSION_WORDS}).*?\]", rf"\s+({TRAILING_WORDS})\z"):
        c = F.regexp_replace(c, f"(?i)(?d){pattern}", "")
    return trimmed(c)


def title_key(c: Column) -> Column:
    return one_space(without_punctuation(without_version(folded(c))))


def album_key(c: Column) -> Column:
    return one_space(folded(c))


def tidy(c: Column) -> Column:
    return one_space(trimmed(nfc(c)))


def version_kind(c: Column) -> Column:
    """live before acoustic before remix (not in remasters and editions) before demo before instrumental, else studio."""
    t = F.lower(c)
    out = F.lit("studio")
    for kind in reversed(VERSION_KINDS):
        found = has_any(t, VERSION_KINDS[kind])
        if kind == "remix":
            found = found & ~has_any(t, ("remaster", "edition"))
        out = F.when(found, kind).otherwise(out)
    return out


def cluster_text(c: Column) -> Column:
    """Looser normalisation: brackets as blanks, '&' and '+' as 'and'."""
    c = F.replace(F.translate(trimmed(F.lower(c)), "()[]{}", "      "), F.lit("&"), F.lit("and"))
    return trimmed(F.regexp_replace(F.replace(c, F.lit("+"), F.lit("and")), " {2,}", " "))


def safe_filename(c: Column) -> Column:
    c = F.translate(nfc(c), "/\\:|\"*?!<>", "----'")
    return F.regexp_replace(one_space(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")), r"^[ .]+|[ .]+\z", "")


def capitalized(word: Column) -> Column:
    """First letter large; the rest small unless the word mixes cases."""
    mixed = word.rlike(r"\p{Ll}") & word.rlike(r"\p{Lu}")
    cased = word.rlike(r"\p{Ll}|\p{Lu}")
    rest = F.substring(word, F.lit(2), F.length(word))
    return F.concat(F.upper(F.substring(word, 1, 1)), F.when(mixed | ~cased, rest).otherwise(F.lower(rest)))


def title_case(c: Column) -> Column:
    words = F.filter(F.split(c, rf"{WS}+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*SMALL_WORDS), F.lower(w)).otherwise(capitalized(w))), " ")


def canonical_artist(c: Column) -> Column:
    """Consistent capitals: known exceptions, short names after '&' in capitals, else title case."""
    known = F.create_map(*(F.lit(x) for pair in CAPITAL_ARTISTS.items() for x in pair))

    def after_sign(bare: Column) -> Column:
        return F.concat(F.lit("&"), F.when(F.octet_length(bare) <= 3, F.upper(bare)).otherwise(title_case(bare)))

    def named(t: Column) -> Column:
        return F.coalesce(F.element_at(known, F.lower(t)), F.when(t.rlike("^_?&"), let(F.regexp_replace(t, "^_?&?", ""), after_sign)).otherwise(title_case(t)))

    return let(trimmed(nfc(c)), named)


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "()[]-" else c for c in text)


def planned_album(c: Column) -> Column:
    """The album as it goes into a path: no addresses, catalogue numbers and release marks; a leading year stays."""

    def cleaned(name: Column) -> Column:
        x = F.regexp_replace(name, r"[-\s]*[\(\[]?[A-Z0-9]{3,15}[\)\]]?[-\s]*", " ")
        for mark in PLAN_MARKERS:
            x = F.regexp_replace(x, _quoted(mark) + r"\z", "")
        x = one_space(F.regexp_replace(x, r"\[(?:www\.|by\s)[^\]]+\]", ""))
        x = F.regexp_replace(F.replace(F.replace(x, F.lit("--"), F.lit("-")), F.lit("__"), F.lit("_")), r"^[ \-_]+|[ \-_]+\z", "")
        return F.when(F.startswith(name, F.lit("http")) | has_any(name, ("_soundcloud_", "_facebook_", "www_")), "").otherwise(x)

    def parts(t: Column) -> Column:
        year = trimmed(F.regexp_extract(t, r"^(\d{4}\s*-\s*)", 1))
        return F.concat(year, F.lit(" "), let(trimmed(F.regexp_replace(t, r"^\d{4}\s*-\s*", "")), cleaned))

    return F.regexp_replace(let(trimmed(c), parts), r"^ |^.* \z", "")


def is_address(c: Column) -> Column:
    t = F.lower(c)
    return F.startswith(t, F.lit("http")) | has_any(t, URL_MARKS)


def ingested_album(c: Column) -> Column:
    """The album as it is read: release marks at the end, catalogue numbers in brackets, addresses and promo marks go."""
    x = c
    for mark in INGEST_MARKERS:
        x = F.regexp_replace(x, rf"(?s)^{WS}*(.*?){WS}*{_quoted(mark)}\z", "$1")
    x = F.regexp_replace(x, r"[-\s]*[\(\[]([A-Z0-9]{3,15})[\)\]][-\s]*", " ")
    x = F.regexp_replace(x, r"\[(?:www\.|by\s|http)[^\]]+\]", "")
    x = F.regexp_replace(x, r"(?i)\s*[-_\(]\s*(bootleg|promo|promotion)\s*[-_\)]?\s*", " ")
    x = one_space(F.regexp_replace(x, r"(?i)only\s+for\s+promotion", ""))
    return F.regexp_replace(F.replace(F.replace(x, F.lit("--"), F.lit("-")), F.lit("__"), F.lit("_")), r"^[ \-_]+|[ \-_]+\z", "")


def catalogue_number(c: Column) -> Column:
    return F.regexp_extract(c, r"[\(\[]([A-Z]{2,5}\d{3,5})[\)\]]", 1)


def featured_artist(c: Column) -> Column:
    return trimmed(F.regexp_extract(c, r"\s*[\(\[]\s*(?:feat\.?|ft\.?|featuring)\s+([^)\]]+)[\)\]]", 1))


def cleaned_artist(c: Column) -> Column:
    return F.when(F.lower(c) == "unknown artist", "").otherwise(trimmed(c))


def is_compilation(path: Column, album: Column) -> Column:
    return has_any(F.lower(path), COMPILATION_PATHS) | has_any(F.lower(album), COMPILATION_ALBUMS)


def is_transient(error: Column) -> Column:
    return has_any(F.lower(error), TRANSIENT_ERRORS)


def int_or_text(c: Column) -> Column:
    """An integer written as number or text, 0 where it is neither."""
    return F.coalesce(F.when(c.rlike(r"^[+-]?\d+\z"), c.try_cast("bigint")), F.lit(0)).cast("bigint")
