"""Problem 2: text that looks the same but holds other characters.

The quick-check property of the Unicode data tells which characters normalisation may change: the
values beyond ASCII pass a quick check as a whole, and of those that fail it only the unstable
segments, with the character before them as context, are normalised and spliced into the unchanged
rest. The few characters of ordinary writing that NFKC would rewrite are listed and stay. Invisible
characters are dropped, special blanks and hyphens become ordinary ones, and words that mix scripts
through look-alike letters get one.

Defined results: null, empty and ASCII values are ordinary; joiners between letters that need them
(Arabic script, Indic scripts) stay; values garbled by a false decoding are left to that problem; a
file repeated in the table gives one row per field.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from tonewright.llm.confusables import plain_letters
from tonewright.llm.mojibake import repair
from tonewright.sources.tables import table

FIELDS = ("tag_artist", "tag_title", "tag_album")

_BLANKS = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_HYPHENS = "\u2010-\u2012\u2043\u2212\ufe58\ufe63\uff0d"
_HIDDEN = "\u00ad\u034f\u061c\u115f\u1160\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufe00-\ufe0f"

_JOINED = regex.compile(r"(?<=[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Gujarati}\p{Gurmukhi}\p{Oriya}\p{Sinhala}\p{Mongolian}])[\u200c\u200d](?=[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Gujarati}\p{Gurmukhi}\p{Oriya}\p{Sinhala}\p{Mongolian}])|(?<=\p{So})[\u200d\ufe0f]|[\u200d\ufe0f](?=\p{So})")
_HIDE = regex.compile(rf"[{_HIDDEN}]")
_BLANK = regex.compile(rf"[{_BLANKS}]")
_HYPHEN = regex.compile(rf"[{_HYPHENS}]")
_KEPT = "\ue100"

# Characters of ordinary writing though NFKC rewrites them (fixed values): dots, primes, numero, micro, letters of Catalan,
# Afrikaans, Thai, Lao and Tibetan. Superscripts, subscripts, fractions and accents that stand alone are ordinary as well.
ORDINARY = frozenset("\u2025\u2026\u2033\u2034\u2036\u2037\u2057\u2116\u2122\u00b5\u0140\u013f\u0149\u0e33\u0eb3\u0edc\u0edd\u0f0c\u0f77\u0f79")


@lru_cache(maxsize=1)
def _quick_check() -> tuple[frozenset[str], frozenset[str]]:
    """(unstable, kept): the characters whose quick check for NFC or NFKC is no or maybe, and those of them that stay as they are.

    No: normalising the character changes it. Maybe: it may combine with one before it or move among
    marks, which is so for the seconds of all composites, the later parts of Hangul and all marks that
    have a place in the order.
    """
    unstable, kept = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}, set()
    for code in range(sys.maxunicode + 1):
        if 0xAC00 <= code < 0xD7A4 or 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if unicodedata.combining(c):
            unstable.add(c)
        parts = unicodedata.decomposition(c)
        if not parts:
            continue
        if parts[0] != "<":
            first, *second = parts.split()
            unstable.update(chr(int(x, 16)) for x in second)
        if not unicodedata.is_normalized("NFC", c):
            unstable.add(c)
        elif not unicodedata.is_normalized("NFKC", c):
            tag = parts.split()
            (kept if c in ORDINARY or tag[0] in ("<super>", "<sub>", "<fraction>") or tag[1] == "0020" and c not in "\u00a0\u3000" and len(tag) > 2 else unstable).add(c)
    return frozenset(unstable), frozenset(kept)


def _stable(text: str) -> str:
    """The text with its unstable segments, each with the character before it, normalised and spliced in."""
    if unicodedata.is_normalized("NFKC", text):
        return text
    unstable, kept = _quick_check()
    out, done, i, n = [], 0, 0, len(text)
    while i < n:
        if text[i] not in unstable:
            i += 1
            continue
        start = i if i == done or text[i - 1] in kept else i - 1
        while i < n and text[i] in unstable:
            i += 1
        # first what is canonically the same, which may be a character that stays
        segment = unicodedata.normalize("NFC", text[start:i])
        if kept.isdisjoint(segment):
            segment = unicodedata.normalize("NFKC", segment)
        else:
            segment = "".join(c if c in kept else unicodedata.normalize("NFKC", c) for c in segment)
        out += [text[done:start], segment]
        done = i
    return "".join(out) + text[done:]


def canonical(text: str) -> str:
    """The text in the one form that compares equal to the ordinary one."""
    if text.isascii():
        return text
    kept = [m[0] for m in _JOINED.finditer(text)]
    if kept:
        text = _JOINED.sub(_KEPT, text)
    before = None
    while text != before:  # what is left may be hidden, or a changed letter combine with the mark after it
        before = text
        text = plain_letters(_stable(_HYPHEN.sub("-", _BLANK.sub(" ", _HIDE.sub("", text)))))
    if kept:
        parts = text.split(_KEPT)
        text = parts[0] + "".join(a + b for a, b in zip(kept, parts[1:]))
    return text


@arrow_udf(StringType())
def canonical_form(texts: pa.Array) -> pa.Array:
    """The canonical form where it differs and the text is not garbled by a false decoding, else null."""
    out = []
    for text in texts.to_pylist():
        form = None if text is None else canonical(text)
        out.append(None if form is None or form == text or repair(text)[0] else form)
    return pa.array(out, pa.string())


def unstable(name: str) -> Column:
    """What has to be looked at: ASCII is stable."""
    return F.col(name).rlike(r"[^\x00-\x7f]")


def lookalike_fields(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file and field that merely looks ordinary: value and canonical."""
    m = table(spark, folder, "metadata", "file_id", *FIELDS)
    wanted = F.array(*(F.when(unstable(c), F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))) for c in FIELDS))
    rows = m.where(F.col("file_id").isNotNull()).select("file_id", F.explode(wanted).alias("x")).where("x is not null").select("file_id", "x.field", "x.value")
    forms = rows.withColumn("canonical", canonical_form("value")).where("canonical is not null")
    return forms.groupBy("file_id", "field").agg(F.min("value").alias("value"), F.min("canonical").alias("canonical"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The files and fields whose value merely looks like ordinary text."""
    return lookalike_fields(spark, folder).select("file_id", "field")


def p2_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Those values with their canonical form."""
    return lookalike_fields(spark, folder)


QUERIES = {"p2_found": p2_found, "p2_canonical": p2_canonical}
SQL: dict[str, str] = {}
