"""Problem 4: text that was decoded with the wrong character encoding.

A text is re-encoded under each legacy encoding it may have been read in and strictly decoded as
each encoding it may have been written in; a result is taken when it lowers the cost of garbling
by a margin, and the search repeats for nested layers. Texts that no round trip restores still
count as garbled where they hold what no writing holds (control characters, replacement signs
inside words, box-drawing or lone mathematical signs between letters).

Defined results: null, empty and pure ASCII texts without a replacement sign are never garbled; of
unparseable JSON the strings before the break count; keys of JSON objects are no texts; a file
repeated in the table gives one row per field.
"""

from __future__ import annotations

import codecs
import re as _re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from tonewright.llm.confusables import plain_letters
from tonewright.sources.tables import table

MARGIN = 1.9
FIELDS = ("tag_artist", "tag_album", "tag_title", "raw_tags_json")

# Letters of Russian per 1000 letters (fixed values).
RUSSIAN = {"о": 110, "е": 85, "а": 80, "и": 74, "н": 67, "т": 63, "с": 55, "р": 47, "в": 45, "л": 44, "к": 35, "м": 32, "д": 30, "п": 28, "у": 26, "я": 20, "ы": 19, "ь": 17, "г": 17, "з": 16, "б": 16, "ч": 14, "й": 12, "х": 10, "ж": 9, "ш": 7, "ю": 6, "ц": 5, "щ": 4, "э": 3, "ф": 3, "ъ": 0.4, "ё": 0.4}
_VOWELS = frozenset("аеёиоуыэюя")

# The encodings a text may have been read in, and those it may have been written in (fixed values).
READ_AS = ("mac_roman", "cp437", "cp850", "cp1252", "cp1251", "koi8_r", "cp866", "shift_jis", "gbk")
WRITTEN_IN = ("utf_8", "cp1252", "cp1251", "koi8_r", "cp866", "mac_roman", "cp437", "cp850", "shift_jis", "euc_jp", "gbk")
_WIDE = frozenset({"shift_jis", "euc_jp", "gbk"})

_BROKEN = regex.compile(r"[\x80-\x9f�￾￿]")
_LOST = regex.compile(r"(?<=\p{L})\?(?=\p{Ll})|(?<=\p{Lu}\p{Lu})\?(?=\p{Lu})|(?:^|(?<=[\s\"(\[&]))\?(?=\p{L})")
_SIGN = r"¢-©¬®-¶¸¹¼-¾×÷ƒˆ-˝†-•‰‹›‚„⁄ⁿ₧€№™Ω∀-⏿─-◿ﬁﬂ"
_SUSPECT = regex.compile(rf"(?<=[\p{{L}}{_SIGN}])[{_SIGN}¡¿“”‘ªº«»…·–—](?=[\p{{L}}{_SIGN}])|(?<=[\p{{L}}{_SIGN}])[{_SIGN}]|[{_SIGN}](?=[\p{{L}}{_SIGN}])|(?<=\p{{L}})[¡¿]")
_CASE = regex.compile(r"(?<=\p{Ll})[À-ÞŒŠŸŽ](?![\p{Lu}])|(?<=\p{Lu}\p{Lu})[à-ÿœšž](?=\p{Lu})|(?<=\p{Lu})ÿ(?=\p{Lu})")
_SHARP = regex.compile(r"(?<![aeiouyäöüAEIOUYÄÖÜ])ß|(?<=\p{Lu})ß(?=\p{Lu})")
_RUN = regex.compile(r"(?<=[À-ɏ])[À-ɏ]")
_MARK = regex.compile(r"(?<=[\p{Latin}\p{Cyrillic}])[̀-ͯ]")
_BLANK = regex.compile(r"(?<=\p{L})[\xa0\xad](?=\p{L})")
_RARE = regex.compile(r"[\u0180-\u024f\u0250-\u02af]")
_POINT = regex.compile(r"[«»“”‘’…–—·]")
_ACCENT = regex.compile(r"[À-ɏ]")
_MIXED = regex.compile(r"(?<=\p{Latin})[\p{Greek}\p{Cyrillic}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]|(?<=[\p{Greek}\p{Cyrillic}\p{Han}\p{Hiragana}\p{Katakana}])\p{Latin}|(?<=\p{Greek})\p{Cyrillic}|(?<=\p{Cyrillic})\p{Greek}")
_HARD = regex.compile(rf"[ˆ-˝∀-⋿⌐⌠⌡─-◿](?=\p{{L}})|(?<=\p{{L}})[ˆ-˝∀-⋿⌐⌠⌡─-◿]|[Â-Å][ -¿†-•‰‹›‚„€™]")
_CYRILLIC = regex.compile(r"\p{Cyrillic}+")
_EAST = regex.compile(r"[\p{Han}\p{Hangul}\p{Katakana}\p{Hiragana}ー　-〿]")
_HALF_KANA = regex.compile(r"[｡-ﾟ]")
_PRIVATE = regex.compile(r"[\p{Co}\p{Cn}]")


def _russian_cost(word: str) -> float:
    low = word.lower()
    if not all(c in RUSSIAN for c in low):
        return 2.0 * sum(c not in RUSSIAN for c in low) + 0.3 * len(low)
    rare = sum(max(0.0, 1.0 - RUSSIAN[c] / 12) for c in low)
    hard = low[0] in "ъьы"
    without = 0 if len(low) < 4 or any(c in _VOWELS for c in low) else 2
    run = max((len(x) for x in _re.split("[аеёиоуыэюя]+", low)), default=0)
    upper = sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]))
    return rare + 3 * hard + without + max(0, run - 3) + (2.0 * (upper - 1) if upper > 1 else 0.0) + (0.5 if upper == 1 else 0.0)


def garbling_cost(text: str) -> float:
    """How unlike writing the text is; ordinary texts of any script stay well below 2."""
    runs = len(_RUN.findall(text))
    cost = 2.0 * runs if runs > 1 else 0.7 * runs
    cost += 8.0 * len(_BROKEN.findall(text)) + 4.0 * len(_SUSPECT.findall(text)) + 3.0 * len(_CASE.findall(text)) + 3.0 * len(_SHARP.findall(text))
    cost += 1.5 * len(_MARK.findall(text)) + 4.0 * len(_BLANK.findall(text)) + 1.5 * len(_RARE.findall(text)) + 0.3 * len(_POINT.findall(text)) + 0.25 * len(_ACCENT.findall(text)) + 3.0 * len(_MIXED.findall(text)) + 1.5 * len(_HALF_KANA.findall(text)) + 6.0 * len(_PRIVATE.findall(text))
    cost += sum(map(_russian_cost, _CYRILLIC.findall(text)))
    east = _EAST.findall(text)
    return cost + 0.15 * len(east)


def _to_bytes(text: str, encoding: str) -> bytes | None:
    if encoding == "cp1252":  # with the five bytes that it leaves undefined, as browsers and old players read it
        out = bytearray()
        for c in text:
            o = ord(c)
            if o < 256 and not (0x80 <= o < 0xA0 and c not in _UNDEFINED):
                out.append(o)
            elif 0x80 <= o < 0xA0:
                out.append(o)
            else:
                try:
                    out += c.encode("cp1252")
                except UnicodeEncodeError:
                    return None
        return bytes(out)
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        return None


_UNDEFINED = frozenset("\x81\x8d\x8f\x90\x9d")


def _decode(data: bytes, encoding: str) -> str | None:
    try:
        out = codecs.decode(data, encoding)
    except (UnicodeDecodeError, ValueError):
        return None
    return out


def _step(text: str, cost: float) -> tuple[str, float] | None:
    """The cheapest round trip of one layer, if it lowers the cost by the margin.

    Bytes that form strict UTF-8 by chance are rare, so UTF-8 goes first and there a lower cost is enough.
    """
    coded = [(read, data) for read in READ_AS if (data := _to_bytes(text, read)) is not None and not data.isascii()]
    for group, margin in ((WRITTEN_IN[:1], 0.4), (WRITTEN_IN[1:], MARGIN)):
        best: tuple[str, float] | None = None
        for read, data in coded:
            for written in group:
                if written == read or read in _WIDE and written != "utf_8":
                    continue
                out = _decode(data, written)
                if out is None or out == text:
                    continue
                now = garbling_cost(out)
                if now <= cost - margin and (best is None or now < best[1] - 1e-9):
                    best = out, now
        if best is not None:
            return best
    return None


@lru_cache(maxsize=20_000)
def repair(text: str) -> tuple[bool, str | None]:
    """(Is the text garbled?, its original text or None where that can't be restored)."""
    if text.isascii():
        return bool(_LOST.search(text)), None
    # letters that merely look Latin, special blanks and ligatures are another problem and no sign of a false decoding
    cost, now, found = garbling_cost(plain_letters(text).translate(_ORDINARY)), text, False
    lost = bool(_LOST.search(text)) or "�" in text
    while True:  # each layer lowers the cost by a margin, so there is an end
        if cost < 1.2 and not found:
            break
        step = _step(now, cost)
        if step is None:
            break
        (now, cost), found = step, True
    if found:
        return True, None if _BROKEN.search(now) or _LOST.search(now) else now
    return lost or bool(_BROKEN.search(text) or _HARD.search(text)), None


_ORDINARY = {0xA0: " ", 0xAD: None, 0xFB01: "fi", 0xFB02: "fl"}
_STRINGS = regex.compile(r'"((?:[^"\\]|\\.)*+)(?:"(\s*:)?|$)')
_ESCAPE = regex.compile(r'\\(?:u([0-9a-fA-F]{4})|(.))')


def _unescape(text: str) -> str:
    if "\\" not in text:
        return text
    plain = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else {"n": "\n", "t": "\t", "r": "\r", "b": "", "f": ""}.get(m[2], m[2]), text)
    return plain.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def json_texts(raw: str) -> list[str]:
    """The string values of a JSON text, also of one that breaks off."""
    return [_unescape(m[1]) for m in _STRINGS.finditer(raw) if not m[2]]


def repair_json(raw: str) -> tuple[bool, str | None]:
    garbled, texts = False, []
    for text in json_texts(raw):
        bad, fixed = repair(text)
        garbled |= bad
        if bad and fixed is not None:
            texts.append(fixed)
    return garbled, "\n".join(texts) if texts else None


@arrow_udf(StringType())
def repaired(texts: pa.Array, is_json: pa.Array) -> pa.Array:
    """Null where the text is sound, '' where it is garbled beyond repair, else the original text (of JSON: its repaired texts by line)."""
    out = []
    for text, json in zip(texts.to_pylist(), is_json.to_pylist()):
        bad, fixed = (False, None) if text is None else repair_json(text) if json else repair(text)
        out.append((fixed or "") if bad else None)
    return pa.array(out, pa.string())


def suspect(name: str) -> Column:
    """The texts that need a look: any beyond ASCII, an escape, or a question mark before a letter."""
    return F.col(name).rlike(r"[^\x00-\x7f]|\\u|\?\p{L}")


def long_fields(spark: SparkSession, folder: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows of (file_id, field, value) for the fields that need a look; repeated files repeat."""
    m = table(spark, folder, "metadata", "file_id", *fields)
    wanted = F.array(*(F.when(suspect(c), F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))) for c in fields))
    return m.where(F.col("file_id").isNotNull()).select("file_id", F.explode(wanted).alias("x")).where("x is not null").select("file_id", "x.field", "x.value")


def garbled_fields(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file and garbled field: value and restored ('' where it can't be)."""
    rows = long_fields(spark, folder, FIELDS).withColumn("restored", repaired("value", F.col("field") == "raw_tags_json")).where("restored is not null")
    return rows.groupBy("file_id", "field").agg(F.min("value").alias("value"), F.min("restored").alias("restored"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The files and fields whose text shows a false decoding."""
    return garbled_fields(spark, folder).select("file_id", "field")


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled values with their original text; null where it can't be restored."""
    return garbled_fields(spark, folder).select("file_id", "field", "value", F.nullif("restored", F.lit("")).alias("restored"))


QUERIES = {"p4_found": p4_found, "p4_restored": p4_restored}
SQL: dict[str, str] = {}
