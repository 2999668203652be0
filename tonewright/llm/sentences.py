r"""Problem 10: sentence boundaries across languages and scripts, in SQL expressions only.

Every mark that ends no sentence (in numbers, file names, addresses, initials, abbreviations,
ordinals, list marks, quoted speech) is replaced by one private-use character, so positions stay.
A second private-use character is then put after each mark that is left, with script-specific
rules for what may follow, and the text is split there. As the pieces hold every other character,
their running lengths are positions in the original text, from which the sentences are cut.

Quotations, brackets and addresses may be of any length; a quotation ends at a blank line at the latest.

Defined results: a null or blank text has no sentences; private-use characters of the text that
the masks use count as one ordinary character each; texts without any capital may start a sentence
with a small letter; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.sources.tables import table

MASK, CUT, BREAK = "\ue000", "\ue001", "\ue002"

# Abbreviations after which a point ends no sentence (fixed values), by language.
ABBREVIATIONS = {
    "en": "Dr Mr Mrs Ms Prof St Rev Hon Gen Col Sgt Capt Lt vs cf fig figs approx incl ed eds op no nos vol vols pt pts pp ca feat ft est i.e e.g",
    "de": "Nr bzw vgl Hr Fr Frl Bd Hrsg Abb Tel Str ggf evtl inkl sog Aufl z.B d.h u.a",
    "fr": "Mme Mlle MM Mgr Me av env ex chap c.-à-d",
    "es": "Sr Sra Srta Sres Dra Ud Uds EE UU pág págs núm ej aprox Gral",
    "ru": "стр см ср рис гл им ул пр др тыс млн млрд руб проф акад",
    "hi": "डॉ प्रो श्री सुश्री",
}
MONTHS = "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"
AFTER_ORDINAL = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Auflage Versuch Jahrhundert Mal Platz Kapitel Satz Tag Stück Aufnahme Ausgabe Band Album"
REPORTING = "said says asked asks replied replies answered cried whispered shouted called added insisted joked wrote recalled explained admitted muttered told remarked noted claimed declared exclaimed sighed laughed continued"

_ABBR = "|".join(sorted({a.replace(".", r"[.]") for x in ABBREVIATIONS.values() for a in x.split()}, key=len, reverse=True))
_W = r"[\s\u00a0\u2009\u202f\u3000]"
_T = ".!?…"
_MARK = r"[ \t]*(?:[-*•‣◦–—]|\d{1,3}[.)]|\d{1,3} [-–]|\p{L}\))[ \t]+"

# a line end between two list entries is a hard break; marks inside an entry end no sentence
_LIST_BREAK = rf"((?:\A|\n[ \t]*\n|\G(?!\A)){_MARK}[^\n]*+)\n(?={_MARK})"
_LIST_NUMBER = r"((?:\A|\n[ \t]*\n|\uE002)[ \t]*\d{1,3})\.(?=[ \t])"
_LIST_INNER = rf"((?:(?:\A|\n[ \t]*\n|\uE002)[ \t]*(?:[-*•‣◦–—]|\d{{1,3}}[)\uE000]|\d{{1,3}} [-–]|\p{{L}}\))[ \t]|\G(?!\A))[^{_T}\n\uE002]*+)[{_T}]"

# all begin with the point, so that a look at one character rules out most places
_POINTS = r"\.(?:" + "|".join(
    (
        r"(?=\d)(?<=[\d]\.)",  # decimals, versions
        r"(?=[\p{Ll}\d_@/])(?<=[\p{L}\d_)]\.)",  # file names, addresses, i.e.
        r"(?<=(?<![\p{L}\p{N}'’])\p{L}\.)",  # initials and other single letters
        r"(?<=[.]\p{L}\.)",
        rf"(?iu:(?<=(?<![\p{{L}}\p{{N}}])(?:{_ABBR})\.))",
        rf"(?={_W}*\d)(?<=\b(?:{'|'.join(MONTHS.split())})\.)",
        rf"(?={_W}+(?:(?:{'|'.join(AFTER_ORDINAL.split())})\b|\p{{Ll}}))(?<=(?<![\p{{L}}\d.,])\d{{1,2}}\.)",
        r"(?<=\p{L}\s{1,2}Oh\.)",
    )
) + ")"
_ADDRESS = r"((?:https?://|www(?=[.])|\G(?!\A))[^\s.?!]*+)[.?!](?=\S)"


def _within(chars: str) -> str:
    """Any characters but those given, up to a blank line, however many they are."""
    return rf"(?:[^{chars}\n]++|\n(?![ \t\r]*\n))*+"


# marks inside brackets and quotations of any length, but for the last one before a closing quote
_BRACKETS = r"([（『《](?=[^（）『』《》\n]*+[）』》])|\G(?!\A))([^（）『』《》。！？!?.…]*+)[。！？!?.…]"
_ROUND = rf"((?:(?<=[^\s.!?…)]\s?)\((?={_within('()')}\))|\G(?!\A)){_within('().!?…')})[.!?…]"
_CURLY = rf"((?:[“„](?={_within('“”„')}[”“])|\G(?!\A)){_within(f'“”„{_T}。！？')})[{_T}。！？](?![{_T}。！？]*[”“])"
_ANGLE = rf"((?:«(?={_within('«»')}»)|\G(?!\A)){_within(f'«»{_T}')})[{_T}](?![{_T}]*{_W}?»)"
_CORNER = rf"((?:「(?={_within('「」')}」)|\G(?!\A)){_within('「」。！？!?.…')})[。！？!?.…](?![。！？]*」\s*(?:\z|\n[ \t]*\n))"
_STRAIGHT = rf"((?:(?<![\p{{L}}\p{{N}}.!?,…;:])\"(?=[^\s\"]{_within(chr(34))}\")|\G(?!\A)){_within(chr(34) + _T)})[{_T}](?![{_T}]*\")"
# quoted speech with its reporting words after it
_REPORTED = "|".join(
    (
        rf"[{_T}](?=[{_T}]*[”\"]{_W}+(?:(?:\p{{Lu}}[\p{{L}}'’.-]*|&|of|the|and|de|\d+){_W}+)++(?:{'|'.join(REPORTING.split())})\b)",
        r"[。！？!?](?=”[^“”。！？\n]+?(?:问道|说道|答道|喊道|问|说|道)[。！？])",
        rf"[।!?.](?=”{_W}*[^“”।!?]+?(?:कहा|पूछा|बोला|बोली|बोले|बताया){_W}*।)",
    )
)
_CLOSE = "[”“’\"»)\\]）】』」》›]"
_OPEN = "[“„\"«‹‘'(\\[¿¡「『《（—–]"


def _ends(start: str) -> str:
    """Where a sentence ends, before a text that starts as given; a look at one character rules out most places."""
    return rf"(?=[{_T}。！？｡।॥\n\uE002])(?:" + "|".join(
        (
            rf"[{_T}]+(?:{_W}?»|{_CLOSE})*(?={_W}+{_OPEN}*{_W}?(?:{start}))(?!{_W}+[—–]{_W}?\p{{Ll}})",
            rf"(?<=[\p{{Ll}}\p{{N}}\p{{Lo}})”»\"!?…])[{_T}]+[”»\")]*(?=[“«]?\p{{Lu}}[\p{{Ll}}'’.])",
            # a point that is left before a small letter ends a sentence of a passage without capitals
            rf"(?<![.…])\.(?![.…])(?<!\b(?:etc|usw|Inc|Ltd|Co|Corp|Bros|Jr|hrsg)\.)(?={_W}+\p{{Ll}})",
            r"[。！？｡](?:[。！？｡]|[」』”’）》])*",
            rf"[।॥](?:{_CLOSE})*(?={_W}|\p{{L}}|[“\"(])",
            r"(?=\n[ \t\r]*\n)|\uE002",
        )
    ) + ")"


_THAI = rf"([\u0E00-\u0E7F])(?={_W}+[\u0E00-\u0E7F])"
_STARTS = r"\p{Lu}|\p{Lo}|\p{N}|\p{Ll}\p{Lu}"
_ENDS = _ends(_STARTS)
_ENDS_SMALL = _ends(_STARTS + r"|\p{Ll}")
_TRIM = " \t\n\r\u000b\u000c\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff" + BREAK


def _replace(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def _holds(c: Column, marks: str) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(c, F.lit(mark))
    return found


def masked(df: DataFrame, text: str = "text", to: str = "masked") -> DataFrame:
    """``df`` with the text in which every mark that ends no sentence is masked, character by character."""
    m = F.col(to)
    out = df.withColumn(to, F.translate(F.col(text), MASK + CUT + BREAK, "\ue00f" * 3))
    listed = _replace(_replace(_replace(m, _LIST_BREAK, f"$1{BREAK}"), _LIST_NUMBER, f"$1{MASK}"), _LIST_INNER, f"$1{MASK}")
    out = out.withColumn(to, F.when(F.contains(m, F.lit("\n")) & m.rlike(rf"(?:\A|\n[ \t]*\n){_MARK}"), listed).otherwise(m))
    out = out.withColumn(to, F.when(F.contains(m, F.lit("://")) | F.contains(m, F.lit("www.")), _replace(m, _ADDRESS, f"$1{MASK}")).otherwise(m))
    out = out.withColumn(to, _replace(m, _POINTS, MASK))
    for marks, pattern, keep in (("（『《", _BRACKETS, "$1$2"), ("「", _CORNER, "$1"), ("(", _ROUND, "$1"), ("“„", _CURLY, "$1"), ("«", _ANGLE, "$1"), ('"', _STRAIGHT, "$1"), ('”"', _REPORTED, "")):
        out = out.withColumn(to, F.when(_holds(m, marks), _replace(m, pattern, f"{keep}{MASK}")).otherwise(m))
    return out


def sentence_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (key, start_pos, end_pos): the sentences of each text as code-point positions, end exclusive."""
    out = masked(df.where(F.col(text).isNotNull()).select(key, text))
    m = F.col("masked")
    cut = F.when(m.rlike(r"\p{Lu}"), _replace(m, _ENDS, f"$0{CUT}")).otherwise(_replace(m, _ENDS_SMALL, f"$0{CUT}"))
    out = out.select(key, cut.alias("cut")).select(key, F.split(F.when(F.col("cut").rlike("[\\u0E00-\\u0E7F]"), _replace(F.col("cut"), _THAI, f"$1{CUT}")).otherwise(F.col("cut")), CUT).alias("pieces"))
    empty = F.array_repeat(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")), 0)

    def add(state: Column, piece: Column) -> Column:
        n, left, right = F.length(piece), F.length(F.ltrim(piece, F.lit(_TRIM))), F.length(F.rtrim(piece, F.lit(_TRIM)))
        span = F.struct((state.at + n - left).alias("a"), (state.at + right).alias("b"))
        return F.struct((state.at + n).alias("at"), F.when(left == 0, state.spans).otherwise(F.array_append(state.spans, span)).alias("spans"))

    spans = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), empty.alias("spans")), add, lambda state: state.spans)
    rows = out.select(key, F.explode(spans).alias("s"))
    return rows.select(key, F.col("s.a").cast("int").alias("start_pos"), F.col("s.b").cast("int").alias("end_pos"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of every document by its position."""
    return sentence_spans(table(spark, folder, "documents", "doc_id", "text"))


def p10_per_document(spark: SparkSession, folder: str) -> DataFrame:
    """How many sentences every document has, and how many characters they hold; documents without sentences have 0."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    spans = sentence_spans(docs).select("doc_id", (F.col("end_pos") - F.col("start_pos")).alias("n"))
    counted = spans.unionByName(docs.select("doc_id", F.lit(None).cast("int").alias("n")))
    return counted.groupBy("doc_id").agg(F.count("n").alias("sentences"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("chars"))


QUERIES = {"p10_found": p10_found, "p10_per_document": p10_per_document}
SQL: dict[str, str] = {}
