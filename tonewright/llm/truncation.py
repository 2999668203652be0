r"""Problem 6: values that were cut by a limit of their source or a broken transfer.

Per source and field the distribution of lengths is fitted by maximum likelihood as a discrete
hazard, right-censored where a source cuts: a source's longest length is a limit if its pile-up is
improbable under the hazard of all sources, and the hazard at a limit comes from the sources that
go on beyond it. One minus that hazard is the posterior that a value of just that length was cut.
It is combined with the evidence of the ending: an open bracket, a last word that the tables know
only as the start of longer words, a word that hardly ever ends a value, a closing mark, and the
same file's raw tag going on after the value. Away from a limit the prior is the source's own rate
of broken transfers, estimated from the endings that leave no doubt.

A source is the first folder of src_path; limits count characters, or bytes of UTF-8 where the
longest byte length is also the longest length. Defined results: null and empty values are not cut;
files without a path form the source ''; a repeated file gives one row per field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.sources.checkpoints import cut
from tonewright.sources.tables import table

FIELDS = ("tag_title", "tag_album", "tag_artist")
RAW_KEYS = {"tag_title": "title|TITLE|Title|TIT2|©nam", "tag_album": "album|ALBUM|Album|TALB|©alb", "tag_artist": "artist|ARTIST|Artist|TPE1|©ART"}
LIMIT_EVIDENCE = 10.0  # log likelihood ratio from which a longest length is a limit
BROKEN_RATE = (0.0015, 0.2)  # bounds of a source's rate of broken transfers


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, source), one row per file."""
    f = table(spark, folder, "files", "file_id", "src_path")
    return f.groupBy("file_id").agg(F.coalesce(F.min(F.regexp_extract("src_path", r"^/*([^/]+)/", 1)), F.lit("")).alias("source"))


def field_values(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file, field and value that is there: source, value, goes_on (the raw tag continues the value)."""
    m = table(spark, folder, "metadata", "file_id", *FIELDS, "raw_tags_json").where(F.col("file_id").isNotNull())
    longer = lambda f: F.regexp_extract("raw_tags_json", rf'"(?:{RAW_KEYS[f]})"\s*:\s*"((?:[^"\\]|\\.)*+)', 1)
    wanted = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.coalesce(longer(f), F.lit("")).alias("raw")) for f in FIELDS))
    rows = m.select("file_id", F.explode(wanted).alias("x")).select("file_id", "x.*").where("value <> ''")
    rows = rows.select("file_id", "field", "value", (F.startswith("raw", "value") & (F.length("raw") > F.length("value")) & ~F.endswith("raw", F.lit("\\"))).alias("goes_on"))
    return rows.join(sources(spark, folder), "file_id", "left").withColumn("source", F.coalesce("source", F.lit("")))


def _last_word(value: Column) -> Column:
    # a word after a sign that stands inside words (of garbled or look-alike text) is no whole word
    return F.lower(F.regexp_extract(value, r"(?:^|[\s(\[_,.\-\"'’&/+:;])([\p{L}\p{M}\p{N}]+)[.]?$", 1))


def words(values: DataFrame) -> DataFrame:
    """Per word of the values: inner (times before something else), final (times at the very end), longer (count of its commonest longer word)."""
    v = values.select(F.lower("value").alias("v")).select(F.split("v", r"[^\p{L}\p{M}\p{N}]+").alias("w"))
    last = F.element_at("w", -1)
    inner = v.select(F.explode(F.slice("w", 1, F.size("w") - 1)).alias("word"), F.lit(1).alias("inner"), F.lit(0).alias("final"))
    counts = inner.unionByName(v.select(last.alias("word"), F.lit(0).alias("inner"), F.lit(1).alias("final"))).where("word <> ''")
    counts = cut(counts.groupBy("word").agg(F.sum("inner").alias("inner"), F.sum("final").alias("final")))
    known = counts.where("inner + final > 1 and length(word) > 1").select((F.col("inner") + F.col("final")).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.xxhash64(F.substring("word", F.lit(1), k)))).alias("start"))
    # starts by their hash, so that a long word writes no more than its length
    longer = known.groupBy("start").agg(F.max("n").alias("longer"), F.sum("n").alias("longer_all"))
    return counts.withColumn("start", F.xxhash64("word")).join(longer, "start", "left").drop("start").na.fill(0)


def limits(values: DataFrame) -> DataFrame:
    """Per source, field and length at a limit: unit ('bytes' or 'chars'), the limit and the posterior that a value of that length was cut."""
    sizes = values.select("source", "field", F.length("value").alias("chars"), F.octet_length("value").alias("bytes"))
    counted = sizes.groupBy("source", "field", "chars", "bytes").count()
    both = counted.select("source", "field", "count", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "n"))
    hist = cut(both.groupBy("field", "unit", "source", "n").agg(F.sum("count").alias("here")))
    most = Window.partitionBy("field", "unit", "source")
    pooled = hist.groupBy("field", "unit", "n").agg(F.sum("here").alias("at"))
    beyond = Window.partitionBy("field", "unit").orderBy(F.col("n").desc())
    hazard = pooled.withColumn("hazard", F.col("at") / F.sum("at").over(beyond)).select("field", "unit", "n", "hazard")
    top = hist.withColumn("limit", F.max("n").over(most)).where("n = limit").join(hazard, ["field", "unit", "n"])
    found = top.where(-F.col("here") * F.log(F.least("hazard", F.lit(0.999999))) >= LIMIT_EVIDENCE).select("field", "unit", "source", "limit")
    one = found.groupBy("field", "source").pivot("unit", ["bytes", "chars"]).agg(F.max("limit"))
    unit = F.when(F.col("bytes").isNotNull() & (F.col("chars").isNull() | (F.col("bytes") <= F.col("chars"))), "bytes").otherwise("chars")
    chosen = one.select("field", "source", unit.alias("unit"), F.coalesce(F.when(unit == "bytes", F.col("bytes")), F.col("chars")).alias("limit"))
    # product-limit estimate: at each length only sources that go on beyond it are at risk
    risk = hist.join(chosen.select("field", "source", "unit", "limit"), ["field", "source", "unit"], "left").where("limit is null or n < limit - 1")
    ahead = Window.partitionBy("field", "unit", "source").orderBy(F.col("n").desc())
    left = risk.withColumn("reach", F.sum("here").over(ahead)).select("field", "unit", "source", "n", "here", F.when(F.col("limit").isNull(), F.col("reach")).alias("reach"), "limit")
    free = left.where("limit is null").groupBy("field", "unit", "n").agg(F.sum("here").alias("here"))
    curve = free.withColumn("hazard", F.col("here") / F.sum("here").over(beyond)).select("field", "unit", "n", "hazard")
    at = hist.join(chosen, ["field", "source", "unit"]).where("n >= limit - 1")
    reach = Window.partitionBy("field", "unit", "source").orderBy(F.col("n").desc())
    at = at.withColumn("reach", F.sum("here").over(reach)).join(curve, ["field", "unit", "n"], "left")
    # expected: values of just this length that are complete
    complete = F.least(F.lit(1.0), F.coalesce("hazard", F.lit(0.0)) * F.col("reach") / F.col("here"))
    return at.select("field", "source", "unit", "limit", "n", (1.0 - complete).alias("posterior"))


def _judged(values: DataFrame) -> DataFrame:
    """Values with the evidence of their ending as a log likelihood ratio, and the posterior of a limit."""
    v = values.withColumn("word", _last_word(F.col("value")))
    # values without a last word have no partner: a key of their own spreads them over the tasks
    apart = F.when(F.col("word") == "", F.concat(F.lit(" "), F.col("file_id").cast("string"))).otherwise(F.col("word"))
    v = v.withColumn("at_word", apart).join(words(values).withColumnRenamed("word", "at_word"), "at_word", "left").drop("at_word").na.fill(0, ["inner", "final", "longer", "longer_all"])
    bounds = limits(values)
    size = F.when(F.col("unit") == "bytes", F.octet_length("value")).otherwise(F.length("value"))
    per_source = bounds.groupBy("field", "source").agg(F.max("unit").alias("unit"), F.max("limit").alias("limit"), F.max(F.when(F.col("n") == F.col("limit"), F.col("posterior"))).alias("at_limit"), F.max(F.when(F.col("n") < F.col("limit"), F.col("posterior"))).alias("below"))
    v = v.join(per_source, ["field", "source"], "left")
    wide = (F.col("unit") == "bytes") & F.col("value").rlike(r"[^\x00-\x7f]") & (size >= F.col("limit") - F.when(F.col("value").rlike(r"[ࠀ-￿]"), 2).otherwise(1))
    # at a limit the whole value is a start of that length, so longer values of the field with the same start are looked up
    starts = bounds.where("unit = 'chars'").select("field", "limit").distinct()
    others = values.join(F.broadcast(starts), "field").where(F.length("value") > F.col("limit")).select("field", F.expr("left(value, limit)").alias("value")).distinct().withColumn("continued", F.lit(True))
    v = v.join(others, ["field", "value"], "left")
    v = v.withColumn("posterior", F.when(F.col("limit").isNull(), F.lit(None)).when((size >= F.col("limit")) | wide, F.col("at_limit")).when(size == F.col("limit") - 1, F.col("below")))
    n = F.length("word")
    # each sign is computed once, as a column
    v = v.withColumns({
        "opened": F.length(F.regexp_replace("value", r"[^(\[]", "")) > F.length(F.regexp_replace("value", r"[^)\]]", "")),
        # a word that the tables know only as the start of longer ones
        "rare": (F.col("inner") * 400 < F.col("longer")) & (F.col("final") * 5 < F.col("longer")) & (F.col("longer") >= 5),
        "short": (F.col("inner") == 0) & (F.col("final") <= 2) & (n <= 4) & F.col("word").rlike(r"^\p{L}+$") & (F.col("longer_all") > 0),
        "trails": (F.col("word") == "") & F.col("value").rlike(r"[\s,&/-]$"),
        # a name written last part first may end in a short form, and names joined by '_' lose a closing bracket
        "turned": (F.col("field") == "tag_artist") & F.col("value").rlike(r"^[^,]+,\s*\p{L}+$"),
    })
    opened, rare, short, turned = (F.col(c) for c in ("opened", "rare", "short", "turned"))
    # words that hardly ever end a value speak for a cut, words that often do against it
    usual = F.log((F.col("inner") + 0.5) / (F.col("final") + 0.5)) - 0.5
    known = F.coalesce("continued", F.lit(False)) & (F.col("word") != "")
    at_end = F.when(opened, 6.0).when(known, 3.0).when(F.col("word") == "", F.when(F.col("trails"), 3.0).otherwise(-3.5)).when(rare, 5.0).when(short, 3.0).when((F.col("inner") + F.col("final")) > 3, F.greatest(F.lit(-4.0), F.least(F.lit(4.0), usual))).otherwise(0.0)
    joined = F.contains("value", F.lit("_"))
    broken = F.when(turned, -9.0).when(opened & (rare | short), 9.0).when(opened & ~joined, 7.0).when(rare & (F.col("longer") > 25 * (F.col("inner") + F.col("final"))), 8.0).when(rare, 5.5).when(short, 5.0).otherwise(-9.0)
    v = v.withColumns({"at_end": at_end, "broken": broken})
    return v.withColumn("sure", (F.col("goes_on") | (F.col("broken") >= 8.0)) & F.col("posterior").isNull())


def cut_values(spark: SparkSession, folder: str) -> DataFrame:
    """All values with source and is_cut."""
    judged = cut(_judged(cut(field_values(spark, folder))).select("file_id", "source", "field", "value", "goes_on", "posterior", "at_end", "broken", "sure"))
    rates = judged.groupBy("source").agg((F.sum(F.col("sure").cast("double")) / F.sum(F.col("posterior").isNull().cast("double"))).alias("rate"))
    v = judged.join(rates, "source")
    low, high = BROKEN_RATE
    rate = F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce("rate", F.lit(low))))
    p = F.least(F.lit(0.999), F.greatest(rate, "posterior"))
    odds = F.when(F.col("posterior").isNull(), F.log(rate / (1 - rate)) + F.col("broken")).otherwise(F.log(p / (1 - p)) + F.col("at_end"))
    return v.select("file_id", "source", "field", "value", (F.col("goes_on") | (odds > 0)).alias("is_cut"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The files and fields whose value lost its end."""
    return cut_values(spark, folder).where("is_cut").select("file_id", "field").distinct()


def p6_share(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts each field."""
    one = cut_values(spark, folder).groupBy("file_id", "source", "field").agg(F.max("is_cut").alias("is_cut"))
    return one.groupBy("source", "field").agg(F.count("*").alias("n_values"), F.sum(F.col("is_cut").cast("bigint")).alias("n_cut"), F.avg(F.col("is_cut").cast("double")).alias("share"))


QUERIES = {"p6_found": p6_found, "p6_share": p6_share}
SQL: dict[str, str] = {}
