"""Problem 7: mapping names as typed to the entries of a reference list.

Typed values are reduced to distinct name keys with plain tokens. Whether a key can be an entry's name is decided by
aligning the two token by token, as no share of n-grams tells one first name from another. ``meeting`` finds all pairs
that align, whatever their cosine: the words of both sides meet under signs that words which can stand for each other
share (the whole, starts, symmetric deletes, nicknames, shortened forms), and a name is looked up by the word whose
partners the fewest entries have. So pairs grow with the names, not with names times entries, as those of an inverted index of
n-grams do (there are only so many n-grams). Pairs that align are scored by their whole weighted cosine of character n-grams, and the
best entry is accepted if its score reaches a threshold and leads by a margin.

``candidates`` is that inverted index, with all pairs at a threshold; the queries don't use it.

Defined results: null, empty and punctuation-only values have no key; keys that are an entry's own
key are left out; a key that fits two entries (an initial shared by two first names) without a margin is left
out; placeholders, credits of a featured artist and everything without a fitting entry map to ''.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType

from tonewright.llm.names import PLACEHOLDERS, TITLES, align, are_partners, kept_under, name_parts, sought_under
from tonewright.sources.checkpoints import cut
from tonewright.sources.tables import table

GRAM = 4
THRESHOLD = 0.25  # of the cosine from which any pair is a candidate
ACCEPTED, MARGIN = 0.1, 0.1  # least cosine of an entry that passes the check, and its least lead over others that do
POWER = 3.0  # of the inverse document frequency in the list
ROUNDING = 1e-5  # of sums of single precision


@arrow_udf(IntegerType())
def alignment(typed: pa.Array, entry: pa.Array, typed_key: pa.Array, entry_key: pa.Array) -> pa.Array:
    """Cost of aligning two forms, null if they can't be the same name."""
    out = []
    for a, b, ka, kb in zip(typed.to_pylist(), entry.to_pylist(), typed_key.to_pylist(), entry_key.to_pylist()):
        one, two = tuple(a.split()), tuple(b.split())
        cost = align(one, two)
        if cost is None and 2 * len(ka) >= len(kb) and kb.startswith(ka):  # cut at its end, with half of the name left
            cost = 4
        if cost is None and len(one) > 2:  # leaves out words that several bands share
            left = align(one, two, 2)
            cost = None if left is None else 5 + left
        out.append(cost)
    return pa.array(out, pa.int32())


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """(entry_key, entry_form, canonical_name) of the reference list, one row per key."""
    c = table(spark, folder, "musicbrainz_cache", "canonical_name").where("canonical_name <> ''").distinct()
    parts = c.select("canonical_name", name_parts("canonical_name").alias("p")).where("p.key <> ''")
    return parts.groupBy(F.col("p.key").alias("entry_key")).agg(F.min_by("p.form", "canonical_name").alias("entry_form"), F.min("canonical_name").alias("canonical_name"))


def typed_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(key, form, credit) of tag_artist and search_name: the form with the most words, then the commonest."""
    m = table(spark, folder, "metadata", "tag_artist").select(F.col("tag_artist").alias("raw"))
    s = table(spark, folder, "musicbrainz_cache", "search_name").select(F.col("search_name").alias("raw"))
    names = m.unionByName(s).where("raw <> ''").groupBy("raw").agg(F.count("*").alias("n"))
    parts = names.select("n", name_parts("raw").alias("p")).select("n", "p.*").where("key <> ''")
    words = F.size(F.split("form", " "))
    return parts.groupBy("key").agg(F.max_by("form", F.struct(words.alias("w"), "n", "form")).alias("form"), F.max("credit").alias("credit"))


def _grams(names: DataFrame, key: str, form: str) -> DataFrame:
    """(key, gram): the different n-grams of the padded tokens."""
    pad = names.select(key, F.explode(F.array_distinct(F.split(form, " "))).alias("t")).select(key, F.concat(F.lit("^"), "t", F.lit("$")).alias("t"))
    last = F.greatest(F.length("t") - (GRAM - 1), F.lit(1))
    return pad.select(key, F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring("t", i, F.lit(GRAM)))).alias("gram")).distinct()


def _gram_list(form: str) -> Column:
    """The same n-grams as an array."""
    tokens = F.transform(F.array_distinct(F.split(form, " ")), lambda t: F.concat(F.lit("^"), t, F.lit("$")))
    parts = F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (GRAM - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(GRAM))))
    return F.array_distinct(F.flatten(parts))


def _rarest(grams: DataFrame, key: str) -> DataFrame:
    """(gram, key, w, beyond, lost): the weights scaled to length one, without the commonest n-grams, as far as those make
    up less than the threshold's square of the length; beyond is the length of all commoner ones, lost of those left out."""
    rising, whole = Window.partitionBy(key).orderBy("w", "gram"), Window.partitionBy(key)
    squares = grams.withColumn("rest", F.sum(F.col("w") * F.col("w")).over(rising)).withColumn("all", F.sum(F.col("w") * F.col("w")).over(whole))
    kept = F.col("rest") >= THRESHOLD * THRESHOLD * F.col("all")
    lost = squares.withColumn("kept", kept).withColumn("lost", F.coalesce(F.max(F.when(~kept, F.col("rest"))).over(whole), F.lit(0.0)))
    beyond = F.greatest(F.col("rest") - F.col("w") * F.col("w"), F.lit(0.0))
    return lost.where("kept").select("gram", key, (F.col("w") / F.sqrt("all")).cast("float").alias("w"), F.sqrt(beyond / F.col("all")).cast("float").alias("beyond"), F.sqrt(F.col("lost") / F.col("all")).cast("float").alias("lost"))


def _may_be_left(word: str) -> Column:
    """Whether a name may have the word or not."""
    return (F.length(word) == 1) | F.col(word).isin(*TITLES) | (F.levenshtein(word, F.lit("the")) <= 1) | F.col(word).isin("hte", "teh")


def _slip_keys(names: DataFrame, key: str, form: str) -> DataFrame:
    """(slip, key): hashes that two names share if one slip in a token, or one word that may be left over, is all between them."""
    tokens = names.select(key, F.array_sort(F.split(form, " ")).alias("tokens")).select(key, "tokens", F.posexplode("tokens").alias("i", "t"))
    others = tokens.select(key, "i", "t", F.expr("array_join(filter(tokens, (x, j) -> j <> i), ' ')").alias("others"), F.array_join("tokens", " ").alias("whole"))
    cuts = F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.concat(F.substring("t", F.lit(1), i - 1), F.substring("t", i + 1, F.length("t"))))
    slips = F.transform(F.array_append(F.when(F.length("t") >= 3, cuts).otherwise(F.array().cast("array<string>")), F.col("t")), lambda x: F.concat(F.col("others"), F.lit("|"), x))
    left = F.concat(F.when(F.col("i") == 0, F.array("whole")).otherwise(F.array().cast("array<string>")), F.when(_may_be_left("t"), F.array("others")).otherwise(F.array().cast("array<string>")))
    return others.select(F.explode(F.concat(slips, left)).alias("slip"), key).select(F.xxhash64("slip").alias("slip"), key)


def candidates(typed: DataFrame, listed: DataFrame) -> DataFrame:
    """(typed_id, entry_id, cosine) of the pairs at or above the threshold and of those one slip apart; typed and listed
    come with their ids, the cosine is that of the n-grams looked up."""
    index = cut(_grams(listed, "entry_id", "entry_form"))
    weights = cut(index.groupBy("gram").agg(F.count("*").alias("df")))
    # an n-gram that the list doesn't have counts as one of average frequency
    weigh, usual = _weigher(weights, listed.count())
    entry_side = _rarest(index.join(weights, "gram").withColumn("w", weigh(F.col("df"))), "entry_id").withColumnsRenamed({"w": "we", "beyond": "beyond_e", "lost": "lost_e"})
    looked = _grams(typed, "typed_id", "form").join(weights, "gram", "left").withColumn("w", weigh(F.coalesce("df", usual)))
    typed_side = _rarest(looked, "typed_id")
    # n-grams that a pair shares but doesn't look up are commoner than all it looks up, and left out on one side at least
    more = F.greatest(F.col("lost") * F.col("beyond_e"), F.col("beyond") * F.col("lost_e"))
    met = typed_side.join(entry_side, "gram").select("typed_id", "entry_id", (F.col("w") * F.col("we")).cast("float").alias("dot"), more.cast("float").alias("more"), F.lit(False).alias("slip"))
    slips = _slip_keys(typed, "typed_id", "form").join(_slip_keys(listed, "entry_id", "entry_form"), "slip").select("typed_id", "entry_id", F.lit(0.0).cast("float").alias("dot"), F.lit(1.0).cast("float").alias("more"), F.lit(True).alias("slip"))
    pairs = met.union(slips).groupBy("typed_id", "entry_id").agg(F.sum("dot").alias("cosine"), F.min("more").alias("more"), F.max("slip").alias("slip"))
    return pairs.where(F.col("slip") | (F.col("cosine") + F.col("more") >= THRESHOLD - ROUNDING)).select("typed_id", "entry_id", "cosine")


def _weigher(weights: DataFrame, entries_listed: int):
    """The weight of an n-gram by the number of entries that have it, and the number that stands for those of none."""
    size = weights.agg(F.sum("df").alias("postings"), F.count("*").alias("grams")).first()
    usual = F.lit(max((size.postings or 0) / max(size.grams, 1), 1.0))
    return (lambda df: F.pow(F.log(1 + F.lit(float(entries_listed)) / df), F.lit(POWER))), usual


def _words(names: DataFrame, key: str, form: str, word: str) -> DataFrame:
    return names.select(key, F.explode(F.array_distinct(F.split(form, " "))).alias(word))


def partners(typed_words: DataFrame, listed_words: DataFrame) -> DataFrame:
    """(word, other, n, alike): the typed words with the listed words that can stand for them, which n entries have, and
    whether the two share an n-gram."""
    kept = listed_words.groupBy("other").agg(F.count("*").alias("n")).select("other", "n", F.explode(kept_under("other")).alias("sign"))
    sought = typed_words.select("word").distinct().select("word", F.explode(sought_under("word")).alias("sign"))
    met = sought.join(kept, "sign").select("word", "other", "n").distinct().where(are_partners("word", "other"))
    return met.select("word", "other", "n", F.arrays_overlap(_gram_list("word"), _gram_list("other")).alias("alike"))


def meeting(typed: DataFrame, listed: DataFrame) -> DataFrame:
    """(typed_id, entry_id) of pairs to check, among them all that pass the check and share an n-gram.

    Each word of a typed name needs a partner in the entry, but for one that may be left over. So a name is looked up only
    by that word of it whose partners the fewest entries have; where any word may be left over, by two. A partner without
    an n-gram of the word (dr for any name with these letters) is looked up together with the n-grams of the whole name,
    one of which the entry must have. Names that were cut meet the entries of at most twice their length by their start.
    """
    typed_words, listed_words = _words(typed, "typed_id", "form", "word"), _words(listed, "entry_id", "entry_form", "other")
    met = cut(partners(typed_words, listed_words))
    counts = met.groupBy("word").agg(F.sum(F.when(F.col("alike"), F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("m"))
    reach = typed_words.join(counts, "word", "left").select("typed_id", F.struct(_may_be_left("word").alias("spare"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"), "word").alias("w"))
    first = reach.groupBy("typed_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    lookups = first.select("typed_id", F.explode(F.slice("ws", F.lit(1), F.when(F.get("ws", F.lit(0))["spare"], 2).otherwise(1))).alias("w")).select("typed_id", "w.word")
    by_word = lookups.join(met.where("alike").select("word", "other"), "word").join(listed_words, "other").select("typed_id", "entry_id")
    unlike = met.where("not alike").select("word", "other")
    # the check lets equal words meet first, so a word that both have is no other's partner, unless the entry has it again
    again = F.concat("other", F.lit(" "), "other")
    asked = lookups.join(unlike, "word").join(typed.select("typed_id", "form"), "typed_id").select("typed_id", F.when(F.array_contains(F.split("form", " "), F.col("other")), again).otherwise(F.col("other")).alias("other"), F.explode(_gram_list("form")).alias("gram"))
    held = listed.select("entry_id", "entry_form", F.explode(F.split("entry_form", " ")).alias("other")).groupBy("entry_id", "entry_form", "other").agg(F.count("*").alias("n"))
    held = held.join(unlike.select("other").distinct(), "other", "left_semi").select("entry_id", "entry_form", F.explode(F.when(F.col("n") > 1, F.array(F.col("other"), again)).otherwise(F.array("other"))).alias("other")).select("entry_id", "other", F.explode(_gram_list("entry_form")).alias("gram"))
    by_gram = asked.join(held, ["other", "gram"]).select("typed_id", "entry_id")
    starts = F.transform(F.sequence(F.ceil(F.length("entry_key") / 2), F.length("entry_key").cast("long")), lambda i: F.xxhash64(F.substring("entry_key", F.lit(1), i.cast("int"))))
    by_start = typed.select("typed_id", F.xxhash64("key").alias("start")).join(listed.select("entry_id", F.explode(starts).alias("start")), "start").select("typed_id", "entry_id")
    return by_word.union(by_gram).union(by_start).distinct()


def aligned(typed: DataFrame, listed: DataFrame) -> DataFrame:
    """(typed_id, entry_id, key, form, entry_form, canonical_name, cost) of all pairs that pass the check and share an n-gram."""
    pairs = meeting(typed, listed).join(listed, "entry_id").join(typed.select("typed_id", "key", "form"), "typed_id")
    return pairs.withColumn("cost", alignment("form", "entry_form", "key", "entry_key")).where("cost is not null").drop("entry_key")


def cosines(pairs: DataFrame, weights: DataFrame, weigh, usual: Column) -> DataFrame:
    """(typed_id, entry_id, cosine): the whole weighted cosine of pairs with form and entry_form."""
    sides = pairs.select("typed_id", "entry_id", _gram_list("form").alias("a"), _gram_list("entry_form").alias("b"))
    each = sides.select("typed_id", "entry_id", "a", "b", F.explode(F.array_union("a", "b")).alias("gram")).select("typed_id", "entry_id", "gram", F.array_contains("a", F.col("gram")).cast("double").alias("a"), F.array_contains("b", F.col("gram")).cast("double").alias("b"))
    each = each.join(weights, "gram", "left").withColumn("w", F.pow(weigh(F.coalesce("df", usual)), F.lit(2.0)))
    sums = each.groupBy("typed_id", "entry_id").agg(*(F.sum(x).alias(n) for n, x in (("a", F.col("w") * F.col("a")), ("b", F.col("w") * F.col("b")), ("dot", F.col("w") * F.col("a") * F.col("b")))))
    return sums.select("typed_id", "entry_id", (F.col("dot") / F.sqrt(F.col("a") * F.col("b"))).alias("cosine"))


def mapped(spark: SparkSession, folder: str) -> DataFrame:
    """(key, canonical_name, cosine, cost, ambiguous) of every typed key that is no entry's key."""
    # the checkpoint fixes the ids, so they are the same wherever they are read
    listed = cut(entries(spark, folder).withColumn("entry_id", F.monotonically_increasing_id()))
    typed = cut(typed_keys(spark, folder).join(listed.select(F.col("entry_key").alias("key")), "key", "left_anti").withColumn("typed_id", F.monotonically_increasing_id()))
    wanted = typed.where(~F.col("credit") & ~F.concat_ws(" ", F.array_sort(F.split("form", " "))).isin(*PLACEHOLDERS))
    # what fails the check can't be the name, however many n-grams it shares
    fits = cut(aligned(wanted, listed))
    weights = _grams(listed, "entry_id", "entry_form").groupBy("gram").agg(F.count("*").alias("df"))
    weigh, usual = _weigher(weights, listed.count())
    scored = fits.join(cosines(fits, weights, weigh, usual), ["typed_id", "entry_id"]).where(F.col("cosine") >= ACCEPTED)
    best = scored.groupBy("key").agg(F.max(F.struct("cosine", (-F.col("cost")).alias("near"), "canonical_name")).alias("best"), F.sort_array(F.collect_list("cosine"), asc=False).alias("all"))
    chosen = best.select("key", "best.canonical_name", "best.cosine", (-F.col("best.near")).alias("cost"), ((F.size("all") > 1) & (F.get("all", F.lit(0)) - F.get("all", F.lit(1)) < MARGIN)).alias("ambiguous"))
    return typed.select("key").join(chosen, "key", "left")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every typed name key with the entry of the artist meant, '' where the list holds none."""
    return mapped(spark, folder).where(~F.coalesce("ambiguous", F.lit(False))).select(F.col("key").alias("name_key"), F.coalesce("canonical_name", F.lit("")).alias("canonical_name"))


def p7_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The typed name keys without an entry, and those that fit several."""
    m = mapped(spark, folder)
    return m.where(F.col("canonical_name").isNull() | F.col("ambiguous")).select(F.col("key").alias("name_key"), F.coalesce("ambiguous", F.lit(False)).alias("fits_several"))


QUERIES = {"p7_found": p7_found, "p7_unmatched": p7_unmatched}
SQL: dict[str, str] = {}
