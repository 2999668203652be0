"""Problem 1: variant spellings of one artist's name.

Each name key gets plain tokens. Misspelt tokens find their commoner neighbour through a
symmetric-delete index. The token of a name that has the fewest different companions is its anchor
(a surname or an invented word); names with the same anchor are compared form by form: the other
tokens are aligned by optimal assignment permitting initials, short forms and one slip. A form that
fits two artists which don't fit each other stands for both and is left out. Artists of different
anchors are compared where a token of one is a slip away from a token of the other, however common
both are; the alignment of the whole names decides. A name of one word has nothing beside its token,
so there only the frequencies tell a slip from another name.

Defined results: placeholders, credits of a featured artist, and keys that are titles more often
than artists form no pair; null, empty and punctuation-only names have no key. Only different forms
of one anchor are compared, never rows or keys, so a name with a third of all rows costs as much as
any other; the forms of one anchor meet through an index of their tokens, so an anchor that many
artists share, as a common surname, takes time in proportion to its forms.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType

from tonewright.functions.unicode import name_key
from tonewright.llm.names import FULL_NAMES, PLACEHOLDERS, Index, align, corrected, name_parts, slips
from tonewright.sources.checkpoints import cut
from tonewright.sources.tables import table


def typed_names(spark: SparkSession, folder: str) -> DataFrame:
    """(raw, n): every spelling in tag_artist, tag_albumartist and aliases with its number of rows."""
    m = table(spark, folder, "metadata", "tag_artist", "tag_albumartist")
    a = table(spark, folder, "musicbrainz_cache", "aliases")
    artists = m.groupBy("tag_artist").count().select(F.col("tag_artist").alias("raw"), F.col("count").alias("n"))
    owners = m.groupBy("tag_albumartist").count().select(F.col("tag_albumartist").alias("raw"), F.col("count").alias("n"))
    aliases = a.select(F.explode("aliases").alias("raw"), F.lit(1).cast("bigint").alias("n"))
    return artists.unionByName(owners).unionByName(aliases).where("raw <> ''").groupBy("raw").agg(F.sum("n").alias("n"))


def title_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(key, titles): how many rows have the key as their title."""
    t = table(spark, folder, "metadata", "tag_title").where("tag_title <> ''").groupBy("tag_title").count()
    return t.select(name_key("tag_title").alias("key"), "count").groupBy("key").agg(F.sum("count").alias("titles"))


def _best_forms(names: DataFrame) -> DataFrame:
    """One row per key: the form with the most words, then the commonest."""
    parts = names.select("n", name_parts("raw").alias("p")).select("n", "p.*").where("key <> ''")
    words = F.size(F.split("form", " "))
    return parts.groupBy("key").agg(F.max_by("form", F.struct(words.alias("w"), "n", "form")).alias("form"), F.sum("n").alias("n"), F.max("credit").alias("credit"))


def _centers(forms: DataFrame) -> DataFrame:
    """(token, center), following neighbours twice."""
    tokens = forms.select("n", F.explode(F.array_distinct(F.split("form", " "))).alias("token")).groupBy("token").agg(F.sum("n").alias("n"))
    best = cut(corrected(cut(tokens)))
    again = best.select(F.col("token").alias("near"), F.col("near").alias("next"))
    return best.join(again, "near", "left").select("token", F.coalesce("next", "near").alias("center"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of one artist among the forms of each anchor; the rows come sorted by anchor."""
    anchor, forms = None, []

    def artists() -> list[tuple[str, str, int, bool]]:
        # forms that write all their words out come first, the commonest ahead
        order = sorted(forms, key=lambda f: (any(len(t) == 1 for t in f[1]), -len(f[1]), -f[2], f[0]))
        heads: list[tuple[str, ...]] = []
        index = Index()
        keys: list[tuple[str, int]] = []  # sorted, with the artist
        out = []
        for form, tokens, _, key in order:
            near = index.near(tokens)
            fits = [(c, i) for i in near if (c := align(tokens, heads[i])) is not None]
            if not fits:  # a name that was cut is the start of one of the artist's keys
                at = bisect.bisect_left(keys, (key, -1))
                cut_of = set()
                while at < len(keys) and keys[at][0].startswith(key) and len(cut_of) < 2:
                    if 2 * len(key) >= len(keys[at][0]):
                        cut_of.add(keys[at][1])
                    at += 1
                fits = [(2, i) for i in cut_of]
            if not fits and len(tokens) > 1:  # or it leaves out words that several bands share
                fits = [(3 + c, i) for i in near if len(heads[i]) > len(tokens) and (c := align(tokens, heads[i], 2)) is not None]
            if not fits:
                out.append((anchor, form, len(heads), True))
                bisect.insort(keys, (key, len(heads)))
                heads.append(tokens)
                index.add(tokens)
                continue
            fits.sort()
            # a cheaper fit wins over initials and short forms; equal ones leave the form open
            if len(fits) > 1 and fits[0][0] == fits[1][0] and fits[0][0] > 0:
                continue
            if len(fits) > 1 and fits[0][0] >= 2:
                continue
            out.append((anchor, form, fits[0][1], False))
            bisect.insort(keys, (key, fits[0][1]))
        return out

    def batch(rows: list[tuple[str, str, int, bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.bool_()))], names=["anchor", "form", "artist", "head"])

    ready: list[tuple[str, str, int, bool]] = []
    for b in batches:
        for a, form, others, n, key in zip(*(c.to_pylist() for c in b.columns)):
            if a != anchor and forms:
                ready += artists()
                forms.clear()
                if len(ready) > 10_000:
                    yield batch(ready)
                    ready = []
            anchor = a
            forms.append((form, tuple(others.split()), n, key))
    if forms:
        ready += artists()
    if ready:
        yield batch(ready)


@arrow_udf(IntegerType())
def _fit(short: pa.Array, long: pa.Array) -> pa.Array:
    """Cost of aligning two whole names, null if they can't be the same."""
    out = []
    for a, b in zip(short.to_pylist(), long.to_pylist()):
        one, two = tuple(a.split()), tuple(b.split())
        cost = align(one, two)
        if cost is None and len(two) > len(one) > 2:  # leaves out words that several bands share
            left = align(one, two, 2)
            cost = None if left is None else 3 + left
        out.append(cost)
    return pa.array(out, pa.int32())


def _merged(heads: DataFrame) -> DataFrame:
    """(id, first): the artists of different anchors that are one, with the least id among them. ``heads`` has id, anchor and form."""
    many = heads.withColumn("tokens", F.split("form", " ")).where(F.size("tokens") > 1)
    order = F.struct((~F.exists("tokens", lambda t: F.length(t) == 1)).alias("full"), F.size("tokens").alias("words"), "id")
    words = cut(many.select("id", "anchor", "form", order.alias("order"), F.explode(F.array_distinct("tokens")).alias("token")))
    near = slips(words.select("token").distinct())
    sides = [words.select(*(F.col(x).alias(f"{x}_{s}") for x in words.columns)) for s in "ab"]
    met = near.join(sides[0], F.col("token") == F.col("token_a")).join(sides[1], (F.col("other") == F.col("token_b")) & (F.col("id_a") != F.col("id_b")))
    met = met.where("anchor_a <> anchor_b and (anchor_a = token_a or anchor_b = token_b)")
    # the name with initials or fewer words has to fit the other
    swap = F.col("order_a") > F.col("order_b")
    pairs = met.select(*(F.when(swap, F.col(f"{x}_b")).otherwise(F.col(f"{x}_a")).alias(f"{x}_short") for x in ("id", "form")), *(F.when(swap, F.col(f"{x}_a")).otherwise(F.col(f"{x}_b")).alias(f"{x}_long") for x in ("id", "form"))).distinct()
    fits = cut(pairs.withColumn("cost", _fit("form_short", "form_long")).where("cost is not null").select("id_short", "id_long", "cost"))
    # a slip with the same company is one artist; initials, short forms and missing words must not fit two
    single = fits.groupBy("id_short").agg(F.count("*").alias("fitting"))
    kept = fits.join(single, "id_short").where("cost = 1 or fitting = 1").select(F.col("id_short").alias("u"), F.col("id_long").alias("v"))
    edges = cut(kept.union(kept.select("v", "u")).distinct())
    first = cut(edges.groupBy(F.col("u").alias("id")).agg(F.min(F.array_min(F.array("u", "v"))).alias("first")))
    while True:  # the least id spreads until nothing changes
        heard = edges.join(first, F.col("v") == F.col("id")).select(F.col("u").alias("id"), F.col("first"))
        after = cut(first.union(heard).groupBy("id").agg(F.min("first").alias("first")))
        if after.join(first, ["id", "first"], "left_anti").isEmpty():
            return after
        first = after


def artist_names(forms: DataFrame) -> DataFrame:
    """(key, anchor, artist): names with equal anchor and artist are of one artist. ``forms`` has key, form and n."""
    centers = _centers(forms)
    tokens = forms.select("key", "n", F.posexplode(F.split("form", " ")).alias("i", "token"))
    tokens = tokens.join(centers, "token", "left").select("key", "n", "i", F.coalesce("center", "token").alias("token"))
    names = cut(tokens.groupBy("key").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("token")).alias("tokens")))
    # a token with many different companions is a first name or a word of many bands
    plain = names.select(F.array_distinct("tokens").alias("tokens")).distinct()
    pairs = plain.select("tokens", F.explode("tokens").alias("token")).select("token", F.explode("tokens").alias("other")).distinct()
    company = cut(pairs.groupBy("token").agg(F.count("*").alias("company")))
    full = F.create_map(*(F.lit(x) for pair in FULL_NAMES.items() for x in pair))
    each = names.select("key", F.explode(F.array_distinct("tokens")).alias("token")).withColumn("name", F.element_at(full, F.col("token")))
    # a short form keeps the company of its name, however few artists use it
    named = company.select(F.col("token").alias("name"), F.col("company").alias("more"))
    each = each.join(company, "token").join(named, "name", "left").withColumn("company", F.greatest("company", F.coalesce("more", F.lit(0))))
    rank = F.struct((F.length("token") < 3).alias("short"), "company", (-F.length("token")).alias("long"), "token")
    anchors = each.groupBy("key").agg(F.min_by("token", rank).alias("anchor"))
    keyed = names.join(anchors, "key")
    keyed = cut(keyed.withColumn("form", F.array_join("tokens", " ")).select("key", "anchor", "form", "n", F.expr("array_join(filter(tokens, (t, i) -> i <> array_position(tokens, anchor) - 1), ' ')").alias("others")))
    by_form = keyed.groupBy("anchor", "form", "others").agg(F.sum("n").alias("n"), F.max("key").alias("key"))
    grouped = by_form.select("anchor", "form", "others", "n", "key").repartition("anchor").sortWithinPartitions("anchor", "form").mapInArrow(_groups, "anchor string, form string, artist int, head boolean")
    grouped = cut(grouped)
    same = _merged(grouped.where("head").select(F.struct("anchor", "artist").alias("id"), "anchor", "form"))
    linked = keyed.join(grouped, ["anchor", "form"]).join(same, F.struct("anchor", "artist") == F.col("id"), "left")
    return linked.select("key", F.coalesce("first.anchor", "anchor").alias("anchor"), F.coalesce("first.artist", "artist").alias("artist"), "form", "n")


def linked_names(spark: SparkSession, folder: str) -> DataFrame:
    """(key, anchor, artist, form, n) of all names that can be linked."""
    forms = cut(_best_forms(typed_names(spark, folder)).where(~F.col("credit")).drop("credit"))
    known = forms.join(title_counts(spark, folder), "key", "left").where("titles is null or titles <= n").drop("titles")
    names = artist_names(known)
    return names.where(~F.col("form").isin(*PLACEHOLDERS))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different name keys of one artist."""
    names = cut(linked_names(spark, folder).select("anchor", "artist", "key"))
    a, b = names.withColumnRenamed("key", "name_a"), names.withColumnRenamed("key", "name_b")
    return a.join(b, ["anchor", "artist"]).where("name_a < name_b").select("name_a", "name_b")


def p1_artists(spark: SparkSession, folder: str) -> DataFrame:
    """Every linked name key with the commonest key of its artist and the artist's number of keys."""
    names = cut(linked_names(spark, folder))
    heads = names.groupBy("anchor", "artist").agg(F.max_by("key", F.struct("n", "key")).alias("artist_key"), F.count("*").alias("keys"))
    return names.join(heads, ["anchor", "artist"]).select("key", "artist_key", "keys")


QUERIES = {"p1_found": p1_found, "p1_artists": p1_artists}
SQL: dict[str, str] = {}
