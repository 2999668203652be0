"""Problem 8: filling training sequences of a fixed capacity with texts of varying length.

Lengths are counted in tokens of a public tokenizer. What is packed is the histogram of lengths,
at most one entry per length up to the capacity, so the plan is made on the driver whatever the
number of texts: from the longest length down, a sequence's gap is filled by a single, a pair or a
triple of lengths that fit it exactly, as long as the counts allow, else by the longest that fits.
A plan is a list of patterns with their numbers of repeats; texts find their place by their rank
among those of equal length. A common length is ranked in as many groups as its texts need, so no
length is a hot key; pieces as long as a sequence need no rank, and their sequence ids, which follow
those of the plan, have gaps.

Defined results: texts longer than the capacity are cut into full pieces and a rest; null and empty
texts have no tokens and come out once with a null sequence_id; equal ids are different texts.
"""

from __future__ import annotations

import base64
import bisect
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.sources.checkpoints import cut
from tonewright.sources.tables import table

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP = 250_000  # texts of one length that one task ranks, about


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every row of (doc_id, text); whole texts, 0 for null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            lengths = [len(encode(x)) if x else 0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id bigint, n_tokens bigint")


class _Lengths:
    """The lengths that are left, with their counts; bit sets of them answer which sums can be made."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {k: n for k, n in counts.items() if n > 0}
        self.sorted = sorted(self.left)
        self.top = capacity
        self.there = sum(1 << k for k in self.sorted)
        self.mirrored = sum(1 << (capacity - k) for k in self.sorted)

    def has(self, *lengths: int) -> bool:
        return all(self.left.get(k, 0) >= lengths.count(k) for k in lengths)

    def take(self, lengths: list[int], times: int) -> None:
        for k in lengths:
            self.left[k] -= times
            if not self.left[k]:
                del self.left[k]
                self.sorted.pop(bisect.bisect_left(self.sorted, k))
                self.there ^= 1 << k
                self.mirrored ^= 1 << (self.top - k)

    def longest(self, most: int, used: list[int]) -> int | None:
        """The longest length of at most ``most`` that is left beside those used."""
        i = bisect.bisect_right(self.sorted, most) - 1
        while i >= 0:
            k = self.sorted[i]
            if self.left[k] > used.count(k):
                return k
            i -= 1
        return None

    def exact(self, gap: int, used: list[int]) -> list[int] | None:
        """One, two or three lengths that fill the gap exactly, the longest first."""
        if self.has(gap, *used):
            return [gap]
        if pair := self._pair(gap, used):
            return pair
        for k in reversed(self.sorted[: bisect.bisect_right(self.sorted, gap - 2)]):
            if (pair := self._pair(gap - k, [*used, k])) and self.has(k, *pair, *used):
                return [k, *pair]
        return None

    def _pair(self, total: int, used: list[int]) -> list[int] | None:
        # lengths k for which total - k is there too
        both = self.there & (self.mirrored >> (self.top - total)) & ((1 << (total // 2 + 1)) - 1)
        while both:
            k = both.bit_length() - 1
            if self.has(total - k, k, *used):
                return [total - k, k]
            both ^= 1 << k
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths that share a sequence, each with the number of sequences filled so."""
    lengths, patterns = _Lengths(counts, capacity), []
    while lengths.sorted:
        used = [lengths.sorted[-1]]
        gap = capacity - used[0]
        while gap:
            fill = lengths.exact(gap, used)
            if fill:
                used += fill
                break
            k = lengths.longest(gap, used)
            if k is None:
                break
            used.append(k)
            gap -= k
        times = min(lengths.left[k] // used.count(k) for k in set(used))
        # the loop above uses a length at most as often as it is left, so at least one sequence is filled
        lengths.take([k for k in set(used) for _ in range(used.count(k))], times)
        patterns.append((used, times))
    return patterns


def _segments(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For every length of every pattern: length, first rank, end of ranks, uses per sequence, first sequence, offset in it."""
    out, ranks, sequence = [], {}, 0
    for used, times in patterns:
        offset = 0
        for k in sorted(set(used), reverse=True):
            uses = used.count(k)
            start = ranks.get(k, 0)
            ranks[k] = start + uses * times
            out.append((k, start, ranks[k], uses, sequence, offset))
            offset += uses * k
        sequence += times
    return out


def pieces(lengths: DataFrame, capacity: int) -> DataFrame:
    """Rows of (doc_id, piece, token_start, n): one per text, or one per full piece and rest of a longer one."""
    last = F.greatest(F.expr(f"cast((n_tokens + {capacity - 1}) div {capacity} as int)"), F.lit(1)) - 1
    rows = lengths.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    return rows.select("doc_id", "piece", start.alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - start).alias("n"))


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of (doc_id, piece, token_start, n_tokens, sequence_id, sequence_offset) for rows of (doc_id, n_tokens)."""
    spark = lengths.sparkSession
    items = cut(pieces(lengths, capacity))
    # one row per length, whatever the number of texts; a full piece is a sequence by itself and needs no plan
    counts = {r.n: r["count"] for r in items.where((F.col("n") > 0) & (F.col("n") < capacity)).groupBy("n").count().collect()}
    patterns = plan(counts, capacity)
    places = spark.createDataFrame(_segments(patterns), "n bigint, first bigint, end bigint, uses bigint, sequence bigint, base bigint")
    # common lengths are ranked in as many groups as they need
    salts = max(1, math.ceil(max(counts.values(), default=0) / GROUP))
    salted = items.where((F.col("n") > 0) & (F.col("n") < capacity)).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    groups = Window.partitionBy("n").orderBy("salt")
    before = salted.groupBy("n", "salt").agg(F.count("*").alias("size")).select("n", "salt", (F.sum("size").over(groups) - F.col("size")).alias("before"))
    order = Window.partitionBy("n", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("place", F.row_number().over(order)).join(before.hint("shuffle_merge"), ["n", "salt"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    # bounded by the number of patterns, itself by that of lengths
    p = places.withColumnRenamed("n", "length").hint("broadcast")
    placed = ranked.join(p, (F.col("n") == F.col("length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    at = F.col("rank") - F.col("first")
    packed = placed.select("doc_id", "piece", "token_start", F.col("n").alias("n_tokens"), (F.col("sequence") + F.expr("(rank - first) div uses")).alias("sequence_id"), (F.col("base") + (at % F.col("uses")) * F.col("n")).alias("sequence_offset"))
    full = items.where(F.col("n") == capacity).select("doc_id", "piece", "token_start", F.col("n").alias("n_tokens"), (F.lit(sum(times for _, times in patterns)) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("sequence_offset"))
    none = F.lit(None).cast("bigint")
    return packed.unionByName(full).unionByName(items.where("n <= 0").select("doc_id", "piece", "token_start", F.col("n").alias("n_tokens"), none.alias("sequence_id"), none.alias("sequence_offset")))


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or piece of a longer one, with its sequence and its place in it."""
    return pack(token_counts(table(spark, folder, "documents", "doc_id", "text")))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How many sequences hold how many tokens of unused room, with the texts in them."""
    used = p8_packing(spark, folder).where("sequence_id is not null").groupBy("sequence_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts"))
    return used.groupBy((F.lit(CAPACITY) - F.col("tokens")).cast("bigint").alias("unused")).agg(F.count("*").alias("sequences"), F.sum("texts").alias("texts"))


QUERIES = {"p8_packing": p8_packing, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
