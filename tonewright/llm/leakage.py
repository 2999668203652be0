"""Problem 9: passages of held-out test items inside corpus documents.

Latent semantic retrieval: passages of all documents (overlapping windows of words) and the items are
weighted by TF-IDF with document frequencies over the whole corpus, and projected on the right
singular vectors of the passage matrix, found by a randomised SVD whose products with the matrix are
computed where the passages are. The SVD is fitted on the items and on a bounded sample of at most
FIT_DOCUMENTS documents; every passage of every document is projected and compared with the items,
which are a stated query set: they are taken in blocks of bounded size, and the windows of a task meet
one block at a time, so what is sent to the tasks doesn't grow with the number of items.

A document and an item whose cosine reaches the threshold at some window are candidates. A candidate is
kept by two checks that follow from one definition, a stretch of which at most a share CHANGED of the
words was changed: first it must hold pairs of neighbouring words as densely as such a stretch does,
then the longest common subsequence with few changes, scored over the whole document, must cover half
of the item in one stretch or in two that follow each other in the item. The last check is on the
answer: the words of the stretch that don't belong to a common turn of phrase (the pairs they form are
rare in the corpus) must mostly be those of the document, so a sentence with other names is no case.

Defined results: null and empty texts carry nothing; rows with a null id are left out; an id with
several texts is carried where one of them is; without items there are no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.sources.checkpoints import cut
from tonewright.sources.tables import table

STRIDE = 24  # words; a window is two strides
RANK = 256
EXTRA = 16
FIT_DOCUMENTS = 4000
THRESHOLD = 0.2
LEAST_SHARE = 0.485  # of an item's words: half of its text may be a little less than half of its words
CHANGED = 0.14  # of the words of a stretch: about one in ten, and one more in a short one
LEAST_STRETCH = 6  # words
LEAST_ANSWER, ANSWER_POWER = 0.75, 4.0  # of the weight of the words of the stretches, or of half the item where they have more
FOREIGN = 5  # words between two stretches, at least
POWER = 1.5  # of the inverse document frequency, so that names count for more than phrases
CHUNK, PART = 40_000, 64  # words taken at once; strides
BLOCK_ITEMS, BLOCK_BYTES = 1024, 4 << 20

_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; of Chinese and Japanese text single characters."""
    return _WORD.findall(text.lower()) if text else []


# --- alignment -------------------------------------------------------------------------------------

_HIT, _MISS = 2, 5
_ALLOWED = _HIT - CHANGED * (_HIT + _MISS)  # least score per word of a stretch


def stretches(words: np.ndarray, ends: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first and last word of the item, place of the last word, score) of all alignments with few changes.

    ``words`` are those of one or more documents, each followed by a place in ``ends`` that holds no word.
    One row of the table of alignments at a time is computed for all places, so the time is the product
    of both lengths whatever the words are. A cell holds the score and, in its low bits, where in the item
    the alignment began; it is kept with the cost of having come so far added, so that words left out in
    the document cost nothing more in the running maximum.
    """
    n, m = len(item), len(words)
    bits = int(n).bit_length()
    step = np.full(m, _MISS, np.int64)
    step[ends] = _HIT * n + _MISS  # more than any score, so no alignment goes on in the next document
    slope = np.cumsum(step) << bits
    if slope[-1] + ((_HIT * n + _MISS) << bits) < 1 << 31:
        slope = slope.astype(np.int32)
    miss, hit, one = (slope.dtype.type(x << bits) for x in (_MISS, _HIT, 1))
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    low, high = np.searchsorted(sorted_words, item), np.searchsorted(sorted_words, item, "right")
    known: dict[int, tuple[np.ndarray, ...]] = {}
    before, now = slope.copy(), np.empty_like(slope)
    found = []
    for i in range(n):
        np.subtract(before, miss, out=now)
        np.maximum(now[1:], before[:-1], out=now[1:])
        some = high[i] > low[i]
        if some:
            if (places := known.get(low[i])) is None:
                at = order[low[i] : high[i]]
                known[low[i]] = places = at, at - 1, slope[at], (at == 0) | (step[at - 1] != _MISS)
            at, ahead, here, opens = places
            gone = before[ahead] + miss
            gone[opens] = 0  # nothing goes on from another document
            now[at] = np.where(gone < here + one, here + slope.dtype.type(n - i), gone) + hit
        np.maximum.accumulate(now, out=now)
        np.maximum(now, slope, out=now)
        if some:
            value = now[at] - here
            score = value >> bits
            length = (value & (one - 1)) - (n - 1 - i)
            good = (length >= LEAST_STRETCH) & (score >= _ALLOWED * length)
            if good.any():
                length = length[good].astype(np.int64)
                found.append((i + 1 - length, np.full(len(length), i), at[good], score[good]))
        before, now = now, before
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found))


def longest_pair(first: np.ndarray, last: np.ndarray, at: np.ndarray) -> tuple[int, int, int]:
    """Most words of the item in two stretches that follow each other in it, with foreign words between; and the two, by index."""
    length = last - first + 1
    order = np.lexsort((at, last))
    ends, places = last[order], at[order]
    wide = int(at.max()) + 2
    big = len(order) + 1
    # the longest stretch so far that ends at the same word; the index tells which
    top = np.maximum.accumulate((ends * (int(length.max()) + 1) + length[order]) * big + np.arange(len(order)))
    keys = ends * wide + places
    best = (0, -1, -1)
    for gap in range(4):
        goal, limit = first - gap, at - length + 1 - FOREIGN - gap
        k = np.searchsorted(keys, goal * wide + np.maximum(limit, -1), "right") - 1
        fits = (k >= 0) & (limit >= 0) & (goal >= 0)
        fits[fits] &= ends[k[fits]] == goal[fits]
        if fits.any():
            second = np.flatnonzero(fits)
            one = order[top[k[second]] % big]
            total = length[second] + length[one]
            j = int(total.argmax())
            if total[j] > best[0]:
                best = int(total[j]), int(one[j]), int(second[j])
    return best


def carried(texts: list[np.ndarray], item: np.ndarray, weight: np.ndarray) -> list[bool]:
    """Whether each text carries at least half of the item; words as numbers, -1 for any that the item's block doesn't have."""
    out = [False] * len(texts)
    need = LEAST_SHARE * len(item)
    words = np.concatenate([np.append(t, -1) for t in texts])
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    first, last, at, score = stretches(words, ends, item)
    owner = np.searchsorted(ends, at)
    length = last - first + 1

    def answered(*which: int) -> bool:
        kept = total = 0.0
        for k in which:
            asked, weights = item[first[k] : last[k] + 1], weight[first[k] : last[k] + 1]
            said = words[max(at[k] - int(length[k] * (1 + CHANGED)) - 1, 0) : at[k] + 1]
            kept += float(weights[np.isin(asked, said)].sum())
            total += float(weights.sum())
        return kept >= LEAST_ANSWER * min(total, float(weight.sum()) / 2)

    order = np.argsort(owner, kind="stable")
    bounds = np.flatnonzero(np.append(True, owner[order][1:] != owner[order][:-1])) if len(order) else []
    for a, b in zip(bounds, [*bounds[1:], len(order)]):
        rows = order[a:b]
        longest = rows[length[rows].argmax()]
        if length[longest] >= need:
            # that with the fewest changes among those long enough, which may leave out changed words at an end
            enough = rows[length[rows] >= need]
            out[owner[longest]] = answered(enough[score[enough].argmax()])
        elif 2 * length[longest] >= need:
            total, one, two = longest_pair(first[rows], last[rows], at[rows])
            if total >= need:
                out[owner[longest]] = answered(rows[one], rows[two])
    return out


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


class Neighbours:
    """Pairs of neighbouring words of the items, to tell which candidates hold them as densely as a stretch must."""

    def __init__(self, items: list[np.ndarray], other: int):
        self.size, self.other = other + 1, other
        self.n = np.array([len(x) for x in items], np.int64)
        # of two stretches the longer has half of what is needed; its words with changes keep so many pairs
        self.window = np.ceil(LEAST_SHARE * self.n / 2).astype(np.int64)
        self.least = np.ceil((1 - 2 * CHANGED) * self.window - 1).astype(np.int64)
        self.shift = np.ceil(np.log2(np.maximum(4.0, CHANGED * self.window))).astype(np.int64)
        code = np.concatenate([x[:-1].astype(np.int64) * self.size + x[1:] for x in items])
        who = np.concatenate([np.full(max(len(x) - 1, 0), k, np.int64) for k, x in enumerate(items)])
        place = np.concatenate([np.arange(max(len(x) - 1, 0)) for x in items])
        order = np.argsort(code, kind="stable")
        self.who, self.place = who[order], place[order]
        self.codes, self.start, self.count = np.unique(code[order], return_index=True, return_counts=True)

    def known(self, owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pair) of the neighbouring words of texts that the items have; owner: the text of each word."""
        if len(words) < 2 or not len(self.codes):
            return (np.zeros(0, np.int64),) * 2
        t = np.flatnonzero((owner[1:] == owner[:-1]) & (words[:-1] < self.other) & (words[1:] < self.other))
        code = words[t] * self.size + words[t + 1]
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[k] == code
        return t[hit], k[hit]

    def answers(self, rarity: np.ndarray) -> list[np.ndarray]:
        """The weight of every word of each item as an answer, for the rarity of each pair in the corpus: that of the commoner
        of the two pairs it is in, so that words of a common turn of phrase weigh little however rare they are."""
        weights = [np.full((2, n), np.inf) for n in self.n]
        for k, (start, times) in enumerate(zip(self.start, self.count)):
            for who, place in zip(self.who[start : start + times], self.place[start : start + times]):
                weights[who][0, place] = weights[who][1, place + 1] = rarity[k]
        return [np.where(np.isinf(w.min(0)), 1.0, w.min(0)) ** ANSWER_POWER for w in weights]

    def dense(self, texts: list[np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) of the pairs wanted (a matrix) that may carry an item; nothing that carries one is left out."""
        lengths = np.array([len(x) for x in texts])
        owner, words = np.repeat(np.arange(len(texts)), lengths), np.concatenate(texts).astype(np.int64)
        short = self.least <= 0  # items of a few words need no pair
        text, item = np.nonzero(wanted & short[None, :])
        none = text, item
        t, k = self.known(owner, words)
        if not len(k):
            return none
        times = self.count[k]
        base = np.repeat(self.start[k] - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
        t = np.repeat(t, times)
        ok = wanted[owner[t], self.who[base]]
        t, base = t[ok], base[ok]
        if not len(t):
            return none
        who, place = self.who[base], self.place[base]
        # most candidates hold too few pairs wherever they stand
        each = owner[t] * len(self.n) + who
        enough = np.bincount(each, minlength=wanted.size)[each] >= self.least[who]
        t, who, place = t[enough], who[enough], place[enough]
        if not len(t):
            return none
        begin = np.append(0, np.cumsum(lengths)[:-1])
        # pairs of words at like distances lie in one of two overlapping bands
        band = ((t - begin[owner[t]] - place + self.n[who]) >> self.shift[who]) + 1
        bands, places = int(band.max()) + 1, 2 * (int(self.n.max()) + 1)
        pair = (owner[t] * len(self.n) + who) * bands + band
        keys = _distinct(np.concatenate([pair * places + place, (pair - 1) * places + place]))
        both = keys // places // bands
        which = both % len(self.n)
        held = np.searchsorted(keys, keys + self.window[which] - 1) - np.arange(len(keys))
        both = _distinct(both[held >= self.least[which]])
        return np.append(text, both // len(self.n)), np.append(item, both % len(self.n))


# --- latent space ----------------------------------------------------------------------------------


def _strides(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the strides of concatenated documents, the document of each, and whether the next is of the same."""
    starts, owner = [], []
    at = 0
    for d, n in enumerate(lengths):
        if n:
            s = np.arange(at, at + n, STRIDE)
            starts.append(s)
            owner.append(np.full(len(s), d))
            at += n
    if not starts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    own = np.concatenate(owner)
    return np.concatenate(starts), own, np.append(own[1:] == own[:-1], False)


def _chunks(ids: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about CHUNK words; a longer document is one range."""
    first, size = 0, 0
    for k, x in enumerate(ids):
        if size and size + len(x) > CHUNK:
            yield first, k
            first, size = k, 0
        size += len(x)
    if size:
        yield first, len(ids)


def _windows(ids: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the weights' rows over the windows of documents, the document of each, strides' starts and whether the next goes on."""
    starts, own, more = _strides([len(x) for x in ids])
    words, ends = np.concatenate(ids), np.append(starts[1:], sum(map(len, ids)))
    sums = np.empty((len(starts), weights.shape[1]), weights.dtype)
    for a in range(0, len(starts), PART):  # so few that their weights stay in the cache
        b = min(a + PART, len(starts))
        sums[a:b] = np.add.reduceat(weights[words[starts[a] : ends[b - 1]]], starts[a:b] - starts[a], axis=0)
    both = sums.copy()
    both[:-1][more[:-1]] += sums[1:][more[:-1]]
    return both, own, starts, more


def _product(ids: list[np.ndarray], idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A^T (A right) for the passage matrix A of the documents."""
    out = np.zeros_like(right)
    scaled = (idf[:, None] * right).astype(np.float32)
    for a, b in _chunks(ids):
        both, _, starts, more = _windows(ids[a:b], scaled)
        # a word is in the window that begins at its stride and in the one before
        near = both.copy()
        near[1:][more[:-1]] += both[:-1][more[:-1]]
        words = np.concatenate(ids[a:b])
        stride = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
        order = np.argsort(words, kind="stable")
        begin = np.flatnonzero(np.append(True, words[order][1:] != words[order][:-1]))
        kinds = words[order][begin]
        out[kinds] += idf[kinds][:, None] * np.add.reduceat(near[stride[order]], begin, axis=0)
    return out


def fit_basis(sample: DataFrame, items: list[np.ndarray], idf: np.ndarray, kind: np.dtype, rank: int = RANK) -> np.ndarray:
    """Right singular vectors of the TF-IDF passage matrix, words by rank. ``sample`` has the column ids (bytes of that kind)."""
    n = len(idf) - 1  # the last row stands for all words that no item has
    size = min(rank + EXTRA, n)
    if size >= n:
        return np.vstack([np.eye(n, dtype=np.float32), np.zeros((1, n), np.float32)])
    known = idf.copy()
    known[-1] = 0.0

    def distributed(right: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                part = _product([np.frombuffer(x, kind).astype(np.int32) for x in b.column(0).to_pylist()], known, right)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["part"])

        # as many partial products as the bounded sample has partitions
        return sum((np.frombuffer(r.part, np.float32).reshape(right.shape).astype(np.float64) for r in sample.mapInArrow(partial, "part binary").toLocalIterator()), np.zeros(right.shape))

    random = np.random.default_rng(9).standard_normal((n + 1, size)).astype(np.float32)
    random[-1] = 0
    corpus, own = distributed(random), _product(items, known, random).astype(np.float64)
    # items and corpus weigh the same, so that the few items are not lost among the passages
    share = np.linalg.norm(corpus) / max(np.linalg.norm(own), 1e-9)
    q = np.linalg.qr(corpus + max(share, 1.0) * own)[0].astype(np.float32)
    gram = q.T.astype(np.float64) @ (distributed(q) + max(share, 1.0) * _product(items, known, q))
    vectors = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1][:, :rank]
    return (q @ vectors.astype(np.float32)).astype(np.float32)


# --- the search ------------------------------------------------------------------------------------


def _block_leaks(docs: DataFrame, total: int, rows: list[tuple[int, list[str]]], threshold: float, verify: bool) -> DataFrame:
    """The leaks of one block of items, each with its words."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in rows for w in ws}))}
    other = len(vocabulary)
    share = min(1.0, FIT_DOCUMENTS / max(total, 1))

    items = [np.array([vocabulary[w] for w in ws], np.int32) for _, ws in rows]
    neighbours = Neighbours(items, other)
    small = np.dtype(np.uint16 if other < 65535 else np.int32)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = np.zeros(other + 1, np.int64), np.zeros(len(neighbours.codes), np.int64)
        get = vocabulary.get
        for b in batches:
            ids = [np.array([get(w, other) for w in words_of(text)], np.int32) for text in b.column(1).to_pylist()]
            for first, end in _chunks(ids):
                owner = np.repeat(np.arange(end - first), [len(x) for x in ids[first:end]])
                flat = np.concatenate(ids[first:end]).astype(np.int64)
                words += np.bincount(_distinct(owner * (other + 1) + flat) % (other + 1), minlength=other + 1)
                t, k = neighbours.known(owner, flat)
                if len(k):
                    pairs += np.bincount(_distinct(owner[t] * len(pairs) + k) % len(pairs), minlength=len(pairs))
            keys = b.column(0).to_pylist()
            sampled = [(key * 2654435761 & 0xFFFFFFFF) < share * 4294967296 for key in keys]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([x.astype(small).tobytes() for x in ids], pa.binary()), pa.array(sampled), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int64())], names=["doc_id", "ids", "sampled", "what", "n"])
        # counts of words, then those of pairs
        n = np.concatenate([words, pairs])
        what = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(what), pa.int64()), pa.nulls(len(what), pa.binary()), pa.nulls(len(what), pa.bool_()), pa.array(what, pa.int64()), pa.array(n[what], pa.int64())], names=["doc_id", "ids", "sampled", "what", "n"])

    counted = cut(docs.mapInArrow(counts, "doc_id bigint, ids binary, sampled boolean, what bigint, n bigint"))
    plain, common = np.full(other + 1, np.log(1.0 + total), np.float32), np.zeros(len(neighbours.codes))
    for r in counted.where("what is not null").groupBy("what").agg(F.sum("n").alias("n")).collect():  # at most the block's words and pairs
        if r.what <= other:
            plain[r.what] = np.log((1.0 + total) / (1.0 + r.n))
        else:
            common[r.what - other - 1] = r.n
    plain = np.maximum(plain, 1e-3)
    plain[other] = float(plain[:other].mean()) if other else 1.0
    answers = neighbours.answers(np.log((2.0 + total) / (1.0 + common)))
    idf = plain**POWER
    basis = fit_basis(counted.where("sampled").select("ids").coalesce(8), items, idf, small)
    projection = (idf[:, None] * basis).astype(np.float32)
    squares = (idf * idf).astype(np.float32)
    queries = np.stack([projection[x].sum(0) for x in items])
    queries /= np.sqrt(np.array([squares[x].sum() for x in items]))[:, None]
    queries = np.ascontiguousarray(queries.T)
    weights = np.hstack([projection, squares[:, None]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            ids = [np.frombuffer(x, small).astype(np.int32) for x in b.column(1).to_pylist()]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for first, end in _chunks(ids):
                sums, own, _, _ = _windows(ids[first:end], weights)
                near = sums[:, :-1] @ queries >= threshold * np.sqrt(np.maximum(sums[:, -1:], 1e-6))
                w, i = np.nonzero(near)
                wanted = np.zeros((end - first, len(rows)), bool)
                wanted[own[w], i] = True
                d, i = neighbours.dense(ids[first:end], wanted) if verify else np.nonzero(wanted)
                found.append((d + first, i))
            if not found:
                continue
            d, i = (np.concatenate(x) for x in zip(*found))
            if verify:
                kept = np.zeros(len(d), bool)
                order = np.argsort(i, kind="stable")
                for a, e in zip(begin := np.flatnonzero(np.append(True, i[order][1:] != i[order][:-1])) if len(order) else [], [*begin[1:], len(order)]):
                    which = order[a:e]
                    texts = [np.where(ids[k] == other, -1, ids[k]) for k in d[which]]
                    for s, t in _chunks(texts):
                        kept[which[s:t]] = carried(texts[s:t], items[i[which[0]]], answers[i[which[0]]])
                d, i = d[kept], i[kept]
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in d], pa.int64()), pa.array([rows[k][0] for k in i], pa.int64())], names=["doc_id", "item_id"])

    return counted.where("ids is not null").select("doc_id", "ids").mapInArrow(search, "doc_id bigint, item_id bigint")


def leaks(documents: DataFrame, evaluation: DataFrame, threshold: float = THRESHOLD, verify: bool = True, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id) of the documents that carry an item; without ``verify`` the candidates of the search."""
    spark = documents.sparkSession
    items = evaluation.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(size.n / block_items), math.ceil(size.bytes / BLOCK_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    if blocks > 1:
        items = cut(items)
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    total = docs.count()
    parts = []
    for block in range(blocks):
        rows = [(r.item_id, words_of(r.text)) for r in items.where(F.col("block") == block).orderBy("item_id", "text").collect()]
        rows = [r for r in rows if r[1]]
        if rows:
            found = _block_leaks(docs, total, rows, threshold, verify)
            parts.append(found if blocks == 1 else cut(found))
    if not parts:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return reduce(DataFrame.union, parts).distinct()


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that carry an item and the item."""
    return leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every test item with the number of documents that carry it."""
    found = p9_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))
    items = table(spark, folder, "eval_items", "item_id", "lang", "task").distinct()
    return items.join(F.broadcast(found), "item_id", "left").select("item_id", "lang", "task", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
SQL: dict[str, str] = {}
