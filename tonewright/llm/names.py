"""Names as people type them: plain tokens, alignment of tokens, and correction of misspelt tokens."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from tonewright.functions.unicode import name_key_of
from tonewright.llm.lookalike import canonical
from tonewright.llm.mojibake import repair

# Cyrillic letters in Latin (fixed values).
LATIN = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya"}
# Letters without a decomposition (fixed values).
PLAIN = {"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"}
_LETTERS = str.maketrans(LATIN | PLAIN)

# Short forms of first names that are no start of the name (fixed values).
SHORT_FORMS = {
    "elizabeth": "betty liz lizzie beth eliza lisa libby bess", "william": "bill billy will liam", "robert": "bob bobby rob", "richard": "dick rick", "margaret": "maggie meg peggy greta", "katherine": "kate kathy katie kitty kat",
    "alexander": "sasha sandy xander", "john": "jack johnny", "james": "jim jimmy", "charles": "chuck charlie", "edward": "ted ned eddie", "theodore": "ted teddy", "anthony": "tony", "michael": "mike mick", "josephine": "josie jo", "joseph": "joe", "dorothea": "dora dolly dot thea",
    "patricia": "pat patty trish tricia", "christopher": "kit topher", "francisco": "paco pancho frank", "nathaniel": "nate nat", "zachary": "zack zak", "frederick": "freddy freddie rick", "gregory": "gregg", "benjamin": "benny", "samuel": "sammy", "matthias": "matt matze", "susannah": "sue susie suzy anna", "eleanor": "ellie nell nora ella",
    "leonard": "lenny len leo", "sebastian": "bastian seb", "wilhelmina": "mina nina willa billie minnie", "anastasia": "stacy nastya ana", "valentina": "tina nina val", "konstantin": "kostya", "johannes": "hans hannes jan jo", "guadalupe": "lupe lupita", "raphael": "rafa ralph raf", "mc": "emcee", "dj": "deejay", "dr": "doctor",
}
_SHORT = {(short, name) for name, shorts in SHORT_FORMS.items() for short in shorts.split()}

_NICKNAMES: dict[str, set[str]] = {}
for _short, _name in _SHORT:
    _NICKNAMES.setdefault(_short, set()).add(_name)
    _NICKNAMES.setdefault(_name, set()).add(_short)

# the full name of each short form and of each start of three or more letters; a form of several names goes to the first
FULL_NAMES = {short: name for name, shorts in reversed(SHORT_FORMS.items()) for short in (*(name[:k] for k in range(3, len(name))), *shorts.split())}

_CREDIT = regex.compile(r"[^\s(\[]\W*[\s(\[]\W*(?:feat|ft|featuring)\b\W*\w", regex.I)
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})")
_TOKEN = regex.compile(r"[\p{L}\p{N}]+|&")
TITLES = {"dr", "dj", "mc", "deejay", "emcee", "doctor"}
PLACEHOLDERS = {"artist unknown", "artists various", "artist various", "unknown", "various", "va"}


@lru_cache(maxsize=50_000)
def plain_tokens(raw: str) -> tuple[str, ...]:
    """The words of a name without accents, look-alikes, case, punctuation and articles, in the order typed."""
    text = raw
    if not raw.isascii() or "?" in raw:
        bad, fixed = repair(raw)
        if bad and fixed:
            text = fixed
        text = canonical(text)
    text = _CAMEL.sub(" ", text).lower().replace("'", "").replace("’", "")
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).translate(_LETTERS)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    # a lost letter leaves its word in one piece
    text = regex.sub(r"(?<=\p{L})[?�](?=\p{L})", "", text)
    out = ["and" if t == "&" else t for t in _TOKEN.findall(text)]
    return tuple(t for t in out if t != "the") or tuple(out)


def is_credit(raw: str) -> bool:
    """Whether the name credits a featured artist."""
    return bool(_CREDIT.search(raw.replace("_", " ")))


NAME = StructType([StructField("key", StringType()), StructField("form", StringType()), StructField("credit", BooleanType())])


@arrow_udf(NAME)
def name_parts(raws: pa.Array) -> pa.Array:
    """Name key, plain tokens (space between) and whether the name is a credit."""
    rows = []
    for raw in raws.to_pylist():
        if raw is None:
            rows.append({"key": "", "form": "", "credit": False})
        else:
            rows.append({"key": name_key_of(raw), "form": " ".join(plain_tokens(raw)), "credit": is_credit(raw)})
    return pa.array(rows, pa.struct([("key", pa.string()), ("form", pa.string()), ("credit", pa.bool_())]))


name_parts = name_parts.asNondeterministic()  # or a filter on the result would evaluate it again


def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours turns a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def abbreviates(a: str, b: str) -> bool:
    """Whether a is a short form of b: its start, its consonants in order, or a known nickname."""
    if len(a) >= len(b):
        return (a, b) in _SHORT
    if len(a) >= 2 and b.startswith(a) or (a, b) in _SHORT:
        return True
    if a[0] != b[0] or len(a) < 2 or len(a) > 5:
        return False
    if a[-1] == "s" and b[-1] == "s" and len(a) > 2 and b.startswith(a[:-1]):
        return True
    rest = iter(b)
    return not any(c in "aeiouy" for c in a[1:]) and all(c in rest for c in a)


def token_cost(a: str, b: str) -> int | None:
    """0 equal, 1 misspelt, 2 short form, 3 initial; None where the tokens can't stand for each other."""
    if a == b:
        return 0
    if len(a) == 1 or len(b) == 1:
        return 3 if a[0] == b[0] and min(len(a), len(b)) == 1 and len(a) != len(b) else None
    if min(len(a), len(b)) >= 3 and near(a, b):
        return 1 if max(len(a), len(b)) >= 4 else 2
    return 2 if abbreviates(a, b) or abbreviates(b, a) else None


def spare(token: str) -> bool:
    """Whether a name may have the token or not: a middle initial, a title, or an article with a slip."""
    return len(token) == 1 or token in TITLES or len(token) in (2, 3, 4) and near(token, "the") and token[0] in "th"


def consonants(a: str) -> bool:
    """Whether a may shorten a name to its consonants."""
    return 2 <= len(a) <= 5 and not any(c in "aeiouy" for c in a[1:])


_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_POWERS = [1]
_WHOLE, _START, _CUT, _LETTERS_OF, _SHORTENED = 1, 2, 3, 4, 5  # what a sign is the hash of


def _signed(kind: int, value: int, size: int) -> int:
    return (value + kind * _POWERS[size]) % _PRIME


def _hashes(t: str) -> list[int]:
    """The hashes of all starts of a token, by length, each from the one before."""
    while len(_POWERS) <= len(t):
        _POWERS.append(_POWERS[-1] * _BASE % _PRIME)
    out = [0]
    for c in t:
        out.append((out[-1] * _BASE + ord(c)) % _PRIME)
    return out


def _cuts(t: str) -> set[int]:
    """Signs that tokens one slip apart share: the token, and what is left without one of its letters."""
    n, h = len(t), _hashes(t)
    if n < 3:
        return set()
    rest = (_POWERS[n - 1 - i] for i in range(n))
    return {_signed(_CUT, h[n], n), *(_signed(_CUT, (h[i] * p + h[n] - h[i + 1] * p) % _PRIME, n - 1) for i, p in enumerate(rest))}


def _two_letters(kind: int, t: str) -> set[int]:
    return {_signed(kind, _hashes(t[0] + c)[2], 2) for c in set(t[1:]) if c not in "aeiouy"}


def signs_kept(t: str) -> set[int]:
    """The signs a listed token is kept under: a number in proportion to its length, whose hashes are made in that time."""
    n, h = len(t), _hashes(t)
    out = {_signed(_WHOLE, h[n], n), *(_signed(_START, h[i], i) for i in range(1, n))} | _cuts(t) | _two_letters(_LETTERS_OF, t)
    return out | {_signed(_SHORTENED, _hashes(t[:2])[2], 2)} if consonants(t) else out


def signs_sought(t: str) -> set[int]:
    """The signs under one of which each listed token is kept that ``token_cost`` lets stand for this one."""
    n, h = len(t), _hashes(t)
    out = {_signed(_START, h[n], n), *(_signed(_WHOLE, h[i], i) for i in range(1, n + 1))} | _cuts(t) | _two_letters(_SHORTENED, t)
    out |= {_signed(_WHOLE, _hashes(other)[len(other)], len(other)) for other in _NICKNAMES.get(t, ())}
    if n > 2 and t[-1] == "s":  # a start and an s
        out |= {_signed(_START, h[n - 1], n - 1), *(_signed(_WHOLE, (h[i] * _BASE + ord("s")) % _PRIME, i + 1) for i in range(2, min(n - 1, 5)))}
    return out | {_signed(_LETTERS_OF, _hashes(t[:2])[2], 2)} if consonants(t) else out


@arrow_udf(ArrayType(LongType()))
def kept_under(tokens: pa.Array) -> pa.Array:
    return pa.array([list(signs_kept(t)) for t in tokens.to_pylist()], pa.list_(pa.int64()))


@arrow_udf(ArrayType(LongType()))
def sought_under(tokens: pa.Array) -> pa.Array:
    return pa.array([list(signs_sought(t)) for t in tokens.to_pylist()], pa.list_(pa.int64()))


@arrow_udf(BooleanType())
def are_partners(tokens: pa.Array, others: pa.Array) -> pa.Array:
    """Whether one token can stand for the other."""
    return pa.array([token_cost(a, b) is not None for a, b in zip(tokens.to_pylist(), others.to_pylist())], pa.bool_())


class Index:
    """Which of the names added so far may fit a name, by what their tokens share; it misses none that ``align`` fits.

    Tokens meet as equals, by a deletion that a slip leaves them in common, as start of one another, as consonants,
    or as nickname. Each token is kept under a number of hashes in proportion to its length.
    """

    def __init__(self):
        self.names: dict[tuple, list[int]] = {}
        self.loose: list[int] = []  # names that need no partner for any of their tokens
        self.size = 0

    @staticmethod
    def _slips(t: str) -> set[tuple]:
        """What tokens one slip apart share: a deletion, or half of a long token, whose deletions would be its length squared."""
        if len(t) <= 48:
            out = {("-", hash(t)), *(("-", hash(t[:i] + t[i + 1 :])) for i in range(len(t)))} if len(t) > 2 else set()
            if len(t) < 47:
                return out
        else:
            out = set()
        return out | {(side, h, hash(t[:h] if side == "<" else t[len(t) - h :])) for h in {(len(t) - 2) // 2, (len(t) - 1) // 2} for side in "<>"}

    def add(self, tokens: tuple[str, ...]) -> None:
        k = self.size
        self.size += 1
        for t in set(tokens):
            signs = {("=", t), *(("^", i, hash(t[:i])) for i in range(1, len(t))), *self._slips(t)}
            if consonants(t):
                signs.add(("c", t[0]))
            for sign in signs:
                self.names.setdefault(sign, []).append(k)
        if sum(not spare(t) for t in tokens) == 0 and len(tokens) <= 1:
            self.loose.append(k)

    def _partners(self, t: str) -> set[int]:
        signs = {("=", t), ("^", len(t), hash(t)), *(("=", t[:i]) for i in range(1, len(t))), *self._slips(t)}
        if len(t) > 2 and t[-1] == "s":
            signs.add(("^", len(t) - 1, hash(t[:-1])))
        if consonants(t):
            signs |= {("^", 1, hash(t[0]))}
        signs |= {("c", t[0])}
        for other in _NICKNAMES.get(t, ()):
            signs.add(("=", other))
        # a head that shortens to its start and an s
        signs |= {("=", t[:i] + "s") for i in range(2, len(t))} if t[-1] == "s" else set()
        return set().union(*(self.names.get(sign, ()) for sign in signs))

    def near(self, tokens: tuple[str, ...]) -> set[int]:
        """The names, by their number, one of which may be the same as this."""
        out = set(self.loose)
        if not tokens:
            return out
        found = sorted((self._partners(t) for t in set(tokens)), key=len)
        out |= found[0]
        # the token with the fewest partners may be one that needs none
        if any(_skipped(t) for t in tokens):
            out |= found[1] if len(found) > 1 else set()
        return out


def _skipped(token: str) -> bool:
    return len(token) == 1 or token in TITLES or near(token, "the")


def align(a: tuple[str, ...], b: tuple[str, ...], missing: int = 0) -> int | None:
    """Cost of the best assignment of the tokens of two names in any order, None if they can't be the same name.

    Every token needs a partner, but for one middle initial, title or misspelt article on either side, and up
    to ``missing`` words of b that a leaves out. Names of any number of tokens are assigned exactly.
    """
    left, right = list(a), list(b)
    for t in a:
        if t in right:
            right.remove(t)
            left.remove(t)
    if not left and not right:
        return 0
    if len(left) > len(right) + 1 or len(right) > len(left) + max(1, missing):
        return None
    best: int | None = None
    for i in (None, *(i for i, t in enumerate(left) if _skipped(t))):
        rows = left if i is None else left[:i] + left[i + 1 :]
        extra = len(right) - len(rows)
        if extra < 0 or extra > max(1, missing):
            continue
        costs = [[token_cost(x, y) for y in right] for x in rows]
        # places for the words of b that are left over
        may = [extra <= missing or spare(y) for y in right]
        costs += [[1 if m else None for m in may]] * extra
        c = _assigned(costs)
        if c is not None:
            c += i is not None
            best = c if best is None else min(best, c)
    return best


def _assigned(costs: list[list[int | None]]) -> int | None:
    """Least cost of giving each row a column of its own, None where that can't be; by shortest augmenting paths."""
    n = len(costs)
    if any(all(c is None for c in row) for row in costs):
        return None
    if n == 0:
        return 0
    never = 1 + sum(max((c for c in row if c is not None), default=0) for row in costs)
    row_price, column_price = [0] * n, [0] * n
    owner: list[int] = [-1] * n
    for start in range(n):
        reach: list[float] = [float("inf")] * n
        via, done = [-1] * n, [False] * n
        row, column, gone = start, -1, 0.0
        while True:
            nearest, at = float("inf"), -1
            for j in range(n):
                if done[j]:
                    continue
                c = costs[row][j]
                d = gone + (never if c is None else c) - row_price[row] - column_price[j]
                if d < reach[j]:
                    reach[j], via[j] = d, column
                if reach[j] < nearest:
                    nearest, at = reach[j], j
            gone, column = nearest, at
            done[column] = True
            if owner[column] < 0:
                break
            row = owner[column]
        row_price[start] += gone
        for j in range(n):
            if done[j] and owner[j] >= 0:
                row_price[owner[j]] += gone - reach[j]
            if done[j]:
                column_price[j] -= gone - reach[j]
        while column >= 0:
            before = via[column]
            owner[column] = owner[before] if before >= 0 else start
            column = before
    chosen = [costs[owner[j]][j] for j in range(n)]
    return None if any(c is None for c in chosen) else sum(chosen)


def _met(tokens: DataFrame, which: Column) -> DataFrame:
    """(token, other, n) for rows of (token, n): the pairs of tokens that one slip turns into each other, n that of the other.

    Tokens meet where they are equal after at most one deletion each (symmetric deletes), so no pairs
    of unlike tokens are formed. ``which`` is a condition on the two rows, a and b.
    """
    t = tokens.where(F.length("token") >= 4)
    # hashes, so that a long token writes no more than its length
    cuts = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.xxhash64(F.concat(F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, F.length("token")))))
    spread = t.select("token", "n", F.explode(F.array_distinct(F.array_append(cuts, F.xxhash64("token")))).alias("cut"))
    a, b = spread.alias("a"), spread.alias("b")
    met = a.join(b, (F.col("a.cut") == F.col("b.cut")) & which).select(F.col("a.token").alias("token"), F.col("b.token").alias("other"), F.col("b.n").alias("n"))
    gap = F.levenshtein("token", "other")
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    return met.where((gap <= 1) | ((gap == 2) & (F.length("token") == F.length("other")) & (letters("token") == letters("other"))))


def slips(tokens: DataFrame) -> DataFrame:
    """(token, other) for rows of (token): all pairs of tokens that one slip turns into each other, token < other."""
    return _met(tokens.select("token", F.lit(1).alias("n")), F.col("a.token") < F.col("b.token")).select("token", "other").distinct()


def corrected(tokens: DataFrame) -> DataFrame:
    """(token, center) for rows of (token, n): the commoner token that one slip turns it into, else itself.

    A token that is nearly as common as its neighbour stays its own.
    """
    commoner = (F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.token") < F.col("a.token")))
    distinct = (F.col("a.n") <= 2) | (F.col("b.n") >= 3 * F.col("a.n"))
    return _met(tokens, commoner & distinct).groupBy("token").agg(F.max_by("other", F.struct("n", "other")).alias("near"))
