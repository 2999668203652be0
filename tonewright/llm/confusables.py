"""Letters of other scripts that look like Latin ones, and words that mix scripts."""

from __future__ import annotations

import regex

# Look-alike letters (fixed values): Cyrillic and Greek letters with the Latin letter they look like.
CYRILLIC_AS_LATIN = {"А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "h", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԛ": "q", "ԝ": "w", "һ": "h", "ԁ": "d", "ӏ": "l"}
GREEK_AS_LATIN = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "υ": "u", "κ": "k", "χ": "x", "γ": "y"}
OTHER_AS_LATIN = {"ı": "i", "ɡ": "g", "ɑ": "a", "Ɩ": "l", "ѵ": "v", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "Ꭺ": "A", "Ꭼ": "E", "Ꮇ": "M", "Ꭲ": "T"}
AS_LATIN = CYRILLIC_AS_LATIN | GREEK_AS_LATIN | OTHER_AS_LATIN
LATIN_AS_CYRILLIC = {b: a for a, b in reversed(CYRILLIC_AS_LATIN.items())}

WORD = regex.compile(r"[\p{L}\p{M}­​-‏⁠-⁤﻿]+")
_LATIN = regex.compile(r"\p{Latin}")
_FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}]")
_MIXED = regex.compile(r"\p{Latin}[^\P{L}\p{Latin}]|[^\P{L}\p{Latin}]\p{Latin}|\p{Greek}\p{Cyrillic}|\p{Cyrillic}\p{Greek}")


def plain_word(word: str) -> str:
    """The word in one script, if it mixes scripts only through look-alike letters; else as it is."""
    latin, foreign = _LATIN.findall(word), _FOREIGN.findall(word)
    if not latin and any(regex.match(r"\p{Greek}", c) for c in foreign) and any(regex.match(r"\p{Cyrillic}", c) for c in foreign):
        pass
    elif not (latin and foreign):
        return word
    if len(foreign) > len(latin) and all(c in LATIN_AS_CYRILLIC for c in latin):
        return "".join(LATIN_AS_CYRILLIC.get(c, c) for c in word)
    if all(c in AS_LATIN for c in foreign) and len(latin) >= 1:
        return "".join(AS_LATIN.get(c, c) for c in word)
    if latin and all(c in LATIN_AS_CYRILLIC for c in latin):
        return "".join(LATIN_AS_CYRILLIC.get(c, c) for c in word)
    return word


def plain_letters(text: str) -> str:
    """The text with each word that mixes scripts through look-alike letters in its one script."""
    return WORD.sub(lambda m: plain_word(m[0]), text) if _FOREIGN.search(text) else text
