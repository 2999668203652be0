"""Unicode functions that Spark has no built-in for, as Arrow functions over whole batches."""

from __future__ import annotations

import string
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

_KEEP = regex.compile(r"[^\p{L}\p{N}]+")
_ASCII = {i: None for i in range(128) if chr(i) not in string.ascii_letters + string.digits} | {ord(c): c.lower() for c in string.ascii_uppercase}


def name_key_of(text: str | None) -> str:
    """The text in NFKC, lower-cased, with all but letters and digits removed; '' for None."""
    if not text:
        return ""
    if text.isascii():
        return text.translate(_ASCII)
    return _KEEP.sub("", unicodedata.normalize("NFKC", text).lower())


@arrow_udf(StringType())
def name_key(texts: pa.Array) -> pa.Array:
    """Name key of each text; '' where it is null or holds no letter or digit."""
    return pa.array([name_key_of(x) for x in texts.to_pylist()], pa.string())


@arrow_udf(StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Each text in Unicode NFC; null stays null."""
    return pa.array([x if x is None or x.isascii() or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x) for x in texts.to_pylist()], pa.string())
