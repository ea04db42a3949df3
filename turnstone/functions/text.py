"""Text expressions that behave like Python's, as column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC, which no built-in function gives: the one Python expression of the text path."""
    return _nfkc(text)


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t).strip())


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t).strip().casefold())


def nfc(text: Column) -> Column:
    """NFC, stripped."""
    return _nfc(text)


def folded(text: Column) -> Column:
    """What texts have in common that differ only in case, canonical form and outer white space."""
    return _folded(text)


def lower_each(text: Column) -> Column:
    """Each character in lower case by itself, as SQL has it: one for one, whatever stands beside it."""
    return F.array_join(F.transform(F.split(F.translate(text, "İ", "i"), ""), F.lower), "")


def canonical_json(value: Column, kind: DataType) -> Column:
    """JSON without blanks, keys in order at every level, nulls written; ``kind`` is the type of ``value``."""
    text = F.to_json(F.struct(_ordered(value, kind).alias("v")), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(6), F.length(text) - 6)


def _ordered(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*(_ordered(value.getField(f.name), f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, MapType):
        sorted_map = F.map_from_entries(F.array_sort(F.map_entries(value)))
        return F.transform_values(sorted_map, lambda _, x: _ordered(x, kind.valueType))
    return value


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def unquote(text: Column) -> Column:
    """Stripped, and without one pair of equal quotes around the rest."""
    return F.regexp_replace(strip(text), r"(?s)^([\"'])(.*)\1$", "$2")


def replace_all(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def slug(text: Column, default: str = "lesson") -> Column:
    """Lower case, with '-' for each run of other characters than digits, a-z, Hangul, '_' and '-'."""
    found = F.trim(F.regexp_replace(F.lower(strip(text)), "[^0-9a-z가-힣_-]+", "-"), F.lit("-"))
    return F.when(F.length(found) > 0, found).otherwise(F.lit(default))


def seconds(text: Column) -> Column:
    """Seconds of 'MM:SS', 'HH:MM:SS' or such with a fraction after point or comma; null if it is none of these.

    A plain number, as JSON has them, counts as seconds; brackets around the text are ignored.
    """
    plain = F.replace(F.regexp_replace(strip(text), r"^[\[\]]+|[\[\]]+$", ""), F.lit(","), F.lit("."))
    parts = F.split(plain, ":")

    def part(k: int, kind: str) -> Column:
        return F.try_element_at(parts, F.lit(k)).try_cast(kind)

    two = part(1, "int") * 60 + part(2, "double")
    three = part(1, "int") * 3600 + part(2, "int") * 60 + part(3, "double")
    n = F.size(parts)
    return F.when(F.length(plain) == 0, None).when(n == 1, plain.try_cast("double")).when(n == 2, two).when(n == 3, three).cast("double")


def strict_seconds(text: Column) -> Column:
    """As `seconds`, but a text that is no time raises; null and blank ones stay null."""
    found = seconds(text)
    return F.when(found.isNull() & (F.length(strip(text)) > 0), F.raise_error(F.concat(F.lit("not a time: "), text)).cast("double")).otherwise(found)


def clock(secs: Column) -> Column:
    """HH:MM:SS.mmm of seconds."""
    ms = F.round(secs * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", (ms / 3_600_000).cast("long"), ((ms / 60_000).cast("long") % 60), ((ms / 1000).cast("long") % 60), ms % 1000)


def one_line(text: Column, limit: int) -> Column:
    """On one line, cut to ``limit`` characters with an ellipsis."""
    flat = F.regexp_replace(strip(text), r"(?U)\s+", " ")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(limit - 1))), F.lit("…")))


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def ratio(part: Column, whole: Column, otherwise: float = 0.0) -> Column:
    """part / whole, or ``otherwise`` where whole is zero."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(otherwise))
