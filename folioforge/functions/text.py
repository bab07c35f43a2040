"""Column functions on texts. All but ``indel_ratio`` run inside the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: what Python's str.split() splits at; Java's \\s alone is ASCII
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def tokens(text: Column, lower: bool = True) -> Column:
    """Tokens between white space, in order, with repetitions; null gives none."""
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.split(F.lower(t) if lower else t, SPACE), lambda w: w != "")


def token_set(text: Column, lower: bool = True) -> Column:
    return F.array_distinct(tokens(text, lower))


def truncate(text: Column, most: int = 2000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def clean(text: Column) -> Column:
    """One space for white space, no control characters, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, SPACE, " "), r"[\x00-\x1f\x7f-\x9f]", ""))


def clean_file_text(text: Column, most: int = 50_000) -> Column:
    """White space collapsed, only letters, digits and ordinary marks kept, cut, trimmed."""
    kept = F.regexp_replace(F.regexp_replace(text, SPACE, " "), r"[^一-龥a-zA-Z0-9\s.,;:!?()\[\]（）【】]", "")
    return F.trim(F.substring(kept, 1, most))


def rough_sentences(text: Column) -> Column:
    """Parts between wide end marks or line feeds."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[。！？\n]+"), lambda s: F.regexp_replace(s, rf"^{SPACE}|{SPACE}$", "")), lambda s: s != "")


def long_words(text: Column) -> Column:
    """The lower-case words of over two letters, each once."""
    return F.filter(token_set(text), lambda w: F.length(w) > 2)


def overlap(a: Column, b: Column) -> Column:
    """Shared lower-case words of over two letters, by the larger of the two sets; 0 if either is empty."""
    return set_overlap(long_words(a), long_words(b))


def set_overlap(x: Column, y: Column) -> Column:
    """Shared elements by the larger of the two sets; 0 if either is empty. Sets met by many pairs are best columns of their own."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.when((F.size(x) > 0) & (F.size(y) > 0), F.greatest(F.size(x), F.size(y)))), F.lit(0.0))


def joined(array: Column) -> Column:
    return F.array_join(F.coalesce(array, F.array().cast("array<string>")), " ")


def quality_factor(strength: Column) -> Column:
    return F.greatest(F.lit(0.8), F.least(F.lit(1.08), 0.9 + 0.2 * (strength - 0.5)))


def normal_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def normal_id(name: Column, most: int = 30) -> Column:
    return F.regexp_replace(F.lower(F.substring(name, 1, most)), "[^a-z0-9]", "_")


def abbreviation(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def token_estimate(text: Column) -> Column:
    """A token for each Chinese character, one for four others."""
    t = F.coalesce(text, F.lit(""))
    wide = F.length(F.regexp_replace(t, "[^一-龥]", ""))
    return (wide + F.floor((F.length(t) - wide) / 4)).cast("long")


def output_budget(estimate: Column, context: int = 200_000, least: int = 1500, most: int = 8192) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.lit(context) - estimate)).cast("long")


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """2 * LCS / (len a + len b) of two texts; 1 for two empty ones."""
    return 2.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null for a null text."""
    return pd.Series([None if x is None or y is None else indel(x, y) for x, y in zip(a, b)], dtype="float64")


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """2 * LCS / (len a + len b), in Arrow batches; 1 for two empty texts, null for a null one."""
    return F.pandas_udf(_ratio, DoubleType())(a, b)
