"""Text views, token sets and pair similarities as columns.

Native expressions wherever Spark has them; Arrow functions for Unicode normal form, transliteration and
matching-block ratios, which it lacks.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("business_name", "business_address", "country")
LABELS = ("Name", "Address", "Country")

_ODD = re.compile(r"[\W_]")
_ODD_RUN = re.compile(r"[\W_]+")
_MAY_MARK = re.compile("[\u0300-\u1fff\u20d0-\U0010ffff]")  # where marks can be
_ASCII = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(128)


def normalize_text(text: str | None) -> str:
    """NFKC, case-folded, letters, digits and marks only, single blanks."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().encode().translate(_ASCII).decode().split())
    folded = unicodedata.normalize("NFKC", text).casefold()
    if not _MAY_MARK.search(folded):
        return _ODD_RUN.sub(" ", folded).strip()
    return " ".join(_ODD.sub(lambda m: m[0] if unicodedata.category(m[0])[0] == "M" else " ", folded).split())


# Romanisation of letters that have no Latin base.
_LETTERS = dict(
    zip(
        "αβγδεζηθικλμνξοπρςστυφχψω"
        "абвгдежзийклмнопрстуфхцчшщъыьэюя"
        "ßæœøđðþłıħŋ",
        ["a", "b", "g", "d", "e", "z", "e", "th", "i", "k", "l", "m", "n", "x", "o", "p", "r", "s", "s", "t", "u", "ph", "kh", "ps", "o"]
        + ["a", "b", "v", "g", "d", "e", "zh", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "shch", "", "y", "", "e", "iu", "ia"]
        + ["ss", "ae", "oe", "o", "d", "d", "th", "l", "i", "h", "ng"],
    )
)
# Devanagari consonants, vowels and vowel signs; other Indic blocks lie at a constant distance.
_CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", "k kh g gh ng c ch j jh ny tt tth dd ddh nn t th d dh n p ph b bh m y r l v sh ss s h ll".split()))
_VOWELS = dict(zip("अआइईउऊऋएऐओऔ", "a aa i ii u uu r e ai o au".split()))
_SIGNS = dict(zip("ािीुूृेैोौंःँ", "aa i ii u uu r e ai o au n h n".split()))
_VIRAMA = "्"
_INDIC_BLOCKS = range(0x0900, 0x0D80, 0x80)
_INDIC, _NOT_ASCII = re.compile("[\u0900-\u0d7f]"), re.compile(r"[^\x00-\x7f]")


@lru_cache(maxsize=1 << 16)
def _latin_char(c: str) -> str:
    upper = c != c.lower() and len(c.lower()) == 1
    low = c.lower() if upper else c
    found = _LETTERS.get(low)
    if found is None:
        found = "".join(_LETTERS.get(b, b) for b in unicodedata.normalize("NFKD", low) if not unicodedata.category(b).startswith("M"))
        if not found.isascii():
            digit = unicodedata.digit(c, None)
            found = str(digit) if digit is not None else "".join(b for b in found if b.isascii())
    return found.capitalize() if upper else found


def transliterate(text: str | None) -> str:
    """ASCII form. Latin loses its accents, Greek, Cyrillic and Indic letters are romanised, the rest goes."""
    if not text or text.isascii():
        return text or ""
    if not _INDIC.search(text):
        return _NOT_ASCII.sub(lambda m: _latin_char(m[0]), text)
    out: list[str] = []
    open_vowel = False  # after an Indic consonant, until a sign or virama says otherwise
    for c in text:
        code = ord(c)
        if _INDIC_BLOCKS.start <= code < _INDIC_BLOCKS.stop:
            base = chr(0x0900 + code % 0x80)
            if base in _CONSONANTS:
                out.append(("a" if open_vowel else "") + _CONSONANTS[base])
                open_vowel = True
                continue
            if base == _VIRAMA:
                open_vowel = False
                continue
            if base in _SIGNS:
                nasal = base in "ंःँ"
                out.append(("a" if nasal and open_vowel else "") + _SIGNS[base])
                open_vowel = False
                continue
            if open_vowel:
                out.append("a")
            open_vowel = False
            out.append(_VOWELS.get(base) or _latin_char(c))
            continue
        if open_vowel:
            out.append("a")
            open_vowel = False
        out.append(_latin_char(c))
    return "".join(out) + ("a" if open_vowel else "")


def _over(function):
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(function)

    return run


normalize = _over(normalize_text)
latin = _over(transliterate)
explorer_normal = _over(lambda t: unicodedata.normalize("NFKC", t or "").casefold().strip())


def serialize(name: str = FIELDS[0], address: str = FIELDS[1], country: str = FIELDS[2]) -> Column:
    """`Name: … | Address: … | Country: …` without empty fields."""
    return F.concat_ws(" | ", *[F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for label, c in zip(LABELS, (name, address, country))])


def with_views(records):
    """raw, normalized and latin views of every record, in one pass over Arrow batches."""

    @F.pandas_udf("normalized string, latin string")
    def both(raw: pd.Series) -> pd.DataFrame:
        normal = raw.map(normalize_text)
        return pd.DataFrame({"normalized": normal, "latin": normal.map(lambda t: t if t.isascii() else normalize_text(transliterate(t)))})

    kept = [c for c in records.columns if c not in ("raw", "normalized", "latin")]
    raw = records.select(*kept, serialize().alias("raw"))
    return raw.withColumn("_views", both("raw")).select(*kept, "raw", "_views.normalized", "_views.latin")


def lexical(normalized: str = "normalized", latin_view: str = "latin") -> Column:
    return F.concat_ws(" ", F.col(normalized), F.col(latin_view))


def char_grams(text: Column, n: int = 3) -> Column:
    """All character n-grams in order, blanks included; none for a shorter text. Time follows the length.

    The characters are bound to a lambda's variable: an expression inside a lambda runs anew for each element.
    """
    none = F.array().cast("array<string>")
    grams = lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))).otherwise(none)
    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), grams), F.lit(0))


def tokens(normalized: Column) -> Column:
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(normalized, " ")))


def numbers(raw: Column) -> Column:
    """Distinct runs of digits of any script."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"(\p{Nd}+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def exact(a: Column, b: Column) -> Column:
    return ((a != "") & (a == b)).cast("double")


def has_non_ascii(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"[^\x00-\x7F]")


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio; 0 if either is empty."""
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@lru_cache(maxsize=1 << 20)
def _signed_bucket(gram: str, dimension: int) -> tuple[int, int]:
    """Bucket and sign of a gram, from the SHA-256 of its JSON form; `dimension` divides 2^16."""
    key = int.from_bytes(hashlib.sha256(json.dumps(gram, ensure_ascii=False).encode("utf-8", "surrogatepass")).digest()[6:8], "big")
    return key % dimension, 1 if key & 256 else -1


def hash_vector(text: str | None, dimension: int = 64) -> np.ndarray:
    """Signed trigram counts of a text by bucket, of unit length. A text shorter than a trigram, even an empty one, is one gram."""
    text = text or ""
    out = np.zeros(dimension)
    for gram, n in Counter(map("".join, zip(text, text[1:], text[2:])) if len(text) > 2 else [text]).items():
        bucket, sign = _signed_bucket(gram, dimension)
        out[bucket] += sign * n
    return (out / max(float(np.sqrt(out @ out)), 1e-9)).astype(np.float32)


def hash_vectors(rows, id_col: str, normalized: str, dimension: int = 64):
    """(id, embedding) of every text. A worker hashes each distinct trigram once, where an exploded plan would hash and shuffle every occurrence."""
    base = rows.select(id_col, normalized)
    schema = T.StructType([base.schema[id_col], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        for batch in batches:
            found = [hash_vector(t, dimension) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return base.mapInArrow(run, schema)
