"""The library's functions by name in Spark SQL. Those written in SQL are inlined into the plans that call them; word_similarity runs
on Arrow batches."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import text as T


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _folded(s: str) -> str:
    source, plain = "".join([*T._ACCENTED, *T.PLAIN_LETTERS]), "".join([*T._BASES, *T.PLAIN_LETTERS.values()])
    out = f"translate(lower({s}), '{source}', '{plain}')"
    for letter, pair in T.LETTER_PAIRS.items():
        out = f"replace({out}, '{letter}', '{pair}')"
    return out


def _pads(secret: str) -> tuple[str, str]:
    """The two keys of HMAC-SHA256, in hex."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def _sequence(s: str) -> str:
    words = rf"filter(split({_folded(s)}, '(?U)[^\\p{{L}}\\p{{N}}]+'), w -> w <> '')"
    return f"flatten(transform({words}, w -> transform(sequence(1, length(w) + 1), i -> substr(concat('  ', w, ' '), i, 3))))"


_ISBN = "upper(regexp_replace(substring_index(s, '(', 1), '[^0-9Xx]', ''))"
_SHARED = f"size(array_intersect({_sequence('a')}, {_sequence('b')}))"
_EVERY = f"size(array_union({_sequence('a')}, {_sequence('b')}))"
#: name: (parameters, type, body). None calls another, so that each is one expression where it is called.
FUNCTIONS = {
    "strip_white": ("s STRING", "STRING", f"trim(BOTH {_quoted(T.WHITE)} FROM s)"),
    "strip_isbd": ("s STRING", "STRING", f"regexp_replace(s, {_quoted(T.ISBD_END)}, '')"),
    "clean_isbn": ("s STRING", "STRING", f"CASE WHEN length({_ISBN}) IN (10, 13) THEN {_ISBN} END"),
    "fold_accents": ("s STRING", "STRING", _folded("s")),
    "trigram_sequence": ("s STRING", "ARRAY<STRING>", _sequence("s")),
    "trigrams": ("s STRING", "ARRAY<STRING>", f"array_distinct({_sequence('s')})"),
    "trigram_similarity": ("a STRING, b STRING", "DOUBLE", f"CASE WHEN {_EVERY} > 0 THEN {_SHARED} / {_EVERY} ELSE 0D END"),
}

_FOLD = str.maketrans(dict(zip(T._ACCENTED, T._BASES, strict=True)) | T.PLAIN_LETTERS | T.LETTER_PAIRS)


@lru_cache(65_536)
def grams(text: str) -> tuple[str, ...]:
    """trigram_sequence() in Python."""
    return tuple(f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower().translate(_FOLD)) for i in range(len(w) + 1))


def register(spark: SparkSession, secret: str | None = None) -> list[str]:
    """Creates the functions in the session and returns their names; with a secret also patron_reference(id), the pseudonym of a
    patron under it."""
    from ..operators.search import word_similarities

    made = dict(FUNCTIONS)
    if secret is not None:
        if not secret:
            raise ValueError("the secret is empty")
        inner, outer = _pads(secret)
        made["patron_reference"] = ("id STRING", "STRING", f"left(sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', encode(id, 'UTF-8')), 256))), 256), 32)")
    for name, (parameters, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")

    @F.arrow_udf("double")
    def word_similarity(queries: pa.Array, targets: pa.Array) -> pa.Array:
        q, t = queries.to_pylist(), targets.to_pylist()
        lists = lambda rows: pa.array(rows, pa.list_(pa.string()))
        found = word_similarities(lists([list(dict.fromkeys(grams(x or ""))) for x in q]), lists([grams(x or "") for x in t]))
        return pa.array([None if x is None or y is None else f for x, y, f in zip(q, t, found.tolist(), strict=True)], pa.float64())

    # it takes the texts, as Spark doesn't find a Python function whose arguments are nested lambdas
    spark.udf.register("word_similarity", word_similarity)
    return [*made, "word_similarity"]
