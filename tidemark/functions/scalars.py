"""Hashing, text and time functions as Column expressions."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKETCH = 128
#: Title separators, and keys whose values never reach a log.
SEPARATORS = r"[|\-:/•]"
SENSITIVE_KEYS = ("raw_keystrokes", "raw_keys", "window_title_raw", "window_title", "clipboard_content", "typed_text", "im_content", "full_url")


def stable_hash(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def salted_hash(text: Column, salt: str) -> Column:
    return stable_hash(F.concat(F.lit(salt), text))


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """Hexadecimal HMAC; the padded keys are constants of the plan."""
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    inner, outer = (bytes(x ^ pad for x in key) for pad in (0x36, 0x5C))
    raw = lambda x: F.unhex(F.lit(x.hex()))
    digest = F.unhex(F.sha2(F.concat(raw(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(raw(outer), digest), 256)


def keyed_digest(payload: Column, secret: bytes, namespace: str) -> Column:
    return hmac_sha256(F.concat(F.lit(f"{namespace}:"), payload), secret)


def hash_bucket(value: Column, buckets: int = 256) -> Column:
    """Hexadecimal strings modulo ``buckets`` (up to 2^31); others by the first eight bytes of their SHA-256.

    Digits are taken in groups of seven from the left, the remainder so far being carried along,
    so numbers of any length are exact.
    """
    is_hex = F.regexp_like(value, F.lit("^[0-9a-fA-F]+$"))
    digits = F.when(is_hex, value).otherwise(F.substring(F.sha2(value, 256), 1, 16))
    groups = F.array_remove(F.split(F.regexp_replace(digits, "(.{7})", "$1 "), " "), "")
    step = lambda rest, g: (rest * F.pow(F.lit(16.0), F.length(g)).cast("long") + F.conv(g, 16, 10).cast("long")) % buckets
    # up to 15 digits fit in a long
    short = is_hex & (F.length(value) <= 15)
    return F.when(short, F.conv(value, 16, 10).cast("long") % buckets).otherwise(F.aggregate(groups, F.lit(0).cast("long"), step)).cast("int")


@F.pandas_udf(T.StringType())
def _nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.str.normalize("NFKC")


def normalize_title(title: Column) -> Column:
    """NFKC, white space collapsed and trimmed; plain ASCII needs no Python."""
    plain = F.regexp_like(title, F.lit(r"^\p{ASCII}*$"))
    composed = F.when(plain, title).otherwise(_nfkc(F.when(plain, F.lit(None)).otherwise(title)))
    return F.trim(F.regexp_replace(composed, r"(?U)\s+", " "))


def title_tokens(title: Column, most: int = 32) -> Column:
    """Lower case, digit runs as ``num``, split on non-alphanumerics, no single characters."""
    text = F.regexp_replace(F.lower(title), r"(?U)\d+", "<num>")
    return F.slice(F.filter(F.split(text, "[^0-9A-Za-z]+"), lambda t: F.length(t) > 1), 1, most)


def char_ngrams(title: Column, n: int = 3, most: int = 256) -> Column:
    """All n-grams of the first ``most`` characters, lower case, digit runs as ``0``."""
    text = F.substring(F.regexp_replace(F.lower(title), r"(?U)\d+", "0"), 1, most)
    # a one-element array carries the text into the lambda, so that it is computed once
    grams = F.transform(F.array(text), lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n))))
    return F.filter(F.get(grams, F.lit(0)), lambda g: F.length(g) == n)


def keyed_buckets(tokens: Column, secret: bytes, namespace: str, size: int = SKETCH) -> Column:
    """Keyed hash bucket of each token."""
    return F.transform(tokens, lambda t: F.pmod(F.conv(F.substring(keyed_digest(t, secret, namespace), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(size)).cast("int"))


def with_bucket_frequencies(df: DataFrame, columns: dict[str, str], size: int = SKETCH) -> DataFrame:
    """For each (new column, column of buckets): shares of the ``size`` buckets, rounded to six places; zeros without any.

    The columns of buckets go. Counted by numpy over Arrow batches: as an expression, each row
    would be read ``size`` times.
    """
    return _with_shares(df, {new: (old, None) for new, old in columns.items()}, size)


def with_token_sketches(df: DataFrame, columns: dict[str, tuple[str, str]], secret: bytes, size: int = SKETCH) -> DataFrame:
    """For each (new column, (column of tokens, namespace)): ``keyed_buckets`` of the tokens and shares of these buckets.

    The columns of tokens go. Each Arrow batch digests a token once, however often its rows hold it.
    """

    def buckets_of(namespace: str):
        prefix = f"{namespace}:".encode()

        def buckets(tokens: pa.Array) -> np.ndarray:
            coded = tokens.dictionary_encode()
            digests = (hmac.digest(secret, prefix + token.encode(), "sha256") for token in coded.dictionary.to_pylist())
            own = np.fromiter((int.from_bytes(d[:8], "big") % size for d in digests), np.int64, len(coded.dictionary))
            return own[coded.indices.to_numpy()]

        return buckets

    return _with_shares(df, {new: (old, buckets_of(namespace)) for new, (old, namespace) in columns.items()}, size)


def _with_shares(df: DataFrame, columns: dict, size: int) -> DataFrame:
    """For each (new column, (array column, buckets of its elements; None: they are buckets)): shares; the array columns go."""
    old = {c for c, _ in columns.values()}
    names = [c for c in df.columns if c not in old and c not in columns]
    schema = T.StructType([*[df.schema[c] for c in names], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in columns]])

    def shares(column: pa.Array, buckets) -> pa.Array:
        sizes = np.diff(column.offsets.to_numpy())
        rows = np.repeat(np.arange(len(column)), sizes)
        flat = column.flatten()
        counts = np.bincount(rows * size + (buckets(flat) if buckets else flat.to_numpy()), minlength=len(column) * size)
        values = np.floor(counts / np.repeat(np.maximum(sizes, 1), size) * 1e6 + 0.5) / 1e6
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * size), pa.array(values))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[shares(batch.column(c), buckets) for c, buckets in columns.values()]], schema.names)

    return df.mapInArrow(count, schema)


def title_scalars(title: Column) -> dict[str, Column]:
    tokens = title_tokens(title)
    chars = F.char_length(title)
    return {
        "title_char_count": chars.cast("int"),
        "title_token_count": F.size(tokens),
        "title_unique_token_ratio": F.when(F.size(tokens) > 0, F.round(F.size(F.array_distinct(tokens)) / F.size(tokens), 4)).otherwise(0.0),
        "title_digit_ratio": F.when(chars > 0, F.round(F.regexp_count(title, F.lit(r"(?U)\d")) / chars, 4)).otherwise(0.0),
        "title_separator_count": F.regexp_count(title, F.lit(SEPARATORS)),
    }


def title_sketch(df: DataFrame, title: str, secret: bytes) -> DataFrame:
    """Token and character sketches as arrays, and the five scalars."""
    clean = df.withColumn("_title", normalize_title(F.coalesce(F.col(title), F.lit(""))))
    split = clean.withColumns({"_tokens": title_tokens(F.col("_title")), "_grams": char_ngrams(F.col("_title"))})
    counted = split.withColumns(title_scalars(F.col("_title"))).drop("_title")
    return with_token_sketches(counted, {"title_token_sketch": ("_tokens", "title-token"), "title_char3_sketch": ("_grams", "title-char3")}, secret)


def units(column: Column, digits: int) -> Column:
    """A number as whole units of its ``digits``-th decimal."""
    return F.round(column * 10**digits).cast("long")


def quotient(numerator: Column, denominator: Column, digits: int, unit: int = 0) -> Column:
    """``numerator / denominator`` of whole numbers to ``digits`` decimals, half away from zero, in whole numbers.

    The numerator counts units of the ``unit``-th decimal. Sums and quotients of doubles may fall on either side of a tie; these do not.
    """
    scaled = F.abs(numerator) * 10 ** (digits - unit) if digits >= unit else F.abs(numerator)
    by = denominator if digits >= unit else denominator * 10 ** (unit - digits)
    return F.sign(numerator).cast("long") * F.call_function("div", 2 * scaled + by, 2 * by) / 10**digits


def align(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def bucket_range(df: DataFrame, start: str, end: str, seconds: int, to: str = "bucket") -> DataFrame:
    """A row for each bucket start in [start, end)."""
    first, last = align(F.col(start), seconds), F.timestamp_seconds(F.unix_seconds(F.col(end)) - 1)
    steps = F.sequence(first, F.greatest(first, last), F.make_dt_interval(secs=F.lit(seconds)))
    return df.where(F.col(end) > F.col(start)).withColumn(to, F.explode(steps))


def calendar(bucket: Column, zone: str | None = None) -> dict[str, Column]:
    local = F.from_utc_timestamp(bucket, zone) if zone else bucket
    return {"hour_of_day": F.hour(local), "day_of_week": F.weekday(local)}


def parse_instant(text: Column) -> Column:
    """ISO 8601 with or without zone; none is UTC; unreadable is null."""
    return F.try_to_timestamp(text)


def redact(message: Column) -> Column:
    keys = "|".join(SENSITIVE_KEYS)
    return F.regexp_replace(message, rf"(?i)({keys})\s*[=:]\s*(\"[^\"]*\"|'[^']*'|\S+)", "$1=[REDACTED]")


def entropy(probs: Column, least: float = 1e-8) -> Column:
    """Shannon entropy in nats of probabilities clipped to [least, 1]."""
    clipped = F.transform(probs, lambda p: F.least(F.greatest(p, F.lit(least)), F.lit(1.0)))
    return -F.aggregate(clipped, F.lit(0.0), lambda total, p: total + p * F.ln(p))
