"""Listings: newest first, keyset pages, delimiter rollup. Keys compare as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most keys of a page.
MAX_KEYS = 1000


def newest(objects: DataFrame, prefix: str = "", limit: int = 0) -> DataFrame:
    """Objects under a literal prefix, newest first, ties by ref; limit <= 0: all. The prefix reaches the scan."""
    rows = objects.where(F.col("ref").startswith(prefix)).orderBy(F.desc("created_at"), "ref")
    return rows.limit(limit) if limit > 0 else rows


def encode_cursor(created_at: Column, ref: Column) -> Column:
    """base64url, without padding, of time|ref; the time has a fixed number of digits, so that cursors of a time sort by ref."""
    text = F.concat(F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("|"), ref)
    return F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), "[=\\r\\n]", "")


def decode_cursor(token: Column) -> Column:
    """struct<at, ref>; null where the token isn't a cursor."""
    padded = F.rpad(F.translate(token, "-_", "+/"), (F.ceil(F.length(token) / 4) * 4).cast("int"), F.lit("="))
    text = F.decode(F.unbase64(F.when(token.rlike("^[A-Za-z0-9_-]+$"), padded)), "UTF-8")
    ok = text.rlike(r"^\d{4}-\d\d-\d\dT[0-9:.]+Z\|")
    return F.when(ok, F.struct(F.substring_index(text, "|", 1).alias("at"), F.regexp_extract(text, r"(?s)^[^|]*\|(.*)$", 1).alias("ref")))


def page(objects: DataFrame, prefix: str, after: tuple | None, limit: int) -> DataFrame:
    """limit + 1 objects after the cursor (created_at, ref), newest first: a row too many says that there is more."""
    rows = objects.where(F.col("ref").startswith(prefix))
    if after is not None:
        t, ref = (x if isinstance(x, Column) else F.lit(x) for x in after)
        rows = rows.where((F.col("created_at") < t) | (F.col("created_at") == t) & (F.col("ref") > ref))
    return rows.orderBy(F.desc("created_at"), "ref").limit(limit + 1)


def entries(keys: DataFrame, prefix: str, delimiter: str, after: str = "", most: int = MAX_KEYS) -> DataFrame:
    """entry, is_prefix, keys and size under the prefix, in byte order, after the cursor; `most` (at most 1000) plus one.

    Keys that hold the delimiter after the prefix fold into one entry up to it. The cursor is an entry: keys under a prefix
    that was the last of a page don't bring it back on the next.
    """
    most = max(0, min(most, MAX_KEYS))
    rest = F.substring(F.col("key"), F.lit(len(prefix) + 1), F.length("key"))
    cut = F.locate(delimiter, rest) if delimiter else F.lit(0)
    folded = cut > 0
    entry = F.when(folded, F.substring(F.col("key"), F.lit(1), F.lit(len(prefix)) + cut + F.lit(len(delimiter) - 1))).otherwise(F.col("key"))
    rows = keys.where(F.col("key").startswith(prefix) & (F.col("key") > after))
    if delimiter and after.endswith(delimiter):
        rows = rows.where(~F.col("key").startswith(after))
    rows = rows.select(entry.alias("entry"), folded.alias("is_prefix"), "size")
    return rows.groupBy("entry", "is_prefix").agg(F.count(F.lit(1)).alias("keys"), F.sum("size").alias("size")).orderBy("entry").limit(most + 1)


def list_params(max_keys: str | None, token: str | None, start_after: str | None) -> tuple[int, str]:
    """Keys of a page, 1000 at most and where unset or not a number, and the cursor: a token goes before start_after."""
    n = int(max_keys) if max_keys and max_keys.isdigit() else MAX_KEYS
    return min(n, MAX_KEYS), token or start_after or ""


def stale_pending(objects: DataFrame, cutoff: Column, limit: int = 0) -> DataFrame:
    from chunklake.operators.gc import stale

    return stale(objects, cutoff, limit)


def get(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """The objects of the wanted refs; absent ones have no row."""
    return objects.join(refs.select("ref").distinct(), "ref", "left_semi")
