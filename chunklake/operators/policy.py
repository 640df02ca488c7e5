"""Ordered policies as folds over a key's events: token buckets, quotas, leases, locks; and their predicates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fold(rows: DataFrame, key: str, order: list[str], start, step, name: str, kind: str) -> DataFrame:
    """rows with a column `name` of step(state, row) -> (state, value), in order within a key. Keys are sorted in their partition and streamed: memory doesn't grow with a key."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != now:
                    now, state = row[key], start()
                state, value = step(state, row)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}[kind])], names=[*batch.schema.names, name])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(go, rows.schema.add(name, kind))


def bucket_step(state: tuple[int, int] | None, ms: int, rate_milli: int, burst_milli: int) -> tuple[tuple[int, int], bool]:
    """One request: state (milli-tokens, ms of the last). The first is always let in; time that runs backwards adds nothing."""
    if state is None:
        return (max(burst_milli - 1000, 0), ms), True
    tokens = min(burst_milli, state[0] + max(0, ms - state[1]) * rate_milli // 1000)
    ok = tokens >= 1000
    return (tokens - 1000 if ok else tokens, ms), ok


def token_bucket(requests: DataFrame, rate: float, burst: float, key: str = "bucket_key", order: tuple[str, ...] = ("ms", "event_id")) -> DataFrame:
    """requests (key, ms, ...) with `allowed`. Whole milli-tokens, so that every engine decides alike."""
    r, b = int(rate * 1000), int(burst * 1000)
    return _fold(requests, key, list(order), lambda: None, lambda s, row: bucket_step(s, row["ms"], r, b), "allowed", "boolean")


def quota(events: DataFrame, key: str, order: list[str], delta: str) -> DataFrame:
    """events with `bytes` after each: deletions are clamped at 0 one by one, so the order matters.

    In closed form: with S the running sum, the clamped total is S minus the least of 0 and all S so far; two windows, no fold.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("__s", F.sum(delta).over(w))
    return rows.withColumn("bytes", F.col("__s") - F.least(F.lit(0), F.min("__s").over(w))).drop("__s")


def lease_step(state: tuple[int, str, int] | None, node: str, ms: int, ttl: int) -> tuple[tuple[int, str, int], str]:
    """One attempt: state (generation, node, expiry). An owner refreshes; an expired lease (expiry < now) is stolen and its generation grows."""
    if state is None:
        return (1, node, ms + ttl), "acquired:1"
    generation, owner, expires = state
    if owner == node:
        return (generation, node, ms + ttl), f"refreshed:{generation}"
    if expires < ms:
        return (generation + 1, node, ms + ttl), f"stolen:{generation + 1}"
    return state, f"held:{generation}"


def leases(attempts: DataFrame, ttl: int, key: str = "scope", order: tuple[str, ...] = ("ms", "event_id")) -> DataFrame:
    """attempts (scope, node, ms) with `outcome` and the generation it leaves."""
    return _fold(attempts, key, list(order), lambda: None, lambda s, r: lease_step(s, r["node"], r["ms"], ttl), "outcome", "string")


def over_quota(objects: Column, size: Column, add: Column, most_objects: Column, most_bytes: Column) -> Column:
    """Whether one more object of `add` bytes breaks a bound; 0 is no bound."""
    return ((most_objects > 0) & (objects + 1 > most_objects)) | ((most_bytes > 0) & (size + add > most_bytes))


def revoked(tokens: DataFrame, denied: DataFrame, now: Column) -> DataFrame:
    """tokens with `revoked`: on the list, and the entry not yet expired."""
    live = denied.where(F.col("expires_at") > now).select("jti").distinct().withColumn("__hit", F.lit(True))
    return tokens.join(live, "jti", "left").withColumn("revoked", F.coalesce("__hit", F.lit(False))).drop("__hit")


def pruned(denied: DataFrame, now: Column) -> DataFrame:
    return denied.where(F.col("expires_at") > now)


def fenced(held: DataFrame, stored: DataFrame) -> DataFrame:
    """held (scope, generation) with `valid`: the stored generation is still the one held."""
    now = stored.select("scope", F.col("generation").alias("__g"))
    return held.join(now, "scope", "left").withColumn("valid", F.col("generation").eqNullSafe(F.col("__g"))).drop("__g")


def lock_conflicts(locks: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (inode, owner, exclusive, start, end; ends are inclusive) that a foreign lock blocks: overlapping, and one of the two exclusive."""
    other = locks.select("inode", *[F.col(c).alias(f"__{c}") for c in ("owner", "exclusive", "start", "end")])
    clash = (F.col("owner") != F.col("__owner")) & (F.col("start") <= F.col("__end")) & (F.col("end") >= F.col("__start")) & (F.col("exclusive") | F.col("__exclusive"))
    return asked.join(other, [asked["inode"] == other["inode"], clash], "left_semi")


def flock_conflicts(locks: DataFrame, asked: DataFrame) -> DataFrame:
    """Whole-file locks: any foreign holder blocks unless both share."""
    whole = {"start": F.lit(0), "end": F.lit(0)}
    return lock_conflicts(locks.withColumns(whole), asked.withColumns(whole)).drop("start", "end")


def lock_sessions(*tables: DataFrame) -> DataFrame:
    """Distinct session ids over lock tables."""
    out = tables[0].select("sid")
    for t in tables[1:]:
        out = out.union(t.select("sid"))
    return out.distinct()


def dead_sessions(locks: DataFrame, live: DataFrame) -> DataFrame:
    return locks.select("sid").distinct().join(live.select("sid"), "sid", "left_anti")


def split_locks(records: Column, start: Column, end: Column, kind: Column, pid: Column) -> Column:
    """An owner's records (array<struct<t,s,e,p>>, ends inclusive) after a request over [start, end]: what it covers is cut out, then it is added; kind 2 (unlock) adds nothing."""
    r = "struct<t:int,s:bigint,e:bigint,p:bigint>"
    part = lambda x, s, e: F.struct(x["t"].alias("t"), s.alias("s"), e.alias("e"), x["p"].alias("p")).cast(r)
    cut = lambda x: F.when((x["e"] < start) | (x["s"] > end), F.array(x.cast(r))).otherwise(
        F.filter(F.array(part(x, x["s"], F.least(x["e"], start - 1)), part(x, F.greatest(x["s"], end + 1), x["e"])), lambda y: y["s"] <= y["e"])
    )
    own = F.struct(kind.cast("int").alias("t"), start.cast("bigint").alias("s"), end.cast("bigint").alias("e"), pid.cast("bigint").alias("p")).cast(r)
    kept = F.flatten(F.transform(records, cut))
    return F.array_sort(F.when(kind == 2, kept).otherwise(F.concat(kept, F.array(own))), lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(0))


def may_access(mode: Column, uid: Column, gid: Column, as_uid: Column, as_gids: Column, mask: int) -> Column:
    """Whether the owner's, group's or others' bits of mode hold the mask; uid 0 may all."""
    bits = F.when(as_uid == uid, F.shiftright(mode, 6)).when(F.array_contains(as_gids, gid), F.shiftright(mode, 3)).otherwise(mode)
    return (as_uid == 0) | (bits.bitwiseAND(F.lit(mask)) == mask)


def may_set(owner: Column, as_uid: Column, in_group: Column, sets_mode: Column, sets_uid: Column, sets_gid: Column, only_clears_setid: Column) -> Column:
    """Whether attributes may change: root all; an owner its mode, and its group to one it is in; a bare clearing of set-id bits is open to writers."""
    return (as_uid == 0) | only_clears_setid | (~sets_uid & (as_uid == owner) & (~sets_gid | in_group)) | (~sets_uid & ~sets_gid & ~sets_mode)


def first_denial(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that fails; null if none does. Nulls fail nothing."""
    out = F.lit(None).cast("string")
    for bad, reason in reversed(rules):
        out = F.when(bad, reason).otherwise(out)
    return out


def token_denial(now: Column) -> Column:
    """Reason why a capability (version, audience, nbf, exp, op, wanted_op, size, max_size, revoked) is refused, in the order of its checks; valid while nbf <= now < exp."""
    c = F.col
    return first_denial(
        (c("version") != 1, "version"), (c("nbf") > now, "not_yet"), (c("exp") <= now, "expired"), (c("audience") != c("wanted_audience"), "audience"),
        (c("op") != c("wanted_op"), "op"), (c("revoked"), "revoked"), ((c("max_size") > 0) & (c("size") > c("max_size")), "too_large"),
    )


def minted_ttl(asked: Column, most: Column, default: int) -> Column:
    """The life of a new token: what was asked for, the default where that is 0 or less, never more than the binding's."""
    return F.least(F.when(asked > 0, asked).otherwise(F.lit(default)), most)
