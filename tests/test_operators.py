"""Hand-written cases of the operators: expected rows, invariants, and the places where semantics surprise."""

import datetime as dt
import random
import struct

import pytest
from pyspark.sql import functions as F

from chunklake.functions import binary as B
from chunklake.functions import expr as X
from chunklake.operators import chunks, compact, gc, listing, mutations, overlay, packing, policy, tree, usage, versions
from chunklake.sources import tables
from tests.conftest import rows

SLICE = "inode bigint, id bigint, slice_id bigint, pos bigint, slen bigint, soff bigint"

def overlay_brute(slices, lo, hi):
    """Byte by byte: the newest slice over each, and where it is in the slice."""
    held = [(0, 0)] * (hi - lo)
    for number, _, pos, n, soff in sorted(slices, key=lambda x: x[1]):
        for at in range(max(pos, lo), min(pos + n, hi)):
            held[at - lo] = (number, soff + at - pos)
    out = []
    for at, (number, src) in enumerate(held, lo):
        last = out[-1] if out else None
        if last and last[2] == number and (number == 0 or last[3] + at - last[0] == src):
            last[1] = at + 1
        else:
            out.append([at, at + 1, number, src])
    return [tuple(x) for x in out]


def test_overlays_byte_by_byte(spark):
    rnd = random.Random(12)
    files = {1: [(7, 1, 3, 4, 2)], 2: [(5, 1, 0, 50, 0)], 3: [(5, 1, 90, 30, 1), (6, 2, 2, 1, 0)]}
    for inode in range(4, 40):
        files[inode] = [(rnd.randint(1, 4), k, rnd.randint(0, 60), rnd.randint(1, 30), rnd.randint(0, 9)) for k in range(1, rnd.randint(2, 9))]
    df = spark.createDataFrame([(i, k, n, pos, size, soff) for i, rows in files.items() for n, k, pos, size, soff in rows], SLICE)
    for lo, hi in ((0, 100), (17, 43)):
        got = {}
        for r in overlay.segments(df, lo, hi).collect():
            got.setdefault(r["inode"], []).append((r["start"], r["end"], r["slice_id"], r["src_off"]))
        assert {i: sorted(x) for i, x in got.items()} == {i: overlay_brute(rows, lo, hi) for i, rows in files.items()}


def test_clone_range_keeps_what_strict_reference_loses(spark):
    df = spark.createDataFrame([(1, 0, 10, 1, 0, 5, 0)], "inode bigint, indx bigint, slice_id bigint, id bigint, pos bigint, slen bigint, soff bigint")
    assert overlay.clone_range(df, 1, 1, 0, 5, 1).count() == 2
    assert overlay.clone_range(df, 1, 1, 0, 5, 1, strict_reference=True).count() == 1


def test_human_bytes_round_ties_to_even(spark):
    """As %.1f of C and Go does, with the number as a double; Java's rounds 1.25 up."""
    rng = random.Random(3)
    sizes = [-5, 0, 1023, 1024, 1280, 1792, 1310720, (1 << 60) + 1, (1 << 63) - 1, *(1280 << (10 * i) for i in range(5)), *(rng.randrange(1 << rng.randrange(1, 63)) for _ in range(500))]
    whole = lambda n, i: f"{float(n) / (1 << (10 * i)):.1f} {'KMGTPE'[i - 1]}iB" if i else f"{n} B"
    want = {n: whole(n, max(0, (n.bit_length() - 1) // 10) if n > 0 else 0) for n in sizes} | {None: None}
    got = spark.createDataFrame([(n,) for n in want], "n long").select("n", X.human_bytes(F.col("n"))).collect()
    assert {r[0]: r[1] for r in got} == want and want[1310720] == "1.2 MiB"


def test_windows_and_whole_chunks(spark):
    df = spark.createDataFrame([("a", 0, 10), ("b", 10, 25), ("c", 35, 0)], "ref string, offset bigint, size bigint")
    got = overlay.file_windows(df, 16).select("ref", "window_no", "lo", "hi")
    assert sorted(map(tuple, got.collect())) == [("a", 0, 0, 10), ("b", 0, 10, 16), ("b", 1, 0, 16), ("b", 2, 0, 3)]
    assert [r["ref"] for r in overlay.whole_chunks(df, 5, 35).collect()] == ["b"]


def test_greedy_packs_drop_the_overshoot(spark):
    df = spark.createDataFrame([("d", i, s) for i, s in enumerate([3, 3, 3, 9, 1, 1])], "g string, i int, s bigint")
    got = [r["pack_no"] for r in packing.greedy(df, "g", ["i"], "s", 5).orderBy("i").collect()]
    assert got == [0, 0, 1, 1, 2, 2]


def test_budget_admits_the_first_and_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("d", 1, 9), ("d", 2, 1), ("e", 1, 2), ("e", 2, 4), ("e", 3, 1)], "domain string, pack_no int, live bigint")
    assert sorted((r[0], r[1]) for r in packing.budget(df, ["pack_no"], "live", 5, ["domain"]).collect()) == [("d", 1), ("e", 1)]


def test_subtract(spark):
    a = spark.createDataFrame([(1, 0, 10), (2, 0, 5)], "k int, start bigint, end bigint")
    b = spark.createDataFrame([(1, 2, 4), (1, 3, 6), (1, 9, 20)], "k int, start bigint, end bigint")
    assert sorted(map(tuple, packing.subtract(a, b, ["k"]).collect())) == [(1, 0, 2), (1, 6, 9), (2, 0, 5)]


def test_versions_compare_as_strings(spark):
    df = spark.createDataFrame([("k", "2024-01-01T00:00:00.1Z"), ("k", "2024-01-01T00:00:00.12Z")], "owner_key string, version string")
    assert versions.latest(df, ["owner_key"]).first()["version"].endswith(".1Z")
    fixed = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00.1' a, timestamp_ntz'2024-01-01 00:00:00.12' b").select(X.version_string(F.col("a"), F.lit(1)) < X.version_string(F.col("b"), F.lit(1))).first()[0]
    assert fixed


def test_prune_keep_none_is_no_op(spark):
    df = spark.createDataFrame([("k", "1"), ("k", "2")], "owner_key string, version string")
    assert versions.prune_keep(df, ["owner_key"], 0).count() == 0
    assert [r["version"] for r in versions.prune_keep(df, ["owner_key"], 1).collect()] == ["1"]


def test_manifest_assembly_refuses_bad_rows(spark):
    df = spark.createDataFrame([("a", 1, "h2", "p", 5, 7), ("a", 0, "h1", "p", 0, 5), ("b", 0, "h", "", 0, 5)], "owner_key string, seq int, chunk_hash string, pack_hash string, offset int, size int")
    got = versions.assemble(df, ["owner_key"]).collect()
    assert [(r["owner_key"], r["total_size"], [c["h"] for c in r["chunks"]]) for r in got] == [("a", 12, ["h1", "h2"])]


def test_gc_refuses_a_corrupt_manifest(spark):
    good = bytearray(b'{"format":"v2","total_size":5,"tenant":"t","chunks":[{"h":"h1","p":"p1","o":0,"s":5},{"h":"h2","o":0,"s":5}]}')
    schema = "domain string, payload binary"
    live = gc.live_blobs(tables.manifest_payloads(spark.createDataFrame([("d", good)], schema)))
    assert sorted(r["blob_hash"] for r in live.collect()) == ["h2", "p1"]
    with pytest.raises(gc.CorruptManifest):
        gc.live_blobs(tables.manifest_payloads(spark.createDataFrame([("d", good), ("d", bytearray(b"bad"))], schema)))


def test_orphans_are_deferred_inside_the_window(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    stored = spark.createDataFrame([("d", 1, 5, t(0)), ("d", 2, 5, t(50)), ("d", 3, 5, t(0))], "domain string, pack_no int, size bigint, created_at timestamp_ntz")
    live = spark.createDataFrame([("d", 3)], "domain string, pack_no int")
    now = F.lit(dt.datetime(2024, 1, 1, 0, 1, 0)).cast("timestamp_ntz")
    plan = lambda w: sorted((r["pack_no"], r["decision"]) for r in gc.orphans(stored, live, ["domain", "pack_no"], now, w).collect())
    assert plan(30) == [(1, "reclaim"), (2, "deferred")]
    assert plan(60) == [(1, "reclaim"), (2, "deferred")]  # an age equal to the window is old enough
    assert plan(0) == [(1, "reclaim"), (2, "reclaim")]


def test_compaction_must_pay(spark):
    filled = spark.createDataFrame([("d", 1, 10, 10, 5, 500), ("d", 2, 10, 10, 5, 500), ("e", 1, 10, 10, 5, 500)], "domain string, pack_no int, size bigint, stored bigint, live bigint, fill_stored bigint")
    assert sorted((r["domain"], r["pack_no"]) for r in compact.candidates(filled, 900, 0, 1000, 100).collect()) == [("d", 1), ("d", 2)]
    assert compact.candidates(filled, 900, 0, 1000, 5).count() == 0
    assert compact.candidates(filled, 0, 0, 1000, 100).count() == 0


def test_delimiter_pages_don_t_repeat_a_prefix(spark):
    df = spark.createDataFrame([(k, 1) for k in ("root.txt", "a/1.txt", "a/2.txt", "b/c/deep.txt", "b/d.txt")], "key string, size bigint")
    names = lambda after, most: [r["entry"] for r in listing.entries(df, "", "/", after, most).collect()]
    assert names("", 1000) == ["a/", "b/", "root.txt"]
    assert names("", 1)[:1] == ["a/"]
    assert names("a/", 1)[:1] == ["b/"]
    assert names("b/", 1000) == ["root.txt"]


def test_list_parameters():
    assert listing.list_params(None, None, "k") == (1000, "k")
    assert listing.list_params("5000", "t", "k") == (1000, "t")
    assert listing.list_params("7", None, None) == (7, "")


def test_cursor_of_garbage_is_null(spark):
    df = spark.createDataFrame([("!!",), ("AAAA",), (None,)], "t string")
    assert [r[0] for r in df.select(listing.decode_cursor(F.col("t"))).collect()] == [None, None, None]


def test_quota_clamps_every_event(spark):
    df = spark.createDataFrame([("t", i, d) for i, d in enumerate([5, -9, 4, -1, -10, 2])], "k string, i int, d bigint")
    assert [r["bytes"] for r in policy.quota(df, "k", ["i"], "d").orderBy("i").collect()] == [5, 0, 4, 3, 0, 2]


def test_token_bucket_lets_the_first_in():
    state, ok = policy.bucket_step(None, 0, 0, 500)
    assert ok and state == (0, 0)
    assert not policy.bucket_step(state, 10, 1000, 500)[1]
    assert policy.bucket_step((0, 100), 50, 1000, 5000) == ((0, 50), False)


def test_leases():
    s, o = policy.lease_step(None, "a", 0, 10)
    assert o == "acquired:1"
    assert policy.lease_step(s, "b", 10, 10)[1] == "held:1"  # expiry equal to now isn't expired
    assert policy.lease_step(s, "b", 11, 10) == ((2, "b", 21), "stolen:2")
    assert policy.lease_step(s, "a", 50, 10) == ((1, "a", 60), "refreshed:1")


def test_fences_and_revocations(spark):
    held = spark.createDataFrame([("s", 1), ("t", 2)], "scope string, generation int")
    stored = spark.createDataFrame([("s", 2), ("t", 2)], "scope string, generation int")
    assert {r["scope"]: r["valid"] for r in policy.fenced(held, stored).collect()} == {"s": False, "t": True}
    denied = spark.createDataFrame([("j", 10)], "jti string, expires_at int")
    assert [policy.pruned(denied, F.lit(n)).count() for n in (9, 10)] == [1, 0]


def test_append_log_numbers_on(spark):
    log = spark.createDataFrame([(7, "a")], "lsn bigint, op string")
    new = spark.createDataFrame([("c",), ("b",), ("d",)], "op string")
    assert sorted((r["lsn"], r["op"]) for r in mutations.append_log(log, new, ["op"]).collect()) == [(7, "a"), (8, "b"), (9, "c"), (10, "d")]


def test_associate_is_all_or_nothing(spark):
    k = "domain string, pack_hash string, context string"
    packs = spark.createDataFrame([("d", "p", "stored"), ("d", "q", "obliterating")], "domain string, pack_hash string, state string")
    none = spark.createDataFrame([], k)
    assert mutations.associate(none, packs, spark.createDataFrame([("d", "p", "c"), ("d", "new", "c")], k)).count() == 2
    with pytest.raises(mutations.NotStored):
        mutations.associate(none, packs, spark.createDataFrame([("d", "p", "c"), ("d", "q", "c")], k))


def test_rename_over_and_unlink(spark):
    edges = spark.createDataFrame([(1, "a", 10), (1, "b", 11)], "parent bigint, name string, inode bigint")
    moved = mutations.rename(edges, spark.createDataFrame([(1, "a", 1, "b")], "parent bigint, name string, to_parent bigint, to_name string"))
    assert [tuple(r) for r in moved.collect()] == [(1, "b", 10)]
    nodes = spark.createDataFrame([(10, "file", 1), (11, "file", 2)], "inode bigint, type string, nlink int")
    data = spark.createDataFrame([(10, "x"), (11, "y")], "inode bigint, v string")
    left, alive, (rest,) = mutations.unlink(edges, nodes, edges.select("parent", "name"), [data])
    assert left.count() == 0 and [tuple(r) for r in alive.collect()] == [(11, "file", 1)] and [r["v"] for r in rest.collect()] == ["y"]
    e2, n2 = mutations.link(edges, nodes, spark.createDataFrame([(2, "c", 10), (1, "a", 10)], "parent bigint, name string, inode bigint"))
    assert e2.count() == 3 and {r["inode"]: r["nlink"] for r in n2.collect()} == {10: 2, 11: 2}
    e3, n3 = mutations.create(edges, nodes, spark.createDataFrame([(10, "sub", 12, "dir"), (1, "a", 13, "file")], "parent bigint, name string, inode bigint, type string"))
    assert e3.count() == 3 and {r["inode"]: r["nlink"] for r in n3.collect()} == {10: 2, 11: 2, 12: 2}


def test_upsert_replaces_named_columns_only(spark):
    s = spark.createDataFrame([("p", 1, "x"), ("q", 2, "y")], "k string, a int, b string")
    b = spark.createDataFrame([("p", 9, "z"), ("r", 3, "w")], "k string, a int, b string")
    assert sorted(map(tuple, mutations.upsert(s, b, ["k"], ["a"]).collect())) == [("p", 9, "x"), ("q", 2, "y"), ("r", 3, "w")]


def test_attributes_by_mask(spark):
    nodes = spark.createDataFrame([(1, 10, 20)], "inode int, mode int, uid int")
    got = mutations.set_attributes(nodes, spark.createDataFrame([(1, 2, 11, 21)], "inode int, mask int, mode int, uid int"), {"mode": 1, "uid": 2})
    assert tuple(got.first()) == (1, 10, 21)


def test_trims(spark):
    log = spark.range(10).select(F.col("id").alias("lsn"))
    assert mutations.keep_last(log, 3).count() == 3 and mutations.keep_last(log, 0).count() == 0
    assert mutations.trim(log, 0).count() == 10 and mutations.trim(log, 4).count() == 5


def test_empty_prefix_is_refused(spark):
    with pytest.raises(ValueError):
        mutations.delete_prefix(spark.range(1).select(F.lit("a").alias("ref")), "")


def test_tree_of_lost_directories(spark):
    nodes = spark.createDataFrame([(1, "dir", "", 0), (2, "dir", "a", 1), (3, "file", "b", 2), (5, "file", "x", 4)], "inode bigint, type string, name string, parent bigint")
    assert {r["inode"]: r["path"] for r in tree.paths(nodes).collect()} == {1: "", 2: "/a", 3: "/a/b"}
    assert [r["inode"] for r in tree.unreachable(nodes).collect()] == [5]
    assert tree.resolve(nodes, spark.createDataFrame([("//a//b",), ("/none",), ("/",)], "path string")).count() == 2


def test_rates_without_time(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t, 1), ("a", t, 4), ("a", t + dt.timedelta(seconds=10), 24)], "k string, at timestamp_ntz, c int")
    assert sorted(r["c_rate"] for r in usage.rates(df, ["k"], "at", ["c"]).collect() if r["c_rate"] is not None) == [2.0, 3.0]


def test_names_and_escapes(spark):
    names = ["", "plain", "a/b", "ü:x", "abcd", "a?b*c"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("s", X.sanitized(F.col("n"))).withColumn("back", X.unsanitized(F.col("s")))
    got = df.collect()
    assert [r["back"] for r in got] == names
    assert got[0]["s"] == "_" and all("/" not in r["s"] and ":" not in r["s"] for r in got)
    assert spark.range(1).select(X.uri_encode(F.lit("a b*~/ü"))).first()[0] == "a%20b%2A~%2F%C3%BC"


def test_log_decoding_stops_at_a_torn_frame(spark):
    data = [(i, 1, 5, 0, 7, 100 + i, 10, 0, 10) for i in range(4)]
    blob = B.encode_log(data)
    assert B.decode_log(blob) == data
    assert B.decode_log(blob[:-3]) == data[:-1]
    assert B.decode_log(blob[:20] + b"\xff" + blob[21:]) == []
    df = spark.createDataFrame([("s1", bytearray(blob)), ("s2", bytearray(b"")), ("s3", None)], "path string, content binary")
    assert B.log_records(df).count() == 4


def test_pack_index_and_access_lists(spark):
    entries = [(0, 10, 0, 5, 1), (10, 20, 5, 9, 0)]
    df = spark.createDataFrame([(bytearray(B.encode_pack_index(entries)),), (bytearray(b"xx"),), (None,)], "b binary")
    got = [r[0] for r in df.select(B.pack_index(F.col("b"))).collect()]
    assert [tuple(e) for e in got[0]] == entries and got[1] is None and got[2] is None
    span = df.limit(1).withColumn("e", B.pack_index(F.col("b"))).select(X.stored_span(F.col("e"), F.lit(5), F.lit(12)).alias("s")).first()["s"]
    assert tuple(span) == (0, 14)
    acl = [(1, 7, 0xFFFFFFFF), (4, 7, 0xFFFFFFFF), (16, 7, 0xFFFFFFFF), (32, 7, 0xFFFFFFFF)]
    df = spark.createDataFrame([(bytearray(B.encode_access_list(acl)),)], "b binary")
    got = df.withColumn("l", B.access_list(F.col("b"))).select(B.masked_access(F.col("l"), F.lit(0o640)).alias("a")).first()["a"]
    assert [e["perm"] for e in got] == [6, 7, 4, 0]


def test_packs_without_a_frame_are_raw():
    assert B.unframed(b"plain") == b"plain"
    assert B.framed(b"", 1)[4] == 0 and B.unframed(B.framed(b"", 2)) == b""
    assert B.unframed(bytes([0x43, 0x50, 0x4B, 1, 9])) is None


def test_file_hash_reads_holes_as_zeros(spark):
    import hashlib

    df = spark.createDataFrame([(1, 4, 6, bytearray(b"zz")), (1, 0, 2, bytearray(b"ab")), (2, 0, 3, None)], "inode bigint, start bigint, end bigint, data binary")
    got = {r["inode"]: r["sha256"] for r in B.file_hashes(df).collect()}
    assert got == {1: hashlib.sha256(b"ab\0\0zz").hexdigest(), 2: hashlib.sha256(bytes(3)).hexdigest()}


def test_signature_chain(spark):
    sign = B.signature_of("secret", "20240101", "us-east-1", "s3")
    a, b = (r[0] for r in spark.createDataFrame([("text",), ("text2",)], "t string").select(sign(F.col("t"))).collect())
    assert len(a) == 64 and a != b


def test_content_chunks_survive_an_insertion():
    import random

    data = random.Random(1).randbytes(60_000)
    cut = lambda d: {d[o : o + n] for o, n in B.cut_points(d)}
    a, b = cut(data), cut(data[:5000] + b"inserted" + data[5000:])
    assert len(a & b) >= 0.8 * len(a)
    assert b"".join(data[o : o + n] for o, n in B.cut_points(data)) == data


def test_metrics_text(spark):
    lines = ["# HELP x", 'hits{a="1"} 3', 'hits{a="2"} 4', "miss 1.5", "bad line here"]
    got = tables.metric_samples(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r["name"]: r["total"] for r in got.collect()} == {"hits": 7.0, "miss": 1.5}


def test_blob_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("pack-a-1", "pack-a-2", ".tmp"):
        (tmp_path / "d" / n).write_bytes(b"12345")
    got = tables.blob_listing(spark, str(tmp_path), "pack-")
    assert sorted((r["blob_id"], r["length"]) for r in got.collect()) == [("pack-a-1", 5), ("pack-a-2", 5)]
    use = tables.folder_usage(spark, str(tmp_path)).first()
    assert use["files"] in (2, 3) and use["oldest"] is not None


def test_manifest_folder(spark, tmp_path):
    at = tmp_path / "root" / "t" / "w" / "u" / "o" / "v1"
    at.mkdir(parents=True)
    (at / "metadata.json").write_text('{"size": 5}')
    (tmp_path / "root" / "metadata.json").write_text('{"size": 6}')
    got = tables.manifest_folder(spark, str(tmp_path / "root"), "size bigint").collect()
    assert [(r["tenant"], r["owner_key"], r["version"], r["size"]) for r in got] == [("t", "o", "v1", 5)]


def test_registered_chunks_are_checked(spark):
    s = "domain string, chunk_hash string, pack_hash string, offset int, size int"
    index = spark.createDataFrame([("d", "h", "p", 0, 5), ("d", "g", "p", 5, 5)], s)
    wanted = spark.createDataFrame([("d", "h", "p", 0, 5), ("d", "g", "p", 0, 5), ("d", "x", "p", 0, 5)], s)
    assert {r["chunk_hash"]: r["status"] for r in chunks.check_registered(wanted, index).collect()} == {"h": "ok", "g": "mismatch", "x": "absent"}


def test_exchange_swaps_both(spark):
    edges = spark.createDataFrame([(1, "a", 10), (1, "b", 11), (1, "c", 12)], "parent bigint, name string, inode bigint")
    pairs = spark.createDataFrame([(1, "a", 1, "b"), (1, "c", 1, "none")], "parent bigint, name string, to_parent bigint, to_name string")
    assert {r["name"]: r["inode"] for r in mutations.exchange(edges, pairs).collect()} == {"a": 11, "b": 10, "c": 12}


def test_plans_push_down_and_don_t_cross(spark, capsys):
    """Filters and columns reach the scan, and no query compares all rows with all rows."""
    from chunklake.plans import registry
    from tests.conftest import SF

    df = listing.newest(tables.table(spark, SF, "pages").select(F.col("url").alias("ref"), F.lit(1).alias("created_at")), "http://m.")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "StringStartsWith(url,http://m.)" in plan and "ReadSchema: struct<url:string>" in plan
    for name in ("overlay_segments", "orphan_packs", "dedup_probe_fixed", "lock_conflicts", "interval_merge"):
        registry.queries()[name](spark, SF).explain("formatted")
        plan = capsys.readouterr().out
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def tree_rows(spark, data):
    return spark.createDataFrame(data, "inode bigint, parent bigint, name string, nlink int")


def test_deep_trees_circles_and_lost_parents(spark):
    """A chain of 300, a circle, an inode that is its own parent, and one whose ancestor is gone."""
    chain = [(1, 0, "", 2)] + [(10 + i, 9 + i if i else 1, f"n{i}", 1) for i in range(300)]
    nodes = tree_rows(spark, [*chain, (500, 501, "x", 1), (501, 500, "y", 1), (600, 600, "own", 1), (601, 600, "c", 1), (701, 700, "z", 1), (702, 701, "w", 1)])
    paths = {r["inode"]: r["path"] for r in tree.paths(nodes).collect()}
    assert paths == {1: "", **{10 + i: "".join(f"/n{k}" for k in range(i + 1)) for i in range(300)}}
    scopes = {r["inode"]: r["scope"] for r in tree.scopes(nodes).collect()}
    assert scopes == {1: "root", **{10 + i: "ino:10" for i in range(300)}, 500: "ino:500", 501: "ino:501", 600: "ino:600", 601: "ino:600", 701: "ino:701", 702: "ino:702"}
    assert tree.paths(nodes.where("false")).count() == 0 and tree.scopes(nodes.where("false")).count() == 0


def test_trees_wider_than_a_recursion(spark):
    nodes = spark.range(2, 1_200_002).selectExpr("id as inode", "case when id < 1000 then 1 else id % 998 + 2 end as parent", "'a' as name").union(spark.sql("select 1L, 0L, ''"))
    assert tree.paths(nodes).where("length(path) > 0").count() == 1_200_000
    assert tree.scopes(nodes).selectExpr("count(distinct scope)").first()[0] == 999


def test_zombies_have_no_entry(spark):
    nodes = tree_rows(spark, [(1, 0, "", 0), (2, 1, "a", 0), (3, 1, "b", 0), (4, 1, "c", 1), (5, 1, "d", -1)])
    edges = spark.createDataFrame([(1, "a", 2), (1, "c", 4)], "parent bigint, name string, inode bigint")
    assert sorted(r["inode"] for r in gc.zombies(nodes, edges).collect()) == [3, 5]


def test_rename_rules(spark):
    edges = spark.createDataFrame([(1, "d1", 2), (1, "d2", 3), (1, "d3", 4), (4, "kid", 5), (1, "f1", 6), (1, "f2", 7), (2, "f3", 8), (1, "hard", 8), (1, "g", 9), (1, "d4", 10)], "parent bigint, name string, inode bigint")
    nodes = spark.createDataFrame([(1, "dir", 6), (2, "dir", 2), (3, "dir", 2), (4, "dir", 2), (5, "file", 1), (6, "file", 1), (7, "file", 1), (8, "file", 2), (9, "file", 1), (10, "dir", 2)], "inode bigint, type string, nlink int")

    def move(*rows):
        e, n, m = mutations.rename_checked(edges, nodes, spark.createDataFrame(rows, "parent bigint, name string, to_parent bigint, to_name string, no_replace boolean"))
        return {r["inode"]: (r["parent"], r["name"]) for r in e.collect()}, {r["inode"]: r["nlink"] for r in n.collect()}, [r["outcome"] for r in m.orderBy("name").collect()]

    for row, outcome in (((1, "no", 1, "x", False), "missing"), ((1, "f1", 1, "f2", True), "exists"), ((1, "hard", 2, "f3", False), "same"), ((1, "f1", 1, "d1", False), "is_dir"), ((1, "d1", 1, "f1", False), "not_dir"), ((1, "d1", 1, "d3", False), "not_empty")):
        e, n, got = move(row)
        assert got == [outcome] and len(n) == 10 and n[1] == 6 and len(e) == 9
    e, n, got = move((1, "f1", 1, "f2", False), (1, "g", 2, "f3", False), (1, "d2", 1, "d4", False), (1, "d3", 2, "in", False))
    assert got == ["moved"] * 4
    assert 7 not in n and n[8] == 1 and 10 not in n  # a last link, one of two, a directory that was replaced
    assert n[1] == 6 - 1 - 1 and n[2] == 3 and e[3] == (1, "d4") and e[4] == (2, "in") and e[9] == (2, "f3")


def test_packs_by_chunk():
    chunks = [b"a" * 500, b"", bytes(range(200)), b"b" * 90]
    for codec in (0, 1, 2):
        pack = B.framed_by_chunk(chunks, codec)
        assert B.unframed(pack) == b"".join(chunks)
        if codec:
            size = struct.unpack_from(">I", pack, 6)[0]
            index = list(struct.iter_unpack(">QIQIB", pack[10 : 10 + size]))
            assert pack[:6] == b"CPK\x01" + bytes([3, codec]) and [e[4] for e in index] == [codec, 0, 0, codec]
            assert B.unframed(pack[:-1]) is None and B.unframed(pack[:12]) is None and B.unframed(pack[:10] + bytes([9]) + pack[11:]) is None
    assert B.unframed(b"CPK\x01\x07x") is None and B.unframed(b"CPK\x01\x01broken") is None and B.unframed(b"raw") == b"raw"


def test_canonical_requests():
    got = B.canonical_request("GET", "/a b/\u00e9", {"z": "1", "a": "x y", "prefix": "a/b"}, {"Host": "h.example", "X-Amz-Date": " 20240101T000000Z ", "b": "two  words"}, "UNSIGNED-PAYLOAD")
    assert got == "GET\n/a%20b/%C3%A9\na=x%20y&prefix=a%2Fb&z=1\nb:two words\nhost:h.example\nx-amz-date:20240101T000000Z\n\nb;host;x-amz-date\nUNSIGNED-PAYLOAD"
    text = B.string_to_sign(got, "20240101T000000Z", "r", "s3")
    assert text.startswith("AWS4-HMAC-SHA256\n20240101T000000Z\n20240101/r/s3/aws4_request\n") and len(text.rsplit("\n", 1)[1]) == 64


def test_tags_are_strings(spark):
    texts = [None, "", "{}", '{"a":"b"}', '{"a":1}', '{"a":{"b":1}}', '{"a":null}', "{bad", "[1]", '{"a":"b","c":true}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.parse_tags(F.col("t")).alias("p")).orderBy("i")
    assert [r["p"]["corrupt"] for r in df.collect()] == [False, False, False, False, True, True, False, True, True, True]
    assert [r["p"]["tags"] for r in df.collect()][3:6] == [{"a": "b"}, None, None]


def test_counters_observations_and_audit(spark):
    counters, first = mutations.reserve(spark.createDataFrame([("nextslice", 7), ("nextinode", 3)], "name string, value bigint"), "nextslice", 1000)
    assert first == 7 and {r["name"]: r["value"] for r in counters.collect()} == {"nextslice": 1007, "nextinode": 3}
    rows, sink = usage.observed(spark.range(10), "rows", F.sum("id").alias("ids"), F.count(F.lit(1)).alias("n"))
    rows.write.format("noop").mode("overwrite").save()
    assert sink.get == {"ids": 45, "n": 10}
    assert [tuple(r) for r in usage.audited(spark.range(1), F.lit("me"), "delete", F.lit(5)).collect()] == [("me", "delete", 5, '{"id":0}')]
