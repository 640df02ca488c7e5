"""Operators against brute force, and on odd input: nulls, empty and very long texts, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunklake.llm import attention, bpe, lm_scoring, minhash_dedup, mixing, neighbours, quality_rules, registry, sharding, substring_dedup, token_counts, url_filter
from chunklake.llm.common import coded, sequence_hash
from chunklake.llm.components import components
from tests.conftest import SF
from tests.llm.conftest import words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---- 1: near duplicates


def near_brute(docs, width, percent):
    sets = []
    for i, t in docs:
        w = split((t or "").translate(LOW))
        sets.append(set() if i is None else {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = {i: i for i, _ in docs if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations([(d[0], s) for d, s in zip(docs, sets, strict=True) if s], 2):
        if 100 * len(x & y) >= percent * len(x | y) and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((str(i), find(i) if i is not None and s else i) for (i, _), s in zip(docs, sets, strict=True))


def near_rows(df):
    return sorted((str(r["doc_id"]), r["component_id"]) for r in df.collect())


def test_near_dedup_on_odd_rows(spark, odd, none):
    setting = minhash_dedup.Setting(3, 85)
    got = minhash_dedup.groups(odd, setting)
    assert near_rows(got) == near_brute(docs_of(odd), 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())
    assert minhash_dedup.groups(none, setting).count() == 0


@pytest.mark.parametrize("hot", [128, 4])
def test_near_dedup_of_a_large_group(spark, monkeypatch, hot):
    """Copies of one text with random edits: links across the threshold both ways, through small bands and through large ones."""
    monkeypatch.setattr(minhash_dedup, "HOT", hot)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rng = np.random.default_rng(hot)
    data = [(0, words(*range(60)))]
    for i in range(1, 70):
        own = list(range(60))
        for at in rng.choice(60, int(rng.integers(1, 6)), replace=False):
            own[at] = 1000 + int(rng.integers(0, 50))
        data.append((i, words(*own)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert near_rows(minhash_dedup.groups(df, minhash_dedup.Setting(3, 85))) == near_brute(data, 3, 85)


def test_strays_of_a_hot_band(spark, monkeypatch):
    """A band with one large component and a few strays, near to some of its members only: the strays alone meet the rest."""
    monkeypatch.setattr(minhash_dedup, "HOT", 4)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    core = list(range(80))
    data = [(i, words(*core[:-1], 1000 + i)) for i in range(60)]  # one component, any two near
    data += [(100 + i, words(*core[: 80 - 7 * i], *range(2000 + 100 * i, 2000 + 107 * i))) for i in range(1, 6)]  # ever farther
    data += [(200, words(*core[:40], *range(3000, 3040))), (201, words(*core[:40], *range(3000, 3039), 9))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert near_rows(minhash_dedup.groups(df, minhash_dedup.Setting(3, 85))) == near_brute(data, 3, 85)


def test_of_equal_rows_the_least_stays(spark):
    text = words(*range(30))
    df = spark.createDataFrame([(1, text, "b", 2), (1, text, None, 9), (1, text, "b", 1), (2, text, "a", 0), (None, text, "z", 1), (None, text, "y", 1)], "doc_id long, text string, source string, n int")
    got = minhash_dedup.representatives(df, minhash_dedup.Setting(5, 80)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted([str((1, text, None, 9)), str((None, text, "y", 1))])


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(3)
    for n in (4, 60, 900, 5000):
        u = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        a, b = u[: n * 3 // 4], u[n // 4 :]
        sig = minhash_dedup.superminhash([np.sort(a), np.sort(b), np.zeros(0, np.uint64)])
        assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.13
        assert sig[2].min() == np.uint64(0xFFFFFFFFFFFFFFFF)


def test_superminhash_early_stop_changes_nothing():
    """Against the definition: each slot holds the least j + r over elements, all steps taken."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    slots, least = 16, [1 << 64] * 16
    for e in x.tolist():
        p = list(range(slots))
        for j in range(slots):
            with np.errstate(over="ignore"):
                r = int(minhash_dedup.mix(np.array([e], np.uint64) + np.uint64(j + 1) * minhash_dedup._GOLDEN)[0])
            k = j + (((r & 0xFFFFFFFF) * (slots - j)) >> 32)
            p[j], p[k] = p[k], p[j]
            least[p[j]] = min(least[p[j]], (j << 32) | (r >> 32))
    assert minhash_dedup.superminhash([x], slots)[0].tolist() == least


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 2: sharding


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def shard_rows(df, docs):
    got = df.collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(i or 0, 8), jump(i or 0, 9)) for i, t in docs
    )
    for s, rs in itertools.groupby(sorted(got, key=lambda r: r["shard"]), key=lambda r: r["shard"]):
        assert sorted(r["slot"] for r in rs) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 8) and r["law"] == "key" for r in got)


def test_sharding(spark, odd, none):
    shard_rows(sharding.assign(odd, 8), docs_of(odd))
    assert sharding.assign(none, 8).count() == 0
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    shard_rows(registry.op2_shard_jump(spark, SF), docs_of(whole))


def test_jump_over_many_shards(spark):
    df = spark.range(-50, 50).select("id", sharding.jump(F.col("id"), 100).alias("j"))
    assert all((r["j"]["shard"], r["j"]["grown"]) == (jump(r["id"], 100), jump(r["id"], 101)) for r in df.collect())
    with pytest.raises(ValueError):
        sharding.jump(F.lit(1), 0)


# ---- 3: URL filters


def test_url_filter_on_odd_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/7x?q#f", "https://com/en/", "http://a.b.com/en", "http://com./en/", "x://y.net/de/8", "http://example.net#/de/8", "http://a.example.net/de/81", "http://org/es/?", "ftp://..org/es/1", "http://notcom/en/", "http://com/en/\u0001", "http://a.com/en/1\n2"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*urls, *urls[3:5]])] + [(3, urls[3], "x", "y")], "page_id long, url string, rule string, lane string")
    rules = spark.createDataFrame([*registry.URL_RULES, ("com", "/en/", "allow"), (None, "/", "block")], "host string, path string, verdict string")

    def brute(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in registry.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    for lanes in (1, 5):
        got = url_filter.judge(pages, rules, lanes).collect()
        want = [(r["page_id"], *brute(r["url"])) for r in pages.collect()]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert url_filter.judge(pages.where("false"), rules, 3).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.where("false"), 3).collect()} == {"allow"}


def test_very_long_urls(spark):
    """A host of 100,000 labels, and a path as long, in a row with as many others."""
    host = ".".join(["a"] * 100_000)
    urls = [f"http://{host}.example.com/en/7", f"http://{host}/x", f"http://com/en/{host}", f"http://org/es/?{host}", "http://" + "." * 100_000 + "org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(registry.URL_RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"], len(r["host"])) for r in url_filter.judge(pages, rules, 3).collect()}
    assert got == {0: ("example.com/en/7", "allow", len(host) + 12), 1: (None, "allow", len(host)), 2: ("com/en/", "block", 3), 3: ("org/es/", "block", 3), 4: ("org/es/", "block", 100_003)}


# ---- 4: mixing


def features_brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    once = list(dict.fromkeys(w))
    share = lambda part, whole: min(8, part * 8 // max(whole, 1))
    marks = [
        f"symbols {share(sum(c in '#*$%&|<>!' for c in text), len(w))}", f"distinct {share(len(once), len(w))} {min(12, int(math.log2(len(w) + 1)))}",
        f"upper {share(sum('A' <= c <= 'Z' for c in text), len(text))}",
    ]
    return tuple(once + marks), len(w), len(once)


def posteriors_brute(docs, domain):
    """Naive Bayes, one document at a time: a mark by its share of the domain's documents, a word by its share of their distinct words; words that tell nothing have one share together."""
    seen = {(domain[i], *features_brute(t)[::2]) for i, t in docs if i in domain}
    names = sorted({d for d, *_ in seen})
    total, drawn = ({d: sum(v * (x == d) for x, _, v in rows) for d in names} for rows in ([(x, fs, 1) for x, fs, _ in seen], seen))
    count = {d: collections.Counter(f for x, fs, _ in seen if x == d for f in fs) for d in names}
    share = lambda f, d: (count[d][f] + 0.5) / (total[d] + 1)
    overall = lambda f: (sum(count[d][f] for d in names) + 0.5) / (len(seen) + 1)
    telling = {f for f in set().union(*count.values()) if sum(2 * count[d][f] * math.log(share(f, d) / overall(f)) for d in names) > mixing.TELLING}
    word = lambda f, d: (count[d][f] + 0.5) / (drawn[d] + 1)
    rest = {d: math.log(1 - sum(word(f, d) for f in telling if " " not in f)) for d in names}
    out = []
    for i, t in docs:
        fs, n, _ = features_brute(t)
        logs = [math.log((total[d] + 0.5) / (len(seen) + 1)) + sum((math.log(share(f, d)) if f in telling else 0) if " " in f else math.log(word(f, d)) if f in telling else rest[d] for f in fs) for d in names]
        e = [math.exp(x - max(logs)) for x in logs]
        out.append((str(i), n, *[x / sum(e) for x in e]))
    return names, sorted(out)


def test_posteriors_are_naive_bayes(spark):
    sf = "/root/testdata/sf0.01"
    docs, domains = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 400"), mixing.domain_of(spark.read.parquet(f"{sf}/labels.parquet"))
    names, want = posteriors_brute(docs_of(docs), {r["doc_id"]: r["domain"] for r in domains.collect()})
    for sent in (500_000, 0):  # the table of features as a broadcast and in a shuffled join
        mixing.SENT, before = sent, mixing.SENT
        try:
            got = mixing.posteriors(docs.select("doc_id", "text"), mixing.classifier(docs.select("doc_id", "text"), domains)).collect()
        finally:
            mixing.SENT = before
        got = sorted((str(r["doc_id"]), r["n_tokens"], *[r[f"p_{n}"] for n in names]) for r in got)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=1e-6)


def mixed(got, weights, growth=1.0):
    names = [c[2:] for c in got.columns if c.startswith("p_")]
    p, t, rate = got[[f"p_{n}" for n in names]].to_numpy(), got["n_tokens"].to_numpy().astype(float), got["rate"].to_numpy()
    start = (p * t[:, None]).sum(axis=0)
    return names, p, t, rate, start, np.array([weights[n] for n in names]) * growth * t.sum()


def test_mixing_reaches_its_targets(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for weights in ({"good": 0.8, "poor": 0.15, "toxic": 0.05}, registry.MIX_WEIGHTS):
        got = mixing.mix(docs, labels, weights).toPandas()
        names, p, t, rate, _, target = mixed(got, weights)
        assert len(got) == docs.count() and (rate >= 0).all() and np.allclose(p.sum(axis=1), 1, atol=1e-6)
        assert (np.abs((p * (t * rate)[:, None]).sum(axis=0) - target) <= 1e-3 * target).all() and got["gap"].max() < 1e-5
    held = got.merge(labels.toPandas(), on="doc_id")
    good = (held["quality"] == 1) & (held["toxic"] == 0)
    best = held[[f"p_{n}" for n in names]].to_numpy().argmax(axis=1)
    assert (best[good] == names.index("good")).mean() > 0.95 and (best[held["toxic"] == 1] == names.index("toxic")).mean() > 0.6


def test_rates_are_the_least_squares_that_can_be_had(spark):
    """Against plain projected gradient in numpy, run to the end: targets that can be reached, that can't, and least rates."""
    rng = np.random.default_rng(2)
    q = rng.dirichlet([2, 1, 0.5], 300)
    data = [(i, int(rng.integers(0, 50)), *map(float, row), float(i % 3 == 0)) for i, row in enumerate(q)]
    for weights, growth, columns in (({"a": 0.5, "b": 0.3, "c": 0.2}, 1.0, "a b c"), ({"a": 0.001, "b": 0.998, "c": 0.001}, 1.0, "a b c"), ({"a": 0.9, "b": 0.05, "c": 0.05}, 1.2, "a b c __least")):
        df = spark.createDataFrame(data, "doc_id long, n_tokens long, p_a double, p_b double, p_c double, __least double")
        df = df if "__least" in columns else df.drop("__least")
        got = mixing.rates(df, weights, growth).orderBy("doc_id").toPandas()
        _, p, t, rate, start, target = mixed(got, weights, growth)
        least = np.array([d[-1] for d in data]) if "__least" in columns else np.zeros(len(t))
        r = np.ones(len(t))
        for _ in range(100_000):
            off = (p * (t * r)[:, None]).sum(axis=0) - target
            r, last = np.maximum(least, r - 1.5 * (p @ (off / start))), r
            if np.abs(r - last).max() < 1e-10:
                break
        cost = lambda r: float((((p * (t * r)[:, None]).sum(axis=0) - target) ** 2 / start).sum())
        assert (rate >= least - 1e-9).all() and cost(rate) <= cost(r) + 1e-4 * cost(np.ones(len(t)))
        gap = np.abs((p * (t * rate)[:, None]).sum(axis=0) - target).max() / t.sum()
        assert abs(gap - got["gap"][0]) < 1e-5


def test_a_domain_with_next_to_no_tokens_repeats_no_row_without_end(spark):
    """A share that a domain's tokens can't give: rates stay below `most`, and the other targets are met."""
    rng = np.random.default_rng(4)
    weights = {"good": 0.985, "poor": 0.005, "toxic": 0.01}
    for p_rare, rows in ((1e-9, 1), (1e-6, 3), (1e-3, 20), (0.9, 2)):
        bad = rng.random(2000) < 0.1
        rare = [0.3 if i == rows else p_rare if i < rows else 0.0 for i in range(2000)]  # the row after them has no tokens
        data = [(i, 0 if i == rows else 100, (1 - b) * (1 - r), r, b * (1 - r), float(not b)) for i, (b, r) in enumerate(zip(bad.astype(float).tolist(), rare, strict=True))]
        df = spark.createDataFrame(data, "doc_id long, n_tokens long, p_good double, p_poor double, p_toxic double, __least double")
        got = mixing.rates(df, weights, 1.15, most=mixing.MOST).orderBy("doc_id").toPandas()
        _, p, t, rate, _, target = mixed(got, weights, 1.15)
        assert (rate >= [d[-1] for d in data]).all() and rate.max() <= mixing.MOST
        off = (p * (t * rate)[:, None]).sum(axis=0) - target
        assert (np.abs(off[[0, 2]]) <= 2e-3 * t.sum()).all() and abs(np.abs(off).max() / t.sum() - got["gap"][0]) < 1e-5


def test_resampling_with_one_labelled_row_of_a_domain(spark):
    """One poor document among many: a row has no more copies than `most`, and the table doesn't grow past its targets."""
    texts = [" ".join(f"fine{(i * 7 + k) % 900}" for k in range(40)) for i in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i != 3), 0) for i in range(1500)], "doc_id long, quality int, toxic int")
    copies = mixing.resample(docs, labels, {"good": 0.985, "poor": 0.005, "toxic": 0.01}, 1.15, spared="good").groupBy("doc_id").count().toPandas()["count"]
    assert copies.max() <= mixing.MOST and 0.9 * 1500 <= copies.sum() <= 1.3 * 1500


def test_mixing_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (5, None, None), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(odd, labels, {"good": 1.0})
    assert got.count() == odd.count() and got.where("rate is null or rate < 0").count() == 0
    assert mixing.mix(odd, labels.where("false"), {"all": 1.0}).where("p_all <> 1").count() == 0
    assert mixing.mix(none, labels, {"good": 1.0}).count() == 0
    out = mixing.resample(odd, labels.where("false"), {"all": 1.0}, growth=2.0)
    assert out.columns == odd.columns and out.where("doc_id = 10").count() == 2


# ---- 5: quality rules


def quality_brute(text):
    w = split(text)
    win = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cov = {p for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cov)


def test_quality_on_odd_rows(odd, none):
    got = sorted((str(r["doc_id"]), *[r[c] for c in quality_rules.COUNTS], r["base_failed"]) for r in quality_rules.judge(odd).collect())
    want = sorted((str(i), *(m := quality_brute(t)), m[0] < 20 or 100 * m[4] > 30 * m[0]) for i, t in docs_of(odd))
    assert got == want
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_cascade_order_changes_no_verdict(odd):
    texts = [(t or "").encode() for _, t in docs_of(odd)]
    kept = {tuple(quality_rules.verdicts(texts, list(o))[0]) for o in itertools.islice(itertools.permutations(quality_rules.RULES), 0, 720, 90)}
    assert len(kept) == 1
    assert {r.name for r in quality_rules.ordered(odd)} == {r.name for r in quality_rules.RULES}
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in quality_rules.keep_good(odd).collect()) == sorted(str(r["doc_id"]) for r in quality_rules.judge(odd).where("kept").collect())


def test_the_sample_does_not_grow_with_partitions(spark):
    texts = spark.range(0, 200_000, 1, 1000).select(F.concat_ws(" ", F.lit("word"), F.col("id")).alias("text"))
    assert {n: lost for n, _, lost in quality_rules.estimate(texts, rows=64)}["few_words"] == 64
    assert quality_rules.estimate(texts.where("false")) == []
    assert quality_rules.ordered(texts.where("false")) == quality_rules.RULES


def test_a_rule_sees_only_the_rows_left(odd):
    texts = [(t or "").encode() for _, t in docs_of(odd)] * 3
    whole, seen = quality_rules.Measures(texts), []
    rules = [quality_rules.Rule(r.name, r.needs, lambda m, r=r: (seen.append(len(m.texts)), r.rejects(m))[1]) for r in quality_rules.RULES]
    kept, by = quality_rules.cascade(whole, rules)
    assert seen[0] == len(texts) and seen == sorted(seen, reverse=True) and seen[-1] < seen[0]
    assert [b is None for b in by] == kept.tolist()
    rows = np.array([4, 0, 0, 13])
    for known in ((), ("n_words",), ("n_repeat_words", "n_upper")):
        m = quality_rules.Measures(texts)
        for name in known:
            m[name]
        for name in quality_rules.COUNTS + quality_rules.OTHERS:
            assert m.take(rows)[name].tolist() == whole[name][rows].tolist()


# ---- 6: token counts


def test_rollup_is_idempotent(spark, odd, none):
    rollup = token_counts.Rollup(spark)
    assert rollup.totals().count() == 0
    assert rollup.commit("a", token_counts.inserts(odd, "words-1"))
    once = sorted(map(str, rollup.totals().collect()))
    assert not rollup.commit("a", token_counts.inserts(odd, "words-1")) and sorted(map(str, rollup.totals().collect())) == once
    assert rollup.commit("empty", token_counts.inserts(none, "words-1"))
    rollup.commit("revised", token_counts.revisions(odd.where("doc_id = 10"), "words-1", F.lit(60), F.lit(61)))
    assert sum(r["n_tokens"] for r in rollup.totals().collect()) == sum(len(split(t)) for _, t in docs_of(odd)) + 1
    rollup.commit("gone", token_counts.deletes(odd, "words-1"))
    assert [r["n_docs"] for r in rollup.totals().collect()] == [0]  # the revision is still there
    with pytest.raises(ValueError):
        rollup.commit("../x", none)


def test_a_batch_without_its_marker_does_not_count(spark, odd):
    rollup = token_counts.Rollup(spark)
    path, fs = rollup._path("half")
    token_counts.inserts(odd, "words-1").write.parquet(path.toString())
    fs.delete(rollup._path("half", "/_SUCCESS")[0], False)
    assert rollup.batches() == [] and rollup.totals().count() == 0
    assert rollup.commit("half", token_counts.inserts(odd, "words-1")) and rollup.batches() == ["half"]


def test_rollup_on_odd_rows(odd, none):
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in token_counts.maintain(odd).collect()}
    first = {}
    for r in sorted(odd.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        first.setdefault(r["text"], r)
    want = collections.Counter(), collections.Counter()
    for r in first.values():
        want[0][r["source"], r["lang"]] += 1
        want[1][r["source"], r["lang"], "words-1"] += len(split(r["text"])) + 1
        want[1][r["source"], r["lang"], "words-2"] += len(re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]", r["text"] or ""))
    assert got == {(*k, v): (n, want[1][*k, v]) for k, n in want[0].items() for v in ("words-1", "words-2")}
    assert token_counts.maintain(none).count() == 0


# ---- 7: BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.tokenizer_path("byte_bpe_50k.json"))


def test_bpe_is_the_library_s(spark, odd, none, library):
    path = registry.tokenizer_path("byte_bpe_50k.json")
    whole = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = collections.Counter()
    for i, t in docs_of(whole):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe.digest(whole, path).collect())) == want
    back = bpe.decode(bpe.encode(odd, path), path)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((i, t or "")) for i, t in docs_of(odd))
    assert bpe.digest(none, path).count() == 0 and bpe.encode(none, path).count() == 0


def test_bpe_on_random_texts(library):
    import random

    rnd = random.Random(5)
    alphabet = [*" \n\t\r\x0b\x1c\x85\u00a0\u2003'sdlmtrvea cA1", "é", "中", "<|endoftext|>", "'re", "  ", "the", "aaaa", "😀", "\u0301"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 30))) for _ in range(3000)] + ["a" * n for n in range(40)]
    with open(registry.tokenizer_path("byte_bpe_50k.json"), "rb") as f:
        units = bpe.Units(bpe.PairIndexBPE(f.read()))
    ids, ends = units.ids_of(units.numbers([t.encode() for t in texts]))
    for t, lo, hi in zip(texts, ends, ends[1:], strict=False):
        assert ids[lo:hi].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


# ---- 8: nearest neighbours


def nearest_brute(ids, x, every, k):
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            s = (x * x[i]).sum(axis=1) / (norm * norm[i])
            other = [j for j in range(len(ids)) if ids[j] != q]
            out[q] = sorted(other, key=lambda j: (-s[j], ids[j]))[:k], s
    return out


def test_recall_and_exact_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.array(e["embedding"].tolist(), np.float64), e["vec_id"].tolist()
    got = collections.defaultdict(list)
    for r in registry.op8_multiprobe_pstable(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = n = 0
    for q, (best, s) in nearest_brute(ids, x, 50, 5).items():
        want = {ids[j] for j in best}
        hit, n = hit + len(want & {v for v, _ in got[q]}), n + len(want)
        assert all(abs(score - s[ids.index(v)]) < 1e-12 for v, score in got[q])
    assert hit / n >= 0.9


def test_neighbours_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 0.0]), (8, [1.0]), (None, [1.0, 0.0]), (9, [1e30, 1e30]), (10, [-1.0, 1e-30]), (10, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 5, 0.5) for i, v in data], "vec_id long, embedding array<float>, rank int, score double")
    got = neighbours.nearest(df, 10, 5).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [1, 2, 9, 10, 10]
    assert {r["query_id"] for r in got} == {0, 10} and [r["rank"] for r in got if r["query_id"] == 0] == [1, 2, 3, 4, 5]
    assert neighbours.nearest(df.where("false"), 10, 5).count() == 0


def test_recall_over_many_groups_and_blocks(spark):
    """12,000 vectors, a third of them equal, in groups of some 500 rows that meet 64 queries at a time."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12_000, 64)).astype(np.float32)
    x[rng.permutation(12_000)[:4000]] = x[7]
    ids = np.arange(12_000)
    index = neighbours.Index(row_block=512, query_block=64)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, 50, 5, index).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = n = 0
    for q, (best, s) in nearest_brute(ids.tolist(), x.astype(np.float64), 50, 5).items():
        want = {int(ids[j]) for j in best}
        hit, n = hit + len(want & {v for v, _ in got[q]}), n + len(want)
        assert len(got[q]) == 5 and all(abs(score - s[v]) < 1e-12 for v, score in got[q])
        if (x[q] == x[7]).all():
            assert {v for v, _ in got[q]} == want
    assert hit / n >= 0.9


def test_no_queries_and_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 9)], "vec_id long, embedding array<double>")
    assert neighbours.nearest(df, 50, 5).count() == 0
    assert sorted((r["query_id"], r["vec_id"]) for r in neighbours.nearest(df, 7, 50).collect()) == [(7, i) for i in (1, 2, 3, 4, 5, 6, 8)]


def test_probes_come_in_order_and_never_hit_both_walls():
    sets = neighbours.probe_sets(5, 60)
    assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == len(sets)
    assert all(not any(9 - i in s for i in s) for s in sets)


# ---- 9: substring dedup


def substring_brute(docs, window):
    first = {}
    split_docs = [(i, split(t)) for i, t in docs]
    for i, w in split_docs:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split_docs:
        gone = {p for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_substring_on_odd_rows(odd, none):
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digest(odd).collect())
    assert got == substring_brute(docs_of(odd), 50)
    assert substring_dedup.digest(none).count() == 0


@pytest.mark.parametrize("window,run", [(6, 3), (5, 5), (8, 1)])
def test_substring_on_random_rows(spark, window, run):
    rng = np.random.default_rng(window)
    data = [(int(i), words(*rng.integers(0, 3, int(rng.integers(0, 40))))) for i in rng.permutation(60)] + [(5, words(0, 1, 2, 0, 1, 2, 0, 1, 2)), (61, words(*[1] * 30))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digest(df, window, run).collect())
    assert got == substring_brute(data, window)


def test_few_rows_but_candidates_are_dealt(spark):
    rows = spark.range(-20_000, 20_000).selectExpr("id AS doc_id", "cast(id AS string) AS text").union(spark.createDataFrame([(None, "none")], "doc_id long, text string"))
    ids = spark.range(-20_000, 20_000, 13).selectExpr("id AS doc_id")
    want = {r["doc_id"] for r in ids.collect()}
    for n, most, more in ((len(want), substring_dedup.MAP_BITS, 0.1), (len(want), 1 << 15, 0.15), (1 << 40, 1 << 18, 0.05)):
        got = substring_dedup.likely(rows, ids, n, most)
        found = [r["doc_id"] for r in got.collect()]
        assert got.columns == rows.columns and len(found) == len(set(found)) and want <= set(found)
        assert len(found) - len(want) < more * 40_000
    assert substring_dedup.likely(rows, ids.where("false"), 0).count() == 0


def test_removal_leaves_clean_texts_alone(odd):
    out = substring_dedup.remove(odd, length="n_chars")
    assert out.columns == odd.columns and out.count() == odd.count()
    want = {s[0]: s for s in substring_brute(docs_of(odd), 50)}
    before = dict(docs_of(odd))
    for r in out.collect():
        if r["doc_id"] is not None and want[str(r["doc_id"])][2] == 0:
            assert r["text"] == before[r["doc_id"]]
        elif r["doc_id"] is not None:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == want[str(r["doc_id"])][3] and r["n_chars"] == len(r["text"])


def test_window_hashes_roll():
    h = np.random.default_rng(1).integers(0, 1 << 62, 50, dtype=np.uint64)
    h[20:27] = h[3:10]
    s = sequence_hash(h, 7)
    assert s[3] == s[20] and len(set(s.tolist())) == len(s) - 1
    assert len(sequence_hash(h[:3], 7)) == 0


# ---- 10: language model


def base_brute(docs):
    tok = [(i, [*split((t or "").translate(LOW)), None]) for i, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    c = collections.Counter(w for (_, ws), h in zip(tok, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(str(i), h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for (i, ws), h in zip(tok, held, strict=True)]


def test_base_scores_on_odd_rows(odd, none):
    path = registry.tokenizer_path("byte_bpe_50k.tiktoken")
    got = lm_scoring.score(odd, path).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted(base_brute(docs_of(odd)))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    by_text = collections.defaultdict(set)
    for r, (_, t) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["n_tokens"])), sorted(docs_of(odd), key=lambda d: (str(d[0]), len(split(d[1])) + 1)), strict=True):
        by_text[t or ""].add(round(r["score"], 6))
    assert all(len(s) == 1 for s in by_text.values())  # a score depends on the text alone
    assert lm_scoring.score(none, path).count() == 0


def test_equal_texts_have_one_score(spark):
    data = [(1, 7, 3, -2.25), (2, 7, 3, -2.2500002), (None, 7, 3, -2.2499998), (3, 8, 3, -2.1), (4, 7, 4, -9.0), (4, 7, 4, -9.0)]
    got = lm_scoring.alike(spark.createDataFrame(data, "doc_id long, text_hash long, n_tokens long, score double"))
    assert sorted((str(r["doc_id"]), r["text_hash"], r["n_tokens"], r["score"]) for r in got.collect()) == sorted((str(i), h, n, -2.2500002 if (h, n) == (7, 3) else s) for i, h, n, s in data)


def test_rare_words_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", 20)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = lm_scoring.score(docs, registry.tokenizer_path("byte_bpe_50k.tiktoken")).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted(base_brute(docs_of(docs)))


def test_training_beats_the_unigram_on_held_out_text():
    """The same sequence scored by the untrained weights, which are a class unigram, and by the trained ones."""
    rng = np.random.default_rng(0)
    shape = attention.Shape(groups=2, leaves=4, frequent=0, window=16, overlap=4)
    seq = np.zeros(8000, np.int64)
    for i in range(1, len(seq)):
        seq[i] = (seq[i - 1] * 3 + 1) % 8 if rng.random() < 0.8 else rng.integers(0, 8)
    ends = np.array([0, 6000, 8000])
    maps = np.append(np.arange(8), 8), np.arange(8)
    text, inputs, targets, real = lm_scoring._laid(seq, ends, shape, maps)
    p = attention.fresh(shape, np.bincount(seq, minlength=8))
    own, trained = text == 0, p
    for seed in range(4):
        trained = attention.train(trained, inputs[own], targets[own], real[own], seed=seed, batch=16, rate=1e-2)
    score = lambda w: (attention.log_probs(w, inputs[~own], targets[~own]) * real[~own]).sum()
    assert score(trained) > score(p) + 500


def gathered(spark, texts, shape):
    path = registry.tokenizer_path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = f.read()
    docs = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string").withColumn("text", F.col("text").cast("binary"))
    sub = lm_scoring.Subwords(ranks)
    return lm_scoring.gather(docs, spark.sparkContext.broadcast(ranks), shape), sub, *sub.stream(*sub.group(pa.array(texts)))


def test_every_token_is_trained_on_once(spark):
    """The pieces that training gets hold each token of each training text, long ones included, as a target once, with its own predecessor."""
    texts, shape = [*[" ".join(f"word{i * j % 97}" for i in range(n)) for j, n in enumerate([1, 20, 33, 700, 9000], 1)], None], attention.Shape()
    got, sub, seq, ends, _ = gathered(spark, texts, shape)
    got = got.where("kind = 2")
    kind = lm_scoring._kind_of_ids(sub.size)
    assert {r["k"]: np.frombuffer(r["ids"], kind).tolist() for r in got.collect()} == {i: seq[lo:hi].tolist() for i, (lo, hi) in enumerate(itertools.pairwise(ends.tolist()))}
    pieces = [bytes(r["ids"]) for r in lm_scoring._cut(got, sub.size, shape).collect()]
    inputs, targets, real = lm_scoring._windows_of(pieces, (np.arange(sub.size + 1), np.arange(sub.size)), shape)
    want = collections.Counter()
    for lo, hi in itertools.pairwise(ends.tolist()):
        want.update(zip([sub.size, *seq[lo : hi - 1].tolist()], seq[lo:hi].tolist(), strict=True))
    assert collections.Counter(zip(inputs[real].tolist(), targets[real].tolist(), strict=True)) == want
    assert all((i[1:][r[1:]] == t[:-1][r[1:]]).all() for i, t, r in zip(inputs, targets, real, strict=True))
    assert got.agg(F.sum("c")).first()[0] == sum(-(-n // shape.window) for n in np.diff(ends)) >= len(inputs)


def test_ids_tell_words_apart(spark):
    """Counts by the key of a word's ids are counts of words, and odd bytes keep words apart as well."""
    texts = ["a b a c\u00a0d a\u2003b \x1c \x85 ab a'b a's 's", "A B <|endoftext|> <|endof text|>", "\u00e9 e\u0301 " + "x" * 3000, ""]
    got, sub, seq, _, starts = gathered(spark, texts, attention.Shape())
    counts = sorted(r["c"] for r in got.where("kind = 0").groupBy("k").agg(F.sum("c").alias("c")).collect())
    assert counts == sorted(collections.Counter(w for t in texts for w in [*split(t.translate(LOW)), None]).values())
    odd = [b"\xff", b"\xfe", b"\xff\xfe", "\ufffd".encode(), b"a\xff"]
    ids, sizes = sub._encoded(odd)
    assert len(set(lm_scoring.word_keys(ids, np.cumsum(sizes) - sizes).tolist())) == len(odd)


def subword_unigram(docs, shape):
    """log10 probability of all held-out texts by add-one counts of subwords in the training texts, which is a distribution."""
    with open(registry.tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        sub = lm_scoring.Subwords(f.read())
    train, held = ([t for i, t in docs if (zlib.crc32(str(i).encode()) % 7 == 2) == h] for h in (False, True))
    counts = np.bincount(sub.stream(*sub.group(pa.array(train)))[0], minlength=sub.size)
    seq = sub.stream(*sub.group(pa.array(held)))[0]
    return float(np.log10((counts[seq] + 1) / (counts.sum() + sub.size)).sum())


def test_scores_of_held_out_documents_beat_a_subword_unigram(spark):
    """Real held-out documents, by the model as built. Untrained, it is the unigram but for the smoothing."""
    assert [lm_scoring.trainers_of(n) for n in (1, 4000, 400_000, 400_001, 4_000_000)] == [1, 1, 1, 2, 10] and lm_scoring.ROUNDS >= 2
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = lm_scoring.score(docs, registry.tokenizer_path("byte_bpe_50k.tiktoken")).where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    unigram = subword_unigram(docs_of(docs), attention.Shape())
    print("held out:", got[0], "subword unigram:", unigram, "words:", got[1])
    assert got[0] > 0.85 * unigram


def test_the_untrained_model_is_the_subword_unigram(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "fit", lambda texts, maps, class_counts, shape: attention.fresh(shape, class_counts))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = lm_scoring.score(docs, registry.tokenizer_path("byte_bpe_50k.tiktoken")).where("held_out").agg(F.sum("score")).first()[0]
    assert abs(got / subword_unigram(docs_of(docs), attention.Shape()) - 1) < 0.06  # its random weights and the smoothing of classes cost a little


@pytest.mark.parametrize("counts", [[5, 1, 0, 9, 9, 2, 0, 0], [0] * 8, [1] * 300, [1000, *[1] * 999], [7]])
def test_classes_are_filled(counts):
    counts = np.array(counts)
    cls = lm_scoring.classes_of(counts, 4)
    assert cls.min() >= 0 and cls.max() <= 3 and (np.diff(cls[np.argsort(-counts, kind="stable")]) >= 0).all()
    if (counts > 0).sum() >= 4:
        assert set(cls.tolist()) == {0, 1, 2, 3}


def test_gradients_are_right():
    shape = attention.Shape(groups=2, leaves=3, frequent=0, width=4, window=6, overlap=2)
    rng = np.random.default_rng(2)
    p = {n: v.astype(np.float64) for n, v in attention.fresh(shape, np.ones(6)).items()}
    inputs, targets, real = rng.integers(0, 7, (3, 6)), rng.integers(0, 6, (3, 6)), rng.random((3, 6)) < 0.8

    def loss():
        return -(attention.log_probs(p, inputs, targets) * real).sum() / real.sum()

    g = attention.gradients(p, inputs, targets, real)
    for n in attention.SHAPES:
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in p[n].shape)
            keep, h = p[n][at], 1e-4
            p[n][at] = keep + h
            up = loss()
            p[n][at] = keep - h
            down = loss()
            p[n][at] = keep
            assert abs((up - down) / (2 * h) - g[n][at]) < 1e-6


def test_attention_is_causal_and_normalised():
    shape = attention.Shape(groups=3, leaves=2, frequent=0, window=8, overlap=2)
    p = attention.fresh(shape, np.arange(6))
    rng = np.random.default_rng(7)
    a = rng.integers(0, 7, (1, 8))
    b = a.copy()
    b[0, 5:] = rng.integers(0, 7, 3)
    every = np.stack([attention.log_probs(p, a, np.full((1, 8), k))[0] for k in range(6)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-5)
    t = np.zeros((1, 8), np.int64)
    assert np.allclose(attention.log_probs(p, a, t)[0, :5], attention.log_probs(p, b, t)[0, :5], atol=1e-6)
    assert np.allclose(attention.Scorer(p)(a, t, 3), attention.log_probs(p, a, t)[:, 3:], atol=1e-5)
    big = {n: v * 1000 for n, v in p.items()}
    assert np.isfinite(attention.log_probs(big, a, t)).all()


@pytest.mark.parametrize("sizes", [[1], [32, 33, 28, 56, 57, 500], [1, 1, 2000]])
def test_windows_score_each_token_once(sizes):
    shape = attention.Shape()
    text, begin, score = attention.windows(np.array(sizes), shape)
    seen = [np.zeros(n, int) for n in sizes]
    for t, b, s in zip(text, begin, score, strict=True):
        seen[t][s : b + shape.window] += 1
    assert all((x == 1).all() for x in seen)


def test_the_model_has_its_full_size():
    """128 classes or more and two rounds; each token scored in a later window sees at least 8 tokens before it."""
    shape = attention.Shape()
    assert shape.classes >= 128 and lm_scoring.ROUNDS >= 2
    _, begin, score = attention.windows(np.array([33, 500, 2000]), shape)
    assert (score - begin)[begin > 0].min() >= 8


def test_words_are_the_contract_s(odd):
    import pyarrow as pa

    texts = [t for _, t in docs_of(odd)] + [" a  b\x0bc\x1cd\x85e \n", "AÀB", " "]
    for column in (pa.array(texts), pa.array([None if t is None else t.encode() for t in texts], pa.binary())[1:]):
        for lower in (False, True):
            words, codes, ends = coded(column, lower)
            for t, lo, hi in zip(texts[len(texts) - len(column) :], ends, ends[1:], strict=False):
                assert [words[c].decode() for c in codes[lo:hi]] == split((t or "").translate(LOW) if lower else t)


def test_words_of_slices_of_a_large_batch():
    import pyarrow as pa

    from chunklake.llm.common import chunks

    rng = np.random.default_rng(8)
    texts = [" ".join(f"Word{i}" for i in rng.integers(0, 5000, int(rng.integers(0, 9000)))) for _ in range(120)]
    for kind in (pa.binary(), pa.large_binary()):
        batch = pa.RecordBatch.from_arrays([pa.array([None, *[t.encode() for t in texts]], kind)], names=["text"])
        seen = 0
        for part, own in chunks(iter([batch])):
            for lower in (False, True):
                words, codes, ends = coded(part.column(0), lower)
                assert [words[c] for c in codes] == [w for t in own for w in (t.lower() if lower else t).split()]
                assert np.diff(ends).tolist() == [len(t.split()) for t in own]
            seen += 1
        assert seen > 2
