"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, long inputs, empty tables and clashing names."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import negatives, prefix_trie, url_filter


def brute_trie(rows):
    """rows: (conv, turn, role, text) in the order that ties take."""
    own = collections.defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in of if rebuilt[c] == node)
        out.append((of[0], len(node), members[node[:-1]][0] if node else None, len(of), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return collections.Counter(out)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def got_trie(df):
    return collections.Counter(tuple(r[c] for c in TRIE) for r in df.collect())


def talks(seed, n=130, gaps=True):
    rng = random.Random(seed)
    words = ["ja", "nein", "ÿ𝄞", "", "so " * 9]
    rows = []
    for c in [*range(n), -3, -100, -205, 10**15]:
        if gaps and rng.random() < 0.1 and c != 100:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 4, 7])):
            rows.append((c, None if t == 0 and c % 3 == 0 else t, rng.choice(["user", "bot", None]) if t % 2 else "user", rng.choice([*words, None]) if rng.random() < 0.8 else f"only {c} {t}"))
    return rows


def frame(spark, rows):
    schema = "conv_id long, turn long, role string, text string, depth int, key1 int, k string, n int, salt int, upto int"
    return spark.createDataFrame([(*r, 1, 2, "k", None, 3, 4) for r in rows], schema)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = talks(seed, gaps=seed == 1)
    mixed = random.Random(seed).sample(rows, len(rows))
    assert got_trie(prefix_trie.trie(frame(spark, mixed).repartition(5))) == brute_trie(sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)))


def test_trie_long_copies_and_ranges(spark):
    long = [(c, t, "user", f"turn {t % 7}") for c in (500, 501, 503, 742) for t in range(120)]
    hot = [(c, t, "bot", "same") for c in range(1000, 2600) for t in range(3)]
    rows = long + hot + [(None, 1, "user", "nobody")] + [(7, 1, "x", None)]
    assert got_trie(prefix_trie.trie(frame(spark, rows).repartition(3))) == brute_trie(sorted(r for r in rows if r[0] is not None))


def test_trie_ties_repeats_and_nothing(spark):
    rows = [(5, 1, "user", "a")] * 3 + [(5, 2, "user", "b"), (5, 2, "user", "c"), (5, None, None, None), (200, 0, "user", "z")]
    got = prefix_trie.trie(frame(spark, rows)).collect()
    assert sum(r.n_convs for r in got if r.depth == 0) == 2 and got_trie(prefix_trie.trie(frame(spark, rows).repartition(4))) == got_trie(prefix_trie.trie(frame(spark, rows[::-1])))
    h = zlib.crc32(b"5") % 6
    assert max(r.depth for r in got if r.conv_id == 5) == max(0, 6 - h)
    assert prefix_trie.trie(frame(spark, [])).collect() == [] and prefix_trie.trie(frame(spark, [(None, 1, "a", "b")])).collect() == []
    turnless = next(c for c in range(300, 400) if zlib.crc32(str(c).encode()) % 6 == 4)
    assert got_trie(prefix_trie.trie(frame(spark, [(turnless, 0, "user", "x")]))) == brute_trie([(turnless, 0, "user", "x")])


def test_hashed_stretches_are_one(spark):
    """Cutting a conversation anywhere gives the same sums."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n = 40
    columns = {"conv": np.repeat([1, 2], [25, 15]).astype(np.int64), "pid": np.zeros(n, np.int32), "h1": rng.integers(-(2**63), 2**63, n), "h2": rng.integers(-(2**63), 2**63, n), "chars": rng.integers(0, 9, n)}
    whole = pa.Table.from_batches(list(prefix_trie.hashed([pa.record_batch(columns)])))
    for cut in (1, 13, 25, 39):
        parts = [pa.record_batch({k: v[a:b] for k, v in columns.items()}) for a, b in ((0, cut), (cut, n))]
        assert pa.Table.from_batches(list(prefix_trie.hashed(parts))).equals(whole)


def brute_negatives(rows, every=100):
    vectors = {(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * float(x)) for x in v)) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)}
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = collections.Counter()
    for a in vectors:
        if a[0] % every:
            continue
        ranked = sorted(((-score(a, b), b[0], b[1]) for b in vectors if b[0] != a[0]))
        for ps, p, _ in [x for x in ranked if x[2] == a[1]][:5]:
            fit = [x for x in ranked if x[2] != a[1] and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:10]
            out.update((a[0], p, r, b, -ps, -s) for r, (s, b, _) in enumerate(fit, 1))
    return out


def got_negatives(df):
    return collections.Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, part int, id string, crowd int, v int").select("*")


def test_negatives(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.3, (700, 12)).astype(np.float32)
    base[200:420] = base[200]  # a vector that many rows share
    rows = [(i, base[i].tolist(), int(rng.integers(0, 3))) for i in range(700)]
    rows += rows[100:130]  # repeated rows
    nan, inf = float("nan"), float("inf")
    rows += [(None, [1.0], 1), (900, None, 1), (901, [1.0, None], 1), (902, [nan], 1), (903, [inf], 2), (904, [0.5], None), (1000, [], 1), (1100, [0.5] * 3, 2), (1200, [0.0] * 12, 0), (-100, [0.25] * 5, 1)]
    rows += [(300, [0.1] * 12, 2)]  # an id with another vector
    want = brute_negatives([(i, lab, v) for i, v, lab in rows])
    for sizes in ({}, {"block_rows": 90, "block_anchors": 2}, {"count": 2}):
        assert got_negatives(negatives.mine(vectors(spark, rows), **sizes)) == want


def test_negatives_cases(spark):
    assert negatives.mine(vectors(spark, [])).collect() == []
    assert negatives.mine(vectors(spark, [(0, [0.5, 0.5], 1)])).collect() == []
    few = [(0, [1.0], 1), (1, [1.0], 2), (2, [0.5], 2), (3, [0.25], 3)]
    want = brute_negatives([(i, lab, v) for i, v, lab in few])
    assert got_negatives(negatives.mine(vectors(spark, few))) == want and len(want) == 1
    with pytest.raises(ValueError):
        negatives.mine(vectors(spark, [(0, [1e30], 1), (1, [1.0], 1)]))


def test_negatives_bounds_hold():
    rng = np.random.default_rng(8)
    v = rng.integers(-200, 200, (300, 9))
    edges = np.sort(rng.integers(-200, 200, (9, 17)), axis=1)
    edges[:, 0], edges[:, -1] = v.min(axis=0), v.max(axis=0) + 1
    block = negatives.Approximations(np.arange(300), np.zeros(300, np.int32), v, np.clip(edges, edges[:, :1], edges[:, -1:]))
    for q in (rng.integers(-200, 200, 9), rng.integers(-(2**40), 2**40, 9)):
        low, high = block.bounds(q, 0, 300)
        assert (low <= v @ q).all() and (v @ q <= high).all() and (high - low).mean() < (high.max() - low.min())


URLS = [
    None, "", "no address", "://", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/1", "http://a.example.com/en/1?x#y", "http://example.com/EN/1", "http://www.example.com/de/", "http://x.www.example.com/en/",
    "http://notexample.com/en/", "http://com", "http://com/", "http://a.net/es/5", "http://a.net/fr", "http://net/fr/", "http://a.net/it/1", "http://spam.org", "http://spam.org/any/page?z", "http://sub.spam.org./x", "http://www.spam.org:80/", "http://u:p@spam.org/",
    "http://notspam.org/", "http://good.org/bad", "http://good.org/bad/", "http://good.org/bad/index.html?utm_source=a&ref=b", "http://good.org/bad/x", "http://good.org/list?b=2&a=1#top", "http://good.org/list?a=1&b=2&fbclid=9", "http://good.org/list?a=1", "x://y://z.net/es/", "http://ÄB.org/", "http://a.b.c.d.e.f.spam.org/",
    "http://good.org/" + "a/" * 30_000, "http://" + "h." * 5_000 + "net/es/", "http://a?b/net/es/", "http://a.net#/es/", "a://b.org/\nline",
]
LISTED = ["http://spam.org/", "https://good.org/bad", "http://good.org/list?b=2&a=1", "http://good.org/list?b=2&a=1", None, ""]


def canonical(url):
    import re

    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    query = (re.match(r"[^?#]*\?([^#]*)", rest) or ["", ""])[1]
    site = re.sub(r"^www\.", "", re.sub(r"\.+$", "", re.sub(r":(80|443)?$", "", re.sub(r"^.*@", "", host))))
    params = sorted(p for p in query.split("&") if p and not re.match(url_filter.TRACKING, p))
    return host, path, site, site and site + re.sub(r"/+(index\.(html?|php))?/*$", "", path) + ("?" + "&".join(params) if params else "")


def brute_verdict(url, listed, rules):
    host, path, site, address = canonical(url)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if fits:
        best = max(fits, key=lambda r: len(r[0] + r[1]))
        return host, path, best[0] + best[1], best[2]
    labels = site.split(".")
    keys = {address, site} | {".".join(labels[-k:]) for k in range(2, 6) if k < len(labels)}
    return host, path, None, "block" if site and keys & listed else "allow"


@pytest.mark.parametrize("sizes", [{}, {"per_block": 1}, {"broadcast_bytes": 0}])
def test_urls(spark, sizes):
    pages = spark.createDataFrame([(i % 30, u, "b", 1, "c") for i, u in enumerate([*URLS, *URLS[:9]])], "page_id long, url string, html string, block int, key string").repartition(3)
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    known = {canonical(u)[3] for u in LISTED} - {""}
    want = collections.Counter((i % 30, *brute_verdict(u, known, url_filter.RULES)) for i, u in enumerate([*URLS, *URLS[:9]]))
    got = url_filter.judge(pages, listed, **sizes)
    assert collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("EvalPython", "InArrow", "InPandas"))


def test_urls_many_listed(spark):
    """Thousands of listed addresses over many blocks: all of them are found, and the filter lets few others through."""
    listed = spark.range(6000).select(F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".org/p/"), "id").alias("url"))
    pages = spark.range(0, 24_000, 2).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.h"), F.col("id") % 50, F.lit(".org/p/"), "id", F.lit("/?ref=x")).alias("url"))
    got = url_filter.judge(pages, listed)
    assert got.where((F.col("verdict") == "block") != (F.col("page_id") < 6000)).count() == 0 and got.count() == 12_000
    keys = listed.select(url_filter.canonical(*url_filter.parts(F.col("url")))[1].alias("key"))
    asked = pages.select("page_id", url_filter.canonical(*url_filter.parts(F.col("url")))[1].alias("key"))
    passed = url_filter.possible(asked, keys, 6000)
    assert passed.where("page_id < 6000").count() == 3000 and passed.where("page_id >= 6000").count() < 180
    assert url_filter.judge(pages.limit(0), listed).count() == 0 and url_filter.judge(pages, listed.limit(0)).where("verdict = 'block'").count() == 0
