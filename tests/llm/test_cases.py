"""Nulls in every column, empty and very long texts, ties, repeated rows, shared ids, empty tables, clashing names: all operators."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import fingerprint, hamming, jaccard, licenses, mixing, packing, pii, suffix_dedup, toxicity, tree_dedup
from tests.llm.test_operators import WORD

public_tokenizers = pytest.importorskip("public_tokenizers")
CLASHING = "sub string, chunk int, bucket int, node int, row int, key string, n int, part int, span int, size int, length int, piece int, score double, digest string, spans int, kind int, slot int, `a.b` int"
NONE_FIRST = -(2**63)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdéж") for _ in range(rng.randrange(1, 8))) for _ in range(500)]
    text = [" ".join(rng.choice(words) for _ in range(n)) for n in (60, 120, 200, 45, 80)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    return [
        (None, text[0], "s"), (None, text[1], None), (None, None, None), (1, text[2], "s"), (1, text[2], "s"), (1, text[2], "s"), (1, text[3] + " " + text[0], "t"),
        (2, text[2] + " end", None), (3, "", "s"), (4, None, "s"), (5, long, "u"), (6, "tail " + long[1000:90_000], "u"), (7, text[4], "s"), (8, text[4], "t"),
        (9, "Mail x@y.example.com", "s"), (10, " \t\n ", "t"), (11, "Released under the MIT License.", "s"), (12, "word", None),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [None if i % 3 else "x" for i in range(len(rows))]
    data = [(d, t, s, e, *(None if (i + k) % 4 else 7 for k in range(4)), "k", *[7] * 6, 0.5, "d", *[7] * 4) for i, ((d, t, s), e) in enumerate(zip(rows, extra, strict=True))]
    return spark.createDataFrame(data, f"doc_id long, text string, source string, {CLASHING}").repartition(4).cache()


@pytest.fixture(scope="module")
def ordered(spark, rows):
    """The different documents in order: nulls first, those of one id by the hash of their text."""
    different = sorted({(d, t or "") for d, t, _ in rows}, key=str)
    subs = {r.t: r.s for r in spark.createDataFrame([(t,) for _, t in different], "t string").select("t", F.xxhash64("t").alias("s")).collect()}
    return sorted(different, key=lambda x: (NONE_FIRST if x[0] is None else x[0], subs[x[1]]))


def listing(rows, of):
    return collections.Counter((d, *of[d, t or ""]) for d, t, _ in rows)


def test_suffix_dedup(docs, rows, ordered):
    seen, of = set(), {}
    for d, t in ordered:
        b = t.encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        of[d, t] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~gone])).hexdigest())
    got = suffix_dedup.remove_repeats(docs).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == listing(rows, of)


def test_tree_dedup(docs, rows, ordered):
    words = {k: WORD.findall(k[1]) for k in ordered}
    count = collections.Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    of = {}
    for k, w in words.items():
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = True
        of[k] = (len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in tree_dedup.remove_passages(docs).collect()) == listing(rows, of)


def test_fingerprints(docs, rows, ordered):
    follow = dict(zip(ordered, ordered[1:] + ordered[:1], strict=True))
    of = {}
    for d, t in ordered:
        k = len(t) // 4
        of[d, t] = (len(t), hashlib.sha256((t[: len(t) - k] + follow[d, t][1][:k]).encode()).hexdigest())
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.fingerprints(docs).collect()) == listing(rows, of)


def test_jaccard(docs, rows, ordered):
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w := WORD.findall(k[1])) > 2 else {tuple(w)} if w else set() for k in ordered}
    label = {k: i for i, k in enumerate(ordered)}
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * len(sets[a] | sets[b]) and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    of = {k: (len(sets[k]), ordered[label[k]][0]) for k in ordered}
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked(docs, 3, 90).collect()) == listing(rows, of)
    kept = jaccard.keep_one(docs, 3, 90)
    assert kept.columns == docs.columns and kept.count() == len({label[k] for k in ordered if sets[k]}) + sum(not sets[d, t or ""] for d, t, _ in rows)


def test_mixing(docs, rows):
    got = mixing.mixture(docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all() and got["size"].sum() == sum(len(WORD.findall(t or "")) for _, t, _ in rows)
    for source in {s for *_, s in rows}:
        total = sum(len(WORD.findall(t or "")) for _, t, s in rows if s == source)
        part = got[got.source_size == total]
        assert abs(part.taken.sum() - part.target.iloc[0]) < 2
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and sum(len(WORD.findall(r.text)) for r in mixed.collect()) == got.taken.sum()


def test_pii(docs, rows):
    got = pii.replaced(docs, "k").select("doc_id", "text").collect()
    want = collections.Counter((d, t) for d, t, _ in rows if d != 9)
    assert collections.Counter((r.doc_id, r.text) for r in got if r.doc_id != 9) == want and pii.replaced(docs, "k").columns == docs.columns
    assert [r.text for r in got if r.doc_id == 9][0] != rows[14][1]


def test_toxicity(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, i) for i in range(12)] + [(1, None, 0), (None, 1, 0), (2, 1, 5)], "doc_id long, toxic int, score int")
    got = toxicity.score(docs, labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and got[got.doc_id == 1].score.nunique() <= 2
    assert toxicity.keep_ordinary(docs, labels).columns == docs.columns
    assert toxicity.score(docs, labels.limit(0)).count() == len(rows)


def test_licenses(docs, rows):
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows) and [r.text_license for r in got if r.doc_id == 11] == ["MIT"] and len({r.digest for r in got if r.doc_id in (3, 4, 10)}) == 1
    assert all(r.n_license_lines == (r.doc_id == 11) for r in got)


def test_search(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.normal(size=8)], i, i, i) for i in range(60)] + [(5, None, 1, 1, 1), (61, [1.0, None], 1, 1, 1)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>, code int, rank int, n int").union(spark.createDataFrame(data[:3], "vec_id long, embedding array<double>, code int, rank int, n int"))
    got = hamming.search(vectors, k=5).toPandas()
    bits = {i: np.array(v) > 0 for i, v, *_ in data[:60]}  # eight signs: many ties
    for q in (0, 50):
        want = sorted((int((bits[q] != bits[i]).sum()), i) for i in bits if i != q)[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(zip(mine.distance, mine.neighbor_id, strict=True)) == want


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    want = collections.Counter()
    for d, t, _ in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((d, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    got = packing.pack(docs, path).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
