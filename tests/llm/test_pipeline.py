"""The pipeline against brute force, stage by stage, on a small table with nulls, copies, long texts and clashing names."""

import collections
import random
import zlib

import numpy as np
import pytest

from gleaner.llm import mixing, toxicity
from tests.llm.test_operators import WORD, brute_components

public_tokenizers = pytest.importorskip("public_tokenizers")
EXTRA = {"row": 1, "node": 2, "key": 3, "span": 4, "score": 5, "fakes": 6, "n": 7}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(260):
        text = [rng.choice(words) for _ in range(rng.choice([8, 30, 80, 150]))]
        if i % 6 == 0:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["vilest", "rotter"])
        if i % 9 == 1:
            text[3] = f"mail{i}@example.com"
        rows.append((i, " ".join(text[:5]) + "\n" + " ".join(text[5:]), f"s{i % 4}"))
        labels.append((i, 0, int(i % 6 == 0)))
    for i in range(40):  # near copies: one word of a long text changes
        parts = rows[i * 6 + 5][1].split(" ")
        parts[-1] = "changed"
        rows.append((1000 + i, " ".join(parts), "s1"))
    rows += [(2000, None, "s1"), (2001, "", None), (2002, rows[7][1], None), (None, "one lonely row without an id stands here", "s2"), (2003, " ".join(rng.choice(words) for _ in range(9000)), "s3"), rows[8]]
    path = tmp_path_factory.mktemp("sf")
    names = ["doc_id", "text", "lang", "source", "n_chars", *EXTRA]
    data = [(d, t, "en", s, len(t) if t is not None else None, *EXTRA.values()) for d, t, s in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA)).select(names).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = {}
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        out[name] = docs.toPandas()
        if name != P.STAGES[-1][0]:
            assert docs.columns == before.columns
            assert all((out[name][c] == x).all() for c, x in EXTRA.items())

    def keyed(frame):
        return [(None if d != d else int(d), t) for d, t in zip(frame.doc_id, frame.text, strict=True)]

    whole = keyed(spark.read.parquet(f"{folder}/documents.parquet").toPandas())
    scores = toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), labels).toPandas()
    rejected = {d for d, p in zip(scores.doc_id, scores.predicted, strict=True) if p == 1}
    kept = keyed(out["toxicity"])
    assert collections.Counter(kept) == collections.Counter(x for x in whole if x[0] not in rejected)
    toxic = {i for i in range(0, 260, 6)}
    assert len(rejected & toxic) > 0.9 * len(toxic) and len(rejected - toxic) < 5

    # rows of one id and text are one document; brute force wants ids, so the row without one gets a number of its own
    different = sorted({(-1 if d is None else d, t) for d, t in kept}, key=lambda x: x[0])
    component = brute_components([(d, t, None) for d, t in different], 5, 80)
    stay = {d for d in component if component[d][1] == d}
    assert sorted(-1 if d is None else d for d, _ in keyed(out["ngram_jaccard_join"])) == sorted(stay)

    plain, masked = dict(keyed(out["ngram_jaccard_join"])), dict(keyed(out["pii"]))
    assert plain.keys() == masked.keys()
    for d, t in plain.items():
        if t and "@" in t:
            mail = next(w for w in t.split() if "@" in w)
            assert mail not in masked[d] and len(masked[d]) == len(t) and masked[d].replace(next(w for w in masked[d].split() if "@" in w), mail) == t
        else:
            assert masked[d] == t

    taken = mixing.mixture(spark.read.parquet(str(tmp_path / "pii"))).toPandas()
    want = {(None if d != d else int(d)): n for d, n in zip(taken.doc_id, taken.taken, strict=True)}
    got = collections.Counter()
    for d, t in keyed(out["mixing"]):
        assert t in masked[d]  # a cut document has a stretch of its text, line breaks and all
        got[d] += len(WORD.findall(t))
    assert got == {d: n for d, n in want.items() if n}
    assert (out["mixing"].n_chars == out["mixing"].text.str.len()).all()

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = collections.Counter()
    for _, t in keyed(out["mixing"]):
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        pieces.update((k, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    packed = out["packing"]
    assert collections.Counter(zip(packed.piece, packed.length, packed.ids_crc32, strict=True)) == pieces
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    assert packed.sequence_id.nunique() <= -(-packed.length.sum() // 2048) * 1.05 + 2

    ran = P.run(spark, folder).toPandas()
    columns = ["doc_id", "piece", "length", "ids_crc32"]
    assert collections.Counter(map(str, ran[columns].itertuples(index=False))) == collections.Counter(map(str, packed[columns].itertuples(index=False)))


def test_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline as P

    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_entry_without_optional_parts(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    everything = set(entry.queries())
    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("gleaner.llm") or name == "gleaner.llm" or (name == "gleaner" and False):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", missing)
    left = set(entry.queries())
    assert left < everything and "page_report" in left and not any(n.startswith("op") for n in left) and "pipeline" not in left


def test_rounds_of_components_have_small_plans(spark, monkeypatch):
    """A plan that holds copies of the star before it costs the driver memory, whatever the input."""
    from gleaner.llm import common

    exchanges, plain = [], common.checkpointed

    def told(df, share=1):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return plain(df, share)

    monkeypatch.setattr(common, "checkpointed", told)
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, i) for i in range(101, 120)] + [(7, 7), (3, 2)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(40)} | {i: 100 for i in range(100, 120)}
    assert max(exchanges) <= 6, exchanges
