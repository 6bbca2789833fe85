"""Operator 2: fingerprints that are homomorphic multiset hashes of a text's paragraphs.

A paragraph is a line, cut further behind every word whose hash is a multiple of ``GRAIN``, so that an edit changes
only the paragraphs it touches. Each paragraph is hashed to a wide vector of plus and minus ones and a text's
fingerprint is the sum of its paragraphs' vectors modulo 2**16: the order does not matter, adding a paragraph adds its
vector and removing it subtracts it. The squared length of a difference estimates how many paragraphs two texts do not
share, so fingerprints of texts that differ also tell how alike they are.

The text that follows (ascending doc_id) sits in the same range of documents; the first document of each range is sent
to the range before as well. A range is sorted by the engine, which spills, and read as a stream, so ranges may be large and
their bounds are few; documents that share one doc_id are spread over ranges by a hash of their text.

Cases: a null or empty text has no paragraphs (the zero vector; two of them are alike, 1.0); the last document is
followed by the first, a single one by itself; an empty table gives no rows; rows with one doc_id are ordered by a hash of
their text; a row listed twice is one document, and each listing gets its result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import NULL_ID, chunk_count, documents_words, keyed, mix, power, powers, word_symbols

WIDTH = 128
GRAIN = 4
#: Bytes of text in a range, about, and texts that are worked on at once.
RANGE_BYTES, TOGETHER = 128 << 20, 128
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def paragraphs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each paragraph of the texts, and how many there are up to each text's end."""
    data, begin, end, ends = documents_words(pa.chunked_array([pa.array(texts, pa.large_string())]))
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    words = word_symbols(data, begin, end)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    cut = (words % np.uint64(GRAIN) == 0) | np.concatenate([breaks[begin[1:]] > breaks[end[:-1]], [True]])
    cut[ends[ends > 0] - 1] = True
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    up, down = powers(len(words) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:-1])])
    return mix((total[last + 1] - total[first]) * down[first] + (last - first).astype(np.uint64)), np.searchsorted(last, ends, side="left")


def vectors(texts: list[str]) -> np.ndarray:
    """The fingerprint of each text as WIDTH numbers modulo 2**16."""
    out = np.zeros((len(texts), WIDTH), dtype=np.uint16)
    hashes, ends = paragraphs(texts)
    starts = np.concatenate([[0], ends[:-1]])
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if a < b:
            seeds = hashes[a:b, None] + np.arange(1, WIDTH // 64 + 1, dtype=np.uint64)[None, :] * power(7)
            bits = np.unpackbits(mix(seeds).view(np.uint8).reshape(b - a, -1), axis=1)
            out[i] = (2 * bits.sum(axis=0, dtype=np.int64) - (b - a)).astype(np.uint16)
    return out


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints, row by row: about the shared paragraphs as a part of all."""

    def square(v):
        return (v.astype(np.int16).astype(np.float64) ** 2).sum(axis=1)

    both, apart = square(x) + square(y), square((x - y).astype(np.uint16))
    return np.where(both + apart > 0, np.clip((both - apart) / np.maximum(both + apart, 1), 0, 1), 1.0)


def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The fingerprint of both texts' paragraphs together; subtract() undoes it."""
    return (x + y).astype(np.uint16)


def subtract(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x - y).astype(np.uint16)


def bounds(rows: DataFrame, count: int) -> np.ndarray:
    """(doc_id, sub) where ranges begin, beyond the first: one pair a range. An id that fills several ranges is cut by sub, a uniform hash."""
    cuts = rows.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)] or [0.5], max(10_000, 20 * count))).first()[0] if count > 1 else None
    values, times = np.unique(np.array(cuts or [], dtype=np.int64), return_counts=True)
    out = []
    for v, k in zip(values.tolist(), times.tolist(), strict=True):
        out += [(v, -(2**63) + (2**64 // k) * i) for i in range(k)]
        if k > 1 and v < 2**63 - 1:
            out.append((v + 1, -(2**63)))
    return np.array(sorted(set(out)), dtype=[("doc_id", np.int64), ("sub", np.int64)])


def range_of(cuts: np.ndarray):
    """For ids and subs the range of each. Cuts of one id are few or evenly spaced, so a search by id is finished by a search by sub."""
    ids = cuts["doc_id"]

    def find(doc_id: np.ndarray, sub: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(ids, doc_id, side="left"), np.searchsorted(ids, doc_id, side="right")
        out = high.copy()
        for i in np.flatnonzero(high > low).tolist():
            out[i] = low[i] + np.searchsorted(cuts["sub"][low[i] : high[i]], sub[i], side="right")
        return out

    return find


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: fingerprints of the text and of its edited form, and the likeness to it and to the next document's."""
    rows = keyed(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    cuts = bounds(rows, chunk_count(docs, RANGE_BYTES))
    find = range_of(cuts)

    @F.pandas_udf("int")
    def range_no(ids, subs):
        import pandas as pd

        return pd.Series(find(ids.to_numpy(), subs.to_numpy()).astype(np.int32))

    least = rows.select(range_no("doc_id", "sub").alias("range"), F.struct("doc_id", "sub").alias("key")).groupBy("range").agg(F.min("key").alias("first"))
    firsts = sorted((r["range"], r["first"]["doc_id"], r["first"]["sub"]) for r in least.collect())  # one row a range
    before = {first[1:]: firsts[i - 1][0] for i, first in enumerate(firsts)}  # the first range's first follows the last range

    @F.pandas_udf("array<int>")
    def ranges_of(ids, subs):
        import pandas as pd

        own = find(ids.to_numpy(), subs.to_numpy())
        return pd.Series([[r] if (key := (i, s)) not in before else [r, -1 - before[key]] for i, s, r in zip(ids.tolist(), subs.tolist(), own.tolist(), strict=True)])

    dealt = rows.withColumn("to", F.explode(ranges_of("doc_id", "sub")))
    dealt = dealt.select(F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("range"), (F.col("to") < 0).alias("ahead"), "doc_id", "sub", "text")
    return dealt.repartitionById(len(cuts) + 1, "range").sortWithinPartitions("range", "ahead", "doc_id", "sub").mapInArrow(streamed, SCHEMA)


def streamed(batches):
    """Results of sorted ranges: a document waits until the one that follows it is known."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    ready: list[list] = []  # doc_id, how often it is listed, text, text that follows
    waiting: list = []  # range, doc_id, sub, how often, text

    def work(part: list[list]) -> pa.RecordBatch:
        texts, follow = [x[2] for x in part], [x[3] for x in part]
        edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, follow, strict=True)]
        v, e, f = vectors(texts), vectors(edited), vectors(follow)
        columns = [
            [None if x[0] == NULL_ID else x[0] for x in part],
            [len(t) for t in texts],
            [hashlib.sha256(x.encode()).hexdigest() for x in edited],
            [x.tobytes().hex() for x in v.astype(">u2")],
            [x.tobytes().hex() for x in e.astype(">u2")],
            near(v, e),
            near(v, f),
        ]
        again = np.repeat(np.arange(len(part)), [x[1] for x in part])
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema).take(pa.array(again))

    for batch in batches:
        for at, ahead, doc_id, sub, text in zip(*(batch[c].to_pylist() for c in ("range", "ahead", "doc_id", "sub", "text")), strict=True):
            if waiting and waiting[0] == at:
                if not ahead and waiting[1:3] == [doc_id, sub]:
                    waiting[3] += 1
                    continue
                ready.append([waiting[1], waiting[3], waiting[4], text])
            waiting = [] if ahead else [at, doc_id, sub, 1, text]
            if len(ready) >= TOGETHER:
                yield work(ready)
                ready = []
    if ready:
        yield work(ready)
