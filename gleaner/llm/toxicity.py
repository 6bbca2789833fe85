"""Operator 6: toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models, one of toxic and one of ordinary labelled texts, count how many different words stand
before an expression (so that copies of a text count once) and back off to their class's words and
from there to continuation counts that both classes share, so that a rare expression is smoothed alike in both. The
difference of the log-likelihoods, normalised by length, is taken over the whole text and over its most telling stretch
of 1 and of ``STRETCH`` words; a logistic curve, fitted on labelled rows that the models have not seen, turns the three
into a score.

Learning uses labelled rows with crc32(doc_id as text) mod 5 other than 0: mod 5 = 1 for the curve, the rest for the
models. The models count over all of their rows, so what is gathered grows with the input. The one bound: the curve's four
numbers are fitted on at most ``max_rows`` labelled rows, those with the smallest hash of doc_id. Expressions with fewer
than ``KEPT`` counts in both classes together leave their mass to their back-off.

Counting: tasks send the different (word two before, word before, word), packed, to the bucket of the word before (of that
and the word, where a sample of texts shows the word before to be frequent); the word two before is told apart by 16 bits and
its number corrected for clashes. The table of expressions (kind, key, two probabilities) is broadcast if it has at most
``broadcast_rows`` rows; beyond that chunks of documents ask it for the expressions that they have, by a join.
Scores use the text alone.

Cases: a null or empty text, or one without letters, is scored from zero evidence; without labelled rows of both
classes every score is the share of toxic labels (0 without labels); an empty table gives no rows; several labels of
one doc_id count as toxic if one is; a null doc_id has no label and isn't held out; rows listed twice score alike; extra columns
of any name are passed on by ``keep_ordinary`` and ignored by ``score``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed, chunk_count, mix, shuffle_partitions, spaced_buffer, word_symbols

STRETCH = 8
DISCOUNT = 0.75
KEPT = 3  # an expression behind fewer different words in both classes together is left to the back-off
SLICE_ROWS = 256
#: Words counted between two flushes of a task; labelled text per bucket; texts that show which words are frequent.
FLUSH, BUCKET_BYTES, SHOWN = 1_000_000, 8 << 20, 200
BROADCAST_ROWS = 4_000_000
WORD, CONTEXT, PAIR = 0, 1, 2
LETTER = np.zeros(256, dtype=bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[128:] = True


def words_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word (run of letters, lower case) of some texts, and the number of words up to each text's end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, offsets = spaced_buffer(pa.chunked_array([pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))]))
    letter = np.concatenate([[False], LETTER[data], [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    begin, end = edge[::2], edge[1::2]
    return word_symbols(data, begin, end), np.searchsorted(begin, offsets[1:], side="left")


START = np.uint64(1)


def bigrams(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The word before each word; a text's first word follows START."""
    before = np.concatenate([[START], words[:-1]]) if len(words) else words
    firsts = np.concatenate([[0], ends[:-1]])
    before[firsts[firsts < len(words)]] = START
    return before


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(3) + word)


def sent_expressions(buckets: int, frequent: np.ndarray):
    """The different (earlier, before, word, class) of texts, packed for the bucket that counts them."""
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def flush(parts):
        e, b, w, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((e, w, b, c))
        e, b, w, c = (x[order] for x in (e, b, w, c))
        new = np.concatenate([[True], (e[1:] != e[:-1]) | (w[1:] != w[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
        e, b, w, c = (x[new] for x in (e, b, w, c))
        to = bucket_of(b, w, buckets, frequent)
        order = np.argsort(to, kind="stable")
        e, b, w, c, to = (x[order] for x in (e, b, w, c, to))
        edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
        blobs = [zlib.compress(b"".join([b[i:j].tobytes(), w[i:j].tobytes(), e[i:j].tobytes(), c[i:j].tobytes()]), 1) for i, j in zip(edge[:-1], edge[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(to[edge[:-1]], pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    def send(batches):
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                words, ends = words_of(part["text"])
                if not len(words):
                    continue
                toxic = np.repeat(part["toxic"].to_numpy(zero_copy_only=False), np.diff(np.concatenate([[0], ends])))
                before = bigrams(words, ends)
                parts.append(((bigrams(before, ends) >> np.uint64(48)).astype(np.uint16), before, words, (toxic > 0).astype(np.uint8)))
                held += len(words)
                if held > FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return send


def bucket_of(before: np.ndarray, word: np.ndarray, buckets: int, frequent: np.ndarray) -> np.ndarray:
    spread = np.isin(before, frequent)
    return (mix(before + np.where(spread, word, np.uint64(0))) % np.uint64(buckets)).astype(np.int64)


def counted(table: pa.Table) -> pa.Table:
    """Counts of a bucket: for words and contexts what it adds to their sums, for expressions that are kept the whole count."""
    parts = []
    for blob in table["blob"]:
        raw = zlib.decompress(blob.as_py())
        n = len(raw) // 19
        parts.append((np.frombuffer(raw, "u8", n), np.frombuffer(raw, "u8", n, 8 * n), np.frombuffer(raw, "u2", n, 16 * n), np.frombuffer(raw, "u1", n, 18 * n)))
    b, w, e, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((e, c, w, b))
    b, w, e, c = (x[order] for x in (b, w, e, c))
    pair = np.concatenate([[True], (b[1:] != b[:-1]) | (w[1:] != w[:-1])])
    different = pair | np.concatenate([[True], (c[1:] != c[:-1]) | (e[1:] != e[:-1])])
    start = np.flatnonzero(pair)
    b, w = b[start], w[start]
    # of n different words some share their 16 bits; the mean number of words is taken from the number of values seen
    n = [-65536 * np.log1p(-np.minimum(np.add.reduceat((different & (c == k)).astype(np.int64), start), 65535) / 65536) for k in (0, 1)]
    n = [np.where(x < 16, np.rint(x), x) for x in n]
    kept = n[0] + n[1] >= KEPT
    mass = [np.where(kept, np.maximum(x - DISCOUNT, 0), 0.0) for x in (*n, n[0] + n[1])]
    contexts, at = np.unique(b, return_inverse=True)
    words, of = np.unique(w, return_inverse=True)
    rows = [
        (WORD, words, words, np.bincount(of), *(np.bincount(of, x > 0) for x in n)),
        (CONTEXT, contexts, contexts, np.bincount(at, kept), *(np.bincount(at, x) for x in n), *(np.bincount(at, x) for x in mass)),
        (PAIR, b[kept], w[kept], np.ones(kept.sum()), *(x[kept] for x in n)),
    ]
    columns = {"kind": np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).astype(np.int32)}
    for i, name in enumerate(("before", "word"), 1):
        columns[name] = np.concatenate([r[i] for r in rows]).view(np.int64)
    for i, name in enumerate(("n", "n0", "n1", "m0", "m1", "m"), 3):
        columns[name] = np.concatenate([np.asarray(r[i], dtype=np.float64) if i < len(r) else np.zeros(len(r[1])) for r in rows])
    return pa.table(columns)


class Model:
    """Sorted keys of known words, contexts and pairs with a number for ordinary and one for toxic texts each.

    Of a word: its probability without context; of a context: what it leaves to the back-off; of a pair: its own share.
    """

    def __init__(self, table: pa.Table, floor: list[float]):
        kind, keys = table["kind"].to_numpy(), table["key"].to_numpy().view(np.uint64)
        values = np.stack([table["p0"].to_numpy(), table["p1"].to_numpy()]).astype(np.float32)
        self.floor = floor

        def of(which: int):
            at = np.flatnonzero(kind == which)
            at = at[np.argsort(keys[at])]
            return keys[at], values[:, at]

        (self.words, self.single), (self.contexts, self.spare), (self.pairs, self.direct) = (of(k) for k in (WORD, CONTEXT, PAIR))

    def likelihoods(self, words: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
        """p(word | before) of every word, of ordinary and of toxic texts."""

        def find(sorted_, x):
            i = np.searchsorted(sorted_, x).clip(max=max(len(sorted_) - 1, 0))
            return i, (sorted_[i] == x if len(sorted_) else np.zeros(len(x), dtype=bool))

        w, known = find(self.words, words)
        v, context = find(self.contexts, before)
        p, pair = find(self.pairs, pair_key(before, words))
        out = []
        for c in (0, 1):
            value = np.full(len(words), self.floor[c])
            value[known] = self.single[c][w[known]]
            value[context] *= self.spare[c][v[context]]
            value[pair] += self.direct[c][p[pair]]
            out.append(value)
        return out

    def evidence(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log p(word | before, toxic) - log p(word | before, ordinary) of every word; a word that neither class knows tells nothing."""
        ordinary, toxic = (np.log(np.maximum(x, 1e-30)) for x in self.likelihoods(words, before))
        known = np.searchsorted(self.words, words).clip(max=max(len(self.words) - 1, 0))
        return np.where(self.words[known] == words, toxic - ordinary, 0.0) if len(self.words) else np.zeros(len(words))

    def features(self, column: pa.Array) -> np.ndarray:
        words, ends = words_of(column)
        n = np.diff(np.concatenate([[0], ends]))
        out = np.zeros((len(n), 3))
        if not len(words):
            return out
        gain = self.evidence(words, bigrams(words, ends))
        total = np.concatenate([[0.0], np.cumsum(gain)])
        starts = ends - n
        doc = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(words))
        stretch_end = np.minimum(place + STRETCH, ends[doc])
        stretch = (total[stretch_end] - total[place]) / STRETCH
        has = np.flatnonzero(n)
        out[has, 0] = (total[ends[has]] - total[starts[has]]) / n[has]
        out[has, 1] = np.maximum.reduceat(stretch, starts[has])
        out[has, 2] = np.maximum.reduceat(gain, starts[has])
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (the constant first) by Newton's method on standardised columns; a step that makes things worse is halved."""
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - middle) / scale])
    weight = ridge * np.array([0.0] + [1.0] * x.shape[1])

    def loss(beta: np.ndarray) -> float:
        z = a @ beta
        return float((np.logaddexp(0, z) - y * z).sum() + (weight * beta**2).sum() / 2)

    beta = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + np.diag(weight + 1e-9), a.T @ (y - p) - weight * beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    slopes = beta[1:] / scale
    return np.concatenate([[beta[0] - slopes @ middle], slopes])


def fold() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(-1))


def expressions(rows: DataFrame, buckets: int, frequent: np.ndarray) -> tuple[DataFrame, list[float]] | None:
    """(kind, key, p0, p1) of all expressions that are kept, and what an unknown word has; None without rows of both classes."""
    sent = rows.select("text", "toxic").mapInArrow(sent_expressions(buckets, frequent), "bucket int, blob binary")
    parts = checkpointed(sent.groupBy("bucket").applyInArrow(counted, "kind int, before long, word long, n double, n0 double, n1 double, m0 double, m1 double, m double"))
    sums = [F.sum(c).alias(c) for c in ("n", "n0", "n1", "m0", "m1", "m")]
    words = checkpointed(parts.where(F.col("kind") == WORD).groupBy("word").agg(*sums[:3]))
    known = F.col("n") >= KEPT
    one = words.agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.sum((~known).cast("long")).alias("rare"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("rare_n"), *(x for c in ("n0", "n1") for x in (F.sum(c).alias(c), F.sum(F.when(~known, F.col(c)).otherwise(0)).alias(f"rare_{c}"), F.sum((known & (F.col(c) > 0)).cast("long")).alias(f"seen_{c}")))).first()
    if not one["n0"] or not one["n1"]:
        return None
    every = one["n"] + 0.5 * (one["words"] + 1)  # the shared back-off: half a count more for every word and for an unseen one
    left = [(DISCOUNT * one[f"seen_{c}"] + one[f"rare_{c}"]) / one[c] for c in ("n0", "n1")]
    unseen = (one["rare_n"] + 0.5 * (one["rare"] + 1)) / every / (one["rare"] + 1)
    single = [F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / one[c] + x * (F.col("n") + 0.5) / every for c, x in zip(("n0", "n1"), left, strict=True)]
    contexts = parts.where(F.col("kind") == CONTEXT).groupBy("before").agg(*sums)
    # what a class leaves goes to the counts of both classes together, and what these leave to the class's words
    spare = [F.when(F.col(c) > 0, 1 - F.col(m) / F.greatest(c, F.lit(1.0))).otherwise(1.0) for c, m in (("n0", "m0"), ("n1", "m1"))]
    every_n = F.col("n0") + F.col("n1")
    contexts = checkpointed(contexts.where("n > 0").select("before", "n0", "n1", *(x.alias(s) for x, s in zip(spare, ("s0", "s1"), strict=True)), (1 - F.col("m") / every_n).alias("shared"), every_n.alias("every")))
    pairs = parts.where(F.col("kind") == PAIR).select("before", "word", F.col("n0").alias("p0"), F.col("n1").alias("p1")).join(contexts, "before")
    shared = F.greatest(F.col("p0") + F.col("p1") - DISCOUNT, F.lit(0.0)) / F.col("every")
    pairs = pairs.select("before", "word", *((F.greatest(F.col(p) - DISCOUNT, F.lit(0.0)) / F.greatest(c, F.lit(1.0)) + F.col(x) * shared).alias(p) for p, c, x in (("p0", "n0", "s0"), ("p1", "n1", "s1"))))

    def keys(batches):
        for batch in batches:
            before, word, p0, p1 = batch.columns
            key = pair_key(before.to_numpy().view(np.uint64), word.to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), PAIR, dtype=np.int32)), pa.array(key.view(np.int64)), p0.cast(pa.float32()), p1.cast(pa.float32())], names=["kind", "key", "p0", "p1"])

    schema = "kind int, key long, p0 float, p1 float"
    table = words.where(known).select(F.lit(WORD).alias("kind"), F.col("word").alias("key"), *(x.cast("float").alias(p) for x, p in zip(single, ("p0", "p1"), strict=True)))
    table = table.union(contexts.select(F.lit(CONTEXT), "before", *((F.col(x) * F.col("shared")).cast("float") for x in ("s0", "s1")))).union(pairs.mapInArrow(keys, schema))
    return checkpointed(table), [x * unseen for x in left]


def frequent_words(rows: DataFrame, buckets: int) -> np.ndarray:
    """Words that a few texts show to be frequent. Only the dealing of work depends on them, no count does."""
    shown = rows.select(F.substring("text", 1, 20_000).alias("text")).limit(SHOWN).toArrow()["text"]
    words = words_of(shown)[0] if len(shown) else np.zeros(0, dtype=np.uint64)
    values, n = np.unique(words, return_counts=True)
    return values[n * 4 * buckets > len(words)]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, broadcast_rows: int = BROADCAST_ROWS):
    """(model or None, table or None, floor, coefficients): from all labelled rows outside the held-out fold.

    The model is None where the table has more than ``broadcast_rows`` rows, and both are without labelled rows of both classes.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = checkpointed(marks.withColumn("fold", fold()).where("fold <> 0"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def labelled(some: DataFrame) -> DataFrame:
        some = some.select("doc_id", "toxic")
        return texts.join(F.broadcast(some) if n_marks <= broadcast_rows else some, "doc_id")

    n_marks, toxic = marks.agg(F.count("*"), F.avg("toxic")).first()
    share = toxic or 0.0
    flat = np.array([np.log(max(share, 1e-6) / max(1 - share, 1e-6)), 0.0, 0.0, 0.0])
    rows = labelled(marks.where("fold <> 1"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not total:
        return None, None, None, flat
    buckets = int(min(max(shuffle_partitions(docs.sparkSession), total // BUCKET_BYTES), 1 << 16))
    found = expressions(rows, buckets, frequent_words(rows, buckets))
    if not found:
        return None, None, None, flat
    table, floor = found
    model = Model(table.toArrow(), floor) if table.count() <= broadcast_rows else None  # bounded by the count just taken
    curve = checkpointed(marks.where("fold = 1").orderBy(F.xxhash64("doc_id")).limit(max_rows))
    measured = measures(labelled(curve).select("doc_id", "text", "toxic"), ["toxic"], model, table, floor)
    seen = measured.toArrow()  # at most max_rows rows of four numbers, and as many again for each row listed twice
    y = seen["toxic"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return model, table, floor, flat
    return model, table, floor, logistic(np.column_stack([seen[c].to_numpy() for c in FEATURES]), y)


FEATURES = ["whole_gain", "stretch_gain", "word_gain"]


def measures(rows: DataFrame, names: list[str], model: Model | None, table: DataFrame | None, floor) -> DataFrame:
    """The columns ``names`` of rows with a column ``text``, and the three features of it."""
    schema = rows.select(names).schema
    for c in FEATURES:
        schema = schema.add(c, "double")

    def measured(part, used: Model | None):
        x = used.features(part["text"]) if used else np.zeros((part.num_rows, 3))
        return [*(part[c] for c in names), *(pa.array(x[:, i]) for i in range(3))]

    if model or table is None:

        def rate(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    yield pa.RecordBatch.from_arrays(measured(batch.slice(at, SLICE_ROWS), model), names=[*names, *FEATURES])

        return rows.mapInArrow(rate, schema)

    chunks = chunk_count(rows)
    chunk = F.pmod(F.xxhash64("text", F.monotonically_increasing_id() % 64), F.lit(chunks)).cast("int")
    dealt = checkpointed(rows.withColumn("chunk_no", chunk))

    def asked(here: pa.Table) -> pa.Table:
        keys: list[set] = [set(), set(), set()]
        for at in range(0, here.num_rows, SLICE_ROWS):
            words, ends = words_of(here["text"].slice(at, SLICE_ROWS))
            before = bigrams(words, ends) if len(words) else words
            for kind, x in ((WORD, words), (CONTEXT, before), (PAIR, pair_key(before, words))):
                keys[kind].update(np.unique(x).view(np.int64).tolist())
        n = [len(k) for k in keys]
        return pa.table({"chunk_no": pa.array([here["chunk_no"][0].as_py()] * sum(n), pa.int32()), "kind": pa.array(np.repeat([WORD, CONTEXT, PAIR], n).astype(np.int32)), "key": pa.array([x for k in keys for x in k], pa.int64())})

    wanted = dealt.select("chunk_no", "text").groupBy("chunk_no").applyInArrow(asked, "chunk_no int, kind int, key long")
    answers = wanted.join(table, ["kind", "key"]).select(F.col("chunk_no").alias("answer_no"), "kind", "key", "p0", "p1")

    def rate_chunk(here: pa.Table, known: pa.Table) -> pa.Table:
        if not here.num_rows:
            return pa.table({c: here[c] for c in names} | {c: pa.array([], pa.float64()) for c in FEATURES})
        used = Model(known, floor)
        out = [measured(here.slice(at, SLICE_ROWS).combine_chunks(), used) for at in range(0, here.num_rows, SLICE_ROWS)]
        return pa.concat_tables(pa.Table.from_arrays(x, names=[*names, *FEATURES]) for x in out)

    return dealt.groupBy("chunk_no").cogroup(answers.groupBy("answer_no")).applyInArrow(rate_chunk, schema)


def scored(docs: DataFrame, labels: DataFrame, max_rows: int, broadcast_rows: int) -> DataFrame:
    """(row, text, score): of each row its other columns as a struct, so that no name of them can clash, and its text."""
    model, table, floor, beta = fit(docs, labels, max_rows, broadcast_rows)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), F.col("text").cast("string").alias("text"))
    value = F.lit(float(beta[0]))
    for c, b in zip(FEATURES, beta[1:], strict=True):
        value = value + F.col(c) * float(b)
    value = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), value))
    return measures(rows, ["row", "text"], model, table, floor).select("row", "text", (1 / (1 + F.exp(-value))).alias("score"))


def score(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, max_rows, broadcast_rows)
    return rows.select("row.doc_id", "score").select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that are not predicted to be toxic, with their columns."""
    kept = scored(docs, labels, max_rows, broadcast_rows).where("score < 0.5")
    return kept.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
