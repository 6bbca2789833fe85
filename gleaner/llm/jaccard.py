"""Operator 3: documents linked by the Jaccard similarity of their word n-grams, as a grouped prefix join.

A document's shingles are ordered rare first: by how common their words are together (from a count sketch of words, of
fixed size, which tells rare shingles from common ones at any size of the input, as a table of shingle counts of fixed size
could not), then by hash; any fixed order gives right results. Two sets that reach the threshold share one of the first n - ceil(threshold * n) + 1 shingles. Steps:

1. *survey*: the count sketch, and how many documents have each smallest hash; only hashes with more than 1/2000 of all
   documents (so at most 2000 of them) are told to the tasks, which salt them.
2. *cluster*: documents go to the bucket of their smallest hash. There equal sets collapse to one, similar ones are
   linked, and documents with identical prefix and size become one group of a local cluster. Groups send prefixes.
3. *bridge*: clusters that share a prefix shingle are compared by one document each, in a star per shingle and, for shingles of
   many clusters, in rings of bounded size whose neighbours must have fitting sketches. This joins the parts of large
   clusters, so that step 4 has few pairs left.
4. *join*: groups of different components that share a prefix shingle are candidates if sizes, positions and, for shingles of
   many groups, parity sketches allow the threshold; their members are expanded and verified on the full sets. A parity sketch tells for each of
   SKETCH slots whether an odd number of shingles fall into it. Sketches of two sets differ in at most as many slots as the
   sets do in shingles, so the filter never drops a pair that reaches the threshold.

No step leaves out a candidate of different components, so components are exact; pairs inside a known component are
not looked at. Only documents that are part of a candidate pair are sent for verification.

Cases: null and empty texts have no shingles and are linked with nothing; a text of fewer than ``words`` words is one
shingle; an empty table gives no rows; rows listed twice are in one component and each is returned; rows with one doc_id and
different texts are different documents; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import LOWER, NULL_ID, ODD, checkpointed, chunk_count, components, grams, keyed, mix, release, spaced_buffer, word_bounds, word_symbols

SLOTS = 1 << 20
BLOCK = 1 << 14
#: The largest table of documents to verify that is broadcast, and how many pairs of one document go to one bucket, about.
BROADCAST_ROWS, FAN = 1 << 20, 256
SLICE_ROWS = 256
HOT = 2000
#: Shingles of so many clusters get rings; a ring has about RING of them, each held against its LAGS predecessors.
CROWD, RING, LAGS = 16, 1024, 6
#: Slots of a parity sketch, and the largest set that has one: of larger ones most slots are odd or even by chance.
SKETCH = 1 << 10
SKETCHED = 2 * SKETCH
#: Shuffle partitions of a table of links that go to one task.
LINKS = 4
#: Groups of one shingle in a block; each pair of blocks is compared by a task of its own.
BLOCK_ROWS = 4096
#: Parts in which the rows of a component look up its smallest document.
SPREAD = 16
ROW = "kind int, key long, a long, b long, n int, blob binary, bits array<long>"


def salt_of(n: int) -> np.uint64:
    return np.uint64((n * int(ODD)) & (2**64 - 1))


def worded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of some texts, in lower case, and the number of words up to each text's end."""
    data, offsets = spaced_buffer(pa.chunked_array([column]) if isinstance(column, pa.Array) else column)
    data = LOWER[data]
    begin, end = word_bounds(data)
    return word_symbols(data, begin, end), np.searchsorted(begin, offsets[1:], side="left")


def shingles(column: pa.Array, words: int) -> list[np.ndarray]:
    """The hashes of each text's distinct shingles."""
    return distinct_shingles(*worded(column), words)


def distinct_shingles(symbols: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    full = mix(grams(symbols, words) + salt_of(words))
    out, at = [], 0
    for stop in ends.tolist():
        n = stop - at
        if n >= words:
            out.append(np.unique(full[at : stop - words + 1]))
        elif n:
            out.append(mix(grams(symbols[at:stop], n) + salt_of(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at = stop
    return out


def slot_of(symbols: np.ndarray) -> np.ndarray:
    return (symbols >> np.uint64(44)).astype(np.int64)


def ranked_shingles(column: pa.Array, words: int, level: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Of each text the smallest hash and the distinct shingles in order, each as a number: how common its words are, then its hash."""
    symbols, ends = worded(column)
    full = mix(grams(symbols, words) + salt_of(words))
    common = np.concatenate([[0], np.cumsum(level[slot_of(symbols)], dtype=np.int64)])
    out, at = [], 0
    for stop in ends.tolist():
        n = stop - at
        if not n:
            out.append((0, np.zeros(0, dtype=np.uint64)))
            continue
        k = min(n, words)
        own = np.unique(full[at : stop - words + 1], return_index=True) if n >= words else (mix(grams(symbols[at:stop], n) + salt_of(n)), np.zeros(1, dtype=np.int64))
        place = own[1] + at
        rank = np.minimum((common[place + k] - common[place]) // k, 255).astype(np.uint64)
        out.append((int(own[0][0]), np.sort((rank << np.uint64(56)) | (own[0] >> np.uint64(8)))))
        at = stop
    return out


def prefix_size(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def parity(s: np.ndarray) -> np.ndarray:
    """The parity sketch of a set of ranked shingles, as 64-bit words."""
    return np.packbits(np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).view(np.uint64)


def differing(x: np.ndarray, y: np.ndarray) -> int:
    return int(np.bitwise_count(x ^ y).sum())


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.searchsorted(large, small).clip(max=len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def survey(docs: DataFrame, words: int) -> tuple[np.ndarray, dict[int, int]]:
    """(level of each slot of the sketch, number of salts for each hot smallest hash)."""

    def count(batches):
        total = np.zeros(SLOTS, dtype=np.uint32)
        smallest: list[int] = []
        schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])

        def keys():
            values, n = np.unique(np.array(smallest, dtype=np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), dtype=np.int32)), pa.array(values.view(np.int64)), pa.array(n), pa.nulls(len(n), pa.binary())], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                symbols, ends = worded(batch.slice(at, SLICE_ROWS)["text"])
                np.add.at(total, slot_of(symbols), np.uint32(1))
                smallest += [int(s[0]) for s in distinct_shingles(symbols, ends, words) if len(s)]
            if len(smallest) > 200_000:
                yield keys()
                smallest.clear()
        if smallest:
            yield keys()
        blocks = [b for b in range(SLOTS // BLOCK) if total[b * BLOCK : (b + 1) * BLOCK].any()]
        if blocks:
            blobs = [zlib.compress(total[b * BLOCK : (b + 1) * BLOCK].tobytes(), 1) for b in blocks]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(blocks), pa.int32()), pa.array(blocks, pa.int64()), pa.nulls(len(blocks), pa.int64()), pa.array(blobs, pa.binary())], schema=schema)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, dtype=np.uint64)
        for blob in table["blob"]:
            total += np.frombuffer(zlib.decompress(blob.as_py()), dtype=np.uint32)
        level = np.rint(6 * np.log2(total + np.uint64(1))).clip(max=255).astype(np.uint8)
        return pa.table({"key": table["key"][:1], "level": pa.array([level.tobytes()], pa.binary())})

    seen = checkpointed(keyed(docs).select("text").mapInArrow(count, "kind int, key long, n long, blob binary"))
    level = np.zeros(SLOTS, dtype=np.uint8)
    for row in seen.where("kind = 0").select("key", "blob").groupBy("key").applyInArrow(add, "key long, level binary").collect():  # SLOTS bytes in all
        level[row["key"] * BLOCK : (row["key"] + 1) * BLOCK] = np.frombuffer(row["level"], dtype=np.uint8)
    own = seen.where("kind = 1")
    rows = own.agg(F.sum("n")).first()[0] or 0
    hot = max(64, rows // HOT)
    salts = {r["key"]: -(-r["n"] // hot) for r in own.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot).collect()}  # fewer than HOT rows
    return level, salts


def link(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first of its local cluster; a set is held against the first and the last of the newest clusters."""
    first = list(range(len(sets)))
    clusters: list[list[int]] = []
    for i, s in enumerate(sets):
        for c in reversed(clusters[-8:]):
            if similar(s, sets[c[0]], percent) or c[-1] != c[0] and similar(s, sets[c[-1]], percent):
                first[i] = first[c[0]]
                c.append(i)
                break
        else:
            clusters.append([i])
    return first


def clustered(docs: DataFrame, level: np.ndarray, salts: dict[int, int], buckets: int, words: int, percent: int) -> DataFrame:
    """Rows by kind. 0: a document (a: node, b: doc_id, n: shingles). 1: a link (a, b). 2: prefixes for a bucket of
    shingles (key, blob). 3: a member (b) of a group (a). 4: the sketch (bits) of the first member (a) of a group, and in
    how many slots at most others of the group differ from it (n)."""

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                to = []
                for s, node in zip(shingles(part["text"], words), part["node"].to_pylist(), strict=True):
                    key = int(s.min()) if len(s) else node & (2**63 - 1)
                    signed = key - (1 << 64) if key >= 1 << 63 else key
                    salt = node % salts[signed] if signed in salts else 0
                    to.append(int(mix(np.array([key], dtype=np.uint64) + salt_of(salt))[0] % np.uint64(buckets)))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), part["node"], part["doc_id"], part["text"]], names=["bucket", "node", "doc_id", "text"])

    def cluster(table: pa.Table) -> pa.Table:
        nodes, ids = table["node"].to_numpy(), table["doc_id"].to_pylist()
        rows: list[tuple] = []
        sets: dict[int, np.ndarray] = {}
        by_set: dict[bytes, int] = {}
        keys: dict[int, list[int]] = {}
        for at in range(0, table.num_rows, SLICE_ROWS):
            for i, (smallest, s) in enumerate(ranked_shingles(table["text"].slice(at, SLICE_ROWS).combine_chunks(), words, level), at):
                node = int(nodes[i])
                rows.append((0, None, node, ids[i], len(s), None, None))
                if not len(s):
                    continue
                whole = s.tobytes() if len(s) < 8 else np.array([len(s), mix(s).sum(dtype=np.uint64), mix(s * ODD).sum(dtype=np.uint64)], dtype=np.uint64).tobytes()
                head = by_set.setdefault(whole, node)
                if head != node:
                    rows.append((1, None, node, head, None, None, None))
                elif node not in sets:
                    sets[node] = s
                    keys.setdefault(smallest, []).append(node)
        o, h, r, n, p = ([] for _ in range(5))
        for members in keys.values():
            members.sort(key=lambda x: (len(sets[x]), x))
            first = link([sets[x] for x in members], percent)
            groups: dict[tuple, int] = {}
            sketches: dict[int, tuple[np.ndarray, int]] = {}
            for x, f in zip(members, first, strict=True):
                rep = members[f]
                if rep != x:
                    rows.append((1, None, x, rep, None, None, None))
                s = sets[x]
                k = prefix_size(len(s), percent)
                head = groups.setdefault((rep, len(s), s[:k].tobytes()), x)
                rows.append((3, None, head, x, None, None, None))
                if len(s) <= SKETCHED:
                    bits = parity(s)
                    known, slack = sketches.get(head, (bits, 0))
                    sketches[head] = known, max(slack, differing(known, bits))
                if head == x:
                    o.append(s[:k])
                    h.append(np.full(k, x))
                    r.append(np.full(k, rep))
                    n.append(np.full(k, len(s)))
                    p.append(np.arange(k))
            rows += [(4, None, head, None, slack, None, bits.view(np.int64).tolist()) for head, (bits, slack) in sketches.items()]
        if o:
            o, h, r, n, p = (np.concatenate(c) for c in (o, h, r, n, p))
            to = (mix(o) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((o, to))
            o, h, r, n, p, to = (c[order] for c in (o, h, r, n, p, to))
            edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                blob = b"".join([o[i:j].tobytes(), h[i:j].tobytes(), r[i:j].tobytes(), n[i:j].astype(np.int32).tobytes(), p[i:j].astype(np.int32).tobytes()])
                rows.append((2, int(to[i]), None, None, int(j - i), zlib.compress(blob, 1), None))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["kind", "key", "a", "b", "n", "blob", "bits"])

    rows = noded(docs).mapInArrow(route, "bucket int, node long, doc_id long, text string")
    return rows.groupBy("bucket").applyInArrow(cluster, ROW)


def noded(docs: DataFrame) -> DataFrame:
    return keyed(docs).select(F.xxhash64("doc_id", "sub").alias("node"), "doc_id", "text")


def shared_prefixes(sent: DataFrame) -> DataFrame:
    """(shingle, head, rep, n, pos, ...) of every prefix shingle that two clusters have; all entries of a shingle are in one bucket.

    lead: the entry stands for its cluster at this shingle; m: how many clusters have it; hub, hub_n, hub_pos: the first of
    them, on the leading entries of the others.
    """

    def read(table: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[] for _ in range(5)]
        for blob, n in zip(table["blob"], table["n"].to_pylist(), strict=True):
            raw = zlib.decompress(blob.as_py())
            for i, (kind, width, at) in enumerate((("u8", 8, 0), ("i8", 8, 8), ("i8", 8, 16), ("i4", 4, 24), ("i4", 4, 28))):
                parts[i].append(np.frombuffer(raw, dtype=kind, count=n, offset=at * n))
        o, h, r, n, p = (np.concatenate(x) for x in parts)
        order = np.lexsort((h, r, o))
        o, h, r, n, p = (x[order] for x in (o, h, r, n, p))
        new = np.concatenate([[True], o[1:] != o[:-1]])
        lead = new | np.concatenate([[True], r[1:] != r[:-1]])
        start = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        clusters = np.add.reduceat(lead.astype(np.int64), start)
        keep = np.flatnonzero(clusters[which] > 1)
        hub = start[which[keep]]
        other = pa.array(~(lead[keep] & ~new[keep]))  # where there is no hub to name
        names = {"shingle": o.view(np.int64), "head": h, "rep": r, "n": n, "pos": p}
        columns = {c: pa.array(x[keep]) for c, x in names.items()} | {"lead": pa.array(lead[keep]), "m": pa.array(clusters[which[keep]].astype(np.int32))}
        columns |= {c: pa.array(x[hub], mask=np.asarray(other)) for c, x in (("hub", h), ("hub_n", n), ("hub_pos", p))}
        return pa.table(columns)

    return sent.where("kind = 2").select("key", "n", "blob").groupBy("key").applyInArrow(read, "shingle long, head long, rep long, n int, pos int, lead boolean, m int, hub long, hub_n int, hub_pos int")


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """The pairs (a, b) of nodes whose documents reach the threshold.

    A pair goes to the bucket of its end with more pairs, so that a text is sent once to all that it is held against there;
    an end with many pairs has several buckets.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("k"))
    many = pairs.join(ends.select(F.col("x").alias("a"), F.col("k").alias("ka")), "a").join(ends.select(F.col("x").alias("b"), F.col("k").alias("kb")), "b")
    hub, spoke = F.when(F.col("ka") >= F.col("kb"), F.col("a")).otherwise(F.col("b")), F.when(F.col("ka") >= F.col("kb"), F.col("b")).otherwise(F.col("a"))
    salt = F.pmod(F.xxhash64(spoke), F.ceil(F.greatest("ka", "kb") / FAN))
    dealt = checkpointed(many.select("a", "b", F.pmod(F.xxhash64(hub, salt), F.lit(buckets)).alias("bucket")), LINKS)
    needed = dealt.select(F.col("bucket").alias("place"), F.explode(F.array("a", "b")).alias("node")).distinct()
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)  # of a size just checked; larger ones are joined by shuffling
    texts = noded(docs).select("node", "text").join(needed, "node").select("place", "node", "text")

    def check(pairs_here: pa.Table, texts_here: pa.Table) -> pa.Table:
        node, first = np.unique(texts_here["node"].to_numpy(), return_index=True)
        sets: list[np.ndarray] = []
        for at in range(0, len(first), SLICE_ROWS):
            sets += shingles(texts_here["text"].take(pa.array(first[at : at + SLICE_ROWS])).combine_chunks(), words)
        a, b = (np.searchsorted(node, pairs_here[c].to_numpy()) for c in "ab")
        good = [i for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if similar(sets[x], sets[y], percent)]
        return pairs_here.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return dealt.groupBy("bucket").cogroup(texts.groupBy("place")).applyInArrow(check, "a long, b long")


def fits(percent: int, places: bool = True, y: str = "y") -> F.Column:
    """Whether sizes, and the places of a shared shingle that is the first one, allow x and y to reach the threshold."""
    sizes = F.least("x.n", f"{y}.n") * 100 >= F.greatest("x.n", f"{y}.n") * percent
    if not places:
        return sizes
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return sizes & (room * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n")))


def sketches_fit(percent: int, y: str = "y") -> F.Column:
    """Whether the parity sketches of x and y, where both have one, allow members of these groups to reach the threshold.

    Sets that reach it differ in at most (100 - percent) / (100 + percent) of the sum of their sizes. Sketches of members
    differ in no fewer slots than those of the first ones do, less the slack of both groups.
    """
    slots = [F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(SKETCH // 64)]
    apart = sum(slots[1:], slots[0]) - F.col("x.slack") - F.col(f"{y}.slack")
    return F.coalesce(apart * (100 + percent) <= (F.col("x.n") + F.col(f"{y}.n")) * (100 - percent), F.lit(True))


def ringed(shared: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of heads near each other in the rings of a shingle; the order differs from shingle to shingle.

    A ring is a part of a shingle's clusters, dealt by hash, so that no task holds all of a frequent shingle.
    """
    each = shared.where(F.col("lead") & (F.col("m") >= CROWD)).select("shingle", "rep", "head", "n", "m").join(sketches, "head", "left").withColumn("place", F.xxhash64("rep", "shingle"))
    order = Window.partitionBy("shingle", F.pmod("place", F.ceil(F.col("m") / RING))).orderBy("place")
    entry = F.struct("head", "n", "bits", "slack")
    near = each.select(entry.alias("x"), *(F.lag(entry, i).over(order).alias(f"y{i}") for i in range(1, LAGS + 1)))
    fit = [F.when(F.col(f"{y}.head").isNotNull() & fits(percent, False, y) & sketches_fit(percent, y), F.col(f"{y}.head")) for y in (f"y{i}" for i in range(1, LAGS + 1))]
    return near.select(F.col("x.head").alias("a"), F.explode(F.array_compact(F.array(*fit))).alias("b"))


def least_shared(percent: int) -> F.Column:
    """How many shingles the prefixes of x and y share at least if they reach the threshold.

    With an overlap of o, the first n - o + k shingles of both sets share k; prefixes have n - ceil(threshold * n) + 1.
    """
    overlap = F.ceil(percent * (F.col("x.n") + F.col("y.n")) / (100 + percent))
    spare = [overlap - F.ceil(percent * F.col(c) / 100) + 1 for c in ("x.n", "y.n")]
    return F.greatest(F.lit(1), F.least(*spare))


def linked(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, and first: whether the row is the one of its component to keep.

    The kept one is the row with the smallest doc_id (then the smallest hash); without links every row is kept.
    """
    docs = docs.select("doc_id", "text")
    level, salts = survey(docs, words)
    buckets = chunk_count(docs)
    rows = checkpointed(clustered(docs, level, salts, buckets, words, percent))
    links = rows.where("kind = 1").select("a", "b")
    shared = checkpointed(shared_prefixes(rows))

    entries = shared.where("hub IS NOT NULL").select(F.struct(F.col("hub").alias("head"), F.col("hub_n").alias("n"), F.col("hub_pos").alias("pos")).alias("x"), F.struct("head", "n", "pos").alias("y"))
    # a hub may not be the same for all shingles, so half of what a similar pair shares is asked for; step 4 needs no luck
    starred = entries.where(fits(percent)).groupBy(F.col("x.head").alias("a"), F.col("y.head").alias("b")).agg(F.count("*").alias("n"), F.min(least_shared(percent)).alias("least")).where("2 * n >= least").select("a", "b")
    sketches = rows.where("kind = 4").select(F.col("a").alias("head"), "bits", F.col("n").alias("slack"))
    bridges = checkpointed(starred.union(ringed(shared, sketches, percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), LINKS)
    bridged = checkpointed(verified(docs, bridges, words, percent, buckets))
    known = checkpointed(components(links.union(bridged)), LINKS)
    release(docs.sparkSession)

    place = shared.join(known, shared["rep"] == known["id"], "left").select("shingle", "head", "n", "pos", F.coalesce("component", "rep").alias("component"))
    mixed = place.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).where("low <> high").select("shingle", "m")
    place = checkpointed(place.join(mixed, "shingle"))

    def meet(of: DataFrame, *more: F.Column) -> DataFrame:
        holds = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") < F.col("y.component")) & fits(percent, False)
        for condition in more:
            holds &= condition
        return of.alias("x").join(of.alias("y"), holds).select(F.col("x.head").alias("p"), F.col("y.head").alias("q"), least_shared(percent).alias("least"), fits(percent).alias("fits"))

    # few groups make few pairs, so only the groups of crowded shingles carry their sketches along
    crowded = place.where(F.col("m") >= CROWD).join(sketches, "head", "left")
    # groups of a very frequent shingle are dealt to blocks, and each pair of blocks meets in a task of its own
    blocks = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
    crowded = crowded.withColumn("own", F.pmod(F.xxhash64("head"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    groups = meet(place.where(F.col("m") < CROWD)).union(meet(crowded, F.col("x.own") == F.col("y.other"), F.col("x.other") == F.col("y.own"), sketches_fit(percent)))
    groups = groups.groupBy("p", "q").agg(F.count("*").alias("n"), F.min("least").alias("least"), F.max("fits").alias("fits")).where("n >= least AND fits").select("p", "q")
    members = rows.where("kind = 3").select(F.col("a").alias("head"), F.col("b").alias("node"))
    expanded = groups.join(members.select(F.col("head").alias("p"), F.col("node").alias("a")), "p").join(members.select(F.col("head").alias("q"), F.col("node").alias("b")), "q").select("a", "b").distinct()
    expanded = checkpointed(expanded, LINKS)
    joined = checkpointed(verified(docs, expanded, words, percent, buckets))
    release(docs.sparkSession)
    classes = components(links.union(bridged).union(joined))

    nodes = rows.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("doc_id"), F.col("n").alias("n_shingles"))
    placed = checkpointed(nodes.join(classes, nodes["node"] == classes["id"], "left").select("doc_id", "node", "n_shingles", "component"))
    # a component may hold a third of all rows, so it is joined in SPREAD parts; rows without links need no join
    together = placed.where("component IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("node", "doc_id"), F.lit(SPREAD)))
    smallest = together.groupBy("component", "part").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("o"), "doc_id", "node")).alias("least")).groupBy("component").agg(F.min("least").alias("least"))
    smallest = smallest.select("component", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("part"))
    found = together.join(smallest, ["component", "part"]).select("doc_id", "node", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("node") == F.col("least.node")).alias("first"))
    alone = placed.where("component IS NULL").select("doc_id", "node", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return found.unionByName(alone).withColumn("n_shingles", F.col("n_shingles").cast("long"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component (and every document without shingles), with its columns.

    Cases: rows without shingles (null and empty texts) all stay; of rows with one doc_id and text one stays; a null doc_id is
    the smallest, so such a row is the one kept of its component; columns of any name are passed on; an empty table gives no rows.
    """
    kept = linked(docs, words, percent).where("first OR n_shingles = 0").select("node", (F.col("n_shingles") == 0).alias("bare")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("node"))
    only = whole.join(kept, "node")
    once = only.where("NOT bare").groupBy("node").agg(F.first("row").alias("row"))
    return once.select("row").union(only.where("bare").select("row")).select("row.*")
