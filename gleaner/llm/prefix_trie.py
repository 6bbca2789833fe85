"""Operator 11: the trie of conversations' prefixes, as mergeable tables of nodes.

A conversation c is rebuilt: the first h turns of conversation c - c % 100, then its own turns after its first h, with h =
crc32(decimal c) % 6. A node is a depth and a 128-bit hash of the turns up to it, the sum of hash(turn i) * B**i, so that stretches
of a conversation are hashed apart and put together: rows are sorted by ranges over all tasks, each task hashes its stretch,
and the few stretches of conversations that go over the edge of a range are told what is before them. No task needs a
whole conversation, and texts are hashed where they are read.

Every task first combines its own rows to a partial trie, a table of nodes with members, ends and smallest member; these are merged
by hash twice, salted and then whole, so that a node of most conversations is summed in many tasks. Nodes of one member need
nothing more: they are the ends of branches. For the others figures are rolled up from the ends:

A conversation owns the nodes whose smallest member it is, the last stretch of its path. Below a node, its members' last nodes
that are owned and have no children are the leaves. What a subtree saves is, for each member that isn't the smallest, the length of
its path from the node to the last node that it doesn't own: (members - 1) times the text, summed over nodes, is the same sum by
members. So both are sums over members of one figure a conversation, and no round a level is needed, however deep the trie.

The ends of a node are ids in order, hashed as one string. They are sorted by ranges over all tasks, joined to pieces, and the pieces
of a node are read by one task as a stream; SHA-256 allows no other way, and memory stays small.

Cases: rows with a null conv_id take no part; a null role or text is empty; turns of one number are ordered by a hash of role and
text; a turn listed twice is two turns; c % 100 has the sign of c; a conversation without turns left is a member of the root only;
an empty table gives no rows, not even the root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import BASE, checkpointed, power, powers, shuffle_partitions

#: The most turns that a conversation takes from another one.
HEAD = 5
SALTS = 16
#: Ids that a piece of a list of ends has at most.
PIECE = 512
NODE = ["depth", "key1", "key2"]
ROW = "conv long, pid int, k long, s1 long, s2 long, t1 long, t2 long, chars long, upto long"
PLACED = "conv long, at long, depth long, key1 long, key2 long, parent1 long, parent2 long, chars long, upto long, ends boolean"


def turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashed = [F.xxhash64(F.lit(i), role, text).alias(f"h{i}") for i in (1, 2)]
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", *hashed, F.length(text).cast("long").alias("chars"))


def unsigned(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy().view(np.uint64) if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False).view(np.uint64)


def hashed(batches):
    """Of each row of a sorted stretch: its place in the stretch's run of its conversation, and sums over the run up to it."""
    last, count, sums, chars = None, 0, (np.uint64(0), np.uint64(0)), 0
    for batch in batches:
        conv = batch["conv"].to_numpy()
        n = len(conv)
        if not n:
            continue
        first = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
        starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        carried = ~np.logical_or.accumulate(first)  # rows that go on with the batch before
        step = np.arange(n) - starts + 1
        up, _ = powers(int(step.max()) + 1)
        ahead = np.where(carried, power(count), np.uint64(1)).astype(np.uint64)
        out = [conv, batch["pid"].to_numpy(), step + np.where(carried, count, 0)]
        keys, terms = [], []
        for lane, before in (("h1", sums[0]), ("h2", sums[1])):
            term = unsigned(batch[lane]) * up[step] * ahead
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term)])
            keys.append(total[1:] - total[starts] + np.where(carried, before, np.uint64(0)))
            terms.append(term)
        size = batch["chars"].to_numpy()
        total = np.concatenate([[0], np.cumsum(size)])
        upto = total[1:] - total[starts] + np.where(carried, chars, 0)
        last, count, sums, chars = conv[-1], int(out[2][-1]), (keys[0][-1], keys[1][-1]), int(upto[-1])
        out += [x.view(np.int64) for x in (*keys, *terms)] + [size, upto]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if i == 1 else x) for i, x in enumerate(out)], names=[x.split(" ")[0] for x in ROW.split(", ")])


def before(runs: pa.Table) -> pa.Table:
    """For each run of one conversation, in order, how many turns are before it and what they sum up to."""
    runs = runs.sort_by("pid")
    count, sums, chars, out = 0, [0, 0], 0, []
    for r in runs.to_pylist():
        out.append((r["conv"], r["pid"], count, *(x - (1 << 64) if x >= 1 << 63 else x for x in sums), chars))
        ahead = pow(BASE, count, 1 << 64)
        sums = [(x + ahead * r[s]) % (1 << 64) for x, s in zip(sums, ("s1", "s2"), strict=True)]
        count, chars = count + r["k"], chars + r["upto"]
    names = ["conv", "pid", "n0", "b1", "b2", "c0"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
    return pa.table({name: pa.array(column, kind) for name, column, kind in zip(names, zip(*out, strict=True), kinds, strict=True)})


def raised(exponents: np.ndarray) -> np.ndarray:
    """BASE**e for whole numbers of either sign."""
    known, where = np.unique(exponents, return_inverse=True)
    return np.array([pow(BASE, int(e), 1 << 64) for e in known], dtype=np.uint64)[where]


def placed(batches):
    """Rows with what is before their run, and how their conversation is rebuilt (own turns after the first h, behind m turns of another), as nodes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n0, k, h, m = (batch[c].to_numpy() for c in ("n0", "k", "h", "m"))
        ahead, shift = raised(n0), raised(m - h)
        keys, parents = [], []
        for i in "12":
            head, own, start = (unsigned(batch[c + i]) for c in ("head", "own", "b"))
            key = head + shift * (start + ahead * unsigned(batch["s" + i]) - own)
            keys.append(key)
            parents.append(key - shift * ahead * unsigned(batch["t" + i]))
        upto = batch["head_chars"].to_numpy() + batch["c0"].to_numpy() + batch["upto"].to_numpy() - batch["own_chars"].to_numpy()
        columns = [batch["conv"].to_numpy(), n0 + k, m + n0 + k - h, *[x.view(np.int64) for x in (*keys, *parents)], batch["chars"].to_numpy(), upto, n0 + k == batch["n"].to_numpy()]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split(" ")[0] for x in PLACED.split(", ")])


def members(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each conversation and node below the root that it is a member of, one row for each conversation)."""
    order = ["conv", F.col("turn").asc_nulls_first(), "h1", "h2"]
    slim = turns(conversations)
    sorted_ = slim.repartitionByRange(shuffle_partitions(slim.sparkSession), *order).sortWithinPartitions(*order)
    rows = checkpointed(sorted_.select("conv", F.spark_partition_id().alias("pid"), "h1", "h2", "chars").mapInArrow(hashed, ROW))
    runs = rows.groupBy("conv", "pid").agg(F.max(F.struct("k", "s1", "s2", "upto")).alias("last")).select("conv", "pid", "last.*")
    # a range has one run at most that goes on from the range before, so this table has two rows a range at most
    several = runs.withColumn("runs", F.count("*").over(Window.partitionBy("conv"))).where("runs > 1").drop("runs")
    offsets = checkpointed(several.groupBy("conv").applyInArrow(before, "conv long, pid int, n0 long, b1 long, b2 long, c0 long"))
    zero = F.lit(0).cast("long")
    known = ["n0", "b1", "b2", "c0"]
    begun = rows.join(F.broadcast(offsets), ["conv", "pid"], "left").select(*[F.col(c) for c in rows.columns], *[F.coalesce(c, zero).alias(c) for c in known])
    plain = [zero.alias(c) for c in ("n", "h", "m", "head1", "head2", "head_chars", "own1", "own2", "own_chars")]
    firsts = begun.where((F.col("k") <= HEAD) & (F.col("n0") < HEAD)).select("*", *plain).mapInArrow(placed, PLACED).where(F.col("at") <= HEAD)
    heads = firsts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("depth"), "key1", "key2", "parent1", "parent2", "chars", "upto"))).alias("head"))
    own = checkpointed(runs.groupBy("conv").agg(F.sum("k").alias("n")).join(heads, "conv"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (HEAD + 1)
    bases = own.where(F.col("conv") % 100 == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))
    starts = own.select("conv", "n", "head", h.cast("long").alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base")).join(bases, "base", "left")
    starts = starts.withColumn("m", F.least("h", F.coalesce("base_n", zero)))

    def at(head: str, n: str, name: str) -> Column:
        return F.coalesce(F.when(F.col(n) > 0, F.get(F.col(head), F.col(n).cast("int") - 1)[name]), zero)

    starts = starts.select("conv", "n", "h", "m", *[at("base_head", "m", f"key{i}").alias(f"head{i}") for i in "12"], at("base_head", "m", "upto").alias("head_chars"), *[at("head", "h", f"key{i}").alias(f"own{i}") for i in "12"], at("head", "h", "upto").alias("own_chars"), F.slice("base_head", F.lit(1), F.col("m").cast("int")).alias("taken"))
    starts = checkpointed(starts)
    behind = begun.join(starts.drop("taken"), "conv").where(F.col("n0") + F.col("k") > F.col("h")).mapInArrow(placed, PLACED)
    taken = starts.select("conv", "n", "h", "m", F.explode("taken").alias("x")).select("conv", "x.*", ((F.col("x.depth") == F.col("m")) & (F.col("n") <= F.col("h"))).alias("ends"))
    return checkpointed(behind.drop("at").unionByName(taken)), starts.select("conv", "n", "h", "m")


def merged(partial: DataFrame, by: list) -> DataFrame:
    """Tables of nodes put together: counts are summed, the smallest ids stay, and what all agree in is taken from one."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_ends")] + [F.min(c).alias(c) for c in ("conv", "end")]
    return partial.groupBy(*by).agg(*sums, *[F.first(c).alias(c) for c in ("parent1", "parent2", "chars", "upto")])


def nodes(member_rows: DataFrame) -> DataFrame:
    one = member_rows.select(*NODE, "parent1", "parent2", "chars", "upto", "conv", F.lit(1).cast("long").alias("n_convs"), F.col("ends").cast("long").alias("n_ends"), F.when(F.col("ends"), F.col("conv")).alias("end"), F.pmod(F.xxhash64("conv"), F.lit(SALTS)).alias("salt"))
    return merged(merged(one, [*NODE, "salt"]), NODE)


def pieces(batches):
    """Runs of one node's ids in a sorted stretch, as decimal numbers joined by commas."""
    for batch in batches:
        keys = np.stack([batch[c].to_numpy() for c in NODE], axis=1)
        ids = batch["conv"].to_numpy()
        if not len(ids):
            continue
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = np.concatenate([np.arange(a, b, PIECE) for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)] + [[len(ids)]]).astype(int)
        begin = bounds[:-1]
        text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(begin, bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*[pa.array(keys[begin, i]) for i in range(3)], pa.array(ids[begin]), pa.array(text)], names=[*NODE, "least", "ids"])


def digested(batches):
    """SHA-256 of each node's pieces, which come sorted; one node's state is held at a time."""
    node, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in node], pa.array([digest.hexdigest()])], names=[*NODE, "ends_sha256"])

    for batch in batches:
        for *key, ids in zip(*[batch[c].to_pylist() for c in NODE], batch["ids"].to_pylist(), strict=True):
            if key != node:
                if node:
                    yield done()
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if node:
        yield done()


def digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) for ``ends`` (node, conv)."""
    parts = shuffle_partitions(ends.sparkSession)
    order = [*NODE, "conv"]
    cut = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pieces, "depth long, key1 long, key2 long, least long, ids string")
    return cut.repartition(parts, *NODE).sortWithinPartitions(*NODE, "least").mapInArrow(digested, "depth long, key1 long, key2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    rows, facts = members(conversations)
    known = checkpointed(nodes(rows))
    shared = known.where("n_convs > 1")
    n_convs, least, turnless = facts.agg(F.count("*"), F.min("conv"), F.count_if((F.col("m") == 0) & (F.col("n") <= F.col("h")))).first()

    above = shared.select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("conv").alias("above"))
    linked = checkpointed(known.where("depth > 1").join(above, ["depth", "parent1", "parent2"], "left").unionByName(known.where("depth = 1").withColumn("above", F.lit(least).cast("long"))))
    kids = linked.where("above IS NOT NULL AND depth > 1").groupBy("depth", "parent1", "parent2").agg(F.count("*").alias("n_children"))
    kids = kids.select((F.col("depth") - 1).alias("depth"), F.col("parent1").alias("key1"), F.col("parent2").alias("key2"), "n_children")

    of_node = shared.select(*NODE, F.col("conv").alias("owner"), "n_convs", "n_ends")
    met = checkpointed(rows.select("conv", *NODE, "chars", "upto", "ends").join(of_node, NODE))
    foreign = F.col("owner") != F.col("conv")
    each = met.groupBy("conv").agg(F.coalesce(F.max(F.when(foreign, F.col("upto"))), F.lit(0)).alias("foreign"), F.max((F.col("ends") & (foreign | (F.col("n_ends") < F.col("n_convs")))).cast("long")).alias("no_leaf"))
    each = checkpointed(each)
    figures = met.join(each, "conv").groupBy(*NODE).agg(F.sum(1 - F.col("no_leaf")).alias("n_leaves"), F.sum(F.when(foreign, F.col("foreign") - F.col("upto") + F.col("chars")).otherwise(0)).alias("saved_tokens"))
    root = [F.lit(0).cast("long").alias(c) for c in NODE]
    ended = digests(met.where("ends AND n_ends > 1").select(*NODE, "conv").unionByName(facts.where("m = 0 AND n <= h").select(*root, "conv")))
    ended = checkpointed(ended)

    more = shared.select(*NODE).join(kids, NODE, "left").join(figures, NODE, "left").join(ended, NODE, "left")
    lone = F.col("n_convs") == 1
    none = F.sha2(F.lit(""), 256)
    digest = F.when(F.col("n_ends") == 0, none).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string").cast("binary"), 256)).otherwise(F.col("ends_sha256"))
    out = linked.join(more, NODE, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.coalesce("above", "conv").alias("parent_conv_id"), "n_convs",
        F.when(lone, 1 - F.col("n_ends")).otherwise(F.coalesce("n_children", F.lit(0))).alias("n_children"),
        F.when(lone, F.lit(1)).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), F.when(lone, F.lit(0)).otherwise(F.col("saved_tokens")).cast("long").alias("saved_tokens"), digest.alias("ends_sha256"),
    )
    if not n_convs:
        return out
    below = known.where("depth = 1").agg(F.count("*").alias("n_children"))
    sums = each.agg(F.coalesce(F.sum("foreign"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.sum("no_leaf"), F.lit(0)).alias("no_leaf"))
    n_children, saved, no_leaf = below.first()[0], *sums.first()
    leaves = n_convs - turnless - no_leaf if n_children else 1
    values = {"conv_id": least, "parent_conv_id": None, "n_convs": n_convs, "n_children": n_children, "n_leaves": leaves, "saved_tokens": saved}
    top = spark.range(1).select(*root, *[F.lit(v).cast("long").alias(c) for c, v in values.items()]).join(ended, NODE, "left")
    return out.unionByName(top.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")))


def oracle() -> str:
    """The same rows in SQL by plain definitions: every prefix as text, members and subtrees by joins. Ties of turn numbers are not met."""
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda x, b: xor(xor(x, b) >> 1, (xor(x, b) & 1) * 3988292384)))"
    return f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS depth, md5(concat(length(role), ':', role, text)) AS turn, length(text) AS chars FROM r),
w AS (SELECT conv_id, depth, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, chars FROM d UNION ALL SELECT conv_id, 0, '', 0 FROM c),
m AS (SELECT conv_id, depth, md5(path) AS node, chars, lag(md5(path)) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM w),
n AS (SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM n GROUP BY parent),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
b AS (SELECT DISTINCT a.node AS above, x.node FROM m a JOIN m x ON a.conv_id = x.conv_id AND a.depth <= x.depth),
s AS (SELECT above AS node, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens FROM b JOIN f ON b.node = f.node GROUP BY above)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256 FROM f JOIN s ON f.node = s.node LEFT JOIN n q ON f.parent = q.node"""
