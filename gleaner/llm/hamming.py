"""Operator 9: exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has the signs of its dimensions. Rows with one code are one entry that carries its k + 1 smallest ids
(ties are broken by id, so no more can appear in an answer). A code is cut into segments, about as long as the number of
entries has bits, and the index has an entry once for each segment, in the bucket of the first bits of that segment's value.

Radii grow: at radius r a query asks, for each segment, for the values that differ from its own in exactly r bits. Where
these differ in the first bits they are in other buckets, so a query visits the buckets of its probes and no others. All codes below
distance segments * (r + 1) are then known, so a query is done as soon as its kth distance is below that bound. A bucket
that many codes share is cut by a hash of the code, and its queries go to all of its parts.

Queries are the rows whose id is divisible by ``every``; equal codes ask once. A row is not its own neighbour.

Cases: rows with a null id, a null or empty vector, or a null element are left out; with fewer than k other rows all of them are
the answer; an empty table gives no rows; ids listed twice with one code are one row; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed, ragged

BITS = 64


def coded(rows: DataFrame) -> DataFrame:
    """(id, code): bit i tells whether element i (beyond 64: the sum of elements i, i + 64, ...) is above 0."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    folded = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.aggregate(F.filter(v, lambda x, j: j % BITS == i), F.lit(0.0), lambda a, x: a + x))
    code = F.aggregate(F.transform(folded, lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return rows.where("vec_id IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL)").select(F.col("vec_id").cast("long").alias("id"), code.alias("code")).distinct()


def masks(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], dtype=np.uint64)


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of each segment."""
    cuts = [i * BITS // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def nearest_first(distance: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Places of all entries up to the distance where k rows are reached."""
    by = np.argsort(distance, kind="stable")
    reach = np.searchsorted(np.cumsum(weight[by]), k)
    return by if reach >= len(by) else by[distance[by] <= distance[by[reach]]]


def bucket_search(codes: np.ndarray, weights: np.ndarray, queries: np.ndarray, radius: int, low: int, bits: int, k: int) -> list[np.ndarray]:
    """For each query the entries that may be among its k nearest rows and differ from it in ``radius`` of ``bits`` bits from ``low`` on."""
    if bits < radius:
        return [np.zeros(0, dtype=np.int64)] * len(queries)
    cut = np.uint64((1 << bits) - 1)
    part = (codes >> np.uint64(low)) & cut
    own = (queries >> np.uint64(low)) & cut
    order = np.argsort(part, kind="stable")
    part = part[order]
    flips = masks(bits, radius) if comb(bits, radius) < 4 * len(codes) else None
    out = []
    for q, x in zip(queries, own, strict=True):
        if flips is None:  # more probes than entries: look at the entries instead
            found = order[np.bitwise_count(part ^ x) == radius]
        else:
            a, b = np.searchsorted(part, x ^ flips, side="left"), np.searchsorted(part, x ^ flips, side="right")
            has = np.flatnonzero(b > a)
            found = order[ragged(a[has], (b - a)[has])]
        keep = nearest_first(np.bitwise_count(codes[found] ^ q).astype(np.int64), weights[found], k)
        out.append(found[keep])
    return out


def search(rows: DataFrame, k: int = 10, every: int = 50, segments: int | None = None, bucket_entries: int = 1 << 14) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) for every query row: its k nearest other rows, by distance, then id."""
    spark = rows.sparkSession
    table = checkpointed(coded(rows))
    entries = checkpointed(table.groupBy("code").agg(F.count("*").alias("n")))
    first = Window.partitionBy("code", "salt").orderBy("id")
    again = Window.partitionBy("code").orderBy("id")
    ids = table.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    ids = ids.withColumn("r", F.row_number().over(again)).where(F.col("r") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = table.where(F.col("id") % every == 0)
    n_entries = entries.count()
    found = nearest(entries, n_entries, asked.select(F.col("code").alias("asked")).distinct(), k + 1, segments or max(2, min(8, BITS // max(8, n_entries.bit_length()))), bucket_entries)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, neighbor_id long, distance int")
    listed = found.join(ids, "code").select("asked", "distance", F.explode("ids").alias("neighbor_id"))
    best = Window.partitionBy("asked").orderBy("distance", "neighbor_id")
    best_list = listed.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    pairs = asked.select(F.col("id").alias("query_id"), F.col("code").alias("asked")).join(best_list, "asked").where("query_id <> neighbor_id")
    final = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def nearest(entries: DataFrame, n_entries: int, queries: DataFrame, k: int, segments: int, bucket_entries: int) -> DataFrame | None:
    """(asked, code, distance): of each query all entries up to the distance where k rows are reached; None without queries."""
    bounds = segment_bounds(segments)
    shared = max(0, (n_entries // bucket_entries).bit_length())  # first bits of a segment that tell its bucket
    shared = min(shared, min(bits for _, bits in bounds))

    def bucket(code: str, low: int, bits: int) -> Column:
        return F.shiftrightunsigned(F.col(code), low + bits - shared).bitwiseAND(F.lit((1 << shared) - 1))

    each = F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), bucket("code", *x).alias("bucket")) for i, x in enumerate(bounds)])).alias("at")
    index = entries.select("code", F.least("n", F.lit(k)).alias("n"), each).select("at.segment", "at.bucket", "code", "n")
    parts = None  # so few entries fit one part of each bucket
    if n_entries > 4 * bucket_entries:
        parts = checkpointed(index.groupBy("segment", "bucket").agg(F.ceil(F.count("*") / (4 * bucket_entries)).cast("int").alias("parts")))
        index = checkpointed(index.join(parts, ["segment", "bucket"]).select("segment", "bucket", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int").alias("part"), "code", "n"))
    else:
        index = index.withColumn("part", F.lit(0))
    active = checkpointed(queries)
    known = None
    closed = None

    def visit(radii: range) -> DataFrame:
        """(segment, bucket, part, asked, rest): the buckets of a query, and in how many of the other bits its values differ there."""
        flips = [(int(m), radius - j) for radius in radii for j in range(min(radius, shared) + 1) for m in masks(shared, j)]
        probes = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(rest).alias("rest")) for m, rest in flips]))
        own = F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), bucket("asked", *x).alias("own")) for i, x in enumerate(bounds)]))
        to = active.select("asked", own.alias("at")).select("asked", "at.*", probes.alias("probe")).select("asked", "segment", F.col("own").bitwiseXOR(F.col("probe.mask")).alias("bucket"), "probe.rest")
        if parts is None:
            return to.select("segment", "bucket", F.lit(0).alias("part"), "asked", "rest")
        return to.join(parts, ["segment", "bucket"]).select("segment", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "asked", "rest")

    def answer(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        codes, weights = mine["code"].to_numpy().view(np.uint64), mine["n"].to_numpy()
        asked, rest = theirs["asked"].to_numpy().view(np.uint64), theirs["rest"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(codes) and len(asked):
            low, bits = bounds[mine["segment"][0].as_py()]
            for r in np.unique(rest):
                here = asked[rest == r]
                hits = bucket_search(codes, weights, here, int(r), low, bits - shared, k)
                q, e = np.repeat(here, [len(x) for x in hits]), np.concatenate(hits)
                out.append((q, codes[e], weights[e]))
        q, c, n = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return pa.table({"asked": pa.array(q.view(np.int64)), "code": pa.array(c.view(np.int64)), "n": pa.array(n.astype(np.int64)), "distance": pa.array(np.bitwise_count(q ^ c).astype(np.int32))})

    keys = ["segment", "bucket", "part"]
    nearer = Window.partitionBy("asked").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
    widest = max(bits for _, bits in bounds)
    # the smallest radii, which probe fewer values than a third of a bucket's entries, are taken together
    first = 1
    while first < widest and 3 * sum(comb(widest, r) for r in range(first + 1)) <= n_entries >> shared:
        first += 1
    for radii in [range(first), *(range(r, r + 1) for r in range(first, widest + 1))]:
        if not active.limit(1).count():
            break
        met = index.groupBy(*keys).cogroup(visit(radii).groupBy(*keys)).applyInArrow(answer, "asked long, code long, n long, distance int")
        met = met if known is None else met.unionByName(known.join(active, "asked", "left_semi"))
        best = met.dropDuplicates(["asked", "code"]).withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).where(F.col("before") < k).drop("before")
        known = checkpointed(best)
        reached = known.groupBy("asked").agg(F.sum("n").alias("rows"), F.max("distance").alias("kth")).where((F.col("rows") >= k) & (F.col("kth") < segments * radii.stop))
        done = known.join(reached.select("asked"), "asked", "left_semi")
        closed = done if closed is None else closed.unionByName(done)
        active = checkpointed(active.join(reached.select("asked"), "asked", "left_anti"))
    if closed is None:
        return None
    return closed.unionByName(known.join(active, "asked", "left_semi")).select("asked", "code", "distance")
