"""Operator 12: hard negatives of anchors within a window of scores, by a vector-approximation file.

Components become whole numbers, so scores (inner products) are exact. Every dimension is cut into cells at quantiles of all
rows; a row's approximation has one byte a dimension, its cell. For an anchor a table holds, for each dimension and cell, the
least and the most that a component of that cell adds to the score, both in one 64-bit number. Looking the cells up and adding
gives a lower and an upper bound of every row's score, and only rows that may enter an answer are scored exactly:

1. positives: of the anchor's label, rows whose upper bound reaches the kth largest lower bound;
2. negatives: of other labels, rows whose bounds meet the window of a positive's score and whose upper bound reaches the kth
   largest lower bound of those that are in the window for certain.

Rows are dealt into blocks by a hash of their id, as many as there are tasks at least, anchors too, and each pair of blocks is one
group of bounded size that returns its k best; of these the k best of all are taken. So anchors meet all rows in blocks, and nothing
grows with a label, a vector or a row that many share: copies have equal bounds and are told apart by their ids.

Cases: rows with a null id, label or vector, or a null or non-finite component, take no part; vectors that are shorter than
others count as filled with zeros, an empty one is all zeros; rows that agree in id, label and vector are one; different rows of
one id are different rows, but none is the other's positive or negative, and each is an anchor if its id says so; equal scores
are ordered by id, then label; scores that don't fit 64 bits are an error; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed, shuffle_partitions

CELLS = 64
ROWS, ANCHORS = 1 << 14, 1 << 10
#: Rows whose approximations are looked up at once, so that sums stay in a core's cache.
STRIP = 1 << 12
ANSWER = "anchor long, row long, positive_id long, positive_score long, negative_id long, negative_label int, negative_score long"


def whole(rows: DataFrame, scale: int = 256, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """(id, label, v): the rows that take part, with whole components and the labels of some of them shifted."""
    x = F.transform("embedding", lambda e: F.floor(scale * e.cast("double")))
    good = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(CAST(e AS DOUBLE)) < double('infinity'))")
    label = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.where(good).select(F.col("vec_id").cast("long").alias("id"), label.cast("int").alias("label"), x.alias("v")).distinct()


def cells(table: DataFrame, count: int = CELLS) -> np.ndarray:
    """edges[d, c]: the least component of cell c in dimension d; the last column is beyond the most. One row a dimension comes to the driver.

    A quantile of the rows is a guess at good cells; any edges give right bounds, as the outer ones are the least and the most.
    """
    each = table.select(F.posexplode("v").alias("d", "x"))
    cut = [c / count for c in range(1, count)]
    found = each.groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", cut, 4 * count).alias("cut"), F.count("*").alias("n")).orderBy("d").collect()
    edges = np.zeros((len(found), count + 1), dtype=np.int64)
    for r in found:
        # shorter vectors are filled with zeros
        edges[r.d, 0], edges[r.d, 1:-1], edges[r.d, -1] = min(r.low, 0), r.cut, max(r.high, 0) + 1
        np.clip(edges[r.d, 1:-1], edges[r.d, 0], edges[r.d, -1], out=edges[r.d, 1:-1])
    return edges


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows of whole numbers, short ones filled with zeros."""
    lists = column.combine_chunks()
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    size = np.diff(offsets)
    out = np.zeros((len(lists), dims), dtype=np.int64)
    at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)
    out[np.repeat(np.arange(len(lists)), size), at] = flat
    return out


class Approximations:
    """A block of rows: their cells by dimension, and their exact vectors for those that are asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, edges: np.ndarray):
        order = np.lexsort((ids, labels))  # rows of one label stand together
        self.ids, self.labels, self.vectors, self.edges = ids[order], labels[order], vectors[order], edges
        self.cells = np.ascontiguousarray(np.stack([np.searchsorted(edges[d, 1:-1], self.vectors[:, d], side="right") for d in range(len(edges))]).astype(np.uint8)) if len(edges) else np.zeros((0, len(ids)), np.uint8)

    def bounds(self, query: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that the score of each row from begin to end can be."""
        a, b = query[:, None] * self.edges[:, :-1], query[:, None] * (self.edges[:, 1:] - 1)
        low, high = np.minimum(a, b), np.maximum(a, b)
        base = low.min(axis=1, initial=0)
        if (high - base[:, None]).max(axis=1, initial=0).sum() >= 1 << 31:  # both don't fit one number
            return self.looked_up(low, begin, end), self.looked_up(high, begin, end)
        both = self.looked_up((high - base[:, None] << 32) + (low - base[:, None]), begin, end)
        return (both & 0xFFFFFFFF) + base.sum(), (both >> 32) + base.sum()

    def looked_up(self, table: np.ndarray, begin: int, end: int) -> np.ndarray:
        out = np.zeros(end - begin, dtype=np.int64)
        for at in range(begin, end, STRIP):
            strip = slice(at, min(end, at + STRIP))
            total = out[strip.start - begin : strip.stop - begin]
            for row, cell in zip(table, self.cells, strict=True):
                total += row[cell[strip]]
        return out

    def best(self, query: np.ndarray, places: np.ndarray, k: int, low: int | None = None, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best of some rows by exact score, within low and high: places and scores."""
        score = self.vectors[places] @ query
        if low is not None:
            keep = (score >= low) & (score <= high)
            places, score = places[keep], score[keep]
        order = np.lexsort((self.labels[places], self.ids[places], -score))[:k]
        return places[order], score[order]


def reaching(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Which upper bounds reach the kth largest lower bound."""
    return high >= np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else np.ones(len(high), dtype=bool)


def positives_of(block: Approximations, query: np.ndarray, own: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.searchsorted(block.labels, [label, label + 1])
    places = np.arange(a, b)
    low, high = block.bounds(query, a, b)
    other = block.ids[a:b] != own
    places, low, high = places[other], low[other], high[other]
    return block.best(query, places[reaching(low, high, k)], k)


def negatives_of(block: Approximations, query: np.ndarray, own: int, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores its k best rows of other labels."""
    a, b = np.searchsorted(block.labels, [label, label + 1])
    places = np.concatenate([np.arange(a), np.arange(b, len(block.ids))])
    (low1, high1), (low2, high2) = block.bounds(query, 0, a), block.bounds(query, b, len(block.ids))
    low, high = np.concatenate([low1, low2]), np.concatenate([high1, high2])
    other = block.ids[places] != own
    out = []
    for least, most in windows:
        meets = np.flatnonzero(other & (high >= least) & (low <= most))
        inside = meets[(low[meets] >= least) & (high[meets] <= most)]
        if len(inside) >= k:
            reach = low[inside]
            meets = meets[high[meets] >= np.partition(reach, len(reach) - k)[len(reach) - k]]
        out.append(block.best(query, places[meets], k, least, most))
    return out


def window_of(score: int, least: int, most: int) -> tuple[int, int]:
    """The whole scores s with least * score <= 100 * s <= most * score."""
    return -(-least * score // 100), most * score // 100


def mine(rows: DataFrame, every: int = 100, positives: int = 5, k: int = 10, least: int = 30, most: int = 90, block_rows: int = ROWS, block_anchors: int = ANCHORS, count: int = CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor, a row whose id is divisible by ``every``."""
    table = checkpointed(whole(rows))
    n, n_anchors, reach = table.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max(F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    if (reach or 0) >= 2**62:
        raise ValueError("scores of these vectors do not fit 64 bits")
    edges = cells(table, count)
    dims = len(edges)
    parts, crowds = max(shuffle_partitions(rows.sparkSession), -(-n // block_rows)), max(1, -(-n_anchors // block_anchors))
    rows_ = table.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("long").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(crowds - 1))).alias("crowd"), "id", "label", "v")
    anchors = table.where(F.col("id") % every == 0).withColumn("row", F.xxhash64("label", "v"))

    def dealt(asked: DataFrame) -> DataFrame:
        return asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.pmod(F.xxhash64("id", "row"), F.lit(crowds)).cast("int").alias("crowd"), *[F.col(c).alias(f"own_{c}") for c in asked.columns])

    def block(mine: pa.Table) -> Approximations:
        return Approximations(mine["id"].to_numpy(), mine["label"].to_numpy(), matrix(mine["v"], dims), edges)

    def table_of(out: list[tuple]) -> pa.Table:
        names = [x.split(" ")[0] for x in ANSWER.split(", ")]
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.table({name: pa.array(np.concatenate(c) if c else [], pa.int32() if name == "negative_label" else pa.int64()) for name, c in zip(names, columns, strict=True)})

    def line(a: int, row: int, p: int, score: int, own: Approximations, at: np.ndarray, scores: np.ndarray) -> tuple:
        same = [np.full(len(at), x, dtype=np.int64) for x in (a, row, p, score)]
        return (*same, own.ids[at], own.labels[at], scores)

    def first(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        if len(mine) and len(theirs):
            own = block(mine)
            for a, row, label, query in zip(theirs["own_id"].to_pylist(), theirs["own_row"].to_pylist(), theirs["own_label"].to_pylist(), matrix(theirs["own_v"], dims), strict=True):
                out.append(line(a, row, 0, 0, own, *positives_of(own, query, a, label, positives)))
        return table_of(out)

    def second(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        if len(mine) and len(theirs):
            own = block(mine)
            for a, row, label, found, query in zip(theirs["own_id"].to_pylist(), theirs["own_row"].to_pylist(), theirs["own_label"].to_pylist(), theirs["own_found"].to_pylist(), matrix(theirs["own_v"], dims), strict=True):
                hits = negatives_of(own, query, a, label, [window_of(p["score"], least, most) for p in found], k)
                out += [line(a, row, p["id"], p["score"], own, *hit) for p, hit in zip(found, hits, strict=True)]
        return table_of(out)

    keys = ["part", "crowd"]
    nearest = Window.partitionBy("anchor", "row").orderBy(F.desc("negative_score"), "negative_id", "negative_label")
    near = rows_.groupBy(*keys).cogroup(dealt(anchors).groupBy(*keys)).applyInArrow(first, ANSWER)
    near = near.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= positives)
    found = near.groupBy("anchor", "row").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("negative_id").alias("id"), F.col("negative_score").alias("score")))).alias("found"))
    asked = checkpointed(anchors.join(found, (F.col("id") == F.col("anchor")) & (anchors["row"] == found["row"])).select("id", anchors["row"], "label", "v", "found"))
    far = rows_.groupBy(*keys).cogroup(dealt(asked).groupBy(*keys)).applyInArrow(second, ANSWER)
    within = Window.partitionBy("anchor", "row", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative_label")
    far = far.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k)
    return far.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle(every: int = 100, positives: int = 5, k: int = 10, least: int = 30, most: int = 90) -> str:
    """The same rows in SQL: every anchor scored with every row."""
    return f"""
WITH t AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, b.label, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score FROM t a JOIN t b ON a.id % {every} = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {positives})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id, label) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {least} * positive_score <= 100 * score AND 100 * score <= {most} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id, label) <= {k}"""
