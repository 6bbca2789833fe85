"""What the training-data operators share: reading, checkpoints, chunking, word hashes, connected components.

Defined for every operator here: a null text counts as an empty one; a null ``doc_id`` sorts before every other;
rows that agree in ``doc_id`` and text are one document listed twice (each gets the same result); rows that agree in
``doc_id`` only are different documents, ordered by a hash of their text. Columns that an operator does not need are
dropped before anything is shuffled, so extra columns cannot clash.
"""

from __future__ import annotations

import gc
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
NULL_ID = -(2**63)
#: Text bytes that one chunk of documents holds, about.
CHUNK_BYTES = 4 << 20
#: Edges that a task of a round of components has, about, beyond the first few tasks.
EDGES_PER_TASK = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine only in local mode, where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleaner-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame, share: int = 1) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, so that no later step depends on an executor's disk.

    share: for tables that are small beside the documents, so many shuffle partitions go to one task and one file.
    """
    checkpoint_folder(df.sparkSession)
    return (df.coalesce(max(8, shuffle_partitions(df.sparkSession) // share)) if share > 1 else df).checkpoint()


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, sub, text): sub tells documents with one doc_id apart; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("sub"), text.alias("text"))


def chunk_count(docs: DataFrame, target: int = CHUNK_BYTES) -> int:
    """So many chunks that each has about ``target`` bytes of text; a column-pruned scan, one number to the driver.

    Beyond a gigabyte chunks grow with the root of the input, up to four times, so that what chunks send to buckets stays in larger pieces.
    """
    total = docs.agg(F.sum(F.octet_length(F.col("text"))).alias("n")).first()["n"] or 0
    size = int(target * min(4.0, max(1.0, (total / (1 << 30)) ** 0.5)))
    return max(shuffle_partitions(docs.sparkSession), -(-total // size))


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, doc_id, sub, text); the chunk follows from the key alone, so a lost task deals its rows the same way again."""
    return keyed(docs).select(F.pmod(F.xxhash64("doc_id", "sub"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "sub", "text")


M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTE_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = 0x5851F42D4C957F2D  # odd, so that its powers have inverses modulo 2**64


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """The polynomial hash of every k consecutive symbols, in O(log k) passes."""
    if len(symbols) < k:
        return np.zeros(0, dtype=np.uint64)
    have, out, width = symbols, None, 1
    done = 0
    while width <= k:
        if k & width:
            if out is None:
                out, done = have, width
            else:
                n = len(symbols) - (done + width) + 1
                out = out[:n] * power(width) + have[done : done + n]
                done += width
        if width * 2 <= k:
            have = have[:-width] * power(width) + have[width:]
        width *= 2
    return out


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.ones(1, dtype=np.uint64)
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            _POWERS[name] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte array start and end."""
    word = np.concatenate([[False], ~SPACE[data], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def word_symbols(data: np.ndarray, begin: np.ndarray, end: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word's bytes, worked out in blocks of bytes so that memory stays small."""
    out = np.zeros(len(begin), dtype=np.uint64)
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(end, begin[at] + block, side="right")))
        lo, hi = int(begin[at]), int(end[stop - 1])
        up, down = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(BYTE_SYMBOL[data[lo:hi]] * up[: hi - lo], out=total[1:])
        b, e = begin[at:stop] - lo, end[at:stop] - lo
        out[at:stop] = mix((total[e] - total[b]) * down[b] + (e - b).astype(np.uint64) * ODD)
        at = stop
    return out


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column without nulls, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, dtype=np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release(spark: SparkSession) -> None:
    """Lets the engine remove shuffles and checkpoints that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (a, b): component is the smallest id that edges reach.

    Alternating large and small stars; minima are aggregated before the shuffle and joined back, so a hub with many
    edges is split by the engine as any skewed join. Each star cuts its lineage with a checkpoint, as the second one reads the
    first one's result several times and the driver would plan and keep as many copies of it. A round has as many tasks as
    its edges need, and lets go of what the round before left on disk.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame, large: bool, tasks: int) -> DataFrame:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        both = both.coalesce(tasks)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(low, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.where("a <> m").select("a", F.col("m").alias("b")))
        return out.where("a <> b").coalesce(tasks).distinct()

    pairs = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    before, now = None, state_of(pairs)
    while now != before:
        tasks = max(8, now[0] // EDGES_PER_TASK)
        for large in (True, False):
            pairs = checkpointed(star(pairs, large, tasks).coalesce(tasks))
        before, now = now, state_of(pairs)
        release(spark)
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(pairs.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def state_of(pairs: DataFrame) -> tuple:
    """The number of pairs and a sum over them: equal for equal sets."""
    return tuple(pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first())


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of many stretches, one after another."""
    sizes = np.asarray(sizes, dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(np.asarray(starts, dtype=np.int64) - ends + sizes, sizes)


def ordered_ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table["doc_id"].combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False), table["sub"].to_numpy()


def spaced_buffer(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """As text_buffer, with a space behind each text, so that words never run from one text into the next."""
    import pyarrow.compute as pc

    return text_buffer(pc.binary_join_element_wise(column.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())))


def documents_words(column: pa.ChunkedArray):
    """(data, begin, end, ends): the spaced bytes, where words begin and end in them, and the number of words up to each text's end."""
    data, offsets = spaced_buffer(column)
    begin, end = word_bounds(data)
    return data, begin, end, np.searchsorted(begin, offsets[1:], side="left")


def ordered(table: pa.Table) -> pa.Table:
    """The different documents of a chunk by (doc_id, sub), nulls first."""
    ids = table["doc_id"].combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    sub = table["sub"].to_numpy()
    order = np.lexsort((sub, ids))
    if len(order):
        keep = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (sub[order][1:] != sub[order][:-1])])
        order = order[keep]
    return table.take(pa.array(order))
