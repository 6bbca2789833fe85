"""Sparse suffixes for finding long repeats exactly.

Every window of ``length`` symbols picks one anchor: the leftmost start, in the window, of the ``core``-symbol gram
with the smallest hash. Equal windows pick the same place, so two windows are equal only if their anchors have equal
cores, equal symbols to the right and equal symbols to the left. One suffix in some tens is an anchor, and only these
are sorted and exchanged: for each the part of the text that its own windows cover.

Three steps, on chunks of documents:

1. ``repeated_cores``: each chunk sends the hash of each of its cores once; a bucket answers which occur more than once, and
   which so often that their suffixes are too many for one group.
2. ``owned``: a chunk lists the anchors whose core repeats, folds equal ones (same text around the same anchor) and
   sends one of each, so a passage found in a third of all documents costs a chunk one suffix.
3. The operator's own merge decides on windows; its answer goes back to the chunk.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.common import grams, mix, ordered

SLICE = 1 << 18
#: Suffixes with one core from which on it counts as crowded.
CROWDED = 4096


@dataclass(frozen=True)
class Window:
    length: int
    core: int

    @property
    def reach(self) -> int:
        """Places in a window where its anchor can be."""
        return self.length - self.core + 1


@dataclass
class Anchors:
    """place: of the anchor; first, last: starts of the windows that picked it; core: hash; whole: hash of all that the windows cover."""

    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    core: np.ndarray
    whole: np.ndarray | None


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have, w = values, 1
    while w * 2 <= width:
        have = np.minimum(have[:-w], have[w:])
        w *= 2
    n = len(values) - width + 1
    return np.minimum(have[:n], have[width - w : width - w + n])


def find(symbols: np.ndarray, ends: np.ndarray, window: Window, whole: bool) -> Anchors:
    """Anchors of all windows that lie inside one document; ends: where documents end, ascending."""
    parts: list[tuple] = []
    low = np.uint64((1 << 20) - 1)
    n = len(symbols)
    for at in range(0, n, SLICE):
        piece = symbols[at : at + SLICE + window.length - 1]
        if len(piece) < window.length:
            break
        core = mix(grams(piece, window.core))
        best = sliding_min((core & ~low) | np.arange(len(core), dtype=np.uint64), window.reach)
        place = (best & low).astype(np.int64)
        starts = np.arange(len(place)) + at
        inside = np.flatnonzero(ends[np.searchsorted(ends, starts, side="right").clip(max=len(ends) - 1)] >= starts + window.length)
        if not len(inside):
            continue
        p = place[inside]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (inside[1:] != inside[:-1] + 1)])
        begin = np.flatnonzero(new)
        stop = np.concatenate([begin[1:], [len(p)]]) - 1
        a, b, p = inside[begin], inside[stop], p[begin]
        h = None
        if whole:
            full = grams(piece, window.length)
            h = mix(mix(full[a]) + full[b] * np.uint64(3) + ((p - a) * 4096 + (b - a)).astype(np.uint64))
        parts.append((p + at, a + at, b + at, core[p], h))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return Anchors(none, none, none, none.astype(np.uint64), none.astype(np.uint64) if whole else None)
    cat = [np.concatenate(x) if x[0] is not None else None for x in zip(*parts, strict=True)]
    return Anchors(*cat)


def distinct_cores(core: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's distinct cores ordered by bucket, how often each occurs in the chunk, and where buckets begin."""
    values, counts = np.unique(core, return_counts=True)
    bucket = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return values[order], counts[order], edges


def repeated_cores(docs: DataFrame, load, window: Window, buckets: int, crowded: int = CROWDED) -> DataFrame:
    """(chunk, bucket, flags): two bits for each distinct core that the chunk has in the bucket: does it occur again anywhere, is it crowded."""

    def send(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        symbols, ends = load(ordered(table))[:2]
        found = find(symbols, ends, window, False)
        values, counts, edges = distinct_cores(found.core, buckets)
        counts = np.minimum(counts, 65535).astype(np.uint16)
        used = np.flatnonzero(edges[1:] > edges[:-1])
        blobs = [values[edges[i] : edges[i + 1]].tobytes() + zlib.compress(counts[edges[i] : edges[i + 1]].tobytes(), 1) for i in used]
        sizes = edges[used + 1] - edges[used]
        return pa.table({"bucket": pa.array(used, pa.int32()), "chunk": pa.array([chunk] * len(used), pa.int32()), "n": pa.array(sizes, pa.int32()), "cores": pa.array(blobs, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        blobs = [x.as_py() for x in table["cores"]]
        every = np.concatenate([np.frombuffer(x, dtype=np.uint64, count=n) for x, n in zip(blobs, sizes, strict=True)])
        counts = np.concatenate([np.frombuffer(zlib.decompress(x[8 * n :]), dtype=np.uint16) for x, n in zip(blobs, sizes, strict=True)])
        values, place = np.unique(every, return_inverse=True)
        total = np.bincount(place, counts, minlength=len(values))[place]
        flags, at, out = np.stack([total > 1, total > crowded], axis=1), 0, []
        for n in sizes:
            out.append(np.packbits(flags[at : at + n].ravel()).tobytes())
            at += n
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "flags": pa.array(out, pa.binary())})

    sent = docs.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, n int, cores binary")
    return sent.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, flags binary")


def owned(found: Anchors, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the anchors whose core occurs more than once anywhere, and whether it is crowded."""
    if not len(found.core):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    values, _, edges = distinct_cores(found.core, buckets)
    flags = np.zeros((len(values), 2), dtype=bool)
    for bucket, bits in zip(answers["bucket"].to_pylist(), answers["flags"].to_pylist(), strict=True):
        a, b = edges[bucket], edges[bucket + 1]
        flags[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=2 * (b - a)).astype(bool).reshape(-1, 2)
    order = np.argsort(values)
    of = flags[order][np.searchsorted(values[order], found.core)]
    pick = np.flatnonzero(of[:, 0])
    return pick, of[pick, 1]


def runs_of(starts: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins windows at consecutive starts of one owner: (owner, begin, end) of what they cover."""
    order = np.lexsort((starts, owner))
    s, o = starts[order], owner[order]
    if not len(s):
        return o, s, s
    new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(s)]]) - 1
    return o[new], s[new], s[last] + length


def covered(begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """A mask of the places that intervals cover."""
    step = np.zeros(size + 1, dtype=np.int32)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def pack(*columns: np.ndarray) -> bytes:
    return np.concatenate([np.asarray(c, dtype=np.int64) for c in columns]).astype(np.int32).tobytes() if len(columns[0]) else b""


def unpack(blobs: list[bytes], width: int) -> list[np.ndarray]:
    parts = [np.frombuffer(b, dtype=np.int32).reshape(width, -1) for b in blobs if b]
    return list(np.concatenate(parts, axis=1).astype(np.int64)) if parts else [np.zeros(0, dtype=np.int64)] * width


def answered(docs: DataFrame, answers: DataFrame, step, schema: str) -> DataFrame:
    """Documents and answers of each chunk brought together; docs has the same plan each time, so its exchange is reused."""
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(step, schema)

