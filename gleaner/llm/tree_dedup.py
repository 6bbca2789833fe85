"""Operator 8: repeated word passages by suffix trees, split by prefixes of variable length.

Words are symbols. Suffixes that can matter (see ``anchors``) are grouped by their first ``core`` words, and a group goes to
one of as many buckets as there are memory-sized chunks. A group that is too large for one task is split by longer prefixes:
the suffixes begin further left then, where their windows do, and each window is the prefix, so what meets is equal over
its whole length and groups have at most one suffix of each chunk. A bucket builds its subtrees from the top: the prefix of
a group grows word by word as long as the group has two suffixes or more, so prefixes are as long as they need to be and a
suffix that is alone is dropped. A group whose prefix has t words is the tree's node at depth t. A window that has d words
on the left of its anchor is repeated if the node at depth ``length - d`` has two leaves with equal d words on the left: these
are the deep nodes whose leaves are maximal repeats.

Cases: null and empty texts have no words; a text below ``length`` words keeps all; an empty table gives no rows; all
occurrences of a repeated window go, the first too; a row listed twice doesn't repeat itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm import anchors as A
from gleaner.llm.common import BASE, NULL_ID, chunk_count, chunked, documents_words, grams, mix, ordered, ordered_ids, ragged, word_symbols

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
FULL = SCHEMA + ", kept string"


def load(table: pa.Table):
    data, begin, end, ends = documents_words(table["text"])
    return word_symbols(data, begin, end), ends


def encode(words: np.ndarray, *numbers: np.ndarray) -> bytes:
    """Numbers of each suffix, and all their words as places in a list of the different ones."""
    known, code = np.unique(words, return_inverse=True)
    code = code.astype(np.uint16 if len(known) < 65536 else np.uint32)
    head = np.array([len(numbers[0]), len(known), len(code), code.itemsize], dtype=np.int64)
    return zlib.compress(b"".join([head.tobytes(), known.tobytes(), *(x.astype(np.int64).tobytes() for x in numbers), code.tobytes()]), 1)


def decode(blob: bytes, numbers: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = zlib.decompress(blob)
    n, k, m, item = (int(x) for x in np.frombuffer(raw, dtype=np.int64, count=4))
    known = np.frombuffer(raw, dtype=np.uint64, count=k, offset=32)
    at = 32 + 8 * k
    columns = [np.frombuffer(raw, dtype=np.int64, count=n, offset=at + 8 * n * i) for i in range(numbers)]
    return columns, known[np.frombuffer(raw, dtype=f"u{item}", count=m, offset=at + 8 * n * numbers)]


def deep_nodes(words: np.ndarray, size: np.ndarray, most: np.ndarray, least: np.ndarray, window: A.Window) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, d) of every window that occurs twice among these suffixes; words: each one's left words, then its own."""
    width = most + size
    at = np.cumsum(np.concatenate([[0], width]))[:-1] + most
    left = np.zeros((window.reach, len(size)), dtype=np.uint64)
    for d in range(1, window.reach):
        has = np.flatnonzero(most >= d)
        left[d, has] = left[d - 1, has] * np.uint64(BASE) + words[at[has] - d]
    alive = np.arange(len(size))
    node = np.zeros(len(size), dtype=np.int64)
    found_row, found_d = [], []
    for depth in range(1, window.length + 1):
        alive = alive[size[alive] >= depth]
        _, node_now, count = np.unique(mix(words[at[alive] + depth - 1]) + mix(node[alive].astype(np.uint64)), return_inverse=True, return_counts=True)
        several = count[node_now] > 1
        alive, node_now = alive[several], node_now[several]
        if not len(alive):
            break
        node[alive] = node_now
        d = window.length - depth
        if depth < window.core:
            continue
        here = alive[(least[alive] <= d) & (d <= most[alive])]
        _, which, count = np.unique(mix(left[d, here]) + mix(node[here].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
        here = here[count[which] > 1]
        found_row.append(here)
        found_d.append(np.full(len(here), d))
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(found_row or none), np.concatenate(found_d or none)


def whole_windows(symbols: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows from first to last: hashes of the different ones, the start of each, how often it occurs, and starts that repeat another's."""
    starts = np.unique(ragged(first, last - first + 1))
    hashed = mix(grams(symbols, length)[starts])
    values, at, which, counts = np.unique(hashed, return_index=True, return_inverse=True, return_counts=True)
    return values, starts[at], counts, starts[counts[which] > 1]


def marked(docs: DataFrame, window: A.Window, chunks: int, crowded: int = A.CROWDED) -> DataFrame:
    """(chunk, spans): packed (document number in the chunk, begin, end), in words, of what occurs elsewhere too."""
    answers = A.repeated_cores(docs, load, window, chunks, crowded)

    def runs(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("run", pa.binary())])
        if not left.num_rows:
            return schema.empty_table()
        chunk = left["chunk"][0].as_py()
        symbols, ends = load(ordered(left))
        begin = np.concatenate([[0], ends])
        found = A.find(symbols, ends, window, True)
        pick, many = A.owned(found, right, chunks)
        rows: list[tuple] = []
        if many.any():
            values, start, count, again = whole_windows(symbols, found.first[pick[many]], found.last[pick[many]], window.length)
            if len(again):
                d = np.searchsorted(ends, again, side="right")
                rows.append((chunk % chunks, chunk, 1, A.pack(*A.runs_of(again - begin[d], d, window.length))))
            d = np.searchsorted(ends, start, side="right")
            place = np.where(count > 1, -1, start - begin[d])  # those that repeat here are known to; they are sent for others
            bucket = (values % np.uint64(chunks)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            values, d, place, bucket = values[order], d[order], place[order], bucket[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                rows.append((int(bucket[i]), chunk, 2, b"".join([values[i:j].tobytes(), A.pack(d[i:j], place[i:j])])))
        pick = pick[~many]
        if len(pick):
            _, first, inverse, count = np.unique(found.whole[pick], return_index=True, return_inverse=True, return_counts=True)
            doc = np.searchsorted(ends, found.place[pick], side="right")
            again = count[inverse] > 1
            if again.any():
                x, d = pick[again], doc[again]
                rows.append((chunk % chunks, chunk, 1, A.pack(d, found.first[x] - begin[d], found.last[x] + window.length - begin[d])))
            keep, d = pick[first], doc[first]
            bucket = (found.core[keep] % np.uint64(chunks)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keep, d, bucket = keep[order], d[order], bucket[order]
            p, a, b = found.place[keep], found.first[keep], found.last[keep]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                s = slice(i, j)
                words = symbols[ragged(a[s], b[s] + window.length - a[s])]
                rows.append((int(bucket[i]), chunk, 0, encode(words, d[s], p[s] - begin[d[s]], p[s] - a[s], p[s] - b[s])))
        return pa.Table.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()

    def decide(table: pa.Table) -> pa.Table:
        chunk, kind = np.asarray(table["chunk"]), np.asarray(table["kind"])
        out_chunk = [int(c) for c in chunk[kind == 1]]
        out = [table["run"][int(i)].as_py() for i in np.flatnonzero(kind == 1)]
        which = np.flatnonzero(kind == 0)
        if len(which):
            parts = [decode(table["run"][int(i)].as_py(), 4) for i in which]
            doc, place, most, least = (np.concatenate([x[0][i] for x in parts]) for i in range(4))
            owner = np.repeat(chunk[which], [len(x[0][0]) for x in parts])
            row, d = deep_nodes(np.concatenate([x[1] for x in parts]), window.length - least, most, least, window)
            o, s, e = A.runs_of(place[row] - d, row, window.length)
            target = owner[o]
            order = np.argsort(target, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], target[order][1:] != target[order][:-1], [True]])) if len(order) else []
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                m = order[i:j]
                out_chunk.append(int(target[m[0]]))
                out.append(A.pack(doc[o[m]], s[m], e[m]))
        which = np.flatnonzero(kind == 2)
        if len(which):
            blobs = [table["run"][int(i)].as_py() for i in which]
            n = [len(x) // 16 for x in blobs]
            values = np.concatenate([np.frombuffer(x, dtype=np.uint64, count=k) for x, k in zip(blobs, n, strict=True)])
            doc, place = A.unpack([x[8 * k :] for x, k in zip(blobs, n, strict=True)], 2)
            _, node, count = np.unique(values, return_inverse=True, return_counts=True)
            hit = np.flatnonzero((count[node] > 1) & (place >= 0))
            owner = np.repeat(chunk[which], n)[hit]
            for c in np.unique(owner):
                mine = hit[owner == c]
                out_chunk.append(int(c))
                out.append(A.pack(*A.runs_of(place[mine], doc[mine], window.length)))
        return pa.table({"chunk": pa.array(out_chunk, pa.int32()), "spans": pa.array(out, pa.binary())})

    sent = A.answered(docs, answers, runs, "bucket int, chunk int, kind int, run binary")
    return sent.groupBy("bucket").applyInArrow(decide, "chunk int, spans binary")


def remove_passages(docs: DataFrame, length: int = 35, core: int = 8, keep_text: bool = False, crowded: int = A.CROWDED) -> DataFrame:
    """Per row of ``docs``: its words, how many go, a digest of what is left and, if asked for, what is left."""
    window = A.Window(length, core)
    chunks = chunk_count(docs)
    parts = chunked(docs, chunks)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        here = ordered(left)
        data, begin, end, ends = documents_words(here["text"])
        first = np.concatenate([[0], ends])
        doc, s, e = A.unpack(right["spans"].to_pylist(), 3)
        gone = A.covered(s + first[doc], e + first[doc], len(begin))
        plain = data.copy()
        plain[end] = 32
        keep = np.flatnonzero(~gone)
        size = end[keep] - begin[keep] + 1
        joined = plain[ragged(begin[keep], size)]
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(keep, first)]
        removed = np.concatenate([[0], np.cumsum(gone)])[first]
        results = {}
        for i, key in enumerate(zip(*(x.tolist() for x in ordered_ids(here)), strict=True)):
            kept = joined[upto[i] : max(upto[i], upto[i + 1] - 1)].tobytes()
            results[key] = (int(first[i + 1] - first[i]), int(removed[i + 1] - removed[i]), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None)
        rows = [(d, *results[NULL_ID if d is None else d, k]) for d, k in zip(left["doc_id"].to_pylist(), left["sub"].to_pylist(), strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        table = pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
        return table if keep_text else table.drop_columns(["kept"])

    return A.answered(parts, marked(parts, window, chunks, crowded), cut, FULL if keep_text else SCHEMA)
