"""Operator 1: substring removal by a distributed merge of front-coded, sorted suffix runs.

Chunks sort the suffixes that can matter (see ``anchors``), write each bucket's run front-coded (length of the prefix
shared with the suffix before, then the rest) and exchange the runs. A bucket merges its runs with a loser tree in
which each contender knows how much it shares with the last winner: unequal knowledge decides without looking at the
text, equal knowledge looks only behind what is known. The merged order with its common-prefix lengths tells which
suffixes agree on the right of their anchors for any length; rolling hashes tell the same on the left.

Cases: null and empty texts, and those below ``length`` bytes, keep every byte; an empty table gives no rows; of equal
strings the one in the smallest (doc_id, sub, start) stays; a row listed twice doesn't repeat itself; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm import anchors as A
from gleaner.llm.common import BASE, BYTE_SYMBOL, NULL_ID, chunk_count, chunked, mix, ordered, ordered_ids, ragged, text_buffer

#: Suffixes whose bytes are gathered at once.
BLOCK = 1 << 14
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
FULL = SCHEMA + ", kept binary"


def load(table: pa.Table):
    data, offsets = text_buffer(table["text"])
    return BYTE_SYMBOL[data], offsets[1:], data, offsets


def encode(window: A.Window, suffix: np.ndarray, size: np.ndarray, left: np.ndarray, *numbers: np.ndarray) -> bytes:
    """A run: numbers of each suffix, prefix lengths shared with the one before, the rests, the left contexts."""
    n = len(size)
    shared = np.zeros(n, dtype=np.int64)
    if n > 1:
        differ = suffix[1:] != suffix[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), window.length)
        shared[1:] = np.minimum(shared[1:], size[1:])
    rest = suffix.ravel()[ragged(np.arange(n) * window.length + shared, size - shared)]
    head = np.array([n, len(rest)], dtype=np.int64)
    return zlib.compress(b"".join([head.tobytes(), shared.astype(np.uint8).tobytes(), size.astype(np.uint8).tobytes(), *(x.astype(np.int64).tobytes() for x in numbers), rest.tobytes(), left.tobytes()]), 1)


def decode(blob: bytes, numbers: int):
    raw = zlib.decompress(blob)
    n, m = np.frombuffer(raw, dtype=np.int64, count=2)
    at = 16
    shared = np.frombuffer(raw, dtype=np.uint8, count=n, offset=at)
    size = np.frombuffer(raw, dtype=np.uint8, count=n, offset=at + n)
    at += 2 * n
    columns = [np.frombuffer(raw, dtype=np.int64, count=n, offset=at + 8 * n * i) for i in range(numbers)]
    at += 8 * n * numbers
    return shared, size, columns, raw[at : at + m], np.frombuffer(raw, dtype=np.uint8, offset=at + m)


def suffixes(shared: np.ndarray, size: np.ndarray, rest: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for s, n in zip(shared.tolist(), size.tolist(), strict=True):
        before = before[:s] + rest[at : at + n - s]
        at += n - s
        out.append(before)
    return out


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """The runs' suffixes in order, as the number of the run that gives each, and what each shares with the one before."""
    k = len(runs)
    width = 1 << max(0, k - 1).bit_length()
    at = [0] * width
    text: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (width - k)
    known = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = text[a], text[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        skip = known[a]
        p, q = x[skip:], y[skip:]
        if p == q:
            known[b] = len(x)
            return a, b
        n = min(len(p), len(q))
        odd = int.from_bytes(p[:n], "big") ^ int.from_bytes(q[:n], "big")
        common = skip + (n - (odd.bit_length() + 7) // 8)
        if p < q:
            known[b] = common
            return a, b
        known[a] = common
        return b, a

    loser = [0] * width
    level = list(range(width))
    node = width
    while len(level) > 1:
        node //= 2
        above = []
        for i in range(0, len(level), 2):
            won, lost = play(level[i], level[i + 1])
            loser[node + i // 2] = lost
            above.append(won)
        level = above
    best = level[0]
    order, common = [], []
    while text[best] is not None:
        order.append(best)
        common.append(known[best])
        i = at[best] + 1
        at[best] = i
        if i < len(runs[best][0]):
            text[best] = runs[best][0][i]
            known[best] = runs[best][1][i]
        else:
            text[best] = None
        node = (best + width) // 2
        while node:
            won, lost = play(best, loser[node])
            loser[node] = lost
            best = won
            node //= 2
    return order, common


def marked(docs: DataFrame, window: A.Window, chunks: int) -> DataFrame:
    """(chunk, spans): packed (document number in the chunk, begin, end) of what repeats something earlier."""
    answers = A.repeated_cores(docs, load, window, chunks)

    def runs(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("run", pa.binary())])
        if not left.num_rows:
            return schema.empty_table()
        chunk = left["chunk"][0].as_py()
        docs_here = ordered(left)
        symbols, ends, data, offsets = load(docs_here)
        found = A.find(symbols, ends, window, True)
        del symbols
        pick, _ = A.owned(found, right, chunks)
        rows: list[tuple] = []
        if len(pick):
            _, first, inverse = np.unique(found.whole[pick], return_index=True, return_inverse=True)
            rep = np.zeros(len(pick), dtype=bool)
            rep[first] = True
            doc = np.searchsorted(ends, found.place[pick], side="right")
            again = pick[~rep]
            if len(again):
                d = doc[~rep]
                rows.append((chunk % chunks, chunk, 1, A.pack(d, found.first[again] - offsets[d], found.last[again] + window.length - offsets[d])))
            keep, d = pick[rep], doc[rep]
            p, a, b = found.place[keep], found.first[keep], found.last[keep]
            size = b + window.length - p
            reach = np.arange(window.length)
            # bytes moved up by one (255 is in no UTF-8 text), so that 0 stands for the end
            text = np.zeros((len(p), window.length), dtype=np.uint8)
            for at in range(0, len(p), BLOCK):
                s = slice(at, at + BLOCK)
                text[s] = np.where(reach[None, :] < size[s, None], data[np.minimum(p[s, None] + reach[None, :], len(data) - 1)] + np.uint8(1), np.uint8(0))
            bucket = (found.core[keep] % np.uint64(chunks)).astype(np.int64)
            order = np.argsort(text.view(f"S{window.length}").ravel(), kind="stable")
            order = order[np.argsort(bucket[order], kind="stable")]
            ids, subs = ordered_ids(docs_here)
            bucket = bucket[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                o = order[i:j]
                left_text = data[ragged(a[o], p[o] - a[o])]
                rows.append((int(bucket[i]), chunk, 0, encode(window, text[o], size[o], left_text, d[o], ids[d[o]], subs[d[o]], p[o] - offsets[d[o]], p[o] - a[o], p[o] - b[o])))
        return pa.Table.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()

    def decide(table: pa.Table) -> pa.Table:
        chunk = np.asarray(table["chunk"])
        kind = np.asarray(table["kind"])
        out_chunk = [int(c) for c in chunk[kind == 1]]
        out = [table["run"][int(i)].as_py() for i in np.flatnonzero(kind == 1)]
        which = np.flatnonzero(kind == 0)
        which = which[np.argsort(chunk[which], kind="stable")]
        parts = [decode(table["run"][int(i)].as_py(), 6) for i in which]
        if parts:
            order, common = merge([(suffixes(x[0], x[1], x[3]), x[0].tolist()) for x in parts])
            order, common = np.array(order), np.array(common)
            begin = np.cumsum([0] + [len(x[0]) for x in parts])
            row = np.empty(len(order), dtype=np.int64)  # rows of the runs in merged order
            by_run = np.argsort(order, kind="stable")
            row[by_run] = np.arange(len(order))
            doc, ids, subs, place, most, least = (np.concatenate([x[2][i] for x in parts])[row] for i in range(6))
            left = np.concatenate([x[4] for x in parts])
            left_at = np.cumsum(np.concatenate([[0], np.concatenate([x[2][4] for x in parts])]))[:-1][row]
            owner = np.repeat(chunk[which], np.diff(begin))[row]
            earliest = np.lexsort((place, subs, ids))
            place_of, owner_of, starts = [], [], []
            hashed = np.zeros(len(row), dtype=np.uint64)
            for d in range(window.reach):
                if d:
                    has = np.flatnonzero(most >= d)
                    hashed[has] = hashed[has] * np.uint64(BASE) + BYTE_SYMBOL[left[left_at[has] + most[has] - d]]
                group = np.cumsum(common < window.length - d).astype(np.uint64)
                here = earliest[(least[earliest] <= d) & (d <= most[earliest])]
                if len(here) < 2:
                    continue
                key = mix(mix(hashed[here]) + group[here])
                _, first = np.unique(key, return_index=True)
                later = np.ones(len(here), dtype=bool)
                later[first] = False
                place_of.append(place[here[later]] - d)
                owner_of.append(here[later])
            if place_of:
                o, s, e = A.runs_of(np.concatenate(place_of), np.concatenate(owner_of), window.length)
                target = owner[o]
                for c in np.unique(target):
                    m = target == c
                    out_chunk.append(int(c))
                    out.append(A.pack(doc[o[m]], s[m], e[m]))
        return pa.table({"chunk": pa.array(out_chunk, pa.int32()), "spans": pa.array(out, pa.binary())})

    sent = A.answered(docs, answers, runs, "bucket int, chunk int, kind int, run binary")
    return sent.groupBy("bucket").applyInArrow(decide, "chunk int, spans binary")


def remove_repeats(docs: DataFrame, length: int = 100, core: int = 16, keep_text: bool = False) -> DataFrame:
    """Per row of ``docs``: its length, what is removed, a digest of what is left and, if asked for, what is left (bytes)."""
    window = A.Window(length, core)
    chunks = chunk_count(docs)
    parts = chunked(docs, chunks)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        here = ordered(left)
        data, offsets = text_buffer(here["text"])
        doc, begin, end = A.unpack(right["spans"].to_pylist(), 3)
        gone = A.covered(begin + offsets[doc], end + offsets[doc], len(data))
        ids, subs = ordered_ids(here)
        results = {}
        touched = np.zeros(len(ids), dtype=bool)
        touched[doc] = True
        for i in range(len(ids)):
            text = data[offsets[i] : offsets[i + 1]]
            n = len(text)
            removed = spans = 0
            if touched[i]:
                mask = gone[offsets[i] : offsets[i + 1]]
                removed = int(mask.sum())
                spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                text = text[~mask]
            kept = text.tobytes()
            results[int(ids[i]), int(subs[i])] = (n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None)
        rows = [(d, *results[NULL_ID if d is None else d, s]) for d, s in zip(left["doc_id"].to_pylist(), left["sub"].to_pylist(), strict=True)]
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        table = pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)
        return table if keep_text else table.drop_columns(["kept"])

    return A.answered(parts, marked(parts, window, chunks), cut, FULL if keep_text else SCHEMA)
