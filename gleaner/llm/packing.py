"""Operator 10: best-fit packing into sequences of a fixed number of tokens, by linear grouping.

Only the histogram of piece lengths (at most ``capacity`` numbers, whatever the input) reaches the driver. There:

1. large lengths, in falling order, are cut into groups of equal cardinality, and each is rounded up to its group's
   largest;
2. the few rounded sizes make a small cutting-stock program, solved by column generation; whole multiples of its
   configurations are opened;
3. documents take the places of their group in the configurations, with their own lengths;
4. what is left over and all small lengths go, longest first, where they fit best, else into new sequences.

The plan is a list of runs: pieces of one length, by their rank, into sequences at an offset. Every piece finds its
run by its length and its rank among the pieces of its length. Ranks come from counts in salted parts of each length,
so one length may hold any share of all rows.

Cases: a null or empty text is the single token 0; an empty table gives no rows; a row listed twice is packed twice.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm.common import checkpointed, keyed, shuffle_partitions

PIECE = "doc_id long, sub long, piece int, start long, length long, ids_crc32 long"


#: Words that lower-case and normalise alike everywhere; all others are left to the tokenizer itself.
PLAIN = re.compile("[!-~\u00c0-\u00ff]+")
#: What the tokenizer cuts words into before it looks for merges.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Stands for the end of a word; no UTF-8 text has this byte.
WORD_END = b"\xff"


class Words(dict):
    """The token ids of words, as little-endian bytes; unknown words are looked up and remembered, up to a bound.

    For a tokenizer whose ids rise with the order of its merges (its words end in "</w>"), plain words take a faster way to the
    same ids: the same ranks in a byte-pair encoder, with one byte for the end of a word. The constructor checks this order;
    without it, and for all other words, the tokenizer answers itself.
    """

    def __init__(self, path: str, bound: int):
        super().__init__()
        self.model, self.bound, self.fast = Tokenizer.from_file(path), bound, None
        ranks = byte_ranks(path)
        if ranks:
            self.fast = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if self.fast and PLAIN.fullmatch(word) and "<|" not in word:
            low = word.lower()
            ids: list[int] = []
            for part in (low,) if low.isalpha() else PARTS.findall(low):
                ids += self.fast(part.encode() + WORD_END)
        else:
            ids = self.model.encode(word, add_special_tokens=False).ids
        found = array("I", ids).tobytes()
        if len(self) >= self.bound:
            self.clear()
        self[word] = found
        return found


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Tokens as bytes with their ids, if every merge makes a token whose id follows the merge's place."""
    with open(path) as f:
        model = json.load(f)["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
        return None
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}

    def raw(token: str) -> bytes:
        end = token.endswith("</w>")
        return bytes(letter[c] for c in (token[:-4] if end else token)) + WORD_END * end

    ranks = {raw(c): vocab[c] for c in letter if c in vocab} | {raw(c + "</w>"): vocab[c + "</w>"] for c in letter if c + "</w>" in vocab}
    made = [vocab[a + b] for a, b in merges]
    if len(ranks) < 511 or made != sorted(made) or max(ranks.values()) > made[0]:
        return None
    ranks |= {raw(a + b): vocab[a + b] for a, b in merges}
    return ranks


#: Of this worker process, so that its tasks share what is known.
_words: dict[str, Words] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, bound: int = 500_000) -> DataFrame:
    """The pieces of every document. The tokenizer drops white space, so words are looked up one by one among known ones."""

    def cut(batches):
        known = _words.setdefault(tokenizer, None) or Words(tokenizer, bound)
        _words[tokenizer] = known
        last = np.array([end_id], dtype="<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("sub", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows: list[tuple] = []
            for doc, sub, text in zip(batch["doc_id"].to_pylist(), batch["sub"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = b"".join(map(known.__getitem__, text.replace("\n", " ").split(" "))) + last
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = ids[at * 4 : (at + capacity) * 4]
                    rows.append((doc, sub, k, at, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return keyed(docs).mapInArrow(cut, PIECE)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Patterns (how many of each size) and how often to use them, so that all demand is met by about the fewest sequences."""
    k = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        price = np.linalg.solve(patterns.T, np.ones(k))
        worth = np.zeros(capacity + 1)
        choice = np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = np.where(sizes <= c, worth[np.maximum(c - sizes, 0)] + price, -1.0)
            best = int(fits.argmax())
            if fits[best] > worth[c - 1] + 1e-12:
                worth[c], choice[c] = fits[best], best
            else:
                worth[c] = worth[c - 1]
        if worth[capacity] <= 1 + 1e-6:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                column[choice[c]] += 1
                c -= sizes[choice[c]]
        amount = np.linalg.solve(patterns, demand)
        direction = np.linalg.solve(patterns, column)
        ratio = np.where(direction > 1e-9, np.maximum(amount, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        patterns[:, int(ratio.argmin())] = column
    amount = np.linalg.solve(patterns, demand)
    return [(patterns[:, j], float(amount[j])) for j in range(k) if amount[j] > 0]


def plan(counts: dict[int, int], capacity: int, groups: int = 48, small: float = 0.125) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces in a sequence, offset)."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c and n < capacity}
    rank = dict.fromkeys(counts, 0)
    opened = 0
    if counts.get(capacity):
        runs.append((capacity, 0, counts[capacity], 0, 1, 0))
        opened = counts[capacity]

    def take(n: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        runs.append((n, rank[n], pieces, sequence, each, offset))
        rank[n] += pieces
        left[n] -= pieces

    free: dict[int, list[tuple[int, int]]] = {}
    large = [n for n in sorted(left, reverse=True) if n > small * capacity]
    total = sum(left[n] for n in large)
    if total:
        each = -(-total // groups)
        queues: dict[int, list[list[int]]] = {}
        seen = 0
        size = 0
        for n in large:
            c = left[n]
            while c:
                if seen % each == 0:
                    size = n
                t = min(c, each - seen % each)
                queues.setdefault(size, []).append([n, t])
                seen += t
                c -= t
        sizes = np.array(sorted(queues, reverse=True))
        demand = np.array([sum(t for _, t in queues[s]) for s in sizes], dtype=float)
        for pattern, amount in configurations(sizes, demand, capacity):
            times = int(amount + 1e-9)
            for s, per in zip(sizes.tolist(), pattern.astype(int).tolist(), strict=True):
                if per:
                    times = min(times, sum(t for _, t in queues[s]) // per)
            if not times:
                continue
            parts = [(opened, times, 0)]
            opened += times
            for s, per in zip(sizes.tolist(), pattern.astype(int).tolist(), strict=True):
                for _ in range(per):
                    filled = []
                    for first, many, used in parts:
                        while many:
                            n, c = queues[s][0]
                            t = min(c, many)
                            take(n, t, first, 1, used)
                            filled.append((first, t, used + n))
                            first, many = first + t, many - t
                            queues[s][0][1] -= t
                            if not queues[s][0][1]:
                                queues[s].pop(0)
                    parts = filled
            for first, many, used in parts:
                free.setdefault(capacity - used, []).append((first, many))
    for n in sorted(left, reverse=True):
        for room in sorted(r for r in free if r >= n):
            if not left[n]:
                break
            stay, each = [], room // n
            for first, many in free.pop(room):
                whole = min(many, left[n] // each)
                if whole:
                    take(n, whole * each, first, each, capacity - room)
                    free.setdefault(room - each * n, []).append((first, whole))
                    first, many = first + whole, many - whole
                if many and 0 < left[n] < each:
                    rest = left[n]
                    take(n, rest, first, rest, capacity - room)
                    free.setdefault(room - rest * n, []).append((first, 1))
                    first, many = first + 1, many - 1
                if many:
                    stay.append((first, many))
            if stay:
                free.setdefault(room, []).extend(stay)
        if left[n]:
            each = capacity // n
            whole = left[n] // each
            if whole:
                take(n, whole * each, opened, each, 0)
                free.setdefault(capacity - each * n, []).append((opened, whole))
                opened += whole
            if left[n]:
                rest = left[n]
                take(n, rest, opened, rest, 0)
                free.setdefault(capacity - rest * n, []).append((opened, 1))
                opened += 1
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with the sequence it goes to and its place there."""
    pieces = checkpointed(token_pieces(docs, tokenizer, capacity))
    spark = docs.sparkSession
    salts = max(64, 4 * shuffle_partitions(spark))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "sub", "piece"), F.lit(salts)))
    counted = checkpointed(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = sorted(plan(counts, capacity))
    length, first, _, sequence, each, offset = (np.array(c, dtype=np.int64) for c in (zip(*runs, strict=True) if runs else [()] * 6))
    starts = length * (1 << 48) + first

    def place(batches):
        for batch in batches:
            n, r = (batch[c].to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(starts, n * (1 << 48) + r, side="right") - 1
            within = r - first[i]
            columns = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[i] + within // each[i]), pa.array(offset[i] + within % each[i] * n)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = counted.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "sub", "piece")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
