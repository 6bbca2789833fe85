"""What the judge sees of a page under the variants of a request's state, for comparing its answers."""

from __future__ import annotations

from itertools import accumulate, groupby

from pyspark.sql import DataFrame

from gleaner.functions import html as H
from gleaner.operators.judge import by_rows
from gleaner.plans import values as V

#: The longest state, in characters, and what a lead has at most.
STATE_CHARS, LEAD_SENTENCES = 80_000, 3
VARIANTS = ("none", "shift", "window", "chunk", "page", "outline", "full")
Sentence = tuple[int, str, str | None]  # id, text, heading


def balanced(n: int, size: int) -> list[slice]:
    """Contiguous chunks of nearly equal size, larger ones first."""
    count = -(-n // size)
    cuts = [0, *accumulate(n // count + (k < n % count) for k in range(count))] if n else [0]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def shifted(n: int, size: int) -> list[slice]:
    """Chunks whose bounds lie between those of the balanced ones."""
    cuts = sorted({0, n, *(s.start + (s.stop - s.start) // 2 for s in balanced(n, size))})
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def around(sizes: list[int], part: slice, most: int = STATE_CHARS) -> slice:
    """As much of the page around a chunk as fits: what is farther from the chunk goes first, the beginning at a tie."""
    upto = [0, *accumulate(sizes)]
    low, high = 0, len(sizes)
    while upto[high] - upto[low] > most and (low < part.start or high > part.stop):
        if low < part.start and part.start - low >= high - part.stop:
            low += 1
        else:
            high -= 1
    return slice(low, high)


def text_of(sentences: list[Sentence], headed: bool) -> str:
    """Sentences in a row; with headings, each on a line of its own where it changes."""
    if not headed:
        return " ".join(t for _, t, _ in sentences)
    parts = []
    for heading, group in groupby(sentences, key=lambda s: s[2] or ""):
        parts += [f"\n## {heading}\n"] if heading else []
        parts += [t for _, t, _ in group]
    return " ".join(parts).strip()


def states(sentences: list[Sentence], variant: str, size: int = V.PER_REQUEST) -> list[tuple[int, dict]]:
    """(chunk, state) of each request under a variant."""
    n = len(sentences)
    out = []
    lengths = [len(t) + 1 for _, t, _ in sentences]
    for k, part in enumerate(shifted(n, size) if variant == "shift" else balanced(n, size)):
        chunk = sentences[part]
        state = {"text": text_of(chunk, False)}
        if variant == "none":
            state = {}
        elif variant == "window" and part.start:
            state["text_just_before"] = text_of(sentences[max(0, part.start - 5) : part.start], False)
        elif variant in ("page", "full"):
            state["text"] = text_of(sentences[around(lengths, part)], variant == "full")
        elif variant == "outline":
            heads = [h for h, _ in groupby(h for _, _, h in sentences if h)]
            lead = text_of(sentences[:LEAD_SENTENCES], False)[: V.SAMPLE_CHARS]
            state = {"headings": " | ".join(heads), "lead": lead, "text": text_of(chunk, True)}
        out.append((k, state))
    return out


def headed(page: H.Page) -> list[Sentence]:
    heads = H.headings(page, H.blocks(page))
    return [(i, t, heads[b]) for i, b, t, *_ in H.page_sentences(page)]


def variant_states(scanned: DataFrame, size: int = V.PER_REQUEST) -> DataFrame:
    """(page_id, variant, chunk, state): the state of each request of a page (page_id, html) under each variant."""

    def work(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            found = headed(H.Page(r["html"] or ""))
            out += [{"page_id": r["page_id"], "variant": v, "chunk": k, "state": list(s.items())} for v in VARIANTS for k, s in states(found, v, size)]
        return out

    return by_rows(scanned.select("page_id", "html"), work, "page_id long, variant string, chunk int, state map<string, string>")
