"""Page revisions as a stream: bursts settle, a page view is started, extended or started over, and requests are limited.

``View`` is the state of one page view and says what follows from a settled revision or from a timer; ``page_views`` runs it
per page as a stateful operator in event time, with a timer for what waits and an end for views that went quiet.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.functions import html as H
from gleaner.functions.text import carries_account_number, hash_text
from gleaner.operators.judge import by_rows
from gleaner.plans import values as V

#: A settled revision: its blocks in order with their sentences, characters inside and outside the container, whether it is hidden.
REVISION = "page_id long, at timestamp, url string, blocks array<struct<block_id: int, sentences: array<string>>>, inside_chars long, outside_chars long, hidden boolean"
#: What follows: start (the whole page is asked), more (new text is asked), retire (judged text is gone), restart, skip.
ACTION = "page_id long, at_ms long, generation int, action string, number int, ids array<int>, texts array<string>"
QUIET_MS = 3_600_000


def debounced(revisions: DataFrame, gap: str = f"{V.DEBOUNCE_MS} milliseconds", late: str = "10 seconds") -> DataFrame:
    """(page_id, generation, at, html, changes, ...): the last revision of each burst of changes; late ones of an older burst are dropped."""
    bursts = revisions.withWatermark("rev_ts", late).groupBy("page_id", "generation", F.session_window("rev_ts", gap).alias("burst"))
    more = [c for c in revisions.columns if c not in ("page_id", "generation", "rev_ts", "html")]
    last = bursts.agg(F.max_by("html", "rev_ts").alias("html"), F.count("*").alias("changes"), *(F.max_by(c, "rev_ts").alias(c) for c in more))
    return last.select("page_id", "generation", F.col("burst.end").alias("at"), "html", "changes", *more)


def change_source(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Revisions of pages as they arrive in a folder: (page_id, generation, rev_ts, url, html)."""
    return spark.readStream.schema("page_id long, generation int, rev_ts timestamp, url string, html string").option("maxFilesPerTrigger", files).parquet(folder)


def settled(bursts: DataFrame) -> DataFrame:
    """REVISION rows for settled pages (page_id, at, url, html): the blocks of the main container with their sentences."""

    def work(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            page = H.Page(r["html"] or "")
            top = H.main_container(page)
            blocks: dict[int, list[str]] = {}
            for _, block, text, *_ in H.page_sentences(page):
                blocks.setdefault(block, []).append(text)
            inside = page.size(top)
            hidden = any(page.hidden(i) for i in (top, *page.above(top)))
            out.append({"page_id": r["page_id"], "at": r["at"], "url": r["url"], "blocks": [{"block_id": b, "sentences": s} for b, s in blocks.items()], "inside_chars": inside, "outside_chars": page.size(0) - inside, "hidden": hidden})
        return out

    return by_rows(bursts.select("page_id", "at", "url", "html"), work, REVISION)


def without_fragment(url: str) -> str:
    return url.partition("#")[0]


@dataclass
class View:
    """A page view. blocks: of each block now on the page its hash and ids; pool: (id, text) that wait for the next request."""

    generation: int = 0
    url: str | None = None
    judged: bool = False
    retries: int = 0
    signature: list[int] = field(default_factory=list)
    outside: int = 0
    next_id: int = 0
    blocks: dict[str, tuple[str, list[int]]] = field(default_factory=dict)
    pool: list[tuple[int, str]] = field(default_factory=list)
    sent: int = 0
    last_ms: int = -(2**62)

    def revise(self, at_ms: int, url: str, blocks: list[tuple[int, list[str]]], inside: int, outside: int, hidden: bool) -> list[tuple]:
        """Actions that a settled revision leads to."""
        if self.judged and (without_fragment(url) != self.url or hidden or outside - self.outside > max(V.OUTGROWN_CHARS, inside)):
            generation = self.generation
            self.__init__(generation=generation)
            return [("restart", 0, [], []), *self.start(url, blocks, inside, outside)]
        if not self.judged:
            signature = [inside + outside, int(hidden)]
            if self.url is not None and (without_fragment(url) == self.url and (signature == self.signature or self.retries >= V.GROWTH_RETRIES)):
                return []  # the page did not change since, or never settles
            self.retries = self.retries + 1 if self.url == without_fragment(url) else 0
            self.signature = signature
            return self.start(url, blocks, inside, outside)
        return self.extend(at_ms, blocks)

    def start(self, url: str, blocks: list[tuple[int, list[str]]], inside: int, outside: int) -> list[tuple]:
        self.generation += 1
        self.url = without_fragment(url)
        if sum(len(s) for _, s in blocks) < V.MIN_SENTENCES:
            return [("skip", self.retries, [], [])]
        self.judged, self.outside = True, outside
        _, added = self.compare(blocks)
        return [("start", 0, [i for i, _ in added], [t for _, t in added])]

    def compare(self, blocks: list[tuple[int, list[str]]]) -> tuple[list[int], list[tuple[int, str]]]:
        """Ids of text that is gone or changed, and new sentences with ids that continue; one with an account number gets an id and is not asked."""
        now = {str(b): (hash_text("\n".join(s)), s) for b, s in blocks}
        gone = [i for b, (h, ids) in self.blocks.items() if b not in now or now[b][0] != h for i in ids]
        kept = {b: x for b, x in self.blocks.items() if b in now and now[b][0] == x[0]}
        added = []
        for b, (h, s) in now.items():
            if b not in kept:
                ids = list(range(self.next_id, self.next_id + len(s)))
                self.next_id += len(s)
                kept[b] = (h, ids)
                added += zip(ids, s, strict=True)
        self.blocks = kept
        return gone, [(i, t) for i, t in added if not carries_account_number(t)]

    def extend(self, at_ms: int, blocks: list[tuple[int, list[str]]]) -> list[tuple]:
        gone, added = self.compare(blocks)
        self.pool = [x for x in self.pool if x[0] not in set(gone)] + added
        return ([("retire", 0, gone, [])] if gone else []) + self.due(at_ms)

    def due(self, at_ms: int) -> list[tuple]:
        """The request that may go out now; beyond the budget what waits is dropped."""
        if self.sent >= V.REQUEST_BUDGET:
            self.pool = []
        if not self.pool or at_ms - self.last_ms < V.REQUEST_INTERVAL_MS:
            return []
        self.sent, self.last_ms, batch, self.pool = self.sent + 1, at_ms, self.pool, []
        return [("more", self.sent, [i for i, _ in batch], [t for _, t in batch])]

    def timer(self) -> int | None:
        """When what waits may go out."""
        return self.last_ms + V.REQUEST_INTERVAL_MS if self.pool else None


def page_views(settled: DataFrame, late: str = "10 seconds") -> DataFrame:
    """ACTION rows for settled revisions (REVISION): what to ask, what is no longer on the page, and when a view starts over."""

    def work(key, batches, state: GroupState):
        view = View()
        if state.exists:
            kept = json.loads(state.get[0])
            view = View(**kept | {"blocks": {b: (h, i) for b, (h, i) in kept["blocks"].items()}, "pool": [tuple(x) for x in kept["pool"]]})
        out = []

        def say(at_ms: int, actions: list[tuple]) -> None:
            out.extend((key[0], at_ms, view.generation, what, number, ids, texts) for what, number, ids, texts in actions)

        rows = sorted((r for batch in batches for r in batch.itertuples(index=False)), key=lambda r: r.at)
        if state.hasTimedOut:
            at_ms = view.timer()
            if at_ms is None:
                state.remove()
                return
            say(at_ms, view.due(at_ms))
        for r in rows:
            at_ms = int(r.at.timestamp() * 1000)
            if (waits := view.timer()) is not None and waits <= at_ms:
                say(waits, view.due(waits))
            blocks = [(b["block_id"], list(b["sentences"])) for b in r.blocks]
            say(at_ms, view.revise(at_ms, r.url, blocks, int(r.inside_chars), int(r.outside_chars), bool(r.hidden)))
        state.update((json.dumps(asdict(view)),))
        last = max([view.last_ms, *(int(r.at.timestamp() * 1000) for r in rows), state.getCurrentWatermarkMs()])
        state.setTimeoutTimestamp(max(view.timer() or last + QUIET_MS, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["page_id", "at_ms", "generation", "action", "number", "ids", "texts"])

    return settled.withWatermark("at", late).groupBy("page_id").applyInPandasWithState(work, ACTION, "view string", "append", GroupStateTimeout.EventTimeTimeout)


def fenced(replies: DataFrame, current: DataFrame) -> DataFrame:
    """Replies (page_id, generation, ...) of the page views that are still open: current (page_id, generation)."""
    return replies.join(current.select("page_id", "generation"), ["page_id", "generation"], "left_semi")


def progress(judgments: DataFrame, threshold: float = V.KEEP_AT) -> DataFrame:
    """Counts by page view that grow as chunks are judged (update mode); the final result of a page is the last row."""
    return judgments.groupBy("page_id", "generation").agg(F.count("*").alias("total"), F.count_if(F.col("keep") >= threshold).alias("kept"), F.count_if(F.col("keep") < threshold).alias("faded"))


def merged_rules(known: DataFrame, more: DataFrame) -> DataFrame:
    """Rule results (page_id, rule, sent_id, p) with those of added sentences: a later result of a sentence replaces an earlier one."""
    both = known.withColumn("seq", F.lit(0)).unionByName(more.withColumn("seq", F.lit(1)))
    return both.groupBy("page_id", "rule", "sent_id").agg(F.max_by("p", "seq").alias("p"))


def latest(states: DataFrame) -> DataFrame:
    """The last state of each key (update mode)."""
    return states.groupBy("tab_id").agg(F.max_by(F.struct("generation", "status"), "ts").alias("last")).select("tab_id", "last.*")
