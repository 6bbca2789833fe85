"""The judge: whatever answers questions about a text.

A request has a state (the text that its questions are about) and questions: ``noul`` asks for a probability, ``choice`` for
one of some labels. ``StubJudge`` is deterministic and says nothing about quality; ``ReplayJudge`` answers from a table;
``HttpJudge`` asks a service that the caller names, several requests at a time, with retries.

A judge answers a list of requests {request_id, state, questions: [{key, type, text, options}]} with as many replies
{answers: {key: {p} or {label, confidence}}, error, tokens}; an answer that is missing is left out.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Thread
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

REPLY = "answers array<struct<key: string, p: double, label: string, confidence: double>>, error string, tokens long"
#: Rows that a Python function gets at once.
ROWS = 256
#: Requests in flight at once.
CONCURRENT = 6


class Judge(Protocol):
    def reply(self, requests: list[dict]) -> list[dict]: ...


def stub_p(text: str) -> float:
    """The first 16 bits of the text's MD5 as a probability."""
    return int(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:4], 16) / 65535


class StubJudge:
    def reply(self, requests: list[dict]) -> list[dict]:
        return [{"answers": {q["key"]: self.answer(q) for q in r["questions"]}, "error": None, "tokens": tokens_of(r)} for r in requests]

    def answer(self, question: dict) -> dict:
        p = stub_p(question["text"])
        if question["type"] == "noul":
            return {"p": p}
        options = list(question["options"])
        return {"label": options[min(int(p * len(options)), len(options) - 1)], "confidence": p}


class ReplayJudge:
    """known: answers by (request id, key)."""

    def __init__(self, known: dict[tuple[str, str], dict]):
        self.known = known

    def reply(self, requests: list[dict]) -> list[dict]:
        return [{"answers": {q["key"]: self.known[r["request_id"], q["key"]] for q in r["questions"] if (r["request_id"], q["key"]) in self.known}, "error": None, "tokens": tokens_of(r)} for r in requests]


def tokens_of(request: dict) -> int:
    """A count of about four characters a token, for judges that don't tell."""
    return math.ceil((len(request["state"] or "") + sum(len(q["text"]) for q in request["questions"])) / 4)


class Refused(Exception):
    """The service refuses the caller: no other request can succeed."""


class HttpJudge:
    """``send(body, timeout)`` gives (status, text). A deadline runs beside each call. Transient errors are retried with growing pauses; what remains is that request's error.

    A refused key ends everything: requests that have not begun are not sent.
    """

    def __init__(self, send: Callable[[dict, float], tuple[int, str]], retries: int = 3, pause: float = 0.4, timeout: float = 20.0, sleep: Callable[[float], None] = time.sleep, concurrent: int = CONCURRENT):
        self.send, self.retries, self.pause, self.timeout, self.sleep, self.concurrent = send, retries, pause, timeout, sleep, concurrent

    def raced(self, body: dict) -> tuple[int, str]:
        """What ``send`` gives, or a TimeoutError when the time is over, whatever ``send`` makes of the limit that it is told."""
        reply: Future = Future()

        def run() -> None:
            try:
                reply.set_result(self.send(body, self.timeout))
            except BaseException as e:
                reply.set_exception(e)

        Thread(target=run, daemon=True).start()
        return reply.result(self.timeout)

    def attempt(self, body: dict) -> tuple[dict | None, str | None, bool]:
        """(reply, error, whether another attempt may help)."""
        try:
            status, text = self.raced(body)
        except OSError as e:
            return None, "timeout" if isinstance(e, TimeoutError) else "network", True
        if status == 401:
            raise Refused("the key is refused")
        if status != 200:
            return None, f"status {status}", status >= 500 or status in (408, 429)
        try:
            reply = json.loads(text)
            return (reply, None, False) if isinstance(reply.get("answers"), dict) else (None, "malformed", True)
        except (ValueError, AttributeError):
            return None, "malformed", True

    def ask(self, body: dict) -> tuple[dict | None, str | None]:
        for k in range(self.retries + 1):
            reply, error, again = self.attempt(body)
            if reply or not again or k == self.retries:
                return reply, error
            self.sleep(self.pause * 2**k + random.random() * 0.2)
        return None, error

    def one(self, request: dict) -> dict:
        body = {"state": request["state"], "questions": {q["key"]: {"type": q["type"], "instructions": q["text"], "criteria": q["options"]} for q in request["questions"]}}
        reply, error = self.ask(body)
        given = (reply or {}).get("answers", {})
        answers = {q["key"]: a for q in request["questions"] if (a := usable(given.get(q["key"])))}
        tokens = ((reply or {}).get("usage") or {}).get("input_tokens")
        return {"answers": answers, "error": error, "tokens": tokens if isinstance(tokens, int) else 0}

    def reply(self, requests: list[dict]) -> list[dict]:
        with ThreadPoolExecutor(max(1, min(self.concurrent, len(requests)))) as pool:
            work = [pool.submit(self.one, r) for r in requests]
            try:
                return [w.result() for w in work]
            except Refused:
                for w in work:
                    w.cancel()
                raise

    def healthcheck(self) -> tuple[bool, str | None]:
        """Whether one tiny request, sent once, is answered, and else why not."""
        try:
            reply, error, _ = self.attempt({"state": "ok", "questions": {"check": {"type": "noul", "instructions": "Does this text say ok?", "criteria": None}}})
        except Refused as e:
            return False, str(e)
        return reply is not None, error


def number(x: object) -> float | None:
    return min(1.0, max(0.0, float(x))) if isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) else None


def usable(answer: object) -> dict | None:
    """What of a service's answer can be used: probabilities within bounds, or a label with its confidence (0 if it has none)."""
    if not isinstance(answer, dict):
        return None
    p = number(answer.get("noul"))
    if p is not None:
        return {"p": p}
    return {"label": answer["choice"], "confidence": number(answer.get("confidence")) or 0.0} if isinstance(answer.get("choice"), str) else None


def ask(requests: DataFrame, judge: Judge) -> DataFrame:
    """``requests`` (request_id, state, questions and any other columns) with the reply: answers, error, tokens.

    Answers are in the order of the questions, null where one is missing. Only what the judge needs becomes Python objects; other columns pass as they are.
    """
    reply = _parse_datatype_string(REPLY)
    types = to_arrow_schema(reply)
    empty = {"p": None, "label": None, "confidence": None}

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = part.select(["request_id", "state", "questions"]).to_pylist()
                replies = judge.reply(rows)
                answers = [[{"key": q["key"]} | empty | r["answers"][q["key"]] if q["key"] in r["answers"] else None for q in row["questions"]] for row, r in zip(rows, replies, strict=True)]
                columns = [answers, [r["error"] for r in replies], [r["tokens"] for r in replies]]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, f.type) for c, f in zip(columns, types, strict=True))], names=[*part.schema.names, *types.names])

    return requests.mapInArrow(work, StructType([*requests.schema.fields, *reply.fields]))


def by_rows(df: DataFrame, work: Callable[[list[dict]], list[dict]], schema: StructType | str) -> DataFrame:
    """Batches of rows through a Python function, by Arrow."""
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def batches_of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield pa.RecordBatch.from_pylist(work(batch.slice(at, ROWS).to_pylist()), schema=arrow)

    return df.mapInArrow(batches_of, schema)
