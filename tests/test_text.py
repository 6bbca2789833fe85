import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gleaner.functions import text as T
from gleaner.operators.highlights import chosen, marks
from gleaner.operators.judge import HttpJudge, Refused


def cut(text):
    return [text[a:b] for a, b in T.split_sentences(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", []),
        ("Dr. Smith came home. He slept until noon.", ["Dr. Smith came home.", "He slept until noon."]),
        ("It cost 9.99 in all. No. 5 was sold out.", ["It cost 9.99 in all.", "No. 5 was sold out."]),
        ("One line without end\nanother line without end", ["One line without end", "another line without end"]),
        ("The fleet grew fast.[12] The port did not.", ["The fleet grew fast.[12]", "The port did not."]),
        ("Mix the flour well. Done. Then wait an hour.", ["Mix the flour well. Done.", "Then wait an hour."]),
        ("The house was sold in May. Read more", ["The house was sold in May."]),
        ("彼は昨日来た。彼女は今日来る。", ["彼は昨日来た。", "彼女は今日来る。"]),
        ("J. K. Miller wrote it down. We read it.", ["J. K. Miller wrote it down.", "We read it."]),
    ],
)
def test_sentences(text, expected):
    assert cut(text) == expected


@given(st.text(alphabet="Ab. \n!?\"[1]。", max_size=60))
def test_spans_are_ordered_and_apart(text):
    spans = T.split_sentences(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_hash_vectors():
    assert [T.hash_text(x) for x in ("", "a", "foobar")] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]
    assert T.hash_text("😀") != T.hash_text("😁")


def test_words_and_stitching():
    text = "The rise of mortgages and a higher spending, said the bank."
    asked = T.asked_words(text)
    assert [w for _, _, w in asked] == ["rise", "mortgages", "higher", "spending", "said", "bank"]
    mark = [(a, b) for a, b, w in asked if w in ("rise", "mortgages", "said")]
    assert [text[a:b] for a, b in T.stitch(text, mark, asked)] == ["rise of mortgages", "said"]


def test_clauses():
    short = "Twenty words or fewer, and it stays whole."
    assert T.clauses(short) == [(0, len(short))]
    long = "Well, the council voted late on Monday night to close the bridge for repairs; the mayor, who had asked for it, thanked everyone present and left."
    parts = [long[a:b] for a, b in T.clauses(long)]
    assert parts[0].startswith("Well, the council") and parts[1:] == ["who had asked for it", "thanked everyone present and left."]


def test_quotes_equal_union_find():
    rng = random.Random(1)
    for _ in range(200):
        sentences = [(i * 10, i * 10 + 9) for i in range(8)]
        quotes = [(a, a + rng.randrange(1, 40)) for a in sorted(rng.sample(range(80), 3))]
        group = T.quote_groups(sentences, quotes)
        islands = []
        for a, b in quotes:
            touched = {i for i, (s, e) in enumerate(sentences) if s < b and a < e}
            if len(touched) > 1:
                for other in [x for x in islands if x & touched]:
                    islands.remove(other)
                    touched |= other
                islands.append(touched)
        assert group == [min((min(x) for x in islands if i in x), default=-1) for i in range(8)]


def test_account_numbers():
    assert T.carries_account_number("Pay to GB82 WEST 1234 5698 7654 32 today.")
    assert T.carries_account_number("Card 4111 1111 1111 1111 was used.")
    assert not T.carries_account_number("Card 4111 1111 1111 1112 was used.")
    assert T.carries_account_number("Her number is 123-45-6789.") and not T.carries_account_number("Part 000-45-6789.")


def test_marks_by_words_clauses_and_failures():
    assert chosen([0.1, 0.4, 0.5], False) == [False, True, True] and chosen([0.1, 0.2], True) == [False, True]
    text = "The bank raised its rates again in spring."
    assert [text[a:b] for a, b in marks(text, "words", [({"w0": 0.9, "w3": 0.1, "w4": 0.2}, None)])] == ["bank"]
    assert marks(text, "words", [({"stated": 0.6, "w0": 0.9}, None)]) == [(0, len(text))]
    assert marks(text, "sentence", [({}, "network")]) == [(0, len(text))] and marks(text, "words", [({}, "network")]) == []
    long = "The council voted late on Monday night to close the bridge for repairs, and the mayor who had asked for it thanked everyone present."
    assert [long[a:b] for a, b in marks(long, "sentence", [({"c0": 0.2, "c1": 0.3}, None)])] == ["and the mayor who had asked for it thanked everyone present."]
    words = " ".join(f"word{i}" for i in range(45))
    found = marks(words, "words", [({"w3": 0.4}, None), ({"w41": 0.36, "w42": 0.9}, None)])  # the best counts within its own request
    assert [words[a:b] for a, b in found] == ["word3", "word42"]


def test_http_judge():
    replies = iter([(503, ""), (200, '{"answers": {"keep_1": {"noul": 1.7}, "kind_1": {"choice": "promo"}, "x": {"noul": "no"}}, "usage": {"input_tokens": 7}}')])
    waits = []
    request = {"request_id": "r", "state": "s", "questions": [{"key": k, "type": "noul", "text": "t", "options": None} for k in ("keep_1", "kind_1", "x")]}
    judge = HttpJudge(lambda body, timeout: next(replies), sleep=waits.append)
    assert judge.reply([request]) == [{"answers": {"keep_1": {"p": 1.0}, "kind_1": {"label": "promo", "confidence": 0.0}}, "error": None, "tokens": 7}] and len(waits) == 1
    with pytest.raises(Refused):
        HttpJudge(lambda body, timeout: (401, ""), sleep=waits.append).reply([request])

    def late(body, timeout):
        raise TimeoutError

    failed = HttpJudge(late, sleep=waits.append)
    assert failed.reply([request])[0]["error"] == "timeout" and len(waits) == 4 and failed.healthcheck() == (False, "timeout")
    assert HttpJudge(lambda body, timeout: (422, "")).reply([request])[0] == {"answers": {}, "error": "status 422", "tokens": 0}
    assert HttpJudge(lambda body, timeout: (200, '{"answers": {}}')).healthcheck() == (True, None)


def test_a_call_that_never_returns_is_a_timeout():
    import threading
    import time

    stuck, calls = threading.Event(), []

    def hangs(body, timeout):
        calls.append(timeout)
        stuck.wait(30)
        return 200, "{}"

    began = time.time()
    request = {"request_id": "r", "state": "s", "questions": [{"key": "k", "type": "noul", "text": "t", "options": None}]}
    assert HttpJudge(hangs, timeout=0.05, retries=2, sleep=lambda s: None).reply([request])[0]["error"] == "timeout"
    assert calls == [0.05] * 3 and time.time() - began < 10
    stuck.set()


def test_settings():
    from gleaner.operators.settings import Hosts, distinct_rules, find_rule

    assert distinct_rules(["  Prices  of bread ", "prices of BREAD", "", "x" * 90], 8) == ["Prices of bread", "x" * 80]
    assert find_rule(["Prices"], "prices ") == "Prices" and find_rule([], "a") is None
    hosts = Hosts()
    assert hosts.switch("www.News.org", False).switch("news.org", True) == hosts and not hosts.enabled("gist.github.com")
    assert hosts.switch("github.com", True).allowed == ("github.com",) and hosts.keep_always("a.org", True).always("b.a.org")
    assert hosts.keep_always("a.org", True).keep_always("a.org", False) == hosts and not hosts.enabled("")


def test_quick_classes_and_quotations_equal_the_plain_ones(spark):
    """Over all characters; a text's stretch behind its last mark is passed once."""
    import time

    from gleaner.functions import quotes
    from gleaner.functions import sqltext as X
    from gleaner.functions.columns import BLANK, BY_CHARACTER, SPACE, among, any_of
    from gleaner.plans import values as V

    every = "".join(chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000)
    one = spark.createDataFrame([(every,)], "x string")
    plain = [SPACE, SPACE.replace(r"\n", "").replace(r"\r", ""), *(any_of(x)[1:-1] for x in (V.SENTENCE_MARKS, V.FLUSH_MARKS, V.CLOSERS, V.OPENERS)), r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"]
    quick = [BLANK, BLANK.replace(r"\n", "").replace(r"\r", ""), *(among(x)[1:-1] for x in (V.SENTENCE_MARKS, V.FLUSH_MARKS, V.CLOSERS, V.OPENERS)), BY_CHARACTER[1:-1]]
    for a, b in zip(plain, quick, strict=True):
        for no in ("", "^"):
            found = one.select(*(X.call("regexp_replace", X.col("x"), f"[{no}{c}]", "").column() for c in (a, b))).first()
            assert found[0] == found[1] and len(found[0]) not in (0, len(every))
    tail = 'He said "yes" and “no”.' + "and so on\n" * 20000
    began = time.time()
    found = spark.createDataFrame([(tail,), ('a "b"',), ("none",), ("",), (None,)], "x string").select(quotes.pairs(X.col("x")).column()).collect()
    assert [[tuple(y) for y in r[0]] for r in found[:2]] == [[(8, 13), (18, 22)], [(2, 5)]] and [r[0] for r in found[2:4]] == [[], []]
    assert time.time() - began < 30
