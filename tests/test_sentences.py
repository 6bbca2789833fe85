"""Sentences, quotations and pages by expressions, against plain Python on random texts and markup."""

import random
import time

import duckdb
import pandas as pd
import pytest

from gleaner.functions import html as H
from gleaner.functions import quotes
from gleaner.functions import sqltext as X
from gleaner.functions import text as T
from gleaner.functions.columns import count_words, running
from gleaner.functions.hashes import fnv1a
from gleaner.functions.sentences import split
from gleaner.plans import oracle_pages
from gleaner.sources.pages import parsed
from tests.test_html import PAGE, PROSE

BITS = ["Dr. ", "Smith ", "came. ", "He ", "i.e. ", "12. ", "3. ", "A. ", "No. ", "no. ", "x", "...", "! ", "。", "彼は", '"', "” ", "“ ", "[1]", " [2]", "\n", "　", "(", "Sig.ra ", "Foo", "bar baz qux ", "• 4. ", "IX. ", "É", "ß", "ǅ", "𝑎bc ", "? ", "one two three four. ", ":", "\xa0", "\r", "U.S. ", ".", "'", ")", "«", "» "]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    fixed = ["", " \n ", "J. K. Miller wrote it down. We read it.", "The house was sold in May. Read more", "Mix the flour well. Done. Then wait an hour.", "It cost 9.99 in all. No. 5 was sold out.", None]
    return fixed + ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]


def test_sentences_equal_python_and_sql(spark, texts):
    got = {r.i: r.s for r in spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", split(X.col("text")).column().alias("s")).collect()}
    assert got == {i: [t[a:b] for a, b in T.split_sentences(t)] if t else [] for i, t in enumerate(texts)}
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    told = duckdb.sql(oracle_pages.document_sentences()).df().sort_values(["doc_id", "sent_id"]).groupby("doc_id").sentence.apply(list).to_dict()
    assert told == {i: s for i, s in got.items() if s}


def test_a_long_line_takes_no_longer_a_character(spark):
    def seconds(n):
        df = spark.createDataFrame([("Short one here. " * n,)], "text string").select(X.call("size", split(X.col("text"))).column().alias("n"))
        began = time.time()
        assert df.first().n == n
        return time.time() - began

    seconds(1000)
    assert seconds(64_000) < 8  # a megabyte; by squares it would be minutes
    began = time.time()
    assert len(T.split_sentences("Short one here. " * 64_000)) == 64_000 and time.time() - began < 20


def test_words_quotations_sums_and_hashes(spark, texts):
    found = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "i long, text string")
    rows = found.select("text", count_words(X.col("text")).column().alias("n"), quotes.pairs(X.col("text")).column().alias("q"), fnv1a(X.col("text")).column().alias("h")).collect()
    for r in rows:
        assert (r.n, sorted((q.a, q.b) for q in r.q), r.h) == (T.count_words(r.text), T.quotations(r.text), T.hash_text(r.text))
    sums = spark.range(1).select(running(X.sequence(1, 1000), X.lit(0).cast("long")).column().alias("r")).first().r
    assert sums == [k * (k + 1) // 2 for k in range(1, 1001)]


def markup(rng):
    words = ["The mill stood by the river.", "It was “old. Very old” they said.", "Buy now!", "Prices: 12 coins", "Note: see the table for all of it", "they came in spring and", "What is it?", "Fig. 2 shows the mill", 'He said "yes. And no" to all of them.', "three things:", "[1]", " ", "\n", "Cells of data are here now.", "An old wooden wheel turned all day and all night for forty years without rest.", "card 4111 1111 1111 1111 is here today.", "Read more"]
    tags = "p p div li ul section table tr td td th form input a b span br h2 nav aside article main figcaption blockquote dl dt dd header strong cite button body".split()
    attributes = [""] * 12 + [' class="comments"', ' class="ad"', ' id="sidebar"', " hidden", ' style="display: none"', ' style="display:none;display:block"', ' role="navigation"', ' role="main"', ' itemprop="review"', ' aria-hidden="true"', " contenteditable", ' class="references"', ' itemtype="https://schema.org/Review"', ' type="hidden"', ' role="Menu x"']

    def text():
        return " ".join(rng.choice(words) for _ in range(rng.randrange(0, 4)))

    def element(depth):
        tag, attribute = rng.choice(tags), rng.choice(attributes)
        inside = "".join(element(depth + 1) if depth < 6 and rng.random() < 0.55 else text() for _ in range(rng.randrange(0, 5)))
        return f"<{tag}{attribute}>" if tag in ("br", "input") else f"<{tag}{attribute}>{inside}" + (f"</{tag}>" if rng.random() < 0.9 else "")

    return "<html>" + rng.choice(["<body>", ""]) + "".join(element(0) for _ in range(rng.randrange(1, 5)))


def test_pages_equal_python(spark):
    rng = random.Random(11)
    pages = [PAGE, "", None, "<div>" * 200 + PROSE + "</div>" * 200, "<article>" + "<p>One sentence stands here now. Another sentence stands here too.</p>" * 650 + "</article>"] + [markup(rng) for _ in range(150)]
    rows = [(i, "https://a.org/x", h) for i, h in enumerate(pages)]
    got = parsed(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).select("page_id", "sentences").collect()
    for r in got:
        want = [(*s, T.carries_account_number(s[2])) for s in H.page_sentences(H.Page(pages[r.page_id] or ""))]
        assert [tuple(s) for s in r.sentences] == want
    assert len(got) == len(pages)


def test_stitching_equals_python(spark):
    from pyspark.sql import functions as S

    from gleaner.operators.stitching import asked_words, stitched

    rng = random.Random(3)
    words = ["the", "rise", "of", "mortgages,", "$5", "and", "7", "higher", "spending.", "(said)", "a", "d’accord", "12%", "—", "bank's", "x", "a long gap of little words in it", "«"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 25))) for _ in range(200)]
    asked = [T.asked_words(t) for t in texts]
    marks = [sorted(rng.sample([(a, b) for a, b, _ in x] + [(max(0, a - 3), b + 4) for a, b, _ in x], len(x))) for x in asked]
    df = spark.createDataFrame(list(zip(range(200), texts, marks, strict=True)), "i long, text string, marks array<struct<a: int, b: int>>")
    rows = df.select("i", asked_words(X.col("text")).column().alias("asked"), "text", "marks").select("i", "asked", stitched(X.col("text"), X.col("marks"), X.col("asked")).column().alias("s")).orderBy(S.col("i")).collect()
    assert [[tuple(w) for w in r.asked] for r in rows] == asked
    assert [[tuple(s) for s in r.s] for r in rows] == [T.stitch(t, m, w) for t, m, w in zip(texts, marks, asked, strict=True)]
