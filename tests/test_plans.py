import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from gleaner import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("-" if pd.isna(x) else repr(round(float(x), 9)) if isinstance(x, int | float) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x) for x in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SMALL).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_entry_and_page_pipeline(spark):
    report = entry.entry(spark).toPandas()
    done = report[report.status == "done"]
    assert len(done) and (done.kept + done.faded == done.total).all() and (done.failed == 0).all() and done.page_kind.notna().all()
    from gleaner.operators.pipeline import guarded, requests
    from gleaner.sources.pages import pages

    sent = requests(guarded(pages(spark, SMALL))).toPandas()
    assert not sent.state.str.contains("http").any() and sent.part.map(len).max() <= 30
    sizes = sent.assign(n=sent.part.map(len)).groupby("page_id").n
    assert (sizes.max() - sizes.min() <= 1).all()
    spans = catalog.queries()["judge_highlights"](spark, SMALL).toPandas()
    assert len(spans) and (spans.start < spans.end).all()


def test_guards_and_routing(spark):
    from gleaner.operators.judge import StubJudge
    from gleaner.operators.pipeline import guarded, judge_rules, page_reports

    prose = "".join(f"<p>Sentence number {i} of this page stands on its own here.</p>" for i in range(12))
    card = "<p>My card is 4111 1111 1111 1111 as you know.</p>"
    rows = [
        (1, "https://a.org/x", f"<body><article>{prose}</article></body>"),
        (2, "https://mail.google.com/x", f"<body><article>{prose}</article></body>"),
        (3, "https://a.org/account/x.html", f"<body><article>{prose}</article></body>"),
        (4, "https://a.org/x", f'<body><input type="password"><article>{prose}</article></body>'),
        (5, "https://a.org/x", f"<body><article>{prose[:120]}</article></body>"),
        (6, "https://a.org/x", f"<body><article>{prose}{card * 3}</article></body>"),
        (7, "https://a.org/x", f"<body><article>{prose}</article>{'<input type=text>' * 40}</body>"),
        (8, "https://a.org/y", f'<script type="application/ld+json">{{"@type": ["Recipe"]}}</script><body><article>{prose}{card}</article></body>'),
    ]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in page_reports(guarded(docs), StubJudge()).collect()}
    assert [got[i].status for i in range(1, 9)] == ["done", "disabled", "held", "skipped", "skipped", "held", "skipped", "done"]
    assert (got[3].reason, got[6].reason, got[5].reason, got[7].reason) == ("private-path:account", "account-numbers", "too little text", "looks like an app")
    assert got[8].pack == "recipe" and got[1].pack == "other" and got[8].total == 12 and got[2].total == 0 and got[2].page_kind is None
    asked = {r.page_id: r.status for r in guarded(docs, mode="click", asked=True).collect()}
    assert asked[3] == asked[6] == "judging" and asked[4] == "skipped"
    assert {r.status for r in guarded(docs.where("page_id = 1"), mode="click").collect()} == {"ready"}
    assert {r.status for r in guarded(docs.where("page_id = 1"), mode="click", always=["a.org"]).collect()} == {"judging"}

    class Broken(StubJudge):
        def reply(self, requests):
            return [{"answers": {}, "error": "timeout", "tokens": 0} for _ in requests]

    failed = page_reports(guarded(docs.where("page_id = 1")), Broken()).first()
    assert (failed.status, failed.reason, failed.failed) == ("error", "network", 12)
    rules = judge_rules(guarded(docs.where("page_id = 1")), ["a", "A", "b"], StubJudge()).toPandas()
    assert len(rules) == 24 and set(rules.rule) == {"a", "b"}
    silent = judge_rules(guarded(docs.where("page_id = 1")), ["a"], Broken()).toPandas()
    assert len(silent) == 12 and silent.rule.isna().all()


def on_events(spark, name, rows):
    """The rows of a plan over a few events, by its first column."""
    from gleaner.plans import sql
    from gleaner.plans.dialect import Spark

    assert any("events.parquet" in f for f in catalog.queries()[name](spark, SMALL).inputFiles())
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").createOrReplaceTempView("events")
    return {r[0]: tuple(r[1:]) for r in spark.sql(sql.PLANS[name](Spark())).collect()}


def test_normalize_colour_reads_events(spark):
    kinds = ["view", "click", "error", "purchase", "red", "#abc", "#A1B2C3", "#12345", None]
    got = on_events(spark, "normalize_colour", [(i, None, 1, kind, None, None) for i, kind in enumerate(kinds)])
    # md5 of 0, 1 and 2 begins with cfcd20, c4ca42 and c81e72
    assert got[0] == ("#cfc", "#ccffcc") and got[1] == ("#C4CA42", "#c4ca42") and got[2] == ("#c81e72", "#c81e72") and got[3][1] == "#ffe066"
    assert [got[i][1] for i in range(4, 9)] == ["#ffe066", "#aabbcc", "#a1b2c3", "#ffe066", "#ffe066"]


def test_rule_chunk_size_reads_events(spark):
    from datetime import datetime

    sizes = {1: 30, 2: 30, 3: 20, 5: 12, 8: 7, 70: 1}
    got = on_events(spark, "rule_chunk_size", [(i, datetime(1970, 1, 2, 23, 59), n, "view", None, None) for n in sizes for i in range(n)])
    assert got == {n: (1, n, size) for n, size in sizes.items()}


def test_threshold_migration_reads_events(spark):
    rows = [(1, 3, 50.0), (2, 4, 35.0), (3, 3, 35.0), (4, 5, 50.0), (5, 3, 49.6), (6, 4, None)]
    got = on_events(spark, "threshold_migration", [(i, None, user, "view", value, None) for i, user, value in rows])
    assert got == {1: (0.25,), 2: (0.25,), 3: (0.35,), 4: (0.5,), 5: (0.25,), 6: (None,)}


def test_validate_settings_reads_events(spark):
    rows = [(1, "auto", 5.0), (2, "click", 200.0), (3, "never", 44.6), (4, None, None), (5, "error", 44.6), (6, "signup", 44.6)]
    got = on_events(spark, "validate_settings", [(i, None, 1, kind, value, None) for i, kind, value in rows])
    assert got == {1: (0.1, 10, "auto"), 2: (0.9, 120, "click"), 3: (0.446, 45, "auto"), 4: (0.25, 30, "auto"), 5: (0.25, 45, "auto"), 6: (0.446, 30, "auto")}


def test_highlights_are_asked_and_read_where_their_sentence_is(spark):
    """One shuffle, for the cap; rows of one page and place with different texts keep their own answers."""
    from gleaner.operators.highlights import located, marks, work_of
    from gleaner.operators.judge import ROWS, StubJudge

    class Counted(StubJudge):
        def reply(self, requests):
            assert len(requests) <= ROWS
            return super().reply(requests)

    long = " ".join(f"Word{i}, the bank of number {i} pays {7 * i} euros for it;" for i in range(90))
    texts = [(1, 0, "A bank lends money to the people of the town."), (1, 0, "The mayor paid 300 euros for one old car."), (2, 0, long), (2, 1, "to be or not"), *((3, i, f"{i} {long}") for i in range(40))]
    units = {"costs": "words", "names": "sentence"}
    gate = spark.createDataFrame([(p, "t", "en", "other", s, x, term, 0.9) for p, s, x in texts for term in units], "page_id long, title string, lang string, pack string, sent_id int, text string, item string, p double")
    got = located(gate, units, Counted())
    expected = []
    for page, sent, text in texts:
        for term, unit in units.items():
            replies = [({q["key"]: StubJudge().answer(q)["p"] for q in asked}, None) for asked in work_of(term, text, unit)]
            expected += [(page, sent, term, a, b) for a, b in (marks(text, unit, replies) if replies else [])]
    assert sorted(map(tuple, got.collect())) == sorted(expected) and expected
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1
