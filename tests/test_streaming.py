import datetime as dt

from gleaner.plans import values as V
from gleaner.streaming import revisions as R


def at(ms):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=ms)


def run(stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_debounce(spark, tmp_path):
    rows = [(1, 1, at(0), "a"), (1, 1, at(300), "b"), (1, 1, at(5000), "c"), (2, 1, at(100), "x")]
    spark.createDataFrame(rows, "page_id long, generation int, rev_ts timestamp, html string").coalesce(1).write.parquet(str(tmp_path / "rev"))
    stream = spark.readStream.schema("page_id long, generation int, rev_ts timestamp, html string").parquet(str(tmp_path / "rev"))
    run(R.debounced(stream), "bursts", "complete", tmp_path)
    assert {(r.page_id, r.html, r.changes) for r in spark.table("bursts").collect()} == {(1, "b", 2), (1, "c", 1), (2, "x", 1)}


def blocks(*names, sentences=1):
    return [(i, [f"{name} {k} is a sentence." for k in range(sentences)]) for i, name in enumerate(names)]


def started(n=9):
    view = R.View()
    assert view.revise(0, "https://a.org/#top", blocks(*"abcdefghi"[:n]), 500, 0, False)[0][0] == "start"
    return view


def test_new_and_changed_text_is_asked_at_intervals():
    view = started()
    now = blocks(*"abcdefghi", "new")
    assert view.revise(1000, "https://a.org/", now, 520, 0, False) == [("more", 1, [9], ["new 0 is a sentence."])]
    now[0] = (0, ["A changed first block."])
    assert view.revise(2000, "https://a.org/", now, 520, 0, False) == [("retire", 0, [0], [])] and view.timer() == 6000
    now.append((77, ["Card 4111 1111 1111 1111 is never asked.", "This one is."]))
    assert view.revise(3000, "https://a.org/", now, 540, 0, False) == []
    assert view.due(6000) == [("more", 2, [10, 12], ["A changed first block.", "This one is."])] and view.timer() is None
    assert view.revise(9000, "https://a.org/", now, 540, 0, False) == []  # nothing new


def test_budget():
    view = started()
    now = blocks(*"abcdefghi")
    asked = 0
    for i in range(20):
        now = [*now, (100 + i, [f"Sentence {i} came later."])]
        asked += len(view.revise(10_000 * (i + 1), "https://a.org/", now, 600, 0, False))
    assert asked == V.REQUEST_BUDGET and view.pool == []


def test_views_start_over():
    for url, inside, outside, hidden in (("https://a.org/other", 500, 0, False), ("https://a.org/", 500, 0, True), ("https://a.org/", 500, 2001, False)):
        view = started()
        actions = view.revise(1000, url, blocks(*"abcdefghi"), inside, outside, hidden)
        assert [a[0] for a in actions] == ["restart", "start"] and view.generation == 2 and actions[1][2] == list(range(9))
    view = started()
    assert view.revise(1000, "https://a.org/#part", blocks(*"abcdefghi"), 500, 2000, False) == []


def test_growing_pages_are_tried_again_a_few_times():
    view = R.View()
    assert view.revise(0, "https://a.org/", blocks("a"), 10, 0, False)[0][0] == "skip"
    assert view.revise(1, "https://a.org/", blocks("a"), 10, 0, False) == []  # unchanged
    tries = [view.revise(i, "https://a.org/", blocks("a"), 10 + i, 0, False) for i in range(1, 12)]
    assert sum(bool(x) for x in tries) == V.GROWTH_RETRIES
    grown = R.View()
    grown.revise(0, "https://a.org/", blocks("a"), 10, 0, False)
    assert grown.revise(1, "https://a.org/", blocks(*"abcdefgh"), 300, 0, False)[0][0] == "start"


def test_page_views_as_a_stream(spark, tmp_path):
    schema = R.REVISION

    def revision(ms, *names, page=1):
        return (page, at(ms), "https://a.org/", [{"block_id": b, "sentences": s} for b, s in blocks(*names)], 500, 0, False)

    batches = [[revision(0, *"abcdefghi")], [revision(1000, *"abcdefghi", "j"), revision(2000, *"abcdefghi", "j", "k")], [revision(60_000, *"abcdefghi", page=2)], [revision(90_000, *"abcdefghi", page=3)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/b=*"))
    run(R.page_views(stream), "views", "append", tmp_path)
    mine = spark.table("views").where("page_id = 1").orderBy("at_ms").collect()
    start = int(at(0).timestamp() * 1000)
    # the last sentence waits for its interval and goes out by the timer, though this page has no later revision
    assert [(r.action, r.at_ms - start, list(r.ids)) for r in mine] == [("start", 0, list(range(9))), ("more", 1000, [9]), ("more", 6000, [10])]


def test_progress_fence_and_merge(spark, tmp_path):
    schema = "page_id long, generation int, sent_id int, keep double"
    for i, rows in enumerate(([(1, 1, 0, 0.9), (1, 1, 1, 0.1)], [(1, 1, 2, 0.5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"chunks/b={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "chunks/b=*"))
    run(R.progress(stream), "growing", "update", tmp_path)
    assert sorted((r.total, r.kept) for r in spark.table("growing").collect()) == [(2, 1), (3, 2)]
    replies = spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "page_id long, generation int, x string")
    assert [r.x for r in R.fenced(replies, spark.createDataFrame([(1, 2)], "page_id long, generation int")).collect()] == ["new"]
    columns = "page_id long, rule string, sent_id int, p double"
    merged = R.merged_rules(spark.createDataFrame([(1, "a", 0, 0.1), (1, "a", 1, 0.2)], columns), spark.createDataFrame([(1, "a", 1, 0.9), (1, "a", 2, 0.3)], columns))
    assert sorted((r.sent_id, r.p) for r in merged.collect()) == [(0, 0.1), (1, 0.9), (2, 0.3)]


def test_from_a_folder_of_revisions_to_settled_blocks(spark, tmp_path):
    prose = "".join(f"<p>Sentence number {i} of this page stands on its own here.</p>" for i in range(3))
    rows = [(1, 1, at(0), "https://a.org/", "<p>old</p>"), (1, 1, at(200), "https://a.org/#x", f"<body><article>{prose}</article><div>Outside text.</div></body>"), (2, 1, at(60_000), "https://b.org/", "")]
    spark.createDataFrame(rows, "page_id long, generation int, rev_ts timestamp, url string, html string").coalesce(1).write.parquet(str(tmp_path / "in"))
    run(R.debounced(R.change_source(spark, str(tmp_path / "in"))), "calm", "append", tmp_path)
    got = R.settled(spark.table("calm")).collect()
    assert [(r.page_id, r.url, [len(b.sentences) for b in r.blocks], r.outside_chars) for r in got] == [(1, "https://a.org/#x", [1, 1, 1], 12)]
