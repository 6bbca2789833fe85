from gleaner.operators import cache as C
from gleaner.sources.store import Store


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "units"), "term string, unit string, seq long", ["term"])
    assert store.size() == 0
    store.upsert(spark.createDataFrame([("a", "words", 1), ("b", "words", 2)], store.schema), "seq")
    store.upsert(spark.createDataFrame([("a", "sentence", 3), ("a", "words", 2)], store.schema), "seq")
    assert {(r.term, r.unit) for r in store.read().collect()} == {("a", "sentence"), ("b", "words")}
    store.remove("term = 'b'")
    assert store.size() == 1 and len(store.versions()) == 2
    store.clear()
    assert store.size() == 0


def test_cache(spark):
    columns = "content_hash string, tick long, page_kind string"
    pages = spark.createDataFrame([("a", 1, "recipe"), ("b", 2, "legal"), ("c", 3, "other")], columns)
    new = spark.createDataFrame([("d", 4, "docs", 5), ("e", 5, "docs", 0), ("a", 6, "paper", 1)], columns + ", judged int")
    assert {(r.content_hash, r.page_kind) for r in C.put(pages, new, 3).collect()} == {("a", "paper"), ("d", "docs"), ("c", "other")}
    assert {r.content_hash for r in C.after_refusal(pages).collect()} == {"b", "c"}
    hits, moved = C.looked_up(pages, spark.createDataFrame([("a", 9), ("z", 9)], "content_hash string, tick long"))
    assert {(r.content_hash, r.cached) for r in hits.collect()} == {("a", True), ("z", False)} and {(r.content_hash, r.tick) for r in moved.collect()} == {("a", 9), ("b", 2), ("c", 3)}
    of = "content_hash string, rule string, sent_id int, p double"
    rules = C.merged_rules(pages, spark.createDataFrame([("a", "x", 0, 0.1), ("a", "x", 1, 0.2), ("b", "x", 0, 0.3)], of), spark.createDataFrame([("a", "x", 0, 0.9), ("z", "x", 0, 0.9)], of))
    assert sorted((r.content_hash, r.sent_id, r.p) for r in rules.collect()) == [("a", 0, 0.9), ("b", 0, 0.3)]
    of = "content_hash string, term string, sent_id int, span_no int, start int, end int, version int"
    spans = C.merged_highlights(pages, spark.createDataFrame([("a", "x", 0, 0, 1, 2, 4), ("b", "x", 0, 0, 1, 2, 5)], of), spark.createDataFrame([("c", "x", 0, 0, 3, 4, 5)], of))
    assert {r.content_hash for r in spans.collect()} == {"b", "c"}
    judged = spark.createDataFrame([("a", 0, False, True), ("a", 1, True, True), ("b", 0, False, True), ("c", 5, False, False)], "content_hash string, sent_id int, failed boolean, full_page boolean")
    assert [r.content_hash for r in C.admitted(judged).collect()] == ["b"]
    log = spark.createDataFrame([("a", 1, "s"), ("b", 2, "s"), ("a", 3, "t"), ("c", 4, "s")], "content_hash string, tick long, text string")
    assert {(r.content_hash, r.text) for r in C.recent(log, 2).collect()} == {("a", "t"), ("c", "s")}
    assert C.missing(spark.createDataFrame([("a", "x"), ("a", "y")], "content_hash string, rule string"), rules, ["content_hash", "rule"]).count() == 1
