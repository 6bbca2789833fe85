from gleaner.operators import cached
from gleaner.operators.judge import StubJudge
from gleaner.operators.pipeline import guarded


class Silent(StubJudge):
    """Answers nothing: a page that is asked fails."""

    def reply(self, requests):
        return [{"answers": {}, "error": "network", "tokens": 0} for _ in requests]


def test_what_is_known_is_not_asked(spark, tmp_path):
    prose = "".join(f"<p>Sentence number {i} of this page stands on its own here.</p>" for i in range(40))
    other = prose.replace("stands", "lies")
    rows = [(1, "https://a.org/x", f"<article>{prose}</article>"), (2, "https://b.org/y", f"<main>{prose}</main>"), (3, "https://a.org/z", f"<article>{other}</article>"), (4, "https://a.org/s", "<p>Too little text.</p>")]
    found = guarded(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()
    store = cached.page_store(spark, str(tmp_path / "pages"))
    run = lambda judge, tick, pages="true", capacity=400: {r.page_id: r for r in cached.counts(cached.judge_cached(found.where(pages), judge, store, tick, capacity)).collect()}
    failed = run(Silent(), 1, "page_id = 1")
    assert (failed[1].failed, failed[1].requests) == (40, 2) and store.size() == 0  # what failed stays out
    one = run(StubJudge(), 2, "page_id = 1")
    assert (one[1].cached, one[1].requests, one[1].kept + one[1].faded) == (False, 2, 40) and store.size() == 1
    two = run(StubJudge(), 3)
    assert [(two[i].cached, two[i].requests) for i in (1, 2, 3, 4)] == [(True, 0), (True, 0), (False, 2), (False, 0)] and two[2].kept == two[1].kept == one[1].kept
    three = run(Silent(), 4, "page_id < 4")  # nothing is asked, so nothing fails
    assert all(r.cached and r.requests == 0 and r.failed == 0 for r in three.values()) and three[3].kept == two[3].kept
    run(Silent(), 5, "page_id = 3", capacity=1)  # the least recently used page goes
    assert [r.tick for r in store.read().collect()] == [5]
    assert run(StubJudge(), 6, "page_id = 1")[1].requests == 2
