from gleaner.functions import html as H

PAGE = """<html lang="it"><head><title> A  page </title><script type="application/ld+json">{"@graph":[{"@type":["Recipe","Thing"]},{"@type":"Person"}]}</script>
<script type="application/ld+json">{bad</script><meta name="robots" content="noindex"></head><body><nav><p>Home page of all the things here.</p></nav>
<article><h1>Title</h1><p><b>The kettle was on the stove all day.<br>It never boiled over at all.</p><p>Nobody came to look after it, said the cook.</p>
<script>var x = "</p>";</script><div class="ad"><p>Buy the very best kettle in town now.</p></div><ul><li>two cups of cold water</li><li>salt</li></ul>
<p><a href="/a">A link that fills the whole paragraph here.</a></p><p>Multi-Head Kettle</p><p>How much is it?</p><table><tr><th>a</th></tr><tr><td>Cells of data are not prose at all.</td></tr></table>
<p>You will need these things today:</p><p style="display: none">Hidden words are never read by anyone.</p></article><footer><p>All rights of the house are reserved.</p></footer></body></html>"""


def test_main_text_only():
    assert [t for _, _, t in H.sentences(PAGE)] == ["The kettle was on the stove all day.", "It never boiled over at all.", "Nobody came to look after it, said the cook.", "Buy the very best kettle in town now.", "two cups of cold water"]


def test_meta():
    m = H.meta(PAGE)
    assert m["title"] == "A page" and m["lang"] == "it" and m["json_ld_types"] == ["person", "recipe", "thing"] and m["unlisted"] and not m["never"]
    assert H.meta('<input type="password">')["never"] and H.meta("")["title"] == ""


def test_cap_falls_between_blocks():
    page = "<article>" + "<p>One sentence stands here now. Another sentence stands here too.</p>" * 5 + "</article>"
    assert len(H.sentences(page, cap=3)) == 4


def texts(html):
    return [t for _, _, t in H.sentences(html)]


PROSE = "<p>The first mill was built beside the river in spring.</p><p>Its wheel turned day and night for forty years.</p><p>Then the flood came and took the dam away.</p>"


def test_names_count_only_without_a_container_and_for_few_words():
    assert len(texts(f'<body><div class="page-header">{PROSE}</div></body>')) == 3
    assert texts(f'<body><section>{PROSE}</section><div class="cookie"><p>We bake cookies for all of our visitors.</p></div></body>')[-1].startswith("Then")
    readers = '<div class="comments"><p>I would have built it on the hill.</p></div>'
    assert len(texts(f"<article>{PROSE}{readers}</article>")) == 3
    assert len(texts('<article><div itemtype="https://schema.org/Review"><p>Nice mill, I would visit it again.</p></div>' + PROSE + "</article>")) == 3


def test_container_is_the_inner_one_that_holds_the_prose():
    menu = "".join(f'<div><a href="/{i}">A link with many words in it</a></div>' for i in range(30))
    page = f'<body><div id="all"><div>{menu}</div><div id="text">{PROSE}</div></div></body>'
    found = H.Page(page)
    assert found.attr(H.main_container(found), "id") == "text"
    page = f"<body><main><div>{PROSE}</div></main></body>"
    found = H.Page(page)
    assert found.tag[H.main_container(found)] == "main"


def test_layout_blocks_with_blocks_inside_are_dropped():
    page = f"<article>{PROSE}<div>These ten words stand around a block in a layout element.<p>The block inside is prose and stays on.</p></div><div>Eight words of text in a div, no block.</div></article>"
    assert texts(page)[3:] == ["The block inside is prose and stays on.", "Eight words of text in a div, no block."]


def test_labels_stay_in_the_text_and_out_of_the_mark():
    page = H.Page(f"<article>{PROSE}<p><b>Milk:</b> No pancake is complete without it, they say.</p><ul><li>Flour: sift it twice before you begin</li></ul></article>")
    rows = H.page_sentences(page)
    assert [(t[at:], at) for _, _, t, at, _ in rows[3:]] == [("No pancake is complete without it, they say.", 6), ("sift it twice before you begin", 7)]


def test_items_behind_a_colon_are_its_rest():
    page = f"<article>{PROSE}<p>The mill needed three things every year:</p><ul><li>a new belt of good leather</li><li>A carpenter came in May to look at it.</li></ul></article>"
    assert texts(page)[3:] == ["A carpenter came in May to look at it."]


def test_quotations_tie_sentences():
    rows = H.page_sentences(H.Page(f"<article>{PROSE}<p>He said: “We will build it again. It will stand higher.” Nobody spoke for a while.</p></article>"))
    assert [q for *_, q in rows] == [None, None, None, 3, 3, None]


def test_pages_of_any_depth():
    assert len(texts("<div>" * 5000 + PROSE + "</div>" * 5000)) == 3
    assert H.json_types("[" * 5000) == set()


def test_private_pages():
    fields = "".join(f'<input autocomplete="{x}">' for x in ("given-name", "street-address", "section-a tel"))
    m = H.meta(f'<meta name="robots" content="noindex, follow"><form>{fields}</form><a href="/user/logout?x=1">bye</a>')
    assert m["personal_form"] and m["unlisted"] and m["signed_in"] and not m["never"]
    assert H.meta('<input autocomplete="cc-number">')["never"] and not H.meta("<a>Log outside</a>")["signed_in"]
    assert H.meta("<div contenteditable>" + "x" * 201 + "</div>")["app_like"] and H.meta("<body>" + "<input type=text>" * 31)["app_like"]
    assert not H.meta("<body>" + "<input type=checkbox>" * 31)["app_like"]


def test_states_of_the_variants():
    from gleaner.operators import evaluate as E

    page = H.Page("<article><h2>One</h2>" + "".join(f"<p>Sentence {i} belongs to the first part.</p>" for i in range(4)) + "<h2>Two</h2><p>The fifth one stands below another heading.</p></article>")
    found = E.headed(page)
    assert [h for _, _, h in found] == ["One"] * 4 + ["Two"]
    by = {v: E.states(found, v, 2) for v in E.VARIANTS}
    assert [s["text"].count("Sentence") for _, s in by["chunk"]] == [2, 2, 0] and by["none"][0][1] == {}
    assert "text_just_before" not in by["window"][0][1] and by["window"][2][1]["text_just_before"].count("Sentence") == 4
    assert all(s["text"].count("Sentence") == 4 for _, s in by["page"]) and by["full"][0][1]["text"].startswith("## One") and "## Two" in by["full"][0][1]["text"]
    assert by["outline"][2][1]["headings"] == "One | Two" and by["outline"][2][1]["text"].startswith("## Two")
    assert sum(len(s["text"].split(".")) - 1 for _, s in by["shift"]) == 5 and len(by["shift"]) == 4
    assert E.around([10] * 9, slice(4, 5), 30) == slice(3, 6)


def test_pages_of_one_row_group_are_dealt_evenly(spark, tmp_path):
    """A file is split by bytes, but one task reads a row group."""
    import pyarrow.parquet as pq

    from gleaner.sources.pages import pages

    table = pq.read_table("/root/testdata/sf0.01/pages.parquet")
    pq.write_table(table, tmp_path / "pages.parquet")
    conf = {"spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = pages(spark, str(tmp_path))
        dealt = [len(x) for x in found.select("page_id").rdd.glom().collect()]
        kept = [u for u in table["url"].to_pylist() if u and u.startswith(("http:", "https:"))]
        assert sum(dealt) == len(kept) and max(dealt) < 0.4 * sum(dealt)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
