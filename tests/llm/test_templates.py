"""Text that stands on most pages of a host."""

import random

from riverseed.llm import html_extract


def texts(spark, pages):
    rows = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_extract.main_text(rows).orderBy("page_id").collect()]


def test_equal_pages_and_repeated_headings_keep_their_text(spark):
    page = lambda body: f"<html><body><div id=top><p>Home</p></div><div id=text>{body}</div></body></html>"
    same = page("<h2>One</h2><p>the article</p>")
    assert texts(spark, [same] * 20) == ["Home\nOne\nthe article"] * 20
    # two distinct pages show the slot; what both have outside it is the template's
    assert texts(spark, [same] * 20 + [page("<p>other</p>")]) == ["One\nthe article"] * 20 + ["other"]
    # headings in slots stay, with and without an article element; what stands outside goes
    bodies = [f"<h2>Summary</h2><p>text {i}</p><div><p>Details</p></div>" for i in range(20)]
    assert texts(spark, map(page, bodies)) == [f"Summary\ntext {i}\nDetails" for i in range(20)]
    articles = [page(f"<article><h2>Summary</h2><p>text {i}</p></article>") for i in range(20)]
    assert texts(spark, articles) == [f"Summary\ntext {i}" for i in range(20)]
    # nearly all pages one article, told apart by a comment: the other page shows the slot
    near = [page(f"<!-- {i} --><p>the article</p>") for i in range(19)] + [page("<p>other</p>")]
    assert texts(spark, near) == ["the article"] * 19 + ["other"]


def test_slots_of_generated_templates(spark):
    """Hosts whose markup tells nothing: menus, notices, side texts that change from page to
    page and footers in nameless elements. The articles come out, and only by the templates."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], []
    for host, n in enumerate([2, 3, 5, 12, 40]):
        marks = [f"x{rng.randrange(10**6)}" for _ in range(5)]
        menu, foot = [word() for _ in range(rng.randrange(3, 9))], line(6)
        for _ in range(n):
            title, body = line(5), [line(rng.randrange(8, 40)) for _ in range(rng.randrange(3, 9))]
            parts = [f"<p>{x}</p>" for x in body]
            article = f"<h1>{title}</h1>" + "".join(parts) if host % 2 else f"<h1>{title}</h1><div id={marks[4]}>{''.join(parts)}</div>"
            html = f"<html><head><title>{title}</title></head><body><div id={marks[0]}>" + "".join(f"<p><a href=/{x}>{x}</a></p>" for x in menu) + f"</div><div id={marks[1]}><p>{line(4)}</p></div><div id={marks[2]}>{article}</div><div id={marks[3]}>{foot}</div></body></html>"
            for _ in range(rng.choice([1, 1, 3])):
                rows.append((len(rows), f"http://h{host}/{len(rows)}", html))
                want.append("\n".join([title, *body]))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    assert [got[i] for i in range(len(rows))] == want
    none = html_extract.main_text(pages, html_extract.deduce_templates(pages).where("false"))
    assert all(r.text != want[r.page_id] for r in none.collect())
    # dealt by host, the largest one split
    html_extract.BROADCAST_TOKENS = 0
    assert {r.page_id: r.text for r in html_extract.main_text(pages).collect()} == got
    html_extract.BROADCAST_TOKENS = 500_000


def test_regions():
    region = lambda p: html_extract.content_region({k: (n, h, True) for k, n, h in p})
    body, a, b = "/html/body", "/html/body/div[id=a]", "/html/body/div[id=b]"
    assert region([("", 0, 0), (body, 5, 0), (a, 100, 9), (b, 20, 0)]) == a
    assert region([("", 0, 0), (body, 9, 9), (a, 100, 0)]) == ""  # the heading stands outside
    assert region([("", 0, 0), (body, 9, 9), ("/html/body/article", 60, 0), ("/html/body/article/div", 60, 0)]) == "/html/body/article"
    assert region([("", 50, 0), (a, 50, 0)]) == "" and region([]) == ""
    assert html_extract.content_region({"": (0, 0, True), a: (90, 0, False)}) == ""


def test_crossing_classes():
    assert html_extract.crossing([1, 2, 2, 1, 3, 3], {1: 2, 2: 2, 3: 2}) == set()
    assert html_extract.crossing([1, 2, 1, 2, 2], {1: 2, 2: 3}) == {1}
    assert html_extract.crossing([1, 2, 3, 1, 3, 2, 1], {1: 3, 2: 2, 3: 2}) == {2, 3}
    assert html_extract.crossing([1, 2, 3, 3, 2, 1], {1: 2, 2: 2, 3: 2}) == set()


def test_extraction_with_clashing_columns_and_nulls(spark):
    from pyspark.sql import functions as F

    rows = [(i, "http://h/x", f"<div id=m><p>menu</p></div><div id=c><p>body {i}</p></div>") for i in range(6)] + [(None, None, None), (7, "http://y/", ""), (8, None, "<p>x"), (9, "http://z/", "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "role", "text", "classes", "slots", "region", "bad", "path", "pages", "digest")})
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    assert got == {**{i: f"body {i}" for i in range(6)}, None: "", 7: "", 8: "x", 9: ("long " * 50_000).strip()}
