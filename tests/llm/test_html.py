"""Main text of pages, with and without templates."""

import random
import time

import pytest

from kinweave.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav>menu</nav><div class="ad">Buy</div><div class="cookie-notice">We use</div>
<article><h1>Ti&amp;tle</h1><p><b>One  two.<br><p>Three <i>fo</i>ur</p><ul><li>a<li>b</ul><aside>side</aside>
<div class="comments"><p>nice</p></div><p>tail &copy; x<script>no()</script> y</p><!-- <p>gone</p> --></article>
<form>f<input></form><footer>foot</footer></body></html>"""


@pytest.mark.parametrize("source,want", [
    (PAGE, ["Ti&tle", "One two.", "Three four", "a", "b", "tail © x y"]),
    (None, []), ("", []), ("plain &lt; text <", ["plain < text <"]), ("<p>a<p>b <div>c</div>d", ["a", "b", "c", "d"]),
    ("<main><p>x</p></main><p>out</p>", ["x"]), ("<article><p>cut off <b>he", ["cut off he"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("<script>a<b", []),
    ("<p title='x>y'>ok</p><p title=\"broken>z</p>", ["ok", "z"]), ("a<style>p{}</style>b", ["ab"]),
])
def test_blocks(source, want):
    assert html_text.main_blocks(source, 0, set(), set(), None) == want


def pages(spark):
    rows = []
    for k in range(12):
        body = "".join(f"<p>Body {k} line {i}, long enough to be the text of the page.</p>" for i in range(8))
        rows.append((k, f"http://a.org/{k}", f"<body><div id=top>Our site</div><div class=x7>{body}</div><div>All rights kept</div></body>"))
    rows += [(100, "http://b.org/", PAGE), (101, None, PAGE), (102, None, None), (103, "", ""), (104, "http://a.org/1", None)]
    return spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string").selectExpr("*", "1 AS pages", "'t' AS main_text")


def test_template_texts_go(spark):
    got = {r["page_id"]: r["main_text"] for r in html_text.extract(pages(spark)).collect()}
    for k in range(12):
        assert got[k].split("\n") == [f"Body {k} line {i}, long enough to be the text of the page." for i in range(8)]
    assert got[100] == got[101] == "Ti&tle\nOne two.\nThree four\na\nb\ntail © x y"
    assert got[102] == got[103] == got[104] == ""


def name_of(*labels):
    code = 0
    for label in labels:
        code = html_text.step(code, label)
    return code


def test_classes_share_their_vectors(spark):
    rows = {r["_kw_host"]: r for r in html_text.templates(pages(spark)).collect()}
    known = set(rows["a.org"]["tokens"])
    for path in (["body"], ["body", "div.x0"], ["body", "div#top"], ["body", "div"]):
        assert html_text._signed(name_of(*path)) in known
    assert html_text._signed(html_text.text_token(name_of("body", "div#top"), "Our site")) in known
    line = html_text.text_token(name_of("body", "div.x0", "p"), "Body 3 line 1, long enough to be the text of the page.")
    assert html_text._signed(line) not in known
    assert rows["a.org"]["root"] == html_text._signed(name_of("body", "div.x0"))


def brute_templates(sources):
    """Tokens of valid classes and the root of one host, from whole occurrence vectors."""
    different = sorted({s or "" for s in sources})
    vectors, facts, total = {}, {}, 0
    for k, source in enumerate(different):
        for t in html_text._page_tokens(source):
            vectors.setdefault(t["token"], [0] * len(different))[k] += t["n"]
            old = facts.get(t["token"], (0, 0, 0))
            facts[t["token"]] = (max(old[0], t["depth"]), max(old[1], t["container"]), old[2] + t["chars"])
    total = facts[0][2]
    classes = {}
    for token, vector in vectors.items():
        if 2 * sum(v > 0 for v in vector) >= len(different) and (sum(v > 0 for v in vector) > 1 or facts[token][0] > 0 or token == 0):
            classes.setdefault(tuple(vector), []).append(token)
    valid = [c for c in classes.values() if len(c) >= 2]
    roots = [(facts[t][0], t) for c in valid for t in c if facts[t][1] and total and facts[t][2] >= 0.9 * total]
    return {t for c in valid for t in c}, max(roots)[1] if roots else None


def test_templates_equal_whole_vectors(spark):
    draw = random.Random(3)
    rows = []
    for host in range(6):
        layout = [f"<div class={draw.choice('uvw')}><p>{draw.choice(['Our site', 'All rights', 'Contact us'])}</p></div>" for _ in range(4)]
        for k in range(draw.randrange(2, 9)):
            middle = "".join(f"<p>line {draw.randrange(40)} of the text here</p>" for _ in range(draw.randrange(1, 9)))
            some = [x for x in layout if draw.random() < 0.9]
            html = f"<body>{''.join(some[:2])}<div class=main><section>{middle}</section></div>{''.join(some[2:])}</body>"
            rows += [(f"http://h{host}.org/{k}", html)] * draw.randrange(1, 3)
    got = {r["_kw_host"]: r for r in html_text.templates(spark.createDataFrame(rows, "url string, html string")).collect()}
    for host in range(6):
        tokens, root = brute_templates([h for u, h in rows if u.startswith(f"http://h{host}.")])
        assert set(got[f"h{host}.org"]["tokens"]) == tokens and got[f"h{host}.org"]["root"] == root


def extracted(spark, bodies):
    rows = [(k, f"http://site.org/{k}", body) for k, body in enumerate(bodies)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r["main_text"] for r in html_text.extract(df).orderBy("page_id").collect()]


def lines(k, n=6):
    return [f"Page {k} tells in line {i} what nobody else tells." for i in range(n)]


def test_boxes_repeated_inside_articles_go(spark):
    """An author box without a telling name stands in the article of every page."""
    box = "<div class=qq><p>Written by the staff of the site.</p><p>Call us any time.</p></div>"
    got = extracted(spark, [f"<body><article>{''.join(f'<p>{x}</p>' for x in lines(k))}{box}</article></body>" for k in range(8)])
    assert got == ["\n".join(lines(k)) for k in range(8)]


def test_teasers_are_not_the_article(spark):
    card = "<article class=card><p>Read this too</p></article>"
    got = extracted(spark, [f"<body><div class=text>{''.join(f'<p>{x}</p>' for x in lines(k))}</div>{card}</body>" for k in range(8)])
    assert all(set(lines(k)) <= set(t.split("\n")) for k, t in enumerate(got))
    several = [f"<body><article>{''.join(f'<p>{x}</p>' for x in lines(k))}</article><article><p>Teaser {k}</p></article></body>" for k in range(8)]
    assert extracted(spark, several) == ["\n".join(lines(k)) for k in range(8)]
    two = [f"<body><article><p>{lines(k)[0]}</p></article><article><p>{lines(k)[1]}</p></article></body>" for k in range(3)]
    assert extracted(spark, two) == ["\n".join(lines(k)[:2]) for k in range(3)]


def test_names_and_forms_of_content_stay(spark):
    page = ("<body><form id=aspnetForm><article><h1>Title</h1><section class='social-studies'><p>About schools.</p></section>"
            "<section id='reply'><p>The answer given.</p></section><div class='comments'>nice</div></article></form><form>search</form></body>")
    assert extracted(spark, [page]) == ["Title\nAbout schools.\nThe answer given."]


def test_equal_pages_are_no_template(spark):
    same = f"<body><article>{''.join(f'<p>{x}</p>' for x in lines(1))}</article></body>"
    assert extracted(spark, [same] * 9) == ["\n".join(lines(1))] * 9


def test_deep_and_long_pages_take_linear_time():
    for page in ("<div>x" * 50_000, "<body>" + "<span>" * 50_000 + "<li>x" * 50_000 + "</b>" * 50_000):
        begin = time.process_time()
        tokens = html_text._page_tokens(page)
        found = html_text.main_blocks(page, 5, set(), set(), tokens[1]["token"])
        assert len(found) == 50_000 and time.process_time() - begin < 5


def test_rows_and_empty(spark):
    df = pages(spark)
    assert html_text.extract(df).count() == df.count()
    assert html_text.extract(df.limit(0)).count() == 0
