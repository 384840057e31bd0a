"""HTML extraction: hand-made pages, odd rows, and the window rule against a plain version."""

import random

from pitchlake.llm import html

LONG = "This is a sentence of the article that is long enough to be text, and no menu has it."


def page(body):
    return f"<html><head><title>t</title><script>var a = '<p>no</p>';</script></head><body>{body}</body></html>"


def brute(lines, marked, window, surge, share):
    """Stretches of lines whose windows hold something, from the text before the first surge on; line by line."""
    weight = []
    for text, own, furniture, inside in lines:
        w = own if own * 2 >= len(text) and not furniture else 0
        weight.append(w * (1.0 if inside or not marked else html.OUTSIDE))
    sums = [sum(weight[i : i + window]) for i in range(len(lines))]
    least = max([1.0, min([surge, share * max(sums, default=0)])])
    take, state = set(), "out"
    for i in range(len(lines)):
        if state == "in" and not sums[i]:
            state = "out"
        elif state == "out" and sums[i] >= least and weight[i]:
            state = "in"
            k = i - 1
            while k >= 0 and k not in take and weight[k] and (lines[k][3] or not marked) == (lines[i][3] or not marked) and not (dived > k):
                take.add(k)
                k -= 1
        if state == "in":
            take.add(i)
            dived = i + 1
        elif i == 0:
            dived = 0
    return [lines[i][0] for i in sorted(take) if not lines[i][2]]


def test_windows_against_a_plain_version():
    rng = random.Random(4)
    for _ in range(3000):
        lines = []
        for _ in range(rng.randint(0, 25)):
            n = rng.choice([3, 10, 30, 120])
            lines.append(("x" * n, rng.choice([0, n // 2, n, n]), rng.random() < 0.2, rng.random() < 0.5))
        marked = rng.random() < 0.5
        window = rng.randint(1, 4)
        assert html.main_lines(lines, marked, window, 80, 0.25) == brute(lines, marked, window, 80, 0.25)


def test_a_page_without_article_tags():
    body = f"<div class='menu'><a href='/'>Home</a> <a>News</a></div><div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG} &amp; more&nbsp;\n  text</p></div><div id='footer'>Copyright</div><form><p>{LONG}</p></form>"
    assert html.main_text(page(body)) == f"Title\n{LONG}\nShort.\n{LONG} & more text"


def test_marks_are_weights_only():
    """The windows cut link lists inside a marked article; long text beside it weighs less, but is not lost by the mark alone."""
    links = "<ul>" + "<li><a href='/x'>Another story with a long title that is only a link</a></li>" * 5 + "</ul>"
    assert html.main_text(page(f"<main><p>{LONG}</p>{links}</main>")) == LONG
    assert html.main_text(page(f"<main><p>{LONG}</p></main>{links}<p>short teaser</p>")) == LONG


def test_class_words_in_compounds():
    for name in ("share-price", "legal-news", "notice-of-meeting-report", "related-work"):
        assert html.main_text(page(f"<div class='{name}'><p>{LONG}</p></div>")) == LONG, name
    for name in ("share-buttons", "legal", "related posts-list related-posts", "cookie-law", "notice box"):
        assert html.main_text(page(f"<div class='{name}'><p>{LONG}</p></div><div><p>{LONG} B</p></div>")) == f"{LONG} B", name


def test_broken_markup():
    assert html.main_text(page(f"<div><p>{LONG}<p>{LONG}</div><div class='ad'>Buy")) == f"{LONG}\n{LONG}"
    assert html.main_text(f"<p>{LONG}<a href='x") == LONG
    assert html.main_text(f"<p>{LONG}</p><!-- never closed <p>{LONG}</p>") == LONG
    assert html.main_text(f"</div></p>{LONG}") == LONG
    assert html.main_text("<") == "<" and html.main_text("<p>a < b") == "a < b"


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "v", page(f"<p>{LONG}</p>")), (3, "v", page(f"<p>{LONG}</p>")), (None, "w", page("")), (4, "x", page(f"<p>{LONG}</p>" * 20000)), (5, "y", page("<div>" * 3000 + f"<p>{LONG}</p>"))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == sorted([(1, 0), (2, 0), (3, len(LONG)), (3, len(LONG)), (0, 0), (4, 20000 * (len(LONG) + 1) - 1), (5, len(LONG))])
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(df.filter("false")).collect() == []
