"""Wrapped pages, nested marks, and the whole table against a plain extractor."""

from html.parser import HTMLParser

from pitchlake.llm import html
from pitchlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LONG = "The long article goes on with many words, and then some more words follow it here. " * 2


def blocks(n):
    return "".join(f"<p>{i} {LONG}</p>" for i in range(n)), "\n".join(f"{i} {LONG}".strip() for i in range(n))


def test_a_page_inside_a_form():
    body, text = blocks(3)
    assert html.main_text(f"<body><form id='aspnetForm'><div id='x'><h1>Head</h1>{body}</div></form></body>") == f"Head\n{text}"
    assert html.main_text(f"<body><div class='nav'><a>menu</a></div><form>{body}</form></body>") == text
    # a form beside the article stays out, also a long one
    assert html.main_text(f"<body><div><h1>Head</h1>{body}</div><form>{blocks(5)[0]}</form></body>") == f"Head\n{text}"


def test_classes_that_say_what_a_box_has():
    body, text = blocks(3)
    for names in ("content with-sidebar", "has-menu", "page no-header", "without-comments"):
        assert html.main_text(f"<body><div class='{names}'>{body}</div><div class='left-sidebar'>{LONG}</div></body>") == text
    # a class on the whole page does not take it out
    assert html.main_text(f"<body><div class='widget-page menu'><h1>Head</h1>{body}</div></body>") == f"Head\n{text}"


def test_comments_and_footers_stay_out_however_long():
    body, text = blocks(2)
    for tag in ("section class='comments'", "div id='disqus_thread'", "footer", "aside", "div role='complementary'", "div hidden"):
        assert html.main_text(f"<body><div><h1>Head</h1>{body}</div><{tag}>{blocks(9)[0]}</{tag.split()[0]}></body>") == f"Head\n{text}"


def test_nested_inline_marks():
    for inner in ("<span>Tweet</span> Share this story now", "<b>Tweet</b> <span><i>now</i> and</span> then", "<span>not closed"):
        assert html.main_text(f"<p>{LONG}<span class='share-buttons'>{inner}</span></p><p>{LONG}</p>") == f"{LONG.strip()}\n{LONG.strip()}"


class Plain(HTMLParser):
    """The blocks of the page's article by its element alone, with Python's own parser."""

    SKIP = {"script", "style", "nav", "aside", "form", "footer", "head", "noscript", "template", "select", "button"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.open, self.skip = [], [], [], []

    def flush(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in html.BLOCK:
            self.flush()
        if tag == "br":
            self.now.append(" ")
        if tag in html.VOID:
            return
        names = dict(attrs)
        out = tag in self.SKIP or html.marks(f"{names.get('class') or ''} {names.get('id') or ''}")
        if tag in html.HOLDS or out or self.skip:
            self.open.append(tag)
            if out and "article" in self.open:
                self.skip.append(len(self.open))

    def handle_endtag(self, tag):
        if tag in html.BLOCK:
            self.flush()
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            self.skip = [n for n in self.skip if n <= len(self.open)]

    def handle_data(self, data):
        if "article" in self.open and not self.skip:
            self.now.append(data)


def test_the_whole_table_equals_a_plain_extractor(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()}
    want = {}
    for page, text in pages.items():
        p = Plain()
        p.feed(text or "")
        p.close()
        p.flush()
        want[page] = "\n".join(p.blocks)
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op2_html_extraction"](spark, SF).collect()}
    differ = [k for k in want if got[k][0] != want[k]]
    assert not differ, (len(differ), len(want), got[differ[0]][0], want[differ[0]], pages[differ[0]])
    assert all(n == len(t) for t, n in got.values()) and got.keys() == want.keys()
