"""Main text of web pages by line-block distribution.

A page is cut into lines at block elements, without markup. Each line weighs as
many characters as it has outside links, or nothing if most of it is links; lines of page furniture (navigation,
forms, adverts, comments and the like, by element, role, class or id) weigh
nothing. Where a page marks its article or main element, lines outside weigh a
quarter. Sums over a sliding window of lines surge where the article begins and
dive to nothing where it ends; the text between such points is kept, less the
furniture inside. On every page it is these points that decide: a mark is a weight.
Lines right before the surge, such as a short heading, belong to it. Article elements that are
comments or teasers by class, or lie in a comment section, are furniture. A form, or an element that
only its class marks, is no furniture where it holds most of the page's text and its heading, or nearly all
of it where the page has no heading: it wraps the page.

Defined results: null or empty html gives an empty text; markup that is cut off
or never closed ends with the page; an advert or menu that is never closed ends
where the first article begins; a page whose windows all weigh the same keeps all
of them; very long pages are read whole; repeated rows each get a row; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import map_batches

WINDOW = 3
SURGE = 80
SHARE = 0.25
#: What a line outside the marked article weighs, where there is one.
OUTSIDE = 0.25

TOKEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: HTML elements by kind.
RAW = set("script style title textarea noscript iframe xmp noembed noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HOLDS = BLOCK - set("p li dt dd h1 h2 h3 h4 h5 h6 option hr tr td th tbody thead tfoot caption".split())
FURNITURE = set("nav footer aside form head select button template svg object canvas menu dialog fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words in a class or id that mark page furniture.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices sidebar sidebars menu menus "
    "nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments reply replies respond disqus discussion share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar pagination pager copyright legal disclaimer alert skip".split()
)
#: Of these, those that stay in force over an article inside, even the first.
COMMENTS = set("comment comments reply replies respond disqus discussion".split())
#: Of these, those that mark furniture only where nothing but such words and names of boxes stand beside them: `share-buttons`, not `share-price`.
VAGUE = set("alert banner legal notice notices promo related share sharing skip social widget widgets".split())
BOXES = set("area bar block bottom box button buttons container content icons inner item items left link links list main page panel post posts right section site stories text title top wrap wrapper".split())
#: Words beside which a mark says what a box has or lacks, not what it is: `with-sidebar`.
ABOUT = set("with has have no not without".split())
#: Elements that may wrap a whole page; others are furniture whatever they hold.
WRAPS = HOLDS - (FURNITURE - {"form", "fieldset"})
WORD = re.compile(r"[a-z]+")


def marks(names: str) -> bool:
    """Whether the words of a class and id mark furniture."""
    for name in names.lower().split():
        words = WORD.findall(name)
        if ABOUT.isdisjoint(words) and any(w in MARKS and (w not in VAGUE or all(x in MARKS or x in BOXES for x in words)) for w in words):
            return True
    return False


def is_out(name: str, attrs: dict[str, str]) -> bool:
    """Whether an element is out by its role or as hidden."""
    return attrs.get("role", "") in ROLES - {"form"} or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")


def is_furniture(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name in FURNITURE or (name == "header" and not in_article):
        return True
    if name in ("html", "body", "main", "h1"):
        return False
    if is_out(name, attrs) or attrs.get("role", "") == "form":
        return True
    return marks(f"{attrs.get('class', '')} {attrs.get('id', '')}") and not (in_article and name == "header")


def lines_of(html: str) -> tuple[list[tuple[str, int, bool, bool]], bool]:
    """Lines as (text, characters outside links, furniture?, inside article or main?), and whether the page marks an article."""
    lines: list[tuple[str, int, list[int], bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # open containers: name, furniture (0, -1, or a number if it may be a wrapper), article, comments
    headed: dict[int, bool] = {}  # possible wrappers: whether a heading of the page is in it
    inline: list[tuple[str, int]] = []  # open inline furniture
    linked, in_link, marked, heading = 0, False, False, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                lines.append((text, max(0, len(text) - linked), [f for _, f, *_ in stack if f], any(a for _, _, a, _ in stack)))
            parts.clear()
        linked = 0

    def take(piece: str) -> None:
        nonlocal linked
        if piece and not inline:
            parts.append(piece)
            if in_link:
                linked += len(piece)

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if not m:
            take(html[at:])
            break
        take(html[at : m.start()])
        at = m.start()
        if m.group() == "<!--":
            stop = html.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        if m.group() in ("<!", "<?"):
            stop = html.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        tag = TAG.match(html, at)
        if tag:
            closing, name, rest, at = tag.group(1), tag.group(2).lower(), tag.group(3), tag.end()
        else:  # a quote or the tag itself is never closed
            stop = html.find(">", at)
            if stop < 0:
                break
            named = NAME.match(html, at)
            closing, name, rest, at = "/" if html[at + 1] == "/" else "", named.group(1).lower(), "", stop + 1
        if name == "br":
            take(" ")
            continue
        if name in BLOCK:
            flush()
            in_link = False
        if name == "a":
            in_link = not closing
        if closing:
            opened = next((i for i in range(len(inline) - 1, -1, -1) if inline[i][0] == name), None)
            if opened is not None:
                del inline[opened:]
            if name in HOLDS:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if depth is not None:
                    del stack[depth:]
                    inline.clear()
            continue
        if name in RAW:
            close = re.compile(f"</{name}", re.IGNORECASE).search(html, at)
            if not close:
                break
            stop = html.find(">", close.end())
            at = end if stop < 0 else stop + 1
            continue
        if name in VOID or rest.endswith("/"):
            continue
        attrs = {k.lower(): (a or b or c) for k, a, b, c in ATTR.findall(rest)} if rest.strip() else {}
        if name in ("h1", "article", "main"):
            heading = True
            headed |= {f: True for _, f, *_ in stack if f > 0}
        article = name in ("article", "main") or attrs.get("itemprop") == "articleBody" or attrs.get("role") in ("main", "article")
        within = any(a for _, _, a, _ in stack)
        furniture = is_furniture(name, attrs, within)
        if name == "body" or (article and not within and not furniture and not marked):  # what was never closed ends here
            stack = [x for x in stack if not x[1] or x[3]]
            inline.clear()
        if name in HOLDS:
            comments = furniture and not COMMENTS.isdisjoint(WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
            wraps = furniture and not comments and name in WRAPS and not is_out(name, attrs) and not (name == "header")
            if wraps:
                headed[len(headed) + 1] = False
            stack.append((name, len(headed) if wraps else -1 if furniture else 0, article and not furniture, comments))
            marked |= article and not furniture and not any(f for _, f, *_ in stack)
        elif name not in BLOCK and (furniture or inline):  # what is inside inline furniture is closed first
            inline.append((name, 0))
        elif furniture:  # a marked paragraph or list item: its text is left out up to the next block
            inline.append((name, 0))
        elif name in BLOCK:
            inline.clear()
    flush()
    # wrappers, from the outermost: they hold most of what nothing else takes out
    open_ = {f for *_, fs, _ in lines for f in fs if f > 0}
    for f in sorted(open_):
        text = [(own, fs) for _, own, fs, _ in lines if not any(x < 0 or (x < f and x in open_) for x in fs)]
        every, held = sum(own for own, _ in text), sum(own for own, fs in text if f in fs)
        if 2 * held > every and (headed[f] or (not heading and 10 * (every - held) <= held)):
            open_.discard(f)
    return [(text, own, any(f < 0 or f in open_ for f in fs), inside) for text, own, fs, inside in lines], marked


def main_lines(lines: list[tuple[str, int, bool, bool]], marked: bool, window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> list[str]:
    """The lines between surge and dive points, without furniture; lines and marked are as lines_of() gives them."""
    n, usual = len(lines), [1.0 if inside or not marked else OUTSIDE for *_, inside in lines]
    weight = [0 if furniture or 2 * own < len(text) else own * u for (text, own, furniture, _), u in zip(lines, usual, strict=True)]
    sums = [sum(weight[i : i + window]) for i in range(n)]
    least = max(1.0, min(surge, share * max(sums, default=0)))
    kept: list[str] = []
    i = end = 0
    while i < n:
        if sums[i] < least or not weight[i]:
            i += 1
            continue
        begin = i  # headings and other lines too short to surge are right before
        while begin > end and weight[begin - 1] and usual[begin - 1] == usual[i]:
            begin -= 1
        while i < n and sums[i]:  # up to the dive: the window after it holds nothing
            i += 1
        end = i
        kept += [text for text, _, furniture, _ in lines[begin:end] if not furniture]
    return kept


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> str:
    """The article's blocks, one a line."""
    return "\n".join(main_lines(*lines_of(html), window, surge, share)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(rows, run, "page_id long, url string, text string, n_chars long", by="html", most=4 << 20)
