"""Main text of pages that mark an article or main element."""

from pitchlake.llm.html import main_text

TEXT = "The council met on Monday evening and agreed, after two hours, on a new plan for the harbour."


def test_link_lists_inside_main_are_no_article_text():
    links = "".join(f'<li><a href="/{i}">Another story with a long headline, number {i}</a></li>' for i in range(8))
    page = f"<body><main><p>{TEXT}</p><p>{TEXT}</p><ul>{links}</ul></main></body>"
    assert main_text(page) == f"{TEXT}\n{TEXT}"


def test_comment_articles_are_furniture():
    comments = f'<section id="comments"><article class="comment"><p>I was there. {TEXT}</p></article><article><p>Me too. {TEXT}</p></article></section>'
    assert main_text(f"<body><article><p>{TEXT}</p></article>{comments}</body>") == TEXT
    assert main_text(f"<body>{comments}<article><p>{TEXT}</p></article></body>") == TEXT
    assert main_text(f"<body><main><p>{TEXT}</p></main>{comments}</body>") == TEXT


def test_an_advert_never_closed_still_ends_at_the_article():
    assert main_text(f'<body><div class="ad">Buy now<article><p>{TEXT}</p><p>Short.</p></article></body>') == f"{TEXT}\nShort."
