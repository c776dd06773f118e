"""What belongs to a page's main text, page by page."""

import pytest

from meterfold.llm.html_text import main_text, parse

LONG = "A sentence of some length that goes on for a while. " * 6

PAGES = {
    # headers of the page and of the article
    "<body><header>Site name</header><div>Real text here.</div></body>": "Real text here.",
    "<body><header><h1>Site</h1></header><div><h2>Title</h2><p>Text.</p></div></body>": "Title\n\nText.",
    "<body><header><h1>Title</h1></header><p>Text.</p></body>": "Title\n\nText.",
    "<article><header><h1>Title</h1></header><p>Text.</p></article>": "Title\n\nText.",
    "<body><div class='page'><header>Logo</header><div><header><h2>Title</h2></header><p>Text.</p></div></div></body>": "Title\n\nText.",
    "<body><div class='top'>Logo</div><p>Text.</p><div class='copyright'>(c) us</div></body>": "Text.",
    "<body><div class='top'><h1>Title</h1><p>Text.</p></div></body>": "Title\n\nText.",
    # a removed block ends the block that it stands in
    "<article>Before<aside>pull quote</aside>after</article>": "Before\n\nafter",
    "<article>Before<form>f</form>after<br>all</article>": "Before\n\nafter all",
    "<article>One<script>x</script>word</article>": "Oneword",
    # readers' comments and hints at other pages
    "<article><p>Text.</p></article><article class='comment-item'><p>Me too</p></article>": "Text.",
    "<article><p>Text.</p><ul class='replies'><li>Me too</li></ul><div id='respond'>Say</div><div class='user-notes'><p>Note</p></div></article>": "Text.",
    "<article><p>Text.</p></article><article class='teaser'><p>Next</p></article><article class='promo-box'><p>Buy</p></article>": "Text.",
    "<article class='post'><p>One.</p></article><article class='post'><p>Two.</p></article>": "One.\n\nTwo.",
    "<article class='related-work'><p>Text.</p></article>": "Text.",
    # what an article's text is made of stays
    "<article><p>Let <math><mi>x</mi><annotation>\\x</annotation></math> be.</p></article>": "Let x be.",
    "<article><p>A <span aria-hidden='true'>visible</span> word.</p></article>": "A visible word.",
    "<article><p class='share'>They share it.</p><p class='banner'>A banner.</p><div class='share'>Tweet</div></article>": "They share it.\n\nA banner.",
    "<article><p hidden>no</p><p style='display: none'>no</p><p>Yes.</p></article>": "Yes.",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert main_text(parse(page)) == PAGES[page]


@pytest.mark.parametrize("text", ["Short.", LONG])
def test_hints_count_alike_at_any_length(text):
    """A name that only hints decides by links, never by how long an element is."""
    assert main_text(parse(f"<body><p>Main.</p><div class='related-studies'><p>{text}</p></div></body>")) == f"Main.\n\n{text.strip()}"
    assert main_text(parse(f"<body><p>Main.</p><div class='related-studies'>{text}</div></body>")) == f"Main.\n\n{text.strip()}"
    assert main_text(parse(f"<body><p>Main.</p><div class='related-studies'><p><a href='x'>{text}</a></p></div></body>")) == "Main."


def test_a_removed_template_ends_its_block():
    elements = parse("<article>Before<div>Template</div>after</article>")
    gone = next(k for k, e in enumerate(elements) if e.tag == "div")
    assert main_text(elements, frozenset([gone])) == "Before\n\nafter"
