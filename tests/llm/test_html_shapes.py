"""Single pages marked by hand, and wrappers of long elements."""

import pytest

from siltstone.llm import html_extraction

L = "long words of the article here " * 6
TEXT = L.strip()
PAGES = {
    "a container named with-sidebar": (f"<html><body><nav>menu</nav><div class='content with-sidebar'><h1>T</h1><p>{L}</p></div><div class='sidebar'>side</div></body></html>", f"T {TEXT}"),
    "a page inside a form": (f"<body><nav>menu</nav><form><nav>menu</nav><div><p>{L}</p></div><input></form></body>", TEXT),
    "a form beside the article": (f"<body><div><p>{L}</p></div><form><p>your name</p></form></body>", TEXT),
    "a head without end": (f"<html><head><title>x</title><meta charset=utf-8><body><p>{L}</p></body></html>", TEXT),
    "a head ended by a paragraph": (f"<head><title>x</title><p>{L}</p>", TEXT),
    "a paragraph named social": (f"<body><article><h1>T</h1><p class='social'>{L}</p></article></body>", f"T {TEXT}"),
    "a paragraph named advert": (f"<body><article><p>{L}</p><p class='advert'>Buy</p></article></body>", TEXT),
    "a formula and a button": (f"<article><p>{L} <math><mi>x</mi></math> end</p><button>Share</button></article>", f"{TEXT} x end"),
    "headers of the site and the article": (f"<body><header><h1>Site</h1></header><article><header><h1>Headline</h1></header><p>{L}</p><footer>f</footer></article></body>", f"Headline {TEXT}"),
    "a heading in the site's header": (f"<body><header><h1>Site</h1></header><div class=content><p>{L}</p></div></body>", TEXT),
    "more comments than text": (f"<body><div class='post'><h1>T</h1><p>{L}</p></div><div class='comments'><p>{L * 9}</p></div></body>", f"T {TEXT}"),
    "a longer sidebar": (f"<body><div class='post'><p>{L}</p></div><div class='sidebar'><p>{L * 2}</p></div></body>", TEXT),
    "comments alone": (f"<body><div class='comments'>{L}</div></body>", ""),
    "a menu alone": ("<body><nav>a b c</nav></body>", ""),
    "references and white space": ("<body><p>a&nbsp;b &lt;c&gt;\n\t d&eacute;</p><p>e</p></body>", "a b <c> dé e"),
    "scripts in odd places": (f"<body><p>{L}<script>if (a < b) x('</p>')</script></p><style>p {{}}</style><!-- <p>no</p> --></body>", TEXT),
    "deep nesting": ("<div>" * 5000 + f"<p>{L}</p>" + "</div>" * 5000, TEXT),
    "end tags left out": ("<ul>" + "".join(f"<li>{i}<b>x" for i in range(30)) + "</ul>", " ".join(f"{i}x" for i in range(30))),
    "twenty open inline elements before an implied end": ("<p>one" + "<i><b>" * 10 + "two<p>three", "onetwo three"),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_page(name):
    page, text = PAGES[name]
    assert html_extraction.main_text(page, []) == text


def test_repeated_groups_of_long_elements():
    section = lambda i, n: "<section>" + "".join(f"<p>{i} {k}</p>" for k in range(n)) + "</section>"
    wrapper = html_extraction.infer([f"<div>{section(1, 300)}</div><p>x</p>", f"<div>{section(2, 300)}{section(3, 300)}</div><p>y</p>"])
    assert [x[0] for x in wrapper] == ["<div", "(+", ">div", "<p", "*", ">p"] and len(wrapper[1][1]) == 902
    steps = html_extraction.program(wrapper)
    assert html_extraction.match(steps, html_extraction.tokens(f"<div>{section(4, 300) * 3}</div><p>z</p>")) is not None


def test_own_main_text_stays(spark):
    rows = [(1, "http://a.example/", f"<p>{L}</p>", "mine", "hers")]
    out = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, main_text string, MAIN_TEXT_ string")).head()
    assert out["main_text"] == "mine" and out["main_text__"] == TEXT
