import html
import re

import pytest

from tessella.llm import html_text
from tessella.llm.html_text import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<header><h1>Site</h1></header><nav><a href=1>Home</a> <a href=2>News</a></nav>
<div class="cookie-notice"><p>We use cookies on this site, and this notice is long enough to look like text, really.</p></div>
{}
<aside>About the author and more of this.</aside>
<form><label>Mail</label><input><button>Send</button></form>
<section id="comments"><div class="comment"><p>A reader's comment that is long, long, long, and longer than the article itself is.</p></div></section>
<div class="ad-banner">Buy now, buy cheap, buy today and tomorrow.</div>
<footer>&copy; Somebody</footer><script>var a = "<p>no</p>";</script></body></html>"""
BODY = "<h2>Head &amp; line</h2><p>First  para\n graph, with <a href=x>a link</a> and <b>bold</b> text.<p>Second one, <i>unclosed<br>line.</p><ul><li>Item one<li>Item two</ul><p>End.</p>"
WANT = "Head & line\nFirst para graph, with a link and bold text.\nSecond one, unclosed line.\nItem one\nItem two\nEnd."


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", '<div class="post"><div class="content">{}</div></div>', '<table><tr><td>{}</td></tr></table>', '<div id=page><div role=main>{}</div></div>'])
def test_article_is_found(shell):
    assert main_text(PAGE.format(shell.format(BODY))) == WANT


def test_an_article_in_sibling_containers():
    """Without article or main, all containers that reach the threshold are returned."""
    para = lambda i: f"Paragraph number {i} says a good deal about its subject, and goes on for some words more."
    part = lambda name, numbers: f"<div class={name}>{''.join(f'<p>{para(i)}</p>' for i in numbers)}</div>"
    links = "<div class=list><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>More</a></ul></div>"
    page = f"<html><body>{links}{part('part1', range(6))}{part('part2', range(6, 9))}</body></html>"
    assert main_text(page) == "\n".join(map(para, range(9)))


def test_characters():
    assert main_text("<p>a &lt; b &eacute;&#233;&#xe9; &nbsp; c &unknown; d</p>") == "a < b ééé c &unknown; d"
    assert main_text("<p>x<!-- <p>no</p> -->y</p>") == "xy"
    assert main_text("<article><p>A<script>if (a<b) c</script>B</p></article>") == "AB"


@pytest.mark.parametrize("icon", ("<svg class=icon/>", '<svg class="icon" />', "<svg><svg><text>no</text></svg><text>no</text></svg>", "<math><mi>no</mi></math>", "<svg><svg/><text>no</text></svg>"))
def test_inline_icons(icon):
    assert main_text(f"<article><p>A{icon}B</p><p>C</p></article>") == "AB\nC"
    assert main_text(f"<article><p>A{icon}B</p><p>C<svg><text>no</text></svg></p></article>") == "AB\nC"


def test_tables_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    got = extract(pages).collect()
    assert len(got) == len(source)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", s)).split()) for s in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


def wanted(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    want = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", s)).split()) for s in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in want if x)


def test_density_alone_finds_the_article(spark, sf_dir):
    """Without article, nav and footer elements and with meaningless classes; titles as short as an advert are lost."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet").collect()]
    bare = lambda page: re.sub(r"(</?)(?:article|nav|footer)\b", r"\1div", page).replace('class="ad"', 'class="k3"')
    assert sum(main_text(bare(p)) == wanted(p) for p in pages) >= 0.96 * len(pages)
    assert sum(main_text(p, cues=False) == wanted(p) for p in pages) >= 0.99 * len(pages)


def test_density_decides(spark, sf_dir, monkeypatch):
    """Were the whole page returned instead of the subtrees chosen, no page would be right."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    monkeypatch.setattr(html_text, "content", lambda root: [root])
    assert not any(main_text(p) == wanted(p) for p in pages)
    assert main_text(PAGE.format(BODY)) != WANT


def test_names_alone_take_nothing_out():
    """A form around the page and a class on its wrapper aren't furniture: they hold most of the text."""
    assert main_text(f"<form><div class='page has sidebar'><nav><a href=1>Home</a></nav><div>{BODY}</div></div></form>") == WANT


def test_parts_of_an_article():
    """Long lists and quotations inside, sections, and a heading beside the container."""
    items = "".join(f"<li>Point {i} of a long list of points.</li>" for i in range(40))
    article = f"<h1>Title</h1><p>{'First words. ' * 20}</p><ul>{items}</ul><blockquote><p>{'Quoted. ' * 9}</p></blockquote><p>Last.</p>"
    got = main_text(f"<body><div><ul>{'<li><a href=1>Menu</a>' * 9}</ul></div><div class=z1>{article}</div><div class=z2>Imprint</div></body>").split("\n")
    assert got[0] == "Title" and got[-1] == "Last." and len(got) == 44
    beside = f"<body><div class=q><a href=1>Home</a></div><h1>Title</h1><div class=z><p>{'Some words. ' * 30}</p><p>{'More words. ' * 30}</p></div></body>"
    assert main_text(beside).split("\n")[0] == "Title" and "Home" not in main_text(beside)


def test_odd_input(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<<<>>><p"), (4, "u", "plain words"), (4, "u", "plain words"), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<p>x</p>" * 20000), (7, "u", "<a b='>x</a>"), (8, "u", "</p></div><script>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    got = sorted(((str(r["page_id"]), r["text"]) for r in extract(pages).collect()))
    assert dict(got)["1"] == dict(got)["2"] == dict(got)["8"] == "" and dict(got)["5"] == "deep" and dict(got)["6"].count("\n") == 19999
    assert [t for k, t in got if k == "4"] == ["plain words"] * 2
    assert extract(pages.limit(0)).count() == 0
