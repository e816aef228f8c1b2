import re
from html import unescape

import pytest

from quarry.llm import html_extract as H

PARA = "This paragraph is long enough to count, has commas, and goes on about the harbour, the mill and the school for a while."
SITE = """<html><head><title>T</title><style>p{{}}</style></head><body><header class="site-header"><h1>Site name</h1><nav><a href="/">Home</a></nav></header>
<div class="cookie-notice">We use cookies, many of them, for all kinds of reasons, and you agree.</div>
<div id="wrap" class="has-sidebar">{main}<div class="sidebar"><p>{p}</p></div></div>
<section id="comments"><p>I disagree, strongly, with all of it, and I will say so at length, again and again, here.</p></section>
<form><p>Subscribe, now, to our letter, please, and thank you.</p><input></form><footer>foot &copy;</footer><script>var x = "<p>no</p>";</script></body></html>"""


@pytest.mark.parametrize(
    "main, text",
    [
        (f"<article><h1>Head &amp; line</h1><p>{PARA}</p><div class=ad>Buy</div><p>Two\n  <b>bold</b>&nbsp;x<br>y</p></article>", f"Head & line\n{PARA}\nTwo bold x y"),
        (f"<div class=post><h2>Head</h2><p>{PARA}<p>{PARA}<ul><li>one<li>two</ul></div>", f"Head\n{PARA}\n{PARA}\none\ntwo"),
        (f"<main><section><p>{PARA}</p></section><section><p>{PARA}</p><p>short</p></section></main>", f"{PARA}\n{PARA}\nshort"),
        (f"<div class=text><p>{PARA}</p><aside>see also</aside><p>{PARA}</p><div class='related'><a href=x>other</a></div></div>", f"{PARA}\n{PARA}"),
    ],
)
def test_pages(main, text):
    assert H.extract(SITE.format(main=main, p="Side, bar")) == text


def test_edges():
    assert H.extract(None) == H.extract("") == H.extract("<p></p>") == H.extract("<script>x") == ""
    assert H.extract("plain  text &lt;b&gt;") == "plain text <b>"
    assert H.extract("<p>a<p>b") == "a\nb"
    assert H.extract("<div>" * 20000 + "deep") == "deep"
    assert H.extract("<p>a < b and c > d</p>") == "a < b and c > d"
    assert H.extract("<p>open <a href='x") in ("open", "open <a href='x")
    assert H.extract("<!-- <p>no</p> --><p>yes</p>") == "yes"


def test_generated_pages(spark):
    """On the given pages the article is plain: everything in <article> but tags."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        m = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S)
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", m[1])]
        assert H.extract(r.html) == "\n".join(p for p in parts if p)


def test_frames(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", 1), (1, "u", "<p>a</p>", 1), (2, None, None, 2), (3, "v", "<p>" + "é, " * 200000, 3)], "page_id long, url string, html string, n_chars int")
    rows = sorted(map(tuple, H.extract_text(df).collect()), key=str)
    assert [r[3] for r in rows] == [1, 1, 0, 599999]
    assert H.extract_text(df.where("false")).count() == 0


LONG = f"<p>{PARA}</p><p>{PARA}</p><p>{PARA}</p>"
THREE = f"{PARA}\n{PARA}\n{PARA}"


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<div><div class=story>{LONG}</div><p>The end, short.</p></div>", f"{THREE}\nThe end, short."),
        (f"<div>Intro line.<div class=story>{LONG}</div></div>", f"Intro line.\n{THREE}"),
        (f"<div><div class=story>{LONG}</div><section><p>Short last.</p></section></div>", f"{THREE}\nShort last."),
        (f"<body><div class=story>{LONG}</div><section><p>Short last.</p></section>", f"{THREE}\nShort last."),
        (f"<div><h3>Headline</h3><div class=story>{LONG}</div><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></div>", f"Headline\n{THREE}"),
        (f"<article><h2>Head</h2><div class=text>{LONG}</div><p class=end>Fin.</p></article>", f"Head\n{THREE}\nFin."),
        (f'<article><p class="social-history">Short.</p>{LONG}<div class="post-comments"><p>First, of all!</p></div><p class="ad">Buy</p></article>', f"Short.\n{THREE}"),
        (f'<div class=story><p class="menu-costs">Short.</p>{LONG}</div>', f"Short.\n{THREE}"),
        (f'<article>{LONG}<div class="sidebar">See also</div><div class="share-buttons">Tweet</div></article>', THREE),
        (f'<p title="abc>text</p>{LONG}', f"text\n{THREE}"),
        (f"<p data-x=it's>text</p>{LONG}", f"text\n{THREE}"),
        (f'<p title="a > b" data-h="<i>x</i>" class=\'y\'>text</p>{LONG}', f"text\n{THREE}"),
    ],
)
def test_nothing_of_the_article_is_lost(html, text):
    assert H.extract(html) == text


def test_deep_pages_take_linear_time():
    import time

    def took(n):
        begun = time.process_time()
        assert H.extract("<div>x" * n).count("x") == n
        return time.process_time() - begun

    took(2000)
    assert took(32000) < 40 * max(took(2000), 0.01)


COMMENTS = "".join(f'<div class="item"><span class="author">Reader {k}</span> <time>Monday</time><p>I do not agree at all, and say so, number {k}.</p></div>' for k in range(3))


@pytest.mark.parametrize(
    "html, text",
    [
        (f'<div class="post ad-free">{LONG}</div>', THREE),
        (f'<div class="post comments-closed">{LONG}</div>', THREE),
        (f'<article>{LONG}<section class="editor-comment"><p>A word, by us.</p></section><p class="comment">So it is.</p></article>', f"{THREE}\nA word, by us.\nSo it is."),
        (f"<article>{LONG}</article><div>The end, a short closing line.</div>", f"{THREE}\nThe end, a short closing line."),
        (f"<article>{LONG}</article><div><p>Short last para.</p></div>", f"{THREE}\nShort last para."),
        (f'<div class="post-header"><h1>Title</h1></div><article>{LONG}</article>', f"Title\n{THREE}"),
        (f'<article>{LONG}</article><div class="discussion-thread"><p>Me too, me too.</p></div><div class="reader-responses"><p>Me too, me too.</p></div>', THREE),
        (f'<article>{LONG}</article><div class="x1">{COMMENTS}</div>', THREE),
        (f'<article>{LONG}<div class="x1">{COMMENTS}</div></article>', THREE),
        (f'<div class="sidebar">{LONG}</div>', THREE),
        (f'<div class="ad-slot">Buy.</div><article>{LONG}</article><ul class="comments"><li>Me, too, and so on.</li></ul>', THREE),
    ],
)
def test_names_and_shapes(html, text):
    assert H.extract(html) == text
    assert H.extract(f"<html><body><nav><a href=x>Home</a></nav>{html}<footer>foot</footer></body></html>") == text


@pytest.mark.parametrize("one, other", [("<div>", "</table>"), ("<span hidden>", "</span>"), ("<span hidden>", "</b>"), ("<li><div>", "</ul>")])
def test_stray_tags_take_linear_time(one, other):
    import time

    def took(n):
        begun = time.process_time()
        H.extract(one * n + other * n + "<p>x</p>")
        return time.process_time() - begun

    took(2000)
    assert took(16000) < 24 * max(took(2000), 0.01)


def plain_scores(node):
    """Points and link density of every container by their definition, top down: node -> (points, chars, linked)."""
    found = {}

    def texts(n):
        own = [c for c in n.children if isinstance(c, tuple)]
        return own + [t for c in n.children if isinstance(c, H.Node) and not c.drop for t in texts(c)]

    def gifts(n, level, at):
        """What the blocks at or below n give a container `level` levels above n's own first receiver."""
        total = 0.0
        for c in n.children:
            if isinstance(c, H.Node):
                if not c.drop:
                    total += gifts(c, level, at)
            elif c[1] * 2 <= len(c[0]):
                up, k = (n.parent, 1) if n.tag in H._TEXT and n.parent else (n, 1)
                while up is not None and up is not at:
                    up, k = up.parent, k + 1
                if up is at and k <= H.LEVELS:
                    total += (1 + c[0].count(",") + min(len(c[0]) // 100, 3)) / (1 if k == 1 else 2 if k == 2 else 3 * k)
        return total

    def visit(n):
        if not n.drop:
            t = texts(n)
            found[id(n)] = (H.TAG_POINTS.get(n.tag, 0) + gifts(n, 0, n), sum(len(x) for x, _ in t), sum(x for _, x in t))
            for c in n.children:
                if isinstance(c, H.Node):
                    visit(c)

    visit(node)
    return found


@pytest.mark.parametrize("seed", range(30))
def test_scores_equal_their_definition(seed):
    import random

    rng = random.Random(seed)

    def some(depth):
        out = []
        for _ in range(rng.randrange(1, 5)):
            text = rng.choice(["one, two, three", "word " * rng.randrange(60), f"<a href=x>{'link ' * rng.randrange(9)}</a> rest"])
            kind = rng.choice(["p", "div", "section", "ul", "td", "text", "blockquote", "aside", "article"])
            out.append(text if kind == "text" else f"<{kind}>{some(depth - 1) if depth and kind != 'p' else text}</{kind}>")
        return "".join(out)

    nodes = H.scored(html := some(4))
    want = plain_scores(nodes[0])
    for n in nodes:
        if not n.drop:
            points, chars, linked = want[id(n)]
            assert (n.chars, n.linked) == (chars, linked) and abs(n.points - points) < 1e-9, html
