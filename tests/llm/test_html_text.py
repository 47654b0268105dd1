import html
import re

import pytest

from vigil.llm import html_text, queries

LONG = "The committee met for the third time this year and agreed on a plan that had been waiting since the spring."
MORE = "Nobody expected the vote to pass so quickly, but after two hours of debate only one member was against it."


def blocks(*texts: str) -> str:
    return "\n\n".join(texts)


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>Site name</title><style>p {{ margin: 0 }}</style><script>if (a < b) document.write('<p>no</p>')</script></head><body>{body}</body></html>"


MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>'
CASES = {
    "plain": (f"{MENU}<article><h1>A plan</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; 2024 all rights reserved</footer>", blocks("A plan", LONG, "Short.")),
    "unclosed": (f"<article><h1>A plan<p><b>{LONG}<br><p>{MORE}<ul><li>one<li>two</ul>tail", blocks("A plan", LONG, MORE, "one", "two", "tail")),
    "references": ("<article><p>Fish &amp; chips &lt;b&gt; &#233;t&eacute; caf&#xe9;&nbsp;&nbsp;now &notit;</p></article>", "Fish & chips <b> été café now ¬it;"),
    "space": ("<article><p>\n  one\t two <br> three<b>four</b>\n</p></article>", "one two threefour"),
    "header": (f"<header><h2>The Daily</h2><p>{LONG}</p></header><main><h1>T</h1><p>{MORE}</p></main>", blocks("T", MORE)),
    "own header": (f"<header>The Daily</header><article><header><h1>T</h1></header><p>{MORE}</p><footer>Tags: a, b</footer></article>", blocks("T", MORE)),
    "sidebar": (f"<div id='content'><h1>T</h1><p>{LONG}</p><p>{MORE}</p></div><div class='left sidebar'><p>{LONG}</p></div><aside><p>{MORE}</p></aside>", blocks("T", LONG, MORE)),
    "comments": (f"<article><p>{LONG}</p></article><section id='comments'><article class='comment'><p>{MORE} {MORE} {LONG}</p></article></section>", LONG),
    "comments within": (f"<article><h1>T</h1><p>{LONG}</p><div class='comment-list'><p>{MORE}</p><p>{MORE}</p></div></article>", blocks("T", LONG)),
    "notice": (f"<div class='cookie-notice'><p>{MORE}</p></div><article><p>{LONG}</p><div class='ad'>{MORE}</div><p>{MORE}</p></article>", blocks(LONG, MORE)),
    "form": (f"<form action='/'><article><p>{LONG}</p><form><label>Mail</label><input><button>Send</button> now</form><p>{MORE}</p></article></form>", blocks(LONG, MORE)),
    "layout class": (f"<div class='layout has-sidebar'><div class='text'><h1>T</h1><p>{LONG}</p><p>{MORE}</p></div></div>", blocks("T", LONG, MORE)),
    "no article": (f"<div>{MENU}<div class='x'><h1>T</h1><div class='y'><p>{LONG}</p><p>{MORE}</p><p>End.</p></div></div><div><a href='/'>one</a> <a href='/'>two</a></div></div>", blocks("T", LONG, MORE, "End.")),
    "menu in article": (f"<article><ul><li><a href='/'>one</a></li><li><a href='/'>two</a></li></ul><p>{LONG}</p></article>", LONG),
    "hidden": (f"<article><p>{LONG}</p><p hidden>{MORE}</p><div style='display: none'>{MORE}</div><span class='ad'>buy <span>now</span> it</span><!-- {MORE} --><noscript>{MORE}</noscript></article>", LONG),
    "table": (f"<article><p>{LONG}</p><table><tr><td>a</td><td>b</td></tr><tr><td>c<td>d</table></article>", blocks(LONG, "a b", "c d")),
    "odd markup": (f"<article><p>{LONG}</p><![CDATA[x]]><?php echo 1 ?></b></p></div><p>{MORE} a < b</p>", blocks(LONG, f"{MORE} a < b")),
    "cut in a script": (f"<article><p>{LONG}</p></article><script>var x = '<p>never", LONG),
    "cut in a tag": (f"<article><p>{LONG}</p><p cla", LONG),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    body, want = CASES[name]
    assert html_text.main_text(page(body)) == want


@pytest.mark.parametrize("text", [None, "", " ", "<", "<p>", "</p></article>", "<article></article>", "<nav>only a menu</nav>", "<![", "<!-- x", "&#0;", "<br>" * 50])
def test_pages_without_an_article(text):
    assert html_text.main_text(text) in ("", "<", "�")


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + f"<p>{LONG}</p>" + "</div>" * 20_000
    assert html_text.main_text(deep) == LONG
    many = "<article>" + "".join(f"<p>{i} {LONG}</p>" for i in range(20_000))
    assert html_text.main_text(many) == blocks(*[f"{i} {LONG}" for i in range(20_000)])
    assert html_text.main_text("<article><p><b>" + "x" * 3_000_000) == "x" * 3_000_000


def test_smoothing_and_threshold():
    ratios = html_text.np.array([1, 1, 1, 60, 80, 2, 70, 1, 1, 1, 1.0])
    weights = [[html_text.np.exp(-((i - j) ** 2) / (2 * html_text.SIGMA**2)) if abs(i - j) <= html_text.RADIUS else 0 for j in range(11)] for i in range(11)]
    want = html_text.np.array([sum(w * r for w, r in zip(row, ratios, strict=True)) / sum(row) for row in weights])
    assert html_text.np.allclose(html_text.smoothed(ratios), want)
    assert html_text.clustered(ratios).tolist() == (want >= want.std()).tolist()
    assert html_text.clustered(html_text.np.zeros(3)).tolist() == [False] * 3
    assert html_text.clustered(html_text.np.array([5.0])).tolist() == [True]


def test_table_of_pages(spark):
    rows = [(1, "http://a", page(CASES["plain"][0]), 5), (1, "http://a", page(CASES["plain"][0]), 5), (None, None, None, None), (3, None, "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    out = html_text.extracted(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    want = CASES["plain"][1]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "http://a", want, len(want))] * 2 + [(None, None, "", 0), (3, None, "", 0)], key=str)
    assert html_text.extracted(pages.limit(0)).count() == 0


def plainly(text: str) -> str:
    """What stands in the article element of the given tables' pages, by patterns."""
    body = re.search(r"<article>(.*?)(</article>|$)", text, re.S)[1]
    parts = (re.sub(r"</?b>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in (" ".join(html.unescape(p).split()) for p in parts) if b)


def test_query_against_patterns(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.page_id: (r.text, r.n_chars) for r in queries.op11_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert out == {r.page_id: (plainly(r.html), len(plainly(r.html))) for r in pages} and len(out) == len(pages)
