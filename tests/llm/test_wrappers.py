import html
import random
import re

from pyspark.sql import functions as F

from mossgraph.llm import wrappers
from mossgraph.llm.queries import op12_html_extraction


def plain(page):
    """Text of the given tables' pages, whose article bears its tag, by substitutions."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|br|h1)>|<[a-z/]*\Z", " ", body[1]))).split()) if body else ""


def test_whole_table(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op12_html_extraction(spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


def words(g, n):
    return " ".join("".join(g.choices("abcdefghilmnorstuv", k=g.randint(2, 8))) for _ in range(n))


def page(kind, g):
    """A page and its main text. Kinds differ in how much their names tell."""
    title, body = words(g, 5), [words(g, g.randint(20, 60)) for _ in range(g.randint(2, 6))]
    inner = f"<h2>{title}</h2>" + "".join(f"<p>{b}</p>" for b in body)
    side = "".join(f'<li><a href="/x">{words(g, 3)}</a></li>' for _ in range(5))
    if kind == "plainly named":
        return f'<body><header>{words(g, 3)}</header><nav><ul>{side}</ul></nav><div class="cookie-notice">{words(g, 9)}</div><main><article>{inner}<div class="share">{words(g, 3)}</div></article><section id="comments"><h3>x</h3><p>{words(g, 30)}</p></section></main><aside>{words(g, 20)}</aside><form><p>{words(g, 4)}</p></form><footer><p>{words(g, 9)}</p></footer></body>', " ".join([title, *body])
    if kind == "divs":
        return f'<body><div id="top-menu"><ul>{side}</ul></div><div class="wrap"><div class="post-content">{inner}</div><div class="postComments"><p>{words(g, 40)}</p></div><div class="sidebar"><p>{words(g, 30)}</p></div></div><div class="footer">{words(g, 9)}</div>', " ".join([title, *body])
    return f'<html><body><div class="a1"><ul>{side}</ul></div><div class="b{g.randint(1, 99)}"><div class="c">{inner}<p class="q">All rights are ours and stay so.</p></div></div><div class="d">Write to us at any time.</div></body></html>', " ".join([title, *body])


def test_hosts_of_three_kinds(spark):
    g, rows, want = random.Random(3), [], {}
    for i in range(90):
        kind = ("plainly named", "divs", "names that tell nothing")[i % 3]
        text, want[i] = page(kind, g)
        rows.append((i, f"https://H{i % 3}.Example.org/{i}", text))
    table = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(5)
    got = wrappers.extracted(table.withColumn("says", F.lit("x")).withColumn("host", F.lit(1)).withColumn("h", F.lit(2))).collect()
    assert {r.page_id: r.text for r in got} == want
    shapes = {r.host: wrappers.expression(wrappers.json.loads(r.wrapper)) for r in wrappers.wrappers(table).collect()}
    assert shapes["h2.example.org"] == "<html><body><div.a#><ul>(<li>#text</>)+</></><div.b#><div.c><h2>#text</>(<p>#text</>)+<p.q>=</></></><div.d>=</></></>"


def test_groups_of_wrappers():
    def of(*pages):
        first, *rest = (wrappers.inferred(p) for p in pages)
        for w in rest:
            wrappers.merge(first, w)
        return wrappers.expression(first)

    assert of("<p>a</p>", "<p>a</p>") == "<p>=</>"
    assert of("<p>a</p>", "<p>b</p>") == "<p>#text</>"
    assert of("<h1>a</h1><p>b</p>", "<p>b</p>") == "(<h1>=</>)?<p>=</>"
    assert of("<p>b</p>", "<h1>a</h1><p>b</p>") == "(<h1>=</>)?<p>=</>"
    assert of("<p>b</p>", "<p>b</p><p>c</p>") == "(<p>#text</>)+"
    assert of("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>") == "(<h2>#text</><p>#text</>)+"
    assert of("<h2>a</h2><p>b</p>", "<p>b</p><h2>a</h2>") == "(<h2>=</><p>=</>)+"
    assert of("<h2>a</h2><ul><li>b</ul><p>b</p>", "<p>b</p><h2>a</h2>") == "(<h2>=</>(<ul><li>=</></>)?<p>=</>)+"


def test_order_and_parts_of_pages_do_not_matter():
    g = random.Random(4)
    pages = [page("names that tell nothing", g)[0] for _ in range(30)]

    def verdict(order, cut):
        folded = []
        for part in (order[:cut], order[cut:]):
            first, *rest = (wrappers.inferred(pages[i]) for i in part)
            for w in rest:
                wrappers.merge(first, w)
            folded.append(first)
        wrappers.merge(*folded)
        return wrappers.judged(folded[0])

    every = [verdict(g.sample(range(30), 30), g.randint(1, 29)) for _ in range(10)]
    assert all(v == every[0] for v in every) and len(every[0]["fixed"]) == 1


def test_markup():
    of = lambda page: wrappers.main_text(page, None)
    assert of("<p>one<b>two</b> three<p>four<br>five") == "onetwo three four five"
    assert of("<article><p>a &lt;b&gt; &amp;amp; &eacute;&#x41;&nbsp;c</p></article>") == "a <b> &amp; éA c"
    assert of('<script>var t="</p><p>x</p>";</script><style>p{}</style><!-- <p>no</p> --><p title="a > b">yes 1 < 2</p>') == "yes 1 < 2"
    assert of("<p>cut</p><p cla") == "cut" and of("<p>cut</p><!-- open <p>x") == "cut" and of("<p>a</p><script>x") == "a"
    assert of('<p>a</p><p hidden>b</p><p style="display: none">c</p><p aria-hidden="true">d</p>') == "a"
    assert of("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    assert of("") == of(None) == of("<p></p>") == of("<script>only</script>") == ""
    assert of("no tags at all & so on") == "no tags at all & so on"
    assert of("<form><p>all of the page is in a form</p></form>") == "all of the page is in a form"
    assert of('<main class="with-sidebar"><h1>t</h1><p>b</p></main>') == "t b"
    assert of("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p>") == "deep after"
    assert of('<p a="unclosed>text</p>') == "text" and of("<article><header><h1>t</h1></header><p>b</p><footer>f</footer></article>") == "t b"


def test_copies_are_no_template(spark):
    g = random.Random(6)
    copy = page("names that tell nothing", g)
    rows = [(i, "http://a.b/", copy[0].replace("b7", "b8")) for i in range(20)] + [(20, "http://a.b/", None), (21, None, "<p>alone</p>"), (None, "no host", ""), (22, "http://a.b/x", "<main><p>other form</p></main>")]
    got = wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    of = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(copy[1] in of[i] for i in range(20)) and (of[20], of[21], of[None], of[22]) == ("", "alone", "", "other form")


def test_empty_table_and_join_beyond_the_bound(spark, sf, monkeypatch):
    assert wrappers.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    usual = sorted(map(tuple, wrappers.extracted(pages).collect()))
    monkeypatch.setattr(wrappers, "SMALL", -1)
    monkeypatch.setattr(wrappers, "LARGE", 5)
    assert sorted(map(tuple, wrappers.extracted(pages).collect())) == usual


def test_long_page(spark):
    text = " ".join(f"word{i}" for i in range(400_000))
    rows = [(1, "http://long.org/a", f"<html><body><nav>x</nav><article><p>{text}</p></article></body></html>")]
    assert wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).first().text == text
