import html as html_module
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldweave.llm import html_extract as h

STYLES = {
    "article": "<header class='site'><h2>Site name</h2></header><nav><ul><li><a href='/a'>A</a><li><a href='/b'>B</a></ul></nav><aside><p>About {host}</p></aside><main><article><h1>{title}</h1>{body}<footer>Tags: x</footer></article><section class='comments'><h3>Comments</h3><article class='comment'><p>{comment}</p></article></section></main><footer>&copy; {host}</footer>",
    "divs": "<div id='top-menu'><a href='/'>Home</a></div><div class='cookie-notice'>We use cookies <button>OK</button></div><div class='wrap'><div class='content'><h1>{title}</h1>{body}</div><div class='sidebar'><p>{comment} {comment} {comment}</p></div></div><div class='site-footer'>All rights</div>",
    "role": "<div role='banner'>Big name</div><div role='navigation'>menu</div><div role='main'><header><h1>{title}</h1></header>{body}<form action='/s'><input name='q'><label>Search here</label></form><div class='ad'>Buy</div></div><div id='comments'><p>{comment}</p></div>",
    "broken": "<nav>menu<ul><li>one<li>two</ul></nav><article><h1>{title}{body}<p>{comment} end",
}


def page(rnd, style, host):
    say = lambda n: " ".join(f"w{rnd.randrange(1000)}" for _ in range(n))
    title, paragraphs = say(5) + " & more", [say(rnd.randrange(15, 60)) + " <x> &" for _ in range(rnd.randrange(1, 6))]
    body = "".join(f"<p>{html_module.escape(p)}</p>\n " for p in paragraphs) + "<script>var t='</p><p>no</p>';</script><style>p{}</style><!-- <p>no</p> -->"
    comment = say(8)
    text = STYLES[style].format(title=f"{html_module.escape(title)}", body=body, host=host, comment=comment)
    want = [title, *paragraphs] + ([comment + " end"] if style == "broken" else [])
    end = "</body></html>" if style != "broken" else ""
    return f"<!DOCTYPE html><html><head><title>{title}</title><meta charset='utf-8'></head><body>{text}{end}", "\n".join(want)


def pages(n=12):
    rnd, out = random.Random(2), []
    for style in STYLES:
        for k in range(n):
            html, want = page(rnd, style, f"{style}.example.org")
            out.append((len(out), f"https://{style}.example.org/{k}?q=1", html, want))
    return out


@pytest.mark.parametrize("broadcast_bytes", [h.BROADCAST_BYTES, 0])
def test_articles_of_four_layouts(spark, broadcast_bytes):
    rows = pages()
    df = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash")).withColumn("wrapper", F.lit(1)).repartition(3)
    got = {r["page_id"]: r["text"] for r in h.extract_pages(df, broadcast_bytes=broadcast_bytes).collect()}
    for k, _, html, want in rows:
        assert got[k] == want, html


def test_text_that_every_article_says_stays(spark):
    """Inside an article nothing goes for being said on other pages too, however many there are."""
    rows = [(k, f"http://same.org/{k}", f"<article><h1>t{k}</h1><p>text {k} of this page</p><div class='x'>Read this on our app</div></article>") for k in range(8)]
    rows += [(100 + k, f"http://copy.org/{k}", "<article><h1>one</h1><p>copy</p></article>") for k in range(8)]
    got = {r["page_id"]: r["text"] for r in h.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[k] == f"t{k}\ntext {k} of this page\nRead this on our app" for k in range(8))
    assert all(got[100 + k] == "one\ncopy" for k in range(8))


def test_text_of_one_page_and_copies_stay(spark):
    one = "<blockquote>said on this page only</blockquote>"
    rows = [(k, f"http://own.org/{k}", f"<article><h1>t{k}</h1><blockquote><p>quote {k}</p></blockquote><div>{one * (k == 3)}</div><h2>Summary</h2><p>text {k}</p><p>more {k}</p></article>") for k in range(8)]
    rows += [(100 + k, f"http://many.org/{k}", f"<nav>{k}</nav><article><h1>one</h1><div class='lead'>lead</div><p>first</p><p>second</p></article>") for k in range(8)]
    got = {r["page_id"]: r["text"] for r in h.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert all(got[k] == "\n".join([f"t{k}", f"quote {k}", *["said on this page only"] * (k == 3), "Summary", f"text {k}", f"more {k}"]) for k in range(8))
    assert all(got[100 + k] == "one\nlead\nfirst\nsecond" for k in range(8))


ODD = [
    (1, "http://a.org/", None),
    (2, None, "<p>no url &amp; more</p>"),
    (3, "http://a.org/", ""),
    (4, "not a url", "plain text,  two   spaces\n\tand &nbsp;entities &am"),
    (None, "http://a.org/x", "<div>null id</div>"),
    (5, "http://a.org/y", "<p>" + "long " * 50_000),
    (5, "http://a.org/y", "<p>" + "long " * 50_000),
    (6, "http://b.org/y", "<" * 2000 + "a" + "<div>" * 3000 + "deep" + "</div>" * 10),
    (7, "http://b.org/y", "a < b and c > d <script>never closed <p>x</p>"),
]


def test_odd_pages(spark):
    rows = h.extract_pages(spark.createDataFrame(ODD, "page_id bigint, url string, html string")).collect()
    assert len(rows) == len(ODD)
    got = {r["page_id"]: r["text"] for r in rows}
    assert got[1] == got[3] == "" and got[2] == "no url & more" and got[4] == "plain text, two spaces and entities &am"
    assert got[None] == "null id" and got[5] == ("long " * 50_000).strip() and got[7] == "a < b and c > d" and "deep" in got[6]


def test_table_against_regular_expressions(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r["page_id"]: r["html"] for r in table.collect()}
    for r in h.extract_pages(table).collect():
        body = re.search("<article>(.*?)</article>", html[r["page_id"]], re.S)[1]
        parts = [" ".join(html_module.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(p for p in parts if p)


def test_alignment_makes_optional_and_repeated_groups():
    a, _ = h.Page("<div><h1>t</h1><p>x</p><p>y</p><ul><li>1<li>2</ul></div>").tree()
    b, _ = h.Page("<div><h1>t</h1><table><tr><td>1</table><p>x</p></div>").tree()
    w = h.fold(a, b)
    div = w.children[0]
    assert [(c.label, c.pages, c.repeated) for c in div.children] == [("h1", 2, False), ("table", 1, False), ("p", 2, True), ("ul", 1, False)]
    assert not div.children[0].varies and div.children[2].varies and div.children[3].children[0].repeated


def texts(spark, htmls, host="http://x.org"):
    rows = [(k, f"{host}/{k}", html) for k, html in enumerate(htmls)]
    got = {r["page_id"]: r["text"] for r in h.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    return [got[k] for k in range(len(rows))]


def test_wrapper_finds_the_article_where_no_tag_does(spark):
    """The template says more than the article: a page alone can't tell them apart, pages together can."""
    promo, about = "Our offer of the season is here for all of our readers. " * 6, "We have been writing from this town since long ago. " * 3
    page = "<div class='c1'><div class='c2'><p>{promo}</p><p>{about}</p></div><div class='c3'><p>{site}</p><h1>t{k}</h1><h2>Introduction</h2><p>story {k} is short</p><div>All rights with us</div></div></div>"
    htmls = [page.format(promo=promo, about=about, site="The Daily", k=k) for k in range(7)]
    want = [f"t{k}\nIntroduction\nstory {k} is short" for k in range(7)]
    assert texts(spark, htmls) == want
    assert all(h.extract(x, None, None) != w and "offer" in h.extract(x, None, None) for x, w in zip(htmls, want))


@pytest.mark.parametrize("n", [1, 4, 6, 40])
def test_headings_that_all_articles_share_stay(spark, n):
    htmls = [f"<nav>menu</nav><article><h1>t{k}</h1><h2>Introduction</h2><p>text {k}</p></article><footer>end</footer>" for k in range(n)]
    assert texts(spark, htmls) == [f"t{k}\nIntroduction\ntext {k}" for k in range(n)]


def test_words_in_longer_names_drop_nothing_inside(spark):
    inside = "<section id='related-work'><h2>Related work</h2><p>others {k}</p></section><p class='login-guide'>how to log in {k}</p><div id='comments-on-the-law'><p>law {k}</p></div><div class='comments'><p>me too {k}</p></div><div class='ad'>Buy {k}</div>"
    for frame, n in (("<div id='top-menu'>menu {k}</div><article><h1>t{k}</h1>%s</article>", 3), ("<div class='top-menu'>menu</div><div class='b'><h1>t{k}</h1>%s</div><div class='site-footer'>end</div>", 4)):
        htmls = [(frame % inside).replace("{k}", str(k)) for k in range(n)]
        assert texts(spark, htmls) == [f"t{k}\nRelated work\nothers {k}\nhow to log in {k}\nlaw {k}" for k in range(n)]


def test_depth_changes_nothing(spark):
    deep = "<div>" * 5000 + "<nav>menu</nav><p>deep text</p>" + "</div>" * 5000
    assert texts(spark, [f"<article><h1>t</h1>{deep}</article>", f"<article><h1>u</h1>{deep}</article>"]) == ["t\ndeep text", "u\ndeep text"]


def test_generated_names_make_no_new_groups():
    rnd, wrapper = random.Random(4), None
    for k in range(200):
        page = h.Page(f"<div id='{rnd.random()}' class='css-{rnd.randrange(10**5, 10**6)} box'><p id=a{k}>x{k}</p></div>").tree()[0]
        wrapper = page if wrapper is None else h.fold(wrapper, page)
    assert [(c.label, c.pages) for c in wrapper.children] == [("div # box", 200)] and wrapper.children[0].children[0].varies


def brute_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rnd = random.Random(5)
    for _ in range(400):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(12))] for _ in range(2))
        pairs = h._aligned(a, b)
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
        both = [(i, j) for i, j in pairs if i is not None and j is not None]
        assert all(a[i] == b[j] for i, j in both) and len(both) == brute_common(a, b)


def test_long_unlike_siblings_align_in_bounded_memory():
    import tracemalloc

    a, b = ([f"{side}{k}" if k % 3 else "same" for k in range(20_000)] for side in "xy")
    tracemalloc.start()
    pairs = h._aligned(a, b)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    assert sum(i is not None and j is not None for i, j in pairs) == sum(x == "same" for x in a)


def test_wrappers_meet_in_levels(spark):
    from fieldweave.llm.scratch import Scratch

    rows = [(f"http://x.org/{k}", f"<div class='m'><p>a{k}</p></div>") for k in range(90)]
    df = spark.createDataFrame(rows, "url string, html string").repartition(30)
    (got,) = h.infer_wrappers(df, Scratch(spark), fan=2).collect()
    root = h.Node.load(got["wrapper"])
    assert got["host"] == "x.org" and root.pages == 90 and root.children[0].children[0].varies


def test_empty(spark):
    assert h.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_main_text_beside_a_teaser_and_several_articles(spark):
    teaser = [f"<main><h1>t{k}</h1><p>{'long text ' * 20}{k}</p><article class='teaser'>Teaser {k}</article></main>" for k in range(5)]
    assert [x.split("\n")[:2] for x in texts(spark, teaser)] == [[f"t{k}", f"{'long text ' * 20}{k}"] for k in range(5)]
    two = [f"<nav>menu</nav><main><article>A of {k}</article><hr><article>B of {k}</article></main>" for k in range(5)]
    assert texts(spark, two) == [f"A of {k}\nB of {k}" for k in range(5)] and h.extract(two[0], None) == "A of 0\nB of 0"
    apart = [f"<main><article>A of {k}</article><h2>Between</h2><article>B of {k}</article></main>" for k in range(5)]
    assert texts(spark, apart) == [f"A of {k}\nB of {k}" for k in range(5)]


@pytest.mark.parametrize("mark", ["class='legal'", "id='legal'", "id='search'", "id=comments", "class=notice"])
def test_doubtful_names_inside_an_article_go_only_if_their_text_is_the_same(spark, mark):
    page = "<article><h1>t{k}</h1><p>text {k}</p><section {mark}><p>{said}</p></section></article>"
    assert texts(spark, [page.format(k=k, mark=mark, said=f"point {k} of the law") for k in range(5)]) == [f"t{k}\ntext {k}\npoint {k} of the law" for k in range(5)]
    assert texts(spark, [page.format(k=k, mark=mark, said="All rights are ours") for k in range(5)]) == [f"t{k}\ntext {k}" for k in range(5)]


@pytest.mark.parametrize("mark", ["comment-list", "comments", "ad-slot", "newsletter-signup", "shareButtons", "related-posts-box"])
def test_chrome_inside_an_article_goes(spark, mark):
    said = "we said this {k}" if mark not in ("related-posts-box",) else "read this too"
    htmls = [f"<article><h1>t{k}</h1><p>text {k}</p><div class='{mark}'><div class='comment-body'>{said.format(k=k)}</div></div></article>" for k in range(5)]
    assert texts(spark, htmls) == [f"t{k}\ntext {k}" for k in range(5)]


def test_formulas_and_broken_quotes_keep_the_text():
    assert h.extract("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>", None) == "Let x=1 be"
    assert h.extract("<p title=it's>two</p><p>three</p><p title=it's>four</p>", None) == "two\nthree\nfour"
    assert h.extract('<p>see <a href="x"">this</a> and <a title="a > b" href=\'y\'>that</a></p><p class="a"id=b>end</p><p / class>x', None) == "see this and that\nend\nx"
    assert h.extract("<p>a</p><div class=", None) == "a"


@pytest.mark.parametrize("tag", ["<a title=\"x>", "<p title='it>", "<p a=\"'>", "<div", "<a b=c'\" ", "<p class = ", "</p \"", "<!--", "<a/////"])
def test_broken_tags_take_linear_time(tag):
    import time

    began = time.process_time()
    h.extract(tag * 20_000, None)
    assert time.process_time() - began < 3


def test_every_page_once_with_many_hosts_in_one_task(spark):
    rows = [(k, f"http://h{k % 6000}.org/{k}", f"<article><h1>t{k}</h1><p>text {k}</p></article><footer>end {k % 6000}</footer>") for k in range(9000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    for broadcast_bytes in (h.BROADCAST_BYTES, 0):
        got = h.extract_pages(df, broadcast_bytes=broadcast_bytes).select("page_id", "text").collect()
        assert len(got) == 9000 and {r["page_id"]: r["text"] for r in got} == {k: f"t{k}\ntext {k}" for k in range(9000)}


def test_wrappers_stay_bounded():
    wrapper = None
    for k in range(60):
        page = h.Page("<div class=m>same</div>" + "".join(f"<div class='c{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}'>x</div>" for j in range(100))).tree()[0]
        wrapper = page if wrapper is None else h.fold(wrapper, page)
    assert len(wrapper.children) == h.MOST_CHILDREN and wrapper.children[0].label == "div m" and wrapper.children[0].pages == 60
