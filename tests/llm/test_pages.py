"""Pages of one template, broken markup, small hosts."""

from tessera.llm import pages

PAGE = '<html><head><title>T {k}</title><script>var a="</p><article>";</script></head><body><header>Site</header><nav><a href="/">home</a> <a href="/b">b</a></nav><div id=wrap><div class="box-7"><h1>Head {k}</h1><p>First &amp; <b>bold</b>\n text {k}<p>Second &lt;{k}&gt; <br>line &#233;{more}<div class="comments"><p>Nice post</div><aside>side</aside></div><div class=promo>buy {k}</div></div><div class="teaser">short</div><footer>&copy; foot</footer></body>'


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article_of_a_template(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.format(k=k, more=" and much more text" * 9)) for k in range(12)]
    got = {r.page_id: r for r in pages.extract(frame(spark, rows)).collect()}
    for k in range(12):
        assert got[k].text == f"Head {k}\nFirst & bold text {k}\nSecond <{k}> line é" + " and much more text" * 9
        assert got[k].n_chars == len(got[k].text)


def test_edges(spark):
    rows = [(1, None, None), (2, None, ""), (3, "http://one.example/x", "<p>only <i>one</i> page"), (4, "not a url", "plain < text &nbsp; here"), (5, "http://b.example", "<!-- <p>no</p> <p>never closed"), (6, "http://b.example", "<script>x</scr <p>gone"), (7, "http://c.example", "<ul><li>a<li>b<li>" + "c" * 100_000 + "</ul>")]
    got = {r.page_id: r.text for r in pages.extract(frame(spark, rows)).collect()}
    assert got == {1: "", 2: "", 3: "only one page", 4: "plain < text here", 5: "", 6: "", 7: "a\nb\n" + "c" * 100_000}
    assert pages.extract(frame(spark, rows).limit(0)).count() == 0


def test_generated_pages_give_their_articles(spark, sf_dir):
    import html
    import re

    source = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in pages.extract(source).collect()}
    for r in source.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


PROBE = """<html><body><div class="site-header">Acme {k}</div><div class="post has-sidebar"><article><header><h1>Title {k}</h1></header><p class="lead">Lead {k}</p>
<div class="body"><h2 class="section-header">Part {k}</h2><p data-id="ad-5">Body one {k} {more}</p><p class="reply">He replied {k}</p><div class="related-work">Work {k}</div>
<p>x <math><mi>y{k}</mi></math> z</p><div class="plain">Read more on our site</div><pre>code  {k}</pre></div><div class="ad-5">Buy {k}</div><div class="comment-list"><p>Nice {k}</p></div></article></div>
<div class="cookie-notice">We use cookies {k}</div><div id="page-footer">foot {k}</div></body></html>"""


def test_nothing_else_is_dropped(spark):
    more = "and more words of the article " * 20
    got = pages.extract(frame(spark, [(k, f"https://p.example/{k}", PROBE.format(k=k, more=more)) for k in range(9)])).collect()
    for r in got:
        k = r.page_id
        assert r.text.split("\n") == [f"Title {k}", f"Lead {k}", f"Part {k}", f"Body one {k} {more.strip()}", f"He replied {k}", f"Work {k}", f"x y{k} z", f"code {k}"]


def test_pages_that_repeat_keep_their_text(spark):
    got = pages.extract(frame(spark, [(k, "https://copies.example/", PROBE.format(k=1, more="")) for k in range(30)])).collect()
    assert len(got) == 30 and all("Read more on our site" in r.text and r.text.startswith("Title 1\nLead 1") for r in got)


def test_a_second_section_stays(spark):
    page = "<body><div class=c><div class=a><p>{long}</p></div><div class=b><h2>Second {k}</h2><p>short {k}</p></div></div><p>&copy; all the same</p></body>"
    got = pages.extract(frame(spark, [(k, "https://two.example/", page.format(k=k, long=f"long text {k} " * 60)) for k in range(6)])).collect()
    assert all(f"long text {r.page_id}" in r.text and r.text.endswith(f"Second {r.page_id}\nshort {r.page_id}") for r in got)


def test_names():
    assert all(pages.says([n], pages.CONTAINER_NAMES) for n in ("ad", "site-header", "main_nav", "ad-5", "ads12", "related-posts", "comment-list"))
    assert not any(pages.says([n], pages.CONTAINER_NAMES) for n in ("section-header", "has-sidebar", "related-work", "lead", "page", "main", "head", "adage", "5"))


def test_clashing_names(spark):
    df = frame(spark, [(k, f"https://p.example/{k}", PROBE.format(k=k, more="")) for k in range(5)])
    for c in ("slot", "texts", "host", "_slot", "_HTML"):
        df = df.withColumn(c, df.page_id)
    got = pages.extract(df)
    assert got.columns == ["page_id", "url", "slot", "texts", "host", "_slot", "_HTML", "text", "n_chars"]
    assert all(r.slot == r.page_id == r.host for r in got.collect())


def body(page):
    return [b.text for b in pages.parsed(page)[1] if not b.out]


def test_parts_of_an_article_stay_whatever_they_are_called():
    for name in "discussion form search social header menu alert notice related reply share".split():
        assert body(f'<article><p>Body</p><section class="{name}"><h2>Discussion</h2><p>More</p></section></article>') == ["Body", "Discussion", "More"]
        assert body(f'<body><div class="{name}"><p>More</p></div></body>') == []
    assert body('<article><p>Body</p><div class="comments"><p>Nice</p></div><div class="advert">Buy</div></article>') == ["Body"]


def test_controls_do_not_cut_a_paragraph():
    assert body("<p>Press <button>OK</button> to go on</p><p>Name <input name=x> and <select><option>a</select> end</p>") == ["Press to go on", "Name and end"]
    assert body("<button>Menu</button><p>text</p>") == ["text"]


TEMPLATE = "<body><div class=top>The Daily Site</div><div class=wrap><div class=text><h1>Title {k}</h1><h2>Introduction</h2><p>Words of {k}, {more}</p><h2>Results</h2><p>Found {k}</p></div></div><div class=foot>All rights reserved, the same on all pages</div></body>"


def test_small_and_large_hosts_have_templates_of_their_own(spark):
    """Two, three and eight pages: the same article; recurring headings stay."""
    for n in (2, 3, 8):
        rows = [(k, f"https://n{n}.example/{k}", TEMPLATE.format(k=k, more=f"long text {k} " * 40)) for k in range(n)]
        for r in pages.extract(frame(spark, rows)).collect():
            k = r.page_id
            assert r.text.split("\n") == [f"Title {k}", "Introduction", f"Words of {k}, " + (f"long text {k} " * 40).strip(), "Results", f"Found {k}"]


def test_near_copies_on_a_small_host_keep_their_text(spark):
    page = "<body><div class=a><p>{}</p><p>{}</p><p>Signed by {}</p></div></body>"
    rows = [(k, f"https://two.example/{k}", page.format("The first paragraph of both. " * 9, "The second paragraph of both. " * 9, k)) for k in range(2)]
    assert all(len(r.text.split("\n")) == 3 for r in pages.extract(frame(spark, rows)).collect())
