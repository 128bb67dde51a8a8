from arborframe.llm import html_text as h


def page(i, body):
    return f"<html><head><title>t {i}</title><script>var a='<p>no</p>'</script></head><body>{body}</body></html>"


def test_articles_are_whole_and_chrome_goes(spark):
    body = """<header>top</header><nav><ul><li><a href=/x>menu</a></ul></nav><div class="cookie-notice">cookies</div><aside>side</aside>
      <article><header><h1>A &amp; B</h1></header><p>one<b>two</b>  three<br>four<p>same line</p><form>f <input></form><style>p{}</style><section class="comments">nice</section></article>
      <div class="ad">buy</div><section id="comments"><p>first!</p></section><footer>&copy; x</footer>"""
    rows = [(i, f"http://h.example/{i}", page(i, body)) for i in range(4)]
    got = h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"A & B onetwo three four same line"} and {r["n_chars"] for r in got} == {33}


def test_words_in_classes():
    read = lambda body: h.extract(page(0, body), None, set(), None)
    assert read('<div class="layout with-sidebar"><div class="page-header">top</div><div class="post-sidebar">side</div><p>text</p></div>') == "text"
    assert read('<div class="header">x</div><article class="has-comments"><div class="article-header"><h1>Title</h1></div><p>text<div class="share">tweet</div></article>') == "Title text"


def test_template_of_a_host_without_articles(spark):
    def body(i):
        return (
            f'<div class="top">Welcome to the site</div><div class="links"><a href=1>other page {i}</a> <a href=2>more {i}</a></div>'
            f'<div class="content"><h1>Title {i}</h1><p>Text {i} of this page, rather long, &lt;so&gt; that it counts.<p>And {i * 7} more words.</div><div class="x">All rights reserved</div>'
        )

    rows = [(i, f"http://h.example/{i}", page(i, body(i))) for i in range(6)] + [(9, "http://lone.example/", page(9, "<div>alone <p>here</div>"))]
    got = {r["page_id"]: r["text"] for r in h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Title {i} Text {i} of this page, rather long, <so> that it counts. And {i * 7} more words."
    assert got[9] == "alone here"


def test_edges(spark):
    rows = [(1, None, None), (2, "http://a", ""), (3, None, "plain & text"), (3, None, "plain & text"), (None, "x", "<article>a<p>b"), (5, "http://a", "<article>a <b <c"), (6, "u", "<p>" + "w " * 100_000), (7, "u", "a < b <!-- c <p> --> d<"), (8, "u", "<" * 5000)]
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = h.extract_text(df)
    x = {r["page_id"]: r["text_"] for r in got.collect()}
    assert x[1] == x[2] == "" and x[3] == "plain & text" and x[None] == "a b" and x[5] == "a" and len(x[6]) == 199_999 and x[7] == "a < b d<" and x[8] == "<" * 5000
    assert h.extract_text(df.limit(0)).count() == 0 and got.filter("text <> 'mine' or n_chars <> 1").count() == 0


def test_whole_table_against_a_plain_reading(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in h.extract_text(pages).collect():
        own = re.search(r"<article>(.*?)</article", r["html"], re.S)
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", own[1])).split())


def test_template_texts_inside_articles_go(spark):
    def body(i):
        return f'<article><p class="by">Written by the desk</p><p>Text {i} of this page.</p><p>Written by the desk</p><p>Sign up for our letter</p></article>'

    # three texts repeat on five pages of six; the sixth and the other host have texts like them, which stay
    rows = [(i, f"http://h.example/{i}", page(i, body(i) if i else "<article><p>Text 0, Written by hand</p><p>Written by the desk?</p></article>")) for i in range(6)]
    rows.append((9, "http://other.example/", page(9, "<article><p>Sign up for our letter</p><p>Text 9</p></article>")))
    got = {r["page_id"]: r["text"] for r in h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Text 0, Written by hand Written by the desk?" and got[9] == "Sign up for our letter Text 9"
    for i in range(1, 6):
        assert got[i] == f"Text {i} of this page."


def test_names_inside_articles_count_only_with_the_template(spark):
    def body(i):
        more = {2: '<div class="related-work"><p>Work like this.</p></div>', 3: '<section class="form-follows-function"><p>It does.</p></section>', 4: '<div class="comments">nice</div>'}.get(i, "")
        return f'<article><p>Text {i} of this page.</p>{more}<div class="share-buttons"><p>Tell {i} friends</p></div></article>'

    rows = [(i, f"http://h.example/{i}", page(i, body(i))) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {i} of this page." + {2: " Work like this.", 3: " It does."}.get(i, "") for i in range(6)}
    # without the template the slots are others
    assert h.extract(rows[5][2], {"", "/html", "/html/body", "/html/body/article"}, set(), None) == "Text 5 of this page. Tell 5 friends"


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "h", "p", "m")], "page_id long, url string, html string, __host string, __paths string, __main string")
    assert tuple(h.extract_text(df).first()) == (1, "http://a/", "<p>x</p>", "h", "p", "m", "x", 1)


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_revisions_of_an_article_keep_their_common_text(spark):
    same = "<p>A paragraph that all the revisions share.</p><p>Another one that they share.</p>"
    pages = [f"<article><h1>One title</h1>{same}<p>Changed para number {i}</p></article>" for i in range(3)]
    pages += [f"<article><h1>Title {i}</h1><p>Something else {i}</p></article>" for i in (3, 4)]
    got = extracted(spark, [(i, f"http://h.example/{i}", page(i, b)) for i, b in enumerate(pages)])
    for i in range(3):
        assert got[i] == f"One title A paragraph that all the revisions share. Another one that they share. Changed para number {i}"
    assert got[4] == "Title 4 Something else 4"


def test_formulas_and_single_parts_of_articles_stay(spark):
    words = ["related", "search", "form", "notice", "social", "aside", "login", "share"]
    pages = [f'<article><h1>T {i}</h1><p>x{i} <math><mi>y</mi></math> z</p><div class="{w}"><p>part {i}</p></div><div class="comments">nice</div></article>' for i, w in enumerate(words)]
    got = extracted(spark, [(i, f"http://h.example/{i}", page(i, b)) for i, b in enumerate(pages)])
    assert got == {i: f"T {i} x{i} y z part {i}" for i in range(len(words))}
    # the same part on all pages of the host is its template's
    got = extracted(spark, [(i, f"http://h.example/{i}", page(i, f'<article><h1>T</h1><p>text {i}</p><div class="related">part {i}</div></article>')) for i in range(5)])
    assert got == {i: f"T text {i}" for i in range(5)}


def test_the_template_decides_on_hosts_without_telling_names(spark):
    def body(i):
        return f'<div class="a"><div class="b">Our house of news</div><div class="c">Read more every day</div></div><div class="d"><h1>Head {i}</h1><p>Long text number {i} with many words in it.</p></div><div class="e">Kept in the town</div>'

    rows = [(i, f"http://h.example/{i}", page(i, body(i))) for i in range(5)]
    got = extracted(spark, rows)
    assert got == {i: f"Head {i} Long text number {i} with many words in it." for i in range(5)}
    assert h.extract(rows[0][2], None, set(), None) != got[0]
