from tallyframe.llm import html_text

PAGE = "page_id long, url string, html string, host string, blocks string"


def texts(spark, rows, least_pages=3):
    pages = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGE)
    got = html_text.main_texts(pages, html_text.TemplateRule(least_pages)).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def one(spark, html):
    return texts(spark, [(1, "http://a.example/x", html)])[1]


def test_structure(spark):
    assert one(spark, """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
      <body><header>site</header><nav><ul><li>menu</ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">c</div>
      <article><h1>Head &amp; line</h1><p><b>First<br>  of &lt;two&gt; <p>Second&nbsp;  one</p>
      <form>f</form><aside>s</aside><div class="ad">buy</div><ul><li>item one<li>item <i>two</i></ul>
      <section class="comments"><p>reader says</p></section></article><footer>&copy; x</footer></body></html>""") == (
        "Head & line\n\nFirst of <two>\n\nSecond one\n\nitem one\n\nitem two")


def test_broken_markup(spark):
    assert one(spark, "<p>a < b and c > d<p>unclosed <b>bold") == "a < b and c > d\n\nunclosed bold"
    assert one(spark, "plain &#65;&#x42;&eacute; text") == "plain ABé text"
    assert one(spark, "<p>x</p></div></p><p>y<script>never closed <p>z") == "x\n\ny"


def test_templates_go_and_repeated_prose_stays(spark):
    rows = [(i, "https://Site.example:80/p", f"<body><div><p>Follow us</p></div><article><p>Story {i}</p><p>Often said.</p>"
             f"<div><span>Read next</span></div></article><div>Made by X</div></body>") for i in range(6)]
    rows += [(10, "http://other.example/", "<body><div><p>Follow us</p></div><div><p>Told once</p></div></body>")]
    rows += [(20 + i, "http://copies.example/", "<body><div><p>Copy</p></div></body>") for i in range(6)]
    got = texts(spark, rows)
    assert [got[i] for i in range(6)] == [f"Story {i}\n\nOften said." for i in range(6)]
    assert got[10] == "Follow us\n\nTold once"
    assert got[20] == "Copy"


def test_site_template_outside_article(spark):
    rows = [(i, "http://s.example/", f"<body><div><p>Menu of all</p></div><p>Text {i}</p><div><p>Legal</p></div></body>") for i in range(5)]
    assert texts(spark, rows) == {i: f"Text {i}" for i in range(5)}


def test_nulls_repeats_and_empty(spark):
    long = "<p>" + "word " * 50_000 + "</p>"
    rows = [(1, None, None), (None, "http://a/", "<p>x</p>"), (2, "", ""), (3, "u", "  "), (4, "http://a/", long)]
    got = texts(spark, rows)
    assert got == {1: "", None: "x", 2: "", 3: "", 4: ("word " * 50_000).strip()}
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "a", "b")] * 3, PAGE)
    assert html_text.main_texts(pages).count() == 3
    assert html_text.main_texts(pages.limit(0)).collect() == []
