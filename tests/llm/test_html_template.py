"""What recurs in few of a host's pages, and tables and lists inside content, are no template."""

from test_html_text import texts

from tallyframe.llm import html_text


def test_few_of_many_pages_make_no_template(spark):
    url, n = "http://hot.example/p", 60
    rows = [(i, url, f"<body><div>Site menu</div><p>Text {i}</p>{'<h2>References</h2>' if i < 6 else ''}</body>") for i in range(n)]
    got = texts(spark, rows, html_text.DEFAULT_RULE.least_pages)
    assert got == {i: f"Text {i}" + ("\n\nReferences" if i < 6 else "") for i in range(n)}


def test_same_rows_and_lists_in_articles_stay(spark):
    table = "<table><tr><td>Item</td><td>{}</td></tr><tr><td>Total</td><td><div>0</div></td></tr></table>"
    rows = [(i, "http://a.example/", f"<article><p>Story {i}</p>{table.format(i)}<ul><li>Flour</li><li>Salt</li></ul>"
             "<div><span>Read next</span></div></article>") for i in range(8)]
    assert texts(spark, rows) == {i: f"Story {i}\n\nItem\n\n{i}\n\nTotal\n\n0\n\nFlour\n\nSalt" for i in range(8)}
