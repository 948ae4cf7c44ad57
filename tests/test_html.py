from foliate.operators import html as H
from foliate.operators import markdown


def content(page):
    root = H.parse(page)
    return H.to_markdown(H.main_content(root))


def test_title_order():
    page = '<title>T</title><h1 class="x pagetitle">P</h1><h1 id="title-text">  Id\n <b>x</b></h1>'
    assert H.title(H.parse(page)) == "Id x"
    assert H.title(H.parse(page.replace('id="title-text"', ""))) == "P"
    assert H.title(H.parse("<title> only &amp; one</title>")) == "only & one"
    assert H.title(H.parse("<p>none")) == ""


def test_containers():
    body = "<body><nav>n</nav><div class='my-page-content'>c</div><div class=wiki-content>w</div><p id=content>i</p><div id=main-content>m</div></body>"
    assert content(body) == "m"
    assert content(body.replace("main-content", "z")) == "i"
    assert content(body.replace("main-content", "z").replace("id=content", "")) == "w"
    assert content(body.replace("main-content", "z").replace("id=content", "").replace("wiki-content", "v")) == "c"
    assert content("<body><header>h</header><nav>n</nav><p>text<footer>f</footer></body>") == "text"


def test_markdown_of_everything():
    page = """<div id=main-content><div class="toc-macro">no</div><div id=sidebar>no</div><script>var a="</p>";</script><style>p{}</style><noscript>no</noscript>
    <h2>Head <b>bold</b></h2><p>one <em>two</em> <a href="/x">three</a><br>four <img src="i.png"> &copy; <code>a*b</code>
    <p>unclosed<ul><li>a<li>b<ol><li>c</ol></ul><table><tr><th>h1<th>h|2<tr><td>1<td>2</table><pre>x
  y</pre><blockquote>q</blockquote><hr></div>"""
    want = """## Head **bold**

one *two* [three](/x)  
four ![](i.png) © `a*b`

unclosed

- a
- b
  1. c

| h1 | h\\|2 |
| --- | --- |
| 1 | 2 |

```
x
  y
```

> q

---"""
    assert content(page) == want


def test_links():
    page = """<nav><a href="/nav">n</a></nav><div><b>Child Pages</b><ul><li><a href="/c1">1</a><a href="mailto:x">m</a></ul></div>
    <div id=content><a href="/b1">b</a><a href="/c1">again</a><a href="javascript:1">j</a><a name=x>n</a><a href="https://o/z">o</a></div>"""
    root = H.parse(page)
    H.main_content(root)
    assert H.links(root) == ["/c1", "mailto:x", "/b1", "https://o/z"]
    root = H.parse("<body><nav><a href=/gone>x</a></nav><a href=/kept>y</a></body>")
    H.main_content(root)  # navigation goes before links are taken
    assert H.links(root) == ["/kept"]


def test_extract_column(spark):
    rows = [(1, "<title>a</title><p>b"), (2, None), (3, ""), (4, "<div>" * 5000)]
    out = {r.id: r.x for r in spark.createDataFrame(rows, "id int, html string").select("id", H.extract(__import__("pyspark.sql.functions", fromlist=["col"]).col("html")).alias("x")).collect()}
    assert (out[1].title, out[1].markdown, out[1].hrefs) == ("a", "b", [])
    assert out[2].markdown is None and out[3].title is None
    assert out[4].markdown == "" or out[4].error


def test_markdown_to_html():
    text = "# A & b\n\np **x** *y* `c<d>` [l](u) ![i](s)\nline\n\n- a\n- b\n  - c\n\n1. d\n\n| h | k |\n|---|---|\n| 1 | 2 |\n\n```\n<code>\n```\n\n> q\n\n---"
    want = (
        "<h1>A &amp; b</h1>\n<p>p <strong>x</strong> <em>y</em> <code>c&lt;d&gt;</code> <a href=\"u\">l</a> <img alt=\"i\" src=\"s\" /><br />\nline</p>\n"
        "<ul>\n<li>a</li>\n<li>b\n<ul>\n<li>c</li>\n</ul></li>\n</ul>\n<ol>\n<li>d</li>\n</ol>\n"
        "<table>\n<thead>\n<tr><th>h</th><th>k</th></tr>\n</thead>\n<tbody>\n<tr><td>1</td><td>2</td></tr>\n</tbody>\n</table>\n"
        "<pre><code>&lt;code&gt;\n</code></pre>\n<blockquote>\n<p>q</p>\n</blockquote>\n<hr />"
    )
    assert markdown.to_html(text) == want


def test_marked_sections_are_comments():
    assert content("<body><![foo]>text <![if x]>a<![endif]> <![CDATA[ b ]]>c") == "text a c"
    assert content("<body>a <![").startswith("a")


def test_odd_numbers_deep_nesting_and_tables_in_tables():
    assert content('<ol start="²"><li>a</ol>') == "1. a" and content('<ol start="7"><li>a<li>b</ol>') == "7. a\n8. b"
    assert content("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert content("<ul><li>" * 1500 + "x").endswith("- x")
    got = content("<table><tr><td>a<table><tr><td>inner</td></tr></table></td><td>b</td></tr><tr><td>c</td></tr></table>")
    assert got.count("inner") == 1 and got.splitlines()[-1] == "| c |"
