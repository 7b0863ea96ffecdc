from trustmill.llm import html as H

PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="page"><div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav>
<div class="sidebar"><p>side</p></div><main><article class="post"><h1>Title &amp; more</h1><p>One<br>two <i>th</i>ree<p>Four <a href=x>five</a> &lt;six
<div class="ad-box">Buy</div><form><label>q</label><input></form><ul><li>a<li>b</ul><section id="comments"><p>nice</p></section></article></main><footer>f</footer><script>if(a<b){"</p>"}</script></body></html>"""


def test_extract():
    assert H.extract(PAGE) == "Title & more One two three Four five <six a b"
    assert H.extract('<div id="content"><p>x &nbsp; y</p></div><div class="nav">n</div>') == "x y"
    for raw, want in ((None, ""), ("", ""), ("plain < text &am", "plain < text &am"), ("<p>a<p>b</body>", "a b"), ("<<<>>>&#x41;", "<<<>>>A"), ("<article><p>cut in the mid", "cut in the mid"), ("<script>never closed", "")):
        assert H.extract(raw) == want
    assert H.extract("<div>" * 300 + "deep" + "</div>" * 300) == "deep"


def test_site_template(spark):
    own = "<div><div class='x1'>Posted in the usual place</div><p>Page {0} says something of its own, {0}.</p></div>"
    rows = [(i, f"https://a.example/{i}", f"<body>{own.format(i)}</body>", "k") for i in range(12)]
    rows += [(100 + i, f"https://b.example/{i}", "<body><article><p>The same article on every page.</p></article></body>", "k") for i in range(12)]
    rows += [(200, None, None, "k"), (201, "https://c.example/", "<p>alone</p>", "k"), (0, rows[0][1], rows[0][2], "k")]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[3].text == "Page 3 says something of its own, 3." and by[3].n_chars == len(by[3].text)
    assert by[105].text == "The same article on every page." and by[200].text == "" and by[201].text == "alone"
    assert H.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_HASHES", 0)
    rows = [(i, "https://a.example/", f"<body><div>Same on all pages</div><p>own {i}</p></body>") for i in range(8)]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"own {i}" for i in range(8)}


def test_deep_and_long_pages():
    """However deep a page is nested and whatever is left open, its text is there, in time in proportion to its length."""
    for tag in ("div", "font", "p", "li", "td"):
        for end in ("", f"</{tag}>" * 100_000, f"</{tag}><b></i>" * 50_000):
            assert H.extract(f"<{tag}>" * 100_000 + "deep" + end + " after").split() == (["deep", "after"])
    page = "<article>" + "".join(f"<p>word{i} more</p>" for i in range(50_000)) + "</article>"
    assert H.extract(page).split()[::2] == [f"word{i}" for i in range(50_000)]


def test_templates_alone(spark, monkeypatch):
    """With the lists of tags and classes off, and no article to choose, counts by host take menus, notices and footers, also those seen once."""
    monkeypatch.setattr(H, "_furniture", lambda node, inside: node.tag in H.RAW or node.tag == "head")
    monkeypatch.setattr(H, "main_node", lambda root: root)
    page = "<body><div id=n1><ul><li>{0}</ul></div><div class=w><p>Story {1} is like no other.<p>It ends {1}.</div><div class=z><p>Rights {0}</p></div></body>"
    rows = [(i, f"https://a.example/{i}", page.format("Home" if i % 10 else f"Only {i}", i)) for i in range(40)]
    rows += [(100 + i, "https://copies.example/", page.format("Same", 1)) for i in range(40)]
    got = {r.page_id: r.text for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} is like no other. It ends {i}." for i in range(40))
    # Copies of one page are one page.
    assert all(got[100 + i] == "Same Story 1 is like no other. It ends 1. Rights Same" for i in range(40))
