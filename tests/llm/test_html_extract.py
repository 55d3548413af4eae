import time

from tsengine.llm import html_extract as h

P1, P2, P3 = ("The river rises in the hills and runs through three valleys before it meets the sea." * 2, "Its banks are settled by farmers who know the floods and the long dry months alike." * 2, "A last word on the bridges: five are of stone, one is of wood, none is new.")


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body class='nav-open'>{body}</body></html>"


def test_article_without_noise():
    body = f"<header>Site</header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class=ad>Buy now and save a lot of money today</div><article><h1>Head &amp; tail</h1><p><b>{P1}<br><p>{P2}</p><div class='share'>Share</div><p>{P3}</article><aside>Side words</aside><form><input value=x>Sign up</form><section id=comments><p>{P1} I disagree</section><footer>&copy; us</footer>"
    assert h.extract(page(body)) == f"Head & tail {P1} {P2} {P3}"


def test_no_article_element():
    links = "".join(f"<li><a href=/{i}>Link number {i} to some page</a></li>" for i in range(30))
    body = f"<div id=menu><ul>{links}</ul></div><div class=page><div class=list>{'<ul>' + links + '</ul>'}</div><div class=content><h2>Rivers</h2><p>{P1}</p><p>{P2}</p><p>{P3}</p></div></div><div class='cookie-notice'>We use cookies</div>"
    assert h.extract(page(body)) == f"Rivers {P1} {P2} {P3}"


def test_short_blocks_between_sections():
    short = "<ul><li>item one<li>item two</ul><ol><li>first</ol><blockquote>Quoted</blockquote><pre>x = 1</pre><table><tr><td>cell</table><h4>Minor</h4><dl><dt>term<dd>meaning</dl><div>Short</div>"
    links = "".join(f"<li><a href=/{i}>Link number {i}</a>" for i in range(9))
    long = f"<p>{P1} {P2} {P3}</p>"
    body = f"<div id=top><div id=content><div class=sec>{long * 3}</div>{short}<div class=sec>{long}</div><div class=sec><p>Last</p></div></div><ul>{links}</ul></div>"
    text = f"{P1} {P2} {P3}"
    assert h.extract(page(body)) == f"{text} {text} {text} item one item two first Quoted x = 1 cell Minor term meaning Short {text} Last"


def test_names_of_layout_and_of_other_articles():
    body = f"<form id=aspnetForm><div class='header'>Site name</div><div class='content with-sidebar'><div class='sidebar-layout'><main><article class='post no-sidebar'><header><h1>Head</h1></header><p>{P1}</p><div class='side-bar'>Side</div><p>{P2}</p></article><article class='comment'><p>{P3}</p></article></main></div></div><div class='gdpr-box'>Cookies</div></form>"
    assert h.extract(page(body)) == f"Head {P1} {P2}"
    replies = "".join(f"<article><p>{P2}</p><p>{P3}</p></article>" for _ in range(20))
    assert h.extract(page(f"<main><article><p>{P1}</p></article><section id='comments'>{replies}</section></main>")) == P1


def test_white_space_and_references():
    body = "<article><p>  a\n\t b&nbsp;c&#x41;&eacute;<i>x</i>y &lt;p&gt; </p>\n\n<p>d</p><pre>e\n  f</pre></article>"
    assert h.extract(page(body)) == "a b cAéxy <p> d e f"


def test_broken_pages():
    for text in ("", "<", "<p", "plain & text", "</div></p>", "<!-- never closed", "<article><p>x", "<a href='unclosed>text", "<" * 5000, "<b>" * 5000 + "x", "<p>" * 5000, "<script>alert(1)"):
        assert isinstance(h.extract(text), str)
    assert h.extract("plain  text") == "plain text" and h.extract("<article><p>x") == "x" and h.extract("<script>alert(1)") == ""


def test_names_alone_remove_no_article_text():
    for name in ("class='social'", "class='comments-off'", "id='search-results'", "class='alert-levels'", "class='related'", "class='login'"):
        for body in ("body...", P1):
            got = h.extract(f"<article><h1>Social life of ants</h1><section {name}><p>{body}</p></section><p>x</p></article>")
            assert got == f"Social life of ants {body} x", name
    text = f"<p>{P1}</p><p>{P2}</p>"
    for name in ("menu", "sidebar", "comments", "footer", "promo"):
        assert h.extract(page(f"<article><h1>Head</h1>{text}<section class={name}>{text}</section><p>{P3}</p></article>")) == f"Head {P1} {P2} {P1} {P2} {P3}", name
        assert h.extract(page(f"<article><h1>Head</h1>{text}<div class={name}>Some words</div><p>{P3}</p></article>")) == f"Head {P1} {P2} {P3}", name


def test_density_decides_inside_containers_too():
    links = "<ul><li><a href=/1>Link one</a><li><a href=/2>Other page</a></ul>"
    assert h.extract(page(f"<main><h1>Head</h1><p>{P1}</p><p>{P2}</p>{links}</main>")) == f"Head {P1} {P2}"
    assert h.extract(page(f"<article><p>{P1} <a href=/1>one</a> and <a href=/2>two</a></p><p><a href=/1>one</a> <a href=/2>two</a></p></article>")) == f"{P1} one and two one two"


def test_feet_without_names():
    body = f"<div><h1>Head</h1><p>{P1}</p><p>{P2}</p></div><div>Copyright 2020</div><p>All rights reserved by us</p><div>© 2021 we</div>"
    assert h.extract(page(body)) == f"Head {P1} {P2}"
    assert h.extract(page(f"<article><p>{P1}</p><p>Copyright is a right.</p></article>")) == f"{P1} Copyright is a right."


def test_one_paragraph_and_articles_own_element():
    assert h.extract(page(f"<div class=ad>Buy this</div><article><p>{P1}</p></article><div>Welcome to us</div>")) == P1
    assert h.extract(page(f"<nav>Menu</nav><div class=ad>Buy this</div><div><p>{P1}</p></div><footer>us</footer>")) == P1
    assert h.extract(page(f"<form><div><p>{P1}</p><p>{P2}</p></div></form>")) == f"{P1} {P2}"


def test_given_pages_need_no_article_element():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    for text in pages:
        other = text.replace("<article>", "<div>").replace("</article>", "</div>")
        assert h.extract(other) == h.extract(text)


def test_cells_and_items_end_each_other():
    root = h.parse("<table><tr><td>a<b>b<td>c<tr><td><ul><li>d<li><i>e<li>f</ul><td>g</table><dl><dt>h<dd>i<dt>j</dl>")
    rows = [n for n in h._nodes(root) if n.tag in ("td", "li", "dt", "dd")]
    text = lambda n: "".join(x if isinstance(x, str) else text(x) for x in n.items)
    assert [text(n) for n in rows] == ["ab", "c", "def", "d", "e", "f", "g", "h", "i", "j"]


def test_time_grows_with_the_page():
    n = 100_000
    for text in ("<div>" * n + "x", "<b>" * n + "x", "</x>" * n, "<article>" * n, "<p><b>" * (n // 2), "<p>" + "<b>" * (n // 2) + "<hr>" * (n // 2), "<ul><li><table><tr><td>" * (n // 5), "<div class=menu>" * n):
        begin = time.process_time()
        h.extract(text)
        assert time.process_time() - begin < 8, text[:30]


def test_rows(small):
    rows = [(1, "u", page(f"<article><p>{P3}</p></article>"), "x"), (1, "u", page(f"<article><p>{P3}</p></article>"), "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", page("<article>" + f"<p>{P1}</p>" * 5000 + "</article>"), "z")]
    got = h.extract_pages(small(rows, "page_id LONG, url STRING, html STRING, text STRING")).collect()
    assert sorted(((r.page_id, r.n_chars, r.text[:4]) for r in got), key=str) == sorted([(1, len(P3), P3[:4])] * 2 + [(2, 0, ""), (None, 0, ""), (3, 5000 * (len(P1) + 1) - 1, P1[:4])], key=str)
    assert h.digest(small([], "page_id LONG, url STRING, html STRING")).count() == 0
