"""Extraction on marked articles, on broken mark-up, and by the induced template alone."""

import html
import re

import pytest

from tidemark.llm import html_text as ht


def brute(page):
    """What the given pages hold: blocks of their only article."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_query_equals_brute_force(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in QUERIES["op10_html_main_text"](spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        r = got.pop(p.page_id)
        assert (r.url, r.text, r.n_chars) == (p.url, brute(p.html), len(brute(p.html)))
    assert not got


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("just text &lt;3", "just text <3"),
        ("<p>a<p>b<br>c <b>d</b>e</p>f", "a\nb c de\nf"),
        ("<article><h1>T &amp; x&nbsp;y</h1><p>One\n two</article><aside>no</aside>", "T & x y\nOne two"),
        ("<main><p>a</p><form>q<p>w</form><section id='comments'><p>spam</section><p>b</main>", "a\nb"),
        ("<article><header><h1>T</h1></header><p>x</p><footer>by</footer></article>", "T\nx"),
        ("<article>a</article><article class='comment'>no</article><div class=sidebar><article>no</article></div>", "a"),
        ("<body class='has-sidebar nav-open'><p>a</p><div class='ad-slot'>no</div><div role=navigation>no</div></body>", "a"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table><dl><dt>k<dd>v</dl>", "a\nb\n1\n2\nk\nv"),
        ("<p>a<script>if (a</b) '<p>no</p>'</script>b<style>p{}</style><!-- <p>no</p> -->c<noscript>no</noscript>", "abc"),
        ("<p>a <unknown attr='>'>b</unknown> 1 < 2 <3 &am &amp", "a b 1 < 2 <3 &am &"),
        ("</p></div><p>x</article></body>y", "xy"),
        ("<article><p>open <b>bold<p>next", "open bold\nnext"),
        ("<div class='with-comments'>kept</div><div class='cookie notice'>no</div>", "kept"),
        ("<" * 50 + "p>a", "<" * 49 + "\na"),
    ],
)
def test_mark_up(page, text):
    assert ht.extract(page)[0] == text


def test_deep_and_long_pages():
    assert ht.extract("<div>" * 20_000 + "x")[0] == "x"
    assert ht.extract("<article>" + "<p>w</p>" * 30_000)[0] == "\n".join(["w"] * 30_000)


def test_tree_matching():
    def tree(page):
        return ht.regions_of(ht.parse(f"<body>{page}</body>"))

    size, pairs = ht.align(tree("<div><p>a</p></div><ul><li>x</ul><section>s</section>"), tree("<ul><li>y<li>z</ul><section>t</section>"))
    assert size == 4 and [a.label[0] for a, _ in pairs[:1]] == ["body"]
    assert {a.label[0] for a, _ in pairs} == {"body", "ul", "li", "section"}
    assert ht.align(tree("<p>a"), ht.Region(ht.Node("div", None)))[0] == 0


def brute_match(a, b):
    """The textbook recursion."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.below) + 1) for _ in range(len(a.below) + 1)]
    for i, x in enumerate(a.below):
        for j, y in enumerate(b.below):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_match(x, y))
    return 1 + best[-1][-1]


def test_matching_equals_the_textbook_recursion():
    import random

    rng = random.Random(5)

    def page(depth=0):
        tags = ["div", "section", "ul", "h2"]
        return "".join(
            f"<{t}>{page(depth + 1) if depth < 3 else rng.choice('ab')}</{t}>" for t in rng.choices(tags, k=rng.randint(0, 4))
        )

    for _ in range(150):
        a, b = (ht.regions_of(ht.parse(f"<body>{page()}</body>")) for _ in range(2))
        size, pairs = ht.align(a, b)
        assert size == brute_match(a, b) == len(pairs)
        assert all(x.label == y.label for x, y in pairs)


def test_long_runs_take_the_same_table(monkeypatch):
    import random

    rng = random.Random(3)

    def page(n):
        return "".join(rng.choice(("<h2>x</h2>", "<p>y</p>", "<ul><li>z</ul>", "<ul><li>z<li>z<p>w</ul>", "<pre>v</pre>")) for _ in range(n))

    # Over 40,000 pairs of regions, most of them out of step by more than 50.
    a, b = (ht.regions_of(ht.parse(f"<body>{x}</body>")) for x in ("<h3>s</h3>" + "<hr><table><tr><td>1</table>" * 60 + page(320), page(330) + "<h4>t</h4>"))
    size, pairs = ht.align(a, b)
    assert len(a.below) * len(b.below) > 40_000 and size == brute_match(a, b) == len(pairs)
    place = [{id(r): i for i, r in enumerate(t.below)} for t in (a, b)]
    order = sorted((place[0][id(r)], place[1][id(s)]) for r, s in pairs if id(r) in place[0])
    assert order == sorted(order, key=lambda p: p[1]) and all(r.label == s.label for r, s in pairs)
    # What is held of the table at once does not show.
    monkeypatch.setattr(ht, "TABLE_CELLS", 700)
    again = ht.align(a, b)
    assert again[0] == size and [(id(r), id(s)) for r, s in again[1]] == [(id(r), id(s)) for r, s in pairs]


def test_deep_and_long_pages_align_in_a_query(rows):
    deep = "<body>" + "<div>" * 20_000 + "x"
    long = "<body>" + "".join(f"<h2>{i}</h2><p>{i}" for i in range(10_000))
    uneven = "<body>" + "".join(f"<div>{'<ul><li>' * (i % 7)}{i}</div>" for i in range(3_000))
    pages = [(i, "http://h.example/", x + str(i)) for i, x in enumerate([deep, long, uneven, deep, long, "<body><p>short"])]
    got = {r.page_id: r.text for r in ht.main_text(rows(pages, "page_id long, url string, html string", 2)).collect()}
    assert got[0] == "x0" and got[5] == "short5" and got[1].endswith("9998\n9999\n99991")


def site(i, host="h.example", title=None):
    """Pages without any mark-up that names their parts: only the template tells."""
    return (
        i,
        f"http://{host}/{i}",
        f"<html><body><div><b>Site name</b> Home Contact</div><div><h2>{title or f'Title {i}'}</h2><p>Body {i} of page.</p>"
        f"<p>Shared line.</p></div><div>Legal text here</div></body></html>",
    )


def test_template_is_induced_from_the_host(rows):
    pages = [site(i) for i in range(12)] + [site(0)] * 10 + [site(99, "lone.example")]
    got = ht.main_text(rows(pages, "page_id long, url string, html string", 3)).collect()
    assert len(got) == 23
    for r in got:
        if r.page_id == 99:
            assert r.text.startswith("Site name")  # one page shows no template
        else:
            assert r.text == f"Title {r.page_id}\nBody {r.page_id} of page.\nShared line."


def test_copies_do_not_turn_content_into_template(rows):
    pages = [(i, *site(1)[1:]) for i in range(30)] + [site(2)]
    got = ht.main_text(rows(pages, "page_id long, url string, html string", 2)).collect()
    assert all("Body" in r.text for r in got)


def test_odd_rows(rows):
    data = [(1, None, None, "x"), (1, None, None, "y"), (2, "not a url", "", "z"), (None, "http://h.example/", "<p>a", "w")]
    got = ht.main_text(rows(data, "page_id long, url string, html string, host string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "a", 1), (1, "", 0), (1, "", 0), (2, "", 0)]
    assert ht.main_text(rows([], "page_id long, url string, html string")).count() == 0


def test_induction_decides_given_pages_without_any_list(spark, monkeypatch):
    """Wrappers of all hosts, and every page's content by them alone: no tags, classes or roles."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wrappers = ht.induce(pages, "url", "html")
    layouts = ht.common_layouts(wrappers)
    by_host = {r.host: ht.Wrapper(r.reference, set(r.constant), r.content, ht._path(r.path)) for r in wrappers.collect()}
    monkeypatch.setattr(ht, "is_content", lambda node, inside: node.tag not in ht.RAW)
    monkeypatch.setattr(ht, "article_of", lambda root: [])
    right = n = 0
    for p in pages.withColumn("host", ht.host_of("url")).collect():
        wrapper = by_host[p.host]
        wrapper.constant = set()
        text, by = ht.extract(p.html, wrapper, layouts)
        n += 1
        right += by == "induced" and text == brute(p.html)
    assert n >= 200 and right == n


def portal(i, host="p.example"):
    """No element says what it is: menus of links, changing adverts, a long list of links."""
    links = "".join(f"<li><a href=/{j}>Other story {i * j} with a long and telling title</a></li>" for j in range(30))
    return (
        i,
        f"http://{host}/{i}",
        f"<body><div><div><a href=/>Home</a> <a href=/{i}>Section {i}</a></div></div><div>Buy {i} now</div>"
        f"<table><tr><td><h2>Story {i}</h2><p>{'Words of the story. ' * (i % 7 + 3)}{i}</p><p>More {i}.</p></td></tr></table>"
        f"<div><ul>{links}</ul></div><div>Printed {i}</div></body>",
    )


def told(i):
    return f"Story {i}\n{'Words of the story. ' * (i % 7 + 3)}{i}\nMore {i}."


def test_content_without_names(rows):
    pages = [portal(i) for i in range(1, 20)] + [portal(50, "one.example"), (51, "http://two.example/", "<body><p>else")]
    got = {r.page_id: r for r in ht.main_text(rows(pages, "page_id long, url string, html string", 3)).collect()}
    assert all(got[i].text == told(i) and got[i].decided_by == "induced" for i in range(1, 20))
    # One page alone shows no template: it takes the layout of the other host, or is read whole.
    assert got[50].text == told(50) and got[50].decided_by == "induced"
    assert got[51].text == "else" and got[51].decided_by == "page"


def test_marked_articles_check_the_content(rows):
    def page(i, inner):
        return (i, "http://h.example/", f"<body><div>Menu {i}</div>{inner}</body>")

    words = "Many words of a story. " * 9
    around = [page(i, f"<div><article><h1>T{i}</h1><p>{words}{i}</article><div>By {i}</div></div>") for i in range(9)]
    got = ht.main_text(rows(around, "page_id long, url string, html string", 2)).collect()
    assert all(r.text == f"T{r.page_id}\n{words}{r.page_id}" for r in got)
    rejected = [page(i, f"<div class=comments><p>{words}{i}<h2>x{i}</h2></div><article><p>Own {i}</article>") for i in range(9)]
    got = ht.main_text(rows(rejected, "page_id long, url string, html string", 2)).collect()
    assert all((r.text, r.decided_by) == (f"Own {r.page_id}", "marked") for r in got)
