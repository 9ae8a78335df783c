import pytest

from folio.llm import html_extraction, url_reputation
from tests.llm.fixtures import clashing

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu {0}</a></li></ul></nav><!-- ad -->
<div class="ad">buy</div><article><h1>Head &amp; {0}</h1><p>First  line\n of {0}<br><p><b>Second</b> &eacute;&#x41; <a href="a>b">link</a><div class="notice">cookies</div><form><input>send</form>
<section class="comments"><p>reader</p></section></article><footer>foot</footer></body></html>"""


def test_main_text():
    assert html_extraction.main_text(PAGE.format(1), frozenset()) == "Head & 1\nFirst line of 1\nSecond éA link"


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain &lt; text", "plain < text"), ("<p>a<p>b", "a\nb"), ("<p unclosed", "<p unclosed"), ("<article><p>x", "x"), ("<main>m</main>rest", "m"), ("<script>x", "")])
def test_odd_pages(page, text):
    assert html_extraction.main_text(page, frozenset()) == text


def test_long_and_hostile_pages_take_linear_time():
    for page in ("<" * 100_000, "<a " * 50_000, '<a "' * 30_000, "<p>" * 50_000 + "x", "&" * 100_000, "<div>" * 20_000 + "x" + "</div>" * 20_000):
        html_extraction.main_text(page, frozenset())


def test_repeated_branches_of_a_site_go(spark):
    body = "<html><body><div id=top><p>Welcome to the site</p></div><div id=story><p>{0} tells {0} a story</p></div></body></html>"
    rows = [(i, f"http://h.example.com/{i}", body.format(f"n{i}")) for i in range(20)] + [(100, "http://other.example.com/", body.format("m")), (101, None, None)]
    d = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in html_extraction.extract_text(d).collect()}
    assert got[3].text == "n3 tells n3 a story" and got[3].n_chars == len(got[3].text)
    assert got[100].text == "Welcome to the site\nm tells m a story" and got[101].text == ""
    assert html_extraction.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_an_article_is_never_cut_by_entropy(spark):
    rows = [(i, f"http://h.example.com/{i}", PAGE.format("same") + " " * i) for i in range(30)]
    got = html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"Head & same\nFirst line of same\nSecond éA link"}


def test_an_article_in_a_dropped_branch_marks_nothing():
    page = "<body><div><p>story</p></div><section class=comments><article><p>reader</p></article></section><aside><article>related</article></aside></body>"
    assert html_extraction.main_text(page, frozenset()) == "story"


def test_a_repeated_notice_in_an_article_goes(spark):
    body = "<body><p>{0} x</p><article><h1>About {0}</h1><p>{0} tells {0}</p><p>The same line</p><div><b>Read our terms first</b></div></article></body>"
    rows = [(i, f"http://h.example.com/{i}", body.format(f"n{i}")) for i in range(20)]
    got = {r.page_id: r.text for r in html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"About n{i}\nn{i} tells n{i}\nThe same line" for i in range(20)}


@pytest.mark.parametrize("page, text", [
    ('<div class="layout has-sidebar"><p>Body text.</p></div>', "Body text."), ('<main class="col-with-sidebar"><p>x</p><div class="ad box">buy</div></main>', "x"),
    ('<article class="teaser">short</article><div class="content"><p>The real content of the page</p></div>', "short\nThe real content of the page"),
])
def test_only_whole_names_drop_and_small_articles_mark_nothing(page, text):
    assert html_extraction.main_text(page, frozenset()) == text


def test_importance_is_that_of_a_plain_merged_tree(spark):
    """Equal pages count once on any number of partitions; hosts of many pages may be split."""
    import math
    from collections import Counter

    body = "<body><div><p>{0}</p><i>same</i></div><ul><li>{1}</li></ul></body>"
    pages = [("a", body.format("x", k % 3)) for k in range(12)] + [("a", body.format(f"t{k}", 1)) for k in range(6)] + [("b", body.format("x", 1))] * 5
    says: dict = {}
    for host, page in set(pages):
        for path, _, _, text in html_extraction.blocks_of(page)[0]:
            says.setdefault((host, path), Counter()).update([text])
    for parts in (1, 6):
        tree = html_extraction.style_tree(spark.createDataFrame(pages, "host string, html string").repartition(parts)).collect()
        for r in tree:
            n = says.get((r.host, r.path))
            if n:
                total = sum(n.values())
                h = -sum(c / total * math.log(c / total) for c in n.values()) / math.log(total) if total > 1 else 1.0
                assert r.seen == total and abs(r.importance - (h * total + 2) / (total + 2)) < 1e-9
    d = spark.createDataFrame([(i, f"http://{h}/", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    plain = {r.page_id: r.text for r in html_extraction.extract_text(d).collect()}
    was, html_extraction.MOST_NODES = html_extraction.MOST_NODES, -1
    try:
        assert {r.page_id: r.text for r in html_extraction.extract_text(d).collect()} == plain
    finally:
        html_extraction.MOST_NODES = was


ARTICLE = "<article><h1>Title of it</h1><p>The long body of the story is here.</p></article>"
STORY = "Title of it\nThe long body of the story is here."


@pytest.mark.parametrize("page, text", [
    ('<div class="story share"><p>Body about shares.</p></div>', "Body about shares."), (f"<form>{ARTICLE}</form>", STORY), ("<form id=f><p>only the body</p></form>", "only the body"),
    ("<article><header><h1>Title</h1></header><p>Body text</p></article>", "Title\nBody text"), ("<header><h1>Site</h1></header><p>Body text</p>", "Body text"),
    ('<div class="cookie-banner">We use cookies</div><div class="site-nav">home</div><p>Body</p><div class="comments-list"><p>reader</p></div>', "Body"),
    ('<div class="col-with-sidebar"><p>x</p></div><div id="form_group"><p>perhaps</p></div>', "x\nperhaps"), ('<article><form><p>A comment, please</p></form><p>The body of the story</p></article>', "The body of the story"),
])
def test_names_are_priors(page, text):
    assert html_extraction.main_text(page) == text


def test_branches_are_cut_as_in_a_plain_tree(spark):
    """Importances, branch means and cuts beside plain recursion over the nodes, on pages with menus that repeat or don't."""
    import random

    rng, pages = random.Random(5), []
    for i in range(60):
        words = lambda n: " ".join(rng.choices(["ka", "lo", "mi", "ter"], k=n)) + f" {i}"  # noqa: B023,E731
        menu = rng.choice([words(3), "same menu", "other menu"])
        body = f"<div class=card_group><p>{words(4) if i % 5 == 0 else 'a frequent card'}</p></div><div class=form_extra><p>{'terms' if i % 4 else words(3)}</p></div><p>{words(12)}</p>"
        pages.append((i, f"http://h{i % 3}.example.com/{i}", f"<body><nav>{menu}</nav><div><span>Welcome</span></div>{f'<article><h2>Head</h2>{body}<p>See more</p></article>' if i % 2 else body}<footer>foot</footer></body>"))
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    tree: dict = {}
    for r in html_extraction.style_tree(d.selectExpr("split(url, '/')[2] AS host", "html")).collect():
        tree.setdefault(r.host, {})[r.path] = r.importance
    by_entropy = 0
    for r in html_extraction.extract_text(d).collect():
        page = pages[r.page_id][2]
        own = tree[r.url.split("/")[2]]
        nodes, blocks = html_extraction.read_page(page)

        def within(k, e):
            return k == e or k != 0 and within(nodes[k].up, e)

        def branch(e):
            inside = [(len(t), 1.0 if nodes[b].mark and nodes[b].name in html_extraction.HEADINGS else own.get(nodes[b].path, 1.0)) for at, b, t in blocks if within(at, e)]
            return sum(n * x for n, x in inside) / sum(n for n, _ in inside) if inside else 1.0

        def combined(e):
            return branch(e) if e == 0 else branch(e) * combined(nodes[e].up) ** 0.2

        def gone(e):
            return nodes[e].prior * branch(e) < 0.3 if e == 0 else gone(nodes[e].up) or nodes[e].prior < 1 and nodes[e].prior * branch(e) < 0.3

        left = [b for b in blocks if not gone(b[0])]
        marked = [b for b in left if nodes[b[0]].mark]
        marked = marked if 2 * sum(len(b[2]) for b in marked) >= sum(len(b[2]) for b in left) else []
        kept = [t for _, b, t in marked or left if nodes[b].mark and nodes[b].name == "h2" or combined(b) >= (0.1 if nodes[b].mark else 0.3)]
        assert r.text == "\n".join(kept), page
        by_entropy += r.text != html_extraction.main_text(page)
    assert by_entropy > 20


def test_copies_of_an_article_do_not_wear_it_out(spark):
    rows = [(i, "http://h.example.com/", f"<body><p>menu {i}</p>{ARTICLE}</body>") for i in range(40)] + [(7, "http://h.example.com/", None)]
    got = [r.text for r in html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == [""] + [STORY] * 40


def test_layouts_tell_long_lists_apart():
    one, two = (html_extraction.blocks_of("<div>" + "<p>a</p>" * 70 + f"<{x}>a</{x}></div>")[1] for x in ("h2", "h3"))
    assert one[-2] != two[-2]


URLS = [
    ("http://A.Example.org/es/1?q", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12#x", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/22", "example.org", "/en/22", "org/", "allow"), ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"),
    ("http://x.com", "x.com", "", None, "allow"), ("http://x.org", "x.org", "", None, "allow"), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("s://É.ORG/p\nq?r", "É.org".replace("É", "É"), "/p\nq", "org/", "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
]


def test_rules_and_parts(spark):
    d = clashing(spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for r in url_reputation.filter_urls(d, labels).collect():
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:], r


def test_reputation_shrinks_and_blocks(spark):
    pages, labels = [], []
    for host, n, bad in (("bad.one.net", 60, 54), ("good.one.net", 60, 3), ("few.one.net", 2, 2), ("none.one.net", 0, 0), ("ok.two.net", 200, 10)):
        for k in range(max(n, 1)):
            pages.append((len(pages), f"http://{host}/{k}"))
            if n:
                labels.append((pages[-1][0], 0 if k < bad else 1))
    p, q = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")
    hosts = {r.host: r for r in url_reputation.host_reputation(p, q).collect()}
    assert hosts["bad.one.net"].bad_rate > 0.8 and hosts["good.one.net"].bad_rate < 0.15
    assert 0.2 < hosts["few.one.net"].bad_rate < 1.0 and hosts["few.one.net"].lower < hosts["bad.one.net"].lower
    assert hosts["none.one.net"].labelled == 0 and 0 < hosts["none.one.net"].bad_rate < 1
    verdicts = {r.host: r.verdict for r in url_reputation.filter_urls(p, q).collect()}
    assert verdicts["bad.one.net"] == "block" and verdicts["good.one.net"] == verdicts["none.one.net"] == "allow"


def test_reputation_is_that_of_plain_arithmetic(spark):
    """Rules and seed words as outcomes; every posterior beside a plain one, own pages left out of each prior."""
    from collections import defaultdict

    urls = [f"http://{h}/{p}/{k}" for h, n in (("casino-win.a.com", 9), ("ok.a.com", 12), ("shop.b.com", 5), ("x.b.net", 30), ("free-bets.c.net", 1), ("y.co.uk", 4)) for k in range(n) for p in ("de", "en")[k % 3 == 0 :]] + [None, "nothing"]
    pages = clashing(spark.createDataFrame([(i % 7 or None, u) for i, u in enumerate(urls)], "page_id long, url string"))
    bad, n = defaultdict(int), defaultdict(int)
    for u in urls:
        host, path = (u.split("/", 3)[2], "/" + u.split("/", 3)[3]) if u and "://" in u else ("", "")
        n[host], bad[host] = n[host] + (host != ""), bad[host] + ((path.startswith("/de/") if host.endswith(".com") and path.startswith("/de/") else "casino" in host or "bets" in host) if host else 0)
    suffix_of = lambda d: "co.uk" if d.endswith("co.uk") else d.split(".")[-1]
    domain_of = lambda h: h if h.endswith("co.uk") else ".".join(h.split(".")[-2:])

    def sums(up, keys):
        out = defaultdict(lambda: [0, 0])
        for k in keys:
            out[up(k)][0] += keys[k][0]
            out[up(k)][1] += keys[k][1]
        return out

    hosts = {h: [n[h], bad[h]] for h in n}
    domains = sums(domain_of, hosts)
    suffixes = sums(suffix_of, domains)

    def strength(level):
        v = [x for x in level.values() if x[0]]
        sn, sb = sum(x[0] for x in v), sum(x[1] for x in v)
        p = (sb + 1) / (sn + 2)
        between = (sum(x[1] ** 2 / x[0] for x in v) - sn * p * p - len(v) * p * (1 - p)) / max(sn - sum(x[0] ** 2 for x in v) / sn, 1e-9)
        return 1000.0 if between <= 1e-9 else min(1000.0, max(1.0, p * (1 - p) / between - 1))

    def posterior(level, above):
        m, out = strength(level), {}
        for k, (count, wrong) in level.items():
            pa, pb = above(k)
            prior = (pa - wrong) / (pa + pb - count)
            out[k] = (wrong + m * prior, count - wrong + m * (1 - prior))
        return out

    everything = (sum(bad.values()) + 1.0, sum(n.values()) - sum(bad.values()) + 1.0)
    mid = posterior(suffixes, lambda k: everything)
    low = posterior(domains, lambda k: mid[suffix_of(k)])
    found = posterior(hosts, lambda k: low[domain_of(k)])
    got = {r.host: r for r in url_reputation.host_reputation(pages).collect()}
    assert set(got) == set(found)
    for h, (a, b) in found.items():
        sd = (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        assert abs(got[h].bad_rate - a / (a + b)) < 1e-9 and abs(got[h].lower - max(0, a / (a + b) - 1.64 * sd)) < 1e-9, h
    rows = url_reputation.filter_urls(pages).collect()
    assert len(rows) == len(urls)
    for r in rows:
        if r.rule is None:
            assert (r.verdict == "block") == (got[r.host].lower > 0.3)
    assert {r.verdict for r in rows if r.host == "casino-win.a.com"} == {"block"}
    assert url_reputation.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
