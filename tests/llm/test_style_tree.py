import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from stacklight.llm import style_tree


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><h1>A &amp; B</h1><p>x<br>y  z&nbsp;w</p><p>two</article>", "A & B\n\nx y z w\n\ntwo"),
        ("<nav>menu</nav><main><p>a<p>b</main><footer>f</footer>", "a\n\nb"),
        ("<div class='ad'>buy</div><div><p>text <b>bold</b>er</p></div><script>var a='</p><p>no';</script>", "text bolder"),
        ("<header>top</header><article><header><h1>title</h1></header><p>t</p><aside>s</aside><form>f</form></article>", "title\n\nt"),
        ("<article><p>t</p><section class='comments'><article class='comment'>c</article></section><div class='notice-box'>n</div></article>", "t"),
        ("<body class='has-sidebar'><div id='sidebar-left'>s</div><div class='content sidebar'><article><p>t</p></article></div>", "t"),
        ("<p hidden>no</p><p style='display: none'>no</p><div role=navigation>no</div><p>yes", "yes"),
        ("<p>a<!-- <p>no</p> -->b</p><ul><li>1<li>2</ul><table><tr><td>x<td>y</table><!-- open", "ab\n\n1\n\n2\n\nx\n\ny"),
        ("</div>stray</p> &#233;&lt;b&gt; a < b", "stray\n\né<b> a < b"),
        ("", ""),
        ("<html><head><title>T</title><style>p{}</style></head><body><nav>x</nav></body></html>", ""),
    ],
)
def test_page_text(html, text):
    assert style_tree.page_text(html, {}) == text


SCHEMA = "page_id long, url string, html string, host int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


def test_template_branches_are_cut_by_importance(spark):
    rows = [(i, f"http://H.example/{i}", f"<div class='top x{i}'>Welcome to the site</div><div class='body'><p>Own text {i} of the page</p></div>") for i in range(12)]
    rows += [(100 + i, f"http://mirror.example/{i}", "<article><p>The same article</p></article>") for i in range(12)]
    rows += [(200, "http://small.example/", "<section class='top x'>Welcome to the site</section>")]
    got = {r.page_id: r for r in style_tree.extract(pages(spark, rows)).collect()}
    assert all(got[i].text == f"Own text {i} of the page" and got[i].n_chars == len(got[i].text) for i in range(12))
    assert all(got[100 + i].text == "The same article" for i in range(12)) and got[200].text == "Welcome to the site"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><h2 id='how-to-share-a-form'>How</h2><p>a</p><section id='related-work'><h2 id='discussion'>Work</h2><p>b</p></section><div class='discussion'><p class='copyright'>c</p></div></article>", "How\n\na\n\nWork\n\nb\n\nc"),
        ("<article class='post category-social tag-search'><p>a</p></article><div class='related-posts'>r</div>", "a"),
        ("<div class='content with-sidebar'><p>a</p></div><div class='sidebar-left'>s</div><div id='footer'>f</div><ul class='share-buttons'><li>x</ul>", "a"),
        ("<div class='content sidebar'><p>the only text</p></div><nav>n</nav>", "the only text"),
        ("<div class='section' id='discussion'><h1>Discussion</h1><p>a</p></div>", "Discussion\n\na"),
    ],
)
def test_names_don_t_take_the_article(html, text):
    assert style_tree.page_text(html, {}) == text


def test_copies_on_a_host_keep_their_text(spark):
    page = lambda text, menu="": f"<html><body><nav>{menu}</nav><div class='text'><p>{text}</p></div></body></html>"
    rows = [(i, None, page("The copied text")) for i in range(10)]
    rows += [(100 + i, "http://a.example/", page("The copied text" if i < 8 else f"Own text {i}")) for i in range(10)]
    # copies that differ outside the text
    rows += [(200 + i, "http://b.example/", page("The copied text" if i < 16 else f"Own text {i}", f"menu {i}")) for i in range(18)]
    rows += [(300 + i, "http://c.example/", f"<nav>{i}</nav><article><h1>Title</h1><div class='body'><p>The copied text</p></div></article>") for i in range(12)]
    got = {r.page_id: r.text for r in style_tree.extract(pages(spark, rows)).collect()}
    own = {i: f"Own text {i % 100}" for i in (108, 109, 216, 217)}
    assert got == {i: own.get(i, "Title\n\nThe copied text" if i >= 300 else "The copied text") for i, _, _ in rows}


def template_site(hosts, per_host, seed=5):
    """Pages whose tags and names say nothing: (page_id, url, html, article). Menu, advert and foot come from a few texts."""
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    menus, adverts = [[words(1) for _ in range(6)] for _ in range(8)], [words(9) for _ in range(8)]
    rows = []
    for h in range(hosts):
        for i in range(per_host):
            title, paragraphs = words(5), [words(rng.randrange(4, 40)) for _ in range(rng.randrange(1, 6))]
            menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.choice(menus))
            body = "".join(f"<p>{p}</p>" for p in paragraphs)
            html = f"<html><body><div class='z{i}'><ul>{menu}</ul></div><div class='q'>{rng.choice(adverts)}</div><h1>{title}</h1>{body}<div class='y'>h{h} {rng.choice(adverts)}</div></body></html>"
            rows.append((h * 1000 + i, f"http://h{h}.example/{i}", html, "\n\n".join([title, *paragraphs])))
    return rows


def test_the_tree_alone_finds_the_article(spark):
    rows = template_site(4, 30)
    got = {r.page_id: r.text for r in style_tree.extract(pages(spark, [r[:3] for r in rows])).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_a_small_host_is_judged_by_the_tree_of_all(spark):
    rows = template_site(12, 12, 6)
    own = f"<html><body><div class='z'><ul><li>{'</li><li>'.join(['one', 'two'])}</li></ul></div><h1>title</h1><p>body</p></body></html>"
    got = {r.page_id: r.text for r in style_tree.extract(pages(spark, [r[:3] for r in rows] + [(-1, "http://new.example/", own)])).collect()}
    assert got[-1] == "title\n\nbody"


def test_importance_by_brute_force(spark):
    rows = [r[:3] for r in template_site(3, 9, 7)]
    rows += [(5000 + i, "http://h0.example/x", rows[0][2]) for i in range(4)]  # equal pages count once
    seen, trails = defaultdict(set), {}
    for _, url, html in rows:
        for page, path, trail, shown, content in style_tree.page_nodes(html, url.split("/")[2]):
            seen[url.split("/")[2], path].add((page, shown, content))
            trails[path] = trail

    def value(nodes):
        m = len(nodes)
        if m == 1:
            return 1.0
        p = -sum(n / m * math.log(n / m, m) for n in Counter(s for _, s, _ in nodes).values())
        counts = Counter(c for _, _, c in nodes).values()
        c = 1 - sum(math.log(n, m) for n in counts) / len(counts)
        return c + (1 - c) * style_tree.GAMMA * p

    every, alike = defaultdict(list), defaultdict(list)
    for (_, path), nodes in seen.items():
        every[path] += nodes
        alike[trails[path]] += nodes
    want = {}
    for (h, path), nodes in seen.items():
        a = min(style_tree.ALL_PAGES, len(every[path]) - len(nodes))
        b = min(style_tree.ALL_PAGES - a, len(alike[trails[path]]) - len(every[path]))
        of_all = a * value(every[path]) + b * value(alike[trails[path]])
        want[h, path] = (len(nodes) * value(nodes) + of_all + style_tree.PRIOR_PAGES) / (len(nodes) + a + b + style_tree.PRIOR_PAGES), len(nodes) + a + b
    got = {(r.host, r.path): (r.importance, r.seen) for r in style_tree.style_tree(style_tree.counted(pages(spark, rows))).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def neutral(html):
    """A page whose tags and names say nothing."""
    html = re.sub(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", html)
    return re.sub(r"<(/?)(?:article|main|nav|aside|header|footer|section)\b", r"<\1div", html)


def test_page_sets(spark):
    """The given pages as they are, without article and main, and with neutral tags and names: the tree gives the same articles; an
    empty one and one that finds everything important don't."""
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    run = lambda change: {r.page_id: r.text for r in style_tree.extract(pages(spark, [(r.page_id, r.url, change(r.html)) for r in given])).collect()}
    plain = run(lambda h: h)
    assert all(plain.values()) and run(lambda h: re.sub(r"<(/?)(?:article|main)\b", r"<\1div", h)) == plain
    bare = run(neutral)
    assert sum(bare[i] == plain[i] for i in plain) >= 0.9 * len(plain)
    assert all(style_tree.page_text(neutral(r.html), {}) != plain[r.page_id] for r in given)
    for r in given[:50]:
        blocks, nodes = style_tree.parse(r.html)
        style_tree.place(nodes)
        assert style_tree.page_text(r.html, {n.path: 1.0 for n in nodes}) != plain[r.page_id]  # names alone don't outvote the tree


def test_comments_go_by_their_names(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    rows = []
    for i in range(150):
        text = words(30)
        rows.append((i, "http://a.example/", f"<nav>menu</nav><div><h1>t{i}</h1><p>{text}</p></div><div class='comments'><p>{words(9)}</p></div><form>{words(3)}</form>", f"t{i}\n\n{text}"))
    got = {r.page_id: r.text for r in style_tree.extract(pages(spark, [r[:3] for r in rows])).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_deep_pages_take_linear_time():
    deep = "<div class=x>" * 70_000 + "text"
    began = time.time()
    assert style_tree.page_text(deep, {}) == "text" and len(style_tree.page_nodes(deep)) == 70_000
    assert style_tree.page_text("<p><b>" * 50_000 + "x" + "<svg>" * 50_000, {}) == "x"
    assert time.time() - began < 60


def test_edge_cases(spark):
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (2, "x", None), (None, "http://a/", ""), (3, "http://a/", "<p>" + "long " * 100_000)]
    got = style_tree.extract(pages(spark, rows)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 499_999)]
    assert style_tree.extract(pages(spark, [])).collect() == []
