import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestone.llm import html as h


def text(source):
    return h.Page(source).main_text()


@pytest.mark.parametrize(
    "source,want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple\n\t&#233;&nbsp;x", "plain & simple é x"),
        ("<p>a<p>b<br>c<b>d</b>e", "a b cde"),
        ("<ul><li>one<li>two</ul>tail", "one two tail"),
        ("<table><tr><td>1<td>2<tr><th>3</table>x", "1 2 3 x"),
        ("<nav>menu</nav><article><h1>T</h1><p><b>x<br><p>y</article><footer>f</footer>", "T x y"),
        ("<header>site</header><main><header><h1>T</h1></header><p>x</p></main><aside>s</aside>", "T x"),
        ("<script>var t='</p>';</script><style>p{}</style><!-- no -->yes<form>f</form>", "yes"),
        ('<a title="a > b">link</a> text <div hidden>h</div>', "link text"),
        ("<div><p>open <div>in</div> x</p> y</div></div></p>z", "open in x y z"),
        ("<![CDATA[raw]]> <b>2 < 3</b> < 4", "raw 2 < 3 < 4"),
        ("<p>" * 3000 + "deep" + "<div>" * 3000 + "er", "deep er"),
        ("<article><p>keep</p><article class='comment'>no</article></article><p>out</p>", "keep"),
        ("<div>" * 20000 + "deep" + "</div>" * 20000 + "after" + "<i><p>" * 20000 + "p", "deep after p"),
        ("<div class='w-1/2'><ul><li><a href=x>home</a></ul><p>text</div>", "text"),
    ],
)
def test_page(source, want):
    assert text(source) == want


def brute_match(a, b):
    """Size of the best match over every order-preserving pairing of children, as defined."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        leaf = lambda k: not isinstance(k[0], str)
        if leaf(x[0]) or leaf(y[0]):
            w = int(leaf(x[0]) and leaf(y[0]))
        else:
            w = brute_match(x[0], y[0])
        return max(best(x[1:], y), best(x, y[1:]), w + best(x[1:], y[1:]) if w else 0)

    return 1 + best(a[1], b[1])


def leaves(tree):
    return sum(1 if not isinstance(k[0], str) else leaves(k) for k in tree[1])


def test_tree_matching_against_brute_force():
    r = random.Random(5)

    def tree(depth, tags):
        kids, before = [], None
        for _ in range(r.randrange(0, 4)):
            t = r.choice([x for x in tags if x != before])  # without runs both definitions are the same
            before = t
            kids.append((r.randrange(3), 1, 0) if t == "#" else (t, tree(depth - 1, tags)[1] if depth else ()))
        return ("r", tuple(kids))

    for _ in range(300):
        a, b = tree(2, "ab#"), tree(2, "ab#")
        assert h._weigh(a, b, {}) == brute_match(a, b)
        n = len(h.aligned(a, b))
        assert n <= min(leaves(a), leaves(b))


def page(i, body):
    return f"<html><body><div class=top>Welcome to the site</div><div class=links><a href=1>x{i}</a> <a href=2>y{i}</a></div><div class=story><p>{body}</p></div><div class=end>All rights reserved</div></body></html>"


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_wrapper_induction(spark, monkeypatch, broadcast):
    monkeypatch.setattr(h, "BROADCAST_CHARS", broadcast)
    rows = [(i, f"http://h.example/{i}", page(i, f"body {i} &eacute;")) for i in range(40)]
    rows += [(100 + i, f"http://single{i}.example/", page(i, f"alone {i}")) for i in range(2)]
    rows += [(200, None, "<p>no url</p>"), (201, "nonsense", None), (None, "http://h.example/x", page(7, "no id")), (3, "http://h.example/3", page(3, "body 3 &eacute;"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text", "1 AS host")
    got = sorted((r.page_id or -1, r.text, r.n_chars) for r in h.extract(pages).collect())
    want = [(i, f"body {i} é") for i in range(40)] + [(3, "body 3 é"), (-1, "no id"), (200, "no url"), (201, "")]
    want += [(100 + i, f"Welcome to the site alone {i} All rights reserved") for i in range(2)]
    want = [(i if i else -1, t) for i, t in want]
    assert got == sorted((i, t, len(t)) for i, t in want)
    assert h.extract(pages.limit(0)).count() == 0


def test_copies_do_not_make_content_template(spark):
    rows = [(i, "http://c.example/", page(0, "same everywhere")) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all("same everywhere" in r.text for r in h.extract(pages).collect())


@pytest.mark.parametrize(
    "source,want",
    [
        ("<html><head><title>T</title><body><p>text</p></body></html>", "text"),
        ("<html><head><title>T</title><meta charset=x><div>text</div>", "text"),
        ("<html><head><title>T</title><script>s</script>bare <b>text</b><p>more", "bare text more"),
        ("<head><noscript><p>no</p></noscript><title>T</title></head><body><p>text</p>", "text"),
        ("<div class='has-sidebar'><p>text</p></div>", "text"),
        ("<article class='post has-sidebar'><p>text</p></article>", "text"),
        ("<div class='content-sidebar-wrap'><article><p>text</p></article></div>", "text"),
        ("<div class='sidebar comments ad'><div><article><p>text</p></article></div></div>", "text"),
        ("<div class='widget'><main><p>text</p></main></div>", "text"),
        ("<form><div role='main'><p>text</p></div>button</form>", "text"),
        ("<div class='story'>a text of some length</div><div class='comments-area'><article class='comment'>nice</article></div>", "a text of some length nice"),
    ],
)
def test_no_article_is_lost(source, want):
    assert text(source) == want


def chrome(i, content):
    menu = "".join(f"<li>m{i} {k}</li>" for k in range(12))
    return f"<html><body><nav><ul>{menu}</ul></nav>{content}<footer>f{i}</footer></body></html>"


def test_article_is_not_template(spark):
    same = "<div class=story>" + "".join(f"<div>part {k}</div>" for k in range(6)) + "</div>"  # copies of one article, other menus
    rows = [(i, "http://copies.example/", chrome(i, same)) for i in range(20)]
    notes = "".join(f"<p>note {k}</p>" for k in range(9))  # one paragraph of ten varies
    rows += [(100 + i, "http://notes.example/", chrome(i, f"<article><p>body {i}</p><p>more {i}</p>{notes}</article>")) for i in range(20)]
    rows += [(200 + i, "http://role.example/", chrome(i, f"<div role=main><p>body {i}</p><p>more {i}</p>{notes}</div>")) for i in range(20)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("part 0 part 1 part 2 part 3 part 4 part 5" in got[i] for i in range(20))
    assert all(got[k + i].startswith(f"body {i} more {i}") for k in (100, 200) for i in range(20))


WORDS = "river stone meadow cloud forest amber candle harbor lantern meteor orchard pebble quarry saddle timber velvet".split()


def prose(seed, n):
    r = random.Random(repr(seed))
    return " ".join(r.choice(WORDS) for _ in range(n))


def untold(i):
    """A page without semantic tags and telling names: menu, advert, article, comments, footer. Advert and comments vary."""
    menu = "".join(f"<div class=x{k}><a href=/{k}>{prose(k, 2)}</a></div>" for k in "abcdef")
    body = "".join(f"<p>{prose((i, k), 40)}</p>" for k in range(3 + i % 4))
    said = "".join(f"<div class=q><b>{prose((i, k, 1), 1)}</b><div>{prose((i, k, 2), 9)}</div><div class=z>Reply</div></div>" for k in range(2 + i % 3))
    title = prose((i, "t"), 5)
    source = f"<body><div class=a>{menu}</div><div class=b>{prose((i, 'ad'), 8)}</div><div class=c><h1>{title}</h1><div class=d>{body}</div><div class=e>{said}</div></div><div class=f>All rights reserved {prose(i, 3)}</div></body>"
    return source, f"{title} " + " ".join(prose((i, k), 40) for k in range(3 + i % 4))


def test_slots_alone_tell_the_article(spark):
    made = [untold(i) for i in range(30)]
    pages = spark.createDataFrame([(i, "http://untold.example/", s) for i, (s, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    assert all(got[i] == want for i, (_, want) in enumerate(made))
    # without induction no page is right
    none = h.induce(pages).limit(0)
    assert all(r.text != made[r.page_id][1] for r in h.extract(pages, wrappers=none).collect())
    bare = pages.selectExpr("page_id", "'nonsense' AS url", "html")
    assert all(r.text != made[r.page_id][1] for r in h.extract(bare).collect())


def test_records_below_the_root(spark):
    def one(i):
        said = "".join(f"<div class=q><p>{prose((i, k), 9)}</p><p class=z>Reply</p></div>" for k in range(2 + i % 3))
        parts = "".join(f"<section><p>{prose((i, k, 's'), 60)}</p><p class=top>Back to top</p></section>" for k in range(3))
        return f"<body><div class=c>{parts}{said}</div></body>", " ".join(prose((i, k, "s"), 60) for k in range(3))

    made = [one(i) for i in range(12)]
    pages = spark.createDataFrame([(i, "http://r.example/", s) for i, (s, _) in enumerate(made)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in h.extract(pages).collect()} == {i: w for i, (_, w) in enumerate(made)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_induction_decides_the_texts_of_many_page_hosts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wrappers = h.induce(pages)
    known = {r.host: r.root for r in wrappers.collect()}
    plain = pages.selectExpr("page_id", "url", "regexp_replace(html, '</?(article|nav|footer|h1)[ >]', '<div>') AS html").cache()
    on, off = ({r.page_id: r.text for r in h.extract(plain, wrappers=w).collect()} for w in (None, wrappers.limit(0)))
    many = [r.page_id for r in plain.select("page_id", h.host_of(F.col("url")).alias("h")).collect() if r.h in known]
    assert len(many) > 150 and sum(on[i] != off[i] for i in many) > 0.9 * len(many)


def test_deep_pages_share_a_host(spark):
    deep = "<div>" * 20000 + "deep {}" + "</div>" * 20000
    pages = spark.createDataFrame([(i, "http://deep.example/", deep.format(prose(i, 9))) for i in range(4)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in h.extract(pages).collect()} == {i: f"deep {prose(i, 9)}" for i in range(4)}


#: What markup is, as one pattern: right, but of quadratic time on pages whose markup doesn't end.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)/?>", re.S | re.I)


def test_tokens_against_a_pattern():
    def plain(s):
        for m in MARKUP.finditer(s):
            yield (m.start(), m.end(), *((m[3] or "<", m[4].lower(), m[5]) if m[4] else ("!", "", m[2]) if m[2] is not None else ("", "", "")))

    bits = ["<", "</", ">", "<p ", "<script", "<script>", "</script>", "</script >", "<style-x>", "<!--", "-->", "<![CDATA[", "]]>", "<!", "<?", '"', "'", "a", "=", "x y", "/", "<scripty>", "<b a='1'>", "<![cdata[", " ", '<a href="x>y">', "</style\n>", "<style"]
    r = random.Random(4)
    for _ in range(20_000):
        s = "".join(r.choice(bits) for _ in range(r.randint(1, 12)))
        assert [t if t[2] else (*t[:3], "", "") for t in h.tokens(s)] == list(plain(s)), s


@pytest.mark.parametrize("bit", ["<p ", "<![CDATA[", '<p a="', "<p a='\"", "<script", "<!x", "</script", "<a b='", "<!--"])
def test_hostile_pages_take_linear_time(bit):
    for tail in ("", ">"):
        began = time.time()
        h.Page(bit * (1_000_000 // len(bit)) + tail)
        assert time.time() - began < 8  # a second at most on an idle machine
