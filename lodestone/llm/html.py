"""Main text of web pages by wrapper induction over pages of one host.

1. A page becomes a tree of block elements (inline markup is transparent), with a leaf per block of text. Elements that HTML
   itself calls no content (scripts, navigation, footers, asides, forms, hidden ones) are left out. A slot is a path of labels:
   tags with their class and id.
2. Pages of a host are aligned in a chain, each with the next, by simple tree matching: the largest order-preserving match
   of equal labels from the root down; runs of siblings with one label match member by member. Aligned leaves with equal
   text vote their slot constant, others vote it varying. Pairs of pages with (near) equal prose don't vote.
3. Votes and characters are summed per host and slot over all pages. Constant and link-dense slots are template. Varying text
   is summed up the slots: the deepest element that a page has once and that holds most of the varying text is the
   content root. Elements in it that come several to a page, each with a template slot of its own (a "reply" link, say), and
   that hold little of the root's text are records of other people's texts or of other pages, and are template, too.
4. A page's text is its blocks under the content root outside template, and varying first headings beside the root. No
   class name has a meaning of its own. A page that no other page of its host was aligned with, or that has nothing under
   the root, is judged by itself: the blocks of its article or main element, or all where none is marked.

Skeletons (labels and checksums) are dealt by ranges of (host, hash of the page id): pages of a host stand together and
a crowded host spreads over as many tasks as its share of all pages, with a chain in each. The html itself moves only where
wrappers are too large to broadcast.

Pages of any markup take time in proportion to their length. Cases: null and empty html give an empty text; pages without or with a malformed url belong to no host and are judged by
themselves; unclosed and stray tags are repaired as browsers do for paragraphs, list items and table cells; elements nested
deeper than MAX_DEPTH count as part of the element at that depth (their text stays, in blocks of its own); repeated rows
each return a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import marshal
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Least votes and share of constant votes, and share of link characters, that make a slot template; and the least share
#: of its host's pages that have it, which bounds a host's template by a hundred times the slots of a page.
LEAST_VOTES, CONSTANT_SHARE, LINK_SHARE, LEAST_PAGES = 3, 0.8, 0.5, 0.01
#: Share of the varying text that the content root holds (over a half, so that such elements form one chain), and the most of
#: the root's text that records may hold.
ROOT_SHARE, RECORD_SHARE = 0.6, 0.4
#: Pairs with this share of equal prose are copies and don't vote; blocks of this many characters are prose.
COPY_SHARE, PROSE = 0.9, 80
MAX_DEPTH = 100
#: Characters of wrappers up to which they are broadcast; beyond, hosts are split over so many tasks.
BROADCAST_CHARS, SALTS = 16_000_000, 64

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSE_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element that a sibling of the same group closes, and where the search for it ends.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: By the HTML standard no content of the page; forms and headers only where no article is in them.
NO_CONTENT = frozenset("nav footer aside script style noscript iframe svg button select textarea template head title dialog menu object canvas audio video".split())
SOFT = frozenset("form header".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: What <head> may hold; any other element, or text, closes it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
#: Elements that can be a content root or a record.
CONTAINERS = frozenset("html body div main article section center td tr li dd ul ol form header".split())
NAME = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)")
RAW = {"script": re.compile(r"</script\s*+>", re.I), "style": re.compile(r"</style\s*+>", re.I)}
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([\w:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    """hard: no content, for good; soft: path of the innermost form or header that no article or main element is below."""

    __slots__ = ("tag", "label", "path", "kids", "hard", "soft", "main", "article")

    def __init__(self, tag: str, label: str, path: str, hard: bool = False, soft: str = "", main: bool = False, article: bool = False):
        self.tag, self.label, self.path, self.hard, self.soft, self.main, self.article, self.kids = tag, label, path, hard, soft, main, article, []


def tokens(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, name, rest) of markup in order: kind `<` a start tag with its attributes, `/` an end tag, `!` text of a CDATA
    section, and empty what is dropped (comments, declarations, scripts and styles with their content). A `<` that opens nothing
    is text. What isn't found up to the end of the page isn't looked for again, so any page takes time in proportion to its length."""
    none: dict[str, int] = {}  # from where on what comes no more
    dead: set[int] = set()  # places of quotes from which no tag ends

    def find(what: str, at: int) -> int:
        if at >= none.get(what, len(source)):
            return -1
        k = source.find(what, at)
        if k < 0:
            none[what] = at
        return k

    def tag_end(at: int) -> int:
        """The `>` outside quotes that ends a tag, from within it."""
        passed = []
        while m := (None if at >= none.get("tag", len(source)) else STOP.search(source, at)):
            k = m.start()
            if m[0] == ">":
                return k
            if k in dead or (close := find(m[0], k + 1)) < 0:
                passed.append(k)
                dead.update(passed)
                return -1
            passed.append(k)
            at = close + 1
        none["tag"] = min(at, none.get("tag", at))
        dead.update(passed)
        return -1

    at = source.find("<")
    while at >= 0:
        end = kind = None
        name = rest = ""
        if source.startswith("<!--", at):
            k = find("-->", at + 4)
            end, kind = (k + 3 if k >= 0 else len(source)), ""
        elif source[at + 1 : at + 2] in ("!", "?"):
            if source[at : at + 9].upper() == "<![CDATA[" and (k := find("]]>", at + 9)) >= 0:
                end, kind, rest = k + 3, "!", source[at + 9 : k]
            elif (k := find(">", at + 2)) >= 0:
                end, kind = k + 1, ""
        elif m := NAME.match(source, at):
            name = m[2].lower()
            raw = RAW.get(name) or (RAW.get(name.split("-")[0].split(":")[0]) if not m[1] else None)
            if raw and not m[1]:
                if (k := find(">", m.end())) >= 0:
                    closed = raw.search(source, k + 1)
                    end, kind = (closed.end() if closed else len(source)), ""
            elif (k := tag_end(m.end())) >= 0:
                end, kind, rest = k + 1, m[1] or "<", source[m.end() : k]
        if end is None:
            at = source.find("<", at + 1)
        else:
            yield at, end, kind, name, rest
            at = source.find("<", end)


class Page:
    """Blocks of a page in order, (node, text, link characters), and the root of its tree."""

    def __init__(self, source: str | None):
        self.root = Node("", "", "")
        self._opened: dict[str, int] = defaultdict(int)
        self.blocks: list[tuple[Node, str, int]] = []
        self._stack, self._text, self._links, self._in_link = [self.root], [], 0, False
        source, at = source or "", 0
        for start, end, kind, name, rest in tokens(source):
            if start > at:
                self._add(source[at:start])
            at = end
            if kind in ("<", "/"):
                (self._end if kind == "/" else self._start)(name, rest)
            elif kind == "!":
                self._add(rest)
        if at < len(source):
            self._add(source[at:])
        self._flush()

    def _close_head(self) -> None:
        if self._stack[-1].tag == "head":
            self._pop_to(len(self._stack) - 1)

    def _add(self, text: str) -> None:
        if self._stack[-1].tag == "head" and text.strip():  # as browsers do, where </head> is left out
            self._close_head()
        self._text.append(text)
        if self._in_link:
            self._links += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text:
                node = self._stack[-1]
                links = min(self._links, len(text))
                self.blocks.append((node, text, links))
                if not node.hard:
                    node.kids.append((zlib.crc32(text.encode("utf-8", "surrogatepass")), len(text), links))
            self._text, self._links = [], 0

    def _pop_to(self, k: int) -> None:
        self._flush()
        for node in self._stack[k:]:
            self._opened[node.tag] -= 1
        del self._stack[k:]

    def _open(self, tags: set[str], until: set[str]) -> int | None:
        """Place in the stack of the innermost open element of some tags, within those of others."""
        if not any(self._opened[t] for t in tags):
            return None
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].tag in tags:
                return k
            if self._stack[k].tag in until:
                return None
        return None

    def _start(self, tag: str, raw: str) -> None:
        if tag == "body" and (k := self._open({"head"}, {"body", "template"})) is not None:
            self._pop_to(k)
        elif tag not in IN_HEAD:
            self._close_head()
        if tag in INLINE:
            self._in_link = self._in_link or tag == "a"
            return
        if tag in VOID:
            self._text.append(" ")
            return
        if tag in CLOSE_P and (k := self._open({"p"}, {"table", "td", "th", "button", "li"})) is not None:
            self._pop_to(k)
        if tag in SIBLINGS and (k := self._open(*SIBLINGS[tag])) is not None:
            if tag == "tr":
                k = next(i for i in range(len(self._stack) - 1, 0, -1) if self._stack[i].tag in {"tr", "table"})
                k = k if self._stack[k].tag == "tr" else k + 1
            self._pop_to(k)
        self._flush()
        self._in_link = False
        up = self._stack[-1]
        attributes = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(raw)} if raw and raw.strip() else {}
        names = attributes.get("class", ""), attributes.get("id", "")
        label = tag + "".join(mark + " ".join(n.replace("/", "_").split()) for mark, n in zip(".#", names) if n and not any(c.isdigit() for c in n))
        role = attributes.get("role", "").lower()
        whole, article = tag == "main" or role == "main", tag == "article" or role == "article"
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
        # the standard nests articles in an article where they are comments on it
        hard = up.hard or tag in NO_CONTENT or role in NO_ROLE or hidden or (article and up.article)
        self._opened[tag] += 1
        if len(self._stack) > MAX_DEPTH:
            node = Node(tag, up.label, up.path, hard, up.soft, up.main, up.article)
            node.kids = up.kids
        else:
            path = f"{up.path}/{label}"
            soft = "" if whole or article else path if tag in SOFT and not up.main else up.soft
            node = Node(tag, label, path, hard, soft, up.main or whole or article, up.article or article)
            if not hard:
                up.kids.append(node)
        self._stack.append(node)

    def _end(self, tag: str, _: str) -> None:
        if tag in INLINE:
            self._in_link = self._in_link and tag != "a"
        elif tag in VOID:
            self._text.append(" ")
        elif (k := self._open({tag}, {"table", "article", "main", "body"} - {tag} if tag in ("p", "li", "td", "th", "tr", "div", "span") else set())) is not None:
            self._pop_to(k)
            self._in_link = False

    def skeleton(self) -> tuple:
        """The tree as (label, kids) with leaves (checksum, characters, link characters); what is no content is left out."""

        def down(root: Node) -> tuple:
            # without recursion: a page may nest deeply
            made: dict[int, tuple] = {}
            todo = [(root, False)]
            while todo:
                node, ready = todo.pop()
                if not ready:
                    todo.append((node, True))
                    todo.extend((k, False) for k in node.kids if isinstance(k, Node))
                else:
                    made[id(node)] = (node.label, tuple(made.pop(id(k)) if isinstance(k, Node) else k for k in node.kids))
            return made[id(root)]

        return down(self.root)

    def main_text(self, wrapper: Wrapper | None = None) -> str:
        if wrapper is not None:
            kept = [t for n, t, _ in self.blocks if not n.hard and wrapper.holds(n)]
            if kept:
                return " ".join(kept)
        return " ".join(self._alone())

    def _alone(self) -> list[str]:
        """The page judged by itself: what it marks as article or main, if that is much of it; slots of links are left out."""
        dense: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for n, t, links in self.blocks:
            d = dense[n.path]
            d[0], d[1] = d[0] + len(t), d[1] + links
        own = [(n, t) for n, t, _ in self.blocks if not n.hard and not n.soft and (n.main or dense[n.path][1] <= LINK_SHARE * dense[n.path][0])]
        inside = sum(len(t) for n, t in own if n.main)
        marked = inside > 0 and inside >= (1 - ROOT_SHARE) * sum(len(t) for _, t in own)
        return [t for n, t in own if n.main or not marked]


class Wrapper:
    """Content root of a host and the template slots below it."""

    def __init__(self, root: str, template: Iterable[str] = ()):
        self.root, self.template = root, frozenset(template)
        above = root.split("/")
        #: Elements that the root is in.
        self.above = {"/".join(above[:k]) for k in range(1, len(above))}
        self._known: dict[str, bool] = {}

    def _content(self, path: str) -> bool:
        if path not in self._known:
            ok = path not in self.template
            if path == self.root or path.startswith(self.root + "/"):
                up = path
                while ok and len(up) > len(self.root):  # template slots drop their own text alone, records all below
                    ok, up = up + "/" not in self.template, up.rpartition("/")[0]
            else:
                up, _, label = path.rpartition("/")
                ok = ok and up in self.above and re.match(r"h1(?![a-z0-9])", label) is not None
            self._known[path] = ok
        return self._known[path]

    def holds(self, node: Node) -> bool:
        if node.soft and node.soft.startswith(self.root + "/"):
            return False
        return self._content(node.path)


# --- alignment --------------------------------------------------------------------------------------------------


def _runs(kids: tuple) -> list[tuple]:
    """Siblings as runs of one label: (label, members); leaves of text have the label #."""
    out: list[tuple] = []
    for k in kids:
        label = k[0] if isinstance(k[0], str) else "#"
        if out and out[-1][0] == label:
            out[-1][1].append(k)
        else:
            out.append((label, [k]))
    return out


def _weigh(a: tuple, b: tuple, memo: dict) -> int:
    """Size of the largest order-preserving match of two subtrees with equal root labels."""
    key = (id(a), id(b))
    if key not in memo:
        x, y = _runs(a[1]), _runs(b[1])
        row = [0] * (len(y) + 1)
        for ra in x:
            new = [0]
            for j, rb in enumerate(y):
                w = _weigh_run(ra, rb, memo) if ra[0] == rb[0] else 0
                new.append(max(new[j], row[j + 1], row[j] + w if w else 0))
            row = new
        memo[key] = row[-1] + 1
    return memo[key]


def _weigh_run(a: tuple, b: tuple, memo: dict) -> int:
    if a[0] == "#":
        return min(len(a[1]), len(b[1]))
    return sum(_weigh(p, q, memo) for p, q in zip(a[1], b[1]))


def aligned(a: tuple, b: tuple) -> list[tuple[str, bool, int]]:
    """(slot, equal text, characters) of the aligned leaves of two skeletons, by simple tree matching."""
    memo: dict = {}
    found: list[tuple[str, bool, int]] = []
    todo = [(a, b, "")]
    while todo:
        a, b, path = todo.pop()
        x, y = _runs(a[1]), _runs(b[1])
        table = [[0] * (len(y) + 1)]
        for ra in x:
            row = [0]
            for j, rb in enumerate(y):
                w = _weigh_run(ra, rb, memo) if ra[0] == rb[0] else 0
                row.append(max(row[j], table[-1][j + 1], table[-1][j] + w if w else 0))
            table.append(row)
        i, j = len(x), len(y)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                for p, q in zip(x[i][1], y[j][1]):
                    if x[i][0] == "#":
                        found.append((path, p[0] == q[0], max(p[1], q[1])))
                    else:
                        todo.append((p, q, f"{path}/{p[0]}"))
    return found


def copies(pairs: list[tuple[str, bool, int]]) -> bool:
    """Whether two pages hold the same prose (or the same text, where neither has any)."""
    counted = [(same, n) for _, same, n in pairs if n >= PROSE] or [(same, n) for _, same, n in pairs]
    return sum(n for same, n in counted if same) >= COPY_SHARE * max(1, sum(n for _, n in counted))


def _slots(tree: tuple) -> dict[str, list[int]]:
    """Per slot: characters and link characters of its leaves, and how many elements it stands for."""
    out: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    todo = [(tree, "")]
    while todo:
        node, path = todo.pop()
        mine = out[path]
        mine[2] += 1
        for k in node[1]:
            if isinstance(k[0], str):
                todo.append((k, f"{path}/{k[0]}"))
            else:
                mine[0], mine[1] = mine[0] + k[1], mine[1] + k[2]
    return out


# --- Spark ------------------------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """Host of an http(s) url in lower case, null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), 256):
            part = batch.slice(at, 256)
            trees = [marshal.dumps(Page(h).skeleton()) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(trees, pa.binary())], ["host", "k", "tree"])


SUMS = ("constant", "votes", "chars", "links", "elements", "pages")


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, host and slot: constant votes, votes, characters, link characters, elements and pages. The chain goes on
    over batches."""
    last = None
    for batch in batches:
        sums: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0] * len(SUMS))
        for host, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            tree = marshal.loads(raw)
            for slot, (n, links, elements) in _slots(tree).items():
                s = sums[host, slot]
                s[2], s[3], s[4], s[5] = s[2] + n, s[3] + links, s[4] + elements, s[5] + 1
            if last is not None and last[0] == host and last[1] != raw:
                pairs = aligned(last[2], tree)
                if not copies(pairs):
                    # a slot of several leaves is constant where all of them are
                    equal: dict[str, bool] = {"": True}
                    for slot, same, _ in pairs:
                        equal[slot] = equal.get(slot, True) and same
                    for slot, same in equal.items():
                        s = sums[host, slot]
                        s[0], s[1] = s[0] + same, s[1] + 1
            last = (host, raw, tree)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *(pa.array([sums[k][c] for k in keys], pa.int64()) for c in range(len(SUMS)))], ["host", "slot", *SUMS])


def _above(slot: str) -> Column:
    """A slot and those above it, from the top."""
    steps = f"split({slot}, '/')"
    return F.expr(f"transform(sequence(1, size({steps})), k -> array_join(slice({steps}, 1, k), '/'))")


def _label(slot: Column) -> Column:
    return F.regexp_extract(slot, r"/([a-z0-9-]*)[^/]*$", 1)


def induce(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, root, template): the content root of each host of which two pages were aligned, and the template slots that are
    the root or below (a record's slot ends in a slash) or first headings beside it."""
    page = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(F.col(id_col)).alias("k"), F.col(html_col).alias("html")).filter("host IS NOT NULL")
    # kept, since range bounds are drawn from them before they are dealt
    trees = cut(page.mapInArrow(_skeletons, "host string, k long, tree binary"))
    chains = trees.repartitionByRange("host", "k").sortWithinPartitions("host", "k", "tree")
    votes = chains.mapInArrow(_votes, "host string, slot string, " + ", ".join(f"{c} long" for c in SUMS))
    slots = cut(votes.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in SUMS]))
    whole = slots.filter("slot = ''").select(F.col("host").alias("_w"), F.col("pages").alias("_all"), F.col("votes").alias("_pairs"))
    constant = (F.col("votes") >= LEAST_VOTES) & (F.col("constant") >= CONSTANT_SHARE * F.col("votes"))
    linked = F.col("links") > LINK_SHARE * F.col("chars")
    common = F.col("pages") >= LEAST_PAGES * F.col("_all")
    known = slots.join(whole, F.col("host") == F.col("_w")).filter("_pairs > 0").withColumn("fixed", (constant | linked) & common)
    # varying text, summed over all that is below
    mass = known.filter(~F.col("fixed") & (F.col("chars") > F.col("links"))).select("host", F.explode(_above("slot")).alias("up"), (F.col("chars") - F.col("links")).alias("m"))
    mass = mass.groupBy("host", "up").agg(F.sum("m").alias("m"))
    total = mass.filter("up = ''").select(F.col("host").alias("_t"), F.col("m").alias("total"))
    element = known.select(F.col("host").alias("_e"), F.col("slot").alias("_s"), F.col("elements").alias("_n"), F.col("pages").alias("_p"))
    held = mass.join(total, F.col("host") == F.col("_t")).join(element, (F.col("host") == F.col("_e")) & (F.col("up") == F.col("_s"))).select("host", "up", "m", "total", "_n", "_p")
    single = (F.col("m") >= ROOT_SHARE * F.col("total")) & (2 * F.col("_n") <= 3 * F.col("_p")) & ((F.col("up") == "") | _label(F.col("up")).isin(*CONTAINERS))
    roots = held.filter(single).groupBy("host").agg(F.max(F.struct(F.size(F.split("up", "/")).alias("depth"), "up", "m")).alias("r")).select(F.col("host").alias("_r"), F.col("r.up").alias("root"), F.col("r.m").alias("root_m"))
    below = lambda c: F.startswith(F.col(c), F.concat("root", F.lit("/")))
    fixed = known.filter("fixed").join(roots, F.col("host") == F.col("_r"))
    # records: several to a page, each with a template slot, little of the root's text
    inside = fixed.filter(below("slot")).select("host", "root", "root_m", F.explode(_above("slot")).alias("up"), F.col("elements").alias("k"))
    inside = inside.filter(below("up")).groupBy("host", "up", "root_m").agg(F.max("k").alias("k"))
    small = mass.select(F.col("host").alias("_h"), F.col("up").alias("_u"), "m")
    inside = inside.join(element, (F.col("host") == F.col("_e")) & (F.col("up") == F.col("_s"))).join(small, (F.col("host") == F.col("_h")) & (F.col("up") == F.col("_u")), "left")
    record = (F.col("_n") >= 2 * F.col("_p")) & (F.col("k") >= 0.8 * F.col("_n")) & (F.coalesce("m", F.lit(0)) < RECORD_SHARE * F.col("root_m")) & _label(F.col("up")).isin(*CONTAINERS)
    records = inside.filter(record).select("host", F.concat("up", F.lit("/")).alias("slot"))
    own = fixed.filter((F.col("slot") == F.col("root")) | below("slot") | (_label(F.col("slot")) == "h1")).select("host", "slot").unionByName(records)
    template = own.groupBy(F.col("host").alias("_o")).agg(F.collect_set("slot").alias("template"))
    return roots.join(template, F.col("_r") == F.col("_o"), "left").select(F.col("_r").alias("host"), "root", F.coalesce("template", F.array().cast("array<string>")).alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", wrappers: DataFrame | None = None) -> DataFrame:
    """id, url, text and n_chars of every page. wrappers: as induce() gives them, by default those of these pages."""
    kind = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part, texts = batch.slice(at, 256), []
                for h, host, root, template in zip(*(part.column(c).to_pylist() for c in (2, 3, 4, 5))):
                    if root is not None and host not in known:
                        if len(known) > 500:
                            known.clear()
                        known[host] = Wrapper(root, template)
                    texts.append(Page(h).main_text(known[host] if root is not None else None))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    found = induce(pages, id_col, url_col, html_col) if wrappers is None else wrappers
    found = cut(found.select(F.col("host").alias("_host"), "root", "template"))
    page = pages.select(F.col(id_col), F.col(url_col), F.col(html_col), host_of(F.col(url_col)).alias("_h"))
    size = F.length("root") + F.length(F.array_join("template", " "))
    if found.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_CHARS:
        joined = page.join(F.broadcast(found), F.col("_h") == F.col("_host"), "left")
    else:  # a host's pages are dealt over SALTS tasks, each with a copy of its slots
        dealt = page.withColumn("_s", F.pmod(F.xxhash64(id_col, html_col), F.lit(SALTS)))
        each = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(each, (F.col("_h") == F.col("_host")) & (F.col("_s") == F.col("_salt")), "left")
    joined = joined.select(id_col, url_col, html_col, "_h", "root", "template")
    return joined.mapInArrow(run, f"{id_col} {kind[id_col]}, {url_col} {kind[url_col]}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
