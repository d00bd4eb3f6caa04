"""HTML extraction by a site style tree.

All different pages of a host are merged into one tree: elements with the same path of tags, classes
and ids are one node of it. Over the m pages that have a node the tree keeps two entropies to the base m:

- presentation: of the layouts of its child elements (one layout on all pages: 0, a different one on each: 1);
- content: 1 minus the mean, over the node's features, of log(pages with the feature) / log(m). Features are the phrases of
  its direct text, link targets and images: a phrase of one page counts 1, one of every page 0.

Both are smoothed by `prior_pages` pages of the prior, so a host with few pages leaves a node as it was and verdicts change
smoothly with the number of pages, at every size and depth alike. Of a page's own branch the composite importance is
(1 - 0.9^l) * presentation + 0.9^l * the mean of the parts' importances weighted by their text, with l layouts; of a leaf it is
its content. A branch goes from the page if its importance and that of every part of it with text is below the threshold.

Marks are a prior of the tree. Menus, headers and footers of the page, sidebars, notices, adverts, forms and reader comments
that the page itself declares, by tag, by role, or by a class or id whose words all name such a part (`ad-box`, `comment-list`;
not `share-price`, `related-work` or `notice-period`), are nodes as all others and counted as they are, but start from a prior of
0 that counts for `declared_pages` pages. A declared branch is judged by itself: nothing of it goes into the importance of what
it stands in. An exact check follows: a declared branch that the tree leaves, as its text differs from page to page (reader
comments, adverts in turn), goes by its mark. Scripts, styles and the page's head have no text that a reader sees and are no nodes.

Paragraphs and headings inside an article or main element always stay, with all that they stand in, and inline elements go only
with their block unless declared. Where a page has such an element, loose boxes and text outside it start from a prior below the
threshold: they stay only where the tree finds them different from page to page; paragraphs and headings outside it start above.

Defined results: a null or empty html, and a page without text, give an empty text; a null or odd url is of the host ''; a null
id is carried through; equal pages count once in the tree and give equal texts, so repeated rows do; an importance equal to the
threshold stays; no text is dropped but with a branch that the tree or the check removes, whatever the length of the page or the
depth of its elements (a page is one row of one task); unclosed and wrongly nested tags are repaired as browsers do for
paragraphs, list items and table parts; other columns of the input, whatever their names, are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

import html as html_lib
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace


@dataclass(frozen=True)
class StyleTree:
    """prior_pages, declared_pages: how many pages the prior of a node, and of a declared one, counts for; marks: heed what the page declares; check: what it declares goes even where the tree leaves it; threshold 0 switches the tree off."""

    threshold: float = 0.6
    prior_pages: int = 8
    declared_pages: int = 64
    marks: bool = True
    check: bool = True


#: Weight of a node's parts against its presentation, to the power of the number of its layouts.
DAMP = 0.9
#: Kinds of a node of a branch: part of its block, block, loose paragraph or heading, other loose text, declared to be no main text; and the prior of each.
PART, BOX, LOOSE_PROSE, LOOSE, DECLARED = range(5)
PRIOR = (1.0, 1.0, 0.75, 0.4, 0.0)
#: What the tree holds of a node of one page only: pages, presentation, content, layouts.
ALONE = (1, None, None, 1)
#: Up to so many nodes of several pages the tree goes to the tasks; a larger one meets the pages in joins.
NODES_AT_ONCE = 50_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noframes".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: What an opening tag ends, up to the nearest of the stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
ENDS_P = BLOCK - {"br", "body", "html", "caption", "option", "legend", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "title", "select"}
#: Parts of a page that are no main text by its own word: tags, roles, and the words that name them in a class or id.
NOISE_TAGS = frozenset("nav aside form script style noscript template iframe svg math head title button select textarea input dialog menu object canvas audio video".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav footer cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond replies share sharing social related recommended widget toolbar pagination pager skip skiplink".split())
#: Words that may stand beside those without changing what they name.
NEUTRAL_WORDS = frozenset("area bar block body bottom box buttons col column container content footer global group header holder icons inner item items left link links list main menu outer page panel posts primary right row secondary section site slot text top unit wrap wrapper".split())
#: Branches that the tree may remove inside an article, and elements that it may not remove anywhere.
BOXES = frozenset("details div dl figure ol section table ul".split())
FRAME = frozenset("html body article main".split())
#: Elements of an article that keep every branch around them.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_tag = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)""", re.S)
_attr = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_word = re.compile(r"[A-Za-z][a-z]*")
_number = re.compile(r"[0-9]+")
_space = re.compile(r"\s+")
_phrase_end = re.compile(r"[.!?…;:|·•]+(?:\s+|$)|\s[–—-]\s")
_signed = lambda x: x - (1 << 64) if x >> 63 else x


@dataclass(slots=True)
class Node:
    tag: str
    #: name in the tree: tag, class and id
    name: str
    #: hash of the names from the root on
    key: int
    parent: Node | None
    noise: bool
    inside: bool
    #: link target or image
    ref: str
    #: pieces of text (str) and children (Node), in page order
    parts: list


def names_noise(own: str) -> bool:
    """Does a class or id (one of the words of `own`) name a part that is no main text, by all of its words?"""
    for token in own.split():
        words = [w.lower() for w in _word.findall(token)]
        if any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in NEUTRAL_WORDS for w in words):
            return True
    return False


def _marks(tag: str, attrs: str) -> tuple[str, bool]:
    """The node's name in the tree (tag, class, id) and whether its marks say that it is no main text."""
    if not attrs.strip():
        return tag, tag in NOISE_TAGS
    got = {k.lower(): a or b or c for k, a, b, c in _attr.findall(attrs)}
    own = f"{got.get('class', '')} {got.get('id', '')}".strip()
    name = f"{tag}.{_number.sub('0', own.lower())}" if own else tag
    # a slash parts the names of a path
    name = name.replace("/", "\\")
    noise = tag in NOISE_TAGS or got.get("role", "").lower() in NOISE_ROLES or got.get("aria-hidden", "").lower() == "true" or "hidden" in attrs.split()
    noise = noise or bool(re.search(r"display\s*:\s*none", got.get("style", "")))
    if own and tag not in FRAME:
        noise = noise or names_noise(own)
    return name, noise


def parse(source: str, host: str = "") -> Node:
    """The page as a tree of nodes; equal paths of different hosts have different keys."""
    top = Node("", "", xxhash.xxh3_64_intdigest(host), None, False, False, "", [])
    at, pos, end = top, 0, len(source)
    open_tags: dict[str, int] = {}

    def close(tags, stops=frozenset()) -> None:
        nonlocal at
        n = at
        if not any(open_tags.get(t) for t in tags):
            return
        while n is not top and n.tag not in stops:
            if n.tag in tags:
                while at is not n.parent:
                    open_tags[at.tag] -= 1
                    at = at.parent
                return
            n = n.parent

    while pos < end:
        m = _tag.search(source, pos)
        text = source[pos : m.start()] if m else source[pos:]
        if text:
            at.parts.append(html_lib.unescape(text) if "&" in text else text)
        if not m:
            break
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "p" and at.tag != "p":
                close({"p"}, BLOCK - {"p"})
            elif tag == "br":
                at.parts.append(Node("br", "br", 0, at, False, at.inside, "", []))
            else:
                close({tag}, frozenset() if tag in ("article", "main", "body", "html", "div", "section", "nav", "footer", "header", "aside", "form", "ul", "ol", "table") else frozenset(("article", "main", "body", "table")))
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ENDS_P:
            close({"p"}, BLOCK - {"p"})
        attrs = m[3] or m[6] or ""
        name, noise = _marks(tag, attrs)
        if tag in ("header", "footer"):
            noise = noise or not at.inside or tag == "footer"
        if tag == "article" and at.inside:
            noise = noise or names_noise(name.partition(".")[2])
        ref = ""
        if tag in ("a", "img"):
            ref = next((re.split("[?#]", a or b or c)[0] for k, a, b, c in _attr.findall(attrs) if k.lower() in ("href", "src")), "")
        node = Node(tag, name, xxhash.xxh3_64_intdigest(name, at.key), at, noise, at.inside or tag in ("article", "main"), ref, [])
        at.parts.append(node)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, pos)
            if tag in ("title", "textarea"):
                node.parts.append(html_lib.unescape(source[pos : stop.start() if stop else end]))
            pos = stop.end() if stop else end
            continue
        open_tags[tag] = open_tags.get(tag, 0) + 1
        at = node
    return top


def _walk(node: Node, marks: bool = True):
    """All nodes outside noise, in any order. Without marks only what no reader sees is noise."""
    stack = [node]
    while stack:
        n = stack.pop()
        if _unseen(n) or marks and n.noise:
            continue
        yield n
        stack.extend(p for p in n.parts if not isinstance(p, str))


def _unseen(n: Node) -> bool:
    """Has the node no text of the page's body?"""
    return n.noise and (n.tag in RAW or n.tag in ("head", "title"))


def _prose(top: Node, marks: bool) -> set[int]:
    """Of one page: ids of the nodes that are or hold an article's paragraph or heading with text."""
    held: set[int] = set()
    for n in _walk(top, marks):
        if n.inside and n.tag in PROSE and any(isinstance(p, str) and p.strip() for k in _walk(n, marks) for p in k.parts):
            while n is not None and id(n) not in held:
                held.add(id(n))
                n = n.parent
    return held


@dataclass
class Page:
    """A page's text in pieces, and the nodes of those of its branches that the tree may remove.

    Of node i: key, up (its parent among the nodes, -1: none; a parent comes before its parts), kind, mass (characters of its
    direct text). Of piece i: at (the node that it stands in, -1: always kept), block (a new block begins), text. facts:
    (key, what, value): the hash of the layouts of a node's children (what = 0), or of a feature of its content (1).
    """

    key: list[int] = field(default_factory=list)
    up: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    mass: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    block: list[bool] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    facts: list[tuple[int, int, int]] = field(default_factory=list)


def phrases(text: str) -> set[str]:
    """The phrases of a node's direct text: between sentence ends and separators, without case."""
    return {own for x in _phrase_end.split(text.casefold()) if (own := _space.sub(" ", x).strip())}


def describe(top: Node, marks: bool = True) -> Page:
    out = Page()
    articles = [n for n in _walk(top, marks) if n.tag in ("article", "main")]
    fixed: set[int] = set()
    for n in articles:  # what an article stands in stays
        while n is not None and id(n) not in fixed:
            fixed.add(id(n))
            n = n.parent
    if articles:
        fixed |= _prose(top, marks)
    texts: list[list[str]] = []
    layouts: list[str] = []
    refs: list[list[str]] = []
    pieces: list[list[str]] = []
    inner: list[bool] = []
    # parts of a declared inline element: blocks in it are no ends of the block around it, only gaps of its own text
    within: list[bool] = []
    fresh, gap = True, False

    def ends_block(rec: int) -> None:
        nonlocal fresh, gap
        if rec >= 0 and within[rec]:
            gap = True
        else:
            fresh = True

    def record(key: int, up: int, kind: int, layout: str, inline: bool = False) -> int:
        within.append(up >= 0 and inner[up] and within[up] or kind == DECLARED and inline and not (up >= 0 and inner[up]))
        inner.append(_declared(inner, up, kind))
        for column, value in ((out.key, _signed(key)), (out.up, up), (out.kind, kind), (texts, []), (layouts, layout), (refs, [])):
            column.append(value)
        return len(out.key) - 1

    def kind_of(n: Node) -> int | None:
        """The kind of a node that may be removed by itself."""
        if n.tag in VOID or n.tag not in (BOXES if n.inside else BLOCK - FRAME) or id(n) in fixed:
            return None
        return BOX if n.inside or not articles else LOOSE_PROSE if n.tag in PROSE else LOOSE

    # (node, the record around it), (text, record) or, at a block's end, (None, record)
    stack: list = [(top, -1)]
    while stack:
        n, rec = stack.pop()
        if n is None:
            ends_block(rec)
            continue
        if isinstance(n, str):
            own = _space.sub(" ", n)
            if rec >= 0:
                texts[rec].append(own)
            if fresh and own == " ":
                continue
            if rec >= 0 and within[rec] and gap:
                own, gap = f" {own}", False
            if not fresh and out.at[-1] == rec:
                pieces[-1].append(own)
            else:
                out.at.append(rec)
                out.block.append(fresh)
                pieces.append([own])
            fresh = False
            continue
        if _unseen(n):
            if n.tag in BLOCK:
                ends_block(rec)
            continue
        if n.tag in VOID:
            if n.tag in BLOCK:
                ends_block(rec)
            if rec >= 0 and n.ref:
                refs[rec].append(f"img {n.ref}")
            continue
        kind = DECLARED if marks and n.noise else None if rec >= 0 and inner[rec] else kind_of(n)
        if kind is not None or rec >= 0:
            kids = " ".join(p.name for p in n.parts if not isinstance(p, str) and p.tag not in VOID)
            rec = record(n.key, rec, PART if kind is None else kind, kids, n.tag not in BLOCK)
            if n.ref:
                refs[rec].append(f"a {n.ref}")
        if n.tag in BLOCK:
            ends_block(rec)
            stack.append((None, rec))
        loose = -1
        for p in reversed(n.parts):
            if isinstance(p, str):
                # text beside an article, in no box
                if rec < 0 and articles and not n.inside and p.strip():
                    if loose < 0:
                        loose = record(xxhash.xxh3_64_intdigest("#text", n.key), -1, LOOSE, "")
                    stack.append((p, loose))
                else:
                    stack.append((p, rec))
            else:
                stack.append((p, rec))
    out.text = ["".join(p) for p in pieces]
    joined = [" ".join(t) for t in texts]
    out.mass = [len(_space.sub(" ", t).strip()) for t in joined]
    shown: dict[int, list[str]] = {}
    features: set[tuple[int, str]] = set()
    for key, layout, text, own in zip(out.key, layouts, joined, refs):
        shown.setdefault(key, []).append(layout)
        features.update((key, x) for x in (*phrases(text), *own))
    out.facts = [(k, 0, _signed(xxhash.xxh3_64_intdigest("|".join(v)))) for k, v in shown.items()]
    out.facts += [(k, 1, _signed(xxhash.xxh3_64_intdigest(v))) for k, v in features]
    return out


def _declared(inner: list[bool], up: int, kind: int) -> bool:
    """Is a node declared to be no main text, or part of such a one? inner: the same of the nodes before it."""
    return kind == DECLARED or kind == PART and up >= 0 and inner[up]


def _with_parts(up: list[int], out: list[bool]) -> list[bool]:
    for i in range(len(up)):
        out[i] = out[i] or up[i] >= 0 and out[up[i]]
    return out


def removed(up: list[int], kind: list[int], mass: list[int], facts: list[tuple], p: StyleTree) -> list[bool]:
    """For each node of a page whether it goes. facts of a node: (m, presentation, content, layouts) of the host's tree."""

    def smooth(x: float | None, m: int, prior: float, pages: int) -> float:
        return prior if x is None else (pages * prior + (m - 1) * x) / (pages + m - 1)

    n = len(up)
    prior = [0.0] * n
    inner: list[bool] = []
    for i in range(n):
        inner.append(_declared(inner, up[i], kind[i]))
        prior[i] = prior[up[i]] if kind[i] == PART and up[i] >= 0 else PRIOR[kind[i]]
    weight, total, parts, noisy = [0] * n, [0.0] * n, [False] * n, [True] * n
    out = [False] * n
    for i in range(n - 1, -1, -1):  # parts before what they stand in
        m, look, content, layouts = facts[i]
        pages = p.declared_pages if inner[i] else p.prior_pages
        total[i] += mass[i] * smooth(content, m, prior[i], pages)
        weight[i] += mass[i]
        value = total[i] / weight[i] if weight[i] else 1.0
        if parts[i] and weight[i]:
            damp = DAMP**layouts
            value = (1 - damp) * smooth(look, m, 0.0 if inner[i] else 1.0, pages) + damp * value
        if weight[i]:
            noisy[i] = noisy[i] and value < p.threshold
            out[i] = noisy[i] and kind[i] != PART
        out[i] = out[i] or p.check and kind[i] == DECLARED
        if up[i] >= 0 and inner[i] == inner[up[i]]:
            parts[up[i]] = True
            total[up[i]] += value * weight[i]
            weight[up[i]] += weight[i]
            noisy[up[i]] = noisy[up[i]] and noisy[i]
    return _with_parts(up, out)


def joined(at: list[int], block: list[bool], text: list[str], gone: list[bool]) -> str:
    """The pieces that stay, white space turned into one space, blocks joined by one."""
    blocks: list[list[str]] = []
    fresh = True
    for a, b, t in zip(at, block, text):
        fresh = fresh or b
        if a >= 0 and gone[a]:
            continue
        if fresh:
            blocks.append([])
        blocks[-1].append(t)
        fresh = False
    return " ".join(own for b in blocks if (own := _space.sub(" ", "".join(b)).strip()))


def main_text(top: Node, gone=frozenset()) -> str:
    """The page's text without what its marks say, and without the nodes (by their number) that are gone."""
    page = describe(top)
    return joined(page.at, page.block, page.text, _with_parts(page.up, [i in gone or k == DECLARED for i, k in enumerate(page.kind)]))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


PARSED = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("key", pa.list_(pa.int64())), ("up", pa.list_(pa.int32())), ("kind", pa.list_(pa.int8())), ("mass", pa.list_(pa.int32())),
    ("at", pa.list_(pa.int32())), ("block", pa.list_(pa.bool_())), ("text", pa.list_(pa.string())), ("node", pa.list_(pa.int64())), ("what", pa.list_(pa.int8())), ("value", pa.list_(pa.int64())),
])
PARSED_DDL = "page_id long, url string, h1 long, h2 long, key array<long>, up array<int>, kind array<byte>, mass array<int>, at array<int>, block array<boolean>, text array<string>, node array<long>, what array<byte>, value array<long>"


def parsed(pages: DataFrame, marks: bool = True) -> DataFrame:
    """Every page once through the parser: its pieces, its nodes and its facts; h1, h2 are a hash of host and html."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                b = whole.slice(start, 200)
                rows = []
                for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                    d = xxhash.xxh3_128_intdigest(f"{host}\0{source or ''}")
                    x = describe(parse(source or "", host), marks)
                    rows.append((_signed(d >> 64), _signed(d & (1 << 64) - 1), x.key, x.up, x.kind, x.mass, x.at, x.block, x.text, *([f[i] for f in x.facts] for i in range(3))))
                columns = [b.column("page_id"), b.column("url"), *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(PARSED)[2:]))]
                yield pa.RecordBatch.from_arrays(columns, schema=PARSED)

    return pages.select("page_id", "url", "host", "html").mapInArrow(run, PARSED_DDL)


def style_tree(facts: DataFrame) -> DataFrame:
    """node, m, look, content, layouts from (node, what, value, n): n different pages of the host have this layout or feature."""
    layout, n = F.col("what") == 0, F.col("n").cast("double")
    sums = facts.groupBy("node").agg(
        F.sum(F.when(layout, F.col("n"))).alias("m"), F.sum(F.when(layout, n * F.log(n))).alias("mlogm"), F.count_if(layout).cast("int").alias("layouts"),
        F.sum(F.when(~layout, n)).alias("occ"), F.sum(F.when(~layout, n * F.log(n))).alias("tlogn"),
    )
    m = F.col("m")
    several = lambda x: F.when(m > 1, x)
    return sums.select("node", "m", several(1 - F.col("mlogm") / (m * F.log(m))).alias("look"), several(F.when(F.col("occ") > 0, 1 - F.col("tlogn") / (F.col("occ") * F.log(m)))).alias("content"), "layouts")


def _tree(ws: Workspace, table: DataFrame) -> tuple[DataFrame, int]:
    """The tree over all different pages with nodes, without nodes of one page (ALONE); and the number of its nodes."""
    pages = table.filter(F.size("key") > 0).select("h1", "h2", "node", "what", "value").dropDuplicates(["h1", "h2"])
    facts = pages.select(F.explode(F.arrays_zip("node", "what", "value")).alias("f")).groupBy("f.node", "f.what", "f.value").agg(F.count(F.lit(1)).alias("n"))
    tree, seen = ws.write(style_tree(facts).filter("m > 1"), "tree", nodes=F.count(F.lit(1)))
    return tree, seen["nodes"] or 0


def _page_facts(ws: Workspace, table: DataFrame, tree: DataFrame) -> DataFrame:
    """h1, h2, facts (the tree's, of the page's nodes by their numbers, without nodes of one page) of all different pages with nodes."""
    asked = table.filter(F.size("key") > 0).select("h1", "h2", "key").dropDuplicates(["h1", "h2"]).select("h1", "h2", F.posexplode("key").alias("i", "node"))
    # most nodes of a large host are met by each of its pages
    known = asked.join(tree, "node")
    return ws.write(known.groupBy("h1", "h2").agg(F.collect_list(F.struct("i", "m", "look", "content", "layouts")).alias("facts")), "page-facts")


def extract(pages: DataFrame, p: StyleTree = StyleTree(), *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", nodes_at_once: int = NODES_AT_ONCE) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Each page is parsed once into a written table; the tree is counted from the facts of its different pages and written. A tree
    of at most `nodes_at_once` nodes goes to the tasks that read the written pages, so no text is shuffled. The values of a
    larger one go back to the nodes, and then to the pages, by joins of written tables, so adaptive execution deals a node of
    very many pages, or a page with very many copies, to several tasks.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    ws = Workspace(pages.sparkSession, "html")
    table, seen = ws.write(parsed(own.withColumn("host", host_of(F.col("url"))), p.marks), "pages", judged=F.count_if(F.size("key") > 0))
    tree, nodes = _tree(ws, table) if seen["judged"] else (None, 0)
    of_node: dict[int, tuple] = {}
    parts = ["page_id", "url", "key", "up", "kind", "mass", "at", "block", "text"]
    ready = table.select(*parts)
    if nodes > nodes_at_once:
        ready = table.select("h1", "h2", *parts).join(_page_facts(ws, table, tree), ["h1", "h2"], "left").select(*parts, "facts")
    elif nodes:
        of_node = {r[0]: tuple(r)[1:] for r in tree.select("node", "m", "look", "content", "layouts").collect()}
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                b = whole.slice(start, 200)
                joins = b.column("facts").to_pylist() if "facts" in b.schema.names else [None] * b.num_rows
                texts = []
                for key, up, kind, mass, at, block, text, met in zip(*(b.column(c).to_pylist() for c in parts[2:]), joins):
                    facts = [of_node.get(k, ALONE) for k in key]
                    for f in met or ():
                        facts[f["i"]] = (f["m"], f["look"], f["content"], f["layouts"])
                    texts.append(joined(at, block, text, removed(up, kind, mass, facts, p)))
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], schema=schema)

    out = ready.mapInArrow(run, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
