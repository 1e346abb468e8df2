"""Main text of web pages by wrapper induction.

1. Each page is parsed once to a tree of elements and written as flat arrays in order of the text, without furniture
   (``FURNITURE``, classes and ids named by ``FURNITURE_WORDS`` alone; the header of an article stays), and with
   nothing but the article where the page marks one.  A run of like paragraphs, items or cells is one node.
2. One page stands for each host and one for each layout of a host (the containers below the body): the model.
3. All pages are aligned to both models by simple tree matching: the ordered matching of the trees with the
   greatest weight, where a pair of nodes with one signature weighs 1, and 1 more if their texts are equal.
4. A node of a model is counted over all pages that have a node aligned to it.  It is template if its text never
   varies there, the pages differ, and they are all pages of the model's host or layout;
   a layout, and prose of an article (headings, paragraphs, items, cells), need ``FEW`` pages.
5. Nodes aligned to template go.  Varying slots, and nodes without a partner in the model, are content.

The pages of a host meet nowhere: a model is a least value, counts are sums, and models join the pages by broadcast
when their measured size is small, otherwise by a salted shuffle.  Children are matched by dynamic programming;
where their numbers multiply to more than ``CELLS``, or a page has met ``PAIRS`` pairs, in order of their signatures.

Defined cases: null or empty html gives an empty text; null urls share no wrapper; a host whose pages are
all the same has no template; equal ids stay apart; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li pre blockquote td th dd dt figcaption".split())
FURNITURE = frozenset(
    "aside button canvas datalist dialog footer form head header iframe input math menu nav noscript object option script select style svg template textarea title".split()
)
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu "
    "modal nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
BESIDE = frozenset("area bar block bottom box container global inner item items left link links list main outer panel primary reader right secondary section site slot top unit user users wrap wrapper".split())
FURNITURE_NAMES = frozenset("related-posts related-articles related-stories".split())
OF_ARTICLES = frozenset("header masthead".split())  # furniture of pages, but of an article its title
FURNITURE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
P_ENDS = BLOCK - {"html", "body", "td", "th", "li", "dd", "dt"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
FEW = 4  # pages that tell the template of a layout, or of article prose
HELD = 200_000  # nodes of models that a task counts before it hands the counts on
CELLS = 10_000
PAIRS = 200_000
SMALL = 32 << 20
SALTS = 32


class Node:
    __slots__ = ("tag", "sig", "out", "kids", "texts", "order")

    def __init__(self, tag: str, sig: str, out: bool):
        self.tag, self.sig, self.out = tag, sig, out
        self.kids: list[Node] = []
        self.texts: list[str] = []
        self.order: list[int] = []


@lru_cache(1 << 14)
def _furniture(name: str, inside: bool) -> bool:
    """Whether a class or id names furniture: by a word of it, with nothing but words of places beside it.

    ``site-footer`` does, ``post-header`` and ``share-price`` do not; inside an article ``header`` does not.
    """
    name = re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()
    words = {w for w in re.split(r"[^a-z]+", name) if w}
    hit = words & (FURNITURE_WORDS - OF_ARTICLES if inside else FURNITURE_WORDS)
    return name in FURNITURE_NAMES or bool(hit) and words <= hit | BESIDE


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", "", False)
        self.stack = [self.root]
        self.homes = [self.root]  # of each open element: where its text goes
        self.outs = [False]  # whether it lies in furniture
        self.open: Counter[str] = Counter()
        self.block: list[str] = []
        self.at = 0
        self.articles = 0

    def _end_block(self) -> None:
        if self.block:
            text = " ".join("".join(self.block).split())
            self.block.clear()
            if text:
                home = self.homes[-1]
                home.texts.append(text)
                home.order.append(self.at)
                self.at += 1

    def _push(self, node: Node) -> None:
        self.stack.append(node)
        self.homes.append(node if node.tag in BLOCK or node.out else self.homes[-1])
        self.outs.append(node.out or self.outs[-1])
        self.open[node.tag] += 1

    def _cut(self, k: int) -> None:
        self.open.subtract(n.tag for n in self.stack[k:])
        del self.stack[k:], self.homes[k:], self.outs[k:]

    def _close(self, names: set[str], limits: set[str]) -> None:
        if not any(self.open[n] for n in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in names:
                self._end_block()
                self._cut(k)
                return
            if self.stack[k].tag in limits:
                return

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "hr":
                self._end_block()
            elif tag == "br":
                self.block.append(" ")
            return
        if tag in P_ENDS:
            self._close({"p"}, {"td", "th", "button", "table"})
        if tag in ENDS:
            names, limits = ENDS[tag]
            for _ in range(2):
                self._close(names, limits)
        got = dict(attrs)
        inside = bool(self.open["article"] or self.open["main"])
        names = f"{got.get('class') or ''} {got.get('id') or ''}".split()
        out = (tag in FURNITURE and not (inside and tag in OF_ARTICLES)) or (got.get("role") or "").lower() in FURNITURE_ROLES or "hidden" in got or (got.get("aria-hidden") or "").lower() == "true"
        out = out or (tag not in ("html", "body", "article", "main") and any(_furniture(n, inside) for n in names))
        if tag in BLOCK or out:
            self._end_block()
        node = Node(tag, f"{tag}.{(got.get('class') or '').strip().lower()}", out)
        parent = self.stack[-1]
        parent.kids.append(node)
        if tag in ("article", "main") and not out and not self.outs[-1]:
            self.articles += 1
        self._push(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            node = self.stack[k]
            if node.tag == tag:
                if tag in BLOCK or node.out:
                    self._end_block()
                self._cut(k)
                return
            if node.tag in ("article", "main", "body") and tag not in ("html", "body"):
                return

    def handle_data(self, data):
        self.block.append(data)


def tree(html: str) -> tuple[Node, bool]:
    """The element tree, with inline elements folded into their blocks, and whether it marks an article."""
    p = _Tree()
    p.feed(html)
    p.close()
    p._end_block()
    _fold(p.root)
    return p.root, p.articles > 0


def _fold(root: Node) -> None:
    """Drops elements without any text; inline elements hand their block children to the parent."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.kids
    for node in reversed(order):  # children first
        kids: list[Node] = []
        for k in node.kids:
            if k.texts or k.kids:
                if k.tag in BLOCK or k.out:
                    kids.append(k)
                else:
                    kids += k.kids
                    node.texts += k.texts
                    node.order += k.order
        node.kids = []
        for k in kids:  # a run of like prose is one repeated node
            last = node.kids[-1] if node.kids else None
            if last and k.tag in PROSE and not k.kids and not last.kids and last.sig == k.sig and last.out == k.out:
                last.texts += k.texts
                last.order += k.order
            else:
                node.kids.append(k)


def _hash(*parts) -> int:
    text = "\n".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 16)
def _sign(sig: str) -> int:
    return _hash(sig)


def flat(root: Node, article: bool) -> tuple[array, list[str], array]:
    """Nodes in order (depth, signature, prose of an article, hash of the texts or 0 each), texts in order, the node of each text.

    Only nodes outside furniture with text at or below them are told, and only of an article where there is one.
    """
    seen: list[tuple[Node, int, int, bool]] = []  # node, index of its parent, depth, whether its text counts
    stack = [(root, -1, 0, False)]
    while stack:
        node, above, depth, inside = stack.pop()
        if node.out:
            continue
        inside = inside or node.tag in ("article", "main")
        me = len(seen)
        seen.append((node, above, depth, bool(node.texts) and (inside or not article)))
        stack += [(k, me, depth + 1, inside) for k in reversed(node.kids)]
    told = [counts for *_, counts in seen]
    for k in range(len(seen) - 1, 0, -1):
        if told[k]:
            told[seen[k][1]] = True
    nodes, found = array("q"), []
    for (node, _, depth, counts), tell in zip(seen, told, strict=True):
        if tell:
            nodes.extend((depth, _sign(node.sig), counts and article and node.tag in PROSE, _hash(*node.texts) if counts else 0))
            if counts:
                at = len(nodes) // 4 - 1
                found += [(order, text, at) for order, text in zip(node.order, node.texts, strict=True)]
    found.sort()
    return nodes, [t for _, t, _ in found], array("q", [at for *_, at in found])


def layout(root: Node) -> int:
    """Tells pages of one layout: the signatures of the containers below the body."""
    level = root.kids
    while level and all(k.tag in ("html", "body", "head") for k in level):
        level = [x for k in level if k.tag != "head" for x in k.kids]
    return _hash(*sorted({k.sig for k in level if k.tag not in PROSE}))


class Model:
    """A page's nodes with their children, sizes, weights of whole subtrees, and subtrees told apart."""

    def __init__(self, nodes: bytes, names: dict[tuple, int]):
        flat_ = array("q", nodes)
        depth, self.sig, self.prose, self.text = flat_[0::4], flat_[1::4], flat_[2::4], flat_[3::4]
        n = len(depth)
        self.kids: list[list[int]] = [[] for _ in range(n)]
        self.size, self.weight, self.name = [1] * n, [0] * n, [0] * n
        line: list[int] = []
        for k in range(n):
            del line[depth[k] :]
            if line:
                self.kids[line[-1]].append(k)
            line.append(k)
        for k in range(n - 1, -1, -1):
            kids = self.kids[k]
            self.size[k] += sum(self.size[c] for c in kids)
            self.weight[k] = 1 + (self.text[k] != 0) + sum(self.weight[c] for c in kids)
            self.name[k] = names.setdefault((self.sig[k], self.text[k], *(self.name[c] for c in kids)), len(names))


def _middle(a: list[int], b: list[int], w: dict[tuple[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """The ordered matching of two lists of children with the greatest weight."""
    best = [[0] * (len(b) + 1)]
    for x in a:
        above, row = best[-1], [0]
        for j, y in enumerate(b):
            row.append(max(above[j + 1], row[j], above[j] + w.get((x, y), 0)))
        best.append(row)
    i, j, pairs = len(a), len(b), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((a[i], b[j]))
    return best[-1][-1], pairs


def _in_order(a: list[int], b: list[int], p: Model, m: Model) -> list[tuple[int, int]]:
    """Pairs of like signature, each as near the start as the one before it lets it be."""
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(m.sig[b[j]], []).append(j)
    out, done = [], -1
    for x in a:
        at = places.get(p.sig[x], [])
        while at and at[-1] <= done:
            at.pop()
        if at:
            done = at.pop()
            out.append((x, b[done]))
    return out


def align(p: Model, m: Model) -> tuple[int, dict[int, int]]:
    """Simple tree matching of a page with a model: the weight, and the model's node of each matched node of the page.

    Equal subtrees at either end of two lists of children belong to a best matching, so they are matched first.
    """
    if not p.kids or not m.kids or p.sig[0] != m.sig[0]:
        return 0, {}
    pairs, plans = [(0, 0)], []
    for a, b in pairs:  # grows: parents before their children
        if p.name[a] == m.name[b]:
            plans.append(None)
            continue
        ka, kb = p.kids[a], m.kids[b]
        lo, ha, hb = 0, len(ka), len(kb)
        while lo < ha and lo < hb and p.name[ka[lo]] == m.name[kb[lo]]:
            lo += 1
        while ha > lo and hb > lo and p.name[ka[ha - 1]] == m.name[kb[hb - 1]]:
            ha, hb = ha - 1, hb - 1
        ends = list(zip(ka[:lo] + ka[ha:], kb[:lo] + kb[hb:], strict=True))
        ka, kb = ka[lo:ha], kb[lo:hb]
        told = len(ka) * len(kb) <= CELLS and len(pairs) <= PAIRS
        new = [(x, y) for x in ka for y in kb if p.sig[x] == m.sig[y]] if told else _in_order(ka, kb, p, m)
        plans.append((ends, ka, kb, None if told else new))
        pairs += new
    weights: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (a, b), plan in zip(reversed(pairs), reversed(plans), strict=True):
        if plan is None:
            weights[a, b] = p.weight[a]
            continue
        ends, ka, kb, fixed = plan
        if fixed is None:
            got, between = _middle(ka, kb, weights)
        else:
            got, between = sum(weights[x] for x in fixed), fixed
        weights[a, b] = 1 + (p.text[a] != 0 and p.text[a] == m.text[b]) + sum(p.weight[x] for x, _ in ends) + got
        chosen[a, b] = ends + between
    out, stack = {}, [(0, 0)]
    while stack:
        a, b = stack.pop()
        if p.name[a] == m.name[b]:
            out.update(zip(range(a, a + p.size[a]), range(b, b + m.size[b]), strict=True))
        else:
            out[a] = b
            stack += chosen[a, b]
    return weights[0, 0], out


TREES = "id long, url string, host string, layout long, page long, nodes binary, texts array<string>, owners binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for html in batch.column(3).to_pylist():
            root, article = tree(html) if html else (Node("", "", False), False)
            nodes, texts, owners = flat(root, article)
            nodes = nodes.tobytes()
            for column, value in zip(out, (layout(root), int.from_bytes(hashlib.blake2b(nodes, digest_size=8).digest(), "little", signed=True), nodes, texts, owners.tobytes()), strict=True):
                column.append(value)
        types = pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.binary()
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, out, types)], names=[c.split()[0] for c in TREES.split(", ")])


COUNTS = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("slot", pa.int64()), ("prose", pa.bool_()), ("pages", pa.int64()), ("text_lo", pa.int64()), ("text_hi", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _models():
    names: dict[tuple, int] = {}

    @lru_cache(1 << 12)
    def model(nodes: bytes) -> Model:
        return Model(nodes, names)

    def page(nodes: bytes) -> Model:
        if len(names) > 1 << 20:  # names of subtrees hold within one generation
            names.clear()
            model.cache_clear()
        return Model(nodes, names)

    return page, model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node of a model: pages with an aligned node, the least and the greatest hash of its texts and of the pages."""
    page, model = _models()
    held: dict[tuple[str, int | None, int], list] = {}

    def rows() -> pa.RecordBatch:
        out = [(*key, *value) for key, value in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), COUNTS, strict=True)], schema=COUNTS)

    for batch in batches:
        for host, lay, hashed, nodes, *both in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            p = page(nodes)
            for scope, other in zip((lay, None), both, strict=True):
                if other is None:
                    continue
                for a, b in align(p, model(other))[1].items():
                    text = p.text[a]
                    if text:
                        old = held.get((host, scope, b))
                        if old is None:
                            held[host, scope, b] = [bool(p.prose[a]), 1, text, text, hashed, hashed]
                        else:
                            old[:] = old[0] or bool(p.prose[a]), old[1] + 1, min(old[2], text), max(old[3], text), min(old[4], hashed), max(old[5], hashed)
            if len(held) > HELD:
                yield rows()
    if held:
        yield rows()


def _content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page, model = _models()
    for batch in batches:
        out = []
        for nodes, texts, owners, *rest in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            gone: set[int] = set()
            for other, slots in (rest[:2], rest[2:]):
                if other is not None and slots:
                    fixed = set(slots)
                    gone.update(a for a, b in align(page(nodes), model(other))[1].items() if b in fixed)
            out.append("\n\n".join(t for t, at in zip(texts, array("q", owners), strict=True) if at not in gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "url", "text"])


def _beside(trees: DataFrame, models: DataFrame) -> DataFrame:
    """Pages with the models of their host and layout; pages without any keep nulls."""
    size = models.agg(F.sum(F.coalesce(F.length("own"), F.lit(0)) + F.coalesce(F.length("hosts"), F.lit(0)) + 128)).first()[0] or 0
    if size <= SMALL:
        return trees.join(F.broadcast(models), ["host", "layout"], "left")
    spread = models.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return trees.withColumn("salt", F.expr(f"cast(pmod(xxhash64(page, id), {SALTS}) AS int)")).join(spread.hint("shuffle_hash"), ["host", "layout", "salt"], "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """-> ``(id, url, text)`` for every row of ``pages``."""
    scratch = Scratch(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    pages = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    pages = pages.select("id", "url", F.coalesce(host, F.lit("")).alias("host"), "html")
    trees = scratch.table(pages.mapInArrow(_parse, TREES), "trees")
    held = trees.where("host <> '' AND length(nodes) > 0").select("host", "layout", "page", "nodes")

    def models(*keys: str) -> DataFrame:
        first = F.min_by("nodes", "page")
        return held.groupBy(*keys).agg(F.count("*").alias("pages"), F.min("page").alias("lo"), F.max("page").alias("hi"), first.alias("nodes")).select(*keys, "pages", F.expr("if(lo < hi, nodes, NULL)").alias("nodes"))

    own, hosts = scratch.table(models("host", "layout"), "own"), scratch.table(models("host"), "hosts")
    every = own.select("host", "layout", F.col("nodes").alias("own")).join(hosts.select("host", F.col("nodes").alias("hosts")), "host").where("own IS NOT NULL OR hosts IS NOT NULL")
    every = scratch.table(every, "models")
    counts = _beside(held, every).select("host", "layout", "page", "nodes", "own", "hosts").where("own IS NOT NULL OR hosts IS NOT NULL")
    counts = counts.mapInArrow(_count, "host string, layout long, slot long, prose boolean, pages long, text_lo long, text_hi long, lo long, hi long")
    counts = counts.groupBy("host", "layout", "slot").agg(F.max("prose").alias("prose"), F.sum("pages").alias("pages"), F.min("text_lo").alias("text_lo"), F.max("text_hi").alias("text_hi"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fixed = scratch.table(counts.where(f"text_lo = text_hi AND lo < hi AND (layout IS NULL AND NOT prose OR pages >= {FEW})").select("host", "layout", "slot", "pages"), "fixed")

    def slots(name: str, of: DataFrame, *keys: str) -> DataFrame:
        mine = fixed.where("layout IS NOT NULL" if "layout" in keys else "layout IS NULL").select(*keys, "slot", F.col("pages").alias("n"))
        return mine.join(of.select(*keys, "pages"), list(keys)).where("n = pages").groupBy(*keys).agg(F.collect_list("slot")).toDF(*keys, name)

    known = every.join(slots("own_slots", own, "host", "layout"), ["host", "layout"], "left").join(slots("hosts_slots", hosts, "host"), "host", "left")
    known = scratch.table(known.where("own_slots IS NOT NULL OR hosts_slots IS NOT NULL"), "known")
    both = _beside(trees, known).select("id", "url", "nodes", "texts", "owners", "own", "own_slots", "hosts", "hosts_slots")
    return keep(both.mapInArrow(_content, "id long, url string, text string"), scratch)
