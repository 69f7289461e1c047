"""Main text of web pages by wrapper induction.

Pages of a host are aligned pair by pair by simple tree matching: two trees match if
their roots have one label, and their children match in order, so that most nodes are
paired.  Nodes whose text is the same in the paired pages are fixed; nodes whose text varies
are slots.  The wrapper of a layout is the container that holds the varying text (its path of
labels; a label is a tag with its classes, but for those with a digit) and the constant blocks inside it: those that
four pages at least, and ``CONSTANT_SHARE`` of all, hold with the same text at the same path,
however often a page repeats it.  The same text at another path stays.  Each page is then read by its host's wrapper: the text of that
container, without the constant blocks and without parts whose tag, class, id or role
says that they are menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts or styles.  A page that lacks the container, or whose host has no wrapper, is read
from its ``article`` or ``main`` element, or from its body.

Text is cut into blocks at block elements; references are decoded, white space inside a
block becomes one space, blocks are joined by a newline.  A line break is white space.

How it runs: all distinct pages of a host are dealt to bins of ``BIN`` pages or more, of one
layout (path of the container of nearly all text) where the host has ``ONE_BIN`` or more; each
page is aligned with the next of its layout in the bin by salted hash.  Votes for paths, and
the pages that hold a block, are summed over the bins.  A text in ``CONSTANT_SHARE`` of the
pages is in two of a bin; texts in one page of a bin are not passed on.  A host keeps a wrapper
for each path with two votes or more and ``OWN_SHARE`` of the pages that hold it; a page is read
by the first, most voted, whose container it holds, the whole page last.

Bounds: no page is left out, whatever its length.  A bin is small, so a host with a large part
of all pages is many tasks' work.  Trees of any size are matched by the same rule: children of one
shape (labels without texts) are compared once, and a table of children takes two bits a cell.  A
page's row carries the wrappers of its host.

Defined cases: null or empty html gives an empty text; markup that is cut off or never
closed is read as far as it goes; a null or broken url is a host of its own kind, shared
by all such pages; repeated pages get equal texts, and equal pages of a host count
once; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.store import in_small_batches, written

# Elements and words of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe noframes template".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article main section div td body center".split())
ENDS_PARAGRAPH = BLOCKS - set("html head body caption td th tr tbody thead tfoot option optgroup legend summary".split())
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}
LEFT_OUT = set("head nav footer aside form button select option input label menu annotation annotation-xml".split())
LEFT_OUT_AROUND = set("dialog object canvas audio video map".split())  # outside articles
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside cookie cookies consent gdpr notice "
    "notices comment comments respond replies disqus share sharing social related recommended newsletter subscribe "
    "signup popup modal overlay widget toolbar pagination pager login search skip copyright complementary contentinfo "
    "navigation".split()
)
BESIDE = set(
    "area bar block box button buttons container content entry form group header icon icons inner items link links list "
    "panel policy post posts article articles section slot text title unit wrap wrapper".split()
)
GROUPS = set("div section ul ol dl table figure center fieldset details".split())
HEADERS = {"header", "masthead", "banner"}
DEEPEST = 200  # elements nested deeper become siblings, but for parts that are left out
CONSTANT_PAGES, CONSTANT_SHARE, VARYING_SHARE = 4, 0.8, 0.9
SMALL_TABLE = 1024  # cells of a table that plain lists fill faster; the alignment is the same
BIN = 24  # pages in a bin, at least, where a host has more
ONE_BIN = 2 * BIN
SALT = b"neighbours"
REMEMBERED = 100_000  # pages a task remembers, so as not to send a copy again
OWN_SHARE = 0.5  # of the pages that hold a layout's path, in bins that voted for it

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>|<[!?][^>]*>", re.DOTALL
)
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*>", re.DOTALL)  # quotes mean nothing
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z0-9]+")
_DIGIT = re.compile(r"\d")


class Node:
    __slots__ = ("tag", "attributes", "label", "parts")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes
        classes = attributes.get("class", "").lower().split()  # those with a digit often name the page
        self.label = ".".join([tag, *sorted(c for c in classes if not _DIGIT.search(c))]) if classes else tag
        self.parts: list[Node | str] = []

    def children(self) -> list[Node]:
        return [p for p in self.parts if not isinstance(p, str)]

    def own_text(self) -> str:
        return " ".join(unescape(" ".join(p for p in self.parts if isinstance(p, str))).split())


def parse(html: str) -> Node:
    """The tree of a page; end tags may be missing.

    Where quotes leave a tag open to the page's end, that tag and all after it end at their first ``>``.
    """
    root = Node("html", {})
    stack, at, n, last, tokens = [root], 0, len(html), html.rfind(">"), _TOKEN
    below: Counter[str] = Counter()  # open elements beyond the deepest
    while at < n:
        begin = html.find("<", at, last)
        if begin < 0:
            rest = html[at:]
            cut = re.search(r"<[a-zA-Z/!][^<]*\Z", rest)  # a tag that is cut off
            stack[-1].parts.append(rest[: cut.start()] if cut else rest)
            break
        if begin > at:
            stack[-1].parts.append(html[at:begin])
        token = tokens.match(html, begin)
        if token is None and tokens is _TOKEN:
            token = _LOOSE.match(html, begin)
            tokens = _LOOSE if token else tokens
        if token is None:
            stack[-1].parts.append("<")
            at = begin + 1
            continue
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if len(stack) < DEEPEST and below:
            below.clear()
        if token[1]:
            if below[tag]:
                below[tag] -= 1
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(token[3])} if token[3] else {}
        if tag == "html":
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(html, at)
            at = end.start() if end else n
            close = html.find(">", at)
            at = close + 1 if close >= 0 else n
            continue
        _close_implied(stack, tag)
        node = Node(tag, attributes)
        stack[-1].parts.append(node)
        if tag not in VOID and not token[3].endswith("/"):
            if len(stack) < DEEPEST or len(stack) == DEEPEST and named_boilerplate(node, True):
                stack.append(node)
            else:
                below[tag] += 1
    return root


def _close_implied(stack: list[Node], tag: str) -> None:
    if tag in ENDS_PARAGRAPH:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == "p":
                del stack[depth:]
                break
            if stack[depth].tag in BLOCKS:
                break
    for depth in range(len(stack) - 1, 0, -1) if tag in SIBLINGS else ():
        if stack[depth].tag in SCOPES.get(tag, ()):
            break
        if stack[depth].tag in SIBLINGS[tag]:
            del stack[depth:]
            break


def named_boilerplate(node: Node, inside: bool) -> bool:
    """Whether tag, class, id or role say that a part is no article.

    ``inside`` an article headers and hidden parts stay, and a class, id or role must say so as a
    whole ("related-posts", not "related-work"), of an element that groups others: no paragraph,
    heading or item goes by its name.
    """
    if node.tag in LEFT_OUT or not inside and (node.tag == "header" or node.tag in LEFT_OUT_AROUND):
        return True
    if not node.attributes or node.tag in ("html", "body", "article", "main"):
        return False
    said = " ".join(node.attributes.get(a, "") for a in ("class", "id", "role")).lower()
    if inside:
        return node.tag in GROUPS and any(_names_boilerplate(name) for name in said.split())
    if "hidden" in node.attributes or "display:none" in node.attributes.get("style", "").replace(" ", "").lower():
        return True
    words = set(_WORDS.findall(said))
    return bool(words & BOILERPLATE or words & HEADERS)


def _names_boilerplate(name: str) -> bool:
    words = {w for w in _WORDS.findall(name) if not w.isdigit()}
    return bool(words & BOILERPLATE) and words <= BOILERPLATE | BESIDE


def is_article(node: Node, by_wrapper: bool) -> bool:
    """Whether headers under a node found by a wrapper, or without one, belong to the article."""
    return node.tag in ("article", "main") or by_wrapper and node.tag not in ("html", "body")


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: most pairs of nodes in order, and which."""
    shapes = Shapes()
    shape_of = shapes.under(a) | shapes.under(b)
    if a.label != b.label:
        return 0, []
    out, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        out.append((x, y))
        left, right = x.children(), y.children()
        if left and right:
            met = shapes.aligned(shape_of[id(x)], shape_of[id(y)])[1]
            stack += [(left[i], right[j]) for i, j in met]
    return len(out), out


class Shapes:
    """Trees of labels without their texts, each by a number; what two of them have in common is found once."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def under(self, tree: Node) -> dict[int, int]:
        """The shape of each node of the tree."""
        shape_of: dict[int, int] = {}
        for node in reversed([node for _, node in walk(tree)]):
            key = (node.label, *[shape_of[id(c)] for c in node.children()])
            number = self.numbers.setdefault(key, len(self.labels))
            if number == len(self.labels):
                self.labels.append(key[0])
                self.children.append(key[1:])
                self.sizes.append(1 + sum([self.sizes[c] for c in key[1:]]))
            shape_of[id(node)] = number
        return shape_of

    def aligned(self, a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        """Pairs of nodes of two shapes with one label, and which children meet, the last first."""
        found = self.known.get((a, b))
        if found is None:
            left, right = self.children[a], self.children[b]
            if a == b:
                found = self.sizes[a], [(i, i) for i in range(len(left))]
            elif len(left) * len(right) < SMALL_TABLE:
                found = self._align_few(left, right)
            else:
                found = self._align(left, right)
            self.known[a, b] = found
        return found

    def _score(self, x: int, y: int) -> int:
        if self.labels[x] != self.labels[y]:
            return 0
        return self.aligned(x, y)[0] if self.children[x] and self.children[y] else 1

    def _align_few(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, list[tuple[int, int]]]:
        """What ``_align`` finds, by a plain table."""
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        labels, children = self.labels, self.children
        for i, x in enumerate(left):
            row, above, label, inner = best[i + 1], best[i], labels[x], children[x]
            for j, y in enumerate(right):
                top = row[j] if row[j] > above[j + 1] else above[j + 1]
                if label == labels[y]:
                    score = above[j] + (self.aligned(x, y)[0] if inner and children[y] else 1)
                    if score > top:
                        top = score
                row[j + 1] = top
        met, i, j = [], len(left), len(right)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                met.append((i, j))
        return 1 + best[-1][-1], met

    def _align(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, list[tuple[int, int]]]:
        """The best alignment, row by row; of the table only its bits "as above" and "as left" are kept."""
        kinds, kind_of = np.unique(np.array(right), return_inverse=True)
        scores: dict[int, np.ndarray] = {}
        above, as_above, as_left = np.zeros(len(right) + 1, np.int64), [], []
        for x in left:
            if x not in scores:
                scores[x] = np.array([self._score(x, y) for y in kinds.tolist()])[kind_of]
            row = np.zeros_like(above)
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + scores[x]), out=row[1:])
            as_above.append(np.packbits(row[1:] == above[1:]))
            as_left.append(np.packbits(row[1:] == row[:-1]))
            above = row
        met, i, j = [], len(left) - 1, len(right) - 1
        while i >= 0 and j >= 0:
            byte, bit = j >> 3, 0x80 >> (j & 7)
            if as_above[i][byte] & bit:
                i -= 1
            elif as_left[i][byte] & bit:
                j -= 1
            else:
                met.append((i, j))
                i, j = i - 1, j - 1
        return 1 + int(above[-1]), met


def walk(node: Node, path: str = "") -> Iterator[tuple[str, Node]]:
    stack = [(f"{path}/{node.label}", node)]
    while stack:
        here, at = stack.pop()
        yield here, at
        stack += [(f"{here}/{c.label}", c) for c in reversed(at.children())]


def observed(pages: list[str], layout_of: list[str] | None = None) -> Iterator[tuple[str, str | None, str | None, int, int]]:
    """What a bin of distinct pages of one host, with their layouts if known, says: root, path, text, votes and pages.

    A row with a path says how many pages that voted for the root hold a block; one without,
    how many pages voted for the root and how many hold its path.
    """
    if len(pages) < 2:
        return
    layouts: dict[str, list[int]] = {}
    for number, html in enumerate(pages):
        layouts.setdefault(layout_of[number] if layout_of else layout(parse(html)), []).append(number)
    votes: Counter[str] = Counter()
    holders: Counter[str] = Counter()
    blocks: Counter[tuple[str, str, str]] = Counter()
    trees: dict[int, Node] = {}  # of the two pages at hand
    for same, other in _neighbours(list(layouts.values())):
        trees = {n: trees[n] if n in trees else parse(pages[n]) for n in (same, other)}
        tree = trees[same]
        fixed = {id(x) for x, y in match(tree, trees[other])[1] if x.own_text() == y.own_text()}
        holders.update({path for path, _ in walk(tree)})
        root = _varying_container(tree, fixed)
        if root:
            votes[root] += 1
            blocks.update((root, *block) for block in blocks_inside(tree, root))
    for root, n in votes.items():
        yield root, None, None, n, holders[root]
    for (root, path, text), n in blocks.items():
        if n > 1:
            yield root, path, text, 0, n


def layout(tree: Node) -> str:
    """Path of the container of nearly all text: alike for most pages of one layout."""
    return _varying_container(tree, set())


def _neighbours(layouts: list[list[int]]) -> Iterator[tuple[int, int]]:
    """Each page with the next one of its layout, or of any if it is alone; a page's pairs follow each other."""
    every = [n for same in layouts for n in same]
    after = dict(zip(every, every[1:] + every[:1]))
    for same in layouts:
        yield from zip(same, same[1:] + same[:1]) if len(same) > 1 else [(same[0], after[same[0]])]


def induce(pages: list[str]) -> tuple[str, list[tuple[str, str]]]:
    """Path of the container of varying text ("": none), and constant blocks inside it, of pages of one host and layout."""
    seen = list(observed(list(dict.fromkeys(pages))))
    votes = {root: n for root, path, _, n, _ in seen if path is None}
    root = min(votes, key=lambda p: (-votes[p], -p.count("/"), p)) if votes else ""
    held = [(path, text, n) for r, path, text, _, n in seen if r == root and path is not None]
    return root, sorted((p, t) for p, t, n in held if n >= max(CONSTANT_PAGES, CONSTANT_SHARE * votes[root]))


def blocks_inside(tree: Node, root: str) -> set[tuple[str, str]]:
    """Path and text of each block in the containers at ``root``, once per page."""
    blocks: list[tuple[str, str]] = []
    for path, node in walk(tree):
        if path == root:
            _read(node, path, is_article(node, True), (), blocks)
    return set(blocks)


def _varying_container(tree: Node, fixed: set[int]) -> str:
    """Path of the deepest container that holds nearly all text that varies and isn't named boilerplate."""
    weight: dict[int, int] = {}

    def weigh(node: Node, inside: bool) -> int:
        inside = inside or node.tag in ("article", "main")
        total = 0 if id(node) in fixed else len(node.own_text())
        for child in node.children():
            if not named_boilerplate(child, inside):
                total += weigh(child, inside)
        weight[id(node)] = total
        return total

    every = weigh(tree, False)
    if not every:
        return ""
    path, at, best = f"/{tree.label}", tree, ""
    while True:
        heavy = [c for c in at.children() if weight.get(id(c), 0) >= VARYING_SHARE * every]
        if not heavy:
            return best
        at = heavy[0]
        path += f"/{at.label}"
        if at.tag in CONTAINERS:
            best = path


def main_text(html: str | None, root: str = "", constants: Collection[tuple[str, str]] = frozenset()) -> str:
    """The text of a page by a wrapper."""
    return text_by(html, {root: constants} if root else {})


def text_by(html: str | None, wrappers_of: dict[str, Collection[tuple[str, str]]]) -> str:
    """The text of a page by the first of its host's wrappers (root: constants) whose container it holds."""
    if not html:
        return ""
    tree = parse(html)
    every = list(walk(tree))
    paths = {path for path, _ in every}
    root = next((r for r in wrappers_of if r in paths), "")
    constants = wrappers_of.get(root, ())
    found = [x for x in every if x[0] == root]
    if not found:
        found = [x for x in every if x[1].tag == "article"] or [x for x in every if x[1].tag == "main"]
        inner = {id(x) for _, n in found for _, x in walk(n) if x is not n}
        found = [x for x in found if id(x[1]) not in inner] or every[:1]
    blocks: list[tuple[str, str]] = []
    for path, node in found:
        _read(node, path, is_article(node, bool(root)), constants, blocks)
    return "\n".join(text for _, text in blocks)


def _read(top: Node, path: str, inside: bool, constants: Collection[tuple[str, str]], blocks: list[tuple[str, str]]) -> None:
    """Append path and text of the blocks under ``top``, but for constant ones; inline elements are in no path."""
    held: list[str] = []

    def flush(path: str) -> None:
        text = " ".join(unescape("".join(held)).split())
        if text and (path, text) not in constants:
            blocks.append((path, text))
        held.clear()

    stack: list[tuple[Node | str | None, bool, str]] = [(top, inside, path)]
    while stack:
        at, inside, path = stack.pop()
        if at is None:
            flush(path)
        elif isinstance(at, str):
            held.append(at)
        elif at.tag == "br":
            held.append(" ")
        elif at is top or not named_boilerplate(at, inside):
            inside = inside or at.tag in ("article", "main")
            if at.tag in BLOCKS:
                flush(path)
                path = path if at is top else f"{path}/{at.label}"
                stack.append((None, inside, path))
            stack += [(p, inside, path) for p in reversed(at.parts)]
    flush(path)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


SEEN = "host string, layout string, digest long"
OBSERVED = "host string, root string, path string, text string, votes long, pages long"


def _distinct(pages: DataFrame, packed: bool) -> DataFrame:
    """Host, layout, digest and, if asked, packed html of pages (host, html); a copy comes once per task at least."""
    names = ["host", "layout", "digest", *(["packed"] if packed else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()
        for batch in batches:
            rows = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                data = html.encode("utf-8", "surrogatepass")
                digest = blake2b(data, digest_size=16, salt=SALT).digest()
                if (host, digest) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add((host, digest))
                number = int.from_bytes(digest[:8], "little", signed=True)
                rows.append((host, layout(parse(html)), number, *([zlib.compress(data, 1)] if packed else [])))
            types = [pa.string(), pa.string(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return pages.filter(F.length("html") > 0).select("host", "html").mapInArrow(run, SEEN + (", packed binary" if packed else ""))


def _binned(pages: DataFrame) -> DataFrame:
    """Distinct pages with the bin in which they meet: all of a small host, else ``BIN`` or more of a layout."""
    known = written(_distinct(pages, packed=False).distinct(), "layouts").groupBy("host", "layout").agg(F.count("*").alias("n"))
    hosts = known.groupBy("host").agg(F.sum("n").alias("all"))
    bins = written(
        known.join(hosts, "host").select(
            F.col("host").alias("h"),
            F.col("layout").alias("l"),
            F.when(F.col("all") >= ONE_BIN, F.col("layout")).otherwise("").alias("group"),
            F.when(F.col("all") >= ONE_BIN, F.greatest(F.floor(F.col("n") / BIN), F.lit(1))).otherwise(1).alias("bins"),
        ),
        "bins",
    )
    met = _distinct(pages, packed=True).join(bins, (F.col("host") == F.col("h")) & (F.col("layout") == F.col("l")))
    return met.select("host", "group", F.pmod("digest", "bins").alias("bin"), "layout", "digest", "packed")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, layouts) of pages (host, html): each layout's root and constants, in the order in which they are tried."""

    def run(table: pa.Table) -> pa.Table:
        order = sorted(set(zip(*[table.column(c).to_pylist() for c in ("digest", "packed", "layout")])))
        pages = [zlib.decompress(data).decode("utf-8", "surrogatepass") for _, data, _ in order]
        rows = list(observed(pages, [layout for _, _, layout in order]))
        root, path, text, votes, n = zip(*rows) if rows else [()] * 5
        host = pa.array([table.column("host")[0].as_py()] * len(rows), pa.string())
        strings = [pa.array(c, pa.string()) for c in (root, path, text)]
        return pa.table([host, *strings, pa.array(votes, pa.int64()), pa.array(n, pa.int64())], ["host", "root", "path", "text", "votes", "pages"])

    told = _binned(pages).groupBy("host", "group", "bin").applyInArrow(run, OBSERVED)
    told = written(told.groupBy("host", "root", "path", "text").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages")), "told")
    roots = told.filter(F.col("path").isNull()).select("host", "root", "votes", "pages")
    # A layout's path says so in its own pages; where no path has two votes, the best one counts.
    first = roots.groupBy("host").agg(F.max("votes").alias("most"), F.max_by("root", F.struct("votes", F.length(F.regexp_replace("root", "[^/]", "")), "root")).alias("best"))
    own = (F.col("votes") > 1) & (F.col("votes") >= OWN_SHARE * F.col("pages"))
    roots = roots.join(first, "host").filter(own | (F.col("root") == F.col("best"))).select("host", "root", "votes")
    blocks = told.filter(F.col("path").isNotNull()).select("host", "root", "path", "text", F.col("pages").alias("n"))
    constant = (F.col("n") >= CONSTANT_PAGES) & (F.col("n") >= CONSTANT_SHARE * F.col("votes"))
    constants = (
        blocks.join(roots, ["host", "root"]).filter(constant)
        .groupBy("host", "root").agg(F.collect_list(F.struct("path", "text")).alias("constants"))
    )
    whole = F.col("root").rlike("^/html(/body[^/]*)?$")
    ranked = F.struct(whole.alias("whole"), (-F.col("votes")).alias("fewer"), "root", "constants")
    return roots.join(constants, ["host", "root"], "left").groupBy("host").agg(F.sort_array(F.collect_list(ranked)).alias("layouts"))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = in_small_batches(pages).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    ).withColumn("host", host_of(F.col("url")))
    learned = written(wrappers(rows.select("host", "html")), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, layouts in zip(batch.column("html").to_pylist(), batch.column("layouts").to_pylist()):
                wrappers_of = {x["root"]: {(c["path"], c["text"]) for c in x["constants"] or ()} for x in layouts or ()}
                texts.append(text_by(html, wrappers_of))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    joined = rows.join(learned, "host", "left").select("page_id", "url", "html", "layouts")
    return joined.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
