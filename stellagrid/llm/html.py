"""HTML extraction by wrapper induction: the main text of each page, found by aligning pages of its host."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, small_side

# Element names of the HTML standard, by what they do here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math textarea".split())
INLINE = set("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th figcaption".split())
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
LINKS = RAW | set("a button".split())
BOILERPLATE = RAW | set("nav header footer aside form button select input dialog menu head title".split())
# Class, id and role words by which pages name what is not main text, and those of them that also name
# parts of an article.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|menu|nav\w*|newsletter|notice|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)(?:$|[\s_-])",
    re.I,
)
FOREIGN = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|breadcrumbs?|comments?|consent|cookies?|disqus|menu|nav\w*|newsletter|popup|promo\w*|replies|sidebar|sponsor\w*|subscribe|widget)(?:$|[\s_-])",
    re.I,
)
TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)", re.S)
# The block elements whose presence tells layouts apart.
LAYOUT = r"<(article|aside|dl|footer|form|header|main|nav|ol|section|table|ul)[\s/>]"
#: A page aligns with a wrapper if this share of both trees' nodes is matched; a text is template if more than that share of pages has it.
ALIGNED, MOST = 0.5, 2 / 3
ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    __slots__ = ("children", "name", "tag")

    def __init__(self, tag: str, name: str = ""):
        self.tag, self.name, self.children = tag, name, []  # children: nodes and strings

    @property
    def boilerplate(self) -> bool:
        return self.tag in BOILERPLATE or bool(self.name and NAMED.search(self.name))

    @property
    def foreign(self) -> bool:
        """Boilerplate even inside an article: a header there is the article's if it has a heading, and words that also
        name parts of articles (post-header, related-work, notice, social) count only for what is nothing but links."""
        if self.tag == "header":
            return not _holds(self, lambda n: n.tag in HEADINGS)
        if self.tag in BOILERPLATE or bool(self.name and FOREIGN.search(self.name)):
            return True
        return bool(self.name and NAMED.search(self.name)) and not _holds(self, lambda n: any(isinstance(c, str) and not c.isspace() for c in n.children), LINKS)


def _holds(top: Node, wanted: Callable[[Node], bool], but: set[str] | frozenset[str] = frozenset()) -> bool:
    """Whether top or a node under it, outside elements of the kinds `but`, is wanted."""
    stack = [top]
    while stack:
        n = stack.pop()
        if n.tag in but:
            continue
        if wanted(n):
            return True
        stack += [c for c in n.children if isinstance(c, Node)]
    return False


def parse(source: str | None) -> Node:
    """A tree of the page. Missing end tags are supplied, stray ones ignored; raw elements keep no text."""
    top = Node("#page")
    stack, at, text = [top], 0, source or ""
    find = TAG.search
    while m := find(text, at):
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        closes = SELF_CLOSING.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in closes or (stack[k].tag == "p" and tag in CLOSES_P):
                del stack[k:]
                break
            if stack[k].tag not in INLINE and stack[k].tag != "p" and not (closes and stack[k].tag in ("td", "th")):
                break
        name = " ".join(a or b or c for _, a, b, c in ATTR.findall(m[3])) if m[3] else ""
        node = Node(tag, name)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    rest = text[at:]
    if rest:
        stack[-1].children.append(rest)
    return top


def squeeze(s: str) -> str:
    return " ".join(html.unescape(s).split())


def blocks(node: Node, skip=lambda n: False, sure: bool = False) -> Iterator[str]:
    """The texts of the blocks under node, without boilerplate and what skip() names; only without what is foreign to an
    article if node is `sure` to be one. Not recursive."""
    held: list[str] = []
    stack: list = [iter((node,))]
    ends: list[bool] = [False]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if ends.pop():
                yield squeeze("".join(held))
                held.clear()
        elif isinstance(child, str):
            held.append(child)
        elif child is not node and ((child.foreign if sure else child.boilerplate) or skip(child)):
            if child.tag not in INLINE:
                yield squeeze("".join(held))
                held.clear()
        elif child.tag == "br":
            held.append(" ")
        else:
            block = child.tag not in INLINE
            if block:
                yield squeeze("".join(held))
                held.clear()
            stack.append(iter(child.children))
            ends.append(block)
    yield squeeze("".join(held))


def text_of(nodes: list[Node], skip=lambda n: False, sure: bool = False) -> str:
    return " ".join(b for n in nodes for b in blocks(n, skip, sure) if b)


def form(n: Node) -> tuple:
    """What siblings must have in common to be one slot: tag, name and, but for prose, the kinds of blocks they hold."""
    kinds = () if n.tag in PROSE else frozenset(c.tag for c in n.children if isinstance(c, Node) and c.tag not in INLINE and c.tag not in RAW and c.tag not in VOID)
    return n.tag, n.name, kinds


class Shape:
    """A tree in which like siblings in a row are one: what simple tree matching aligns.

    A menu, an advert and an article stay apart, even as siblings of one tag without names, since they hold other kinds
    of blocks; the paragraphs of an article, or the items of a list, are one slot.
    """

    __slots__ = ("children", "count", "leaf", "nodes", "sig", "tag", "text")

    def __init__(self, nodes: list[Node], depth: int = 0):
        self.nodes, self.tag = nodes, f"{nodes[0].tag}.{nodes[0].name}"
        self.text = "\n".join(squeeze(c) for n in nodes for c in n.children if isinstance(c, str) and not c.isspace())
        groups: list[list[Node]] = []
        last = None
        for n in nodes:
            for c in n.children:
                if isinstance(c, Node) and c.tag not in RAW and c.tag not in VOID and not (c.tag in INLINE and n.tag in PROSE):
                    if (this := form(c)) == last:
                        groups[-1].append(c)
                    else:
                        groups.append([c])
                    last = this
        self.leaf = not groups
        self.children = [Shape(g, depth + 1) for g in groups] if depth < 60 else []
        self.sig, self.count = signed(self)

    def walk(self) -> Iterator[Shape]:
        yield self
        for c in self.children:
            yield from c.walk()


def signed(node) -> tuple[int, int]:
    """A hash of the tree under a node, equal for equal trees, and its number of nodes."""
    return hash((node.tag, *(c.sig for c in node.children))), 1 + sum(c.count for c in node.children)


#: Entries of a matrix of sizes that are held at once; longer lists are divided.
HELD = 1 << 20


def _weight(a, b, known: dict) -> int:
    """The size of the largest match of two trees."""
    if a.tag != b.tag:
        return 0
    if a.sig == b.sig:
        return a.count
    if (key := (a.sig, b.sig)) not in known:
        m, n, same = _same_ends(a.children, b.children)
        known[key] = 1 + same + (int(_rows(a.children[m[0] : m[1]], b.children[n[0] : n[1]], known)[-1]) if m[0] < m[1] and n[0] < n[1] else 0)
    return known[key]


def _same_ends(x: list, y: list) -> tuple[tuple[int, int], tuple[int, int], int]:
    """What is left of two lists without their equal beginnings and ends, and how many nodes those have.

    Equal trees at the same end of both lists are matched in some largest match.
    """
    i, same, m, n = 0, 0, len(x), len(y)
    while i < m and i < n and x[i].sig == y[i].sig:
        same += x[i].count
        i += 1
    while m > i and n > i and x[m - 1].sig == y[n - 1].sig:
        same += x[m - 1].count
        m, n = m - 1, n - 1
    return (i, m), (i, n), same


def _rows(x: list, y: list, known: dict, every: bool = False, back: bool = False) -> np.ndarray:
    """The sizes of the largest matches of all of x with each beginning of y, or of each beginning of x too (`every`);
    with `back`, of endings. Trees of equal form are weighed once, and a row is worked out at once."""
    x, y = (x[::-1], y[::-1]) if back else (x, y)
    kinds_x, kinds_y = {c.sig: c for c in x}, {c.sig: c for c in y}
    place = {sig: k for k, sig in enumerate(kinds_y)}
    which = np.fromiter((place[c.sig] for c in y), np.int64, len(y))
    weights = {sig: np.fromiter((_weight(a, b, known) for b in kinds_y.values()), np.int32, len(kinds_y)) for sig, a in kinds_x.items()}
    if len(weights) * len(y) <= HELD:
        weights = {sig: w[which] for sig, w in weights.items()}
        of = weights.__getitem__
    else:
        of = lambda sig: weights[sig][which]
    row = np.zeros(len(y) + 1, np.int32)
    rows = [row]
    for a in x:
        new = np.zeros_like(row)
        np.add(row[:-1], of(a.sig), out=new[1:])
        np.maximum(new, row, out=new)
        row = np.maximum.accumulate(new)
        if every:
            rows.append(row)
    return np.stack(rows) if every else row


def _together(x: list, y: list, known: dict) -> list[tuple[int, int]]:
    """The places of a largest match of two lists of trees. Long lists are divided where the sizes of the matches before
    and after add up to the most, so that no matrix of them is held."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i, m, j, n = todo.pop()
        (p, m1), (_, n1), _ = _same_ends(x[i:m], y[j:n])
        out += [(i + k, j + k) for k in range(p)]
        out += [(i + m1 + k, j + n1 + k) for k in range(m - i - m1)]
        i, m, j, n = i + p, i + m1, j + p, j + n1
        if i >= m or j >= n:
            continue
        if (m - i) * (n - j) <= HELD or m - i == 1:
            size = _rows(x[i:m], y[j:n], known, every=True)
            a, b = m - i, n - j
            while a and b:
                if size[a][b] == size[a - 1][b]:
                    a -= 1
                elif size[a][b] == size[a][b - 1]:
                    b -= 1
                else:
                    a, b = a - 1, b - 1
                    out.append((i + a, j + b))
            continue
        middle = (i + m) // 2
        split = j + int((_rows(x[i:middle], y[j:n], known) + _rows(x[middle:m], y[j:n], known, back=True)[::-1]).argmax())
        todo += [(i, middle, j, split), (middle, m, split, n)]
    return out


def match(a, b, known: dict | None = None) -> tuple[int, list[tuple]]:
    """Simple tree matching: the size of the largest order- and level-keeping match of two trees, and its node pairs."""
    if a.tag != b.tag:
        return 0, []
    if a.sig == b.sig:
        return a.count, list(zip(a.walk(), b.walk(), strict=True))
    known = {} if known is None else known
    pairs = [(a, b)]
    for i, j in _together(a.children, b.children, known):
        pairs += match(a.children[i], b.children[j], known)[1]
    return _weight(a, b, known), pairs


class Template:
    """A wrapper's node: number, tag and name, hash of its text if that is template, and whether it is of the main part."""

    __slots__ = ("children", "count", "main", "own", "sig", "slot", "tag")

    def __init__(self, spec: list, numbers: Iterator[int] | None = None):
        numbers = count() if numbers is None else numbers
        self.slot, self.tag, self.own, self.main = next(numbers), spec[0], spec[1], bool(spec[2])
        self.children = [Template(c, numbers) for c in spec[3]]
        self.sig, self.count = signed(self)

    @property
    def kind(self) -> str:
        return self.tag.partition(".")[0]

    def walk(self) -> Iterator[Template]:
        yield self
        for c in self.children:
            yield from c.walk()

    def spec(self) -> list:
        return [self.tag, self.own, int(self.main), [c.spec() for c in self.children]]


def text_hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def aligned(shape: Shape, wrapper: Template) -> list[tuple] | None:
    """The pairs of a page's shape and a wrapper, or None where they align poorly."""
    size, pairs = match(shape, wrapper)
    return pairs if 2 * size >= ALIGNED * (shape.count + wrapper.count) else None


def structure(pages: list[str]) -> str | None:
    """As JSON, the tree of the page that aligns best with the others; None for a single page. It holds no verdict."""
    if len(pages) < 2:
        return None
    shapes = [Shape([parse(p)]) for p in pages]
    base = max(shapes, key=lambda s: sum(match(s, t)[0] for t in shapes if t is not s))

    def spec(s: Shape) -> list:
        return [s.tag, None, 0, [spec(c) for c in s.children]]

    return json.dumps(spec(base))


def judge(spec: str, pages: int, slots: dict[int, tuple[int, int, int, int]]) -> str:
    """The wrapper of a structure, from all pages that align with it.

    slots gives, by number, how many pages have the slot's commonest text, its hash and length, and the summed length of
    all pages' texts. A text is template if more than MOST of the pages have it; all else varies. The main part is the
    innermost node that holds most of the varying text outside links, with the headings and paragraphs that vary beside
    it or beside a node around it. No class names are looked at, and of tags only those that never hold main text.
    Where nothing varies, nothing is template. Of equal nodes the first counts.
    """
    base = Template(json.loads(spec))
    mass: dict[int, int] = {}

    def weigh(t: Template, dead: bool) -> int:
        tag = t.kind
        dead |= tag in BOILERPLATE or tag == "a"
        n, h, size, total = slots.get(t.slot, (0, 0, 0, 0))
        t.own = h if n > 1 and n > MOST * pages else None
        mass[t.slot] = sum(weigh(c, dead) for c in t.children) + (0 if dead else total - (0 if t.own is None else n * size))
        return mass[t.slot]

    if not weigh(base, False):
        for t in base.walk():
            t.own = None
        return json.dumps(base.spec())
    main = base
    while down := next((c for c in main.children if c.kind not in PROSE and 2 * mass[c.slot] > mass[base.slot]), None):
        for c in main.children:
            c.main = c.kind in PROSE and mass[c.slot] > 0
        main = down
    main.main = True
    return json.dumps(base.spec())


def marked_main(page: Node) -> list[Node]:
    """The outermost article or main elements, else the body, else the page: all there is to go by without a wrapper."""
    for wanted in (("article", "main"), ("body",)):
        found, stack = [], [page]
        while stack:
            n = stack.pop()
            if n.tag in wanted and not (n.tag == "article" and n.boilerplate):
                found.append(n)
            elif not n.boilerplate:
                stack += [c for c in reversed(n.children) if isinstance(c, Node)]
        if found:
            return found
    return [page]


def main_part(page: Node, chosen: set[int]) -> list[Node]:
    """The nodes of the page that the wrapper chose, by their ids, in page order; marked_main() if it chose none.

    An article or main element that reaches beyond the chosen part, or divides it, corrects its edges; one that has
    nothing to do with it, as a teaser, does not. What the wrapper chose outside of it, as a headline before it, stays.
    """
    if not chosen:
        return marked_main(page)
    parts, roots, stack = [], [], [(page, None)]
    while stack:  # mark: the outermost article or main element above
        n, mark = stack.pop()
        if mark is None and n.tag in ("article", "main"):
            mark = n
        if id(n) in chosen:
            part = n if mark is None else mark
            if not any(part is p for p in parts[-1:]) and not any(part is p for p in parts if p is mark):
                parts.append(part)
            roots.append(n)
            continue
        stack += [(c, mark) for c in reversed(n.children) if isinstance(c, Node)]
    if not any(p.tag in ("article", "main") for p in parts):
        edges = {id(r): marks for r in roots if (marks := [m for m in marked_main(r) if m.tag in ("article", "main")])}
        parts = [m for p in parts for m in edges.get(id(p), [p] if p.tag in PROSE or not edges else [])]
    return parts


def extract(source: str | None, *wrappers: Template | None) -> str:
    """The page's main text: its part that aligns with the main nodes of the first wrapper it aligns with, without
    template and boilerplate.

    A leaf of the main part is template if its own text is the template's, unless it is prose (paragraphs, headings),
    since articles of a host may share paragraphs. A page that aligns with no wrapper goes by its own marks.
    """
    page = parse(source)
    chosen, constant = set(), set()
    known = [w for w in wrappers if w is not None]
    shape = Shape([page]) if known else None
    pairs = next((x for w in known if (x := aligned(shape, w)) is not None), [])
    for a, b in pairs:
        if b.own is not None and a.leaf and a.text and text_hash(a.text) == b.own:
            constant |= {id(n) for n in a.nodes if n.tag not in PROSE and n.tag not in ("article", "main", "body")}
        if b.main:
            chosen |= {id(n) for n in a.nodes}
    parts = main_part(page, chosen)
    return text_of(parts, lambda n: id(n) in constant, bool(chosen) or any(n.tag in ("article", "main") for n in parts))


RESULT = "page_id long, url string, text string, n_chars long"
SLOTS = "array<struct<slot: int, hash: long, size: int>>"


def templates() -> Callable[[str | None], Template | None]:
    """Wrappers from JSON, kept by a task while there are not too many."""
    known: dict[str, Template] = {}

    def get(spec: str | None) -> Template | None:
        if not spec:
            return None
        if spec not in known:
            if len(known) >= 2000:
                known.clear()
            known[spec] = Template(json.loads(spec))
        return known[spec]

    return get


def structures(marks: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, structure) of each key of marks (key, mark) with two pages or more; rows (key, mark, html) has the pages.

    The exemplars are the pages with the least mark, the greatest, and the least that is not negative: three plain
    aggregates of a hash, so a host with a third of all pages sends three numbers a task. They give the tree to align
    with, and decide nothing else.
    """
    least = marks.groupBy(*key).agg(F.min("mark").alias("a"), F.max("mark").alias("b"), F.min(F.when(F.col("mark") >= 0, F.col("mark"))).alias("c"))
    chosen = cut(least.select(*key, F.explode(F.array_distinct(F.array_compact(F.array("a", "b", "c")))).alias("mark")), "exemplars")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        found = structure(list(group.sort_values("mark")["html"]))
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in key}, "structure": [found]}).dropna()

    picked = rows.select(*key, "mark", "html").join(small_side(chosen, sizes(key)), [*key, "mark"]).dropDuplicates([*key, "mark"])
    return cut(picked.groupBy(*key).applyInPandas(choose, ", ".join(f"{k} string" for k in key) + ", structure string"), "structures")


def sizes(names: list[str]) -> Column:
    return sum((F.coalesce(F.octet_length(n), F.lit(0)) for n in names[1:]), F.octet_length(names[0]))


def tally(rows: DataFrame) -> DataFrame:
    """(host, layout, mark, poor, slots) of each different page of rows (host, layout, mark, html, first, structure).

    Every page is aligned with its structure, and slots are the numbers, text hashes and lengths of the nodes with text.
    poor marks those that do not align. Pages that align with first, if there is one, are left out. Exact copies of a
    page count once, so that they do not turn its text into template.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = templates()
        for b in batches:
            out = []
            for host, layout, mark, source, first, spec in zip(b["host"], b["layout"], b["mark"], b["html"], b["first"], b["structure"], strict=True):
                shape = Shape([parse(source)])
                if first and aligned(shape, get(first)) is not None:
                    continue
                pairs = aligned(shape, get(spec))
                out.append((host, layout, mark, pairs is None, [(t.slot, text_hash(a.text), len(a.text)) for a, t in pairs or () if a.text]))
            yield pd.DataFrame(out, columns=["host", "layout", "mark", "poor", "slots"])

    each = rows.select("host", "layout", "mark", "html", "first", "structure").mapInPandas(run, f"host string, layout string, mark long, poor boolean, slots {SLOTS}")
    return cut(each.groupBy("host", "layout", "mark").agg(F.first("poor").alias("poor"), F.first("slots").alias("slots")), "tally")


def judged(tallied: DataFrame, trees: DataFrame, key: list[str]) -> DataFrame:
    """(key, wrapper) from the tally of all pages: page counts are summed by (key, slot, text hash), then by slot."""
    good = tallied.where(~F.col("poor"))
    pages = good.groupBy(*key).agg(F.count("*").alias("pages"))
    texts = good.select(*key, F.explode("slots").alias("s")).groupBy(*key, "s.slot", "s.hash").agg(F.count("*").alias("n"), F.max("s.size").alias("size"))
    slots = texts.groupBy(*key, "slot").agg(F.max(F.struct("n", "hash", "size")).alias("top"), F.sum(F.col("n") * F.col("size")).alias("mass"))
    lists = slots.groupBy(*key).agg(F.collect_list(F.struct("slot", "top.n", "top.hash", "top.size", "mass")).alias("slots"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [judge(s, n, {x["slot"]: (x["n"], x["hash"], x["size"], x["mass"]) for x in (v if v is not None else ())}) for s, n, v in zip(b["structure"], b["pages"], b["slots"], strict=True)]
            yield b[key].assign(wrapper=made)

    joined = trees.join(pages, key).join(lists, key, "left").select(*key, "structure", "pages", "slots")
    return cut(joined.mapInPandas(run, ", ".join(f"{k} string" for k in key) + ", wrapper string"), "wrappers")


def induce_wrappers(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(host, wrapper), and (host, layout, second) for the pages that align poorly with their host's, or None.

    rows has host, layout, mark and html. Each page is parsed once for its host's tree, and the pages of layouts where
    some align poorly once more for the layout's.
    """
    none = F.lit(None).cast("string")
    trees = structures(rows, rows, ["host"])
    side = small_side(trees, sizes(["host", "structure"]))
    tallied = tally(rows.join(side, "host").withColumn("first", none))
    wrappers = judged(tallied, trees, ["host"])
    poor = tallied.where("poor")
    if poor.isEmpty():
        return wrappers, None
    key = ["host", "layout"]
    second = structures(poor, rows, key)
    both = cut(second.join(trees.withColumnRenamed("structure", "first"), "host"), "layouts")
    again = tally(rows.join(small_side(both, sizes([*key, "first", "structure"])), key))
    return wrappers, judged(again, second, key).withColumnRenamed("wrapper", "second")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html).

    Three pages a host at most meet in a group, to choose the tree that all pages of the host are aligned with; what is
    template follows from counts over all of them. Pages that align poorly form layouts by the block elements they
    contain, each with a tree and counts of its own. Exemplars and wrappers are broadcast to the pages if their measured
    size is small; else they join by host, and as no aggregation follows, adaptive execution can split a hot host.

    Null or empty html has an empty text. Null urls, or urls without host, share a host of empty name. Hosts with one
    page, or whose pages are equal, have no wrapper; there the page's own marks decide. Repeated rows each get their
    row. A very long page is parsed in one task, as any other, and lists of any length are aligned in memory that does not
    grow with their product; elements nested deeper than 60 keep their text, but are not aligned. Of nodes with equal text
    the first in the page counts. An empty table gives no rows. Other columns are left aside.
    """
    small_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    elements = F.regexp_extract_all(F.lower("html"), F.lit(LAYOUT), F.lit(1))
    rows = rows.withColumns({"mark": F.xxhash64("html"), "layout": F.array_join(F.array_sort(F.array_distinct(elements)), " ")})
    wrappers, second = induce_wrappers(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = templates()
        for b in batches:
            texts = [extract(source, get(one), get(two)) for source, one, two in zip(b["html"], b["wrapper"], b["second"], strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [*map(len, texts)]})

    joined = rows.join(small_side(wrappers, sizes(["host", "wrapper"])), "host", "left")
    if second is not None:
        joined = joined.join(small_side(second, sizes(["host", "layout", "second"])), ["host", "layout"], "left")
    else:
        joined = joined.withColumn("second", F.lit(None).cast("string"))
    return joined.select("page_id", "url", "html", "wrapper", "second").mapInPandas(run, RESULT)
