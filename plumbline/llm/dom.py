"""A small tolerant reader of HTML: what wrapper induction needs of a page, no more.

Null pages are read as empty ones by the caller; an empty page is a root without children. Nothing recurses, so
pages may be nested as deeply as they are long.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|\Z)", re.I)
# Fixed values of HTML: elements without an end, elements whose content is not markup,
# elements inside a line of text, and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("table td th ul ol dl select body html article section div".split())
# What is never main text, by element, role, and word of a class or id.
_OUT_TAGS = frozenset("head script style noscript template nav footer aside form button select option textarea iframe svg canvas object dialog menu title".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
_OUT_WORDS = frozenset(
    "nav navbar navigation menu masthead footer sidebar aside widget ad ads advert adverts advertisement advertising banner promo promotion "
    "sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay comment comments disqus respond replies share sharing "
    "social related recommended breadcrumb breadcrumbs pagination pager subscribe newsletter signup login search toolbar skip".split()
)
_HEADER_OF = frozenset("article post entry content story page".split())
# Elements whose names are not asked, and those that show where a page's subject is.
_MAIN = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
_SUBJECT = frozenset("main article h1".split())


@dataclass(slots=True)
class Node:
    tag: str
    label: str
    out: bool
    #: Whether its class or id alone takes it out.
    named: bool
    parent: Node | None
    children: list = field(default_factory=list)
    #: Where the node is in the page's folded tree.
    place: int = -1


def _described(tag: str, attributes: str, parent: Node | None) -> tuple[str, bool, bool]:
    """Label (element and class words), whether its content is never main text, and whether its
    class or id hints at that."""
    words, out, hint = [], tag in _OUT_TAGS, False
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                mine = [w for w in re.split(r"[^a-z]+", value) if w]
                if name == "class":
                    words += mine
                if tag not in _MAIN:
                    hint |= not _OUT_WORDS.isdisjoint(mine) or ("header" in mine and _HEADER_OF.isdisjoint(mine))
            elif name == "role":
                out |= value in _OUT_ROLES
            else:
                out |= name == "hidden" or (name == "aria-hidden" and value == "true") or ("display" in value and "none" in value.partition("display")[2][:8])
    if tag == "header" and not out:
        node = parent
        while node is not None and node.tag not in ("article", "main"):
            node = node.parent
        out = node is None
    return tag + "." + ".".join(sorted(set(words))) if words else tag, out, hint


def _overrule(root: Node) -> None:
    """Takes back what names hint at, where it would take the page's subject: all of its main parts,
    articles and first headings, of which there are some, and more than half of its text."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if not isinstance(c, str) and (c.named or not c.out)]
    text, subjects = {}, {}
    for node in reversed(order):
        text[id(node)] = sum(len(c) * (not c.isspace()) if isinstance(c, str) else text.get(id(c), 0) for c in node.children)
        subjects[id(node)] = (node.tag in _SUBJECT) + sum(subjects.get(id(c), 0) for c in node.children if not isinstance(c, str))
    for node in order:
        if node.named and subjects[id(node)] == subjects[id(root)] > 0 and 2 * text[id(node)] > text[id(root)]:
            node.out = node.named = False


def parse(page: str) -> Node:
    """The tree of a page; text is kept as strings among the children, references decoded."""
    root = node = Node("", "", False, False, None)
    hints = False
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not text.isspace():
            node.children.append(entities.unescape(text) if "&" in text else text)
        elif text:
            node.children.append(" ")
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, attributes = tag.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in _ENDS_P or tag in _ENDS:
            closed = {"p"} if tag in _ENDS_P else _ENDS[tag]
            up = node
            while up is not root and up.tag not in closed and up.tag not in _SCOPE - closed:
                up = up.parent
            if up is not root and up.tag in closed:
                node = up.parent
                if tag == "tr" and node.tag in closed:
                    node = node.parent
        label, out, hint = _described(tag, attributes, node)
        new = Node(tag, label, out or hint, hint and not out, node)
        hints |= new.named
        node.children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            node = new
    if hints:
        _overrule(root)
    return root


@dataclass(slots=True)
class Folded:
    """The block elements of a page, neighbours of one label as one, in document order.

    Per place: parent, label, hash and length of the text directly in it, length of what of
    that is links. ``shape`` is parents and labels alone."""

    parents: list[int]
    labels: list[str]
    texts: list[list[str]]
    linked: list[int]

    def shape(self) -> tuple:
        return tuple(zip(self.parents, self.labels, strict=True))


def fold(root: Node) -> Folded:
    """Also notes in each node its place; what is never main text is left out."""
    done = Folded([-1], [""], [[]], [0])
    root.place = 0

    def text_of(node: Node, place: int, in_link: bool) -> list[Node]:
        """Takes the node's line text to ``place``; the block elements below it."""
        blocks = []
        # inline elements may be nested deeply: their children and whether these are in a link
        stack = [(iter(node.children), in_link)]
        while stack:
            children, linked = stack[-1]
            child = next(children, None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                if not child.isspace():
                    done.texts[place].append(child)
                    done.linked[place] += len(child) * linked
            elif child.out:
                continue
            elif child.tag in INLINE:
                child.place = place
                stack.append((iter(child.children), linked or child.tag == "a"))
            else:
                blocks.append(child)
        return blocks

    queue = [(0, text_of(root, 0, False))]
    while queue:
        place, nodes = queue.pop()
        runs: list[list] = []
        for node in nodes:
            if not runs or runs[-1][0] != node.label:
                runs.append([node.label, []])
            runs[-1][1].append(node)
        for label, run in runs:
            done.parents.append(place)
            done.labels.append(label)
            done.texts.append([])
            done.linked.append(0)
            mine, below = len(done.labels) - 1, []
            for node in run:
                node.place = mine
                below += text_of(node, mine, False)
            if below:
                queue.append((mine, below))
    return done


def align(a: tuple, b: tuple) -> list[int]:
    """Simple tree matching of two shapes: for each place of ``a`` its counterpart in ``b`` or
    -1. Children of matched nodes are matched in order, for the most matched nodes in all.

    Equal subtrees at the front and the back of two lists of children are matched as they are: no
    other matching of these has more nodes, nor do others profit if they are matched elsewhere.
    Tables are made only for what lies between, so pages that differ in few places take a time
    linear in their size, and only lists of unlike children the product of their lengths."""
    kinds: dict[tuple, int] = {}

    def described(shape: tuple) -> tuple[list[list[int]], list[int], list[int]]:
        """Children, a number that equal subtrees share, and nodes of each subtree."""
        below: list[list[int]] = [[] for _ in shape]
        for i, (parent, _) in enumerate(shape):
            if parent >= 0:
                below[parent].append(i)
        kind, nodes = [0] * len(shape), [1] * len(shape)
        # places of parents come before those of children, so from the back all below is known
        for i in range(len(shape) - 1, -1, -1):
            kind[i] = kinds.setdefault((shape[i][1], *(kind[c] for c in below[i])), len(kinds))
            nodes[i] += sum(nodes[c] for c in below[i])
        return below, kind, nodes

    in_a, kind_a, nodes_a = described(a)
    in_b, kind_b, _ = described(b)
    if a[0][1] != b[0][1]:
        return [-1] * len(a)
    # pairs of nodes whose parents are a pair; with each, how many children are equal in front and at the back
    pairs, ends = [(0, 0)], {}
    for i, j in pairs:
        if kind_a[i] == kind_b[j]:
            continue
        x, y = in_a[i], in_b[j]
        short, front, back = min(len(x), len(y)), 0, 0
        while front < short and kind_a[x[front]] == kind_b[y[front]]:
            front += 1
        while front + back < short and kind_a[x[-1 - back]] == kind_b[y[-1 - back]]:
            back += 1
        ends[i, j] = front, back
        by_label: dict[str, list[int]] = {}
        for v in y[front : len(y) - back]:
            by_label.setdefault(b[v][1], []).append(v)
        pairs += [(u, v) for u in x[front : len(x) - back] for v in by_label.get(a[u][1], ())]
    sizes: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], list[list[int]]] = {}
    for i, j in reversed(pairs):
        if (i, j) not in ends:
            sizes[i, j] = nodes_a[i]
            continue
        front, back = ends[i, j]
        x, y = in_a[i], in_b[j]
        equal = x[:front] + x[len(x) - back :]
        x, y = x[front : len(x) - back], y[front : len(y) - back]
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p, u in enumerate(x, 1):
            row, above = table[p], table[p - 1]
            for q, v in enumerate(y, 1):
                row[q] = max(above[q], row[q - 1], above[q - 1] + sizes.get((u, v), 0))
        tables[i, j] = table
        sizes[i, j] = 1 + sum(nodes_a[u] for u in equal) + table[-1][-1]
    out = [-1] * len(a)
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        out[i] = j
        x, y = in_a[i], in_b[j]
        if kind_a[i] == kind_b[j]:
            stack += zip(x, y, strict=True)
            continue
        front, back = ends[i, j]
        stack += zip(x[:front], y[:front], strict=True)
        stack += zip(x[len(x) - back :], y[len(y) - back :], strict=True)
        p, q, table = len(x) - front - back, len(y) - front - back, tables[i, j]
        while p and q:
            if table[p][q] == table[p - 1][q]:
                p -= 1
            elif table[p][q] == table[p][q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                stack.append((x[front + p], y[front + q]))
    return out


def blocks_of(root: Node, wanted: set[int]) -> list[tuple[int, str]]:
    """Text blocks under the places ``wanted`` in page order, each with the place it is directly in."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    at = -1

    def flush() -> None:
        if line := " ".join("".join(held).split()):
            out.append((at, line))
        held.clear()

    # with each node: whether it is under a wanted place, and the place that text in it is directly in
    stack: list[tuple[Node | str | None, bool, int]] = [(root, False, -1)]
    while stack:
        node, inside, place = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if inside:
                held.append(node)
                at = place
        elif node.out:
            if node.tag not in INLINE:
                flush()
        elif node.tag in INLINE:
            if node.tag == "br":
                held.append(" ")
            stack += [(c, inside, place) for c in reversed(node.children)]
        else:
            flush()
            inside = inside or node.place in wanted
            stack.append((None, False, -1))
            stack += [(c, inside, node.place) for c in reversed(node.children)]
    flush()
    return out
