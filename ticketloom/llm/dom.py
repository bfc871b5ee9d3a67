"""A small DOM of web pages: blocks of text under block elements, and its shape.

A page becomes a tree of block elements whose leaves are runs of inline text. Inline elements
are no nodes. Scripts, styles, comments and other unseen content are no text; menus, headers,
footers, sidebars, adverts, notices, forms and reader comments, told by element, class, id or
role, stay as nodes without text. The shape of a tree writes equal neighbours once, so an
article of any number of paragraphs has one paragraph slot in its shape.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'<>])*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is not markup; it is skipped up to their end tag.
RAW = set("script style noscript template iframe object svg math textarea xmp title".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BLOCK = set(
    "address article aside blockquote body button caption center col colgroup dd details dialog "
    "dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul video audio canvas".split())
VOID = set("hr img br input link meta col source track wbr embed area base param".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: What an open element is closed by.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"},
    "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "thead", "tbody"},
    **{one: HEADINGS for one in HEADINGS}}
#: Elements that never hold the article's text.
CHROME_TAGS = set("head nav footer aside form button select dialog menu search audio video "
                  "canvas".split())
CHROME_WORDS = set(
    "ad ads adbox adsense adslot advert adverts advertisement banner sponsor sponsored promo "
    "promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead "
    "topbar cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist replies respond disqus discussion widget pagination "
    "pager toolbar".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alert "
                   "alertdialog menu menubar toolbar".split())
#: Words beside which "header" names the head of the article itself.
OWN_HEADER = {"article", "post", "entry", "content", "story"}
FRAMES = {"html", "body", "main"}
REGIONS = {"article", "main"}
#: Elements nested deeper are read as part of the last one that is not.
DEPTH = 100
#: Share of a run's characters inside links from which the run is a link list.
LINKED = 0.8


@dataclass
class Node:
    tag: str
    label: str
    by_tag: bool = False    # chrome by element
    by_name: bool = False   # chrome by class, id or role
    children: list = field(default_factory=list)  # nodes, or (text, is a link) runs


def names(attributes: str) -> tuple[str, set, str]:
    """(class and id as a label, their words, role) of an element."""
    label, words, role = "", set(), ""
    for found in ATTRIBUTE.finditer(attributes):
        value = found[2] or found[3] or found[4] or ""
        if found[1].lower() == "role":
            role = value.strip().lower()
        else:
            own = WORD.findall(value)
            label += "." + "-".join(own).lower()
            words.update(word.lower() for word in own)
    return label, words, role


def open_node(tag: str, attributes: str, in_article: bool) -> Node:
    if not attributes or attributes.isspace():
        label, words, role = "", set(), ""
    else:
        label, words, role = names(attributes)
    named = words & CHROME_WORDS
    if words & OWN_HEADER:
        named -= {"header"}
    if tag == "article":
        named &= {"ad", "advert", "comment", "related", "sponsored", "promo"}
    return Node(
        tag, tag + label, tag in CHROME_TAGS or tag == "header" and not in_article,
        tag not in FRAMES and (bool(named) or role in CHROME_ROLES
                               or bool(attributes) and HIDDEN.search(attributes) is not None))


def parse(page: str) -> Node:
    """The tree of a page; never fails, whatever the markup."""
    root = Node("", "")
    stack, run, linked = [root], [], [0, 0]  # characters in links, in all
    links = articles = beyond = at = 0
    end = page.rfind(">") + 1

    def flush():
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                stack[-1].children.append((text, linked[0] >= LINKED * linked[1]))
            run.clear()
            linked[:] = 0, 0

    def write(text):
        run.append(text)
        size = len(text) - text.count(" ")
        linked[1] += size
        if links:
            linked[0] += size

    def pop():
        nonlocal articles
        articles -= stack.pop().tag in REGIONS

    while at < len(page):
        found = TOKEN.search(page, at, end) if at < end else None
        if found is None:
            write(page[at:])
            break
        if found.start() > at:
            write(page[at:found.start()])
        at = found.end()
        if found[1] is None:
            continue
        tag, closing = found[1].lower(), page[found.start() + 1] == "/"
        if tag in RAW:
            if not closing:
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = len(page) if close is None else page.find(">", close.end() - 1) + 1 or len(page)
                run.append(" ")
            continue
        named = tag not in BLOCK
        if named and not closing and tag in INLINE and found[2] and tag not in VOID:
            node = open_node(tag, found[2], articles > 0)
            named = not node.by_name  # an inline advert or notice is a node of its own
        if closing and named:
            named = not any(one.tag == tag for one in stack[-3:])
        if named:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                run.append(" ")
            continue
        flush()
        if closing:
            if beyond:
                beyond -= 1
            elif any(one.tag == tag for one in stack):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        while stack[-1].tag == "p" and tag in BLOCK or stack[-1].tag in CLOSES.get(tag, ()):
            pop()
        if len(stack) > DEPTH:
            beyond += 1
            continue
        node = open_node(tag, found[2], articles > 0)
        stack[-1].children.append(node)
        stack.append(node)
        articles += tag in REGIONS
    flush()
    return root


def holds_region(node: Node) -> bool:
    return any(isinstance(one, Node) and not one.by_tag and (
        one.tag in REGIONS and not one.by_name or holds_region(one)) for one in node.children)


@dataclass
class Page:
    """A page's shape, its slots' texts in order, and which slots are titles."""

    shape: str
    blocks: list  # (slot, text)
    titles: set


def read_page(page: str) -> Page:
    """The parts of a page that may be its article.

    With an <article> or <main> these are its texts; without, all texts beside link lists.
    """
    root = parse(page)
    only_region = holds_region(root)

    def shape(node: Node, inside: bool):
        """(shape, [(template leaf, text, title)]) with leaves numbered inside the shape."""
        inside = inside or node.tag in REGIONS
        shapes, texts, leaves, last, first = [], [], 0, None, 0
        for one in node.children:
            if isinstance(one, Node):
                if one.by_tag or one.by_name and (one.tag in REGIONS or not holds_region(one)):
                    made, own, size = one.label + "!", [], 0
                else:
                    made, own, size = shape(one, inside)
            elif inside or not (only_region or one[1]):
                made, own, size = "#", [(0, one[0], inside and node.tag == "h1")], 1
            else:
                continue
            if not made:
                continue
            if made != last:
                shapes.append(made)
                last, first = made, leaves
                leaves += size
            texts += [(first + leaf, text, title) for leaf, text, title in own]
        return (f"{node.label}({','.join(shapes)})" if shapes else ""), texts, leaves

    made, texts, _ = shape(root, False)
    return Page(made, [(leaf, text) for leaf, text, _ in texts],
                {leaf for leaf, _, title in texts if title})


def fingerprint(text: str) -> int:
    """64 bits of a text, signed."""
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (value >> 63 << 64)


def lead(texts: list) -> int:
    """Which article it is: the least hash of its three-word shingles, alike for near copies."""
    words = " ".join(texts).split()
    if len(words) < 3:
        return fingerprint(" ".join(words))
    return min(fingerprint(" ".join(words[i:i + 3])) for i in range(len(words) - 2))


# --- shapes ----------------------------------------------------------------------

SHAPE = re.compile(r"[(),]|[^(),]+")


def tree(shape: str) -> list:
    """A shape as nested [label, children]; a leaf is "#"."""
    root: list = ["", []]
    stack = [root]
    for part in SHAPE.findall(shape):
        if part == "(":
            stack.append(stack[-1][1][-1] if stack[-1][1] else root)
        elif part == ")":
            stack.pop()
        elif part != ",":
            stack[-1][1].append([part, []])
    return root


def similar(a: list, b: list) -> int:
    """Weight of two nodes' own match: equal labels 2, equal elements 1, else 0."""
    return 2 if a[0] == b[0] else int(a[0].split(".")[0] == b[0].split(".")[0] != "#")


def matching(a: list, b: list, known: dict) -> tuple[int, list]:
    """Simple tree matching: the greatest weight of an order-keeping match, and pairs of children.

    Only nodes whose parents match may match; rows of the table are a's children. Equal first
    and last children match each other, which is never worse, so the table covers the rest.
    """
    key = (id(a), id(b))
    if key in known:
        return known[key]
    own = similar(a, b)
    if not own:
        known[key] = (0, [])
        return known[key]
    head, tail, shorter = 0, 0, min(len(a[1]), len(b[1]))
    while head < shorter and a[1][head] == b[1][head]:
        head += 1
    while tail < shorter - head and a[1][-1 - tail] == b[1][-1 - tail]:
        tail += 1
    ends = [(i, i) for i in range(head)] + [
        (len(a[1]) - i, len(b[1]) - i) for i in range(tail, 0, -1)]
    left, right = a[1][head:len(a[1]) - tail], b[1][head:len(b[1]) - tail]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, one in enumerate(left):
        for j, two in enumerate(right):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j],
                                     best[i][j] + matching(one, two, known)[0])
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i + head, j + head))
    pairs = ends[:head] + pairs[::-1] + ends[head:]
    weight = best[len(left)][len(right)] + sum(
        matching(a[1][i], b[1][j], known)[0] for i, j in ends)
    known[key] = (own + weight, pairs)
    return known[key]


def align(seed: str, shape: str) -> list[str]:
    """The key of each slot of `shape`: that of the seed's node it matches, else a path of its own."""
    first, second = tree(seed), tree(shape)
    known: dict = {}
    keys: list[str] = []

    def walk(a, b, key):
        pairs = {j: i for i, j in matching(a, b, known)[1]} if a is not None else {}
        seen: dict[str, int] = {}
        for j, child in enumerate(b[1]):
            if j in pairs:
                own, partner = f"{key}/{pairs[j]}", a[1][pairs[j]]
            else:
                seen[child[0]] = seen.get(child[0], 0) + 1
                own, partner = f"{key}/{child[0]}~{seen[child[0]]}", None
            if child[0] == "#":
                keys.append(own)
            walk(partner, child, own)

    walk(first, second, "")
    return keys
