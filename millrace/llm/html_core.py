"""Parsing of one page into blocks and a folded tree, and simple tree matching; no Spark here."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: Fixed values of HTML: tags that break text into blocks, that have no end, whose content is no markup, and of forms.
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary center fieldset nav header footer aside form dialog menu hgroup search hr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw text up to the end tag; of the first four also where there is none.
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
_TO_THE_END = frozenset("script style textarea title".split())
#: Elements whose content is not text of the page. A block ends some of them, as it may not stand in them.
DROPPED = frozenset("template object audio video canvas button svg select annotation".split())
_BROKEN_BY_BLOCKS = frozenset("svg select annotation".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
MAIN = frozenset(("article", "main"))
ASIDE = frozenset("nav footer aside form dialog menu head fieldset search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that name what is not the article.
ROLE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|sidebar|widgets?|nav|navbar|navigation|breadcrumbs?|sharing|comments?|disqus|replies|footer|masthead|toolbar|pagination|pager|login|signup|contentinfo|complementary|taboola|outbrain|topbar)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Words that articles use for parts of their own too. They name something else outside of an article, as a
#: class or role; inside of one they do so only where what stands there agrees.
WEAK_WORDS = re.compile(
    r"(?:^|[\s_-])(?:notices?|alert|menu|share|social|related|recommend\w*|respond|search|skip|toc|hidden|discussion|reactions|notifications?|infobar|disclaimer)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Share of a weakly named part's characters that are in links, or in parts named as something else, from which it is none.
_AGREES = 0.5
#: Weakly named elements around a block that are looked at, from the inside.
_NESTED = 8
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+)(>?)")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
#: Class names such as has-sidebar say what stands beside an element.
_BESIDE = re.compile(r"(?<!\S)(?:has|with|no|without|is)-\S+", re.IGNORECASE)
_NAMED = re.compile(r"\b(?:class|id|role|hidden|style|aria-hidden)\b", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z]+")


@dataclass
class Page:
    """A folded tree, where siblings with one label are one node, and the blocks of text in page order.

    ``label`` and ``parent`` are by node; ``side`` tells whether a node or one above it is named as something else than
    the article, ``main`` whether it lies in an article or main element. A block is (node, text, characters in links).
    """

    label: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    side: list[bool] = field(default_factory=lambda: [False])
    main: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def judge_weak(self, within: list[tuple[int, ...]]) -> None:
        """Drops the blocks of weakly named elements in which links, or parts named as something else, are the most.

        ``within`` has the numbers of such elements around each block.
        """
        sums: dict[int, list[int]] = {}
        for (node, text, linked), around in zip(self.blocks, within, strict=True):
            for k in around:
                mine = sums.setdefault(k, [0, 0])
                mine[0] += len(text)
                mine[1] += len(text) if self.side[node] else min(linked, len(text))
        gone = {k for k, (all_, other) in sums.items() if other >= _AGREES * all_}
        self.blocks = [b for b, around in zip(self.blocks, within, strict=True) if gone.isdisjoint(around)]

    def skeleton(self) -> str:
        return "\n".join(f"{p} {name}" for p, name in zip(self.parent, self.label, strict=True))


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


class _Stack:
    """Open elements as (name, node), and how many there are of each name."""

    def __init__(self) -> None:
        self.items: list[tuple[str, int]] = [("", 0)]
        self.count: dict[str, int] = {}
        self.dropped = 0  # place of the outermost element whose content is dropped, or 0

    def push(self, name: str, node: int) -> None:
        self.items.append((name, node))
        self.count[name] = self.count.get(name, 0) + 1

    def cut(self, i: int) -> None:
        for name, _ in self.items[i:]:
            self.count[name] -= 1
        del self.items[i:]
        if i <= self.dropped:
            self.dropped = 0

    def find(self, names: tuple[str, ...], stops: tuple[str, ...] = ()) -> int:
        """The innermost open element of these names that no stop lies above, or 0."""
        if any(self.count.get(n) for n in names):
            for i in range(len(self.items) - 1, self.dropped, -1):
                if self.items[i][0] in names:
                    return i
                if self.items[i][0] in stops:
                    return 0
        return 0


def parse(html: str) -> Page:
    """The page's blocks. Unclosed and misplaced tags are closed as browsers do for paragraphs, lists and tables.

    Takes time in proportion to the page, however deep, long or broken it is. A quote that is never closed ends at the
    next ">"; a tag without an end is text.
    """
    page = Page()
    child: dict[tuple[int, str], int] = {}
    stack = _Stack()
    text: list[str] = []
    linked, in_link = 0, False
    unclosed: set[str] = set()
    weak_at: list[tuple[int, int]] = []  # of open elements in an article that only a weak word names: place and number
    within: list[tuple[int, ...]] = []
    named = 0

    def flush() -> None:
        nonlocal linked
        while weak_at and weak_at[-1][0] >= len(stack.items):
            weak_at.pop()
        if text:
            block = " ".join(unescape("".join(text)).split())
            if block:
                within.append(tuple(k for _, k in weak_at[-_NESTED:]))
                page.blocks.append((stack.items[-1][1], block, linked))
            text.clear()
        linked = 0

    def close(i: int) -> None:
        if i:
            stack.cut(i)

    at, end = 0, len(html)
    while at < end:
        m_at = html.find("<", at)
        begin = end if m_at < 0 else m_at
        tag = None
        if begin < end:
            if html.startswith("<!--", begin):
                stop = html.find("-->", begin + 4)
                stop = end if stop < 0 else stop + 3
            elif html.startswith(("<!", "<?"), begin):
                stop = html.find(">", begin)
                stop = end if stop < 0 else stop + 1
            elif (tag := _TAG.match(html, begin)) is None:
                begin, stop = begin + 1, begin + 1
            else:
                stop = tag.end()
                if not tag[4]:
                    found = html.find(">", stop) if stop < end else -1
                    if found < 0:
                        tag, begin, stop = None, end, end
                    else:
                        stop = found + 1
        else:
            stop = end
        if begin > at and not stack.dropped:
            piece = html[at:begin]
            text.append(piece)
            if in_link:
                linked += len(piece)
        at = stop
        if tag is None:
            continue
        name = tag[2].lower()
        if tag[1]:
            if name == "a":
                in_link = False
            elif name in BLOCK or name == "head":
                dropped = stack.dropped
                i = stack.find((name,))
                if not i and dropped and stack.count.get(name):  # the end of what the dropped element stands in
                    stack.dropped = 0
                    if i := stack.find((name,)):
                        if i > dropped:
                            i = 0
                    if not i:
                        stack.dropped = dropped
                if i:
                    if i < dropped or not dropped:
                        flush()
                    stack.cut(i)
            elif name in DROPPED and stack.dropped:
                dropped, stack.dropped = stack.dropped, stack.dropped - 1
                i = stack.find((name,))
                stack.dropped = dropped
                if i:
                    stack.cut(i)
            continue
        if name in RAW:
            if not tag[3].rstrip().endswith("/") and name not in unclosed:
                found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?", re.IGNORECASE).search(html, at)
                if found:
                    at = found.end()
                elif name in _TO_THE_END:
                    at = end
                else:
                    unclosed.add(name)
            if not stack.dropped:
                text.append(" ")
            continue
        if name in DROPPED:
            if not tag[3].rstrip().endswith("/"):
                if not stack.dropped:
                    text.append(" ")
                stack.push(name, -1)
                stack.dropped = stack.dropped or len(stack.items) - 1
            continue
        if name == "a":
            in_link = True
            continue
        if name == "br" and not stack.dropped:
            text.append(" ")
            continue
        if name not in BLOCK and name != "head":
            continue
        if stack.dropped and stack.items[stack.dropped][0] in _BROKEN_BY_BLOCKS:
            stack.cut(stack.dropped)
        if stack.dropped:
            if name not in VOID:
                stack.push(name, -1)
            continue
        flush()
        if name in VOID:
            continue
        close(stack.find(("p",), ("table", "td", "th", "article", "section", "div", "body")))
        if name in CLOSES:
            names, stops = CLOSES[name]
            for _ in range(2):
                close(stack.find(tuple(names.split()), stops))
        if name == "body":
            close(stack.find(("head",)))
        up = stack.items[-1][1]
        label, raw, aside, weak = name, tag[3], name in ASIDE, False
        if raw and _NAMED.search(raw):
            a = _attributes(raw)
            called = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}"
            words = _WORD.findall(called)
            label = ".".join([name, *words[:2]])
            # the article itself may be called anything; one inside of it may be a comment. A heading is what it says
            if name not in ("html", "body") and name not in HEADINGS and (name not in MAIN or page.main[up]):
                aside |= ROLE_WORDS.search(_BESIDE.sub(" ", called)) is not None
                weak = WEAK_WORDS.search(_BESIDE.sub(" ", f"{a.get('class', '')} {a.get('role', '')}")) is not None
                aside |= weak and not page.main[up]
            aside |= "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
        node = child.get((up, label))
        if node is None:
            node = child[up, label] = len(page.label)
            page.label.append(label)
            page.parent.append(up)
            page.main.append(page.main[up] or name in MAIN)
            page.side.append(page.side[up] or aside or name == "header" and not page.main[up])
        while weak_at and weak_at[-1][0] >= len(stack.items):
            weak_at.pop()
        if weak and not page.side[node]:
            named += 1
            weak_at.append((len(stack.items), named))
        stack.push(name, node)
    flush()
    if named:
        page.judge_weak(within)
    return page


def _tree(skeleton: str) -> tuple[list[str], list[list[int]]]:
    labels, children = [], []
    for i, line in enumerate(skeleton.split("\n")):
        parent, _, label = line.partition(" ")
        labels.append(label)
        children.append([])
        if i:
            children[int(parent)].append(i)
    return labels, children


def _heaviest(pairs: list[tuple[int, int]]) -> list[int]:
    """Of pairs (place, weight), in order of another place, those of the heaviest chain of rising places."""
    top = max((p for p, _ in pairs), default=-1) + 2
    best: list[tuple[int, int]] = [(0, -1)] * (top + 1)  # by place, as a tree of prefixes: weight of the best chain, its last pair
    before = []
    for i, (place, weight) in enumerate(pairs):
        found, k = (0, -1), place
        while k > 0:
            found = max(found, best[k])
            k -= k & -k
        before.append(found[1])
        mine, k = (found[0] + weight, i), place + 1
        while k <= top:
            if mine > best[k]:
                best[k] = mine
            k += k & -k
    found, k = (0, -1), top
    while k > 0:
        found = max(found, best[k])
        k -= k & -k
    chain, i = [], found[1]
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def align(page: str, model: str) -> list[int]:
    """Simple tree matching of two skeletons: for each node of the page its node of the model, or -1.

    Two trees with equal root labels match with one more than the best order-keeping matching of their children. As a
    node's children have different labels, that is the heaviest chain of children with common labels, in both orders.
    Pairs are handled from the leaves up, without recursion.
    """
    (la, ca), (lb, cb) = _tree(page), _tree(model)
    if la[0] != lb[0]:
        return [-1] * len(la)
    todo: list[tuple[int, int]] = [(0, 0)]
    common: list[list[tuple[int, int, int]]] = []  # by pair: the pairs below, with the child's place in the model
    for a, b in todo:
        place = {lb[q]: (k, q) for k, q in enumerate(cb[b])}
        below = []
        for p in ca[a]:
            if la[p] in place:
                k, q = place[la[p]]
                below.append((len(todo), k))
                todo.append((p, q))
        common.append(below)
    weight, chosen = [1] * len(todo), [()] * len(todo)
    for n in range(len(todo) - 1, -1, -1):
        if common[n]:
            chain = _heaviest([(k, weight[m]) for m, k in common[n]])
            chosen[n] = [common[n][i][0] for i in chain]
            weight[n] += sum(weight[m] for m in chosen[n])
    out, left = [-1] * len(la), [0]
    while left:
        n = left.pop()
        out[todo[n][0]] = todo[n][1]
        left.extend(chosen[n])
    return out
