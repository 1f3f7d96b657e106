"""HTML extraction by union-free wrappers inferred from pages of the same host.

A page is a stream of tokens: block-level tags (with class, id and role) and
texts; inline tags belong to the text around them, and optional end tags are
filled in. A wrapper is a regular expression without unions over such tokens.
The first page of a host is its first wrapper; each further page is aligned
with it. Where both agree the token stays; where texts differ the text becomes
a slot; where elements of one name differ in class or id, what they have in
common stays; like elements in a row become one repeated group; a token that only one
side has becomes optional. Alignment of two wrappers is the same operation, so
each task folds its pages into one wrapper a host, and wrappers of tasks are
folded again in two steps: all pages count, and a host of a third of all rows
is no more than one small wrapper per task after the first stage.

The wrapper says which part of the template holds the article: the declared
one (article, main, role main; the outer one of nested ones), else the whole
page. Elements that declare themselves menus, headers, footers,
sidebars, notices, adverts, forms or reader comments are left out, by their name,
their role or a class or id that consists of such words alone, unless such a
form, class or id would take most of a page without another article. Outside
a declared article texts that several of the host's pages have in common go as well. A page
is then read through its host's wrapper.

Inline elements that declare themselves adverts or share links are left out of
the text around them. Elements nested deeper than ``DEPTH`` count as part of
their parent, unless they declare themselves an article or out of it.

Defined results: null or empty html gives an empty text; a null url counts as
host ''; a page that its wrapper doesn't match is judged by declarations alone;
repeated rows are read one by one; a page in which its wrapper finds no text, and
which declares no article, is read by itself.
"""

from __future__ import annotations

import bisect
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.textkit import cut, small_batches
from tributary.llm.url_cascade import host_of

#: A text that the host's pages share is template only if so many different pages show it.
SHOWN = 4
#: Hosts whose wrappers a task keeps before it hands them on.
MOST_HOSTS = 2_000
#: Wrappers of more bytes than this are joined to the pages, not broadcast.
MOST_BROADCAST = 32 << 20
#: Tasks' wrappers of a host are folded in so many groups, then those.
SALTS = 32
#: Elements nested deeper than this count as part of their parent.
DEPTH = 128
#: Sequences of more pairs of elements than this are aligned by the order of like elements, not by a longest common subsequence.
MOST_PAIRS = 40_000
#: Labels whose properties a task remembers.
MOST_LABELS = 50_000

#: Names of elements.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("head title nav header footer aside form button select option input textarea noscript iframe svg canvas object dialog menu template video audio map".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table td th tr ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
    "h1": frozenset(["p"]), "h2": frozenset(["p"]), "h3": frozenset(["p"]),
}
#: Words by which classes, ids and roles declare what isn't the article.
DECLARED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar sidebar sidebars aside complementary widget widgets related recommended "
    "header masthead topbar footer foot contentinfo copyright share sharing social comment comments disqus respond reply replies form search newsletter subscribe subscription signup login skip".split()
)
#: Beginnings of such words.
DECLARED_STARTS = ("advert", "breadcrumb", "cookie", "navbar", "newsletter", "paginat", "sidebar", "sponsor", "subscri")
#: Words that may stand beside such words in one class or id; with any other (has-sidebar, related-work) it declares nothing.
BESIDE = frozenset("site page top bottom left right main global primary secondary list lists item items box wrap wrapper container inner outer bar area links posts thread slot unit".split())
#: Words of reader comments, which may well be longer than the article.
READERS = frozenset("comment comments disqus respond reply replies".split())
#: Words by which inline elements declare themselves adverts or share links.
INLINE_OUT = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion popup share sharing social newsletter subscribe subscription signup".split())
ARTICLE = frozenset(["article", "main"])

REMOVED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>", re.DOTALL | re.IGNORECASE)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
ATTRIBUTES = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[^\W\d_]+")
#: Numbers in classes and ids tell pages and elements apart, not their kinds.
NUMBERS = re.compile(r"[\d-]+")


class Node:
    """An element of a page, or a group of a wrapper. label None: a text."""

    __slots__ = ("label", "kids", "text", "chars", "pages", "many", "optional")

    def __init__(self, label: str | None, text: str | None = None, chars: int = 0) -> None:
        self.label, self.text, self.chars = label, text, chars
        self.kids: list[Node] = []
        self.pages, self.many, self.optional = 1, False, False

    def packed(self) -> list:
        return [self.label, self.text, self.chars, self.pages, int(self.many), int(self.optional), [k.packed() for k in self.kids]]

    @staticmethod
    def unpacked(x: list) -> Node:
        node = Node(x[0], x[1], x[2])
        node.pages, node.many, node.optional = x[3], bool(x[4]), bool(x[5])
        node.kids = [Node.unpacked(k) for k in x[6]]
        return node


def label_of(name: str, attributes: str) -> str:
    """``name``, or ``name|role|words`` with the words of class and id; hidden elements are declared as such."""
    if not attributes.strip():
        return name
    role, words = "", []
    for m in ATTRIBUTES.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "role":
            role = value.strip()
        elif kind == "hidden" or kind == "aria-hidden" and value == "true":
            words.append("popup")
        elif kind in ("class", "id"):
            words += [NUMBERS.sub("-", w) for w in value.split()]
    return f"{name}|{role}|{' '.join(sorted(set(words)))}" if role or words else name


def inline_out(attributes: str) -> bool:
    """Whether an inline element declares itself an advert or a share link."""
    if not attributes.strip():
        return False
    _, _, marks = label_of("span", attributes).partition("|")
    role, _, tokens = marks.partition("|")
    return role in INLINE_OUT or any((rest := [w for w in WORDS.findall(x) if w not in BESIDE]) and INLINE_OUT.issuperset(rest) for x in tokens.split())


class Open:
    """An open element: its name, the node that takes what it holds, and whether it or one around it is declared out or an article."""

    __slots__ = ("name", "node", "out", "article")

    def __init__(self, name: str, node: Node, out: bool, article: bool) -> None:
        self.name, self.node, self.out, self.article = name, node, out, article


def parse(html: str) -> Node:
    """Element tree of the block-level tags; texts are decoded, their white space made single."""
    root = Node("")
    stack, parts, opened = [Open("", root, False, False)], [], {}
    depth = 0
    # Inline element that is left out: its name, how many of that name are open, and the elements around it.
    skipped: list | None = None
    html = REMOVED.sub(" ", html)

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                stack[-1].node.kids.append(Node(None, text, len(text)))

    def close(down_to: int) -> None:
        nonlocal depth, skipped
        while len(stack) > down_to:
            gone = stack.pop()
            opened[gone.name] -= 1
            depth -= gone.node is not stack[-1].node
        if skipped and len(stack) < skipped[2]:
            skipped = None

    at = 0
    for m in TAG.finditer(html):
        if m.start() > at and not skipped:
            parts.append(html[at : m.start()])
        at = m.end()
        name = m[2].lower()
        if name in INLINE:
            if skipped:
                if name == skipped[0]:
                    skipped[1] += -1 if m[1] else 1
                    if not skipped[1]:
                        skipped = None
            elif name in ("br", "img"):
                parts.append(" ")
            elif not m[1] and name not in VOID and inline_out(m[3]):
                skipped = [name, 1, len(stack)]
            continue
        flush()
        if m[1]:
            if opened.get(name):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                close(k)
            continue
        while len(stack) > 1 and name in CLOSED_BY.get(stack[-1].name, ()):
            close(len(stack) - 1)
        top, label = stack[-1], label_of(name, m[3])
        _, out, article = known(label)
        if depth < DEPTH or not top.out and (out or article and not top.article):
            node = Node(label)
            top.node.kids.append(node)
        else:
            node = top.node
        if name not in VOID and not m[3].endswith("/"):
            stack.append(Open(name, node, top.out or out, top.article or article))
            opened[name] = opened.get(name, 0) + 1
            depth += node is not top.node
    if not skipped:
        parts.append(html[at:])
    flush()
    return root


def folded(node: Node) -> Node:
    """A page's tree as its first wrapper: like siblings in a row become one repeated group."""
    out = Node(node.label, node.text, node.chars)
    for kid in node.kids:
        own = folded(kid)
        if out.kids and out.kids[-1].label == own.label and own.label is not None:
            last = out.kids[-1]
            merge(last, own)
            last.many, last.pages = True, 1
        else:
            out.kids.append(own)
    return out


def merge(into: Node, other: Node) -> None:
    """Generalises one group so that it describes the other too."""
    into.pages += other.pages
    into.many |= other.many
    into.optional |= other.optional
    into.chars += other.chars
    if into.label is None:
        if into.text != other.text:
            into.text = None
        return
    into.label = general(into.label, other.label)
    mine, theirs = into.kids, other.kids
    if len(mine) == len(theirs) and all(a.label == b.label for a, b in zip(mine, theirs, strict=True)):
        for a, b in zip(mine, theirs, strict=True):
            merge(a, b)
        return
    out: list[Node] = []
    for a, b in aligned(mine, theirs):
        if a is None or b is None:
            one = a or b
            one.optional = True
            out.append(one)
        else:
            merge(a, b)
            out.append(a)
    # Options that came to stand beside a like group are the same repeated group.
    into.kids = []
    for kid in out:
        if into.kids and kid.label is not None and into.kids[-1].label == kid.label:
            pages = max(into.kids[-1].pages, kid.pages)
            merge(into.kids[-1], kid)
            into.kids[-1].many, into.kids[-1].pages = True, pages
        else:
            into.kids.append(kid)


def general(a: str, b: str) -> str:
    """The label of elements of one kind: the words that both have; of those declared out, one of the two."""
    if a == b:
        return a
    _, out, article = known(a)
    if out:
        return min(a, b)
    (name, _, x), (_, _, y) = a.partition("|"), b.partition("|")
    (role, _, words), (other, _, more) = x.partition("|"), y.partition("|")
    role = role if role == other else min(r for r in (role, other) if r in ("main", "article")) if article and name not in ARTICLE else ""
    words = " ".join(sorted({*words.split()} & {*more.split()}))
    return f"{name}|{role}|{words}" if role or words else name


def kind(node: Node) -> tuple | None:
    return None if node.label is None else known(node.label)[0]


def aligned(mine: list[Node], theirs: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Both sequences in order, with like elements side by side: first those of one label, then between them those of one kind."""
    out: list[tuple[Node | None, Node | None]] = []
    i = j = 0
    for a, b in [*common([x.label for x in mine], [x.label for x in theirs]), (len(mine), len(theirs))]:
        left, right = mine[i:a], theirs[j:b]
        u = v = 0
        pairs = common([kind(x) for x in left], [kind(x) for x in right]) if left and right else []
        for c, d in [*pairs, (len(left), len(right))]:
            out += [(x, None) for x in left[u:c]]
            out += [(None, x) for x in right[v:d]]
            if c < len(left) and d < len(right):
                out.append((left[c], right[d]))
            u, v = c + 1, d + 1
        if a < len(mine) and b < len(theirs):
            out.append((mine[a], theirs[b]))
        i, j = a + 1, b + 1
    return out


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a common subsequence: ends first, then a longest one; of long sequences the longest in which the k-th of equal elements meets the k-th."""
    n, m = len(a), len(b)
    lo = 0
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    x, y = a[lo : n - hi], b[lo : m - hi]
    middle = (longest(x, y) if len(x) * len(y) <= MOST_PAIRS else by_occurrence(x, y)) if x and y else []
    return [*((k, k) for k in range(lo)), *((lo + i, lo + j) for i, j in middle), *((n - k, m - k) for k in range(hi, 0, -1))]


def longest(a: list, b: list) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def by_occurrence(a: list, b: list) -> list[tuple[int, int]]:
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    seen: dict = {}
    pairs = []
    for i, x in enumerate(a):
        k = seen[x] = seen.get(x, -1) + 1
        if k < len(places.get(x, ())):
            pairs.append((i, places[x][k]))
    # Longest increasing run of the second places.
    ends, tails, before = [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(ends, j)
        before.append(tails[at - 1] if at else -1)
        if at == len(ends):
            ends.append(j)
            tails.append(k)
        else:
            ends[at], tails[at] = j, k
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


class Wrapper:
    """A host's wrapper and the texts of a few different pages, to tell template from copies."""

    def __init__(self, root: Node, prints: list[int]) -> None:
        self.root, self.prints = root, prints

    @staticmethod
    def of(page: Node) -> Wrapper:
        import zlib

        return Wrapper(folded(page), [zlib.crc32("\n".join(texts_of(page)).encode())])

    def add(self, other: Wrapper) -> None:
        merge(self.root, other.root)
        self.prints = sorted({*self.prints, *other.prints})[:SHOWN]

    def packed(self) -> bytes:
        return json.dumps([self.root.packed(), self.prints], separators=(",", ":")).encode()

    @staticmethod
    def unpacked(data: bytes) -> Wrapper:
        root, prints = json.loads(data)
        return Wrapper(Node.unpacked(root), prints)


def texts_of(node: Node) -> Iterator[str]:
    if node.label is None:
        yield node.text or ""
    for kid in node.kids:
        yield from texts_of(kid)


#: Kinds, and whether they are declared out or articles, of labels that the task has met.
KNOWN: dict[str, tuple[tuple, bool, bool]] = {}


def known(label: str) -> tuple[tuple, bool, bool]:
    """An element's kind (name, declared out, by readers, article), and whether it is declared out or an article."""
    found = KNOWN.get(label)
    if found is None:
        if len(KNOWN) >= MOST_LABELS:
            KNOWN.clear()
        name, _, marks = label.partition("|")
        out, article = says_element_out(label), name in ARTICLE or marks.partition("|")[0] in ("main", "article")
        found = KNOWN[label] = (name, out, out and not READERS.isdisjoint(WORDS.findall(marks)), article), out, article
    return found


def declared_out(label: str) -> bool:
    return known(label)[1]


def is_article(label: str) -> bool:
    return known(label)[2]


def says_element_out(label: str) -> bool:
    """Whether an element says of itself that it isn't the article."""
    name, _, marks = label.partition("|")
    if name in LEFT_OUT:
        return True
    if not marks or name in ("html", "body", *ARTICLE):
        return False
    role, _, words = marks.partition("|")
    if role in ("main", "article"):
        return False
    return role in DECLARED or any(map(says_out, words.split()))


def says_out(token: str) -> bool:
    """Whether a class or id consists of words that declare what isn't the article, and of words that go with them."""
    rest = [w for w in WORDS.findall(token) if w not in BESIDE]
    return bool(rest) and all(w in DECLARED or w.startswith(DECLARED_STARTS) for w in rest)


def shared(text: Node) -> bool:
    """Whether a text is the same on all pages that have it, and these aren't a few."""
    return text.text is not None and not text.optional and text.pages >= SHOWN


def slot_chars(node: Node, template: bool, spared: frozenset[int] | set[int] = frozenset()) -> int:
    """Characters of the texts in a group that aren't template."""
    if node.label is None:
        return 0 if template and shared(node) else node.chars
    return 0 if declared_out(node.label) and id(node) not in spared else sum(slot_chars(k, template, spared) for k in node.kids)


def spare(scope: Node, template: bool) -> set[int]:
    """Groups that declare themselves out by class, id or as a form, but hold more text than all the rest, which has no article."""
    out: list[Node] = []

    def look(node: Node) -> bool:
        """Whether there is an article; what is declared out is put aside."""
        found = False
        for kid in node.kids:
            if kid.label is None:
                continue
            if declared_out(kid.label):
                out.append(kid)
            else:
                found |= is_article(kid.label) and slot_chars(kid, False) > 0 or look(kid)
        return found

    if look(scope):
        return set()
    rest, most, spared = sum(slot_chars(k, template) for k in scope.kids), 0, set()
    for node in out:
        name, _, marks = node.label.partition("|")
        readers = not READERS.isdisjoint(WORDS.findall(marks))
        if name in LEFT_OUT and name != "form" or readers and rest:
            continue
        own = spare(node, template)
        held = sum(slot_chars(k, template, own) for k in node.kids)
        if held > max(rest, most):
            most, spared = held, own | {id(node)}
    return spared


def region(wrapper: Wrapper) -> tuple[list[Node], bool, set[int]]:
    """The groups that hold the article, whether they are declared, and groups to be read although they declare themselves out."""
    template = len(wrapper.prints) >= SHOWN
    declared: list[Node] = []
    spared = spare(wrapper.root, template)

    def look(node: Node) -> None:
        for kid in node.kids:
            if kid.label is None or declared_out(kid.label) and id(kid) not in spared:
                continue
            if is_article(kid.label):
                declared.append(kid)
            else:
                look(kid)

    look(wrapper.root)
    if sum(slot_chars(x, False, spared) for x in declared):
        return declared, True, spared
    return [wrapper.root], False, spared


def read(page: Node, wrapper: Wrapper) -> str:
    """The page's blocks inside the wrapper's article, in order."""
    inside, declared, spared = region(wrapper)
    chosen = {id(x) for x in inside}
    template = len(wrapper.prints) >= SHOWN
    blocks: list[str] = []

    def walk(kids: list[Node], groups: list[Node] | None, taken: bool) -> None:
        for kid, group in matched(kids, groups):
            if kid.label is None:
                common = not declared and template and group is not None and shared(group)
                if taken and not common:
                    blocks.append(kid.text)
            elif not declared_out(kid.label) or id(group) in spared:
                own = taken or (id(group) in chosen if group is not None else is_article(kid.label))
                walk(kid.kids, group.kids if group is not None else None, own)

    walk(page.kids, wrapper.root.kids, id(wrapper.root) in chosen)
    return "\n\n".join(blocks)


def matched(kids: list[Node], groups: list[Node] | None) -> Iterator[tuple[Node, Node | None]]:
    """Each element of a page with the wrapper's group that describes it."""
    if not groups:
        yield from ((k, None) for k in kids)
        return
    runs: list[list[Node]] = []
    for kid in kids:
        if runs and kid.label is not None and runs[-1][0].label == kid.label:
            runs[-1].append(kid)
        else:
            runs.append([kid])
    if len(runs) == len(groups) and all(r[0].label == g.label for r, g in zip(runs, groups, strict=True)):
        pairs: list[tuple[list[Node] | None, Node | None]] = list(zip(runs, groups, strict=True))
    else:
        heads = [r[0] for r in runs]
        by_head = {id(r[0]): r for r in runs}
        pairs = [(by_head[id(b)], a) for a, b in aligned(groups, heads) if b is not None]
    for run, group in pairs:
        for kid in run:
            yield kid, group


def fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, salt, wrapper) from (host, html): the task's wrapper of each host."""
    held: dict[str, Wrapper] = {}
    salt = 0
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = Wrapper.of(parse(page or ""))
            salt = (salt * 31 + own.prints[0]) % SALTS
            if host in held:
                held[host].add(own)
            else:
                if len(held) >= MOST_HOSTS:
                    yield handed_on(held, salt)
                    held = {}
                held[host] = own
    if held:
        yield handed_on(held, salt)


def handed_on(held: dict[str, Wrapper], salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([salt] * len(held), pa.int32()), pa.array([w.packed() for w in held.values()], pa.binary())], names=["host", "salt", "wrapper"])


def fold_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal hosts."""
    current, wrapper = None, None
    for batch in batches:
        for host, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = Wrapper.unpacked(data)
            if wrapper is not None and host == current:
                wrapper.add(own)
                continue
            if wrapper is not None:
                yield handed_on({current: wrapper}, 0)
            current, wrapper = host, own
    if wrapper is not None:
        yield handed_on({current: wrapper}, 0)


WRAPPERS = "host string, salt int, wrapper binary"


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of all pages (host, html)."""
    parts = small_batches(pages.select("host", "html")).mapInArrow(fold_pages, WRAPPERS)
    halves = small_batches(parts.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper")).mapInArrow(fold_wrappers, WRAPPERS)
    return small_batches(halves.repartition("host").sortWithinPartitions("host", "wrapper")).mapInArrow(fold_wrappers, WRAPPERS).select("host", "wrapper")


TEXTS = "page_id long, url string, text string, n_chars long"


def has_article(node: Node) -> bool:
    return any(k.label is not None and not declared_out(k.label) and (is_article(k.label) or has_article(k)) for k in node.kids)


def text_of(html: str | None, wrapper: Wrapper | None) -> str:
    """A page's article; by the page alone if its host's wrapper finds none and the page declares none."""
    tree = parse(html or "")
    text = read(tree, wrapper) if wrapper else ""
    return text or ("" if wrapper and has_article(tree) else read(tree, Wrapper.of(tree)))


def texts(rows: Iterator[tuple[pa.RecordBatch, list[Wrapper | None]]]) -> Iterator[pa.RecordBatch]:
    for batch, wrappers in rows:
        out = [text_of(page, wrapper) for page, wrapper in zip(batch.column(3).to_pylist(), wrappers, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page with the text of its article."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    wrappers = cut(infer(rows), pages.count())
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= MOST_BROADCAST:
        held = {r["host"]: bytes(r["wrapper"]) for r in wrappers.collect()}

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_: dict[str, Wrapper] = {}

            def of(host: str) -> Wrapper | None:
                if host not in open_ and host in held:
                    open_[host] = Wrapper.unpacked(held[host])
                return open_.get(host)

            yield from texts((b, [of(h) for h in b.column(2).to_pylist()]) for b in batches)

        return small_batches(rows).mapInArrow(known, TEXTS)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[bytes, Wrapper] = {}

        def of(data: bytes | None) -> Wrapper | None:
            if data is not None and data not in last:
                last.clear()
                last[data] = Wrapper.unpacked(data)
            return last.get(data)

        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                yield from texts(iter([(one, [of(one.column(4)[0].as_py())])]))

    met = rows.join(wrappers.select(F.col("host").alias("_host"), "wrapper"), F.col("host") == F.col("_host"), "left")
    return small_batches(met.select("page_id", "url", "host", "html", "wrapper")).mapInArrow(joined, TEXTS)
