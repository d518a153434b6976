"""Main-text extraction by union-free wrappers.

A page is a stream of tags and texts. Repeats in a page are folded into
repeated groups and texts into slots, which gives a union-free regular
expression of the page. The expressions of one host are aligned one after the
other: equal parts stay, what only one side has becomes optional, what comes
several times becomes a repeated group. The result is the host's wrapper. Every
page is matched against it, which gives the wrapper's slot of each of its texts;
a slot is a place in the wrapper, so two under one path stay apart. What the
slots hold over the host's different pages (always the same, or varying; links)
and where they are (in the element with most of the running text; in a repeated
group of records) tells article from surroundings, see ``article_slots``. HTML's
own elements (article, nav and the like) count as well; English class names only
leave texts out, and neither on the way to the host's running text nor where a
page would have no text without them. Copies of a page are one page here.

Pages are reduced to counts by (host, expression) where they are read, and
alignment first folds salted parts of a host, so a host with a third of all
pages stays small everywhere. The html itself is never shuffled while the
wrappers are within a checked size, and salted beyond it.

An expression is at most ``DEPTH`` elements deep: what lies deeper is read as part
of the element at that depth. It has at most ``WIDE`` parts side by side: beyond that,
parts of one label are one repeated group, then those of one element, then all. No text is lost by either.

Definitions for odd rows. Null or empty html, and a page without an article
slot's text, gives an empty text. A null url belongs to the host ''. Every row
gives one result row. Unclosed tags end with what holds them.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_SPACES = re.compile(r"\s+")
#: Signs of written expressions and paths, which names of elements go without.
_SIGNS = re.compile(r"[()#,?+*/.]")

#: Fixed values of HTML: elements that do not break a block, that have no content, and that end an open paragraph.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements, and words of class, id and role, that hold no article text.
OUTSIDE = frozenset("head nav footer aside form button dialog menu title fieldset".split())
OUTSIDE_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus dialog feedback footer header login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted recommended related replies reply respond search share sharing shares sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Beginnings of names that tell of a page's layout, such as has-sidebar, and not of what the element holds.
_LAYOUT = re.compile(r"(?:has|no|with|without)[-_]", re.IGNORECASE)
ARTICLE = frozenset("article main".split())
#: Within an article a name counts only if all of its words are of the list above or of these (as in ad-box), and
#: header never; of elements that are a block of text, only the last ones count.
PARTS = frozenset("area bar block body box button buttons card container content element entry group holder inner item items link links list outer panel post posts section text widget wrap wrapper".split())
TEXTUAL = frozenset("blockquote figcaption h1 h2 h3 h4 h5 h6 p pre".split())
NEVER_TEXT = frozenset("ad ads advert advertisement adverts advertising breadcrumb breadcrumbs comment comments cookie cookies newsletter sponsor sponsored".split())
#: Limits of an expression's shape.
DEPTH, WIDE = 100, 48


class Page:
    """Blocks of a page: (text, words, words in links), in order, its expression, and the expression's slot of each block."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int]] = []
        root: list = ["", []]
        stack = [root]
        opened: Counter = Counter()  # elements on the stack by name
        held: list[str] = []
        links = [0, 0]  # open links, words in links so far

        def flush() -> None:
            if held:
                text = _SPACES.sub(" ", "".join(held)).strip()
                held.clear()
                if text:
                    n = text.count(" ") + 1
                    siblings = stack[-1][1]
                    if not siblings or siblings[-1][0] != "#":
                        siblings.append(["#", []])
                    siblings[-1][1].append(len(self.blocks))
                    self.blocks.append((text, n, min(n, links[1])))
            links[1] = 0

        def close(to: int) -> None:
            flush()
            opened.subtract(x[2] for x in stack[to:])
            del stack[to:]

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()], held, links)
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if name in INLINE:
                if name == "a":
                    links[0] = 0 if m[2] else 1
                continue
            if name == "br":
                held.append(" ")
                continue
            if m[2]:
                name = _SIGNS.sub("", name)
                if opened[name] > 0:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][2] == name))
                else:
                    flush()
                continue
            flush()
            if name in VOID:
                continue
            if name in ENDS_P and len(stack) > 1 and stack[-1][2] == "p":
                close(len(stack) - 1)
            if name in CLOSES:
                while len(stack) > 1 and stack[-1][2] in CLOSES[name]:
                    close(len(stack) - 1)
            names = [x for g in _NAMES.findall(m[4] or "") for x in "".join(g).split() if not _LAYOUT.match(x)]
            marks = sorted({"-".join(re.findall("[a-z]+", x.lower())) for x in names} - {""})
            name = _SIGNS.sub("", name)
            opened[name] += 1
            if len(stack) > DEPTH:  # its content goes on in the element above
                stack.append([name, stack[-1][1], name])
                continue
            node: list = [".".join([name, *marks]), [], name]
            stack[-1][1].append(node)
            stack.append(node)
        if at < len(source):
            self._text(source[at:], held, links)
        flush()
        self.expression, leaves = fold(root[1])
        self.slot = [0] * len(self.blocks)
        for i, blocks in leaves:
            for b in blocks:
                self.slot[b] = i

    @staticmethod
    def _text(raw: str, held: list[str], links: list[int]) -> None:
        text = htmllib.unescape(raw) if "&" in raw else raw
        held.append(text)
        if links[0]:
            links[1] += len(text.split())


# An expression is a tuple of parts; a part is (label or '#', mark, inner expression), its mark '', '?', '+' or '*'.


Leaves = list[tuple[int, list[int]]]


def fold(children: list) -> tuple[tuple, Leaves]:
    """The expression of a node's children, adjacent parts of one label being one repeated group, and (slot, blocks) of its texts."""
    out: list[tuple] = []
    held: list[list[tuple[tuple, Leaves]]] = []  # of each part, the expressions and texts it was made of
    for c in children:
        inner, leaves = ((), [(0, c[1])]) if c[0] == "#" else fold(c[1])
        if out and out[-1][0] == c[0]:
            out[-1] = (c[0], "+", align(out[-1][2], inner))
            held[-1].append((inner, leaves))
        else:
            out.append((c[0], "", inner))
            held.append([(inner, leaves)])
    # a group of two labels that alternates
    i = 0
    while i + 3 < len(out):
        a, b = out[i], out[i + 1]
        if (a[0], b[0]) == (out[i + 2][0], out[i + 3][0]):
            out[i : i + 4] = [(a[0], "+", align(a[2], out[i + 2][2])), (b[0], "+", align(b[2], out[i + 3][2]))]
            held[i : i + 4] = [held[i] + held[i + 2], held[i + 1] + held[i + 3]]
        else:
            i += 1
    groups = narrow([x[0] for x in out])
    if groups is not None:
        held = [[x for i in own for x in held[i]] for _, own in groups]
        out = [merged(label, [out[i] for i in own]) for label, own in groups]
    texts: Leaves = []
    at = 0
    for (label, _, whole), parts in zip(out, held, strict=True):
        places: dict[tuple, list[int]] = {}
        for inner, leaves in parts:
            if label == "#" or inner == whole:
                texts += [(at + k, blocks) for k, blocks in leaves]
            else:
                if inner not in places:
                    places[inner] = placed(inner, whole)
                texts += [(at + places[inner][k], blocks) for k, blocks in leaves]
        at += 1 if label == "#" else count(whole)
    return tuple(out), texts


def bare(label: str) -> str:
    """A label without its names."""
    return label.partition(".")[0]


def narrow(labels: list[str]) -> list[tuple[str, list[int]]] | None:
    """Groups (label, places) of parts side by side that are too many: by label, else by element, else all but texts; None for few parts."""
    if len(labels) <= WIDE:
        return None
    for general in (str, bare, lambda x: x if x == "#" else "any"):
        groups: dict[str, list[int]] = {}
        for i, x in enumerate(labels):
            groups.setdefault(general(x), []).append(i)
        if len(groups) <= WIDE:
            break
    return list(groups.items())


def merged(label: str, parts: list[tuple]) -> tuple:
    """One part for several."""
    inner = parts[0][2]
    for x in parts[1:]:
        inner = align(inner, x[2])
    optional = all(x[1] in ("?", "*") for x in parts)
    return label, _mark(optional, len(parts) > 1 or parts[0][1] in ("+", "*")), inner


_MARKS = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}


def _mark(optional: bool, repeated: bool) -> str:
    return _MARKS[optional, repeated]


def align(x: tuple, y: tuple) -> tuple:
    """The union-free expression of both: a longest common subsequence of labels, the rest optional."""
    if x == y:
        return x
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    out: list[tuple] = []

    def add(part: tuple) -> None:
        if out and out[-1][0] == part[0]:
            last = out[-1]
            optional = last[1] in ("?", "*") and part[1] in ("?", "*")
            out[-1] = (last[0], _mark(optional, True), align(last[2], part[2]))
        else:
            out.append(part)

    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[i][0] == y[j][0]:
            a, b = x[i], y[j]
            marks = a[1] + b[1]
            add((a[0], _mark("?" in marks or "*" in marks, "+" in marks or "*" in marks), align(a[2], b[2])))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            add((x[i][0], "*" if x[i][1] in ("+", "*") else "?", x[i][2]))
            i += 1
        else:
            add((y[j][0], "*" if y[j][1] in ("+", "*") else "?", y[j][2]))
            j += 1
    groups = narrow([x[0] for x in out])
    return tuple(out if groups is None else [merged(label, [out[i] for i in own]) for label, own in groups])


def fits(label: str, whole: str) -> bool:
    """Whether a part of a page's expression can be one of the wrapper's, which may have lost its names."""
    return label == whole or whole == bare(label) or (whole == "any" and label != "#")


def written(e: tuple) -> str:
    """An expression as text; labels hold letters, digits, dots and the like, never the signs used here."""
    return "".join(f"{a}({written(i)}){m}," if a != "#" else f"#{m}," for a, m, i in e)


def read(s: str) -> tuple:
    def parts(at: int) -> tuple[tuple, int]:
        out = []
        while at < len(s) and s[at] != ")":
            if s[at] == "#":
                label, inner, at = "#", (), at + 1
            else:
                to = s.index("(", at)
                label = s[at:to]
                inner, at = parts(to + 1)
                at += 1
            mark = ""
            if s[at] != ",":
                mark, at = s[at], at + 1
            out.append((label, mark, inner))
            at += 1
        return tuple(out), at

    return parts(0)[0]


def count(e: tuple) -> int:
    """Number of an expression's slots; they are numbered in the order they are written."""
    return sum(1 if label == "#" else count(inner) for label, _, inner in e)


def slots(e: tuple, path: str = "", listed: bool = False) -> Iterator[tuple[str, bool]]:
    """(path, listed) of an expression's slots; listed ones lie in a repeated group of records, which have elements of their own."""
    for label, mark, inner in e:
        if label == "#":
            yield path, listed
        else:
            records = mark in ("+", "*") and any(x[0] != "#" for x in inner)
            yield from slots(inner, f"{path}/{label}", listed or records)


def matched(e: tuple, w: tuple) -> list[int]:
    """The slot of the wrapper w that each slot of e, an expression of fewer pages, falls in; -1 for none.

    As many parts of e as can be are matched in order, a repeated part of w with
    several, with as few parts left out that w always has. A part that comes
    out of order falls in the last part of its label.
    """
    if e == w:
        return list(range(count(e)))
    n, m = len(e), len(w)
    if [x[0] for x in e] == [x[0] for x in w]:
        to = list(range(n))
    else:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for j in range(m - 1, -1, -1):
            best[n][j] = best[n][j + 1] - (w[j][1] in ("", "+"))
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                found = max(best[i + 1][j], best[i][j + 1] - (w[j][1] in ("", "+")))
                if fits(e[i][0], w[j][0]):
                    found = max(found, 1000 + best[i + 1][j + 1])
                    if w[j][1] in ("+", "*"):
                        found = max(found, 1000 + best[i + 1][j])
                best[i][j] = found
        to = [-1] * n
        i = j = 0
        while i < n and j < m:
            if fits(e[i][0], w[j][0]) and best[i][j] == 1000 + best[i + 1][j + 1]:
                to[i] = j
                i, j = i + 1, j + 1
            elif fits(e[i][0], w[j][0]) and w[j][1] in ("+", "*") and best[i][j] == 1000 + best[i + 1][j]:
                to[i] = j
                i += 1
            elif best[i][j] == best[i][j + 1] - (w[j][1] in ("", "+")):
                j += 1
            else:
                i += 1
        last = {x[0]: j for j, x in enumerate(w)}
        to = [next((last[y] for y in (x[0], bare(x[0]), "any") if y in last), -1) if j < 0 else j for x, j in zip(e, to, strict=True)]
    at = [0]
    for label, _, inner in w:
        at.append(at[-1] + (1 if label == "#" else count(inner)))
    out: list[int] = []
    for (label, _, inner), j in zip(e, to, strict=True):
        if label == "#":
            out.append(at[j] if j >= 0 else -1)
        else:
            out += [at[j] + x if x >= 0 else -1 for x in matched(inner, w[j][2])] if j >= 0 else [-1] * count(inner)
    return out


def placed(e: tuple, w: tuple) -> list[int]:
    """As ``matched``; a slot without a match falls in the first one of its path, or, where the wrapper has lost its names, in the first."""
    to = matched(e, w)
    if -1 in to:
        first: dict[str, int] = {}
        for i, (path, _) in enumerate(slots(w)):
            first.setdefault(path, i)
        to = [first.get(path, 0) if i < 0 else i for i, (path, _) in zip(to, slots(e), strict=True)]
    return to


def named(label: str, inside: bool) -> bool:
    """Whether an element's names tell that it holds no article text; ``inside`` an article they must tell of nothing else."""
    element, *names = label.split(".")
    for name in names:
        words = name.split("-")
        told = OUTSIDE_NAMES.intersection(words)
        if not inside:
            if told:
                return True
        elif told - {"header"} and all(w in OUTSIDE_NAMES or w in PARTS for w in words) and (element not in TEXTUAL or told & NEVER_TEXT):
            return True
    return False


def outside(path: str, articles: bool, known: int = 0) -> bool:
    """Whether an element on the path holds no article text. An article within an article is judged by its names, as comments are.

    The names of the first ``known`` elements, which lead to the host's text, don't count.
    """
    inside = False
    for depth, label in enumerate(path.split("/")[1:]):
        name = bare(label)
        whole = name in ("html", "body", "main") or name == "article" and not inside or depth < known
        if name in OUTSIDE or name == "header" and not inside or not whole and named(label, inside):
            return True
        inside = inside or name in ARTICLE or not ARTICLE.isdisjoint(re.split("[.-]", label)[1:])
    return articles and not inside


def article_slots(wrapper: tuple, seen: dict[int, tuple[int, int, int, bool]]) -> tuple[list[int], list[int], list[int]]:
    """The wrapper's slots with article text; seen has (different pages, up to 3; words; words in links; whether always the same text) by slot.

    The wrapper tells where the host's running text is: in varying slots that
    are not mostly links and not in lists of records, and from the root down in
    the element with most of their words, whatever its names. Names and lists
    tell what is left out below. First the slots inside article elements; then,
    for pages without text there, other varying ones; then, for pages without
    either, those that only names leave out.
    """
    every = list(slots(wrapper))
    none = (0, 0, 0, False)

    def varies(i: int) -> bool:
        pages, words, linked, same = seen.get(i, none)
        return 2 * linked <= words and not (same and pages >= 3)

    def shown(i: int) -> bool:
        """Whether enough different pages show that the slot varies, so that names need not be asked."""
        pages, words, _, same = seen.get(i, none)
        return words > 0 and varies(i) and pages >= 3 and not same

    elements = [outside(path, False, path.count("/")) for path, _ in every]
    weight = [seen.get(i, none)[1] if varies(i) and not elements[i] and not listed and (shown(i) or not outside(path, False)) else 0 for i, (path, listed) in enumerate(every)]
    records = [seen.get(i, none)[1] if varies(i) and not elements[i] and listed else 0 for i, (_, listed) in enumerate(every)]
    minor = sum(records) < sum(weight)
    known = [0] * len(every)  # elements above the slot that lead to the running text
    node, at, to = wrapper, 0, len(every)
    while True:
        most, first = None, at
        for label, _, inner in node:
            n = 1 if label == "#" else count(inner)
            own, total = sum(weight[first : first + n]), sum(weight[at:to])
            named = outside(f"/{label}", False) and not outside(f"/{label}", False, 1)
            if any(x[0] != "#" for x in inner) and (10 * own > 9 * total if named else 2 * own > total):
                most = (inner, first, first + n)
            first += n
        if most is None:
            break
        node, at, to = most
        known[at:to] = [k + 1 for k in known[at:to]]
    marked, others, rest = [], [], []
    for i, (path, listed) in enumerate(every):
        if not outside(path, True, known[i]):
            marked.append(i)
        elif not varies(i) or elements[i] or (listed and minor and not at <= i < to):
            continue
        elif not outside(path, False, known[i]):
            others.append(i)
        elif shown(i) and not listed:
            rest.append(i)
    return marked, others, rest


def host_of(url: str | None) -> str:
    if not url or "://" not in url:
        return ""
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower()


_REDUCED = "host string, expression string, prints array<long>, counts array<long>"
_SEEN = "host string, slot int, prints array<long>, words long, linked long, low long, high long"
_CHOSEN = "host string, wrapper string, paths array<int>, others array<int>, rest array<int>"
#: Different pages of a slot that are told apart: what is the same on this many is not text of a page.
_DIFFERENT = 3


def _print(page: Page) -> int:
    """64 bits of a page's content."""
    h = blake2b(written(page.expression).encode(), digest_size=8)
    for text, _, _ in page.blocks:
        h.update(b"\0" + text.encode("utf-8", "surrogatepass"))
    return int.from_bytes(h.digest(), "little", signed=True)


def _least(a: list[int], b) -> list[int]:
    return sorted({*a, *b})[:_DIFFERENT]


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, expression): the least values of its different pages, and (words, words in links, least and greatest value of the text) of each slot."""
    held: dict[tuple[str, str], tuple[list[int], list[int]]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        hosts, forms = zip(*held, strict=True)
        prints, counts = zip(*held.values(), strict=True)
        held.clear()
        kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((hosts, forms, prints, counts), kinds, strict=True)], names=["host", "expression", "prints", "counts"])

    for batch in batches:
        for url, source in zip(batch.column(0), batch.column(1), strict=True):
            page = Page(source.as_py() or "")
            own = [[0, 0, 0] for _ in range(count(page.expression))]
            for i, (text, n, linked) in zip(page.slot, page.blocks, strict=True):
                x = own[i]
                x[0], x[1], x[2] = x[0] + n, x[1] + linked, crc32(text.encode("utf-8", "surrogatepass"), x[2])
            k = (host_of(url.as_py()), written(page.expression))
            x = held.get(k)
            if x is None:
                held[k] = [_print(page)], [v for n, linked, same in own for v in (n, linked, same, same)]
                size += len(own) + 1
            else:
                x[0][:] = _least(x[0], [_print(page)])
                for i, (n, linked, same) in enumerate(own):
                    c = x[1]
                    c[4 * i : 4 * i + 4] = [c[4 * i] + n, c[4 * i + 1] + linked, min(c[4 * i + 2], same), max(c[4 * i + 3], same)]
        if size > 20_000:
            yield out()
            size = 0
    if held:
        yield out()


def _gather(wrapper_of):
    """Rows of _REDUCED, with the wrapper as a further column where there is no shared one, to counts of the wrappers' slots, added up in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def out() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            kinds = [pa.string(), pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "slot", "prints", "words", "linked", "low", "high"])

        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for host, expression, prints, counts, *wrapper in rows:
                to = _slots_of(expression, wrapper[0] if wrapper else wrapper_of.value[host])
                for i, slot in enumerate(to):
                    n, linked, low, high = counts[4 * i : 4 * i + 4]
                    x = held.get((host, slot))
                    # several slots of a page may fall in one; it is the same on all pages only if all of them are
                    held[host, slot] = [prints, n, linked, low, high] if x is None else [_least(x[0], prints), x[1] + n, x[2] + linked, min(x[3], low), max(x[4], high)]
            if len(held) > 20_000:
                yield out()
        if held:
            yield out()

    return run


@lru_cache(2048)
def _slots_of(expression: str, wrapper: str) -> list[int]:
    return placed(read(expression), _read(wrapper))


@lru_cache(64)
def _read(wrapper: str) -> tuple:
    return read(wrapper)


def _fold_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, expression) of sorted rows (host, salt, expression): one expression for each run of host and salt, which is never held as a whole."""
    last, wrapper = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.string()), pa.array([written(wrapper)], pa.string())], names=["host", "expression"])

    for batch in batches:
        for host, salt, expression in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is not None and last != (host, salt):
                yield out()
            wrapper = align(wrapper, read(expression)) if last == (host, salt) else read(expression)
            last = (host, salt)
    if last is not None:
        yield out()


def _folded(forms: DataFrame) -> DataFrame:
    """(host, expression) of rows (host, salt, expression): one for each host and salt."""
    return forms.repartition("host", "salt").sortWithinPartitions("host", "salt", "expression").mapInArrow(_fold_runs, "host string, expression string")


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, wrapper, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seen = {x["slot"]: (x["pages"], x["words"], x["linked"], x["low"] == x["high"]) for x in counts or ()}
            rows.append((host, wrapper, *article_slots(read(wrapper), seen)))
        if rows:
            kinds = [pa.string(), pa.string(), *[pa.list_(pa.int32())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "wrapper", "paths", "others", "rest"])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = 64, broadcast_bytes: int = 16_000_000) -> DataFrame:
    """(host, wrapper, paths, others, rest): each host's union-free expression, its article slots, and those for pages without text in these."""
    spark = pages.sparkSession
    reduced = materialise(pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(_reduce, _REDUCED), "reduced")
    forms = reduced.select("host", "expression").distinct().withColumn("salt", F.pmod(F.xxhash64("expression"), F.lit(salts)))
    parts = _folded(forms.select("host", "salt", "expression"))
    hosts = materialise(_folded(parts.select("host", F.lit(0).cast("long").alias("salt"), "expression")).withColumnRenamed("expression", "wrapper"), "hosts")  # at most `salts` expressions a host
    size = hosts.agg(F.sum(F.length("host") + F.length("wrapper") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        seen = reduced.mapInArrow(_gather(spark.sparkContext.broadcast({r.host: r.wrapper for r in hosts.toLocalIterator()})), _SEEN)
    else:
        salted = reduced.withColumn("salt", F.pmod(F.xxhash64("expression"), F.lit(salts)))
        spread = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        seen = salted.join(spread, ["host", "salt"]).select("host", "expression", "prints", "counts", "wrapper").mapInArrow(_gather(None), _SEEN)
    # each task gives a few rows a slot, so the lists are short
    different = F.size(F.array_distinct(F.flatten(F.collect_list("prints"))))
    seen = seen.groupBy("host", "slot").agg(F.least(different, F.lit(_DIFFERENT)).alias("pages"), F.sum("words").alias("words"), F.sum("linked").alias("linked"), F.min("low").alias("low"), F.max("high").alias("high"))
    seen = seen.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "words", "linked", "low", "high")).alias("counts"))  # as many as the wrapper has slots
    return materialise(hosts.join(seen, "host", "left").select("host", "wrapper", "counts").mapInArrow(_choose, _CHOSEN), "wrappers")


def _main_text(source: str | None, wrapper: str | None, *choices) -> str:
    page = Page(source or "")
    if not page.blocks or wrapper is None:
        return ""
    to = _slots_of(written(page.expression), wrapper)
    for chosen in choices:
        texts = [text for i, (text, _, _) in zip(page.slot, page.blocks, strict=True) if to[i] in chosen]
        if texts:
            return "\n".join(texts)
    return ""


def _apply_shared(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host = shared.value
        for batch in batches:
            texts = [_main_text(s.as_py(), *by_host.get(host_of(u.as_py()), (None,))) for u, s in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def _apply_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [_main_text(s.as_py(), w.as_py(), *(frozenset(c.as_py() or ()) for c in chosen)) for s, w, *chosen in zip(*batch.columns[2:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 16_000_000, salts: int = 64) -> DataFrame:
    """(page_id, url, text) of every row."""
    spark, chosen = pages.sparkSession, wrappers(pages, url_col, html_col, salts, broadcast_bytes)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    size = chosen.agg(F.sum(F.length("host") + F.length("wrapper") + 32 * (F.size("paths") + F.size("others") + F.size("rest")) + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        by_host = {r.host: (r.wrapper, frozenset(r.paths), frozenset(r.others), frozenset(r.rest)) for r in chosen.toLocalIterator()}
        return rows.mapInArrow(_apply_shared(spark.sparkContext.broadcast(by_host)), "page_id long, url string, text string")
    at = F.instr("url", "://")
    host = F.when(at > 0, F.lower(F.regexp_extract(F.expr("substring(url, instr(url, '://') + 3)"), r"^[^/?#]*", 0))).otherwise("")
    salted = rows.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(salts)))
    spread = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(spread, ["host", "salt"], "left").select("page_id", "url", "html", "wrapper", "paths", "others", "rest").mapInArrow(_apply_joined, "page_id long, url string, text string")
