"""Main text of web pages by union-free regular-expression inference.

A page's tokens (start and end tags, texts) nest to a tree, in which inline marks are part of their block's text. The pages of
a host are aligned one after another with the host's wrapper, a regular expression without unions: the children of
an element are a sequence of groups. A text that differs from the wrapper's becomes a slot. A token that the wrapper lacks,
or that a page lacks, becomes optional. A token that comes again makes everything since its last place a repeated
group. Two wrappers are aligned in the same way, so tasks infer wrappers of the pages that they read, and these are merged.

The wrapper tells template from content. Menus, headers, footers, asides, forms, scripts, notices, adverts and comments go by tag,
role or the words of their names; texts that stay the same on nearly all pages of a host (no slots) are template too. The main text
is what is left in the container that has most of the slots' text: an article element, else a main element, else the
innermost container with most of it and with its headings. A page of another form than its host's is judged by itself, and names count
less, step by step, where nothing would be left of a page.

Scale: pages aren't shuffled to learn; a task sends one wrapper for a host (more, if they get large), which are merged in two
steps, so a host with a third of all pages has no large group. What the wrappers say is sent to all tasks while it has ``SMALL`` bytes at most;
beyond that pages find it by a join. A wrapper grows with a host's forms, not with its pages: numbers in names don't count,
and elements are nested to ``DEEP`` levels, deeper ones belong to the last one's text.

Nulls: null html has no text; a null url is the empty host. Markup without an end is read as far as it goes; a tag that the
page's end cuts is dropped. Text is all of it, however long. Repeated rows return each, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, frugal, stored

SMALL, DEEP, LARGE, SALT = 16 << 20, 64, 20_000, 16
#: A text is template from so many pages of a host on, if it is on this share of them, and if templates are no more than this share of the main text.
FEW, SHARE, MINOR = 3, 0.9, 0.2
#: A container has most of the text from this share on; an article or main element from that one.
MOST, SAID = 0.8, 0.4

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Never text of a page.
CODE = frozenset("script style noscript template svg canvas iframe object audio video head title noembed noframes select datalist textarea button".split())
OUTSIDE = frozenset("nav footer aside menu dialog form".split())
WHOLE = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = frozenset("p ul ol dl table blockquote pre figure hr h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph; and elements that end an open one of the same kind, up to a parent.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "thead", "tbody", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tbody": ("thead tbody tr td th", ("table",)), "tfoot": ("tbody tr td th", ("table",)), "option": ("option", ("select",))}
#: Words of names (class, id, role) that tell what isn't the main text.
NAMES = frozenset(
    "nav navbar navigation navi menu menubar breadcrumb breadcrumbs toolbar masthead banner footer contentinfo sidebar complementary rail widget widgets "
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog "
    "newsletter subscribe subscription signup signin login search form comment comments usercomments commentlist disqus respond reply replies discussion "
    "share sharing social related recommended recommendations pagination pager skip copyright legal".split()
)
HEADER, OF_ARTICLE, BESIDE = frozenset(("header", "topbar")), frozenset("article entry post story content title".split()), frozenset("with has no without".split())

_OPEN = re.compile(r"<(?:!--(?P<comment>)|(?P<odd>[!?])|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*))")
_ATTRIBUTES = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_ATTRIBUTE = re.compile(r"""(hidden|class|id|role|style|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>"']|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    """An element of a page: its name with its classes, its children in order (elements and texts), and what it is known to be."""

    __slots__ = ("tag", "name", "children", "part", "sure", "link")

    def __init__(self, tag: str, name: str, part: bool, sure: bool, link: bool) -> None:
        self.tag, self.name, self.part, self.sure, self.link = tag, name, part, sure, link  # part: no main text; sure: nor in any case
        self.children: list[Element | str] = []


@functools.lru_cache(4096)
def described(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """An element's name, whether its names tell that it is no main text, whether it is hidden, and whether it is a header."""
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    tokens = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop"))
    words = {w.lower() for w in _WORD.findall(tokens)}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
    named = bool(words & NAMES) and not words & BESIDE and tag not in WHOLE
    header = (tag == "header" or bool(words & HEADER)) and not words & OF_ARTICLE
    classes = [re.sub(r"\d+", "#", c.lower()) for c in (found.get("class", "").split() or found.get("id", "").split())[:2]]
    return ".".join([tag, *classes]), named, hidden, header


def tree(page: str) -> Element:
    """The page's tokens as a tree."""
    root = Element("", "", False, False, False)
    stack, at, n = [root], 0, len(page)
    inside = 0  # open article and main elements

    def close(to: int) -> None:
        nonlocal inside
        inside -= sum(e.tag in ("article", "main") for e in stack[to:])
        del stack[to:]

    def say(raw: str) -> None:
        if raw:
            stack[-1].children.append(entities.unescape(raw) if "&" in raw else raw)

    while at < n:
        m = _OPEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        if m["comment"] is not None:
            end = page.find("-->", m.end() - (page.startswith(("<!-->", "<!--->"), m.start()) and 2))
            at = n if end < 0 else end + 3
            continue
        if m["odd"]:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        tag = m["name"].lower()
        full = _ATTRIBUTES.match(page, m.end())
        end = full.end() if full else page.find(">", m.end()) + 1
        if not end:
            break  # the page ends in a tag
        at, attributes = end, page[m.end() : end - 1]
        if m["end"]:
            k = len(stack) - 1
            while k and stack[k].tag != tag and not (tag in INLINE and stack[k].tag not in INLINE):
                k -= 1
            if k and stack[k].tag == tag:
                close(k)
            elif tag in ("p", "br"):
                stack[-1].children.append(" ")
            continue
        if tag not in INLINE:
            if tag in ENDS_P:
                k = len(stack) - 1
                while k and (stack[k].tag in INLINE):
                    k -= 1
                if stack[k].tag == "p":
                    close(k)
            if tag in ENDS:
                kinds, most = ENDS[tag]
                k, last = len(stack) - 1, 0
                while k and stack[k].tag not in most:
                    if stack[k].tag in kinds.split():
                        last = k
                    k -= 1
                if last:
                    close(last)
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].children.append(" ")
            continue
        name, named, hidden, header = described(tag, attributes)
        part = named or tag in OUTSIDE or header and not inside
        made = Element(tag, name, part, hidden or tag in CODE, tag == "a")
        stack[-1].children.append(made)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(page, at)
            at = stop.start() if stop else n
        if len(stack) < DEEP or tag in RAW:
            stack.append(made)
            inside += tag in ("article", "main")
    return root


# A wrapper is [name, instances, parents that have it, text (hash; None: a slot), characters, of these in links, groups]; a host's also
# has the ``KEPT`` least hashes of its pages' longest texts. A group is [repeated, wrappers]. JSON can carry it.
NAME, MANY, HAVE, TEXT, CHARS, LINKED, GROUPS, LONGEST = range(8)
KEPT = 64


def hashed(text: str) -> str:
    import xxhash

    return xxhash.xxh64_hexdigest(text)


def own_text(e: Element, level: int) -> tuple[str, int, list[Element]]:
    """The text of an element without that of the blocks in it, characters of it in links, and those blocks and the parts that are dropped."""
    text, linked, blocks = [], 0, []
    todo = [(x, e.link) for x in reversed(e.children)]
    while todo:
        x, link = todo.pop()
        if isinstance(x, str):
            text.append(x)
            linked += len(x) * link
        elif dropped(x, level):
            if x.tag not in CODE:
                blocks.append(x)
        elif x.tag in INLINE and not any(isinstance(y, Element) and y.tag not in INLINE for y in x.children):
            todo += [(y, link or x.link) for y in reversed(x.children)]
        else:
            text.append(" ")
            blocks.append(x)
    return " ".join("".join(text).split()), linked, blocks


def dropped(e: Element, level: int) -> bool:
    """No main text: by tag and name at level 0, by tag but for forms and headers at level 1, only code and hidden parts at level 2."""
    return e.sure or (level == 0 and e.part) or (level == 1 and e.tag in OUTSIDE and e.tag != "form")


def lifted(e: Element, level: int = 0) -> list:
    """The wrapper of a single element: its children one after another, repeated ones aligned with each other. Of a part that is dropped it is the name alone."""
    if dropped(e, level):
        return [e.name, 1, 1, "", 0, 0, []]
    text, linked, blocks = own_text(e, level)
    groups: list = []
    for b in blocks:
        placed(groups, [False, [lifted(b, level)]], len(groups), within=True)
    return [e.name, 1, 1, hashed(text) if text else "", len(text), min(linked, len(text)), groups]


def inferred(page: str, level: int = 0) -> list:
    """The wrapper of a page."""
    root, longest = tree(page), ""
    todo = [root]
    while todo:
        text, _, blocks = own_text(todo.pop(), level)
        longest = max(longest, text, key=lambda t: (len(t), t))
        todo += [b for b in blocks if not dropped(b, level)]
    return [*lifted(root, level), [hashed(longest)]]


def placed(groups: list, new: list, at: int, within: bool = False) -> int:
    """Aligns a group with a sequence of groups from place ``at`` on, and returns the place after it. ``within``: both belong to one parent."""
    where = {w[NAME]: i for i, g in enumerate(groups) for w in g[1]}
    met = [where[w[NAME]] for w in new[1] if w[NAME] in where]
    if not met:
        groups.insert(at, new)
        return at + 1
    first, last = min(met), max(met)
    again = within or first < at  # it has been before: all since then repeats
    if again:
        last = max(last, at - 1)
    mine = groups[first]
    for g in groups[first + 1 : last + 1]:
        mine[1] += g[1]
    del groups[first + 1 : last + 1]
    mine[0] = mine[0] or new[0] or again or last > first
    of = {w[NAME]: w for w in mine[1]}
    for w in new[1]:
        if w[NAME] in of:
            merge(of[w[NAME]], w, within)
        else:
            mine[1].append(w)
    return first + 1


def merge(w: list, other: list, within: bool = False) -> None:
    """Aligns a wrapper with another one (or a page's) of the same name."""
    w[MANY] += other[MANY]
    if not within:
        w[HAVE] += other[HAVE]
    if w[TEXT] != other[TEXT]:
        w[TEXT] = None
    w[CHARS] += other[CHARS]
    w[LINKED] += other[LINKED]
    if len(w) > LONGEST:
        w[LONGEST] = sorted({*w[LONGEST], *other[LONGEST]})[:KEPT]
    at = 0
    for group in other[GROUPS]:
        at = placed(w[GROUPS], group, at)


def size(w: list) -> int:
    return 1 + sum(size(x) for g in w[GROUPS] for x in g[1])


def expression(w: list) -> str:
    """The wrapper as a regular expression: #text is a slot, = a text that stays, ? optional, + repeated."""
    inner = "#text" if w[TEXT] is None else "=" if w[TEXT] else ""
    for again, members in w[GROUPS]:
        each = "".join(f"({expression(x)})?" if x[HAVE] < w[MANY] and (len(members) > 1 or not again) else expression(x) for x in members)
        optional = again and all(x[HAVE] < w[MANY] for x in members)
        inner += f"({each}){'*' if optional else '+'}" if again else each
    return f"<{w[NAME]}>{inner}</>" if w[NAME] else inner


def differing(root: list) -> float:
    """How many pages of a host differ, by their longest texts: copies don't count."""
    kept = root[LONGEST]
    return len(kept) if len(kept) < KEPT else (KEPT - 1) * 2**64 / int(kept[-1], 16)


def template(w: list, root: list) -> bool:
    """Whether a wrapper's text is the host's: the same on nearly all pages, once on each, and on differing ones."""
    return bool(w[TEXT]) and w[MANY] == w[HAVE] and w[MANY] >= SHARE * root[MANY] and differing(root) - (root[MANY] - w[MANY]) >= FEW


def judged(w: list) -> dict:
    """What a host's wrapper says: ``main``, the path to the container of the main text, and ``fixed``, paths to template texts in it."""

    def slots(x: list) -> int:  # characters of content that are no links
        mine = 0 if template(x, w) else x[CHARS] - x[LINKED]
        return mine + sum(slots(y) for g in x[GROUPS] for y in g[1])

    def every(x: list, path: tuple) -> Iterator[tuple[tuple, list]]:
        yield path, x
        for g in x[GROUPS]:
            for y in g[1]:
                yield from every(y, (*path, y[NAME]))

    total, main = slots(w), None
    for kind in ("article", "main"):
        found = [(slots(x), len(p), p, x) for p, x in every(w, ()) if p and p[-1].split(".")[0] == kind]
        if found:
            score, _, path, node = min(found, key=lambda f: (-f[0], f[1], f[2]))
            if score > 0 and score >= SAID * total:
                main = path, node
                break
    if main is None:
        path, node = (), w
        while True:
            inner = [(slots(y), y) for g in node[GROUPS] for y in g[1] if y[NAME].split(".")[0] not in FLOW and y[NAME].split(".")[0] not in INLINE]
            titled = any(y[NAME].split(".")[0] in HEADINGS and not template(y, w) for g in node[GROUPS] for y in g[1])
            score, best = max(inner, key=lambda s: (s[0], s[1][NAME]), default=(0, None))
            if best is None or titled or score <= 0 or score < MOST * slots(node):
                break
            path, node = (*path, best[NAME]), best
        main = path, node
    path, node = main
    fixed = [p for p, x in every(node, path) if template(x, w)]
    chars = {p: x[CHARS] for p, x in every(node, path)}
    if sum(chars[p] for p in fixed) > MINOR * sum(chars.values()):
        fixed = []
    return {"main": list(path), "fixed": sorted(map(list, fixed))}


def text_of(e: Element, says: dict, level: int) -> str:
    """The texts in the main container, but for template texts, in page order."""
    main, fixed, out = tuple(says["main"]), {tuple(p) for p in says["fixed"]}, []

    def walk(e: Element, path: tuple, mine: bool, inline: bool) -> None:
        mine = mine or path == main
        silent = path in fixed and not inline
        for x in e.children:
            if isinstance(x, str):
                if mine and not silent:
                    out.append(x)
            elif not dropped(x, level):
                flat = x.tag in INLINE and not any(isinstance(y, Element) and y.tag not in INLINE for y in x.children)
                if flat:
                    if not silent:
                        walk(x, path, mine, inline)
                else:
                    out.append(" ")
                    walk(x, (*path, x.name), mine, False)
                    out.append(" ")

    walk(e, (), not main, False)
    return " ".join("".join(out).split())


def main_text(page: str | None, says: dict | None) -> str:
    """The main text by what the host's wrapper says, or else by the page's own."""
    if not page:
        return ""
    root = tree(page)
    if says is not None:
        text = text_of(root, says, 0)
        if text:
            return text
    for level in (0, 1, 2):
        text = text_of(root, judged(inferred(page, level)), level)
        if text:
            return text
    return ""


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) of all hosts. ``expression`` shows a wrapper as a regular expression."""
    fields = "host string, wrapper string"

    def row(held: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "wrapper"])

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for name, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page:
                    w = inferred(page)
                    if name in held:
                        merge(held[name], w)
                    else:
                        held[name] = w
            if sum(map(size, held.values())) > LARGE:
                yield row(held)
                held = {}
        if held:
            yield row(held)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for w in map(json.loads, batch.column(batch.schema.get_field_index("wrapper")).to_pylist()):
                if total is None:
                    total = w
                else:
                    merge(total, w)
        yield row({key[0].as_py(): total})

    each = stored(pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(frugal(infer), fields))
    some = each.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALT)).alias("salt")).applyInArrow(add, fields)
    return stored(some.groupBy("host").applyInArrow(add, fields))


def verdicts(wrapped: DataFrame) -> DataFrame:
    """host, says (JSON): what each wrapper tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [json.dumps(judged(json.loads(w))) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], ["host", "says"])

    return stored(wrapped.select("host", "wrapper").mapInArrow(run, "host string, says string"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    told = verdicts(wrappers(pages))
    bytes_ = told.agg(F.sum(F.octet_length("says") + F.octet_length("host"))).first()[0] or 0
    told = told.withColumnRenamed("host", "h")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(told) if bytes_ <= SMALL else told, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "says")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = functools.lru_cache(256)(json.loads)
        for batch in batches:
            texts = [main_text(page, read(says) if says else None) for page, says in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(frugal(run), f"page_id {kind}, url string, text string, n_chars long")
