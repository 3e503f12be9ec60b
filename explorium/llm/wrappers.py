"""Main text of web pages through wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a sequence of structural items: container tags opening and closing, leaf blocks, text. Runs that repeat
a unit fold into a repeated group. Two sequences are aligned; what both have stays, what one has is optional, texts
that differ become slots. Aligning a host's pages one after another gives its wrapper, and wrappers align like pages:
each task folds its own pages by host, and a host's partial wrappers (one a task at most) are folded after a shuffle.

A wrapper says where the host keeps its article: the container named so, else the lowest one that holds nearly all text
outside menus, headers, footers, side bars, notices, adverts, forms and comments; slots, that is text that differs between
pages, count most. A text is of the template if the wrapper has it as a constant that at least ``TEMPLATE`` pages and
half of the host's pages share; it counts for nothing, and in a container that isn't named as the article it is left
out, unless nothing else is left of the page. Of a page, the text blocks in that container, outside of the parts above
and not of the template, are the main text; a page that lacks the container is read by its own structure in the same way.

A host's wrapper comes from all its pages; in which order they are aligned follows the partitions. Partial wrappers are
folded in two rounds, first in ``SALTS`` parts of a host, so no task aligns all parts of a large host. Pages aren't
shuffled while what the hosts' wrappers say fits a broadcast of ``BROADCAST`` bytes.

A leaf block or a stretch inside of one that is marked by a name of its own, as adverts and comments of a list are, counts as
excluded too. An element whose content is never text, such as svg, hides nothing if it isn't closed within its article.

Null pages have no text; pages without a host share one wrapper. Empty tables give empty results. Extra columns are
not read. Whole pages are read, whatever their length; nothing recurses.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Container, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(?:noscript|template|iframe|svg|select|button|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    r"|<(noscript|template|iframe|svg|select|button|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:(?!<\2\b|</(?:article|main|body|html)\b).)*?</\2\s*>"
    r"|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)

#: Tags by what they do to the flow of text.
CONTAINERS = frozenset("html head body article main section nav header footer aside div form fieldset ul ol dl table thead tbody tfoot tr figure details dialog menu blockquote title".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre br hr figcaption summary caption address center legend label option".split())
OUTSIDE = frozenset("head nav footer aside form menu dialog fieldset title".split())
#: Words of class, id and role that mark what isn't the article.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside "
    "comment comments disqus respond responses replies discussion commentlist commentform cookie cookies consent notice banner alert popup modal newsletter subscribe subscription signup login share sharing social related recommended pagination pager widget toolbar skip".split())
MAIN_NAMES = frozenset("main article content post entry story".split())
#: Tags and names whose content is never the article; other marks may stand on a wrapper of the whole page.
NEVER = frozenset("head nav footer aside menu dialog title".split())
NEVER_NAMES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent pagination pager toolbar skip".split())
FIRM = 1000
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Marks of single blocks and of stretches inside of them: names that say so by themselves, or begin so. Headings have none.
SOFT_NAMES = ASIDE_NAMES - frozenset("header banner notice alert social skip toolbar widget response responses respond discussion".split())
SOFT_STARTS = frozenset("ad ads advert advertisement sponsor sponsored promo".split())
HEADINGS, VOID = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("br hr img input wbr source track param area base col embed link meta".split())
#: What "social" stands with where it means links to elsewhere.
SOCIAL = frozenset("social media link links share sharing icon icons button buttons bar nav follow widget".split())
#: Containers that are parts of a text, for which a template asks their parent.
CONTENT = frozenset("blockquote ul ol dl table thead tbody tfoot tr figure details".split())
#: Containers that may hold a whole article, and the share of a page's text that is nearly all.
WRAPPING, NEARLY_ALL = frozenset("html body section div form fieldset".split()), 0.98
_STATE = frozenset("has with no without".split())
#: Pages that must share a constant for it to be of the template; parts that a host's wrappers are folded in; bytes.
TEMPLATE, SALTS, BROADCAST = 3, 32, 16 << 20


def _names(attributes: str) -> list[list[str]]:
    """The words of each name in class, id and role; "siteHeader" is site and header."""
    return [_WORDS.findall(_CAMEL.sub("-", n).lower()) for m in _NAMED.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").split()] if attributes else []


def _soft(tag: str, attributes: str) -> bool:
    """Whether a leaf or a tag within text is marked."""
    return bool(attributes) and tag not in HEADINGS and tag not in VOID and any(n and (len(n) == 1 and n[0] in SOFT_NAMES or n[0] in SOFT_STARTS) for n in _names(attributes))


def _label(tag: str, attributes: str, inner: bool) -> tuple[str, int, bool]:
    """Tag with its names, its mark (0: none, 1, or FIRM where nothing below can be the article), whether it is named as the article. inner: it stands in an article."""
    names = _names(attributes)
    words = [w for n in names for w in n]
    main = tag in ("article", "main") or "main" in words or "article" in words
    # "has-sidebar" says what the element holds, not what it is
    said = {w for n in names if not _STATE & set(n) and not ("social" in n and set(n) - SOCIAL) for w in n} - ({"header"} if inner else set())
    out = 0
    if not main and tag not in ("html", "body"):
        out = FIRM if tag in NEVER or said & NEVER_NAMES else 1 if tag in OUTSIDE or said & ASIDE_NAMES else 0
    if tag == "header":
        out = 0 if inner else FIRM
    return tag + "".join("." + w for w in words[:3]), out, main


def blocks(page: str) -> Iterator[tuple[str, tuple[str, ...], int, str]]:
    """Items of a page: ("<" or ">", path, outside, label) of containers, ("b", path, outside, label) of leaf starts, ("t", path, outside, text) of text blocks.

    outside: 0 if nothing above is marked, else the sum of the marks. An article that isn't in another one lifts the
    marks of its wrappers, unless one is firm; its label then starts with "^".
    """
    stack: list[tuple[str, str, int, bool]] = []  # tag, label, outside, within an article
    soft: list[list] = []  # marked leaves and tags within text: tag, containers around it, tags of the same name open in it
    text: list[str] = []

    def flush():
        said = " ".join(html.unescape("".join(text)).split())
        text.clear()
        return said

    def where():
        return tuple(s[1] for s in stack), (stack[-1][2] if stack else 0) + len(soft)

    for m in _TOKEN.finditer(page):
        if m[6] is not None:
            text.append(m[6])
            continue
        if (tag := m[4]) is None:
            if m[1] or m[2] or m[0][1] not in "!?":
                text.append(" ")
            elif m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:-3]))
            continue
        tag, ends, attributes = tag.lower(), bool(m[3]), m[5] or ""
        block = tag in CONTAINERS or tag in LEAVES
        marked = not ends and tag not in CONTAINERS and _soft(tag, attributes)
        own = next((k for k in range(len(soft) - 1, -1, -1) if soft[k][0] == tag), None) if soft else None
        if not block and not marked and own is None:
            continue
        if block or marked or ends and not soft[own][2]:
            if said := flush():
                yield "t", *where(), said
        if own is not None and tag not in CONTAINERS:
            if tag in LEAVES:
                # its own end, or the next one beside it
                if soft[own][1] == len(stack):
                    del soft[own:]
            elif not ends:
                soft[own][2] += 1
            elif soft[own][2]:
                soft[own][2] -= 1
            else:
                del soft[own:]
        if block and not ends and tag != "br" and soft and soft[-1][0] == "p":
            soft.pop()  # a paragraph holds no other block
        if marked:
            soft.append([tag, len(stack), 0])
        if tag in LEAVES:
            if not ends and tag != "br":
                yield "b", *where(), tag
        elif tag in CONTAINERS and ends:
            if any(s[0] == tag for s in stack):
                while stack:
                    while soft and soft[-1][1] >= len(stack):
                        soft.pop()
                    top = stack.pop()
                    yield ">", *where(), top[1]
                    if top[0] == tag:
                        break
        elif tag in CONTAINERS:
            inner, above = bool(stack and stack[-1][3]), stack[-1][2] if stack else 0
            label, out, main = _label(tag, attributes, inner)
            if main and not inner and 0 < above < FIRM:
                label, above = "^" + label, 0
            yield "<", *where(), label
            stack.append((tag, label, above + out, inner or main and above < FIRM))
    if said := flush():
        yield "t", *where(), said


# A wrapper's items: [label], ["#", text or null (a slot), region, most characters, pages that have it], and groups of items: ["?", items]
# optional, ["+", items] repeated, ["*", items] both.


def _mark(x: list) -> str:
    """What items are aligned by: texts by their region, groups by their content."""
    return f"#{x[2]}" if x[0] == "#" else "(" + " ".join(map(_mark, x[1])) + ")" if x[0] in _GROUPS else x[0]


_GROUPS = ("?", "+", "*")


def _unit(x: list) -> list:
    return x[1] if x[0] in _GROUPS else [x]


def _kind(x: list) -> str:
    return x[0] if x[0] in _GROUPS else ""


def _join(a: list, b: list, pages=max) -> list:
    """Of two items with the same mark. pages: how the numbers of pages go together, by their sum if the pages are others."""
    if a[0] == "#":
        return ["#", a[1] if a[1] == b[1] else None, a[2], max(a[3], b[3]), pages((a[4], b[4]))]
    return a


def _fold(items: list, longest: int = 4) -> list:
    """Runs of a unit, at least two, become a repeated group."""
    marks, out, at = [_mark(x) for x in items], [], 0
    while at < len(items):
        for k in range(1, longest + 1):
            n = 1
            while marks[at + n * k : at + (n + 1) * k] == marks[at : at + k] and at + (n + 1) * k <= len(items):
                n += 1
            if n > 1:
                unit = items[at : at + k]
                for r in range(1, n):
                    unit = [_join(a, b) for a, b in zip(unit, items[at + r * k : at + (r + 1) * k], strict=True)]
                out.append(["+", unit])
                at += n * k
                break
        else:
            out.append(items[at])
            at += 1
    return out


def _tidy(items: list) -> list:
    """Pieces next to a repeated group that say nothing but what the group says go into it, so a wrapper stays short."""
    out: list = []
    for x in items:
        while out and (_kind(out[-1]) in ("+", "*") or _kind(x) in ("+", "*")):
            big, small = (out[-1], x) if len(_unit(out[-1])) >= len(_unit(x)) and _kind(out[-1]) in ("+", "*") else (x, out[-1])
            if _kind(big) not in ("+", "*") or not {_mark(v) for v in _unit(small)} <= {_mark(v) for v in _unit(big)}:
                break
            unit = [next((_join(v, w) for w in _unit(small) if _mark(w) == _mark(v)), v) for v in _unit(big)]
            out.pop()
            x = ["*" if "?" in (_kind(big), _kind(small)) or "*" in (_kind(big), _kind(small)) or len(_unit(small)) < len(unit) else "+", unit]
        out.append(x)
    return out


def _loose(x: list) -> list:
    return [{"": "?", "?": "?", "+": "*", "*": "*"}[_kind(x)], _unit(x)]


def align(a: list, b: list) -> list:
    """The wrapper of two: items of one side only become optional; an optional or repeated group meets its single unit."""
    out: list = []
    bare = lambda items: [" ".join(map(_mark, _unit(x))) for x in items]
    for op, i, j, k, m in SequenceMatcher(None, bare(a), bare(b), autojunk=False).get_opcodes():
        if op != "equal":
            out += [_loose(x) for x in a[i:j]] + [_loose(x) for x in b[k:m]]
            continue
        for x, y in zip(a[i:j], b[k:m], strict=True):
            unit = [_join(v, w, sum) for v, w in zip(_unit(x), _unit(y), strict=True)]
            kinds = {_kind(x), _kind(y)}
            many, maybe = kinds & {"+", "*"}, kinds & {"?", "*"}
            kind = "*" if many and maybe else "+" if many else "?" if maybe else ""
            out.append([kind, unit] if kind else unit[0])
    return _tidy(out)


def page_items(page: str) -> list:
    items = []
    for kind, path, outside, what in blocks(page):
        if kind == "t":
            items.append(["#", _short(what), ("-" if outside else "") + ">".join(path), 0 if outside else len(what), 1])
        else:
            items.append([("" if kind == "<" else "/" if kind == ">" else "|") + what])
    return _tidy(_fold(items))


def _short(text: str) -> str:
    """What a constant is told by: the text, or for long ones its start and a digest of the whole."""
    return text if len(text) <= 200 else text[:200] + f" {hash_of(text)}"


def hash_of(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "replace")).hexdigest()


def _texts(wrapper: list) -> Iterator[list]:
    """The text items of a wrapper in order, those in groups too, outside of excluded parts."""
    todo = list(reversed(wrapper))
    while todo:
        x = todo.pop()
        if x[0] in _GROUPS:
            todo += reversed(x[1])
        elif x[0] == "#" and not x[2].startswith("-"):
            yield x


def _named_as_article(path: str) -> str | None:
    """The path of the outermost container on a path that is named as the article."""
    steps = path.split(">")
    for k, step in enumerate(steps):
        if step.lstrip("^").split(".")[0] in ("article", "main") or {"main", "article"} & set(step.split(".")[1:]):
            return ">".join(steps[: k + 1])
    return None


def _around(path: str) -> str:
    """The container that a text's path ends in, without unnamed parts of a text."""
    steps = path.split(">")
    while len(steps) > 1 and steps[-1] in CONTENT:
        steps.pop()
    return ">".join(steps)


def template(wrapper: list, pages: int) -> set[tuple[str, str]]:
    """Path and text of the wrapper's constants that belong to the host's pages, not to their articles.

    What stands between the first and the last slot of its container is of the article, as its repeated headings are.
    """
    shared = max(TEMPLATE, pages / 2)
    texts = list(_texts(wrapper))
    ends: dict[str, tuple[int, int]] = {}
    for k, x in enumerate(texts):
        if x[1] is None:
            around = _around(x[2])
            ends[around] = ends.get(around, (k, k))[0], k
    within = lambda k, x: (e := ends.get(_around(x[2]))) is not None and e[0] < k < e[1]
    return {(x[2], x[1]) for k, x in enumerate(texts) if x[1] is not None and x[4] >= shared and not _named_as_article(x[2]) and not within(k, x)}


def region(wrapper: list, pages: int = 1) -> str:
    """The path of the container that holds the article: the one named so with most text, else the lowest that holds nearly all text outside the excluded parts; empty if that is the whole page.

    Containers beside the one named as the article that are named so too, with a quarter of its text or more, are parts of
    the article; the paths are told line by line then.
    """
    mass: dict[str, float] = {}
    ours, texts = template(wrapper, pages), list(_texts(wrapper))
    if all((x[2], x[1]) in ours for x in texts):  # pages that are all alike
        ours = set()
    for x in texts:
        # a slot varies between pages; a constant still counts, since a host may have a single page
        if (x[2], x[1]) not in ours:
            mass[x[2]] = mass.get(x[2], 0) + (x[3] if x[1] is None else x[3] / 4)
    named = {}
    for path, n in mass.items():
        if top := _named_as_article(path):
            # in a marked wrapper, as teasers are: counts less than one that isn't
            named[top] = named.get(top, 0) + (n / 4 if "^" in top else n)
    if named:
        most = max(sorted(named), key=named.get)
        return "\n".join(sorted(p for p in named if p.rpartition(">")[0] == most.rpartition(">")[0] and named[p] >= named[most] / 4))
    below: dict[str, float] = {}
    for path, n in mass.items():
        steps = path.split(">")
        for k, step in enumerate(steps):
            if step.split(".")[0] not in WRAPPING:
                break
            top = ">".join(steps[: k + 1])
            below[top] = below.get(top, 0) + n
    whole = [p for p, n in below.items() if n >= NEARLY_ALL * sum(mass.values())]
    return max(sorted(whole), key=lambda p: p.count(">"), default="")


def _below(path: str, home: str) -> bool:
    return any(home and (path == home or path.startswith(home + ">")) for home in home.split("\n"))


def main_text(page: str, home: str, ours: Container[tuple[str, str]] = ()) -> str:
    """The article of a page: text blocks below the region ``home`` and outside of excluded parts, but for what is of the template (``ours``). If all is excluded, what is excluded least and not firmly."""
    every = [(">".join(path), outside, what) for kind, path, outside, what in blocks(page) if kind == "t" and outside < FIRM]
    least = min((outside for _, outside, _ in every), default=0)
    texts = [(path, what) for path, outside, what in every if outside == least]
    if own := [(path, what) for path, what in texts if (path, _short(what)) not in ours]:
        texts = own
    found = [what for path, what in texts if _below(path, home)]
    if not found and texts:
        own_home = region([["#", None, path, len(what), 1] for path, what in texts])
        found = [what for path, what in texts if not own_home or _below(path, own_home)]
    return " ".join(found)


_PARTIAL = {"host": pa.string(), "salt": pa.int32(), "pages": pa.int64(), "wrapper": pa.string()}
_TOLD = {"host": pa.string(), "wrapper": pa.string(), "region": pa.string(), "template": pa.string()}
_PARTIAL_DDL, _TOLD_DDL = "host string, salt int, pages long, wrapper string", "host string, wrapper string, region string, template string"


def _rows(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.values(), strict=True)], list(schema))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, salt, pages and wrapper of this task's pages."""
    found: dict[str, tuple[int, list]] = {}
    salt = TaskContext.get().partitionId() % SALTS
    out = lambda: _rows([(host, salt, n, json.dumps(w)) for host, (n, w) in found.items()], _PARTIAL)
    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if (page := page.as_py()) is None:
                continue
            items = page_items(page)
            n, old = found.get(host, (0, None))
            found[host] = n + 1, items if old is None else align(old, items)
            if len(found) > 20_000:
                yield out()
                found.clear()
    yield out()


def _folded(batches: Iterator[pa.RecordBatch], salted: bool) -> Iterator[tuple]:
    """Partial wrappers, sorted by host (and salt, if ``salted``), as one for each."""
    key, pages, wrapper = None, 0, None
    for b in batches:
        for host, salt, n, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
            w, now = json.loads(w), (host, salt if salted else 0)
            if now != key:
                if key is not None:
                    yield *key, pages, wrapper
                key, pages, wrapper = now, n, w
            else:
                pages, wrapper = pages + n, align(wrapper, w)
    if key is not None:
        yield *key, pages, wrapper


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for host, salt, pages, wrapper in _folded(batches, True):
        yield _rows([(host, salt, pages, json.dumps(wrapper))], _PARTIAL)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for host, _, pages, wrapper in _folded(batches, False):
        ours = sorted(template(wrapper, pages))
        yield _rows([(host, json.dumps(wrapper), region(wrapper, pages), json.dumps(ours) if ours else None)], _TOLD)


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper (JSON), region and template (JSON: path and text of its constants), learned from every page."""
    part = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(_partial, _PARTIAL_DDL)
    part = part.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(_parts, _PARTIAL_DDL)
    return part.repartition("host").sortWithinPartitions("host", "salt").mapInArrow(_whole, _TOLD_DDL)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, frozenset] = {}
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part, texts = b.slice(at, 256), []
            for page, home, ours in zip(part.column(2), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                if ours and ours not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[ours] = frozenset(map(tuple, json.loads(ours)))
                texts.append(main_text(page.as_py() or "", home or "", known[ours] if ours else ()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    told = Scratch(pages.sparkSession, "wrappers").save(infer(pages).select("host", "region", "template"), "regions")
    size = told.agg(F.sum(F.length("host") + F.length("region") + F.coalesce(F.length("template"), F.lit(0)) + 64)).first()[0] or 0
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html", host_of().alias("host")).join(F.broadcast(told) if size <= BROADCAST else told, "host", "left")
    return rows.select("page_id", "url", "html", "region", "template").mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
