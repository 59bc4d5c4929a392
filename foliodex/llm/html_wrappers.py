"""Operator 3, HTML extraction by inferred wrappers (union-free regular expressions).

Every page becomes a stream of tokens: tags, with class, id and role as far as they name something, and text.
A page's stream is folded first: equal neighbouring runs of tokens become a repeated group, inner
ones before outer ones. Streams of one host are then aligned one after another with the wrapper so far: equal items
stay, texts become slots, and what only one side has becomes an optional group; the
result is folded again. A wrapper is thus a union-free regular expression over tags and slots.

Hosts are not bounded, nor are a host's pages: only distinct folded streams of a host meet (most
pages of a template are one), they are merged a few dozen at a time, and the merged wrappers again, until
each host has one. A hot host is spread over as many tasks as it has such groups.

The main part of a page is made of its content containers, chosen on each page among those of its host's wrapper: every
<article>, else <main>, else the containers that say they are one, else all of <body>. Inside it, containers of navigation, notices, adverts, forms, comments and the
like are left out, named by their tag or a whole word of class, id or role. A page is parsed by its host's wrapper and yields the texts in the slots of the main part.
A named main part keeps all its texts. Where there is none, the texts that a slot has on every page of the host are
constants of the template and are left out (see infer_constants), unless the page has no others.
Should a page not match (a host without wrapper), a wrapper of the page alone is used, which it matches by construction.

Cases: a null or empty html has the empty text; an unclosed element ends where HTML implies it or with its parent, stray end tags are passed over; a null or odd url belongs to the host ""; repeated pages
give repeated rows; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces_of, stored

# HTML's void, raw-text and inline elements, and names by which pages mark what is no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OUT_TAGS = frozenset("nav header footer aside form script style noscript template svg iframe textarea button select dialog menu head title".split())
OUT_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert advertisement adverts sponsor sponsored promo banner cookie cookies consent notice "
    "newsletter subscribe signup popup modal comment comments respond replies share sharing social related recommended widget toolbar pagination pager copyright".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Which open elements a start tag ends by implication, and the elements through which none of it, nor an end tag, reaches.
ENDS_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul".split())
CELL = frozenset("td th caption".split())
SCOPE = CELL | frozenset("table html template object marquee button".split())
TABLES = frozenset("table html template".split())
LISTS = SCOPE | frozenset("ul ol menu dl".split())
IMPLIED: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(["li"]), LISTS),
    **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), LISTS)),
    **dict.fromkeys(("td", "th"), (CELL, TABLES | {"tr"})),
    "tr": (CELL | {"tr"}, TABLES),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (CELL | {"tr", "tbody", "thead", "tfoot", "colgroup"}, TABLES)),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
    "a": (frozenset(["a"]), SCOPE),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
HEAD = frozenset("head html base basefont bgsound link meta noframes script style template title noscript".split())
IN_NAMES = ("article", "post", "content", "entry", "story", "main", "body")
SLOT = "\x00"

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_attribute = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_names = re.compile(r"[a-z]+")


def tokens(html: str) -> list[tuple[str, str | None]]:
    """(tag, None) or (SLOT, text) of a page, in order; tags as "div.ad", "/div"."""
    out: list[tuple[str, str | None]] = []
    at = 0
    while True:
        m = _token.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text.strip():
            out.append((SLOT, text))
        elif text and out and out[-1][0] == SLOT:
            out[-1] = (SLOT, out[-1][1] + text)
        elif text:
            out.append((" ", text))
        if not m:
            return out
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            out.append((f"/{tag}", None))
            continue
        values = [(a[2] or a[3] or a[4] or "").lower() for a in _attribute.finditer(m[3])]
        # what is no content is named by a whole word of class, id or role, a main part also by a piece of one (post-content)
        said = sorted({n for v in values for n in v.split() if n in OUT_NAMES} | {n for v in values for n in _names.findall(v) if n in IN_NAMES})
        out.append((".".join([tag, *said]), None))
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            out.append((f"/{tag}", None))


def shape(stream: list[tuple[str, str | None]]) -> list:
    """The stream without white space between tags and without texts, folded."""
    return fold([t for t, _ in stream if t != " "])


def _key(item) -> str:
    """What makes items equal: a tag, a slot, or a group by its contents."""
    return item if isinstance(item, str) else json.dumps(item, ensure_ascii=False)


_square = re.compile(r"(.{1,24}?)\1+", re.S)


def fold(items: list) -> list:
    """Equal neighbouring runs (of up to 24 items) as repeated groups ["+", ...], inner ones first, until nothing changes."""
    code: dict[str, str] = {}
    what: list = []

    def of(item) -> str:
        key = _key(item)
        if key not in code:
            code[key] = chr(0x4E00 + len(what))
            what.append(item)
        return code[key]

    text = "".join(map(of, items))
    groups: dict[str, str] = {}

    def group(m: re.Match) -> str:
        run = m[1]
        if len(run) == 1 and run in groups:
            return run
        inner = [what[ord(c) - 0x4E00] for c in run]
        g = of(["+", *inner])
        groups[g] = run
        return g

    while True:
        new = _square.sub(group, text)
        for g, run in groups.items():  # a group takes in single copies of itself beside it
            if run in new:
                new = new.replace(run + g, g).replace(g + run, g)
        if new == text:
            return [what[ord(c) - 0x4E00] for c in text]
        text = new


def _same(a, b) -> bool:
    if isinstance(a, str) or isinstance(b, str):
        return a == b
    return a[0] == b[0] == "+" and [_key(x) for x in a[1:]] == [_key(x) for x in b[1:]] or _key(a) == _key(b)


def _optional(items: list) -> list:
    """Items that may be missing: runs of them as optional groups, those that are optional already as they are."""
    out: list = []
    run: list = []
    for x in [*items, None]:
        if x is None or isinstance(x, list) and x[0] == "?":
            if run:
                out.append(["?", *run])
                run = []
            if x is not None:
                out.append(x)
        else:
            run.append(x)
    return out


#: Above so many cells, what two streams do not share at their ends becomes two optional groups unaligned.
MOST_CELLS = 1_000_000


def align(wrapper: list, page: list) -> list:
    """The wrapper that takes in both: common items stay, the rest becomes optional groups, then it is folded."""
    start = 0
    while start < min(len(wrapper), len(page)) and _same(wrapper[start], page[start]):
        start += 1
    end = 0
    while end < min(len(wrapper), len(page)) - start and _same(wrapper[-1 - end], page[-1 - end]):
        end += 1
    a, b = wrapper[start : len(wrapper) - end], page[start : len(page) - end]
    if len(a) * len(b) > MOST_CELLS:
        return wrapper[:start] + fold(_optional(a) + _optional(b)) + (wrapper[len(wrapper) - end :] if end else [])
    # longest common subsequence of what is left
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _same(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j, only_a, only_b = [], 0, 0, [], []

    def resolve():
        out.extend([*_optional(only_a), *_optional(only_b)])
        only_a.clear()
        only_b.clear()

    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and _same(a[i], b[j]):
            resolve()
            out.append(a[i])
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            only_a.append(a[i])
            i += 1
        else:
            only_b.append(b[j])
            j += 1
    resolve()
    return wrapper[:start] + fold(out) + (wrapper[len(wrapper) - end :] if end else [])


def _names_of(tag: str) -> tuple[str, set[str]]:
    name, *said = tag.split(".")
    return name, set(said)


def _flat(items: list) -> list[str]:
    return [y for x in items for y in ([x] if isinstance(x, str) else _flat(x[1:]))]


def _rank(tag: str) -> int | None:
    """The order in which kinds of main parts are asked for: articles, <main>, containers by their names, and last articles and mains that are named as no content."""
    name, said = _names_of(tag)
    if name in ("article", "main"):
        return (0 if name == "article" else 1) + (2 + len(IN_NAMES) if said & OUT_NAMES else 0)
    if name in ("div", "section", "td") and not said & OUT_NAMES:
        return next((2 + k for k, word in enumerate(IN_NAMES) if word in said), None)
    return None


def candidates(wrapper: list) -> dict[str, int]:
    """The opening tags of the wrapper that can be a page's main part, with their ranks."""
    ranks = {t: _rank(t) for t in set(_flat(wrapper)) if not t.startswith("/") and t != SLOT}
    return {t: r for t, r in ranks.items() if r is not None}


#: A parser's remembered steps are bounded; above so many entries they begin anew.
MOST_STEPS = 1_000_000
MATCH = -1


class Parser:
    """A wrapper as an automaton over tags and slots, whose sets of states are remembered: time is linear in the page, without backtracking."""

    def __init__(self, wrapper: list):
        self.program: list = []  # (tag,) takes a token; (x, y) goes on at x or y
        self._compile(wrapper)
        self.mains = candidates(wrapper)
        self._forget()

    def _compile(self, items: list) -> None:
        for x in items:
            if isinstance(x, str):
                self.program.append((x,))
            elif x[0] == "?":
                at = len(self.program)
                self.program.append(None)
                self._compile(x[1:])
                self.program[at] = (at + 1, len(self.program))
            else:
                at = len(self.program)
                self._compile(x[1:])
                self.program.append((at, len(self.program) + 1))

    def _forget(self) -> None:
        self.reach: dict[int, frozenset[int]] = {}
        self.step: dict[tuple[frozenset[int], str], tuple[list[int], frozenset[int]]] = {}
        self.size = 0

    def _reach(self, at: int) -> frozenset[int]:
        """The places that take a token (or MATCH) to which a place leads without one."""
        if at not in self.reach:
            seen, todo, out = set(), [at], set()
            while todo:
                k = todo.pop()
                if k in seen:
                    continue
                seen.add(k)
                if k == len(self.program):
                    out.add(MATCH)
                elif len(self.program[k]) == 1:
                    out.add(k)
                else:
                    todo.extend(self.program[k])
            self.reach[at] = frozenset(out)
            self.size += len(out)
        return self.reach[at]

    def bind(self, stream: list[tuple[str, str | None]]) -> list[int] | None:
        """The place in the wrapper that takes each token (white space between tags left out), or None if the page does not match.

        Of several ways to match the one is taken that, from the last token on, has the first place.
        """
        if self.size > MOST_STEPS:
            self._forget()
        now, taken = self._reach(0), []
        for tag, _ in stream:
            if tag == " ":
                continue
            if (now, tag) not in self.step:
                hits = sorted(k for k in now if k != MATCH and self.program[k][0] == tag)
                then = frozenset().union(*(self._reach(k + 1) for k in hits))
                self.step[now, tag] = (hits, then)
                self.size += len(hits) + len(then)
            hits, now = self.step[now, tag]
            if not hits:
                return None
            taken.append(hits)
        if MATCH not in now:
            return None
        target, out = MATCH, []
        for hits in reversed(taken):
            target = hits[0] if len(hits) == 1 else next(k for k in hits if target in self._reach(k + 1))
            out.append(target)
        return out[::-1]

    def matches(self, stream: list[tuple[str, str | None]]) -> bool:
        return self.bind(stream) is not None

    def slots(self, stream: list[tuple[str, str | None]], bound: list[int]) -> list[tuple[int, str] | None]:
        """For each token of the stream the slot that takes its text and the text, or None."""
        places = iter(bound)
        placed = ((None if tag == " " else next(places), tag, text) for tag, text in stream)
        return [(k, " ".join(text.split())) if tag == SLOT else None for k, tag, text in placed]

    def without(self, stream: list[tuple[str, str | None]], bound: list[int], constants: frozenset[tuple[int, int]]) -> list[tuple[str, str | None]]:
        """The stream without texts that its host's pages all have in the same slot."""
        return [(" ", " ") if s and (s[0], digest(s[1])) in constants else x for x, s in zip(stream, self.slots(stream, bound), strict=True)]

    def main(self, stream: list[tuple[str, str | None]]) -> str | None:
        """The text of the page's best kind of main part that has any, None where no main part is open."""
        opened = False
        for rank in sorted({self.mains[t] for t, _ in stream if t in self.mains}):
            text, found = self._texts(stream, rank)
            if text:
                return text
            opened |= found
        return "" if opened else None

    def texts(self, stream: list[tuple[str, str | None]], bound: list[int] | None = None, constants: frozenset[tuple[int, int]] = frozenset()) -> str:
        """The text of the main part; where none is open that of the body, without the host's constants unless nothing else is there."""
        text = self.main(stream)
        if text is not None:
            return text
        if bound and constants:
            text = self._texts(self.without(stream, bound, constants), None)[0]
        return text or self._texts(stream, None)[0]

    def _texts(self, stream: list[tuple[str, str | None]], rank: int | None) -> tuple[str, bool]:
        """The blocks in the slots of all main parts of a rank, joined by line ends, and whether there is such a part."""
        blocks: list[str] = []
        current: list[str] = []
        found = False
        open_ = Elements()

        def flush():
            text = " ".join(entities.unescape("".join(current)).split())
            if text:
                blocks.append(text)
            current.clear()

        for tag, text in stream:
            if text is not None:
                if text.strip():
                    open_.end_head()
                inside, out = open_.state
                if not out and (inside or rank is None):
                    current.append(text)
                continue
            closing = tag.startswith("/")
            name, said = _names_of(tag[1:] if closing else tag)
            if name not in INLINE and name not in RAW:
                flush()
            if name in RAW or closing and name in VOID:
                continue
            if closing:
                open_.close(name)
                continue
            open_.imply(name)
            if name in VOID:
                continue
            inside, out = open_.state
            if rank is not None and not (inside or out) and self.mains.get(tag) == rank:
                inside = found = True
            elif (name in OUT_TAGS or said & OUT_NAMES) and name not in ("html", "body"):
                out = True
            open_.push(name, inside, out)
        flush()
        return "\n".join(blocks), found


class Elements:
    """The open elements of a page, each with whether it is inside a main part and inside what is no content; HTML's implied ends close them."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []
        self.count: dict[str, int] = {}

    @property
    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def push(self, name: str, inside: bool, out: bool) -> None:
        self.stack.append((name, inside, out))
        self.count[name] = self.count.get(name, 0) + 1

    def _cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.count[self.stack.pop()[0]] -= 1

    def _end(self, names: frozenset, scope: frozenset, *, outermost: bool = False) -> None:
        """End the innermost open element of these names (or the outermost one) that lies within the scope, with all in it."""
        if not any(self.count.get(n) for n in names):
            return
        at = None
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in names:
                at = k
                if not outermost:
                    break
            elif name in scope:
                break
        if at is not None:
            self._cut(at)

    def end_head(self) -> None:
        if self.count.get("head"):
            self._end(frozenset(["head"]), frozenset(["body"]))

    def imply(self, name: str) -> None:
        """End what a start tag of this name ends."""
        if name not in HEAD:
            self.end_head()
        if name in IMPLIED:
            names, scope = IMPLIED[name]
            self._end(names, scope, outermost=name in ("tr", "tbody", "thead", "tfoot", "optgroup"))
        if name in ENDS_P:
            self._end(frozenset(["p"]), SCOPE)
        if name in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self._cut(len(self.stack) - 1)

    def close(self, name: str) -> None:
        """End the element that an end tag names, if one is open within reach; a stray end tag ends nothing."""
        names = HEADINGS if name in HEADINGS else frozenset([name])
        if name in ("body", "html"):
            self._end(names, frozenset())
        elif name in INLINE:
            if self.count.get(name):
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] == name:
                        self._cut(k)
                        break
                    if self.stack[k][0] not in INLINE:
                        break
        elif name in CELL or name in ("tr", "tbody", "thead", "tfoot", "table"):
            self._end(names, TABLES - names)
        else:
            self._end(names, (LISTS if name == "li" else SCOPE) - names)


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, *, fan_in: int = 32) -> DataFrame:
    """host, wrapper (JSON), bare (whether a page of it has no named main part) for every host of (host, html) rows."""
    schema = "host string, wrapper string, bare boolean"

    def shapes(batches):
        seen: set[tuple[str, str]] = set()
        for whole in batches:
            for x in pieces_of(whole, "html"):
                new = []
                for h, text in zip(x.column("host").to_pylist(), x.column("html").to_pylist(), strict=True):
                    stream = tokens(text or "")
                    found = shape(stream)
                    pair = (h, json.dumps(found, ensure_ascii=False))
                    if pair not in seen:
                        new.append((*pair, Parser(found).main(stream) is None))
                        if len(seen) < 100_000:
                            seen.add(pair)
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in new], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_()))], ["host", "wrapper", "bare"])

    def merge(rows: pa.Table) -> pa.Table:
        wrappers = sorted(set(rows.column("wrapper").to_pylist()), key=lambda w: (len(w), w))
        found = json.loads(wrappers[0])
        for w in wrappers[1:]:
            found = align(found, json.loads(w))
        return pa.table({"host": [rows.column("host")[0].as_py()], "wrapper": [json.dumps(found, ensure_ascii=False)], "bare": [any(rows.column("bare").to_pylist())]})

    left = stored(arrow_map(pages, shapes, schema).distinct(), "shapes")
    while True:
        counts = left.groupBy("host").count()
        most = counts.agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return left
        part = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("count") / fan_in)).alias("part")
        left = stored(left.join(counts, "host").select("host", "wrapper", "bare", part).groupBy("host", "part").applyInArrow(merge, schema), "wrappers")


def parsers():
    """Parsers by wrapper, kept while there are not too many."""
    known: dict[str, Parser] = {}

    def of(wrapper: str | None) -> Parser | None:
        if wrapper and wrapper not in known:
            if len(known) > 5_000:
                known.clear()
            known[wrapper] = Parser(json.loads(wrapper))
        return known.get(wrapper) if wrapper else None

    return of


def infer_constants(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, constants (JSON of [slot, digest] pairs) of bare hosts: texts on every page that fills their slot.

    Equal pages count as one; the slot must be filled on two pages and on over half of its host's pages.
    """

    def run(batches):
        of = parsers()
        for whole in batches:
            for x in pieces_of(whole, "html"):
                rows = []
                for h, page, wrapper in zip(*(x.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
                    stream, parser = tokens(page or ""), of(wrapper)
                    bound = parser.bind(stream) if parser else None
                    if bound is not None:
                        key = digest(page or "")
                        rows.extend((h, k, t, key) for k, t in {(s[0], digest(s[1])) for s in parser.slots(stream, bound) if s})
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["host", "slot", "text", "page"])

    bound = arrow_map(pages.join(wrappers.where("bare").select("host", "wrapper"), "host").select("host", "html", "wrapper"), run, "host string, slot long, text long, page long")
    bound = stored(bound.distinct(), "bound")
    texts = bound.groupBy("host", "slot", "text").agg(F.count("*").alias("n")).where("n >= 2")
    slots = bound.select("host", "slot", "page").distinct().groupBy("host", "slot").agg(F.count("*").alias("n"))
    all_pages = bound.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    found = texts.join(slots, ["host", "slot", "n"]).join(all_pages, "host").where("2 * n > n_pages")
    return found.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.array("slot", "text")))).alias("constants"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars, matched (whether its host's wrapper took it)."""
    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    wrappers = infer_wrappers(rows.select("host", "html"))
    if wrappers.where("bare").limit(1).count():
        wrappers = wrappers.join(infer_constants(rows.select("host", "html"), wrappers), "host", "left")
    else:
        wrappers = wrappers.withColumn("constants", F.lit(None).cast("string"))

    def run(batches):
        of = parsers()
        last, constants = None, frozenset()
        for whole in batches:
            for x in pieces_of(whole, "html"):
                texts, matched = [], []
                for page, wrapper, said in zip(*(x.column(c).to_pylist() for c in ("html", "wrapper", "constants")), strict=True):
                    if said != last:
                        last, constants = said, frozenset(map(tuple, json.loads(said or "[]")))
                    stream = tokens(page or "")
                    parser = of(wrapper)
                    bound = parser.bind(stream) if parser else None
                    matched.append(bound is not None)
                    texts.append(parser.texts(stream, bound, constants) if matched[-1] else Parser(shape(stream)).texts(stream))
                yield pa.RecordBatch.from_arrays(
                    [x.column(id_col), x.column(url_col), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(matched, pa.bool_())], [id_col, url_col, "text", "n_chars", "matched"]
                )

    joined = rows.join(wrappers, "host", "left").select(id_col, url_col, "html", "wrapper", "constants")
    return arrow_map(joined, run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long, matched boolean")


#: The driver's pages have one kind of article, for which SQL can say what is to come out.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, list_transform(regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1|br)>'), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) AS b FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS t FROM a)
SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS text,
  length(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS n_chars, TRUE AS matched FROM t
"""
