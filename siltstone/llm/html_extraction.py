"""Operator 9, main text of web pages by wrappers inferred from pages of one host.

Pages of a host come from one template with data put in. A page is a stream of tag and text tokens. Starting from one page,
the wrapper is aligned with further pages of the host (at most SAMPLE, picked by hash) and mismatches generalise it: two
different texts become a text slot; where one side goes on with another element like the last one, that element becomes a
repeated group; other tags that only one side has become an optional group. The result is a regular expression without
unions. Its slots and repeated groups hold the data. The main region of a host is the deepest container that holds all of
the slot text outside navigation, adverts, comments and their like (its article or main elements where they hold most). Every page
is matched against its wrapper and cut to that region: slots, optional and repeated groups stay, blocks of text that is constant
in the wrapper go, and so do elements named for boilerplate. Pages that match no wrapper are cut by the longer list of names;
pages with data outside the region, and hosts with a single page, fall back to the same choice of a region on the page.

Names of boilerplate are read in context: a class, id or role counts by its whole words, not behind with-, has- or no-; on
paragraphs, headings and other prose only words for adverts, consent and comments count; a header inside an article is part
of it; and a form, header or named element that holds most of the page's text, with its article, main and h1, is spared.

Defined results: null and empty html, and pages without text, give an empty text; an url that is null or has no host is the
host ''; repeated rows each get a row; unclosed elements end with their parent or the page, a head without end tag with its
first other element; an empty table gives no rows; other columns pass through, and ``main_text`` gets a free name (see
``common.free``) where the input has such a column. Text is never capped, and nesting may be of any depth.
"""

from __future__ import annotations

import bisect
import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import cut, free, table

SAMPLE, SHARE, LEAST, ALIKE, EFFORT = 12, 0.6, 4, 0.5, 64
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|canvas|title|textarea|select|annotation|annotation-xml)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_AWAY = set("header form fieldset".split())
_NEVER = set("nav footer aside menu dialog button".split())
_AWAY_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup sidebar side nav navbar navigation navigational menu breadcrumb breadcrumbs pagination pager header masthead footer foot complementary contentinfo search "
    "comment comments commentary reply replies respond disqus related recommended recommendations share sharing social toolbar widget login".split()
)
#: Words of a class, id or role that always mean boilerplate; the other listed words do only on pages that match no wrapper.
_SURE = set(
    "ad ads adv advert adverts advertisement advertising promo sponsored cookie cookies consent gdpr newsletter sidebar nav navbar navigation navigational breadcrumb breadcrumbs pagination pager "
    "masthead complementary contentinfo comment comments disqus related recommended recommendations share sharing social".split()
)
#: Of these, the words that count on prose elements too.
_LOUD = set("ad ads adv advert adverts advertisement advertising sponsored cookie cookies consent gdpr newsletter comment comments disqus".split())
_TALK = set("comment comments disqus reply replies respond commentary".split())
#: A word behind one of these says what a page has beside the element, or lacks.
_BESIDE = set("with has have no not without is hide show open".split())
_PROSE = set("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr figcaption caption".split())
_MAIN = ("article", "main")
#: Elements a main region may be; others, such as lists, tables and quotations, are parts of one.
_CONTAINERS = {"html", "body", "div", "section", "center", *_MAIN}
#: A start tag closes open elements of these names by itself.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


def _name(kind: str) -> str:
    return kind[1:].split(".")[0]


def _named_away(name: str, named: dict[str, str]) -> str:
    """'away' where the names of an element always mean boilerplate, 'talk' for reader comments, 'word' where they may."""
    found = set()
    for own in " ".join(named.values()).lower().split():
        words = re.split(r"[^a-z0-9]+", own)
        found.update(w for i, w in enumerate(words) if w in _AWAY_WORDS and not (i and words[i - 1] in _BESIDE))
    if name in _PROSE or name in _INLINE:
        found &= _LOUD
    return "talk" if found & _TALK else "away" if found & _SURE else "word" if found else ""


def tokens(page: str) -> list[tuple[str, str]]:
    """('<name.classes', boilerplate mark), ('>name', '') and ('', text); comments, scripts, styles and the head's tags are left out."""
    out = []
    for m in _TOKEN.finditer(page):
        skipped, close, name, attrs, text = m.groups()
        if text is not None:
            out.append(("", text))
        elif name and (name := name.lower()) != "head":
            if close:
                out.append((">" + name, ""))
                continue
            named = {k.lower(): (a or b or c) for k, a, b, c in _NAMED.findall(attrs)} if attrs else {}
            away = "" if name in ("html", "body", *_MAIN) else "never" if name in _NEVER else "away" if name in _AWAY else _named_away(name, named) if named else ""
            out.append((f"<{name}" + (f".{named['class'].strip()}" if named.get("class", "").strip() else ""), away))
    return out


def _same(a: tuple, b: tuple) -> bool:
    return a[0] == b[0] and a[0] not in ("(?", "(+")


def _ends(items: list) -> dict[int, int]:
    """Where each element ends: after the end tag that balances its name. Elements that nothing balances are left out."""
    open_: dict[str, list[int]] = {}
    out = {}
    for i, (kind, _) in enumerate(items):
        if kind.startswith("<"):
            open_.setdefault(_name(kind), []).append(i)
        elif kind.startswith(">") and open_.get(kind[1:]):
            out[open_[kind[1:]].pop()] = i + 1
    return out


def _last_element(items: list) -> int | None:
    """The start of the element that the last item ends."""
    if not items or not items[-1][0].startswith(">"):
        return None
    name, depth = items[-1][0][1:], 0
    for i in range(len(items) - 1, -1, -1):
        kind = items[i][0]
        depth += kind == ">" + name
        depth -= kind.startswith("<") and _name(kind) == name
        if not depth:
            return i
    return None


def _fits(body: list, items: list, at: int) -> tuple[int, list] | None:
    """Where ``body`` ends if the items from ``at`` match it, and the body with texts that differ made slots."""
    out, i = [], at
    for b in body:
        if b[0] in ("(?", "(+"):
            n = 0
            while (got := _fits(b[1], items, i)) and got[0] > i and (b[0] == "(+" or not n):
                i, b, n = got[0], (b[0], got[1]), n + 1
            out.append(b)
        elif b[0] in ("", "*"):
            if i < len(items) and items[i][0] in ("", "*"):
                out.append(b if b[0] == "*" or b[1] == items[i][1] and items[i][0] == "" else ("*", ""))
                i += 1
            else:
                return None
        elif i < len(items) and _same(b, items[i]):
            out.append(b)
            i += 1
        else:
            return None
    return i, out


def _grow_group(out: list, items: list, at: int, ends: dict[int, int]) -> int:
    """Make the last element of ``out`` a repeated group if the items from ``at`` go on with one like it; where they end."""
    if at >= len(items) or not items[at][0].startswith("<") or not out:
        return at
    if out[-1][0] == "(+":
        got = _fits(out[-1][1], items, at)
        if got and got[0] > at:
            out[-1] = ("(+", got[1])
            return got[0]
        return at
    end = ends.get(at, at)
    if end == at or out[-1][0] != ">" + _name(items[at][0]):
        return at
    start = _last_element(out)
    if start is not None and _same(out[start], items[at]):
        got = _fits(out[start:], items, at) or _fits(items[at:end], out, start)
        if got:
            out[start:] = [("(+", got[1])]
            return end
    return at


def _places(items: list) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, (kind, _) in enumerate(items):
        if kind not in ("(?", "(+"):
            out.setdefault(kind, []).append(i)
    return out


def _next(places: dict[str, list[int]], kind: str, after: int) -> int | None:
    found = places.get(kind, ())
    at = bisect.bisect_right(found, after)
    return found[at] if at < len(found) else None


def align(wrapper: list, page: list) -> list:
    """The wrapper generalised so that it also matches the page."""
    out: list = []
    i = j = 0
    w_ends, p_ends, w_places, p_places = _ends(wrapper), _ends(page), _places(wrapper), _places(page)
    while i < len(wrapper) and j < len(page):
        w, p = wrapper[i], page[j]
        if w[0] in ("(?", "(+"):
            n = 0
            while (got := _fits(w[1], page, j)) and got[0] > j and (w[0] == "(+" or not n):
                j, w, n = got[0], (w[0], got[1]), n + 1
            out.append(w if n or w[0] == "(?" else ("(?", [w]))
            i += 1
        elif w[0] in ("", "*") and p[0] == "":
            out.append(w if w[0] == "*" or w[1] == p[1] else ("*", ""))
            i, j = i + 1, j + 1
        elif _same(w, p):
            out.append(w)
            i, j = i + 1, j + 1
        elif w[0] in ("", "*"):
            out.append(("(?", [("*", "")]))
            i += 1
        elif p[0] == "":
            out.append(("(?", [("*", "")]))
            j += 1
        elif (end := _grow_group(out, page, j, p_ends)) > j:
            j = end
        elif (end := _grow_group(out, wrapper, i, w_ends)) > i:
            i = end
        else:
            in_page, in_wrapper = _next(p_places, w[0], j), _next(w_places, p[0], i)
            if in_wrapper is not None and (in_page is None or in_wrapper - i <= in_page - j):
                out.append(("(?", wrapper[i:in_wrapper]))
                i = in_wrapper
            elif in_page is not None:
                out.append(("(?", page[j:in_page]))
                j = in_page
            else:
                out += [("(?", [w]), ("(?", [p])]
                i, j = i + 1, j + 1
    if i < len(wrapper):
        return out + [("(?", wrapper[i:])]
    while j < len(page) and (end := _grow_group(out, page, j, p_ends)) > j:
        j = end
    return out + ([("(?", page[j:])] if j < len(page) else [])


def infer(pages: list[str]) -> list:
    """The wrapper of pages of one host."""
    streams = [t for t in ([x for x in tokens(p) if x[0] or x[1].strip()] for p in pages) if t]
    wrapper = streams[0] if streams else []
    for page in streams[1:]:
        wrapper = align(wrapper, page)
    return wrapper


class Tree:
    """Paths of open elements as numbers: each is its parent's number and its last element. 0 is the empty path."""

    def __init__(self):
        self.parent, self.kind, self.depth, self.number = [0], [""], [0], {}

    def child(self, of: int, kind: str) -> int:
        found = self.number.get((of, kind))
        if found is None:
            found = self.number[of, kind] = len(self.parent)
            self.parent.append(of)
            self.kind.append(kind)
            self.depth.append(self.depth[of] + 1)
        return found

    def path(self, node: int) -> list[str]:
        out = []
        while node:
            out.append(self.kind[node])
            node = self.parent[node]
        return out[::-1]

    def node(self, path: list[str]) -> int | None:
        """The number of a path, None where nothing of the page has it."""
        at = 0
        for kind in path:
            at = self.number.get((at, kind), -1)
            if at < 0:
                return None
        return at

    def inside(self, goals: set[int], known: dict[int, bool], node: int) -> bool:
        """Whether a goal is the node or above it."""
        way = []
        while node not in known and node not in goals and node:
            way.append(node)
            node = self.parent[node]
        found = known[node] if node in known else node in goals
        known.update(dict.fromkeys(way, found))
        return found


def paths(items: list, tree: Tree) -> list[tuple[int, int, str]]:
    """(path, away: 0 if not, 1 by a listed word, 2 for sure, text) for each text of a token stream; the end of a block is -1, 0 and a newline."""
    # Elements: path, mark, parent, length of the text, has a main element or first heading.
    own: list[list] = [[0, "", 0, 0, False]]
    stack, open_, found = [0], Counter(), []
    for kind, value in items:
        if kind == "":
            found.append((stack[-1], value))
            own[stack[-1]][3] += len(value.strip())
            continue
        name = _name(kind)
        if kind[0] == "<":
            closes = _ENDS.get(name, set()) | ({"p"} if name in _BLOCKS_P else set())
            while len(stack) > 1 and any(open_[x] for x in closes) and _name(tree.kind[own[stack[-1]][0]]) in closes | _INLINE:
                open_[_name(tree.kind[own[stack.pop()][0]])] -= 1
            if name not in _VOID:
                # A header of an article is part of it.
                mark = "" if name == "header" and any(open_[x] for x in _MAIN) else value
                own.append([tree.child(own[stack[-1]][0], kind), mark, stack[-1], 0, name == "h1" or name in _MAIN])
                stack.append(len(own) - 1)
                open_[name] += 1
        elif open_[name]:
            while (last := _name(tree.kind[own[stack.pop()][0]])) != name:
                open_[last] -= 1
            open_[name] -= 1
        if name not in _INLINE or name == "wbr":
            found.append((-1, "\n"))
    away = _away(own)
    return [(-1, 0, text) if at < 0 else (own[at][0], away[at], text) for at, text in found]


def _away(own: list[list]) -> list[int]:
    """How surely each element is boilerplate, after sparing those that hold what the page is about: more than half of its text,
    every main element and first heading, and far more than what no name marks."""
    marked = [False]
    for _, mark, parent, *_ in own[1:]:
        marked.append(bool(mark) or marked[parent])
    length, bare, held = [e[3] for e in own], [e[3] for e in own], [int(e[4]) for e in own]
    for at in range(len(own) - 1, 0, -1):
        parent = own[at][2]
        length[parent] += length[at]
        held[parent] += held[at]
        bare[parent] += 0 if own[at][1] else bare[at]
    free_text, out = bare[0], [0]
    for at, (_, mark, parent, *_) in enumerate(own[1:], 1):
        spared = mark and mark != "never" and 2 * length[at] > length[0] and (not free_text and held[0] if mark == "talk" else free_text < length[at] if held[0] else free_text * 4 < length[at]) and held[at] == held[0]
        if spared and not out[parent]:
            free_text += bare[at]
        out.append(max(out[parent], 0 if not mark or spared else 1 if mark == "word" else 2))
    return out


def _flat(wrapper: list) -> Iterator[tuple[str, str]]:
    """The wrapper's tokens with each group once; constant texts of all pages, which are the template's own, are left out."""
    for kind, value in wrapper:
        if kind in ("(?", "(+"):
            yield from _flat([("*", "") if k == "" else (k, v) for k, v in value])
        elif kind == "*":
            yield "", "*"
        elif kind:
            yield kind, value


def region(weights: Counter, tree: Tree) -> set[int]:
    """The paths of the outermost article or main elements if these hold SHARE of the weight; else the deepest container of
    all of it, so that lists, tables, quotations and sibling sections stay with the paragraphs beside them."""
    held = [p for p, n in weights.items() if n]
    named = {}
    for p in held:
        at, top = p, 0
        while at:
            top = at if _name(tree.kind[at]) in _MAIN else top
            at = tree.parent[at]
        named[p] = top
    if sum(weights[p] for p in held if named[p]) >= SHARE * sum(weights.values()) > 0:
        return {named[p] for p in held if named[p]}
    if not held:
        return set()
    common = held[0]
    for p in held[1:]:
        while common != p:
            if tree.depth[common] >= tree.depth[p]:
                common = tree.parent[common]
            else:
                p = tree.parent[p]
    while common and _name(tree.kind[common]) not in _CONTAINERS:
        common = tree.parent[common]
    return {common}


def _weights(texts: list[tuple[int, int, str]], slots: set | None = None) -> Counter:
    weights: Counter = Counter()
    for path, away, text in texts:
        if path >= 0 and not away and (slots is None or path in slots):
            weights[path] += len(text.strip())
    return weights


def program(wrapper: list) -> list[list]:
    """The wrapper as steps: ["t", its text where constant in all pages, else null], ["<", tag] and ["|", first way, second way]."""
    steps: list = []

    def add(items: list, always: bool) -> None:
        for kind, value in items:
            if kind == "(?":
                at = len(steps)
                steps.append(None)
                add(value, False)
                steps[at] = ["|", at + 1, len(steps)]
            elif kind == "(+":
                at = len(steps)
                add(value, False)
                steps.append(["|", at, len(steps) + 1])
            else:
                steps.append(["t", value if always and kind == "" else None] if kind in ("", "*") else ["<", kind])

    add(wrapper, True)
    return steps


def match(steps: list[list], items: list[tuple[str, str]]) -> set[int] | None:
    """The places of a page's items that are the wrapper's constant texts; None if the page does not match the wrapper. A
    search that visits each (step, item) once, and EFFORT times their numbers at most."""
    n, m, limit = len(items), len(steps), EFFORT * (len(items) + len(steps))
    seen: dict = {}
    stack: list = [((0, 0), None)]
    while stack and len(seen) < limit:
        state, before = stack.pop()
        if state in seen:
            continue
        seen[state] = before
        at, i = state
        if at == m:
            if i < n:
                continue
            constant = set()
            while before is not None:
                if before[1] < i and steps[before[0]][0] == "t" and steps[before[0]][1] == items[before[1]][1]:
                    constant.add(before[1])
                i, before = before[1], seen[before]
            return constant
        kind, *value = steps[at]
        if kind == "|":
            stack += [((value[1], i), state), ((value[0], i), state)]
        elif i < n and (items[i][0] == "" if kind == "t" else items[i][0] == value[0]):
            stack.append(((at + 1, i + 1), state))
    return None


def alike(pages: list[str]) -> list[str]:
    """The distinct pages that share ALIKE of their tags with the page most like the others: a page of another template would make
    all of the wrapper optional."""
    shown = {tuple(x for x in tokens(page) if x[0] or x[1].strip()): page for page in sorted(set(pages), reverse=True)}
    tags = {page: {kind for kind, _ in items if kind} for items, page in shown.items()}
    near = {a: [b for b in tags if len(tags[a] & tags[b]) >= ALIKE * len(tags[a] | tags[b])] for a in tags}
    return sorted(max(near.values(), key=lambda found: (len(found), min(found)), default=[]))


def wrapper_of(pages: list[str]) -> dict:
    """What reading a page of the host takes: ``main``, the region of the slots by the text that pages have there, and ``steps``."""
    own = alike(pages)
    if len(own) < 2:
        return {}
    wrapper, tree = infer(own), Tree()
    slots = {path for path, away, _ in paths(list(_flat(wrapper)), tree) if path >= 0 and not away}
    # A few pages may share a paragraph by chance, so texts are constant in LEAST pages or more.
    steps = [["t", None] if step[0] == "t" and len(own) < LEAST else step for step in program(wrapper)]
    main = region(sum((_weights(paths(tokens(page), tree), slots) for page in own), Counter()), tree)
    return {"main": sorted(tree.path(g) for g in main), "steps": steps} if main else {}


def _without(items: list, constant: set[int]) -> list:
    """The items without blocks all of whose text is constant; a constant word beside a slot in one paragraph stays."""
    out, block = list(items), []
    for i, (kind, text) in enumerate([*items, (">", "")]):
        if not kind:
            block += [i] if text.strip() else []
        elif _name(kind) not in _INLINE or kind[1:] == "wbr":
            for at in block if constant.issuperset(block) else ():
                out[at] = ("", " ")
            block = []
    return out


def main_text(page: str | None, main: list, steps: list | None = None) -> str:
    """The text of a page inside ``main``, or inside the page's own region where text that is no boilerplate lies outside. Where
    the page matches the wrapper, blocks of constant text are left out and only sure words mark boilerplate."""
    items = tokens(page or "")
    places = [i for i, (kind, text) in enumerate(items) if kind or text.strip()]
    constant = match(steps, [items[i] for i in places]) if steps else None
    if constant:
        items = _without(items, {places[i] for i in constant})
    fixed = {value for kind, value, *_ in steps or () if kind == "t" and value}
    least, tree = 1 if constant is None else 2, Tree()
    found = paths(items, tree)
    data = [(path, away, text) for path, away, text in found if path >= 0 and not away and text.strip() and text not in fixed]
    goal = {at for g in main if (at := tree.node(g)) is not None}
    known: dict[int, bool] = {}
    held = [tree.inside(goal, known, path) for path, _, _ in data]
    if not any(held) or not all(held) and not all(g and _name(g[-1]) in _MAIN for g in main):
        goal, known = region(_weights(data or found), tree), {}
    kept = [text if path < 0 else entities.unescape(text) if away < least and tree.inside(goal, known, path) else "" for path, away, text in found]
    return " ".join("".join(kept).split())


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def extract(pages: DataFrame, page: str = "html", url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """``pages`` with ``main_text`` (a free name)."""
    hosts = pages.select(host_of(F.col(url)).alias("__host"), F.col(page).alias("__html")).where("__html is not null")
    # Hashes are made distinct first, so copies of a page take one place. Their count a host, added up in each task, gives the share
    # of its hashes that leaves about three times ``sample`` of them, so a hot host is no large group anywhere.
    hashes = cut(hosts.select("__host", F.xxhash64("__html").alias("__hash")).distinct(), "page-hashes")
    counts = cut(hashes.groupBy("__host").agg(F.count("*").alias("__n")), "host-pages")
    share = F.pmod(F.xxhash64("__hash", F.lit(7)), F.lit(1 << 24)) * F.col("__n") < F.lit(3 * sample).cast("long") * (1 << 24)
    few = hashes.join(counts, "__host").where(share).withColumn("n", F.row_number().over(Window.partitionBy("__host").orderBy("__hash")))
    least = cut(few.where(F.col("n") <= sample).select("__host", "__hash"), "picked-pages")
    held = hosts.withColumn("__hash", F.xxhash64("__html")).join(least, ["__host", "__hash"])
    picked = held.groupBy("__host", "__hash").agg(F.min("__html").alias("__html"))

    def learn(of: pd.DataFrame) -> pd.DataFrame:
        wrapper = json.dumps(wrapper_of(of["__html"].to_list())).encode()
        return pd.DataFrame({"__host": [of["__host"].iloc[0]], "__main": [zlib.compress(wrapper)]})

    # Written, so that Spark knows its size and broadcasts it only below its threshold.
    wrappers = cut(picked.groupBy("__host").applyInPandas(learn, "__host string, __main binary"), "wrappers")

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for own, mains in batches:
            known = {m: json.loads(zlib.decompress(m)) for m in set(mains) if m}
            yield pd.Series([main_text(h, w.get("main", []), w.get("steps")) for h, w in ((h, known.get(m, {})) for h, m in zip(own, mains, strict=True))], dtype=object)

    return pages.withColumn("__host", host_of(F.col(url))).join(wrappers, "__host", "left").withColumn(free(pages, "main_text"), read(F.col(page), F.col("__main"))).drop("__host", "__main")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
SQL: dict[str, str] = {}
