"""Main text of web pages by wrappers inferred per host.

A page becomes a stream of tokens whose tags are repaired into a tree; tags within
running text are dropped. Same-host streams are aligned one after the other into
a wrapper, a regular expression without unions: equal tokens stay, a mismatch becomes
an optional part, parts that follow themselves become a repeated part, and texts
that differ become slots. A constant text that recurs on ``RECURS`` or more different
pages of its host is template and is left out, as long as the varying slots hold more
text. The slots that are left are classed by the parts around them, and a page's text is
what fills the slots of the article. Where all that varies on a host stands in parts whose
class words say aside, those parts are read instead.

Wrappers are merged in three steps (the pages of a task, the tasks' wrappers dealt
into ``MERGE_WAYS`` parts for each host, those parts), so a host with a third of all
pages is never in one task. They go to the pages by broadcast where all of them are
below ``BROADCAST_BYTES`` and by an equi-join else.

Defined results: null or empty html gives empty text; pages without host (null or odd
url) share one wrapper; repeated rows are extracted each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promospark.llm.common import cut, ship_package, text_or_empty

MERGE_WAYS = 16
HOSTS_AT_ONCE = 2000
BROADCAST_BYTES = 8 << 20
#: Longer constants are kept by their digest.
CONSTANT_CHARS = 60
#: Different pages of a host that make a constant text template.
RECURS = 3

# Names of elements by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style title textarea xmp".split())
ASIDE = frozenset("nav footer aside form script style noscript template button select iframe svg menu dialog head title "
                  "object canvas audio video textarea".split())
ASIDE_WORDS = frozenset("nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement banner "
                        "sponsor sponsored promo cookie cookies consent notice notices popup modal newsletter subscribe "
                        "share sharing social related recommended comment comments reply replies breadcrumb breadcrumbs "
                        "pagination login search widget disclaimer".split())
#: Elements that hold the page's text whatever their class words say.
WHOLE = frozenset("html body article main".split())
MAIN_WORDS = frozenset("content article post entry main story".split())
#: Elements that end an open one of the named kinds, up to the kinds that hold them (fixed values).
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
                   r"|(?P<text>[^<]+|<)", re.S)
MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    __slots__ = ("symbol", "name", "children")

    def __init__(self, symbol: str, name: str):
        self.symbol, self.name, self.children = symbol, name, []


class Text:
    __slots__ = ("parts", "link_chars")

    def __init__(self):
        self.parts, self.link_chars = [], 0

    def value(self) -> str:
        return " ".join("".join(self.parts).split())


def symbol_of(name: str, more: str) -> str:
    marks = sorted({w for m in MARKS.finditer(more) for w in (m[2] or m[3] or m[4] or "").lower().split()}) if more else []
    return ".".join([name, *(w.replace("/", "_").replace(".", "_") for w in marks)])


def parse(html: str) -> Node:
    """The page's tree; unclosed elements end where their parents or followers need it."""
    root = Node("", "")
    stack, links, at = [root], 0, 0
    opened: Counter[str] = Counter()  # names on the stack

    def close(size: int) -> None:
        while len(stack) > size:
            opened[stack.pop().name] -= 1

    while at < len(html):
        token = TOKEN.match(html, at)
        at = token.end()
        if token["text"] is not None:
            children = stack[-1].children
            if not children or not isinstance(children[-1], Text):
                children.append(Text())
            text = html_lib.unescape(token["text"])
            children[-1].parts.append(text)
            if links:
                children[-1].link_chars += len(text)
            continue
        if token["name"] is None:
            continue
        name = token["name"].lower()
        if token["end"]:
            if name == "a":
                links = max(0, links - 1)
            elif name == "p" and stack[-1].name != "p":
                stack[-1].children.append(Node("/p", "/p"))  # an end without a start still parts blocks
            elif name not in INLINE and opened[name]:
                while stack[-1].name != name:
                    close(len(stack) - 1)
                close(len(stack) - 1)
                links = 0
        elif name in VOID:
            if name in ("br", "hr"):
                stack[-1].children.append(Node(name, name))
        elif name in INLINE:
            links += name == "a"
        else:
            links = 0
            if stack[-1].name == "p":
                close(len(stack) - 1)
            if name in CLOSES and any(opened[x] for x in CLOSES[name][0]):
                ended, holders = CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in holders:
                        break
                    if stack[k].name in ended:
                        close(k)
                        break
            node = Node(symbol_of(name, token["more"]), name)
            stack[-1].children.append(node)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif not token["more"].endswith("/"):
                stack.append(node)
                opened[name] += 1
    return root


# A wrapper part is [symbol, how often, parts] or, for text, ["#", how often, constant or None, characters, in links,
# pages]; a repeated group has the symbol "()". How often: "1", "?", "+" or "*". Pages are the least digests, at most
# RECURS of them, of the pages that hold the constant, so copies of a page count once.

def constant(value: str) -> str:
    return value if len(value) <= CONSTANT_CHARS else "\0" + hashlib.blake2b(value.encode(), digest_size=16).hexdigest()


def page_digest(html: str) -> int:
    return int.from_bytes(hashlib.blake2b(html.encode(), digest_size=6).digest())



def _often(a: str, b: str) -> str:
    least_none = a in "?*" or b in "?*"
    many = a in "+*" or b in "+*"
    return "*" if least_none and many else "?" if least_none else "+" if many else "1"


def room_for(levels: int) -> None:
    """Let ``merge`` recurse into trees of that many levels: a few frames each, which Python keeps on its heap."""
    if 8 * levels + 1000 > sys.getrecursionlimit():
        sys.setrecursionlimit(8 * levels + 1000)


def of_page(node: Node, page: int = 0) -> list:
    """The page's tree as a wrapper; children before parents, on a stack of (node, level, parts so far, parts of its
    parent)."""
    whole: list = []
    waiting = [(node, 1, None, whole)]
    deepest = 1
    while waiting:
        node, level, parts, into = waiting.pop()
        if isinstance(node, Text):
            value = node.value()
            if value:
                into.append(["#", "1", constant(value), len(value), node.link_chars, [page]])
        elif parts is not None:
            room_for(deepest)
            into.append([node.symbol, "1", fold(parts)])
        elif node.name not in ("br", "hr", "/p"):
            parts, deepest = [], max(deepest, level)
            waiting.append((node, level, parts, into))
            waiting += [(c, level + 1, None, parts) for c in reversed(node.children)]
    return whole[0]


def stored(wrapper: list) -> str:
    """The wrapper as flat JSON: parts in order, each with the number of parts in it in place of them."""
    out, waiting = [], [wrapper]
    while waiting:
        part = waiting.pop()
        if part[0] == "#":
            out.append(part)
        else:
            out.append([part[0], part[1], len(part[2])])
            waiting += reversed(part[2])
    return json.dumps(out)


def restored(text: str) -> list:
    whole: list = []
    waiting = [(whole, 1)]  # parts to be filled, and how many are missing
    deepest = 1
    for part in json.loads(text):
        deepest = max(deepest, len(waiting))
        into, missing = waiting.pop()
        waiting.append((into, missing - 1))
        into.append(part)
        if part[0] != "#":
            count, part[2] = part[2], []
            waiting.append((part[2], count))
        while waiting and not waiting[-1][1]:
            waiting.pop()
    room_for(deepest)
    return whole[0]


def _key(part: list) -> str:
    return part[0] if part[0] != "()" else "(" + " ".join(_key(p) for p in part[2]) + ")"


def merge(a: list, b: list) -> list:
    often = _often(a[1], b[1])
    if a[0] == "#":
        same = a[2] is not None and a[2] == b[2]
        return ["#", often, a[2] if same else None, a[3] + b[3], a[4] + b[4],
                sorted({*a[5], *b[5]})[:RECURS] if same else []]
    return [a[0], often, align(a[2], b[2])]


def fold(parts: list) -> list:
    """Parts that follow themselves, alone or in groups of two or three, become repeated parts."""
    out: list = []
    for part in parts:
        out.append(part)
        if len(out) > 1 and _key(out[-1]) == _key(out[-2]):
            last = out.pop()
            out[-1] = merge(out[-1], last)
            out[-1][1] = "*" if out[-1][1] in "?*" else "+"
            continue
        for size in (2, 3):
            tail = out[-size:]
            if len(out) > size and out[-size - 1][0] == "()" and _key(out[-size - 1]) == _key(["()", "1", tail]):
                del out[-size:]
                out[-1][2] = [merge(x, y) for x, y in zip(out[-1][2], tail)]
                break
            if len(out) >= 2 * size and [_key(x) for x in out[-2 * size:-size]] == [_key(x) for x in tail]:
                pairs = [merge(x, y) for x, y in zip(out[-2 * size:-size], tail)]
                del out[-2 * size:]
                out.append(["()", "+", pairs])
                break
    return out


def align(a: list, b: list) -> list:
    """Align two streams of parts by their longest common subsequence; what only one has is optional."""
    if [_key(x) for x in a] == [_key(x) for x in b]:
        return [merge(x, y) for x, y in zip(a, b)]
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    best = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
    for i in range(len(ka) - 1, -1, -1):
        for j in range(len(kb) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(ka) or j < len(kb):
        if i < len(ka) and j < len(kb) and ka[i] == kb[j]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        if j == len(kb) or (i < len(ka) and best[i + 1][j] >= best[i][j + 1]):
            alone, i = a[i], i + 1
        else:
            alone, j = b[j], j + 1
        out.append([alone[0], "*" if alone[1] in "+*" else "?", *alone[2:]])
    return fold(out)


def _aside(symbol: str, inside_article: bool) -> bool:
    name = symbol.split(".")[0]
    return name in ASIDE or (name == "header" and not inside_article)


def _named_aside(symbol: str) -> bool:
    name, *marks = symbol.split(".")
    return name not in WHOLE and any(w in ASIDE_WORDS for m in marks for w in re.split(r"[-_]", m))


class Slots:
    """Paths of a wrapper, numbered by ``steps`` from (path, symbol), and ``where``: for the paths of text slots,
    their rank and their template constants."""

    def __init__(self, steps: dict[tuple[int, str], int], tiers: list[dict[int, set[str]]]):
        self.steps, self.ranks = steps, len(tiers)
        self.where = {path: (k, dropped) for k, tier in enumerate(tiers) for path, dropped in tier.items()}


def slot_paths(wrapper: list) -> Slots:
    """The text slots: in articles, in main parts, and elsewhere with little link text; before them the same in
    parts that only their class words call aside, if nothing else varies."""
    tiers: list[dict[int, set[str]]] = [{} for _ in range(6)]
    chars, varying, template = [0] * 6, [0] * 6, [0] * 6
    steps: dict[tuple[int, str], int] = {}
    waiting = [(child, 0, 2) for child in wrapper[2]]
    while waiting:
        part, path, tier = waiting.pop()
        if part[0] == "#":
            if tier % 3 < 2 or 2 * part[4] < part[3]:
                dropped = tiers[tier].setdefault(path, set())
                chars[tier] += part[3]
                if part[2] is None:
                    varying[tier] += part[3]
                elif len(part[5]) >= RECURS:
                    template[tier] += part[3]
                    dropped.add(part[2])
        elif part[0] == "()":
            waiting += [(child, path, tier) for child in part[2]]
        elif not _aside(part[0], tier % 3 == 0):
            named = _named_aside(part[0])
            if named and tier >= 3:
                continue
            name, *marks = part[0].split(".")
            words = {w for m in marks for w in re.split(r"[-_]", m)}
            own = 0 if name == "article" or "article" in words else 1 if name == "main" or words & MAIN_WORDS else 2
            tier = 3 + own if named else tier - tier % 3 + min(tier % 3, own)
            path = steps.setdefault((path, part[0]), len(steps) + 1)
            waiting += [(child, path, tier) for child in part[2]]
    if not sum(varying[:3]) and sum(varying[3:]) > sum(chars[:3]):
        used = [3, 4, 5, 0, 1, 2]
    else:
        used = [0, 1, 2]
    if sum(varying[t] for t in used) <= sum(template[t] for t in used):
        return Slots(steps, [{path: set() for path in tiers[t]} for t in used])
    return Slots(steps, [tiers[t] for t in used])


def extract(page: Node, slots: Slots) -> str:
    """The blocks that fill the article's slots, or those of the next best parts."""
    found: list[list[str]] = [[] for _ in range(slots.ranks)]
    waiting = [(page, 0)]
    while waiting:
        node, path = waiting.pop()
        if isinstance(node, Text):
            value = node.value()
            k, dropped = slots.where[path]
            if value and not (dropped and constant(value) in dropped):
                found[k].append(value)
            continue
        for child in reversed(node.children):
            if isinstance(child, Text):
                if path in slots.where:
                    waiting.append((child, path))
            elif (path, child.symbol) in slots.steps:
                waiting.append((child, slots.steps[path, child.symbol]))
    return "\n".join(next((blocks for blocks in found if blocks), []))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    way = TaskContext.get().partitionId() % MERGE_WAYS
    known: dict[str | None, list] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(known), pa.string()), pa.array([way] * len(known), pa.int32()),
             pa.array([stored(w) for w in known.values()], pa.string())], names=["host", "way", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            wrapper = of_page(parse(page), page_digest(page))
            known[host] = merge(known[host], wrapper) if host in known else wrapper
            if len(known) >= HOSTS_AT_ONCE:
                yield out()
                known.clear()
    if known:
        yield out()


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    wrapper = None
    for text in parts["wrapper"]:
        other = restored(text)
        wrapper = other if wrapper is None else merge(wrapper, other)
    return parts.iloc[:1].assign(wrapper=stored(wrapper))[["host", "way", "wrapper"]]


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots: dict[str, Slots] = {}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
            if wrapper not in slots:
                if len(slots) >= HOSTS_AT_ONCE:
                    slots.clear()
                slots[wrapper] = slot_paths(restored(wrapper))
            texts.append(extract(parse(page), slots[wrapper]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                         names=["page_id", "url", "text"])


def host_of(url_col: str):
    return F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from rows (host, html)."""
    ship_package(pages.sparkSession)
    schema = "host string, way int, wrapper string"
    parts = pages.select("host", "html").mapInArrow(_infer, schema)
    parts = parts.groupBy("host", "way").applyInPandas(_merged, schema)
    return parts.groupBy("host").applyInPandas(_merged, schema).drop("way")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(host_of(url_col), F.lit("")).alias("host"), text_or_empty(html_col).alias("html"))
    wrappers = cut(infer_wrappers(rows)).withColumnRenamed("host", "wrapper_host")
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("wrapper_host") + 64)).first()[0] or 0
    side = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers
    texts = (rows.join(side, F.col("host") == F.col("wrapper_host"))
             .select("page_id", "url", "html", "wrapper")
             .mapInArrow(_extractor, "page_id bigint, url string, text string"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
