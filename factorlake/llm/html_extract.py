"""Main text of web pages by union-free wrappers, inferred per host.

Pages of one host are token streams made by one template. A wrapper starts as one page's stream, with runs of equal
neighbouring groups folded into repeated groups, and is aligned with the next page's stream again and again: texts that
differ become slots, and tokens that only one side has become optional groups. The wrapper never holds a union. It then
names the host's main region: the article or main element, or else the smallest element that holds all slot text outside
menus, headers, footers, sidebars, notices, adverts, forms and comments (never a list, table, pre or quotation). Every page
is read whole, by its template's region; a page that has less than half of its text there is its own template.

Wrappers are inferred from all pages: a template is a host and a page's own region, and has a wrapper of its own. Tasks merge
pages of equal shape, and the shapes of a template are aligned in their order, first by `BUCKETS` groups. Regions are
broadcast while the hosts that need them are within `broadcast_limit`, and joined by a shuffle beyond it.

Defined results: null or empty html gives an empty text; a null url is a host of its own; repeated rows are read each on
its own; unclosed, misnested and cut off markup is read as far as it goes; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import md5
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BROADCAST_LIMIT = 100_000
BUCKETS = 64  # groups of shapes of one template that are aligned apart before they meet
HELD_NODES = 300_000  # nodes that a task holds at once

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# fixed values: element names of the HTML standard by their role
RAW = frozenset("script style textarea title noscript template iframe svg object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
NOISE_TAGS = frozenset("nav aside form footer head select option button".split()) | RAW
OUTER_NOISE_TAGS = frozenset("header menu dialog fieldset label input".split())  # noise outside an article or main only
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
# words of class and id that name what is no article; the weak ones give way where hardly any text is left without them
STRONG_WORDS = frozenset("ad ads advert adverts advertisement adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr comment comments commentlist reply replies disqus newsletter subscribe signup login pagination pager".split())
WEAK_WORDS = frozenset("sidebar side header masthead topbar notice notices alert popup modal overlay related share sharing social search widget toolbar".split())
STATE_WORDS = frozenset("has with no is without not js open closed visible enabled disabled".split())  # a token that tells of a state, not of a part


def _attrs(s: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(s)} if s.strip(" /") else {}


def _noise(tag: str, at: dict[str, str], inside: bool) -> bool:
    """What is no article for certain: by the element, its role, or as it is hidden."""
    if tag in NOISE_TAGS or (tag in OUTER_NOISE_TAGS and not inside):
        return True
    return bool(at) and (at.get("role", "").lower() in NOISE_ROLES or "hidden" in at or at.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", at.get("style", ""))))


def _suspect(tag: str, at: dict[str, str]) -> int:
    """2 and 1 for strong and weak words of class and id, 0 for none."""
    if not at:
        return 0
    tokens = [set(re.split(r"[^a-z0-9]+", x)) for x in f"{at.get('class', '')} {at.get('id', '')}".lower().split()]
    words = set().union(*[x for x in tokens if len(x) == 1 or not x & STATE_WORDS], set())
    if tag in ("html", "body", "article", "main"):
        return 2 * bool(words & {"comment", "comments", "reply"})
    return 2 if words & STRONG_WORDS else 1 if words & WEAK_WORDS else 0


def _signature(tag: str, at: dict[str, str]) -> str:
    return tag + "".join(f".{c}" for c in sorted(at.get("class", "").lower().split())) + (f"@{'-'.join(at['role'].lower().split())}" if at.get("role") else "")


def events(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("<" | ">" | "t", name or text, attributes); the inside of raw elements is left out."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        m = m if m[5] is None else {0: m[0], 1: m[4], 2: m[5], 3: m[6]}  # a quote that never ends: the tag ends at the next ">"
        if m[2] is None:
            if m[0][0] != "<" or m[0] == "<":
                yield "t", m[0], {}
            elif m[0].startswith("<![CDATA["):
                yield "t", m[0][9:].removesuffix("]]>"), {}
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            yield ">", tag, {}
            continue
        yield "<", tag, _attrs(attributes)
        if tag in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            yield ">", tag, {}


class Walk:
    """Keeps the open elements of a stream, closing what HTML closes by itself."""

    def __init__(self) -> None:
        self.stack: list[tuple] = []  # tag, signature, noise, inside an article or main, path, numbers of the suspects around it
        self.closed: list[tuple] = []  # what the last call closed, inner ones first
        self.suspects: list[list] = []  # [strength, the one around it or -1, holds a main element, holds an article]

    def open(self, tag: str, at: dict[str, str]) -> None:
        self.closed = []
        if tag in ENDS_P:
            self._end(("p",), ("table", "td", "th", "li", "blockquote", "article", "div"))
        if tag in CLOSES:
            self._end(CLOSES[tag], ("ul", "ol", "dl", "table", "menu", "article", "div", "section", "body"))
        up = self.stack[-1] if self.stack else ("", "", False, False, "", -1)
        if tag not in VOID:
            sig, mark = _signature(tag, at), up[5]
            k = mark
            while k >= 0 and tag in ("main", "h1", "article") and not up[2]:
                self.suspects[k][2 if tag != "article" else 3] = True
                k = self.suspects[k][1]
            if (bad := _suspect(tag, at)) and not up[2]:
                self.suspects.append([bad, mark, False, False])
                mark = len(self.suspects) - 1
            path = f"{up[4]} {sig}".lstrip() if tag in BLOCK else up[4]
            self.stack.append((tag, sig, up[2] or _noise(tag, at, up[3]), up[3] or tag in ("article", "main") or at.get("role") == "main", path, mark))

    def dropped(self, size: dict[int, int]) -> set[int]:
        """The suspects that are noise, by the text that each holds outside the suspects inside it (-1: outside all). One stays
        if it holds the main element or title, or, with weak words only, an article or nearly all text that is left."""
        out, free = set(range(len(self.suspects))), size.get(-1, 0)
        for k, (bad, up, main, article) in enumerate(self.suspects):  # outer ones first
            if up not in out and (main or bad == 1 and (article or size.get(k, 0) > 8 * free)):
                out.discard(k)
                free += size.get(k, 0)
        for k, (_, up, _, _) in enumerate(self.suspects):
            if up in out:
                out.add(k)
        return out

    def _cut(self, k: int) -> None:
        self.closed += self.stack[:k - 1 if k else None:-1]
        del self.stack[k:]

    def _end(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                self._cut(k)
                return
            if self.stack[k][0] in stop:
                return

    def close(self, tag: str) -> None:
        self.closed = []
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._cut(k)
                return
            if self.stack[k][0] in ("article", "main", "body") and tag not in ("body", "html", "article", "main"):
                return


# ---------------------------------------------------------------- wrappers


def read(page: str) -> list:
    """Balanced nodes ["<", signature], [">", tag] of the block elements that hold text, and one ["t", text, length, path] for
    each block's text; noise is left out. The path names the open block elements."""
    w, out, marks, now = Walk(), [], [], []

    def put(node: list, mark: int) -> None:
        out.append(node)
        marks.append(mark)

    def end(up: tuple) -> None:
        text = " ".join(html.unescape("".join(now)).split()) if now else ""
        if text:
            put(["t", text, len(text), up[4]], up[5])
        now.clear()

    def closing(closed: list) -> None:
        for c in closed:
            if c[0] in BLOCK and not c[2]:
                end(c)
                put([">", c[0]], c[5])
            elif c[0] not in BLOCK and not c[2] and c[5] != (w.stack[-1][5] if w.stack else -1):
                end(c)  # an inline suspect is a block of its own

    top = ("", "", False, False, "", -1)
    for kind, x, at in events(page):
        up = w.stack[-1] if w.stack else top
        if kind == "t":
            if not up[2]:
                now.append(x)
            continue
        if x in BLOCK:
            end(up)
        elif x == "br" and now:
            now.append(" ")
        if kind == "<":
            w.open(x, at)
            closing(w.closed)
            new = w.stack[-1] if w.stack else top
            if x not in BLOCK and new[5] != up[5]:
                end(up)
            if x in BLOCK and not new[2]:
                put(["<", _signature(x, at)], new[5])
        else:
            w.close(x)
            closing(w.closed)
    end(w.stack[-1] if w.stack else top)
    closing(w.stack[::-1])
    size = Counter()
    for x, k in zip(out, marks):
        if x[0] == "t":
            size[k] += x[2]
    gone = w.dropped(size) if w.suspects else set()
    kept: list = []
    for x, k in zip(out, marks):
        if k in gone:
            continue
        if x[0] == ">" and kept and kept[-1][0] == "<" and _tag(kept[-1][1]) == x[1] and x[1] not in VOID:
            kept.pop()
        else:
            kept.append(x)
    return kept


def stream(page: str) -> list:
    """The nodes of read(), with ["+", nodes] for repeated groups; a text that differs between turns is a slot ["s", "", length, path]."""
    return fold(read(page))


def shape(node: list) -> str:
    if node[0] in "ts":
        return "#" + node[3]
    if node[0] in "?+":
        return node[0] + "(" + " ".join(map(shape, node[1])) + ")"
    return node[0] + node[1]


def _tandem(ids: np.ndarray, size: int) -> bool:
    """Whether two neighbouring groups of this size are equal."""
    same = np.concatenate(([False], ids[:-size] == ids[size:], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    return bool(len(edges)) and int((edges[1::2] - edges[::2]).max()) >= size


def fold(nodes: list) -> list:
    """Runs of two or more neighbouring groups of one shape become one repeated group, inner ones first; groups of any size."""
    size, known, shapes, ids = 0, None, [], np.empty(0, np.int64)
    while 2 * (size := size + 1) <= len(nodes):
        if known is not nodes:
            names: dict[str, int] = {}
            known, shapes = nodes, [shape(x) for x in nodes]
            ids = np.array([names.setdefault(x, len(names)) for x in shapes])
        if not _tandem(ids, size):
            continue
        out, i = [], 0
        while i < len(nodes):
            group = shapes[i : i + size]
            j = i + size
            if len(group) == size and (size > 1 or group[0][0] == "+") and _balanced(nodes[i:j]):
                while shapes[j : j + size] == group:
                    j += size
            if j > i + size:
                body = nodes[i : i + size]
                for k in range(i + size, j, size):
                    body = [_merge(a, b) for a, b in zip(body, nodes[k : k + size])]
                out.append(["+", body] if body[0][0] != "+" or size > 1 else body[0])
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = nodes if len(out) == len(nodes) else out
    return nodes


def _balanced(nodes: list) -> bool:
    depth = 0
    for x in nodes:
        depth += (x[0] == "<" and x[1].split(".")[0].split("@")[0] not in VOID) - (x[0] == ">")
        if depth < 0:
            return False
    return depth == 0


def _merge(a: list, b: list) -> list:
    """Two nodes of one shape; texts that differ become a slot."""
    if a[0] in "ts":
        same = a[0] == "t" == b[0] and a[1] == b[1]
        return ["t" if same else "s", a[1] if same else "", a[2] + b[2], a[3]]
    if a[0] in "?+":
        return [a[0], [_merge(x, y) for x, y in zip(a[1], b[1])]]
    return a


def _flat(nodes: list) -> list:
    """(node, mark) with outer groups opened once; the mark (kind, group, place, size) tells where a group was."""
    out = []
    for x in nodes:
        if x[0] in "?+":
            out += [(y, (x[0], id(x), k, len(x[1]))) for k, y in enumerate(x[1])]
        else:
            out.append((x, None))
    return out


def _regroup(flat: list) -> list:
    """Groups that are still whole are closed again."""
    out, i = [], 0
    while i < len(flat):
        mark = flat[i][1]
        run = flat[i : i + mark[3]] if mark and mark[2] == 0 else []
        if run and len(run) == mark[3] and all(m and m[1] == mark[1] for _, m in run):
            out.append([mark[0], [x for x, _ in run]])
            i += len(run)
        elif mark and mark[0] == "?":  # what is left of an optional group stays optional
            j = i + 1
            while j < len(flat) and flat[j][1] and flat[j][1][1:3] == (mark[1], mark[2] + j - i):
                j += 1
            out.append(["?", [x for x, _ in flat[i:j]]])
            i = j
        else:
            out.append(flat[i][0])
            i += 1
    return out


def opcodes(a: list[str], b: list[str]) -> Iterator[tuple[str, int, int, int, int]]:
    """As difflib's, in nearly linear time: common ends, then shapes that occur once on both sides in their longest common order,
    and so on between them; only short rests are compared in full, long ones without such shapes differ as a whole."""
    todo, same = [(0, len(a), 0, len(b))], []
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            same.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            same.append((m, n))
        if i == m or j == n:
            continue
        if (m - i) * (n - j) <= 10_000:
            for x in SequenceMatcher(None, a[i:m], b[j:n], autojunk=False).get_matching_blocks():
                same += [(i + x.a + k, j + x.b + k) for k in range(x.size)]
            continue
        once, at = Counter(a[i:m]), {}
        for k in range(j, n):
            at[b[k]] = -1 if b[k] in at else k
        pairs = [(k, at[a[k]]) for k in range(i, m) if once[a[k]] == 1 and at.get(a[k], -1) >= 0]
        ends, back, chain = [], {}, []  # longest rising chain of places in b
        for k, q in pairs:
            t = bisect_left(ends, (q,))
            back[k, q] = chain[t - 1] if t else None
            ends[t:t + 1], chain[t:t + 1] = [(q,)], [(k, q)]
        node, anchors = chain[-1] if chain else None, []
        while node:
            anchors.append(node)
            node = back[node]
        lo = (i, j)
        for k, q in reversed(anchors):
            same.append((k, q))
            todo.append((lo[0], k, lo[1], q))
            lo = (k + 1, q + 1)
        if anchors:
            todo.append((lo[0], m, lo[1], n))
    same.sort()
    i = j = k = 0
    while k <= len(same):
        x, y = same[k] if k < len(same) else (len(a), len(b))
        if i < x or j < y:
            yield "replace", i, x, j, y
        start = k
        while k < len(same) and same[k] == (x + k - start, y + k - start):
            k += 1
        if k == start:
            return
        i, j = x + k - start, y + k - start
        yield "equal", x, i, y, j


def align(wrapper: list, page: list) -> list:
    """Longest common runs stay, a group being aligned with one turn of it; what only one side has becomes optional."""
    a, b = _flat(wrapper), _flat(page)
    out: list = []
    for op, i0, i1, j0, j1 in opcodes([shape(x) for x, _ in a], [shape(x) for x, _ in b]):
        if op == "equal":
            for (x, m), (y, n) in zip(a[i0:i1], b[j0:j1]):
                out.append((_merge(x, y), n if n and n[0] == "+" else m or n))
        else:
            for side in (a[i0:i1], b[j0:j1]):
                if side:
                    body = _slots(_regroup([(x, m if m and m[0] == "+" else None) for x, m in side]))
                    out.append((["?", body], None))
    return fold(_regroup(out))


def infer(pages: list[str]) -> list:
    return join([stream(page) for page in pages])


def join(parts: list[list]) -> list:
    """One wrapper of several: equal shapes are merged first, the others aligned in the order of their shapes, so that the result
    does not depend on the order of the parts."""
    shapes: dict[str, list] = {}
    for nodes in parts:
        _put(shapes, shapes_of(nodes), nodes)
    wrapper: list = []
    for k, name in enumerate(sorted(shapes)):
        wrapper = align(wrapper, shapes[name]) if k else shapes[name]
    return wrapper


def shapes_of(nodes: list) -> str:
    return "\n".join(map(shape, nodes))


def _put(held: dict, name: object, nodes: list) -> None:
    held[name] = [_merge(a, b) for a, b in zip(held[name], nodes)] if name in held else nodes


def _texts(nodes: list) -> Iterator[list]:
    for x in nodes:
        if x[0] in "ts":
            yield x
        elif x[0] in "?+":
            yield from _texts(x[1])


def _slots(nodes: list) -> list:
    """The nodes with every text a slot: what only some pages have is no text of the template."""
    return [["s", "", x[2], x[3]] if x[0] in "ts" else [x[0], _slots(x[1])] if x[0] in "?+" else x for x in nodes]


def _tag(signature: str) -> str:
    return re.split(r"[.@]", signature, maxsplit=1)[0]


def region(wrapper: list, whole: bool = False) -> str:
    """The main region: article or main (by signature, or by tag if there are several) where they hold half of the text, or else
    "/" and the path of the smallest element that holds all of it; "" is the page. The text is that of the slots, or all of it if
    there are none or `whole` is asked for."""
    texts = list(_texts(wrapper))
    if not whole:
        texts = [x for x in texts if x[0] == "s"] or texts
    total = sum(x[2] for x in texts)
    paths = {x[3]: x[3].split() for x in texts}
    for tag in ("article", "main"):
        first = {p: next((q for q in parts if _is(q, tag)), None) for p, parts in paths.items()}
        if 2 * sum(x[2] for x in texts if first[x[3]]) >= total > 0:
            names = {q for q in first.values() if q}
            return names.pop() if len(names) == 1 else tag
    common: list[str] = []
    for level in zip(*paths.values()):
        if len(set(level)) > 1 or re.fullmatch(r"p|h[1-6]|li|ul|ol|table|dl|pre|blockquote", _tag(level[0])):
            break
        common.append(level[0])
    return "/" + " ".join(common) if common else ""


def _is(signature: str, tag: str) -> bool:
    return _tag(signature) == tag or tag == "main" and signature.endswith("@main")


def within(path: str, where: str) -> bool:
    if where.startswith("/") or not where:
        return not where or f"{path} ".startswith(where[1:] + " ")
    return any(q == where or where in ("article", "main") and _is(q, where) for q in path.split())


def extract(page: str, where: str) -> str | None:
    """Blocks of the region in page order, None if the page has no text there."""
    blocks = [x[1] for x in read(page) if x[0] == "t" and within(x[3], where)]
    return "\n".join(blocks) if blocks or not where else None


def main_text(page: str | None, where: str | dict[str, str] | None) -> str:
    """Text of the region `where`, or of the page's own region if that holds less than half of the latter's text; a dictionary
    gives the regions of the host's templates by their pages' own regions."""
    if not page:
        return ""
    texts = [x for x in read(page) if x[0] == "t"]
    own = region(texts, whole=True)
    mine = [x for x in texts if within(x[3], own)]
    where = where.get(own) if isinstance(where, dict) else where
    named = [x for x in texts if within(x[3], where)] if where else []
    if 2 * sum(x[2] for x in named) >= sum(x[2] for x in mine):
        mine = named
    return "\n".join(x[1] for x in mine)


# ---------------------------------------------------------------- Spark


def host(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


_PARTS = "host string, template string, bucket int, wrapper string, lo string, hi string"


def _digest(text: str) -> str:
    return md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()[:16]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (host, html) as wrappers, one for each host, template and shape; lo and hi tell whether there is more than one page."""
    held: dict[tuple[str, str, str], list] = {}
    ends: dict[tuple[str, str, str], tuple[str, str]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        keys = list(held)
        cols = [[k[0] for k in keys], [k[1] for k in keys], pa.array([crc32(k[2].encode("utf-8", "surrogatepass")) % BUCKETS for k in keys], pa.int32()), [json.dumps(held[k]) for k in keys], [ends[k][0] for k in keys], [ends[k][1] for k in keys]]
        return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in cols], names=["host", "template", "bucket", "wrapper", "lo", "hi"])

    for b in batches:
        for name, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not page:
                continue
            nodes = read(page)
            template, whole = region(nodes, whole=True), _digest(page)
            for x in nodes:
                if x[0] == "t" and len(x[1]) > 32:
                    x[1] = _digest(x[1])
            nodes = fold(nodes)
            key = (name, template, shapes_of(nodes))
            size += 0 if key in held else len(nodes)
            _put(held, key, nodes)
            lo, hi = ends.get(key, (whole, whole))
            ends[key] = (min(lo, whole), max(hi, whole))
            if size > HELD_NODES:
                yield rows()
                held.clear()
                ends.clear()
                size = 0
    if held:
        yield rows()


def _join_parts(table: pa.Table) -> pa.Table:
    wrapper = join([json.loads(x) for x in table["wrapper"].to_pylist()])
    row = {"host": table["host"][0].as_py(), "template": table["template"][0].as_py(), "bucket": 0, "wrapper": json.dumps(wrapper), "lo": min(table["lo"].to_pylist()), "hi": max(table["hi"].to_pylist())}
    return pa.Table.from_pylist([row], schema=pa.schema([(k, pa.int32() if k == "bucket" else pa.string()) for k in row]))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, template, region, wrapper) over all pages: one row per host and own region of its pages."""
    p = pages.select(host().alias("host"), "html").mapInArrow(_parts, _PARTS)
    p = p.groupBy("host", "template", "bucket").applyInArrow(_join_parts, _PARTS).groupBy("host", "template").applyInArrow(_join_parts, _PARTS)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:  # one page alone has no slots, and an article or main element is the region of its pages
                named = r["template"].startswith("/") and r["lo"] != r["hi"]
                r["region"] = region(json.loads(r["wrapper"])) if named else r["template"]
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in ("host", "template", "region", "wrapper")], names=["host", "template", "region", "wrapper"])

    return p.mapInArrow(one, "host string, template string, region string, wrapper string")


def main_texts(pages: DataFrame, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    w = materialise(wrappers(pages), "wrappers").where("region <> template")
    w = w.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("template", "region"))).alias("regions"))
    few = w.limit(broadcast_limit + 1).count() <= broadcast_limit
    p = pages.select("page_id", "url", "html", host().alias("host"))
    p = p.join(F.broadcast(w) if few else w, "host", "left").select("page_id", "url", "html", "regions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x, dict(r or ())) for x, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return p.mapInArrow(run, schema)
