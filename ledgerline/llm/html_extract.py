"""Main text of web pages by equivalence-class template deduction over pages of the same host.

A token is an element's path of tags, classes and ids (a hash of its parent's token and its own part, so paths of
any depth cost the same). Its occurrence vector says how often it occurs on each of the host's distinct pages
(copies count once). Tokens with equal vectors and enough pages form an equivalence class. Vectors are compared by
sums of 32-bit hashes of (page, count), so they are built with map-side sums and never gathered. A second pass over
the pages tries every class: it is valid only if its tokens come in one and the same order on all pages, and if
each of its instances lies in one slot of the class around it. Valid classes, nested from the root class (the tokens
once on every page) on, make the host's template; a class around which nothing valid stands is left out with all
that lies in it.

What stands between the template's tokens are its slots. The main slot is the template's article. Without one, the
slots are told apart by what varies: those with the same text on nearly all pages are template, all others are text.
Navigation, headers, footers, asides, forms, adverts, notices and comments are left out by tag, class, id or role.
Names that may mean either (``share``, ``legal``) only settle what the rest leaves open: outside an article, or in a
slot that is the same on nearly all pages, or where most of the text is links. Pages of hosts with too few pages
take the same rules on themselves.

Defined results: null or empty html, and pages without main text: empty text. Cut-off pages give what they
hold; a tag cut off at the end is dropped. A quote that is never closed is a character like any other. Pages without
a host share the empty host. Repeated pages each get their own row. Columns of any name may stand beside; only
``text`` and ``n_chars`` are replaced. No text is shortened, and no depth or length is too much: reading is linear.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .url_filter import host_path

MIN_SUPPORT = 3  # distinct pages a class must occur on
MIN_SHARE = 0.2  # of the host's distinct pages
CONSTANT_SUPPORT = 10  # distinct pages a host must have for constant slots to be template
NEARLY_ALL = 0.9  # of the host's distinct pages must hold a constant slot
BROADCAST_MB = 16

#: Element names, and words of classes, ids and roles, by what they mean.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea noscript template iframe title xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = set("head script style noscript template iframe title nav footer aside form button select option textarea svg canvas object embed dialog menu".split())
OUTSIDE_WORDS = set("""
ad ads adv advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments comentarios commentaires consent cookie
cookies disqus footer gdpr kommentare masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted
promotion sidebar signup sponsor sponsored subscribe toolbar topbar widget widgets
""".split())
EITHER_WORDS = set("alert copyright disclaimer discussion legal login overlay recommended related replies reply responses search share sharing skip social teaser trending".split())
PLAIN_WORDS = set("area bar block body bottom box button buttons container content global group holder icons inner item items left link links list main outer page panel post posts right row section site top wrap wrapper".split())
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Which open elements an opening tag closes, up to the given bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
P_BOUNDS = {"body", "div", "td", "th", "li", "article", "section", "main", "button", "blockquote", "aside", "nav", "header", "footer", "form"}

ROOT = 0
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+>")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def scan(html: str):
    """Yields (text, None, ""), (tag, False, attributes) for opening and (tag, True, "") for closing tags; linear in the page's length."""
    at, n, quotes = 0, len(html), True
    while at < n:
        start = html.find("<", at)
        m = _NAME.match(html, start + 1) if start >= 0 else None
        while start >= 0 and m is None and html[start + 1 : start + 2] not in ("!", "?"):
            start = html.find("<", start + 1)
            m = _NAME.match(html, start + 1) if start >= 0 else None
        if start < 0:
            yield html[at:], None, ""
            return
        if start > at:
            yield html[at:start], None, ""
        if m is None:
            ends = "-->" if html.startswith("<!--", start) else "]]>" if html.startswith("<![CDATA[", start) else ">"
            end = html.find(ends, start)
            at = n if end < 0 else end + len(ends)
            continue
        rest = _REST.match(html, m.end()) if quotes else None
        end = rest.end() if rest else html.find(">", m.end()) + 1
        if not end:
            return  # a tag cut off
        quotes = quotes and rest is not None  # no way to the end from here is none from further on
        tag = m[1].lower()
        at = end
        if html[start + 1] == "/":
            yield tag, True, ""
        elif tag in RAW:
            close = _RAW_END[tag].search(html, end)
            at = close.end() if close else n
        else:
            yield tag, False, html[m.end() : end - 1]


def named(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """A token's own part, and whether its tag or names say it is outside the main text, or may say so."""
    if not attrs or "=" not in attrs:
        return tag, tag in OUTSIDE, False
    names, outside, either = [], tag in OUTSIDE, False
    for name, a, b, c in _ATTR.findall(attrs):
        value = a or b or c
        if name.lower() == "role":
            outside |= value.lower() in OUTSIDE_ROLES
            continue
        for part in value.split():
            words = {w.lower() for w in _WORDS.findall(part)}
            if tag not in ("html", "body", "article", "main") or words & {"comment", "comments"}:
                outside |= bool(words & OUTSIDE_WORDS)
                either |= bool(words & EITHER_WORDS) and words <= EITHER_WORDS | PLAIN_WORDS
            names.append(re.sub(r"\d{3,}", "0", part.lower()))
    return ".".join([tag, *sorted(names)]), outside, either


class Page:
    """A page's nodes (one for each distinct path), the order in which they open, and its texts in order.

    nodes: [parent, token, tag, outside, either, inside an article, inside a link, count]; texts: (node, text), text
    None where a block ends.
    """

    def __init__(self, html: str) -> None:
        self.nodes: list[list] = [[-1, ROOT, "", False, False, False, False, 1]]
        self.texts: list[tuple[int, str | None]] = []
        self.opens: list[int] = [0]
        kids: dict[tuple, int] = {}
        stack: list[tuple[str, int]] = [("", 0)]
        places: dict[str, list[int]] = {}  # tag -> its places on the stack
        blocks = [0]  # places of those that are not inline
        parts: dict[tuple[str, str], tuple] = {}

        def cut(k: int) -> None:
            while len(stack) > k:
                places[stack.pop()[0]].pop()
            while blocks[-1] >= k:
                blocks.pop()

        def last(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        for value, closing, attrs in scan(html):
            if closing is None:
                self.texts.append((stack[-1][1], value))
                continue
            tag = value
            if tag not in INLINE:
                self.texts.append((stack[-1][1], None))
            if closing:
                k = last((tag,))
                if k and (tag not in INLINE or k > blocks[-1]):
                    cut(k)
                continue
            if tag in VOID:
                continue
            for closed, bounds in [x for x in (CLOSES.get(tag), None if tag in INLINE else ({"p"}, P_BOUNDS)) if x]:
                k = last(closed)
                if k and k > last(bounds):
                    cut(k)
            parent = stack[-1][1]
            key = parts.get((tag, attrs))
            if key is None:
                key = parts[tag, attrs] = named(tag, attrs)
            above = self.nodes[parent]
            outside = key[1] or tag == "header" and not above[5]
            node = kids.get((parent, key[0], outside))
            if node is None:
                node = kids[parent, key[0], outside] = len(self.nodes)
                token = _h63(f"{above[1]}>{key[0]}{'!' * outside}")
                self.nodes.append([parent, token, tag, outside or above[3], key[2], above[5] or tag in ("article", "main"), above[6] or tag == "a", 0])
            self.nodes[node][7] += 1
            self.opens.append(node)
            if not (attrs.endswith("/") and tag in ("path", "circle", "rect", "use")):
                places.setdefault(tag, []).append(len(stack))
                if tag not in INLINE:
                    blocks.append(len(stack))
                stack.append((tag, node))

    def own_texts(self) -> dict[int, str]:
        """Each node's own text, white space made one."""
        own: dict[int, list[str]] = {}
        for node, text in self.texts:
            if text and not text.isspace():
                own.setdefault(node, []).append(text)
        return {k: " ".join(" ".join(v).split()) for k, v in own.items()}

    def slot_texts(self) -> list[tuple[int, int]]:
        """Each node's hash and length of the text in and below it, but for what lies outside; 0, 0 without any."""
        own = self.own_texts()
        out = [(0, 0)] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):  # kids come after their parents
            parent, outside = self.nodes[k][0], self.nodes[k][3]
            text = "" if outside else own.get(k, "")
            h, n = out[k]
            if text:
                h, n = _h32(f"{h} {text}"), n + len(text)
            out[k] = h, n
            if parent >= 0 and n:
                out[parent] = _h32(f"{out[parent][0]}>{h}"), out[parent][1] + n
        return out

    def _link_lists(self) -> set[int]:
        """Nodes whose names may mean either and most of whose text is links."""
        if not any(x[4] for x in self.nodes):
            return set()
        total, linked = [0] * len(self.nodes), [0] * len(self.nodes)
        for node, text in self.texts:
            if text and not text.isspace():
                total[node] += len(text)
                linked[node] += len(text) * self.nodes[node][6]
        for k in range(len(self.nodes) - 1, 0, -1):
            total[self.nodes[k][0]] += total[k]
            linked[self.nodes[k][0]] += linked[k]
        return {k for k, x in enumerate(self.nodes) if x[4] and 2 * linked[k] > total[k]}

    def text(self, main: int | None = None, template: set[int] = frozenset()) -> str:
        """The text below the token ``main`` (or the page's own article), without what lies outside or is template."""
        nodes = self.nodes
        roots = {k for k, x in enumerate(nodes) if x[1] == main} if main else set()
        roots = roots or own_roots(nodes)
        lists = self._link_lists()
        inside = [False] * len(nodes)
        for k, (parent, token, _, outside, either, article, _, _) in enumerate(nodes):
            left_out = outside or token in template or either and (not article or k in lists)
            inside[k] = not left_out and (k in roots or (parent >= 0 and inside[parent]))
        out = [" " if text is None else text for node, text in self.texts if inside[node]]
        return " ".join(unescape("".join(out)).split())

    def class_orders(self, classes: list[tuple[int, int, list[int]]]) -> dict[int, tuple[int, bool]]:
        """For each class (number, class around it or -1, tokens) on this page: hash of its tokens' order, and whether it breaks the rules here."""
        of = {t: c for c, _, tokens in classes for t in tokens}
        size = {c: len(tokens) for c, _, tokens in classes}
        around = {c: p for c, p, _ in classes}
        seen: dict[int, list[int]] = {}  # class -> its tokens as they open
        opened: dict[int, int] = {}  # class -> tokens opened so far
        places: dict[int, list[int]] = {}
        for node in self.opens:
            token = self.nodes[node][1]
            c = of.get(token)
            if c is None:
                continue
            seen.setdefault(c, []).append(token)
            places.setdefault(c, []).append(opened.get(around[c], 0))
            opened[c] = opened.get(c, 0) + 1
        out = {}
        for c, tokens in seen.items():
            k = size[c]
            first = tokens[:k]
            bad = len(tokens) % k != 0 or len(set(first)) < k or tokens != first * (len(tokens) // k)
            bad = bad or any(len(set(places[c][i : i + k])) > 1 for i in range(0, len(tokens), k))
            out[c] = _h32(repr(first)), bad
        return out


def own_roots(nodes: list[list]) -> set[int]:
    """The page's own main slots: articles, else main elements, else the body, else all of it."""
    for tag in ("article", "main", "body"):
        found = {k for k, x in enumerate(nodes) if x[2] == tag and not x[3]}
        if found:
            return found
    return {0}


def _h32(x) -> int:
    return xxhash.xxh32_intdigest(x)


def _h63(x) -> int:
    return (xxhash.xxh64_intdigest(x) >> 1) or 1


_NAMES = ("token", "parent", "tag", "outside", "either", "pages", "uses", "v1", "v2", "below", "low", "high")
_STATS = "_host string, token bigint, parent bigint, tag string, outside boolean, either boolean, pages bigint, uses bigint, v1 bigint, v2 bigint, below bigint, low bigint, high bigint"
_ARROW = pa.schema([("_host", pa.string()), ("token", pa.int64()), ("parent", pa.int64()), ("tag", pa.string()), ("outside", pa.bool_()), ("either", pa.bool_()), *[(c, pa.int64()) for c in _NAMES[5:]]])


def page_tokens(html: str, page: str) -> list[tuple]:
    """A page's tokens with their facts (as in ``_NAMES``); the vector's sums for this page, whose name is ``page``."""
    read = Page(html)
    out = []
    for (parent, token, tag, outside, either, _, _, uses), (h, below) in zip(read.nodes, read.slot_texts(), strict=True):
        vector = f"{page}:{uses}"
        out.append((token, read.nodes[parent][1] if parent >= 0 else -1, tag, outside, either, 1, uses, _h32(vector), _h32(vector + "'"), below, h, h))
    return out


def host_tokens(pages: DataFrame) -> DataFrame:
    """(_host, token) with distinct pages, uses, occurrence-vector sums, and length, least and greatest hash of the text in and below it.

    ``pages`` has (_host, _html). Equal html on a host counts once, however many copies there are; the html is
    shuffled for it.
    """
    distinct = pages.where(F.length("_html") > 0).select("_host", F.md5("_html").alias("_page"), "_html").dropDuplicates(["_host", "_page"])

    def count(batches):
        for batch in batches:
            seen: dict[tuple, list] = {}
            for host, page, value in zip(*(batch.column(c).to_pylist() for c in ("_host", "_page", "_html")), strict=True):
                for token, parent, tag, outside, either, *facts in page_tokens(value, page):
                    row = seen.get((host, token))
                    if row is None:
                        seen[host, token] = [host, token, parent, tag, outside, either, *facts]
                        continue
                    for k in range(6, 11):
                        row[k] += facts[k - 6]
                    row[11], row[12] = min(row[11], facts[5]), max(row[12], facts[6])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*seen.values(), strict=True), _ARROW.types, strict=True)] if seen else [pa.array([], t) for t in _ARROW.types], schema=_ARROW)

    sums = [F.sum(c).alias(c) for c in ("pages", "uses", "v1", "v2", "below")]
    return (distinct.mapInArrow(count, _STATS).groupBy("_host", "token", "parent", "tag", "outside", "either")
            .agg(*sums, F.min("low").alias("low"), F.max("high").alias("high")))


def candidate_classes(tokens: list[dict]) -> list[tuple[int, int, list[int]]]:
    """A host's equivalence classes as (number, class around it or -1, tokens), those around before those inside.

    A class is two or more tokens with equal occurrence vectors. The root class is that of the page itself; of it
    the tokens count whose parents are in it too. Any other class is taken or left as a whole: its outermost tokens
    must lie below one and the same token of a class.
    """
    by_vector: dict[tuple, dict[int, dict]] = {}
    for t in tokens:
        by_vector.setdefault((t["pages"], t["v1"], t["v2"]), {})[t["token"]] = t
    parent = {t["token"]: t["parent"] for t in tokens}
    depth = {ROOT: 0}

    def depth_of(token: int) -> int:
        way = []
        while token not in depth:
            way.append(token)
            token = parent.get(token, ROOT)
        for x in reversed(way):
            depth[x] = depth[token] + 1
            token = x
        return depth[token]

    taken: dict[int, int] = {}
    out: list[tuple[int, int, list[int]]] = []
    waiting = []
    for c in by_vector.values():
        if len(c) < 2:
            continue
        if ROOT not in c:
            waiting.append((min(map(depth_of, c)), sorted(c), {parent[t] for t in c if parent[t] not in c}))
            continue
        for t in sorted(c, key=lambda t: (depth_of(t), t)):
            if t == ROOT or parent[t] in taken:
                taken[t] = 0
        out.append((0, -1, sorted(taken)))
    # a class lies below its slot's token, so one pass from the outside in meets those around first
    for _, c, slots in sorted(waiting):
        if len(slots) == 1 and slots <= taken.keys():
            out.append((len(out), taken[next(iter(slots))], c))
            taken.update(dict.fromkeys(c, len(out) - 1))
    return out


def valid_tokens(classes: list[tuple[int, int, list[int]]], broken: set[int]) -> set[int]:
    """The template's tokens: those of classes that hold on all pages, in classes that do."""
    good: set[int] = set()
    out: set[int] = set()
    for c, around, tokens in classes:
        if c not in broken and (around < 0 or around in good):
            good.add(c)
            out.update(tokens)
    return out


def deduce(tokens: list[dict], valid: set[int]) -> tuple[int | None, list[int]]:
    """A host's template: (token of the main slot or none, tokens of slots with template text only).

    With an article (or main element) once a page in the template, that is the main slot and all of it is text, but
    for constant slots in it whose names may mean either. Without one the slots between the template's tokens are
    told apart by what they hold: the same on all pages is template, all else is text.
    """
    root = next((t for t in tokens if t["token"] == ROOT), None)
    if root is None or not valid:
        return None, []
    of = {t["token"]: t for t in tokens}
    constant = [t for t in tokens if t["token"] in valid and t["low"] == t["high"] and t["below"] and not t["outside"] and t["pages"] >= max(CONSTANT_SUPPORT, NEARLY_ALL * root["pages"])]
    named_same = sorted(t["token"] for t in constant if t["either"])
    for tag in ("article", "main"):
        found = [t for t in tokens if t["token"] in valid and t["tag"] == tag and t["uses"] == t["pages"] and not t["outside"]]
        if len(found) == 1:
            return found[0]["token"], named_same
        if found:
            return None, named_same  # several articles: the pages' own rule takes them all
    if any(t["tag"] in ("article", "main") and not t["outside"] for t in tokens):
        return None, named_same  # none of the template or several to a page: the pages' own rule takes them all
    blocks = {t["token"] for t in constant if t["tag"] not in HEADINGS | INLINE | {"p", "", "html", "body"}}

    def below_one(token: int) -> bool:
        while token in of and token != ROOT:
            token = of[token]["parent"]
            if token in blocks:
                return True
        return False

    same = sorted(t for t in blocks if not below_one(t))
    # pages that differ in little are near copies: what they share is then their text
    return None, same if 2 * sum(of[t]["below"] for t in same) < root["below"] else []


def _small(df: DataFrame, *size) -> DataFrame:
    """``df`` to be broadcast if it is proven small, else as it is."""
    mb = (df.agg(F.sum(sum(size, F.lit(16)))).first()[0] or 0) / 1e6
    return F.broadcast(df) if mb <= BROADCAST_MB else df


def templates(pages: DataFrame) -> DataFrame:
    """(_host, _main, _same) of each host with a template; ``pages`` has (_host, _html).

    A host's tokens that are on enough of its pages are at most 1 / ``MIN_SHARE`` times those of a page: a bounded group.
    """
    tokens = materialise(host_tokens(pages).where((F.col("pages") >= MIN_SUPPORT)), "tokens")
    roots = tokens.where(F.col("token") == ROOT).select("_host", F.col("pages").alias("_total"))
    kept = tokens.join(_small(roots, F.length("_host")), "_host").where(F.col("pages") >= MIN_SHARE * F.col("_total"))
    grouped = kept.groupBy("_host").agg(F.collect_list(F.struct(*_NAMES)).alias("tokens")).where(F.size("tokens") > 1)

    def rows_of(value) -> list[dict]:
        return [t.asDict() if hasattr(t, "asDict") else dict(t) for t in value]

    def classify(frames):
        for frame in frames:
            rows = [(h, c, around, t) for h, x in zip(frame["_host"], frame["tokens"], strict=True) for c, around, t in candidate_classes(rows_of(x))]
            yield pd.DataFrame(rows, columns=["_host", "c", "around", "t"])

    classes = materialise(grouped.mapInPandas(classify, "_host string, c int, around int, t array<bigint>"), "classes")
    by_host = classes.groupBy("_host").agg(F.array_sort(F.collect_list(F.struct("c", "around", "t"))).alias("_classes"))
    by_host = _small(by_host, F.length("_host"), F.aggregate("_classes", F.lit(0), lambda n, x: n + 8 * F.size(x["t"]) + 16))

    def hold(batches):
        for batch in batches:
            seen: dict[tuple, list] = {}
            for host, value, own in zip(*(batch.column(c).to_pylist() for c in ("_host", "_html", "_classes")), strict=True):
                for c, (order, bad) in Page(value).class_orders([(x["c"], x["around"], x["t"]) for x in own]).items():
                    row = seen.setdefault((host, c), [order, order, False])
                    row[:] = min(row[0], order), max(row[1], order), row[2] or bad
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), *[pa.array([v[k] for v in seen.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]], names=["_host", "c", "low", "high", "bad"])

    tried = pages.where(F.length("_html") > 0).join(by_host, "_host").select("_host", "_html", "_classes").mapInArrow(hold, "_host string, c int, low bigint, high bigint, bad boolean")
    broken = tried.groupBy("_host", "c").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("bad").alias("bad")).where("bad or low <> high")
    known = by_host.join(broken.groupBy("_host").agg(F.collect_set("c").alias("broken")), "_host", "left").join(grouped, "_host")

    def run(frames):
        for frame in frames:
            found = []
            for x, own, bad in zip(frame["tokens"], frame["_classes"], frame["broken"], strict=True):
                own = [(int(c["c"]), int(c["around"]), [int(t) for t in c["t"]]) for c in rows_of(own)]
                found.append(deduce(rows_of(x), valid_tokens(own, set() if bad is None else {int(c) for c in bad})))
            yield pd.DataFrame({"_host": frame["_host"], "_main": pd.array([m for m, _ in found], "Int64"), "_same": [s for _, s in found]})

    return known.select("_host", "tokens", "_classes", "broken").mapInPandas(run, "_host string, _main bigint, _same array<bigint>").where("_main is not null or size(_same) > 0")


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """``pages`` with the columns text and n_chars (replacing columns of those names)."""
    keep = [c for c in pages.columns if c not in ("text", "n_chars", html)]
    host = host_path(F.col(f"`{url}`"))[0]
    found = materialise(templates(pages.select(host.alias("_host"), F.col(f"`{html}`").alias("_html"))), "templates")
    found = _small(found, F.length("_host"), 8 * F.size("_same")).select(F.col("_host").alias("__host"), F.col("_main").alias("__main"), F.col("_same").alias("__same"))
    joined = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("__html"), host.alias("__host")).join(found, "__host", "left").drop("__host")
    spec = pages.sparkSession.createDataFrame([], joined.select(*[F.col(f"`{c}`") for c in keep]).schema).selectExpr("*", "cast(null as string) as text", "cast(null as bigint) as n_chars").schema

    def run(batches):
        for batch in batches:
            texts = [Page(h).text(m, set(s or ())) if h else "" for h, m, s in zip(*(batch.column(c).to_pylist() for c in ("__html", "__main", "__same")), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return joined.mapInArrow(run, spec)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every ``pages`` row: page_id, url, text, n_chars."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
