"""Main text of web pages by wrappers inferred from pages of the same host.

A page is a stream of tags and texts. Repeats are folded (``(<li>T</li>)+``); pages of a host with equal
folded streams are one layout. A host's distinct layouts are aligned one after another with the wrapper so
far: what both have stays, what one lacks becomes optional, texts that differ become slots. The wrapper is
thus a union-free regular expression over tags, slots, constants, optional and repeated groups, learned from
all pages of the host. To extract, a page's folded stream is aligned with its host's wrapper. On a page with
an article element the containers of a text, their class and id words decide (words on the only article
don't take it away); on others a text goes too if
it is constant on ``SEEN`` distinct pages at least: in its slot over the host's pages, or in its containers
over the pages of a layout. Blocks are joined by newlines in page order.

Scale: every page is folded where it stands and counted with those of its layout; only keys, hashes of
constant texts and ``SEEN`` page hashes are shuffled, aggregated map-side by host, layout and item, so a host
with a third of all pages is no hot spot. Layouts are merged in a tree, ``FAN`` at once. Wrappers join the
pages by host as a plain equi-join: broadcast if the table was measured to be small, otherwise a sort-merge
join whose hot hosts Spark splits. Pages are read whole.

Time follows the length of a page, whatever its depth: elements are linked to their parents, alignment goes
by unique keys.

Defined cases: null or empty html gives empty text; a page without a readable host uses the wrapper of
the empty host; cut-off tags, comments and scripts end with the page; unknown end tags are ignored;
repeated rows get equal texts.
"""

from __future__ import annotations

import html as references
import json
import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflow.llm.common import broadcast_if_small, cut, small_batches, table

SEEN = 3  # pages a text must be constant on
HELD = 2000  # layouts counted together before they are passed on
FAN = 64  # wrappers merged at once
LONGEST_GROUP = 12  # items of a repeated group
DEPTH = 16  # rounds of unique keys
BLOCK = 128  # keys that are aligned exactly
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SIDE = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "fieldset", "object", "video", "audio", "canvas"}
ARTICLE = {"article", "main"}
SIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer|cookies?|consent|notices?|alert|popup|modal|overlay"
    r"|newsletter|subscribe|subscription|share|sharing|social|related|recommended|comments?|commentlist|reply|replies|respond|disqus|login|signup|search|pagination|pager|toolbar)(?:$|[\s_-])", re.I
)


def tokens(page: str) -> list[tuple[str, str]]:
    """(key, text): ``<tag names>``, ``</tag>`` or ``T`` with the decoded text."""
    out, at, n = [], 0, len(page)
    start = 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[start : m.start() if m else n]
        if text:
            out.append(("T", references.unescape(text)))
        if not m:
            return out
        at = start = m.end()
        name = (m[2] or "").lower()
        if not name or (not m[4] and m.end() == n):
            continue
        if m[1]:
            out.append((f"</{name}>", ""))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = start = end.end() if end else n
            continue
        names = " ".join(sorted({w for g in _NAMES.findall(m[3] or "") for w in "".join(g).lower().split()}))
        out.append((f"<{name} {names}>" if names else f"<{name}>", ""))


def containers(keys: list[str]) -> tuple[list[int], list[tuple[int, str]]]:
    """The innermost open element of each token, as an index, and the elements: (parent, key), parents first."""
    elements = [(-1, "")]
    stack: list[tuple[str, int]] = []
    open_: Counter = Counter()
    out = []

    def leave() -> str:
        name = stack.pop()[0]
        open_[name] -= 1
        return name

    for key in keys:
        if key[:2] == "</":
            name = key[2:-1]
            if open_[name]:
                while leave() != name:
                    pass
        elif key != "T":
            name = key[1:-1].split(" ", 1)[0]
            if name not in INLINE:
                while stack and (stack[-1][0] in INLINE or stack[-1][0] in ("p", name) and name in ("p", "li", "tr", "td", "th", "dt", "dd", "option")):
                    if not open_["p"] and stack[-1][0] in INLINE:
                        break
                    leave()
            if name not in VOID:
                elements.append((stack[-1][1] if stack else 0, key))
                stack.append((name, len(elements) - 1))
                open_[name] += 1
        out.append(stack[-1][1] if stack else 0)
    return out, elements


def _is_article(key: str) -> bool:
    name, _, names = key[1:-1].partition(" ")
    return name in ARTICLE or "main" in names.split()


def _is_side(key: str) -> bool:
    name, _, names = key[1:-1].partition(" ")
    return name in SIDE or bool(names and name not in ("html", "body") and SIDE_WORDS.search(names))


def verdicts(elements: list[tuple[int, str]]) -> tuple[list[tuple[bool, bool]], bool]:
    """Whether each element is beside the main text and whether it is inside an article, and whether the page has one.

    Class words are a hint: they take an article away if the page has another without them.
    """
    articles = [key for _, key in elements[1:] if _is_article(key)]
    unsure = bool(articles) and all(_is_side(key) for key in articles)
    out = [(False, False)]
    for parent, key in elements[1:]:
        side, inside = out[parent]
        name, _, names = key[1:-1].partition(" ")
        own = _is_article(key)
        side = side or (_is_side(key) and not (unsure and own and not inside))
        side = side or (not inside and (name == "header" or bool(re.search(r"(?:^|[\s_-])header(?:$|[\s_-])", names))))
        out.append((side, inside or own))
    return out, bool(articles)


def fold(keys: list[str]) -> list[tuple[str, list[int]]]:
    """The stream with repeats folded: (key, the tokens that stand for it)."""
    items = [(k, [i]) for i, k in enumerate(keys)]
    changed = True
    while changed:
        changed = False
        for size in range(1, LONGEST_GROUP + 1):
            out: list[tuple[str, list[int]]] = []
            names: list[str] = []
            for item in items:
                out.append(item)
                names.append(item[0])
                if len(out) >= 2 * size and names[-size:] == names[-2 * size : -size]:
                    for a, b in zip(out[-2 * size : -size], out[-size:], strict=True):
                        a[1].extend(b[1])
                    del out[-size:], names[-size:]
                    changed = True
            items = out
    return items


def _anchors(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of keys that stand once in either range, the longest run that ascends in both."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {k: j for j, k in enumerate(b[b0:b1], b0) if in_b[k] == 1}
    tails: list[int] = []
    last: list[int] = []
    found: list[tuple[int, int, int]] = []  # place in a, place in b, the one before
    for i in range(a0, a1):
        j = at.get(a[i])
        if j is None or in_a[a[i]] != 1:
            continue
        k = bisect_left(tails, j)
        found.append((i, j, last[k - 1] if k else -1))
        tails[k : k + 1], last[k : k + 1] = [j], [len(found) - 1]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(found[k][:2])
        k = found[k][2]
    return out[::-1]


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places with equal keys, ascending in both, in time that follows the lengths.

    What both begin and end with matches, then keys that are unique in both, and so on between them. What
    has no such key, or is left after ``DEPTH`` rounds, is aligned exactly in ``BLOCK`` keys at a time.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), 0)]
    while todo:
        a0, a1, b0, b1, depth = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _anchors(a, b, a0, a1, b0, b1) if depth < DEPTH else []
        if anchors:
            out += anchors
            ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m, depth + 1) for (i, j), (k, m) in zip(ends, ends[1:], strict=False)]
            continue
        parts = -(-max(a1 - a0, b1 - b0) // BLOCK)
        cuts = [(a0 + (a1 - a0) * k // parts, b0 + (b1 - b0) * k // parts) for k in range(parts + 1)]
        for (i, j), (k, m) in zip(cuts, cuts[1:], strict=False):
            for x, y, n in SequenceMatcher(None, a[i:k], b[j:m], autojunk=False).get_matching_blocks():
                out += [(i + x + d, j + y + d) for d in range(n)]
    return sorted(out)


def shape(page: str) -> list[tuple[str, bool, int | None]]:
    """The folded items of a page: key, repeated, hash of the text if the item has a single one."""
    stream = tokens(page)
    out = []
    for key, places in fold([k for k, _ in stream]):
        texts = {" ".join(stream[i][1].split()) for i in places} if key == "T" else ()
        out.append((key, len(places) > 1, text_hash(texts.pop()) if len(texts) == 1 else None))
    return out


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def places_of(keys: list[str]) -> list[int]:
    """A hash of all open elements of each folded item."""
    around, elements = containers(keys)
    hashes = [0]
    for parent, key in elements[1:]:
        hashes.append(text_hash(f"{hashes[parent]}\n{key}"))
    return [hashes[i] for i in around]


def placed_hash(place: int, text: int) -> int:
    return text_hash(f"{place}\n{text}")


def _constants(wrapper: list[dict]) -> list[dict]:
    """``wrapper`` with the texts added that all pages of a slot have, ``SEEN`` pages at least."""
    for x in wrapper:
        if x["const"] is not None and len(x["pages"]) >= SEEN and x["const"] not in x["known"]:
            x["known"] = sorted([*x["known"], x["const"]])
    return wrapper


def merge(wrappers: list[list[dict]]) -> list[dict]:
    """One wrapper of many, aligned one after another in the given order.

    An item has its key, optional, repeated, the one text of all its pages or null, the ``SEEN`` smallest
    of its pages and the texts known to be constant, over the host or over the pages of one layout.
    """
    wrapper = wrappers[0]
    for new in wrappers[1:]:
        merged: list[dict] = []
        i = j = 0
        for k, m in [*matches([x["key"] for x in wrapper], [x["key"] for x in new]), (len(wrapper), len(new))]:
            merged += [x | {"opt": True} for x in wrapper[i:k] + new[j:m]]  # each side's rest becomes an optional group
            if k < len(wrapper):
                x, y = wrapper[k], new[m]
                merged.append({
                    "key": x["key"], "opt": x["opt"] or y["opt"], "plus": x["plus"] or y["plus"], "const": x["const"] if x["const"] == y["const"] else None,
                    "pages": sorted({*x["pages"], *y["pages"]})[:SEEN], "known": sorted({*x["known"], *y["known"]}),
                })
            i, j = k + 1, m + 1
        wrapper = merged
    return wrapper


def _layout(items: list[tuple], pages: list[int]) -> list[dict]:
    """The wrapper of the pages of one layout; items: key, repeated, the one text or null."""
    found = _constants([{"key": k, "opt": False, "plus": p, "const": c, "pages": pages, "known": []} for k, p, c in items])
    for x, place in zip(found, places_of([k for k, _, _ in items]), strict=True):
        x["known"] += [placed_hash(place, t) for t in x["known"]]
    return found


def infer(pages: list[str]) -> str:
    """The wrapper of a host's pages as JSON: what ``wrappers`` learns, in one process."""
    held: dict = {}
    for page in pages:
        _add(held, "", page)
    layouts = [_layout(list(zip(keys, plus, const, strict=True)), sorted(seen)) for (_, keys), (plus, const, seen) in sorted(held.items())]
    return _written(merge(layouts)) if layouts else "[]"


def _written(wrapper: list[dict]) -> str:
    return json.dumps([[x["key"], x["opt"], x["plus"], x["known"]] for x in _constants(wrapper)], ensure_ascii=False)


def _add(held: dict, host: str, page: str) -> None:
    """Count a page among those of its host and layout: repeated, constant texts, the smallest pages."""
    found = shape(page)
    seen = {text_hash(page)}
    key = host, tuple(k for k, _, _ in found)
    if key in held:
        plus, const, before = held[key]
        found = [(k, p or a, c if c == b else None) for (k, p, c), a, b in zip(found, plus, const, strict=True)]
        seen = set(sorted(seen | before)[:SEEN])
    held[key] = [p for _, p, _ in found], [c for _, _, c in found], seen


@lru_cache(4096)
def _parsed(wrapper: str) -> tuple[list, list[str], set[int]]:
    items = json.loads(wrapper)
    return items, [x[0] for x in items], {t for x in items for t in x[3]}


@lru_cache(8192)
def _matched(wrapper: str, keys: tuple[str, ...]) -> tuple[int, ...]:
    """For each folded item of a page the wrapper's item, or -1."""
    out = [-1] * len(keys)
    for i, j in matches(_parsed(wrapper)[1], list(keys)):
        out[j] = i
    return tuple(out)


def extract(page: str | None, wrapper: str | None) -> str:
    """The main text of a page under its host's wrapper."""
    if not page:
        return ""
    stream = tokens(page)
    around, elements = containers([k for k, _ in stream])
    judged, article = verdicts(elements)
    items, _, known = _parsed(wrapper or "[]")
    folded = fold([k for k, _ in stream])
    keys = [k for k, _ in folded]
    learned = bool(known) and not article
    match = _matched(wrapper, tuple(keys)) if learned else [-1] * len(keys)
    hashes = places_of(keys) if learned else [0] * len(keys)
    main = set()
    for (key, places), slot, place in zip(folded, match, hashes, strict=True):
        if key != "T":
            continue
        for i in places:
            constant = False
            if learned:
                text = text_hash(" ".join(stream[i][1].split()))
                constant = (slot >= 0 and text in items[slot][3]) or placed_hash(place, text) in known
            side, inside = judged[around[i]]
            if not side and (inside if article else not constant):
                main.add(i)
    blocks, now = [], []
    for i, (key, text) in enumerate(stream):
        if key == "T":
            if i in main:
                now.append(text)
        elif key == "<br>" or key.startswith("<br "):
            now.append(" ")
        elif key.strip("</>").split(" ")[0] not in INLINE:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


@F.arrow_udf(StringType())
def _extracted(pages: pa.Array, wrappers: pa.Array) -> pa.Array:
    return pa.array([extract(p, w) for p, w in zip(pages.to_pylist(), wrappers.to_pylist(), strict=True)], pa.string())


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_ITEMS = pa.schema([("__host", pa.string()), ("layout", pa.int64()), ("i", pa.int32()), ("key", pa.string()), ("plus", pa.bool_()), ("const", pa.int64()), ("page", pa.int64())])


def _flat(held: dict) -> pa.RecordBatch:
    rows = []
    for (host, keys), (plus, const, seen) in held.items():
        layout = text_hash("\n".join(keys))
        rows += [(host, layout, -1, None, None, None, page) for page in seen]
        rows += [(host, layout, i, *x, None) for i, x in enumerate(zip(keys, plus, const, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ITEMS, strict=True)], schema=_ITEMS)


def _shapes(batches):
    """The items of each host's layouts, counted together over as many pages as have ``HELD`` layouts."""
    held: dict = {}
    for batch in batches:
        for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _add(held, host, page)
            if len(held) >= HELD:
                yield _flat(held)
                held = {}
    if held:
        yield _flat(held)


def _merge_layouts(rows: pa.Table) -> list[dict]:
    return merge([json.loads(w) for w in rows.sort_by("layout")["wrapper"].to_pylist()])


def _merge_group(rows: pa.Table) -> pa.Table:
    first = rows.sort_by("layout").slice(0, 1)
    return pa.table({"__host": first["__host"], "layout": first["layout"], "wrapper": pa.array([json.dumps(_merge_layouts(rows))])})


def _finish_group(rows: pa.Table) -> pa.Table:
    return pa.table({"__host": rows["__host"].slice(0, 1), "__wrapper": pa.array([_written(_merge_layouts(rows))])})


@F.arrow_udf(StringType())
def _layouts(items: pa.Array, pages: pa.Array) -> pa.Array:
    return pa.array([json.dumps(_layout([(x["key"], x["plus"], x["const"]) for x in xs], p)) for xs, p in zip(items.to_pylist(), pages.to_pylist(), strict=True)], pa.string())


def layouts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """__host, layout and wrapper of every distinct folded stream of every host, over all pages."""
    slim = pages.select(host_of(F.col(url)).alias("__host"), F.col(html).alias("__html")).filter("__html IS NOT NULL")
    flat = slim.mapInArrow(_shapes, "__host string, layout long, i int, key string, plus boolean, const long, page long")
    low, high = F.min("const"), F.max("const")
    one = F.when((F.count("const") == F.count("*")) & (low == high), low).alias("const")
    counted = flat.groupBy("__host", "layout", "i").agg(F.first("key").alias("key"), F.max("plus").alias("plus"), one, F.collect_set("page").alias("pages"))
    item = F.when(F.col("i") >= 0, F.struct("i", "key", "plus", "const"))  # lists leave nulls out
    found = counted.groupBy("__host", "layout").agg(F.array_sort(F.collect_list(item)).alias("items"), F.slice(F.array_sort(F.flatten(F.collect_list("pages"))), 1, SEEN).alias("pages"))
    return found.select("__host", "layout", _layouts(F.col("items"), F.col("pages")).alias("wrapper"))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html", fan: int = FAN) -> DataFrame:
    """__host and __wrapper of every host, learned from all its pages."""
    found = cut(layouts(pages, url, html))
    while True:
        sizes = found.groupBy("__host").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= fan:
            return found.groupBy("__host").applyInArrow(_finish_group, "__host string, __wrapper string")
        # in each round a host's wrappers fall to half at most, in groups of about half of ``fan``
        dealt = found.join(broadcast_if_small(sizes, F.length("__host") + 16), "__host")
        part = F.when(F.col("n") > fan, F.pmod(F.xxhash64("layout"), F.ceil(2 * F.col("n") / fan))).otherwise(F.xxhash64("layout")).alias("part")
        found = cut(dealt.select("__host", "layout", "wrapper", part).groupBy("__host", "part").applyInArrow(_merge_group, "__host string, layout long, wrapper string"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with main_text (never null)."""
    small_batches(pages.sparkSession)
    learned = broadcast_if_small(cut(wrappers(pages, url, html)), F.length("__host") + F.length("__wrapper") + 40)
    joined = pages.withColumn("__host", host_of(F.col(url))).join(learned, "__host", "left")
    return joined.withColumn("main_text", _extracted(F.col(html), F.col("__wrapper"))).drop("__host", "__wrapper")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
