"""Main text of web pages: wrappers inferred by aligning the token streams of a host's pages.

A page is a stream of tags and texts. The streams of a host are folded (runs of equal groups become one repeated group) and
aligned: texts that differ become slots, tags that only some pages have become optional groups, groups that repeat a different
number of times become repeated groups. The wrapper is a regular expression without unions. It says which container holds the
article, and which of its texts are the same on all pages.

`infer` aligns some streams one after the other with the wrapper so far, in memory. `wrappers` does so for a table: all pages
of a host are aligned with a middle one, each by itself, and Spark adds up what they have at each place.
"""

from __future__ import annotations

import bisect
import html
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import text_bytes
from tenderlake.llm.url_filters import url_host

# Wrappers of more bytes than this are joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 1 << 26
# Bytes of counts, and of alignments, that a task holds at once; it sends on or forgets what it has beyond that.
HELD = 1 << 26
# Alignments of two shapes that a task holds at once.
CACHED = 1024
# Pages in a hundred that make a text the same on all of them, or not optional.
SAME = 95
# Longest run of tags that is looked at as a repeated group.
PERIOD = 12

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)", re.S)
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Elements whose content is text for the machine, up to their end tag.
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul").split())
# Elements, and words of class, id and role, that never hold the article.
OUTSIDE = frozenset("nav footer aside form button select dialog menu head".split())
OUTSIDE_WORDS = frozenset((
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer menu modal nav navbar navigation newsletter notice notices popup promo related share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget").split())
# Elements of running text.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption".split())
# Elements that may hold a whole article.
CONTAINERS = frozenset("html body div section center table tbody tr td".split())
# A start tag of the left closes an open element of the right.
CLOSES = {**{b: frozenset(["p"]) for b in BLOCKS}, "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]),
          "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]),
          "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): `<` start tag with its marks, `>` end tag, `t` text with its references decoded."""
    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            break
        if found.start() > at:
            yield "t", "", html.unescape(page[at:found.start()])
        at = found.end()
        if found["cdata"] is not None:
            yield "t", "", found["cdata"]
        name = found["name"] or found["name2"]
        if not name:
            continue
        name, attributes = name.lower(), found["attributes"] or found["attributes2"] or ""
        if found["end"] or found["end2"]:
            yield ">", name, ""
            continue
        marks = " ".join(sorted({w.lower() for m in _MARKS.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").split()}))
        yield "<", name, marks
        if name in VOID or attributes.rstrip().endswith("/") and name in ("svg", "math"):
            continue
        if name in RAW:
            # The content ends with the next end tag of that name, whatever else it holds.
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else size
            yield ">", name, ""
    if at < size:
        yield "t", "", html.unescape(page[at:])


def nodes(page: str) -> Iterator[tuple[str, tuple[str, ...], str]]:
    """(kind, path, value): tokens with the path of open elements, `name.marks` each; inline elements are no part of it."""
    path: list[str] = []
    for kind, name, value in tokens(page):
        if kind == "t":
            yield "t", tuple(path), value
        elif name not in BLOCKS and name not in OUTSIDE:
            # Inline marks keep the block together; a line break is white space.
            yield ("t", tuple(path), " ") if name in ("br", "wbr") and kind == "<" else ("i", tuple(path), name)
        elif kind == "<":
            while path and path[-1].partition(".")[0] in CLOSES.get(name, ()):
                path.pop()
            if name not in VOID:
                path.append(f"{name}.{value}")
            yield "<", tuple(path), name
        else:
            open_names = [p.partition(".")[0] for p in path]
            if name in open_names:
                del path[len(path) - 1 - open_names[::-1].index(name):]
            yield ">", tuple(path), name


def is_outside(step: str, inside_article: bool) -> bool:
    """Whether an element holds menus, notices and the like, by its name or its marks.

    Marks of the page itself say nothing of its parts. A mark of a paragraph counts as a whole word, that of a box by its
    parts too (`cookie-banner`).
    """
    name, _, marks = step.partition(".")
    if name in OUTSIDE or name == "header" and not inside_article:
        return True
    if name in ("html", "body"):
        return False
    whole = name in PARAGRAPHS
    return any(w in OUTSIDE_WORDS for m in marks.split() for w in ({m} if whole else {m, *re.split(r"[-_]+", m)}))


def boxed(path: tuple[str, ...], spared: tuple[str, ...] = ()) -> bool:
    """Whether any element of a path holds menus, notices and the like. Elements of `spared`, which hold the whole article, do
    so only by a name that never stands around one."""
    inside = False
    for n, step in enumerate(path):
        name = step.partition(".")[0]
        if is_outside(step, inside) and (name in OUTSIDE and name != "form" or path[:n + 1] != spared[:n + 1]):
            return True
        inside = inside or name in ("article", "main")
    return False


def around(paths: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The elements around all text of a page's articles, or around all text of a page without one: a form or a layout
    that holds everything is no box."""
    open_ = [p for p in paths if not any((name := s.partition(".")[0]) in OUTSIDE and name != "form" for s in p)]
    within = [p for p in open_ if in_article(p)]
    above = [p[:next(n for n, s in enumerate(p) if s.partition(".")[0] in ("article", "main"))] for p in within] or open_
    return tuple(os.path.commonprefix(above)) if above else ()


def in_article(path) -> bool:
    return any(step.partition(".")[0] in ("article", "main") for step in path)


# --- wrappers -------------------------------------------------------------------------------------------------------


def stream(page: str) -> list[list]:
    """The page as items [key, path, text hash, length] for alignment: block tags, and texts between them."""
    items: list[list] = []
    for kind, path, value in nodes(page):
        if kind == "t":
            text = " ".join(value.split())
            if text:
                items.append(["#", list(path), xxhash.xxh3_64_hexdigest(text.encode()), len(text)])
        elif kind in "<>":
            items.append([kind + value, list(path), "", 0])
    return items


def fold(items: list[list]) -> list[list]:
    """Neighbouring groups of equal keys become one group: [key, path, text, length, repeated]."""
    out = [[*i, False] if len(i) == 4 else i for i in items]
    for period in range(1, PERIOD + 1):
        folded: list[list] = []
        for item in out:
            folded.append(item)
            if len(folded) < 2 * period or item[0] != folded[-1 - period][0]:
                continue
            last, before = folded[-period:], folded[-2 * period:-period]
            if all(a[0] == b[0] and a[1] == b[1] for a, b in zip(last, before)):
                for a, b in zip(before, last):
                    a[3] += b[3]
                    a[2] = a[2] if a[2] == b[2] else None
                    a[4] = True
                del folded[-period:]
        out = folded
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The most of some pairs (by their first places) whose second places rise too."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at:at + 1], ends[at:at + 1] = [j], [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _counted(keys: list) -> list[tuple]:
    """Every key with its number among its equals."""
    seen: Counter = Counter()
    out = []
    for key in keys:
        out.append((key, seen[key]))
        seen[key] += 1
    return out


def matches(left: list, right: list) -> list[tuple[int, int]]:
    """Pairs of places of equal keys, rising on both sides.

    Keys that stand once on both sides are anchors, as far as they keep the order. Between two anchors what is equal at the
    beginning and at the end is matched, and of the rest the n-th of a key on the left with the n-th on the right, the
    most pairs that keep the order. Takes n log n steps for pages of any length.
    """
    once = {key for key, n in Counter(left).items() if n == 1} & {key for key, n in Counter(right).items() if n == 1}
    where = {key: j for j, key in enumerate(right) if key in once}
    anchors = _rising([(i, where[key]) for i, key in enumerate(left) if key in once])
    out: list[tuple[int, int]] = []
    a = c = 0
    for b, d in [*anchors, (len(left), len(right))]:
        end = (b, d)
        while a < b and c < d and left[a] == right[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        tail = 0
        while a < b - tail and c < d - tail and left[b - tail - 1] == right[d - tail - 1]:
            tail += 1
        b, d = b - tail, d - tail
        places = {key: c + j for j, key in enumerate(_counted(right[c:d]))}
        out += _rising([(a + i, places[key]) for i, key in enumerate(_counted(left[a:b])) if key in places])
        out += [(b + n, d + n) for n in range(tail)]
        if end[0] < len(left):
            out.append(end)
        a, c = end[0] + 1, end[1] + 1
    return out


def align(wrapper: list[dict], items: list[list]) -> list[dict]:
    """The wrapper made to match one more page: mismatching texts become slots, mismatching tags optional."""
    left, right = [(w["key"], *w["path"]) for w in wrapper], [(i[0], *i[1]) for i in items]
    out: list[dict] = []
    a = c = 0
    for b, d in [*matches(left, right), (len(left), len(right))]:
        out += [{**w, "optional": True} for w in wrapper[a:b]] + [_fresh(i, True) for i in items[c:d]]
        if b < len(left):
            w, item = wrapper[b], items[d]
            out.append({**w, "text": w["text"] if w["text"] == item[2] else None, "size": w["size"] + item[3],
                        "repeated": w["repeated"] or item[4]})
        a, c = b + 1, d + 1
    return out


def _fresh(item: list, optional: bool) -> dict:
    return {"key": item[0], "path": item[1], "text": item[2], "size": item[3], "repeated": item[4], "optional": optional}


def _slots(streams: list[list[list]]) -> list[dict]:
    """The texts of the wrapper of some pages that lie in no box."""
    wrapper: list[dict] = []
    for n, items in enumerate(streams):
        folded = fold(items)
        wrapper = align(wrapper, folded) if n else [_fresh(i, False) for i in folded]
    common = tuple(os.path.commonprefix([_spared(s) for s in streams]))
    return [w for w in wrapper if w["key"] == "#" and not boxed(tuple(w["path"]), common)]


def _spared(items: list[list]) -> tuple[str, ...]:
    return around([tuple(i[1]) for i in items if i[0] == "#"])


def _article_containers(slots: list[dict], several: bool) -> tuple[list[list[str]], list[list]]:
    """The marked containers of the article, and the texts of those that are part of the template.

    Containers of the same elements are one, with the marks that all of them have. One whose texts are the same on all pages
    is part of the template if another's texts differ; copies of one page tell nothing.
    """
    found: dict[tuple[str, ...], list] = {}
    for w in slots:
        at = next((n for n, s in enumerate(w["path"]) if s.partition(".")[0] in ("article", "main")), None)
        if at is None:
            continue
        steps = [s.partition(".") for s in w["path"][:at + 1]]
        marks = [set(s[2].split()) for s in steps]
        group = found.setdefault(tuple(s[0] for s in steps), [marks, False, []])
        group[0] = [a & b for a, b in zip(group[0], marks)]
        group[1] = group[1] or w["text"] is None or w["optional"]
        group[2].append([w["path"], w["text"]])
    varying = [names for names, group in found.items() if several and group[1]] or list(found)
    containers = [[f"{name}.{' '.join(sorted(m))}" for name, m in zip(names, found[names][0])] for names in varying]
    return containers, [text for names, group in found.items() if names not in varying for text in group[2]]


def infer(streams: list[list[list]]) -> dict:
    """A host's wrapper in short: the containers of the article, and texts that are part of the template.

    Pages with text in an article or main element, and others, are aligned by themselves; equal pages count once.
    `containers` are the paths of marked elements that hold the article. `main` is the path below which it stands on pages
    without a mark, the deepest container with most of the varying text. `fixed` holds (path, text hash) of what all pages
    share: on pages without a mark anywhere, on others in marked elements that never differ while another does.
    """
    streams = list({json.dumps(s): s for s in streams}.values())
    marked = [s for s in streams if any(i[0] == "#" and in_article(i[1]) and not boxed(tuple(i[1]), _spared(s)) for i in s)]
    plain = [s for s in streams if s not in marked]
    containers, fixed = _article_containers(_slots(marked), len(marked) > 1) if marked else ([], [])
    slots = _slots(plain) if plain else []
    varying = [w for w in slots if w["text"] is None or len(plain) == 1]
    main: list[str] = []
    if varying:
        total, main = sum(w["size"] for w in varying), varying[0]["path"]
        sizes: dict[tuple[str, ...], int] = {}
        for w in varying:
            for n in range(len(w["path"]) + 1):
                sizes[tuple(w["path"][:n])] = sizes.get(tuple(w["path"][:n]), 0) + w["size"]
        holds = [p for p, s in sizes.items() if 2 * s >= total and (not p or p[-1].partition(".")[0] in CONTAINERS)]
        main = list(max(holds, key=lambda p: (len(p), p)))
    fixed += [[w["path"], w["text"]] for w in slots if len(plain) > 1 and w["text"] and not w["optional"]]
    return {"containers": containers, "main": main, "fixed": fixed}


def fits(path: tuple[str, ...], container: list[str]) -> bool:
    """Whether a path leads into a container: through the same elements, each with at least the container's marks."""
    if len(path) < len(container):
        return False
    steps = [(a.partition("."), b.partition(".")) for a, b in zip(path, container)]
    return all(a[0] == b[0] and set(b[2].split()) <= set(a[2].split()) for a, b in steps)


# --- extraction -----------------------------------------------------------------------------------------------------


def extract(page: str, wrapper: dict | None) -> str:
    """The article's blocks, joined by two line feeds."""
    wrapper = wrapper or {"containers": [], "main": [], "fixed": []}
    fixed = {(tuple(path), text) for path, text in wrapper["fixed"]}
    main = tuple(wrapper["main"])
    blocks: list[tuple[tuple[str, ...], str]] = []
    buffer: list[str] = []
    last: tuple[str, ...] = ()

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        if text:
            blocks.append((last, text))
        buffer.clear()

    for kind, path, value in nodes(page):
        if kind == "t":
            if path != last:
                flush()
                last = path
            buffer.append(value)
        elif kind in "<>":
            flush()
            last = path
    flush()
    whole = around([path for path, _ in blocks])
    blocks = [b for b in blocks if not boxed(b[0], whole)]
    inside = {path for path, _ in blocks if any(fits(path, c) for c in wrapper["containers"])}
    chosen = marked = [b for b in blocks if in_article(b[0])]
    if inside:
        # Marked elements that the sampled pages lack stay, as far as their texts are not the template's.
        chosen = [b for b in marked if b[0] in inside or (b[0], xxhash.xxh3_64_hexdigest(b[1].encode())) not in fixed]
    if not chosen:
        # A page that does not match its host's wrapper keeps all that is no menu, notice and the like.
        inside = [b for b in blocks if b[0][:len(main)] == main]
        chosen = [b for b in inside or blocks if (b[0], xxhash.xxh3_64_hexdigest(b[1].encode())) not in fixed]
    return "\n\n".join(text for _, text in chosen)


def shaped(page: str) -> tuple[bool, str, list[str], int, str, list[str | None], list[int]]:
    """A page for the alignment: whether it has text in an article, digest of its stream, the elements around its text, number of
    folded items, their shape (kinds and paths, and the order of these), and hashes and lengths of the texts in that order."""
    items = stream(page)
    spared = _spared(items)
    marked = any(i[0] == "#" and in_article(i[1]) and not boxed(tuple(i[1]), spared) for i in items)
    names: dict[str, int] = {}
    ids = [names.setdefault("\n".join([i[0], *i[1]]), len(names)) for i in items]
    digest = xxhash.xxh3_128_hexdigest(json.dumps([list(names), ids, [i[2] for i in items]]).encode())
    folded = fold(items)
    texts = [i for i in folded if i[0] == "#"]
    shape = json.dumps([list(names), [names["\n".join([i[0], *i[1]])] for i in folded]])
    return marked, digest, list(spared), len(folded), shape, [i[2] for i in texts], [i[3] for i in texts]


def places(center: str, shape: str, common: tuple[str, ...]) -> list[tuple[str, str] | None]:
    """Place in the host's alignment and path of every text of a shape, None in a box.

    A text that meets one of the center has its place, another the place behind the last item that meets one, and its number
    among texts of that path there.
    """
    left, right = ([names[i] for i in order] for names, order in (json.loads(center), json.loads(shape)))
    met = {j: i for i, j in matches(left, right)}
    out: list[tuple[str, str] | None] = []
    more: Counter = Counter()
    behind = -1
    for j, name in enumerate(right):
        behind = met.get(j, behind)
        if name[0] != "#":
            continue
        path = name[2:]
        if boxed(tuple(path.split("\n")) if path else (), common):
            out.append(None)
        elif j in met:
            out.append((str(behind), path))
        else:
            out.append((f"{behind}+{more[behind, path]}", path))
            more[behind, path] += 1
    return out


def page_shapes(pages: DataFrame) -> DataFrame:
    """Every different token stream of a host once, see `shaped`."""
    rows = pages.select(url_host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).where("html is not null")

    def run(batches):
        for batch in batches:
            found = [shaped(raw.decode()) for raw in text_bytes(batch, "html")]
            types = (pa.bool_(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([f[n] for f in found], t) for n, t in enumerate(types)]],
                names=["host", "marked", "digest", "spared", "items", "shape", "texts", "sizes"])

    return rows.mapInArrow(
        run, "host string, marked boolean, digest string, spared array<string>, items long, shape string, texts array<string>, sizes array<long>"
    ).dropDuplicates(["host", "digest"])


def centers(shapes: DataFrame) -> DataFrame:
    """Per host, for pages with a mark and for others: the page of the median length that all are aligned with (the smallest
    digest of those), the number of pages, and the first and last of the elements around their texts."""
    keys = ["host", "marked"]
    lengths = shapes.groupBy(*keys, "items").agg(
        F.count("*").alias("n"), F.min_by("shape", "digest").alias("center"), F.min("spared").alias("low"), F.max("spared").alias("high"))
    group = Window.partitionBy(*keys)
    upto = F.sum("n").over(group.orderBy("items"))
    return lengths.select(
        *keys, "center", "n", upto.alias("upto"), F.sum("n").over(group).alias("total"), F.min("low").over(group).alias("low"),
        F.max("high").over(group).alias("high")).where("2 * upto >= total and 2 * (upto - n) < total").drop("n", "upto")


def slots(shapes: DataFrame, middle: DataFrame, cached: int) -> DataFrame:
    """The texts of the wrappers: host, marked, total (pages), path, text (hash; null where pages differ), optional, size.

    Every page is aligned with its center. Counts by place and text are added up in the task and then by Spark. One page in
    twenty changes nothing: from 20 pages on a text is the same, or not optional, if 95 in a hundred pages say so.
    """

    def run(batches):
        known: dict[tuple, list] = {}
        found: dict[tuple, list[int]] = {}
        held = kept = 0

        def sent():
            columns = list(zip(*[(*key, *value) for key, value in found.items()]))
            found.clear()
            types = (pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["host", "marked", "total", "place", "path", "text", "n", "size"])

        for batch in batches:
            for host, marked, total, shape, texts, sizes, center, low, high in zip(*[c.to_pylist() for c in batch.columns]):
                common = tuple(os.path.commonprefix([low, high]))
                pair = (center, shape, common)
                if pair not in known:
                    if len(known) >= cached or kept > HELD:
                        known.clear()
                        kept = 0
                    known[pair] = places(center, shape, common)
                    kept += len(center) + len(shape)
                for place, text, size in zip(known[pair], texts, sizes):
                    if place is None:
                        continue
                    key = (host, marked, total, *place, text)
                    if key not in found:
                        held += len(place[1]) + 256
                    counts = found.setdefault(key, [0, 0])
                    counts[0] += 1
                    counts[1] += size
                if held > HELD:
                    yield sent()
                    held = 0
        if found:
            yield sent()

    keys = ["host", "marked", "total", "place", "path"]
    rows = shapes.join(_placed(middle, "center"), ["host", "marked"]).select(
        "host", "marked", "total", "shape", "texts", "sizes", "center", "low", "high")
    counted = rows.mapInArrow(
        run, "host string, marked boolean, total long, place string, path string, text string, n long, size long"
    ).groupBy(*keys, "text").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    top = F.max(F.when(F.col("text").isNotNull(), F.struct("n", "text")))
    return counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("size").alias("size"), top.alias("top")).select(
        "host", "marked", "total", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "\n")).alias("path"),
        F.when(100 * F.col("top.n") >= SAME * F.col("n"), F.col("top.text")).alias("text"),
        (100 * F.col("n") < SAME * F.col("total")).alias("optional"), "size")


def _placed(df: DataFrame, column: str) -> DataFrame:
    """One row per host: sent to all tasks if the texts of a column are few bytes, else joined by a shuffle."""
    size = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def _name(step: Column | str) -> Column:
    return F.substring_index(step, ".", 1)


def _containers(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, containers) and (host, path, text) of marked templates, as `_article_containers` tells them."""
    at = F.array_position(F.transform("path", lambda s: _name(s).isin("article", "main")), True).cast("int")
    rows = texts.where("marked").withColumn("at", at).where("at > 0").withColumn("prefix", F.slice("path", 1, F.col("at"))).withColumn(
        "names", F.transform("prefix", _name))
    keys = ["host", "names"]
    groups = rows.groupBy(*keys).agg(
        F.max("total").alias("total"), F.max(F.col("text").isNull() | F.col("optional")).alias("varies"))
    some = groups.groupBy("host").agg(F.max("varies").alias("some"))
    groups = groups.join(some, "host").withColumn("kept", (F.col("total") == 1) | F.col("varies") | ~F.col("some"))
    # Marks that all prefixes of the same elements have, by the number of those that have them.
    prefixes = rows.select(*keys, "prefix").distinct()
    marks = F.filter(F.split(F.expr("substr(step, locate('.', step) + 1)"), " "), lambda m: m != "")
    shared = prefixes.select(*keys, F.posexplode("prefix").alias("pos", "step")).select(*keys, "pos", F.explode(marks).alias("mark")).groupBy(
        *keys, "pos", "mark").agg(F.count("*").alias("n"))
    steps = shared.join(prefixes.groupBy(*keys).agg(F.count("*").alias("n")), [*keys, "n"]).groupBy(*keys, "pos").agg(
        F.concat_ws(" ", F.sort_array(F.collect_list("mark"))).alias("marks"))
    steps = steps.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", "marks"))).alias("marks"))
    container = F.transform("names", lambda x, n: F.concat(x, F.lit("."), F.coalesce(F.try_element_at("marks", n), F.lit(""))))
    containers = groups.where("kept").join(steps, keys, "left").groupBy("host").agg(F.sort_array(F.collect_list(container)).alias("containers"))
    return containers, rows.join(groups.where("not kept"), keys, "left_semi").select("host", "path", "text")


def _main(texts: DataFrame) -> DataFrame:
    """(host, main): the deepest container with half of the varying text of the pages without a mark."""
    sizes = texts.where("not marked and (text is null or total = 1)").groupBy("host", "path").agg(F.sum("size").alias("size"))
    total = sizes.groupBy("host").agg(F.sum("size").alias("whole"))
    prefixes = sizes.select("host", "size", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", 1, n))).alias("main")).groupBy("host", "main").agg(F.sum("size").alias("size"))
    holds = (F.size("main") == 0) | _name(F.try_element_at("main", F.lit(-1))).isin(*CONTAINERS)
    return prefixes.where(holds).join(total, "host").where("2 * size >= whole").groupBy("host").agg(
        F.max(F.struct(F.size("main"), "main"))["main"].alias("main"))


def wrappers(pages: DataFrame, cached: int = CACHED) -> DataFrame:
    """(host, wrapper as JSON), inferred from all pages of each host; see `infer` for its parts.

    All pages are aligned with one of them, each by itself, and what they have at a place is counted by Spark. A task holds counts
    of HELD bytes and `cached` alignments at most; neither changes a wrapper.
    """
    from tenderlake.llm.common import stored

    shapes = stored(page_shapes(pages), "page-shapes")
    middle = stored(centers(shapes), "centers")
    texts = stored(slots(shapes, middle, cached), "slots")
    containers, templates = _containers(texts)
    same = texts.where("not marked and total > 1 and text is not null and not optional").select("host", "path", "text")
    fixed = templates.unionByName(same).groupBy("host").agg(F.sort_array(F.collect_set(F.struct("path", "text"))).alias("fixed"))
    found = middle.select("host").distinct()
    for part in (containers, _main(texts), fixed):
        found = found.join(part, "host", "left")
    wrapper = F.struct(
        F.coalesce("containers", F.array().cast("array<array<string>>")).alias("containers"), F.coalesce("main", F.array().cast("array<string>")).alias("main"),
        F.coalesce("fixed", F.array().cast("array<struct<path:array<string>,text:string>>")).alias("fixed"))
    return found.select("host", F.to_json(wrapper).alias("wrapper"))


def parsed_wrapper(wrapper: str) -> dict:
    found = json.loads(wrapper)
    return {**found, "fixed": [[f["path"], f["text"]] for f in found["fixed"]]}


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text (main text, empty if none), n_chars.

    A null or empty html has an empty text. A null url counts as one more host. A null page_id stays null; repeated rows
    are extracted each. Other columns are not read. An empty table gives an empty table.
    """
    from tenderlake.llm.common import stored

    known = _placed(stored(wrappers(pages), "wrappers"), "wrapper")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", url_host(F.col("url"))).join(known, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches):
        parsed: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            texts = []
            for raw, wrapper in zip(text_bytes(batch, "html"), batch.column(3).to_pylist()):
                if wrapper not in parsed:
                    parsed[wrapper] = parsed_wrapper(wrapper)
                texts.append(extract((raw or b"").decode(), parsed[wrapper]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
