"""Main text of web pages by deduced templates.

Pages of one host are taken to be made from one template. A page is a sequence
of tokens: tags and text nodes, each with its role, the path of open structural
elements. Tokens of a host that share their occurrence vector (how often each
page has them) form an equivalence class. The vector is never gathered: per host
and token, three sums stand for it (pages, occurrences, and a sum of hashes of
page and count), which are added up before the shuffle. Frequent classes are
valid if their tokens come in one order on every page, and nest if every other
class lies within one gap of theirs; classes that break this on some page are
dropped. What is left is the host's template; its gaps are the slots.

What fills the slots decides what is content. On each page the text that isn't the
template's is added up for the innermost template element around it, and by host
over its pages. From the page's root the content region goes down into the
element that holds ``SHARE`` of the text of the region so far, as long as it stands
once on a page and leaves no heading of the pages' own outside; an ``article`` or
``main`` element is as deep as it goes. So menus, adverts or notices beside the region
go whatever their markup is called. Inside the region

* text nodes of the template go, unless their element has text of its own on some
  page, or lies in an ``article`` or ``main`` element;
* slots in elements that are labelled as menus, headers, footers, sidebars, notices,
  adverts, forms or comments (by element or class name; the part that stays a
  heuristic, since readers' comments fill slots like an article does) go; such slots
  count for no region.

A page without its host's region, or of a host with one distinct page, is taken as one
slot with the same labels, where an ``article`` or ``main`` element is preferred. A page
whose region has nothing but template text keeps that.

Text: character references are decoded, white space inside a block is one space,
blocks are joined by a line feed. Nothing else is dropped or capped.

Edge cases: null or empty html gives an empty text; unclosed elements end with
their parents; a null URL is a host of its own; pages of one host with equal html
count once in its template; no pages give no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_join, slices, stash

#: Share of a host's pages that have a template's tokens.
SUPPORT = 0.9
#: Share of a region's text that an element needs to be the region instead.
SHARE = 0.6
#: Template tokens in all that may be broadcast.
BROADCAST_TOKENS = 500_000

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
STRUCTURE = BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 li dd dt tr td th tbody thead tfoot option hr pre blockquote caption summary".split())
BOILERPLATE = frozenset("aside button dialog footer form head label menu nav search select header".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3".split())
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|aside|menu|nav\w*|breadcrumbs?|footer|foot|masthead|site-header|page-header|topbar|toolbar|cookies?|consent|notice|alert|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|widget|pagination|pager|comments?|replies|reply|respond|disqus|discussion|skip|search|form)(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Paths of elements that hold the whole page.
WHOLE = re.compile(r"/html(?:\[[^/]*)?(?:/body(?:\[[^/]*)?)?|/body(?:\[[^/]*)?")
#: A paragraph ends where one of these begins.
P_ENDS = BLOCK - frozenset("option caption summary".split())


def _hash(s: str) -> int:
    """A 62-bit hash that is the same in every process."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 2


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """``(kind, name, attributes or text, path)`` of a page in order; kind is ``open``,
    ``close`` or ``text``; path is that of the open structural elements."""
    stack: list[tuple[str, str]] = []  # name, label
    path, at, n = "", 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            s = m.group()
            if not (s.startswith(("<!", "<?")) and len(s) > 2):
                yield "text", "", s, path
            continue
        name, closing, attributes = tag.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if not closing:
            label = name
            if name in STRUCTURE:
                found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
                label = name + "".join(f"[{k}={found[k]}]" for k in sorted(found))
            yield "open", name, label, path
            if name in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = end.start() if end else n  # its content is no text; its end tag comes next
            elif name in STRUCTURE and name not in VOID and not attributes.endswith("/"):
                stack.append((name, label))
                path += "/" + label
        else:
            if name in STRUCTURE and any(x[0] == name for x in stack):
                while stack:
                    top = stack.pop()
                    path = path[: -len(top[1]) - 1]
                    if top[0] == name:
                        break
            yield "close", name, name, path


def role(kind: str, label: str, text: str, path: str) -> str | None:
    """A token's role; white space has none."""
    if kind == "text":
        s = " ".join(text.split())
        return f"text {path} {s}" if s else None
    return f"{kind} {path} {label}"


def is_boilerplate(path: str) -> bool:
    """Whether a path lies in an element of menus, adverts and so on. A header inside
    an article is part of it; so is a form that wraps the whole body."""
    labels = path.split("/")[1:]
    inside = False
    for label in labels:
        name, _, attributes = label.partition("[")
        if name in MAIN:
            inside = True
        if name in BOILERPLATE and not (name == "header" and inside):
            return True
        if attributes and name not in ("html", "body") and name not in MAIN:
            for value in re.findall(r"=([^\]]*)\]", attributes):
                if HINTS.search(value):
                    return True
    return False


def is_main(label: str) -> bool:
    name, _, attributes = label.partition("[")
    return name in MAIN or "role=main" in attributes or "itemprop=articleBody" in attributes


def in_slot(path: str, slots: frozenset[int]) -> bool:
    """Whether a path is, or lies in, a content slot (hashes of paths)."""
    if _hash(path) in slots:
        return True
    ends = [i for i, c in enumerate(path) if c == "/" and i]
    return any(not WHOLE.fullmatch(path[:i]) and _hash(path[:i]) in slots for i in ends)


def main_depth(path: str) -> bool:
    return any(map(is_main, path.split("/")[1:]))


def inside(path: str, region: str) -> bool:
    return not region or path == region or path.startswith(region + "/")


def extract(page: str, furniture: frozenset[int] = frozenset(), slots: frozenset[int] = frozenset(), region: str = "") -> str:
    """The content slots' text of a page; ``furniture``: hashes of the roles of text
    nodes that are part of the template; ``slots``: hashes of the paths of content
    slots; ``region``: the path of the host's content region, empty for none."""
    if region:
        text = _extract(page, furniture, slots, region) or _extract(page, frozenset(), slots, region)
        if text or any(inside(path, region) for *_, path in tokens(page)):
            return text
    return _extract(page, furniture, slots, "") or (_extract(page, frozenset(), slots, "") if furniture else "")


def _extract(page: str, furniture: frozenset[int], slots: frozenset[int], region: str) -> str:
    blocks: dict[bool, list[str]] = {True: [], False: []}
    run: list[str] = []
    where = (False, False)

    def flush() -> None:
        s = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if s and where[1]:
            blocks[where[0]].append(s)

    kept: dict[str, tuple[bool, bool]] = {}
    content: dict[str, bool] = {}
    main = any(map(is_main, region.split("/")[1:]))
    for kind, name, value, path in tokens(page):
        if kind == "text":
            if path not in kept:
                kept[path] = (main if region else main_depth(path), inside(path, region) and not is_boilerplate(path))
            if kept[path] != where:
                flush()
                where = kept[path]
            if furniture and where[1] and not main_depth(path) and (r := role("text", "", value, path)) and _hash(r) in furniture:
                if path not in content:
                    content[path] = in_slot(path, slots)
                if not content[path]:
                    continue
            run.append(value)
        elif name in BLOCK:
            flush()
        elif name == "br":
            run.append(" ")
    flush()
    return "\n".join(blocks[True] or blocks[False])


_SUMS = "host string, role long, text boolean, pages long, total long, low long, high long, place double"


def _roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the occurrence vectors of a task's distinct pages; role 0 counts them."""
    names = [x.split(" ")[0] for x in _SUMS.split(", ")]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    sums: dict[tuple[str, int, bool], list] = {}

    def out() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for whole in batches:
        for b in slices(whole, "html"):
            for host, digest, page in zip(*(b.column(c).to_pylist() for c in ("host", "digest", "html")), strict=True):
                seen = {}
                for i, (kind, _, value, path) in enumerate(tokens(page)):
                    r = role(kind, value, value, path)
                    if r is not None:
                        x = seen.setdefault((_hash(r) or 1, kind == "text"), [0, i])
                        x[0] += 1
                for (r, text), (n, place) in [*seen.items(), ((0, False), (1, 0))]:
                    h = _hash(f"{digest} {n}")
                    s = sums.setdefault((host, r, text), [0, 0, 0, 0, 0.0])
                    s[0] += 1
                    s[1] += n
                    s[2] += h & 0x3FFFFFFF
                    s[3] += h >> 30
                    s[4] += place
            if len(sums) > 200_000:
                yield out()
    if sums:
        yield out()


def in_order(sequence: list[int], members: list[int]) -> bool:
    """Whether the members come in one order, again and again."""
    k = len(members)
    return len(sequence) % k == 0 and all(x == members[i % k] for i, x in enumerate(sequence))


def crossing(sequence: list[int], size: dict[int, int]) -> set[int]:
    """Classes that don't nest, of ``sequence``, the classes of a page's tokens in turn, each
    with ``size`` tokens: of two classes that have tokens in two gaps of each other the
    smaller. One pass over the tokens with the stack of classes that are open."""
    bad, stack, left = set(), [], dict(size)
    for c in sequence:
        if c in bad:
            continue
        if left[c] == size[c]:
            stack.append(c)
        while stack[-1] != c:  # the classes above have begun inside a gap of c and aren't at their end
            if size[stack[-1]] > size[c]:
                bad.add(c)
                stack.remove(c)
                break
            bad.add(stack.pop())
        if c in bad:
            continue
        left[c] -= 1
        if not left[c]:
            stack.pop()
    return bad


def page_faults(page: str, classes: list[list[int]], texts: frozenset[int] = frozenset()) -> tuple[set[int], dict[str, list[int]]]:
    """Numbers of the classes that break order or nesting on a page, and for the path of
    each innermost element of the classes: characters of text outside ``texts``, the
    classes' text nodes; how many of those are its own, not deeper down; how many of
    headings; and how often the element stands on the page. Slots labelled as
    boilerplate count for nothing."""
    of = {r: c for c, members in enumerate(classes) for r in members}
    places: dict[int, list[int]] = defaultdict(list)
    sequence: list[int] = []
    paths: dict[str, list[int]] = {"": [0, 0, 0, 1]}
    innermost: dict[str, str] = {"": ""}
    heading = False

    def known(path: str) -> str:
        if path not in innermost:
            innermost[path] = path if path in paths else known(path.rpartition("/")[0])
        return innermost[path]

    for kind, name, value, path in tokens(page):
        r = role(kind, value, value, path)
        if r is None:
            continue
        h = _hash(r) or 1
        if (c := of.get(h)) is not None:
            places[c].append(h)
            sequence.append(c)
            if kind == "open" and name in STRUCTURE:
                at = f"{path}/{value}"
                paths.setdefault(at, [0, 0, 0, 0])[3] += 1
                innermost[at] = at
        if kind != "text":
            if name in HEADINGS:
                heading = kind == "open"
            elif name in BLOCK:
                heading = False
        elif h not in texts and not is_boilerplate(path):
            n, x = len(value.strip()), paths[known(path)]
            x[0] += n
            x[1] += n if path in paths else 0
            x[2] += n if heading else 0
    bad = {c for c, found in places.items() if not in_order(found, classes[c])}
    once = {c: len(classes[c]) for c, found in places.items() if c not in bad and 1 < len(found) == len(classes[c])}
    return bad | crossing([c for c in sequence if c in once], once), paths


def content_region(paths: dict[str, tuple[int, int, bool]]) -> str:
    """The path of the content region, empty for the whole page; ``paths``: characters of
    text and of headings of each innermost element, and whether it stands once a page."""
    text, heads = defaultdict(int), defaultdict(int)
    for path, (n, k, _) in paths.items():
        while True:
            text[path] += n
            heads[path] += k
            if not path:
                break
            path = path.rpartition("/")[0]
    below = defaultdict(list)
    for path, (_, _, once) in paths.items():
        if path and once:
            above = path.rpartition("/")[0]
            while above and above not in paths:
                above = above.rpartition("/")[0]
            below[above].append(path)
    at = ""
    while not (at and is_main(at.rpartition("/")[2])):
        found = max(below[at], key=lambda p: (text[p], p), default=None)
        if found is None or not text[found] or text[found] < SHARE * text[at]:
            break
        if heads[found] < heads[at] and not is_main(found.rpartition("/")[2]):
            break
        at = found
    return "" if WHOLE.fullmatch(at) else at


def deduce_templates(pages: DataFrame) -> DataFrame:
    """``(host, pages, classes, slots, region)``: valid nested classes of each host with two
    distinct pages or more, each ``(roles, text)`` in the order of the page, the hashes of
    the paths of its content slots, and the path of its content region."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    distinct = src.select(host_of().alias("host"), F.coalesce("html", F.lit("")).alias("html")).groupBy("host", F.md5("html").alias("digest")).agg(F.first("html").alias("html"))
    sums = distinct.mapInArrow(_roles, _SUMS).groupBy("host", "role", "text").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "low", "high", "place")])
    sums = stash(sums.where("pages > 1"), "roles")
    hosts = sums.where("role = 0").select("host", F.col("pages").alias("host_pages"))
    frequent = sums.where("role != 0").join(hosts, "host").where(f"pages >= {SUPPORT} * host_pages")
    member = F.struct((F.col("place") / F.col("pages")).alias("place"), "role", "text")
    classes = frequent.groupBy("host", "host_pages", "pages", "total", "low", "high").agg(F.array_sort(F.collect_list(member)).alias("m"))
    per_host = classes.groupBy("host", "host_pages").agg(F.array_sort(F.collect_list(F.struct(F.transform("m", lambda x: x.role).alias("roles"), F.transform("m", lambda x: x.text).alias("text")))).alias("classes"))
    found = stash(per_host.select("host", F.col("host_pages").alias("pages"), "classes"), "classes")

    names = ["host", "number", "path", "chars", "own", "heads", "most"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        faults, sums = set(), defaultdict(lambda: [0, 0, 0, 0])
        for whole in batches:
            for b in slices(whole, "html"):
                for host, page, classes in zip(*(b.column(c).to_pylist() for c in ("host", "html", "classes")), strict=True):
                    texts = frozenset(r for x in classes for r, text in zip(x["roles"], x["text"], strict=True) if text)
                    bad, paths = page_faults(page, [x["roles"] for x in classes], texts)
                    faults.update((host, c) for c in bad)
                    for path, x in paths.items():
                        have = sums[host, path]
                        have[:3] = [i + j for i, j in zip(have, x[:3], strict=False)]
                        have[3] = max(have[3], x[3])
        rows = [*((h, c, *[None] * 5) for h, c in faults), *((h, None, p, *x) for (h, p), x in sums.items())]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [{x["path"]: (x["chars"], x["heads"], x["most"] == 1) for x in p} for p in b.column("paths").to_pylist()]
            slots = [[_hash(x["path"]) for x in p if x["own"]] for p in b.column("paths").to_pylist()]
            yield pa.record_batch([b.column("host"), b.column("bad"), pa.array(slots, pa.list_(pa.int64())), pa.array(list(map(content_region, paths)), pa.string())], names=["host", "bad", "slots", "region"])

    # distinct pages again: copies of one page don't outweigh the others
    seen = _with_templates(distinct.select("host", "html"), found).where("classes IS NOT NULL").select("host", "html", "classes").mapInArrow(check, "host string, number long, path string, chars long, own long, heads long, most long")
    seen = stash(seen, "checked")
    bad = seen.where("number IS NOT NULL").groupBy("host").agg(F.collect_set("number").alias("bad"))
    sums = seen.where("path IS NOT NULL").groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("chars", "own", "heads")], F.max("most").alias("most"))
    sums = sums.groupBy("host").agg(F.collect_list(F.struct("path", "chars", "own", "heads", "most")).alias("paths"))  # elements of the template
    none = F.array().cast("array<bigint>")
    fit = sums.join(bad, "host", "left").select("host", F.coalesce("bad", none).alias("bad"), "paths").mapInArrow(regions, "host string, bad array<long>, slots array<long>, region string")
    valid = F.filter("classes", lambda x, i: ~F.array_contains(F.coalesce("bad", none), i.cast("long")))
    return stash(found.join(fit, "host", "left").select("host", "pages", valid.alias("classes"), F.coalesce("slots", none).alias("slots"), F.coalesce("region", F.lit("")).alias("region")), "templates")


def host_of() -> Column:
    """The host of ``url``; empty without one."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _with_templates(src: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages (with ``host`` or ``url``) with their host's classes (null: none). Templates are
    broadcast up to a size; beyond it pages are dealt by host, those of large hosts split."""
    size = templates.agg(F.sum(F.aggregate("classes", F.lit(0), lambda a, x: a + F.size(x.roles)))).first()[0] or 0
    src = src if "host" in src.columns else src.withColumn("host", host_of())
    return src.join(F.broadcast(templates), "host", "left") if size <= BROADCAST_TOKENS else skew_join(src, templates, ["host"], "left")


def main_text(pages: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """``page_id, url, text`` of each row of ``pages`` (``page_id``, ``url``, ``html``)."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    templates = deduce_templates(pages) if templates is None else templates
    furniture = F.flatten(F.transform("classes", lambda x: F.arrays_zip(x.roles.alias("roles"), x.text.alias("text"))))
    furniture = F.transform(F.filter(furniture, lambda x: x["text"]), lambda x: x["roles"])
    slim = templates.select("host", "classes", furniture.alias("furniture"), "slots", "region")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html"):
                columns = (b.column(c).to_pylist() for c in ("html", "furniture", "slots", "region"))
                texts = [extract(page or "", frozenset(f or ()), frozenset(s or ()), r or "") for page, f, s, r in zip(*columns, strict=True)]
                yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return _with_templates(src, slim).select("page_id", "url", "html", "furniture", "slots", "region").mapInArrow(run, "page_id long, url string, text string")
