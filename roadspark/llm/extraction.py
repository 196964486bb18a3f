"""HTML main-text extraction with wrappers: union-free regular expressions inferred per host.

A page is read as a stream of tags (with their first class) and texts. A host's wrapper starts as its
first page's expression, and the stream of every further page is aligned with it: tags that match stay,
a tag that only one side has becomes optional, a tag that recurs in one parent, or that comes before
and after another, becomes (part of) a repeated group, and texts that differ become slots. This
alignment gives the same wrapper in any order, so every task aligns its own pages and the results are
aligned by grouped aggregation over all pages of a host; no page is left out and none is sampled.

A page is read through its host's wrapper, which alone says what is content:

* From the root, the reader goes down into the container (or cell of a layout table) that holds most
  (DOMINANT) of the slots' text of its parent, over all pages that have it: menus, sidebars and adverts
  beside it stay outside.
* Constants (a text that at least CONSTANT of the different contents with its place have there, of
  more than two) are template text and no slots.
* Places with mostly linked text, and containers beside the main text that are a list of records (a
  repeated group of containers: reader comments, teasers) hold no main text.

HTML's own words help: elements that never hold main text (nav, footer, aside, form, script, ..., a
header outside article and main, an article within an article, which is a comment by the standard) are
left out, and article or main is gone into where a page has it. Class names and ids are only looked at
below that for containers and blocks that aren't dominant.

Edge cases: null or empty html gives the empty text; a null url is the host ''; pages without markup
are one block; unclosed tags end with their container; an unclosed comment or script ends with the
page; constants that are most of a page's main text are content (copies); a host with one page has no
constants; rows that repeat a page_id are read row by row; extra columns are ignored; an empty table
gives no rows. Time and memory are linear in the page's length, whatever its markup.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, table

#: Share of its parent's slot text that makes a container the way to the main text, of pages' contents that makes a text constant, of linked text that makes a menu, and of records that makes a list.
DOMINANT, CONSTANT, LINKED, RECORDS = 0.6, 0.9, 0.5, 0.8
#: Places that a task gathers before it hands them on, bytes of wrappers that are broadcast, pages of a host for each of its copies otherwise.
HELD, BROADCAST, PER_COPY = 20_000, 32 << 20, 20_000
#: Elements that never hold main text, block elements, void elements, containers, elements whose content is no markup.
NOISE = set("head nav footer aside form script style noscript template iframe svg button select option menu dialog textarea object embed canvas map label input".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul br option".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("html body main article section div td center".split())
GRID = set("table tbody tr td".split())
LISTS = set("ul ol table dl select menu".split())
ITEMS = set("li td th tr dd dt option".split())
ROOTS = set("article body main".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NOISY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|nav\w*|menu\w*|breadcrumbs?|footer|comments?|disqus|replies|reply|cookies?|notices?|consent|newsletter|subscribe|share|sharing|social|related|recommended|popup|modal|widget|masthead|copyright|login|signup|search)(?:$|[\s_-])",
    re.I,
)
PAGE_HEAD = re.compile(r"(?:^|[\s_-])(?:header|topbar|site-title)(?:$|[\s_-])", re.I)
#: A tag without quotes, and one whose quotes are closed; neither gives back what it took, so a failure costs one pass.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>\"']*+)>")
QUOTED = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>?")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "svg")}
ATTRIBUTE = re.compile(r"""([\w:-]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
#: Numbers of pages and posts in class names.
DIGITS = re.compile(r"\d{3,}")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open"|"close"|"text", tag, attributes or text), in one pass over the page."""
    at, last, closed = 0, page.rfind(">"), True
    while True:
        i = page.find("<", at)
        if i < 0 or i > last:
            # what follows the last ">" holds no tag
            if at < len(page):
                yield "text", "", page[at:]
            return
        if i > at:
            yield "text", "", page[at:i]
        m = TAG.match(page, i)
        if m is None and page[i + 1 : i + 2] in ("!", "?"):
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                at = len(page) if end < 0 else end + 3
            else:
                at = page.find(">", i) + 1
            continue
        if m is None and closed:
            m = QUOTED.match(page, i)
            if m is None and page[i + 1 : i + 3].lstrip("/")[:1].isalpha():
                closed = False  # some quote stays open to the end: from here on quotes mean nothing
        if m is None and not closed:
            m = LOOSE.match(page, i)
        if m is None:
            yield "text", "", "<"
            at = i + 1
            continue
        at, tag = m.end(), m[2].lower()
        if not m[1] and tag in RAW:
            end = RAW[tag].search(page, at)
            at = len(page) if end is None else end.end()
            continue
        yield ("close" if m[1] else "open"), tag, m[3]


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


@lru_cache(maxsize=1 << 17)
def _place(above: int, label: str) -> int:
    """The 64-bit name of the place that a label has below another; a chain of hashes, so its size doesn't grow with depth."""
    return int.from_bytes(blake2b(f"{above}/{label}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _text_key(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


ROOT = 0


class Page:
    """One page's stream: its blocks of text, and for every place what aligning the page says of it.

    blocks: [place, text, linked characters]. places: place -> [above, label, tag, named, instances,
    parents that have it, whether one has it twice]. after: (above, label, next label).
    """

    __slots__ = ("after", "blocks", "places")

    def __init__(self, page: str) -> None:
        self.blocks: list[tuple[int, str, int]] = []
        self.places: dict[int, list] = {}
        self.after: set[tuple[int, str, str]] = set()
        blocks, places, after = self.blocks, self.places, self.after
        # tag, noise, place, inside an article or main, labels seen in it, the last of them
        stack: list[list] = [["", False, ROOT, False, set(), ""]]
        open_at: dict[str, list[int]] = {}
        fences: dict[str, list[int]] = {"box": [-1], "list": [-1], "root": [-1]}
        run: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if run:
                if not stack[-1][1]:
                    text = "".join(run)
                    text = " ".join((entities.unescape(text) if "&" in text else text).split())
                    if text:
                        blocks.append((stack[-1][2], text, min(linked, len(text))))
                run.clear()
                linked = 0

        def cut(k: int) -> None:
            while len(stack) > k:
                tag = stack.pop()[0]
                open_at[tag].pop()
                for kind, of in (("box", CONTAINERS), ("list", LISTS), ("root", ROOTS)):
                    if tag in of:
                        fences[kind].pop()

        def innermost(tag: str) -> int:
            found = open_at.get(tag)
            return found[-1] if found else -1

        for kind, tag, rest in tokens(page):
            if kind == "text":
                if not stack[-1][1]:
                    run.append(rest)
                    if open_at.get("a"):
                        linked += len(rest.strip())
            elif kind == "open":
                if tag in BLOCKS:
                    if tag != "br":
                        k = innermost("p")
                        if k > fences["box"][-1]:
                            flush()
                            cut(k)
                        k = innermost(tag) if tag in ITEMS else -1
                        if k > fences["list"][-1]:
                            flush()
                            cut(k)
                        if tag in HEADINGS and stack[-1][0] in HEADINGS:
                            flush()
                            cut(len(stack) - 1)
                    flush()
                if tag in VOID:
                    continue
                _, noise, place, inside, seen, before = stack[-1]
                named, label = False, tag
                if not noise:
                    noise = tag in NOISE or (tag == "header" and not inside) or (tag == "article" and innermost("article") >= 0)
                    if rest and not noise:
                        found = _attributes(rest)
                        noise = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "")
                        names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
                        named = bool(NOISY.search(names) or (not inside and PAGE_HEAD.search(names))) and tag not in ("html", "body")
                        first = found.get("class", "").split()
                        if tag in BLOCKS and (first or found.get("id")):
                            label = f"{tag}.{DIGITS.sub('0', first[0])}" if first else f"{tag}#{DIGITS.sub('0', found['id'])}"
                    if (tag in BLOCKS or named) and not noise:
                        above, place = place, _place(place, label)
                        node = places.setdefault(place, [above, label, tag, named, 0, 0, False])
                        node[4] += 1
                        if label in seen:
                            node[6] = True
                        else:
                            seen.add(label)
                            node[5] += 1
                        if before:
                            after.add((above, before, label))
                        stack[-1][5] = label
                        seen = set()
                k = len(stack)
                stack.append([tag, noise, place, inside or tag in ("article", "main"), seen, ""])
                open_at.setdefault(tag, []).append(k)
                for name, of in (("box", CONTAINERS), ("list", LISTS), ("root", ROOTS)):
                    if tag in of:
                        fences[name].append(k)
            else:
                k = innermost(tag)
                if k > 0 and (tag in ROOTS or tag == "html" or k > fences["root"][-1]):
                    if tag in BLOCKS or tag in NOISE or stack[k][1] or stack[k][2] != stack[k - 1][2]:
                        flush()
                    cut(k)
        flush()

    def chain(self, place: int) -> Iterator[int]:
        """The place and those above it."""
        while place != ROOT:
            yield place
            place = self.places[place][0]

    def content(self) -> int:
        return _text_key("\0".join(t for _, t, _ in self.blocks))

    def masses(self) -> dict[int, list[int]]:
        """place -> [characters, linked ones] at and below it."""
        out: dict[int, list[int]] = {}
        own: dict[int, list[int]] = {}
        for place, text, linked in self.blocks:
            got = own.setdefault(place, [0, 0])
            got[0] += len(text)
            got[1] += linked
        # places are kept in the order in which they open, so the parts come after the whole
        for place in [*reversed(self.places), ROOT]:
            a, b = out.setdefault(place, [0, 0]), own.get(place, (0, 0))
            a[0] += b[0]
            a[1] += b[1]
            if place != ROOT:
                up = out.setdefault(self.places[place][0], [0, 0])
                up[0] += a[0]
                up[1] += a[1]
        return out


class Wrapper:
    """What a host's expression says to its reader: shares of dominant places, places without main text, constants."""

    __slots__ = ("constants", "out", "shares")

    def __init__(self, shares: dict[int, float] | None = None, out: frozenset = frozenset(), constants: frozenset = frozenset()) -> None:
        self.shares, self.out, self.constants = shares or {}, out, constants


def main_text(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The page's main text, read through its host's wrapper."""
    read, wrapper = Page(page or ""), wrapper or Wrapper()
    if not read.blocks:
        return ""
    masses = read.masses()
    below: dict[int, list[int]] = {}
    for place, (above, _, tag, *_) in read.places.items():
        if tag in CONTAINERS and masses[place][0] and place not in wrapper.out:
            if tag == "td":  # a layout's cell is reached from what holds its table
                while above != ROOT and read.places[above][2] in GRID and above in wrapper.shares:
                    above = read.places[above][0]
            below.setdefault(above, []).append(place)
    region, way = ROOT, set()
    while True:
        inner = below.get(region, [])
        named = [p for p in inner if read.places[p][2] in ("article", "main")]
        dominant = named or [p for p in inner if p in wrapper.shares]
        if not dominant and region == ROOT:
            dominant = inner  # html, or body in a fragment
        if not dominant:
            # the page's own article, however deep
            dominant = [p for p in read.places if read.places[p][2] in ("article", "main") and masses[p][0] and region in read.chain(p)] if region != ROOT and not _within(read, region) else []
        if not dominant:
            break
        region = max(dominant, key=lambda p: (wrapper.shares.get(p, 0.0), masses[p][0]))
        way.update(read.chain(region))

    fits: dict[int, bool] = {ROOT: region == ROOT}

    def fit(place: int) -> bool:
        trail = []
        while place not in fits:
            trail.append(place)
            place = read.places[place][0]
        good = fits[place]
        for p in reversed(trail):
            above, _, tag, named, *_ = read.places[p]
            if p == region:
                good = True
            elif p in way:
                good = False
            elif tag == "h1" and above in way | {ROOT}:
                good = p not in wrapper.out and not named  # the title above its article
            else:
                good = good and p not in wrapper.out and (p in wrapper.shares or not named)
            fits[p] = good
        return good

    chosen = [(p, t) for p, t, _ in read.blocks if fit(p)]
    fixed = [bool(wrapper.constants) and (p, _text_key(t)) in wrapper.constants for p, t in chosen]
    slots = [t for (_, t), f in zip(chosen, fixed, strict=True) if not f]
    if 2 * sum(map(len, slots)) < sum(len(t) for _, t in chosen):
        slots = [t for _, t in chosen]
    return "\n".join(slots)


def _within(read: Page, place: int) -> bool:
    return any(read.places[p][2] in ("article", "main") for p in read.chain(place))


def host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))


READ = "kind int, host string, place long, above long, label string, tag string, n long, instances long, parents long, twice boolean, mass long, linked long, up long, texts array<struct<place:long,text:long,size:int>>"
_TEXTS = pa.list_(pa.struct([("place", pa.int64()), ("text", pa.int64()), ("size", pa.int32())]))
_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3, pa.bool_(), *[pa.int64()] * 3, _TEXTS]
_NAMES = [f.split()[0] for f in READ.split(", ")]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligns a task's pages, by host. Kind 0: a page's content (place) and texts; 1: a place of a host's expression; 2: a label (tag) that follows another (label) below a place (above)."""
    nodes: dict[tuple[str, int], list] = {}
    after: set[tuple] = set()

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * len(_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

    def known() -> Iterator[pa.RecordBatch]:
        out = [(1, h, p, *x[:3], *x[3:6], x[6], *x[7:], None) for (h, p), x in nodes.items()]
        out += [(2, h, None, above, a, b, *[None] * 8) for h, above, a, b in after]
        for k in range(0, len(out), 10_000):
            yield rows(out[k : k + 10_000])
        nodes.clear()
        after.clear()

    for batch in batches:
        out = []
        for h, page in zip(batch["host"].to_pylist(), batch["html"], strict=True):
            read = Page(page.as_py())
            if not read.blocks:
                continue
            masses = read.masses()
            for p, (above, label, tag, _, instances, parents, twice) in read.places.items():
                node = nodes.get((h, p))
                if node is None:
                    node = nodes[h, p] = [above, label, tag, 0, 0, 0, False, 0, 0, 0]
                mass, linked = masses[p]
                all_mass, all_linked = masses[above]
                for k, x in ((3, 1), (4, instances), (5, parents), (7, mass), (8, linked), (9, all_mass - all_linked)):
                    node[k] += x
                node[6] = node[6] or twice
            after.update((h, *x) for x in read.after)
            seen = {(p, _text_key(t)): len(t) for p, t, _ in read.blocks}
            out.append((0, h, read.content(), *[None] * 10, [{"place": p, "text": t, "size": n} for (p, t), n in seen.items()]))
            if len(nodes) + len(after) > HELD:
                yield from known()
        yield rows(out)
    yield from known()


def aligned(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """What aligning every page gives, written once and read several times."""
    return scratch.keep(pages.where("html is not null").select(host("url").alias("host"), "html").mapInArrow(_aligned, READ), "aligned")


def places(found: DataFrame) -> DataFrame:
    """(host, place, above, label, tag, n, instances, parents, twice, mass, linked, up): the hosts' expressions, place by place."""
    sums = [F.sum(c).alias(c) for c in ("n", "instances", "parents", "mass", "linked", "up")]
    return found.where("kind = 1").groupBy("host", "place").agg(*(F.first(c).alias(c) for c in ("above", "label", "tag")), *sums, F.max("twice").alias("twice"))


def constants(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, place, text, size, contents): the template texts of every host; copies of a page count once."""
    once = found.where("kind = 0").groupBy("host", F.col("place").alias("content")).agg(F.first("texts").alias("texts"))
    # a content whose texts are all known elsewhere still counts; its texts are what is dealt on
    rows = scratch.keep(once, "contents")
    texts = rows.select("host", F.explode("texts").alias("t")).groupBy("host", F.col("t.place").alias("place"), F.col("t.text").alias("text")).agg(F.count("*").alias("n"), F.max("t.size").alias("size")).where("n > 2")
    having = rows.select("host", F.explode(F.array_distinct("texts.place")).alias("place")).groupBy("host", "place").agg(F.count("*").alias("contents"))
    return texts.join(having, ["host", "place"]).where(F.col("n") >= F.lit(CONSTANT) * F.col("contents")).select("host", "place", "text", "size", "contents")


def below(chars: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, place, dead): the characters of (host, place, chars) at and below every place that has any.

    Sums double their reach each round, so there are as many rounds as the depth has binary digits.
    """
    if chars.isEmpty():
        return chars.select("host", "place", F.col("chars").alias("dead"))
    own = chars.groupBy("host", "place").agg(F.sum("chars").alias("dead"))
    now, k = scratch.keep(nodes.select("host", "place", "above").join(own, ["host", "place"], "left").select("host", "place", "above", F.coalesce("dead", F.lit(0)).alias("dead")), "below-0"), 0
    while not now.where(F.col("above") != ROOT).isEmpty():
        k += 1
        given = now.where((F.col("above") != ROOT) & (F.col("dead") > 0)).groupBy("host", F.col("above").alias("place")).agg(F.sum("dead").alias("more"))
        jumps = now.select("host", F.col("place").alias("above"), F.col("above").alias("further"))
        step = now.join(given, ["host", "place"], "left").join(jumps, ["host", "above"], "left")
        now = scratch.keep(step.select("host", "place", F.coalesce("further", F.lit(ROOT)).alias("above"), (F.col("dead") + F.coalesce("more", F.lit(0))).alias("dead")), f"below-{k}")
        scratch.drop(f"below-{k - 1}")
    return now.where("dead > 0").select("host", "place", "dead")


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, n, shares, out, constants): every host's wrapper for its reader, from all its pages."""
    found = aligned(pages, scratch)
    nodes = scratch.keep(places(found), "places")
    fixed = scratch.keep(constants(found, scratch), "constants")
    dead = below(fixed.select("host", "place", (F.col("size") * F.col("contents")).alias("chars")), nodes, scratch)
    slots = nodes.join(dead, ["host", "place"], "left").join(dead.select("host", F.col("place").alias("above"), F.col("dead").alias("dead_up")), ["host", "above"], "left")
    mass = F.greatest(F.col("mass") - F.col("linked") - F.coalesce("dead", F.lit(0)), F.lit(0))
    # the parent's constants are taken for the share of its pages that have this place
    all_n = nodes.select("host", F.col("place").alias("above"), F.col("n").alias("n_up"))
    slots = slots.join(all_n, ["host", "above"], "left")
    whole = F.greatest(F.col("up") - F.coalesce("dead_up", F.lit(0)) * F.col("n") / F.coalesce("n_up", "n"), mass)
    slots = scratch.keep(slots.select("host", "place", "above", "tag", "n", "twice", F.col("mass"), F.col("linked"), F.when((whole > 0) & F.col("tag").isin(*CONTAINERS, *GRID) & ~(F.col("tag").isin(*GRID) & F.col("twice")), mass / whole).alias("share")), "slots")
    records = slots.where(F.col("tag").isin(*CONTAINERS) & F.col("twice")).groupBy("host", F.col("above").alias("place")).agg(F.sum("mass").alias("in_records"))
    judged = slots.join(records, ["host", "place"], "left")
    dominant = F.coalesce(F.col("share") >= DOMINANT, F.lit(False))
    listed = F.col("tag").isin(*(CONTAINERS - {"html", "body", "article", "main"})) & (F.coalesce("in_records", F.lit(0)) >= F.lit(RECORDS) * F.col("mass"))
    out = ~dominant & ~F.col("tag").isin("html", "body", "article", "main") & (F.col("mass") > 0) & ((F.col("linked") > F.lit(LINKED) * F.col("mass")) | listed)
    judged = judged.select("host", "place", "n", "share", dominant.alias("dominant"), out.alias("out"))
    known = judged.groupBy("host").agg(
        F.max("n").alias("n"), F.collect_list(F.when(F.col("dominant"), F.struct("place", "share"))).alias("shares"), F.collect_list(F.when(F.col("out"), F.col("place"))).alias("out")
    )
    texts = fixed.groupBy("host").agg(F.collect_list(F.struct("place", "text")).alias("constants"))
    return scratch.keep(known.join(texts, "host", "left"), "wrappers")


def expressions(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, expression): every host's wrapper as text; ``x?`` is optional, ``(x y?)+`` a repeated group, ``#`` a place of text."""
    found = aligned(pages, scratch)
    nodes = places(found).select("host", F.struct("place", "above", "label", "instances", "parents", "twice").alias("node"))
    order = found.where("kind = 2").select("host", F.struct("above", F.col("label").alias("a"), F.col("tag").alias("b")).alias("order")).distinct()
    texts = found.where("kind = 0").select("host", F.explode(F.array_distinct("texts.place")).alias("at")).distinct()
    rows = nodes.groupBy("host").agg(F.collect_list("node").alias("nodes"))
    rows = rows.join(order.groupBy("host").agg(F.collect_list("order").alias("order")), "host", "left").join(texts.groupBy("host").agg(F.collect_set("at").alias("texts")), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown = [expression(r["nodes"], r["order"] or [], set(r["texts"] or [])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array(shown, pa.string())], names=["host", "expression"])

    return rows.mapInArrow(run, "host string, expression string")


def expression(nodes: list[dict], order: list[dict], texts: set[int]) -> str:
    """The union-free expression of a host's places, the order of their labels and the places of text."""
    below: dict[int, list[dict]] = {}
    instances = {ROOT: None}
    for node in nodes:
        below.setdefault(node["above"], []).append(node)
        instances[node["place"]] = node["instances"]
    follows: dict[int, set] = {}
    for o in order:
        follows.setdefault(o["above"], set()).add((o["a"], o["b"]))

    def shown(place: int, depth: int = 0) -> str:
        own = {n["label"]: n for n in below.get(place, [])}
        nexts: dict[str, set[str]] = {label: set() for label in own}
        for a, b in follows.get(place, ()):
            nexts[a].add(b)
        reach: dict[str, set[str]] = {}
        for label in own:
            todo, got = [label], set()
            while todo:
                new = nexts[todo.pop()] - got
                got |= new
                todo += new
            reach[label] = got
        parts, done = ["#"] if place in texts else [], set()
        # what more labels can still follow comes first
        for label in sorted(own, key=lambda x: (-len(reach[x]), x)):
            if label in done:
                continue
            group = sorted([x for x in own if x == label or (label in reach[x] and x in reach[label])], key=lambda x: (-own[x]["parents"], x))
            done.update(group)
            several = len(group) > 1
            items = []
            for x in group:
                n = own[x]
                inner = f"{x}({shown(n['place'], depth + 1)})" if depth < 200 and (n["place"] in below or n["place"] in texts) else x
                optional = instances[place] is not None and n["parents"] < instances[place]
                items.append(inner + ("*" if optional and n["twice"] else "+" if n["twice"] else "?" if optional or several else ""))
            parts.append(f"({' '.join(items)})+" if several else items[0])
        return " ".join(parts)

    return shown(ROOT)


def extract(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html).

    Wrappers are broadcast while they are small; beyond BROADCAST bytes they are joined, each with as
    many copies as its host's number of pages asks for, so no host is one task's work.
    """
    scratch = scratch or Scratch(pages.sparkSession, "extraction")
    found = wrappers(pages, scratch)
    size = found.agg(F.sum(16 * F.size("shares") + 8 * F.size("out") + 16 * F.greatest(F.size("constants"), F.lit(0)) + F.length("host") + 32)).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host("url").alias("host"))
    known = found.select(F.col("host").alias("h"), "n", "shares", "out", "constants")
    if size <= BROADCAST:
        rows = rows.join(F.broadcast(known.drop("n")), F.col("host") == F.col("h"), "left")
    else:
        copies = F.ceil(F.col("n") / PER_COPY).cast("int")
        sizes = known.select(F.col("h").alias("s"), copies.alias("copies")).where("copies > 1")  # hosts of more than PER_COPY pages: fewer than rows / PER_COPY
        rows = rows.join(F.broadcast(sizes), F.col("host") == F.col("s"), "left").withColumn("copy", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("copies", F.lit(1))))
        rows = rows.join(known.withColumn("copy_of", F.explode(F.sequence(F.lit(0), copies - 1))), (F.col("host") == F.col("h")) & (F.col("copy") == F.col("copy_of")), "left")
    rows = rows.select("page_id", "url", "html", "host", "shares", "out", "constants")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        for batch in batches:
            texts = []
            for k, h in enumerate(batch["host"].to_pylist()):
                wrapper = held.get(h)
                if wrapper is None:
                    if len(held) >= 256:
                        held.clear()
                    shares, out, fixed = (batch[c][k].as_py() or [] for c in ("shares", "out", "constants"))
                    wrapper = held[h] = Wrapper({s["place"]: s["share"] for s in shares}, frozenset(out), frozenset((c["place"], c["text"]) for c in fixed))
                texts.append(main_text(batch["html"][k].as_py(), wrapper))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the main text of all pages."""
    return extract(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html"))
