"""HTML extraction by nearest-URL page differencing.

Each page is parsed into lines: the texts between block tags, with what encloses them. Pages of a host are
sorted by URL path; each is paired with the nearer by path of the last page before and the next
after it that aren't copies of it, the lines of both are aligned by a longest common subsequence, and shared lines - menus, notices, adverts,
whatever a template repeats - are deleted, inside a main element as anywhere else. What elements state breaks
ties only: a shared line inside an article element is a passage that two articles share, so it stays; an unshared line in a
navigation, header, footer, sidebar, form, advert, notice or comment element goes, as such lines
differ from page to page. A page without a partner keeps its other lines, unless its article and main elements
hold at least as much text.

The parser reads a page once, whatever its markup: no quote, comment or element that nothing closes is
looked for twice, and only a comment, a script or a style swallows what follows it.

Pages are dealt out in ranges of host and path of about `group` pages (more where there would be more than `most`
ranges), with bounds from a sample. Each range also gets the pages beside it - those of `halo` different htmls
before and after it - so that a page's partner doesn't depend on the bounds. Only keys of samples and of
ranges' ends come to the driver, at most 10 and 4 x `halo` a range. Ranges are sorted streams in a partition; a
run of copies of a range waits for the next other page, packed where it is long; a host is never collected.

Null html is empty, an empty page has an empty text; a page whose URL is null or names no host has no partner;
repeated rows are extracted one by one (a copy of a page is never its partner); an empty table
gives an empty result; other columns are ignored."""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import cut, mapped, pieces
from veilframe.llm.url_filter import host_of, path_of

# fixed values: element names
RAW = frozenset("script style noscript template svg math iframe object textarea select canvas head title".split())
# of these, what holds no markup: without a closing tag they last to the end of the page
OPAQUE = frozenset("script style textarea".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav header footer aside form button menu dialog".split())
# fixed values: words of class, id and role that mark page furniture
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice overlay pagination popup promo promoted related replies share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget".split())
# fixed values: words that mark the text itself
TEXT_MARKS = frozenset("article body content entry main page post story text".split())
# after a mark that opens a token these say that it is a part of the page: "share-buttons", not "share-price"
PARTS = frozenset("area bar block body box button buttons container count form icon icons inner item items label link links list panel posts row section slot stories tab text title top unit widget wrap wrapper zone".split())
# an open p ends where one of these begins
ENDS_P = BLOCK - {"br", "body", "html", "option"}

# what a "<" opens: a comment, a declaration, or a tag and its name
OPENS = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
# the attributes of a tag up to its end; possessive, so that nothing is tried twice
REST = re.compile(r"((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
MARKED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CAMEL = re.compile(r"([a-z])([A-Z])")
COMMENT = re.compile(r"\b(?:class|id)\s*=\s*[\"']?[^\"'>]*\b(?:comment|reply)", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}

# what a line is: page furniture, open to differencing, open inside a main element, or an article's text
FURNITURE, OPEN, MAIN, TEXT = 0, 1, 2, 3
BODY = {"main": MAIN, "article": TEXT}


def marked(attributes: str, heading: bool) -> bool:
    """Whether class, id or role name page furniture: a mark ends one of their tokens, or opens one
    that goes on with a part of a page ("ad-slot", "comment-body"), of an element that isn't named as text as well. A heading
    may be called a header."""
    tokens = [SPLIT.split(CAMEL.sub(r"\1-\2", t).lower().strip("-_")) for m in MARKED.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").split()]
    known = MARKS - {"header"} if heading else MARKS
    if any(t[-1] in known for t in tokens):
        return True
    named = any(TEXT_MARKS.issuperset(t) for t in tokens)
    return not named and any(t[0] in known and (t[1] in PARTS or t[1].isdigit()) for t in tokens if len(t) > 1)


def hidden(attributes: str) -> bool:
    """Whether an attribute says that the element isn't shown."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN.search(value):
            return True
    return False


def kind_of(name: str, attributes: str, outer: int) -> int:
    """What an element's content is: page furniture, open to evidence, or text."""
    if outer == FURNITURE or name in CHROME and not (name == "header" and outer == TEXT):
        return FURNITURE
    if attributes.strip() and name not in ("body", "html"):
        if hidden(attributes):
            return FURNITURE
        if name in BODY:
            # a reader comment may be an article, too; any other name of one says little
            return FURNITURE if COMMENT.search(attributes) else max(outer, BODY[name])
        if marked(attributes, outer == TEXT or name in HEADINGS):
            return FURNITURE
    return max(outer, BODY.get(name, outer))


def tags(page: str):
    """(start, end, name or None, closing, attributes) of each tag, comment and declaration, in one pass.

    A quote that nothing closes doesn't swallow the page: from then on a tag ends at the next ">". Without one
    what is left is text."""
    at, quoted = 0, True
    while (m := OPENS.search(page, at)) is not None:
        start, at = m.span()
        if m[1] or m[2]:
            end = page.find("-->" if m[1] else "]]>", at)
            at = len(page) if end < 0 else end + 3
            yield start, at, None, False, ""
            continue
        end = page.find(">", at)
        if end < 0:
            return
        if m[3]:
            at = end + 1
            yield start, at, None, False, ""
            continue
        rest = REST.match(page, at) if quoted else None
        quoted = rest is not None
        attributes, at = (rest[1], rest.end()) if rest else (page[at:end], end + 1)
        moved = yield start, at, m[5].lower(), bool(m[4]), attributes
        if moved is not None:
            at = moved
            yield None


def lines(page: str) -> list[tuple[str, int]]:
    """The page's lines in order, each with its kind; a header inside an article is its heading."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    blocks: list[int] = []  # places of the block elements in it
    opened: Counter[str] = Counter()
    parts: list[str] = []
    unclosed: set[str] = set()
    kind, at = OPEN, 0

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, kind))

    def close(i: int):
        nonlocal kind
        kind = stack[i][1]
        opened.subtract(x for x, _ in stack[i:])
        del stack[i:]
        while blocks and blocks[-1] >= i:
            blocks.pop()

    found = tags(page)
    for start, end, name, closing, attributes in found:
        if start > at:
            parts.append(page[at:start])
        at = end
        if name is None:
            continue
        if closing:
            if name in BLOCK:
                flush()
            if opened[name] > 0:
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                if any(s[1] != kind for s in stack[i:]) and name not in BLOCK:
                    flush()
                close(i)
            continue
        if name in RAW:
            if name not in OPAQUE and (name in unclosed or attributes.endswith("/")):
                continue
            tail = CLOSE[name].search(page, at)
            if tail or name in OPAQUE:
                at = tail.end() if tail else len(page)
                found.send(at)
            else:
                unclosed.add(name)
            continue
        if name in BLOCK:
            flush()
            if name in ENDS_P and opened["p"] > 0:
                if stack[blocks[-1]][0] == "p":
                    close(blocks[-1])
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        new = kind_of(name, attributes, kind)
        if new != kind and name not in BLOCK:
            flush()
        if name in BLOCK:
            blocks.append(len(stack))
        stack.append((name, kind))
        opened[name] += 1
        kind = new
    parts.append(page[at:])
    flush()
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Indexes of a's lines in a longest common subsequence of a and b.

    Equal ends are taken off. Where few pairs of lines are equal, Hunt and Szymanski's method goes through the pairs. Where a
    line stands many times on both sides, the lists are halved as by Hirschberg; the lengths that tell where
    to halve come from rows of bits, so that 64 pairs are one step, in memory linear in the lines."""
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        low, high, start, stop = todo.pop()
        while low < high and start < stop and a[low] == b[start]:
            found.add(low)
            low, start = low + 1, start + 1
        while low < high and start < stop and a[high - 1] == b[stop - 1]:
            high, stop = high - 1, stop - 1
            found.add(high)
        if low == high or start == stop:
            continue
        here, there = Counter(a[low:high]), Counter(b[start:stop])
        pairs = sum(n * there[line] for line, n in here.items() if line in there)
        if pairs <= 64 * (high - low + stop - start) or high - low == 1:
            found.update(low + i for i in by_pairs(a[low:high], b[start:stop]))
        else:
            middle = (low + high) // 2
            before = growth(a[low:middle], b[start:stop])
            after = growth(a[middle:high][::-1], b[start:stop][::-1])
            total = np.concatenate([[0], np.cumsum(before)]) + np.concatenate([[0], np.cumsum(after)])[::-1]
            cut_ = start + int(total.argmax())
            todo += [(low, middle, start, cut_), (middle, high, cut_, stop)]
    return found


def growth(a: list[str], b: list[str]) -> np.ndarray:
    """For each line of b whether it makes the longest common subsequence of a and b's lines so far longer by one.

    A zero in `row` is such a line; a line of a moves each zero to the first of its places behind the zero before."""
    places: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    row = full = (1 << len(b)) - 1
    masks: dict[str, int] = {}
    for line in a:
        if line not in places:
            continue
        mask = masks.get(line)
        if mask is None:
            bits = np.zeros(len(b), np.uint8)
            bits[places[line]] = 1
            mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(masks) * len(b) < 1 << 26:  # 8 MB of bits
                masks[line] = mask
        hit = row & mask
        row = ((row + hit) | (row - hit)) & full
    data = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return 1 - np.unpackbits(data, bitorder="little")[: len(b)].astype(np.int64)


def by_pairs(a: list[str], b: list[str]) -> set[int]:
    """common() by all pairs of equal lines (Hunt and Szymanski)."""
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in places.get(line, ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k] = j
                links[k] = link
    found, link = set(), links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def main_text(own: list[tuple[str, int]], partner: list[tuple[str, int]] | None) -> str:
    """The page's text, given its partner's lines. Differencing goes first; what elements state breaks ties: a
    shared line inside an article is a passage of it, a line of marked furniture goes though it isn't shared."""
    shared = common([t for t, _ in own], [t for t, _ in partner]) if partner is not None else set()
    size = Counter()
    for t, k in own:
        size[k] += len(t)
    # without a partner nothing is shared: what a page says outside its body counts only if it has hardly any
    alone = partner is None and 0 < size[MAIN] + size[TEXT] >= size[OPEN]
    return " ".join(t for i, (t, k) in enumerate(own) if (k == TEXT if i in shared else k != FURNITURE and not (alone and k == OPEN)))


def is_copy(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> bool:
    """Whether most of what a page says outside its furniture stands in the other, too, and what differs
    is nearly equal or an addition of one of them: pages of one template differ in their texts."""
    mine, theirs = ([t for t, k in side if k != FURNITURE] for side in (a, b))
    here, there = set(mine), set(theirs)
    if sum(len(t) for t in mine if t in there) <= 0.7 * sum(map(len, mine)):
        return False
    own, other = (Counter(w for t in side if t not in known for w in t.split()) for side, known in ((mine, there), (theirs, here)))
    return not own or not other or (own & other).total() >= 0.8 * max(own.total(), other.total())


def near(a: str, b: str) -> int:
    """The length of the paths' common prefix."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


class Held:
    """Pages of a range that wait for a partner: those beyond about `most` characters are packed one by one. Equal pages
    share their lines, and a range has a bounded number of pages, so this is a bounded part of a task's memory."""

    def __init__(self, most: int = 4 << 20):
        self.rows, self.room = [], most

    def add(self, page: dict, sides: list[dict], shared: bool = False) -> None:
        if self.room > 0 or shared:
            self.rows.append((page, sides))
            self.room -= 200 if shared else 200 + sum(len(t) for t, _ in page["lines"])
        else:
            self.rows.append((zlib.compress(pickle.dumps(page), 1), sides))

    def __iter__(self):
        for page, sides in self.rows:
            yield pickle.loads(zlib.decompress(page)) if isinstance(page, bytes) else page, sides


def parsed(batches):
    for batch in pieces(batches, "html", 1 << 20):
        for row in batch.to_pylist():
            row["lines"] = lines(row["html"] or "")
            row["html"] = None
            yield row


def partner_of(page: dict, sides: list[dict]) -> dict | None:
    """The nearest by path of the pages that aren't copies of the page, the earlier of equals."""
    return next((s for s in sorted(sides, key=lambda s: -near(s["path"], page["path"])) if not is_copy(page["lines"], s["lines"])), None)


def paired(rows):
    """(page, partner or None) of pages sorted by group and path. A run of copies waits for the next other page;
    the last other pages before it are carried along."""
    held, group, before, head, last = Held(), None, [], None, None
    for row in rows:
        own = row["part"], row["host"], None if row["host"] else row["page_id"]  # pages of no host have nothing in common
        if own == group and row["lines"] == head["lines"]:
            row["lines"] = head["lines"]
        if own == group and (row["lines"] is head["lines"] or is_copy(row["lines"], head["lines"]) and is_copy(head["lines"], row["lines"])):
            held.add(row, before, shared=row["lines"] is head["lines"])
            last = row
            continue
        waiting, held = held, Held()
        for page, sides in waiting:
            partner = partner_of(page, [*sides, row] if own == group else sides)
            if partner is None and own == group:
                held.add(page, sides)
            else:
                yield page, partner
        before = [] if own != group else [last] if last is head else [last, head]
        held.add(row, before)
        group, head, last = own, row, row
    for page, sides in held:
        yield page, partner_of(page, sides)


def extracted(batches):
    rows: list[tuple] = []
    size = 0
    for page, partner in paired(parsed(batches)):
        if page["place"]:
            continue  # in this group for its neighbours' sake
        text = main_text(page["lines"], partner["lines"] if partner else None)
        rows.append((page["page_id"], page["url"], text, len(text)))
        size += len(text)
        if size > 1 << 20 or len(rows) >= 5000:
            yield packed(rows)
            rows, size = [], 0
    if rows:
        yield packed(rows)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "text", "n_chars"])


def ranges(keys: DataFrame, bounds: list[tuple], halo: int) -> dict[tuple, list[int]]:
    """Which pages belong to further groups, as what stands before or after them: by key, the groups.

    Beside each end of a group these are the nearest pages of the host with `halo` different htmls, however
    many groups a run of equal ones fills. keys: host, path, id, digest; bounds: the least key of each group but
    the first."""

    @F.pandas_udf("int")
    def group_of(host: pd.Series, path: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, k) for k in zip(host, path, page, strict=True)], dtype="int32")

    placed = keys.withColumn("part", group_of("host", "path", "id"))
    seen = cut(placed.groupBy("part", "host", "digest").agg(F.min(F.struct("path", "id")).alias("low"), F.max(F.struct("path", "id")).alias("high")))
    extra: dict[tuple, list[int]] = {}
    for end, up in (("high", True), ("low", False)):  # what stands before each group, then what stands after it
        order = [F.col(c).desc() if up else F.col(c).asc() for c in ("host", end)]
        ends = seen.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*order))).where(F.col("n") <= halo)
        near_by: dict[int, list[tuple]] = {}
        for r in ends.select("part", "n", "host", F.col(f"{end}.path"), F.col(f"{end}.id"), "digest").collect():
            near_by.setdefault(r.part, []).append((r.n, (r.host, r.path, r.id), r.digest))
        # the group's host on the side where the others stand
        first = {r.part: r.host for r in seen.groupBy("part").agg((F.min if up else F.max)("host").alias("host")).collect()}
        recent: list[tuple] = []
        for part in sorted(near_by, reverse=not up):
            for key, _ in recent:
                if key[0] == first[part]:
                    extra.setdefault(key, []).append(part)
            own = [(key, digest) for _, key, digest in sorted(near_by[part])]
            known = {digest for _, digest in own}
            recent = [x for x in own + [x for x in recent if x[1] not in known] if x[0][0] == own[0][0][0]][:halo]
    return extra


def extract(pages: DataFrame, group: int = 1000, halo: int = 4, most: int = 50_000) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars. group: pages of a range of host and path, more
    where there would be more than `most` ranges; ten keys a range are sampled to the driver."""
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = named.withColumn("id", F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63))))
    keys = keyed.select("host", "path", "id", F.xxhash64("html").alias("digest"))
    count = pages.count()
    parts = min(most, -(-count // group))
    some = sorted((r.host, r.path, r.id) for r in keys.drop("digest").sample(min(1.0, 10 * parts / count), 7).collect()) if parts > 1 else []
    bounds = sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []
    extra = ranges(keys, bounds, halo) if bounds else {}

    @F.pandas_udf("array<int>")
    def groups_of(host: pd.Series, path: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([[bisect_right(bounds, k), *extra.get(k, ())] for k in zip(host, path, page, strict=True)])

    groups = groups_of("host", "path", "id") if bounds else F.array(F.lit(0))
    dealt = keyed.select("page_id", "url", "html", "host", "path", F.posexplode(groups).alias("place", "part"))
    placed = dealt.repartition("part").sortWithinPartitions("part", "host", "path", "page_id", "html")
    return mapped(placed, extracted, "page_id long, url string, text string, n_chars long")
