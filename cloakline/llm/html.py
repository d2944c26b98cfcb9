"""Main text of web pages: a host's suffix array finds what its pages repeat, structure says where main text lies.

A page is cut into blocks. Elements that are never main text (menus, page headers, footers, sidebars, forms, scripts,
and any element with a whole class or id name for notices, adverts, comments and the like, or such a role) are
boilerplate; what lies in article or main, or in a div or section named as a body, is content; everything else is
boilerplate on a page that has such a landmark and open on a page without one. A block's slot is the path of block
elements to it, by names and, for div, section, table and lists, by their places among their siblings.

The token streams of a host's pages, in which each block begins with its slot, are concatenated, with a separator of its
own after each page, and sorted by prefix doubling. Doubling stops at `least_tokens`: suffixes that agree that far are
neighbours then, and every longer repeat is a run of such windows. Windows that occur on two distinct pages cover their
tokens. A slot that is open is boilerplate on a host if `slot_share` of the pages that have it have it covered (80 % of
its tokens): its blocks go, unique ones too. Of what is left of a page, covered tokens go and unique runs stay, unless
`copy_share` of it is covered: such a page is a copy of another's text and keeps it. A page left with nothing keeps its
open blocks.

Content goes through the array too, on every host: a window that holds a token of content on `notice_share` of the
host's pages with content, and on `notice_pages` at least, is a notice's, whatever element it is in. A block of content
whose tokens are covered by such windows (80 %) is boilerplate, unless such blocks are `copy_share` of the page's
content: such a page is a copy and keeps it. A notice of fewer tokens than a window stays, as it is covered only
together with its neighbours. Structure is asked after that, of blocks that the array leaves.

A host's pages are dealt to groups of about `group_chars` of html, so a host with a third of all pages is no single
task. Windows that hold an open token without a partner in its group are compared, by their hashes, with all windows of
the host's groups, and slots are counted over the whole host. A notice's window has its share in one of the host's
groups at least, so each group's array names its own, and those named are counted over the whole host. Groups change no
result.

Defined cases: null or empty html gives empty text; null urls share one host; repeated rows are one page for finding
repeats, each with its own result (for notices, rows of equal html); other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches_of, chain, mix, quiet, shingle_hashes, small_batches

BOILERPLATE, CONTENT, OPEN = 0, 1, 2
#: A tag, comment or declaration; quoted values may hold ">".
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "svg", "math", "object", "canvas", "audio", "video"}
NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu"}
LANDMARKS = {"article", "main"}
BLOCKS = set("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul option legend".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a slot tells from their siblings of the same name.
PLACED = set("div section table ul ol dl".split())
#: Opening one of these ends an open element of the same kind.
CLOSES_ITSELF = set("p li dd dt option td th tr".split())
#: Whole names of classes and ids: a word for boilerplate, alone or with words for its place, owner or form.
HINT = re.compile(
    r"(?:^|\s)(?:(?:site|page|main|top|bottom|left|right|header|footer|primary|secondary|global|mobile|reader|user|post|article|entry|cookie|gdpr|privacy|email|social|text|google|widget)[_-]+)*"
    r"(?:ads?|ad\d+|adv|advert(?:s|isements?|ising)?|adsense|adslot\d*|sponsor(?:s|ed)?|promos?|promotions?|banners?|side-?bars?|menus?|nav|navbar|navigation|\w+nav|breadcrumbs?|footer|site-?header|page-?header|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|notifications?|alerts?|pop-?ups?|modals?|overlay|newsletters?|subscribe|subscriptions?|sign-?up|log-?in|share|sharing|social|comments?|commentlist|disqus\w*|replies|respond|related|recommended|recommendations?|widgets?|pagination|pager|skip-?link|tagcloud|tags|search)"
    r"(?:[_-]+(?:ads?|links?|list|items?|box|bar|area|block|container|wrapper?|inner|section|panel|buttons?|icons?|form|banner|notice|message|popup|modal|menu|nav|widgets?|thread|posts?|articles?|stories|unit|slot|top|bottom|left|right|primary|secondary|main|site|footer|header|\d+))*(?=$|\s)",
    re.I,
)
#: A header that isn't an article's own.
HEADER = re.compile(r"(?:^|\s)(?!(?:article|entry|post|story|content)[_-])(?:[\w-]*[_-])?header(?:$|\s)", re.I)
#: A class or id of the article's own element, on pages without article or main.
BODY = re.compile(r"(?:^|\s)(?:article|post|entry|story|main|content)(?:[_-]?(?:body|content|text|article|main))?(?:$|\s)", re.I)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar"}


def kind_of(name: str, attributes: str, inside: bool) -> int | None:
    """BOILERPLATE or CONTENT where an element's name or attributes say so."""
    if name in NEVER or name == "header" and not inside:
        return BOILERPLATE
    if attributes and name not in ("html", "body"):
        for a, *values in ATTRIBUTE.findall(attributes):
            value, a = next((v for v in values if v), ""), a.lower()
            if a == "hidden" or a == "aria-hidden" and value == "true" or a == "role" and value.lower() in ROLES:
                return BOILERPLATE
            if a == "role" and value.lower() == "main":
                return CONTENT
            if a in ("class", "id") and name not in LANDMARKS:
                if BODY.search(value) and name in ("div", "section"):
                    return CONTENT
                if HINT.search(value) or not inside and HEADER.search(value):
                    return BOILERPLATE
    return CONTENT if name in LANDMARKS else None


class Path:
    """Open block elements: each one's name, slot and numbers of children by name."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int, dict[str, int]]] = [("", 0, {})]
        self.names: dict[str, int] = {}

    @property
    def slot(self) -> int:
        return self.open[-1][1]

    def enter(self, name: str) -> None:
        if name in CLOSES_ITSELF and self.open[-1][0] == name:
            self.leave(name)
        _, under, children = self.open[-1]
        place = children[name] = children.get(name, 0) + 1 if name in PLACED else 0
        self.open.append((name, xxhash.xxh64_intdigest(f"{under} {name} {place}") >> 1, {}))
        self.names[name] = self.names.get(name, 0) + 1

    def leave(self, name: str) -> None:
        while self.names.get(name):
            last = self.open.pop()[0]
            self.names[last] -= 1
            if last == name:
                break


def blocks_of(page: str) -> list[tuple[str, int, int]]:
    """(text, zone, slot) of a page's blocks in order: references decoded, white space made one space, empty blocks left out."""
    out, parts, path = [], [], Path()
    stack: list[tuple[str, int]] = []  # elements that decide a zone, and nested elements of the same names
    at, landmark = 0, False

    now = OPEN

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, now, path.slot))
            parts = []

    position, search = 0, MARKUP.search
    while found := search(page, position):
        if found.start() > at:
            parts.append(page[at : found.start()])
        position = at = found.end()
        name = found[2]
        if name is None:
            continue
        name, closing, attributes = name.lower(), found[1], found[3]
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(page, position)
                position = end.start() if end else len(page)
                close = page.find(">", position)
                position = at = close + 1 if end and close >= 0 else len(page)
            continue
        if name in BLOCKS:
            flush()
        if name in VOID:
            continue
        if name in BLOCKS and closing:
            path.leave(name)
        elif name in BLOCKS:
            path.enter(name)
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            if name in CLOSES_ITSELF and stack and stack[-1][0] == name:
                stack.pop()
            inside = any(z == CONTENT for _, z in stack)
            kind = kind_of(name, attributes, inside)
            if kind is not None or any(n == name for n, _ in stack):
                if kind == CONTENT:
                    landmark = True
                under = stack[-1][1] if stack else OPEN
                stack.append((name, BOILERPLATE if under == BOILERPLATE or kind == BOILERPLATE else CONTENT if CONTENT in (kind, under) else OPEN))
        new = stack[-1][1] if stack else OPEN
        if new != now:
            flush()
            now = new
    if at < len(page):
        parts.append(page[at:])
    flush()
    return [(t, BOILERPLATE if z == OPEN and landmark else z, s) for t, z, s in out]


def suffix_array(streams: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of all streams, sorted by their first `least` tokens (prefix doubling), equal ones in order of place.

    Streams' numbers start at 0; each ends in a separator of its own. Gives the suffixes' starts in the concatenated
    streams, where runs that agree begin, the runs' lengths, and the stream of each place.
    """
    lengths = [len(s) for s in streams]
    page = np.repeat(np.arange(len(streams)), [n + 1 for n in lengths])
    total = len(page)
    base = max((int(s.max()) + 1 for s in streams if len(s)), default=0)
    text = np.concatenate([np.append(s, base + k) for k, s in enumerate(streams)]) if streams else np.zeros(0, np.int64)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < least:
        step = min(depth, least - depth)  # windows of depth + step tokens, from two that overlap
        after = np.concatenate((rank[step:], np.full(min(step, total), -1, np.int64)))[:total]
        rank = np.unique(rank * (total + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        depth += step
    order = np.argsort(rank, kind="stable")
    ranks = rank[order]
    first = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1]))) if total else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, total)) if total else first, page


def covered_by(starts: np.ndarray, least: int, total: int) -> np.ndarray:
    """Which of `total` places lie in a window of `least` from one of `starts`."""
    edge = np.zeros(total + least + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + least, -1)
    return np.cumsum(edge)[:total] > 0


def repeated(streams: list[np.ndarray], least: int) -> list[np.ndarray]:
    """Which tokens of each stream lie in a substring of `least` tokens or more that another stream has too."""
    order, first, runs, page = suffix_array(streams, least)
    total, pages = len(page), page[order]
    shared = np.minimum.reduceat(pages, first) != np.maximum.reduceat(pages, first) if total else np.zeros(0, bool)
    covered = covered_by(order[np.repeat(shared, runs)] if total else order, least, total)
    ends = np.cumsum([len(s) + 1 for s in streams]) if streams else []
    return [covered[e - len(s) - 1 : e - 1] for e, s in zip(ends, streams)]


def counted(streams: list[np.ndarray], wanted: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `least` tokens that hold a wanted one: a start in the concatenated streams of each, and how many streams have it."""
    order, first, runs, page = suffix_array(streams, least)
    if not len(page):
        return order, order
    sums = np.concatenate(([0], np.cumsum(np.concatenate([np.append(w, False) for w in wanted]))))
    stops = np.minimum(np.arange(len(page)) + least, len(page))
    whole = page[stops - 1] == page  # a window that ends in a separator is no window
    separators = np.cumsum([len(s) + 1 for s in streams]) - 1
    whole[separators] = False
    whole &= ~np.isin(stops - 1, separators)
    holds = (whole & (sums[stops] > sums[:-1]))[order]
    run, at = np.repeat(np.arange(len(first)), runs)[holds], order[holds]
    if not len(at):
        return at, at
    new = np.concatenate(([True], run[1:] != run[:-1]))  # places ascend in a run, and pages with them
    other = new | np.concatenate(([True], page[at[1:]] != page[at[:-1]]))
    return at[new], np.add.reduceat(other.astype(np.int64), np.flatnonzero(new))


def token_hashes(blocks: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the tokens of blocks."""
    tokens = [t for b in blocks for t in b.split(" ")]
    return np.array([known.get(t) or known.setdefault(t, xxhash.xxh64_intdigest(t)) for t in tokens], np.uint64)


def sizes_of(texts: list[str]) -> np.ndarray:
    """Tokens of each block."""
    return np.array([t.count(" ") + 1 for t in texts], np.int64)


def with_slots(tokens: np.ndarray, sizes: np.ndarray, slots: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A page's stream, where each block begins with its slot; and the places of the tokens in it."""
    return np.insert(tokens, np.cumsum(sizes) - sizes, np.array(slots, np.uint64)), np.arange(len(tokens)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)


def slot_cover(sizes: np.ndarray, zones: list[int], slots: list[int], covered: np.ndarray) -> dict[int, bool]:
    """Which of a page's open slots are covered: 80 % of the slot's tokens."""
    found: dict[int, list[int]] = {}
    ends = np.concatenate(([0], np.cumsum(covered)))[np.cumsum(sizes)] if len(sizes) else []
    before = 0
    for n, z, s, end in zip(sizes.tolist(), zones, slots, ends):
        if z == OPEN:
            held = found.setdefault(s, [0, 0])
            held[0] += n
            held[1] += int(end - before)
        before = end
    return {s: 5 * c >= 4 * n for s, (n, c) in found.items()}


def assemble(texts: list[str], zones: list[int], slots: list[int], covered: np.ndarray, template: set[int], copy_share: float) -> str:
    """The text of a page's content and of what its open blocks hold beside boilerplate."""
    sizes, out, at = sizes_of(texts), [], 0
    left = np.array([z == OPEN and s not in template for z, s in zip(zones, slots)], bool)
    if CONTENT not in zones and not left.any():
        left = np.array(zones, np.int64) == OPEN
    tokens = np.repeat(left, sizes) if len(texts) else np.zeros(0, bool)
    whole = not tokens.any() or covered[tokens].mean() >= copy_share
    for text, z, keep, n in zip(texts, zones, left, sizes):
        if z == CONTENT or keep and whole:
            out.append(text)
        elif keep:
            gone = covered[at : at + n]
            out.extend([text] if not gone.any() else [t for t, g in zip(text.split(" "), gone) if not g])
        at += n
    return " ".join(out)


def content_windows(blocks: list[tuple[str, int, int]], known: dict[str, int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A page's stream, the places of its tokens, and the hashes and starts of the windows that hold a token of content."""
    texts, sizes = [t for t, _, _ in blocks], sizes_of([t for t, _, _ in blocks])
    stream, at = with_slots(token_hashes(texts, known), sizes, [s for _, _, s in blocks])
    wanted = np.zeros(len(stream), bool)
    wanted[at] = np.repeat(np.array([z == CONTENT for _, z, _ in blocks], bool), sizes)
    if len(stream) < least:
        return stream, at, np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.concatenate(([0], np.cumsum(wanted)))
    starts = np.flatnonzero(sums[least:] > sums[:-least])
    with quiet():
        return stream, at, shingle_hashes(mix(stream), least)[starts].view(np.int64), starts


def without_notices(blocks: list[tuple[str, int, int]], notices: list[int] | None, known: dict[str, int], least: int, copy_share: float) -> list[tuple[str, int, int]]:
    """Blocks of content that the host's notices cover made boilerplate, unless the page is a copy."""
    if not notices or not blocks:
        return blocks
    stream, at, hashes, starts = content_windows(blocks, known, least)
    hit = starts[np.isin(hashes, np.array(notices, np.int64))]
    if not len(hit):
        return blocks
    sizes, content = sizes_of([t for t, _, _ in blocks]), np.array([z == CONTENT for _, z, _ in blocks], bool)
    held = np.add.reduceat(covered_by(hit, least, len(stream))[at].astype(np.int64), np.cumsum(sizes) - sizes)
    gone = content & (5 * held >= 4 * sizes)
    if sizes[gone].sum() >= copy_share * sizes[content].sum():
        return blocks
    return [(t, BOILERPLATE if g else z, s) for (t, z, s), g in zip(blocks, gone)]


PARSED = "page_id long, url string, host string, part long, texts array<string>, zones array<tinyint>, slots array<long>"
LABELLED = "page_id long, url string, host string, texts array<string>, zones array<tinyint>, slots array<long>, covered binary"
RESULT = "page_id long, url string, text string, n_chars long"


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


#: Pages of a host's group on the average, at least.
GROUP_PAGES = 20
NAMED = "host string, opened boolean, pages long, h array<long>, n array<long>"


def repeats_of_group(batches: Iterator[pa.RecordBatch], least: int, share: float) -> pa.RecordBatch:
    """Of a group's pages: whether one has an open block, how many have content, and the windows of content that `share` of those have."""
    known: dict[str, int] = {}
    seen: set[int] = set()
    streams, wanted, opened, pages, host = [], [], False, 0, None
    for host, page, html in (row for b in batches_of(batches) for row in zip(*(b.column(c).to_pylist() for c in ("host", "page", "html")))):
        if page in seen:
            continue
        seen.add(page)
        blocks = blocks_of(html or "")
        texts, sizes = [t for t, _, _ in blocks], sizes_of([t for t, _, _ in blocks])
        zones = np.array([z for _, z, _ in blocks], np.int64)
        stream, at = with_slots(token_hashes(texts, known), sizes, [s for _, _, s in blocks])
        marks = np.zeros(len(stream), bool)
        marks[at] = np.repeat(zones == CONTENT, sizes)
        streams.append(stream)
        wanted.append(marks)
        opened |= bool((zones == OPEN).any())
        pages += bool((zones == CONTENT).any())
    numbers = np.unique(np.concatenate(streams)) if streams else np.zeros(0, np.uint64)
    starts, n = counted([np.searchsorted(numbers, x).astype(np.int64) for x in streams], wanted, least)
    often = n >= share * pages - 1e-6
    starts, n = starts[often], n[often]
    with quiet():
        every = mix(np.concatenate([np.append(x, np.uint64(0)) for x in streams])) if streams else numbers
        hashes = every[starts]
        for k in range(1, least if len(starts) else 1):
            hashes = chain(hashes, every[starts + k])
    values = [pa.array([host], pa.string()), pa.array([opened]), pa.array([pages], pa.int64()), pa.array([hashes.view(np.int64)], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(values, names=names_of(NAMED))


def with_hosts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows with their hosts' columns. Few hosts are broadcast; many, or long ones, are joined by sixteenths, so no host's pages meet in one place."""
    wide = F.sum(F.greatest(F.size("notices"), F.lit(0))) if "notices" in hosts.columns else F.lit(0)
    n, windows = hosts.agg(F.count("*"), wide).first()
    if n <= 100_000 and (windows or 0) <= 2_000_000:
        return rows.join(F.broadcast(hosts), "host", "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(16)))
    return rows.join(hosts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")))), ["host", "salt"], "left").drop("salt")


def repeats_of_hosts(rows: DataFrame, scratch: Scratch, *, least: int, group_chars: int, share: float, fewest: int) -> DataFrame:
    """host, groups (null where no page has an open block) and notices: windows that hold content on `share` of its pages with content, `fewest` at least."""
    some = rows.filter("html <> ''").withColumn("page", F.xxhash64("html"))
    # Groups are of different pages: copies don't count, and a group has GROUP_PAGES pages on the average, so what half of them have is no more than a few pages' worth.
    once = rows.groupBy("host", F.xxhash64("html").alias("page")).agg(F.max(F.length("html")).alias("size"), F.sum(F.length("html")).alias("all")).groupBy("host").agg(F.sum("size").alias("chars"), F.sum("all").alias("all"), F.count("*").alias("different"))
    groups = F.least(F.ceil(F.coalesce("chars", F.lit(0)) / group_chars), F.floor(F.col("different") / GROUP_PAGES))
    # Pages with open blocks are dealt to groups with their copies.
    sizes = once.select("host", F.greatest(groups, F.lit(1)).cast("long").alias("groups"), F.greatest(F.ceil(F.col("all") / group_chars), F.lit(1)).cast("long").alias("with_copies")).persist()
    total = int(sizes.agg(F.sum("groups")).first()[0] or 0)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, total // 4, 1)

    def first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A page that a task meets again stays where it lies: a group gets a page once from each task at most."""
        met: set[tuple[str, int]] = set()
        for b in batches_of(batches):
            new = []
            for key in zip(b.column("host").to_pylist(), b.column("page").to_pylist()):
                new.append(key not in met)
                met.add(key)
            yield b.filter(pa.array(new))

    firsts = some.select("host", "page", "html", "page_id", "url").mapInArrow(first_copies, "host string, page long, html string, page_id long, url string")
    dealt = with_hosts(firsts, sizes.select("host", "groups")).withColumn("part", F.pmod("page", "groups")).select("host", "part", "page", "html").repartition(parts, "host", "part")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield repeats_of_group(batches, least, share)

    named = dealt.groupBy("host", "part").applyInArrow(name, NAMED).persist()
    hosts = named.groupBy("host").agg(F.max("opened").alias("opened"), F.sum("pages").alias("pages"))
    windows = named.select("host", F.explode(F.arrays_zip("h", "n")).alias("w")).select("host", "w.h", "w.n").join(sizes.select("host", "groups"), "host")
    asked = windows.filter("groups > 1").groupBy("host").agg(F.collect_set("h").alias("notices")).persist()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            known: dict[str, int] = {}
            for host, page, html, notices in zip(*(b.column(c).to_pylist() for c in ("host", "page", "html", "notices"))):
                hashes = content_windows(blocks_of(html or ""), known, least)[2]
                h = np.unique(hashes[np.isin(hashes, np.array(notices, np.int64))])
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(h), pa.string()), pa.array(h, pa.int64()), pa.array([page] * len(h), pa.int64())], names=["host", "h", "page"])

    # What a host's groups named is counted over all its pages.
    again = with_hosts(some, asked).filter("notices is not null").select("host", "page", "html", "notices")
    whole = again.mapInArrow(ask, "host string, h long, page long").groupBy("host", "h").agg(F.count_distinct("page").alias("n"))
    counts = windows.filter("groups = 1").select("host", "h", "n").union(whole.select("host", "h", "n")).join(hosts, "host")
    notices = counts.filter((F.col("n") >= share * F.col("pages")) & (F.col("n") >= fewest)).groupBy("host").agg(F.collect_set("h").alias("notices"))
    found = hosts.join(sizes.select("host", "with_copies"), "host").join(notices, "host", "left")
    out = scratch.table(found.select("host", F.when(F.col("opened"), F.col("with_copies")).alias("groups"), "notices"), "hosts")
    for table in (asked, named, sizes):
        table.unpersist()
    return out


def grouped_pages(pages: DataFrame, scratch: Scratch, *, least: int, group_chars: int, share: float, fewest: int) -> DataFrame:
    """Every page with its host, its group (null where no page of the host has an open block, 0 where it is one group), its html and the host's notices."""
    small_batches(pages.sparkSession, 256)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    rows = with_hosts(rows, repeats_of_hosts(rows, scratch, least=least, group_chars=group_chars, share=share, fewest=fewest))
    part = F.when(F.col("groups") > 1, F.pmod(F.xxhash64("page_id", "url", "html"), F.col("groups")) + 1).when(F.col("groups") == 1, F.lit(0))
    return rows.select("page_id", "url", "host", part.cast("long").alias("part"), "html", "notices")


def cut(batch: pa.RecordBatch, least: int, copy_share: float) -> list[list[tuple[str, int, int]]]:
    """The blocks of a batch's pages, notices made boilerplate."""
    known: dict[str, int] = {}
    return [without_notices(blocks_of(h or ""), n, known, least, copy_share) for h, n in zip(batch.column("html").to_pylist(), batch.column("notices").to_pylist())]


def result(page_ids: pa.Array, urls: pa.Array, texts: list[str]) -> list[pa.Array]:
    return [page_ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]


def label_group(table: pa.Table, least: int) -> pa.Table:
    """Covered tokens of a group's pages."""
    known: dict[str, int] = {}
    texts, slots = (table.column(c).to_pylist() for c in ("texts", "slots"))
    hashes = [token_hashes(t, known) for t in texts]
    # Pages of equal tokens count as one, with the least of their slots.
    place: dict[bytes, list[int]] = {}
    for k, h in enumerate(hashes):
        place.setdefault(h.tobytes(), []).append(k)
    streams, tokens_at = [], []
    for same in place.values():
        k = min(same, key=lambda i: slots[i])
        stream, at = with_slots(hashes[k], sizes_of(texts[k]), slots[k])
        streams.append(stream)
        tokens_at.append(at)
    numbers = np.unique(np.concatenate(streams)) if streams else np.zeros(0, np.uint64)
    marks = repeated([np.searchsorted(numbers, s).astype(np.int64) for s in streams], least)
    covered: list[bytes] = [b""] * len(texts)
    for same, m, at in zip(place.values(), marks, tokens_at):
        for k in same:
            covered[k] = m[at].astype(np.uint8).tobytes()
    return table.drop_columns(["part"]).append_column("covered", pa.array(covered, pa.binary())).select(names_of(LABELLED))


def page_windows(texts: list[str], zones: list[int], slots: list[int], covered: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of a page's stream, and the starts of those that hold an open token that its group has not covered."""
    sizes = sizes_of(texts)
    stream, at = with_slots(token_hashes(texts, {}), sizes, slots)
    if len(stream) < least:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    wanted = np.zeros(len(stream), bool)
    wanted[at] = np.repeat(np.array(zones, np.int64) == OPEN, sizes) & ~covered
    sums = np.concatenate(([0], np.cumsum(wanted)))
    with quiet():
        return shingle_hashes(mix(stream), least), np.flatnonzero(sums[least:] > sums[:-least])


def all_marks(texts: list[str], covered: bytes, more: list[int] | None, least: int) -> np.ndarray:
    """Covered tokens of a page: those of its group, and those of windows that the whole host repeats."""
    marks, sizes = np.frombuffer(covered, np.uint8) > 0, sizes_of(texts)
    if more:
        edge = np.zeros(len(marks) + len(sizes) + least + 1, np.int64)
        np.add.at(edge, more, 1)
        np.add.at(edge, np.array(more) + least, -1)
        marks = marks | (np.cumsum(edge) > 0)[np.arange(len(marks)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)]
    return marks


def main_text(pages: DataFrame, *, least_tokens: int = 8, group_chars: int = 2_000_000, slot_share: float = 0.3, copy_share: float = 0.5, notice_share: float = 0.5, notice_pages: int = 5) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of every page."""
    scratch = Scratch(pages.sparkSession, "html")
    dealt = grouped_pages(pages, scratch, least=least_tokens, group_chars=group_chars, share=notice_share, fewest=notice_pages)

    def of_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            texts = [" ".join(t for t, z, _ in blocks if z == CONTENT) for blocks in cut(b, least_tokens, copy_share)]
            yield pa.RecordBatch.from_arrays(result(b.column("page_id"), b.column("url"), texts), names=names_of(RESULT))

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            found = cut(b, least_tokens, copy_share)
            lists = [pa.array([[x[k] for x in f] for f in found], pa.list_(t)) for k, t in enumerate((pa.string(), pa.int8(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *lists], names=names_of(PARSED))

    def one_group(table: pa.Table) -> pa.Table:
        t = label_group(table, least_tokens)
        rows = [(x, z, s, np.frombuffer(c, np.uint8) > 0) for x, z, s, c in zip(*(t.column(c).to_pylist() for c in ("texts", "zones", "slots", "covered")))]
        having: dict[int, list[int]] = {}
        for texts, zones, slots, covered in rows:
            for slot, full in slot_cover(sizes_of(texts), zones, slots, covered).items():
                held = having.setdefault(slot, [0, 0])
                held[0] += 1
                held[1] += full
        template = {s for s, (n, c) in having.items() if c >= slot_share * n}
        return pa.Table.from_arrays(result(t.column("page_id"), t.column("url"), [assemble(*r, template, copy_share) for r in rows]), names=names_of(RESULT))

    # Pages of hosts without an open block: the content that the array leaves.
    closed = dealt.filter("part is null").mapInArrow(of_content, RESULT)
    alone = dealt.filter("part = 0").mapInArrow(of_blocks, PARSED).groupBy("host").applyInArrow(one_group, RESULT)
    grouped = dealt.filter("part > 0").mapInArrow(of_blocks, PARSED).groupBy("host", "part").applyInArrow(lambda table: label_group(table, least_tokens), LABELLED)
    labelled = scratch.table(grouped.withColumn("uid", F.monotonically_increasing_id()), "labelled")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            for host, texts, zones, slots, covered in zip(*(c.to_pylist() for c in b.columns)):
                h = np.unique(page_windows(texts, zones, slots, np.frombuffer(covered, np.uint8) > 0, least_tokens)[0])
                if len(h):
                    page = xxhash.xxh64_intdigest(" ".join(texts)) >> 1  # pages of equal tokens are one
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array([page] * len(h), pa.int64())], names=["host", "h", "page"])

    def undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            for host, texts, zones, slots, covered, uid in zip(*(c.to_pylist() for c in b.columns)):
                h, starts = page_windows(texts, zones, slots, np.frombuffer(covered, np.uint8) > 0, least_tokens)
                if len(starts):
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(starts), pa.string()), pa.array(h[starts].view(np.int64)), pa.array([uid] * len(starts), pa.int64()), pa.array(starts)], names=["host", "h", "uid", "at"])

    # Hosts in several groups: windows with open tokens that a group found unique, compared with all windows of the host, covered ones and those of other blocks too.
    left = labelled.select("host", "texts", "zones", "slots", "covered", "uid").filter("exists(zones, z -> z = 2)").mapInArrow(undecided, "host string, h long, uid long, at long")
    shared = labelled.select("host", "texts", "zones", "slots", "covered").mapInArrow(windows, "host string, h long, page long").groupBy("host", "h").agg(F.min("page").alias("a"), F.max("page").alias("b")).filter("a <> b").select("host", "h")
    more = scratch.table(left.join(shared, ["host", "h"], "left_semi").groupBy("uid").agg(F.collect_list("at").alias("more")), "more")
    marked = labelled.join(more, "uid", "left").select("uid", "host", "page_id", "url", "texts", "zones", "slots", "covered", "more")

    def count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            for uid, host, texts, zones, slots, covered, extra in zip(*(c.to_pylist() for c in b.columns)):
                found = slot_cover(sizes_of(texts), zones, slots, all_marks(texts, covered, extra, least_tokens))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([uid] * len(found), pa.int64()), pa.array([host] * len(found), pa.string()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.bool_())], names=["uid", "host", "slot", "full"])

    # A host's slots are counted, and come back to its pages by sixteenths.
    of_pages = scratch.table(marked.select("uid", "host", "texts", "zones", "slots", "covered", "more").mapInArrow(count_slots, "uid long, host string, slot long, full boolean"), "slots")
    templates = of_pages.groupBy("host", "slot").agg(F.count("*").alias("n"), F.sum(F.col("full").cast("long")).alias("c")).filter(F.col("c") >= slot_share * F.col("n"))
    templates = templates.select("host", "slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("salt"))
    held = of_pages.withColumn("salt", F.pmod("uid", F.lit(16))).join(templates, ["host", "slot", "salt"], "left_semi").groupBy("uid").agg(F.collect_list("slot").alias("template"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            rows = zip(*(b.column(c).to_pylist() for c in ("texts", "zones", "slots", "covered", "more", "template")))
            texts = [assemble(t, z, s, all_marks(t, c, m, least_tokens), set(own or ()), copy_share) for t, z, s, c, m, own in rows]
            yield pa.RecordBatch.from_arrays(result(b.column("page_id"), b.column("url"), texts), names=names_of(RESULT))

    return closed.union(alone).union(marked.join(held, "uid", "left").mapInArrow(finish, RESULT))
