"""Operator 1: main text of web pages, with a suffix array per host for boilerplate.

A page is cut into blocks at its block-level tags.  A block is dropped by its
structure (menus, page headers, footers, sidebars, notices, adverts, forms,
scripts, reader comments), or belongs to the page's article, or neither.  A
wrapper is no chrome, whatever its marks: an element with a main element inside,
a form or an element marked by its class or id with the page's longest articles
inside, and a form or an element marked by a layout word (``LAYOUT_WORDS``) with
most of the page's text outside links and without an article beside it.  A main
element (or role) with text leaves only its own blocks in question.  The blocks
of an article there are the main text as they are if they hold at least half of
the text outside links.  Other pages show their chrome, in the main element too,
only by repetition, which a suffix array of their host finds.  Of such a page, a
block wholly under runs that another page of the host has is boilerplate, and so
are ``LONG_WORDS`` repeated words in a row inside a block that stays; what is
kept are the unique runs.  A page that is covered through and through is a copy
of other pages, not chrome, and keeps all.

The suffix array.  The word streams of all pages, with articles and chrome, are
concatenated per host (a stream ends at its page's end) and their suffixes are
sorted; a suffix whose longest common prefix with a suffix of another page has
``MIN_WORDS`` words or more covers these words.  Sorting each suffix with its
words would ship many times the input, so only those go into the sort on which
the rest depends (a sparse suffix array):

1. A suffix takes part if another page of the host has its first ``MIN_WORDS``
   words.  Chunks of about ``CHUNK_WORDS`` words exchange the hashes of their
   windows, delta-coded: first of the window's anchor (its ``ANCHOR_WORDS`` words
   with the least hash, which equal windows share), then, where the anchor is
   shared, of the whole window in 64 bits.
2. Of these, a suffix whose window follows the same word wherever it occurs has
   the common prefix of the suffix before it less one word (Kasai's rule); the
   second exchange tells these apart by a hash of the word before (31 bits).
3. The others are range-partitioned at sampled splitters by host, words and place
   (a passage that all pages have spreads over many buckets), sorted as words,
   and compared with their neighbours, also across boundaries, past rows of the
   same page: the nearest suffixes of another page have the longest common prefix.
   Suffixes are compared up to ``DEPTH`` words; a match of that length goes on to
   the next sorted suffix or to where the shared windows end, whichever is first.

A page counts once, however often it repeats itself.  Pages are parsed once,
into a table bucketed by chunk, so that no later pass moves texts.

Defined cases: null or empty html gives an empty text; a null url is a host of
its own; repeated rows are one page to the suffix array and get one result each;
unclosed and stray tags follow the browsers' rule of thumb (an end tag closes up
to its start tag, a block start closes an open paragraph); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html as html_lib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revguard.llm.common import new_folder, pick, shuffle_width, written

MIN_WORDS = 6
LONG_WORDS = 12  # a covered run of so many words is cut out of a block that stays
DEPTH = 24  # words by which suffixes are compared
ANCHOR_WORDS = 4
CHUNK_WORDS = 1 << 20  # of the pages that a task takes at once
ROW_PAGES = 64
BUCKET_WORDS = 1 << 23  # words of the input for each bucket of keys or suffixes
SAMPLE_ROWS = 1_000_000  # of the suffixes, if every word began one
NO_WORD, MIXED = 0xFFFFFFFE, 0xFFFFFFFF  # in place of a hash of the word before a window
DROPPED, ARTICLE, OTHER, MAIN = 0, 1, 2, 4  # MAIN is added to a zone

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)"
                   r"((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MAIN_ROLE = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
pre search section select summary table tbody td tfoot th thead tr ul""".split())
CHROME = frozenset("nav footer aside form menu button select dialog head label fieldset input".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
# Words in a class or id that mark chrome.
CHROME_WORDS = frozenset("""ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner
sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice
alert popup modal overlay newsletter subscribe signup social share sharing related recommended comment comments respond
disqus pagination pager toolbar login""".split())
TITLE_WORDS = frozenset(["header", "banner"])  # not chrome inside an article
# Of these, words that also describe a page's layout, and words that mark what readers write.
LAYOUT_WORDS = frozenset("sidebar widget menu nav navbar navigation footer header masthead banner toolbar".split())
READER_WORDS = frozenset("comment comments respond disqus".split())
NONE, LAYOUT, MARKED, CHROME_ELEMENT, HIDDEN = range(5)
SPLIT = re.compile(r"[^a-z0-9]+")


def _chrome_kind(tag: str, attributes: str, in_article: bool) -> int:
    kind = LAYOUT if tag == "form" else CHROME_ELEMENT if tag in CHROME or (tag == "header" and not in_article) else NONE
    if not attributes.strip():
        return kind
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return HIDDEN
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return HIDDEN
    if found.get("role", "").lower() in CHROME_ROLES:
        return CHROME_ELEMENT
    if tag in ("html", "body"):
        return kind
    marks = {w for key in ("class", "id") for w in SPLIT.split(found.get(key, "").lower())} & CHROME_WORDS
    if in_article:
        marks -= TITLE_WORDS
    if marks & READER_WORDS:
        return max(kind, CHROME_ELEMENT)
    return max(kind, MARKED if marks - LAYOUT_WORDS else LAYOUT if marks else NONE)


def _zones(found: list[tuple[int, int, str]], nodes: list[tuple[int, int, bool, bool]]) -> list[int]:
    """The zone of each block (element, characters outside links, text), MAIN added below a main element.

    ``nodes`` are the elements that decide, parents first: parent, kind of chrome, article, main.  Node 0 is the page.
    """
    kind = [k for _, k, _, _ in nodes]

    def inherited(value) -> list:
        out = []
        for i, (parent, *_) in enumerate(nodes):
            out.append(value(i) if not i else max(value(i), out[parent]))
        return out

    hidden = inherited(lambda i: kind[i] == HIDDEN)
    for i, (parent, _, _, main) in enumerate(nodes):
        if main and not hidden[i]:
            kind[i] = NONE if kind[i] <= MARKED else kind[i]
            while parent and kind[parent] < HIDDEN and not nodes[parent][3]:
                kind[parent] = NONE
                parent = nodes[parent][0]
    article = inherited(lambda i: nodes[i][2])
    if any(LAYOUT <= k <= MARKED for k in kind):
        shut = inherited(lambda i: kind[i] >= CHROME_ELEMENT)
        inside, in_articles = [0] * len(nodes), [0] * len(nodes)
        for at, size, _ in found:
            if not shut[at]:
                inside[at] += size
                in_articles[at] += size * article[at]
        for i in range(len(nodes) - 1, 0, -1):
            inside[nodes[i][0]] += inside[i]
            in_articles[nodes[i][0]] += in_articles[i]
        free = None
        for i in range(1, len(nodes)):
            if not LAYOUT <= kind[i] <= MARKED or shut[i]:
                continue
            if free is None:
                dropped = inherited(lambda j: kind[j] > NONE)
                free = sum(size for at, size, _ in found if not dropped[at])
            longest = 2 * in_articles[i] >= in_articles[0] and in_articles[i] > free
            alone = in_articles[i] == in_articles[0] or article[i]
            if longest or kind[i] == LAYOUT and alone and 2 * inside[i] > inside[0]:
                kind[i], free = NONE, None
    dropped, main = inherited(lambda i: kind[i] > NONE), inherited(lambda i: nodes[i][3])
    return [DROPPED if dropped[at] else (ARTICLE if article[at] else OTHER) + (MAIN if main[at] else 0)
            for at, _, _ in found]


def blocks(page: str | None) -> tuple[list[tuple[int, str]], bool]:
    """(zone, text) of every block with text, in page order, and whether an article decides.

    Blocks outside a main element that has text are dropped.
    """
    page = page or ""
    found: list[tuple[int, int, str]] = []
    nodes = [(0, NONE, False, False)]
    stack: list[tuple[str, int, bool]] = []  # name, the deciding element around it, whether it is a link
    part: list[str] = []
    node = links = linked = at = 0
    inside = [False]  # by node: in an article or a main element

    def flush():
        nonlocal linked
        if part:
            own = sum(map(len, part)) - linked
            linked = 0
            text = " ".join(html_lib.unescape("".join(part)).split())
            part.clear()
            if text:
                found.append((node, own, text))

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            part.append(page[at:])
            break
        if m.start() > at:
            part.append(page[at: m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        if m[2] is None:
            continue
        tag, closing, attributes = m[2].lower(), m[1], m[3]
        if tag == "br":
            part.append(" ")
        if tag in RAW and not closing:
            flush()
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if closing:
            if any(name == tag for name, *_ in stack):
                while True:
                    name, around, link = stack.pop()
                    if around != node:
                        flush()
                    node = around
                    links -= link
                    if name == tag:
                        break
            continue
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK and stack and stack[-1][0] == "p" or tag in ("li", "td", "tr", "option", "dd", "dt") and \
                stack and stack[-1][0] == tag:
            _, node, link = stack.pop()
            links -= link
        kind = _chrome_kind(tag, attributes, inside[node])
        article, main = tag == "article", tag == "main" or bool(MAIN_ROLE.search(attributes))
        link = tag == "a" and "href" in attributes.lower()
        stack.append((tag, node, link))
        links += link
        if kind or article or main:
            flush()
            nodes.append((node, kind, article, main))
            inside.append(inside[node] or article or main)
            node = len(nodes) - 1
    flush()
    zones = _zones(found, nodes)
    if any(zone >= MAIN for zone in zones):
        zones = [zone - MAIN if zone >= MAIN else DROPPED for zone in zones]
    size = {z: sum(own for zone, (_, own, _) in zip(zones, found) if zone == z) for z in (ARTICLE, OTHER)}
    has_article = ARTICLE in zones and size[ARTICLE] >= size[OTHER]
    if not has_article:
        zones = [OTHER if zone == ARTICLE else zone for zone in zones]
    return [(zone, text) for zone, (_, _, text) in zip(zones, found)], has_article


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(words: list[str]) -> np.ndarray:
    import xxhash
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1))


# --- pages, parsed once --------------------------------------------------------------------------

PAGE = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.string())
PAGE_SCHEMA = pa.schema(list(zip(("page_id", "url", "copies", "host", "has_article", "zones", "n", "text"), PAGE)))


def _packed(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _unpacked(z: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(z)).read_all()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (page_id, url, copies, host, html) -> rows of up to ROW_PAGES parsed pages; rows of a chunk follow each other."""
    import xxhash
    from pyspark import TaskContext
    chunk, first, in_chunk = TaskContext.get().partitionId() << 32, 0, 0
    own: list[list] = [[] for _ in PAGE]
    size = 0

    def row() -> pa.RecordBatch:
        z = _packed(pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(own, PAGE)], schema=PAGE_SCHEMA))
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([first], pa.int32()),
                                           pa.array([size], pa.int64()), pa.array([z], pa.binary())],
                                          names=["chunk", "first", "n_words", "z"])

    for batch in batches:
        for page_id, url, copies, host, html in zip(*(c.to_pylist() for c in batch.columns)):
            found, has_article = blocks(html)
            text = "\n".join(t for _, t in found)
            n = text.count(" ") + text.count("\n") + 1 if text else 0
            for col, x in zip(own, (page_id, url, copies, np.uint64(xxhash.xxh3_64_intdigest(host)).view(np.int64).item(),
                                    has_article, "".join(str(zone) for zone, _ in found), n, text)):
                col.append(x)
            size += n
            if len(own[0]) == ROW_PAGES or size >= CHUNK_WORDS // 16:
                yield row()
                first, in_chunk = first + len(own[0]), in_chunk + size
                own, size = [[] for _ in PAGE], 0
                if in_chunk >= CHUNK_WORDS:
                    chunk, first, in_chunk = chunk + 1, 0, 0
    if own[0]:
        yield row()


def _chunk_table(keyed: DataFrame) -> DataFrame:
    """The parsed pages as a table bucketed by chunk: passes over its chunks move what they are joined with, never texts."""
    spark = keyed.sparkSession
    folder = new_folder(spark, "pages")
    name = "pages_" + uuid.uuid4().hex
    rows = keyed.select("page_id", "url", "copies", "host", "html").mapInArrow(
        _parsed, "chunk long, first int, n_words long, z binary")
    (rows.write.format("parquet").option("compression", "none").option("path", folder)
     .bucketBy(shuffle_width(spark), "chunk").saveAsTable(name))
    return spark.table(name)


def _pages(chunk: pa.Table) -> pa.Table:
    """The pages of a chunk, in their order."""
    rows = sorted(zip(chunk.column("first").to_pylist(), chunk.column("z").to_pylist()))
    return pa.concat_tables([_unpacked(z) for _, z in rows])


class Streams:
    """The word streams of a chunk's pages, one behind the other: word hashes, hosts and page numbers by word."""

    def __init__(self, pages: pa.Table):
        n = pages.column("n").to_numpy()
        words = " ".join(t for t in pages.column("text").to_pylist() if t).replace("\n", " ")
        self.words = words.split(" ") if words else []
        self.page = np.repeat(np.arange(len(n)), n)
        self.page_host = pages.column("host").to_numpy()
        self.host = self.page_host.view(np.uint64)[self.page]
        self.hash = _hash(self.words)
        # one window of MIN_WORDS words starts at each of these places
        size = max(0, len(self.words) - MIN_WORDS + 1)
        self.whole = self.page[:size] == self.page[MIN_WORDS - 1:]

    def strings(self, n: int) -> np.ndarray:
        """A hash, led by the host, of every ``n`` words that follow each other."""
        out = np.zeros(max(0, len(self.hash) - n + 1), np.uint64)
        for j in range(n):
            out = out * np.uint64(0xD1342543DE82EF95) + self.hash[j: j + len(out)]
        return mix(mix(out) ^ self.host[: len(out)])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """By window: the place of its ANCHOR_WORDS words with the least hash; and the hashes by place."""
        g = self.strings(ANCHOR_WORDS)
        size = len(self.whole)
        at, least = np.arange(size), g[:size].copy()
        for j in range(1, MIN_WORDS - ANCHOR_WORDS + 1):
            less = g[j: j + size] < least
            least[less], at[less] = g[j: j + size][less], np.flatnonzero(less) + j
        return at, g


# --- which keys do other pages have? -------------------------------------------------------------

def coded(x: np.ndarray, bits: int) -> bytes:
    """Ascending distinct numbers below 2 ** bits in about log2(2 ** bits / n) + 2 bits each (Elias and Fano)."""
    low = max(0, bits - len(x).bit_length())
    out = [len(x).to_bytes(4, "little"), low.to_bytes(1, "little")]
    if low:
        step = np.arange(low, dtype=np.uint64)
        out += [np.packbits(((x[k: k + 4096, None] >> step) & np.uint64(1)).astype(np.uint8)).tobytes()
                for k in range(0, len(x), 4096)]
    high = (x >> np.uint64(low)).astype(np.int64) + np.arange(len(x))
    bit = np.zeros(int(high[-1]) + 1, np.uint8)
    bit[high] = 1
    return b"".join([*out, np.packbits(bit).tobytes()])


def decoded(data: bytes) -> np.ndarray:
    n, low = int.from_bytes(data[:4], "little"), data[4]
    at, x = 5, np.zeros(n, np.uint64)
    if low:
        step = np.arange(low, dtype=np.uint64)
        for k in range(0, n, 4096):
            m = min(4096, n - k)
            size = (m * low + 7) // 8
            bit = np.unpackbits(np.frombuffer(data, np.uint8, size, at))[: m * low].reshape(m, low)
            x[k: k + m] = (bit.astype(np.uint64) << step).sum(axis=1, dtype=np.uint64)
            at += size
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=at)))[:n] - np.arange(n)
    return x | (high.astype(np.uint64) << np.uint64(low))


def _differ(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By group, given the groups' first places: whether it has several values."""
    return np.minimum.reduceat(x, first) != np.maximum.reduceat(x, first) if len(x) else np.zeros(0, bool)


class Keys:
    """A chunk's keys of one round: distinct ones in order, where they are, whether several pages of the chunk have them."""

    def __init__(self, key: np.ndarray, page: np.ndarray, before: np.ndarray | None):
        order = np.argsort(key)
        k, p = key[order], page[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        first = np.flatnonzero(new)
        self.key = k[first]
        self.of = np.empty(len(k), np.int64)  # by place: the number of its key
        self.of[order] = np.cumsum(new) - 1
        self.many = _differ(p, first)
        self.before = np.zeros(0, np.uint32)
        self.branch = np.zeros(len(first), bool)
        if before is not None:
            b = before[order]
            self.branch = _differ(b, first)
            self.before = np.where(self.branch, np.uint32(MIXED), b[first])

    def sent(self, bits: int, bucket_bits: int) -> Iterator[tuple[int, bytes, bytes]]:
        bucket = (self.key >> np.uint64(bits - bucket_bits)).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(bucket)]):
            rest = self.key[a:b] & np.uint64((1 << (bits - bucket_bits)) - 1)
            yield int(bucket[a]), coded(rest, bits - bucket_bits), self.before[a:b].tobytes()

    def answered(self, replies: pa.Table, level: int, bits: int, bucket_bits: int) -> None:
        """Adds what the chunk's replies say about other chunks."""
        counts = np.bincount((self.key >> np.uint64(bits - bucket_bits)).astype(np.int64), minlength=1)
        ends = np.cumsum(counts)
        for lev, bucket, shared, branch in zip(*(replies.column(x).to_pylist()
                                                 for x in ("level", "bucket", "shared", "branch"))):
            if lev == level:
                here = slice(ends[bucket] - counts[bucket], ends[bucket])
                for x, data in ((self.many, shared), (self.branch, branch)):
                    x[here] |= np.unpackbits(np.frombuffer(data, np.uint8))[: counts[bucket]].astype(bool)


def _round(chunk: pa.Table, replies: pa.Table | None, level: int, shape: tuple[int, int]):
    """(streams, keys, places of the keys' first words) of a chunk in round ``level``, given the replies of earlier rounds."""
    bits, bucket_bits = shape
    s = Streams(_pages(chunk))
    at, g = s.anchors()
    is_anchor = np.zeros(len(s.hash), bool)
    is_anchor[at[s.whole]] = True
    anchor = np.flatnonzero(is_anchor)
    keys = Keys(g[anchor] >> np.uint64(64 - bits), s.page[anchor], None)
    if not level:
        return s, keys, anchor
    keys.answered(replies, 0, bits, bucket_bits)
    common = np.zeros(len(s.hash) + 1, bool)
    common[anchor[keys.many[keys.of]]] = True
    place = np.flatnonzero(s.whole & common[at])
    start = np.concatenate([[True], s.page[1:] != s.page[:-1]])[place] if len(place) else np.zeros(0, bool)
    before = (mix(s.hash[place - 1]) >> np.uint64(33)).astype(np.uint32)
    keys = Keys(s.strings(MIN_WORDS)[place], s.page[place], np.where(start, np.uint32(NO_WORD), before))
    if level > 1:
        keys.answered(replies, 1, 64, bucket_bits)
    return s, keys, place


def _settled(level: int, bucket_bits: int):
    """One bucket of keys of all chunks -> by chunk: which of its keys other chunks have, and after another word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, list] = {}
        for batch in batches:
            for bucket, chunk, keys, before in zip(*(c.to_pylist() for c in batch.columns)):
                buckets.setdefault(bucket, []).append((chunk, decoded(keys), np.frombuffer(before, np.uint32)))
        for bucket, rows in buckets.items():
            key = np.concatenate([k for _, k, _ in rows])
            order = np.argsort(key)
            first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            size = np.diff(np.append(first, len(key)))
            shared, branch = np.empty(len(key), bool), np.zeros(len(key), bool)
            shared[order] = np.repeat(size > 1, size)
            if level:
                before = np.concatenate([b for _, _, b in rows])[order]
                branch[order] = np.repeat(_differ(before, first), size)
            ends = np.cumsum([len(k) for _, k, _ in rows]).tolist()
            parts = [(a, b) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _, _ in rows], pa.int64()), pa.array([level] * len(rows), pa.int32()),
                 pa.array([bucket] * len(rows), pa.int32()),
                 pa.array([np.packbits(shared[a:b]).tobytes() for a, b in parts], pa.binary()),
                 pa.array([np.packbits(branch[a:b]).tobytes() for a, b in parts], pa.binary())],
                names=["chunk", "level", "bucket", "shared", "branch"])
    return run


REPLY = "chunk long, level int, bucket int, shared binary, branch binary"


def _exchanged(table: DataFrame, replies: DataFrame | None, level: int, shape: tuple[int, int]) -> DataFrame:
    """The replies to the keys of round ``level``."""
    bits, bucket_bits = shape

    def send(chunk: pa.Table, known: pa.Table | None = None) -> pa.Table:
        name = chunk.column("chunk")[0].as_py()
        _, keys, _ = _round(chunk, known, level, shape)
        rows = list(keys.sent(64 if level else bits, bucket_bits))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([name] * len(rows), pa.int64()),
                         "keys": pa.array([r[1] for r in rows], pa.binary()), "before": pa.array([r[2] for r in rows], pa.binary())})

    types = "bucket int, chunk long, keys binary, before binary"
    chunks = table.groupBy("chunk")
    sent = (chunks.applyInArrow(lambda t: send(t), types) if replies is None
            else chunks.cogroup(replies.groupBy("chunk")).applyInArrow(lambda t, r: send(t, r), types))
    return written(sent.repartitionById(1 << bucket_bits, F.col("bucket")).mapInArrow(_settled(level, bucket_bits), REPLY), "replies")


# --- the suffix sort -----------------------------------------------------------------------------

def common_words(a: str, b: str) -> int:
    """Words of the common prefix of two suffixes (each word ends in a space)."""
    if a == b:
        return a.count(" ")
    n = 0
    for x, y in zip(a.split(" "), b.split(" ")):
        if x != y or not x:
            break
        n += 1
    return n


def _places(shape: tuple[int, int], rate: int):
    """The suffixes of a chunk that are sorted: word number, end of the run of shared windows; and a sample of them."""
    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        name = chunk.column("chunk")[0].as_py()
        s, keys, place = _round(chunk, replies, 2, shape)
        shared = keys.many[keys.of]
        at, branch = place[shared], keys.branch[keys.of][shared]
        start = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (s.page[at[1:]] != s.page[at[:-1]])])[: len(at)]
        number = np.cumsum(start) - 1
        far = (at[np.append(np.flatnonzero(start)[1:], len(at)) - 1] + MIN_WORDS)[number] if len(at) else at
        keep = start | branch
        at, far = at[keep], far[keep]
        some = np.flatnonzero(mix(at.astype(np.uint64) ^ np.uint64(name)) % np.uint64(rate) == 0)
        sample = [{"host": int(s.page_host[s.page[a]]), "suffix": _suffix(s.words, a, f), "chunk": name, "at": a}
                  for a, f in zip(at[some].tolist(), far[some].tolist())]
        return pa.table({"chunk": pa.array([name], pa.int64()), "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                         "far": pa.array([far.astype(np.int32).tobytes()], pa.binary()),
                         "sample": pa.array([sample], pa.list_(SAMPLE))})
    return run


SAMPLE = pa.struct([("host", pa.int64()), ("suffix", pa.string()), ("chunk", pa.int64()), ("at", pa.int64())])
SUFFIX = pa.schema([("host", pa.int64()), ("suffix", pa.string()), ("chunk", pa.int64()), ("at", pa.int32()),
                    ("page", pa.int32()), ("stop", pa.int32()), ("common", pa.int32())])


def _suffix(words: list[str], at: int, far: int) -> str:
    return " ".join(words[at: min(far, at + DEPTH)]) + " "


def _dealt(splitters: list[tuple]):
    """The suffixes of a chunk, in order, cut at the splitters: one packed row for each bucket."""
    def run(chunk: pa.Table, places: pa.Table) -> pa.Table:
        out: list[list] = [[], []]
        if places.num_rows and len(places.column("at")[0].as_py()):
            name = chunk.column("chunk")[0].as_py()
            at, far = (np.frombuffer(places.column(x)[0].as_py(), np.int32) for x in ("at", "far"))
            # the next sorted suffix of the run, or the run's end
            stop = np.where(np.append(far[1:] == far[:-1], False), np.append(at[1:], 0), far)
            pages = _pages(chunk)
            text = " ".join(t for t in pages.column("text").to_pylist() if t).replace("\n", " ").split(" ")
            page = np.repeat(np.arange(pages.num_rows), pages.column("n").to_numpy())[at]
            host = pages.column("host").to_numpy()[page]
            rows = sorted((h, _suffix(text, a, f), name, a, p, max(e, a + DEPTH), 0) for h, a, f, p, e in zip(
                *(x.tolist() for x in (host, at, far, page, stop))))
            cuts = [bisect.bisect_left(rows, k) for k in splitters]
            for bucket, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
                if a < b:
                    out[0].append(bucket)
                    out[1].append(_packed(_suffix_batch(rows[a:b])))
        return pa.table({"bucket": pa.array(out[0], pa.int32()), "rows": pa.array(out[1], pa.binary())})
    return run


def _suffix_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), SUFFIX.types)], schema=SUFFIX)


def _rows(z: bytes) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in _unpacked(z).columns)))


def _likeness(a: tuple, b: tuple) -> int:
    return common_words(a[1], b[1]) if a[0] == b[0] else 0


def _with_common(rows: list[tuple]) -> list[int]:
    """By row of an ordered bucket: the longest common prefix with a suffix of another page."""
    near = [_likeness(a, b) for a, b in zip(rows, rows[1:])]
    page = [(r[2], r[4]) for r in rows]
    best = [0] * len(rows)
    for order, step in ((range(1, len(rows)), -1), (range(len(rows) - 2, -1, -1), 1)):
        other = 0  # common prefix of the row before with the nearest suffix of another page than its own
        for i in order:
            common = near[min(i, i + step)]
            other = common if page[i] != page[i + step] else min(common, other)
            best[i] = max(best[i], other)
    return best


def _found(rows: list[tuple]) -> dict[int, list[tuple[int, int]]]:
    """Chunk -> (word number, end) of the matches of at least MIN_WORDS words."""
    out: dict[int, list[tuple[int, int]]] = {}
    for _, _, chunk, at, _, stop, common in rows:
        if common >= MIN_WORDS:
            out.setdefault(chunk, []).append((at, at + common if common < DEPTH else stop))
    return out


def _match_batch(found: dict[int, list[tuple[int, int]]], edge: list[bytes] = (), settle: bytes | None = None) -> pa.RecordBatch:
    n = len(found)
    return pa.RecordBatch.from_arrays(
        [pa.array([*found, *([None] * len(edge))], pa.int64()),
         pa.array([*(np.array(x, np.int32).tobytes() for x in found.values()), *([None] * len(edge))], pa.binary()),
         pa.array([None] * n + list(edge), pa.binary()), pa.array([None] * n + [settle] * len(edge), pa.binary())],
        names=["chunk", "matches", "edge", "settle"])


MATCH = "chunk long, matches binary, edge binary, settle binary"


def _sorted_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket in order: its matches, the two outermost pages of each side, and the rows only other buckets settle."""
    rows = sorted(r for batch in batches for z in batch.column(1).to_pylist() for r in _rows(z))
    if not rows:
        return
    rows = [(*r[:6], c) for r, c in zip(rows, _with_common(rows))]
    page = [(r[2], r[4]) for r in rows]
    head = next((i for i, p in enumerate(page) if p != page[0]), len(rows))
    tail = next((i for i in range(len(rows) - 1, -1, -1) if page[i] != page[-1]), -1)
    open_ = rows[:head] + rows[max(head, tail + 1):]
    edge = [rows[0], rows[min(head, len(rows) - 1)], rows[max(tail, 0)], rows[-1]]
    yield _match_batch(_found(rows[head: max(head, tail + 1)]), [_packed(_suffix_batch(edge))], _packed(_suffix_batch(open_)))


def _beside(edges: list[tuple[int, list[tuple]]]) -> dict[int, list[tuple]]:
    """Bucket -> the nearest suffixes of two pages before and behind it."""
    out: dict[int, list[tuple]] = {b: [] for b, _ in edges}
    for way, (near, far) in ((edges, (3, 2)), (edges[::-1], (0, 1))):
        seen: list[tuple] = []
        for bucket, e in way:
            out[bucket] = out[bucket] + seen
            seen = [e[near], *(x for x in (e[far], *seen) if (x[2], x[4]) != (e[near][2], e[near][4]))][:2]
    return out


def _matches(table: DataFrame) -> DataFrame:
    """chunk, matches: word numbers and ends of what other pages of the host have too."""
    spark = table.sparkSession
    total = table.agg(F.sum("n_words")).first()[0] or 0
    width = shuffle_width(spark)
    bucket_bits = max(1, (max(width, total // BUCKET_WORDS) - 1).bit_length())
    # an anchor is taken for a shared one by mistake about once in 256 times
    shape = (max(total.bit_length() + 8, bucket_bits + 1), bucket_bits)
    first = _exchanged(table, None, 0, shape)
    replies = first.unionByName(_exchanged(table, first, 1, shape))
    places = written(table.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        _places(shape, max(16, total // SAMPLE_ROWS)),
        "chunk long, at binary, far binary, sample array<struct<host:long,suffix:string,chunk:long,at:long>>"), "places")
    sample = sorted(tuple(r) for r in places.select(F.explode("sample").alias("s")).select("s.*").collect())
    buckets = min(1 << bucket_bits, max(1, len(sample)))
    splitters = [sample[len(sample) * k // buckets] for k in range(1, buckets)] if sample else []
    dealt = table.groupBy("chunk").cogroup(places.select("chunk", "at", "far").groupBy("chunk")).applyInArrow(
        _dealt(splitters), "bucket int, rows binary")
    found = written(dealt.repartitionById(1 << bucket_bits, F.col("bucket")).mapInArrow(_sorted_bucket, MATCH)
                    .withColumn("bucket", F.spark_partition_id()), "suffixes")
    beside = _beside([(r["bucket"], _rows(r["edge"])) for r in
                      found.where("edge is not null").select("bucket", "edge").orderBy("bucket").collect()])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(*r[:6], max([r[6], *(_likeness(r, x) for x in beside[bucket] if (x[2], x[4]) != (r[2], r[4]))]))
                        for r in _rows(z)]
                yield _match_batch(_found(rows)).select(["chunk", "matches"])

    settled = found.where("edge is not null").select("bucket", "settle").mapInArrow(settle, "chunk long, matches binary")
    return found.where("edge is null").select("chunk", "matches").unionByName(settled)


# --- the text ------------------------------------------------------------------------------------

def kept_text(zones: list[tuple[int, str]], has_article: bool, covered: np.ndarray) -> str:
    """The main text, given which words of the page other pages of the host have in runs of MIN_WORDS."""
    if has_article:
        return " ".join(text for zone, text in zones if zone == ARTICLE)
    kept, own, at = [], [], 0
    for zone, text in zones:
        words = text.split(" ")
        cover = covered[at: at + len(words)]
        at += len(words)
        if zone == DROPPED:
            continue
        own.append(text)
        if cover.all():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8))).tolist()
        gone = np.zeros(len(words), bool)
        for a, b in zip(edges[::2], edges[1::2]):
            gone[a:b] = b - a >= LONG_WORDS
        kept.append(" ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else text)
    return " ".join(kept if kept else own)


def main_text(page: str | None, host: str, repeated: list[tuple[int, int]]) -> tuple[str, int]:
    """Main text and the number of words under repeats, given the runs of words that other pages of the host have too."""
    zones, has_article = blocks(page)
    covered = np.zeros(sum(len(text.split(" ")) for _, text in zones), bool)
    for a, b in repeated:
        covered[a:b] = True
    return kept_text(zones, has_article, covered), int(covered.sum())


RESULT = "page_id long, url string, text string, n_chars long, n_repeated_words long"


def _texts(chunk: pa.Table, matches: pa.Table) -> pa.Table:
    pages = _pages(chunk)
    n = pages.column("n").to_numpy()
    ends = np.cumsum(n)
    step = np.zeros(int(n.sum()) + 1, np.int64)
    for data in matches.column("matches").to_pylist():
        found = np.frombuffer(data, np.int32).reshape(-1, 2)
        np.add.at(step, found[:, 0], 1)
        np.add.at(step, found[:, 1], -1)
    covered = np.cumsum(step)[:-1] > 0
    text, repeated = [], []
    for has, zones, words, a, b in zip(pages.column("has_article").to_pylist(), pages.column("zones").to_pylist(),
                                       pages.column("text").to_pylist(), (ends - n).tolist(), ends.tolist()):
        text.append(kept_text([(int(z), t) for z, t in zip(zones, words.split("\n"))], has, covered[a:b]))
        repeated.append(int(covered[a:b].sum()))
    out = pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array(text, pa.string()),
                    "n_chars": pa.array([len(t) for t in text], pa.int64()), "n_repeated_words": pa.array(repeated, pa.int64())})
    copies = pages.column("copies").to_numpy()
    return out.take(pa.array(np.repeat(np.arange(len(copies)), copies))) if (copies != 1).any() else out


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_repeated_words (words that other pages of the host repeat) of every row."""
    own = pick(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    # a row's key: 96 bits of two digests, which repeated rows share
    no_id = F.col("page_id").isNull()
    did, th = F.xxhash64("html", "url", "page_id", no_id), F.hash("url", "html", no_id)
    counted = own.groupBy(did.alias("did"), th.alias("th")).agg(F.count("*").alias("n")).where("n > 1")
    if counted.isEmpty():
        once = own.withColumn("copies", F.lit(1).cast("long"))
    else:
        once = (own.groupBy(did.alias("did"), th.alias("th"))
                .agg(F.any_value(F.struct("page_id", "url", "html")).alias("p"), F.count("*").alias("copies"))
                .select("p.*", "copies"))
    table = _chunk_table(once.withColumn("host", host_of(F.col("url"))))
    return table.groupBy("chunk").cogroup(_matches(table).groupBy("chunk")).applyInArrow(_texts, RESULT)
