"""Main text of web pages: what a page shares with its neighbour by URL is template.

Pages of a host are put in the order of their paths; each is paired with the one
before or after it that its path is most like.  The text blocks of the two are
aligned by a longest common subsequence, and what is aligned is deleted.
Markup says what is never text (scripts, menus, forms, comments ...), and blocks
inside an article are not deleted: paragraphs that two articles share are theirs.
Pages without an article that copy each other, or nearly, say nothing of the template.
"""

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from pairscreen.llm.shared import numbered
from pairscreen.operators.indexing import with_position
from pairscreen.session import materialise

#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template nav header footer aside form menu dialog button select textarea svg iframe object canvas head title".split())
#: The same inside an article, where a header holds its heading.
DROPPED_INSIDE = DROPPED - {"header"}
#: Elements of which everything up to the end tag is raw.
RAW = frozenset("script style template noscript textarea title iframe".split())
#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold the article, and words of a class or id that say what is none.
ARTICLE = frozenset(["article", "main"])
NOT_TEXT = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices popup "
    "modal overlay sidebar nav navbar navigation menu breadcrumb breadcrumbs header masthead footer comment comments "
    "comment-list discussion disqus replies share sharing social related newsletter subscribe".split()
)
#: The same inside an article, as with elements.
NOT_TEXT_INSIDE = NOT_TEXT - {"header"}
#: Elements that hold the page or the article, whatever their names say of it.
WHOLE = ARTICLE | {"html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: A page without article that has this part of its characters, or more, in common with
#: a neighbour is a copy of it, and what they share no template.
COPY = 0.9

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_MARKS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"[\s ]+")


def _says_no(name, attributes, article):
    """Whether a class, id or role says that an element is none of the text.  Inside
    an article only whole names do: parts of them, such as post-header, and ids of
    headings speak of what the article is about."""
    if name in WHOLE:
        return False
    for m in _MARKS.finditer(attributes):
        found = (m[2] or m[3] or m[4] or "").lower().split()
        if article:
            if m[1].lower() == "id" and name in HEADINGS:
                continue
            if not NOT_TEXT_INSIDE.isdisjoint(found):
                return True
        elif any(w in NOT_TEXT or not NOT_TEXT.isdisjoint(re.split(r"[-_]", w)) for w in found):
            return True
    return False


def blocks(page):
    """Text blocks of a page in order: (text, inside an article)."""
    out, part = [], []
    open_ = []  # (name, dropped, article) of elements that may have an end tag
    dropped = article = 0

    def close_block():
        text = _SPACE.sub(" ", html.unescape("".join(part))).strip()
        part.clear()
        if text:
            out.append((text, article > 0))

    def close_to(depth):
        nonlocal dropped, article
        while len(open_) > depth:
            _, no, inside = open_.pop()
            dropped -= no
            article -= inside

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and not dropped:
            part.append(page[at:stop])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, ends = m[2].lower(), bool(m[1])
        if name in BLOCKS or name in ARTICLE:
            close_block()
        elif name == "br":
            part.append(" ")
        if ends:
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth][0] == name:
                    close_to(depth)
                    break
            continue
        if name in VOID or m[3].endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if end is None:
                break  # the rest is raw
            close = page.find(">", end.start())
            at = len(page) if close < 0 else close + 1
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            # The next of its kind ends the last, unless a list or table lies between.
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth][0] == name:
                    close_to(depth)
                    break
                if open_[depth][0] in BLOCKS and open_[depth][0] != "p":
                    break
        no = name in (DROPPED_INSIDE if article else DROPPED) or _says_no(name, m[3], article)
        open_.append((name, no, name in ARTICLE))
        dropped += no
        article += name in ARTICLE
    close_block()
    return out


def _rows_of(a, b):
    """Bit-parallel lengths of common subsequences: after each item of ``a``, bit j
    is 0 where item j of ``b`` makes the longest one longer."""
    at = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a, b):
    """Length of the longest common subsequence of ``a`` with each start of ``b``."""
    v = (1 << len(b)) - 1
    for v in _rows_of(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a, b, room=1 << 26):
    """Positions in ``a`` of a longest common subsequence with ``b``.  Above ``room``
    cells ``a`` is halved and ``b`` cut where the halves' lengths add up to most."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    head, tail = list(range(start)), list(range(len(a) - end, len(a)))
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return head + tail
    if len(a) * len(b) > room and len(a) > 1:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        inner = common(a[:half], b[:cut], room) + [half + i for i in common(a[half:], b[cut:], room)]
        return head + [start + i for i in inner] + tail
    rows = [(1 << len(b)) - 1, *_rows_of(a, b)]
    inner, j = [], len(b) - 1
    for i in range(len(a), 0, -1):
        # The last item of b, up to j, that makes the subsequence longer.
        zeros = ~rows[i] & ((1 << j + 1) - 1)
        if not zeros:
            break
        last = zeros.bit_length() - 1
        before = ~rows[i - 1] & ((1 << j + 1) - 1)
        if before.bit_count() == zeros.bit_count():
            continue  # as long without item i
        inner.append(i - 1)
        j = last - 1
    return head + [start + i for i in reversed(inner)] + tail


def _loose(parsed):
    """Hashes and lengths of the blocks outside articles."""
    texts = [t for t, inside in parsed if not inside]
    return [xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for t in texts], [len(t) for t in texts]


def _same_start(a, b):
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extract(pages, id_col="page_id", url_col="url", html_col="html"):
    """Main text of every page: ``id_col``, ``url_col``, ``text`` (blocks in page
    order joined by an empty line; empty if there are none), ``n_chars``.

    Character references are decoded, white space within a block becomes one
    space.  Pages are numbered in the order of host, path and id, which cuts a host
    with a third of all pages anywhere; only hashes of blocks outside articles are
    written and travel between neighbours.  A page is parsed twice, for its hashes and
    for its text, as written blocks would take as much disk as the pages.  A page alone on its host has nothing to be compared with.

    Pages of a host that have the same blocks and no article are numbered once and
    share their result; a neighbour that such a page has ``COPY`` of its characters in
    common with shows no template, so the other one is taken, or none.

    A null or empty page has an empty text.  Null urls are pages of one host without
    name.  Pages with the same id, url and text are one in the numbering and each
    come back; an empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(
        pages[id_col].alias("id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html")
    ).withColumn("key", F.xxhash64("id", "url", "html"))
    address = F.coalesce(F.regexp_replace("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[^/?#]*", 0))
    path = F.regexp_extract(address, r"^[^/?#]*([^?#]*)", 1)

    def hashed(batches):
        for batch in batches:
            found, sizes, article, copy = [], [], [], []
            for key, host, t in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "html"))):
                parsed = blocks(t)
                loose, size = _loose(parsed)
                found.append(loose)
                sizes.append(size)
                article.append(len(loose) < len(parsed))
                same = np.array(loose, np.int64).tobytes() + host.encode()
                copy.append(key if article[-1] else xxhash.xxh64_intdigest(same) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("key", "host", "path")),
                    pa.array(found, pa.list_(pa.int64())),
                    pa.array(sizes, pa.list_(pa.int32())),
                    pa.array(article, pa.bool_()),
                    pa.array(copy, pa.int64()),
                ],
                names=["key", "host", "path", "loose", "sizes", "article", "copy"],
            )

    kinds = "key long, host string, path string, loose array<long>, sizes array<int>, article boolean, copy long"
    keyed = rows.select("key", host.alias("host"), path.alias("path"), "html").mapInArrow(hashed, kinds)
    # Numbering reads its input several times; pages are parsed once for all of them.
    keyed = materialise(keyed, "page-blocks")
    one = F.min(F.struct("host", "path", "key", "loose", "sizes", "article")).alias("one")
    placed = with_position(materialise(keyed.groupBy("copy").agg(one).select("copy", "one.*"), "page-copies"), ["host", "path", "key"], out="pos")
    near = placed.select(F.struct("host", "path", "loose").alias("near"), "pos")
    before = near.select((F.col("pos") + 1).alias("pos"), F.col("near").alias("before"))
    after = near.select((F.col("pos") - 1).alias("pos"), F.col("near").alias("after"))
    paired = placed.join(before, "pos", "left").join(after, "pos", "left")
    bare = rows.select("key", "id", "url", "html")

    def shared(batches):
        for batch in batches:
            gone = []
            for row in batch.to_pylist():
                others = [x for x in (row["before"], row["after"]) if x and x["host"] == row["host"]]
                others.sort(key=lambda x: -_same_start(x["path"], row["path"]))
                gone.append([])
                for other in others if row["loose"] else ():
                    found = common(row["loose"], other["loose"])
                    if row["article"] or sum(row["sizes"][i] for i in found) < COPY * sum(row["sizes"]):
                        gone[-1] = found
                        break
            yield pa.RecordBatch.from_arrays([batch.column("copy"), pa.array(gone, pa.list_(pa.int32()))], names=["copy", "gone"])

    columns = ["copy", "host", "path", "loose", "sizes", "article", "before", "after"]
    template = paired.select(*columns).mapInArrow(shared, "copy long, gone array<int>").where(F.size("gone") > 0)
    template = keyed.select("key", "copy").distinct().join(template, "copy").select("key", "gone")

    def text(batches):
        for batch in batches:
            out = []
            for page, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist()):
                gone, loose, kept = set(gone or ()), 0, []
                for block, inside in blocks(page):
                    if inside or loose not in gone:
                        kept.append(block)
                    loose += not inside
                out.append("\n\n".join(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    kind = dict(pages.dtypes)[id_col]
    schema = numbered([("id", kind), ("url", "string"), ("text", "string"), ("n_chars", "long")])
    joined = bare.join(template, "key", "left").select("id", "url", "html", "gone")
    return joined.mapInArrow(text, schema).withColumnsRenamed({"id": id_col, "url": url_col})
