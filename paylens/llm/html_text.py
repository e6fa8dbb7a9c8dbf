"""Main text of web pages by nearest-URL page differencing.

Pages of a host are put in order of their URL path; each is compared with the nearest page beside it. The text lines
of the two are aligned by longest common subsequence, and shared lines are deleted: menus, footers and
notices are the same on neighbouring pages, the article is not. Markup decides the weak cases: lines that a page itself
marks as not its article go even if no page beside it has them, and those inside its article element go
only if the two nearest pages have them.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from paylens.llm.tables import col, fresh
from paylens.session import stored

# a near copy shares more than COPY of what a page does not share with a second one, or ALMOST all
COPY = 0.5
ALMOST = 0.9

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|math|object|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|([^<]+|<)",
    re.S | re.I,
)
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead tr ul".split()
)
_SPACED = frozenset("br td th button input img label".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("head nav aside footer form menu dialog button select fieldset".split())
_ROLE = re.compile(r"""\brole\s*=\s*["']?(navigation|banner|contentinfo|complementary|search|dialog|alertdialog|alert|menu|menubar|form)\b""", re.I)
_NAMED = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
# whole class names and ids, words parted by one hyphen; of compounds only these and those that begin as below
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead sidebar aside rail comment comments respond reply replies disqus cookie cookies consent gdpr "
    "notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "pagination pager toolbar widget skip copyright commentlist "
    "site-header site-footer site-nav site-navigation main-nav main-menu main-navigation top-nav page-footer footer-nav left-sidebar right-sidebar "
    "sidebar-left sidebar-right social-share social-links share-buttons share-links related-posts related-articles related-links comment-list "
    "comment-form comments-area skip-link".split()
)
_BEGINS = tuple("ad- ads- advert- advertisement- navbar- breadcrumb- breadcrumbs- cookie- cookies- gdpr- consent- newsletter- pagination- sponsored- popup-".split())
# compounds that end with one of these, or begin with one and end with a name of a container
_NOUNS = frozenset("comment comments disqus banner advert adverts ads sidebar navbar breadcrumbs newsletter".split())
_HOLDERS = frozenset("section list area thread wrap wrapper container block box form panel".split())
_STATES = frozenset("has no with without is hide show".split())
# these are never the frame of a whole page
_SURE = frozenset("head nav aside footer menu dialog button select header".split())
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
# a new one of these ends an open one of the same name
_IMPLIED = frozenset("p li dt dd tr td th option".split())


def _is_compound(plain: str) -> bool:
    """Names like user-comments, top-banner or disqus-thread; not has-sidebar, which tells of a page beside one."""
    words = plain.split("-")
    if len(words) < 2 or words[0] in _STATES:
        return False
    return words[-1] in _NOUNS or (words[0] in _NOUNS and words[-1] in _HOLDERS)


def _is_aside(name: str, attributes: str, in_article: bool) -> bool:
    if name in _ASIDE or (name == "header" and not in_article):
        return True
    if not attributes or name in ("body", "html", "article", "main") and not in_article:
        return False
    if _ROLE.search(attributes) or _HIDDEN.search(attributes):
        return True
    if in_article and name in _PROSE:
        return False
    for m in _NAMED.finditer(attributes):
        for given in (m[1] or m[2] or m[3] or "").split():
            plain = re.sub(r"[-_]+", "-", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", given)).lower()
            if plain in _WORDS or plain.startswith(_BEGINS) or _is_compound(plain):
                return True
    return False


def _frames(tokens: list[re.Match]) -> set[int]:
    """Numbers of the start tags whose elements are not skipped: those around an article, or around over half of the text.

    A nav, aside, footer or the like around articles is a frame only if no article stands outside of such.
    """
    opened: list[tuple[int, str, int]] = []
    count: Counter[str] = Counter()
    around: dict[int, str] = {}
    ends: list[tuple[int, int]] = []
    size, plain = 0, False

    def end(at: int) -> None:
        for k, name, before in opened[at:]:
            count[name] -= 1
            if name not in _SURE:
                ends.append((k, size - before))
        del opened[at:]

    for i, m in enumerate(tokens):
        if m[5] is not None:
            size += len(m[5].strip())
            continue
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            if count[name]:
                end(next(k for k in range(len(opened) - 1, -1, -1) if opened[k][1] == name))
        elif name not in _EMPTY and not m[4].endswith("/"):
            if name in _IMPLIED and opened and opened[-1][1] == name:
                end(len(opened) - 1)
            if name in ("article", "main"):
                plain = plain or not any(count[n] for n in _SURE)
                for k, outer, _ in reversed(opened):
                    if k in around:
                        break
                    around[k] = outer
            opened.append((i, name, size))
            count[name] += 1
    end(0)
    return {k for k, inside in ends if 2 * inside > size} | {k for k, name in around.items() if not (plain and name in _SURE)}


def page_lines(html: str) -> tuple[list[str], list[int]]:
    """Text lines of a page and their kind: 0 marked as no article, 1 unmarked, 2 inside an article.

    A line is the text of a block, references decoded, white space folded. In a page with an article
    or main element, whatever is outside is marked as no article; no element around one is taken for marked.
    """
    lines: list[str] = []
    kinds: list[int] = []
    parts: list[str] = []
    # open article elements; open elements of the name that is skipped; where its text begins in an unfinished line
    article = skip = inline = 0
    skipping = ""

    def close() -> None:
        text = " ".join(references.unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append(text)
            kinds.append(0 if skip else 2 if article else 1)

    tokens = list(_TOKEN.finditer(html))
    frames = _frames(tokens)
    for i, m in enumerate(tokens):
        if m[5] is not None:
            parts.append(m[5])
            continue
        if m[3] is None:
            continue
        name = m[3].lower()
        if name in _BLOCKS:
            close()
        elif name in _SPACED:
            parts.append(" ")
        if m[2]:
            if skip and name == skipping:
                skip -= 1
                if not skip and name not in _BLOCKS:
                    del parts[inline:]
            elif skip and skipping in _IMPLIED and name in _BLOCKS and name not in _IMPLIED:
                skip = 0
            elif not skip and article and name in ("article", "main"):
                article -= 1
            continue
        if name in _EMPTY or m[4].endswith("/"):
            continue
        if skip and skipping in _IMPLIED and name in _BLOCKS and skipping in (name, "p"):
            skip = 0
        if skip:
            skip += name == skipping
        elif i not in frames and _is_aside(name, m[4], article > 0):
            skip, skipping, inline = 1, name, len(parts)
        elif name in ("article", "main"):
            article += 1
    close()
    if 2 in kinds:
        kinds = [0 if k == 1 else k for k in kinds]
    return lines, kinds


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of all of a with each beginning of b."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return row


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which items of a are in one longest common subsequence with b; by halving, in linear memory."""
    hit = np.zeros(len(a), dtype=bool)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            hit[i] = True
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            hit[j - 1] = True
            j, m = j - 1, m - 1
        if i >= j or k >= m:
            continue
        if j - i == 1:
            hit[i] = bool((b[k:m] == a[i]).any())
            continue
        middle = (i + j) // 2
        ahead = _lengths(a[i:middle], b[k:m])
        back = _lengths(a[middle:j][::-1], b[k:m][::-1])[::-1]
        cut = k + int(np.argmax(ahead + back))
        todo += [(i, middle, k, cut), (middle, j, cut, m)]
    return hit


def _shared(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Lines of a page in a longest common subsequence with another."""
    ours, theirs = np.isin(own, other), np.isin(other, own)
    hit = np.zeros(len(own), dtype=bool)
    hit[np.flatnonzero(ours)] = common_subsequence(own[ours], other[theirs])
    return hit


def shared_lines(own: np.ndarray, kind: np.ndarray, size: np.ndarray, beside: list[np.ndarray]) -> np.ndarray:
    """Lines to delete as shared; `beside` has the nearest page and, if there is one, the second.

    Near copies are told by what the page does not share with the second: a menu or footer, however long, is not
    part of that. Without a second, a near copy shares almost all. Lines inside an article need more to go: both pages
    have them, and they are less than half of the article.
    """
    hit = np.zeros(len(own), dtype=bool)
    if not beside:
        return hit
    has = [np.isin(own, other) for other in beside]
    if len(beside) == 2:
        rest = ~has[1]
        copy = size[rest & has[0]].sum() > COPY * size[rest].sum()
    else:
        copy = size[has[0]].sum() > ALMOST * size.sum()
    if copy and len(beside) == 1:
        return hit
    hit = _shared(own, beside[1 if copy else 0])
    inside = kind == 2
    both = hit & has[0] & has[1] if len(beside) == 2 and not copy else np.zeros(len(own), dtype=bool)
    if 2 * size[both & inside].sum() >= size[inside].sum():
        both[:] = False
    return np.where(inside, both, hit)


def _marks(html: str) -> tuple[list[str], list[int], list[int], int]:
    """Lines of a page, their kinds and marks, and the page's sign: pages of a host with the same one are copies.

    It is made of the lines that are not marked as no article, or of all if there is none.
    """
    import xxhash

    lines, kinds = page_lines(html)
    marks = [xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines]
    own = [m for m, k in zip(marks, kinds) if k] or marks
    return lines, kinds, marks, xxhash.xxh64_intdigest(np.array(own, dtype="<i8").tobytes()) - (1 << 63)


def _slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (..., html) to (..., sign, marks)."""
    for batch in batches:
        signs, marks = [], []
        for page in batch.column("_html"):
            _, _, mark, sign = _marks(page.as_py() or "")
            signs.append(sign)
            marks.append(np.array(mark, dtype="<i8").tobytes())
        kept = [c for c in batch.schema.names if c != "_html"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(signs, pa.int64()), pa.array(marks, pa.binary())], names=[*kept, "_sign", "_marks"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (..., html) to (..., lines, kinds, marks, sign); lines marked as no article keep their mark only."""
    for batch in batches:
        lines, kinds, marks, signs = [], [], [], []
        for page in batch.column("_html"):
            text, kind, mark, sign = _marks(page.as_py() or "")
            marks.append(np.array(mark, dtype="<i8").tobytes())
            lines.append([x if k else "" for x, k in zip(text, kind)])
            kinds.append(bytes(kind))
            signs.append(sign)
        kept = [c for c in batch.schema.names if c != "_html"]
        columns = [*[batch.column(c) for c in kept], pa.array(lines, pa.list_(pa.string())), pa.array(kinds, pa.binary()), pa.array(marks, pa.binary()), pa.array(signs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "_lines", "_kinds", "_own", "_sign2"])


def _common_start(a: str | None, b: str | None) -> int:
    a, b = a or "", b or ""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def _two(pages: list[tuple], at: int) -> tuple[bytes | None, bytes | None]:
    """Marks of the nearest page and of that on the other side, or the next behind it at an end of the host."""
    here = pages[at]
    sides = []
    for step in (-1, 1):
        side = [pages[i] for i in (at + step, at + 2 * step) if 0 <= i < len(pages) and pages[i][0] == here[0]]
        if side:
            sides.append((-_common_start(here[1], side[0][1]), step, [p[3] for p in side]))
    sides.sort(key=lambda x: x[:2])
    found = [side[0] for _, _, side in sides] if len(sides) == 2 else sides[0][2] if sides else []
    return tuple([*found, None, None][:2])


_BESIDE = {"_host": pa.string(), "_sign": pa.int64(), "_near": pa.binary(), "_far": pa.binary(), "_task": pa.int32(), "_at": pa.int64(), "_open": pa.bool_(), "_path": pa.string(), "_marks": pa.binary()}
_BESIDE_SCHEMA = "_host string, _sign long, _near binary, _far binary, _task int, _at long, _open boolean, _path string, _marks binary"


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (host, path, sign, marks) of one range, in order, to (host, sign, near, far, ...).

    The first and the last two of a range are left open, as pages beside them are in other ranges; these and the two next to
    them have their path and marks.
    """
    task = TaskContext.get().partitionId()
    held: list[tuple] = []
    base = at = 0

    def emit(upto: int, last: bool) -> pa.RecordBatch:
        out = []
        for i in range(at, upto):
            back = base + len(held) - i if last else 5
            open_ = i < 2 or back <= 2
            here = held[i - base]
            shown = (here[1], here[3]) if i < 4 or back <= 4 else (None, None)
            out.append((here[0], here[2], *((None, None) if open_ else _two(held, i - base)), task, i, open_, *shown))
        columns = zip(*out) if out else [[]] * len(_BESIDE)
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, _BESIDE.values())], names=list(_BESIDE))

    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("_host", "_path", "_sign", "_marks")))
        upto = max(at, base + len(held) - 4)
        yield emit(upto, False)
        at = upto
        cut = max(0, at - 2 - base)
        del held[:cut]
        base += cut
    yield emit(base + len(held), True)


# border pages are joined with those beside them in blocks of so many
BLOCK = 256


def _across(pages: pd.DataFrame) -> pd.DataFrame:
    """Open pages of one block of border pages with their neighbours; pages of other blocks are only beside them."""
    pages = pages.sort_values("_p")
    plain = list(zip(pages["_host"], pages["_path"], pages["_sign"], pages["_marks"]))
    found = [(plain[i][0], plain[i][2], *_two(plain, i)) for i in np.flatnonzero(pages["_asked"])]
    return pd.DataFrame(found, columns=["_host", "_sign", "_near", "_far"])


def _neighbours(pages: DataFrame) -> DataFrame:
    """(host, sign, near, far): the nearest pages of each page of (host, path, url, key, sign, marks).

    Pages of all hosts are sorted by ranges, so a host of any size is dealt to as many tasks as it fills. The first
    and last pages of each range are numbered through all ranges and meet in blocks, to which the two pages on either
    side are added, to find the pages across the borders. Only counts per range come together in one task.
    """
    order = ["_host", "_path", "_url", "_key", "_sign"]
    ranges = pages.repartitionByRange(*order).sortWithinPartitions(*order).select("_host", "_path", "_sign", "_marks")
    placed = stored(ranges.mapInArrow(_beside, _BESIDE_SCHEMA))
    shown = placed.where("_path IS NOT NULL").drop("_near", "_far")
    # at most eight pages of each range
    counts = shown.groupBy(F.col("_task").alias("_t2")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_t2").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_t2", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    nth = F.row_number().over(W.partitionBy("_task").orderBy("_at")) - 1
    numbered = shown.withColumn("_nth", nth).join(starts, F.col("_task") == F.col("_t2")).withColumn("_p", F.col("_first") + F.col("_nth"))
    blocks = F.array_distinct(F.transform(F.array(*[F.lit(i) for i in (-2, 0, 2)]), lambda i: F.floor((F.col("_p") + i) / BLOCK)))
    halos = numbered.select("_host", "_path", "_sign", "_marks", "_open", "_p", F.explode(blocks).alias("_block"))
    halos = halos.withColumn("_asked", F.col("_open") & (F.floor(F.col("_p") / BLOCK) == F.col("_block"))).drop("_open")
    borders = halos.groupBy("_block").applyInPandas(_across, "_host string, _sign long, _near binary, _far binary")
    return placed.where("NOT _open").select("_host", "_sign", "_near", "_far").union(borders)


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inner = ["_lines", "_kinds", "_own", "_near", "_far"]
    for batch in batches:
        texts, counts = [], []
        for i in range(len(batch)):
            lines, kinds, marks, near, far = (batch.column(c)[i].as_py() for c in inner)
            own, kind = np.frombuffer(marks, dtype="<i8"), np.frombuffer(kinds, dtype=np.uint8)
            size = np.array([len(x) for x in lines], dtype=np.int64) + (kind == 0)
            hit = shared_lines(own, kind, size, [np.frombuffer(m, dtype="<i8") for m in (near, far) if m is not None])
            keep = (kind > 0) & ~hit
            texts.append("\n".join(x for x, k in zip(lines, keep) if k))
            counts.append(int(hit.sum()))
        kept = [c for c in batch.schema.names if c not in inner]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=[*kept, "text", "n_shared"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every page with `text`, its main text, and `n_shared`, its lines deleted as shared; html is dropped.

    Pages without URL are not compared. Copies of a host stand once among its pages, at the place of the first by path,
    url and key, and are all compared with the pages beside it. Null or empty html gives an empty text. Columns
    `text` and `n_shared` are replaced, all others are kept. Pages are compared in the same way whatever the number of a host.
    """
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_shared", html.lower())]
    inner = {
        "_html", "_lines", "_kinds", "_own", "_marks", "_path", "_host", "_url", "_key", "_sign", "_host2", "_sign2", "_near", "_far"
    }
    if inner & {c.lower() for c in kept}:
        names = fresh(pages.select(*[col(c) for c in kept]), *["c" + str(i) for i in range(len(kept))])
        renamed = pages.select(*[col(c).alias(n) for c, n in zip(kept, names)], col(html).alias("_page"))
        back = dict(zip(kept, names))
        return extract(renamed, back[key], back[url], "_page").toDF(*kept, "text", "n_shared")
    address = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.lower(F.regexp_extract(col(url), address, 1)), F.lit(""))
    path = F.regexp_replace(F.regexp_extract(col(url), address, 2), r"(/|/index\.\w+|\.\w{1,5})$", "")
    placed = pages.select(host.alias("_host"), path.alias("_path"), col(url).alias("_url"), col(key).alias("_key"), col(html).alias("_html")).where("_host <> ''")
    slim = placed.mapInArrow(_slim, T.StructType([*placed.drop("_html").schema.fields, T.StructField("_sign", T.LongType()), T.StructField("_marks", T.BinaryType())]))
    first = slim.groupBy("_host", "_sign").agg(F.min(F.struct("_path", "_url", "_key", "_marks")).alias("one"))
    beside = _neighbours(first.select("_host", "one._path", "one._url", "one._key", "_sign", "one._marks"))

    # parsed again, so that texts are not kept while neighbours are found
    rows = pages.select(*[col(c) for c in kept], host.alias("_host2"), col(html).alias("_html"))
    extra = [T.StructField("_lines", T.ArrayType(T.StringType())), T.StructField("_kinds", T.BinaryType()), T.StructField("_own", T.BinaryType()), T.StructField("_sign2", T.LongType())]
    parsed = rows.mapInArrow(_parse, T.StructType([*rows.drop("_html").schema.fields, *extra]))
    paired = parsed.join(beside, (F.col("_host2") == F.col("_host")) & (F.col("_sign2") == F.col("_sign")), "left")
    out = T.StructType([*[pages.schema[c] for c in kept], T.StructField("text", T.StringType()), T.StructField("n_shared", T.LongType())])
    return paired.select(*[col(c) for c in kept], "_lines", "_kinds", "_own", "_near", "_far").mapInArrow(_difference, out)
