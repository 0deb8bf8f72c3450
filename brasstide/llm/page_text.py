"""HTML extraction: article structure, and a host suffix array that finds repeated boilerplate."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from brasstide.llm.common import small, written

#: Tokens that pages of a host must share in a row for the passage to count as repeated.
LONG = 8
#: Pages a host's boilerplate stands on at least, besides being on most of its pages.
COMMON_PAGES = 3

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is raw and never shown as text.
_RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp template svg math object audio video canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr".split())
#: Containers beside the article.
_BESIDE = frozenset("nav footer aside form head menu dialog button select option datalist fieldset".split())
_MAIN = frozenset(("article", "main"))
#: A class or id marks a container as not the article's if it consists of these words and _PLAIN ones, whole.
_MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
                   "sidebar side cookie cookies consent notice popup modal newsletter subscribe comment comments disqus reply replies respond "
                   "share social related breadcrumb breadcrumbs footer masthead pagination contentinfo complementary search".split())
#: Such words on pages outside of articles only; within one they are the names of its own parts.
_OUTER_MARKS = frozenset("header menu".split())
#: The marks of adverts: the only ones that count on a paragraph of an article.
_ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo".split())
#: The marks of reader comments: the only ones that count in an id within an article.
_COMMENTS = frozenset("comment comments disqus replies respond".split())
#: Words that say where, in what or whose a marked thing stands.
_PLAIN = frozenset("area article articles bar block bottom box button buttons container content count entry form global google icons inner "
                   "item items left link links list main outer page panel post posts primary reader readers right row secondary section "
                   "signup site slot stories thread threads top unit user users visitor visitors widget widgets wrap wrapper".split())
_ROLES = frozenset("banner navigation menu menubar search contentinfo complementary".split())
#: Only in these is an id the name of a place; elsewhere it is the slug of a heading.
_PLACES = frozenset("div ul ol table td".split())
#: The article's own text, whatever its class.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def blocks_of(html: str) -> tuple[list[str], list[str], bool]:
    """(article blocks, other blocks shown, whether the page names its article).

    Blocks are the texts between block-level tags, references decoded, white space made single
    spaces, empty ones left out. Without <article> or <main>, the first list holds all blocks outside
    of marked containers. Unclosed tags end with the element around them; an article opens even
    within a container that was never closed.
    """
    from html import unescape
    stack: list[tuple[str, bool, bool]] = []  # (tag, beside the article, in a main element)
    opened: Counter = Counter()  # of the stack by tag: an end tag without its start looks at nothing
    found: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    beside = inside = named = False
    at, size = 0, len(html)

    def end_block():
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append((text, beside, inside))
            parts.clear()

    while at < size:
        cut = html.find("<", at)
        if cut < 0:
            parts.append(html[at:])
            break
        if cut > at:
            parts.append(html[at:cut])
        tag = _TAG.match(html, cut)
        if tag is None:
            parts.append("<")
            at = cut + 1
            continue
        at = tag.end()
        name = tag[2]
        if name is None:
            continue
        name = name.lower()
        if name in _INLINE and name != "br":
            if tag[1] or not (tag[3] and _marked(name, tag[3], inside)):
                continue
        if name == "br":
            parts.append(" ")
            continue
        end_block()
        if tag[1]:
            ended = None
            while opened[name] and ended != name:
                ended, beside, inside = stack.pop()
                opened[ended] -= 1
            continue
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
            at = close.end() if close else size
            continue
        if name in _VOID or tag[3].endswith("/"):
            continue
        if name == "body":
            stack.clear()
            opened.clear()
            beside = inside = False
            continue
        stack.append((name, beside, inside))
        opened[name] += 1
        if name in _MAIN and not inside:
            beside, inside, named = False, True, True
        elif not beside:
            beside = name in _BESIDE or name == "header" and not inside or bool(tag[3]) and _marked(name, tag[3], inside)
    end_block()
    if named:
        main = [t for t, b, i in found if i and not b]
        return main, [t for t, b, i in found if b or not i], True
    return [t for t, b, _ in found if not b], [t for t, b, _ in found if b], False


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether class, role or id say that an element, in an article or not, is something beside the text.

    A class or id does so by consisting of marks and plain words, whole. Headings of an article never
    are, its paragraphs only as adverts; an id within it tells reader comments alone, since ids there
    are slugs of its sections.
    """
    if inside and name in _HEADINGS:
        return False
    prose = inside and name == "p"
    for kind, *value in _NAMES.findall(attributes):
        kind = kind.lower()
        if kind == "id":
            if name not in _PLACES and not (inside and name in ("section", "aside")):
                continue
            marks = _COMMENTS if inside else _MARKS | _OUTER_MARKS
        else:
            marks = _ADVERTS if prose else _MARKS if inside else _MARKS | _OUTER_MARKS
        for token in "".join(value).lower().split():
            if kind == "role":
                if token in _ROLES and not prose:
                    return True
                continue
            words = [w for w in re.split("[_-]+", token) if w]
            if any(w in marks for w in words) and all(w in marks or w in _PLAIN for w in words):
                return True
    return False


def _host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def _parse(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import xxhash

    def digest(blocks):
        return xxhash.xxh64_intdigest("\n".join(blocks).encode("utf-8", "surrogatepass")) - (1 << 63)

    for batch in batches:
        rows = []
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            main, other, named = blocks_of(html or "")
            # the unprotected stream: what stands beside the article or, without one, everything
            stream = other if named else main
            rows.append((_host(url), named, "\n".join(main) if named else None, stream, digest(stream), digest(main or other)))
        host, named, text, stream, print_, page = zip(*rows) if rows else ([], [], [], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(host, pa.string()), pa.array(named, pa.bool_()), pa.array(text, pa.string()),
             pa.array(stream, pa.list_(pa.string())), pa.array(print_, pa.int64()), pa.array(page, pa.int64())],
            names=["page_id", "url", "host", "named", "text", "stream", "stream_print", "page_print"])


def suffix_ranks(tokens, depth: int):
    """Ranks of all suffixes by their first `depth` tokens (a power of two), by prefix doubling.

    The argsort of the ranks is the suffix array to that depth; equal ranks share the tokens. Ends
    and page borders must carry tokens of their own.
    """
    import numpy as np
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        next_ = np.zeros_like(rank)
        next_[:-step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + next_, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return rank


def _windows(batches: Iterator) -> Iterator:
    """(host, window, stream_print, start, page_print): each page's LONG-token windows.

    The token streams of a batch's pages are concatenated host by host and sorted as one suffix
    array; a run of equal ranks is one window, whose tokens are hashed once.
    """
    import numpy as np
    import pyarrow as pa
    import xxhash
    for batch in batches:
        by_host: dict[str, list[tuple[list[str], int, int]]] = {}
        for host, stream, print_, page_print in zip(*(c.to_pylist() for c in batch.columns)):
            words = [w for block in stream for w in block.split(" ")]
            if len(words) >= LONG:
                by_host.setdefault(host, []).append((words, print_, page_print))
        out = ([], [], [], [], [])
        for host, pages in by_host.items():
            ids: dict[str, int] = {}
            flat, owner, start = [], [], []
            for page, (words, _, _) in enumerate(pages):
                flat += [ids.setdefault(w, len(ids)) for w in words]
                flat.append(-1 - page)  # a border no other page has
                owner += [page] * (len(words) + 1)
                start += range(len(words) + 1)
            ranks = suffix_ranks(np.array(flat, dtype=np.int64), LONG)
            whole = np.concatenate([np.arange(len(w) + 1) + LONG <= len(w) for w, _, _ in pages])
            order = np.argsort(ranks, kind="stable")
            order = order[whole[order]]
            fresh = np.append(True, ranks[order][1:] != ranks[order][:-1])
            window = 0
            for k, new in zip(order.tolist(), fresh.tolist()):
                page = owner[k]
                words, print_, page_print = pages[page]
                if new:
                    window = xxhash.xxh64_intdigest(" ".join(words[start[k]:start[k] + LONG]).encode("utf-8", "surrogatepass")) - (1 << 63)
                out[0].append(host)
                out[1].append(window)
                out[2].append(print_)
                out[3].append(start[k])
                out[4].append(page_print)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                                          pa.array(out[3], pa.int32()), pa.array(out[4], pa.int64())], names=["host", "window", "stream_print", "start", "page_print"])


_WINDOW = "host string, window bigint, stream_print bigint, start int, page_print bigint"


def _n_covered(starts: str):
    """Tokens that windows at these places cover."""
    tokens = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (LONG - 1))))
    return F.size(F.array_distinct(tokens))


def _unique_runs(batches: Iterator) -> Iterator:
    import pyarrow as pa
    for batch in batches:
        texts = []
        for stream, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            hit = {k for s in starts or () for k in range(s, s + LONG)}
            at, kept = 0, []
            for block in stream:
                words = block.split(" ")
                left = [w for k, w in enumerate(words, at) if k not in hit]
                at += len(words)
                if left:
                    kept.append(" ".join(left))
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(4)],
                                         names=["page_id", "url", "text", "n_repeated"])


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated): the main text of every page.

    An <article> or <main> is kept whole but for containers marked as something else in it, even
    where other pages repeat it. All other shown text of a page is its unprotected stream; n_repeated
    counts its tokens in runs of LONG or more that another page of the host (pages of one main text
    are one page) also has in its stream. A page without an article keeps its unmarked blocks but
    for boilerplate: runs of LONG tokens or more on most of the host's pages, COMMON_PAGES at least, in articles
    or not. So what few pages quote of each other stays on all of them. Null html is empty, a null or odd
    url has the host "", null ids keep their rows, repeated rows come out alike, an empty table gives no rows.

    Only streams are stored; articles are cut into windows only for hosts that have a page without one.
    Articles meet the counts by broadcast, or by shuffle where those are many.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    parsed = pages.select(F.col(key), F.col(url), F.col(html)).mapInArrow(
        _parse, f"page_id {kinds[0]}, url {kinds[1]}, host string, named boolean, text string, stream array<string>, "
                "stream_print bigint, page_print bigint")
    streams = written(parsed.drop("text"), "page-streams")
    windows = streams.select("host", "stream", "stream_print", "page_print").mapInArrow(_windows, _WINDOW)
    plain_hosts = written(streams.where(~F.col("named")).select("host").distinct(), "plain-hosts")
    n_plain = plain_hosts.count()
    plain_hosts = small(plain_hosts, n_plain)
    seen = windows.select("host", "window", "page_print", F.lit(1).alias("shown"))
    if n_plain:
        articles = (parsed.where("named").join(plain_hosts, "host", "left_semi")
                    .select("host", F.split("text", "\n").alias("stream"), "stream_print", "page_print").mapInArrow(_windows, _WINDOW))
        seen = seen.unionByName(articles.select("host", "window", "page_print", F.lit(0).alias("shown")))
    counts = (seen.groupBy("host", "window", "page_print").agg(F.max("shown").alias("shown"))
              .groupBy("host", "window").agg(F.count(F.lit(1)).alias("n"), F.sum("shown").alias("n_shown")))
    n_pages = (streams.join(plain_hosts, "host", "left_semi").select("host", "page_print").distinct()
               .groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")))
    common = F.coalesce((F.col("n") >= COMMON_PAGES) & (2 * F.col("n") > F.col("n_pages")), F.lit(False))
    repeated = written(counts.where(f"n_shown > 1 or n_shown = 1 and n >= {COMMON_PAGES}").join(n_pages, "host", "left")
                       .select("host", "window", (F.col("n_shown") > 1).alias("again"), common.alias("common"))
                       .where("again or common"), "repeated-windows")
    met = windows.join(small(repeated, repeated.count()), ["host", "window"])
    # one stream's own token positions
    covered = written(met.groupBy("host", "stream_print").agg(
        F.collect_set(F.when(F.col("common"), F.col("start"))).alias("starts"), F.collect_set(F.when(F.col("again"), F.col("start"))).alias("again"))
        .select("host", "stream_print", "starts", _n_covered("again").alias("n_repeated")), "covered-streams")
    covered = small(covered, covered.count())
    n_repeated = F.coalesce("n_repeated", F.lit(0)).alias("n_repeated")
    unnamed = (streams.where(~F.col("named")).join(covered, ["host", "stream_print"], "left")
               .select("page_id", "url", "stream", "starts", n_repeated)
               .mapInArrow(_unique_runs, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_repeated int"))
    named = parsed.where("named").join(covered.drop("starts"), ["host", "stream_print"], "left").select("page_id", "url", "text", n_repeated)
    return named.unionByName(unnamed).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"), "n_repeated")
