"""Main text of web pages: markup gives blocks and what they are for, host suffix arrays find the text that pages of a host share.

The token streams of a host's pages are laid end to end. Their suffixes, sorted by the first RUN tokens, bring equal substrings together: one
that several distinct pages hold is boilerplate, and a longer repeat is the union of such substrings, so that nothing more need be sorted.
A large host has a suffix array for each of its chunks, whose counts are added up; what comes out doesn't depend on the chunks.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import map_rows, segments, shingles, ship, stash, trim

#: Pages, and bytes, of a host whose streams make one suffix array, about; hosts with more are dealt to several by a hash.
CHUNK_PAGES, CHUNK_BYTES = 500, 16 << 20
#: Tokens of the shortest repeated substring (a power of two), and the share of a host's distinct pages that hold boilerplate (two at least).
RUN, SHARE = 8, 0.01

# --- markup -----------------------------------------------------------------------------------------------------------

OUT, OPEN, ARTICLE = 0, 1, 2  # not content by its markup; undecided; in an article

# Names of the markup language.
RAW = "script|style|textarea|title|iframe|noembed|noframes|xmp"
OUT_TAGS = frozenset("head nav footer aside form noscript template svg math select button object canvas audio video dialog menu datalist".split())
CONTAINERS = OUT_TAGS | frozenset("html body main article section header div ul ol dl table tbody thead tfoot tr td th caption blockquote figure figcaption fieldset details center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address summary legend option optgroup hgroup search".split())
IN_HEAD = frozenset("meta link base script style title noscript template".split())
SCOPES = frozenset("table td th caption template object".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words of class names and ids that say what an element is for.
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promoted promotion banner billboard cookie cookies consent gdpr notice notices newsletter subscribe "
    "subscription signup sidebar sidebars aside rail comment comments commentlist disqus respond reply replies nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar "
    "toolbar related recommended recommendations share sharing social popup modal overlay pagination pager login search searchbox skip hidden".split()
)
KEEP_WORDS = frozenset("has with no without is not".split())  # has-sidebar says something of the page, not that this is a sidebar

TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:[^>=]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|))*+(?:>|\Z).*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|))*+)(?:>|\Z)"
    rf"|<[!?][^>]*(?:>|\Z)|</(?![a-z])[^>]*(?:>|\Z)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?", re.S)
TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def attributes(text: str) -> dict[str, str]:
    if not TELLING.search(text):
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTRIBUTE.finditer(text)))}


def named_out(attrs: dict[str, str]) -> bool:
    """Whether role, class, id or visibility say that an element is not content."""
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in OUT_ROLES or INVISIBLE.search(attrs.get("style", "")):
        return True
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        words = [w.lower() for w in CAMEL.split(name) if w]
        if words and words[0] not in KEEP_WORDS and not OUT_WORDS.isdisjoint(words):
            return True
    return False


@dataclass
class Element:
    tag: str
    out: bool
    article: bool
    soft: bool = False  # out as a form alone: an article in it is one all the same


class Page:
    """Blocks of a page: (what the markup says of it, text with single spaces), in order. Elements may be unclosed or badly nested."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[int, str]] = []
        self.stack, self.text = [Element("", False, False)], []
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.add(source[at : m.start()])
            at = m.end()
            if m["tag"]:
                (self.close if m["end"] else self.open)(m["tag"].lower(), m["attrs"])
        if at < len(source):
            self.add(source[at:])
        self.flush()

    def add(self, piece: str) -> None:
        self.text.append(html.unescape(piece) if "&" in piece else piece)

    def flush(self) -> None:
        words = "".join(self.text).split()
        if words:
            top = self.stack[-1]
            self.blocks.append((OUT if top.out else ARTICLE if top.article else OPEN, " ".join(words)))
        self.text = []

    def cut(self, k: int) -> None:
        self.flush()
        del self.stack[k:]

    def open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.text.append("\n")
            return
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self.cut(len(self.stack) - 1)
        if tag in BLOCKS:
            self.flush()
            if self.stack[-1].tag == "p" or (tag == "li" and self.stack[-1].tag == "li"):
                self.cut(len(self.stack) - 1)
        named = attributes(attrs) if attrs else {}
        out = named_out(named) if named and tag not in ("html", "body", "main") else False
        if tag not in CONTAINERS and not out:
            return
        top = self.stack[-1]
        main = tag in ("article", "main") or named.get("role", "").lower() in ("main", "article") or "articlebody" in named.get("itemprop", "").lower()
        inherited = top.out and not (main and top.soft)
        own = out or tag in OUT_TAGS or (tag == "header" and not top.article)
        self.flush()
        self.stack.append(Element(tag, inherited or own, top.article or main, soft=(tag == "form" and not out and not inherited) or (top.soft and not own)))
        if attrs.endswith("/") and tag in ("svg", "math"):
            self.cut(len(self.stack) - 1)

    def close(self, tag: str, _: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self.cut(k)
                return
            if self.stack[k].tag in SCOPES:
                return


# --- suffix arrays ----------------------------------------------------------------------------------------------------


def suffix_ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """Ranks of suffixes by their first `length` tokens (a power of two), by prefix doubling; equal ones have equal ranks."""
    _, rank = np.unique(tokens, return_inverse=True)
    k = 1
    while k < length:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-k] = rank[k:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (len(rank) + 2) + ahead, return_inverse=True)
        k *= 2
    return rank


def starts(lengths: np.ndarray, run: int) -> np.ndarray:
    """Where substrings of `run` tokens start that don't cross streams of these lengths, laid end to end."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    return np.flatnonzero(np.arange(len(ends)) + run <= ends)


def holders(tokens: np.ndarray, lengths: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array, cut to suffixes of `run` tokens at least: where they start, which interval of equal substrings each is in, and how
    many of the streams hold the substring of each interval.

    tokens: streams of `lengths` tokens, one after another; substrings don't cross streams.
    """
    at = starts(lengths, run)
    if not len(at):
        return at, at, at
    stream = np.repeat(np.arange(len(lengths)), lengths)
    rank = suffix_ranks(tokens, run)[at]
    order = np.argsort(rank, kind="stable")  # equal prefixes together, by stream within
    rank, at = rank[order], at[order]
    owner = stream[at]
    first = np.concatenate(([True], rank[1:] != rank[:-1]))
    other = first | np.concatenate(([True], owner[1:] != owner[:-1]))
    interval = np.cumsum(first) - 1
    return at, interval, np.bincount(interval, weights=other).astype(np.int64)


def cover(n: int, at: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which of n tokens lie in one of the substrings of `run` tokens that start there."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + run, -1)
    return np.cumsum(edge[:-1]) > 0


def covered(tokens: np.ndarray, lengths: np.ndarray, run: int = RUN, share: float = SHARE) -> np.ndarray:
    """Which tokens lie in a substring of `run` tokens that at least two, and at least this share, of the streams hold."""
    at, interval, held = holders(tokens, lengths, run)
    return cover(len(tokens), at[held[interval] >= max(2, share * len(lengths))] if len(at) else at, run)


def listed(hashes: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which hashes are among these sorted ones."""
    if not len(among):
        return np.zeros(len(hashes), bool)
    return among[np.minimum(np.searchsorted(among, hashes), len(among) - 1)] == hashes


def stream_of(blocks: list) -> bytes:
    return " ".join(t for _, t in blocks).encode()


def tokens_of(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of streams, one stream after another, and the streams' lengths."""
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for seg in segments(streams):
        hashes.append(seg.hashes)
        counts.append(seg.counts)
    return np.concatenate(hashes), np.concatenate(counts)


def counted(streams: list[bytes], more_than: int = 0, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the RUN-token substrings that more than so many of the distinct streams hold (and that are among these sorted ones),
    and how many hold each."""
    tokens, lengths = tokens_of(streams)
    at, interval, held = holders(tokens, lengths)
    if not len(at):
        return np.empty(0, np.uint64), at
    runs = shingles(tokens, RUN)[at[np.flatnonzero(np.diff(interval, prepend=-1))]]
    keep = held > more_than
    if among is not None:
        keep &= listed(runs, among)
    return runs[keep], held[keep]


def main_texts(pages: list[list[tuple[int, str]]], known: np.ndarray | None = None) -> list[tuple[str, int]]:
    """Of pages of one host, as blocks, the text that stays and the number of tokens in repeated runs.

    Pages of equal text count as one. Repeated runs are found among all text, whatever its markup; `known` has the sorted hashes of the host's
    substrings of RUN tokens that are repeated, where these are but some of its pages. Undecided blocks that runs cover for half or
    more go. What the markup says for certain comes after: blocks of an article stay, whatever they share with other pages, and
    blocks that are out go, whether they are unique or not; where a page has an article, nothing else of it stays.
    """
    streams = [stream_of(blocks) for blocks in pages]
    kinds = {s: None for s in streams}
    tokens, lengths = tokens_of(list(kinds))
    if known is None:
        hits = covered(tokens, lengths)
    else:
        at = starts(lengths, RUN)
        hits = cover(len(tokens), at[listed(shingles(tokens, RUN)[at], known)] if len(at) else at)
    for s, at, n in zip(kinds, np.cumsum(lengths) - lengths, lengths, strict=True):
        kinds[s] = hits[at : at + n]
    out = []
    for stream, blocks in zip(streams, pages, strict=True):
        repeated, at, article, rest = kinds[stream], 0, [], []
        for where, text in blocks:
            n = text.count(" ") + 1
            if where == ARTICLE:
                article.append(text)
            elif where == OPEN and 2 * np.count_nonzero(repeated[at : at + n]) < n:
                rest.append(text)
            at += n
        out.append((" ".join(article or rest), int(np.count_nonzero(repeated))))
    return out


# --- the job ----------------------------------------------------------------------------------------------------------


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def unzipped(unzip: zstandard.ZstdDecompressor, blocks: bytes | None) -> list:
    return json.loads(unzip.decompress(blocks)) if blocks else []


def main_text(pages: DataFrame, chunk_pages: int = CHUNK_PAGES) -> DataFrame:
    """The main text of every page, whole.

    pages: page_id, url, html; other columns, whatever their names, are not read. Null and empty html have no text; null page_ids and urls pass
    through, pages without a host make a host of their own; one row out for each row in. Runs are looked for among all pages of a
    host. A large host is dealt to chunks of about `chunk_pages` pages by a hash; this says how the work is cut, not what comes out: substrings that
    a chunk holds too seldom are counted nowhere only if they can't reach SHARE of the host's distinct pages, all others in every
    chunk. Returns page_id, url, text, n_chars (code points) and n_repeated (words in runs that pages share).
    """
    d = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    sizes = d.groupBy("host").agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes"))
    sizes = sizes.select("host", F.ceil(F.greatest(F.col("pages") / chunk_pages, F.col("bytes") / CHUNK_BYTES)).alias("chunks"))
    large = stash(sizes.where("chunks > 1"))  # its size decides how it is joined

    def parser():
        zipper = zstandard.ZstdCompressor(level=1)

        def fn(rows: dict[str, list]) -> dict:
            parsed = [Page(s).blocks if s else [] for s in rows.pop("html")]
            digests = [hashlib.blake2b(stream_of(b), digest_size=16).digest() for b in parsed]
            return rows | {"digest": digests, "blocks": [zipper.compress(json.dumps(b, ensure_ascii=False).encode()) if b else None for b in parsed]}

        return fn

    parsed = map_rows(d, parser, "page_id long, url string, host string, digest binary, blocks binary")
    chunks = F.coalesce("chunks", F.lit(1)).cast("long")
    dealt = parsed.join(large, "host", "left").select("page_id", "url", "digest", "blocks", "host", chunks.alias("chunks"), F.pmod(F.xxhash64("page_id", "url", "digest"), chunks).alias("chunk"))
    # Every step below reads the rows as one shuffle by host and chunk deals them; Spark makes it once. Equal streams are neighbours.
    rows = dealt.withColumn("row", F.row_number().over(Window.partitionBy("host", "chunk").orderBy("digest")))

    def told(news: DataFrame) -> DataFrame:
        """rows, the first of each chunk with what a row of news (host, chunk, ...) says of it."""
        names = [c for c in news.columns if c not in ("host", "chunk")]
        joined = rows.join(news, ["host", "chunk"], "left").select(*rows.columns, *(F.when(F.col("row") == 1, F.col(c)).alias(c) for c in names))
        return joined.sortWithinPartitions("host", "chunk", "row")  # whatever kind of join it was

    # 1. Of copies in several chunks of a host, those in the chunk of the smallest number count.
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for h, c, n, digest in zip(*(batch.column(k).to_pylist() for k in ("host", "chunk", "chunks", "digest")), strict=True):
                if n > 1 and (h, c, digest) != last:
                    last = h, c, digest
                    out.append(last)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["host", "chunk", "digest"])

    copies = rows.sortWithinPartitions("host", "chunk", "row").mapInArrow(digests, "host string, chunk long, digest binary").withColumn("counts", F.col("chunk") == F.min("chunk").over(Window.partitionBy("host", "digest")))
    held = copies.groupBy("host", "chunk").agg(F.count_if("counts").alias("streams"), F.collect_list(F.when(~F.col("counts"), F.col("digest"))).alias("elsewhere"))
    # A substring that no chunk holds more than `most` times is held fewer than `least` times in all.
    held = held.withColumn("most", F.floor(0.999 * SHARE * F.col("streams")))
    whole = held.groupBy("host").agg(F.sum("streams").alias("streams"), F.sum("most").alias("most"))
    whole = whole.select("host", F.greatest(F.lit(2.0), SHARE * F.col("streams")).alias("least"), F.col("most").alias("unseen"))
    about = held.join(whole, "host").select("host", "chunk", "elsewhere", "most", "least", "unseen")

    # 2., 3. Counts of substrings by chunk, as far above `most` as they are; then those of all that can reach `least`.
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, key, last, streams, news = zstandard.ZstdDecompressor(), None, None, [], {}

        def done() -> pa.RecordBatch:
            among = news.get("among")
            if among is None:
                runs, n = counted(streams, news["most"])
                n = n - news["most"]
            else:
                runs, n = counted(streams, 0, np.sort(np.array(among, np.int64).view(np.uint64)))
            least = news["least"] - (news["unseen"] if among is None else 0)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(runs), pa.string()), pa.array(runs.view(np.int64)), pa.array(n, pa.int64()), pa.array(np.full(len(runs), least))], names=["host", "run", "n", "least"]
            )

        for batch in batches:
            for r in batch.to_pylist():
                if (r["host"], r["chunk"]) != key:
                    if streams:
                        yield done()
                    key, last, streams, news = (r["host"], r["chunk"]), None, [], r
                    skipped = set(r["elsewhere"] or ())
                # Hosts of one chunk are told nothing, nor are, the second time, those where nothing can reach `least`.
                if news["least"] is not None and r["digest"] != last and r["digest"] not in skipped:
                    streams.append(stream_of(unzipped(unzip, r["blocks"])))
                last = r["digest"]
            trim()
        if streams:
            yield done()

    kind = "host string, run long, n long, least double"

    def reaching(found: DataFrame) -> DataFrame:
        runs = found.groupBy("host", "run").agg(F.sum("n").alias("n"), F.max("least").alias("least")).where("n >= least")
        return runs.groupBy("host").agg(F.collect_list("run").alias("among"))

    ship(pages.sparkSession)
    possible = reaching(told(about.withColumn("among", F.lit(None).cast("array<long>"))).mapInArrow(counts, kind))
    repeated = reaching(told(about.join(possible, "host")).mapInArrow(counts, kind))

    # 4. The texts, by the host's repeated substrings; a host of one chunk is counted here.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, key, known, kept, size = zstandard.ZstdDecompressor(), None, None, [], 0

        def done() -> pa.RecordBatch:
            texts = main_texts([blocks for _, _, blocks in kept], known)
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in kept], pa.int64()), pa.array([u for _, u, _ in kept], pa.string()), pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([n for _, n in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_repeated"],
            )

        for batch in batches:
            for r in batch.to_pylist():
                now = r["host"], r["chunk"]
                if kept and (now != key or (known is not None and size > CHUNK_BYTES)):
                    yield done()
                    kept, size = [], 0
                if now != key:
                    key, known = now, np.sort(np.array(r["among"] or [], np.int64).view(np.uint64)) if r["chunks"] > 1 else None
                blocks = [tuple(b) for b in unzipped(unzip, r["blocks"])]
                kept.append((r["page_id"], r["url"], blocks))
                size += sum(len(t) for _, t in blocks) + 100
        if kept:
            yield done()

    return told(held.select("host", "chunk").join(repeated, "host")).mapInArrow(run, "page_id long, url string, text string, n_chars long, n_repeated long")
