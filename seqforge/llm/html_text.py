"""Main text of HTML pages, with suffix arrays per host for what markup doesn't tell.

A page is parsed once and cut into blocks, each with its region. Blocks in containers that name themselves as menus,
headers, footers, sidebars, notices, adverts, forms or comments are left out. The tokens of a page are streams of its host,
one for each stretch of blocks of one region, so no run goes over a region's border; prose of declared articles is none of
them, since articles quote the same passages. What MIN_PAGES pages of different
content share on a host, as runs of RUN tokens or more, is boilerplate, and so are blocks of SHORT tokens or more outside
of declared articles that as many pages have whole. It goes wherever markup doesn't vouch for the text: from all of a page
without a declared article, and within one from blocks that stand in no element of prose (PROSE), such as a bare div.
Paragraphs, headings and lists of a declared article stay, shared or not. Unique runs stay. A declared article of which
runs cover COVERED or more is a copy of others and stays whole; text beside a declared article is kept where more of it is
unique than of the article, which then is a teaser. Content is the text of the declared articles, or else of all blocks
that no container names.

Counts are those of the whole host, however large. Of each run of RUN tokens the anchor, its GRAM tokens of the least
hash, is counted by host; equal runs have equal anchors. Passages around the anchors that MIN_PAGES contents share are
dealt by host and anchor into lots of about SEGMENTS, so that equal runs meet in one lot, and sorted there as a suffix
array, which tells the runs that are shared. Their hashes go back to the pages. Of equal passages MIN_PAGES contents a
batch are passed on, which is all that the counts ask for, so no hot passage fills a task.

The suffixes are sorted by their first DEPTH tokens, which orders all repeated substrings of up to that length; longer
repeats are covered by overlapping ones.

Defined cases: a null or empty html has the empty text; page ids and urls may be null or repeated, rows are judged one
by one; a page cut off anywhere yields what was there, and a container of other media that is never closed hides
nothing; pages of any length are parsed whole; equal runs and anchors are one, so ties need no rule; an empty table
gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, map_batches, table, text_or_empty
from .shingles import word_spans

RUN, GRAM, SHORT, DEPTH, MIN_PAGES, SEGMENTS = 12, 5, 5, 16, 3, 10_000
COVERED = 0.5
#: Pages whose tokens are held at a time, at most.
SLICE = 500
BROADCAST_ROWS = 1_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|<[!?][^>]*+>|<[^<]*\Z", re.S)
_MARK = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")
_REGION = {"m": "main", "b": "bare", "c": "chrome", "o": "open"}
#: Their content isn't text.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title", "head"}
#: Of these, what hides the rest of a page that doesn't close them.
UNSEEN = {"script", "style", "head"}
CHROME = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu"}
MAIN = {"article", "main"}
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption dialog menu".split())
#: What vouches for the text of a declared article.
PROSE = set("article main p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption summary legend address".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SPACED = {"br", "td", "th"}
#: Words of class, id and role that name what isn't the article.
NAMES = set("ad ads advert adverts advertisement banner sponsor sponsored cookie cookies consent gdpr popup modal nav navbar navigation menu breadcrumb breadcrumbs sidebar masthead contentinfo complementary comment comments disqus reply replies newsletter subscribe signup login pagination toolbar".split())
#: Such words that say nothing beside one of TEXT in a class of several words.
WEAK_NAMES = set("promo promotion notice widget footer header share sharing social related recommended search".split())
TEXT = {"content", "text", "body", "story"}


def names_chrome(marks: str) -> bool:
    """Whether one of the classes or ids, each of one or more words, names what isn't the article."""
    return any(words & NAMES or (words & WEAK_NAMES and not words & TEXT) for c in marks.lower().split() for words in [set(_WORD.findall(c))])


def blocks_of(html: str | None) -> list[tuple[str, str]]:
    """(region, text) of each block with text; region: main, bare (main, but in no element of prose), chrome or open."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # tag, region
    parts: list[str] = []
    html = html or ""

    def close() -> None:
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            region = stack[-1][1] if stack else "open"
            out.append(("bare" if region == "main" and stack[-1][0] not in PROSE else region, text))

    ends: dict[str, int] = {}  # where the last end tag of a name begins

    def closed_after(name: str, place: int) -> bool:
        if name not in ends:
            ends[name] = html.lower().rfind(f"</{name}")
        return ends[name] >= place

    at, skip = 0, ""
    for m in _TOKEN.finditer(html):
        tag = m[2]
        name = tag.lower() if tag else ""
        if skip:
            if name == skip and m[1]:
                skip, at = "", m.end()
            elif skip == "head" and name == "body":  # a head that was not closed
                skip = ""
            else:
                continue
            if m[1]:
                continue
        elif m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        if not name:
            continue
        if name in SPACED:
            parts.append(" ")
        if name not in BLOCK and name not in RAW and name not in CHROME:
            continue
        if m[1]:
            if name in BLOCK or name in CHROME:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in RAW:
            if not m[3].endswith("/") and (name in UNSEEN or closed_after(name, m.end())):
                skip = name
            continue
        close()
        if name in VOID:
            continue
        while stack and stack[-1][0] in {"p", "li", "dt", "dd"} and (stack[-1][0] == "p" or name == stack[-1][0]):
            stack.pop()
        region = stack[-1][1] if stack else "open"
        marks = {k.lower(): (a or b or c) for k, a, b, c in _MARK.findall(m[3])} if "=" in m[3] else {}
        if region != "chrome":
            if name in CHROME or (name == "header" and region != "main") or any(map(names_chrome, marks.values())) or (m[3] and _HIDDEN.search(m[3])):
                region = "chrome"
            elif name in MAIN or marks.get("role", "").lower() == "main" or marks.get("itemprop", "") == "articleBody":
                region = "main"
        stack.append((name, region))
    if not skip and at < len(html):
        parts.append(html[at:])
    close()
    return out


def shared_starts(streams: list[list[str]], owner: np.ndarray) -> list[np.ndarray]:
    """Of each stream's tokens: whether RUN tokens begin there that streams of MIN_PAGES owners (numbers from 0) share."""
    lengths = np.array([len(s) + 1 for s in streams], np.int64)
    ids: dict[str, int] = {}
    text = np.concatenate([np.array([ids.setdefault(t, len(ids)) for t in s] + [-1 - k], np.int64) for k, s in enumerate(streams)])
    page = np.repeat(owner, lengths)
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1]
    step, ranks = 1, {1: rank}
    while step < DEPTH:  # prefix doubling: ranks by 2, 4, 8, ... tokens
        ahead = np.concatenate([rank[step:], np.full(min(step, n), -1)])[:n]
        rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1]
        step *= 2
        ranks[step] = rank
    order = np.argsort(rank, kind="stable")  # the suffix array
    # neighbours' common prefix, up to DEPTH, from the ranks of powers of two
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for s in sorted(ranks, reverse=True):
        ok = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[ok] = ranks[s][a[ok]] == ranks[s][b[ok]]
        common += same * s
        a, b = a + same * s, b + same * s
    common = np.minimum(common, DEPTH)
    group = np.cumsum(np.concatenate([[True], common < RUN]))  # suffixes that share RUN tokens
    pairs = np.unique(group * len(streams) + page[order])
    pages = np.bincount(pairs // len(streams), minlength=group[-1] + 1)
    hit = np.zeros(n, bool)
    hit[order[pages[group] >= MIN_PAGES]] = True
    starts = np.cumsum(lengths) - lengths
    return [hit[s : s + m - 1] for s, m in zip(starts, lengths)]


def spread(starts: np.ndarray) -> np.ndarray:
    """Whether tokens lie in one of the runs of RUN tokens that begin at starts."""
    mark = np.zeros(len(starts) + RUN, np.int64)
    at = np.flatnonzero(starts)
    mark[at] += 1
    mark[at + RUN] -= 1
    return np.cumsum(mark)[: len(starts)] > 0


def covered_tokens(streams: list[list[str]]) -> list[np.ndarray]:
    """Of each page's tokens: whether they lie in a substring of RUN tokens or more that MIN_PAGES pages share."""
    return [spread(x) for x in shared_starts(streams, np.arange(len(streams)))]


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


def _mixed(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return code ^ (code >> np.uint64(29))


def window_hashes(h: np.ndarray, seed: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the size tokens from each position, from the tokens' hashes and a seed by position."""
    n = max(0, len(h) - size + 1)
    code = seed[:n].copy()
    for k in range(size):
        code = code * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return _mixed(code)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, key (of the row), regions (a letter for each block) and text (a line for each block)."""
    names = ["page_id", "url", "host", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "html"):
            blocks = [blocks_of(x.as_py()) for x in b.column("html")]
            regions, texts = (pa.array([join.join(x[i][:n] for x in page) for page in blocks], pa.string()) for join, i, n in (("", 0, 1), ("\n", 1, None)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), regions, texts], names=[*names, "regions", "text"])

    keyed = pages.select("page_id", "url", _host("url").alias("host"), F.xxhash64("page_id", "url", "html").alias("key"), text_or_empty("html").alias("html"))
    return map_batches(keyed, run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, host string, key long, regions string, text string")


class Slice:
    """Blocks and tokens of some parsed pages, with hashes that are the same everywhere: run and anchor at each position
    (ok: where a run lies in one region of a page), and the hash of each block outside of declared articles."""

    def __init__(self, hosts: list[str], regions: list[str], texts: list[str]):
        self.blocks = [[(_REGION[r], t) for r, t in zip(x, text.split("\n"))] for x, text in zip(regions, texts)]
        places, short, contents = [], [], []
        for p, blocks in enumerate(self.blocks):
            wanted = ("main", "bare") if any(r in ("main", "bare") for r, _ in blocks) else ("open",)
            contents.append("\n".join(t for r, t in blocks if r in wanted))
            for i, (region, text) in enumerate(blocks):
                if region == "open" and text.count(" ") >= SHORT - 1:
                    places.append((p, i))
                    short.append(text)
        h, self.page, self.raw, self.starts, self.stops = word_spans([t.encode("utf-8", "surrogatepass") for t in texts])
        self.tokens = len(h)
        self.ends = np.cumsum(np.bincount(self.page, minlength=len(texts)))
        self.content = _hashes(contents).view(np.int64)
        seeds = _hashes(hosts)
        n = max(0, len(h) - RUN + 1)
        seed = seeds[self.page]
        self.run = window_hashes(h, seed, RUN)
        letters = [r or "-" for r in regions]  # a page without blocks has an empty line of text
        of = np.repeat(np.arange(len(letters)), [len(x) for x in letters])
        kind = np.frombuffer("".join(letters).encode(), np.uint8)
        border = np.ones(len(kind), bool)
        border[1:] = (kind[1:] != kind[:-1]) | (of[1:] != of[:-1])
        block = np.searchsorted(np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 10), self.starts) + self.page
        stretch = np.cumsum(border)[block]
        self.ok = (stretch[:n] == stretch[RUN - 1 : RUN - 1 + n]) & (kind[block][:n] != ord("m"))
        gram = window_hashes(h, seed, GRAM)
        self.anchor = np.minimum.reduce([gram[k : k + n] for k in range(RUN - GRAM + 1)]) if n else self.run
        self.places = places
        self.block = _mixed(_hashes(short) + seeds[[p for p, _ in places]] * np.uint64(3)) if places else np.zeros(0, np.uint64)

    def words(self, first: int, last: int) -> str:
        """The tokens from first to last, one space between two."""
        return self.raw[self.starts[first] : self.stops[last]].decode("utf-8", "surrogatepass").replace("\n", " ")

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(page, hash) of anchors and blocks."""
        page = np.concatenate([self.page[: len(self.ok)][self.ok], np.array([p for p, _ in self.places], np.int64)])
        return page, np.concatenate([self.anchor[self.ok], self.block]).view(np.int64)


def _slices(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    for part in chunks(iter([b]), "text", most=SLICE):
        yield part, Slice(*(part.column(c).to_pylist() for c in ("host", "regions", "text")))


def _few(frame: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """MIN_PAGES contents of each value of by."""
    frame = frame.drop_duplicates([*by, "content"])
    return frame[frame.groupby(by, sort=False).cumcount() < MIN_PAGES]


def _among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of values are in found, which is sorted."""
    if not len(found):
        return np.zeros(len(values), bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


def _several(rows: DataFrame, by: str) -> DataFrame:
    """The values of by that MIN_PAGES contents have."""
    return rows.select(by, "content").repartition(by).distinct().groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES).select(by)


def _tell(keyed: DataFrame, wanted: DataFrame, runs: bool):
    """keyed with found, and a function of a batch's found that gives the sorted hashes of wanted among those of its
    pages: all of them, broadcast, where they are few, else those that a join by hash brings to the pages."""
    if wanted.count() <= BROADCAST_ROWS:
        all_of = keyed.sparkSession.sparkContext.broadcast(np.unique(wanted.toPandas()["hash"].to_numpy(np.int64)))
        return keyed.withColumn("found", F.lit(None).cast("array<bigint>")), lambda found: all_of.value

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, s in _slices(b):
                page, h = s.pairs()
                if runs:
                    page, h = np.concatenate([page, s.page[: len(s.ok)][s.ok]]), np.concatenate([h, s.run[s.ok].view(np.int64)])
                key = part.column("key").to_numpy()[page]
                own = pd.DataFrame({"key": key, "hash": h}).drop_duplicates()
                yield pa.RecordBatch.from_pandas(own, preserve_index=False)

    asked = map_batches(keyed, ask, "key long, hash long").distinct()
    found = asked.join(wanted, "hash").groupBy("key").agg(F.collect_list("hash").alias("found"))
    return keyed.join(found, "key", "left"), lambda found: np.unique(found.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def boilerplate(keyed: DataFrame) -> DataFrame:
    """hash: of the runs that MIN_PAGES contents of a host share, and of their anchors and of blocks that they have whole,
    from keyed (host, key, regions, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, s in _slices(b):
                page, h = s.pairs()
                yield pa.RecordBatch.from_pandas(_few(pd.DataFrame({"hash": h, "content": s.content[page]}), ["hash"]), preserve_index=False)

    first = cut(_several(map_batches(keyed, count, "hash long, content long"), "hash"), "anchors")
    asked, known = _tell(keyed, first, False)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, s in _slices(b):
                n = len(s.ok)
                at = np.flatnonzero(s.ok & _among(s.anchor.view(np.int64), known(part.column("found"))))
                page, anchor = s.page[:n][at], s.anchor[at]
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) > 1) | (page[1:] != page[:-1]) | (anchor[1:] != anchor[:-1])
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(at)) - 1
                hosts = part.column("host").to_pylist()
                texts = [s.words(at[i], at[j] + RUN - 1) for i, j in zip(begin, last)]
                own = pd.DataFrame({"host": [hosts[p] for p in page[begin]], "anchor": anchor[begin].view(np.int64), "content": s.content[page[begin]], "text": texts})
                own = _few(own, ["anchor", "text"]).astype({"host": object, "text": object})
                kinds = [("host", pa.string()), ("anchor", pa.int64()), ("content", pa.int64()), ("text", pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(own[c].tolist(), k) for c, k in kinds], names=[c for c, _ in kinds])

    found = cut(map_batches(asked, passages, "host string, anchor long, content long, text string"), "passages", "zstd")
    sizes = found.groupBy("host").agg(F.ceil(F.count("*") / SEGMENTS).alias("lots"))
    lots = found.join(_small(sizes), "host").withColumn("lot", F.pmod("anchor", "lots"))

    def sort(key: tuple, lot: pd.DataFrame) -> pd.DataFrame:
        streams = [t.split() for t in lot["text"]]
        starts = shared_starts(streams, np.unique(lot["content"], return_inverse=True)[1])
        out = []
        for words, hit in zip(streams, starts):
            if hit.any():
                seed = np.repeat(_hashes([key[0]]), len(words))
                out.append(window_hashes(word_spans([" ".join(words).encode("utf-8", "surrogatepass")])[0], seed, RUN)[hit[: len(words) - RUN + 1]].view(np.int64))
        return pd.DataFrame({"hash": np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)})

    return cut(lots.groupBy("host", "lot").applyInPandas(sort, "hash long").union(first), "runs").distinct()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def main_text(blocks: list[tuple[str, str]], covered: np.ndarray, shared: set[int]) -> str:
    """The text of a page, from its blocks, which of its tokens lie in shared runs, and which blocks are shared whole."""
    if not covered.any() and not shared:
        sizes = {r: sum(t.count(" ") + 1 for x, t in blocks if ("main" if x == "bare" else x) == r) for r in ("main", "open")}
        return "\n".join(t for r, t in blocks if r in ("main", "bare") or (r == "open" and sizes["open"] > sizes["main"]))
    at, parts = 0, {"main": [], "open": []}
    for i, (region, text) in enumerate(blocks):
        words = text.split(" ")
        gone = covered[at : at + len(words)]
        at += len(words)
        if region != "chrome":
            own = [] if i in shared else [w for w, g in zip(words, gone) if not g]
            parts["main" if region == "bare" else region].append((text, len(words), own))
    sizes = {r: sum(n for _, n, _ in p) for r, p in parts.items()}
    unique = {r: sum(len(own) for *_, own in p) for r, p in parts.items()}
    copy = sizes["main"] > 0 and sizes["main"] - unique["main"] >= COVERED * sizes["main"]
    teaser = unique["open"] > (sizes["main"] if copy else unique["main"])
    kept = []
    at = {"main": iter(parts["main"]), "open": iter(parts["open"])}
    for region, _ in blocks:
        if region in ("main", "bare"):
            text, _, own = next(at["main"])
            kept.append(text if copy or region == "main" else " ".join(own))
        elif region == "open":
            _, _, own = next(at["open"])
            if not sizes["main"] or teaser:
                kept.append(" ".join(own))
    return "\n".join(t for t in kept if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each row of pages (page_id, url, html)."""
    keyed = cut(parsed(pages), "parsed", "zstd")
    asked, known = _tell(keyed, boilerplate(keyed.select("host", "key", "regions", "text")), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, s in _slices(b):
                hashes = known(part.column("found"))
                starts = np.zeros(s.tokens, bool)
                starts[: len(s.ok)] = s.ok & _among(s.run.view(np.int64), hashes)
                covered = spread(starts)
                shared: dict[int, set[int]] = {}
                for (p, i), hit in zip(s.places, _among(s.block.view(np.int64), hashes)):
                    if hit:
                        shared.setdefault(p, set()).add(i)
                begin = np.append(0, s.ends)
                texts = [main_text(x, covered[begin[p] : begin[p + 1]], shared.get(p, set())) for p, x in enumerate(s.blocks)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return map_batches(asked.select("page_id", "url", "regions", "text", "host", "found"), run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op4_html_text": op4_html_text}
ORACLES: dict[str, str] = {}
