"""Page boilerplate mixed with main content: host suffix arrays.

The token streams of a host's pages are concatenated, block by block, and a suffix array (sorted to
``REACH`` tokens by prefix doubling) finds the substrings of ``REACH`` or more tokens that stand in many
distinct pages; lines shorter than that are compared whole. What reaches a block's part of the limit is
counted in all blocks of the host, the counts are added up, and what stands in ``SHARE`` of the host's
pages (at least ``MIN_PAGES``) is boilerplate. A longer repeated substring is covered by the runs of
``REACH`` tokens in it, each of which stands in at least as many pages, so sorting further would cover
nothing else. Covered tokens are removed; what stays are each page's unique runs, from its headline on.

What the body holds besides unique runs is learnt from all pages, in one pass over them and two counts:

* A headline is the unique short line nearest before the page's first unique paragraph.
* A subhead is a repeated short line that a unique line follows ``SUBHEAD_SHARE`` of the times.
* A specification is a line of a label and a short value whose label stands next to lines of other labels
  ``SUBHEAD_SHARE`` of the times over all pages, as rows of a table do and lone links don't.

Unique lines that only accompany the body are dropped by their form: bylines, breadcrumbs, lead-ins to
other pages, teasers, readers' comments and bare titles. Neither the url nor the host's name counts.

A block holds about ``BLOCK_PAGES`` distinct pages or ``BLOCK_CHARS`` characters of them, so a hot host is
many blocks; pages fetched again count once. A host has at most ``REACH / SHARE`` runs per token of a page.
All hosts' runs go out together while they are at most ``BROADCAST_RUNS``; beyond, pages and runs meet by
host and block, with the same rows. Subheads and labels are joined, never collected. Defined results: pages
with an error status or with null or blank text have no line; repeated pages each give their lines; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtmill.session import checkpoint, fits, small

REACH = 12
SHARE = 0.02
MIN_PAGES = 3
BLOCK_PAGES = 256
BLOCK_CHARS = 4_000_000
COVERED = 0.8
#: A line is a subhead or a label if it stands as one at least this often, and is seen this often.
SUBHEAD_SHARE = 0.7
SUBHEAD_PAGES = 3
BROADCAST_RUNS = 2_000_000
CACHED_TOKENS = 200_000
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TAG = re.compile(r"<[^>]*>")
_BYLINE = re.compile(r"^\s*(?:by|words by|written by|posted by|von|par|por)\b.{2,80}?(?:comments?|min read|minutes?)\b", re.I)
_LEAD_IN = re.compile(r"^\s*(?:related|also read|read next|read also|see also|more on|up next|don't miss|recommended)\s*[:—-]", re.I)
_HANDLE = re.compile(r"^\s*[a-z_][\w.-]*\d\s*:\s|^\s*@\w+\s*:", re.I)
_TEASER = re.compile(r"\b(?:read more|continue reading|read the full review)\W*$", re.I)
_CRUMB = re.compile(r"[>›»](?<=\S\s.)\s\S")
#: Another page's title and the beginning of its text.
_QUOTED = re.compile(r"^(?:[^\W\d_a-zà-ÿ][\w'’&-]*\s+|&\s+){1,5}[^\W_a-zà-ÿ][\w'’-]*:\s+\S")
_LABEL = re.compile(r"^([^\W\d_]+(?:[ -][^\W\d_]+){0,2})\s*:\s+(\S.*)$")
_MARKUP = re.compile(r"\s*(?:<!--.*?-->\s*|<\?.*?\?>\s*)*<(?:!doctype|[a-z][a-z0-9-]*)[\s>/]", re.I | re.S)
_HIDING = re.compile(r"<(/?)(head|script|style|noscript)\b[^>]*>", re.I)
#: Cells of one row; shown with a colon between them.
_CELLS = re.compile(r"</(?:td|th|dt)>\s*<(?:td|th|dd)\b[^>]*>", re.I)


def visible(text: str) -> list[str]:
    """What each line shows; the head, scripts, styles and bare tags show nothing."""
    if not _MARKUP.match(text):
        return [(html.unescape(line) if "&" in line else line).strip() for line in text.split("\n")]
    out: list[str] = []
    hidden = ""
    for line in text.split("\n"):
        if "<" in line:
            shown, at = [], 0
            for m in _HIDING.finditer(line):
                tag = m.group(2).lower()
                if not hidden:
                    shown.append(line[at : m.start()])
                    if not m.group(1):
                        hidden = tag
                elif m.group(1) and tag == hidden:
                    hidden = ""
                at = m.end()
            if not hidden:
                shown.append(line[at:])
            line = _TAG.sub(" ", _CELLS.sub(": ", " ".join(shown)))
        elif hidden:
            line = ""
        out.append((html.unescape(line) if "&" in line else line).strip())
    return out


def tokens(line: str) -> list[str]:
    return _TOKEN.findall(line.lower())


_MIX = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i in range(64)], dtype=np.uint64)
_known: dict[str, int] = {}


def _codes(lines: list[list[str]]) -> list[np.ndarray]:
    if len(_known) > CACHED_TOKENS:
        _known.clear()
    for line in lines:
        for t in line:
            if t not in _known:
                _known[t] = xxhash.xxh64_intdigest(t)
    return [np.array([_known[t] for t in line], dtype=np.uint64) for line in lines]


def _hashes(stream: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` tokens from each position on; as signed 64 bits, as Spark has them."""
    n = len(stream) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        total += stream[i : i + n] * _MIX[i]
    return (total ^ (total >> np.uint64(29))).view(np.int64)


def _line_hash(codes: np.ndarray) -> int:
    """A hash of a line shorter than REACH."""
    total = np.uint64(0x5851F42D4C957F2D) ^ (codes * _MIX[32 : 32 + len(codes)]).sum(dtype=np.uint64)
    return int((total ^ (total >> np.uint64(29))).view(np.int64))


def suffix_groups(streams: list[np.ndarray], reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of concatenated streams sorted to ``reach`` tokens.

    Returns positions in suffix order, the group (equal first ``reach`` tokens) of each, and the stream
    each position is in. Suffixes shorter than ``reach`` within their stream are left out.
    """
    sizes = np.array([len(s) for s in streams])
    owner = np.repeat(np.arange(len(streams)), sizes)
    flat = np.concatenate(streams) if len(streams) else np.empty(0, np.uint64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # tokens from here to the stream's end
    rank = np.unique(flat, return_inverse=True)[1].astype(np.int64) + 1
    span = 1
    while span < reach:
        step = min(span, reach - span)
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        after[left <= step] = 0
        rank = np.unique(rank * (rank.max(initial=0) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        span += step
    whole = np.flatnonzero(left >= reach)
    order = whole[np.argsort(rank[whole], kind="stable")]
    return order, rank[order], owner[order]


def page_lines(text: str) -> tuple[list[str], list[np.ndarray]]:
    """What each line shows, and the codes of its tokens."""
    shown = visible(text)
    return shown, _codes([tokens(s) for s in shown])


def good_pages(pages: DataFrame) -> DataFrame:
    """(page_id, source, url, text) of pages with an unfailed fetch and some text."""
    fine = (F.coalesce("status", F.lit(200)) == 200) & (F.btrim("text", F.lit(" \t\r\n")) != "")
    return pages.filter(fine).select("page_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("url", F.lit("")).alias("url"), "text")


def in_blocks(pages: DataFrame) -> DataFrame:
    """``pages`` with page (a hash of what was fetched), host_pages, blocks, need and block."""
    each = pages.withColumn("page", F.xxhash64(F.when(F.col("url") != "", F.col("url")).otherwise(F.col("text"))))
    once = each.groupBy("source", "page").agg(F.max(F.length("text")).alias("chars"))
    hosts = once.groupBy("source").agg(F.count(F.lit(1)).alias("host_pages"), F.sum("chars").alias("chars"))
    blocks = F.greatest(F.ceil(F.col("host_pages") / BLOCK_PAGES), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    need = F.greatest(F.lit(MIN_PAGES), F.ceil(F.col("host_pages") * SHARE)).cast("bigint")
    hosts = hosts.select("source", "host_pages", blocks.alias("blocks"), need.alias("need"))
    return each.join(small(hosts), "source").withColumn("block", F.pmod("page", "blocks").cast("int"))


def repeated_runs(placed: DataFrame) -> DataFrame:
    """(source, blocks, run): for each host the hashes of its repeated token runs and short lines.

    A run in ``need`` of a host's pages stands in at least the block's part of ``need`` in one block or
    more. Runs that reach that part anywhere are counted again in every block of the host, so the sum
    compared with ``need`` leaves out no page.
    """
    dealt = placed.repartition("source", "block")
    # One text per page, the same whenever it is read; the partitioning serves this and both counts.
    dealt = dealt.groupBy("source", "block", "host_pages", "blocks", "need", "page").agg(F.min("text").alias("text"))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        streams, shorts = [], {}
        for i, text in enumerate(frame["text"]):
            _, codes = page_lines(text)
            streams.append(np.concatenate(codes) if codes else np.empty(0, np.uint64))
            for c in codes:
                if 0 < len(c) < REACH:
                    shorts.setdefault(_line_hash(c), set()).add(i)
        least = -(-int(frame["need"].iloc[0]) * len(frame) // int(frame["host_pages"].iloc[0]))
        order, group, owner = suffix_groups(streams)
        pairs = np.unique(np.stack([group, owner]), axis=1) if len(order) else np.empty((2, 0), np.int64)
        ids, pages_in = np.unique(pairs[0], return_counts=True)
        first = np.searchsorted(group, ids[pages_in >= least])
        flat = np.concatenate(streams)
        long = np.array([_hashes(flat[p : p + REACH], REACH)[0] for p in order[first]], dtype=np.int64)
        often = [(h, len(s)) for h, s in shorts.items() if len(s) >= least]
        run = np.concatenate([long, np.array([h for h, _ in often], dtype=np.int64)])
        n = np.concatenate([pages_in[pages_in >= least], np.array([c for _, c in often], dtype=np.int64)])
        return pd.DataFrame({"source": frame["source"].iloc[0], "blocks": frame["blocks"].iloc[0], "need": frame["need"].iloc[0], "run": run, "pages": n})

    def recount(frame: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
        runs = np.sort(np.asarray(sought["runs"].iloc[0] if len(sought) else [], dtype=np.int64))
        n = np.zeros(len(runs), dtype=np.int64)
        for text in frame["text"] if len(runs) else ():
            _, codes = page_lines(text)
            shorts = np.array([_line_hash(c) for c in codes if 0 < len(c) < REACH], dtype=np.int64)
            found = np.unique(np.concatenate([_hashes(np.concatenate(codes), REACH), shorts]))
            at = np.minimum(np.searchsorted(runs, found), len(runs) - 1)
            n[at[runs[at] == found]] += 1
        has = n > 0
        first = frame.iloc[0] if len(frame) else {"source": "", "blocks": 0, "need": 0}
        return pd.DataFrame({"source": first["source"], "blocks": first["blocks"], "need": first["need"], "run": runs[has], "pages": n[has]})

    counted = dealt.groupBy("source", "block").applyInPandas(count, "source string, blocks int, need bigint, run bigint, pages bigint")
    counted = checkpoint(counted)  # parsed once for both uses
    whole = counted.filter("blocks = 1").select("source", "blocks", "need", "run", "pages")
    sought = counted.filter("blocks > 1").groupBy("source", "blocks").agg(F.collect_set("run").alias("runs"))
    sought = sought.select("source", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "runs")
    parts = dealt.filter("blocks > 1").groupBy("source", "block").cogroup(sought.groupBy("source", "block")).applyInPandas(recount, "source string, blocks int, need bigint, run bigint, pages bigint")
    total = whole.unionByName(parts.groupBy("source", "blocks", "need", "run").agg(F.sum("pages").alias("pages")))
    return total.filter("pages >= need").select("source", "blocks", "run")


def _among(found: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which of ``found`` are in the ascending ``runs``."""
    if not len(runs):
        return np.zeros(len(found), dtype=bool)
    return runs[np.minimum(np.searchsorted(runs, found), len(runs) - 1)] == found


def _covered(codes: list[np.ndarray], runs: np.ndarray) -> np.ndarray:
    """The share of each line's tokens that repeated runs cover; ``runs`` ascend."""
    sizes = np.array([len(c) for c in codes])
    flat = np.concatenate(codes) if len(codes) else np.empty(0, np.uint64)
    at = np.flatnonzero(_among(_hashes(flat, REACH), runs))
    mark = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, np.minimum(at + REACH, len(flat)), -1)
    inside = np.cumsum(mark[:-1]) > 0
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(inside)])
    share = np.divide(total[ends] - total[ends - sizes], sizes, out=np.zeros(len(sizes)), where=sizes > 0)
    short = np.flatnonzero((sizes > 0) & (sizes < REACH))
    whole = _among(np.array([_line_hash(codes[i]) for i in short], dtype=np.int64), runs)
    share[short[whole]] = 1.0
    return share


def _aside(line: str) -> bool:
    """Whether a line has the form of something that only accompanies the body."""
    if _BYLINE.match(line) or _LEAD_IN.match(line) or _HANDLE.match(line) or _QUOTED.match(line) or _title_like(line):
        return True
    return bool((("read" in line or "Read" in line) and _TEASER.search(line)) or _CRUMB.search(line))


def _title_like(line: str) -> bool:
    """A short line of capitalised words, such as another product's name."""
    if line[-1] in ".!?:;," or line.count(" ") > 24:
        return False
    parts = line.split()
    letters = [p for p in parts if p[0].isalpha()]
    return 2 <= len(parts) <= 8 and len(letters) >= 2 and all(p[0].isupper() for p in letters)


def _headline(shown: list[str], sizes: list[int], prose: list[bool], unique: list[bool]) -> int | None:
    """The unique short line nearest before the first unique paragraph, or that paragraph's own line."""
    first = next((i for least in (REACH, REACH // 2) for i, n in enumerate(sizes) if prose[i] and n >= least), None)
    if first is None:
        return None
    for i in range(first - 1, -1, -1):
        line = shown[i]
        if unique[i] and not (_BYLINE.search(line) or _LEAD_IN.search(line) or _CRUMB.search(line)) and line[-1] not in ".,;" and not line[0].islower():
            return i
    return first


def _label(line: str) -> str | None:
    """The label of a line of a label and a short value."""
    m = _LABEL.match(line)
    return " ".join(tokens(m.group(1))) if m and len(tokens(m.group(2))) <= REACH and not m.group(2).endswith((".", "!", "?")) else None


def page_rows(text: str, runs: np.ndarray) -> list[tuple]:
    """(line_no, line, sure, after, head, followed, label, beside, last) of a page's lines with words.

    ``sure`` lines are of the body; ``head`` and ``label`` are what the line would be a subhead or a
    specification as; ``after`` tells whether it stands after the headline, ``last`` the last line that
    belongs to the body unless a subhead, ``followed`` and ``beside`` what speaks for the two.
    """
    shown, codes = page_lines(text)
    share = _covered(codes, runs)
    sizes = [len(c) for c in codes]
    unique = [bool(n) and s < COVERED for n, s in zip(sizes, share, strict=True)]
    prose = [u and not _aside(line) for u, line in zip(unique, shown, strict=True)]
    start = _headline(shown, sizes, prose, unique)
    at = [i for i, n in enumerate(sizes) if n]
    if not at:
        return []
    labels = {i: label for i in at if (label := _label(shown[i]))}
    near = {i: [j for j in (before, after) if j is not None] for before, i, after in zip([None, *at[:-1]], at, [*at[1:], None], strict=True)}
    beside = {i: any(j in labels and labels[j] != labels[i] for j in near[i]) for i in labels}
    after = {i: start is not None and i >= start for i in at}
    sure = {i: after[i] and (i == start or prose[i]) for i in at}
    last = max((i for i in at if sure[i] or (after[i] and beside.get(i))), default=-1)
    rows = []
    for i in at:
        head = " ".join(tokens(shown[i])) if not unique[i] and sizes[i] < REACH and i not in beside else None
        followed = any(j > i and sure[j] for j in near[i])
        if sure[i] or head or i in labels:
            rows.append((i, shown[i], bool(sure[i]), after[i], head, followed, labels.get(i), beside.get(i, False), last))
    return rows


ROWS = "line_no int, line string, sure boolean, after boolean, head string, followed boolean, label string, beside boolean, last int"


def _rows_of(frame: pd.DataFrame, runs_of) -> pd.DataFrame:
    rows = [(page, *row) for page, text, runs in zip(frame["page_id"], frame["text"], runs_of, strict=True) for row in page_rows(text, runs)]
    out = pd.DataFrame(rows, columns=["page_id", *(c.split()[0] for c in ROWS.split(", "))])
    return out.astype({"line_no": "int32", "sure": bool, "after": bool, "followed": bool, "beside": bool, "last": "int32"})


def line_rows(pages: DataFrame, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """``page_rows`` of all good pages."""
    placed = in_blocks(good_pages(pages))
    runs = checkpoint(repeated_runs(placed))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, {ROWS}"
    none = np.empty(0, dtype=np.int64)
    if fits(runs, broadcast_runs):
        found = runs.select("source", "run").toPandas()  # at most `broadcast_runs` rows
        shared = pages.sparkSession.sparkContext.broadcast({s: np.sort(r.to_numpy(dtype=np.int64)) for s, r in found.groupby("source")["run"]})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield _rows_of(batch, [shared.value.get(s, none) for s in batch["source"]])

        return good_pages(pages).select("page_id", "source", "text").mapInPandas(run, schema)

    def meet(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        mine = np.sort(own["run"].to_numpy(dtype=np.int64)) if len(own) else none
        return _rows_of(frame, [mine] * len(frame))

    everywhere = runs.select("source", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "run")
    return placed.select("page_id", "source", "block", "text").groupBy("source", "block").cogroup(everywhere.groupBy("source", "block")).applyInPandas(meet, schema)


def _often(rows: DataFrame, key: str, speaks: str) -> DataFrame:
    """(key): the keys for which ``speaks`` holds often enough."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(speaks).alias("yes"))
    return counts.filter((F.col("n") >= SUBHEAD_PAGES) & (F.col("yes") >= SUBHEAD_SHARE * F.col("n"))).select(key)


def body_lines(pages: DataFrame, with_text: bool = True, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """(page_id, line_no, line): the lines of each page's main body; numbers start at 0, tags are taken out.

    Without ``with_text`` the lines are null, which spares writing them.
    """
    made = line_rows(pages, broadcast_runs)
    rows = checkpoint(made if with_text else made.withColumn("line", F.lit(None).cast("string")))  # read for two counts and the result
    sure = rows.filter("sure")
    heads = rows.filter("not sure and after and head is not null and line_no < last").join(small(_often(rows, "head", "followed")), "head", "left_semi")
    specs = rows.filter("not sure and after and label is not null").join(small(_often(rows, "label", "beside")), "label", "left_semi")
    columns = ["page_id", "line_no", "line"]
    return sure.select(columns).unionByName(heads.select(columns)).unionByName(specs.select(columns))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): each page reduced to its main body; pages without one are left out."""
    lines = body_lines(pages).groupBy("page_id").agg(F.sort_array(F.collect_set(F.struct("line_no", "line"))).alias("lines"))
    return lines.select("page_id", F.array_join(F.transform("lines", lambda s: s["line"]), "\n").alias("text"))
