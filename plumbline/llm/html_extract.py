"""HTML main text by consensus host paths.

Each page is parsed once into its text blocks and containers. A container's score is its text that is
not in links, text of containers inside counting a tenth less for each level; text in elements
whose class words speak of boilerplate counts little. Each page votes for the generalised tag-class path of
its best container, Spark sums the votes of a host, and each page is then re-extracted with its
host's winning path (its own best container where the page has no such path). What class words mark
inside the chosen container is left out; the chosen container itself is never dropped by them.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: Elements whose content is no markup; the parser goes on after their end tag.
_RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
#: Elements whose text is never part of an article.
_HARD = frozenset("nav footer aside dialog menu head svg canvas object select button template audio video datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split()
)
_CONTAINER = frozenset("article main section div td body blockquote center form fieldset".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Class words that speak of boilerplate, those that do so only without a content word, and content words.
_NOISE = frozenset(
    "comment comments commentlist disqus respond reply replies ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "related recommended share sharing social newsletter subscribe signup cookie cookies consent popup modal paywall breadcrumb breadcrumbs "
    "pagination pager sidebar nav navbar navigation menu footer".split()
)
_WEAK = frozenset("header masthead topbar banner notice notices alert widget toolbar search login skip legal copyright overlay rail gdpr form".split())
_CONTENT = frozenset("article post entry content story main body text".split())
#: Words that turn a class name into a statement about another element: no-sidebar, comments-open.
_ABOUT = frozenset("no has with without hide show is open closed off on enabled disabled left right layout".split())
#: What the text of marked elements counts, what a level counts, and the bonus of semantic elements.
NOISE_WEIGHT, LEVEL, BONUS = 0.05, 0.9, 1.3
#: Steps of a path that are kept; what is above them is a digest.
DEPTH = 24

_OPEN = re.compile(r"<(?:!--|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_ATTR = re.compile(r"[\s/]*(?:(>)|([^\s/>=][^\s/>=]*|=)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?)")


def _tokens(page: str):
    """(kind, value, attributes) in one pass: text, start, end. A tag that never ends takes the rest of the page."""
    at, n = 0, len(page)
    while at < n:
        m = _OPEN.search(page, at)
        if m is None:
            yield "text", page[at:], None
            return
        if m.start() > at:
            yield "text", page[at : m.start()], None
        at = m.end()
        if m[3] is None:
            end = page.find(">" if m[1] else "-->", at)
            at = n if end < 0 else end + (1 if m[1] else 3)
            continue
        name, attrs = m[3].lower(), {}
        while (a := _ATTR.match(page, at)) and not a[1]:
            at = a.end()
            attrs.setdefault(a[2].lower(), a[3] or a[4] or a[5] or "")
        if a is None:
            return
        at = a.end()
        if m[2]:
            yield "end", name, None
            continue
        yield "start", name, attrs
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = n if end is None else end.start()


def _words(value: str) -> list[str]:
    return [re.sub(r"\d+$", "", w) for w in re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower().replace("-", " ").replace("_", " ").split()]


def _marked(name: str, attrs: dict) -> bool:
    """Whether an element's names speak of boilerplate and none of them of content."""
    noise = weak = content = False
    for value in [*attrs.get("class", "").split(), attrs.get("id", ""), attrs.get("role", "")]:
        ws = set(_words(value))
        if ws & _ABOUT:
            continue
        noise |= bool(ws & _NOISE)
        weak |= bool(ws & _WEAK)
        content |= bool(ws & _CONTENT) and not ws & _NOISE
    if name in ("body", "html", "article", "main"):
        return noise and not content and name == "article"
    return (noise or weak) and not content


def _step(name: str, attrs: dict) -> str:
    classes = sorted({re.sub(r"\d+", "", c.lower()) for c in attrs.get("class", "").split()} - {""})
    return name + "".join(f".{c}" for c in classes)


def parse(page: str) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, int, float]]]:
    """(blocks, containers): (text, depth of the innermost marked element around it, 0 without one) and
    (path, depth, first block, end, score), the innermost container first."""
    blocks: list[tuple[str, int]] = []
    found: list[tuple[str, int, int, int, float]] = []
    # open elements: name, path, hard, marked depth, first block, own score
    stack: list[list] = []
    open_: Counter = Counter()
    text: list[tuple[str, bool]] = []
    linked, inline = 0, 0

    def flush() -> None:
        nonlocal linked
        clear = " ".join("".join(s for s, noise in text if not noise).split())
        line = clear or " ".join("".join(s for s, _ in text).split())
        if line and stack:
            depth = len(stack) if not clear else stack[-1][3]
            owner = next((e for e in reversed(stack) if e[0] in _CONTAINER), stack[0])
            owner[5] += max(0, len(line) - linked) * (NOISE_WEIGHT if depth else 1.0)
            blocks.append((line, depth))
        elif line:
            blocks.append((line, 0))
        text.clear()
        linked = 0

    def pop() -> None:
        nonlocal inline
        name, path, hard, _, first, score = stack.pop()
        open_[name] -= 1
        inline -= path is None and score == "noise"
        if name in _BLOCK and name in _CONTAINER:
            if not hard and len(blocks) > first and score > 0:
                bonus = BONUS if name in ("article", "main") else 1.0
                found.append((path, len(stack) + 1, first, len(blocks), score * bonus))
            if owner := next((e for e in reversed(stack) if e[0] in _CONTAINER), None):
                owner[5] += LEVEL * score

    for kind, value, attrs in _tokens(page):
        if kind == "text":
            if not (stack and stack[-1][2]):
                s = html.unescape(value) if "&" in value else value
                text.append((s, inline > 0))
                if open_["a"] > 0:
                    linked += len(s)
            continue
        name = value
        if kind == "end":
            if name == "br":
                text.append((" ", False))
            if name in _BLOCK:
                flush()
            if open_[name] > 0:
                k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                if name in _BLOCK or not any(e[0] in _BLOCK for e in stack[k + 1 :]):
                    while len(stack) > k:
                        pop()
            continue
        if name in _BLOCK:
            flush()
            shut = _CLOSES.get(name, set()) | {"p"}
            k = len(stack)
            while k and (stack[k - 1][0] in shut or stack[k - 1][0] not in _BLOCK):
                k -= 1
            if any(e[0] in shut for e in stack[k:]):
                while len(stack) > k:
                    pop()
        elif name == "br":
            text.append((" ", False))
        if name in _VOID:
            continue
        up = stack[-1] if stack else None
        hidden = bool(attrs) and ("hidden" in attrs or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""))))
        in_article = open_["article"] > 0 or open_["main"] > 0
        hard = bool(up and up[2]) or hidden or name in _HARD or name in _RAW or name == "header" and not in_article
        marked = name == "form" or bool(attrs) and _marked(name, attrs)
        depth = len(stack) + 1 if marked and name in _BLOCK else up[3] if up else 0
        path, score = None, 0.0
        if name in _CONTAINER:
            above = next((e[1] for e in reversed(stack) if e[1] is not None), None)
            path = _step(name, attrs or {}) if above is None else f"{above}>{_step(name, attrs or {})}"
            if path.count(">") >= DEPTH:
                head, _, tail = path.partition(">")
                nxt, _, rest = tail.partition(">")
                path = f"#{hashlib.md5(f'{head}>{nxt}'.encode()).hexdigest()[:12]}>{rest}"
        elif marked and name not in _BLOCK:
            score, inline = "noise", inline + 1
        stack.append([name, path, hard, depth, len(blocks), score])
        open_[name] += 1
    flush()
    while stack:
        pop()
    if blocks and not found:
        found.append(("", 0, 0, len(blocks), 0.5 * sum(len(b) for b, d in blocks)))
    return blocks, found


def best(found: list[tuple[str, int, int, int, float]]) -> tuple[str, int, int, int, float] | None:
    """The container of the highest score; the one closed first (the innermost) of equals."""
    return max(found, key=lambda c: c[4], default=None)


PARSED = (
    "page_id long, url string, host string, blocks array<struct<text:string,noise:int>>, "
    "ranges array<struct<path:string,depth:int,first:int,end:int>>, own string, score double"
)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url if isinstance(url, str) else "")
    return re.sub(r"^(?:www|m)\.", "", m[1].lower()) if m else ""


def parse_pages(pages: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for page, url, text in zip(b["page_id"], b["url"], b["html"], strict=True):
                blocks, found = parse(text if isinstance(text, str) else "")
                top = best(found)
                ranges = [{"path": p, "depth": d, "first": i, "end": j} for p, d, i, j, _ in found]
                lines = [{"text": t, "noise": d} for t, d in blocks]
                rows.append((page, url, host_of(url), lines, ranges, top[0] if top else None, float(top[4]) if top else 0.0))
            yield pd.DataFrame(rows, columns=["page_id", "url", "host", "blocks", "ranges", "own", "score"]).astype({"page_id": "Int64"})

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, PARSED)


#: Bytes of the hosts' winning paths up to which they are broadcast.
BROADCAST_BYTES = 32_000_000


def winners(parsed: DataFrame) -> DataFrame:
    """(host, winner): the path with most votes; a page's vote weighs at most 1. Ties go to the first path.

    Partial sums are made before the votes of a host meet, and again before its paths do."""
    votes = parsed.where("own IS NOT NULL").groupBy("host", "own").agg(F.sum(F.least(F.lit(1.0), F.col("score") / 200)).alias("votes"))
    return votes.groupBy("host").agg(F.min_by("own", F.struct(-F.round("votes", 6), "own")).alias("winner"))


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, vote: bool = True) -> DataFrame:
    """(page_id, url, text) of every page, from a DataFrame with page_id, url and html. Without ``vote``
    every page uses its own best container."""
    parsed = durable(parse_pages(pages), "parsed")
    win = durable(winners(parsed) if vote else winners(parsed).limit(0), "winners")
    # The texts move only where the winners are too many to be sent; that join splits a hot host.
    size = win.agg(F.sum(F.octet_length("host") + F.octet_length("winner") + 64)).first()[0] or 0
    out = parsed.join(F.broadcast(win) if size <= broadcast_bytes else win.hint("merge"), "host", "left")
    of = lambda path: F.filter("ranges", lambda r: r["path"] == path)
    out = out.withColumn("use", of(F.col("winner")))
    out = out.withColumn("use", F.when(F.size("use") > 0, F.col("use")).otherwise(of(F.col("own"))))
    # Several containers of the path: all their blocks, once each, in page order.
    inside = lambda b, i: F.exists("use", lambda r: (r["first"] <= i) & (i < r["end"]) & (b["noise"] <= r["depth"]))
    lines = F.transform(F.filter("blocks", inside), lambda b: b["text"])
    return out.select("page_id", "url", F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("text"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page. Null or empty html gives an empty text; a null or odd url has the empty
    host; repeated rows give a row each; a page without containers uses its whole body."""
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
