"""Benchmark decontamination by q-gram lemma filtering.

Benchmark passages are searched by windows of WINDOW bytes that start every STEP bytes; windows of
the same content are one. A window of m bytes that occurs in a text with at most k edits shares at
least m - q + 1 - k * q of its q-grams with it, and all of them lie on neighbouring diagonals. Shared
q-grams are counted in overlapping diagonal bands; bands that meet the bound for
k = m * RATE are merged where they touch, checked once more by short q-grams (FINE_RATE), and verified by
one alignment within m * BUDGET edits. A
replaced word of n letters costs up to n edits but only n + q - 1 q-grams, so the bound also lets
through two of them in any window.

So found for sure are all places of a window with at most RATE edits anywhere, or with one or
two words replaced within BUDGET; and every part of a passage of WINDOW + STEP - 1 bytes or more,
as it holds a whole window. Passages of under LEAST bytes are found where they stand word for word.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_scan import _CLEAN

WINDOW, STEP, RATE, BUDGET, LEAST = 80, 20, 0.1, 0.2, 32
#: q and edits of the bound that is checked before an alignment; two replaced words within BUDGET meet it too.
FINE_Q, FINE_RATE = 4, 0.14
#: q of passages of SHORT bytes or more, and of shorter ones, whose bound needs shorter q-grams.
Q, SHORT_Q, SHORT = 8, 6, 64
#: Bytes of benchmark text whose index is held at once; more come in further blocks, READY of which a worker keeps.
BLOCK, READY = 4_000_000, 4
#: Shared q-grams that are counted at once, and characters of text that a worker takes through all blocks.
HITS, TEXTS = 2_000_000, 32_000_000
#: Bytes of short texts that are filtered together, regions that are aligned together, and windows of a group.
TOGETHER, PAIRS, RUN = 256_000, 1000, 16


def normal(text: str | None) -> bytes:
    """Words of letters and digits, A-Z in lower case, joined by one space (UTF-8)."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split())


def eights(data: bytes) -> np.ndarray:
    """The 8 bytes from each place on as one number, zeros after the end."""
    out, b = np.empty(len(data), np.uint64), data + bytes(16)
    for i in range(min(8, len(data))):
        part = out[i::8]
        part[:] = np.frombuffer(b, np.uint64, len(part), i)
    return out


def hashed(code: np.ndarray, q: int) -> np.ndarray:
    """A hash of the first q of 8 bytes, one to one; its upper bits are well mixed."""
    with np.errstate(over="ignore"):
        return (code if q == 8 else code & np.uint64(256**q - 1)) * np.uint64(0x9E3779B97F4A7C15)


def grams(data: bytes, q: int) -> np.ndarray:
    """The hash of the q bytes (8 at most) from each place on."""
    return hashed(eights(data)[: max(0, len(data) - q + 1)], q)


def spread(first: np.ndarray, n: np.ndarray):
    """(i, number): for each i the numbers from first[i] on, n[i] of them; some HITS at a time."""
    ends, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HITS, "right")))
        m = n[lo:hi]
        total = int(m.sum())
        yield np.repeat(np.arange(lo, hi), m), np.repeat(first[lo:hi] - np.cumsum(m) + m, m) + np.arange(total)
        lo = hi


def add_up(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, weights: np.ndarray):
    """Sorted distinct keys and their counts, with more keys counted in."""
    order = np.argsort(more, kind="stable")
    more, weights = more[order], weights[order]
    first = np.flatnonzero(np.r_[True, more[1:] != more[:-1]]) if len(more) else np.zeros(0, np.int64)
    more, weights = more[first], np.add.reduceat(weights, first) if len(first) else weights
    if not len(keys):
        return more, weights
    both, at = np.unique(np.r_[keys, more], return_inverse=True)
    n = np.zeros(len(both), np.int64)
    n[at[: len(keys)]] = counts
    n[at[len(keys) :]] += weights
    return both, n


def align(pairs: list[tuple[bytes, bytes, int]], cells: int = 200_000) -> list[tuple[int, int, int] | None]:
    """For each (item, text, k): (edits, begin, end) of the item at its fewest edits, if these are at most k,
    from the first such place to the last. Items of one length are aligned together, ``cells`` cells at a time."""
    out: list[tuple[int, int, int] | None] = [None] * len(pairs)
    rest = []
    for i, (item, text, _) in enumerate(pairs):
        if (at := text.find(item)) >= 0:
            out[i] = 0, at, text.rfind(item) + len(item)
        elif text:
            rest.append(i)
    rest.sort(key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    lo = 0
    while lo < len(rest):
        hi, m = lo + 1, len(pairs[rest[lo]][0])
        while hi < len(rest) and len(pairs[rest[hi]][0]) == m and (hi + 1 - lo) * len(pairs[rest[hi]][1]) <= cells:
            hi += 1
        own = np.array(rest[lo:hi])
        lo = hi
        n = max(len(pairs[i][1]) for i in own)
        item = np.array([np.frombuffer(pairs[i][0], np.uint8) for i in own])
        size = np.array([len(pairs[i][1]) for i in own])
        text = np.zeros((len(own), n), np.uint8)  # what is filled up equals no letter
        for j, i in enumerate(own):
            text[j, : size[j]] = np.frombuffer(pairs[i][1], np.uint8)
        k = np.array([pairs[i][2] for i in own])
        steps = np.arange(n + 1, dtype=np.int32)
        cost, start = np.zeros((len(own), n + 1), np.int32), np.tile(steps, (len(own), 1))
        for r in range(m):
            down, diag = cost + 1, np.full_like(cost, 2**30)
            diag[:, 1:] = cost[:, :-1] + (text != item[:, r, None])
            best = np.minimum(down, diag)
            left = np.zeros_like(start)
            left[:, 1:] = start[:, :-1]
            near = np.where(diag <= down, left, start)
            best[:, 0], near[:, 0] = r + 1, 0
            best -= steps
            run = np.minimum.accumulate(best, axis=1)  # insertions along the text
            first = np.maximum.accumulate(np.where(best == run, steps, -1), axis=1)
            cost, start = run + steps, np.take_along_axis(near, first, axis=1)
            if r % 8 == 7 or r == m - 1:
                alive = cost.min(1) <= k
                if not alive.all():
                    own, item, text, k, cost, start, size = (x[alive] for x in (own, item, text, k, cost, start, size))
                if not len(own):
                    break
        for j, i in enumerate(own):
            ends = np.flatnonzero(cost[j] == cost[j].min())
            out[i] = int(cost[j, ends[0]]), int(start[j, ends[0]]), min(int(ends[-1]), int(size[j]))
    return out


class _Grams:
    """q-gram index of the distinct windows of passages for one q."""

    def __init__(self, items: list[tuple[int, bytes]], q: int) -> None:
        self.q = q
        owners: dict[bytes, dict[int, None]] = {}
        runs: list[tuple[int, int]] = []
        for i, (item, data) in enumerate(items):
            size = min(len(data), WINDOW)
            for j, at in enumerate((*range(0, len(data) - size, STEP), len(data) - size)):
                window = data[at : at + size]
                if window not in owners:
                    owners[window] = {}
                    runs.append((i, j // RUN))
                owners[window][item] = None
        self.windows = list(owners)
        self.owners = [list(o) for o in owners.values()]
        self.length = size = np.array([len(w) for w in self.windows])
        # Neighbouring windows of a passage form a group; q-grams of a group are counted before those of its windows.
        number = {r: i for i, r in enumerate(dict.fromkeys(runs))}
        group = np.array([number[r] for r in runs], np.int64)
        codes = [grams(w, q) for w in self.windows]
        n = size - q + 1
        code, own = np.concatenate(codes), np.repeat(np.arange(len(n)), n)
        place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((group[own], code))
        code, self.own, self.place = code[order], own[order], place[order]
        # An entry is a place of a q-gram in a window; the entries of a q-gram in a group lie together as a pair.
        change = np.r_[True, (code[1:] != code[:-1]) | (group[self.own[1:]] != group[self.own[:-1]])]
        self.entry = np.r_[np.flatnonzero(change), len(code)]
        self.group = group[self.own[self.entry[:-1]]]
        self.code, first = np.unique(code[self.entry[:-1]], return_index=True)
        self.pair = np.r_[first, len(self.group)]
        # How often a window holds a q-gram: the most of any window of a pair, and of any with the q-gram.
        once = np.flatnonzero(change | np.r_[True, self.own[1:] != self.own[:-1]])
        often = np.diff(np.r_[once, len(code)])
        self.often = np.maximum.reduceat(often, np.searchsorted(once, self.entry[:-1]))
        self.most = np.maximum.reduceat(self.often, first)
        self.shift = np.uint64(64 - min(24, max(16, (16 * len(self.code)).bit_length())))
        top = (self.code >> self.shift).astype(np.int64)
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[top] = True
        self.head = np.searchsorted(top, np.arange(len(self.bits))).astype(np.int32)
        self.budget = (size * BUDGET).astype(np.int64)
        self.need = np.maximum(1, size - q + 1 - (size * RATE).astype(np.int64) * q)
        self.least = np.full(len(number), 2**30)
        np.minimum.at(self.least, group, self.need)
        self.width = 2 * self.budget + 1
        #: All q-grams of a band lie within so many places, so in two neighbouring blocks.
        self.block = int((2 * self.width + size - q).max())
        fine = [np.unique(eights(w)[: len(w) - FINE_Q + 1] & np.uint64(256**FINE_Q - 1)) for w in self.windows]
        n = np.array([len(f) for f in fine])
        self.fine, self.fine_first = np.concatenate(fine), np.r_[0, np.cumsum(n)]
        # Duplicates in the window count once.
        self.fine_need = n - FINE_Q * (size * FINE_RATE).astype(np.int64)

    def hits(self, code: np.ndarray):
        """(place, pair) of the shared q-grams of groups that share enough in two neighbouring blocks, some HITS at a time."""
        g = hashed(code, self.q)
        top = (g >> self.shift).view(np.int64)
        at = np.flatnonzero(self.bits.take(top))
        g, slot = g[at], self.head.take(top[at])
        todo = np.flatnonzero(self.code[slot] < g)
        while len(todo):
            slot[todo] += 1
            todo = todo[slot[todo] < len(self.code)]
            todo = todo[self.code[slot[todo]] < g[todo]]
        slot = np.minimum(slot, len(self.code) - 1)
        ok = self.code[slot] == g
        at, slot = at[ok], slot[ok]
        n_blocks, n_groups = len(code) // self.block + 2, len(self.least)

        def near(count: np.ndarray, least) -> np.ndarray:
            enough = count[:-1] + count[1:] >= least
            out = np.zeros(count.shape, bool)
            out[:-1] = enough
            out[1:] |= enough
            return out

        block = at // self.block
        ok = near(np.bincount(block, self.most[slot], n_blocks), self.least.min())[block]
        at, slot, block = at[ok], slot[ok], block[ok]
        first, n = self.pair[slot], self.pair[slot + 1] - self.pair[slot]
        ends = np.r_[0, np.cumsum(n)]
        begin = np.searchsorted(block, np.arange(n_blocks + 2))  # of each block's q-grams
        lo, most = 0, max(1, 2 * HITS // n_groups)
        while lo < n_blocks:  # some blocks, of which at most HITS pairs come, and the one before and after
            hi = int(np.searchsorted(ends[begin], ends[begin[lo]] + HITS, "right")) - 1
            hi = min(max(hi, lo + 1), lo + most, n_blocks)
            base, top = max(0, lo - 1), min(hi + 1, n_blocks)
            part = slice(begin[base], begin[top])
            own, total, cells = block[part] - base, int(n[part].sum()), (top - base) * n_groups
            if total:
                whole = list(spread(first[part], n[part])) if total <= HITS else None
                if dense := whole is None or cells <= 16 * total:
                    count = np.zeros(cells)
                    for of, pair in whole or spread(first[part], n[part]):
                        count += np.bincount(own[of] * n_groups + self.group[pair], self.often[pair], cells)
                    alive = near(count.reshape(-1, n_groups), self.least).ravel()
                else:
                    of, pair = (np.concatenate(x) for x in zip(*whole, strict=True))
                    keys, counts = add_up(np.zeros(0, np.int64), np.zeros(0, np.int64), own[of] * n_groups + self.group[pair], self.often[pair])
                    after = np.minimum(np.searchsorted(keys, keys + n_groups), len(keys) - 1)
                    both = keys[after] == keys + n_groups
                    alive = counts + counts[after] * both >= self.least[keys % n_groups]
                    alive[after[both & alive]] = True
                if alive.any():
                    for of, pair in whole or spread(first[part], n[part]):
                        key = own[of] * n_groups + self.group[pair]
                        ok = alive[key if dense else np.searchsorted(keys, key)] & (own[of] >= lo - base) & (own[of] < hi - base)
                        yield at[part][of[ok]], pair[ok]
            lo = hi

    def bands(self, code: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, window, band) of every band that meets its window's bound, sorted, for texts that begin at ``start``.
        Shared q-grams are counted a bounded number at a time; one that stands twice counts twice, which only adds candidates."""
        span = int(np.diff(np.r_[start, len(code) + 1]).max()) // int(self.width.min()) + 8
        cells, total, dense = len(start) * len(self.windows) * span, 0, None
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for place, pair in self.hits(code):
            text = np.searchsorted(start, place, "right") - 1
            row, at = text * len(self.windows), place - start[text]
            n = self.entry[pair + 1] - self.entry[pair]
            total += int(n.sum())
            if dense is None and total > cells:  # where hits are more than bands, bands are counted in place; else by sorting the hits
                dense = np.zeros(cells, np.int32)
                dense[keys] = counts
            for of, entry in spread(self.entry[pair], n):
                own = self.own[entry]
                band = (at[of] - self.place[entry]) // self.width[own] + 5  # from 1 on
                # Overlapping bands: each is two widths wide and starts a width after the one before.
                key = (row[of] + own) * span + band
                key = np.r_[key, key - 1]
                if dense is not None:
                    np.add.at(dense, key, 1)
                else:
                    keys, counts = add_up(keys, counts, *np.unique(key, return_counts=True))
        if dense is not None:
            keys = np.flatnonzero(dense)
            counts = dense[keys]
        own = keys // span % len(self.windows)
        ok = counts >= self.need[own]
        keys, own = keys[ok], own[ok]
        return keys // (span * len(self.windows)), own, keys % span - 5

    def regions(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, window, begin, end) of what may hold a window: merged bands that meet the bound for FINE_RATE too."""
        size = np.array([len(t) for t in texts])
        start = np.cumsum(size + 1) - size - 1
        code = eights(b"\0".join(texts))  # no window holds a zero byte
        text, own, band = self.bands(code, start)
        if not len(text):
            return []
        cut = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (own[1:] != own[:-1]) | (band[1:] > band[:-1] + 2)])
        last = band[np.r_[cut[1:], len(band)] - 1]
        text, own, band = text[cut], own[cut], band[cut]
        lo = np.maximum(0, band * self.width[own] - self.budget[own])
        hi = np.minimum(size[text], (last + 2) * self.width[own] + self.length[own] + self.budget[own])
        # Before the alignment the bound for FINE_RATE on short q-grams.
        n, shared = np.maximum(0, hi - lo - FINE_Q + 1), np.zeros(len(text), np.int64)
        tag = lambda of, gram: of.astype(np.uint64) << np.uint64(8 * FINE_Q) | gram
        for i in range(0, len(text), 4096):
            part = slice(i, i + 4096)
            own_first = self.fine_first[own[part]]
            fine = np.concatenate([tag(of, self.fine[f]) for of, f in spread(own_first, self.fine_first[own[part] + 1] - own_first)])
            for of, at in spread(start[text[part]] + lo[part], n[part]):
                if len(of):
                    here = np.sort(tag(of, code[at] & np.uint64(256**FINE_Q - 1)))
                    few = fine[slice(*np.searchsorted(fine, tag(of[[0, -1]] + [0, 1], np.uint64(0))))]
                    found = few[here[np.minimum(np.searchsorted(here, few), len(here) - 1)] == few] >> np.uint64(8 * FINE_Q)
                    shared[part] += np.bincount(found.astype(np.int64), minlength=len(own_first))
        ok = shared >= self.fine_need[own]
        return list(zip(*(x[ok].tolist() for x in (text, own, lo, hi)), strict=True))

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        out: list[list] = [[] for _ in texts]
        pairs, at, lo = [], [], 0
        while lo < len(texts):
            hi, n = lo + 1, len(texts[lo])
            while hi < len(texts) and n + len(texts[hi]) <= TOGETHER:
                n += len(texts[hi])
                hi += 1
            for t, w, begin, end in self.regions(texts[lo:hi]):
                pairs.append((self.windows[w], texts[lo + t][begin:end], int(self.budget[w])))
                at.append((lo + t, w, begin))
            lo = hi
            if len(pairs) >= PAIRS or lo == len(texts):
                for (t, w, begin), found in zip(at, align(pairs), strict=True):
                    if found:
                        out[t] += [(item, begin + found[1], begin + found[2], found[0]) for item in self.owners[w]]
                pairs, at = [], []
        return out


class _Exact:
    """Passages too short for a bound, found word for word."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        import ahocorasick

        own: dict[str, list[int]] = {}
        for item, data in items:
            own.setdefault(data.decode("latin-1"), []).append(item)
        self.auto = ahocorasick.Automaton()
        for text, ids in own.items():
            self.auto.add_word(f" {text} ", (len(text), ids))
        self.auto.make_automaton()

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        lines = (f" {t.decode('latin-1')} " for t in texts)
        return [[(i, end - n - 1, end - 1, 0) for end, (n, ids) in self.auto.iter(line) for i in ids] for line in lines]


class Index:
    """The windows of benchmark passages, with shorter q-grams for short passages; the shortest as they are."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        by = lambda lo, hi: [x for x in items if lo <= len(x[1]) < hi]
        self.parts: list = [_Grams(x, q) for x, q in ((by(SHORT, 2**62), Q), (by(LEAST, SHORT), SHORT_Q)) if x]
        if few := by(1, LEAST):
            self.parts.append(_Exact(few))

    def search(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item, begin, end, edits) of every verified place in a normalised text."""
        return self.search_all([text])[0]

    def search_all(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        found = [p.search(texts) for p in self.parts]
        return [sorted({f for part in found for f in part[i]}) for i in range(len(texts))]


class Indexes:
    """The indexes of all blocks of a benchmark; a worker keeps the last READY of them."""

    def __init__(self, blocks: list) -> None:
        self.blocks, self.ready = blocks, OrderedDict()

    def get(self, i: int) -> Index:
        if i not in self.ready:
            if len(self.ready) >= READY:
                self.ready.popitem(last=False)
            self.ready[i] = Index(self.blocks[i].value)
        self.ready.move_to_end(i)
        return self.ready[i]

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each text what is found in it: block by block, so that each index is made once for many texts."""
        out: list[list] = [[] for _ in texts]
        for i in range(len(self.blocks)):
            for own, found in zip(out, self.get(i).search_all(texts), strict=True):
                own += found
        return out


def blocks_of(benchmark: DataFrame, limit: int = BLOCK):
    """Lists of (item_id, normalised text), each of at most ``limit`` bytes or one item."""
    block, size = [], 0
    for r in benchmark.where("text IS NOT NULL").select("item_id", "text").orderBy("item_id").toLocalIterator():
        data = normal(r.text)
        if not data:
            continue
        if block and size + len(data) > limit:
            yield block
            block, size = [], 0
        block.append((r.item_id, data))
        size += len(data)
    if block:
        yield block


def _broadcast(spark: SparkSession, benchmark: DataFrame) -> list:
    """The benchmark's blocks of bounded size, each sent to the executors that ask for it."""
    return [spark.sparkContext.broadcast(b) for b in blocks_of(benchmark)]


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_regions, begin, end, edits): matches of benchmark passages in ``docs``.

    ``docs`` has doc_id and text; they are read once, whatever the benchmark's size."""
    schema = "doc_id long, item_id long, n_regions long, begin long, end long, edits int"
    blocks = _broadcast(docs.sparkSession, benchmark)
    if not blocks:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches):
        indexes = Indexes(blocks)
        for b in batches:
            rows, at = [], 0
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            ids = b["doc_id"].tolist()
            while at < len(texts):
                end, n = at, 0
                while end < len(texts) and (end == at or n + len(texts[end]) <= TEXTS):
                    n += len(texts[end])
                    end += 1
                for d, found in zip(ids[at:end], indexes.search([normal(t) for t in texts[at:end]]), strict=True):
                    for item in sorted({f[0] for f in found}):
                        own = [f for f in found if f[0] == item]
                        rows.append((d, item, len(own), min(f[1] for f in own), max(f[2] for f in own), min(f[3] for f in own)))
                at = end
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_regions", "begin", "end", "edits"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark passage found in it. Null and empty texts and passages
    match nothing; repeated documents give rows each; passages of one text are each found."""
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark passage, in one pass. Null and empty texts
    stay; repeated rows are judged alike; all columns are kept as they are."""
    blocks = _broadcast(spark, table(spark, sf_dir, "benchmark"))
    cache: list[Indexes] = []

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        if not cache:
            cache.append(Indexes(blocks))
        out, at, ts = [], 0, [t if isinstance(t, str) else "" for t in texts]
        while at < len(ts):
            end, n = at, 0
            while end < len(ts) and (end == at or n + len(ts[end]) <= TEXTS):
                n += len(ts[end])
                end += 1
            out += [not f for f in cache[0].search([normal(t) for t in ts[at:end]])]
            at = end
        return pd.Series(out, dtype=bool)

    return docs.where(clean("text")) if blocks else docs
