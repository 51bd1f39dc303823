"""Best-fit packing with certified bounds.

Texts become token ids once. Pieces go to partitions by hash, to several even where one would hold
them; each partition packs by best-fit decreasing, and dual feasible functions give a lower bound on
its bins, in whole numbers. A partition at its bound is certified: all but its TAIL loosest bins are final. One with
a gap refills its loosest bins by subset sums and by trial; if a gap is left, it gives the documents of many more
bins to the pool, which is dealt to fewer partitions (so that documents of different partitions meet) and packed
again, until one partition is left. ``certificate`` tells what gap there is in the end.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

CAPACITY, END = 1024, 2
VOCABULARY = "byte_bpe_50k.json"
#: Bins that even a partition at its bound gives away: what is loose in several of them fits together.
TAIL = 24
PIECES = "piece int, start long, length long, ids_crc32 long"


class Ids:
    """Token ids as little-endian uint32 bytes, equal to those of the tokenizers library.

    A space between two characters that are not white space starts a new pre-token, so texts without
    other spaces are encoded unit by unit ("word", " word", ...) through a cache of bounded size.
    All other texts, and those that name a special token, go to the library whole.
    """

    LIMIT = 400_000

    def __init__(self, name: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ranks = public_tokenizers.path(name.replace(".json", ".tiktoken"))
        with open(ranks, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.units = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})
        self.cache: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        import re

        if re.search(r"\s |[ ]\s|^ | $", text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not text:
            return b""
        cache, out = self.cache, []
        first, *rest = text.split(" ")
        out.append(np.array(self.units.encode_ordinary(first), dtype="<u4").tobytes())
        for w in rest:
            ids = cache.get(w)
            if ids is None:
                if len(cache) >= self.LIMIT:
                    cache.clear()
                ids = np.array(self.units.encode_ordinary(" " + w), dtype="<u4").tobytes()
                if len(w) <= 40:
                    cache[w] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(name: str) -> Ids:
    return Ids(name)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; null text counts as empty.

    Only documents of over ``capacity`` tokens are cut; their first piece takes the remainder."""
    tail = np.array([end], dtype="<u4").tobytes()

    def cut(batches):
        ids = encoder(vocabulary)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                data = ids(text if isinstance(text, str) else "") + tail
                n, lo, k = len(data) // 4, 0, 0
                while lo < n:
                    hi = lo + ((n - lo) % capacity or capacity) if lo == 0 else lo + capacity
                    rows.append((doc, k, lo, hi - lo, zlib.crc32(data[4 * lo : 4 * hi])))
                    lo, k = hi, k + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": b["doc_id"].dtype})

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(cut, "doc_id string, " + PIECES).withColumn("doc_id", F.col("doc_id").cast("long"))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual feasible functions on a histogram of lengths, in integers."""
    counts = counts.astype(object)
    size = np.arange(len(counts)).astype(object)
    up = lambda total, unit: -(-int(total) // unit)
    best = up((size * counts).sum(), capacity)
    for e in range(1, capacity // 2 + 1, max(1, capacity // 128)):  # large to the whole, small to nothing
        middle = slice(e, max(e, capacity - e + 1))
        best = max(best, up(counts[capacity - e + 1 :].sum() * capacity + (size[middle] * counts[middle]).sum(), capacity))
    for k in range(1, 21):  # rounds down to multiples of 1 / k
        x = size * (k + 1)
        best = max(best, up((np.where(x % capacity == 0, size * k, (x // capacity) * capacity) * counts).sum(), capacity * k))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item by best-fit decreasing, and the room left in each bin."""
    room_of: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, place, offset = 0, np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fit = open_ >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1  # the smallest room of at least n
            b = stacks[room].pop()
            if not stacks[room]:
                open_ &= ~(1 << room)
        else:
            room, b = capacity, len(room_of)
            room_of.append(capacity)
        place[i], offset[i] = b, capacity - room
        left = room - n
        room_of[b] = left
        if left:
            stacks[left].append(b)
            open_ |= 1 << left
    return place, offset, np.array(room_of, dtype=np.int64)


def complete(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``best_fit``, bin by bin: the largest item that is left and those that together fill the rest best.

    Sums of items are bits of a number; larger items are tried first, so that small ones are kept for later."""
    own: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable"):
        own.setdefault(int(lengths[i]), []).append(int(i))
    sizes = sorted(own, reverse=True)
    place, offset, rooms = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    while sizes:
        chosen, room = [sizes[0]], capacity - sizes[0]
        reach, full, steps = 1, (1 << (room + 1)) - 1, []
        for n in sizes:
            if n > room:
                continue
            left, k = min(len(own[n]) - (n == sizes[0]), room // n), 1
            while left > 0:
                t = min(k, left)
                if (more := (reach | reach << (t * n)) & full) != reach:
                    steps.append((n, t, reach))
                    reach = more
                left, k = left - t, 2 * k
            if reach >> room & 1:
                break
        total = reach.bit_length() - 1
        for n, t, before in reversed(steps):
            if not before >> total & 1:
                chosen += [n] * t
                total -= t * n
        at = 0
        for n in chosen:
            i = own[n].pop()
            place[i], offset[i] = len(rooms), at
            at += n
        rooms.append(capacity - at)
        sizes = [n for n in sizes if own[n]]
    return place, offset, np.array(rooms, dtype=np.int64)


def fill(lengths: np.ndarray, capacity: int, loose: int, tries: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item, the room left in each bin, and the gap to the bound.

    Best-fit decreasing; where that leaves a gap, its ``loose`` bins with most room are filled anew, and then a
    few bins at a time, drawn by a fixed seed and the looser the likelier, for ``tries`` times or until the gap is closed."""
    place, _, room = best_fit(lengths, capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    bins: list[np.ndarray] = np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place))[:-1]) if len(lengths) else []
    rng = np.random.default_rng(len(lengths))
    for t in range(tries if len(bins) > bound else 0):
        room = np.array([capacity - lengths[b].sum() for b in bins]) if t % 20 == 0 else room
        if t == 0:
            chosen = np.argsort(-room, kind="stable")[:loose]
        else:
            weight = room + 5.0
            chosen = rng.choice(len(bins), min(int(rng.integers(5, 60)), len(bins)), replace=False, p=weight / weight.sum())
        items = np.concatenate([bins[i] for i in chosen])
        rng.shuffle(items)
        new = min((complete(lengths[items], capacity), best_fit(lengths[items], capacity)), key=lambda x: len(x[2]))
        if len(new[2]) <= len(chosen):
            parts = np.split(items[np.argsort(new[0], kind="stable")], np.cumsum(np.bincount(new[0]))[:-1])
            for i, p in zip(chosen, parts, strict=False):
                bins[i] = p
            if len(parts) < len(chosen):
                gone = set(chosen[len(parts) :].tolist())
                bins = [b for i, b in enumerate(bins) if i not in gone]
                room = np.array([capacity - lengths[b].sum() for b in bins])
                if len(bins) <= bound:
                    break
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, b in enumerate(bins):
        place[b], offset[b] = i, np.cumsum(lengths[b]) - lengths[b]
    room = np.array([capacity - lengths[b].sum() for b in bins], dtype=np.int64)
    return place, offset, room, len(room) - bound


def _pack(capacity: int, round_: int, last: bool, loose: int):
    def group(pdf):
        n = pdf["length"].to_numpy()
        place, offset, room, gap = fill(n, capacity, loose)
        free = np.zeros(len(room), bool)
        if not last:
            free[np.argsort(-room, kind="stable")[: loose if gap else TAIL]] = True
            free &= room > 0
        base = (round_ * 2**31 + int(pdf["part"].iloc[0])) * 2**24
        return pdf.drop(columns="part").assign(sequence_id=np.where(free[place], -1, base + place), offset=offset)

    return group


def pack(items: DataFrame, *, capacity: int = CAPACITY, target: int = 60_000, loose: int = 2000, least: int = 4) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to items that have ``length`` (1 to ``capacity``).

    ``target`` is the number of items a partition holds, which bounds the memory of a task; there are ``least`` partitions
    at first. A partition with a gap releases ``loose`` bins at most, any other TAIL, so the pool of the next round
    is a fraction of this one's, until one partition holds it. Items of full length fill a sequence alone and take
    no part in the search. ``items`` is read more than once: a stored table."""
    schema = items.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", sequence_id long, offset long"
    whole = items.where(F.col("length") == capacity).withColumns(
        {"sequence_id": -2 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    pool, out, r = items.where(F.col("length") < capacity), whole, 0
    n = pool.count()
    parts = max(least, -(-n // target))
    while n:
        # A row number sets repeated rows apart, which may be a third of all.
        part = F.pmod(F.xxhash64(*items.columns, F.monotonically_increasing_id(), F.lit(r)), F.lit(parts)).cast("int")
        packed = durable(
            pool.withColumn("part", part).groupBy("part").applyInPandas(_pack(capacity, r, parts == 1, loose), schema), f"pack{r}"
        )
        out = out.unionByName(packed.where("sequence_id >= 0"))
        pool = packed.where("sequence_id = -1").select(*items.columns)
        n, r = pool.count(), r + 1
        parts = max(1, min(parts // 2, -(-n // target)))
    return out


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences, lower bound) of all that is packed: at equal numbers no packing has fewer."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect():  # capacity rows at most
        counts[r.length] = r.n
    return packed.select("sequence_id").distinct().count(), lower_bound(counts, capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of every document. A null or empty text is one piece that holds only the
    end; repeated rows are packed as they come; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(durable(pieces(docs), "pieces"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents. Null and empty texts are one piece; repeated rows are packed as
    they come; other columns than doc_id and text are not read."""
    return pack(durable(pieces(docs), "pieces-stage"))
