"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are routed by masked bit patterns: the upper nodes of the index are (mask,
pattern) pairs, and all fingerprints that share one meet. Below such a node its fingerprints are
sorted by Gray rank and grouped level by level; each inner node keeps the mask of the bits that all
its fingerprints share and their pattern. Two nodes whose common masked bits already differ in more
bits than the radius are pruned with all that is below them, and the differences of the remaining
leaves are counted in full. Groups over ``LEAF_LIMIT`` go one level further down, by more bits, where
the masks of that level are complete; else their blocks are compared two by two.

For the 64-bit query the masks are complete: 64 bits in 6 blocks, and two fingerprints within 4 bits
agree in two blocks at least; splits use 5 parts of the bits left, one of which agrees.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, durable, release, table, whole_row
from .components import components

LEAF_LIMIT, FAN, LEVELS = 4096, 8, 3
_SPREAD = np.array([int.from_bytes(bytes((b >> i) & 1 for i in range(8)), "little") for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: str | None, k: int) -> list[int]:
    """XXH64 (seed 42) of every k-word shingle, repeats included; of the whole text if shorter."""
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not ws:
        return []
    line, h = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= k:
        return [h(line, 42)]
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in ws)]
    starts = [0, *(e + 1 for e in ends[: len(ws) - k])]
    return [h(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=True)]


def _mix(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64-bit hash of the same shingle for each further fingerprint word."""
    if not word:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * word) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints_of(hashes: list[list[int]], words: int = 1) -> np.ndarray:
    """(n, words) fingerprints: a bit is set if it is in over half the hashes; none: zero."""
    out = np.zeros((len(hashes), words), np.uint64)
    lo = 0
    while lo < len(hashes):
        hi, n = lo, 0
        while hi < len(hashes) and (hi == lo or n + len(hashes[hi]) <= 150_000):
            n += len(hashes[hi])
            hi += 1
        size = np.array([len(h) for h in hashes[lo:hi]])
        full = np.flatnonzero(size)
        if len(full):
            flat = np.fromiter((x for h in hashes[lo:hi] for x in h), np.uint64, n)
            for w in range(words):
                total = np.zeros((len(full), 64), np.int64)
                for part in range(0, n, 150_000):  # a very long text comes in parts
                    piece = _mix(flat[part : part + 150_000], w)
                    owner = np.repeat(np.arange(len(full)), size[full])[part : part + 150_000]
                    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    # eight counters in a word hold up to 255 each
                    cut = np.concatenate([np.arange(a, b, 255) for a, b in zip(first, [*first[1:], len(owner)], strict=True)])
                    sums = np.add.reduceat(_SPREAD[piece.view(np.uint8).reshape(-1, 8)], cut, axis=0)
                    np.add.at(total, owner[cut], sums.view(np.uint8).reshape(len(cut), 64))
                bits = np.packbits(2 * total > size[full, None], axis=1, bitorder="little")
                out[lo + full, w] = bits.view(np.uint64)[:, 0]
        lo = hi
    return out


def with_fingerprints(df: DataFrame, text: str = "text", k: int = 4, words: int = 1) -> DataFrame:
    """Adds ``fp``, an array of ``words`` longs."""

    @F.pandas_udf("array<long>")
    def fp(texts: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for lo in range(0, len(texts), 256):  # bounds the hashes held at once
            part = [shingle_hashes(t if isinstance(t, str) else None, k) for t in texts.iloc[lo : lo + 256]]
            out += list(fingerprints_of(part, words).view(np.int64))
        return pd.Series(out)

    return df.withColumn("fp", fp(text))


def with_set_fingerprints(df: DataFrame, text: str = "text", k: int = 5, words: int = 4) -> DataFrame:
    """Adds ``fp``, an array of ``words`` longs over the distinct shingles, and ``digest``, a hash of their set."""

    @F.pandas_udf("fp array<long>, digest long")
    def code(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        fp: list[np.ndarray] = []
        digest: list[int] = []
        for lo in range(0, len(texts), 256):
            part = [sorted(set(shingle_hashes(t if isinstance(t, str) else None, k))) for t in texts.iloc[lo : lo + 256]]
            fp += list(fingerprints_of(part, words).view(np.int64))
            digest += [xxhash.xxh64_intdigest(np.array(s, dtype=np.uint64).tobytes(), 42) for s in part]
        return pd.DataFrame({"fp": pd.Series(fp, dtype=object), "digest": np.array(digest, dtype=np.uint64).view(np.int64)})

    return df.withColumn("code", code(text)).select(*df.columns, "code.fp", "code.digest")


def gray_rank(code: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> np.uint64(s))
    return code


def near_pairs(codes: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of ``codes`` (n, words) in one group that differ in ``radius`` bits at most."""
    order = np.lexsort((*(gray_rank(codes[:, w]) for w in reversed(range(codes.shape[1]))), group))
    code, own = codes[order], group[order]
    levels = [(code, code, np.arange(len(code) + 1), own)]  # and-fold, or-fold, child bounds, group
    while len(levels[-1][3]) > len(np.unique(levels[-1][3])):
        both, either, _, g = levels[-1]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        within = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
        cut = np.flatnonzero(within % FAN == 0)
        levels.append((np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(either, cut), np.r_[cut, len(g)], g[cut]))
    words = range(codes.shape[1])
    leaf = [np.ascontiguousarray(code[:, w]) for w in words]
    inner = [[(np.ascontiguousarray(both[:, w]), np.ascontiguousarray(~(both ^ either)[:, w])) for w in words] for both, either, _, _ in levels[1:]]

    def near(depth: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node pairs that may hold near codes: differences add up word by word."""
        total = np.zeros(len(x), np.int16)
        for w in words:
            if depth:
                bits, shared = inner[depth - 1][w]
                total += np.bitwise_count((bits[x] ^ bits[y]) & shared[x] & shared[y])
            else:
                total += np.bitwise_count(leaf[w][x] ^ leaf[w][y])
            keep = total <= radius
            x, y, total = x[keep], y[keep], total[keep]
        return x, y

    a = b = np.arange(len(levels[-1][3]))
    for depth in range(len(levels) - 1, 0, -1):
        bound, found, step = levels[depth][2], [], 20_000
        for lo in range(0, len(a), step):
            x, y = a[lo : lo + step], b[lo : lo + step]
            nx, ny = bound[x + 1] - bound[x], bound[y + 1] - bound[y]  # all children of both nodes
            of = np.repeat(np.arange(len(x)), nx * ny)
            at = np.arange(len(of)) - np.repeat(np.cumsum(nx * ny) - nx * ny, nx * ny)
            cx, cy = bound[x][of] + at // ny[of], bound[y][of] + at % ny[of]
            keep = cx <= cy if depth > 1 else cx < cy
            found.append(near(depth - 1, cx[keep], cy[keep]))
        a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, int) for i in (0, 1))
    if len(levels) == 1:
        a = b = a[:0]
    return order[a], order[b]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each row."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == old).all():
            return root


# -- routing ---------------------------------------------------------------------------------------


def blocks(bits: list[int], n: int) -> list[list[int]]:
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]


class CompleteRoutes:
    """Masks under which any two 64-bit fingerprints within ``radius`` bits agree at least once."""

    words = 1

    def __init__(self, radius: int = 4) -> None:
        self.radius = radius

    def first(self) -> list[tuple[int, ...]]:
        parts = blocks(list(range(64)), self.radius + 2)
        return [tuple(sorted(x + y)) for x, y in combinations(parts, 2)]

    def below(self, mask: tuple[int, ...]) -> list[tuple[int, ...]]:
        free = [b for b in range(64) if b not in set(mask)]
        return [tuple(sorted((*mask, *p))) for p in blocks(free, min(self.radius + 1, len(free))) if p] if len(free) > self.radius else []


class SampledRoutes:
    """Masks of bits drawn (by a fixed seed) from wide fingerprints, for large radii.

    They have no masks below, as more sampled bits would lose pairs: large groups are cut into blocks."""

    def __init__(self, words: int, radius: int, bits: int, tables: int) -> None:
        self.words, self.radius, self.bits, self.tables = words, radius, bits, tables

    def first(self) -> list[tuple[int, ...]]:
        rng = np.random.default_rng(42)
        return [tuple(sorted(map(int, rng.choice(64 * self.words, self.bits, replace=False)))) for _ in range(self.tables)]


def _longs(mask: tuple[int, ...], words: int) -> list[int]:
    out = [0] * words
    for b in mask:
        out[b // 64] |= 1 << (b % 64)
    return [x - 2**64 if x >= 2**63 else x for x in out]


def _key(fp: str, mask: list, words: int) -> Column:
    return F.xxhash64(*(F.col(fp)[w].bitwiseAND(mask[w]) for w in range(words)))


def route(codes: DataFrame, routes, limit: int = LEAF_LIMIT) -> list[DataFrame]:
    """Groups (members: array of (id, fp)) of 2 to ``limit`` distinct codes that share a pattern.

    Larger groups of routes without masks below are cut into blocks by a hash of the id, of about half of ``limit``; every
    block is a group and so are every two, where ``across`` says that only pairs of different ``part`` are new.

    ``codes`` has id, fp and what else the members carry. Other larger groups are dealt again by the masks below theirs, level by
    level; those whose masks have nothing below, or that are LEVELS down, are left whole."""
    w, cols = routes.words, codes.columns
    masks = routes.first()
    rows = codes.select(
        *cols, F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), _key("fp", _longs(m, w), w).alias("key")) for i, m in enumerate(masks)))).alias("r")
    ).select(*cols, "r.mask", "r.key")
    out = []
    if not hasattr(routes, "below"):
        hot = rows.groupBy("mask", "key").count().where(F.col("count") > limit)
        hot = durable(hot.select("mask", "key", F.ceil(2 * F.col("count") / limit).cast("int").alias("n")), "hot")
        big = rows.join(hot, ["mask", "key"]).withColumn("part", F.pmod(F.xxhash64("id"), "n").cast("int"))
        big = big.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        big = big.withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")})
        cold = rows.join(hot, ["mask", "key"], "left_anti").withColumns({c: F.lit(0) for c in ("part", "x", "y")})
        keys = ["mask", "key", "x", "y"]
        both = cold.select(*cols, "part", *keys).unionByName(big.select(*cols, "part", *keys))
        groups = both.groupBy(*keys).agg(F.collect_list(F.struct(*cols, "part")).alias("members"))
        return [groups.where(F.size("members") > 1).select("mask", (F.col("x") < F.col("y")).alias("across"), "members")]
    while True:
        sizes = rows.groupBy("mask", "key").count()
        hot = durable(sizes.where(F.col("count") > limit).select("mask", "key"), "hot")
        n_hot = hot.count()
        n_hot = n_hot if len(out) < LEVELS else 0
        below = {i: routes.below(masks[i]) for i in {r.mask for r in hot.select("mask").distinct().collect()}} if n_hot else {}
        below = {i: m for i, m in below.items() if m}  # there are as many masks as the routes define
        cold = rows
        if below:
            hot = hot.where(F.col("mask").isin(*below))
            cold = rows.join(hot, ["mask", "key"], "left_anti")
        groups = cold.groupBy("mask", "key").agg(F.collect_list(F.struct(*cols)).alias("members"))
        out.append(groups.where(F.size("members") > 1).select("mask", "members"))
        if not below:
            return out
        masks = [m for i in sorted(below) for m in below[i]]
        table, n = [], 0
        for i in sorted(below):
            for m in below[i]:
                table.append((i, n, _longs(m, w)))
                n += 1
        table = codes.sparkSession.createDataFrame(table, "mask int, child int, bits array<long>")
        again = rows.join(hot, ["mask", "key"], "left_semi").join(F.broadcast(table), "mask")  # a fixed number of masks
        rows = durable(again.select(*cols, F.col("child").alias("mask"), _key("fp", [F.col("bits")[k] for k in range(w)], w).alias("key")), "again")


def links(groups: DataFrame, radius: int) -> DataFrame:
    """(a, b) ids of near codes: a spanning star of each component within a group."""

    def run(batches):
        for batch in batches:
            rows: list[pd.DataFrame] = []
            at, members = 0, batch["members"].tolist()
            while at < len(members):
                end, n = at, 0
                while end < len(members) and (end == at or n + len(members[end]) <= 100_000):
                    n += len(members[end])
                    end += 1
                flat = [m for g in members[at:end] for m in g]
                ids = np.array([m["id"] for m in flat], dtype=np.int64)
                codes = np.array([m["fp"] for m in flat], dtype=np.int64).view(np.uint64).reshape(n, -1)
                group = np.repeat(np.arange(end - at), [len(g) for g in members[at:end]])
                i, j = near_pairs(codes, group, radius)
                i, j = (r := np.arange(n)), spanning(n, i, j)
                i, j = r[j != r], j[j != r]
                a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                rows.append(pd.DataFrame({"a": a, "b": b}).drop_duplicates())
                at = end
            yield pd.concat(rows) if rows else pd.DataFrame({"a": [], "b": []})

    return groups.mapInPandas(run, "a long, b long")


def all_links(codes: DataFrame, routes) -> DataFrame:
    return reduce(DataFrame.unionByName, [links(g, routes.radius) for g in route(codes, routes)]).distinct()


def candidates(codes: DataFrame, routes, each: str, within: int | None = None, limit: int = LEAF_LIMIT) -> DataFrame:
    """(a, b), a < b: near codes with different roots (``codes`` has id, fp and root).

    ``each`` says what is kept of them, by the fewest differing bits: "node": for every code its
    nearest code and its nearest of a smaller id; "roots": the nearest pair of every two roots; "pair": all. Each
    task keeps its own least pairs before those of all tasks meet. Where ``codes`` also has ``w``,
    longer fingerprints, those decide instead within the groups, up to ``within`` differing bits."""
    col = "w" if "w" in codes.columns else "fp"
    keys = {"node": ["k", "l"], "roots": ["k", "l"], "pair": ["a", "b"]}[each]
    groups = route(codes, routes, limit)[0]
    # Every pair meets under each mask on which it agrees: the first of them gives it.
    masks = np.array([_longs(m, routes.words) for m in routes.first()], dtype=np.int64).view(np.uint64)

    def run(batches):
        for batch in batches:
            at, members, under, across = 0, batch["members"].tolist(), batch["mask"].to_numpy(), batch["across"].to_numpy()
            while at < len(members):
                end, n = at, 0
                while end < len(members) and (end == at or n + len(members[end]) <= 20_000):
                    n += len(members[end])
                    end += 1
                flat = [m for g in members[at:end] for m in g]
                ids, root = (np.array([m[c] for m in flat], dtype=np.int64) for c in ("id", "root"))
                code = np.array([m["fp"] for m in flat], dtype=np.int64).view(np.uint64).reshape(n, -1)
                group = np.repeat(np.arange(end - at), [len(g) for g in members[at:end]])
                i, j = near_pairs(code, group, routes.radius)
                part = np.array([m["part"] for m in flat])
                new, own = ~across[at:end][group[i]] | (part[i] != part[j]), under[at:end][group[i]]
                for k, mask in enumerate(masks[: own.max(initial=0)]):
                    again = own > k
                    for w in range(len(mask)):
                        again &= ((code[i, w] ^ code[j, w]) & mask[w]) == 0
                    new &= ~again
                i, j = i[new], j[new]
                at = end
                i, j = (v[root[i] != root[j]] for v in (i, j))
                code = np.array([m[col] for m in flat], dtype=np.int64).view(np.uint64).reshape(n, -1)
                d = np.zeros(len(i), np.int32)
                for w in range(code.shape[1]):
                    d += np.bitwise_count(code[i, w] ^ code[j, w])
                if within is not None:
                    i, j, d = (v[d <= within] for v in (i, j, d))
                if not len(i):
                    continue
                i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
                rows = pd.DataFrame({"a": ids[i], "b": ids[j], "d": d})
                if each == "node":
                    rows = pd.concat([rows.assign(k=rows["b"], l=0), rows.assign(k=rows["a"], l=1), rows.assign(k=rows["b"], l=1)])
                else:
                    rows["k"], rows["l"] = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
                yield rows.sort_values(["d", "a", "b"]).drop_duplicates(keys)[["k", "l", "a", "b", "d"]]

    least = groups.mapInPandas(run, "k long, l long, a long, b long, d int").groupBy(*keys).agg(F.min(F.struct("d", "a", "b")).alias("m"))
    return least.select("m.a", "m.b").distinct()


#: Ids from here on stand for fingerprints of documents without an id.
NO_ID = 2**62


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document. Null and empty texts have fingerprint zero; a null id takes part in
    linking but is nobody's smallest id; repeated rows give a row each."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = durable(with_fingerprints(docs, k=4).select("doc_id", F.col("fp")[0].alias("code")), "fingerprints")
    # A fingerprint is known by the least id of its documents: the smallest node reached is then the answer.
    none = F.shiftrightunsigned(F.xxhash64("code"), 2) + NO_ID
    kinds = durable(docs.groupBy("code").agg(F.min("doc_id").alias("least")).select("code", F.coalesce("least", none).alias("id")), "kinds")
    root = components(all_links(kinds.select("id", F.array("code").alias("fp")), CompleteRoutes(4)))
    of = kinds.join(root, kinds["id"] == root["node"], "left").select("code", F.coalesce("root", "id").alias("component_id"))
    of = of.withColumn("component_id", F.when(F.col("component_id") < NO_ID, F.col("component_id")))
    return docs.join(of, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-duplicates on shingles: five words, similarity 0.8 or more.
SHINGLE, SIMILARITY, WORDS, LONG = 5, 0.8, 4, 16


def wide_radius(similarity: float, words: int = WORDS, sigmas: float = 2.5) -> int:
    """Bits in which fingerprints at this Jaccard similarity differ, with a margin for chance."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * words
    return math.ceil(n * p + sigmas * math.sqrt(n * p * (1 - p)))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays, the one of the least id.

    Fingerprints of 256 bits over the distinct 5-word shingles propose pairs of different shingle sets; the
    Jaccard similarity of the sets decides each of them, of equal fingerprints too. As copies of one text are near each other, they are joined by
    their nearest pairs first; then only pairs of different components are left: the nearest pair of
    every two by longer fingerprints of 1024 bits, and at last all pairs of roots whose nearest pair was not similar. The
    masks are sampled: a link at the limit itself is proposed with a chance of about 0.97, closer ones more surely.
    Sets are compared by 32 bits of each shingle's hash. Null and empty texts are copies of one another. Columns of
    ``docs`` are kept; null ids come last, and of rows with the same least id one stays."""
    wide = docs.select(whole_row(docs).alias("doc"), F.col("text"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = durable(with_set_fingerprints(wide, k=SHINGLE, words=WORDS).withColumn("uid", F.monotonically_increasing_id()), "wide")
    best = F.min(F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "uid"))
    heads = rows.groupBy("fp", "digest").agg(best.alias("b"))
    heads = durable(heads.select("fp", F.col("b.uid").alias("id"), F.col("b.col1").alias("o1"), F.col("b.col2").alias("o2")), "heads")
    routes = SampledRoutes(WORDS, wide_radius(SIMILARITY), 12, 24)
    pairs = durable(candidates(heads.select("id", "fp", F.col("id").alias("root")), routes, "node"), "pairs")
    # Every set whose fingerprint is near any other is in one of these pairs.
    ids = durable(pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct(), "near")

    @F.pandas_udf("array<int>")
    def shingles(texts: pd.Series) -> pd.Series:
        # Half of each hash: two different shingles of a pair of 20,000-word texts share it with a chance of 1 in 10.
        return texts.map(lambda t: np.unique(np.array(shingle_hashes(t, SHINGLE), dtype=np.uint64).astype(np.uint32)).view(np.int32))

    @F.pandas_udf("array<long>")
    def long_code(sets: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for lo in range(0, len(sets), 256):
            part = [np.asarray(x, dtype=np.int32).view(np.uint32).tolist() for x in sets.iloc[lo : lo + 256]]
            out += list(fingerprints_of(part, LONG + 1)[:, 1:].copy().view(np.int64))  # the first word would be the bare hashes
        return pd.Series(out)

    sets = rows.select("uid", "text").join(ids, "uid", "left_semi").select("uid", shingles("text").alias("s"))
    sets = durable(sets.withColumn("w", long_code("s")), "sets")

    def similar(pairs: DataFrame) -> DataFrame:
        right = sets.select(F.col("uid").alias("b"), F.col("s").alias("sb")).join(pairs.select("b").distinct(), "b", "left_semi")  # moves only what is needed
        both = pairs.join(sets.select(F.col("uid").alias("a"), F.col("s").alias("sa")), "a").join(right, "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where(common >= SIMILARITY * (F.size("sa") + F.size("sb") - common)).select("a", "b")

    near = durable(similar(pairs), "similar")
    release(pairs)
    root = durable(components(near), "roots")
    active = durable(heads.join(ids.withColumnRenamed("uid", "id"), "id", "left_semi").join(sets.select(F.col("uid").alias("id"), "w"), "id").select("id", "fp", "w"), "active")
    # Wider nets for the codes with near copies; they find 99 % of links at the limit itself.
    routes = SampledRoutes(WORDS, routes.radius, 10, 24)
    for each in ("roots", "pair"):
        codes = durable(active.join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "codes")
        found = durable(candidates(codes, routes, each, wide_radius(SIMILARITY, LONG, 3)), "pairs")
        more = durable(similar(found), "similar")
        near = near.unionByName(more)
        root = durable(components(near), "roots")
        # Roots that are joined have nothing more to find; only those of pairs that were not similar have.
        end = found.join(more, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("id"))
        open_roots = codes.join(end, "id", "left_semi").select("root").distinct()
        active = codes.join(open_roots, "root", "left_semi").select("id", "fp", "w")
    # The head of least id stays for each component; all other rows of its sets go.
    h = heads.join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    stay = h.groupBy("root").agg(F.min(F.struct("o1", "o2", "id")).alias("m")).select(F.col("m.id").alias("uid"))
    return rows.select("uid", "doc").join(stay, "uid", "left_semi").select("doc.*")
