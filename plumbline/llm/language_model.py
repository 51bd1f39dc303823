"""LM scoring: a gated recurrent language model in numpy with a class-factored output.

One pass over the corpus turns every text into ids of its block's own dictionary; the dictionaries are
joined with the counts of all training tokens, and texts become arrays of symbols. The most frequent
tokens form a short list; all other tokens are symbols of one of ``KINDS`` kinds (by ending), which
are grouped into tail classes. A token's probability is that of its class times that within its
class: a softmax over the members for short-list classes, smoothed corpus counts for tail classes
(unknown tokens share the smoothing mass). Classes come from the company that symbols keep in all
training documents.

Weights are fitted by truncated backpropagation over all training documents, each with its state
carried from its first token to its last. Training goes in rounds, each of which starts from the
averaged weights of the one before and uses twice its blocks, so the number of rounds grows with the
corpus. Scoring carries the state too, so a document's score is that of its whole text.

The gates are of the form (1 + s) / 2 with s = x / (1 + abs(x)), the candidate state is s itself.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, id_hash, release, table

END = b""
SHORT, COMPANIES, GROUP, CLASSES, KINDS, COMMON = 1000, 8, 96, 16, 2048, 48
HIDDEN, EMBED, WINDOW, STREAMS = 16, 12, 16, 256
#: Bytes of text whose dictionary is made at once; a block is what a task holds.
BLOCK_BYTES = 24_000_000
#: Bytes of symbols (two a token) that are trained on or scored at once.
TRAIN_BYTES, SCORE_BYTES = 5_000_000, 3_000_000
#: Rows of a softmax that are worked on at once (a matter of caches only).
ROWS = 1024
#: Passes over the block of the first round, which starts from counts alone, and the steps of Adam.
FIRST_PASSES, FIRST_RATE, RATE = 3, 0.01, 0.003


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ids of all tokens of texts without nulls, how many each has, and the dictionary that the ids are places in.

    Arrow's ASCII functions lower-case A-Z and split at U+0009 to U+000D and space only, whatever else a text holds."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = pa.concat_arrays([lists.flatten(), pa.array([""], texts.type)])  # the last is the end; others that are empty stand at a text's edges
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy()
    word, end = ids[:-1] != ids[-1], ids[-1]
    upto = np.r_[0, np.cumsum(word)][np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]]
    length = np.diff(upto) + 1
    out = np.full(length.sum(), end, np.int32)
    own = np.ones(len(out), bool)
    own[np.cumsum(length) - 1] = False
    out[own] = ids[:-1][word]
    return out, length, coded.dictionary.cast(pa.binary())


def kind(token: Column) -> Column:
    """A token's kind: a hash of the last two characters of its word and of the sign after it."""
    s = token.cast("string")
    core = F.rtrim(s, F.lit(".,;:!?*#$%&|"))
    sign = F.when(F.length(core) < F.length(s), F.right(s, F.lit(1))).otherwise("")
    return F.pmod(F.crc32(F.concat(F.right(core, F.lit(2)), F.lit("\n"), sign).cast("binary")), F.lit(KINDS)).cast("int")


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + abs(x)), in place."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


def by_gate(w: np.ndarray) -> np.ndarray:
    """(n, 3 * HIDDEN) to (3, n, HIDDEN): each gate's values lie together, which is what makes the small steps cheap."""
    return np.ascontiguousarray(w.reshape(len(w), 3, -1).transpose(1, 0, 2))


def all_gates(w: np.ndarray) -> np.ndarray:
    """The inverse of ``by_gate``."""
    return np.ascontiguousarray(w.transpose(1, 0, 2)).reshape(w.shape[1], -1)


class Model:
    """Classes and weights; pickled to the executors (some 300 KB).

    Symbols are places in the short list, or ``n_short`` + tail class."""

    def __init__(self, short_class: np.ndarray, end: int) -> None:
        self.n_short, self.end = len(short_class), end
        order = np.argsort(short_class, kind="stable")
        self.n_group = int(short_class.max()) + 1
        self.groups = [order[short_class[order] == c] for c in range(self.n_group)]
        slot = np.zeros(self.n_short, np.int64)
        for g in self.groups:
            slot[g] = np.arange(len(g))
        self.slot = slot
        self.members = order
        self.edges = np.r_[0, np.cumsum([len(g) for g in self.groups])].tolist()
        self.n_class = self.n_group + CLASSES
        self.class_of = np.r_[short_class, self.n_group + np.arange(CLASSES)].astype(np.int16)
        rng = np.random.default_rng(0)
        f = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        h = HIDDEN
        self.p = {
            "E": f(self.n_short + CLASSES, EMBED), "Wx": f(EMBED, 3 * h), "bx": np.zeros(3 * h, np.float32), "U": f(h, 3 * h),
            "Wc": f(h, self.n_class), "bc": np.zeros(self.n_class, np.float32), "Ws": f(self.n_short, h), "bs": np.zeros(self.n_short, np.float32),
        }

    def prime(self, counts: np.ndarray) -> None:
        """Biases from the counts of all symbols."""
        by_class = np.bincount(self.class_of, weights=counts, minlength=self.n_class)
        self.p["bc"] += np.log(by_class + 1.0).astype(np.float32) - np.float32(np.log(counts.sum() + 1.0))
        for g in self.groups:
            self.p["bs"][g] += (np.log(counts[g] + 1.0) - np.log(counts[g].sum() + 1.0)).astype(np.float32)

    def lay(self, docs: list[np.ndarray], streams: int) -> tuple[np.ndarray, ...]:
        """Inputs, targets and first-token marks step by step, the number of streams active at each step,
        and the place of each token of the documents in ``order``, whose lengths come last.

        Documents follow one another in at most ``streams`` streams, the longest first to the stream
        that is least full; streams stand by length, so that those still active come first."""
        loads = [(0, s) for s in range(min(streams, len(docs)))]
        own: list[list[int]] = [[] for _ in loads]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            n, s = loads[0]
            own[s].append(i)
            heapq.heapreplace(loads, (n + len(docs[i]), s))
        size = np.zeros(len(own), np.int64)
        for n, s in loads:
            size[s] = n
        rank = np.argsort(-size, kind="stable")
        order = [i for s in rank for i in own[s]]
        length = np.array([len(docs[i]) for i in order])
        y = np.concatenate([docs[i] for i in order]).astype(np.int32)
        first = np.zeros(len(y), bool)
        first[np.cumsum(length) - length] = True
        x = np.r_[np.int32(self.end), y[:-1]]
        x[first] = self.end
        size = size[rank]
        step = np.arange(len(y)) - np.repeat(np.cumsum(size) - size, size)
        active = np.bincount(step)
        to = (np.cumsum(active) - active)[step] + np.repeat(np.arange(len(size)), size)
        out = [np.empty(len(y), np.int32), np.empty(len(y), np.int32), np.empty(len(y), bool)]
        for a, v in zip(out, (x, y, first), strict=True):
            a[to] = v
        return (*out, active, to, np.array(order), length)

    def gates(self) -> np.ndarray:
        """What each input symbol adds to the three gates: (3, symbols, HIDDEN)."""
        return by_gate(self.p["E"] @ self.p["Wx"] + self.p["bx"])

    def run(self, x: np.ndarray, first: np.ndarray, active: np.ndarray, h: np.ndarray, gates: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each input of consecutive steps, and the last one."""
        k, u = HIDDEN, by_gate(self.p["U"])
        gx = np.take(gates, x, axis=1)
        out = np.empty((len(x), k), np.float32)
        off = np.r_[0, np.cumsum(active)]
        begins = np.flatnonzero(first)
        upto = np.searchsorted(begins, off).tolist()
        off = off.tolist()
        if keep is not None:
            keep.update({n: np.empty((len(x), k), np.float32) for n in "bcg"}, s=np.empty((2, len(x), k), np.float32), o=np.empty((2, len(x), k), np.float32), begins=begins, upto=upto, off=off)
        for t in range(len(active)):
            at, end = off[t], off[t + 1]
            h = h[: end - at]
            if upto[t] < upto[t + 1]:
                h = h.copy()
                h[begins[upto[t] : upto[t + 1]] - at] = 0
            g = np.matmul(h, u)
            s = squash(np.add(gx[:2, at:end], g[:2], out=None if keep is None else keep["s"][:, at:end]))
            rz = np.add(s, 1, out=None if keep is None else keep["o"][:, at:end])
            rz *= np.float32(0.5)
            c = np.multiply(rz[0], g[2], out=None if keep is None else keep["c"][at:end])
            c += gx[2, at:end]
            squash(c)
            if keep is not None:
                keep["b"][at:end], keep["g"][at:end] = h, g[2]
            d = h - c
            d *= rz[1]
            h = np.add(c, d, out=out[at:end])
        return out, h

    def log_probs(self, hs: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of P(class) and of the softmax within short-list classes, for flat targets."""
        p, n, k = self.p, len(hs), HIDDEN
        cls = np.take(self.class_of, ids)
        order = np.argsort(cls, kind="stable")
        cls = np.take(cls, order)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        bounds = np.searchsorted(cls, np.arange(self.n_group + 1)).tolist()
        x = np.ones((n, k + 1), np.float32)  # biases are weights of a last input of ones
        x[:, :k] = np.take(hs, order, axis=0)
        slot = np.take(self.slot, np.take(ids, order[: bounds[-1]]))
        wc, ws = np.r_[p["Wc"], p["bc"][None]], np.r_[p["Ws"].T, p["bs"][None]][:, self.members]
        shift = any((np.abs(w[:-1]).sum(0) + np.abs(w[-1])).max(initial=0) > 60 for w in (wc, ws))  # states are below 1, so this bounds all logits
        slopes = grads is not None
        gc, gs = np.zeros_like(wc), np.zeros_like(ws)
        lp, d = np.empty(n, np.float32), np.empty((n, k), np.float32) if slopes else None
        for lo in range(0, n, ROWS):
            hi = min(n, lo + ROWS)
            lp[lo:hi], dx, dw = self._softmax(x[lo:hi], wc, cls[lo:hi], shift, slopes)
            if slopes:
                d[lo:hi] = dx
                gc += dw
        for c, (a, b) in enumerate(zip(bounds, bounds[1:])):
            i, j = self.edges[c], self.edges[c + 1]
            if j - i < 2:
                continue
            for lo in range(a, b, ROWS):
                hi = min(b, lo + ROWS)
                part, dx, dw = self._softmax(x[lo:hi], ws[:, i:j], slot[lo:hi], shift, slopes)
                lp[lo:hi] += part
                if slopes:
                    d[lo:hi] += dx
                    gs[:, i:j] += dw
        if not slopes:
            return np.take(lp, back), None
        grads["Wc"], grads["bc"] = gc[:-1], gc[-1]
        grads["Ws"], grads["bs"] = np.empty_like(p["Ws"]), np.empty_like(p["bs"])
        grads["Ws"][self.members], grads["bs"][self.members] = gs[:-1].T, gs[-1]
        return np.take(lp, back), np.take(d, back, axis=0)

    @staticmethod
    def _softmax(x, w, target, shift, slopes):
        """Log probabilities of the targets, and if asked for, their negated slopes by inputs and by weights."""
        z = x @ w
        if shift:
            z -= z.max(1, keepdims=True)
        at = np.arange(len(x))
        lp = z[at, target]
        e = np.exp(z, out=z)
        s = e @ np.ones(w.shape[1], np.float32)
        lp -= np.log(s)
        if not slopes:
            return lp, None, None
        inv, wt = (1 / s)[:, None], np.ascontiguousarray(w[:-1].T)
        dx = e @ wt
        dx *= inv
        dx -= np.take(wt, target, axis=0)
        e[at, target] -= s
        return lp, dx, (x * inv).T @ e

    def train(self, docs: list[np.ndarray], rate: float) -> None:
        """One pass by Adam; the state is carried over whole documents, gradients over WINDOW steps."""
        p, k = self.p, HIDDEN
        total = sum(map(len, docs))
        x, y, first, active, *_ = self.lay(docs, max(32, min(STREAMS, total // 8192)))
        off = np.r_[0, np.cumsum(active)]
        m1 = {n: np.zeros_like(w) for n, w in p.items()}
        m2 = {n: np.zeros_like(w) for n, w in p.items()}
        h = np.zeros((active[0], k), np.float32)
        column = np.arange(EMBED)
        for step, lo in enumerate(range(0, len(active), WINDOW), 1):
            hi = min(len(active), lo + WINDOW)
            a, b = off[lo], off[hi]
            xs, keep, g = x[a:b], {}, {}
            hs, h = self.run(xs, first[a:b], active[lo:hi], h, self.gates(), keep)
            _, dh_all = self.log_probs(hs, y[a:b], g)
            before, c, (r, z) = keep["b"], keep["c"], keep["o"]
            slope = np.subtract(1, np.abs(keep["s"]), out=keep["s"])
            slope *= slope
            slope *= np.float32(0.5)
            to_r, to_z = np.multiply(keep["g"], slope[0], out=keep["g"]), before - c
            to_z *= slope[1]
            to_c = 1 - np.abs(c)
            to_c *= to_c
            to_c *= 1 - z
            ut = np.ascontiguousarray(by_gate(p["U"]).transpose(0, 2, 1))
            dgh, dcs = np.empty((3, b - a, k), np.float32), np.empty((b - a, k), np.float32)
            back, begins, upto, at = np.zeros((0, k), np.float32), keep["begins"], keep["upto"], keep["off"]
            for t in range(hi - lo - 1, -1, -1):
                i, j = at[t], at[t + 1]
                dh = dh_all[i:j]
                dh[: len(back)] += back
                dc = np.multiply(dh, to_c[i:j], out=dcs[i:j])
                np.multiply(dc, to_r[i:j], out=dgh[0, i:j])
                np.multiply(dh, to_z[i:j], out=dgh[1, i:j])
                np.multiply(dc, r[i:j], out=dgh[2, i:j])
                back, more, last = np.matmul(dgh[:, i:j], ut)
                back += more
                back += last
                back += dh * z[i:j]
                if upto[t] < upto[t + 1]:
                    back[begins[upto[t] : upto[t + 1]] - i] = 0
            g["U"] = all_gates((dgh.transpose(0, 2, 1) @ before).transpose(0, 2, 1))
            dgx = dgh
            dgx[2] = dcs
            dx, more, last = np.matmul(dgx, np.ascontiguousarray(by_gate(p["Wx"]).transpose(0, 2, 1)))
            dx += more
            dx += last
            g["E"] = np.bincount((xs[:, None] * EMBED + column).ravel(), weights=dx.ravel(), minlength=p["E"].size).reshape(p["E"].shape).astype(np.float32)
            g["Wx"], g["bx"] = all_gates(np.take(p["E"], xs, axis=0).T @ dgx), (np.ones(len(xs), np.float32) @ dgx).ravel()
            scale = np.float32(1 / len(xs))
            for name, dw in g.items():
                dw = np.clip(dw * scale, -1, 1)
                m1[name] += 0.1 * (dw - m1[name])
                m2[name] += 0.01 * (dw * dw - m2[name])
                p[name] -= rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-6)

    def score(self, docs: list[np.ndarray], streams: int = 1024, flush: int = 20_000) -> np.ndarray:
        """Natural log probability of each document without the share of its tail tokens' counts."""
        if not docs:
            return np.zeros(0)
        x, y, first, active, place, order, length = self.lay(docs, streams)
        gates, got = self.gates(), np.empty(len(y), np.float32)
        off = np.r_[0, np.cumsum(active)]
        h, lo = np.zeros((active[0], HIDDEN), np.float32), 0
        while lo < len(active):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + flush, "right")) - 1)
            a, b = off[lo], off[hi]
            hs, h = self.run(x[a:b], first[a:b], active[lo:hi], h, gates)
            got[a:b], _ = self.log_probs(hs, y[a:b])
            lo = hi
        sums = np.add.reduceat(got[place].astype(np.float64), np.cumsum(length) - length)
        out = np.empty(len(docs))
        out[order] = sums
        return out


def cluster(vectors: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Weighted k-means with farthest-first starts."""
    centre = [int(weight.argmax())] if len(vectors) else []
    near = np.full(len(vectors), np.inf)
    while centre and len(centre) < k:
        near = np.minimum(near, ((vectors - vectors[centre[-1]]) ** 2).sum(1))
        centre.append(int((near * weight).argmax()))
    c = vectors[centre]
    own = np.zeros(len(vectors), np.int64)
    for _ in range(rounds if centre else 0):
        own = ((vectors**2).sum(1)[:, None] - 2 * vectors @ c.T + (c**2).sum(1)).argmin(1)
        for j in range(k):
            if (own == j).any() and weight[own == j].sum() > 0:
                c[j] = np.average(vectors[own == j], axis=0, weights=weight[own == j])
    return own


def company(docs: list[np.ndarray], n: int, common: np.ndarray) -> np.ndarray:
    """(n, COMMON + 1): how often each symbol stands in documents of each most frequent common token (the last: of none)."""
    if not docs:
        return np.zeros((n, COMMON + 1))
    flat = np.concatenate(docs).astype(np.int64)
    own = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    at = common[flat]
    mix = np.bincount(own[at >= 0] * COMMON + at[at >= 0], minlength=len(docs) * COMMON).reshape(-1, COMMON)
    top = np.where(mix.any(1), mix.argmax(1), COMMON)
    return np.bincount(flat * (COMMON + 1) + top[own], minlength=n * (COMMON + 1)).reshape(n, -1).astype(float)


def classes(stats: np.ndarray, n_short: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each short-list word (at most GROUP words of like company) and the tail class of each kind."""
    n = stats.sum(1)
    mean = np.sqrt(stats / np.maximum(n, 1)[:, None])
    own = cluster(mean[:n_short], n[:n_short], COMPANIES)
    own[end] = COMPANIES
    short, k = np.zeros(n_short, np.int64), 0
    for c in range(COMPANIES + 1):
        at = np.flatnonzero(own == c)
        for lo in range(0, len(at), GROUP):
            short[at[lo : lo + GROUP]] = k
            k += 1
    return short, cluster(mean[n_short:], n[n_short:] + 1e-9, CLASSES)


def _chunks(batches, columns: list[str], size: int):
    """Lists of rows whose last column sums to about ``size`` in length."""
    rows, n = [], 0
    for b in batches:
        for r in zip(*(b[c] for c in columns), strict=True):
            rows.append(r)
            n += len(r[-1]) if r[-1] is not None else 0
            if n >= size:
                yield rows
                rows, n = [], 0
    if rows:
        yield rows


def _blocks(batches, size: int):
    """Record batches put together and cut after the row with which their texts reach ``size`` characters."""
    parts, n = [], 0
    for b in batches:
        upto, base, at = np.cumsum(pc.utf8_length(b.column("text")).to_numpy().astype(np.int64)), 0, 0
        while at < len(upto):
            cut = int(np.searchsorted(upto, base + size - n)) + 1
            parts.append(b.slice(at, cut - at))
            if cut > len(upto):
                n += int(upto[-1]) - base
                break
            yield pa.Table.from_batches(parts).combine_chunks()
            parts, n, base, at = [], 0, int(upto[cut - 1]), cut
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def _symbols(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16)


ROW = "a binary, w double"


def _row(a: np.ndarray, w: float) -> pd.DataFrame:
    return pd.DataFrame({"a": [np.asarray(a, np.float64).tobytes()], "w": [w]})


def combined(rows: DataFrame, fan_in: int = 16) -> tuple[np.ndarray | None, float]:
    """The sums of ``a`` (arrays of one length) and ``w`` of all rows: ``fan_in`` rows meet in a task, level by level."""

    def add(pdf):
        return _row(np.sum([np.frombuffer(a) for a in pdf["a"]], axis=0), pdf["w"].sum())

    rows = durable(rows, "sums")
    while (n := rows.count()) > fan_in:
        own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-n // fan_in * 2)))
        rows = durable(rows.groupBy(own).applyInPandas(add, ROW), "sums")
    found = rows.collect()
    if not found:
        return None, 0.0
    return np.sum([np.frombuffer(r.a) for r in found], axis=0), sum(r.w for r in found)


def score_texts(docs: DataFrame, held_out: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` has doc_id and text; ``held_out`` is a Column true for rows that teach nothing."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def index(batches):
        """Rows of texts as ids of their block's dictionary, and rows of that dictionary."""
        task = TaskContext.get().partitionId() * 2**24
        for k, rows in enumerate(_blocks(batches, block_bytes)):
            doc_id, held, text = (pa.concat_arrays(c.chunks) for c in rows.select(["doc_id", "held_out", "text"]).columns)
            ids, length, known = tokens(text)
            taught = ids[np.repeat(~held.fill_null(False).to_numpy(zero_copy_only=False), length)]
            n = np.bincount(taught, minlength=len(known))
            for lo in range(0, len(known), 100_000):
                hi = min(len(known), lo + 100_000)
                yield batch(hi - lo, block=np.full(hi - lo, task + k), token=known[lo:hi], local=np.arange(lo, hi, dtype=np.int32), n=n[lo:hi])
            upto = np.r_[0, np.cumsum(length)]
            for lo in range(0, len(doc_id), 1000):
                hi = min(len(doc_id), lo + 1000)
                at = (upto[lo : hi + 1] - upto[lo]) * 4
                data = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids[upto[lo] : upto[hi]])])
                yield batch(hi - lo, block=np.full(hi - lo, task + k), doc_id=doc_id[lo:hi], held_out=held[lo:hi], ids=data)

    types = pa.schema([("block", pa.int64()), ("doc_id", pa.string()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("token", pa.binary()), ("local", pa.int32()), ("n", pa.int64())])

    def batch(size, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in types], schema=types)

    schema = "block long, doc_id string, held_out boolean, ids binary, token binary, local int, n long"
    indexed = durable(docs.mapInArrow(index, schema), "indexed")
    words = indexed.where("token IS NOT NULL")
    total = words.groupBy("token").agg(F.sum("n").alias("c")).where("c > 0")
    total = durable(total.withColumn("kind", kind(F.col("token"))), "total")
    n, v = total.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = [(bytes(r.token), r.c) for r in total.orderBy(F.desc("c"), "token").limit(SHORT).collect()]
    short = [*(t for t in top if t[0] != END), (END, dict(top).get(END, 0))]
    n_short, end = len(short), len(short) - 1
    listed = spark.createDataFrame([(t, i) for i, (t, _) in enumerate(short)], "token binary, place int")

    # Symbols of each block's dictionary; tokens that no training text holds have none of ``total``.
    known = words.select("block", "local", "token").join(total, "token", "left").join(F.broadcast(listed), "token", "left")  # SHORT rows
    symbol = F.coalesce("place", F.coalesce("kind", kind(F.col("token"))) + n_short)
    known = known.select(F.col("block").alias("own"), "local", F.coalesce("c", F.lit(0)).alias("c"), symbol.alias("symbol"))

    def encode(left, right):
        symbol, log, seen = (np.empty(len(right), t) for t in (np.uint16, float, bool))
        at = right["local"].to_numpy()
        c = right["c"].to_numpy()
        symbol[at], log[at], seen[at] = right["symbol"].to_numpy(), np.log10(c + 1.0), c > 0
        rest = np.where(symbol >= n_short, log, 0.0)
        rows = []
        for data in left["ids"]:
            i = np.frombuffer(data, np.int32)
            rows.append((len(i), int(seen[i].sum()), float(log[i].sum()), float(rest[i].sum()), symbol[i].tobytes()))
        out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base", "rest", "symbols"])
        return pd.concat([left[["block", "doc_id", "held_out"]].reset_index(drop=True), out], axis=1)

    schema = "block long, doc_id string, held_out boolean, n_tokens long, n_known long, base double, rest double, symbols binary"
    texts = indexed.where("token IS NULL").select("block", "doc_id", "held_out", "ids")
    encoded = texts.groupBy("block").cogroup(known.groupBy("own")).applyInPandas(encode, schema)
    # Round r has some 2 ** r blocks, the last one the rest.
    n_blocks = words.select("block").distinct().count()
    n_rounds = max(1, int(math.log2(n_blocks + 1)))
    u = F.pmod(F.xxhash64("block"), F.lit(2**30)) / 2**30
    round_ = F.least(F.floor(F.log2(u * n_blocks + 1)), F.lit(n_rounds - 1)).cast("int")
    encoded = durable(encoded.withColumn("round", round_), "encoded", by="round")
    release(indexed)
    learn = encoded.where("NOT held_out")

    n_symbols = n_short + KINDS
    common = np.full(n_symbols, -1)
    common[: min(COMMON, end)] = np.arange(min(COMMON, end))

    def stats(batches):
        acc = np.zeros((n_symbols, COMMON + 1))
        for rows in _chunks(batches, ["symbols"], 2_000_000):
            acc += company([_symbols(r[0]) for r in rows], n_symbols, common)
        yield _row(acc, 1.0)

    acc, _ = combined(learn.select("symbols").mapInPandas(stats, ROW))
    acc = np.zeros((n_symbols, COMMON + 1)) if acc is None else acc.reshape(n_symbols, -1)
    short_class, tail = classes(acc, n_short, end)
    to_model = np.r_[np.arange(n_short), n_short + tail].astype(np.int32)
    model = Model(short_class, end)
    model.prime(np.bincount(to_model, weights=acc.sum(1), minlength=n_short + CLASSES))
    names = sorted(model.p)

    def fit(pdf_rows, sent, passes, rate):
        own = sent.value
        before = {k: w.copy() for k, w in own.p.items()}
        ids = [to_model[_symbols(s)] for s in pdf_rows]
        for _ in range(passes):
            own.train(ids, rate)
        flat = np.concatenate([own.p[k].ravel() for k in names]).astype(np.float64)
        own.p = before
        return flat, float(sum(map(len, ids)))

    started = False
    for r in range(n_rounds):
        sent = spark.sparkContext.broadcast(model)  # weights of fixed number
        passes, rate = (1, RATE) if started else (FIRST_PASSES, FIRST_RATE)

        def run(batches, sent=sent, passes=passes, rate=rate):
            acc, weight = 0.0, 0.0
            for rows in _chunks(batches, ["symbols"], TRAIN_BYTES):
                flat, size = fit([s for (s,) in rows], sent, passes, rate)
                acc, weight = acc + flat * size, weight + size
            if weight:
                yield _row(acc, weight)

        flat, weight = combined(learn.where(F.col("round") == r).select("symbols").mapInPandas(run, ROW))
        if flat is not None:
            started, at = True, 0
            for k in names:
                shape, m = model.p[k].shape, model.p[k].size
                model.p[k] = (flat[at : at + m] / weight).reshape(shape).astype(np.float32)
                at += m

    tail_total = np.ones(CLASSES)
    rest = total.join(F.broadcast(listed), "token", "left_anti").groupBy("kind").agg((F.sum("c") + F.count("*")).alias("n"))  # KINDS rows
    for r in rest.collect():
        tail_total[tail[r.kind]] += r.n
    final = spark.sparkContext.broadcast(model)
    log_n, log_tail = math.log10(n + v + 1), np.log10(tail_total)
    out = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(batches):
        m = final.value
        cols = ["doc_id", "held_out", "n_tokens", "n_known", "base", "rest", "symbols"]
        for rows in _chunks(batches, cols, SCORE_BYTES):
            ids = [to_model[_symbols(r[-1])] for r in rows]
            pdf = pd.DataFrame([r[:-1] for r in rows], columns=cols[:-1])
            own = [log_tail[i[i >= n_short] - n_short].sum() for i in ids]
            pdf["score"] = m.score(ids) / math.log(10) + pdf["rest"] - own
            yield pdf.assign(train_tokens=n, base_score=pdf["base"] - pdf["n_tokens"] * log_n)[out_names]

    out_names = [c.split()[0] for c in out.split(", ")]
    scored = encoded.select("doc_id", "held_out", "n_tokens", "n_known", "base", "rest", "symbols").mapInPandas(score, out)
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document. Null text counts as empty (only the end is scored); a null id has
    crc32 0; repeated rows give a row each; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, id_hash() % 7 == 2)
