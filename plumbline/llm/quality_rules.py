"""Quality rules: base counts and Jensen-Shannon divergence from language references.

Main path in native expressions only. The histograms of character classes and of common words of
each document are compared with a reference of each language, which is the sum over all documents
of that language. A document is judged by its nearest language; texts below the minimum lengths
are not judged by divergence, as their histograms are mostly noise. As most words of any text are
not common ones, the bound of the word histogram is taken from each reference: its distance from
itself with only a tenth of its common words left, which is under one word in 50.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, whole_row
from .textstats import CLASSES, with_stats

#: Frequent function words of each language reference.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is"),
    "de": ("der", "die", "und", "den", "von", "das"),
    "fr": ("de", "la", "le", "et", "les", "des"),
    "es": ("que", "el", "en", "los", "se", "del"),
}
BINS = tuple(sorted({w for ws in COMMON.values() for w in ws}))
HIST_CLASSES = (*CLASSES, "other")


def _js(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root, base 2) of two arrays that each sum to one."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (half(a, b) + half(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def word_bound(ref: list[float], least: float) -> float:
    """Distance of a word reference from itself with ``least`` of its common words, the rest being other words."""
    few = [least * x for x in ref[:-1]]
    few.append(1 - sum(few))
    return math.sqrt(sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(few, ref, strict=True)) / 2)


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))


def quality_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts and both histograms (``h_class``, ``h_word``)."""
    df = with_stats(docs, text)
    df = df.withColumn("st_common", F.filter("st_words", lambda w: w.isin(*BINS)))
    ref = F.array(*(F.lit(w) for w in BINS))
    return df.withColumns(
        {
            "h_class": F.array(*(F.col(f"st_{c}").cast("double") for c in HIST_CLASSES)),
            "h_word": F.concat(
                F.transform(ref, lambda r: (F.size("st_common") - F.size(F.array_remove("st_common", r))).cast("double")),
                F.array((F.col("st_n_words") - F.size("st_common")).cast("double")),
            ),
        }
    )


def references(counts: DataFrame, lang: str = "lang", languages: tuple[str, ...] = tuple(COMMON)) -> dict:
    """The two reference histograms of each language that has documents, summed over all of them."""
    sums = lambda c, n: [F.sum(F.col(c)[i]).alias(f"{c}_{i}") for i in range(n)]
    rows = (
        counts.where(F.col(lang).isin(*languages))
        .groupBy(lang)
        .agg(*sums("h_class", len(HIST_CLASSES)), *sums("h_word", len(BINS) + 1))
        .collect()
    )  # one row a language of the list
    out = {}
    for r in rows:
        c, w = [[r[f"{k}_{i}"] for i in range(n)] for k, n in (("h_class", len(HIST_CLASSES)), ("h_word", len(BINS) + 1))]
        if sum(c) and sum(w):
            out[r[lang]] = ([x / sum(c) for x in c], [x / sum(w) for x in w])
    return out


def judge(
    counts: DataFrame, refs: dict, *, max_class: float = 0.25, least_common: float = 0.1, min_chars: int = 300, min_words: int = 50
) -> DataFrame:
    """Adds ``n_words``, the base counts, ``base_failed``, ``js_class``, ``js_word``, ``kept``."""
    lits = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    each = lambda h, k: F.array(*(_js(F.col(h), lits(r[k])) for r in refs.values()), F.lit(1.0))
    bounds = lits([*(word_bound(r[1], least_common) for r in refs.values()), 0])  # the 1.0 that stands for no reference is never near
    df = counts.withColumns({"h_class": _share(F.col("h_class")), "h_word": _share(F.col("h_word"))})
    df = df.withColumns({"js_class": F.array_min(each("h_class", 0)), "js_words": each("h_word", 1)})
    df = df.withColumns({"js_word": F.array_min("js_words"), "far": F.forall(F.zip_with("js_words", bounds, lambda d, b: d > b), lambda x: x)})
    n, r = F.col("st_n_words"), F.col("st_n_repeat_words")
    df = df.withColumn("base_failed", (n < 50) | (100 * r.cast("long") > 50 * n.cast("long")))
    odd = ((F.col("st_n_chars") >= min_chars) & (F.col("js_class") > max_class)) | ((n >= min_words) & F.col("far"))
    if not refs:
        odd = F.lit(False)
    return df.withColumn("kept", ~F.col("base_failed") & ~odd).drop("js_words", "far")


_SLIM = ("st_n_words", "st_n_chars", "st_space", "st_symbol", "st_n_dup_lines", "st_n_repeat_words", "h_class", "h_word")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document. Null text has no words and fails; a null or unlisted language only
    leaves the references unchanged; repeated rows each give a row; an empty table gives none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    slim = durable(quality_counts(docs).select("doc_id", "lang", *_SLIM), "op7")
    out = judge(slim, references(slim))
    long = lambda c, a: F.col(c).cast("long").alias(a)
    return out.select(
        "doc_id",
        long("st_n_words", "n_words"),
        (F.col("st_n_chars") - F.col("st_space")).cast("long").alias("word_chars"),
        long("st_symbol", "n_symbols"),
        long("st_n_dup_lines", "n_dup_lines"),
        long("st_n_repeat_words", "n_repeat_words"),
        "base_failed",
        "kept",
        "js_class",
        "js_word",
    )


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: the documents the rules keep, with their own columns only.

    The counts are stored beside the row's columns once, so that texts are scanned once. Null and empty texts go, as they
    have no words; a null language only leaves the references unchanged; repeated rows are judged alike."""
    wide = docs.select(whole_row(docs).alias("doc"), F.col("text"), F.col("lang"))
    slim = durable(quality_counts(wide).select("doc", "lang", *_SLIM), "op7-stage")
    return judge(slim, references(slim)).where("kept").select("doc.*")
