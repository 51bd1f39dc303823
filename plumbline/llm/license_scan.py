"""License scans: fuzzy search for short notices.

Each notice allows k edits and is split into k + 1 seeds, one of which any match holds unchanged.
An automaton of all seeds finds candidates in one pass over the text; the regex library then
verifies each candidate's surroundings with at most k errors and reports the span.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Base phrases and labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices (words only), labels, and the edits allowed.
NOTICES = (
    ("released under the mit license", "mit", 1),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("gnu general public license", "gpl", 3),
    ("licensed under the gnu general public license version", "gpl", 5),
    ("gnu lesser general public license", "lgpl", 3),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("subject to the terms of the mozilla public license", "mpl", 4),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
    ("creative commons attribution", "cc-by", 2),
    ("licensed under cc by 4 0", "cc-by", 1),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("licensed under cc by sa", "cc-by-sa", 1),
)
#: Lower-cases A-Z and turns every separator of the contract into a space.
_CLEAN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def seeds(notice: str, edits: int) -> list[tuple[str, int]]:
    """The notice cut into ``edits + 1`` parts of nearly equal length, with their places."""
    n, k = len(notice), edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def matcher(notices=NOTICES):
    import ahocorasick
    import regex

    auto, at = ahocorasick.Automaton(), {}
    for i, (text, _, k) in enumerate(notices):
        for s, a in seeds(text, k):
            at.setdefault(s, []).append((i, a))
    for s, v in at.items():
        auto.add_word(s, (len(s), v))
    auto.make_automaton()
    patterns = [regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(t)}){{e<={k}}}(?![^ ])") for t, _, k in notices]
    return auto, patterns


def fuzzy(clean: str, notices=NOTICES) -> list[tuple[str, int, int, int, int]]:
    """(label, begin, end, edits, notice) of the notices in normalised text, at word bounds.

    A candidate's window reaches k characters past where the seed puts the notice's ends, and on to the
    next word bound, so it holds any match that the seed can be part of; overlapping windows of a notice are merged."""
    auto, patterns = matcher(notices)
    windows: dict[int, list[list[int]]] = {}
    for last, (n, places) in auto.iter(clean):
        for i, a in places:
            text, _, k = notices[i]
            lo, hi = last + 1 - n - a - k, last + 1 - n - a + len(text) + k
            lo = clean.rfind(" ", 0, max(0, lo)) + 1
            hi = clean.find(" ", hi) if clean.find(" ", hi) >= 0 else len(clean)
            own = windows.setdefault(i, [])
            if own and lo <= own[-1][1]:
                own[-1][1] = max(own[-1][1], hi)
            else:
                own.append([lo, hi])
    out = []
    for i, own in windows.items():
        for lo, hi in own:
            for m in patterns[i].finditer(clean, lo, hi):
                b, e = m.span()
                b, e = b + len(m[0]) - len(m[0].lstrip(" ")), e - len(m[0]) + len(m[0].rstrip(" "))
                if b < e:
                    out.append((notices[i][1], b, e, sum(m.fuzzy_counts), i))
    return out


def scan(text: str | None, notices=NOTICES) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of a text."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()
    clean = b" ".join(ws).decode("utf-8", "replace")
    starts, base, spans = [], set(), []
    if "license" in clean:
        for phrase, label in PHRASES.items():
            for m in re.finditer(rf"(?<![^ ]){phrase}(?![^ ])", clean):
                starts.append(clean.count(" ", 0, m.start()))
                base.add(label)
                spans.append((label, m.start(), m.end(), 0))
    found = fuzzy(clean, notices)
    labels = base | {f[0] for f in found}
    score = 1.0 if base else max((1 - f[3] / len(notices[f[4]][0]) for f in found), default=0.0)
    join = lambda s: ",".join(sorted(s))
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), join(base), join(labels), score, spans + [f[:4] for f in found]


SCHEMA = (
    "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,begin:int,end:int,edits:int>>"
)


def license_scan(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """One row per document, with spans (in the normalised text: words joined by one space)."""

    def run(batches):
        for b in batches:
            rows = [
                (d, *(r := scan(t if isinstance(t, str) else None, notices))[:7], [dict(zip(("label", "begin", "end", "edits"), s, strict=True)) for s in r[7]])
                for d, t in zip(b["doc_id"], b["text"], strict=True)
            ]
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document. Null and empty texts have no words, places or labels and score 0;
    repeated rows give a row each."""
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
