"""Per-document text statistics as native column expressions (no Python on executors)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS

#: Character classes in the order in which they are peeled off; "other" is what is left.
CLASSES = ("lower", "space", "accent", "upper", "digit", "stop", "symbol", "punct")
_PEEL = {
    "accent": r"[\x{C0}-\x{24F}]+",
    "upper": r"[A-Z]+",
    "digit": r"[0-9]+",
    "stop": r"[.,]+",
    "symbol": r"[#*$%&|<>]+",
    "punct": r"[\x21-\x7E]+",
}
_BLANK = "concat(' ', decode(unhex('090A0B0C0D'), 'UTF-8'))"


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``st_*`` columns to ``df`` and keeps every other column.

    ``st_n_chars``, ``st_<class>`` for each of CLASSES and ``st_other`` (code points),
    ``st_words`` (the word array), ``st_n_words``, ``st_n_lines``, ``st_n_dup_lines``
    (lines holding a word that equal an earlier line) and ``st_n_repeat_words`` (words covered
    by 3-word windows found at least twice). Null text counts as empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("st_text", F.expr(f"trim(BOTH {_BLANK} FROM coalesce({text}, ''))"))
    df = df.withColumn(
        "st_words", F.when(F.col("st_text") == "", F.array().cast("array<string>")).otherwise(F.split("st_text", WS))
    ).drop("st_text")
    df = df.withColumns({"st_n_chars": F.length(t), "st_n_words": F.size("st_words")})
    df = df.withColumn("st_space", F.col("st_n_chars") - F.length(F.array_join("st_words", "")))
    # Lower case and white space go in one pass, as runs of both are long; the rest sees little text.
    df = df.withColumn("st_left", F.regexp_replace(t, r"[a-z\x20\x09-\x0D]+", ""))
    df = df.withColumn("st_lower", F.col("st_n_chars") - F.length("st_left") - F.col("st_space"))
    for name, pattern in _PEEL.items():
        df = df.withColumn("st_next", F.regexp_replace("st_left", pattern, ""))
        df = df.withColumn(f"st_{name}", F.length("st_left") - F.length("st_next"))
        df = df.drop("st_left").withColumnRenamed("st_next", "st_left")
    df = df.withColumn("st_other", F.length("st_left")).drop("st_left")
    df = df.withColumn("st_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns(
        {
            "st_n_lines": F.size("st_lines"),
            "st_n_dup_lines": F.size("st_lines") - F.size(F.array_distinct("st_lines")),
        }
    ).drop("st_lines")
    # Hashes of word pairs, then of neighbouring pairs: those of the 3-word windows, in order.
    # Only texts in which one repeats are sorted.
    pairs = lambda c, f: F.expr(
        f"zip_with(slice({c}, 1, greatest(size({c}) - 1, 0)), slice({c}, 2, greatest(size({c}) - 1, 0)), (a, b) -> {f})"
    )
    df = df.withColumn("st_pair", pairs("st_words", "xxhash64(a, b)"))
    df = df.withColumn("st_win", pairs("st_pair", "xxhash64(a, b)")).drop("st_pair")
    df = df.withColumn("st_n_win_distinct", F.size(F.array_distinct("st_win")))
    df = df.withColumn(
        "st_sorted",
        F.expr(
            "CASE WHEN size(st_win) > st_n_win_distinct THEN "
            "sort_array(transform(st_win, (h, i) -> struct(h, i))) END"
        ),
    ).drop("st_win")
    df = df.withColumn(
        "st_at",
        F.expr(
            "sort_array(transform(filter(st_sorted, (s, k) -> (k > 0 AND st_sorted[k - 1].h = s.h) OR "
            "(k + 1 < size(st_sorted) AND st_sorted[k + 1].h = s.h)), s -> s.i))"
        ),
    ).drop("st_sorted")
    # Windows start at st_at; each adds three words less those shared with the next one.
    return df.withColumn(
        "st_n_repeat_words",
        F.expr(
            "coalesce(aggregate(transform(st_at, (p, k) -> CASE WHEN k + 1 < size(st_at) "
            "THEN least(3, st_at[k + 1] - p) ELSE 3 END), 0, (a, x) -> a + x), 0)"
        ),
    ).drop("st_at")
