"""Quality rules with thresholds that follow each language and source, from mergeable quantile sketches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datasteward.llm.common import drop_table, window_hashes, word_hashes, write_table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SIGNALS = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_lines:long,n_repeat_words:long>"
#: metric: (numerator, denominator, least spread, whether low values are rejected too). A spread below the least counts as
#: the least, so that a group of equal documents does not reject the first that differs.
METRICS = {"symbols_per_word": ("n_symbols", "n_words", 0.04, False),
           "repeat_share": ("n_repeat_words", "n_words", 0.04, False),
           "dup_line_share": ("n_dup_lines", "n_lines", 0.07, False),
           "word_length": ("word_chars", "n_words", 0.8, True)}


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words inside windows of n words that occur twice or more, the first occurrence included."""
    if len(words) <= n:
        return 0
    h = window_hashes(word_hashes(words), n)
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, np.flatnonzero(again), 1)
    np.add.at(steps, np.flatnonzero(again) + n, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def signals_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words); null counts as empty text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), len(lines), repeated_words(words))


def _signals(texts: pa.Array) -> pa.Array:
    rows = [signals_of(t.as_py()) for t in texts]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    pa.default_memory_pool().release_unused()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def signals(text) -> F.Column:
    """The signals of a text column as one struct; whole texts, one Arrow batch at a time."""
    # not deterministic to the optimizer, which else computes them once more below every filter
    return F.arrow_udf(_signals, SIGNALS).asNondeterministic()(text)


def base_failed():
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _ratios():
    return [F.when(F.col(d) > 0, F.col(n) / F.col(d)).alias(m) for m, (n, d, _, _) in METRICS.items()]


def quantile_sketches(signal_rows: DataFrame, error: float = 0.01) -> DataFrame:
    """(lang, source, metric, cell, n): a logarithmic histogram per language, source and metric with a bounded relative
    error. Sketches of parts merge by adding n per cell, which Spark does before and after the shuffle, so neither a hot
    source nor the number of documents makes a sketch large. Documents that the base rules reject are left out."""
    gamma = math.log((1 + error) / (1 - error))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    return (signal_rows.filter(~base_failed()).select("lang", "source", *_ratios())
            .select("lang", "source", pairs.alias("p")).select("lang", "source", "p.*").filter("value is not null")
            .withColumn("cell", F.when(F.col("value") < 1e-6, F.lit(-100000))
                        .otherwise(F.ceil(F.log("value") / gamma)).cast("int"))
            .groupBy("lang", "source", "metric", "cell").agg(F.count(F.lit(1)).alias("n")))


def thresholds(sketches: DataFrame, error: float = 0.01, reach: float = 4.0, least_docs: float = 1.0) -> DataFrame:
    """(lang, source, metric, low, high): the median of the group minus and plus ``reach`` times its distance to the
    quartile on that side, which counts as twice the distance on the other side at most: junk that fills a quarter of a
    group moves the quartile on its own side only, and does not widen the fence by it. The median and quartiles of a group
    of n documents are blended with those of its language by weights n and ``least_docs``, and those of a language with
    those of all documents in the same way, so no size switches from one fence to another."""
    scale = (1 + error) / (1 - error)
    tops = sketches.groupBy("metric", "cell").agg(F.sum("n").alias("n")).select(
        F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"),
        "metric", "cell", "n")
    middles = sketches.groupBy("lang", "metric", "cell").agg(F.sum("n").alias("n")).select(
        F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "metric", "cell", "n")
    every = sketches.select(F.lit(0).alias("level"), "lang", "source", "metric", "cell", "n").unionAll(middles).unionAll(tops)
    group = Window.partitionBy("level", "lang", "source", "metric")
    ranked = (every.withColumn("upto", F.sum("n").over(group.orderBy("cell")))
              .withColumn("all", F.sum("n").over(group))
              .withColumn("value", F.when(F.col("cell") == -100000, 0.0)
                          .otherwise(F.pow(F.lit(scale), F.col("cell")) * 2 / (scale + 1))))

    def at(q):
        return F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("value")))
    marks = ranked.groupBy("level", "lang", "source", "metric").agg(
        F.max("all").alias("docs"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    own = marks.filter("level = 0").alias("a")
    lang = marks.filter("level = 1").alias("b")
    top = marks.filter("level = 2").alias("c")

    def blended(q):
        def part(side, parent):
            n = F.col(f"{side}.docs")
            return (n * F.col(f"{side}.{q}") + least_docs * parent) / (n + least_docs)
        return part("a", part("b", F.col(f"c.{q}"))).alias(q)
    marks = (own.join(lang, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.metric") == F.col("b.metric")))
             .join(top, F.col("a.metric") == F.col("c.metric"))
             .select("a.lang", "a.source", "a.metric", *[blended(q) for q in ("q1", "q2", "q3")]))
    spread = F.create_map(*[x for m, v in METRICS.items() for x in (F.lit(m), F.lit(v[2]))])[F.col("metric")]
    two_sided = F.col("metric").isin([m for m, v in METRICS.items() if v[3]])
    below, above = F.col("q2") - F.col("q1"), F.col("q3") - F.col("q2")
    return marks.select("lang", "source", "metric",
                        F.when(two_sided, F.col("q2") - reach * F.greatest(F.least(below, 2 * above), spread)).alias("low"),
                        (F.col("q2") + reach * F.greatest(F.least(above, 2 * below), spread)).alias("high"))


def judged(signal_rows: DataFrame, fences: DataFrame) -> DataFrame:
    """``signal_rows`` with base_failed and kept: every metric inside the fences of the row's language and source."""
    wide = fences.groupBy(F.col("lang").alias("l_"), F.col("source").alias("s_")).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high")))).alias("fence_"))  # four entries
    out = signal_rows.join(wide, F.col("lang").eqNullSafe(F.col("l_")) & F.col("source").eqNullSafe(F.col("s_")), "left")
    inside = F.lit(True)
    for m, ratio in zip(METRICS, _ratios(), strict=True):
        fence = F.col("fence_")[m]
        inside = inside & F.coalesce((ratio <= fence["high"]) & (fence["low"].isNull() | (ratio >= fence["low"])), F.lit(True))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside).drop("l_", "s_", "fence_")


def quality_rules(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, lang, source, signals, base_failed, kept) for every row of ``docs``.

    The texts are read once; the signals are written and serve both the sketches and the verdicts. Null and empty texts
    have no words and fail the base rule. A null language or source is a group of its own. Repeated rows count each."""
    rows = write_table(docs.select("doc_id", "lang", "source", signals("text").alias("q")).select("doc_id", "lang", "source", "q.*"))
    sketches = write_table(quantile_sketches(rows))
    return judged(rows, thresholds(sketches, **params))


def quality_filter(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged, repeated rows included."""
    names = docs.columns
    packed = docs.select("lang", "source", F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"), signals("text").alias("q"))
    rows = packed.select("lang", "source", "q.*")
    sketches = write_table(quantile_sketches(rows))
    fences = write_table(thresholds(sketches, **params))
    drop_table(sketches)
    return judged(packed.select("row_", "lang", "source", "q.*"), fences).filter("kept").select("row_.*")
