"""Operator 10: quality rules as a short-circuit cascade (DataFrame functions only).

``word_statistics`` computes the base counts of every text. ``cascade`` estimates, on a bounded
sample, what each rule costs and how much it rejects, orders the rules by rejection per cost and
evaluates them as one nested CASE, so that a text rejected by an early rule never pays for a later
one. The verdict is the conjunction of the rules, hence the same whatever order is chosen.

Defined results: a null or empty text, or one of white space alone, has no words, all counts 0 and
fails the base rules; a null doc_id is an ordinary value; repeated rows give repeated results;
columns beyond the text column are carried through untouched (names that clash with a result
column are replaced by it); an empty table gives an empty result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, free_prefix, quoted, scratch, settle

SYMBOLS = "#*$%&|<>"
#: Rows that the rules are measured on.
SAMPLE = 2000
#: Up to so many different repeated windows their places are found by membership, beyond by sorting.
FEW = 24


def word_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    Works within the row: no shuffle, linear memory in the text, n log n time at worst.
    """
    keep = [c for c in df.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    p = free_prefix(df)
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    d = df.select(*map(quoted, keep), t.alias(f"{p}t"), F.btrim(t, F.lit(SPACE_CHARS)).alias(f"{p}trim"))
    d = d.withColumn(f"{p}w", F.when(F.col(f"{p}trim") == "", F.array().cast("array<string>")).otherwise(F.split(f"{p}trim", f"{SPACE}+")))
    d = d.withColumn(
        f"{p}tri",
        F.when(
            F.size(f"{p}w") >= 3,
            F.transform(F.slice(f"{p}w", 1, F.size(f"{p}w") - 2), lambda w, i: F.xxhash64(w, F.get(f"{p}w", i + 1), F.get(f"{p}w", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    d = d.withColumn(f"{p}again", F.size(f"{p}tri") > F.size(F.array_distinct(f"{p}tri")))
    d = d.withColumn(f"{p}sorted", F.when(F.col(f"{p}again"), F.sort_array(f"{p}tri")))
    d = d.withColumn(
        f"{p}dups", F.when(F.col(f"{p}again"), F.array_distinct(F.filter(f"{p}sorted", lambda x, i: (i > 0) & (x == F.get(f"{p}sorted", i - 1)))))
    )
    d = d.withColumn(
        f"{p}pairs",
        F.when(F.size(f"{p}dups") > FEW, F.sort_array(F.transform(f"{p}tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    d = d.withColumn(
        f"{p}pos",
        F.when(
            F.size(f"{p}dups") > FEW,
            F.sort_array(
                F.transform(
                    F.filter(
                        f"{p}pairs",
                        lambda x, j: ((j > 0) & F.coalesce(x["h"] == F.get(f"{p}pairs", j - 1)["h"], F.lit(False)))
                        | F.coalesce(x["h"] == F.get(f"{p}pairs", j + 1)["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        ).when(
            F.col(f"{p}again"),
            F.filter(F.transform(f"{p}tri", lambda h, i: F.when(F.array_contains(f"{p}dups", h), i)), lambda x: x.isNotNull()),
        ),
    )
    covered = F.aggregate(
        F.transform(f"{p}pos", lambda x, k: F.least(F.lit(3), F.coalesce(F.get(f"{p}pos", k + 1) - x, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    d = d.withColumn(f"{p}lines", F.filter(F.split(f"{p}t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return d.select(
        *map(quoted, keep),
        F.size(f"{p}w").cast("long").alias("n_words"),
        F.length(F.translate(f"{p}t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(f"{p}t") - F.length(F.translate(f"{p}t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a text to reject; null counts as false."""

    name: str
    fails: Column


def default_rules(text: str = "text") -> list[Rule]:
    """Rules over a text and its ``word_statistics``; the limits spare ordinary prose of any language."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        Rule("mean_word_length", (F.col("word_chars") > 20 * n) | (F.col("word_chars") < 2 * n)),
        Rule("symbols_to_words", 10 * F.col("n_symbols") > 3 * n),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 5 * F.greatest(F.lit(2), F.regexp_count(t, F.lit("\n")) + 1)),
        Rule("shouting", 10 * F.regexp_count(t, F.lit(r"(?<![\p{L}\p{N}])\p{Lu}{2,}+(?![\p{L}\p{N}])")) > 6 * n),
        Rule("few_letters", 2 * F.length(F.regexp_replace(t, r"\P{L}+", "")) < F.col("word_chars")),
        Rule("bullet_lines", 10 * F.regexp_count(t, F.lit(r"(?md)^[ \t]*[-*•‣]")) > 9 * F.greatest(F.lit(2), F.regexp_count(t, F.lit("\n")) + 1)),
    ]


def bounded_sample(df: DataFrame, max_rows: int = SAMPLE, files: int = 4) -> DataFrame:
    """Up to ``max_rows`` rows from a few of a table's files, spread over the table; work does not grow with it."""
    names = sorted(df.inputFiles())
    if len(names) > files:
        chosen = [names[i * len(names) // files] for i in range(files)]
        chosen += [x.replace("file:///", "file:/", 1) for x in chosen]  # either notation of a local file
        try:
            # Spark skips the files that such a filter leaves out.
            return df.where(F.col("_metadata.file_path").isin(chosen)).limit(max_rows)
        except AnalysisException:  # not a plain scan any more
            pass
    return df.limit(max_rows)


def rank_rules(sample: DataFrame, rules: list[Rule], max_rows: int = SAMPLE, times: int = 3, copies: int = 4) -> list[tuple[Rule, float, float]]:
    """(rule, seconds per row, rejected share), best rejection per cost first.

    Each rule runs ``times`` times over ``copies`` copies of the settled sample; the least time less the least of a
    constant counts as its cost, and a cost below what the constant's own times vary by as that. ``max_rows``
    bounds the sample. It steers only the order of evaluation, never a verdict.
    """
    sample = settle(sample.limit(max_rows), "rules")
    p = free_prefix(sample)
    rows = sample.count()
    if not rows:
        return [(r, 0.0, 0.0) for r in rules]
    many = sample.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

    def timed(c: Column) -> tuple[list[float], int]:
        seconds = []
        for _ in range(times + 1):
            began = time.perf_counter()
            out = many.agg(F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias("n")).first()["n"]
            seconds.append(time.perf_counter() - began)
        return sorted(seconds[1:]), (out or 0) // copies  # the first run compiles

    base, _ = timed(F.lit(True))
    noise = max(base[-1] - base[0], 1e-4)
    seen = []
    for r in rules:
        s, n = timed(r.fails)
        seen.append((r, max(s[0] - base[0], noise) / (rows * copies), n / rows))
    return sorted(seen, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def cascade(df: DataFrame, rules: list[Rule], sample: DataFrame | None = None) -> DataFrame:
    """Add ``kept``: no rule rejects the row. The rules run in measured order and stop at the first that rejects."""
    verdict = F.lit(True)
    with scratch(df.sparkSession):
        ranked = rank_rules(bounded_sample(df) if sample is None else sample, rules)
    for r, _, _ in reversed(ranked):
        verdict = F.when(F.coalesce(r.fails, F.lit(False)), F.lit(False)).otherwise(verdict)
    return df.withColumn("kept", verdict)


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word_statistics``, ``base_failed`` and ``kept`` for each row."""
    stats = word_statistics(docs, text)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", base)
    rules = [Rule("base", F.col("base_failed")), *default_rules(text)]
    # The sample is drawn from the raw table, so that measuring does not compute the statistics of all rows.
    few = word_statistics(settle(bounded_sample(docs), "sample"), text).withColumn("base_failed", base)
    return cascade(stats, rules, sample=few)
