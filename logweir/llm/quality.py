"""Operator 3: quality rules compiled into one Spark projection.

A rule is a row of a threshold table: a metric and the closed range in which a document is
acceptable. ``with_metrics`` computes every metric of a text in one projection and ``verdict``
compiles the table into a single boolean expression. No user functions run.

Defined cases: a null text is an empty text (no words, no lines with words; it fails the
base rule); metrics that divide take an empty denominator as zero; a repeated row gets the
same verdict as its twin; an empty table gives an empty table; other columns are kept or
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import SPACE, let, table, words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in that is with for be have it as on are this by from at or an was not "
    "le la les de des du et un une en que qui pour dans est par sur au pas il elle "
    "der die das und ist von zu den mit nicht ein eine auf im für dem sich auch es "
    "el los las del que y en un una para con por su al se lo como más no"
).split()
STOP_WORDS = tuple(dict.fromkeys(STOP_WORDS))

SYMBOLS = "[#*$%&|<>]"
BULLET_LINE = rf"^[{SPACE}]*[-*•‣▪][{SPACE}]"
ELLIPSIS_LINE = rf"(\.\.\.|…)[{SPACE}]*$"


@dataclass(frozen=True)
class Rule:
    """A metric must lie in [low, high]; None leaves a side open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The base rule, which every verdict includes.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Thresholds in the manner of published web-corpus filters.
RULES = (
    Rule("n_words", low=MIN_WORDS),
    Rule("mean_word_chars", low=2, high=15),
    Rule("symbol_ratio", high=0.1),
    Rule("n_stop_words", low=2),
    Rule("letter_word_ratio", low=0.7),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
)


def window_hash(*three: Column) -> Column:
    return F.xxhash64(*three)


#: Bits of a window's key that hold its start, by the most words they serve.
START_BITS = (16, 24, 32)


def _by_length(w: Column, of: Callable[[int], Column]) -> Column:
    """``of`` the start bits that the number of words needs."""
    small, wide, widest = START_BITS
    return F.when(F.size(w) <= 1 << small, of(small)).when(F.size(w) <= 1 << wide, of(wide)).otherwise(of(widest))


def _window_keys(w: Column) -> Column:
    """One long per 3-word window: its hash in the high bits, its start in the low ones."""
    key = lambda x, i: window_hash(x, F.get(w, i + 1), F.get(w, i + 2))
    packed = lambda bits: lambda x, i: F.shiftleft(F.shiftright(key(x, i), bits), bits).bitwiseOR(i.cast("long"))
    starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    return _by_length(w, lambda bits: F.transform(starts, packed(bits)))


def _repeated_starts(w: Column, s: Column) -> Column:
    """Starts of the windows that are found twice or more, from the sorted keys ``s``.

    Windows of one hash are neighbours. Where all neighbours of one hash have the same words,
    as in all but very few texts, those are the repeats; where some don't, the windows of the
    text are sorted again by their words.
    """
    none = F.lit([]).cast("array<bigint>")

    def of(bits: int) -> Column:
        start = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1))
        word = lambda x, k: F.get(w, start(x).cast("int") + k)
        hashed = lambda x, y: F.shiftright(x.bitwiseXOR(y), bits) == 0
        alike = lambda x, y: reduce(lambda a, b: a & b, [word(x, k) == word(y, k) for k in range(3)])
        found = F.filter(s, lambda x, j: hashed(x, F.get(s, j - 1)) | hashed(x, F.get(s, j + 1)))
        # 1 where a window has the hash of the one before it, 2 where its words differ all the same.
        kind = lambda x, y: F.when(hashed(x, y), F.when(alike(x, y), 1).otherwise(2)).otherwise(0)
        worst = F.coalesce(F.array_max(F.transform(s, lambda x, j: kind(x, F.get(s, j - 1)))), F.lit(0))
        return let(worst, lambda k: F.when(k == 0, none).when(k == 1, F.transform(found, start)))

    def by_words(t: Column) -> Column:
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        found = F.filter(t, lambda x, j: F.coalesce(same(x, F.get(t, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(t, j + 1)), F.lit(False)))
        return F.transform(found, lambda x: x["i"].cast("long"))

    starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    windows = F.transform(starts, lambda x, i: F.struct(x.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")))
    return F.coalesce(_by_length(w, of), let(F.sort_array(windows), by_words))


def with_metrics(docs: DataFrame, out: str = "__q") -> DataFrame:
    """``docs`` with every metric of ``text`` in a struct column ``out``.

    Columns starting with ``__`` are reserved. The words, the sorted windows and the lines
    are columns of their own below the final projection, so each is computed once a row. The
    condition on the row number always holds; it keeps a later filter from being pushed below
    the projection, which would evaluate these columns again inside every lambda.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    w, s, p, lines = (F.col(c) for c in ("__w", "__s", "__p", "__lines"))
    staged = (
        docs.select(*kept, words(t).alias("__w"))
        .select(
            *kept,
            "__w",
            F.sort_array(_window_keys(w)).alias("__s"),
            F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]"))).alias("__lines"),
        )
        .select(*kept, "__w", "__lines", F.sort_array(_repeated_starts(w, s)).alias("__p"))
    )
    n, n_lines = F.size(w).cast("long"), F.size(lines)
    chars = F.length(F.array_join(w, "")).cast("long")
    symbols = F.regexp_count(t, F.lit(SYMBOLS)).cast("long")
    letterless = F.size(F.filter(w, lambda x: F.rlike(x, F.lit(r"^\P{L}+$"))))
    dup = (n_lines - F.size(F.array_distinct(lines))).cast("long")
    count = lambda pattern: F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(pattern))))
    stop = F.array(*[F.lit(x) for x in STOP_WORDS])
    # Sorted starts of repeated windows cover min(3, distance to the next start) words each.
    spans = F.transform(p, lambda x, k: F.least(F.lit(3).cast("long"), F.get(p, k + 1) - x))
    return staged.select(
        *kept,
        F.when(F.monotonically_increasing_id() >= 0, F.struct(
            n.alias("n_words"),
            chars.alias("word_chars"),
            symbols.alias("n_symbols"),
            dup.alias("n_dup_lines"),
            F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
            F.size(F.array_intersect(F.split(F.lower(t), f"[{SPACE}]+"), stop)).cast("long").alias("n_stop_words"),
            ratio(chars, n).alias("mean_word_chars"),
            ratio(symbols, n).alias("symbol_ratio"),
            ratio(n - letterless, n).alias("letter_word_ratio"),
            ratio(dup, n_lines).alias("dup_line_ratio"),
            ratio(count(BULLET_LINE), n_lines).alias("bullet_line_ratio"),
            ratio(count(ELLIPSIS_LINE), n_lines).alias("ellipsis_line_ratio"),
        )).alias(out),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where the base rule and every row of the threshold table accept the metrics."""
    parts = [~base_failed(m)]
    for r in rules:
        parts += [] if r.low is None else [m[r.metric] >= F.lit(r.low)]
        parts += [] if r.high is None else [m[r.metric] <= F.lit(r.high)]
    return reduce(lambda a, b: a & b, parts)


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, every metric, base_failed, kept and the names of the failed metrics."""
    broken = [
        F.when(
            reduce(
                lambda a, b: a | b,
                ([] if r.low is None else [F.col("q")[r.metric] < F.lit(r.low)])
                + ([] if r.high is None else [F.col("q")[r.metric] > F.lit(r.high)]),
            ),
            F.lit(r.metric),
        )
        for r in rules
    ]
    return with_metrics(docs.select("doc_id", "text"), "q").select(
        "doc_id",
        "q.*",
        base_failed(F.col("q")).alias("base_failed"),
        verdict(F.col("q"), rules).alias("kept"),
        F.array_compact(F.array(*broken)).alias("failed_rules"),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the rules accept, with their columns as they came."""
    return with_metrics(docs).filter(verdict(F.col("__q"), rules)).drop("__q")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql_rules(rules: tuple[Rule, ...]) -> str:
    parts = [f"{r.metric} >= {r.low}" for r in rules if r.low is not None]
    parts += [f"{r.metric} <= {r.high}" for r in rules if r.high is not None]
    return " AND ".join(parts)


def quality_sql(source: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """The same verdicts by unnesting words and windows instead of folding arrays."""
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {source}),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^{SPACE}]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls FROM d),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(t, '[{SPACE}]+', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(list_distinct(list_filter(list_transform(w, lambda x: lower(x)), lambda x: x IN ({stop})))) AS n_stop_words,
             len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter,
             len(ls) AS n_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '{BULLET_LINE}'))) AS n_bullet,
             len(list_filter(ls, lambda x: regexp_matches(x, '{ELLIPSIS_LINE}'))) AS n_ellipsis
      FROM w LEFT JOIN rep ON rep.rid = w.rid),
r AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
             CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
             CASE WHEN n_words > 0 THEN n_letter / n_words ELSE 0 END AS letter_word_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
             CASE WHEN n_lines > 0 THEN n_bullet / n_lines ELSE 0 END AS bullet_line_ratio,
             CASE WHEN n_lines > 0 THEN n_ellipsis / n_lines ELSE 0 END AS ellipsis_line_ratio,
             n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_sql_rules(rules)} AS kept FROM r
"""
