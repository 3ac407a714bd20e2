"""Quality rules as a short-circuit cascade, in DataFrame expressions alone.

A rule is a predicate over measures of a text. ``order_rules`` times every rule on a sample and
sees which rows it rejects there; the cascade then takes, one after the other, the rule that rejects
most per cost of what the rules before it leave, as one CASE, so that a row that an early rule
rejects never pays for the later ones. The order changes the cost only: a row is kept if and only
if no rule rejects it.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: a null text has no words and no lines with
words, so the word count rejects it; a very long text is judged whole, in one row; repeated rows
are judged each on its own; an empty table gives an empty result; other columns pass through
``filter_quality`` untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import written

WINDOW = 8
#: Names of the working columns; long, so that they don't clash with columns of the input.
TEXT, WORDS = "__quality_text", "__quality_words"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text.

    Window hashes come by doubling (two words, four, eight), so ``width`` is a power of two. Only a
    text with a repeated window is sorted: the start positions of its repeated windows cover
    ``width`` words each, less what the next one covers too.
    """

    def doubled(h: Column, step: int) -> Column:
        if step == width:
            return h
        ahead = F.size(h) - step
        pairs = F.zip_with(F.slice(h, 1, ahead), F.slice(h, step + 1, ahead), lambda a, b: F.xxhash64(a, b))
        return bind(pairs, lambda p: doubled(p, 2 * step)) if 2 * step < width else pairs

    def windows(h: Column) -> Column:
        return F.when(F.size(h) >= width, doubled(h, 1)).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = bind(
            ordered,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        first = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(starts, first, step, lambda acc: acc["n"])

    return bind(
        windows(hashes),
        lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)),
    ).cast("bigint")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def chars_of(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


#: Each measure from the text and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("bigint"),
    "word_chars": lambda text, words: F.length(F.concat_ws("", words)).cast("bigint"),
    "n_symbols": lambda text, words: chars_of(text, r"[#*$%&|<>]+"),
    "n_dup_lines": lambda text, words: bind(
        lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))
    ).cast("bigint"),
    "n_repeat_words": lambda text, words: bind(word_hashes(words), lambda h: repeated_words(h)),
    "n_lines": lambda text, words: F.size(lines_with_words(text)).cast("bigint"),
    "n_doubled": lambda text, words: F.size(
        F.filter(words, lambda w, i: F.coalesce(w == F.get(words, i - 1), F.lit(False)))
    ).cast("bigint"),
    "n_upper": lambda text, words: chars_of(text, r"\p{Lu}+"),
    "n_other": lambda text, words: chars_of(text, r"[^\p{L}\p{M}\x20\x09-\x0D]+"),  # vowel signs belong to letters
}
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

Measure = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measure], Column]


BASE_RULES = (
    Rule("too_few_words", lambda m: m("n_words") < 20),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
)
#: Thresholds of the rules beyond the base: shares in hundredths, so that all sums are integers.
METHOD_RULES = (
    Rule("word_length", lambda m: (m("word_chars") < 3 * m("n_words")) | (m("word_chars") > 12 * m("n_words"))),
    Rule("symbols", lambda m: 100 * m("n_symbols") > 10 * m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    Rule("doubled_words", lambda m: 100 * m("n_doubled") > 30 * m("n_words")),
    Rule("shouting", lambda m: 100 * m("n_upper") > 30 * m("word_chars")),
    Rule("few_letters", lambda m: 100 * m("n_other") > 30 * m("word_chars")),
)
RULES = BASE_RULES + METHOD_RULES


def expressions(text: Column, words: Column) -> Measure:
    return lambda name: MEASURES[name](text, words)


def over_words(text_col: str, body: Callable[[Measure], Column]) -> Column:
    """``body`` of the measures of a text. The words are bound to a variable: as a column of their
    own they would be split anew wherever Spark pushes the expression down as a filter."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return bind(split_words(text), lambda words: body(expressions(text, words)))


#: Rows and bytes of the sample that orders the rules, about; tasks that share it; how often a timed job repeats each row.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_TASKS, REPEATS = 1000, 16 << 20, 4, 4


def rule_sample(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` whole texts, or as many as have ``SAMPLE_BYTES`` bytes, drawn evenly from all partitions, dealt out evenly to ``SAMPLE_TASKS`` tasks."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    n, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    share = min(1.0, rows / max(1, n), SAMPLE_BYTES / max(1, size or 0))
    return texts.sample(share, seed=1).repartition(SAMPLE_TASKS)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules in the order of the cascade, as measured on a sample of about ``rows`` rows.

    Costs are the better of two timed jobs for each rule, less that of a job that only splits words.
    What a rule rejects counts only as far as the rules before it don't.
    """
    sample = written(rule_sample(docs, text_col, rows), "rule-sample")
    often = sample.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(rejects: Callable[[Measure], Column]) -> float:
        taken = []
        for _ in range(2):
            began = time.perf_counter()
            often.select(over_words("text", rejects).alias("c"), "turn").agg(F.count_if("c"), F.max("turn")).first()
            taken.append(time.perf_counter() - began)
        return min(taken)

    hits = sample.select(over_words("text", lambda m: F.array(*[r.rejects(m) for r in rules])).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    left = [(tuple(r["c"]), r["n"]) for r in hits.collect()]  # at most a row for each row of the sample
    idle = seconds(lambda m: m("n_words") < 0)
    cost = [max(seconds(rule.rejects) - idle, 0.001) for rule in rules]
    order, open_ = [], list(range(len(rules)))
    while open_:
        best = max(open_, key=lambda k: (sum(n for c, n in left if c[k]) / cost[k], -cost[k], -k))
        order.append(rules[best])
        open_.remove(best)
        left = [(c, n) for c, n in left if not c[best]]
    return order


def first_rejection(rules: list[Rule] | tuple[Rule, ...], measure: Measure) -> Column:
    """Name of the first rule in this order that rejects the row; null if none does."""
    chain = None
    for rule in rules:
        hit = rule.rejects(measure)
        chain = F.when(hit, rule.name) if chain is None else chain.when(hit, rule.name)
    return chain if chain is not None else F.lit(None).cast("string")


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns of the input."""
    chain = order_rules(docs, rules, text_col=text_col)
    return docs.where(over_words(text_col, lambda m: first_rejection(chain, m)).isNull())


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, the base measures, ``base_failed`` and ``kept``.

    The base measures are wanted for every row; the cascade runs over the other rules and stops
    at the first that rejects.
    """
    chain = order_rules(docs, METHOD_RULES, text_col=text_col)
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(TEXT)).withColumn(WORDS, split_words(F.col(TEXT)))
    measure = expressions(F.col(TEXT), F.col(WORDS))
    rows = rows.select(id_col, TEXT, WORDS, *[measure(m).alias(m) for m in BASE_MEASURES])
    known = lambda name: F.col(name) if name in BASE_MEASURES else measure(name)
    rows = rows.withColumn("base_failed", first_rejection(BASE_RULES, known).isNotNull())
    rejected = F.when(F.col("base_failed"), "base").otherwise(first_rejection(chain, known))
    return rows.select(id_col, *BASE_MEASURES, "base_failed", rejected.isNull().alias("kept"))


JUDGE_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i+7], ' ')) AS win
  FROM base, unnest(range(1, len(words) - 6)) AS t(i) WHERE len(words) >= 8
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, unnest(range(0, 8)) AS t(k) GROUP BY doc_id
), measured AS (
  SELECT b.doc_id, text, lines, words, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR word_chars < 3 * n_words OR word_chars > 12 * n_words
            OR 100 * n_symbols > 10 * n_words
            OR 100 * n_dup_lines > 50 * len(lines)
            OR 100 * len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) > 30 * n_words
            OR 100 * (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) > 30 * word_chars
            OR 100 * (length(text) - length(regexp_replace(text, '[^\p{L}\p{M}\x20\x09-\x0D]', '', 'g'))) > 30 * word_chars
       ) AS kept
FROM judged
"""
