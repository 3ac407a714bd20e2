"""Generated claims: prompts, an injected text generator, claims with their source, review report."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions.scalars import filled, natural_id, prefix
from gavel.schemas import REVIEW_BILLS

PROMPT_CHARS = 12_000
Generator = Callable[[str], str]


def unclaimed(bills: DataFrame, claims: DataFrame) -> DataFrame:
    """Bills that have a description and no claim yet."""
    known = claims.select(F.col("bill_entity_id").alias("entity_id"))
    return bills.where(filled(F.col("description")).isNotNull()).join(known, "entity_id", "left_anti")


def prompts(bills: DataFrame, templates: Mapping[str, str], text: str = "description") -> DataFrame:
    """(entity_id, claim_type, prompt): a row for each bill and template.

    Templates name ``{bill_number}``, ``{title}`` and ``{bill_text}``, the text cut to ``PROMPT_CHARS``.
    """
    kinds = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])
    rows = bills.select("entity_id", "bill_number", "title", prefix(F.col(text), PROMPT_CHARS).alias("bill_text"), F.explode(kinds).alias("claim_type", "template"))
    prompt = F.col("template")
    for name in ("bill_number", "title", "bill_text"):
        prompt = F.replace(prompt, F.lit("{" + name + "}"), F.coalesce(F.col(name), F.lit("")))
    return rows.select("entity_id", "claim_type", prompt.alias("prompt"))


def generated(asked: DataFrame, make: Callable[[], Generator]) -> DataFrame:
    """(entity_id, claim_type, text, error): a failing prompt keeps its error and fails nothing else.

    ``make`` builds the generator once for each task. A task may run twice, so a generator has to
    be idempotent for the same prompt.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make()
        for part in batches:
            texts, errors = [], []
            for prompt in part["prompt"]:
                try:
                    text, error = generator(prompt), None
                except Exception as problem:  # whatever the service raises
                    text, error = None, f"{type(problem).__name__}: {problem}"
                texts.append(text)
                errors.append(error)
            yield part[["entity_id", "claim_type"]].assign(text=texts, error=errors)

    return asked.mapInPandas(run, "entity_id string, claim_type string, text string, error string")


def stored(made: DataFrame, sources: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Claims and their links to the one source of their bill; a bill with any error gets neither.

    ``sources`` has (entity_id, source_id).
    """
    failed = made.where(F.col("error").isNotNull()).select("entity_id").distinct()
    good = made.join(failed, "entity_id", "left_anti").join(sources, "entity_id")
    key = natural_id(F.col("entity_id"), F.col("claim_type"), F.lit(model))
    claims = good.select(key.alias("id"), F.col("entity_id").alias("bill_entity_id"), "claim_type", F.col("text").alias("claim_text"), F.lit(f"llm:{model}").alias("generated_by"))
    return claims, good.select(key.alias("claim_id"), "source_id")


def outcome(made: DataFrame) -> DataFrame:
    """(succeeded, failed) in bills."""
    by_bill = made.groupBy("entity_id").agg(F.bool_or(F.col("error").isNotNull()).alias("failed"))
    return by_bill.agg(F.count_if(~F.col("failed")).alias("succeeded"), F.count_if("failed").alias("failed"))


def review_lines(bills: DataFrame, made: DataFrame) -> DataFrame:
    """(bill_number, report): a Markdown section per bill, with at most 500 characters of its text."""
    answers = made.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("claim_type", F.coalesce("text", F.concat(F.lit("error: "), "error")).alias("text")))).alias("answers"))
    quote = F.concat(prefix(F.col("bill_text"), 500), F.when(F.length("bill_text") > 500, "...").otherwise(""))
    listed = F.array_join(F.transform("answers", lambda a: F.concat(F.lit("**"), a["claim_type"], F.lit(":** "), a["text"])), "\n\n")
    section = F.concat_ws("\n\n", F.concat(F.lit("## "), "bill_number", F.lit(": "), "title"), F.concat(F.lit("> "), quote), listed)
    return bills.join(answers, "entity_id").select("bill_number", section.alias("report"))


def review_bills(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(entity_id, bill_number, title, bill_text) of bills that are to be reviewed: a JSON file with one list, or with a bill on each of its ``lines``."""
    rows = spark.read.schema(REVIEW_BILLS).option("multiLine", not lines).json(path)
    return rows.select(natural_id(F.col("bill_number"), F.col("title")).alias("entity_id"), "*")


VERDICT = "**Verdict:** [ ] accurate  [ ] change the prompt  [ ] reject"


def review_report(bills: DataFrame, made: DataFrame, model: str) -> DataFrame:
    """(place, bill_number, report): a header that tells the model and how many bills come, then a section for each bill."""
    said = [F.concat(F.lit(f"# Review of summaries\n\nModel: {model}\nBills: "), F.count(F.lit(1)).cast("string"), F.lit("\n\nCompare each answer with its text: invented facts, missing provisions, judgements of value."))]
    head = bills.agg(F.lit(0).alias("place"), F.lit("").alias("bill_number"), said[0].alias("report"))
    sections = review_lines(bills, made).select(F.lit(1).alias("place"), "bill_number", F.concat_ws("\n\n", "report", F.lit(VERDICT)).alias("report"))
    return head.unionByName(sections)


def review_run(spark: SparkSession, path: str, out: str, templates: Mapping[str, str], make: Callable[[], Generator], model: str) -> None:
    """From a JSON file of bills to a folder of text files that hold the report in the order of their names."""
    bills = review_bills(spark, path)
    asked = prompts(bills, templates, text="bill_text")
    report = review_report(bills, generated(asked, make), model)
    report.orderBy("place", "bill_number").select(F.concat("report", F.lit("\n\n---\n")).alias("value")).write.mode("overwrite").text(out)
