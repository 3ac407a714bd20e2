"""The pipeline's rows against a plain version of its five stages."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from test_near_copies import heads
from test_operators import ascii_lower, brute_lines, brute_measures, words_of

import corpus_pipeline
from gavel.llm.common import table, written
from gavel.llm.decontaminate import find_leaks


def rejected(text):
    n_words, chars, symbols, dup_lines, repeated = brute_measures(text)
    words, lines = words_of(text), [x for x in (text or "").split("\n") if words_of(x)]
    upper = sum(c.isupper() for c in text or "")
    other = sum(unicodedata.category(c)[0] not in "LM" and not re.match(r"[\x20\x09-\x0D]", c) for c in text or "")
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return (
        n_words < 20 or 100 * repeated > 30 * n_words or not 3 * n_words <= chars <= 12 * n_words or 100 * symbols > 10 * n_words
        or 100 * dup_lines > 50 * len(lines) or 100 * doubled > 30 * n_words or 100 * upper > 30 * chars or 100 * other > 30 * chars
    )


def holds_item(text, items):
    """Whether five-word runs of an item, at least half of them, stand in the text."""
    grams = lambda t: {tuple(w[k : k + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for k in range(len(w) - 4)}
    own = grams(text)
    return any(g and len(g & own) >= 0.5 * len(g) for g in map(grams, items))


def test_pipeline_matches_plain_stages(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    kept = [(i, t) for i, t in docs if not rejected(t)]
    kept = [(i, t) for i, _, _, t in brute_lines(kept)]
    alone = set(heads([(i, ascii_lower(t)) for i, t in kept]))  # five-word shingles, similarity 0.8 or more, all pairs
    kept = sorted((i, t) for (i, t) in kept if i in alone)
    kept = [(i, t) for i, t in kept if not holds_item(t, items)]
    want = []
    for i, text in kept:
        n = len(words_of(text))
        want += [(i, k, min(4096, n - 4096 * k)) for k in range(-(-n // 4096))] or [(i, None, 0)]
    got = [(r.doc_id, r.chunk, r.n_tokens) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert len(want) > 100
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def prose(rng, n):
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.randrange(10**6):x}".rstrip("0123456789") + rng.choice("aeiou") for _ in range(n))


def test_stages_as_a_chain_on_odd_rows(spark, sf_dir):
    rng = random.Random(21)
    whole, item = prose(rng, 400), table(spark, sf_dir, "benchmark").first().text
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, whole, "en", "a", 1), (4, whole, "en", "a", 1), (5, whole + " more", "en", "b", 2),
        (None, prose(rng, 300), None, None, None), (None, prose(rng, 300), "fr", "b", 3), (6, prose(rng, 200) + " " + item, "en", "b", 3), (7, prose(rng, 30_000), "en", "c", 1), (8, "same " * 100_000, "en", "c", 2),
    ]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), f"odd-{name}")
    got = sorted(((r.doc_id, r.chunk, r.n_tokens) for r in docs.collect()), key=str)
    # of rows equal in id and text one stays, and the near copy goes; rows without an id stay apart; the leak, the empty rows and the run go
    assert got == sorted([(4, 0, 400), (None, 0, 300), (None, 0, 300), *[(7, k, min(4096, 30_000 - 4096 * k)) for k in range(8)]], key=str)


def test_stages_as_a_chain_on_an_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), f"none-{name}")
        assert docs.count() == 0


def test_leak_ties(spark):
    bench = spark.createDataFrame([(1, "red river runs along nine old stone mills today"), (1, "red river runs along nine old stone mills today"), (2, "red river runs along nine old stone mills today")], "item_id bigint, text string")
    text = "we say red river runs along nine old stone mills today and again red river runs along nine old stone mills today"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "nothing of the kind")], "doc_id bigint, text string")
    got = find_leaks(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(i, j) for i in (1, None) for j in (1, 2)], key=str)
    # equal rows and items get equal places, in the first of the two stretches
    assert {(r.covered, r.answer_found, r.first_word // 9) for r in got} == {(1.0, True, 0)} and len({(r.cosine, r.first_word) for r in got}) == 1


@pytest.mark.parametrize("number", range(1, 14))
def test_every_operator_has_one_query(number):
    from gavel.llm.queries import QUERIES

    assert sum(name.startswith(f"op{number}_") for name in QUERIES) == 1
