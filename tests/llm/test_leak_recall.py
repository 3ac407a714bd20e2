"""Recall of decontamination in prose of the given table: by length, frequent or rare words, whole or altered."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from gavel.llm.common import table
from gavel.llm.decontaminate import COVERED, bit_masks, common_words, find_leaks

LENGTHS = (4, 6, 8, 12, 20, 40)
ITEMS, TEXTS = 8, 24


def altered(item, form, rng, rare):
    """The item as it is, without a quarter of its words, or so with a rare word after each."""
    if form == "whole":
        return list(item)
    gone = set(rng.choice(len(item), len(item) // 4, replace=False).tolist())
    kept = [w for k, w in enumerate(item) if k not in gone]
    return kept if form == "dropped" else [x for w in kept for x in (w, rare[int(rng.integers(len(rare)))])]


@pytest.fixture(scope="module")
def recall(spark, sf_dir):
    """Found share of the planted texts of each (words, form, length)."""
    rng = np.random.default_rng(17)
    prose = [r.text.lower().split() for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect() if r.text and len(r.text.split()) > 60]
    counts = Counter(w for x in prose for w in set(x) if w.isalpha())
    ranked = [w for w, _ in counts.most_common()]
    kinds = {"frequent": ranked[:60], "rare": [w for w in ranked if counts[w] <= 3]}
    unseen = [f"zz{k}qx" for k in range(5000)]
    items, texts, cells = [], [], {}
    for kind, words in kinds.items():
        for n in LENGTHS:
            own = [[words[k] for k in rng.integers(0, len(words), n)] for _ in range(ITEMS)]
            for form in ("whole", "dropped", "diluted"):
                for k in range(TEXTS):
                    planted = altered(own[k % ITEMS], form, rng, unseen)
                    assert common_words(bit_masks(own[k % ITEMS]), n, planted) >= COVERED * n
                    base = prose[int(rng.integers(len(prose)))][:400]
                    at = int(rng.integers(len(base)))
                    cells.setdefault((kind, form, n), []).append((len(texts), len(items) + k % ITEMS))
                    texts.append((len(texts), " ".join([*base[:at], *planted, *base[at:]])))
            items += own
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(8)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    return {cell: sum(p in found for p in pairs) / len(pairs) for cell, pairs in cells.items()}


def test_no_item_that_stands_word_for_word_is_lost(recall):
    assert {cell: x for cell, x in recall.items() if cell[1] == "whole" and x < 1} == {}


def test_altered_items_are_found(recall):
    print(recall)
    assert {cell: x for cell, x in recall.items() if x < 0.9} == {}
