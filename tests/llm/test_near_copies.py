"""The near-dedup stage against exact Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from gavel.llm import near_copies
from gavel.llm.simhash import components


def shingles(text):
    words = (text or "").split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def heads(docs):
    """Least id of each component of the pairs of similarity 0.8 or more."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                root[max(top(a), top(b))] = min(top(a), top(b))
    groups = {}
    for k, (i, _) in enumerate(docs):
        groups.setdefault(top(k), []).append(i)
    return sorted(min(x) for x in groups.values())


def edited(words, changes, rng):
    words = list(words)
    for k in range(changes):
        words[(k * len(words) // changes + rng.randrange(3)) % len(words)] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [1024, 4])
def test_near_dedup_stage_matches_exact_similarity(spark, sf_dir, block, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(30)]
    docs = [(0, ""), (1, ""), (2, "one two"), (3, "one two"), (4, None)]
    for n in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(25, 260))]
        # 0 to 12 changes put the similarities on both sides of 0.8; copies of copies make chains
        docs += [(len(docs) + k, edited(base, changes, rng)) for k, changes in enumerate([1, 2, 3, 5, 7, 9, 12])]
        docs.append((len(docs), " ".join(passage + base[:60])))
    near = [f"v{rng.randrange(5000)}" for _ in range(120)]
    docs += [(len(docs) + k, edited(near, 1 + k % 3, rng)) for k in range(40)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, table.repartition(3), sf_dir).collect())
    assert got == heads(docs)
    assert len(got) < len(docs) - 40  # there is much to remove


def test_one_row_stays_of_rows_that_share_an_id(spark, sf_dir):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text), (5, text), (6, text), (None, text + " a"), (None, "q r s t u v"), (None, "q r s t u v"), (5, "other words of the same id here")]
    got = near_copies.keep_one_of_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, text), (None, "q r s t u v"), (5, "other words of the same id here")], key=str)


def test_odd_rows_and_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, 7, "a"), (2, text + " more", 8, "b"), (3, None, None, None), (4, "", 9, "c"), (5, "w " * 200_000, 1, "d"), (5, "w " * 200_000, 1, "d")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, __k1 bigint, key string")
    got = near_copies.keep_one_of_near_copies(odd)
    assert got.columns == odd.columns
    assert sorted((r[0], r[2], r[3]) for r in got.collect()) == [(1, 7, "a"), (3, None, None), (5, 1, "d")]
    assert near_copies.keep_one_of_near_copies(odd.where("false")).count() == 0


def test_components_of_paths_and_stars(spark):
    paths = [(k, k + 1) for k in range(40)] + [(100 - k, 101 - k) for k in range(0, 9, 2)]
    stars = [(200, 200 + k) for k in range(1, 20)] + [(231 + k, 230) for k in range(5)] + [(300, 300)]
    edges = spark.createDataFrame(paths + stars, "a bigint, b bigint")
    got = dict(map(tuple, components(edges).collect()))
    want = {k: 0 for k in range(41)} | {k: 200 for k in range(200, 220)} | {k: 230 for k in range(230, 236)}
    for k in range(0, 9, 2):
        want |= {100 - k: 100 - k, 101 - k: 100 - k}
    assert got == want


def test_names_that_unlike_sets_share_are_replaced(spark):
    rows = [(1, 1, 1, 7, 100, [5]), (2, 2, 2, 7, 200, [6]), (3, 3, 3, 7, 200, [6]), (4, 4, 4, 8, 300, []), (5, 5, 5, 8, 300, [])]
    got = {r.id: r.name for r in near_copies.told_apart(spark.createDataFrame(rows, "k1 bigint, k2 bigint, id bigint, name bigint, mark bigint, keys array<bigint>")).collect()}
    assert got[1] != got[2] == got[3] and got[4] == got[5] == 8 and 7 not in got.values()


def test_a_run_leaves_only_its_result(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr("gavel.llm.common.shared_dir", lambda spark: f"file://{tmp_path}")
    found = corpus_pipeline.run(spark, sf_dir)
    assert [p.name.rpartition("-")[0] for p in tmp_path.iterdir()] == ["stage-packing"]
    assert found.count() > 0
