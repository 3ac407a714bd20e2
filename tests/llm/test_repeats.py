"""Repeated stretches of words against a brute-force version, and on odd rows."""

from __future__ import annotations

import random
import re

import pytest

from gavel.llm import substring_dedup
from gavel.llm.substring_dedup import drop_repeats, repeat_report, super_kmers, windows

SIZE = 20


def brute(rows):
    """(words, removed, kept text) of each row; rows of equal id and text are one document."""
    seen, firsts = {}, {}
    for k, (i, text) in enumerate(rows):
        seen.setdefault((i, text), k)
    docs = [(i, text, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for i, text in seen]
    for i, text, words in docs:
        for s in range(len(words) - SIZE + 1):
            firsts.setdefault(tuple(words[s : s + SIZE]), []).append((i is None, i or 0, text, s))
    out = {}
    for i, text, words in docs:
        stays = [True] * len(words)
        for s in range(len(words) - SIZE + 1):
            # the order of rows that share an id is the operator's own, so these tests give them no window in common
            if min(firsts[tuple(words[s : s + SIZE])], key=lambda x: (x[0], x[1], x[3])) != (i is None, i or 0, text, s):
                stays[s : s + SIZE] = [False] * SIZE
        kept = [w for w, k in zip(words, stays, strict=True) if k]
        out[i, text] = (len(words), len(words) - len(kept), " ".join(kept))
    return [(i, *out[i, text]) for i, text in rows]


def corpus(rng):
    """Copies, shared passages in other surroundings, repeats within a text, runs of one word, shared ends."""
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passages = [words(n) for n in (20, 21, 35, 60, 120)]
    rows = []
    for k in range(120):
        text = words(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            text += rng.choice(passages)[rng.choice([0, 0, 3]) :] + words(rng.randrange(25))
        rows.append((k * 3 % 127, " ".join(text)))
    rows += [(200 + k, " ".join(passages[3])) for k in range(60)] + [(300 + k, "same " * (15 + k)) for k in range(15)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "a\x0bb\u00a0c d " * 30), (404, " ".join(passages[2] + passages[2] + passages[2][:19]))]
    rows += [(500, rows[0][1])] * 3 + [(None, rows[1][1])] * 3 + [(None, None)]
    return rows


@pytest.mark.parametrize(("hot", "map_bits", "piece"), [(4096, 28, 1 << 18), (3, 28, 64), (0, 0, 1 << 18)])
def test_repeats_match_brute_force(spark, hot, map_bits, piece, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MAP_BITS", map_bits)
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    rows = corpus(random.Random(11))
    want = sorted(brute(rows), key=str)
    got = repeat_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), hot=hot).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert 0 < sum(r[2] for r in want) < sum(r[1] for r in want)


def test_equal_windows_have_equal_minimisers():
    rng = random.Random(2)
    words = [b"w%d" % rng.randrange(3) for _ in range(3000)]
    first, n, mini = super_kmers(words)
    assert first[0] == 0 and (first[1:] == (first + n)[:-1]).all() and first[-1] + n[-1] == 3000 - SIZE + 1
    of = {}
    for s, k, m in zip(first.tolist(), n.tolist(), mini.tolist(), strict=True):
        own = windows(b" ".join(words[s : s + k + SIZE - 1]), k, SIZE)
        assert own == [b" ".join(words[a : a + SIZE]) for a in range(s, s + k)]
        for w in own:
            assert of.setdefault(w, m) == m


def test_clashing_columns_and_empty_tables(spark):
    text = " ".join(f"x{k}" for k in range(30))
    rows = [(1, text, 1, "a", 2, "o"), (2, "y " + text, None, None, None, None), (2, "y " + text, None, None, None, None), (None, text, 3, "c", 4, "p")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, id bigint, digest string, spans int, of string")
    kept = drop_repeats(odd)
    assert kept.columns == odd.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, text, 1, "a", 2, "o"), *[(2, "y", None, None, None, None)] * 2, (None, "", 3, "c", 4, "p")], key=str)
    assert drop_repeats(odd.where("false")).count() == 0
    named = spark.createDataFrame([("a", text), ("b", text)], "`doc id` string, `the text` string")
    assert sorted(map(tuple, repeat_report(named, "doc id", "the text").collect())) == [("a", 30, 0, text), ("b", 30, 30, "")]
    with pytest.raises(ValueError):
        drop_repeats(odd, size=4, gram=5)
