"""The learned operators against plain versions of themselves: loops over bytes, dicts of weights, whole matrices."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gavel.llm import language_id, quality_classifier, toxicity
from gavel.llm.common import remainder, table, utf8
from gavel.llm.license_scan import scan_licenses
from gavel.llm.packing import pack


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").collect()]


def lowered(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


# op1


def plain_probabilities(net, window):
    """The network as it is written down: embed, convolve, rectify, take maxima, one dense layer, softmax."""
    e = [net.embedding[b].astype(float) for b in window]
    maxima, k = [], 0
    for width in language_id.WIDTHS:
        for f in range(language_id.FILTERS):
            responses = [sum(float(e[i + j] @ net.filters[width][j][:, f]) for j in range(width)) for i in range(len(e) - width + 1)]
            maxima.append(max(0.0, max(responses) + float(net.bias[k])))
            k += 1
    logits = np.array(maxima) @ net.dense.astype(float) + net.dense_bias
    raised = np.exp(logits - logits.max())
    return raised / raised.sum()


def test_language_scores_match_the_plain_network(spark, sf_dir, rows):
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs, remainder("doc_id", 4) != 2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, net).collect()}
    some = [*rows[::23], min(rows, key=lambda r: len(r[1] or "") or 10**9)]
    for doc_id, text in some:
        body, sums, total = lowered(text)[:1500], np.zeros(len(net.languages)), 0
        if len(lowered(text)) > 1500 or not body:
            continue  # loops over bytes are slow
        step = language_id.LENGTH - max(language_id.WIDTHS) + 1
        starts = [0, *range(step, max(1, len(body) - (language_id.LENGTH - step)), step)]
        for a in starts:
            part = body[a : a + language_id.LENGTH]
            sums += plain_probabilities(net, part.ljust(language_id.LENGTH, b"\0")) * len(part)
            total += len(part)
        assert got[doc_id][0] == net.languages[int(sums.argmax())]
        assert got[doc_id][1] == pytest.approx(min(1.0, sums.max() / total), abs=1e-4)


def test_every_language_is_learned(spark):
    kinds = [chr(0x4E00 + 3 * k) for k in range(30)]
    docs = spark.createDataFrame([(k * 30 + n, f"{c * 6} " * 20, f"l{n}") for k in range(6) for n, c in enumerate(kinds)], "doc_id bigint, text string, lang string")
    x, labels = language_id.training_windows(docs, F.lit(True), "doc_id", "text", "lang")
    assert len(set(labels)) == 30 and len(x) == len(labels)
    few = language_id.TEXTS
    try:
        language_id.TEXTS = 30
        assert len(language_id.training_windows(docs, F.lit(True), "doc_id", "text", "lang")[1]) < len(labels)
    finally:
        language_id.TEXTS = few


# op2


def plain_ftrl(examples):
    """FTRL-proximal with dicts, one example after the other."""
    z, n, bz, bn = defaultdict(float), defaultdict(float), 0.0, 0.0

    def weight(k):
        if abs(z[k]) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[k]) - z[k]) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for keys, y in examples:
            w = {k: weight(k) for k in keys}
            bias = -bz / ((toxicity.BETA + math.sqrt(bn)) / toxicity.ALPHA)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()) + bias)))) - y
            for k in keys:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA * w[k]
                n[k] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / toxicity.ALPHA * bias
            bn += g * g
    return {k: weight(k) for k in z if weight(k)}, -bz / ((toxicity.BETA + math.sqrt(bn)) / toxicity.ALPHA)


def plain_features(text):
    """Words, stems, neighbours and pairs around one word, as the coordinates that the hashes of single words give."""
    words = re.findall(rb"[a-z0-9\x80-\xff]+", lowered(text))
    one = lambda w: int(toxicity.stem_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]), ())[1][0][0])
    mixed = lambda x: int(toxicity.mixed(np.array([x % (1 << 64)], np.uint64))[0])
    h, found = [one(w) for w in words], set()
    for w, x in zip(words, h, strict=True):
        found.add(x)
        found |= {mixed(one(w[:size]) + n) for n, size in enumerate(toxicity.STEMS, 1)}
    for step, salt in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        found |= {mixed(h[k] * salt + h[k + step]) for k in range(len(h) - step)}
    return {x >> (64 - toxicity.BITS) for x in found}


def test_toxicity_matches_plain_ftrl(spark, sf_dir, rows):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    model = toxicity.fit(docs, labels)
    known = {r.doc_id: r.toxic for r in labels.select("doc_id", "toxic").where("toxic IS NOT NULL").collect()}
    texts = dict(rows)
    draw = {r.doc_id: r.draw for r in docs.select("doc_id", F.xxhash64("doc_id").alias("draw")).collect()}
    weights, bias = plain_ftrl([(plain_features(texts[k]), known[k]) for k in sorted((k for k in known if k in texts), key=draw.get)])
    assert model.bias == pytest.approx(bias, abs=1e-6)
    assert {int(k): pytest.approx(float(v), abs=1e-5) for k, v in zip(model.coordinates, model.weights, strict=True)} == weights
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for doc_id, text in rows[::9]:
        total = bias + sum(weights.get(k, 0.0) for k in plain_features(text))
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-max(-35.0, min(35.0, total)))), abs=1e-4)


# op6


def plain_isotonic(pairs):
    """Levels by the largest-minorant formula: min over ends of max over starts of the mean between them."""
    n = len(pairs)
    sums, counts = np.r_[0, np.cumsum([y for _, y, _ in pairs])], np.r_[0, np.cumsum([c for *_, c in pairs])]
    mean = lambda a, b: (sums[b] - sums[a]) / (counts[b] - counts[a])
    return [max(min(mean(a, b) for b in range(k + 1, n + 1)) for a in range(k + 1)) for k in range(n)]


def test_quality_matches_whole_matrices(spark, sf_dir, rows):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    stats = quality_classifier.with_statistics(docs, "doc_id", "text")
    model = quality_classifier.fit(stats, labels, remainder("doc_id", 5) == 1)
    known = {r.doc_id: (r.quality, r.later) for r in labels.where("quality IS NOT NULL").select("doc_id", "quality", (remainder("doc_id", 5) == 1).alias("later")).collect()}
    data, at = utf8(pa.array([t for _, t in rows]))
    x = quality_classifier.statistics(data, at)
    place = {doc_id: k for k, (doc_id, _) in enumerate(rows)}
    first = [k for k, (_, later) in known.items() if not later and k in place]
    later = [k for k, (_, later) in known.items() if later and k in place]
    a, y = x[[place[k] for k in first]], np.array([known[k][0] for k in first], float)
    kernel = quality_classifier.Kernel.drawn(a.mean(axis=0), a.std(axis=0))
    f = kernel.features(a)
    penalty = np.eye(f.shape[1]) * quality_classifier.RIDGE * len(a)
    penalty[-1, -1] = 1e-9
    # ridge regression as least squares over the features with the penalty's rows below them
    weights = np.linalg.lstsq(np.r_[f, np.sqrt(penalty)], np.r_[y, np.zeros(f.shape[1])], rcond=None)[0]
    raw = kernel.features(x) @ weights
    assert model.raw(x) == pytest.approx(raw, abs=1e-4)
    bins = defaultdict(list)
    for k in later:
        value = model.raw(x[place[k]][None])[0]
        bins[min(max(math.floor(value * quality_classifier.BINS), -quality_classifier.BINS), 2 * quality_classifier.BINS)].append((value, known[k][0]))
    pairs = [(np.mean([v for v, _ in b]), sum(q for _, q in b), len(b)) for _, b in sorted(bins.items())]
    levels = plain_isotonic(pairs)
    pools = defaultdict(list)
    for (mean, _, n), level in zip(pairs, levels, strict=True):
        pools[round(level, 9)].append((mean, n))
    assert np.round(model.level, 9).tolist() == sorted(pools)
    assert model.at == pytest.approx([np.average([m for m, _ in pools[x]], weights=[n for _, n in pools[x]]) for x in sorted(pools)], abs=1e-6)
    got = {r.doc_id: r.score for r in quality_classifier.score(stats, model).collect()}
    for doc_id, _ in rows[::11]:
        assert got[doc_id] == pytest.approx(float(np.clip(model.score(x[place[doc_id]][None])[0], 0, 1)), abs=1e-9)


# clashing names, and equal rows


@pytest.mark.parametrize("name", ["text_hash", "row_id", "own_id", "doc id", "words"])
def test_ids_may_be_called_like_working_columns(spark, name):
    docs = spark.createDataFrame([("a", "under the MIT license", 1), ("b", None, 2), ("a", "under the MIT license", 1)], f"`{name}` string, text string, label int")
    assert sorted((r[0], r.n_words, r.labels) for r in scan_licenses(docs, name).collect()) == [("a", 4, "mit"), ("a", 4, "mit"), ("b", 0, "")]
    assert sorted((r[0], r.n_tokens) for r in pack(docs, name).collect()) == [("a", 4), ("a", 4), ("b", 0)]


def test_equal_rows_are_packed_by_many_shards(spark, monkeypatch):
    monkeypatch.setattr("gavel.llm.packing.SHARD_ROWS", 100)
    rng = random.Random(2)
    texts = ["same words here"] * 3000 + [" ".join("w" * rng.randrange(1, 30)) for _ in range(2000)]
    docs = spark.createDataFrame([(None if x == "same words here" else k, x) for k, x in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    packed = pack(docs)
    got = packed.collect()
    rooms = {b: 32_768 // b for b in {r.bucket for r in got}}
    by_bucket = defaultdict(list)
    for r in got:
        by_bucket[r.bucket].append(r.batch * rooms[r.bucket] + r.place)
    assert len(got) == 5000 and all(sorted(x) == list(range(len(x))) for x in by_bucket.values())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = pack(docs).where("doc_id IS NULL").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) == 4 and max(r["count"] for r in spread) < 2000  # of 3000 equal rows
