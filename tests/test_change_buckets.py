"""Keyed change state by buckets: few calls of state, each key on its own."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from gavel.streaming import changes
from gavel.streaming.batches import run_available


class Value:
    def __init__(self):
        self.held, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.held

    def update(self, x):
        self.calls += 1
        self.held = x

    def clear(self):
        self.held = None


def plain(state, rows):
    """What goes on of (key, digest, version, n), one key and row after the other."""
    out = []
    for k, d, v, n in sorted(rows, key=lambda r: (r[2], r[1] is not None, r[1] or "")):
        known, last = state.get(k, ("", None))
        if last is None or v >= last:
            out += [n] if not d or d != known else []
            state[k] = (d or "", v)
    return sorted(out)


def test_a_bucket_of_many_keys_takes_few_calls_of_state():
    value = Value()
    work = changes._Changes([changes.KEY], "digest", "version", ["n"], None)
    work.init(SimpleNamespace(getValueState=lambda *_: value))
    draw, state, n = random.Random(7), {}, 0
    first = [(f"k{k}", draw.choice(["a", "b", "", None]), draw.randrange(4)) for k in range(3000)]
    for part in (first[:2000], first[1000:]):  # a large bucket comes in parts that may overlap
        work.handleInitialState((1,), pd.DataFrame(part, columns=[changes.KEY, "digest", "version"]), None)
    state |= {k: (d or "", v) for k, d, v in first}
    for _ in range(4):
        rows = [(f"k{draw.randrange(4000)}", draw.choice(["a", "b", "", None]), draw.randrange(8), n + i) for i in range(5000)]
        n, before = n + len(rows), value.calls
        frame = pd.DataFrame(rows, columns=[changes.KEY, "digest", "version", "n"])
        got = sorted(int(x) for out in work.handleInputRows((1,), iter([frame[:2500], frame[2500:]]), None) for x in out["n"])
        assert got == plain(state, rows)
        assert value.calls - before == 2


@pytest.mark.parametrize("buckets", [1, 8])
def test_numbers_and_null_keys_pass_unchanged(spark, tmp_path, buckets):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, changes.ROCKS)
    try:
        big = (1 << 60) + 1
        schema = "id long, digest string, version int, n long, x double"
        stored = spark.createDataFrame([(big, "h", 1), (None, "h", 1), (2, "h", 1)], "id long, digest string, version int")
        rows = [(big, "i", 2, big, float("nan")), (None, "i", 2, None, None), (2, "h", 2, 5, 0.1), (3, "h", 0, None, -0.5)]
        path, out = str(tmp_path / "in"), str(tmp_path / "out")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        fresh = changes.changed_in_stream(spark.readStream.schema(schema).parquet(path), ["id"], "digest", "version", stored, buckets=buckets)
        run_available(fresh, out, str(tmp_path / "state"))
    finally:
        spark.conf.set(provider, before)
    got = sorted(map(str, spark.read.parquet(out).collect()))
    assert got == sorted(map(str, spark.createDataFrame([rows[0], rows[1], rows[3]], schema).collect()))
