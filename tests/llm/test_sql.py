"""Operators that SQL can express against DuckDB, on the given texts and on awkward ones (very long ones are too slow in this SQL)."""

from __future__ import annotations

import duckdb
import pytest

from gavel.llm.queries import ORACLES, QUERIES

AWKWARD = [
    (1, "All rights reserved. All rights reserved."), (2, "all rights reserved all rights reserved all rights reserved"), (3, "rights reserved all rights"),
    (4, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0 licensed under cc by"), (5, "this work is licensed under the very gnu general public license of version 3"),
    (6, "under the MIT license " * 3), (7, "this program is free software you can redistribute it and modify it under the terms of the gnu license " * 2), (8, None), (8, None), (9, ""),
    (10, "either version 3 of the license or at your option any later version either version 3 of the new license or at your option any later version"),
]
VECTORS = [
    (0, [0.5, 0.5, -0.25], 9), (0, [0.5, 0.5, -0.25], 9), (50, [0.5, 0.4, -0.25], 0), (100, [-0.5, -0.5, 0.25], 1), (150, None, 1), (200, [float("nan"), 0.1, 0.1], 1), (250, [0.1, None, 0.3], 1),
    (300, [0.25, 0.5, 0.0], None), *[(k, [0.5 - k / 400, 0.4, -k / 500], k % 3) for k in range(1, 40)], *[(k, [0.3, 0.3, 0.0], k % 2) for k in range(400, 420)],
]


def plain(rows, columns):
    place = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(f"{r[k]:.9g}" if isinstance(r[k], float) else str(r[k]) for k in place) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("which", ["given", "awkward"])
def test_operator_matches_sql(spark, sf_dir, tmp_path, name, which):
    path = sf_dir
    if which != "given":
        rows = spark.createDataFrame(AWKWARD, "doc_id bigint, text string")
        rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
        path = str(tmp_path)
    con = duckdb.connect()
    for name_of in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name_of} AS SELECT * FROM '{path}/{name_of}.parquet{'/*.parquet' if which != 'given' else ''}'")
    found, want = QUERIES[name](spark, path), con.sql(ORACLES[name])
    assert plain(found.collect(), found.columns) == plain(want.fetchall(), want.columns)


def test_notices_that_follow_each_other_keep_their_label(spark):
    from gavel.llm.license_scan import scan_licenses

    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(spark.createDataFrame(AWKWARD, "doc_id bigint, text string")).collect()}
    assert got[1] == got[2] == ("all-rights-reserved", 1.0) and got[3] == ("", 0.0) and got[4][0] == "cc-by-nc" and got[6][0] == "mit"
    own = spark.createDataFrame([("house", "all items stay with the house")], "label string, text string")
    docs = spark.createDataFrame([(1, "All items stay with the HOUSE all rights reserved")], "doc_id bigint, text string")
    assert scan_licenses(docs, notices=own).first().labels == "house"
