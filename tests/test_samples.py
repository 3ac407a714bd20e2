"""Sample rows, bills by hand, and the review of answers, from files to files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gavel import schemas
from gavel.operators import claims, samples
from gavel.operators.commits import Store


def run_at():
    return F.lit("2026-03-05 10:00:00").cast("timestamp")


def row(number, sponsor="Ann", claims=None, system="legiscan"):
    return (number, f"T {number}", "city", "Miami", "2026", "Board", "Passed", None, None, None, f"u{number}", system, "county", ["Miami-Dade County"], sponsor, claims)


def test_samples_are_entered_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([row("1", claims={"what_it_does": "x", "who_it_affects": "y"}), row("2", claims={}), row("3", sponsor=None, system="legistar")], schemas.SAMPLE_BILLS)
    for _ in range(2):
        samples.enter(store, samples.sample_tables(rows, run_at()))
    _, tables = store.snapshot()
    assert {n: df.count() for n, df in tables.items()} == {"entities": 4, "bills": 3, "sources": 3, "relationships": 2, "claims": 2, "claim_sources": 2}
    assert all(tables[n].schema == schemas.TABLES[n] for n in tables)
    assert {(r.source_type, r.publisher) for r in tables["sources"].collect()} == {("legiscan_bill", "Miami via legiscan"), ("legistar_agenda", "Miami via legistar")}
    cards = {r.bill_number: r.card for r in samples.shown(tables).collect()}
    assert cards["1"] == "1 - T 1\nstatus: Passed, county: Miami-Dade County\nwhat_it_does: x\nwho_it_affects: y\nsources: u1"
    assert cards["3"] == "3 - T 3\nstatus: Passed, county: Miami-Dade County"


def test_by_hand_keeps_bills_whose_prompts_fail(spark):
    kind = [f for f in schemas.SAMPLE_BILLS.fieldNames() if f not in ("geo_scope_type", "geo_scope_names", "claims")]
    whole = [dict(zip(schemas.SAMPLE_BILLS.fieldNames(), row(n), strict=True)) | {"bill_text": text} for n, text in (("1", "roads in Polk"), ("2", "fails in Tampa"), ("3", None))]
    bills = spark.createDataFrame([[r[c] for c in (*kind, "bill_text")] for r in whole], ", ".join(f"{c} {schemas.SAMPLE_BILLS[c].dataType.simpleString()}" for c in kind) + ", bill_text string")

    def make():
        def tell(prompt):
            if "fails" in prompt:
                raise RuntimeError("no")
            return prompt.upper()

        return tell

    made = samples.by_hand(bills, run_at(), {"what_it_does": "{bill_text}"}, make, "stub", ["Polk"], ["Tampa"])
    assert sorted((r.bill_number, r.geo_scope_type, r.geo_scope_names) for r in made["bills"].collect()) == [("1", "county", ["Polk"]), ("2", "city", ["Tampa"]), ("3", "statewide", ["FL"])]
    assert sorted((r.claim_text, r.generated_by) for r in made["claims"].collect()) == [("", "llm:stub"), ("ROADS IN POLK", "llm:stub")]
    assert made["claim_sources"].count() == 2


def test_a_review_runs_from_a_file_to_a_report(spark, tmp_path):
    bills = [{"bill_number": f"HB {k}", "title": "T", "bill_text": "x" * (490 + 10 * k)} for k in range(4)]
    (tmp_path / "bills.json").write_text(json.dumps(bills))

    def make():
        def tell(prompt):
            if len(prompt) == 510:
                raise RuntimeError("down")
            return f"{len(prompt)} letters"

        return tell

    claims.review_run(spark, str(tmp_path / "bills.json"), str(tmp_path / "out"), {"what_it_does": "{bill_text}"}, make, "stub")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith("# Review of summaries\n\nModel: stub\nBills: 4\n")
    assert [text.index(f"## HB {k}: T") for k in range(4)] == sorted(text.index(f"## HB {k}: T") for k in range(4))
    assert "**what_it_does:** 490 letters" in text and "error: RuntimeError: down" in text
    assert f"> {'x' * 500}...\n" in text and f"> {'x' * 490}\n" in text and text.count(claims.VERDICT) == 4
