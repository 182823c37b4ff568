"""Queries that must return all that they worked out before."""

import json
from pathlib import Path

from almanac import catalog

SF = "/root/testdata/sf0.01"


def test_paper_factors_keep_the_trailing_change_and_the_plain_body(spark):
    got = catalog.queries()["paper_factors"](spark, SF)
    assert {"OPEN_TO_CLOSE", "BODY", "body_plain", "change5"} <= set(got.columns)
    assert got.where("change5 is not null").count() > 0 and got.where("body_plain <> BODY").count() > 0


def test_registry_latest_keep_has_every_user(spark):
    got = catalog.queries()["registry_latest_keep"](spark, SF)
    users = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    assert got.count() == users > got.where("keep").count() > 0
    assert got.where("keep <> (event_type = 'purchase')").count() == 0


def test_json_pages_stay_small(spark, monkeypatch):
    """A page has at most PAGE records, a file one page, and all records but those of pages without a result come back."""
    from almanac import catalog_proofs

    monkeypatch.setattr(catalog_proofs, "PAGE", 7, raising=False)
    read, seen = catalog_proofs.files.json_pages, []
    monkeypatch.setattr(catalog_proofs.files, "json_pages", lambda spark, path, *a: seen.append(path) or read(spark, path, *a))
    got = {r.event_id for r in catalog.queries()["json_page_rows"](spark, "/root/testdata/sf0.001").collect()}
    ids = {r.event_id for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id").collect()}
    assert got == {i for i in ids if i % 10 != 7}
    texts = [t for f in Path(seen[0].removeprefix("file:")).glob("part-*.txt") if (t := f.read_text())]
    pages = [json.loads(t).get("body", {}).get("result", {}).get("data", []) for t in texts]
    assert max(map(len, pages)) <= 7 and sum(map(len, pages)) == len(got) and [] in pages
