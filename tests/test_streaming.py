"""One batch or several: the same tables."""

from __future__ import annotations

import json

from newsloom.streaming import ingest


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def entry(n, title="A long headline", **more):
    return {"link": f"https://x/{n}", "title": f"{title} {n}", "summary": f"<p>Body {n}</p>", "published": "2024-01-30T10:00:00Z"} | more


def run(spark, tmp_path, landing, name, files):
    table = ingest.open_store(spark, f"file://{tmp_path}/{name}")
    ingest.ingest_feeds(spark, f"file://{landing}", table, f"file://{tmp_path}/{name}-state", files_a_batch=files).awaitTermination()
    return {tuple(r) for r in table.read("articles").select("id", "title", "body", "image_url").collect()}


def test_feed_batches_agree(spark, tmp_path):
    landing = tmp_path / "in"
    image = {"enclosures": [{"type": "image/png", "url": "u.png"}]}
    write(landing, "1.json", [{"source_id": "s", "entries": [entry(1, **image), entry(2), entry(3, link=""), entry(4, title="NFL draft pick")]}])
    write(landing, "2.json", [{"source_id": "s", "entries": [entry(2), entry(5)]}, {"source_id": "t", "entries": [entry(1)]}])
    once, twice = run(spark, tmp_path, landing, "a", 10), run(spark, tmp_path, landing, "b", 1)
    assert once == twice and len(once) == 4
    assert {r[3] for r in once} == {None, "u.png"}


def test_signals_keep_the_latest(spark, tmp_path):
    landing = tmp_path / "in"
    market = {"condition_id": "m", "question": " Will it rain? ", "outcomes": '["Yes","No"]', "outcome_prices": '["0.25","0.75"]', "slug": "rain"}
    write(landing, "1.json", [market, market | {"condition_id": "n", "fee_type": "sports_x"}])
    table = ingest.open_store(spark, f"file://{tmp_path}/t")
    ingest.ingest_signals(spark, f"file://{landing}", table, f"file://{tmp_path}/state").awaitTermination()
    write(landing, "2.json", [market | {"outcome_prices": '["0.5","0.5"]'}])
    ingest.ingest_signals(spark, f"file://{landing}", table, f"file://{tmp_path}/state").awaitTermination()
    assert [(r.id, r.question, r.yes_price) for r in table.read("signals").collect()] == [("m", "Will it rain?", 0.5)]


def test_a_poll_gives_the_most_traded(spark, tmp_path):
    landing = tmp_path / "in"
    markets = [{"condition_id": f"m{i:03}", "question": f"Will it rain {i}?", "outcomes": '["Yes","No"]', "outcome_prices": '["0.25","0.75"]', "slug": "rain", "volume_24hr": float(i // 2)} for i in range(205)]
    write(landing, "1.json", markets)
    write(landing, "2.json", [markets[0] | {"condition_id": "other"}])
    seen = []
    for name, files in (("a", 10), ("b", 1)):
        table = ingest.open_store(spark, f"file://{tmp_path}/{name}")
        ingest.ingest_signals(spark, f"file://{landing}", table, f"file://{tmp_path}/{name}-state", files_a_batch=files).awaitTermination()
        seen.append({r["id"] for r in table.read("signals").collect()})
    assert seen[0] == seen[1] == {f"m{i:03}" for i in range(4, 205)} - {"m005"} | {"m004", "other"}
