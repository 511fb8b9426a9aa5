"""Files that a cache fills are taken in once, changed ones anew, bad ones apart."""

import json
import os

from headway.sources import intake


def put(path, document, age):
    path.write_text(document if isinstance(document, str) else json.dumps(document))
    os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))


def element(i, lat=1.0, **tags):
    return {"type": "way", "id": i, "center": {"lat": lat, "lon": 2.0}, "tags": tags}


def test_intake(spark, tmp_path):
    cache, store = tmp_path / "cache", str(tmp_path / "store")
    source = f"file://{cache}/*.json"
    assert intake.take_in(spark, source, store, intake.ELEMENTS) == 0
    cache.mkdir()
    put(cache / "a.json", {"elements": [element(1, name="one"), element(2, highway="primary"), {"type": "way", "id": 3}]}, 0)
    put(cache / "b.json", {"elements": [element(1, lat=5.0, construction="road")]}, 0)
    put(cache / "c.json", "{}", 0)
    put(cache / "d.json", '{"elements": [', 0)
    assert intake.take_in(spark, source, store, intake.ELEMENTS) == 4
    rows = lambda: {(r["event_id"], r["title"], r["lat"], r["major"]) for r in intake.features(intake.documents(spark, store, intake.ELEMENTS)).collect()}
    assert rows() == {("way/1", "road", 5.0, False), ("way/2", "primary", 1.0, True)}  # the last file has the say
    assert [(r["path"][-6:], r["text"]) for r in intake.bad(spark, store).collect()] == [("d.json", '{"elements": [')]
    assert intake.take_in(spark, source, store, intake.ELEMENTS) == 0  # nothing is opened again
    put(cache / "b.json", {"elements": [element(9)]}, 60)  # changed: its rows are replaced
    put(cache / "d.json", {"elements": [element(4)]}, 60)  # mended
    put(cache / "e.json", {"elements": None}, 60)
    assert intake.take_in(spark, source, store, intake.ELEMENTS) == 3
    assert rows() == {("way/1", "one", 1.0, False), ("way/2", "primary", 1.0, True), ("way/9", "", 1.0, False), ("way/4", "", 1.0, False)}
    assert intake.bad(spark, store).count() == 0


def test_a_batch_that_breaks_off_counts_for_nothing(spark, tmp_path, monkeypatch):
    cache, store = tmp_path / "cache", str(tmp_path / "store")
    cache.mkdir()
    for i in range(5):
        put(cache / f"{i}.json", {"articles": [{"pageid": i, "title": f"t{i}", "lat": 1.0, "lon": 2.0}, {"title": "same", "lat": float(i), "lon": 0.0}, {"title": "nowhere"}]}, 0)
    spark.createDataFrame([("x",)], "path string").write.parquet(f"{store}/rows/batch=broken")
    monkeypatch.setattr(intake, "BATCH", 2)  # several reads a run
    assert intake.take_in(spark, f"file://{cache}", store, intake.ARTICLES) == 5
    got = {(r["event_id"], r["lat"]) for r in intake.articles(intake.documents(spark, store, intake.ARTICLES)).collect()}
    assert got == {*((str(i), 1.0) for i in range(5)), ("same", 4.0)}
