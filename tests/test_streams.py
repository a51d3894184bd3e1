"""Streams into tables that take each batch once: failures, replays, late and undated items, lost checkpoints."""

import json

import pytest

from riverplane import schemas
from riverplane.streaming import feeds, sink


def feature(path, n):
    path.write_text(json.dumps({"features": [{"properties": {"id": str(n)}, "geometry": {"type": "LineString", "coordinates": [[n, 0], [n, 1]]}}]}))


def page(path, *items):
    path.write_text(json.dumps({"items": [{"title": f"title of {u}", "downloadURL": u, "publicationDate": when} for u, when in items]}))


def test_streams_take_files_and_urls_once(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    feature(src / "a.geojson", 0)
    for _ in range(2):
        feeds.aoi_stream(spark, str(src), str(tmp_path / "ck"), lambda v, n: seen.append(v.count())).awaitTermination()
    assert seen == [2]
    cat = tmp_path / "cat"
    cat.mkdir()
    table = sink.BatchTable(spark, str(tmp_path / "out"), schemas.SEEN_ITEMS)
    for i in range(2):
        page(cat / f"{i}.json", ("u1", "2024-01-02"), (f"v{i}", "2024-01-02"))
        feeds.catalog_stream(spark, str(cat), str(tmp_path / "ck2"), table).awaitTermination()
    assert sorted(r.url for r in table.read().collect()) == ["u1", "v0", "v1"]


def test_no_url_is_lost_or_twice_whatever_its_date(spark, tmp_path):
    cat = tmp_path / "cat"
    cat.mkdir()
    table = sink.BatchTable(spark, str(tmp_path / "out"), schemas.SEEN_ITEMS)
    runs = [
        [("u1", "2024-01-02"), ("u2", "2025-06-01"), ("u2", "2025-07-01"), (None, "2024-01-01")],
        [("u3", "2019-05-05"), ("u1", "2026-01-01"), ("u4", None)],
        [("u5", "not a date"), ("u6", "2018-01-01"), ("u3", "2019-05-05"), ("u4", "2020-01-01")],
    ]
    for i, items in enumerate(runs):
        page(cat / f"{i}.json", *items)
        (cat / f"bad{i}.json").write_text("{" if i else "")
        feeds.catalog_stream(spark, str(cat), str(tmp_path / "ck"), table).awaitTermination()
    got = sorted((r.url, str(r.published)[:10]) for r in table.read().collect())
    assert got == [("u1", "2024-01-02"), ("u2", "2025-07-01"), ("u3", "2019-05-05"), ("u4", "None"), ("u5", "None"), ("u6", "2018-01-01")]
    # Another checkpoint reads every page again: nothing comes out twice, and what is new still comes out.
    page(cat / "9.json", ("u7", "2001-01-01"))
    feeds.catalog_stream(spark, str(cat), str(tmp_path / "another"), table).awaitTermination()
    assert sorted(r.url for r in table.read().collect()) == [f"u{i}" for i in range(1, 8)]


@pytest.mark.parametrize("when", ["before the mark", "after the mark"])
def test_a_batch_that_fails_is_there_once(spark, tmp_path, monkeypatch, when):
    src = tmp_path / "in"
    src.mkdir()
    table = sink.BatchTable(spark, str(tmp_path / "out"), schemas.FEATURES)
    run = lambda: feeds.aoi_table(spark, str(src), str(tmp_path / "ck"), table, id_property="id").awaitTermination()
    feature(src / "a.geojson", 1)
    run()
    feature(src / "b.geojson", 2)
    own = table.mark

    def failing(writer, batch):
        if when == "after the mark":
            own(writer, batch)
        raise RuntimeError("the driver goes away")

    monkeypatch.setattr(table, "mark", failing)
    with pytest.raises(Exception):  # noqa: B017
        run()
    expected = [1, 1] if when == "before the mark" else [1, 1, 2, 2]
    assert sorted(r.feature_id for r in table.read().collect()) == expected
    monkeypatch.undo()
    for n in (3, 4):
        run()
        assert sorted(r.feature_id for r in table.read().collect()) == sorted([1, 1, 2, 2] + [x for k in range(3, n) for x in (k, k)])
        feature(src / f"{n}.geojson", n)
    run()
    assert sorted(r.feature_id for r in table.read().collect()) == [1, 1, 2, 2, 3, 3, 4, 4]


def test_half_a_batch_is_replaced(spark, tmp_path):
    table = sink.BatchTable(spark, str(tmp_path / "t"), "a int")
    assert table.read().count() == 0
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "a int")
    rows(1, 2, 3).write.parquet(f"{table.path}/rows/writer=w/batch=0")  # left by an attempt without a mark
    assert table.read().count() == 0 and table.put(rows(1, 2), "w", 0) and not table.put(rows(9), "w", 0)
    assert table.put(rows(5), sink.writer_of("elsewhere"), 0)
    assert sorted(r.a for r in table.read().collect()) == [1, 2, 5]
    assert sink.writer_of("a/b") == sink.writer_of("a/b/") != sink.writer_of("a/c")
