"""Incremental ingest: each file once, repeats and failures included."""

from datetime import datetime
from pathlib import Path

import pytest
from test_sources import HEAD, put_zip, record

from tidegrid.operators.clean import clean_prices, dedupe_prices
from tidegrid.plans.reports import price_summary
from tidegrid.sinks import tables
from tidegrid.sinks.manifest import current_version, live_parts, read_manifest, remove_garbage
from tidegrid.sinks.tables import read_ledger, read_rejected_files, read_rejected_rows, read_summary
from tidegrid.sources.market_zip import read_market_zips
from tidegrid.streaming import ingest
from tidegrid.streaming.ingest import (
    Warehouse,
    backfill_history,
    compact_prices,
    create_tables,
    ingest_market_zips,
    read_prices,
    refresh_summary,
    upsert_prices,
)


def rows_of(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.fixture()
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    for day in (1, 2):
        text = HEAD + record(f"2024/01/{day:02d} 00:05:00") + record(f"2024/02/{day:02d} 00:05:00", price=day)
        put_zip(folder / f"p [x] {{{day}}}_2024010{day}.zip", {"a.csv": text})
    (folder / "bad.zip").write_bytes(b"nothing")
    return folder


@pytest.fixture()
def warehouse(tmp_path):
    return Warehouse(str(tmp_path / "warehouse"))


def run(spark, landing, warehouse, **options):
    ingest_market_zips(spark, str(landing), warehouse, **options).awaitTermination()


def check(spark, landing, warehouse):
    live = read_prices(spark, warehouse)
    landed = clean_prices(read_market_zips(spark, str(landing))).select(live.columns)
    assert rows_of(live) == rows_of(dedupe_prices(landed))
    check_summary(spark, warehouse)


def check_summary(spark, warehouse):
    expected = price_summary(read_prices(spark, warehouse))
    assert rows_of(read_summary(spark, warehouse.summary).drop("sum_price")) == rows_of(expected)


def test_stream_equals_batch_and_repeats_add_nothing(spark, landing, warehouse):
    run(spark, landing, warehouse)
    check(spark, landing, warehouse)
    assert {r.filename for r in read_ledger(spark, warehouse.ledger).collect()} == {
        "p [x] {1}_20240101.zip",
        "p [x] {2}_20240102.zip",
    }
    run(spark, landing, warehouse)
    check(spark, landing, warehouse)

    text = HEAD + record("2024/02/03 00:05:00", price=-7) + record("2024/03/01 00:05:00")
    put_zip(landing / "p_20240103.zip", {"a.csv": text})
    run(spark, landing, warehouse)
    check(spark, landing, warehouse)
    summary = {(r.year, r.month): r for r in read_summary(spark, warehouse.summary).collect()}
    assert summary[2024, 2].min_price == -7 and summary[2024, 2].record_count == 3
    assert summary[2024, 1].record_count == 2 and summary[2024, 3].record_count == 1


def test_small_batches(spark, landing, warehouse):
    run(spark, landing, warehouse, max_files_per_batch=1, max_file_age="7d")
    check(spark, landing, warehouse)
    assert read_ledger(spark, warehouse.ledger).select("load_id").distinct().count() == 2


def test_known_name_in_another_folder_is_skipped(spark, landing, warehouse, tmp_path):
    run(spark, landing, warehouse)
    copy = tmp_path / "again"
    copy.mkdir()
    name = "p [x] {1}_20240101.zip"
    (copy / name).write_bytes((landing / name).read_bytes())
    files = spark.read.format("binaryFile").load(str(copy))
    assert ingest._new_files(files, read_ledger(spark, warehouse.ledger)).isEmpty()
    twice = files.unionByName(spark.read.format("binaryFile").load(str(landing)))
    assert ingest._new_files(twice, read_ledger(spark, warehouse.ledger).limit(0)).count() == 3


def test_failed_batch_is_repeated_without_doubling(spark, landing, warehouse, monkeypatch):
    real, calls = tables.write_ledger, []

    def fail_once(*args):
        calls.append(args)
        if len(calls) == 1:
            raise RuntimeError("lost")
        real(*args)

    monkeypatch.setattr(ingest, "write_ledger", fail_once)
    with pytest.raises(Exception, match="lost"):
        run(spark, landing, warehouse)
    assert read_prices(spark, warehouse).count() == 4
    assert read_ledger(spark, warehouse.ledger).isEmpty()
    version = current_version(spark, warehouse.manifest)
    run(spark, landing, warehouse)
    check(spark, landing, warehouse)
    assert len(calls) == 2 and read_ledger(spark, warehouse.ledger).count() == 2
    assert current_version(spark, warehouse.manifest) == version


def test_backfill(spark, tmp_path, warehouse):
    folder = tmp_path / "history"
    folder.mkdir()
    (folder / "h [1] é+%20_2024.csv").write_text("REGION,SETTLEMENTDATE,RRP\nVIC1,2024/01/01 00:05:00,1\n")
    backfill_history(spark, str(folder), warehouse, 2024, "2024-06-09", "historic-1")
    backfill_history(spark, str(folder), warehouse, 2024, "2024-06-09", "historic-1")
    assert read_prices(spark, warehouse).count() == 1
    (folder / "h_2024_2.csv").write_text("REGION,SETTLEMENTDATE,RRP\nVIC1,2024/01/01 00:10:00,3\n")
    backfill_history(spark, str(folder), warehouse, 2024, "2024-06-09", "historic-2")
    backfill_history(spark, str(folder), warehouse, 2024, "2024-06-09", "historic-3")
    assert sorted(r.RRP for r in read_prices(spark, warehouse).collect()) == [1.0, 3.0]
    summary = read_summary(spark, warehouse.summary).first()
    assert (summary.record_count, summary.avg_price) == (2, 2.0)
    assert {r.source for r in read_ledger(spark, warehouse.ledger).collect()} == {"historic"}


def test_rejected_archives_get_another_chance(spark, landing, warehouse):
    """A truncated archive is listed, and loaded when the whole file lands under the same name."""
    put_zip(landing / "bad.zip", {"a.csv": HEAD + record("2024/04/01 00:05:00", price=4)})
    whole = (landing / "bad.zip").read_bytes()
    (landing / "bad.zip").write_bytes(whole[: len(whole) // 2])
    run(spark, landing, warehouse)
    assert [r.filename for r in read_rejected_files(spark, warehouse.rejected).collect()] == ["bad.zip"]
    (landing / "bad.zip").write_bytes(whole)
    run(spark, landing, warehouse)
    check(spark, landing, warehouse)
    assert "bad.zip" in {r.filename for r in read_ledger(spark, warehouse.ledger).collect()}


def test_first_load_of_bad_files_only(spark, tmp_path, warehouse):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "bad.zip").write_bytes(b"nothing")
    run(spark, tmp_path / "l", warehouse)
    assert read_ledger(spark, warehouse.ledger).isEmpty()
    assert read_rejected_files(spark, warehouse.rejected).count() == 1


def stored(spark, warehouse, rows, make_prices, load_id):
    create_tables(spark, warehouse)
    changed = upsert_prices(spark, make_prices(rows), warehouse, load_id)
    refresh_summary(spark, warehouse)
    return changed


def prices_of(spark, warehouse):
    return {(r.REGIONID, str(r.SETTLEMENTDATE)): r.RRP for r in read_prices(spark, warehouse).collect()}


def test_a_stamp_is_kept_once_and_later_changes_replace_it(spark, warehouse, make_prices):
    def changed(day):
        return datetime(2024, 5, day)

    first = [("2024-01-01 00:05", "R", 1.0, changed(1)), ("2024-01-01 00:10", "R", 2.0, changed(1))]
    stored(spark, warehouse, first + [("2024-01-01 00:05", "R", 9.0, changed(2))], make_prices, "a")
    assert prices_of(spark, warehouse) == {("R", "2024-01-01 00:05:00"): 9.0, ("R", "2024-01-01 00:10:00"): 2.0}
    # An earlier state of a live stamp and an equal one change nothing, other regions and months are added.
    again = [*first, ("2024-01-01 00:10", "R", 2.0, None), ("2024-02-01 00:10", "S", 5.0, changed(1))]
    assert stored(spark, warehouse, again, make_prices, "b") == {(2024, 2)}
    assert len(prices_of(spark, warehouse)) == 3
    version = current_version(spark, warehouse.manifest)
    assert stored(spark, warehouse, again, make_prices, "b") == set()
    assert current_version(spark, warehouse.manifest) == version
    # A correction replaces the row, and the summary follows, extremes included.
    stored(spark, warehouse, [("2024-01-01 00:05", "R", -4.0, changed(3))], make_prices, "c")
    assert prices_of(spark, warehouse)["R", "2024-01-01 00:05:00"] == -4.0
    january = read_summary(spark, warehouse.summary).where("month = 1").first()
    assert (january.min_price, january.max_price, january.sum_price, january.record_count) == (-4, 2, -2, 2)
    check_summary(spark, warehouse)


def test_summary_reads_no_price_file(spark, warehouse, make_prices, grid):
    for i in range(3):
        stored(spark, warehouse, grid(f"2024-01-0{i + 1} 00:00", "R", range(10)), make_prices, f"l{i}")
    summary = ingest.summary_of(read_manifest(spark, warehouse.manifest))
    assert all("/manifest/" in path for path in summary.inputFiles())
    check_summary(spark, warehouse)
    # A load of another month does not open the files of this one.
    for path in (Path(warehouse.prices)).rglob("month=1/**/*.parquet"):
        path.write_bytes(b"unreadable")
    stored(spark, warehouse, grid("2024-02-01 00:00", "R", range(10)), make_prices, "m")
    counts = {r.month: (r.record_count, float(r.sum_price)) for r in read_summary(spark, warehouse.summary).collect()}
    assert counts == {1: (30, 135.0), 2: (10, 45.0)}


def test_many_loads_leave_few_parts_and_compaction_one(spark, warehouse, make_prices, grid):
    for i in range(12):
        stored(spark, warehouse, grid(f"2024-01-{i + 1:02d} 00:00", "R", range(4)), make_prices, f"l{i:02d}")
    parts = live_parts(read_manifest(spark, warehouse.manifest))
    assert 1 < len(parts[2024, 1]) <= ingest.MOST_PARTS
    reader, before = read_prices(spark, warehouse), prices_of(spark, warehouse)
    assert compact_prices(spark, warehouse) == {(2024, 1)} and compact_prices(spark, warehouse) == set()
    assert len(live_parts(read_manifest(spark, warehouse.manifest))[2024, 1]) == 1
    assert prices_of(spark, warehouse) == before and len(before) == 48
    # The version before stays until the next clean-up, so a reader of it still finds its files.
    assert reader.count() == 48
    remove_garbage(spark, warehouse.prices, warehouse.manifest, keep_versions=1)
    assert len(list(Path(warehouse.prices).glob("part=*"))) == 1
    assert not list(Path(warehouse.root, "staging").glob("*"))
    check_summary(spark, warehouse)


def test_a_reader_sees_old_or_new_rows_only(spark, warehouse, make_prices, monkeypatch):
    stored(spark, warehouse, [("2024-01-01 00:05", "R", 1.0), ("2024-01-01 00:10", "R", 2.0)], make_prices, "a")
    seen, real = [], ingest.commit

    def watched(*args):
        seen.append(prices_of(spark, warehouse))
        real(*args)
        seen.append(prices_of(spark, warehouse))

    monkeypatch.setattr(ingest, "commit", watched)
    stored(spark, warehouse, [("2024-01-01 00:05", "R", 7.0, datetime(2025, 1, 1))], make_prices, "b")
    assert [sorted(s.values()) for s in seen] == [[1.0, 2.0], [2.0, 7.0]]


def test_failed_attempts_are_garbage_only(spark, warehouse, make_prices, monkeypatch):
    def lost(*args):
        raise RuntimeError("lost")

    stored(spark, warehouse, [("2024-01-01 00:05", "R", 1.0)], make_prices, "a")
    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(ingest, "commit", lost)
        stored(spark, warehouse, [("2024-01-01 00:10", "R", 2.0)], make_prices, "b")
    assert len(prices_of(spark, warehouse)) == 1
    stored(spark, warehouse, [("2024-01-01 00:10", "R", 2.0)], make_prices, "b")
    assert len(prices_of(spark, warehouse)) == 2
    assert len(remove_garbage(spark, warehouse.prices, warehouse.manifest)) == 1


def test_rejected_rows_are_kept(spark, tmp_path, warehouse):
    (tmp_path / "l").mkdir()
    text = HEAD + record("2024/01/01 00:05:00", price="1e13") + record("2024/01/01 00:10:00", price=3)
    put_zip(tmp_path / "l" / "p_20240101.zip", {"a.csv": text})
    run(spark, tmp_path / "l", warehouse)
    assert list(prices_of(spark, warehouse).values()) == [3.0]
    rejected = read_rejected_rows(spark, warehouse.rejected_rows).collect()
    assert [(r.RRP, r.reason, r.filename) for r in rejected] == [("1e13", "price out of range", "p_20240101.zip")]


def test_only_recent_files_are_opened(spark, tmp_path, warehouse, monkeypatch):
    (tmp_path / "l").mkdir()
    for name in ("p_20240101.zip", "p_20240108.zip", "p_20240109.zip", "undated.zip"):
        put_zip(tmp_path / "l" / name, {"a.csv": HEAD + record("2024/01/01 00:05:00")})
    opened, real = [], ingest._load_zips
    monkeypatch.setattr(ingest, "_load_zips", lambda s, paths, *rest: opened.extend(paths) or real(s, paths, *rest))
    run(spark, tmp_path / "l", warehouse, days_back=1, as_of=datetime(2024, 1, 9))
    assert sorted(p.rpartition("/")[2] for p in opened) == ["p_20240108.zip", "p_20240109.zip"]


def test_unchanged_rejected_files_are_not_opened_again(spark, landing, warehouse, monkeypatch):
    run(spark, landing, warehouse)
    opened, real = [], ingest._load_zips
    monkeypatch.setattr(ingest, "_load_zips", lambda s, paths, *rest: opened.extend(paths) or real(s, paths, *rest))
    run(spark, landing, warehouse)
    assert opened == []
    (landing / "bad.zip").write_bytes(b"nothing again")
    run(spark, landing, warehouse)
    run(spark, landing, warehouse)
    assert len(opened) == 1 and read_rejected_files(spark, warehouse.rejected).count() == 2
