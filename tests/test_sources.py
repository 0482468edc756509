import dataclasses
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticemill import sources
from noticemill.functions.hashing import content_text
from noticemill.operators.lookup import latest_per_source
from noticemill.operators.tables import raw_table
from noticemill.plans.ingest import collect, default_paths
from noticemill.sources.landing import page_snapshots, read_source
from noticemill.sources.resume import take_until_checkpoint
from noticemill.sources.spec import SourceSpec, get_source, list_sources, register_source
from noticemill.suite import records as suite_records


def land_federal(folder, pages, total=None):
    folder.mkdir(parents=True, exist_ok=True)
    total = sum(map(len, pages)) if total is None else total
    lines = [
        json.dumps({"offset": 25 * i, "totalRecords": total, "opportunitiesData": rows})
        for i, rows in enumerate(pages)
    ]
    (folder / "pages.json").write_text("\n".join(lines))
    return str(folder)


def land_city(folder, pages):
    for i, rows in enumerate(pages):
        place = folder / f"page_offset={50 * i}"
        place.mkdir(parents=True)
        (place / "response.json").write_text(json.dumps(rows))
    return str(folder)


def notice(i, posted="2024-01-10", **more):
    return {"noticeId": f"n{i}", "title": f"T{i}", "postedDate": posted, **more}


def city_row(i, section="Procurement", **more):
    return {"request_id": f"r{i}", "short_title": f"S{i}", "section_name": section, **more}


def test_federal_fields(spark, tmp_path):
    rows = [notice(1, uiLink="https://x/1", department="D"), notice(2), {"title": "no id"}]
    path = land_federal(tmp_path / "f", [rows])
    got = read_source(spark, get_source("sam_gov"), path).orderBy("seq").collect()
    assert [(r.seq, r.source_id, r.source_url) for r in got] == [
        (0, "n1", "https://x/1"),
        (1, "n2", "https://sam.gov/opp/n2/view"),
    ]
    assert got[0].extracted == {
        "title": "T1", "agency": "D", "sub_tier": "", "office": "", "posted_date": "2024-01-10",
        "response_deadline": "", "type": "", "set_aside": "", "naics_code": "",
        "solicitation_number": "",
    }


def test_city_keys_and_section(spark, tmp_path):
    pages = [
        [city_row(1), city_row(2, request_id="", pin="p2"), city_row(3, section="Hearings")],
        [city_row(4, request_id="", pin=""), city_row(5, request_id=None, pin="p5")],
    ]
    rows = read_source(spark, get_source("nyc_procurement"), land_city(tmp_path / "c", pages))
    got = rows.orderBy("seq").collect()
    assert [(r.seq, r.source_id) for r in got] == [(0, "r1"), (1, "p2"), (51, "p5")]
    assert got[1].source_url.endswith("/resource/3khw-qi8f/p2")


def test_window(spark, tmp_path):
    days = ["2024-01-01", "2024-01-02", "2024-02-01", "2024-02-02", "soon"]
    path = land_federal(tmp_path / "f", [[notice(i, d) for i, d in enumerate(days)]])
    got = read_source(spark, get_source("sam_gov"), path, dt.date(2024, 2, 1)).collect()
    assert {r.extracted["posted_date"] for r in got} == {"2024-01-02", "2024-02-01"}


def test_page_rules(spark, tmp_path):
    spec = get_source("sam_gov")
    past_total = land_federal(tmp_path / "a", [[notice(1)], [notice(2)]], total=25)
    assert [r.source_id for r in read_source(spark, spec, past_total).collect()] == ["n1"]
    after_empty = land_federal(tmp_path / "b", [[notice(1)], [], [notice(3)]], total=75)
    assert [r.source_id for r in read_source(spark, spec, after_empty, until_empty=True).collect()] == ["n1"]


def test_missing_landing(spark, tmp_path):
    spec = get_source("sam_gov")
    nowhere = str(tmp_path / "nowhere")
    assert read_source(spark, spec, nowhere, allow_missing=True).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        read_source(spark, spec, nowhere).count()


def test_failures_are_isolated(spark, tmp_path):
    path = land_federal(tmp_path / "f", [[notice(1)]])
    table = raw_table(str(tmp_path / "raw"))
    summary = collect(spark, table, {"sam_gov": path, "unheard": path}, 0).first()
    assert (summary.items_collected, summary.failures) == (1, 1)
    assert table.read(spark).count() == 1


def test_registry(spark):
    names = [r.name for r in list_sources(spark).collect()]
    assert names == sorted(names)
    assert {"sam_gov", "nyc_procurement"} <= set(names)
    with pytest.raises(KeyError, match="Unknown source 'x'; registered: .*sam_gov"):
        get_source("x")
    row = T.StructType([T.StructField("id", T.StringType()), T.StructField("t", T.StringType())])
    spec = SourceSpec(
        name="own", base_url="https://own", row_type=row, page_size=1, mapping={"title": "t"},
        read_pages=lambda s, p: s.createDataFrame(
            [(0, None, [("1", "x")])],
            T.StructType(
                [
                    T.StructField("page_offset", T.LongType()),
                    T.StructField("total_records", T.LongType()),
                    T.StructField("rows", T.ArrayType(row)),
                ]
            ),
        ),
        key=lambda: F.col("id"), url=lambda: F.concat(F.lit("https://own/"), F.col("source_id")),
    )
    register_source(spec)
    try:
        assert get_source("own").start_url() == "https://own"
        row = read_source(spark, get_source("own"), "").select(content_text("extracted"), "source_url").first()
        assert tuple(row) == ("[('title', 'x')]", "https://own/1")
    finally:
        sources.spec._REGISTRY.pop("own")


def test_checkpoint(spark):
    rows = spark.createDataFrame(
        [("a", "1", 0), ("a", "2", 1), ("a", "3", 2), ("b", "1", 0), ("c", "1", 0), ("c", "1", 1)],
        "source_name string, source_id string, seq long",
    )
    marks = spark.createDataFrame(
        [("a", "3"), ("b", "9"), ("c", "1")], "source_name string, source_id string"
    )
    got = sorted((r.source_name, r.source_id) for r in take_until_checkpoint(rows, marks).collect())
    assert got == [("a", "1"), ("a", "2"), ("b", "1")]


def test_snapshot_names(spark):
    pages = spark.createDataFrame(
        [(1, "https://x/a/b?q=1", "<p>"), (2, "https://x/" + "y" * 70, "")],
        "page_id long, url string, html string",
    )
    got = [r.snapshot_name for r in page_snapshots(pages, "s", "error").orderBy("source_id").collect()]
    assert got == ["error_b?q=1.html", "error_" + "y" * 60 + ".html"]


def test_collect_runs(spark, tmp_path):
    landing = tmp_path / "landing"
    land_federal(landing / "sam_gov", [[notice(1), notice(2)]])
    land_city(landing / "nyc_procurement", [[city_row(1), city_row(1), city_row(1, pin="new")]])
    table = raw_table(str(tmp_path / "raw"))
    paths = default_paths(str(landing))
    at = F.lit("2024-02-01").cast("timestamp")

    def run(batch, paths=paths, **more):
        return collect(spark, table, paths, batch, fetched_at=at, **more).first()

    first = run(0)
    assert (first.items_collected, first.items_skipped, first.failures) == (4, 1, 0)
    stored = {r.source_id: r for r in table.read(spark).collect()}
    assert set(stored) == {"n1", "n2", "r1"}
    assert stored["r1"].extracted["pin"] == "new"
    again = run(10, resume=False)
    # the city row goes back to its first form and forth again
    assert (again.items_collected, again.items_skipped) == (2, 3)
    # n2 was stored last, so only what comes before it is read again
    resumed = run(20, {"sam_gov": paths["sam_gov"], "unheard": "/nowhere"})
    assert (resumed.items_collected, resumed.items_skipped, resumed.failures) == (0, 1, 1)
    assert {r.source_id for r in table.read(spark).collect()} == {"n1", "n2", "r1"}
    times = {r.source_id: r.fetched_at for r in table.read(spark).collect()}
    assert times["n2"] > times["n1"]


def numbers(table, spark):
    return sorted(int(r.source_id[1:]) for r in table.read(spark, columns=()).collect())


@pytest.mark.parametrize("filed", [True, False])
def test_a_growing_folder_loses_nothing(spark, tmp_path, filed):
    """A newer listing is cut at the checkpoint's place in itself, not at its place in an old one."""
    landing, table = tmp_path / "sam_gov", raw_table(str(tmp_path / "raw"))
    for run, newest in enumerate((3, 9, 30)):
        folder = landing / f"run={run}" if filed else landing
        rows = [notice(i) for i in range(newest, 0, -1)]
        folder.mkdir(parents=True, exist_ok=True)
        pages = [
            json.dumps({"offset": k, "totalRecords": newest, "opportunitiesData": rows[k : k + 25]})
            for k in range(0, newest, 25)
        ]
        (folder / f"listing{run}.json").write_text("\n".join(pages))
        summary = collect(spark, table, {"sam_gov": str(landing)}, 10 * run).first()
        assert (summary.items_collected, summary.failures) == (newest - (0, 3, 9)[run], 0)
        assert numbers(table, spark) == list(range(1, newest + 1))


def land_runs(folder, *runs):
    """One file a run, a page a line; a run is a list of pages of notice numbers."""
    for run, pages in enumerate(runs, 1):
        place = folder / f"run={run}"
        place.mkdir(parents=True)
        lines = [
            json.dumps({"offset": 25 * k, "opportunitiesData": [notice(i) for i in page]}) for k, page in enumerate(pages)
        ]
        (place / "listing.json").write_text("\n".join(lines))
        os.utime(place / "listing.json", (1000 + run, 1000 + run))
    return str(folder)


def test_an_empty_page_ends_its_own_listing_only(spark, tmp_path):
    path = land_runs(tmp_path / "sam_gov", [[1], [], [9]], [[2], [3], [4]])
    got = read_source(spark, get_source("sam_gov"), path, until_empty=True)
    assert sorted(r.source_id for r in got.collect()) == ["n1", "n2", "n3", "n4"]
    table = raw_table(str(tmp_path / "raw"))
    assert collect(spark, table, {"sam_gov": path}, 0, until_empty=True).first().items_collected == 4
    assert numbers(table, spark) == [1, 2, 3, 4]


def test_the_checkpoint_is_the_last_record_of_the_last_listing(spark, tmp_path):
    """A short listing that landed after a long one: what it ends with is stored last."""
    path = land_runs(tmp_path / "sam_gov", [[3, 2, 1]], [[11]])
    table = raw_table(str(tmp_path / "raw"))
    collect(spark, table, {"sam_gov": path}, 0)
    assert latest_per_source(table.read(spark)).first().source_id == "n11"
    times = {r.source_id: r.fetched_at for r in table.read(spark).collect()}
    assert sorted(times, key=times.get) == ["n3", "n2", "n1", "n11"]


def test_a_changed_record_of_a_later_listing_wins(spark, tmp_path):
    """The same key in two listings of one run, the later one at an earlier place."""
    path = land_runs(tmp_path / "sam_gov", [[1, 2, 3]], [[3]])
    later = tmp_path / "sam_gov" / "run=2" / "listing.json"
    page = {"offset": 0, "opportunitiesData": [notice(3) | {"title": "new"}]}
    later.write_text(json.dumps(page))
    os.utime(later, (2000, 2000))
    table = raw_table(str(tmp_path / "raw"))
    assert collect(spark, table, {"sam_gov": path}, 0).first().items_collected == 4
    assert {r.source_id: r.extracted["title"] for r in table.read(spark).collect()}["n3"] == "new"


def test_many_listings_follow_each_other(spark, monkeypatch):
    """The same starts by ranges as by one window."""
    import datetime

    from noticemill.sources import spec as spec_module

    stamps = [datetime.datetime(2024, 1, 1, 0, 0, k * 7 % 40) for k in range(40)]
    rows = [(f"l{k % 40}", (stamps[k % 40], f"/f{k}"), k * 3 % 17) for k in range(200)]
    frame = spark.createDataFrame(
        rows, "landing string, landed struct<file_modification_time:timestamp,file_path:string>, seq long"
    )
    few = sorted(map(tuple, spec_module.listing_starts(frame).collect()))
    monkeypatch.setattr(spec_module, "is_small", lambda df: False)
    assert sorted(map(tuple, spec_module.listing_starts(frame).collect())) == few


def test_pages_without_a_place_or_cut_off_are_failures(spark, tmp_path):
    federal, city = tmp_path / "sam_gov", tmp_path / "nyc_procurement"
    federal.mkdir()
    pages = [
        {"opportunitiesData": [notice(1)]},
        {"offset": 25, "totalRecords": 99, "opportunitiesData": [notice(2)]},
    ]
    (federal / "a.json").write_text("\n".join(map(json.dumps, pages)))
    land_city(city, [[city_row(1)], [city_row(2)]])
    (city / "page_offset=50" / "response.json").write_text(json.dumps([city_row(2)])[:-9])
    table = raw_table(str(tmp_path / "raw"))
    summary = collect(spark, table, default_paths(str(tmp_path)), 0).first()
    assert (summary.items_collected, summary.failures) == (2, 2)
    aside = table.read_aside(spark, "unreadable").collect()
    assert sorted((r.source_name, r.reason) for r in aside) == [
        ("nyc_procurement", "not a response"), ("sam_gov", "no offset"),
    ]
    assert {r.source_id for r in table.read(spark).collect()} == {"n2", "r1"}


def test_whole_file_responses(spark, tmp_path):
    path = tmp_path / "f"
    path.mkdir()
    page = {"offset": 0, "totalRecords": 1, "opportunitiesData": [notice(1)]}
    (path / "a.json").write_text(json.dumps(page, indent=2))
    spec = get_source("sam_gov")
    assert read_source(spark, spec, str(path)).count() == 0
    table = raw_table(str(tmp_path / "raw"))
    assert collect(spark, table, {"sam_gov": str(path)}, 0).first().failures == 1
    whole = dataclasses.replace(spec, read_pages=sources.federal.read_whole_pages)
    assert [r.source_id for r in read_source(spark, whole, str(path)).collect()] == ["n1"]


def test_several_runs_for_one_city_page_need_run_folders(spark, tmp_path):
    land_city(tmp_path / "c", [[city_row(1)]])
    (tmp_path / "c" / "page_offset=0" / "later.json").write_text(json.dumps([city_row(2)]))
    with pytest.raises(ValueError, match="run=<n>"):
        read_source(spark, get_source("nyc_procurement"), str(tmp_path / "c"))


def pack_city(folder, lines):
    (folder / "packed").mkdir(parents=True)
    (folder / "packed" / "part.json").write_text(
        "\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines)
    )
    return str(folder)


def test_packed_city_pages_are_read_as_single_ones(spark, tmp_path):
    pages = [[city_row(1), city_row(2, section="Hearings")], [city_row(3, pin="a\nb ü")]]
    single = read_source(spark, get_source("nyc_procurement"), land_city(tmp_path / "s", pages))
    frame = spark.createDataFrame(
        [(50 * i, json.dumps(rows, indent=1)) for i, rows in enumerate(pages)], "page_offset long, value string"
    )
    sources.city.pack(frame, str(tmp_path / "p"))
    packed = read_source(spark, get_source("nyc_procurement"), str(tmp_path / "p"))
    columns = ("seq", "source_id", "source_url", "content_hash", "extracted")
    assert sorted(map(str, packed.select(*columns).collect())) == sorted(map(str, single.select(*columns).collect()))
    # both forms in one folder
    land_city(tmp_path / "p", [[], [], [city_row(4)]])
    for place in ("page_offset=0", "page_offset=50"):
        os.remove(tmp_path / "p" / place / "response.json")
        os.rmdir(tmp_path / "p" / place)
    both = read_source(spark, get_source("nyc_procurement"), str(tmp_path / "p")).collect()
    assert sorted((r.seq, r.source_id) for r in both) == [(0, "r1"), (50, "r3"), (100, "r4")]


def test_packed_city_pages_without_a_place_or_cut_off_are_failures(spark, tmp_path):
    city = tmp_path / "nyc_procurement"
    whole = json.dumps([city_row(1)])
    lines = [
        {"page_offset": 0, "response": whole},
        {"response": json.dumps([city_row(2)])},
        {"page_offset": 50, "response": whole[:-9]},
        {"page_offset": 100},
        json.dumps({"page_offset": 150, "response": whole})[:-9],
        json.dumps({"page_offset": "x", "response": json.dumps([city_row(3)])}),
    ]
    pack_city(city, lines)
    table = raw_table(str(tmp_path / "raw"))
    summary = collect(spark, table, {"nyc_procurement": str(city)}, 0).first()
    assert (summary.items_collected, summary.failures) == (1, 1)
    aside = table.read_aside(spark, "unreadable").collect()
    assert sorted((r.reason, r.response or "") for r in aside) == sorted(
        [
            ("no offset", lines[1]["response"]), ("not a response", whole[:-9]), ("not a response", ""),
            ("not a response", lines[4]), ("not a response", lines[5]),
        ]
    )


def test_several_packed_responses_for_one_city_page_need_run_folders(spark, tmp_path):
    lines = [{"page_offset": 0, "response": json.dumps([city_row(i)])} for i in (1, 2)]
    with pytest.raises(ValueError, match="run=<n>"):
        read_source(spark, get_source("nyc_procurement"), pack_city(tmp_path / "c", lines))
    for run, line in enumerate(lines):
        (tmp_path / "r" / "packed" / f"run={run}").mkdir(parents=True)
        (tmp_path / "r" / "packed" / f"run={run}" / "part.json").write_text(json.dumps(line))
    rows = read_source(spark, get_source("nyc_procurement"), str(tmp_path / "r")).collect()
    assert sorted((r.source_id, r.landing) for r in rows) == [("r1", "run=0"), ("r2", "run=1")]


def test_landed_city_responses_do_not_take_a_file_each(spark, tmp_path):
    rows = [(i, f"C{i}", "BUILDING") for i in range(3000)]
    schema = "c_custkey long, c_name string, c_mktsegment string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "customer.parquet"))
    orders = "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate date"
    spark.createDataFrame([], orders).write.parquet(str(tmp_path / "orders.parquet"))
    for land in (suite_records._landed, suite_records._broken):
        folder = land(spark, str(tmp_path))["nyc_procurement"]
        pages = get_source("nyc_procurement").read_pages(spark, folder)
        assert pages.count() == 60
        assert len(pages.inputFiles()) <= 8
