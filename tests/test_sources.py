"""Readers, the archive, the batch plan and the streams."""

import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alertlake.operators.gazetteer import alias_table, code_of_region, first_place, with_places, without_fallback
from alertlake.operators.pairing import pair_alerts, tokens_of
from alertlake.plans.collect import archived, collect, purge_archive
from alertlake.sources import archive, gazetteer, posts
from alertlake.streaming import ingest
from alertlake.streaming.pairing import TOKEN, pair_stream, stream_tokens, with_rocksdb

PAGE = """<div class="tgme_widget_message_wrap"><div class="tgme_widget_message" data-post="chan/100">
<div class="tgme_widget_message_forwarded_from">from <a class="tgme_widget_message_forwarded_from_name">Some &amp; One</a></div>
<div class="tgme_widget_message_text">Line <b>one</b><br/>two</div><a><time datetime="2026-09-21T02:25:00+00:00">x</time></a></div></div>
<div data-post="chan/101"><div class="tgme_widget_message_text">no time</div></div>
<div data-post="chan/102"><img src="x"><div class="tgme_widget_message_text">three</div><time datetime="2026-09-21T05:28:00+03:00"></time></div>"""
FEED = """<?xml version="1.0"?><rss><channel><title>t</title>
<item><title>Start</title><link>http://a/1</link><guid>1</guid><pubDate>Sun, 21 Sep 2026 02:25:00 GMT</pubDate><description><![CDATA[<p>body &amp; more</p>]]></description></item>
<item><title>Undated</title><link>http://a/2</link><description>d</description></item></channel></rss>"""


def at(minutes):
    return datetime(2026, 9, 21) + timedelta(minutes=minutes)


def test_html_posts(spark):
    rows = posts.posts_from_html(spark.createDataFrame([(PAGE,), (None,), ("<p>",)], "html string")).orderBy("post_id").collect()
    assert [(r["channel"], r["post_id"], r["published_at"], r["text"], r["forwarded_from"]) for r in rows] == [
        ("chan", "100", at(145), "Line one\ntwo", "Some & One"),
        ("chan", "102", at(148), "three", None),
    ]
    assert rows[0]["url"] == "https://t.me/chan/100"


def test_rss_posts(spark):
    rows = posts.posts_from_rss(spark.createDataFrame([("src", "http://feed", FEED)], "source_id string, feed_url string, xml string")).collect()
    assert [(r["published_at"], r["text"], r["url"]) for r in rows] == [(at(145), "Start body & more", "http://a/1")]


def test_overlaid_keeps_the_last_crawl(spark):
    mk = lambda *rows: spark.createDataFrame([("c", i, at(0), t, "", None) for i, t in rows], posts.POST)
    assert {(r["post_id"], r["text"]) for r in posts.overlaid(mk(("1", "a"), ("2", "b")), mk(("2", "c"))).collect()} == {("1", "a"), ("2", "c")}


def test_place_dump_and_catalog(spark, tmp_path):
    cols = ["1", "Самара", "Samara", "Самара,Samarа,123", "53.2", "50.1", "P", "PPLA", "RU", "", "65", "", "", "", "1100000", "", "", "", "2020-01-01"]
    (tmp_path / "d.txt").write_text("\n".join(["\t".join(cols), "\t".join(cols[:5]), "\t".join([*cols[:4], "x", *cols[5:]]), "\t".join([*cols[:8], "US", *cols[9:]])]), encoding="utf-8")
    dump = gazetteer.place_dump(spark, str(tmp_path / "d.txt"), "RU")
    made = gazetteer.cities(dump, spark.createDataFrame([("65", "samara")], "code string, region string")).collect()
    assert [(r["name"], r["region"], r["rank"], r["aliases"]) for r in made] == [("Самара", "samara", 1, ["Самара", "Samara", "Samarа"])]
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.write(tmp_path / "d.txt", "d.txt")
    assert [r["name"] for r in gazetteer.place_dump(spark, str(tmp_path / "d.zip"), "RU").collect()] == ["Самара"]
    assert gazetteer.write_catalog(places(spark), str(tmp_path / "catalog")) == {"city": 2, "district": 2}
    assert gazetteer.read_catalog(spark, str(tmp_path / "catalog")).count() == 4 and gazetteer.read_catalog(spark, str(tmp_path / "none")).collect() == []


def test_geojson(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"A"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}},{"type":"Feature","properties":{"name":"B"},"geometry":{"type":"MultiPolygon","coordinates":[[[[5,5],[6,5],[6,6],[5,5]]]]}}]}')
    rows = {r["region"]: r["polygon"] for r in gazetteer.shapes(spark, str(tmp_path / "g.json")).collect()}
    assert len(rows["A"][0]) == 4 and rows["B"][0][1]["lon"] == 6


PLACES = [
    ("1", "Самара", "Самара", "samara", "city", 53.2, 50.1, 1100000, "P", ["Самара"], 1),
    ("2", "Тольятти", "Тольятти", "samara", "city", 53.5, 49.4, 700000, "P", ["Тольятти"], 2),
    ("3", "Лискинский район", "Лискинский район", "voronezh", "district", 51.0, 39.5, 0, "A", ["Лискинский район"], 1),
    ("4", "Острогожский район", "Острогожский район", "voronezh", "district", 50.9, 39.1, 0, "A", ["Острогожский район"], 2),
]


def places(spark):
    return spark.createDataFrame(PLACES, f"{gazetteer.PLACE}, rank int")


def test_places_in_cases_and_lists(spark):
    aliases = alias_table(places(spark))
    rows = [(1, "samara", "Фиксация БПЛА в Самаре и Тольятти"), (2, "voronezh", "Лискинский и Острогожский районы: внимание"), (3, "voronezh", "Лискинский характер без пояснений"), (4, "voronezh", "Самара далеко"), (5, "samara", "самарец")]
    found = with_places(spark.createDataFrame(rows, "post_key long, region string, text string"), aliases)
    got = {r["post_key"]: [p["name"] for p in r["places"]] for r in found.collect()}
    assert got == {1: ["Самара", "Тольятти"], 2: ["Лискинский район", "Острогожский район"], 3: [], 4: [], 5: []}


def test_layers_codes_and_fallback(spark):
    a = spark.createDataFrame([("r", "x", None, 1.0), ("r", "y", 1.0, 1.0)], "region string, name string, lat double, lon double")
    b = spark.createDataFrame([("r", "x", 2.0, 2.0), ("r", "y", 9.0, 9.0)], "region string, name string, lat double, lon double")
    assert {(r["name"], r["lat"]) for r in first_place(a, b).collect()} == {("x", 2.0), ("y", 1.0)}
    codes = spark.createDataFrame([("1", "Samara Oblast"), ("2", "Omsk"), ("3", "Nowhere")], "code string, code_name string")
    regions = spark.createDataFrame([("samara", 1, ["Samara"]), ("omsk", 2, ["Omsk", "Omsk Oblast"])], "region string, rank int, aliases array<string>")
    assert {(r["code"], r["region"]) for r in code_of_region(codes, regions).collect()} == {("1", "samara"), ("2", "omsk")}
    rows = spark.createDataFrame([("A", "monitoring_local", False), ("A", "monitoring_national", True), ("B", "monitoring_national", True)], "region string, source_layer string, fallback_only_if_no_local_activity boolean")
    assert sorted((r["region"], r["source_layer"]) for r in without_fallback(rows).collect()) == [("A", "monitoring_local"), ("B", "monitoring_national")]


SOURCES = "source string, channel string, region string, region_label string, region_aliases array<string>, default_scope string, source_layer string, require_region_match boolean, fallback_to_region_on_unresolved boolean, fallback_only_if_no_local_activity boolean, expected_active boolean"


@pytest.fixture(scope="module")
def run(spark):
    rows = [
        ("c1", "1", at(0), "В Самарской области объявлена беспилотная опасность", "u1", None),
        ("c1", "2", at(10), "В Тольятти введен режим «Беспилотная опасность»", "u2", None),
        ("c1", "3", at(60), "Отбой беспилотной опасности на всей территории области", "u3", None),
        ("c1", "4", at(70), "Самара. Фиксация от 3 БПЛА", "u4", None),
        ("c1", "5", at(75), "За минувшие сутки уничтожены 20 БПЛА", "u5", None),
        ("c1", "6", at(80), "Опасность атаки БПЛА", "u6", None),
        ("shared", "7", at(90), "Воронежская область. Фиксация БПЛА", "u7", None),
        ("shared", "7", at(90), "Воронежская область. Фиксация БПЛА", "u7", None),
    ]
    feed = spark.createDataFrame(rows, posts.POST)
    sources = spark.createDataFrame(
        [
            ("s1", "c1", "samara", "Самарская область", ["Самарской области"], None, "official_local", False, False, False, True),
            ("s2", "shared", "samara", "Самарская область", [], None, "monitoring_national", True, True, True, True),
            ("s3", "shared", "voronezh", "Воронежская область", [], None, "monitoring_national", True, True, True, True),
        ],
        SOURCES,
    )
    fetched = spark.createDataFrame([(s, "html", True, True) for s in ("s1", "s2", "s3")], "source string, transport string, transport_ok boolean, window_complete boolean")
    return collect(feed, sources, places(spark), fetched, F.lit(at(-60)), F.lit(at(600)))


def test_collected_events_and_reports(run):
    events = {(r["place"], r["start"], r["end"], r["precision"], r["end_match"]) for r in run.events.collect()}
    assert events == {("samara", at(0), at(60), "exact_region", "regional_clear"), ("Тольятти", at(10), at(60), "exact_local", "regional_clear")}
    reports = {(r["source"], r["at"], r["place"], r["count"], r["activity_kind"]) for r in run.reports.collect()}
    assert ("s1", at(70), "Самара", 3, "uav_detected") in reports and ("s3", at(90), "voronezh", None, "uav_detected") in reports
    assert all(s != "s2" and t != at(75) for s, t, *_ in reports)
    assert [(r["type"], r["start"]) for r in run.unmatched.collect()] == [("unplaced_start", at(80))]
    status = {r["source"]: (r["health"], r["posts"]) for r in run.status.collect()}
    assert status == {"s1": ("healthy", 6), "s2": ("healthy", 0), "s3": ("healthy", 1)}
    totals = run.totals.first()
    assert totals["events_total"] == 2 and totals["regions_with_records"] == 2


def test_archive_round_trip(spark, run, tmp_path):
    root = str(tmp_path / "archive")
    assert archive.read_archive(spark, root, "events") is None
    tables = archived(run, None, None, F.lit(at(-60)))
    archive.write_archive(tables, run.status, root, at(-60), at(600), "initial")
    old = archive.read_archive(spark, root, "events"), archive.read_archive(spark, root, "reports")
    again = archived(run, *old, F.lit(at(-60)))
    archive.write_archive(again, run.status, root, at(-60), at(600), "incremental")
    assert archive.read_archive(spark, root, "events").count() == 2
    assert archive.read_archive(spark, root, "reports").count() == old[1].count()
    with pytest.raises(ValueError, match="every source failed"):
        archive.write_archive(tables, run.status.withColumn("ok", F.lit(False)), root, at(0), at(1), "incremental")


def test_stream_pairs_as_the_batch_does(spark, run, tmp_path):
    batch = pair_alerts(tokens_of(run.posts), F.lit(at(-60)), F.lit(at(600)))
    want = {(r["source"], r["threat_class"], r["start"], r["end"], r["precision"], r["end_match"]) for r in batch.collect()}
    rows = stream_tokens(run.posts).orderBy("published_at", "post_id", "sub").collect()
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, TOKEN).coalesce(1).write.json(str(tmp_path / f"in/{i}"))
    source = with_rocksdb(spark).readStream.schema(TOKEN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    query = pair_stream(source).writeStream.format("memory").queryName("paired").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["source"], r["threat"], r["start"], r["end"], r["precision"], r["end_match"]) for r in spark.table("paired").collect()}
    assert got == want and len(got) == 2


def test_stream_of_posts_is_logged_once(spark, tmp_path):
    rows = [("c", "1", at(0), "a", "u", None), ("c", "1", at(0), "a", "u", None), ("c", "2", at(1), "b", "u", None)]
    spark.createDataFrame(rows, posts.POST).coalesce(1).write.json(str(tmp_path / "in"))
    stream = ingest.read_posts(spark, str(tmp_path / "in")).withColumn("quality", F.lit(10))
    ingest.append_versions(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    spark.createDataFrame([("c", "2", at(1), "better", "u", None)], posts.POST).withColumn("quality", F.lit(30)).write.parquet(str(tmp_path / "log/batch=99"))
    now = ingest.current(spark, str(tmp_path / "log"), ["channel", "post_id"], ["quality"])
    assert {(r["post_id"], r["text"]) for r in now.collect()} == {("1", "a"), ("2", "better")}


def test_late_correction_of_a_stream(spark, tmp_path):
    schema = "id int, threat_class string, signal_class string, activity_kind string, count int, count_type string, text string"
    rows = [(1, "uav", "uav_activity_signal", "uav_warning", None, "official_activity", "Силами ПВО уничтожен БПЛА."), (2, "uav", "uav_activity_signal", "uav_detected", None, "official_activity", "Хорошая погода."), (3, "uav", "uav_activity_signal", "uav_detected", None, "x", "За ночь уничтожены 12 БПЛА.")]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    for run_no in range(2):  # a new checkpoint reads all again
        ingest.correct_reports(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / f"cp{run_no}")).awaitTermination(120)
    assert [(r["id"], r["activity_kind"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [(1, "air_defense_action")]


def test_state_of_a_stream_is_let_go(spark, tmp_path):
    tokens = [("s", "uav", "start", at(0), "1", 2, "p", "t"), ("s", "uav", "start", at(60 * 200), "2", 2, "q", "t"), ("s", "uav", "end", at(60 * 200 + 5), "3", 2, "p", "t"), ("s", "uav", "end", at(60 * 200 + 6), "4", 2, "q", "t")]
    for i, part in enumerate((tokens[:1], tokens[1:2], tokens[2:])):
        spark.createDataFrame(part, TOKEN).coalesce(1).write.json(str(tmp_path / f"in/{i}"))
    source = with_rocksdb(spark).readStream.schema(TOKEN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    pair_stream(source).writeStream.format("memory").queryName("let_go").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert [(r["place"], r["start_post_id"], r["end_post_id"]) for r in spark.table("let_go").collect()] == [("q", "2", "4")]


def test_purge_of_the_archive_is_done_once(spark, run, tmp_path):
    root = str(tmp_path / "archive")
    assert purge_archive(spark, root) == (0, 0)
    tables = archived(run, None, None, F.lit(at(-60)), places(spark))
    tally = tables["reports"].limit(1).withColumns({"id": F.lit("tally"), "text": F.lit("За ночь уничтожены 12 БПЛА.")})
    archive.write_archive({**tables, "reports": tables["reports"].unionByName(tally)}, run.status, root, at(-60), at(600), "initial")
    n = tables["reports"].count()
    assert purge_archive(spark, root, dry_run=True) == (1, 0) and archive.read_archive(spark, root, "reports").count() == n + 1
    assert purge_archive(spark, root) == (1, 0) and archive.read_archive(spark, root, "reports").count() == n
    assert archive.read_archive(spark, root, "coverage").first()["archive_reports_total"] == n
    before = archive.current_run(spark, root)
    assert purge_archive(spark, root) == (0, 0) and archive.current_run(spark, root) == before
