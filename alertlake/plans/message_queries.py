"""Queries of the message operators.

Posts are made of given rows: a document's text with a phrase before or behind it, which one its
id tells, its channel by a source, its time by an id. What each phrase says is a small table
beside it, and the SQL finds a row's answer by joining that. Operators that don't read Russian
work on the driver's tables as they are, with SQL that says the same.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertlake.functions import rules, times
from alertlake.functions.inflection import alias_forms_of, head_forms_of
from alertlake.functions.text import channel_of, count_label, loose_name, strict_name
from alertlake.operators import coverage, gazetteer, merge, reports
from alertlake.plans.collect import Run, archived, collect
from alertlake.plans.registry import query, table
from alertlake.sources import archive, posts
from alertlake.sources.gazetteer import PLACE, alias_set, municipalities

T0 = datetime(2026, 9, 21)


def at(minutes: int) -> datetime:
    return T0 + timedelta(minutes=minutes)


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S}'"
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def answers(columns: str, rows: list[tuple]) -> str:
    """SQL of a table of answers; columns: `name type, ...`."""
    names, kinds = zip(*(c.split(" ", 1) for c in columns.split(", ")), strict=True)
    names = [f'"{n}"' for n in names]
    cast = ", ".join(f"{n}::{k} AS {n}" for n, k in zip(names, kinds, strict=True))
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def spread(over: str, key: str, columns: str, rows: list[tuple], chosen: str = "") -> str:
    """SQL: the answer rows[key % len(rows)] for every row of a table, with its key (and more columns of it)."""
    own = ", ".join(c.split(" ", 1)[0] for c in columns.split(", "))
    return f"WITH said AS ({answers(f'i BIGINT, {columns}', [(i, *r) for i, r in enumerate(rows)])}) SELECT {key}, {own}{chosen} FROM {over} JOIN said ON i = {key} % {len(rows)}"


def phrase_of(key: Column, phrases: list[str | None]) -> Column:
    return F.get(F.array(*map(F.lit, phrases)), F.pmod(key, F.lit(len(phrases))).cast("int"))


def posts_saying(spark: SparkSession, sf_dir: str, phrases: list[str]) -> DataFrame:
    """doc_id, phrase, text: every document with a phrase on a line of its own before it or behind it."""
    d = table(spark, sf_dir, "documents").withColumn("phrase", phrase_of(F.col("doc_id"), phrases))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("\n", "phrase", "text")).otherwise(F.concat_ws("\n", "text", "phrase"))
    return d.select("doc_id", "phrase", text.alias("text"))


# What texts say of drones: (text, formal kind, what it reports).
UAV_SAID = [
    ("В Татарстане введен режим «Беспилотная опасность»", "start", "alert_start_signal"),
    ("В Татарстане снят режим «Беспилотная опасность»", "end", "alert_end_signal"),
    ("Снята угроза атаки БПЛА.", "end", "alert_end_signal"),
    ("В Тольятти действует режим «АТАКА БПЛА».", "start", "alert_start_signal"),
    ('Отмена сигнала "ОПАСНОСТЬ АТАКИ БПЛА".', "end", "alert_end_signal"),
    ("Отбой сигнала «Опасное небо».", "end", "alert_end_signal"),
    ("Объявлен режим «Опасное небо».", "start", "alert_start_signal"),
    ("Опасность атаки БПЛА не объявлялась.", None, "uav_attack_activity"),
    ("Ракетная опасность отменена, беспилотная опасность сохраняется.", "start", "alert_start_signal"),
    ("Хорошая погода.", None, None),
    ("Сернурский район. Фиксация БПЛА.", None, "uav_detected"),
    ("Саратовская область. Внимание по БПЛА.", None, "uav_warning"),
    ("Два БПЛА движутся в направлении города.", None, "uav_movement"),
    ("ПВО отражает атаку беспилотников.", None, "uav_attack_activity"),
    ("Обломки БПЛА упали на окраине города.", None, "impact_or_debris"),
    ("Силами ПВО уничтожен БПЛА.", None, "air_defense_action"),
    ("В районе сообщается о БПЛА.", None, "official_uav_activity"),
    ("Обсудили производство БПЛА на предприятии.", None, None),
    ("ОПАСНОСТЬ АТАКИ БПЛА. Не публикуйте работу ПВО.", "start", "alert_start_signal"),
    ("Отмена угрозы атаки БПЛА в Сочи.", "end", "alert_end_signal"),
    ("За минувшие сутки силы ПВО нейтрализовали пять вражеских беспилотников.", None, "historical_summary"),
    ("Губернатор сообщил о последствиях атаки БПЛА на Ульяновск.", None, "historical_summary"),
    ("Это очередной дипфейк о БПЛА.", None, None),
]
MISSILES_SAID = [
    ("Отбой ракетной опасности. Опасность атаки БПЛА сохраняется.", "end", "alert_end_signal"),
    ("Ракета летит в сторону города.", None, "missile_movement"),
    ("Объявлена ракетная опасность", "start", "alert_start_signal"),
    ("Космический корабль и ракета", None, None),
    ("Сбита ракета над морем.", None, "air_defense_action"),
    ("Зафиксирован пуск ракеты.", None, "missile_detected"),
    ("Пуск ракет с моря.", None, "missile_launch"),
    ("Хорошая погода.", None, None),
]


def told(spark: SparkSession, sf_dir: str, said: list[tuple], threat: rules.Threat) -> DataFrame:
    rows = posts_saying(spark, sf_dir, [t for t, *_ in said])
    return rows.select("doc_id", rules.formal_kind(F.col("text"), threat).alias("formal"), rules.activity_kind(F.col("text"), threat).alias("activity"))


@query(spread("documents", "doc_id", "formal VARCHAR, activity VARCHAR", [r[1:] for r in UAV_SAID]))
def uav_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, sf_dir, UAV_SAID, rules.THREATS[0])


@query(spread("documents", "doc_id", "formal VARCHAR, activity VARCHAR", [r[1:] for r in MISSILES_SAID]))
def missile_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, sf_dir, MISSILES_SAID, rules.THREATS[1])


# (text, signals as threat:kind, drones are spoken of, missiles are spoken of)
SIGNALS = [
    ("Отбой ракетной опасности. Опасность атаки БПЛА сохраняется.", "uav:start,missile:end", True, True),
    ("Объявлена ракетная опасность", "missile:start", False, True),
    ("Объявлен режим «Опасное небо».", "uav:start", True, False),
    ("Дроны и ракеты на выставке", "", True, True),
    ("Хорошая погода.", "", False, False),
]


@query(spread("documents", "doc_id", "signals VARCHAR, about_uav BOOLEAN, about_missile BOOLEAN", [r[1:] for r in SIGNALS]))
def formal_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts_saying(spark, sf_dir, [t for t, *_ in SIGNALS]).withColumn("published_at", F.lit(at(0)))
    told_ = F.array_join(F.transform("formal", lambda s: F.concat(s["threat"], F.lit(":"), s["kind"])), ",")
    return coverage.flagged(rows).select("doc_id", told_.alias("signals"), F.col("uav_reference").alias("about_uav"), F.col("missile_reference").alias("about_missile"))


# (text, threat, count, type, qualifier, second count, second type)
COUNTS = [
    ("Фиксация от 3 БПЛА", "uav", 3, "detected_reported", None, None, None),
    ("Фиксация около 2 БПЛА", "uav", 2, "detected_reported", "approx", None, None),
    ("Расчеты сбили и подавили 249 БПЛА", "uav", 249, "destroyed_or_suppressed", None, None, None),
    ("Регион атаковали более 10 БПЛА, из которых 4 сбиты", "uav", 10, "attacked", None, 4, "shot_down"),
    ("Обнаружены и уничтожены 7 беспилотников", "uav", 7, "detected_and_destroyed", None, None, None),
    ("На город летели примерно 5 беспилотников", "uav", 5, "incoming_reported", None, None, None),
    ("Тишина", "uav", None, None, None, None, None),
    ("Фиксация 2 ракет", "missile", 2, "missile_detected_reported", None, None, None),
    ("Летят 4 ракеты", "missile", 4, "missile_incoming_reported", None, None, None),
]


@query(spread("documents", "doc_id", "count INTEGER, count_type VARCHAR, qualifier VARCHAR, second_count INTEGER, second_type VARCHAR", [r[2:] for r in COUNTS]))
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts_saying(spark, sf_dir, [t for t, *_ in COUNTS]).withColumn("threat", phrase_of(F.col("doc_id"), [r[1] for r in COUNTS]))
    of = F.when(F.col("threat") == "uav", rules.count_of(F.col("text"), rules.THREATS[0])).otherwise(rules.count_of(F.col("text"), rules.THREATS[1]))
    return rows.withColumn("c", of).select("doc_id", "c.*")


# (text, looks back over completed work, spans regions, kind of record, live)
TALLIES = [
    ("За ночь уничтожены 12 БПЛА.", True, False, "air_defense_action", False),
    ("В период с 20:00 до 7:00 перехвачены беспилотники.", True, False, "air_defense_action", False),
    ("Уничтожены 159 БПЛА над территориями Брянской, Курской областей и Крымской республики.", True, True, "air_defense_action", False),
    ("Уничтожен БПЛА в районе города.", False, False, "air_defense_action", True),
    ("За ночь выпало 12 см снега.", False, False, None, False),
    ("Отбой опасности БПЛА", False, False, "alert_end_signal", False),
    ("Фиксация БПЛА", False, False, "uav_detected", True),
    ("Внимание по БПЛА", False, False, "uav_warning", False),
    ("Ранее сбит БПЛА", False, False, "air_defense_action", False),
    ("Опасность атаки БПЛА", False, False, "alert_start_signal", True),
]


@query(spread("documents", "doc_id", "retrospective BOOLEAN, over_regions BOOLEAN, kind VARCHAR, live BOOLEAN", [r[1:] for r in TALLIES]))
def tallies_and_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds are found in the posts themselves, but for those of TALLIES that no text tells."""
    rows = posts_saying(spark, sf_dir, [t for t, *_ in TALLIES]).withColumn("kind", phrase_of(F.col("doc_id"), [r[3] for r in TALLIES]))
    text = F.col("text")
    return rows.select("doc_id", rules.is_retrospective(text).alias("retrospective"), rules.spans_regions(text).alias("over_regions"), "kind", rules.is_live(text, F.col("kind")).alias("live"))


# (name of a place, a form, is it one, heads of the name's form as a list)
FORMS = [
    ("Самара", "Самаре", True, ""), ("Самара", "Самарой", True, ""), ("Самара", "Самарец", False, ""), ("Сочи", "Сочи", True, ""), ("Сочи", "Сочах", False, ""), ("Иваново", "Иваново", True, ""),
    ("Клинцовский район", "Клинцовском районе", True, None), ("Клинцовский район", "Клинцовского района", True, None), ("Лискинский район", "Лискинскому району", True, None), ("Лискинский район", "Лискинский", False, None),
]
HEADS = [("Лискинский район", "Лискинского", True), ("Стародубский муниципальный округ", "Стародубском", True), ("Стародубский муниципальный округ", "Стародубского муниципального", True), ("Самара", "Самаре", False)]


@query(f"""WITH f AS ({answers("i BIGINT, name VARCHAR, asked VARCHAR, form BOOLEAN", [(i, *r[:3]) for i, r in enumerate(FORMS)])}), h AS ({answers("i BIGINT, name VARCHAR, asked VARCHAR, head BOOLEAN", [(i, *r) for i, r in enumerate(HEADS)])})
          SELECT p_partkey, p_brand || ' ' || f.name AS place, f.form, h.head FROM part JOIN f ON f.i = p_partkey % {len(FORMS)} JOIN h ON h.i = p_partkey % {len(HEADS)}""")
def inflected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as places: is a phrase one of the forms that are looked for, or a head of them?"""
    key = F.col("p_partkey")
    own = lambda rows, k: phrase_of(key, [r[k] for r in rows])
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", own(FORMS, 0).alias("name"), own(FORMS, 1).alias("asked"), own(HEADS, 0).alias("of"), own(HEADS, 1).alias("asked_head"))
    form = F.array_contains(alias_forms_of()(F.array("name")), F.col("asked"))
    head = F.array_contains(head_forms_of()(F.array("of")), F.col("asked_head"))
    return rows.select("p_partkey", F.concat_ws(" ", "p_brand", "name").alias("place"), form.alias("form"), head.alias("head"))


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 1 THEN o_orderdate + INTERVAL (o_custkey % 86400) SECOND - INTERVAL 3 HOUR WHEN 4 THEN date_trunc('minute', o_orderdate + INTERVAL (o_custkey % 86400) SECOND) ELSE o_orderdate + INTERVAL (o_custkey % 86400) SECOND END AS instant FROM orders""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' times written in five ways, with a weekday that may be wrong, and two texts that are no date."""
    at_ = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") % 86400)
    ways = ["'Sun,' dd MMM yyyy HH:mm:ss 'GMT'", "dd MMM yyyy HH:mm:ss '+0300'", "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy-MM-dd'T'HH:mm:ss", "d MMM yyyy HH:mm 'UT'"]
    raw = F
    for i, way in enumerate(ways):
        raw = raw.when(F.col("o_orderkey") % 7 == i, F.date_format(at_, way))
    raw = raw.when(F.col("o_orderkey") % 7 == 5, "soon").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", times.parse_instant(raw).cast("timestamp_ntz").alias("instant"))


@query("""WITH d AS (SELECT doc_id, source, trim(regexp_replace(translate(text, '<>&', '   '), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g')) AS words FROM documents)
          SELECT 'html-' || source AS channel, doc_id, TIMESTAMP '2026-09-21' + INTERVAL (doc_id) MINUTE AS published_at, words || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'A & B' ELSE '' END AS text, CASE WHEN doc_id % 3 = 0 THEN 'Some & One' END AS forwarded_from FROM d WHERE doc_id % 5 <> 4
          UNION ALL SELECT 'rss-' || source, doc_id, TIMESTAMP '2026-09-21' + INTERVAL (doc_id) MINUTE, 'Item ' || doc_id || ' ' || words || ' & more', NULL FROM d WHERE doc_id % 5 <> 3""")
def posts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on channel pages and in feeds: some without a time are no posts."""
    key = F.col("doc_id")
    words = F.trim(F.regexp_replace(F.translate("text", "<>&", "   "), r"[ \t\n\r\x0B\f]+", " "))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", words.alias("words"), F.timestamp_seconds(F.unix_timestamp(F.lit(at(0))) + key * 60).alias("at"))
    bare = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    said = bare('<div class="tgme_widget_message_text"><b>', F.col("words"), "</b>", F.when(key % 2 == 0, "<br/>A &amp; B").otherwise(""), "</div>")
    from_ = F.when(key % 3 == 0, '<div>from <a class="tgme_widget_message_forwarded_from_name">Some &amp; One</a></div>').otherwise("")
    time = F.when(key % 5 != 4, bare('<time datetime="', F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), '">x</time>')).otherwise("")
    wraps = d.withColumn("wrap", bare('<div class="tgme_widget_message" data-post="html-', F.col("source"), "/", key.cast("string"), '">', from_, said, time, "</div>"))
    pages = wraps.groupBy("source", F.floor(key / 20)).agg(F.concat_ws("\n", F.array_sort(F.collect_list("wrap"))).alias("html"))
    date = F.when(key % 5 != 3, bare("<pubDate>", F.date_format("at", "'Sun,' dd MMM yyyy HH:mm:ss 'GMT'"), "</pubDate>")).otherwise("")
    item = bare("<item><title>Item ", key.cast("string"), "</title><link>http://a/", key.cast("string"), "</link><guid>", key.cast("string"), "</guid>", date, "<description><![CDATA[<p>", F.col("words"), " &amp; more</p>]]></description></item>")
    feeds = d.withColumn("item", item).groupBy("source", F.floor(key / 20)).agg(F.concat_ws("", F.lit('<?xml version="1.0"?><rss><channel><title>t</title>'), F.concat_ws("", F.collect_list("item")), F.lit("</channel></rss>")).alias("xml"))
    html = posts.posts_from_html(pages).withColumn("doc_id", F.col("post_id").cast("long"))
    rss = posts.posts_from_rss(feeds.select(F.concat(F.lit("rss-"), "source").alias("source_id"), F.lit("http://feed").alias("feed_url"), "xml"))
    rss = rss.withColumn("doc_id", F.substring_index("url", "/", -1).cast("long"))
    return html.unionByName(rss).select("channel", "doc_id", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "text", "forwarded_from")


PLACES = [
    ("1", "Самара", "Самара", "samara", "city", 53.2, 50.1, 1100000, "P", ["Самара"], 1),
    ("2", "Тольятти", "Тольятти", "samara", "city", 53.5, 49.4, 700000, "P", ["Тольятти"], 2),
    ("3", "Лискинский район", "Лискинский район", "voronezh", "district", 51.0, 39.5, 0, "A", ["Лискинский район"], 1),
    ("4", "Острогожский район", "Острогожский район", "voronezh", "district", 50.9, 39.1, 0, "A", ["Острогожский район"], 2),
]
NAMED = [
    ("samara", "Фиксация БПЛА в Самаре и Тольятти", "Самара,Тольятти"), ("voronezh", "Лискинский и Острогожский районы: внимание", "Лискинский район,Острогожский район"),
    ("voronezh", "Лискинский характер без пояснений", ""), ("voronezh", "Самара далеко", ""), ("samara", "самарец", ""), ("voronezh", "В Лискинском районе тихо", "Лискинский район"),
]


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLACES, f"{PLACE}, rank int")


@query(spread("documents", "doc_id", "names VARCHAR", [(r[2],) for r in NAMED]))
def places_in_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts_saying(spark, sf_dir, [r[1] for r in NAMED]).select(F.col("doc_id").alias("post_key"), phrase_of(F.col("doc_id"), [r[0] for r in NAMED]).alias("region"), "text")
    found = gazetteer.with_places(rows, gazetteer.alias_table(places(spark)))
    return found.select(F.col("post_key").alias("doc_id"), F.array_join(F.transform("places", lambda p: p["name"]), ",").alias("names"))


SHOWN = "array<struct<name:string,label:string,type:string,lat:double,lon:double>>"
OLD = [
    # id, region, text, place, scope, mentioned, then: place, scope, names, changed
    ("a", "samara", "Фиксация БПЛА в Самаре", "samara", "region", [], "Самара", "city", "Самара", True),
    ("b", "samara", "Фиксация БПЛА в Самаре", "Самара", "city", ["Самара"], "Самара", "city", "Самара", False),
    ("c", "samara", "Без мест", "Где-то", "city", ["Где-то"], "Где-то", "city", "Где-то", False),
    ("d", "voronezh", "Лискинский район: внимание", "Лискинский район", "region", ["Лискинский район"], "Лискинский район", "municipality", "Лискинский район", True),
    ("e", None, "Самара", "x", "region", [], "x", "region", "", False),
    ("f", "samara", None, "y", "region", [], "y", "region", "", False),
]


@query(spread("orders", "o_orderkey", "place VARCHAR, scope VARCHAR, names VARCHAR, changed BOOLEAN", [r[6:] for r in OLD], ", o_orderpriority AS priority"))
def reports_re_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as archived reports whose places are looked up again."""
    key, own = F.col("o_orderkey"), lambda k: phrase_of(F.col("o_orderkey"), [r[k] for r in OLD])
    mentioned = phrase_of(key, [",".join(r[5]) for r in OLD])
    shown = F.transform(F.filter(F.split(mentioned, ","), lambda n: n != ""), lambda n: F.struct(n.alias("name"), n.alias("label"), F.lit("city").alias("type"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")))
    none = F.lit(None).cast("double")
    old = table(spark, sf_dir, "orders").select(key.cast("string").alias("id"), own(1).alias("region"), own(2).alias("text"), own(3).alias("place"), own(4).alias("scope"), none.alias("lat"), none.alias("lon"), shown.alias("mentioned_places"), F.col("o_orderpriority").alias("priority"))
    found = gazetteer.re_enriched(old, gazetteer.alias_table(places(spark)))
    return found.select(F.col("id").cast("long").alias("o_orderkey"), "place", "scope", F.array_join(F.transform("mentioned_places", lambda p: p["name"]), ",").alias("names"), "changed", "priority")


# The batch job over small archives, one for each supplier: its sources, its channels, its days.
FEED_ROWS = [
    ("c1", 1, 0, "В Самарской области объявлена беспилотная опасность", None),
    ("c1", 2, 10, "В Тольятти введен режим «Беспилотная опасность»", None),
    ("c1", 3, 60, "Отбой беспилотной опасности на всей территории области", None),
    ("c1", 4, 70, "Самара. Фиксация от 3 БПЛА", None),
    ("c1", 5, 75, "За минувшие сутки уничтожены 20 БПЛА", None),
    ("c1", 6, 80, "Опасность атаки БПЛА", None),
    ("c1", 8, 85, "Опасность атаки БПЛА в Самаре", None),
    ("shared", 7, 90, "Воронежская область. Фиксация БПЛА", None),
    ("shared", 7, 90, "Воронежская область. Фиксация БПЛА", None),
    ("shared", 9, 95, "Фиксация БПЛА в Тольятти. Сообщает Минобороны", "Минобороны России"),
]
SOURCE = "source string, channel string, region string, region_label string, region_aliases array<string>, default_scope string, source_layer string, require_region_match boolean, fallback_to_region_on_unresolved boolean, fallback_only_if_no_local_activity boolean, expected_active boolean"
SOURCES = [
    ("s1", "c1", "samara", "Самарская область", ["Самарской области"], None, "official_local", False, False, False, True),
    ("s2", "shared", "samara", "Самарская область", [], None, "monitoring_national", True, True, True, True),
    ("s3", "shared", "voronezh", "Воронежская область", [], None, "monitoring_national", True, True, True, True),
]
FEED_COLUMNS = [("of", "string"), ("post_no", "int"), ("minute", "int"), ("said", "string"), ("forwarded", "string")]
SOURCE_COLUMNS = [tuple(c.split(" ")) for c in SOURCE.split(", ")]
LOW = at(-60)


def constant(value, kind: str) -> Column:
    return (F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)).cast(kind)


def each(rows: list[tuple], columns: list[tuple]) -> Column:
    """Explodes to a struct for each of the rows."""
    return F.explode(F.array(*(F.struct(*(constant(v, k).alias(c) for v, (c, k) in zip(r, columns, strict=True))) for r in rows)))


def own_name(*parts: Column | str) -> Column:
    return F.concat_ws("-", *(F.lit(x) if isinstance(x, str) else x for x in parts))


def feed_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of every supplier's two channels: each says the same some days after the one before."""
    key = F.col("s_suppkey").cast("string")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", each(FEED_ROWS, FEED_COLUMNS).alias("r"))
    at_ = F.timestamp_seconds(F.unix_timestamp(F.lit(at(0))) + F.col("s_suppkey") * 86400 + F.col("r.minute") * 60)
    return rows.select(own_name(F.col("r.of"), key).alias("channel"), F.col("r.post_no").cast("string").alias("post_id"), at_.alias("published_at"), F.concat(F.col("r.said"), F.lit("\n"), F.col("s_name")).alias("text"), own_name("u", key, F.col("r.post_no")).alias("url"), F.col("r.forwarded").alias("forwarded_from"))


def sources_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources of every supplier."""
    key = F.col("s_suppkey").cast("string")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", each(SOURCES, SOURCE_COLUMNS).alias("s"))
    return rows.select(own_name(F.col("s.source"), key).alias("source"), own_name(F.col("s.channel"), key).alias("channel"), *(f"s.{c}" for c, _ in SOURCE_COLUMNS[2:]))


def job(spark: SparkSession, sf_dir: str) -> Run:
    sources = sources_of(spark, sf_dir)
    fetched = sources.select("source", F.lit("html").alias("transport"), F.lit(True).alias("transport_ok"), F.lit(True).alias("window_complete"))
    feed = feed_of(spark, sf_dir)
    # The window ends with the last post, however many suppliers there are.
    high = feed.agg(F.unix_micros(F.max("published_at")).alias("high")).first()["high"]
    return collect(feed, sources, places(spark), fetched, F.lit(LOW), F.timestamp_micros(F.lit(high).cast("long")))


def ntz(*names: str) -> list[Column]:
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


def of_suppliers(columns: str, rows: list[tuple], shown: str) -> str:
    """SQL: each answer for each supplier, its times some days later."""
    return f"WITH said AS ({answers(columns, rows)}) SELECT {shown} FROM said, supplier"


JOB_EVENTS = [("s1", "samara", "samara", at(0), at(60), "region", "exact_region", "regional_clear"), ("s1", "samara", "Тольятти", at(10), at(60), "local", "exact_local", "regional_clear")]


@query(of_suppliers("s VARCHAR, region VARCHAR, place VARCHAR, a TIMESTAMP, b TIMESTAMP, scope VARCHAR, precision VARCHAR, end_match VARCHAR", JOB_EVENTS, "s || '-' || s_suppkey AS source, region, place, a + INTERVAL (s_suppkey) DAY AS start, b + INTERVAL (s_suppkey) DAY AS \"end\", scope, precision, end_match"))
def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that the batch job pairs: a clear of the whole region closes its places too."""
    return job(spark, sf_dir).events.select("source", "region", "place", *ntz("start", "end"), "scope", "precision", "end_match")


JOB_UNMATCHED = [("unmatched_start", "samara", "Самара", at(85)), ("unplaced_start", "samara", None, at(80))]


@query(of_suppliers("type VARCHAR, region VARCHAR, place VARCHAR, a TIMESTAMP", JOB_UNMATCHED, "type, 's1-' || s_suppkey AS source, region, place, a + INTERVAL (s_suppkey) DAY AS start"))
def job_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job(spark, sf_dir).unmatched.select("type", "source", "region", "place", *ntz("start"))


JOB_REPORTS = [
    ("s1", at(0), "samara", None, "alert_start_signal"), ("s1", at(10), "Тольятти", None, "alert_start_signal"), ("s1", at(60), "samara", None, "alert_end_signal"),
    ("s1", at(70), "Самара", 3, "uav_detected"), ("s1", at(80), "samara", None, "alert_start_signal"), ("s1", at(85), "Самара", None, "alert_start_signal"), ("s3", at(90), "voronezh", None, "uav_detected"),
]


@query(of_suppliers("s VARCHAR, a TIMESTAMP, place VARCHAR, count INTEGER, activity_kind VARCHAR", JOB_REPORTS, "s || '-' || s_suppkey AS source, a + INTERVAL (s_suppkey) DAY AS \"at\", place, count, activity_kind"))
def job_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the batch job: no tallies, none from ministry posts; a shared feed speaks for the region that it names."""
    return job(spark, sf_dir).reports.select("source", *ntz("at"), "place", "count", "activity_kind")


JOB_STATUS = [("s1", "healthy", 7, 4, 1), ("s2", "healthy", 1, 0, 0), ("s3", "healthy", 1, 0, 0)]


@query(of_suppliers("s VARCHAR, health VARCHAR, posts BIGINT, start_posts BIGINT, end_posts BIGINT", JOB_STATUS, "s || '-' || s_suppkey AS source, health, posts, start_posts, end_posts"))
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source of the batch job with the counts of its posts."""
    return job(spark, sf_dir).status.select("source", "health", "posts", "start_posts", "end_posts")


@query("SELECT 2 * count(*) AS archive_events_total, 7 * count(*) AS archive_reports_total, 2::BIGINT AS archive_regions_with_records, 1::BIGINT AS archive_regions_with_local_records, 0::BIGINT AS aggregate_reports_purged, 0::BIGINT AS reports_reclassified, 0::BIGINT AS reports_place_reenriched FROM supplier")
def job_archive_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive after the same run twice: merged, purged, judged and placed again, nothing is new."""
    run = job(spark, sf_dir)
    once = archived(run, None, None, F.lit(LOW), places(spark))
    again = archived(run, once["events"], once["reports"], F.lit(LOW), places(spark))
    return again["coverage"].select("archive_events_total", "archive_reports_total", "archive_regions_with_records", "archive_regions_with_local_records", "aggregate_reports_purged", "reports_reclassified", "reports_place_reenriched")


RECORDS = [
    # threat, signal, kind, count, count type, text; then: kept, kind, changed
    ("uav", "uav_activity_signal", "uav_detected", None, "official_activity", "Фиксация БПЛА.", True, "uav_detected", False),
    ("uav", "uav_activity_signal", "uav_detected", None, "official_activity", "Хорошая погода.", False, None, None),
    ("uav", "formal_alert_signal", "alert_start_signal", None, "alert_start_signal", "Хорошая погода.", True, "alert_start_signal", False),
    ("uav", "uav_activity_signal", "uav_warning", None, "official_activity", "Силами ПВО уничтожен БПЛА.", True, "air_defense_action", True),
    ("uav", "uav_activity_signal", "uav_detected", 150, "destroyed_or_suppressed", "Уничтожены 150 БПЛА", False, None, None),
    ("uav", "uav_activity_signal", "uav_detected", None, "official_activity", None, True, "uav_detected", False),
    ("missile", "missile_activity_signal", "missile_detected", None, "official_activity", "Ракета летит в сторону города.", True, "missile_movement", True),
]


@query(spread("orders", "o_orderkey", "kept BOOLEAN, activity_kind VARCHAR, changed BOOLEAN", [r[6:] for r in RECORDS]).replace("SELECT o_orderkey, kept, ", "SELECT o_orderkey, ") + " WHERE kept")
def purged_and_revalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as archived reports after the purge of tallies, under the rules of today."""
    own = lambda k: phrase_of(F.col("o_orderkey"), [r[k] for r in RECORDS])
    text = F.concat(own(5), F.lit("\n"), "o_orderpriority")
    names = ("threat_class", "signal_class", "activity_kind", "count", "count_type")
    df = table(spark, sf_dir, "orders").select("o_orderkey", *(own(k).alias(n) for k, n in enumerate(names)), text.alias("text"))
    return merge.revalidated(merge.purged_reports(df)).select("o_orderkey", "activity_kind", "changed")


# (text, forwarded from, is a repost of the ministry's): the third says the region's name, so it is about the region as a whole
CONTEXT = [("Сообщило Минобороны: сбиты БПЛА", None, True), ("Тихо", "Министерство обороны", True), ("Самарская область. Сообщило Минобороны: сбиты БПЛА", None, False), ("Тихо", "Сосед", False)]


@query(spread("documents", "doc_id", "repost BOOLEAN", [r[2:] for r in CONTEXT]))
def ministry_reposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reposts told by what a post says, where it is from, and whether it is found to be about its whole region."""
    rows = posts_saying(spark, sf_dir, [t for t, *_ in CONTEXT]).withColumn("forwarded_from", phrase_of(F.col("doc_id"), [r[1] for r in CONTEXT]))
    rows = rows.select("*", *(constant(v, k).alias(c) for v, (c, k) in zip(SOURCES[0], SOURCE_COLUMNS, strict=True)))
    named = gazetteer.in_scope(gazetteer.with_places(rows.withColumn("post_key", F.col("doc_id")), gazetteer.alias_table(places(spark))), gazetteer.region_phrases(spark.createDataFrame(SOURCES, SOURCE)))
    return named.withColumn("region_wide", gazetteer.is_region_wide()).select("doc_id", gazetteer.is_repost_of_ministry().alias("repost"))


@query("""SELECT n_nationkey, trim(regexp_replace(lower('Republic of ' || n_name || ' (Krai)'), '[^a-z0-9]+', ' ', 'g')) AS strict, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS loose FROM nation""")
def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Republic of "), "n_name", F.lit(" (Krai)"))
    return table(spark, sf_dir, "nation").select("n_nationkey", strict_name(name).alias("strict"), loose_name(name).alias("loose"))


@query("""WITH a AS (SELECT n_nationkey AS region, lower(n_name) || ' oblast' AS alias FROM nation), s AS (SELECT n_nationkey AS shape_id, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) || ' oblast' WHEN 1 THEN lower(n_name) WHEN 2 THEN 'greater ' || lower(n_name) ELSE 'nowhere' END AS name FROM nation),
          strict AS (SELECT shape_id, region FROM s JOIN a ON name = alias), bare AS (SELECT region, replace(alias, ' oblast', '') AS b FROM a),
          loose AS (SELECT DISTINCT shape_id, region FROM s, bare WHERE shape_id NOT IN (SELECT shape_id FROM strict) AND (name = b OR (length(b) >= 5 AND (contains(name, b) OR contains(b, name))))),
          u AS (SELECT shape_id, count(*) AS n, min(region) AS region FROM (SELECT * FROM strict UNION SELECT * FROM loose) GROUP BY shape_id)
          SELECT shape_id, CASE WHEN n = 1 THEN region::VARCHAR END AS region FROM (SELECT DISTINCT shape_id FROM s) LEFT JOIN u USING (shape_id)""")
def shape_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes with the strict names of regions, with bare ones, with longer ones, and with none."""
    n = table(spark, sf_dir, "nation")
    low, key = F.lower("n_name"), F.col("n_nationkey")
    name = F.when(key % 4 == 0, F.concat(low, F.lit(" oblast"))).when(key % 4 == 1, low).when(key % 4 == 2, F.concat(F.lit("greater "), low)).otherwise("nowhere")
    regions = n.select(key.cast("string").alias("region"), F.array(F.concat(low, F.lit(" oblast"))).alias("aliases"))
    return gazetteer.regions_of_shapes(n.select(key.alias("shape_id"), F.array(name).alias("names")), regions)


@query("""WITH p AS (SELECT n_regionkey AS region, n_name AS name, 'Land of ' || n_name AS label, n_nationkey::DOUBLE AS lat FROM nation),
          q AS (SELECT c_custkey AS row_id, n_regionkey AS region, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'the unknown' ELSE lower(n_name) END AS first, CASE c_custkey % 2 WHEN 0 THEN 'land of ' || lower(n_name) END AS second FROM customer JOIN nation ON c_nationkey = n_nationkey),
          k AS (SELECT region, name AS key, name, lat FROM p UNION ALL SELECT region, lower(name), name, lat FROM p UNION ALL SELECT region, lower(label), name, lat FROM p)
          SELECT row_id, coalesce(a.name, b.name) AS name, coalesce(a.lat, b.lat) AS lat FROM q LEFT JOIN k a ON a.region = q.region AND a.key = q.first LEFT JOIN k b ON b.region = q.region AND b.key = q.second""")
def places_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    known = n.select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.concat(F.lit("Land of "), "n_name").alias("label"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    key = F.col("c_custkey")
    first = F.when(key % 3 == 0, F.col("n_name")).when(key % 3 == 1, "the unknown").otherwise(F.lower("n_name"))
    rows = table(spark, sf_dir, "customer").join(n, F.expr("c_nationkey = n_nationkey")).select(key.alias("row_id"), F.col("n_regionkey").alias("region"), first.alias("first"), F.when(key % 2 == 0, F.concat(F.lit("land of "), F.lower("n_name"))).alias("second"))
    return gazetteer.looked_up(rows, known, ["first", "second"]).select("row_id", "found.name", "found.lat")


@query("""WITH l AS (SELECT c_nationkey AS region, c_mktsegment AS name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::DOUBLE END AS lat, 0 AS layer FROM customer UNION ALL SELECT s_nationkey, 'MACHINERY', s_suppkey::DOUBLE, 1 FROM supplier UNION ALL SELECT n_nationkey, 'BUILDING', n_nationkey::DOUBLE, 2 FROM nation)
          SELECT region, name, lat FROM (SELECT *, row_number() OVER (PARTITION BY region, name ORDER BY layer, lat) AS i FROM l WHERE lat IS NOT NULL) WHERE i = 1""")
def place_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of three tables: the first that knows one wins, and those without a point know nothing."""
    key = F.col("c_custkey")
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("name"), F.when(key % 3 == 0, key.cast("double")).alias("lat"), F.lit(1.0).alias("lon"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("region"), F.lit("MACHINERY").alias("name"), F.col("s_suppkey").cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region"), F.lit("BUILDING").alias("name"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    return gazetteer.first_place(a, b, c).select("region", "name", "lat")


@query("""WITH c AS (SELECT n_nationkey::VARCHAR AS code, lower(n_name) AS a FROM nation), r AS (SELECT n_nationkey AS region, lower(n_name) AS b FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT r_regionkey + 100, lower(r_name) FROM region),
          s AS (SELECT code, region, CASE WHEN a = b THEN 100 WHEN (contains(a, b) OR contains(b, a)) AND length(b) >= 4 THEN least(length(a), length(b)) END AS score FROM c, r)
          SELECT code, arg_max(region, (score, -region))::VARCHAR AS region FROM s WHERE score IS NOT NULL GROUP BY code""")
def codes_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    codes = n.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("code_name"))
    regions = n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("a")).union(r.select(F.col("r_regionkey") + 100, "r_name"))
    return gazetteer.code_of_region(codes, regions.select(F.col("id").cast("string").alias("region"), F.col("id").alias("rank"), F.array("a").alias("aliases")))


@query("""WITH n AS (SELECT 'RU.' || n_regionkey || '.' || n_nationkey AS code, n_name AS name FROM nation WHERE n_nationkey % 2 = 0), f AS (SELECT 'RU.' || n_regionkey || '.' || n_nationkey AS code, n_nationkey::DOUBLE AS lat, 1.0 AS lon FROM nation WHERE n_nationkey % 3 = 0),
          p AS (SELECT 'RU.' || n_regionkey || '.' || n_nationkey AS code, s_name AS name, s_suppkey / 10.0 AS lat, s_suppkey / 20.0 AS lon, s_suppkey % 50 AS pop FROM supplier JOIN nation ON s_nationkey = n_nationkey),
          c AS (SELECT code, sum(lat * sqrt(pop)) / sum(sqrt(pop)) AS lat, sum(lon * sqrt(pop)) / sum(sqrt(pop)) AS lon, avg(lat) AS alat, avg(lon) AS alon, sum(pop) AS pop FROM p GROUP BY code),
          s AS (SELECT code, arg_min(name, (-pop, name)) AS name FROM p GROUP BY code), k AS (SELECT code FROM n UNION SELECT code FROM f UNION SELECT code FROM p)
          SELECT k.code AS id, coalesce(n.name, s.name) AS name, 'R' || split_part(k.code, '.', 2) AS region, round(coalesce(f.lat, CASE WHEN c.pop > 0 THEN c.lat ELSE c.alat END), 6) AS lat, round(coalesce(f.lon, CASE WHEN c.pop > 0 THEN c.lon ELSE c.alon END), 6) AS lon
          FROM k LEFT JOIN n USING (code) LEFT JOIN f USING (code) LEFT JOIN c USING (code) LEFT JOIN s USING (code)""")
def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts known by name, by an area or by places: a full outer join of the three."""
    n = table(spark, sf_dir, "nation").withColumn("code", F.concat(F.lit("RU."), "n_regionkey", F.lit("."), "n_nationkey"))
    names = n.where("n_nationkey % 2 = 0").select("code", F.col("n_name").alias("name"), F.array("n_name").alias("aliases"))
    features = n.where("n_nationkey % 3 = 0").select("code", F.col("n_nationkey").cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    key = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").join(n, F.expr("s_nationkey = n_nationkey")).select("code", F.col("s_name").alias("name"), (key / 10.0).alias("lat"), (key / 20.0).alias("lon"), (key % 50).alias("population"))
    regions = n.select(F.concat(F.lit("RU."), "n_regionkey").alias("code"), F.concat(F.lit("R"), "n_regionkey").alias("region")).distinct()
    return municipalities(names, features, p, regions).select("id", "name", "region", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("""SELECT user_id, event_id % 40 AS post, arg_max(value, (crawl, ts, event_id)) AS value FROM (SELECT *, 0 AS crawl FROM events UNION ALL SELECT *, 1 FROM events WHERE event_type = 'click' UNION ALL SELECT *, 2 FROM events WHERE event_type = 'error') GROUP BY ALL""")
def crawls_overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three crawls of the same channels: of a post the last crawl's version stays."""
    e = table(spark, sf_dir, "events")
    as_posts = lambda df: df.select(F.col("user_id").cast("string").alias("channel"), (F.col("event_id") % 40).cast("string").alias("post_id"), F.col("ts").cast("timestamp").alias("published_at"), F.format_string("%09d", "event_id").alias("text"), F.col("value").cast("string").alias("url"), F.lit(None).cast("string").alias("forwarded_from"))
    found = posts.overlaid(as_posts(e), as_posts(e.where("event_type = 'click'")), as_posts(e.where("event_type = 'error'")))
    return found.select(F.col("channel").cast("long").alias("user_id"), F.col("post_id").cast("long").alias("post"), F.col("url").cast("double").alias("value"))


@query("""WITH p AS (SELECT user_id, event_id, ts, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1) // 20 AS page, 1000000 - row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS number FROM events),
          g AS (SELECT user_id, page, max(ts) AS newest FROM p WHERE NOT (user_id % 5 = 0 AND page = 2) GROUP BY ALL),
          r AS (SELECT user_id, page FROM g x WHERE NOT (user_id % 5 = 0 AND page > 2) AND NOT EXISTS (SELECT 1 FROM g y WHERE y.user_id = x.user_id AND y.page < x.page AND y.newest < TIMESTAMP '2024-01-12'))
          SELECT user_id, count(*) AS posts, min(number) AS last FROM p JOIN r USING (user_id, page) GROUP BY user_id""")
def pages_walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 20 posts, newest first; every fifth channel has an empty third page."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("channel"), (1000000 - back).cast("string").alias("post_id"), F.col("ts").cast("timestamp").alias("published_at"), F.lit("x").alias("text"), F.floor((back - 1) / 20).cast("int").alias("page_no"))
    rows = rows.where("not (channel % 5 = 0 and page_no = 2)")
    found = posts.walked(rows, F.lit("2024-01-12").cast("timestamp"))
    return found.groupBy(F.col("channel").cast("long").alias("user_id")).agg(F.count("*").alias("posts"), F.min(F.col("post_id").cast("long")).alias("last"))


@query("""SELECT c_custkey, CASE WHEN bad THEN 'html' ELSE 'mtproto' END AS transport, CASE WHEN bad THEN f_posts > 0 ELSE true END AS transport_ok, CASE WHEN bad THEN f_old ELSE c_custkey % 2 = 0 END AS window_complete
          FROM (SELECT c_custkey, c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR (c_custkey % 3 = 0 AND c_custkey % 4 <= 1) AS bad, c_custkey % 6 AS f_posts, c_custkey % 11 < 5 AS f_old FROM customer)""")
def transports_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback where the first transport failed, erred or found nothing."""
    key = F.col("c_custkey")
    at_ = lambda early: F.when(early, F.lit("2024-01-01 01:00:00")).otherwise(F.lit("2024-01-03")).cast("timestamp")
    c = table(spark, sf_dir, "customer")
    first = c.select(key.alias("channel"), F.lit("mtproto").alias("transport"), (key % 5 != 0).alias("transport_ok"), (key % 2 == 0).alias("window_complete"), F.when(key % 7 == 0, "flood").alias("error"), F.when(key % 3 == 0, 0).otherwise(4).alias("posts"), (key % 4).cast("int").alias("raw_items"), at_(F.lit(True)).alias("oldest"))
    html = c.select(key.alias("channel"), F.lit("html").alias("transport"), F.lit(True).alias("transport_ok"), F.lit(False).alias("window_complete"), F.lit(None).cast("string").alias("error"), (key % 6).cast("int").alias("posts"), F.lit(9).alias("raw_items"), at_(key % 11 < 5).alias("oldest"))
    found = merge.choose_transport(first, html, F.lit("2024-01-01").cast("timestamp"))
    return found.select(F.col("channel").alias("c_custkey"), "transport", "transport_ok", "window_complete")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'uav' WHEN c_custkey % 4 = 1 THEN 'missile' ELSE 'uav' END AS threat_class, CASE WHEN c_custkey % 5 = 0 THEN 17 WHEN c_custkey % 3 = 0 THEN 10 WHEN c_custkey % 2 = 0 THEN 20 ELSE 5 END AS quality,
          CASE WHEN c_custkey % 6 = 0 THEN 'own' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'ch_' || c_nationkey END AS source_id FROM customer""")
def record_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several ages: what is missing is told by what there is."""
    key = F.col("c_custkey")
    url = F.when(key % 7 != 0, F.concat(F.when(key % 2 == 0, "https://t.me/s/ch_").otherwise("t.me/ch_"), F.col("c_nationkey").cast("string"), F.lit("/12?x")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 4 == 0, "uav").alias("threat_class"), F.when(key % 4 == 1, "missile_alert").when(key % 4 == 2, "uav_alert").alias("alert_type"), F.when(key % 5 == 0, 17).alias("quality"), F.when(key % 3 == 0, "html").alias("transport"), F.when(key % 2 == 0, "telegram").otherwise("mchs_rss").alias("source_kind"), F.when(key % 6 == 0, "own").otherwise("").alias("source_id"), F.lit(None).cast("string").alias("url"), url.alias("start_url"))
    return merge.with_defaults(rows).select("c_custkey", "threat_class", "quality", "source_id")


@query("""SELECT event_id % 97 AS id, arg_max(event_id, event_id) AS last_one, arg_min(event_id, event_id) AS first_one FROM events GROUP BY ALL""")
def last_and_first_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with one id the last, and the first."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("id"), F.col("event_id").alias("seq"), (-F.col("event_id")).alias("back"))
    last = merge.best_version(rows, ["id"], ["seq"]).select("id", F.col("seq").alias("last_one"))
    return last.join(merge.best_version(rows, ["id"], ["back"]).select("id", F.col("seq").alias("first_one")), "id")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '≥' WHEN o_orderstatus = 'O' THEN '≈' ELSE '×' END || o_custkey % 9 AS label, CASE WHEN o_custkey % 3 = 0 THEN 'chan' || o_custkey % 10 END AS channel FROM orders""")
def labels_and_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_custkey")
    said = F.when(F.col("o_orderstatus") == "F", "at_least").when(F.col("o_orderstatus") == "O", "approx")
    url = F.when(key % 3 == 0, F.concat(F.when(key % 2 == 0, "https://t.me/s/chan").otherwise("http://t.me/chan"), (key % 10).cast("string"), F.lit("/77"))).when(key % 3 == 1, "https://example.com/t/me")
    return table(spark, sf_dir, "orders").select("o_orderkey", count_label((key % 9).cast("int"), said).alias("label"), channel_of(url).alias("channel"))


@query("""SELECT p_partkey, string_agg(w, ',' ORDER BY i) FILTER (rn <= 3) AS aliases FROM (SELECT p_partkey, w, i, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS rn FROM (
          SELECT p_partkey, arg_min(w, i) AS w, min(i) AS i FROM (SELECT p_partkey, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT p_partkey, list_concat(list_concat(string_split(p_name, ' '), [upper(split_part(p_name, ' ', 1)), '12', p_brand]), string_split(lower(p_type), ' ')) AS ws FROM part)) WHERE regexp_matches(w, '[A-Za-z]') GROUP BY p_partkey, lower(w))) GROUP BY p_partkey""")
def alias_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names in order, case folded, with a letter, three at most."""
    names = alias_set(F.split("p_name", " "), F.array(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit("12"), F.col("p_brand")), F.split(F.lower("p_type"), " "), limit=3)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names, ",").alias("aliases"))


@query("""SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || s_suppkey % 180 || '.5,' || s_nationkey || '.25]},"properties":{"id":' || s_suppkey || ',"name":"' || s_name || '"}}' AS feature FROM supplier
          UNION ALL SELECT '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[' || s_suppkey % 180 || '.5,0.5],[1.5,' || s_nationkey || '.25]]},"properties":{"id":' || s_suppkey || '}}' FROM supplier""")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points and as lines of two points."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 180 + 0.5).cast("double").alias("lon"), (F.col("s_nationkey") + 0.25).cast("double").alias("lat"))
    p = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    lines = s.select("id", F.array(p(F.col("lon"), F.lit(0.5)), p(F.lit(1.5), F.col("lat"))).alias("line"))
    return archive.geojson_points(s).union(archive.geojson_lines(lines))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS a, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS b FROM orders GROUP BY ALL), l AS (SELECT a, b FROM m ORDER BY b DESC LIMIT 1), n AS (SELECT b + INTERVAL 100 HOUR AS now, a, b FROM l)
          SELECT 'incremental' AS asked, 'incremental' AS mode, b AS window_start, now AS window_end FROM n UNION ALL SELECT 'replay_previous', 'replay_previous', a, b FROM n
          UNION ALL SELECT 'backfill', 'backfill', now - INTERVAL 24 HOUR, now FROM n UNION ALL SELECT 'incremental, no manifest', 'initial', now - INTERVAL 24 HOUR, now FROM n""")
def windows_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that kept a month of orders each: where the next one begins, in every mode."""
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    ends = F.expr("window_start + INTERVAL 1 MONTH")
    manifest = table(spark, sf_dir, "orders").select(month.alias("window_start")).distinct().select(F.date_format("window_start", "yyyy-MM").alias("run"), "window_start", ends.alias("window_end"), F.lit("initial").alias("mode"), (ends + F.expr("INTERVAL 10 MINUTES")).alias("published_at"))
    now = F.lit(manifest.agg(F.max("window_end") + F.expr("INTERVAL 100 HOURS")).first()[0])
    plan = lambda m, mode, asked: coverage.plan_window(m, mode, now, 24.0).select(F.lit(asked).alias("asked"), "mode", *ntz("window_start", "window_end"))
    out = plan(manifest.where("false"), "incremental", "incremental, no manifest")
    for mode in ("incremental", "replay_previous", "backfill"):
        out = out.unionByName(plan(manifest, mode, mode))
    return out


# (text, the sentences that count, with their number in the text, threat and count)
SENTENCES = [("Самара. Фиксация от 3 БПЛА. Тольятти. Фиксация около 2 БПЛА", [(1, "uav", 3), (3, "uav", 2)]), ("Летят 4 ракеты", [(0, "missile", 4)]), ("За ночь уничтожены 12 БПЛА.", []), ("Тихо", [])]


@query(f"""WITH said AS ({answers("i BIGINT, n INTEGER, threat VARCHAR, count INTEGER", [(i, *c) for i, (_, counted) in enumerate(SENTENCES) for c in counted])}) SELECT doc_id, n AS sentence_no, threat, count FROM documents JOIN said ON i = doc_id % {len(SENTENCES)}""")
def counted_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counted sentence of a post; one that looks back or spans regions counts nothing."""
    d = table(spark, sf_dir, "documents")
    text = F.concat_ws("\n", phrase_of(F.col("doc_id"), [t for t, _ in SENTENCES]), "text")
    return reports.counted(d.select(F.col("doc_id").alias("post_key"), text.alias("text"))).select(F.col("post_key").alias("doc_id"), "sentence_no", "threat", "count")
