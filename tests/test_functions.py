import hashlib
import math
from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertlake.functions import geo, text, times
from alertlake.functions.inflection import alias_forms_of, head_forms_of


def one(spark, column, **values):
    row = spark.range(1).select(column.alias("x")).first()
    return row["x"]


def test_normalize_and_ids(spark):
    assert one(spark, text.normalize(F.lit("«Ёлка» —  стоит,\n тут!"))) == "елка стоит тут"
    assert one(spark, text.stable_id(F.lit("a"), F.lit(None).cast("string"), F.lit(7))) == hashlib.sha1(b"a||7").hexdigest()[:16]
    assert one(spark, text.channel_of(F.lit("https://t.me/s/some_name/12"))) == "some_name"
    assert one(spark, text.channel_of(F.lit("https://example.com/x"))) is None
    assert one(spark, text.count_label(F.lit(3), F.lit("approx"))) == "≈3"


def test_sentences(spark):
    assert one(spark, text.sentences(F.lit("Раз. Два!\nТри; четыре"))) == ["Раз.", "Два!", "Три; четыре"]
    assert one(spark, text.sentences(F.lit("Раз;\nдва. Три"), ".!?;", newlines=False)) == ["Раз;", "два.", "Три"]
    assert one(spark, text.sentences(F.lit("  "))) == ["  "]


def test_phrases_are_found_as_whole_words(spark):
    texts = spark.createDataFrame([(1, "r", "a b c"), (2, "r", ""), (3, "q", "a b"), (4, "r", "ab c a b b")], "k int, g string, n string")
    phrases = spark.createDataFrame([("r", "a", 1), ("r", "a b", 2), ("q", "b", 3), ("r", "b c d", 4)], "g string, phrase string, p int")
    got = {(r["k"], r["at"], r["p"]) for r in text.phrase_hits(texts, ["k"], "n", phrases, on=["g"]).collect()}
    assert got == {(1, 0, 1), (1, 0, 2), (3, 1, 3), (4, 2, 1), (4, 2, 2)}


def test_what_stands_at_the_ends_of_items_is_white_space_only(spark):
    """transform() hands a function of two parameters the index too: sentences and names keep their digits."""
    from alertlake.sources.gazetteer import alias_set

    assert one(spark, text.sentences(F.lit("0 ab 0.  1 cd 1. 2"))) == ["0 ab 0.", "1 cd 1.", "2"]
    assert one(spark, alias_set(F.array(F.lit(" 0a0 "), F.lit("b1"), F.lit("B1")))) == ["0a0", "b1"]


def test_names_of_regions(spark):
    assert one(spark, text.strict_name(F.lit("Республика  Алтай—(Ёж)"))) == "республика алтай еж"
    assert one(spark, text.loose_name(F.lit("Алтайский край"))) == "алтайский" and one(spark, text.loose_name(F.lit("Republic of Altai"))) == "altai"
    assert one(spark, text.loose_name(F.lit("Ямало-Ненецкий автономный округ"))) == "ямало ненецкий" and one(spark, text.strict_name(F.lit(None).cast("string"))) == ""


def fnv(s):
    h = 2166136261
    for c in s:
        h = ((h ^ (ord(c) if ord(c) < 65536 else 0xD800 + ((ord(c) - 65536) >> 10))) * 16777619) & 0xFFFFFFFF
    return h


def test_fnv(spark):
    words = ["a", "Привет", "x😀y", "seed:12"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.fnv1a(F.col("w")).alias("h"))
    assert {r["w"]: r["h"] for r in df.collect()} == {w: fnv(w) for w in words}


def test_instants(spark):
    for raw, want in [("Sun, 21 Sep 2026 02:25:00 GMT", "2026-09-21 02:25:00"), ("21 Sep 2026 05:25:00 +0300", "2026-09-21 02:25:00"), ("2026-09-21T02:25:00+00:00", "2026-09-21 02:25:00"), ("2026-09-21T02:25:00", "2026-09-21 02:25:00"), ("soon", None)]:
        got = one(spark, times.parse_instant(F.lit(raw)).cast("string"))
        assert got == want, raw
    bounds = one(spark, times.day_bounds(F.to_date(F.lit("2026-09-21")), "+03:00"))
    assert bounds["start"] == datetime(2026, 9, 20, 21) and bounds["end"] == datetime(2026, 9, 21, 20, 59, 59)
    at = lambda s: F.to_timestamp(F.lit(s))
    assert one(spark, times.duration_text(at("2026-01-01 00:00:00"), at("2026-01-01 02:05:20"))) == "2 h 5 min"
    assert one(spark, times.at_share(at("2026-01-01 00:00:00"), at("2026-01-01 10:00:00"), F.lit(0.25)).cast("string")) == "2026-01-01 02:30:00"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.tuples(*[st.floats(-80, 80)] * 4))
def test_haversine_agrees_with_plain_numbers(spark, p):
    got = one(spark, geo.haversine_km(*[F.lit(v) for v in p]))
    assert math.isclose(got, geo.haversine(*p), rel_tol=1e-9, abs_tol=1e-6)


def test_bearings_and_corridor(spark):
    assert abs(one(spark, geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(10.0))) - 90) < 1e-9
    assert one(spark, geo.angle_between(F.lit(350.0), F.lit(20.0))) == 30
    c = one(spark, geo.corridor(F.lit(50.0), F.lit(30.0), F.lit(50.0), F.lit(34.0), F.lit(50.5), F.lit(32.0)))
    assert abs(c["progress_km"] - c["length_km"] / 2) < 1e-9 and abs(c["cross_km"] - 0.5 * geo.KM_LAT) < 1e-9


def test_inflection(spark):
    names = ["Клинцовский район", "Самара", "Сочи", "Иваново", "Лискинский район", "Стародубский муниципальный округ", "Тверь", "Уфа", "Псков", "Ox", "", None, " Нижняя  Салда ", "Ленинский"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", "n", alias_forms_of()(F.array("n")).alias("forms"), head_forms_of()(F.array("n")).alias("heads"), head_forms_of(("область",))(F.lit(["Самарская область"])).alias("region")).collect()
    forms, heads = {r["n"]: r["forms"] for r in rows}, {r["n"]: r["heads"] for r in rows}
    assert forms["Клинцовский район"][:1] == ["Клинцовский район"] and {"Клинцовском районе", "Клинцовского района", "Клинцовскому району", "Клинцовским районом"} <= set(forms["Клинцовский район"])
    assert set(forms["Самара"]) == {"Самара", "Самаре", "Самары", "Самару", "Самарой"} and set(forms["Тверь"]) == {"Тверь", "Твери", "Тверью"} and set(forms["Псков"]) == {"Псков", "Пскове", "Пскова", "Пскову", "Псковом"}
    assert forms["Сочи"] == ["Сочи"] and forms["Иваново"] == ["Иваново"] and forms["Ox"] == ["Ox"] and forms["Уфа"] == ["Уфа"] and forms[None] == [] == forms[""]
    assert "Лискинского" in heads["Лискинский район"] and heads["Самара"] == [] == heads[None]
    assert {"Стародубского муниципального", "Стародубском"} <= set(heads["Стародубский муниципальный округ"])
    assert rows[0]["region"] == ["Самарская", "Самарской"]


def test_strip_html(spark):
    assert one(spark, text.strip_html(F.lit("<p>a &amp; <b>b</b><script>x<y</script><!-- c --> d&nbsp;e</p>"))) == "a & b d e"


def test_curves(spark):
    from alertlake.functions import curves
    from alertlake.operators.geometry import contains_point

    line = F.from_json(F.lit('[{"lon":0,"lat":0},{"lon":0.1,"lat":0},{"lon":1,"lat":0.5},{"lon":2,"lat":0}]'), curves.LINE)
    assert [(p["lon"], p["lat"]) for p in one(spark, curves.spaced(line, 50.0))] == [(0, 0), (1, 0.5), (2, 0)]
    curve = [(p["lon"], p["lat"]) for p in one(spark, curves.smoothed(line, 4))]
    assert len(curve) == 13 and [curve[i] for i in (0, 4, 8, 12)] == [(0, 0), (0.1, 0), (1, 0.5), (2, 0)]
    assert one(spark, curves.smoothed(F.slice(line, 1, 1)))[0]["lon"] == 0
    # A U: the centre of its bounds lies outside.
    ring = '[[{"lon":0,"lat":0},{"lon":6,"lat":0},{"lon":6,"lat":6},{"lon":5.5,"lat":6},{"lon":5.5,"lat":1.5},{"lon":0.5,"lat":1.5},{"lon":0.5,"lat":6},{"lon":0,"lat":6},{"lon":0,"lat":0}]]'
    polygon, centre = F.from_json(F.lit(ring), "array<array<struct<lon:double,lat:double>>>"), F.struct(F.lit(3.0).alias("lon"), F.lit(3.0).alias("lat"))
    p = one(spark, curves.interior_point(polygon, centre, contains_point))
    assert (p["lon"], p["lat"]) == (3, 1)


def test_phrases_anywhere_in_texts(spark):
    import random

    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abс😀") for _ in range(n))
    texts, phrases = [(i, word(rnd.randrange(30))) for i in range(60)] + [(99, None)], [(i, word(rnd.randrange(1, 8))) for i in range(60)] + [(98, None)]
    a, b = spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame(phrases, "j int, phrase string")
    for least in (1, 3):
        found = text.contained(a, "text", b, "phrase", least)
        assert sorted((r["i"], r["j"]) for r in found.collect()) == sorted((i, j) for i, t in texts for j, p in phrases if t is not None and p is not None and len(p) >= least and p in t)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_phrase_hits_of_long_texts(spark):
    rows = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30_000)))], "k int, n string")
    phrases = spark.createDataFrame([("w5 w6 w7",), ("w29999",), ("w29999 w0",), ("w7 w6",)], "phrase string")
    assert sorted((r["at"], r["phrase"]) for r in text.phrase_hits(rows, ["k"], "n", phrases).collect()) == [(5, "w5 w6 w7"), (29_999, "w29999")]
