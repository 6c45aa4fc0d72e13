"""Order-dependent operators against sequential versions."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alertlake.functions.geo import haversine
from alertlake.operators import chains, coverage, geometry, intervals, merge, pairing, sequences, sessions

T0 = datetime(2026, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.mark.parametrize("bucket", [None, "ts"])
def test_pairing_is_first_start_wins(spark, bucket):
    rnd = random.Random(3)
    rows = [(rnd.randrange(12), at(rnd.randrange(9000)), i, rnd.choice(["start", "end"])) for i in range(600)]
    want, open_, left = [], {}, {}
    for key, ts, i, kind in sorted(rows, key=lambda r: (r[1], r[2])):
        if kind == "start":
            open_.setdefault(key, i)
        elif key in open_:
            want.append((key, open_.pop(key), i))
    left = {(k, v) for k, v in open_.items()}
    df = spark.createDataFrame(rows, "key int, ts timestamp, i int, kind string")
    got = pairing.pair(df, ["key"], ["ts", "i"], ["i"], bucket=bucket and F.to_date(bucket))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert {tuple(r) for r in pairing.still_open(df, ["key"], ["ts", "i"], ["i"]).collect()} == left


def test_joins_on_time_agree_with_nested_loops(spark):
    rnd = random.Random(5)
    iv = [(i, at(a := rnd.randrange(50000)), at(a + rnd.choice([0, 1, 59, 60, 300, 20000]))) for i in range(150)] + [(900, None, at(5)), (901, at(9), at(3))]
    probes = [(j, at(rnd.randrange(60000))) for j in range(120)] + [(500, None), (501, iv[0][1]), (502, iv[0][2])]
    a = spark.createDataFrame(iv, "i int, start timestamp, end timestamp")
    b = spark.createDataFrame(probes, "j int, at timestamp")
    want = {(i, j) for i, s, e in iv for j, t in probes if s and t and s <= t <= e}
    assert {(r["i"], r["j"]) for r in intervals.stab(a, b).collect()} == want
    counts = {r["at"]: r["active"] for r in intervals.active_counts(a, b).collect()}
    assert counts == {t: sum(1 for i, s, e in iv if s and s <= t <= e) for _, t in probes if t}
    c = b.select(F.col("j").alias("k"), F.col("at").alias("other_at"))
    near = {(r["j"], r["k"]) for r in intervals.near_in_time(b, c, 45 * 60000).collect()}
    assert near == {(j, k) for j, t in probes for k, u in probes if t and u and abs(t - u) <= timedelta(minutes=45)}


def test_stab_is_an_equi_join(spark):
    a = spark.createDataFrame([(1, at(0), at(5))], "i int, start timestamp, end timestamp")
    b = spark.createDataFrame([(at(1),)], "at timestamp")
    assert "NestedLoop" not in intervals.stab(a, b)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [512, 3])
def test_anchored_sessions(spark, few, monkeypatch):
    monkeypatch.setattr(sessions, "FEW", few)
    rnd = random.Random(7)
    rows = [(rnd.randrange(4), at(rnd.randrange(3000))) for _ in range(400)]
    want, last = {}, {}
    for key, ts in sorted(rows, key=lambda r: r[1]):
        if key not in last or ts - last[key] > timedelta(minutes=60):
            last[key] = ts
        want[key, last[key]] = want.get((key, last[key]), 0) + 1
    got = sessions.session_totals(spark.createDataFrame(rows, "key int, ts timestamp"), ["key"], "ts", 3_600_000, []).collect()
    assert {(r["key"], r["session_start"]): r["observations"] for r in got} == want


def test_runs_and_bridges(spark):
    rows = [("a", i, f) for i, f in enumerate([False, True, True, False, True, False])]
    runs = sessions.runs_of(spark.createDataFrame(rows, "k string, n int, lit boolean"), ["k"], "n", "lit")
    assert {(r["lit"], r["first"], r["last"], r["length"]) for r in runs.collect()} == {(False, 0, 0, 1), (True, 1, 2, 2), (False, 3, 3, 1), (True, 4, 4, 1), (False, 5, 5, 1)}
    assert [(r["first"], r["last"]) for r in sessions.bridges(runs, ["k"], "lit").collect()] == [(3, 3)]


def test_merge_keeps_better_old_rows(spark):
    schema = "id string, source_id string, at timestamp, quality int, text string"
    old = spark.createDataFrame([("1", "s", at(0), 10, "before"), ("2", "s", at(90), 30, "better"), ("3", "s", at(90), 10, "gone"), ("4", "x", at(90), 5, "no status"), ("5", "f", at(90), 5, "fetch failed"), ("6", "s", None, 30, "untimed")], schema)
    new = spark.createDataFrame([("2", "s", at(90), 20, "worse"), ("7", "s", at(91), 20, "new"), (None, "s", at(91), 20, "no id")], schema)
    status = spark.createDataFrame([("s", True, 20), ("f", False, 10)], "source_id string, transport_ok boolean, quality int")
    got = merge.merged(old, new, status, F.lit(at(60))).collect()
    # A row without a time outlives the run only by its quality.
    assert {(r["id"], r["text"]) for r in got} == {("1", "before"), ("2", "better"), ("4", "no status"), ("5", "fetch failed"), ("6", "untimed"), ("7", "new")}


def test_purge_and_revalidation(spark):
    schema = "id int, threat_class string, signal_class string, activity_kind string, count int, count_type string, text string"
    rows = [
        (1, "uav", "uav_activity_signal", "uav_detected", None, "official_activity", "Фиксация БПЛА."),
        (2, "uav", "uav_activity_signal", "uav_detected", None, "official_activity", "Хорошая погода."),
        (3, "uav", "formal_alert_signal", "alert_start_signal", None, "alert_start_signal", "Хорошая погода."),
        (4, "uav", "uav_activity_signal", "uav_warning", None, "official_activity", "Силами ПВО уничтожен БПЛА."),
        (5, "uav", "uav_activity_signal", "uav_detected", 150, "destroyed_or_suppressed", "Уничтожены 150 БПЛА"),
        (6, "uav", "uav_activity_signal", "uav_detected", None, "official_activity", None),
    ]
    df = spark.createDataFrame(rows, schema)
    purged = merge.purged_reports(df)
    assert sorted(r["id"] for r in purged.collect()) == [1, 2, 3, 4, 6]
    assert merge.purged_reports(purged).count() == 5
    got = {r["id"]: (r["activity_kind"], r["changed"]) for r in merge.revalidated(purged).collect()}
    assert got == {1: ("uav_detected", False), 3: ("alert_start_signal", False), 4: ("air_defense_action", True), 6: ("uav_detected", False)}


def test_transport_fallback(spark):
    schema = "channel string, transport string, transport_ok boolean, window_complete boolean, error string, posts int, raw_items int, oldest timestamp"
    first = spark.createDataFrame([("a", "mtproto", True, True, None, 5, 5, at(0)), ("b", "mtproto", True, True, None, 0, 0, None), ("c", "mtproto", False, False, "x", 0, 0, None)], schema)
    html = spark.createDataFrame([("b", "html", True, False, None, 3, 3, at(60)), ("c", "html", True, False, None, 0, 9, None)], schema)
    got = {r["channel"]: (r["transport"], r["transport_ok"], r["window_complete"]) for r in merge.choose_transport(first, html, F.lit(at(0))).collect()}
    assert got == {"a": ("mtproto", True, True), "b": ("html", True, True), "c": ("html", False, False)}


def test_window_planner(spark):
    manifest = spark.createDataFrame([("r", at(0), at(60), "initial", at(70))], "run string, window_start timestamp, window_end timestamp, mode string, published_at timestamp")
    plan = lambda m, mode: tuple(coverage.plan_window(m, mode, F.lit(at(6000)), 24.0).first())
    assert plan(manifest, "incremental") == ("incremental", at(60), at(6000))
    assert plan(manifest, "replay_previous") == ("replay_previous", at(0), at(60))
    assert plan(manifest, "backfill") == ("backfill", at(6000 - 1440), at(6000))
    assert plan(manifest.where("false"), "incremental") == ("initial", at(6000 - 1440), at(6000))


def test_region_gaps(spark):
    rows = [("A", "a1", True, True, "healthy", 3), ("A", "a2", True, True, "degraded", 1), ("B", "b", True, False, "failed", 0), ("C", "c", True, True, "quiet", 0), ("D", "d", False, False, "inactive", 0)]
    status = spark.createDataFrame(rows, "region string, source string, expected_active boolean, transport_ok boolean, health string, posts int")
    gaps = {r["region"]: (r["state"], r["sources"]) for r in coverage.region_gaps(status).collect()}
    assert gaps == {"A": ("PARTIAL / DEGRADED", "@a1=healthy(3 posts); @a2=degraded(1 posts)"), "B": ("NO WORKING SOURCE", "@b=failed(0 posts)")}
    assert {r["region"] for r in coverage.failed_regions(status).collect()} == {"B", "D"}


def test_boundary_is_stitched_to_a_ring(spark):
    def square(x, part):
        c = [(x, 0), (x + 1, 0), (x + 1, 1), (x, 1)]
        return [("p", *map(float, c[i] + c[(i + 1) % 4])) for i in range(4)]

    edges = spark.createDataFrame(square(0, 0) + square(1, 1), "shape string, lon1 double, lat1 double, lon2 double, lat2 double")
    lines = geometry.stitched(geometry.outer_edges(edges, ["shape"]), "shape").collect()
    assert len(lines) == 1 and len(lines[0]["points"]) == 7 and lines[0]["points"][0] == lines[0]["points"][-1]


def test_every_edge_is_in_one_line_at_its_place(spark):
    rnd, edges = random.Random(5), []
    for shape in range(6):
        n = rnd.choice([1, 5, 30])
        own = {tuple(sorted(((float(rnd.randrange(6)), float(rnd.randrange(6))), (float(rnd.randrange(6)), float(rnd.randrange(6)))))) for _ in range(n)}
        edges += [(shape, *a, *b) for a, b in own if a != b]
    edges += [(90, float(i), 0.0, float(i + 1), 0.0) for i in range(40)]  # a long line
    edges += [(91, math.cos(i), math.sin(i), math.cos((i + 1) % 37), math.sin((i + 1) % 37)) for i in range(37)]  # a ring
    rnd.shuffle(edges)
    df = spark.createDataFrame(edges, "shape int, lon1 double, lat1 double, lon2 double, lat2 double")
    rows = geometry.lines_of_edges(df, ["shape"]).collect()
    key = lambda s, a, b, c, d: (s, *sorted(((a, b), (c, d))))
    assert sorted(key(r["shape"], r["lon1"], r["lat1"], r["lon2"], r["lat2"]) for r in rows) == sorted(key(*e) for e in edges)
    lines = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        lines.setdefault((r["shape"], r["line"]), []).append(r)
    ends = {}
    for own in lines.values():
        assert [r["place"] for r in own] == list(range(len(own)))
        assert all((x["lon2"], x["lat2"]) == (y["lon1"], y["lat1"]) for x, y in zip(own, own[1:], strict=False))
        a, b = (own[0]["lon1"], own[0]["lat1"]), (own[-1]["lon2"], own[-1]["lat2"])
        if a != b:
            for p in (a, b):
                ends[own[0]["shape"], p] = ends.get((own[0]["shape"], p), 0) + 1
    degree = {}
    for s, *e in edges:
        for p in (tuple(e[:2]), tuple(e[2:])):
            degree[s, p] = degree.get((s, p), 0) + 1
    assert set(ends) == {k for k, n in degree.items() if n % 2} and set(ends.values()) == {1}
    assert [len(v) for k, v in lines.items() if k[0] in (90, 91)] in ([40, 37], [37, 40])
    assert geometry.stitched(df, "shape").where("shape = 90").first()["points"][0]["lon"] in (0.0, 40.0)
    assert geometry.lines_of_edges(df.where("false"), ["shape"]).count() == 0


def test_crossings(spark):
    rnd = random.Random(11)
    segs = [(line, s, *(rnd.uniform(0, 6) for _ in range(4))) for line in range(6) for s in range(3)]

    def turn(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def proper(a, b):
        p, q, r, s = a[2:4], a[4:6], b[2:4], b[4:6]
        return turn(p, q, r) * turn(p, q, s) < 0 and turn(r, s, p) * turn(r, s, q) < 0

    want = {}
    for a in segs:
        for b in segs:
            if a[0] < b[0] and proper(a, b):
                want[a[0], b[0]] = want.get((a[0], b[0]), 0) + 1
    got = geometry.crossings(spark.createDataFrame(segs, "line_id int, seg_no int, x1 double, y1 double, x2 double, y2 double")).collect()
    assert {(r["line_id"], r["other_id"]): r["n"] for r in got} == {k: min(4, n) for k, n in want.items()}


def plain_path(scores, links):
    """The path to every point with the largest sum, point by point: (sum, path)."""
    best = {}
    for b in sorted(scores):
        best[b] = (scores[b], [b])
        for a in sorted(a for a, c in links if c == b):
            if best[a][0] + scores[b] > best[b][0]:
                best[b] = (best[a][0] + scores[b], [*best[a][1], b])
    return best


def test_longest_paths_by_relaxation(spark):
    rnd, points, links, want = random.Random(2), [], [], {}
    for end in range(12):
        n = rnd.randrange(1, 14)
        scores = {i: float(rnd.randrange(-6, 9)) for i in range(n)}  # whole numbers, so that sums tie
        own = {(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.4}
        points += [(end, i, s, i) for i, s in scores.items()]
        links += [(end, a, b) for a, b in own]
        want |= {(end, i): found for i, found in plain_path(scores, own).items()}
    points += [(99, i, 1.0, i) for i in range(25)]  # one long line
    links += [(99, i, i + 1) for i in range(24)]
    want |= {(99, i): (i + 1.0, list(range(i + 1))) for i in range(25)}
    df = spark.createDataFrame(points, "end_id int, node_id long, score double, t int")
    got = chains.longest_paths(df, spark.createDataFrame(links, "end_id int, a long, b long"), ["end_id"], ["t", "node_id"]).collect()
    assert {(r["end_id"], r["node_id"]): (r["best"], r["path"]) for r in got} == want
    assert chains.longest_paths(df.where("false"), spark.createDataFrame([], "end_id int, a long, b long"), ["end_id"], ["t", "node_id"]).count() == 0


def test_chain_follows_the_corridor(spark):
    rows = [(1, 31.0, 50.0, at(0), 1.0, 1, False), (2, 32.5, 50.1, at(60), 1.0, 1, False), (3, 32.0, 56.0, at(60), 1.0, 1, False), (4, 32.6, 50.1, at(61), 1.0, 1, True)]
    nodes = spark.createDataFrame(rows, "node_id long, lon double, lat double, at timestamp, weight double, observations long, proxy boolean")
    ends = spark.createDataFrame([(9, 29.0, 50.0, 34.0, 50.0, at(120))], "end_id long, anchor_lon double, anchor_lat double, lon double, lat double, at timestamp")
    got = chains.chains(nodes, ends).collect()
    assert [(r["end_id"], r["path"], r["illustrative"]) for r in got] == [(9, [1, 2], True)]
    again = chains.chains(nodes, ends).withColumn("w", F.lit(1)).unionByName(chains.chains(nodes, ends).withColumns({"w": F.lit(1), "end_id": F.lit(10).cast("long")}))
    assert [r["end_id"] for r in chains.chosen_chains(again, ["w"], 5).collect()] == [9]
    apart = nodes.withColumn("threat_class", F.when(F.col("node_id") == 2, "missile").otherwise("uav"))
    with pytest.raises(ValueError):
        chains.chains(apart, ends)
    assert [r["path"] for r in chains.chains(apart, ends.withColumn("threat_class", F.lit("uav"))).collect()] == [[1, 4]]
    assert sorted(r["node_id"] for r in chains.suppressed(nodes).collect()) == [1, 2, 3, 4]


def test_wave(spark):
    schema = "route_id int, total_km double, arrival timestamp, anchors array<struct<progress:double,t:long>>"
    ms = lambda m: int(at(m).timestamp() * 1000)
    routes = chains.prepared(spark.createDataFrame([(1, 210.0, at(120), [(0.5, ms(60)), (0.4, ms(70)), (2.0, ms(1))])], schema).withColumn("arrival", F.timestamp_millis(F.lit(ms(120)))))
    r = routes.first()
    assert r["arrival_ms"] - r["start_ms"] > 0 and [p["progress"] for p in r["checkpoints"]] == [0.0, 0.4, 1.0]
    times_ = spark.createDataFrame([(ms(m),) for m in (-500, 100, 119, 121, 900)], "t long").select(F.timestamp_millis("t").alias("at"))
    heads = [(x["head"], x["tail"]) for x in chains.waves_at(routes, times_).orderBy("at").collect()]
    assert len(heads) == 3 and heads[-1][0] == 1.0 and all(h > t for h, t in heads) and heads == sorted(heads)


def test_starts_near_those_taken_cost(spark):
    rows = [(1, "w", [1], 9.0, 30.0, 50.0), (2, "w", [2], 8.0, 30.1, 50.0), (3, "w", [3], 7.0, 34.0, 50.0)]
    found = spark.createDataFrame(rows, "end_id long, w string, path array<long>, score double, start_lon double, start_lat double")
    take = lambda weight: [r["end_id"] for r in chains.chosen_chains(found, ["w"], 2, weight).collect()]
    assert take(0.0) == [1, 2] and take(0.05) == [1, 3]


def test_nearest_sites_wherever_they_lie(spark):
    """Across the date line, at the poles, with no site near, in crowds, and with fewer sites than asked for."""
    rnd = random.Random(4)
    sites = [(i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(60)] + [(100 + i, 10 + rnd.uniform(0, 0.01), 50 + rnd.uniform(0, 0.01)) for i in range(200)]
    points = [(i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(80)] + [(200, 179.99, 0.0), (201, -179.99, 0.0), (202, 0.0, 90.0), (203, 10.005, 50.005), (204, None, 3.0)]
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} int, lon double, lat double")
    for k, of in ((1, sites), (3, sites), (5, sites[:2]), (1, [])):
        want = {(p, s, r + 1) for p, lon, lat in points if lon is not None for r, (_, s) in enumerate(sorted((haversine(lat, lon, y, x), s) for s, x, y in of)[:k])}
        got = {(r["point_id"], r["site_id"], r["rank"]) for r in geometry.nearest(df(points, "point_id"), df(of, "site_id"), k).collect()}
        assert got == want
    assert "Nested" not in geometry.nearest(df(points, "point_id"), df(sites, "site_id"))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bucket", [None, "t"])
def test_sequences_against_loops(spark, bucket):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", None]), t, rnd.choice([None, rnd.randrange(9)])) for t in rnd.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    b = bucket and F.floor(F.col("t") / 40)
    made = [sequences.previous(df, ["k"], ["t"], F.col("v"), "x", b), sequences.last_known(df, ["k"], ["t"], F.col("v"), "x", b), sequences.next_known(df, ["k"], ["t"], F.col("v"), "x", b), sequences.running_sum(df, ["k"], ["t"], F.coalesce("v", F.lit(0)), "x", b)]
    for kind, frame in enumerate(made):
        want = {}
        for key in ("a", "b", None):
            own = sorted(r[1:] for r in rows if r[0] == key)
            for i, (t, _) in enumerate(own):
                past, ahead = [v for _, v in own[: i + 1] if v is not None], [v for _, v in own[i + 1 :] if v is not None]
                want[key, t] = [own[i - 1][1] if i else None, past[-1] if past else None, ahead[0] if ahead else None, sum(past)][kind]
        assert {(r["k"], r["t"]): r["x"] for r in frame.collect()} == want


def test_a_dense_key_has_sessions_by_doubling(spark):
    rows = [("k", at(7 * i)) for i in range(3000)] + [(None, at(5)), (None, at(500))]
    got = sessions.anchored_sessions(spark.createDataFrame(rows, "key string, ts timestamp"), ["key"], "ts", 3_600_000).collect()
    assert len(got) == 3002 and {r["session_start"] for r in got if r["key"] is None} == {at(5), at(500)}
    assert {(r["ts"], r["session_start"]) for r in got if r["key"]} == {(at(7 * i), at(63 * (i // 9))) for i in range(3000)}


def inside(rings, x, y):
    """Rays east through all edges."""
    return sum(((y1 > y) != (y2 > y)) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False)) % 2 == 1


def ringed(ring):
    return [{"lon": x, "lat": y} for x, y in ring]


def test_points_in_shapes_of_many_edges_with_holes_and_across_the_date_line(spark):
    rnd = random.Random(9)
    star = [(30 + (8 + 3 * math.sin(9 * a) + rnd.random()) * math.cos(a), 50 + (5 + 2 * math.sin(9 * a)) * math.sin(a)) for a in (2 * math.pi * i / 4000 for i in range(4000))]
    star.append(star[0])
    hole = [(29.0, 49.0), (31.0, 49.0), (31.0, 51.0), (29.0, 51.0), (29.0, 49.0)]
    square = [(20.0, 45.0), (32.0, 45.0), (32.0, 55.0), (20.0, 55.0), (20.0, 45.0)]
    across = [(178.0, -10.0), (-177.0, -10.0), (-177.0, 10.0), (178.0, 10.0), (178.0, -10.0)]
    shapes = [(2, "star", [star, hole]), (3, "square", [square]), (1, "across", [across]), (1, "across", [across]), (4, "line", [[(0.0, 0.0)]])]
    df = spark.createDataFrame([(r, n, [ringed(x) for x in p]) for r, n, p in shapes], f"rank int, region string, polygon {geometry.POLYGON}")
    points = [(rnd.uniform(15, 45), rnd.uniform(40, 60)) for _ in range(400)] + [(rnd.choice([-1, 1]) * rnd.uniform(175, 180), rnd.uniform(-12, 12)) for _ in range(80)] + [(30.0, 50.0), (25.0, 45.0), (32.0, 55.0), (20.0, 50.0)]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)] + [(999, None, 1.0)], "i int, lon double, lat double")
    east = lambda x: x + 360 if x < 0 else x
    wrapped = [(east(x), y) for x, y in across]

    def first(x, y):
        return "across" if inside([wrapped], east(x), y) else "star" if inside([star, hole], x, y) else "square" if inside([square], x, y) else None

    got = {r["i"]: r["region"] for r in geometry.locate(rows, df).collect()}
    assert got == {i: first(x, y) for i, (x, y) in enumerate(points)} | {999: None}
    assert set(got.values()) == {"across", "star", "square", None}


def test_lines_are_cut_at_the_edges_of_shapes(spark):
    rnd = random.Random(4)
    star = [(30 + (8 + 3 * math.sin(9 * a)) * math.cos(a), 50 + (5 + 2 * math.sin(9 * a)) * math.sin(a)) for a in (2 * math.pi * i / 300 for i in range(300))]
    star.append(star[0])
    hole = [(29.0, 49.0), (31.0, 49.0), (31.0, 51.0), (29.0, 51.0), (29.0, 49.0)]
    square = [(20.0, 45.0), (32.0, 45.0), (32.0, 55.0), (20.0, 55.0), (20.0, 45.0)]
    shapes = {"star": [star, hole], "square": [square]}
    df = spark.createDataFrame([(i, n, [ringed(x) for x in p]) for i, (n, p) in enumerate(shapes.items())], f"rank int, region string, polygon {geometry.POLYGON}")
    ways = [tuple(rnd.uniform(*b) for b in ((15, 45), (40, 60)) * 2) for _ in range(60)] + [(x, y, x + rnd.uniform(-0.2, 0.2), y + 0.1) for x, y in star[:60]]
    # Along an edge, through a corner, touching a corner, of no length, far away, right through both.
    ways += [(19.0, 45.0, 33.0, 45.0), (19.0, 44.0, 22.0, 47.0), (19.0, 46.0, 21.0, 44.0), (25.0, 50.0, 25.0, 50.0), (-70.0, 0.0, -69.0, 1.0), (10.0, 50.5, 50.0, 50.6)]
    schema = "line_id int, lon1 double, lat1 double, lon2 double, lat2 double"
    lines = spark.createDataFrame([(i, *w) for i, w in enumerate(ways)] + [(999, None, 1.0, 2.0, 2.0)], schema)
    found = geometry.cut_at_edges(lines, df).cache()
    pieces = {}
    for r in found.orderBy("line_id", "region", "piece").collect():
        pieces.setdefault((r["line_id"], r["region"]), []).append(r)
    for rows in pieces.values():
        assert [r["piece"] for r in rows] == list(range(1, len(rows) + 1)) and rows[0]["since"] == 0 and rows[-1]["until"] == 1
        assert all(a["until"] == b["since"] and a["inside"] != b["inside"] for a, b in zip(rows, rows[1:], strict=False))
    along = lambda w, t: (w[0] + (w[2] - w[0]) * t, w[1] + (w[3] - w[1]) * t)
    land = {}
    for i, w in enumerate(ways):
        if i == 120:
            continue  # along an edge: on neither side
        for k in range(200):
            t = (k + rnd.random()) / 200
            for name, rings in shapes.items():
                rows = pieces.get((i, name), [])
                if all(abs(t - r["until"]) > 1e-6 for r in rows):
                    of = [r["inside"] for r in rows if r["since"] < t < r["until"]]
                    assert (of == [True]) == inside(rings, *along(w, t)), (i, name, t)
                    land.setdefault(i, []).append((t, of == [True]))
    assert (122, "square") not in pieces and (124, "square") not in pieces and max(len(v) for v in pieces.values()) >= 5
    entries = {r["line_id"]: r for r in geometry.first_entries(lines, found).collect()}
    assert set(entries) - {120} == {i for i, _ in pieces if any(r["inside"] for n in shapes for r in pieces.get((i, n), []))} - {120}
    for i, r in entries.items():
        assert (r["lon"], r["lat"]) == pytest.approx(along(ways[i], r["share"]))
        in_land = lambda t: any(inside(p, *along(ways[i], t)) for p in shapes.values())  # noqa: B023, E731
        if i != 120 and r["share"] > 0:
            assert in_land(r["share"] + 2e-9) and not in_land(r["share"] - 2e-9)
    assert geometry.cut_at_edges(lines.limit(0), df).isEmpty() and geometry.cut_at_edges(lines, df.limit(0)).isEmpty()


def test_weak_nodes_go_by_what_lies_near_and_strong_ones_are_not_broadcast(spark, tmp_path):
    draw = random.Random(5)
    begin = datetime(2026, 9, 21)
    rows = []
    for i in range(600):
        lon, lat = draw.choice([(179.9, 10.0), (-179.9, 10.0), (30.0, 89.8), (-150.0, 89.8), (30.0, 0.0)])
        rows.append((i, begin + timedelta(minutes=draw.randrange(3000)), lon + draw.uniform(-0.4, 0.4), min(90.0, lat + draw.uniform(-0.4, 0.4)), draw.choice(["uav", "missile"]), draw.random() < 0.6))
    rows += [(600, begin, 30.0, 0.0, None, True), (601, None, 30.0, 0.0, "uav", True), (602, begin, None, 0.0, "uav", None)]
    spark.createDataFrame(rows, "node_id long, at timestamp, lon double, lat double, threat_class string, proxy boolean").write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))  # files, so that the planner knows a size
    gone = {w[0] for w in rows if w[5] and None not in w for s in rows if s[5] is False and s[4] == w[4] and timedelta(0) <= s[1] - w[1] <= timedelta(minutes=90) and haversine(w[3], w[2], s[3], s[2]) < 45}
    found = chains.suppressed(nodes)
    assert 50 < len(gone) < 300
    assert sorted(r["node_id"] for r in found.collect()) == [r[0] for r in rows if r[0] not in gone]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("first", [1, 100_000])
def test_crossings_in_lots_of_cells(spark, monkeypatch, first):
    monkeypatch.setattr(geometry, "FIRST_LOT", first)
    monkeypatch.setattr(geometry, "LOTS", 64)
    staged, kept = geometry.staged, []
    monkeypatch.setattr(geometry, "staged", lambda df, name: kept.append((name, staged(df, name))) or kept[-1][1])
    rnd = random.Random(7)
    segs = [(line, s % 90, x, y, x + rnd.uniform(-2, 2), y + rnd.uniform(-2, 2)) for line in range(5) for s in range(120) for x, y in [(rnd.uniform(0, 14), rnd.uniform(-7, 7))]]  # numbers repeat
    segs += [(5, s, s + 0.1, 20.0, s + 0.3, 20.5) for s in range(9)] + [(6, 0, 0.0, 20.4, 1.0, 20.2), (6, 1, 2.0, 20.4, 3.0, 20.2)]  # two crossings only
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    want = {}
    for a in segs:
        for b in segs:
            p, q, r, s = a[2:4], a[4:6], b[2:4], b[4:6]
            if a[0] < b[0] and turn(p, q, r) * turn(p, q, s) < 0 and turn(r, s, p) * turn(r, s, q) < 0:
                want[a[0], b[0]] = want.get((a[0], b[0]), 0) + 1
    assert max(want.values()) > 6 and want[5, 6] == 2
    columns = "line_id int, seg_no int, x1 double, y1 double, x2 double, y2 double"
    got = geometry.crossings(spark.createDataFrame(segs + segs[:50], columns), 6).collect()  # alike rows count once
    assert {(r["line_id"], r["other_id"]): r["n"] for r in got} == {k: min(6, n) for k, n in want.items()}
    rounds = sum(name == "crossings" for name, _ in kept)
    assert rounds == (3 if first == 1 else 1)

    kept.clear()  # what every pair of lines has often enough needs no further cells
    dense = spark.createDataFrame([s for s in segs if s[0] < 5], columns)
    assert {r["n"] for r in geometry.crossings(dense, 1).collect()} == {1}
    assert sum(name == "crossings" for name, _ in kept) < 3


def test_best_chains_without_a_row_for_each_step(spark, monkeypatch):
    rnd, begin = random.Random(3), datetime(2026, 9, 21)
    at_ = [(begin + timedelta(minutes=rnd.randrange(480)), 30 + rnd.uniform(0, 12), 50.5 + rnd.uniform(0, 2.5), rnd.choice([0.4, 1.0, 1.7]), rnd.random() < 0.3) for _ in range(220)]
    rows = [(i * 10, t, x, y, w, 1, p, "uav") for i, (t, x, y, w, p) in enumerate(at_)]
    rows += [(i * 10 + k, *r[1:]) for i, r in enumerate(rows[:60]) for k in (-3, 4)]  # alike but for their ids
    nodes = spark.createDataFrame(rows, "node_id long, at timestamp, lon double, lat double, weight double, observations long, proxy boolean, threat_class string")
    late = [(e, "uav", 28.0, 51.5, 40.0 + e % 4, 51.8, begin + timedelta(hours=7 + e % 4 / 4)) for e in range(8)]  # each twice
    ends = spark.createDataFrame(late, "end_id long, threat_class string, anchor_lon double, anchor_lat double, lon double, lat double, at timestamp")
    found = chains.candidates(nodes, ends).withColumn("score", chains.node_score()).localCheckpoint()
    links = chains.steps(found).localCheckpoint()
    points = found.select("end_id", "node_id", "score", intervals.millis(F.col("at")).alias("t"), "progress_km")
    paths = chains.longest_paths(points, links.where("b is not null"), ["end_id"], ["t", "progress_km", "node_id"])
    last = paths.join(links.where("b is null").select("end_id", F.col("a").alias("node_id")), ["end_id", "node_id"]).collect()
    want = {}
    for r in sorted(last, key=lambda r: (-r["best"] - chains.LAST_STEP, r["t"], r["progress_km"], r["node_id"])):
        want.setdefault(r["end_id"], (r["path"], r["best"] + chains.LAST_STEP))
    staged, kept = chains.staged, []
    monkeypatch.setattr(chains, "staged", lambda df, name: kept.append(name) or staged(df, name))
    got = chains.chains(nodes, ends).collect()
    assert {r["end_id"]: (r["path"], r["score"]) for r in got} == want
    assert len(want) == 8 and max(len(p) for p, _ in want.values()) > 3
    assert kept == ["chain-ends", "chains"]
    assert chains.chains(nodes.where("false"), ends).count() == 0
