"""Triples, graph, behaviour, vectors and metrics on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from lanewise.functions import motion as fm
from lanewise.functions.text import entity_is_active, normalise_label
from lanewise.operators import behaviour as be
from lanewise.operators import graph as gr
from lanewise.operators import metrics as me
from lanewise.operators import triples as tp
from lanewise.operators import vectors as ve
from lanewise.plans import chunks, joins, ranks

TEXT = "video_id string, frame_id bigint, ts double, raw_text string, active_ids array<bigint>"
ONE = '{"subject": "Vehicle 4", "predicate": "tailgating", "object": "Vehicle 9"%s}'


def texts(spark, *raw, active=None):
    return spark.createDataFrame([("v", i, i / 10, r, active) for i, r in enumerate(raw)], TEXT)


@pytest.mark.parametrize(
    "raw, n",
    [
        ("[%s]" % (ONE % ""), 1),
        ("Two cars.\nThey are close.\n[%s]" % (ONE % ""), 1),
        ("```json\n[%s]\n```" % (ONE % ""), 1),
        ("[]", 0),
        ("this is not json at all {{{{", 0),
        ("", 0),
        ('[{"predicate": "p", "object": "o"}]', 0),
        ('[{"subject": "s", "object": "o"}]', 0),
        ('[{"subject": "s", "predicate": "p", "object": "  "}]', 0),
        ("[{'subject': 'a', 'predicate': 'p', 'object': 'o'}]", 0),
        ('[{"subject":"a","predicate":"p","object":"o"}, 5, "x"]', 1),
        ("[%s, %s" % (ONE % "", ONE % ""), 0),
    ],
)
def test_extract(spark, raw, n):
    assert tp.extract_triples(texts(spark, raw)).count() == n


def test_normalise_and_drop(spark):
    raw = "[%s, %s]" % (ONE % ', "motion_state": "parallel", "phase": "CONFLICT"', ONE % ', "motion_state": "FLYING"')
    rows = tp.normalise_triples(tp.extract_triples(texts(spark, raw))).orderBy("ord").collect()
    assert [(r.motion_state, r.phase) for r in rows] == [("PARALLEL", "conflict"), ("APPROACHING", "normal")]
    assert rows[0].subject_type == "Vehicle"
    for active, n in (([4, 9], 2), ([1, 2, 3], 0), ([], 0), (None, 2)):
        assert tp.drop_hallucinated(tp.normalise_triples(tp.extract_triples(texts(spark, raw, active=active)))).count() == n
    counts = tp.triple_drop_counts(texts(spark, '[5, %s]' % (ONE % ""), active=[4])).first()
    assert (counts.elements, counts.triples, counts.malformed, counts.hallucinated) == (2, 1, 1, 1)


def test_labels_and_names(spark):
    df = spark.createDataFrame([(" The Car ",), ("a an x",), ("bus",)], "label string")
    assert [r[0] for r in df.select(normalise_label(F.col("label"))).collect()] == ["car", "an x", "bus"]
    names = spark.createDataFrame(
        [("Vehicle 7", "Vehicle"), ("Vehicle", "Vehicle"), ("Vehicle x", "Vehicle"), ("road", "Infrastructure")],
        "name string, kind string",
    ).withColumn("active", F.array(F.lit(7).cast("bigint")))
    ok = entity_is_active(F.col("name"), F.col("kind"), F.col("active"))
    assert [r[0] for r in names.select(ok).collect()] == [True, False, False, True]


EDGE = (
    "video_id string, frame_id bigint, ts double, subject string, subject_type string, predicate string,"
    " object string, object_type string, motion_state string, phase string"
)


def test_graph(spark):
    rows = [
        ("v", 200, 20.0, "Vehicle 4", "Vehicle", "tailgating", "Vehicle 9", "Vehicle", None, None),
        ("v", 200, 20.0, "Vehicle 4", "Vehicle", "stops_at", "traffic_light", "Infrastructure", "stationary", "NORMAL"),
        ("v", 200, 20.0, " Vehicle 9 ", "Vehicle", "turns_at", "junction", "Infrastructure", None, None),
        ("v", 200, 20.0, "Pedestrian 1", "Pedestrian", "crosses", "road", "Infrastructure", None, None),
        ("v", 300, 30.0, "Vehicle 7", "Vehicle", "passes", "", "Infrastructure", None, None),
    ]
    edges = gr.interaction_edges(spark.createDataFrame(rows, EDGE))
    assert edges.count() == 4
    assert gr.match_edges(edges, window=(15.0, 20.0)).count() == 4 and gr.match_edges(edges, window=(25.0, 30.0)).count() == 0
    assert gr.match_edges(edges, "Vehicle", "Infrastructure").count() == 2
    assert {r.window for r in gr.with_pointer(edges).collect()} == {"15.0-20.0"}
    assert {r.entity_type: r.entities for r in gr.count_entities(gr.merge_entities(edges)).collect()} == {
        "Vehicle": 2, "Pedestrian": 1, "Infrastructure": 3,
    }
    assert gr.entity_history(edges, "Vehicle 9").count() == 2
    degree = {r.name: (r.degree, r.partners) for r in gr.entity_degree(edges).collect()}
    assert degree["Vehicle 4"] == (2, 2)
    first = edges.where("predicate = 'stops_at'").first()
    assert (first.motion_state, first.phase) == ("STATIONARY", "normal")


def test_precedes_and_chain(spark):
    ticks = spark.createDataFrame([("v", f, f / 10) for f in (50, 100, 150, 200)], "video_id string, frame_id bigint, ts double")
    active = spark.createDataFrame(
        [("v", f, t) for f in (50, 100, 150, 200) for t in (1, 2)], "video_id string, frame_id bigint, track_id bigint"
    )
    for size in (60, 8192):
        pre = gr.precedes_edges(ticks, active, chunk_frames=size)
        rows = sorted((r.name, r.from_start, r.to_start, r.gap_seconds) for r in pre.collect())
        assert rows[:3] == [("Vehicle 1", 0.0, 5.0, 5.0), ("Vehicle 1", 5.0, 10.0, 5.0), ("Vehicle 1", 10.0, 15.0, 5.0)]
        hops = gr.window_chain(pre, 3).groupBy("hops").count().collect()
        assert {r.hops: r["count"] for r in hops} == {1: 6, 2: 4, 3: 2}


STATE = "video_id string, track_id bigint, frame_id bigint, ts double, x double, y double, vx double, vy double, ax double, ay double, warm boolean"


def test_lookback_summary(spark):
    rows = [("v", 1, f, f / 10, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0, True) for f in range(10)]
    active = spark.createDataFrame([("v", 1, 9, 0.9), ("v", 2, 9, 0.9)], "video_id string, track_id bigint, frame_id bigint, ts double")
    history = be.lookback(active, spark.createDataFrame(rows, STATE), fps=10, chunk_frames=60)
    said = {r.track_id: r for r in be.lookback_summary(history).collect()}
    assert [(s.state, s.start_ts, s.end_ts) for s in said[1].segments] == [("MOVING", 0.0, 0.9)]
    assert (said[1].now_speed, said[1].now_accel) == (5.0, 0.0)
    assert said[1].summary == "Vehicle 1: moving for 0.9s | now: speed=5.0 m/s, accel=+0.0 m/s²"
    assert said[2].summary == "Vehicle 2: no history yet (just appeared)" and said[2].now_speed is None
    text = be.tick_summaries(be.lookback_summary(history)).first().behaviour
    assert text.splitlines()[1].startswith("Vehicle 2")


def test_runs_and_profiles_across_chunks(spark):
    speeds = [0.0] * 7 + [5.0] * 9 + [0.0] * 4 + [5.0] * 30
    rows = [("v", 1, 3 * f, 3 * f / 10, 0.0, 0.0, s, 0.0, 0.0, 0.0, True) for f, s in enumerate(speeds)]
    for size in (5, 8192):
        runs = be.behaviour_runs(spark.createDataFrame(rows, STATE), size).orderBy("start_ts").collect()
        assert [(r.state, round(r.start_ts, 1), round(r.end_ts, 1)) for r in runs] == [
            ("STOPPED", 0.0, 2.1), ("MOVING", 2.1, 4.8), ("STOPPED", 4.8, 6.0), ("MOVING", 6.0, 14.7),
        ]
    lines = spark.createDataFrame(
        [("v", 1, i, s) for i, s in enumerate(["a", "a", "b", " ", "b", "a"])], "video_id string, track_id bigint, frame_id bigint, summary string"
    )
    for size in (2, 8192):
        assert [r.summary for r in be.changed_profiles(lines, size).orderBy("frame_id").collect()] == ["a", "b", "a"]


def test_stable_start_and_clips(spark):
    score = [(f, 9.0) for f in range(1, 5)] + [(f, 2.0) for f in range(5, 15)]
    both = spark.createDataFrame([("a", *s) for s in score] + [("b", *s) for s in score[:-1]], "video_id string, frame_idx bigint, score double")
    for size in (9, 8192):
        assert {r.video_id: r.stable_frame for r in be.stable_start(both, chunk_frames=size).collect()} == {"a": 5, "b": 0}
    late = spark.range(700).selectExpr("'v' as video_id", "id as frame_idx", "if(id < 650, 9.0D, 1.0D) as score")
    assert be.stable_start(late, chunk_frames=64).first().stable_frame == 650
    assert be.stable_start(late, scan=500, chunk_frames=64).first().stable_frame == 0
    ticks = spark.createDataFrame([("v", 3 * i) for i in range(20)], "video_id string, frame_id bigint")
    for size in (6, 8192):
        clips = {r.frame_id: r.clip for r in be.clip_buffer(ticks, chunk_frames=size).collect()}
        assert clips[0] == [0] and clips[57] == [42, 45, 48, 51, 54, 57] and len(clips) == 20


def test_forced_tick_waits_for_the_first_eligible_frame(spark):
    eligible = spark.createDataFrame([("v", 4, 0.4), ("v", 6, 0.6)], "video_id string, frame_id bigint, ts double")
    fired = spark.createDataFrame(
        [("v", 0, "COLLISION_SUSPECTED"), ("v", 6, "HARD_BRAKING"), ("v", 4, "SPEEDING")], "video_id string, frame_id bigint, alert_type string"
    )
    assert sorted(r.frame_id for r in be.forced_ticks(eligible, fired).collect()) == [4, 6]
    scores = spark.createDataFrame([("v", 4, 0.0), ("v", 6, 0.0)], "video_id string, frame_id bigint, score double")
    ticks = be.macro_ticks(eligible, scores, be.forced_ticks(eligible, fired).where("frame_id = 6"), fps=6)
    assert {r.frame_id: (r.forced, r.runs) for r in ticks.collect()} == {4: (False, False), 6: (True, True)}


def test_search_blocks_ties_and_bad_vectors(spark, monkeypatch):
    nan = float("nan")
    vectors = [[float(i % 5), 1.0] for i in range(40)] + [None, [1.0, None], [nan, 1.0], [1.0], [0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "chunk_id bigint, embedding array<float>").repartition(3)
    asked = [(i, [float(i), 1.0]) for i in range(5)] + [(8, None), (9, [2.0])]
    queries = spark.createDataFrame(asked, "query_id bigint, query_vec array<double>")
    for metric in ("l2", "cosine"):
        whole = sorted(map(tuple, ve.search(df, queries, "chunk_id", 10, metric).collect()))
        monkeypatch.setattr(ve, "BLOCK_CELLS", 4)
        assert sorted(map(tuple, ve.search(df, queries, "chunk_id", 10, metric).collect())) == whole
        monkeypatch.undo()
        two = [[r[1] for r in sorted(whole, key=lambda r: r[3]) if r[0] == q] for q in range(5)]
        assert [x[:8] for x in two] == [list(range(q, 40, 5)) for q in range(5)]
        assert [r[1] for r in whole if r[0] == 9] == [43] and not [r for r in whole if r[0] == 8]
        assert not {r[1] for r in whole} & {40, 41, 42}


def test_search_and_intent(spark):
    rng = random.Random(1)
    store = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    asked = [(q, [rng.gauss(0, 1) for _ in range(8)]) for q in range(4)]
    df = spark.createDataFrame(store, "chunk_id bigint, embedding array<float>")
    queries = spark.createDataFrame(asked, "query_id bigint, query_vec array<double>")
    got = {(r.query_id, r["rank"]): r for r in ve.search_events(df, queries, 3).collect()}
    for q, v in asked:
        d = sorted((sum((a - b) ** 2 for a, b in zip(e, v)) ** 0.5, i) for i, e in store)[:3]
        assert [got[q, n].chunk_id for n in (1, 2, 3)] == [i for _, i in d]
        assert got[q, 1].score == pytest.approx(1 / (1 + d[0][0]), abs=1e-4)
    assert ve.search_events(df.limit(0), queries).count() == 0
    assert ve.search_events(df, queries.limit(0)).count() == 0
    protos = spark.createDataFrame([("full_analysis", [1.0, 0.0]), ("semantic_lookup", [0.0, 1.0])], "intent string, embedding array<double>")
    ask = spark.createDataFrame([(1, [2.0, 1.0]), (2, [1.0, 3.0]), (3, [1.0, 1.0])], "id int, query_vec array<double>")
    assert {r.id: r.intent for r in ve.classify_intent(ask, protos).collect()} == {
        1: "full_analysis", 2: "semantic_lookup", 3: "full_analysis",
    }
    far = spark.range(2500).selectExpr("'full_analysis' as intent", "array(-1.0D, -1.0D - id) as embedding")
    assert ve.classify_intent(ask, protos.unionByName(far)).where("id = 2 and intent = 'semantic_lookup'").count() == 1
    words = ve.text_vectors(spark.createDataFrame([(1, "véhicule arrêté"), (2, "Привет, мир"), (3, None)], "id int, text string"))
    assert [r.n_words for r in words.orderBy("id").collect()] == [2, 2, 0]


def test_percentiles(spark):
    rows = [("a", float(v)) for v in (10, 20, 30, 40)] + [("b", 7.0)]
    got = {r.op: (r.p50, r.p95) for r in me.percentile_floor(spark.createDataFrame(rows, "op string, ms double"), ["op"], "ms").collect()}
    assert got == {"a": (20.0, 30.0), "b": (7.0, 7.0)}
    # A group far larger than the sketch keeps exactly, with heavy ties.
    big = spark.range(60_000).select((F.pmod(F.xxhash64("id"), F.lit(9_973)) / 7.0).alias("ms"))
    values = sorted(r.ms for r in big.collect())
    row = me.percentile_floor(big, [], "ms", (1, 50, 95, 100)).first()
    assert [row.p1, row.p50, row.p95, row.p100] == [
        round(values[max(0, int(60_000 * p / 100) - 1)], 2) for p in (1, 50, 95, 100)
    ]
    assert ranks.rank_values(big.limit(0), [], "ms", (50,)).count() == 0
    none = me.percentile_floor(big.limit(0), [], "ms").first()
    assert (none.p50, none.p95) == (0.0, 0.0)
    plan = me.percentile_floor(big, [], "ms")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_model_and_store_metrics(spark):
    calls = spark.createDataFrame([(3, 1, 0), (0, 0, 2), (1, 0, 1)], "triples int, hallucinated int, incomplete int")
    r = me.model_quality(calls).first()
    assert (r.calls, r.parse_successes, r.parse_rate, r.triples_per_call) == (3, 2, 0.667, 2.0)
    assert (r.hallucination_rate, r.completeness_rate) == (0.25, 0.75)
    none = me.model_quality(calls.limit(0)).first()
    assert (none.calls, none.parse_rate) == (0, 0.0)
    asked = spark.createDataFrame([(10.0, ["a", "b"], "a long answer", "x"), (20.0, [], "short", "x")], "latency_ms double, tools array<string>, answer string, route string")
    empty = me.agent_metrics(asked.limit(0)).first()
    assert (empty.queries, empty.tool_calls, empty.latency_p50, empty.tools_per_query) == (0, 0, 0.0, 0.0)
    a = me.agent_metrics(asked).first()
    assert (a.queries, a.tools_per_query, a.empty_answers, a.empty_rate, a.latency_p50) == (2, 1.0, 1, 0.5, 10.0)


def test_calibration_quality(spark):
    h = [30 / 1280, 0.0, 0.0, 0.0, -20 / 720, 20.0, 0.0, 0.0, 1.0]
    cal = spark.createDataFrame([("v", h)], "video_id string, h array<double>")
    pts = [(0, 720, 0, 0), (1280, 720, 30, 0), (1280, 0, 30, 20), (0, 0, 0.5, 20)]
    pairs = spark.createDataFrame([("v", *map(float, p)) for p in pts], "video_id string, pixel_x double, pixel_y double, world_x double, world_y double")
    r = me.reprojection_error(pairs, cal).first()
    assert (r.points, r.rmse_m) == (4, 0.25)
    assert me.reprojection_error(pairs.limit(3), cal).count() == 0


def test_asof_equals_brute_force(spark):
    rng = random.Random(2)
    right = [("v", t, f, float(f)) for t in (1, 2) for f in sorted(rng.sample(range(300), 40))]
    left = [("v", t, rng.randrange(300), i) for i, t in enumerate([1, 2] * 60)]
    ldf = spark.createDataFrame(left, "video_id string, track_id bigint, frame_id bigint, i int")
    rdf = spark.createDataFrame(right, "video_id string, track_id bigint, frame_id bigint, val double")
    want = {i: max((v for _, t2, f2, v in right if t2 == t and f2 <= f), default=None) for _, t, f, i in left}
    for size in (7, 8192):
        got = chunks.asof(ldf, rdf, ["video_id", "track_id"], "frame_id", ["val"], size)
        assert {r.i: r.val for r in got.collect()} == want


def test_frame_times_and_pointers(spark):
    df = spark.createDataFrame([(30, 29.97), (30, 0.0), (30, 0.4)], "frame_id bigint, fps double")
    assert [r[0] for r in df.select(fm.frame_time()).collect()] == pytest.approx([30 / 29, 1.0, 1.0])
    p = spark.createDataFrame([(12.0,), (2.0,)], "ts double").withColumn("s", fm.window_start("ts")).withColumn("p", fm.window_pointer("s", "ts"))
    assert [(r.p, r.v) for r in p.select("p", fm.pointer_start("p").alias("v")).collect()] == [("7.0-12.0", 7.0), ("0.0-2.0", 0.0)]


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [("v", t, rng.uniform(0, 2000)) for t in (1, 2) for _ in range(150)] + [("v", 1, 30.0)]
    spans = [("v", rng.choice([1, 2]), a, a + rng.choice([0.0, 5.0, 300.0, 1500.0])) for a in (rng.uniform(0, 1500) for _ in range(40))]
    spans += [("v", 1, 10.0, 30.0), ("v", 1, 30.0, 20.0)]
    rdf = spark.createDataFrame(rows, "video_id string, track_id bigint, ts double")
    sdf = spark.createDataFrame(spans, "video_id string, track_id bigint, t0 double, t1 double")
    want = sorted((t, ts, a, b) for _, t, ts in rows for _, u, a, b in spans if t == u and a <= ts <= b)
    got = joins.interval_join(rdf, sdf, ["video_id", "track_id"], "t0", "t1")
    assert sorted((r.track_id, r.ts, r.t0, r.t1) for r in got.collect()) == want


def test_approximate_search_gives_k_rows_and_most_neighbours(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # a hot bucket of equal vectors
    odd = [(2000, None), (2001, [1.0]), (2002, [None] * 16), (2003, [float("nan")] * 16)]
    store = spark.createDataFrame(rows + odd, "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame(rows[:40], "query_id long, query_vec array<double>")
    exact = ve.search(store, asked, "chunk_id", 5).cache()
    for cells in (ve.PART_CELLS, 64):
        monkeypatch.setattr(ve, "PART_CELLS", cells)
        near = ve.approx_search(store, asked, "chunk_id", 5, bits=5).cache()
        got = {}
        for r in near.collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
        assert all(sorted(x[0] for x in v) == [1, 2, 3, 4, 5] and len({x[1] for x in v}) == 5 for v in got.values())
        assert len(got) == 40
        share = ve.recall(near, exact, "chunk_id").agg(F.sum("found") / F.sum("asked")).first()[0]
        assert share >= 0.9
    assert ve.approx_search(store.limit(0), asked, "chunk_id", 5).count() == 0
    assert ve.approx_search(store, asked.limit(0), "chunk_id", 5).count() == 0
    few = ve.approx_search(store.where("chunk_id < 3"), asked, "chunk_id", 5)
    assert few.count() == 3 * 40


def test_text_search_is_cosine_of_weights(spark):
    import math
    import re
    from collections import Counter

    rng = random.Random(9)
    words = ["braking", "moving", "stationary", "for", "2.5", "3", "é", "now"]
    texts = {f"p{i:02d}": " ".join(["vehicle", *rng.choices(words, k=rng.randint(0, 8))]) for i in range(40)}
    rows = list(texts.items()) + [("none", None), ("empty", "")]
    store = spark.createDataFrame([(*r, 1.0) for r in rows], "profile_id string, text string, score double")
    asked = {f"q{i}": texts[f"p{i:02d}"] for i in range(5)} | {"unknown": "zebra", "null": None}
    got = ve.search_profiles(store, spark.createDataFrame(list(asked.items()), "query_id string, text string"), 4).collect()

    terms = {p: Counter(re.findall(r"[^\W_]+(?:\.\d+)?", (t or "").lower())) for p, t in rows}
    df = Counter(w for c in terms.values() for w in c)
    idf = {w: math.log((len(rows) + 1) / (n + 1)) for w, n in df.items()}
    weigh = lambda c: {w: round(n * idf[w] * 1000) for w, n in c.items() if w in idf}
    index = {p: weigh(c) for p, c in terms.items()}
    want = []
    for qid, text in asked.items():
        q = weigh(Counter(re.findall(r"[^\W_]+(?:\.\d+)?", (text or "").lower())))
        norm = lambda v: sum(x * x for x in v.values())
        found = [(-sum(q[w] * v.get(w, 0) for w in q) / math.sqrt(norm(v) * norm(q)), p) for p, v in index.items() if any(q[w] * v.get(w, 0) for w in q)]
        want += [(qid, p, i, round(-c, 4)) for i, (c, p) in enumerate(sorted(found)[:4], 1)]
    assert sorted((r.query_id, r.profile_id, r.rank) for r in got) == sorted(w[:3] for w in want)
    assert {(r.query_id, r.rank): r.score for r in got} == pytest.approx({(q, i): c for q, _, i, c in want}, abs=1e-4)


def test_text_search_leaves_postings_where_they_lie(spark, monkeypatch):
    """Texts and words are not dealt anew; rare terms and many repeats give the same scores as common ones."""
    rng = random.Random(4)
    texts = [(f"p{i:02d}", " ".join(rng.choices(["a", "b", "2.5", "é"], k=rng.randint(0, 30)) + [f"v{i % 9}"])) for i in range(50)]
    store = spark.createDataFrame([*texts, ("none", None)], "profile_id string, text string")
    asked = spark.createDataFrame([(0, "a b b v3"), (1, "2.5 " * 12), (2, None)], "query_id long, text string")
    want = ve.search_profiles(store, asked, 5).collect()
    assert len(want) == 10
    monkeypatch.setattr(ve, "COMMON_TERMS", 2)
    monkeypatch.setattr(ve, "REPEATS", 1)
    assert sorted(ve.search_profiles(store, asked, 5).collect()) == sorted(want)
    monkeypatch.setattr(ve, "staged", lambda df: df)
    plan = ve.search_profiles(store, asked, 5)._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt and not [d for d in dealt if "profile_id" in d and "term" in d]


@pytest.mark.parametrize("chunk", [1, 4, 8192])
def test_motion_energy_of_arrays_and_bytes(spark, chunk):
    rng = random.Random(5)
    frames = {v: sorted(rng.sample(range(40), n)) for v, n in (("a", 25), ("b", 1), ("c", 12))}
    rows = [(v, f, [rng.randrange(256) for _ in range(6)]) for v, fs in frames.items() for f in fs]
    rows += [("d", 0, [1, 2]), ("d", 5, [3, 2]), ("d", 9, [3, 2, 1]), ("d", 11, None), ("d", 12, [9, 9])]
    want, before = {}, {}
    for v, f, p in rows:
        q = before.get(v)
        same = p is not None and q is not None and len(p) == len(q)
        want[v, f] = 999.0 if q is None else sum(abs(x - y) for x, y in zip(p, q)) / len(p) if same else None
        before[v] = p
    arrays = spark.createDataFrame(rows, "video_id string, frame_id long, pixels array<int>").repartition(5)
    binary = spark.createDataFrame([(v, f, p and bytes(p)) for v, f, p in rows], "video_id string, frame_id long, pixels binary")
    for frame in (arrays, binary):
        got = be.motion_energy(frame, chunk).collect()
        assert len(got) == len(rows) and {(r.video_id, r.frame_id): r.score for r in got} == pytest.approx(want)
        assert be.motion_energy(frame.limit(0), chunk).count() == 0
