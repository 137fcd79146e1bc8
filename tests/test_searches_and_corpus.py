"""Searches against each other, hash splits, leak scan, sinks, streams, registered queries."""

import math
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siteweave.operators import corpus, intake
from siteweave.plans import centers, revision
from siteweave.session import drop_stages, scratch_path, shared_folder
from siteweave.sources import readers, sinks
from siteweave.streaming import answered
from siteweave.streaming import intake as live

SQUARE = "array(named_struct('x',0D,'y',0D),named_struct('x',300D,'y',0D),named_struct('x',300D,'y',300D),named_struct('x',0D,'y',300D))"


def test_centres_equal_brute_force(rows, spark):
    b = rows("plan_id int, id int, cx double, cy double, w double, d double, clock double, zone_id string",
             (1, 1, 60.0, 60.0, 40.0, 20.0, 0.5, "Z"), (1, 2, 150.0, 150.0, 290.0, 280.0, 0.0, "Z"), (1, 3, 150.0, 150.0, 400.0, 10.0, 3.0, "Z"), (2, 1, 290.0, 20.0, 20.0, 20.0, 1.0, "Z"))
    z = spark.sql(f"select plan_id, 'Z' as zone_id, {SQUARE} as poly from values (1),(2) as t(plan_id)")
    got = {}
    for r in centers.feasible_centers(b, z, z.select("plan_id", "poly")).collect():
        got.setdefault((r.plan_id, r.id), []).append((r["rank"], r.distance, r.ox, r.oy))
    for r in b.collect():
        want = []
        for dx in range(-40, 41, 2):
            for dy in range(-40, 41, 2):
                a = math.pi * r.clock / 6
                corners = [(r.cx + dx - u * r.w / 2 * math.cos(a) + v * r.d / 2 * math.sin(a), r.cy + dy - u * r.w / 2 * math.sin(a) - v * r.d / 2 * math.cos(a)) for u, v in ((-1, 1), (1, 1), (1, -1), (-1, -1))]
                if dx * dx + dy * dy <= 1600 and all(0 <= x < 300 and 0 <= y < 300 for x, y in corners):
                    want.append((float(dx * dx + dy * dy), r.cx + dx, r.cy + dy))
        found = sorted(got.get((r.plan_id, r.id), []))
        assert [k for k, *_ in found] == list(range(1, len(want) + 1))
        assert [tuple(x) for _, *x in found] == sorted(want)


@pytest.mark.parametrize("written", [12, 3])
def test_centres_in_outlines_of_many_edges(spark, rows, monkeypatch, written):
    """Outlines with notches, more edges than one expression tests, corners on edges; a row of no shifts and one of all."""
    monkeypatch.setattr(centers, "WRITTEN_OUT", written)
    star = [(150 + r * math.cos(k * math.pi / 13), 150 + r * math.sin(k * math.pi / 13)) for k, r in ((k, 140 if k % 2 else 90) for k in range(26))]
    comb = [(0, 0), (300, 0), (300, 300), (200, 300), (200, 100), (180, 100), (180, 300), (100, 300), (100, 40), (90, 40), (90, 300), (0, 300)]
    data = [(k, 130.0 + 5 * k, 140.0 + 3 * k, 8.0 + k, 6.0, k * 0.75) for k in range(9)] + [(20, 150.0, 60.0, 10.0, 10.0, 0.0), (21, 10.0, 280.0, 20.0, 20.0, 3.0), (22, 999.0, 999.0, 2.0, 2.0, 0.0)]
    b = rows("id int, cx double, cy double, w double, d double, clock double", *data).selectExpr("1 as plan_id", "*", "'Z' as zone_id")
    outline = lambda points: "array(" + ",".join(f"named_struct('x',{float(x)!r}D,'y',{float(y)!r}D)" for x, y in points) + ")"
    found = {}
    for r in centers.feasible_centers(b, spark.sql(f"select 1 as plan_id, 'Z' as zone_id, {outline(star)} as poly"), spark.sql(f"select 1 as plan_id, {outline(comb)} as poly"), 20).collect():
        found.setdefault(r.id, []).append((r["rank"], r.distance, r.ox, r.oy))

    def inside(x, y, ring):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2

    for k, cx, cy, w, d, clock in data:
        a, want = math.pi * clock / 6, []
        for dx in range(-20, 21, 2):
            for dy in range(-20, 21, 2):
                corners = [(cx - u * w / 2 * math.cos(a) + v * d / 2 * math.sin(a) + dx, cy - u * w / 2 * math.sin(a) - v * d / 2 * math.cos(a) + dy) for u, v in ((-1, 1), (1, 1), (1, -1), (-1, -1))]
                if dx * dx + dy * dy <= 400 and all(inside(x, y, ring) for x, y in corners for ring in (star, comb)):
                    want.append((float(dx * dx + dy * dy), cx + dx, cy + dy))
        assert sorted(found.get(k, [])) == [(n, *x) for n, x in enumerate(sorted(want), 1)], k


def test_bad_shift_is_refused():
    with pytest.raises(ValueError):
        centers.grid_axis(7)


@pytest.mark.parametrize("parts", [1, 5])
def test_split_counts_and_stability(spark, parts):
    im = spark.range(500).select(F.format_string("img%04d", "id").alias("name")).repartition(parts)
    val = {r.name for r in corpus.split_dataset(im).filter("split = 'val'").collect()}
    import hashlib

    order = sorted((f"img{i:04d}" for i in range(500)), key=lambda n: hashlib.md5((n + "20260807").encode()).hexdigest())
    assert val == set(order[:90])


def test_first_n_ranks_only_the_edge_bucket(spark, rows):
    d = spark.range(300).select((F.col("id") % 2).alias("k"), F.md5(F.col("id").cast("string")).alias("h"))
    lim = rows("k bigint, take bigint", (0, 37), (1, 500))
    got = corpus.first_n(d, "h", ["k"], lim, prefix=1)
    assert {r.k: r.n for r in got.filter("chosen").groupBy("k").agg(F.count("*").alias("n")).collect()} == {0: 37, 1: 150}
    top = sorted(r.h for r in d.filter("k = 0").collect())[:37]
    assert sorted(r.h for r in got.filter("chosen and k = 0").collect()) == top


def test_leaks_and_links(rows):
    f = rows("file string, text string, size long", ("a/x.md", "sk-" + "a" * 20 + " [l](y.md) [m](../b.md#s) [n](gone.md) [o](http://q)", 10), ("a/y.md", "", 10), ("b.md", "", 11 * 1024 * 1024), ("k.pem", "", 1))
    assert sorted((r.file, r.check) for r in corpus.leak_scan(f).collect()) == [("a/x.md", "api_key_shape"), ("b.md", "file_exceeds_10_MiB"), ("k.pem", "private_or_model_file")]
    assert [(r.file, r.target) for r in corpus.broken_links(f, f).collect()] == [("a/x.md", "gone.md")]


def test_links_resolve_at_any_depth(rows):
    down, up = "a/b/c/d/e/f", "../../../../../.."
    f = rows("file string, text string, size long", ("x.md", f"[l]({down}/{up}/y.md) [m](.hid/../y.md) [n](./a//../y.md) [o](../y.md)", 1), ("y.md", "", 1))
    assert [(r.file, r.target) for r in corpus.broken_links(f, f).collect()] == [("x.md", "../y.md")]


def test_gate_takes_one_object_and_one_fence(rows):
    answers = ['{"a":1}', '```json\n{"a":1}\n```', '```\n{"a":1}\n``` ', 'Sure: {"a":1}', '{"a":1} done', "[1]", '```{"a":1}```', "", None]
    runs = rows("run_id int, answer string", *enumerate(answers)).selectExpr("*", "'stop' as finish_reason", "'m' as model_requested", "'m' as model_returned", "0 as issues")
    assert [r.refused for r in intake.gate(runs).orderBy("run_id").collect()] == [None] * 3 + ["not_json"] * 6


def test_fingerprint_counts_rows_and_keeps_values_apart(rows):
    def of(*data):
        return revision.fingerprint(rows("k int, a string, b string", *((1, *r) for r in data)), ["k"], ["a", "b"]).first()[1]

    a, b, c = ("x", "1"), ("y", "2"), ("z", None)
    assert of(a, a, c) != of(b, b, c) and of(a, b) == of(b, a) and of(a) != of(a, a)
    assert of(("x|1", "")) != of(("x", "1|")) and of(("~", None)) != of((None, "~")) and of(("x", None)) != of(("x", "~"))


def test_repeated_claims_survive_unless_merged(rows):
    claims = rows("plan_id int, source_id string, owner string", (1, "s", "A"), (1, "s", "A"), (1, "t", "B"), (1, "t", "C"), (1, "u", "D"), (1, "u", "D"))
    removed = rows("plan_id int, id string, target string", (1, "B", "C"), (1, "D", None))
    out = sorted((r.source_id, str(r.owner)) for r in revision.move_ownership(claims, removed).collect())
    assert out == [("s", "A"), ("s", "A"), ("t", "C"), ("u", "None"), ("u", "None")]


def test_files_are_numbered_by_path_in_nested_folders(rows):
    paths = ["a/z.jpg", "a/b/c.jpg", "a/b.jpg", "b.jpg", "a/b/d/e.jpg", "A/x.jpg"]
    got = readers.number_files(rows("path string, n int", *((p, 1) for p in paths))).collect()
    assert [r.path for r in sorted(got, key=lambda r: r.id)] == sorted(paths) and sorted(r.id for r in got) == list(range(1, 7))


def test_tally_is_whole_over_any_batches(spark, tmp_path):
    src = tmp_path / "in"
    for day in (3, 1, 2):
        part = spark.range(10).selectExpr(
            "cast(id as int) as run_id", f"timestamp'2024-01-0{day} 00:00:00' + make_interval(0,0,0,0,cast(id as int)) as ts",
            "'stop' as finish_reason", "'m' as model_requested", "'m' as model_returned", "0 as issues", "case when id % 2 = 0 then '{}' else 'no' end as answer",
        )
        part.coalesce(1).write.mode("append").parquet(str(src))
    sink, state = scratch_path(spark, "tally"), scratch_path(spark, "tally-state")
    live.tally_rejections(live.answer_stream(spark, str(src), part.schema, max_files=1), sink, state)
    out = sorted((r.window_start.day, r.reason, r.n, r.open) for r in live.rejection_windows(spark, sink).collect())
    assert out == [(d, reason, 5, d == 3) for d in (1, 2, 3) for reason in ("accepted", "not_json")]


def test_stages_are_below_the_shared_folder_and_can_be_dropped(spark, tmp_path):
    import os

    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert path.startswith(shared_folder(spark)) and os.path.isdir(local)
    assert drop_stages(spark) >= 1 and not os.path.exists(local)


def test_background_boxes_stay_inside_and_clear(rows):
    im = rows("image_id int, width double, height double", (1, 1000.0, 800.0), (2, 640.0, 480.0))
    bg = corpus.background_boxes(im)
    assert bg.filter("x0 < 0 or y0 < 0 or x1 > width or y1 > height").count() == 0 and bg.count() == 6
    lab = rows("image_id int, id string, x0 double, y0 double, x1 double, y1 double", (1, "l", 0.0, 0.0, 1000.0, 800.0))
    assert {r.image_id for r in corpus.clear_of(bg.select("image_id", "id", "x0", "y0", "x1", "y1"), lab).collect()} == {2}


def test_sinks_refuse_overwrite(spark):
    path = scratch_path(spark, "t")
    df = spark.range(3)
    sinks.write_new(df, path)
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_new(df, path)
    snap = scratch_path(spark, "s")
    sinks.write_snapshot(df, snap, 1, None)
    with pytest.raises(FileExistsError):
        sinks.write_snapshot(df, snap, 1, None)


def test_readers(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "two.jpg").write_bytes(b"xx")
    (tmp_path / "a.jpg").write_bytes(b"x")
    cat = readers.number_files(readers.image_catalogue(spark, str(tmp_path))).orderBy("id").collect()
    assert [(r.id, r.bytes) for r in cat] == [(1, 1), (2, 2)]
    (tmp_path / "p.json").write_text('{"scenes":{"s1":{"camera":{"pitch_deg":42,"azimuth_deg":0,"scale":80,"offset_y":0.88},"occlusion":[["House_01","House_05",0.8]]},"s2":{"camera":{},"houses":[]}}}')
    docs = readers.json_documents(spark, str(tmp_path))
    cams, refused = readers.scene_priors(docs)
    assert [(r.scene_id, r.pitch_deg, r.offset_ratio) for r in cams.collect()] == [("s1", 42.0, 0.88)]
    assert [r.scene_id for r in refused.collect()] == ["s2"]
    assert [(r.src, r.dst, r.confidence) for r in readers.occlusion_edges(cams).collect()] == [("House_01", "House_05", 0.8)]
    (tmp_path / "img.txt").write_text("1 0.5 0.5 0.2 0.2\n0 0.1 0.1 0.1 0.1\n1 0.3\n")
    lab = corpus.label_rows(readers.label_lines(spark, str(tmp_path))).collect()
    assert [(r.image_id, r["class"], r.cx, r.h) for r in lab] == [("img", 0, 0.5, 0.2)]
    typed, bad = readers.typed_answers(spark.createDataFrame([(1, '{"a":1}'), (2, "{oops")], "run_id int, answer string"), "a int")
    assert [r.data.a for r in typed.collect()] == [1] and [r.doc_id for r in bad.collect()] == ["2"]


def test_stream_accepts_once_over_several_batches(spark, tmp_path):
    schema = "image_id int, stage string, label string, run_id int, ts timestamp, finish_reason string, model_requested string, model_returned string, issues int, answer string"
    base = "timestamp'2024-01-01 00:00:00'"
    src = tmp_path / "in"
    for k, ids in enumerate(((3, 1), (2, 4), (5,))):
        part = spark.createDataFrame([(i % 2, "s", "l", i) for i in ids], "image_id int, stage string, label string, run_id int")
        part = part.selectExpr("*", f"{base} + make_interval(0,0,0,0,run_id) as ts", "'stop' as finish_reason", "'m' as model_requested", "'m' as model_returned", "0 as issues", "'{}' as answer")
        part.coalesce(1).write.mode("append").parquet(str(src))
    sink, state = scratch_path(spark, "sink"), scratch_path(spark, "state")
    stream = lambda: live.answer_stream(spark, str(src), part.schema, max_files=1)
    assert schema.split(",")[0] == "image_id int"
    live.accept_once(stream(), sink, state)
    first = spark.read.parquet(sink).collect()
    assert sorted(r.image_id for r in first) == [0, 1]
    live.accept_once(stream(), sink, state)
    assert spark.read.parquet(sink).count() == 2


def test_keyed_stream_over_restarts_late_runs_and_lost_state(spark, tmp_path):
    src, sink, state = str(tmp_path / "in"), scratch_path(spark, "sink"), scratch_path(spark, "state")

    def put(*runs):
        part = spark.createDataFrame(runs, "image_id int, run_id int, day int").selectExpr(
            "image_id", "'s' as stage", "'l' as label", "run_id", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,day) as ts", "'stop' as finish_reason",
            "'m' as model_requested", "if(run_id = 99, 'x', 'm') as model_returned", "0 as issues", "'{}' as answer",
        )
        part.coalesce(1).write.mode("append").parquet(src)
        return part.schema

    schema = put((1, 2, 1), (1, 1, 0), (2, 3, 0), (3, 99, 0))
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled", None)

    def go():
        return answered.accept_keyed(live.answer_stream(spark, src, schema, max_files=1), sink, state, keep="10 days", check_ms=1)

    assert go() == 2
    put((1, 4, 2), (3, 5, 40))  # answered; first accepted run, which moves the horizon past the state of 1 and 2
    put((4, 6, -5), (4, 8, -6))  # late and new: the earlier of the two
    put((2, 7, 41))  # its state has gone: refused through the sink
    assert go() <= 3
    put((2, 9, 61), (1, 10, 90), (5, 11, 1), (3, 12, 41))
    assert go() <= 4
    assert go() >= 0, "nothing new"
    got = {r.image_id: r.run_id for r in spark.read.parquet(sink).collect()}
    assert got == {1: 1, 2: 3, 3: 5, 4: 8, 5: 11} and spark.read.parquet(sink).count() == 5
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled", None) == before


def test_every_query_is_registered_once_and_whole():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 150
    assert all(n in o for n in q if not n.startswith("op") and n != "pipeline")
    assert all(re.fullmatch(r"[a-z][a-z0-9_]+", n) for n in q)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
