"""Files, typed answers by stage, look-ups by path and slug, ratio choice."""

import hashlib

from siteweave.operators import corpus, summary
from siteweave.plans import cuboid
from siteweave.sources import readers


def test_files_that_are_there_and_those_that_are_not(spark, rows, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.jpg").write_bytes(b"one")
    (tmp_path / "deep" / "er" / "b.c.jpg").write_bytes(b"x")
    (tmp_path / "e.jpg").write_bytes(b"")
    (tmp_path / "deep" / "a.jpg").write_bytes(b"two")
    (tmp_path / "d.txt").write_bytes(b"no")
    found = readers.match_files(rows("name string, n int", ("a", 1), ("b.c", 2), ("d", 3), ("e", 4)), readers.image_catalogue(spark, str(tmp_path))).collect()
    got = [(r.name, r.present, r.bytes, r.sha256) for r in found]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted(got, key=str) == sorted([("a", True, 3, sha(b"one")), ("a", True, 3, sha(b"two")), ("b.c", True, 1, sha(b"x")), ("d", False, None, None), ("e", False, None, None)], key=str)


def test_a_missing_label_file_is_an_empty_one(spark, rows, tmp_path):
    (tmp_path / "i1.txt").write_text("1 0.5 0.5 0.1 0.1\n0 1 1 1 1\n1 2 3\n1 0.25 0.5 0.1 0.1\n")
    (tmp_path / "i2.txt").write_text("\n")
    labels = corpus.label_rows(readers.label_lines(spark, str(tmp_path)))
    got = sorted((r.image_id, r.cx, r.labelled) for r in readers.labels_of_images(rows("image_id string", ("i1",), ("i2",), ("i3",)), labels).fillna(-1.0, ["cx"]).collect())
    assert got == [("i1", 0.25, True), ("i1", 0.5, True), ("i2", -1.0, False), ("i3", -1.0, False)]


def test_each_answer_meets_the_schema_of_its_stage(rows):
    schemas = {"a": {"$.n": "bigint", "$.deep.name": "string"}, "b": {"$.list": "array<struct<x:double>>"}}
    good = [(1, "a", '{"n":1,"deep":{"name":"x"}}'), (2, "b", '{"list":[]}'), (3, "b", '{"list":[{"x":1}]}')]
    bad = [(4, "a", '{"n":1}', "$.deep.name"), (5, "a", '{"n":"one","deep":{"name":"x"}}', "$.n"), (6, "b", '{"list":{}}', "$.list"), (7, "b", "[1]", "$"), (8, "a", "{", "$"), (9, "a", None, "$"), (10, "a", "null", "$")]
    odd = [(11, "c", "{}"), (12, None, "{}")]
    runs = rows("run_id int, stage string, answer string", *good, *(b[:3] for b in bad), *odd)
    typed, issues = readers.dispatch_answers(runs, schemas)
    assert sorted(r.run_id for r in typed.collect()) == [1, 2, 3]
    assert {(r.run_id, r.rule, r.path) for r in issues.collect()} == {(b[0], "malformed", b[3]) for b in bad} | {(11, "unknown_stage", None), (12, "unknown_stage", None)}
    assert [(r.n, r.name) for r in readers.stage_fields(typed, schemas, "a").collect()] == [(1, "x")]
    assert sorted(len(r.list) for r in readers.stage_fields(typed, schemas, "b").collect()) == [0, 1]


def test_slugs_and_run_paths(rows):
    found, none = readers.by_slug(rows("n int, slug string, title string", (1, "a", "old"), (2, "b", "old"), (3, None, "old")), rows("slug string, title string, year int", ("a", "new", 1), ("a", "new", 2), ("c", "x", 3)))
    assert [(r.n, r.title, r.year) for r in found.collect()] == [(1, "new", 2)] and sorted(r.n for r in none.collect()) == [2, 3]
    runs = rows("output_dir string", ("r/1/s",), ("r/2/../3/s/",), ("../r/4",), ("r/5",))
    audits = rows("pos int, prior_dir string, output_dir string, exit_code int", (1, "r//1/./s", "x", 0), (2, "r/1/s", "y", 0), (3, "r/1/s", "z", 1), (4, "r/3/s", "w", 0), (5, "r/4", "v", 0), (6, "r/5", "u", 2))
    assert {(r.output_dir, r.audit_dir) for r in summary.run_matches(runs, audits).collect()} == {("r/1/s", "y"), ("r/2/../3/s/", "w")}


def test_ratio_choice_gates_and_ties(rows):
    tried = [
        (1, 2.0, 0.8, 0.5), (1, 4.0, 0.8, 0.5), (1, 3.0, 0.7, 0.5), (1, 2.5, 0.8, 0.5),  # tie: nearest three
        (2, 2.5, 0.9, 0.5), (2, 3.5, 0.9, 0.5), (2, 3.0, 0.1, 0.5),  # tie on both sides: the smaller
        (3, 2.0, 0.9, 0.34), (3, 3.0, 0.1, 0.34),  # axis not seen
        (4, 2.0, 0.37, 0.9), (4, 3.0, 0.1, 0.9),  # overlap too small
        (5, 2.0, 0.54, 0.9), (5, 3.0, 0.5, 0.9),  # gain too small
        (6, 2.0, 0.9, 0.9), (7, 3.0, 0.9, 0.9),  # no fallback row; nothing but it
    ]
    hyp = rows("id int, ratio double, iou double, observability double", *tried).selectExpr("1 as scene_id", "*")
    got = {r.id: (r.ratio, r.accepted, r.best_ratio) for r in cuboid.chosen_ratio(hyp).collect()}
    assert got == {1: (2.5, True, 2.5), 2: (2.5, True, 2.5), 3: (3.0, False, 2.0), 4: (3.0, False, 2.0), 5: (3.0, False, 2.0), 6: (3.0, False, 2.0), 7: (3.0, False, 3.0)}
