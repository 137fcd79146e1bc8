"""Answers in versions, logs of changes, replaced lists."""

import random

from pyspark.sql import functions as F

from siteweave.operators import intake, rules
from siteweave.plans import evidence, history, versions

ANSWER = "doc_id int, id string, anchor_status string, w double"


def _rules(rows):
    return rules.all_of(
        rules.row_issues(rows, {"size": rules.bad(F.col("w") > 0), "status": rules.not_in("anchor_status", rules.ANCHOR_STATUS)}),
        rules.duplicates(rows, "duplicate_id", ["doc_id", "id"]),
    )


def test_a_normalised_answer_is_taken_only_whole(rows):
    docs = rows("doc_id int, requested_stage string, stage string", (1, "plan_buildings", None), (2, "plan_buildings", None), (3, "plan_buildings", "plan_buildings"),
                (4, "plan_buildings", "landmarks"), (5, "landmarks", None), (6, "plan_buildings", "plan_buildings"), (7, "plan_buildings", None))
    answers = rows(ANSWER, (1, "a", "partial_visible", 1.0), (1, "b", "inferred", 1.0), (2, "a", "partial_visible", -1.0), (3, "a", "inferred", 1.0), (3, "a", "inferred", 1.0),
                   (4, "a", "partial_visible", 1.0), (5, "a", "partial_visible", 1.0), (6, "a", "partial_visible", 2.0), (6, "b", "partial_visible", 2.0))
    out, taken, found = versions.normalize_answers(docs, answers, _rules)
    got = {r.doc_id: (r.stage, r.changes, r.issues_before, r.issues_after) for r in out.collect()}
    assert got == {
        1: ("plan_buildings", 2, 2, 0),  # stage and status
        2: (None, 0, 3, 1),  # the size is left: nothing is changed
        3: ("plan_buildings", 0, 1, None),
        4: ("landmarks", 0, 2, 1),  # another stage is never overwritten
        5: (None, 0, 2, 1),  # the status word is only known in the plan stage
        6: ("plan_buildings", 2, 2, 0),
        7: ("plan_buildings", 1, 1, 0),
    }
    status = sorted((r.doc_id, r.anchor_status) for r in taken.collect())
    assert status == [(1, "inferred"), (1, "visible_partial"), (2, "partial_visible"), (3, "inferred"), (3, "inferred"), (4, "partial_visible"), (5, "partial_visible"), (6, "visible_partial"), (6, "visible_partial")]
    assert {(r.doc_id, r.version, r.rule) for r in found.collect() if r.doc_id == "2"} == {("2", 0, "wrong_stage"), ("2", 0, "size"), ("2", 0, "status"), ("2", 1, "size")}


def test_stored_answers_are_judged_again(rows):
    runs = rows("run_id int, finish_reason string, answer string", (1, "stop", '{"doc_id":1,"id":"a","anchor_status":"inferred","w":-1}'), (2, "length", "{}"), (3, "stop", "[1]"),
                (4, "stop", '{"doc_id":4'), (5, "stop", '{"doc_id":5,"id":"a","anchor_status":"no","w":1}'), (6, None, "{}"), (7, "stop", None))
    stored = rows("doc_id string, entity_id string, rule string", ("1", "a", "size"), ("1", "a", "status"))
    change, refused = versions.revalidate(runs, ANSWER, _rules, stored)
    assert {(r.doc_id, r.rule, r.was, r.now) for r in change.collect()} == {("1", "size", True, True), ("1", "status", True, False), ("5", "status", False, True)}
    assert sorted(r.run_id for r in refused.collect()) == [2, 3, 4, 6, 7]


def test_current_state_equals_replay_in_any_order(rows):
    rng = random.Random(5)
    log = []
    for seq in range(400):
        fields = rng.sample(["a", "b", "c"], rng.randrange(4))
        value = lambda: rng.choice([None, 1, 2, 3])
        log.append((rng.randrange(9), seq, rng.choice(["set", "set", "set", "remove"]), fields, value(), value(), value()))
    want = {}
    for key, seq, op, stated, *values in log:
        if op == "remove":
            want.pop(key, None)
        else:
            old = want.get(key, (None,) * 4)
            want[key] = (*(v if f in stated else o for f, v, o in zip("abc", values, old, strict=False)), seq)
    rng.shuffle(log)
    table = rows("id int, seq int, op string, stated array<string>, a int, b int, c int", *log).repartition(5)
    got = {r.id: (r.a, r.b, r.c, r.version) for r in history.current_state(table, ["id"], ["a", "b", "c"]).collect()}
    assert got == want


def test_lists_are_replaced_only_by_lists(rows):
    old = rows("plan_id int, source_id string, reason string", *((k, f"old{k}", "r") for k in range(9)))
    text = ["{}", '{"rej":null}', '{"rej":[]}', '{"rej":[{"source_id":"x","reason":"y"},{"source_id":"z"}]}', '{"rej":3}', '{"other":[1]}', '{"rej":{"source_id":"x"}}', "[1]"]
    patches = rows("plan_id int, text string", *enumerate(text)).select("plan_id", F.try_parse_json("text").alias("patch"))
    new, says = history.replaced_lists(old, patches, "rej", "source_id string, reason string")
    assert {r.plan_id: r.says for r in says.collect()} == {0: "absent", 1: "null", 2: "empty", 3: "list", 4: "not_a_list", 5: "absent", 6: "not_a_list", 7: "absent"}
    kept = {(k, f"old{k}", "r") for k in (0, 1, 4, 5, 6, 7, 8)}
    assert {tuple(r) for r in new.collect()} == kept | {(3, "x", "y"), (3, "z", None)}


def test_removals_add_to_a_replaced_list_and_rebuilt_ownership_forgets(rows):
    old = rows("plan_id int, source_id string, reason string", (1, "s0", "before"), (2, "s0", "before"))
    patches = rows("plan_id int, text string", (1, '{"replace_rejected":[]}')).select("plan_id", F.try_parse_json("text").alias("patch"))
    removed = rows("plan_id int, id string, merge_into string, reason string", (1, "A", None, "shadow"), (1, "B", "C", "same"), (2, "A", None, "roof"))
    claims = rows("plan_id int, source_id string, owner string", (1, "s1", "A"), (1, "s2", "B"), (2, "s3", "A"), (2, "s4", "C"))
    assert {tuple(r) for r in history.review_rejections(old, patches, removed, claims).collect()} == {(1, "s1", "shadow"), (2, "s0", "before"), (2, "s3", "roof")}
    owned, rejected = history.rebuilt_ownership(rows("plan_id int, source_id string, target string, reason string", (1, "s1", "A", None), (1, "s2", None, "none")))
    assert [tuple(r) for r in owned.collect()] == [(1, "s1", "A")] and [tuple(r) for r in rejected.collect()] == [(1, "s2", "none")]


def test_a_choice_with_unknown_or_repeated_ids_refuses_its_run(rows):
    decisions = rows("plan_id int, run_id int, id string", (1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (1, 3, "e"), (1, 4, "f"))
    runs = rows("run_id int, complete boolean, crop string, meta_crop string, source_sha256 string, plan_sha256 string", *((k, k != 4, "c", "c", "s", "p") for k in range(1, 5)))
    plans = rows("plan_id int, source_sha256 string, plan_sha256 string", (1, "s", "p"))
    chosen = rows("run_id int, id string", (1, "a"), (2, "c"), (2, "c"), (3, "d"), (3, "nowhere"), (4, "f"))
    good, refused = evidence.load_evidence(decisions, runs, plans, chosen)
    assert [r.id for r in good.collect()] == ["a"]
    assert {(r.id, r.reason) for r in refused.collect()} == {("c", "invalid_selection"), ("d", "invalid_selection"), ("e", "invalid_selection"), ("f", "incomplete_run")}
    assert {r.id for r in evidence.load_evidence(decisions, runs, plans)[0].collect()} == set("abcde")


def test_report_counts_only_answers_of_the_stage(rows):
    gated = rows("run_id string, stage string, refused string", ("r1", "inventory", None), ("r2", "review", None), ("r3", "inventory", "truncated"), ("r4", "inventory", None))
    box = (0.0, 0.0, 10.0, 10.0, None)
    objects = rows("run_id string, id string, category string, x0 double, y0 double, x1 double, y1 double, occluder string", ("r1", "a", "tree_group", *box), ("r1", "b", "mountain", *box), ("r1", "c", "ship", *box), ("r2", "a", "house", *box))
    report, counts, refused = intake.normalization_report(gated, objects)
    assert {tuple(r) for r in report.collect()} == {("r1", 1, 1, 1), ("r4", 0, 0, 0)}
    assert {tuple(r) for r in counts.collect()} == {("r1", "tree", 1), ("r1", "mountain", 1), ("r1", "ship", 1)}
    assert {tuple(r) for r in refused.collect()} == {("r2", "wrong_stage"), ("r3", "truncated")}
