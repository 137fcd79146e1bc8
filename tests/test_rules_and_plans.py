"""Rule mutations, ownership, locks, evidence, publication."""

import pytest
from pyspark.sql import functions as F

from siteweave.functions.answers import with_strict_json
from siteweave.operators import intake, rules
from siteweave.plans import cuboid, evidence, publication, revision


def found(issues):
    return sorted((r.doc_id, r.entity_id, r.rule) for r in issues.collect())


INV = "doc_id string, id string, category string, x0 double, y0 double, x1 double, y1 double, occluder string"
GOOD = ("d", "a", "house", 1.0, 1.0, 5.0, 5.0, None)


@pytest.mark.parametrize(
    "bad,rule",
    [
        (("d", "b", "castle", 1.0, 1.0, 5.0, 5.0, None), "unsupported_category"),
        (("d", "b", "tree", 5.0, 1.0, 5.0, 5.0, None), "bbox_range"),
        (("d", "b", "tree", 1.0, 1.0, 1001.0, 5.0, None), "bbox_range"),
        (("d", "b", "tree", 1.0, 1.0, 5.0, 5.0, "z"), "unknown_occluder"),
        (("d", "", "tree", 1.0, 1.0, 5.0, 5.0, None), "missing_id"),
        (("d", "a", "tree", 1.0, 1.0, 5.0, 5.0, None), "duplicate_id"),
    ],
)
def test_inventory_mutations(rows, bad, rule):
    assert found(rules.inventory_issues(rows(INV, GOOD))) == []
    assert [r[2] for r in found(rules.inventory_issues(rows(INV, GOOD, bad)))] == [rule]


def test_accounting(rows):
    ex = rows("plan_id int, source_id string", (1, "a"), (1, "b"), (1, "c"))
    cl = rows("plan_id int, source_id string", (1, "a"), (1, "b"), (1, "b"), (1, "x"))
    got = {r.source_id: r.status for r in rules.accounting(ex, cl).collect()}
    assert got == {"a": "ok", "b": "repeated", "c": "missing", "x": "unexpected"}


def test_review_shares_sources_but_not_with_rejections(rows):
    two = "doc_id int, source_id string"
    ob = rows("doc_id int, id string, status string", (1, "o1", "supported"), (1, "o2", "uncertain"))
    refs = rows("doc_id int, id string, source_id string", (1, "o1", "a"), (1, "o2", "a"))
    src = rows(two, (1, "a"), (1, "b"))
    assert found(rules.review_issues(ob, refs, rows(two, (1, "b")), src)) == []
    assert [r[2] for r in found(rules.review_issues(ob, refs, rows(two, (1, "a")), src))] == ["rejected_retained", "unaccounted_source"]


def test_ground_check_front_edge(rows):
    alt = rows("doc_id int, instance_id string, alternative_id string, corners string, placement string", (1, "i", "a", "c", "anchored"), (1, "i", "s", "", "shape_only"))
    schema = "doc_id int, instance_id string, alternative_id string, verdict string, corners string, consistent boolean, front array<int>"
    ok = [(1, "i", "a", "usable_hypothesis", "c", True, [0, 1]), (1, "i", "s", "usable_hypothesis", "", True, [])]
    assert found(rules.ground_check_issues(rows(schema, *ok), alt)) == []
    bad = [(1, "i", "a", "usable_hypothesis", "d", None, [1, 0])]
    assert sorted(r[2] for r in found(rules.ground_check_issues(rows(schema, *bad), alt))) == ["accepted_front_edge", "corner_echo", "not_decided", "order_consistency"]


def test_detail_matrix(spark):
    assert sorted((r.status, r.independence) for r in rules.allowed_pairs(spark).collect()) == [
        ("keep", "independent"), ("merge", "shared"), ("reject", "nonbuilding"), ("uncertain", "independent"), ("uncertain", "unresolved")]


def test_gate_and_strict_json(rows):
    r = rows("run_id int, finish_reason string, model_requested string, model_returned string, issues int, answer string",
             (1, "stop", "m-1", "m-1", 0, '```json\n{"a":1}\n```'), (2, "length", "m-1", "m-1", 0, "{}"), (3, "stop", "m-1", "m-10", 0, "{}"),
             (4, "stop", "m-1", "m-1-2024", 0, "text {broken"), (5, "stop", "m-1", "m-1-2024", 2, '{"b":2}'),
             (6, "stop", "m-1", "m-1-2024", 2, '<think>{}</think>{"b":2}'))
    got = {x.run_id: x.refused for x in intake.gate(r).select("run_id", "refused").collect()}
    assert got == {1: None, 2: "truncated", 3: "wrong_model", 4: "not_json", 5: "invalid", 6: "not_json"}


def test_text_around_an_object_is_refused_whatever_it_closes(rows):
    good = ['{"a":1}', ' \n{"a":[1,{"b":"]"}]} ', '```json\n{"a":"],["}\n```', "{}"]
    bad = ['{"a":1} tail', '{"a":1},{"b":2}', '{"a":1}],[2', '{"a":1}],"b":[', "[1]", '{"a":1} null', '{"a":1},null', '{"a":1', "1", "null", "", '{"a":1}}', '{"a":1}]']
    df = rows("n int, answer string", *enumerate(good + bad), (99, None))
    got = {r.n for r in with_strict_json(df, "answer", "doc").filter("doc is not null").collect()}
    assert got == set(range(len(good)))
    assert with_strict_json(df, "answer", "doc").filter("n = 1").selectExpr("variant_get(doc, '$.a[1].b', 'string') as b").first().b == "]"


def test_decode_path_needs_numbers(rows):
    df = rows("t string", ("[[1,2],[3,4.5]]",), ("[[1,2]]",), ("[[true,2],[3,4]]",), ("[[1,2],[3,1004]]",), ("nope",))
    assert [r[0] is not None for r in df.select(intake.decode_path(F.col("t"))).collect()] == [True, False, False, False, False]


def test_merge_moves_and_removal_rejects(rows):
    cl = rows("plan_id int, source_id string, owner string", (1, "s1", "A"), (1, "s2", "B"), (1, "s3", "C"), (1, "s4", None))
    gone = rows("plan_id int, id string, target string", (1, "B", "A"), (1, "C", None))
    got = {r.source_id: r.owner for r in revision.move_ownership(cl, gone).collect()}
    assert got == {"s1": "A", "s2": "A", "s3": None, "s4": None}


def test_review_keeps_every_source_exactly_once(rows):
    b = rows("plan_id int, id string, cx double", (1, "A", 1.0), (1, "B", 2.0), (1, "C", 3.0))
    cl = rows("plan_id int, source_id string, owner string", (1, "s1", "A"), (1, "s2", "B"), (1, "s3", "C"))
    ch = rows("plan_id int, id string, op string, merge_into string, cx double", (1, "A", "replace", None, 9.0), (1, "B", "remove", "A", None), (1, "N", "add", None, 4.0), (1, "C", "remove", None, None))
    new, claims = revision.apply_review(b, cl, ch)
    assert {(r.id, r.cx) for r in new.collect()} == {("A", 9.0), ("N", 4.0)}
    acc = rules.accounting(cl.select("plan_id", "source_id"), claims)
    assert {r.status for r in acc.collect()} == {"ok"}


def test_redirect_drops_loops_and_lost_ends(rows):
    from siteweave.operators.graph import redirect_edges

    e = rows("plan_id int, src string, dst string", (1, "A", "B"), (1, "B", "C"), (1, "C", "D"))
    m = rows("plan_id int, id string, target string", (1, "B", "A"), (1, "D", None))
    assert [(r.src, r.dst) for r in redirect_edges(e, m).collect()] == [("A", "C")]


def test_shape_constraint(rows):
    b = rows("plan_id int, id string, w double, d double, ratio_low double, ratio_high double, grouped boolean",
             (1, "A", 60.0, 10.0, 5.0, 7.0, False), (1, "G", 60.0, 10.0, 5.0, 7.0, True), (1, "K", 60.0, 30.0, 1.5, 2.5, False))
    ev = rows("plan_id int, id string, status string, ratio_low double, ratio_high double", *[(1, i, "keep", 1.5, 2.5) for i in "AGK"])
    got = {r.id: (r.d, r.ratio_low, r.shape_changed) for r in evidence.constrain_shapes(b, ev).collect()}
    assert got == {"A": (30.0, 1.5, True), "G": (10.0, 5.0, False), "K": (30.0, 1.5, False)}


def test_lock_survives_and_violation_is_seen(rows):
    cols = ", ".join(f"{c} double" for c in revision.OBSERVED)
    base = [float(i) for i in range(len(revision.OBSERVED))]
    old = rows(f"plan_id int, id string, {cols}", (1, "A", *base), (1, "B", *base))
    moved = [base[0] + 1, *base[1:]]
    now = rows(f"plan_id int, id string, {cols}", (1, "A", *moved), (1, "B", *base))
    assert [(r.id, r.fields) for r in revision.lock_violations(old, now).collect()] == [("A", 1)]


def test_identity_evidence(rows):
    q = {"q0x": 0.0, "q0y": 0.0, "q1x": 10.0, "q1y": 0.0, "q2x": 10.0, "q2y": 10.0, "q3x": 0.0, "q3y": 10.0}
    names = [*revision.OBSERVED, "category", "clock", "confidence", "grouped"]
    types = ", ".join(f"{n} {'string' if n in ('category', 'confidence') else 'boolean' if n == 'grouped' else 'double'}" for n in names)

    def rec(i, **kw):
        v = {"sx0": 0.0, "sy0": 0.0, "sx1": 9.0, "sy1": 9.0, "ax": 5.0, "ay": 5.0, **q, "category": "house", "clock": 6.0, "confidence": "high", "grouped": False, **kw}
        return (1, i, *[v[n] for n in names])

    b = rows(f"plan_id int, id string, {types}", rec("A"), rec("B"), rec("C"))
    cl = rows("plan_id int, source_id string, owner string", (1, "s1", "A"), (1, "s2", "B"), (1, "s3", "C"))
    ev = rows(f"plan_id int, id string, {types}, status string, merge_into string, independence string, appearance_kind string",
              (*rec("A", ax=50.0, ay=50.0, sx1=8.0), "keep", None, "unresolved", "physical"), (*rec("B"), "merge", "A", "shared", "physical"), (*rec("C"), "merge", "B", "shared", "physical"))
    out, claims, refused = evidence.apply_identity(b, cl, ev)
    got = {r.id: r for r in out.collect()}
    assert set(got) == {"A", "C"} and [r.id for r in refused.collect()] == ["C"]
    a = got["A"]
    assert (a.ax, a.ay, a.reported_ax, a.confidence, a.grouped, a.locked, a.sx1) == (5.0, 5.0, 50.0, "medium", True, True, 8.0)
    assert {r.source_id: r.owner for r in claims.collect()} == {"s1": "A", "s2": "A", "s3": "C"}


def test_publication_gate(rows):
    plans = rows("plan_id int, review_only boolean, sha256 string", (1, False, "h"), (2, True, "h"), (3, False, "h"))
    rv = rows("plan_id int, stage string, verdict string, plan_sha256 string", (1, "plan_final_check", "ready_for_confirmation", "h"), (2, "plan_final_check", "ready_for_confirmation", "h"), (3, "plan_critique", "reasonable_approximation", "other"))
    none = rows("plan_id int", (9,))
    g = publication.publication_gate(plans, rv, none, rows("doc_id string", ("9",)), rows("plan_id int, severity string", (1, "minor")))
    assert {r.plan_id: r.publishable for r in g.collect()} == {1: True, 2: False, 3: False}


def test_recovery_budget(rows):
    jobs = rows("job_id int, exit_code int, finish_reason string, model_ok boolean, parsed boolean, stage_ok boolean, corrections int",
                (1, 0, "stop", True, True, True, 0), (2, 2, "length", True, True, True, 0), (3, 2, "stop", True, True, True, 0), (4, 2, "stop", True, True, True, 0), (5, 2, "stop", True, True, True, 1))
    left = rows("job_id int", (4,), (5,))
    got = {r.job_id: r.action for r in publication.recovery(jobs, left).collect()}
    assert got == {1: "keep", 2: "refuse", 3: "revalidated", 4: "request_correction", 5: "exhausted"}


def test_contract_mutation(rows):
    schema = "doc_id int, id string, length double, depth double, solved_ratio double, recorded_ratio double, body_scale double, uniform boolean, locked boolean, cz double, depth_source string, fit_accepted boolean"
    good = (1, "h", 3.0, 1.0, 3.0, 3.0, 1.0, True, True, 0.0, cuboid.FALLBACK, False)
    met = rows("doc_id int, accepted boolean, houses int, detected int, oriented int, violations int, silhouette_iou double", (1, True, 4, 4, 4, 0, 1.0))
    assert found(cuboid.contract_issues(rows(schema, good), met)) == []
    drift = (1, "h", 3.0, 1.0, 3.0 + 1e-6, 3.0, 1.0, True, True, 0.0, cuboid.FIT_SOURCE, False)
    assert [r[2] for r in found(cuboid.contract_issues(rows(schema, drift), met))] == ["ratio_drifted", "rejected_fit_used"]


def test_scene_documents_are_chunked(rows):
    p = rows("scene_id int, kind string, id string", *[(1, "houses", f"h{i}") for i in range(25)])
    docs = cuboid.scene_documents(p, chunk=10).collect()
    assert {d.parts for d in docs} == {3} and sum(d.entries.count('"id"') for d in docs) == 25
