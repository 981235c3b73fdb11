"""Learners, mining, audit and comparison."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from juncture.operators import audit, compare, learn, metrics, mining
from juncture.plans import expr
from juncture.plans.compile import evaluate
from juncture.plans.expr import leaf
from juncture.plans.policy import ActionPolicy, Feature, Gate, Rule
from juncture.sources import readers


@pytest.fixture(scope="module")
def traces(spark):
    rows = [(float(a), float(b), c == 1, s) for a in range(10) for b in range(6) for c in (0, 1) for s in ("x", "y", "z")]
    return spark.createDataFrame(rows, "a double, b double, c boolean, s string").coalesce(2).cache()


@pytest.mark.parametrize("hidden", ["a > 6", "a >= 3 and b < 2", "s in ('x', 'y') and c", "a = 4", "not c and (a < 2 or b > 4)"])
def test_gates_are_found(traces, hidden):
    df = traces.withColumn("y", F.expr(hidden))
    got = learn.learn_gate(df, ["a", "b", "c", "s"], F.col("y"))
    assert got.report["parity"] == 1.0 and len(got.policy.rules) <= 3
    assert metrics.parity(evaluate(df, got.policy), F.col("y"), ~F.col("allow")).first()["parity"] == 1.0


def test_one_class_and_nulls(spark, traces):
    assert learn.learn_gate(traces, ["a"], F.lit(False)).policy.rules == ()
    df = spark.createDataFrame([(None, None, True), (1.0, "q", True), (2.0, None, False), (None, "r", False)], "a double, s string, y boolean")
    assert learn.learn_gate(df, ["a", "s"], F.col("y")).report["rows"] == 4
    assert learn.learn_gate(df.limit(0), ["a", "s"], F.col("y")).report["rows"] == 0


def test_exact_choice_is_the_best_subset(traces):
    df = traces.withColumn("y", F.expr("(a > 6 and c) or b = 0"))
    cells = mining.cell_table(df, ["a", "b", "c", "s"], F.col("y"))
    pool = learn.candidates(cells, cells.denied, 2)[:7]
    plan = learn.Plan(cells, learn.Goal())
    best = min(plan.key(list(s)) for n in range(8) for s in itertools.combinations(pool, n))
    assert plan.key(learn.exact(cells, pool, learn.Goal())) == best
    assert (cells.denied + cells.allowed + cells.held_denied + cells.held_allowed).sum() == traces.count()


def test_coarser_cells_lose_no_row(traces):
    df = traces.withColumn("y", F.expr("a > 6"))
    cells = mining.cell_table(df, ["a", "b"], F.col("y"), most_cells=12)
    assert (cells.denied + cells.held_denied).sum() == df.filter("y").count() and len(cells.denied) <= 12


def test_recall_goal(traces):
    df = traces.withColumn("y", F.expr("a > 8 or (b = 3 and s = 'x')"))
    assert learn.learn_gate(df, ["a", "b", "s"], F.col("y"), goal=learn.Goal("recall", 0.9, 0.2)).report["recall"] >= 0.9


def test_actions_fan_outs_votes_and_targets(traces):
    df = traces.withColumn("act", F.expr("case when a > 7 then 'stop' when s = 'x' then 'ask' else 'go' end"))
    got = learn.learn_actions(df, ["a", "b", "s"], "act")
    assert evaluate(df, got.policy).filter("action <> act").count() == 0
    voted = learn.vote_aware(df, got.policy, "act")
    assert voted.mode == "weighted_vote" and len(voted.rules) <= len(got.policy.rules)
    both = df.withColumn("acts", F.array_compact(F.array(F.when(F.col("a") > 7, "p"), F.when(F.col("s") == "x", "q"))))
    fan = learn.learn_fan_out(both, ["a", "s"], "acts").policy
    assert evaluate(both, fan).filter("array_sort(actions) <> array_sort(acts)").count() == 0
    gates, skipped = learn.learn_targets(df.withColumns({"t": F.col("a") > 5, "u": F.lit(True)}), ["a"], ["t", "u"])
    assert list(gates) == ["t"] and skipped == {"u": "one class only"}


def test_interactions_and_proposals(spark):
    df = spark.createDataFrame([(float(a), float(b), a > 2 * b) for a in range(1, 12) for b in range(1, 8)], "a double, b double, y boolean")
    names = [f.name for f in learn.interactions(df, ["a", "b"], F.col("y"))]
    assert "a__over__b" in names
    cells = mining.cell_table(df, ["a", "b"], F.col("y"))
    assert any(p["safe"] for p in learn.proposals(cells, []))


def test_hygiene():
    parts = [{"all": [leaf("a", ">=", 1), leaf("a", "<", 3)]}, {"all": [leaf("a", ">=", 3), leaf("a", "<=", 5)]}, leaf("a", ">", 9), leaf("s", "==", "x")]
    assert {expr.signature(t) for t in learn.merge_intervals(parts)} == {expr.signature(t) for t in (leaf("s", "==", "x"), {"all": [leaf("a", ">=", 1), leaf("a", "<=", 5)]}, leaf("a", ">", 9))}
    apart = [leaf("a", "<", 3), leaf("a", ">", 3)]
    assert len(learn.merge_intervals(apart)) == 2
    hits = np.array([[1, 0, 1], [1, 0, 0], [0, 1, 0]], dtype=bool)
    assert learn.select_phrases(hits, np.array([0, 0, 5])) == [0, 1]


def test_verification(spark):
    features = (Feature("n", "int", min=0, max=9), Feature("s", "string"))
    gate = Gate("g", features, (Rule("r", {"all": [leaf("n", ">=", 4), leaf("s", "==", "x")]}),))
    assert compare.verify(spark, gate, {"all": [leaf("s", "==", "x"), leaf("n", ">", 3)]})["complete"] is True
    got = compare.verify(spark, gate, leaf("s", "==", "x"))
    assert got["complete"] is False and got["missed"]["s"] == "x" and got["sound"] is True


def test_audit(spark):
    df = spark.createDataFrame([("yes", "a,b", 1), ("no", "c", 2), ("yes", "d", 3)], "approved string, tags string, n long")
    assert audit.infer_label(df) == "approved" and audit.label_domain(df, "approved") == ["no", "yes"]
    assert audit.infer_target(df)[0]["field"] == "approved"
    with pytest.raises(ValueError):
        audit.label_domain(df, "n")
    fields = [audit.Field("x", 0, 10), audit.Field("k", values=("p", "q", "r"), weights=(1, 2, 7)), audit.Field("noise", nuisance=True)]
    made = audit.generate_traces(spark, 400, fields, "x > 9 and k = 'r'", least_share=0.25)
    got = {r["allowed"]: r["count"] for r in made.groupBy("allowed").count().collect()}
    assert got == {True: 300, False: 100}
    assert audit.governance({"has_x": "bool", "noise": "bool", "n": "int"}, ["noise"]) == {"has_x": "true_only", "noise": "never", "n": None}
    assert audit.feature_dictionary(["debt_ratio"])["debt_ratio"]["higher_is_better"] is False


def test_split_shares(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    got = metrics.stratified_split(df, ["g"], F.col("id").cast("string"), 0.8)
    counts = {(r["g"], r["is_train"]): r["count"] for r in got.groupBy("g", "is_train").count().collect()}
    assert got.count() == 500 and counts[(0, True)] == 133 and counts[(2, False)] == 34


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,yes,$5\n2,no,$6\n")
    assert [r.asDict() for r in readers.read_traces(spark, str(tmp_path / "t.csv")).collect()][0] == {"a": 1, "b": True, "c": 5}
    (tmp_path / "u.csv").write_text("a,b\n1,\n")
    with pytest.raises(readers.SourceError, match="blank cells in b"):
        readers.read_traces(spark, str(tmp_path / "u.csv"))
    (tmp_path / "t.jsonl").write_text('{"x": {"y": "3"}, "l": [1, 2]}\n{"x": {"y": "4"}, "l": [3, 4]}\n')
    got = readers.read_traces(spark, str(tmp_path / "t.jsonl"))
    assert got.columns == ["l.0", "l.1", "x.y"] and [r["x.y"] for r in got.collect()] == [3, 4]
    text_of = spark.createDataFrame([("GET /a?x=1+2 HTTP/1.1\nHost: h\n\nPOST /b HTTP/1.1\nHost: h\n\nk=%41",)], "value string")
    reqs = readers.http_requests(text_of).collect()
    assert [r["path"] for r in reqs] == ["/a", "/b"] and reqs[0]["query"] == {"x": "1 2"} and reqs[1]["body"] == {"k": "A"}
    log = spark.createDataFrame([("--ab12-A--\nx\n--ab12-B--\nGET / HTTP/1.1\n--ab12-H--\nMessage: m\n--ab12-Z--\n",)], "value string")
    tx = readers.audit_transactions(log).first()
    assert tx["tx"] == "ab12" and tx["request"] == "GET / HTTP/1.1" and tx["meta"] == "Message: m"
    cases = readers.adapt(spark.createDataFrame([("hi", 1)], "prompt string, label int"), readers.sniff(["prompt", "label"]))
    assert cases.first()["expected_route"] == "deny"
    readers.write_traces(got, str(tmp_path / "out.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out.csv")).count() == 2
    assert readers.read_yaml_rows(spark, "- {a: 1}\n- {b: 2}").count() == 2


def test_phrases_beyond_the_exact_ones_cover_what_is_left():
    hits = np.zeros((21, 17), dtype=bool)
    hits[:20, :16] = True
    hits[20, 16] = True
    got = learn.select_phrases(hits, np.zeros(17, dtype=int))
    assert 16 in got and len(got) == 2


def test_votes_of_more_than_62_rules(spark):
    rows = spark.createDataFrame([(i, f"a{i}") for i in range(70)] + [(-1, "none")], "x int, action string")
    rules = tuple(Rule(f"r{i:02d}", expr.leaf("x", "==", i), i, f"a{i}", i, 1) for i in range(70))
    got = learn.vote_aware(rows, ActionPolicy("p", (Feature("x", "float"),), rules, "none", mode="weighted_vote"), "action")
    assert len(got.rules) == 70


def test_narrow_bands_are_not_crowded_out_by_wide_ones(spark):
    """Beside a wide rule, a band of three conditions whose edges have many strong but impure neighbours."""
    rule = "(v > 81234.5 AND v < 154321.7 AND k IN ('k1', 'k2')) OR v > 321111.1"
    df = spark.range(40_000).select((F.pmod(F.xxhash64("id"), F.lit(50_000_000)) / 100 + 900).alias("v"), F.concat(F.lit("k"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).cast("string")).alias("k"))
    df = df.withColumn("y", F.expr(rule)).cache()
    got = learn.learn_gate(df, ["v", "k"], F.col("y"))
    assert evaluate(df, got.policy, "lenient").filter(F.col("allow") == F.col("y")).count() == 0
