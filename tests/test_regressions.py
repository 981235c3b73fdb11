"""Behaviours of the learner on small planted tables, and functions that no query calls."""

import json
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from juncture.functions import scalars, text
from juncture.operators import audit, compare, learn, metrics, mining, observe
from juncture.plans import expr
from juncture.plans.compile import Engine, evaluate, gate_columns, interpret_mask, near_misses
from juncture.plans.compile import test_bit as bit_of
from juncture.plans.expr import leaf
from juncture.plans.policy import ActionPolicy, Feature, Gate, Rule, compose
from juncture.sources import readers
from juncture.streaming import score


def named(gate):
    return {f for r in gate.rules for f in expr.features(r.when)}


def test_a_broad_signal_beats_narrow_fragments(spark):
    rows = [(p, float(light), float((7 * i) % 11), p == "fern" and light > 6) for i in range(6) for p in ("fern", "moss", "palm") for light in range(1, 11)]
    got = learn.learn_gate(spark.createDataFrame(rows, "plant string, light double, humidity double, y boolean"), ["plant", "light", "humidity"], F.col("y"))
    assert got.report["parity"] == 1.0 and named(got.policy) == {"plant", "light"}


def test_what_only_follows_the_base_rate_is_no_rule(spark):
    rows = [(i % 10 == 0, i % 2 == 0 or i % 10 == 5, i % 10 == 0) for i in range(200)]
    got = learn.learn_gate(spark.createDataFrame(rows, "pest boolean, prior boolean, y boolean"), ["pest", "prior"], F.col("y"))
    assert len(got.policy.rules) == 1 and named(got.policy) == {"pest"}


def test_recall_takes_some_false_positives(spark):
    # two allowed rows lie within the broad region that holds all denied ones
    rows = [("fern", float(x), not (x == 8 and k < 2)) for x in (7, 8, 9) for k in range(6)] + [(p, float(x), False) for p in ("fern", "moss") for x in (1, 2, 3, 4) for _ in range(5)]
    df = spark.createDataFrame(rows, "plant string, light double, y boolean")
    got = learn.learn_gate(df, ["plant", "light"], F.col("y"), goal=learn.Goal("recall", 1.0, 0.1))
    assert got.report["recall"] == 1.0 and 0.9 < got.report["parity"] < 1.0
    assert evaluate(df, got.policy, "lenient").filter("not allow and not y").count() == 2


def test_balanced_keeps_rules_without_false_positives(spark):
    rows = [(i % 6 == 0, i % 6 == 3, i % 4 < 2, i % 3 == 0) for i in range(240)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, y boolean")
    got = learn.learn_gate(df, ["a", "b", "c"], F.col("y"))
    assert got.report["parity"] == 1.0 and got.report["fpr"] == 0.0 and named(got.policy) <= {"a", "b"}


def test_shards_with_a_shared_part_collapse_to_it(spark):
    rows = [(pest, root, curl, pest) for pest in (True, False) for root in (True, False) for curl in (True, False) for _ in range(12)]
    got = learn.learn_gate(spark.createDataFrame(rows, "pest boolean, root boolean, curl boolean, y boolean"), ["pest", "root", "curl"], F.col("y"))
    assert len(got.policy.rules) == 1 and named(got.policy) == {"pest"}


def test_edges_within_a_column_are_found(spark):
    df = spark.range(6000).select((F.pmod(F.xxhash64("id"), F.lit(10**6)) / 1000.0).alias("v"), (F.col("id") % 3).cast("string").alias("k")).withColumn("y", F.expr("v > 312.4567 and v < 547.8912 and k = '1'"))
    got = learn.learn_gate(df, ["v", "k"], F.col("y"))
    assert got.report["parity"] == 1.0 and got.report["held"] > 1000


def test_many_strings_are_named_though_only_some_come_first(spark):
    df = spark.range(4000).select(F.concat(F.lit("s"), (F.col("id") % 800).cast("string")).alias("s"), (F.col("id") % 800 < 400).alias("y"))
    axes, whole = mining.first_axes(df, {"s": "string"}, F.col("y"), most=256)
    assert len(axes["s"]) == 256 and "s" not in whole
    cells = mining.cell_table(df, ["s"], F.col("y"), (axes, whole))
    tree = leaf("s", "in", axes["s"])
    more, _, _ = mining.finer(df, F.col("y"), ~F.col("s").isin(axes["s"]), cells, [tree])
    assert len(more["s"]) == 400


def test_exact_choice_beyond_sixteen(spark):
    rng = np.random.default_rng(3)
    n = 300
    masks = rng.random((20, n)) < 0.12
    denied = (masks[:6].any(axis=0)).astype("int64")
    cells = mining.Cells({}, {}, {}, denied, 1 - denied, np.zeros(n, "int64"), np.zeros(n, "int64"))
    pool = [mining.Candidate(leaf("x", "==", f"v{i:02d}"), m, 0, 0, 0.0) for i, m in enumerate(masks[::-1])]
    plan = learn.Plan(cells, learn.Goal())
    found = learn.exact(cells, pool, learn.Goal(), most_nodes=400_000)
    assert plan.key(found)[0] == 0 and plan.key(found) <= plan.key(pool[-6:])


def test_comparisons_of_two_columns_are_found(spark):
    rows = [(float(a), float(b), float((a * 7 + b * 3) % 5), a > b + 2) for a in range(20) for b in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y boolean")
    got = learn.learn_gate(df, ["a", "b", "c"], F.col("y"))
    assert got.report["parity"] == 1.0 and any(f.derived for f in got.policy.features) and len(got.policy.rules) == 1
    assert evaluate(df, got.policy).filter("allow = y").count() == 0
    replayed = compare.replay(df, got.policy, F.col("y"))
    assert replayed.filter("not correct").count() == 0


def test_residual_conjunctions(spark):
    rows = [(a, b, c, a and b and not c) for a in (True, False) for b in (True, False) for c in (True, False) for _ in range(4)]
    cells = mining.cell_table(spark.createDataFrame(rows, "a boolean, b boolean, c boolean, y boolean"), ["a", "b", "c"], F.col("y"))
    plan = learn.Plan(cells, learn.Goal())
    learn.residual_conjunctions(plan)
    assert len(plan.chosen) == 1 and {(x["feature"], x["value"]) for x in expr.leaves(plan.chosen[0].tree)} == {("a", True), ("b", True), ("c", False)}


def test_probes_are_validated_and_adopted(spark):
    df = spark.createDataFrame([(float(x), x > 5 or x == 2) for x in range(10) for _ in range(3)], "x double, y boolean")
    gate = Gate("g", (Feature("x", "float"),), (Rule("high", leaf("x", ">", 5), 0),))
    probes = {"two": leaf("x", "==", 2), "low": leaf("x", "<", 4)}
    got = compare.validate_probes(df, gate, F.col("y"), probes)
    assert {r.probe: (r.matched, r.fixed, r.introduced, r.safe) for r in got.collect()} == {"two": (3, 3, 0, True), "low": (12, 3, 9, False)}
    more = compare.adopt(gate, got, probes)
    assert [r.id for r in more.rules] == ["high", "auto_proposal_001"] and evaluate(df, more).filter("allow = y").count() == 0


def test_actions_are_compared(spark):
    features = (Feature("x", "float"),)
    old = ActionPolicy("p", features, (Rule("a", leaf("x", ">", 5), 0, "stop", 0), Rule("b", leaf("x", ">", 2), 1, "ask", 1)), "go")
    new = ActionPolicy("p", features, (Rule("a", leaf("x", ">", 5), 0, "ask", 0), Rule("c", leaf("x", ">", 2), 1, "ask", 1)), "go")
    got = {(r.rule_id, r.new_id, r.change) for r in compare.rule_diff(compare.rule_table(spark, old), compare.rule_table(spark, new)).collect()}
    assert got == {("a", "a", "semantic_change"), ("b", "c", "renamed")}
    df = spark.createDataFrame([(1.0, "go"), (3.0, "stop"), (9.0, "stop")], "x double, act string")
    wrong = compare.action_conflicts(df, old, "act").collect()
    assert [(r.x, r.expected, r.predicted, r.candidates) for r in wrong] == [(3.0, "stop", "ask", ["ask"])]
    assert [r.correct for r in compare.replay_actions(df, old, "act").orderBy("x").collect()] == [True, False, True]


def test_observed_features(spark, tmp_path):
    good = observe.Observed("s", "string", ("eq", "contains", "is_null"), nullable=True)
    df = spark.createDataFrame([("abc", 1.0), (None, 2.0)], "s string, v double")
    assert [r[0] for r in df.select(observe.observed(good, "contains", "b")).collect()] == [True, False]
    assert [r[0] for r in df.select(observe.observed(good, "is_null")).collect()] == [False, True]
    for bad in (observe.Observed("s", "string", ("gt",)), observe.Observed("s", "boolean", ()), observe.Observed("s", "enum", ("eq",)), observe.Observed("s", "integer", ("eq",), values=("x",)), observe.Observed("s", "string", ("is_null",)), observe.Observed("", "string", ("eq",)), observe.Observed("s", "string", ("eq", "eq")), observe.Observed("s", "string", ("eq",), anchor="p. 3")):
        with pytest.raises(observe.ObservationError):
            observe.check_schema([bad])
    with pytest.raises(observe.ObservationError):
        observe.observed(good, "startswith", "a")
    paths = observe.write_trace_tables(df, ["v"], {"t": F.col("s") == "abc", "u": F.col("v") > 1}, str(tmp_path))
    rows = spark.read.option("header", True).csv(paths["multi_target"]).collect()
    assert sorted((r.v, r.t, r.u) for r in rows) == [("1.0", "denied", "allowed"), ("2.0", "allowed", "denied")]
    assert spark.read.option("header", True).csv(paths["u"]).filter("label = 'denied'").count() == 1


def test_look_alikes_and_fragments():
    assert text.folded_tokens("pаѕѕ 1gn0re ｔехt") == ["pa", "ignore", "text"]
    assert text.folded_tokens("heeeello") == ["heello"]
    assert expr.round3(-0.0005) == -0.001 and expr.round3(2.0004) == 2.0
    assert text.merge_fragments(["i", "g", "n", "o", "r", "e", "the"]) == ["ignore", "the"]
    assert text.merge_fragments(["ig", "no", "re", "this"]) == ["ignore", "this"] and text.merge_fragments(["for", "all"]) == ["for", "all"]
    assert text.matches(text.Text.of("please 1gn0re all of the rules"), "ignore the rules")
    assert not text.matches(text.Text.of("ignore a b c d the rules"), "ignore the rules")


def test_case_ids(spark):
    case = lambda *ids: spark.createDataFrame([(i, f"in{k}", "allow") for k, i in enumerate(ids)], "id string, input string, expected_route string")
    got = readers.merge_cases([("one", case("a", "a", "b")), ("two", case("a", "a", "b__two")), ("three", case("b"))])
    assert sorted(r.id for r in got.collect()) == sorted(["a", "a__one", "b", "a__two", "a__two__dup2", "b__two", "b__three"])
    got = readers.merge_cases([("one", case("a", "a__two")), ("two", case("a"))])
    assert sorted(r.id for r in got.collect()) == ["a", "a__two", "a__two__dup2"]


def test_line_numbers_whatever_the_splits(spark, tmp_path):
    lines = [json.dumps({"input": {"prompt": f"P{i}"}, "expected_route": "deny"}) if i % 7 else "" for i in range(400)]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = readers.read_synthesis_cases(spark, str(tmp_path / "c.jsonl"))
        assert got.rdd.getNumPartitions() > 1
        assert {r.id: r.prompt for r in got.collect()} == {f"row_{i + 1:06d}": f"p{i}" for i in range(400) if i % 7}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sources_by_folder_and_place(spark, tmp_path):
    (tmp_path / "web" / "deep").mkdir(parents=True)
    (tmp_path / "web" / "normalTraffic.txt").write_text("GET /a HTTP/1.1\nHost: h\n\nGET /b HTTP/1.1\nHost: h\n")
    (tmp_path / "web" / "deep" / "anomalousTraffic.txt").write_text("GET /c?x=%27 HTTP/1.1\nHost: h\n")
    got = readers.read_http_folder(spark, str(tmp_path / "web")).collect()
    assert sorted(r.expected_route for r in got) == ["allow", "allow", "deny"]
    (tmp_path / "logs" / "x").mkdir(parents=True)
    for name, uri in (("logs/a.log", "/1"), ("logs/x/b.log", "/2")):
        (tmp_path / name).write_text(f"--aa11-A--\nx\n--aa11-B--\nGET {uri} HTTP/1.1\n--aa11-Z--\n")
    tx = readers.read_audit_logs(spark, str(tmp_path / "logs")).collect()
    assert sorted(r.request for r in tx) == ["GET /1 HTTP/1.1", "GET /2 HTTP/1.1"]
    rows = spark.createDataFrame([(f"p{i}", i % 2) for i in range(30)], "prompt string, label int").repartition(5)
    ids = [{r.input: r.id for r in readers.adapt(rows.repartition(n), readers.sniff(["prompt", "label"])).collect()} for n in (2, 5)]
    assert ids[0] == ids[1] and sorted(ids[0].values()) == [f"labelled_prompt_{i:06d}" for i in range(1, 31)]
    readers.write_cases(readers.adapt(rows, readers.sniff(["prompt", "label"])), str(tmp_path / "cases"))
    assert readers.read_cases(spark, str(tmp_path / "cases")).count() == 30
    readers.write_traces(rows, str(tmp_path / "t.json"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "t.json").glob("part*")))
    assert len(json.loads(written)) == 30
    nested = spark.createDataFrame([("t", [("c", [("q1", "why?")])])], "title string, paragraphs array<struct<context:string,qas:array<struct<id:string,question:string>>>>")
    data = nested.select(F.array(F.struct("title", "paragraphs")).alias("data"))
    assert readers.qa_questions(data).first().question == "why?"


def test_checks_of_columns(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2},), ({"b": 3, "a": 4},)], "m map<string,int>")
    assert readers.ensure_rectangular(df, "m") == ["a", "b"]
    with pytest.raises(readers.SourceError):
        readers.ensure_rectangular(df.unionByName(spark.createDataFrame([({"a": 1},)], "m map<string,int>")), "m")
    table = spark.createDataFrame([(1, 2, 3)], "a int, b int, y int")
    assert text.observed_fields(spark.createDataFrame([("x", 1)], "prompt string, text int")) == ["prompt"]
    assert readers.select_features(table, "y") == ["a", "b"] and readers.select_features(table, "y", exclude=["a"]) == ["b"]
    with pytest.raises(readers.SourceError):
        readers.select_features(table, "y", only=["y"])


def test_scalars(spark):
    df = spark.createDataFrame([("12", "a"), ("1.5", "b"), ("true", "c"), ("42%", "d"), (None, None)], "s string, i string")
    assert [r.k.kind if r.k else None for r in df.select(scalars.plain_scalar(F.col("s")).alias("k")).collect()][:4] == ["int", "float", "bool", "string"]
    got = df.select("i", scalars.fnv_bucket(F.col("i"), F.lit(100)).alias("n")).collect()
    assert all(r.n is None if r.i is None else r.n == scalars.fnv1a(r.i) % 100 for r in got) and scalars.fnv1a("a") == 0xAF63DC4C8601EC8C
    pair = spark.createDataFrame([("password", "passwords"), ("cat", "cats"), ("ignore", "ignor"), ("equal", "equal")], "a string, b string")
    assert [r[0] for r in pair.select(text.words_alike(F.col("a"), F.col("b"))).collect()] == [text.alike(r.a, r.b) for r in pair.collect()] == [True, False, True, True]
    grams = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "w array<string>").select(text.skipgrams(F.col("w"), 1)).collect()
    assert [r[0] for r in grams] == [["a __gap__ c"], []]


def test_wide_masks_and_composition(spark):
    features = (Feature("x", "float"),)
    gate = Gate("wide", features, tuple(Rule(f"r{i}", leaf("x", ">", i), i) for i in (0, 62, 63, 64, 127, 200)))
    df = spark.createDataFrame([(100.0,), (0.5,)], "x double")
    words = gate_columns(gate)["mask"]
    got = df.select("x", *[bit_of(words, i).alias(f"b{i}") for i in (0, 62, 63, 64, 127, 200)]).collect()
    for r in got:
        mask = interpret_mask(gate, {"x": r.x})
        assert all(r[f"b{i}"] == bool(mask >> i & 1) for i in (0, 62, 63, 64, 127, 200))
    assert compare.cross_check(df, gate).first().asDict() == {"rows": 2, "agreed": 2}
    for mode in ("first_match", "weighted_vote"):
        policy = ActionPolicy("p", features, (Rule("a", leaf("x", ">", 0), 0, "low", 0, 1), Rule("b", leaf("x", ">", 50), 1, "high", 1, 2)), "none", mode=mode)
        assert [r.action for r in evaluate(df, policy).collect()] == Engine(policy).evaluate([r.asDict() for r in df.collect()])
    staged = compose("both", [gate, Gate("low", features, (Rule("l", leaf("x", "<", 1), 0),))], {"x": "$.x"})
    assert {"wide_bitmask", "low_bitmask"} <= set(evaluate(df, staged).columns)


def test_near_misses_match_the_interpreter(spark):
    features = (Feature("a", "float"), Feature("b", "float"))
    rules = (Rule("r0", {"all": [leaf("a", ">", 5), leaf("b", ">", 5)]}, 0), Rule("r1", {"any": [leaf("a", ">", 8), {"all": [leaf("b", "<", 1), leaf("a", "<", 1)]}]}, 1), Rule("r2", {"not": leaf("a", "<", 3)}, 2), Rule("r3", leaf("b", "==", 4), 3))
    gate = Gate("g", features, rules)
    df = spark.createDataFrame([(float(a), float(b)) for a in range(10) for b in range(0, 10, 2)], "a double, b double")
    for row in near_misses(df, gate).collect():
        plain = {"a": row.a, "b": row.b}
        lists = [(len(expr.unmet(r.when, plain)), r.bit, r.id, [expr.label(x) for x in expr.unmet(r.when, plain)]) for r in rules if not expr.holds(r.when, plain, False)]
        assert [(n.n_unmet, n.bit, n.rule, n.unmet) for n in row.near_misses] == sorted(lists)[:3]


def test_near_misses_are_ranked_without_a_comparator(spark):
    """Ranks are sorted as whole numbers by generated code, not by a comparator that is interpreted for each pair."""
    features = tuple(Feature(f"x{i}", "float") for i in range(6))
    gate = Gate("g", features, tuple(Rule(f"r{i}", {"any": [leaf(f"x{i}", ">", 5), leaf(f"x{i}", "<", -5)]}, 7 - i) for i in range(6)))
    df = spark.range(40).select(*[((F.col("id") * (i + 3)) % 13 - 6.0).alias(f"x{i}") for i in range(6)])
    got = near_misses(df, gate).filter(F.get("near_misses", F.lit(0))["n_unmet"] > 1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
    wanted = [sorted(7 - i for i in range(6) if abs(r[f"x{i}"]) <= 5)[:3] for r in df.collect()]
    assert [[n.bit for n in r.near_misses] for r in got.collect()] == [w for w in wanted if w]


def test_cross_check_interprets_equal_rows_once(spark):
    gate = Gate("g", (Feature("a b", "float"), Feature("s", "string")), (Rule("r0", leaf("a b", ">", 2), 0), Rule("r1", leaf("s", "==", "y"), 70)))
    df = spark.range(1000).select((F.col("id") % 4.0).alias("a b"), F.when(F.col("id") % 3 == 0, "y").otherwise("n").alias("s"))
    got = compare.cross_check(df, gate)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.index("ArrowEvalPython")
    assert got.first().asDict() == {"rows": 1000, "agreed": 1000}
    assert compare.cross_check(df.limit(0), gate).first().asDict() == {"rows": 0, "agreed": 0}


def test_reports(spark):
    df = spark.createDataFrame([(float(i), "x" if i % 2 else "y", i > 5) for i in range(10)], "v double, k string, y boolean")
    got = audit.drift_report(df, ["v"], ["k"], F.col("y"), nuisance=["v"]).collect()
    assert got[0].field == "v" and got[0].suspicious and not got[1].suspicious
    gate = Gate("g", (Feature("v", "float"),), (Rule("high", leaf("v", ">", 5), 0), Rule("none", leaf("v", ">", 90), 1)))
    rows = {r.rule: r for r in metrics.rule_reliability(df, gate, F.col("y"), examples=2).collect()}
    assert len(rows["high"].examples) == 2 and rows["high"].examples == sorted(rows["high"].examples) and rows["none"].examples is None
    assert mining.top_atoms(mining.threshold_coverage(df, ["v"], F.col("y")), 1).first().threshold == 6.0
    many = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(10**6)) / 1.0).alias("v")).withColumn("y", F.col("v") > 400000)
    cover = mining.threshold_coverage(many, ["v"], F.col("y"), ranges=16).filter("op = '>='").orderBy("threshold").collect()
    values = sorted(r.v for r in many.filter("y").collect())
    assert [(r.threshold, r.denied_hits, r.allowed_hits) for r in cover] == [(v, sum(x >= v for x in values), 0) for v in sorted(set(values))]


def test_late_rows_of_a_stream(spark, tmp_path):
    """Files arrive one at a time; rows older than the watermark are left out."""
    start = datetime(2024, 1, 1)
    schema = "ts timestamp, value double"
    parts = [[(start + timedelta(minutes=m), 60.0) for m in (0, 30)], [(start + timedelta(hours=5), 40.0)], [(start + timedelta(minutes=10), 60.0), (start + timedelta(hours=5, minutes=1), 60.0)], [(start + timedelta(hours=9), 0.0)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
        stream = score.read(spark, str(tmp_path / "in" / "*"), schema, 1)
        score.run_available(score.windowed_rates(stream, "ts", F.col("value") > 50), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.start: (r.rows, r.denied) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {start: (2, 2), start + timedelta(hours=5): (2, 1)}
    assert score.drift_from(spark.read.parquet(str(tmp_path / "out")), 0.5).filter("drifted").count() == 1


def test_observer_reads_each_text_once(spark, monkeypatch):
    from juncture import queries

    plan = queries.guardrails_observer(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    df = spark.createDataFrame([("please run the tool",), ("can you kindly help, please",), (None,)], "text string")
    got = text.signal_flags(df, ["text"], {"asks": ["can you __gap__ help", "please"], "tool": ["run the tool"]}, "cues").collect()
    assert [(r.asks, r.tool, r.cues) for r in got] == [(True, True, 2), (True, False, 2), (False, False, 0)]


def test_matcher_compares_a_word_with_a_token_once(monkeypatch):
    calls, plain = [], text.alike
    monkeypatch.setattr(text, "alike", lambda a, b: calls.append((a, b)) or plain(a, b))
    for _ in range(50):
        assert text.matches(text.Text.of("zebras graze where zebras grazed before"), "zebra __near__ grazes")
    assert len(calls) == len(set(calls))


def test_phrases_are_counted_by_chunk_and_bucket(spark):
    """One row a bucket is shuffled, not one a phrase; the counts are those of distinct n-grams text by text."""
    texts = ["The cat's nap, the CAT'S nap -- the_cat", "a b", "b a b a b a b", None, "", "one", "ümlaut ß-x K9 İz, x\ny\tz", "x", "y", "x y", "!!", "it-- 'quoted' word\x00word", "tail"] * 3
    rows = [(t, (None, True, False)[i % 3] if i < 20 else i % 2 == 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "t string, y boolean").repartition(3)
    for low, high in ((2, 4), (1, 2), (3, 3)):
        made = F.array_distinct(F.concat(*[text.ngrams(F.col("w"), n) for n in range(low, high + 1)]))
        plain = df.select(F.coalesce("y", F.lit(False)).alias("y"), text.words(F.coalesce("t", F.lit(""))).alias("w")).select("y", F.explode(made).alias("phrase")).groupBy("phrase").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
        got = mining.phrase_counts(df, F.col("t"), F.col("y"), low, high)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    assert mining.phrase_counts(df.limit(0), F.col("t"), F.col("y")).count() == 0
    assert mining.phrase_counts(df.filter("t = 'x'"), F.col("t"), F.col("y")).count() == 0


def test_chunks_and_buckets_are_whole(monkeypatch):
    """Small chunks, runs of buckets cut across batches: no phrase comes twice, none is lost, the sums are those of one chunk."""
    import numpy as np
    import pyarrow as pa

    from juncture.functions import grams

    words = [f"w{i * i % 97}" for i in range(4000)]
    docs = [" ".join(words[i : i + 1 + i % 50]) for i in range(0, 3900, 13)]
    data, cuts = grams._bytes(pa.array(docs))
    flags = np.arange(len(docs)) % 3 == 0
    whole = [r for b in grams._dealt(data, cuts, flags, 2, 4) for r in grams._added([b])]
    parts = [b for i in range(len(docs)) for b in grams._dealt(data[cuts[i] : cuts[i + 1]], cuts[i : i + 2] - cuts[i], flags[i : i + 1], 2, 4)]
    rows = pa.Table.from_batches(parts).sort_by("bucket").combine_chunks()
    monkeypatch.setattr(grams, "TOGETHER", 2000)
    runs = list(grams._whole_buckets(iter(rows.to_batches(max_chunksize=7))))
    assert len(runs) > 5
    out = [r for held in runs for r in grams._added(held)]
    listed = lambda batches: sorted(tuple(x.values()) for b in batches for x in b.to_pylist())
    assert listed(out) == listed(whole)
    assert len({x[0] for x in listed(out)}) == len(listed(out))


def test_phrases_are_ranked_from_dealt_counts(spark):
    """No n-gram is a row of the shuffle; ties go to fewer neg, more pos, the shorter and then by text."""
    from juncture import queries

    plan = queries.phrase_rank(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    df = spark.createDataFrame([("b c", True), ("b c", True), ("a z", True), ("a z", True), ("aa z", True), ("aa z", True), ("q r", True), ("q r", True), ("q r", True), ("q r", False), ("lone one", True)], "t string, y boolean")
    got = mining.rank_phrases(mining.phrase_counts(df, F.col("t"), F.col("y")), 10).collect()
    assert [tuple(r) for r in got] == [("a z", 2, 0), ("b c", 2, 0), ("aa z", 2, 0), ("q r", 3, 1)]


def test_other_texts_are_searched_for_the_best_phrases_alone(spark, monkeypatch):
    """phrase_rank deals the n-grams of positive texts only; what it counts in the others is exact, so the rank is that of all counts."""
    from juncture import queries
    from juncture.functions import grams

    dealt, plain = [], grams.counted
    monkeypatch.setattr(grams, "counted", lambda df, low, high: dealt.append(df) or plain(df, low, high))
    got = queries.phrase_rank(spark, "/root/testdata/sf0.001").collect()
    assert len(dealt) == 1 and dealt[0].count() > 0 and dealt[0].filter("not positive").count() == 0
    rows = queries._labelled(spark, "/root/testdata/sf0.001")
    assert got == mining.rank_phrases(mining.phrase_counts(rows, F.col("text"), F.col("toxic") == 1), 50).collect()


def test_best_phrases_by_each_way(spark, monkeypatch):
    """One pass, more of them for phrases that could still be better, and everything where those are too many."""
    from juncture.functions import grams

    # words that all texts share come first by pos and are bad, so the best ones lie beyond the first by pos
    texts = [(f"the of the of and the c{i % 7} d{i % 3} c{i % 5} D{i % 3}", i % 4 == 0) for i in range(120)] + [("it is bad it is bad", True)] * 5 + [("it is good", None), (None, True), ("", True), ("the", True)]
    df = spark.createDataFrame(texts, "t string, y boolean").repartition(3)
    args = (df, F.col("t"), F.col("y"))
    searched, plain = [], grams.occurring
    monkeypatch.setattr(grams, "occurring", lambda df, phrases: searched.append(len(phrases)) or plain(df, phrases))
    for k, least, low, high in ((10, 2, 2, 4), (4, 3, 1, 2), (500, 2, 2, 4)):
        want = mining.rank_phrases(mining.phrase_counts(*args, low, high), k, least).collect()
        for first, most, more in ((1000, 1000, False), (3, 1000, True), (3, 2, False)):
            searched.clear()
            assert mining.best_phrases(*args, k, least, low, high, first, most).collect() == want
            assert (len(searched) > 1) == (more and k < 500)
    assert mining.best_phrases(df.filter("not y"), F.col("t"), F.col("y"), 5).collect() == []


def test_phrases_are_found_once_a_text():
    import pyarrow as pa

    from juncture.functions import grams

    phrases = ["a b", "a b c", "a b c d", "b", "b c", "c a", "x y z"]
    docs = ["a b c d, a b", "b", "", "a", "b c a b c", "x y", "z", "A b c", "q a-b c"]
    data, cuts = grams._bytes(pa.array(docs))
    got = [phrases[i] for i in grams.Tree.of(phrases).found(data, cuts)]
    words = [re.findall(r"[a-z0-9_'\-]+", d) for d in docs]
    want = [p for w in words for p in phrases if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))]
    assert sorted(got) == sorted(want)
    assert not len(grams.Tree.of([]).found(data, cuts)) and not len(grams.Tree.of(phrases).found(data[:0], cuts[:1]))
