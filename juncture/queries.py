"""Registered queries and their DuckDB statements. Each runs over its whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juncture.functions import scalars, text
from juncture.operators import audit, compare, learn, metrics, mining, observe
from juncture.plans.compile import Compiler, Engine, evaluate, near_misses
from juncture.plans.expr import leaf, leaves
from juncture.plans.policy import ActionPolicy, FanOut, Feature, Gate, Override, Rule, Stage, Staged
from juncture.sources import readers
from juncture.streaming import score

FLAGSHIP = "gate_eval_lineitem"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function under its name, with the DuckDB statement of the same result."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


EPS = "2.220446049250313e-16"
LINE_FEATURES = (Feature("l_quantity", "float"), Feature("l_discount", "float"), Feature("l_tax", "float"), Feature("l_returnflag", "string"))
LINE = Gate(
    "line",
    LINE_FEATURES,
    (
        Rule("bulk_discount", {"all": [leaf("l_quantity", ">", 45), leaf("l_discount", ">=", 0.08)]}, 0),
        Rule("top_tax_or_tiny_return", {"any": [leaf("l_tax", "==", 0.08), {"all": [leaf("l_returnflag", "in", ["R"]), leaf("l_quantity", "<=", 2)]}]}, 1),
        Rule("no_plain_discount", {"all": [leaf("l_returnflag", "!=", "N"), {"not": leaf("l_discount", "<", 0.1)}]}, 2),
        Rule("odd_tax", leaf("l_tax", "in", [0.01, 0.03]), 40),
    ),
)
_R0, _R1 = "(l_quantity > 45 AND l_discount >= 0.08)", f"(abs(l_tax - 0.08) < {EPS} OR (l_returnflag = 'R' AND l_quantity <= 2))"
_R2, _R3 = "(l_returnflag <> 'N' AND NOT l_discount < 0.1)", f"(abs(l_tax - 0.01) < {EPS} OR abs(l_tax - 0.03) < {EPS})"
_DENY = f"({_R0} OR {_R1} OR {_R2} OR {_R3})"


@query(f"SELECT l_orderkey, l_linenumber, CAST(CASE WHEN {_R0} THEN 1 ELSE 0 END + CASE WHEN {_R1} THEN 2 ELSE 0 END + CASE WHEN {_R2} THEN 4 ELSE 0 END + CASE WHEN {_R3} THEN 1099511627776 ELSE 0 END AS BIGINT) AS mask, NOT {_DENY} AS allow FROM lineitem")
def gate_eval_lineitem(spark, sf_dir):
    return evaluate(table(spark, sf_dir, "lineitem"), LINE).select("l_orderkey", "l_linenumber", F.col("mask")[0].alias("mask"), "allow")


@query(f"SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN {_R0} THEN 'bulk_discount' END, CASE WHEN {_R1} THEN 'top_tax_or_tiny_return' END, CASE WHEN {_R2} THEN 'no_plain_discount' END, CASE WHEN {_R3} THEN 'odd_tax' END) AS matched FROM lineitem WHERE {_DENY}")
def gate_matched_rules(spark, sf_dir):
    found = evaluate(table(spark, sf_dir, "lineitem"), LINE, explain=True).filter("not allow")
    return found.select("l_orderkey", "l_linenumber", F.array_join(F.transform("rules", lambda r: r["id"]), ",").alias("matched"))


@query("SELECT o_orderkey, CAST(CASE WHEN c_acctbal > o_totalprice THEN 1 ELSE 0 END + CASE WHEN c_acctbal < 0 THEN 2 ELSE 0 END AS BIGINT) AS mask FROM orders JOIN customer ON o_custkey = c_custkey")
def gate_feature_ref(spark, sf_dir):
    gate = Gate("credit", (Feature("o_totalprice", "float"), Feature("c_acctbal", "float")), (Rule("covered", {"feature": "c_acctbal", "op": ">", "feature_ref": "o_totalprice"}, 0), Rule("in_debt", leaf("c_acctbal", "<", 0), 1)))
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return evaluate(both, gate).select("o_orderkey", F.col("mask")[0].alias("mask"))


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN abs(l_discount) < 2.220446049250313e-16 THEN 0.0 ELSE l_tax / l_discount END) > 1 AS taxed, l_discount - (CASE WHEN abs(l_discount) < 2.220446049250313e-16 THEN 0.0 ELSE l_tax / l_discount END) > 0 AS cheap FROM lineitem")
def derived_ratio_gate(spark, sf_dir):
    derived = (Feature("net", "float", derived={"kind": "difference", "left": "l_discount", "right": "load"}), Feature("load", "float", derived={"kind": "ratio", "left": "l_tax", "right": "l_discount"}))
    gate = Gate("derived", (*LINE_FEATURES, *derived), (Rule("taxed", leaf("load", ">", 1), 0), Rule("cheap", leaf("net", ">", 0), 1)))
    got = evaluate(table(spark, sf_dir, "lineitem"), gate)
    return got.select("l_orderkey", "l_linenumber", F.array_contains("matched_rules", "taxed").alias("taxed"), F.array_contains("matched_rules", "cheap").alias("cheap"))


ORDER_FEATURES = (Feature("o_totalprice", "float"), Feature("o_orderstatus", "string"), Feature("o_orderpriority", "string"))
ORDER_RULES = (
    Rule("urgent", leaf("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), 0, "expedite", 0, 3),
    Rule("large", leaf("o_totalprice", ">", 200000), 1, "review", 1, 2),
    Rule("large_open", {"all": [leaf("o_totalprice", ">=", 100000), leaf("o_orderstatus", "==", "O")]}, 2, "review", 2, 2),
    Rule("done", leaf("o_orderstatus", "==", "F"), 3, "archive", 3, 1),
)
_O = ("o_orderpriority IN ('1-URGENT', '2-HIGH')", "o_totalprice > 200000", "(o_totalprice >= 100000 AND o_orderstatus = 'O')", "o_orderstatus = 'F'")


@query(f"SELECT o_orderkey, CASE WHEN {_O[0]} THEN 'expedite' WHEN {_O[1]} OR {_O[2]} THEN 'review' WHEN {_O[3]} THEN 'archive' ELSE 'hold' END AS action, NOT ({' OR '.join(_O)}) AS defaulted, concat_ws(',', CASE WHEN {_O[0]} THEN 'expedite' END, CASE WHEN {_O[1]} OR {_O[2]} THEN 'review' END, CASE WHEN {_O[3]} THEN 'archive' END) AS candidates FROM orders")
def action_first_match(spark, sf_dir):
    got = evaluate(table(spark, sf_dir, "orders"), ActionPolicy("route", ORDER_FEATURES, ORDER_RULES, "hold"))
    return got.select("o_orderkey", "action", "defaulted", F.array_join("candidate_actions", ",").alias("candidates"))


@query(f"""SELECT o_orderkey, CASE WHEN e = 0 AND r = 0 AND a = 0 THEN 'none' WHEN e >= r AND e >= a THEN 'expedite' WHEN r >= a THEN 'review' ELSE 'archive' END AS action
FROM (SELECT o_orderkey, CASE WHEN {_O[0]} THEN 3 ELSE 0 END AS e, CASE WHEN {_O[1]} THEN 2 ELSE 0 END + CASE WHEN {_O[2]} THEN 2 ELSE 0 END AS r, CASE WHEN {_O[3]} THEN 1 ELSE 0 END AS a FROM orders)""")
def action_weighted_vote(spark, sf_dir):
    return evaluate(table(spark, sf_dir, "orders"), ActionPolicy("vote", ORDER_FEATURES, ORDER_RULES, "hold", "none", "weighted_vote")).select("o_orderkey", "action")


@query("SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type")
def action_support(spark, sf_dir):
    return metrics.support(table(spark, sf_dir, "events"), "event_type")


def _flag(name: str, tree: dict, features: tuple[Feature, ...]) -> Gate:
    return Gate(name, features, (Rule(name, tree, 0),))


EVENT_FEATURES = (Feature("value", "float"), Feature("event_type", "string"))
FAN = FanOut("alerts", (("page", _flag("page", {"all": [leaf("event_type", "==", "error"), leaf("value", ">=", 100)]}, EVENT_FEATURES)), ("notify", _flag("notify", leaf("value", ">", 50), EVENT_FEATURES)), ("bill", _flag("bill", leaf("event_type", "in", ["purchase", "signup"]), EVENT_FEATURES))))
_FAN = {"page": "(event_type = 'error' AND value >= 100)", "notify": "(value > 50)", "bill": "(event_type IN ('purchase', 'signup'))"}


@query(f"SELECT event_id, concat_ws(',', {', '.join(f'CASE WHEN {p} THEN {a!r} END' for a, p in _FAN.items())}) AS actions, {_FAN['notify']} AS notified FROM events")
def fanout_actions(spark, sf_dir):
    return evaluate(table(spark, sf_dir, "events"), FAN).select("event_id", F.array_join("actions", ",").alias("actions"), F.col("verdicts")["notify"].alias("notified"))


@query(f"""SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'deny' WHEN o_orderstatus = 'P' THEN 'wait' WHEN {_O[0]} THEN 'expedite' WHEN {_O[1]} OR {_O[2]} THEN 'review' WHEN {_O[3]} THEN 'archive' ELSE 'hold' END AS result,
CASE WHEN o_totalprice < 1000 THEN 'tiny' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'base' END AS source FROM orders""")
def override_pipeline(spark, sf_dir):
    tiny = _flag("tiny", leaf("o_totalprice", "<", 1000), ORDER_FEATURES)
    pending = ActionPolicy("pending", ORDER_FEATURES, (Rule("p", leaf("o_orderstatus", "==", "P"), 0, "wait", 0),), "go")
    policy = Override("orders", ActionPolicy("route", ORDER_FEATURES, ORDER_RULES, "hold"), (("tiny", tiny), ("pending", pending)))
    return evaluate(table(spark, sf_dir, "orders"), policy).select("o_orderkey", "result", "source")


def _staged(when=None) -> Staged:
    first = Gate("amount", (Feature("price", "float"),), (Rule("large", leaf("price", ">", 150000), 0),))
    second = Gate("final", (Feature("ok", "bool"), Feature("status", "string")), (Rule("blocked", {"all": [leaf("ok", "==", False), leaf("status", "!=", "F")]}, 0), Rule("pending", leaf("status", "==", "P"), 1)))
    stages = (Stage("amount", first, {"price": "$.o_totalprice"}), Stage("final", second, {"ok": "@amount.allow", "status": "$.o_orderstatus"}, {"bits": "$.bitmask", "allow": "$.allow"}, when))
    return Staged("pipe", stages, {"bits": "@final.bits", "allow": "@final.allow"}).validate()


_BITS = "CAST(CASE WHEN o_totalprice > 150000 AND o_orderstatus <> 'F' THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END AS BIGINT)"


@query(f"SELECT o_orderkey, {_BITS} AS bits, {_BITS} = 0 AS allow FROM orders")
def staged_pipeline(spark, sf_dir):
    return evaluate(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), _staged()).select("o_orderkey", F.col("bits")[0].alias("bits"), "allow")


@query(f"SELECT o_orderkey, CASE WHEN NOT o_totalprice > 150000 THEN {_BITS} END AS bits FROM orders")
def stage_when(spark, sf_dir):
    got = evaluate(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), _staged("@amount.allow"), "lenient")
    return got.select("o_orderkey", F.col("bits")[0].alias("bits"))


_N0 = "((CASE WHEN l_quantity > 45 THEN 0 ELSE 1 END) + (CASE WHEN l_discount >= 0.08 THEN 0 ELSE 1 END))"
_N1 = f"(CASE WHEN {_R1} THEN 0 ELSE 1 + (CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) + (CASE WHEN l_quantity <= 2 THEN 0 ELSE 1 END) END)"
_N2 = "(CASE WHEN l_returnflag <> 'N' THEN 0 ELSE 1 END)"


@query(f"""SELECT l_orderkey, l_linenumber, min(n * 100 + bit) // 100 AS n_unmet, arg_min(rule, n * 100 + bit) AS rule FROM (
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_shipdate, unnest([{_N0}, {_N1}, {_N2}, 1]) AS n, unnest([0, 1, 2, 40]) AS bit, unnest(['bulk_discount', 'top_tax_or_tiny_return', 'no_plain_discount', 'odd_tax']) AS rule,
unnest([{_R0}, {_R1}, {_R2}, {_R3}]) AS fires, row_id FROM (SELECT *, row_number() OVER () AS row_id FROM lineitem)) WHERE NOT fires GROUP BY row_id, l_orderkey, l_linenumber""")
def near_miss(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter(~Compiler(LINE.features, "lenient").tree({"all": [r.when for r in LINE.rules]}))
    got = near_misses(lines, LINE).withColumn("m", F.get("near_misses", F.lit(0)))
    return got.select("l_orderkey", "l_linenumber", F.col("m.n_unmet").alias("n_unmet"), F.col("m.rule").alias("rule"))


@query(f"SELECT l_quantity, l_discount, l_tax, l_returnflag, count(*) AS n FROM lineitem WHERE {_DENY} <> (l_returnflag = 'R') GROUP BY ALL")
def conflict_report(spark, sf_dir):
    found = compare.conflicts(table(spark, sf_dir, "lineitem"), LINE, F.col("l_returnflag") == "R")
    return found.groupBy("l_quantity", "l_discount", "l_tax", "l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('odd', 39.0, 0, true), ('odd', 40.0, 0, true), ('odd', 41.0, 1, false), ('low', 1.0, 2, false), ('low', 2.0, 0, true), ('low', 3.0, 0, true)) AS t(probe_rule, probe_value, mask, allow)")
def review_boundaries(spark, sf_dir):
    gate = Gate("probe", (Feature("q", "float"),), (Rule("odd", leaf("q", ">", 40.0), 0), Rule("low", leaf("q", "<", 2.0), 1)))
    return compare.boundary_probes(spark, gate, {"q": 10.0}).select("probe_rule", "probe_value", F.col("mask")[0].cast("int").alias("mask"), "allow")


@query("SELECT count(*) AS rows, count(*) AS agreed FROM lineitem")
def runtime_cross_check(spark, sf_dir):
    return compare.cross_check(table(spark, sf_dir, "lineitem"), LINE)


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_discount * 100) AS INTEGER) AS DOUBLE) / 100 AS pct, CAST(-l_linenumber AS BIGINT) AS negative, CAST(1000 + l_linenumber AS DOUBLE) AS dollars, l_tax > 0.04 AS flag FROM lineitem")
def coerce_human_numbers(spark, sf_dir):
    n = F.col("l_linenumber").cast("string")
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(" %")).alias("p"), F.concat(F.lit(" ("), n, F.lit(")")).alias("m"), F.concat(F.lit("$1,"), F.lpad(n, 3, "0"), F.lit(".0")).alias("d"), F.when(F.col("l_tax") > 0.04, "Yes").otherwise("OFF").alias("f"))
    return t.select("l_orderkey", "l_linenumber", scalars.parse_number(F.col("p")).alias("pct"), scalars.parse_whole(F.col("m")).alias("negative"), scalars.parse_number(F.col("d")).alias("dollars"), scalars.parse_bool(F.col("f")).alias("flag"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def nested_flatten(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k:bigint>").alias("props"))
    return readers.flatten(events).select("event_id", F.col("`props.k`").alias("k"))


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct([l_returnflag, l_linestatus, 'x'])), ';') AS actions FROM lineitem")
def action_lists(spark, sf_dir):
    raw = F.concat(F.col("l_linestatus"), F.lit(" , x|"), F.col("l_returnflag"), F.lit(";;"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(scalars.action_list(raw), ";").alias("actions"))


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE (n_chars > 400) = (quality = 1)) AS correct, count(*) FILTER (WHERE (n_chars > 400) = (quality = 1)) / count(*) AS parity FROM documents JOIN labels USING (doc_id)")
def training_parity(spark, sf_dir):
    return metrics.parity(_labelled(spark, sf_dir), F.col("quality") == 1, F.col("n_chars") > 400)


@query("""SELECT rule, m AS matched, d AS denied_hits, m - d AS allowed_hits, round(CASE WHEN m = 0 THEN 0 ELSE d / m END, 9) AS precision, round(d / nd, 9) AS recall, round((m - d) / (n - nd), 9) AS fpr, round(CASE WHEN m = 0 THEN 0 ELSE (d / m) / (nd / n) END, 9) AS lift FROM (
SELECT unnest(['bulk_discount', 'top_tax_or_tiny_return', 'no_plain_discount', 'odd_tax']) AS rule, unnest([count(*) FILTER (WHERE R0), count(*) FILTER (WHERE R1), count(*) FILTER (WHERE R2), count(*) FILTER (WHERE R3)]) AS m,
unnest([count(*) FILTER (WHERE R0 AND D), count(*) FILTER (WHERE R1 AND D), count(*) FILTER (WHERE R2 AND D), count(*) FILTER (WHERE R3 AND D)]) AS d, count(*) FILTER (WHERE D) AS nd, count(*) AS n FROM lineitem)""".replace("R0", _R0).replace("R1", _R1).replace("R2", _R2).replace("R3", _R3).replace("D)", "l_returnflag = 'R')"))
def rule_reliability(spark, sf_dir):
    got = metrics.rule_reliability(table(spark, sf_dir, "lineitem"), LINE, F.col("l_returnflag") == "R")
    return got.select("rule", "matched", "denied_hits", "allowed_hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "fpr", "lift")])


_WANT = {"page": "event_type = 'error'", "notify": "value > 60", "bill": "event_type = 'purchase'"}


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS action, count(*) FILTER (WHERE {w} AND {_FAN[a]}) AS tp, count(*) FILTER (WHERE NOT {w} AND {_FAN[a]}) AS fp, count(*) FILTER (WHERE {w} AND NOT {_FAN[a]}) AS fn, round(count(*) FILTER (WHERE {' AND '.join(f'({x}) = {_FAN[b]}' for b, x in _WANT.items())}) / count(*), 9) AS exact_set_match FROM events" for a, w in _WANT.items()) + ")")
def fanout_exact_set(spark, sf_dir):
    wanted = F.array_compact(F.array(*[F.when(F.expr(p), a) for a, p in _WANT.items()]))
    got = metrics.fan_out_metrics(evaluate(table(spark, sf_dir, "events"), FAN).withColumn("wanted", wanted), "wanted", "actions", list(_WANT))
    return got.select("action", "tp", "fp", "fn", F.round("exact_set_match", 9).alias("exact_set_match"))


@query("""SELECT lang AS category, count(*) AS cases, round(avg(CAST(expected = actual AS INTEGER)), 9) AS exact_match, round(coalesce(count(*) FILTER (WHERE expected <> 'allow' AND actual <> 'allow') / nullif(count(*) FILTER (WHERE expected <> 'allow'), 0), 0), 9) AS attack_catch,
round(coalesce(count(*) FILTER (WHERE expected = 'allow' AND actual = 'allow') / nullif(count(*) FILTER (WHERE expected = 'allow'), 0), 0), 9) AS benign_pass, round(coalesce(count(*) FILTER (WHERE expected = 'allow' AND actual <> 'allow') / nullif(count(*) FILTER (WHERE expected = 'allow'), 0), 0), 9) AS false_positive
FROM (SELECT lang, CASE WHEN toxic = 1 THEN 'deny' ELSE 'allow' END AS expected, CASE WHEN n_chars < 300 THEN 'deny' ELSE 'allow' END AS actual FROM documents JOIN labels USING (doc_id)) GROUP BY GROUPING SETS ((), (lang))""")
def benchmark_summary(spark, sf_dir):
    cases = _labelled(spark, sf_dir).select("lang", F.when(F.col("toxic") == 1, "deny").otherwise("allow").alias("expected"), F.when(F.col("n_chars") < 300, "deny").otherwise("allow").alias("actual"))
    got = metrics.benchmark_summary(cases, "expected", "actual", "lang")
    return got.select("category", "cases", *[F.round(c, 9).alias(c) for c in ("exact_match", "attack_catch", "benign_pass", "false_positive")])


def _held(w: str, g: str, t: str) -> str:
    return f"SELECT '{t}' AS target, count(*) FILTER (WHERE {w} AND {g}) AS tp, count(*) FILTER (WHERE NOT {w} AND NOT {g}) AS tn, count(*) FILTER (WHERE NOT {w} AND {g}) AS fp, count(*) FILTER (WHERE {w} AND NOT {g}) AS fn FROM documents JOIN labels USING (doc_id)"


@query(f"""WITH t AS ({_held('quality = 0', 'n_chars < 300', 'junk')} UNION ALL {_held('toxic = 1', 'n_chars > 900', 'toxic')}),
r AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fn) AS catch, fp / (fp + tn) AS false_positive FROM t)
SELECT target, tp, tn, fp, fn, round(accuracy, 9) AS accuracy, round(catch, 9) AS catch, round(false_positive, 9) AS false_positive FROM r UNION ALL SELECT 'macro', NULL, NULL, NULL, NULL, round(avg(accuracy), 9), round(avg(catch), 9), round(avg(false_positive), 9) FROM r""")
def heldout_scores(spark, sf_dir):
    got = metrics.heldout_scores(_labelled(spark, sf_dir), {"junk": (F.col("quality") == 0, F.col("n_chars") < 300), "toxic": (F.col("toxic") == 1, F.col("n_chars") > 900)})
    return got.select("target", "tp", "tn", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("accuracy", "catch", "false_positive")])


@query("SELECT l_quantity, l_discount, count(*) FILTER (WHERE l_returnflag = 'R') AS n_denied, count(*) FILTER (WHERE l_returnflag <> 'R') AS n_allowed FROM lineitem GROUP BY 1, 2 HAVING n_denied > 0 AND n_allowed > 0")
def exact_trace_conflicts(spark, sf_dir):
    return metrics.exact_conflicts(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], F.col("l_returnflag") == "R")


_PROFILED = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\", count(*) FILTER (WHERE regexp_matches(CAST({c} AS VARCHAR), '[,;|]')) AS multi FROM orders" for c in _PROFILED))
def column_profile(spark, sf_dir):
    return audit.column_profile(table(spark, sf_dir, "orders"), _PROFILED)


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS field, {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM orders GROUP BY {c}) WHERE rank <= 3" for c in _PROFILED[:2]))
def value_examples(spark, sf_dir):
    return audit.value_examples(table(spark, sf_dir, "orders"), _PROFILED[:2]).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT DISTINCT CASE WHEN quality = 1 THEN '1' ELSE '0' END AS token, quality = 0 AS denied FROM labels")
def label_domain(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.select(scalars.token(F.col("quality").cast("string")).alias("token"), audit.denied_column(labels, "quality").alias("denied")).distinct()


_DRIFT = " UNION ALL ".join(
    f"""SELECT field, round(sum(abs(d / nd - a / na)) * 0.5, 9) AS drift, round(max(td / nd), 6) AS mean_denied, round(max(ta / na), 6) AS mean_allowed FROM (SELECT '{c}' AS field, b, d, a, sum(d) OVER () AS nd, sum(a) OVER () AS na, sum(sd) OVER () AS td, sum(sa) OVER () AS ta FROM (
SELECT floor(least(greatest(({c} - lo) / (hi - lo), 0.0), 0.999999) * 10) AS b, count(*) FILTER (WHERE y) AS d, count(*) FILTER (WHERE NOT y) AS a, sum({c}) FILTER (WHERE y) AS sd, sum({c}) FILTER (WHERE NOT y) AS sa
FROM (SELECT CAST({c} AS DOUBLE) AS {c}, l_returnflag = 'R' AS y, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM lineitem) GROUP BY 1)) GROUP BY field"""
    for c in ("l_quantity", "l_extendedprice")
)


@query(_DRIFT)
def drift_numeric(spark, sf_dir):
    got = audit.numeric_drift(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], F.col("l_returnflag") == "R")
    return got.select("field", F.round("drift", 9).alias("drift"), F.round("mean_denied", 6).alias("mean_denied"), F.round("mean_allowed", 6).alias("mean_allowed"))


@query("SELECT 'event_type' AS field, round(sum(abs(d / nd - a / na)) * 0.5, 9) AS drift FROM (SELECT d, a, sum(d) OVER () AS nd, sum(a) OVER () AS na FROM (SELECT event_type, count(*) FILTER (WHERE value > 50) AS d, count(*) FILTER (WHERE NOT value > 50) AS a FROM events GROUP BY 1))")
def drift_discrete(spark, sf_dir):
    got = audit.discrete_drift(table(spark, sf_dir, "events"), ["event_type"], F.col("value") > 50)
    return got.select("field", F.round("drift", 9).alias("drift"))


@query("""SELECT doc_id, CASE WHEN n > 1 THEN r <= greatest(1, least(n - 1, floor(n * 0.8))) ELSE true END AS is_train FROM (
SELECT doc_id, count(*) OVER (PARTITION BY lang, source) AS n, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS r FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)""")
def stratified_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").filter("lang is not null and source is not null")
    return metrics.stratified_split(docs, ["lang", "source"], F.col("doc_id").cast("string"), 0.8).select("doc_id", "is_train")


@query("SELECT CASE WHEN f = 0 THEN CAST(item_id AS VARCHAR) WHEN f = 1 THEN item_id || '__second' ELSE item_id || '__third' END AS id, 'allow' AS expected_route FROM benchmark, (VALUES (0), (1), (2)) AS t(f)")
def dedupe_case_ids(spark, sf_dir):
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("input"), F.lit("allow").alias("expected_route"))
    return readers.merge_cases([("first", cases), ("second", cases), ("third", cases)]).select("id", "expected_route")


_COVERAGE = " UNION ALL ".join(
    f"""SELECT '{c}' AS field, t AS threshold, op, count(*) FILTER (WHERE y AND h) AS denied_hits, count(*) FILTER (WHERE NOT y AND h) AS allowed_hits, count(*) FILTER (WHERE y) AS nd, count(*) FILTER (WHERE NOT y) AS na FROM (
SELECT t, op, y, CASE op WHEN '<' THEN v < t WHEN '<=' THEN v <= t WHEN '==' THEN v = t WHEN '>=' THEN v >= t ELSE v > t END AS h
FROM (SELECT {c} AS v, l_returnflag = 'R' AS y FROM lineitem), (SELECT DISTINCT round({c} * 1000) / 1000 AS t FROM lineitem WHERE l_returnflag = 'R'), (VALUES ('<'), ('<='), ('=='), ('>='), ('>')) AS o(op)) GROUP BY t, op"""
    for c in ("l_quantity", "l_discount")
)


@query(f"SELECT field, threshold + 0.0 AS threshold, op, denied_hits, allowed_hits FROM ({_COVERAGE})")
def threshold_coverage(spark, sf_dir):
    got = mining.threshold_coverage(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], F.col("l_returnflag") == "R")
    return got.select("field", (F.col("threshold") + 0.0).alias("threshold"), "op", "denied_hits", "allowed_hits")


_G = "2 * (" + " + ".join(f"(CASE WHEN {o} > 0 THEN {o} * ln(CAST({o} AS DOUBLE) * (nd + na) / (CAST({r} AS DOUBLE) * {c})) ELSE 0 END)" for o, r, c in (("denied_hits", "h", "nd"), ("allowed_hits", "h", "na"), ("(nd - denied_hits)", "(nd + na - h)", "nd"), ("(na - allowed_hits)", "(nd + na - h)", "na"))) + ")"


@query(f"SELECT field, threshold + 0.0 AS threshold, op, round({_G}, 6) AS signal FROM (SELECT *, denied_hits + allowed_hits AS h FROM ({_COVERAGE})) WHERE h > 0 AND denied_hits * (nd + na) > nd * h")
def atom_gtest(spark, sf_dir):
    coverage = mining.threshold_coverage(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], F.col("l_returnflag") == "R")
    return coverage.filter((F.col("denied_hits") + F.col("allowed_hits") > 0) & (F.col("signal") > 0)).select("field", (F.col("threshold") + 0.0).alias("threshold"), "op", F.round("signal", 6).alias("signal"))


@query(f"SELECT CAST(CASE WHEN {_R0} THEN 1 ELSE 0 END + CASE WHEN {_R1} THEN 2 ELSE 0 END + CASE WHEN {_R2} THEN 4 ELSE 0 END + CASE WHEN {_R3} THEN 8 ELSE 0 END AS BIGINT) AS bits, count(*) FILTER (WHERE l_linestatus = 'O') AS n_denied, count(*) FILTER (WHERE l_linestatus <> 'O') AS n_allowed FROM lineitem GROUP BY 1")
def pattern_table(spark, sf_dir):
    from juncture.plans.compile import Compiler

    c = Compiler(LINE.features, "lenient")
    return mining.patterns(table(spark, sf_dir, "lineitem"), [c.tree(r.when) for r in LINE.rules], F.col("l_linestatus") == "O")


_HIDDEN = "(l_quantity > 40 AND l_discount >= 0.07) OR l_tax > 0.07"


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_HIDDEN}")
def learn_gate(spark, sf_dir):
    """Lines that the learned gate denies."""
    rows = table(spark, sf_dir, "lineitem").withColumn("denied", F.expr(_HIDDEN))
    got = learn.learn_gate(rows, ["l_quantity", "l_discount", "l_tax", "l_returnflag"], F.col("denied"))
    return Engine(got.policy).transform(rows, "lenient").filter("not allow").select("l_orderkey", "l_linenumber")


_ROUTED = "CASE WHEN o_totalprice > 300000 THEN 'review' WHEN o_orderpriority = '1-URGENT' THEN 'expedite' ELSE 'hold' END"


# the edges of the learned rules, which SQL finds as the extreme prices of each class
@query(f"""SELECT expected, count(*) AS n, count(*) AS correct, CASE expected WHEN 'review' THEN min(o_totalprice) WHEN 'expedite' THEN max(o_totalprice) END AS edge
FROM (SELECT {_ROUTED} AS expected, o_totalprice FROM orders) GROUP BY 1""")
def learn_actions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("expected", F.expr(_ROUTED))
    got = learn.learn_actions(rows, ["o_totalprice", "o_orderpriority", "o_orderstatus"], "expected")
    edges = {r.action: x["value"] for r in got.policy.rules for x in leaves(r.when) if x["feature"] == "o_totalprice"}
    said = evaluate(rows, got.policy, "lenient").groupBy("expected").agg(F.count("*").alias("n"), F.count_if(F.col("action") == F.col("expected")).alias("correct"))
    edge = F.lit(None).cast("double")
    for a, v in edges.items():
        edge = F.when(F.col("expected") == a, F.lit(float(v))).otherwise(edge)
    return said.withColumn("edge", edge)


_BAND = "(o_totalprice > 81234.5 AND o_totalprice < 154321.7 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) OR o_totalprice > 321111.1"


@query(f"SELECT o_orderkey FROM orders WHERE {_BAND}")
def learn_bands(spark, sf_dir):
    """Orders that a gate learned from raw prices denies: conjunctions whose edges lie inside the column."""
    rows = table(spark, sf_dir, "orders").withColumn("y", F.expr(_BAND))
    got = learn.learn_gate(rows, ["o_totalprice", "o_orderpriority", "o_orderstatus"], F.col("y"))
    return evaluate(rows, got.policy, "lenient").filter("not allow").select("o_orderkey")


@query("SELECT event_id, concat_ws(',', CASE WHEN event_type IN ('purchase', 'signup') THEN 'bill' END, CASE WHEN value >= 60 THEN 'notify' END) AS actions FROM events")
def learn_fanout(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("wanted", F.array_compact(F.array(F.when(F.col("value") >= 60, "notify"), F.when(F.col("event_type").isin("purchase", "signup"), "bill"))))
    got = learn.learn_fan_out(rows, ["value", "event_type"], "wanted")
    return evaluate(rows, got.policy, "lenient").select("event_id", F.array_join(F.array_sort("actions"), ",").alias("actions"))


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9_''\\-]+')"
_N_GRAMS = " || ".join("[array_to_string(w[i : i + %d], ' ') for i in range(1, greatest(len(w) - %d, 0) + 1)]" % (n - 1, n - 1) for n in (2, 3, 4))
_GRAMS = f"SELECT doc_id, toxic, unnest(list_distinct({_N_GRAMS})) AS phrase FROM (SELECT doc_id, toxic, {_WORDS} AS w FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL) WHERE len(w) > 1"


@query(f"SELECT phrase, count(*) FILTER (WHERE toxic = 1) AS pos, count(*) FILTER (WHERE toxic = 0) AS neg FROM ({_GRAMS}) GROUP BY phrase")
def ngram_mining(spark, sf_dir):
    return mining.phrase_counts(_labelled(spark, sf_dir), F.col("text"), F.col("toxic") == 1)


@query(f"SELECT phrase, pos, neg FROM (SELECT phrase, count(*) FILTER (WHERE toxic = 1) AS pos, count(*) FILTER (WHERE toxic = 0) AS neg FROM ({_GRAMS}) GROUP BY phrase) WHERE pos >= 2 ORDER BY pos - neg DESC, neg, pos DESC, length(phrase), phrase LIMIT 50")
def phrase_rank(spark, sf_dir):
    return mining.best_phrases(_labelled(spark, sf_dir), F.col("text"), F.col("toxic") == 1, 50)


@query("SELECT doc_id, coalesce(regexp_matches(lower(text), '(^|[^a-z0-9])the($|[^a-z0-9])'), false) AS has_the, coalesce(contains(lower(text), '%%%'), false) AS has_junk FROM documents")
def signal_flags_exact(spark, sf_dir):
    flag = lambda p: F.coalesce(text.contains_phrase(F.col("text"), p), F.lit(False))
    return table(spark, sf_dir, "documents").select("doc_id", flag("the").alias("has_the"), flag("%%%").alias("has_junk"))


SIGNALS = {"asks_help": ["can you __gap__ help", "please"], "quoted_order": ["__quoted__ ignore", "ignore the above"], "mentions_tool": ["run the tool", "call __near__ function"]}


@query()
def guardrails_observer(spark, sf_dir):
    turns = text.signal_flags(table(spark, sf_dir, "conversations"), ["text"], SIGNALS, "cues")
    flags = [F.col(n) for n in SIGNALS]
    return turns.select("conv_id", "turn", *SIGNALS, text.attack_confidence(flags[1:], F.col("cues"), F.col("mentions_tool"), F.col("asks_help")).alias("confidence"))


@query("SELECT conv_id, string_agg('[Turn ' || turn || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text NULLS FIRST) AS prompt FROM conversations GROUP BY conv_id")
def multi_turn_prompt(spark, sf_dir):
    return readers.render_turns(table(spark, sf_dir, "conversations"))


@query("SELECT page_id, CASE WHEN contains(u, 'select ') OR contains(u, '/en/') THEN 'english' WHEN contains(u, 'page=') THEN 'paged' WHEN contains(u, '.net/') THEN 'net' ELSE 'other' END AS family FROM (SELECT page_id, lower(coalesce(url, '')) AS u FROM pages)")
def waf_classify(spark, sf_dir):
    families = [("english", ["select ", "/en/"]), ("paged", ["page="]), ("net", [".net/"])]
    return table(spark, sf_dir, "pages").select("page_id", text.marker_cascade([F.coalesce(F.col("url"), F.lit(""))], families, "other").alias("family"))


@query("SELECT doc_id, (toxic = 1) AND ((n_chars > 500) OR (lang = 'en')) AND (quality = 1) AS denied FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL")
def trace_projection(spark, sf_dir):
    rows = _labelled(spark, sf_dir).filter("lang is not null")
    rows = text.declared(rows.withColumn("long", F.col("n_chars") > 500), [{"feature": "english", "op": "field_equals", "field": "lang", "value": "en"}, {"feature": "any_of", "op": "feature_any_true", "features": ["long", "english"]}, {"feature": "bad", "op": "field_in_set", "field": "toxic", "values": [1]}, {"feature": "good", "op": "field_equals", "field": "quality", "value": 1}, {"feature": "denied", "op": "feature_all_true", "features": ["bad", "any_of", "good"]}])
    return rows.select("doc_id", "denied")


@query("SELECT * FROM (VALUES ('bulk_discount', 'bulk_discount', 'same'), ('top_tax_or_tiny_return', 'top_tax_or_tiny_return', 'semantic_change'), ('no_plain_discount', 'plain', 'renamed'), ('odd_tax', NULL, 'removed'), (NULL, 'fresh', 'added')) AS t(rule_id, new_id, change)")
def rule_diff(spark, sf_dir):
    r = LINE.rules
    new = Gate("line", LINE_FEATURES, (r[0], Rule(r[1].id, leaf("l_tax", ">", 0.07), 1), Rule("plain", {"all": list(reversed(r[2].when["all"]))}, 2), Rule("fresh", leaf("l_quantity", "<", 3), 3)))
    return compare.rule_diff(compare.rule_table(spark, LINE), compare.rule_table(spark, new))


@query("SELECT count(*) FILTER (WHERE p IS NULL) AS added, count(*) FILTER (WHERE l IS NULL) AS removed, count(*) FILTER (WHERE p IS NOT NULL AND l IS NOT NULL) AS common FROM (SELECT DISTINCT p_partkey AS p FROM part WHERE p_size < 25) FULL JOIN (SELECT DISTINCT l_partkey AS l FROM lineitem WHERE l_quantity > 30) ON p = l")
def set_ops(spark, sf_dir):
    return metrics.set_difference(table(spark, sf_dir, "part").filter("p_size < 25").select("p_partkey"), table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select("l_partkey"))


@query("SELECT * FROM (VALUES ('exact', 'true', 'true'), ('narrow', 'false', 'true')) AS t(gate, complete, sound)")
def verify_spec(spark, sf_dir):
    features = (Feature("q", "float", min=0.0, max=100.0), Feature("vip", "bool"))
    spec = {"all": [leaf("q", ">", 40), leaf("vip", "==", False)]}
    gates = {"exact": Gate("g", features, (Rule("a", spec, 0),)), "narrow": Gate("g", features, (Rule("a", {"all": [leaf("q", ">", 50), leaf("vip", "==", False)]}, 0),))}
    rows = [(n, *[str(v).lower() for v in (got["complete"], got["sound"])]) for n, g in gates.items() for got in [compare.verify(spark, g, spec)]]
    return spark.createDataFrame(rows, "gate string, complete string, sound string")


def _shared(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir; a local one only if that is unset and the session is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{named or tempfile.mkdtemp()}/stream-{uuid.uuid4().hex}"


@query(f"SELECT event_id, CAST(CASE WHEN {_FAN['page']} THEN 1 ELSE 0 END + CASE WHEN {_FAN['notify']} THEN 2 ELSE 0 END AS BIGINT) AS mask FROM events")
def stream_gate_scores(spark, sf_dir):
    gate = Gate("events", EVENT_FEATURES, tuple(Rule(g.id, g.rules[0].when, i) for i, (_, g) in enumerate(FAN.gates[:2])))
    source = table(spark, sf_dir, "events")
    stream = score.read(spark, f"{sf_dir}/events.parquet*", source._jdf.schema().toDDL())
    folder = _shared(spark)
    score.run_available(score.scores(stream, gate).select("event_id", F.col("mask")[0].alias("mask")), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS rows, count(*) FILTER (WHERE value > 50) AS denied FROM events GROUP BY 1")
def windowed_rates(spark, sf_dir):
    return score.windowed_rates(table(spark, sf_dir, "events"), "ts", F.col("value") > 50).select("start", "rows", "denied")


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS rows, count(*) FILTER (WHERE value > 50) AS denied FROM events GROUP BY 1 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_rates(spark, sf_dir):
    """Rates by window of a stream of files: a window comes out once the watermark has passed it."""
    source = table(spark, sf_dir, "events")
    stream = score.read(spark, f"{sf_dir}/events.parquet*", source._jdf.schema().toDDL())
    folder = _shared(spark)
    score.run_available(score.windowed_rates(stream, "ts", F.col("value") > 50), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("start", "rows", "denied")


@query("SELECT start, abs(denied / rows - 0.5) > 0.15 AS drifted FROM (SELECT date_trunc('hour', ts) AS start, count(*) AS rows, count(*) FILTER (WHERE value > 50) AS denied FROM events GROUP BY 1)")
def stream_drift(spark, sf_dir):
    rates = score.windowed_rates(table(spark, sf_dir, "events"), "ts", F.col("value") > 50)
    return score.drift_from(rates, 0.5).select("start", "drifted")


@query(f"SELECT o_orderkey, CASE WHEN {_O[1]} THEN 'review' ELSE 'none' END AS action FROM orders")
def action_no_match(spark, sf_dir):
    policy = ActionPolicy("route", ORDER_FEATURES, (Rule("large", leaf("o_totalprice", ">", 200000), 0, "review"),), "hold", "none")
    return evaluate(table(spark, sf_dir, "orders"), policy).select("o_orderkey", "action")


@query("SELECT event_id, value > 50 AS denied, event_type AS kind FROM events")
def json_path_project(spark, sf_dir):
    """Paths of named fields into a nested row, as a staged policy's inputs and output."""
    gate = Gate("g", (Feature("v", "float"),), (Rule("high", leaf("v", ">", 50), 0),))
    staged = Staged("s", (Stage("one", gate, {"v": "$.event.reading.value"}, {"ok": "$.allow"}),), {"ok": "@one.ok", "kind": "$.event.kind"})
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(F.struct("value").alias("reading"), F.col("event_type").alias("kind")).alias("event"))
    return evaluate(rows, staged).select("event_id", (~F.col("ok")).alias("denied"), "kind")


_LOOSE = Gate("loose", LINE_FEATURES, LINE.rules[:1])


@query(f"""SELECT probe, count(*) FILTER (WHERE hit) AS matched, count(*) FILTER (WHERE hit AND y AND NOT {_R0}) AS fixed, count(*) FILTER (WHERE hit AND NOT y AND NOT {_R0}) AS introduced FROM (
SELECT *, l_returnflag = 'R' AS y, CASE probe WHEN 'tax' THEN abs(l_tax - 0.08) < {EPS} ELSE l_returnflag IN ('R') AND l_quantity <= 2 END AS hit FROM lineitem, (VALUES ('tax'), ('tiny')) AS p(probe)) GROUP BY probe""")
def probe_validation(spark, sf_dir):
    probes = {"tax": leaf("l_tax", "==", 0.08), "tiny": {"all": [leaf("l_returnflag", "in", ["R"]), leaf("l_quantity", "<=", 2)]}}
    return compare.validate_probes(table(spark, sf_dir, "lineitem"), _LOOSE, F.col("l_returnflag") == "R", probes).select("probe", "matched", "fixed", "introduced")


@query(f"SELECT o_orderkey, expected, predicted FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'review' ELSE 'hold' END AS expected, CASE WHEN {_O[0]} THEN 'expedite' WHEN {_O[1]} OR {_O[2]} THEN 'review' WHEN {_O[3]} THEN 'archive' ELSE 'hold' END AS predicted FROM orders) WHERE expected <> predicted")
def action_conflict_report(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("label", F.expr("CASE WHEN o_totalprice > 150000 THEN 'review' ELSE 'hold' END"))
    got = compare.action_conflicts(rows, ActionPolicy("route", (*ORDER_FEATURES, Feature("o_orderkey", "int")), ORDER_RULES, "hold"), "label")
    return got.select("o_orderkey", "expected", "predicted")


@query("SELECT event_id, CASE WHEN value > 50 THEN 'denied' ELSE 'allowed' END AS hot, CASE WHEN starts_with(event_type, 'p') THEN 'denied' ELSE 'allowed' END AS paid FROM events")
def trace_tables(spark, sf_dir):
    kind = observe.Observed("event_type", "string", ("eq", "in", "contains", "startswith"))
    value = observe.Observed("value", "number", ("gt", "lte"))
    targets = {"hot": observe.observed(value, "gt", 50), "paid": observe.observed(kind, "startswith", "p")}
    return observe.trace_tables(table(spark, sf_dir, "events"), ["event_id"], targets)["multi_target"]


_CUES = text.Cues(override=("ignore all", "forget the"), system_prompt=("system prompt",), secrets=("password", "secret key"), tool=("run the tool",), document=("the document says",), benign=("how do i", "what is"))
_HAS = lambda *phrases: " + ".join(f"CAST(regexp_matches(t, '(^|[^a-z0-9]){p}($|[^a-z0-9])') AS INT)" for p in phrases)
_CASES = "SELECT * FROM (VALUES (1, 'Please ignore all of it', NULL, NULL), (2, 'What is the system prompt and the password?', 'shell', NULL), (3, 'How do I bake bread', NULL, NULL), (4, 'Run the tool, ignore all', 'shell', NULL), (5, NULL, NULL, 'elsewhere'), (6, 'The document says: secret key', 'none', 'here')) AS c(id, prompt, tool, scope)"


@query(f"""SELECT id, o > 0 AS requests_instruction_override, y > 0 AS targets_system_prompt, x > 0 AS requests_secret_exfiltration, u > 0 AS requests_tool_misuse, a > 0 AS requests_data_access_outside_scope, d > 0 AS contains_indirect_document_authority,
 b > 0 AND n = 0 AS is_likely_benign_question, round(100 * least(1.0, CASE WHEN b > 0 AND n = 0 THEN 0.02 ELSE 0.02 + 0.14 * n + 0.03 * least(6, o + y + x + u + a + d) + CASE WHEN u > 0 AND tool IN ('browser', 'filesystem', 'shell') THEN 0.1 ELSE 0 END END)) / 100 AS attack_confidence
FROM (SELECT *, CAST(o > 0 AS INT) + CAST(y > 0 AS INT) + CAST(x > 0 AS INT) + CAST(u > 0 AS INT) + CAST(a > 0 AS INT) + CAST(d > 0 AS INT) AS n FROM (
SELECT id, tool, {_HAS('ignore all', 'forget the')} AS o, {_HAS('system prompt')} AS y, {_HAS('password', 'secret key')} AS x, {_HAS('run the tool')} AS u, CAST(coalesce(scope, '') = 'elsewhere' AS INT) AS a, {_HAS('the document says')} AS d, {_HAS('how do i', 'what is')} AS b
FROM (SELECT id, tool, scope, lower(coalesce(prompt, '')) AS t FROM ({_CASES}))))""")
def guardrails_signals(spark, sf_dir):
    rows = [(1, "Please ignore all of it", None, None), (2, "What is the system prompt and the password?", "shell", None), (3, "How do I bake bread", None, None), (4, "Run the tool, ignore all", "shell", None), (5, None, None, "elsewhere"), (6, "The document says: secret key", "none", "here")]
    cases = spark.createDataFrame(rows, "id int, prompt string, tool string, scope string")
    cues = text.Cues(**{**_CUES.__dict__, "scopes": ("elsewhere",)})
    return text.guardrails(cases, cues, tool="tool", scope="scope").drop("prompt", "tool", "scope")
