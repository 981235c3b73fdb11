"""Scans and sinks: labelled traces, cases, nested QA, HTTP blocks, audit logs, multi-turn corpora."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from juncture.functions.scalars import boolish, identifier, promote


class SourceError(ValueError):
    """Input that a source can't read as what it should be."""


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .json, .jsonl / .ndjson, .parquet, and CSV for all else."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    return read_json(spark, path) if suffix == "json" else read_jsonl(spark, path) if suffix in ("jsonl", "ndjson") else read_csv(spark, path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header. A blank cell is an error that names its column; each column becomes what all its values are."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").option("inferSchema", False).csv(path)
    blanks = raw.agg(*[F.count_if(F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`")) == "")).alias(str(i)) for i, c in enumerate(raw.columns)]).first()
    found = [c for i, c in enumerate(raw.columns) if blanks[i]]
    if found:
        raise SourceError(f"blank cells in {', '.join(found)}")
    return promote(raw, raw.columns)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, or an object with the list `decision_traces`."""
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    if "decision_traces" in raw.columns:
        raw = raw.select(F.explode("decision_traces").alias("_r")).select("_r.*")
    return flatten(raw)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; blank lines are skipped, a line that can't be parsed is an error."""
    return flatten(spark.read.option("mode", "FAILFAST").json(path))


def flatten(df: DataFrame) -> DataFrame:
    """Objects to `a.b`, lists to `a.0`; by name. Strings are coerced. Nulls and lists of unlike lengths are errors."""

    def walk(c: Column, kind: T.DataType, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(c[f.name], f.dataType, f"{name}.{f.name}" if name else f.name)]
        if isinstance(kind, T.ArrayType):
            low, high = df.agg(F.min(F.size(c)), F.max(F.size(c))).first()
            if not low or low != high:
                raise SourceError(f"lists of {name} have {low} to {high} entries")
            return [x for i in range(high) for x in walk(c[i], kind.elementType, f"{name}.{i}")]
        return [c.alias(name)]

    flat = df.select(*[x for f in df.schema.fields for x in walk(F.col(f"`{f.name}`"), f.dataType, f.name)])
    flat = flat.select(*[F.col(f"`{c}`") for c in sorted(flat.columns)])
    nulls = flat.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(str(i)) for i, c in enumerate(flat.columns)]).first()
    missing = [c for i, c in enumerate(flat.columns) if nulls[i]]
    if missing:
        raise SourceError(f"rows are not alike: {', '.join(missing)} is missing or null in some")
    return promote(flat, [c for c, k in flat.dtypes if k == "string"])


def ensure_rectangular(df: DataFrame, object_column: str) -> list[str]:
    """The one key set of a map column; an error names the keys that some rows lack or add."""
    sets = [set(r[0]) for r in df.select(F.array_sort(F.map_keys(object_column)).alias("k")).distinct().limit(2).collect()]
    if len(sets) > 1:
        raise SourceError(f"keys differ between rows: {sorted(sets[0] ^ sets[1])}")
    return sorted(sets[0]) if sets else []


def select_features(df: DataFrame, label: str, only: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """The feature columns in the loader's order; `only` and `exclude` shut each other out."""
    if only is not None and exclude is not None:
        raise SourceError("give either the features or what to exclude")
    named = only if only is not None else exclude or []
    wrong = [c for c in named if c not in df.columns or c == label]
    if wrong or len(set(named)) < len(named):
        raise SourceError(f"unknown, reserved or repeated columns: {wrong or named}")
    out = [c for c in df.columns if c != label and ((c in named) if only is not None else (c not in named))]
    if not out:
        raise SourceError("no feature is left")
    return out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _n): the lines that aren't blank with their numbers in their file, from 1, however the file is divided among tasks.

    Lines are numbered within each split of a file, and the splits' counts, a table of one row for each, are summed in order.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_f"), F.input_file_block_start().alias("_b"), F.monotonically_increasing_id().alias("_m"))
    from pyspark.sql.window import Window

    splits = lines.groupBy("_f", "_b").agg(F.min("_m").alias("_least"), F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("_f", "_b", "_least", before.alias("_before"))
    out = lines.join(F.broadcast(starts), ["_f", "_b"]).withColumn("_n", F.col("_m") - F.col("_least") + F.col("_before") + 1)
    return out.filter(F.trim("value") != "").select("value", "_n")


CASES = "id string, input string, expected_route string, category string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases: id, input (JSON text), expected_route, category."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    got = text.select(*[F.get_json_object("value", f"$.{c}").alias(c) for c in ("id", "input", "expected_route", "category")])
    if got.filter(F.col("id").isNull() | F.col("expected_route").isNull() | F.col("input").isNull()).limit(1).count():
        raise SourceError("a case lacks its id, input or expected_route")
    return got


def read_synthesis_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases with `prompt` in lower case, an id (`row_000001`... by line), and an optional features map."""
    text = numbered_lines(spark, path)
    at = lambda p: F.get_json_object("value", p)
    return text.select(F.coalesce(at("$.id"), F.format_string("row_%06d", "_n")).alias("id"), F.lower(at("$.input.prompt")).alias("prompt"), at("$.expected_route").alias("expected_route"), F.from_json(at("$.features"), "map<string,string>").alias("features"))


def qa_questions(df: DataFrame) -> DataFrame:
    """data[].paragraphs[].qas[] to (id, question, context, title); nothing there is an error."""
    has_title = "title" in df.schema["data"].dataType.elementType.names
    one = df.select(F.explode("data").alias("d")).select((F.col("d.title") if has_title else F.lit(None).cast("string")).alias("title"), F.explode("d.paragraphs").alias("p"))
    out = one.select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("q")).select(F.col("q.id").alias("id"), F.col("q.question").alias("question"), "context", "title")
    if out.isEmpty():
        raise SourceError("no question found")
    return out


@dataclass(frozen=True)
class Adapter:
    """How rows of a public corpus become cases."""

    id: str
    prompts: tuple[str, ...]
    route: str | None = None
    label: str | None = None
    true_route: str = "deny"
    false_route: str = "allow"
    id_field: str | None = None
    category: str | None = None
    copies: tuple[str, ...] = ()
    static: dict = field(default_factory=dict)
    #: field names by which a row is known
    marks: tuple[str, ...] = ()


def adapt(df: DataFrame, a: Adapter, place: str | None = None) -> DataFrame:
    """Rows to (id, input, expected_route, category): the first prompt that is there, an id from a field or the row's place,
    a fixed or labelled route; copied fields go into input, and static ones over them.

    `place` names a column of the row's number (`numbered_lines` makes one); without it rows are numbered in the order of a
    hash of what they hold, so that the same rows get the same ids again.
    """
    have = [p for p in a.prompts if p in df.columns]
    if not have:
        raise SourceError(f"none of {a.prompts} is a column")
    prompt = F.coalesce(*[F.nullif(F.trim(F.col(p).cast("string")), F.lit("")) for p in have])
    route = F.lit(a.route) if a.label is None else F.when(boolish(F.col(a.label), dict(df.dtypes)[a.label]), a.true_route).otherwise(a.false_route)
    if place is None and not a.id_field:
        df, place = _by_content(df), "_place"
    number = F.format_string("%06d", F.col(place).cast("long")) if place else F.lit(None).cast("string")
    if a.id_field:
        number = F.coalesce(number, F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 16))
    name = F.coalesce(identifier(F.col(a.id_field).cast("string")), number) if a.id_field else number
    entries = [(k, F.lit(str(v))) for k, v in a.static.items()] + [(c, F.col(c).cast("string")) for c in a.copies if c not in a.static and c in df.columns]
    inputs = F.map_from_arrays(F.array(F.lit("prompt"), *[F.lit(k) for k, _ in entries]), F.array(prompt, *[v for _, v in entries]))
    return df.select(F.concat(F.lit(f"{a.id}_"), name).alias("id"), F.to_json(inputs).alias("input"), route.alias("expected_route"), (F.col(a.category).cast("string") if a.category else F.lit(a.id)).alias("category"))


def _by_content(df: DataFrame) -> DataFrame:
    """`df` with _place: 1 for the row of the least hash, and so on; counted within 4096 ranges of the hash and summed over them."""
    from pyspark.sql.window import Window

    hashed = df.withColumn("_h", F.sha2(F.to_json(F.struct(*df.columns)), 256)).withColumn("_r", F.substring("_h", 1, 3))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = hashed.groupBy("_r").agg(F.count("*").alias("_c")).select("_r", before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_r").orderBy("_h"))
    return hashed.withColumn("_nth", nth).join(F.broadcast(starts), "_r").withColumn("_place", F.col("_before") + F.col("_nth")).drop("_h", "_r", "_nth", "_before")


#: Profiles by the shape of their rows; the first whose marks are all there is taken.
ADAPTERS = (
    Adapter("labelled_prompt", ("prompt", "text"), label="label", marks=("prompt", "label")),
    Adapter("labelled_text", ("text",), label="label", marks=("text", "label")),
    Adapter("toxic_chat", ("user_input",), label="toxicity", marks=("user_input", "toxicity")),
    Adapter("jailbreak_goal", ("goal", "behavior"), route="deny", category="category", marks=("goal", "category")),
    Adapter("attack_prompt", ("attack", "jailbreak"), route="deny", marks=("attack",)),
    Adapter("adversarial_prompt", ("adversarial",), route="deny", marks=("adversarial",)),
    Adapter("prompt_injection", ("injection",), route="deny", marks=("injection",)),
    Adapter("benign_instruction", ("instruction",), route="allow", copies=("context",), marks=("instruction", "response")),
    Adapter("question_answer", ("question",), route="allow", copies=("context", "title"), id_field="id", marks=("question", "context")),
    Adapter("dialogue_turn", ("utterance",), route="allow", marks=("utterance",)),
    Adapter("tool_call", ("query",), label="is_attack", copies=("tool",), marks=("query", "is_attack")),
    Adapter("leak_probe", ("user_prompt",), route="deny", copies=("system_prompt",), marks=("user_prompt", "system_prompt")),
    Adapter("policy_case", ("message",), label="violates", marks=("message", "violates")),
    Adapter("http_request", ("request",), label="malicious", marks=("request", "malicious")),
    Adapter("web_form", ("payload",), label="attack_type", marks=("payload",)),
    Adapter("plain_prompt", ("prompt",), route="allow", marks=("prompt",)),
    Adapter("plain_text", ("text",), route="allow", marks=("text",)),
)


def sniff(columns: list[str]) -> Adapter:
    for a in ADAPTERS:
        if set(a.marks) <= set(columns):
            return a
    raise SourceError(f"no known shape has the fields {sorted(columns)}")


def read_yaml_rows(spark: SparkSession, text: str) -> DataFrame:
    """A list of objects in YAML (of a configuration's size: it is read on the driver)."""
    try:
        import yaml
    except ImportError as e:
        raise SourceError("reading YAML needs the yaml package") from e
    rows = yaml.safe_load(text)
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise SourceError("a list of objects is wanted")
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], T.StructType([T.StructField(n, T.StringType()) for n in names]))


def percent_decode(text: str) -> str:
    """`+` to a space, %XX to the character of that byte."""
    return unquote_to_bytes(text.replace("+", " ")).decode("latin-1")


def parse_request(block: str) -> dict:
    """Method, path, headers (names lower-cased), query and body pairs of one request block."""
    head, _, body = block.replace("\r\n", "\n").strip("\n").partition("\n\n")
    first, *rest = head.split("\n")
    method, uri = (first.split(" ") + ["", ""])[:2]
    path, _, query = uri.partition("?")
    pairs = lambda s: {percent_decode(k): percent_decode(v) for k, _, v in (p.partition("=") for p in s.strip().split("&") if p)}
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest if ":" in x)}
    return {"method": method, "path": path, "headers": headers, "query": pairs(query), "body": pairs(body), "raw_request": block}


_REQUEST = "struct<method:string,path:string,headers:map<string,string>,query:map<string,string>,body:map<string,string>,raw_request:string>"


def http_requests(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row for each request block of each text: a block begins with a request line."""
    @F.pandas_udf(_REQUEST)
    def parse(blocks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_request(b) for b in blocks], columns=["method", "path", "headers", "query", "body", "raw_request"])

    blocks = F.split(F.col(column), r"\n(?=(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH) \S+ HTTP/)")
    rest = [c for c in texts.columns if c != column]
    some = texts.select(*rest, F.explode(blocks).alias("_b")).filter(F.trim("_b") != "")
    return some.select(*rest, parse("_b").alias("_r")).select(*rest, "_r.*")


def http_cases(normal: DataFrame, anomalous: DataFrame) -> DataFrame:
    """Cases of two texts of requests: allow and deny, by id."""
    parts = []
    for name, df, route in (("normal", normal, "allow"), ("anomalous", anomalous, "deny")):
        r = http_requests(df)
        parts.append(r.select(F.concat(F.lit(f"{name}_"), F.substring(F.sha2("raw_request", 256), 1, 16)).alias("id"), F.to_json(F.struct("method", "path", "headers", "query", "body")).alias("input"), F.lit(route).alias("expected_route"), F.lit(name).alias("category")))
    return parts[0].unionByName(parts[1])


def read_http_folder(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a folder of request files: normal or anomalous by the file's name; files of neither are left out."""
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).withColumn("_f", F.lower(F.element_at(F.split(F.input_file_name(), "/"), -1)))
    bad = F.col("_f").contains("anomal")
    return http_cases(texts.filter(F.col("_f").contains("normal") & ~bad).select("value"), texts.filter(bad).select("value"))


def read_audit_logs(spark: SparkSession, path: str) -> DataFrame:
    """Transactions of all audit logs below a folder; equal ids of two files stay apart."""
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).withColumn("file", F.input_file_name())
    return audit_transactions(texts)


def audit_transactions(texts: DataFrame, column: str = "value") -> DataFrame:
    """(tx, request, meta, and every other column): the B and H sections of audit logs whose sections begin with `--id-X--`.
    Transactions are told apart by all other columns as well, such as the file that a text comes from."""
    rest = [c for c in texts.columns if c != column]
    parts = F.regexp_extract_all(F.concat(F.col(column), F.lit("\n")), F.lit(r"(?s)--([0-9a-zA-Z]+-[A-Z])--\n(.*?)(?=\n--[0-9a-zA-Z]+-[A-Z]--|\s*$)"), F.lit(0))
    rows = texts.select(*rest, F.explode(parts).alias("s")).select(*rest, F.regexp_extract("s", r"^--([0-9a-zA-Z]+)-", 1).alias("tx"), F.regexp_extract("s", r"^--[0-9a-zA-Z]+-([A-Z])--", 1).alias("k"), F.trim(F.regexp_replace("s", r"^--[^\n]*\n", "")).alias("body"))
    return rows.groupBy(*rest, "tx").agg(F.max(F.when(F.col("k") == "B", F.col("body"))).alias("request"), F.max(F.when(F.col("k") == "H", F.col("body"))).alias("meta"))


def render_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conversation, prompt): `[Turn n]` and the text of each turn in order, a blank line between."""
    listed = turns.groupBy(conversation).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("n"), F.col(text).alias("t")))).alias("_t"))
    said = F.transform("_t", lambda x: F.concat(F.lit("[Turn "), x["n"].cast("string"), F.lit("]\n"), F.coalesce(x["t"], F.lit(""))))
    return listed.select(conversation, F.array_join(said, "\n\n").alias("prompt"))


def merge_cases(parts: list[tuple[str, DataFrame]], rounds: int = 20) -> DataFrame:
    """All cases, ids told apart: the first case of an id keeps it, others get `id__source`, and `__dup2`, `__dup3`... behind that
    where it is taken, by another case of that source or by a case of that very id."""
    from pyspark.sql.window import Window

    rows = None
    for i, (name, df) in enumerate(parts):
        one = df.withColumns({"_source": F.lit(name), "_file": F.lit(i)})
        rows = one if rows is None else rows.unionByName(one)
    order = F.struct("_file", F.coalesce("input", F.lit("")))
    first = F.row_number().over(Window.partitionBy("id").orderBy(order)) == 1
    nth = F.row_number().over(Window.partitionBy("id", "_source").orderBy(order))
    rows = rows.withColumn("_first", first)
    # of one source's cases the first one of an id may have kept it
    kept = F.max(F.col("_first").cast("int")).over(Window.partitionBy("id", "_source"))
    rows = rows.withColumn("_k", F.when(F.col("_first"), 0).otherwise(nth - kept)).withColumn("_id", F.col("id"))
    name = F.when(F.col("_k") == 0, F.col("_id")).when(F.col("_k") == 1, F.concat_ws("__", "_id", "_source")).otherwise(F.concat(F.concat_ws("__", "_id", "_source"), F.lit("__dup"), F.col("_k").cast("string")))
    rows = rows.withColumn("id", name)
    for _ in range(rounds):
        taken = rows.groupBy("id").agg(F.count("*").alias("_n"), F.min("_k").alias("_least")).filter("_n > 1")
        if taken.isEmpty():
            break
        # a made-up id gives way to an own one, and to one made of a shorter id
        clash = rows.join(taken, "id", "left").withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy("_k", F.length("_id"), order)))
        moved = clash.withColumn("_k", F.when(F.col("_n").isNotNull() & (F.col("_nth") > 1) & (F.col("_k") > 0), F.greatest(F.col("_k") + 1, F.lit(2))).otherwise(F.col("_k")))
        rows = moved.withColumn("id", name).drop("_n", "_least", "_nth")
    return rows.drop("_first", "_k", "_id", "_file", "_source")


def write_cases(df: DataFrame, path: str) -> None:
    """JSON lines; input stays JSON text."""
    df.select("id", "input", "expected_route", "category").write.mode("overwrite").json(path)


def write_traces(df: DataFrame, path: str, format: str | None = None) -> None:
    """CSV, JSON lines or one JSON list, by name or suffix."""
    format = format or {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl"}.get(path.rsplit(".", 1)[-1], "csv")
    if format == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif format == "jsonl":
        df.write.mode("overwrite").json(path)
    elif format == "json":
        # one list in one text: written by one task, which holds a row at a time
        def listed(rows: Iterator[Row]) -> Iterator[tuple[str]]:
            before = "["
            for row in rows:
                yield (before + row["j"],)
                before = ","
            yield ("]" if before == "," else "[]",)

        rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("j")).coalesce(1)
        rows.rdd.mapPartitions(listed).toDF("value string").write.mode("overwrite").text(path)
    else:
        raise SourceError(f"unknown format {format!r}")
