"""Phrase matching: exact phrases at word edges, tolerant words, patterns with operators, and observers built on them.

Whatever built-in functions can say is a Column. The tolerant matcher is an Arrow UDF; phrases are compiled once a worker.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juncture.functions.scalars import round2

GAP, NEAR, DELIMITER, SKIP = 6, 6, 4, 3
# Letters of other alphabets, by the Latin letter that they look like; signs and digits that stand for letters.
LOOKALIKES = {
    "a": "ΑαАаａＡ",
    "e": "ΕεЕеｅＥ",
    "o": "ΟοОоｏＯ",
    "p": "ΡρРрｐＰ",
    "x": "ΧχХхｘＸ",
    "y": "ΥυУуｙＹ",
    "t": "ΤτТтｔＴ",
    "k": "ΚκКкｋＫ",
    "m": "ΜμМмｍＭ",
    "h": "ΝνНнｈＨ",
    "c": "ΣσсСｃＣ",
}
STANDS_FOR = {"@": "a", "4": "a", "$": "s", "5": "s", "0": "o", "1": "i", "!": "i", "3": "e", "7": "t"}
# Words that are no fragments of others.
WHOLE_WORDS = ("a", "an", "and", "for", "how", "its", "not", "now", "the", "this", "that", "why")
_FOLD = str.maketrans({x: k for k, v in LOOKALIKES.items() for x in v} | STANDS_FOR)
_TOKEN = re.compile(r"[a-z0-9_'\-]+")
_FOLDED, _RUN = re.compile(r"[a-z0-9]+"), re.compile(r"([a-z0-9])\1{2,}")
# Quotes, and what divides a text into parts.
_QUOTES, _DELIMITERS = "\"`“”‘’", "\n\r:;|#>.!?[]{}"


def contains_phrase(c: Column, phrase: str) -> Column:
    """The phrase within lower-cased text; an edge of the phrase that is a letter or digit must be a word's edge."""
    left = r"(?<![a-z0-9])" if re.match("[a-z0-9]", phrase) else ""
    right = r"(?![a-z0-9])" if re.search("[a-z0-9]$", phrase) else ""
    return F.lower(c).rlike(left + re.sub(r"([^A-Za-z0-9 ])", r"\\\1", phrase.lower()) + right)


def words(c: Column) -> Column:
    """Runs of ASCII letters, digits, _ ' and -, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_'\-]+"), F.lit(0))


def words_alike(a: Column, b: Column) -> Column:
    """Equal; or both of 5 or more letters and digits and one begins the other or one edit apart."""
    long = (F.length(a) >= 5) & (F.length(b) >= 5) & a.rlike("^[a-z0-9]+$") & b.rlike("^[a-z0-9]+$")
    return (a == b) | (long & (a.startswith(b) | b.startswith(a) | (F.levenshtein(a, b, 1) >= 0)))


def alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or not (a.isalnum() and b.isalnum() and a.isascii() and b.isascii()):
        return False
    if a.startswith(b) or b.startswith(a):
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


#: Words repeat from text to text: of each phrase word the tokens seen, and those of them that are alike; so many are remembered.
_SEEN: dict[str, tuple[set[str], set[str]]] = {}
_MOST_SEEN = 1 << 16


def folded_tokens(text: str) -> list[str]:
    """Runs of letters and digits once look-alikes are folded, runs of one character cut to two."""
    # a token is letters and digits alone, so runs can be cut before the text is divided
    return _FOLDED.findall(_RUN.sub(r"\1\1", text.translate(_FOLD).lower()))


def merge_fragments(tokens: list[str]) -> list[str]:
    """A run of six or more single letters, and three or else two short pieces (2 to 4 letters, six in all, none a whole word of
    its own), become one token in their place."""
    short = [2 <= len(p) <= 4 and p.isalpha() and p not in WHOLE_WORDS for p in tokens]
    out, i = [], 0
    while i < len(tokens):
        width = 0
        if short[i]:
            width = next((n for n in (3, 2) if i + n <= len(tokens) and all(short[i : i + n]) and sum(map(len, tokens[i : i + n])) >= 6), 0)
        elif len(tokens[i]) == 1:
            j = i
            while j < len(tokens) and len(tokens[j]) == 1 and tokens[j].isalpha():
                j += 1
            width = j - i if j - i >= 6 else 0
        out.append("".join(tokens[i : i + width]) if width else tokens[i])
        i += width or 1
    return out


@dataclass(frozen=True)
class Text:
    """A lower-cased text, its tokens, where delimiters fall between them, and which tokens are quoted."""

    raw: str
    tokens: tuple[str, ...]
    breaks: tuple[int, ...]
    quoted: tuple[tuple[int, int], ...]

    @cached_property
    def folded(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """The folded tokens as they are, and with fragments merged."""
        plain = folded_tokens(self.raw)
        return tuple(plain), tuple(merge_fragments(plain))

    @classmethod
    def of(cls, text: str | None) -> Text:
        raw = (text or "").lower()
        found = list(_TOKEN.finditer(raw))
        starts = [m.start() for m in found]
        place = lambda at: bisect_left(starts, at)
        breaks = sorted({place(i) for i, ch in enumerate(raw) if ch in _DELIMITERS})
        marks = [i for i, ch in enumerate(raw) if ch in _QUOTES]
        quoted = tuple((place(a), place(b)) for a, b in zip(marks[::2], marks[1::2], strict=False))
        return cls(raw, tuple(m[0] for m in found), tuple(breaks), quoted)


def _kin(tokens: tuple[str, ...], phrase: tuple[str, ...]) -> list[set[str]]:
    """For each word of the phrase the tokens that are alike; empty if a word has none."""
    different, out = set(tokens), []
    for w in phrase:
        seen, kin = _SEEN.get(w) or (set(), set())
        fresh = different - seen
        if fresh:
            if w not in _SEEN and len(_SEEN) >= 4096:
                _SEEN.clear()
            if len(seen) > _MOST_SEEN:
                seen, kin, fresh = set(), set(), different
            seen |= fresh
            kin |= {t for t in fresh if alike(t, w)}
            _SEEN[w] = (seen, kin)
        here = different & kin
        if not here:
            return []
        out.append(here)
    return out


def _spans(tokens: tuple[str, ...], phrase: tuple[str, ...]) -> list[tuple[int, int]]:
    n, kin = len(phrase), _kin(tokens, phrase)
    return [(i, i + n) for i in range(len(tokens) - n + 1) if all(tokens[i + k] in kin[k] for k in range(n))] if kin else []


def in_order(tokens: tuple[str, ...], phrase: tuple[str, ...], skip: int = SKIP) -> bool:
    """The phrase's words in order with at most `skip` other tokens among them, all together."""
    kin = _kin(tokens, phrase)
    for start in range(len(tokens) if kin else 0):
        if tokens[start] not in kin[0]:
            continue
        at, left = 0, skip
        for i in range(start, len(tokens)):
            if tokens[i] in kin[at]:
                at += 1
                if at == len(phrase):
                    return True
            elif left:
                left -= 1
            else:
                break
    return False


@lru_cache(maxsize=4096)
def _compiled(phrase: str) -> tuple:
    parts = re.split(r"\s*(__gap__|__and__|__near__|__after_delim__|__before_delim__|__quoted__)\s*", phrase.lower().strip())
    return tuple(p if p.startswith("__") else tuple(_TOKEN.findall(p)) for p in parts)


def matches(text: Text, phrase: str) -> bool:
    """Exact at word edges, by tolerant words, by a pattern's operators, or folded and in order."""
    parts = _compiled(phrase)
    if len(parts) == 1:
        p = re.escape(phrase.lower())
        exact = (r"(?<![a-z0-9])" if phrase[:1].isalnum() else "") + p + (r"(?![a-z0-9])" if phrase[-1:].isalnum() else "")
        if re.search(exact, text.raw) or _spans(text.tokens, parts[0]):
            return True
        wanted = tuple(f for t in parts[0] for f in folded_tokens(t))
        return any(in_order(tokens, wanted) for tokens in text.folded)
    left, op, right = parts[0], parts[1], parts[2] if len(parts) > 2 else ()
    if op == "__quoted__":
        return any(a <= s and e <= b for s, e in _spans(text.tokens, right or left) for a, b in text.quoted)
    if op == "__after_delim__":
        return any(0 <= s - b <= DELIMITER for s, _ in _spans(text.tokens, right or left) for b in text.breaks)
    if op == "__before_delim__":
        return any(0 <= b - e <= DELIMITER for _, e in _spans(text.tokens, left or right) for b in text.breaks)
    a, b = _spans(text.tokens, left), _spans(text.tokens, right)
    if op == "__and__":
        return bool(a and b)
    if op == "__near__":
        return any(max(x[0], y[0]) - min(x[1], y[1]) <= NEAR for x in a for y in b)
    return any(0 <= y[0] - x[1] <= GAP for x in a for y in b)


def phrase_count(c: Column, phrases: list[str]) -> Column:
    """How many of the phrases match; null text counts as empty."""
    held = tuple(phrases)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sum(matches(t, p) for p in held) for t in map(Text.of, texts)], dtype="int32")

    return count(c)


def signal_flags(df: DataFrame, texts: list[str], signals: dict[str, list[str]], cues: str | None = None) -> DataFrame:
    """A boolean column for each signal: whether a text column matches one of its phrases; `cues` names a column for how many of
    all the phrases match. One pass of one UDF."""
    names, phrases = list(signals), [tuple(v) for v in signals.values()]

    def found(ts: list[Text]) -> list[int]:
        if cues is None:
            return [int(any(matches(t, p) for t in ts for p in ps)) for ps in phrases]
        counts = [sum(any(matches(t, p) for t in ts) for p in ps) for ps in phrases]
        return [*(int(c > 0) for c in counts), sum(counts)]

    @F.pandas_udf("array<int>")
    def flags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([found([Text.of(x) for x in row]) for row in batch])

    out = df.withColumn("_flags", flags(F.array(*[F.coalesce(F.col(t), F.lit("")) for t in texts])))
    made = {n: F.col("_flags")[i] == 1 for i, n in enumerate(names)} | ({cues: F.col("_flags")[len(names)]} if cues else {})
    return out.withColumns(made).drop("_flags")


@dataclass(frozen=True)
class Cues:
    """What a guardrails observer looks for: phrases by signal, and the values that count without any phrase."""

    override: tuple[str, ...] = ()
    system_prompt: tuple[str, ...] = ()
    secrets: tuple[str, ...] = ()
    tool: tuple[str, ...] = ()
    outside_scope: tuple[str, ...] = ()
    document: tuple[str, ...] = ()
    benign: tuple[str, ...] = ()
    tool_actions: tuple[str, ...] = ()
    tool_resources: tuple[str, ...] = ()
    sensitive_actions: tuple[str, ...] = ()
    scopes: tuple[str, ...] = ()


#: Tools whose misuse weighs more.
RISKY_TOOLS = ("browser", "filesystem", "shell")
_OBSERVED = {"override": "requests_instruction_override", "system_prompt": "targets_system_prompt", "secrets": "requests_secret_exfiltration", "tool": "requests_tool_misuse", "outside_scope": "requests_data_access_outside_scope", "document": "contains_indirect_document_authority"}


def guardrails(df: DataFrame, cues: Cues, prompt: str = "prompt", action: str | None = None, tool: str | None = None, scope: str | None = None, document: str | None = None) -> DataFrame:
    """`df` with the six signals of an attack, is_likely_benign_question (a benign phrase and none of the six) and
    attack_confidence. Columns that are not named, nulls and missing values count as empty or false.

    One UDF counts the matching phrases of each kind; everything else is a Column. A tool term with a sensitive resource, a
    sensitive action, a scope outside and instructions in a document count as one match each.
    """
    lists = [cues.override, cues.system_prompt, cues.secrets, cues.tool, cues.outside_scope, cues.document, cues.benign, cues.tool_actions, cues.tool_resources]

    @F.pandas_udf("array<int>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[sum(matches(t, p) for p in held) for held in lists] for t in map(Text.of, texts)])

    plain = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) if c else F.lit("")
    n = [F.col("_counts")[i] for i in range(len(lists))]
    among = lambda c, values: plain(c).isin(*values).cast("int") if values else F.lit(0)
    counts = dict(zip(_OBSERVED, n, strict=False))
    counts["tool"] = n[3] + ((n[7] > 0) & (n[8] > 0)).cast("int") + among(action, cues.sensitive_actions)
    counts["outside_scope"] = n[4] + among(scope, cues.scopes)
    counts["document"] = n[5] + (F.coalesce(F.col(document), F.lit(False)).cast("int") if document else F.lit(0))
    signals = {_OBSERVED[k]: c > 0 for k, c in counts.items()}
    none = ~F.greatest(*signals.values()) if len(signals) > 1 else ~next(iter(signals.values()))
    total = sum(list(counts.values())[1:], counts["override"])
    out = df.withColumn("_counts", count(F.coalesce(F.col(prompt), F.lit("")))).withColumns({**signals, "_total": total, "is_likely_benign_question": (n[6] > 0) & none})
    risky = plain(tool).isin(*RISKY_TOOLS) & F.col(_OBSERVED["tool"])
    return out.withColumn("attack_confidence", attack_confidence([F.col(c) for c in signals], F.col("_total"), risky, F.col("is_likely_benign_question"))).drop("_counts", "_total")


#: Fields of a raw input that an observer of signals reads.
SIGNAL_FIELDS = ("prompt", "message", "text", "content", "input", "query", "description", "body")


def observed_fields(df: DataFrame, fields: tuple[str, ...] = SIGNAL_FIELDS) -> list[str]:
    """The text columns by which a profile of signals is known to fit; none means that it doesn't."""
    types = dict(df.dtypes)
    return [f for f in fields if types.get(f) == "string"]


def attack_confidence(signals: list[Column], cues: Column, tool: Column, benign: Column) -> Column:
    """0.02 + 0.14 a signal + 0.03 a cue (at most 6) + 0.1 for a tool, between 0 and 1, at most 0.1 if benign without a signal."""
    n = sum((s.cast("int") for s in signals[1:]), signals[0].cast("int"))
    raw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.02 + 0.14 * n + 0.03 * F.least(cues, F.lit(6)) + 0.1 * tool.cast("int")))
    return round2(F.when(benign & (n == 0), F.least(raw, F.lit(0.1))).otherwise(raw))


def marker_cascade(texts: list[Column], families: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The first family of which a marker occurs in the texts (lower-cased)."""
    whole = F.lower(F.concat_ws(" ", *texts))
    out = F.lit(otherwise)
    for name, markers in reversed(families):
        out = F.when(whole.rlike("|".join(re.sub(r"([^A-Za-z0-9 ])", r"\\\1", m.lower()) for m in markers)), F.lit(name)).otherwise(out)
    return out


def declared(df: DataFrame, spec: list[dict]) -> DataFrame:
    """Features of a declarative mapping, in order: field_copy, field_equals, field_in_set, feature_all_true, feature_any_true."""
    for one in spec:
        kind = one["op"]
        if kind == "field_copy":
            c = F.col(one["field"])
        elif kind == "field_equals":
            c = F.coalesce(F.col(one["field"]) == one["value"], F.lit(False))
        elif kind == "field_in_set":
            c = F.coalesce(F.col(one["field"]).isin(one["values"]), F.lit(False))
        elif kind in ("feature_all_true", "feature_any_true"):
            c = F.lit(kind == "feature_all_true")
            for f in one["features"]:
                c = (c & F.col(f)) if kind == "feature_all_true" else (c | F.col(f))
        else:
            raise ValueError(f"unknown mapping {kind!r}")
        df = df.withColumn(one["feature"], c)
    return df


def ngrams(tokens: Column, n: int) -> Column:
    """The windows of n tokens, each joined by spaces."""
    last = F.size(tokens) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def skipgrams(tokens: Column, skip: int) -> Column:
    """Pairs of tokens with exactly `skip` between them, as `a __gap__ b`."""
    last = F.size(tokens) - skip - 2
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" __gap__ ", F.get(tokens, i), F.get(tokens, i + skip + 1)))).otherwise(F.array().cast("array<string>"))
