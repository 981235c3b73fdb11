"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from juncture.llm import decontaminate, language, lines, mixing, neardup, neighbours, quality, shard, toxicity, urls
from juncture.llm.words import blocks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def words(rng, n, alphabet="abcdefgh"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(n)]


def make_docs(n=120, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = "xy"[i % 2]
        w = words(rng, rng.randint(5, 60), "abcdefgh" if lang == "x" else "mnopqrst")
        if i % 5 == 0:
            w.insert(rng.randint(0, len(w)), "zzvile")
        if i % 7 == 0:
            w = [x + "%%%" for x in w]
        out.append((i, " ".join(w), lang, "s", 1))
    out += [(1000, None, None, None, None), (1001, "", "x", "s", 0), (1002, "  \n ", None, "s", 0), (1003, "1234 !!", "x", "s", 0)]
    out += [(None, out[3][1], "x", "s", 1), (1004, out[4][1], "x", "s", 1), (1004, out[4][1], "x", "s", 1), (1005, " ".join(words(rng, 30000)), "x", "s", 1)]
    base = out[8][1].split()
    for k in range(30):
        changed = list(base) * 4
        changed[k] = "changed"
        out.append((2000 + k, " ".join(changed), "x", "s", 1))
    return out


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(120)] + [(None, 1, 1), (5, None, None)], LABELS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates_match_brute_force(docs, rows):
    got = neardup.near_duplicates(docs.withColumn("rep", F.lit(1)).withColumn("score", F.lit("a"))).collect()
    assert len(got) == len(rows)

    def sets(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    by = {(r[0], r[1]): sets(r[1]) for r in rows if r[0] is not None}
    parent = {k[0]: k[0] for k in by}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = list(by.items())
    for i, (a, s) in enumerate(items):
        for b, t in items[:i]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = find(a[0]), find(b[0])
                parent[max(x, y)] = min(x, y)
    expected = {k[0]: find(k[0]) for k in by}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    shingles = {k[0]: len(v) for k, v in by.items()}
    assert all(r.n_shingles == shingles[r.doc_id] for r in got if r.doc_id is not None)


@pytest.mark.parametrize("turned", [False, True])
def test_near_duplicates_of_rows_that_share_an_id(spark, turned):
    rng = random.Random(6)
    a, b = (" ".join(words(rng, 60)) for _ in range(2))
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (9, "single"), (9, "single"), (None, a)]
    got = neardup.near_duplicates(spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True), (9, 9, True)]


def test_one_of_each_takes_rows_not_ids(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(5, a, "x"), (5, b, "y"), (7, a + " more", "x"), (8, b + " more", "x"), (9, c, "x"), (9, c, "z"), (None, a, "x"), (None, "", "x"), (None, "", "x"), (3, None, "x"), (6, "few words", "x"), (None, "few words", "x")]
    got = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, root string").withColumn("n", F.lit(1)), 85)
    assert got.columns == ["doc_id", "text", "root", "n"]
    assert sorted(((str(r.doc_id), str(r.text)) for r in got.collect())) == sorted([("5", a), ("5", b), ("9", c), ("None", ""), ("None", ""), ("3", "None"), ("6", "few words")])


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty).count() == 0


def test_buckets_that_stars_leave_open(spark):
    """A chain: each text is like its neighbour, few are like the first."""
    rng = random.Random(3)
    base = words(rng, 120)
    rows, text = [], list(base)
    for i in range(12):
        text[i * 10] = f"new{i}"
        rows.append((50 - i, " ".join(text), "x", "s", 1))
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in got} == {39}


def test_chunk_keys_meet_within_the_distance():
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 1 << 16, neardup.HASHES).astype("uint16")
    for _ in range(300):
        other = sig.copy()
        at = rng.choice(neardup.HASHES, neardup.DISTANCE, replace=False)
        other[at] ^= rng.integers(1, 1 << 16, len(at)).astype("uint16")
        keys = neardup.keys(np.stack([sig, other]))
        assert set(keys[0]) & set(keys[1])


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.rep: r.root for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100}


def brute_contamination(rows, items):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for r in rows:
        w, hit, found = tokens(r[1]), set(), set()
        for item, text in items:
            b = tokens(text)
            k = min(10, len(b))
            for s in range(len(b) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == b[s : s + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(item))
        out.append((r[0], len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    common = words(rng, 12, "ab")
    item = [rng.choice(common) for _ in range(25)]
    items = [(1, " ".join(item)), (2, "Short Item"), (3, None), (4, "!!"), (10, " ".join(item[3:20])), (11, "É é the " * 4), (2, "another short")]
    rows = [(i, " ".join(rng.choice(common) for _ in range(60))) for i in range(15)]
    rows += [(20, "..." + " ".join(item).upper() + "!"), (21, " ".join(item[:9])), (22, " ".join(item[:10]) + " x " + " ".join(item[12:24])), (23, None), (24, ""), (25, "a short item, SHORT-ITEM"), (26, "É é the " * 9), (None, " ".join(item)), (20, "no"), (22, " ".join(item[:10]) + " x " + " ".join(item[12:24]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("term", F.lit("a"))
    frame = spark.createDataFrame(items, "item_id long, text string")
    for most in (1_000_000, 0):
        monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
        got = sorted((tuple(r) for r in decontaminate.contamination(docs, frame).collect()), key=str)
        assert got == brute_contamination(rows, items)


def test_contamination_of_and_by_nothing(spark, empty, docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, nothing).count() == 0
    assert decontaminate.contamination(docs.limit(3), nothing).filter("contaminated").count() == 0


def test_clean_drops_rows_not_ids(spark, docs):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, "x " + item), (1, "another text"), (None, item), (None, "clean"), (2, None), (2, None)]
    got = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit("a")), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(1, "another text", "a"), (None, "clean", "a"), (2, None, "a"), (2, None, "a")], "doc_id long, text string, pos string").collect()))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b x c"), (2, "a b c"), (3, "a"), (4, None)], "doc_id long, text string")
    index = decontaminate.postings(docs, "doc_id")
    queries = spark.createDataFrame([(7, ["a", "b", "c"]), (8, ["a", "zz"])], "query_id long, terms array<string>")
    assert [(r.query_id, r.doc_id, r.pos) for r in decontaminate.proximity_matches(index, "doc_id", queries, 4).collect()] == [(7, 2, 0)]
    assert decontaminate.proximity_matches(index, "doc_id", queries, 6).count() == 2


def test_lines_match_brute_force(spark, empty):
    rng = random.Random(4)
    base = [words(rng, rng.randint(1, 25), "abcd") for _ in range(12)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(["new", "other"])
            out.append(" ".join(line))
        rows.append((i, "\n".join(out)))
    rows += [(100 + i, " ".join([*base[0], *words(rng, 2, "xyz")])) for i in range(30)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, " ".join(words(rng, 5000)))]
    got = {r.doc_id: r for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(0))).collect()}
    expected = lines.brute_force(rows)
    for d, text in rows:
        gone = set(expected.get(d, []))
        assert got[d].text == (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
        assert got[d].n_removed == len(gone)
    assert lines.deduplicated(empty).count() == 0


def removed(spark, rows):
    out = defaultdict(int)
    for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out[r.doc_id] += r.n_removed
    return dict(out)


def test_lines_that_come_again(spark, monkeypatch):
    """Few candidates at first, words divided into parts, and everything joined by a shuffle: the same lines go."""
    rng = random.Random(23)
    fillers = words(rng, 40)
    rows = []
    for i in range(160):
        line = [f"group{i % 8}", *(f"t{k}" for k in range(12)), *rng.sample(fillers, 6)]
        rows.append((i, " ".join(line) + ("\n" + " ".join([*rows[i - 40][1].split("\n")[0].split()[1:], "tail"]) if i > 80 else "")))
    expected = lines.brute_force(rows)
    assert expected
    expected = {d: len(expected.get(d, ())) for d, _ in rows}
    assert removed(spark, rows) == expected
    rounds = []
    plain = lines.matched_at_last
    monkeypatch.setattr(lines, "matched_at_last", lambda *a: rounds.append(1) or plain(*a, piece=8))
    monkeypatch.setattr(lines, "FIRST_CANDIDATES", 1)
    monkeypatch.setattr(lines, "CLEAR_CANDIDATES", 1)
    monkeypatch.setattr(lines, "MOST_OF_A_WORD", 8)
    assert removed(spark, rows) == expected and rounds
    monkeypatch.setattr(lines, "MOST_BROADCAST", 0)
    assert removed(spark, rows) == expected


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "other words\nalpha beta gamma delta"), (2, "Alpha  beta gamma delta"), (3, "x y"), (3, "x y"), (3, "x y"), (None, "x y"), (None, "x y")]
    assert removed(spark, rows) == {1: 1, 2: 1, 3: 2, None: 0}
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sorted(r.text for r in got if r.doc_id == 3) == ["", "", "x y"]


def test_a_word_in_most_lines(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(f"the of the {' '.join(words(rng, rng.randint(1, 6), 'abc'))} the" for _ in range(3))) for i in range(150)]
    expected = lines.brute_force(rows)
    assert removed(spark, rows) == {d: len(expected.get(d, ())) for d, _ in rows}


def test_long_lines(spark):
    rng = random.Random(12)
    made = words(rng, 900, "abcdefghij")
    rows = [(i, " ".join(rng.sample(made, rng.choice([40, 90, 190, 400])))) for i in range(60)]
    for i in range(60, 140):
        line = rows[rng.randrange(60)][1].split()
        for _ in range(rng.randint(1, max(1, len(line) // 6))):
            line[rng.randrange(len(line))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(line)))
    expected = lines.brute_force(rows)
    assert 20 < len(expected) < 80
    assert removed(spark, rows) == {d: len(expected.get(d, ())) for d, _ in rows}


def test_many_near_copies_of_a_line(spark):
    rng = random.Random(31)
    base = [f"word{i}" for i in range(30)]
    rows = []
    for i in range(700):
        line = list(base)
        for _ in range(rng.choice([1, 2, 3, 7])):
            line[rng.randrange(30)] = f"other{rng.randrange(2000)}"
        rows.append((1000 - i, " ".join(line)))
    expected = lines.brute_force(rows)
    assert 400 < len(expected) < 700
    assert removed(spark, rows) == {d: len(expected.get(d, ())) for d, _ in rows}


def test_entries_are_packed_and_unpacked():
    rng = np.random.default_rng(5)
    n = 500
    size = rng.integers(4, 400, n)
    e = {"token": np.sort(rng.integers(0, 1 << 40, n)), "doc_id": rng.integers(-(1 << 62), 1 << 62, n), "sub": rng.integers(-(1 << 63), (1 << 63) - 1, n), "shape": (size << 32) | rng.integers(0, 50, n), "split": rng.integers(0, 2, n)}
    for i, c in enumerate(lines._PARITY):
        e[c] = rng.integers(-(1 << 63), (1 << 63) - 1, n) * (size > [0, *np.repeat(lines.WIDER, (1, 2, 4))][i])
    got = lines.unpacked(lines.packed(e))
    assert set(got) == set(e) and all((got[c] == e[c]).all() for c in e)


def test_word_blocks_match_plain_splitting(monkeypatch):
    from juncture.llm import words as hashed

    rng = random.Random(1)
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(" \n\tabAé\r") for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(rng.randint(1, 8))]
        monkeypatch.setattr(hashed, "BLOCK", rng.choice([1, 4, 10, 1 << 20]))
        column = pa.array(["x y", *texts])[1:]
        got = [(int(r), int(k), b.word[s:e].tolist()) for b in hashed.blocks(column) for r, k, s, e in zip(b.row, b.line, b.start, b.start[1:], strict=False)]
        plain = [(i, k, line.split()) for i, t in enumerate(texts) for k, line in enumerate((t or "").encode().lower().split(b"\n"))]
        assert [(r, k, len(w)) for r, k, w in got] == [(r, k, len(w)) for r, k, w in plain]
        names = {}
        for (_, _, a), (_, _, b) in zip(got, plain, strict=True):
            assert all(names.setdefault(w, h) == h for h, w in zip(a, b, strict=True))
        assert len(set(names.values())) == len(names)


def test_quality(docs, labels, rows, empty):
    got = quality.quality_of_documents(docs.withColumn("label", F.lit(3)), labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 120]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == int(r.doc_id % 7 != 0) for r in held) / len(held) >= 0.95
    assert quality.quality_of_documents(empty, labels).count() == 0
    assert {r.score for r in quality.quality_of_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity(docs, labels, rows, empty):
    got = toxicity.toxicity_of_documents(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 120]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) / len(held) >= 0.9
    assert toxicity.toxicity_of_documents(empty, labels).count() == 0
    assert not any(r.predicted for r in toxicity.toxicity_of_documents(docs, labels.limit(0)).collect())


def test_negative_risk_is_reversed():
    """With every confirmed text unlike all unlabelled ones nothing blows up."""
    model = toxicity.fit([np.array([1])] * 20, [np.array([2])] * 50, 0.3, 4)
    assert np.isfinite(model.weights).all() and np.isfinite(model.bias)


def brute_phrases(text, data):
    n = at = 0
    while at < len(data):
        size = 1
        while at + size <= len(data) and data[at : at + size] in text:
            size += 1
        at += max(1, size - 1)
        n += 1
    return n


def test_phrases_match_brute_force():
    rng = random.Random(2)
    texts = tuple((k, " ".join(words(rng, 80, a)).encode()) for k, a in (("x", "abcd"), ("y", "efgh")))
    data = [" ".join(words(rng, n, "abefz")).encode() for n in (1, 5, 40, 170)] + [b""]
    got = language.Parser(texts).phrases(data, segment=4096)
    assert got[:-1].tolist() == [[brute_phrases(t, d) for _, t in texts] for d in data[:-1]]
    assert got[-1].tolist() == [0, 0]


def test_language(docs, rows, empty):
    got = language.languages_of_documents(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und"] * 4
    held = [r for r in got if r.held_out and r.doc_id < 120]
    assert all(r.lang_pred == "xy"[r.doc_id % 2] for r in held) and all(0 <= r.score <= 1 for r in got)
    assert language.languages_of_documents(empty).count() == 0
    assert {r.lang_pred for r in language.languages_of_documents(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_shards(docs, rows, empty):
    got = shard.shard_documents(docs.withColumn("shard", F.lit(0)), 4).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got if r.text_crc32 is not None) == sorted((r[0] or -1, len(r[1].encode()) + 1, zlib.crc32(r[1].encode())) for r in rows if r[1] is not None)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append((r.slot, r["size"]))
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for held in by.values():
        assert sorted(s for s, _ in held) == list(range(len(held)))
        assert abs(sum(b for _, b in held) - total / 4) <= most
    assert shard.shard_documents(empty).count() == 0


def test_hot_groups_are_divided(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    sums = [r.b for r in shard.shard_documents(many, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 3 * 14


def test_range_of_matches_bisection():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 5, 300), rng.integers(0, 50, 300)]
    splits = sorted(set(zip(rng.integers(0, 5, 20).tolist(), rng.integers(0, 50, 20).tolist(), strict=True)))
    got = shard.range_of(keys, [np.array([s[i] for s in splits]) for i in (0, 1)])
    assert got.tolist() == [sum(s <= k for s in splits) for k in zip(keys[0].tolist(), keys[1].tolist(), strict=True)]


def test_urls(spark):
    rows = [(1, "http://a.COM/en/x"), (2, "https://example.com/en/7"), (3, "http://m.example.com/en/71?x#y"), (4, "http://notexample.com/en/7"), (5, None), (6, "no scheme"), (7, "x://net/de/"), (8, "x://w.example.net/de/8"), (9, "x://org?/es/"), (None, "x://org/es/"), (1, "http://a.COM/en/x"), (10, "x://.com/en/"), (11, "")]
    got = sorted(map(tuple, urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))).collect()), key=str)

    def one(page, url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = raw.lower(), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.key), default=None)
        return (page, host, path, best and best.key, best.verdict if best else "allow")

    assert got == sorted((one(*r) for r in rows), key=str)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_a_host_of_many_labels_costs_no_more(spark):
    long = ".".join("a" * 3000)
    rows = [(1, f"http://{long}.com/en/"), (2, f"http://{long}/en/")]
    got = {r.page_id: r.rule for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: "com/en/", 2: None}


def test_shares_of_training_texts():
    assert language.fair_shares([10, 1000, 50], 100) == [10, 45, 45] and language.fair_shares([], 5) == []
    assert sum(language.fair_shares([7, 7, 7], 20)) <= 20


def test_cascade_is_exact_for_the_universe(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.filter(F.crc32("key") % 40 == 0)
    cascade = urls.build_cascade(universe, listed)
    pairs = universe.select("key", *urls.hash_pair(F.col("key"))).toArrow()
    got = {k for k, c in zip(pairs.column("key").to_pylist(), cascade.contains(urls._pairs(pairs)), strict=True) if c}
    assert got == {r.key for r in listed.collect()} and len(cascade.levels) > 1


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(900, 16)).astype("float32")
    v[100:400] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 15 + [None]), (2080, [1.0]), (None, [1.0] * 16), (2100, [])]
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, leaf_size=16).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    hits, d = 0, v.astype("float64")
    for q, found in got.items():
        score = np.einsum("ij,j->i", d, d[q])
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(d)), -score))[:20]
        assert sorted(r for r, _, _ in found) == list(range(1, 21))
        assert all(abs(score[i] - s) < 1e-9 for _, i, s in found)
        assert [i for _, i, _ in sorted(found)] == [i for _, i in sorted((-s, i) for _, i, s in found)]
        hits += len(set(best.tolist()) & {i for _, i, _ in found})
    assert hits / (20 * len(got)) >= 0.9
    for q in range(100, 400, 20):
        assert [i for _, i, _ in sorted(got[q])] == [i for i in range(100, 122) if i != q][:20] or d[q] @ d[q] < (d @ d[q]).max() - 1e-9


def test_ties_go_to_the_smaller_id(spark):
    """400 unlike vectors with one and the same inner product to the query."""
    rng = np.random.default_rng(2)
    rows = [(0, [1.0, *([0.0] * 7)])] + [(i, [1.0, *rng.integers(-9, 9, 7).astype(float).tolist()]) for i in range(1, 401)]
    rng.shuffle(rows)
    rows = [(int(i), [float(c) for c in v]) for i, v in rows]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, share=8.0)
    assert [(r["rank"], r.vec_id) for r in got.orderBy("rank").collect()] == [(i, i) for i in range(1, 21)]


@pytest.mark.parametrize("n", [500, 4000])
def test_recall_of_vectors_without_structure(spark, n):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").withColumn("leaf", F.lit("a"))
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0, cell_rows=1000).collect()}
    scores = v[::20] @ v.T
    scores[np.arange(0, n, 20) // 20, np.arange(0, n, 20)] = -9
    true = {(q * 20, int(i)) for q, row in enumerate(scores) for i in np.argsort(-row)[:20]}
    assert len(got & true) >= 0.9 * len(true)


def test_large_leaves_are_read_in_pieces(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 8))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0, share=9.0, leaf_size=200, cell_rows=60, block_rows=10).collect()}
    scores = v[::20] @ v.T
    scores[np.arange(0, 600, 20) // 20, np.arange(0, 600, 20)] = -np.inf
    assert got == {(q * 20, int(i)) for q, row in enumerate(scores) for i in np.argsort(-row)[:20]}


def test_few_neighbours(spark):
    got = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    assert sorted((r["rank"], r.vec_id) for r in got.collect()) == [(1, 2), (2, 1)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_mixing_meets_its_targets(docs, labels, rows, empty):
    targets = {"clean": 0.6, "junk": 0.2, "toxic": 0.2}
    got = mixing.mixed(docs, labels, targets).collect()
    assert len(got) == len(rows)
    total = sum(r.tokens for r in got)
    for d, t in targets.items():
        assert abs(sum(r.tokens * r.rate * r[f"p_{d}"] for r in got) / total - t) < 1e-3
    assert all(r.rate >= 0 and abs(r.p_clean + r.p_junk + r.p_toxic - 1) < 1e-9 for r in got)
    assert {r.doc_id: r.tokens for r in got}[1000] == 0
    assert mixing.mixed(empty, labels, targets).count() == 0


@pytest.mark.parametrize(("share", "steps"), [({"a": 0.97, "b": 0.02, "c": 0.01}, 200), ({"a": 0.3, "b": 0.3, "c": 0.4}, 20000), ({"a": 0.5, "b": 0.49, "c": 0.01}, 20000)])
def test_rates_are_as_good_as_a_long_dense_descent(spark, share, steps):
    """The first targets can't be met: the fit must be as good as the most steps that it may take of the plain descent."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 40)
    tokens = rng.integers(1, 100, 40)
    df = spark.createDataFrame([(i, int(t), 1, *map(float, x)) for i, (t, x) in enumerate(zip(tokens, p, strict=True))], "i long, tokens long, _rows long, p_a double, p_b double, p_c double")
    got = {r.i: r.rate for r in mixing.fit_rates(df, share).collect()}
    total, x, t = tokens.sum(), np.ones(40), np.array(list(share.values()))
    mass = (p * tokens[:, None]).sum(axis=0) / total
    scale = np.maximum(mass, 1e-3 * t)
    totals = lambda x: (p * (tokens * x)[:, None]).sum(axis=0) / total
    for _ in range(steps):
        x = np.maximum(0, x - p @ ((totals(x) - t) / scale))
    mine = np.array([got[i] for i in range(40)])
    error = lambda x: ((totals(x) - t) ** 2 / scale).sum()
    assert (mine >= 0).all() and error(mine) <= 1.01 * error(x) + 1e-9


def test_resampled_totals_meet_the_targets(spark, docs, labels):
    docs = docs.filter("doc_id < 1000")  # without the one text that holds most tokens
    targets = {"clean": 0.6, "toxic": 0.4}
    rates = {r.doc_id: r for r in mixing.mixed(docs, labels, targets, reference="clean").collect()}
    out = mixing.resample(docs, labels, targets, reference="clean")
    assert out.columns == docs.columns
    times = defaultdict(int)
    for r in out.select("doc_id").collect():
        times[r.doc_id] += 1
    assert all(np.floor(r.rate) <= times[i] <= np.ceil(r.rate) for i, r in rates.items())
    for d in targets:
        wanted = sum(r.tokens * r.rate * r[f"p_{d}"] for r in rates.values())
        spread = sum((r.tokens * r[f"p_{d}"]) ** 2 * (r.rate % 1) * (1 - r.rate % 1) for r in rates.values()) ** 0.5
        assert abs(sum(r.tokens * times[i] * r[f"p_{d}"] for i, r in rates.items()) - wanted) <= 4 * spread + 1


def test_targets_that_cannot_be_met_are_told(spark):
    df = spark.createDataFrame([(1, 10, 1, 1.0, 0.0), (2, 20, 1, 1.0, 0.0)], "i long, tokens long, _rows long, p_a double, p_b double")
    with pytest.warns(mixing.Unmet):
        mixing.fit_rates(df, {"a": 0.5, "b": 0.5})


def test_posteriors_match_naive_bayes(spark, docs, labels, rows):
    """The classifier, counted again in Python from the model's own terms."""
    domains = ["clean", "junk", "toxic"]
    model = mixing.train(docs, labels, domains)
    weights = {r.term: np.array(r.w) for r in model.collect()}
    got = {(r.doc_id, r.tokens): r for r in mixing.posteriors(docs, model, domains).collect()}
    for i, text, *_ in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        have = set(w) | {x for x in re.split(r"[^!-/:-@\[-`{-~]+", text or "") if x} | {"#doc", f"#r{len(set(w)) * 20 // len(w)}" if len(w) >= 20 else "#r"}
        total = sum((weights[t] for t in have if t in weights), np.zeros(3))
        p = np.exp(total - total.max())
        p /= p.sum()
        r = got[(i, len(w))]
        assert np.allclose([r.p_clean, r.p_junk, r.p_toxic], p)
    assert {"zzvile", "%%%", "#doc"} <= set(weights)


def test_the_vote_matches_brute_force():
    rng = np.random.default_rng(7)
    made = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(60)]
    texts = [" ".join(rng.choice(made, rng.integers(3, 30))) + ("!?" * int(i % 2)) for i in range(90)]
    vocabulary = np.unique(np.concatenate([b.word for b in blocks(pa.array(texts[:20]))]))
    x = quality.features(pa.array(texts), vocabulary)
    assert x[:, quality.PLAIN - 1].tolist() == [len(t.split()) for t in texts]
    assert x[:, quality.PLAIN - 2].tolist() == [len(t.split()) - len(set(t.split())) for t in texts]
    assert x[:, quality.PLAIN - 3].tolist() == [sum(a == b for a, b in zip(t.split(), t.split()[1:])) for t in texts]
    model = quality.Neighbours.fit(x[:60], np.arange(60) % 2, vocabulary, rank=20, k=7)
    got = model.score(x, block=13)
    v = model.weigh(x) @ model.projection
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(len(x)):
        cosine = model.vectors @ v[i]
        near = sorted(range(60), key=lambda j: (-cosine[j], j))[:7]
        weight = np.maximum(cosine[near].astype("float64"), 0) ** 4
        assert abs(got[i] - (weight * (np.array(near) % 2)).sum() / weight.sum()) < 1e-4
    cosine = np.array([[1.0, 0.5, 0.5, 0.5, 0.2]])
    assert sorted(quality.nearest(cosine, 2)[0]) == [0, 1]


def test_words_alone_can_be_learned(spark):
    """Two classes whose texts differ in their vocabulary and in no sign, length or repeat."""
    rng = random.Random(3)
    good, bad = (sorted({"".join(rng.choice("aeiou") if k % 2 else rng.choice("bcdfgh") for k in range(6)) for _ in range(50)}) for _ in range(2))
    rows = [(i, " ".join(rng.sample(good if i % 2 else bad, 12))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    held = [r for r in quality.quality_of_documents(docs, labels).collect() if r.held_out]
    assert len(held) > 60 and sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (1, None), (2, "e f"), (None, "g")], "doc_id long, text string")
    ids = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, _y int")
    from juncture.llm.common import bounded_sample, one_text_each

    got = one_text_each(docs, ids, "_y").collect()
    assert sorted(r._y for r in got) == [0, 1] and all(r.text for r in got)
    many = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"))
    counts = {r._stratum: r["count"] for r in bounded_sample(many, F.col("s"), F.col("k"), 20).groupBy("_stratum").count().collect()}
    assert counts == {"0": 20, "1": 20, "2": 20}


def test_risk_gradient_matches_finite_differences():
    """The steps of `fit` follow the non-negative risk: at its end no small move of a used weight or the bias lowers it much."""
    rng = np.random.default_rng(9)
    positive = [np.unique(np.append(rng.integers(8, 16, 3), rng.integers(0, 4, 2))) for _ in range(80)]
    unlabelled = [np.unique(rng.integers(4, 16, 5)) for _ in range(300)] + [np.unique(np.append(rng.integers(8, 16, 3), rng.integers(0, 4, 2))) for _ in range(40)]
    prior, decay = 0.12, 3e-5
    model = toxicity.fit(positive, unlabelled, prior, 4, steps=3000, rate=0.02)

    def risk(w, b):
        p = np.array([b + w[t].sum() for t in positive])
        u = np.array([b + w[t].sum() for t in unlabelled])
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        return prior * np.logaddexp(0, -p).mean() + max(0.0, negative) + decay * w.sum(), negative

    w, b = model.weights.astype("float64"), model.bias
    assert set(np.flatnonzero(w)) <= {0, 1, 2, 3} and (w > 0).any()
    at, negative = risk(w, b)
    plain = risk(np.zeros_like(w), -2.0)[0]
    assert at < plain
    if negative > 1e-3:
        for i in np.flatnonzero(w):
            for step in (-1e-2, 1e-2):
                moved = w.copy()
                moved[i] = max(0, moved[i] + step)
                assert risk(moved, b)[0] > at - 1e-4
        for step in (-1e-2, 1e-2):
            assert risk(w, b + step)[0] > at - 1e-4


def test_shards_are_where_sorting_puts_them(spark):
    """Every row against a placement by plain sorting."""
    rng = random.Random(14)
    rows = [(i, None if i % 50 == 0 else "x" * rng.randint(0, 300) if i % 3 else "the same text") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    key = {r.doc_id: r.k for r in frame.select("doc_id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("k")).collect()}
    least = -(1 << 63)
    order = sorted(rows, key=lambda r: (least if key[r[0]] is None else key[r[0]], r[0]))
    total, before, slots, expected = sum(len((t or "").encode()) + 1 for _, t in rows), 0, defaultdict(int), {}
    for i, t in order:
        size = len((t or "").encode()) + 1
        at = min(int((before + size / 2) * 7 // total), 6)
        expected[i] = (at, slots[at])
        slots[at] += 1
        before += size
    assert {r.doc_id: (r.shard, r.slot) for r in shard.shard_documents(frame, 7).collect()} == expected


@pytest.mark.parametrize("run", ["mixing", "neighbours", "language", "toxicity", "quality"])
def test_clashing_names(spark, docs, labels, run):
    extra = docs.limit(40)
    for c in ("_doc", "term", "tokens", "rate", "_y", "word", "label", "leaf", "cell", "score", "_stratum", "_row", "held_out"):
        extra = extra.withColumn(c, F.lit("clash"))
    if run == "neighbours":
        vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<double>")
        for c in ("rid", "v", "q", "leaf", "cell", "block", "ids", "_q"):
            vectors = vectors.withColumn(c, F.lit("clash"))
        assert neighbours.nearest(vectors, F.col("vec_id") % 20 == 0).count() == 60
        return
    got = {"mixing": lambda: mixing.mixed(extra, labels.withColumn("_domain", F.lit(1)), {"clean": 0.5, "toxic": 0.5}), "language": lambda: language.languages_of_documents(extra), "toxicity": lambda: toxicity.toxicity_of_documents(extra, labels.withColumn("_y", F.lit(1))), "quality": lambda: quality.quality_of_documents(extra, labels.withColumn("_y", F.lit(1)))}[run]()
    assert got.count() == 40
