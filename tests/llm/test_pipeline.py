"""The pipeline's stages on a small corpus, each on what the one before kept."""

import random

import corpus_pipeline


def corpus(spark, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(200):
        w = [word() for _ in range(rng.randint(30, 80))]
        if i % 10 == 1:
            w = [x + "%%%" for x in w]
        if i % 10 == 2:
            w[3:3] = ["zzvile"]
        docs.append((i, " ".join(w), "x", "s", 1))
        if i < 150:
            labels.append((i, int(i % 10 != 1), int(i % 10 == 2)))
    item = " ".join(word() for _ in range(20))
    docs += [(300, docs[5][1], "x", "s", 1), (301, docs[5][1] + " more", "x", "s", 1), (302, "start " + item + " " + docs[6][1], "x", "s", 1), (303, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/out/{name}")
        docs = spark.read.parquet(f"{folder}/out/{name}")
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
        if name != "sharding":
            assert docs.columns == columns
    quality, near, clean, mixed, sharded = map(set, kept)
    assert not any(i % 10 == 1 for i in quality if i < 200) and {i for i in range(200) if i % 10 != 1} <= quality
    assert quality - near == {300, 301}
    assert near - clean == {302}
    assert len({i for i in range(200) if i % 10 not in (1, 2)} - mixed) <= 8
    assert len({i for i in mixed if i < 200 and i % 10 == 2}) < 12
    assert sorted(kept[3], key=str) == sorted(kept[4], key=str)


def test_run(spark, tmp_path):
    corpus(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.count() > 150


def test_near_copies_from_four_fifths_are_linked(spark, tmp_path):
    from juncture.llm import neardup

    rng = random.Random(5)
    rows, pairs = [], 0
    for i in range(20):
        w = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(104)]
        other = list(w)
        for at in (20, 60):
            other[at] = f"new{i}"
        # 100 shingles, 10 of them changed: 90 / 110 = 0.818
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
        a, b = (set(neardup.shingles(t).tolist()) for _, t in rows[-2:])
        pairs += 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
    assert pairs == 20
    docs = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()}
    assert kept == {2 * i for i in range(20)}
    assert neardup.near_duplicates(docs).filter("kept").count() == 40


def test_stages_drop_rows_not_ids(spark, tmp_path):
    corpus(spark, str(tmp_path))
    stages = dict(corpus_pipeline.STAGES)
    text = " ".join(f"a{i}" for i in range(40))
    item = spark.read.parquet(f"{tmp_path}/benchmark.parquet").first().text
    rows = [(1, text), (1, text), (2, text + " b"), (None, text), (1, "another text of its own"), (None, item), (5, item + " x"), (5, "a clean text")]
    docs = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([("1", text), ("1", rows[4][1]), ("5", item + " x"), ("5", "a clean text")])
    left = stages["decontamination"](spark, docs, str(tmp_path))
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([(str(i), t) for i, t in rows if item not in t])


def test_few_like_pairs_are_beyond_the_distance():
    from math import comb

    from juncture.llm import neardup

    n, share = neardup.HASHES, 1 - corpus_pipeline.NEAR_PERCENT / 100
    assert sum(comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(neardup.DISTANCE + 1, n + 1)) < 1e-5
