"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations alone.

One pass over the corpus tokenises it and stores its positional index, in the order of the documents: 64-bit hashes of the terms
by position. Everything after that reads this table alone. Terms of test items are counted over all of it. Each window of each
test item is looked up by the list of its rarest term, and a place on that list stays only if the lists of the next two rarest
terms have it at their offsets; of the documents that are left over, the lists of all test terms are laid out (document,
position, term) and intersected. A posting at position p of the term at offset o of an item lies on the diagonal p - o, and a
run of consecutive offsets on one diagonal is an exact phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from juncture.llm.common import ascii_lower, cut, of_rows, row_key, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rows of a table made from the test items that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _pieces(text: Column) -> Column:
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def _lead(pieces: Column) -> Column:
    """1 if the text begins with a separator (or is empty), so that the first piece is no word."""
    return (F.get(pieces, F.lit(0)) == "").cast("int")


def word_count_of(pieces: Column) -> Column:
    return (F.size(pieces) - _lead(pieces) - ((F.size(pieces) > 1) & (F.get(pieces, F.size(pieces) - 1) == "")).cast("int")).cast("long")


def postings(docs: DataFrame, key: str, text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """The positional index of `docs`: (key, pos, term), of the words in `terms` (column term) or of all words."""
    pieces = docs.select(key, _pieces(F.col(text)).alias("_pieces")).withColumn("_lead", _lead(F.col("_pieces")))
    rows = pieces.select(key, "_lead", F.posexplode("_pieces").alias("_at", "term"))
    if terms is not None:
        rows = rows.join(_bounded(terms.select("term").distinct()), "term")
    return rows.filter("term <> ''").select(key, (F.col("_at") - F.col("_lead")).alias("pos"), "term")


def proximity_matches(index: DataFrame, key: str, queries: DataFrame, within: int) -> DataFrame:
    """(query_id, key, pos): the places from which `within` words on all terms of a query (query_id, terms) occur.

    A posting list is read from the query's rarest term outwards: documents without it are left out before the other lists
    are joined. A query without terms matches nothing.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    needed = wanted.groupBy("query_id").agg(F.count("*").alias("_need"))
    counted = wanted.join(index.groupBy("term").count(), "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = counted.groupBy("query_id").agg(F.min(F.struct("count", "term")).alias("r")).select("query_id", F.col("r.term").alias("term"))
    candidates = index.join(rarest, "term").select("query_id", key).distinct()
    lists = index.join(wanted, "term").join(candidates, ["query_id", key])
    ahead = Window.partitionBy("query_id", key).orderBy("pos").rangeBetween(0, within - 1)
    found = lists.withColumn("_have", F.size(F.collect_set("term").over(ahead))).join(needed, "query_id").filter("_have = _need")
    return found.select("query_id", key, "pos").distinct()


def numbered_terms(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((_item, item_id), (_item, off, tid, term, _n)) of items (item_id, text): each wordful text's terms with their numbers."""
    texts = items.filter(F.col("text").isNotNull()).select("item_id", F.xxhash64("item_id", "text").alias("_item"), "text").distinct()
    words = postings(texts, "_item").withColumnRenamed("pos", "off").distinct()
    tids = words.select("term").distinct().withColumn("tid", F.xxhash64("term"))
    words = words.join(tids, "term").withColumn("_n", F.count("*").over(Window.partitionBy("_item")))
    return texts.select("_item", "item_id"), cut(words)


def stored_index(docs: DataFrame, key: str, *keep: str) -> DataFrame:
    """The index of `docs` as a table in the shared folder: (key, *keep, tids), the hashes of a text's words in their order."""
    pieces = docs.select(key, *keep, _pieces(F.col("text")).alias("_pieces"))
    words = F.slice("_pieces", _lead(F.col("_pieces")) + 1, word_count_of(F.col("_pieces")).cast("int"))
    return stored(pieces.select(key, *keep, F.transform(words, lambda w: F.xxhash64(w)).alias("tids")))


def _postings(index: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """(key, pos, tid): the lists of `terms` (column tid)."""
    return index.select(key, F.posexplode("tids").alias("pos", "tid")).join(_bounded(terms.select("tid").distinct()), "tid", "left_semi")


def phrases(index: DataFrame, key: str, ids: DataFrame, item_terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, item_id, start, stop): maximal runs of document words that spell `window` or more consecutive words of an item,
    or all of an item that has fewer."""
    counts = index.select(F.explode("tids").alias("tid")).join(_bounded(item_terms.select("tid").distinct()), "tid", "left_semi").groupBy("tid").agg(F.count("*").alias("_count"))
    counted = item_terms.join(counts, "tid", "left").withColumn("_count", F.coalesce("_count", F.lit(0)))
    ahead = Window.partitionBy("_item").orderBy("off").rowsBetween(0, window - 1)
    whole = F.col("off") <= F.col("_n") - F.least("_n", F.lit(window))
    # a window with a term that the corpus lacks occurs nowhere
    windows = counted.withColumn("_terms", F.array_sort(F.collect_list(F.struct("_count", "off", "tid")).over(ahead))).filter(whole & (F.col("_terms")[0]["_count"] > 0))
    nth = lambda i: F.get("_terms", F.least(F.size("_terms") - 1, F.lit(i)))
    lists = cut(windows.select("_item", *[x for i in range(3) for x in (nth(i)["off"].alias(f"off{i}"), nth(i)["tid"].alias(f"tid{i}"))]).distinct())
    diagonal = (F.col("pos") - F.col("off0")).alias("_diagonal")
    if lists.count() <= MOST_BROADCAST:
        there = lambda i: F.get("tids", F.col("pos") + F.col(f"off{i}") - F.col("off0")) == F.col(f"tid{i}")
        at = index.select(key, "tids", F.posexplode("tids").alias("pos", "tid0")).join(F.broadcast(lists), "tid0")
        found = at.filter(there(1) & there(2)).select(key, "_item", diagonal)
    else:
        found = _postings(index, key, lists.select(F.col("tid0").alias("tid"))).withColumnRenamed("tid", "tid0").join(lists, "tid0").select(key, "_item", diagonal, "off1", "tid1", "off2", "tid2")
        for i in (1, 2):
            other = _postings(index, key, lists.select(F.col(f"tid{i}").alias("tid"))).withColumnsRenamed({"tid": f"tid{i}", "pos": "_pos"})
            found = found.withColumn("_pos", F.col("_diagonal") + F.col(f"off{i}")).join(other, [key, "_pos", f"tid{i}"], "left_semi").drop("_pos")
    candidates = cut(found.select(key, "_item", "_diagonal").distinct())
    keys = candidates.select(key).distinct()
    own = cut(_postings(index.join(F.broadcast(keys) if keys.count() <= 4 * MOST_BROADCAST else keys, key, "left_semi"), key, item_terms).distinct())
    expected = candidates.join(_bounded(item_terms.select("_item", "off", "tid", "_n")), "_item").withColumn("pos", F.col("_diagonal") + F.col("off"))
    same = expected.join(own, [key, "pos", "tid"], "left_semi").select(key, "_item", "_diagonal", "off", "_n").distinct()
    on = Window.partitionBy(key, "_item", "_diagonal").orderBy("off")
    runs = same.withColumn("_run", F.col("off") - F.row_number().over(on)).groupBy(key, "_item", "_diagonal", "_run", "_n").agg(F.min("off").alias("_low"), F.count("*").alias("_len"))
    long = runs.filter(F.col("_len") >= F.least("_n", F.lit(window)))
    return long.join(ids, "_item").select(key, "item_id", (F.col("_diagonal") + F.col("_low")).alias("start"), (F.col("_diagonal") + F.col("_low") + F.col("_len")).alias("stop"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of `docs` (doc_id, text).

    A null or empty text has no words and no hits; a null or wordless item never occurs. Texts are told apart by a 64-bit hash
    of (doc_id, text), so repeated rows get equal results each, rows that share a doc_id are judged by their own text, and a
    null doc_id is no hindrance. An item_id with several texts counts once. A text of any length is indexed whole.
    """
    ids, terms = numbered_terms(items)
    index = stored_index(docs.select("doc_id", "text", row_key(docs).alias("_doc")), "_doc", "doc_id")
    hits = cut(phrases(index, "_doc", ids, terms, window).select("_doc", "item_id", "start", "stop").distinct())
    in_order = Window.partitionBy("_doc").orderBy("start", "stop")
    before = F.coalesce(F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = hits.select("_doc", "start", "stop").distinct().withColumn("_new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", before)))
    covered = spans.groupBy("_doc").agg(F.sum("_new").cast("long").alias("n_hit"))
    named = hits.groupBy("_doc").agg(F.collect_set(F.col("item_id").cast("string")).alias("_ids"))
    found = covered.join(named, "_doc", "left")
    none = F.array().cast("array<string>")
    counted = index.select("doc_id", "_doc", F.size("tids").cast("long").alias("n_words"))
    out = counted.join(found, "_doc", "left").withColumn("_ids", F.coalesce("_ids", none)).withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    return out.select("doc_id", "n_words", "n_hit", F.size("_ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("_ids"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` without any hit, with all their columns; a null doc_id or a shared one is no hindrance."""
    keyed = docs.withColumn("_row", row_key(docs))
    ids, terms = numbered_terms(items)
    hits = phrases(stored_index(keyed.filter(F.col("text").isNotNull()).select("_row", "text"), "_row"), "_row", ids, terms, window)
    return of_rows(keyed, cut(hits.select("_row").distinct()), "left_anti").select(*docs.columns)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, w[s + 1 : s + k] AS win FROM (SELECT item_id, k, w, unnest(range(0, len(w) - k + 1)) AS s FROM b)),
ks AS (SELECT DISTINCT k FROM b),
pos AS (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, ks WHERE len(w) >= k),
occ AS (SELECT pos.doc_id, pos.p, pos.k, iw.item_id FROM pos JOIN iw ON iw.k = pos.k AND iw.win = pos.w[pos.p + 1 : pos.p + pos.k]),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
