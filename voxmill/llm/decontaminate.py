"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with whole documents, in DataFrame operations.

A window is `window` consecutive words of a benchmark item (an item of fewer words, but not none, is one window). It
is the set of its `shingle`-word shingles, each at its offset. Since a window occurs only where all of its shingles
do, one of them is a sufficient prefix. A first scan of the documents counts how often each benchmark shingle occurs in them; that
orders the shingles by rarity, drops the windows of which some shingle occurs nowhere, and leaves the rarest one of each
other window as its prefix. A second scan joins the prefixes alone. An occurrence of one at word p places the window at
p - offset (positional bound); it has to lie inside the document (length bound); then all its words are compared one by one.

Counts are combined before their shuffle. The shingles of the benchmark are broadcast only if they are counted to be `broadcast_rows` at
most; beyond that the same joins are shuffled. Everything after the second scan works on its matches alone, with
joins that adaptive execution can split.

Defined results: a null or empty text, or one without words, has no words, no hits and no items. Repeated rows each
have a result. Items with a null id or no words are left out, and repeated items count once. Without any item no
document is hit. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.common import clean_documents, materialise

#: Fixed value: what separates words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    lower = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, BETWEEN), "")


def shingle_hash(words: str, at: str, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.expr(f"get({words}, {at} + {i})") for i in range(size)])


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id (string), wkey (the words as one string), ww (the words): one row for each item and distinct window."""
    known = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    cut = known.select("item_id", words_of("text").alias("w")).where("size(w) > 0")
    cut = cut.select("item_id", "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {window}, 0))")).alias("s"))
    ww = cut.select("item_id", F.expr(f"slice(w, s + 1, {window})").alias("ww"))
    return ww.select("item_id", F.concat_ws(" ", "ww").alias("wkey"), "ww").dropDuplicates(["item_id", "wkey"])


def shingles_at(docs: DataFrame, sizes: list[int], first: int) -> DataFrame:
    """docs with pos (each word from `first` on) and h, the hash of the shingle that starts there; one row for each size."""
    at = docs.withColumn("pos", F.explode(F.expr(f"sequence({first}, size(w) - 1)") if first < 0 else F.expr("IF(size(w) > 0, sequence(0, size(w) - 1), CAST(array() AS array<int>))")))
    hashes = [shingle_hash("w", "pos", k) for k in sizes]
    return at.withColumn("h", F.explode(F.array(*hashes)) if len(hashes) > 1 else hashes[0] if hashes else F.lit(0).cast("long"))


def frequencies(docs: DataFrame, known: DataFrame, sizes: list[int], broadcast: bool) -> DataFrame:
    """h and freq: how often each shingle of `known` (column h, distinct) starts in docs (column w); none for those that never do."""
    every = shingles_at(docs.select("w"), sizes, 0).select("h")
    if broadcast:
        return every.join(F.broadcast(known), "h").groupBy("h").agg(F.count("*").alias("freq"))
    return every.groupBy("h").agg(F.count("*").alias("freq")).join(known, "h")


def occurrences(docs: DataFrame, prefix: DataFrame, sizes: list[int], window: int, broadcast: bool) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, text_mark, n_words) of each document, and (uid, start, stop, wkey) of each window that occurs in one.

    prefix: wkey, ww (its words), h (its rarest shingle) and off (where in it); a broadcast prefix needs one scan that ships the
    words around each match, a larger one is met by (uid, pos, h) alone and fetches the words of the matches afterwards.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("text_mark"), words_of("text").alias("w"))
    fits = F.expr("start >= 0 AND start + size(ww) <= n_words")
    if broadcast:
        at = shingles_at(rows, sizes, -1)
        known = prefix.select(F.col("h").alias("kh")).distinct()
        hit = at.join(F.broadcast(known), F.col("h") == F.col("kh"), "left").where("kh IS NOT NULL OR pos = -1")
        around = F.expr(f"slice(w, greatest(pos - {window - 1}, 0) + 1, {2 * window - 1})")
        one = F.col("pos") >= 0
        hit = hit.select("uid", "doc_id", "text_mark", F.expr("size(w)").alias("n_words"), "pos", F.when(one, F.col("kh")).alias("h"), F.when(one, around).alias("ctx"), F.expr(f"greatest(pos - {window - 1}, 0)").alias("ctx_at"))
        found = materialise(hit.dropDuplicates(["uid", "pos", "h"]) if len(sizes) > 1 else hit, "matches")
        placed = found.where("pos >= 0").join(prefix, "h").withColumn("start", F.col("pos") - F.col("off"))
        placed = placed.where(fits).where("slice(ctx, start - ctx_at + 1, size(ww)) = ww")
        base = found.where("pos = -1").select("uid", "doc_id", "text_mark", "n_words")
    else:
        rows = materialise(rows, "words")  # so that a row keeps its uid
        at = shingles_at(rows.select("uid", "w"), sizes, 0).select("uid", "pos", "h", F.expr("size(w)").alias("n_words"))
        near = at.join(prefix, "h").withColumn("start", F.col("pos") - F.col("off")).where(fits).select("uid", "start", "wkey", "ww").distinct()
        placed = near.join(rows.select("uid", "w"), "uid").where("slice(w, start + 1, size(ww)) = ww")
        base = rows.select("uid", "doc_id", "text_mark", F.expr("size(w)").alias("n_words"))
    return base, materialise(placed.select("uid", "start", (F.col("start") + F.expr("size(ww)")).alias("stop"), "wkey"), "hits")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 8, shingle: int = 5, least_items: int = 2, broadcast_rows: int = 500_000, with_text_mark: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted array of id strings), contaminated, and text_mark if asked for (xxhash64 of the text); one row for each row of docs."""
    owned = materialise(benchmark_windows(items, window), "windows")
    wins = owned.select("wkey", "ww").dropDuplicates(["wkey"]).withColumn("k", F.expr(f"least(size(ww), {shingle})"))
    sizes = sorted(r[0] for r in wins.select("k").distinct().collect())  # at most `shingle` numbers
    offs = wins.select("wkey", "ww", "k", F.explode(F.expr("sequence(0, size(ww) - k)")).alias("off"))
    of_size = F.lit(0).cast("long")
    for k in sizes:
        of_size = F.when(F.col("k") == k, shingle_hash("ww", "off", k)).otherwise(of_size)
    offs = materialise(offs.withColumn("h", of_size), "shingles")
    small = offs.count() <= broadcast_rows

    texts = clean_documents(docs)
    freq = materialise(frequencies(texts.select(words_of("text").alias("w")), offs.select("h").distinct(), sizes, small), "rarity")
    rarest = offs.join(freq, "h").groupBy("wkey").agg(F.min(F.struct("freq", "h", "off")).alias("r"), F.count("*").alias("seen"), F.first("ww").alias("ww"), F.first("k").alias("k"))
    # a window of which some shingle occurs nowhere cannot occur
    prefix = materialise(rarest.where("seen = size(ww) - k + 1").select("wkey", "ww", F.col("r.h").alias("h"), F.col("r.off").alias("off")), "prefix")
    base, placed = occurrences(texts, prefix, sizes, window, small)

    before = Window.partitionBy("uid").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.select("uid", "start", "stop").distinct()
    covered = spans.withColumn("to", F.coalesce(F.max("stop").over(before), F.lit(0)))
    covered = covered.groupBy("uid").agg(F.sum(F.expr("greatest(stop - greatest(start, to), 0)")).alias("n_hit"))
    of_doc = placed.select("uid", "wkey").distinct().join(owned.select("wkey", "item_id"), "wkey").select("uid", "item_id").distinct()
    of_doc = of_doc.groupBy("uid").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    out = base.join(covered, "uid", "left").join(of_doc, "uid", "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        items_.alias("items"),
        (F.size(items_) >= least_items).alias("contaminated"),
        *(["text_mark"] if with_text_mark else []),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, least_items: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, in which windows of fewer than least_items benchmark items occur.

    A row is known by its doc_id and a 64-bit hash of its text, so rows that repeat a doc_id are judged each by its own text.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    found = decontaminate(docs.select("doc_id", "text"), items, least_items=least_items, with_text_mark=True)
    bad = materialise(found.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_mark").alias("bad_mark")).distinct(), "contaminated")
    # the ids grow with the documents: one plan at every size, never a broadcast
    return docs.join(bad.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (mark == bad["bad_mark"]), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, list_slice(w, s, s + 7) AS ww FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(ww) AS n FROM win),
occ AS (SELECT doc_id, p, n, list_slice(w, p, p + n - 1) AS ww FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d), lens WHERE p + n - 1 <= len(w)),
hit AS (SELECT doc_id, p, n, item_id FROM occ JOIN win USING (ww)),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN own USING (doc_id)
"""
