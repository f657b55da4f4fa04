"""Near copies by the Jaccard similarity of word shingles: SimHash fingerprints propose pairs, the texts themselves decide.

A text's set is that of its runs of `SHINGLE` words (A-Z lower-cased, cut at ASCII white space; a shorter text is one run).
Texts whose sets have a Jaccard similarity of `LEAST` or more are linked; a component is what links join.

Which pairs are looked at: those that SimHash with pivot distances links (`simhash.near_groups`, 512 bits of the shingles' hashes) at a distance
that sets of the similarity do not pass; by computed odds 3e-6 of the pairs at 0.8 share no table, fewer above (3e-5 where the larger set has five shingles and keys seven bits, and
under 1e-5 pass the limits). Equal sets are one node, so copies are never paired. Of the clusters that fingerprints link, each
node first meets the least one, then (where a cluster's nodes are still in several components) one chosen by hash. So a
large group of near copies costs a few pairs a node. The nodes of clusters that are still in several components then meet by an exact
prefix-filtered join: their shingles are ordered by how many of these nodes have them, and two sets of the similarity share one of the
rarest (1 - LEAST) of the larger one. Texts that only have a frequent passage in common differ in their rare shingles
and so never meet. No group is dropped or capped.

Defined results: null and empty texts and those without words have the empty set and are copies of each other. Nodes and
marks are 64-bit hashes. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm import simhash
from voxmill.llm.common import chunks, materialise
from voxmill.operators.graph import star_components as components

SHINGLE, LEAST = 5, 0.8
#: Pairs whose components one task finds (16 MB); more go through rounds of stars, each of which has the driver plan and compile some ten jobs.
AT_ONCE = 1 << 20


def text_mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def grams(text: str) -> set[bytes]:
    words = text.encode().lower().split()  # bytes: A-Z alone and ASCII white space alone
    if len(words) < SHINGLE:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))


def similarity(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def fingerprints(texts: list[str]) -> tuple[list[int], list[int], list[bytes | None]]:
    """The node (a digest of the set), size and wide fingerprint of each text; the empty set has none."""
    sets = [grams(t) for t in texts]
    each = [np.sort(np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(simhash.SEED)), np.uint64, len(own))) for own in sets]
    nodes = [int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))) for h in each]
    full = [k for k, h in enumerate(each) if len(h)]
    out: list[bytes | None] = [None] * len(texts)
    if full:
        found = simhash.wide_fingerprints(np.concatenate([each[k] for k in full]), np.array([len(each[k]) for k in full]))
        for k, fp in zip(full, found, strict=True):
            out[k] = fp.tobytes()
    return nodes, [len(h) for h in each], out


def _coded(df: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), node, size and fp of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                nodes, sizes, fps = fingerprints(part.column("text").to_pylist())
                cols = [part.column("doc_id"), part.column("mark"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "mark", "node", "size", "fp"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, node long, size long, fp binary")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have the similarity; texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was, own = None, set()
        for batch in batches:
            rows = []
            for a, b, s, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a_text", "b_text")), strict=True):
                if a != was:  # rows come sorted by a
                    was, own = a, grams(s)
                if similarity(own, grams(t)) >= LEAST:
                    rows.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text")) for c in "ab")
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return materialise(both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long"), "near")


def _nodes(df: DataFrame) -> DataFrame:
    """node, size, fp, rep: the doc_id (nulls last) and mark of its first row, and how many rows have both."""
    same = [F.any_value(c).alias(c) for c in ("size", "fp")]
    rows = materialise(_coded(df), "coded").groupBy("node", "doc_id", "mark").agg(F.count("*").alias("n"), *same)
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "n")
    return materialise(rows.groupBy("node").agg(F.min(rep).alias("rep"), *same), "nodes")


def _roots(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and root of the nodes that are not the least of their component."""
    keyed = simhash.near_groups(nodes.where("size > 0"), LEAST)
    reps = nodes.join(keyed.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "rep.doc_id", "rep.mark")
    docs = df.select(F.col("doc_id").cast("long").alias("own"), text_mark().alias("mark"), "text")
    found = docs.join(reps.hint("merge"), F.col("own").eqNullSafe(reps["doc_id"]) & (docs["mark"] == reps["mark"]))
    texts = materialise(found.select("node", "text").dropDuplicates(["node"]), "texts")

    edges, roots = None, None
    for centre in (F.min("node"), F.min_by("node", F.xxhash64("key", "node"))):
        named = _open(keyed, roots)
        if roots is not None and named.isEmpty():
            return roots
        chosen = named.groupBy("key").agg(centre.alias("node"))
        mine = named.join(chosen.hint("merge"), ["key", "node"]).select("key", F.col("node").alias("a"), "root")
        other = named.select("key", F.col("node").alias("b"), F.col("root").alias("b_root"))
        met = mine.join(other.hint("merge"), "key").where("root <> b_root").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = _linked(met, texts)
        edges = new if edges is None else edges.union(new)
        roots = components(edges, AT_ONCE)
    left = materialise(_open(keyed, roots).select("node", "root").distinct(), "left")
    if left.isEmpty():
        return roots
    return components(edges.union(_linked(_prefix_pairs(left, texts), texts)), AT_ONCE)


def _open(keyed: DataFrame, roots: DataFrame | None) -> DataFrame:
    """key, node, root of the keys whose nodes are in several components."""
    if roots is None:
        return keyed.withColumn("root", F.col("node"))
    named = keyed.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return materialise(named.join(several.hint("merge"), "key"), "open")


def _shingles(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, size and g: the 64-bit hash of each different shingle of the nodes' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                found = [np.fromiter(map(xxhash.xxh64_intdigest, own := grams(t), repeat(7)), np.uint64, len(own)) for t in part.column("text").to_pylist()]
                sizes = np.array([len(g) for g in found], np.int64)
                every = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(part.column("node")), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(every)], names=["node", "size", "g"])

    return texts.join(nodes.select("node").hint("merge"), "node", "left_semi").mapInArrow(run, "node long, size long, g long")


def _prefix_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes of different roots that share a shingle of both prefixes; nodes: node, root.

    A prefix is the rarest size - ceil(LEAST * size) + 1 shingles of a set, ties by hash. Those that one node alone has come first
    and join nothing, so they are only counted; the set's size is bounded by LEAST as well. Positions bound the rest: at the first
    shingle that two sets share, both have to have as many shingles from there on as sets of that similarity have in common.
    """
    every = materialise(_shingles(nodes, texts), "shingles")
    common = materialise(every.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "common")
    shared = every.join(common.hint("merge"), "g")
    rarer = Window.partitionBy("node").orderBy("df", "g")
    own = Window.partitionBy("node")
    ranked = shared.withColumn("at", F.row_number().over(rarer)).withColumn("n", F.count("*").over(own))
    # at among all shingles of the node: those that no other node has stand before
    ranked = ranked.withColumn("place", F.col("size") - F.col("n") + F.col("at"))
    prefix = ranked.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * LEAST - 1e-9) + 1)
    prefix = materialise(prefix.join(nodes.hint("merge"), "node").select("g", "node", "root", "size", F.col("size") - F.col("place") + 1).toDF("g", "node", "root", "size", "rest"), "prefix")
    several = prefix.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("g")
    prefix = prefix.join(several.hint("merge"), "g")
    left = prefix.select("g", F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("size").alias("a_size"), F.col("rest").alias("a_rest"))
    right = prefix.select("g", F.col("node").alias("b"), F.col("root").alias("b_root"), F.col("size").alias("b_size"), F.col("rest").alias("b_rest"))
    fits = F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * LEAST - 1e-9
    enough = F.least("a_rest", "b_rest") >= (F.col("a_size") + F.col("b_size")) * (LEAST / (1 + LEAST)) - 1e-9
    met = left.join(right.hint("merge"), (left["g"] == right["g"]) & F.expr("a < b AND a_root <> b_root") & fits & enough)
    return met.select("a", "b").distinct()


def near_copies(df: DataFrame) -> DataFrame:
    """rep (as in _nodes) of each node, and first: the least rep of its component."""
    nodes = _nodes(df)
    grown = nodes.select("node", "rep").join(_roots(df, nodes).hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grown.groupBy("root").agg(F.min("rep").alias("first"))
    return grown.join(least.hint("merge"), "root").select("node", "rep", "first")


def keep_first(df: DataFrame) -> DataFrame:
    """One row of df for each component of near copies: that of the least doc_id (nulls last), then the least mark of its text."""
    kept = materialise(near_copies(df).where("rep = first").select(F.col("rep.doc_id").alias("kept_id"), F.col("rep.mark").alias("kept_mark"), F.col("rep.n").alias("kept_n")), "kept")
    # the ids grow with the documents: one plan at every size, never a broadcast
    same = df["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & (text_mark() == kept["kept_mark"])
    out = df.join(kept.hint("merge"), same)
    once = out.where("kept_n = 1").select(*df.columns)
    if kept.where("kept_n > 1").isEmpty():
        return once
    # rows that repeat both doc_id and text: the first of them by its JSON form, which any column type has
    row = F.struct(*df.columns)
    more = out.where("kept_n > 1").groupBy("kept_id", "kept_mark").agg(F.min_by(row, F.to_json(row)).alias("r"))
    return once.unionByName(more.select("r.*"))
