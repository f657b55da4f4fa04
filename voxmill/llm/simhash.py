"""Near-duplicates by SimHash fingerprints, linked through pivot distance tables.

Each distinct fingerprint has a row of Hamming distances to many fixed reference fingerprints (the pivots). Two
fingerprints at d differing bits have rows that differ by d at most in every coordinate.

Candidates come from the distances to a family of pivots, a centre and its neighbours at two flipped bits each, all different
bits. The distance to the centre less that to a neighbour tells how many of the two bits differ from the centre's: 0, 1 or 2.
Over the 32 neighbours these numbers differ by d in sum at most, so for a pair within `limit` bits all but `limit` are
equal. They are cut into `blocks` blocks, and a pair shares a key in one of the tables, each of which takes the numbers of
blocks - limit blocks. A key that more than `group` fingerprints share (counted with map-side aggregation first) is
split: its free numbers are cut into limit + 1 parts, one of which must be alike, and so on; when none is free, the same goes on with
the neighbours of the centre at one flipped bit each. Distinct fingerprints differ in one of those, so this ends, nothing is
dropped, and no task takes an unbounded group.

Within a key, a pair whose rows of distances to `n_pivots` further pivots differ by more than the limit in any coordinate is
discarded, and the survivors are compared bit by bit. The links leave as a spanning forest, never as all pairs; the
components are those of all links.

Wide fingerprints (`wide_fingerprints`, `near_groups`) are for links that 3 of 64 bits can't reach. Sets of shingles whose Jaccard similarity is
0.8 differ in up to WORST of their bits, each bit by itself, so such a pair's distance is known but for chance. Their keys are numbers of the same pivots,
`coarse` of them to a table, and the tables are so many that a pair shares none with probability MISSED at most; within a
key, rows meet by size and the bits confirm them. These odds take the tables as independent, though they share bits. Here the distances are too large for further pivots to discard anything.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other. Equal
fingerprints are one node, so copies and repeated rows are never paired. Every input row has one result row. A null
doc_id never is a component_id unless its component has no other. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import chunks, clean_documents, materialise
from voxmill.operators.graph import star_components as components

SHINGLE, SEED, BITS = 3, 42, 64
ALL = (1 << BITS) - 1
#: Words of a wide fingerprint, those of them that travel with a key, and the bits in which sets at Jaccard similarity 0.8 differ (computed at 16 sizes of union from 6 to 300, at most 0.161; at five 0.1875).
WORDS, CARRIED, WORST = 8, 4, 0.165
#: Pairs at 0.8 that share no table; differing bits of the first word and of all carried words (of sets up to five, of others) that under 1e-5 of such pairs pass.
MISSED, FIRST_LIMIT, SMALL_LIMIT, LIMIT = 3e-6, 27, 82, 72


def fingerprint_texts(texts: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """The unsigned 64-bit fingerprints: bit set where over half of the shingle hashes have it."""
    hashes, sizes = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        words = t.encode().lower().split()  # bytes: A-Z alone and ASCII white space alone
        if not words:
            continue
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        hashes.append(h)
        sizes[k] = len(h)
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    every = np.concatenate(hashes)
    full = np.flatnonzero(sizes)
    starts = np.cumsum(sizes[full]) - sizes[full]
    for b in range(BITS):
        ones = np.add.reduceat(((every >> np.uint64(b)) & np.uint64(1)).astype(np.uint32), starts)
        out[full] |= (2 * ones > sizes[full]).astype(np.uint64) << np.uint64(b)
    return out


def fingerprints(df: DataFrame, slice_bytes: int = 1 << 20) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", slice_bytes):
                fp = fingerprint_texts(part.column("text").to_pylist()).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return clean_documents(df).mapInArrow(run, "doc_id long, fp long")


def pivots(count: int) -> np.ndarray:
    """Reference fingerprints by the splitmix64 rule."""
    x = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


CENTRE = pivots(1)


def pivot_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances, one row for each reference."""
    return np.bitwise_count(fp[None, :] ^ refs[:, None]).astype(np.int8)


def surviving(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no pivot discards and that the bits confirm."""
    for row in table:
        near = np.abs(row[i] - row[j]) <= limit
        i, j = i[near], j[near]
    near = np.bitwise_count(fp[i] ^ fp[j]) <= limit
    return i[near], j[near]


def links(fp: np.ndarray, first: np.ndarray, refs: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked places (i, j); groups begin at `first` and fp is sorted by group."""
    table, n = pivot_table(fp, refs), len(fp)
    sizes = np.diff([*first, n])
    end = np.repeat(first + sizes, sizes)
    at, out = np.arange(n), []
    step = 1
    live = at[end - at > step]
    while len(live):  # each place with the one `step` further on in its group
        out.append(surviving(fp, table, live, live + step, limit))
        step += 1
        live = live[end[live] - live > step]
    return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (at[:0], at[:0])


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, as (node, root of its tree)."""
    up: dict[int, int] = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y] if y in up else y
            x = y
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
    return [(x, r) for x in list(up) if (r := root(x)) != x]


def neighbours(width: int) -> np.ndarray:
    """The centre and its neighbours at `width` flipped bits each; all bits are flipped in one of them."""
    step = BITS // width
    flips = np.array([sum(1 << (k + j * step) for j in range(width)) for k in range(step)], np.uint64)
    return np.concatenate([CENTRE, CENTRE ^ flips])


def packed_numbers(fp: np.ndarray, width: int) -> np.ndarray:
    """For each neighbour how many of its bits differ from the centre's, from the distances alone; `width` bits to a number."""
    rows = pivot_table(fp, neighbours(width)).astype(np.int64)
    numbers = (rows[0] - rows[1:] + width) // 2
    out = np.zeros(len(fp), np.uint64)
    for k, own in enumerate(numbers):
        out |= own.astype(np.uint64) << np.uint64(k * width)
    return out


def block_masks(blocks: int, limit: int) -> list[int]:
    """Masks over the numbers of the neighbours at two bits."""
    n = BITS // 2
    cuts = [round(k * n / blocks) for k in range(blocks + 1)]
    part = [sum(3 << 2 * b for b in range(cuts[k], cuts[k + 1])) for k in range(blocks)]
    return [sum(part[k] for k in own) for own in combinations(range(blocks), blocks - limit)]


def finer_masks(two: int, one: int, limit: int) -> list[tuple[int, int]]:
    """The masks (over numbers of two bits, of one bit) that split a key of masks (two, one)."""
    free = [k for k in range(BITS // 2) if not two >> 2 * k & 3]
    if free:
        return [(two | sum(3 << 2 * k for k in free[j :: limit + 1]), one) for j in range(min(limit + 1, len(free)))]
    free = [k for k in range(BITS) if not one >> k & 1]
    return [(two, one | sum(1 << k for k in free[j :: limit + 1])) for j in range(min(limit + 1, len(free)))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(distinct: DataFrame, limit: int = 3, blocks: int = 6, group: int = 1024, n_pivots: int = 32) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links at `limit` or fewer bits."""
    spark, refs = distinct.sparkSession, pivots(n_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)

        def linked(rows):
            new = np.flatnonzero((np.diff(rows[:4]) != 0).any(axis=0)) + 1
            fp = rows[4]
            i, j = links(fp.view(np.uint64), np.concatenate([[0], new]), refs, limit)
            pairs = forest(fp[i], fp[j])
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:  # sorted by group; the last group of a batch may go on in the next
            rows = np.concatenate([held, np.stack([np.asarray(batch.column(c)) for c in ("m2", "m1", "k2", "k1", "fp")])], axis=1)
            if not rows.shape[1]:
                continue
            last = np.flatnonzero((rows[:4] != rows[:4, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = rows[:, cut:].copy()
            if cut:
                yield linked(np.ascontiguousarray(rows[:, :cut]))
        if held.shape[1]:
            yield linked(held)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (fp, packed_numbers(fp, 2), packed_numbers(fp, 1))], names=["fp", "two", "one"])

    # dealt out before each row is copied once for each table
    known = materialise(distinct.select("fp").repartition("fp").mapInArrow(numbered, "fp long, two long, one long"), "numbers")
    first = [F.lit(signed(m)) for m in block_masks(blocks, limit)]
    keyed = known.select("fp", "two", "one", F.explode(F.array(*first)).alias("m2"), F.lit(0).cast("long").alias("m1"))
    out = None
    while True:
        keyed = keyed.withColumn("k2", F.expr("two & m2")).withColumn("k1", F.expr("one & m1"))
        sizes = keyed.groupBy("m2", "m1", "k2", "k1").agg(F.count("*").alias("n")).where("n > 1")
        shared = materialise(keyed.join(sizes, ["m2", "m1", "k2", "k1"]), "keyed")
        key = ["m2", "m1", "k2", "k1"]
        few = shared.where(F.col("n") <= group).select(*key, "fp").repartition(*key).sortWithinPartitions(*key)
        made = materialise(few.mapInArrow(run, "a long, b long"), "links")
        out = made if out is None else out.union(made)
        many = shared.where(F.col("n") > group)
        if many.isEmpty():
            return out
        # the masks of a level are as many as the choices of blocks allow, whatever the data
        hot = many.select("m2", "m1").distinct().collect()
        masks = [(*old, *map(signed, new)) for old in hot for new in finer_masks(old[0] & ALL, old[1] & ALL, limit)]
        finer = F.broadcast(spark.createDataFrame(masks, "m2 long, m1 long, f2 long, f1 long"))
        keyed = many.join(finer, ["m2", "m1"]).select("fp", "two", "one", F.col("f2").alias("m2"), F.col("f1").alias("m1")).distinct()


def near_duplicates(df: DataFrame, limit: int = 3) -> DataFrame:
    """doc_id, fp (signed long) and component_id (the least doc_id of the document's component) for each row."""
    docs = materialise(fingerprints(df), "simhash")
    nodes = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(fingerprint_links(nodes.select("fp"), limit))
    grown = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grown.groupBy("root").agg(F.min("first").alias("component_id"))
    found = grown.join(least, "root").select("fp", "component_id")
    return docs.join(found, "fp").select("doc_id", "fp", "component_id")


def wide_fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets, WORDS) fingerprints of sets from the hashes of their shingles, end to end; no set is empty. The first word takes the hashes as they are."""
    parts = -(-sizes // 255)  # a byte counts up to 255 ones
    ends = np.cumsum(parts)
    own = np.arange(ends[-1]) - np.repeat(ends - parts, parts)
    cuts = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * own
    out = np.zeros((len(sizes), WORDS), np.uint64)
    lanes, places = np.uint64(0x0101010101010101), np.arange(0, BITS, 8, dtype=np.uint64)
    for w in range(WORDS):
        x = hashes
        if w:
            x = x + np.uint64(w * 0x9E3779B97F4A7C15 & ALL)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
        for k in range(8):
            ones = np.add.reduceat((x >> np.uint64(k)) & lanes, cuts).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(ones.astype(np.int64), ends - parts, axis=0)
            out[:, w] |= np.bitwise_or.reduce((2 * ones > sizes[:, None]).astype(np.uint64) << (places + np.uint64(k)), axis=1)
    return out


def coarse_tables(coarse: int) -> np.ndarray:
    """(tables, coarse) numbers of pivots' neighbours: so many tables that a pair at WORST shares none with probability MISSED."""
    count = int(np.ceil(np.log(MISSED) / np.log1p(-((1 - WORST) ** coarse)))) if coarse else 1
    draw, fit = np.random.default_rng(42), WORDS * BITS // max(1, coarse)
    dealt = [draw.permutation(WORDS * BITS)[: fit * coarse].reshape(fit, coarse) for _ in range(-(-count // fit))]
    return np.concatenate(dealt)[:count]


def coarse_keys(fp: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(sets, tables) keys: the table and, of each of its neighbours at one bit, whether it is further off than the centre."""
    count, coarse = tables.shape
    numbers = np.concatenate([np.unpackbits(packed_numbers(fp[:, w], 1).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") for w in range(WORDS)], axis=1)
    out = np.empty((len(fp), count), np.int64)
    for t, own in enumerate(tables):
        out[:, t] = numbers[:, own].astype(np.int64) @ (1 << np.arange(coarse, dtype=np.int64)) | t << coarse
    return out


def clusters(size: np.ndarray, fp: np.ndarray, least: float) -> np.ndarray:
    """The least place that each set of a group is linked to; sets come by size, fp: (CARRIED, sets).

    Linked are sets whose sizes allow the similarity `least` and whose carried words differ in no more than the limits.
    """
    n = len(size)
    label, stop = np.arange(n), np.searchsorted(size, np.floor(size / least + 1e-9), side="right")
    limit = np.where(size <= 5, SMALL_LIMIT, LIMIT)
    for a in range(0, n, 64):
        b, end = min(n, a + 64), int(stop[min(n, a + 64) - 1])
        near = np.bitwise_count(fp[0, a:b, None] ^ fp[0, None, a:end]) <= FIRST_LIMIT
        near &= label[a:b, None] != label[None, a:end]
        i, j = np.nonzero(near)
        i, j = i + a, j + a
        ok = (j > i) & (j < stop[i])
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(fp[:, i] ^ fp[:, j]).sum(axis=0, dtype=np.int64) <= limit[i]
        if ok.any():
            p, q = np.divmod(np.unique(label[i[ok]] * n + label[j[ok]]), n)
            goes = np.arange(n)
            for x, root in forest(p, q):
                goes[x] = root
            label = goes[label]
    return label


def near_groups(nodes: DataFrame, least: float, group: int = 2048) -> DataFrame:
    """key, node: for each table, the clusters of two or more sets. nodes: node, size (of the set, not zero), fp (binary, the wide fingerprint).

    The keys take as many numbers as leave about `group` nodes to a key; a larger group is met whole.
    """
    count = nodes.count()
    tables = coarse_tables(max(0, int(np.ceil(np.log2(max(count, 1) / group)))))
    carried = [f"f{k}" for k in range(CARRIED)]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                fp = np.frombuffer(b"".join(part.column("fp").to_pylist()), "<u8").reshape(-1, WORDS)
                keys = coarse_keys(fp, tables)
                times = lambda x: pa.array(np.repeat(x, keys.shape[1]))  # noqa: B023, E731
                cols = [pa.array(keys.ravel()), times(np.asarray(part.column("size"))), times(np.asarray(part.column("node")))]
                yield pa.RecordBatch.from_arrays(cols + [times(fp[:, k].view(np.int64)) for k in range(CARRIED)], names=["g", "size", "node", *carried])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def linked(rows):
            found = []
            first = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1, [rows.shape[1]]])
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a > 1:
                    label = clusters(rows[1, a:b], rows[3:, a:b].view(np.uint64), least)
                    keep = np.flatnonzero(np.bincount(label, minlength=b - a)[label] > 1)
                    node = rows[2, a:b]
                    key = [xxhash.xxh3_64_intdigest(node[x].tobytes(), int(rows[0, a])) for x in label[keep].tolist()]
                    found.append((np.array(key, np.uint64).view(np.int64), node[keep]))
            cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node"])

        for batch in batches:  # sorted by group; the last group of a batch may go on in the next
            rows = np.stack([np.asarray(batch.column(c)) for c in ("g", "size", "node", *carried)])
            if not rows.shape[1]:
                continue
            new = np.flatnonzero(np.diff(rows[0]))
            if held and held[0][0, 0] != rows[0, 0]:
                yield linked(np.concatenate(held, axis=1))
                held = []
            if len(new):
                cut = int(new[-1]) + 1
                yield linked(np.concatenate([*held, rows[:, :cut]], axis=1))
                held, rows = [], rows[:, cut:].copy()
            held.append(rows)
        if held:
            yield linked(np.concatenate(held, axis=1))

    schema = "g long, size long, node long, " + ", ".join(f"{c} long" for c in carried)
    # dealt out before each row is copied once for each table
    keyed = nodes.select("node", "size", "fp").repartition("node").mapInArrow(dealt, schema)
    return materialise(keyed.repartition("g").sortWithinPartitions("g", "size").mapInArrow(met, "key long, node long"), "groups")
