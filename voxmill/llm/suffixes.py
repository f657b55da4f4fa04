"""Exact substring dedup over all documents with suffix arrays sorted deep-shallow.

Which suffixes are compared: every string of `length` bytes holds one anchor, the 8-byte gram with the least hash in
it (the leftmost if several tie), and equal strings have equal anchors. Consecutive strings with the same anchor make one run, at
most 2 * length - 8 bytes long, and each run goes to the bucket of its anchor, so equal strings always meet there.

In a bucket, runs of equal text (found by a 128-bit digest, then compared byte for byte) are one class: those of a later document than the class's first are
covered whole. Of each class one run goes on, if another class shares with it the anchor and enough bytes to its left or
right for a common string. The suffixes of these runs, cut to `length` bytes, are sorted: multikey quicksort by 8-byte
big-endian words (three-way parting around a pivot, level by level) down to a shallow depth, then blind tries order the groups that are still tied. Suffixes in one leaf
are equal strings; all that belong to a later document than the leaf's first are covered.

Scale: runs equal to one of an earlier document in the same map task are settled there and not sent (that also thins
hot passages before the shuffle). Tasks are as many as the counted bytes ask for, `task_bytes` of documents to each, and buckets eight times
that. Runs travel as compressed blocks, one for each bucket and flush; a bucket larger than
`bucket_bytes` is worked off in several passes over its blocks. Covered intervals travel as compressed blocks to the part of their
document, and the documents themselves are shuffled once, each compressed, and streamed past them.

Defined results: a null or empty text, and any of fewer than `length` bytes, loses nothing. Rows with one doc_id are one
document: they don't cover each other, and a 32-bit hash of their texts tells them apart. A null doc_id ranks before all others. An empty table gives an empty table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import chunks, string_bytes

GRAM = 8
NO_ID = -(2**63)
#: Low bits of an anchor key that hold its place; a longer text is cut into overlapping segments.
PLACE_BITS = 25
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def words_at_each(raw: np.ndarray) -> np.ndarray:
    """A view: the little-endian 8 bytes at each place (the last 7 places have none)."""
    n = len(raw) - GRAM + 1
    return np.lib.stride_tricks.as_strided(raw.view(), (max(n, 0), GRAM), (1, 1)).view("<u8")[:, 0] if n > 0 else np.zeros(0, "<u8")


def runs(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """doc (index), first string, last string, anchor place of each run of strings with one anchor."""
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (mix(words_at_each(raw) * M1) & ~low) | np.arange(n - GRAM + 1, dtype=np.uint64)
    span, wide = 1, length - GRAM + 1  # grams in a string
    while span * 2 <= wide:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    if wide > span:
        key = np.minimum(key[: len(key) - (wide - span)], key[wide - span :])
    anchor = (key & low).astype(np.int64)  # for each of the n - length + 1 strings
    sizes = np.diff(offsets)
    inside = np.maximum(sizes - length + 1, 0)
    turn = np.ones(len(anchor) + 1, bool)
    turn[1:-1] = anchor[1:] != anchor[:-1]
    has = inside > 0
    starts, stops = offsets[:-1][has], (offsets[:-1] + inside)[has]
    turn[starts] = True
    turn[stops[stops <= len(anchor)]] = True
    cuts = np.flatnonzero(turn)
    first, last = cuts[:-1], cuts[1:] - 1
    doc = np.searchsorted(offsets, first, side="right") - 1
    ok = first < offsets[doc] + inside[doc]
    first, last, doc = first[ok], last[ok], doc[ok]
    return doc, first, last, anchor[first]


def text_digests(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of the texts of `size` (8 or more) bytes at `at`; words: of words_at_each."""
    a = size.astype(np.uint64) * M1
    b = a ^ M2
    for j in range(0, int(size.max(initial=0)), GRAM):
        on = np.flatnonzero(size > j)
        w = words[at[on] + np.minimum(j, size[on] - GRAM)]
        a[on] = mix((a[on] ^ w) * M1)
        b[on] = mix((b[on] + w) * M3)
    return a, b


def classes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal pairs side by side, and where each class begins in it."""
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    if len(x) and ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, np.flatnonzero(new)


def verified(words: np.ndarray, at: np.ndarray, size: np.ndarray, order: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes with the texts themselves compared: members that are unlike their class's first become classes of their own."""
    if not len(order):
        return order, begin
    lead = np.repeat(order[begin], np.diff([*begin, len(order)]))
    like = size[order] == size[lead]
    for j in range(0, int(size.max(initial=0)), GRAM):
        on = np.flatnonzero(like & (size[order] > j))
        a, b = order[on], lead[on]
        like[on] = words[at[a] + np.minimum(j, size[a] - GRAM)] == words[at[b] + np.minimum(j, size[b] - GRAM)]
    if like.all():
        return order, begin
    # two texts of one 128-bit digest: each unlike member stands alone, behind the others of its class
    of_class = np.repeat(np.arange(len(begin)), np.diff([*begin, len(order)]))
    by = np.lexsort((~like, of_class))
    order, alone = order[by], ~like[by]
    return order, np.flatnonzero(np.r_[True, of_class[by][1:] != of_class[by][:-1]] | alone)


def least_of_class(order: np.ndarray, begin: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each element, the least value in its class."""
    out = np.empty_like(value)
    if len(order):
        out[order] = np.repeat(np.minimum.reduceat(value[order], begin), np.diff([*begin, len(order)]))
    return out


class BlindTrie:
    """Orders strings of one length that share a long prefix: inner nodes keep only the depth at which they branch."""

    __slots__ = ("root", "text")

    def __init__(self, text):
        self.text, self.root = text, None

    def insert(self, k: int) -> None:
        s = self.text[k]
        if self.root is None:
            self.root = [k]
            return
        node = self.root
        while isinstance(node, tuple):  # blind descent: only branching bytes are looked at
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = self.text[node[0]]
        if s == other:
            node.append(k)
            return
        depth = next(i for i in range(len(s)) if s[i] != other[i])
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][s[depth]] = [k]
            return
        new = (depth, {other[depth]: node, s[depth]: [k]})
        if parent is None:
            self.root = new
        else:
            parent[1][s[parent[0]]] = new

    def leaves(self) -> Iterator[list[int]]:
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                yield node


def three_way(order: np.ndarray, key: np.ndarray, bounds: list[tuple[int, int]], small: int) -> np.ndarray:
    """One level of multikey quicksort: sorts the stretches `bounds` of order and key, in place, by key; True where a new value begins.

    A stretch is parted into what is less than, equal to and greater than a pivot (the median of three keys); the equal part is done, the
    others go on. Stretches of `small` elements at most are sorted together at the end.
    """
    new, todo, rest = np.zeros(len(order) + 1, bool), list(bounds), []
    for lo, hi in bounds:
        new[lo] = new[hi] = True
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= small:
            if hi > lo:
                rest.append((lo, hi))
            continue
        k = key[lo:hi]
        pivot = sorted((k[0], k[(hi - lo) // 2], k[-1]))[1]
        less, more = k < pivot, k > pivot
        moved = np.concatenate([np.flatnonzero(less), np.flatnonzero(~(less | more)), np.flatnonzero(more)])
        order[lo:hi], key[lo:hi] = order[lo:hi][moved], k[moved]
        a, b = lo + int(less.sum()), hi - int(more.sum())
        new[a] = new[b] = True
        todo += [(lo, a), (b, hi)]
    if rest:
        lo, hi = np.array(sorted(rest)).T
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        by = np.lexsort((key[at], np.repeat(lo, size)))
        order[at], key[at] = order[at][by], key[at][by]
        new[at[1:]] |= key[at[1:]] != key[at[:-1]]
    return new


def deep_shallow(raw: np.ndarray, places: np.ndarray, length: int, shallow: int = 32, small: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at `places`, cut to `length` bytes, and where each class of equal ones begins in it."""
    words, n = words_at_each(raw), len(places)
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # where the element's group begins, by place in the order
    depth = 0
    live = np.arange(n)  # places in the order that are still tied
    while depth < min(shallow, length) and len(live):
        step = min(GRAM, length - depth)
        key = words[places[order[live]] + depth + step - GRAM if step < GRAM else places[order[live]] + depth].byteswap()
        if step < GRAM:  # the word ends at the string's end
            key = key & np.uint64((1 << 8 * step) - 1)
        g = group[live]  # groups stay where they are
        cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
        own = order[live]
        first = np.flatnonzero(three_way(own, key, list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)), small)[:-1])
        order[live] = own
        size = np.diff([*first, len(live)])
        group[live] = np.repeat(live[first], size)
        live = live[np.repeat(size > 1, size)]
        depth += step
    if depth >= length or not len(live):
        return order, np.flatnonzero(group == np.arange(n))
    # deep: members that equal their group's first are one leaf; a group with others is ordered by a blind trie
    lead = order[group[live]]
    equal = np.ones(len(live), bool)
    for d in [*range(depth, length - GRAM, GRAM), length - GRAM]:
        equal &= words[places[order[live]] + d] == words[places[lead] + d]
    begins = np.flatnonzero(np.r_[True, group[live][1:] != group[live][:-1]])
    ends = np.r_[begins[1:], len(live)]
    odd = np.flatnonzero(np.minimum.reduceat(equal, begins) == 0)
    for k in odd:
        at = live[begins[k] : ends[k]]
        own = order[at]
        text = [raw[p + depth : p + length].tobytes() for p in places[own]]
        trie = BlindTrie(text)
        for i in range(len(own)):
            trie.insert(i)
        done = at[0]
        for leaf in trie.leaves():
            order[done : done + len(leaf)] = own[leaf]
            group[done : done + len(leaf)] = done
            done += len(leaf)
    return order, np.flatnonzero(group == np.arange(n))


def pack_block(doc: np.ndarray, ids: np.ndarray, tags: np.ndarray, arrays: list[np.ndarray]) -> bytes:
    """doc: index into ids and tags, ascending. Only the documents that occur are kept."""
    used, own = np.unique(doc, return_inverse=True)
    head = struct.pack("<II", len(used), len(doc))
    parts = [np.diff(ids[used], prepend=np.int64(0)), tags[used], np.diff(own, prepend=0).astype("<u4"), *arrays]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(x.tobytes() for x in parts))


def unpack_block(block: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """doc_id, tag and the arrays of each row; what is left over comes last."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    docs, n = struct.unpack_from("<II", raw)
    at, out = 8, []
    for kind, count in (("<i8", docs), ("<u4", docs), ("<u4", n), *((k, n) for k in kinds)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    ids, own = np.cumsum(out[0]), np.cumsum(out[2], dtype=np.int64)
    return [ids[own], out[1][own], *out[3:], np.frombuffer(raw, np.uint8, offset=at)]


class Intervals:
    """Covered intervals on their way to the parts of their documents."""

    def __init__(self, parts: int):
        self.parts, self.held, self.count = parts, [], 0

    def add(self, ids, tags, start, stop) -> None:
        if len(ids):
            self.held.append((ids.astype(np.int64), tags.astype("<u4"), start.astype("<u4"), stop.astype("<u4")))
            self.count += len(ids)

    def flush(self) -> list[tuple[int, bytes]]:
        if not self.held:
            return []
        ids, tags, start, stop = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.count = [], 0
        part = part_of(ids, self.parts)
        order = np.lexsort((start, tags, ids, part))
        ids, tags, start, stop, part = (x[order] for x in (ids, tags, start, stop, part))
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            new = np.r_[True, (ids[a + 1 : b] != ids[a : b - 1]) | (tags[a + 1 : b] != tags[a : b - 1])]
            doc = np.cumsum(new) - 1
            out.append((int(part[a]), pack_block(doc, ids[a:b][new], tags[a:b][new], [start[a:b], stop[a:b]])))
        return out


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) * M1) % np.uint64(parts)).astype(np.int64)


def remove_repeats(df: DataFrame, length: int = 50, buckets: int | None = None, bucket_bytes: int = 24 << 20, flush_bytes: int = 40 << 20, slice_bytes: int = 1 << 20, task_bytes: int = 128 << 20) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, stop in bytes), kept (binary); one row for each row of df."""
    if length < 3 * GRAM or 2 * length - GRAM > 255:
        raise ValueError("length must be from 24 to 131 bytes")
    spark = df.sparkSession
    docs_bytes = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + docs_bytes // task_bytes)
    parts = buckets or 8 * tasks
    half = (length - GRAM + 1) // 2  # a common string has this many bytes left of its anchor, or right of it
    docs = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, []  # known: (id, tag) of the documents since the last flush
        covered = Intervals(parts)

        def flush():
            nonlocal held, size, known
            doc, start, width, off, gram, da, db, text = (np.concatenate(x) for x in zip(*held, strict=True))
            ids, tags = np.array([k[0] for k in known], np.int64), np.array([k[1] for k in known], "<u4")
            rank = np.argsort(ids, kind="stable")
            back = np.empty(len(rank), np.int64)
            back[rank] = np.arange(len(rank))
            ids, tags, doc = ids[rank], tags[rank], back[doc]
            begin = np.cumsum(width, dtype=np.int64) - width
            held_words = words_at_each(text)
            wide = width.astype(np.int64)
            least = least_of_class(*verified(held_words, begin, wide, *classes(da, db)), ids[doc])
            here = ids[doc] > least
            covered.add(ids[doc[here]], tags[doc[here]], start[here], start[here] + width[here])
            bucket = (mix(gram * M3) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((start, doc, bucket))
            order = order[~here[order]]
            cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1), len(order)] if len(order) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[a:b]
                w = width[own].astype(np.int64)
                took = text[np.repeat(begin[own] - (np.cumsum(w) - w), w) + np.arange(w.sum())]
                yield 0, int(bucket[own[0]]), pack_block(doc[own], ids, tags, [start[own], width[own], off[own], took])
            for part, block in covered.flush():
                yield 1, part, block
            held, size, known = [], 0, []

        def rows(out):
            for kind, part, block in out:
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int64()), pa.array([block], pa.binary())], names=["kind", "part", "block"])

        for batch in batches:
            for piece in chunks(batch, "text", slice_bytes):
                raw, offsets = string_bytes(piece.column("text"))
                ids = np.asarray(piece.column("id"))
                base = len(known)
                known += [(int(i), xxhash.xxh32_intdigest(raw[a:b])) for i, a, b in zip(ids, offsets[:-1], offsets[1:], strict=True)]
                for lo, seg, segoff in segments(raw, offsets, length):
                    doc, first, last, anchor = runs(seg, segoff, length)
                    if not len(doc):
                        continue
                    words = words_at_each(seg)
                    width = last - first + length
                    da, db = text_digests(words, first, width)
                    text = seg[np.repeat(first - (np.cumsum(width) - width), width) + np.arange(width.sum())]
                    held.append((doc + base, (first + lo - offsets[doc]).astype("<u4"), width.astype(np.uint8), (anchor - first).astype(np.uint8), words[anchor], da, db, text))
                    size += len(text)
                    if size > flush_bytes:
                        yield from rows(flush())
                        base = 0
                        known = [(int(i), xxhash.xxh32_intdigest(raw[a:b])) for i, a, b in zip(ids, offsets[:-1], offsets[1:], strict=True)]
        if held:
            yield from rows(flush())

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covered, bucket, blocks, raw_size = Intervals(parts), None, [], 0

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], names=["part", "block"])

        def settle():
            passes = 1 + raw_size // bucket_bytes
            for k in range(passes):
                bucket_suffixes(blocks, k, passes, length, half, covered)

        for batch in batches:
            for kind, part, block in zip(batch.column("kind").to_pylist(), batch.column("part").to_pylist(), batch.column("block"), strict=True):
                if kind:
                    yield out([(part, block.as_py())])
                    continue
                if part != bucket and blocks:
                    settle()
                    blocks, raw_size = [], 0
                    if covered.count > 2_000_000:
                        yield out(covered.flush())
                bucket = part
                blocks.append(block.as_py())
                raw_size += zstandard.frame_content_size(blocks[-1])
        if blocks:
            settle()
        if covered.count:
            yield out(covered.flush())

    sent = docs.mapInArrow(send, "kind int, part long, block binary").repartition(tasks, "kind", "part").sortWithinPartitions("kind", "part")
    found = sent.mapInArrow(sort, "part long, block binary")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text", 8 << 20):
                ids, press = np.asarray(piece.column("id")), zstandard.ZstdCompressor(level=1)
                texts = pa.array([press.compress(t.as_py()) for t in piece.column("text").cast(pa.binary())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part_of(ids, parts)), piece.column("id"), texts], names=["part", "id", "data"])

    placed = docs.mapInArrow(place, "part long, id long, data binary").select("part", F.lit(1).alias("turn"), "id", "data")
    both = found.select("part", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("id"), F.col("block").alias("data")).union(placed)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, of, open_ = None, [], {}, zstandard.ZstdDecompressor()
        for batch in batches:
            for piece in chunks(batch, "data", 1 << 20):
                rows: list[list] = [[], [], [], []]
                for p, turn, i, data in zip(*(piece.column(c).to_pylist() for c in ("part", "turn", "id", "data")), strict=True):
                    if p != part:
                        part, blocks, of = p, [], {}
                    if turn == 0:
                        blocks.append(data)
                        continue
                    if blocks:
                        of, blocks = merged(blocks), []
                    data = open_.decompress(data)
                    spans = of.get((i, xxhash.xxh32_intdigest(data)))
                    kept, at = [], 0
                    for a, b in spans if spans is not None else ():
                        kept.append(data[at:a])
                        at = b
                    kept.append(data[at:])
                    for col, v in zip(rows, (None if i == NO_ID else i, len(data), [] if spans is None else [{"start": int(a), "stop": int(b)} for a, b in spans], b"".join(kept)), strict=True):
                        col.append(v)
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "n_bytes", "removed", "kept"])

    return both.repartition(tasks, "part").sortWithinPartitions("part", "turn").mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")


def segments(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, bytes, offsets of all documents in it): whole slices, but a longer one in segments that overlap by length - 1."""
    most = 1 << PLACE_BITS
    if len(raw) <= most:
        yield 0, raw, offsets
        return
    for lo in range(0, len(raw) - length + 1, most - length + 1):
        hi = min(lo + most, len(raw))
        yield lo, raw[lo:hi], np.clip(offsets, lo, hi) - lo


def bucket_suffixes(blocks: list[bytes], k: int, passes: int, length: int, half: int, covered: Intervals) -> None:
    """Adds what the runs of one bucket (those of pass k by their anchor) cover."""
    cols: list[list[np.ndarray]] = [[] for _ in range(8)]
    for block in blocks:
        ids, tags, start, width, off, text = unpack_block(block, ("<u4", "u1", "u1"))
        width = width.astype(np.int64)
        begin = np.cumsum(width) - width
        words = words_at_each(text)
        gram = words[begin + off]
        if passes > 1:
            own = mix(gram * M2) % np.uint64(passes) == k
            w = width[own]
            text = text[np.repeat(begin[own] - (np.cumsum(w) - w), w) + np.arange(w.sum())]
            ids, tags, start, off, gram, width = ids[own], tags[own], start[own], off[own], gram[own], w
        for c, v in zip(cols, (ids, tags, start, width, off, gram, text), strict=False):
            c.append(v)
    ids, tags, start, width, off, gram, raw = (np.concatenate(c) for c in cols[:7])
    if not len(ids):
        return
    begin = np.cumsum(width) - width
    # runs of an anchor that one run alone has are done with
    order, head = classes(gram, gram)
    many = np.zeros(len(ids), bool)
    size = np.diff([*head, len(order)])
    many[order] = np.repeat(size > 1, size)
    live = np.flatnonzero(many)
    if not len(live):
        return
    ids, tags, start, width, off, gram, begin = (x[live] for x in (ids, tags, start, width, off, gram, begin))
    off = off.astype(np.int64)
    words = words_at_each(raw)
    order, head = verified(words, begin, width, *classes(*text_digests(words, begin, width)))
    size = np.diff([*head, len(order)])
    of_class = np.empty(len(order), np.int64)
    of_class[order] = np.repeat(np.arange(len(head)), size)
    least = np.minimum.reduceat(ids[order], head)
    later = ids > least[of_class]
    covered.add(ids[later], tags[later], start[later], start[later] + width[later])
    # one run of each class, if another class shares `half` bytes on a side of the anchor
    rep = order[head]
    share = np.zeros(len(rep), bool)
    for left in (False, True):
        room = off[rep] if left else width[rep] - off[rep] - GRAM
        has = np.flatnonzero(room >= half)
        if not len(has):
            continue
        at = begin[rep[has]] + off[rep[has]] - (half if left else 0)
        da, db = text_digests(words, at, np.full(len(has), half + GRAM))
        o, h = classes(da, db)
        n = np.diff([*h, len(o)])
        share[has[o]] |= np.repeat(n > 1, n)
    picked = np.flatnonzero(share)
    if not len(picked):
        return
    own = rep[picked]
    count = width[own] - length + 1
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    run = np.repeat(np.arange(len(own)), count)
    places = begin[own][run] + within
    order, head = deep_shallow(raw, places, length)
    doc = least[picked][run]
    hit = doc > least_of_class(order, head, doc)
    if not hit.any():
        return
    same = run[1:] == run[:-1]
    first = np.flatnonzero(hit & ~np.r_[False, same & hit[:-1]])
    last = np.flatnonzero(hit & ~np.r_[same & hit[1:], False])
    # all runs of the class in its first document are covered alike
    rank = np.full(len(rep), -1)
    rank[picked] = np.arange(len(picked))
    members = np.flatnonzero(~later & (rank[of_class] >= 0))
    members = members[np.argsort(rank[of_class[members]], kind="stable")]
    at = rank[of_class[members]]
    lo, hi = np.searchsorted(at, run[first], side="left"), np.searchsorted(at, run[first], side="right")
    times = hi - lo
    who = members[np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    a, b = np.repeat(within[first], times), np.repeat(within[last] + length, times)
    covered.add(ids[who], tags[who], start[who] + a, start[who] + b)


def merged(blocks: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
    """Disjoint, ascending intervals of each document."""
    cols = [unpack_block(b, ("<u4", "<u4")) for b in blocks]
    ids, tags, start, stop = (np.concatenate([c[k] for c in cols]) for k in range(4))
    order = np.lexsort((start, tags, ids))
    ids, tags, start, stop = ids[order], tags[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    new_doc = np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]
    doc = np.cumsum(new_doc) - 1
    base = doc * (1 << 33)  # documents one after another on one line
    reach = np.maximum.accumulate(stop + base)
    new = np.r_[True, (start + base)[1:] > reach[:-1]]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:] - 1, len(start) - 1]
    spans = np.stack([start[begin], reach[end] - base[end]], axis=1)
    cuts = np.flatnonzero(np.r_[True, doc[begin][1:] != doc[begin][:-1]])
    return {(int(ids[begin[a]]), int(tags[begin[a]])): spans[a:b] for a, b in zip(cuts, [*cuts[1:], len(begin)], strict=True)}

