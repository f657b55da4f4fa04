"""Context-triggered piecewise hashing: fingerprints that stay alike where texts stay alike.

A rolling hash over the last 7 bytes ends a chunk wherever it hits the block size; each chunk gives one character. The
block size is 3 * 2^k, the largest that gives `least` characters (or the smallest one); where a short text repeats so that this gives more
than `most` characters (each byte of a long run may end a chunk), it is the next larger one. A second signature is
taken at twice the size, so that texts whose block sizes differ by a factor of two can be compared. Likeness is taken
from the edit distance (insertions and deletions) of signatures at one block size, 1 - distance / both lengths, if they
share a run of 7 characters (half of the shorter one, if that is less); 0 otherwise. Signatures are never cut: every byte of a text is in a chunk.

Each document is also compared with an edited copy of itself and with its neighbour in descending doc_id order. Documents are
dealt by ranges of doc_id and streamed; only the first and last document of each range meet in a second, small step.

Defined results: a null text counts as empty, whose fingerprint is "3::"; equal fingerprints have likeness 1. Rows with one
doc_id follow each other in the order of their texts; null doc_ids come last. The neighbour of the last row is the first, so
a single row is its own neighbour. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.common import clean_documents, materialise

WINDOW, SMALLEST = 7, 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SCHEMA = "kind int, part long, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
RESULT, HEAD, TAIL = 0, 1, 2


def rolling(raw: np.ndarray) -> np.ndarray:
    """The hash of the 7 bytes that end at each place: their sum, their weighted sum and their shifted exclusive or."""
    n = len(raw)
    c = np.zeros(n + WINDOW - 1, np.uint32)
    c[WINDOW - 1 :] = raw
    out, shifted = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for j in range(WINDOW):  # j bytes back
        x = c[WINDOW - 1 - j : WINDOW - 1 - j + n]
        out += x * np.uint32(1 + WINDOW - j)
        shifted ^= x << np.uint32(5 * j) if 5 * j < 32 else np.uint32(0)
    return out + shifted


def signature(data: bytes, ends: list[int]) -> str:
    view, out, at = memoryview(data), [], 0
    for e in ends:
        out.append(ALPHABET[zlib.crc32(view[at:e]) & 63])
        at = e
    if at < len(data):
        out.append(ALPHABET[zlib.crc32(view[at:]) & 63])
    return "".join(out)


def fingerprint(data: bytes, least: int = 32, most: int = 256) -> str:
    """block size : signature at it : signature at twice the size; each signature has `most` characters at most."""
    if not data:
        return f"{SMALLEST}::"
    after = rolling(np.frombuffer(data, np.uint8)) + np.uint32(1)
    at = np.flatnonzero(after % np.uint32(SMALLEST) == 0)  # ends of chunks at block size 3
    size = after[at]
    k = max(0, (len(data) // (SMALLEST * 2 * least)).bit_length())
    while True:
        ends = at[(size & np.uint32((1 << k) - 1)) == 0]
        if k == 0 or len(ends) + 1 >= least:
            break
        k -= 1
    while len(ends) + 1 > most:  # the ends at a size are some of those at half of it
        k += 1
        ends = at[(size & np.uint32((1 << k) - 1)) == 0]
    twice = at[(size & np.uint32((2 << k) - 1)) == 0]
    return f"{SMALLEST << k}:{signature(data, (ends + 1).tolist())}:{signature(data, (twice + 1).tolist())}"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, all cells of a column at once in one integer."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def signature_likeness(a: str, b: str, run: int = 7) -> float:
    if a == b:
        return 1.0
    run = min(run, (min(len(a), len(b)) + 1) // 2)
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    distance = len(a) + len(b) - 2 * common_subsequence(a, b)
    return 1 - distance / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 0 if the block sizes are not the same or a factor of two apart."""
    if x == y:
        return 1.0
    (m, a, a2), (n, b, b2) = x.split(":"), y.split(":")
    m, n = int(m), int(n)
    if m == n:
        return max(signature_likeness(a, b), signature_likeness(a2, b2))
    if m == 2 * n:
        return signature_likeness(a, b2)
    if n == 2 * m:
        return signature_likeness(a2, b)
    return 0.0


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as many first characters of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare(doc_id, text: str, own: str, following: str, next_fp: str) -> tuple:
    new = edited(text, following).encode()
    new_fp = own if new == text.encode() else fingerprint(new)
    return (RESULT, None, doc_id, None, len(text), hashlib.sha256(new).hexdigest(), own, new_fp, likeness(own, new_fp), likeness(own, next_fp))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, rows = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = value.as_py()
            own = fingerprint(text.encode())
            if last is None:
                rows.append((HEAD, part, doc_id, text, *[None] * 6))
            else:
                rows.append(compare(*last, text, own))
            last = (doc_id, text, own)
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
    if last is not None:
        rows.append((TAIL, part, last[0], last[1], *[None] * 6))
        yield _batch(rows)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [compare(d, t, fingerprint(t.encode()), f, fingerprint(f.encode())) for d, t, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True)]
        if rows:
            yield _batch(rows)


def compare_neighbours(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row for each row of df."""
    down = F.col("doc_id").desc_nulls_last()
    ordered = clean_documents(df).repartitionByRange(down).sortWithinPartitions(down, "text")
    found = materialise(ordered.mapInArrow(_along, SCHEMA), "ctph")
    # one head and one tail for each partition; only the partitions' numbers are put in order in one task
    heads, tails = found.where(F.col("kind") == HEAD), found.where(F.col("kind") == TAIL)
    up = Window.orderBy("part")
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    next_part = heads.select("part").select("part", F.coalesce(F.lead("part").over(up), F.first("part").over(whole)).alias("next"))
    following = next_part.join(heads.select(F.col("part").alias("next"), F.col("text").alias("following")).hint("merge"), "next")
    closed = tails.select("part", "doc_id", "text").join(following.hint("merge"), "part").select("doc_id", "text", "following").mapInArrow(_ends, SCHEMA)
    return found.where(F.col("kind") == RESULT).union(closed).drop("kind", "part", "text")
