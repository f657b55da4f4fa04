"""Substring dedup by line and sentence hashing: normalised units are digested, the earliest ranked copy stays, the others go.

A document's units begin where a line or a sentence begins. Each such place has two: the one that runs to the end of its line and
the one that runs to the end of its sentence (a line's unit only from a line's beginning), both joined with the lines or sentences that follow until
the unit has `unit_words` words. So short lines and sentences are not judged alone, where they repeat by chance, but are removed with
the text they repeat with. The last line and the last sentence of a text are joined with those before them. A passage is found inside a longer line, and also where its lines are broken at other places. A text of fewer
words is one unit.

A sentence ends at . ! or ? (with closing quotes or brackets) before white space, at an empty line and at the end of the text.
A unit is normalised (A-Z lower-cased, each run of ASCII white space made one space, trimmed) and its 128-bit digest
taken; one without words is none. Digests are grouped over all documents; the copy with the least (doc_id, offset) stays,
every other is removed. Removed units keep their offsets in the original text and the doc_id in which the text stays.
Where a copy overlaps the one that stays, only what lies beyond that one goes.

Skew: the group of a digest is only a count and a minimum, combined before the shuffle; its units then meet that one
row in an equi-join that adaptive execution can split. No group is ever gathered.

Defined results: a null text counts as empty; an empty text has no units. Rows that repeat a doc_id are
ranked by a hash of their texts and are cleaned each on its own; rows that repeat doc_id and text are cleaned alike. A null
doc_id ranks first. A removed run that begins a line takes its line break with it, any other the spaces before it. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import chunks, clean_documents, materialise

#: Ends of sentences: closing marks, or an empty line.
SENTENCE_END = re.compile(r"[.!?]+[\"'”’»)\]]*(?=[ \t\r\n\f\v])|\n[ \t\r\f\v]*(?=\n)")
LINE_END = re.compile("\n")
WORD = re.compile(r"[^ \t\r\n\f\v]+")
NO_ID = -(2**63)
UNIT = "hi long, lo long, doc_id long, mark long, start int, stop int"
REMOVED = "array<struct<start:int,stop:int,kept_in:long>>"


def spans_of_units(text: str, unit_words: int) -> set[tuple[int, int]]:
    """(start, stop) of each unit, trimmed."""
    words = [m.span() for m in WORD.finditer(text)]
    if len(words) < unit_words:
        return {(words[0][0], words[-1][1])} if words else set()
    begin, end = np.array(words).T

    def last_words(ends: list[int]) -> np.ndarray:
        last = np.unique(np.searchsorted(begin, [*ends, len(text)]) - 1)
        return last[last >= 0]

    lines = last_words([m.start() for m in LINE_END.finditer(text)])
    sentences = last_words([m.start() + len(m[0].rstrip()) for m in SENTENCE_END.finditer(text)])
    out = set()
    of_line = np.r_[0, lines[:-1] + 1]
    for first, last in ((of_line, lines), (np.union1d(of_line, np.r_[0, sentences[:-1] + 1]), sentences)):
        k = np.searchsorted(last, first + unit_words - 1)  # the first end that leaves enough words
        whole = k < len(last)
        out.update(zip(begin[first[whole]].tolist(), end[last[k[whole]]].tolist(), strict=True))
        out.add((int(begin[first[first <= len(words) - unit_words][-1]]), int(end[-1])))
    return out


def units(df: DataFrame, unit_words: int, slice_bytes: int = 2 << 20) -> DataFrame:
    """hi, lo (the digest), doc_id, mark (hash of the text), start, stop (code points) of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", slice_bytes):
                rows: list[list] = [[], [], [], []]
                digests = []
                for doc_id, mark, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "mark", "text")), strict=True):
                    for a, b in sorted(spans_of_units(text, unit_words)):
                        for col, v in zip(rows, (doc_id, mark, a, b), strict=True):
                            col.append(v)
                        digests.append(xxhash.xxh3_128_digest(b" ".join(text[a:b].encode().lower().split())))
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                cols = [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(cols, names=["hi", "lo", "doc_id", "mark", "start", "stop"])

    return df.mapInArrow(run, UNIT)


def _marked(df: DataFrame) -> DataFrame:
    return clean_documents(df).select("doc_id", F.xxhash64("text").alias("mark"), "text")


def repeated_units(df: DataFrame, unit_words: int = 10) -> DataFrame:
    """The units to remove: doc_id, mark, start, stop, kept_in (the doc_id in which the text stays)."""
    every = materialise(units(_marked(df), unit_words), "units")
    rank = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("mark").alias("m"), F.col("start").alias("a"), F.col("stop").alias("b"))
    first = every.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min(rank).alias("r")).where("n > 1").drop("n")
    first = materialise(first, "repeated")  # so that the join is one of two plain shuffles, which adaptive execution can split
    both = every.join(first.hint("merge"), ["hi", "lo"]).where(rank != F.col("r"))
    same = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("r.d")) & (F.col("mark") == F.col("r.m"))
    start = F.when(same, F.greatest("start", "r.b")).otherwise(F.col("start"))
    return both.select("doc_id", "mark", start.alias("start"), "stop", F.nullif(F.col("r.d"), F.lit(NO_ID)).alias("kept_in")).where("start < stop")


def without(text: str, removed: list[tuple[int, int]]) -> str:
    """text without the union of the spans; a run that begins a line takes its line break, any other the spaces before it."""
    runs: list[list[int]] = []
    for a, b in sorted(removed):
        if runs and not text[runs[-1][1] : a].strip(" \t\r\n\f\v"):  # white space between two removed units goes with them
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    kept, at, new_line = [], 0, True
    for a, b in runs:
        before = text[at:a].rstrip(" \t")
        if before:
            kept.append(before)
            new_line = before.endswith("\n")
        if new_line:
            while b < len(text) and text[b] in " \t\r":
                b += 1
            b += text[b : b + 1] == "\n"
        at = b
    return "".join([*kept, text[at:]])


def remove_repeats(df: DataFrame, unit_words: int = 10) -> DataFrame:
    """doc_id, text (input), removed (array of start, stop, kept_in by start), kept_text; one row for each row of df."""
    gone = repeated_units(df, unit_words).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "kept_in"))).alias("removed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                kept = [without(t, [(x["start"], x["stop"]) for x in r]) if r else t for t, r in zip(part.column("text").to_pylist(), part.column("removed").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), part.column("removed"), pa.array(kept, pa.string())], names=["doc_id", "text", "removed", "kept_text"])

    docs = _marked(df)
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (docs["mark"] == gone["mark"])
    both = docs.join(gone, same, "left").select(docs["doc_id"], docs["text"], gone["removed"])
    return both.mapInArrow(run, f"doc_id long, text string, removed {REMOVED}, kept_text string")
