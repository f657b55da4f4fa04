"""BPE encoding and decoding with a priority queue of merge ranks over a doubly linked symbol list.

Each piece of text that the pre-tokenizer cuts off starts as a doubly linked list of byte symbols. A heap holds the
adjacent pairs that have a merge, by (rank, place). The least entry is popped; if either symbol has changed since
it was pushed the entry is stale and is skipped, otherwise the right symbol is unlinked, the left one takes the
merged id, and its two new neighbour pairs are pushed. Decoding concatenates the vocabulary's byte strings.

Defined results: a null text counts as empty, and an empty text has no ids and decodes to "". The text of an added
token (for example the end marker) becomes that token's one id. Rows are handled one by one, so repeated rows, ties
and an empty table need nothing special; other columns of the input are returned unchanged unless the output has a
column of that name, which then replaces it. Memory is bounded by one slice of rows and a piece cache of fixed size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm.common import chunks

#: Fixed value: the split pattern of byte-level BPE vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Ranges of code points that the regex module and the library's splitter class alike; a text with any other is split by the library.
ALIKE = ((0x0, 0x557), (0x890, 0xC5B), (0xCDD, 0x208E), (0x20A0, 0xA7CD), (0xAB6E, 0xD7FF), (0xE000, 0xFFFF), (0x1E700, 0x2B739))
UNSURE = re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ALIKE) + "]")

#: Pieces kept per worker process. Beyond it the cache starts anew; this bounds memory and changes no result.
CACHED_PIECES = 300_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE tokenizer read from the bytes of a tokenizer.json."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level BPE files without a normalizer or prefix space are supported")
        symbol = byte_symbols()
        byte_of = {c: b for b, c in symbol.items()}
        vocab = spec["model"]["vocab"]
        self.base = [vocab[symbol[b]] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): (n, vocab[a + b]) for n, (a, b) in enumerate(pairs)}
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        if any(x.get("single_word") or x.get("lstrip") or x.get("rstrip") for x in spec.get("added_tokens") or []):
            raise ValueError("added tokens that strip or need word ends are not supported")
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.added_at = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pieces = regex.compile(PIECES).findall
        self.cache: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if UNSURE.search(text):
            from tokenizers import pre_tokenizers

            spans = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
            return [text[a:b] for _, (a, b) in spans]
        return self.pieces(text)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.base[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        prev, after, rank = list(range(-1, n - 1)), [*range(1, n), -1], self.rank
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale
            ids[i], ids[j], k = new, -1, after[j]
            after[i] = k
            if k >= 0:
                prev[k] = i
                if r := rank.get((new, ids[k])):
                    heapq.heappush(heap, (r[0], i, new, ids[k], r[1]))
            h = prev[i]
            if h >= 0 and (r := rank.get((ids[h], new))):
                heapq.heappush(heap, (r[0], h, ids[h], new, r[1]))
        return [x for x in ids if x >= 0]

    def pieces_to_bytes(self, text: str) -> bytes:
        cache, out = self.cache, self.split(text)
        try:
            return b"".join([cache[p] for p in out])
        except KeyError:
            pass
        for p in set(out):
            if p not in cache:
                cache[p] = b"".join(i.to_bytes(4, "little") for i in self.merge(p.encode()))
        got = b"".join([cache[p] for p in out])
        if len(cache) > CACHED_PIECES:
            cache.clear()
        return got

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.added_at and self.added_at.search(text):
            return b"".join(self.added[x].to_bytes(4, "little") if x in self.added else self.pieces_to_bytes(x) for x in self.added_at.split(text))
        return self.pieces_to_bytes(text)

    def decode(self, ids: bytes) -> str:
        words = memoryview(ids).cast("I").tolist()
        return b"".join(map(self.bytes_of.__getitem__, words)).decode("utf-8", "replace")


_LOADED: dict[str, Tokenizer] = {}


def loaded(source: bytes) -> Tokenizer:
    """One tokenizer per worker process and file."""
    key = hashlib.sha256(source).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(source)
    return _LOADED[key]


def encode_decode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", slice_bytes: int = 4 << 20) -> DataFrame:
    """df with the ids of its text (binary, little-endian unsigned 32-bit) and, unless decoded is None, the text decoded from them.

    tokenizer_path is read by the driver and its content broadcast, about 1.5 MB whatever the data.
    """
    with open(tokenizer_path, "rb") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    made = [ids] + ([decoded] if decoded else [])
    # the text travels in a column of its own, so that an output column may have the name of an input column
    inner = df.select(*[df[c] for c in df.columns if c not in made], F.coalesce(df[text], F.lit("")).alias("__text"))
    keep = inner.columns[:-1]
    schema = T.StructType([f for f in inner.schema.fields if f.name != "__text"] + [T.StructField(ids, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(source.value)
        for batch in batches:
            for part in chunks(batch, "__text", slice_bytes):
                coded = [tok.encode(t) for t in part.column("__text").to_pylist()]
                cols = [part.column(c) for c in keep] + [pa.array(coded, pa.binary())]
                if decoded:
                    cols.append(pa.array([tok.decode(c) for c in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=keep + made)

    return inner.mapInArrow(run, schema)
