"""Token ids as one wavelet matrix per shard: succinct bit planes with rank and select, in one compressed file.

A shard holds the ids of consecutive documents in ascending doc_id order, each closed by an end id. Its file is

    magic "WMX2" | header length (u32) | header (JSON: tokens, documents, bits, zeros of each plane, sizes of the parts)
    | doc_id (i64) | tokens per document (u32) | for each bit plane, highest first: the block of every 4096th zero, the same of
    ones (u32), the ones before each block of 512 bits (u64), and the plane's words in parts of 64 KiB

each part compressed by itself (zstd). Access, rank (count of an id in a prefix), select (place of the k-th occurrence),
count and locate work on the file alone and open just the parts they touch; one document's ids are read by access at its
places, those of all documents by select of all places at once. Shards are stored as binary rows of a table in the shared folder, so that any store Spark can write
takes them; at most `shard_tokens` tokens (and at least one document) go into one, which bounds a task's memory.

Defined results: a null or empty text is one end id; repeated doc_ids are kept, each row on its own, in the order of
(doc_id, text); null doc_ids come first; an empty table has no shards; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.bpe import ALIKE, PIECES, UNSURE
from voxmill.llm.common import chunks, clean_documents, materialise, string_bytes

MAGIC = b"WMX2"
#: Entries of each lookup table of a worker process. Beyond it the table starts anew; this bounds memory and changes no result.
CACHED_PIECES = 1_200_000
#: Bits of a plane for each stored count of ones, ones (or zeros) for each stored place, and words of a block that is compressed by itself.
BLOCK, SAMPLE, PLANE_WORDS = 512, 4096, 8192
NONE = np.zeros(0, "<u8")
#: Chunks in which white space touches a cut, or that are a line break alone.
_SPACE = r"[ \t\f\r\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LOOSE = f"^\n?({_SPACE}|$)|{_SPACE}$"
UNSURE_RE2 = "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ALIKE if a != 0xE000) + "\\x{e000}-\\x{ffff}]"


def document_ids(file: bytes, k: int) -> np.ndarray:
    """The ids of the file's k-th document (from 0), by access at its places."""
    wm, _, counts = unpack(file)
    start = int(counts[:k].sum())
    return wm.access_many(np.arange(start, start + int(counts[k])))


class Plane:
    """One bit plane: its words, the ones before each block of BLOCK bits, and the block of every SAMPLE-th one and zero."""

    def __init__(self, n: int, words: Words, ranks: np.ndarray, samples: tuple[np.ndarray, np.ndarray]):
        self.n, self.words, self.ranks, self.samples = n, words, ranks, samples

    def ones(self, i: int) -> int:
        """Ones among the first i bits: a stored count and the words of one block."""
        block, word = i // BLOCK, i // 64
        tail = self.words.cut(block * (BLOCK // 64), min(word + 1, self.words.n)) if i % BLOCK else NONE
        got = int(self.ranks[block])
        if len(tail):
            whole = word - block * (BLOCK // 64)
            got += int(np.bitwise_count(tail[:whole]).sum())
            got += (int(tail[whole]) & ((1 << i % 64) - 1)).bit_count() if i % 64 else 0
        return got

    def bit(self, i: int) -> int:
        return int(self.words.cut(i // 64, i // 64 + 1)[0]) >> i % 64 & 1

    def place(self, value: int, nth: int) -> int:
        """Where the nth (from 0) bit of that value is; the caller knows that there is one."""
        sample = self.samples[value]
        k = nth // SAMPLE
        lo, hi = int(sample[k]), int(sample[k + 1]) if k + 1 < len(sample) else len(self.ranks) - 1
        before = self.ranks[lo : hi + 1].astype(np.int64)
        if not value:
            before = np.arange(lo, hi + 1) * BLOCK - before
        block = lo + int(np.searchsorted(before, nth, side="right")) - 1
        first = block * (BLOCK // 64)
        bits = unpacked(self.words.cut(first, min(first + BLOCK // 64, self.words.n)), self.n - block * BLOCK)
        return block * BLOCK + int(np.flatnonzero(bits == value)[nth - int(before[block - lo])])


def unpacked(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little", count=min(n, 64 * len(words)))


class Words:
    """The 64-bit words of a plane, in blocks that are decompressed one by one as they are asked for."""

    def __init__(self, n: int, blocks: list):
        self.n, self.blocks, self.open = n, blocks, {}

    def block(self, k: int) -> np.ndarray:
        if k not in self.open:
            self.open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.blocks[k]), "<u8")
        return self.open[k]

    def cut(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return NONE
        i, j = a // PLANE_WORDS, (b - 1) // PLANE_WORDS
        if i == j:
            return self.block(i)[a - i * PLANE_WORDS : b - i * PLANE_WORDS]
        return np.concatenate([self.block(k) for k in range(i, j + 1)])[a - i * PLANE_WORDS : b - i * PLANE_WORDS]


class WaveletMatrix:
    """A sequence of unsigned integers as bit planes, highest first; the zeros of a plane lead the next one in order."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[Plane]):
        self.n, self.bits, self.zeros, self.planes = n, bits, zeros, planes

    def access(self, i: int) -> int:
        out = 0
        for zeros, plane in zip(self.zeros, self.planes, strict=True):
            bit, ones = plane.bit(i), plane.ones(i)
            i = zeros + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def access_many(self, at: np.ndarray) -> np.ndarray:
        """The values at many places, all of them one plane further at a time; a plane's ranks are unfolded once for all."""
        out = np.zeros(len(at), np.uint32 if self.bits > 16 else np.uint16)
        at = at.astype(np.int32 if self.n < 1 << 31 else np.int64)
        for zeros, plane in zip(self.zeros, self.planes, strict=True):
            bits = unpacked(plane.words.cut(0, plane.words.n), self.n)
            # where each bit goes: ones after all zeros, both in their order
            ones = np.cumsum(bits, dtype=at.dtype)
            goes = np.where(bits.view(bool), ones + at.dtype.type(zeros - 1), np.arange(self.n, dtype=at.dtype) - ones)
            out = (out << out.dtype.type(1)) | bits[at]
            at = goes[at]
        return out

    def every(self) -> np.ndarray:
        """All values in order: from the lowest plane up, each place's value goes to where select puts it in the plane above."""
        now = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for k in range(self.bits - 1, -1, -1):
            plane, zeros = self.planes[k], self.zeros[k]
            one = unpacked(plane.words.cut(0, plane.words.n), self.n).view(bool)
            up = np.empty_like(now)
            up[~one] = now[:zeros]
            up[one] = now[zeros:] | now.dtype.type(1 << (self.bits - 1 - k))
            now = up
        return now

    def _narrow(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for k, (zeros, plane) in enumerate(zip(self.zeros, self.planes, strict=True)):
            a, b = plane.ones(lo), plane.ones(hi)
            lo, hi = (zeros + a, zeros + b) if value >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value among the first i."""
        if value < 0 or value >> self.bits:
            return 0
        lo, hi = self._narrow(value, 0, i)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _up(self, value: int, at: int) -> int:
        for k in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - k) & 1
            at = self.planes[k].place(bit, at - self.zeros[k] if bit else at)
        return at

    def select(self, value: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of value; -1 if there are fewer."""
        if nth < 0 or value < 0 or value >> self.bits:
            return -1
        lo, hi = self._narrow(value, 0, self.n)
        return self._up(value, lo + nth) if lo + nth < hi else -1

    def locate(self, value: int) -> list[int]:
        """All places of value, in order."""
        if value < 0 or value >> self.bits:
            return []
        lo, hi = self._narrow(value, 0, self.n)
        return [self._up(value, k) for k in range(lo, hi)]


def build(values: np.ndarray, bits: int) -> tuple[list[int], list[np.ndarray]]:
    """The zeros of each plane and its bits, packed in little-endian 64-bit words."""
    now, zeros, planes = values, [], []
    for level in range(bits - 1, -1, -1):
        one = (now & now.dtype.type(1 << level)).astype(bool)
        packed = np.packbits(one, bitorder="little")
        planes.append(np.pad(packed, (0, -len(packed) % 8)).view("<u8"))
        low = now[~one]
        zeros.append(len(low))
        now = np.concatenate([low, now[one]])
    return zeros, planes


def pack(values: np.ndarray, doc_ids: list, counts: np.ndarray, bits: int) -> bytes:
    """The file of one shard."""
    press = zstandard.ZstdCompressor(level=1).compress
    zeros, planes = build(values, bits)
    known = np.array([-1 if d is None else d for d in doc_ids], "<i8")
    parts = [press(x.tobytes()) for x in (known, counts.astype("<u4"))]
    for words in planes:
        per = np.bitwise_count(np.pad(words, (0, -len(words) % (BLOCK // 64)))).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(per)])
        ends = np.minimum(np.arange(len(ranks)) * BLOCK, len(values)) - ranks  # zeros before each block
        for before in (ends, ranks):  # the block of every SAMPLE-th zero, then one
            parts.append(press((np.searchsorted(before, np.arange(0, before[-1], SAMPLE), side="right") - 1).astype("<u4").tobytes()))
        parts.append(press(ranks.astype("<u8").tobytes()))
        parts += [press(words[k : k + PLANE_WORDS].tobytes()) for k in range(0, len(words), PLANE_WORDS)]
    head = {"n": len(values), "docs": len(doc_ids), "bits": bits, "zeros": zeros, "null_docs": sum(d is None for d in doc_ids), "parts": [len(p) for p in parts]}
    text = json.dumps(head).encode()
    return b"".join([MAGIC, struct.pack("<I", len(text)), text, *parts])


def unpack(file: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """The matrix, whose planes are opened block by block as needed, the doc_ids and the tokens of each."""
    if file[:4] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    size = struct.unpack_from("<I", file, 4)[0]
    head, at, parts, view = json.loads(file[8 : 8 + size]), 8 + size, [], memoryview(file)
    for p in head["parts"]:
        parts.append(view[at : at + p])
        at += p
    load = lambda part, kind: np.frombuffer(zstandard.ZstdDecompressor().decompress(part), kind)
    n, take = head["n"], iter(parts[2:])
    words = -(-n // 64)
    planes = []
    for _ in range(head["bits"]):
        samples = load(next(take), "<u4"), load(next(take), "<u4")
        ranks = load(next(take), "<u8")
        planes.append(Plane(n, Words(words, [next(take) for _ in range(-(-words // PLANE_WORDS))]), ranks, samples))
    docs = load(parts[0], "<i8").tolist()
    return WaveletMatrix(n, head["bits"], head["zeros"], planes), [None] * head["null_docs"] + docs[head["null_docs"] :], load(parts[1], "<u4")


class Numbers(dict):
    """Numbers of chunks; -1 for one that has none."""

    def __missing__(self, chunk: str) -> int:
        return -1


class LibraryEncoder:
    """The tokenizers library's ids of whole texts, each distinct chunk encoded once by the library and then looked up.

    Byte-level BPE never merges across pieces, and the splitter always cuts before a space or a line break that stands
    between two other characters. So a slice of texts is cut there, its distinct chunks are found by Arrow's dictionary coding,
    and the ids of every chunk are put together by one take. A chunk is a word with the space or the line break before it.
    Texts with runs of white space are split into pieces one by one; texts with an added token, or with code points that the
    two splitters may class differently, go to the library whole.
    """

    def __init__(self, source: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(source.decode())
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.bits, self.dtype = id_width(source)
        self.spaced = np.array([(self.tok.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.split, self.pieces = regex.compile(PIECES).findall, {}
        self.line_break = self.whole("\n")
        self.one_break = len(self.line_break) == self.dtype.itemsize
        self.forget()

    def forget(self) -> None:
        """Starts the table of chunks anew: chunk to number, and the ids of all numbers end to end; number 0 has none."""
        self.known = Numbers()
        self.coded = pa.array([b""], pa.large_binary())

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def whole(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def of_pieces(self, out: list[str]) -> bytes:
        known = self.pieces
        new = [p for p in dict.fromkeys(out) if p not in known]
        for p in new:
            known[p] = self.whole(p)
        got = b"".join([known[p] for p in out])
        if len(known) > CACHED_PIECES:
            known.clear()
        return got

    def learn(self, new: pa.Array) -> None:
        """Numbers new chunks: a word after a space, or a line break with the first word of its line.

        All of a kind go to the library in one call. What begins each chunk, and nothing else of it, is an id of a string with a
        leading space, or the line break's id. A chunk in which white space touches a cut gets the number 0.
        """
        loose = pc.match_substring_regex(new, LOOSE)
        self.known.update(dict.fromkeys(new.filter(loose).to_pylist(), 0))
        sound = new.filter(pc.invert(loose))
        line = pc.starts_with(sound, "\n")
        words, lines = sound.filter(pc.invert(line)).to_pylist(), sound.filter(line).to_pylist()
        for own, joined, begins in ((words, " " + " ".join(words), self.spaced.__getitem__), (lines, "".join(lines), lambda ids: ids == int.from_bytes(self.line_break, "little"))):
            if own:
                ids = self.ids(joined)
                cuts = np.append(np.flatnonzero(begins(ids)), len(ids)) * self.dtype.itemsize
                base = len(self.coded)
                made = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids)])
                self.coded = pa.concat_arrays([self.coded, made])
                self.known.update(zip(own, range(base, base + len(own)), strict=True))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a slice."""
        if not len(texts):
            return []
        hard = pc.match_substring_regex(texts, UNSURE_RE2)
        for s in self.special:
            hard = pc.or_(hard, pc.match_substring(texts, s))
        hard = np.asarray(hard) | (not self.one_break)
        if len(self.known) > CACHED_PIECES:
            self.forget()
        # each text begins like a line; the id of that line break is left out again
        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n"), " ")
        offsets = np.asarray(cut.offsets).astype(np.int64)
        flat = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        index = np.array(flat.indices)
        # neither the empty chunk before each text's own line break nor chunks of texts that are not looked up need be known
        use = ~np.repeat(hard, np.diff(offsets))
        use[offsets[:-1]] = False
        wanted = np.zeros(len(flat.dictionary), bool)
        wanted[index[use]] = True
        chunks_, known = flat.dictionary.filter(pa.array(wanted)), self.known
        own = chunks_.to_pylist()
        numbers = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            self.learn(chunks_.take(pa.array(new)))
            numbers[new] = [known[own[k]] for k in new.tolist()]
        number = np.zeros(len(wanted), np.int64)
        number[wanted] = numbers
        number = np.where(use, number[index], 0)
        hard = hard | (np.add.reduceat(use & (number == 0), offsets[:-1]) > 0)
        raw, at = string_bytes(self.coded.take(pa.array(number)))
        view, at, skip = memoryview(raw), at[offsets], len(self.line_break)
        return [self.slowly(texts[k].as_py()) if slow else bytes(view[at[k] + skip : at[k + 1]]) for k, slow in enumerate(hard.tolist())]

    def slowly(self, text: str) -> bytes:
        if not text.isascii() and UNSURE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return self.of_pieces(self.split(text))

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]


def id_width(source: bytes) -> tuple[int, np.dtype]:
    """Bits of the largest id of a tokenizer.json, and the kind that holds them."""
    spec = json.loads(source)
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or [])])
    bits = max(1, top.bit_length())
    return bits, np.dtype("<u2" if bits <= 16 else "<u4")


_ENCODERS: dict[int, LibraryEncoder] = {}


def encoder(source: bytes) -> LibraryEncoder:
    key = zlib.crc32(source)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(source)
    return _ENCODERS[key]


def write_shards(df: DataFrame, tokenizer_path: str, end_id: int = 0, shard_tokens: int = 1 << 20, slice_bytes: int = 4 << 20) -> DataFrame:
    """Shard files in ascending doc_id order, written once and read back.

    shard_part, shard_seq (their order), part_start (tokens of its part before it), n_tokens, n_docs, file (binary).
    Texts are dealt out by ranges of doc_id (two-byte ids of them would be no smaller), then encoded and packed in one pass.
    """
    with open(tokenizer_path, "rb") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    order = F.col("doc_id").asc_nulls_first()
    ordered = clean_documents(df).repartitionByRange(order).sortWithinPartitions(order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, before = encoder(source.value), TaskContext.get().partitionId(), 0, 0
        end, size = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        docs, coded, total = [], [], 0

        def shard():
            values = np.frombuffer(b"".join(coded), enc.dtype)
            file = pack(values, docs, np.array([len(c) for c in coded]) // size, enc.bits)
            own = {"shard_part": part, "shard_seq": seq, "part_start": before, "n_tokens": len(values), "n_docs": len(docs)}
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in own.items()} | {"file": pa.array([file], pa.binary())})

        for batch in batches:
            for slice_ in chunks(batch, "text", slice_bytes):
                for doc_id, ids in zip(slice_.column("doc_id").to_pylist(), enc.encode_all(slice_.column("text")), strict=True):
                    if docs and total + len(ids) + size > shard_tokens * size:
                        yield shard()
                        seq, before, docs, coded, total = seq + 1, before + total // size, [], [], 0
                    docs.append(doc_id)
                    coded.append(ids + end)
                    total += len(ids) + size
        if docs:
            yield shard()

    files = ordered.mapInArrow(run, "shard_part long, shard_seq long, part_start long, n_tokens long, n_docs long, file binary")
    return materialise(files, "wavelet")


def read_shards(files: DataFrame, digest_only: bool = False) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, unless digest_only, ids.

    ids: binary, little-endian unsigned 32-bit. The tokens of each part are summed over parts, of which there are as many as
    partitions; that one small table meets the files before they are opened, so neither files nor ids are shuffled.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, file in zip(batch.column("before").to_pylist(), batch.column("file"), strict=True):
                wm, doc_ids, counts = unpack(file.as_py())
                values = memoryview(wm.every().astype("<u4")).cast("B")
                stops = np.cumsum(counts, dtype=np.int64)
                for a in range(0, len(doc_ids), 2000):
                    own = slice(a, a + 2000)
                    starts = stops[own] - counts[own]
                    ids = [values[4 * s : 4 * e] for s, e in zip(starts.tolist(), stops[own].tolist(), strict=True)]
                    cols = [doc_ids[own], starts + before, counts[own].astype(np.int64), [zlib.crc32(x) for x in ids]]
                    if not digest_only:
                        cols.append([bytes(x) for x in ids])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names[: len(cols)])

    parts = files.groupBy("shard_part").agg(F.sum("n_tokens").alias("own"))
    order = Window.orderBy("shard_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("shard_part", F.coalesce(F.sum("own").over(order), F.lit(0)).alias("part_before"))
    placed = files.join(F.broadcast(before), "shard_part").select((F.col("part_before") + F.col("part_start")).alias("before"), "file")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * (not digest_only))
