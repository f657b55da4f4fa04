import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from voxmill.llm import ctph, nearcopies, queries, simhash, suffixes, unitdedup
from voxmill.operators.graph import star_components as components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def linked(ids, fps, limit=3):
    """Component of each id by all pairs."""
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= limit:
                p, q = root(ids[a]), root(ids[b])
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def near_texts(n, seed=1):
    r, out = random.Random(seed), []
    base = [" ".join(r.choice("alpha beta gamma delta Eps zeta eta theta".split()) + str(r.randrange(40)) for _ in range(120)) for _ in range(5)]
    for _ in range(n):
        w = r.choice(base).split()
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = "new" + str(r.randrange(1000))
        out.append(" ".join(w))
    return out


def test_simhash_components(spark, make, small):
    texts = [*near_texts(60), *small, "", "A b", "a B"]
    want = [fingerprint(t) for t in texts]
    comp = linked(list(range(len(texts))), want)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(make(texts)).collect()}
    assert got == {i: (want[i], comp[i]) for i in range(len(texts))}
    assert simhash.near_duplicates(make(texts).limit(0)).count() == 0


def test_numbers_from_pivot_distances():
    """All of the numbers differ by the differing bits in sum at most; those of one bit by just as many."""
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64)
    for width in (1, 2):
        parts = lambda v: (v[:, None] >> np.arange(0, 64, width, dtype=np.uint64)) & np.uint64((1 << width) - 1)  # noqa: B023, E731
        apart = np.abs(parts(simhash.packed_numbers(x, width)).astype(int) - parts(simhash.packed_numbers(y, width)).astype(int)).sum(axis=1)
        bits = np.bitwise_count(x ^ y)
        assert (apart <= bits).all() and (width == 2 or (apart == bits).all())
    masks = simhash.block_masks(6, 3)
    two = zip(*(simhash.packed_numbers(v, 2).tolist() for v in (x, y)), strict=True)
    assert len(masks) == 20 and all(any(a & m == b & m for m in masks) for a, b in two)


@pytest.mark.parametrize("group", [12, 1024])
def test_simhash_links_of_dense_groups(spark, group):
    """Many fingerprints within few bits of each other; with a small group limit keys are split again and again."""
    r = random.Random(3)
    centre = [r.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << r.randrange(64) for _ in range(r.randrange(0, 4))) & (1 << 64) - 1 for c in centre for _ in range(40)})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    edges = simhash.fingerprint_links(df, group=group).collect()
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for e in edges:
        a, b = (x & (1 << 64) - 1 for x in e)
        assert (a ^ b).bit_count() <= 64
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    want = linked(fps, fps)
    assert {f: root(f) for f in fps} == want


def test_pivots_discard_no_link():
    refs = simhash.pivots(32)
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64))
    t = simhash.pivot_table(np.r_[a, b], refs)
    i, j = simhash.surviving(np.r_[a, b], t, np.arange(500), np.arange(500, 1000), 3)
    assert len(i) == 500
    i, j = simhash.surviving(a, simhash.pivot_table(a, refs), np.arange(250), np.arange(250, 500), 3)
    assert len(i) == 0


def test_keep_first(spark, make):
    texts = near_texts(20)
    rows = [(5, texts[0]), (2, texts[0]), (9, "quite another text it is"), (9, "quite another text it is"), (7, None), (8, "")]
    kept = nearcopies.keep_first(make(rows)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 7, 9] and kept[0].start == "s"


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 300), (300, 200), (300, 400)] + [(500, 500 + k) for k in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 300: 200, 400: 200, **{500 + k: 500 for k in range(1, 50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def covered(rows, length=50):
    seen, out = {}, {}
    docs = sorted(((-(2**63) if d is None else d), (t or "").encode()) for d, t in rows)
    for d, b in docs:
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], d)
    for d, b in docs:
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] < d:
                mark[i : i + length] = True
        out.setdefault(None if d == -(2**63) else d, set()).add((len(b), int(mark.sum()), int((np.diff(np.r_[0, mark.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mark].tobytes()).hexdigest()))
    return out


def removed(df, **options):
    out = {}
    for r in suffixes.remove_repeats(df, **options).collect():
        out.setdefault(r.doc_id, set()).add((r.n_bytes, sum(s.stop - s.start for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 2000, "flush_bytes": 5000, "slice_bytes": 500}, {"buckets": 1}])
def test_suffixes_against_brute_force(spark, make, options):
    r = random.Random(5)
    base = ["".join(r.choice("ab") for _ in range(400)) for _ in range(5)] + ["".join(r.choice("défg hij") for _ in range(300)) for _ in range(3)]
    rows = []
    for i in range(80):
        t = "".join(b[(a := r.randrange(250)) : a + r.randrange(20, 150)] for b in r.choices(base, k=r.randrange(5)))
        rows.append((i, t if i % 17 else "aaaa" * r.randrange(90)))
    rows += [(3, rows[4][1]), (3, rows[3][1]), (None, rows[8][1]), (90, None), (91, "")]
    assert removed(make(rows), **options) == covered(rows)


def test_suffix_edge_cases(spark, make, small):
    rows = list(enumerate([t if t is None or len(t) < 5000 else t[:3000] for t in small]))
    assert removed(make(rows)) == covered(rows)
    assert suffixes.remove_repeats(make(rows).limit(0)).count() == 0
    long_ = suffixes.remove_repeats(make(small)).collect()
    assert len(long_) == len(small)


def test_deep_shallow_orders():
    r = np.random.default_rng(2)
    raw = r.integers(97, 99, 3000).astype(np.uint8)
    raw[500:900] = raw[1500:1900]
    raw[2000:2300] = 97
    places = np.arange(3000 - 60)
    order, head = suffixes.deep_shallow(raw, places, 50)
    text = [raw[p : p + 50].tobytes() for p in places[order]]
    assert text == sorted(text) and sorted(order) == list(range(len(places)))
    assert head.tolist() == [i for i in range(len(text)) if i == 0 or text[i] != text[i - 1]]


@pytest.mark.parametrize("small", [1, 7, 512])
def test_three_way_partition(small):
    r = np.random.default_rng(small)
    key = r.integers(0, 40, 900).astype(np.uint64)
    bounds = [(0, 300), (300, 301), (350, 900)]
    order, got = np.arange(900), key.copy()
    new = suffixes.three_way(order, got, bounds, small)
    for a, b in bounds:
        assert (got[a:b] == np.sort(key[a:b])).all() and (key[order[a:b]] == got[a:b]).all()
        assert [k for k in range(a, b) if new[k]] == [k for k in range(a, b) if k == a or got[k] != got[k - 1]]
    assert (order[301:350] == np.arange(301, 350)).all()


def test_equal_digests_are_compared():
    """Texts that share a digest but not their bytes are no copies."""
    raw = np.frombuffer(b"aaaaaaaaaabbbbbbbbbbaaaaaaaaaaccccccccccaaaaaaaaaaaaaaaa", np.uint8)
    at, size = np.array([0, 10, 20, 30, 40]), np.array([10, 10, 10, 10, 10])
    same = np.zeros(5, np.uint64)
    order, begin = suffixes.verified(suffixes.words_at_each(raw), at, size, *suffixes.classes(same, same))
    groups = [set(order[a:b].tolist()) for a, b in zip(begin, [*begin[1:], 5], strict=True)]
    assert sorted(map(sorted, groups)) == [[0, 2, 4], [1], [3]]


@pytest.mark.parametrize("unit", [" ", "-", "=-", "abc ", "0123456"])
def test_periodic_texts_and_hot_anchors(spark, make, unit):
    """Long runs of a short unit in many documents, with copies inside a document and across them."""
    r = random.Random(len(unit))
    rows = [(k, unit * r.randrange(0, 400 // len(unit)) + r.choice(["", "tail", "tail" * 20]) + unit * r.randrange(0, 90)) for k in range(40)]
    assert removed(make(rows)) == covered(rows)
    assert removed(make(rows), bucket_bytes=3000, flush_bytes=4000, slice_bytes=700) == covered(rows)


def test_blind_trie():
    words = [b"abcd", b"abce", b"abcd", b"xbcd", b"abxd", b"aaaa"]
    t = suffixes.BlindTrie(words)
    for i in range(len(words)):
        t.insert(i)
    leaves = list(t.leaves())
    assert [words[x[0]] for x in leaves] == sorted(set(words)) and sorted(map(len, leaves)) == [1, 1, 1, 1, 2]


def test_fingerprints(spark, make, small):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    texts = [" ".join(word() for _ in range(400)) for _ in range(8)]
    rows = [*enumerate(texts), *((20 + i, t) for i, t in enumerate(small)), (None, "none")]
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    want = {}
    for (d, t), (_, f) in zip(order, order[1:] + order[:1], strict=True):
        t, f = t or "", f or ""
        k = len(t) // 3
        new = t[: len(t) - k] + f[:k]
        a, b, c = (ctph.fingerprint(x.encode()) for x in (t, new, f))
        want[d] = (len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, ctph.likeness(a, b), ctph.likeness(a, c))
    got = {x.doc_id: (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint, x.near_edited, x.near_next) for x in ctph.compare_neighbours(make(rows)).collect()}
    assert got == want
    assert all(want[d][4] > 0.4 for d in range(8)) and all(want[d][5] == 0 for d in range(8))
    assert ctph.compare_neighbours(make(rows).limit(0)).count() == 0
    one = ctph.compare_neighbours(make(["only one text"])).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_signature_likeness():
    assert ctph.common_subsequence("kitten", "sitting") == 4
    assert ctph.signature_likeness("abcdefgh", "abcdefgx") == 1 - 2 / 16
    assert ctph.signature_likeness("abcdefghijklmn", "zzzzzzzzzzzzzz") == 0


def plain_fingerprint(data):
    """Byte by byte: the rolling hash as a loop over the last 7 bytes, chunks cut one after another, all sizes tried."""
    if not data:
        return "3::"
    hashes = []
    for i in range(len(data)):
        total = weighted = shifted = 0
        for j in range(7):
            c = data[i - j] if i >= j else 0
            total, weighted = total + c, weighted + (7 - j) * c
            shifted ^= c << 5 * j & 0xFFFFFFFF
        hashes.append((total + weighted + shifted) & 0xFFFFFFFF)

    def signature(size):
        out, chunk = "", b""
        for c, h in zip(data, hashes, strict=True):
            chunk += bytes([c])
            if h % size == size - 1:
                out, chunk = out + ctph.ALPHABET[zlib.crc32(chunk) % 64], b""
        return out + (ctph.ALPHABET[zlib.crc32(chunk) % 64] if chunk else "")

    cuts = lambda size: sum(h % size == size - 1 for h in hashes)
    top = max(0, (len(data) // 192).bit_length())
    k = max((k for k in range(top + 1) if cuts(3 << k) + 1 >= 32), default=0)
    while cuts(3 << k) + 1 > 256:
        k += 1
    return f"{3 << k}:{signature(3 << k)}:{signature(6 << k)}"


def test_fingerprints_byte_by_byte():
    r = np.random.default_rng(0)
    cases = [b"", b"a", b"abc", b"}" * 3000, b"x" * 700, b"q" * 40 + b"some words " * 30, r.integers(0, 256, 5000).astype(np.uint8).tobytes(), r.integers(97, 123, 900).astype(np.uint8).tobytes(), "Größe ça ñ 漢字 😀".encode() * 20]
    cases += [r.integers(0, 256, n).astype(np.uint8).tobytes() for n in range(1, 200, 13)]
    for data in cases:
        assert ctph.fingerprint(data) == plain_fingerprint(data)


def test_common_subsequence_by_table():
    r = random.Random(6)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(20))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert ctph.common_subsequence(a, b) == best[-1][-1]


@pytest.mark.parametrize("byte", list("}q)5)YMA e"))
def test_runs_of_one_byte_stay_small(byte):
    """A megabyte of a byte that ends a chunk each time, alone and beside a text: seconds, and short signatures."""
    run = byte * (1 << 20)
    a, b = (ctph.fingerprint(t.encode()) for t in (run, run[:-5] + " tail"))
    assert max(map(len, a.split(":") + b.split(":"))) <= 257
    assert 0 <= ctph.likeness(a, b) <= 1


def brute_units(text, least=10):
    """(start, stop) of units, word by word."""
    words = [m.span() for m in re.finditer(r"[^ \t\r\n\f\v]+", text)]
    if len(words) < least:
        return {(words[0][0], words[-1][1])} if words else set()
    gap = lambda i: text[words[i][1] : words[i + 1][0]] if i + 1 < len(words) else "\n\n"
    ends_line = ["\n" in gap(i) for i in range(len(words))]
    ends_sentence = [gap(i).count("\n") > 1 or re.search("[.!?][\"'”’»)\\]]*$", text[slice(*words[i])]) is not None for i in range(len(words))]
    out = set()
    for i in range(len(words)):
        at_line, at_sentence = i == 0 or ends_line[i - 1], i == 0 or ends_sentence[i - 1]
        for ok, ends in ((at_line, ends_line), (at_line or at_sentence, ends_sentence)):
            stop = next((j for j in range(i + least - 1, len(words)) if ends[j]), None) if ok else None
            if stop is not None:
                out.add((words[i][0], words[stop][1]))
    for starts in (ends_line, [x or y for x, y in zip(ends_line, ends_sentence, strict=True)]):
        i = max(i for i in range(len(words) - least + 1) if i == 0 or starts[i - 1])
        out.add((words[i][0], words[-1][1]))
    return out


def brute_dedup(rows, least=10):
    """Removed units and what is left, over rows of different (doc_id, text)."""
    every = [(d, mark, a, b, " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), t[a:b]).split())) for d, mark, t in rows for a, b in brute_units(t, least)]
    first = {}
    for d, mark, a, b, u in sorted(every):
        first.setdefault(u, (d, mark, a, b))
    out = []
    for d, mark, t in rows:
        spans = set()
        for d2, mark2, a, b, u in every:
            keep = first[u]
            if (d2, mark2) == (d, mark) and keep[:3] != (d, mark, a):
                a = max(a, keep[3]) if keep[:2] == (d, mark) else a
                if a < b:
                    spans.add((a, b, keep[0]))
        gone = np.zeros(len(t) + 1, bool)
        for a, b, _ in spans:
            gone[a:b] = True
        for m in re.finditer(r"[ \t\r\n\f\v]+", t):  # white space between removed units
            if m.start() and gone[m.start() - 1] and gone[m.end()]:
                gone[m.start() : m.end()] = True
        kept, i = "", 0
        while i < len(t):
            if not gone[i]:
                kept += t[i]
                i += 1
                continue
            while i < len(t) and gone[i]:
                i += 1
            kept = kept.rstrip(" \t")
            if not kept or kept.endswith("\n"):
                i += len(re.match(r"[ \t\r]*\n?", t[i:])[0])
        out.append((d, tuple(sorted(spans)), kept))
    return sorted(out)


def marked(spark, rows):
    """(doc_id, mark, text) as the operator marks them."""
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string").selectExpr("doc_id", "xxhash64(coalesce(text, '')) m", "coalesce(text, '') t")
    return [tuple(r) for r in df.collect()]


def test_units(spark, make, small):
    line = [f"this is  the Line number {i} of them, to which a few words come" for i in range(6)]
    passage = " ".join(f"It is said of word{i} that word{i + 1} and so on. Yes." for i in range(12))
    wrapped = passage.replace(" and", "\nand").replace("that ", "that\n")
    rows = [(4, f"{line[0]}\nshort\n{line[1]}"), (2, f"{line[1].upper()}\nshort\n{line[2]}\n{line[2]}\n  {line[0]}"), (9, line[2]), (11, f"Before it. {passage} After it stands more."), (12, f"another\nbeginning here and {wrapped}\n\nThe end."), (13, passage), (14, "Hm. " * 60)]
    rows += [(20 + i, t) for i, t in enumerate(t for t in small if t is None or len(t) < 1000)]
    got = unitdedup.remove_repeats(make(rows)).collect()
    found = sorted((r.doc_id, tuple((s.start, s.stop, s.kept_in) for s in r.removed or ()), r.kept_text) for r in got)
    want = brute_dedup(marked(spark, rows))
    assert found == want
    kept = {d: t for d, _, t in found}
    assert kept[13] == "Yes." and kept[9] == "" and kept[12] == "another\nbeginning here and It is said of word0 that\nword1\nand so on. Yes.\n\nThe end." and kept[11].startswith("Before it.")
    assert unitdedup.remove_repeats(make(rows).limit(0)).count() == 0
    odd = unitdedup.remove_repeats(make([*small, (None, line[0]), (None, line[0]), (3, line[0]), (3, line[1])])).collect()
    assert len(odd) == len(small) + 4 and sorted(r.kept_text for r in odd if r.doc_id is None) == [line[0]] * 2


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab.! \n\t)"), max_size=80))
def test_units_of_any_text(text):
    assert unitdedup.spans_of_units(text, 3) == brute_units(text, 3)


def test_line_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: (len(s), ",".join(f"{a}:{b}" for a, b, _ in s), [k for *_, k in s], len(t), hashlib.sha256(t.encode()).hexdigest()) for d, s, t in brute_dedup(marked(spark, rows))}
    got = {r.doc_id: (r.n_removed, r.removed_spans, r.kept_in, r.n_chars_kept, r.kept_sha256) for r in queries.op10_line_dedup(spark, sf).collect()}
    assert got == want
