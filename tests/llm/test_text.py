import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from voxmill.llm import decontaminate, htmlmain, pii, queries, toxicity

SF = "/root/testdata/sf0.001"


# ---- personal data

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(t):
    ok = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), pii.good_card, pii.good_phone]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(t) if ok[k](m[0]))


def test_base_patterns():
    r = random.Random(1)
    for _ in range(5000):
        t = "".join(r.choice("a1@.-+ (2%é") for _ in range(30))
        assert plain_spans(t) == pii.base_spans(t)
    assert pii.base_spans("4111 1111 1111 1111 and a.b@c.de") == [(0, 2, 19), (24, 0, 32)]
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@b") == []


def test_added_spans_of_unseen_samples():
    """Held-out samples of the generator: what the patterns miss, the network adds."""
    model, r = pii.trained(), np.random.default_rng(99)
    samples = [pii.sample(r) for _ in range(800)]
    hit = missed = wrong = 0
    for (text, tags), found in zip(samples, pii.find([t for t, _ in samples], model), strict=True):
        base, added = ({x[:3] for x in found if x[3] == of} for of in (True, False))
        assert sorted(base) == plain_spans(text)
        gold = {(s, k, e) for s, k, e in pii.spans_of_tags(tags)}
        rest = {g for g in gold if not any(s < g[2] and g[0] < e for s, _, e in base)}
        hit, missed, wrong = hit + len(rest & added), missed + len(rest - added), wrong + len(added - gold)
    assert hit > 200 and hit > 0.93 * (hit + missed) and wrong < 0.02 * hit


def test_spans_past_a_rejected_match():
    """The phone pattern runs on into the address and fails; two cards in a row fail as one."""
    texts = ["words of it +1 (826) 555-4081 190.137.223.204 and more words", "Éçan 4539578763621486 4716461583322103 èaique treoile", "elleelleque sichenkeitsch of 19 v2.3.4 in 2021-11-12 words"]
    phone, cards, none = ([(x[1], t[x[0] : x[2]], x[3]) for x in f] for t, f in zip(texts, pii.find(texts, pii.trained()), strict=True))
    assert (3, "+1 (826) 555-4081", False) in phone and (1, "190.137.223.204", True) in phone
    assert cards == [(2, "4539578763621486", False), (2, "4716461583322103", False)] and none == []


def test_decoding_against_enumeration():
    """The Viterbi path and its margin against all tag sequences of short stretches."""
    r = np.random.default_rng(4)
    m = pii.Tagger(embed=3, hidden=4)
    m.p["tr"], m.p["first"] = r.normal(size=(pii.N_TAGS, pii.N_TAGS)), r.normal(size=pii.N_TAGS)
    sizes, begins = np.array([1, 3, 4, 2]), np.array([True, False, True, False])
    e = r.normal(size=(4, 4, pii.N_TAGS)).astype(np.float32)
    got = m.best_paths(e, begins, sizes)
    tr = m.p["tr"] + pii.BARRED

    def value(tags, k):
        start = m.p["first"][tags[0]] + pii.BARRED[0, tags[0]] if begins[k] else tr[0, tags[0]]
        return start + sum(e[t, k, x] for t, x in enumerate(tags)) + sum(tr[a, b] for a, b in zip(tags[:-1], tags[1:], strict=True)) + tr[tags[-1], 0]

    for k, n in enumerate(sizes):
        best = max(itertools.product(range(pii.N_TAGS), repeat=int(n)), key=lambda tags: value(tags, k))  # noqa: B023
        assert tuple(got[k, :n]) == best and not got[k, n:].any()


def test_merged_emissions():
    """A stretch of several windows: each character's emissions are the mean of its windows', by distance from their edges."""
    m = pii.Tagger(embed=3, hidden=4)
    text = "1 word here and there " * 9
    coded = {0: pii.symbols(text)}
    (part,) = pii.stretches([text], [0])
    assert part == (0, 0, len(text))
    e, _ = pii.merged_emissions(coded, [part], m)
    starts = pii.windows_of(text)
    for at in (0, 31, 32, 70, len(text) - 1):
        total = weight = 0
        for s in starts:
            if s <= at < s + pii.WINDOW:
                own = np.full((1, pii.WINDOW), pii.PAD, np.uint8)
                part = coded[0][s : s + pii.WINDOW]
                own[0, : len(part)] = part
                w = min(at - s, s + pii.WINDOW - 1 - at) + 1
                total, weight = total + w * m.emissions(own)[0][at - s, 0], weight + w
        assert e[at] == pytest.approx(total / weight, abs=1e-4)


def test_training_is_repeatable():
    a, b = (pii.fit(samples=128, epochs=2) for _ in range(2))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    assert {k: x.shape for k, x in a.p.items()} == {k: x.shape for k, x in pii.trained().p.items()}


def test_crf_gradient():
    r = np.random.default_rng(0)
    m = pii.Tagger(embed=3, hidden=4)
    ids, tags = r.integers(0, pii.N_SYMBOLS, (3, 7)), r.integers(0, pii.N_TAGS, (3, 7))
    _, g = m.gradient(ids, tags)
    for name, grad in g.items():
        at = tuple(r.integers(0, n) for n in grad.shape)
        if name == "e":
            at = (ids[0, 0], 1)
        old, eps = m.p[name][at], 1e-5
        m.p[name][at] = old + eps
        up = m.gradient(ids, tags)[0]
        m.p[name][at] = old - eps
        down = m.gradient(ids, tags)[0]
        m.p[name][at] = old
        assert grad[at] == pytest.approx((up - down) / (2 * eps), abs=1e-6)


def test_windows_join_long_spans():
    model = pii.trained()
    text = "filler words go here and there " * 3 + "very.long.name" * 1 + ".of.someone@mail-server.example.org" + " more of the words after it"
    found = pii.find([text], model)[0]
    assert [(s, k, e) for s, k, e, _ in found] == plain_spans(text)
    assert pii.windows_of("") == [] and pii.windows_of("abc") == [] and pii.windows_of("1" + "a" * 500)[:1] == [0]
    last = "a" * 500 + "1"
    assert any(s <= 500 < s + pii.WINDOW for s in pii.windows_of(last))


def test_personal_data_operator(spark, make, small):
    rows = [*enumerate(small), (50, "mail a@b.com or 10.0.0.1"), (50, "mail a@b.com or 10.0.0.1")]
    got = pii.find_personal_data(make(rows)).collect()
    assert len(got) == len(rows)
    assert [[(s.kind, s.start, s.stop) for s in r.spans] for r in got if r.doc_id == 50] == [[("email", 5, 12), ("ip", 16, 24)]] * 2
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.mask_personal_data(make(rows)).collect()}
    assert out[50] == ("mail [EMAIL] or [IP]", 20) and out[0] == (None, None) and out[1] == ("", 0)
    assert pii.masked("+1 10.0.0.1 5555 x", [(0, 3, 16, True), (3, 1, 11, True)]) == "[PHONE] x"
    assert pii.find_personal_data(make(rows).limit(0)).count() == 0


def test_personal_data_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op1_pii(spark, SF).collect():
        base = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        text = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(text).encode()).hexdigest()
        assert set(text) <= set(r.spans.split(",") if r.spans else []) and len(r.spans.split(",")) * bool(r.spans) == len(text) + r.n_added


# ---- benchmark passages


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for s in range(max(1, len(w) - 7)):
                wins.setdefault(tuple(w[s : s + 8]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    own |= got
        out.append((-1 if d is None else d, len(w), len(hit), tuple(sorted(own)), len(own) >= 2))
    return sorted(out)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination_against_brute_force(spark, make, small, limit):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["Ünï", "x1"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 12, 8, 9, 20])] + [(7, "two words"), (8, "Three short words"), (9, ""), (10, None), (None, text(9)), (11, None), (0, "w1"), (2, "repeat repeat repeat repeat repeat repeat repeat repeat repeat")]
    docs = list(enumerate(small)) + [(100 + i, text(40)) for i in range(10)]
    docs += [(200, f"{text(5)}, {items[0][1].upper()}! {text(5)}"), (201, items[1][1] + " " + items[4][1]), (202, " ".join(items[3][1].split()[:8])), (203, " ".join(items[3][1].split()[1:8])), (204, "Two - words; three SHORT words"), (205, "repeat " * 20), (205, "repeat " * 20), (None, items[0][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, uid string")
    got = decontaminate.decontaminate(make(docs), bench, broadcast_rows=limit).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_words, x.n_hit, tuple(x["items"]), x.contaminated) for x in got) == brute_hits(docs, items)


def test_decontamination_of_nothing(spark, make):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(make(["a b c", None]), bench).collect()
    assert sorted((r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == [(0, 0, 0, False), (3, 0, 0, False)]
    some = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert decontaminate.decontaminate(make(["a"]).limit(0), some).count() == 0


def test_decontamination_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = sorted(map(tuple, queries.op3_decontaminate(spark, SF).collect()))
    assert got == sorted(con.sql(queries.oracle_sql()["op3_decontaminate"]).fetchall())


# ---- toxicity


def test_grammar_patterns():
    g = toxicity.Grammar({"idio": 5.0}, np.zeros(toxicity.N_FEATURES))
    pattern = lambda t: [k for k in range(8) if g.features(t)[k] > 0]
    assert pattern("what an idiot") == [toxicity.PLAIN]
    assert pattern("you idiot") == [toxicity.AIMED] == pattern("an idiot you are")
    assert pattern("not an idiot") == [toxicity.DENIED] and pattern("she said idiot") == [toxicity.QUOTED]
    assert pattern("not so. an idiot") == [toxicity.PLAIN] and pattern("nothing here") == []
    assert pattern("not that it ever mattered to idiots") == [toxicity.PLAIN]  # beyond the negation's reach
    assert pattern("an idiot by any measure that there is you") == [toxicity.PLAIN]  # the target comes too late
    assert pattern("kill you") == [4 + toxicity.AIMED]


def test_lexicon():
    t = toxicity.lexicon([("ab", ("stem", 1.0), True), ("abc", ("word", 1.0), False)])
    assert [toxicity.look_up(t, w) and toxicity.look_up(t, w)[0] for w in ("a", "ab", "abc", "abcd", "xab")] == [None, "stem", "word", "stem", None]


def interpreted(letters):
    """What each insult or threat of a clause is, from the rules as they are written down."""
    out, n = [], len(letters)
    for k, c in enumerate(letters):
        if c not in "ih":
            out.append("o")
        elif "r" in letters[:k]:
            out.append(c + "q")
        elif "n" in letters[max(0, k - toxicity.SCOPE) : k]:
            out.append(c + "d")
        else:
            near = range(max(0, k - toxicity.REACH), min(n, k + toxicity.REACH + 1))
            out.append(c + "a" * any(letters[j] == "t" for j in near))
    return out


def test_clause_transducer_against_the_rules():
    r = random.Random(8)
    for _ in range(3000):
        letters = [r.choice("iiihtnrooooo") for _ in range(r.randrange(1, 14))]
        assert toxicity.CLAUSE.best_path(letters)[1] == interpreted(letters), letters
    # an open guess is no final state
    assert all(s in toxicity.CLAUSE.final or toxicity.CLAUSE.arcs.get((s, "t")) for s in {to for a in toxicity.CLAUSE.arcs.values() for _, _, to in a})


def test_composition_against_two_steps():
    """Best paths of the composed transducer weigh as much as the best over all outputs of the first read by the second."""
    r = random.Random(2)
    a, b = toxicity.Transducer(), toxicity.Transducer()
    for t, outs in ((a, "xy"), (b, "uv")):
        for state in range(3):
            if state != 1:
                t.final[state] = r.random()
            for label in ("pq" if t is a else "xy"):
                for _ in range(2):
                    t.arc(state, label, r.choice(outs), r.random(), r.randrange(3))
    both = a.compose(b)

    def every(t, labels):
        paths = [(0, 0.0, ())]
        for label in labels:
            paths = [(to, w + x, (*p, o)) for s, w, p in paths for o, x, to in t.arcs.get((s, label), ())]
        return [(w + t.final[s], p) for s, w, p in paths if s in t.final]

    for labels in itertools.product("pq", repeat=4):
        want = max((w + x for w, p in every(a, labels) for x, _ in every(b, p)), default=None)
        got = both.best_path(list(labels))
        assert (got is None) == (want is None) and (got is None or got[0] == pytest.approx(want))


def test_toxicity_features_clause_by_clause():
    """The features of whole texts from a plain reading of each clause."""
    g = toxicity.Grammar({"moro": 4.0, "stup": 2.5})
    r = random.Random(5)
    vocab = "you moron not stupid said kill they word other never idiot walks. fine, quick; the".split()
    for _ in range(200):
        text = " ".join(r.choice(vocab) for _ in range(40))
        want, clauses = np.zeros(toxicity.N_FEATURES), [c for c in re.split(r"[.!?;:,|\n]+", text) if c.strip()]
        for c in clauses:
            ws = re.findall("[a-z]+", c)
            cls = ["i" if w[:4] in ("moro", "stup") else next((toxicity.LETTER[k] for k, ws_ in toxicity.WORDS.items() if w in ws_.split()), "o") for w in ws]
            got = [(o, {"moro": 4.0, "stup": 2.5}.get(w[:4], 1.0)) for o, w in zip(interpreted(cls), ws, strict=True) if o != "o"]
            for o, weight in got:
                want[toxicity.PATTERN[o]] += weight
            want[toxicity.MATCHED] += bool(got)
        want[toxicity.MATCHED] *= 100 / (len(clauses) + 5)
        assert g.features(text) == pytest.approx(np.log1p(want) if want.any() else want)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_toxicity(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    unseen = both[both.held_out]
    assert unseen.predicted.eq(unseen.toxic).mean() > 0.95
    assert ((unseen.predicted == 1) & (unseen.toxic == 0)).sum() <= 2
    import zlib

    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(got.doc_id, got.held_out, strict=True))
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_toxicity_edge_cases(spark, make, small):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    g = toxicity.train(make(small), labels)
    got = toxicity.score(make(small), g).collect()
    assert len(got) == len(small) and len({r.score for r in got}) == 1 and not any(r.predicted for r in got)
    texts = ["you are a moronic person indeed moronic"] * 40 + ["a fine day to walk"] * 40
    texts = [f"{t} {i}" for i, t in enumerate(texts)]
    both = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    docs = make([*enumerate(texts), (100, None), (101, ""), (102, None)])
    g = toxicity.train(docs, both)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, g).collect()}
    assert kept == {*range(40, 80), 100, 101, 102}
    assert toxicity.drop_toxic(docs, g).columns == docs.columns
    assert toxicity.score(docs.limit(0), g).count() == 0


# ---- pages


def test_blocks():
    page = '<head><title>t</title></head><body><!-- x <p>no --><script>var a="</p>";</script><p>One&amp;two &lt;3<br>four<p><b>five\n\n six<div class="Ad box">seven</div>tail<ul><li>a<li>b</ul></body>'
    assert [b.text for b in htmlmain.blocks_of(page)] == ["One&two <3 four", "five six", "seven", "tail", "a", "b"]
    assert htmlmain.blocks_of("") == [] and htmlmain.blocks_of("<p>") == []
    assert [b.text for b in htmlmain.blocks_of("a < b <!-- open")] == ["a < b"]
    assert [b.text for b in htmlmain.blocks_of("x<script>never closed")] == ["x"]
    assert htmlmain.blocks_of('<div id="c" class=\'d e\'>z')[0].context == ("in:div", "is:c", "is:d", "is:e")


def test_chain_on_unseen_pages():
    chain, r, right, n = htmlmain.trained(), np.random.default_rng(77), 0, 0
    for _ in range(150):
        page, labels = htmlmain.labelled_page(r)
        got = chain.decode(htmlmain.blocks_of(page))
        right, n = right + sum(a == b for a, b in zip(got, labels, strict=True)), n + len(labels)
    assert right > 0.99 * n


def test_pages_of_the_table(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op6_html(spark, SF).collect():
        body = pages[r.page_id]
        inner = body[body.index("<article>") : body.index("</article>")]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|article)>", inner.replace("<br>", " "))]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_pages_edge_cases(spark):
    long_ = "<article>" + "<p>word word word.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<p>", "t"), (4, long_, "t"), (4, long_, "t")], "page_id long, html string, text string")
    got = htmlmain.extract_main_text(df).collect()
    assert sorted((r.page_id, len(r.text)) for r in got)[:3] == [(1, 0), (2, 0), (3, 0)] and len(got) == 5
    assert all(r.text.count("\n") == 19_999 for r in got if r.page_id == 4)
    assert htmlmain.extract_main_text(df.limit(0)).count() == 0
