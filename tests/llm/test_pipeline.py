import hashlib
from itertools import combinations

import numpy as np
import pytest

from tests.llm.test_text import brute_hits
from voxmill.llm import bpe, pii, toxicity

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def shingles(text):
    w = [x.lower() for x in text.split()]  # the tables' white space is ASCII
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def first_of_each_group(docs):
    """The least doc_id of each component of texts whose 5-word shingles have a Jaccard similarity of 0.8."""
    sets, up = {d: shingles(t) for d, t in docs.items()}, {d: d for d in docs}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if (len(x & y) / len(x | y) if x or y else 1) >= 0.8:
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return {d: t for d, t in docs.items() if up[d] == d}


def test_pipeline_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r.text or "" for r in table.collect()}
    grammar = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = {d: t for d, t in docs.items() if grammar.scores(grammar.features(t)[None])[0] < 0.7}
    docs = first_of_each_group(docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {d: docs[d] for d, _, n_hit, *_ in brute_hits(list(docs.items()), items) if not n_hit}
    found = pii.find(list(docs.values()), pii.trained())
    docs = {d: pii.masked(t, s) for (d, t), s in zip(docs.items(), found, strict=True)}
    tok = bpe.Tokenizer(open(pipeline.TOKENIZER, "rb").read())
    want = {d: (len(i := tok.encode(t)) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in docs.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < table.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "bpe"]
    assert np.all([callable(f) for _, f in pipeline.STAGES])


@pytest.fixture
def odd(spark, tmp_path):
    """A folder of tables with nulls, repeated ids, clashing column names and documents that hold benchmark passages."""
    passage = "the quick brown fox jumps over a lazy dog by the river bank"
    rows = [(1, None), (2, ""), (3, "a clean text of some words"), (3, f"so {passage.upper()}, he said"), (None, "no id at all"), (5, f"Here: {passage} - and more."), (6, "three short words"), (7, "the quick brown fox jumps over a cat"), (8, "x" * 50_000), (8, "x" * 50_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, mark long, bad_id long, text_mark string, start map<string,int>"
    build = lambda r: spark.createDataFrame([(d, t, "en", "s", 0, 1, 2, "m", {"a": 1}) for d, t in r], schema)
    spark.createDataFrame([(1, passage), (2, "three short words"), (None, "a clean text of some words"), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), build, rows


def test_documents_with_benchmark_windows_go(spark, odd):
    sf, build, rows = odd
    docs = build(rows)
    kept = dict(pipeline.STAGES)["decontamination"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((d or -1, t or "") for d, t in rows if t and "clean" in t or d in (1, 2, 8, 7, None))


def test_odd_documents_run_through(spark, odd):
    sf, build, rows = odd
    build(rows).write.parquet(f"{sf}/documents.parquet")
    got = sorted((r.doc_id or -1, r.n_tokens) for r in pipeline.run(spark, sf).collect())
    # null and empty texts are copies, and so are the repeated rows
    assert [d for d, _ in got] == [-1, 1, 3, 7, 8] and got[1] == (1, 0)


def test_no_documents(spark, odd):
    sf, build, rows = odd
    build(rows).limit(0).write.parquet(f"{sf}/documents.parquet")
    assert pipeline.run(spark, sf).count() == 0
