import zlib

import pytest

import corpus_pipeline as P
from judgefuse.llm import queries, toxicity
from judgefuse.llm.common import Forest

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """(name, input rows, output rows, output columns) of every stage, written and read again."""
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for k, (name, stage) in enumerate(P.STAGES):
        got = stage(spark, docs, SF)
        got.write.parquet(str(base / str(k)))
        after = spark.read.parquet(str(base / str(k)))
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def stage(staged, name):
    return next(s for s in staged if s[0] == name)


def test_stages_keep_the_columns(staged):
    assert [s[0] for s in staged] == ["toxicity", "ngram_jaccard", "substring_dedup", "mixing", "bpe"]
    for name, _, _, columns in staged[:-1]:
        assert columns == COLUMNS, name


def test_toxicity_drops_what_the_classifier_rejects(spark, staged):
    _, before, after, _ = stage(staged, "toxicity")
    rejected = {r.doc_id for r in queries.op3_toxicity(spark, SF).filter("predicted = 1").collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - rejected
    assert all(zlib.crc32(str(i).encode()) >= 0 for i in rejected) and toxicity.CUT == 0.7


def test_one_document_of_each_group_stays(staged):
    _, before, after, _ = stage(staged, "ngram_jaccard")
    sets = {}
    for r in before:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    forest, ids = Forest(), sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                forest.unite(a, b)
    assert {r.doc_id for r in after} == {i for i in ids if forest.find(i) == i}


def test_repeated_windows_go(staged):
    _, before, after, _ = stage(staged, "substring_dedup")
    got = {r.doc_id: r.text for r in after}
    seen = set()
    for r in sorted(before, key=lambda r: r.doc_id):
        w = (r.text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i:i + 20])
            if key in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(key)
        want = b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else r.text
        assert got[r.doc_id] == want


def test_mixing_follows_the_rates(spark, staged):
    from judgefuse.llm import mixing
    _, before, after, _ = stage(staged, "mixing")
    docs = spark.createDataFrame(before)
    rates = mixing.document_rates(docs, queries.mix_labels(spark, SF), queries.MIX_TARGETS).collect()
    want = {r.doc_id: r.copies for r in rates if r.copies}
    got = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want


def test_bpe_equals_the_library(staged):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    _, before, after, columns = stage(staged, "bpe")
    assert len(before) == len(after) and columns == [*COLUMNS, "token_ids", "n_tokens"]
    for r in after:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)


def test_run_and_edge_rows(spark, make_docs):
    assert P.run(spark, SF).count() > 0
    edge = make_docs([(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x y z"), (4, "long text " * 20000)])
    docs = edge
    for _, f in P.STAGES[:-1]:
        docs = f(spark, docs, SF)
        assert docs.columns == COLUMNS
    assert {r.doc_id for r in P.STAGES[-1][1](spark, docs, SF).collect()} <= {1, 2, 3, 4, None}
    for _, f in P.STAGES:
        assert f(spark, edge.limit(0), SF).count() == 0
