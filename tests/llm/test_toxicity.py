import random
import zlib

from pyspark.sql import functions as F

from judgefuse.llm import queries, toxicity

BAD = ["gruzzle", "plonker", "vexwit", "snarkel"]


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain + ["the", "of", "and"] * 40) for _ in range(rng.randint(20, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "s", "."])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, make_docs):
    rows, labels = corpus()
    docs = make_docs(rows)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known.filter(toxicity.learnable()))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in held} == {r.doc_id for r in docs.filter(~toxicity.learnable()).collect()}
    right = sum((got[i] >= toxicity.CUT) == (i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values())


def test_edge_rows(spark, make_docs):
    rows, labels = corpus(200)
    known = spark.createDataFrame(labels + [(0, 1), (0, 0), (None, 1), (7, None), (9999, 1)], "doc_id long, toxic int")
    docs = make_docs(rows + [(1000, None), (1001, ""), (1002, "word " * 30000), (5, rows[5][1])])
    model = toxicity.fit(docs, known)
    out = toxicity.score(docs.withColumn("SCORE", F.lit(3)), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    got = [(r.doc_id, r.score) for r in out.collect()]
    assert len(got) == 204 and len({s for i, s in got if i == 5}) == 1
    assert len({s for i, s in got if i in (1000, 1001)}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, known.limit(0))
    assert toxicity.score(docs, none).filter("score >= 0.7").count() == 0


def test_query(spark):
    out = queries.op3_toxicity(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
