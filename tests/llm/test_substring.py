import random

import pytest

from judgefuse.llm.substring import NO_KEY, deal, drop_repeats


def brute(rows, window):
    seen, out = {}, []
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < (d, i):
                gone[i:i + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice(["", "x", "é", "."])
    passages = [[word() for _ in range(rng.randint(window, 3 * window))] for _ in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p if rng.random() < 0.5 else p[a:]
            w += [word() for _ in range(rng.randint(0, 30))]
        if d % 11 == 0:
            w = ["la", "li"] * 40 + w  # periodic text
        rows.append((d * 3, " \n".join(w)))
    return rows


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 20), (3, 8)])
def test_against_brute_force(spark, make_docs, seed, window):
    rows = corpus(seed, window)
    out = drop_repeats(make_docs(rows), window=window)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()) == brute(rows, window)


def test_edge_rows(spark, make_docs):
    p = " ".join(f"w{i}" for i in range(25))
    rows = [(5, p), (5, p), (None, None), (6, ""), (7, "few words"), (8, p + " " + p), (9, "tick tock " * 40000)]
    df = make_docs(rows).withColumnRenamed("source", "N_WORDS")
    out = drop_repeats(df)
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in out.collect())
    # of the periodic text only the first start of each of the two windows stays: two words
    assert got == [(-1, 0, 0), (5, 25, 0), (5, 25, 0), (6, 0, 0), (7, 2, 0), (8, 50, 50), (9, 80000, 79998)]
    assert "N_WORDS" not in out.columns and "n_words" in out.columns
    assert drop_repeats(df.limit(0)).count() == 0


def test_rows_without_id_spread_over_blocks(spark, make_docs):
    rows = [(None if i % 3 else 4, t) for i, (_, t) in enumerate(corpus(5, 20))]
    dealt = deal(make_docs(rows), "doc_id", "text", 8).filter("doc_id is null")
    assert dealt.groupBy("__block").count().count() > 4
    got = sorted((NO_KEY if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text)
                 for r in drop_repeats(make_docs(rows)).collect())
    assert got == brute([(NO_KEY if d is None else d, t) for d, t in rows], 20)
