import hashlib
import random

import numpy as np
import pytest

import judgefuse.llm.suffix_runs as S


def corpus(seed, window):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcde é.") for _ in range(n))
    passages = [noise(rng.randint(window // 2, 4 * window)) for _ in range(8)]
    texts = []
    for d in range(70):
        t = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            t += p if rng.random() < 0.5 else p[a:]
            t += noise(rng.randint(0, 2 * window))
        if d % 10 == 0:
            t += "ab" * window  # periodic
        texts.append(t)
    return texts + texts[:4] + ["x" * (3 * window), "", None]


def result(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("seed,window,crowd", [(1, 200, 2048), (2, 40, 2048), (3, 40, 1), (4, 24, 3)])
def test_against_brute_force(spark, make_docs, monkeypatch, seed, window, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)   # crowded anchors even here
    monkeypatch.setattr(S, "PIECE", 300)     # texts cross the pieces that are hashed at a time
    monkeypatch.setattr(S, "SHARD", 4000)
    texts = corpus(seed, window)
    want = S.brute_force([(t or "").encode() for t in texts], window)
    out = S.drop_repeats(make_docs(list(enumerate(texts))), window=window)
    assert result(out) == sorted((d, *w) for d, w in enumerate(want))
    assert sum(w[1] for w in want) > 0
    for r in out.collect():   # the spans are what is missing
        raw, cuts = (texts[r.doc_id] or "").encode(), [(s["from"], s["to"]) for s in r.removed]
        assert len(cuts) == r.n_spans and sum(b - a for a, b in cuts) == r.n_removed
        assert b"".join(raw[a:b] for a, b in zip([0, *[b for _, b in cuts]], [*[a for a, _ in cuts], len(raw)])) == r.kept


def test_edge_rows(spark, make_docs):
    p, long = ("".join(random.Random(n).choices("abcdefgh ", k=n)) for n in (260, 700_000))
    rows = [(5, p), (5, p), (None, None), (6, ""), (7, "few bytes"), (8, p[:199]), (9, long), (None, "é" * 150), (10, "q" + p[30:] + "r")]
    df = make_docs(rows).withColumnRenamed("source", "N_REMOVED").withColumnRenamed("lang", "kept")
    out = S.drop_repeats(df)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans) for r in out.collect())
    assert got == [(-1, 0, 0, 0), (-1, 300, 300, 1), (5, 260, 260, 1), (5, 260, 260, 1), (6, 0, 0, 0), (7, 9, 0, 0),
                   (8, 199, 0, 0), (9, 700_000, 0, 0), (10, 232, 230, 1)]
    assert "N_REMOVED" not in out.columns and out.columns[-1] == "kept"
    assert S.drop_repeats(df.limit(0)).count() == 0


def naive_statistics(strings):
    out = []
    places = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]
    for k, i in places:
        best = 0
        for m, j in places:
            if (m, j) != (k, i):
                n = 0
                while i + n < len(strings[k]) and j + n < len(strings[m]) and strings[k][i + n] == strings[m][j + n]:
                    n += 1
                best = max(best, n)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab\x00\xff") for _ in range(40))
    strings = [base[rng.randrange(20):] + bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 15))) for _ in range(6)]
    strings += [b"a" * 30, b"a" * 31, base]
    index = S.RunIndex(strings)
    got = np.delete(index.matching_statistics(), index.sep)   # nothing starts at a separator
    assert got.tolist() == naive_statistics(strings)
    assert len(index.heads) < index.n                          # runs are shorter than the text
    order = index.sort()
    ends = [(i, k) for k, s in enumerate(strings) for i in range(len(s) + 1)]
    assert order.tolist() == [index.start[k] + i for i, k in sorted(ends, key=lambda e: (strings[e[1]][e[0]:], e[1]))]
