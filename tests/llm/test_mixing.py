import random

import numpy as np

from judgefuse.llm import mixing


def corpus():
    rng = random.Random(2)
    kinds = {"de": "abcdäöüß", "es": "abcdñóíá", "en": "abcdefgh"}
    rows, labels = [], []
    for i in range(400):
        d = rng.choices(list(kinds), [0.15, 0.1, 0.75])[0]
        rows.append((i, " ".join("".join(rng.choice(kinds[d]) for _ in range(5)) for _ in range(rng.randint(5, 60))), d, "s"))
        if i % 2:
            labels.append((i, d))
    return rows, labels


def test_targets_against_numpy(spark, make_docs):
    rows, labels = corpus()
    targets = {"de": 1.0, "es": 2.0, "en": 3.0}
    out = mixing.document_rates(make_docs(rows), spark.createDataFrame(labels, "doc_id long, domain string"), targets).collect()
    tokens = np.array([r.n_tokens for r in out], float)
    post, rate = np.array([r.posterior for r in out]), np.array([r.rate for r in out])
    assert sorted(tokens) == sorted(len(t.split()) for _, t, *_ in rows)
    assert np.allclose(post.sum(1), 1) and (rate >= 0).all()
    want = tokens.sum() * np.array([1, 2, 3]) / 6
    assert np.abs((rate * tokens) @ post - want).max() <= 1e-3 * tokens.sum()
    # the same rounds by hand, one document at a time
    base = tokens @ post
    r = np.ones(len(tokens))
    for _ in range(mixing.STEPS):
        now = (r * tokens) @ post
        if np.abs(now - want).max() <= mixing.TOLERANCE * tokens.sum():
            break
        gram = (post * (tokens * (r > 0))[:, None]).T @ post
        r = np.maximum(0, r - post @ np.array(mixing.descend(
            list(now - want), gram.tolist(), list(base), mixing.TOLERANCE * tokens.sum() / 4)))
    assert np.allclose(r, rate)
    truth = {i: d for i, _, d, _ in rows}
    assert np.mean([truth[r.doc_id] == r.domain for r in out]) > 0.95


def test_copies_and_edges(spark, make_docs):
    rows, labels = corpus()
    extra = [(1000, None, None, None), (1001, "", "de", "s"), (3, rows[3][1], "en", "s"), (None, "abc", "en", "s"),
             (1002, "ab " * 50000, "en", "s")]
    df = make_docs(rows + extra)
    known = spark.createDataFrame(labels + [(None, "de"), (77777, "es"), (5, "other")], "doc_id long, domain string")
    targets = {"de": 0.3, "es": 0.3, "en": 0.4, "none": 0.0}
    mixed = mixing.mix(df, known, targets)
    assert mixed.columns == df.columns
    rates = mixing.document_rates(df, known, targets).collect()
    assert mixed.count() == sum(r.copies for r in rates)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rates)
    assert mixing.mix(df.limit(0), known, targets).count() == 0
    plain = mixing.document_rates(df, known.limit(0), {"a": 1.0}).collect()
    assert all(abs(r.rate - 1) < 1e-9 for r in plain)


def test_clipped_rates_reach_the_least_squares(spark, make_docs):
    """A target of zero for the largest domain: its rates end at zero, none below."""
    rows, labels = corpus()
    targets = {"de": 1.0, "es": 1.0, "en": 0.0}
    out = mixing.document_rates(make_docs(rows), spark.createDataFrame(labels, "doc_id long, domain string"), targets).collect()
    tokens, post = np.array([r.n_tokens for r in out], float), np.array([r.posterior for r in out])
    rate = np.array([r.rate for r in out])
    want = tokens.sum() * np.array([0.5, 0.5, 0])
    base = tokens @ post
    loss = lambda r: ((((r * tokens) @ post - want) ** 2) / base).sum()
    plain = np.ones(len(tokens))
    for _ in range(3000):  # plain projected gradient
        plain = np.maximum(0, plain - post @ (((plain * tokens) @ post - want) / base))
    assert (rate >= 0).all() and loss(rate) <= loss(plain) + 1e-3 * tokens.sum()
