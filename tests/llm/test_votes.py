"""Votes of the quality classifier beside a plain computation: terms, latent vectors, neighbours, one document at a time."""

import math

import numpy as np

from shoalwater.llm import quality


def brute_score(voter, text):
    """Score by exact cosines with every labelled vector in double precision; and the margin at the last neighbour's place."""
    counts = quality.term_counts([text])[0].astype(np.float64)
    x = np.array([math.log1p(c) for c in counts]) * voter.idf.astype(np.float64)
    for part, weight in ((slice(0, quality.SHAPES), 1.0), (slice(quality.SHAPES, None), quality.WORD_WEIGHT)):
        x[part] *= weight / max(math.sqrt(float((x[part] ** 2).sum())), 1e-9)
    y = x @ voter.space.astype(np.float64)
    y /= max(math.sqrt(float(y @ y)), 1e-9)
    cosines = sorted(((float(y @ v), float(label)) for v, label in zip(voter.pool.astype(np.float64), voter.labels)), reverse=True)
    k = min(quality.NEIGHBOURS, len(cosines))
    votes = [(max(0.0, c) ** 8, label) for c, label in cosines[:k]]
    total = sum(w for w, _ in votes)
    margin = cosines[k - 1][0] - cosines[k][0] if k < len(cosines) else 1.0
    return (sum(w * label for w, label in votes) / total if total > 0 else voter.prior), margin


def test_votes_equal_brute_force(spark, make_text):
    rng = np.random.default_rng(9)
    good = lambda i: make_text(i, 40 + i % 50).capitalize() + ". " + make_text(i + 1, 30).capitalize() + "."
    bad = lambda i: " ".join(w.upper() if j % 3 else w + "!!" for j, w in enumerate(make_text(i, 30 + i % 40).split()))
    rows = [(i, good(i) if i % 2 else bad(i)) for i in range(400)]
    noisy = [(i, int((i % 2) ^ (rng.random() < 0.1)), 0) for i in range(0, 400) if i % 5]
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, " \t"), (903, rows[1][1]), (904, good(5) * 400)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(noisy, "doc_id long, quality int, toxic int")
    voter = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, voter).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    clear = 0
    for i, t in texts.items():
        want, margin = brute_score(voter, t)
        if margin > 1e-5:  # else float32 may take another of two equally near neighbours
            clear += 1
            assert math.isclose(got[i]["score"], want, abs_tol=1e-4), (i, got[i]["score"], want)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    assert clear > 300 and got[900]["score"] == got[901]["score"] == got[902]["score"]
    assert math.isclose(got[903]["score"], got[1]["score"], abs_tol=1e-6)
