"""Line dedup, filter audit and whitening beside brute force, on odd input and on empty tables."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest

from shoalwater.llm import filter_audit, line_dedup, whitening

STRIPPED = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(STRIPPED))


# ------------------------------------------------------------------------------- line dedup


def brute_lines(rows):
    """(doc_id, text) rows to (doc_id, n_lines, n_dropped, text)."""
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(-1 if i is None else i)
    last = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in last or last[key(x)] == (-1 if i is None else i)]
        yield i, len(lines), len(lines) - len(stay), "\n".join(stay)


def line_rows():
    shared = ["A line that many Documents share", "ÉTÉ à la plage, une ligne Partagée", "short line", "exactly twenty chars", "nineteen characters"]
    rows = []
    for i in range(40):
        own = [f"own line number {i} of the document", ""]
        rows.append((i, "\n".join([shared[0], *own, "  " + shared[1].replace("P", "p") + "\t\r", shared[2], shared[3].upper(), shared[4], own[0]])))
    rows += [(100, shared[0] + "\n" + shared[0].lower()), (100, "another text of the same id\n" + shared[1]), (None, shared[0]), (None, shared[0] + "\n" + "held by two rows without an id"), (None, "held by two rows without an id")]
    rows += [(101, "été à la plage, une ligne partagée"), (102, "\n\n\n"), (103, None), (104, ""), (105, "twice in here, not three documents\n" * 5), (106, "twice in here, not three documents"), (106, "twice in here, not three documents")]
    rows += [(200, "\n".join(shared[0] if k % 3 else f"line {k} of a very long document" for k in range(100_000))), (201, shared[3]), (202, "x" * 300_000)]
    return rows


def test_line_dedup_brute(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, "clash", i) for i, r in enumerate(rows)], "doc_id long, text string, n_lines string, pos int").repartition(5)
    got = line_dedup.dedup(docs)
    assert got.columns == ["doc_id", "text", "pos", "n_lines", "n_dropped"]
    by = {r["pos"]: (r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()}
    want = list(brute_lines(rows))
    assert len(by) == len(rows) and all(by[i] == w for i, w in enumerate(want))
    assert any(w[2] == w[1] for w in want) and line_dedup.dedup(docs.limit(0)).count() == 0


def test_line_dedup_without_repeats_and_columns_of_any_name(spark):
    names = "id version h1 h2 last dropped gone_id gone_version key line c0 c1".split()
    rows = [(i, f"a line that all of them hold here\n{i}", *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id int, text string", *[f"`{n}` string" for n in names]]))
    got = line_dedup.dedup(docs).collect()
    assert all(r["text"] == (rows[5][1] if r["doc_id"] == 5 else str(r["doc_id"])) and all(r[n] == f"{n}{r['doc_id']}" for n in names) for r in got)
    assert all(r["n_dropped"] == 0 for r in line_dedup.dedup(docs.where("doc_id < 2")).collect())


# ------------------------------------------------------------------------------- filter audit


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    ids = defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""].append(i)
    failed = []
    for i, t, lang in docs:
        t = t or ""
        words = [w for w in "".join(" " if c in STRIPPED else c for c in t).split(" ") if w]
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j < i for j in ids[t])}
        failed.append((lang or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    rows = {}
    for part in {f[0] for f in failed}:
        own, removed_by = [f for f in failed if f[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            for step in range(5):
                letter, before = order[step], set(order[:step])
                hit = [f for f in own if letter in f[1]]
                gone = [f for f in hit if not f[1] & before]
                removed_by[letter] += len(gone)
                rows[part, "".join(order), step + 1] = [sum(not f[1] & (before | {letter}) for f in own), len(gone), len(hit) - len(gone), sum(f[1] == {letter} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), r in rows.items():
            if p == part:
                r.append(removed_by[order[step - 1]])
    return rows


def test_filter_audit_brute(spark, odd_docs, make_text):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()]
    rows += [(300 + i, " ".join(make_text(i % 7, 100 + 20 * i).split() * (1 + i % 4)) + ("", " $", " UPPER CASE WORDS")[i % 3] * (1 + 9 * (i % 2)), ("en", "", None)[i % 3]) for i in range(40)]
    rows += [(2, "copy of one id", "en"), (2, "copy of one id", "de"), (1, "copy of one id", "xx"), (1, "copy of one id", "en"), (7, "copy of one id", None), (None, "copy of one id", "en"), (None, "copy of one id", "en")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 400, 2)] + [(2, None, 1), (2, 1, None), (None, 1, 1), (300, 0, 0), (300, 1, 0)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, part string, step int").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(docs, marks).collect()}
    assert got == brute_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs.limit(5), marks.limit(0)).count() > 0


def test_term_matrix_is_global(spark, odd_docs):
    matrix, names = filter_audit.term_matrix(odd_docs)
    words = {r["column"]: r["word"] for r in names.collect()}
    assert len(words) == names.count() == len(set(words.values()))
    got = Counter()
    for r in matrix.collect():
        columns, counts = np.frombuffer(r["columns"], np.int64), np.frombuffer(r["counts"], np.int32)
        for k, i in enumerate(r["id"]):
            own = slice(r["indptr"][k], r["indptr"][k + 1])
            assert len(set(columns[own])) == len(columns[own])
            got[i, tuple(sorted((words[c], int(n)) for c, n in zip(columns[own], counts[own])))] += 1
    want = Counter((r["doc_id"], tuple(sorted(Counter((r["text"] or "").split()).items()))) for r in odd_docs.collect())
    assert got == want


def test_byte_planes():
    values = np.array([0, 1, -1, 300, 2**31 - 1, -(2**31)], np.int32)
    assert (filter_audit.from_planes(filter_audit.planes(values)) == values).all() and not len(filter_audit.from_planes(b""))


def test_words_of_long_texts(monkeypatch):
    text = b"aa b\x0bcc\tdd  \xc3\xa9\xc2\xa0e\n" * 50 + b"z" * 90 + b" end"
    whole = filter_audit.count_words(text)
    monkeypatch.setattr(filter_audit, "PIECE", 7)
    assert filter_audit.count_words(text) == whole == Counter(text.split()) and b"\xc3\xa9\xc2\xa0e" in whole


# ------------------------------------------------------------------------------- whitening


@pytest.mark.parametrize("d, rank", [(1, 1), (7, 7), (24, 9), (33, 33), (12, 0)])
def test_factorisation(d, rank):
    rng = np.random.default_rng(d)
    z = rng.normal(size=(200, rank)) * 10.0 ** rng.integers(-3, 3, rank) @ rng.normal(size=(rank, d)) if rank else np.zeros((200, d))
    v = z.T @ z / 200
    factor = whitening.pivoted_cholesky(v)
    values, vectors = whitening.one_sided_jacobi(factor)
    want = np.linalg.eigvalsh(v)[::-1]
    assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, v, rtol=0, atol=1e-12 * max(1, np.abs(v).max()))
    assert np.allclose(values, want[:rank], rtol=1e-6, atol=1e-13 * want[0]) and np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
    assert np.allclose(vectors * values @ vectors.T, v, atol=1e-12 * max(1, np.abs(v).max()))


def test_rounds_cover_all_pairs():
    for n in (1, 2, 5, 8):
        assert sorted((min(a, b), max(a, b)) for r in whitening.rounds(n) for a, b in zip(*map(np.ndarray.tolist, r))) == list(itertools.combinations(range(n), 2))


def brute_whitening(vectors, k):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    z = fit - total / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, total)) for r in x], (x - total / n) @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening_brute(spark):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(300, 20)) * np.linspace(0.5, 4, 20) @ rng.normal(size=(20, 20))).astype(np.float32).tolist()
    good += good[:40] + [good[0]] * 100
    odd = [None, [], [1.0] * 19 + [None], [1.0] * 19 + [float("nan")], [float("-inf")] + [0.0] * 19, [1.0] * 7, [2.0] * 21]
    rows = [(i if i % 50 else None, v, i % 3, 5) for i, v in enumerate(good)] + [(1000 + i, v, 1, 5) for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component int").repartition(6)
    got = whitening.whiten(table).collect()
    n, far, white, explained = brute_whitening(good, 16)
    assert len(got) == 16 * len(good) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    by = {(r["vec_id"], r["component"]): r for r in got if r["vec_id"] is not None}
    known = [i for i in range(len(good)) if i % 50]
    ours = np.array([[by[i, c + 1]["whitened"] for c in range(16)] for i in known])
    sign = np.sign((ours * white[known]).sum(0))
    assert np.allclose(ours * sign, white[known], atol=1e-7) and all(by[i, 1]["deviation"] == far[i] for i in known)
    assert np.allclose([by[1, c + 1]["explained"] for c in range(16)], explained, rtol=1e-9)


def test_whitening_of_few_and_flat_vectors(spark):
    make = lambda vs: spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    assert whitening.whiten(make([[1.0, 2.0]] * 5)).count() == 0 and whitening.whiten(make([None])).count() == 0
    assert whitening.whiten(make([[1.0, 2.0]]).limit(0)).count() == 0
    flat = whitening.whiten(make([[float(i), 3.0, -2.0 * i] for i in range(10)] * 3)).collect()
    assert len(flat) == 30 and {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12 and flat[0]["n"] == 10
    huge = whitening.whiten(make([[1.5 * 2**24, 0.0], [0.0, 1.0], [5.0, 5.0]])).collect()
    assert {r["deviation"] is None for r in huge if r["vec_id"] == 0} == {True} and len(huge) == 6


def test_kept_digest(spark):
    rows = [(1, "the very same line in all of them"), (2, "the very same line in all of them"), (3, "the very same line in all of them\nx")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "", 3: rows[2][1]} and hashlib.sha256(b"").hexdigest().startswith("e3b0")
