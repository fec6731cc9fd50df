"""Each operator on odd input, on an empty table, and against brute force."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shoalwater.operators import graph
from shoalwater.llm import common, embedding_dedup, exact_dedup, html_extract, language, mixing, near_dedup, packing, quality, tokens, url_filter

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


# ------------------------------------------------------------------------------- URL filter


def test_url_rules(spark):
    urls = {1: "http://A.Net/x", 2: "https://example.NET/en/1?q", 3: "http://m.example.net/de/", 4: "http://example.com/de/a#b", 5: "http://www.org/fr/", 6: "http://badnet/x", 7: "net", 8: None, 9: "http://net", 10: "x://spam-farm.example.org/a", 11: "http://example.org/en"}
    pages = spark.createDataFrame([(k, u, "verdict") for k, u in urls.items()], "page_id long, url string, verdict string")
    rules, listed = url_filter.rule_table(spark, url_filter.RULES), url_filter.rule_table(spark, url_filter.LISTED)
    for most in (url_filter.MAX_BITS, 20):  # in one part, and in several
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules, [1, 4], listed, max_bits=most).collect()}
        assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("example.net", "/en/1", "example.net/en/", "allow")
        assert got[3][2:] == ("net/", "block") and got[4] == ("example.com", "/de/a", "example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow")
        assert got[6] == ("badnet", "/x", None, "allow") and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
        assert got[9] == ("net", "", None, "allow") and got[10][2:] == (None, "block") and got[11][2:] == (None, "allow")
    assert url_filter.judge(pages.limit(0), rules, [1, 4], listed).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key").union(spark.createDataFrame([(None,)], "key string"))
    listed = spark.range(0, 20_000, 37).selectExpr("concat('k', id) AS key")
    cascade = url_filter.Cascade(universe, listed)
    assert len(cascade.levels) > 1
    held = {r["key"] for r in universe.where("key IS NOT NULL").withColumn("in", cascade.contains(common.F.col("key"))).where("in").collect()}
    assert held == {f"k{i}" for i in range(0, 20_000, 37)}
    assert not url_filter.Cascade(universe, listed.limit(0)).levels


def test_long_lists_are_judged_part_by_part(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 700, '.example.org/', repeat('x', id % 3)) AS url")
    listed = spark.range(0, 700, 3).selectExpr("'block' AS action", "concat('h', id, '.example.org/') AS key")
    none = listed.limit(0)
    assert url_filter.parts_for(listed.select("key"), [none, listed], 500) > 2
    one, many = ({(r["page_id"], r["verdict"]) for r in url_filter.judge(pages, none, [1], listed, max_bits=m).collect()} for m in (url_filter.MAX_BITS, 500))
    assert one == many == {(i, "block" if i % 700 % 3 == 0 else "allow") for i in range(3000)}


def test_very_long_and_repeated_urls(spark):
    long_ = "http://" + "a." * 300 + "net/" + "y" * 200_000
    pages = spark.createDataFrame([(1, long_), (1, long_), (2, "http://" + "b" * 100_000)], "page_id long, url string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES), [1, 4]).collect())
    assert got == [(1, "net/", "block"), (1, "net/", "block"), (2, None, "allow")]


# ------------------------------------------------------------------------------- dedup


def test_word_hashes_follow_words():
    a, b = common.Words([b"ab cd  ab", b"", b"\tcd\n"]), None
    h = a.hashes()
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1] and a.first.tolist() == [0, 3, 3, 4]
    assert b is None


def test_word_hashes_across_windows(monkeypatch):
    texts = [b"abcdefghij" * 3 + b" ab", b"ab", b" abcdefghij" * 4, b"abcdefghij" * 3]
    whole = common.Words(texts).hashes()
    monkeypatch.setattr(common, "WINDOW", 7)
    assert (common.Words(texts).hashes() == whole).all() and whole[0] == whole[-1] and whole[1] == whole[2] and len(set(whole.tolist())) == 3


def test_hash_bound_never_falls_to_nothing():
    for n in (1, 1000, 10**9, 10**12):
        share = (common.hash_bound(1600, n) + 2**63) / 2**64
        assert abs(share * n - min(n, 1600)) < 1


def test_near_dedup_brute(spark, odd_docs, make_text):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for g in range(6):  # groups of near copies around one text, at several distances
        words = make_text(1000 + g, 120).split()
        for k in range(25):
            w = list(words)
            for j in range(k % 7):
                w[(k * 31 + j * 17) % 120] = f"z{k}x{j}"
            rows.append((2000 + 100 * g + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.groups(docs).collect()
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for c in ids[:n]:
            common_ = len(sets[a] & sets[c])
            if common_ and 100 * common_ >= 85 * (len(sets[a]) + len(sets[c]) - common_):
                x, y = find(a), find(c)
                parent[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])


def test_near_dedup_of_repeated_ids(spark, make_text):
    """Rows of one id are one node, so what their texts are linked with is one component."""
    a, b = make_text(50, 80), make_text(51, 80)
    docs = spark.createDataFrame([(5, a), (7, a + " x"), (7, b), (9, b + " y"), (11, make_text(52, 80))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.groups(docs).collect()) == [(5, 5, True), (7, 5, False), (7, 5, False), (9, 5, False), (11, 11, True)]


@pytest.mark.parametrize("span", [3, 10_000])
def test_long_buckets_lose_no_link(spark, monkeypatch, span):
    """Texts that share a long passage but are unlike otherwise: every bucket that they share holds many components."""
    monkeypatch.setattr(near_dedup, "SPAN", span)
    passage = " ".join(f"p{i}" for i in range(100))
    texts = {i: passage + " " + " ".join(f"own{i // 2}x{k}" for k in range(40)) + (" tail" if i % 2 else "") for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.groups(docs).collect()} == {i: i // 2 * 2 for i in texts}


def test_near_dedup_empty(no_docs):
    assert near_dedup.groups(no_docs).count() == 0 and near_dedup.keepers(no_docs).columns == no_docs.columns


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_golomb_round_trip(n):
    values = np.sort(np.random.default_rng(n).integers(2**40, 2**41, n, dtype=np.uint64))
    if n > 4:
        values[1] = values[0]
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values, 2**40, 2**40), 2**40) == values).all()


def test_exact_dedup(odd_docs):
    rows = odd_docs.collect()
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r["text"])].append(r)
    got = exact_dedup.dedup(odd_docs).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        own = by_sha[r["text_sha256"]]
        best = min(own, key=lambda x: (-len(x["text"] or ""), x["doc_id"] is None, x["doc_id"] or 0))
        assert r["group_size"] == len(own) and r["keep_id"] == best["doc_id"] and (not r["kept"] or r["doc_id"] == best["doc_id"])


def test_stages_take_columns_of_any_name(spark, make_text):
    """Names that helpers use inside stay the user's; ids repeat, so rows are found again by text."""
    names = "_key _source _range _before _r _start _own_size _sha _kept _id key range from start before sha id c0 c1 size taken".split()
    rows = [(i // 2, make_text(i // 3, 20), "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, source string", *[f"`{n}` string" for n in names]]))
    for got in (exact_dedup.keepers(docs), mixing.mixed(docs), near_dedup.keepers(docs)):
        assert got.columns == docs.columns
        for r in got.collect():
            number = r["_key"].removeprefix("_key")
            assert all(r[n] == f"{n}{number}" for n in names)
    assert exact_dedup.keepers(docs).count() == 4 and mixing.take(docs.drop("size", "taken")).count() == 12


def test_exact_keepers(odd_docs, no_docs):
    kept = exact_dedup.keepers(odd_docs)
    texts = [re.sub(r"\s", "", r["text"] or "") for r in kept.collect()]
    assert kept.columns == odd_docs.columns and len(texts) == len(set(texts)) == len({re.sub(r"\s", "", r["text"] or "") for r in odd_docs.collect()})
    assert exact_dedup.dedup(no_docs).count() == 0 and exact_dedup.keepers(no_docs).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((12, 16))
    rows = [(i, (centre[i % 12] + 0.03 * (1 + i % 4) * rng.standard_normal(16)).astype(np.float32).tolist(), i % 3) for i in range(600)]
    rows += [(700, rows[0][1], 0), (701, rows[0][1], None), (702, None, 0), (703, [0.0] * 16, 0), (704, [float("nan")] * 16, 0), (705, [1.0, None] + [0.0] * 14, 0), (706, [float("inf")] + [0.0] * 15, 0), (707, [2 * x for x in rows[0][1]], 0), (708, [1.0, 2.0], 0), (709, [], 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, v string")
    got = embedding_dedup.dedup(df).collect()
    assert len(got) == len(rows)
    fine = [(i, v, np.array(e, float)) for i, e, v in rows if e and v is not None and None not in e and np.isfinite(np.array(e, float)).all() and np.any(np.array(e))]
    links, parent = Counter(), {i: i for i, _, _ in fine}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, label, e) in enumerate(fine):
        for m, (j, other, f) in enumerate(fine):
            if n != m and label == other and len(e) == len(f) and e @ f / math.sqrt((e @ e) * (f @ f)) >= 0.98:
                links[n] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = {i: (links[n], find(i)) for n, (i, _, _) in enumerate(fine)}
    for r in got:
        n, c = want.get(r["vec_id"], (0, r["vec_id"]))
        assert (r["n_links"], r["component_id"], r["kept"]) == (n, c, c == r["vec_id"])
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_embedding_star(spark):
    """Far more copies of one vector than a window holds, few of them similar to each other."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3001, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base, side = x[0], x[1:] - (x[1:] @ x[0])[:, None] * x[0]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x[1:] = 0.982 * base + math.sqrt(1 - 0.982**2) * side
    x = x[rng.permutation(3001)].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in embedding_dedup.dedup(df).collect()}
    assert near.sum(axis=1).max() == 3000
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (int(n), 0, i == 0) for i, n in enumerate(near.sum(axis=1))}


# ------------------------------------------------------------------------------- classifiers


def test_language(spark, odd_docs, no_docs):
    german = ["der die und ist nicht", "und das haus ist gross", "die frau und der mann", "nicht der tag und die nacht"]
    english = ["the house and the street", "this is not the day", "and the man with the dog", "the night is not long"]
    rows = [(i, f"{(german, english)[i % 2][i // 2 % 4]} {i}", ("de", "en")[i % 2], "s") for i in range(200)] + [(900, "und die strasse ist lang", None, "s"), (901, None, "de", "s"), (902, "12 !", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in language.predict(docs, language.fit(docs, language.model_path())).collect()}
    held = [r for i, r in got.items() if r["held_out"] and i < 200]
    assert held and all(r["lang_pred"] == ("de", "en")[r["doc_id"] % 2] for r in held)
    assert got[900]["lang_pred"] == "de" and got[901]["lang_pred"] == got[902]["lang_pred"] == "und" and got[901]["score"] == 0
    kept = language.keepers(docs, language.model_path())
    assert kept.columns == docs.columns and {r["doc_id"]: r["lang"] for r in kept.collect()}[900] == "de" and kept.count() == 201
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(docs.limit(0), language.model_path())).collect()} == {"und"}
    assert language.keepers(odd_docs, language.model_path()).columns == odd_docs.columns and language.keepers(no_docs, language.model_path()).count() == 0


def test_forward_sums_all_segmentations():
    pieces = [b"\x01", b"\x01a", b"a", b"b", b"ab", b"\x01ab", b"bb"]
    model = language.Unigrams(pieces, ["x", "y"], np.arange(14, dtype=float).reshape(7, 2))

    def total(word: bytes, k: int) -> float:
        if not word:
            return 1.0
        return sum(model.p[i, k] * total(word[len(p) :], k) for i, p in enumerate(pieces) if word.startswith(p))

    for word in ("ab", "abb", "bbab", "a" * 9):
        got = model.log_probabilities([word])[0]
        assert np.allclose(got, [math.log(total(b"\x01" + word.encode(), k)) for k in (0, 1)])
    long = model.log_probabilities(["ab" * 300, "ü" * 100])
    assert np.isfinite(long).all()


def test_long_words_are_not_cut():
    """Pieces across any place of a long word count: the sums agree with the recursion over the whole word."""
    pieces = ["\x01", "\x01a", "a", "b", "ab", "ba", "bba", "aabba", "ü", "üa"]
    raw = [x.encode() for x in pieces]
    model = language.Unigrams(raw, ["x", "y"], np.arange(20, dtype=float).reshape(10, 2) ** 2)
    words = ["ab" * 19 + "a", "ab" * 20, "aabba" * 30, "ab" * 300, "ü" * 100, "aüaab" * 90 + "c", "b" * 255, "b" * 256, "a" * 1100, "ab"]

    def total(word: bytes, k: int) -> float:
        logs = [0.0]
        for n in range(1, len(word) + 1):
            into = [logs[n - len(x)] + math.log(model.p[i, k]) for i, x in enumerate(raw) if word[:n].endswith(x)]
            logs.append(np.logaddexp.reduce(into + [logs[n - 1] + math.log(language.UNKNOWN)] * (word[n - 1 : n] not in raw)))
        return logs[-1]

    assert np.allclose(model.log_probabilities(words), [[total(b"\x01" + w.encode(), k) for k in (0, 1)] for w in words], rtol=1e-9)


def test_quality(spark, make_text, odd_docs, no_docs):
    rows = [(i, make_text(i, 60) if i % 4 else make_text(i, 60).upper().replace(" ", "!! "), int(i % 4 > 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(900, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    held = [i for i, r in got.items() if r["held_out"] and i < 400]
    assert np.mean([got[i]["predicted"] == int(i % 4 > 0) for i in held]) > 0.95
    assert len(got) == 402 and 0 <= got[900]["score"] <= 1 and got[900]["score"] == got[901]["score"]
    voter = quality.fit(docs, labels.limit(0))
    assert quality.score(odd_docs, voter).count() == odd_docs.count() and quality.score(no_docs, voter).count() == 0


# ------------------------------------------------------------------------------- mixing


def test_mixing(odd_docs, no_docs):
    got = mixing.take(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v) and v[0]["target"] <= 2 * v[0]["source_size"]
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 1
    mix = mixing.mixed(odd_docs)
    assert mix.columns == odd_docs.columns and mix.select("text").rdd.map(lambda r: len(WORD.findall(r[0]))).sum() == sum(r["taken"] for r in got)
    assert mixing.take(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


# ------------------------------------------------------------------------------- tokens and packing


@functools.cache
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def _ids(text):
    return _tokenizer().encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("shard_docs, shard_bytes", [(10**6, 10**9), (5, 10**9), (10**6, 3000)])
def test_token_files(spark, odd_docs, no_docs, shard_docs, shard_bytes):
    """One file a task, and files that are rolled by documents or by bytes."""
    out = common.new_path(spark, "tokens")
    manifest, dictionary = tokens.write_shards(odd_docs, out, tokens.vocabulary_path(), shard_docs=shard_docs, shard_bytes=shard_bytes)
    assert (manifest.where("roll > 0").count() > 0) == (shard_docs < 10 or shard_bytes < 10**6) and manifest.where(f"n_docs > {shard_docs}").isEmpty()
    got = tokens.read_shards(manifest, out, dictionary).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = np.array([*_ids(r["text"]), 2], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert ids == sorted(ids)
    manifest, dictionary = tokens.write_shards(no_docs, out, tokens.vocabulary_path())
    assert tokens.read_shards(manifest, out, dictionary).count() == 0


def test_encoder_equals_whole_text():
    e = tokens.WordEncoder(tokens.vocabulary_path())
    rng = np.random.default_rng(4)
    alphabet = [*"abcABZ'stmdrevl09._-<|>\x00\x1c\x7f\x85 \t\n\u00a0\u3000\u00e9\u00c9e\u0301\u0130\u00df\u03a3\u03c2\u4f60\U0001f600\u212a\u00d7\u00f7\u00de", "<|endoftext|>", "<|ENDOFTEXT|>", "'re", "'LL"]
    mixed = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 30, 2000)]
    for text in (*mixed, "It's 2024-01-01, it'S <|endoftext|>x\u00a0y \u0130 \u03a3\u03a3 don't\x1cstop", "é e\u0301 \ud55c\uad6d\uc5b4 \U0001f600\U0001f600!!", " "):
        assert np.frombuffer(e.encode(text.encode()), "<u4").tolist() == _ids(text)


def test_packing(odd_docs, no_docs):
    got = packing.pack_documents(odd_docs, tokens.vocabulary_path(), capacity=512).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = np.array([*_ids(r["text"]), 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[r["doc_id"], k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) <= math.ceil(sum(r["length"] for r in got) / 512) + 2
    assert packing.pack_documents(no_docs, tokens.vocabulary_path()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(int(x) for x in np.clip(rng.lognormal(3.2, 1, 3000), 1, 256))
    plan = packing.plan_for(dict(counts), 256)
    ranks, fill = defaultdict(list), Counter()
    for length, first, times, seq, offset in plan.places:
        ranks[length] += range(first, first + times)
        for k in range(times):
            fill[seq + k] += length
    assert all(sorted(ranks[x]) == list(range(n)) for x, n in counts.items()) and max(fill.values()) <= 256
    assert len(fill) <= 1.01 * sum(x * n for x, n in counts.items()) / 256 + 2


@pytest.mark.parametrize("seed", range(6))
def test_plan_never_needs_more_than_best_fit_alone(seed):
    """Odd lengths: exact combinations take the partners that long pieces need."""
    rng = np.random.default_rng(seed)
    counts = {int(x): int(rng.integers(1, 2000)) for x in range(1, 512, 2 if seed % 2 else 1)}
    plan, alone = packing.plan_for(counts, 512), packing.Plan(counts, 512, 0)
    assert -(-sum(x * n for x, n in counts.items()) // 512) <= plan.sequences <= alone.sequences
    fill, ranks = Counter(), defaultdict(int)
    for length, _, times, seq, offset in plan.places:
        ranks[length] += times
        for k in range(times):
            assert fill[seq + k] == offset
            fill[seq + k] += length
    assert dict(ranks) == counts and max(fill.values()) <= 512 and len(fill) == plan.sequences


# ------------------------------------------------------------------------------- HTML


def test_html_parser():
    p = html_extract.Page("<p>a<p>b &amp; <b>c</b>d<br>e<!-- <p>x --><script>var t='</p>';</script><ul><li>f<li>g</ul>h")
    assert [t for _, t, _ in p.runs] == ["a", "b & cd e", "f", "g", "h"]


def test_html_formulas_are_text():
    p = html_extract.Page("<p>We set <math><msup><mi>x</mi><mn>2</mn></msup><annotation>x^2</annotation></math> to zero, <object>a plot</object>.")
    assert [t for _, t, _ in p.runs] == ["We set x2 to zero, a plot."]


def test_html_repeated_and_very_long_pages(spark, make_text):
    page = lambda n: f"<html><body><nav><a href=/>home</a></nav><article>{''.join(f'<p>{make_text(i, 40)}.</p>' for i in range(n))}</article></body></html>"
    rows = [(i, "u", page(4 + i % 3)) for i in range(60)] + [(7, "u", page(5)), (7, "u", page(5)), (900, "u", page(9000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract(pages, html_extract.train(pages)).collect()
    assert len(got) == len(rows) and len({r["text"] for r in got if r["page_id"] == 7}) <= 2
    assert next(r["text"] for r in got if r["page_id"] == 900) == " ".join(make_text(i, 40) + "." for i in range(9000))


def test_html_extraction(spark, make_text):
    page = lambda i, body: f"<html><head><title>t{i}</title></head><body><nav><ul><li><a href=/>home</a><li><a href=/x>{make_text(i, 2)}</a></ul></nav><div class='ad'>{make_text(i + 7, 8)}</div><article><h1>{make_text(i, 5)}</h1>{body}</article><footer>&copy; {make_text(i, 9)}</footer></body></html>"
    bodies = {i: [make_text(i + k, 10 + (i * 7 + k * 11) % 60) + "." for k in range(1 + i % 5)] for i in range(120)}
    rows = [(i, f"u{i}", page(i, "".join(f"<p>{t}</p>" for t in b)), "clash") for i, b in bodies.items()] + [(500, None, None, ""), (501, "u", "", ""), (None, "u", "<p>x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(pages, html_extract.train(pages)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    texts = {r["page_id"]: r["text"] for r in got}
    right = sum(texts[i] == " ".join([make_text(i, 5), *b]) for i, b in bodies.items())
    assert right >= 115 and texts[500] == texts[501] == ""
    empty = pages.limit(0)
    assert html_extract.extract(empty, html_extract.train(empty)).count() == 0


@pytest.mark.parametrize("hubs", [3, 1000])
def test_components(spark, monkeypatch, hubs):
    monkeypatch.setattr(graph, "HUBS", hubs)
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (21, 21)] + [(30, 31 + i) for i in range(200)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert {got[i] for i in (1, 2, 3, 7, 8, 9)} == {1} and got[21] == got[20] == 20 and all(got[30 + i] == 30 for i in range(201))
    assert common.components(edges.limit(0)).count() == 0
