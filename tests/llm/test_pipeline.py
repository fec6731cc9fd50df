"""The pipeline against a brute-force version of all its stages."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from shoalwater.llm import tokens

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    from tokenizers import Tokenizer

    rows = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    same = defaultdict(list)
    for r in rows:
        same[re.sub("[\x20\x09-\x0d]", "", r[1])].append(r)
    rows = [min(v, key=lambda r: (-len(r[1]), r[0])) for v in same.values()]
    sets, parent = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    rows = [r for r in rows if find(r[0]) == r[0]]
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    size = {s: sum(len(WORD.findall(r[1])) for r in v) for s, v in by.items()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, s)))}
    left, capped = 1.5 * sum(size.values()), set()
    while True:  # reshare until no source is above twice its size
        level = left / max(1, sum(w for s, w in weight.items() if s not in capped))
        over = {s for s in weight if s not in capped and level * weight[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
        left -= sum(2 * size[s] for s in over)
    tk, pieces = Tokenizer.from_file(tokens.vocabulary_path()), Counter()
    for s, v in by.items():
        budget = round(2 * size[s] if s in capped else level * weight[s])
        at = 0
        for r in sorted(v, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            n = len(WORD.findall(r[1]))
            part = max(0, min(n, budget % size[s] - at))
            at += n
            texts = [r[1]] * (budget // size[s] + (part == n)) + ([" ".join(WORD.findall(r[1])[:part])] if 0 < part < n else [])
            for t in texts:
                ids = np.array([*tk.encode(t, add_special_tokens=False).ids, 1], "<u4")
                for k in range(math.ceil(len(ids) / 4096)):
                    p = ids[4096 * k : 4096 * (k + 1)]
                    pieces[r[0], k, len(p), zlib.crc32(p.tobytes())] += 1
    return pieces


def test_pipeline(spark, make_text, tmp_path):
    rows = [(i, make_text(i, 30 + i * 7 % 200), f"s{i % 4}", ("en", "de")[i % 2]) for i in range(80)]
    rows += [(100 + i, rows[i][1] + "  ", "s0", "en") for i in range(0, 80, 9)] + [(200 + i, rows[i][1].replace("one", "oone", 1), None, None) for i in range(0, 80, 7)]
    rows += [(300, None, "s1", "en"), (301, "", "s1", None), (302, "12 34", "s1", "en"), (303, make_text(5, 9000), "s2", "en")]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, s, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == brute(rows)
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
