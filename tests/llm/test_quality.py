import math
import re
import zlib
from collections import Counter

from revlake.llm import quality


def brute(rows, labels):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    crc = lambda w: zlib.crc32(w.encode())
    grams = [[crc(w) % quality.BUCKETS for w in ws] + [(crc(a) * 31 + crc(b)) % quality.BUCKETS for a, b in zip(ws, ws[1:])] + [(crc(w[-2:]) * 37 + 1) % quality.BUCKETS for w in ws] for ws in words]
    good = {i for i, q in labels if q == 1 and i is not None}
    target, raw = Counter(), Counter()
    for (i, _), g in zip(rows, grams):
        raw.update(g)
        if i in good:
            target.update(g)
    nt, nr = sum(target.values()) + quality.BUCKETS, sum(raw.values()) + quality.BUCKETS
    weight = {b: math.log((target[b] + 1) / nt) - math.log((n + 1) / nr) for b, n in raw.items()}
    out = []
    for (i, t), ws, g in zip(rows, words, grams):
        seen = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        covered = {k + j for k in range(len(ws) - 4) if seen[tuple(ws[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        score = sum(weight[b] for b in g) / len(g) if g else 0.0
        failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
        out.append((i, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), failed, not failed and score >= quality.THRESHOLD, round(score, 4)))
    return out


CLEAN = "the quick brown fox jumps over the lazy dog and runs far away to the green hill where it rests"
ROWS = [
    *[(i, f"{CLEAN} w{i} é{i % 7} naïve 🙂 x{i * i} plain y{i} words z{i} here\nline {i}\nmore") for i in range(80)],
    *[(100 + i, " ".join(f"{w}{'$$$' if k % 2 else '&&&'}" for k, w in enumerate(f"{CLEAN} j{i} q{i}".split()))) for i in range(30)],
    (200, None),
    (201, ""),
    (202, " \t\n"),
    (203, "one two three four five"),
    (204, "a b c d e a b c d e a b c d e f g h i j k l m n o p"),
    (205, "x " * 5000),
    (206, "l1\nl1\n\n \nl1\nl2 | # <b>"),
    (207, "plumless a b c d buckeroo a b c d e f g h"),  # two words of one CRC-32
    (3, f"{CLEAN} second row of one id"),
    (None, CLEAN),
]
LABELS = [(i, 1) for i in range(60)] + [(3, 1), (None, 1), (100, 0), (5000, 1)]


def test_matches_brute_force(spark, make_docs):
    labels = spark.createDataFrame([(i, q, 0) for i, q in LABELS], "doc_id long, quality int, toxic int")
    got = quality.rules(make_docs(ROWS), labels)
    assert got.columns[:8] == ["doc_id", *quality.MEASURES, "base_failed", "kept"]
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((*r[:8], round(r.score, 4)) for r in got.collect()), key=key) == sorted(brute(ROWS, LABELS), key=key)
    kept = quality.kept_documents(make_docs(ROWS), labels)
    assert kept.columns == make_docs(ROWS).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in brute(ROWS, LABELS) if r[7])
    assert set(range(80)) <= {r.doc_id for r in kept.collect()} and not {r.doc_id for r in kept.collect()} & set(range(100, 208))


def test_empty(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.rules(make_docs([]), labels).collect() == []
    assert len(quality.rules(make_docs(ROWS[:3]), labels).collect()) == 3
