import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
from revlake.llm import bpe, minhash, mixing, pii
from tests.llm.test_minhash import brute as brute_classes
from tests.llm.test_pii import brute_spans
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_sharding_mixing import brute_targets


def test_tokens_are_decoded(spark, make_docs):
    rows = [(1, "the cat  sat\n on Ünïcode 日本 "), (2, ""), (3, None), (4, "x" * 2000), (4, "x" * 2000)]
    got = corpus_pipeline.tokens(spark, make_docs(rows), "").collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert all(r.n_tokens == len(r.ids) for r in got)


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(["th", "er", "on", "an", "ing", "keit", "o"], k=rng.randint(1, 4)))
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.choice([15, 40, 80]))] + [rng.choice(["a.b@c.org", "4785380592391139", "4785380592391130", "10.2.3.4", "call 743 555 3824", "x"])]
        rows.append((i, " ".join(words), "abc"[i % 3]))
    rows += [(100 + i, rows[i % 4][1] + rng.choice(["", " end"]), "b") for i in range(12)]
    return rows + [(200, None, "a"), (201, "", None), (202, "too short", None), (203, "a b c d e " * 9, "a"), (None, "x y z " + " ".join(word() for _ in range(20)), None)]


def test_stages_match_a_composition_of_brute_force(spark, make_docs, tmp_path):
    """Each stage works on all that the one before kept, and its decisions take effect."""
    rows, labels = corpus(), [(i, 1) for i in [*range(60), *range(100, 112)]] + [(200, 0)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    passed = [r[7] for r in brute_quality([r[:2] for r in rows], labels)]
    kept = [r for r, ok in zip(rows, passed) if ok]
    named = [r[:2] for r in kept if r[0] is not None]
    root = brute_classes(named, minhash._idf(make_docs(kept)))
    kept = [r for r in kept if r[0] is None or root[r[0]] == r[0]]
    spans = brute_spans([t or "" for _, t, _ in kept])
    parse = lambda s: [(k, int(b), int(e)) for k, b, e in (x.split(":") for x in s.split(",") if x)]
    clean = [(i, pii.redacted(t or "", parse(spans[n])), s) for n, (i, t, s) in enumerate(kept)]
    size = lambda t: len((t or "").split())
    sizes = Counter()
    for _, t, s in clean:
        sizes[s] += size(t)
    targets, expected = brute_targets(sizes), Counter()
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for s in sizes:
        u = int(md5(f"{mixing.SEED}:{'n' if s is None else 's' + s}")[:8], 16) / 2**32
        mine = sorted((d for d in clean if d[2] == s), key=lambda d: (math.floor(math.log2(size(d[1]) + 1) * 8), md5(f"{'n' if d[0] is None else d[0]}|{md5(d[1] or '')}")))
        rate = targets[s] / sizes[s] if sizes[s] else 0.0
        for at, (i, t, _) in enumerate(mine):
            copies = math.floor(u + rate * (at + 1)) - math.floor(u + rate * at)
            if copies:
                expected[i, s, hashlib.sha256((t or "").encode()).hexdigest()] = copies
    assert Counter((r.doc_id, r.source, r.decoded_sha256) for r in got) == expected
    assert len(kept) < sum(passed) < len(rows) and any(spans.values())
    coder = bpe.Coder(*bpe._vocabulary(None))
    assert all(hashlib.sha256(coder.decode([b"".join(x.to_bytes(4, "little") for x in r.ids)])[0]).hexdigest() == r.decoded_sha256 for r in got)


def test_stages_on_empty_tables(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
