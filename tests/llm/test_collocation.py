import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from revlake.llm import collocation


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counts_of(rows, longest):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for b in range(len(words)):
                for e in range(b + 1, min(len(words), b + longest) + 1):
                    counts[lang][tuple(words[b:e])] += 1
    return counts, total


def brute(rows, top, longest, least):
    counts, total = counts_of(rows, longest)
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            score, _, left, right = min((2000000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 80 * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "ångström", "Ö", "a" * 70, "b" * 64, "x-y", "’", " ", "ſK", *(f"w{i}" for i in range(30))]
    borders = [" ", " ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", "\x0b", "!?", "\x00 "]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(vocabulary[: rng.choice([4, 12, 41])]) + rng.choice(borders) for _ in range(rng.randrange(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    rows += [(200, None, "en"), (201, "", None), (202, " \t ", "en"), (203, "...", "fr"), (None, "the of the of", "en")]
    rows += [(300, "same words over and over again", "en")] * 40  # repeated rows
    rows += [(400, " ".join(rng.choice(vocabulary) for _ in range(3000)), "de")]  # longer than a block
    return rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(*r, "x", 1, 2) for r in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, `a.b` string, phrase int, n int").repartition(5)


@pytest.mark.parametrize("sizes", [{}, {"part": 7, "entries": 5, "block": 100}, {"part": 40, "block": 1000}])
def test_against_brute_force(docs, rows, sizes):
    got = sorted(map(tuple, collocation.collocations(docs, top=25, least=3, **sizes).collect()))
    want = brute(rows, 25, 4, 3)
    assert len(want) > 60 and got == want


def test_counts_of_all_lengths(docs, rows):
    phrases, totals = collocation.phrase_counts(docs, longest=5, least=2, part=11, entries=50, block=300)
    counts, total = counts_of(rows, 5)
    assert {(r.lang, r.phrase): r.n for r in phrases.collect()} == {(g, " ".join(p)): n for g, c in counts.items() for p, n in c.items() if n >= 2}
    assert {r.lang: r.n for r in totals.collect()} == dict(total)


def test_every_word_is_one_block_s_own():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab ,\n") for _ in range(rng.randrange(400))).encode() for _ in range(30)] + [b"w" * 500, b" " * 300]
    for size in (1, 10, 100):
        own = []
        for stretch, low, high in collocation.blocks(texts, size, 3):
            words = collocation.Words(stretch, "en")
            own += [stretch[b:e] for b, e in zip(words.begin, words.end) if low <= b < high]
        assert sorted(own) == sorted(w for t in texts for w in re.findall(rb"[^ ,\n]+", t))


def test_equal_hashes_mean_equal_words():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in rng.integers(1, 90, 20_000)]
    h = collocation.Words(b" ".join(words), "en").h
    assert len(set(zip(*h.tolist()))) == len(set(words)) == len(set(h[0].tolist()))


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    score = F.expr("(2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    a, left, right = 4 * 10**17 + 1, 5 * 10**18 + 3, 9 * 10**18 + 7
    assert spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(score).first()[0] == 2000000 * a // (left + right)


def test_empty_table(spark, docs):
    assert collocation.collocations(docs.limit(0)).count() == 0
    assert collocation.collocations(docs.select("doc_id", "lang", docs.lang.cast("string").alias("text")).filter("lang is null")).count() == 0


def test_groups_are_mined_together_and_infrequent_phrases_do_not_grow(monkeypatch):
    import pyarrow as pa

    rows = [("en", b"a b c", 1, 3), ("en", b"a b d", 1, 2), ("de", b"a b c", 1, 9), ("en", b"z y", 0, 1), ("en", b"q \xc3\xb6 q r", 1, 4)]
    lang, fragment, place, n = pa.array([r[0] for r in rows]), pa.array([b"cut"] + [r[1] for r in rows], pa.binary()).slice(1), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    grown = []
    alike = collocation._alike
    monkeypatch.setattr(collocation, "_alike", lambda key, n: grown.append(len(key)) or alike(key, n))

    def found(whole):
        grown.clear()
        return sorted((lang[int(r)].as_py(), p, int(c), bool(whole[r])) for at, some, total in collocation._phrases(lang, fragment, place, n, whole, 4, 4) for r, p, c in zip(at, some, total))

    everything = [("de", b"a b", 9), ("de", b"a b c", 9), ("de", b"b", 9), ("de", b"b c", 9), ("en", b"a b", 5), ("en", b"b", 5), *(("en", x.encode(), 4) for x in ("q ö", "q ö q", "q ö q r", "ö", "ö q", "ö q r"))]
    assert found(np.ones(5, bool)) == sorted((*r, True) for r in everything)
    assert sum(grown) == 17  # b c, b d and z go no further
    rare = [("en", b"a b c", 3), ("en", b"a b d", 2), ("en", b"b c", 3), ("en", b"b d", 2), ("en", b"z", 1), ("en", b"z y", 1)]
    assert found(np.zeros(5, bool)) == sorted((*r, False) for r in everything + rare)


def test_a_group_of_many_pieces_is_never_whole(spark):
    rows = [(7, "en", f"w{i % 50} p".encode(), 1, 1, False) for i in range(400)] + [(9, "en", b"x", 0, 5, False)]
    routed = spark.createDataFrame(rows, "key long, lang string, fragment binary, place int, n long, dealt boolean")
    for entries, pieces in ((7, True), (1000, False)):
        got = collocation.mined(routed, least=3, entries=entries).collect()
        total = {}
        for r in got:
            total[bytes(r.phrase)] = total.get(bytes(r.phrase), 0) + r.n
            assert r.whole == (not pieces or bytes(r.phrase) == b"x")
        assert total == {b"p": 400, b"x": 5, **{f"w{i} p".encode(): 8 for i in range(50)}}
