import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from revlake.llm import common, mixing, sharding


def brute_cuts(sizes, n):
    """Smallest capacity by trying all, and the greedy walk at it."""

    def walk(cap):
        out, load, k = [], 0, 0
        for s in sizes:
            if s > cap:
                return None
            if load + s > cap:
                k, load = k + 1, 0
            load += s
            out.append(k)
        return out if k < n else None

    return next((c, walk(c)) for c in itertools.count(1) if walk(c) is not None)


ROWS = [(i, t) for i, t in enumerate(["a", "bb", None, "", "a", "a", "x" * 5000, "dd", "é", "dd", "q w e"])] + [(3, ""), (None, "z"), (5, "a")]


def test_shards_match_brute_force(make_docs):
    got = sharding.shard(make_docs(ROWS), 3).collect()
    groups = defaultdict(int)
    for _, t in ROWS:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    keys = sorted(groups)
    _, where = brute_cuts([groups[k] for k in keys], 3)
    place = dict(zip(keys, where))
    expected = Counter((i, zlib.crc32((t or "").encode()), place[hashlib.md5((t or "").encode()).hexdigest()]) for i, t in ROWS)
    assert Counter((r.doc_id, r.text_crc32, r.shard) for r in got) == expected
    for k in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))


def test_empty_tables(make_docs):
    assert sharding.shard(make_docs([]), 8).collect() == []
    assert mixing.mix(make_docs([])).collect() == []




@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 9))
def test_range_search_is_exact(sizes, n):
    """Opening ranges level by level ends at the brute-force capacity."""
    keys = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(len(sizes)))
    table = list(zip(keys, sizes))

    def at(digits, prefixes=None):
        found = defaultdict(lambda: [0, 0])
        for k, s in table:
            if prefixes is None or any(k.startswith(p) for p in prefixes):
                found[k[:digits]][0] += s
                found[k[:digits]][1] += 1
        return [(k, s, c) for k, (s, c) in found.items()]

    digits, ranges = 1, sharding._Ranges(at(1))
    while True:
        low, high = ranges.least(True, n), ranges.least(False, n)
        opened = ranges.cuttable(low, high, n)
        if not opened:
            break
        prefixes = {ranges.rows[k][0] for k in opened}
        digits += 1
        ranges = sharding._Ranges([r for r in ranges.rows if r[0] not in prefixes] + at(digits, prefixes))
    assert high == brute_cuts(sizes, n)[0]


def brute_targets(sizes):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in full}
        level = (total - sum(full.values())) / sum(rest.values()) if rest else 0
        over = [s for s, w in rest.items() if level * w > 2 * sizes[s]]
        if not over:
            return full | {s: level * w for s, w in rest.items()}
        full |= {s: 2 * sizes[s] for s in over}


def test_mixing_targets_and_copies(make_docs):
    rows = [(i, "w " * (1 + i * 7 % 40), src) for i, src in enumerate(["a"] * 60 + ["b"] * 5 + [None] * 20 + ["c"] * 90 + ["é"] * 8)] + [(1, "w w", "a"), (2, None, "b"), (None, "", "z")]
    got = mixing.mix(make_docs(rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    expected = brute_targets(sizes)
    by_size = {(sizes[s], round(expected[s], 6)) for s in sizes}
    assert {(r.source_size, round(r.target, 6)) for r in got} == by_size
    for r in got:
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    taken = defaultdict(int)
    for r in got:
        taken[(r.source_size, round(r.target, 6))] += r.taken
    for key, words in taken.items():
        assert abs(words - key[1]) <= 2 * 40
    assert sorted(map(tuple, mixing.mix(make_docs(rows)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixed_documents_repeat_rows(make_docs):
    docs = make_docs([(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(40)])
    expected = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in expected.items() if v})


def test_rows_without_ids_are_dealt_over_many_cells(spark, make_docs, monkeypatch):
    monkeypatch.setattr(common, "CELL_ROWS", 50)
    rows = [(None, f"t{i} " * (1 + i % 3), "ab"[i % 2]) for i in range(10_000)]
    got = sharding.shard(make_docs(rows), 4)
    for k, slots in got.groupBy("shard").agg(F.sort_array(F.collect_list("slot"))).collect():
        assert slots == list(range(len(slots)))
    cells = sharding.measured(make_docs(rows)).select(F.substring(common.order_digest("doc_id", "group_key"), 1, common.cell_digits(10_000)).alias("c"))
    assert cells.groupBy("c").count().agg(F.max("count")).first()[0] < 100
    mixed = mixing.mix(make_docs(rows)).groupBy("target").agg(F.sum("taken").alias("n")).collect()
    assert len(mixed) == 2 and all(abs(r.n - r.target) <= 9 for r in mixed)
    assert mixing.mixed_documents(make_docs([])).collect() == []
    odd = [(1, None, "a"), (1, "x y", "a"), (1, "x y", "a"), (None, "x y", None)]
    expected = Counter({(r.doc_id, r["size"]): 0 for r in mixing.mix(make_docs(odd)).collect()})
    for r in mixing.mix(make_docs(odd)).collect():
        expected[r.doc_id, r["size"]] += r.copies
    assert Counter((r.doc_id, len((r.text or "").split())) for r in mixing.mixed_documents(make_docs(odd)).collect()) == +expected
