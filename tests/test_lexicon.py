import random

import pytest

from revlake.operators import lexicon as L
from revlake.operators import stemming

MAIN = "token_asli string, bentuk_baku string, buang string"


def table(spark, entries, noise=()):
    rows = [(k, v.split()) for k, v in entries.items()] + [(k, []) for k in noise]
    return spark.createDataFrame(rows, "token string, words array<string>")


def fold(spark, texts, entries, noise=(), limit=100):
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "id int, w array<string>")
    rows = L.attach(rows, "id", "w", table(spark, entries, noise), "words", "e", limit)
    return [" ".join(r.out) for r in L.folded(rows, "w", "e", "out").orderBy("id").collect()]


def by_word(words, entries, noise):
    """The rule, one word after the other."""
    out, parts = [], ()
    for w in words:
        if w in noise:
            continue
        if w in parts:
            parts = ()
            continue
        made = entries.get(w, w).split()
        a, _, b = made[0].partition("-")
        parts = (a, b) if len(made) == 1 and made[0].count("-") == 1 and b.startswith(a) else ()
        out += made
    return " ".join(out)


CASES = {
    "gara gara": "gara-gara",
    "gara zz gara": "gara-gara",  # noise between them does not count
    "naik gcr nya": "naik gocar-nya nya",  # no reduplication
    "gara gara gara": "gara-gara gara-gara",
    "ugal ugalan ugalan": "ugal-ugalan ugalan",
    "gabisa zz": "tidak bisa",
    "": "",
}
ENTRIES = {"gara": "gara-gara", "gcr": "gocar-nya", "ugal": "ugal-ugalan", "gabisa": "tidak bisa", "tiga": "a-b-c"}


@pytest.mark.parametrize("limit", [100, 0])
def test_reduplications(spark, limit):
    assert fold(spark, list(CASES), ENTRIES, ("zz",), limit) == list(CASES.values())


@pytest.mark.parametrize("limit", [100, 0])
def test_folding_against_the_rule(spark, limit):
    rng = random.Random(4)
    entries = ENTRIES | {"x": "x-x", "y": "y-yz", "n": "m"}
    texts = [" ".join(rng.choices(["x", "x", "y", "yz", "gara", "gara-gara", "zz", "n", "word", "ugalan", "ugal"], k=rng.randrange(30))) for _ in range(200)]
    assert fold(spark, texts, entries, ("zz",), limit) == [by_word(t.split(), entries, {"zz"}) for t in texts]


def test_long_texts_are_folded_in_linear_time(spark):
    text = "x zz " * 100_000
    assert fold(spark, [text], {"x": "x-x"}, ("zz",)) == [" ".join(["x-x"] * 50_000)]


def test_layers(spark):
    main = spark.createDataFrame([("A ", "a baik", ""), ("b", "bb", "x"), ("it", "itu", ""), ("c", "", ""), ("d", "dd", "nan"), ("e", "ee", None), (None, "x", "")], MAIN)
    extra = spark.createDataFrame([("a", "aa"), ("b", "bbb"), ("jek", "gojek"), ("f", "ff gg")], "token_asli string, bentuk_baku string")
    reviewed = spark.createDataFrame([("f", "", "ya"), ("it", "teknologi", "tidak"), ("e", "eee", ""), ("b", "q", "")], MAIN)
    got = {r.token: " ".join(r.words) for r in L.layered(main, extra, reviewed).collect()}
    assert got == {"a": "aa", "b": "", "d": "dd", "e": "eee", "f": "", "it": "teknologi"}


def test_stop_words_keep_negation(spark):
    listed = spark.createDataFrame([("tidak",), ("yang",), ("yang",), ("bisa",)], "word string")
    assert [r.token for r in L.stop_words(listed).collect()] == ["yang"]


@pytest.mark.parametrize("entries", [100, 0])
def test_clean_table(spark, entries):
    raw = spark.createDataFrame(
        [(1, "n", "GPP full call, jahatt bill!! Top-up gara2 go-jek memesan makanannya", 1, "2024-01-01", 0, "5.11.2"), (2, "n", None, 5, None, 0, None), (3, "n", "memang 👍🏽👍", 3, None, 0, "x")],
        "id long, nama_user string, ulasan string, rating int, tanggal string, likes int, versi_app string",
    )
    lexicon = table(spark, {"gpp": "tidak apa-apa", "full": "penuh", "call": "telepon", "gara": "gara-gara"})
    roots = spark.createDataFrame([("makan",), ("jahat",)], "root string")
    stop = L.stop_words(spark.createDataFrame([("penuh",), ("tidak",)], "word string"))
    got = L.clean_table(raw, lexicon, stop, lambda words: stemming.stem_words(words, roots), entries).orderBy("id").collect()
    assert got[0].ulasan_normalized == "tidak apa-apa penuh telepon jahat bill topup gara-gara gojek memesan makanannya"
    assert got[0].ulasan_clean == "tidak apa telepon jahat bill topup gara gojek pesan makan"  # halves that agree are one
    assert (got[0].versi_minor, got[0].word_count, got[0].sentimen_aktual) == ("5.11", 11, 0)
    assert (got[1].ulasan_normalized, got[1].ulasan_clean, got[1].word_count, got[1].versi_minor) == ("", "", 0, None)
    assert (got[2].ulasan_normalized, got[2].versi_minor, got[2].sentimen_aktual) == ("memang bagus", None, None) and len(got[0]) == 12


STEMS = {
    "makan": "makan", "makanannya": "makan", "dimakanlah": "makan", "memakan": "makan", "memukul": "pukul", "menulis": "tulis", "menyapu": "sapu", "mengirimkan": "kirim", "mengecat": "cat",
    "belajar": "ajar", "pelajar": "ajar", "bacalah": "baca", "mempermainkan": "main", "keberuntungannya": "untung", "menyanyi": "nyanyi", "mengambilkan": "ambil", "berlarian": "lari", "perampok": "rampok",
    "mata-matanya": "mata", "berbalas-balasan": "balas", "gara-gara": "gara", "terdekat": "dekat", "tertulis": "tulis", "pembelian": "beli", "pengiriman": "kirim", "penyanyi": "nyanyi", "kutahu": "tahu",
    "gerigi": "gigi", "tembok": "tembok", "memesan": "pesan", "a-b-c": "a-b-c", "xyz": "xyz", "x": "x",
}
ROOTS = "makan pukul tulis sapu kirim cat ajar baca main untung nyanyi ambil lari rampok mata balas dekat beli tahu gigi".split()


def test_stems(spark):
    words = spark.createDataFrame([(w,) for w in [*STEMS, None, "makan"]], "word string")
    roots = spark.createDataFrame([(w,) for w in [*ROOTS, "makan"]], "root string")
    assert {r.word: r.stem for r in stemming.stem_words(words, roots).collect()} == STEMS


def test_roots_are_their_own_stems(spark):
    words = spark.createDataFrame([("berita",), ("dimakan",), ("beritakan",)], "word string")
    roots = spark.createDataFrame([("berita",), ("makan",), ("dimakan",)], "root string")
    assert {r.word: r.stem for r in stemming.stem_words(words, roots).collect()} == {"berita": "berita", "dimakan": "dimakan", "beritakan": "berita"}


def test_spread_counts_tasks_not_files(spark):
    from revlake.operators.topics import spread

    assert spread(spark.range(100).repartition(9)).rdd.getNumPartitions() == 9
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_dictionary_and_stems_meet_each_distinct_token_once(spark):
    texts = ["gara gara zz naikk", "gara gara zz naikk", "gara naikk zz", None]
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    asked = raw.selectExpr("explode(split(t, ' ')) as token").distinct()
    lexicon = table(spark, {"gara": "gara-gara x", "naik": "dinaik"}, ("zz",))
    stems = lambda words: words.selectExpr("word", "replace(word, 'di', '') as stem")
    got = {r.token: (r.entry.w, r.entry.m, r.entry.c) for r in L.token_table(asked, lexicon, table(spark, {}, ("x",)), stems).collect()}
    assert got == {"gara": ("gara", ["gara-gara", "x"], ["gara-gara"]), "zz": ("zz", [], []), "naikk": ("naik", ["dinaik"], ["naik"])}


def test_phrases_are_tried_where_they_can_stand(spark):
    import re

    from revlake.functions import normalise as N

    texts = ["go-jek gojek go  jek", "kasi tau kasih tau", "was-was was was swas was", "mati2an kata2nya rp2 a2.5 b² ab²c", "b@ngsat top up topup", "bintang 5 bintang1", "pada hal jadi nya sebagai nya tiba2", "gaa ada kenapa napa", "2 ²", ""]
    got = [r.p for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", N.rewrite_phrases(N.F.col("t")).alias("p")).orderBy("i").collect()]
    want = []
    for t in texts:
        for pattern, by in N.PHRASES:
            p = pattern.replace(r"[\p{L}\p{N}_]", r"\w")
            t = re.sub(rf"(?<!\w){p}" + ("" if pattern.startswith("(?!rp") else r"(?!\w)"), re.sub(r"\$(\d)", r"\\\1", by), t)
        want.append(t)
    assert got == want
