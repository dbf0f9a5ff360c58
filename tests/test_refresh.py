from datetime import date

import pytest
from pyspark.sql import functions as F

from revlake.operators import analysis, marts, serving
from revlake.operators.dashboard import Dashboard
from revlake.operators.refresh import BASE, Conflict, Store
from revlake.sources import adapters

SF = "/root/testdata/sf0.001"
FROM, TO = date(1996, 3, 15), date(1997, 11, 2)


def rows(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


@pytest.fixture(scope="module")
def frames(spark):
    return {n: getattr(adapters, n)(spark, SF).persist() for n in BASE}


@pytest.fixture(scope="module")
def direct(frames):
    r, s, t, x = (frames[n] for n in BASE)
    pairs = marts.review_category(t, x, r, s)
    return {
        "agg_monthly": marts.agg_monthly(r, s), "agg_weekly": marts.agg_weekly(r, s), "agg_monthly_actual": marts.agg_monthly_actual(r), "agg_version": marts.agg_version(r, s),
        "agg_topic_keyword": marts.agg_topic_keyword(t, x, r), "review_category": pairs, "agg_category": marts.agg_category(pairs), "agg_meta": marts.agg_meta(r),
    }


@pytest.fixture(scope="module")
def store(spark, frames, tmp_path_factory):
    """A third of the reviews, then another, then all of them again, which adds the rest only."""
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    assert store.last() == 0 and store.commit() == {}
    part = lambda n, of: frames[n].filter(of) if n != "topics" else frames[n]
    key = {"reviews": "id", "scores": "review_id", "review_topics": "review_id", "topics": "id"}
    cut = lambda n, what: part(n, F.expr(f"({key[n]} div 32) % 3 {what}"))
    assert store.refresh({n: cut(n, "= 0") for n in BASE}) == 1
    before = Dashboard(spark, store.folder)
    seen = rows(before.monthly)
    assert store.add(cut("reviews", "= 1"), cut("scores", "= 1"), cut("review_topics", "= 1")) == 2
    assert rows(before.table("agg_monthly")) == seen  # an open dashboard stays with its commit
    assert rows(Dashboard(spark, store.folder).monthly) != seen
    assert store.add(frames["reviews"], frames["scores"], frames["review_topics"]) == 3
    return store


def test_additions_equal_a_whole_refresh(store, direct, frames):
    for name, df in direct.items():
        assert rows(store.table(name)) == rows(df), name
    for name in BASE:
        assert rows(store.table(name)) == rows(frames[name]), name


def test_adding_known_reviews_changes_nothing(store, frames):
    before = {n: rows(store.table(n)) for n in ("agg_monthly", "agg_category", "agg_topic_keyword", "agg_meta", "review_category")}
    store.add(frames["reviews"].limit(50), frames["scores"], frames["review_topics"])
    assert {n: rows(store.table(n)) for n in before} == before


def test_a_refresh_that_fails_leaves_the_last_commit(store, frames, direct):
    at = store.last()
    broken = frames["scores"].withColumn("pred_label", F.raise_error(F.lit("no score")).cast("int"))
    with pytest.raises(Exception, match="no score"):
        store.add(frames["reviews"].withColumn("id", F.col("id") + 10_000_000), broken.withColumn("review_id", F.col("review_id") + 10_000_000), frames["review_topics"])
    assert store.last() == at and rows(store.table("agg_meta")) == rows(direct["agg_meta"])


def test_two_refreshes_cannot_take_one_number(store):
    with pytest.raises(Conflict):
        store.put(store.last() - 1, {})
    assert store.commit()


def test_dashboard_equals_the_direct_queries(spark, store, direct):
    d = Dashboard(spark, store.folder)
    m, w, a, v, c, p = (direct[n] for n in ("agg_monthly", "agg_weekly", "agg_monthly_actual", "agg_version", "agg_category", "review_category"))
    for start, end in ((None, None), (FROM, TO), (TO, None)):
        assert rows(d.kpi(start, end)) == rows(analysis.kpi_full(serving.kpi(m, a, start, end), v, direct["agg_meta"]))
        assert rows(d.trend(start, end)) == rows(serving.trend(m, start, end)) and rows(d.trend(start, end, "week")) == rows(serving.trend(w, start, end, "week"))
        assert rows(d.coverage(start, end)) == rows(serving.topic_coverage(p, start, end))
    assert rows(d.topics(5, FROM, TO)) == rows(serving.topics_in(p, 5, FROM, TO)) and rows(d.topics(3)) == rows(serving.top_topics(c, 3))
    assert rows(d.versions()) == rows(serving.versions(v))
    of = p.groupBy("kategori_id").count().orderBy(F.desc("count"), "kategori_id").first().kategori_id
    page = d.reviews(of, "likes", 1, 10)
    assert rows(page.drop("versi_app", "sentimen_aktual")) == rows(serving.topic_reviews(p, of, "likes", 1, 10))
