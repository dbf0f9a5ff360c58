"""Registered queries: name -> (DataFrame builder, SQL for DuckDB or None)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlake.functions import text as T
from revlake.operators import analysis, dictionary, evaluation, explore, marts, models, release, serving, topics
from revlake.sources import adapters as A
from revlake.streaming import windows

FROM, TO = date(1996, 3, 15), date(1997, 11, 2)
STOP = ("the", "of", "and", "to", "in", "de", "la", "der", "die", "und")
PHRASES = ("of the", "in der", "de la", "the", "que", "no such phrase")

_R = """reviews as (select o_orderkey as id, substr(o_orderpriority, 1, 1)::int as rating, o_orderdate as tanggal,
  greatest(0, floor((o_totalprice - 300000) / 1000))::bigint as likes,
  case when o_orderkey % 5 <> 0 then '4.' || floor(sqrt(o_custkey))::bigint || '.' || (o_orderkey % 3) end as versi_app,
  case when o_orderkey % 5 <> 0 then '4.' || floor(sqrt(o_custkey))::bigint end as versi_minor,
  case when substr(o_orderpriority, 1, 1)::int <= 2 then 0 when substr(o_orderpriority, 1, 1)::int >= 4 then 1 end as sentimen_aktual from orders)"""
_S = """scores as (select o_orderkey as review_id, 'final' as model_name, case when o_orderstatus = 'F' then 0 else 1 end as pred_label from orders
  union all select o_orderkey, 'alt', case when o_orderkey % 3 = 0 then 0 else 1 end from orders),
s as (select r.*, c.pred_label from reviews r join scores c on c.review_id = r.id and c.model_name = 'final'),
lim as (select min(tanggal)::date as lo, max(tanggal)::date as hi from reviews)"""
_T = """topics as (select p_type as kategori, p_brand as keyword, row_number() over (order by p_type, p_brand) as id from (select distinct p_type, p_brand from part)),
review_topics as (select distinct l_orderkey as review_id, t.id as topic_id from lineitem join part on p_partkey = l_partkey join topics t on t.kategori = p_type and t.keyword = p_brand where l_quantity > 40)"""


def _r2(x: str, places: int = 2) -> str:
    return f"round(({x})::decimal(38,10), {places})::double"


def _pct(a: str, b: str) -> str:
    return _r2(f"100.0::double * ({a}) / nullif(({b}), 0)")


_NEG = "count(*) filter (where pred_label = 0)"
_AGG = f"count(*) as total_ulasan, {_NEG} as jumlah_negatif, {_pct(_NEG, 'count(*)')} as persen_negatif, {_r2('avg(rating)')} as rata_rating, sum(likes)::bigint as total_likes"
_MONTHLY = f"""monthly as (select m.*, (date_trunc('month', lo)::date = bulan and lo > bulan) or (date_trunc('month', hi)::date = bulan and hi < last_day(bulan)) as periode_parsial
  from (select date_trunc('month', tanggal)::date as bulan, {_AGG} from s group by 1) m, lim)"""
_WEEKLY = f"""weekly as (select m.*, bulan in (date_trunc('week', lo)::date, date_trunc('week', hi)::date) as periode_parsial
  from (select date_trunc('week', tanggal)::date as bulan, {_AGG} from s group by 1) m, lim)"""
_ACTUAL = "actual as (select date_trunc('month', tanggal)::date as bulan, count(sentimen_aktual) as n_berlabel, count(*) filter (where sentimen_aktual = 0) as n_negatif_aktual from reviews group by 1)"
_VERSION = f"""version as (select *, {_pct('jumlah_negatif', 'total_ulasan')} as persen_negatif from (select versi_minor, count(*) as total_ulasan, {_NEG} as jumlah_negatif, {_r2('avg(rating)')} as rata_rating, min(tanggal)::date as pertama_muncul
  from s where versi_minor is not null group by 1) where total_ulasan >= 100)"""
_PAIRS = """pairs as (select distinct min(t2.id) over (partition by t.kategori) as kategori_id, t.kategori, x.review_id, s.tanggal, s.rating, s.likes, s.pred_label
  from review_topics x join topics t on t.id = x.topic_id join topics t2 on t2.kategori = t.kategori join s on s.id = x.review_id)"""
_CAT = f"select kategori_id as id, kategori, count(*) as jumlah_ulasan, {_NEG} as jumlah_negatif, {_pct(_NEG, 'count(*)')} as persen_negatif, sum(likes)::bigint as total_likes, {_r2('avg(rating)')} as rata_rating from pairs"


def _with(*parts: str) -> str:
    *ctes, last = parts
    return "with " + ",\n".join(ctes) + "\n" + last


def _kpi(where: str) -> str:
    return _with(_R, _S, _MONTHLY, _ACTUAL, f"""select sum(total_ulasan)::bigint as total_ulasan, {_pct('sum(jumlah_negatif)', 'sum(total_ulasan)')} as persen_negatif_model, {_pct('sum(n_negatif_aktual)', 'sum(n_berlabel)')} as persen_negatif_aktual,
  {_r2('sum((rata_rating * total_ulasan)::decimal(20,2))::double / nullif(sum(total_ulasan), 0)')} as rata_rating, coalesce(string_agg(strftime(bulan, '%Y-%m'), ',' order by bulan) filter (where periode_parsial), '') as bulan_parsial
  from monthly join actual using (bulan) where {where}""")


_MONTHS = f"bulan between date_trunc('month', date '{FROM}')::date and date_trunc('month', date '{TO}')::date"
_WEEKS = f"bulan between date_trunc('week', date '{FROM}')::date and date_trunc('week', date '{TO}')::date"
_DAYS = f"tanggal >= date '{FROM}' and tanggal < date '{TO}' + interval 1 day"
_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[@#][\\p{L}\\p{N}_]+', ' ', 'g'), '[^\\x00-\\x7F]+', ' ', 'g'), '[0-9]+', ' ', 'g'), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TOK = "tok as (select doc_id, list_filter(string_split(" + _CLEAN + ", ' '), lambda x: x <> '') as w from documents)"
_VER = "v as (select *, lag(n) over o as n0, lag(neg) over o as neg0 from (select versi_minor, count(*) as n, count(*) filter (where pred_label = 0) as neg, min(tanggal) as t0 from s where versi_minor is not null group by 1 having count(*) >= 100) window o as (order by list_transform(string_split(versi_minor, '.'), lambda x: x::int)))"
_Z = "z as (select *, 100 * (neg / n - neg0 / n0) as delta_pp, (neg / n - neg0 / n0) / nullif(sqrt(((neg + neg0) / (n + n0)) * (1 - (neg + neg0) / (n + n0)) * (1 / n + 1 / n0)), 0) as z from (select versi_minor, t0, n::double as n, neg::double as neg, n0::double as n0, neg0::double as neg0 from v))"
_PRED = "p as (select r.id, r.rating, r.sentimen_aktual as label, c.model_name, c.pred_label as pred from reviews r join scores c on c.review_id = r.id where r.sentimen_aktual is not null)"


def _upper(z: str) -> str:
    """Upper tail of the normal by Simpson's rule from 0 to z, cut at 9."""
    h = f"(greatest(-9, least(9, {z})) / 2000)"
    return f"(case when ({z}) is not null then 0.5::double - list_sum(list_transform(range(0, 2001), lambda i: (case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-0.5::double * (i * {h}) * (i * {h})))) * {h} / 3 / sqrt(2 * pi()) end)"


def _bh(name: str, source: str, columns: str) -> str:
    """CTE of the source's columns with p, and q by Benjamini and Hochberg."""
    ranked = f"select *, row_number() over (partition by p is null order by p) as r, count(p) over () as m from {source}"
    upward = "min(p * m / r) over (partition by p is null order by r rows between current row and unbounded following)"
    return f"{name} as (select {columns}, p, case when p is not null then least(1.0::double, {upward}) end as q from ({ranked}))"


_ZP = f"zp as (select versi_minor, delta_pp, z, {_upper('z')} as p from z)"
#: Upper tail of the chi-square distribution: Simpson's rule over its density from the statistic on.
_TAIL = """tail as (select *, list_sum(list_transform(range(0, 20001), lambda i: (case when i in (0, 20000) then 1 when i % 2 = 1 then 4 else 2 end) * exp((a - 1) * ln(x + i * h) - (x + i * h) - lgamma(a)))) * h / 3 as p
  from (select *, (greatest(a - x, 0) + 80 + 12 * sqrt(a)) / 20000 as h from (select *, dof / 2.0::double as a, chi2 / 2.0::double as x from c2)))"""


class Frames:
    """The canonical frames of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    # Each frame is opened when a query first asks for it.
    r = cached_property(lambda self: A.reviews(self.spark, self.sf_dir))
    s = cached_property(lambda self: A.scores(self.spark, self.sf_dir))
    t = cached_property(lambda self: A.topics(self.spark, self.sf_dir))
    x = cached_property(lambda self: A.review_topics(self.spark, self.sf_dir))
    docs = cached_property(lambda self: A.table(self.spark, self.sf_dir, "documents"))
    labels = cached_property(lambda self: A.table(self.spark, self.sf_dir, "labels"))
    events = cached_property(lambda self: A.table(self.spark, self.sf_dir, "events"))
    lines = cached_property(lambda self: A.table(self.spark, self.sf_dir, "lineitem"))
    monthly = cached_property(lambda self: marts.agg_monthly(self.r, self.s))
    actual = cached_property(lambda self: marts.agg_monthly_actual(self.r))
    version = cached_property(lambda self: marts.agg_version(self.r, self.s))
    pairs = cached_property(lambda self: marts.review_category(self.t, self.x, self.r, self.s))

    @property
    def texts(self) -> DataFrame:
        return self.docs.join(self.labels.select("doc_id", F.col("quality").alias("label")), "doc_id", "left")

    @property
    def by_version(self) -> DataFrame:
        rows = marts.scored(self.r, self.s)
        return release.by_version(rows.withColumn("label", F.col("pred_label")))

    @property
    def predictions(self) -> DataFrame:
        return evaluation.labelled_predictions(self.r, self.s)


def _tests(f: Frames) -> DataFrame:
    return release.z_tests(f.by_version)


def _dual(f: Frames) -> DataFrame:
    actual = release.by_version(f.r.withColumn("label", F.col("sentimen_aktual")))
    return f.by_version.select("versi_minor", F.col("n").alias("n_pred"), F.col("neg").alias("neg_pred")).join(actual.select("versi_minor", F.col("n").alias("n_actual"), F.col("neg").alias("neg_actual")), "versi_minor", "left")


def _parts(f: Frames) -> tuple[DataFrame, DataFrame]:
    """Training rows, each text once, and test rows; texts are cleaned after copies have gone, and training rows kept for all passes over them."""
    train, test = models.split(f.texts)
    return models.terms(topics.spread(models.first_of_text(train))).persist(), models.terms(test)


def _fitted(f: Frames, kind: str):
    return models.fit(_parts(f)[0], kind)


def _classified(f: Frames, kind: str) -> DataFrame:
    train, test = _parts(f)
    return models.score(models.fit(train, kind), test)


def _score_all(f: Frames) -> DataFrame:
    """All rows, labelled or not, under all models."""
    return models.score_all(models.fit_all(_parts(f)[0], ("lr", "svc", "nb", "cnb")), models.terms(topics.spread(f.texts)))


def _three(f: Frames) -> DataFrame:
    """Toxic texts are class 0, others of low quality 1, of high quality 2."""
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return f.docs.join(f.labels.select("doc_id", label.alias("label")), "doc_id", "left")


def _keywords(f: Frames) -> DataFrame:
    rows = [(w, k) for k, ws in {"a": ("the", "of the", "tion"), "b": ("der", "in der"), "c": ("de la", "que")}.items() for w in ws]
    return f.docs.sparkSession.createDataFrame(rows, "keyword string, kategori string")


def _page(order: str, sql: str, page: int):
    return (
        lambda f: serving.topic_reviews(f.pairs, 1, order, page, 20),
        _with(_R, _S, _T, _PAIRS, f"select review_id, tanggal, rating, likes, pred_label, (select greatest(1, ceil(count(*) / 20.0))::bigint from pairs where kategori_id = 1) as total_halaman from pairs where kategori_id = 1 order by {sql} limit 20 offset {20 * (page - 1)}"),
    )


QUERIES: dict[str, tuple[Callable[[Frames], DataFrame], str | None]] = {
    "agg_monthly": (lambda f: f.monthly, _with(_R, _S, _MONTHLY, "select * from monthly")),
    "agg_weekly": (lambda f: marts.agg_weekly(f.r, f.s), _with(_R, _S, _WEEKLY, "select * from weekly")),
    "agg_monthly_actual": (lambda f: marts.agg_monthly_actual(f.r), _with(_R, _ACTUAL, "select * from actual")),
    "agg_version": (lambda f: marts.agg_version(f.r, f.s), _with(_R, _S, _VERSION, "select * from version")),
    "agg_topic_keyword": (lambda f: marts.agg_topic_keyword(f.t, f.x, f.r), _with(_R, _T, f"select t.id, t.kategori, t.keyword, count(distinct r.id) as jumlah_ulasan, sum(likes)::bigint as total_likes, {_r2('avg(rating)')} as rata_rating from topics t join review_topics x on x.topic_id = t.id join reviews r on r.id = x.review_id group by all")),
    "review_category": (lambda f: f.pairs, _with(_R, _S, _T, _PAIRS, "select * from pairs")),
    "agg_category": (lambda f: marts.agg_category(f.pairs), _with(_R, _S, _T, _PAIRS, _CAT + " group by all")),
    "agg_meta": (lambda f: marts.agg_meta(f.r), _with(_R, f"select count(*) as total_ulasan, count(versi_minor) as n_versi_minor_terisi, {_pct('count(*) - count(versi_minor)', 'count(*)')} as versi_null_pct, min(tanggal)::date as tanggal_min, max(tanggal)::date as tanggal_max from reviews")),
    "kpi_all": (lambda f: serving.kpi(f.monthly, marts.agg_monthly_actual(f.r)), _kpi("true")),
    "kpi_range": (lambda f: serving.kpi(f.monthly, marts.agg_monthly_actual(f.r), FROM, TO), _kpi(_MONTHS)),
    "trend_month_range": (lambda f: serving.trend(f.monthly, FROM, TO), _with(_R, _S, _MONTHLY, f"select * from monthly where {_MONTHS}")),
    "trend_week_range": (lambda f: serving.trend(marts.agg_weekly(f.r, f.s), FROM, TO, "week"), _with(_R, _S, _WEEKLY, f"select * from weekly where {_WEEKS}")),
    "versions_min200": (lambda f: serving.versions(marts.agg_version(f.r, f.s), 200), _with(_R, _S, _VERSION, "select * from version where total_ulasan >= 200")),
    "topics_top3": (lambda f: serving.top_topics(marts.agg_category(f.pairs), 3), _with(_R, _S, _T, _PAIRS, _CAT + " group by all order by jumlah_ulasan desc, id limit 3")),
    "topics_range": (lambda f: serving.topics_in(f.pairs, 5, FROM, TO), _with(_R, _S, _T, _PAIRS, _CAT + f" where {_DAYS} group by all order by jumlah_ulasan desc, id limit 5")),
    "topic_coverage_range": (lambda f: serving.topic_coverage(f.pairs, FROM, TO), _with(_R, _S, _T, _PAIRS, f"select count(distinct kategori_id) as n_kategori, count(distinct review_id) as ulasan_unik from pairs where {_DAYS}")),
    "drill_by_likes_p2": _page("likes", "likes desc, review_id", 2),
    "drill_by_date_p1": _page("tanggal", "tanggal desc, review_id", 1),
    "drill_by_rating_p1": _page("rating", "rating, likes desc, review_id", 1),
    "eda_profile": (lambda f: explore.profile(f.r), _with(_R, "select count(*) as n_rows, min(tanggal)::date as first_day, max(tanggal)::date as last_day, count(distinct date_trunc('month', tanggal)) as n_months, count(*) - count(versi_app) as missing_version, count(*) - count(sentimen_aktual) as missing_label from reviews")),
    "eda_duplicates": (lambda f: explore.duplicates(f.docs), "select sum(n)::bigint as n_rows, count(*) as n_texts, (sum(n) - count(*))::bigint as n_repeats from (select text, count(*) as n from documents group by text)"),
    "eda_rating": (lambda f: explore.rating_distribution(f.r), _with(_R, f"select rating, n, {_pct('n', 'sum(n) over ()')} as share from (select rating, count(*) as n from reviews group by 1)")),
    "eda_length": (lambda f: explore.length_by_label(f.texts), f"select label, count(*) as n, {_r2('avg(w)')} as mean_words, median(w)::double as median_words, max(w)::bigint as max_words from (select quality as label, len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) as w from documents left join labels using (doc_id)) group by 1"),
    "eda_short": (lambda f: explore.short_texts(f.docs), "select count(*) filter (where w <= 2) as n_short, count(*) filter (where w >= 5) as n_informative, count(*) as n from (select len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) as w from documents)"),
    "eda_class_mix": (lambda f: explore.class_mix(f.r), _with(_R, f"select class, n, {_pct('n', 'sum(n) over ()')} as share_of_three, case when class <> 'neutral' then {_pct('n', 'sum(case when class <> $$neutral$$ then n end) over ()')} end as share_of_two from (select case when rating <= 2 then 'negative' when rating = 3 then 'neutral' else 'positive' end as class, count(*) as n from reviews group by 1)")),
    "eda_version_coverage": (lambda f: explore.version_coverage(f.r), _with(_R, "select threshold, count(*) filter (where n >= threshold) as n_versions, coalesce(sum(n) filter (where n >= threshold), 0)::bigint as n_reviews from (select count(*) as n from reviews where versi_app is not null group by versi_app), (select unnest([30, 100, 200, 500]) as threshold) group by 1")),
    "eda_likes_profile": (lambda f: explore.likes_profile(f.r), _with(_R, f"select count(likes) as n, {_r2('avg(likes)', 4)} as mean, round(stddev_samp(likes), 6) as std, min(likes) as least, quantile_cont(likes, 0.25)::double as q1, quantile_cont(likes, 0.5)::double as q2, quantile_cont(likes, 0.75)::double as q3, max(likes) as most, {_pct('count(*) filter (where likes = 0)', 'count(*)')} as share_zero from reviews")),
    "eda_monthly_volume": (lambda f: explore.monthly_volume(f.r), _with(_R, "select date_trunc('month', tanggal)::date as bulan, count(*) as n, round_even(avg(rating), 2)::double as mean_rating from reviews group by 1")),
    "eda_top_texts": (lambda f: explore.top_texts(f.docs), "select text, count(*) as n from documents where text is not null group by 1 order by n desc, encode(text) limit 20"),
    "contract_report": (lambda f: explore.contract_report(f.r), _with(_R, "select count(*) - count(id) as null_id, count(*) filter (where not coalesce(rating between 1 and 5, false)) as bad_rating, count(*) filter (where coalesce(likes, -1) < 0) as bad_likes, count(*) - count(tanggal) as no_date, (select count(*) from (select id from reviews group by id having count(*) > 1)) as repeated_id from reviews")),
    "release_z": (lambda f: _tests(f).select("versi_minor", "n", "neg", F.round("delta_pp", 6).alias("delta_pp"), F.round("z", 6).alias("z")), _with(_R, _S, _VER, _Z, "select versi_minor, n::bigint as n, neg::bigint as neg, round(delta_pp, 6) as delta_pp, round(z, 6) as z from z")),
    "release_bh": (lambda f: release.bh(f.by_version.select("versi_minor", (F.col("neg") / F.col("n")).alias("p")), "p", "q").select("versi_minor", F.round("q", 6).alias("q")), _with(_R, _S, _VER, "b as (select versi_minor, neg::double / n as p from v), k as (select *, row_number() over (order by p) as r, count(*) over () as m from b)", "select versi_minor, round(least(1.0::double, min(p * m / r) over (order by r rows between current row and unbounded following)), 6) as q from k")),
    "release_flags": (lambda f: release.flags(release.with_q(_tests(f))).select("versi_minor", F.round("z", 4).alias("z"), F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), "flag"), _with(_R, _S, _VER, _Z, _ZP, _bh("zq", "zp", "versi_minor, delta_pp, z"), "select versi_minor, round(z, 4) as z, round(p, 6) as p, round(q, 6) as q, coalesce(delta_pp >= 5 and q < 0.05::double, false) as flag from zq")),
    "release_chi2": (
        lambda f: release.chi_square(f.by_version).select(F.round("chi2", 4).alias("chi2"), "dof", F.round("p", 6).alias("p")),
        _with(
            _R,
            _S,
            _VER,
            "c2 as (select sum((neg - e) * (neg - e) / e + (neg - e) * (neg - e) / (n - e)) as chi2, count(*) - 1 as dof from (select n::double as n, neg::double as neg, n * (sum(neg) over ())::double / (sum(n) over ())::double as e from v))",
            _TAIL,
            "select round(chi2, 4) as chi2, dof, round(p, 6) as p from tail",
        ),
    ),
    "release_windows": (lambda f: release.windows(marts.scored(f.r, f.s).withColumn("label", F.col("pred_label")), f.by_version), _with(_R, _S, _VER, "select v.versi_minor, count(*) filter (where s.tanggal >= t0 - interval 28 day and s.tanggal < t0) as n_before, count(*) filter (where s.tanggal >= t0 - interval 28 day and s.tanggal < t0 and pred_label = 0) as neg_before, count(*) filter (where s.tanggal >= t0 and s.tanggal < t0 + interval 28 day) as n_after, count(*) filter (where s.tanggal >= t0 and s.tanggal < t0 + interval 28 day and pred_label = 0) as neg_after from v join s on s.tanggal >= t0 - interval 28 day and s.tanggal < t0 + interval 28 day group by 1")),
    "release_composition": (lambda f: release.composition(f.pairs, f.r, _tests(f).filter("delta_pp > 0")), _with(_R, _S, _T, _PAIRS, _VER, _Z, "select kategori, nf as n_flagged, na as n_all, round(100.0::double * nf / nullif(sum(nf) over (), 0), 6) as pct_flagged, round(100.0::double * na / sum(na) over (), 6) as pct_all from (select kategori, count(z.versi_minor) as nf, count(*) as na from pairs p join reviews r on r.id = p.review_id left join z on z.versi_minor = r.versi_minor and z.delta_pp > 0 where p.pred_label = 0 group by 1)")),
    "clean_ascii": (lambda f: topics.spread(f.docs).select("doc_id", T.clean_ascii(F.col("text")).alias("clean")), f"select doc_id, {_CLEAN} as clean from documents"),
    "clean_full": (lambda f: f.docs.select("doc_id", T.clean_full(F.col("text")).alias("clean")), None),
    "stopword_filter": (lambda f: f.docs.select("doc_id", F.array_join(T.without(T.tokens(T.clean_ascii(F.col("text"))), STOP), " ").alias("kept")), _with(_TOK, f"select doc_id, coalesce(array_to_string(list_filter(w, lambda x: x not in {STOP}), ' '), '') as kept from tok")),
    "language_flag": (lambda f: T.language_counts(f.docs).select("doc_id", "n_words", "n_en", "n_id", "is_english"), f"select *, n_words >= 3 and n_en >= 2 and n_en > 2 * n_id as is_english from (select doc_id, len(w)::bigint as n_words, len(list_filter(w, lambda x: list_contains(string_split('the to and i a it is my of for you this not but that with be was are have they me your can so very in on at just when or if from no all what there more because too even after would will dont don''t cant can''t it''s i''m im their them our we us has had been than only also really still always never every', ' '), x)))::bigint as n_en, len(list_filter(w, lambda x: list_contains(string_split('dan yang di ke dari tidak ga gak nggak ngga gk tdk ini itu saya aku nya ada bisa sudah udah sangat banget tapi untuk dengan kalau kalo mau lagi juga sih aja saja jadi karena krn yg dgn sama buat kok deh dong apa kenapa mohon tolong belum blm masih harus', ' '), x)))::bigint as n_id from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') as w from documents))"),
    "token_counts": (lambda f: topics.ngram_top(f.docs, 1, 500), _with(_TOK, "select term, count(*) as freq, count(distinct doc_id) as n_dokumen from (select doc_id, unnest(w) as term from tok) group by 1 order by freq desc, term limit 500")),
    "ngram_top": (lambda f: topics.ngram_top(f.docs, 2), _with(_TOK, "select term, count(*) as freq, count(distinct doc_id) as n_dokumen from (select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from tok) group by 1 order by freq desc, term limit 30")),
    "keyword_match": (lambda f: topics.keyword_match(f.docs, _keywords(f)), _with(_TOK, "g as (select distinct doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as keyword from tok)", "select doc_id, kategori, keyword from g join (values ('the', 'a'), ('of the', 'a'), ('tion', 'a'), ('der', 'b'), ('in der', 'b'), ('de la', 'c'), ('que', 'c')) k(keyword, kategori) using (keyword)")),
    "tfidf_weights": (lambda f: topics.tfidf_weights(f.docs), _with(_TOK, "c as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from tok) group by 1, 2), d as (select term, count(*) as df from c group by 1 having count(*) >= 3), x as (select doc_id, term, (1 + ln(tf)) * (ln((1 + (select count(*) from documents))::double / (1 + df)::double) + 1) as w from c join d using (term))", "select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from x")),
    "trigger_rows": (lambda f: topics.trigger_rows(f.t, f.x), _with(_T, "sc as (select topic_id, count(*) as score from review_topics group by 1), k as (select x.review_id, t.kategori, t.keyword, score, row_number() over (partition by x.review_id, t.kategori order by score desc, t.keyword) as rn from review_topics x join topics t on t.id = x.topic_id join sc using (topic_id))", "select review_id, kategori, keyword, score from k where rn = 1")),
    "category_rank": (lambda f: topics.category_rank(f.pairs), _with(_R, _S, _T, _PAIRS, f"c as (select kategori, count(*) as jumlah_ulasan, sum(likes)::bigint as total_likes, {_r2('avg(likes)')} as rata_likes from pairs group by 1), k as (select *, floor(rank() over (order by jumlah_ulasan desc) + (count(*) over (partition by jumlah_ulasan) - 1) / 2.0)::bigint as rank_freq, floor(rank() over (order by total_likes desc) + (count(*) over (partition by total_likes) - 1) / 2.0)::bigint as rank_likes from c)", "select *, rank_freq - rank_likes as gap from k")),
    "category_trend": (lambda f: topics.category_trend(f.pairs), _with(_R, _S, _T, _PAIRS, "select date_trunc('month', tanggal)::date as bulan, kategori, count(*) as jumlah from pairs group by 1, 2")),
    "story_examples": (lambda f: topics.story_examples(f.pairs), _with(_R, _S, _T, _PAIRS, "m as (select *, count(*) over (partition by review_id) = 1 as alone from pairs), e as (select *, count(*) filter (where alone) over (partition by kategori) >= 3 as enough from m), k as (select kategori, review_id, likes, row_number() over (partition by kategori order by likes desc, review_id) as rank from e where alone or not enough)", "select kategori, rank, review_id, likes from k where rank <= 3")),
    "confusion": (lambda f: evaluation.confusion(f.predictions), _with(_R, _S, _PRED, "select model_name, label, pred, count(*) as n from p group by all")),
    "metrics_ordered": (lambda f: evaluation.metrics(f.predictions).orderBy(F.desc("macro_f1"), "model_name"), _with(_R, _S, _PRED, "k as (select model_name, (count(*) filter (where label = 1 and pred = 1))::double as tp, (count(*) filter (where label = 0 and pred = 0))::double as tn, (count(*) filter (where label = 0 and pred = 1))::double as fp, (count(*) filter (where label = 1 and pred = 0))::double as fn from p group by 1)", "select model_name, (tp + tn + fp + fn)::bigint as n_eval, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, coalesce(round(tn / nullif(tn + fn, 0), 6), 0) as precision_neg, coalesce(round(tn / nullif(tn + fp, 0), 6), 0) as recall_neg, round(2 * tn / (2 * tn + fp + fn), 6) as f1_neg, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) as macro_f1 from k")),
    "majority_baseline": (lambda f: evaluation.majority_baseline(f.r), _with(_R, "select max_by(l, n) as label, round(max(n) / sum(n)::double, 6) as accuracy from (select sentimen_aktual as l, count(*) as n from reviews where sentimen_aktual is not null group by 1)")),
    "error_profile": (lambda f: evaluation.error_profile(f.predictions), _with(_R, _S, _PRED, "select model_name, rating, case when pred = 0 then 'false_negative_sentiment' else 'false_positive_sentiment' end as direction, count(*) as n from p where label <> pred group by all")),
    "model_overlap": (lambda f: evaluation.model_overlap(f.predictions), _with(_R, _S, _PRED, "w as (select id, model_name as a from p where label <> pred), o as (select a, count(*) as n from w group by 1), j as (select x.a, y.a as b, count(*) as n_both from w x join w y using (id) group by 1, 2)", "select j.a, j.b, n_both, round(n_both::double / (oa.n + ob.n - n_both), 6) as jaccard from j join o oa on oa.a = j.a join o ob on ob.a = j.b")),
    "agreement_kappa": (lambda f: evaluation.kappa(f.s), _with(_R, _S, "q as (select o_orderkey as id, case when o_orderstatus = 'F' then 0 else 1 end as x, case when o_orderkey % 3 = 0 then 0 else 1 end as y from orders), t as (select count(*)::double as n, (count(*) filter (where x = y))::double as same, sum(x)::double as sx, sum(y)::double as sy from q), e as (select n, same / n as po, (sx * sy + (n - sx) * (n - sy)) / (n * n) as pe from t)", "select n::bigint as n, round(po, 6) as agreement, round((po - pe) / (1 - pe), 6) as kappa from e")),
    "event_windows": (lambda f: windows.tumbling(f.events).select(F.to_date("start").alias("day"), "event_type", "n", "total"), "select ts::date as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"),
    "word_counts": (lambda f: dictionary.word_counts(f.docs), _with(_TOK, "select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+'))::bigint as raw_words, len(w)::bigint as clean_words from documents join tok using (doc_id)")),
    "phrase_doc_counts": (lambda f: dictionary.phrase_counts(f.docs, PHRASES), "select phrase, (select count(*) from documents where contains(' ' || " + _CLEAN + " || ' ', ' ' || phrase || ' ')) as n_dokumen from (select unnest([" + ", ".join(f"'{p}'" for p in PHRASES) + "]) as phrase)"),
    "nb_counts": (lambda f: dictionary.nb_counts(f.texts), _with(_TOK, "c as (select term, count(*) filter (where quality = 1) as pos, count(*) filter (where quality = 0) as neg from (select doc_id, unnest(w) as term from tok) join labels using (doc_id) group by 1 having count(*) filter (where quality is not null) >= 3)", "select term, pos, neg, round(ln((pos + 1)::double / (sum(pos) over () + count(*) over ())::double) - ln((neg + 1)::double / (sum(neg) over () + count(*) over ())::double), 6) as log_ratio from c")),
    "candidate_tokens": (lambda f: dictionary.candidates(f.docs, f.docs.sparkSession.createDataFrame([(w,) for w in STOP], "word string")), _with(_TOK, f"select term as word, count(*) as freq, min(doc_id) as first_doc from (select doc_id, unnest(w) as term from tok) where length(term) >= 2 and term not in {STOP} group by 1 having count(*) >= 20 order by freq desc, word limit 500")),
    "keyword_collisions": (lambda f: dictionary.collisions(f.t), _with(_T, "select keyword, count(*) as n_kategori, min(kategori) as pemilik from topics group by 1 having count(*) > 1")),
    "dictionary_layers": (lambda f: dictionary.layered([f.t.select(F.col("keyword").alias("word"), F.concat(F.lit("a:"), F.min("kategori").over(Window.partitionBy("keyword"))).alias("expansion")).distinct(), f.docs.sparkSession.createDataFrame([("Brand#11", "b:x"), ("new", "b:y")], "word string, expansion string")], f.docs.sparkSession.createDataFrame([("Brand#12",)], "word string")), _with(_T, "l as (select keyword as word, 'a:' || min(kategori) as expansion, 0::bigint as priority from topics group by 1 union all select 'Brand#11', 'b:x', 1 union all select 'new', 'b:y', 1)", "select word, max_by(expansion, priority) as expansion, max(priority) as priority from l where word <> 'Brand#12' group by 1")),
    "release_dual_label": (lambda f: _dual(f), _with(_R, _S, "a as (select versi_minor, count(*) as n_pred, count(*) filter (where pred_label = 0) as neg_pred from s where versi_minor is not null group by 1 having count(*) >= 100), b as (select versi_minor, count(*) as n_actual, count(*) filter (where sentimen_aktual = 0) as neg_actual from reviews where versi_minor is not null and sentimen_aktual is not null group by 1 having count(*) >= 100)", "select versi_minor, n_pred, neg_pred, n_actual, neg_actual from a left join b using (versi_minor)")),
    "lr_scores": (lambda f: _classified(f, "lr"), None),
    "svc_scores": (lambda f: _classified(f, "svc"), None),
    "cnb_scores": (lambda f: _classified(f, "cnb"), None),
    "lda_topics": (lambda f: models.lda_topics(f.docs), None),
    "lda_sweep": (lambda f: models.lda_sweep(f.docs), None),
    "score_all": (lambda f: _score_all(f), None),
    "model_features": (lambda f: analysis.top_features(models.log_ratios(_fitted(f, "cnb"), f.spark)), None),
    "cv_grid": (lambda f: models.cv_grid(_parts(f)[0]), None),
    "dedup_impact": (lambda f: models.dedup_impact(models.terms(f.texts)).drop("fit_seconds"), None),
    "svc_calibrated": (lambda f: models.calibrated(*_parts(f)), None),
    "three_class": (lambda f: models.three_class(models.terms(_three(f))), None),
    "stratified_split": (lambda f: models.dealt(f.texts, [0.8]).select("doc_id", "label", "part"), "with t as (select doc_id, quality as label, row_number() over (partition by quality order by md5(doc_id::varchar || ':42'), doc_id) as pos, count(*) over (partition by quality) as n from documents join labels using (doc_id) where quality is not null) select doc_id, label, (pos > round(0.8::double * n))::int as part from t"),
    "stratified_folds": (lambda f: models.dealt(f.texts, [0.2, 0.4, 0.6, 0.8]).select("doc_id", "label", "part"), "with t as (select doc_id, quality as label, row_number() over (partition by quality order by md5(doc_id::varchar || ':42'), doc_id) as pos, count(*) over (partition by quality) as n from documents join labels using (doc_id) where quality is not null) select doc_id, label, (pos > round(0.2::double * n))::int + (pos > round(0.4::double * n))::int + (pos > round(0.6::double * n))::int + (pos > round(0.8::double * n))::int as part from t"),
    "scoring_sanity": (lambda f: models.scoring_sanity(f.s.select(F.col("review_id").alias("id"), "model_name", F.col("pred_label").alias("pred")), f.r.select("id", F.col("sentimen_aktual").alias("label"))), _with(_R, _S, "select model_name, count(*) as n, round(100.0::double * avg((c.pred_label = 0)::int), 6) as neg_pct, round(100.0::double * avg((c.pred_label = r.sentimen_aktual)::int), 6) as agreement_pct from scores c left join reviews r on r.id = c.review_id group by 1")),
}


def _all() -> dict[str, tuple[Callable[[Frames], DataFrame], str | None]]:
    from revlake.plans import factqueries, more, storequeries, topicqueries, words

    return QUERIES | more.QUERIES | words.QUERIES | topicqueries.QUERIES | storequeries.QUERIES | factqueries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, build=build: build(Frames(spark, sf_dir))) for name, (build, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
