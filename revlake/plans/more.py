"""Registered queries of the text pipeline, analysis and table operators; see ``registry`` for the frames and common SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.functions import normalise as N
from revlake.functions import text as T
from revlake.operators import analysis as X
from revlake.operators import dictionary, evaluation, marts, models, release, serving, topics, warehouse
from revlake.plans.registry import QUERIES as _FIRST
from revlake.plans.registry import _ACTUAL, _MONTHLY, _PAIRS, _PRED, _R, _S, _T, _TOK, _VER, _VERSION, _Z, _ZP, FROM, TO, Frames, _bh, _kpi, _pct, _r2, _upper, _with
from revlake.sources import files

# The words of a text on white space, and predictions over texts: quality is the label, three rules are the models.
_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+'))"
_TEXTS = f"texts as (select d.doc_id, d.text, d.lang, d.source, l.quality as label, {_WORDS} as words from documents d left join labels l using (doc_id))"
_RULES = "rules as (select doc_id, words, label, unnest(['long', 'latin', 'majority_baseline']) as model_name, unnest([(words >= 60)::int, (lang = 'en')::int, 1]) as pred from texts where label is not null)"
_TERMS1 = "terms as (select lang as topic, term, sum(tf)::bigint as tf, count(*) as df from (select doc_id, lang, term, count(*) as tf from (select tok.doc_id, lang, unnest(w) as term from tok join documents using (doc_id)) group by all) group by all)"
_TERMS2 = "terms as (select lang as topic, term, sum(tf)::bigint as tf, count(*) as df from (select doc_id, lang, term, count(*) as tf from (select tok.doc_id, lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from tok join documents using (doc_id)) group by all) group by all)"
_LIFT = """lift as (select topic, term, tf, df, round(p, 9) as phi, round(p / base, 6) as lift, round(100.0::double * df_all / (select count(*) from documents), 6) as df_pct, round(tf::double / tf_all, 6) as concentration, round(0.6::double * ln(p) + (1 - 0.6::double) * ln(p / base), 6) as relevance
  from (select t.*, tf::double / n_topic as p, tf_all::double / n_all as base from (select *, sum(df) over (partition by term) as df_all, (sum(tf) over (partition by term))::double as tf_all from terms) t
  join (select topic, sum(tf)::double as n_topic, (sum(sum(tf)) over ())::double as n_all from terms group by 1) using (topic)) where df_all >= 10)"""
_CHOSEN = "chosen as (select topic, row_number() over (partition by topic order by relevance desc, encode(term)) as rank, term, lift, relevance from lift where df_pct <= 15 and lift >= 2 qualify rank <= 10)"
_OWNERS = "owners as (select term, max(struct_pack(lift := lift, topic := topic)) as x, count(*) as n_topics from chosen group by 1)"
_NB = "nb as (select term, round(ln((pos + 1)::double / (sum(pos) over () + count(*) over ())::double) - ln((neg + 1)::double / (sum(neg) over () + count(*) over ())::double), 6) as log_ratio from (select term, count(*) filter (where quality = 1) as pos, count(*) filter (where quality = 0) as neg from (select doc_id, unnest(w) as term from tok) join labels using (doc_id) group by 1 having count(*) filter (where quality is not null) >= 3))"
_SETS = """sa as (select l_orderkey as id, list_sort(list(distinct (l_shipdate::varchar)[:4] || l_returnflag)) as set_a from lineitem where l_quantity > 25 group by 1),
sb as (select l_orderkey as id, list_sort(list(distinct (l_shipdate::varchar)[:4] || l_returnflag)) as set_b from lineitem where l_linenumber <= 3 group by 1),
sets as (select id, set_a, set_b, set_a[1] as main_a, set_b[1] as main_b from sa join sb using (id))"""
_FACTS, _PROSE = [0.9261, 0.8951, 526322.0, 77.25], [(1, "526.322 ulasan, 92,61 persen"), (2, "0,9261 atau 0,93; salah 0,91"), (3, "77,25 persen dari 1.234"), (4, "v 89,5 dan 89.5")]
_B = "bounds as (select min(tanggal) as lo, max(tanggal) as hi from reviews)"


def _frame(f: Frames, rows, schema: str) -> DataFrame:
    return f.spark.createDataFrame(rows, schema)


def _texts(f: Frames) -> DataFrame:
    return f.texts.withColumn("words", F.size(T.tokens(F.coalesce("text", F.lit("")))))


def _rules(f: Frames) -> DataFrame:
    made = F.array(*(F.struct(F.lit(n).alias("model_name"), p.cast("int").alias("pred")) for n, p in (("long", F.col("words") >= 60), ("latin", F.col("lang") == "en"), ("majority_baseline", F.lit(1)))))
    return _texts(f).filter("label is not null").select("doc_id", "words", "label", F.inline(made))


def _lifted(f: Frames) -> DataFrame:
    return X.keyword_lift(X.topic_terms(f.docs, "lang"), f.docs.agg(F.count(F.lit(1)).alias("n_docs")))


def _chosen(f: Frames) -> DataFrame:
    return X.keywords(_lifted(f))


def _grid(f: Frames) -> DataFrame:
    """The grid of the query ``cv_grid``."""
    return _FIRST["cv_grid"][0](f)


_RULE_WORDS = (5, 20, 40, 60, 80, 120, 200, 400)


def _rule_cv(f: Frames) -> DataFrame:
    """Rules by the number of words under the folds of the models: one row per rule and threshold."""
    rows = models.dealt(_texts(f), [0.2, 0.4, 0.6, 0.8]).select("label", "part", "words", F.explode(F.array(*map(F.lit, _RULE_WORDS))).alias("t"))
    made = F.array(*(F.struct(F.lit(n).alias("model_name"), p.cast("int").alias("pred")) for n, p in (("long", F.col("words") >= F.col("t")), ("short", F.col("words") < F.col("t")))))
    scores = models.macro_f1(rows.select("label", "part", "t", F.inline(made)), "model_name", "t", "part")
    return scores.groupBy("model_name", F.col("t").cast("double").alias("complexity")).agg(F.round(F.avg("macro_f1"), 6).alias("mean_score"), F.round(F.stddev_pop("macro_f1"), 6).alias("std_score"))


def _sets(f: Frames) -> DataFrame:
    name = F.concat(F.substring(F.col("l_shipdate").cast("string"), 1, 4), "l_returnflag")
    side = lambda keep, s: f.lines.filter(keep).groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set(name)).alias(f"set_{s}"))
    both = side("l_quantity > 25", "a").join(side("l_linenumber <= 3", "b"), "id")
    return both.withColumns({"main_a": F.col("set_a")[0], "main_b": F.col("set_b")[0]})


def _bounds(f: Frames) -> DataFrame:
    return f.r.agg(F.min("tanggal").alias("lo"), F.max("tanggal").alias("hi"))


def _windows(f: Frames) -> DataFrame:
    return release.windows(marts.scored(f.r, f.s).withColumn("label", F.col("pred_label")), f.by_version)


_NWIN = "w as (select v.versi_minor, (count(*) filter (where s.tanggal >= t0 - interval 28 day and s.tanggal < t0))::double as nb, (count(*) filter (where s.tanggal >= t0 - interval 28 day and s.tanggal < t0 and pred_label = 0))::double as gb, (count(*) filter (where s.tanggal >= t0 and s.tanggal < t0 + interval 28 day))::double as na, (count(*) filter (where s.tanggal >= t0 and s.tanggal < t0 + interval 28 day and pred_label = 0))::double as ga from v join s on s.tanggal >= t0 - interval 28 day and s.tanggal < t0 + interval 28 day group by 1)"
_KPI = _kpi("true")

QUERIES = {
    # text
    "language_words": (lambda f: T.language_counts(f.docs).groupBy("lang").agg(F.sum("n_words").alias("n_words"), F.sum("n_en").alias("n_en"), F.sum("n_id").alias("n_id"), F.count_if("is_english").alias("n_english")), "with w as (select lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') as w from documents), c as (select lang, len(w) as n, len(list_filter(w, lambda x: list_contains(string_split('the to and i a it is my of for you this not but that with be was are have they me your can so very in on at just when or if from no all what there more because too even after would will dont don''t cant can''t it''s i''m im their them our we us has had been than only also really still always never every', ' '), x))) as e, len(list_filter(w, lambda x: list_contains(string_split('dan yang di ke dari tidak ga gak nggak ngga gk tdk ini itu saya aku nya ada bisa sudah udah sangat banget tapi untuk dengan kalau kalo mau lagi juga sih aja saja jadi karena krn yg dgn sama buat kok deh dong apa kenapa mohon tolong belum blm masih harus', ' '), x))) as d from w) select lang, sum(n)::bigint as n_words, sum(e)::bigint as n_en, sum(d)::bigint as n_id, count(*) filter (where n >= 3 and e >= 2 and e > 2 * d) as n_english from c group by 1"),
    "phrase_rewrite": (lambda f: f.docs.select("doc_id", N.rewrite_phrases(F.lower(F.coalesce("text", F.lit("")))).alias("text")), None),
    "clean_adaptive": (lambda f: f.docs.select("doc_id", N.clean_adaptive(F.col("text")).alias("clean")), None),
    "sentences": (lambda f: f.docs.select("doc_id", F.posexplode(N.sentences(F.col("text"))).alias("pos", "sentence")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("chars")), "with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') as s from documents) select doc_id, len(s)::bigint as n, list_sum(list_transform(s, lambda x: length(x)))::bigint as chars from p where len(s) > 0"),
    "review_sample": (lambda f: N.review_sample(f.docs, f.labels, 25).select("doc_id", "text"), "select d.doc_id, text from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) order by md5('42:' || d.doc_id), d.doc_id limit 25"),
    # description
    "eda_missing": (lambda f: X.missing_by_column(f.r), _with(_R, "c as (select count(*) as n, " + ", ".join(f"count(*) - count({c}) as {c}" for c in ("id", "rating", "tanggal", "likes", "versi_app", "sentimen_aktual", "versi_minor")) + " from reviews)", f"select name as \"column\", k as n_missing, {_pct('k', 'n')} as share from (unpivot c on id, rating, tanggal, likes, versi_app, sentimen_aktual, versi_minor into name name value k)")),
    "eda_duplicate_scopes": (lambda f: X.duplicate_scopes(f.texts.select("text", "lang", "source", "label")), _with(_TEXTS, "select 'row' as scope, (count(*) - (select count(*) from (select distinct text, lang, source, label from texts)))::bigint as n_repeats from texts union all select 'text', count(*) - (select count(*) from (select distinct text from texts)) from texts union all select 'text_in_label', count(*) - (select count(*) from (select distinct text, label from texts)) from texts")),
    "eda_rating_pivot": (lambda f: X.rating_pivot(f.r), _with(_R, "select date_trunc('month', tanggal)::date as bulan, " + ", ".join(f"count(*) filter (where rating = {k}) as rating_{k}" for k in range(1, 6)) + " from reviews group by 1")),
    "eda_extreme_months": (lambda f: X.extreme_months(f.monthly), _with(_R, _S, _MONTHLY, "select (select bulan from monthly order by persen_negatif desc, bulan limit 1) as worst, max(persen_negatif) as worst_pct, (select bulan from monthly order by persen_negatif, bulan limit 1) as best, min(persen_negatif) as best_pct from monthly")),
    "eda_series_agreement": (lambda f: X.series_agreement(f.monthly, f.actual), _with(_R, _S, _MONTHLY, _ACTUAL, f"j as (select persen_negatif as a, {_pct('n_negatif_aktual', 'n_berlabel')} as b from monthly join actual using (bulan))", "select count(*) as n_months, round(corr(a, b), 6) as pearson, round(avg(abs(a - b)), 6) as mean_abs_diff from j")),
    "eda_vocabulary": (lambda f: X.vocabulary(f.docs), _with(_TOK, "select w[1] as letter, count(*) as n_tokens from (select distinct unnest(w) as w from tok) group by 1")),
    "eda_categories_per_review": (lambda f: X.categories_per_review(f.pairs, f.r), _with(_R, _S, _T, _PAIRS, "c as (select n_kategori, count(*) as n from (select r.id, count(p.review_id) as n_kategori from reviews r left join pairs p on p.review_id = r.id group by 1) group by 1)", f"select n_kategori, n, {_pct('n', 'sum(n) over ()')} as share from c union all select 0, 0, 0.0 where not exists (select 1 from c where n_kategori = 0)")),
    "eda_length_band": (lambda f: X.length_band(f.docs), "select lang, count(*) as n, sum(length(text))::bigint as n_chars from documents where length(text) between 40 and 300 group by 1"),
    "eda_typical": (lambda f: X.typical(f.docs), f"select source, count(*) as n, sum(w)::bigint as words from (select source, {_WORDS} as w from documents) where w between 10 and 60 group by 1"),
    "ngram_table": (lambda f: X.ngram_table(f.docs, 2), _with(_TOK, "t as (select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from tok)", f"select 2 as n_gram, term, tf, df, {_pct('df', '(select count(*) from documents)')} as df_pct from (select term, count(*) as tf, count(distinct doc_id) as df from t group by 1 having count(distinct doc_id) >= 10 order by tf desc, encode(term) limit 30)")),
    "corpus_stats": (lambda f: X.corpus_stats(f.texts), _with(_TOK, f"select count(*) as n_docs, sum(len(w))::bigint as n_tokens, {_r2('avg(len(w))')} as mean_words, count(distinct text) as n_texts from tok join documents using (doc_id) join labels using (doc_id) where quality = 0 and len(w) >= 5")),
    # evaluation
    "macro_f1_dual_set": (lambda f: X.dual_metrics(_rules(f)), _with(_TEXTS, _RULES, "e as (select *, 'full' as eval_set from rules union all select *, 'informative_ge5w' from rules where words >= 5)", "k as (select eval_set, model_name, count(*) as n, (count(*) filter (where label = 1 and pred = 1))::double as tp, (count(*) filter (where label = 0 and pred = 0))::double as tn, (count(*) filter (where label = 0 and pred = 1))::double as fp, (count(*) filter (where label = 1 and pred = 0))::double as fn from e group by all)", "select eval_set, model_name, n as n_eval, round((tp + tn) / n, 6) as accuracy, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) as macro_f1 from k order by eval_set, model_name = 'majority_baseline' desc, macro_f1 desc, model_name")),
    "metrics_nested": (lambda f: X.nested_metrics(X.dual_metrics(_rules(f))), _with(_TEXTS, _RULES, "e as (select *, 'full' as eval_set from rules union all select *, 'informative_ge5w' from rules where words >= 5)", "k as (select eval_set, model_name, (count(*) filter (where label = 1 and pred = 1))::double as tp, (count(*) filter (where label = 0 and pred = 0))::double as tn, (count(*) filter (where label <> pred))::double as w from e group by all)", "m as (select eval_set, model_name, round((coalesce(2 * tp / nullif(2 * tp + w, 0), 0) + coalesce(2 * tn / nullif(2 * tn + w, 0), 0)) / 2, 6) as f from k)", "select eval_set, string_agg(model_name, ',' order by model_name <> 'majority_baseline', f desc, model_name) as models, count(*) as n from m group by 1")),
    "error_rates": (lambda f: X.error_rates(_rules(f)), _with(_TEXTS, _RULES, f"select model_name, case when words <= 2 then '0-2' when words <= 4 then '3-4' when words < 20 then '5-19' else '20+' end as bucket, count(*) as n, count(*) filter (where label = 1 and pred = 0) as false_negative, count(*) filter (where label = 0 and pred = 1) as false_positive, {_pct('count(*) filter (where label <> pred)', 'count(*)')} as error_pct from rules group by 1, 2")),
    "wilson_by_category": (lambda f: X.wilson(f.pairs.groupBy("kategori").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred_label") == 0).alias("neg")), "neg", "n"), _with(_R, _S, _T, _PAIRS, "c as (select kategori, count(*) as n, count(*) filter (where pred_label = 0) as neg from pairs group by 1), k as (select *, neg::double / n as p, n::double as m, 1.959963984540054::double as z from c)", "select kategori, n, neg, round(100 * (p + z * z / (2 * m) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m), 6) as low, round(100 * (p + z * z / (2 * m) + z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m), 6) as high from k")),
    "noise_ceiling": (lambda f: X.noise_ceiling(_rules(f), F.col("doc_id") % 3 == 0, F.col("words") < 30), _with(_TEXTS, _RULES, "k as (select model_name, count(*) as n, count(*) filter (where label <> pred) as n_errors, count(*) filter (where label <> pred and doc_id % 3 = 0) as n_sampled, count(*) filter (where label <> pred and doc_id % 3 = 0 and words < 30) as n_noisy from rules group by 1)", "select *, round(100 * (n_noisy::double / nullif(n_sampled, 0)), 6) as noise_pct, round(100 * (1 - n_errors * (1 - n_noisy::double / nullif(n_sampled, 0)) / n), 6) as ceiling_pct from k")),
    "agreement_jaccard": (lambda f: X.set_agreement(_sets(f)), _with(_SETS, "r as (select list_contains(set_b, main_a)::int as l, (main_a = main_b)::int as s, len(list_intersect(set_a, set_b))::double / len(list_distinct(list_concat(set_a, set_b))) as j from sets)", "pe as (select coalesce(sum(a.n::double * b.n), 0) as x from (select main_a as m, count(*) as n from sets group by 1) a join (select main_b as m, count(*) as n from sets group by 1) b using (m))", "t as (select count(*) as n, avg(l) as lo, avg(s) as st, avg(j) as j from r)", "select n, round(lo, 6) as loose, round(st, 6) as strict, round(j, 6) as jaccard, round((st - x / (n::double * n)) / nullif(1 - x / (n::double * n), 0), 6) as kappa from t, pe")),
    "one_se_rules": (
        lambda f: X.one_se_choice(_rule_cv(f)),
        _with(
            _TEXTS,
            "f as (select doc_id, words, label, row_number() over (partition by label order by md5(doc_id::varchar || ':42'), doc_id) as pos, count(*) over (partition by label) as n from texts where label is not null)",
            f"g as (select words, label, (pos > round(0.2::double * n))::int + (pos > round(0.4::double * n))::int + (pos > round(0.6::double * n))::int + (pos > round(0.8::double * n))::int as part, unnest({list(_RULE_WORDS)}) as t from f)",
            "r as (select *, unnest(['long', 'short']) as model_name, unnest([(words >= t)::int, (words < t)::int]) as pred from g)",
            "k as (select model_name, t, part, (count(*) filter (where label = 1 and pred = 1))::double as tp, (count(*) filter (where label = 0 and pred = 0))::double as tn, (count(*) filter (where label <> pred))::double as w from r group by all)",
            "s as (select model_name, t, part, round(case when 2 * tp + w = 0 then 2 * tn / (2 * tn + w) when 2 * tn + w = 0 then 2 * tp / (2 * tp + w) else (2 * tp / (2 * tp + w) + 2 * tn / (2 * tn + w)) / 2 end, 6) as f from k)",
            "cv as (select model_name, t::double as complexity, round(avg(f), 6) as mean_score, round(stddev_pop(f), 6) as std_score from s group by 1, 2)",
            "b as (select distinct on (model_name) model_name, mean_score as top, mean_score - std_score as bar from cv order by model_name, mean_score desc, complexity)",
            "c as (select cv.*, top, bar, count(*) over (partition by cv.model_name) as n_within, row_number() over (partition by cv.model_name order by complexity, mean_score desc) as r from cv join b using (model_name) where mean_score >= bar)",
            "select model_name, complexity, mean_score, round(bar, 6) as bar, n_within, mean_score = top as same_as_best from c where r = 1",
        ),
    ),
    "one_se_choice": (lambda f: X.one_se_choice(_grid(f)), None),
    "top_features": (lambda f: X.top_features(dictionary.nb_counts(f.texts)), _with(_TOK, _NB, "select * exclude (s) from (select class, row_number() over (partition by class order by s desc, encode(term)) as rank, term, log_ratio, s from (select 'positive' as class, term, log_ratio, log_ratio as s from nb union all select 'negative', term, log_ratio, -log_ratio from nb)) where rank <= 20")),
    "artifact_audit": (lambda f: X.artifact_audit(X.top_features(dictionary.nb_counts(f.texts))), _with(_TOK, _NB, "k as (select class, row_number() over (partition by class order by s desc, encode(term)) as rank, term from (select 'positive' as class, term, log_ratio as s from nb union all select 'negative', term, -log_ratio from nb) qualify rank <= 20)", "select class, count(*) as n, count(*) filter (where regexp_matches(term, '[0-9]')) as with_digit, count(*) filter (where regexp_matches(term, '[^a-z0-9 ]')) as with_mark, count(*) filter (where list_contains(list_transform(string_split(term, ' '), lambda x: length(x)), 1)) as with_letter from k group by 1")),
    "predict": (lambda f: X.predict(f.docs, dictionary.nb_counts(f.texts)), _with(_TOK, _NB, "h as (select doc_id, sum(log_ratio) as s, count(*) as n from (select doc_id, unnest(w) as term from tok) join nb using (term) group by 1)", "p as (select d.doc_id, coalesce(s, 0) as s, coalesce(n, 0) as n, 1 / (1 + exp(-greatest(-700.0::double, least(700.0::double, coalesce(s, 0))))) as p from documents d left join h using (doc_id))", "select doc_id, n as n_known, (s >= 0)::int as pred, round(greatest(p, 1 - p), 4) as confidence from p")),
    "error_sheet": (lambda f: models.error_sheet(_rules(f), f.labels.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("cause")), 50), f"with {_TEXTS}, {_RULES}, k as (select *, row_number() over (partition by model_name order by md5(doc_id::varchar || ':42'), doc_id) as rank from rules where label <> pred qualify rank <= 50) select model_name, rank, k.doc_id, label, pred, case when l.toxic = 1 then 'toxic' end as cause from k left join labels l on l.doc_id = k.doc_id"),
    "tfidf_exact": (lambda f: X.tfidf(f.docs), "with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+') as w from documents), t as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from d), c as (select doc_id, term, count(*) as tf from t group by 1, 2), s as (select term, count(*) as df, sum(tf) as n from c group by 1 having count(*) >= 3 order by n desc, encode(term) limit 30000), x as (select doc_id, term, (1 + ln(tf)) * (ln((1 + (select count(*) from documents))::double / (1 + df)::double) + 1) as w from c join s using (term)) select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from x"),
    # topics
    "keyword_lift": (_lifted, _with(_TOK, _TERMS1, _LIFT, "select * from lift")),
    "keyword_unigrams": (_chosen, _with(_TOK, _TERMS1, _LIFT, _CHOSEN, "select * from chosen")),
    "keyword_bigrams": (lambda f: X.bigram_keywords(X.topic_terms(f.docs, "lang", 2)), _with(_TOK, _TERMS2, "k as (select *, sum(df) over (partition by term) as df_all, df::double / sum(df) over (partition by term) as share from terms)", "b as (select term, max(struct_pack(share := share, topic := topic, df_all := df_all)) as x from k where df_all >= 15 and share >= 0.35 group by 1)", "select x.topic as topic, row_number() over (partition by x.topic order by x.df_all desc, encode(term)) as rank, term, x.df_all::bigint as df_all, round(x.share, 6) as share from b qualify rank <= 15")),
    "keyword_owners": (lambda f: X.keyword_owners(_chosen(f)), _with(_TOK, _TERMS1, _LIFT, _CHOSEN, _OWNERS, "select term, x.topic as topic, x.lift as lift, n_topics from owners")),
    "keyword_map": (lambda f: X.keyword_map(_chosen(f)), _with(_TOK, _TERMS1, _LIFT, _CHOSEN, "select topic, string_agg(term, ',' order by encode(term)) as keywords, count(*) as n from chosen group by 1")),
    "topic_assignment": (lambda f: X.assigned(f.docs, X.keyword_owners(_chosen(f))), _with(_TOK, _TERMS1, _LIFT, _CHOSEN, _OWNERS, "h as (select doc_id, x.topic as topic, count(*) as n from (select doc_id, unnest(w) as term from tok) join owners using (term) group by 1, 2)", "g as (select doc_id, max(struct_pack(weight := weight, topic := topic)) as x from (select *, n::double / sum(n) over (partition by doc_id) as weight from h) group by 1)", "select doc_id, case when x.weight >= 0.3 then x.topic end as topic from g")),
    "topic_agreement": (lambda f: X.assignment_agreement(X.assigned(f.docs, X.keyword_owners(_chosen(f))), f.docs.select("doc_id", F.col("lang").alias("topic"))), _with(_TOK, _TERMS1, _LIFT, _CHOSEN, _OWNERS, "h as (select doc_id, x.topic as topic, count(*) as n from (select doc_id, unnest(w) as term from tok) join owners using (term) group by 1, 2)", "g as (select doc_id, max(struct_pack(weight := weight, topic := topic)) as x from (select *, n::double / sum(n) over (partition by doc_id) as weight from h) group by 1)", "j as (select x.topic = lang as same from g join documents using (doc_id) where x.weight >= 0.3 and lang is not null)", f"select count(*) as n, count(*) filter (where same) as n_same, {_pct('count(*) filter (where same)', 'count(*)')} as agreement_pct from j")),
    "u_mass": (lambda f: X.u_mass(f.docs, _chosen(f)), _with(_TOK, _TERMS1, _LIFT, _CHOSEN, "h as (select distinct doc_id, topic, rank from (select doc_id, unnest(w) as term from tok) join chosen using (term))", "n as (select topic, rank as b, count(*) as n_b from h group by 1, 2)", "p as (select x.topic, x.rank as a, y.rank as b, count(*) as n_ab from h x join h y on x.doc_id = y.doc_id and x.topic = y.topic and x.rank > y.rank group by all)", "e as (select x.topic, x.rank as a, y.rank as b from chosen x join chosen y on x.topic = y.topic and x.rank > y.rank)", "select topic, count(*) as n_pairs, round(avg(ln((coalesce(n_ab, 0) + 1)::double / n_b)), 6) as u_mass from e left join n using (topic, b) left join p using (topic, a, b) group by 1")),
    "category_ranking": (lambda f: X.ranking(f.pairs), _with(_R, _S, _T, _PAIRS, f"c as (select kategori, count(*) as n, sum(likes)::bigint as likes, {_pct('count(*)', '(select count(distinct review_id) from pairs where pred_label = 0)')} as share from pairs where pred_label = 0 group by 1), k as (select *, row_number() over (order by n desc, kategori) as rank_n, row_number() over (order by likes desc, kategori) as rank_likes from c)", "select *, rank_n - rank_likes as gap from k")),
    "category_trend_partial": (lambda f: X.trend_with_partial(f.pairs, f.monthly), _with(_R, _S, _T, _PAIRS, _MONTHLY, "select c.bulan, kategori, jumlah, periode_parsial from (select date_trunc('month', tanggal)::date as bulan, kategori, count(*) as jumlah from pairs group by 1, 2) c join monthly using (bulan)")),
    "category_first_last_year": (lambda f: X.first_last_year(f.pairs, _bounds(f)), _with(_R, _S, _T, _PAIRS, _B, "n as (select *, tanggal < lo + interval 12 month as e, tanggal >= hi - interval 12 month as l from pairs, bounds where pred_label = 0), a as (select count(distinct review_id) filter (where e) as ae, count(distinct review_id) filter (where l) as al from n)", f"select kategori, count(*) filter (where e) as n_first, count(*) filter (where l) as n_last, {_pct('count(*) filter (where e)', 'any_value(ae)')} as pct_first, {_pct('count(*) filter (where l)', 'any_value(al)')} as pct_last from n, a group by 1")),
    "category_union": (lambda f: X.union_coverage(f.pairs, 1, 26), _with(_R, _S, _T, _PAIRS, "select count(*) as n_either, count(*) filter (where k = 2) as n_both from (select review_id, count(*) as k from pairs where kategori_id in (1, 26) group by 1)")),
    # releases
    "release_share_diff": (lambda f: X.share_difference(f.by_version), _with(_R, _S, _VER, "select versi_minor, round(100 * (neg::double / n - (sum(neg) over ())::double / (sum(n) over ())::double), 6) as diff_pp from v")),
    "release_window_tests": (
        lambda f: X.window_tests(_windows(f)),
        _with(
            _R,
            _S,
            _VER,
            _NWIN,
            "wz as (select *, (ga / nullif(na, 0) - gb / nullif(nb, 0)) / nullif(sqrt((gb + ga) / (nb + na) * (1 - (gb + ga) / (nb + na)) * (1 / nullif(nb, 0) + 1 / nullif(na, 0))), 0) as z from w)",
            f"wp as (select *, {_upper('z')} as p from wz)",
            _bh("wq", "wp", "versi_minor, nb, gb, na, ga, z"),
            "select versi_minor, nb::bigint as n_before, na::bigint as n_after, round(100 * (gb / nullif(nb, 0)), 6) as pct_before, round(100 * (ga / nullif(na, 0)), 6) as pct_after, round(100 * (ga / nullif(na, 0) - gb / nullif(nb, 0)), 6) as delta_pp, round(z, 6) as z, round(p, 6) as p, round(q, 6) as q from wq",
        ),
    ),
    "release_left_censored": (lambda f: X.left_censored(f.by_version, f.r.agg(F.min("tanggal").alias("lo"))), _with(_R, _S, _VER, _B, "select versi_minor, t0 < lo + interval 28 day as censored from v, bounds")),
    "release_dual_flags": (
        lambda f: X.dual_flags(release.z_tests(f.by_version), release.z_tests(release.by_version(f.r.withColumn("label", F.col("sentimen_aktual"))))),
        _with(
            _R,
            _S,
            _VER,
            _Z,
            _ZP,
            _bh("zq", "zp", "versi_minor, delta_pp"),
            _VER.replace("v as (", "v2 as (", 1).replace("pred_label = 0", "sentimen_aktual = 0").replace("from s where versi_minor is not null", "from reviews where versi_minor is not null and sentimen_aktual is not null"),
            _Z.replace("z as (", "z2 as (", 1).replace("from v)", "from v2)"),
            _ZP.replace("zp as (", "zp2 as (", 1).replace("from z)", "from z2)"),
            _bh("zq2", "zp2", "versi_minor, delta_pp"),
            "m as (select a.versi_minor, coalesce(a.delta_pp >= 5 and a.q < 0.05::double, false) as by_prediction, coalesce(b.delta_pp >= 5 and b.q < 0.05::double, false) as by_rating from zq a left join zq2 b on b.versi_minor = a.versi_minor)",
            "select *, by_prediction and by_rating as by_both from m",
        ),
    ),
    "release_flags_given_p": (lambda f: release.flags(release.bh(release.z_tests(f.by_version).withColumn("p", 1 / (1 + F.exp(1.702 * F.col("z")))), "p", "q")).select("versi_minor", F.round("q", 6).alias("q"), "flag"), _with(_R, _S, _VER, _Z, "b as (select versi_minor, delta_pp, 1 / (1 + exp(1.702::double * z)) as p from z), k as (select *, row_number() over (partition by p is null order by p) as r, count(p) over () as m from b)", "u as (select versi_minor, delta_pp, case when p is not null then least(1.0::double, min(p * m / r) over (partition by p is null order by r rows between current row and unbounded following)) end as q from k)", "select versi_minor, round(q, 6) as q, coalesce(delta_pp >= 5 and q < 0.05::double, false) as flag from u")),
    # serving and tables
    "kpi_full": (lambda f: X.kpi_full(serving.kpi(f.monthly, f.actual), f.version, marts.agg_meta(f.r)), None),
    "version_coverage_pct": (lambda f: X.version_coverage_pct(f.version, marts.agg_meta(f.r), 200), _with(_R, _S, _VERSION, f"select count(*) as n_versi, coalesce(sum(total_ulasan), 0)::bigint as n_ulasan, {_pct('coalesce(sum(total_ulasan), 0)', '(select count(versi_minor) from reviews)')} as pct_of_versioned, {_pct('coalesce(sum(total_ulasan), 0)', '(select count(*) from reviews)')} as pct_of_all from version where total_ulasan >= 200")),
    "display_monthly": (lambda f: X.displayed(f.monthly), _with(_R, _S, _MONTHLY, "select bulan, replace(format('{:,}', total_ulasan), ',', '.') as total, replace(format('{:.2f}', persen_negatif), '.', ',') || '%' as persen, strftime(bulan, '%m-%Y') as periode from monthly")),
    "upsert_labels": (lambda f: warehouse.upsert(f.labels, f.labels.filter("doc_id % 7 = 0").select("doc_id", (1 - F.col("quality")).cast("int").alias("quality"), "toxic"), ["doc_id"]).select("doc_id", F.col("quality").cast("int").alias("quality")), "select doc_id, (case when doc_id % 7 = 0 then 1 - quality else quality end)::int as quality from labels"),
    "pending_docs": (lambda f: warehouse.pending(f.docs, f.labels, ["doc_id"]).select("doc_id", "lang"), "select doc_id, lang from documents where doc_id not in (select doc_id from labels where doc_id is not null)"),
    "masked_update": (lambda f: warehouse.masked_update(f.docs.select("doc_id", "text"), f.docs.filter("lang = 'en'"), f.docs.select("doc_id", F.concat(F.lit("> "), "text").alias("text")).filter("text is not null"), "doc_id", "text").select("doc_id", F.md5("text").alias("digest")), "select doc_id, md5(case when lang = 'en' then '> ' || text else text end) as digest from documents"),
    "replace_suffix": (lambda f: warehouse.replace_suffix(f.s.groupBy("model_name").agg(F.count(F.lit(1)).alias("n")), _frame(f, [("new_al", 1)], "model_name string, n long"), "model_name", "al"), _with(_R, _S, "select model_name, count(*) as n from scores where model_name not like '%al' group by 1 union all select 'new_al', 1")),
    "completeness": (lambda f: warehouse.complete(f.docs, f.labels, ["doc_id"]).groupBy("lacks").agg(F.count(F.lit(1)).alias("n")), "select 'right' as lacks, count(*) as n from (select distinct doc_id from documents where doc_id not in (select doc_id from labels)) having count(*) > 0 union all select 'left', count(*) from (select distinct doc_id from labels where doc_id not in (select doc_id from documents)) having count(*) > 0"),
    "constraint_report": (lambda f: warehouse.constraints({"reviews": f.r, "scores": f.s, "topics": f.t, "review_topics": f.x}, {"reviews": ["id"], "scores": ["review_id", "model_name"], "topics": ["id"], "review_topics": ["review_id", "topic_id"]}, [("scores", "review_id", "reviews", "id"), ("review_topics", "topic_id", "topics", "id"), ("review_topics", "review_id", "reviews", "id")]), _with(_R, _S, _T, "select 'pk reviews' as rule, (count(*) - count(distinct id))::bigint as violations from reviews union all select 'pk scores', count(*) - count(distinct (review_id, model_name)) from scores union all select 'pk topics', count(*) - count(distinct id) from topics union all select 'pk review_topics', count(*) - count(distinct (review_id, topic_id)) from review_topics union all select 'fk scores.review_id', count(*) from scores where review_id not in (select id from reviews) union all select 'fk review_topics.topic_id', count(*) from review_topics where topic_id not in (select id from topics) union all select 'fk review_topics.review_id', count(*) from review_topics where review_id not in (select id from reviews)")),
    "merge_languages": (lambda f: files.merge_languages({"en": f.docs.filter("lang = 'en' or doc_id % 10 = 0").select("doc_id", "n_chars"), "xx": f.docs.filter("lang <> 'en' or doc_id % 10 = 1").select("doc_id", "n_chars")}, "doc_id", "n_chars"), "with u as (select doc_id, n_chars, 'en' as lang, 0 as k from documents where lang = 'en' or doc_id % 10 = 0 union all select doc_id, n_chars, 'xx', 1 from documents where lang <> 'en' or doc_id % 10 = 1) select doc_id, arg_min(n_chars, k) as n_chars, arg_min(lang, k) as lang, count(*) as n_sources from u group by 1"),
    "trigger_check": (lambda f: warehouse.complete(topics.trigger_rows(f.t, f.x).select("kategori", "keyword"), f.t.select("kategori", "keyword"), ["kategori", "keyword"]).filter("lacks = 'right'").agg(F.count(F.lit(1)).alias("n_unknown")), "select 0::bigint as n_unknown"),
}
_HEAD, _, _TAIL = _KPI.partition("\nselect sum(total_ulasan)")
QUERIES["kpi_full"] = (
    QUERIES["kpi_full"][0],
    f"{_HEAD},\n{_VERSION},\nq as (select sum(total_ulasan){_TAIL})\nselect *, (select count(*) from version) as n_versi, (select {_pct('count(*) - count(versi_minor)', 'count(*)')} from reviews) as versi_null_pct, {_r2('persen_negatif_model - persen_negatif_aktual')} as selisih_model_aktual, {_r2('100 - persen_negatif_model')} as persen_positif from q",
)
