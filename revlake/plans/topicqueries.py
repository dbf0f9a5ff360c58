"""Registered queries of topic weights and coherence, on topics that the corpus gives: one for each language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlake.operators import analysis as X
from revlake.operators import models, sheets, topicmodel
from revlake.plans.more import _CHOSEN, _LIFT, _TERMS1, _chosen
from revlake.plans.more import QUERIES as _MORE
from revlake.plans.registry import _TOK, Frames, _with

LANGS = ("de", "en", "es", "fr")
#: A fixed number of rounds, as SQL has to do the same.
ROUNDS, ALPHA = 6, 0.25


def _topics(f: Frames) -> DataFrame:
    """term, weights: how often each language has the word, plus a tenth; words of ten documents or more."""
    words = topicmodel.words_of(f.docs).join(f.docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", F.explode_outer("words").alias("term")).filter("term is not null")
    counts = words.groupBy("doc_id", "lang", "term").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.array(*(F.coalesce(F.sum(F.when(F.col("lang") == g, F.col("n"))), F.lit(0)) + 0.1 for g in LANGS)).alias("weights"))
    return found.filter("df >= 10").select("term", "weights")


def _weights(f: Frames) -> DataFrame:
    return topicmodel.posterior(topicmodel.words_of(f.docs), "doc_id", _topics(f), [ALPHA] * len(LANGS), ROUNDS, 0.0)


def _agreement(f: Frames) -> DataFrame:
    """Rules against topic weights, where both give a topic."""
    lda = X.dominant_topic(_weights(f)).filter("topic >= 0").select("doc_id", F.element_at(F.array(*map(F.lit, LANGS)), (F.col("topic") + 1).cast("int")).alias("topic"))
    return X.assignment_agreement(X.assigned(f.docs, X.keyword_owners(_chosen(f))), lda)


def _models(f: Frames) -> DataFrame:
    """Models of 3 to 10 words a topic, as topics 1000 k + number of the language."""
    numbered = _chosen(f).withColumn("t", F.dense_rank().over(Window.orderBy("topic")) - 1)  # some words per language
    return numbered.withColumn("k", F.explode(F.sequence(F.lit(3), F.lit(10)))).filter("rank <= k").select((1000 * F.col("k") + F.col("t")).cast("int").alias("topic"), F.col("rank").cast("int").alias("rank"), "term")


def _psi(x: str) -> str:
    y = f"(({x}) + 6)"
    return f"(ln{y} - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6)" + "".join(f" - 1 / (({x}) + {k})" for k in range(6)) + ")"


_K = range(len(LANGS))
_INFER = [
    f"""lam as (select term, {', '.join(f"coalesce(sum(n) filter (where lang = '{g}'), 0)::double + 0.1::double as l{k}" for k, g in enumerate(LANGS))}
  from (select doc_id, lang, term, count(*) as n from (select tok.doc_id, lang, unnest(w) as term from tok join documents using (doc_id)) group by all) group by term having count(*) >= 10)""",
    f"sums as (select {', '.join(f'sum(l{k}) as t{k}' for k in _K)} from lam)",
    f"beta as (select term, {', '.join(f'exp({_psi(f'l{k}')} - {_psi(f't{k}')}) as b{k}' for k in _K)} from lam, sums)",
    "n as (select doc_id, term, count(*)::double as n from (select doc_id, unnest(w) as term from tok) where term in (select term from beta) group by all)",
    f"g0 as (select doc_id, {', '.join(f'{ALPHA}::double + coalesce(s, 0) / {len(LANGS)} as g{k}' for k in _K)} from documents left join (select doc_id, sum(n) as s from n group by 1) using (doc_id))",
]
for _i in range(ROUNDS):
    _total = " + ".join(f"g{k}" for k in _K)
    _product = " + ".join(f"e{k} * b{k}" for k in _K)
    _INFER += [
        f"e{_i} as materialized (select doc_id, {', '.join(f'exp({_psi(f'g{k}')} - {_psi('tot')}) as e{k}' for k in _K)} from (select *, {_total} as tot from g{_i}))",
        f"s{_i} as materialized (select doc_id, {', '.join(f'sum(n / ({_product} + 1e-100) * b{k}) as s{k}' for k in _K)} from n join beta using (term) join e{_i} using (doc_id) group by 1)",
        f"g{_i + 1} as materialized (select doc_id, {', '.join(f'{ALPHA}::double + coalesce(e{k} * s{k}, 0) as g{k}' for k in _K)} from e{_i} left join s{_i} using (doc_id))",
    ]
_total = " + ".join(f"g{k}" for k in _K)
_INFER.append(f"weights as (select doc_id, [{', '.join(f'g{k} / ({_total})' for k in _K)}] as w from g{ROUNDS})")
_DOMINANT = "dominant as (select doc_id, (case when list_max(w) >= 0.3 then list_position(w, list_max(w)) - 1 else -1 end)::bigint as topic, round(list_max(w), 6) as weight from weights)"

_COHERENT = [
    _TOK,
    _TERMS1,
    _LIFT,
    _CHOSEN,
    "langs as (select topic as lang, row_number() over (order by topic) - 1 as t from (select distinct topic from chosen))",
    "models as (select 1000 * k + t as topic, rank, term from (select c.*, t, unnest(range(3, 11)) as k from chosen c join langs on lang = topic) where rank <= k)",
    # every window of every word by itself
    "placed as (select doc_id, unnest(w) as term, generate_subscripts(w, 1) - 1 as p, greatest(len(w) - 110, 0) as last from tok)",
    "held as (select distinct doc_id, term, unnest(range(greatest(p - 109, 0), least(p, last) + 1)) as s from placed where term in (select term from models))",
    "one as (select term, count(*)::double as f from held group by 1)",
    "two as (select x.term as a, y.term as b, count(*)::double as n from held x join held y on x.doc_id = y.doc_id and x.s = y.s group by all)",
    "total as (select sum(greatest(len(w) - 109, 1))::double as d from tok where len(w) > 0)",
    """npmi as (select x.topic, x.term as a, y.term as b, ln((coalesce(n, 0) / d + 1e-12) / ((p.f / d) * (q.f / d))) / -ln(coalesce(n, 0) / d + 1e-12) as v
  from models x join models y on x.topic = y.topic left join two on two.a = x.term and two.b = y.term join one p on p.term = x.term join one q on q.term = y.term, total)""",
    "summed as (select topic, b, sum(v) as s from npmi group by all)",
    "cosine as (select topic, a, sum(v * s) / sqrt(sum(v * v)) / sqrt(sum(s * s)) as c from npmi join summed using (topic, b) group by all)",
    "cv as (select topic, round(avg(c), 6) as c_v from cosine group by 1)",
]
_UM = [
    "h as (select distinct doc_id, topic, rank from (select doc_id, unnest(w) as term from tok) join models using (term))",
    "nb as (select topic, rank as b, count(*) as n_b from h group by 1, 2)",
    "pb as (select x.topic, x.rank as a, y.rank as b, count(*) as n_ab from h x join h y on x.doc_id = y.doc_id and x.topic = y.topic and x.rank > y.rank group by all)",
    "eb as (select x.topic, x.rank as a, y.rank as b from models x join models y on x.topic = y.topic and x.rank > y.rank)",
    "um as (select topic, round(avg(ln((coalesce(n_ab, 0) + 1)::double / n_b)), 6) as u from eb left join nb using (topic, b) left join pb using (topic, a, b) group by 1)",
    "means as (select (topic // 1000)::int as k, round(avg(c_v), 6) as c_v, round(avg(u), 6) as u_mass from cv join um using (topic) group by 1)",
]
_RULES = "owners as (select term, max(struct_pack(lift := lift, topic := topic)) as x, count(*) as n_topics from chosen group by 1)"

_SHEET = [
    f"each as (select doc_id, unnest(range(0, {len(LANGS)}))::int as topic, round(unnest(w), 6) as weight from weights)",
    "own as (select doc_id, (list_position(w, list_max(w)) - 1)::int as topic, round(list_max(w), 6) as weight from weights)",
    "likely as (select topic, 'likely' as kind, row_number() over (partition by topic order by weight desc, doc_id) as place, doc_id, weight from each qualify place <= 5)",
    "fit as (select doc_id from documents where len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) between 10 and 60)",
    "drawn as (select * from own join fit using (doc_id) qualify row_number() over (partition by topic order by md5(doc_id::varchar || ':42'), doc_id) <= 5)",
    "typical as (select topic, 'typical' as kind, row_number() over (partition by topic order by weight desc, doc_id) as place, doc_id, weight from drawn)",
    "shown as (select x.*, trim(replace(coalesce(text, ''), chr(10), ' '), ' ') as shown from (select * from likely union all select * from typical) x join documents using (doc_id))",
    "cells as (select topic, " + ", ".join(f"max({c}) filter (where kind = '{k}' and place = {j}) as {k}_{c}_{j}" for k in ("likely", "typical") for j in range(1, 6) for c in ("doc_id", "shown", "weight")) + " from shown group by 1)",
    "counts as (select topic, count(*) as n_dominant, round((100.0::double * count(*) / sum(count(*)) over ())::decimal(38,10), 2)::double as share from own group by 1)",
    f"heavy as (select term, topic, w, sum(w) over (partition by topic) as total, row_number() over (partition by topic order by w desc, encode(term)) as place from (select term, unnest(range(0, {len(LANGS)}))::int as topic, unnest([{', '.join(f'l{k}' for k in _K)}]) as w from lam))",
    "terms20 as (select topic, string_agg(term, ', ' order by place) as top_terms, string_agg(term || ':' || printf('%.4f', w / total), ', ' order by place) as top_terms_weights from heavy where place <= 20 group by 1)",
]


def _negative(f: Frames) -> DataFrame:
    return f.texts.filter("label = 0").select("doc_id", "text")


def _blind(f: Frames) -> tuple[DataFrame, DataFrame]:
    return sheets.blind_sample(_negative(f), X.assigned(f.docs, X.keyword_owners(_chosen(f))))


_SAMPLE = """sampled as (select row_number() over (order by doc_id) as no, doc_id, text
  from (select d.doc_id, text from documents d join labels l using (doc_id) where quality = 0 order by md5(d.doc_id::varchar || ':42'), d.doc_id limit 50))"""

QUERIES: dict = {
    "labelling_sheet": (
        lambda f: sheets.labelling_sheet(_weights(f), f.docs, _topics(f)),
        _with(_TOK, *_INFER, *_SHEET, "select topic, top_terms, top_terms_weights, coalesce(n_dominant, 0) as n_dominant, coalesce(share, 0) as share, cells.* exclude (topic), '' as category, '' as reason from terms20 left join counts using (topic) left join cells using (topic)"),
    ),
    "blind_sample": (lambda f: _blind(f)[0], _with(_SAMPLE, "select no, doc_id, trim(replace(coalesce(text, ''), chr(10), ' '), ' ') as shown, '' as judge_1, '' as judge_2, '' as note from sampled")),
    "blind_sample_key": (lambda f: _blind(f)[1], _with(_SAMPLE, f"select no, doc_id, topic from sampled left join ({_MORE['topic_assignment'][1]}) using (doc_id)")),
    "definition_sheet": (
        lambda f: sheets.definitions(_chosen(f), X.bigram_keywords(X.topic_terms(f.docs, "lang", 2))),
        f"select topic, string_agg(term, ', ' order by o, rank) as keywords from (select topic, 1 as o, rank, term from ({_MORE['keyword_unigrams'][1]}) where rank <= 8 union all select topic, 2 as o, rank, term from ({_MORE['keyword_bigrams'][1]}) where rank <= 4) group by 1 union all select '{sheets.NO_CATEGORY[0]}', '{sheets.NO_CATEGORY[1]}'",
    ),
    "topic_posterior": (
        lambda f: _weights(f).select("doc_id", *(F.round(F.get("weights", F.lit(k)), 6).alias(f"w_{g}") for k, g in enumerate(LANGS))),
        _with(_TOK, *_INFER, f"select doc_id, {', '.join(f'round(w[{k + 1}], 6) as w_{g}' for k, g in enumerate(LANGS))} from weights"),
    ),
    "dominant_topic": (lambda f: X.dominant_topic(_weights(f)), _with(_TOK, *_INFER, _DOMINANT, "select * from dominant")),
    "topic_agreement_posterior": (
        _agreement,
        _with(
            _TOK, _TERMS1, _LIFT, _CHOSEN, _RULES, *_INFER, _DOMINANT,
            "hh as (select doc_id, x.topic as topic, count(*) as n from (select doc_id, unnest(w) as term from tok) join owners using (term) group by 1, 2)",
            "gg as (select doc_id, max(struct_pack(weight := weight, topic := topic)) as x from (select *, n::double / sum(n) over (partition by doc_id) as weight from hh) group by 1)",
            f"jj as (select x.topic = {list(LANGS)}[d.topic + 1] as same from gg join dominant d using (doc_id) where x.weight >= 0.3 and d.topic >= 0)",
            "select count(*) as n, count(*) filter (where same) as n_same, round((100.0::double * count(*) filter (where same) / nullif(count(*), 0))::decimal(38,10), 2)::double as agreement_pct from jj",
        ),
    ),
    "c_v": (lambda f: topicmodel.c_v(topicmodel.words_of(f.docs), _models(f)), _with(*_COHERENT, "select topic::int as topic, c_v from cv")),
    "coherence_choice": (lambda f: models.with_choice(models.coherences(f.docs, _models(f))), _with(*_COHERENT, *_UM, "select k, c_v, u_mass, k = (select min(k) from means where c_v >= (select max(c_v) from means) - 0.005::double) as chosen from means")),
    "lda_assignment": (lambda f: models.lda_assignment(f.docs).drop("weights"), None),
}
