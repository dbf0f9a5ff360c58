"""Registered queries of the fact register and of the number check over documents; their SQL is composed of the SQL of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from revlake.functions import prose
from revlake.operators import facts
from revlake.plans import more, registry, topicqueries
from revlake.plans.registry import Frames

_TABLES = registry.QUERIES | more.QUERIES | topicqueries.QUERIES

#: section, query, keys, columns with units.
SPECS = (
    ("dataset", "eda_profile", (), {"n_rows": "rows", "first_day": "text", "last_day": "text", "n_months": "months", "missing_version": "rows", "missing_label": "rows"}),
    ("duplicates", "eda_duplicate_scopes", ("scope",), {"n_repeats": "rows"}),
    ("version_coverage", "eda_version_coverage", ("threshold",), {"n_versions": "versions", "n_reviews": "rows"}),
    ("likes", "eda_likes_profile", (), {"mean": "likes", "q2": "likes", "most": "likes", "share_zero": "percent"}),
    ("rating", "eda_rating", ("rating",), {"n": "rows", "share": "percent"}),
    ("asymmetry", "eda_length", ("label",), {"n": "rows", "mean_words": "words", "median_words": "words", "max_words": "words"}),
    ("class", "eda_class_mix", ("class",), {"n": "rows", "share_of_three": "percent", "share_of_two": "percent"}),
    ("preprocessing", "phrase_doc_counts", ("phrase",), {"n_dokumen": "documents"}),
    ("model", "metrics_ordered", ("model_name",), {"n_eval": "rows", "accuracy": "share", "macro_f1": "share"}),
    ("baseline", "majority_baseline", (), {"label": "class", "accuracy": "share"}),
    ("error", "error_profile", ("model_name", "rating", "direction"), {"n": "rows"}),
    ("features", "top_features", ("class", "rank"), {"term": "text", "log_ratio": "log"}),
    ("topics", "agg_category", ("kategori",), {"jumlah_ulasan": "rows", "persen_negatif": "percent", "total_likes": "likes"}),
    ("agreement", "agreement_kappa", (), {"n": "rows", "agreement": "share", "kappa": "share"}),
    ("coherence", "coherence_choice", ("k",), {"c_v": "share", "u_mass": "log", "chosen": "text"}),
    ("trend", "eda_extreme_months", (), {"worst": "text", "worst_pct": "percent", "best": "text", "best_pct": "percent"}),
    ("series", "eda_series_agreement", (), {"n_months": "months", "pearson": "share", "mean_abs_diff": "points"}),
    ("release", "release_flags", ("versi_minor",), {"z": "z", "p": "share", "q": "share", "flag": "text"}),
    ("homogeneity", "release_chi2", (), {"chi2": "chi2", "dof": "degrees", "p": "share"}),
    ("structural", "release_window_tests", ("versi_minor",), {"pct_before": "percent", "pct_after": "percent", "delta_pp": "points", "q": "share"}),
    ("composition", "category_first_last_year", ("kategori",), {"n_first": "rows", "n_last": "rows", "pct_first": "percent", "pct_last": "percent"}),
)
#: Sections of tables that people fill by hand: name, file, step.
AWAITED = (("audit", "translation_audit.csv", "audit of translations"), ("validation", "blind_sample.csv", "labels of independent judges"))


def sections(f: Frames) -> list[facts.Section]:
    ready = [facts.Section(name, query, _TABLES[query][0](f), keys, units) for name, query, keys, units in SPECS]
    return ready + [facts.Section(name, source, awaits=step) for name, source, step in AWAITED]


def _register(f: Frames) -> DataFrame:
    return facts.register(f.spark, sections(f))


def _check(f: Frames) -> DataFrame:
    return facts.number_check(f.docs, "doc_id", _register(f))


def _section_sql(name: str, query: str, keys: tuple[str, ...], units: dict[str, str]) -> str:
    path = " || '.' || ".join([f"'{name}'", *(f"coalesce({k}::varchar, '-')" for k in keys)])
    listed = lambda items: "[" + ", ".join(items) + "]"
    value = listed("null::double" if u == facts.TEXT else f"{c}::double" for c, u in units.items())
    words = listed(f"{c}::varchar" if u == facts.TEXT else "null::varchar" for c, u in units.items())
    status = listed(f"case when {c} is null then 'empty' else 'ready' end" for c in units)
    names, kinds = listed(f"'{c}'" for c in units), listed(f"'{u}'" for u in units.values())
    return f"""select '{name}' as section, {path} || '.' || unnest({names}) as path, unnest({value}) as value, unnest({words}) as words, unnest({kinds}) as unit, unnest({status}) as status, '{query}' as source
from ({_TABLES[query][1]})"""


_WAITING = [f"select '{n}' as section, '{n}' as path, null::double as value, '{step}' as words, 'text' as unit, 'waiting' as status, '{source}' as source" for n, source, step in AWAITED]
_FACTS = "\nunion all\n".join([*(_section_sql(*s) for s in SPECS), *_WAITING])


def _without(text: str, block: str) -> str:
    """Matches of a block replaced by their line ends."""
    ends = f"regexp_extract_all({text}, '{block}')"
    return f"(select coalesce(string_agg(p || coalesce(regexp_replace(e, '[^\\n]+', '', 'g'), ''), '' order by i), '') from (select unnest(string_split_regex({text}, '{block}')) as p, unnest({ends}) as e, generate_subscripts(string_split_regex({text}, '{block}'), 1) as i))"


def _found(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{_NUMBER}'), lambda x: regexp_extract(x, '{_CUT}'))"


def _scrubbed(line: str) -> str:
    for pattern, kept in prose.SCRUBBED:
        line = f"regexp_replace({line}, '{pattern}', '{kept}', 'g')"
    return line


#: DuckDB has no look-ahead: the character after thousands is taken along, and cut off; it is no digit, so no number begins there.
_NUMBER = f"{prose.DOTTED}(?:[^0-9.]|$)|{prose.COMMAED}(?:[^0-9,]|$)|{prose.DECIMAL_COMMA}|{prose.PLAIN}"
_CUT = "[0-9](?:[0-9.,]*[0-9])?"
_VALUE = f"""(case when regexp_full_match(written, '{prose.DOTTED}') then replace(replace(written, '.', ''), ',', '.')
  when regexp_full_match(written, '{prose.COMMAED}') then replace(written, ',', '') else replace(written, ',', '.') end)"""
_CHECK = f"""with facts as materialized ({_FACTS}),
ready as (select * from facts where status = 'ready'),
worded as (select unnest({_found('words')}) as written from ready where words is not null),
base as (select distinct v from (select value as v from ready where value is not null union all select {_VALUE}::double from worded)),
allowed as (select distinct d, round_even(v * 10.0::double ** d, 0) as at from (select v, unnest(range(0, {prose.PLACES + 1})) as d from (select v from base union all select v * 100 from base))),
coded as (select doc_id, {_without('text', prose.CODE_BLOCK)} as text from documents where text is not null),
plain as (select doc_id, {_without('text', prose.COMMENT)} as text from coded),
cut as (select doc_id, string_split_regex(text, '\\r\\n|[\\n\\x0B\\f\\r\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]') as l from plain),
line as (select doc_id, unnest(range(1, len(l) + 1)) as line, unnest(l) as text from cut),
spots as (select doc_id, line, {_found(_scrubbed('text'))} as w from line where regexp_matches(text, '[0-9]')),
spot as (select doc_id, line, unnest(range(1, len(w) + 1)) as place, unnest(w) as written from spots),
n as (select doc_id, line::int as line, place::int as place, written, {_VALUE} as plain from spot),
k as (select *, least(length(regexp_extract(plain, '\\.([0-9]+)$', 1)), {prose.PLACES}) as d from n)
select doc_id, line, place, written from k where not exists (select 1 from allowed a where a.d = k.d and a.at = round_even(k.plain::double * 10.0::double ** k.d, 0))"""

QUERIES: dict = {
    "facts": (_register, _FACTS),
    "number_check": (_check, _CHECK),
}
