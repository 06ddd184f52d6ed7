"""Registered queries: roll-ups, latest rows, text functions, criteria extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from bidloom.fixtures import view as V
from bidloom.functions import patterns as P
from bidloom.functions import text as T
from bidloom.operators import changes, criteria, rollups
from bidloom.oracle_views import plain
from bidloom.plans import evaluation
from bidloom.queries import _REASONED, _reasoned, query
from bidloom.sources import plugins


# Roll-ups --------------------------------------------------------------------------------------
@query("""select owner_id, count(*) as tenders, (select count(*) from {customer}) as officers from {tenders} group by owner_id""")
def totals(spark, sf):
    n = V(spark, sf, "customer").agg(F.count("*").alias("officers"))
    return V(spark, sf, "tenders").groupBy("owner_id").agg(F.count("*").alias("tenders")).join(F.broadcast(n))


_LISTINGS = [("tenders", "owner_id"), ("bidders", "tender_id"), ("criteria", "tender_id"), ("audit", "user_id")]


@query(" union all ".join(f"select '{name}' as listing, cast({key} as varchar) as key, count(*) as total from {{{name}}} group by {key}" for name, key in _LISTINGS)
       + """ union all select 'bidder_docs', bidder_id, count(*) from {bidder_docs} group by bidder_id union all
  select 'results', cast(tender_id as varchar), count(*) from {decisions} group by tender_id union all
  select 'review_queue', cast(owner_id as varchar), count(*) from {decisions} d join {tenders} t on t.id = d.tender_id where verdict = 'NEEDS_REVIEW' group by owner_id""")
def listing_totals(spark, sf):
    """How many rows each page-wise listing has in all, by the key it is listed for."""
    d = evaluation.decisions(spark, sf)
    t = V(spark, sf, "tenders").select(F.col("id").alias("tender_id"), "owner_id")
    parts = [rollups.listing_total(V(spark, sf, name), name, key) for name, key in _LISTINGS]
    parts.append(rollups.listing_total(V(spark, sf, "bidder_docs"), "bidder_docs", "bidder_id"))
    parts.append(rollups.listing_total(d, "results", "tender_id"))
    parts.append(rollups.listing_total(d.filter("verdict = 'NEEDS_REVIEW'").join(t, "tender_id"), "review_queue", "owner_id"))
    return reduce(lambda a, b: a.unionByName(b), parts)


_OVER = """case when total = 0 then 'PENDING' when conflicts > 0 or needs_review > 0 then 'NEEDS_REVIEW' when not_eligible > 0 then 'NOT_ELIGIBLE' else 'ELIGIBLE' end"""


def _board(spark, sf, part=""):
    d = evaluation.decisions(spark, sf)
    return rollups.scoreboard(V(spark, sf, "bidders"), d.filter(part) if part else d)


@query(f"""select *, {_OVER} as overall, round(eligible * 100.0 / greatest(total, 1), 6)::double as eligible_pct, round(not_eligible * 100.0 / greatest(total, 1), 6)::double as not_eligible_pct,
  round(needs_review * 100.0 / greatest(total, 1), 6)::double as needs_review_pct from {{scoreboard}}""")
def bidder_scoreboard(spark, sf):
    return _board(spark, sf)


@query(f"""select s.tender_id, count(*) as n_bidders, count_if(o = 'ELIGIBLE') as n_eligible, count_if(o = 'NEEDS_REVIEW') as n_review, count_if(o = 'PENDING') as n_pending, coalesce(max(nc), 0) as n_criteria,
  case when count_if(o = 'PENDING') = count(*) then 'pending' when count_if(o = 'NEEDS_REVIEW') > 0 then 'review' when count_if(o = 'ELIGIBLE') > 0 then 'eligible' else 'not_eligible' end as status,
  greatest(30.0::double, round(coalesce(max(nc), 0) * count(*) * 1.2::double)) as estimate_sec from (select *, {_OVER} as o from {{scoreboard}}) s
  left join (select tender_id, count(*) as nc from {{criteria}} group by tender_id) c on c.tender_id = s.tender_id group by s.tender_id""")
def tender_status(spark, sf):
    return rollups.tender_status(_board(spark, sf), V(spark, sf, "criteria"))


@query("""select tender_id, n_bidders, conflicts, floor((ok / n * 0.6 + c * 0.4) * 1e6 + 0.5) / 1e6 as trust, floor(least(1.0, conflicts / n) * 1e6 + 0.5) / 1e6 as fraud,
  floor(rev / n * 1e6 + 0.5) / 1e6 as ambiguity, floor(c * 1e6 + 0.5) / 1e6 as clarity, case when conflicts > 0 then 'HIGH' when rev / n > 0.3 then 'MEDIUM' else 'LOW' end as risk
  from (select tender_id, count(distinct bidder_id) as n_bidders, count_if(reason = 'CONFLICT_DETECTED')::bigint as conflicts, count_if(verdict = 'ELIGIBLE') as ok, count_if(verdict = 'NEEDS_REVIEW') as rev,
    count(*) as n, cast(sum(cast(round(confidence * 1e6) as bigint)) as double) / 1e6 / count(*) as c from {decisions} group by tender_id)""")
def tender_risk(spark, sf):
    return rollups.tender_risk(evaluation.decisions(spark, sf))


@query("select * from " + _REASONED + " where regexp_matches(coalesce(nullif(reasoning, ''), reason, ''), '" + P.CONFLICT_WORDS + "')")
def contradiction_alerts(spark, sf):
    return rollups.alerts(_reasoned(spark, sf))


def _labelled(spark, sf):
    return V(spark, sf, "criteria").withColumn("text_raw", F.expr("case when tender_id % 4 = 0 then repeat('x', 500) when tender_id % 4 = 1 then '' else field || ' at least' end"))


@query("""select 'c-' || id as id, 'criterion' as type, left(case when not contains(left(base, 40), field) then field || ': ' || base else base end, 420) as label, null::varchar as bidder_id, null::double as confidence
  from (select id, field, case when tender_id % 4 = 0 then repeat('x', 397) || '…' when tender_id % 4 = 1 then field else field || ' at least' end as base from {criteria}) union all
  select 'v-' || bidder_id || '-' || criterion_id, 'verdict', verdict, bidder_id, confidence from {decisions}""")
def graph_nodes(spark, sf):
    return rollups.graph_nodes(_labelled(spark, sf), evaluation.decisions(spark, sf))


@query("select 'c-' || criterion_id as source, 'v-' || bidder_id || '-' || criterion_id as target, 'evaluates' as label from {decisions}")
def graph_edges(spark, sf):
    return rollups.graph_edges(evaluation.decisions(spark, sf))


@query("select c.tender_id, c.id as criterion_id, count(d.verdict) as verdicts, greatest(1, count(d.verdict)) as layout_rows from {criteria} c left join {decisions} d on d.criterion_id = c.id group by all")
def graph_degree(spark, sf):
    return rollups.graph_degree(V(spark, sf, "criteria"), V(spark, sf, "bidders"))


@query("""select path, count(*) as n, round(avg(latency_ms), 6) as mean, round(median(latency_ms), 6) as median,
  list_sort(list(latency_ms))[1 + cast(round_even(0.95::double * count(*) - 0.95::double, 0) as bigint)] as p95,
  list_sort(list(latency_ms))[1 + cast(round_even(0.99::double * count(*) - 0.99::double, 0) as bigint)] as p99, min(latency_ms) as lowest, max(latency_ms) as highest from {http_log} group by path""")
def latency_summary(spark, sf):
    return rollups.latency_summary(V(spark, sf, "http_log"), "latency_ms", "path")


@query("""select path, status, count(*) as n, round(avg(latency_ms), 6) as mean, round(median(latency_ms), 6) as median,
  list_sort(list(latency_ms))[1 + cast(round_even(0.95::double * count(*) - 0.95::double, 0) as bigint)] as p95,
  list_sort(list(latency_ms))[1 + cast(round_even(0.99::double * count(*) - 0.99::double, 0) as bigint)] as p99, min(latency_ms) as lowest, max(latency_ms) as highest from {http_log} group by path, status""")
def latency_by_status(spark, sf):
    return rollups.latency_summary(V(spark, sf, "http_log"), "latency_ms", "path", "status")


@query(r"""select doc_id, string_agg(text, chr(10) order by page) as text, round(least(0.95, greatest(0.2, avg(case when mc <= 0 then 0.35 else mc end))), 6) as quality_score from
  (select doc_id, page, string_agg(token, ' ' order by pos, token) as text, round(coalesce(avg(case when confidence >= 0 then confidence end), 0.5), 6) as mc from {ocr_tokens} group by all) group by doc_id""")
def ocr_assemble(spark, sf):
    return rollups.ocr_documents(rollups.ocr_pages(V(spark, sf, "ocr_tokens")))


@query("""select doc_id, page, coalesce(string_agg(token, chr(10) order by pass, pos, token) filter (where pass = 1 or page < 2), '') as text,
  round(coalesce(avg(confidence) filter (where pass = 1 or page < 2), 0.0), 6) as mean_confidence from (select *, case when y % 3 = 0 then 2 else 1 end as pass from {ocr_tokens}) group by doc_id, page""")
def ocr_two_languages(spark, sf):
    """Lines of an English and a Hindi pass; the last page of each document was read in English only."""
    lines = V(spark, sf, "ocr_tokens").withColumn("pass", F.when(F.col("y") % 3 == 0, 2).otherwise(1)).withColumnRenamed("token", "line")
    return rollups.ocr_line_pages(lines.filter("page < 2")).unionByName(rollups.ocr_line_pages(lines.filter("page >= 2"), "eng"))


@query(r"""select f.file_id, case when ext = '.pdf' and length(trim(text)) > 50 then 'native' when ext = '.pdf' then 'scan' when ext in ('.png', '.jpg', '.jpeg', '.tif', '.tiff', '.bmp', '.webp') then 'image' else 'none' end as way,
  case when ext = '.pdf' and length(trim(text)) > 50 then 0.95 when ext = '.pdf' then least(0.95, greatest(0.2, case when conf <= 0 then 0.35 else conf end))
    when ext in ('.png', '.jpg', '.jpeg', '.tif', '.tiff', '.bmp', '.webp') then least(0.99, greatest(0.3, conf)) else 0.0 end as quality_score
  from (select file_id, lower(regexp_extract(path, '(\.[^./]+)$', 1)) as ext, case when file_id % 2 = 0 then repeat('word ', 12) else ' page ' end as text, (file_id % 25) / 20.0 - 0.1 as conf from {files}) f""")
def ocr_quality(spark, sf):
    """Quality of native text, scanned pages and images."""
    f = V(spark, sf, "files").withColumn("text", F.expr("case when file_id % 2 = 0 then repeat('word ', 12) else ' page ' end"))
    return rollups.text_quality(f.withColumn("mean_confidence", (F.col("file_id") % 25) / F.lit(20.0) - 0.1)).select("file_id", "way", "quality_score")


@query("select doc_id, page, min(x) as x, min(y) as y, max(x) - min(x) as w, max(y) - min(y) as h from {ocr_tokens} group by all")
def ocr_bbox(spark, sf):
    points = V(spark, sf, "ocr_tokens").groupBy("doc_id", "page").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    return points.select("doc_id", "page", rollups.bounding_box(F.col("p")).alias("b")).select("doc_id", "page", "b.*")


@query("""select cast(cast(t.created_at as date) as varchar) as day, count(*) as decisions, round(count_if(d.verdict = 'NEEDS_REVIEW') / count(*), 6) as review_ratio from {decisions} d
  join {tenders} t on t.id = d.tender_id group by 1""")
def review_ratio_daily(spark, sf):
    t = V(spark, sf, "tenders").select(F.col("id").alias("tender_id"), F.date_format("created_at", "yyyy-MM-dd").alias("day"))
    return evaluation.decisions(spark, sf).join(t, "tender_id").groupBy("day").agg(
        F.count("*").alias("decisions"), F.round(F.count_if(F.col("verdict") == "NEEDS_REVIEW") / F.count("*"), 6).alias("review_ratio")
    )


@query("""select tender_id, count(*) as decisions, round(count_if(verdict = 'NEEDS_REVIEW') / count(*), 6) as review_ratio from {decisions} group by tender_id""")
def review_ratio_tender(spark, sf):
    return evaluation.decisions(spark, sf).groupBy("tender_id").agg(
        F.count("*").alias("decisions"), F.round(F.count_if(F.col("verdict") == "NEEDS_REVIEW") / F.count("*"), 6).alias("review_ratio")
    )


@query("select cast(cast(created_at as date) as varchar) as day, status, count(*) as jobs from {jobs} group by all")
def job_state_counts(spark, sf):
    return V(spark, sf, "jobs").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "status").agg(F.count("*").alias("jobs"))


# Latest rows ----------------------------------------------------------------------------------
_KIND = "case when doc_pos % 6 = 0 then ' ' else doc_type end"


def _typed(spark, sf):
    return V(spark, sf, "bidder_docs").withColumn("doc_type", F.expr(_KIND))


@query(f"""select bidder_id, coalesce(nullif(trim(kind), ''), 'supporting') as doc_type, arg_max(id, (created_at, doc_pos)) as doc_id, max(created_at) as created_at
  from (select *, {_KIND} as kind from {{bidder_docs}}) group by 1, 2""")
def latest_doc_by_type(spark, sf):
    return rollups.latest_by_type(_typed(spark, sf))


@query(f"""select b.id as bidder_id, r.k as doc_type, d.doc_id, d.doc_id is not null as done from {{bidders}} b cross join (select unnest({P.CHECKLIST!r}) as k) r
  left join (select bidder_id, coalesce(nullif(trim(kind), ''), 'supporting') as k, arg_max(id, (created_at, doc_pos)) as doc_id from (select *, {_KIND} as kind from {{bidder_docs}}) group by 1, 2) d
  on d.bidder_id = b.id and d.k = r.k""")
def doc_checklist(spark, sf):
    return rollups.checklist(V(spark, sf, "bidders"), _typed(spark, sf), P.CHECKLIST)


@query("""select tender_id, arg_max(id, (created_at, id)) as job_id, arg_max(status, (created_at, id)) as status from {jobs} where status in ('queued', 'running') group by 1""")
def active_job(spark, sf):
    return rollups.active_job(V(spark, sf, "jobs"))


@query("select user_id, id, action, r as rank from (select *, row_number() over (partition by user_id order by id desc) as r from {audit}) where r <= 5")
def audit_page(spark, sf):
    return changes.page(V(spark, sf, "audit"), "user_id", [F.desc("id")], 5, total=False).select("user_id", "id", "action", "rank")


@query("""select j.id as request_id, j.tender_id, f.job_id, j.id = f.job_id as accepted from {jobs} j join (select tender_id, arg_min(id, (created_at, cast(id as bigint))) as job_id
  from {jobs} where status = 'queued' group by 1) f on f.tender_id = j.tender_id where j.status = 'queued'""")
def job_admission(spark, sf):
    return rollups.admit_jobs(V(spark, sf, "jobs"))


@query("""select id, tender_id, case when status in ('queued', 'running') then 'interrupted' else status end as status,
  case when status in ('queued', 'running') then coalesce(nullif(case when tender_id % 2 = 0 then 'lost' else '' end, ''), 'process restart') else case when tender_id % 2 = 0 then 'lost' else '' end end as error from {jobs}""")
def job_recovery(spark, sf):
    return rollups.recover_jobs(V(spark, sf, "jobs").withColumn("error", F.expr("case when tender_id % 2 = 0 then 'lost' else '' end")))


# Criteria extraction ------------------------------------------------------------------------------
def _ratio_sql(body: str) -> str:
    return body.replace("RATIO", r"coalesce(len(regexp_extract_all(text, '[ऀ-ॿ]')) / nullif(len(regexp_extract_all(text, '[\pLऀ-ॿ]')), 0), 0.0)")


_COLUMNS = ("field operator value unit mandatory priority extraction_confidence semantic_ambiguity_score text_raw source_clause "
            "temporal_type temporal_n temporal_anchor").split()  # fmt: skip


def _find(pattern: str, group: int = 0) -> str:
    return f"regexp_extract(t, '{P.as_sql(pattern)}', {group})"


def _hit(pattern: str) -> str:
    return f"regexp_matches(t, '{P.as_sql(pattern)}')"


def _number(pattern: str) -> str:
    return plain(_find(pattern, 1))


def _clause(pattern: str) -> str:
    """80 characters on both sides of the first match, in one line."""
    at = f"length(regexp_extract(t, '(?s)^(.*?)(?:{P.as_sql(pattern)})', 1))"
    cut = f"substr(text, greatest(0, {at} - 80) + 1, {at} + length({_find(pattern)}) + 80 - greatest(0, {at} - 80))"
    return rf"case when {_hit(pattern)} then left(trim(regexp_replace({cut}, '\s+', ' ', 'g')), 400) end"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _row(cond: str, field: str, operator: str, value: str, unit: str, must: bool, priority: str, conf, amb, raw: str, clause: str) -> str:
    kind, n, anchor = criteria.TEMPORAL.get(field.strip("'"), (None, None, None))
    text = lambda x: f"'{x}'" if x else "null::varchar"
    values = [field, f"'{operator}'", f"({value})::double", f"'{unit}'", str(must).lower(), f"'{priority}'", f"({conf})::double", f"({amb})::double",
              raw, clause, text(kind), f"{n or 'null'}::int", text(anchor)]
    made = ", ".join(f"{v} as {c}" for v, c in zip(values, _COLUMNS, strict=True))
    return f"select tender_id, {made} from T where {cond}"


def _inr(pattern: str) -> str:
    unit = _find(pattern, 2)
    return (f"{_number(pattern)} * case when contains({unit}, 'crore') or {unit} = 'cr' then 1e7 "
            f"when contains({unit}, 'lakh') or contains({unit}, 'lac') then 1e5 when contains({unit}, 'million') then 1e6 else 1.0 end")  # fmt: skip


def _amount_sql(field: str, lead: str, priority: str, conf: float, amb: float, seen) -> str:
    p = lead + r"[^\n\d]{0,40}" + P.AMOUNT
    v = _inr(p)
    value = {"annual_turnover": f"case when {v} <= 0 then 5e7 else {v} end", "net_worth": f"case when {v} > 0 then {v} else 1e7 end"}.get(field, v)
    own = _row(_hit(p), f"'{field}'", ">=", value, "INR", True, priority, conf, amb, _strip(_find(p)), _clause(p))
    if not seen:
        return own
    test, raw, fixed, c, a = seen
    return f"{own} union all {_row(f'not {_hit(p)} and {_hit(test)}', f'{chr(39)}{field}{chr(39)}', '>=', str(fixed), 'INR', True, priority, c, a, f'{chr(39)}{raw}{chr(39)}', _clause(test))}"


_FIN = " union all ".join(_amount_sql(*r) for r in criteria.AMOUNT_RULES)
_E, _W, _P, _M = criteria.EXPERIENCE, criteria.EXPERIENCE_WORDS, criteria.PROJECTS, criteria.MANPOWER
_LETTERS = "experience_letters,work_order,supporting"
_STAFF = f"case when contains({_find(_M)}, 'engineer') or contains({_find(_M)}, 'technical') then 'technical_staff_count' else 'manpower_count' end"
_EXP = " union all ".join([
    _row(_hit(_E), "'experience_years'", ">=", _number(_E), "years", True, _LETTERS, 0.78, 0.15, _strip(_find(_E)), _clause(_E)),
    _row(f"not {_hit(_E)} and {_hit(_W)}", "'experience_years'", ">=", "3", "years", True, _LETTERS, 0.55, 0.3, "'Relevant experience / similar contracts'", _clause(_W)),
    _row(f"{_number(_P)} between 1 and 50", "'similar_projects_count'", ">=", _number(_P), "count", True, "experience_letters,work_order", 0.7, 0.22, _strip(_find(_P)), _clause(_P)),
    _row(f"{_number(_M)} between 1 and 100000", _STAFF, ">=", _number(_M), "count", True, "pf_records,epf_statement,hr_certificate,supporting", 0.7, 0.2, _strip(_find(_M)), _clause(_M)),
])
_CERT = " union all ".join(
    _row(_hit(test), f"'{field}'", "==", "1", "bool", must, priority, conf, amb, f"'{raw}'", _clause(clause or test))
    for field, test, clause, raw, must, priority, conf, amb in [*criteria.PRESENCE_RULES, criteria.BLACKLIST]
)
_V1, _V2 = (r[0] for r in criteria.VALIDITY)
_VAL = " union all ".join(
    _row(cond, "'bid_validity_days'", ">=", _number(p), "days", True, "bid_form,supporting", conf, amb, _strip(_find(p)), _clause(p))
    for (p, conf, amb), cond in zip(criteria.VALIDITY, (_hit(_V1), f"not {_hit(_V1)} and {_hit(_V2)}"), strict=True)
)
_PLACEHOLDER = _row("true", "'generic_compliance'", "==", "1", "bool", True, "supporting", 0.4, 0.5, "'Minimum eligibility (placeholder)'", "null::varchar")
_CATEGORY = "case field " + " ".join(f"when '{k}' then '{v}'" for k, v in P.CATEGORIES.items()) + " else 'general' end"


def _rules_sql(*parts: str, source: str = "select tender_id, text, lower(text) as t from {tender_texts}") -> str:
    body = " union all ".join(f"({p})" for p in parts)
    return f"select * from (with T as ({source}) select *, {_CATEGORY} as category from ({body}))"


def _shown(rules, *more):
    parts = [F.col(f"temporal.{c}").alias(f"temporal_{c}") for c in ("type", "n", "anchor")]
    return rules.select("tender_id", *[c for c in _COLUMNS if not c.startswith("temporal")], *parts, "category", *more)


def _rules(spark, sf, pick):
    return _shown(criteria.emit(V(spark, sf, "tender_texts"), pick))


@query(_rules_sql(_FIN))
def criteria_financial(spark, sf):
    return _rules(spark, sf, criteria.amount_rules)


@query(_rules_sql(_EXP))
def criteria_experience(spark, sf):
    return _rules(spark, sf, criteria.count_rules)


@query(_rules_sql(_CERT))
def criteria_certs_tax(spark, sf):
    return _rules(spark, sf, lambda t: [*criteria.presence_rules(t), *criteria.presence_rules(t, [criteria.BLACKLIST])])


@query(_rules_sql(_VAL))
def criteria_validity(spark, sf):
    return _rules(spark, sf, criteria.validity_rules)


_ALL = (_FIN, _EXP, _CERT, _VAL)
_NONE = f"select * from ({_PLACEHOLDER}) where tender_id not in (select tender_id from ({' union all '.join(_ALL)}))"


@query(_rules_sql(*_ALL, _NONE))
def criteria_extract_all(spark, sf):
    return _shown(criteria.extract(V(spark, sf, "tender_texts")))


_ENGLISH = "case when tender_id % 24 = 7 then null else 'Translated. Minimum 5 years of experience. GST needed. ' || tender_id end"
_LANG = """(select *, case when r > 0.3 then 'hi' when r < 0.05 then 'en' else 'mixed' end as lang from (select *, RATIO as r from {tender_texts}))"""
_MIXED = f"select tender_id, lang, e is not null as done, coalesce(e, text) as text, lower(coalesce(e, text)) as t from (select *, case when lang <> 'en' then {_ENGLISH} end as e from {_LANG})"


@query(_ratio_sql(f"""select r.*, l.lang as source_text_lang, case when l.done then coalesce(source_clause, '') end as source_clause_translated,
  case when l.lang <> 'en' and not l.done then 'untranslated_indic_text' end as extraction_warning
  from ({_rules_sql(*_ALL, _NONE, source=_MIXED)}) r join ({_MIXED}) l using (tender_id)"""))
def criteria_translated(spark, sf):
    """Rules of texts in other languages, by a translation that a plug-in makes and that fails for some."""
    docs = V(spark, sf, "tender_texts")

    def make():
        def answer(texts: list[str]) -> list[str | None]:
            if any(t.startswith("fail") for t in texts):
                raise RuntimeError("down")
            return ["Translated. Minimum 5 years of experience. GST needed. " + t for t in texts]

        return answer

    # What is sent is short, so that SQL can say what comes back.
    # By a generator, so that texts are made and judged once, where they were dealt out, and not where a file holds them.
    lang = F.explode_outer(F.array(T.language(T.devanagari_ratio(F.col("text"))))).alias("lang")
    sent = docs.select("tender_id", "text", lang).filter("lang <> 'en' and text is not null").withColumn("sent", F.expr("case when tender_id % 24 = 7 then 'fail ' || tender_id else cast(tender_id as string) end"))
    english = plugins.call(sent.select("tender_id", "sent"), make, "sent", answer="english")
    return _shown(criteria.extract_in_language(docs, english), "source_text_lang", "source_clause_translated", "extraction_warning")


_TURNOVER = r"turnover[^\n\d]{0,40}" + P.AMOUNT


@query(f"select tender_id, {_inr(_TURNOVER)} as value from (select tender_id, lower(text) as t from {{tender_texts}})")
def fn_amount_inr(spark, sf):
    p = "(?iU)" + _TURNOVER
    t = F.lower("text")
    return V(spark, sf, "tender_texts").select("tender_id", criteria.amount_inr(F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)).alias("value"))


@query(r"""select tender_id, case when i > 0 then left(trim(regexp_replace(substr(text, greatest(1, i - 80), i + 7 + 80 - greatest(1, i - 80) + 1), '\s+', ' ', 'g')), 400) end as clause
  from (select *, instr(lower(text), 'turnover') as i from {tender_texts})""")
def fn_source_clause(spark, sf):
    return criteria.source_clause(V(spark, sf, "tender_texts"), "turnover")


@query("select id, field, " + _CATEGORY + " as category from {wide_criteria}")
def fn_category(spark, sf):
    return V(spark, sf, "wide_criteria").select("id", "field", criteria.category(F.col("field")).alias("category"))


@query(_ratio_sql("select tender_id, round(RATIO, 4) as ratio from {tender_texts}"))
def fn_devanagari_ratio(spark, sf):
    return V(spark, sf, "tender_texts").select("tender_id", F.round(T.devanagari_ratio(F.col("text")), 4).alias("ratio"))


@query(_ratio_sql("""select tender_id, case when r > 0.3 then 'hi' when r < 0.05 then 'en' else 'mixed' end as lang,
  round(case when r > 0.3 then least(1.0, (r - 0.3) / 0.7 + 0.5) when r < 0.05 then least(1.0, (0.05 - r) / 0.05 + 0.5) else 0.5 end, 3)::double as confidence from (select *, RATIO as r from {tender_texts})"""))
def fn_detect_language(spark, sf):
    r = T.devanagari_ratio(F.col("text"))
    return V(spark, sf, "tender_texts").select("tender_id", T.language(r).alias("lang"), F.round(T.language_confidence(r), 3).alias("confidence"))


@query(_ratio_sql("""select tender_id, lang, field from (select tender_id, case when RATIO > 0.3 then 'hi' when RATIO < 0.05 then 'en' else 'mixed' end as lang from {tender_texts}) l join ("""
                  + _rules_sql(_CERT) + ") c using (tender_id)"))
def criteria_language_stamp(spark, sf):
    docs = V(spark, sf, "tender_texts")
    docs = docs.withColumn("source_text_lang", T.language(T.devanagari_ratio(F.col("text"))))
    rules = lambda t: [*criteria.presence_rules(t), *criteria.presence_rules(t, [criteria.BLACKLIST])]
    return criteria.emit(docs, rules, ("tender_id", "source_text_lang")).select("tender_id", F.col("source_text_lang").alias("lang"), "field")


@query(f"""select tender_id, 'net_profit' as field, tender_id * 1.0::double as value, 'INR' as unit, 'itr,supporting' as priority, null::double as extraction_confidence, case when tender_id % 2 = 0 then 'given' else 'financial' end as category, 'reply' as origin
  from {{tender_texts}} where tender_id % 3 = 0
  union all select tender_id, field, value, unit, priority, extraction_confidence, category, 'rules' from ({_rules_sql(*_ALL, _NONE)}) where tender_id % 3 <> 0""")
def criteria_backfill(spark, sf):
    docs = V(spark, sf, "tender_texts")
    reply = F.expr("""case when tender_id % 3 = 0 then 'Here: {"criteria": [{"field": "net_profit", "operator": ">=", "unit": "INR", "source_priority": ["itr", "supporting"], "value": ' || tender_id || case when tender_id % 2 = 0 then ', "category": "given"' else '' end || '}]} end'
      when tender_id % 3 = 1 then '{"criteria": []}' else 'none' end""")
    out = criteria.backfill(docs, docs.select("tender_id", reply.alias("reply")))
    return out.select("tender_id", "field", "value", "unit", "priority", "extraction_confidence", "category", "origin")


# Text functions -----------------------------------------------------------------------------------
@query()
def fn_text_chunks(spark, sf):
    """Documents in pieces of at most 4000 characters."""
    return V(spark, sf, "documents").select("doc_id", F.posexplode(T.chunks(F.coalesce("text", F.lit("")))).alias("pos", "piece"))


@query(r"""select id, regexp_replace(regexp_replace(text, '\b[0-9]{2}[A-Z]{5}[0-9]{4}([A-Z][1-9A-Z]Z[0-9A-Z])\b', '[GSTIN:***********\1]', 'g'), '\b[A-Z]{5}[0-9]([0-9]{3}[A-Z])\b', '[PAN:******\1]', 'g') as masked from {identities}""")
def pii_mask_ids(spark, sf):
    return V(spark, sf, "identities").select("id", T.mask_ids(F.col("text")).alias("masked"))


@query()
def pii_mask_aadhaar(spark, sf):
    return V(spark, sf, "identities").select("id", T.mask_aadhaar(F.col("text")).alias("masked"))


@query(f"""select id, number, list_reduce(list_prepend(0, list_transform(range(1, 13), lambda i: cast(substr('{T.VERHOEFF_P}', ((i - 1) % 8) * 10 + cast(substr(number, 13 - i, 1) as int) + 1, 1) as int))),
  lambda c, x: cast(substr('{T.VERHOEFF_D}', c * 10 + x + 1, 1) as int)) = 0 as ok from {{identities}}""")
def fn_verhoeff(spark, sf):
    return V(spark, sf, "identities").select("id", "number", T.verhoeff_ok(F.col("number")).alias("ok"))


@query(r"""select id, '{"PAN":"' || regexp_replace(note, '\b[A-Z]{5}[0-9]([0-9]{3}[A-Z])\b', '[PAN:******\1]', 'g') || '","ref":999999990019,"in":["[PAN:******234F]"]}' as payload from {audit}""")
def audit_redact(spark, sf):
    """JSON payloads with the string values masked; the number under ``ref`` passes the checksum and stays."""
    payload = F.concat(F.lit('{"PAN":"'), "note", F.lit('","ref":999999990019,"in":["ABCPE1234F"]}'))
    return V(spark, sf, "audit").select("id", T.redact_json(payload).alias("payload"))


@query()
def fn_ocr_repair(spark, sf):
    return V(spark, sf, "documents").select("doc_id", T.ocr_repair(F.col("text")).alias("text")).withColumn("sha", F.sha2("text", 256)).drop("text")


@query("select id, 'sha256:' || sha256('{\"id\":\"' || id || '\",\"field\":\"' || field || '\"}') as checksum from {criteria}")
def fn_checksum(spark, sf):
    return V(spark, sf, "criteria").select("id", T.checksum(F.to_json(F.struct("id", "field"))).alias("checksum"))


@query("select id, 'eval:' || left(sha256(cast(tender_id as varchar) || chr(31) || case when tender_id % 2 = 0 then field || chr(31) else '' end), 48) as key from {criteria}")
def fn_stable_key(spark, sf):
    return V(spark, sf, "criteria").select("id", T.stable_key("eval:", F.col("tender_id"), F.when(F.col("tender_id") % 2 == 0, F.col("field"))).alias("key"))


@query("""select o_orderkey as id, case when v >= 1e7 then '₹' || printf('%.2f', v / 1e7) || ' Cr' when v >= 1e5 then '₹' || printf('%.1f', v / 1e5) || ' L' else '₹' || format('{:,}', cast(v as bigint)) end as label
  from (select *, (o_orderkey % 300) * 61731.0::double + 5003 as v from {orders})""")
def fn_fmt_inr(spark, sf):
    v = (F.col("o_orderkey") % 300) * 61731.0 + 5003
    return V(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.format_inr(v).alias("label"))


@query("select l_orderkey, l_linenumber, l_partkey, case when greatest(a, b) = 0 then 0.0 else round(abs(a - b) / greatest(a, b) * 100) end as pct from (select *, floor(l_extendedprice) as a, floor(l_quantity * 1000) as b from {lineitem})")
def fn_discrepancy(spark, sf):
    a, b = F.floor("l_extendedprice").cast("double"), F.floor(F.col("l_quantity") * 1000).cast("double")
    return V(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.discrepancy_percent(a, b).alias("pct"))


@query("select tender_id, bidder_id, criterion_id, case when confidence >= 0.75 then 'high' when confidence >= 0.45 then 'medium' else 'low' end as band from {decisions}")
def fn_conf_band(spark, sf):
    return evaluation.decisions(spark, sf).select("tender_id", "bidder_id", "criterion_id", T.confidence_band(F.col("confidence")).alias("band"))


@query("""select id, case when doc_pos % 6 = 0 then 'supporting' when doc_pos % 6 = 1 then null else doc_type end as doc_type from {bidder_docs}""")
def fn_doc_type(spark, sf):
    raw = F.expr("case when doc_pos % 6 = 0 then '  ' when doc_pos % 6 = 1 then 'passport' else ' ' || upper(doc_type) end")
    return V(spark, sf, "bidder_docs").select("id", T.doc_type(raw).alias("doc_type"))


@query("""select id, case when id % 3 = 0 then 'Tender Created' else action end as label from {audit}""")
def audit_timeline(spark, sf):
    action = F.when(F.col("id") % 3 == 0, F.lit("tender created")).otherwise(F.col("action"))
    return V(spark, sf, "audit").select("id", T.action_label(action).alias("label"))
