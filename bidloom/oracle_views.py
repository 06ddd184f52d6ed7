"""SQL of the evaluation itself, written for the oracle only, as views other queries build on."""

from bidloom.functions import patterns as P


def plain(digits: str) -> str:
    """SQL of a number in Devanagari or ASCII digits, with or without commas."""
    return f"try_cast(replace(translate({digits}, '०१२३४५६७८९', '0123456789'), ',', '') as double)"


def every(pattern: str, group: int) -> str:
    return f"regexp_extract_all(text, '{P.as_sql(pattern)}', {group})"


def signal_test(words: tuple, some: tuple, pattern: str | None, least: int) -> str:
    tests = [f"contains(t, '{w}')" for w in words]
    tests += ["(" + " or ".join(f"contains(t, '{w}')" for w in some) + ")"] if some else []
    tests += [f"regexp_matches(t, '{P.as_sql(pattern)}')"] if pattern else []
    tests += [f"length(t) >= {least}"] if least else []
    return " and ".join(tests)


def signal_case(field: str, at: int) -> str:
    """SQL of a signal's value (at 0) or confidence (at 1) over the lower-cased text ``t``."""
    rules, miss = P.SIGNALS[field]
    cases = " ".join(f"when {signal_test(*r[:4])} then {float(r[4 + at])}::double" for r in rules)
    return f"case {cases} else {miss if at else 0.0}::double end"


def largest(field: str) -> str:
    pattern, _ = P.COUNT_RULES[field]
    return f"list_max(list_transform({every(pattern, 1)}, lambda x: {plain('x')}))"


_MONEY = f"""
  select * exclude (num, unit, text), {plain('num')} * case when lower(unit) = 'crore' then 1e7
      when lower(unit) in ('lakh', 'lac') then 1e5 when lower(unit) = 'million' then 1e6 else 1.0 end as value, 0.9::double as ext_conf
  from (select d.*, 'money' as family, 1 as pass, unnest(range(0, len({every(P.MONEY_ALL, 1)}))) as match_pos, unnest({every(P.MONEY_ALL, 0)}) as raw,
      unnest({every(P.MONEY_ALL, 1)}) as num, unnest({every(P.MONEY_ALL, 2)}) as unit from {{bidder_docs}} d)
  union all
  select * exclude (v, text), case when v < 1e6 then v * 1e7 else v end, 0.75
  from (select d.*, 'money', 2, unnest(range(0, len({every(P.MONEY_TURNOVER, 1)}))), unnest({every(P.MONEY_TURNOVER, 0)}),
      {plain(f"unnest({every(P.MONEY_TURNOVER, 1)})")} as v from {{bidder_docs}} d)"""
_COUNTS = "".join(
    f"""
  union all select d.* exclude (text), '{f}', 1, 0, left(text, 200), {largest(f)}, {P.COUNT_RULES[f][1]} from {{bidder_docs}} d"""
    for f in P.COUNT_FIELDS
)
_SIGNALS = "".join(
    f"""
  union all select d.* exclude (text, t), '{f}', 1, 0, left(text, 200), {signal_case(f, 0)}, {signal_case(f, 1)} from (select *, lower(text) as t from {{bidder_docs}}) d"""
    for f in P.BOOL_FIELDS
)
_IN = lambda fields: "(" + ", ".join(f"'{f}'" for f in fields) + ")"

ORACLE = {
    "facts": f"""
select *, case when quality_score is null or quality_score = 0 then 0.75 else quality_score end as ocr_conf from ({_MONEY}{_COUNTS}{_SIGNALS}
) where value > 0 or family in ('money', 'generic_compliance')""",
    "evidence": """
select f.*, c.id as criterion_id, c.field, c.priority,
  f.ocr_conf * 0.35 + f.ext_conf * 0.3 + (case when list_position(c.types, f.doc_type) is null or list_position(c.types, f.doc_type) = 0 then 0.5
    else 1.0 - (list_position(c.types, f.doc_type) - 1) / len(c.types) * 0.2 end) * 0.2 + 0.15 as conf
from {facts} f join (select *, string_split(case when priority = '' then 'supporting' else priority end, ',') as types from {criteria}) c on c.tender_id = f.tender_id
  and f.family = case when c.field in MONEY then 'money' else c.field end where f.value is not null""",
    "summary": """
select tender_id, bidder_id, criterion_id, count(*) as n, max(value) as top, min(value) as low
from {evidence} group by all""",
    "best": """
select * from {evidence}
qualify row_number() over (partition by tender_id, bidder_id, criterion_id order by conf desc, doc_pos, pass, match_pos) = 1""",
    "presence": """
select d.tender_id, d.bidder_id, c.id as criterion_id, min(d.doc_pos) as first_pos, arg_min(d.doc_type, d.doc_pos) as present_type
from {bidder_docs} d join {criteria} c on c.tender_id = d.tender_id
where c.field in BOOLS and c.priority <> '' and len(list_filter(string_split(c.priority, ','),
  lambda p: contains(lower(d.doc_type), lower(p)) or contains(lower(p), lower(d.doc_type)))) > 0
group by all""",
    "judged": """
select b.tender_id, b.id as bidder_id, c.id as criterion_id, c.field, c.operator, c.value as target, c.priority,
  c.semantic_ambiguity_score as amb, s.n, s.top, s.low, e.conf, e.ocr_conf, e.ext_conf, e.value, e.id as doc_id,
  e.id || '#' || e.pass || '#' || e.match_pos as best_id, left(e.raw, 200) as raw, p.present_type,
  case when c.field not in KNOWN then 'NO_EVIDENCE' when s.n is null and c.field in BOOLS and c.priority <> '' then
      case when p.present_type is not null then 'DOC_PRESENT' else 'DOC_MISSING' end
    when s.n is null then 'NO_EVIDENCE'
    when s.n >= 2 and case when s.top > 0 then (s.top - s.low) / s.top > 0.05 else abs(s.top - s.low) > 1 end then 'CONFLICT_DETECTED'
    when e.ocr_conf < 0.5 then 'LOW_OCR_CONFIDENCE'
    when e.conf < 0.6 or c.semantic_ambiguity_score > 0.55 then 'LOW_CONFIDENCE'
    when case c.operator when '>=' then e.value >= c.value when '<=' then e.value <= c.value when '==' then abs(e.value - c.value) < 1e-6
      when '!=' then abs(e.value - c.value) >= 1e-6 else false end then 'MATCH'
    else 'REQUIREMENT_NOT_MET' end as reason
from {bidders} b join {criteria} c on c.tender_id = b.tender_id
left join {summary} s on s.tender_id = b.tender_id and s.bidder_id = b.id and s.criterion_id = c.id
left join {best} e on e.tender_id = b.tender_id and e.bidder_id = b.id and e.criterion_id = c.id
left join {presence} p on p.tender_id = b.tender_id and p.bidder_id = b.id and p.criterion_id = c.id""",
    "decisions": """
select tender_id, bidder_id, criterion_id, field,
  case when reason in ('MATCH', 'DOC_PRESENT') then 'ELIGIBLE' when reason in ('REQUIREMENT_NOT_MET', 'DOC_MISSING') then 'NOT_ELIGIBLE'
    else 'NEEDS_REVIEW' end as verdict, reason,
  round(case when reason in ('DOC_PRESENT', 'DOC_MISSING') then 0.7 when reason = 'CONFLICT_DETECTED' then 0.51
    when reason = 'LOW_OCR_CONFIDENCE' then ocr_conf when reason = 'LOW_CONFIDENCE' then conf
    when reason = 'NO_EVIDENCE' then 0.0 else greatest(conf, 0.7) end, 6) as confidence
from {judged}""",
    "reasoned": """
select j.tender_id, j.bidder_id, j.criterion_id, j.reason, case when j.field not in KNOWN then 'Unknown field with no documents matching expected types.'
    when j.reason = 'DOC_MISSING' then 'No document of type matching ' || w || ' provided by bidder.'
    when j.reason = 'DOC_PRESENT' then 'Document of type ' || chr(39) || present_type || chr(39) || ' satisfies presence requirement (expected one of ' || w || ').'
    when j.reason = 'NO_EVIDENCE' then 'No evidence extracted for this criterion.'
    when j.reason = 'CONFLICT_DETECTED' then 'Conflicting ' || j.field || ' values detected across documents: ' || vals || '. Cannot auto-decide — requires officer verification.'
    when j.reason = 'LOW_OCR_CONFIDENCE' then 'OCR confidence below threshold.'
    when j.reason = 'LOW_CONFIDENCE' then j.operator || ' ' || cast(j.target as varchar) || '; extracted ' || cast(j.value as varchar) || ' but confidence/ambiguity requires review.'
    else j.field || ' requires ' || j.operator || ' ' || cast(j.target as varchar) || '. Extracted ' || cast(j.value as varchar) || ' from ' || j.doc_id || '.' end as reasoning,
  case when j.reason = 'CONFLICT_DETECTED' then first_id when j.reason in ('MATCH', 'REQUIREMENT_NOT_MET', 'LOW_CONFIDENCE', 'LOW_OCR_CONFIDENCE') then j.best_id end as evidence_used,
  case when j.reason = 'CONFLICT_DETECTED' then snaps end as snapshots,
  case when j.reason in ('DOC_PRESENT', 'DOC_MISSING') then 'deterministic_doc_presence' else 'deterministic' end as mode,
  case when j.reason in ('MATCH', 'REQUIREMENT_NOT_MET') then j.value end as extracted, case when j.reason in ('MATCH', 'REQUIREMENT_NOT_MET') then j.doc_id end as document
from (select *, '[' || array_to_string(list_transform(string_split(priority, ','), lambda p: chr(39) || p || chr(39)), ', ') || ']' as w from {judged}) j left join (
  select tender_id, bidder_id, criterion_id, string_agg(case when value >= 1e7 then '₹' || printf('%.2f', value / 1e7) || ' Cr' when value >= 1e5 then '₹' || printf('%.1f', value / 1e5) || ' L'
      else '₹' || format('{:,}', cast(value as bigint)) end, ' vs ' order by k) filter (where k <= 3) as vals,
    string_agg(id || '|' || doc_type || '|' || left(raw, 200), ';' order by k) as snaps, max(case when k = 1 then id || '#' || pass || '#' || match_pos end) as first_id
  from (select *, row_number() over (partition by tender_id, bidder_id, criterion_id order by doc_pos, pass, match_pos) as k from {evidence}) where k <= 4 group by all) s
  using (tender_id, bidder_id, criterion_id)""",
    "scoreboard": """
select b.id as bidder_id, b.tender_id, b.name, count_if(d.verdict = 'ELIGIBLE') as eligible,
  count_if(d.verdict = 'NOT_ELIGIBLE') as not_eligible, count_if(d.verdict = 'NEEDS_REVIEW') as needs_review,
  count_if(d.reason = 'CONFLICT_DETECTED') as conflicts, count(d.verdict) as total
from {bidders} b left join {decisions} d on d.bidder_id = b.id and d.tender_id = b.tender_id group by all""",
}
ORACLE = {
    k: v.replace("in MONEY", f"in {_IN(P.MONEY_FIELDS)}").replace("in BOOLS", f"in {_IN(P.BOOL_FIELDS)}")
    .replace("in KNOWN", f"in {_IN(P.MONEY_FIELDS + P.COUNT_FIELDS + P.BOOL_FIELDS)}")
    for k, v in ORACLE.items()
}


def _wide(sql: str) -> str:
    for k in [*ORACLE, "bidder_docs", "criteria"]:
        sql = sql.replace("{%s}" % k, "{%s}" % {"bidder_docs": "signal_docs", "criteria": "wide_criteria"}.get(k, f"{k}_wide"))
    return sql


#: The same over rules of all fields and operators, and documents with signals for them.
ORACLE |= {f"{k}_wide": _wide(v) for k, v in ORACLE.items()}
