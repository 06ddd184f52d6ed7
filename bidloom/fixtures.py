"""Views of tender data over the star-schema tables, as SQL that Spark and DuckDB both run.

``{name}`` stands for a parquet table or another view.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS = {
    "officers": """
select c_custkey as id, c_name as name,
  case when c_custkey % 50 = 0 then 'admin' else 'officer' end as role
from {customer}""",
    "tenders": """
select o_orderkey as id, 'Tender ' || cast(o_orderkey as string) as title, o_custkey as owner_id,
  case o_orderstatus when 'O' then 'open' when 'F' then 'closed' else 'draft' end as status,
  o_orderdate as created_at
from {orders}""",
    "bidders": """
select distinct cast(l_orderkey as string) || '-' || cast(l_suppkey as string) as id,
  l_orderkey as tender_id, s_name as name
from {lineitem} join {supplier} on l_suppkey = s_suppkey""",
    "bidder_docs": """
select cast(l_orderkey as string) || '-' || cast(l_suppkey as string) || '-' || cast(l_linenumber as string)
    || '-' || cast(l_partkey as string) as id,
  cast(l_orderkey as string) || '-' || cast(l_suppkey as string) as bidder_id,
  l_orderkey as tender_id,
  l_linenumber * 1000000 + l_partkey as doc_pos,
  case l_partkey % 5 when 0 then 'ca_certificate' when 1 then 'audited_balance_sheet'
    when 2 then 'gst_certificate' when 3 then 'work_order' else 'supporting' end as doc_type,
  round(1.0 - l_discount * 6.0, 2) as quality_score,
  l_shipdate as created_at,
  translate('Annual turnover: Rs. ' || cast(cast(floor(l_extendedprice / 100.0) as bigint) as string) || ' Lakh.'
    || case when l_partkey % 3 = 0 then ' GST registration is valid.' else '' end
    || case when l_returnflag = 'R' then ' ISO 9001 certified.' else '' end
    || case when l_returnflag = 'A' then ' We are not blacklisted.' else '' end
    || case when l_partkey % 4 <> 0 then ' Completed ' || cast(cast(l_quantity as bigint) as string) || ' similar projects.' else '' end,
    '0123456789', case when l_partkey % 13 = 5 then '०१२३४५६७८९' else '0123456789' end) as text
from {lineitem}""",
    "signal_docs": """
select id, bidder_id, tender_id, doc_pos, doc_type, quality_score, created_at, text
    || case doc_pos % 7 when 0 then ' NABL lab, ISO-14001 and ISO 27001.' when 1 then ' GSTIN 22ABCDE1234F1Z5 of the firm.' when 2 then ' Goods and services tax is paid.' when 3 then ' An undertaking of compliance follows, and certificates are enclosed with it.' else '' end
    || case doc_pos % 5 when 0 then ' Registered company with Udyam number.' when 1 then ' PAN ABCDE1234F.' when 2 then ' The firm was debarred.' when 3 then ' TDS with TAN ABCD12345E.' else '' end
    || case doc_pos % 6 when 0 then ' We have 12+ years and 9 years.' when 1 then ' 34 technical staff, 40 engineers.' when 2 then ' 250 full-time employees.' when 3 then ' Valid for 120 days.' when 4 then ' 7 yrs, 15 works, 80 personnel.' else '' end as text
from {bidder_docs}""",
    "criteria": """
select cast(t.id as string) || '-' || k.field as id, t.id as tender_id, k.field, k.operator,
  cast(case when k.field = 'annual_turnover' then 1000000.0 * (1 + t.id % 50)
       when k.field = 'similar_projects_count' then 1.0 * (t.id % 40) else 1.0 end as double) as value,
  k.priority,
  cast(case when t.id % 11 = 0 then 0.6 else 0.1 end as double) as semantic_ambiguity_score,
  case t.id % 3 when 0 then '' when 1 then 'Requirement of the notice on ' || k.field
    else repeat('The bidder shall show this in the documents of its offer. ', 3) || k.field end as text_raw
from (select o_orderkey as id from {orders}) t
cross join (values ('annual_turnover', '>=', 'audited_balance_sheet,ca_certificate'),
  ('similar_projects_count', '>=', 'work_order,supporting'),
  ('gst_registration', '==', 'gst_certificate'),
  ('iso_9001', '==', 'iso_certificate,supporting')) as k(field, operator, priority)""",
    "wide_criteria": """
select id, tender_id, field, case when v.op = '' then operator else v.op end as operator, case when v.target < 0 then value else v.target end as value,
  case when tender_id % 6 = 5 and field = 'similar_projects_count' then '' else priority end as priority, semantic_ambiguity_score, text_raw from (
  select c.id, c.tender_id, c.operator, c.value, c.priority, c.semantic_ambiguity_score, c.text_raw, case c.field
    when 'annual_turnover' then case c.tender_id % 7 when 2 then 'turnover' when 3 then 'net_worth' when 4 then 'emd_amount' when 5 then 'bank_guarantee' else 'annual_turnover' end
    when 'similar_projects_count' then case c.tender_id % 7 when 1 then 'years_of_experience' when 2 then 'experience_years' when 4 then 'bid_validity_days' when 5 then 'manpower_count' when 6 then 'technical_staff_count' else 'similar_projects_count' end
    when 'gst_registration' then case c.tender_id % 7 when 1 then 'pan_registration' when 2 then 'blacklisting_declaration' when 3 then 'generic_compliance' when 4 then 'registered_firm' when 5 then 'msme_preference' when 6 then 'tds_registration' else 'gst_registration' end
    else case c.tender_id % 7 when 2 then 'iso_14001' when 3 then 'nabl_accreditation' when 4 then 'iso_27001' when 5 then 'msme_registration' when 6 then 'local_content' else 'iso_9001' end end as field
  from {criteria} c) x
join (values (0, '', -1.0), (1, '<=', -1.0), (2, '!=', -1.0), (3, '~', -1.0), (4, '', -1.0), (5, '>=', 12.0)) as v(k, op, target) on v.k = x.tender_id % 6""",
    "http_log": """
select event_id as id, ts, user_id, event_type as path,
  case when event_type = 'error' then 500 else 200 end as status, value as latency_ms
from {events}""",
    "jobs": """
select cast(event_id as string) as id, user_id as tender_id,
  case event_type when 'signup' then 'queued' when 'view' then 'running' when 'click' then 'completed'
    when 'error' then 'failed' else 'interrupted' end as status,
  ts as created_at
from {events}""",
    "graphs": """
select event_id as id, user_id as tender_id, ts as updated_at,
  '{"nodes":[' || cast(event_id % 9 as string) || '],"edges":[]}' as graph
from {events} where event_type = 'click'""",
    "tender_texts": """
select o_orderkey as tender_id,
  case when o_orderkey % 13 = 0 then '' else translate(
  case when o_orderkey % 97 = 5 then 'Annual turnover of Rs.' || repeat(' ', 2100) || '5 crore. ' when o_orderkey % 31 = 4 then 'EMD of Rs. 500
in cash. ' else '' end || 'Eligibility: annual turnover of at least Rs. ' || cast(1 + o_orderkey % 90 as string)
    || case o_orderkey % 4 when 0 then ' crore' when 1 then ' lakh' when 2 then ',50,000' else ' million' end || '.'
    || case when o_orderkey % 2 = 0 then ' Positive net worth.' when o_orderkey % 5 = 1 then ' Net worth of INR ' || cast(o_orderkey % 70 as string) || ' lakh.' else '' end
    || case when o_orderkey % 3 = 0 then ' EMD of Rs. ' || cast(1000 + o_orderkey % 900 as string) || '.' when o_orderkey % 3 = 1 then ' Bid security shall apply.' else '' end
    || case when o_orderkey % 5 = 0 then ' Bank guarantee of Rs 2 lakh.' when o_orderkey % 5 = 2 then ' Performance guarantee needed.' else '' end
    || case when o_orderkey % 7 < 3 then ' Minimum ' || cast(1 + o_orderkey % 15 as string) || ' years of experience.' when o_orderkey % 7 = 4 then ' Past performance counts.' else '' end
    || case when o_orderkey % 6 < 4 then ' Completed ' || cast(o_orderkey % 60 as string) || ' similar projects.' else '' end
    || case when o_orderkey % 8 = 1 then ' At least ' || cast(o_orderkey % 200 as string) || ' employees.' when o_orderkey % 8 = 2 then ' At least 12 full-time engineers.' else '' end
    || case when o_orderkey % 9 < 2 then ' ISO-9001 and ISO 14001 needed.' when o_orderkey % 9 = 3 then ' iso27001 and NABL lab.' else '' end
    || case when o_orderkey % 4 < 2 then ' GST and PAN mandatory.' else '' end
    || case when o_orderkey % 10 = 3 then ' TDS deducted.' when o_orderkey % 10 = 4 then ' MSME or Udyam firms preferred.' else '' end
    || case when o_orderkey % 6 = 1 then ' Bid validity: ' || cast(30 + o_orderkey % 150 as string) || ' days.' when o_orderkey % 6 = 2 then ' Validity of bid is 90 days.' else '' end
    || case when o_orderkey % 5 = 3 then ' Bidder must not be blacklisted.' else '' end
    || case when o_orderkey % 12 = 5 then ' निविदा शर्तें लागू होंगी।' when o_orderkey % 12 = 7 then ' निविदा की सभी शर्तें सामान्य नियमों के अनुसार लागू होंगी और बोलीदाता को अनुभव प्रमाण पत्र जमा करना होगा तथा सभी दस्तावेज समय पर देने होंगे। कार्य पूरा करने की अवधि और भुगतान की शर्तें अनुबंध में दी गई हैं और सभी पक्षों को मान्य होंगी।' else '' end
, '0123456789', case when o_orderkey % 17 = 3 then '०१२३४५६७८९' else '0123456789' end) end as text
from {orders}""",
    "files": """
select p_partkey as file_id, '/uploads/' || case when p_partkey % 17 = 0 then 'a..b' else 'Doc' || cast(p_partkey as string) end
    || case p_partkey % 9 when 0 then '.pdf' when 1 then '.PNG' when 2 then '.jpg' when 3 then '.jpeg' when 4 then '.tif'
       when 5 then '.TIFF' when 6 then '.docx' when 7 then '.bmp' else '' end as path,
  cast(p_size as bigint) * 1500000 as size
from {part}""",
    "criteria_rows": """
select c.id, c.tender_id,
  case when c.tender_id % 19 = 0 and c.field = 'iso_9001' then '{"field": "iso_9001", '
  else '{"id": "old-' || cast(c.tender_id as string) || '", "field": "' || c.field || '", "operator": "' || c.operator
    || '", "value": ' || cast(cast(c.value as bigint) as string) || case when c.tender_id % 3 = 0 then 'e0' else '' end || '}' end as payload
from {criteria} c""",
    "identities": """
select c_custkey as id, 'PAN ' || 'ABCPE' || lpad(cast(c_custkey % 10000 as string), 4, '0') || 'F'
    || case when c_custkey % 2 = 0 then ' GSTIN ' || lpad(cast(1 + c_custkey % 37 as string), 2, '0') || 'ABCDE' || lpad(cast(c_custkey % 10000 as string), 4, '0') || 'F1Z5' else '' end
    || case when c_custkey % 3 = 0 then ' Aadhaar ' || '9999 9999 ' || lpad(cast(c_custkey % 10000 as string), 4, '0') else '' end
    || case when c_custkey % 7 = 0 then ' ref XABCPE1234FZ' else '' end || ' of ' || c_name as text,
  lpad(cast(999999990000 + (c_custkey * 7919) % 100000 as string), 12, '0') as number
from {customer}""",
    "audit": """
select event_id as id, case when event_type = 'view' then cast(null as bigint) else user_id end as tender_id,
  user_id % 500 as user_id,
  case event_type when 'signup' then 'tender.created' when 'view' then 'document.uploaded' when 'click' then 'bidder.registered'
    when 'error' then 'reviewer.override' else 'evaluation.completed' end as action,
  'PAN ABCPE' || lpad(cast(event_id % 10000 as string), 4, '0') || 'F note ' || cast(event_id as string) as note,
  ts as created_at
from {events}""",
    "ocr_tokens": """
select l_orderkey as doc_id, l_linenumber % 3 as page, l_linenumber as pos, 'w' || cast(l_partkey as string) as token,
  case when l_partkey % 10 = 0 then -1.0 else round(l_discount * 9.0, 2) end as confidence,
  cast(l_quantity as bigint) as x, cast(l_partkey % 97 as bigint) as y
from {lineitem}""",
    "overrides": """
select b.tender_id, b.id as bidder_id, cast(b.tender_id as string) || '-annual_turnover' as criterion_id,
  case when b.tender_id % 4 = 0 then 'NOT_ELIGIBLE' when b.tender_id % 4 = 1 then 'MAYBE' else 'ELIGIBLE' end as verdict,
  case when b.tender_id % 9 = 0 then 'too short' else 'Figures were checked against the signed original, PAN ABCPE1234F.' end as justification,
  b.tender_id % 77 as officer_id, b.tender_id * 10 + v.k as version
from {bidders} b cross join (values (1), (2)) as v(k) where b.tender_id % 5 = 0""",
}


#: Views whose rows belong to a tender, and the column that names it in the table they read.
TENDER_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
OF_TENDERS = ("bidder_docs", "bidders", "criteria", "tender_texts")
#: Lines that a part holds at most on average: each gives several rows of pairs, which a task should sort in memory.
LINES_OF_A_PART = 50_000


@cache
def lines(spark: SparkSession, sf_dir: str) -> int:
    """Lines of the tables, as the footers of their files tell."""
    return view(spark, sf_dir, "lineitem").count()


def by_tender(name: str, df: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a table dealt out by tender while they are narrow, before texts and rules are made of them.

    How many parts a file is read in says nothing about where its rows are, as a row group is read by one
    task.  What joins or groups by tender later finds the rows of a tender together.  All tables have as many
    parts, the session's number and more where the lines are many.
    """
    if name not in TENDER_KEYS:
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-lines(df.sparkSession, sf_dir) // LINES_OF_A_PART)), TENDER_KEYS[name])


def needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame; timestamps get the session's time zone type."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    made = {n: view(spark, sf_dir, n) for n in needs(sql)}
    if name in OF_TENDERS:
        made = {n: by_tender(n, df, sf_dir) for n, df in made.items()}
    for n in made:
        sql = sql.replace("{%s}" % n, f"__{n}__")
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in made:
        sql = sql.replace(f"__{n}__", "{%s}" % n)
    return spark.sql(sql, **made)


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """An oracle query: the views it names, and theirs, as common table expressions before it."""
    known = VIEWS | (extra or {})
    order: list[str] = []

    def visit(text: str) -> None:
        for n in needs(text):
            if n in known and n not in order:
                visit(known[n])
                order.append(n)

    visit(sql)
    plain = lambda text: re.sub(r"\{([a-z]\w*)\}", r"\1", text)
    parts = [f"{n} as ({plain(known[n])})" for n in order]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + plain(sql)
