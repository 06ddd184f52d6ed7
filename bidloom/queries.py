"""Registered queries over the tender views, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.fixtures import view, with_views
from bidloom.functions import patterns as P
from bidloom.functions import text as T
from bidloom.operators import changes, criteria, decide, evidence, rollups
from bidloom.oracle_views import ORACLE, largest, signal_case
from bidloom.plans import evaluation
from bidloom.sources import files
from bidloom.sources.shared import Workspace

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: with_views(q, ORACLE) for k, q in SQL.items()}


V = view


# Sources and sinks -----------------------------------------------------------------------------
@query(r"""select file_id, path, size, reject_reason, reject_reason is null as admitted from (select *,
  case when lower(regexp_extract(path, '(\.[^./]+)$', 1)) not in ('.pdf', '.png', '.jpg', '.jpeg', '.tif', '.tiff') then 'bad_extension'
    when contains(regexp_extract(path, '([^/]*)$', 1), '..') then 'bad_name' when size > 52428800 then 'too_large' end as reject_reason
  from {files})""")
def src_upload_admission(spark, sf):
    return files.admit(V(spark, sf, "files"))


@query(r"""select file_id, path, case when lower(regexp_extract(path, '(\.[^./]+)$', 1)) = '.pdf' then 'pdf'
  when lower(regexp_extract(path, '(\.[^./]+)$', 1)) in ('.png', '.jpg', '.jpeg', '.tif', '.tiff', '.bmp', '.webp') then 'image'
  else 'none' end as engine from {files}""")
def src_engine_dispatch(spark, sf):
    return V(spark, sf, "files").select("file_id", "path", files.engine(F.col("path")).alias("engine"))


@query("""select id, tender_id, json_extract_string(payload, '$.field') as field, json_extract_string(payload, '$.operator') as operator,
  cast(json_extract_string(payload, '$.value') as double) as value from {criteria_rows} where json_valid(payload)""")
def scan_criteria(spark, sf):
    return files.read_criteria(V(spark, sf, "criteria_rows"))


@query("select tender_id, id as bidder_id from {bidders} where tender_id in (select id from {tenders} where status = 'open')")
def scan_bidders(spark, sf):
    """Bidder ids of the tenders that are open."""
    open_ = V(spark, sf, "tenders").filter("status = 'open'").select(F.col("id").alias("tender_id"))
    return V(spark, sf, "bidders").join(open_, "tender_id", "left_semi").select("tender_id", F.col("id").alias("bidder_id"))


@query("""select id, bidder_id, doc_type, quality_score, text from
  (select *, case when doc_pos % 11 = 0 then null else doc_type end as kind from {bidder_docs}) where kind is not null""")
def scan_bidder_docs(spark, sf):
    docs = V(spark, sf, "bidder_docs").withColumn("kind", F.expr("case when doc_pos % 11 = 0 then null else doc_type end"))
    ocr = F.from_json(F.to_json(F.struct("quality_score", "text")), "struct<quality_score: double, text: string>")
    return docs.dropna(subset=["kind"]).withColumn("ocr", ocr).select("id", "bidder_id", "doc_type", "ocr.quality_score", "ocr.text")


@query("""select cast(tender_id as varchar) as tender_id, 4 as n_criteria, 0 as bidder_pos, bidder_id, (row_number() over (partition by tender_id, bidder_id order by doc_pos, id) - 1)::int as doc_pos,
  id as doc_id, doc_type, quality_score, text from {bidder_docs}""")
def src_eval_payload(spark, sf):
    """Evaluation payloads as JSON text, one line for each bidder of a tender, read back to documents."""
    docs = V(spark, sf, "bidder_docs").groupBy("tender_id", "bidder_id").agg(
        F.sort_array(F.collect_list(F.struct("doc_pos", "id", "doc_type", F.struct("quality_score", "text").alias("ocr")))).alias("documents")
    )
    bidders = docs.select("tender_id", F.array(F.struct("bidder_id", "documents")).alias("bidders"))
    rules = V(spark, sf, "criteria").groupBy("tender_id").agg(F.sort_array(F.collect_list(F.struct("id", "field", "operator", "value"))).alias("criteria"))
    made = bidders.join(rules, "tender_id").select(F.to_json(F.struct(F.col("tender_id").cast("string").alias("tender_id"), "criteria", "bidders")).alias("payload"))
    return files.read_payloads(made)


_UPS = """select tender_id, bidder_id, criterion_id, verdict, 1 as version from {decisions} union all
  select tender_id, bidder_id, criterion_id, verdict, version from {overrides}"""


@query("select tender_id, bidder_id, criterion_id, arg_max(verdict, version) as verdict, max(version) as version from (" + _UPS + ") group by all")
def sink_decision_upsert(spark, sf):
    old = evaluation.decisions(spark, sf).select("tender_id", "bidder_id", "criterion_id", "verdict", F.lit(1).cast("long").alias("version"))
    new = V(spark, sf, "overrides").select(old.columns)
    return changes.upsert(old, new, ["tender_id", "bidder_id", "criterion_id"], "version").select(old.columns)


@query("""select tender_id, id, 'old' as origin from {bidders} where tender_id not in (select id from {tenders} where status = 'open')
  union all select tender_id, id, 'new' from {bidders} where tender_id in (select id from {tenders} where status = 'open')""")
def sink_replace_tender(spark, sf):
    open_ = V(spark, sf, "tenders").filter("status = 'open'").select(F.col("id").alias("tender_id"))
    b = V(spark, sf, "bidders").select("tender_id", "id")
    return changes.replace_group(b.withColumn("origin", F.lit("old")), b.join(open_, "tender_id").withColumn("origin", F.lit("new")), "tender_id")


@query("select tender_id, bidder_id, criterion_id, reason, confidence, 'open' as status from {decisions} where verdict = 'NEEDS_REVIEW'")
def sink_review_items(spark, sf):
    return review_items(spark, sf).withColumn("status", F.lit("open"))


_MASK = r"regexp_replace(note, '\b[A-Z]{5}[0-9]([0-9]{3}[A-Z])\b', '[PAN:******\1]', 'g')"


@query(f"""select id, cast(tender_id as varchar) as tender_id, user_id, action, payload, 'sha256:' || sha256(payload) as checksum, created_at from (select *,
  '{{"action":"' || action || '","note":"' || {_MASK.replace("{5}", "{{5}}").replace("{3}", "{{3}}")} || '"}}' as payload from {{audit}})""".replace("{{5}}", "{5}").replace("{{3}}", "{3}"))
def audit_append(spark, sf):
    """Entries whose tender is an empty text or a number; the empty one is stored as null."""
    blank = F.coalesce(F.col("tender_id").cast("string"), F.lit(""))
    return changes.audit_rows(V(spark, sf, "audit").withColumn("tender_id", blank))


@query("""select file_id, 's3:tenders:documents/' || file_id || '/' || regexp_extract(path, '([^/]*)$', 1) as ref, 'tenders' as bucket,
  'documents/' || file_id || '/' || regexp_extract(path, '([^/]*)$', 1) as key from {files}""")
def fn_object_ref(spark, sf):
    key = F.concat(F.lit("documents/"), F.col("file_id").cast("string"), F.lit("/"), F.regexp_extract("path", "([^/]*)$", 1))
    out = V(spark, sf, "files").select("file_id", files.object_ref(F.lit("tenders"), key).alias("ref"))
    return out.select("file_id", "ref", files.split_ref(F.col("ref"))["bucket"].alias("bucket"), files.split_ref(F.col("ref"))["key"].alias("key"))


@query("""select id, tender_id, field, case when tender_id % 3 = 0 then '<=' else operator end as operator,
  case when tender_id % 6 = 0 then value + 2 when tender_id % 9 = 0 then value + 1 else value end as value, case when tender_id % 12 = 0 then null else text_raw end as text_raw from {criteria}""")
def criteria_patch(spark, sf):
    """Patches of different columns of the same rows: an operator, then a value, then a text that is taken away."""
    base = V(spark, sf, "criteria").select("id", "tender_id", "field", "operator", "value", "text_raw")

    def made(every: int, version: int, **columns) -> DataFrame:
        all_ = {"operator": F.lit(None).cast("string"), "value": F.lit(None).cast("double"), "text_raw": F.lit(None).cast("string")} | columns
        named = F.array(*map(F.lit, columns)).alias("named")
        return base.filter(F.col("tender_id") % every == 0).select("id", *[c.alias(k) for k, c in all_.items()], F.lit(version).alias("version"), named)

    patches = made(3, 1, operator=F.lit("<=")).unionByName(made(9, 2, value=F.col("value") + 1)).unionByName(made(6, 3, value=F.col("value") + 2))
    patches = patches.unionByName(made(12, 4, text_raw=F.lit(None).cast("string")))
    return changes.patch(base, patches, "id", "version", ["operator", "value", "text_raw"], named="named")


@query("""select id, case when tender_id % 6 = 0 then '{"note":"two","unit":"INR","weight":"1"}' when tender_id % 3 = 0 then '{"note":"one","unit":"INR"}' else '{"unit":"INR"}' end as extras from {criteria}""")
def criteria_patch_extras(spark, sf):
    """Further keys of criteria, patched twice: keys that a patch does not name stay."""
    c = V(spark, sf, "criteria").select("id", "tender_id")
    note = lambda text: (F.lit("note"), F.lit(text))
    first = c.filter("tender_id % 3 = 0").select("id", F.lit(1).alias("version"), F.create_map(*note("one")).alias("extras"))
    second = c.filter("tender_id % 6 = 0").select("id", F.lit(2).alias("version"), F.create_map(*note("two"), F.lit("weight"), F.lit("1")).alias("extras"))
    base = c.select("id", F.create_map(F.lit("unit"), F.lit("INR")).alias("extras"))
    return changes.patch_extras(base, first.unionByName(second), "id", "version", "extras").select("id", F.to_json("extras").alias("extras"))


@query("select id, tender_id, field from {criteria} where tender_id not in (select id from {tenders} where status = 'closed')")
def criteria_delete(spark, sf):
    """Criteria that are left when those of closed tenders are deleted by their ids."""
    rows = V(spark, sf, "criteria").select("id", "tender_id", "field")
    return rows.join(_of_closed(spark, sf, rows).select("id"), "id", "left_anti").select("id", "tender_id", "field")


def _of_closed(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    closed = V(spark, sf, "tenders").filter("status = 'closed'").select(F.col("id").alias("tender_id"))
    return rows.join(closed, "tender_id", "left_semi")


@query("""select 'new-' || id as id, tender_id, field, case when c <= 0 or c > 1 then 1 else c end as confidence, tender_id in (select id from {tenders} where status <> 'closed') as accepted from
  (select *, cast(tender_id % 5 as double) / 3 as c from {criteria})""")
def criteria_manual(spark, sf):
    """Rules that officers enter, of which closed tenders have every one already."""
    stored = V(spark, sf, "criteria").select("id", "tender_id", "field", "operator", F.col("value").cast("string").alias("value"))
    batch = stored.withColumn("id", F.concat(F.lit("new-"), "id")).withColumn("confidence", F.col("tender_id") % 5 / F.lit(3.0))
    out = changes.manual_criteria(batch, _of_closed(spark, sf, stored))
    return out.select("id", "tender_id", "field", "confidence", "accepted")


# Listings and lookups ----------------------------------------------------------------------------
@query("""select owner_id, id, title, status, r as rank, n as total from (select *, row_number() over (partition by owner_id order by created_at desc, id) as r,
  count(*) over (partition by owner_id) as n from {tenders}) where r <= 10""")
def list_tenders(spark, sf):
    out = changes.page(V(spark, sf, "tenders"), "owner_id", [F.desc("created_at"), "id"], 10)
    return out.select("owner_id", "id", "title", "status", "rank", "total")


@query("""select id, title, owner_id, status, (select count(*) from {tenders}) as total from {tenders} order by created_at desc, id limit 50 offset 100""")
def list_all_tenders(spark, sf):
    """The third page of all tenders, newest first, as an admin sees them: each page starts after the last row of the one before."""
    order, after = [("created_at", True), ("id", False)], None
    tenders = V(spark, sf, "tenders")
    for _ in range(2):
        last = changes.keyset_page(tenders, order, after).collect()[-1:]
        after = (last[0].created_at, last[0].id) if last else after
    return changes.keyset_page(tenders, order, after).select("id", "title", "owner_id", "status", "total")


@query("""select t.id, t.title, t.status, count(c.id) as n_criteria, coalesce(string_agg(c.field, ',' order by c.field), '') as fields
  from {tenders} t left join {criteria} c on c.tender_id = t.id group by all""")
def tender_detail(spark, sf):
    own = V(spark, sf, "criteria").groupBy(F.col("tender_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("field", "operator", "value"))).alias("c"))
    out = V(spark, sf, "tenders").join(own, "id", "left")
    return out.select("id", "title", "status", F.coalesce(F.size("c"), F.lit(0)).cast("long").alias("n_criteria"),
                      F.coalesce(F.array_join("c.field", ","), F.lit("")).alias("fields"))


@query("""select tender_id, id, name, r as rank, n as total from (select *, row_number() over (partition by tender_id order by name, id) as r,
  count(*) over (partition by tender_id) as n from {bidders}) where r <= 50""")
def list_bidders(spark, sf):
    return changes.page(V(spark, sf, "bidders"), "tender_id", ["name", "id"]).select("tender_id", "id", "name", "rank", "total")


@query("""select bidder_id, id, coalesce(kind, 'supporting') as doc_type, r as rank from (select *, row_number() over (partition by bidder_id
  order by kind nulls last, created_at desc, id) as r from (select *, case when doc_pos % 4 = 0 then null else doc_type end as kind from {bidder_docs})) where r <= 50""")
def list_bidder_docs(spark, sf):
    docs = V(spark, sf, "bidder_docs").withColumn("kind", F.expr("case when doc_pos % 4 = 0 then null else doc_type end"))
    out = changes.page(docs, "bidder_id", [F.asc_nulls_last("kind"), F.desc("created_at"), "id"], total=False)
    return out.select("bidder_id", "id", F.coalesce("kind", F.lit("supporting")).alias("doc_type"), "rank")


@query("""select owner_id, id, r as rank, n as total from (select *, row_number() over (partition by owner_id order by id) as r,
  count(*) over (partition by owner_id) as n from {tenders}) where r > 5 and r <= 8""")
def paginate(spark, sf):
    return changes.page(V(spark, sf, "tenders"), "owner_id", ["id"], 3, 5).select("owner_id", "id", "rank", "total")


@query("""select t.id as tender_id, coalesce(d.n, 0) as decisions, case when d.n > 0 then 'complete' when j.status is not null then j.status else 'none' end as state, g.graph
  from {tenders} t left join (select tender_id, count(*) as n from {decisions} group by 1) d on d.tender_id = t.id
  left join (select tender_id, arg_max(status, id::bigint) as status from {jobs} group by 1) j on j.tender_id = t.id
  left join (select tender_id, arg_max(graph, (updated_at, id)) as graph from {graphs} group by 1) g on g.tender_id = t.id""")
def results_state(spark, sf):
    n = evaluation.decisions(spark, sf).groupBy("tender_id").agg(F.count("*").alias("n"))
    last = V(spark, sf, "jobs").groupBy("tender_id").agg(F.max_by("status", F.col("id").cast("long")).alias("s"))
    graph = V(spark, sf, "graphs").groupBy("tender_id").agg(F.max_by("graph", F.struct("updated_at", "id")).alias("graph"))
    out = V(spark, sf, "tenders").select(F.col("id").alias("tender_id")).join(n, "tender_id", "left")
    out = out.join(last, "tender_id", "left").join(graph, "tender_id", "left")
    return out.select("tender_id", "graph", F.coalesce("n", F.lit(0)).alias("decisions"),
                      F.when(F.col("n") > 0, "complete").otherwise(F.coalesce("s", F.lit("none"))).alias("state"))


@query("""select bidder_id, criterion_id, verdict, r as rank from (select *, row_number() over (partition by bidder_id order by criterion_id) as r
  from {decisions}) where r <= 3""")
def bidder_breakdown(spark, sf):
    return changes.page(evaluation.decisions(spark, sf), "bidder_id", ["criterion_id"], 3, total=False).select("bidder_id", "criterion_id", "verdict", "rank")


@query("select d.* from {decisions} d where d.criterion_id = cast(d.tender_id as varchar) || '-iso_9001'")
def decision_evidence(spark, sf):
    """Decisions at the keys another relation names (here one per bidder)."""
    keys = V(spark, sf, "bidders").select("tender_id", F.col("id").alias("bidder_id"), F.concat(F.col("tender_id").cast("string"), F.lit("-iso_9001")).alias("criterion_id"))
    return evaluation.decisions(spark, sf).join(keys, ["tender_id", "bidder_id", "criterion_id"], "left_semi")


_REASONED = """(select d.*, r.reasoning from {decisions} d join {reasoned} r using (tender_id, bidder_id, criterion_id))"""


@query("select * exclude (reasoning) from " + _REASONED + """ where verdict = 'NEEDS_REVIEW' and (contains(lower(criterion_id), 'turnover')
  or contains(lower(coalesce(nullif(reasoning, ''), reason, '')), 'ocr'))""")
def search_decisions(spark, sf):
    d = _reasoned(spark, sf).filter("verdict = 'NEEDS_REVIEW'")
    said = F.lower(F.coalesce(F.nullif("reasoning", F.lit("")), "reason", F.lit("")))
    return d.filter(F.lower("criterion_id").contains("turnover") | said.contains("ocr")).drop("reasoning")


def _reasoned(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions with what is told of them."""
    return evaluation.explained(spark, sf).select(*decide.PAIR, "field", "verdict", "reason", F.round("confidence", 6).alias("confidence"), "reasoning")


_QUEUE = """select d.tender_id, t.title, d.bidder_id, b.name, d.criterion_id, d.reason, d.confidence from {decisions} d
  join {tenders} t on t.id = d.tender_id join {bidders} b on b.id = d.bidder_id and b.tender_id = d.tender_id where d.verdict = 'NEEDS_REVIEW'"""


@query("select * from (" + _QUEUE + ") where contains(lower(coalesce(nullif(title, ''), cast(tender_id as varchar))), '12') or contains(lower(coalesce(nullif(name, ''), bidder_id)), '7')")
def search_review_queue(spark, sf):
    title = F.lower(F.coalesce(F.nullif("title", F.lit("")), F.col("tender_id").cast("string")))
    return _queue(spark, sf).filter(title.contains("12") | F.lower(F.coalesce(F.nullif("name", F.lit("")), "bidder_id")).contains("7"))


_OUTPUT = """select tender_id, case tender_id % 6 when 0 then bidder_id when 1 then '1-2-3-4-5' when 2 then '{' || u || '}' when 3 then replace(u, '-', '') when 4 then upper(u) || 'x' else u end as bidder_id,
  case when tender_id % 4 = 0 then '' else criterion_id end as criterion_id from (select *, lpad(cast(tender_id as string), 8, '0') || '-0000-4000-8000-00000000000a' as u from DECISIONS)"""


@query("select bidder_id, criterion_id, regexp_full_match(bidder_id, '(urn:uuid:)?U|.U.|[0-9a-fA-F]{32}') and criterion_id <> '' as ok from (".replace(
    "U", "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}") + _OUTPUT.replace("DECISIONS", "{decisions}") + ")")
def validate_decisions(spark, sf):
    """Rows of an engine's output, good ones and those that go to quarantine."""
    d = evaluation.decisions(spark, sf).select("tender_id", "bidder_id", "criterion_id")
    out = spark.sql(_OUTPUT.replace("{", "{{").replace("}", "}}").replace("DECISIONS", "{d}"), d=d).drop("tender_id")
    good, bad = changes.admit_decisions(out)
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))


@query("""select t.id as tender_id, case when not exists (select 1 from {criteria} c where c.tender_id = t.id and semantic_ambiguity_score < 0.5) then 'no criteria' else 'no bidders' end as error
  from {tenders} t where t.id not in (select tender_id from {criteria} where semantic_ambiguity_score < 0.5) or t.id not in (select tender_id from {bidders})""")
def eval_preconditions(spark, sf):
    """Tenders without a clear criterion, or without bidders."""
    t = V(spark, sf, "tenders").select(F.col("id").alias("tender_id"))
    c = V(spark, sf, "criteria").filter("semantic_ambiguity_score < 0.5").select("tender_id").distinct()
    no_c = t.join(c, "tender_id", "left_anti").withColumn("error", F.lit("no criteria"))
    no_b = t.join(c, "tender_id", "left_semi").join(V(spark, sf, "bidders").select("tender_id").distinct(), "tender_id", "left_anti")
    return no_c.unionByName(no_b.withColumn("error", F.lit("no bidders")))


# Joins -----------------------------------------------------------------------------------------
@query("select b.tender_id, b.id as bidder_id, c.id as criterion_id, c.field, c.operator, c.value as target from {bidders} b join {criteria} c on c.tender_id = b.tender_id")
def pair_matrix(spark, sf):
    out = decide.pairs(V(spark, sf, "bidders"), V(spark, sf, "criteria"))
    return out.select("tender_id", "bidder_id", "criterion_id", "field", "operator", "target")


@query("select tender_id, bidder_id, criterion_id, id as doc_id, pass, match_pos, round(value, 4) as value, ext_conf, ocr_conf from {evidence}")
def gather_evidence(spark, sf):
    return evaluation.evidence_rows(spark, sf).select(
        "tender_id", "bidder_id", "criterion_id", "doc_id", "pass", "match_pos", F.round("value", 4).alias("value"), "ext_conf", "ocr_conf"
    )


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    d = evaluation.decisions(spark, sf).filter("verdict = 'NEEDS_REVIEW'")
    t = V(spark, sf, "tenders").select(F.col("id").alias("tender_id"), "title")
    b = V(spark, sf, "bidders").select(F.col("id").alias("bidder_id"), "tender_id", "name")
    return d.join(t, "tender_id").join(b, ["tender_id", "bidder_id"]).select("tender_id", "title", "bidder_id", "name", "criterion_id", "reason", "confidence")


@query(_QUEUE)
def review_queue(spark, sf):
    return _queue(spark, sf)


_OWNED = """select id, case when doc_pos % 2 = 0 then 'tender' else 'bidder' end as owner_type,
  case when doc_pos % 2 = 0 then cast(tender_id as string) else bidder_id end as owner_key from {bidder_docs}"""


@query(f"""select d.id, d.owner_type, coalesce(t1.owner_id, t2.owner_id) as owner_id from ({_OWNED}) d
  left join {{tenders}} t1 on d.owner_type = 'tender' and cast(t1.id as varchar) = d.owner_key
  left join (select distinct id, tender_id from {{bidders}}) b on d.owner_type = 'bidder' and b.id = d.owner_key left join {{tenders}} t2 on t2.id = b.tender_id""")
def doc_owner(spark, sf):
    docs = V(spark, sf, "bidder_docs").select(
        "id", F.expr("case when doc_pos % 2 = 0 then 'tender' else 'bidder' end").alias("owner_type"),
        F.expr("case when doc_pos % 2 = 0 then cast(tender_id as string) else bidder_id end").alias("owner_key"))
    t = V(spark, sf, "tenders").select(F.col("id").alias("tid"), "owner_id")
    b = V(spark, sf, "bidders").select(F.col("id").alias("bid"), "tender_id").distinct()
    t1 = t.select(F.col("tid").cast("string").alias("t1"), F.col("owner_id").alias("o1"))
    via = b.join(t, F.col("tender_id") == F.col("tid")).select("bid", F.col("owner_id").alias("o2"))
    out = docs.join(t1, (F.col("owner_type") == "tender") & (F.col("t1") == F.col("owner_key")), "left")
    out = out.join(via, (F.col("owner_type") == "bidder") & (F.col("bid") == F.col("owner_key")), "left")
    return out.select("id", "owner_type", F.coalesce("o1", "o2").alias("owner_id"))


@query("select b.id as bidder_id, b.tender_id, t.owner_id from {bidders} b join {tenders} t on t.id = b.tender_id")
def bidder_owner(spark, sf):
    t = V(spark, sf, "tenders").select(F.col("id").alias("tender_id"), "owner_id")
    return V(spark, sf, "bidders").select(F.col("id").alias("bidder_id"), "tender_id").join(t, "tender_id").select("bidder_id", "tender_id", "owner_id")


@query("""select distinct a.id, o.officer from {audit} a join (select a2.id as aid, t.owner_id as officer from {audit} a2 join {tenders} t on t.id = a2.tender_id
  union select id, user_id from {audit}) o on o.aid = a.id""")
def audit_visible(spark, sf):
    """Every officer's visible entries: of tenders they own, or their own."""
    a = V(spark, sf, "audit")
    t = V(spark, sf, "tenders").select(F.col("id").alias("tender_id"), F.col("owner_id").alias("officer"))
    owned = a.select("id", "tender_id").join(t, "tender_id").select("id", "officer")
    return owned.unionByName(a.select("id", F.col("user_id").alias("officer"))).distinct()


@query("""select min(id) as id, tender_id, field, operator, cast(cast(value as double) as varchar) = cast(cast(value as double) as varchar) as numeric_value
  from {criteria} where tender_id not in (select id from {tenders} where status = 'closed') group by tender_id, field, operator, value""")
def criteria_dedupe(spark, sf):
    """All criteria come twice, against those that closed tenders have already."""
    c = V(spark, sf, "criteria").select("id", "tender_id", "field", "operator", F.col("value").cast("long").cast("string").alias("value"))
    twice = c.unionByName(c.withColumn("id", F.concat("id", F.lit("x"))).withColumn("value", F.concat("value", F.lit(".0"))))
    out = changes.new_criteria(twice, _of_closed(spark, sf, c))
    return out.select("id", "tender_id", "field", "operator", F.col("value").try_cast("double").isNotNull().alias("numeric_value"))


@query("select tender_id, bidder_id, criterion_id, present_type from {presence}")
def doc_type_match(spark, sf):
    docs = evaluation.documents(spark, sf)
    return decide.presence(decide.pairs(V(spark, sf, "bidders"), V(spark, sf, "criteria")), docs).filter("present_type is not null")


@query("""select id, sha256(bidder_id || '|' || doc_type || '|' || text) as fingerprint from {bidder_docs}
  where sha256(bidder_id || '|' || doc_type || '|' || text) not in (select sha256(bidder_id || '|' || doc_type || '|' || text) from {bidder_docs} where created_at < '1998-06-01')""")
def incremental_anti(spark, sf):
    """Documents whose fingerprint none of those processed before the day has."""
    docs = V(spark, sf, "bidder_docs").select("id", "created_at", F.sha2(F.concat_ws("|", "bidder_id", "doc_type", "text"), 256).alias("fingerprint"))
    done = docs.filter("created_at < '1998-06-01'").select("fingerprint")
    return docs.join(done, "fingerprint", "left_anti").select("id", "fingerprint")


@query("""select d.bidder_id, d.criterion_id, b.name, case when length(c.label) > 120 then left(c.label, 117) || '…' else c.label end as label from {decisions} d
  join {bidders} b on b.id = d.bidder_id and b.tender_id = d.tender_id join (select id, coalesce(nullif(text_raw, ''), nullif(field, ''), id) as label from {criteria}) c on c.id = d.criterion_id""")
def decision_labels(spark, sf):
    """Each decision with the name of its bidder and the label of its criterion.

    There is one decision of every bidder on every criterion of its tender, so names and labels meet in the join
    by tender that makes these pairs; decisions are not moved to their names and labels.
    """
    full = F.coalesce(F.nullif("text_raw", F.lit("")), F.nullif("field", F.lit("")), "id")
    label = F.when(F.char_length(full) > 120, F.concat(F.left(full, F.lit(117)), F.lit("…"))).otherwise(full)
    c = V(spark, sf, "criteria").select("tender_id", F.col("id").alias("criterion_id"), label.alias("label"))
    b = V(spark, sf, "bidders").select("tender_id", F.col("id").alias("bidder_id"), "name")
    return b.join(c, "tender_id").select("bidder_id", "criterion_id", "name", "label")


# Evidence and decisions ----------------------------------------------------------------------------
@query("select id as doc_id, match_pos, round(value, 4) as value from {facts} where family = 'money' and pass = 1")
def ev_money_pass1(spark, sf):
    return evidence.money_pass1(evaluation.documents(spark, sf)).select("doc_id", "match_pos", F.round("value", 4).alias("value"))


@query("select id as doc_id, match_pos, round(value, 4) as value from {facts} where family = 'money' and pass = 2")
def ev_money_pass2(spark, sf):
    return evidence.money_pass2(evaluation.documents(spark, sf)).select("doc_id", "match_pos", F.round("value", 4).alias("value"))


_SIGNAL_SQL = " union all ".join(
    f"select doc_id, '{field}' as field, {signal_case(field, 0)} as value, {signal_case(field, 1)} as ext_conf from d" for field in P.SIGNALS
)


@query("select * from (with d as (select id as doc_id, lower(text) as t from {signal_docs}) " + _SIGNAL_SQL + ")")
def ev_bool_signals(spark, sf):
    """All twelve presence signals of each document, hits and misses."""
    return evidence.bool_facts(V(spark, sf, "signal_docs").select(F.col("id").alias("doc_id"), "text")).drop("text")


_COUNT_SQL = " union all ".join(
    f"select doc_id, '{field}' as field, {largest(field)} as value, {conf}::double as ext_conf from d" for field, (_, conf) in P.COUNT_RULES.items()
)


@query("select * from (with d as (select id as doc_id, text from {signal_docs}) " + _COUNT_SQL + ") where value > 0")
def ev_counts(spark, sf):
    """The largest count of each of the six fields in each document."""
    return evidence.count_facts(V(spark, sf, "signal_docs").select(F.col("id").alias("doc_id"), "text")).drop("text")


@query("select id as doc_id, case when q is null or q = 0 then 0.75 else q end as ocr_conf from (select id, case when doc_pos % 10 = 0 then 0 else quality_score end as q from {bidder_docs})")
def ev_ocr_conf(spark, sf):
    q = F.expr("case when doc_pos % 10 = 0 then 0D else quality_score end")
    return evaluation.documents(spark, sf).select("doc_id", evidence.ocr_confidence(q).alias("ocr_conf"))


@query(r"""select doc_id, coalesce(nullif(regexp_replace(max(whole), '^\s+|\s+$', '', 'g'), ''), string_agg(text, chr(10) order by page)) as text from (select doc_id, page, case when doc_id % 2 = 0 then ' whole ' || doc_id || ' ' else chr(10) || ' ' end as whole,
  nullif(case when page = 1 and doc_id % 3 = 0 then '' else string_agg(token, ' ' order by pos, token) end, '') as text from {ocr_tokens} group by doc_id, page) group by doc_id""".replace("string_agg(text, chr(10) order by page)", "coalesce(string_agg(text, chr(10) order by page), '')"))
def doc_full_text(spark, sf):
    """A text that is more than white space, else the pages, of which some are empty."""
    pages = rollups.ocr_pages(V(spark, sf, "ocr_tokens"))
    pages = pages.withColumn("text", F.when((F.col("page") == 1) & (F.col("doc_id") % 3 == 0), "").otherwise(F.col("text")))
    docs = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"))
    whole = F.expr("case when doc_id % 2 = 0 then ' whole ' || doc_id || ' ' else '\n ' end")
    return docs.select("doc_id", evidence.full_text(whole, F.col("pages")).alias("text"))


_STORED = """case doc_pos % 6 when 0 then '{"text": " ' || id || ' ", "pages": [{"text": "no"}]}' when 1 then '{"text": "  ", "pages": [{"text": "' || id || '"}, {"text": ""}, {"n": 1}, 7, {"text": "two"}]}'
  when 2 then '  plain ' || id || ' ' when 3 then '["' || id || '"]' when 4 then '' else '{"pages": 5}' end"""


@query("""select id, case doc_pos % 6 when 0 then id when 1 then id || chr(10) || 'two' when 2 then 'plain ' || id else '' end as text from {bidder_docs}""")
def doc_stored_text(spark, sf):
    """Stored readings in all forms: objects with a text or pages, plain text, other JSON."""
    return V(spark, sf, "bidder_docs").select("id", evidence.stored_text(F.expr(_STORED)).alias("text"))


@query("select tender_id, bidder_id, criterion_id, n, round(top, 4) as top, round(low, 4) as low from {summary} where n >= 2 and case when top > 0 then (top - low) / top > 0.05 else abs(top - low) > 1 end")
def conflict_detect(spark, sf):
    out = decide.evidence_summary(evaluation.evidence_rows(spark, sf)).filter(decide.in_conflict(F.col("n"), F.col("top"), F.col("low")))
    return out.select(*decide.PAIR, "n", F.round("top", 4).alias("top"), F.round("low", 4).alias("low"))


_NUMBERED = "(select *, row_number() over (partition by tender_id, bidder_id, criterion_id order by doc_pos, pass, match_pos) as k from {evidence})"


@query("select e.tender_id, e.bidder_id, e.criterion_id, e.id as doc_id, e.pass, e.match_pos, o.id || '#' || o.pass || '#' || o.match_pos as conflicts_with from " + _NUMBERED + """ e
  join {summary} s using (tender_id, bidder_id, criterion_id) left join """ + _NUMBERED + """ o on o.tender_id = e.tender_id and o.bidder_id = e.bidder_id
    and o.criterion_id = e.criterion_id and o.k <> e.k and s.n >= 2 and case when s.top > 0 then (s.top - s.low) / s.top > 0.05 else abs(s.top - s.low) > 1 end""")
def cross_doc_flags(spark, sf):
    """Every evidence row with the ids of those that contradict it, one a row."""
    return decide.cross_flags(evaluation.evidence_rows(spark, sf))


@query("""select d.id as doc_id, c.id as criterion_id, case when coalesce(list_position(string_split(c.priority, ','), d.doc_type), 0) = 0 then 0.5 else
  round(1.0 - (list_position(string_split(c.priority, ','), d.doc_type) - 1) / len(string_split(c.priority, ',')) * 0.2, 6) end as score
  from {bidder_docs} d join {criteria} c on c.tender_id = d.tender_id""")
def source_priority(spark, sf):
    c = V(spark, sf, "criteria").select("tender_id", F.col("id").alias("criterion_id"), "priority")
    out = evaluation.documents(spark, sf).select("tender_id", "doc_id", "doc_type").join(c, "tender_id")
    return out.select("doc_id", "criterion_id", F.round(decide.priority_score(F.col("doc_type"), decide.priority_list(F.col("priority"))), 6).alias("score"))


@query("select id as doc_id, criterion_id, pass, match_pos, round(conf, 6) as confidence from {evidence}")
def overall_confidence(spark, sf):
    spi = decide.priority_score(F.col("doc_type"), decide.priority_list(F.col("priority")))
    conf = decide.confidence(F.col("ocr_conf"), F.col("ext_conf"), spi, F.lit(0.0))
    return evaluation.evidence_rows(spark, sf).select("doc_id", "criterion_id", "pass", "match_pos", F.round(conf, 6).alias("confidence"))


@query("select tender_id, bidder_id, criterion_id, id as doc_id, round(value, 4) as value, round(conf, 6) as confidence from {best}")
def best_evidence(spark, sf):
    out = decide.evidence_summary(evaluation.evidence_rows(spark, sf))
    return out.select(*decide.PAIR, F.col("best.doc_id").alias("doc_id"), F.round("best.value", 4).alias("value"), F.round("best.conf", 6).alias("confidence"))


@query("""select l_orderkey, l_linenumber, l_partkey, case l_linenumber % 5 when 0 then l_quantity >= 25 when 1 then l_quantity <= 25 when 2 then abs(l_quantity - 25) < 1e-6
  when 3 then not abs(l_quantity - 25) < 1e-6 else false end as ok from {lineitem}""")
def eval_operator(spark, sf):
    op = F.element_at(F.array(*map(F.lit, [">=", "<=", "==", "!=", "~"])), F.col("l_linenumber") % 5 + 1)
    return V(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", decide.passes(F.col("l_quantity"), op, F.lit(25.0)).alias("ok"))


@query("select tender_id, bidder_id, criterion_id, reason from {decisions} where reason in ('DOC_PRESENT', 'DOC_MISSING')")
def doc_presence(spark, sf):
    return evaluation.decisions(spark, sf).filter(F.col("reason").isin("DOC_PRESENT", "DOC_MISSING")).select(*decide.PAIR, "reason")


@query("select tender_id, bidder_id, criterion_id, field, verdict, reason from {decisions}")
def verdict_cascade(spark, sf):
    return evaluation.decisions(spark, sf).select(*decide.PAIR, "field", "verdict", "reason")


@query("""select tender_id, bidder_id, criterion_id, reason, coalesce(n, 0) as evidence_count,
  round(case when reason = 'NO_EVIDENCE' then 1.0 when reason = 'CONFLICT_DETECTED' then 0.0 when reason = 'LOW_OCR_CONFIDENCE' then 1.0 - ocr_conf
    when reason = 'LOW_CONFIDENCE' then greatest(0.0, 0.9 - ext_conf) when reason in ('MATCH', 'REQUIREMENT_NOT_MET') then 0.05 end, 6) as ambiguity_extraction,
  case when reason not in ('DOC_PRESENT', 'DOC_MISSING') then amb end as ambiguity_semantic,
  case when reason not in ('DOC_PRESENT', 'DOC_MISSING') then cast(reason = 'CONFLICT_DETECTED' as int)::double end as ambiguity_conflict,
  case when reason in ('MATCH', 'REQUIREMENT_NOT_MET', 'LOW_CONFIDENCE', 'LOW_OCR_CONFIDENCE') then doc_id end as source_doc,
  round(case when reason in ('MATCH', 'REQUIREMENT_NOT_MET', 'LOW_CONFIDENCE', 'LOW_OCR_CONFIDENCE') then value end, 4) as extracted,
  reason in ('NO_EVIDENCE', 'CONFLICT_DETECTED', 'LOW_OCR_CONFIDENCE', 'LOW_CONFIDENCE') as reviewer_required from {judged}""")
def decision_explain(spark, sf):
    out = decide.explain(evaluation.rows(spark, sf, decide.FIGURES))
    return out.withColumns({"ambiguity_extraction": F.round("ambiguity_extraction", 6), "extracted": F.round("extracted", 4)})


@query("""select tender_id, bidder_id, criterion_id, id as doc_id, pass, match_pos, k from (select *, row_number() over w as k, count(*) over p as n, max(value) over p as top, min(value) over p as low
  from {evidence} window w as (partition by tender_id, bidder_id, criterion_id order by doc_pos, pass, match_pos), p as (partition by tender_id, bidder_id, criterion_id))
  where k <= 4 and n >= 2 and case when top > 0 then (top - low) / top > 0.05 else abs(top - low) > 1 end""")
def conflict_snapshots(spark, sf):
    return decide.conflict_snapshots(evaluation.evidence_rows(spark, sf)).select(*decide.PAIR, "doc_id", "pass", "match_pos", "k")


_BAD = """(select tender_id, bidder_id, criterion_id, n from {summary} where n >= 2 and case when top > 0 then (top - low) / top > 0.05 else abs(top - low) > 1 end)"""


@query("select tender_id, bidder_id, criterion_id, n, e.id || '#' || e.pass || '#' || e.match_pos as evidence_id from {evidence} e join " + _BAD + " b using (tender_id, bidder_id, criterion_id)")
def conflict_members(spark, sf):
    """The ids that contradict each other, as members of one class for each pair."""
    return decide.conflict_classes(evaluation.evidence_rows(spark, sf))[1]


@query("""select d.tender_id, d.bidder_id, d.criterion_id, m.id || '#' || m.pass || '#' || m.match_pos as evidence_id, o.id || '#' || o.pass || '#' || o.match_pos as conflicts_with from (select tender_id, bidder_id, criterion_id, arg_min(id, doc_pos) as id
    from {evidence} group by all) d join {evidence} m on m.tender_id = d.tender_id and m.bidder_id = d.bidder_id and m.criterion_id = d.criterion_id and m.id = d.id and m.pass = 1 and m.match_pos = 0
  join """ + _BAD + """ b on b.tender_id = d.tender_id and b.bidder_id = d.bidder_id and b.criterion_id = d.criterion_id
  join {evidence} o on o.tender_id = d.tender_id and o.bidder_id = d.bidder_id and o.criterion_id = d.criterion_id and (o.id <> m.id or o.pass <> m.pass or o.match_pos <> m.match_pos)""")
def conflict_others(spark, sf):
    """What contradicts the first amount of each pair's first document."""
    return decide.conflicts_of_first(evaluation.evidence_rows(spark, sf))


@query("select tender_id, bidder_id, criterion_id, reason, reasoning, evidence_used, snapshots, mode, round(extracted, 4) as extracted, document from {reasoned}")
def decision_reasons(spark, sf):
    """Reasoning, the evidence shown and the trace of every decision."""
    out = evaluation.explained(spark, sf)
    line = lambda s: F.concat_ws("|", s["document"], s["doc_type"], s["raw_text"])
    return out.select(*decide.PAIR, "reason", "reasoning", "evidence_used", F.array_join(F.transform("snapshots", line), ";").alias("snapshots"),
                      "trace.mode", F.round("trace.extracted", 4).alias("extracted"), F.col("snapshot.document").alias("document"))


@query("select tender_id, bidder_id, criterion_id, field, verdict, reason, confidence from {decisions_wide}")
def evaluation_all_fields(spark, sf):
    """Decisions over rules of all families, all operators and unknown fields, on documents with signals for them."""
    docs = V(spark, sf, "signal_docs").withColumnRenamed("id", "doc_id")
    out = decide.decide(V(spark, sf, "bidders"), V(spark, sf, "wide_criteria"), docs)
    return out.select(*decide.PAIR, "field", "verdict", "reason", F.round("confidence", 6).alias("confidence"))


@query("select * from {decisions}")
def run_evaluation(spark, sf):
    return evaluation.decisions(spark, sf)


@query("select tender_id, bidder_id, criterion_id, reason, confidence from {decisions} where verdict = 'NEEDS_REVIEW'")
def review_items(spark, sf):
    return evaluation.decisions(spark, sf).filter("verdict = 'NEEDS_REVIEW'").select(*decide.PAIR, "reason", "confidence")


@query("""select d.tender_id, d.bidder_id, d.criterion_id, d.reason, coalesce(o.verdict, d.verdict) as verdict, o.officer_id as override_by from {decisions} d left join
  (select tender_id, bidder_id, criterion_id, arg_max(verdict, version) as verdict, arg_max(officer_id, version) as officer_id from {overrides}
   where verdict in ('ELIGIBLE', 'NOT_ELIGIBLE', 'NEEDS_REVIEW') and length(trim(justification)) between 10 and 4000 group by all) o using (tender_id, bidder_id, criterion_id)""")
def apply_overrides(spark, sf):
    d = evaluation.decisions(spark, sf).select(*decide.PAIR, "reason", "verdict")
    return decide.override(d, V(spark, sf, "overrides")).select(*decide.PAIR, "reason", "verdict", "override_by")


_GOOD = """(select o.*, d.reason from {overrides} o join {decisions} d using (tender_id, bidder_id, criterion_id)
  where o.verdict in ('ELIGIBLE', 'NOT_ELIGIBLE', 'NEEDS_REVIEW') and length(trim(o.justification)) between 10 and 4000)"""
_NEW = """'{"bidder_id":"' || bidder_id || '","criterion_id":"' || criterion_id || '","override_by":' || officer_id || ',"reason":"' || reason || '","reviewer_override":"' || justification || '","tender_id":' || tender_id || ',"verdict":"' || verdict || '"}'"""


@query(f"""select tender_id, bidder_id, criterion_id, payload, 'sha256:' || sha256(payload) as checksum from (select *, {_NEW} as payload from {_GOOD}
  qualify row_number() over (partition by tender_id, bidder_id, criterion_id order by version desc) = 1)""")
def override_decisions(spark, sf):
    """Payload and checksum of every decision that an override changed."""
    d = evaluation.decisions(spark, sf).select(*decide.PAIR, "reason", "verdict")
    return decide.overridden(d, V(spark, sf, "overrides"))


@query(f"""select i.tender_id, i.bidder_id, i.criterion_id, case when g.tender_id is null then 'open' else 'resolved' end as status
  from (select * from {{decisions}} where verdict = 'NEEDS_REVIEW') i left join (select distinct tender_id, bidder_id, criterion_id from {_GOOD}) g using (tender_id, bidder_id, criterion_id)""")
def override_queue(spark, sf):
    """Review items, closed where an override was accepted."""
    items = evaluation.decisions(spark, sf).filter("verdict = 'NEEDS_REVIEW'").select(*decide.PAIR)
    return decide.close_items(items, decide.well_formed(V(spark, sf, "overrides")))  # items are decisions, so a change of one is accepted


@query(f"""select tender_id, officer_id as user_id, 'reviewer.override' as action, payload, 'sha256:' || sha256(payload) as checksum from (select *,
  '{{"bidder_id":"' || bidder_id || '","criterion_id":"' || criterion_id || '","justification":"' || replace(justification, 'ABCPE1234F', '[PAN:******234F]') || '","new_verdict":"' || verdict || '","tender_id":' || tender_id || '}}' as payload from {_GOOD})""")
def override_audit(spark, sf):
    """One masked audit row for every accepted override."""
    keys = evaluation.decisions(spark, sf).select(*decide.PAIR)
    return decide.override_audit(decide.accepted(V(spark, sf, "overrides"), keys))


@query("""select owner_id, tender_id, bidder_id, criterion_id, r as rank, n as total from (select t.owner_id, d.*, row_number() over (partition by t.owner_id order by t.created_at, d.tender_id, d.bidder_id, d.criterion_id) as r,
  count(*) over (partition by t.owner_id) as n from {decisions} d join {tenders} t on t.id = d.tender_id where d.verdict = 'NEEDS_REVIEW') where r <= 50""")
def review_queue_by_owner(spark, sf):
    """Each officer's first page of open items of tenders they own, oldest first, with the total."""
    t = V(spark, sf, "tenders").select(F.col("id").alias("tender_id"), "owner_id", "created_at")
    items = evaluation.decisions(spark, sf).filter("verdict = 'NEEDS_REVIEW'").join(t, "tender_id").select("owner_id", "created_at", *decide.PAIR)
    # Read for ranks and for totals, so decided once and written.
    out = changes.page(Workspace(spark).write(items, "items"), "owner_id", ["created_at", *decide.PAIR])
    return out.select("owner_id", *decide.PAIR, "rank", "total")


@query("""select o.id as user_id, t.id as tender_id from {officers} o join {tenders} t on t.owner_id = o.id where o.role <> 'admin'
  union all select null, id from {tenders}""")
def tender_access(spark, sf):
    """Who sees which tender: its owner, and any admin (one row without a user, not one per admin)."""
    t = V(spark, sf, "tenders").select(F.col("id").alias("tender_id"), "owner_id")
    o = V(spark, sf, "officers").filter("role <> 'admin'").select(F.col("id").alias("owner_id"))
    own = t.join(o, "owner_id").select(F.col("owner_id").alias("user_id"), "tender_id")
    return own.unionByName(t.select(F.lit(None).cast("long").alias("user_id"), "tender_id"))


@query(r"""select * from (with docs as (select d.*, row_number() over (partition by bidder_id order by doc_pos) as r, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) as lines from {bidder_docs} d),
  named as (select d.tender_id, d.bidder_id, c.id as criterion_id, d.doc_pos, d.id, array_to_string(d.lines, chr(10)) as whole, array_to_string(list_filter(d.lines,
    lambda x: len(list_filter(string_split(c.field, '_'), lambda k: len(k) >= 3 and contains(lower(x), k))) > 0), chr(10)) as picked
    from docs d join {criteria} c on c.tender_id = d.tender_id where r <= 8),
  snippets as (select *, chr(10) || '--- Document: ' || id || ' ---' || chr(10) || left(case when picked <> '' then picked else whole end, 12000) || chr(10) as s from named)
  select tender_id, bidder_id, criterion_id, left(string_agg(s, '' order by doc_pos), 180000) as context from snippets group by all)""")
def llm_context(spark, sf):
    """What a model would read for each bidder and criterion."""
    text = F.replace("text", F.lit(". "), F.lit(".\n"))
    docs = evaluation.documents(spark, sf).withColumn("text", text).withColumn("filename", F.col("doc_id"))
    return decide.model_context(docs, V(spark, sf, "criteria"))


@query("""select b.tender_id, b.id as bidder_id, c.id as criterion_id, case when down or c.operator = '~' then 'NEEDS_REVIEW' else 'ELIGIBLE' end as verdict,
  case when down then 'LLM_FAILURE' when c.operator = '~' then 'PARSE_ERROR' else 'MATCH' end as reason, case when down or c.operator = '~' then 0.0 else 0.8 end::double as confidence,
  case when down then 'LLM evaluation failed: down' when c.operator = '~' then 'Could not parse LLM response.' else 'read' end as reasoning
  from {bidders} b join {wide_criteria} c on c.tender_id = b.tender_id and c.field = 'local_content' join (select tender_id, bidder_id, bool_or(contains(text, 'blacklisted')) as down
    from (select *, row_number() over (partition by tender_id, bidder_id order by doc_pos) as r from {signal_docs}) where r <= 8 group by all) d on d.tender_id = b.tender_id and d.bidder_id = b.id""")
def llm_decisions(spark, sf):
    """Unknown fields as a model decides them, here a stub that fails on some and answers others with no JSON."""
    unknown = V(spark, sf, "wide_criteria").filter("field = 'local_content'")
    docs = V(spark, sf, "signal_docs").withColumn("filename", F.col("id"))

    def make():
        def answer(prompts: list[str]) -> list[str | None]:
            if any("blacklisted" in p for p in prompts):
                raise RuntimeError("down")
            return ["no idea" if "Requirement: ~" in p else 'so: {"verdict": "ELIGIBLE", "reason": "MATCH", "confidence": 0.8, "reasoning": "read"}' for p in prompts]

        return answer

    return decide.model_decisions(decide.model_prompts(decide.model_context(docs, unknown), unknown), make)


@query(r"""select event_id, case when event_type in ('error', 'view') then 'NEEDS_REVIEW' else 'ELIGIBLE' end as verdict,
  case when event_type in ('error', 'view') then 'PARSE_ERROR' else 'MATCH' end as reason from {events}""")
def llm_response_parse(spark, sf):
    """Replies with an answer, with broken JSON, and with none at all."""
    reply = F.expr("""case when event_type = 'error' then 'sorry, {"verdict": "ELIGIBLE", ' || props || '}' when event_type = 'view' then '["ELIGIBLE"]'
      else 'Answer: {"verdict": "ELIGIBLE", "reason": "MATCH", "raw": ' || props || '} done' end""")
    return V(spark, sf, "events").select("event_id", decide.model_reply(reply).alias("p")).select("event_id", "p.verdict", "p.reason")
