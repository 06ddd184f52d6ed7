"""What queries move: rows go to their tender once, narrow, wherever a file holds them."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bidloom import fixtures, queries, queries_rollups
from bidloom.functions import patterns as P
from bidloom.operators import decide, evidence
from bidloom.plans import evaluation
from bidloom.streaming import monitors


@pytest.fixture(scope="module")
def one_group(tmp_path_factory):
    """Small tables, each in one row group of one file."""
    path, day = tmp_path_factory.mktemp("tables"), datetime.datetime(1998, 1, 1)
    n = 200
    lines = {
        "l_orderkey": [k // 3 for k in range(n)], "l_partkey": list(range(n)), "l_suppkey": [k % 5 for k in range(n)],
        "l_linenumber": pa.array([1 + k % 3 for k in range(n)], pa.int32()), "l_quantity": [float(k % 40) for k in range(n)],
        "l_extendedprice": [1e5 + 1e6 * k for k in range(n)], "l_discount": [k % 11 / 100 for k in range(n)],
        "l_tax": [0.0] * n, "l_returnflag": ["RAN"[k % 3] for k in range(n)], "l_linestatus": ["O"] * n, "l_shipdate": [day] * n,
    }
    orders = {
        "o_orderkey": list(range(70)), "o_custkey": [k % 9 for k in range(70)], "o_orderstatus": ["O"] * 70, "o_totalprice": [1.0] * 70,
        "o_orderdate": [day] * 70, "o_orderpriority": ["1"] * 70,
    }
    supplier = {"s_suppkey": list(range(5)), "s_name": [f"s{k}" for k in range(5)], "s_nationkey": [0] * 5, "s_acctbal": [0.0] * 5}
    for name, columns in {"lineitem": lines, "orders": orders, "supplier": supplier}.items():
        pq.write_table(pa.table(columns), path / f"{name}.parquet")
    return str(path)


def exchanges(df) -> list[str]:
    """The shuffles of a plan as it is before it runs."""
    return [x.strip() for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange " in x and "Broadcast" not in x]


def test_decisions_move_table_rows_only(spark, one_group):
    df = evaluation.decisions(spark, one_group)
    assert df.count() > 0
    moved = exchanges(df)
    assert moved and all("(l_orderkey" in x or "(o_orderkey" in x for x in moved), moved


def test_rows_of_one_row_group_are_dealt_out(spark, one_group):
    for name in ("bidder_docs", "bidders", "criteria", "tender_texts"):
        parts = fixtures.view(spark, one_group, name).groupBy(F.spark_partition_id()).count().count()
        assert parts == 4, name


def test_percentiles_of_many_values_are_exact(spark):
    """More values than a sketch holds, in one hour, path and status."""
    rows = spark.range(20_000).select(F.timestamp_seconds(F.lit(0)).alias("ts"), F.lit("view").alias("path"), F.lit(200).alias("status"),
                                      ((F.col("id") * 7919) % 20_000).cast("double").alias("latency_ms"))
    got = monitors.exact_metrics(rows).first()
    assert (got.n, got.fastest, got.slowest) == (20_000, 0.0, 19_999.0)
    assert (got.p50, got.p95, got.p99) == (9_999.0, 18_999.0, 19_799.0)


def scans(df, table: str) -> int:
    """How often a plan reads a table."""
    return sum("FileScan" in x and f"/{table}.parquet" in x for x in df._jdf.queryExecution().executedPlan().toString().split("\n"))


@pytest.mark.parametrize("name", ["gather_evidence", "ev_counts", "ev_money_pass1"])
def test_facts_are_worked_out_once(spark, one_group, name):
    """No filter of the optimizer's own works out the facts of a text before the text is dealt out, and once more after."""
    df = queries.QUERIES[name](spark, one_group)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() > 0
    assert not [x for x in plan.split("\n") if "Filter" in x and "regexp_extract_all" in x]


def test_conflicts_of_the_first_amount_take_one_pass(spark, one_group):
    df = queries.conflict_others(spark, one_group)
    assert scans(df, "lineitem") == 1
    _, members = decide.conflict_classes(found := evaluation.evidence_rows(spark, one_group))
    first = found.groupBy(*decide.PAIR).agg(F.min(F.struct("doc_pos", "doc_id")).alias("d"))
    asked = first.select(*decide.PAIR, F.concat("d.doc_id", F.lit("#1#0")).alias("evidence_id"))
    want = decide.conflicts_of(asked.join(members, [*decide.PAIR, "evidence_id"], "left_semi"), members)
    rows = sorted(map(tuple, df.collect()))
    assert rows and rows == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["override_decisions", "override_queue", "apply_overrides"])
def test_overrides_decide_once(spark, one_group, name):
    """Documents, bidders and overrides read the lines, each once; decisions are not made again to see which changes are accepted."""
    assert scans(queries.QUERIES[name](spark, one_group), "lineitem") == 3


def test_parts_grow_with_the_lines(spark, one_group, monkeypatch):
    """A part holds a bounded number of lines, so that a task groups its pairs in memory; all tables have as many parts."""
    monkeypatch.setattr(fixtures, "LINES_OF_A_PART", 30)
    for name in ("bidder_docs", "criteria"):
        assert fixtures.view(spark, one_group, name).rdd.getNumPartitions() == 7, name
    moved = exchanges(evaluation.decisions(spark, one_group))
    assert moved and all("(l_orderkey" in x or "(o_orderkey" in x for x in moved), moved


def test_only_what_says_something_is_grouped(spark, one_group):
    """A document that says nothing of a criterion gives no row to be grouped, and rows hold what is told only."""
    b, c, d = fixtures.view(spark, one_group, "bidders"), fixtures.view(spark, one_group, "criteria"), evaluation.documents(spark, one_group)
    rows = decide.judged_documents(b, c, d, ())
    assert rows.filter("asked is null and n = 0 and present is null").count() == 0
    assert rows.filter("asked").count() == 4 * b.count()
    assert rows.schema["best"].dataType.fieldNames() == ["conf", "d", "p", "m", "value", "ocr_conf"]


def test_a_null_text_is_an_empty_one(spark):
    doc = spark.createDataFrame([(1, "b", "d", 0, "t", 0.9, None)], "tender_id long, bidder_id string, doc_id string, doc_pos long, doc_type string, quality_score double, text string")
    (row,) = evidence.fact_lists(doc, ["annual_turnover", "generic_compliance"]).collect()
    assert [(x.family, x.value) for x in row.facts] == [("generic_compliance", 0.0)]


def test_checklist_moves_a_row_a_bidder(spark, one_group):
    """Required types are laid out after the join, so no exchange carries a bidder once for each."""
    df = queries_rollups.doc_checklist(spark, one_group)
    assert df.count() == 9 * fixtures.view(spark, one_group, "bidders").count()
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert [x for x in plan if "Generate" in x] and not any("Generate" in x for x in plan[[k for k, x in enumerate(plan) if "Join" in x][0]:])


def test_labels_meet_decisions_by_tender(spark, one_group):
    """Only table rows move, and there is a row of every decision."""
    df = queries.decision_labels(spark, one_group)
    moved = exchanges(df)
    assert moved and all("(l_orderkey" in x or "(o_orderkey" in x for x in moved), moved
    want = evaluation.decisions(spark, one_group).select("bidder_id", "criterion_id")
    rows = sorted(map(tuple, df.select("bidder_id", "criterion_id").collect()))
    assert rows and rows == sorted(map(tuple, want.collect()))


def test_degrees_need_no_verdicts(spark, one_group):
    """Counted by tender from table rows, as many as there are decisions of each criterion."""
    df = queries_rollups.graph_degree(spark, one_group)
    moved = exchanges(df)
    assert moved and all("(l_orderkey" in x or "(o_orderkey" in x for x in moved), moved
    want = evaluation.decisions(spark, one_group).groupBy("criterion_id").count()
    rows = sorted((r.criterion_id, r.verdicts) for r in df.collect() if r.verdicts)
    assert rows and rows == sorted(map(tuple, want.collect()))


def test_contexts_move_table_rows_only(spark, one_group):
    """Texts meet the criteria by tender, where they are."""
    df = queries.llm_context(spark, one_group)
    assert df.count() == 4 * fixtures.view(spark, one_group, "bidders").count()
    moved = exchanges(df)
    assert moved and all("(l_orderkey" in x or "(o_orderkey" in x for x in moved), moved


def test_contexts_leave_out_empty_texts_of_the_first_documents(spark):
    docs = [(1, "b", 9, "i", "gst one\rno"), (1, "b", 1, "a", None), (1, "b", 2, "c", ""), (1, "b", 3, "d", "x\nGST\r\ny"), (2, "e", 1, "f", ""), (1, None, 1, "g", "gst")]
    docs = spark.createDataFrame(docs, "tender_id long, bidder_id string, doc_pos long, filename string, text string")
    rules = spark.createDataFrame([(1, "k", "gst_id"), (1, "m", None), (2, "n", "gst")], "tender_id long, id string, field string")
    got = {(r.bidder_id, r.criterion_id): r.context for r in decide.model_context(docs, rules, most_docs=3).collect()}
    assert got == {("b", "k"): "\n--- Document: d ---\nGST\n", ("b", "m"): "\n--- Document: d ---\nx\nGST\r\ny\n"}


def test_payloads_are_parsed_once(spark, one_group):
    df = queries.src_eval_payload(spark, one_group)
    assert df.count() == 200
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_counts_take_one_search_of_a_text(spark, one_group):
    plan = queries.ev_counts(spark, one_group)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") - plan.count("regexp_extract_all(_counted") == 1


def test_counts_equal_the_rules_on_whole_texts(spark):
    texts = [
        "20 works30 days", "20 workforce", "20 work force 7 personnel", "12345 days, 5 days", "7 ſtaff 8 staſ 9 ſimilar", "3 worKs 4 worKforce",
        "12 + years 9yrs", "5 full-time\n employees", "१२ similar 1,2 projects", "4 technical staff 40engineers", "10 full time projects", "6+ works", None, "",
        "days 12", "1234567 years3 yr", "8 bıd 9 dİdays", "4 engıneers 5 engİneer", "007 DAYS|08 day", "3.14 staff 2", "1\n\n2 year",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = set()
    for field, (pattern, _) in P.COUNT_RULES.items():
        found = docs.select("doc_id", F.array_max(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), evidence.number_of)).alias("v"))
        want |= {(r.doc_id, field, r.v) for r in found.filter("v > 0").collect()}
    rows = evidence.count_facts(docs).collect()
    assert len(want) > 20 and len(rows) == len(want) and {(r.doc_id, r.field, r.value) for r in rows} == want


def test_review_queue_decides_once(spark, one_group):
    """Ranks and totals read the items that were written, and neither makes decisions again."""
    df = queries.review_queue_by_owner(spark, one_group)
    assert scans(df, "lineitem") == 0
    items = evaluation.decisions(spark, one_group).filter("verdict = 'NEEDS_REVIEW'").count()
    assert 0 < items == sum(r.total for r in df.select("owner_id", "total").distinct().collect())


def test_parts_fit_a_small_share_of_memory(spark, one_group, monkeypatch):
    """A task that groups pairs has at most 50,000 lines on average: under 200 MB measured."""
    monkeypatch.setattr(fixtures, "lines", lambda *a: 600_000)
    assert fixtures.view(spark, one_group, "bidder_docs").rdd.getNumPartitions() == 12
