"""Decisions on hand-written documents, and the golden case of the evaluation rules."""

import pytest
from pyspark.sql import functions as F

from bidloom.operators import decide, evidence

DOC = "tender_id long, bidder_id string, doc_id string, doc_pos int, doc_type string, quality_score double, text string"
RULE = "tender_id long, id string, field string, operator string, value double, priority string, semantic_ambiguity_score double"


def run(spark, docs, rules, bidders=None):
    d = spark.createDataFrame(docs, DOC)
    c = spark.createDataFrame(rules, RULE)
    b = spark.createDataFrame(bidders or sorted({(r[0], r[1], "n") for r in docs}), "tender_id long, id string, name string")
    out = decide.decide(b, c, d).collect()
    return {(r.bidder_id, r.criterion_id): (r.verdict, r.reason, round(r.confidence, 7)) for r in out}


def one(spark, text, field="annual_turnover", op=">=", value=5e7, priority="audited_balance_sheet,ca_certificate",
        doc_type="audited_balance_sheet", quality=0.95, ambiguity=0.1):
    return run(spark, [(1, "b", "d", 1, doc_type, quality, text)], [(1, "c", field, op, value, priority, ambiguity)])["b", "c"]


@pytest.mark.parametrize(
    "given, reason",
    [
        ({"text": "Amount: Rs. 6 crore"}, "MATCH"),
        ({"text": "Amount: Rs. 4 crore"}, "REQUIREMENT_NOT_MET"),
        ({"text": "nothing here"}, "NO_EVIDENCE"),
        ({"text": "Rs. 6 crore and Rs. 9 crore"}, "CONFLICT_DETECTED"),
        ({"text": "Rs. 600 lakh and INR 6.1 crore"}, "MATCH"),
        ({"text": "Rs. 6 crore", "quality": 0.4}, "LOW_OCR_CONFIDENCE"),
        ({"text": "Rs. 6 crore", "quality": 0.0}, "MATCH"),
        ({"text": "Rs. 6 crore", "ambiguity": 0.6}, "LOW_CONFIDENCE"),
        ({"text": "Turnover (audited FY 2023-24) Rs. 6 crore"}, "CONFLICT_DETECTED"),
        ({"text": "office hours 50 a week", "value": 40.0}, "MATCH"),
        ({"text": "x", "field": "iso_9001", "op": "==", "value": 1.0, "priority": "iso_certificate", "doc_type": "ISO_Certificate"}, "DOC_PRESENT"),
        ({"text": "x", "field": "iso_9001", "op": "==", "value": 1.0, "priority": "iso_certificate"}, "DOC_MISSING"),
        ({"text": "x", "field": "iso_9001", "op": "==", "value": 1.0, "priority": ""}, "NO_EVIDENCE"),
        ({"text": "the bidder is blacklisted", "field": "blacklisting_declaration", "op": "==", "value": 1.0, "priority": "affidavit",
          "doc_type": "affidavit"}, "DOC_PRESENT"),
        ({"text": "12 similar projects", "field": "similar_projects_count", "value": 12.0}, "MATCH"),
        ({"text": "in the last 5 years", "field": "experience_years", "value": 5.0}, "MATCH"),
        ({"text": "anything", "field": "no_such_field", "value": 5.0}, "NO_EVIDENCE"),
        ({"text": "INR 5", "op": "~", "value": 5.0}, "REQUIREMENT_NOT_MET"),
    ],
)
def test_branches(spark, given, reason):
    got = one(spark, **given)
    assert got[1] == reason
    verdict = {"MATCH": "ELIGIBLE", "DOC_PRESENT": "ELIGIBLE", "REQUIREMENT_NOT_MET": "NOT_ELIGIBLE", "DOC_MISSING": "NOT_ELIGIBLE"}
    assert got[0] == verdict.get(reason, "NEEDS_REVIEW")


def test_confidence_and_ties(spark):
    # .35 * .95 + .3 * .9 + .2 * 1 + .15
    assert one(spark, "Rs. 6 crore")[2] == pytest.approx(0.9525)
    assert one(spark, "Rs. 6 crore", doc_type="ca_certificate")[2] == pytest.approx(0.9325)
    docs = [(1, "b", "d2", 2, "supporting", 0.9, "Rs. 100"), (1, "b", "d1", 1, "supporting", 0.9, "Rs. 101")]
    found = evidence.gather(
        spark.createDataFrame([(1, "c", "net_worth", ">=", 1.0, "itr", 0.1)], RULE), evidence.facts(spark.createDataFrame(docs, DOC))
    )
    assert decide.evidence_summary(found).first().best.doc_id == "d1"


def test_every_pair_is_decided(spark):
    docs = [(1, "b1", "d", 1, "x", 0.9, "Rs. 5"), (1, "b2", "e", 1, None, None, None), (2, "b3", "f", 1, "", 0.9, "")]
    rules = [(t, f"c{t}{k}", f, ">=", 1.0, "x", 0.1) for t in (1, 2) for k, f in enumerate(["net_worth", "iso_9001"])]
    got = run(spark, docs, rules, [(1, "b1", "n"), (1, "b2", "n"), (1, "b9", "n"), (2, "b3", "n")])
    assert len(got) == 8 and got["b9", "c10"][1] == "NO_EVIDENCE"


def test_overrides_need_a_known_verdict_and_a_reason(spark):
    d = spark.createDataFrame([(1, "b", "c", "NEEDS_REVIEW"), (1, "b", "e", "ELIGIBLE")], "tender_id long, bidder_id string, criterion_id string, verdict string")
    o = spark.createDataFrame(
        [(1, "b", "c", "ELIGIBLE", "long enough a reason", 7, 1), (1, "b", "c", "NOT_ELIGIBLE", "short", 8, 2), (1, "b", "e", "MAYBE", "long enough a reason", 9, 3)],
        "tender_id long, bidder_id string, criterion_id string, verdict string, justification string, officer_id long, version long",
    )
    got = {r.criterion_id: (r.verdict, r.override_by) for r in decide.override(d, o).collect()}
    assert got == {"c": ("ELIGIBLE", 7), "e": ("ELIGIBLE", None)}


def test_signals(spark):
    texts = ["our company", "standard work", "enabled", "27ABCDE1234F1Z5 gstin", "22abcde1234f1 ok", "no blacklisting"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {(r.k, r.field): (r.value, r.ext_conf) for r in evidence.bool_facts(df).collect()}
    assert got[0, "pan_registration"] == (1.0, 0.7) and got[1, "tds_registration"] == (1.0, 0.72)
    assert got[2, "nabl_accreditation"] == (1.0, 0.85) and got[3, "gst_registration"] == (1.0, 0.78)
    assert got[4, "gst_registration"] == (1.0, 0.92) and got[5, "blacklisting_declaration"] == (1.0, 0.82)
    assert df.select(F.count("*")).first()[0] == 6


def test_model_context(spark):
    docs = [(1, "b", f"d{k}", k, f"f{k}", t) for k, t in enumerate(
        ["Turnover: 5\nother\nANNUAL figures", "nothing", None, "", "x" * 30, *["turnover"] * 6])]
    d = spark.createDataFrame(docs, "tender_id long, bidder_id string, doc_id string, doc_pos int, filename string, text string")
    c = spark.createDataFrame([(1, "c", "annual_turnover"), (1, "z", "a_b")], "tender_id long, id string, field string")
    got = {r.criterion_id: r.context for r in decide.model_context(d, c, per_doc=20).collect()}
    head = "\n--- Document: f{} ---\n{}\n".format
    parts = [head(0, "Turnover: 5\nANNUAL f"), head(1, "nothing"), head(4, "x" * 20), *[head(k, "turnover") for k in (5, 6, 7)]]
    assert got["c"] == "".join(parts)
    assert got["z"].startswith(head(0, "Turnover: 5\nother\nAN"))
    cut = decide.model_context(d, c, per_doc=20, most=50).filter("criterion_id = 'c'").first().context
    assert cut == "".join(parts)[:50]


@pytest.mark.parametrize("reply, want", [
    ('so {"verdict": "ELIGIBLE", "reason": "MATCH"} ok', ("ELIGIBLE", "MATCH")), ("none", ("NEEDS_REVIEW", "PARSE_ERROR")),
    ('{"a": 1} {', (None, None)), ('{"a": ', ("NEEDS_REVIEW", "PARSE_ERROR")), ('{"a": }', ("NEEDS_REVIEW", "PARSE_ERROR")),
    ('["ELIGIBLE"]', ("NEEDS_REVIEW", "PARSE_ERROR")), (None, ("NEEDS_REVIEW", "PARSE_ERROR")),
])
def test_model_reply(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "reply string")
    assert tuple(df.select(decide.model_reply(F.col("reply")).alias("p")).select("p.*").first()) == want


def test_override_outputs(spark):
    keys = [(1, "b", "c"), (1, "b", "d")]
    d = spark.createDataFrame([(*k, "MATCH", "NEEDS_REVIEW") for k in keys], "tender_id long, bidder_id string, criterion_id string, reason string, verdict string")
    form = "tender_id long, bidder_id string, criterion_id string, verdict string, justification string, officer_id long, version long"
    why = "Checked against PAN ABCDE1234F by hand."
    rows = [(1, "b", "c", " eligible ", why, 7, 1), (1, "b", "c", "NOT_ELIGIBLE", why, 8, 2), (1, "b", "d", "MAYBE", why, 7, 1),
            (1, "b", "d", "ELIGIBLE", "short", 7, 1), (1, "b", "gone", "ELIGIBLE", why, 7, 1)]
    changes = spark.createDataFrame(rows, form)
    new = decide.overridden(d, changes).collect()
    assert [(r.criterion_id, r.payload) for r in new] == [("c", '{"bidder_id":"b","criterion_id":"c","override_by":8,"reason":"MATCH","reviewer_override":"'
        + why + '","tender_id":1,"verdict":"NOT_ELIGIBLE"}')]
    done = decide.accepted(changes, d)
    assert {(r.criterion_id, r.status) for r in decide.close_items(d, done).collect()} == {("c", "resolved"), ("d", "open")}
    audit = decide.override_audit(done).collect()
    assert len(audit) == 2 and all("[PAN:******234F]" in r.payload and r.checksum.startswith("sha256:") for r in audit)
