"""Changes of stored rows, engine output, paging, stored texts, digits of other scripts, plug-ins."""

import pytest
from pyspark.sql import functions as F

from bidloom.functions import text as T
from bidloom.operators import changes, criteria, decide, evidence, rollups
from bidloom.sources import files, plugins


def rules_of(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "tender_id long, text string")
    out = [{} for _ in texts]
    for r in criteria.extract(docs).collect():
        out[r.tender_id][r.field] = r
    return out


def facts_of(spark, text):
    docs = spark.createDataFrame([(1, "b", "d", 1, "itr", 0.9, text)], "tender_id long, bidder_id string, doc_id string, doc_pos int, doc_type string, quality_score double, text string")
    return {(r.family, r["pass"], r.match_pos): r for r in evidence.facts(docs).collect()}


# Digits ----------------------------------------------------------------------------------------
def test_digits_of_any_script_in_rules(spark):
    hindi, long, both = rules_of(
        spark, "Annual turnover ₹ ५० crore. ५ years of experience. २५० employees, bid validity: १२० days",
        "turnover of Rs." + " " * 2100 + "5 crore", "😀😀 EMD of Rs. 𝟓𝟎𝟎\n in cash")
    assert hindi["annual_turnover"].value == 5e8 and hindi["annual_turnover"].text_raw == "turnover ₹ ५० crore"
    assert hindi["experience_years"].value == 5 and hindi["manpower_count"].value == 250
    assert hindi["bid_validity_days"].value == 120
    assert long["annual_turnover"].value == 5e7 and "generic_compliance" not in long
    assert both["emd_amount"].source_clause.startswith("😀😀 EMD of Rs.")


def test_white_space_around_the_match_goes(spark):
    (rule,) = rules_of(spark, "EMD of Rs. 500\nbefore the line break")
    assert rule["emd_amount"].text_raw == "emd of rs. 500" and rule["emd_amount"].source_clause == "EMD of Rs. 500 before the line break"


def test_years_that_figures_are_of(spark):
    (rule,) = rules_of(spark, "Turnover of Rs. 5 crore, 3 similar projects, GST")
    assert tuple(rule["annual_turnover"].temporal) == ("any_of_last_n_years", 3, "tender_date")
    assert tuple(rule["similar_projects_count"].temporal) == ("last_n_years", 5, None)
    assert rule["gst_registration"].temporal is None and rule["gst_registration"].depends_on is None


def test_digits_of_any_script_in_evidence(spark):
    got = facts_of(spark, "Rs. ५० lakh, ५ years, Rs. 7,00,000. turnover २०२३४५")
    assert got["money", 1, 0].value == 50e5 and got["money", 1, 0].raw == "Rs. ५० lakh"
    # The end of "years" with the comma is a match without a number, so it takes a place.
    assert got["money", 1, 2].value == 7e5 and got["experience_years", 1, 0].value == 5
    assert got["money", 2, 0].value == 202345e7 and got["money", 2, 0].raw == "turnover २०२३४५"


def test_plain_digits(spark):
    got = spark.createDataFrame([("a ५० ٣ 𝟗 7",), (None,)], "s string").select(T.plain_digits(F.col("s"))).collect()
    assert [r[0] for r in got] == ["a 50 3 9 7", None]


# Stored texts ------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "stored, text",
    [
        ('{"text": " a\\n", "pages": [{"text": "b"}]}', "a"),
        ('{"text": "\\n", "pages": [{"text": "b"}, {"text": ""}, {"text": null}, 5, {"text": "c "}]}', "b\nc"),
        ('{"pages": {"text": "no list"}}', ""), ('{"text": null}', ""), ('{"text": 0}', ""), ('{"text": 12}', "12"),
        ("  plain text \n", "plain text"), ('"a string"', ""), ("[1]", ""), ("", ""), (None, ""), ("{broken", "{broken"),
    ],
)
def test_stored_text(spark, stored, text):
    df = spark.createDataFrame([(stored,)], "s string")
    assert df.select(evidence.stored_text(F.col("s"))).first()[0] == text


# Changes of stored rows ----------------------------------------------------------------------------
def test_patches_of_different_columns_all_count(spark):
    base = spark.createDataFrame([(1, ">=", 5.0, "a"), (2, "==", 1.0, "b"), (3, "==", 2.0, "c")], "id long, operator string, value double, note string")
    form = "id long, version int, operator string, value double, named array<string>"
    rows = [(1, 1, "<=", None, ["operator"]), (1, 2, None, 7.0, ["value"]), (2, 1, "<", 3.0, ["operator", "value"]), (2, 3, None, None, ["value"]),
            (2, 2, "!=", None, ["operator"]), (9, 1, "x", 1.0, ["operator"])]
    patches = spark.createDataFrame(rows, form)
    got = {r.id: (r.operator, r.value, r.note) for r in changes.patch(base, patches, "id", "version", ["operator", "value"]).collect()}
    assert got == {1: ("<=", 7.0, "a"), 2: ("!=", 3.0, "b"), 3: ("==", 2.0, "c")}
    got = {r.id: (r.operator, r.value) for r in changes.patch(base, patches, "id", "version", ["operator", "value"], named="named").collect()}
    assert got == {1: ("<=", 7.0), 2: ("!=", None), 3: ("==", 2.0)}


def test_engine_output(spark):
    good = "0000000a-0000-4000-8000-000000000001"
    ids = [good, good.upper(), "urn:uuid:" + good, "{" + good + "}", good.replace("-", ""), "1-2-3-4-5", "", None, good + "0"]
    rows = spark.createDataFrame([(i, "c") for i in ids] + [(good, ""), (good, None)], "bidder_id string, criterion_id string")
    kept, bad = changes.admit_decisions(rows)
    assert kept.count() == 5 and bad.count() == 6
    with pytest.raises(changes.NoValidDecisions) as e:
        changes.admit_decisions(rows.filter("criterion_id = ''"))
    assert [tuple(r) for r in e.value.quarantine.collect()] == [(good, "")]
    with pytest.raises(changes.NoValidDecisions):
        changes.admit_decisions(rows.limit(0))


def test_manual_criteria(spark):
    form = "id string, tender_id long, field string, operator string, value string, confidence double"
    stored = spark.createDataFrame([("s", 1, "emd", ">=", "5.0", 1.0)], form)
    batch = spark.createDataFrame([("a", 1, "emd", ">=", "5", 0.4), ("b", 1, "emd", "<=", "5", 1.5), ("c", 1, "emd", "<=", "5e0", None), ("d", 2, "emd", ">=", "5", 0.0)], form)
    got = {r.id: (r.accepted, r.confidence) for r in changes.manual_criteria(batch, stored).collect()}
    assert got == {"a": (False, 0.4), "b": (True, 1.0), "c": (False, 1.0), "d": (True, 1.0)}


def test_empty_ids_of_audit_rows(spark):
    form = "id long, tender_id string, user_id string, action string, note string, created_at timestamp"
    rows = spark.createDataFrame([(1, "", "u", "a", "n", None), (2, "t", "", "a", "n", None), (3, None, None, "a", "n", None)], form)
    assert {r.id: (r.tender_id, r.user_id) for r in changes.audit_rows(rows).collect()} == {1: (None, "u"), 2: ("t", None), 3: (None, None)}


def test_pages_of_the_whole_table(spark):
    """All pages one after the other give every row once, ties and nulls of other columns included."""
    rows = [(k, k % 4, None if k % 3 else "x") for k in range(57)]
    df = spark.createDataFrame(rows, "id long, day int, note string").repartition(5)
    seen, after = [], None
    while part := sorted(changes.keyset_page(df, [("day", True), ("id", False)], after, 10).collect(), key=lambda r: (-r.day, r.id)):
        assert {r.total for r in part} == {57} and len(part) <= 10
        seen += [(r.day, r.id) for r in part]
        after = seen[-1]
    assert seen == sorted(((d, i) for i, d, _ in rows), key=lambda r: (-r[0], r[1]))
    with pytest.raises(ValueError):
        changes.keyset_page(df, [("id", False)], None, -1)


# Explanations --------------------------------------------------------------------------------------
def test_numbers_as_they_are_told(spark):
    values = [0.0, 5.0, -5.25, 5e7, 12345678.5, 1e15, 123456789012345680.0, 1e16, 1.5e300, 0.001, 0.00025, 1e-5, 2.5e-7, 0.1, 1e22, -3e20]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(T.python_float(F.col("v"))).collect()] == [repr(v) for v in values]


def test_explanations_of_each_branch(spark):
    rule = "tender_id long, id string, field string, operator string, value double, priority string, semantic_ambiguity_score double"
    doc = "tender_id long, bidder_id string, doc_id string, doc_pos int, doc_type string, quality_score double, text string, filename string"
    rules = [("turn", "annual_turnover", ">=", 5e7, "itr", 0.1), ("gst", "gst_registration", "==", 1.0, "gst_certificate,itr", 0.1),
             ("iso", "iso_9001", "==", 1.0, "iso_certificate", 0.1), ("years", "experience_years", ">=", 3.0, "itr", 0.1), ("odd", "local_content", ">=", 1.0, "itr", 0.1)]
    amounts = " ".join(f"Rs. {k} crore" for k in (6, 9, 12, 15, 18))
    docs = [("b1", "d1", 1, "itr", 0.9, "Rs. 6 crore and 4 years", "one.pdf"), ("b2", "d2", 1, "itr", 0.9, amounts, "two.pdf"),
            ("b3", "d3", 1, "itr", 0.3, "Rs. 6 crore", "three.pdf"), ("b4", "d4", 1, "gst_certificate", 0.9, "Rs. 4 crore", None)]
    c = spark.createDataFrame([(1, *r) for r in rules], rule)
    d = spark.createDataFrame([(1, *r) for r in docs], doc)
    b = spark.createDataFrame([(1, k, "n") for k in ("b1", "b2", "b3", "b4", "b5")], "tender_id long, id string, name string")
    rows, found = decide.decide(b, c, d), evidence.gather(c, evidence.facts(d))
    got = {(r.bidder_id, r.criterion_id): r for r in decide.explanations(rows, found, d).collect()}
    told = lambda bidder, rule: got[bidder, rule].reasoning
    assert told("b1", "turn") == "annual_turnover requires >= 50000000.0. Extracted 60000000.0 from one.pdf."
    assert tuple(got["b1", "turn"].snapshot) == ("one.pdf", "Rs. 6 crore", 6e7, 0.9, None)
    assert got["b1", "turn"].evidence_used == "d1#1#0" and got["b1", "turn"].trace.source_doc == "one.pdf"
    assert told("b1", "years") == "experience_years requires >= 3.0. Extracted 4.0 from one.pdf."
    assert got["b1", "years"].snapshot.extracted_value == "Rs. 6 crore and 4 years"
    assert told("b2", "turn") == ("Conflicting annual_turnover values detected across documents: ₹6.00 Cr vs ₹9.00 Cr vs ₹12.00 Cr."
                                  " Cannot auto-decide — requires officer verification.")  # fmt: skip
    assert [(s.document, s.normalized_value, s.raw_text) for s in got["b2", "turn"].snapshots] == [("two.pdf", k * 1e7, f"Rs. {k} crore") for k in (6, 9, 12, 15)]
    assert got["b2", "turn"].trace.evidence_count == 5 and got["b2", "turn"].evidence_used == "d2#1#0"
    assert told("b3", "turn") == "OCR confidence below threshold." and got["b3", "turn"].trace.ocr_confidence == 0.3
    assert told("b4", "turn").endswith("Extracted 40000000.0 from d4.") and got["b4", "turn"].reason == "REQUIREMENT_NOT_MET"
    assert told("b4", "gst") == "Document of type 'gst_certificate' satisfies presence requirement (expected one of ['gst_certificate', 'itr'])."
    assert told("b4", "iso") == "No document of type matching ['iso_certificate'] provided by bidder." and got["b4", "iso"].trace.found is False
    assert told("b5", "turn") == "No evidence extracted for this criterion." and got["b5", "turn"].trace.evidence_count == 0
    assert told("b5", "odd") == "Unknown field with no documents matching expected types."
    _, members = decide.conflict_classes(found)
    others = decide.conflicts_of(members.filter("evidence_id = 'd2#1#2'"), members)
    assert sorted(r.conflicts_with for r in others.collect()) == ["d2#1#0", "d2#1#1", "d2#1#3", "d2#1#4"]


def test_engines(spark):
    paths = {"": "missing_file", None: "missing_file", "a/b.PDF": "pdf", "x.webp": "image", "x.docx": "none", "dir.pdf/x": "none"}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.e for r in df.select("path", files.engine(F.col("path")).alias("e")).collect()} == paths


# Plug-ins ------------------------------------------------------------------------------------------
def shouting():
    """A plug-in that answers in capitals, not at all to "nothing", and breaks on "bad"."""

    def answer(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [None if t == "nothing" else t.upper() for t in texts]

    return answer


def test_plugin_rows_pass_through(spark):
    texts = ["a", "bad", None, "nothing", "b", "c"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(2)
    got = {r.id: (r.t, r.answer, r.failure) for r in plugins.call(df, shouting, "t", batch=4).collect()}
    want = {"a": ("A", None), "b": ("B", None), "c": ("C", None), None: (None, None), "nothing": (None, "no answer"), "bad": (None, "RuntimeError: no")}
    assert got == {k: (t, *want[t]) for k, t in enumerate(texts)}


def test_plugins_that_do_not_work(spark):
    def broken():
        raise OSError("down")

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    assert {r.failure for r in plugins.call(df, broken, "t").collect()} == {"OSError: down"}
    short = plugins.call(df, lambda: lambda texts: texts[1:], "t", batch=2)
    assert {r.failure for r in short.collect()} == {"ValueError: 0 answers to 1 texts"}


def test_translation_in_pieces(spark):
    hindi = "निविदा की शर्तें"
    rows = [(1, "\n".join([hindi] * 3)), (2, "English text only"), (3, hindi + "\nखराब"), (4, None)]
    docs = spark.createDataFrame(rows, "tender_id long, text string")

    def make():
        def answer(texts):
            if any("खराब" in t for t in texts):
                raise ValueError("bad piece")
            return [f"<{t.count('न')}> 5 years of experience" for t in texts]

        return answer

    english = plugins.translate(docs, make, most=20)
    got = {r.tender_id: (r.english, r.failure) for r in english.collect()}
    assert got == {1: ("\n".join(["<1> 5 years of experience"] * 3), None), 3: (None, "ValueError: bad piece")}
    out = {(r.tender_id, r.field): r for r in criteria.extract_in_language(docs, english).collect()}
    assert out[1, "experience_years"].source_clause_translated.startswith("<1> 5 years") and out[1, "experience_years"].extraction_warning is None
    assert out[1, "experience_years"].source_text_lang == "hi"
    assert out[3, "generic_compliance"].extraction_warning == "untranslated_indic_text" and out[3, "generic_compliance"].source_clause_translated is None
    assert out[2, "generic_compliance"].extraction_warning is None
    without = {r.tender_id: r.extraction_warning for r in criteria.extract_in_language(docs).collect()}
    assert without == {1: "untranslated_indic_text", 2: None, 3: "untranslated_indic_text", 4: None}


def test_model_decisions(spark):
    def make():
        def answer(prompts):
            if any("Field: c" in p for p in prompts):
                raise RuntimeError("down: again")
            return ['x {"verdict": "NOT_ELIGIBLE", "reason": "EXP_SHORT", "confidence": 0.9} y' if "Field: a" in p else "[1]" for p in prompts]

        return answer

    rules = spark.createDataFrame([(1, k, k, None, ">=", 2.0) for k in "abc"], "tender_id long, id string, field string, text_raw string, operator string, value double")
    contexts = spark.createDataFrame([(1, "b", k, "text of " + k) for k in "abc"], "tender_id long, bidder_id string, criterion_id string, context string")
    prompts = decide.model_prompts(contexts, rules)
    assert "Requirement: >= 2.0" in prompts.first().prompt
    got = {r.criterion_id: tuple(r)[3:] for r in decide.model_decisions(prompts, make).collect()}
    assert got == {
        "a": ("NOT_ELIGIBLE", "EXP_SHORT", 0.9, None), "b": ("NEEDS_REVIEW", "PARSE_ERROR", 0.0, "Could not parse LLM response."),
        "c": ("NEEDS_REVIEW", "LLM_FAILURE", 0.0, "LLM evaluation failed: down: again"),
    }


def test_lines_of_two_languages(spark):
    rows = [(1, 1, 2, 1, "हिंदी", 0.5), (1, 1, 1, 2, "second", 0.9), (1, 1, 1, 1, "first", 0.7), (1, 2, 2, 1, "केवल", 0.4)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, pass int, pos int, line string, confidence double")
    both = {r.page: (r.text, r.mean_confidence) for r in rollups.ocr_line_pages(lines).collect()}
    assert both == {1: ("first\nsecond\nहिंदी", 0.7), 2: ("केवल", 0.4)}
    one = {r.page: (r.text, r.mean_confidence) for r in rollups.ocr_line_pages(lines, "eng").collect()}
    assert one == {1: ("first\nsecond", 0.8), 2: ("", 0.0)}


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_cross_flags_name_every_conflicting_id(spark, block):
    """Ids and not their number, of all others of the pair however many blocks they fill; copies of a row count; the rest stay."""
    values = {"a": [5.0, 5.0, 9.0, 7.0, 20.0], "b": [5.0, 5.0], "c": [3.0], "d": [0.0, 4.0, 4.0]}
    rows = [(1, b, "turn", f"d{k // 2}", k // 2, 1, k % 2, v) for b, own in values.items() for k, v in enumerate(own)]
    rows += [(2, "a", "turn", "same", 0, 1, 0, v) for v in (1.0, 2.0, 3.0)]
    found = spark.createDataFrame(rows, "tender_id long, bidder_id string, criterion_id string, doc_id string, doc_pos long, pass int, match_pos int, value double")
    name = lambda r: f"{r[3]}#{r[5]}#{r[6]}"
    want = []
    for r in rows:
        own = [x for x in rows if x[:3] == r[:3]]
        clash = (r[0], r[1]) in {(1, "a"), (1, "d"), (2, "a")}
        others = [name(x) for x in own if x is not r] if clash else [None]
        want += [(*r[:4], r[5], r[6], o) for o in others]
    got = decide.cross_flags(found, block)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
