"""Rules from tender text, masking, repair and language, on literal cases."""

import random
import re
import statistics
import time

import pytest
from pyspark.sql import functions as F

from bidloom import queries_rollups
from bidloom.functions import text as T
from bidloom.operators import changes, criteria, rollups
from bidloom.sources import files


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("EMD Rs.5O,000", "EMD Rs.50,000"), ("turnover 1OO lakh", "turnover 100 lakh"), ("₹1O", "₹10"),
        ("hello world", "hello world"), ("10 OFF on selected items", "10 OFF on selected items"),
        ("ISO 9001 required", "ISO 9001 required"), ("Transformer 10O-1600 kVA", "Transformer 10O-1600 kVA"),
        ("part 3OEM supply", "part 3OEM supply"), ("1" + "O" * 300 + "5", "1" + "0" * 300 + "5"), ("OO5O.", "OO50."),
        ("5O/2", "5O/2"), ("₹O and 1o 2O-3 4o", "₹0 and 10 2O-3 40"), (None, None), ("", ""),
    ],
)
def test_ocr_repair(spark, text, want):
    assert value(spark, text, T.ocr_repair) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("PAN ABCDE1234F.", "PAN [PAN:******234F]."), ("22ABCDE1234F1Z5", "[GSTIN:***********F1Z5]"),
        ("id 9999 9999 0019", "id [AADHAAR:********0019]"), ("999999990019", "[AADHAAR:********0019]"),
        ("123456789012", "123456789012"), ("XABCDE1234F", "XABCDE1234F"), ("1999999990019", "1999999990019"), (None, None),
        ("id 999999990019 ref 9999999900195", "id [AADHAAR:********0019] ref 9999999900195"),
        ("९९९९ ९९९९ ००१९ x", "[AADHAAR:********००१९] x"), ("999999990019-999999990019", "[AADHAAR:********0019]-[AADHAAR:********0019]"),
    ],
)
def test_masking(spark, text, want):
    assert value(spark, text, T.redact) == want
    if want:
        assert value(spark, want, T.redact) == want


@pytest.mark.parametrize("text, want", [("hello", "en"), ("निविदा सूचना", "hi"), ("", "en"), ("Tender for supply of water pumps निविदा", "mixed")])
def test_language(spark, text, want):
    assert value(spark, text, lambda t: T.language(T.devanagari_ratio(t))) == want


def test_chunks(spark):
    text = "a" * 4500 + "\n" + "b" * 3000 + "\n" + "c" * 900 + "\n\nd"
    got = value(spark, text, T.chunks)
    assert all(len(x) <= 4000 for x in got) and "".join(got).replace("\n", "") == text.replace("\n", "")
    assert got[1:] == ["a" * 500 + "\n" + "b" * 3000, "c" * 900 + "\n\nd"]


@pytest.mark.parametrize("text, want", [
    ("\n\n" + "a" * 3000 + "\n" + "b" * 3000, ["a" * 3000, "b" * 3000]), ("\n\nshort", ["\n\nshort"]), ("", []), (None, None),
    ("a" * 4000, ["a" * 4000]), ("a" * 3999 + "\n\n", ["a" * 3999 + "\n"]), ("\n" * 5000, []),
])
def test_chunk_borders(spark, text, want):
    assert value(spark, text, T.chunks) == want


@pytest.mark.parametrize("text, want", [
    ('{"a": {"PAN": ["ABCDE1234F", 999999990019]}, "999999990019": "x \\" 999999990019"}',
     '{"a": {"PAN": ["[PAN:******234F]", 999999990019]}, "999999990019": "x \\" [AADHAAR:********0019]"}'),
    ('{"broken": ABCDE1234F', '{"broken": [PAN:******234F]'), ('"ABCDE1234F"', '"[PAN:******234F]"'), ("5", "5"), (None, None),
])
def test_masking_within_json(spark, text, want):
    assert value(spark, text, T.redact_json) == want


SAMPLE = """1. Annual turnover of at least Rs. 5 crore in any of the last three years.
2. Positive net worth.
EMD of Rs. 50,000 by draft. 4. Bank guarantee of Rs. 2 lakh.
5. Minimum 5 years of experience. 6. Completed 3 similar projects. 7. At least 25 employees.
8. ISO 9001 and ISO 14001. 9. Valid GST and PAN. 10. TDS deducted. 11. MSME preferred.
12. Bid validity: 90 days. 13. The bidder shall not be blacklisted."""


def test_sample_tender(spark):
    docs = spark.createDataFrame([(1, SAMPLE), (2, ""), (3, "नमस्ते"), (4, None)], "tender_id long, text string")
    got = criteria.extract(docs).collect()
    own = {r.field: r.value for r in got if r.tender_id == 1}
    assert own == {
        "annual_turnover": 5e7, "net_worth": 1e7, "emd_amount": 50000, "bank_guarantee": 2e5, "experience_years": 5,
        "similar_projects_count": 3, "manpower_count": 25, "iso_9001": 1, "iso_14001": 1, "gst_registration": 1,
        "pan_registration": 1, "tds_registration": 1, "msme_registration": 1, "bid_validity_days": 90,
        "blacklisting_declaration": 1,
    }
    assert [r.field for r in got if r.tender_id != 1] == ["generic_compliance"] * 3
    clause = next(r.source_clause for r in got if r.field == "iso_9001")
    assert "ISO 9001" in clause and len(clause) <= 400 and "\n" not in clause


@pytest.mark.parametrize("limit, offset, want", [(0, 0, 50), (500, 0, 200), (3, 250, 0), (10, 205, 5)])
def test_pages(spark, limit, offset, want):
    df = spark.range(210).withColumn("k", F.lit(1))
    assert changes.page(df, "k", ["id"], limit, offset).count() == want
    with pytest.raises(ValueError):
        changes.page(df, "k", ["id"], -1)


def test_page_totals_and_null_keys(spark):
    df = spark.createDataFrame([("a", k) for k in range(7)] + [(None, 9)], "k string, id int")
    got = sorted((r.k or "", r.id, r["rank"], r.total) for r in changes.page(df, "k", ["id"], 2, 1).collect())
    assert got == [("a", 1, 2, 7), ("a", 2, 3, 7)]
    assert [(r.k, r.total) for r in changes.page(df.filter("k is null"), "k", ["id"]).collect()] == [(None, 1)]
    assert "total" not in changes.page(df, "k", ["id"], total=False).columns


def test_patch_of_extras(spark):
    base = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {}), (3, None)], "id int, extras map<string,string>")
    patches = spark.createDataFrame([(1, 1, {"b": "x", "c": "y"}), (1, 2, {"b": None}), (2, 1, {"d": "z"})],
                                    "id int, v int, extras map<string,string>")
    got = {r.id: r.extras for r in changes.patch_extras(base, patches, "id", "v", "extras").collect()}
    assert got == {1: {"a": "1", "b": None, "c": "y"}, 2: {"d": "z"}, 3: None}


def test_references(spark):
    df = spark.createDataFrame([("s3:b:documents/1/a:b",), ("S3:b:k",), ("s3::k",), ("s3:b:",), ("x",)], "r string")
    got = [r[0] and tuple(r[0]) for r in df.select(files.split_ref(F.col("r"))).collect()]
    assert got == [("b", "documents/1/a:b"), ("b", "k"), None, None, None]


def test_latency_ranks(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 21)] + [("b", 5.0)], "k string, v double")
    got = {r.k: r for r in rollups.latency_summary(df, "v", "k").collect()}
    assert (got["a"].p95, got["a"].p99, got["a"].median, got["a"].mean) == (19.0, 20.0, 10.5, 10.5)
    assert got["b"].p99 == 5.0


def test_latency_ranks_of_many_signs_and_sizes(spark):
    rng = random.Random(5)
    rows = [(k, s, rng.choice([-1, 1]) * 10 ** rng.uniform(-4, 6) if rng.random() < 0.7 else 2.5)
            for k in "ab" for s in (200, 500) for _ in range(rng.randint(1, 400))]
    rows += [("a", 200, None), (None, 200, 1.0)]
    df = spark.createDataFrame(rows, "k string, s int, v double")
    got = rollups.latency_summary(df, "v", "k", "s").collect()
    assert len(got) == 4
    for r in got:
        own = sorted(v for k, s, v in rows if (k, s) == (r.k, r.s) and v is not None)
        assert (r.n, r.lowest, r.highest) == (len(own), own[0], own[-1])
        assert (r.p95, r.p99) == tuple(own[round((len(own) - 1) * p)] for p in (0.95, 0.99))
        assert r.median == round(statistics.median(own), 6)


def test_quality_by_way(spark):
    rows = [("a.pdf", "w" * 51, 0.1), ("a.pdf", " x ", 0.0), ("a.PNG", "x", 1.0), ("b.tif", "x", 0.0), ("c.doc", "x", 0.5)]
    got = rollups.text_quality(spark.createDataFrame(rows, "path string, text string, mean_confidence double")).collect()
    assert [(r.way, r.quality_score) for r in got] == [
        ("native", 0.95), ("scan", 0.35), ("image", 0.99), ("image", 0.3), ("none", 0.0)
    ]


def test_clause_and_value_are_read_at_the_match(spark):
    text = "x " * 500 + "Note: EMD\tof  Rs. 7,500 due." + " y" * 300
    got = criteria.extract(spark.createDataFrame([(1, text)], "tender_id long, text string")).collect()
    assert [(r.field, r.value, r.text_raw) for r in got] == [("emd_amount", 7500.0, "emd\tof  rs. 7,500")]
    assert got[0].source_clause == ("x " * 37 + "Note: EMD of Rs. 7,500 due." + " y" * 38).strip()


def test_payload_round_trip(spark):
    text = '{"tender_id":"t","criteria":[{"id":"c","field":"f","operator":">=","value":1}],"bidders":[{"bidder_id":"b","documents":[{"id":"d1","doc_type":"itr","ocr":{"quality_score":0.5,"text":"x"}},{"id":"d2"}]},{"bidder_id":"e","documents":[]}]}'
    got = files.read_payloads(spark.createDataFrame([(text,), ("{broken",), (None,)], "payload string")).collect()
    assert [(r.tender_id, r.n_criteria, r.bidder_id, r.doc_pos, r.doc_id, r.doc_type, r.quality_score, r.text) for r in got] == [
        ("t", 1, "b", 0, "d1", "itr", 0.5, "x"), ("t", 1, "b", 1, "d2", None, None, None),
    ]


def test_replaced_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, "old"), (1, 11, "old"), (2, 20, "old")], "tender_bucket int, id int, v string")
    files.write_tenders(rows, str(tmp_path / "t"))
    files.write_tenders(spark.createDataFrame([(1, 12, "new")], "tender_bucket int, id int, v string"), str(tmp_path / "t"))
    got = sorted((r.tender_bucket, r.id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert got == [(1, 12, "new"), (2, 20, "old")]


def test_every_pattern_names_its_words():
    """A text without any of a pattern's words is not searched, so each pattern of the rules has its own."""
    text = criteria.Found()
    criteria.every_rule(text)
    assert set(text.patterns) == set(criteria.WORDS)
    assert all(w in p.replace("(?:s)?", "") for p, words in criteria.WORDS.items() for w in words)


def test_strip_takes_white_space_of_any_kind(spark):
    """The same as a search for it, for every character, and in time that does not grow with the square of a gap."""
    rows = [(k, f"{chr(k)}a{chr(k)}b{chr(k)}{chr(k)}") for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000]
    rows += [(-1, ""), (-2, None), (-3, " \n\x85　"), (-4, "\r\n x  y\r\n")]
    df = spark.createDataFrame(rows, "k int, t string")
    searched = F.regexp_replace("t", r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    assert df.filter(~T.strip(F.col("t")).eqNullSafe(searched)).count() == 0
    wide = spark.range(4).select(F.concat(F.lit(" a"), F.repeat(F.lit(" "), 100_000), F.lit("b ")).alias("t"))
    before = time.monotonic()
    assert wide.agg(F.max(F.char_length(T.strip(F.col("t"))))).first()[0] == 100_002
    assert time.monotonic() - before < 30


def test_rules_are_worked_out_once_in_compiled_code(spark):
    """No lambda holds a search: what lambdas read is worked out without compiled code; each rule is a column before."""
    docs = spark.createDataFrame([(1, "Annual turnover of Rs. 5 crore. GST needed.")], "tender_id long, text string")
    df = criteria.extract(docs)
    assert [r.field for r in df.orderBy("pos").collect()] == ["annual_turnover", "gst_registration"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" in plan and not re.search(r"(?:filter|transform)\((?:array\()?CASE", plan)


def test_devanagari_ratio_counts_every_character(spark):
    """The same as counting matches; a plain text needs no search."""
    texts = ["", None, "plain 123", "123 .", "निविदा", "निविदा x १२", "é१ \U00010400\U0001F600a", "  ", "कa\nखb", "\u0964\u0970"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    count = lambda p: F.regexp_count("t", F.lit(p))
    counted = F.coalesce(F.try_divide(count(r"[\x{0900}-\x{097F}]"), count(r"[\p{L}\x{0900}-\x{097F}]")), F.lit(0.0))
    assert all(a == b for a, b in df.select(T.devanagari_ratio(F.col("t")), counted).collect())


def test_texts_are_judged_where_they_were_dealt_out(spark):
    """What is sent to a translator is chosen after tenders are dealt out, by as many tasks, and not in those that read a file."""
    plan = queries_rollups.criteria_translated(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = [x for part in plan.split("RepartitionByExpression")[1:] for x in part.split("Relation")[0].split("\n")]
    assert below and not [x for x in below if "regexp" in x]
