"""One decision per bidder and criterion, as one chain of conditions over joined frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from bidloom.functions import patterns as P
from bidloom.functions import text as T
from bidloom.operators import evidence as E
from bidloom.sources.plugins import Plugin, call
from bidloom.sources.shared import Workspace

PAIR = ["tender_id", "bidder_id", "criterion_id"]


def pairs(bidders: DataFrame, criteria: DataFrame) -> DataFrame:
    """Every bidder with every criterion of its tender."""
    left = bidders.select("tender_id", F.col("id").alias("bidder_id"))
    right = criteria.select(
        "tender_id", F.col("id").alias("criterion_id"), "field", "operator", "value", "priority",
        "semantic_ambiguity_score",
    )
    return left.join(right.withColumnRenamed("value", "target"), "tender_id")


def in_conflict(n: Column, top: Column, low: Column) -> Column:
    """Two or more values that differ by over a twentieth of the largest."""
    return (n >= 2) & F.when(top > 0, (top - low) / top > P.SPREAD).otherwise(F.abs(top - low) > P.SPREAD_ABSOLUTE)


def priority_list(priority: Column) -> Column:
    """Comma-separated document types as an array; blank is the supporting type alone."""
    return F.split(F.when(F.coalesce(priority, F.lit("")) == "", F.lit("supporting")).otherwise(priority), ",")


def priority_score(doc_type: Column, priority: Column) -> Column:
    """1 for the first expected type, less by a fifth of the place; 0.5 if it is not expected."""
    at = F.array_position(priority, doc_type)
    return F.when(at > 0, 1.0 - (at - 1) / F.greatest(F.size(priority), F.lit(1)) * 0.2).otherwise(0.5)


def confidence(ocr: Column, extraction: Column, priority: Column, penalty: Column) -> Column:
    w = P.WEIGHTS
    return ocr * w["ocr"] + extraction * w["extraction"] + priority * w["priority"] + (1.0 - penalty) * w["agreement"]


def passes(value: Column, operator: Column, target: Column) -> Column:
    near = F.abs(value - target) < 1e-6
    return (
        F.when(operator == ">=", value >= target).when(operator == "<=", value <= target)
        .when(operator == "==", near).when(operator == "!=", ~near).otherwise(False)
    )


def type_matches(doc_type: Column, priority: Column) -> Column:
    """Equal to, part of or containing an expected type, in either case."""
    dt = F.lower(doc_type)
    return (F.coalesce(doc_type, F.lit("")) != "") & F.exists(
        priority, lambda p: (p != "") & (dt.contains(F.lower(p)) | F.lower(p).contains(dt))
    )


def evidence_summary(found: DataFrame) -> DataFrame:
    """Count, extremes and best evidence of each pair; partial aggregation, no ordering of groups."""
    spi = priority_score(F.col("doc_type"), priority_list(F.col("priority")))
    conf = confidence(F.col("ocr_conf"), F.col("ext_conf"), spi, F.lit(0.0))
    # Highest confidence first, then document, pass and match order.
    rank = F.struct(conf.alias("conf"), (-F.col("doc_pos")).alias("d"), (-F.col("pass")).alias("p"), (-F.col("match_pos")).alias("m"))
    best = F.struct("doc_id", "doc_type", "value", "ocr_conf", "ext_conf", conf.alias("conf"), evidence_id().alias("best_id"), "raw")
    return found.groupBy(*PAIR).agg(
        F.count("*").alias("n"), F.max("value").alias("top"), F.min("value").alias("low"), F.max_by(best, rank).alias("best")
    )


def presence(pair_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """First document in order of an expected type, per pair of a boolean field; none: doc_type null."""
    asked = pair_rows.filter(F.col("field").isin(P.BOOL_FIELDS) & (F.coalesce("priority", F.lit("")) != ""))
    match = asked.select(*PAIR, "priority").join(docs.select("tender_id", "bidder_id", "doc_pos", "doc_type"), ["tender_id", "bidder_id"])
    match = match.filter(type_matches(F.col("doc_type"), F.split("priority", ",")))
    first = match.groupBy(*PAIR).agg(F.min(F.struct("doc_pos", "doc_type")).alias("first"))
    return asked.select(*PAIR).join(first, PAIR, "left").select(*PAIR, F.col("first.doc_type").alias("present_type"))


def cascade(rows: DataFrame) -> DataFrame:
    """Verdict, reason and confidence of joined rows: n, top, low, best, present_type and pair columns."""
    ocr, conf = F.col("best.ocr_conf"), F.col("best.conf")
    is_bool = F.col("field").isin(P.BOOL_FIELDS) & (F.coalesce("priority", F.lit("")) != "")
    known = F.col("field").isin(P.MONEY_FIELDS + P.COUNT_FIELDS + P.BOOL_FIELDS)
    ok = passes(F.col("best.value"), F.col("operator"), F.col("target"))
    none = F.coalesce("n", F.lit(0)) == 0
    reason = (
        F.when(~known, "NO_EVIDENCE")
        .when(none & is_bool & F.col("present_type").isNotNull(), "DOC_PRESENT")
        .when(none & is_bool, "DOC_MISSING")
        .when(none, "NO_EVIDENCE")
        .when(in_conflict(F.col("n"), F.col("top"), F.col("low")), "CONFLICT_DETECTED")
        .when(ocr < P.LEAST_OCR, "LOW_OCR_CONFIDENCE")
        .when((conf < P.LEAST_CONFIDENCE) | (F.coalesce("semantic_ambiguity_score", F.lit(0.0)) > P.MOST_AMBIGUITY), "LOW_CONFIDENCE")
        .when(ok, "MATCH").otherwise("REQUIREMENT_NOT_MET")
    )
    rows = rows.withColumn("reason", reason)
    r = F.col("reason")
    verdict = (
        F.when(r.isin("MATCH", "DOC_PRESENT"), "ELIGIBLE").when(r.isin("REQUIREMENT_NOT_MET", "DOC_MISSING"), "NOT_ELIGIBLE")
        .otherwise("NEEDS_REVIEW")
    )
    level = (
        F.when(r.isin("DOC_PRESENT", "DOC_MISSING"), F.lit(P.PRESENCE_CONFIDENCE)).when(r == "CONFLICT_DETECTED", P.CONFLICT_CONFIDENCE)
        .when(r == "LOW_OCR_CONFIDENCE", ocr).when(r == "LOW_CONFIDENCE", conf)
        .when(r == "NO_EVIDENCE", 0.0).otherwise(F.greatest(conf, F.lit(P.DECIDED_CONFIDENCE)))
    )
    return rows.withColumn("verdict", verdict).withColumn("confidence", level)


#: What a decision can carry of the evidence it rests on, for explanations in figures and in words.
FIGURES = ("ext_conf", "doc_id")
WORDS = (*FIGURES, "doc_type", "document", "best_id", "shown")


def judged_documents(bidders: DataFrame, criteria: DataFrame, docs: DataFrame, told: tuple[str, ...]) -> DataFrame:
    """What each document says on each criterion of its tender, and one row of each pair that says nothing.

    Columns: tender_id, bidder_id, ``k`` (place of the criterion among those of the tender), ``asked`` (the pair
    exists), n, top and low of the document's evidence, its ``best`` and ``present``, its place and type (true
    where they are not told) where its type is expected.  All evidence of a document has one type and one reading confidence, so its best is
    the one extracted most surely, first in pass and match order.

    Rows come to their tender once and are joined by it alone, with their texts; a text is searched after that,
    so that facts are neither moved nor sorted, and what says nothing of a criterion gives no row.  The rows that
    are grouped hold what decides and what is ``told`` of it, no more.
    """
    fields = E.asked_fields(criteria)
    extra = [c for c in ("doc_id", "document") if c in told]
    own = docs.select(*E.DOC, "text", *E.shown(docs)).select(
        "tender_id", "bidder_id", F.lit(None).cast("boolean").alias("asked"), "doc_pos", "doc_type", E.ocr_confidence(F.col("quality_score")).alias("ocr_conf"), "text", *extra,
    )
    who = bidders.select("tender_id", F.col("id").alias("bidder_id"), F.lit(True).alias("asked"))
    rows = E.said(own.unionByName(who, allowMissingColumns=True).join(E.rules_of(criteria), "tender_id"), fields)
    start = [F.left("text", F.lit(200)).alias("start")] if "shown" in told else []
    place = F.array_position(F.array(*map(F.lit, E.families(fields))).cast("array<string>"), F.col("rule.family")).cast("int")
    rows = rows.select("tender_id", "bidder_id", "asked", "doc_pos", "doc_type", "ocr_conf", "said", *extra, *start, F.posexplode("rules").alias("k", "rule"))
    said = F.when(F.col("asked").isNull(), F.get("said", place - 1))
    boolean = F.col("rule.field").isin(P.BOOL_FIELDS) & (F.coalesce("rule.priority", F.lit("")) != "")
    expected = F.coalesce(F.col("asked").isNull() & boolean & type_matches(F.col("doc_type"), F.col("rule.types")), F.lit(False))
    rows = rows.withColumn("s", said).withColumn("expected", expected)
    rows = rows.filter(F.col("asked") | F.col("s").isNotNull() | F.col("expected"))

    b = F.col("s.surest")
    conf = confidence(F.col("ocr_conf"), b["e"], priority_score(F.col("doc_type"), F.col("rule.types")), F.lit(0.0))
    more = {
        "ext_conf": b["e"], "doc_id": F.col("doc_id") if extra else None, "doc_type": F.col("doc_type"), "document": F.col("document") if "document" in extra else None,
        "best_id": F.concat_ws("#", "doc_id", (-b["p"]).cast("string"), (-b["m"]).cast("string")) if extra else None,
        "shown": F.left(F.coalesce(b["raw"], "start"), F.lit(200)) if start else None,
    }
    best = F.struct(
        conf.alias("conf"), (-F.col("doc_pos")).alias("d"), b["p"].alias("p"), b["m"].alias("m"), b["v"].alias("value"), "ocr_conf", *[more[c].alias(c) for c in told]
    )
    # Which document is present matters only where it is told.
    present = F.struct("doc_pos", "doc_type") if "doc_type" in told else F.lit(True)
    return rows.select(
        "tender_id", "bidder_id", "k", "asked", F.coalesce("s.n", F.lit(0)).alias("n"), F.col("s.top").alias("top"), F.col("s.low").alias("low"),
        F.when(F.col("s").isNotNull(), best).alias("best"), F.when(F.col("expected"), present).alias("present"),
    )


def decide(bidders: DataFrame, criteria: DataFrame, docs: DataFrame, told: tuple[str, ...] = WORDS) -> DataFrame:
    """All decisions.  ``docs`` has tender_id, bidder_id, doc_id, doc_pos, doc_type, quality_score, text.

    Everything is joined and grouped by tender, so rows move once; ``told`` names what explanations need.
    """
    said = judged_documents(bidders, criteria, docs, told).groupBy("tender_id", "bidder_id", "k").agg(
        F.max("asked").alias("asked"), F.sum("n").alias("n"), F.max("top").alias("top"), F.min("low").alias("low"),
        F.max("best").alias("best"), F.min("present").alias("present"),
    ).filter("asked")
    rows = said.join(E.rules_of(criteria), "tender_id").withColumn("rule", F.get("rules", F.col("k")))
    return cascade(rows.select(
        "tender_id", "bidder_id", *[f"rule.{c}" for c in ("criterion_id", "field", "operator", "target", "priority", "semantic_ambiguity_score")],
        "n", "top", "low", "best", (F.col("present.doc_type") if "doc_type" in told else F.col("present")).alias("present_type"),
    ))


def model_context(docs: DataFrame, criteria: DataFrame, most_docs: int = 8, per_doc: int = 12_000, most: int = 180_000) -> DataFrame:
    """Text that a model reads per bidder and criterion: tender_id, bidder_id, criterion_id, context.

    Of the first ``most_docs`` documents of a bidder, each gives a headed snippet: the lines that
    hold a word of the criterion's field (three letters or more), or its text where none does, up
    to ``per_doc`` characters.  Snippets are joined in order until ``most`` characters are used.

    Rows are joined by tender alone, so texts stay where they are.  A text is split into lines once, and the
    words of each criterion of its tender look through them; each context is made from the bidder's row.
    """
    order = W.partitionBy("tender_id", "bidder_id").orderBy("doc_pos")
    doc = F.struct("filename", "text")
    # The first row of a bidder holds its documents, ``most_docs`` at most.
    first = docs.select("tender_id", "bidder_id", F.row_number().over(order).alias("k"), F.collect_list(doc).over(order.rowsBetween(0, most_docs - 1)).alias("docs"))
    own = first.filter("k = 1 and bidder_id is not null").select("tender_id", "bidder_id", F.filter("docs", lambda d: F.coalesce(d["text"], F.lit("")) != "").alias("docs"))

    def lines(d: Column) -> Column:
        each = F.transform(F.split(d["text"], r"\r\n|\r|\n"), lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))
        head = F.concat(F.lit("\n--- Document: "), d["filename"], F.lit(" ---\n"))
        return F.struct(head.alias("head"), d["text"].alias("text"), each.alias("lines"))

    own = own.filter(F.size("docs") > 0).select("tender_id", "bidder_id", F.explode_outer(F.array(F.transform("docs", lines))).alias("docs"))
    words = F.filter(F.split(F.trim(F.lower(F.coalesce("field", F.lit("")))), r"[_\s\-]+"), lambda w: F.char_length(w) >= 3)
    asked = criteria.groupBy("tender_id").agg(F.collect_list(F.struct(F.col("id").alias("criterion_id"), words.alias("words"))).alias("asked"))
    rows = own.join(asked, "tender_id").select("tender_id", "bidder_id", "docs", F.explode("asked").alias("a"))

    def snippet(d: Column) -> Column:
        held = F.filter(d["lines"], lambda x: F.exists("a.words", lambda w: x["low"].contains(w)))
        # Lines that hold a word are not empty.
        chosen = F.transform(F.array(F.array_join(held["line"], "\n")), lambda c: F.when(c != "", c).otherwise(d["text"]))
        return F.concat(d["head"], F.left(F.get(chosen, F.lit(0)), F.lit(per_doc)), F.lit("\n"))

    context = F.left(F.array_join(F.transform("docs", snippet), ""), F.lit(most))
    return rows.select("tender_id", "bidder_id", F.col("a.criterion_id").alias("criterion_id"), context.alias("context"))


def model_prompts(contexts: DataFrame, criteria: DataFrame) -> DataFrame:
    """The question to a model about each context: the rule, the form of the answer, and the documents."""
    rule = criteria.select("tender_id", F.col("id").alias("criterion_id"), "field", "text_raw", "operator", T.python_float(F.col("value")).alias("v"))
    ask = F.concat_ws(
        "\n", F.lit("Is this requirement of a tender met by the documents of a bidder?"), F.concat(F.lit("Field: "), F.coalesce("field", F.lit(""))),
        F.concat(F.lit("Label: "), F.coalesce("text_raw", F.lit(""))), F.concat(F.lit("Requirement: "), F.coalesce("operator", F.lit("")), F.lit(" "), F.coalesce("v", F.lit(""))),
        F.lit('Answer with a JSON object only: "verdict" (ELIGIBLE, NOT_ELIGIBLE or NEEDS_REVIEW), "reason", "confidence" (0 to 1), "reasoning".'),
        F.lit("Documents:"), "context",
    )
    return contexts.join(rule, ["tender_id", "criterion_id"]).select(*PAIR, ask.alias("prompt"))


def model_decisions(prompts: DataFrame, make: Plugin, batch: int = 8) -> DataFrame:
    """What a model decides: pair, verdict, reason, confidence, reasoning.

    A call that fails, or an answer without a JSON object, needs review, with confidence 0 and the
    reason ``LLM_FAILURE`` or ``PARSE_ERROR``; the others keep what the answer says.
    """
    asked = call(prompts.repartition(*PAIR), make, "prompt", answer="reply", batch=batch).select(*PAIR, "reply", "failure")
    v = F.try_parse_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0))
    failed, broken = F.col("failure").isNotNull(), v.isNull()
    said = lambda k, kind, lost, unread: (
        F.when(failed, lost).when(broken, unread).otherwise(F.try_variant_get(v, f"$.{k}", kind)).alias(k)
    )
    review = F.lit("NEEDS_REVIEW")
    message = F.concat(F.lit("LLM evaluation failed: "), F.regexp_replace("failure", r"^\w+: ", ""))
    return asked.select(
        *PAIR, said("verdict", "string", review, review), said("reason", "string", F.lit("LLM_FAILURE"), F.lit("PARSE_ERROR")),
        said("confidence", "double", F.lit(0.0), F.lit(0.0)), said("reasoning", "string", message, F.lit("Could not parse LLM response.")),
    )


def model_reply(reply: Column) -> Column:
    """verdict and reason of a model's reply: its outermost braces must hold a JSON object."""
    block = F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    get = lambda k, other: F.when(block.isNull(), other).otherwise(F.try_variant_get(block, f"$.{k}", "string")).alias(k)
    return F.struct(get("verdict", "NEEDS_REVIEW"), get("reason", "PARSE_ERROR"))


def explain(rows: DataFrame) -> DataFrame:
    """Explanation columns of ``cascade`` rows, as numbers where text would depend on formatting."""
    r = F.col("reason")
    extraction = (
        F.when(r == "NO_EVIDENCE", F.lit(1.0)).when(r == "CONFLICT_DETECTED", 0.0)
        .when(r == "LOW_OCR_CONFIDENCE", 1.0 - F.col("best.ocr_conf"))
        .when(r == "LOW_CONFIDENCE", F.greatest(F.lit(0.0), 0.9 - F.col("best.ext_conf")))
        .when(r.isin("MATCH", "REQUIREMENT_NOT_MET"), 0.05)
    )
    has_best = r.isin("MATCH", "REQUIREMENT_NOT_MET", "LOW_CONFIDENCE", "LOW_OCR_CONFIDENCE")
    return rows.select(
        *PAIR, "reason", F.coalesce("n", F.lit(0)).alias("evidence_count"), extraction.alias("ambiguity_extraction"),
        F.when(extraction.isNotNull(), F.col("semantic_ambiguity_score")).alias("ambiguity_semantic"),
        F.when(extraction.isNotNull(), (r == "CONFLICT_DETECTED").cast("double")).alias("ambiguity_conflict"),
        F.when(has_best, F.col("best.doc_id")).alias("source_doc"),
        F.when(has_best, F.col("best.value")).alias("extracted"),
        (F.col("verdict") == "NEEDS_REVIEW").alias("reviewer_required"),
    )


def evidence_id() -> Column:
    """Name of an evidence row among those of its pair."""
    return F.concat_ws("#", "doc_id", F.col("pass").cast("string"), F.col("match_pos").cast("string"))


def in_order() -> WindowSpec:
    """Evidence of a pair in document and match order; windows over all of it share one sort."""
    return W.partitionBy(*PAIR).orderBy("doc_pos", "pass", "match_pos")


def with_spread(found: DataFrame) -> DataFrame:
    """Evidence with the count and extremes (n, top, low) of its pair, which it is never joined for."""
    pair = in_order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return found.withColumns({"n": F.count("*").over(pair), "top": F.max("value").over(pair), "low": F.min("value").over(pair)})


def conflicting(found: DataFrame) -> DataFrame:
    """Evidence of the pairs that are in conflict, with its count and extremes."""
    return with_spread(found).filter(in_conflict(F.col("n"), F.col("top"), F.col("low")))


def conflict_snapshots(found: DataFrame, most: int = 4) -> DataFrame:
    """First evidence rows (``k`` from 1) of each conflicting pair, in document and match order."""
    rows = with_spread(found).withColumn("k", F.row_number().over(in_order()))
    return rows.filter((F.col("k") <= most) & in_conflict(F.col("n"), F.col("top"), F.col("low")))


def conflict_classes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(classes, members)``: each conflicting pair with its size, and the ids of its evidence, one a row, with it.

    All evidence of such a pair contradicts the others of it, so the ids that an evidence row is in
    conflict with are the other members of its class, by one join.
    """
    n = found.groupBy(*PAIR).agg(F.count("*").alias("n"), F.max("value").alias("top"), F.min("value").alias("low"))
    classes = n.filter(in_conflict(F.col("n"), F.col("top"), F.col("low"))).select(*PAIR, "n")
    return classes, conflicting(found).select(*PAIR, "n", evidence_id().alias("evidence_id"))


def conflicts_of(evidence: DataFrame, members: DataFrame) -> DataFrame:
    """Of each given evidence row (pair and evidence_id) the ids it is in conflict with, one a row."""
    other = members.select(*PAIR, F.col("evidence_id").alias("conflicts_with"))
    return evidence.select(*PAIR, "evidence_id").join(other, PAIR).filter("evidence_id <> conflicts_with")


def conflicts_of_first(found: DataFrame) -> DataFrame:
    """Of the first amount of each pair's first document the ids it is in conflict with, one a row.

    One pass: the first evidence is known to all of its pair, as their count and extremes are.
    """
    pair = in_order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.min(F.struct("doc_pos", "doc_id", "pass", "match_pos")).over(pair)
    rows = with_spread(found).withColumn("first", first).filter(in_conflict(F.col("n"), F.col("top"), F.col("low")))
    rows = rows.filter("first.pass = 1 and first.match_pos = 0")
    out = rows.select(*PAIR, F.concat("first.doc_id", F.lit("#1#0")).alias("evidence_id"), evidence_id().alias("conflicts_with"))
    return out.filter("evidence_id <> conflicts_with")


def cross_flags(found: DataFrame, block: int = 256) -> DataFrame:
    """Every evidence row with the ids of the others it conflicts with, one a row; null where there is none.

    Evidence is made once.  That of a pair of up to ``block`` rows meets where it lies.  Larger pairs in conflict are written
    as they are, numbered and cut into blocks, of which two meet at a time: no list holds more than some ``2 * block``
    ids, however many contradict each other, and the groups of a pair are dealt out.
    """
    near = F.collect_list(F.struct("k", "doc_id", "pass", "match_pos")).over(in_order().rowsBetween(-block, block))
    rows = with_spread(found).withColumn("k", F.row_number().over(in_order()) - 1).withColumn("near", near)
    clash = F.coalesce(in_conflict(F.col("n"), F.col("top"), F.col("low")), F.lit(False))
    others = F.filter("near", lambda y: y["k"] != F.col("k"))
    large = clash & (F.col("n") > block)
    out = rows.select(*PAIR, "doc_id", "pass", "match_pos", "k", "n", large.alias("large"), F.explode_outer(F.when(clash & ~large, others)).alias("y"))
    named = lambda x: F.concat(x["doc_id"], F.lit("#"), x["pass"], F.lit("#"), x["match_pos"]).alias("conflicts_with")
    own = [*PAIR, "doc_id", "pass", "match_pos"]
    out = out.select(*own, named(F.col("y")), *[F.when(F.col("large"), F.col(c)).alias(c) for c in ("k", "n")])
    out = Workspace(found.sparkSession).write(out, "flags")

    mine = F.floor(F.col("k") / block).cast("int")
    blocks = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))
    met = out.filter("k is not null").select(*own, "k", mine.alias("mine"), F.explode(blocks).alias("other"))
    met = met.select(*own, "k", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    met = met.groupBy(*PAIR, "i", "j").agg(F.collect_list(F.struct("k", "mine", "doc_id", "pass", "match_pos")).alias("items"))
    met = met.select(*PAIR, "i", "j", "items", F.explode("items").alias("x"))
    rest = F.filter("items", lambda y: (y["k"] != F.col("x.k")) & ((F.col("i") == F.col("j")) | (y["mine"] != F.col("x.mine"))))
    met = met.select(*PAIR, "x.doc_id", "x.pass", "x.match_pos", F.explode(rest).alias("y")).select(*own, named(F.col("y")))
    return out.filter("k is null").drop("k", "n").unionByName(met)


def explanations(rows: DataFrame, found: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """What is told of each decision: reasoning, mode, evidence_used, snapshot, snapshots and trace.

    ``rows`` are those of ``cascade``, ``found`` their evidence.  Both carry the name and the start of the
    document they rest on, so ``docs`` is not read again.  Decisions meet the first evidence of those in
    conflict by grouping, which leaves the rows of a tender where they are.
    """
    raw = F.left(F.coalesce("raw", "start"), F.lit(200))
    first = conflict_snapshots(found)
    first = first.select(*PAIR, F.struct("k", evidence_id().alias("id"), "document", "doc_type", F.col("value").alias("normalized_value"), raw.alias("raw_text")).alias("s"))
    # Four rows of bounded length meet here at most.
    first = first.groupBy(*PAIR).agg(F.sort_array(F.collect_list("s")).alias("first"))
    told = F.struct("reason", "field", "operator", "target", "priority", "n", "present_type", "confidence", "semantic_ambiguity_score", "verdict", "best")
    both = rows.select(*PAIR, told.alias("told")).unionByName(first, allowMissingColumns=True)
    both = both.groupBy(*PAIR).agg(F.max("told").alias("told"), F.max("first").alias("first")).filter("told is not null")
    best = both.select(*PAIR, "told.*", "first").select("*", "best.*").drop("best")
    r, number = F.col("reason"), T.python_float
    wanted = F.concat(F.lit("["), F.array_join(F.transform(F.split("priority", ","), lambda p: F.concat(F.lit("'"), p, F.lit("'"))), ", "), F.lit("]"))
    values = F.array_join(F.transform(F.slice("first", 1, 3), lambda s: T.format_inr(s["normalized_value"])), " vs ")
    known = F.col("field").isin(P.MONEY_FIELDS + P.COUNT_FIELDS + P.BOOL_FIELDS)
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    target, value = number(F.coalesce("target", F.lit(0.0))), number(F.col("value"))
    reasoning = (
        F.when(~known, "Unknown field with no documents matching expected types.")
        .when(r == "DOC_MISSING", say("No document of type matching ", wanted, " provided by bidder."))
        .when(r == "DOC_PRESENT", say("Document of type '", F.col("present_type"), "' satisfies presence requirement (expected one of ", wanted, ")."))
        .when(r == "NO_EVIDENCE", "No evidence extracted for this criterion.")
        .when(r == "CONFLICT_DETECTED", say("Conflicting ", F.col("field"), " values detected across documents: ", values,
                                            ". Cannot auto-decide — requires officer verification."))
        .when(r == "LOW_OCR_CONFIDENCE", "OCR confidence below threshold.")
        .when(r == "LOW_CONFIDENCE", say(F.col("operator"), " ", target, "; extracted ", value, " but confidence/ambiguity requires review."))
        .otherwise(say(F.col("field"), " requires ", F.col("operator"), " ", target, ". Extracted ", value, " from ", F.col("document"), "."))
    )
    decided, present = r.isin("MATCH", "REQUIREMENT_NOT_MET"), r.isin("DOC_PRESENT", "DOC_MISSING")
    used = F.when(r == "CONFLICT_DETECTED", F.col("first")[0]["id"]).when(decided | r.isin("LOW_OCR_CONFIDENCE", "LOW_CONFIDENCE"), F.col("best_id"))
    snapshot = F.struct(
        F.when(decided, F.col("document")).alias("document"),
        F.when(decided, F.col("shown")).alias("extracted_value"),
        F.when(decided, F.col("value")).alias("normalized_value"), F.when(decided, F.col("ocr_conf")).alias("ocr_confidence"),
        F.when(r == "DOC_PRESENT", F.col("present_type")).alias("doc_type"),
    )
    only = lambda cond, c: F.when(cond, c)
    trace = F.struct(
        F.when(present, "deterministic_doc_presence").otherwise("deterministic").alias("mode"), "field",
        only(known & r.isin("NO_EVIDENCE", "CONFLICT_DETECTED"), F.coalesce("n", F.lit(0))).alias("evidence_count"),
        only(r == "LOW_OCR_CONFIDENCE", F.col("ocr_conf")).alias("ocr_confidence"),
        only(r == "LOW_CONFIDENCE", F.col("conf")).alias("overall_confidence"),
        only(decided, F.col("operator")).alias("operator"), only(decided, F.coalesce("target", F.lit(0.0))).alias("target"),
        only(decided, F.col("value")).alias("extracted"), only(decided, F.col("document")).alias("source_doc"),
        only(present, F.split("priority", ",")).alias("expected_doc_types"), only(present, r == "DOC_PRESENT").alias("found"),
        only(~known, F.lit("no_signal_no_llm")).alias("fallback"),
    )
    conflict = r == "CONFLICT_DETECTED"
    snapshots = F.when(conflict, F.transform("first", lambda s: s.dropFields("k", "id")))
    return best.select(
        *PAIR, "field", "verdict", "reason", "confidence", reasoning.alias("reasoning"), used.alias("evidence_used"), F.when(decided | (r == "DOC_PRESENT"), snapshot).alias("snapshot"),
        snapshots.alias("snapshots"), trace.alias("trace"),
    )


def well_formed(changes: DataFrame) -> DataFrame:
    """Changes with a known verdict and a justification of 10 to 4000 characters."""
    return changes.withColumn("verdict", F.upper(F.trim("verdict"))).filter(
        F.col("verdict").isin("ELIGIBLE", "NOT_ELIGIBLE", "NEEDS_REVIEW")
        & F.char_length(F.trim("justification")).between(10, 4000)
    )


def accepted(changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Well-formed changes of an existing decision."""
    return well_formed(changes).join(decisions.select(*PAIR), PAIR, "left_semi")


def latest_override(changes: DataFrame) -> DataFrame:
    """The last well-formed change of each key: keys and the struct ``o``.  Joined to decisions, it is the last accepted one."""
    rest = F.struct("verdict", "officer_id", "justification")
    return well_formed(changes).groupBy(*PAIR).agg(F.max_by(rest, "version").alias("o"))


def override(decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """Decisions with the latest accepted override of each; ``override_by`` is null where none applies."""
    return decisions.join(latest_override(changes), PAIR, "left").select(
        *[c for c in decisions.columns if c != "verdict"],
        F.coalesce("o.verdict", "verdict").alias("verdict"), F.col("o.officer_id").alias("override_by"),
    )


def overridden(decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """The changed decisions only: keys, the new payload as JSON with sorted keys, and its checksum."""
    rows = decisions.drop("verdict").join(latest_override(changes), PAIR)
    fields = {c: F.col(c) for c in rows.columns if c != "o"} | {
        "verdict": F.col("o.verdict"), "reviewer_override": F.col("o.justification"), "override_by": F.col("o.officer_id"),
    }
    payload = F.to_json(F.struct(*[fields[c].alias(c) for c in sorted(fields)]))
    return rows.select(*PAIR, payload.alias("payload")).withColumn("checksum", T.checksum(F.col("payload")))


def close_items(items: DataFrame, done: DataFrame) -> DataFrame:
    """Review items with ``status``: resolved where ``done`` has a change of their decision."""
    closed = done.select(*PAIR).distinct().withColumn("closed", F.lit(True))
    status = F.when(F.col("closed"), "resolved").otherwise("open")
    return items.join(closed, PAIR, "left").withColumn("status", status).drop("closed")


def override_audit(done: DataFrame) -> DataFrame:
    """An audit row for every accepted change; what officers typed is masked before it is stored."""
    payload = F.to_json(F.struct("bidder_id", "criterion_id", "justification", F.col("verdict").alias("new_verdict"), "tender_id"))
    rows = done.select("tender_id", F.col("officer_id").alias("user_id"), F.lit("reviewer.override").alias("action"),
                       T.redact_json(payload).alias("payload"))
    return rows.withColumn("checksum", T.checksum(F.col("payload")))
