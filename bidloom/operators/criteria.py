"""Tender text to rule rows: a table of emitters, each a column expression over the text.

Patterns run on the lower-cased text; a clause is cut from the original at the same offsets.
Digits are Unicode digits, as the rules have it.

Each pattern looks through a text once: a first projection finds where it matches, a second reads the
match there, however long it is, a third its groups and a fourth the numbers in them, so that rules
only name columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import patterns as P
from bidloom.functions import text as T
from bidloom.operators.evidence import amount_inr, number_of

_U = "(?U)"
RULE = (
    "struct<field: string, operator: string, value: double, unit: string, mandatory: boolean, priority: string, "
    "extraction_confidence: double, semantic_ambiguity_score: double, text_raw: string, source_clause: string, "
    "temporal: struct<type: string, n: int, anchor: string>, depends_on: string>"
)

# Fixed values -------------------------------------------------------------------------------
#: Amount rules: field, words before the amount, priority, confidence, ambiguity, and the presence rule
#: (pattern, raw text, value, confidence, ambiguity) that holds where no amount follows.
AMOUNT_RULES = [
    ("annual_turnover", r"turnover", "ca_certificate,audited_balance_sheet,itr", 0.78, 0.12, None),
    ("net_worth", r"net\s*worth", "audited_balance_sheet,ca_certificate", 0.6, 0.2,
     (r"positive\s*net\s*worth", "Positive net worth requirement", 1e7, 0.6, 0.2)),
    ("emd_amount", r"(?:earnest\s*money(?:\s*deposit)?|\bemd\b|bid\s*security)", "bank_statement,supporting", 0.7, 0.2,
     (r"\bemd\b|earnest\s*money|bid\s*security", "EMD / bid security", 0.0, 0.5, 0.35)),
    ("bank_guarantee", r"bank\s*guarantee", "bank_guarantee,supporting", 0.72, 0.18,
     (r"\bbank\s*guarantee\b|\bperformance\s*(?:bank\s*)?guarantee\b|\bpbg\b", "Bank guarantee required", 0.0, 0.55, 0.3)),
]
EXPERIENCE = (r"(\d+)\s*(?:\+|or\s*more)?\s*(?:years?|yrs?)\s*(?:of)?\s*"
              r"(?:experience|relevant\s*experience|professional\s*experience)")  # fmt: skip
EXPERIENCE_WORDS = r"\b(?:relevant\s+)?experience\b|past\s*performance|similar\s*work"
PROJECTS = r"(\d+)\s*(?:similar|completed)?\s*projects?\s*(?:of\s*similar\s*nature)?"
MANPOWER = (r"(\d+)\s*(?:\+|or\s*more)?\s*(?:full[-\s]*time\s*)?"
            r"(?:employees?|engineers?|technical\s*staff|manpower|professionals?|personnel)")  # fmt: skip
VALIDITY = [(r"bid\s*validity[^\n\d]{0,30}(\d{2,4})\s*(?:days?|d)?", 0.78, 0.1),
            (r"validity\s*of\s*bid[^\n\d]{0,30}(\d{2,4})\s*(?:days?|d)?", 0.75, 0.12)]
#: Fields whose figures are of certain years: type, number of years, day from which they count.
TEMPORAL = {"annual_turnover": ("any_of_last_n_years", 3, "tender_date"), "similar_projects_count": ("last_n_years", 5, None)}
#: Presence rules: field, test, pattern of the clause, raw text, mandatory, priority, confidence, ambiguity.
PRESENCE_RULES = [
    ("iso_9001", r"iso[\s\-]*9001", None, "ISO 9001 certification (quality management)", False, "iso_certificate", 0.88, 0.08),
    ("iso_14001", r"iso[\s\-]*14001", None, "ISO 14001 certification (environment)", False, "iso_certificate", 0.88, 0.08),
    ("iso_27001", r"iso[\s\-]*27001", None, "ISO 27001 certification (information security)", False, "iso_certificate", 0.88, 0.08),
    ("nabl_accreditation", r"\bnabl\b|nabl\s*accredit", r"\bnabl\b", "NABL accreditation", False, "nabl_certificate", 0.85, 0.1),
    ("gst_registration", r"gst|goods and services tax", r"\bgst\b|goods and services tax", "Valid GST registration", True,
     "gst_certificate,itr", 0.9, 0.05),
    ("pan_registration", r"\bpan\b|permanent account number", None, "PAN registration", True, "pan_certificate,itr", 0.88, 0.05),
    ("tds_registration", r"\btds\b|tax deducted at source|tan\s*number", None, "TDS / TAN compliance", False,
     "tds_certificate,itr", 0.78, 0.12),
    ("msme_registration", r"\bmsme\b|udyam|udyog\s*aadhar|micro,?\s*small\s*and\s*medium", None, "MSME / Udyam registration",
     False, "msme_certificate,udyam_certificate", 0.82, 0.1),
]
BLACKLIST = ("blacklisting_declaration", r"black[\s\-]*list|debar(?:red|ment)|not\s*black[\s\-]*listed", None,
             "Non-blacklisting / non-debarment declaration", True, "affidavit,undertaking,supporting", 0.75, 0.15)
#: Words of which one is in every match of a pattern: texts without any are not searched for it.
WORDS = {
    r"turnover[^\n\d]{0,40}" + P.AMOUNT: ("turnover",), r"net\s*worth[^\n\d]{0,40}" + P.AMOUNT: ("worth",),
    AMOUNT_RULES[2][1] + r"[^\n\d]{0,40}" + P.AMOUNT: ("earnest", "emd", "security"), r"bank\s*guarantee[^\n\d]{0,40}" + P.AMOUNT: ("guarantee",),
    AMOUNT_RULES[1][5][0]: ("positive",), AMOUNT_RULES[2][5][0]: ("earnest", "emd", "security"), AMOUNT_RULES[3][5][0]: ("guarantee", "pbg"),
    EXPERIENCE: ("experience",), EXPERIENCE_WORDS: ("experience", "performance", "work"), PROJECTS: ("project",),
    MANPOWER: ("employee", "engineer", "staff", "manpower", "professional", "personnel"),
    VALIDITY[0][0]: ("validity",), VALIDITY[1][0]: ("validity",),
    **{r[1]: w for r, w in zip(PRESENCE_RULES, [
        ("9001",), ("14001",), ("27001",), ("nabl",), ("gst", "goods"), ("pan", "permanent"), ("tds", "tax", "tan"),
        ("msme", "udyam", "udyog", "micro")], strict=True)},
    r"\bnabl\b": ("nabl",), r"\bgst\b|goods and services tax": ("gst", "goods"), BLACKLIST[1]: ("black", "debar"),
}
# --------------------------------------------------------------------------------------------


def apart(name: str) -> Column:
    """A column as it is, by a lambda.

    The projection that holds it is compiled as many small methods.  Within a stage it would be one method, and one
    this long is never compiled by the JVM, which then interprets it.
    """
    return F.get(F.transform(F.array(name), lambda x: x), F.lit(0)).alias(name)


class Found:
    """A text column, the places at which patterns match in it, and the matches."""

    def __init__(self, text: str = "text"):
        self.raw, self.low, self.patterns, self.groups, self.numbers = F.col(text), F.col("_low"), {}, {}, {}

    def _number(self, pattern: str) -> int:
        return self.patterns.setdefault(pattern, len(self.patterns))

    def at(self, pattern: str) -> Column:
        """Where the pattern matches first, from 1; 0 if nowhere."""
        return F.col(f"_at{self._number(pattern)}")

    def hit(self, pattern: str) -> Column:
        return self.at(pattern) > 0

    def whole(self, pattern: str) -> Column:
        """The first match; null if there is none."""
        return F.col(f"_match{self._number(pattern)}")

    def group(self, pattern: str, group: int) -> Column:
        """A group of the first match, read from the match alone."""
        name = f"_group{self._number(pattern)}_{group}"
        self.groups[name] = self._search(lambda p: F.regexp_extract(self.whole(pattern), p, group), f"^(?:{pattern})")
        return F.col(name)

    @staticmethod
    def _search(search, pattern: str) -> Column:
        """A search by Unicode's classes; those of ASCII say the same of a text that is plain, and are found faster."""
        return F.when(F.col("_plain"), search(pattern)).otherwise(search(_U + pattern))

    def number(self, pattern: str) -> Column:
        """The first group as a number."""
        name = f"_value{self._number(pattern)}"
        self.numbers[name] = number_of(self.group(pattern, 1))
        return F.col(name)

    def amount(self, pattern: str) -> Column:
        """The first two groups as rupees."""
        name = f"_amount{self._number(pattern)}"
        self.numbers[name] = amount_inr(self.group(pattern, 1), self.group(pattern, 2))
        return F.col(name)

    def clause(self, pattern: str, around: int = 80, most: int = 400) -> Column:
        """The original text from 80 characters before the match to 80 after it, white space collapsed."""
        at = self.at(pattern) - 1
        start = F.greatest(F.lit(0), at - around)
        cut = F.substr(self.raw, start + 1, at + F.char_length(self.whole(pattern)) + around - start)
        return F.when(self.hit(pattern), F.left(F.trim(self._search(lambda p: F.regexp_replace(cut, p, " "), r"\s+")), F.lit(most)))

    def locate(self, docs: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
        """``keys``, the text, and the places and matches of all patterns asked for so far."""
        low = F.lower(text)
        # Places count characters where the pattern functions count code units; no rule has a character of two units.
        low = F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.regexp_replace(low, r"[\x{10000}-\x{10FFFF}]", "\ufffd"))
        plain = (F.octet_length(text) == F.char_length(text)) & (F.octet_length("_low") == F.char_length("_low"))

        def place(p: str) -> Column:
            first = self._search(lambda x: F.regexp_instr("_low", F.lit(x)), p)
            words = [F.col("_low").contains(w) for w in WORDS.get(p, ())]
            return F.coalesce(F.when(reduce(lambda a, b: a | b, words), first) if words else first, F.lit(0))

        at = {f"_at{k}": place(p) for p, k in self.patterns.items()}
        read = {
            f"_match{k}": F.when(self.hit(p), self._search(lambda x, p=p: F.regexp_extract(F.substr(self.low, self.at(p)), x, 0), f"^(?:{p})"))
            for p, k in self.patterns.items()
        }
        found = docs.select(*keys, F.col(text).alias(text), low.alias("_low")).withColumn("_plain", plain)
        for more in (at, read, self.groups, self.numbers):
            found = found.withColumns(more | {"_plain": apart("_plain")}) if more else found
        return found


def source_clause(docs: DataFrame, pattern: str, key: str = "tender_id") -> DataFrame:
    """The clause around the first match of one pattern, null where there is none."""
    found = Found()
    clause = found.clause(pattern)
    return found.locate(docs, (key,)).select(key, clause.alias("clause"))


def temporal(field) -> Column:
    kind, n, anchor = TEMPORAL.get(field, (None, None, None)) if isinstance(field, str) else (None, None, None)
    made = F.struct(F.lit(kind).cast("string").alias("type"), F.lit(n).cast("int").alias("n"), F.lit(anchor).cast("string").alias("anchor"))
    return F.when(F.lit(kind is not None), made).alias("temporal")


def _rule(cond, field, operator, value, unit, mandatory, priority, conf, amb, raw, clause) -> Column:
    made = F.struct(
        F.lit(field).alias("field") if isinstance(field, str) else field.alias("field"),
        F.lit(operator).alias("operator"), value.cast("double").alias("value"), F.lit(unit).alias("unit"),
        F.lit(mandatory).alias("mandatory"), F.lit(priority).alias("priority"), conf.alias("extraction_confidence"),
        amb.alias("semantic_ambiguity_score"), raw.alias("text_raw"), clause.alias("source_clause"),
        temporal(field), F.lit(None).cast("string").alias("depends_on"),
    )
    return F.when(cond, made)


def amount_rules(text: Found) -> list[Column]:
    out = []
    for field, lead, priority, conf, amb, fallback in AMOUNT_RULES:
        pattern = lead + r"[^\n\d]{0,40}" + P.AMOUNT
        hit = text.hit(pattern)
        value = text.amount(pattern)
        if field == "annual_turnover":
            value, good = F.when(value <= 0, 5e7).otherwise(value), hit & value.isNotNull()
        elif field == "net_worth":
            value, good = F.when(value > 0, value).otherwise(1e7), hit
        else:
            good = hit & value.isNotNull()
        own = _rule(good, field, ">=", value, "INR", True, priority, F.lit(conf), F.lit(amb),
                    T.strip(text.whole(pattern)), text.clause(pattern))
        if fallback:
            seen, raw, v, c, a = fallback
            other = _rule(~hit & text.hit(seen), field, ">=", F.lit(v), "INR", True, priority, F.lit(c), F.lit(a),
                          F.lit(raw), text.clause(seen))
            own = F.coalesce(own, other)
        out.append(own)
    return out


def count_rules(text: Found) -> list[Column]:
    number = text.number
    raw = lambda p: T.strip(text.whole(p))
    letters = "experience_letters,work_order,supporting"
    years = _rule(text.hit(EXPERIENCE), "experience_years", ">=", number(EXPERIENCE), "years", True, letters, F.lit(0.78),
                  F.lit(0.15), raw(EXPERIENCE), text.clause(EXPERIENCE))
    spoken = _rule(text.hit(EXPERIENCE_WORDS), "experience_years", ">=", F.lit(3.0), "years", True, letters, F.lit(0.55),
                   F.lit(0.3), F.lit("Relevant experience / similar contracts"),
                   text.clause(EXPERIENCE_WORDS))
    projects = _rule(number(PROJECTS).between(1, 50), "similar_projects_count", ">=",
                     number(PROJECTS), "count", True, "experience_letters,work_order", F.lit(0.7), F.lit(0.22),
                     raw(PROJECTS), text.clause(PROJECTS))
    whole = text.whole(MANPOWER)
    kind = F.when(whole.contains("engineer") | whole.contains("technical"), "technical_staff_count").otherwise("manpower_count")
    people = _rule(number(MANPOWER).between(1, 100000), kind, ">=", number(MANPOWER), "count", True,
                   "pf_records,epf_statement,hr_certificate,supporting", F.lit(0.7), F.lit(0.2), raw(MANPOWER),
                   text.clause(MANPOWER))
    return [F.coalesce(years, spoken), projects, people]


def presence_rules(text: Found, rules=None) -> list[Column]:
    return [
        _rule(text.hit(test), field, "==", F.lit(1.0), "bool", must, priority, F.lit(conf), F.lit(amb), F.lit(raw),
              text.clause(clause or test))
        for field, test, clause, raw, must, priority, conf, amb in (rules or PRESENCE_RULES)
    ]


def validity_rules(text: Found) -> list[Column]:
    found = [
        _rule(text.hit(p), "bid_validity_days", ">=", text.number(p), "days", True,
              "bid_form,supporting", F.lit(conf), F.lit(amb), T.strip(text.whole(p)), text.clause(p))
        for p, conf, amb in VALIDITY
    ]
    return [F.coalesce(*found)]


def category(field: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in P.CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, field), F.lit("general"))


def emit(docs: DataFrame, rules, keys: tuple[str, ...] = ("tender_id",), otherwise: Column | None = None) -> DataFrame:
    """Rule rows of each text in emission order, the first of each field only.

    ``rules`` gives the rule columns of a ``Found``; ``otherwise`` is the one rule of a text that
    gives none.
    """
    text = Found()
    made = {f"_rule{k}": r.cast(RULE) for k, r in enumerate(rules(text))}
    found = text.locate(docs, keys)
    # Rules are columns of their own before they are an array: what a lambda reads is worked out without compiled code.
    found = found.select(apart(keys[0]), *keys[1:], *[r.alias(n) for n, r in made.items()])
    fields = [F.col(f"{n}.field") for n in made]
    found = found.select(*keys, F.array(*made).alias("r"), F.array(*fields).alias("fields"), F.coalesce(*fields).alias("any"))
    first = F.filter("r", lambda x, i: F.array_position("fields", x["field"]) == i + 1)
    if otherwise is not None:
        first = F.when(F.col("any").isNull(), F.array(otherwise.cast(RULE))).otherwise(first)
    return found.select(*keys, F.posexplode(first).alias("pos", "x")).select(*keys, "pos", "x.*").withColumn(
        "category", category(F.col("field"))
    )


def every_rule(text: Found) -> list[Column]:
    return [*amount_rules(text), *count_rules(text), *presence_rules(text), *validity_rules(text),
            *presence_rules(text, [BLACKLIST])]


def placeholder() -> Column:
    return F.struct(
        F.lit("generic_compliance").alias("field"), F.lit("==").alias("operator"), F.lit(1.0).alias("value"),
        F.lit("bool").alias("unit"), F.lit(True).alias("mandatory"), F.lit("supporting").alias("priority"),
        F.lit(0.4).alias("extraction_confidence"), F.lit(0.5).alias("semantic_ambiguity_score"),
        F.lit("Minimum eligibility (placeholder)").alias("text_raw"), F.lit(None).cast("string").alias("source_clause"),
        temporal("generic_compliance"), F.lit(None).cast("string").alias("depends_on"),
    )


def extract(docs: DataFrame) -> DataFrame:
    """All rule rows; texts without any get the placeholder."""
    return emit(docs, every_rule, otherwise=placeholder())


REPLY = (
    "struct<criteria: array<struct<field: string, operator: string, value: double, unit: string, mandatory: boolean, "
    "source_priority: array<string>, extraction_confidence: double, semantic_ambiguity_score: double, text_raw: string, "
    "source_clause: string, temporal: struct<type: string, n: int, anchor: string>, depends_on: string, category: string>>>"
)


def backfill(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """Rules of a model's reply (its first JSON block), else those of the text itself.

    What a reply leaves out is null, but for the category, which follows from the field.
    """
    block = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    parsed = replies.select("tender_id", F.from_json(block, REPLY)["criteria"].alias("c")).filter("size(c) > 0")
    given = parsed.select("tender_id", F.posexplode("c").alias("pos", "x")).select("tender_id", "pos", "x.*")
    given = given.withColumn("priority", F.array_join("source_priority", ",")).withColumn("category", F.coalesce("category", category(F.col("field"))))
    own = extract(docs.join(parsed.select("tender_id"), "tender_id", "left_anti"))
    return given.select(own.columns).withColumn("origin", F.lit("reply")).unionByName(own.withColumn("origin", F.lit("rules")))


def extract_in_language(docs: DataFrame, translated: DataFrame | None = None) -> DataFrame:
    """All rule rows with ``source_text_lang``, a translated clause and a warning.

    ``translated`` has tender_id and english, null where the translation failed.  Texts that are not
    English go through the rules in English where there is a translation; the clause is then one of
    it.  Where there is none the text itself goes, with the warning ``untranslated_indic_text``.
    """
    lang = T.language(T.devanagari_ratio(F.coalesce("text", F.lit(""))))
    docs = docs.withColumn("source_text_lang", lang)
    other = translated.select("tender_id", F.nullif("english", F.lit("")).alias("english")) if translated is not None else None
    docs = docs.join(other, "tender_id", "left") if other is not None else docs.withColumn("english", F.lit(None).cast("string"))
    foreign = F.col("source_text_lang") != "en"
    docs = docs.withColumn("english", F.when(foreign, F.col("english"))).withColumn("text", F.coalesce("english", "text"))
    docs = docs.withColumn("is_translated", F.col("english").isNotNull())
    keys = ("tender_id", "source_text_lang", "is_translated")
    rules = emit(docs, every_rule, keys, otherwise=placeholder())
    return rules.withColumn("source_clause_translated", F.when(F.col("is_translated"), F.coalesce("source_clause", F.lit("")))).withColumn(
        "extraction_warning", F.when((F.col("source_text_lang") != "en") & ~F.col("is_translated"), "untranslated_indic_text")
    ).drop("is_translated")
