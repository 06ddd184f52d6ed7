"""Fixed values that results depend on: patterns, fields, words and weights of the evaluation rules."""

import re

# Fixed values -------------------------------------------------------------------------------
AMOUNT = r"(?:₹|rs\.?|inr)?\s*([\d][\d,]*(?:\.\d+)?)\s*(crore|crores|cr|lakh|lakhs|lac|lacs|million)?"
# Digits, white space and word borders are those of Unicode (flag U).
MONEY_ALL = r"(?iU)(?:₹|Rs\.?|INR)\s*([\d,]+(?:\.\d+)?)\s*(crore|lakh|lac|million)?"
MONEY_TURNOVER = r"(?iU)turnover[^\d]{0,40}([\d,]{4,})"

MONEY_FIELDS = ["annual_turnover", "net_worth", "net_profit", "turnover", "emd_amount", "bid_security",
                "earnest_money", "bank_guarantee"]
COUNT_FIELDS = ["similar_projects_count", "experience_years", "years_of_experience", "technical_staff_count",
                "manpower_count", "bid_validity_days"]
BOOL_FIELDS = ["gst_registration", "iso_9001", "iso_14001", "iso_27001", "nabl_accreditation",
               "blacklisting_declaration", "registered_firm", "msme_preference", "msme_registration",
               "pan_registration", "tds_registration", "generic_compliance"]

#: field: pattern with one group, confidence; the largest match counts.
COUNT_RULES = {
    "similar_projects_count": (r"(?iU)(\d+)\s*(?:similar|projects?|works?)", 0.72),
    "experience_years": (r"(?iU)(\d+)\s*(?:\+)?\s*(?:years?|yrs?)", 0.75),
    "years_of_experience": (r"(?iU)(\d+)\s*(?:\+)?\s*(?:years?|yrs?)", 0.75),
    "technical_staff_count": (r"(?iU)(\d+)\s*(?:technical staff|engineers?|staff)", 0.76),
    "manpower_count": (
        r"(?iU)(\d+)\s*(?:full[-\s]*time\s*)?(?:employees?|manpower|personnel|professionals?|workforce)", 0.74),
    "bid_validity_days": (r"(?iU)(\d{2,4})\s*days?", 0.72),
}

#: Words of which a match of a count rule holds one.
COUNT_WORDS = {
    "similar_projects_count": ("similar", "project", "work"), "experience_years": ("year", "yr"), "years_of_experience": ("year", "yr"),
    "technical_staff_count": ("staff", "engineer"), "manpower_count": ("employee", "manpower", "personnel", "professional", "workforce"),
    "bid_validity_days": ("day",),
}
#: A number with what any count rule wants after it, to the end of the word.
COUNTED = r"(?iU)\d\d*+\s*+(?:" + "|".join(dict.fromkeys(re.sub(r"^\(\?iU\)\(.*?\)\\s\*", "", p) for p, _ in COUNT_RULES.values())) + r")\p{L}*"

#: Presence signals on lower-cased text.  field: rules (all of these words, one of these words, pattern, minimal
#: length, value, confidence) of which the first that holds counts, and the confidence where none does.
SIGNALS = {
    "gst_registration": ([((), (), r"(?U)\b\d{2}[a-z]{5}\d{4}[a-z][a-z0-9]\b", 0, 1, 0.92),
                          (("gst", "registration"), (), None, 0, 1, 0.8),
                          ((), ("gstin", "goods and services tax"), None, 0, 1, 0.78)], 0.5),
    "iso_9001": ([(("iso", "9001"), (), None, 0, 1, 0.85)], 0.6),
    "iso_14001": ([(("iso", "14001"), (), None, 0, 1, 0.85)], 0.6),
    "iso_27001": ([(("iso", "27001"), (), None, 0, 1, 0.85)], 0.6),
    "nabl_accreditation": ([(("nabl",), (), None, 0, 1, 0.85)], 0.5),
    "generic_compliance": ([((), ("certif", "undertaking", "compliance"), None, 81, 1, 0.55)], 0.45),
    "blacklisting_declaration": ([((), ("not blacklisted", "no blacklisting", "not debarred"), None, 0, 1, 0.82),
                                  ((), ("blacklisted", "debarred"), None, 0, 0, 0.85)], 0.45),
    "registered_firm": ([(("registered",), ("firm", "company"), None, 0, 1, 0.75)], 0.45),
    "msme_preference": ([((), ("msme", "udyam", "udyog aadhar"), None, 0, 1, 0.78)], 0.45),
    "msme_registration": ([((), ("msme", "udyam", "udyog aadhar"), None, 0, 1, 0.78)], 0.45),
    "pan_registration": ([((), (), r"(?U)\b[a-z]{5}\d{4}[a-z]\b", 0, 1, 0.88), (("pan",), (), None, 0, 1, 0.7)], 0.45),
    "tds_registration": ([((), (), r"(?U)\b[a-z]{4}\d{5}[a-z]\b", 0, 1, 0.85),
                          ((), ("tds", "tan", "tax deducted at source"), None, 0, 1, 0.72)], 0.45),
}

CATEGORIES = {
    "annual_turnover": "financial", "net_worth": "financial", "net_profit": "financial", "emd_amount": "financial",
    "bank_guarantee": "financial", "bid_validity_days": "compliance", "gst_registration": "tax",
    "pan_registration": "tax", "tds_registration": "tax", "iso_9001": "certification", "iso_14001": "certification",
    "iso_27001": "certification", "nabl_accreditation": "certification", "experience_years": "experience",
    "years_of_experience": "experience", "similar_projects_count": "experience", "manpower_count": "capacity",
    "technical_staff_count": "capacity", "msme_registration": "preference", "msme_preference": "preference",
    "blacklisting_declaration": "compliance", "registered_firm": "compliance", "generic_compliance": "compliance",
}

DOC_TYPES = ["supporting", "ca_certificate", "gst_certificate", "audited_balance_sheet", "itr", "iso_certificate",
             "experience_letters", "experience_letter", "work_order", "bank_statement", "balance_sheet",
             "similar_projects", "technical_brochure"]
CHECKLIST = ["ca_certificate", "gst_certificate", "audited_balance_sheet", "itr", "iso_certificate", "work_order",
             "experience_letters", "bank_statement", "technical_brochure"]
ACTION_LABELS = {
    "ELIGIBILITY_DECISION": "Eligibility Decision", "OFFICER_OVERRIDE": "Officer Override",
    "TENDER_CREATED": "Tender Created", "DOCUMENT_UPLOADED": "Document Uploaded",
    "BIDDER_REGISTERED": "Bidder Registered", "EVALUATION_STARTED": "Evaluation Started",
    "REVIEW_OVERRIDE": "Review Override",
}
CONFLICT_WORDS = r"(?i)conflict|contradict|mismatch|inconsist|manipul|discrepan"
#: Bidder ids: the usual form, with a URN prefix or one character on each side, or 32 digits.
UUID = r"(?i)^(?:(?:urn:uuid:)?@|.@.|[0-9a-f]{32})$".replace("@", "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
#: Limits of the decision cascade: relative spread of values, absolute one where none is positive, confidence of
#: reading and of the whole, ambiguity of the rule, and the confidences that verdicts are given.
SPREAD, SPREAD_ABSOLUTE, LEAST_OCR, LEAST_CONFIDENCE, MOST_AMBIGUITY = 0.05, 1, 0.5, 0.6, 0.55
PRESENCE_CONFIDENCE, CONFLICT_CONFIDENCE, DECIDED_CONFIDENCE = 0.7, 0.51, 0.7
WEIGHTS = {"ocr": 0.35, "extraction": 0.30, "priority": 0.20, "agreement": 0.15}
# --------------------------------------------------------------------------------------------


def as_sql(pattern: str) -> str:
    """A pattern for engines whose digits are ASCII ones unless they are named."""
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace(r"\d", r"\p{Nd}")
