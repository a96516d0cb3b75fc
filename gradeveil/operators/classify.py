"""Ordered rules that put fields, labels, media and recognised text into categories. The first rule that holds wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeveil.functions import policy
from gradeveil.functions.columns import bound, first_match, luhn
from gradeveil.operators import spans

# Rules on a field's autocomplete attribute.
AUTOCOMPLETE = [
    (r"current-password|new-password|one-time-code", "credential"),
    (r"\bcc-|transaction-", "financial"),
    (r"\bemail\b|\btel(?:-|\b)", "contact"),
    (r"street-address|address-line|postal-code|country|locality", "location"),
    (r"\bbday(?:-|\b)", "date-of-birth"),
    (r"\busername\b", "username"),
    (r"\b(?:name|given-name|additional-name|family-name|nickname)\b", "name"),
]

# Rules on a field's name, id, placeholder and aria label together.
METADATA = [
    (r"pass(?:word|code)|\bsecret\b|api.?key|access.?token|refresh.?token|auth(?:entication)?.?token|private.?key|recovery.?code|one.?time.?code|\botp\b|\bcvv\b|\bcvc\b|security.?code|(?:login|transaction|security|atm|upi)?.?\bpin\b", "credential"),
    (r"aadhaar|aadhar|pan.?number|passport|\bssn\b|social.?security", "government-id"),
    (r"credit.?card|debit.?card|card.?number|cc.?number|bank.?account|account.?number|routing.?number|\biban\b|\bupi\b|\bifsc\b", "financial"),
    (r"e.?mail|phone|mobile|telephone|contact.?number", "contact"),
    (r"street.?address|postal.?address|home.?address|residential.?address|postal.?code|\bpincode\b", "location"),
    (r"date.?of.?birth|birth.?date|\bdob\b", "date-of-birth"),
    (r"ip.?address", "network"),
    (r"(?:customer|member|subscriber).?(?:id|code|number|no\b)", "account-id"),
    (r"(?:employee|staff|personnel).?(?:id|code|number|no\b)", "professional-id"),
    (r"\buser.?name\b|\blogin.?id\b", "username"),
    (r"^(?:full |customer |employee |passenger |account holder )?name\b", "name"),
]

# Whole labels.
LABELS = [
    (r"password|passcode|secret|token|api key|api token|access token|refresh token|otp|one time code|pin|cvv|cvc|security code", "credential"),
    (r"pan|pan number|aadhaar|aadhar|passport|passport number|ssn|social security number", "government-id"),
    (r"card|card number|credit card|debit card|account number|bank account|bank account number|upi|upi id|ifsc|iban", "financial"),
    (r"email|e-mail|phone|mobile|telephone|contact number", "contact"),
    (r"address|home address|postal address|residential address|postal code|pincode", "location"),
    (r"date of birth|dob|birth date", "date-of-birth"),
    (r"ip|ip address", "network"),
    (r"(?:customer|member|subscriber) (?:id|code|number)", "account-id"),
    (r"(?:full |customer |employee |passenger |account holder )?name", "name"),
    (r"username|user name|login id", "username"),
    (r"(?:employee|staff|personnel) (?:id|code|number)", "professional-id"),
]

# Keys under which labels of different forms meet.
TRANSFER_KEYS = [
    (r"\b(?:e mail|email)\b", "email"),
    (r"\b(?:phone|mobile|telephone)(?: number)?\b", "phone"),
    (r"\b(?:home|postal|residential|street) address\b|^address$", "address"),
    (r"\bcity\b|\blocality\b", "city"),
    (r"\b(?:date of birth|birth date|dob)\b", "date-of-birth"),
    (r"\b(?:full|preferred|given|family) name\b|^name$", "name"),
    (r"\b(?:employee|staff|personnel) (?:id|code|number)\b", "employee-id"),
    (r"\b(?:customer|member|subscriber) (?:id|code|number)\b", "account-id"),
]

# Words that hint at a kind of media, and at a type of document.
MEDIA_HINTS = [
    (r"\b(?:aadhaar|aadhar|uidai|pan\s*card|credit\s*card|debit\s*card|identity\s*(?:card|document)|passport|voter(?:\s|-)?id|driving\s*licen[cs]e|government\s*id|document)\b", "document"),
    (r"\b(?:person|portrait|profile\s*photo|face|selfie|human|headshot)\b", "person"),
]
OBJECT_HINT = r"\b(?:object|product|landscape|diagram|illustration|logo|icon|public\s*image)\b"
DOCUMENT_TYPES = [
    (r"\b(?:aadhaar|aadhar|uidai)\b", "aadhaar-card"),
    (r"\b(?:pan\s*card|permanent\s+account\s+number|income\s+tax)\b", "pan-card"),
    (r"\b(?:credit|debit)\s+card\b", "credit-card"),
]

# The placeholder that names a category, a kind, or a labelled field.
FIELD_LABEL_OF_CATEGORY = {
    "credential": "PASSWORD",
    "government-id": "GOVERNMENT_ID",
    "financial": "FINANCIAL",
    "biometric": "BIOMETRIC",
    "contact": "CONTACT",
    "location": "ADDRESS",
    "date-of-birth": "DATE_OF_BIRTH",
    "network": "NETWORK",
    "account-id": "ACCOUNT_ID",
    "name": "NAME",
    "username": "USERNAME",
    "professional-id": "EMPLOYEE_ID",
}
FIELD_LABEL_OF_KIND = {
    "SECRET": "PASSWORD",
    "AADHAAR": "AADHAAR_NUMBER",
    "PAN": "PAN",
    "PASSPORT": "PASSPORT_NUMBER",
    "CARD": "CARD_NUMBER",
    "BANK_ACCOUNT": "BANK_ACCOUNT",
    "EMAIL": "EMAIL",
    "PHONE": "PHONE_NUMBER",
    "ADDRESS": "ADDRESS",
    "DOB": "DATE_OF_BIRTH",
    "NAME": "NAME",
    "USERNAME": "USERNAME",
    "EMPLOYEE_ID": "EMPLOYEE_ID",
    "ACCOUNT_ID": "ACCOUNT_ID",
}
FIELD_LABELS = [
    (r"\b(?:aadhaar|aadhar)\b", "AADHAAR_NUMBER"),
    (r"\bpan\b", "PAN"),
    (r"\bpassport\b", "PASSPORT_NUMBER"),
    (r"\b(?:e-?mail)\b", "EMAIL"),
    (r"\b(?:phone|mobile|telephone|contact number)\b", "PHONE_NUMBER"),
    (r"\b(?:card number|credit card|debit card)\b", "CARD_NUMBER"),
    (r"\b(?:bank account|account number)\b", "BANK_ACCOUNT"),
    (r"\b(?:cvv|cvc|security code)\b", "CVV"),
]


def regex(pattern: str, ignore_case: bool = False) -> str:
    """A pattern with ASCII word boundaries."""
    return ("(?i)" if ignore_case else "") + pattern.replace(r"\b", policy.ASCII_BOUNDARY)


def _rules(text: Column, rules: list[tuple[str, str]], ignore_case: bool = False) -> list[tuple[Column, str]]:
    return [(text.rlike(regex(p, ignore_case)), value) for p, value in rules]


def _or_empty(value: Column) -> Column:
    return F.lower(F.coalesce(value, F.lit("")))


def sensitive_field(type_: Column, autocomplete: Column, name: Column, id_: Column, placeholder: Column, aria_label: Column) -> Column:
    """The category of a form field, or null."""
    kind, auto = _or_empty(type_), _or_empty(autocomplete)
    parts = F.filter(F.array(name, id_, placeholder, aria_label), lambda x: F.coalesce(x, F.lit("")) != "")
    metadata = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", parts)), "[_-]+", " "))
    direct = [(kind == "password", "credential"), (kind.isin("email", "tel"), "contact")]
    return first_match([*direct, *_rules(auto, AUTOCOMPLETE), *_rules(metadata, METADATA)])


def grade_of_category(category: Column) -> Column:
    return first_match([(category == c, F.lit(g)) for c, g in policy.MINIMUM_GRADES.items()], F.when(category.isNotNull(), F.lit(3)))


def hidden(category: Column, grade: Column | int) -> Column:
    return grade_of_category(category) <= (F.lit(grade) if isinstance(grade, int) else grade)


def field_redaction(category: Column, type_: Column, grade: Column | int) -> Column:
    """The kind of redaction of a field at a grade, or null."""
    return F.when(hidden(category, grade), F.when(_or_empty(type_) == "password", "password").otherwise("sensitive-field"))


def category_of_kind(kind: Column) -> Column:
    by_kind = F.create_map(*(F.lit(x) for pair in policy.CATEGORY_OF_KIND.items() for x in pair))
    return F.coalesce(F.try_element_at(by_kind, kind), F.lit(policy.UNKNOWN))


def sensitive_label(label: Column) -> Column:
    """The category of a text label, or null."""
    plain = F.trim(F.regexp_replace(F.lower(spans.normalized(label)), r"[:\-]$", ""))
    return first_match(_rules(plain, [(f"^(?:{p})$", c) for p, c in LABELS]))


def pseudo_content_needs_mask(*contents: Column) -> Column:
    plain = F.transform(F.array(*contents), lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    return F.exists(plain, lambda c: ~c.isin("", "none", "normal", '""', "''"))


def input_needs_mask(type_: Column, value: Column, findings: Column, grade: Column | int) -> Column:
    """findings: those in the value, before grading."""
    limit = F.lit(grade) if isinstance(grade, int) else grade
    skipped = ["checkbox", "radio", "button", "submit", "reset", "hidden", "image"]
    return first_match(
        [
            ((F.coalesce(value, F.lit("")) == "") | _or_empty(type_).isin(skipped), F.lit(False)),
            (_or_empty(type_) == "password", F.lit(True)),
            (F.exists(findings, lambda f: f["min_grade"] <= limit), F.lit(True)),
        ],
        limit >= policy.MINIMUM_GRADES[policy.UNKNOWN],
    )


def media_kind(explicit: Column, text: Column, child_explicit: Column | None = None) -> Column:
    """document, person, object or unknown. explicit: the value of the element's own marker attribute; child_explicit:
    of the first marked image below; text: alt, title, aria label and source. An object needs a marker."""

    def marked(value: Column) -> Column:
        plain = F.lower(F.trim(value))
        return F.when(plain.isin("document", "person", "object"), plain).when(plain != "", "unknown")

    by_text = [*_rules(text, MEDIA_HINTS, True), (text.rlike(regex(OBJECT_HINT, True)) & explicit.isNotNull(), "object")]
    child = marked(child_explicit) if child_explicit is not None else F.lit(None).cast("string")
    return F.coalesce(marked(explicit), child, first_match(by_text, "unknown"))


def document_type(explicit: Column, text: Column) -> Column:
    plain = F.lower(F.trim(F.coalesce(explicit, F.lit(""))))
    direct = [(plain.isin("aadhaar", "aadhar", "aadhaar-card"), "aadhaar-card"), (plain.isin("pan", "pan-card"), "pan-card"), (plain.isin("credit", "credit-card", "debit-card"), "credit-card")]
    return first_match([*direct, *_rules(text, DOCUMENT_TYPES, True)], "unknown")


def transfer_key(label: Column) -> Column:
    """The key under which a label matches others; null where it has no letter or digit."""
    plain = F.trim(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain != "", first_match(_rules(plain, TRANSFER_KEYS), plain))


def field_label(category: Column, label: Column | None = None, kind: Column | None = None) -> Column:
    """The placeholder that names a field: by its label, else by the kind of finding, else by its category."""
    by_category = first_match([(category == c, v) for c, v in FIELD_LABEL_OF_CATEGORY.items()], "PII")
    by_kind = first_match([(kind == k, v) for k, v in FIELD_LABEL_OF_KIND.items()], by_category) if kind is not None else by_category
    if label is None:
        return by_kind
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(label, F.lit("")), "[_-]+", " "), r"\s+", " ")))
    return first_match(_rules(plain, FIELD_LABELS), by_kind)


def entity_category(entity: Column, score: Column, min_score: float = 0.8) -> Column:
    """The category of a recognised entity; uncertain ones cannot be inspected."""
    # Labels of recognised entities.
    labels = {"PER": "name", "PERSON": "name", "LOC": "location", "LOCATION": "location", "ORG": "professional-id", "ORGANIZATION": "professional-id", "DATE": "date-of-birth", "AGE": policy.UNKNOWN, "MISC": policy.UNKNOWN}
    plain = F.regexp_replace(entity, "^[BI]-", "")
    named = first_match([(plain == k, v) for k, v in labels.items()], "uninspectable")
    return F.when(F.coalesce(score, F.lit(0.0)) < min_score, "uninspectable").otherwise(named)


def most_protective(categories: Column, grade: Column | int) -> Column:
    """Of an array of categories the one with the least grade that is hidden at `grade`, the first of equals."""
    limit = F.lit(grade) if isinstance(grade, int) else grade
    ranked = F.transform(categories, lambda c, i: F.struct(grade_of_category(c).alias("g"), i.alias("i"), c.alias("c")))
    return F.array_min(F.filter(ranked, lambda x: x["g"] <= limit))["c"]


def line_category(text_category: Column, confidence: Column, min_confidence: float = 0.7) -> Column:
    """Recognised lines of low confidence cannot be inspected."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) < min_confidence, "uninspectable").otherwise(text_category)


def needs_confirmation(label: Column, type_: Column, role: Column | None = None) -> Column:
    """Whether a control ends or sends something, so that a person has to confirm it. A checkbox only prepares."""
    # Words on such controls.
    words = ["delete", "remove", "submit", "pay", "checkout", "buy", "confirm"]
    named = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(_or_empty(label), w))
    box = (_or_empty(type_) == "checkbox") | ((_or_empty(role) == "checkbox") if role is not None else F.lit(False))
    return ~box & (named | (_or_empty(type_) == "submit"))


# What numbers and dates on documents look like, and what their print says; operators/documents.py reads
# single lines by the same patterns.
CARD_RUN = r"(?<!\d)(?:\d[\s-]?){12,18}\d(?!\d)"
PAN = r"\b[A-Z]{5}\s*\d{4}\s*[A-Z]\b"
AADHAAR_GROUPS = r"(?<!\d)\d{4}[\s-]\d{4}[\s-]\d{4}(?!\d)"
AADHAAR_LABELLED = r"\baadhaar(?:\s+number)?\b[^\d]{0,16}\d{12}\b"
EXPIRY = r"(?<!\d)(\d{1,3})\s*[/-]\s*\d{2,4}(?!\d)"
CVV = r"\b(?:cvv|cvc|security\s+code)\b[^\d]{0,20}\d{3,4}\b"
DATE = r"(?<!\d)\d{1,2}\s*[/-]\s*\d{1,2}\s*[/-]\s*\d{2,4}(?!\d)"
PRINTED = r"\b(?:income|tax|department|government|republic|account|number|date|birth|signature)\b"
CARD_TERMS = ["visa", "mastercard", "amex", "credit", "debit", "card", r"valid\s+thru", "validity", "expiry", "expires?", "cvv", "cvc", r"security\s+code"]


def card_numbers(text: Column) -> Column:
    """Digits of the runs of 13 to 19 digits with spaces and hyphens that pass the Luhn check."""
    found = F.regexp_extract_all(spans.normalized(text), F.lit(CARD_RUN), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"\D", "")), luhn)


def has_pan(text: Column) -> Column:
    return text.rlike(regex(PAN, True))


def has_aadhaar(text: Column) -> Column:
    return spans.normalized(text).rlike(AADHAAR_GROUPS) | text.rlike(regex(AADHAAR_LABELLED, True))


def card_context_score(text: Column) -> Column:
    """How many of the words around a payment card's number a text has."""
    score = F.lit(0)
    for term in CARD_TERMS:
        score = score + text.rlike(regex(rf"\b{term}\b", True)).cast("int")
    return score


def has_expiry(text: Column) -> Column:
    """A month and a year; one stray digit before the month is forgiven."""
    months = F.regexp_extract_all(text, F.lit(EXPIRY), F.lit(1))
    return F.exists(months, lambda m: m.rlike("^(?:0?[1-9]|1[0-2])$") | F.substring(m, -1, 1).rlike("^[1-9]$") | F.substring(m, -2, 2).rlike("^(?:0[1-9]|1[0-2])$"))


def has_cvv(text: Column) -> Column:
    return text.rlike(regex(CVV, True))


def has_date(text: Column) -> Column:
    return text.rlike(DATE)


def is_name_value(text: Column) -> Column:
    """Two words or more of letters, none of which belongs to a document's print."""
    return bound(spans.normalized(text), lambda t: t.rlike(r"^\p{L}[\p{L}.' -]{2,80}$") & (F.size(F.split(t, " ")) >= 2) & ~t.rlike(regex(PRINTED, True)))


def document_shape(bounds: Column) -> Column:
    return F.coalesce((bounds["width"] / bounds["height"]).between(1.2, 2.4), F.lit(False))
