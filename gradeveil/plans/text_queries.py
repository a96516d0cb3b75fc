"""Queries over texts: detection, identities, floors, tasks and classifiers, each on written-out cases for all customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeveil.operators import classify, reports, spans, texts
from gradeveil.plans import planners
from gradeveil.plans.registry import case_query, query, table

# One example of every detection pattern: text, redacted, and the least grade at which it is.
PATTERN_CASES = [
    ("token Bearer abcdefgh123#", "token [REDACTED:SECRET]", 1),
    ("key sk-abcdefghijklmnop", "key [REDACTED:SECRET]", 1),
    ("token ghp_abcdefghijklmnopqrstuvwxyz here", "token [REDACTED:SECRET] here", 1),
    ("Voter ID: ABC123456#", "[REDACTED:VOTER_ID]", 1),
    ("DL: MH12 2011001234#", "[REDACTED:DRIVING_LICENCE]", 1),
    ("GSTIN 22ABCDE1234F1Z#", "GSTIN [REDACTED:GSTIN]", 1),
    ("Car MH 12 AB 123#", "Car [REDACTED:VEHICLE]", 1),
    ("UPI: dev@okbank", "[REDACTED:UPI]", 1),
    ("MAC 00:1A:2B:3C:4D:5E", "MAC [REDACTED:MAC]", 2),
    ("at 2001:db8::ff0#", "at [REDACTED:IPV6]", 2),
    ("IMEI 49015420323751#", "IMEI [REDACTED:CARD]", 1),
    ("जन्म तिथि: 01/02/199#", "[REDACTED:DOB]", 2),
    ("पासवर्ड: गुप्त12#", "[REDACTED:SECRET]", 1),
    ("Age: 4#", "[REDACTED:AGE]", 2),
    ("आयु: 4#", "[REDACTED:AGE]", 2),
    ("नाम: आन्या", "[REDACTED:NAME]", 3),
    ("पता: झील मार्ग", "[REDACTED:ADDRESS]", 2),
    ("password: hunter2#, ok", "[REDACTED:SECRET], ok", 1),
    ("recovery code - abcdef", "[REDACTED:SECRET]", 1),
    ("mail dev#@example.in now", "mail [REDACTED:EMAIL] now", 2),
    ("Aadhaar 1234 5678 901#", "Aadhaar [REDACTED:AADHAAR]", 1),
    ("PAN ABCDE123#F", "PAN [REDACTED:PAN]", 1),
    ("card 4111 1111 1111 111#", "card [REDACTED:CARD]", 1),
    ("ssn 123-45-678#", "ssn [REDACTED:SSN]", 1),
    ("Account Number: 12345678#", "[REDACTED:BANK_ACCOUNT]", 1),
    ("IFSC HDFC000123#", "IFSC [REDACTED:IFSC]", 1),
    ("call 98765 4321# soon", "call [REDACTED:PHONE] soon", 2),
    ("from 10.0.0.#", "from [REDACTED:IP]", 2),
    ("DOB: 14/08/199#", "[REDACTED:DOB]", 2),
    ("Passport: A123456#", "[REDACTED:PASSPORT]", 1),
    ("Full name: Ananya Rao", "[REDACTED:NAME]", 3),
    ("Username: ananya#", "[REDACTED:USERNAME]", 3),
    ("Username: dev@example.in", "Username: [REDACTED:EMAIL]", 2),
    ("Employee ID: E-100#", "[REDACTED:EMPLOYEE_ID]", 3),
    ("Customer ID: C-100#", "[REDACTED:ACCOUNT_ID]", 2),
    ("Home address: 12 Lake Road", "[REDACTED:ADDRESS]", 2),
    ("Nothing to hide, item #", "Nothing to hide, item #", 1),
    ("", "", 1),
]


def _graded(case: tuple) -> tuple:
    text, redacted, least = case
    return (text, *(redacted if least <= g else text for g in (1, 2, 3)))


def _redactions(df: DataFrame) -> DataFrame:
    found = spans.with_findings(df)
    return found.select("c_custkey", *(spans.spliced(F.col("text"), spans.for_grade(F.col("findings"), g)).alias(f"g{g}") for g in (1, 2, 3)))


case_query("pattern_redactions", "text string", dict.fromkeys(("g1", "g2", "g3"), "VARCHAR"), [_graded(c) for c in PATTERN_CASES], _redactions)

# Placeholders of normalised texts; what stands behind the label; the same for known values.
case_query(
    "labelled_values",
    "text string",
    {"value": "VARCHAR"},
    [("Name: Ananya Demo", "Ananya Demo"), ("Passport: A123456#", "A123456#"), ("DOB = 14/08/199#", "14/08/199#"), ("Address: 12 Lake Road", "12 Lake Road"), ("mail dev@example.in", "dev@example.in"), ("password:   s3cret#", "s3cret#"), ("plain", None)],
    lambda df: _values(df),
)


def _values(df: DataFrame) -> DataFrame:
    found = spans.with_findings(df).withColumn("v", spans.value_only(F.col("findings"), F.col("text")))
    first = F.try_element_at("v", F.lit(1))
    return found.select("c_custkey", F.substring(F.col("text"), first["start"] + 1, first["end"] - first["start"]).alias("value"))


case_query(
    "known_value_redactions",
    "text string, known array<string>",
    {"redacted": "VARCHAR"},
    [
        ("Welcome, Meera Rao #", ["meera rao", "x"], "Welcome, [REDACTED:KNOWN] #"),
        ("order  AB-77#  for ab-77#", ["AB-77"], "order [REDACTED:KNOWN]# for [REDACTED:KNOWN]#"),
        ("too short: ab", ["ab"], "too short: ab"),
        ("a.c is no abc", [" a.c "], "[REDACTED:KNOWN] is no abc"),
        ("nothing known", None, "nothing known"),
        ("known and mail dev@example.in", ["known"], "[REDACTED:KNOWN] and mail [REDACTED:EMAIL]"),
    ],
    lambda df: spans.redacted(df, known="known").select("c_custkey", "redacted"),
)

# The server profile: the least grade at which a text is rejected; 9: at none.
FLOOR_CASES = [
    ("pan ABCDE123#F", 1),
    ("1234 5678 901#", 1),
    ("A123456#", 1),
    ("4111-1111-1111-111#", 1),
    ("OTP 123#", 1),
    ("one-time pin: 1234#", 1),
    ("password=secret#", 1),
    ("Bearer abcdefgh#", 1),
    ("ghp_abcdefghijklmnopqrst", 1),
    ("account no: 12345678#", 1),
    ("123-45-678#", 1),
    ("HDFC000123#", 1),
    ("dev#@example.in", 2),
    ("call 98765 4321#", 2),
    ("10.0.0.#", 2),
    ("date of birth: 14/08/199#", 2),
    ("Address: 12 Lake Road", 2),
    ("customer id: AB-100#", 2),
    ("Full name: Ananya Rao", 3),
    ("username: ananya#", 3),
    ("Ｂｅａｒｅｒ abcdefgh123#", 1),
    ("आयु: ४२", 2),
    ("[REDACTED:EMAIL]", 9),
    ("nothing to hide", 9),
    ("", 9),
]


def _rejections(df: DataFrame) -> DataFrame:
    for g in (1, 2, 3):
        df = texts.rejected_by_floor(df, "text", g, f"r{g}")
    return df.select("c_custkey", "r1", "r2", "r3")


case_query("floor_rejections", "text string", dict.fromkeys(("r1", "r2", "r3"), "BOOLEAN"), [(t, *(least <= g for g in (1, 2, 3))) for t, least in FLOOR_CASES], _rejections)

case_query(
    "placeholder_texts",
    "text string",
    {"placeholder": "BOOLEAN"},
    [("[REDACTED:EMAIL]", True), ("[REDACTED:BANK_ACCOUNT]", True), ("[REDACTED:A#-]", True), ("[REDACTED:X]", False), ("[REDACTED:email]", False), (" [REDACTED:EMAIL]", False), ("[REDACTED:EMAIL] x", False), ("", False)],
    lambda df: {"placeholder": texts.is_placeholder(F.col("text"))},
)

case_query(
    "unsafe_key_records",
    "json string",
    {"unsafe": "BOOLEAN"},
    [('{"task":"x#"}', False), ('{"a":{"innerHTML":"x#"}}', True), ('{"a":[{"b":{"Password":1}}]}', True), ('{"values":1}', False), ('{"text":"password"}', False), ('{"rawDom":null}', True), ("not json", True), ("[]", False), ('{"cookie" : "a"}', True)],
    lambda df: {"unsafe": texts.has_unsafe_keys(F.col("json"))},
)

case_query(
    "dlp_gate",
    "title string, task string, label string",
    dict.fromkeys(("b1", "b2", "b3"), "BOOLEAN"),
    [
        ("Form", "Fill in the form", "Name", False, False, False),
        ("Form", "mail dev#@example.in", "x", False, True, True),
        ("PAN ABCDE123#F", "x", "y", True, True, True),
        ("Form", "x", "Full name: Ananya Rao", False, False, True),
        ("token", "ghp_abcdefghijklmnopqrstuvwxyz", "x", True, True, True),
        ("[REDACTED:EMAIL]", "x", None, False, False, False),
    ],
    lambda df: _gated(df),
)


def _gated(df: DataFrame) -> DataFrame:
    for g in (1, 2, 3):
        df = texts.dlp_blocked(df, ["title", "task", "label"], g, f"b{g}")
    return df.select("c_custkey", "b1", "b2", "b3")


case_query(
    "identity_forms",
    "value string, category string",
    {"forms": "VARCHAR[]"},
    [
        ("1998-08-14", "date-of-birth", ["1998-08-14", "1998-08-14", "14/08/1998", "14-08-1998"]),
        ("4/8/1998", "date-of-birth", ["4/8/1998", "1998-08-04", "04/08/1998", "04-08-1998"]),
        (" Ananya Rao ", "name", ["Ananya Rao"]),
        ("1998-08-14", "name", ["1998-08-14"]),
        ("yesterday", "date-of-birth", ["yesterday"]),
    ],
    lambda df: {"forms": texts.identity_variants(F.col("value"), F.col("category"))},
)

_VALUES = "array<struct<value:string,category:string>>"
case_query(
    "identity_redactions",
    f"text string, values {_VALUES}",
    dict.fromkeys(("g2", "g3"), "VARCHAR"),
    [
        ("Dear ananya  rao, case #", [("Ananya Rao", "name")], "Dear ananya  rao, case #", "Dear [REDACTED:NAME], case #"),
        ("born 14/08/1998 or 1998-08-14", [("1998-08-14", "date-of-birth")], "born [REDACTED:DOB] or [REDACTED:DOB]", "born [REDACTED:DOB] or [REDACTED:DOB]"),
        ("Raol and Ra", [("Rao", "name"), ("Ra", "name")], "Raol and Ra", "Raol and Ra"),
        ("Rao Ananya Rao", [("Ananya Rao", "name"), ("Rao Ananya", "name")], "Rao Ananya Rao", "[REDACTED:NAME] Rao"),
        ("(Zoë) #", [("zoë", "name")], "(Zoë) #", "([REDACTED:NAME]) #"),
        ("no values", [], "no values", "no values"),
    ],
    lambda df: {f"g{g}": texts.without_identities(F.col("text"), F.col("values"), g) for g in (2, 3)},
)


@query(
    """SELECT c_nationkey, v AS value, c AS category, rank - 1 AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY p, v) AS rank FROM (
            SELECT c_nationkey, v, c, min(p) AS p FROM (
                SELECT c_nationkey, c_custkey AS p, trim(c_name) AS v, 'name' AS c FROM customer WHERE c_custkey % 4 = 0
                UNION ALL SELECT c_nationkey, c_custkey, '1990-01-0' || c_custkey % 10, 'date-of-birth' FROM customer WHERE c_custkey % 4 = 1) GROUP BY ALL)) WHERE rank <= 256"""
)
def learned_identity_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    pick = lambda options: F.element_at(F.array(*options), (key % 4 + 1).cast("int"))
    label = pick([F.lit("Full Name:"), F.lit(" DOB - "), F.lit("Colour"), F.lit("Email")])
    value = pick([F.concat(F.lit(" "), "c_name"), F.concat(F.lit("1990-01-0"), (key % 10).cast("string")), F.lit("red"), F.lit("dev@example.in")])
    fields = table(spark, sf_dir, "customer").select("c_nationkey", label.alias("label"), value.alias("value"), key.alias("position"))
    learned = texts.learned_identities(fields, "c_nationkey").select("c_nationkey", F.posexplode("values").alias("place", "v"))
    return learned.select("c_nationkey", "v.value", "v.category", F.col("place").cast("long").alias("place"))


case_query(
    "task_field_values",
    "task string",
    {"fields": "VARCHAR"},
    [
        ("Preferred name is Anna Rao, work email: anna#@example.in and then submit", '{"preferredName":"Anna Rao","workEmail":"anna#@example.in"}'),
        ("Set the city to nothing", '{"city":"to nothing"}'),
        ("phone number = 12345, mobile 999", '{"phoneNumber":"12345"}'),
        ("benefit plan: Gold; coverage start date 2024-01-0#.", '{"benefitPlan":"Gold","startDate":"2024-01-0#"}'),
        ("Requested centre is North, transfer type: full, effective date equals 1 May", '{"requestedCentre":"North","transferType":"full","effectiveDate":"1 May"}'),
        ("Read the page", "{}"),
    ],
    lambda df: {"fields": F.to_json(texts.task_fields(F.col("task")))},
)

case_query(
    "field_categories",
    "type string, autocomplete string, name string, id string, placeholder string, aria string",
    {"category": "VARCHAR", "g1": "VARCHAR", "g2": "VARCHAR", "g3": "VARCHAR"},
    [
        ("password", "", "", "", "", "", "credential", "password", "password", "password"),
        ("PASSWORD", None, None, None, None, None, "credential", "password", "password", "password"),
        ("email", "", "", "", "", "", "contact", None, "sensitive-field", "sensitive-field"),
        ("tel", "cc-number", "", "", "", "", "contact", None, "sensitive-field", "sensitive-field"),
        ("text", "one-time-code", "", "", "", "", "credential", "sensitive-field", "sensitive-field", "sensitive-field"),
        ("text", "cc-number", "", "", "", "", "financial", "sensitive-field", "sensitive-field", "sensitive-field"),
        ("text", "shipping postal-code", "", "", "", "", "location", None, "sensitive-field", "sensitive-field"),
        ("text", "bday", "", "", "", "", "date-of-birth", None, "sensitive-field", "sensitive-field"),
        ("text", "username", "", "", "", "", "username", None, None, "sensitive-field"),
        ("text", "given-name", "", "", "", "", "name", None, None, "sensitive-field"),
        ("text", "", "api_key", "", "", "", "credential", "sensitive-field", "sensitive-field", "sensitive-field"),
        ("text", "", "", "passport-no", "", "", "government-id", "sensitive-field", "sensitive-field", "sensitive-field"),
        ("text", "", "", "", "IBAN", "", "financial", "sensitive-field", "sensitive-field", "sensitive-field"),
        ("text", "", "", "", "", "Mobile #", "contact", None, "sensitive-field", "sensitive-field"),
        ("text", "", "home_address", "", "", "", "location", None, "sensitive-field", "sensitive-field"),
        ("text", "", "date_of_birth", "", "", "", "date-of-birth", None, "sensitive-field", "sensitive-field"),
        ("text", "", "ip_address", "", "", "", "network", None, "sensitive-field", "sensitive-field"),
        ("text", "", "customer_id", "", "", "", "account-id", None, "sensitive-field", "sensitive-field"),
        ("text", "", "staff number", "", "", "", "professional-id", None, None, "sensitive-field"),
        ("text", "", "login_id", "", "", "", "username", None, None, "sensitive-field"),
        ("text", "", "full_name", "", "", "", "name", None, None, "sensitive-field"),
        ("text", "", "colour", "c#", "Choose", "", None, None, None, None),
        (None, None, None, None, None, None, None, None, None, None),
    ],
    lambda df: _fields(df),
)


def _fields(df: DataFrame) -> DataFrame:
    df = df.withColumn("category", classify.sensitive_field(*(F.col(c) for c in ("type", "autocomplete", "name", "id", "placeholder", "aria"))))
    return df.select("c_custkey", "category", *(classify.field_redaction(F.col("category"), F.col("type"), g).alias(f"g{g}") for g in (1, 2, 3)))


case_query(
    "label_categories",
    "label string, kind string",
    {"category": "VARCHAR", "transfer": "VARCHAR", "placeholder": "VARCHAR"},
    [
        ("Password:", "SECRET", "credential", "password", "PASSWORD"),
        ("Aadhaar", "AADHAAR", "government-id", "aadhaar", "AADHAAR_NUMBER"),
        ("Card number -", "CARD", "financial", "card number", "CARD_NUMBER"),
        ("E-mail", "EMAIL", "contact", "email", "EMAIL"),
        ("Mobile", None, "contact", "phone", "PHONE_NUMBER"),
        ("Home  Address", None, "location", "address", "ADDRESS"),
        ("Date of Birth", None, "date-of-birth", "date-of-birth", "DATE_OF_BIRTH"),
        ("IP address", None, "network", "ip address", "NETWORK"),
        ("Customer ID", None, "account-id", "account-id", "ACCOUNT_ID"),
        ("full name", None, "name", "name", "NAME"),
        ("User name", None, "username", "user name", "USERNAME"),
        ("Staff code", "EMPLOYEE_ID", "professional-id", "employee-id", "EMPLOYEE_ID"),
        ("Your full name please", None, None, "name", "PII"),
        ("City / locality", None, None, "city", "PII"),
        ("Security code (CVV)", None, None, "security code cvv", "CVV"),
        ("...", None, None, None, "PII"),
    ],
    lambda df: _labels(df),
)


def _labels(df: DataFrame) -> DataFrame:
    df = df.withColumn("category", classify.sensitive_label(F.col("label")))
    return df.select("c_custkey", "category", classify.transfer_key(F.col("label")).alias("transfer"), classify.field_label(F.col("category"), F.col("label"), F.col("kind")).alias("placeholder"))


case_query(
    "input_masks",
    "type string, value string",
    dict.fromkeys(("m1", "m2", "m3"), "BOOLEAN"),
    [
        ("text", "", False, False, False),
        ("text", None, False, False, False),
        ("checkbox", "on", False, False, False),
        ("Submit", "PAN ABCDE123#F", False, False, False),
        ("password", "x", True, True, True),
        ("text", "PAN ABCDE123#F", True, True, True),
        ("text", "dev#@example.in", False, True, True),
        ("text", "anything else #", False, False, True),
    ],
    lambda df: _masks(df),
)


def _masks(df: DataFrame) -> DataFrame:
    df = spans.with_findings(df.withColumn("v", F.coalesce("value", F.lit(""))), "v")
    return df.select("c_custkey", *(classify.input_needs_mask(F.col("type"), F.col("value"), F.col("findings"), g).alias(f"m{g}") for g in (1, 2, 3)))


case_query(
    "pseudo_content_masks",
    "before string, after string",
    {"masked": "BOOLEAN"},
    [("none", "normal", False), ('""', "''", False), (" None ", "", False), ("'secret #'", "none", True), (None, None, False), ("none", "attr(title)", True)],
    lambda df: {"masked": classify.pseudo_content_needs_mask(F.col("before"), F.col("after"))},
)

case_query(
    "media_kinds",
    "explicit string, child string, text string",
    {"kind": "VARCHAR", "type": "VARCHAR"},
    [
        ("Document", None, "x", "document", "unknown"),
        ("banner", None, "passport", "unknown", "unknown"),
        (None, "person", "logo", "person", "unknown"),
        (None, None, "Scan of my Aadhaar card", "document", "aadhaar-card"),
        (None, None, "PAN card photo", "document", "pan-card"),
        (None, None, "debit card", "document", "credit-card"),
        (None, None, "profile photo #", "person", "unknown"),
        (None, None, "company logo", "unknown", "unknown"),
        ("", None, "company logo", "object", "unknown"),
        ("pan", None, "", "unknown", "pan-card"),
    ],
    lambda df: {"kind": classify.media_kind(F.col("explicit"), F.col("text"), F.col("child")), "type": classify.document_type(F.col("explicit"), F.col("text"))},
)

_TESTS = ("pan", "aadhaar", "expiry", "cvv", "date", "name")
case_query(
    "document_text_tests",
    "text string",
    {**dict.fromkeys(_TESTS, "BOOLEAN"), "cards": "VARCHAR[]", "score": "INTEGER"},
    [
        ("ABCDE 1234 F", True, False, False, False, False, False, [], 0),
        ("no 1234 5678 901#", False, True, False, False, False, False, [], 0),
        ("Aadhaar number: 123456789012", False, True, False, False, False, False, [], 0),
        ("VISA 4111 1111 1111 1111 valid thru 12/29", False, True, True, False, False, False, ["4111111111111111"], 2),
        ("4111 1111 1111 1112", False, True, False, False, False, False, [], 0),
        ("CVV: 123", False, False, False, True, False, False, [], 1),
        ("1/13 of it", False, False, True, False, False, False, [], 0),
        ("13/99", False, False, True, False, False, False, [], 0),
        ("20/99", False, False, False, False, False, False, [], 0),
        ("14/08/1998", False, False, True, False, True, False, [], 0),
        ("Ananya Rao", False, False, False, False, False, True, [], 0),
        ("Income Tax Department", False, False, False, False, False, False, [], 0),
        ("Ananya", False, False, False, False, False, False, [], 0),
    ],
    lambda df: {
        **dict(zip(_TESTS, (f(F.col("text")) for f in (classify.has_pan, classify.has_aadhaar, classify.has_expiry, classify.has_cvv, classify.has_date, classify.is_name_value)), strict=True)),
        "cards": classify.card_numbers(F.col("text")),
        "score": classify.card_context_score(F.col("text")),
    },
)

case_query(
    "entity_categories",
    "entity string, score double, confidence double",
    {"category": "VARCHAR", "line": "VARCHAR"},
    [
        ("B-PER", 0.95, 0.9, "name", "name"),
        ("I-LOC", 0.8, 0.69, "location", "uninspectable"),
        ("ORG", 0.79, 0.7, "uninspectable", "uninspectable"),
        ("DATE", 0.9, None, "date-of-birth", "uninspectable"),
        ("B-MISC", 0.99, 1.0, "unknown-populated-field", "unknown-populated-field"),
        ("EVENT", 0.99, 1.0, "uninspectable", "uninspectable"),
        ("PERSON", None, 1.0, "uninspectable", "uninspectable"),
    ],
    lambda df: _entities(df),
)


def _entities(df: DataFrame) -> DataFrame:
    df = df.withColumn("category", classify.entity_category(F.col("entity"), F.col("score")))
    return df.select("c_custkey", "category", classify.line_category(F.col("category"), F.col("confidence")).alias("line"))


case_query(
    "most_protective_categories",
    "categories array<string>",
    dict.fromkeys(("g1", "g2", "g3"), "VARCHAR"),
    [
        (["name", "contact", "credential"], "credential", "credential", "credential"),
        (["name", "location", "contact"], None, "location", "location"),
        (["username", "name"], None, None, "username"),
        ([], None, None, None),
        (["biometric", "financial"], "biometric", "biometric", "biometric"),
    ],
    lambda df: {f"g{g}": classify.most_protective(F.col("categories"), g) for g in (1, 2, 3)},
)

case_query(
    "confirmations",
    "label string, type string, role string",
    {"needed": "BOOLEAN"},
    [("Delete account", "button", "button", True), ("Pay now", None, None, True), ("Next", "submit", None, True), ("Next", "button", None, False), ("I confirm", "checkbox", None, False), ("Submit", "x", "checkbox", False), (None, None, None, False)],
    lambda df: {"needed": classify.needs_confirmation(F.col("label"), F.col("type"), F.col("role"))},
)

case_query(
    "safe_messages",
    "message string",
    {"shown": "VARCHAR"},
    [("Page changed during capture: tab  #", "Page changed during capture: tab #"), ("Stack trace at 0x#", "Local operation failed"), (None, "Local operation failed"), ("Reasoning service unavailable", "Reasoning service unavailable")],
    lambda df: {"shown": reports.safe_message(F.col("message"))},
)

case_query(
    "canvas_tiers",
    "requested string, detector boolean, regions int",
    {"tier": "VARCHAR"},
    [("visual-redaction", False, 0, "visual-redaction"), ("dbnet-blind-mask", True, 2, "dbnet-blind-mask"), ("dbnet-blind-mask", True, 0, "manual-escalation"), ("dbnet-blind-mask", False, 2, "manual-escalation"), ("dbnet-blind-mask", None, None, "manual-escalation"), ("other", True, 3, "manual-escalation")],
    lambda df: {"tier": planners.canvas_tier(F.col("requested"), F.col("detector"), F.col("regions"))},
)

case_query(
    "serving_routes",
    "capacity boolean, fast boolean, fallback boolean, ready boolean, blocked boolean, outcome string, valid boolean",
    {"route": "VARCHAR"},
    [
        (False, True, True, True, False, "ok", True, "503"),
        (True, True, False, False, False, None, True, "fast"),
        (True, True, False, False, False, None, False, "502"),
        (True, False, True, False, False, None, True, "structural"),
        (True, False, False, False, False, None, True, "503"),
        (True, False, True, True, True, "ok", True, "structural"),
        (True, False, True, True, False, "context_limit", True, "503"),
        (True, False, True, True, False, "timeout", True, "structural"),
        (True, False, False, True, False, "circuit_open", True, "503"),
        (True, False, False, True, False, "invalid", True, "502"),
        (True, False, True, True, False, "invalid", True, "structural"),
        (True, False, False, True, False, "ok", True, "model"),
        (True, False, False, True, False, "ok", None, "502"),
    ],
    lambda df: {"route": planners.serving_route(*(F.col(c) for c in ("capacity", "fast", "fallback", "ready", "blocked", "outcome", "valid")))},
)


def _elements(roles: Column) -> Column:
    return F.transform(roles, lambda r: F.struct(r.alias("role")))


case_query(
    "visual_prompts",
    "roles array<string>, width int, height int",
    {"picture": "BOOLEAN"},
    [(["button"], 960, 100, True), (["button"], 961, 100, False), (["other"], 2000, 1000, True), ([], 2000, 1000, True), (["other", "link"], 100, 2000, False)],
    lambda df: {"picture": planners.needs_picture(_elements(F.col("roles")), F.col("width"), F.col("height"))},
)
