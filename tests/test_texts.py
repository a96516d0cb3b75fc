"""Detection, redaction, classification and text operators on literal cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeveil.functions import policy
from gradeveil.functions.columns import hmac_sha256, luhn
from gradeveil.operators import classify, spans, texts


def redact(spark, text, grade=3, known=None, max_length=None):
    df = spark.createDataFrame([(text, known)], "text string, known array<string>")
    return spans.redacted(df, grade=grade, known="known" if known else None, max_length=max_length).first()


CASES = [
    ("Email dev@example.in, PAN ABCDE1234F, Aadhaar 1234 5678 9012, phone +91 98765 43210", 3, "Email [REDACTED:EMAIL], PAN [REDACTED:PAN], Aadhaar [REDACTED:AADHAAR], phone [REDACTED:PHONE]"),
    ("Username: dev@example.in", 2, "Username: [REDACTED:EMAIL]"),
    ("a 123456789012345 b", 1, "a [REDACTED:CARD] b"),
    ("call 98765 43210", 1, "call 98765 43210"),
    ("call 98765 43210", 2, "call [REDACTED:PHONE]"),
    ("é ab@cd.ef x", 2, "é [REDACTED:EMAIL] x"),
    ("password: hunter22, ok", 1, "[REDACTED:SECRET], ok"),
    ("token Bearer abcdefgh12345", 1, "token [REDACTED:SECRET]"),
    ("from 10.0.0.1  to\n10.0.0.2", 2, "from [REDACTED:IP] to [REDACTED:IP]"),
    ("GSTIN 22ABCDE1234F1Z5", 1, "GSTIN [REDACTED:GSTIN]"),
    ("नाम: आन्या", 3, "[REDACTED:NAME]"),
    ("", 3, ""),
    (None, 3, None),
]


@pytest.mark.parametrize("text,grade,expected", CASES)
def test_redaction(spark, text, grade, expected):
    assert redact(spark, text, grade).redacted == expected


def test_known_values(spark):
    assert redact(spark, "Welcome, Meera Rao", known=["meera rao", "x"]).redacted == "Welcome, [REDACTED:KNOWN]"


def test_clipping_after_detection(spark):
    assert "alice" not in redact(spark, "Prefix alice@example.com", 2, max_length=12).redacted


def test_labelled_lines(spark):
    text = "Name: Ananya Demo\nAddress: 12 Lake Road\nDOB: 14/08/1998\nPassport: A1234567"
    df = spans.with_findings(spark.createDataFrame([(text,)], "text string"))
    assert [f.kind for f in df.first().findings] == ["NAME", "ADDRESS", "DOB", "PASSPORT"]
    values = df.select(spans.value_only(F.col("findings"), F.col("text")).alias("v")).first().v
    assert [text[v.start : v.end] for v in values] == ["Ananya Demo", "12 Lake Road", "14/08/1998", "A1234567"]


def test_a_strong_narrow_finding_uncovers_the_rest_of_a_weak_one(spark):
    row = redact(spark, "Name: +91 98765 43210, Account Number: 1234567890")
    assert [f.kind for f in row.findings] == ["PHONE", "BANK_ACCOUNT"]


@given(st.lists(st.sampled_from(["dev@example.in", "1234 5678 9012", "ABCDE1234F", "10.1.2.3", "name: Ann Lee", "password=abc123", "plain words", "4111 1111 1111 1111", "+91 98765 43210"]), min_size=1, max_size=6))
@settings(max_examples=8, deadline=None)
def test_redacted_text_has_no_more_findings(spark, parts):
    first = redact(spark, " ; ".join(parts)).redacted
    again = redact(spark, first)
    assert [f.kind for f in again.findings if f.kind not in ("NAME", "USERNAME")] == []


def test_policy():
    assert len(policy.CLIENT) == 38
    assert policy.grade_of("never heard of") == 3
    assert policy.registry_violations(policy.MINIMUM_GRADES, policy.SHARED, policy.CATEGORY_OF_KIND) == []
    assert policy.registry_violations({**policy.MINIMUM_GRADES, "custom": 2}, policy.SHARED[:1] * 2 + [policy.Pattern("X", "(")], {"SECRET": "credential"}) == ["not_always_hidden:custom", "repeated_pattern:SECRET", "no_category:X", "bad_regex:X"]


FLOOR = [
    (1, ["ABCDE1234F", "1234 5678 9012", "A1234567", "4111 1111 1111 1111", "otp: 123456", "api_key=abcd1234", "Bearer abcdefgh1", "sk-abcdefghijklmnop1", "bank account number: 123456789", "123-45-6789", "ABCD0123456"]),
    (2, ["dev@example.in", "98765 43210", "10.1.2.3", "dob: 14/08/1998", "home address: 12 Lake Road", "customer id: AB12345"]),
    (3, ["Full name: Ananya Demo", "employee id: X123"]),
]


def test_server_floor(spark):
    rows = [(t, g) for g, ts in FLOOR for t in ts]
    df = spark.createDataFrame(rows, "t string, g int")
    got = df.select("t", "g", *(texts.floor_hit(F.col("t"), g).isNotNull().alias(f"g{g}") for g in (1, 2, 3))).collect()
    for r in got:
        assert [r.g1, r.g2, r.g3] == [r.g <= 1, r.g <= 2, r.g <= 3], r.t


def test_floor_on_normalised_text(spark):
    df = spark.createDataFrame([("voter id： ABC१२३४५६७",), ("[REDACTED:PAN]",), (None,), ("fine",)], "t string")
    assert [r.rejected for r in texts.rejected_by_floor(df, "t", 1).collect()] == [True, False, False, False]


def test_for_detection(spark):
    df = spark.createDataFrame([("dev @ example . in ९८७ ٦٥ ​4–3 ﬁ",)], "t string")
    assert df.select(texts.for_detection(F.col("t"))).first()[0] == "dev@example.in 987654-3 fi"


FIELDS = [
    (("password", None, None, None, None, None), "credential"),
    (("tel", None, None, None, None, None), "contact"),
    ((None, "cc-number", None, None, None, None), "financial"),
    ((None, "bday-day", None, None, None, None), "date-of-birth"),
    ((None, None, "aadhaar_no", None, None, None), "government-id"),
    ((None, None, None, "home-address", None, None), "location"),
    ((None, None, None, None, None, "Customer ID"), "account-id"),
    ((None, None, "full_name", None, None, None), "name"),
    ((None, None, "colour", None, None, None), None),
]


def test_fields(spark):
    names = ["type", "auto", "name", "id", "placeholder", "aria"]
    df = spark.createDataFrame([f for f, _ in FIELDS], ", ".join(f"{n} string" for n in names))
    category = classify.sensitive_field(*(F.col(n) for n in names))
    got = df.select(category.alias("c"), classify.field_redaction(category, F.col("type"), 2).alias("r")).collect()
    assert [r.c for r in got] == [c for _, c in FIELDS]
    assert [r.r for r in got] == ["password", *["sensitive-field"] * 6, None, None]


def test_labels_and_transfer_keys(spark):
    rows = [("Date of Birth:", "date-of-birth", "date-of-birth"), ("PAN number", "government-id", "pan number"), ("Work email", None, "email"), ("Email address", None, "email"), ("Username", "username", "username"), ("Name", "name", "name"), ("--", None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "l string")
    got = df.select(classify.sensitive_label(F.col("l")).alias("c"), classify.transfer_key(F.col("l")).alias("k")).collect()
    assert [(r.c, r.k) for r in got] == [r[1:] for r in rows]


def test_media_and_document_kinds(spark):
    rows = [(None, "scan of my passport", "document", "unknown"), ("object", "a face", "object", "unknown"), (None, "product shot", "unknown", "unknown"), ("nonsense", "", "unknown", "unknown"), (None, "Credit card front", "document", "credit-card"), (None, "selfie", "person", "unknown")]
    df = spark.createDataFrame([r[:2] for r in rows], "e string, t string")
    none = F.lit(None).cast("string")
    got = df.select(classify.media_kind(F.col("e"), F.col("t")).alias("m"), classify.document_type(none, F.col("t")).alias("d")).collect()
    assert [(r.m, r.d) for r in got] == [r[2:] for r in rows]


def test_document_predicates(spark):
    df = spark.createDataFrame([("VISA valid thru 038/29 cvv 123", "4111 1111 1111 1111", "Ananya Demo", "1234 5678 9012", "ABCDE 1234 F")], "a string, b string, c string, d string, e string")
    row = df.select(classify.has_expiry(F.col("a")), classify.has_cvv(F.col("a")), classify.card_context_score(F.col("a")), F.size(classify.card_numbers(F.col("b"))), classify.is_name_value(F.col("c")), classify.has_aadhaar(F.col("d")), classify.has_pan(F.col("e")), classify.is_name_value(F.lit("Income Tax"))).first()
    assert list(row) == [True, True, 3, 1, True, True, True, False]


def test_categories_of_entities(spark):
    df = spark.createDataFrame([("B-PER", 0.9), ("PER", 0.5), ("ORG", 0.95)], "e string, s double")
    assert [r.c for r in df.select(classify.entity_category(F.col("e"), F.col("s")).alias("c")).collect()] == ["name", "uninspectable", "professional-id"]
    row = spark.range(1).select(classify.most_protective(F.array(F.lit("name"), F.lit("contact"), F.lit("network")), 3).alias("a"), classify.most_protective(F.array(F.lit("name")), 1).alias("b"), classify.field_label(F.lit("contact"), F.lit("Mobile_no")).alias("c")).first()
    assert list(row) == ["contact", None, "PHONE_NUMBER"]


def test_identities(spark):
    values = [("1998-08-14", "date-of-birth"), ("Ann Lee", "name")]
    text = "born 1998-08-14 or 14/08/1998 or 14-08-1998, not 1998-08-15. Ann  Lee and ann lee, Annlee"
    df = spark.createDataFrame([(text, values)], "t string, v array<struct<value:string,category:string>>")
    found = lambda g: [f.kind for f in df.select(texts.identity_findings(F.col("t"), F.col("v"), g).alias("f")).first().f]
    assert found(1) == [] and found(2) == ["DOB"] * 3 and found(3) == ["DOB"] * 3 + ["NAME"] * 2
    clean = df.select(texts.without_identities(F.col("t"), F.col("v"), 3)).first()[0]
    assert clean == "born [REDACTED:DOB] or [REDACTED:DOB] or [REDACTED:DOB], not 1998-08-15. [REDACTED:NAME] and [REDACTED:NAME], Annlee"


def test_learned_identities(spark):
    rows = [("d", 1, "Full name", "Ann Lee"), ("d", 2, "DOB", "1998-08-14"), ("d", 3, "Full name", "Ann Lee"), ("d", 4, "Colour", "red")]
    df = spark.createDataFrame(rows, "k string, position int, label string, value string")
    got = texts.learned_identities(df, "k").first()
    assert [(v.value, v.category) for v in got["values"]] == [("Ann Lee", "name"), ("1998-08-14", "date-of-birth")]


def test_task_fields(spark):
    task = "Set preferred name to be Asha; work email: asha@x.in, city is Pune then submit the form. City: Delhi"
    df = spark.createDataFrame([(task,), ("nothing here",)], "t string")
    got = [r.m for r in df.select(texts.task_fields(F.col("t")).alias("m")).collect()]
    assert got == [{"preferredName": "to be Asha", "workEmail": "asha@x.in", "city": "Pune"}, {}]


def test_canaries(spark):
    canaries = spark.createDataFrame([("c1", "secret name"), ("c2", "ab"), ("c3", "AB-12-CD-34-EF")], "canary_id string, value string")
    rows = spark.createDataFrame([(1, "a Secret Name"), (2, "x=secret%20name"), (3, "c2VjcmV0IG5hbWU="), (4, "[REDACTED:NAME]"), (5, "AB 12 CD 34 EF")], "id int, text string")
    client = {(r.id, r.canary_id, r.form) for r in texts.canary_leaks(rows, canaries, "text", "id").collect()}
    assert client == {(1, "c1", "plain"), (2, "c1", "url"), (3, "c1", "base64")}
    verifier = {(r.id, r.canary_id, r.form) for r in texts.canary_leaks(rows, canaries, "text", "id", "verifier").collect()}
    assert (5, "c3", "separated") in verifier and (3, "c1", "base64") in verifier


def test_unsafe_keys_and_last_gate(spark):
    rows = [('{"a": {"InnerHTML": 1}}', True), ('{"a": "value"}', False), ("{broken", True), (None, True)]
    df = spark.createDataFrame([(r[0],) for r in rows], "j string")
    assert [r.u for r in df.select(texts.has_unsafe_keys(F.col("j")).alias("u")).collect()] == [u for _, u in rows]
    gate = texts.dlp_blocked(spark.createDataFrame([("fine", "dev@example.in"), ("fine", "ok")], "a string, b string"), ["a", "b"], 2)
    assert [r.blocked for r in gate.collect()] == [True, False]


def test_hmac_and_luhn(spark):
    import hashlib
    import hmac

    row = spark.range(1).select(hmac_sha256(b"key" * 40, F.lit("https://é.example")).alias("h"), luhn(F.lit("4111111111111111")).alias("a"), luhn(F.lit("4111111111111112")).alias("b")).first()
    assert row.h == hmac.new(b"key" * 40, "https://é.example".encode(), hashlib.sha256).hexdigest()
    assert (row.a, row.b) == (True, False)


def test_documents_and_columns_agree(spark):
    """The predicates on a line are those on a column."""
    from gradeveil.operators import documents

    lines = ["ABCDE 1234 F", "no 1234 5678 9012", "Aadhaar number: 123456789012", "4111 1111 1111 1111", "4111-1111-1111-1112", "valid thru 12/29", "13/99", "113/25", "14/08/1998", "CVV: 123", "Ananya Rao", "Income Tax", "Ananya", ""]
    tests = [(documents.has_pan, classify.has_pan), (documents.has_aadhaar, classify.has_aadhaar), (documents.has_expiry, classify.has_expiry), (documents.is_date, classify.has_date), (documents.is_name, classify.is_name_value), (documents.has_card_number, lambda t: F.size(classify.card_numbers(t)) > 0)]
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    got = {r.text: [bool(v) for v in r[1:]] for r in df.select("text", *(f(F.col("text")).alias(f"t{i}") for i, (_, f) in enumerate(tests))).collect()}
    assert got == {x: [bool(f(x)) for f, _ in tests] for x in lines}
