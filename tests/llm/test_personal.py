import pytest

from codeloom.llm.personal import candidates, estimate, personal_items, redacted, verdict
from codeloom.plans.scratch import Scratch

CASES = [
    ("Reported by Lena M. Vorholt (lena.vorholt [at] mail.example.net).", {("name", "Lena M. Vorholt"), ("email", "lena.vorholt [at] mail.example.net")}),
    ("Signed-off-by: Vorholt, Lena <lv-3@post.test>", {("name", "Vorholt, Lena"), ("email", "lv-3@post.test")}),
    ("Reviewed by R. Adler and OTTO VAN DER BEEK.", {("name", "R. Adler"), ("name", "OTTO VAN DER BEEK")}),
    ('{"user": "Ana de la Cruz", "mail": "ana@uni.invalid", "tel": "+44 (0)20 7946 0727"}', {("name", "Ana de la Cruz"), ("email", "ana@uni.invalid"), ("phone", "+44 (0)20 7946 0727")}),
    ("Old office: 402 Old Mill Rd., Oldhaven.", {("address", "402 Old Mill Rd.")}),
    ("Bitte das Gerät an priya adler, Alte Fährgasse 32 b, Port Ellan schicken.", {("name", "priya adler"), ("address", "Alte Fährgasse 32 b")}),
    ("Envoyer la carte à Ana Cruz, 46 ter bd des Phares, Oldhaven.", {("name", "Ana Cruz"), ("address", "46 ter bd des Phares")}),
    ("Enviar la placa a Ana Cruz, C/ Molino Viejo, 11, Oldhaven.", {("name", "Ana Cruz"), ("address", "C/ Molino Viejo, 11")}),
    ("请寄到云杉路366号，收件人：靳舟禾。", {("address", "云杉路366号"), ("name", "靳舟禾")}),
    ("Passport no. QQ 36 18 21 D was printed in the debug log for B. Adler.", {("id_number", "QQ 36 18 21 D"), ("name", "B. Adler")}),
    ("Clone git@code.example:atlas/core.git. Pinned kit@3.19.73. Build 2024-123-4567 passed in 3.1234 s.", set()),
    ("See section 17 Lane Detection and 2 Street Network of the plan. ISO stamps such as 2024-01-02T03:04:05 sort.", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_candidates(text, want):
    assert {(k, text[s:e]) for s, e, k, v in candidates(text, weak=False) if not v & 128} == want


def test_estimation_keeps_order():
    chance = estimate({("phone", 5): 100, ("phone", 1): 30, ("phone", 129): 40, ("name", 21): 50, ("name", 33): 500})
    assert chance["phone", 5] > 0.8 > 0.1 > chance["phone", 129] and chance["name", 21] > 0.8 > chance["name", 33]


def test_rows(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(50, None), (51, ""), (52, CASES[0][0] + "\r\n" + CASES[0][0]), (53, "x" * 2_000_000 + " ping ana.cruz@post.test when")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS pii_type", "1 AS start")
    found = {(r["doc_id"], r["pii_type"], r["pii_value"]) for r in personal_items(docs, Scratch(spark, "t")).collect()}
    want = {(i, *x) for i, (_, w) in enumerate(CASES) for x in w} | {(52, *x) for x in CASES[0][1]} | {(53, "email", "ana.cruz@post.test")}
    assert found == want
    texts = {r["doc_id"]: r["text"] for r in redacted(docs, Scratch(spark, "t")).collect()}
    assert texts[0] == "Reported by [NAME] ([EMAIL])." and texts[50] is None and texts[51] == "" and len(texts) == len(rows)
    assert personal_items(docs.where("false"), Scratch(spark, "t")).count() == 0


def test_votes_and_classifier_can_overturn_rules(spark):
    assert verdict(0.9, -9.0) < 0.5 < verdict(0.02, 9.0)
    seen = {("phone", 5): 300, ("phone", 1): 20}
    assert estimate(seen | {("phone", 133): 300})["phone", 133] > 0.5 > estimate(seen | {("phone", 129): 300})["phone", 129]
    rows = [(i, f"tel=+49 30 90{i:04d} rings") for i in range(60)] + [(i, f"build +49 30 90{i:04d} passed") for i in range(100, 130)] + [(i, f"call +49 30 90{i:04d} today") for i in range(200, 260)]
    found = {r["doc_id"] for r in personal_items(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    assert found == {*range(60), *range(200, 260)}


def test_mail_domains_seen_elsewhere_speak_for_an_address(spark):
    from codeloom.llm import personal
    from codeloom.llm.text import map_rows

    rows = [(i, f"contact u{i}.person@known.example today") for i in range(4)] + [(9, "x q.adler [at] known [dot] example y"), (10, "x q.adler@other.test y")]
    spans = map_rows(spark.createDataFrame(rows, "doc_id long, text string"), personal._spans, personal._SPAN, personal._SPAN_ARROW)
    votes = {r["doc_id"]: r["votes"] for r in personal.with_gazetteer(spans).where("pii_type = 'email'").collect()}
    assert votes[9] & 16 and not votes[10] & 16
