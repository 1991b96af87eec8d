"""IBANs are found whatever follows them."""

from ferry.llm import pii

IBANS = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947"]
AFTER = [" Please", " BIC COBADEFF", " 250 EUR", " 7", ", x", "", " FR14 2004 1010 0505 0001 3M02 606", " A"]


def test_ibans_before_capitals_digits_and_ibans(spark):
    texts = [f"account {iban}{after}" for iban in IBANS for after in AFTER] + ["account DE88370400440532013000 Please"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "iban"] for r in pii.find_personal_data(docs).collect()}
    wanted = [[iban, *([after[1:]] if after[1:3] == "FR" else [])] for iban in IBANS for after in AFTER] + [[]]
    assert found == dict(enumerate(wanted))
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(docs).collect()}
    assert masked[0] == "account [IBAN] Please" and masked[6] == "account [IBAN] [IBAN]"
