"""Scrubbing by ordered rules: what is replaced, what is kept, and that claims don't overlap."""

from pyspark.sql import functions as F

from tidemark.functions import scrub

SK, GH, AWS = "sk-" + "abcdefghijklmnop1234", "ghp_" + "16C7e42F292c6912E7710c83", "AKIA" + "IOSFODNN7EXAMPLE"
CASES = {
    "Tax file number 123 456 782": "Tax file number [tax file number]", "TFN: 123456782": "TFN: [tax file number]", "Medicare 2123 45670 1": "Medicare [medicare number]",
    "card shows 2123 45670 1 on it": "card shows [medicare number] on it", "batch 123 456 782 processed": None,
    "BSB 062-000, account 12345678": "BSB 062-000, account [bank account]", "Remit to BSB 062-000, 12345678": "Remit to BSB 062-000, [bank account]", "BSB 062-000 / 12345678": "BSB 062-000 / [bank account]",
    "BSB 062-000 Acct 12345678": "BSB 062-000 Acct [bank account]", "BSB 062-000 A/C 12345678": "BSB 062-000 A/C [bank account]", "Account 4 500 000 AUD in the ledger": None,
    "Passport PA0941234 expires soon": "Passport [id number] expires soon", "Drivers licence 04829173": "Drivers licence [id number]", "Centrelink CRN 203 456 789A is on file": "Centrelink CRN [id number] is on file",
    "call +61 412 345 678 now": "call [phone number] now", "call 0412 987 654 now": "call [phone number] now", "call 03 9876 5432 now": "call [phone number] now",
    "IRD 49-091-850": "IRD [ird number]", "NHI ZAC5361 on the referral": "NHI [nhi number] on the referral", "GST 49091850 filed": "GST [ird number] filed", "GST 100 000 payable this quarter": None,
    "files under 136-410-132 this year": "files under [ird number] this year", "paid into 01-0123-0123456-00": "paid into [bank account]", "call +64 21 555 0134 now": "call [phone number] now", "call 021 555 0198 now": "call [phone number] now",
    "Harbourline trades as ABN 51 824 753 556": None, "ACN 004 085 616 on the invoice": None, "NZBN 9429041234567 registered": None, "supplier 51 824 753 556 approved": None,
    "Tax file number 100000182": "Tax file number [tax file number]", "Tax file number 100 000 182": "Tax file number [tax file number]", "Account number 51824753556": "Account number [bank account]",
    f"export OPENAI_API_KEY={SK}": "export OPENAI_API_KEY=[redacted secret]", f"git push with {GH}": "git push with [redacted secret]", f"aws configure {AWS}": "aws configure [redacted secret]",
    "api_key: 9f8e7d6c5b4a": "api_key: [redacted secret]", "password: Tr0ub4dor&3": "password: [redacted password]", "Temporary password\nSumm3r!2026\nChange it": "Temporary password\n[redacted password]\nChange it",
    "DOB: 04/12/1985": "DOB: [redacted date of birth]", "Employee ID: EMP-04481": "Employee ID: [redacted employee id]", "Set password: hunter42, then log in": "Set password: [redacted password], then log in",
    "api_key: 9f8e7d6c5b4a.": "api_key: [redacted secret].", "password: password": "password: [redacted password]", "pass = pass": "pass = [redacted password]", "api_key: api_key123": "api_key: [redacted secret]",
    "card 4111 1111 1111 1111": "card [payment card]", "batch 4820 1174 9930 2217 shipped": None, "SSN 078-05-1120": "SSN [id number]", "sarah.chen@harbourline.com.au asked Tom Whitaker to sign": None,
    "Ticket DEU-205 on 3f2a9c1e-7b44-4d0a-9e21-8c5f6b0d1234, host 10.0.14.203:5432, build v1.5.5-alpha.2, commit 67221f6": None, "processed 1 000 000 rows in 4 steps": None, "Q3 2026 revenue 12 500 AUD, up 15%": None,
    "container limit 8192 MB, exit code 137": None, "NetSuite > Payables > Harbourline": None, "INV-2026-0417 due 2026-04-01": None, "": None, "ü ß call 0412 987 654, dob 1 1 2001!": "ü ß call [phone number], dob [redacted date of birth]!",
}


def test_rules(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*CASES, None])], "i int, t string").repartition(2)
    got = [r.v for r in df.select("i", scrub.scrubbed(F.col("t")).alias("v")).orderBy("i").collect()]
    assert dict(zip(CASES, got, strict=False)) == {k: k if v is None else v for k, v in CASES.items()} and got[-1] is None


def test_claims_are_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 5000")
    for r in docs.select("text", scrub.claims(F.col("text")).alias("c")).limit(60).collect():
        spans = sorted((c.start, c.end) for c in r.c or [])
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
