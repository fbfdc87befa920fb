"""Secret rules on files of several kinds, and entry files."""

import base64

import pytest
from pyspark.sql import functions as F

from graphloam.operators import rules
from graphloam.operators import views as vw


def part(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


TOKEN = f"{part('{"alg": "HS256"}')}.{part('{"sub": "1234567890"}')}.{part('signature-bytes')}"
KEY = "AKIA" + "IOSFODNN7ABCDEFG"
GOOGLE = "AIza" + "Sy0123456789abcdefghijklmnopqrstuvw"
LINES = [
    ("code", f'auth: "{TOKEN}"', ("JSON Web Token", "medium")),
    ("code", 'auth: "abcdefghijk.abcdefghijk.abcdefghijk"', None),
    ("code", 'if (password == "hunter2Z9!x")', None),
    ("code", 'if (password !== "hunter2Z9!x")', None),
    ("code", 'api_key := "hunter2Z9!x"', ("Hardcoded secret", "medium")),
    ("code", "'db.apiKey' => 'hunter2Z9!x'", ("Hardcoded secret", "medium")),
    ("code", "password = hunter2Z9!x", None),
    ("bare", "password = hunter2Z9!x", ("Hardcoded secret", "medium")),
    ("bare", "password => hunter2Z9!x", None),
    ("env", "PASSWORD=hunter2Z9!x", None),
    ("sample", f"key {KEY}", ("AWS access key", "medium")),
    ("sample", 'password = "hunter2Z9!x"', None),
    ("code", f"VITE_MAP_KEY={GOOGLE}", None),
    ("code", f"VITE_AWS={KEY}", ("Secret in a browser variable", "high")),
    ("code", "NEXT_PUBLIC_SECRET_ID: 'abcd1234'", ("Secret in a browser variable", "high")),
    ("code", "NEXT_PUBLIC_URL: 'https://u:s3cr3tPw@h/db'", None),
    ("code", "postgres://user:s3cr3tPw@h/db", ("Password in a URL", "medium")),
    ("code", "postgres://sesame:sesame@h/db", None),
    ("code", "postgres://user:short@h/db", None),
    ("code", "x" * 200_000 + " key", None),
    ("code", None, None),
]


def test_findings_by_kind_of_file(spark):
    rows = [(kind, i, line) for i, (kind, line, _) in enumerate(LINES)]
    lines = spark.createDataFrame(rows, "file string, line int, line_text string")
    found = rules.secret_scan(lines, F.col("file") == "sample", F.col("file") == "bare", F.col("file") == "env").collect()
    assert {r.line: (r.title, r.severity) for r in found} == {i: x for i, (_, _, x) in enumerate(LINES) if x}


@pytest.mark.parametrize("path,entry", [("a/vite.config.ts", True), ("a/.eslintrc", True), ("a/x.d.ts", True), ("a/x.config-dev.js", True), ("a/config.py", False), ("a/x.config", False), ("a/xd.ts", False), ("bin/tool", True), ("src/index.ts", True)])
def test_entry_files(spark, path, entry):
    assert spark.createDataFrame([(path,)], "p string").select(vw.is_entry(F.col("p"))).first()[0] is entry


def test_query_of_secrets_says_what_its_sql_says(spark, tmp_path):
    from parity import difference

    from graphloam.queries import ORACLES, QUERIES

    lines = [
        "key AKIA" + "1234567890ABCDEF", "password = 'abcd1234efgh' # AKIA" + "1234567890ABCDEF", "token: \"changeme123\"", "my.api-key => `example1value`",
        "--secret='a1b2c3d4'", "épassword='a1b2c3d4'", "pwd := \"short1\"", "token == 'abcd1234efgh'", "password = 'with space 12'", "password='UPPER1234' secret='lower1234'",
        "passwords='abcd1234'", "access_key\"\t:\t\"abcdefgh1\"", "to\u212aen='abcd1234efgh'", "x" * 50 + "secret_key='" + "a1" * 100 + "'", "secretkey='" + "a1" * 101 + "'", "https://u:abcdef12@h/", "token='é1é1é1é1a'", "PASSWD='a1234567\u00a08'",
    ]
    spark.createDataFrame([(1, "en", "s", "\n".join(lines)), (2, "en", "s", None), (3, "en", "s", "\r\n".join(lines[::-1]))], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert difference(QUERIES["secret_scan"](spark, str(tmp_path)), ORACLES["secret_scan"], str(tmp_path)) is None
