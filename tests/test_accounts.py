import hashlib

from pyspark.sql import functions as F

from reelspark.operators import accounts

USERS = "id long, email string, password_hash string, password_salt string, is_active int, email_verified_at string, last_login_at string"
CODES = "user_id long, code_hash string, created_at string, expires_at string, attempts int"


def test_passwords(spark):
    salt = "0a" * 16
    want = hashlib.scrypt(b"secret words", salt=bytes.fromhex(salt), n=1 << 14, r=8, p=1).hex()
    users = spark.createDataFrame([(1, "a@x.org", want, salt, 1, "t", None), (2, "b@x.org", want, salt, 1, None, None), (3, "c@x.org", want, salt, 0, "t", None)], USERS)
    tries = [(" A@X.org", "secret words"), ("a@x.org", "Secret words"), ("b@x.org", "secret words"), ("c@x.org", "secret words"), ("d@x.org", "secret words"), ("a@x.org", None)]
    got = accounts.authenticate(users, spark.createDataFrame(tries, "email string, password string")).collect()
    assert sorted((r.email, r.user_id, r.outcome) for r in got if r.outcome != "refused") == [("a@x.org", 1, "ok"), ("b@x.org", 2, "unverified")] and len(got) == 6


def test_codes_from_issue_to_use(spark):
    users = spark.createDataFrame([(1, "a@x.org", "", "", 1, None, None), (2, "b@x.org", "", "", 1, None, None)], USERS)
    asked = spark.createDataFrame([("a@x.org", "000123"), ("b@x.org", "000456")], "email string, code string")
    codes = accounts.issue_codes(users, spark.createDataFrame([], CODES), asked, "2024-01-01 00:00:00", 15)
    assert {r.user_id: (r.expires_at, r.attempts) for r in codes.collect()} == {1: ("2024-01-01 00:15:00", 0), 2: ("2024-01-01 00:15:00", 0)}
    assert {r.error: r.wait_seconds for r in accounts.code_requests(users, codes, asked, "2024-01-01 00:00:20").collect()} == {"too soon": 40}
    tries = spark.createDataFrame([("a@x.org", " 000123 "), ("b@x.org", "000123")], "email string, code string")
    seen = accounts.code_tries(users, codes, tries, "2024-01-01 00:05:00")
    assert {r.user_id: r.outcome for r in seen.collect()} == {1: "verified", 2: "wrong code"}
    users, codes = accounts.apply_tries(users, codes, seen, "2024-01-01 00:05:00")
    assert {r.id: r.email_verified_at for r in users.collect()} == {1: "2024-01-01 00:05:00", 2: None}
    assert [(r.user_id, r.attempts) for r in codes.collect()] == [(2, 1)]
    late = accounts.code_tries(users, codes, spark.createDataFrame([("b@x.org", "000456")], "email string, code string"), "2024-01-01 00:15:00")
    assert late.first().outcome == "expired"
    spent = codes.withColumn("attempts", F.lit(6))
    assert accounts.code_tries(users, spent, tries, "2024-01-01 00:05:00").where("user_id = 2").first().outcome == "too many attempts"


def test_read_only_and_admins(spark):
    users = spark.createDataFrame([(1, "a@x.org", "", "", 1, "t", None), (2, "b@x.org", "", "", 1, None, None)], USERS)
    got = {r.id: (r.may_read, r.may_write, r.may_admin) for r in accounts.allowed(users, [" A@x.org"], True).collect()}
    assert got == {1: (True, False, True), 2: (False, False, False)}
