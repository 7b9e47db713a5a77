"""Queries over accounts, codes, sessions and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accounts, merge
from .queries import Tables, query

NOW = "2024-01-01 00:01:00"
#: Requests with the address's key and its account: ask; codes with their hashes: held.
_ASK = """, ask AS (SELECT n, lower(trim(email)) AS email, password, code, verified FROM asked),
ok AS (SELECT * FROM ask WHERE regexp_full_match(email, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')),
fresh AS (SELECT email, min(password) AS password, bool_or(verified) AS verified FROM ok WHERE email NOT IN (SELECT email FROM users) GROUP BY 1),
made AS (SELECT 9000 + row_number() OVER (ORDER BY email) AS id, email, password AS password_hash, '00ff' AS password_salt, 1 AS is_active, CASE WHEN verified THEN '2024-01-01 00:01:00' END AS email_verified_at FROM fresh),
held AS (SELECT *, sha256(CAST(user_id AS VARCHAR) || ':' || lpad(CAST(user_id % 3 AS VARCHAR), 6, '0')) AS code_hash FROM codes)
"""


def _asked(t: Tables) -> DataFrame:
    return t.asked


def _codes(t: Tables) -> DataFrame:
    return t.codes.withColumn("code_hash", accounts.code_hash(F.col("user_id"), F.lpad((F.col("user_id") % 3).cast("string"), 6, "0")))


def _wanted(t: Tables) -> DataFrame:
    return t.asked.select("email", F.col("password").alias("password_hash"), F.lit("00ff").alias("password_salt"), "verified")


def _same(password, salt):
    """The test tables hold passwords as they are; the real function is tested with real hashes."""
    return password


_USER = ["id", "email", "password_hash", "is_active", "email_verified_at"]
query("account_errors", lambda t: accounts.account_errors(t.asked.select("n", "email", "password"), t.users).select("n", "email", "error"),
      _ASK + "SELECT n, ask.email, CASE WHEN NOT regexp_full_match(ask.email, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') THEN 'no e-mail address' WHEN length(password) < 8 THEN 'password too short' WHEN length(password) > 256 THEN 'password too long' WHEN users.email IS NOT NULL THEN 'account exists' END AS error FROM ask LEFT JOIN users ON users.email = ask.email", "asked", "users", "codes")
query("create_users", lambda t: accounts.create_users(t.users, _wanted(t), 9000, NOW).select(*_USER),
      _ASK + "SELECT id, email, password_hash, is_active, email_verified_at FROM users UNION ALL SELECT id, email, password_hash, is_active, email_verified_at FROM made", "asked", "users", "codes")
_ENSURED = ", ens AS (SELECT DISTINCT users.id FROM users JOIN ask ON ask.email = users.email AND ask.verified WHERE email_verified_at IS NULL)"
query("ensure_users", lambda t: accounts.ensure_users(t.users, t.codes, _wanted(t), 9000, NOW)[0].select(*_USER),
      _ASK + _ENSURED + f" SELECT id, email, password_hash, is_active, CASE WHEN id IN (SELECT id FROM ens) THEN '{NOW}' ELSE email_verified_at END AS email_verified_at FROM users UNION ALL SELECT id, email, password_hash, is_active, email_verified_at FROM made", "asked", "users", "codes")
query("ensure_users_codes", lambda t: accounts.ensure_users(t.users, t.codes, _wanted(t), 9000, NOW)[1].select("user_id", "attempts"),
      _ASK + _ENSURED + " SELECT user_id, attempts FROM codes WHERE user_id NOT IN (SELECT id FROM ens)", "asked", "users", "codes")
_AUTH = ", au AS (SELECT ask.n, ask.email, CASE WHEN users.id IS NOT NULL AND password = password_hash THEN users.id END AS user_id, CASE WHEN users.id IS NULL OR password <> password_hash THEN 'refused' WHEN email_verified_at IS NULL THEN 'unverified' ELSE 'ok' END AS outcome FROM ask LEFT JOIN users ON users.email = ask.email AND is_active = 1)"
query("authenticate", lambda t: accounts.authenticate(t.users, _asked(t), _same), _ASK + _AUTH + " SELECT email, user_id, outcome FROM au", "asked", "users", "codes")
query("logged_in", lambda t: accounts.logged_in(t.users, accounts.authenticate(t.users, _asked(t), _same), NOW).select("id", "last_login_at"),
      _ASK + _AUTH + f" SELECT id, CASE WHEN id IN (SELECT user_id FROM au WHERE outcome = 'ok') THEN '{NOW}' END AS last_login_at FROM users", "asked", "users", "codes")
_REQUESTED = """, rq AS (SELECT ask.n, ask.email, ask.code, users.id AS user_id, email_verified_at, created_at, 60 - CAST(substr(created_at, 18, 2) AS BIGINT) AS age FROM ask LEFT JOIN users ON users.email = ask.email AND is_active = 1 LEFT JOIN codes ON codes.user_id = users.id),
re AS (SELECT *, CASE WHEN user_id IS NULL THEN 'unknown account' WHEN email_verified_at IS NOT NULL THEN 'verified already' WHEN age < 30 THEN 'too soon' END AS error FROM rq)"""
query("code_requests", lambda t: accounts.code_requests(t.users, _codes(t), _asked(t), NOW, 30),
      _ASK + _REQUESTED + " SELECT email, user_id, code, error, CAST(CASE WHEN error = 'too soon' THEN greatest(1, 30 - age) ELSE 0 END AS BIGINT) AS wait_seconds FROM re", "asked", "users", "codes")
query("issue_codes", lambda t: accounts.issue_codes(t.users, _codes(t), _asked(t), NOW, 15, 30),
      _ASK + _REQUESTED + f", nw AS (SELECT user_id, min(code) AS code FROM re WHERE error IS NULL GROUP BY 1) SELECT user_id, code_hash, created_at, expires_at, attempts FROM held WHERE user_id NOT IN (SELECT user_id FROM nw) UNION ALL SELECT user_id, sha256(CAST(user_id AS VARCHAR) || ':' || code), '{NOW}', '2024-01-01 00:16:00', 0 FROM nw", "asked", "users", "codes")
_TRIED = f""", tr AS (SELECT ask.email, users.id AS user_id, CASE WHEN NOT regexp_full_match(trim(code), '[0-9]{{6}}') THEN 'not six digits' WHEN users.id IS NULL THEN 'unknown account' WHEN email_verified_at IS NOT NULL THEN 'known' WHEN code_hash IS NULL THEN 'no code'
    WHEN attempts >= 6 THEN 'too many attempts' WHEN expires_at <= '{NOW}' THEN 'expired' WHEN code_hash <> sha256(CAST(users.id AS VARCHAR) || ':' || trim(code)) THEN 'wrong code' ELSE 'verified' END AS outcome
    FROM ask LEFT JOIN users ON users.email = ask.email AND is_active = 1 LEFT JOIN held ON held.user_id = users.id)"""
query("code_tries", lambda t: accounts.code_tries(t.users, _codes(t), _asked(t), NOW), _ASK + _TRIED + " SELECT email, user_id, outcome FROM tr", "asked", "users", "codes")


def _applied(which: int):
    return lambda t: accounts.apply_tries(t.users, _codes(t), accounts.code_tries(t.users, _codes(t), _asked(t), NOW), NOW)[which]


query("verified_users", lambda t: _applied(0)(t).select("id", "email_verified_at"),
      _ASK + _TRIED + f" SELECT id, CASE WHEN id IN (SELECT user_id FROM tr WHERE outcome = 'verified') THEN '{NOW}' ELSE email_verified_at END AS email_verified_at FROM users", "asked", "users", "codes")
query("codes_after_tries", lambda t: _applied(1)(t).select("user_id", "attempts"),
      _ASK + _TRIED + " SELECT held.user_id, CAST(attempts + count(outcome) AS INTEGER) AS attempts FROM held LEFT JOIN tr ON tr.user_id = held.user_id AND outcome = 'wrong code' WHERE held.user_id NOT IN (SELECT user_id FROM tr WHERE outcome = 'verified') GROUP BY held.user_id, attempts", "asked", "users", "codes")
_some = lambda t: t.users.where("id % 4 < 2").select(F.col("id").alias("user_id"))
query("delete_codes", lambda t: accounts.delete_codes(t.codes, _some(t)).select("user_id", "attempts"), "SELECT user_id, attempts FROM codes WHERE user_id % 4 >= 2", "codes")
query("delete_unverified", lambda t: accounts.delete_unverified(t.users, t.codes, t.sessions, _some(t))[0].select("id", "email"), "SELECT id, email FROM users WHERE id % 4 >= 2 OR email_verified_at IS NOT NULL", "users")
query("delete_unverified_sessions", lambda t: accounts.delete_unverified(t.users, t.codes, t.sessions, _some(t))[2].select("token_hash", "user_id"),
      "SELECT token_hash, user_id FROM sessions WHERE user_id NOT IN (SELECT id FROM users WHERE id % 4 < 2 AND email_verified_at IS NULL)", "users", "sessions")
_stamped = lambda t: t.sessions.withColumn("created_at", F.lit("1990-01-01 00:00:00"))
query("create_sessions", lambda t: accounts.create_sessions(_stamped(t), t.users.select(F.concat(F.lit("t"), "id").alias("token"), F.col("id").alias("user_id")), "1996-01-01 00:00:00", 2),
      "SELECT token_hash, user_id, '1990-01-01 00:00:00' AS created_at, expires_at FROM sessions WHERE expires_at > '1996-01-01 00:00:00' UNION ALL SELECT sha256('t' || id), id, '1996-01-01 00:00:00', '1996-01-03 00:00:00' FROM users", "users", "sessions")
_hashed = lambda t: t.sessions.select(F.sha2("token_hash", 256).alias("token_hash"), "user_id")
query("delete_sessions", lambda t: accounts.delete_sessions(_hashed(t), t.sessions.where("user_id % 2 = 0").select(F.col("token_hash").alias("token"))),
      "SELECT sha256(token_hash) AS token_hash, user_id FROM sessions WHERE user_id % 2 <> 0", "sessions")
query("allowed", lambda t: accounts.allowed(t.users, ["customer-000000007@x.example "], False),
      "SELECT id, email, ok AS may_read, ok AS may_write, ok AND email = 'customer-000000007@x.example' AS may_admin FROM (SELECT *, is_active = 1 AND email_verified_at IS NOT NULL AS ok FROM users)", "users")
query("password_bounds", lambda t: t.asked.select("n", accounts.password_error(F.when(F.col("n") % 9 == 0, F.repeat("password", 60)).otherwise(F.col("password"))).alias("error")),
      "SELECT n, CASE WHEN length(p) < 8 THEN 'password too short' WHEN length(p) > 256 THEN 'password too long' END AS error FROM (SELECT n, CASE WHEN n % 9 = 0 THEN repeat(password, 60) ELSE password END AS p FROM asked)", "asked")

# ---- settings
_FOLDER = [("drive_folder_id", "F9"), ("drive_folder_name", "New"), ("drive_folder_url", "https://x.example/F9")]
_SCAN = [("drive_last_scan_status", "succeeded"), ("drive_folder_id", "kept by")]


def _put(values: list[tuple[str, str]], user: str | None):
    return lambda t: merge.put_settings(t.settings, t.spark.createDataFrame(values, "key string, value string"), F.lit(NOW), user)


def _put_sql(values: list[tuple[str, str]], who: str) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in values)
    return f", nv(k, v) AS (VALUES {rows}) SELECT coalesce(k, key) AS key, coalesce(v, value) AS value, {who} AS updated_by_email, CASE WHEN k IS NOT NULL THEN '{NOW}' ELSE updated_at END AS updated_at FROM settings FULL JOIN nv ON k = key"


query("put_folder_setting", _put(_FOLDER, "me@x.example"), _put_sql(_FOLDER, "CASE WHEN k IS NOT NULL THEN 'me@x.example' ELSE updated_by_email END"), "settings")
query("record_scan", _put(_SCAN, None), _put_sql(_SCAN, "coalesce(updated_by_email, '')"), "settings")
