"""Accounts, verification codes and sessions as transformations of their tables.

users (id, email, password_hash, password_salt, is_active, email_verified_at, last_login_at), codes (user_id, code_hash,
created_at, expires_at, attempts), sessions (token_hash, user_id, created_at, expires_at). Times are UTC texts. A
request that can't be met has an error; the tables take the others.
"""

from __future__ import annotations

import hashlib
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import email_key, is_email, stripped
from .merge import assign_ids

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

# The password function's costs, and the bounds of passwords and codes.
SCRYPT = {"n": 1 << 14, "r": 8, "p": 1}
SHORTEST, LONGEST = 8, 256
DIGITS, ATTEMPTS, COOLDOWN = 6, 6, 60


def password_error(password: Column) -> Column:
    return F.when(F.length(password) < SHORTEST, "password too short").when(F.length(password) > LONGEST, "password too long")


def password_hash(password: Column, salt: Column) -> Column:
    """scrypt in hexadecimal, of a password and a salt in hexadecimal. It is meant to be slow: no built-in has it."""

    def of(passwords: pd.Series, salts: pd.Series) -> pd.Series:
        one = lambda p, s: None if p is None or s is None else hashlib.scrypt(p.encode(), salt=bytes.fromhex(s), **SCRYPT).hex()
        return pd.Series([one(p, s) for p, s in zip(passwords, salts, strict=True)], dtype=object)

    return F.pandas_udf(of, T.StringType())(password, salt)


def code_hash(user_id: Column, code: Column) -> Column:
    return F.sha2(F.concat_ws(":", user_id.cast("string"), code), 256)


def later(now: str, seconds: int) -> Column:
    return F.date_format(F.to_timestamp(F.lit(now)) + F.make_dt_interval(secs=F.lit(seconds)), "yyyy-MM-dd HH:mm:ss")


def account_errors(wanted: DataFrame, users: DataFrame) -> DataFrame:
    """wanted (email, password) with the address's key and ``error``, null where an account can be made."""
    held = users.select(F.col("email").alias("_held"))
    rows = wanted.withColumn("email", email_key(F.col("email"))).join(held, F.col("email") == F.col("_held"), "left")
    error = F.when(~is_email(F.col("email")), "no e-mail address")
    error = F.coalesce(error, password_error(F.col("password")), F.when(F.col("_held").isNotNull(), "account exists"))
    return rows.withColumn("error", error).drop("_held")


def create_users(users: DataFrame, wanted: DataFrame, high_water: int, now: str) -> DataFrame:
    """users with the accounts of wanted (email, password_hash, password_salt, verified) that they lack, one for an
    address; ids go on from high_water in the order of addresses."""
    rows = wanted.withColumn("email", email_key(F.col("email"))).where(is_email(F.col("email")))
    one = rows.groupBy("email").agg(F.min(F.struct("password_hash", "password_salt", "verified")).alias("w"))
    new = one.join(users.select("email"), "email", "left_anti")
    keys = new.select(F.col("email").alias("file_id"), F.col("email").alias("scan_seq"))
    ids = assign_ids(keys, keys.limit(0), high_water).select("id", F.col("file_id").alias("email"))
    made = new.join(ids, "email").select(
        "id", "email", "w.password_hash", "w.password_salt", F.lit(1).alias("is_active"),
        F.when(F.col("w.verified"), now).alias("email_verified_at"), F.lit(None).cast("string").alias("last_login_at"),
    )
    return users.select(*made.columns).unionByName(made)


def ensure_users(users: DataFrame, codes: DataFrame, wanted: DataFrame, high_water: int, now: str) -> tuple[DataFrame, DataFrame]:
    """users and codes after every account of wanted exists: known ones become verified where wanted, which uses up
    their codes; the others are made."""
    asked = wanted.where("verified").select(email_key(F.col("email")).alias("email")).distinct().withColumn("_v", F.lit(True))
    fresh = F.col("_v") & F.col("email_verified_at").isNull()
    rows = users.join(asked, "email", "left").withColumn("_now", F.coalesce(fresh, F.lit(False)))
    done = rows.where("_now").select(F.col("id").alias("user_id"))
    known = rows.withColumn("email_verified_at", F.when(F.col("_now"), now).otherwise(F.col("email_verified_at"))).select(*users.columns)
    return create_users(known, wanted, high_water, now), codes.join(done, "user_id", "left_anti")


def authenticate(users: DataFrame, tries: DataFrame, hashed=password_hash) -> DataFrame:
    """(email, user_id, outcome) of tries (email, password): ok, unverified, or refused, which doesn't tell a wrong
    password from an unknown or inactive account."""
    t = tries.select(email_key(F.col("email")).alias("email"), "password")
    u = users.where("is_active = 1").select(F.col("email").alias("_e"), "id", "password_hash", "password_salt", "email_verified_at")
    rows = t.join(u, F.col("email") == F.col("_e"), "left")
    right = F.coalesce(hashed(F.col("password"), F.col("password_salt")) == F.col("password_hash"), F.lit(False))
    outcome = F.when(~right, "refused").when(F.col("email_verified_at").isNull(), "unverified").otherwise("ok")
    return rows.select("email", F.when(right, F.col("id")).alias("user_id"), outcome.alias("outcome"))


def logged_in(users: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """users with the time of the log-ins that went well."""
    ok = outcomes.where("outcome = 'ok'").select(F.col("user_id").alias("id"), F.lit(now).alias("_at")).distinct()
    return users.join(ok, "id", "left").withColumn("last_login_at", F.coalesce("_at", "last_login_at")).select(*users.columns)


def code_requests(users: DataFrame, codes: DataFrame, requests: DataFrame, now: str, cooldown: int = COOLDOWN) -> DataFrame:
    """requests (email, code) with user_id, ``error`` and the seconds still to wait."""
    u = users.where("is_active = 1").select(F.col("email").alias("_e"), F.col("id").alias("user_id"), "email_verified_at")
    c = codes.select(F.col("user_id").alias("_u"), F.col("created_at").alias("_sent"))
    rows = requests.select(email_key(F.col("email")).alias("email"), "code").join(u, F.col("email") == F.col("_e"), "left")
    rows = rows.join(c, F.col("user_id") == F.col("_u"), "left")
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("_sent")
    wait = F.when(age < cooldown, F.greatest(F.lit(1), cooldown - age)).otherwise(0)
    error = F.when(F.col("user_id").isNull(), "unknown account").when(F.col("email_verified_at").isNotNull(), "verified already").when(age < cooldown, "too soon")
    return rows.select("email", "user_id", "code", error.alias("error"), F.when(error == "too soon", wait).otherwise(0).cast("long").alias("wait_seconds"))


def issue_codes(users: DataFrame, codes: DataFrame, requests: DataFrame, now: str, minutes: int = 15, cooldown: int = COOLDOWN) -> DataFrame:
    """codes with those of the requests that can be met; a new code begins with no attempts."""
    good = code_requests(users, codes, requests, now, cooldown).where("error is null")
    one = good.groupBy("user_id").agg(F.min("code").alias("code"))
    new = one.select("user_id", code_hash(F.col("user_id"), F.col("code")).alias("code_hash"), F.lit(now).alias("created_at"), later(now, 60 * minutes).alias("expires_at"), F.lit(0).alias("attempts"))
    return codes.select(*new.columns).join(new.select("user_id"), "user_id", "left_anti").unionByName(new)


def code_tries(users: DataFrame, codes: DataFrame, tries: DataFrame, now: str) -> DataFrame:
    """(email, user_id, outcome) of tries (email, code): verified, known (as it was before), or why not."""
    u = users.where("is_active = 1").select(F.col("email").alias("_e"), F.col("id").alias("user_id"), "email_verified_at")
    c = codes.select(F.col("user_id").alias("_u"), F.col("code_hash").alias("_hash"), F.col("expires_at").alias("_until"), F.col("attempts").alias("_n"))
    rows = tries.select(email_key(F.col("email")).alias("email"), stripped(F.col("code")).alias("code")).join(u, F.col("email") == F.col("_e"), "left")
    rows = rows.join(c, F.col("user_id") == F.col("_u"), "left")
    outcome = (
        F.when(~F.col("code").rlike(rf"^[0-9]{{{DIGITS}}}$"), "not six digits")
        .when(F.col("user_id").isNull(), "unknown account")
        .when(F.col("email_verified_at").isNotNull(), "known")
        .when(F.col("_hash").isNull(), "no code")
        .when(F.col("_n") >= ATTEMPTS, "too many attempts")
        .when(F.col("_until") <= now, "expired")
        .when(F.col("_hash") != code_hash(F.col("user_id"), F.col("code")), "wrong code")
        .otherwise("verified")
    )
    return rows.select("email", "user_id", outcome.alias("outcome"))


def apply_tries(users: DataFrame, codes: DataFrame, outcomes: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """users and codes after code_tries(), one try a user: who is verified gets the time and loses the code, a wrong
    code counts an attempt."""
    done = outcomes.where("outcome = 'verified'").select("user_id").distinct()
    wrong = outcomes.where("outcome = 'wrong code'").groupBy("user_id").agg(F.count("*").cast("int").alias("_more"))
    marks = done.select(F.col("user_id").alias("id"), F.lit(now).alias("_at"))
    known = users.join(marks, "id", "left").withColumn("email_verified_at", F.coalesce("_at", "email_verified_at")).select(*users.columns)
    left = codes.join(done, "user_id", "left_anti").join(wrong, "user_id", "left")
    return known, left.withColumn("attempts", F.col("attempts") + F.coalesce("_more", F.lit(0))).select(*codes.columns)


def delete_codes(codes: DataFrame, user_ids: DataFrame) -> DataFrame:
    return codes.join(user_ids.select("user_id"), "user_id", "left_anti").select(*codes.columns)


def delete_unverified(users: DataFrame, codes: DataFrame, sessions: DataFrame, user_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """users, codes and sessions without those of user_ids (user_id) that were never verified; what is theirs goes."""
    gone = users.where("email_verified_at is null").join(user_ids.select(F.col("user_id").alias("id")), "id", "left_semi").select("id")
    theirs = gone.withColumnRenamed("id", "user_id")
    return users.join(gone, "id", "left_anti").select(*users.columns), delete_codes(codes, theirs), sessions.join(theirs, "user_id", "left_anti").select(*sessions.columns)


def create_sessions(sessions: DataFrame, wanted: DataFrame, now: str, days: int = 14) -> DataFrame:
    """sessions without those that have expired, with those of wanted (token, user_id)."""
    new = wanted.select(F.sha2("token", 256).alias("token_hash"), "user_id", F.lit(now).alias("created_at"), later(now, 86400 * days).alias("expires_at"))
    return sessions.select(*new.columns).where(F.col("expires_at") > now).unionByName(new)


def delete_sessions(sessions: DataFrame, tokens: DataFrame) -> DataFrame:
    """sessions without those of tokens (token)."""
    return sessions.join(tokens.select(F.sha2("token", 256).alias("token_hash")), "token_hash", "left_anti").select(*sessions.columns)


def allowed(users: DataFrame, admins: list[str], read_only: bool) -> DataFrame:
    """(id, email, may_read, may_write, may_admin): what an account may do; nothing is written where the catalogue is
    read-only, and only the named addresses administer it."""
    active = (F.col("is_active") == 1) & F.col("email_verified_at").isNotNull()
    admin = F.col("email").isin([a.strip().lower() for a in admins])
    return users.select("id", "email", active.alias("may_read"), (active & F.lit(not read_only)).alias("may_write"), (active & admin).alias("may_admin"))
