"""Sign-up checks. Passwords are only compared here and are never put out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.text import trim_all

LEAST_NAME, LEAST_PASSWORD = 2, 8


def validate_signups(signups: DataFrame, users: DataFrame) -> DataFrame:
    """``form_errors`` names every failed field, ``server_error`` the first failed check; of equal emails in one batch only the first row that passes is accepted. ``signup_id`` is a key."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("name", "email", "password", "password_confirm")}
    form = F.array_compact(F.array(
        F.when((trim_all(text["name"]) == "") | (F.length(text["name"]) < LEAST_NAME), "name"),
        F.when((trim_all(text["email"]) == "") | ~F.contains(text["email"], F.lit("@")), "email"),
        F.when(F.length(text["password"]) < LEAST_PASSWORD, "password"),
        F.when(text["password"] != text["password_confirm"], "password_confirm"),
    ))
    taken = users.select("email").distinct().withColumn("taken", F.lit(True))
    rows = signups.join(taken, "email", "left")
    server = F.coalesce(F.when(F.col("taken"), "email"), F.when(F.length(text["password"]) < LEAST_PASSWORD, "password"), F.when(text["password"] != text["password_confirm"], "password_confirm"))
    checked = rows.select("signup_id", "email", F.concat_ws(",", form).alias("form_errors"), server.alias("server_error"))
    passes = (F.col("form_errors") == "") & F.col("server_error").isNull()
    # the least id of each email among rows that pass: partial minima meet a hot email before the shuffle, and ids are met by id
    first = checked.filter(passes).groupBy("email").agg(F.min("signup_id").alias("signup_id")).select("signup_id", F.lit(True).alias("first"))
    told = checked.join(first, "signup_id", "left")
    return told.select("signup_id", "form_errors", F.coalesce("server_error", F.lit("")).alias("server_error"), (passes & F.coalesce("first", F.lit(False))).alias("accepted"))
