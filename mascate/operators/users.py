"""The user table: listing, lookup and bulk changes written as new snapshots."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mascate.functions.text import login_key, password_digest
from mascate.operators.lookup import lookup

PASSWORD = "password_md5"
# What a new user gets where the change gives nothing.
DEFAULT_EMAIL, DEFAULT_ACTIVE = "0", 1

# Columns a change may set, beside login and password.
PLAIN_FIELDS = ("email", "active", "person_id", "seller_no", "type", "store")

UNKNOWN_USER, KNOWN_USER, LOGIN_TAKEN = "unknown_user", "user_exists", "login_taken"
INCOMPLETE = "login_and_password_required"


class UserChange(NamedTuple):
    """The new snapshot of the user table, and the changes that were not applied."""

    users: DataFrame
    rejected: DataFrame

    def shown(self) -> DataFrame:
        """The new snapshot as callers may see it: without passwords."""
        return self.users.drop(PASSWORD)


def user_directory(users: DataFrame, ordered: bool = True) -> DataFrame:
    """Active users in code order, without passwords."""
    listed = users.where(F.col("active") == 1).drop(PASSWORD)
    return listed.orderBy("user_id") if ordered else listed


def user_lookup(users: DataFrame, targets: DataFrame) -> DataFrame:
    """The users asked for by ``user_id``, without passwords."""
    return users.join(targets.select("user_id").distinct(), "user_id", "left_semi").drop(PASSWORD)


def unknown_users(users: DataFrame, targets: DataFrame) -> DataFrame:
    """The codes asked for that no user has."""
    return (
        targets.select("user_id").distinct().join(users.select("user_id"), "user_id", "left_anti")
    )


def _judge(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes in stored form with a ``reason`` that is NULL where the change can be applied."""
    stored = changes.withColumn("login", login_key(F.col("login"))).withColumn(
        PASSWORD, password_digest(F.col("password"))
    )
    known = users.select("user_id", F.lit(True).alias("known"))
    creates = F.col("op") == "create"
    judged = lookup(stored, known, "user_id").withColumn(
        "reason",
        F.when(~creates & F.col("known").isNull(), UNKNOWN_USER)
        .when(creates & F.col("known").isNotNull(), KNOWN_USER)
        .when(creates & (F.col("login").isNull() | F.col(PASSWORD).isNull()), INCOMPLETE),
    )
    # A login is taken if another user of the old snapshot holds it, or if an earlier change has it.
    holders = users.select("login", F.col("user_id").alias("holder"))
    judged = _refuse(
        lookup(judged, holders, "login"), F.col("login").isNotNull() & (F.col("holder") != F.col("user_id")), LOGIN_TAKEN
    )
    # Of the creates of one user that are left the first one claims its login. If it loses that to
    # another user, the next one is the user's first; what both then claim goes by their order.
    judged = _refuse_late(_with_first_create(judged), ~creates | (F.col("seq") == F.col("first_create")))
    judged = _with_first_create(judged)
    judged = _refuse(judged, creates & (F.col("seq") > F.col("first_create")), KNOWN_USER)
    return _refuse_late(judged, F.lit(True))


def _refuse(judged: DataFrame, wrong: Column, reason: str) -> DataFrame:
    """Give the changes that stand so far and are ``wrong`` the reason."""
    refused = F.when(F.col("reason").isNull() & wrong, reason).otherwise(F.col("reason"))
    return judged.withColumn("reason", refused)


def _with_first_create(judged: DataFrame) -> DataFrame:
    first = (
        judged.where((F.col("op") == "create") & F.col("reason").isNull())
        .groupBy("user_id")
        .agg(F.min("seq").alias("first_create"))
    )
    return lookup(judged.drop("first_create"), first, "user_id")


def _refuse_late(judged: DataFrame, claims: Column) -> DataFrame:
    """Refuse changes whose login another user has claimed before, by a change that stands."""
    standing = F.col("login").isNotNull() & F.col("reason").isNull() & claims
    first = judged.where(standing).groupBy("login").agg(F.min(F.struct("seq", "user_id")).alias("claim"))
    late = (F.col("claim.user_id") != F.col("user_id")) & (F.col("claim.seq") < F.col("seq")) & F.col("login").isNotNull()
    return _refuse(lookup(judged, first, "login"), late, LOGIN_TAKEN).drop("claim")


def apply_user_changes(users: DataFrame, changes: DataFrame, at: datetime) -> UserChange:
    """Create users and set the given fields of known ones; everything else keeps its value.

    ``changes`` has ``seq`` (order of the changes, unique), ``op`` (``create`` or ``update``),
    ``user_id``, ``login``, ``password``, the plain fields, ``created_by`` and ``changed_by``; NULL
    means "not given". Logins are stripped and upper-cased, passwords stored as MD5. Several
    updates of one user are folded, the last value given wins. A change is rejected if its user is
    unknown (update) or exists (create), if a create gives no login or no password, or if its login
    belongs to another user of the old snapshot or is asked for by an earlier change that stands.
    A refused create leaves its user free for the next one.

    Nothing is written: the caller stores ``users`` as a new snapshot, never over the one it read.
    """
    judged = _judge(users, changes)
    rejected = judged.where(F.col("reason").isNotNull()).select("seq", "op", "user_id", "login", "reason")

    def last_given(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(f"new_{name}")

    fields = ("login", PASSWORD, *PLAIN_FIELDS, "created_by", "changed_by")
    folded = (
        judged.where(F.col("reason").isNull())
        .groupBy("user_id")
        .agg(F.max(F.col("op") == "create").alias("is_new"), *[last_given(f) for f in fields])
    )
    defaults = {"email": F.lit(DEFAULT_EMAIL), "active": F.lit(DEFAULT_ACTIVE)}

    def merged(name: str) -> Column:
        kind = users.schema[name].dataType
        if name == "user_id":
            return F.col(name)
        if name == "created":
            return F.when(F.col("is_new"), F.lit(at).cast(kind)).otherwise(F.col(name)).alias(name)
        if name == "changed":
            update = F.col("is_new").isNotNull() & ~F.col("is_new")
            return F.when(update, F.lit(at).cast(kind)).otherwise(F.col(name)).alias(name)
        if name not in fields:
            return F.col(name)
        value = F.coalesce(F.col(f"new_{name}").cast(kind), F.col(name))
        if name in defaults:
            value = F.when(F.col("is_new"), F.coalesce(value, defaults[name].cast(kind))).otherwise(value)
        return value.alias(name)

    snapshot = users.join(folded, "user_id", "full").select(*[merged(c) for c in users.columns])
    return UserChange(snapshot, rejected)


def soft_delete_users(users: DataFrame, targets: DataFrame, at: datetime) -> DataFrame:
    """Set the users asked for inactive and stamp the time; no row is dropped."""
    gone = targets.select("user_id").distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone").isNotNull()
    return (
        users.join(gone, "user_id", "left")
        .withColumn("active", F.when(hit, F.lit(0)).otherwise(F.col("active")))
        .withColumn(
            "changed",
            F.when(hit, F.lit(at).cast(users.schema["changed"].dataType)).otherwise(F.col("changed")),
        )
        .select(*users.columns)
    )
