"""Who may see and change what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.operators.joins import lookup_join
from tallysheet.operators.review import effective_templates
from tallysheet.operators.storage import insert_skip_duplicates, upsert_by_key


def access_pairs(events: DataFrame, members: DataFrame) -> DataFrame:
    """P1 for all users: every (user, event) the user owns or is a member of."""
    owned = events.filter(F.col("owner_id").isNotNull()).select(
        F.col("owner_id").alias("user_id"), "event_id"
    )
    return owned.unionByName(members.select("user_id", "event_id")).distinct()


def visible_events(events: DataFrame, members: DataFrame, user_id: str) -> DataFrame:
    """P1 for one user, newest first."""
    mine = members.filter(F.col("user_id") == user_id).select("event_id").distinct()
    joined = events.join(mine.withColumn("_member", F.lit(True)), "event_id", "left")
    return (
        joined.filter((F.col("owner_id") == user_id) | F.col("_member").isNotNull())
        .drop("_member").orderBy(F.col("created_at").desc(), "event_id")
    )


def manageable_pairs(events: DataFrame, members: DataFrame) -> DataFrame:
    """P2 for all users: a membership role decides; ownership counts only without one."""
    owned = events.filter(F.col("owner_id").isNotNull()).select(
        "event_id", F.col("owner_id").alias("user_id"), F.lit("owner").alias("_owned")
    )
    roles = members.select("event_id", "user_id", "role")
    return (
        roles.join(owned, ["event_id", "user_id"], "full")
        .filter(F.coalesce("role", "_owned") == "owner")
        .select("user_id", "event_id")
    )


def members_with_users(members: DataFrame, users: DataFrame) -> DataFrame:
    """J3."""
    return members.join(users.select("user_id", "email", "name"), "user_id")


def team_order() -> list[Column]:
    """Owners first, then name or email in locale order, then id."""
    shown = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("email"))
    return [
        F.when(F.col("role") == "owner", 0).otherwise(1), F.collate(shown, "UNICODE"), F.col("user_id"),
    ]


def event_view(events: DataFrame, templates: DataFrame, fields: DataFrame) -> DataFrame:
    """P9 without the members: event, UTC day, effective template and its sorted fields.

    A template has at most 80 fields, so they are kept as a list; members may be any
    number and stay rows (`event_members_view`). An event without a template gets an
    empty stub.
    """
    listed = fields.groupBy("template_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("sort_order", "field_id", "label", "key", "type", "required", "options")
            )
        ).alias("fields")
    )
    return (
        events.join(effective_templates(templates), "event_id", "left")
        .join(listed, "template_id", "left")
        .select(
            "event_id", "title", F.date_format("event_date", "yyyy-MM-dd").alias("event_day"),
            "template_id",
            F.coalesce("fields", F.expr("array()").cast(listed.schema["fields"].dataType)).alias("fields"),
        )
    )


def event_members_view(members: DataFrame, users: DataFrame) -> DataFrame:
    """P9, the members: owners before reviewers, then by time of joining."""
    return members_with_users(members, users).orderBy("event_id", "role", "created_at", "user_id")


def _invites(invites: DataFrame) -> DataFrame:
    trimmed = F.lower(F.regexp_replace("email", r"(?U)^\s+|\s+$", ""))
    name = F.nullif(F.regexp_replace("name", r"(?U)^\s+|\s+$", ""), F.lit(""))
    return invites.withColumn("email", trimmed).withColumn("name", name)


def roster_users(users: DataFrame, invites: DataFrame) -> DataFrame:
    """Users after the invites; a blank invited name keeps the stored one.

    New users take the id `user_id` of their invite. The last non-blank name wins.
    """
    tidy = _invites(invites)
    newest = tidy.groupBy("email").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("position"))).alias("name"),
        F.min_by("user_id", "position").alias("_fresh_id"),
    )
    stored = users.select("email", "user_id", F.col("name").alias("_name"))
    return stored.join(newest, "email", "full").select(
        F.coalesce("user_id", "_fresh_id").alias("user_id"), "email",
        F.coalesce("name", "_name").alias("name"),
    )


def roster_sync(
    events: DataFrame, members: DataFrame, users: DataFrame, invites: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, members, outbox). Only a new membership writes an outbox row."""
    people = roster_users(users, invites)
    asked = _invites(invites).groupBy("event_id", "email").agg(
        F.min_by("invited_by", "position").alias("invited_by"),
    )
    new = (
        asked.join(people, "email")
        .join(members.select("event_id", "user_id"), ["event_id", "user_id"], "left_anti")
    )
    added = new.select("event_id", "user_id", F.lit("reviewer").alias("role"))
    safe = F.regexp_replace("email", "[^a-z0-9]+", "-")
    # a longer key ends in a hash of the whole, so that invitees with a long common start differ
    whole = F.concat_ws("-", F.lit("reviewer-invite"), F.col("event_id"), safe)
    outbox = lookup_join(
        new, events.select("event_id", "title"), "event_id", "inner", spread=["email"]
    ).select(
        "event_id", "title", F.col("email").alias("invitee"), "invited_by",
        F.when(F.length(whole) <= 256, whole).otherwise(
            F.concat(F.substring(whole, 1, 223), F.lit("-"), F.md5(whole.cast("binary")))
        ).alias("idempotency_key"),
    )
    return people, members.select("event_id", "user_id", "role").unionByName(added), outbox


def role_changes(events: DataFrame, members: DataFrame, changes: DataFrame
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, events, rejected), at most one change per member.

    `changes`: event_id, user_id, action in (owner, reviewer, remove). Removing an owner
    is refused; when the demotions of a batch would leave an event without an owner, all
    of that event's demotions are refused. An owner_id that was demoted moves to the
    earliest remaining owner; an empty owner_id takes a promoted member.
    """
    asked = changes.groupBy("event_id", "user_id").agg(F.max("action").alias("action"))
    joined = members.join(asked, ["event_id", "user_id"], "left")
    is_owner = F.col("role") == "owner"
    demoted = is_owner & (F.col("action") == "reviewer")
    stays = F.count_if((is_owner & ~F.coalesce(demoted, F.lit(False))) | (F.col("action") == "owner"))
    owners_left = joined.groupBy("event_id").agg(stays.alias("_owners_left"))
    checked = lookup_join(joined, owners_left, "event_id", spread=["user_id"]).withColumn(
        "reason",
        F.when(is_owner & (F.col("action") == "remove"), "owner_not_removable")
        .when(demoted & (F.col("_owners_left") == 0), "last_owner"),
    )
    refused = checked.filter(F.col("reason").isNotNull()).select(
        "event_id", "user_id", "action", "reason"
    )
    applied = F.when(F.col("reason").isNull(), F.col("action"))
    new_members = (
        checked.withColumn("_action", applied)
        .filter(~F.coalesce(F.col("_action") == "remove", F.lit(False)))
        .withColumn("_was", F.col("role"))
        .withColumn(
            "role",
            F.when(F.col("_action").isin("owner", "reviewer"), F.col("_action")).otherwise(F.col("role")),
        )
    )
    first = F.struct("created_at", "user_id")
    heirs = new_members.groupBy("event_id").agg(
        F.min_by("user_id", F.when(F.col("role") == "owner", first)).alias("_heir"),
        F.min_by(
            "user_id",
            F.when((F.col("_action") == "owner") & (F.col("_was") != "owner"), first),
        ).alias("_promoted"),
    )
    lost = new_members.filter(
        (F.col("_was") == "owner") & (F.col("role") == "reviewer")
    ).select("event_id", F.col("user_id").alias("owner_id"), F.lit(True).alias("_lost"))
    new_events = (
        events.join(heirs, "event_id", "left").join(lost, ["event_id", "owner_id"], "left")
        .withColumn(
            "owner_id",
            F.when(F.col("_lost").isNotNull(), F.col("_heir"))
            .otherwise(F.coalesce("owner_id", "_promoted")),
        )
        .select(*events.columns)
    )
    return new_members.select(*members.columns), new_events, refused


def claim_ownerless(events: DataFrame, members: DataFrame, user_id: str
                    ) -> tuple[DataFrame, DataFrame]:
    """Events without an owner go to `user_id`, who becomes a member of them."""
    claimed = events.filter(F.col("owner_id").isNull()).select(
        "event_id", F.lit(user_id).alias("user_id"), F.lit("owner").alias("role"),
    )
    owned = events.withColumn("owner_id", F.coalesce("owner_id", F.lit(user_id)))
    stored = members.select("event_id", "user_id", "role")
    return owned, insert_skip_duplicates(stored, claimed, ["event_id", "user_id"])


def reorder_fields(fields: DataFrame, order: list[Column]) -> DataFrame:
    """sort_order becomes the place in `order`; a template has at most 80 fields."""
    place = Window.partitionBy("template_id").orderBy(*order)
    return fields.withColumn("sort_order", F.row_number().over(place))


def upsert_users(users: DataFrame, changes: DataFrame, latest: list[Column]) -> DataFrame:
    """S12 on the e-mail of a user; nulls keep what is stored, the last change by `latest` wins."""
    others = [c for c in users.columns if c != "email"]
    return upsert_by_key(users, changes, ["email"], latest, keep_old_when_null=others)
