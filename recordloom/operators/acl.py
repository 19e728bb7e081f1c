"""Access rules: which records a user may see, permission strings, and figures about both.

A record is seen when one of its rows is unrestricted, or grants a location or group of the user. Records without
any row are not seen (``open_without_rows`` decides otherwise). Rules are applied before a result is cut, and fail
closed: a null group counts as unrestricted only in rows that say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.packed import split_packed

UNRESTRICTED = "<Unrestricted>"
# fixed values: kinds of permission
PERMISSIONS = ["ViewDocument", "UpdateDocument", "UpdateMetadata", "ModifyAccess", "DestroyRecord", "ContributeContents", "ViewMetadata"]


def is_unrestricted(acl: Column) -> Column:
    return acl.isNull() | (F.trim(acl) == "") | F.contains(acl, F.lit(UNRESTRICTED))


def principals(user_groups: DataFrame, user: int | Column) -> DataFrame:
    """The user's own location and its groups as ``location_id``, each once."""
    u = F.lit(user) if isinstance(user, int) else user
    own = user_groups.sparkSession.range(1).select(u.cast("long").alias("location_id"))
    return own.union(user_groups.where(F.col("user_id") == u).select(F.col("group_id").alias("location_id"))).distinct()


def visible_records(record_acl: DataFrame, members: DataFrame, user_groups: DataFrame, user: int, permission: str = "ViewDocument") -> DataFrame:
    """``record_uri`` of the records a user may see, each once.

    Direct grants, grants over groups and unrestricted rows are one union, so a plain semi join with the granted
    groups replaces a disjunction of subqueries.
    """
    rows = record_acl.where((F.col("permission_type") == permission) & F.col("record_uri").isNotNull())
    granted = members.join(principals(user_groups, user), "location_id", "left_semi").select("acl_group").distinct()
    free = rows.where(F.col("acl_group").isNull()).select("record_uri")
    return free.union(rows.join(granted, "acl_group", "left_semi").select("record_uri")).distinct()


def apply_acl(hits: DataFrame, record_acl: DataFrame, members: DataFrame, user_groups: DataFrame, user: int, open_without_rows: bool = False) -> DataFrame:
    """Hits of records the user may see; to be called before the result is limited."""
    seen = hits.join(visible_records(record_acl, members, user_groups, user), "record_uri", "left_semi")
    if open_without_rows:
        return seen.unionByName(hits.join(record_acl.select("record_uri").distinct(), "record_uri", "left_anti"))
    return seen


def visible_to_each(record_acl: DataFrame, members: DataFrame, user_groups: DataFrame, permission: str = "ViewDocument") -> DataFrame:
    """``(user_id, records)``: how many restricted records each user may see through groups.

    Records are counted once per set of groups that may see them, and users once per set of groups they reach, so
    only different sets meet, not users and records.
    """
    rows = record_acl.where((F.col("permission_type") == permission) & F.col("acl_group").isNotNull() & F.col("record_uri").isNotNull())
    sets = rows.groupBy("record_uri").agg(F.sort_array(F.collect_set("acl_group")).alias("open_to")).groupBy("open_to").agg(F.count("*").alias("records"))
    own = user_groups.select("user_id", F.col("user_id").alias("location_id")).distinct()
    reach = user_groups.select("user_id", F.col("group_id").alias("location_id")).union(own).join(members, "location_id")
    kinds = reach.groupBy("user_id").agg(F.sort_array(F.collect_set("acl_group")).alias("groups"))
    one = kinds.select("groups").distinct().select("groups", F.explode("groups").alias("acl_group"))
    met = one.join(sets.select("open_to", "records", F.explode("open_to").alias("acl_group")), "acl_group").select("groups", "open_to", "records").distinct()
    return kinds.join(met.groupBy("groups").agg(F.sum("records").alias("records")), "groups").select("user_id", "records")


def identity(locations: DataFrame, user_groups: DataFrame) -> DataFrame:
    """``(user_id, name, groups)``: each user with the names of its groups in order, none for a user without groups."""
    users = locations.where("type = 4").select(F.col("id").alias("user_id"), "name")
    named = user_groups.join(locations.select(F.col("id").alias("group_id"), F.col("name").alias("group")), "group_id")
    of = named.groupBy("user_id").agg(F.sort_array(F.collect_set("group")).alias("groups"))
    return users.join(of, "user_id", "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<string>")))


def is_in_group(user_groups: DataFrame, user: int, group: int) -> bool:
    return not user_groups.where((F.col("user_id") == user) & (F.col("group_id") == group)).isEmpty()


def classify(value: Column) -> tuple[Column, Column]:
    """Kind (group, location or user) and name of one permission value."""
    kind = F.when(F.lower(value).startswith("group:"), "group").when(F.lower(value).startswith("location:"), "location").otherwise("user")
    return kind, F.trim(F.regexp_replace(value, r"(?i)^(group|location):\s*", ""))


def parse_permissions(df: DataFrame, id_col: str, acl_col: str) -> DataFrame:
    """``(row_id, pos, kind, name)`` of all values of a permission string; the unrestricted mark is none."""
    rows = split_packed(df, id_col, acl_col).where(F.col("val") != UNRESTRICTED)
    kind, name = classify(F.col("val"))
    return rows.select("row_id", "pos", kind.alias("kind"), name.alias("name"))


def permission_frequencies(record_acl: DataFrame) -> DataFrame:
    """``(permission_type, kind, name, records)``, counted over all rows."""
    values = parse_permissions(record_acl, "id", "raw_acl_string")
    named = record_acl.select(F.col("id").alias("row_id"), "permission_type", "record_uri").join(values, "row_id")
    return named.groupBy("permission_type", "kind", "name").agg(F.count_distinct("record_uri").alias("records"))


def unique_principals(record_acl: DataFrame) -> DataFrame:
    """``(kind, principals)``: how many different users, groups and locations permission strings name."""
    return parse_permissions(record_acl, "id", "raw_acl_string").groupBy("kind").agg(F.count_distinct("name").alias("principals"))


def acl_statistics(record_acl: DataFrame) -> DataFrame:
    """One row: records with and without restriction, distinct groups, rows."""
    return record_acl.agg(
        F.count("*").alias("acl_rows"), F.count_distinct("record_uri").alias("records"), F.count_distinct(F.when(F.col("acl_group").isNotNull(), F.col("record_uri"))).alias("restricted_records"),
        F.count_distinct("acl_group").alias("groups"), F.count_if(F.col("raw_acl_string").isNull()).alias("null_strings"), F.count_if(F.trim("raw_acl_string") == "").alias("blank_strings"),
    )


def acl_json(names: dict[str, Column]) -> Column:
    """A JSON object of permission lists, those of PERMISSIONS that are given."""
    return F.to_json(F.struct(*[names[p].alias(p) for p in PERMISSIONS if p in names]))


def acl_ddl(database: str) -> list[str]:
    """Statements that create the access tables."""
    tables = {
        "locations": "id BIGINT, name STRING, type INT", "acl_groups": "id BIGINT, hash STRING", "acl_group_members": "acl_group BIGINT, location_id BIGINT", "user_groups": "user_id BIGINT, group_id BIGINT",
        "record_acl": "id BIGINT, record_uri BIGINT, acl_group BIGINT, permission_type STRING, raw_acl_string STRING, allowed_users ARRAY<STRING>, allowed_groups ARRAY<STRING>, last_synced_at TIMESTAMP, created_at TIMESTAMP",
    }
    return [f"CREATE TABLE IF NOT EXISTS {database}.{t} ({cols}) USING parquet" for t, cols in tables.items()]
