"""Settings and small keyed state: configuration with defaults, formats, tokens, memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats that are always there, by kind.
BUILTIN = {"presentation": ["builtin_default"], "import": ["builtin_default", "builtin_checked", "builtin_checked_plain"]}
TOKEN_S = 1800


def number_setting(raw: Column, default: float, whole: bool = True) -> tuple[Column, Column]:
    """A number from a setting, and whether what was set is no number; blank takes the default quietly."""
    value = F.trim(raw).try_cast("int" if whole else "double")
    filled = F.coalesce(F.trim(raw), F.lit("")) != ""
    return F.coalesce(value, F.lit(default).cast("int" if whole else "double")), filled & value.isNull()


def flag(settings: DataFrame, key: str, default: str = "1") -> DataFrame:
    """One row: whether a flag is on; without a row for it, the default."""
    return settings.where(F.col("key") == key).agg((F.coalesce(F.max("value"), F.lit(default)) == "1").alias("enabled"))


def default_format(settings: DataFrame, formats: DataFrame, kind: str) -> DataFrame:
    """One row: the default format of a kind, or the built-in one where it is unset or gone."""
    told = settings.where(F.col("key") == f"default_format_{kind}").agg(F.max("value").alias("id"))
    own = formats.where(F.col("kind") == kind).select("id", F.lit(True).alias("there"))
    return told.join(own, "id", "left").select(F.when(F.col("there") | F.col("id").isin(BUILTIN[kind]), F.col("id")).otherwise(BUILTIN[kind][0]).alias("id"))


def import_formats(users: DataFrame, settings: DataFrame, formats: DataFrame) -> DataFrame:
    """user_id, format_id: each user's own format if it is there, else the default."""
    own = formats.where("kind = 'import'").select(F.col("id").alias("chosen"), F.lit(True).alias("there"))
    rows = users.select("user_id", F.col("txt_import_format_id").alias("chosen")).join(own, "chosen", "left")
    usual = default_format(settings, formats, "import").withColumnRenamed("id", "usual")  # one row
    keep = F.coalesce(F.col("there") | F.col("chosen").isin(BUILTIN["import"]), F.lit(False))
    return rows.join(F.broadcast(usual)).select("user_id", F.when(keep, F.col("chosen")).otherwise(F.col("usual")).alias("format_id"))


def support_config(value: Column, default: str) -> Column:
    """ref, chat_id and url of a JSON setting: unset takes the default, damaged is empty."""
    kind = "struct<ref: string, chat_id: bigint, url: string>"
    parsed = F.from_json(value, kind)
    sound = F.get_json_object(value, "$").isNotNull() & value.rlike(r"^\s*\{") & (F.coalesce(parsed["url"], F.lit("https://t.me/")).startswith("https://t.me/"))
    return F.when(value.isNull(), F.from_json(F.lit(default), kind)).when(sound, parsed).otherwise(F.from_json(F.lit("{}"), kind))


def live_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """Tokens that are not used and not older than half an hour."""
    return tokens.where((F.col("consumed") == 0) & (F.col("created_ts") >= now - TOKEN_S))


def states(raw: DataFrame) -> DataFrame:
    """user_id, state, data: stored state with its map; unreadable data is empty."""
    return raw.select("user_id", "state", F.coalesce(F.from_json("data_json", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("data"))


def memberships(users: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return users.select("user_id", zero("verified_ts"), zero("checked_ts"))


def polls_with_sessions(polls: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each poll with its session's quiz, chat and status; polls without one go."""
    s = sessions.select(F.col("id").alias("session_id"), "quiz_id", "chat_id", F.col("status").alias("session_status"))
    return polls.join(s, "session_id")


def migrated_state(state: Column) -> Column:
    """Names of old states as they are now; unknown ones stay."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("await_question", "creating", "await_options", "creating", "await_correct", "creating", "await_explanation", "creating")]), state), state)
