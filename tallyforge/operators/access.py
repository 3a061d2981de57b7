"""Who may start what, and the labels of modes and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MODES = ["standard", "practice", "exam", "sectional"]
MODE_LABELS = {
    "standard": "🎯 Standard Mode",
    "practice": "📘 Practice Mode (Immediate Feedback)",
    "exam": "📝 Exam Mode (Answers Hidden Until Finish)",
    "sectional": "📂 Sectional Mode (Per-Section Timers)",
}
TIERS = ["free", "batch", "private"]
TIER_LABELS = {
    "free": "🌐 Free (Open to All)",
    "batch": "🎓 Batch Restricted",
    "private": "🔒 Private (Owner Only)",
}
MEMBER_STATUSES = ["creator", "owner", "administrator", "member"]


def _one_of(value: Column, known: list[str]) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(known), v).otherwise(F.lit(known[0]))


def normalize_mode(mode: Column) -> Column:
    return _one_of(mode, MODES)


def normalize_tier(tier: Column) -> Column:
    return _one_of(tier, TIERS)


def _label(key: Column, labels: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), key)


def mode_label(mode: Column) -> Column:
    return _label(normalize_mode(mode), MODE_LABELS)


def tier_label(tier: Column, batch_name: Column) -> Column:
    t = normalize_tier(tier)
    base = _label(t, TIER_LABELS)
    return F.when((t == "batch") & (batch_name != ""), F.concat(base, F.lit(" ("), batch_name, F.lit(")"))).otherwise(base)


def number_list(raw: Column) -> Column:
    """The whole numbers of a JSON list; anything else in it is passed over, and what is no list is empty."""
    items = F.coalesce(F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))
    return F.transform(F.filter(items, lambda x: x.rlike(r"^-*\d+$")), lambda x: x.try_cast("long"))


def id_set(raw: Column) -> Column:
    """The numbers of a text that separates them by commas or semicolons, sorted, each once."""
    parts = F.transform(F.split(F.replace(F.coalesce(raw, F.lit("")), F.lit(";"), F.lit(",")), ","), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda x: x.rlike(r"^-*\d+$")), lambda x: x.try_cast("long"))))


def is_active_member(status: Column, is_member: Column) -> Column:
    """Whether a chat's member counts; a restricted one only while inside."""
    return F.coalesce(status.isin(MEMBER_STATUSES) | ((status == "restricted") & is_member), F.lit(False))


def has_access(verified_ts: Column, checked_ts: Column, now: Column, answer: Column, ttl: float = 300.0) -> Column:
    """A cached membership: fresh verifications hold; then the answer of the source does; without one, who was verified before stays in."""
    fresh = (verified_ts > 0) & (now - checked_ts < ttl)
    return F.when(fresh, True).when(answer.isNotNull(), answer).otherwise(F.coalesce(verified_ts, F.lit(0.0)) > 0)


def share_allowed(owner_id: Column, user_id: Column, status: Column, tier: Column, admin: Column) -> Column:
    """Whether a user may pass a quiz on: ready, and if private then the user's own."""
    own = F.coalesce(admin, F.lit(False)) | F.coalesce(owner_id == user_id, F.lit(False))
    return F.coalesce((status == "ready") & ((normalize_tier(tier) != "private") | own), F.lit(False))


def in_batch(asked: DataFrame, members: DataFrame) -> DataFrame:
    """asked (user_id, batch_name, ..) with flag `inside`: a member under any spelling of the batch's case."""
    known = members.select("user_id", F.lower("batch_name").alias("_b")).distinct().withColumn("inside", F.lit(True))
    rows = asked.withColumn("_b", F.lower("batch_name")).join(known, ["user_id", "_b"], "left")
    return rows.withColumn("inside", F.coalesce("inside", F.lit(False))).drop("_b")


def check_access(asked: DataFrame, quizzes: DataFrame, members: DataFrame, chats: DataFrame, admins: list[int] = ()) -> DataFrame:
    """user_id, chat_id, quiz_id, allowed, reason of each row asked (user_id, chat_id, quiz_id).

    chats: chat_id, batch_name of authorised chats. An allow-list binds only in a chat that isn't the user's own.
    """
    q = quizzes.select(F.col("id").alias("quiz_id"), "owner_id", "access_tier", F.trim(F.coalesce("batch_name", F.lit(""))).alias("batch"), "allowed_chats", F.lit(True).alias("known"))
    rows = asked.join(q, "quiz_id", "left").withColumn("tier", normalize_tier(F.col("access_tier"))).withColumn("need", F.when(F.col("batch") == "", "Default").otherwise(F.col("batch")))
    rows = in_batch(rows.withColumn("batch_name", F.col("need")), members).drop("batch_name")
    c = chats.select("chat_id", F.lower("batch_name").alias("chat_batch"), F.lit(True).alias("authorised")).dropDuplicates(["chat_id"])
    rows = rows.join(c, "chat_id", "left")
    away = F.col("chat_id") != F.col("user_id")
    mine = F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False)) | F.col("user_id").isin(list(admins))
    barred = (F.size("allowed_chats") > 0) & away & ~F.array_contains("allowed_chats", F.col("chat_id")) & ~F.coalesce("authorised", F.lit(False))
    batch_ok = F.col("inside") | (away & F.coalesce(F.col("chat_batch") == F.lower("need"), F.lit(False)))
    reason = (
        F.when(F.col("known").isNull(), "missing").when(mine, "").when(F.coalesce(barred, F.lit(False)), "chat").when(F.col("tier") == "private", "private")
        .when(((F.col("tier") == "batch") | (F.col("batch") != "")) & ~batch_ok, "batch").otherwise("")
    )
    return rows.select("user_id", "chat_id", "quiz_id", (reason == "").alias("allowed"), reason.alias("reason"))
