"""Mail: browsing, copies of messages, live and archived copies, folders and activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T

ACCOUNT = "account://"


def all_words(text: Column, words: Sequence[str]) -> Column:
    """Whether a text has each of the words as a whole word."""
    have = T.words(text)
    out = F.lit(True)
    for w in words:
        out = out & F.array_contains(have, w.lower())
    return out


def browse(
    messages: DataFrame, sender: str = "", recipient: str = "", subject: str = "", has_attachment: bool | None = None,
    after: int | None = None, before: int | None = None, words: Sequence[str] = (), newest: bool = True,
) -> DataFrame:
    """Messages under all that is asked, in order of the time sent (after <= sent < before), undated ones last."""
    test = F.lit(True)
    if sender:
        test = test & T.contains_ci(F.col("sender"), sender)
    if recipient:
        test = test & F.exists("recipients", lambda r: T.contains_ci(r, recipient))
    if subject:
        test = test & T.contains_ci(F.col("subject"), subject)
    if has_attachment is not None:
        test = test & (F.col("has_attach") == has_attachment)
    if after is not None:
        test = test & (F.col("sent_at") >= after)
    if before is not None:
        test = test & (F.col("sent_at") < before)
    when = F.col("sent_at").desc_nulls_last() if newest else F.col("sent_at").asc_nulls_last()
    return messages.filter(test & all_words(F.col("text"), words)).orderBy(when, "file_id")


def duplicates(messages: DataFrame) -> DataFrame:
    """(file_id, keep_id, attachment) of messages that repeat one of their archive: same text, subject, sender
    and time. The least id is kept; an extra copy's attachment goes with it."""
    key = ["archive", "h", "subject", "sender", "sent"]
    own = messages.withColumn("h", F.md5(F.col("text").cast("binary"))).withColumn("sent", F.coalesce("sent_at", F.lit(-1)))
    kept = own.groupBy(*key).agg(F.min("file_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    extra = own.join(kept, key).filter("file_id != keep_id")
    return extra.select("file_id", "keep_id", F.when(F.col("has_attach"), F.concat("path", F.lit("/attachments/"), "attachment")).alias("attachment"))


def message_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "[<>]", "")))


def live_copies(live: DataFrame, archived: DataFrame) -> DataFrame:
    """(live_id, archive_id): messages that an account and an archive both have, by Message-ID; the least id of each."""
    side = lambda df, name: df.groupBy(message_key(F.col("message_id")).alias("k")).agg(F.min("file_id").alias(name))
    return side(live, "live_id").join(side(archived, "archive_id"), "k").drop("k")


def account_path(account: Column, folder: Column, remote: Column) -> Column:
    """account://<account>/<folder>/<id>, each part percent-encoded."""
    return F.concat(F.lit(ACCOUNT), F.url_encode(account), F.lit("/"), F.url_encode(folder), F.lit("/"), remote)


def account_of(path: Column) -> tuple[Column, Column]:
    """The account and the folder that a path of a live message names."""
    part = lambda n: F.url_decode(F.split_part(path, F.lit("/"), F.lit(n)))
    return part(3), part(4)


def folder_counts(messages: DataFrame) -> DataFrame:
    """(archive, folder, n); a live message counts for its account, as its path says."""
    account, folder = account_of(F.col("path"))
    live = F.col("path").startswith(ACCOUNT)
    box = F.when(live, F.concat(F.lit(ACCOUNT), account)).otherwise(F.coalesce("archive", F.lit("")))
    return messages.groupBy(box.alias("archive"), F.when(live, folder).otherwise(F.coalesce("folder", F.lit(""))).alias("folder")).agg(F.count("*").alias("n"))


def activity(messages: DataFrame, addresses: Sequence[str]) -> DataFrame:
    """(sent_to, received, first, last, attachments) of mail with any of the addresses."""
    by = F.lower("sender").isin(*[a.lower() for a in addresses])
    to = F.exists("recipients", lambda r: F.lower(r).isin(*[a.lower() for a in addresses]))
    return messages.filter(by | to).agg(
        F.count_if(to).alias("sent_to"), F.count_if(by).alias("received"), F.min("sent_at").alias("first"), F.max("sent_at").alias("last"), F.count_if("has_attach").alias("attachments")
    )
