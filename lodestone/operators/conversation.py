"""Bounded histories of conversations and the rewriting of follow-up questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import ConversationConfig

KEYS = ["repository_id", "conversation_id"]
#: The rewriting prompt's parts, around lines of role and content.
REWRITE_HEAD = (
    "Turn the last message below into a search query for the repository that can be read alone.\n"
    "Put in what its pronouns and references stand for, going by the conversation.\n"
    "Answer with the query alone: no comment, no citation.\n\n"
    "Conversation so far:\n"
)
REWRITE_LATEST = "\n\nLast message:\n"


def retained(messages: DataFrame, config: ConversationConfig = ConversationConfig()) -> DataFrame:
    """The last `history` messages (repository_id, conversation_id, seq, role, content) of each conversation."""
    back = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("seq")))
    return messages.withColumn("back", back).where(F.col("back") <= config.history).drop("back")


def with_history(messages: DataFrame, config: ConversationConfig = ConversationConfig()) -> DataFrame:
    """Each message with the array of those before it that a rewrite sees, oldest first."""
    before = Window.partitionBy(*KEYS).orderBy("seq").rowsBetween(-min(config.rewrite, config.history), -1)
    return messages.withColumn("history", F.collect_list(F.struct("role", "content")).over(before))


def rewrite_prompt(message: Column, history: Column) -> Column:
    transcript = F.array_join(F.transform(history, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return F.concat(F.lit(REWRITE_HEAD), transcript, F.lit(REWRITE_LATEST), message, F.lit("\n"))


def standalone(messages: DataFrame, generator: Callable[[Column], Column]) -> DataFrame:
    """Messages (of with_history) with `query`: the generator's rewriting, or the message itself where there is no history
    or the generator gives null or blank."""
    first = messages.where(F.size("history") == 0).withColumn("query", F.col("content"))
    later = messages.where(F.size("history") > 0)
    written = F.trim(generator(rewrite_prompt(F.col("content"), F.col("history"))))
    return first.unionByName(later.withColumn("query", F.coalesce(F.nullif(written, F.lit("")), F.col("content"))))


def appended(messages: DataFrame, turns: DataFrame, config: ConversationConfig = ConversationConfig()) -> DataFrame:
    """The messages retained after turns (repository_id, conversation_id, message, answer) are added as a user and an
    assistant message."""
    last = messages.groupBy(*KEYS).agg(F.max("seq").alias("last"))
    at = F.coalesce("last", F.lit(0).cast("long"))
    two = F.explode(F.array(F.struct((at + 1).alias("seq"), F.lit("user").alias("role"), F.col("message").alias("content")), F.struct((at + 2).alias("seq"), F.lit("assistant").alias("role"), F.col("answer").alias("content"))))
    new = turns.join(last, KEYS, "left").select(*KEYS, two.alias("m")).select(*KEYS, "m.*")
    return retained(messages.select(*KEYS, F.col("seq").cast("long").alias("seq"), "role", "content").unionByName(new), config)
