"""Conversations: history, retrieval questions, lists, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLLOW_UP_CHARS, HISTORY = 16, 10


def history(messages: DataFrame, last: int = HISTORY) -> DataFrame:
    """conv_id and its last messages, oldest first, as "User: ..." and "Assistant: ..." paragraphs."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    who = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    kept = messages.withColumn("__n", newest).where(F.col("__n") <= last).select("conv_id", "turn", F.concat(who, "text").alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return kept.groupBy("conv_id").agg(F.array_join(ordered, "\n\n").alias("history"))


def retrieval_question(messages: DataFrame) -> DataFrame:
    """conv_id, turn and question of user turns: a short one is preceded by the user's previous text."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = messages.withColumn("previous", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)).where("role = 'user'")
    alone = (F.length(F.trim("text")) >= FOLLOW_UP_CHARS) | F.col("previous").isNull()
    return asked.select("conv_id", "turn", F.when(alone, F.col("text")).otherwise(F.concat("previous", F.lit(" "), "text")).alias("question"))


def listing(messages: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"), F.substring(F.coalesce(first["text"], F.lit("")), 1, 100).alias("title"))


def as_text(messages: DataFrame) -> DataFrame:
    """A conversation as plain text: a role in capitals and its text for each message."""
    line = F.concat(F.lit("["), F.upper("role"), F.lit("]\n"), "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return messages.groupBy("conv_id").agg(F.array_join(ordered, "\n\n").alias("body"))


def enhanced_question(messages: DataFrame) -> DataFrame:
    """conv_id and the last user question of each conversation, with the history before it if there is one."""
    last = messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("asked_at"))
    before = history(messages.join(last, "conv_id").where("turn < asked_at").select("conv_id", "turn", "role", "text"))
    with_history = F.concat(F.lit("Previous conversation:\n"), "history", F.lit("\n\nCurrent question: "), "question")
    return last.join(before, "conv_id", "left").select("conv_id", F.coalesce(with_history, "question").alias("question"))


def with_turn(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with a user's question and the answer to it (turns: conv_id, question, answer) appended to their conversations.

    Further columns of turns (such as citations, model, tokens) are those of the answer; all other messages have null there.
    """
    more = [c for c in turns.columns if c not in ("conv_id", "question", "answer")]
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    said = F.array(F.struct(F.lit(1).alias("step"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit(2).alias("step"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    new = turns.join(last, "conv_id", "left").select("conv_id", F.coalesce("last", F.lit(-1)).alias("last"), F.explode(said).alias("x"), *more)
    answers = [F.when(F.col("x.role") == "assistant", F.col(c)).alias(c) for c in more]
    return messages.select("conv_id", "turn", "role", "text").unionByName(new.select("conv_id", (F.col("last") + F.col("x.step")).alias("turn"), "x.role", "x.text", *answers), allowMissingColumns=True)


def as_markdown(messages: DataFrame, title: Column) -> DataFrame:
    """A conversation as Markdown: its title, and a section for each message with its sources (an array of titles), if it has some."""
    head = F.when(F.col("role") == "user", "## 👤 User").otherwise("## 🤖 Assistant")
    cited = F.when(F.size("citations") > 0, F.concat(F.lit("**Sources:**\n"), F.array_join(F.transform("citations", lambda c: F.concat(F.lit("- "), F.coalesce(c, F.lit("Unknown")), F.lit("\n"))), ""), F.lit("\n"))).otherwise("")
    section = F.concat(head, F.lit("\n\n"), "text", F.lit("\n\n"), cited, F.lit("---\n\n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", section.alias("section")))), lambda x: x["section"])
    body = messages.groupBy("conv_id").agg(F.array_join(ordered, "").alias("body"))
    return body.select("conv_id", F.concat(F.lit("# "), title, F.lit("\n\n---\n\n"), "body").alias("body"))


def as_json(messages: DataFrame) -> DataFrame:
    """A conversation as a JSON object: its id and its messages in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(F.to_json(F.struct(F.first("conv_id").alias("id"), ordered.alias("messages"))).alias("body"))
