"""A project as a file, in rows: one for its head, each document and each conversation, as JSON and as Markdown.

A project may hold a third of all documents, so its rows never meet in one;
ordered by part and id and written as text they are the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = ("project", "document", "conversation")


def project_rows(docs: DataFrame, conversations: DataFrame) -> DataFrame:
    """project, part (0, 1, 2), id, json and markdown of projects' docs (project, doc_id, title, source_type, chunks) and conversations (project, conv_id, title, messages).

    A document without chunks is in error; a conversation without a title is untitled.
    """
    status = F.when(F.coalesce("chunks", F.lit(0)) > 0, "ready").otherwise("error")
    rows = docs.withColumn("status", status).withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    head = rows.select("project").unionByName(conversations.select("project")).distinct()
    line = lambda name, c: F.concat(F.lit(f"- {name}: "), c, F.lit("\n"))
    of_project = head.select("project", F.lit(0).alias("part"), F.lit(0).cast("long").alias("id"), F.to_json(F.struct(F.col("project").alias("name"))).alias("json"), F.concat(F.lit("# "), "project", F.lit("\n\n")).alias("markdown"))
    of_docs = rows.select(
        "project",
        F.lit(1).alias("part"),
        F.col("doc_id").alias("id"),
        F.to_json(F.struct(F.col("doc_id").alias("id"), "title", "source_type", "status", F.col("chunks").alias("chunk_count"))).alias("json"),
        F.concat(F.lit("### "), "title", F.lit("\n"), line("Type", F.col("source_type")), line("Status", F.col("status")), line("Chunks", F.col("chunks")), F.lit("\n")).alias("markdown"),
    )
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))
    of_talks = conversations.select(
        "project",
        F.lit(2).alias("part"),
        F.col("conv_id").alias("id"),
        F.to_json(F.struct(F.col("conv_id").alias("id"), "title", F.col("messages").alias("message_count"))).alias("json"),
        F.concat(F.lit("### "), title, F.lit("\n"), line("Messages", F.col("messages")), F.lit("\n")).alias("markdown"),
    )
    return of_project.unionByName(of_docs).unionByName(of_talks)
