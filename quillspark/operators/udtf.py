"""The chunker as a table function of SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from . import chunking


@udtf(returnType=chunking.SCHEMA)
class ChunkText:
    """SELECT * FROM chunk_text(TABLE(documents) PARTITION BY doc_id): the chunks of doc_id and text of each row."""

    def eval(self, row: Row) -> Iterator[tuple]:
        made = chunking.chunks_of(row["text"])
        for i, c in enumerate(made):
            yield row["doc_id"], i, len(made), c.start, c.end, c.path, c.path.split(" > ")[-1] if c.path else None, c.text


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
