"""Functions for SQL users: ``register`` makes them known to a session.

    SELECT page_id, f.key, f.value FROM pages, LATERAL document_fields(url) f
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillsift.functions.documents import extract
from quillsift.functions.rulebook import STANDARD, Names, Rulebook


def document_fields(book: Rulebook = STANDARD):
    """Table function of a text: its key-value pairs (key, value) and the label that each key stands for (context). A null text has none."""

    class DocumentFields:
        def __init__(self) -> None:
            self.names = Names(book)

        def eval(self, text: str) -> Iterator[tuple[str, str, str | None]]:
            if text is not None:
                for key, value in extract(text)[1]:
                    yield key, value, self.names.context(key)

    return udtf(DocumentFields, returnType="key string, value string, context string", useArrow=True)


def register(spark: SparkSession, book: Rulebook = STANDARD) -> None:
    spark.udtf.register("document_fields", document_fields(book))
