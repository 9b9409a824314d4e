"""Text extraction for the formats Spark can read by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doccat.functions.text import decode_text, html_to_text, trim_space
from doccat.session import spread


def extract_text(docs: DataFrame, column: str, html: bool = False, partitions: int | None = None) -> DataFrame:
    """Add trimmed ``contents`` from bytes or text, taking HTML apart if asked; ``partitions`` deals the rows out anew."""
    docs, source = spread(docs, partitions), F.col(column)
    text = decode_text(source) if isinstance(docs.schema[column].dataType, T.BinaryType) else source
    return docs.withColumn("contents", html_to_text(text) if html else trim_space(text))


def extract_content(content: Column, content_type: Column) -> Column:
    """Text of ``content`` by its type: HTML is taken apart, other text decoded, the rest is null."""
    text = decode_text(content, content_type)
    return F.when(content_type.contains("html"), html_to_text(text)).when(
        content_type.startswith("text/"), trim_space(text)
    )


def extract_with(docs: DataFrame, extractor: Callable[[bytes], str], column: str = "content") -> DataFrame:
    """Add ``contents`` with a library of the caller's for other formats.

    Runs in Arrow batches on the executors; a failing document gets null text
    and its reason in ``extract_error``.
    """
    fields = [f for f in docs.schema.fields if f.name != column]
    schema = T.StructType(
        [*fields, T.StructField("contents", T.StringType()), T.StructField("extract_error", T.StringType())]
    )

    def one(content: bytes | None) -> tuple[str | None, str | None]:
        try:
            return extractor(content).strip(), None
        except Exception as error:
            return None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            texts = [one(c) for c in batch.pop(column)]
            yield batch.assign(contents=[t for t, _ in texts], extract_error=[e for _, e in texts])

    return docs.mapInPandas(run, schema)
