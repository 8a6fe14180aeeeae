"""Knowledge base build: pages to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import chunking, documents
from ..session import materialise


def build(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean, structure and cut. Returns (clean pages, records, chunks).

    Normalised pages are written once: two later steps read them (repeated lines, structure), and
    running the regular expressions again costs more than reading the text back. Records are
    written once: chunks, reports and later builds start from them.
    """
    normal = materialise(documents.normalise_pages(pages))
    clean = documents.drop_header_lines(normal)
    records = materialise(documents.records(clean))
    return clean, records, chunking.chunks(records)
