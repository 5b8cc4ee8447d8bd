"""Pages of documents: inventory, printed labels, binary files, and registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

LEAST_TEXT, LARGEST = 20, 50 * 1024 * 1024
#: A bare page number: digits, or a roman numeral.
LABEL = r"(?i)^(?:\d{1,4}|[ivxlcdm]{1,7})$"


def printed_label(text: Column) -> Column:
    """The label printed on a page: a bare number in one of its last two lines, else of its first two.

    A line of up to four words may end with the number. Lines without text do not count.
    """
    lines = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), strip), lambda x: x != "")
    n = F.size(lines)
    last = F.slice(lines, F.greatest(n - 1, F.lit(1)), F.lit(2))
    looked = F.concat(F.reverse(last), F.slice(lines, 1, 2))
    words = lambda x: F.split(x, r"\s+")
    found = F.transform(looked, lambda x: F.when(x.rlike(LABEL), x).when((F.size(words(x)) <= 4) & F.element_at(words(x), -1).rlike(LABEL), F.element_at(words(x), -1)))
    return F.when(n > 0, F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1)))


def inventory(pages: DataFrame, has_images: Column | None = None) -> DataFrame:
    """All columns, and label, char_count, has_text, is_blank and the status that a page starts with.

    pages: text and, if the source knows it, a label. A page is blank without text and without images or drawings.
    """
    text = F.coalesce("text", F.lit(""))
    has_text = F.length(strip(text)) >= LEAST_TEXT
    blank = ~has_text & ~(F.lit(False) if has_images is None else F.coalesce(has_images, F.lit(False)))
    given = F.col("label") if "label" in pages.columns else F.lit(None).cast("string")
    return pages.withColumns(
        {"label": F.coalesce(given, printed_label(text)), "char_count": F.length(text), "has_text": has_text, "is_blank": blank, "status": F.when(blank, "skipped").otherwise("pending")}
    )


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (storage_path, size_bytes, sha256, content); files over the size cap are left out, and Spark lists no empty ones."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= LARGEST)
    return files.select(F.col("path").alias("storage_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def parse_pages(files: DataFrame, parse: Callable[[bytes], list[tuple[int, str | None, str, bool]]], schema: str = "page_index int, label string, text string, has_images boolean") -> DataFrame:
    """Pages by a parser that the caller brings: bytes to (index, label, text, has images) of each page."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(d, *page) for d, content in zip(f["sha256"], f["content"], strict=True) for page in parse(bytes(content))]
            yield pd.DataFrame(rows, columns=["sha256", "page_index", "label", "text", "has_images"])

    return files.select("sha256", "content").mapInPandas(run, f"sha256 string, {schema}")


def register(new: DataFrame, known: DataFrame) -> DataFrame:
    """Documents of ``new`` that no document of ``known`` has the sha256 of, one of each; over-large ones are refused.

    Known documents that never finished uploading do not count.
    """
    done = known.where(F.col("status") != "uploading")
    fit = new.where(F.col("size_bytes").between(1, LARGEST))
    return fit.join(done.select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"])


def intact(files: DataFrame, registered: DataFrame) -> DataFrame:
    """Uploaded files (document_id, content) with ``ok``: size and sha256 are as registered."""
    both = files.join(registered.select("document_id", "size_bytes", "sha256"), "document_id", "left")
    same = (F.length("content") == F.col("size_bytes")) & (F.sha2("content", 256) == F.col("sha256"))
    return both.withColumn("ok", F.coalesce(same, F.lit(False)))
