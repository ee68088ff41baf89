"""Files in and out: uploads, page text, exports, deletions, keyed tables with a lifetime."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, MAX_FILES, MAX_PAGES = 20 * 1024 * 1024, 10, 50
SCANNED_BELOW = 50


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with the first reason to reject each, or null: extension, size, magic bytes. Spark
    lists no empty files, so an upload that is missing here was empty."""
    files = spark.read.format("binaryFile").load(folder)
    error = (
        F.when(~F.lower("path").endswith(".pdf"), "not a PDF file name")
        .when(F.col("length") > MAX_BYTES, "too large")
        .when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not a PDF")
    )
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content", error.alias("error"))


def request_error(files: DataFrame) -> str | None:
    """Why a request is rejected as a whole: its first bad file by name, or too many files."""
    n, first = files.agg(F.count("*"), F.min(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "filename", "error")))).first()
    return f"more than {MAX_FILES} files" if n > MAX_FILES else first


def page_text(files: DataFrame, extract: Callable[[bytes], list[str]], ocr: Sequence[Callable[[bytes, int], str]] = ()) -> DataFrame:
    """(filename, page_num, text, is_scanned, ocr_used, error) by an extraction hook; a file that fails gives its error alone. A page with
    next to no text is scanned: the OCR hooks (content, page index) are asked one after the other until one reads it."""

    def read(content: bytes, index: int, text: str) -> tuple[str, bool, bool]:
        scanned = len(text.strip()) < SCANNED_BELOW
        found = next((t for engine in (ocr if scanned else ()) if (t := engine(content, index)).strip()), None)
        return (text if found is None else found), scanned, found is not None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["filename"], frame["content"], strict=True):
                try:
                    pages = extract(bytes(content))
                    if len(pages) > MAX_PAGES:
                        raise ValueError(f"more than {MAX_PAGES} pages")
                    rows += [(name, i + 1, *read(bytes(content), i, t), None) for i, t in enumerate(pages)]
                except Exception as e:  # one bad file is reported and doesn't stop the others
                    rows.append((name, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["filename", "page_num", "text", "is_scanned", "ocr_used", "error"]).astype({"page_num": "Int32", "is_scanned": "boolean", "ocr_used": "boolean"})

    return files.where("error is null").select("filename", "content").mapInPandas(run, "filename string, page_num int, text string, is_scanned boolean, ocr_used boolean, error string")


def carry_headers(fragments: DataFrame) -> DataFrame:
    """Table fragments (page_id, fragment, header, rows): one without a header takes the last before it."""
    from pyspark.sql import Window

    so_far = Window.partitionBy("page_id").orderBy("fragment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return fragments.withColumn("header", F.last("header", ignorenulls=True).over(so_far))


def export_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


CONFLICT_COLUMNS = ["entity_label", "doc_a_id", "doc_a_value", "doc_b_id", "doc_b_value", "severity"]


def export_conflicts(rows: DataFrame, path: str) -> None:
    """The six columns of conflict rows."""
    export_csv(rows.select(CONFLICT_COLUMNS), path)


def export_csv(rows: DataFrame, path: str) -> None:
    """With a header; fields are quoted only where they must be."""
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")


def alive(table: DataFrame, now: Column) -> DataFrame:
    """Rows of a keyed table that have not expired; without expires_at they never do."""
    return table.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def in_scope(rows: DataFrame, key: str | None, keys: list[str], header: str | None = None) -> DataFrame:
    """Rows of the caller's scope: everyone's is default where no keys are set; an unknown key may see nothing. A key in the header
    goes before one in the query."""
    key = header or key
    if keys and key not in keys:
        raise PermissionError("unknown key")
    return rows.where(F.col("scope") == (key if keys else "default"))


def find_document(sessions: DataFrame, doc_id: str) -> DataFrame:
    """The first session that holds a document, by audit_id."""
    return sessions.select("audit_id", F.explode("documents").alias("d")).where(F.col("d.doc_id") == doc_id).orderBy("audit_id").limit(1)
