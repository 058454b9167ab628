"""File sources and sinks: raw texts, DOCX and PDF, processed JSON, benchmark CSV, results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators.hierarchy import HIERARCHY

UPLOAD_CAP = 20 << 20
PAGES = "array<struct<page_number: int, text: string, is_scanned: boolean>>"
PROCESSED = f"document_id string, title string, language string, pages {PAGES}, metadata struct<file_name: string, file_path: string, file_size_bytes: bigint, file_type: string, num_pages: int, language: string, creation_date: string, pdf_properties: map<string, string>, is_scanned: boolean, ocr_applied: boolean>"
BENCHMARK_COLUMNS = ("ID", "Question", "Query_Type", "Difficulty", "Expected_Section", "Expected_Keywords", "Expected_Answer_Summary")


def raw_files(spark: SparkSession, path: str, cap: int = UPLOAD_CAP) -> DataFrame:
    """path, content, length, ext; files above the cap are left out. The filter on length spares reading their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= cap)
    return files.select("path", "content", "length", "modificationTime", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"))


def decode_text(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are not valid UTF-8."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(utf8, F.decode(content, "ISO-8859-1"))


def load_text(files: DataFrame) -> DataFrame:
    """One page for each text file; none for a blank one."""
    text = decode_text(F.col("content"))
    page = F.struct(F.lit(1).alias("page_number"), text.alias("text"), F.lit(False).alias("is_scanned"))
    return files.where("ext = 'txt'").select("path", F.when(F.trim(text) == "", F.array().cast(PAGES)).otherwise(F.array(page)).alias("pages"))


def load_docx(files: DataFrame) -> DataFrame:
    """Non-blank paragraphs of a DOCX as one page: an archive of XML has no built-in reader, so a batch function reads it."""

    def run(batches):
        import io
        import re
        import xml.etree.ElementTree as ET
        import zipfile

        import pandas as pd

        ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for frame in batches:
            pages = []
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    root = ET.fromstring(z.read("word/document.xml"))
                lines = ["".join(t.text or "" for t in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p")]
                text = "\n".join(x for x in lines if re.search(r"\S", x))
                pages.append([{"page_number": 1, "text": text, "is_scanned": False}] if text else [])
            yield pd.DataFrame({"path": frame["path"], "pages": pages})

    return files.where("ext = 'docx'").select("path", "content").mapInPandas(run, f"path string, pages {PAGES}")


def load_pdf(files: DataFrame, pages_of: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Pages of PDFs by ``pages_of``, a function of the bytes; without one, PyMuPDF if it is installed."""

    def run(batches):
        import pandas as pd

        def default(content: bytes) -> list[str]:
            import fitz

            return [p.get_text() for p in fitz.open(stream=content, filetype="pdf")]

        read = pages_of or default
        for frame in batches:
            pages = [[{"page_number": i, "text": t, "is_scanned": not t.strip()} for i, t in enumerate(read(c), 1)] for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "pages": pages})

    return files.where("ext = 'pdf'").select("path", "content").mapInPandas(run, f"path string, pages {PAGES}")


def load_any(files: DataFrame, pages_of=None) -> DataFrame:
    """Text, DOCX and PDF together; a file of another kind is an error when it is reached."""
    other = files.where("not coalesce(ext in ('txt', 'docx', 'pdf'), false)").select("path", F.raise_error(F.concat(F.lit("no loader for "), "path")).cast(PAGES).alias("pages"))
    return load_text(files).unionByName(load_docx(files)).unionByName(load_pdf(files, pages_of)).unionByName(other)


def has_text(pages: Column) -> Column:
    return F.exists(F.slice(pages, 1, 5), lambda p: F.length(F.trim(p["text"])) > 0)


def scanned(pages: Column) -> Column:
    """More than half of the first five pages have fewer than 50 characters, or there is no page."""
    first = F.slice(pages, 1, 5)
    return (F.size(pages) == 0) | (2 * F.size(F.filter(first, lambda p: F.length(F.trim(p["text"])) < 50)) > F.size(first))


def write_processed(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Broken files give a row with only _corrupt_record, and do not stop the scan."""
    return spark.read.schema(f"{PROCESSED}, _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def write_hierarchies(documents: DataFrame, path: str) -> None:
    """Compressed: names of fields are most of a record."""
    documents.write.mode("overwrite").option("compression", "gzip").json(path)


def read_hierarchies(spark: SparkSession, path: str) -> DataFrame:
    """Nested hierarchy records, one a line or one a file. Broken ones give a row with only _corrupt_record."""
    return spark.read.schema(f"{HIERARCHY}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    item = "struct<id: string, domain: string, query: string, reference_answer: string, citations: array<struct<citation_text: string, node_id: string, label: string, numbering: string, title: string>>, language: string, grounded: boolean, difficulty: string, expected_counter_authority_markers: array<string>, notes: string>"
    return spark.read.schema(f"name string, items array<{item}>").option("multiLine", "true").json(path).select("name", F.explode("items").alias("item")).select("name", "item.*")


def read_benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').schema(", ".join(f"{c} string" for c in BENCHMARK_COLUMNS)).csv(path)


def benchmark_problems(items: DataFrame) -> DataFrame:
    """(ID, problem): repeated ids, and missing questions, types or difficulties."""
    again = items.groupBy("ID").count().where("count > 1").select("ID", F.lit("duplicate_id").alias("problem"))
    missing = [items.where(F.coalesce(F.trim(c), F.lit("")) == "").select("ID", F.lit(f"missing_{c.lower()}").alias("problem")) for c in ("Question", "Query_Type", "Difficulty")]
    for x in missing:
        again = again.unionByName(x)
    return again


def write_results(rows: DataFrame, path: str) -> None:
    """JSON as it is, and CSV with nested columns as JSON strings."""
    rows.write.mode("overwrite").json(f"{path}/json")
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in rows.schema]
    rows.select(*flat).write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    """A small report table, rendered on the driver from at most ``limit`` rows."""
    got = rows.limit(limit).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got)])
