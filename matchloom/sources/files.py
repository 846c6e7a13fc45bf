"""Files to documents and lines: validation, DOCX and plain text without dependencies, PDF where a parser is installed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.config import Files
from matchloom.functions import text as X

_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: The first four bytes of files of each format.
MAGIC = {"pdf": ("25504446",), "docx": ("504B0304", "504B0506")}


def read_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("pdf", "docx")) -> DataFrame:
    """path, modificationTime, length, content of a folder's files, with suffixes in any case, not those of folders below
    it; the pattern is applied when the folder is listed.

    The scan leaves out files of 0 bytes; they are added from its listing, with length 0 and no content. The listing is
    that which the scan itself keeps on the driver: paths alone.
    """
    either = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in extensions)
    scan = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{either}}}").load(path)
    listed = spark.createDataFrame([(p,) for p in scan.inputFiles()], "path string")
    key = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    listed = listed.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))  # as the scan writes it
    empty = listed.withColumn("k", key).join(scan.select(key.alias("k")), "k", "left_anti")
    return scan.unionByName(empty.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def sorted_paths(files: DataFrame) -> DataFrame:
    """The files in the order of their paths."""
    return files.orderBy("path")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def validated(files: DataFrame, cfg: Files = Files()) -> DataFrame:
    """files with format, sanitized_name, status and messages. Bad files are rows of status error, not exceptions; a
    wrong signature is only a warning."""
    ext = extension(F.col("path"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    bad_type = ~ext.isin(*cfg.extensions)
    empty, large = F.col("length") == 0, F.col("length") > int(cfg.max_mb * 1024 * 1024)
    magic = F.hex(F.substring("content", 1, 4))
    right = F.lit(False)
    for e, marks in MAGIC.items():
        right = right | ((ext == e) & magic.isin(*marks))
    status = F.when(bad_type | empty | large, "error").when(~right, "warning").otherwise("valid")
    notes = F.array_compact(
        F.array(F.when(bad_type, "unsupported extension"), F.when(~bad_type & empty, "empty file"), F.when(~bad_type & ~empty & large, "file too large"), F.when(~bad_type & ~empty & ~large & ~right, "unexpected signature"))
    )
    return files.select("*", name.alias("file_name"), X.sanitised_name(name).alias("sanitized_name"), ext.alias("format"), status.alias("status"), notes.alias("messages"))


def _text(node: ElementTree.Element, glue: str = "") -> str:
    return glue.join(t.text or "" for t in node.iter(f"{_NS}t"))


def docx_lines(content: bytes) -> list[str]:
    """Paragraphs, empty ones too, and a line `a | b` for each table row that holds text, in the order of the body."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_NS}body")
    out: list[str] = []
    for child in body if body is not None else ():
        if child.tag == f"{_NS}p":
            out.append(_text(child))
        elif child.tag == f"{_NS}tbl":
            for row in child.iter(f"{_NS}tr"):
                cells = [_text(c, " ").strip() for c in row.iter(f"{_NS}tc")]
                if any(cells):
                    out.append(" | ".join(cells))
    return out


def pdf_lines(content: bytes) -> list[tuple[int, str]]:
    """(page, line) by the blocks' and lines' places on the page; of a page without such blocks the lines of its plain
    text. Needs the optional parser."""
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("no PDF parser is installed") from e
    out: list[tuple[int, str]] = []
    with pymupdf.open(stream=content, filetype="pdf") as doc:
        for number, page in enumerate(doc, 1):
            before = len(out)
            blocks = [b for b in page.get_text("dict")["blocks"] if b.get("type") == 0]
            for block in sorted(blocks, key=lambda b: (b["bbox"][1], b["bbox"][0])):
                for line in sorted(block["lines"], key=lambda x: (x["bbox"][1], x["bbox"][0])):
                    text = "".join(s["text"] for s in line["spans"])
                    if text:
                        out.append((number, text))
            if len(out) == before:
                out += [(number, text) for text in page.get_text("text").split("\n") if text.strip()]
    return out


_LINES = "doc_id string, line_no int, page_no int, local_line_no int, text string, error string"


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for doc, kind, content in zip(b["doc_id"], b["format"], b["content"], strict=True):
            try:
                if kind == "docx":
                    rows = [(1, t) for t in docx_lines(bytes(content))]
                elif kind == "pdf":
                    rows = pdf_lines(bytes(content))
                else:
                    rows = [(1, t) for t in bytes(content).decode("utf-8", "replace").splitlines()]
            except Exception as e:  # a bad file is a row, so that it can't fail its task
                out.append((doc, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
                continue
            local: dict[int, int] = {}
            for i, (page, text) in enumerate(rows, 1):
                local[page] = local.get(page, 0) + 1
                out.append((doc, i, page, local[page], text, None))
        pdf = pd.DataFrame(out, columns=[c.split()[0] for c in _LINES.split(", ")])
        yield pdf.astype({"line_no": "Int32", "page_no": "Int32", "local_line_no": "Int32"})


def extracted_lines(files: DataFrame) -> DataFrame:
    """doc_id, line_no, page_no, local_line_no, text, error of validated files; a file that can't be read gives one row
    with its error. doc_id is a hash of the path, so a repeated task gives the same."""
    ok = files.filter("status <> 'error'").select(F.substring(F.sha2("path", 256), 1, 12).alias("doc_id"), "format", "content")
    return ok.mapInPandas(_extract, _LINES)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new; of rows with one key, those of new stay."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)
