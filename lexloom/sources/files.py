"""Documents from files: paged documents, plain text, and tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Extractor = Callable[[bytes], list[str]]
LOADED = "filepath string, filename string, pages array<string>, total_pages int, raw_text string, load_error string"


def pdf_pages(password: str | None = None) -> Extractor:
    """Extractor of PDF pages by whichever PDF library is installed; without one, every file is a row with an error."""

    def extract(data: bytes) -> list[str]:
        try:
            import fitz
        except ImportError:
            try:
                from io import BytesIO

                from pypdf import PdfReader
            except ImportError:
                raise RuntimeError("no PDF library is installed") from None
            reader = PdfReader(BytesIO(data))
            if reader.is_encrypted and not reader.decrypt(password or ""):
                raise RuntimeError("password required")
            return [p.extract_text() or "" for p in reader.pages]
        with fitz.open(stream=data, filetype="pdf") as doc:
            if doc.needs_pass and not doc.authenticate(password or ""):
                raise RuntimeError("password required")
            return [p.get_text() for p in doc]

    return extract


def text_pages(data: bytes) -> list[str]:
    """Pages of a text file, parted by form feeds."""
    return data.decode("utf-8").split("\f")


_WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_pages(data: bytes) -> list[str]:
    """Pages of a word-processor file (Office Open XML): paragraphs as lines, parted where a page break is written.

    Only breaks that stand in the file are known; what a program would break itself is one page.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        body = ElementTree.fromstring(parts.read("word/document.xml"))
    pages: list[list[str]] = [[]]
    for paragraph in body.iter(f"{_WORD_XML}p"):
        line = ""
        for node in paragraph.iter():
            kind = node.tag.removeprefix(_WORD_XML)
            if kind == "t":
                line += node.text or ""
            elif kind == "tab":
                line += "\t"
            elif kind == "lastRenderedPageBreak" or kind == "br" and node.get(f"{_WORD_XML}type") == "page":
                if line:
                    pages[-1].append(line)
                    line = ""
                if pages[-1]:
                    pages.append([])
            elif kind in ("br", "cr"):
                line += "\n"
        pages[-1].append(line)
    return ["\n".join(p) for p in pages]


def any_pages(password: str | None = None) -> Callable[[str, bytes], list[str]]:
    """Extractor by the ending of a file's name: PDF, word-processor or text files."""
    pdf = pdf_pages(password)

    def extract(name: str, data: bytes) -> list[str]:
        ending = name.rsplit(".", 1)[-1].lower()
        return pdf(data) if ending == "pdf" else docx_pages(data) if ending == "docx" else text_pages(data)

    return extract


def load_bytes(df: DataFrame, content: str, path: str, extract: Extractor, named: bool = False) -> DataFrame:
    """Loaded documents from a column of bytes. A failure becomes the row's error; nothing is raised.

    With ``named``, the extractor is given the file's name before its bytes (see ``any_pages``).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, data in zip(pdf["path"], pdf["content"]):
                name = (p or "").rsplit("/", 1)[-1]
                try:
                    if not data:
                        raise RuntimeError("empty file")
                    pages = extract(name, bytes(data)) if named else extract(bytes(data))
                    out.append((p, name, pages, len(pages), "\n".join(pages), None))
                except Exception as e:
                    out.append((p, name, [], 0, "", str(e)))
            yield pd.DataFrame(out, columns=["filepath", "filename", "pages", "total_pages", "raw_text", "load_error"])

    return df.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, LOADED)


def load(spark: SparkSession, folder: str, extract: Extractor, pattern: str = "*.pdf", recursive: bool = False, named: bool = False) -> DataFrame:
    """Loaded documents of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return load_bytes(files, "content", "path", extract, named)


def scan(spark: SparkSession, folder: str, pattern: str = "*.{pdf,docx,txt}", recursive: bool = True) -> DataFrame:
    """Paths, sizes and times of files, their content unread, in order of path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "length", "modificationTime").orderBy("path")


def whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text file."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(folder).select(F.col("_metadata.file_path").alias("filepath"), F.col("value").alias("raw_text"))
