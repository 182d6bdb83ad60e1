"""Files as DataFrames: discovery, hashes, admission, and the text of PDF files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD = 50 * 1024 * 1024


def admitted(content: Column, largest: int = MAX_UPLOAD, magic: bytes = b"%PDF-") -> Column:
    """``too large``, ``wrong type`` or ``ok``; size is looked at first."""
    begins = F.substring(content, 1, len(magic)) == F.lit(magic)
    return F.when(F.octet_length(content) > largest, "too large").when(~begins, "wrong type").otherwise("ok")


PDF = "*.[pP][dD][fF]"


def _binary(spark: SparkSession, folder: str | list[str], glob: str) -> DataFrame:
    for path in [folder] if isinstance(folder, str) else folder:
        if "://" not in path and not path.startswith("file:") and not Path(path).exists():
            raise FileNotFoundError(path)
    paths = folder if isinstance(folder, str) else [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in folder]
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)
    return files.withColumns({"file_name": F.element_at(F.split("path", "/"), -1), "modified": F.col("modificationTime")})


def listed(spark: SparkSession, folder: str, glob: str = PDF) -> DataFrame:
    """Files of a folder (not of folders in it), from its listing alone: path, file_name, length, modified. No content is read."""
    return _binary(spark, folder, glob).select("path", "file_name", "length", "modified")


def discovered(spark: SparkSession, folder: str | list[str], glob: str = PDF) -> DataFrame:
    """Files of a folder (not of folders in it), or of a list of paths: path, file_name, length, modified, md5, content."""
    return _binary(spark, folder, glob).select("path", "file_name", "length", "modified", F.md5("content").alias("md5"), "content")


def pdf_text(data: bytes) -> list[str]:
    """Text of a PDF's content streams, one string per stream with text.

    Uses pypdf where it is installed. Otherwise plain and Flate streams are read for the strings that
    text operators show, which covers simple files only.
    """
    try:
        import io

        import pypdf
    except ImportError:
        pass
    else:
        return [page.extract_text() for page in pypdf.PdfReader(io.BytesIO(data)).pages]
    if not data.startswith(b"%PDF-"):
        raise ValueError("not a PDF file")
    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\n?endstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        shown = [s for block in re.findall(rb"BT(.*?)ET", body, re.S) for s in re.findall(rb"\(((?:\\.|[^\\)])*)\)\s*(?:Tj|'|\"|[^()\]]*\]\s*TJ)|\(((?:\\.|[^\\)])*)\)", block)]
        if shown:
            pages.append("".join(re.sub(rb"\\([()\\])", rb"\1", a or b).decode("latin-1") for a, b in shown))
    return pages


PAGES = "path string, source string, page_label string, text string, error string, md5 string, length long, modified timestamp, same boolean"


def loaded(files: DataFrame, parse: Callable[[bytes], list[str]] = pdf_text) -> DataFrame:
    """Text of each file by page: path, source, page_label, text, error; and md5, length, modified of the file.

    A file that can't be read, or has no text, gives one row with ``error``. With a column ``known`` (a hash) a file that has this very hash is not
    parsed and gives one row that is ``same``. ``parse`` makes the pages of a file's content (any loader with this signature will do). Contents are parsed by the tasks that read them.
    """
    if "known" not in files.columns:
        files = files.withColumn("known", F.lit(None).cast("string"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, name, data, md5, length, modified, known in batch.itertuples(index=False):
                about = (md5, length, modified, md5 == known)
                if md5 == known:
                    out.append((path, name, None, None, None, *about))
                    continue
                try:
                    pages = parse(bytes(data))
                    if not any(text.strip() for text in pages):
                        raise ValueError("no text found")
                    out += [(path, name, str(i), text, None, *about) for i, text in enumerate(pages, 1)]
                except Exception as error:  # one bad file must not stop the others; it is reported
                    out.append((path, name, None, None, str(error), *about))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])

    return files.select("path", "file_name", "content", "md5", "length", "modified", "known").mapInPandas(rows, PAGES)


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """Text of one file by page, as ``loaded`` gives it."""
    return loaded(discovered(spark, [path]))


def load_folder(spark: SparkSession, folder: str) -> DataFrame:
    files = discovered(spark, folder)
    if files.isEmpty():
        raise ValueError(f"No files found in {folder}")
    return loaded(files)
