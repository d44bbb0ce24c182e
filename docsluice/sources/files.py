"""Documents from files."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.functions.names import suffix
from docsluice.functions.text import decode_text
from docsluice.session import found_at

# The supported file types.
SUPPORTED = ["txt", "pdf", "docx", "doc", "md"]

# Turns the bytes of one file into its text; may raise.
Extractor = Callable[[bytes], str]

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (path, length, content, ...) of the files that paths and wildcards name.

    Of a folder, not its subfolders, the files of supported types are taken; a file
    named by itself or by a wildcard is taken whatever its type, and as often as it is
    named. Paths that name nothing give a warning.
    """
    folders, singles = [], []
    for path in paths:
        found = found_at(spark, path)
        if not found:
            warnings.warn(f"no such file or folder: {path}", stacklevel=2)
        for place, is_folder in found:
            (folders if is_folder else singles).append(place)
    reader = spark.read.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "false")
    parts = []
    kinds = "*.{" + ",".join(SUPPORTED) + "}"
    for places in _rounds(folders):
        parts.append(reader.option("pathGlobFilter", kinds).load(places))
    for places in _rounds(singles):
        whole = spark.read.format("binaryFile").schema(FILE_SCHEMA)
        parts.append(whole.load([_literal(place) for place in places]))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FILE_SCHEMA)


def _rounds(places: list[str]) -> list[list[str]]:
    """The places, each once per list: a scan reads a path once, however often it is given."""
    rounds: list[list[str]] = []
    for place, times in Counter(places).items():
        rounds += [[] for _ in range(times - len(rounds))]
        for chosen in rounds[:times]:
            chosen.append(place)
    return rounds


def _literal(path: str) -> str:
    """The path with the signs of wildcards taken as themselves."""
    return "".join(f"\\{sign}" if sign in "*?[]{}\\" else sign for sign in path)


def docx_text(data: bytes) -> str:
    """The paragraphs of the body, without tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{WORD}body")
    return "\n".join("".join(_pieces(paragraph)) for paragraph in body.findall(f"{WORD}p")).strip()


def _pieces(element: ElementTree.Element) -> Iterator[str]:
    for child in element:
        if child.tag in (f"{WORD}r", f"{WORD}hyperlink"):
            yield from _pieces(child)
        elif child.tag == f"{WORD}t":
            yield child.text or ""
        elif child.tag == f"{WORD}tab":
            yield "\t"
        elif child.tag in (f"{WORD}br", f"{WORD}cr"):
            yield "\n"


DEFAULT_EXTRACTORS: dict[str, Extractor] = {"docx": docx_text, "doc": docx_text}


def extract_documents(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """Rows (path, content, file_extension, file_size, error) from the rows of `scan_files`.

    `extractors` adds or replaces readers by file type, such as pdf. Types without
    a reader are read as text; a pdf without one, or a broken file, gives an error.
    """
    readers = {**DEFAULT_EXTRACTORS, **(extractors or {})}
    typed = files.select(
        "path",
        F.col("content").alias("data"),
        F.regexp_replace(suffix(F.col("path")), r"^\.", "").alias("file_extension"),
        F.col("length").alias("file_size"),
    )
    coded = F.col("file_extension").isin(list(dict.fromkeys([*readers, "pdf"])))
    # Every file is read once: what is text is decoded before the readers, what is not passes through them.
    decoded = typed.select(
        "path",
        "file_extension",
        "file_size",
        F.when(~coded, decode_text(F.col("data"))).alias("content"),
        F.when(coded, F.col("data")).alias("data"),
    )
    schema = "path string, content string, file_extension string, file_size long, error string"
    return decoded.mapInPandas(_reader(readers), schema)


def _reader(readers: dict[str, Extractor]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(kind: str, data: bytes | None, text: str | None) -> tuple[str | None, str | None]:
        if data is None:
            return text, None
        if kind not in readers:
            return None, "no extractor for this file type"
        try:
            return readers[kind](bytes(data)), None
        except Exception as error:  # a broken file is a row with an error
            return None, f"Failed to extract content: {error}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read(*row) for row in zip(batch["file_extension"], batch["data"], batch["content"])]
            yield pd.DataFrame(
                {
                    "path": batch["path"],
                    "content": [text for text, _ in found],
                    "file_extension": batch["file_extension"],
                    "file_size": batch["file_size"],
                    "error": [error for _, error in found],
                }
            )

    return run
