"""Source files as page records: source, source_path, doc_type, page, text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestrata.functions import text as T

EXTENSIONS = (".pdf", ".docx", ".md", ".markdown", ".html", ".htm", ".txt")
PARAGRAPH = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: A parser of a paged format: content and the most pages wanted (None: all), to the pages' texts, None for a bad page.
PageParser = Callable[[bytes, int | None], list[str | None]]


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def html_text(content: bytes) -> str:
    """All text outside scripts and styles, a line each text node."""
    parser = _Text()
    parser.feed(content.decode("utf-8", "replace"))
    parser.close()
    return "\n".join(parser.found)


@F.pandas_udf(StringType())
def page_text(pages: pd.Series) -> pd.Series:
    """html_text of a column of pages; null stays null."""
    return pages.map(lambda p: None if p is None else html_text(p.encode()))


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{PARAGRAPH}t")) for p in tree.iter(f"{PARAGRAPH}p"))


def excluded_reason(source: Column) -> Column:
    """Why a file is left out, null if it isn't."""
    name = F.lower(source)
    return (
        F.when(T.text_name_of(source) == "Charaka Samhita", "exclude_charaka")
        .when(F.startswith(name, F.lit("ashtanga_hridaya_srikantha_murthy")), "exclude_ah_srikantha_murthy")
        .when(F.startswith(name, F.lit("ashtanga_hridaya_sanskrit_commentaries")), "exclude_ah_sanskrit_commentaries")
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, content, source, ext, doc_type and reason of the files below root that can be read; none is opened here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    source = F.element_at(F.split("path", "/"), -1)
    return (
        files.select("path", "length", "content", source.alias("source"))
        .withColumn("ext", F.lower(F.regexp_extract("source", r"\.[^.]+$", 0)))
        .where(F.col("ext").isin(*EXTENSIONS))
        .withColumns({"doc_type": T.doc_type_of(F.col("path")), "reason": excluded_reason(F.col("source"))})
    )


def records_of(files: DataFrame, pdf: PageParser | None = None, max_pages: int | None = None) -> DataFrame:
    """Page records of files that aren't excluded. A file that can't be parsed has none; texts under 20 characters go.

    pdf parses the only paged format; without it such files have no records.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, source, kind, ext, content in zip(b["path"], b["source"], b["doc_type"], b["ext"], b["content"], strict=True):
                pages: list[tuple[int | None, str | None]] = []
                try:
                    if ext == ".pdf":
                        pages = [(i, t) for i, t in enumerate(pdf(content, max_pages)[:max_pages] if pdf else [], 1)]
                    elif ext == ".docx":
                        pages = [(None, docx_text(content))]
                    elif ext in (".html", ".htm"):
                        pages = [(None, html_text(content))]
                    else:
                        pages = [(None, content.decode("utf-8", "replace"))]
                except Exception:  # noqa: BLE001  one bad file doesn't end the scan
                    pages = []
                rows += [(source, re.sub(r"^file:/+", "/", path), kind, page, t) for page, t in pages if t is not None]
            out = pd.DataFrame(rows, columns=["source", "source_path", "doc_type", "page", "text"])
            yield out.astype({"page": "Int64"})

    kept = files.where("reason is null").select("path", "source", "doc_type", "ext", "content")
    found = kept.mapInPandas(run, "source string, source_path string, doc_type string, page int, text string")
    return found.withColumn("text", T.normalize_whitespace(F.col("text"))).where(F.length("text") >= T.MIN_RECORD_CHARS)


def first_files(records: DataFrame, max_files: int) -> DataFrame:
    """The records of the first max_files files, by path, that have any."""
    paths = records.select("source_path").distinct().orderBy("source_path").limit(max_files)
    return records.join(F.broadcast(paths), "source_path", "left_semi") if max_files <= 10_000 else records.join(paths, "source_path", "left_semi")


def catalog(files: DataFrame) -> DataFrame:
    """Files and kilobytes of each document type."""
    return files.groupBy("doc_type").agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("length") / 1024, 1).alias("size_kb"))
