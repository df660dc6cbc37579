"""Sources: which parser reads a path, and readers of files by kind.

Text and code are read by Spark itself; marked-up and office files come through ``binaryFile`` and an Arrow
function with the standard library's parsers.  ``register_parser`` adds a kind.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.tables import share_package

# Extensions by kind of parser.
EXTENSIONS = {
    "text": ("txt", "md"),
    "code": ("py", "js", "ts", "java"),
    "html": ("html", "htm"),
    "pdf": ("pdf",),
    "docx": ("docx",),
    "pptx": ("pptx",),
    "image": ("png", "jpg", "jpeg", "gif", "bmp"),
    "audio": ("wav", "mp3", "flac", "m4a", "ogg"),
}


def extension_of(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)


def parser_of(path: Column) -> Column:
    """Kind of the parser of a path: by scheme, then extension; other URLs are HTML; null where none fits."""
    extension = extension_of(path)
    found = F.when(F.rlike(path, F.lit(r"^https?://(?:www\.)?(?:youtube\.com|youtu\.be)")), "youtube")
    for kind, extensions in EXTENSIONS.items():
        found = found.when(extension.isin(*extensions), kind)
    return found.when(path.startswith("http"), "html")


class _Markup(HTMLParser):
    BLOCKS = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "br", "section", "article", "title", "td"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(content: bytes) -> str:
    """Texts of the elements, a line each."""
    markup = _Markup()
    markup.feed(content.decode("utf-8", "replace"))
    lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(markup.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def _paragraphs(document: bytes, paragraph: str, run: str) -> str:
    tree = ElementTree.fromstring(document)
    rows = ("".join(t.text or "" for t in p.iter(run)) for p in tree.iter(paragraph))
    return "\n".join(r for r in rows if r.strip())


def docx_text(content: bytes) -> str:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        return _paragraphs(file.read("word/document.xml"), f"{space}p", f"{space}t")


def pptx_text(content: bytes) -> str:
    space = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        slides = sorted((n for n in file.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        return "\n".join(_paragraphs(file.read(n), f"{space}p", f"{space}t") for n in slides)


PARSERS: dict[str, Callable[[bytes], str]] = {
    "text": lambda content: content.decode("utf-8", "replace"),
    "code": lambda content: content.decode("utf-8", "replace"),
    "html": html_text,
    "docx": docx_text,
    "pptx": pptx_text,
}


def register_parser(kind: str, extensions: tuple[str, ...], parse: Callable[[bytes], str]) -> None:
    EXTENSIONS[kind] = extensions
    PARSERS[kind] = parse


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(``path``, ``checksum``, ``parser``, ``text``, ``error``) of the files below ``path``.

    ``text`` is null where no parser is registered or it fails; ``error`` says how it failed.
    """
    share_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    parsers = dict(PARSERS)

    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for kind, content in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = error = None
                try:
                    text = parsers[kind](content) if kind in parsers else None
                except Exception as wrong:  # noqa: BLE001  a broken file is a row that says so
                    error = f"{type(wrong).__name__}: {wrong}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "checksum", "parser", "text", "error"])

    return files.select("path", F.md5("content").alias("checksum"), parser_of(F.col("path")).alias("parser"), "content").mapInArrow(run, "path string, checksum string, parser string, text string, error string")
