"""Document sources: files of several formats as rows of elements.

Files are read as binary rows, and the reader of a file's extension turns its bytes into elements (category, content,
page). Office files are archives of XML and need no other library; other formats are added with `reader`.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import ingest

Element = tuple[str, str, int]
Reader = Callable[[bytes], Iterable[Element]]
_READERS: dict[str, Reader] = {}
#: Files of one Arrow batch; a file is held whole by the task that reads it.
BATCH_FILES = 8


def reader(*extensions: str) -> Callable[[Reader], Reader]:
    """Registers a function from a file's bytes to (category, content, page)."""

    def register(f: Reader) -> Reader:
        _READERS.update(dict.fromkeys(extensions, f))
        return f

    return register


def formats() -> list[str]:
    return sorted(_READERS)


def _texts(node: ElementTree.Element, tag: str) -> str:
    return "".join(x.text or "" for x in node.iter() if x.tag.endswith(tag))


@reader("docx")
def read_docx(data: bytes) -> Iterator[Element]:
    """Paragraphs and table rows of a word-processor file; pages follow its rendered page breaks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(iter(ElementTree.fromstring(z.read("word/document.xml"))))
    page = 1
    for node in body:
        if node.tag.endswith("}tbl"):
            for row in (r for r in node.iter() if r.tag.endswith("}tr")):
                yield "Table", " | ".join(_texts(c, "}t") for c in row if c.tag.endswith("}tc")), page
        elif node.tag.endswith("}p"):
            page += sum(x.tag.endswith("}lastRenderedPageBreak") for x in node.iter())
            style = next((v for x in node.iter() if x.tag.endswith("}pStyle") for v in x.attrib.values()), "")
            listed = any(x.tag.endswith("}numPr") for x in node.iter())
            yield "Title" if style.startswith(("Heading", "Title")) else "ListItem" if listed else "NarrativeText", _texts(node, "}t"), page


@reader("pptx")
def read_pptx(data: bytes) -> Iterator[Element]:
    """Paragraphs of a slide show, a slide a page; speaker notes are not read."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for page, name in slides:
            for shape in (x for x in ElementTree.fromstring(z.read(name)).iter() if x.tag.endswith("}sp")):
                title = any(x.tag.endswith("}ph") and x.attrib.get("type") in ("title", "ctrTitle") for x in shape.iter())
                for p in (x for x in shape.iter() if x.tag.endswith("}p")):
                    yield "Title" if title else "NarrativeText", _texts(p, "}t"), page


_PDF_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_PDF_SHOWN = re.compile(rb"\[((?:\\.|[^\]\\])*)\]\s*TJ|\(((?:\\.|[^()\\])*)\)\s*(?:Tj|'|\")|(T\*|Td|TD|ET)", re.S)
_PDF_STRING = re.compile(rb"\(((?:\\.|[^()\\])*)\)", re.S)


def _pdf_text(raw: bytes) -> str:
    return re.sub(rb"\\([()\\])", rb"\1", raw).decode("latin-1")


@reader("pdf")
def read_pdf(data: bytes) -> Iterator[Element]:
    """Lines of simple page descriptions: strings shown in plain or deflated content streams, a stream a page.

    Files with encoded fonts need a reader of a library, registered in place of this one.
    """
    page = 0
    for m in _PDF_STREAM.finditer(data):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        if b"BT" not in body:
            continue
        page += 1
        line: list[str] = []
        for x in _PDF_SHOWN.finditer(body):
            if x[3]:
                if line:
                    yield "NarrativeText", "".join(line), page
                line = []
            else:
                line.append("".join(_pdf_text(s) for s in _PDF_STRING.findall(x[1])) if x[1] is not None else _pdf_text(x[2]))
        if line:
            yield "NarrativeText", "".join(line), page


@reader("txt", "md")
def read_text(data: bytes) -> Iterator[Element]:
    """Lines of plain text; a form feed begins a page."""
    for page, part in enumerate(data.decode("utf-8", "replace").split("\f"), 1):
        for line in part.split("\n"):
            mark = line.strip()
            yield "Title" if mark.startswith("#") else "ListItem" if re.match(r"([-*•]|\d+[.)]) ", mark) else "NarrativeText", mark.lstrip("# "), page


@reader("html", "htm")
def read_html(data: bytes) -> Iterator[Element]:
    """Text runs between tags, with the kind of the tag they follow; scripts and styles are not text."""
    text = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ", data.decode("utf-8", "replace"))
    kinds = {"h1": "Title", "h2": "Title", "h3": "Title", "li": "ListItem", "td": "Table", "th": "Table"}
    for tag, run in re.findall(r"(?s)<(/?\w+)[^>]*>([^<]+)", text):
        yield kinds.get(tag.lower(), "NarrativeText"), html.unescape(run), 1


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """filename, file_type, elem_idx, type, category, content, page, total_pages, error of all files below a path.

    Content is trimmed and never empty, a page is 1 where none is known. A file of an unknown format, or one that its
    reader cannot read, is one row with an error; a missing path is an error of the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(BATCH_FILES, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))
    names = ["filename", "file_type", "elem_idx", "category", "content", "page", "error"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for where, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = where.rsplit("/", 1)[-1]
                kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
                if kind not in _READERS:
                    out.append((name, kind, None, None, None, None, f"unsupported format {kind!r}"))
                    continue
                try:
                    found = [(c, t.strip(), p or 1) for c, t, p in _READERS[kind](data) if t and t.strip()]
                except Exception as e:  # noqa: BLE001, one bad file must not end the scan
                    out.append((name, kind, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                out += [(name, kind, i, c, t, p, None) for i, (c, t, p) in enumerate(found)]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    rows = files.select("path", "content").mapInArrow(run, "filename string, file_type string, elem_idx bigint, category string, content string, page bigint, error string")
    pages = rows.groupBy(F.col("filename").alias("of")).agg(F.coalesce(F.max("page"), F.lit(0)).alias("total_pages"))
    return rows.join(pages, F.col("filename") == F.col("of")).drop("of").withColumn("type", F.when(F.col("error").isNull(), ingest.element_type(F.col("category"))))


def text_runs(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, i, content: trimmed text runs of stored pages, JVM-side; scripts, styles and comments are none."""
    bare = F.regexp_replace(html_col, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    runs = F.filter(F.transform(F.regexp_extract_all(bare, F.lit(r">([^<>]+)<"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return pages.select("page_id", F.posexplode(runs).alias("i", "content")).withColumn("i", F.col("i").cast("bigint"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """term, expansion from a JSON file: a list of terms, or an object with `terms`, `acronyms` and `synonyms`. Driver-side: it is a dictionary."""
    import json

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    found = json.loads(text)
    rows: list[tuple[str, str | None]] = []
    if isinstance(found, list):
        rows = [(t, None) for t in found]
    else:
        rows = [(t, None) for t in found.get("terms", [])] + list(found.get("acronyms", {}).items()) + [(k, s) for k, v in found.get("synonyms", {}).items() for s in v]
    return spark.createDataFrame(rows, "term string, expansion string").distinct()


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """The items of an evaluation set: a JSON document with a list `items`."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("items").alias("x")).select("x.*")
