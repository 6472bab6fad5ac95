"""Files as rows: listing, type by content, parsing of text, DOCX, XLSX and PDF (standard library only)."""

from __future__ import annotations

import io
import re
import signal
import threading
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docsluice.functions.text import detect_language, flatten_table
from docsluice.sources.pdf import parse_pdf

HEAD = 8192


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """source_path, file_name, file_size, modified_at, content. Rows have no order; sort by source_path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    return df.select(F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), "content")


def with_checksum(files: DataFrame) -> DataFrame:
    return files.withColumn("checksum", F.sha2("content", 256)).withColumn("file_type", file_type("content"))


def type_of(content: bytes) -> str | None:
    """pdf, docx, xlsx or txt by content, else None. A zip is told by its folders; text by decoding its head."""
    if content.startswith(b"%PDF-"):
        return "pdf"
    if content.startswith(b"PK\x03\x04"):
        try:
            names = zipfile.ZipFile(io.BytesIO(content)).namelist()
        except zipfile.BadZipFile:
            return None
        word, sheets = (any(n.startswith(p) for n in names) for p in ("word/", "xl/"))
        return None if word == sheets else "docx" if word else "xlsx"
    head = content[:HEAD]
    if not head or b"\0" in head or head.startswith((b"\x7fELF", b"MZ", b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"\x1f\x8b")):
        return None
    control = sum(b < 32 and b not in (9, 10, 12, 13, 27) for b in head)
    return "txt" if control <= len(head) // 100 else None


@F.pandas_udf(StringType())
def file_type(content: pd.Series) -> pd.Series:
    return content.map(type_of, na_action="ignore")


def decode(content: bytes) -> str:
    """UTF-8 (with or without mark), UTF-16 with a mark, else the Western one-byte code."""
    for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, errors="replace")
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("cp1252", errors="replace")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_NONE = {"pages": [], "sections": [], "tables": [], "figures": [], "parse_warnings": []}


def parse_txt(content: bytes, read: Callable[[bytes], str] = decode) -> dict:
    """Paragraphs of a text. read: bytes to text, such as a `charset.PairModel`'s `decode`."""
    blocks = [b.strip() for b in read(content).replace("\r\n", "\n").split("\n\n")]
    return _NONE | {"pages": [{"page_no": 1, "text_blocks": [b for b in blocks if b]}]}


def _table(index: int, rows: list[list[str | None]], page: int | None, sheet: str | None) -> dict:
    return {"index": index, "data": rows, "flattened_text": "\n".join(" | ".join((c or "").strip() for c in r) for r in rows), "page_no": page, "sheet_name": sheet}


def parse_docx(content: bytes) -> dict:
    """One page; paragraphs in Heading or Title styles are sections too; tables apart."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    blocks, sections, tables = [], [], []
    for e in body if body is not None else []:
        if e.tag == f"{_W}p" and (line := text(e).strip()):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            if name.startswith(("Heading", "Title")):
                level = re.search(r"\d+", name)
                sections.append({"title": line, "level": int(level[0]) if level else 1, "page_start": 1})
            blocks.append(line)
        elif e.tag == f"{_W}tbl":
            tables.append(_table(len(tables), [[text(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")], 1, None))
    return _NONE | {"pages": [{"page_no": 1, "text_blocks": blocks}], "sections": sections, "tables": tables}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_xlsx(content: bytes) -> dict:
    """Each sheet with a value is a table; rows without any are left out."""
    z = zipfile.ZipFile(io.BytesIO(content))
    xml = lambda name: ElementTree.fromstring(z.read(name))
    shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    targets = {r.get("Id"): r.get("Target", "") for r in xml("xl/_rels/workbook.xml.rels")}
    tables = []
    for sheet in xml("xl/workbook.xml").iter(f"{_S}sheet"):
        target = targets[sheet.get(f"{_R}id")]
        rows = []
        for r in xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter(f"{_S}row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(r.iter(f"{_S}c")):
                v = c.find(f"{_S}v")
                value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                if value is not None:
                    cells[_column(c.get("r", "")) if c.get("r") else i] = value
            if cells:
                rows.append([cells.get(i) for i in range(max(cells) + 1)])
        if rows:
            tables.append(_table(len(tables), rows, None, sheet.get("name")))
    return _NONE | {"tables": tables}


PARSERS = {"txt": parse_txt, "docx": parse_docx, "xlsx": parse_xlsx, "pdf": parse_pdf}
BACKENDS = ("auto", "primary", "fallback")
PARSED = (
    "pages array<struct<page_no:int,text_blocks:array<string>>>, sections array<struct<title:string,level:int,page_start:int>>, "
    "tables array<struct<index:int,data:array<array<string>>,flattened_text:string,page_no:int,sheet_name:string>>, "
    "figures array<struct<index:int,page_no:int,caption:string>>, parse_warnings array<string>"
)
ATTEMPTS = "attempts array<struct<attempt:int,ocr:boolean,duration_ms:long,timed_out:boolean,error:string>>"
#: Seconds that one attempt may take, and the share of pages with text below which OCR is tried.
TIMEOUT, OCR_BELOW = 120.0, 0.50


def parsers_for(backend: str = "auto", primary: dict | None = None) -> dict:
    """Parsers by type: `fallback` those of this module; `auto` the primary backend's where it has one; `primary`
    the same, but a primary backend must be there."""
    if backend not in BACKENDS or (backend == "primary" and not primary):
        raise ValueError(f"no such backend: {backend}")
    return PARSERS if backend == "fallback" else PARSERS | (primary or {})


def in_time(parse: Callable[[bytes], dict], content: bytes, seconds: float) -> dict:
    """What `parse` gives, or TimeoutError. In a worker's main thread a timer breaks the parser off; elsewhere it is
    left behind in a thread of its own."""
    if threading.current_thread() is threading.main_thread():

        def late(*_):
            raise TimeoutError(f"no result in {seconds} s")

        before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return parse(content)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
    out: dict = {}

    def run() -> None:
        try:
            out["value"] = parse(content)
        except Exception as e:
            out["error"] = e

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        raise TimeoutError(f"no result in {seconds} s")
    if "error" in out:
        raise out["error"]
    return out["value"]


def _covered(parsed: dict) -> float:
    return sum(any(b.strip() for b in p["text_blocks"]) for p in parsed["pages"]) / max(1, len(parsed["pages"]))


def parse_file(content: bytes, kind: str | None, parsers: dict, ocr: Callable[[bytes], dict] | None = None, timeout: float = TIMEOUT, retries: int = 1) -> dict:
    """The parts of a document and its `attempts`. A PDF of which less than `OCR_BELOW` of the pages have text is
    tried again by `ocr`; the last attempt's result holds. A first attempt that took too long is the last."""
    attempts: list[dict] = []

    def attempt(parse: Callable[[bytes], dict] | None, by_ocr: bool) -> dict:
        began, error, late, got = time.perf_counter(), None, False, _NONE
        try:
            if parse is None:
                raise LookupError(f"no parser for {kind}")
            got = _NONE | in_time(parse, content, timeout)
        except TimeoutError as e:
            error, late = str(e), True
        except LookupError as e:
            error = str(e) if parse is None else f"broken file: {e}"
        except Exception as e:
            error = f"broken file: {e}"
        attempts.append({"attempt": len(attempts) + 1, "ocr": by_ocr, "duration_ms": int(1000 * (time.perf_counter() - began)), "timed_out": late, "error": error})
        return got if error is None else _NONE | {"parse_warnings": [error]}

    got = attempt(parsers.get(kind), False)
    if ocr and kind == "pdf" and not attempts[0]["timed_out"] and attempts[0]["error"] is None and _covered(got) < OCR_BELOW:
        for _ in range(retries):
            got = attempt(ocr, True)
    return got | {"attempts": attempts}


def parse_files(files: DataFrame, parsers: dict | None = None, *, ocr: Callable[[bytes], dict] | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """files: file_id, file_type, content. Adds the parts of a parsed document, its language and the attempts made; a
    type without a parser or a file that breaks one or takes too long has no pages and a warning."""
    known = PARSERS if parsers is None else parsers
    columns = ["file_id", "file_type", "pages", "sections", "tables", "figures", "parse_warnings", "attempts"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"file_id": i, "file_type": kind, **parse_file(bytes(content or b""), kind, known, ocr, timeout)} for i, kind, content in zip(batch["file_id"], batch["file_type"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=columns)

    parsed = files.select("file_id", "file_type", "content").mapInPandas(run, f"file_id long, file_type string, {PARSED}, {ATTEMPTS}")
    body = F.array_join(F.flatten(F.col("pages")["text_blocks"]), "\n")
    return parsed.withColumn("language", detect_language(body))


def attempt_metrics(parsed: DataFrame) -> DataFrame:
    """A metrics row for each attempt at a file: step `parse`, duration, ok, detail."""
    each = parsed.select("file_id", F.explode("attempts").alias("a"))
    detail = F.to_json(F.struct("a.attempt", "a.ocr", "a.timed_out", "a.error"))
    return each.select("file_id", F.lit("parse").alias("step"), F.col("a.duration_ms").cast("int").alias("duration_ms"), F.col("a.error").isNull().alias("ok"), detail.alias("detail"))


def tables_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_id", F.posexplode("tables").alias("table_no", "t")).select("file_id", "table_no", F.col("t.page_no").alias("page_no"), F.col("t.sheet_name").alias("sheet_name"), flatten_table(F.col("t.data")).alias("text"))
