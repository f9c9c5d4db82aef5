"""Workbooks (``.xlsx``: zipped XML) in and out, with the standard library inside tasks.

Reading streams one file's first sheet row by row in the task that holds the file: shared and inline
strings, sparse cells, numbers, booleans, errors, and dates by the cell's style. Writing deals the
report's rows into books of at most ``ROWS`` rows a sheet, which bounds a task by the format's own
size; every book holds all sheets. A book's bytes leave the task through Spark's text writer, so that its committer
decides which attempt counts, and the line end that writer adds is the zip file's one-byte comment.
"""

from __future__ import annotations

import datetime
import io
import re
import uuid
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.operators.rank import ordered_rank

ROWS = 200_000  # of a sheet of one book; the format allows 1,048,576
BATCH = 10_000

# Fixed values of the format: namespaces, built-in number formats that are dates, first days of the two calendars.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
CALENDAR = {False: datetime.datetime(1899, 12, 30), True: datetime.datetime(1904, 1, 1)}

_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
_UNSAFE = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def column_letters(n: int) -> str:
    """``A`` for column 0."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(ref: str) -> int:
    """0 for ``A1``."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def escape(text: str) -> str:
    """XML text of a cell; characters that XML can't hold are written ``_xHHHH_``, as the format does."""
    text = _UNSAFE.sub(lambda m: f"_x{ord(m.group()):04X}_", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), text)


def _texts(item) -> str:
    """Text of a string item: its runs, without phonetic hints."""
    runs = [t for child in item for t in ([child] if child.tag == MAIN + "t" else child.findall(MAIN + "t") if child.tag == MAIN + "r" else [])]
    return unescape("".join(t.text or "" for t in runs))


def _is_date(code: str) -> bool:
    """Whether a number format shows a day or a time: d, m, y, h or s outside quotes, brackets and escapes."""
    return bool(re.search("[dmyhsDMYHS]", re.sub(r'"[^"]*"|\[(?![hmsHMS]+\])[^\]]*\]|\\.|_.', "", code)))


def number_text(raw: str, date: bool, calendar_1904: bool) -> str:
    """A number as text: whole numbers without a point, dates as ISO 8601."""
    try:
        x = float(raw)
    except ValueError:
        return raw
    if date:
        try:
            moment = CALENDAR[calendar_1904] + datetime.timedelta(seconds=round(x * 86400))
        except OverflowError:
            return raw
        if x < 1:
            return f"{moment:%H:%M:%S}"
        return f"{moment:%Y-%m-%d}" if moment.time() == datetime.time() else f"{moment:%Y-%m-%d %H:%M:%S}"
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


class Book:
    """A workbook's sheets, strings and date styles."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = {x.get("Id"): x.get("Target") for x in links}
        about = book.find(MAIN + "workbookPr")
        self.calendar_1904 = about is not None and about.get("date1904") in ("1", "true")
        self.sheets = [(s.get("name"), t.lstrip("/") if t.startswith("/") else f"xl/{t}") for s in book.iter(MAIN + "sheet") if (t := target.get(s.get(REL + "id")))]
        self.strings = [_texts(x) for x in self._elements("xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        self.dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            codes = {int(x.get("numFmtId")): x.get("formatCode") or "" for x in styles.iter(MAIN + "numFmt")}
            used = styles.find(MAIN + "cellXfs")
            for x in used if used is not None else ():
                k = int(x.get("numFmtId") or 0)
                self.dates.append(_is_date(codes[k]) if k in codes else k in DATE_FORMATS)

    def _elements(self, part: str, tag: str):
        """Elements of a part as they end; what has been read is dropped."""
        with self.zip.open(part) as f:
            stack = []
            for event, x in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    stack.append(x)
                    continue
                stack.pop()
                if x.tag == MAIN + tag:
                    yield x
                    stack[-1].remove(x)

    def rows(self, sheet: int = 0):
        """Cells of each row that has any: text, or None for a cell that is absent or empty."""
        for row in self._elements(self.sheets[sheet][1], "row"):
            cells: list[str | None] = []
            for c in row.iter(MAIN + "c"):
                at = column_number(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = self._text(c) or None
            if any(x is not None for x in cells):
                yield cells

    def _text(self, c) -> str | None:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            inner = c.find(MAIN + "is")
            return _texts(inner) if inner is not None else None
        value = c.findtext(MAIN + "v")
        if not value:
            return None
        if kind == "s":
            return self.strings[int(value)]
        if kind == "b":
            return "TRUE" if value.strip() == "1" else "FALSE"
        if kind == "n":
            style = int(c.get("s") or 0)
            return number_text(value, style < len(self.dates) and self.dates[style], self.calendar_1904)
        return unescape(value)  # str: a formula's text, e: an error, d: an ISO date


def _read(sheet: int):
    def run(batches):
        def out(path, at, rows):
            return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))],
                                              ["file", "line", "cells"])

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    book, rows, at = Book(content.as_py()), [], 0
                    for cells in book.rows(sheet):
                        rows.append(cells)
                        if len(rows) == BATCH:
                            yield out(path, at, rows)
                            at, rows = at + BATCH, []
                    yield out(path, at, rows)
                except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError) as e:
                    raise ValueError(f"not a readable workbook: {path}: {e!r}") from e
    return run


def workbook_rows(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """(file, line, cells): the rows of one sheet of each ``.xlsx`` file of a path, a file a task at least.

    Rows without a cell are left out; ``line`` counts the others from 0.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path)
    return found.select("path", "content").mapInArrow(_read(sheet), "file string, line long, cells array<string>")


# Fixed parts of a workbook; the header style is white bold Calibri 11 on 1F2937, centred.
_TYPES = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
          '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
          '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
          '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{sheets}</Types>')
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_LINKS = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
_LINK = '<Relationship Id="{id}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/>'
_BOOK = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
         'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>')
_STYLES = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
           '<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/><name val="Calibri"/></font></fonts>'
           '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
           '<fill><patternFill patternType="solid"><fgColor rgb="FF1F2937"/></patternFill></fill></fills>'
           '<borders count="1"><border><left/><right/><top/><bottom/><diagonal/></border></borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
           '<cellXfs count="2"><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/><xf numFmtId="0" fontId="1" fillId="2" borderId="0" xfId="0" applyAlignment="1">'
           '<alignment horizontal="center" vertical="center"/></xf></cellXfs></styleSheet>')
_SHEET = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cols>{cols}</cols><sheetData>')


class BookWriter:
    """One workbook, its rows in order of sheet and row."""

    def __init__(self, sheets: list[str], columns: list[str], widths: list[list[int]]):
        self.sheets, self.columns, self.widths = sheets, columns, widths
        self.letters = [column_letters(k) for k in range(len(columns))]
        self.bytes = io.BytesIO()
        self.zip = zipfile.ZipFile(self.bytes, "w", zipfile.ZIP_DEFLATED)
        self.zip.comment = b"\n"
        self.at, self.line, self.part = -1, 0, None
        n = range(1, len(sheets) + 1)
        self._whole("[Content_Types].xml", _TYPES.format(sheets="".join(_SHEET_TYPE.format(n=k) for k in n)))
        self._whole("_rels/.rels", _LINKS.format(links=_LINK.format(id="rId1", kind="officeDocument", target="xl/workbook.xml")))
        self._whole("xl/workbook.xml", _BOOK.format(sheets="".join(
            f'<sheet name="{escape(s).replace(chr(34), "&quot;")}" sheetId="{k}" r:id="rId{k}"/>' for k, s in zip(n, sheets, strict=True))))
        self._whole("xl/_rels/workbook.xml.rels", _LINKS.format(links="".join(_LINK.format(id=f"rId{k}", kind="worksheet", target=f"worksheets/sheet{k}.xml") for k in n)
                                                                + _LINK.format(id="rIdStyles", kind="styles", target="styles.xml")))
        self._whole("xl/styles.xml", _STYLES)

    def _whole(self, name: str, text: str) -> None:
        info = zipfile.ZipInfo(name)  # no clock: a repeated task writes the same bytes
        info.compress_type = zipfile.ZIP_DEFLATED
        self.zip.writestr(info, text)

    def _close_sheet(self) -> None:
        if self.part:
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()
            self.part = None

    def _open_until(self, sheet: int) -> None:
        while self.at < sheet:
            self._close_sheet()
            self.at += 1
            self.line = 0
            info = zipfile.ZipInfo(f"xl/worksheets/sheet{self.at + 1}.xml")
            info.compress_type = zipfile.ZIP_DEFLATED
            self.part = self.zip.open(info, "w", force_zip64=True)
            cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(self.widths[self.at], 1))
            self.part.write(_SHEET.format(cols=cols).encode())
            self.row(self.at, self.columns, 1)

    def row(self, sheet: int, cells: list[str | None], style: int = 0) -> None:
        self._open_until(sheet)
        self.line += 1
        shown = "".join(f'<c r="{a}{self.line}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>'
                        for a, x in zip(self.letters, cells, strict=True) if x is not None)
        self.part.write(f'<row r="{self.line}">{shown}</row>'.encode())

    def finish(self) -> bytes:
        """The book without its last byte, which is a line end."""
        self._open_until(len(self.sheets) - 1)
        self._close_sheet()
        self.zip.close()
        return self.bytes.getvalue()[:-1]


def _books(sheets: list[str], columns: list[str], widths: list[list[int]]):
    def run(batches):
        def out(book, writer):
            return pa.RecordBatch.from_arrays([pa.array([book], pa.int64()), pa.array([writer.finish()], pa.binary())], ["book", "content"])

        book, writer = None, None
        for batch in batches:
            for now, sheet, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now != book:
                    if writer:
                        yield out(book, writer)
                    book, writer = now, BookWriter(sheets, columns, widths)
                if cells is not None:
                    writer.row(sheet, cells)
        if writer:
            yield out(book, writer)
    return run


def write_workbooks(df: DataFrame, path: str, sheets: list[str], columns: list[str], order: list, sheet_col: str = "sheet",
                    name: str = "allocations", rows: int = ROWS) -> list[str]:
    """Write ``df`` as ``<path>/<name>-<book>.xlsx``; returns the file names in order.

    Every book has all ``sheets``, each with a header row and the next ``rows`` of its rows in ``order`` (which
    ends in a unique key). Null cells stay absent; a report without rows has one book of header rows. Names appear
    once all books are complete; a failed write leaves none.
    """
    spark = df.sparkSession
    cells = [F.col(f"`{c}`").cast("string") for c in columns]
    place = F.array_position(F.array(*map(F.lit, sheets)), F.col(sheet_col)).cast("int") - 1
    tagged = df.withColumns({"_sheet": place, "_cells": F.array(*cells)}).where("_sheet >= 0")
    # written by the rank, so the report is not computed again for the widths
    ranked = ordered_rank(tagged, order, {"_rank": ["_sheet"]})
    sizes = {r["_sheet"]: r for r in ranked.groupBy("_sheet").agg(*[F.max(F.length(F.col("_cells")[k])).alias(str(k)) for k in range(len(columns))]).collect()}  # a row a sheet
    widths = [[max(12, 3 + max(len(c), (sizes[s][str(k)] or 0) if s in sizes else 0)) for k, c in enumerate(columns)] for s in range(len(sheets))]
    dealt = ranked.select(F.floor(F.col("_rank") / rows).alias("book"), F.col("_sheet").alias("sheet"), F.col("_rank").alias("rank"), F.col("_cells").alias("cells"))
    first = spark.range(1).select(F.col("id").alias("book"), F.lit(-1).alias("sheet"), F.lit(-1).cast("long").alias("rank"), F.lit(None).cast("array<string>").alias("cells"))
    books = (dealt.unionByName(first).repartition("book").sortWithinPartitions("book", "sheet", "rank")
             .mapInArrow(_books(sheets, columns, widths), "book long, content binary"))
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    scratch = jvm.org.apache.hadoop.fs.Path(target, f"_books-{uuid.uuid4().hex}")  # beside the books: naming them moves no bytes
    try:
        books.select("book", F.col("content").cast("string").alias("value")).write.partitionBy("book").text(scratch.toString())  # a book is one row, so one file
        parts = {int(s.getPath().getParent().getName().split("=")[1]): s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(scratch, "book=*/part-*"))}
        names = {k: f"{name}-{k:05d}.xlsx" for k in sorted(parts)}
        for k, own in names.items():
            final = jvm.org.apache.hadoop.fs.Path(target, own)
            fs.delete(final, False)
            if not fs.rename(parts[k], final):
                raise OSError(f"cannot name {final.toString()}")
    finally:
        fs.delete(scratch, True)
    return list(names.values())
