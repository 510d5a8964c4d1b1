"""Sinks: delimited files, summaries, an audit table, reports."""

from __future__ import annotations

import io
import os
import shutil
import struct
import zipfile
import zlib
from datetime import UTC, datetime
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the office formats.
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEETS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
AUDIT = "query_id string, run_at string, phase string, source string, query_or_url string, parameters string, output_path string, status string, notes string"


def write_csv(df: DataFrame, path: str, fields: list[str], bom: bool = False, tab: bool = False) -> None:
    """SNK-01, SNK-02: a folder of files with the fields in order; lists joined, nulls empty. bom: the mark that spreadsheet programs look for, in the header's first name."""
    kinds = dict(df.dtypes)
    columns = [F.coalesce(F.array_join(c, " || ") if kinds[c].startswith("array") else F.col(c).cast("string"), F.lit("")).alias(c) for c in fields]
    out = df.select(*columns)
    if bom:
        out = out.withColumnRenamed(fields[0], "﻿" + fields[0])
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("sep", "\t" if tab else ",").csv(path)


def summary(df: DataFrame, metrics: dict) -> DataFrame:
    """SNK-03: counters of a table as one JSON row."""
    return df.agg(*[c.alias(n) for n, c in metrics.items()]).select(F.to_json(F.struct(*metrics)).alias("summary"))


def append_audit(spark: SparkSession, path: str, query_id: str, phase: str, source: str = "", query: str = "", parameters: str = "", output: str = "", status: str = "ok", notes: str = "") -> None:
    """SNK-04: one row; the table is made where there is none."""
    row = (query_id, datetime.now(UTC).isoformat(), phase, source, query, parameters, output, status, notes)
    spark.createDataFrame([row], AUDIT).coalesce(1).write.mode("append").parquet(path)


def copy_if_needed(source: str, target: str) -> bool:
    """SNK-07: copies a file that is missing or differs in size."""
    if os.path.exists(target) and os.path.getsize(target) == os.path.getsize(source):
        return False
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    shutil.copyfile(source, target)
    return True


def copy_between(spark: SparkSession, source: str, target: str) -> bool:
    """SNK-07 for paths of any file system: copies a file that is missing or differs in size."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    one, two = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    here, there = one.getFileSystem(conf), two.getFileSystem(conf)
    if there.exists(two) and there.getFileStatus(two).getLen() == here.getFileStatus(one).getLen():
        return False
    return jvm.org.apache.hadoop.fs.FileUtil.copy(here, one, there, two, False, conf)


def bar_chart(values: list[int], bar: int = 12, gap: int = 4, height: int = 200) -> bytes:
    """SNK-10: bars from the left, the highest as high as the image, as a grey PNG."""
    width, most = max(1, len(values) * (bar + gap)), max(1, *values, 1)
    tall = [v * height // most for v in values]
    rows = b"".join(b"\0" + b"".join((b"\x30" if height - y <= t else b"\xff") * bar + b"\xff" * gap for t in tall).ljust(width, b"\xff") for y in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def bar_heights(image: bytes, bar: int = 12, gap: int = 4) -> list[int]:
    """The heights of the bars of an image of bar_chart()."""
    width, height = struct.unpack(">II", image[16:24])
    size = struct.unpack(">I", image[33:37])[0]
    rows = zlib.decompress(image[41 : 41 + size])
    return [sum(rows[y * (width + 1) + 1 + x] == 0x30 for y in range(height)) for x in range(0, width, bar + gap)]


def report_rows(df: DataFrame, most_rows: int) -> list[tuple]:
    """Rows for people; tables beyond most_rows are refused."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report table has more than {most_rows} rows")
    return [tuple(r) for r in rows]


def _package(parts: dict[str, str]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)
    return held.getvalue()


def _relations(targets: dict[str, str]) -> str:
    rows = "".join(f'<Relationship Id="{k}" Type="{OFFICE}/{v.split("|")[0]}" Target="{v.split("|")[1]}"/>' for k, v in targets.items())
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def _types(parts: dict[str, str]) -> str:
    rows = "".join(f'<Override PartName="/{k}" ContentType="application/vnd.openxmlformats-officedocument.{v}+xml"/>' for k, v in parts.items())
    return f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{rows}</Types>'


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(tables: dict[str, DataFrame], most_rows: int = 100_000) -> bytes:
    """SNK-08, SNK-13: report tables as the sheets of a workbook, headers first."""
    names = [n[:31] for n in tables]
    sheets = {}
    for k, df in enumerate(tables.values(), 1):
        rows = [tuple(df.columns), *report_rows(df, most_rows)]
        body = "".join("<row>" + "".join(map(_cell, r)) + "</row>" for r in rows)
        sheets[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{SHEETS}"><sheetData>{body}</sheetData></worksheet>'
    listed = "".join(f"<sheet name={quoteattr(n)} sheetId=\"{k}\" r:id=\"rId{k}\"/>" for k, n in enumerate(names, 1))
    return _package(
        {
            "[Content_Types].xml": _types({"xl/workbook.xml": "spreadsheetml.sheet.main"} | dict.fromkeys(sheets, "spreadsheetml.worksheet")),
            "_rels/.rels": _relations({"rId1": "officeDocument|xl/workbook.xml"}),
            "xl/workbook.xml": f'<workbook xmlns="{SHEETS}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": _relations({f"rId{k}": f"worksheet|worksheets/sheet{k}.xml" for k in range(1, len(names) + 1)}),
            **sheets,
        }
    )


def sheet_rows(book: bytes) -> list[tuple[str, int, list[str | None]]]:
    """Sheet, row number and cells, as text, of a workbook of workbook()."""
    out = []
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        names = [x.get("name") for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{SHEETS}}}sheet")]
        for k, name in enumerate(names, 1):
            for n, row in enumerate(ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{{{SHEETS}}}row")):
                out.append((name, n, ["".join(c.itertext()) if len(c) else None for c in row]))
    return out


def markdown(title: str, metrics: dict[str, object], tables: dict[str, DataFrame], most_rows: int = 1000) -> str:
    """SNK-12: a report with its metrics as a list and its tables under headings."""
    said = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", *(f"- {k}: {said(v)}" for k, v in metrics.items()), ""]
    for name, df in tables.items():
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join(map(said, r)) + " |" for r in report_rows(df, most_rows)]
        lines.append("")
    return "\n".join(lines)


def document(title: str, paragraphs: list[str]) -> bytes:
    """SNK-11: a word processor's file with a heading and paragraphs."""
    text = lambda x, style="": f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>'
    body = text(title, '<w:pPr><w:outlineLvl w:val="0"/></w:pPr>') + "".join(map(text, paragraphs))
    return _package(
        {
            "[Content_Types].xml": _types({"word/document.xml": "wordprocessingml.document.main"}),
            "_rels/.rels": _relations({"rId1": "officeDocument|word/document.xml"}),
            "word/document.xml": f'<w:document xmlns:w="{WORDS}"><w:body>{body}</w:body></w:document>',
        }
    )


def document_paragraphs(file: bytes) -> list[str]:
    """The paragraphs of a file of document(), heading first."""
    with zipfile.ZipFile(io.BytesIO(file)) as z:
        return ["".join(p.itertext()) for p in ElementTree.fromstring(z.read("word/document.xml")).iter(f"{{{WORDS}}}p")]
