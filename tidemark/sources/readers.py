"""Readers: tables, partitions, drifting files, broken JSON lines, HTML lists."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import by_row


def read_table(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Parquet, CSV, ORC or JSON by suffix."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("parquet", "csv", "orc", "json"):
        raise ValueError(f"unsupported format: {kind}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).csv(path) if kind == "csv" else getattr(reader, kind)(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Date, ticker as text, numbers as doubles; contracts are in ``operators.stats``."""
    df = read_table(spark, path)
    return df.withColumns({"date": F.to_date("date"), "ticker": F.col("ticker").cast("string")} | {c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume") if c in df.columns})


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """S3: one row per date, NaN as null."""
    df = read_table(spark, path)
    return df.select(F.to_date("date").alias("date"), *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in df.columns if c != "date"])


def read_months(spark: SparkSession, root: str, months: list[tuple[int, int]] | None = None, year: str = "year", month: str = "month") -> DataFrame:
    """Partitions of the months, by pruning; no month given reads all, no match gives no rows."""
    df = spark.read.parquet(root)
    if months is None:
        return df
    wanted = F.lit(False)
    for y, m in months:
        wanted = wanted | ((F.col(year).try_cast("int") == y) & (F.col(month).try_cast("int") == m))
    return df.where(wanted)


def in_window(df: DataFrame, column: str, start: str, end: str, lookback_days: int = 0) -> DataFrame:
    """Rows of an inclusive window, dashes or not in either."""
    plain = lambda c: F.try_to_date(F.replace(c, F.lit("-"), F.lit("")), "yyyyMMdd")
    return df.where(plain(F.col(column)).between(F.date_sub(plain(F.lit(start)), lookback_days), plain(F.lit(end))))


def read_drifting(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files whose schemas disagree, all columns as text, united by name. Paths are grouped by
    footer schema, so there is one scan per schema; unreadable files are skipped."""
    groups: dict[str, list[str]] = {}
    for p in paths:
        try:
            groups.setdefault(spark.read.parquet(p).schema.simpleString(), []).append(p)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "FAILED_READ_FILE" not in str(e) and "CANNOT_READ_FILE_FOOTER" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    out = None
    for same in groups.values():
        df = spark.read.parquet(*same)
        df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def first_readable(spark: SparkSession, paths: list[tuple[str, str]], columns: list[str] | None = None, prefix: tuple[str, str] | None = None) -> DataFrame | None:
    """The first (format, path) that can be read, pruned to columns and to a date prefix; dots in
    dates become dashes."""
    for kind, path in paths:
        try:
            df = spark.read.format(kind).load(path)
        except Exception as e:  # noqa: BLE001
            if "DATA_SOURCE_NOT_FOUND" not in str(e) and "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            continue
        if prefix:
            df = df.where(F.startswith(F.replace(F.col(prefix[0]).cast("string"), F.lit("."), F.lit("-")), F.lit(prefix[1])))
        return df.select(*[c for c in columns if c in df.columns]) if columns else df
    return None


def read_registry(df: DataFrame) -> DataFrame:
    """Filings once per receipt number, the latest version preferred, then the order of ids."""
    from ..operators.merge import latest, truthy

    return latest(df, ["rcept_no"], [truthy(F.col("is_latest")).desc(), F.col("rcept_dt").desc(), F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)]), *[F.col(c).cast("string") for c in sorted(df.columns)]])


def read_reports(spark: SparkSession, root: str, schema: str | StructType | None = None) -> DataFrame:
    """One JSON object per file, with its key, without inputs, private and edited files."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("multiLine", True).option("recursiveFileLookup", True).json(root).withColumn("source_key", F.input_file_name())
    name = F.element_at(F.split("source_key", "/"), -1)
    return df.where(~F.contains(F.col("source_key"), F.lit("embedding_input")) & ~F.startswith(name, F.lit("_")) & ~F.rlike(name, F.lit(r"_(수정|%EC%88%98%EC%A0%95)\.json$")))


_MARKS = re.compile(r'\\.|["{}\[\]]', re.DOTALL)


def _parsed(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except ValueError:
        return None


def joined_lines(text: str | None) -> list[tuple[int, str | None, str | None]]:
    """S16 on one text: (line, record, error). Lines are joined until brackets and quotes are closed and the
    whole parses. What stays open to the end of the text is an error from its first line to the next line
    that parses by itself, where reading goes on; so nothing is left out."""
    lines = (text or "").splitlines()
    out: list[tuple[int, str | None, str | None]] = []
    at = 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        depth, quoted, held = 0, False, []
        for i in range(at, len(lines)):
            held.append(lines[i] if held else lines[i].lstrip())
            for mark in _MARKS.findall(lines[i]):
                if mark == '"':
                    quoted = not quoted
                elif not quoted and len(mark) == 1:
                    depth += 1 if mark in "{[" else -1
            if depth <= 0 and not quoted and (record := _parsed("".join(held))) is not None:
                out.append((at + 1, record, None))
                at = i + 1
                break
        else:
            end = next((i for i in range(at + 1, len(lines)) if lines[i].lstrip()[:1] in ("{", "[") and _parsed(lines[i]) is not None), len(lines))
            out.append((at + 1, None, "\n".join(lines[at:end])))
            at = end
    return out


def read_broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, record, error) of JSON files in which line breaks cut records; each file is read by
    one task, and a row has either a record or the text that never parses."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                rows = joined_lines(text)
                columns = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], ["file", "line", "record", "error"])

    return whole.mapInArrow(run, "file string, line long, record string, error string")


def matched_output(records: DataFrame, manifest: DataFrame, key: str = "recordId") -> tuple[DataFrame, DataFrame]:
    """Batch output with its manifest rows, and one row (records, errors, matched, unknown) of counts."""
    named = records.withColumn(key, F.get_json_object("record", f"$.{key}"))
    joined = named.join(manifest.withColumn("_known", F.lit(True)), key, "left")
    counts = joined.agg(F.count("record").alias("records"), F.count("error").alias("errors"), F.count_if(F.col("_known")).alias("matched"), F.count_if(F.col("record").isNotNull() & F.col("_known").isNull()).alias("unknown"))
    return joined.where("_known").drop("_known", "error"), counts


class _Rows(HTMLParser):
    """Cells of table rows, or items of lists, with the first link of each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[list[str], str | None]] = []
        self.cells: list[str] | None = None
        self.link: str | None = None
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("tr", "li"):
            self.close_row()
            self.cells, self.link = ([""] if tag == "li" else []), None
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
        elif tag == "a" and self.cells is not None and self.link is None:
            self.link = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("tr", "li", "table", "ul", "ol"):
            self.close_row()

    def handle_data(self, data):
        if self.cells and not self.skip:
            self.cells[-1] += data

    def close_row(self):
        if self.cells and any(c.strip() for c in self.cells):
            self.rows.append(([" ".join(c.split()) for c in self.cells], self.link))
        self.cells = None


def html_rows(html: Column) -> Column:
    """Array of (cells, link) of a page's table rows and list items."""

    def parse(s):
        p = _Rows()
        p.feed(s or "")
        p.close()
        p.close_row()
        return [{"cells": cells, "link": link} for cells, link in p.rows]

    kind = pa.list_(pa.struct([("cells", pa.list_(pa.string())), ("link", pa.string())]))
    return by_row(parse, kind, "array<struct<cells:array<string>,link:string>>")(html)


def needs_ocr(pages: Column, text_pages: Column, chars: Column) -> Column:
    """S18."""
    return (pages == 0) | (text_pages == 0) | ((text_pages / F.nullif(pages, F.lit(0)) < 0.3) & (chars < 200))


def read_corp_codes(spark: SparkSession, path: str) -> DataFrame:
    """Company records of an XML list."""
    schema = "corp_code string, corp_name string, corp_eng_name string, stock_code string, modify_date string"
    df = spark.read.format("xml").option("rowTag", "list").option("ignoreSurroundingSpaces", True).schema(schema).load(path)
    return df.withColumn("stock_code", F.nullif(F.trim("stock_code"), F.lit("")))


def read_csv_any(spark: SparkSession, path: str, columns: list[str], encodings: tuple[str, ...] = ("utf-8", "cp949", "euc-kr")) -> DataFrame:
    """Headerless CSV; the first encoding under which no value holds a replacement character, else the
    last. Bytes are read as they are, since the delimiters are the same in all of them, and decoded after."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("encoding", "iso-8859-1").csv(path)

    def decoded(encoding: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = [[None if x is None else x.encode("latin-1").decode(encoding, "replace") for x in c.to_pylist()] for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in values], columns)

        return raw.mapInArrow(run, raw.schema)

    for encoding in encodings:
        df = decoded(encoding)
        broken = reduce(lambda a, b: a | b, [F.contains(F.coalesce(F.col(c), F.lit("")), F.lit("\ufffd")) for c in columns])
        if df.where(broken).limit(1).isEmpty():
            break
    return df.withColumn(columns[0], F.replace(F.col(columns[0]), F.lit("\ufeff"), F.lit("")))


def listed_reports(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of an API list within the dates, once per file, with a report id and a code."""
    from ..operators.merge import latest

    kept = latest(in_window(df, "date", start, end), ["file_id"], [F.desc("date"), F.col("title")])
    return kept.withColumns({"report_id": F.md5(F.concat_ws("_", "broker", "date", "file_id")), "code": F.coalesce(F.nullif("code", F.lit("")), F.lit("000000"))})
