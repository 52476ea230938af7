"""The three raw files: a strict, lossless CSV source, and constraints that name what breaks them."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..runtime import cut, ship

# The files, their columns, and the column that identifies a row.
VARIANTS = ("variant_id", "name", "design_date", "region", "seats", "bike_spaces", "traction")
BOM = ("line_id", "variant_id", "sub_assembly_ref", "sub_assembly_designation", "component_ref", "designation", "quantity", "unit", "supplier", "unit_cost_eur")
NOTES = ("note_id", "variant_id", "date", "text")
FILES = {"variants.csv": VARIANTS, "bom.csv": BOM, "notes.csv": NOTES}


class IngestError(ValueError):
    """A raw file can't be read as what it must be."""


@dataclass(frozen=True)
class Raw:
    """The raw tables: all columns strings, and row_number from 1, header excluded."""

    variants: DataFrame
    bom: DataFrame
    notes: DataFrame


def schema_of(columns: tuple[str, ...]) -> StructType:
    return StructType([*[StructField(c, StringType(), False) for c in columns], StructField("row_number", LongType(), False)])


def parse(content: bytes, columns: tuple[str, ...]) -> list[list[str]]:
    """The records of a ``;`` file under its header, cells as they are; ValueError says what is wrong with it.

    The header is exactly ``columns``, every record has as many cells, and quoting is strict. A record
    may span lines.
    """
    csv.field_size_limit(sys.maxsize)
    try:
        records = [*csv.reader(io.StringIO(content.decode("utf-8"), newline=""), delimiter=";", strict=True)]
    except UnicodeDecodeError as problem:
        raise ValueError(f"can't be read as UTF-8 at byte {problem.start}") from None
    except csv.Error as problem:
        raise ValueError(f"can't be read as CSV: {problem}") from None
    if records[:1] != [list(columns)]:
        raise ValueError(f"has the header {records[0] if records else None} in place of {list(columns)}")
    odd = [(k, len(cells)) for k, cells in enumerate(records) if len(cells) != len(columns)]
    if odd:
        raise ValueError(f"has {odd[0][1]} cells in row {odd[0][0]} in place of {len(columns)}")
    return records[1:]


def records_of(files: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows of files given as (path, content), with their numbers in the file; several files are parsed at once."""
    names = [*columns, "row_number"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    records = parse(content, columns)
                except ValueError as problem:
                    raise IngestError(f"{place.rpartition('/')[2]}: {problem}") from None
                for low in range(0, len(records), 10_000):
                    part = records[low : low + 10_000]
                    cells = [pa.array(c, pa.string()) for c in zip(*part, strict=True)]
                    yield pa.RecordBatch.from_arrays([*cells, pa.array(range(low + 1, low + 1 + len(part)), pa.int64())], names)

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(rows, schema_of(columns))


def read_csv(spark: SparkSession, path: str | Path, columns: tuple[str, ...]) -> DataFrame:
    """The rows of one file, or of all files of a folder, wherever Spark reads from.

    Since records may span lines, a file is parsed by one task.
    """
    return records_of(spark.read.format("binaryFile").load(str(path)), columns)


def repeated(df: DataFrame, column: str) -> DataFrame:
    """(value, n, first, last): identifiers, exactly as written, that stand in several rows, and the numbers of the outermost."""
    found = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("first"), F.max("row_number").alias("last"))
    return found.where("n > 1")


def check_unique(df: DataFrame, column: str, file: str) -> None:
    """Raises if an identifier stands in two rows."""
    twice = repeated(df, column).orderBy("first").first()
    if twice:
        raise IngestError(f"{file}: {column} {twice['value']!r} stands in rows {twice['first']} and {twice['last']}")


def read_raw(spark: SparkSession, raw_dir: str | Path) -> Raw:
    """The raw directory as tables; every constraint is checked before anything is returned."""
    tables = {}
    for file, columns in FILES.items():
        try:
            tables[file] = cut(read_csv(spark, f"{raw_dir}/{file}", columns))
        except PySparkException as problem:
            said = next((x.split("IngestError:", 1)[1].strip() for x in str(problem).splitlines() if "IngestError:" in x), None)
            if said is None and "PATH_NOT_FOUND" not in str(problem):
                raise
            raise IngestError(said or f"{file}: there is none in {raw_dir}") from None
        check_unique(tables[file], columns[0], file)
    return Raw(*tables.values())


def write_csv(path: str | Path, columns: tuple[str, ...], rows: Iterator[tuple]) -> None:
    """One ``;`` file with minimal quoting, rows in the order given."""
    with open(path, "w", encoding="utf-8", newline="") as handle:
        out = csv.writer(handle, delimiter=";", lineterminator="\n")
        out.writerow(columns)
        out.writerows(rows)
