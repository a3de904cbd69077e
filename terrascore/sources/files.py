"""Readers for delimited, columnar, sheet and text files.

All readers are lazy and take folders or globs, so a source that is one file on a
laptop can be a folder of thousands on a cluster.
"""

from __future__ import annotations

import csv
import logging
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrascore.functions.cleaning import clean_area_code, strip
from terrascore.functions.labels import link_city, link_name, link_texts
from terrascore.session import settings, stage

logger = logging.getLogger(__name__)

# Fixed value: a commune code (five characters) or a grouping code (nine digits).
AREA_CODE = r"^([0-9][0-9AB][0-9]{3}|[0-9]{9})$"
CORRUPT = "_corrupt_record"


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def read_delimited(
    spark: SparkSession,
    path,
    sep: str = ",",
    header: bool = True,
    schema: T.StructType | str | None = None,
    encoding: str = "UTF-8",
    multi_line: bool = False,
    infer: bool = False,
) -> DataFrame:
    """Delimited scan. Without ``schema`` all columns are text unless ``infer``.

    ``infer`` costs a second pass over the files; give a schema for large data.
    ``multi_line`` allows line breaks inside quotes but makes files unsplittable.
    """
    reader = spark.read.options(
        sep=sep, header=header, encoding=encoding, quote='"', escape='"', multiLine=multi_line, inferSchema=infer
    )
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def _schema_of(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _checked_text(spark, path, schema: T.StructType, mode: str, sep: str, header: bool, encoding: str):
    """All fields as text, and the test that a line fits the schema.

    The test names every column, so the outcome for a line does not depend on
    the columns a query happens to use; pruned CSV scans would not check the rest.
    """
    fields = [T.StructField(f.name, T.StringType()) for f in schema.fields]
    if mode == "PERMISSIVE":
        fields.append(T.StructField(CORRUPT, T.StringType()))
    raw = (
        spark.read.schema(T.StructType(fields))
        .options(
            sep=sep, header=header, encoding=encoding, quote='"', escape='"', mode=mode,
            columnNameOfCorruptRecord=CORRUPT, columnPruning=False,
        )
        .csv(path)
    )
    fits = F.lit(True)
    for field in schema.fields:
        text = F.col(f"`{field.name}`")
        fits = fits & (text.isNull() | text.try_cast(field.dataType).isNotNull())
    return raw, fits


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_tolerant(
    spark: SparkSession, path, schema: T.StructType | str, sep: str = ",", header: bool = True, encoding: str = "UTF-8"
) -> DataFrame:
    """Delimited scan that skips the lines which do not fit the schema."""
    schema = _schema_of(schema)
    raw, fits = _checked_text(spark, path, schema, "DROPMALFORMED", sep, header, encoding)
    return _typed(raw.where(fits), schema)


def read_with_quarantine(
    spark: SparkSession, path, schema: T.StructType | str, sep: str = ",", header: bool = True, encoding: str = "UTF-8"
) -> tuple[DataFrame, DataFrame]:
    """(fitting rows, rejected lines): rejects keep their fields as text.

    A line with a wrong number of fields is also given whole in ``_corrupt_record``.
    """
    schema = _schema_of(schema)
    raw, fits = _checked_text(spark, path, schema, "PERMISSIVE", sep, header, encoding)
    accepted = fits & F.col(CORRUPT).isNull()
    return _typed(raw.where(accepted), schema), raw.where(~accepted)


def read_after_preamble(
    spark: SparkSession,
    path,
    columns: Sequence[str],
    sep: str = ",",
    key: str | None = None,
    key_pattern: str = AREA_CODE,
    encoding: str = "UTF-8",
) -> DataFrame:
    """Delimited files whose header comes after some lines of free text.

    Data rows are those whose key column holds a code, after the usual repairs (blanks,
    a lost leading zero, a trailing ``.0``). That needs no line order, so it works on any
    number of files split over any number of tasks. What is dropped is in
    ``read_after_preamble_with_rejects``.
    """
    return read_after_preamble_with_rejects(spark, path, columns, sep, key, key_pattern, encoding)[0]


def read_after_preamble_with_rejects(
    spark: SparkSession,
    path,
    columns: Sequence[str],
    sep: str = ",",
    key: str | None = None,
    key_pattern: str = AREA_CODE,
    encoding: str = "UTF-8",
) -> tuple[DataFrame, DataFrame]:
    """(data rows with repaired codes, rejected rows).

    Neither data nor rejected are header lines (all filled cells are column names) and
    free text (a line with at most one filled cell). A row of several cells whose code can't be repaired is rejected, with its cells as they stand.
    """
    key = key or columns[0]
    rows = read_delimited(spark, path, sep=sep, header=False, schema=text_schema(columns), encoding=encoding)
    given = F.col(f"`{key}`")
    code = F.coalesce(F.when(strip(given).rlike(key_pattern), strip(given)), clean_area_code(given))
    fits = F.coalesce(code.rlike(key_pattern), F.lit(False))
    cells = F.array(*[F.col(f"`{c}`") for c in columns])
    filled = F.filter(cells, lambda c: F.trim(c) != "")
    header = F.forall(filled, lambda c: F.trim(c).isin(*columns))
    data = rows.where(fits).withColumn(key, code)
    return data, rows.where(~fits & ~header & (F.size(filled) > 1))


def leading_lines(spark: SparkSession, path, count: int, encoding: str = "UTF-8", name_glob: str | None = None) -> DataFrame:
    """The first ``count`` lines of every file: ``file, number`` (from 0)``, value``, staged.

    One job however many files there are: a file is one task, which reads its first lines and no more.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            part = batch.slice(0, count - done)
            numbers = pa.array(range(done, done + part.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), numbers, part.column(1)], ["file", "number", "value"])
            done += part.num_rows
            if done == count:
                return

    reader = spark.read.option("encoding", encoding)
    lines = (reader.option("pathGlobFilter", name_glob) if name_glob else reader).text(path)
    named = lines.select("_metadata.file_path", F.ltrim("value", F.lit("\ufeff")).alias("value"))
    whole = 1 << 50  # no file is as large: none is cut, and no two share a task
    with settings(spark, {
        "spark.sql.files.maxPartitionBytes": whole, "spark.sql.files.openCostInBytes": whole,
        "spark.sql.execution.arrow.maxRecordsPerBatch": count,
    }):
        return stage(named.mapInArrow(first, "file string, number int, value string"), "heads")


def _by_header(heads: DataFrame, number: int) -> tuple[list[str], str | None]:
    """The different lines of this number, and a file that has none; few lines, as files share their shape."""
    headers = heads.groupBy("file").agg(F.max(F.when(F.col("number") == number, F.col("value"))).alias("header"))
    found = headers.groupBy("header").agg(F.min("file").alias("file")).collect()
    return sorted(r["header"] for r in found if r["header"] is not None), next((r["file"] for r in found if r["header"] is None), None)


def _files_with(heads: DataFrame, number: int, header: str, path, alone: bool):
    """The path itself if all its files have this header, else those that do: no more names than the scan's own list of files."""
    if alone:
        return path
    rows = heads.where((F.col("number") == number) & (F.col("value") == header)).select("file").collect()
    return sorted(unquote(r["file"]) for r in rows)


def _names(line: str, sep: str) -> tuple[str, ...]:
    names = next(csv.reader([line], delimiter=sep), [])
    return tuple(name.strip() or f"_c{i}" for i, name in enumerate(names))


def read_after_header_line(
    spark: SparkSession, path: str, skip: int, sep: str = ",", encoding: str = "UTF-8", order: str | None = None
) -> DataFrame:
    """Delimited files, each with its header after ``skip`` lines of free text of its own.

    The leading lines of all files are read in one job to learn their headers. The scan leaves
    out lines of a file's first block that equal one of that file's leading lines: one join on file and line,
    however many files there are, and no line order is needed. Files may have their columns in different orders.
    A record is one line. Files without any line have no rows. ``order`` names a column for the place of the line: its
    file, and a number that grows within it.
    """
    heads = leading_lines(spark, path, skip + 1, encoding)
    headers, short = _by_header(heads, skip)
    if short is not None or not headers:
        raise ValueError(f"{short or path}: no header after {skip} lines")
    leading = heads.select(F.col("file").alias("_of"), F.col("value").alias("_leading"))
    frames = []
    for header in headers:
        files = _files_with(heads, skip, header, path, len(headers) == 1)
        lines = spark.read.option("encoding", encoding).text(files).where(F.length("value") > 0).select(
            "value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_place"),
            F.when(F.col("_metadata.file_block_start") == 0, F.ltrim("value", F.lit("\ufeff"))).alias("_early"))
        lines = lines.join(leading, (F.col("_file") == F.col("_of")) & (F.col("_early") == F.col("_leading")), "left_anti")
        parsed = F.from_csv("value", text_schema(_names(header, sep)).toDDL(), {"sep": sep, "quote": '"', "escape": '"'})
        place = [F.struct("_file", "_place").alias(order)] if order else []
        frames.append(lines.select(parsed.alias("_line"), *place).select("_line.*", *([order] if order else [])))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_columnar(spark: SparkSession, path, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_folder(
    spark: SparkSession,
    folder: str,
    name_glob: str,
    columns: Sequence[str],
    where: Column | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> DataFrame:
    """All files of a folder whose names match, filtered and projected in the scan.

    Files may have their columns in different orders: each is read by its own header, which one job learns for all
    of them, and files of one header are one scan. A file without one of ``columns`` is an error.
    ``multi_line`` allows line breaks inside quotes but makes a file one task.
    """
    heads = leading_lines(spark, folder, 1, encoding, name_glob)
    headers, _ = _by_header(heads, 0)
    if not headers:
        raise ValueError(f"{folder}: no file with a header matches {name_glob}")
    frames = []
    for header in headers:
        names = _names(header, sep)
        lacking = [c for c in columns if c not in names]
        if lacking:
            raise ValueError(f"{folder}: no column {lacking} in a file that starts with {header!r}")
        files = _files_with(heads, 0, header, folder, len(headers) == 1)
        reader = spark.read.option("pathGlobFilter", name_glob).schema(text_schema(names)).options(
            sep=sep, header=True, encoding=encoding, quote='"', escape='"', multiLine=multi_line)
        df = reader.csv(files)
        frames.append((df if where is None else df.where(where)).select(*columns))
    return reduce(DataFrame.unionByName, frames)


def load_sheets(spark: SparkSession, folder: str, names: Iterable[str], sep: str = ",") -> dict[str, DataFrame]:
    """One text-typed frame per exported sheet ``<folder>/<name>.csv``.

    A missing sheet is reported and left out, as with an optional workbook tab. Cells
    may hold line breaks; a sheet is therefore one task, which its size allows.
    """
    sheets: dict[str, DataFrame] = {}
    for name in names:
        try:
            sheets[name] = read_delimited(spark, f"{folder}/{name}.csv", sep=sep, multi_line=True)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            logger.warning("sheet %s not found, skipped", name)
    return sheets


def read_link_entities(spark: SparkSession, path, href: str = "#") -> DataFrame:
    """(nom_media, ville) for every link of the text files, line by line."""
    return link_entities(spark.read.text(path), "value", href)


def link_entities(lines: DataFrame, text: str, href: str = "#", keep: Sequence[str] = ()) -> DataFrame:
    links = lines.select(*keep, F.explode(link_texts(text, href)).alias("_link"))
    return links.select(*keep, link_name("_link").alias("nom_media"), link_city("_link").alias("ville"))
