"""A stored index for the search box: which areas hold which runs of characters.

Every area is posted under each run of two and three characters of its name and code,
in lower case, and under the empty one. A posting carries the code and the name, so a
search reads the postings of one run, the rarest of those in its text, and tests them
as a scan of all areas would: no join, no shuffle. Postings lie in folders by
a checksum of the run, which the driver knows as well, and are sorted by it: one folder is listed, and few row groups are read.
"""

from __future__ import annotations

import re
from zlib import crc32

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.operators.filters import find_one, suggest

FOLDERS = 64
POSTINGS, COUNTS = "code string, name string, gram string", "gram string, n long"
#: What splits a search text: wildcards, and letters whose lower case may differ between engines.
_BETWEEN = re.compile(r"[%_]|[^\x00-\x7f]")


def _grams(value: Column, size: int) -> Column:
    starts = F.when(F.char_length(value) >= size, F.sequence(F.lit(1), F.char_length(value) - (size - 1)))
    found = F.transform(starts, lambda i: F.substring(value, i, F.lit(size)))
    return F.coalesce(found, F.array().cast("array<string>"))


def write_search_index(areas: DataFrame, path: str, code: str, name: str) -> None:
    """Store the postings of ``areas`` and how many each run has below ``path``, which must be new.

    Rows that are equal are posted as often as they occur; a null name or code has no runs.
    A common run's postings are written by as many tasks as their size asks for.
    """
    spark = areas.sparkSession
    named = areas.select(F.col(f"`{code}`").cast("string").alias("code"), F.col(f"`{name}`").cast("string").alias("name"))
    lower = named.withColumns({"lower_code": F.lower("code"), "lower_name": F.lower("name")})
    texts = [F.col("lower_code"), F.col("lower_name")]
    runs = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(t, size) for t in texts for size in (2, 3)]))
    postings = lower.select("code", "name", F.explode(runs).alias("gram"))
    placed = postings.withColumn("folder", F.crc32(F.encode("gram", "UTF-8")) % FOLDERS).hint("rebalance", "folder")
    placed.sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{path}/postings")
    counts = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.orderBy("gram").write.parquet(f"{path}/counts")


def runs_of(text: str) -> list[str]:
    """Runs of characters that whatever contains ``text`` has: of three where it gives any, else of two."""
    pieces = [piece.lower() for piece in _BETWEEN.split(text)]
    for size in (3, 2):
        found = sorted({p[i : i + size] for p in pieces for i in range(len(p) - size + 1)})
        if found:
            return found
    return []


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame:
    """``code, name`` of all areas that may contain the text: those of its rarest run; all, if it has no run."""
    runs = runs_of(text)
    rarest = ""
    if runs:
        counts = spark.read.schema(COUNTS).parquet(f"{path}/counts").where(F.col("gram").isin(runs))
        n = {r["gram"]: r["n"] for r in counts.collect()}  # a row for each run of the text, at most
        rarest = min(runs, key=lambda run: (n.get(run, 0), run))
    try:
        folder = spark.read.schema(POSTINGS).parquet(f"{path}/postings/folder={crc32(rarest.encode()) % FOLDERS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "code string, name string")  # no area has a run of this folder
    return folder.where(F.col("gram") == rarest).select("code", "name")


def suggest_indexed(spark: SparkSession, path: str, text: str, limit: int = 8, min_length: int = 2) -> DataFrame:
    """``operators.filters.suggest`` over the stored index."""
    return suggest(candidates(spark, path, text), text, "code", "name", limit, min_length)


def find_one_indexed(spark: SparkSession, path: str, text: str) -> DataFrame:
    """``operators.filters.find_one`` over the stored index."""
    return find_one(candidates(spark, path, text), text, "code", "name")
