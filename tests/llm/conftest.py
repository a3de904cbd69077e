import pathlib

import pytest

SF = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    if not SF.exists():
        pytest.skip("driver tables not found")
    return str(SF)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]) tuples, with the columns of the driver's table."""

    def make(*rows, extra=""):
        full = [(*r, *(None, None)[: 4 - len(r)])[:4] if len(r) < 4 else r for r in rows]
        full = [(*r[:4], None if r[1] is None else len(r[1])) for r in full]
        frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        for name in extra.split():
            frame = frame.selectExpr("*", f"'x' as `{name}`")
        return frame

    return make


@pytest.fixture(scope="session")
def frame(spark, tmp_path_factory):
    """Save a frame as a driver table in a folder of its own; the folder's path."""

    def save(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.coalesce(2).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return save
