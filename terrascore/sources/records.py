"""Nested JSON: result pages of any shapes, records with fallbacks, GeoJSON features of files that are split."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrascore.functions.cleaning import first_non_empty
from terrascore.session import scratch_path, stage


def read_pages(
    spark: SparkSession, path, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """Landed result pages: one JSON document per file, or per line if not ``multi_line``.

    Documents on single lines can be split over tasks; whole-file ones cannot.
    """
    reader = spark.read.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    found: list[tuple[str, ...]] = []
    for field in schema.fields:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType):
            found.extend(_leaves(field.dataType, here))
        else:
            found.append(here)
    return found


def flatten(df: DataFrame) -> DataFrame:
    """Nested fields become top-level columns with dotted names; arrays stay."""
    return df.select(
        *[F.col(".".join(f"`{part}`" for part in leaf)).alias(".".join(leaf)) for leaf in _leaves(df.schema)]
    )


def explode_results(pages: DataFrame, results: str = "results") -> DataFrame:
    """One flat row per record of every page."""
    return flatten(pages.select(F.explode(results).alias("_r")).select("_r.*"))


def _settled(found: T.DataType) -> str:
    """The type that records of several shapes are read with: fractions are doubles, what has no one shape is text."""
    if isinstance(found, T.StructType):
        fields = [f"`{f.name.replace('`', '``')}`: {_settled(f.dataType)}" for f in found.fields]
        return f"struct<{', '.join(fields)}>"
    if isinstance(found, T.ArrayType):
        return f"array<{_settled(found.elementType)}>"
    if isinstance(found, T.DecimalType) and found.scale:
        return "double"
    return "string" if isinstance(found, (T.NullType, T.VariantType)) else found.simpleString()


def read_results(
    spark: SparkSession, path, schema: T.StructType | str | None = None, results: str = "results", multi_line: bool = True
) -> DataFrame:
    """One flat row per record of all landed pages, whatever shapes the pages have.

    With a ``schema`` of the pages nothing is inferred. Without one every file is still read and parsed only once: the
    records are staged as variants, and the same job finds the schema that unites them. A field that some records
    lack is null there; one whose values have no common type is text (objects as JSON). A page without records, or
    with null for them, gives no row; pages without any record give a frame without columns. A file that is no
    JSON is an error, as is a record that is no object.
    """
    if schema is not None:
        return explode_results(read_pages(spark, path, schema, multi_line), results)
    pages = spark.read.options(multiLine=multi_line, singleVariantColumn="page", mode="FAILFAST").json(path)
    key = results.replace("\\", "\\\\").replace('"', '\\"')
    records = F.variant_get("page", f'$["{key}"]', "array<variant>")
    seen = Observation()
    found = pages.select(F.explode(records).alias("record")).observe(
        seen, F.expr("schema_of_variant_agg(record)").alias("schema")
    )
    folder = scratch_path(spark, "records")
    found.write.parquet(folder)
    text = seen.get["schema"]
    if text == "VOID":
        return spark.createDataFrame([], T.StructType([]))
    # objects are structs, except where a quoted field has such a name
    united = T.DataType.fromDDL(re.sub(r"(`(?:[^`]|``)*`)|OBJECT<", lambda m: m[1] or "STRUCT<", text))
    if not isinstance(united, T.StructType):
        raise ValueError(f"{path}: records of {results!r} are no objects but {text}")
    staged = spark.read.schema("record variant").parquet(folder)
    return flatten(staged.select(F.variant_get("record", "$", _settled(united)).alias("_r")).select("_r.*"))


def extract_records(
    records: DataFrame,
    indicator_id: str,
    year: int,
    id_columns=("id_epci", "siren"),
    value_column: str = "value",
    default_source: str | None = None,
) -> DataFrame:
    """Indicator values out of API records.

    The id is the first non-empty of ``id_columns``; records without id or value
    are skipped; a record without a source gets ``default_source``.
    """
    present = set(records.columns)
    ids = [c for c in id_columns if c in present]
    source = F.col("source") if "source" in present else F.lit(None).cast("string")
    unit = F.col("unit") if "unit" in present else F.lit(None).cast("string")
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns]), {"ignoreNullFields": "false"})
    return (
        records.select(
            first_non_empty(ids).alias("id_epci"),
            F.lit(indicator_id).alias("id_indicateur"),
            F.lit(year).alias("annee"),
            F.col(value_column).try_cast("double").alias("valeur_brute"),
            unit.alias("unite"),
            F.coalesce(source, F.lit(default_source)).alias("source"),
            raw.alias("meta"),
        )
        .where(F.col("id_epci").isNotNull() & F.col("valeur_brute").isNotNull())
    )


# Property names that may hold the code, name and kind of an area.
CODE_PROPERTIES = ("epci_code", "epci_siren", "siren", "code_siren", "code_epci", "code")
NAME_PROPERTIES = ("epci_name", "nom_epci", "nom", "libepci", "lib_epci")
KIND_PROPERTIES = ("epci_type", "nature_epci", "nature")

# properties as text: a value may be a string or a one-element array of strings
FEATURE = "struct<type: string, properties: map<string,string>, geometry: struct<type: string, coordinates: string>>"
FEATURE_SCHEMA = f"features array<{FEATURE}>"
# brackets open around the elements of a collection: the document and the array
ELEMENTS = 2


def read_features(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """One row per GeoJSON feature: properties map, geometry type, coordinates text.

    One collection per line if not ``multi_line``. Else one per file, and a large file is many tasks: see
    ``split_features``. Elements of another type than ``Feature`` are left out.
    """
    if multi_line:
        features = split_features(spark, path).select(F.from_json("text", FEATURE).alias("f"))
    else:
        features = read_pages(spark, path, FEATURE_SCHEMA, multi_line).select(F.explode("features").alias("f"))
    return features.where("f.type = 'Feature'").select(
        F.col("f.properties").alias("properties"),
        F.col("f.geometry.type").alias("geometry_type"),
        F.col("f.geometry.coordinates").alias("coordinates"),
    )


def split_features(spark: SparkSession, path) -> DataFrame:
    """The elements of the arrays of whole-file JSON documents, as text: (file, number in the file, text).

    Spark's text reader cuts a file at closing braces, over as many tasks as it has blocks. What a block opens and
    closes is counted twice, as if it began outside and inside a string; sums over the blocks of a file (few rows)
    then tell where each one really begins, and so which braces close an element. Elements that cross blocks are put
    together by their number. Only numbers are summed; texts are staged once and shuffled by block and by element, so
    no task holds more than a block. A file that ends inside an element is an error.
    """
    cut = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"),
    )
    def outside(text: Column, odd: int | Column) -> Column:
        """Every other part between quotes; escaped characters are gone before."""
        parts = F.split(F.regexp_replace(text, r"(?s)\\.", ""), '"')
        return F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), '"')

    def opened(odd: int) -> Column:
        """Brackets opened less those closed outside of strings, without the brace the piece was cut at."""
        bare = outside(F.col("text"), odd)
        opening, closing = (F.length(bare) - F.length(F.translate(bare, b, "")) for b in ("{[", "}]"))
        return opening - closing

    quotes = F.size(F.split(F.regexp_replace("text", r"(?s)\\.", ""), '"')) - 1
    # a cut inside a string closes nothing
    measured = cut.select(
        "*", (quotes % 2).alias("flips"),
        *[(opened(odd) - F.when(quotes % 2 == odd, 1).otherwise(0)).alias(f"depth{odd}") for odd in (0, 1)],
    )
    pieces = stage(measured, "pieces")

    in_block = Window.partitionBy("file", "block").orderBy("place")
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def prefix(column: str | Column, window=before) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    turned = pieces.withColumn("inside", prefix("flips") % 2)  # inside a string, if the block begins outside
    steps = turned.withColumns(
        {
            "step0": F.when(F.col("inside") == 0, F.col("depth0")).otherwise(F.col("depth1")),
            "step1": F.when(F.col("inside") == 0, F.col("depth1")).otherwise(F.col("depth0")),
        }
    )
    blocks = steps.groupBy("file", "block").agg(*[F.sum(c).alias(c) for c in ("flips", "step0", "step1")])
    blocks = blocks.withColumn("quoted", prefix("flips", in_file) % 2)
    blocks = blocks.withColumn("step", F.when(F.col("quoted") == 0, F.col("step0")).otherwise(F.col("step1")))
    left = F.sum("step").over(Window.partitionBy("file"))  # text after the last brace counts as one more of them
    broken = F.raise_error(F.concat(F.lit("the file ends inside an element: "), "file"))
    starts = blocks.select(
        "file", "block", "quoted", F.when(left.isin(0, -1), prefix("step", in_file)).otherwise(broken).alias("start")
    )

    step = F.when(F.col("quoted") == 0, F.col("step0")).otherwise(F.col("step1"))
    placed = steps.join(starts, ["file", "block"]).withColumn("step", step)
    placed = placed.withColumn("depth", F.col("start") + prefix("step"))  # where the piece begins
    closes = ((F.col("quoted") + F.col("inside") + F.col("flips")) % 2 == 0) & (F.col("depth") + F.col("step") == ELEMENTS)
    ended = placed.withColumn("ends", closes.cast("int"))
    counts = ended.groupBy("file", "block").agg(F.sum("ends").alias("elements"))
    bases = counts.select("file", "block", prefix("elements", in_file).alias("base"))
    numbered = ended.withColumn("local", prefix("ends")).join(bases, ["file", "block"])

    within = (F.col("quoted") + F.col("inside")) % 2
    piece = F.struct("block", "place", "depth", "ends", within.alias("within"), "text")
    whole = numbered.groupBy("file", (F.col("base") + F.col("local")).alias("number")).agg(
        F.sort_array(F.collect_list(piece)).alias("pieces")
    )
    # the last piece that begins outside of an element is the one in which this element begins
    first = F.array_max(F.transform("pieces", lambda p, i: F.when(p["depth"] <= ELEMENTS, i)))
    whole = whole.where(F.element_at("pieces", -1)["ends"] == 1).withColumn("first", first)
    head = whole.withColumn("head", F.expr("pieces[first]"))
    bare, depth = outside(F.col("head.text"), F.col("head.within")), F.col("head.depth")
    # before an element: a comma, or the start of its array; before any other object the name that it is the value of
    element = (
        F.when(depth == ELEMENTS, bare.rlike(r"^\s*(,\s*|\][^{]*\[\s*)?\{"))
        .when(depth == 1, bare.rlike(r"^[^{]*\[\s*\{")).otherwise(bare.rlike(r"^\s*\{[^{]*\[\s*\{"))
    )
    opening = F.when(depth == ELEMENTS, F.lit(r"^[^{]*")).otherwise(F.lit(r'(?s)^.*?"\s*:\s*\[\s*(?=\{)'))
    texts = F.transform(F.expr("slice(pieces, first + 1, size(pieces))"), lambda p: p["text"])
    text = F.concat(F.regexp_replace(F.array_join(texts, "}"), opening, F.lit("")), F.lit("}"))
    whole = head.where(element)
    return whole.select("file", "number", text.alias("text"))


def property_text(properties: str, name: str) -> Column:
    """Property value; the first element when it is a JSON array."""
    value = F.try_element_at(F.col(properties), F.lit(name))
    return F.when(value.startswith("["), F.get_json_object(value, "$[0]")).otherwise(value)


def describe_features(features: DataFrame) -> DataFrame:
    """Code, name and kind of every feature from its alternative properties."""

    def pick(names, default):
        return first_non_empty([property_text("properties", n) for n in names], default)

    return features.withColumns(
        {
            "code": pick(CODE_PROPERTIES, ""),
            "nom": pick(NAME_PROPERTIES, "Inconnu"),
            "nature": pick(KIND_PROPERTIES, "EPCI"),
        }
    )
