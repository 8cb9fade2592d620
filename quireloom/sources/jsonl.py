"""JSON lines and JSON documents with declared schemas, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.functions.text import strip

SCHEMAS = {
    "chapters": "book_id string, chapter_id string, chapter_index int, title string, text string",
    "chunks": (
        "book_id string, chunk_id string, chapter_id string, chapter_index int, chunk_index int, chapter_title string, "
        "source_text string, source_token_estimate int"
    ),
    "translations": (
        "book_id string, seq bigint, chunk_id string, translated_text string, provider string, model string, attempt_count int, "
        "latency_ms int, input_tokens int, output_tokens int, estimated_cost_usd double, timestamp string"
    ),
    "errors": (
        "book_id string, chunk_id string, chapter_id string, chapter_title string, chunk_index int, error_type string, "
        "error_message string, attempts int"
    ),
    "artifacts": "book_id string, stage string, chapter_id string, chapter_index int, title string, text string",
    "blocks": "chapter_id string, block_id string, kind string, text string, order_index int, source_anchor string",
    "structured_chapters": (
        "book_id string, chapter_id string, chapter_index int, source_title string, translated_title string, "
        "blocks array<struct<block_id: string, kind: string, text: string, order_index: int, source_anchor: string>>, "
        "assets array<struct<source_asset_id: string, source_location_hint: string, extracted_path: string, caption: string, "
        "block_anchor_id: string, status: string>>"
    ),
}


def chapter_parts(chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and assets, in their order, of structured chapters that hold both as arrays."""
    blocks = chapters.select("chapter_id", F.inline("blocks"))
    numbered = F.posexplode("assets").alias("ord", "asset")
    return blocks, chapters.select("chapter_id", numbered).select("chapter_id", "ord", "asset.*")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are no rows, lines that are no JSON fail. A missing path gives an empty table."""
    if not _found(spark, path):
        return spark.createDataFrame([], SCHEMAS.get(schema, schema))
    return spark.read.schema(SCHEMAS.get(schema, schema)).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines; 'append' adds files and keeps what is there."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


#: Rows of a JSON document that is one array; larger tables are JSON lines.
MAX_DOCUMENT_ROWS = 100_000


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that each hold one JSON array of objects. Other JSON fails; a missing path gives an empty table."""
    declared = SCHEMAS.get(schema, schema)
    texts = _whole_files(spark, path)
    if texts is None:
        return spark.createDataFrame([], declared)
    bare = strip("value")
    checked = F.when(F.startswith(bare, F.lit("[")), bare).otherwise(F.raise_error(F.concat(F.lit("no JSON array: "), F.substring(bare, 1, 80))).cast("string"))
    items = F.from_json(checked, f"array<struct<{declared}>>", {"mode": "FAILFAST"})
    return texts.select(F.inline(items))


def read_json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each file that holds one JSON object. Other JSON fails; a missing path gives an empty table."""
    declared = SCHEMAS.get(schema, schema)
    texts = _whole_files(spark, path)
    if texts is None:
        return spark.createDataFrame([], declared)
    return texts.select(F.from_json(_an_object(F.col("value")), f"struct<{declared}>", {"mode": "FAILFAST"}).alias("o")).select("o.*")


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """Entries (key, value) of files that each hold one JSON object, values as text; other JSON fails."""
    texts = _whole_files(spark, path)
    if texts is None:
        return spark.createDataFrame([], "key string, value string")
    return texts.select(F.explode(F.from_json(_an_object(F.col("value")), "map<string,string>", {"mode": "FAILFAST"})))


def _an_object(text: Column) -> Column:
    bare = strip(text)
    return F.when(F.startswith(bare, F.lit("{")), bare).otherwise(
        F.raise_error(F.concat(F.lit("must hold a JSON object: "), F.substring(bare, 1, 80))).cast("string")
    )


def _found(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def _whole_files(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.text(path, wholetext=True) if _found(spark, path) else None


def write_json_array(df: DataFrame, path: str) -> None:
    """Rows as one JSON array in one file of a folder; more than MAX_DOCUMENT_ROWS fail."""
    rows = F.collect_list(F.struct(*df.columns))
    small = F.when(F.size(rows) > MAX_DOCUMENT_ROWS, F.raise_error(F.lit(f"more than {MAX_DOCUMENT_ROWS} rows"))).otherwise(rows)
    limited = df.limit(MAX_DOCUMENT_ROWS + 1)  # the one row too many is what fails
    limited.agg(F.to_json(small, {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_json_object(df: DataFrame, path: str) -> None:
    """The only row as one JSON object in one file of a folder; any other number of rows fails."""
    rows = F.collect_list(F.struct(*df.columns))
    only = F.when(F.size(rows) == 1, F.get(rows, F.lit(0))).otherwise(F.raise_error(F.lit("an object is made of one row")))
    df.limit(2).agg(F.to_json(only, {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def json_map(text: Column | str) -> Column:
    """Entries of a JSON object of strings as an array of structs in no particular order; empty for other JSON."""
    parsed = F.from_json(text, "map<string,string>")
    return F.coalesce(F.map_entries(parsed), F.array().cast("array<struct<key:string,value:string>>"))


def title_list(text: Column | str) -> Column:
    """Stripped titles of a JSON list of strings or objects with a title; blank ones left out, other items an error."""
    items = F.from_json(text, "array<string>")

    def one(item: Column) -> Column:
        titled = F.get_json_object(item, "$.title")
        return F.when(~F.startswith(item, F.lit("{")), strip(item)).when(titled.isNotNull(), strip(titled)).otherwise(
            F.raise_error(F.concat(F.lit("neither a title nor an object with one: "), item)).cast("string")
        )

    return F.filter(F.transform(items, one), lambda t: t != "")


def write_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrite only the partitions of ``keys`` that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
