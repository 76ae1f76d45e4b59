"""Upload files: header checks (S4), CSV reading (S1) and schema healing.

Uploads carry their own header row and the layout differs between files, so records are cut
into cells one by one, as many as each has, and keyed by the header of their file: no line
decides anything about another. Read errors are raised. Row order within a file (``row_ord``) is taken straight after
the scan, before any shuffle: (block start offset, position in the task), which
sorts rows of one file in file order even when Spark packs several splits into
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punchspark.functions.text import JS_WS
from punchspark.operators.common import measured
from punchspark.policy import REQUIRED_UPLOAD_HEADERS

CSV_GLOB = "*.[cC][sS][vV]"


def files_under(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(upload_id) of every file, listed by Spark (any Hadoop file system); contents aren't read."""
    return spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("upload_id"))


#: A cell: quoted (quotes inside are doubled, and what follows the closing one belongs to it), or up to
#: the next comma. Possessive throughout, so a line is read once, however long a cell is.
_QUOTED = r'"(?:[^"]++|"")*+"'
CELL = rf"(?:{_QUOTED}[^,]*+|[^,]*+)"
CELL_IN_FILE = rf"(?:{_QUOTED}[^,\r\n]*+|[^,\r\n]*+)"
RECORD_IN_FILE = rf"({CELL_IN_FILE}(?:,{CELL_IN_FILE})*+)(?:\r\n|\r|\n|\z)"
NOT_BLANK = r"[^\x00-\x20]"


def cells_of(record: Column) -> Column:
    """The cells of a CSV record: an empty one is null, a quoted empty one is empty.

    A quote inside an unquoted cell is a character like any other, and so is one that is never closed.
    """
    # each match takes a comma at least, which an empty cell would not
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({CELL})"), F.lit(1))
    quoted = lambda c: c.startswith('"') & c.endswith('"') & (F.length(c) > 1)
    plain = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda c: F.when(quoted(c), plain(c)).when(c != "", c))


def csv_records(spark: SparkSession, paths: str | list[str], multi_line: bool = False) -> DataFrame:
    """Every record of every CSV file, the header included: (upload_id, row_ord, values). Blank lines are no records.

    A line is a record, and files are read in splits. With ``multi_line`` quoted cells may hold line
    breaks; a file is then cut into records by one task, which holds its text.
    """
    reader = spark.read.option("pathGlobFilter", CSV_GLOB)
    if multi_line:
        files = reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("upload_id"), "value")
        text = F.regexp_replace("value", "^\ufeff", "")
        records = files.select("upload_id", F.posexplode(F.regexp_extract_all(text, F.lit(RECORD_IN_FILE), F.lit(1))).alias("rec", "value"))
        place = F.struct(F.lit(0).cast("long").alias("blk"), F.col("rec").cast("long").alias("rec"))
        records = records.select("upload_id", place.alias("row_ord"), "value")
    else:
        records = with_row_order(reader.text(paths).select("value", "_metadata"))
    return records_of_lines(records)


def header_records(records: DataFrame) -> DataFrame:
    """(upload_id, header, head_ord): the first record of each file."""
    return records.groupBy("upload_id").agg(F.min_by("values", "row_ord").alias("header"), F.min("row_ord").alias("head_ord"))


def upload_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per CSV file: (upload_id, header array); a file without a record has an empty one."""
    files = files_under(spark, paths).where(F.lower("upload_id").endswith(".csv"))
    headers = files.join(header_records(csv_records(spark, paths)), "upload_id", "left")
    names = F.transform(F.filter("header", lambda h: h.isNotNull()), lambda h: F.regexp_replace(h, "^\ufeff", ""))
    return headers.select("upload_id", F.coalesce(names, F.array().cast("array<string>")).alias("header"))


def check_uploads(headers: DataFrame, required: tuple[str, ...] = REQUIRED_UPLOAD_HEADERS) -> DataFrame:
    """Per upload, are all required header names present (exact match)."""
    req = F.array(*[F.lit(h) for h in required])
    missing = F.array_except(req, F.coalesce(F.col("header"), F.array().cast("array<string>")))
    return headers.select(
        "upload_id",
        (F.size(missing) == 0).alias("valid"),
        missing.alias("missing"),
    )


def with_row_order(df: DataFrame) -> DataFrame:
    """Add upload_id and row_ord right after a file scan (before any shuffle)."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("upload_id"),
        F.struct(
            F.col("_metadata.file_block_start").alias("blk"),
            F.monotonically_increasing_id().alias("rec"),
        ).alias("row_ord"),
    )


def read_csv_layout(spark: SparkSession, files: list[str], multi_line: bool = False) -> DataFrame:
    """S1 for files sharing one header: every value a string, no inference."""
    df = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("inferSchema", False)
        .option("multiLine", multi_line)
        .option("encoding", "UTF-8")
        .csv(files)
    )
    return with_row_order(df)


def read_csv_uploads(spark: SparkSession, paths: str | list[str], multi_line: bool = False) -> DataFrame:
    """S1 over files of mixed layouts: (upload_id, row_ord, cells), cells keyed by normalised header.

    Each file's first record names its cells; of headers that normalise alike the leftmost
    wins. The headers (a row per file) are joined to the records, by broadcast when small.
    """
    return keyed_by_header(csv_records(spark, paths, multi_line))


def records_of_lines(lines: DataFrame) -> DataFrame:
    """(upload_id, row_ord, values) of the lines (upload_id, row_ord, value) of CSV files."""
    return lines.where(F.col("value").rlike(NOT_BLANK)).select("upload_id", "row_ord", cells_of(F.col("value")).alias("values"))


def keyed_by_header(records: DataFrame) -> DataFrame:
    """(upload_id, row_ord, cells) of the records of whole files, without their headers."""
    keys = F.transform("header", lambda h: F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), JS_WS, ""))
    headers = header_records(records).select("upload_id", "head_ord", keys.alias("keys"))
    first = F.transform("keys", lambda k, i: F.when((k != "") & (F.array_position(F.col("keys"), k) == i + 1), k))
    headers, _, small = measured(headers.select("upload_id", "head_ord", first.alias("keys")))
    rows = records.join(F.broadcast(headers) if small else headers, "upload_id").where(F.col("row_ord") != F.col("head_ord"))
    cells = F.map_from_entries(F.filter(F.arrays_zip("keys", "values"), lambda z: z["keys"].isNotNull()))
    return rows.select("upload_id", "row_ord", cells.alias("cells"))


def with_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add absent nullable columns as typed nulls (e.g. EmpType, Status)."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df

