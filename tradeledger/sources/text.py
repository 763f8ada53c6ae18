"""Bulk text load: tab-separated rows, ``\\N`` for null, backslash escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tradeledger import schema

# Fixed values of the text format.
NULL_MARK = "\\N"
END_MARK = "\\."
ESCAPES = (("\\b", "\b"), ("\\t", "\t"), ("\\n", "\n"), ("\\v", "\v"), ("\\f", "\f"), ("\\r", "\r"))

# A run of escaped bytes (octal or hexadecimal), an escaped character, plain text, a backslash at the end.
_BYTES = r"\\([0-7]{1,3}|x[0-9A-Fa-f]{1,2})"
_PIECE = r"(?s)(?:\\(?:[0-7]{1,3}|x[0-9A-Fa-f]{1,2}))+|\\.|[^\\]+|\\"


def _unescape(field: Column) -> Column:
    """Escapes are read from left to right; an escaped character without a meaning stands for itself.

    Escaped bytes need not be UTF-8; ``checked_tsv`` tells those that are not.
    """
    def byte(code: Column) -> Column:
        number = F.when(code.startswith("x"), F.conv(F.substring(code, 2, 2), 16, 16)).otherwise(F.conv(code, 8, 16))
        return F.right(F.lpad(number, 2, "0"), F.lit(2))

    def plain(piece: Column) -> Column:
        found = F.when(piece.rlike("^" + _BYTES), F.unhex(
            F.array_join(F.transform(F.regexp_extract_all(piece, F.lit(_BYTES), 1), byte), "")).cast("string"))
        for mark, char in ESCAPES:
            found = found.when(piece == mark, F.lit(char))
        return found.when((F.length(piece) > 1) & piece.startswith("\\"), F.substring(piece, 2, 2)).otherwise(piece)

    pieces = F.transform(F.regexp_extract_all(field, F.lit(_PIECE), 0), plain)
    return F.when(F.contains(field, F.lit("\\")), F.array_join(pieces, "")).otherwise(field)


def _escape(field: Column) -> Column:
    field = F.replace(field, F.lit("\\"), F.lit("\\\\"))
    for mark, char in ESCAPES:
        field = F.replace(field, F.lit(char), F.lit(mark))
    return field


def load_tsv(spark: SparkSession, path: str, shape: T.StructType) -> DataFrame:
    """Read text files with the columns of ``shape``, in its order.

    Fields never hold raw tabs or line ends, so files split freely.  Empty
    strings stay empty strings; only the null mark becomes null.
    """
    fields = F.split(F.col("value"), "\t", -1)
    columns = []
    for i, f in enumerate(shape):
        raw = F.get(fields, F.lit(i))
        text = F.when(raw != F.lit(NULL_MARK), _unescape(raw))
        columns.append(text.cast(f.dataType).alias(f.name))
    return spark.read.text(path).where(F.col("value") != F.lit(END_MARK)).select(*columns)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, line`` of all lines; lines count from 1 in each file.

    A task counts its own lines; what lies before a stretch of a file follows from
    one row per stretch.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    rows = spark.read.text(path).select("value", *at)
    stretches = spark.read.text(path).select(*at).groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(stretches), ["file", "block"]).select("value", "file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"))


def checked_tsv(spark: SparkSession, path: str, shape: T.StructType, domains: dict[str, tuple] | None = None) -> DataFrame:
    """Every line but the end mark, once: ``file, line, value, reasons, row``.

    ``reasons`` is empty for sound lines.  Others say what is wrong, in the order of
    the columns: ``fields`` (their number), or ``column: escape`` (a lone backslash, or
    escaped bytes that are no UTF-8), ``null`` (where ``shape`` allows none), ``type``,
    ``length`` (of a ``varchar``), ``domain`` (none of the values in ``domains``).
    ``row`` has the columns as far as they can be read.
    """
    lines = _lines(spark, path).where(F.col("value") != F.lit(END_MARK)).withColumn("_f", F.split("value", "\t", -1))
    columns, faults = [], []
    for i, f in enumerate(shape):
        kind = T.StringType() if isinstance(f.dataType, T.VarcharType) else f.dataType
        raw = F.get("_f", F.lit(i))
        text = F.when(raw != F.lit(NULL_MARK), _unescape(raw))
        read = text.try_cast(kind)
        broken = raw.rlike(r"(?s)^(?:[^\\]|\\.)*\\$") & (raw != F.lit(NULL_MARK)) | ~F.is_valid_utf8(text)
        found = F.when(broken, "escape")
        if not f.nullable:
            found = found.when(text.isNull(), "null")
        found = found.when(text.isNotNull() & read.isNull(), "type")
        if isinstance(f.dataType, T.VarcharType):
            found = found.when(F.char_length(text) > f.dataType.length, "length")
        if domains and f.name in domains:
            found = found.when(~text.isin(*domains[f.name]), "domain")
        columns.append(read.alias(f.name))
        faults.append(F.when(found.isNotNull(), F.concat(F.lit(f"{f.name}: "), found)))
    listed = F.filter(F.array(*faults), lambda x: x.isNotNull())
    reasons = F.when(F.size("_f") != len(shape), F.array(F.lit("fields"))).otherwise(listed)
    return lines.select("file", "line", "value", reasons.alias("reasons"), F.struct(*columns).alias("row"))


def sound_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") == 0).select("row.*")


def rejected_lines(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") > 0).select("file", "line", "reasons", "value")


def load_balance(checked: DataFrame) -> DataFrame:
    """``reason, n``: lines per reason; sound ones under an empty reason, a line with several faults under each, all lines under ``all``."""
    each = checked.select(F.explode(F.when(F.size("reasons") == 0, F.array(F.lit(""))).otherwise(F.col("reasons"))).alias("reason"))
    return each.groupBy("reason").agg(F.count("*").alias("n")).union(checked.agg(F.lit("all"), F.count("*")))


def load_table_tsv(spark: SparkSession, path: str, table: str) -> DataFrame:
    return load_tsv(spark, path, schema.read_schema(table))


def save_tsv(df: DataFrame, path: str) -> None:
    """Write the same format."""
    fields = [F.coalesce(_escape(F.col(c).cast("string")), F.lit(NULL_MARK)) for c in df.columns]
    df.select(F.concat_ws("\t", *fields).alias("value")).write.mode("overwrite").text(path)
