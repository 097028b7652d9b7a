"""Rows as SQL literals, INSERT statements and table definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from opstrail import tasks
from opstrail.functions import literals as lit
from opstrail.sources.tables import range_of

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
TIMESTAMP_TYPES = (T.TimestampType, T.TimestampNTZType)

# Definition types by Spark type name.
DDL_TYPES = {
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "int": "INT",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "string": "LONGTEXT",
    "binary": "LONGBLOB",
    "date": "DATE",
    "timestamp": "DATETIME(6)",
    "timestamp_ntz": "DATETIME(6)",
    "variant": "JSON",
}


def quote_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _unsupported(name: str) -> ValueError:
    return ValueError(f"unsupported database type: {name}")


def _default_literal(c: Column, kind: T.DataType, lossless: bool, parity: bool) -> Column:
    if isinstance(kind, (*INTEGER_TYPES, T.DecimalType)):
        return c.cast("string")
    if isinstance(kind, FLOAT_TYPES):
        return lit.sql_float(c, lossless)
    if isinstance(kind, (*TIMESTAMP_TYPES, T.DateType, T.TimeType)):
        return F.concat(F.lit("'"), c.cast("string"), F.lit("'"))
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return lit.sql_text(c, parity)
    if isinstance(kind, T.BinaryType):
        return lit.sql_binary(c)
    if isinstance(kind, T.BooleanType):
        return lit.sql_bool(c)
    if isinstance(kind, T.VariantType):
        return lit.sql_json(F.to_json(c), parity)
    raise _unsupported(kind.simpleString())


def _bit_literal(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return lit.sql_bit(c)
    if not isinstance(kind, T.BinaryType):
        raise _unsupported(f"BIT as {kind.simpleString()}")
    too_long = F.concat(
        F.lit("failed to parse BIT type, expected length 1, got "),
        F.octet_length(c).cast("string"),
    )
    number = F.conv(F.hex(c), 16, 10)
    return F.when(F.octet_length(c) > 1, F.raise_error(too_long).cast("string")).otherwise(
        F.concat(F.lit("b'"), number, F.lit("'"))
    )


def sql_literal(
    field: T.StructField,
    source_type: str | None = None,
    lossless: bool = False,
    parity: bool = False,
) -> Column:
    """Literal text of a column, ``NULL`` for NULL.

    ``source_type`` names the database type where the Spark type does not
    tell: JSON, BIT, BINARY, YEAR, ENUM, SET or TIME. A type without a
    literal raises here, before any job starts.
    """
    c, kind = F.col(quote_name(field.name)), field.dataType
    name = (source_type or "").split("(")[0].strip().upper()
    if name == "JSON":
        text = lit.sql_json(c.cast("string"), parity)
    elif name == "BIT":
        text = _bit_literal(c, kind)
    elif name == "BINARY":
        text = lit.sql_binary(c, fixed=True)
    elif name in ("YEAR", "TIME"):
        text = F.concat(F.lit("'"), c.cast("string"), F.lit("'"))
    elif name in ("", "ENUM", "SET"):
        text = _default_literal(c, kind, lossless, parity)
    else:
        raise _unsupported(name)
    return F.coalesce(text, F.lit("NULL"))


def to_sql_literals(
    df: DataFrame,
    lossless: bool = False,
    parity: bool = False,
    source_types: dict[str, str] | None = None,
) -> DataFrame:
    """Adds ``row_sql``, the row as ``(v1,v2,…)``."""
    named = source_types or {}
    values = [sql_literal(f, named.get(f.name), lossless, parity) for f in df.schema.fields]
    return df.withColumn("row_sql", F.concat(F.lit("("), F.concat_ws(",", *values), F.lit(")")))


def insert_head(df: DataFrame, table: str) -> str:
    names = ", ".join(quote_name(c) for c in df.columns)
    return f"INSERT INTO {quote_name(table)} ({names}) VALUES "


def _range_number(key: Column, width: int) -> Column:
    """key / width rounded down, in whole numbers: a double would merge large keys."""
    key, step = key.cast("bigint"), F.lit(width).cast("bigint")
    return F.call_function("div", key, step) - F.when(key % step < 0, 1).otherwise(0)


def insert_statements(
    df: DataFrame,
    table: str,
    batch_rows: int = 1000,
    batch_by: tuple[str, int | list[int]] | None = None,
    batch_bytes: int = 16 << 20,
    **literal_options,
) -> DataFrame:
    """INSERT statements of at most ``batch_rows`` rows: ``(batch, statement, n_rows)``.

    A statement's rows take ``batch_bytes`` at most, unless a single row is longer.

    Rows are joined inside the partitions they are scanned in, without a
    shuffle; ``batch`` is then the partition. With ``batch_by=(column, width)``
    a statement holds the rows of one range of an integer key, in key order,
    which gives the same text on every run; the key should be unique. A list of
    ``sources.key_cuts`` instead of a width makes ranges with as many rows each. Either
    way a task holds one open statement, however many rows share a batch.
    """
    rows = to_sql_literals(df, **literal_options)
    if batch_by is None:
        rows = rows.select(F.spark_partition_id().cast("long").alias("batch"), "row_sql")
    else:
        column, width = batch_by
        rows = rows.select(
            (range_of(F.col(column), width) if isinstance(width, list) else _range_number(F.col(column), width)).alias("batch"),
            F.col(column).alias("row_key"),
            "row_sql",
        )
        rows = rows.repartition("batch").sortWithinPartitions("batch", "row_key", "row_sql")
        rows = rows.select("batch", "row_sql")
    return rows.mapInArrow(
        tasks.join_rows(insert_head(df, table), batch_rows, batch_bytes),
        "batch long, statement string, n_rows long",
    )


def insert_frame(table: str, locks: bool = True) -> tuple[list[str], list[str]]:
    """Lines before and after the statements of a table that has rows."""
    name = quote_name(table)
    before = [f"/*!40000 ALTER TABLE {name} DISABLE KEYS */;"]
    after = [f"/*!40000 ALTER TABLE {name} ENABLE KEYS */;"]
    if locks:
        before.insert(0, f"LOCK TABLES {name} WRITE;")
        after.append("UNLOCK TABLES;")
    return before, after


def table_ddl(
    schema: T.StructType, table: str, drop: bool = True, source_types: dict[str, str] | None = None
) -> list[str]:
    """Statements that define a table, each on one line.

    ``source_types`` are written as they are given, with their length or
    values where these are part of the type: ``BINARY(16)``, ``ENUM('a','b')``.
    """
    columns = []
    for field in schema.fields:
        name = field.dataType.simpleString()
        if field.name in (source_types or {}):
            kind = source_types[field.name]
        elif isinstance(field.dataType, T.DecimalType):
            kind = name.upper()
        elif isinstance(field.dataType, (T.CharType, T.VarcharType)):
            kind = name.upper()
        elif isinstance(field.dataType, T.TimeType):
            kind = "TIME(6)"
        elif name in DDL_TYPES:
            kind = DDL_TYPES[name]
        else:
            raise _unsupported(name)
        columns.append(f"{quote_name(field.name)} {kind}" + ("" if field.nullable else " NOT NULL"))
    create = f"CREATE TABLE {quote_name(table)} ({', '.join(columns)});"
    return [f"DROP TABLE IF EXISTS {quote_name(table)};", create] if drop else [create]
