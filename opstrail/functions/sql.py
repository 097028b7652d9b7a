"""The column functions under SQL names, as temporary functions whose bodies are SQL expressions.

Calls are expanded by the optimizer: plans hold built-in functions only, no Python.
Spark takes no SQL function inside a lambda; explode first. Column functions that take a pattern or a clock value are left to the DataFrame API.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from opstrail.functions import text as t
from opstrail.functions.literals import EXACT_FLOAT


def _raw(pattern: str) -> str:
    """A regular expression as a raw SQL literal."""
    quote = "'" if "'" not in pattern else '"'
    return f"r{quote}{pattern}{quote}"


def _chars(text: str) -> str:
    """Characters as a SQL expression that needs no escapes."""
    return "concat(" + ", ".join(f"char({ord(c)})" if ord(c) < 256 else f"'{c}'" for c in text) + ")"


def _masked(c: str) -> str:
    for pattern in (t.WHOLE_NUMBER, t.SINGLE_QUOTED, t.DOUBLE_QUOTED):
        c = f"regexp_replace({c}, {_raw(pattern)}, '?')"
    return c


def _escaped(c: str) -> str:
    return f"replace(replace(replace({c}, r'\\', r'\\\\'), char(10), r'\\n'), char(13), r'\\r')"


_BASE = "substring_index(s, '/', -1)"
_LOG_DIGITS = rf"regexp_extract({_BASE}, r'^[^.]*\.([+-]?[0-9]+)\z', 1)"
_FLOAT_VALUE = "try_cast(s as double)"
_SIGN = "case when x < 0 or cast(x as string) = '-0.0' then '-' else '' end"

#: name: (parameters, type, body)
FUNCTIONS = {
    "mask_literals": ("s string", "string", _masked("s")),
    "trim_ws": ("s string", "string", f"btrim(s, {_chars(t.WHITE_SPACE)})"),
    "strip_semicolons": ("s string", "string", "replace(s, ';', '')"),
    "text_tokens": ("s string", "array<string>", f"filter(split(s, {_raw(t.WHITE_SPACE_RUN)}), w -> w <> '')"),
    "to_int": ("s string", "bigint", f"case when rlike(s, {_raw(t.INT_TEXT)}) then try_cast(s as bigint) end"),
    "to_float": (
        "s string",
        "double",
        f"case when rlike(s, {_raw(t.FLOAT_TEXT)}) and not (abs({_FLOAT_VALUE}) = double('Infinity') and rlike(s, '[0-9]')) then {_FLOAT_VALUE} end",
    ),
    "is_gzip": ("b binary", "boolean", "hex(substring(b, 1, 2)) = '1F8B'"),
    "content_hash": ("s string", "string", "sha2(cast(s as binary), 256)"),
    "base_name": ("s string", "string", _BASE),
    "dir_name": ("s string", "string", r"regexp_extract(s, r'(?s)^(.*)/[^/]*\z', 1)"),
    "log_number": ("s string", "bigint", f"coalesce(case when {_LOG_DIGITS} <> '' then try_cast({_LOG_DIGITS} as bigint) end, 0L)"),
    "relative_key": (
        "s string, prefix string",
        "string",
        "ltrim('/', case when startswith(s, prefix) then substr(s, length(prefix) + 1) else s end)",
    ),
    "sql_text": ("s string", "string", f"concat(char(39), replace({_escaped('s')}, char(39), concat(char(39), char(39))), char(39))"),
    "sql_json": (
        "s string",
        "string",
        f"concat(char(39), replace(replace({_escaped('s')}, char(39), concat(char(39), char(39))), char(34), concat(char(92), char(34))), char(39))",
    ),
    "sql_float": ("v double", "string", f"case when v is not null then get(transform(array(v), x -> concat({_SIGN}, {EXACT_FLOAT})), 0) end"),
    "sql_bit": ("v boolean", "string", "case when v is not null then concat('b', char(39), if(v, '1', '0'), char(39)) end"),
    "sql_bool": ("v boolean", "string", "case when v is not null then if(v, 'true', 'false') end"),
    "sql_binary": ("b binary", "string", "concat('x', char(39), hex(b), char(39))"),
    "elapsed_text": (
        "ms bigint",
        "string",
        """case when ms = 0 then '0s' when ms < 1000 then concat(ms, 'ms') else concat(
          if(ms >= 3600000, concat(ms div 3600000, 'h'), ''), if(ms >= 60000, concat(ms div 60000 % 60, 'm'), ''),
          ms div 1000 % 60, if(ms % 1000 = 0, '', concat('.', rtrim('0', lpad(ms % 1000, 3, '0')))), 's') end""",
    ),
}


def register_functions(spark: SparkSession, prefix: str = "ot_") -> list[str]:
    """Create the functions in this session under ``prefix``, replacing what they were; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
