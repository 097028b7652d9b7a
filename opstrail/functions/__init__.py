from opstrail.functions.literals import (
    rtrim_nul,
    sql_binary,
    sql_bit,
    sql_bool,
    sql_float,
    sql_json,
    sql_text,
)
from opstrail.functions.paths import (
    base_name,
    dest_name,
    dir_name,
    glob_match,
    glob_to_regex,
    log_number,
    relative_key,
)
from opstrail.functions.sql import register_functions
from opstrail.functions.text import (
    is_gzip,
    json_text,
    mask_literals,
    strip_semicolons,
    to_number,
    tokens,
    trim_ws,
)
from opstrail.functions.times import elapsed_text, instant, utc_literal

__all__ = [
    "base_name", "dest_name", "dir_name", "elapsed_text", "glob_match", "glob_to_regex",
    "instant", "is_gzip", "json_text", "log_number", "mask_literals",
    "register_functions", "relative_key", "rtrim_nul", "sql_binary", "sql_bit", "sql_bool", "sql_float", "sql_json", "sql_text",
    "strip_semicolons", "to_number", "tokens", "trim_ws", "utc_literal",
]
