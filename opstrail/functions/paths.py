"""Path and object-name functions."""

from __future__ import annotations

import posixpath
import re
from datetime import datetime, timezone

from pyspark.sql import Column, functions as F


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def dir_name(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)^(.*)/[^/]*\z", 1)


def log_number(c: Column) -> Column:
    """Number after the only dot of a log's base name; 0 for any other name."""
    digits = F.regexp_extract(base_name(c), r"^[^.]*\.([+-]?[0-9]+)\z", 1)
    return F.coalesce(F.when(digits != "", digits.try_cast("bigint")), F.lit(0).cast("bigint"))


def relative_key(c: Column, prefix: str) -> Column:
    """Object key without ``prefix`` and without leading slashes."""
    start = F.lit(len(prefix) + 1)
    rest = F.when(c.startswith(prefix), F.substr(c, start)).otherwise(c)
    return F.ltrim(rest, F.lit("/"))


def _class_char(pattern: str, i: int) -> tuple[str, int]:
    """One member of a ``[...]`` class, possibly escaped, and the index after it."""
    escaped = pattern[i:i + 1] == "\\"
    ch = pattern[i + escaped:i + escaped + 1]
    if not ch or (ch in "-]" and not escaped):
        raise ValueError(f"invalid pattern: {pattern}")
    return f"\\x{{{ord(ch):x}}}", i + escaped + 1


def _char_class(pattern: str, i: int) -> tuple[str, int]:
    """The class whose ``[`` stands before ``i`` as a regex, and the index after it."""
    negated = pattern[i:i + 1] == "^"
    i += negated
    members: list[str] = []
    while not members or pattern[i:i + 1] != "]":
        low, i = _class_char(pattern, i)
        high = low
        if pattern[i:i + 1] == "-":
            high, i = _class_char(pattern, i + 1)
        members.append(f"{low}-{high}")
    valid = [m for m in members if int(m[3:m.index("}")], 16) <= int(m[m.rindex("{") + 1:-1], 16)]
    if not valid:
        return ("(?s:.)" if negated else "(?!)"), i + 1
    return f"[{'^' if negated else ''}{''.join(valid)}]", i + 1


def glob_to_regex(pattern: str) -> str:
    """Shell glob (``*``, ``?``, ``[a-z]``, ``[^a]``, ``\\x``) as a Java regex.

    ``*`` and ``?`` do not cross a ``/``. A malformed pattern raises ``ValueError``.
    """
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "[":
            text, i = _char_class(pattern, i + 1)
            out.append(text)
            continue
        if ch == "\\":
            i += 1
            if i == len(pattern):
                raise ValueError(f"invalid pattern: {pattern}")
            out.append(re.escape(pattern[i]))
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(ch) or re.escape(ch))
        i += 1
    return "^" + "".join(out) + r"\z"


def glob_match(c: Column, pattern: str) -> Column:
    """Whether the whole name matches the glob."""
    return c.rlike(glob_to_regex(pattern))


def dest_name(path: str, gzip: bool, unique: bool, now: datetime | None = None) -> str:
    """Destination name: ``.gz`` added once, then a UTC time stamp before the base name."""
    if gzip and not path.endswith(".gz"):
        path += ".gz"
    if unique:
        stamp = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
        parent, name = posixpath.split(path)
        path = posixpath.join(parent, f"{stamp:%Y%m%d%H%M%S}-{name}")
    return path
