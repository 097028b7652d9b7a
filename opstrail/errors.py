"""Whole error texts, without stack traces or object numbers."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError


def error_text(problem: BaseException) -> str:
    """What went wrong with all its causes, one per line; never empty."""
    if isinstance(problem, Py4JJavaError):
        lines, cause = [], problem.java_exception
        while cause is not None and len(lines) < 20:
            lines.append(cause.toString())
            cause = cause.getCause()
        return "\n".join(dict.fromkeys(lines))
    return str(problem).strip() or type(problem).__name__
