"""Spark jobs for database-operations data.

Slow-query logs, SQL exports, content-addressed file sync and point-in-time
restore from a change log, written as DataFrame operators.
"""
