from opstrail.sources.changelog import read_changelog, write_changelog
from opstrail.sources.dumpfile import read_dump_heads, read_dump_lines
from opstrail.sources.files import list_files, list_prefix
from opstrail.sources.slowlog import read_slowlog
from opstrail.sources.tables import cut_predicates, jdbc_options, jdbc_ranges, key_cuts, list_tables, range_of, read_table

__all__ = [
    "cut_predicates", "jdbc_options", "jdbc_ranges", "key_cuts", "range_of", "list_files", "list_prefix", "list_tables", "read_changelog",
    "read_dump_heads", "read_dump_lines", "read_slowlog", "read_table", "write_changelog",
]
