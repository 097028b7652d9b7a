"""Code that runs inside executor tasks.

Only byte-level file work lives here: peeking at magic bytes, streaming
decompression, chunked digests, copying, and joining rendered rows into
statements. The module is pickled by value, so executors need no install.
"""

from __future__ import annotations

import contextlib
import gzip
import hashlib
import io
import itertools
import os
import re
import sys
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 20
RECORD_SEPARATOR = b"\n# Time"
GZIP_MAGIC = b"\x1f\x8b"
MAX_BATCH_BYTES = 8 << 20
MAX_BATCH_ROWS = 4096


def _remote(path):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _local(path):
    """Local form of a path, or None for an object store or cluster file system."""
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        rest = path[len("file:"):] if scheme else path
        return "/" + rest.lstrip("/") if scheme else rest
    return None


def open_input(path):
    local = _local(path)
    if local is not None:
        return open(local, "rb")
    fs, inner = _remote(path)
    return fs.open_input_stream(inner, compression=None)


@contextlib.contextmanager
def replacing(path):
    """A writer whose content appears under ``path`` only when complete."""
    local = _local(path)
    mark = f".tmp-{uuid.uuid4().hex}"
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        partial = os.path.join(os.path.dirname(local), mark)
        try:
            with open(partial, "wb") as out:
                yield out
            os.replace(partial, local)
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(partial)
        return
    fs, inner = _remote(path)
    parent = inner.rpartition("/")[0]
    fs.create_dir(parent, recursive=True)
    partial = f"{parent}/{mark}"
    with fs.open_output_stream(partial, compression=None) as out:
        yield out
    fs.move(partial, inner)


def pinned_chunks(path, length):
    """The first ``length`` bytes of a file, in chunks; fewer bytes are an error."""
    left = length
    with open_input(path) as source:
        while left > 0:
            block = source.read(min(CHUNK, left))
            if not block:
                raise OSError(f"file shrank by {left} bytes while read: {path}")
            left -= len(block)
            yield block


def is_gzip_file(path):
    """Whether the content starts with the gzip magic; None if it cannot be read."""
    try:
        with open_input(path) as source:
            return source.read(2) == GZIP_MAGIC
    except OSError:
        return None


def split_stream(source, separator):
    """Pieces of a byte stream between separators, holding one piece at a time."""
    held = bytearray()
    while True:
        block = source.read(CHUNK)
        if not block:
            break
        start = max(0, len(held) - len(separator) + 1)
        held += block
        cut = held.find(separator, start)
        done = 0
        while cut >= 0:
            yield bytes(held[done:cut])
            done = cut + len(separator)
            cut = held.find(separator, done)
        if done:
            del held[:done]
    if held:
        yield bytes(held)


def read_pieces(separator):
    """Task that streams whole files, gzip or plain, and cuts them at ``separator``.

    A file that cannot be read or decompressed ends in one row with
    ``scan_error``. Without ``is_gzip`` the content of each file tells.
    """

    def run(batches):
        def flush():
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(uris, pa.string()),
                    pa.array(ids, pa.int64()),
                    pa.array(values, pa.binary()),
                    pa.array(errors, pa.string()),
                ],
                names=["file", "row_id", "bytes", "scan_error"],
            )
            for column in (uris, ids, values, errors):
                column.clear()
            return out

        uris, ids, values, errors = [], [], [], []
        size = 0
        for batch in batches:
            paths = batch.column("path").to_pylist()
            told = "is_gzip" in batch.schema.names
            kinds = batch.column("is_gzip").to_pylist() if told else map(is_gzip_file, paths)
            for uri, path, is_gzip in zip(batch.column("uri").to_pylist(), paths, kinds):
                row = 0
                try:
                    with open_input(path) as source:
                        stream = gzip.GzipFile(fileobj=source) if is_gzip else source
                        for piece in split_stream(stream, separator):
                            uris.append(uri)
                            ids.append(row)
                            values.append(piece)
                            errors.append(None)
                            row += 1
                            size += len(piece)
                            if size >= MAX_BATCH_BYTES or len(ids) >= MAX_BATCH_ROWS:
                                yield flush()
                                size = 0
                except (EOFError, gzip.BadGzipFile, gzip.zlib.error, OSError) as problem:
                    unreadable = isinstance(problem, OSError) and not isinstance(problem, gzip.BadGzipFile)
                    uris.append(uri)
                    ids.append(row)
                    values.append(b"")
                    errors.append(f"fail to read {'file' if unreadable else 'gzip file'}: {problem}")
        if ids:
            yield flush()

    return run


class CountedReads:
    """A file opened for reading from ``start`` on; ``taken`` counts bytes asked for."""

    taken = 0

    def __init__(self, path, start=0):
        local = _local(path)
        if local is not None:
            self.file = open(local, "rb", buffering=0)
        else:
            fs, inner = _remote(path)
            self.file = fs.open_input_file(inner)
        if start:
            self.file.seek(start)

    def read(self, n=CHUNK):
        block = self.file.read(n)
        CountedReads.taken += len(block)
        return block

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


class Ranged:
    """``source`` up to position ``size``, beyond which a growing file is not read."""

    def __init__(self, source, at, size):
        self.source, self.at, self.size = source, at, size

    def read(self, n=CHUNK):
        block = self.source.read(min(n, self.size - self.at)) if self.at < self.size else b""
        if not block and self.at < self.size:
            raise OSError(f"file shrank by {self.size - self.at} bytes while read")
        self.at += len(block)
        return block


def pieces_from(source, start, end, separator):
    """The pieces of a plain file that begin in [start, end); ``source`` stands at ``start``, or for
    a later start one separator before it. A piece is read to its end, wherever that is."""
    held, at, open_ = bytearray(), start, start == 0
    at -= 0 if open_ else min(start, len(separator))
    while True:
        block = source.read(CHUNK)
        if not block:
            break
        look = max(0, len(held) - len(separator) + 1)
        held += block
        cut, done = held.find(separator, look), 0
        while cut >= 0:
            if open_:
                yield bytes(held[done:cut])
            done = cut + len(separator)
            open_ = True
            if at + done >= end:  # the next piece is the next range's
                return
            cut = held.find(separator, done)
        if not open_:
            done = max(done, len(held) - len(separator) + 1)
        at += done
        del held[:done]
    if open_ and held:
        yield bytes(held)


def read_ranges(ranges, separator, first=None):
    """Arrow batches of the pieces of (path, uri, start, end, size) ranges.

    The first two bytes of a file tell gzip, which is streamed by its first range alone. A
    file that cannot be read, at whatever time, ends in a row with ``scan_error``; an empty
    one is one empty piece. ``first`` is a pattern: a file is left after the first piece that
    has it, and only that piece is given.
    """
    rows, size = [], 0

    def batch():
        arrays = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(arrays, PIECES)], schema=PIECES)

    for path, uri, start, end, length in ranges:
        number = 0
        try:
            # Unzipped content may be longer or shorter than the file; a plain file is read as it was listed.
            with CountedReads(path) as source:
                kind = source.read(2)
            if kind == GZIP_MAGIC and start:
                continue
            back = 0 if kind == GZIP_MAGIC else max(0, start - len(separator))
            with CountedReads(path, back) as source:
                if kind == GZIP_MAGIC:
                    found = split_stream(gzip.GzipFile(fileobj=io.BufferedReader(_Raw(source), CHUNK)), separator)
                else:
                    found = pieces_from(Ranged(source, back, length), start, end, separator)
                for piece in found:
                    if first is None or first.search(piece):
                        rows.append((uri, start, number, piece, None))
                        size += len(piece)
                    number += 1
                    if size >= MAX_BATCH_BYTES or len(rows) >= MAX_BATCH_ROWS:
                        yield batch()
                        rows, size = [], 0
                    if first is not None and rows and rows[-1][0] == uri:
                        break
            if not number and not start and first is None:
                rows.append((uri, start, 0, b"", None))
        except (EOFError, gzip.BadGzipFile, gzip.zlib.error, OSError) as problem:
            unreadable = isinstance(problem, OSError) and not isinstance(problem, gzip.BadGzipFile)
            rows.append((uri, start, number, b"", f"fail to read {'file' if unreadable else 'gzip file'}: {problem}"))
    if rows:
        yield batch()


PIECES = pa.schema(
    [("file", pa.string()), ("block_start", pa.int64()), ("row_id", pa.int64()), ("bytes", pa.binary()), ("scan_error", pa.string())]
)


class _Raw(io.RawIOBase):
    """Counted reads as a raw stream, for buffering."""

    def __init__(self, source):
        self.source = source

    def readable(self):
        return True

    def readinto(self, into):
        block = self.source.read(len(into))
        into[: len(block)] = block
        return len(block)


def read_dealt(separator):
    """Task over rows with an array of ranges each."""

    def run(batches):
        for batch in batches:
            for ranges in batch.column("ranges").to_pylist():
                yield from read_ranges([tuple(r.values()) for r in ranges], separator)

    return run


def list_inputs(paths, recursive):
    """(path, size) of every file at or below the paths, in order; names starting with _ or . are hidden."""
    out = []
    for path in paths:
        local = _local(path)
        if local is not None:
            scheme = "file:" if path.startswith("file:") else ""
            out += [(scheme + p, n) for p, n in _walk(local, recursive)]
            continue
        from pyarrow.fs import FileSelector, FileType

        fs, inner = _remote(path)
        info = fs.get_file_info(inner)
        found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(inner, recursive=recursive))
        head = path[: len(path.rstrip("/")) - len(inner.rstrip("/"))]
        below = len(inner.rstrip("/"))
        shown = [x for x in found if x.type == FileType.File and (x is info or not re.search(r"(^|/)[_.]", x.path[below:].lstrip("/")))]
        out += sorted((head + x.path, x.size) for x in shown)
    return out


def _walk(path, recursive):
    if not os.path.isdir(path):
        yield path, os.path.getsize(path)
        return
    for entry in sorted(os.scandir(path), key=lambda e: e.name):
        if entry.name[0] in "_.":
            continue
        if entry.is_dir():
            if recursive:
                yield from _walk(entry.path, recursive)
        else:
            try:
                yield entry.path, entry.stat().st_size
            except OSError:
                yield entry.path, 0  # opening it will tell


def name_test(pattern):
    """Test of names by a pattern as Spark takes it: code points and the end of text are written otherwise here."""
    pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)
    return re.compile(pattern.replace(r"\z", r"\Z")).search


def file_uri(path):
    """A path as scan metadata shows it, percent-encoded."""
    local = _local(path)
    text = path if local is None else "file:" + os.path.abspath(local)
    return re.sub(r"[^A-Za-z0-9\-_.!~'()*,;:$&+=@/\x80-\U0010ffff]", lambda m: f"%{ord(m[0]):02X}", text)


def plan_ranges(files, split, cost):
    """Lists of (path, uri, start, end, size) of about ``split`` bytes; a file counts ``cost`` more."""
    parts, room = [], 0
    for path, size in files:
        uri = file_uri(path)
        for start in range(0, max(size, 1), split):
            end = min(start + split, size)
            if not parts or end - start + cost > room:
                parts.append([])
                room = split
            parts[-1].append((path, uri, start, max(end, start + 1), size))
            room -= end - start + cost
    return parts


def digest_files(batches):
    """Adds ``sha256`` of the first ``length`` bytes of each file."""
    for batch in batches:
        digests = []
        for path, length in zip(
            batch.column("path").to_pylist(), batch.column("length").to_pylist()
        ):
            digest = hashlib.sha256()
            for block in pinned_chunks(path, length):
                digest.update(block)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(digests, pa.string())],
            names=[*batch.schema.names, "sha256"],
        )


def first_of_each(key, order):
    """Task that keeps, of each Arrow batch, the row of the least ``order`` of every ``key``."""

    def run(batches):
        for batch in batches:
            ranked = batch.sort_by([(key, "ascending"), (order, "ascending")])
            keys = ranked.column(key)
            if len(keys):
                new = pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)), True)
                yield ranked.filter(pa.concat_arrays([pa.array([True]), new]))

    return run


def copy_to(dest):
    """Task that copies files below ``dest`` and reports each outcome."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, name, length in zip(
                batch.column("path").to_pylist(),
                batch.column("name").to_pylist(),
                batch.column("length").to_pylist(),
            ):
                digest, copied, error = hashlib.sha256(), 0, None
                try:
                    with replacing(f"{dest}/{name}") as out:
                        for block in pinned_chunks(path, length):
                            out.write(block)
                            digest.update(block)
                            copied += len(block)
                except OSError as problem:
                    error = f"fail to sync file: {path}, error: {problem}"
                rows.append(
                    {
                        "path": path,
                        "name": name,
                        "ok": error is None,
                        "error": error or "",
                        "bytes": copied,
                        "sha256": digest.hexdigest() if error is None else None,
                    }
                )
            yield pa.RecordBatch.from_pylist(
                rows,
                schema=pa.schema(
                    [
                        ("path", pa.string()),
                        ("name", pa.string()),
                        ("ok", pa.bool_()),
                        ("error", pa.string()),
                        ("bytes", pa.int64()),
                        ("sha256", pa.string()),
                    ]
                ),
            )

    return run


def write_lines(dest, base):
    """Task that writes rows of ``(folder, value)`` in their order, as lines of ``dest/folder/base``.

    Rows of one folder follow each other. Values are bytes, null is an empty line; one
    file is open at a time, and appears only when complete.
    """

    def run(batches):
        rows = (row for batch in batches for row in zip(batch.column("folder"), batch.column("value")))
        for folder, lines in itertools.groupby(rows, lambda row: row[0].as_py()):
            n = 0
            with replacing(f"{dest}/{folder}/{base}") as out:
                for _, value in lines:
                    if value.is_valid:
                        out.write(value.as_buffer())
                    out.write(b"\n")
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([folder], pa.string()), pa.array([n], pa.int64())], names=["folder", "n_lines"])

    return run


def local_path(path):
    return _local(path)


def tree_root(nodes):
    """Root of a digest tree over hex digests; one without a sibling stands for itself."""
    while len(nodes) > 1:
        pairs = [
            hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(nodes[::2], nodes[1::2])
        ]
        nodes = pairs + (nodes[-1:] if len(nodes) % 2 else [])
    return nodes[0]


def _leaves(path, start, end, leaf_bytes):
    """The leaves of a file's bytes [start, end); at least one, fewer bytes are an error."""
    with CountedReads(path, start) as source:
        left = end - start
        while True:
            leaf, want = bytearray(), min(leaf_bytes, left)
            while len(leaf) < want:
                block = source.read(want - len(leaf))
                if not block:
                    raise OSError(f"file shrank by {left - len(leaf)} bytes while read: {path}")
                leaf += block
            yield bytes(leaf)
            left -= want
            if not left:
                return


RANGE_DIGESTS = pa.schema(
    [(n, pa.string()) for n in ("path", "name")]
    + [(n, pa.int64()) for n in ("length", "nth", "start", "end")]
    + [(n, pa.string()) for n in ("digest", "error")]
)


def _each_range(act):
    """Task that adds the digest or the error of ``act(row)`` to each range."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                try:
                    row["digest"], row["error"] = act(row), None
                except OSError as problem:
                    row["digest"], row["error"] = None, f"fail to read file: {row['path']}, error: {problem}"
            yield pa.RecordBatch.from_pylist(rows, schema=RANGE_DIGESTS)

    return run


def digest_byte_ranges(leaf_bytes):
    """Task that reads ranges leaf by leaf."""

    def digest(row):
        found = _leaves(row["path"], row["start"], row["end"], leaf_bytes)
        return tree_root([hashlib.sha256(leaf).hexdigest() for leaf in found])

    return _each_range(digest)


def _hidden(dest, name, run):
    parent, base = os.path.split(f"{_local(dest)}/{name}")
    return os.path.join(parent, f".{base}.{run}")


def copy_byte_ranges(dest, run, leaf_bytes):
    """Task that writes ranges at their place in a hidden file."""

    def copy(row):
        hidden = _hidden(dest, row["name"], run)
        os.makedirs(os.path.dirname(hidden), exist_ok=True)
        out, at, digests = os.open(hidden, os.O_WRONLY | os.O_CREAT, 0o666), row["start"], []
        try:
            for leaf in _leaves(row["path"], row["start"], row["end"], leaf_bytes):
                done = 0
                while done < len(leaf):
                    done += os.pwrite(out, leaf[done:], at + done)
                at += len(leaf)
                digests.append(hashlib.sha256(leaf).hexdigest())
        finally:
            os.close(out)
        return tree_root(digests)

    return _each_range(copy)


def show_copies(dest, run):
    """Task that gives whole copies their names."""

    def show(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                hidden, final = _hidden(dest, row["name"], run), f"{_local(dest)}/{row['name']}"
                error = row["error"]
                if not error:
                    try:
                        if os.path.exists(hidden) or not os.path.exists(final):
                            os.replace(hidden, final)
                    except OSError as problem:
                        error = f"fail to sync file: {row['path']}, error: {problem}"
                else:
                    with contextlib.suppress(FileNotFoundError):
                        os.unlink(hidden)
                rows.append(
                    {
                        "path": row["path"],
                        "name": row["name"],
                        "ok": not error,
                        "error": error,
                        "bytes": 0 if error else row["length"],
                        "tree": None if error else row["tree"],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=SHOWN)

    return show


SHOWN = pa.schema(
    [("path", pa.string()), ("name", pa.string()), ("ok", pa.bool_()), ("error", pa.string()), ("bytes", pa.int64()), ("tree", pa.string())]
)


def join_rows(head, batch_rows, batch_bytes):
    """Task that joins rendered rows into statements of at most ``batch_rows`` rows.

    Rows carry ``batch``; a statement never spans two batches, and is closed before the
    row that would take its rows beyond ``batch_bytes``, or after a longer row. Rows are
    counted off by their lengths and joined as Arrow data; only the open statement is held.
    """

    def run(batches):
        open_batch, pieces, n, size = None, [], 0, 0
        for batch in batches:
            texts = batch.column("row_sql")
            keys = batch.column("batch").to_numpy()
            ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
            edges = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
            out, at = [], 0
            while at < len(keys):
                begun = ends[at - 1] if at else 0
                same = int(edges[np.searchsorted(edges, at, side="right")])
                if n and keys[at] != open_batch:
                    end = at
                else:
                    fits = int(np.searchsorted(ends, begun + batch_bytes - size, side="right"))
                    end = min(same, at + batch_rows - n, max(fits, at if n else at + 1))
                if end > at:
                    pieces.append(pc.binary_join(pa.ListArray.from_arrays([0, end - at], texts.slice(at, end - at)), ",")[0].as_py())
                    open_batch, n, size = keys[at], n + end - at, size + int(ends[end - 1] - begun)
                    at = end
                # What stops short of the rows at hand is full.
                if at < len(keys) and n:
                    out.append((open_batch, head + ",".join(pieces) + ";", n))
                    pieces, n, size = [], 0, 0
            if out:
                yield _statements(out)
        if n:
            yield _statements([(open_batch, head + ",".join(pieces) + ";", n)])

    return run


def _statements(rows):
    batch, statement, count = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(batch, pa.int64()), pa.array(statement, pa.string()), pa.array(count, pa.int64())],
        names=["batch", "statement", "n_rows"],
    )
