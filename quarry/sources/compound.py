"""Images inside documents: zip packages and compound files (sector chains, a directory tree, a mini stream)."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Signatures, sector numbers with a meaning and kinds of directory entries of compound files (fixed values).
COMPOUND = bytes.fromhex("D0CF11E0A1B11AE1")
ZIP = b"PK"
LAST_REGULAR = 0xFFFFFFFA
END_OF_CHAIN = 0xFFFFFFFE
NO_ENTRY = 0xFFFFFFFF
STORAGE, STREAM, ROOT = 1, 2, 5
#: Endings of images (fixed values).
IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "emf", "wmf")
#: Folder of a compound document with what is embedded, and the bit of its file header that says that streams are deflated (fixed values).
EMBEDDED = "BinData"
DEFLATED = 1


#: Bytes of images that leave Python together (one file's at least), and what a row counts besides.
TOGETHER, ROW = 1 << 20, 1 << 9


class BrokenFile(ValueError):
    """A file whose inner structure leads nowhere."""


class CompoundFile:
    """A compound file in memory.  Streams are read one by one, so a broken one leaves the others whole."""

    def __init__(self, data: bytes):
        self.data = data
        if len(data) < 512 or not data.startswith(COMPOUND):
            raise BrokenFile("no compound file")
        shift, mini_shift = struct.unpack_from("<2H", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise BrokenFile(f"sectors of 2**{shift} and 2**{mini_shift} bytes")
        self.size, self.mini_size, self.wide = 1 << shift, 1 << mini_shift, shift == 12
        directory, = struct.unpack_from("<I", data, 48)
        self.cutoff, mini_start, _, more, n_more = struct.unpack_from("<5I", data, 56)
        self.next = self._numbers(self._table_sectors(more, n_more))
        self.entries = self._chain(directory)
        self.mini_next = self._numbers(self._sectors(mini_start)) if mini_start <= LAST_REGULAR else ()
        self.mini: bytes | None = None

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        if n > LAST_REGULAR or at >= len(self.data):
            raise BrokenFile(f"no sector {n}")
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def _table_sectors(self, more: int, n_more: int) -> list[int]:
        """Sectors of the allocation table: 109 in the head, the rest in a list of their own."""
        found = list(struct.unpack_from("<109I", self.data, 76))
        for _ in range(n_more):
            if more > LAST_REGULAR:
                break
            *listed, more = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            found += listed
            if len(found) > len(self.data) // self.size + 109 + self.size:
                raise BrokenFile("the list of the allocation table runs in a circle")
        return [n for n in found if n <= LAST_REGULAR]

    def _numbers(self, sectors) -> tuple[int, ...]:
        table = b"".join(map(self._sector, sectors))
        return struct.unpack(f"<{len(table) // 4}I", table)

    def _walk(self, start: int, table: tuple[int, ...]) -> Iterator[int]:
        met, at = 0, start
        while at != END_OF_CHAIN:
            if at >= len(table) or met >= len(table):
                raise BrokenFile(f"broken chain from sector {start}")
            met += 1
            yield at
            at = table[at]

    def _sectors(self, start: int) -> Iterator[int]:
        return self._walk(start, self.next)

    def _chain(self, start: int) -> bytes:
        return b"".join(map(self._sector, self._sectors(start)))

    def _entry(self, n: int) -> tuple[str, int, int, int, int, int, int]:
        """(name, kind, left, right, child, first sector, size) of a directory entry."""
        at = n * 128
        if at + 128 > len(self.entries):
            raise BrokenFile(f"no directory entry {n}")
        length, kind = struct.unpack_from("<HB", self.entries, at + 64)
        left, right, child = struct.unpack_from("<3I", self.entries, at + 68)
        start, low, high = struct.unpack_from("<3I", self.entries, at + 116)
        name = self.entries[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
        return name, kind, left, right, child, start, low | high << 32 if self.wide else low

    def streams(self) -> Iterator[tuple[str, int, int]]:
        """(path, first sector, size) of every stream, by path."""
        found, todo, seen = [], [(self._entry(0)[4], "")], {0}
        while todo:
            n, folder = todo.pop()
            if n == NO_ENTRY:
                continue
            if n in seen:
                raise BrokenFile("the directory runs in a circle")
            seen.add(n)
            name, kind, left, right, child, start, size = self._entry(n)
            todo += [(left, folder), (right, folder)]
            if kind == STORAGE:
                todo.append((child, f"{folder}{name}/"))
            elif kind == STREAM:
                found.append((folder + name, start, size))
        return iter(sorted(found))

    def read(self, start: int, size: int) -> bytes:
        """A stream's bytes; the small ones lie in the mini stream, which is the root's own chain."""
        if size == 0:
            return b""
        if size >= self.cutoff:
            made = self._chain(start)
        else:
            if self.mini is None:
                self.mini = self._chain(self._entry(0)[5])
            made = b"".join(self.mini[n * self.mini_size : (n + 1) * self.mini_size] for n in self._walk(start, self.mini_next))
        if len(made) < size:
            raise BrokenFile(f"{len(made)} of {size} bytes")
        return made[:size]


def _is_image(name: str) -> bool:
    return name.rpartition(".")[2].lower() in IMAGES


def _compound_images(data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    whole = CompoundFile(data)
    listed = list(whole.streams())
    heads = [whole.read(start, size) for path, start, size in listed if path == "FileHeader"]
    deflated = any(len(h) >= 40 and h[36] & DEFLATED for h in heads)
    for path, start, size in listed:
        if path.startswith(EMBEDDED + "/") and _is_image(path):
            try:
                raw = whole.read(start, size)
                yield path, zlib.decompress(raw, -15) if deflated and raw else raw, None
            except (BrokenFile, zlib.error) as x:
                yield path, None, f"{type(x).__name__}: {x}"


def _zip_images(data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for path in sorted(n for n in z.namelist() if _is_image(n)):
            try:
                yield path, z.read(path), None
            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError) as x:
                yield path, None, f"{type(x).__name__}: {x}"


def images(data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path inside, bytes, error) of a file's images, by path; the first bytes tell the kind of file."""
    if data.startswith(COMPOUND):
        return _compound_images(data)
    if data.startswith(ZIP):
        return _zip_images(data)
    raise BrokenFile("neither a package nor a compound file")


def _flat(paths: list[str]) -> list[str]:
    """File names without folders; a name met again gets the next free number."""
    taken: set[str] = set()
    for path in paths:
        base, _, ending = path.rsplit("/", 1)[-1].rpartition(".")
        name, k = f"{base}.{ending}", 0
        while name in taken:
            k += 1
            name = f"{base}_{k}.{ending}"
        taken.add(name)
        yield name


def embedded_images(files: DataFrame) -> DataFrame:
    """path, member (path inside), name (flat, one of a kind within the file), bytes, error.  files: path, content.

    A file without images has no row; one that cannot be opened has one row with its error and neither member nor bytes; of an
    image whose sectors or compressed bytes are broken the row holds the error, and the file's other images stay.  Empty or null
    contents are files that cannot be opened.
    """

    kind = StructType.fromDDL("path string, member string, name string, bytes binary, error string")
    shape = to_arrow_schema(kind)

    def made(path: str, data: bytes | None) -> list[dict]:
        try:
            found = list(images(data or b""))
            return [{"path": path, "member": member, "name": name, "bytes": content, "error": error} for (member, content, error), name in zip(found, _flat([m for m, _, _ in found]))]
        except (BrokenFile, struct.error, zipfile.BadZipFile) as x:
            return [{"path": path, "error": f"{type(x).__name__}: {x}"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, data in zip(*batch.columns):  # a file at a time becomes Python objects
                more = made(path.as_py(), data.as_py())
                rows, size = rows + more, size + sum(len(r.get("bytes") or b"") + ROW for r in more)
                if size > TOGETHER:
                    yield pa.RecordBatch.from_pylist(rows, shape)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, shape)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, kind)
