"""A sink that writes a file for each row, and image files through it.

``binary_files`` is a data source of Spark: every attempt of a task writes into folders of its own under ``_temporary``, which readers of Spark pass over; when
all tasks are done the driver moves the folders of the attempts that count into place, one rename a folder, and marks the end with
``_SUCCESS``. A folder holds FOLDER_FILES files at most, so that a task that lists it holds no more. A lost executor or a repeated task so never leaves half a file, or a file twice.
"""
from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.kernels import stacks


def _opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


#: Files of a folder that a task writes, at most, and rows of a batch of listed files.
FOLDER_FILES, LISTED = 20_000, 10_000


def _hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


class _Names:
    """The names that a task has written: those of the folder at hand as they are, those of full folders as sorted 8-byte hashes, and where a hash meets again the files
    themselves decide."""

    def __init__(self, exists):
        self.exists, self.own, self.before = exists, set(), []

    def add(self, name: str) -> bool:
        """Whether the name is new."""
        h = np.uint64(_hash(name))
        known = name in self.own or any(past[min(np.searchsorted(past, h), len(past) - 1)] == h and self.exists(name) for past in self.before)
        self.own.add(name)
        return not known

    def close(self) -> None:
        """The folder is full. Arrays of like size are put together, so there are few of them."""
        new = np.sort(np.fromiter(map(_hash, self.own), np.uint64, len(self.own)))
        while self.before and len(self.before[-1]) <= len(new):
            new = np.sort(np.concatenate((self.before.pop(), new)))
        self.before.append(new)
        self.own = set()


@dataclass
class Written(WriterCommitMessage):
    folders: list[str]


class FileWriter(DataSourceArrowWriter):
    """name, data -> files ``<path>/part-<attempt>-<number>/<name>``."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _opened(self.path)
        attempt, folders, made = uuid.uuid4().hex, [], set()
        seen = _Names(lambda name: any(x.type.name != "NotFound" for x in fs.get_file_info([f"{base}/_temporary/{f}/{name}" for f in folders])))
        for b in iterator:
            for name, data in zip(b.column("name").to_pylist(), b.column("data")):
                if not folders or len(seen.own) >= FOLDER_FILES:
                    if folders:
                        seen.close()
                    folders.append(f"part-{attempt}-{len(folders)}")
                    made.clear()
                if not name or name.startswith("/") or ".." in name.split("/") or not seen.add(name):
                    raise ValueError(f"file names must be relative and unique: {name!r}")
                within = f"{base}/_temporary/{folders[-1]}/{name}".rpartition("/")[0]
                if within not in made:
                    fs.create_dir(within, recursive=True)
                    made.add(within)
                with fs.open_output_stream(f"{base}/_temporary/{folders[-1]}/{name}") as f:
                    f.write(data.as_buffer() if data.is_valid else b"")
        return Written(folders)

    def commit(self, messages: list) -> None:
        fs, base = _opened(self.path)
        from pyarrow.fs import FileSelector

        if self.overwrite:
            for x in fs.get_file_info(FileSelector(base, allow_not_found=True)):
                if x.base_name != "_temporary":
                    (fs.delete_dir if x.type.name == "Directory" else fs.delete_file)(x.path)
        fs.create_dir(base, recursive=True)
        for folder in (f for m in messages if m is not None for f in m.folders):
            fs.move(f"{base}/_temporary/{folder}", f"{base}/{folder}")
        self._clear(fs, base)
        with fs.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        self._clear(*_opened(self.path))

    @staticmethod
    def _clear(fs, base: str) -> None:
        if fs.get_file_info([f"{base}/_temporary"])[0].type.name == "Directory":
            fs.delete_dir(f"{base}/_temporary")


class BinaryFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary_files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """``rows``: name (with folders, if any), data. A file for each row; a null is an empty file. Names must be unique within a task; rows of one name in different
    tasks become files in the folders of different tasks. Nothing is visible before all is written. The folder may be in any file system that pyarrow opens and that
    can rename folders (a shared disk, HDFS)."""
    rows.sparkSession.dataSource.register(BinaryFiles)
    rows.select("name", "data").write.format("binary_files").mode(mode).save(path)


def _hidden(path: str, base: str) -> bool:
    return any(x.startswith(("_", ".")) for x in path[len(base) :].strip("/").split("/"))


def walk_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name (below the folder of the task that wrote it), length of all files in ``path``, empty ones too. The driver lists one level; the folders found there are walked
    by as many tasks as there are cores. Names that begin with ``_`` or ``.`` are passed over; a folder that is not there has no files."""
    from pyarrow.fs import FileSelector

    def found(fs, base: str, infos: list) -> list[tuple[str, str, int]]:
        below = [(x.path, x.path[len(base) :].lstrip("/"), x.size) for x in infos if x.is_file and not _hidden(x.path, base)]
        return [(p, name.partition("/")[2] if name.startswith("part-") and "/" in name else name, n) for p, name, n in below]

    fs, base = _opened(path.rstrip("/"))
    top = fs.get_file_info(FileSelector(base, allow_not_found=True))
    kind = "path string, name string, length bigint"
    folders = [x.path for x in top if not x.is_file and not _hidden(x.path, base)]
    cores = spark.sparkContext.defaultParallelism

    def walk(batches):
        fs, base = _opened(path.rstrip("/"))
        for b in batches:
            for folder in b.column(0).to_pylist():
                infos = fs.get_file_info(FileSelector(folder, recursive=True))
                for at in range(0, len(infos), LISTED):
                    rows = found(fs, base, infos[at : at + LISTED])
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["path", "name", "length"])

    out = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(max(1, min(len(folders), cores))).mapInArrow(walk, kind)
    flat = found(fs, base, top)
    return out.unionByName(spark.createDataFrame(flat, kind)) if flat else out


def png_bytes(im: np.ndarray) -> bytes:
    """An (h, w, c) image of bytes as PNG: one channel gray, three RGB, four RGBA. Every row is stored as it is and the whole is deflated."""
    h, w, c = im.shape
    kind = {1: 0, 3: 2, 4: 6}.get(c)
    if kind is None:
        raise ValueError(f"an image of {c} channels has no PNG form")
    rows = np.zeros((h, 1 + w * c), np.uint8)
    rows[:, 1:] = im.reshape(h, -1)
    parts = ((b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes(), 6)), (b"IEND", b""))
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d)) for t, d in parts)


def to_png(images: DataFrame, name: str = "name") -> DataFrame:
    """``images``: name, height, width, channels, px (array or packed bytes). name and data; data is null where the pixels are null or do not fit."""

    def run(batches):
        for b in batches:
            for part, ims in stacks(b, 1):
                data = [None] * len(part) if ims is None else [png_bytes(im.astype(np.uint8)) for im in ims[0]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(part)), pa.array(data, pa.binary())], names=["name", "data"])

    return images.select(F.col(name).alias("name"), "height", "width", "channels", "px").mapInArrow(run, "name string, data binary")


def write_images(images: DataFrame, path: str, name: str = "name", mode: str = "append") -> None:
    """Images as PNG files; rows whose pixels are missing or do not fit become empty files, which readers count as broken."""
    write_files(to_png(images, name), path, mode)
