"""Numbered pictures as a data source (SRC13, SNK07, SNK08): frames_%05d.png, or a single name.png.

    spark.dataSource.register(NumberedPictures)
    spark.read.format("numbered_pictures").load("/shared/run/frames_%05d.png")
    df.write.format("numbered_pictures").mode("append").save("/shared/run/out_%05d.png")

A row is a picture: number (null for a single one), height, width, channels (1 to 4), depth (8 or 16 bits) and pixels,
row by row. Reading cuts the numbers into ranges, a task each; only names come to the driver. A sequence with a hole is
rejected, in reading and in writing. Tasks write into a folder beside the pictures, of which a
commit moves what the successful attempts wrote, after it has looked at all numbers; a failed job
removes that folder, and leaves no picture. Paths are those of pyarrow's file systems; a cluster needs one that all
executors share.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "number long, height int, width int, channels int, depth int, pixels array<int>"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: The format's colour types by channels.
COLOURS = {1: 0, 2: 4, 3: 2, 4: 6}


def encode_png(pixels: np.ndarray, depth: int) -> bytes:
    """A picture (height, width, channels) of whole numbers as PNG."""
    h, w, channels = pixels.shape
    if channels not in COLOURS or depth not in (8, 16) or not h or not w:
        raise ValueError(f"{h} x {w} x {channels} pixels of {depth} bits are no picture")
    if pixels.min() < 0 or pixels.max() >= 1 << depth:
        raise ValueError(f"pixels must be from 0 to {(1 << depth) - 1}")
    rows = pixels.astype(">u2" if depth == 16 else "u1").reshape(h, -1).view("u1").reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), "u1"), rows], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, COLOURS[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[np.ndarray, int]:
    """(pixels (height, width, channels), depth) of a PNG of 8 or 16 bits without palette or interlacing."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, head, body = len(SIGNATURE), None, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR" and len(part) == 13:
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
    known = {v: k for k, v in COLOURS.items()}
    if head is None or head[2] not in (8, 16) or head[3] not in known or head[6]:
        raise ValueError(f"this kind of PNG is not read: {head}")
    w, h, depth, colour = head[:4]
    step = known[colour] * depth // 8  # bytes of a pixel
    rows = np.frombuffer(zlib.decompress(b"".join(body)), "u1").reshape(h, 1 + w * step)
    out, before = np.empty((h, w, step), "u1"), np.zeros((w, step), "i4")
    for y in range(h):
        kind, row = int(rows[y, 0]), rows[y, 1:].reshape(w, step).astype("i4")
        if kind == 1:
            row = np.cumsum(row, axis=0)
        elif kind == 2:
            row = row + before
        elif kind in (3, 4):
            left, corner = np.zeros(step, "i4"), np.zeros(step, "i4")
            for x in range(w):
                above = before[x]
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    from_left, from_above, from_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
                    guess = np.where((from_left <= from_above) & (from_left <= from_corner), left, np.where(from_above <= from_corner, above, corner))
                left, corner = (row[x] + guess) & 255, above
                row[x] = left
        before = row & 255
        out[y] = before
    return out.reshape(h, -1).view(">u2" if depth == 16 else "u1").reshape(h, w, -1).astype("i4"), depth


@dataclass
class Numbered:
    """A path with one %0Nd (or %d) in its file name, or the path of a single picture."""

    folder: str
    name: str
    digits: int | None

    @classmethod
    def of(cls, path: str) -> Numbered:
        folder, _, name = path.rpartition("/")
        marks = re.findall(r"%0?(\d*)d", name)
        if len(marks) > 1 or "%" in re.sub(r"%0?\d*d", "", path):
            raise ValueError(f"one %0Nd in the file name, not {path}")
        if not name.lower().endswith(".png"):
            raise ValueError(f"pictures are read and written as PNG, not {name}")
        return cls(folder or ".", name, int(marks[0] or 1) if marks else None)

    def file(self, number: int | None) -> str:
        return self.name if self.digits is None else re.sub(r"%0?\d*d", f"{number:0{self.digits}d}", self.name)

    def number(self, file: str) -> int | None:
        start, end = re.split(r"%0?\d*d", self.name)
        found = re.fullmatch(rf"{re.escape(start)}(\d{{{self.digits},}}){re.escape(end)}", file)
        return int(found[1]) if found and self.file(int(found[1])) == file else None

    def opened(self):
        """(file system, folder in it)"""
        from pyarrow import fs

        if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", self.folder):
            return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.folder))
        return fs.LocalFileSystem(), os.path.abspath(self.folder)

    def numbers(self) -> list[int]:
        from pyarrow import fs

        system, folder = self.opened()
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(n for n in (self.number(f.base_name) for f in found if f.is_file) if n is not None)


def checked(numbers: list[int], where: str) -> list[int]:
    """The numbers, in order, if they follow each other."""
    numbers = sorted(numbers)
    for a, b in zip(numbers, numbers[1:], strict=False):
        if b != a + 1:
            raise ValueError(f"{where}: picture {b} comes {'twice' if a == b else f'after {a}'}")
    return numbers


@dataclass
class Span(InputPartition):
    first: int | None
    last: int | None


class NumberedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.where, self.per_task = Numbered.of(options["path"]), int(options.get("per_task", "256"))

    def partitions(self) -> list[Span]:
        if self.where.digits is None:
            return [Span(None, None)]
        numbers = checked(self.where.numbers(), self.where.name)
        if not numbers:
            raise FileNotFoundError(f"no picture {self.where.name} in {self.where.folder}")
        return [Span(n, min(n + self.per_task - 1, numbers[-1])) for n in range(numbers[0], numbers[-1] + 1, self.per_task)]

    def read(self, partition: Span) -> Iterator[tuple]:
        system, folder = self.where.opened()
        for number in [None] if partition.first is None else range(partition.first, partition.last + 1):
            with system.open_input_stream(f"{folder}/{self.where.file(number)}") as f:
                pixels, depth = decode_png(f.read())
            yield number, *pixels.shape, depth, pixels.reshape(-1).tolist()


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    numbers: list = field(default_factory=list)


class NumberedWriter(DataSourceWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        missing = {"height", "width", "pixels"} - set(schema.names)
        self.where, self.overwrite, self.names = Numbered.of(options["path"]), overwrite, schema.names
        if missing or (self.where.digits is not None and "number" not in self.names):
            raise ValueError(f"pictures need the columns {sorted(missing or {'number'})}")
        if not overwrite and self._present():
            raise FileExistsError(f"{self.where.folder} has pictures {self.where.name}")
        self.work = f"_writing-{uuid.uuid4().hex[:12]}"
        system, folder = self.where.opened()
        system.create_dir(f"{folder}/{self.work}", recursive=True)

    def _present(self) -> list:
        from pyarrow import fs

        if self.where.digits is not None:
            return self.where.numbers()
        system, folder = self.where.opened()
        return [None] if system.get_file_info(f"{folder}/{self.where.name}").type != fs.FileType.NotFound else []

    def write(self, iterator: Iterator) -> Written:
        system, folder = self.where.opened()
        done = Written(uuid.uuid4().hex)
        # not with its parents: a task that outlives a job which was given up finds no place to write to
        system.create_dir(f"{folder}/{self.work}/{done.attempt}", recursive=False)
        for row in iterator:
            one = dict(zip(self.names, row, strict=True))
            number = one["number"] if self.where.digits is not None else None
            if self.where.digits is not None and (number is None or number < 0):
                raise ValueError(f"a picture with the number {number}")
            pixels = np.array(one["pixels"], dtype=np.int64).reshape(one["height"], one["width"], one.get("channels") or 1)
            with system.open_output_stream(f"{folder}/{self.work}/{done.attempt}/{self.where.file(number)}") as f:
                f.write(encode_png(pixels, one.get("depth") or 8))
            done.numbers.append(number)
        return done

    def commit(self, messages: list) -> None:
        system, folder = self.where.opened()
        try:
            every = [n for m in messages if m for n in m.numbers]
            if self.where.digits is None:
                if len(every) != 1:
                    raise ValueError(f"{len(every)} pictures for one name, {self.where.name}")
            else:
                checked(every, self.where.name)
            for old in self._present() if self.overwrite else ():
                system.delete_file(f"{folder}/{self.where.file(old)}")
            for m in messages:
                for n in m.numbers if m else ():
                    system.move(f"{folder}/{self.work}/{m.attempt}/{self.where.file(n)}", f"{folder}/{self.where.file(n)}")
        finally:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, folder = self.where.opened()
        for more in range(5, -1, -1):  # tasks that are still writing make a folder that isn't empty
            try:
                if system.get_file_info(f"{folder}/{self.work}").type != fs.FileType.NotFound:
                    system.delete_dir(f"{folder}/{self.work}")
                return
            except OSError:
                if not more:
                    raise
                time.sleep(0.2)


class NumberedPictures(DataSource):
    """Option per_task: how many pictures a task reads."""

    @classmethod
    def name(cls) -> str:
        return "numbered_pictures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NumberedReader:
        return NumberedReader(self.options)

    def writer(self, schema, overwrite: bool) -> NumberedWriter:
        return NumberedWriter(self.options, schema, overwrite)


def register(spark) -> None:
    """Makes the format known to a session; its code travels with it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(NumberedPictures)
