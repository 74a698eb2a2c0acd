"""PCM WAV files as a splittable source: blocks of samples, many tasks a file and many small files a task.

    spark.dataSource.register(WavSource)
    spark.read.format("pcm_wav").load("store://folder")

A range of bytes gives the blocks that begin in it, so blocks don't depend on the ranges. A file that isn't PCM WAV gives one row with its error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mediaspan.operators.audio import BLOCK

#: Bytes of a task.
SPLIT_BYTES = 32 << 20
#: Format tags of integers, floats and the extensible header; bits of a sample by tag.
INTEGER, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
BITS = {INTEGER: (8, 16, 24, 32), FLOAT: (32, 64)}
_SCHEMA = pa.schema([("media_id", pa.string()), ("channel", pa.int32()), ("rate", pa.int32()), ("n", pa.int64()), ("block", pa.int64()), ("samples", pa.list_(pa.float64())), ("error", pa.string())])


class BadWav(ValueError):
    """What is wrong with a file."""


@dataclass
class Layout:
    """Where a file's samples are and how they are written."""

    tag: int
    channels: int
    rate: int
    bits: int
    begin: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.bits // 8

    def decode(self, data: bytes) -> np.ndarray:
        """(frames, channels) of doubles in -1 to 1."""
        if self.tag == FLOAT:
            values = np.frombuffer(data, f"<f{self.bits // 8}").astype(float)
        elif self.bits == 8:
            values = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
        elif self.bits == 24:
            b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
            values = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
        else:
            values = np.frombuffer(data, f"<i{self.bits // 8}") / float(1 << (self.bits - 1))
        return values.reshape(-1, self.channels)


def layout(file: pa.NativeFile, size: int) -> Layout:
    """Read the chunks up to the samples. Samples that the file is too short for are left out."""
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise BadWav("not a RIFF WAVE file")
    form, at = None, 12
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            form = file.read(min(length, 40))
        elif name == b"data":
            return _checked(form, at + 8, min(length, size - at - 8))
        at += 8 + length + length % 2
    raise BadWav("no samples")


def _checked(form: bytes | None, begin: int, length: int) -> Layout:
    if form is None or len(form) < 16:
        raise BadWav("no format before the samples")
    tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
    if tag == EXTENSIBLE and len(form) >= 26:
        tag = struct.unpack("<H", form[24:26])[0]
    if bits not in BITS.get(tag, ()):
        raise BadWav(f"format {tag} of {bits} bits is not PCM")
    if not channels or not rate:
        raise BadWav("no channels or no rate")
    found = Layout(tag, channels, rate, bits, begin, length // (channels * bits // 8))
    if not found.frames:
        raise BadWav("no samples")
    return found


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path, begin, end, size of the file) of one task."""

    parts: list[tuple[str, int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.block, self.split = int(options.get("blocksamples", BLOCK)), int(options.get("splitbytes", SPLIT_BYTES))
        self.mono = str(options.get("mono", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """Files are listed, not opened: large ones are cut, small ones share a task."""
        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info([path])[0]
        files = store.get_file_info(fs.FileSelector(path, recursive=True)) if found.type == fs.FileType.Directory else [found]
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        out: list[Ranges] = [Ranges([])]
        held = 0
        for f in sorted((f for f in files if f.type == fs.FileType.File), key=lambda f: f.path):
            for at in range(0, max(1, f.size), self.split):
                end = min(f.size, at + self.split)
                if held + end - at > self.split and out[-1].parts:
                    out.append(Ranges([]))
                    held = 0
                out[-1].parts.append((f.path, at, end, f.size))
                held += end - at
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for path, begin, end, size in partition.parts:
            with store.open_input_file(path) as file:
                try:
                    found = layout(file, size)
                except BadWav as error:
                    if begin == 0:
                        yield pa.RecordBatch.from_pylist([{"media_id": path, "error": str(error)}], _SCHEMA)
                    continue
                step = self.block * found.frame_bytes
                # blocks that begin in the range; what lies before the samples counts as the first one's
                first = max(0, -(-(begin - found.begin) // step)) if begin > found.begin else 0
                last = -(-(end - found.begin) // step) if end > found.begin else 0
                if begin <= found.begin < end or begin > found.begin:
                    yield from self._blocks(file, path, found, first, min(last, -(-found.frames // self.block)))

    def _blocks(self, file: pa.NativeFile, path: str, found: Layout, first: int, last: int) -> Iterator[pa.RecordBatch]:
        for k in range(first, last):
            frames = min(self.block, found.frames - k * self.block)
            file.seek(found.begin + k * self.block * found.frame_bytes)
            values = found.decode(file.read(frames * found.frame_bytes))
            if self.mono:
                values = values.mean(axis=1, keepdims=True)
            rows = range(values.shape[1])
            columns = [[path] * len(rows), list(rows), [found.rate] * len(rows), [found.frames] * len(rows), [k] * len(rows), [np.ascontiguousarray(values[:, c]) for c in rows], [None] * len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


class WavSource(DataSource):
    """Format ``pcm_wav``: media_id (path), channel, rate, n, block, samples, error. Options: blockSamples, splitBytes, mono (mean of the channels)."""

    @classmethod
    def name(cls) -> str:
        return "pcm_wav"

    def schema(self) -> str:
        return "media_id string, channel int, rate int, n long, block long, samples array<double>, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def audio_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks for the audio operators, and (media_id, error) of files that have none."""
    return rows.where(F.col("error").isNull()).drop("error"), rows.where(F.col("error").isNotNull()).select("media_id", "error")
