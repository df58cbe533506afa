"""Data sources over files of arrays: .npy matrices and NIfTI volumes in parts, and a writer of single files.

Executors open the files themselves and read the byte ranges of their own part; the driver reads headers
only.  Paths are local or of any file system that pyarrow opens (``file:``, ``hdfs:``, ``s3:``, ``gs:``).
"""

from __future__ import annotations

import ast
import gzip
import io
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a part at most (a part is one row range or slab at least), and of one batch.
PART, BATCH = 64 << 20, 8 << 20


def file_system(path: str) -> tuple[afs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return afs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return afs.LocalFileSystem(), os.path.abspath(path)


def listed(path: str, endings: tuple[str, ...]) -> list[str]:
    """The files at a path, by name: itself, or those below it with one of the endings; hidden ones are left out."""
    files, at = file_system(path)
    info = files.get_file_info(at)
    scheme = path[: path.index(at)] if at in path else ""
    if info.type == afs.FileType.File:
        return [scheme + at]
    if info.type == afs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = files.get_file_info(afs.FileSelector(at, recursive=True))
    return sorted(scheme + f.path for f in found if f.type == afs.FileType.File and f.path.endswith(endings) and not f.base_name.startswith(("_", ".")))


def read_range(path: str, start: int, size: int) -> bytes:
    files, at = file_system(path)
    with files.open_input_file(at) as f:
        f.seek(start)
        return f.read(size)


# ---------------------------------------------------------------- .npy matrices
@dataclass
class Rows(InputPartition):
    path: str
    first: int
    start: int
    n: int
    width: int
    kind: str


def npy_header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, dtype, where the data begin) of a C-ordered .npy file."""
    head = read_range(path, 0, 12)
    if head[:6] != b"\x93NUMPY":
        raise ValueError(f"{path} is no .npy file")
    size, at = (struct.unpack("<H", head[8:10])[0], 10) if head[6] == 1 else (struct.unpack("<I", head[8:12])[0], 12)
    about = ast.literal_eval(read_range(path, at, size).decode("latin1"))
    if about["fortran_order"]:
        raise ValueError(f"{path} is in Fortran order")
    return about["shape"], np.dtype(about["descr"]), at + size


class _NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.part = options["path"], int(options.get("partBytes", PART))

    def partitions(self):
        parts, first = [], 0
        for path in listed(self.path, (".npy",)):
            shape, kind, at = npy_header(path)
            if len(shape) != 2:
                raise ValueError(f"{path} holds no matrix")
            size = max(1, self.part // max(shape[1] * kind.itemsize, 1))
            for lo in range(0, shape[0], size):
                n = min(size, shape[0] - lo)
                parts.append(Rows(path, first + lo, at + lo * shape[1] * kind.itemsize, n, shape[1], kind.str))
            first += shape[0]
        return parts or [Rows("", 0, 0, 0, 0, "<f4")]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        kind, step = np.dtype(part.kind), max(1, BATCH // max(part.width * 8, 1))
        for lo in range(0, part.n, step):
            n = min(step, part.n - lo)
            x = np.frombuffer(read_range(part.path, part.start + lo * part.width * kind.itemsize, n * part.width * kind.itemsize), kind).astype(np.float64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), pa.array(x))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first + lo, part.first + lo + n)), values], names=["patch_id", "embedding"])


class NpySource(DataSource):
    """``patch_id, embedding``: rows of the .npy matrices at ``path``; ids run on from file to file, by name."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "patch_id bigint, embedding array<double>"

    def reader(self, schema):
        return _NpyReader(self.options)


# ---------------------------------------------------------------- volumes
#: Fixed values of the format: types by code.
NIFTI_KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


@dataclass(frozen=True)
class Header:
    """Of a NIfTI-1 file: shape as stored (first axis fastest), type, place of the data, scaling, spacing of the stored axes."""

    shape: tuple[int, ...]
    kind: str
    start: int
    slope: float
    inter: float
    spacing: tuple[float, ...]


def nifti_header(raw: bytes) -> Header:
    order = next((o for o in "<>" if struct.unpack(o + "i", raw[:4])[0] == 348), None)
    if order is None:
        raise ValueError("no NIfTI-1 file")
    dim = struct.unpack(order + "8h", raw[40:56])
    code = struct.unpack(order + "h", raw[70:72])[0]
    if code not in NIFTI_KINDS:
        raise ValueError(f"values of type {code} are not read")
    pix = struct.unpack(order + "8f", raw[76:108])
    at, slope, inter = struct.unpack(order + "3f", raw[108:120])
    return Header(dim[1 : 1 + dim[0]], order + NIFTI_KINDS[code], int(at), slope, inter, tuple(float(p) for p in pix[1 : 1 + dim[0]]))


def _head(path: str) -> Header:
    raw = read_range(path, 0, 65536)
    if raw[:2] == b"\x1f\x8b":
        import zlib

        raw = zlib.decompressobj(31).decompress(raw, 352)
    return nifti_header(raw)


@dataclass
class Slab(InputPartition):
    path: str
    first: int
    n: int


class _NiftiReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.part, self.axes, self.labels = options["path"], int(options.get("partBytes", PART)), options.get("axes", "ijk"), options.get("labels", "false").lower() == "true"
        if self.axes not in ("ijk", "kji"):
            raise ValueError("axes must be ijk (as stored) or kji (turned)")

    def partitions(self):
        parts = []
        for path in listed(self.path, (".nii", ".nii.gz")):
            h = _head(path)
            if len(h.shape) != 3:
                raise ValueError(f"{path} has {len(h.shape)} axes, not 3")
            plane = h.shape[0] * h.shape[1] * np.dtype(h.kind).itemsize
            # A compressed file is read from its beginning, so it is one part.
            size = h.shape[2] if path.endswith(".gz") else max(1, self.part // max(plane, 1))
            parts += [Slab(path, k, min(size, h.shape[2] - k)) for k in range(0, h.shape[2], size)]
        return parts or [Slab("", 0, 0)]

    def read(self, part) -> Iterator[tuple]:
        if not part.n:
            return
        h, files = _head(part.path), file_system(part.path)
        kind, (i, j, k) = np.dtype(h.kind), h.shape
        plane = i * j * kind.itemsize
        step = max(1, BATCH // max(i * j * 8, 1))
        if self.axes == "ijk":  # one cut of the last axis each: rows of any number of planes would not be alike
            step = 1
        with files[0].open_input_stream(files[1], compression="gzip" if part.path.endswith(".gz") else None) if part.path.endswith(".gz") else files[0].open_input_file(files[1]) as f:
            if part.path.endswith(".gz"):
                f.read(h.start)
            else:
                f.seek(h.start + part.first * plane)
            for lo in range(0, part.n, step):
                n = min(step, part.n - lo)
                x = np.frombuffer(f.read(n * plane), kind).reshape(n, j, i)
                if self.labels:
                    if kind.kind == "f" and (x != np.rint(x)).any():
                        raise ValueError(f"{part.path} holds no whole numbers")
                    x = x.astype(np.int64)
                else:
                    x = x.astype(np.float32)
                    x = (x * np.float32(h.slope) + np.float32(h.inter)) if h.slope else x
                for p, cut in enumerate(x):
                    cut = cut if self.axes == "kji" else cut.T
                    shape = [k, j, i] if self.axes == "kji" else [i, j, k]
                    spacing = [float(s) for s in reversed(h.spacing)]
                    yield part.path, part.first + lo + p, 0 if self.axes == "kji" else 2, shape, spacing, cut.ravel().tolist()


class NiftiSource(DataSource):
    """``path, plane, axis, shape, spacing, values``: a row for each plane of the NIfTI volumes at ``path``.

    ``axes`` is ``ijk`` for arrays as stored, then a plane cuts axis 2, or ``kji`` for turned ones, whose
    planes cut axis 0; ``values`` are row by row of the two other axes.  Spacing is in reversed order of the
    stored axes.  With ``labels`` values are whole numbers, unscaled.  Parts are slabs of planes.
    """

    @classmethod
    def name(cls):
        return "nifti"

    def schema(self):
        whole = self.options.get("labels", "false").lower() == "true"
        return f"path string, plane int, axis int, shape array<int>, spacing array<double>, values array<{'bigint' if whole else 'float'}>"

    def reader(self, schema):
        return _NiftiReader(self.options)


def _source(spark: SparkSession, kind: type, path: str, **options):
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).options(**options).load(path)


def read_npy(spark: SparkSession, path: str, part_bytes: int = PART) -> DataFrame:
    return _source(spark, NpySource, path, partBytes=part_bytes)


def read_volume(spark: SparkSession, path: str, axes: str = "ijk", labels: bool = False, part_bytes: int = PART) -> DataFrame:
    """Planes of volumes, or with ``labels`` of annotations; see :class:`NiftiSource`."""
    return _source(spark, NiftiSource, path, axes=axes, labels=str(labels).lower(), partBytes=part_bytes)


def voxels(planes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``path, z, y, x, value`` of planes, and the columns of ``keep``; no shuffle."""
    a, b = F.when(F.col("axis") == 0, F.col("shape")[2]).otherwise(F.col("shape")[1]), F.col("at")
    row, col = F.call_function("div", b, a).cast("int"), (b % a).cast("int")
    flat = planes.select("path", *keep, "plane", "axis", "shape", F.posexplode("values").alias("at", "value"))
    first = F.col("axis") == 0
    return flat.select("path", *keep, F.when(first, F.col("plane")).otherwise(row).alias("z"), F.when(first, row).otherwise(col).alias("y"), F.when(first, col).otherwise(F.col("plane")).alias("x"), "value")


@dataclass(frozen=True)
class VolumeFile:
    """A volume that tasks open themselves, once for each worker; only its header is read here.

    ``low`` and ``high``, where given, are what 0 and 1 stand for; what lies beyond is clipped.
    """

    path: str
    axes: str = "ijk"
    low: float | None = None
    high: float | None = None
    labels: bool = False

    @property
    def shape(self) -> tuple[int, int, int]:
        shape = _head(self.path).shape
        return shape if self.axes == "ijk" else shape[::-1]

    @property
    def spacing(self) -> tuple[float, float, float]:
        """Of the axes of :attr:`shape`."""
        found = _head(self.path).spacing
        return found if self.axes == "ijk" else found[::-1]

    @property
    def kind(self) -> str:
        """Type of the values that a copy needs: the stored one, or single precision where values are scaled."""
        h = _head(self.path)
        return "f4" if h.slope and (h.slope, h.inter) != (1.0, 0.0) else h.kind[1:]

    def array(self) -> np.ndarray:
        return _opened(self)


@lru_cache(maxsize=4)
def _opened(volume: VolumeFile) -> np.ndarray:
    h = _head(volume.path)
    files, at = file_system(volume.path)
    with files.open_input_stream(at, compression=None) as f:
        raw = f.read()
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    data = np.frombuffer(raw, h.kind, int(np.prod(h.shape)), h.start).reshape(h.shape, order="F")
    data = data.astype(np.int64) if volume.labels else data.astype(np.float32)
    data = data if volume.labels or not h.slope else data * np.float32(h.slope) + np.float32(h.inter)
    data = data if volume.axes == "ijk" else np.ascontiguousarray(data.T)
    if volume.low is None:
        return data
    return np.clip((data - volume.low) / max(volume.high - volume.low, 1e-12), 0, 1).astype(np.float32)


def nifti_head(shape: tuple[int, int, int], kind: np.dtype, spacing: tuple[float, float, float]) -> bytes:
    """The 352 bytes before the values; shape and spacing of the stored axes, the fastest first."""
    codes = {np.dtype(v).str[1:]: k for k, v in NIFTI_KINDS.items()}
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, codes[kind.str[1:]], kind.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 0.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head)


def nifti_bytes(data: np.ndarray, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> bytes:
    """An array as a NIfTI-1 file, stored as it is indexed (the first axis fastest), with the spacing of its axes."""
    return nifti_head(data.shape, data.dtype, spacing) + data.astype(data.dtype.newbyteorder("<")).tobytes(order="F")


def npy_bytes(data: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.save(held, np.ascontiguousarray(data))
    return held.getvalue()


# ---------------------------------------------------------------- single files
@dataclass
class _Written(WriterCommitMessage):
    n: int


class _FilesWriter(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, rows):
        files, base = file_system(self.path)
        made, n = set(), 0
        for row in rows:
            name = row["name"]
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"{name} leads out of the folder")
            at = f"{base}/{name}"
            folder, last = at.rsplit("/", 1)
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            beside = f"{folder}/.{last}.{uuid.uuid4().hex}"
            with files.open_output_stream(beside, compression=None) as f:
                f.write(row["content"])
            files.move(beside, at)
            n += 1
        return _Written(n)

    def commit(self, messages):
        files, base = file_system(self.path)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/_SUCCESS", compression=None) as f:
            f.write(b"")


class FilesSink(DataSource):
    """Writes rows of ``name, content`` each to a file of its own below ``path``.

    A file appears whole, by renaming, and a repeated task writes the same ones again; ``_SUCCESS`` says that
    all are there.
    """

    @classmethod
    def name(cls):
        return "single_files"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return _FilesWriter(self.options)


def write_files(rows: DataFrame, path: str) -> None:
    """Each row of ``name, content`` as a file below ``path``."""
    rows.sparkSession.dataSource.register(FilesSink)
    rows.select("name", "content").write.format("single_files").mode("append").save(path)


# ---------------------------------------------------------------- volumes, written
#: Fixed value of the format: voxels along an axis at most.
LONGEST = 32767


class _VolumesWriter(DataSourceWriter):
    def __init__(self, options):
        self.path, self.kind, self.least = options["path"], np.dtype(options["kind"]), int(options["least"])
        self.spacing = tuple(float(s) for s in options["spacing"].split(","))

    def write(self, rows):
        n = 0
        for name, planes in groupby(rows, lambda row: row["name"]):
            self._one(name, planes)
            n += 1
        return _Written(n)

    def _one(self, name, planes):
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name} leads out of the folder")
        files, base = file_system(self.path)
        at = f"{base}/{name}"
        folder, last = at.rsplit("/", 1)
        files.create_dir(folder, recursive=True)
        beside, n, shape = f"{folder}/.{last}.{uuid.uuid4().hex}", 0, None
        try:
            with files.open_output_stream(beside, compression="gzip" if last.endswith(".gz") else None) as f:
                for row in planes:
                    if shape is None:
                        shape = tuple(row["shape"])
                        if not (len(shape) == 3 and all(1 <= side <= LONGEST for side in shape)):
                            raise ValueError(f"a volume file has three axes of 1 to {LONGEST} voxels, not {shape}")
                        f.write(nifti_head(shape[::-1], self.kind, self.spacing[::-1]))
                    if row["plane"] != n or tuple(row["shape"]) != shape or len(row["values"]) != shape[1] * shape[2]:
                        raise ValueError(f"plane {n} of {at} is missing, repeated or of another size")
                    x = np.asarray(row["values"], np.float64)
                    f.write((np.rint(x) if self.kind.kind in "iu" else x).astype(self.kind.newbyteorder("<")).tobytes())
                    n += 1
            if n != shape[0]:
                raise ValueError(f"{at} has {n} planes, not {shape[0]}")
            files.move(beside, at)
        finally:
            if files.get_file_info(beside).type == afs.FileType.File:
                files.delete_file(beside)

    def commit(self, messages):
        if sum(m.n for m in messages if m) < self.least:
            raise ValueError(f"no planes for a volume in {self.path}")


class VolumesSink(DataSource):
    """Writes rows of ``name, plane, shape, values`` (cuts of z, row by row) as NIfTI files below ``path``, compressed if a name ends with .gz."""

    @classmethod
    def name(cls):
        return "volume_files"

    def schema(self):
        return "name string, plane int, shape array<int>, values array<double>"

    def writer(self, schema, overwrite):
        return _VolumesWriter(self.options)


def write_volumes(planes: DataFrame, path: str, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), kind: str = "f4", least: int = 0) -> None:
    """A NIfTI file below ``path`` for each ``name`` of ``name, plane, shape, values``; shapes and spacing are given in the order z, y, x.

    A file is written from its beginning to its end, so one task writes it: the sort before it spills, and the task holds a
    plane at a time; different files are written side by side.  A file appears whole, by renaming; missing or repeated
    planes, other sizes and sides of more than LONGEST voxels are errors and leave none.  Read back with the axes ``kji``.
    """
    planes.sparkSession.dataSource.register(VolumesSink)
    laid = planes.select("name", F.col("plane").cast("int").alias("plane"), F.col("shape").cast("array<int>").alias("shape"), F.col("values").cast("array<double>").alias("values"))
    sorted_ = laid.repartition("name").sortWithinPartitions("name", "plane")
    sorted_.write.format("volume_files").options(spacing=",".join(map(repr, map(float, spacing))), kind=kind, least=str(least)).mode("append").save(path)


def write_volume(planes: DataFrame, path: str, shape: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), kind: str = "f4") -> None:
    """One file of the ``plane, values`` of a volume; see :func:`write_volumes`."""
    folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
    named = planes.select(F.lit(name).alias("name"), "plane", F.array(*map(F.lit, shape)).alias("shape"), "values")
    write_volumes(named, folder, spacing, kind, 1)
