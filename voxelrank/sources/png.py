"""Gray PNG files: reading into pixel rows, and writing images of a table."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: the file's first bytes, and the channels of each colour type.
MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encode_png(image: np.ndarray) -> bytes:
    """8-bit gray file of an image in [0, 1]."""
    pixels = np.clip(np.rint(np.asarray(image, float) * 255), 0, 255).astype(np.uint8)
    h, w = pixels.shape
    raw = np.zeros((h, w + 1), np.uint8)
    raw[:, 1:] = pixels
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def decode_png(raw: bytes) -> np.ndarray:
    """Gray image in [0, 1]: colours are averaged, transparency is ignored; 8 bits, not interlaced."""
    if raw[:8] != MAGIC:
        raise ValueError("no PNG file")
    at, data, head = 8, [], None
    while at < len(raw):
        (n,), kind = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    w, h, depth, colour, _, _, woven = head
    if depth != 8 or colour not in CHANNELS or woven:
        raise ValueError("only 8-bit gray or colour PNG files without interlacing are read")
    c = CHANNELS[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h + 1, w + 1, c), np.int64)  # a border of zeros above and to the left
    for y in range(h):
        out[y + 1, 1:] = _undo(int(rows[y, 0]), rows[y, 1:].reshape(w, c).astype(np.int64), out[y])
    pixels = out[1:, 1:]
    return (pixels[..., :3].mean(-1) if c >= 3 else pixels[..., 0]) / 255


def _undo(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return line.cumsum(0) & 255
    if kind == 2:
        return (line + above[1:]) & 255
    left, got = np.zeros(line.shape[1], np.int64), np.empty_like(line)
    for x, v in enumerate(line):
        up, corner = above[x + 1], above[x]
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        left = got[x] = (v + guess) & 255
    return got


def read_png_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, height, width, pixels`` in [0, 1]."""

    def run(batches):
        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                image = decode_png(raw)
                yield pd.DataFrame({"path": [name], "height": [image.shape[0]], "width": [image.shape[1]], "pixels": [image.ravel()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, height int, width int, pixels array<double>")


def encode_images(images: DataFrame, name_col: str = "name") -> DataFrame:
    """``name, content``: each row of ``height, width, pixels`` as a PNG file."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"name": b[name_col], "content": [encode_png(np.asarray(p).reshape(h, w)) for h, w, p in zip(b["height"], b["width"], b["pixels"])]})

    return images.select(name_col, "height", "width", "pixels").mapInPandas(run, "name string, content binary")


def decode_images(files: DataFrame) -> DataFrame:
    """``name, height, width, pixels`` of rows of ``name, content``, the other way of :func:`encode_images`.

    As a table, images live on any file system that Spark writes.
    """

    def run(batches):
        for b in batches:
            images = [decode_png(raw) for raw in b["content"]]
            yield pd.DataFrame({"name": b["name"], "height": [i.shape[0] for i in images], "width": [i.shape[1] for i in images], "pixels": [i.ravel() for i in images]})

    return files.select("name", "content").mapInPandas(run, "name string, height int, width int, pixels array<double>")


def export_images(images: DataFrame, folder: str, name_col: str = "name") -> DataFrame:
    """Writes each image to its own file in ``folder``, and returns the names; a repeated task rewrites the same file.

    Executors write with the operating system's calls, so ``folder`` must be mounted on all of them;
    for other file systems write the table of :func:`encode_images`.
    """
    folder = folder.removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise ValueError("single files go to a mounted folder only; write the table of encode_images to other file systems")

    def run(batches):
        import os

        for b in batches:
            for name, raw in zip(b["name"], b["content"]):
                place = os.path.join(folder, name)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(f"{place}.{os.getpid()}", "wb") as f:
                    f.write(raw)
                os.replace(f"{place}.{os.getpid()}", place)
            yield b[["name"]]

    return encode_images(images, name_col).mapInPandas(run, "name string")
