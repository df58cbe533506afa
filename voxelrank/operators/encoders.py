"""The encoder side: images prepared for a vision model, encoded in batches by a model that a task loads once.

A model maps a batch (n, 3, size, size) to tokens (n, tokens, dim): the patches row by row, with a token for the whole image
in front where it has one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Mean and deviation of the channels that public vision models are trained with.
MEAN, DEVIATION = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
#: Images that are encoded in one go.
BATCH = 64

Model = Callable[[np.ndarray], np.ndarray]


@lru_cache(maxsize=256)
def bicubic(size: int, to: int) -> np.ndarray:
    """(to, size) weights of a bicubic resampling of ``size`` pixels, widened where it shrinks so that no pixel is skipped."""
    scale = size / to
    wide = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * size / to
    lo = np.maximum((centre - 2 * wide + 0.5).astype(int), 0)
    hi = np.minimum((centre + 2 * wide + 0.5).astype(int), size)
    at = np.arange(size)
    t = np.abs((at[None] + 0.5 - centre[:, None]) / wide)
    near, far = (1.5 * t - 2.5) * t * t + 1, ((-0.5 * t + 2.5) * t - 4) * t + 2
    w = np.where(t < 1, near, np.where(t < 2, far, 0.0)) * ((at >= lo[:, None]) & (at < hi[:, None]))
    return w / w.cumsum(1)[:, -1:]


def _weighted(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums along the last axis of ``x`` by the rows of ``w``, pixel after pixel: sums near a half round alike whatever is worked on together."""
    out = np.zeros((*x.shape[:-1], len(w)))
    for i in range(x.shape[-1]):
        some = np.flatnonzero(w[:, i])
        if len(some):  # neighbours, as the kernel is one piece
            at = slice(some[0], some[-1] + 1)
            out[..., at] += x[..., i, None] * w[at, i]
    return out


def resize(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """Images (n, h, w) of 8 bits, resampled to 8 bits; the columns first, each step rounded."""
    step = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    x = images.astype(float)
    if width != x.shape[2]:
        x = step(_weighted(x, bicubic(x.shape[2], width)))
    if height != x.shape[1]:
        x = step(_weighted(x.transpose(0, 2, 1), bicubic(x.shape[1], height))).transpose(0, 2, 1)
    return x.astype(np.uint8)


def preprocess(images: list[np.ndarray], size: int) -> np.ndarray:
    """(n, 3, size, size): gray or colour images in [0, 1] or 8 bits, shorter side resized to ``size``, middle cut out, channels normalised.

    Images of one shape are worked on together.
    """
    out = np.empty((len(images), 3, size, size))
    alike: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        if image.ndim not in (2, 3) or image.ndim == 3 and image.shape[2] not in (1, 3) or 0 in image.shape:
            raise ValueError("images are (height, width) or (height, width, 1 or 3)")
        alike.setdefault((*image.shape, image.dtype == np.uint8), []).append(i)
    for (h, w, *_), at in alike.items():
        x = np.stack([images[i] for i in at])
        x = x if x.dtype == np.uint8 else (np.clip(x, 0, 1) * 255.0).astype(np.uint8)
        x = x[:, None] if x.ndim == 3 else x.transpose(0, 3, 1, 2)
        to_h, to_w = (round(h * (size / w)), size) if w < h else (size, round(w * (size / h)))
        x = resize(x.reshape(-1, h, w), to_h, to_w)
        top, left = max(0, (to_h - size) // 2), max(0, (to_w - size) // 2)
        x = x[:, top : top + size, left : left + size].reshape(len(at), -1, size, size) / 255.0
        out[at] = (x - MEAN[:, None, None]) / DEVIATION[:, None, None]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


def patch_tokens(tokens: np.ndarray, grid: int) -> np.ndarray:
    """The grid * grid tokens of the patches: those after a first token for the whole, or all there are."""
    n = grid * grid
    if tokens.shape[1] < n:
        raise ValueError(f"{tokens.shape[1]} tokens are fewer than {n} patches")
    return tokens[:, 1 : 1 + n] if tokens.shape[1] > n else tokens


def pool(tokens: np.ndarray, grid: int, how: str = "first", window: int = 2) -> np.ndarray:
    """Embeddings of length 1: ``first`` (the token for the whole, or the mean where there is none), ``mean`` of the patches, or
    ``grid``, the patches averaged over windows, one embedding each."""
    patches = patch_tokens(tokens, grid)
    if how == "first":
        return _unit(tokens[:, 0] if tokens.shape[1] > grid * grid else patches.mean(1))
    if how == "mean":
        return _unit(patches.mean(1))
    if how != "grid" or window < 1:
        raise ValueError("pooling is first, mean or grid, with a window of 1 or more")
    side = grid // window
    cells = patches.reshape(len(patches), grid, grid, -1)[:, : side * window, : side * window]
    return _unit(cells.reshape(len(patches), side, window, side, window, -1).mean((2, 4)).reshape(len(patches), side * side, -1))


_loaded: dict[str, Model] = {}


@dataclass(frozen=True)
class Encoder:
    """A model that is loaded where it is used, once for each worker, and never sent around; ``encoder(images)`` gives an embedding each.

    ``load`` is a picklable function without arguments; ``size`` and ``patch`` are pixels.
    """

    load: Callable[[], Model]
    size: int = 224
    patch: int = 16
    pooling: str = "first"
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def model(self) -> Model:
        if self.key not in _loaded:
            _loaded[self.key] = self.load()
        return _loaded[self.key]

    def tokens(self, images: list[np.ndarray]) -> np.ndarray:
        return self.model(preprocess(images, self.size))

    def batch(self, images: list[np.ndarray]) -> np.ndarray:
        return pool(self.tokens(images), self.size // self.patch, self.pooling)

    def __call__(self, image: np.ndarray) -> np.ndarray:
        return self.batch([image])[0]


def encode_all(encoder, images: list[np.ndarray]) -> list[np.ndarray]:
    """An embedding of each image, BATCH at a time where the encoder takes batches."""
    if not hasattr(encoder, "batch"):
        return [encoder(image) for image in images]
    return [e for lo in range(0, len(images), BATCH) for e in encoder.batch(images[lo : lo + BATCH])]


class Projection:
    """A stand-in for a vision model: seeded random projections of the patches, and of their mean in front."""

    def __init__(self, patch: int = 16, dim: int = 64, seed: int = 7):
        self.patch, self.turn = patch, np.random.default_rng(seed).standard_normal((3 * patch * patch, dim))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        n, _, size, _ = x.shape
        g = size // self.patch
        cells = x[:, :, : g * self.patch, : g * self.patch].reshape(n, 3, g, self.patch, g, self.patch).transpose(0, 2, 4, 1, 3, 5).reshape(n, g * g, -1)
        tokens = cells @ self.turn
        return np.concatenate([tokens.mean(1, keepdims=True), tokens], 1)


def embed_images(images: DataFrame, encoder: Encoder, id_col: str = "name", window: int = 2) -> DataFrame:
    """``<id>, cell, emb``: embeddings of rows of ``height, width, pixels``; cell is 0, or with grid pooling the window's place.

    A task loads the model once and encodes BATCH images at a time; an image without pixels is left out.
    """

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), BATCH):
                part = b.iloc[lo : lo + BATCH]
                part = part[[p is not None and len(p) > 0 for p in part["pixels"]]]
                if not len(part):
                    continue
                found = pool(encoder.tokens([np.asarray(p, float).reshape(h, w) for p, h, w in zip(part["pixels"], part["height"], part["width"])]), encoder.size // encoder.patch, encoder.pooling, window)
                found = found if found.ndim == 3 else found[:, None]
                cells = found.shape[1]
                yield pd.DataFrame({id_col: part[id_col].repeat(cells).to_numpy(), "cell": np.tile(np.arange(cells), len(part)), "emb": list(found.reshape(len(part) * cells, -1))})

    kind = images.schema[id_col].dataType.simpleString()
    return images.select(id_col, "height", "width", "pixels").mapInPandas(run, f"{id_col} {kind}, cell int, emb array<double>")


def resized_images(images: DataFrame, size: int, id_col: str = "name") -> DataFrame:
    """``<id>, channel, y, x, value``: what a model gets to see of each image."""

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), BATCH):
                part = b.iloc[lo : lo + BATCH]
                x = preprocess([np.asarray(p, float).reshape(h, w) for p, h, w in zip(part["pixels"], part["height"], part["width"])], size)
                c, y, z = (i.ravel() for i in np.indices(x.shape[1:]))
                yield pd.DataFrame({id_col: part[id_col].repeat(len(c)).to_numpy(), "channel": np.tile(c, len(x)), "y": np.tile(y, len(x)), "x": np.tile(z, len(x)), "value": x.ravel()})

    kind = images.schema[id_col].dataType.simpleString()
    return images.select(id_col, "height", "width", "pixels").mapInPandas(run, f"{id_col} {kind}, channel long, y long, x long, value double")


def pooled_tokens(rows: DataFrame, grid: int, how: str = "first", window: int = 2, id_col: str = "name") -> DataFrame:
    """``<id>, cell, emb`` of rows of ``tokens array<array<double>>``; see :func:`pool`."""

    def run(batches):
        for b in batches:
            for name, tokens in zip(b[id_col], b["tokens"]):
                found = pool(np.stack(tokens)[None], grid, how, window)
                found = found[0] if found.ndim == 3 else found
                yield pd.DataFrame({id_col: [name] * len(found), "cell": np.arange(len(found)), "emb": list(found)})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "tokens").mapInPandas(run, f"{id_col} {kind}, cell int, emb array<double>")
