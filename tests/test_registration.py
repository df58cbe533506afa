import struct
import zlib

import numpy as np
import pytest

from voxelrank.operators import registration as R
from voxelrank.operators import volume
from voxelrank.sources import png


def test_regrid_keeps_linear_ramps():
    z, y, x = np.meshgrid(np.arange(10.0), np.arange(12.0), np.arange(8.0), indexing="ij")
    v = 2 * z - y + 3 * x
    got = R.regrid(v, (10.0, 10.0, 10.0), (25.0, 25.0, 5.0))
    assert got.shape == R.regrid_shape(v.shape, (10, 10, 10), (25, 25, 5)) == (4, 5, 16)
    a, b, c = np.meshgrid(np.arange(4) * 2.5, np.arange(5) * 2.5, np.minimum(np.arange(16) * 0.5, 7.0), indexing="ij")
    assert np.allclose(got, 2 * a - b + 3 * c)
    assert (R.regrid(v, (1.0, 1.0, 1.0), (1.0, 1.0, 1.0)) == v).all()


def test_orientation_bound_and_mismatch():
    v = np.arange(24.0).reshape(2, 3, 4)
    w = R.orient(v, (2, 0, 1), (True, False, True))
    assert w.shape == (4, 2, 3) and w[0, 0, 0] == v[0, 2, 3]
    assert R.distance_bound((2, 3, 4)) == pytest.approx(2 * np.sqrt(1 + 4 + 9)) and R.distance_bound((2, 2, 2), (3, 0, 4)) == pytest.approx(10)
    assert R.spacing_mismatch((25, 25, 10), (25, 50, 10)) == pytest.approx(2)


def test_slice_statistics(spark):
    labels = (volume.synthetic_volume() > 0).astype(np.int32)
    every = R.slice_foreground(spark, labels, 30, 32)
    some = R.slice_foreground(spark, labels, 30, 32, least=0.3)
    row = R.slice_statistics(every).first()
    assert row.n == 30 and 0 <= row.fg_min <= row.fg_p25 <= row.fg_median <= row.fg_max < 1 and abs(row.fg_mean + row.bg_mean - 1) < 1e-12
    assert 0 < some.count() < 30 and R.slice_statistics(some).first().fg_min >= 0.3


def _png(pixels, colour, kinds):
    """A file whose lines use the given filters."""
    h, w, c = pixels.shape
    p, out = pixels.astype(int), []
    at = lambda y, x: p[y, x] if y >= 0 and x >= 0 else np.zeros(c, int)
    for y in range(h):
        line = [kinds[y % len(kinds)]]
        for x in range(w):
            a, b, d = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
            q = a + b - d
            near = [min((abs(q[i] - v[i]), k, v[i]) for k, v in enumerate((a, b, d)))[2] for i in range(c)]
            guess = [0 * a, a, b, (a + b) // 2, np.array(near)][line[0]]
            line += list((p[y, x] - guess) % 256)
        out.append(bytes(int(v) for v in line))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(out))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,c", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_all_line_filters(colour, c):
    pixels = np.random.default_rng(c).integers(0, 256, (11, 7, c))
    want = (pixels[..., :3].mean(-1) if c >= 3 else pixels[..., 0]) / 255
    assert np.allclose(png.decode_png(_png(pixels, colour, [0, 1, 2, 3, 4])), want)
    with pytest.raises(ValueError):
        png.decode_png(b"P5 1 1 255 x")


def test_round_trip():
    image = np.random.default_rng(0).integers(0, 256, (9, 5)) / 255
    assert np.allclose(png.decode_png(png.encode_png(image)), image)
