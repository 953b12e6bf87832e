"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images, written as NPY tiles with difference hashes.

Defined results: a null text counts as empty; an empty payload is padded to one row of pixels; rows with equal texts get equal values; null ids pass through; only the named columns are read, so others may clash freely. Media bytes that can't be decoded give null features.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from loam.llm.common import column, map_batches, texts

WIDTH, UNIT = 64, 192  # pixels in a row; bytes in a row of RGB pixels


def encode_ppm(payload: bytes) -> bytes:
    """A binary pixmap (P6) of 64 RGB pixels a row; the payload's length is a multiple of 192."""
    return b"P6\n%d %d\n255\n" % (WIDTH, len(payload) // UNIT) + payload


def encode_bmp(a: np.ndarray) -> bytes:
    """An uncompressed 24-bit bitmap, bottom row first, of an array (height, width, 3)."""
    h, w, _ = a.shape
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = a[::-1, :, ::-1].reshape(h, w * 3)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[:2], 2, []
    while len(head) < (2 if kind in (b"P1", b"P4") else 3):
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        head.append(int(data[at:end]))
        at = end
    w, h = head[:2]
    top = head[2] if len(head) > 2 else 1
    if not w or not h or not 0 < top < 65536:
        raise ValueError("no pixels, or no range of samples")
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P5", b"P6"):
        a = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * depth, at + 1)
    elif kind == b"P4":
        a = 1 - np.unpackbits(np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1), axis=1)[:, :w].ravel()
    elif kind == b"P1":
        a = 1 - np.array([c - 48 for c in data[at:] if c in b"01"][: w * h], np.uint8)
    else:
        a = np.array(data[at:].split()[: w * h * depth], np.int64)
    if top != 255:
        a = (a.astype(np.uint32) * 255 + top // 2) // top
    return a.astype(np.uint8).reshape(h, w, depth)


def _bmp(data: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", data, 10)[0]
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed bitmaps of 8, 24 or 32 bits")
    if w <= 0 or not h:
        raise ValueError("no pixels")
    step, tall = (w * bits // 8 + 3) // 4 * 4, abs(h)
    a = np.frombuffer(data, np.uint8, step * tall, start).reshape(tall, step)[:, : w * bits // 8].reshape(tall, w, bits // 8)
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, start - 14 - size, 14 + size).reshape(-1, 4)[:, 2::-1]
        a = palette[a[:, :, 0]]
    else:
        a = a[:, :, 2::-1]
    return a[::-1] if h > 0 else a


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 1 or 3) of a Netpbm (P1 to P6) or BMP file, 8 bits a sample."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _between(edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For edges among n cells, the cell that each falls into and how far."""
    lo = np.minimum(edges.astype(int), n - 1)
    return lo, edges - lo


def area_resize(a: np.ndarray, height: int, width: int, rows: int = 4096) -> np.ndarray:
    """Mean over each target cell's exact area, from an integral image; fractional borders are interpolated. The integral image is made in blocks of rows, of which only those at the target's borders are kept."""
    h, w = a.shape[:2]
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    (y, dy), (x, dx) = _between(ys, h), _between(xs, w)
    wanted = np.unique(np.r_[y, y + 1])
    kept = np.zeros((len(wanted), w + 1, *a.shape[2:]))  # the wanted rows of the integral image; row 0 is empty
    above = np.zeros((w, *a.shape[2:]))
    for at in range(0, h, rows):
        s = a[at : at + rows].astype(np.float64).cumsum(1).cumsum(0) + above
        here = np.flatnonzero((wanted > at) & (wanted <= at + len(s)))
        kept[here, 1:] = s[wanted[here] - 1 - at]
        above = s[-1]
    fit = lambda part, axis: part.reshape([-1 if i == axis else 1 for i in range(a.ndim)])
    low, high = (kept[np.searchsorted(wanted, i)] for i in (y, y + 1))
    s = low * (1 - fit(dy, 0)) + high * fit(dy, 0)
    c = s[:, x] * (1 - fit(dx, 1)) + s[:, x + 1] * fit(dx, 1)
    return (c[1:, 1:] - c[:-1, 1:] - c[1:, :-1] + c[:-1, :-1]) * (height * width / (h * w))


def grey(a: np.ndarray) -> np.ndarray:
    return a[:, :, 0].astype(np.float64) if a.shape[2] == 1 else a @ np.array([0.299, 0.587, 0.114])


def difference_hash(a: np.ndarray) -> str:
    """64 bits as hex: whether each cell of the 8 x 9 grey thumbnail is brighter than the next in its row."""
    g = area_resize(grey(a), 8, 9)
    return np.packbits(g[:, 1:] > g[:, :-1] + 1e-9).tobytes().hex()


def npy_tile(a: np.ndarray, size: int = 16) -> bytes:
    """The image area-resized to size x size, as the bytes of an NPY file of 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(a, size, size)).clip(0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def store_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as pixmaps: (doc_id, n_bytes, media)."""

    def run(b):
        raw = [x.encode() for x in texts(b, text_col)]
        return {"doc_id": column(b, id_col), "n_bytes": [len(x) for x in raw], "media": [encode_ppm(x.ljust(max(1, -(-len(x) // UNIT)) * UNIT)) for x in raw]}

    return map_batches(docs.select(id_col, text_col), run, "doc_id long, n_bytes long, media binary", 200)


def features(media: DataFrame, tile: int = 16) -> DataFrame:
    """Decoded from the stored bytes: pixel payload digests, difference hash and NPY tile, beside the other columns' ids."""

    def run(b):
        rows = []
        for x in column(b, "media").to_pylist():
            try:
                a = decode(x)
            except (ValueError, TypeError, IndexError, struct.error):
                rows.append((None, None, None, None if x is None else len(x), None if x is None else hashlib.sha256(x).hexdigest(), None, None))
                continue
            p = a.tobytes()
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(x), hashlib.sha256(x).hexdigest(), difference_hash(a), npy_tile(a, tile)))
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")
        return {"doc_id": column(b, "doc_id"), "n_bytes": column(b, "n_bytes")} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return map_batches(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary", 200)


def write_tiles(media: DataFrame, path: str, tile: int = 16) -> None:
    """Write the NPY tiles with their difference hashes as a Parquet dataset of (doc_id, feature, tile)."""
    features(media, tile).select("doc_id", "feature", "tile").write.parquet(path)
