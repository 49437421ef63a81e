"""GeoTIFF: band 1 of rasters, read by strip or tile.

`read_geotiff` gives (path, row, col, lat, lon, value).  Row 0 is north.  Coordinates are those
of the transform at whole rows and columns: of an area raster a cell's corner, of a point raster
its point less half a cell.  The no-data value and NaN are NULL.

Classic TIFF and BigTIFF in either byte order; strips and tiles; bands interleaved or apart;
integers of 8 to 64 bits and floats of 32 and 64; uncompressed, PackBits, LZW and Deflate; the
horizontal predictor and the one for floats.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hydroloom.sources.ranged import Format, Part, RangedFile, RangedSource, load

#: Fixed values of the format: tags by name.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_bytes": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_bytes": 325, "sample_format": 339, "scale": 33550, "tie": 33922, "matrix": 34264, "keys": 34735, "no_data": 42113}
#: Fixed values of the format: number types by code, compressions, predictors, kinds of samples, and the key of the raster's type.
TYPES = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 6: "i1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
HORIZONTAL, FLOATING = 2, 3
KINDS = {1: "u", 2: "i", 3: "f"}
RASTER_TYPE, IS_POINT = 1025, 2
CLEAR, END = 256, 257


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit on, 9 to 12 bits wide, widened one code early."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, at, last = [], 9, 0, None
    size = 8 * len(data)
    while at + width <= size:
        byte, bit = divmod(at, 8)
        code = int.from_bytes(data[byte : byte + 3].ljust(3, b"\0"), "big") >> (24 - bit - width) & ((1 << width) - 1)
        at += width
        if code == END:
            break
        if code == CLEAR:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("damaged LZW data")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) + 1 >> width and width < 12:
                width += 1
        out.append(entry)
        last = entry
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    """What `unpack_lzw` reads."""
    codes = []
    table, last, width = {bytes([i]): i for i in range(256)}, b"", 9
    codes.append((CLEAR, 9))
    for i in range(len(data)):
        longer = last + data[i : i + 1]
        if longer in table:
            last = longer
            continue
        codes.append((table[last], width))
        table[longer] = len(table) + 2
        last = data[i : i + 1]
        if len(table) + 2 > (1 << width) - 1:
            width += 1
        if len(table) + 2 >= 4094:
            codes.append((CLEAR, 12))
            table, width = {bytes([i]): i for i in range(256)}, 9
    if last:
        codes.append((table[last], width))
        if len(table) + 3 > (1 << width) - 1 and width < 12:
            width += 1
    codes.append((END, width))
    bits = "".join(format(code, f"0{width}b") for code, width in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def unpack_bits(data: bytes) -> bytes:
    """PackBits: runs of a byte, and bytes as they are."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
    return b"".join(out)


class Directory:
    """The first image directory of a file."""

    def __init__(self, file: RangedFile):
        head = file.read(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack_from(f"{self.order}H", head, 2)[0] if self.order else 0
        if magic not in (42, 43):
            raise ValueError(f"{file.path}: no TIFF file")
        big = magic == 43
        at = struct.unpack_from(f"{self.order}Q", head, 8)[0] if big else struct.unpack_from(f"{self.order}I", head, 4)[0]
        count, size, inner = ("Q", 20, 8) if big else ("H", 12, 4)
        n = struct.unpack(f"{self.order}{count}", file.read(at, struct.calcsize(count)))[0]
        raw = file.read(at + struct.calcsize(count), n * size)
        found = {}
        for i in range(n):
            tag, kind = struct.unpack_from(f"{self.order}HH", raw, i * size)
            many = struct.unpack_from(f"{self.order}{'Q' if big else 'I'}", raw, i * size + 4)[0]
            if tag not in TAGS.values() or kind not in TYPES:
                continue
            dtype = np.dtype(self.order + TYPES[kind])
            room = i * size + size - inner
            held = raw[room : room + inner]
            if many * dtype.itemsize > inner:
                held = file.read(struct.unpack(f"{self.order}{'Q' if big else 'I'}", held)[0], many * dtype.itemsize)
            found[tag] = held[:many] if TYPES[kind] == "S1" else np.frombuffer(held, dtype, many)
        get = lambda name, default=None: found.get(TAGS[name], default)
        one = lambda name, default: int(get(name, [default])[0])
        self.width, self.height = one("width", 0), one("height", 0)
        self.samples, self.apart = one("samples", 1), one("planar", 1) == 2
        bits, kind = one("bits", 1), one("sample_format", 1)
        if bits not in (8, 16, 32, 64) or kind not in KINDS or (kind == 3 and bits < 32):
            raise ValueError(f"{file.path}: samples of {bits} bits, kind {kind}")
        self.type = np.dtype(f"{self.order}{KINDS[kind]}{bits // 8}")
        self.compression, self.predictor = one("compression", NONE), one("predictor", 1)
        self.tiled = get("tile_offsets") is not None
        self.block = (one("tile_height", 0), one("tile_width", 0)) if self.tiled else (min(one("rows_per_strip", self.height), self.height), self.width)
        self.offsets, self.sizes = (get(f"{'tile' if self.tiled else 'strip'}_{x}") for x in ("offsets", "bytes"))
        mark = get("no_data")
        try:
            self.no_data = float(bytes(mark).split(b"\0")[0]) if mark is not None else None
        except ValueError:
            self.no_data = None
        self.origin, self.step = self._transform(get("scale"), get("tie"), get("matrix"), get("keys"))

    @staticmethod
    def _transform(scale, tie, matrix, keys) -> tuple[tuple[float, float], tuple[float, float]]:
        """(x, y) of row and column 0, and their steps; rows and columns where there is no transform."""
        if matrix is not None:
            if matrix[1] or matrix[4]:
                raise ValueError("rotated rasters have no axes")
            origin, step = (float(matrix[3]), float(matrix[7])), (float(matrix[0]), float(matrix[5]))
        elif scale is not None and tie is not None:
            step = (float(scale[0]), -float(scale[1]))
            origin = (float(tie[3] - tie[0] * step[0]), float(tie[4] - tie[1] * step[1]))
        else:
            return (0.0, 0.0), (1.0, 1.0)
        entries = np.asarray(keys[4:]).reshape(-1, 4).tolist() if keys is not None else []
        if any(k == RASTER_TYPE and where == 0 and value == IS_POINT for k, where, _, value in entries):
            origin = (origin[0] - step[0] / 2, origin[1] - step[1] / 2)
        return origin, step

    def blocks(self) -> Iterator[tuple[int, int, int, int]]:
        """(first row, first column, offset, bytes) of band 1's strips or tiles."""
        across = -(-self.width // self.block[1])
        down = -(-self.height // self.block[0]) if self.block[0] else 0
        for i in range(across * down):
            yield i // across * self.block[0], i % across * self.block[1], int(self.offsets[i]), int(self.sizes[i])

    def layout(self) -> dict:
        """What decoding a block needs."""
        return {k: getattr(self, k) for k in ("order", "width", "height", "samples", "apart", "type", "compression", "predictor", "tiled", "block", "no_data", "origin", "step")}


def decode_block(data: bytes, rows: int, cols: int, samples: int, dtype: np.dtype, compression: int, predictor: int) -> np.ndarray:
    """Numbers (rows, cols) of the first of `samples` interleaved bands."""
    if compression == LZW:
        data = unpack_lzw(data)
    elif compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif compression == PACKBITS:
        data = unpack_bits(data)
    elif compression != NONE:
        raise ValueError(f"compression {compression} has no decoder")
    need = rows * cols * samples * dtype.itemsize
    if len(data) < need:
        raise ValueError("a block ends too early")
    if predictor == FLOATING:
        # the bytes of a row's numbers stand highest ones first, each as what it is more than the one before
        raw = np.frombuffer(data, "u1", need).reshape(rows, -1, samples).cumsum(1, dtype="u1").reshape(rows, dtype.itemsize, cols * samples)
        values = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(f">f{dtype.itemsize}")[..., 0].reshape(rows, cols, samples)
    else:
        values = np.frombuffer(data, dtype, rows * cols * samples).reshape(rows, cols, samples)
        if predictor == HORIZONTAL:
            plain = np.dtype(f"u{dtype.itemsize}")
            values = values.astype(dtype.newbyteorder("=")).view(plain).cumsum(1, dtype=plain).view(dtype.newbyteorder("="))
    return values[..., 0]


class GeoTiff(Format):
    schema = "path string, row int, col int, lat double, lon double, value double"

    def parts(self, file: RangedFile) -> Iterator[Part]:
        head = Directory(file)
        layout = head.layout()
        for row, col, offset, size in head.blocks():
            yield Part(size, {}, (layout, row, col, offset, size))

    def batches(self, file: RangedFile, part: Part) -> Iterator[pa.RecordBatch]:
        lay, row, col, offset, size = part.what
        # the last strip is as high as what is left, a tile always whole
        height = lay["block"][0] if lay["tiled"] else min(lay["block"][0], lay["height"] - row)
        if size:
            value = decode_block(file.read(offset, size), height, lay["block"][1], 1 if lay["apart"] else lay["samples"], lay["type"], lay["compression"], lay["predictor"]).astype("f8")
        else:
            value = np.full((height, lay["block"][1]), np.nan)  # a sparse file leaves blocks out
        value = value[: lay["height"] - row, : lay["width"] - col]
        rows, cols = (np.arange(n) + at for n, at in zip(value.shape, (row, col), strict=True))
        lat, lon = lay["origin"][1] + rows * lay["step"][1], lay["origin"][0] + cols * lay["step"][0]
        if lay["step"][1] > 0:
            rows = lay["height"] - 1 - rows  # south first in the file
        value = value.ravel()
        nothing = np.isnan(value)
        if lay["no_data"] is not None and not math.isnan(lay["no_data"]):
            # written as decimal digits, which a float of 32 bits need not equal
            nothing |= value == (lay["no_data"] if lay["type"].itemsize == 8 or lay["type"].kind != "f" else float(np.float32(lay["no_data"])))
        every = lambda x, kind: pa.array(np.repeat(x, len(cols)).astype(kind))
        tiled = lambda x, kind: pa.array(np.tile(x, len(rows)).astype(kind))
        yield pa.RecordBatch.from_arrays([pa.array([file.path] * len(value), pa.string()), every(rows, "i4"), tiled(cols, "i4"), every(lat, "f8"), tiled(lon, "f8"), pa.array(value, mask=nothing)], names=["path", "row", "col", "lat", "lon", "value"])


class GeoTiffSource(RangedSource):
    format = GeoTiff

    @classmethod
    def name(cls) -> str:
        return "hydroloom_geotiff"


def read_geotiff(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, row, col, lat, lon, value) of the rasters' first bands; an empty folder gives no rows."""
    return load(spark, GeoTiffSource, path, **options)


def encode(value: np.ndarray, north: float, west: float, step: float, no_data: float | None = None, compression: int = NONE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 0, order: str = "<", point: bool = False) -> bytes:
    """The bytes of a TIFF file with one band, row 0 at `north`; for files that other programs read, and for tests."""
    value = np.asarray(value)
    dtype = value.dtype.newbyteorder(order)
    height, width = value.shape
    block = tile or (rows_per_strip or height, width)
    blocks = []
    for row in range(0, height, block[0]):
        for col in range(0, width, block[1]):
            part = value[row : row + block[0], col : col + block[1]]
            if tile:
                part = np.pad(part, [(0, b - n) for b, n in zip(block, part.shape, strict=True)])
            if predictor == HORIZONTAL:
                raw = part.view(f"u{dtype.itemsize}")
                part = np.concatenate((raw[:, :1], np.diff(raw, axis=1)), axis=1).view(part.dtype)
            data = part.astype(dtype).tobytes()
            if predictor == FLOATING:
                planes = np.ascontiguousarray(part.astype(f">f{dtype.itemsize}")).view("u1").reshape(*part.shape, -1).transpose(0, 2, 1).reshape(len(part), -1)
                data = np.concatenate((planes[:, :1], np.diff(planes, axis=1)), axis=1).tobytes()
            blocks.append(pack_lzw(data) if compression == LZW else zlib.compress(data) if compression in (DEFLATE, OLD_DEFLATE) else data)
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    offset = 8 + np.concatenate(([0], np.cumsum([len(b) for b in blocks])[:-1]))
    tags = {
        "width": ("I", [width]), "height": ("I", [height]), "bits": ("H", [8 * dtype.itemsize]), "compression": ("H", [compression]), "samples": ("H", [1]),
        "predictor": ("H", [predictor]), "sample_format": ("H", [kind]), "scale": ("d", [step, step, 0.0]), "tie": ("d", [0.0, 0.0, 0.0, west, north, 0.0]),
        "keys": ("H", [1, 1, 0, 1, RASTER_TYPE, 0, 1, IS_POINT if point else 1]),
    } | ({"tile_width": ("I", [block[1]]), "tile_height": ("I", [block[0]])} if tile else {"rows_per_strip": ("I", [block[0]])})
    tags |= {f"{'tile' if tile else 'strip'}_offsets": ("I", offset.tolist()), f"{'tile' if tile else 'strip'}_bytes": ("I", [len(b) for b in blocks])}
    if no_data is not None:
        tags["no_data"] = ("s", f"{no_data:g}\0".encode())
    codes = {"s": 2, "H": 3, "I": 4, "d": 12}
    body = b"".join(blocks)
    body += b"\0" * (len(body) % 2)
    at = 8 + len(body)
    entries, beyond, free = [], b"", at + 2 + 12 * len(tags) + 4
    for name, (code, numbers) in sorted(tags.items(), key=lambda x: TAGS[x[0]]):
        held = numbers if code == "s" else struct.pack(f"{order}{len(numbers)}{code}", *numbers)
        if len(held) > 4:
            place, beyond = struct.pack(f"{order}I", free + len(beyond)), beyond + held + b"\0" * (len(held) % 2)
        else:
            place = held.ljust(4, b"\0")
        entries.append(struct.pack(f"{order}HHI", TAGS[name], codes[code], len(numbers)) + place)
    head = {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, at)
    return head + body + struct.pack(f"{order}H", len(tags)) + b"".join(entries) + struct.pack(f"{order}I", 0) + beyond
