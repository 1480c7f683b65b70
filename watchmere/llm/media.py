"""Media columns: TIFF files in binary columns.

``write_tiff`` builds classic little-endian TIFF files of 8-bit grey samples, one
or more pages, in strips or tiles, uncompressed or with PackBits, LZW or deflate,
with or without the horizontal predictor.  ``read_tiff`` walks the chain of image
directories of either byte order, decodes the strips or tiles (either bit order,
samples together or in planes), undoes the predictor and yields one ``Page`` per
directory.  Whatever is wrong with a file becomes a ``TiffError``: sizes are held
against the file before anything is allocated.  ``pages`` is the DataFrame operator:
one row per page of every file of a binary column.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

# Fixed values of the format: tag numbers, codes of compressions, sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
FILL_ORDER, PLANAR = 266, 284
NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}

PAGE_WIDTH = 64
PAGE_ROWS = 1 << 15
BLOCK_ROWS = 4096
#: A page of more decoded bytes than this gives an error row instead.
MOST_BYTES = 1 << 30
#: No compression of the format yields more bytes from one than this.
MOST_GROWTH = 4096


class TiffError(ValueError):
    """The bytes are no TIFF file that this reader understands."""


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes


def packbits_encode(data: bytes) -> bytes:
    """PackBits: runs of three or more equal bytes as counts, the rest literally."""
    if not data:
        return b""
    a = np.frombuffer(data, np.uint8)
    cuts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
    long = np.flatnonzero(np.diff(cuts) >= 3)
    out, at = bytearray(), 0

    def literal(end):
        for i in range(at, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, e in zip(cuts[long].tolist(), cuts[long + 1].tolist()):
        literal(s)
        for i in range(s, e, 128):
            n = min(128, e - i)
            out.extend((257 - n, data[s]) if n > 1 else (0, data[s]))
        at = e
    literal(len(a))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


#: Numbers of codes after a clear at which LZW codes get wider than 9, 10 and 11 bits: one before entries 512, 1024 and 2048.
_WIDER = np.array([512, 1024, 2048]) - 258
LZW_CODES = 4096 - 258 - 1


def _widths(n: int) -> np.ndarray:
    """Bits of each of the n codes that follow a clear."""
    return np.searchsorted(_WIDER, np.arange(n), "right") + 9


def lzw_encode(data: bytes) -> bytes:
    """LZW of the TIFF kind: most significant bit first, clear 256, end 257, codes widen one entry early."""
    codes, sizes, table = [256], [9], {}
    since, w = 0, -1
    for b in data:
        if w < 0:
            w = b
            continue
        k = w << 8 | b
        known = table.get(k)
        if known is not None:
            w = known
            continue
        codes.append(w)
        since += 1
        table[k] = 257 + since
        if since == LZW_CODES:
            codes.append(256)
            sizes.append(since)
            table.clear()
            since = 0
        w = b
    if w >= 0:
        codes.append(w)
        since += 1
    codes.append(257)
    full = np.append(_widths(LZW_CODES), 12)
    width = np.concatenate([[9], *[full] * (len(sizes) - 1), _widths(since + 1)])
    bits = np.array(codes)[:, None] << (12 - width[:, None]) >> np.arange(11, -1, -1) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """At least size bytes, or what there is.  The codes between two clears are cut out at once, their widths being known."""
    a = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, total, at, since = [], 0, 0, 0  # at: the next code's first bit; since: codes after the last clear
    prev = b""
    while total < size:
        width = _widths(since + LZW_CODES)[since:]
        begin = at + np.concatenate([[0], np.cumsum(width)])
        n = int(np.searchsorted(begin[1:], 8 * len(data), "right"))
        if not n:
            break
        begin, width = begin[: n + 1], width[:n]
        byte = begin[:-1] >> 3
        codes = (a[byte] << 16 | a[byte + 1] << 8 | a[byte + 2]) >> (24 - (begin[:-1] & 7) - width) & ((1 << width) - 1)
        marks = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(marks[0]) if len(marks) else n
        for code in codes[:stop].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and prev:
                entry = prev + prev[:1]
            else:
                raise TiffError("LZW code out of range")
            if prev and len(table) < 4096:
                table.append(prev + entry[:1])
            out.append(entry)
            total += len(entry)
            prev = entry
        since += stop
        at = int(begin[min(stop + 1, n)])
        if len(marks):
            if codes[stop] == 257:
                break
            del table[258:]
            since, prev = 0, b""
    return b"".join(out)


_ENCODE = {NONE: lambda d: d, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1)}


def _decode(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        out = data
    elif kind == PACKBITS:
        out = packbits_decode(data, size)
    elif kind == LZW:
        out = lzw_decode(data, size)
    elif kind in (DEFLATE, 32946):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise TiffError(f"compression {kind}")
    if len(out) < size:
        raise TiffError("a strip or tile is too short")
    return out[:size]


def _difference(rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows: int = BLOCK_ROWS) -> bytes:
    """A TIFF file of 2-D uint8 pages; tile: (width, height), multiples of 16, else strips of ``rows`` rows."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        h, w = page.shape
        parts = []
        if tile:
            tw, th = tile
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    cell = np.zeros((th, tw), np.uint8)
                    got = page[y : y + th, x : x + tw]
                    cell[: got.shape[0], : got.shape[1]] = got
                    parts.append(cell)
        else:
            parts = [page[y : y + rows] for y in range(0, h, rows)]
        offsets, sizes = [], []
        for p in parts:
            data = _ENCODE[compression]((_difference(p) if predictor == 2 else np.ascontiguousarray(p)).tobytes())
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
            out += b"\0" * (len(out) & 1)
        place = (TILE_OFFSETS, TILE_BYTES) if tile else (STRIP_OFFSETS, STRIP_BYTES)
        tags = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8]), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), place[0]: (4, offsets), place[1]: (4, sizes)}
        if tile:
            tags |= {TILE_WIDTH: (4, [tile[0]]), TILE_HEIGHT: (4, [tile[1]])}
        else:
            tags[ROWS_PER_STRIP] = (4, [rows])
        if predictor != 1:
            tags[PREDICTOR] = (3, [predictor])
        fields = []
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                raw, at = struct.pack("<I", len(out)), raw
                out += at
            fields.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) & 1)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _tags(data: bytes, e: str, at: int, n: int) -> dict[int, tuple]:
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
        size = TYPE_SIZE.get(kind, 0) * count
        place = at + 10 + 12 * k
        if size > 4:
            place = struct.unpack_from(e + "I", data, place)[0]
        if kind in (1, 3, 4) and count and place + size <= len(data):
            tags[tag] = struct.unpack_from(f"{e}{count}{' B HI'[kind]}", data, place)
    return tags


def _page(data: bytes, tags: dict[int, tuple], index: int) -> Page:
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    samples, kind, predictor, planar = (tags.get(t, (1,))[0] for t in (SAMPLES, COMPRESSION, PREDICTOR, PLANAR))
    if not w or not h or not samples:
        raise TiffError("a page without samples")
    if any(b != 8 for b in tags.get(BITS, (8,))):
        raise TiffError("samples of other than 8 bits")
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor}")
    if planar not in (1, 2):
        raise TiffError(f"planar configuration {planar}")
    tiled = TILE_OFFSETS in tags
    if tiled:
        bw, bh = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]
        offsets, sizes = tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        bw, bh = w, min(tags.get(ROWS_PER_STRIP, (h,))[0], h)
        offsets, sizes = tags[STRIP_OFFSETS], tags[STRIP_BYTES]
    if not bw or not bh:
        raise TiffError("strips or tiles without samples")
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    across, down = -(-w // bw), -(-h // bh)
    if min(len(offsets), len(sizes)) < across * down * planes:
        raise TiffError("strips or tiles are missing")
    if max(w * h * samples, bw * bh * each) > min(MOST_BYTES, MOST_GROWTH * len(data)):
        raise TiffError("a page of more samples than the file can hold")
    image = np.empty((h, w, samples), np.uint8)
    for k in range(across * down * planes):
        plane, y, x = k // (across * down), k // across % down * bh, k % across * bw
        rows = bh if tiled else min(bh, h - y)
        if offsets[k] + sizes[k] > len(data):
            raise TiffError("a strip or tile is cut off")
        part = data[offsets[k] : offsets[k] + sizes[k]]
        if tags.get(FILL_ORDER, (1,))[0] == 2:
            part = np.packbits(np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little")).tobytes()
        cell = np.frombuffer(_decode(kind, part, rows * bw * each), np.uint8).reshape(rows, bw, each)
        if predictor == 2:
            cell = np.cumsum(cell, axis=1, dtype=np.uint8)
        nh, nw = min(rows, h - y), min(bw, w - x)
        image[y : y + nh, x : x + nw, plane : plane + each] = cell[:nh, :nw]
    return Page(index, w, h, samples, kind, predictor, tiled, image.tobytes())


def read_tiff(data: bytes):
    """Yield the pages of a TIFF file of 8-bit samples; TiffError if it can't be read."""
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    e = "<" if data[:1] == b"I" else ">"
    at, seen, index = struct.unpack_from(e + "I", data, 4)[0], set(), 0
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("broken chain of directories")
        seen.add(at)
        n = struct.unpack_from(e + "H", data, at)[0]
        if at + 2 + 12 * n + 4 > len(data):
            raise TiffError("a directory is cut off")
        try:
            page = _page(data, _tags(data, e, at, n), index)
        except KeyError as missing:
            raise TiffError(f"tag {missing} is missing") from None
        except (zlib.error, struct.error) as broken:
            raise TiffError(str(broken)) from None
        yield page
        at, index = struct.unpack_from(e + "I", data, at + 2 + 12 * n)[0], index + 1


def features(page: Page) -> tuple[float, float, float]:
    """Mean, standard deviation and mean horizontal gradient of a page's samples."""
    a = np.frombuffer(page.data, np.uint8).reshape(page.height, -1)
    # sums of small whole numbers: the same on every machine
    n = max(a.size, 1)
    hist = np.bincount(a.ravel(), minlength=256).astype(np.int64)
    level = np.arange(256, dtype=np.int64)
    mean = float((hist * level).sum()) / n
    var = float((hist * level * level).sum()) / n - mean * mean
    step = int(np.abs(np.diff(a.astype(np.int16), axis=1)).sum()) if a.shape[1] > 1 else 0
    return mean, max(var, 0.0) ** 0.5, step / n


def pages(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """One row per page of every file: key, page, width, height, samples, compression, predictor, tiled, data, error.

    A null or unreadable file gives one row with page -1 and the reason in
    ``error``; a file that breaks off gives its readable pages, then such a row.
    Repeated files give repeated rows; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        fields = ("page", "width", "height", "samples", "compression", "predictor", "tiled", "data", "error")
        schema = pa.schema([("key", pa.string()), *[(f, pa.bool_() if f == "tiled" else pa.binary() if f == "data" else pa.string() if f == "error" else pa.int32()) for f in fields]])
        for batch in batches:
            rows = []

            def out():
                got = pa.RecordBatch.from_pylist(rows, schema=schema)
                rows.clear()
                return got

            for key_, data in zip(batch.column(0), batch.column(1)):
                try:
                    if not data.is_valid:
                        raise TiffError("null")
                    for p in read_tiff(data.as_py()):
                        rows.append({"key": key_.as_py(), "page": p.index, "width": p.width, "height": p.height, "samples": p.samples, "compression": p.compression, "predictor": p.predictor, "tiled": p.tiled, "data": p.data, "error": None})
                        if sum(len(r.get("data") or b"") for r in rows) > 4 * kernel.BLOCK_BYTES:
                            yield out()
                except TiffError as e:
                    rows.append({"key": key_.as_py(), "page": -1, "error": str(e)})
            if rows:
                yield out()

    schema = "key string, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, data binary, error string"
    return files.select(F.col(key).cast("string").alias("key"), F.col(content).cast("binary").alias("content")).mapInArrow(run, schema)


def layout(n: int) -> dict:
    """Layout of a stored payload of n bytes by n // 64 % 8 alone: every way of storing is in use, at every size."""
    ways = {
        0: {"compression": NONE},
        1: {"compression": LZW},
        2: {"compression": PACKBITS, "tile": (16, 64)},
        3: {"compression": DEFLATE, "predictor": 2, "tile": (32, 32)},
        4: {"compression": DEFLATE, "rows": 16},
        5: {"compression": DEFLATE, "predictor": 2, "tile": (64, 64)},
    }
    return ways.get(n // 64 % 8, {"compression": DEFLATE, "predictor": 2})


def store_text(text: bytes) -> tuple[bytes, bytes]:
    """Padded payload of a text, and the TIFF file that holds it: pages of PAGE_WIDTH bytes a row, PAGE_ROWS rows at most."""
    payload = text + b"\0" * ((-len(text)) % 64 or (64 if not text else 0))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH)
    return payload, write_tiff([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], **layout(len(payload)))


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every text as TIFF samples, read the stored bytes back and describe what was read.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, pages.  A null text counts as empty; its payload is 64
    zero bytes.  A row's values depend on its text alone; repeated rows give
    repeated results, a null doc_id is passed through.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "pages": pa.int32()}
        for batch in batches:
            ids = batch.column("doc_id")
            for b in kernel.blocks(batch.column("text")):
                rows = []
                for i in range(b.hi - b.lo):
                    text = b.buf[b.offs[i] : b.offs[i + 1]].tobytes()
                    _, media = store_text(text)
                    digest, size, tail, marks = hashlib.sha256(), 0, b"", []
                    for page in read_tiff(media):
                        digest.update(page.data)
                        size += len(page.data)
                        tail = page.data[-64:]
                        marks.append("%dx%d:%.4f:%.4f:%.4f" % (page.width, page.height, *features(page)))
                    rows.append((ids[b.lo + i].as_py(), len(text), size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), ";".join(marks), len(marks)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
