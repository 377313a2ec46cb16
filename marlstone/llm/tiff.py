"""TIFF as a media column: files are walked directory by directory, one row per page.

Read: both byte orders, strips and tiles, no compression, PackBits, LZW and
deflate, chunky and planar samples of 8, 16, 32 or 64 bits, and predictors 1 (none), 2 (horizontal differences)
and 3 (floating point).  Written: 8-bit grey pages, as strips or tiles, with any of these compressions.

Defined results: a null, empty or damaged file gives one row with page -1 and the
reason in `error`; pages that precede the damage are given too; a page that can't be in its file's bytes, or
in memory, counts as damage; repeated rows give their pages each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

# Fixed values of the format: tag numbers, type sizes and compression schemes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES, FORMAT = 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_CLEAR, _END = 256, 257

#: The shape in which payloads are stored.
PAYLOAD_WIDTH = 64
PAGE_ROWS = 1 << 14
STRIP_ROWS = 1 << 10


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: np.ndarray


# --- compression -----------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while i + run < n and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 2 < n and data[i] == data[i + 1] == data[i + 2]):
            i += 1
        out.append(i - start - 1)
        out += data[start:i]
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    acc = held = 0
    width = 9
    out = bytearray()

    def put(code: int) -> None:
        nonlocal acc, held
        acc, held = acc << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    table = {bytes((i,)): i for i in range(256)}
    size, prefix = 258, b""
    put(_CLEAR)
    for b in data:
        longer = prefix + bytes((b,))
        if longer in table:
            prefix = longer
            continue
        put(table[prefix])
        table[longer] = size
        size += 1
        # The width changes one code early; the table is dropped before 12 bits run out.
        if size == 4095:
            put(_CLEAR)
            table, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif size in (512, 1024, 2048):
            width += 1
        prefix = bytes((b,))
    if prefix:
        put(table[prefix])
        width += size + 1 in (512, 1024, 2048)
    put(_END)
    if held:
        out.append(acc << (8 - held) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, acc, held, previous = list(base), 9, 0, 0, b""
    out = bytearray()
    for b in data:
        acc, held = acc << 8 | b, held + 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == _END:
            break
        if code == _CLEAR:
            table, width, previous = list(base), 9, b""
            continue
        if not previous:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
            if len(table) in (511, 1023, 2047):
                width += 1
        out += entry
        previous = entry
    return bytes(out)


def _pack(data: bytes, scheme: int) -> bytes:
    if scheme == NONE:
        return data
    if scheme == DEFLATE:
        return zlib.compress(data, 1)
    return packbits_encode(data) if scheme == PACKBITS else lzw_encode(data)


#: No scheme here makes more bytes of one: LZW gives less than 4096 bytes for a code of 12 bits, deflate 1032 times its input.
MOST_GROWTH = 2731


def _unpack(data: bytes, scheme: int, want: int) -> bytes:
    """want: bytes that are needed; deflate stops there, so a block can't fill the memory."""
    if scheme == NONE:
        return data
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, want)
    if scheme == PACKBITS:
        return packbits_decode(data)
    if scheme == LZW:
        return lzw_decode(data)
    raise ValueError(f"compression {scheme}")


# --- writing ---------------------------------------------------------------


def encode(pages: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 2, tile: int = 0) -> bytes:
    """A little-endian file of 8-bit grey pages; tile: edge of square tiles (a multiple of 16), or 0 for strips."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            down, across = -(-height // tile), -(-width // tile)
            padded = np.zeros((down * tile, across * tile), np.uint8)
            padded[:height, :width] = page
            blocks = [padded[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] for y in range(down) for x in range(across)]
        else:
            blocks = [page[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            packed = _pack(np.ascontiguousarray(block).tobytes(), scheme)
            offsets.append(len(out))
            sizes.append(len(packed))
            out += packed
        tags = {WIDTH: [width], LENGTH: [height], BITS: [8], COMPRESSION: [scheme], PHOTOMETRIC: [1], SAMPLES: [1], PLANAR: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile], TILE_LENGTH: [tile], TILES: offsets, TILE_BYTES: sizes} if tile else {STRIPS: offsets, ROWS: [STRIP_ROWS], STRIP_BYTES: sizes}
        entries = b""
        for tag, values in sorted(tags.items()):
            raw = struct.pack(f"<{len(values)}I", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                place = struct.pack("<I", len(out))
                out += raw
                raw = place
            entries += struct.pack("<HHI", tag, 4, len(values)) + raw
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


# --- reading ---------------------------------------------------------------


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in _TYPES:
            continue
        code = _TYPES[kind]
        size = struct.calcsize(code) * count
        place = at + 10 + 12 * i
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + size > len(data):
            raise ValueError(f"tag {tag} lies outside the file")
        tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def _undo(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: rows x columns x samples."""
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    return block


def _undo_floats(raw: bytes, rows: int, columns: int, samples: int, size: int) -> np.ndarray:
    """Predictor 3: bytes are differenced along a row that holds all first bytes, then all second ones, ..."""
    planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, columns, samples)


def _page(data: bytes, tags: dict[int, tuple], order: str) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    bits, scheme, predictor, kind = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(FORMAT, 1)
    if bits not in (8, 16, 32, 64) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise ValueError(f"{tags.get(BITS)} bits a sample")
    dtype = np.dtype(("<" if order == "<" else ">") + ("f" if kind == 3 else "i" if kind == 2 else "u") + str(bits // 8))
    planes = samples if one(PLANAR, 1) == 2 else 1
    each = samples // planes
    tiled = TILES in tags
    rows, columns = (one(TILE_LENGTH, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS, height), height) or 1, width)
    offsets, sizes = (tags.get(TILES, ()), tags.get(TILE_BYTES, ())) if tiled else (tags.get(STRIPS, ()), tags.get(STRIP_BYTES, ()))
    across, down = -(-width // columns) if columns else 0, -(-height // rows)
    if len(offsets) != len(sizes) or len(offsets) < across * down * planes:
        raise ValueError("blocks are missing")
    if width * height * samples * dtype.itemsize > MOST_GROWTH * sum(sizes):
        raise ValueError("blocks are too short for the page")
    out = np.zeros((height, width, samples), dtype.newbyteorder("="))
    for i in range(across * down * planes):
        plane, rest = divmod(i, across * down)
        y, x = rest // across * rows, rest % across * columns
        tall = rows if tiled else min(rows, height - y)
        if offsets[i] + sizes[i] > len(data):
            raise ValueError("a block lies outside the file")
        want = tall * columns * each * dtype.itemsize
        if want > MOST_GROWTH * sizes[i]:
            raise ValueError("a block is too short")
        raw = _unpack(data[offsets[i] : offsets[i] + sizes[i]], scheme, want)
        if len(raw) < want:
            raise ValueError("a block is too short")
        if predictor == 3:
            block = _undo_floats(raw[:want], tall, columns, each, dtype.itemsize)
        else:
            block = _undo(np.frombuffer(raw[:want], dtype).astype(dtype.newbyteorder("=")).reshape(tall, columns, each), predictor, order)
        part = out[y : y + tall, x : x + columns]
        part[:, :, plane * each : (plane + 1) * each] = block[: part.shape[0], : part.shape[1]]
    return Page(width, height, samples, bits, scheme, predictor, out)


def pages(data: bytes) -> Iterator[Page]:
    """The pages in file order; raises ValueError or struct.error where the file is damaged."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        tags, following = _directory(data, at, order)
        yield _page(data, tags, order)
        at = following


_PAGES = "doc_id long, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def read_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page of every file; pixels are row by row, native byte order."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int32()) for c in ("page", "width", "height", "samples", "bits", "compression", "predictor")), ("pixels", pa.binary()), ("error", pa.string())])
        for ids, files in batches(rows, ["doc_id", "media"]):
            for i, data in zip(ids, files, strict=True):
                n = 0
                try:
                    for n, p in enumerate(pages(data or b""), 1):
                        yield pa.RecordBatch.from_pylist([{"doc_id": i, "page": n - 1, "width": p.width, "height": p.height, "samples": p.samples, "bits": p.bits, "compression": p.compression, "predictor": p.predictor, "pixels": p.pixels.tobytes(), "error": None}], schema)
                except (ValueError, struct.error, zlib.error, IndexError, MemoryError) as e:
                    yield pa.RecordBatch.from_pylist([{"doc_id": i, "page": -1, "error": str(e) or "damaged"}], schema)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, _PAGES)


# --- texts as pages --------------------------------------------------------


def payload_pages(payload: bytes) -> list[np.ndarray]:
    grid = np.frombuffer(payload, np.uint8).reshape(-1, PAYLOAD_WIDTH)
    return [grid[y : y + PAGE_ROWS] for y in range(0, len(grid), PAGE_ROWS)]


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of PAYLOAD_WIDTH, and its length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % PAYLOAD_WIDTH or (0 if raw else PAYLOAD_WIDTH)), len(raw)


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: int = DEFLATE) -> DataFrame:
    """doc_id, media: each whole text as a file of 8-bit grey pages, 64 pixels wide."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(rows, ["doc_id", "text"]):
            for at in range(0, len(ids), 256):
                files = [encode(payload_pages(padded(t)[0]), scheme) for t in texts[at : at + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 256], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, media binary")


def features(pixels: np.ndarray, n_pages: int) -> str:
    """Pages, mean, deviation, entropy in bits and mean horizontal step of the samples."""
    share = np.bincount(pixels.ravel(), minlength=256) / pixels.size
    level = np.arange(256)
    mean = float((share * level).sum())
    deviation = float(np.sqrt((share * (level - mean) ** 2).sum()))
    some = share[share > 0]
    steps = np.abs(np.diff(pixels.astype(np.int16), axis=1)).mean()
    return f"pages={n_pages};mean={mean:.4f};sd={deviation:.4f};entropy={abs(float(-(some * np.log2(some)).sum())):.4f};step={steps:.4f}"


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long"


def stored_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: int = DEFLATE) -> DataFrame:
    """Every text stored as a file, read back page by page, and described from what was read."""

    def row(i: int | None, text: str | None) -> dict:
        payload, n = padded(text)
        media = encode(payload_pages(payload), scheme)
        read = [p.pixels[:, :, 0] for p in pages(media)]
        pixels = np.concatenate(read)
        back = pixels.tobytes()
        return {"doc_id": i, "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": features(pixels, len(read)), "n_pages": len(read)}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = ("doc_id", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "n_pages")
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]
        schema = pa.schema([(c, pa.int64() if c in longs else pa.string()) for c in names])
        for ids, texts in batches(rows, ["doc_id", "text"]):
            yield pa.RecordBatch.from_pylist([row(i, t) for i, t in zip(ids, texts, strict=True)], schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _FEATURES)
