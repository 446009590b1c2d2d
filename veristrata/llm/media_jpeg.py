"""Baseline JPEG media columns.

A decoder for baseline JPEG (markers, Huffman scans, restart intervals, any
sampling factors) that reconstructs the DC-only luminance thumbnail, one sample
per 8x8 block, and an encoder that stores bytes as such samples: each byte is
the DC coefficient of one block, at a quantiser step of 8, where a flat block
of value b has the DC coefficient b - 128. Rows of blocks are restart
intervals, so numpy decodes many of them in step, one lane each.

The stored form of a payload is one JPEG, or several in a row where it exceeds
the 8,191 rows of blocks that fit one. Null and empty texts store one row of
spaces. Truncated or non-baseline data raise ValueError from the decoder.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.common import pieces, text_of
from veristrata.session import table

UNIT = 192
MOST_ROWS = 65528 // 8
STEP = 8

#: Code lengths of the encoder's own DC table: how many codes of each length, and the categories in order.
DC_COUNTS = (0, 1, 3, 3, 1, 1) + (0,) * 10
DC_VALUES = (6, 5, 4, 3, 7, 2, 1, 0, 8)
#: The encoder's AC table has the end of block only, and one code that never occurs.
AC_COUNTS = (1, 1) + (0,) * 14
AC_VALUES = (0, 1)

#: Fixed values of the JPEG standard: natural position of each zigzag index is not needed for DC-only output.
SOI, EOI, SOS, DQT, DHT, SOF0, DRI = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xC0, 0xDD


def huffman(counts, values) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), as the standard derives codes from counts."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def lookup(counts: tuple, values: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits ahead: symbol * 32 + code length (0: no such code), and for DC tables difference * 32 + all bits (0: they exceed 16)."""
    packed, whole = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)
    for symbol, (code, length) in huffman(counts, values).items():
        lo, hi = code << (16 - length), (code + 1) << (16 - length)
        packed[lo:hi] = symbol * 32 + length
        if length + symbol <= 16:
            raw = (np.arange(lo, hi) >> (16 - length - symbol)) & ((1 << symbol) - 1)
            whole[lo:hi] = np.where(raw < (1 << symbol >> 1), raw - (1 << symbol) + 1, raw) * 32 + length + symbol
    return packed, whole


@lru_cache(maxsize=1)
def encoder_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 to 255, end of block included."""
    codes, (eob, eob_length) = huffman(DC_COUNTS, DC_VALUES), huffman(AC_COUNTS, AC_VALUES)[0]
    bits, sizes = np.zeros(511, dtype=np.uint64), np.zeros(511, dtype=np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = codes[category]
        value = (code << category) | (d if d >= 0 else d + (1 << category) - 1)
        bits[d + 255], sizes[d + 255] = (value << eob_length) | eob, length + category + eob_length
    return bits, sizes


def segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def header(rows: int) -> bytes:
    out = bytes((0xFF, SOI)) + segment(DQT, bytes([0]) + bytes([STEP]) + bytes([1] * 63))
    out += segment(SOF0, bytes([8]) + (rows * 8).to_bytes(2, "big") + (UNIT * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    out += segment(DHT, bytes([0x00, *DC_COUNTS, *DC_VALUES])) + segment(DHT, bytes([0x10, *AC_COUNTS, *AC_VALUES]))
    return out + segment(DRI, UNIT.to_bytes(2, "big")) + segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))


def encode_rows(rows: np.ndarray, most: int = 1024) -> list[bytes]:
    """Entropy-coded, byte-stuffed data of each row of samples (rows x UNIT)."""
    bits, sizes = encoder_table()
    out: list[bytes] = []
    for k in range(0, len(rows), most):
        differences = np.diff(rows[k : k + most].astype(np.int16) - np.int16(128), axis=1, prepend=np.int16(0)) + np.int16(255)
        size = sizes[differences]
        ends = np.cumsum(size, axis=1)
        n_bytes = (ends[:, -1] + 7) >> 3
        offsets = np.cumsum(n_bytes) - n_bytes
        at = (ends - size + (offsets << 3)[:, None]).ravel()
        # A code has 17 bits at most, so one starts in each word of 32 and ends in the next at the latest.
        shifted = bits[differences].ravel() << (64 - size.ravel() - (at & 31)).astype(np.uint64)
        word = at >> 5
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.add.reduceat(shifted, starts)
        data = np.zeros(int(word[-1]) + 2, dtype=np.uint32)
        data[word[starts]] = (sums >> np.uint64(32)).astype(np.uint32)
        data[word[starts] + 1] += sums.astype(np.uint32)
        data = data.astype(">u4").view(np.uint8)[: int(n_bytes.sum())]
        data[offsets + n_bytes - 1] |= ((1 << ((n_bytes << 3) - ends[:, -1])) - 1).astype(np.uint8)
        full = np.flatnonzero(data == 0xFF)
        stuffed = np.insert(data, full + 1, 0).tobytes()
        edges = (offsets + np.searchsorted(full, offsets)).tolist() + [len(stuffed)]
        out += [stuffed[i:j] for i, j in zip(edges, edges[1:], strict=False)]
    return out


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload, a positive multiple of UNIT bytes long."""
    rows = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, UNIT)
    coded, out, k = encode_rows(rows), [], 0
    for payload in payloads:
        n, parts = len(payload) // UNIT, []
        for start in range(0, n, MOST_ROWS):
            here = min(MOST_ROWS, n - start)
            parts.append(header(here))
            for i in range(here):
                parts.append(coded[k])
                k += 1
                parts.append(bytes((0xFF, 0xD0 + i % 8)) if i < here - 1 else bytes((0xFF, EOI)))
        out.append(b"".join(parts))
    return out


class Frame:
    """What the markers of one JPEG say, and its entropy-coded intervals."""

    def __init__(self, data: bytes, at: int):
        self.tables: dict[int, tuple] = {}
        self.quantisers: dict[int, int] = {}
        self.interval = 0
        self.components: list[list[int]] = []
        self.intervals: list[tuple[int, int]] = []
        if data[at : at + 2] != bytes((0xFF, SOI)):
            raise ValueError("no start of image")
        at += 2
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("truncated, or no marker where one must be")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == EOI:
                raise ValueError("no scan")
            length = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == DQT:
                while body:
                    wide = body[0] >> 4
                    self.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == DHT:
                while body:
                    counts = tuple(body[1:17])
                    self.tables[body[0]] = (counts, tuple(body[17 : 17 + sum(counts)]))
                    body = body[17 + sum(counts) :]
            elif marker == DRI:
                self.interval = int.from_bytes(body[:2], "big")
            elif marker == SOF0:
                if body[0] != 8:
                    raise ValueError("samples of 8 bits only")
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.components = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(body[5])]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline frame")
            elif marker == SOS:
                for i in range(body[0]):
                    for c in self.components:
                        if c[0] == body[1 + 2 * i]:
                            c[4], c[5] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                break
        if not self.components:
            raise ValueError("no frame")
        start = at
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                raise ValueError("truncated scan")
            if data[at + 1] == 0:
                at += 2
            elif 0xD0 <= data[at + 1] <= 0xD7:
                self.intervals.append((start, at))
                at += 2
                start = at
            else:
                self.intervals.append((start, at))
                break
        self.end = at + 2 if data[at + 1] == EOI else at
        single = len(self.components) == 1
        self.h = 1 if single else max(c[1] for c in self.components)
        self.v = 1 if single else max(c[2] for c in self.components)
        self.mcus_x, self.mcus_y = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        #: Blocks of one MCU: component, tables, and whether it is luminance.
        self.blocks = [(k, c[4], c[5]) for k, c in enumerate(self.components) for _ in range(1 if single else c[1] * c[2])]


def decode_lanes(buffer: np.ndarray, starts: np.ndarray, units: np.ndarray, frame: Frame) -> np.ndarray:
    """DC values (lanes x MCUs x blocks of an MCU), all lanes in step; frame gives the tables."""
    wide = np.zeros(len(buffer) + 8, dtype=np.int32)
    wide[: len(buffer)] = buffer
    ahead = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    limit = (len(buffer) + 4) << 3
    n, most, blocks = len(starts), int(units.max(initial=0)), frame.blocks
    out = np.zeros((most, len(blocks), n), dtype=np.int16)
    order = np.argsort(-units, kind="stable")
    units, at = units[order], starts[order].astype(np.int32) * 8
    predicted = np.zeros((len(frame.components), n), dtype=np.int32)
    tables = [(lookup(*frame.tables[dc]), lookup(*frame.tables[0x10 | ac])[0]) for _, dc, ac in blocks]

    def peek(at):
        return (ahead[at >> 3] >> (8 - (at & 7))) & 0xFFFF

    for mcu in range(most):
        live = int(np.searchsorted(-units, -mcu, side="left"))
        here = at[:live]
        for b, (component, _, _) in enumerate(blocks):
            (codes, whole), ac = tables[b]
            window = peek(here)
            found = whole[window]
            long = np.flatnonzero(found & 31 == 0)
            difference, here = found >> 5, here + (found & 31)
            if len(long):  # codes whose bits exceed the window
                code = codes[window[long]]
                if not (code & 31).all():
                    raise ValueError("no such code")
                after, category = here[long] + (code & 31), code >> 5
                raw = peek(after) >> (16 - category)
                difference[long] = np.where(raw < (1 << category >> 1), raw - (1 << category) + 1, raw)
                here[long] = after + category
            predicted[component, :live] += difference
            out[mcu, b, :live] = predicted[component, :live]
            code = ac[peek(here)]
            here = here + (code & 31)
            if not (code & 31).all():
                raise ValueError("no such code")
            if not (code < 32).all():  # lanes with AC coefficients, which are read and left out
                going = np.flatnonzero(code >= 32)
                run, coefficient = code[going] >> 5, np.ones(len(going), dtype=np.int32)
                while len(going):
                    here[going] += run & 15
                    coefficient += (run >> 4) + 1
                    keep = coefficient < 64
                    going, coefficient = going[keep], coefficient[keep]
                    code = ac[peek(np.minimum(here[going], limit))]
                    if not (code & 31).all():
                        raise ValueError("no such code")
                    here[going] += code & 31
                    keep = code >= 32
                    going, coefficient, run = going[keep], coefficient[keep], code[keep] >> 5
            np.minimum(here, limit, out=here)
        at[:live] = here
    back = np.empty_like(order)
    back[order] = np.arange(n)
    return out.transpose(2, 0, 1)[back]


def unstuffed(data: bytes) -> bytes:
    return data.replace(b"\xff\x00", b"\xff")


def decode_frames(data: list[bytes], frames: list[list[Frame]], most_lanes: int = 1 << 13) -> list[list[np.ndarray]]:
    """The luminance thumbnail of each frame; frames with equal tables share the lanes."""
    alike: dict = {}
    for i, own in enumerate(frames):
        for j, f in enumerate(own):
            total = f.mcus_x * f.mcus_y
            step = f.interval or total
            lanes = alike.setdefault((tuple(sorted(f.tables.items())), tuple(f.blocks), len(f.components)), [])
            lanes += [(i, j, span, min(step, total - k * step)) for k, span in enumerate(f.intervals) if k * step < total]
    found: dict = {}
    for lanes in alike.values():
        for s in range(0, len(lanes), most_lanes):
            some = lanes[s : s + most_lanes]
            chunks = [unstuffed(data[i][a:b]) for i, _, (a, b), _ in some]
            sizes = np.array([len(c) for c in chunks], dtype=np.int64)
            dc = decode_lanes(np.frombuffer(b"".join(chunks), dtype=np.uint8), np.cumsum(sizes) - sizes, np.array([x[3] for x in some], dtype=np.int64), frames[some[0][0]][some[0][1]])
            for (i, j, _, units), x in zip(some, dc, strict=True):
                found.setdefault((i, j), []).append(x[:units])
    out: list[list[np.ndarray]] = []
    for i, own in enumerate(frames):
        out.append([])
        for j, f in enumerate(own):
            dc = np.concatenate(found[i, j])
            if len(dc) != f.mcus_x * f.mcus_y:
                raise ValueError("intervals are missing")
            first = f.components[0]
            h, v = (1, 1) if len(f.components) == 1 else (first[1], first[2])
            luma = dc[:, [b for b, x in enumerate(f.blocks) if x[0] == 0]].reshape(f.mcus_y, f.mcus_x, v, h).transpose(0, 2, 1, 3).reshape(f.mcus_y * v, f.mcus_x * h)
            wide, high = -(-f.width * h // (8 * f.h)), -(-f.height * v // (8 * f.v))
            samples = np.floor_divide(luma.astype(np.int64) * f.quantisers[first[3]] + 4, 8) + 128
            out[-1].append(np.clip(samples[:high, :wide], 0, 255).astype(np.uint8))
    return out


def decode_many(data: list[bytes]) -> list[list[np.ndarray]]:
    """Thumbnails of the frames that each byte string holds in a row."""
    frames = []
    for x in data:
        at, own = 0, []
        while at < len(x):
            own.append(Frame(x, at))
            at = own[-1].end
        frames.append(own)
    return decode_frames(data, frames)


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    """64 bits: which cell of an 8x8 grid of means exceeds the mean of all."""
    y, x = (np.arange(8) * n // 8 for n in thumbnail.shape)
    rows = np.add.reduceat(thumbnail.astype(np.float64), y, axis=0)
    cells = np.add.reduceat(rows, x, axis=1)
    area = np.outer(*(np.maximum(np.diff(np.append(np.arange(8) * n // 8, n)), 1) for n in thumbnail.shape))
    means = cells / area
    return np.packbits(means.ravel() > means.mean()).tobytes().hex()


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, media (the JPEG bytes), and the digests of what is read back from them."""
    return _media(docs, keep=True)


def _media(docs: DataFrame, keep: bool) -> DataFrame:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"] + ["media"] * keep
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height long" + ", media binary" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = [x.as_buffer().to_pybytes() for x in part.column(1)]
                stored = encode_many([t + b" " * ((-len(t)) % UNIT if t else UNIT) for t in texts])
                rows = []
                for doc_id, text, media, images in zip(part.column(0).to_pylist(), texts, stored, decode_many(stored), strict=True):
                    payload = b"".join(i.tobytes() for i in images)
                    height = sum(i.shape[0] for i in images)
                    whole = images[0] if len(images) == 1 else np.concatenate(images)
                    feature = f"{images[0].shape[1] * 8}x{height * 8}:{thumbnail_hash(whole)}"
                    rows.append((doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, images[0].shape[1] * 8, height * 8) + (media,) * keep)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    texts = {"payload_sha256", "media_sha256", "feature"}
    kinds = {n: pa.string() if n in texts else pa.int32() if n == "width" else pa.binary() if n == "media" else pa.int64() for n in names}
    return docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text")).mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _media(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)


QUERIES = {"op5_media_jpeg": op5}
ORACLE_SQL: dict[str, str] = {}
