"""Media columns (operator 1): GIF images as binary columns.

``lzw_encode`` and ``lzw_decode`` handle GIF's variable-width LZW code streams,
``parse`` reads frames with palettes, interlacing, timing, transparency and disposal,
``composed`` draws them on the canvas as a viewer would, and ``frames`` stores the timed
frames of a media column as rows with colour-histogram columns. ``store_payloads`` keeps
arbitrary bytes losslessly as the 8-bit samples of a GIF, whose frames leave out what they
repeat (transparent, disposal 1); ``read_payloads`` reads them back through the same decoder
and canvas, with the frames' times and colour histograms. The query stores the media before
it reads them.

Defined cases: a null text is empty (a payload of padding alone); a null medium yields
no frames; bytes that aren't a whole GIF give one row whose ``error`` says why, and no
frames; equal inputs give equal rows; other columns are ignored. A canvas over
``MOST_PIXELS`` is reported as an error instead of being allocated.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

#: Samples of a row; payloads are padded to whole rows.
UNIT = 576
PAD = 255
ROWS = 64
DELAY_CS = 10
MOST_PIXELS = 1 << 26
_FULL = 4096  # entries of a code table
_BYTES = [bytes([i]) for i in range(256)]


def _runs(bits: int, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(width, first, last + 1) of the codes numbered start..stop-1 since the last clear code."""
    free = (1 << bits) + 1  # the decoder's table grows by one entry a code
    while start < stop:
        width = min(12, max(bits + 1, (free + start).bit_length()))
        end = stop if width == 12 else min(stop, (1 << width) - free)
        yield width, start, end
        start = end


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of samples below 1 << bits, without sub-block lengths."""
    clear, free = 1 << bits, (1 << bits) + 2
    out: list[np.ndarray] = []

    def pack(codes: list[int]) -> None:
        as_bits = np.unpackbits(np.array(codes, "<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
        out.extend(as_bits[a:b, :width].reshape(-1) for width, a, b in _runs(bits, 0, len(codes)))

    out.append(np.unpackbits(np.array([clear], "<u2").view(np.uint8), bitorder="little")[: bits + 1])
    if not data:
        pack([clear + 1])
        return np.packbits(np.concatenate(out), bitorder="little").tobytes()
    table: dict[int, int] = {}
    get = table.get
    codes: list[int] = []
    emit = codes.append
    now = data[0]
    for sample in data[1:]:
        key = now << 8 | sample
        longer = get(key)
        if longer is None:
            emit(now)
            table[key] = free
            free += 1
            now = sample
            if free == _FULL:
                emit(clear)
                pack(codes)
                table.clear()
                codes.clear()
                free = clear + 2
        else:
            now = longer
    emit(now)
    emit(clear + 1)
    pack(codes)
    return np.packbits(np.concatenate(out), bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream; raises ValueError at a code that can't be."""
    clear, end = 1 << bits, (1 << bits) + 1
    as_bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    base = _BYTES[:clear] + [b"", b""]
    at = made = 0
    out: list[bytes] = []
    table, previous, count = base.copy(), b"", 0
    while made < most:
        # the codes of one width
        width, _, last = next(_runs(bits, count, count + 4096))
        n = min(last - count, (len(as_bits) - at) // width)
        if n <= 0:
            break
        padded = np.zeros((n, 16), np.uint8)
        padded[:, :width] = as_bits[at : at + n * width].reshape(n, width)
        codes = np.packbits(padded, axis=1, bitorder="little").view("<u2").reshape(-1)
        special = np.flatnonzero((codes == clear) | (codes == end))
        if len(special):
            n = int(special[0])
        read = codes[:n].tolist()
        if read and not previous:
            if read[0] >= clear:
                raise ValueError("a code stream starts with an unknown code")
            previous = base[read[0]]
            out.append(previous)
            read = read[1:]
        for code in read:
            try:
                entry = table[code]
            except IndexError:
                if code != len(table) or code >= _FULL:
                    raise ValueError("a code isn't in the table") from None
                entry = previous + previous[:1]
            out.append(entry)
            if len(table) < _FULL:
                table.append(previous + entry[:1])
            previous = entry
        at += n * width
        count += n
        if len(special):
            at += width
            if codes[n] == end:
                break
            table, previous, count = base.copy(), b"", 0
            made = sum(map(len, out))
    return b"".join(out)[:most]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    palette: np.ndarray  # (colours, 3)
    samples: np.ndarray  # (height, width) palette indices


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = data[at]
        at += 1
        if not n:
            return b"".join(parts), at
        if at + n > len(data):
            raise ValueError("a sub-block is cut off")
        parts.append(data[at : at + n])
        at += n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise ValueError("a palette is cut off")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _rows_in_order(height: int) -> np.ndarray:
    """The row of each stored row of an interlaced frame."""
    return np.concatenate([np.arange(a, height, step) for a, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def parse(data: bytes) -> tuple[int, int, list[Frame]]:
    """(canvas width, canvas height, frames); raises ValueError if data isn't a whole GIF."""
    try:
        return _parse(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the file is cut off") from e


def _parse(data: bytes) -> tuple[int, int, list[Frame]]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > MOST_PIXELS:
        raise ValueError("the canvas is too large")
    at, shared, frames = 13, None, []
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    delay, disposal, transparent = 0, 0, None
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return width, height, frames
        if kind == 0x21:
            label = data[at]
            body, at = _sub_blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                packed, cs, index = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = cs * 10, packed >> 2 & 7, index if packed & 1 else None
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            at += 9
            palette = shared
            if flags & 0x80:
                palette, at = _palette(data, at, flags)
            if palette is None:
                raise ValueError("a frame has no palette")
            bits = data[at]
            if not 2 <= bits <= 8:
                raise ValueError("a code size that can't be")
            if w * h > MOST_PIXELS:
                raise ValueError("a frame is too large")
            stream, at = _sub_blocks(data, at + 1)
            samples = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8)
            if len(samples) < w * h:
                raise ValueError("a frame lacks samples")
            samples = samples.reshape(h, w)
            if flags & 0x40:
                laced, samples = samples, np.empty_like(samples)
                samples[_rows_in_order(h)] = laced
            frames.append(Frame(left, top, w, h, delay, disposal, transparent, palette, samples))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("an unknown block")


def composed(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The canvas (height, width, RGBA) as shown during each frame; valid until the next one."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        box = np.s_[f.top : min(f.top + f.height, height), f.left : min(f.left + f.width, width)]
        kept = canvas.copy() if f.disposal == 3 else None
        part = canvas[box]
        samples = f.samples[: part.shape[0], : part.shape[1]]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3] = f.palette
        colours[:, 3] = 255
        if f.transparent is None:
            part[...] = colours[samples]
        else:
            shown = samples != f.transparent
            part[shown] = colours[samples[shown]]
        yield canvas
        if f.disposal == 2:
            part[...] = 0
        elif f.disposal == 3:
            canvas = kept


def histogram(canvas: np.ndarray) -> list[list[int]]:
    """16 bins for each of red, green and blue, of the pixels that aren't transparent."""
    pixels = canvas[canvas[..., 3] > 0] if (canvas[..., 3] == 0).any() else canvas.reshape(-1, 4)
    return [np.bincount(pixels[:, c] >> 4, minlength=16).tolist() for c in range(3)]


def _blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)) + b"\0"


def build(width: int, height: int, palette: bytes, frames: list[dict]) -> bytes:
    """A GIF with one shared palette of 2**k colours. A frame has samples (bytes) and, each optional,
    left, top, width, height, delay_cs, disposal, transparent and palette."""
    bits = max(2, (len(palette) // 3 - 1).bit_length())
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | ((len(palette) // 3).bit_length() - 2), 0, 0), palette]
    for f in frames:
        own, clear = f.get("palette", b""), f.get("transparent")
        packed = f.get("disposal", 1) << 2 | (clear is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", packed, f.get("delay_cs", 0), clear or 0, 0))
        flags = 0x80 | ((len(own) // 3).bit_length() - 2) if own else 0
        out.append(b"\x2c" + struct.pack("<HHHHB", f.get("left", 0), f.get("top", 0), f.get("width", width), f.get("height", height), flags) + own)
        out.append(bytes([bits]) + _blocks(lzw_encode(f["samples"], bits)))
    return b"".join(out) + b"\x3b"


#: A payload's sample is the red of its colour; green and blue differ from it, so that a histogram has three columns.
_COLOURS = bytes(v for i in range(256) for v in (i, 255 - i, i * 73 % 256))
#: Says "as before" where a frame repeats what is shown; the byte occurs neither in UTF-8 nor as padding.
SAME = 254


def payload_gif(payload: bytes) -> bytes:
    """A GIF of UNIT columns whose frames, drawn over each other, show the payload (whole rows) in turn.

    A frame that repeats at least half of what is on the canvas leaves that out: its place is transparent.
    """
    rows = len(payload) // UNIT
    step = UNIT * ROWS
    canvas, frames = np.zeros(0, np.uint8), []
    for at in range(0, len(payload), step):
        part = payload[at : at + step]
        frame = {"samples": part, "height": len(part) // UNIT, "delay_cs": DELAY_CS, "disposal": 1}
        now = np.frombuffer(part, np.uint8)
        if at:
            same = now == canvas[: len(now)]
            if 2 * same.sum() >= len(now) and bytes([SAME]) not in part:
                frame |= {"samples": np.where(same, SAME, now).astype(np.uint8).tobytes(), "transparent": SAME}
        canvas = np.r_[now, canvas[len(now) :]]
        frames.append(frame)
    return build(UNIT, min(rows, ROWS), _COLOURS, frames)


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * ((-len(data)) % UNIT if data else UNIT)


def store_payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the padded UTF-8 bytes of each whole text, kept in a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([payload_gif(padded(t)) for t in texts], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return tables.doc_columns(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_FRAMES = "array<struct<frame:int,start_ms:bigint,delay_ms:bigint,red:array<bigint>,green:array<bigint>,blue:array<bigint>>>"
_FRAMES_ARROW = pa.list_(pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("red", "green", "blue"))]))


def read_payloads(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, payload, frames): what the frames, drawn on the canvas, hold; frames has their times and
    16-bin histograms of the rows that each one covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, told = [], []
            for data in batch.column("media").to_pylist():
                width, height, frames = parse(data)
                parts, timed, start = [], [], 0
                for i, (f, canvas) in enumerate(zip(frames, composed(width, height, frames))):
                    shown = canvas[: f.height]
                    parts.append(shown[..., 0].tobytes())
                    timed.append((i, start, f.delay_ms, *histogram(shown)))
                    start += f.delay_ms
                payloads.append(b"".join(parts))
                told.append([dict(zip(("frame", "start_ms", "delay_ms", "red", "green", "blue"), t)) for t in timed])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(told, _FRAMES_ARROW)], [*batch.schema.names, "payload", "frames"])

    return media.mapInArrow(run, f"doc_id long, n_bytes long, media binary, payload binary, frames {_FRAMES}")


def frames(media: DataFrame, key: str = "media_id", column: str = "media") -> DataFrame:
    """The timed frames of a media column: (key, frame, start_ms, delay_ms, width, height, rgba, red, green, blue, error)."""
    schema = f"{key} long, frame int, start_ms long, delay_ms long, width int, height int, rgba binary, red array<bigint>, green array<bigint>, blue array<bigint>, error string"
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def rows_of(name: int, data: bytes | None) -> Iterator[tuple]:
        if data is None:
            return
        try:
            width, height, parsed = parse(data)
        except ValueError as e:
            yield (name, *[None] * 9, str(e))
            return
        start = 0
        for i, (f, canvas) in enumerate(zip(parsed, composed(width, height, parsed))):
            yield (name, i, start, f.delay_ms, width, height, canvas.tobytes(), *histogram(canvas), None)
            start += f.delay_ms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in rows_of(name, data):  # a batch for each frame: an animation is never held whole in drawn form
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names)

    return media.select(F.col(key).cast("long").alias(key), F.col(column).cast("binary").alias(column)).mapInArrow(run, schema)


def _added(name: str) -> Column:
    """The frames' histograms of a colour, added up, as text."""
    zero = F.array_repeat(F.lit(0).cast("long"), 16)
    return F.array_join(F.aggregate("frames", zero, lambda t, f: F.zip_with(t, f[name], lambda a, b: a + b)).cast("array<string>"), ",")


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tables.store(store_payloads(tables.read(spark, sf_dir, "documents")), "media", codec="uncompressed")
    back = read_payloads(media)
    time = F.aggregate("frames", F.lit(0).cast("long"), lambda t, f: t + f["delay_ms"])
    text = F.concat_ws(";", F.concat(F.lit("frames="), F.size("frames")), F.concat(F.lit("ms="), time), *[F.concat(F.lit(f"{c}="), _added(c)) for c in ("red", "green", "blue")])
    return back.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), text.alias("feature"), "frames",
    )
