"""Telephony audio in binary columns: mu-law, A-law and ADPCM, and the linear PCM they decode to.

Sound is stored as WAVE files. mu-law and A-law samples expand by tables of 256 values, which are built from the rule
of G.711. IMA ADPCM is decoded block by block in step: one numpy operation handles the same sample of all blocks of a
batch of files. Decoded sound at 8 kHz is stored again as 16-bit PCM at 16 kHz, by a half-band interpolation in integer
arithmetic, so that results are the same on every machine.

Lossless storage of any bytes: as 8-bit samples for mu-law and A-law; as pairs of 4-bit codes for ADPCM, in blocks of
192 bytes, each behind its own header.

Defined results: a null text counts as empty. An empty text is stored as 192 spaces. Texts are handled whole; a
batch holds about ``BATCH_BYTES`` of payload, or one longer text. Equal texts give equal values, whatever rows stand
around them. An empty table gives an empty result. A new column whose name a kept column has gets the first number that
is free (``media``, ``media_1``, ``media_2``).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framescope.llm.common import free_fields, free_name, quoted

RATE = 8000
UNIT = 192
BLOCK = 4 + UNIT
BATCH_BYTES = 2 << 20
# Fixed values of the WAVE format: format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
CODECS = {"mulaw": MULAW, "alaw": ALAW, "adpcm": IMA_ADPCM}
# Fixed values of IMA ADPCM: step sizes, and index changes by code.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
#: Half of a symmetric half-band filter, in units of 1 / 16384: the weights of the nearest, second, ... neighbours.
HALF_BAND = (10106, -2579, 827, -162)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(part == 0, low + 8, (low + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks: (blocks, bytes) to (blocks, samples), all blocks in step."""
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(head[:, 2].astype(np.int32), 88)
    data = np.ascontiguousarray(blocks[:, 4:].T)  # a row for each place in the blocks
    out = np.empty((1 + 2 * data.shape[0], blocks.shape[0]), dtype=np.int16)
    out[0] = value
    for k in range(2 * data.shape[0]):
        code = (data[k >> 1] >> (4 * (k & 1))) & 0x0F
        step = STEPS[index]
        change = step >> 3
        change += np.where(code & 4, step, 0)
        change += np.where(code & 2, step >> 1, 0)
        change += np.where(code & 1, step >> 2, 0)
        value += np.where(code & 8, -change, change)
        np.clip(value, -32768, 32767, out=value)
        index += INDEX_CHANGE[code]
        np.clip(index, 0, 88, out=index)
        out[k + 1] = value
    return out.T


def wave(tag: int, data: bytes, rate: int, bits: int, align: int, samples: int, samples_per_block: int = 0) -> bytes:
    """A mono WAVE file."""
    more = struct.pack("<H", samples_per_block) if tag == IMA_ADPCM else b""
    per_second = rate * align // max(1, samples_per_block)
    form = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + (b"" if tag == PCM else struct.pack("<H", len(more)) + more)
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, bytes per block and the data of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form, data = 12, b"", None
    while at + 8 <= len(media) and data is None:
        name, (n,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"fmt ":
            form = media[at + 8 : at + 8 + n]
        elif name == b"data":
            data = media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    if len(form) < 16 or data is None:
        raise ValueError("a WAVE file without format or data")
    tag, _, rate, _, align, _ = struct.unpack_from("<HHIIHH", form)
    return tag, rate, align, data


def pad(payload: bytes) -> bytes:
    """``payload`` with spaces up to a positive multiple of UNIT bytes."""
    return payload + b" " * (-len(payload) % UNIT or (0 if payload else UNIT))


def store(payload: bytes, codec: str) -> bytes:
    """``payload``, a multiple of UNIT bytes, as the samples of a WAVE file."""
    if codec != "adpcm":
        return wave(CODECS[codec], payload, RATE, 8, 1, len(payload))
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    blocks = np.zeros((len(units), BLOCK), np.uint8)
    blocks[:, 4:] = units
    return wave(IMA_ADPCM, blocks.tobytes(), RATE, 4, BLOCK, len(units) * (1 + 2 * UNIT), 1 + 2 * UNIT)


def stored_payload(media: bytes) -> bytes:
    """The bytes that ``store`` put into a file."""
    tag, _, align, data = read_wave(media)
    if tag != IMA_ADPCM:
        return data
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:]).tobytes()


def decode(files: Sequence[bytes]) -> list[np.ndarray]:
    """16-bit PCM of each file. ADPCM blocks of equal size are decoded together, whichever file they are from."""
    out: list[np.ndarray | None] = [None] * len(files)
    waiting: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, media in enumerate(files):
        tag, _, align, data = read_wave(media)
        codes = np.frombuffer(data, np.uint8)
        if tag == MULAW:
            out[k] = MULAW_TABLE[codes]
        elif tag == ALAW:
            out[k] = ALAW_TABLE[codes]
        elif tag == PCM:
            out[k] = np.frombuffer(data, "<i2")
        elif tag == IMA_ADPCM:
            waiting.setdefault(align, []).append((k, codes[: len(codes) // align * align].reshape(-1, align)))
        else:
            raise ValueError(f"WAVE format {tag} is not handled")
    for group in waiting.values():
        pcm, at = decode_adpcm(np.concatenate([b for _, b in group])), 0
        for k, blocks in group:
            out[k] = pcm[at : at + len(blocks)].reshape(-1)
            at += len(blocks)
    return out  # type: ignore[return-value]


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples themselves, and between any two the half-band filter's value."""
    reach = len(HALF_BAND)
    x = np.zeros(len(pcm) + 2 * reach, dtype=np.int32)
    x[reach : reach + len(pcm)] = pcm
    between = np.full(len(pcm), 8192, dtype=np.int32)
    for k, weight in enumerate(HALF_BAND):
        between += weight * (x[reach - k : reach - k + len(pcm)] + x[reach + 1 + k : reach + 1 + k + len(pcm)])
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[::2] = pcm
    out[1::2] = np.clip(between >> 14, -32768, 32767)
    return out


def features(pcm: np.ndarray) -> tuple[int, int, int, int]:
    """Samples, peak, mean square and sign changes."""
    wide = pcm.astype(np.int64)
    signs = pcm < 0
    return len(pcm), int(np.abs(wide).max(initial=0)), int((wide * wide).sum() // max(1, len(pcm))), int((signs[1:] != signs[:-1]).sum())


def codec_of(payload: bytes) -> str:
    """Spreads payloads over the codecs by their content."""
    return ("mulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]


FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("codec", T.StringType()), T.StructField("media", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("pcm", T.BinaryType()), T.StructField("samples", T.LongType()), T.StructField("peak", T.LongType()), T.StructField("mean_square", T.LongType()), T.StructField("sign_changes", T.LongType())]


def store_and_decode(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Store each text as telephony sound, read the stored file back, and decode it.

    The ``keep`` columns with ``n_bytes`` of the text, ``codec``, the stored file ``media``, the ``payload`` read back
    from it, the decoded and resampled ``pcm`` (a WAVE file), and features of that.
    """
    value = free_name(df, "value")
    source = df.select(*[quoted(k) for k in keep], quoted(text_col).cast("string").alias(value))
    made_fields = free_fields(keep, FIELDS)
    names = [*keep, *(f.name for f in made_fields)]
    schema = T.StructType([*(df.schema[k] for k in keep), *made_fields])
    kinds = [to_arrow_type(f.dataType) for f in FIELDS]
    n = len(keep)

    def part(batch: pa.RecordBatch, rows: list[int], texts: list[bytes]) -> pa.RecordBatch:
        padded = [pad(t) for t in texts]
        codecs = [codec_of(p) for p in padded]
        media = [store(p, c) for p, c in zip(padded, codecs, strict=True)]
        made: list[list] = [[] for _ in FIELDS]
        for text, codec, file, pcm in zip(texts, codecs, media, decode(media), strict=True):
            sound = double_rate(pcm)
            row = (len(text), codec, file, stored_payload(file), wave(PCM, sound.astype("<i2").tobytes(), 2 * RATE, 16, 2, len(sound)), *features(sound))
            for x, v in zip(made, row, strict=True):
                x.append(v)
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(n)] + [pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            texts: list[bytes] = []
            size = 0
            for k, value in enumerate(batch.column(n)):
                rows.append(k)
                texts.append((value.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield part(batch, rows, texts)
                    rows, texts, size = [], [], 0
            if rows:
                yield part(batch, rows, texts)

    return source.mapInArrow(run, schema)
