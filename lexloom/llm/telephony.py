r"""Media columns for telephony audio: mu-law, A-law and IMA ADPCM in WAV files, decoded, resampled, stored as PCM.

`encode` turns each text into one audio file. The payload is the text in UTF-8 with bytes 255 behind it up to a
positive multiple of 576. For mu-law and A-law its bytes are the 8-bit samples; for ADPCM each 576 bytes are the 1152
codes of a block of their own, behind the four header bytes that the format asks for. Without a given codec the
payload's CRC-32 picks one, so equal texts have equal files. `decode` reads the files back: the companded codes are
expanded through tables of 256 entries, ADPCM blocks are decoded step by step across all blocks of a batch at once,
and the samples are resampled by a fixed-point windowed sinc, so that every machine gives the same bits. `store`
writes files and PCM as a Parquet table. `measures` has what a query needs of each file without its PCM.

Work is done in slices of at most SLICE bytes and, within a long text, windows of WINDOW samples and runs of RUN
blocks; beyond the text itself and its file memory does not grow with a text's length.

Edge cases: a null text is empty, its payload 576 bytes of 255. Rows are encoded one by one, whatever their id; null
and equal ids stay as they are. An empty table gives no rows. A file that is no such WAV file, or null, gives null
measures and its reason. Only id and text are read; extra columns with any name do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, documents, fresh

UNIT, RATE, RATE_OUT = 576, 8000, 16_000
SLICE, WINDOW, RUN = 4 << 20, 1 << 20, 4096
CODECS = ("mulaw", "alaw", "adpcm")
#: Fixed values of the WAV format: the tags of the three codecs and of PCM.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}
#: Fixed values of IMA ADPCM: the step sizes and the moves of the step's index by the code's lower bits.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)
BLOCK_SAMPLES = 2 * UNIT + 1


def mulaw_table() -> np.ndarray:
    """Samples of the 256 mu-law codes."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Samples of the 256 A-law codes."""
    code = np.arange(256) ^ 0x55
    chord, step = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(chord == 0, step + 8, step + 0x108 << np.maximum(chord - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each (step index, code): the change of the sample, and 16 times the next step index."""
    step, code = np.asarray(STEPS)[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    following = np.clip(np.arange(len(STEPS))[:, None] + np.asarray(MOVES)[code & 7], 0, len(STEPS) - 1) * 16
    return np.where(code & 8, -change, change).ravel().astype(np.int32), following.ravel().astype(np.int32)


def decode_blocks(blocks: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Samples of ADPCM blocks, one row each: (n, 4 + bytes) to (n, 1 + 2 * bytes); one NumPy step for each code of a block."""
    change, following = tables
    head = blocks[:, :4].copy()
    sample = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    at = np.minimum(head[:, 2].astype(np.int32), len(STEPS) - 1) * 16
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(body), len(blocks)), np.int16)
    out[0] = sample
    for i, byte in enumerate(body):
        for j, code in enumerate((byte & 15, byte >> 4)):
            at += code
            sample += change[at]
            np.clip(sample, -32768, 32767, out=sample)
            at = following[at]
            out[2 * i + j + 1] = sample
    return np.ascontiguousarray(out.T)


class Resampler:
    """A windowed sinc in 15-bit fixed point, one set of weights for each phase."""

    def __init__(self, rate: int, rate_out: int, lobes: int = 8):
        self.up, self.down = rate_out // gcd(rate, rate_out), rate // gcd(rate, rate_out)
        narrow = min(1.0, self.up / self.down)
        self.half = int(np.ceil(lobes / narrow))
        self.weights = []
        for j in range(self.up):
            x = np.arange(-self.half + 1, self.half + 1) - (j * self.down % self.up) / self.up
            w = np.sinc(x * narrow) * (0.5 + 0.5 * np.cos(np.pi * np.clip(x / self.half, -1, 1)))
            fixed = np.rint(w / w.sum() * 32768).astype(np.int64)
            fixed[self.half - 1] += 32768 - fixed.sum()  # a constant stays as it is
            self.weights.append(fixed)

    def window(self, x: np.ndarray, n: int) -> np.ndarray:
        """Outputs of n inputs; x has half inputs more on both sides, and n is a multiple of down or the last."""
        out = np.empty(-(-n * self.up // self.down), np.int16)
        for j in range(self.up):
            n_out = len(out[j :: self.up])
            first, total = j * self.down // self.up + 1, np.full(n_out, 1 << 14, np.int64)
            for k, w in enumerate(self.weights[j].tolist()):
                if w:
                    total += w * x[first + k : first + k + (n_out - 1) * self.down + 1 : self.down]
            out[j :: self.up] = np.clip(total >> 15, -32768, 32767)
        return out

    def pieces(self, x: np.ndarray) -> Iterator[np.ndarray]:
        size = max(1, WINDOW // self.down) * self.down
        for i in range(0, len(x), size):
            n = min(size, len(x) - i)
            inner = x[max(0, i - self.half) : i + n + self.half].astype(np.int64)
            yield self.window(np.pad(inner, (max(0, self.half - i), max(0, i + n + self.half - len(x)))), n)


def wav(tag: int, rate: int, bits: int, align: int, data: bytes, n_samples: int, extra: bytes = b"") -> bytes:
    """A mono WAV file."""
    bytes_a_second = rate * align if tag != TAGS["adpcm"] else rate * align // BLOCK_SAMPLES
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, bytes_a_second, align, bits, len(extra)) + extra
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n_samples) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(media: bytes) -> tuple[str, int, int, memoryview]:
    """Codec, rate, block size and data of a WAV file; ValueError for what is none of this module's."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    view, at, found = memoryview(media), 12, {}
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        found[name] = view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if b"fmt " not in found or b"data" not in found or len(found[b"fmt "]) < 16:
        raise ValueError("a chunk is missing")
    tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", found[b"fmt "])
    codec = next((c for c in CODECS if TAGS[c] == tag), None)
    data = found[b"data"]
    if codec is None or channels != 1 or bits != (4 if codec == "adpcm" else 8):
        raise ValueError("another format")
    if codec == "adpcm" and (align <= 4 or len(data) % align):
        raise ValueError("broken blocks")
    return codec, rate, align, data


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def write_media(payload: bytes, codec: str | None = None, rate: int = RATE) -> tuple[str, bytes]:
    """The codec and the file of a payload."""
    codec = codec or CODECS[zlib.crc32(payload) % len(CODECS)]
    if codec != "adpcm":
        return codec, wav(TAGS[codec], rate, 8, 1, payload, len(payload))
    codes = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    blocks = np.concatenate([np.zeros((len(codes), 4), np.uint8), codes], axis=1)
    return codec, wav(TAGS[codec], rate, 4, 4 + UNIT, blocks.tobytes(), len(codes) * BLOCK_SAMPLES, struct.pack("<H", BLOCK_SAMPLES))


def payload_parts(codec: str, align: int, data: memoryview) -> Iterator[bytes]:
    """The payload as it stands in the file, in parts."""
    if codec != "adpcm":
        yield data
        return
    blocks = np.frombuffer(data, np.uint8).reshape(-1, align)
    for i in range(0, len(blocks), RUN):
        yield blocks[i : i + RUN, 4:].tobytes()


def samples_of(files: list[tuple[str, int, int, memoryview]]) -> list[np.ndarray]:
    """The samples of each file; the blocks of all ADPCM files of one block size are decoded together."""
    companded = {"mulaw": mulaw_table(), "alaw": alaw_table()}
    out: list[np.ndarray | None] = [companded[c][np.frombuffer(d, np.uint8)] if c in companded else None for c, _, _, d in files]
    for align in {a for c, _, a, _ in files if c == "adpcm"}:
        mine = [i for i, (c, _, a, _) in enumerate(files) if c == "adpcm" and a == align]
        blocks = np.concatenate([np.frombuffer(files[i][3], np.uint8).reshape(-1, align) for i in mine])
        made = np.empty((len(blocks), 1 + 2 * (align - 4)), np.int16)
        for k in range(0, len(blocks), RUN):
            made[k : k + RUN] = decode_blocks(blocks[k : k + RUN], adpcm_tables())
        at = 0
        for i in mine:
            n = len(files[i][3]) // align
            out[i], at = made[at : at + n].ravel(), at + n
    return out


def features(codec: str, rate: int, rate_out: int, x: np.ndarray, keep_pcm: bool) -> tuple[str, bytes | None]:
    """The measures of one file's samples and of its resampled PCM, and the PCM as a WAV file if it is to be kept."""
    peak = energy = crossings = 0
    for i in range(0, len(x), WINDOW):
        part = x[i : i + WINDOW].astype(np.int64)
        peak, energy = max(peak, int(np.abs(part).max())), energy + int((part * part).sum())
        sign = x[max(0, i - 1) : i + WINDOW] < 0
        crossings += int((sign[1:] != sign[:-1]).sum())
    crc, n, kept = 0, 0, []
    for piece in resampler(rate, rate_out).pieces(x):
        raw = piece.astype("<i2").tobytes()
        crc, n = zlib.crc32(raw, crc), n + len(piece)
        if keep_pcm:
            kept.append(raw)
    text = f"{codec} rate={rate} samples={len(x)} peak={peak} energy={energy} crossings={crossings} rate_out={rate_out} samples_out={n} pcm_crc32={crc:08x}"
    return text, wav(TAGS["pcm"], rate_out, 16, 2, b"".join(kept), n) if keep_pcm else None


_resamplers: dict[tuple[int, int], Resampler] = {}


def resampler(rate: int, rate_out: int) -> Resampler:
    if (rate, rate_out) not in _resamplers:
        _resamplers[rate, rate_out] = Resampler(rate, rate_out)
    return _resamplers[rate, rate_out]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most SLICE bytes in the column, or one row."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)]
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", codec: str | None = None, rate: int = RATE) -> DataFrame:
    """doc_id, n_bytes, codec, media: one WAV file for each row."""
    if codec is not None and codec not in CODECS:
        raise ValueError(f"codec has to be one of {CODECS}")

    def make(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                texts = [x.as_buffer().to_pybytes() for x in batch.column(1)]
                made = [write_media(payload_of(x), codec, rate) for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([c for c, _ in made], pa.string()), pa.array([m for _, m in made], pa.binary())], ["doc_id", "n_bytes", "codec", "media"])

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, codec string, media binary")


def decode(files: DataFrame, key: str = "doc_id", media: str = "media", rate_out: int = RATE_OUT, keep_pcm: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per file: key, carried columns, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm, problem.

    pcm is the resampled 16-bit WAV file, null unless keep_pcm. A file that cannot be read has its problem instead.
    """
    kept = [key, *carry]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm", "problem"]

    def one(blob: bytes | None):
        if blob is None:
            return None, "no file"
        try:
            return read_wav(blob), None
        except ValueError as e:
            return None, str(e)

    def make(batches):
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        for whole in batches:
            for batch in slices(whole, len(kept)):
                blobs = batch.column(len(kept)).to_pylist()
                read = [one(b) for b in blobs]
                samples = iter(samples_of([r for r, _ in read if r]))
                rows = []
                for blob, (file, problem) in zip(blobs, read, strict=True):
                    whole_file = (None, None) if blob is None else (len(blob), hashlib.sha256(blob).hexdigest())
                    if file is None:
                        rows.append((None, None, None, *whole_file, None, None, problem))
                        continue
                    codec, rate, align, data = file
                    sha, n, tail = hashlib.sha256(), 0, b""
                    for part in payload_parts(codec, align, data):
                        sha.update(part)
                        n, tail = n + len(part), (tail + bytes(part[-32:]))[-32:]
                    rows.append((n, sha.hexdigest(), zlib.crc32(tail), *whole_file, *features(codec, rate, rate_out, next(samples), keep_pcm), None))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [*kept, *names])

    rows = files.select(*[F.col(f"`{c}`") for c in kept], F.col(media).alias(*fresh(files, "file")))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(kept)])
    return rows.mapInArrow(make, head + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary, problem string")


def store(docs: DataFrame, path: str, rate_out: int = RATE_OUT, **options) -> DataFrame:
    """Write the files and their PCM of docs as a Parquet table (doc_id, n_bytes, codec, media, and decode's columns) and return its reader."""
    decode(encode(docs, **options), rate_out=rate_out, carry=("n_bytes", "codec", "media")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def op13_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Scratch(spark, "telephony").save(encode(documents(spark, sf_dir)), "media")
    return decode(files, keep_pcm=False, carry=("n_bytes",)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
