"""Media columns: signature sniffing, carving, and a lossless text-to-samples round trip."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import text_of

# Magic bytes and the media type each announces.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"RIFF": "audio/wav",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
}
#: Payload unit in bytes: every stored payload is a positive multiple of it.
UNIT = 192
#: Samples a second that the wave header states.
RATE = 16000

SPANS = "array<struct<type:string,start:bigint,end:bigint>>"


def wave_bytes(payload: bytes) -> bytes:
    """The payload as one-channel, unsigned 8-bit PCM samples in a RIFF/WAVE file."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + (n & 1), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + payload + b"\0" * (n & 1)


def _wave(b: bytes, at: int) -> tuple[int, int, int] | None:
    """(end of file, start and end of the samples), or None if the chunk structure does not hold."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    p, fmt, data = at + 12, False, None
    while p + 8 <= end:
        n = int.from_bytes(b[p + 4 : p + 8], "little")
        if p + 8 + n > end:
            return None
        fmt |= b[p : p + 4] == b"fmt " and n >= 16
        if b[p : p + 4] == b"data" and data is None:
            data = (p + 8, p + 8 + n)
        p += 8 + n + (n & 1)
    return (end, *data) if fmt and data and p >= end else None


def _png(b: bytes, at: int) -> int | None:
    p = at + 8
    while p + 12 <= len(b):
        n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return None
        p += 12 + n
        if kind == b"IEND":
            return p
    return None


def _gif(b: bytes, at: int) -> int | None:
    if len(b) < at + 13:
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)

    def blocks(p: int) -> int | None:
        while p < len(b):
            if b[p] == 0:
                return p + 1
            p += 1 + b[p]
        return None

    while p is not None and p < len(b):
        if b[p] == 0x3B:
            return p + 1
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    """Segments by their lengths; inside a scan, escaped bytes and restart marks are passed over, and another segment may follow."""
    p = at + 2
    while p + 2 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2
        if p + 4 > len(b) or (n := int.from_bytes(b[p + 2 : p + 4], "big")) < 2:
            return None
        p += 2 + n
        if kind == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7 or b[p + 1] == 0xFF):
                p += 1 if b[p + 1] == 0xFF else 2
            if p < 0:
                return None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 26:
        return None
    n, offset, head = (int.from_bytes(b[at + i : at + i + 4], "little") for i in (2, 10, 14))
    ok = head in (12, 40, 52, 56, 108, 124) and 14 + head <= offset <= n and b[at + 6 : at + 10] == b"\0\0\0\0"
    return at + n if ok and at + n <= len(b) else None


def _pdf(b: bytes, at: int) -> int | None:
    """Up to its last end mark: a further one belongs to the file if a new cross-reference, and no new file, comes before it."""
    stop = b.find(b"%%EOF", at)
    if stop < 0 or b.find(b"startxref", at, stop) < 0:
        return None
    while (more := b.find(b"%%EOF", stop + 5)) >= 0 and b.find(b"startxref", stop, more) >= 0 and b.find(b"%PDF-", stop, more) < 0:
        stop = more
    return stop + 5


def _zip(b: bytes, at: int) -> int | None:
    """Up to the end record whose directory lies right before it and starts where the record says, counted from the file's start."""
    stop = at
    while (stop := b.find(b"PK\x05\x06", stop + 1)) >= 0 and stop + 22 <= len(b):
        size, offset, note = int.from_bytes(b[stop + 12 : stop + 16], "little"), int.from_bytes(b[stop + 16 : stop + 20], "little"), int.from_bytes(b[stop + 20 : stop + 22], "little")
        if at + offset + size == stop and (not size or b[at + offset : at + offset + 4] == b"PK\x01\x02") and stop + 22 + note <= len(b):
            return stop + 22 + note
    return None


#: Each gives the end of a well-formed file that starts at the position, or None.
VALIDATORS = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp,
    "audio/wav": lambda b, at: (w := _wave(b, at)) and w[0], "application/pdf": _pdf, "application/zip": _zip,
}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def carve(b: bytes, magics) -> list[tuple[str, int, int]]:
    """All well-formed media in the bytes, outermost first and in order; what lies inside a found file is part of it."""
    out, free = [], 0
    for last, (kind, n) in magics.iter(b.decode("latin-1")):
        at = last - n + 1
        if at >= free and (end := VALIDATORS[kind](b, at)) is not None:
            out.append((kind, at, end))
            free = end
    return out


def sniff_media(df: DataFrame, content: str = "content", declared: str = "declared") -> DataFrame:
    """Adds sniffed (type at byte 0, null if none), corrected (sniffed if any, else declared), mismatch and embedded spans.

    Null or empty content: sniffed null, no spans. A null declared type never mismatches. Columns named like the
    added ones are replaced; all others are kept.
    """
    kept = [c for c in df.columns if c not in ("sniffed", "corrected", "mismatch", "embedded")]

    @F.pandas_udf(f"sniffed string, embedded {SPANS}")
    def look(contents: pd.Series) -> pd.DataFrame:
        magics, rows = automaton(), []
        for c in contents:
            spans = carve(bytes(c), magics) if c is not None else []
            rows.append((next((k for k, s, _ in spans if s == 0), None), [{"type": k, "start": s, "end": e} for k, s, e in spans if s]))
        return pd.DataFrame(rows, columns=["sniffed", "embedded"])

    seen = df.select(*kept, look(F.col(content)).alias("_seen"))
    kind = F.col("_seen.sniffed")
    told = F.col(declared) if declared in kept else F.lit(None).cast("string")
    out = seen.select(
        *kept, kind.alias("sniffed"), F.coalesce(kind, told).alias("corrected"),
        F.coalesce(kind != told, F.lit(False)).alias("mismatch"), F.col("_seen.embedded").alias("embedded"),
    )
    return out


def _measures(payload: bytes, stored: bytes, spans: list[tuple[str, int, int]], start: int) -> str:
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    mean, crossings = float(x.mean()), int(np.count_nonzero(np.diff(x > 127)))
    return f"{spans[0][0]};rate={RATE};bits=8;channels=1;samples={len(x)};start={start};mean={mean:.6f};crossings={crossings};peak={int(x.max())}"


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text's UTF-8 bytes as wave samples, sniffs the stored bytes, carves the samples back and measures them.

    The bytes get trailing spaces up to a positive multiple of 192. Null text: empty, so 192 spaces. Equal texts
    give equal rows. A stored file that the sniffer does not recognise, or that reads back changed, raises.
    """
    fields = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    names = [x.split()[0] for x in fields.split(", ")]

    @F.pandas_udf(fields)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        magics = automaton()
        for batch in batches:
            rows = []
            for text in batch:
                raw = text.encode("utf-8", "surrogatepass")
                stored = wave_bytes(raw + b" " * (-len(raw) % UNIT or (UNIT if not raw else 0)))
                spans = carve(stored, magics)
                if not spans or spans[0] != ("audio/wav", 0, len(stored)):
                    raise ValueError("stored media is not recognised")
                _, start, end = _wave(stored, 0)
                back = stored[start:end]
                if back[: len(raw)] != raw:
                    raise ValueError("stored media reads back changed")
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), _measures(back, stored, spans, start)))
            yield pd.DataFrame(rows, columns=names)

    return df.select(F.col(id_col), run(text_of(text_col)).alias("_m")).select(id_col, *(F.col("_m")[c].alias(c) for c in names))
