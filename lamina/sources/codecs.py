"""Compression of archive and tree sections: stored, zlib and LZ4 (block and frame), each bounded by what it can expand to."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa

STORED, ZLIB, LZ4, ZSTD = range(4)
# The largest expansion of each codec, and bytes allowed besides.
MOST = {ZLIB: 1032, LZ4: 255}
SLACK = 4096
FRAME_MAGIC = b"\x04\x22\x4d\x18"


class CodecError(ValueError):
    """Data that cannot be decoded, or whose declared size cannot be true."""


def plausible(packed: int, declared: int, method: int) -> None:
    """Refuses a declared size beyond what so many packed bytes can expand to, before anything is allocated for it."""
    if declared < 0 or declared > packed * MOST[method] + SLACK:
        raise CodecError(f"{packed} packed bytes cannot hold {declared}")


def inflate(raw: bytes) -> bytes:
    """zlib data of any size up to the codec's bound."""
    worker = zlib.decompressobj()
    bound = len(raw) * MOST[ZLIB] + SLACK
    try:
        out = worker.decompress(raw, bound)
    except zlib.error as problem:
        raise CodecError(f"zlib: {problem}") from problem
    if not worker.eof:
        raise CodecError("zlib: truncated, or larger than it can be")
    return out


def block(raw: bytes, size: int) -> bytes:
    """An LZ4 block of known size."""
    plausible(len(raw), size, LZ4)
    if not size:
        return b""
    try:
        out = pa.Codec("lz4_raw").decompress(raw, size).to_pybytes()
    except (OSError, pa.ArrowException) as problem:
        raise CodecError(f"LZ4: {problem}") from problem
    if len(out) != size:
        raise CodecError(f"LZ4: {len(out)} bytes in place of {size}")
    return out


def pack_block(data: bytes) -> bytes:
    return pa.Codec("lz4_raw").compress(data).to_pybytes() if data else b"\x00"


def frame(raw: bytes, most: int, *, open_end: bool = False) -> bytes:
    """An LZ4 frame of at most ``most`` bytes; with ``open_end`` it may stop after any whole block, without an end mark.

    Blocks are decoded one by one against the output so far, so linked blocks and frames without end work.
    """
    if len(raw) < 7 or raw[:4] != FRAME_MAGIC:
        raise CodecError("LZ4 frame: no magic number")
    flags = raw[4]
    if flags >> 6 != 1:
        raise CodecError("LZ4 frame: unknown version")
    linked, block_sums, sized, summed, keyed = not flags & 0x20, flags & 0x10, flags & 0x08, flags & 0x04, flags & 0x01
    at = 6 + 8 * bool(sized) + 4 * bool(keyed) + 1
    out = bytearray()
    while True:
        if at + 4 > len(raw):
            if open_end and at == len(raw):
                return bytes(out)
            raise CodecError("LZ4 frame: no end mark")
        (head,) = struct.unpack_from("<I", raw, at)
        at += 4
        if not head:
            break
        size = head & 0x7FFFFFFF
        body = raw[at : at + size]
        if len(body) != size:
            raise CodecError("LZ4 frame: truncated block")
        at += size + 4 * bool(block_sums)
        if head >> 31:
            out += body
        else:
            _block_onto(out, body, most, 0 if linked else len(out))
        if len(out) > most:
            raise CodecError(f"LZ4 frame: more than {most} bytes")
    if summed and at + 4 > len(raw):
        raise CodecError("LZ4 frame: no checksum")
    return bytes(out)


def _block_onto(out: bytearray, body: bytes, most: int, floor: int) -> None:
    """Decodes one block's sequences behind ``out``; matches may reach back to ``floor``."""
    at, end = 0, len(body)

    def length(first: int) -> int:
        nonlocal at
        total = first
        if first == 15:
            while True:
                if at >= end:
                    raise CodecError("LZ4: truncated length")
                more = body[at]
                at += 1
                total += more
                if more < 255:
                    break
        return total

    while at < end:
        token = body[at]
        at += 1
        literals = length(token >> 4)
        if at + literals > end:
            raise CodecError("LZ4: truncated literals")
        out += body[at : at + literals]
        at += literals
        if at == end:
            return
        if at + 2 > end:
            raise CodecError("LZ4: truncated offset")
        back = body[at] | body[at + 1] << 8
        at += 2
        run = length(token & 15) + 4
        begin = len(out) - back
        if not back or begin < floor:
            raise CodecError("LZ4: offset before the data")
        if len(out) + run > most:
            raise CodecError(f"LZ4: more than {most} bytes")
        pattern = out[begin : begin + run]
        while len(pattern) < run:
            pattern += pattern[: run - len(pattern)]
        out += pattern


def pack_frame(data: bytes) -> bytes:
    return pa.Codec("lz4").compress(data).to_pybytes()


def unpack(raw: bytes, method: int, size: int) -> bytes:
    """A stored file's bytes by compression method."""
    if method == STORED:
        return raw
    if method == ZLIB:
        return inflate(raw)
    if method == LZ4:
        return block(raw, size)
    raise CodecError("zstd is not read" if method == ZSTD else f"unknown compression method {method}")


def pack(data: bytes, method: int) -> tuple[bytes, int]:
    """Packed bytes and the method used; empty data is stored."""
    if method == STORED or not data:
        return data, STORED
    if method == ZLIB:
        return zlib.compress(data), ZLIB
    if method == LZ4:
        return pack_block(data), LZ4
    raise CodecError(f"cannot write compression method {method}")
