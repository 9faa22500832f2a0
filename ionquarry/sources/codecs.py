"""Binary arrays in spectra files: base64 floats, zlib, and the Numpress linear, integer and logarithmic codes."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def floats(text: str | bytes | None, bits: int = 32, compressed: bool = False, big_endian: bool = False) -> np.ndarray:
    """Values of base64 text; blanks in it don't count; an incomplete value at the end is left out. No text gives none."""
    data = base64.b64decode(b"".join((text.encode() if isinstance(text, str) else text or b"").split()))
    data = zlib.decompress(data) if compressed and data else data
    size = bits // 8
    return np.frombuffer(data[: len(data) // size * size], f"{'>' if big_endian else '<'}f{size}").astype(float)


def encoded(values, bits: int = 32, compressed: bool = False, big_endian: bool = False) -> str:
    data = np.asarray(values, f"{'>' if big_endian else '<'}f{bits // 8}").tobytes()
    return base64.b64encode(zlib.compress(data) if compressed else data).decode()


def _halves(values: list[int]) -> bytes:
    """Integers as half bytes: a count of leading zero halves (from 8 on, of leading f halves), then the rest, lowest first."""
    out: list[int] = []
    for v in values:
        v &= 0xFFFFFFFF
        digits = [(v >> (4 * k)) & 15 for k in range(8)]
        lead = 15 if digits[7] == 15 else 0
        n = 0
        while n < (8 if lead == 0 else 7) and digits[7 - n] == lead:
            n += 1
        out += [n + 8 if lead else n, *digits[: 8 - n]]
    out += [0] * (len(out) % 2)
    return bytes((a << 4) | b for a, b in zip(out[::2], out[1::2], strict=True))


def _from_halves(data: bytes) -> list[int]:
    halves = [h for b in data for h in (b >> 4, b & 15)]
    out, at = [], 0
    while at < len(halves):
        head = halves[at]
        if at == len(halves) - 1 and head == 0:
            break  # padding
        n, fill = (head, 0) if head <= 8 else (head - 8, 15)
        digits = halves[at + 1 : at + 9 - n]
        if len(digits) < 8 - n:
            break
        value = sum(d << (4 * k) for k, d in enumerate([*digits, *([fill] * n)]))
        out.append(value - (1 << 32) if value >= 1 << 31 else value)
        at += 9 - n
    return out


def linear(values, scale: float = 0.0) -> bytes:
    """Fixed-point values as differences to the line through the two before; ``scale`` 0 takes the largest that fits."""
    x = np.asarray(values, float)
    if scale <= 0:
        scale = float(np.floor(0x7FFFFFFF / max(np.abs(x).max() + 1, 1))) if len(x) else 1.0
    fixed = np.floor(x * scale + 0.5).astype(np.int64).tolist()
    out = struct.pack(">d", scale) + b"".join(struct.pack("<i", v) for v in fixed[:2])
    return out + _halves([v - (2 * b - a) for a, b, v in zip(fixed, fixed[1:], fixed[2:], strict=False)])


def from_linear(data: bytes) -> np.ndarray:
    scale = struct.unpack(">d", data[:8])[0]
    fixed = [struct.unpack("<i", data[k : k + 4])[0] for k in (8, 12) if k + 4 <= len(data)]
    for d in _from_halves(data[16:]):
        fixed.append(2 * fixed[-1] - fixed[-2] + d)
    return np.array(fixed, float) / scale


def integers(values) -> bytes:
    """Values from 0 on, rounded to integers."""
    return _halves([int(v + 0.5) for v in values])


def from_integers(data: bytes) -> np.ndarray:
    return np.array(_from_halves(data), float)


def logarithms(values, scale: float = 0.0) -> bytes:
    """Logarithms of values + 1 as 16-bit fixed points."""
    x = np.log(np.asarray(values, float) + 1)
    if scale <= 0:
        scale = float(np.floor(0xFFFF / max(x.max(), 1e-9))) if len(x) else 1.0
    return struct.pack(">d", scale) + np.floor(x * scale + 0.5).astype("<u2").tobytes()


def from_logarithms(data: bytes) -> np.ndarray:
    return np.exp(np.frombuffer(data[8:], "<u2") / struct.unpack(">d", data[:8])[0]) - 1


NUMPRESS = {"linear": from_linear, "pic": from_integers, "slof": from_logarithms}


def decoded_floats(text: Column, bits: int = 32, compressed: bool = False, big_endian: bool = False) -> Column:
    run = F.pandas_udf(lambda s: s.map(lambda t: floats(t, bits, compressed, big_endian).tolist(), na_action="ignore"), T.ArrayType(T.DoubleType()))
    return run(text)


def encoded_floats(values: Column, bits: int = 32, compressed: bool = False, big_endian: bool = False) -> Column:
    run = F.pandas_udf(lambda s: s.map(lambda v: encoded(v, bits, compressed, big_endian), na_action="ignore"), T.StringType())
    return run(values)


def tagged_scan(mz: Column, intensity: Column) -> Column:
    """A spectrum as text with two tagged base64 arrays of 32-bit floats."""
    return F.concat(F.lit("<mz>"), encoded_floats(mz), F.lit("</mz><intensity>"), encoded_floats(intensity), F.lit("</intensity>"))


def inflated(data: Column) -> Column:
    """Bytes that zlib compressed; null where they aren't such."""

    def one(b: bytes) -> bytes | None:
        try:
            return zlib.decompress(b)
        except zlib.error:
            return None

    run = F.pandas_udf(lambda s: s.map(one, na_action="ignore"), T.BinaryType())
    return run(data)


def deflated(data: Column) -> Column:
    run = F.pandas_udf(lambda s: s.map(lambda b: zlib.compress(bytes(b)), na_action="ignore"), T.BinaryType())
    return run(data)
