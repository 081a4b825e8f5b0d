"""Reading and writing Zarr (version 2) directories with numpy alone.

Compressors: none, zlib, gzip and zstd; blosc and others if ``numcodecs`` is there. Strings are
fixed-length or variable-length UTF-8.
"""

from __future__ import annotations

import gzip
import json
import os
import struct
import zlib
from typing import Any

import numpy as np


def _read(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except FileNotFoundError:
        return None


def is_group(path: str) -> bool:
    return os.path.isfile(os.path.join(path, ".zgroup"))


def is_array(path: str) -> bool:
    return os.path.isfile(os.path.join(path, ".zarray"))


def children(path: str) -> list[str]:
    """Names of arrays and groups in a group."""
    if not os.path.isdir(path):
        return []
    return sorted(n for n in os.listdir(path) if is_array(os.path.join(path, n)) or is_group(os.path.join(path, n)))


def decode_strings(raw: bytes) -> np.ndarray:
    """Variable-length UTF-8: a count, then length and bytes of each."""
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4, np.empty(n, object)
    for i in range(n):
        (size,) = struct.unpack_from("<I", raw, at)
        out[i] = raw[at + 4 : at + 4 + size].decode("utf-8")
        at += 4 + size
    return out


def encode_strings(values) -> bytes:
    parts = [struct.pack("<I", len(values))]
    for v in values:
        b = ("" if v is None else str(v)).encode("utf-8")
        parts += [struct.pack("<I", len(b)), b]
    return b"".join(parts)


class Array:
    """A one- or two-dimensional array; only the chunks asked for are read."""

    def __init__(self, path: str):
        meta = _read(os.path.join(path, ".zarray"))
        if meta is None:
            raise FileNotFoundError(f"no array at {path}")
        self.path, self.meta = path, json.loads(meta)
        self.shape = tuple(self.meta["shape"])
        self.chunks = tuple(self.meta["chunks"])
        self.objects = self.meta["dtype"] == "|O"
        self.dtype = np.dtype(object) if self.objects else np.dtype(self.meta["dtype"])

    def __len__(self) -> int:
        return self.shape[0]

    def _decompress(self, raw: bytes) -> bytes:
        codec = self.meta.get("compressor")
        if codec is None:
            return raw
        kind = codec["id"]
        if kind == "zlib":
            return zlib.decompress(raw)
        if kind == "gzip":
            return gzip.decompress(raw)
        if kind == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        try:
            import numcodecs
        except ImportError:
            raise ImportError(f"compressor {kind!r} of {self.path} needs numcodecs") from None
        return bytes(numcodecs.get_codec(codec).decode(raw))

    def _chunk(self, at: tuple[int, ...]) -> np.ndarray:
        sep = self.meta.get("dimension_separator", ".")
        raw = _read(os.path.join(self.path, sep.join(map(str, at))))
        if raw is None:
            fill = self.meta.get("fill_value")
            if self.objects:
                return np.full(self.chunks, "" if fill in (None, 0) else fill, object)
            return np.full(self.chunks, 0 if fill is None else fill, self.dtype)
        raw = self._decompress(raw)
        if self.objects:
            return decode_strings(raw).reshape(self.chunks if len(self.chunks) > 1 else -1)
        return np.frombuffer(raw, self.dtype).reshape(self.chunks, order=self.meta.get("order", "C"))

    def __getitem__(self, s: slice) -> np.ndarray:
        """Rows of a slice without step."""
        lo, hi, _ = s.indices(self.shape[0])
        if hi <= lo:
            return np.zeros((0, *self.shape[1:]), self.dtype)
        size = self.chunks[0]
        rows = []
        for i in range(lo // size, (hi - 1) // size + 1):
            across = [self._chunk((i, j))[: size, :] for j in range(-(-self.shape[1] // self.chunks[1]))] if len(self.shape) == 2 else [self._chunk((i,))]
            whole = np.concatenate(across, axis=1)[:, : self.shape[1]] if len(self.shape) == 2 else across[0]
            rows.append(whole[max(0, lo - i * size) : hi - i * size])
        out = np.concatenate(rows)
        return np.array([x.decode("utf-8").rstrip("\0") for x in out], object) if out.dtype.kind == "S" else out.astype(object) if out.dtype.kind == "U" else out


def write_array(path: str, values, chunk: int = 65_536, codec: str | None = "zstd") -> None:
    """Write a one-dimensional array."""
    os.makedirs(path, exist_ok=True)
    values = np.asarray(values)
    text = values.dtype.kind in "OUS"
    meta: dict[str, Any] = {"zarr_format": 2, "shape": [len(values)], "chunks": [max(1, min(chunk, max(1, len(values))))], "order": "C", "fill_value": "" if text else 0, "compressor": {"id": codec} if codec else None}
    meta |= {"dtype": "|O", "filters": [{"id": "vlen-utf8"}]} if text else {"dtype": values.dtype.str, "filters": None}
    size = meta["chunks"][0]
    for i in range(0, len(values), size):
        part = values[i : i + size]
        if text:
            raw = encode_strings(part)
        else:
            full = np.zeros(size, values.dtype)
            full[: len(part)] = part
            raw = full.tobytes()
        if codec == "zlib":
            raw = zlib.compress(raw, 1)
        elif codec == "gzip":
            raw = gzip.compress(raw, 1)
        elif codec == "zstd":
            import zstandard

            raw = zstandard.ZstdCompressor(level=1).compress(raw)
        with open(os.path.join(path, str(i // size)), "wb") as f:
            f.write(raw)
    with open(os.path.join(path, ".zarray"), "w") as f:
        json.dump(meta, f)


def write_group(path: str, attrs: dict | None = None) -> None:
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, ".zgroup"), "w") as f:
        json.dump({"zarr_format": 2}, f)
    if attrs:
        with open(os.path.join(path, ".zattrs"), "w") as f:
            json.dump(attrs, f)
