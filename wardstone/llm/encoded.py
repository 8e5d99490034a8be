"""Texts as token ids: whole texts are cut where no token can cross, and each distinct chunk is encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Bytes of a key that is too long to be remembered; keys whose values are made in one call.
LONG, CALL = 256, 1024


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The byte strings data[offsets[i]:offsets[i + 1]] as an Arrow array; nothing is copied."""
    offsets = np.ascontiguousarray(offsets, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each value in the array of distinct values, and that array."""
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of byte strings, and their offsets."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    body = values.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut(data: bytes, offsets: np.ndarray) -> list[bytes]:
    """The byte strings data[offsets[i]:offsets[i + 1]]; much faster than an Arrow array's to_pylist()."""
    at = offsets.tolist()
    return [data[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]


def gathered(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches flat[offsets[c]:offsets[c + 1]] of all codes one after another, and their lengths."""
    lengths = (offsets[1:] - offsets[:-1])[codes]
    ends = np.cumsum(lengths)
    places = np.repeat(offsets[:-1][codes] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[places], lengths


def apart(encode: Callable[[str], list[int]], alone: Callable[[str], list[int]], mark: str, mark_id: int) -> Callable[[list[str]], list[bytes]]:
    """Encodes chunks in one text, between marks that the library takes for a special token and never joins with what stands beside.

    Chunks that hold the beginning of a mark themselves go alone.
    """

    def chunks_of(chunks: list[str]) -> list[bytes]:
        plain = [c for c in chunks if "<|" not in c]
        ids = np.array(encode(mark.join(plain)), np.int32)
        marks = (4 * np.flatnonzero(ids == mark_id)).tolist()
        body = ids.tobytes()
        joined = (body[lo:hi] for lo, hi in zip([0, *[m + 4 for m in marks]], [*marks, len(body)], strict=True))
        if len(plain) == len(chunks):
            return list(joined)
        return [np.array(alone(c), np.int32).tobytes() if "<|" in c else next(joined) for c in chunks]

    return chunks_of


class Memory:
    """Values of byte strings, made once for those met lately: past `limit` of them, those not met since half that many are forgotten."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], limit: int):
        self.make, self.limit = make, limit
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def of(self, keys: list[bytes]) -> list[bytes]:
        """The values of distinct keys."""
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        fresh = []
        for i, value in enumerate(found):
            if value is None:
                key = keys[i]
                value = old.get(key)
                if value is None:
                    fresh.append(i)
                else:
                    found[i] = young[key] = value
        for at in range(0, len(fresh), CALL):
            part = fresh[at : at + CALL]
            for i, value in zip(part, self.make([keys[i] for i in part]), strict=True):
                found[i] = value
                if len(keys[i]) <= LONG:
                    young[keys[i]] = value
        if len(young) > self.limit // 2:
            self.young, self.old = {}, young
        return found


def arrays(values: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as one array of numbers, and offsets (one more than strings)."""
    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(kind).itemsize, out=offsets[1:])
    return np.frombuffer(b"".join(values), kind), offsets
