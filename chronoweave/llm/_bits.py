"""Fixed-size summaries that are merged on executors and then broadcast.

Each has a size set by a parameter, whatever the input: that is the bound which makes
collecting and broadcasting it safe.  A fuller one prunes or orders less well; no result
depends on it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from ._rows import batch, fields
from ._store import parts
from ._text import mix

SEG = 1 << 16


def segments(a: np.ndarray) -> list[tuple[int, bytes]]:
    """Non-zero segments of an array, compressed."""
    z = zstandard.ZstdCompressor(level=1)
    return [(i, z.compress(s.tobytes())) for i, s in enumerate(np.split(a, range(SEG, len(a), SEG))) if s.any()]


def merged(df: DataFrame, size: int, dtype: str, how: str) -> np.ndarray:
    """Merge (seg int, blob binary) rows by ``add`` or ``bitwise_or`` to one array of ``size``."""
    merge = {"add": np.add, "or": np.bitwise_or}[how]

    def fold(batches):
        z, acc = zstandard.ZstdDecompressor(), {}
        for pdf in batches:
            for seg, blob in zip(pdf.seg, pdf.blob):
                a = np.frombuffer(z.decompress(blob), dtype)
                acc[seg] = merge(acc[seg], a) if seg in acc else a.copy()
        c = zstandard.ZstdCompressor(level=1)
        if acc:
            yield pd.DataFrame({"seg": list(acc), "blob": [c.compress(a.tobytes()) for a in acc.values()]})

    n = min(parts(df.sparkSession), max(1, size // SEG))
    out, z = np.zeros(size, dtype), zstandard.ZstdDecompressor()
    few = df.repartition(n, "seg").coalesce(max(1, out.nbytes >> 22))  # 4 MB of the result for each task
    for r in few.mapInPandas(fold, "seg int, blob binary").collect():
        a = np.frombuffer(z.decompress(bytes(r.blob)), dtype)
        out[r.seg * SEG : r.seg * SEG + len(a)] = a
    return out


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.astype(np.int64).view(np.uint64))
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def room(keys: int) -> int:
    """Bits of a filter for so many keys: 16 each, up to the bound of 32 MB."""
    return 1 << min(28, max(19, (16 * keys).bit_length()))


def key_filter(df: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """Bloom filter (two hashes) over a long column: ``bits / 8`` bytes, 1 MB by default."""

    out = fields("seg int, blob binary")

    def fill(batches):
        acc = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for slot in _slots(b.column(column).drop_null().to_numpy(), bits):
                np.bitwise_or.at(acc, slot >> np.uint64(3), np.left_shift(np.uint8(1), (slot & np.uint64(7)).astype(np.uint8)))
        rows = segments(acc)
        yield batch({"seg": [s for s, _ in rows], "blob": [x for _, x in rows]}, out)

    return merged(df.select(column).mapInArrow(fill, out), bits // 8, "uint8", "or")


def maybe(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter: never false for a key that is."""
    a, b = _slots(keys, len(table) * 8)
    hit = lambda s: (table[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1
    return (hit(a) & hit(b)).astype(bool)
