"""Blowfish on Columns: texts to hex digits and back, in blocks of 8 bytes that are encrypted each for itself. Arrow-batched Python.

The cipher is kept for data that is already encrypted with it; it is no choice for new secrets.
"""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M32 = 0xFFFFFFFF


@cache
def pi_words(n: int) -> list[int]:
    """The first n words of 32 bits of the fraction of pi, by Machin's formula."""
    bits = 32 * n + 64

    def arctan_of_inverse(k: int) -> int:
        term = (1 << bits) // k
        total, i, sign = term, 1, 1
        while term:
            term //= k * k
            i, sign = i + 2, -sign
            total += sign * (term // i)
        return total

    fraction = (4 * (4 * arctan_of_inverse(5) - arctan_of_inverse(239))) & ((1 << bits) - 1)
    return [(fraction >> (bits - 32 * (i + 1))) & _M32 for i in range(n)]


class Cipher:
    """The key schedule and the sixteen rounds."""

    def __init__(self, key: bytes) -> None:
        if not 1 <= len(key) <= 56:
            raise ValueError("a key has 1 to 56 bytes")
        words = pi_words(18 + 1024)
        cycle = (key * (72 // len(key) + 1))[:72]
        self.p = [w ^ int.from_bytes(cycle[4 * i : 4 * i + 4]) for i, w in enumerate(words[:18])]
        self.s = [list(words[18 + 256 * i : 18 + 256 * (i + 1)]) for i in range(4)]
        left = right = 0
        for table in (self.p, *self.s):
            for i in range(0, len(table), 2):
                left, right = self.block(left, right, self.p)
                table[i], table[i + 1] = left, right

    def block(self, left: int, right: int, keys: list[int]) -> tuple[int, int]:
        for k in keys[:16]:
            left ^= k
            mixed = (self.s[0][left >> 24] + self.s[1][left >> 16 & 255]) & _M32
            right ^= ((mixed ^ self.s[2][left >> 8 & 255]) + self.s[3][left & 255]) & _M32
            left, right = right, left
        return right ^ keys[17], left ^ keys[16]

    def apply(self, data: bytes, back: bool) -> bytes:
        keys, out = self.p[::-1] if back else self.p, []
        for i in range(0, len(data), 8):
            out += [x.to_bytes(4) for x in self.block(int.from_bytes(data[i : i + 4]), int.from_bytes(data[i + 4 : i + 8]), keys)]
        return b"".join(out)


@cache
def _cipher(key: str) -> Cipher:
    return Cipher(key.encode())


def encode(text: Column, key: str) -> Column:
    """Hex digits of the encrypted UTF-8 bytes, filled up with zero bytes to whole blocks."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        whole = lambda b: b + b"\0" * (-len(b) % 8)
        return pd.Series([None if t is None else _cipher(key).apply(whole(t.encode()), False).hex() for t in texts], dtype=object)

    return run(text)


def decode(hexes: Column, key: str) -> Column:
    """The text of encode(); undefined where the digits aren't those of whole blocks."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                data = None if t is None else bytes.fromhex(t)
            except ValueError:
                data = None
            out.append(None if data is None or len(data) % 8 else _cipher(key).apply(data, True).rstrip(b"\0").decode(errors="replace"))
        return pd.Series(out, dtype=object)

    return run(hexes)
