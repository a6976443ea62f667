"""Signatures: hash bits cut into bands and packed into 64-bit words."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# the sign bit stays free, so that words are never negative
WORD_BITS = 63


@dataclass(frozen=True)
class BandLayout:
    """How ``bits`` hash bits are cut into bands.

    There are ``bits // rows`` bands of equal width, so a band is wider than ``rows`` when
    ``rows`` does not divide ``bits``; bits that cannot be cut equally are an error.
    Narrow bands share a word, a band wider than a word takes several words of its own.
    """

    bits: int
    rows: int

    def __post_init__(self) -> None:
        if self.rows < 1 or self.bits < self.rows or self.bits % self.bands:
            raise ValueError(f"{self.bits} bits cannot be cut into equal bands of about {self.rows}")

    @property
    def bands(self) -> int:
        return self.bits // self.rows

    @property
    def width(self) -> int:
        return self.bits // self.bands

    def places(self, band: int) -> list[tuple[int, int, int]]:
        """(word, shift, number of bits) of the parts of a band."""
        if self.width <= WORD_BITS:
            word, slot = divmod(band, WORD_BITS // self.width)
            return [(word, slot * self.width, self.width)]
        parts = -(-self.width // WORD_BITS)
        sizes = [WORD_BITS] * (parts - 1) + [self.width - WORD_BITS * (parts - 1)]
        return [(band * parts + k, 0, size) for k, size in enumerate(sizes)]

    @property
    def words(self) -> int:
        return self.places(self.bands - 1)[-1][0] + 1

    def pack(self, bits: np.ndarray) -> np.ndarray:
        """[n, bits] zeros and ones to [n, words] integers."""
        packed = np.zeros((len(bits), self.words), dtype=np.int64)
        column = 0
        for band in range(self.bands):
            for word, shift, size in self.places(band):
                weights = np.int64(1) << np.arange(shift, shift + size, dtype=np.int64)
                packed[:, word] |= bits[:, column : column + size].astype(np.int64) @ weights
                column += size
        return packed

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        """[n, words] integers back to [n, bits] zeros and ones."""
        columns = [
            (packed[:, word] >> np.int64(shift + i)) & 1
            for band in range(self.bands)
            for word, shift, size in self.places(band)
            for i in range(size)
        ]
        return np.stack(columns, axis=1).astype(np.uint8)

    def keys(self, sig: Column) -> Column:
        """Array with the join key of every band.

        A band inside one word is its own key.  A wider band is hashed; whoever joins on it
        also checks ``first_shared_band``, which compares the bits themselves.
        """
        keys = []
        for band in range(self.bands):
            places = self.places(band)
            if len(places) == 1:
                word, shift, size = places[0]
                part = F.shiftright(F.get(sig, F.lit(word)), shift)
                keys.append(part.bitwiseAND(F.lit((1 << size) - 1)))
            else:
                keys.append(F.xxhash64(*[F.get(sig, F.lit(word)) for word, _, _ in places]))
        return F.array(*keys)

    def bit_text(self, sig: Column) -> Column:
        """The bits of a signature as a string of zeros and ones, band after band."""
        used: dict[int, int] = {}
        for band in range(self.bands):
            for word, _, size in self.places(band):
                used[word] = used.get(word, 0) + size
        return F.concat(
            *[
                F.substring(F.reverse(F.lpad(F.bin(F.get(sig, F.lit(word))), WORD_BITS, "0")), 1, size)
                for word, size in used.items()
            ]
        )

    def first_shared_band(self, a: Column, b: Column) -> Column:
        """Number of the first band in which two signatures agree, null if there is none."""
        differs = [
            F.get(a, F.lit(word)).bitwiseXOR(F.get(b, F.lit(word))) for word in range(self.words)
        ]
        cases = None
        for band in range(self.bands):
            parts = [
                differs[word].bitwiseAND(F.lit(((1 << size) - 1) << shift))
                for word, shift, size in self.places(band)
            ]
            same = reduce(lambda x, y: x.bitwiseOR(y), parts) == 0
            cases = F.when(same, band) if cases is None else cases.when(same, band)
        return cases

    def first_shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same row by row for two [n, words] matrices, -1 if there is none."""
        differs = a ^ b
        first = np.full(len(a), -1)
        for band in reversed(range(self.bands)):
            same = np.ones(len(a), dtype=bool)
            for word, shift, size in self.places(band):
                same &= differs[:, word] & np.int64(((1 << size) - 1) << shift) == 0
            first[same] = band
        return first


def split_bands(bits: Column, layout: BandLayout) -> Column:
    """0/1 array to an array with one string of bits per band."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(layout.bands - 1)),
        lambda i: F.array_join(F.slice(bits, i * layout.width + 1, F.lit(layout.width)), ""),
    )
