"""Binary feature vectors packed into bigint words.

Feature ``i`` (0-based position in the category list) lives in word
``i // 64`` at bit ``i % 64``.  A 73-category vector is two words, a
64-category vector one.  Distance is ``bit_count(a ^ b)`` summed over the
words: two codegen'd expressions per word instead of one comparison per
category.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 64


def n_words(n_features: int) -> int:
    return max(1, -(-n_features // WORD_BITS))


def word_names(n_features: int, prefix: str = "w") -> list[str]:
    return [f"{prefix}{j}" for j in range(n_words(n_features))]


def bit_position(index: int) -> tuple[int, int]:
    """(word, bit) of the 0-based feature index."""
    return divmod(index, WORD_BITS)


def _bit(b: int) -> Column:
    return F.shiftleft(F.lit(1).cast("long"), b)


def valid_mask(n_features: int, word: int) -> int:
    """Signed 64-bit value with the bits of ``word`` that hold features."""
    used = min(WORD_BITS, n_features - word * WORD_BITS)
    mask = (1 << used) - 1
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def pack_columns(cols: Sequence[Column | str]) -> list[Column]:
    """0/1 columns, in category order, to packed words (per row).
    A value other than 0 sets the bit; null counts as 0.  Column names are
    turned into one SQL expression per word (one JVM call, not one per bit)."""
    words = []
    for j in range(n_words(len(cols))):
        part = cols[j * WORD_BITS:(j + 1) * WORD_BITS]
        if all(isinstance(c, str) for c in part):
            text = " | ".join(f"shiftleft(cast(coalesce({quoted(c)}, 0) <> 0 as bigint), {b})"
                              for b, c in enumerate(part))
            words.append(F.expr(text))
            continue
        terms = [F.when(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) != 0, _bit(b))
                  .otherwise(F.lit(0).cast("long")) for b, c in enumerate(part)]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), terms))
    return words


def unpack_words(words: Sequence[Column | str], n_features: int) -> list[Column]:
    """Packed words back to one 0/1 int column per feature (category order)."""
    out = []
    for i in range(n_features):
        j, b = bit_position(i)
        if isinstance(words[j], str):
            out.append(F.expr(f"cast(shiftright({quoted(words[j])}, {b}) & 1 as int)"))
            continue
        out.append(F.shiftright(words[j], b).bitwiseAND(F.lit(1)).cast("int"))
    return out


def hamming(a: Sequence[Column | str], b: Sequence[Column | str]) -> Column:
    """Number of unequal positions between two packed vectors (F1)."""
    if len(a) != len(b):
        raise ValueError(f"vectors have different widths: {len(a)} and {len(b)} words")
    col = lambda c: F.col(c) if isinstance(c, str) else c
    terms = [F.bit_count(col(x).bitwiseXOR(col(y))) for x, y in zip(a, b)]
    return reduce(lambda x, y: x + y, terms).cast("int")


def hamming_arrays(a: Column | str, b: Column | str) -> Column:
    """Hamming distance between two array columns; unequal lengths raise at
    run time, as the reference's shape assertion does."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    checked = F.when(F.size(a) == F.size(b), F.lit(0)).otherwise(
        F.raise_error(F.format_string("arrays of unequal length: %d and %d", F.size(a), F.size(b))))
    diff = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x != y, 1).otherwise(0)),
                       F.lit(0), lambda acc, x: acc + x)
    return diff + checked


def complement_words(words: Sequence[Column | str], n_features: int) -> list[Column]:
    """``1 - q`` for every feature bit (F2)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return [F.bitwise_not(col(w)).bitwiseAND(F.lit(valid_mask(n_features, j)))
            for j, w in enumerate(words)]


def shift_seed_words(majority: Sequence[Column | str], n_values: Column | str,
                     n_features: int) -> list[Column]:
    """Seed ``q[i] = (m[i] - i) mod c`` (F3) over packed majority bits.

    ``m[i]`` is 1 where ones outnumber zeros, ``c`` the number of distinct
    cell values of the group.  For ``c = 2``, subtracting ``i`` modulo 2
    flips exactly the odd positions, an XOR with the odd-bit mask; for
    ``c = 1`` every position is 0.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    odd = -0x5555555555555556  # 0xAAAA...AAAA as a signed 64-bit value
    c = col(n_values)
    return [F.when(c == 2, col(m).bitwiseXOR(F.lit(odd & valid_mask(n_features, j))))
             .otherwise(F.lit(0).cast("long"))
            for j, m in enumerate(majority)]
