"""Column expressions: packed bit vectors, Hamming distance, thresholds,
length bands and the seeded sampling hash.  All are built-in Spark
expressions, so they stay inside whole-stage code generation."""

from cartlens.functions.bits import (
    WORD_BITS, n_words, word_names, bit_position, pack_columns, unpack_words,
    hamming, hamming_arrays, complement_words, shift_seed_words, valid_mask,
)
from cartlens.functions.scalar import (
    threshold, threshold_sql, band_fraction, sample_unit, majority_vote, category_int,
)

__all__ = [
    "WORD_BITS", "n_words", "word_names", "bit_position", "pack_columns", "unpack_words",
    "hamming", "hamming_arrays", "complement_words", "shift_seed_words", "valid_mask",
    "threshold", "threshold_sql", "band_fraction", "sample_unit", "majority_vote", "category_int",
]
