"""Doubles as order-preserving integers, with exact built-in arithmetic.

The exponent and the mantissa of a double come from a logarithm (corrected by
comparison) and from dividing and multiplying by powers of two, which is exact.
So ``a < b`` holds exactly if ``ordered_bits(a) < ordered_bits(b)``, and a hash
aggregate or a histogram can work on integers instead of sorting values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MANTISSA = 1 << 52
BIAS = 1023
LEAST_EXPONENT, INFINITE = -1022, 2047
# the least normal number is 2^-1022; 2^1074 = 2^537 * 2^537 makes subnormal ones integers
HALF_SCALE = 2.0 ** 537


def power_of_two(power: Column) -> Column:
    return F.pow(F.lit(2.0), power.cast("double"))


def exponent_guess(a: Column) -> Column:
    """The exponent of a positive double, or one beside it."""
    return F.greatest(F.least(F.floor(F.log2(a)).cast("int"), F.lit(BIAS)), F.lit(LEAST_EXPONENT))


def exponent_of(a: Column, guess: Column, power: Column) -> Column:
    """The exponent itself; ``power``: two to the guess."""
    return F.when(a < power, guess - 1).when(a / power >= 2.0, guess + 1).otherwise(guess)


def bits_of(x: Column, a: Column, exponent: Column) -> Column:
    """The ordered bits of ``x``, from its absolute value and exponent."""
    normal = (exponent + BIAS).cast("long") * F.lit(MANTISSA) + ((a / power_of_two(exponent) - 1.0) * float(MANTISSA)).cast("long")
    size = (F.when(a == float("inf"), F.lit(INFINITE * MANTISSA)).when(a < 2.0 ** LEAST_EXPONENT, (a * HALF_SCALE * HALF_SCALE).cast("long"))
            .otherwise(normal))
    return F.when(F.isnan(x) | x.isNull(), F.lit(None).cast("long")).when(x < 0, -size).otherwise(size)


def ordered_bits(x: Column) -> Column:
    """A long in the order of the doubles; NULL for NULL and NaN, 0 for both zeros."""
    a = F.abs(x)
    guess = exponent_guess(a)
    return bits_of(x, a, exponent_of(a, guess, power_of_two(guess)))


def from_ordered_bits(key: Column) -> Column:
    """The double of :func:`ordered_bits` (0.0 for zero)."""
    size = F.abs(key)
    exponent = F.shiftright(size, 52)
    mantissa = F.pmod(size, F.lit(MANTISSA)).cast("double")
    a = (F.when(exponent == INFINITE, F.lit(float("inf"))).when(exponent == 0, mantissa / HALF_SCALE / HALF_SCALE)
         .otherwise((mantissa / float(MANTISSA) + 1.0) * power_of_two(exponent - BIAS)))
    return F.when(key < 0, -a).otherwise(a)
