"""Scalar column expressions (P2, P8, P10-P15, M3 pieces, S12 text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(id_col: str | Column, folds: int = 10) -> Column:
    """Stable hash fold, floor-mod (non-negative for negative ids)."""
    return F.pmod(col(id_col), F.lit(folds))


def sigmoid(margin: str | Column) -> Column:
    """P14."""
    return 1.0 / (1.0 + F.exp(-col(margin)))


def softplus(x: str | Column) -> Column:
    """log(1 + e^x) in the overflow-free form max(x, 0) + log1p(e^-|x|)."""
    x = col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def smoothed_rate(
    target_sum: str | Column,
    count: str | Column,
    base_rate: str | Column,
    smoothing: float,
) -> Column:
    """(sum + k * base) / (n + k)."""
    return (col(target_sum) + F.lit(smoothing) * col(base_rate)) / (
        col(count) + F.lit(smoothing)
    )


def log_density(count: str | Column, width: int | str | Column) -> Column:
    """log1p(n) / log1p(width)."""
    w = F.lit(width) if isinstance(width, int) else col(width)
    return F.log1p(col(count)) / F.log1p(w)


# The embedding-width rule (scale, exponent, floor, cap).
EMB_SCALE = 1.6
EMB_EXPONENT = 0.56
EMB_MIN = 2
EMB_MAX = 16


def embedding_width(cardinality: str | Column, maximum: int = EMB_MAX) -> Column:
    """P10: min(max, max(floor, round(scale * card ** exponent))), rounding
    half to even as Python's ``round`` does."""
    raw = F.bround(F.lit(EMB_SCALE) * F.pow(col(cardinality), F.lit(EMB_EXPONENT)), 0)
    return F.least(F.lit(maximum), F.greatest(F.lit(EMB_MIN), raw.cast("int")))


def clamp(x: str | Column, lower, upper) -> Column:
    """P8."""
    return F.least(F.greatest(col(x), F.lit(lower)), F.lit(upper))


def weighted_sum(terms: Sequence[tuple[float, str | Column]]) -> Column:
    """w1*c1 + w2*c2 + ... evaluated left to right."""
    total = None
    for weight, c in terms:
        term = F.lit(float(weight)) * col(c)
        total = term if total is None else total + term
    return total


_BITS, _LIMBS, _BILLION = 30, 4, 1_000_000_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _limbs(part: Column) -> Column:
    """A double in [0, 1) as ``_LIMBS`` digits of base 2^30, highest first.
    Scaling by 2^30 and taking off the floor are exact."""
    first = F.struct(part.alias("rest"), F.array().cast("array<long>").alias("limbs"))

    def next_limb(acc, _):
        scaled = acc["rest"] * F.lit(float(1 << _BITS))
        whole = F.floor(scaled).cast("long")
        return F.struct((scaled - whole).alias("rest"), F.array_append(acc["limbs"], whole).alias("limbs"))

    return F.aggregate(F.array(*[F.lit(k) for k in range(_LIMBS)]), first, next_limb, lambda acc: acc["limbs"])


def _times_billion(limbs: Column) -> Column:
    """(digits, limbs): the whole part of a billion times the fraction, and
    the fraction that is left."""
    first = F.struct(F.lit(0).cast("long").alias("digits"), F.array().cast("array<long>").alias("limbs"))

    def step(acc, limb):
        product = limb * F.lit(_BILLION) + acc["digits"]
        low = product.bitwiseAND(F.lit((1 << _BITS) - 1).cast("long"))
        return F.struct(F.shiftright(product, _BITS).alias("digits"), F.array_append(acc["limbs"], low).alias("limbs"))

    done = F.aggregate(F.reverse(limbs), first, step)
    return _let(done, lambda d: F.struct(d["digits"].alias("digits"), F.reverse(d["limbs"]).alias("limbs")))


def _eighteen_places(part: Column) -> Column:
    """A double in [0, 1) times 10^18 as a long, its exact binary value rounded
    half to even. Limbs reach 2^-120; what lies below them belongs to numbers
    that round to zero."""

    def rounded(high, low):
        number = high["digits"] * F.lit(_BILLION) + low["digits"]
        top, half = low["limbs"][0], 1 << (_BITS - 1)
        more = F.exists(F.slice(low["limbs"], 2, _LIMBS - 1), lambda v: v > 0)
        up = (top > half) | ((top == half) & (more | (number % 2 == 1)))
        return number + up.cast("long")

    return _let(
        _times_billion(_limbs(part)), lambda high: _let(_times_billion(high["limbs"]), lambda low: rounded(high, low))
    )


def compact_decimal_text(value: str | Column) -> Column:
    """The number at 18 decimal places (its exact binary value rounded
    half to even, so 0.1 is ``.100000000000000006``) without trailing zeros, a
    trailing dot, or the leading zero of ``0.``/``-0.``. Null, NaN and numbers
    from 2^63 on have no text."""

    def text_of(x):
        size = F.abs(x)
        whole = F.floor(size).cast("long")

        def joined(places):
            over = (places >= 10**18).cast("long")
            text = F.concat(
                F.when(x < 0, F.lit("-")).otherwise(F.lit("")),
                (whole + over).cast("string"),
                F.lit("."),
                F.lpad((places - over * 10**18).cast("string"), 18, "0"),
            )
            text = F.regexp_replace(text, r"\.?0+$", "")
            text = F.regexp_replace(text, r"^(-?)0\.", "$1.")
            return F.when(text == "-0", F.lit("0")).otherwise(text)

        return F.when(size < F.lit(float(1 << 63)), _let(_eighteen_places(size - whole), joined))

    x = col(value).cast("double")
    return F.when(~F.isnan(x), _let(x, text_of))


def mix_hash(*columns: str | Column, seed: int = 0) -> Column:
    """Deterministic 32-bit hash of integer columns: the leading md5 digits
    of the seed and the values. Independent of partitioning (unlike
    ``rand()``), the same in any SQL engine, and without structure between
    neighbouring values; nulls are left out."""
    text = F.concat_ws(":", F.lit(str(int(seed))), *[col(c).cast("long").cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_unit(*columns: str | Column, seed: int = 0) -> Column:
    """The high 16 bits of ``mix_hash`` as an integer in [0, 65536)."""
    return F.shiftright(mix_hash(*columns, seed=seed), 16)
