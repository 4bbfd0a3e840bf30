from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

PART_BITS = 18
# From here on a double no longer holds every whole number of units.
UNITS_LIMIT = float(2**53)
MOST_PLACES = 5


def exact_sum(amount: Column, name: str, scale: int = 2) -> Column:
    """Exact sum of a double column whose amounts have at most ``scale`` decimal places.

    A sum of doubles depends on the order of addition, so a retried task or
    another file split can change its last digits. This one cannot: it adds
    whole units of ``10**-scale`` only.

    The column must hold what the caller declares: finite amounts, each the
    double nearest to a whole number of units, and less than 2**53 of them.
    Anything else raises an error with the column's ``name``; nothing is rounded
    away. Nulls are skipped and an empty sum is null, as in ``sum``. The result
    is a decimal with ``scale`` places (0 to 5).

    Units are added as three parts of at most 18 bits, so 2**45 rows a group fit
    into bigints whatever the amounts, with ANSI mode on or off; wide decimals
    would leave the fast aggregation path.
    """
    if not 0 <= scale <= MOST_PLACES:
        raise ValueError(f"scale must be from 0 to {MOST_PLACES}")
    power = float(10**scale)
    units = F.rint(amount * power)
    # NaN equals NaN and compares greater than any number; null falls through.
    undeclared = (F.abs(units) >= UNITS_LIMIT) | (units / power != amount)
    message = f"{name}: an amount is NaN, infinite, too large or has over {scale} decimal places"
    whole = F.when(undeclared, F.raise_error(F.lit(message))).otherwise(units.cast("bigint"))
    mask = F.lit(2**PART_BITS - 1)
    parts = [
        F.sum(F.shiftright(whole, 2 * PART_BITS)),
        F.sum(F.shiftright(whole, PART_BITS).bitwiseAND(mask)),
        F.sum(whole.bitwiseAND(mask)),
    ]
    high, middle, low = (p.cast("decimal(19,0)") for p in parts)
    total = high * F.lit(2 ** (2 * PART_BITS)) + middle * F.lit(2**PART_BITS) + low
    return (total * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(38,{scale})")
