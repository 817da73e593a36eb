"""The normal distribution and its inverse as column expressions, by published rational approximations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the percentage points of the normal distribution (Wichura 1988,
# algorithm AS 241, PPND16), highest power first, over and under the line for each region.
CENTRE = (
    2509.0809287301227,
    33430.57558358813,
    67265.7709270087,
    45921.95393154987,
    13731.69376550946,
    1971.5909503065513,
    133.14166789178438,
    3.3871328727963665,
)
CENTRE_UNDER = (
    5226.495278852854,
    28729.085735721943,
    39307.89580009271,
    21213.794301586597,
    5394.196021424751,
    687.1870074920579,
    42.31333070160091,
    1.0,
)
MIDDLE = (
    0.0007745450142783414,
    0.022723844989269184,
    0.2417807251774506,
    1.2704582524523684,
    3.6478483247632045,
    5.769497221460691,
    4.630337846156546,
    1.4234371107496835,
)
MIDDLE_UNDER = (
    1.0507500716444169e-09,
    0.0005475938084995345,
    0.015198666563616457,
    0.14810397642748008,
    0.6897673349851,
    1.6763848301838038,
    2.053191626637759,
    1.0,
)
TAIL = (
    2.0103343992922881e-07,
    2.7115555687434876e-05,
    0.0012426609473880784,
    0.026532189526576124,
    0.29656057182850487,
    1.7848265399172913,
    5.463784911164114,
    6.657904643501103,
)
TAIL_UNDER = (
    2.0442631033899397e-15,
    1.421511758316446e-07,
    1.8463183175100548e-05,
    0.0007868691311456133,
    0.014875361290850615,
    0.1369298809227358,
    0.599832206555888,
    1.0,
)
# Coefficients of the normal integral (Hart 1968, as given by West 2005), highest power first.
INTEGRAL = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
INTEGRAL_UNDER = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed a single time, however often f names it."""
    return F.get(F.transform(F.array(x), f), 0)


def normal_quantile(p: Column) -> Column:
    """The value below which a share ``p`` (between 0 and 1, neither) of a standard normal lies; 16 digits."""

    def beside(q: Column, r: Column) -> Column:
        middle = once(r - 1.6, lambda x: polynomial(x, MIDDLE) / polynomial(x, MIDDLE_UNDER))
        tail = once(r - 5, lambda x: polynomial(x, TAIL) / polynomial(x, TAIL_UNDER))
        return F.signum(q) * F.when(r <= 5, middle).otherwise(tail)

    def of(p: Column) -> Column:
        q = p - 0.5
        centre = once(0.180625 - q * q, lambda x: polynomial(x, CENTRE) / polynomial(x, CENTRE_UNDER))
        return F.when(F.abs(q) <= 0.425, q * centre).otherwise(once(F.sqrt(-F.log(F.least(p, 1 - p))), lambda r: beside(q, r)))

    return once(p, of)


def normal_cdf(x: Column) -> Column:
    """The share of a standard normal below ``x``, to 1e-15; tails have 8 digits of their own."""

    def below(a: Column) -> Column:
        bell = F.exp(-a * a / 2)
        fraction = a + 0.65
        for k in (4, 3, 2, 1):
            fraction = a + k / fraction
        near = bell * polynomial(a, INTEGRAL) / polynomial(a, INTEGRAL_UNDER)
        return F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(bell / fraction / 2.506628274631)

    return once(x, lambda v: once(below(F.abs(v)), lambda share: F.when(v > 0, 1 - share).otherwise(share)))
