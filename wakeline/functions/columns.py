"""Column-expression builders. Everything here stays on the JVM."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# The five primes of the 64-bit xxHash.
XX_PRIMES = (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
)

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000

# Web Mercator radius, metres in a nautical mile.
MERCATOR_RADIUS_M = 6378137.0
METRES_PER_NM = 1852.0

# Half-open gap buckets in hours (name, low, high).
GAP_BUCKETS = (
    ("<1min", 0.0, 1 / 60),
    ("1-10min", 1 / 60, 10 / 60),
    ("10min-1h", 10 / 60, 1.0),
    ("1-6h", 1.0, 6.0),
    ("6-12h", 6.0, 12.0),
    ("12-24h", 12.0, 24.0),
    ("1-7d", 24.0, 168.0),
    (">7d", 168.0, math.inf),
)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c="Timestamp") -> Column:
    return F.unix_micros(col(c))


def row_order(us, seq, latest_first: bool = False) -> Column:
    """One exact number that orders rows by time, then by any bigint; ``latest_first`` turns the second.

    A decimal keeps ``max_by`` and ``min_by`` in a hash aggregate with map-side combine;
    a struct would sort the rows.
    """
    time = col(us).cast("decimal(19,0)") * F.lit("18446744073709551616").cast("decimal(20,0)")
    tie = col(seq).cast("decimal(20,0)")
    return ((time - tie) if latest_first else (time + tie)).cast("decimal(38,0)")


def finite(c) -> Column:
    """NaN and infinities become null."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clip(c, low: float, high: float) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def wrap_course(delta) -> Column:
    """Course change into [-180, 180)."""
    return F.pmod(col(delta) + 180.0, F.lit(360.0)) - 180.0


def safe_ratio(a, b) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def bin_start(us, width: int) -> Column:
    return col(us) - F.pmod(col(us), F.lit(width))


def gap_bucket(hours) -> Column:
    hours = col(hours)
    out = F.lit(None).cast("string")
    for name, low, high in reversed(GAP_BUCKETS):
        inside = hours >= low if math.isinf(high) else (hours >= low) & (hours < high)
        out = F.when(inside, name).otherwise(out)
    return out


def hash_order(seed: int, *ids) -> Column:
    """A repeatable random order: md5 over the seed and the identifiers."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[col(i).cast("string") for i in ids]))


def hash_integer(seed: int, *ids) -> Column:
    """A repeatable 60-bit integer from the same md5."""
    return F.conv(F.substring(hash_order(seed, *ids), 1, 15), 16, 10).cast("bigint")


def hash_uniform(seed: int, *ids) -> Column:
    """A repeatable uniform number in (0, 1); unlike rand() a retried task repeats it."""
    h = F.xxhash64(F.lit(seed), *[col(i) for i in ids])
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)


def next_uniform(hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """(numbers, hashes): hash_uniform over the columns of xxhash64 values and one more int column, in numpy."""
    def turned(v, k):
        return (v << np.uint64(k)) | (v >> np.uint64(64 - k))

    one, two, three, _, five = (np.uint64(v) for v in XX_PRIMES)
    with np.errstate(over="ignore"):
        h = hashes.astype(np.int64).view(np.uint64)[None, :] + five + np.uint64(4)
        h = h ^ (numbers.astype(np.uint64)[:, None] * one)
        h = turned(h, 23) * two + three
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        h = h ^ (h >> np.uint64(32))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def _md5_words(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of md5 of many messages of one block: (16 words, messages) as uint32."""
    first = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(block.shape[1], v) for v in first)
    f, low = np.empty_like(a), np.empty_like(a)
    for k in range(64):
        kind = k // 16
        if kind == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif kind == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        f += block[(k, 5 * k + 1, 3 * k + 5, 7 * k)[kind] % 16]
        f += np.uint32(int(abs(math.sin(k + 1)) * 2**32))
        turn = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[kind][k % 4]
        np.right_shift(f, np.uint32(32 - turn), out=low), np.left_shift(f, np.uint32(turn), out=f), np.bitwise_or(f, low, out=f)
        f += b
        a, d, c, b, f = d, c, b, f, a
    return a + first[0], b + first[1]


def md5_integers(prefix: str, start: int, end: int) -> np.ndarray:
    """hash_integer of a text prefix (which ends with the hyphen) and each whole number from start to end - 1, in numpy."""
    lead, found = prefix.encode(), np.empty(end - start, np.int64)
    at = start
    while at < end:
        digits = len(str(at))
        upto = min(end, 10**digits, at + 8_192)
        size = len(lead) + digits
        if size > 55:
            raise ValueError(f"{prefix!r} is too long for one block")
        text = np.zeros((upto - at, 64), np.uint8)
        text[:, : len(lead)] = np.frombuffer(lead, np.uint8)
        rest = np.arange(at, upto)
        for k in range(size - 1, len(lead) - 1, -1):
            rest, text[:, k] = rest // 10, 48 + rest % 10
        text[:, size] = 0x80
        text[:, 56:60] = np.array([8 * size], "<u4").view(np.uint8)
        a, b = _md5_words(np.ascontiguousarray(text.view("<u4").T))
        found[at - start : upto - start] = ((a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap() >> np.uint32(4))).astype(np.int64)
        at = upto
    return found


def hash_normal(seed: int, *ids) -> Column:
    """Box-Muller on two repeatable uniforms."""
    u = hash_uniform(seed * 2 + 1, *ids)
    v = hash_uniform(seed * 2 + 2, *ids)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def mercator_x(lon) -> Column:
    return F.radians(col(lon)) * MERCATOR_RADIUS_M


def mercator_y(lat) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2.0)) * MERCATOR_RADIUS_M


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Planar distance of a point from a segment."""
    px, py, x1, y1, x2, y2 = map(col, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    along = F.coalesce(
        F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0)
    )
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    gx, gy = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(gx * gx + gy * gy)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 8, moved back by the factors between."""
    z = x + 8.0
    y = 1 / (z * z)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / z
    between = sum((F.log(x + float(j)) for j in range(1, 8)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - between


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by running ratios of its convergents.

    Terms needed grow with the square root of the larger parameter.
    """
    tiny = 1e-300

    def away(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def fold(state: Column, term: Column, c, d, f) -> Column:
        d_new = 1.0 / away(1.0 + term * d)
        c_new = away(1.0 + term / c)
        return F.struct(c_new.alias("c"), d_new.alias("d"), (f * c_new * d_new).alias("f"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        s = fold(s, even, s["c"], s["d"], s["f"])
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        return fold(s, odd, s["c"], s["d"], s["f"])

    first = 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("f"))
    terms = F.sequence(F.lit(1), F.ceil(40 + 4 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(F.transform(terms, lambda m: m.cast("double")), start, step)["f"]


def incomplete_beta(a, b, x) -> Column:
    """Regularised incomplete beta function I_x(a, b) for a, b > 0 and x in [0, 1]."""
    a, b, x = (col(c).cast("double") for c in (a, b, x))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x))
    low = front * _beta_fraction(a, b, x) / a
    high = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    inside = F.when(x < (a + 1.0) / (a + b + 2.0), low).otherwise(high)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def correlation_pvalue(rho, n) -> Column:
    """Two-sided p-value of a correlation of n points, from Student's t with n - 2 degrees of freedom.

    With t^2 = rho^2 (n - 2) / (1 - rho^2) the tail is I_{1 - rho^2}((n - 2) / 2, 1 / 2).
    Null for fewer than three points or a null correlation.
    """
    rho, n = col(rho), col(n)
    return F.when(rho.isNotNull() & (n > 2), incomplete_beta((n - 2) / 2.0, F.lit(0.5), 1.0 - rho * rho))


def arc_angle(a, b) -> Column:
    """Angle between two unit vectors (arrays of three), by half the chord: exact for small ones too."""
    a, b = col(a), col(b)
    chord = F.sqrt(sum((a[k] - b[k]) * (a[k] - b[k]) for k in range(3)))
    return 2.0 * F.asin(F.least(chord / 2.0, F.lit(1.0)))


def risk_hex(p) -> Column:
    """Green to red through yellow; both channels are cut to whole numbers."""
    p = clip(p, 0.0, 1.0)
    red = F.floor(F.least(F.lit(255.0), p * 2 * 255)).cast("int")
    green = F.floor(F.least(F.lit(255.0), (1 - p) * 2 * 255)).cast("int")

    def pair(c):
        return F.lower(F.lpad(F.hex(c), 2, "0"))

    return F.concat(F.lit("#"), pair(red), pair(green), F.lit("00"))
