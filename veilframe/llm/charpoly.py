"""Exact characteristic polynomials of symmetric integer matrices, their roots, and null spaces, without rounding.

The polynomial is found modulo many primes (Hessenberg form, then the recurrence over its leading minors) and put
together by Chinese remaindering. All its roots are real, so the sign changes of its Taylor shift count the roots above a
point exactly (Descartes' rule is an equality then), and bisection isolates any root to any number of bits. A
component is the null space of the matrix less that root, by inverse iteration in decimal arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Context, Decimal, localcontext
from math import comb

import numpy as np

#: Roots are isolated to this many bits after their first, and null spaces computed with this many digits beyond those by
#: which a root is smaller than the matrix.
ROOT_BITS, DIGITS = 128, 110


def primes_below(start: int = 1 << 31) -> Iterator[int]:
    """Primes below `start`, largest first. Strong tests to 2, 3, 5 and 7 decide all numbers below 3.2 * 10^9."""
    n = start - 1
    while n > 7:
        d, s = n - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        if n % 2 and all(pow(a, d, n) == 1 or any(pow(a, d << r, n) == n - 1 for r in range(s)) for a in (2, 3, 5, 7)):
            yield n
        n -= 1


def enough_primes(trace: int, size: int) -> list[int]:
    """Primes whose product is over twice any coefficient of a positive semidefinite matrix with this trace.

    Its k-th coefficient is an elementary symmetric function of roots that are none below 0 and sum to the trace, so it
    is largest when all roots are equal (Maclaurin).
    """
    mean = trace // max(size, 1) + 1
    bound, product, out = 2 * max(comb(size, k) * mean**k for k in range(size + 1)), 1, []
    for p in primes_below():
        if product > bound:
            break
        out.append(p)
        product *= p
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo a prime below 2^31, the highest first. `matrix` is reduced modulo p."""
    h, n = matrix.astype(np.int64).copy(), len(matrix)
    for m in range(1, n - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    # Row k holds the polynomial of the leading k x k minor, the lowest coefficient first.
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, n + 1):
        new = -(polys[k - 1] * h[k - 1, k - 1] % p)
        new[1:] += polys[k - 1, :-1]
        run, weights = 1, np.zeros(k - 1, np.int64)
        for i in range(k - 1, 0, -1):
            run = run * int(h[i, i - 1]) % p
            weights[i - 1] = int(h[i - 1, k - 1]) * run % p
        new -= (polys[: k - 1] * weights[:, None] % p).sum(axis=0)
        polys[k] = new % p
    return polys[n, ::-1]


def remaindered(residues: Sequence[int], primes: Sequence[int]) -> int:
    """The integer nearest zero with these remainders."""
    x, m = 0, 1
    for r, p in zip(residues, primes, strict=True):
        x += m * ((r - x) * pow(m, -1, p) % p)
        m *= p
    return x - m if x > m // 2 else x


def roots_above(coefficients: Sequence[int], point: int, shift: int = 0) -> int:
    """How many roots, each as often as it counts, lie above point / 2^shift. All roots must be real."""
    c = [v << shift * i for i, v in enumerate(coefficients)]
    for end in range(len(c), 1, -1):
        for j in range(1, end):
            c[j] += point * c[j - 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def isolate(coefficients: Sequence[int], k: int, trace: int, bits: int = ROOT_BITS) -> tuple[Decimal, int, int] | None:
    """The k-th largest root, the number of the first root of its cluster and how many that has; None if it is not above 0.

    Roots that agree in `bits` bits are one cluster.
    """
    if roots_above(coefficients, 0) < k:
        return None
    high = trace.bit_length()  # no root is above the trace
    while (roots_above(coefficients, 1 << high - 1) if high > 0 else roots_above(coefficients, 1, 1 - high)) < k:
        high -= 1
    shift = max(0, bits - high + 1)
    low, up = 1 << high - 1 + shift, 1 << high + shift
    while up - low > max(1, low >> bits):
        middle = (low + up) // 2
        if roots_above(coefficients, middle, shift) >= k:
            low = middle
        else:
            up = middle
    above = roots_above(coefficients, up, shift)
    with localcontext(Context(prec=DIGITS)):
        root = Decimal(low + up) / Decimal(1 << shift + 1)
    return root, above + 1, roots_above(coefficients, low, shift) - above


def null_space(matrix: Sequence[Sequence[int]], root: Decimal, count: int) -> list[list[Decimal]]:
    """`count` orthonormal vectors that the matrix multiplies by `root`, by inverse iteration.

    The largest entry of each is above zero.
    """
    n = len(matrix)
    size = Decimal(max(abs(v) for row in matrix for v in row)).adjusted()
    with localcontext(Context(prec=DIGITS + max(0, size - root.adjusted()))):
        a = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object)
        a[np.arange(n), np.arange(n)] -= root
        tiny = max(abs(v) for v in a.flat).scaleb(-DIGITS) or Decimal(1)
        order = np.arange(n)
        for k in range(n):
            i = k + max(range(n - k), key=lambda j: abs(a[k + j, k]))
            if i != k:
                a[[i, k]], order[[i, k]] = a[[k, i]], order[[k, i]]
            if not a[k, k]:
                a[k, k] = tiny
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solved(b: np.ndarray) -> np.ndarray:
            x = b[order]
            for k in range(n):
                x[k + 1 :] -= a[k + 1 :, k] * x[k]
            for k in range(n - 1, -1, -1):
                x[k] /= a[k, k]
                x[:k] -= a[:k, k] * x[k]
            return x

        def unit(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
            for _ in range(2):
                for o in others:
                    v = v - o * (v * o).sum()
                v = v / (v * v).sum().sqrt()
            return v

        out: list[np.ndarray] = []
        for start in range(count):
            v = np.array([Decimal(1) / (1 + (start + 1) * i + start) for i in range(n)], dtype=object)
            for _ in range(4):
                v = unit(solved(v), out)
            out.append(v if max(v, key=abs) > 0 else -v)
        return [list(v) for v in out]
