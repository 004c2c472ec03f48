"""Exact characteristic polynomials of integer scatter matrices and their roots.

Plain integer helpers that run inside tasks or on matrices of the vector dimension:
``charpoly_mod`` (Hessenberg reduction modulo a prime), ``combine`` (Chinese
remainders), ``largest_roots`` (exact isolation: all roots of a scatter matrix are
real, so Descartes' count of sign changes is the number of roots above a point) and
``null_vectors`` (inverse iteration in long decimals).
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from math import comb

import numpy as np

#: Relative width of a root's interval, in bits.
ROOT_BITS = 160


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 3.2 * 10^9."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(dims: int, trace: int) -> list[int]:
    """31-bit primes whose product is over twice any coefficient.

    The k-th elementary symmetric function of non-negative roots is at most
    C(dims, k) * (trace / dims)^k.
    """
    mean = trace // dims + 1
    need = 2 * max(comb(dims, k) * mean ** k for k in range(dims + 1)) + 1
    primes, product, p = [], 1, (1 << 31) - 1
    while product < need:
        if _is_prime(p):
            primes.append(p)
            product *= p
        p -= 2
    return primes


def charpoly_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(xI - matrix) modulo ``p`` (below 2^31), lowest degree first."""
    h = np.array(matrix % p, dtype=np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        r = k + 1 + below[0]
        h[[k + 1, r]] = h[[r, k + 1]]
        h[:, [k + 1, r]] = h[:, [r, k + 1]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1][None, :] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u[None, :] % p).sum(axis=1)) % p
    # Polynomials of the leading blocks of the Hessenberg matrix, one from all before it.
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for k in range(d):
        new = (np.roll(polys[k], 1) - h[k, k] * polys[k] % p) % p
        factors, t = np.zeros(k, dtype=np.int64), 1
        for i in range(k - 1, -1, -1):
            t = t * int(h[i + 1, i]) % p
            factors[i] = t * int(h[i, k]) % p
        polys[k + 1] = (new - (factors[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d]


def combine(residues: dict[int, list[int]]) -> list[int]:
    """Signed integers from their residues by prime."""
    product = 1
    for p in residues:
        product *= p
    sums = [0] * len(next(iter(residues.values())))
    for p, values in residues.items():
        rest = product // p
        unit = rest * pow(rest, -1, p)
        sums = [s + unit * v for s, v in zip(sums, values)]
    sums = [s % product for s in sums]
    return [s - product if 2 * s > product else s for s in sums]


def roots_above(coeffs: list[int], a: int, shift: int) -> int:
    """Number of roots greater than a / 2^shift: sign changes of the shifted polynomial."""
    d = len(coeffs) - 1
    c = [v << (shift * (d - k)) for k, v in enumerate(coeffs)]
    for j in range(d):
        for k in range(d - 1, j - 1, -1):
            c[k] += a * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(coeffs: list[int], a: int, shift: int) -> int:
    d, v = len(coeffs) - 1, 0
    for k in range(d, -1, -1):
        v = v * a + (coeffs[k] << (shift * (d - k)))
    return (v > 0) - (v < 0)


def largest_roots(coeffs: list[int], wanted: int, top: int, bits: int = ROOT_BITS) -> list[tuple[int, int, int, int]]:
    """(lo, hi, shift, multiplicity) of the largest positive roots, falling, ``wanted`` with multiplicity.

    A root lies in (lo, hi] / 2^shift with hi - lo at most 2^-bits of it. Roots that
    agree to ``bits`` bits come as one multiple root. ``top`` is a bound of all roots;
    the polynomial has no root zero (divide by x first).
    """
    out: list[tuple[int, int, int, int]] = []
    todo = [(0, top + 1, 0, len(coeffs) - 1, 0)]           # lo, hi, shift, roots above lo, above hi
    while todo and sum(m for *_, m in out) < wanted:
        lo, hi, s, at_lo, at_hi = todo.pop()
        if at_lo == at_hi:
            continue
        if (hi - lo) << bits <= lo or lo == hi:
            out.append((lo, hi, s, at_lo - at_hi))
            continue
        if hi - lo == 1:
            lo, hi, s = lo << 32, hi << 32, s + 32
        mid = (lo + hi) // 2
        if at_lo - at_hi == 1:                              # one simple root: its sign change suffices
            sign = _sign(coeffs, mid, s)
            if sign == 0:
                todo.append((mid, mid, s, at_lo, at_hi))
            elif (sign > 0) == (at_hi % 2 == 0):
                todo.append((lo, mid, s, at_lo, at_hi))
            else:
                todo.append((mid, hi, s, at_lo, at_hi))
        else:
            n = roots_above(coeffs, mid, s)
            todo += [(lo, mid, s, at_lo, n), (mid, hi, s, n, at_hi)]
    return out


def _solve(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x = b[order].copy()
    d = len(x)
    for k in range(d):
        x[k + 1:] -= lu[k + 1:, k] * x[k]
    for k in range(d - 1, -1, -1):
        x[k] = (x[k] - (lu[k, k + 1:] * x[k + 1:]).sum()) / lu[k, k]
    return x


def null_vectors(matrix: list[list[int]], lo: int, hi: int, shift: int, count: int, rounds: int = 3) -> list[list[float]]:
    """``count`` orthonormal eigenvectors of the root in (lo, hi] / 2^shift, largest entry positive."""
    d = len(matrix)
    largest = max(abs(v) for row in matrix for v in row)
    with localcontext() as ctx:
        ctx.prec = digits = 60 + 2 * len(str(largest))
        root = Decimal(lo + hi) / (Decimal(2) ** (shift + 1))
        a = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object)
        for k in range(d):
            a[k, k] -= root
        order = list(range(d))
        for k in range(d):
            r = k + int(np.argmax(np.abs(a[k:, k])))
            a[[k, r]] = a[[r, k]]
            order[k], order[r] = order[r], order[k]
            if a[k, k] == 0:
                a[k, k] = Decimal(largest + 1).scaleb(-digits)
            a[k + 1:, k] /= a[k, k]
            a[k + 1:, k + 1:] -= np.multiply.outer(a[k + 1:, k], a[k, k + 1:])
        found: list[np.ndarray] = []
        for c in range(count):
            state = 12345 + c
            x = np.empty(d, dtype=object)
            for k in range(d):                               # a fixed start with no special direction
                state = (1103515245 * state + 12345) % (1 << 31)
                x[k] = Decimal(state + 1)
            for _ in range(rounds):
                x = _solve(a, order, x)
                for f in found:
                    x = x - f * (f * x).sum()
                x = x / (x * x).sum().sqrt()
            lead = max(range(d), key=lambda k: abs(x[k]))
            found.append(-x if x[lead] < 0 else x)
        return [[float(v) for v in f] for f in found]
