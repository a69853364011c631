"""Exact inner products in a residue number system: float32 matrix products modulo small primes, put together by Chinese remaindering."""

from __future__ import annotations

import numpy as np

#: Sums of float32 products are exact below this.
EXACT = 1 << 24


def primes_for(bound: int) -> list[int]:
    """The largest primes under 256, as many as tell all integers of at most ``bound`` in magnitude apart."""
    out, product = [], 1
    for p in range(255, 2, -1):
        if all(p % q for q in range(2, 16) if q < p):
            out.append(p)
            product *= p
            if product > 2 * bound + 1:
                return out
    raise OverflowError(f"primes under 256 don't reach {bound}")


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, between -p/2 and p/2, as float32."""
    return ((x + p // 2) % p - p // 2).astype(np.float32)


def _remainder(x: np.ndarray, y: np.ndarray, p: int) -> np.ndarray:
    """Inner products of rows of x and y modulo p; dimensions are added in runs so short that float32 holds every sum exactly."""
    width, total = EXACT // (p // 2) ** 2, None
    a, b = centred(x, p), centred(y, p)
    for at in range(0, max(1, x.shape[1]), width):
        part = (a[:, at : at + width] @ b[:, at : at + width].T).astype(np.int32) % p
        total = part if total is None else (total + part) % p
    return total


def products(x: np.ndarray, y: np.ndarray, bound: int) -> np.ndarray:
    """All inner products of integer rows of x and y, exact and signed; none may exceed ``bound`` in magnitude, nor ``bound`` 2^62."""
    primes = primes_for(bound)
    digits: list[np.ndarray] = []  # mixed radix: digits[0] + digits[1] * p0 + digits[2] * p0 * p1 ...
    for i, p in enumerate(primes):
        digit = _remainder(x, y, p)
        if i:
            so_far, radix = digits[-1] % p, 1
            for q, d in zip(primes[i - 2 :: -1] if i > 1 else [], digits[-2::-1]):
                so_far = (so_far * q + d) % p
            for q in primes[:i]:
                radix = radix * q % p
            digit = (digit - so_far) * pow(radix, -1, p) % p
        digits.append(digit)
    # The largest residues stand for negative numbers. Sums wrap at 2^64, which the last subtraction undoes.
    half, total = [], 1
    for p in primes:
        total *= p
    rest = total // 2
    for p in primes:
        half.append(rest % p)
        rest //= p
    negative, value, unit = np.zeros(digits[0].shape, bool), np.zeros(digits[0].shape, np.uint64), 1
    for p, d, h in zip(primes, digits, half):
        negative = (d > h) | (d == h) & negative
        value += d.astype(np.uint64) * np.uint64(unit % (1 << 64))
        unit *= p
    value[negative] -= np.uint64(total % (1 << 64))
    return value.view(np.int64)
