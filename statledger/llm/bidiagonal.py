"""Singular values and right singular vectors of a small square matrix.

Householder reflections bring the matrix to upper bidiagonal form B. dqds then finds the squares of
B's singular values, each to high relative accuracy, and for those wanted a twisted factorisation of
B'B less the square gives the vector in one multiplication each way from the twist.
"""

import numpy as np

_EPS = np.finfo(float).eps
# Entries of the qd arrays below this share of the largest are 0 to any accuracy asked for.
_FLOOR = 1e-60
# Squares nearer to each other than this share are a cluster, whose vectors are made orthogonal.
_CLOSE = 1e-4


def bidiagonalise(matrix: np.ndarray) -> tuple:
    """(diagonal, superdiagonal, right) with right's columns orthonormal: matrix @ right = left @ B."""
    a = np.array(matrix, float)
    n = len(a)
    right = np.eye(n)
    for k in range(n):
        v, beta, a[k, k] = _reflector(a[k:, k])
        a[k + 1:, k] = 0
        a[k:, k + 1:] -= beta * np.outer(v, v @ a[k:, k + 1:])
        if k + 1 < n:
            v, beta, a[k, k + 1] = _reflector(a[k, k + 1:])
            a[k, k + 2:] = 0
            a[k + 1:, k + 1:] -= beta * np.outer(a[k + 1:, k + 1:] @ v, v)
            right[:, k + 1:] -= beta * np.outer(right[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflector(x: np.ndarray) -> tuple:
    """(v, beta, head): x less beta v (v'x) is head in the first place and 0 behind it."""
    size = np.linalg.norm(x)
    if size == 0:
        return np.zeros_like(x), 0.0, 0.0
    scaled = x / size
    head = -np.copysign(np.linalg.norm(scaled), scaled[0])
    v = scaled.copy()
    v[0] -= head
    return v, 2 / (v @ v), head * size


def squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix, falling, by dqds with deflation."""
    q, e = (np.square(x, dtype=float) for x in (diagonal, above))
    largest = max(q.max(initial=0.0), e.max(initial=0.0))
    if largest == 0:
        return np.zeros(len(q))
    q, e = np.maximum(q, _FLOOR * largest).tolist(), np.maximum(e, _FLOOR * largest).tolist()
    blocks, found = [(q, e, 0.0)], []
    while blocks:
        q, e, shifted = blocks.pop()
        while q:
            if len(q) == 1:
                found.append(shifted + q.pop())
                break
            negligible = _EPS**2
            if e[-1] <= negligible * (shifted + q[-1]):
                found.append(shifted + q.pop())
                e.pop()
                continue
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= negligible * (shifted + min(q[k], q[k + 1]))), None)
            if cut is not None:
                blocks.append((q[:cut + 1], e[:cut], shifted))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            q, e, step = _shifted_sweep(q, e)
            shifted += step
    return np.sort(found)[::-1]


def _shifted_sweep(q: list, e: list) -> tuple:
    """The next qd arrays and the shift taken from them, at most their smallest eigenvalue."""
    # The smaller eigenvalue of the last two rows' 2 by 2, which tends to the smallest of all from above,
    # and a bound from below (of singular values, by their rows) stand for trial shifts.
    a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-1], e[-1]
    total, product = a + b + c, a * b
    root = np.sqrt(max(total * total - 4 * product, 0.0))
    near = 2 * product / (total + root) if total + root > 0 else 0.0
    sides = np.sqrt([0.0, *e, 0.0])
    safe = max(0.0, float(np.min(np.sqrt(q) - 0.5 * (sides[1:] + sides[:-1]))))**2
    for shift in sorted({near * (1 - 4 * _EPS), near * 0.99, near * 0.75, near / 4, safe * (1 - 8 * _EPS)}, reverse=True):
        if shift > 0:
            made = _sweep(q, e, shift)
            if made:
                return *made, shift
    return *_sweep(q, e, 0.0), 0.0


def _sweep(q: list, e: list, shift: float):
    """One dqds transform; None if the shift is beyond the smallest eigenvalue."""
    d = q[0] - shift
    new_q, new_e = [], []
    for k, off in enumerate(e):
        if d < 0:
            return None
        whole = d + off
        ratio = q[k + 1] / whole if whole > 0 else 0.0
        new_q.append(whole)
        new_e.append(off * ratio)
        d = (d * ratio if whole > 0 else q[k + 1]) - shift
    if d < 0:
        return None
    return [*new_q, d], new_e


def _twisted(q: np.ndarray, ratios: np.ndarray, square: float) -> tuple:
    """(twists, multipliers down to and up from each row) of LDL' less the square: D = q, L's entries ratios."""
    n = len(q)
    tiny = np.finfo(float).tiny
    fore, aft = np.empty(n), np.empty(n)
    down, up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s = -square
    for k in range(n - 1):
        fore[k] = s
        pivot = (s + q[k]) or tiny
        down[k] = ratios[k] * q[k] / pivot
        s = down[k] * ratios[k] * s - square
    fore[n - 1] = s
    p = q[n - 1] - square
    for k in range(n - 2, -1, -1):
        aft[k + 1] = p
        pivot = (q[k] * ratios[k]**2 + p) or tiny
        up[k] = ratios[k] * q[k] / pivot
        p = p * (q[k] / pivot) - square
    aft[0] = p
    return np.abs(fore + aft + square), down, up


def vectors(diagonal: np.ndarray, above: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Right singular vectors of the bidiagonal matrix, a column for each of the wanted squares, falling."""
    n = len(diagonal)
    largest = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    d = np.where(np.abs(diagonal) < np.sqrt(_FLOOR) * largest, np.sqrt(_FLOOR) * largest, diagonal)
    q, ratios = d * d, above / d[:-1]
    out = np.zeros((n, len(wanted)))
    for k, square in enumerate(wanted):
        with np.errstate(all="ignore"):
            twists, down, up = _twisted(q, ratios, square)
        near = [j for j in range(k) if wanted[j] - square <= _CLOSE * wanted[j]]
        # The best twist's vector, or, where others of its cluster have taken that direction, the next's.
        best, best_left = None, 0.0
        for twist in np.argsort(np.where(np.isfinite(twists), twists, np.inf), kind="stable"):
            z = np.zeros(n)
            z[twist] = 1.0
            for j in range(twist - 1, -1, -1):
                z[j] = -down[j] * z[j + 1]
            for j in range(twist, n - 1):
                z[j + 1] = -up[j] * z[j]
            if not np.isfinite(z).all():
                continue
            z /= np.linalg.norm(z)
            left = z
            for _ in range(2):
                left = left - out[:, near] @ (out[:, near].T @ left)
            size = np.linalg.norm(left)
            if size > best_left:
                best, best_left = left / size, size
            if not near or best_left > 0.5:
                break
        out[:, k] = best
    return out


def right_singular(matrix: np.ndarray, most: int) -> tuple:
    """(all squares of singular values, falling; the first `most` right singular vectors as columns).

    Only squares that rounding can't have made are given vectors, so there may be fewer columns.
    """
    if not matrix.size or not np.abs(matrix).max():
        return np.zeros(len(matrix)), np.zeros((len(matrix), 0))
    scale = np.abs(matrix).max()
    diagonal, above, right = bidiagonalise(matrix / scale)
    found = squares(diagonal, above)
    real = found > (len(matrix) * _EPS)**2 * found[0]
    wanted = found[:most][real[:most]]
    return found * scale**2, right @ vectors(diagonal, above, wanted)
