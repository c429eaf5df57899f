"""Symmetric eigenvectors by spectral divide and conquer on QDWH polar decompositions."""

import numpy as np

#: Rounds of one polar decomposition; it takes six or seven.
ROUNDS = 30
EPS = np.finfo(float).eps


def _weights(low: float) -> tuple[float, float, float]:
    """The dynamical weights for singular values between `low` and 1."""
    d = np.cbrt(4 * (1 - low**2) / low**4)
    root = np.sqrt(1 + d)
    a = root + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)) / 2
    b = (a - 1) ** 2 / 4
    return a, b, a + b - 1


def polar_factor(matrix: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix: for eigenvalues away from 0, their signs.

    QR-based dynamically weighted Halley steps; Cholesky-based ones once the weights
    are small. An eigenvalue of exactly 0 stays near 0.
    """
    size = len(matrix)
    x = matrix / np.linalg.norm(matrix)
    low, one = EPS, np.eye(size)
    for _ in range(ROUNDS):
        a, b, c = _weights(low)
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))
            new = b / c * x + (a - b / c) / np.sqrt(c) * (q[:size] @ q[size:].T)
        else:
            z = np.linalg.cholesky(one + c * (x.T @ x))
            half = np.linalg.solve(z, x.T)
            new = b / c * x + (a - b / c) * np.linalg.solve(z.T, half).T
        new = (new + new.T) / 2
        low = min(1.0, low * (a + b * low**2) / (1 + c * low**2))
        moved = np.linalg.norm(new - x)
        x = new
        if abs(1 - low) < 10 * EPS and moved < 10 * EPS ** (1 / 3):
            break
    return x


def _halves(matrix: np.ndarray, shift: float, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below `shift`, or None if it parts none.

    (U + 1) / 2 projects on the subspace above, U the polar factor of the shifted matrix.
    """
    n = len(matrix)
    shifted = matrix - shift * np.eye(n)
    if not np.linalg.norm(shifted):
        return None
    projector = (polar_factor(shifted) + np.eye(n)) / 2
    above = int(round(float(np.trace(projector))))
    if not 0 < above < n:
        return None
    # Columns of the projector by falling length, so the first `above` of Q span its range.
    order = np.argsort(-np.einsum("ij,ij->j", projector, projector), kind="stable")
    basis, _ = np.linalg.qr(projector[:, order[:above]], mode="reduced")
    # One more step of subspace iteration makes the range exact where those columns were poor.
    basis, _ = np.linalg.qr(projector @ basis, mode="complete")
    upper, lower = basis[:, :above], basis[:, above:]
    if np.linalg.norm(lower.T @ matrix @ upper) > 100 * n * EPS * size:
        return None
    return upper, lower


def _shifts(matrix: np.ndarray):
    """Places to part the spectrum at, the likeliest first: in wide gaps of the diagonal, then all over its bounds."""
    diagonal = np.sort(np.diag(matrix))
    n = len(diagonal)
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    gaps = (diagonal[:-1] + diagonal[1:]) / 2
    yield from gaps[np.argsort(-np.diff(diagonal), kind="stable")][:8].tolist()
    reach = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    low, high = float((np.diag(matrix) - reach).min()), float((np.diag(matrix) + reach).max())
    for parts in (3, 7, 31, 127, 511):
        yield from (low + (high - low) * k / (parts + 1) for k in range(1, parts + 1))
    off = np.linalg.norm(matrix - np.diag(np.diag(matrix))) / n
    yield from (float(diagonal.mean()) + off * f for f in (0.5, -0.5, 0.1, -0.1, 0.01, -0.01))


def _turned(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a 2 x 2 block by its rotation."""
    angle = np.arctan2(2 * matrix[0, 1], matrix[0, 0] - matrix[1, 1]) / 2
    c, s = np.cos(angle), np.sin(angle)
    vectors = np.array([[c, -s], [s, c]])
    return np.einsum("ij,ik,kj->j", vectors, matrix, vectors), vectors


def _split(matrix: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors in any order; `size` is the norm of the whole matrix."""
    n = len(matrix)
    off = matrix - np.diag(np.diag(matrix))
    if n == 1 or np.linalg.norm(off) <= EPS * size:
        # As good as diagonal: its axes are its components.
        return np.diag(matrix).copy(), np.eye(n)
    if n == 2:
        return _turned(matrix)
    for shift in _shifts(matrix):
        parts = _halves(matrix, shift, size)
        if parts:
            break
    else:
        raise ArithmeticError("no shift parts the spectrum")
    values, vectors = [], []
    for basis in parts:
        part = basis.T @ matrix @ basis
        found, turned = _split((part + part.T) / 2, size)
        values.append(found)
        vectors.append(basis @ turned)
    return np.concatenate(values), np.concatenate(vectors, axis=1)


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of a symmetric matrix, by falling value; column k has vector k.

    Signs are such that each vector's largest entry (the first of equal ones) is
    positive. Where eigenvalues are equal, any orthonormal basis of their space comes
    out. A matrix of no rows gives none.
    """
    if not len(matrix):
        return np.zeros(0), np.zeros((0, 0))
    matrix = (matrix + matrix.T) / 2
    _, vectors = _split(matrix, float(np.linalg.norm(matrix)))
    # Rayleigh quotients of the joined vectors, and one step towards the matrix' own axes.
    vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ik,kj->j", vectors, matrix, vectors)
    vectors = _refined(matrix, values, vectors)
    values = np.einsum("ij,ik,kj->j", vectors, matrix, vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    return values[order], vectors * np.where(largest < 0, -1.0, 1.0)


def _refined(matrix: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One first-order correction of nearly exact eigenvectors, orthonormal again afterwards."""
    rest = vectors.T @ matrix @ vectors
    gap = values[None, :] - values[:, None]
    size = np.abs(values).max(initial=0.0)
    far = np.abs(gap) > np.sqrt(EPS) * size
    step = np.where(far, rest / np.where(far, gap, 1.0), 0.0)
    np.fill_diagonal(step, 0.0)
    basis, upper = np.linalg.qr(vectors + vectors @ step)
    return basis * np.where(np.diag(upper) < 0, -1.0, 1.0)
