"""Plain numpy twins of the routines over flat buffers, and helpers to compare buffers."""

import numpy as np

RNG = np.random.default_rng(12345)


def random(*shape):
    """Uniform in [-2, 5]."""
    return RNG.uniform(-2, 5, shape)


def place(n, inc):
    k = np.arange(n) * abs(inc)
    return k if inc > 0 else k[::-1]


def strided(x, inc, pad=3):
    """A buffer that holds x at an increment; what lies between is a sentinel that must survive."""
    out = np.full((max(len(x), 1) - 1) * abs(inc) + 1 + pad, -77.0)
    out[place(len(x), inc)] = x
    return out


def flat(a, ld, pad=2):
    """Column-major with a leading dimension; padding is a sentinel."""
    m, n = a.shape
    out = np.full(ld * n + pad, -77.0)
    for j in range(n):
        out[j * ld : j * ld + m] = a[:, j]
    return out


def unflat(buf, m, n, ld):
    return np.stack([buf[j * ld : j * ld + m] for j in range(n)], axis=1)


def banded(a, kl, ku, ld):
    m, n = a.shape
    out = np.full((ld, n), np.nan)  # corners of band storage are never read
    for j in range(n):
        for i in range(max(0, j - ku), min(m, j + kl + 1)):
            out[ku + i - j, j] = a[i, j]
    return out.ravel(order="F")


def packed(a, uplo):
    n = len(a)
    return np.concatenate([a[: j + 1, j] if uplo == "u" else a[j:, j] for j in range(n)])


def op(a, trans):
    return a if trans == "n" else a.T


def tri(a, uplo, diag):
    t = np.triu(a) if uplo == "u" else np.tril(a)
    if diag == "u":
        np.fill_diagonal(t, 1.0)
    return t


def sym(a, uplo):
    t = np.triu(a) if uplo == "u" else np.tril(a)
    return t + t.T - np.diag(np.diag(a))


def poison(a, uplo, diag="n"):
    """NaN wherever a triangular routine must not look."""
    out = a.copy()
    out[np.tril_indices(len(a), -1) if uplo == "u" else np.triu_indices(len(a), 1)] = np.nan
    if diag == "u":
        np.fill_diagonal(out, np.nan)
    return out


def band_of(a, kl, ku):
    i, j = np.indices(a.shape)
    return np.where((i - j <= kl) & (j - i <= ku), a, 0)


def taken(df, size):
    out = np.full(size, np.nan)
    rows = df.collect()
    assert len(rows) == size
    for r in rows:
        out[r["pos"]] = r["v"]
    return out


def same(got, want, tol=1e-9):
    np.testing.assert_allclose(got, want, rtol=tol, atol=tol, equal_nan=True)
