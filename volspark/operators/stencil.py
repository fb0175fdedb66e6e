"""Window filters: means, medians, gradients, Sobel, Gaussian gradient, local equalisation, curvature flow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from volspark.operators.blocks import Borders, Chunks, along_axis, box_mean, chunked, on_chunks, over_blocks, over_chunks, replicated, voxels_of, windows


def _cube(r: int) -> tuple[int, int, int]:
    return (r, r, r)


def mean_filter(vox: DataFrame, r: int, boundary: str = "replicate") -> DataFrame:
    return over_blocks(vox, lambda p: box_mean(p, r), _cube(r), boundary)


def _by_plane(p: np.ndarray, halo: tuple[int, int, int], f) -> np.ndarray:
    """f of the windows of one core plane after the other, so that a large window's copies stay small."""
    d = 2 * halo[0] + 1
    return np.concatenate([f(windows(p[z : z + d], halo)) for z in range(p.shape[0] - d + 1)])


def _middle(w: np.ndarray) -> np.ndarray:
    """Median over the last axis: the middle value, of an even number the mean of the middle two. NaN goes last (as the largest)."""
    n = w.shape[-1]
    if n % 2:
        return np.partition(w, n // 2, axis=-1)[..., n // 2]
    part = np.partition(w, (n // 2 - 1, n // 2), axis=-1)
    return (part[..., n // 2 - 1] + part[..., n // 2]) / 2


def plain_median(p: np.ndarray, halo: tuple[int, int, int]) -> np.ndarray:
    return _by_plane(p, halo, _middle)


def median_filter(vox: DataFrame, halo: tuple[int, int, int], boundary: str = "replicate") -> DataFrame:
    """Median of the whole window; halo (z, y, x) may differ by axis."""
    return over_blocks(vox, lambda p: plain_median(p, halo), halo, boundary)


def median_without_centre(vox: DataFrame, r: int = 1) -> DataFrame:
    """Median of the neighbours alone: of their even number the mean of the middle two; borders mirrored without the edge."""
    return voxels_of(chunk_median_without_centre(chunked(vox, max(32, r)), r))


def chunk_median_without_centre(chunks: Chunks, r: int = 1) -> Chunks:
    n = (2 * r + 1) ** 3
    others = np.delete(np.arange(n), n // 2)
    return over_chunks(chunks, lambda p: _by_plane(p, _cube(r), lambda w: _middle(w[..., others])), _cube(r), "reflect")


def _central(p: np.ndarray) -> list[np.ndarray]:
    """Central differences of the core of an array padded by 1."""
    inner = [slice(1, -1)] * 3
    out = []
    for axis in range(3):
        hi, lo = list(inner), list(inner)
        hi[axis], lo[axis] = slice(2, None), slice(0, -2)
        out.append((p[tuple(hi)] - p[tuple(lo)]) / 2)
    return out


def plain_gradient(p: np.ndarray, truncate: bool = False) -> np.ndarray:
    g = np.sqrt(sum(d * d for d in _central(p)))
    return np.floor(np.clip(g, 0, 255)) if truncate else g


def gradient_magnitude(vox: DataFrame, truncate: bool = False, boundary: str = "replicate") -> DataFrame:
    """Square root of summed squared central differences (unit spacing); truncate: whole numbers 0..255."""

    return over_blocks(vox, lambda p: plain_gradient(p, truncate), (1, 1, 1), boundary)


def sobel_magnitude(vox: DataFrame) -> DataFrame:
    """[-1, 0, 1] on one axis and [1, 2, 1] on the others; borders replicated."""

    def kernel(p: np.ndarray) -> np.ndarray:
        total = 0.0
        for axis in range(3):
            g = p
            for a in range(3):
                n = g.shape[a] - 2
                lo, mid, hi = (np.take(g, np.arange(k, k + n), axis=a) for k in range(3))
                g = hi - lo if a == axis else lo + 2 * mid + hi
            total = total + g * g
        return np.sqrt(total)

    return over_blocks(vox, kernel, (1, 1, 1), "replicate")


def gaussian_weights(sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Sampled Gaussian of radius ceil(4 sigma), normalised, and its derivative, normalised to slope 1 on a ramp."""
    r = int(np.ceil(4 * sigma))
    k = np.arange(-r, r + 1)
    g = np.exp(-0.5 * (k / sigma) ** 2)
    d = k * g
    return g / g.sum(), d / (d * k).sum()


def gaussian_gradient(vox: DataFrame, sigma: float) -> DataFrame:
    """Gradient magnitude of the Gaussian-smoothed volume, by separable finite weights (not a recursive filter)."""
    return voxels_of(chunk_gaussian_gradient(chunked(vox, max(32, len(gaussian_weights(sigma)[0]) // 2)), sigma))


def chunk_gaussian_gradient(chunks: Chunks, sigma: float) -> Chunks:
    g, d = gaussian_weights(sigma)
    r = len(g) // 2

    def kernel(p: np.ndarray) -> np.ndarray:
        total = 0.0
        for axis in range(3):
            a = p
            for i in range(3):
                w = d if i == axis else g
                a = np.lib.stride_tricks.sliding_window_view(a, 2 * r + 1, axis=i) @ w
            total = total + a * a
        return np.sqrt(total)

    return over_chunks(chunks, kernel, _cube(r), "replicate")


#: Two damped oscillations each that add up to half a Gaussian and half its derivative (Farneback and Westin 2006; fixed values): cosine and sine
#: amplitudes, and the frequencies and dampings of both.
SMOOTH, SLOPE = ((1.3530, 1.8151), (-0.3531, 0.0902)), ((-0.6724, -3.4327), (0.6724, 0.6100))
WAVES = ((0.6681, -1.3932), (2.0787, -1.3732))


def recursive_weights(sigma: float, amplitudes: tuple[tuple[float, float], ...], slope: bool) -> tuple[np.ndarray, np.ndarray]:
    """(c, z): the response at distance n >= 0 is the real part of the sum of c z^n; on the other side the same, for slopes negated. Of sum 1, or
    of slope 1 on a ramp."""
    z = np.exp(np.array([complex(damping, w) for w, damping in WAVES]) / sigma)
    c = np.array([complex(a, -b) for a, b in amplitudes])
    gain = -2 * (c * z / (1 - z) ** 2).sum().real if slope else (c * (1 + z) / (1 - z)).sum().real
    return c / gain, z


def recursive_filter(x: np.ndarray, sigma: float, slope: bool = False) -> np.ndarray:
    """Gaussian smoothing, or its derivative, along the first axis: a recurrence forwards and one backwards, so the work does not grow with sigma.
    Beyond the ends the end's value goes on."""
    c, z = recursive_weights(sigma, SLOPE if slope else SMOOTH, slope)
    out = np.zeros(x.shape)
    for k in range(len(c)):
        state = x[0] / (1 - z[k])  # of the constant before the line
        for i in range(len(x)):
            state = z[k] * state + x[i]
            out[i] += (c[k] * state).real
        state = x[-1] / (1 - z[k])
        for i in range(len(x) - 1, -1, -1):  # what lies behind, the place itself left out
            out[i] += (-1 if slope else 1) * (c[k] * z[k] * state).real
            state = z[k] * state + x[i]
    return out


def recursive_gaussian_gradient(vox: DataFrame, sigma: float) -> DataFrame:
    """Gradient magnitude of the Gaussian-smoothed volume by recursive filters, an axis at a time over whole lines; borders replicated."""
    smooth, slope = lambda a: recursive_filter(a, sigma), lambda a: recursive_filter(a, sigma, True)
    c = along_axis(chunked(vox), 2, lambda v: (slope(v), smooth(v)), ("dx", "s"))
    c = along_axis(c, 1, lambda dx, s: (smooth(dx), slope(s), smooth(s)), ("dx", "dy", "s"))
    c = along_axis(c, 0, lambda dx, dy, s: (smooth(dx), smooth(dy), slope(s)), ("dx", "dy", "dz"))
    return voxels_of(on_chunks(c, lambda *d: np.sqrt(sum(x * x for x in d))))


def adaptive_equalisation(vox: DataFrame, alpha: float, beta: float, r: int, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """Local histogram equalisation after Stark (2000), over a range low..high mapped to -1/2..1/2.

    out(u) is the window's mean of q(u - w, alpha) - beta q(u - w, 1) + beta u, with the cumulation function
    q(d, a) = sign(d) |2 d|^a / 2: alpha = beta = 0 is classic equalisation, alpha = beta = 1 the identity.
    """

    return over_blocks(vox, lambda p: plain_equalisation(p, alpha, beta, r, low, high), _cube(r), "replicate")


def plain_equalisation(p: np.ndarray, alpha: float, beta: float, r: int, low: float, high: float) -> np.ndarray:
    return plain_equalisations(p, (alpha,), (beta,), (r,), low, high)[0]


def plain_equalisations(p: np.ndarray, alphas: tuple[float, ...], betas: tuple[float, ...], radii: tuple[int, ...], low: float, high: float) -> list[np.ndarray]:
    """The equalisations of all combinations (alpha first, then beta, then radius) of the core of an array padded by the largest radius. As q(d, 1) = d, the
    terms with beta add up to beta times the window's mean, so the powers are taken once for each alpha, a place of the largest window after the other, and
    no window is copied."""
    most = max(radii)
    w = (p - low) / (high - low) - 0.5
    size = [n - 2 * most for n in p.shape]
    u = w[tuple(slice(most, most + n) for n in size)]
    means, curves = np.zeros((len(radii), *size)), np.zeros((len(alphas), len(radii), *size))
    for offset in np.ndindex((2 * most + 1,) * 3):
        x = w[tuple(slice(o, o + n) for o, n in zip(offset, size, strict=True))]
        inside = [k for k, r in enumerate(radii) if max(abs(o - most) for o in offset) <= r]
        for k in inside:
            means[k] += x
        d = u - x
        sign, twice = np.sign(d), np.abs(2 * d)
        for a, alpha in enumerate(alphas):
            f = sign * (np.sqrt(twice) if alpha == 0.5 else twice**alpha)
            for k in inside:
                curves[a, k] += f
    n = np.array([(2 * r + 1) ** 3 for r in radii], float)
    return [((0.5 * curves[a, k] + beta * means[k]) / n[k] + 0.5) * (high - low) + low for a in range(len(alphas)) for beta in betas for k in range(len(radii))]


def curvature_diffusion(vox: DataFrame, iterations: int, step: float = 0.0625, conductance: float = 3.0) -> DataFrame:
    """Modified curvature diffusion: v grows by step * |grad v| * div(c(|grad v|) grad v / |grad v|), c = exp(-(|grad v| / conductance)^2 / 2).
    Nothing flows over the volume's border: before each iteration the values outside it are those of its edge.

    A halo of two voxels per iteration lets a block run them alone, in rounds of at most 4 between shuffles.
    """

    def sweep(p: np.ndarray) -> np.ndarray:
        """One iteration; the result is smaller by 2 on each side."""
        g = _central(p)
        size = np.sqrt(sum(d * d for d in g)) + 1e-12
        c = np.exp(-0.5 * (size / conductance) ** 2)
        inner = (slice(1, -1),) * 3
        div = sum(_central(c * g[axis] / size)[axis] for axis in range(3))
        return p[2:-2, 2:-2, 2:-2] + step * size[inner] * div

    if iterations < 1:
        return vox
    out, left = chunked(vox, 32), iterations
    while left > 0:
        n = min(left, 4)

        def kernel(p: np.ndarray, borders: Borders, n: int = n) -> np.ndarray:
            for k in range(n - 1, -1, -1):
                p = sweep(p)
                if k:
                    p = replicated(p, 2 * (n - k), borders)
            return p

        out = over_chunks(out, kernel, _cube(2 * n), "replicate", bordered=True)
        left -= n
    return voxels_of(out)
