"""NumPy transforms of single signals."""

from __future__ import annotations

import numpy as np


def octave_grid(low_exp: float, top: float, step: float = 0.1) -> np.ndarray:
    """2 ** (low_exp, low_exp + step, ...) up to top."""
    exps = np.arange(low_exp, np.log2(top) + step, step)
    f = 2.0**exps
    return f[f <= top]


def morlet(freq: float, rate: float, n_cycles: float) -> np.ndarray:
    """Complex wavelet: a carrier without mean under a Gaussian of n_cycles / (2 pi freq) seconds, cut at 5 deviations, of norm sqrt(2)."""
    sigma = n_cycles / (2 * np.pi * freq)
    t = np.arange(0, 5 * sigma, 1 / rate)
    t = np.r_[-t[:0:-1], t]
    w = (np.exp(2j * np.pi * freq * t) - np.exp(-2 * (np.pi * freq * sigma) ** 2)) * np.exp(-(t**2) / (2 * sigma**2))
    return w * np.sqrt(2) / np.linalg.norm(w)


def wavelet_bank(freqs: np.ndarray, rate: float) -> list[np.ndarray]:
    """The wavelets of max(2, f / 2) cycles of all frequencies."""
    return [morlet(f, rate, max(2.0, f / 2)) for f in freqs]


def morlet_transform(signals: np.ndarray, freqs: np.ndarray, rate: float) -> np.ndarray:
    """Complex (signals, freqs, samples) convolutions, as long as the signal, which is 0 beyond its ends."""
    n, bank = signals.shape[1], wavelet_bank(freqs, rate)
    size = 1 << int(np.ceil(np.log2(n + max(map(len, bank)) - 1)))
    spectrum = np.fft.fft(signals, size)
    out = np.empty((len(signals), len(bank), n), complex)
    for i, w in enumerate(bank):
        at = (len(w) - 1) // 2
        out[:, i] = np.fft.ifft(spectrum * np.fft.fft(w, size))[:, at : at + n]
    return out


def band_taps(n: int, low: float, high: float, rate: float) -> np.ndarray:
    """Hamming-windowed sinc band-pass of n (made odd) taps, with gain 1 at the band's centre."""
    n += 1 - n % 2
    t = np.arange(n) - n // 2
    taps = (2 * high / rate * np.sinc(2 * high / rate * t) - 2 * low / rate * np.sinc(2 * low / rate * t)) * np.hamming(n)
    return taps / np.abs(np.sum(taps * np.exp(-2j * np.pi * (low + high) / 2 / rate * t)))


#: Kernels of at most so many values are summed directly.
DIRECT = 64


def block_convolve(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """np.convolve(x, kernel) of a signal and a kernel, long kernels by transforms of blocks whose tails are added to the next ones."""
    m, n = len(kernel), len(x)
    if m <= DIRECT or n <= DIRECT:
        return np.convolve(x, kernel)
    size = 1 << int(np.ceil(np.log2(min(4 * m, n + m - 1))))
    own = size - m + 1
    blocks = np.zeros((-(-n // own), own), x.dtype)
    blocks.ravel()[:n] = x
    if np.iscomplexobj(x) or np.iscomplexobj(kernel):
        done = np.fft.ifft(np.fft.fft(blocks, size) * np.fft.fft(kernel, size))
    else:
        done = np.fft.irfft(np.fft.rfft(blocks, size) * np.fft.rfft(kernel, size), size)
    out = np.zeros(len(blocks) * own + m - 1, done.dtype)
    out[: len(blocks) * own] = done[:, :own].ravel()
    for i, tail in enumerate(done[:, own:], 1):
        out[i * own : i * own + m - 1] += tail
    return out[: n + m - 1]


def snapped(values: np.ndarray, scale: float) -> np.ndarray:
    """Values on a grid of 2^-40 of the power of two at scale, so that what is equal stays so whatever was rounded on the way."""
    if not scale or not np.isfinite(scale):
        return values
    grid = 2.0 ** (np.ceil(np.log2(scale)) - 40)
    return np.round(values / grid) * grid


def analytic_kernel(taps: np.ndarray) -> np.ndarray:
    """The filter's forward and backward pass with only its positive frequencies (doubled), as one complex kernel of 4 * len(taps) + 1 values.

    A band-pass has next to no gain at 0, so this kernel has faded out by then, and the analytic signal follows from
    samples nearby instead of from the whole recording.
    """
    reach = 2 * len(taps)
    both = np.convolve(taps, taps[::-1])
    n = 1 << int(np.ceil(np.log2(8 * reach)))
    x = np.zeros(n)
    x[np.arange(len(both)) - len(taps) + 1] = both
    gain = np.zeros(n)
    gain[1 : n // 2] = 2
    return np.fft.ifft(np.fft.fft(x) * gain)[np.arange(-reach, reach + 1)]


def odd_ends(signal: np.ndarray, left: int, right: int) -> np.ndarray:
    """The signal, continued by odd reflection over so many samples at its ends."""
    return np.r_[2 * signal[0] - signal[left:0:-1], signal, 2 * signal[-1] - signal[-2 : -right - 2 : -1]]


def welch(segments: np.ndarray, rate: float, n_fft: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies in [low, high] and mean power density over whole blocks of n_fft samples (Hamming window, mean removed)."""
    n = segments.shape[1] // n_fft
    blocks = segments[:, : n * n_fft].reshape(len(segments), n, n_fft)
    blocks = blocks - blocks.mean(2, keepdims=True)
    win = np.hamming(n_fft + 1)[:-1]
    power = np.abs(np.fft.rfft(blocks * win)) ** 2 / (rate * (win**2).sum())
    power[:, :, 1 : (n_fft + 1) // 2] *= 2
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    use = (f >= low) & (f <= high)
    return f[use], power.mean(1)[:, use]


def tfce(t: np.ndarray, start: float = 0.0, step: float = 0.2, e: float = 0.5, h: float = 2.0) -> np.ndarray:
    """Threshold-free cluster enhancement of a (freq, time) map with four neighbours, for both signs."""
    out = np.zeros_like(t)
    for sign in (1, -1):
        x = np.maximum(sign * t, 0)
        for level in np.arange(start + step, x.max() + 1e-12, step):
            labels = _clusters(x >= level)
            sizes = np.bincount(labels.ravel())
            sizes[0] = 0
            out += sign * (sizes[labels] ** e) * level**h * step
    return out


def _clusters(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of connected cells: the least index spreads to neighbours until nothing changes."""
    lab = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        big = np.where(lab == 0, np.iinfo(np.int64).max, lab)
        near = big.copy()
        near[1:] = np.minimum(near[1:], big[:-1])
        near[:-1] = np.minimum(near[:-1], big[1:])
        near[:, 1:] = np.minimum(near[:, 1:], big[:, :-1])
        near[:, :-1] = np.minimum(near[:, :-1], big[:, 1:])
        new = np.where(mask, near, 0)
        if (new == lab).all():
            return new
        lab = new


def t_values(sums: np.ndarray, squares: np.ndarray, n: int) -> np.ndarray:
    """One-sample t values from sums and sums of squares of n observations; 0 where there is no spread."""
    mean = sums / n
    var = (squares - n * mean**2) / (n - 1)
    spread = var > 1e-12 * np.maximum(squares / n, 1e-300)
    return np.where(spread, mean / np.sqrt(np.where(spread, var, 1) / n), 0.0)
