"""Numerics on stacks of equally long rows (series x samples), for use on Arrow batches inside tasks."""

from __future__ import annotations

import numpy as np


def welch(x: np.ndarray, rate: float, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power densities: Hann segments of ``length`` that overlap by half, each without its mean."""
    length = min(length, x.shape[1])
    starts = np.arange(0, x.shape[1] - length + 1, max(1, length // 2))
    segments = x[:, starts[:, None] + np.arange(length)]
    window = np.hanning(length + 1)[:-1]
    spectra = np.abs(np.fft.rfft((segments - segments.mean(axis=2, keepdims=True)) * window, axis=2)) ** 2
    power = spectra.mean(axis=1) / (rate * (window**2).sum())
    power[:, 1 : (length + 1) // 2] *= 2
    return np.fft.rfftfreq(length, 1 / rate), power


def butterworth(order: int, low: float | None, high: float | None, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a digital Butterworth filter by the bilinear transform: high-, low- or band-pass."""
    k = np.arange(order)
    poles = -np.exp(1j * np.pi * (2 * k - order + 1) / (2 * order))
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    if low and high:
        a, b = warp(low), warp(high)
        half = poles * (b - a) / 2
        root = np.sqrt(half**2 - a * b)
        poles, zeros = np.concatenate([half + root, half - root]), np.r_[np.ones(order), -np.ones(order)]
        centre = np.exp(1j * 2 * np.arctan(np.sqrt(a * b) / (2 * rate)))
    elif high:
        poles, zeros, centre = poles * warp(high), -np.ones(order), 1.0
    else:
        poles, zeros, centre = warp(low) / poles, np.ones(order), -1.0
    digital = (2 * rate + poles) / (2 * rate - poles)
    digital = np.concatenate([digital[digital.imag > 1e-12], np.sort_complex(digital[np.abs(digital.imag) <= 1e-12])])
    sections, real = [], [p for p in digital if abs(p.imag) <= 1e-12]
    pairs = [(p, p.conjugate()) for p in digital if p.imag > 1e-12] + [(real[i], real[i + 1] if i + 1 < len(real) else None) for i in range(0, len(real), 2)]
    ends = zeros.tolist()
    for p, q in pairs:
        # one zero at each end of the spectrum for a band, else two at the same end
        z = [ends.pop(0)] + ([ends.pop(-1)] if q is not None and ends else [])
        b = np.real(np.poly(z))
        a = np.real(np.poly([p] if q is None else [p, q]))
        gain = abs(np.polyval(b, centre) / np.polyval(a, centre)) if q is None else abs(np.polyval(b, centre) * centre ** (2 - (len(b) - 1)) / np.polyval(a, centre))
        sections.append((b / gain, a))
    return sections


def filtered(sections: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Both ways through the sections (no phase), with odd extension at the ends and each section settled on the first sample."""
    pad = min(3 * (2 * len(sections) + 1), x.shape[1] - 1)
    y = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1) if pad else x
    for _ in range(2):
        for b, a in sections:
            b, a = np.r_[b, np.zeros(3 - len(b))], np.r_[a, np.zeros(3 - len(a))]
            steady = b.sum() / a.sum()
            s1, s2 = (steady - b[0]) * y[:, 0], (b[2] - a[2] * steady) * y[:, 0]
            out = np.empty_like(y)
            for n in range(y.shape[1]):
                v = y[:, n]
                w = b[0] * v + s1
                s1, s2 = b[1] * v - a[1] * w + s2, b[2] * v - a[2] * w
                out[:, n] = w
            y = out
        y = y[:, ::-1]
    return y[:, pad : pad + x.shape[1]]


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal of each row, by the one-sided spectrum."""
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1)


def morlet(x: np.ndarray, rate: float, freqs: np.ndarray, cycles: float = 7.0) -> np.ndarray:
    """Complex wavelet coefficients, rows x frequencies x samples: zero-mean wavelets of unit energy."""
    out = np.empty((x.shape[0], len(freqs), x.shape[1]), complex)
    for i, f in enumerate(freqs):
        sigma = cycles / (2 * np.pi * f)
        t = np.arange(-np.ceil(5 * sigma * rate), np.ceil(5 * sigma * rate) + 1) / rate
        envelope = np.exp(-(t**2) / (2 * sigma**2))
        wave = envelope * (np.exp(2j * np.pi * f * t) - np.exp(-((2 * np.pi * f * sigma) ** 2) / 2))
        wave /= np.sqrt((np.abs(wave) ** 2).sum())
        size = x.shape[1] + len(wave) - 1
        full = np.fft.ifft(np.fft.fft(x, size, axis=1) * np.fft.fft(wave, size), axis=1)
        begin = (len(wave) - 1) // 2
        out[:, i] = full[:, begin : begin + x.shape[1]]
    return out


def notch(freq: float, width: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """One section that takes out ``freq``; ``width`` is the band, in the same unit, below half power."""
    w = 2 * np.pi * freq / rate
    gain = 1 / (1 + np.tan(np.pi * width / rate))
    b = gain * np.array([1.0, -2 * np.cos(w), 1.0])
    return b, np.array([1.0, -2 * gain * np.cos(w), 2 * gain - 1])


def resampled(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Rows at up/down times their rate: a Kaiser-windowed low-pass between zeros, every ``down``-th value kept, no delay."""
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    spread = np.zeros((x.shape[0], x.shape[1] * up))
    spread[:, ::up] = x
    size = spread.shape[1] + len(taps) - 1
    full = np.fft.irfft(np.fft.rfft(spread, size, axis=1) * np.fft.rfft(taps, size), size, axis=1)
    return full[:, half : half + spread.shape[1]][:, ::down]
