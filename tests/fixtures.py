"""Deterministic recordings, all arithmetic."""

import numpy as np

from sonorum.sources.audio import Audio


def pluck(rate, f, n, decay, gain):
    t = np.arange(n) / rate
    return gain * np.exp(-decay * t) * np.sin(2 * np.pi * f * t)


def hit(rate, n, seed, gain):
    state, out, last = seed | 1, np.zeros(n), 0.0
    for i in range(n):
        state = (state * 6364136223846793005 + 1) % 2**64
        white = (state >> 33) / (2**32 - 1) * 2 - 1
        last = 0.5 * last + 0.5 * white
        out[i] = last * gain * np.exp(-40 * i / rate)
    return out


def mixed(into, at, x):
    n = min(len(x), len(into) - at)
    into[at : at + n] += x[:n]


def repetitive_loop(rate, format_, bars):
    beat = rate // 2
    x = np.zeros(beat * 4 * bars)
    drum = hit(rate, beat // 3, 12345, 0.3)
    for k in range(4 * bars):
        mixed(x, k * beat, pluck(rate, 110, beat, 9, 0.45))
        mixed(x, k * beat + beat // 2, drum)
    return Audio(rate, format_, x).quantized()


def chord_progression(rate, format_):
    x = np.zeros(4 * rate)
    for bar, chord in enumerate(((57, 60, 64), (55, 59, 62), (53, 57, 60), (50, 53, 57))):
        for n in chord:
            mixed(x, bar * rate, pluck(rate, 440 * 2 ** ((n - 69) / 12), rate, 2.5, 0.22))
    return Audio(rate, format_, x).quantized()


def wide_stereo(rate, format_):
    beat = rate // 2
    x = np.zeros((2, beat * 8))
    for k in range(8):
        mixed(x[0], k * beat, pluck(rate, 165, beat, 7, 0.4))
        if k % 2:
            mixed(x[1], k * beat, pluck(rate, 247, beat, 7, 0.4))
    return Audio(rate, format_, x).quantized()


def repeated(rate, times, spacing):
    t = np.arange(spacing) / rate
    one = 0.6 * np.exp(-8 * t) * (np.sin(2 * np.pi * 220 * t) + 0.4 * np.sin(2 * np.pi * 440 * t)) / 1.4
    x = np.zeros((times + 1) * spacing)
    for k in range(times):
        x[k * spacing : (k + 1) * spacing] = one
    return x


def clicks(bpm, seconds, hop):
    x = np.zeros(int(seconds / hop))
    period = 60 / bpm / hop
    k = 0
    while round(k * period) < len(x):
        at = round(k * period)
        for j, v in enumerate((1.0, 0.5, 0.25)):
            if at + j < len(x):
                x[at + j] += v
        k += 1
    return x
