"""An FM-index over a sequence of symbols: wavelet matrix for ranks, sampled suffix positions for locating."""

from __future__ import annotations

import numpy as np


def suffix_positions(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in ascending order, by doubling the compared length; ``text`` ends with a unique least symbol."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, reach = len(text), 1
    while True:
        key = rank * (n + 1)
        key[: n - reach] += rank[reach:] + 1
        order = np.argsort(key, kind="stable")
        changed = np.concatenate([[0], (key[order][1:] != key[order][:-1]).cumsum()])
        rank = np.empty(n, np.int64)
        rank[order] = changed
        if changed[-1] == n - 1:
            return order
        reach = min(2 * reach, n - 1)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one stable bit partition for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []
        now = symbols
        for b in range(self.bits - 1, -1, -1):
            one = (now >> b) & 1 == 1
            before = np.zeros(len(now) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            now = np.concatenate([now[~one], now[one]])
        self.last = now

    def rank(self, symbol: np.ndarray, until: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        begin = np.zeros_like(until)
        for level, before in enumerate(self.zeros):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            zeros = before[-1]
            begin = np.where(one, zeros + begin - before[begin], before[begin])
            until = np.where(one, zeros + until - before[until], before[until])
        return until - begin

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbols at the places."""
        symbol = np.zeros_like(place)
        for before in self.zeros:
            zero = before[place + 1] > before[place]
            symbol = symbol * 2 + ~zero
            place = np.where(zero, before[place], before[-1] + place - before[place])
        return symbol


class FMIndex:
    """Counts and locates phrases in ``text`` (non-negative symbols that end with a unique 0)."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        order = suffix_positions(text)
        self.n = len(text)
        turned = text[order - 1]
        self.wavelet = WaveletMatrix(turned)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        self.sampled = order % sample == 0
        self.sample_before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of all phrases at once, read backwards; rows are padded on the right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1 if len(phrases) else 1):
            now = live[lengths[live] >= back]
            symbol = phrases[now, lengths[now] - back]
            known = symbol < len(self.below) - 1
            high[now[~known]] = low[now[~known]]
            now, symbol = now[known], symbol[known]
            low[now] = self.below[symbol] + self.wavelet.rank(symbol, low[now])
            high[now] = self.below[symbol] + self.wavelet.rank(symbol, high[now])
            live = live[high[live] > low[live]]
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at ``places``: steps back in the text until a sampled suffix."""
        found = np.zeros(len(places), np.int64)
        left, now, steps = np.arange(len(places)), places, 0
        while len(left):
            ready = self.sampled[now]
            found[left[ready]] = self.samples[self.sample_before[now[ready]]] + steps
            left, now = left[~ready], now[~ready]
            symbol = self.wavelet.at(now)
            now = self.below[symbol] + self.wavelet.rank(symbol, now)
            steps += 1
        return found
