"""Approximate containment (K6): the best similarity of a text with any window of another, by longest common subsequence.

`partial_ratio` says what is meant, for one pair. `PhraseIndex` finds the same for many phrases in a batch of texts:
where a phrase is similar enough, so few letters are lost or put in that one of its disjoint pieces of three letters
stands there untouched. So the pieces are kept in an inverted index, all texts' trigrams probe it at once, and only
around the places that hit are subsequences measured. A window wide enough to hold every alignment bounds them all: first
by the letters that it shares with the phrase, from running tallies, then by its subsequence, for all places together in
bits of one array. For the few that are left each alignment is measured."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Letters of a piece; slots of the index, by bits; places measured together; letters of texts in a block.
PIECE, SLOT_BITS, TOGETHER, BLOCK = 3, 16, 1 << 16, 1 << 18
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of a: one integer operation a character of b."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & mask
    return len(a) - row.bit_count()


def partial_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """200 * LCS / (lengths) of the shorter with the best window of the longer: windows of the shorter's length, and
    shorter ones clipped at either end. 0 where nothing reaches the floor."""
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    n, most, best, shared = len(short), len(long_), 0.0, 0
    letters, held = Counter(short), Counter()
    for end in range(1, most + n):
        start = end - n
        if end <= most:
            shared += held[long_[end - 1]] < letters[long_[end - 1]]
            held[long_[end - 1]] += 1
        if start > 0:
            held[long_[start - 1]] -= 1
            shared -= held[long_[start - 1]] < letters[long_[start - 1]]
        size = min(end, most) - max(start, 0)
        if 200 * shared >= max(best, floor) * (n + size):  # no subsequence is longer than the shared letters
            best = max(best, 200 * lcs_length(short, long_[max(start, 0) : end]) / (n + size))
            if best == 100:
                break
    return best if best >= floor else 0.0


def allowed(n: int, floor: float) -> int:
    """The most letters that may be lost or put in where a window of at most n letters reaches the floor against n letters."""
    best = 0
    for m in range(1, n + 1):
        least = -(-floor * (n + m) // 200)
        if least <= m:
            best = max(best, int(n + m - 2 * least))
    return best


def heads(codes: np.ndarray, base: int) -> np.ndarray:
    """A slot for the first PIECE letters from each place on."""
    n = max(len(codes) - PIECE + 1, 0)
    out = codes[:n].astype(np.uint32)
    for k in range(1, PIECE):
        out *= np.uint32(base)
        out += codes[k : k + n].astype(np.uint32)
    return out & np.uint32((1 << SLOT_BITS) - 1)


class _Pieces:
    """Pieces of one length: (letters' codes, phrase, place there), found by slot."""

    def __init__(self, size: int, base: int, pieces: list[tuple[np.ndarray, int, int]]) -> None:
        self.size, self.base = size, base
        packed = np.array([self.pack(codes, np.zeros(1, np.int64))[0] for codes, _, _ in pieces], np.int64)
        self.heads = np.zeros(1 << SLOT_BITS, bool)
        self.heads[[heads(codes, base)[0] for codes, _, _ in pieces]] = True
        slots = self.slot(packed)
        order = np.argsort(slots, kind="stable")
        self.packed, self.phrase, self.place = packed[order], *(np.array([x[j] for x in pieces], np.int64)[order] for j in (1, 2))
        self.starts = np.searchsorted(slots[order], np.arange((1 << SLOT_BITS) + 1))

    def pack(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The letters from each of some places on, as one number."""
        out = codes[at].astype(np.int64)
        for k in range(1, self.size):
            out = out * self.base + codes[at + k]
        return out

    @staticmethod
    def slot(packed: np.ndarray) -> np.ndarray:
        return (packed.astype(np.uint64) * _SPREAD >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, codes: np.ndarray, begun: np.ndarray, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces stand (at `where` only, if given), of which phrase, and where the phrase would begin. begun: heads() of the
        codes; only where a piece may begin are all of its letters read."""
        if len(codes) < self.size:
            return (np.zeros(0, np.int64),) * 3
        open_ = self.heads[begun[: len(codes) - self.size + 1]]
        at = np.flatnonzero(open_ if where is None else open_ & where[: len(open_)])
        packed = self.pack(codes, at)
        slots = self.slot(packed)
        many = np.diff(self.starts)[slots]
        entry = np.repeat(self.starts[slots] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        at, packed = np.repeat(at, many), np.repeat(packed, many)
        good = self.packed[entry] == packed
        return at[good], self.phrase[entry[good]], at[good] - self.place[entry[good]]


class PhraseIndex:
    """Finds (text, phrase, similarity) for phrases given with the similarity that each must reach.

    Windows of a phrase's full length stand anywhere and allow few changes, so their pieces are long; shorter ones, which
    allow more, only stand at a text's ends, and their short pieces are only looked for there."""

    def __init__(self, phrases: list[tuple[str, float]]) -> None:
        self.phrases = phrases
        letters = sorted({c for p, _ in phrases for c in p})
        self.code = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)  # the last entry stands for all code points above; 0: no phrase has it
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        base = len(letters) + 1
        longest_piece = max(PIECE, int(62 / np.log2(base + 1)))
        self.size = np.array([len(p) for p, _ in phrases], np.int64)
        self.floor = np.array([f for _, f in phrases], np.float64)
        self.longest = int(self.size.max(initial=0))
        self.whole = []  # phrases of too few letters for pieces, or too many for a word of bits
        self.bits = np.zeros((len(phrases), base), np.uint64)
        #: by whether windows are clipped: how many letters may be lost or put in, and how far a window may begin from where its piece
        #: has it (a window of full length takes as many in as it loses, so half as far)
        self.edits, self.slack = np.zeros((2, len(phrases)), np.int64), np.zeros((2, len(phrases)), np.int64)
        pieces: list[dict[int, list]] = [{}, {}]
        for k, (p, floor) in enumerate(phrases):
            lost = len(p) - int(-(-floor * len(p) // 100))
            self.edits[:, k], self.slack[:, k] = (2 * lost, allowed(len(p), floor)), (lost, allowed(len(p), floor))
            if (self.edits[:, k].max() + 1) * PIECE > len(p) or len(p) > 64:
                self.whole.append(k)
                continue
            codes = self.code[[ord(c) for c in p]]
            for j, c in enumerate(codes.tolist()):
                self.bits[k, c] |= np.uint64(1 << j)
            for clipped in (0, 1):
                wanted = int(self.edits[clipped, k]) + 1
                step = len(p) // wanted
                size = PIECE if clipped else min(step, longest_piece)
                pieces[clipped].setdefault(size, []).extend((codes[at : at + size], k, at) for at in range(0, step * wanted, step))
        tables = [Counter(self.code[[ord(c) for c in p]].tolist()) for p, _ in phrases]
        self.kinds = np.array([len(t) for t in tables], np.int64)
        self.letters, self.needed = (np.zeros((len(phrases), int(self.kinds.max(initial=0))), np.int64) for _ in range(2))
        for k, t in enumerate(tables):
            self.letters[k, : len(t)], self.needed[k, : len(t)] = list(t), list(t.values())
        # no window is longer than this, of phrases in pieces
        self.field_bits = 8 if min(self.longest, 64) + 2 * int(self.slack.max(initial=0)) < 256 else 16
        self.together = 64 // self.field_bits
        self.fields = np.zeros((-(-base // self.together), base), np.uint64)
        self.fields[np.arange(base) // self.together, np.arange(base)] = np.uint64(1) << (np.arange(base) % self.together * self.field_bits).astype(np.uint64)
        self.tables = [[_Pieces(size, base, found) for size, found in some.items()] for some in pieces]

    def find(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """For each text the (phrase's number, similarity) that reach the phrase's floor, by phrase."""
        best: list[dict[int, float]] = [{} for _ in texts]
        row = 0
        while row < len(texts):
            end, held = row, 0
            while end < len(texts) and (end == row or held + len(texts[end] or "") < BLOCK):
                held += len(texts[end] or "")
                end += 1
            self._block([t or "" for t in texts[row:end]], best[row:end])
            row = end
        return [sorted(b.items()) for b in best]

    def _block(self, texts: list[str], best: list[dict[int, float]]) -> None:
        for text, found in zip(texts, best, strict=True):
            for k in range(len(self.phrases)) if text and len(text) < self.longest else self.whole:
                if text and (k in self.whole or len(text) < self.size[k]):
                    phrase, floor = self.phrases[k]
                    if value := partial_ratio(phrase, text, floor):
                        found[k] = value
        joined = np.frombuffer("\0".join(texts).encode("utf-32-le"), np.uint32)
        codes = self.code[np.minimum(joined, len(self.code) - 1)]
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        # how often each letter stood before each place, in fields of one number for several letters: of two places' numbers, the
        # difference has in its fields what stands between them, which is less than a field holds, whatever has run over
        tallies = np.zeros((len(self.fields), len(codes) + 1), np.uint64)
        for row, field in zip(tallies, self.fields, strict=True):
            np.cumsum(field[codes], out=row[1:])
        totals = np.bincount(codes, minlength=self.bits.shape[1])
        rare = np.argsort(np.where(self.needed > 0, totals[self.letters], len(codes) + 1), axis=1, kind="stable")  # a phrase's rarest letters first
        letters, needed = np.take_along_axis(self.letters, rare, 1), np.take_along_axis(self.needed, rare, 1)
        # letters that a clipped window can reach
        reach, ends = 2 * self.longest, np.zeros(len(codes) + 1, np.int64)
        for begin, end in ((first[:-1], np.minimum(first[:-1] + reach, first[1:] - 1)), (np.maximum(first[1:] - 1 - reach, first[:-1]), first[1:] - 1)):
            np.add.at(ends, begin, 1)
            np.add.at(ends, end, -1)
        ends = np.cumsum(ends[:-1]) > 0
        begun = heads(codes, self.bits.shape[1])
        for clipped in (0, 1):
            met = [t.find(codes, begun, ends if clipped else None) for t in self.tables[clipped]]
            if not met:
                continue
            at, phrase, anchor = (np.concatenate([m[j] for m in met]) for j in range(3))
            row = np.searchsorted(first, at, side="right") - 1
            lo, hi, n, slack = first[row], first[row + 1] - 1, self.size[phrase], self.slack[clipped][phrase]
            fits = hi - lo >= n  # shorter texts are compared above
            if clipped:
                fits &= (anchor - slack < lo) | (anchor + n + slack > hi)
            keys, kept = np.unique(phrase[fits] * (len(codes) + 2 * self.longest) + anchor[fits] + self.longest, return_index=True)
            phrase, anchor, row = phrase[fits][kept], anchor[fits][kept], row[fits][kept]
            for some in np.array_split(np.argsort(self.size[phrase], kind="stable"), max(1, -(-len(keys) // TOGETHER))):
                self._measure(clipped, texts, best, codes, tallies, letters, needed, first, phrase[some], anchor[some], row[some])

    def _measure(self, clipped: int, texts: list[str], best: list[dict[int, float]], codes: np.ndarray, tallies: np.ndarray, letters: np.ndarray, needed: np.ndarray, first: np.ndarray, phrase: np.ndarray, anchor: np.ndarray, row: np.ndarray) -> None:
        lo, hi, n, slack, floors = first[row], first[row + 1] - 1, self.size[phrase], self.slack[clipped][phrase], self.floor[phrase]
        begin, end = np.maximum(anchor - slack, lo), np.minimum(anchor + n + slack, hi)
        smallest = np.ceil(floors * n / (200 - floors)) if clipped else n  # a clipped window of fewer letters can't reach the floor
        least = np.ceil(floors * (n + smallest) / 200).astype(np.int64)
        # no subsequence is longer than the letters that both have: those that lack too many are out, after a few letters mostly
        open_, lacking = np.arange(len(phrase)), np.zeros(len(phrase), np.int64)
        which, b, e, spare = phrase, begin, end, n - least
        for j in range(letters.shape[1]):
            letter = letters[which, j]
            held = tallies[letter // self.together, e] - tallies[letter // self.together, b] >> (letter % self.together * self.field_bits).astype(np.uint64)
            lacking += np.maximum(needed[which, j] - (held & np.uint64((1 << self.field_bits) - 1)).astype(np.int64), 0)
            if j < 8 or j + 1 == letters.shape[1]:
                alive = np.flatnonzero(lacking <= spare)
                open_, lacking, which, b, e, spare = open_[alive], lacking[alive], which[alive], b[alive], e[alive], spare[alive]
        n_, least_, end_, which, place = n[open_], least[open_], end[open_], phrase[open_], begin[open_]
        mask = np.where(n_ == 64, ~np.uint64(0), (np.uint64(1) << (n_ % 64).astype(np.uint64)) - np.uint64(1))
        state = np.full(len(open_), ~np.uint64(0))
        for _ in range(int((end_ - place).max(initial=0))):
            hit = state & self.bits[which, np.where(place < end_, codes[np.minimum(place, len(codes) - 1)], 0)]
            state = (state + hit) | (state - hit)
            place += 1
        for c in open_[n_ - np.bitwise_count(state & mask).astype(np.int64) >= least_]:
            k, r, size = int(phrase[c]), int(row[c]), int(n[c])
            word, floor = self.phrases[k]
            text, most = texts[r], len(texts[r])
            near = int(anchor[c] - lo[c])
            for start in range(near - int(slack[c]), near + int(slack[c]) + 1):
                window = text[max(start, 0) : min(start + size, most)] if start < most else ""
                if window and 200 * min(size, len(window)) >= max(floor, best[r].get(k, 0.0)) * (size + len(window)):
                    value = 200 * lcs_length(word, window) / (size + len(window))
                    if value >= floor and value > best[r].get(k, 0.0):
                        best[r][k] = value
