"""The sound environment of a session (E4-E9): noise floor, speaking level, and the events they tell."""

from __future__ import annotations

import math

#: Chunks between two roundings of the averages, about two minutes.
SETTLED = 4096
#: Seconds between two events of a kind; chunks of speech before voices can be raised; a time long past.
COOLDOWN, WARM, NEVER = 5.0, 60, -1e9


class Environment:
    """E4-E9 of one session, chunk by chunk; picklable, so a stream can keep it as state.

    At every SETTLED-th chunk the averages are rounded to a millionth of a decibel, cooldowns that are over are forgotten,
    and the floor is sampled anew. What was before is forgotten to more places by then, so a block of so many chunks leaves
    the same whatever it was thought to begin with, unless there is nothing in it to move an average."""

    CHUNK = 0.032

    def __init__(self) -> None:
        self.n = 0
        self.floor: float | None = None
        self.quiet, self.told_quiet = 0.0, False
        self.spike: tuple[int, dict] | None = None
        self.voice: list[float] = []
        self.speaking, self.spoken = None, 0
        self.history: list[tuple[float, float]] = []
        self.sampled = NEVER
        self.last: dict[str, float] = {}

    @property
    def t(self) -> float:
        return self.n * self.CHUNK

    def _tell(self, out: list, kind: str, shown: dict) -> None:
        if self.t - self.last.get(kind, NEVER) >= COOLDOWN:
            self.last[kind] = self.t
            out.append({"kind": kind, **shown})

    def feed(self, level: float, speech: bool, in_segment: bool = False) -> list[dict]:
        """Events of one chunk: kind, t, level_db, baseline_db, delta_db."""
        out = self._feed(level, speech, in_segment)
        if self.n % SETTLED == 0:
            settle = lambda x: None if x is None else round(x, 6)
            self.floor, self.speaking = settle(self.floor), settle(self.speaking)
            self.history, self.sampled = [(t, settle(x)) for t, x in self.history], NEVER
            self.last = {k: t for k, t in self.last.items() if self.t - t < COOLDOWN}
        return out

    def _feed(self, level: float, speech: bool, in_segment: bool) -> list[dict]:
        out: list[dict] = []
        self.n += 1
        base = level if self.floor is None else self.floor
        shown = {"t": round(self.t, 3), "level_db": round(level, 1), "baseline_db": round(base, 1), "delta_db": round(level - base, 1)}
        if level <= -80:
            self.quiet += self.CHUNK
            if self.quiet >= 8 and not self.told_quiet:
                self.told_quiet = True
                out.append({"kind": "input_silent", **shown})
            return out
        self.quiet, self.told_quiet = 0.0, False
        if self.floor is None:
            self.floor = level
            return out
        if self.spike:
            left, was = self.spike
            if speech or in_segment:
                self.spike = None
            elif left <= 1:
                self.spike = None
                self._tell(out, "sudden_sound", was)
            else:
                self.spike = (left - 1, was)
        loud = not speech and level - self.floor >= 18 and level >= -30
        if loud and not in_segment and self.spike is None and self.t - self.last.get("sudden_sound", NEVER) >= COOLDOWN:
            self.spike = (8, shown)
        if not speech and not in_segment and not loud:
            self.floor += 0.01 * (level - self.floor)
        if speech:
            self.voice = [*self.voice, 10 ** (level / 10)][-10:]
            mean = 10 * math.log10(sum(self.voice) / len(self.voice))
            self.spoken = min(self.spoken + 1, WARM + 1)
            if self.spoken > WARM and self.speaking is not None and mean >= self.speaking + 12 and level >= self.floor + 18:
                self._tell(out, "raised_voice", shown)
            self.speaking = level if self.speaking is None else self.speaking + 0.02 * (level - self.speaking)
        if self.t - self.sampled >= 0.5:
            self.sampled = self.t
            self.history = [*self.history, (self.t, self.floor)][-120:]
            if len(self.history) == 120 and not out and abs(self.floor - self.history[0][1]) >= 10:
                self._tell(out, "ambient_shift", shown)
                self.history = []
        return out
