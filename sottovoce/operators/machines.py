"""State machines over a key's rows in order, the same for live streams (streaming.event_time) and for finished tables (operators.rounds)."""

from __future__ import annotations

from sottovoce.operators.environment import Environment
from sottovoce.operators.state import filled, segment

SEVERITIES = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


class Machine:
    """Rows of a key in order, in; rows, out. kept: the type of what it keeps; takes: of a row's values; gives: of its output."""

    kept: str
    takes: str
    gives: str

    def begin(self, row: tuple) -> tuple:
        """What is kept before the first row, (us, order, *values)."""
        raise NotImplementedError

    def guess(self, row: tuple, before: int) -> tuple:
        """What may be kept before a row that is not the first, behind so many others (see operators.rounds)."""
        return self.begin(row)

    def feed(self, kept: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def end(self, kept: tuple) -> list[tuple]:
        return []


class Segments(Machine):
    """R3-R5; order is the chunk's number, the value whether it is speech."""

    kept = "number long, at long, start long, spoken long, silent long, free long"
    takes = "speech boolean"
    gives = "segment_id long, first long, stop long, speech long"

    def begin(self, row: tuple) -> tuple:
        return 0, row[1], -1, 0, 0, row[1]

    def _number(self, number: int, found: list[tuple]) -> list[tuple]:
        return [(number + k, *s) for k, s in enumerate(found)]

    def feed(self, kept: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        number, *state = kept
        found, state = segment(filled([r[1] for r in rows], [r[2] for r in rows], state[0]), closing=False, state=tuple(state))
        return (number + len(found), *state), self._number(number, found)

    def end(self, kept: tuple) -> list[tuple]:
        number, *state = kept
        return self._number(number, segment([], closing=True, state=tuple(state))[0])


class Confirm(Machine):
    """R6; order is the window's number, the value its phrases. A window that is missing breaks a streak."""

    kept = "window long, streak map<string,int>, told array<string>"
    takes = "phrases array<string>"
    gives = "phrase string, confirmed_at long, windows int"

    def __init__(self, needed: int = 2) -> None:
        self.needed = needed

    def begin(self, row: tuple) -> tuple:
        return row[1] - 1, {}, []

    def feed(self, kept: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        window, streak, told, out = kept[0], dict(kept[1]), list(kept[2]), []
        for _, at, phrases in rows:
            if at <= window:
                continue
            before = streak if at == window + 1 else {}
            window, streak = at, {p: before.get(p, 0) + 1 for p in sorted(set(phrases or ()))}
            for p, n in streak.items():
                if n >= self.needed and p not in told:
                    told.append(p)
                    out.append((p, at, self.needed))
        return (window, streak, told), out


class Escalation(Machine):
    """R10; values are the severity and the categories. Earlier disclosures older than `seconds` are forgotten."""

    kept = "past array<struct<us:long,category:string>>"
    takes = "severity string, categories array<string>"
    gives = "order long, severity string, repeats long, escalated string"

    def __init__(self, seconds: int = 600, needed: int = 2) -> None:
        self.seconds, self.needed = seconds, needed

    def begin(self, row: tuple) -> tuple:
        return ([],)

    def feed(self, kept: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        past, out = [tuple(p) for p in kept[0]], []
        for us, order, severity, categories in rows:
            repeats, after = 0, severity
            rank = SEVERITIES.index(severity) if severity in SEVERITIES else 0
            if rank >= 2 and categories:
                past = [p for p in past if us - p[0] <= self.seconds * 1_000_000]
                repeats = max(sum(c == p[1] for p in past) for c in categories)
                past += [(us, c) for c in categories]
                after = SEVERITIES[min(rank + (repeats >= self.needed), 4)]
            out.append((order, severity, repeats, after))
        return (past,), out


class Levels(Machine):
    """E4-E9; order is the chunk's number, values are its level and whether it is speech and lies in a segment."""

    kept = ("n long, floor double, quiet double, told boolean, left int, spike struct<t:double,level_db:double,baseline_db:double,delta_db:double>, voice array<double>, "
            "speaking double, spoken long, history array<struct<t:double,floor:double>>, sampled double, last map<string,double>")  # fmt: skip
    takes = "level_db double, speech boolean, in_segment boolean"
    gives = "chunk_idx long, kind string, level_db double, baseline_db double, delta_db double"

    def begin(self, row: tuple) -> tuple:
        return self._kept(Environment())

    def guess(self, row: tuple, before: int) -> tuple:
        e = Environment()
        e.n = before
        return self._kept(e)

    @staticmethod
    def _kept(e: Environment) -> tuple:
        left, spike = e.spike or (None, None)
        return e.n, e.floor, e.quiet, e.told_quiet, left, spike and tuple(spike[k] for k in ("t", "level_db", "baseline_db", "delta_db")), list(e.voice), e.speaking, e.spoken, list(e.history), e.sampled, dict(e.last)

    @staticmethod
    def _environment(kept: tuple) -> Environment:
        e = Environment()
        e.n, e.floor, e.quiet, e.told_quiet, left, spike, e.voice, e.speaking, e.spoken, history, e.sampled, last = kept
        e.spike = (left, dict(zip(("t", "level_db", "baseline_db", "delta_db"), spike, strict=True))) if spike else None
        e.voice, e.history, e.last = list(e.voice), [tuple(h) for h in history], dict(last)
        return e

    def feed(self, kept: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        e, out = self._environment(kept), []
        for *_, chunk, level, speech, in_segment in rows:
            out += [(chunk, x["kind"], x["level_db"], x["baseline_db"], x["delta_db"]) for x in e.feed(level, bool(speech), bool(in_segment))]
        return self._kept(e), out


class Baselines(Levels):
    """Of every chunk the noise floor and the speaking level after it."""

    gives = "chunk_idx long, floor_db double, speaking_db double"

    def feed(self, kept: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        e, out = self._environment(kept), []
        for *_, chunk, level, speech, in_segment in rows:
            e.feed(level, bool(speech), bool(in_segment))
            out.append((chunk, e.floor, e.speaking))
        return self._kept(e), out
