"""Weighted finite-state transducers over the words of a clause, their composition, and best paths.

A transducer is a table of arcs (state, symbol read, symbol written, weight, next state), with a start state and final states. A weight is a pair (a, b): the
arc adds a times the word's own weight and b. ``compose`` joins two of them so that the second reads what the first writes. The best path of a clause is the one of
largest sum among those that end in a final state.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np

#: Classes of words.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = WORDS = ("insult", "threat", "target", "negation", "report", "other")
#: Written for a marked word: an insult, an aimed insult, a threat; then a denied and a quoted one.
MARK, AIMED, THREATENED, DENIED, QUOTED = MARKED = ("mark", "aimed", "threatened", "denied", "quoted")
MATCHING = frozenset((INSULT, THREAT))

#: Additions to a marked word's weight.
THREAT_WEIGHT, AIM, DENIAL, QUOTE = 2.0, 0.5, -2.0, -2.0
#: How many words a negation reaches.
DENIAL_REACH = 3


@dataclass(frozen=True)
class Transducer:
    arcs: tuple[tuple[int, str, str, tuple[float, float], int], ...]
    finals: frozenset[int]
    start: int = 0

    def leaving(self) -> dict[tuple[int, str], list]:
        out = defaultdict(list)
        for s, read, write, weight, to in self.arcs:
            out[s, read].append((write, weight, to))
        return out


def _transducer(rules, states: int, finals) -> Transducer:
    """rules: (states, symbols read, symbol written or None for the same, weight, next state or None for the same)."""
    arcs = [(s, read, write or read, weight, s if to is None else to) for own, symbols, write, weight, to in rules for s in own for read in symbols]
    assert all(0 <= x < states for s, _, _, _, to in arcs for x in (s, to))
    return Transducer(tuple(arcs), frozenset(finals))


_FREE = (0.0, 0.0)


def insult() -> Transducer:
    """Marks insults, or leaves them as other words."""
    return _transducer([([0], [INSULT], MARK, (1.0, 0.0), None), ([0], [INSULT], OTHER, _FREE, None), ([0], [THREAT, TARGET, NEGATION, REPORT, OTHER], None, _FREE, None)], 1, [0])


#: States of what needs a target somewhere in the clause: none seen and none needed, seen, needed.
_NONE, _SEEN, _NEEDED = range(3)


def threat() -> Transducer:
    """Marks threats in clauses with a target, or leaves them as other words."""
    marked = (0.0, THREAT_WEIGHT)
    return _transducer(
        [
            ([_NONE, _NEEDED], [THREAT], THREATENED, marked, _NEEDED), ([_SEEN], [THREAT], THREATENED, marked, None), ([_NONE, _SEEN, _NEEDED], [THREAT], OTHER, _FREE, None),
            ([_NONE, _SEEN, _NEEDED], [TARGET], None, _FREE, _SEEN), ([_NONE, _SEEN, _NEEDED], [MARK, NEGATION, REPORT, OTHER], None, _FREE, None),
        ], 3, [_NONE, _SEEN],
    )


def target() -> Transducer:
    """Marked insults become aimed ones in clauses with a target, or stay."""
    aimed = (0.0, AIM)
    return _transducer(
        [
            ([_NONE, _NEEDED], [MARK], AIMED, aimed, _NEEDED), ([_SEEN], [MARK], AIMED, aimed, None), ([_NONE, _SEEN, _NEEDED], [MARK], None, _FREE, None),
            ([_NONE, _SEEN, _NEEDED], [TARGET], None, _FREE, _SEEN), ([_NONE, _SEEN, _NEEDED], [THREATENED, NEGATION, REPORT, OTHER], None, _FREE, None),
        ], 3, [_NONE, _SEEN],
    )


def negation() -> Transducer:
    """State: how many more words are denied."""
    rules = [(range(DENIAL_REACH + 1), [NEGATION], None, _FREE, DENIAL_REACH), ([0], [MARK, AIMED, THREATENED, TARGET, REPORT, OTHER], None, _FREE, 0)]
    for left in range(1, DENIAL_REACH + 1):
        rules += [([left], [MARK, AIMED, THREATENED], DENIED, (0.0, DENIAL), left - 1), ([left], [TARGET, REPORT, OTHER], None, _FREE, left - 1)]
    return _transducer(rules, DENIAL_REACH + 1, range(DENIAL_REACH + 1))


def reported_speech() -> Transducer:
    """After a word of reporting the rest of the clause is quoted."""
    marks = [MARK, AIMED, THREATENED, DENIED]
    return _transducer([([0, 1], [REPORT], None, _FREE, 1), ([0], marks, None, _FREE, None), ([1], marks, QUOTED, (0.0, QUOTE), None), ([0, 1], [TARGET, NEGATION, OTHER], None, _FREE, None)], 2, [0, 1])


def compose(one: Transducer, two: Transducer) -> Transducer:
    """Reads what one reads, writes what two writes; states are the pairs that can be reached and can reach an end."""
    first, second = defaultdict(list), two.leaving()
    for s, *arc in one.arcs:
        first[s].append(arc)
    number, arcs, front = {(one.start, two.start): 0}, [], [(one.start, two.start)]
    while front:
        p, q = now = front.pop()
        for read, middle, (a, b), p2 in first[p]:
            for write, (c, d), q2 in second[q, middle]:
                if (p2, q2) not in number:
                    number[p2, q2] = len(number)
                    front.append((p2, q2))
                arcs.append((number[now], read, write, (a + c, b + d), number[p2, q2]))
    finals = {k for (p, q), k in number.items() if p in one.finals and q in two.finals}
    alive = set(finals)
    while more := {s for s, *_, to in arcs if to in alive} - alive:
        alive |= more
    return Transducer(tuple(x for x in arcs if x[0] in alive and x[-1] in alive), frozenset(finals))


class Machine:
    """Best paths of one transducer, all states at once."""

    def __init__(self, transducer: Transducer):
        self.states = 1 + max([to for *_, to in transducer.arcs] + [s for s, *_ in transducer.arcs] + [transducer.start])
        self.start, self.finals = transducer.start, np.array(sorted(transducer.finals))
        self.table = {}
        for symbol in WORDS:
            arcs = sorted((a for a in transducer.arcs if a[1] == symbol), key=lambda x: x[-1])
            source, to = np.array([x[0] for x in arcs]), np.array([x[-1] for x in arcs])
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            own, add = (np.array([x[3][k] for x in arcs]) for k in (0, 1))
            self.table[symbol] = source, own, add, first, to[first], [x[2] for x in arcs]

    def best(self, symbols: list[tuple[str, float]]) -> tuple[float, list[str]]:
        """Weight of the best path over (class, own weight) of each word, and what it writes; of equal paths the first arcs' one."""
        value, steps = np.full(self.states, -np.inf), []
        value[self.start] = 0.0
        for symbol, weight in symbols:
            source, own, add, first, to, _ = self.table[symbol]
            through = value[source] + own * weight + add
            value = np.full(self.states, -np.inf)
            value[to] = np.maximum.reduceat(through, first)
            steps.append(through)
        state = int(self.finals[np.argmax(value[self.finals])])
        total, written = float(value[state]), []
        for (symbol, _), through in zip(reversed(symbols), reversed(steps)):
            source, _, _, first, to, writes = self.table[symbol]
            k = int(np.searchsorted(to, state))
            begin, end = first[k], first[k + 1] if k + 1 < len(first) else len(source)
            arc = begin + int(np.argmax(through[begin:end]))
            written.append(writes[arc])
            state = int(source[arc])
        return total, written[::-1]


def parts() -> list[Transducer]:
    return [insult(), threat(), target(), negation(), reported_speech()]


_HELD: list[Machine] = []


def composed() -> Machine:
    """The five in a row as one machine, built once in each process."""
    if not _HELD:
        _HELD.append(Machine(reduce(compose, parts())))
    return _HELD[0]
