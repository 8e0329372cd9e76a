"""Weighted finite-state transducers over short sequences of symbols, and their composition.

A transducer has arcs (state, symbol read) -> (symbol written, weight, next state),
start states and final states. It may guess (several arcs for one symbol); of the paths
that read a whole sequence and end in a final state the heaviest counts, with the
product of its weights.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence

Arc = tuple[Hashable, float, Hashable]


class Transducer:
    """Arcs by (state, symbol read); weights of start and final states are 1."""

    def __init__(self, starts: Iterable[Hashable], finals: Iterable[Hashable], arcs: dict[tuple[Hashable, Hashable], list[Arc]]):
        self.starts, self.finals, self.arcs = list(starts), set(finals), arcs

    def __matmul__(self, after: Transducer) -> Transducer:
        """The transducer that does what this one does and then, to what it writes, what `after` does.

        >>> up = Transducer([0], [0], {(0, "a"): [("A", 0.5, 0)]})
        >>> twice = Transducer([0], [0], {(0, "A"): [("AA", 0.5, 0)]})
        >>> (up @ twice).run("a")
        (['AA'], 0.25)
        """
        starts = [(a, b) for a in self.starts for b in after.starts]
        arcs: dict[tuple[Hashable, Hashable], list[Arc]] = {}
        seen, todo = set(starts), list(starts)
        by_state: dict[Hashable, list[tuple[Hashable, Arc]]] = {}
        for (state, symbol), out in self.arcs.items():
            by_state.setdefault(state, []).extend((symbol, arc) for arc in out)
        while todo:
            a, b = state = todo.pop()
            for symbol, (middle, weight, to) in by_state.get(a, ()):
                for written, more, then in after.arcs.get((b, middle), ()):
                    arcs.setdefault((state, symbol), []).append((written, weight * more, (to, then)))
                    if (to, then) not in seen:
                        seen.add((to, then))
                        todo.append((to, then))
        return Transducer(starts, {(a, b) for a, b in seen if a in self.finals and b in after.finals}, arcs)

    def run(self, symbols: Sequence[Hashable]) -> tuple[list[Hashable], float] | None:
        """What the heaviest path writes and its weight; None where no path reads all symbols."""
        back: list[dict[Hashable, tuple[Hashable, Hashable]]] = []
        now = dict.fromkeys(self.starts, 1.0)
        for symbol in symbols:
            after: dict[Hashable, float] = {}
            came: dict[Hashable, tuple[Hashable, Hashable]] = {}
            for state, weight in now.items():
                for written, more, to in self.arcs.get((state, symbol), ()):
                    if weight * more > after.get(to, 0.0):
                        after[to], came[to] = weight * more, (state, written)
            back.append(came)
            now = after
        ends = [(weight, state) for state, weight in now.items() if state in self.finals]
        if not ends:
            return None
        weight, state = max(ends, key=lambda e: e[0])
        out = []
        for came in reversed(back):
            state, written = came[state]
            out.append(written)
        return out[::-1], weight
