"""Auction algorithm for shortest paths in a lattice of repair states (Bertsekas).

A lattice has layers 0..m with one node per state in each.  Steps lead from a layer to the next, insert
arcs stay in their layer, and sink arcs leave the last layer.  Every node has a price, never more than an
arc's cost above the arc's end.  A path grows from its origin along the arc of least cost plus price
(extension); where the price of its end is below that, the price rises to it and the path loses its end
(contraction).  When the path reaches the sink, the origin's price is its distance, and as distances are
met with equality, every arc of every shortest path is tight: its cost is the fall of price along it.
The path with the least letters follows, from the origin, the least letter whose arc is tight and leads
on to the sink through tight arcs.
"""

from __future__ import annotations

from functools import lru_cache

#: States: nothing yet; a system turn; the last turn is the user's; the last turn is the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FOLLOWING = (USER, USER, ASSISTANT, USER)  # state after a turn that is inserted or given another role
INITIALS = "sua"  # of roles; then any other initial, then none
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
DELETE, REROLE, INSERT, UNFINISHED = 2, 1, 5, 5
ACCEPT = (0, None, None, 0)  # cost of ending in each state
FAR = 1 << 60

Arc = tuple[str, int, int]  # letter, state, cost


def symbol(initial: int, fault: int) -> str:
    """A row as one character: place of the initial in ``INITIALS`` (3 other, 4 none), fault 0 none, 1 truncated, 2 to delete."""
    return chr(65 + 3 * initial + fault)


def row_arcs(code: str) -> list[list[Arc]]:
    """Arcs over one row from each state, by letter."""
    initial, fault = divmod(ord(code) - 65, 3)
    more, out = UNFINISHED if fault == 1 else 0, []
    for state in STATES:
        arcs = [("D", state, DELETE)]
        if fault < 2:
            to = state if initial == 4 else KEPT[state].get(INITIALS[initial]) if initial < 3 else None
            if to is not None:
                arcs.append(("K", to, more))
            arcs.append(("R", FOLLOWING[state], REROLE + more))
        out.append(arcs)
    return out


def matrix_arcs(costs: list[int]) -> list[list[Arc]]:
    """Arcs over a solved stretch of rows: cost by entry and exit state."""
    return [[("", to, costs[4 * state + to]) for to in STATES if costs[4 * state + to] < FAR] for state in STATES]


class Lattice:
    """``steps``: arcs per state of each layer but the last; ``inserts``: a turn may be inserted before each step
    (rows) or not (stretches, which hold their own inserts); ``final``: also in the last layer; ``sink``: cost of
    leaving from each state, None where the lattice can't be left."""

    def __init__(self, steps: list[list[list[Arc]]], sink: tuple[int | None, ...], inserts: bool, final: bool):
        self.steps, self.sink, self.inserts, self.final = steps, sink, inserts, final
        self.last, self.end = len(steps), 4 * (len(steps) + 1)
        alive = [self._alive(i) for i in (self.last,)]
        for i in range(self.last - 1, -1, -1):
            alive.append(self._alive(i, alive[-1]))
        self.alive = alive[::-1]
        price, self.price = 0, [0] * (self.end + 1)
        for i in range(self.last - 1, -1, -1):  # no row costs less than its cheapest arc
            price += min((c for arcs in steps[i] for _, _, c in arcs), default=0)
            self.price[4 * i : 4 * i + 4] = [price] * 4

    def _insert(self, layer: int) -> bool:
        return self.final if layer == self.last else self.inserts

    def _alive(self, layer: int, after: set[int] | None = None) -> set[int]:
        """States of a layer from which the sink can be reached."""
        if after is None:
            found = {s for s in STATES if self.sink[s] is not None}
        else:
            found = {s for s in STATES if any(to in after for _, to, _ in self.steps[layer][s])}
        if self._insert(layer):
            for _ in range(2):
                found |= {s for s in STATES if FOLLOWING[s] in found}
        return found

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """Letter, end and cost of the arcs from a node to nodes that can reach the sink."""
        layer, state = divmod(node, 4)
        out = []
        if layer < self.last:
            out = [(letter, 4 * layer + 4 + to, cost) for letter, to, cost in self.steps[layer][state] if to in self.alive[layer + 1]]
        elif self.sink[state] is not None:
            out = [("", self.end, self.sink[state])]
        if self._insert(layer) and FOLLOWING[state] in self.alive[layer]:
            out.append(("I", 4 * layer + FOLLOWING[state], INSERT))
        return out

    def distance(self, origin: int) -> int:
        """Cost from a node to the sink; prices stay for the next origin."""
        if origin % 4 not in self.alive[origin // 4]:
            return FAR
        price, path = self.price, [origin]
        while path[-1] != self.end:
            node = path[-1]
            least, to = min((price[to] + cost, to) for _, to, cost in self.arcs(node))
            if price[node] < least:
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[origin]

    def borders(self) -> list[tuple[int, ...]]:
        """Distance from every state of layers 1 to the last, from the last layer on."""
        return [tuple(self.distance(4 * i + s) for s in STATES) for i in range(self.last, 0, -1)][::-1]

    def trace(self, origin: int) -> tuple[str, int]:
        """Least letters of a shortest path from a state of the first layer, and the state where it leaves."""
        self.distance(origin)
        price = self.price
        tight: dict[int, list[tuple[str, int]]] = {}
        leads = {self.end}
        for layer in range(self.last, -1, -1):
            nodes = [4 * layer + s for s in STATES if s in self.alive[layer]]
            for node in nodes:
                tight[node] = [(letter, to) for letter, to, cost in self.arcs(node) if price[node] == price[to] + cost]
            for _ in range(3):  # inserts lead on within the layer
                leads.update(node for node in nodes if any(to in leads for _, to in tight[node]))
        letters, node = [], origin
        while True:
            letter, to = min((letter, to) for letter, to in tight[node] if to in leads)
            if to == self.end:
                return "".join(letters), node % 4
            letters.append(letter)
            node = to


def stretch(steps: list[list[list[Arc]]], inserts: bool) -> list[int]:
    """Cost of every entry and exit state, 16 values; ``FAR`` where there is no way."""
    costs = [FAR] * 16
    for to in STATES:
        lattice = Lattice(steps, tuple(0 if s == to else None for s in STATES), inserts, False)
        for state in STATES:
            costs[4 * state + to] = lattice.distance(state)
    return costs


@lru_cache(1 << 15)
def rows_stretch(codes: str) -> list[int]:
    return stretch([row_arcs(c) for c in codes], True)


@lru_cache(1 << 15)
def rows_trace(codes: str, sink: tuple[int | None, ...], final: bool, entries: tuple[int, ...]) -> list[tuple[str, int] | None]:
    """Letters and exit state for each entry state that is asked for and leads to the sink."""
    lattice = Lattice([row_arcs(c) for c in codes], sink, True, final)
    return [lattice.trace(s) if s in entries and s in lattice.alive[0] else None for s in STATES]


def walk(codes: str, letters: str, state: int) -> tuple[list[tuple[int, str, int]], int]:
    """The edits that letters stand for: (row before which or at which, letter, state after), and their cost."""
    row, cost, edits = 0, 0, []
    for letter in letters:
        if letter == "I":
            state, cost = FOLLOWING[state], cost + INSERT
            edits.append((row, letter, state))
            continue
        to, more = next((to, c) for name, to, c in row_arcs(codes[row])[state] if name == letter)
        state, cost = to, cost + more
        edits.append((row, letter, state))
        row += 1
    return edits, cost
