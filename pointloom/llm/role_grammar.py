"""A generalised LR recogniser of role sequences that repairs them at least cost."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

#: What an edit costs; a truncated row that isn't deleted costs TRUNCATED more.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3

#: Cost, edits' initials, and the initial of the role that each edit leaves ("-" where it leaves none).
Path = tuple[int, str, str]


@dataclass
class Grammar:
    """SLR tables of a context-free grammar over roles' initials, and the stacks that they make.

    A stack is a number that stands for an LR state and the stack below it. Equal stacks have one number, so stacks
    share their tails (the graph-structured stack) and equal tops meet. Where the tables leave a choice, all are taken."""

    productions: Sequence[tuple[str, tuple[str, ...]]]
    terminals: Sequence[str]
    nodes: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.start = self.productions[0][0]
        self.rules = [("^", (self.start,)), *self.productions]
        self.names = {left for left, _ in self.productions}
        self._states: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self._follow = self._follows()
        self._numbers: dict[tuple[int, int], int] = {}
        self._after: dict[tuple[int, str], tuple[int, ...]] = {}
        self.empty = self._node(self._state({(0, 0)}), -1)

    def _follows(self) -> dict[str, set[str]]:
        first: dict[str, set[str]] = {t: {t} for t in self.terminals} | {n: set() for n in self.names | {"^"}}
        follow: dict[str, set[str]] = {n: set() for n in self.names} | {"^": {"$"}}
        before = None
        while before != (before := (sum(map(len, first.values())), sum(map(len, follow.values())))):
            for left, right in self.rules:
                rest = set(follow[left])
                for symbol in reversed(right):
                    if symbol in self.names:
                        follow[symbol] |= rest - {""}
                    rest = first[symbol] - {""} | (rest if "" in first[symbol] else set())
                head: set[str] = {""}
                for symbol in right:
                    head = head - {""} | first[symbol]
                    if "" not in first[symbol]:
                        break
                first[left] |= head
        return follow

    def _state(self, kernel: Iterable[tuple[int, int]]) -> int:
        items, open_ = set(kernel), list(kernel)
        while open_:
            rule, dot = open_.pop()
            right = self.rules[rule][1]
            for i, (left, _) in enumerate(self.rules):
                if dot < len(right) and left == right[dot] and (i, 0) not in items:
                    items.add((i, 0))
                    open_.append((i, 0))
        key = frozenset(items)
        if key not in self._states:
            self._states[key] = len(self.items)
            self.items.append(key)
        return self._states[key]

    def _node(self, state: int, below: int) -> int:
        if (state, below) not in self._numbers:
            self._numbers[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self._numbers[state, below]

    def _goto(self, node: int, symbol: str) -> int | None:
        kernel = {(r, d + 1) for r, d in self.items[self.nodes[node][0]] if self.rules[r][1][d : d + 1] == (symbol,)}
        return self._node(self._state(kernel), node) if kernel else None

    def _reduced(self, node: int, ahead: str) -> set[int]:
        """The stack and all that reductions make of it before the symbol ahead."""
        seen, open_ = {node}, [node]
        while open_:
            top = open_.pop()
            for rule, dot in sorted(self.items[self.nodes[top][0]]):
                left, right = self.rules[rule]
                if rule and dot == len(right) and ahead in self._follow[left]:
                    below = top
                    for _ in right:
                        below = self.nodes[below][1]
                    if (made := self._goto(below, left)) is not None and made not in seen:
                        seen.add(made)
                        open_.append(made)
        return seen

    def after(self, node: int, symbol: str) -> tuple[int, ...]:
        """The stacks once symbol is shifted onto node; "$" gives the node itself if all may end there."""
        if (node, symbol) not in self._after:
            tops = self._reduced(node, symbol)
            if symbol == "$":
                found = {node for t in tops if (0, 1) in self.items[self.nodes[t][0]]}
            else:
                found = {n for t in tops if (n := self._goto(t, symbol)) is not None}
            self._after[node, symbol] = tuple(sorted(found))
        return self._after[node, symbol]

    def stacks(self) -> list[int]:
        """All stacks that some sequence leads to. There must be few, as for a grammar that nests nothing."""
        seen, open_ = {self.empty}, [self.empty]
        while open_:
            node = open_.pop()
            for t in self.terminals:
                for n in self.after(node, t):
                    if n not in seen:
                        seen.add(n)
                        open_.append(n)
            if len(seen) > 64:
                raise ValueError("the grammar has too many stacks to repair a conversation in pieces")
        return sorted(seen)


class Repairer:
    """Least-cost repairs by a grammar, all of whose stacks are numbered first, alike in every task. tops map stacks to the best path that leads there; of paths that meet in one
    stack only the least by cost, then edits, stays, which is all that what follows can tell apart."""

    def __init__(self, grammar: Grammar, insertable: Sequence[str]):
        self.grammar, self.insertable, self.stacks = grammar, tuple(insertable), grammar.stacks()

    def inserted(self, tops: dict[int, Path]) -> dict[int, Path]:
        """tops and all that insertions reach. Costs only grow, so the cheapest open stack is settled."""
        out, open_ = dict(tops), set(tops)
        while open_:
            node = min(open_, key=lambda n: out[n])
            open_.remove(node)
            cost, audit, roles = out[node]
            for t in self.insertable:
                for n in self.grammar.after(node, t):
                    path = (cost + INSERT, audit + "I", roles + t)
                    if n not in out or path < out[n]:
                        out[n] = path
                        open_.add(n)
        return out

    def row(self, tops: dict[int, Path], initial: str, fault: str, copies: int = 1) -> dict[int, Path]:
        """tops after a row: of this role's initial, and blank or a duplicate ("d"), truncated ("t") or sound ("").
        Insertions come before it. Further copies of a row are deleted."""
        if copies < 1:
            return tops
        out: dict[int, Path] = {}

        def put(node: int, path: Path) -> None:
            if node not in out or path < out[node]:
                out[node] = path

        more = TRUNCATED if fault == "t" else 0
        for node, (cost, audit, roles) in self.inserted(tops).items():
            put(node, (cost + DELETE, audit + "D", roles + "-"))
            if fault != "d":
                for n in self.grammar.after(node, initial) if initial in self.grammar.terminals else ():
                    put(n, (cost + more, audit + "K", roles + initial))
                for t in self.insertable:
                    for n in self.grammar.after(node, t):
                        put(n, (cost + REROLE + more, audit + "R", roles + t))
        if copies > 1:
            out = {n: (c + DELETE * (copies - 1), a + "D" * (copies - 1), r + "-" * (copies - 1)) for n, (c, a, r) in out.items()}
        return out

    def rows(self, start: int, rows: Iterable[tuple[str, str, int]]) -> dict[int, Path]:
        tops: dict[int, Path] = {start: (0, "", "")}
        for initial, fault, copies in rows:
            tops = self.row(tops, initial, fault, copies)
        return tops

    def ended(self, tops: dict[int, Path]) -> tuple[int, Path]:
        """The stack of tops from which the least path ends, with that path, insertions at the end included."""
        def closed(node: int) -> Path | None:
            ways = self.inserted({node: tops[node]})
            return min((p for n, p in ways.items() if self.grammar.after(n, "$")), default=None)

        return min(((n, p) for n in tops if (p := closed(n))), key=lambda x: x[1])


#: s?(ua)+ or nothing, by the initials of system, user and assistant.
ROLES = {"s": "system", "u": "user", "a": "assistant"}


def role_repairer() -> Repairer:
    rules = [("chat", ()), ("chat", ("pairs",)), ("chat", ("s", "pairs")), ("pairs", ("pair",)), ("pairs", ("pairs", "pair")), ("pair", ("u", "a"))]
    return Repairer(Grammar(rules, tuple(ROLES)), ("u", "a"))
