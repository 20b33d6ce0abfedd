"""A generalised LL recogniser with a graph-structured stack.

Grammars map a name to its alternatives; a symbol that is no name is a terminal. All
alternatives are followed side by side; calls of one name at one position share a stack
node, so ambiguity and recursion of any form cost polynomial time and no Python recursion.
"""

from __future__ import annotations

from collections.abc import Callable


class Grammar:
    def __init__(self, rules: dict[str, list[str]], start: str) -> None:
        self.rules = {name: [tuple(a.split()) for a in alternatives] for name, alternatives in rules.items()}
        self.start = start

    def ends(self, token: Callable[[int], str]) -> set[int]:
        """Positions at which a phrase of the start symbol from position 0 can end.

        ``token(i)`` gives the terminal at a position and '' past the last; it is asked only for
        positions that the grammar can reach.
        """
        rules, root = self.rules, (self.start, 0)
        found: dict[tuple[str, int], set[int]] = {root: set()}
        callers: dict[tuple[str, int], list[tuple]] = {root: []}
        todo = [(alternative, 0, root, 0) for alternative in rules[self.start]]
        seen = set(todo)
        while todo:
            symbols, dot, node, at = todo.pop()
            if dot == len(symbols):
                if at in found[node]:
                    continue
                found[node].add(at)
                new = [(s, d, n, at) for s, d, n in callers[node]]
            elif symbols[dot] not in rules:
                new = [(symbols, dot + 1, node, at + 1)] if token(at) == symbols[dot] else []
            else:
                called = (symbols[dot], at)
                back = (symbols, dot + 1, node)
                if called not in found:
                    found[called], callers[called] = set(), [back]
                    new = [(alternative, 0, called, at) for alternative in rules[symbols[dot]]]
                else:
                    callers[called].append(back)
                    new = [(*back, end) for end in found[called]]
            for d in new:
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        return found[root]
