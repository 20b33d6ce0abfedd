"""Functions and what stands round them, by a generalised LL parse over the tokens of a text.

A text is cut into tokens of a few classes; brackets know their partners, so a group of round or
square ones is passed as one token. From the line of a function the declaration is parsed forwards
(modifiers, types, name, parameters, in Python up to a string as first statement) and decorators and
comments backwards. Nothing else of the text needs to be right: functions of broken files come out
as long as their own declaration is one; a parameter list that never closes still makes one.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from codeloom.llm.gll import Grammar

HASH_COMMENTS = ("python", "py", "ruby", "shell", "yaml")
# Classes of tokens: C comment on lines of its own, c comment after code, S string, b blank line, i word, m modifier,
# D word that begins a function, P round group, Q square group; some signs stand for themselves, x is any other.
_SIGNS = {c: c for c in ":=*<>{};@#()[]}"}
# Words that begin a function, and words before one.
_STARTS = "def func fn function fun sub".split()
_MODIFIERS = "async public private protected internal static final abstract export default pub unsafe const extern inline override virtual readonly synchronized native strictfp declare get set register volatile crate".split()
_WORDS = dict.fromkeys(_STARTS, "D") | dict.fromkeys(_MODIFIERS, "m")
_STRING = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"
_LEX = {
    True: re.compile(rf"(?P<n>\n(?:[ \t\r\f]*\n)*)|(?P<w>(?!(?:[rRbBuUfF]{{1,2}})[\"'])[^\W\d]\w*)|(?P<C>\#[^\n]*)|(?P<S>[rRbBuUfF]{{0,2}}(?:\"{{3}}(?:[^\"\\]|\\.|\"(?!\"\"))*+\"{{3}}|'{{3}}(?:[^'\\]|\\.|'(?!''))*+'{{3}}|{_STRING}))|\d\w*|(?P<x>[^\s\w])", re.S),
    False: re.compile(rf"(?P<n>\n(?:[ \t\r\f]*\n)*)|(?P<w>[^\W\d][\w$]*)|(?P<C>//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)|(?P<S>{_STRING}|`(?:[^`\\]|\\.)*+`)|\d\w*|(?P<x>[^\s\w])", re.S),
}

DECLARATION = Grammar(
    {
        "Function": ["Modifiers Core"],
        "Python": ["Modifiers D Name Types Params Rest : Gap S"],
        "Modifiers": ["", "m Modifiers", "P Modifiers", "S Modifiers"],
        "Core": ["D Star Owner Name Types Params", "Name Types Params", "Type Name Types Params", "Name Hint = Modifiers Value"],
        "Star": ["", "*"],
        "Owner": ["", "P"],
        "Name": ["i", "m", "# i", "Q", "S"],
        "Types": ["", "Generic", "Q"],
        "Generic": ["< Inner >"],
        "Inner": ["", "Part Inner"],
        "Part": ["i", "m", "x", "Q", "P", ":", "=", "*", "S", "Generic"],
        "Params": ["P", "("],
        "Type": ["Word", "Type Word"],
        "Word": ["i", "m", "x", "*", "Q", "Generic", "@ i"],
        "Hint": ["", ": Rest"],
        "Value": ["D Star Types Params", "Types P = >", "i = >"],
        "Rest": ["", "Part Rest", "> Rest"],
        "Gap": ["", "C Gap", "c Gap", "b Gap"],
    },
    "Function",
)
_PYTHON = Grammar({}, "Python")
_PYTHON.rules = DECLARATION.rules
#: Read backwards from a function.
ABOVE = Grammar(
    {
        "Above": ["Attributes Comments"],
        "Attributes": ["", "Attribute Attributes"],
        "Attribute": ["Path @", "P Path @", "Q #"],
        "Path": ["i", "m", "i x Path", "m x Path"],
        "Comments": ["C", "C Comments"],
    },
    "Above",
)


class Tokens:
    """The tokens of a text: classes, places, lines (from 1), partners of brackets."""

    def __init__(self, text: str, hashes: bool) -> None:
        self.text, self.hashes = text, hashes
        kinds, starts, ends, lines, partner = [], [], [], [], {}
        line, last, stack = 1, 0, []
        for m in _LEX[hashes].finditer(text):
            group = m.lastgroup
            if group == "n":
                breaks = m[0].count("\n")
                line += breaks
                if breaks > 1:
                    kinds.append("b"), starts.append(m.start()), ends.append(m.end()), lines.append(line - 1)
                continue
            value = m[0]
            if group == "w":
                kind = _WORDS.get(value, "i")
            elif group == "C":
                kind = "c" if last == line else "C"
            elif group == "S":
                kind = "S"
            else:
                kind = _SIGNS.get(value, "x") if group == "x" else "i"
                if value in "([{":
                    stack.append(len(kinds))
                elif value in ")]}" and stack and text[starts[stack[-1]]] == {")": "(", "]": "[", "}": "{"}[value]:
                    a = stack.pop()
                    partner[a], partner[len(kinds)] = len(kinds), a
            kinds.append(kind), starts.append(m.start()), ends.append(m.end()), lines.append(line)
            line += value.count("\n") if group in ("C", "S") else 0
            last = line if kind != "C" else last
        self.kinds, self.starts, self.ends, self.lines, self.partner = kinds, starts, ends, lines, partner

    def first_of(self, line: int) -> int | None:
        """The first token of a line that is no comment."""
        k = bisect_left(self.lines, line)
        while k < len(self.kinds) and self.kinds[k] in "Ccb" and self.lines[k] <= line:
            k += 1
        return k if k < len(self.kinds) and self.lines[k] == line else None

    def view(self, at: int, step: int):
        """Terminals from a token on, forwards or backwards, groups of round and square brackets as one; with the token behind each."""
        seen: list[int] = []

        def token(i: int) -> str:
            while len(seen) <= i:
                k = at if not seen else self._after(seen[-1], step)
                if not 0 <= k < len(self.kinds):
                    return ""
                seen.append(k)
            k = seen[i]
            kind = self.kinds[k]
            if kind in "()[]" and k in self.partner:
                return "P" if kind in "()" else "Q"
            return kind

        return token, seen

    def _after(self, k: int, step: int) -> int:
        return (self.partner[k] if self.kinds[k] in ("([" if step > 0 else ")]") and k in self.partner else k) + step


def declared(tokens: Tokens, line: int, name: str) -> tuple[str | None, str | None] | None:
    """(comment above, string as first statement) of the function declared at a line; None where none is.

    The name has to be among the words of the declaration, where it is a word at all.
    """
    at = tokens.first_of(line)
    if at is None:
        return None
    token, seen = tokens.view(at, 1)
    ends = DECLARATION.ends(token)
    if not ends:
        return None
    if name.isidentifier() and all(tokens.text[tokens.starts[k] : tokens.ends[k]] != name for k in seen[: max(ends)]):
        return None
    string = None
    if tokens.hashes:
        found = _PYTHON.ends(token)
        if found:
            k = seen[min(found) - 1]
            string = tokens.text[tokens.starts[k] : tokens.ends[k]]
    token, seen = tokens.view(at - 1, -1)
    above, comment = ABOVE.ends(token) if at else set(), None
    if above:
        top = seen[max(above) - 1]
        bottom = next(k for k in seen if tokens.kinds[k] == "C")
        comment = tokens.text[tokens.starts[top] : tokens.ends[bottom]]
    return comment, string
