"""The structure of source text: symbols with their ends, containment, imports, supertypes, calls.

A text is read with strings and comments blanked out, so brackets and words in them count for
nothing. Ends of symbols come from the partner of the opening brace or from indentation; what never
closes ends with the file. A broken text so still gives the symbols that stand in it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple


class Symbol(NamedTuple):
    kind: str
    name: str
    start: int
    end: int
    parent: int | None  # place of the innermost symbol round it
    head: str


class Reference(NamedTuple):
    owner: int | None  # place of the innermost symbol round it
    name: str
    kind: str
    line: int
    col: int


_STRINGS = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"
_LONG = r"\"{3}(?:[^\"\\]|\\.|\"(?!\"\"))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}"
_BLANK = {
    "python": re.compile(rf"{_LONG}|{_STRINGS}|#[^\n]*", re.S),
    "rust": re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|b?r#+\"(?:[^\"]|\"(?!#))*+\"#+|b?\"(?:[^\"\\]|\\.)*+\"|b?'(?:[^'\\\n]|\\.[^'\n]{0,8})'", re.S),
    "other": re.compile(rf"//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|`(?:[^`\\]|\\.)*+`|{_STRINGS}", re.S),
}
# Words that look like calls or names of functions and are neither.
_KEYWORDS = frozenset("if else for while do switch case catch try return function func fn def class struct enum interface impl new delete typeof sizeof void throw throws await yield async import export from with in is not and or lambda match loop let const var static go defer select range assert print elif except raise super this self synchronized instanceof using namespace template operator union typedef extern package type where unsafe mut ref pub use mod extends implements".split())
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|export|default|async|readonly|override|synchronized|native|pub(?:\([^)]*\))?|unsafe|const|extern|inline|virtual|declare|get|set)\s+)*"
# How declarations begin, by language.
_HEADS = {
    "python": [("class", r"class\s+(?P<name>\w+)"), ("function", r"(?:async\s+)?def\s+(?P<name>\w+)")],
    "go": [("function", r"func\s+\(\s*\w*\s*\*?\s*(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)"), ("function", r"func\s+(?P<name>\w+)"), ("struct", r"type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b")],
    "rust": [("function", _MODS + r"fn\s+(?P<name>\w+)"), ("struct", _MODS + r"(?:struct|union)\s+(?P<name>\w+)"), ("enum", _MODS + r"enum\s+(?P<name>\w+)"), ("trait", _MODS + r"trait\s+(?P<name>\w+)"), ("impl", _MODS + r"impl\b(?:<[^{]*?>)?\s+(?:[\w:<>, ']+\s+for\s+)?(?P<name>\w+)"), ("module", _MODS + r"mod\s+(?P<name>\w+)")],
    "java": [("class", _MODS + r"(?:class|record)\s+(?P<name>\w+)"), ("interface", _MODS + r"@?interface\s+(?P<name>\w+)"), ("enum", _MODS + r"enum\s+(?P<name>\w+)"), ("function", _MODS + r"(?:<[^>{]*>\s*)?(?:[\w.]+(?:<[^;={(]*>)?(?:\[\])*\s+)?(?P<name>\w+)\s*\((?![^)]*;)")],
    "c": [("struct", r"(?:typedef\s+)?(?:struct|union)\s+(?P<name>\w+)\s*(?=\{|\n\s*\{|$)"), ("enum", r"(?:typedef\s+)?enum\s+(?P<name>\w+)\s*(?=\{|\n\s*\{|$)"), ("function", r"(?:(?:static|inline|extern|const|unsigned|signed|struct|enum)\s+)*\w+[\s*]+(?:const\s+)?\**(?P<name>\w+)\s*\(")],
    "javascript": [("class", _MODS + r"class\s+(?P<name>\w+)"), ("function", _MODS + r"function\b\s*\*?\s*(?P<name>[\w$]+)"), ("function", r"(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)\n]*\)\s*(?::[^=\n]+)?=>|[\w$]+\s*=>)"), ("method", _MODS + r"\*?\s*#?(?P<name>[\w$]+)\s*(?:<[^(\n]*>)?\(")],
}
_HEADS["typescript"] = [_HEADS["javascript"][0], ("interface", _MODS + r"interface\s+(?P<name>\w+)"), ("enum", _MODS + r"enum\s+(?P<name>\w+)"), ("namespace", _MODS + r"(?:namespace|module)\s+(?P<name>\w+)"), *_HEADS["javascript"][1:]]
_COMPILED = {language: [(kind, re.compile(r"[ \t]*(?:@[\w.]+(?:\([^)\n]*\))?\s+)*" + pattern)) for kind, pattern in heads] for language, heads in _HEADS.items()}
_TYPES = ("class", "struct", "interface", "enum", "trait", "impl", "namespace", "module")
_CALL = re.compile(r"(?<![\w$.])(?:new\s+)?((?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*)\s*(?:::<[^>\n]*>)?\(")
_IMPORTS = {
    "python": re.compile(r"^[ \t]*(?:from\s+(?P<module>[\w.]+)\s+import\s+(?P<names>[^\n#]+)|import\s+(?P<plain>[\w.]+(?:\s*,\s*[\w.]+)*))", re.M),
    "javascript": re.compile(r"^[ \t]*(?:import\b[^\n;]*?from\s*|import\s*|(?:const|let|var)\s+[^\n=]+=\s*require\(\s*)['\"](?P<module>[^'\"\n]+)['\"]", re.M),
    "go": re.compile(r"^[ \t]*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<module>[\w./-]+)\"[ \t]*$", re.M),
    "java": re.compile(r"^[ \t]*import\s+(?:static\s+)?(?P<module>[\w.]+(?:\.\*)?)\s*;", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub\s+)?use\s+(?P<module>[\w:]+)", re.M),
    "c": re.compile(r"^[ \t]*#[ \t]*include\s*[<\"](?P<module>[^>\"\n]+)[>\"]", re.M),
}
_IMPORTS["typescript"] = _IMPORTS["javascript"]
_SUPERS = {
    "python": re.compile(r"class\s+\w+\s*\(([^)]*)\)"),
    "java": re.compile(r"\b(extends|implements)\s+([\w.<>, ]+?)(?=\bimplements\b|\{|$)"),
}
LANGUAGES = tuple(_HEADS)
# How a variable gets a type, by language: named groups v and t (or u).
_TYPED = {
    "python": re.compile(r"\b(?P<v>\w+)\s*=\s*(?:await\s+)?(?P<t>[A-Z]\w*)\(|\b(?P<w>\w+)\s*:\s*(?P<u>[A-Z]\w*)"),
    "typescript": re.compile(r"\b(?:const|let|var)\s+(?P<v>\w+)\s*(?::[^=;\n]+)?=\s*(?:await\s+)?new\s+(?P<t>[A-Z]\w*)|\b(?P<w>\w+)\??\s*:\s*(?P<u>[A-Z]\w*)"),
    "java": re.compile(r"\b(?P<t>[A-Z]\w*)(?:<[^;=()\n]*>)?\s+(?P<v>[a-z_]\w*)\s*(?=[=;,):])"),
    "go": re.compile(r"\b(?P<v>\w+)\s*:?=\s*&?(?P<t>[A-Z]\w*)\{|\b(?P<w>[a-z]\w*)\s+\*?(?P<u>[A-Z]\w*)(?=[,)])"),
    "rust": re.compile(r"\blet\s+(?:mut\s+)?(?P<v>\w+)\s*(?::[^=;\n]+)?=\s*(?P<t>[A-Z]\w*)(?=::|\s*\{|\()|\b(?P<w>\w+)\s*:\s*&?(?:'\w+\s+)?(?:mut\s+)?(?P<u>[A-Z]\w*)"),
}
_TYPED["javascript"] = _TYPED["typescript"]


def blanked(text: str, language: str) -> str:
    """The text with blanks in place of strings and comments; lines and places stay."""
    return _BLANK.get(language, _BLANK["other"]).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _partners(code: str) -> dict[int, int]:
    """The place of the closing brace of every opening one; what never closes ends with the text."""
    out, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out | dict.fromkeys(stack, max(0, len(code.rstrip()) - 1))


_SIGNS = re.compile(r"[(){};]|=>|\n[ \t]*\n")


def _body(code: str, at: int) -> int | None:
    """The opening brace of a declaration that begins at a place; None where it ends without one."""
    depth = 0
    for m in _SIGNS.finditer(code, at):
        c = m[0]
        depth += (c == "(") - (c == ")")
        if depth <= 0 and c == "{":
            return m.start()
        if depth <= 0 and c in ";}" or c[0] == "\n" and depth <= 0:
            return None
    return None


def symbols(text: str, language: str) -> list[Symbol]:
    """The symbols of a text in the order of their starts."""
    heads = _COMPILED.get(language)
    if heads is None:
        return []
    code = blanked(text, language)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line_of = lambda place: bisect_right(starts, place)
    braces = {} if language == "python" else _partners(code)
    found: list[tuple[int, int, str, str, str | None, str]] = []
    lines = code.split("\n")
    for k, line in enumerate(lines):
        if not line.strip():
            continue
        for kind, pattern in heads:
            m = pattern.match(line)
            if not m or m["name"] in _KEYWORDS:
                continue
            if language == "python":
                end = _indented_end(lines, k)
            else:
                opening = _body(code, starts[k] + m.start("name"))
                if opening is None and (kind in ("method", "function") and language in ("javascript", "typescript", "c", "java") or kind == "impl"):
                    arrow = language in ("javascript", "typescript") and "=>" in line
                    if not arrow:
                        continue
                end = line_of(braces[opening]) if opening is not None else k + 1
            found.append((k + 1, end, kind, m["name"], m.groupdict().get("owner"), line.strip()))
            break
    out: list[Symbol] = []
    stack: list[int] = []
    for start, end, kind, name, owner, head in found:
        while stack and out[stack[-1]].end < start:
            stack.pop()
        parent = stack[-1] if stack else None
        around = out[parent].kind if parent is not None else None
        if kind == "method" and around not in ("class", "interface"):
            continue  # a call with a block after it
        if kind == "function" and (around in ("class", "struct", "interface", "enum", "trait", "impl") or owner):
            kind = "method"
        stack.append(len(out))
        out.append(Symbol(kind, name, start, end, parent, head))
    return out


def _indented_end(lines: list[str], k: int) -> int:
    """The last line of the block that a header at line k (from 0) begins."""
    width = len(lines[k]) - len(lines[k].lstrip())
    last, depth = k, 0
    for n in range(k, len(lines)):
        line = lines[n]
        if n > k and depth <= 0 and line.strip() and len(line) - len(line.lstrip()) <= width and line.lstrip()[0] not in ")]}":
            break
        depth += sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
        last = n if line.strip() else last
    return last + 1


def enclosing(found: list[Symbol]) -> Callable[[int], int | None]:
    """The place of the innermost symbol round a line."""
    firsts = [s.start for s in found]

    def owner(line: int) -> int | None:
        k: int | None = bisect_right(firsts, line) - 1
        while k is not None and k >= 0 and found[k].end < line:
            k = found[k].parent
        return k if k is not None and k >= 0 else None

    return owner


def references(text: str, language: str, found: list[Symbol]) -> Iterator[Reference]:
    """Imports, supertypes and calls of a text, with the innermost symbol round each."""
    code = blanked(text, language)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    heads = {(s.start, s.name) for s in found}

    owner = enclosing(found)
    pattern = _IMPORTS.get(language)
    if pattern:
        for m in pattern.finditer(text):
            if code[m.start() : m.end()].strip() == "":
                continue
            line = bisect_right(starts, m.start())
            for name in [x for x in (m.groupdict().get("module"), *re.split(r"\s*,\s*", m.groupdict().get("plain") or "")) if x]:
                yield Reference(None, name, "imports", line, 0)
    for k, s in enumerate(found):
        if s.kind not in _TYPES:
            continue
        if language == "python":
            m = _SUPERS["python"].search(s.head)
            for name in re.findall(r"(?<![\w.=])([A-Za-z_][\w.]*+)(?!\s*=)", m[1]) if m else ():
                yield Reference(k, name, "extends", s.start, 0)
        else:
            for m in _SUPERS["java"].finditer(s.head):
                for name in re.findall(r"(?:^|,)\s*([\w.]+)", m[2]):
                    yield Reference(k, name, m[1], s.start, 0)
    for m in _CALL.finditer(code):
        name = m[1]
        tail = re.split(r"\.|::|->", name)[-1]
        line = bisect_right(starts, m.start(1))
        if tail in _KEYWORDS or (line, name) in heads:
            continue
        at = owner(line)
        if at is not None:
            yield Reference(at, name, "instantiates" if code[m.start() : m.start(1)].strip() == "new" else "calls", line, m.start(1) - starts[line - 1])


def typed_variables(text: str, language: str, found: list[Symbol]) -> Iterator[tuple[int | None, str, str]]:
    """(place of the innermost symbol, variable, type name) of declarations and assignments that tell a variable's type."""
    pattern = _TYPED.get(language)
    if pattern is None:
        return
    code = blanked(text, language)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    around = enclosing(found)
    for m in pattern.finditer(code):
        groups = m.groupdict()
        variable, kind = groups.get("v") or groups.get("w"), groups.get("t") or groups.get("u")
        if variable and kind and variable not in _KEYWORDS:
            yield around(bisect_right(starts, m.start())), variable, kind
