"""Syntax checks of source text for seven languages.

Python text goes to Python's own parser. The other six share one engine:

1. A single pattern cuts the text into tokens, and a table turns each token into one
   character (identifiers, numbers, strings, and a character per operator and keyword).
2. Brackets are reduced from the inside. The content of a group holds no brackets any
   more, so a regular grammar decides which roles it can play (arguments, parameters,
   block, object literal, class body, ...). The group becomes one character that stands
   for its set of roles; whatever surrounds it asks for the role that it needs.
3. What is left at the top must be a file of the language.

The reduction runs over a stack, so nesting of any depth costs linear time and no Python
recursion. Results per group are remembered; the memory of them is bounded.
"""

from __future__ import annotations

import ast
import re
import symtable
import warnings
from itertools import islice

import regex

IDENT, NUMBER, STRING, ERROR = "i", "0", "s", "\x00"
MEMO_LIMIT, MEMO_LENGTH = 60_000, 32
#: Token texts that get a character of their own; several texts may share one.
OPERATORS = {
    "=": "=", "+=": "=", "-=": "=", "*=": "=", "/=": "=", "%=": "=", "&=": "=", "|=": "=", "^=": "=", "<<=": "=", ">>=": "=", ">>>=": "=", "**=": "=", "&&=": "=", "||=": "=", "??=": "=", "&^=": "=",
    "/": "b", "%": "b", "^": "b", "==": "b", "!=": "b", "===": "b", "!==": "b", "<=": "b", ">=": "b", "&&": "b", "??": "b", "**": "b", "&^": "b",
    "||": "||", "|": "|", "&": "&", "+": "-", "-": "-", "*": "*", "<": "<", ">": ">", "<<": "<<", ">>": ">>", ">>>": ">>>", "!": "!", "~": "!",
    "++": "p", "--": "p", ".": ".", "?.": ".", "...": "d", "..": "d", "..=": "d", "=>": "a", "->": "r", "::": "c", ":=": "w", "<-": "l",
    ":": ":", ",": ",", ";": ";", "?": "?", "@": "@", "#": "#",
}
BRACKETS = "()[]{}"
_OPS = sorted(OPERATORS, key=len, reverse=True)
_KEYWORD_CHARS = [chr(c) for c in range(0x4E00, 0x4F00)]


class Grammar:
    """The engine for one language; subclasses give patterns.

    Rules are written in a small notation: 'text' is a token, NAME an earlier rule, P.role,
    S.role and B.role a round, square or curly group that can play the role, and the signs
    ( ) | * + ? have their regular meaning.
    """

    name = ""
    keywords = ""
    last_cut: tuple = (None, None, [])
    #: Pattern of what is skipped or taken whole before words and operators.
    special = ""
    string_starts = "\"'`"
    newlines = False
    #: Words are tried before what is special, where nothing special begins like a word.
    words_first = True

    def __init__(self) -> None:
        self.words = {w: _KEYWORD_CHARS[k] for k, w in enumerate(self.keywords.split())}
        self.all_words = "[" + "".join(self.words.values()) + "i]"
        ops = "|".join(map(re.escape, _OPS))
        first = r"[^\W\d][\w$]*|" if self.words_first else ""
        self.token = re.compile(rf"{first}{self.special}|[ \t\r\f\v ﻿]+|\n(?:\s*\n)?|[^\W\d][\w$]*|\$[\w$]*|\.?\d(?:\w|\.(?![._]|[A-Za-z]{{2}})|(?<=[eEpP])[+-])*|[()\[\]{{}}]|{ops}|.", re.S)
        base = OPERATORS | dict(zip(BRACKETS, BRACKETS)) | self.words
        grammar = self

        class Table(dict):
            def __missing__(self, text: str) -> str:
                if len(self) > MEMO_LIMIT:
                    self.clear()
                    self.update(grammar.base)
                found = grammar.classify(text, self)
                if len(text) <= MEMO_LENGTH:  # spaces, numbers, short strings and comments come again and again
                    self[text] = found
                return found

        self.base, self.table = base, Table(base)
        self.roles: dict[str, list[str]] = {"P": [], "S": [], "B": []}
        self.rules: dict[str, str] = {}
        self.checks: dict[str, list[tuple[int, re.Pattern]]] = {"P": [], "S": [], "B": []}
        for kind, names in self.group_roles().items():
            self.roles[kind] = names.split()
        self.start = {"P": 0xE000, "S": 0xE200, "B": 0xE400}
        self.file = self.begins = None
        self.define()
        self.memo: dict[str, str] = {}

    # Tokens

    def classify(self, text: str, table: dict) -> str:
        first = text[0]
        if first == "\n" or first in " \t\r\f\v\u00a0\ufeff":
            return "\n" if self.newlines and "\n" in text else ""
        if first.isalpha() or first in "_$" or first.isidentifier():
            return IDENT
        return self.classify_special(text, first)

    def classify_special(self, text: str, first: str) -> str:
        if text.startswith(("//", "/*")):
            return "\n" if self.newlines and "\n" in text else ""
        if first in self.string_starts and len(text) > 1:
            return STRING
        if first.isdigit() or (first == "." and len(text) > 1):
            return NUMBER if self.good_number(text) else ERROR
        return ERROR

    def good_number(self, text: str) -> bool:
        return _NUMBER.fullmatch(text) is not None

    def tokens(self, text: str) -> str:
        # Grammars that cut alike read one text one after the other: the last cut is kept.
        last = Grammar.last_cut
        if last[0] is not self.token or last[1] is not text:
            last = Grammar.last_cut = (self.token, text, self.token.findall(text))
        return self.settle("".join(map(self.table.__getitem__, last[2])))

    def settle(self, tokens: str) -> str:
        return tokens

    # Rules

    def compile(self, rule: str) -> str:
        out = []
        for part in re.findall(r"'[^']*'|[PSB]\.\w+|\w+|[()|*+?]|\S", rule):
            if part[0] == "'":
                for word in part[1:-1].split():
                    out.append(re.escape(self.words.get(word) or OPERATORS.get(word) or {"ident": "i", "number": "0", "string": "s", "newline": "\n"}[word]))
            elif part[1:2] == "." and part[0] in "PSB":
                out.append(self.group_class(part[0], part[2:]))
            elif part == "(":
                out.append("(?:")
            elif part in ")|*+?":
                out.append(part)
            else:
                out.append(self.rules[part])
        return "".join(out)

    def rule(self, name: str, text: str, atomic: bool = False) -> None:
        body = self.compile(text)
        self.rules[name] = f"(?>{body})" if atomic else f"(?:{body})"

    def bit(self, kind: str, role: str) -> int:
        return len(self.roles[kind]) - 1 - self.roles[kind].index(role)

    def group_class(self, kind: str, role: str) -> str:
        """Characters of the groups that can play the role, as ranges."""
        bit, size, start = 1 << self.bit(kind, role), 1 << len(self.roles[kind]), self.start[kind]
        return "[" + "".join(f"{chr(start + m)}-{chr(start + m + bit - 1)}" for m in range(bit, size, 2 * bit)) + "]"

    def role(self, kind: str, name: str, text: str) -> None:
        self.checks[kind].append((1 << self.bit(kind, name), re.compile(self.compile(text))))

    def group_roles(self) -> dict[str, str]:
        raise NotImplementedError

    def define(self) -> None:
        raise NotImplementedError

    def variants(self, content: str) -> tuple[str, ...]:
        """Readings of a content: as it stands, and with type arguments taken away."""
        if "<" not in content:
            return (content,)
        reduced, last = content, None
        while reduced != last:
            last, reduced = reduced, self.generic.sub(r"\1", reduced)
        return (content,) if reduced == content else (content, reduced)

    # Reduction

    def group(self, kind: str, content: str) -> str | None:
        """The character of a group with this content; None when it can play no role."""
        known = self.memo.get(kind + content)
        if known is not None:
            return known or None
        mask = 0
        for reading in self.variants(content):
            for bit, check in self.checks[kind]:
                if not mask & bit and check.fullmatch(reading):
                    mask |= bit
        found = chr(self.start[kind] + mask) if mask else ""
        if len(content) < 200:
            if len(self.memo) > MEMO_LIMIT:
                self.memo.clear()
            self.memo[kind + content] = found
        return found or None

    def reduce(self, tokens: str) -> list[str] | None:
        """The parts at the top and in every bracket still open, without closed groups; None if a bracket or a group is wrong."""
        pieces = _SPLIT.split(tokens)
        memo, frame = self.memo, [pieces[0]]
        stack: list[tuple[str, list[str]]] = []
        for k in range(1, len(pieces), 2):
            bracket = pieces[k]
            kind = _KIND.get(bracket)
            if kind is None:
                stack.append((bracket, frame))
                frame = [pieces[k + 1]]
                continue
            if not stack or stack[-1][0] != _OPENS[bracket]:
                return None
            content = "".join(frame)
            symbol = memo.get(kind + content) or self.group(kind, content)
            if symbol is None:
                return None
            frame = stack.pop()[1]
            frame.append(symbol)
            frame.append(pieces[k + 1])
        return ["".join(f) for _, f in stack] + ["".join(frame)]

    def valid(self, text: str) -> bool:
        tokens = self.tokens(text)
        if ERROR in tokens:
            return False
        left = self.reduce(tokens)
        return left is not None and len(left) == 1 and any(self.file.fullmatch(reading) for reading in self.variants(left[0]))

    def plausible(self, text: str, first: int) -> bool:
        """False if the first tokens alone show that a text breaks the grammar, whatever follows them.

        A wrong token, a closed group without a role, and complete statements that no file can begin
        with are final; what is still open after the first tokens says nothing.
        """
        found = [m[0] for m in islice(self.token.finditer(text), first)]
        tokens = self.settle("".join(map(self.table.__getitem__, found)))
        if ERROR in tokens:
            return False
        left = self.reduce(tokens)
        if left is None:
            return False
        top = left[0].rstrip("\n")
        if "<" in top:  # type arguments may be cut in two but at the end of a statement
            top = top[: max((k for k, c in enumerate(top) if c == ";" or 0xE400 <= ord(c) < 0xE600), default=-1) + 1]
        if not top:
            return True
        if self.begins is None:
            self.begins = regex.compile(self.file.pattern)
        return any(self.begins.fullmatch(reading, partial=True) for reading in self.variants(top))


_NEVER = re.compile(r"(?!)()")
_SPLIT = re.compile(r"([()\[\]{}])")
_KIND, _OPENS = {")": "P", "]": "S", "}": "B"}, {")": "(", "]": "[", "}": "{"}
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?\w*|0[bB][01_]+\w*|0[oO]?[0-7_]+\w*|(?:\d[\d_]*)?\.?[\d_]*(?:[eE][+-]?[\d_]+)?(?:[uUlLfFdDn]+|i|[iuf](?:8|16|32|64|128|size))?")
_C_SPECIAL = r'//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|"(?:[^"\\\n]|\\.)*+"'


class Script(Grammar):
    """JavaScript."""

    name = "javascript"
    keywords = "var let const function class extends return if else for while do switch case default break continue throw try catch finally new delete typeof void in instanceof this super null true false import export await yield debugger with enum async of get set static from as"
    special = _C_SPECIAL + r"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`|(?<=[(,=:\[!&|?{};+\n])[ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|(?<=return)[ \t]+/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|\#![^\n]*|\#[A-Za-z_]\w*"
    newlines = True
    contextual = "async of get set static from as let"

    def classify(self, text: str, table: dict) -> str:
        stripped = text.lstrip(" \t")
        if stripped and stripped[0] == "/" and len(stripped) > 1 and not stripped.startswith(("//", "/*")):
            return STRING
        if text[0] == "#" and len(text) > 1:
            return "" if text[1] == "!" else IDENT
        return super().classify(text, table)

    def settle(self, tokens: str) -> str:
        return self.breaks.sub("", tokens)

    def group_roles(self) -> dict[str, str]:
        return {"P": "cond args params forhead", "S": "array", "B": "block object members cases"}

    def define(self) -> None:
        w = self.words
        ends = "i0s)]}p" + "".join(w[x] for x in "this super null true false return break continue debugger".split()) + "".join(w[x] for x in self.contextual.split())
        starts = "i0s{@" + "".join(c for x, c in w.items() if x not in ("in", "instanceof", "as", "satisfies", "of", "from", "is"))
        self.breaks = re.compile(rf"(?<![{re.escape(ends)}\n])\n+|\n+(?![\n{re.escape(starts)}!p])")
        self.generic = _NEVER
        self.rules["I"] = "[i" + "".join(w[x] for x in self.contextual.split()) + "]"
        self.rules["KEYNAME"] = self.all_words
        self.rules["SEP"] = r"(?:,\n?|\n?(?=\Z))"
        self.rules["NL"] = "\n*"
        self.rules["END"] = r"(?:[;\n]|(?=\Z))"
        self.rule("KEY", "KEYNAME | 'string' | 'number' | S.array")
        self.types()
        self.expressions()
        self.statements()
        self.file = re.compile(self.compile("STATEMENT *"))

    def types(self) -> None:
        self.rules |= {"RETURNS": "", "ANNOTATION": "", "IMPLEMENTS": "", "DECORATORS": "", "CAST": "(?!)", "NONNULL": "(?!)", "TYPEONLY": ""}
        self.rules["MODS"] = self.compile("( 'static' | 'async' | 'get' | 'set' | '*' ) *")
        self.rules["OPTIONAL"] = ""

    def expressions(self) -> None:
        self.rule("ARROW", "'async' ? ( P.params RETURNS | I ) 'newline' ? '=>'", True)
        self.rule("FUNC", "'async' ? 'function' '*' ? I ? P.params RETURNS B.block")
        self.rule("CLASS", "'class' I ? ( 'extends' I ( '.' KEYNAME ) * P.args ? ) ? IMPLEMENTS B.members")
        self.rule("PREFIX", "'!' | '-' | '++' | '...' | 'typeof' | 'void' | 'delete' | 'await' | 'yield' '*' ? | 'new' | ARROW")
        self.rule("PRIMARY", "FUNC | CLASS | I | 'number' | 'string' | 'this' | 'super' | 'null' | 'true' | 'false' | P.cond | S.array | B.object | 'import' | 'yield'")
        self.rule("POSTFIX", "'.' KEYNAME | '.' ? P.args | '.' ? S.array | 'string' | '++' | NONNULL | CAST")
        body = f"(?>{self.rules['PREFIX']}*(?:(?<=a){self.group_class('B', 'block')}|{self.rules['PRIMARY']}){self.rules['POSTFIX']}*)"
        binary = self.compile("'/' | '-' | '*' | '&' | '|' '|' ? | '<' '<' ? | '>' '>' ? '>' ? | '=' | '?' | ':' | 'in' | 'instanceof'")
        tail = "[b\\-*&|<>=?:" + self.words["in"] + self.words["instanceof"] + "]"
        first = r"[0si({\[!\-" + "".join(c for x, c in self.words.items() if x not in ("in", "instanceof", "of", "as", "satisfies", "is", "from", "extends", "implements", "else", "while", "catch", "finally")) + "-]"
        plain = binary.replace("|\\?|:|", "|")
        self.rules["OPERAND"] = body
        self.rules["CASEVALUE"] = f"(?>(?:{body}(?:(?:{plain})|(?!{first})))+(?<!{tail}))"
        self.rules["EXPR"] = f"(?>(?:{body}(?:(?:{binary})|(?!{first})))+(?<!{tail}))"
        self.rules["LIST"] = f"(?>(?:{body}(?:(?:{binary}|,+\n?)|(?!{first})))+(?<!{tail})(?<!,))"

    def statements(self) -> None:
        self.rule("TARGET", "( I | B.object | S.array | 'this' ) ANNOTATION")
        self.rule("PARAM", "DECORATORS MODS '...' ? TARGET ( '=' EXPR ) ?")
        self.rule("VAR", "( 'var' | 'let' | 'const' ) TARGET ( '=' LIST ) ? ( ',' TARGET ( '=' LIST ) ? ) *")
        self.rule("MODULE", "'import' TYPEONLY ( 'string' | ( I ( ',' ( '*' 'as' I | B.object ) ) ? | '*' 'as' I | B.object ) 'from' 'string' | I '=' LIST ) END | 'export' TYPEONLY ( '*' ( 'as' KEYNAME ) ? 'from' 'string' END | B.object ( 'from' 'string' ) ? END )")
        self.rule("FUNCTION", "'async' ? 'function' '*' ? I ? P.params RETURNS ( B.block | BODYLESS )" if "BODYLESS" in self.rules else "'async' ? 'function' '*' ? I ? P.params RETURNS B.block")
        self.rule("DECLARE", "TYPES_DECL" if "TYPES_DECL" in self.rules else "'debugger' END")
        self.rule("SIMPLE", "( 'export' 'default' ? ) ? ( FUNCTION | DECORATORS CLASSHEAD 'class' I ? ( 'extends' I ( '.' KEYNAME ) * P.args ? ) ? IMPLEMENTS B.members | DECLARE )" if "CLASSHEAD" in self.rules else "( 'export' 'default' ? ) ? ( FUNCTION | CLASS | DECLARE )")
        self.rule("PLAINEND", "( 'export' ? VAR | ( 'export' 'default' ) ? LIST | ( 'return' | 'throw' ) LIST | 'return' | ( 'break' | 'continue' ) I ? | 'debugger' ) END")
        self.rule("TRY", "'try' NL B.block NL ( 'catch' P.params ? NL B.block ( NL 'finally' NL B.block ) ? | 'finally' NL B.block )")
        self.rule("CORE", "B.block | SIMPLE | 'switch' P.cond NL B.cases | TRY | MODULE | PLAINEND | ';'")
        self.rule("HEAD", "'if' P.cond NL | 'for' 'await' ? P.forhead NL | 'while' P.cond NL | 'with' P.cond NL | 'do' NL | I ':' NL")
        after = "(?<=[;\n" + self.group_class("B", "block")[1:-1] + "])"
        self.rules["ELSE"] = f"(?:{after}{self.words['else']}\n*)"
        self.rule("STATEMENT", "'newline' | ELSE ? HEAD * CORE", True)
        self.rule("METHOD", "MODS KEY OPTIONAL P.params RETURNS B.block")
        self.rule("MEMBER", "DECORATORS ( METHOD | 'static' B.block | MODS KEY ANNOTATION ( '=' EXPR ) ? END | SIGNATURES )" if "SIGNATURES" in self.rules else "METHOD | 'static' B.block | 'static' ? KEY ( '=' EXPR ) ? END")
        self.rule("PROPERTY", "METHOD | KEY ':' EXPR | TYPEONLY ( I | 'default' ) 'as' KEYNAME | TYPEONLY I ( '=' EXPR ) ? | 'default' | '...' EXPR")
        self.role("P", "args", "( LIST ',' ? ) ?")
        self.role("P", "params", "( PARAM SEP ) *")
        self.role("P", "cond", "LIST")
        self.role("P", "forhead", "( VAR | LIST ) ? ';' LIST ? ';' LIST ? | ( ( 'var' | 'let' | 'const' ) TARGET | OPERAND ) ( 'of' | 'in' ) LIST | LIST")
        self.role("S", "array", "( ',' * LIST ',' * ) ? | ',' +")
        self.role("B", "block", "STATEMENT *")
        self.role("B", "object", "( PROPERTY SEP ) *")
        self.role("B", "members", "( MEMBER | ';' | 'newline' ) *")
        self.role("B", "cases", "( ( 'case' CASEVALUE | 'default' ) ':' STATEMENT * ) *")


class TypeScript(Script):
    """TypeScript."""

    name = "typescript"
    keywords = Script.keywords + " type interface namespace module declare abstract readonly private protected public implements keyof infer is satisfies override unknown asserts"
    contextual = Script.contextual + " type namespace module declare abstract readonly keyof infer is satisfies override unknown asserts private protected public interface implements"

    def group_roles(self) -> dict[str, str]:
        return {"P": "cond args params type forhead", "S": "array types index", "B": "block object members cases signature enum"}

    def types(self) -> None:
        names = self.rules["I"]
        self.rule("TYPEATOM", "( 'keyof' | 'readonly' | 'infer' | 'typeof' | 'asserts' ) * ( P.params '=>' | 'new' P.params '=>' ) ? ( I ( '.' KEYNAME ) * | 'void' | 'null' | 'this' | 'string' | '-' ? 'number' | 'true' | 'false' | B.signature | S.types | P.type ) ( S.types | S.index ) *")
        atom = self.rules["TYPEATOM"]
        link = self.compile("'|' | '&' | 'is' | 'extends' | '?' | ':' | '=>'")
        nocolon = self.compile("'|' | '&' | 'is' | 'extends'")
        links = "".join(self.words[x] for x in "as satisfies is of from".split())
        first = f"(?![{links}])[{names[1:-1]}0s{self.words['void']}{self.words['null']}{self.words['this']}]"
        self.rules["TYPE"] = f"(?>(?:[|&]\n?)?(?:{atom}(?:{nocolon}|(?!{first})))+(?:\\?{atom}:{atom})*)"
        self.rules["ANYTYPE"] = f"(?>(?:[|&]\n?)?(?:{atom}(?:\n?(?:{link})|(?!{first})))+)"
        flat = self.rules["ANYTYPE"]
        self.generic = re.compile(rf"({names}|(?<=[-;\n,=(]))<(?:(?:{self.words['const']})?{flat}(?:={flat})?(?:,|(?=>)))+>(?![0s])")
        self.rule("RETURNS", "( ':' TYPE ) ?")
        self.rule("ANNOTATION", "( '?' | '!' ) ? ( ':' TYPE ) ?")
        self.rule("IMPLEMENTS", "( 'implements' TYPE ( ',' TYPE ) * ) ?")
        self.rule("DECORATORS", "( '@' I ( '.' KEYNAME ) * P.args ? NL ) *")
        self.rule("CAST", "( 'as' | 'satisfies' ) ( 'const' | TYPE )")
        self.rules["NONNULL"] = "!"
        self.rules["OPTIONAL"] = r"\??"
        self.rule("TYPEONLY", "'type' ?")
        self.rule("MODS", "( 'private' | 'protected' | 'public' | 'readonly' | 'override' | 'static' | 'abstract' | 'declare' | 'async' | 'get' | 'set' | '*' ) *")
        self.rule("CLASSHEAD", "( 'declare' | 'abstract' ) *")
        self.rule("BODYLESS", "END")
        self.rule("SIGNATURES", "MODS KEY OPTIONAL P.params RETURNS END | MODS S.index ':' TYPE END")

    def statements(self) -> None:
        self.rule("SIG", "( 'readonly' | 'get' | 'set' | '-' ) * ( ( KEY | S.index ) '-' ? '?' ? ( P.params ? ':' ANYTYPE | P.params ) ? | 'new' ? P.params ( ':' ANYTYPE ) ? )")
        self.rule("TARGET", "( I | B.object | S.array ) ANNOTATION")
        self.rule("TYPES_DECL", "'declare' ? ( 'interface' I ( 'extends' TYPE ( ',' TYPE ) * ) ? B.signature | 'type' I '=' ANYTYPE END | 'const' ? 'enum' I B.enum | ( 'namespace' | 'module' ) ( I ( '.' I ) * | 'string' ) B.block | ( 'const' | 'let' | 'var' ) TARGET END | 'function' I P.params RETURNS END )")
        super().statements()
        self.role("B", "signature", "( SIG ( ';' | ',' | 'newline' | END ) NL ) *")
        self.role("B", "enum", "( KEY ( '=' EXPR ) ? SEP ) *")
        self.role("P", "type", "ANYTYPE")
        self.role("S", "types", "( '...' ? ( I '?' ? ':' ) ? TYPE '?' ? SEP ) *")
        self.role("S", "index", "I ( ':' | 'in' ) ANYTYPE ( 'as' ANYTYPE ) ?")


class Java(Grammar):
    """Java."""

    name = "java"
    keywords = "package import class interface enum extends implements public private protected static final abstract native synchronized transient volatile strictfp default void boolean byte char short int long float double if else for while do switch case break continue return throw throws try catch finally new this super null true false instanceof assert var record yield sealed permits non"
    special = r'"""(?:[^"\\]|\\.|"(?!""))*+"""|' + _C_SPECIAL + r"|'(?:[^'\\\n]|\\.[0-7u0-9a-fA-F]*)'"
    string_starts = "\"'"

    def group_roles(self) -> dict[str, str]:
        return {"P": "cond args params cast forhead resources annotation", "S": "empty index", "B": "block members array cases enum"}

    def define(self) -> None:
        w = self.words
        self.rules["I"] = "[i" + "".join(w[x] for x in "record yield sealed permits non var".split()) + "]"
        self.rules["SEP"] = r"(?:,|(?=\Z))"
        self.rule("BASIC", "'boolean' | 'byte' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double'")
        self.rule("NAME", "I ( '.' I ) *", True)
        self.rule("NOTE", "'@' NAME P.annotation ?", True)
        self.rule("TYPE", "( BASIC | NAME ) S.empty *", True)
        arg = self.compile("NOTE * ( TYPE | '?' ) ( ( 'extends' | 'super' ) TYPE ( '&' TYPE ) * ) ?")
        modifier = "".join(w[x] for x in "public static private protected final abstract default new".split())
        self.generic = re.compile(rf"({self.rules['I']}|(?<=[.,;c\n{modifier}])|(?<=[-])|^)<(?:{arg}(?:,|(?=>)))*>(?![0s])")
        self.rule("MOD", "NOTE | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'")
        self.rules["MODS"] = f"(?>{self.rules['MOD']}*)"
        self.rule("LAMBDA", "( I | P.params | P.args ) '->'", True)
        self.rule("CREATE", "'new' ( BASIC | NAME ) ( S.index + S.empty * | S.empty + B.array | P.args B.members ? )")
        self.rule("PRIMARY", "CREATE | 'switch' P.cond B.cases | I | 'number' | 'string' | 'this' | 'super' | 'null' | 'true' | 'false' | BASIC S.empty * ( '.' 'class' | '::' 'new' ) | 'void' '.' 'class' | P.cond")
        self.rule("POSTFIX", "'.' ( I | 'class' | 'this' | 'super' | 'new' I P.args ) | P.args | S.index | S.empty + ( '.' 'class' | '::' 'new' ) | '++' | '::' ( I | 'new' ) | 'instanceof' 'final' ? TYPE ( I | P.params ) ?")
        self.rule("PREFIX", "LAMBDA | '!' | '-' | '++' | P.cast")
        body = f"(?:{self.rules['PREFIX']}*(?:(?<=r){self.group_class('B', 'block')}|{self.rules['PRIMARY']}){self.rules['POSTFIX']}*)"
        binary = self.compile("'/' | '-' | '*' | '&' | '|' '|' ? | '<' '<' ? | '>' '>' ? '>' ? | '=' | '?' | ':'")
        plain = binary.replace("|\\?|:", "")
        first = "[i0s!" + "".join(w.values()) + "-]"
        self.rules["EXPR"] = f"(?>(?:{body}(?:(?:{binary})|(?!{first})))+(?<![b\\-*&|<>=?:]))"
        self.rules["CASEVALUE"] = f"(?>(?:{body}(?:(?:{plain})|,|(?!{first})))+(?<![b\\-*&|<>=?:,]))"
        self.rules["LIST"] = f"(?>(?:{body}(?:(?:{binary})|,|(?!{first})))+(?<![b\\-*&|<>=?:,]))"
        self.rule("LOCAL", "MODS TYPE I S.empty * ( '=' ( LIST | B.array ) ) ? ( ',' I S.empty * ( '=' ( LIST | B.array ) ) ? ) *")
        self.rule("TYPES", "TYPE ( ',' TYPE ) *")
        self.rule("CLASS", "MODS ( 'class' I ( 'extends' TYPE ) ? ( ( 'implements' | 'permits' ) TYPES ) * B.members | 'interface' I ( ( 'extends' | 'permits' ) TYPES ) * B.members | '@' 'interface' I B.members | 'enum' I ( 'implements' TYPES ) ? B.enum | 'record' I P.params ( 'implements' TYPES ) ? B.members )")
        self.rule("TRY", "'try' ( P.resources B.block ( 'catch' P.params B.block ) * ( 'finally' B.block ) ? | B.block ( ( 'catch' P.params B.block ) + ( 'finally' B.block ) ? | 'finally' B.block ) )")
        self.rule("CORE", "B.block | TRY | 'switch' P.cond B.cases | 'synchronized' P.cond B.block | CLASS | LOCAL ';' | ( 'return' | 'throw' | 'yield' | 'assert' ) ? EXPR ';' | 'return' ';' | ( 'break' | 'continue' ) I ? ';' | ';'")
        self.rule("HEAD", "'if' P.cond | 'for' P.forhead | 'while' P.cond | 'do' | I ':'")
        after = "(?<=[;" + self.group_class("B", "block")[1:-1] + "])"
        self.rules["ELSE"] = f"(?:{after}{w['else']})"
        self.rule("STATEMENT", "ELSE ? HEAD * CORE", True)
        self.rule("THROWS", "( 'throws' TYPES ) ?")
        self.rule("MEMBER", "CLASS | MODS ( ( TYPE | 'void' ) I P.params S.empty * THROWS ( 'default' ( EXPR | B.array ) ) ? ( B.block | ';' ) | I P.params THROWS B.block | I B.block | LOCAL ';' ) | 'static' ? B.block | ';'", True)
        self.rule("PARAM", "MODS TYPE ( '|' TYPE ) * '...' ? ( I ( '.' 'this' ) ? | 'this' ) S.empty *")
        self.role("P", "args", "LIST ?")
        self.role("P", "params", "( PARAM SEP ) * | ( I SEP ) +")
        self.role("P", "cond", "EXPR")
        self.role("P", "forhead", "( LOCAL | LIST ) ? ';' EXPR ? ';' LIST ? | MODS TYPE I ':' EXPR")
        self.role("P", "resources", "( ( LOCAL | NAME ) ( ';' | SEP ) ) +")
        self.role("P", "annotation", "( ( I '=' ) ? ( LIST | B.array | NOTE ) SEP ) *")
        self.role("P", "cast", "TYPE ( '&' TYPE ) *")
        self.rules["NOTHING"] = ""
        self.role("S", "empty", "NOTHING")
        self.role("S", "index", "EXPR")
        self.role("B", "block", "STATEMENT *")
        self.role("B", "array", "( ( EXPR | B.array | NOTE ) SEP ) *")
        self.role("B", "members", "MEMBER *")
        self.role("B", "cases", "( ( 'case' ( CASEVALUE | TYPE I ) | 'default' ) ( ':' STATEMENT * | '->' ( EXPR ';' | B.block | 'throw' EXPR ';' ) ) ) *")
        self.role("B", "enum", "( NOTE * I P.args ? B.members ? ( ',' | SEP | ( ';' MEMBER * ) ) ) *")
        self.file = re.compile(self.compile("( NOTE * 'package' NAME ';' ) ? ( 'import' 'static' ? I ( '.' I ) * ( '.' '*' ) ? ';' | ';' ) * ( CLASS | ';' ) *"))


class Go(Grammar):
    """Go."""

    name = "go"
    keywords = "package import func type struct interface map chan var const if else for range switch case default select break continue fallthrough return defer go goto"
    special = _C_SPECIAL + r"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{1,10}?)'"
    newlines = True

    def group_roles(self) -> dict[str, str]:
        return {"P": "cond args params group imports", "S": "index size tparams", "B": "block literal cases fields methods comm"}

    def settle(self, tokens: str) -> str:
        return self.skip.sub("", self.breaks.sub(";", tokens))

    def define(self) -> None:
        w = self.words
        ends = re.escape("i0s)]}p" + "".join(w[x] for x in "break continue fallthrough return".split()))
        self.breaks, self.skip = re.compile(rf"(?<=[{ends}])\n+"), re.compile(r"\n+")
        self.generic = _NEVER
        self.rules["SEP"] = r"(?:,|(?=\Z))"
        self.rules["END"] = r"(?:;|(?=\Z))"
        self.rule("TYPEHEAD", "( '*' | S.size | 'map' S.index | 'chan' '<-' ? | '<-' 'chan' ) *", True)
        self.rule("TYPE", "'...' ? TYPEHEAD ( 'ident' ( '.' 'ident' ) ? ( S.tparams | S.index ) ? | 'struct' B.fields | 'interface' B.methods | P.cond | 'func' P.params ( P.params | TYPEHEAD 'ident' ( '.' 'ident' ) ? ) ? )", True)
        self.rule("RESULT", "( P.params | TYPE ) ?")
        self.rule("FUNC", "'func' P.params ( P.params | TYPEHEAD 'ident' ( '.' 'ident' ) ? ) ? B.block")
        self.rule("PREFIX", "'!' | '-' | '&' | '*' | '<-' | '/'")
        first = "[i0s!" + w["func"] + w["map"] + w["struct"] + "-]"
        binary = self.compile("'/' | '-' | '*' | '&' | '|' '|' ? | '<' '<' ? | '>' '>' ?")
        self.rule("OPERAND", "PREFIX * ( FUNC | TYPE | 'number' | 'string' ) ( '.' ( 'ident' | P.cond | P.group ) | P.args | S.index | S.size | S.tparams | B.literal ) *", True)
        self.rule("OPERAND0", "PREFIX * ( FUNC | TYPEHEAD 'ident' | 'number' | 'string' | P.cond ) ( '.' ( 'ident' | P.cond | P.group ) | P.args | S.index ) *", True)
        self.rules["EXPR"] = f"(?>(?:{self.rules['OPERAND']}(?:{binary}|(?!{first})))+(?<![b\\-*&|<>]))"
        self.rules["LIST"] = f"(?>(?:{self.rules['OPERAND']}(?:{binary}|,|(?!{first})))+(?<![b\\-*&|<>,]))"
        self.rules["LIST0"] = f"(?>(?:{self.rules['OPERAND0']}(?:{binary}|,|(?!{first})))+(?<![b\\-*&|<>,]))"
        self.rule("SIMPLE", "LIST ( ( '=' | ':=' ) LIST | '++' | '<-' LIST ) ?")
        self.rule("SIMPLE0", "LIST0 ( ( '=' | ':=' ) 'range' ? LIST0 | '++' ) ?")
        self.rule("IDENTS", "'ident' ( ',' 'ident' ) *")
        self.rule("SPEC", "IDENTS TYPE ? ( '=' LIST ) ?")
        self.rule("TYPESPEC", "'ident' S.tparams ? '=' ? TYPE")
        self.rule("DECL", "( 'var' | 'const' ) ( SPEC | P.group ) | 'type' ( TYPESPEC | P.group )")
        self.rule("HEADED", "( 'if' | 'switch' | 'for' 'range' ? ) SIMPLE0 ? ( ';' SIMPLE0 ? ) ? ( ';' SIMPLE0 ? ) ?")
        self.rule("CORE", "( HEADED ( B.block | B.cases ) | B.block ) ( 'else' ( HEADED ) ? B.block ) * | 'for' B.block | 'select' B.comm | 'switch' B.cases | 'return' LIST ? | ( 'break' | 'continue' | 'goto' ) 'ident' ? | 'fallthrough' | ( 'defer' | 'go' ) EXPR | DECL | SIMPLE")
        self.rule("STATEMENT", "'ident' ':' ';' ? | CORE END | ';'", True)
        self.role("P", "args", "( LIST '...' ? ',' ? ) ?")
        self.role("P", "params", "( IDENTS TYPE SEP ) * | ( TYPE SEP ) *")
        self.role("P", "imports", "( ( 'ident' | '.' ) ? 'string' END ) *")
        self.role("P", "group", "( ( SPEC | TYPESPEC ) END ) * | 'type'")
        self.role("P", "cond", "EXPR")
        self.role("S", "size", "( EXPR | '...' ) ?")
        self.role("S", "index", "EXPR | EXPR ? ':' EXPR ? ( ':' EXPR ) ?")
        self.role("S", "tparams", "( IDENTS ? '!' ? TYPE ( '|' '!' ? TYPE ) * SEP ) +")
        self.role("B", "block", "STATEMENT *")
        self.role("B", "literal", "( ( EXPR | B.literal ) ( ':' ( EXPR | B.literal ) ) ? SEP ) *")
        self.role("B", "fields", "( ( IDENTS TYPE | TYPE ) 'string' ? END ) *")
        self.role("B", "methods", "( ( 'ident' P.params RESULT | '!' ? TYPE ( '|' '!' ? TYPE ) * ) END ) *")
        self.role("B", "cases", "( ( 'case' LIST | 'default' ) ':' ';' ? STATEMENT * ) *")
        self.role("B", "comm", "( ( 'case' SIMPLE | 'default' ) ':' ';' ? STATEMENT * ) *")
        self.file = re.compile(self.compile("';' * 'package' 'ident' END ( 'import' ( ( 'ident' | '.' ) ? 'string' | P.imports ) END | ';' ) * ( 'func' P.params ? 'ident' S.tparams ? P.params RESULT B.block ? END | DECL END | ';' ) *"))

    def valid(self, text: str) -> bool:
        return not self.tokens(text) or super().valid(text)


class Rust(Grammar):
    """Rust."""

    name = "rust"
    words_first = False
    keywords = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union"
    special = r'//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*+\*/|b?r(\#+)".*?"\1|b?r"[^"]*"|[bc]?"(?:[^"\\]|\\.)*+"|b?\'(?:[^\'\\\n]|\\[^\n]{1,9}?)\'|\'[^\W\d]\w*'.replace(r'(\#+)".*?"\1', r'\#".*?"\#|b?r\#\#".*?"\#\#|b?r\#\#\#".*?"\#\#\#')
    string_starts = "\"'"

    def classify(self, text: str, table: dict) -> str:
        if text[0] in "brc" and ('"' in text or "'" in text):
            return STRING
        if text[0] == "'" and len(text) > 1:
            return STRING if text[-1] == "'" else "L"
        return super().classify(text, table)

    def group_roles(self) -> dict[str, str]:
        return {"P": "args params types pattern vis any", "S": "array types pattern attr any", "B": "block init items fields arms enum uses pattern any"}

    def define(self) -> None:
        w = self.words
        self.rules["I"] = f"[i{w['union']}{w['Self']}]"
        self.rules["SEP"] = r"(?:,|(?=\Z))"
        self.rule("SEG", "I | 'self' | 'super' | 'crate'")
        self.rule("PATH", "'::' ? SEG ( '::' '::' ? SEG ) *", True)
        self.rules["LIFE"] = "L"
        self.rule("TYPEHEAD", "( '&' LIFE ? 'mut' ? | '*' ( 'const' | 'mut' ) | 'dyn' | 'impl' ) *", True)
        self.rule("TYPEATOM", "TYPEHEAD ( 'for' ? PATH ( P.types ( '->' TYPEHEAD ( PATH | P.types | S.types ) ) ? ) ? | P.types | S.types | '!' | '?' PATH | LIFE | 'unsafe' ? ( 'extern' 'string' ? ) ? 'fn' P.params ( '->' TYPEHEAD ( PATH | P.types ) ) ? )")
        self.rule("TYPE", "TYPEATOM ( '-' TYPEATOM ) *", True)
        arg = self.compile("LIFE ( ':' LIFE ( '-' LIFE ) * ) ? | 'const' I ':' TYPE ( '=' 'number' ) ? | ( I ( '=' | ':' ) ) ? TYPE ( '=' TYPE ) ? | 'number' | B.block")
        self.generic = re.compile(rf"({self.rules['I']}|c|(?<={w['impl']})|(?<={w['for']}))<(?:(?:{arg})(?:,|(?=>)))*>")
        self.rule("ATTR", "'#' '!' ? S.attr", True)
        self.rules["ATTRS"] = f"(?>{self.rules['ATTR']}*)"
        self.rule("PAT1", "'&' * 'ref' ? 'mut' ? ( PATH ( P.pattern | B.pattern ) ? ( '@' ( PATH ( P.pattern | B.pattern ) ? | 'number' | P.pattern ) ) ? | '-' ? 'number' | 'string' | 'true' | 'false' | P.pattern | S.pattern | '...' ) ( '...' ( '-' ? 'number' | 'string' | PATH ) ? ) ?")
        self.rule("PAT", "'|' ? PAT1 ( '|' PAT1 ) *", True)
        self.rule("CLOSURE", "'async' ? 'move' ? ( '|' '|' | '|' PAT1 ( ':' TYPE ) ? ( ',' PAT1 ( ':' TYPE ) ? ) * '|' ) ( '->' TYPE ) ?", True)
        self.rule("PREFIX", "'&' 'mut' ? | '*' | '!' | '-' | CLOSURE | 'return' | 'break' LIFE ? | '...'")
        self.rule("LEAF", "PATH ( '!' ( P.any | S.any | B.any ) ) ? | 'number' | 'string' | 'true' | 'false' | P.args | S.array | 'continue' LIFE ?")
        self.rule("POSTFIX", "'.' ( I | 'number' | 'await' ) | '::' ? P.args | S.array | '?' | 'as' TYPE | '...'")
        binary = self.compile("'/' ( 'let' PAT '=' ) ? | '-' | '*' | '&' | '|' '|' ? | '<' '<' ? | '>' '>' ? | '=' | '...'")
        first = r"[i0s!Lc" + "".join(w[x] for x in "self Self super crate true false union if match loop for while unsafe return break continue move".split()) + "-]"
        tail = r"(?<![b\-*&|<>=])"
        empties = self.compile("'return' | 'break' LIFE ? | 'continue' LIFE ?")
        self.rules["HEADEXPR"] = f"(?>(?:{self.compile('( PREFIX * LEAF POSTFIX * )')}(?:{binary}|(?!{first})))+{tail})"
        self.rule("LABEL", "( LIFE ':' ) ?")
        self.rule("LETCOND", "( 'let' PAT '=' ) ? HEADEXPR")
        self.rule("BLOCKLIKE", "LABEL ( ( ( 'if' | 'while' | 'match' | 'for' PAT 'in' ) LETCOND | 'loop' | 'unsafe' | 'async' 'move' ? | 'const' ) ? ( B.block | B.arms ) ( 'else' ( 'if' LETCOND ) ? B.block ) * )", True)
        self.rules["EXPR"] = f"(?>(?:{self.compile('( PREFIX * ( PATH B.init | BLOCKLIKE | LEAF ) POSTFIX * )')}(?:{binary}|(?!{first})))+{tail}|{empties})"
        self.rule("VIS", "( 'pub' P.vis ? ) ?")
        self.rule("WHERE", "( 'where' ( TYPE ':' TYPE ? ',' ? ) + ) ?")
        self.rule("FN", "( 'const' | 'async' | 'unsafe' | 'extern' 'string' ? ) * 'fn' I P.params ( '->' TYPE ) ? WHERE ( B.block | ';' )")
        self.rule("USETREE", "'::' ? ( SEG '::' ) * ( '*' | SEG ( 'as' I ) ? | B.uses )")
        self.rule("ITEMHEAD", "ATTRS VIS ( FN | 'struct' I ( WHERE B.fields | P.types WHERE ';' | P.params WHERE ';' | ';' ) | 'enum' I WHERE B.enum | 'union' I B.fields | 'unsafe' ? 'trait' I ( ':' TYPE ) ? WHERE B.items | 'unsafe' ? 'impl' '!' ? TYPE ( 'for' TYPE ) ? WHERE B.items | 'mod' I ( B.items | ';' ) | 'use' USETREE ';' | 'extern' 'crate' I ( 'as' I ) ? ';' | 'extern' 'string' ? B.items | 'type' I ( ':' TYPE ) ? ( '=' TYPE ) ? ';' | ( 'const' | 'static' 'mut' ? ) I ':' TYPE ';' | PATH '!' I ? ( P.any ';' | S.any ';' | B.any ) )", True)
        self.rule("VALUE", "VIS ( 'const' | 'static' 'mut' ? ) I ':' TYPE '='")
        self.rule("ITEM", "ITEMHEAD | ATTRS VALUE EXPR ';'", True)
        self.rules["ALONE"] = self.compile("BLOCKLIKE") + r"(?![.?])"
        self.rule("STATEMENT", "';' | ATTRS 'let' PAT ( ':' TYPE ) ? ';' | ITEMHEAD | ATTRS ALONE | ATTRS ( 'let' PAT ( ':' TYPE ) ? '=' | VALUE ) ? EXPR ( 'else' B.block ) ? ';'", True)
        self.role("P", "args", "( EXPR SEP ) *")
        self.rule("SELF", "( '&' LIFE ? ) ? 'mut' ? 'self' ( ':' TYPE ) ?")
        self.rule("PARAM", "ATTRS ( SELF | PAT1 ':' TYPE | TYPE | '...' )")
        self.role("P", "params", "( PARAM SEP ) *")
        self.role("P", "vis", "'crate' | 'super' | 'self' | 'in' PATH")
        self.role("P", "types", "( ATTRS VIS TYPE SEP ) *")
        self.role("P", "pattern", "( PAT SEP ) *")
        self.role("S", "array", "( EXPR SEP ) * | EXPR ';' EXPR")
        self.role("S", "types", "TYPE ( ';' EXPR ) ?")
        self.role("S", "pattern", "( PAT SEP ) *")
        self.role("B", "block", "ATTRS STATEMENT * EXPR ?")
        self.role("B", "fields", "( ATTRS VIS I ':' TYPE SEP ) *")
        self.role("B", "init", "( ( ( I | 'number' ) ( ':' EXPR ) ? | '...' EXPR ) SEP ) *")
        self.role("B", "enum", "( ATTRS I ( P.types | B.fields ) ? ( '=' EXPR ) ? SEP ) *")
        self.role("B", "items", "ATTRS ITEM *")
        self.rule("ARM", "ATTRS PAT ( 'if' LETCOND ) ? '=>'")
        self.role("B", "arms", "( ARM ( B.block ',' ? | EXPR SEP ) ) *")
        self.role("B", "uses", "( USETREE SEP ) *")
        self.role("B", "pattern", "( ( ( 'ref' | 'mut' ) * I ( ':' PAT ) ? | '...' ) SEP ) *")
        for kind in "PSB":
            self.checks[kind].append((1 << self.bit(kind, "any"), re.compile(r"[^\x00]*", re.S)))
        self.checks["S"].append((1 << self.bit("S", "attr"), re.compile(r"[^\x00]+", re.S)))
        self.file = re.compile(self.compile("ATTRS ITEM *"))


class C(Grammar):
    """C."""

    name = "c"
    words_first = False
    keywords = "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool bool"
    special = r"(?<![^\n])[ \t]*\#(?:[^\n\\/]|\\\n|\\.|/(?!\*)|/\*(?:[^*]|\*(?!/))*+\*/)*|" + _C_SPECIAL + r"|[LuU]?'(?:[^'\\\n]|\\.[0-7xa-fA-F]*)+'"
    string_starts = "\"'"

    def classify(self, text: str, table: dict) -> str:
        stripped = text.lstrip(" \t")
        if stripped[:1] == "#":
            return "" if _DIRECTIVE.match(stripped) else ERROR
        return super().classify(text, table)

    def group_roles(self) -> dict[str, str]:
        return {"P": "cond args params type declarator forhead", "S": "size", "B": "block init fields cases enum"}

    def define(self) -> None:
        w = self.words
        self.generic = _NEVER
        self.rules["SEP"] = r"(?:,|(?=\Z))"
        self.rule("WORD", "'char' | 'double' | 'float' | 'int' | 'long' | 'short' | 'signed' | 'unsigned' | 'void' | '_Bool' | 'bool'")
        self.rule("QUAL", "'const' | 'volatile' | 'restrict' | 'static' | 'extern' | 'inline' | 'register' | 'auto' | 'typedef'")
        self.rule("TAGGED", "( 'struct' | 'union' ) ( 'ident' B.fields ? | B.fields ) | 'enum' ( 'ident' B.enum ? | B.enum )")
        self.rule("SPEC", "QUAL * ( WORD ( QUAL | WORD ) * | TAGGED QUAL * | 'ident' QUAL * )", True)
        self.rule("STARS", "( '*' QUAL * ) *")
        self.rule("PRIMARY", "'ident' | 'number' | 'string' + | P.cond | P.type B.init | 'sizeof' P.type")
        self.rule("POSTFIX", "'.' 'ident' | '->' 'ident' | P.args | S.size | '++'")
        self.rule("PREFIX", "'!' | '-' | '&' | '*' | '++' | 'sizeof' | P.type")
        body = self.compile("( PREFIX * PRIMARY POSTFIX * )")
        binary = self.compile("'/' | '-' | '*' | '&' | '|' '|' ? | '<' '<' ? | '>' '>' ? | '=' | '?' | ':'")
        first = "[i0s!" + "".join(w.values()) + "-]"
        plain = binary.replace("|\\?|:", "")
        self.rules["CASEVALUE"] = f"(?>(?:{body}(?:(?:{plain})|(?!{first})))+(?<![b\\-*&|<>=?:]))"
        self.rules["EXPR"] = f"(?>(?:{body}(?:(?:{binary})|(?!{first})))+(?<![b\\-*&|<>=?:]))"
        self.rules["LIST"] = f"(?>(?:{body}(?:(?:{binary})|,|(?!{first})))+(?<![b\\-*&|<>=?:,]))"
        self.rule("NAMED", "STARS ( 'ident' | P.declarator ) ( S.size | P.params ) *")
        self.rules["NEXT"] = r"(?:,|(?=;))"
        self.rule("DECL", "SPEC ( NAMED ( ':' CASEVALUE ) ? ( '=' ( EXPR | B.init ) ) ? NEXT ) * ';'")
        self.rule("TYPENAME", "SPEC STARS ( P.declarator ( S.size | P.params ) * ) ? S.size *")
        self.rule("CORE", "B.block | 'switch' P.cond B.cases | DECL | 'return' ? LIST ';' | ( 'return' | 'break' | 'continue' ) ';' | 'goto' 'ident' ';' | ';'")
        self.rule("HEAD", "'if' P.cond | 'for' P.forhead | 'while' P.cond | 'do' | 'ident' ':'")
        after = "(?<=[;" + self.group_class("B", "block")[1:-1] + "])"
        self.rules["ELSE"] = f"(?:{after}{w['else']})"
        self.rule("STATEMENT", "ELSE ? HEAD * CORE", True)
        self.rule("PARAM", "SPEC STARS ( 'ident' | P.declarator ) ? ( S.size | P.params ) *")
        self.role("P", "args", "( ( LIST | TYPENAME ) SEP ) *")
        self.role("P", "params", "( PARAM SEP ) * '...' ?")
        self.role("P", "cond", "LIST")
        self.role("P", "forhead", "( DECL | LIST ? ';' ) LIST ? ';' LIST ?")
        self.role("P", "type", "TYPENAME")
        self.role("P", "declarator", "STARS 'ident' ? ( S.size | P.params ) *")
        self.role("S", "size", "( 'static' ? EXPR ) ?")
        self.role("B", "block", "STATEMENT *")
        self.role("B", "init", "( ( ( '.' 'ident' | S.size ) + '=' ) ? ( EXPR | B.init ) SEP ) *")
        self.role("B", "fields", "DECL *")
        self.role("B", "enum", "( 'ident' ( '=' EXPR ) ? SEP ) *")
        self.role("B", "cases", "( ( 'case' CASEVALUE ( '...' CASEVALUE ) ? | 'default' ) ':' STATEMENT * ) *")
        self.file = re.compile(self.compile("( SPEC STARS 'ident' P.params B.block | DECL | ';' ) *"))


_DIRECTIVE = re.compile(r"#[ \t]*(?:include|define|undef|ifdef|ifndef|if|elif|else|endif|error|warning|pragma|line|import|include_next)\b|#[ \t]*(?:\n|$)")


_PY_TOKEN = re.compile(
    r"(?P<c>\#[^\n]*)|(?P<s>[rRuUbBfFtT]{0,2}(?:\"{3}(?:[^\"\\]|\\.|\"(?!\"\"))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'))|(?P<j>\\\r?\n)|(?P<n>\r?\n|\r)|(?P<o>[(\[{])|(?P<e>[)\]}])|(?P<w>\w+)|(?P<x>.)", re.S
)
#: Levels of brackets and blocks that are left to the parser at once.
PY_LEVELS = 30


def _parses(code: str, mode: str = "exec") -> bool | None:
    """Does Python's parser take a text? None where the text is beyond its limits."""
    if mode == "exec":
        try:  # the parse and the check of scopes, without a tree to hand over
            symtable.symtable(code, "<file>", mode)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass  # a wrong text, or one that is right but for its scopes
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(code, "<file>", mode, ast.PyCF_ONLY_AST, dont_inherit=True)
        return True
    except RecursionError:
        return True  # the parse was done, only its tree is too deep to hand over
    except MemoryError:
        return None
    except SyntaxError as e:
        return None if "too many levels of indentation" in str(e) or "too many nested parentheses" in str(e) else False
    except ValueError:
        return False  # null bytes, surrogates


def _deep_lines(text: str) -> list[tuple[int, str]] | None:
    """The logical lines (indentation, code) of a text, with deep bracket groups checked and cut down; None if one is wrong."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, list[str]]] = []
    frame: list[str] = []
    for m in _PY_TOKEN.finditer(text):
        kind, piece = m.lastgroup, m[0]
        if kind == "c" or (kind in "jn" and stack):
            frame.append(" ")
        elif kind == "n":
            line = "".join(frame)
            if line.strip():
                out.append((len(line) - len(line.lstrip(" \t\f")), line.strip()))
            frame = []
        elif kind == "o":
            stack.append((piece, frame))
            frame = []
        elif kind == "e":
            if not stack or stack[-1][0] + piece not in ("()", "[]", "{}"):
                return None
            group = stack[-1][0] + "".join(frame) + piece
            if len(stack) > PY_LEVELS and "".join(frame).strip():
                if _parses(group, "eval"):
                    group = stack[-1][0] + "_" + piece
                elif piece != "}" and _parses("_" + group, "eval"):
                    group = "(*_)" if piece == ")" else "[_:_]"
                else:
                    return None
            frame = stack.pop()[1]
            frame.append(group)
        else:
            frame.append(" " if kind == "j" else piece)
    if stack:
        return None
    line = "".join(frame)
    return out + [(len(line) - len(line.lstrip(" \t\f")), line.strip())] if line.strip() else out


def _parses_deep(text: str) -> bool | None:
    """Like ``_parses`` for texts nested beyond the parser's limits: deep groups and blocks are checked from the inside and cut down."""
    lines = _deep_lines(text)
    if lines is None:
        return False
    levels, done = [0], [[]]
    for width, code in [*lines, (0, "pass")]:
        while width < levels[-1]:
            block = done.pop()
            levels.pop()
            if len(levels) >= PY_LEVELS:
                body = "\n".join(block)
                if not (_parses("if _:\n" + body) or _parses("match _:\n" + body)):
                    return False
                done[-1].append("".join((" " * len(levels), "pass")))
            else:
                done[-1] += block
        if width > levels[-1]:
            levels.append(width)
            done.append([])
        elif width != levels[-1]:
            return False
        done[-1].append(" " * (len(levels) - 1) + code)
    return _parses("\n".join(done[0]) + "\n")


class Python:
    """Python, by the language's own parser; None for texts beyond its limits even when cut down."""

    name = "python"

    def valid(self, text: str) -> bool | None:
        found = _parses(text)
        return _parses_deep(text) if found is None else found

    def plausible(self, text: str, first: int) -> bool:
        return True


_CLASSES = {c.name: c for c in (Python, Script, TypeScript, Java, Go, Rust, C)}
_READY: dict[str, object] = {}
LANGUAGES = tuple(_CLASSES)
ALIASES = {"js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "golang": "go", "rs": "rust", "h": "c"}


def grammar(language: str | None):
    """The grammar of a language name in any case; None for other languages."""
    name = (language or "").strip().lower()
    name = ALIASES.get(name, name)
    if name not in _READY and name in _CLASSES:
        _READY[name] = _CLASSES[name]()
    return _READY.get(name)
