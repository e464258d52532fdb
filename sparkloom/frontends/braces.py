"""A frontend for the common core of languages with braces, and of those whose blocks end with ``end``.

One tokenizer and one precedence parser serve JavaScript, TypeScript, Java, C, C++, C#, Go, Rust, Kotlin,
Scala and PHP, and, with words in place of braces, Lua, Ruby and Pascal. The core is functions, variables,
assignment, if, while, for, return, calls, indexing, fields, literals and operators; what lies
outside it becomes ``SYMBOLIC "unsupported:<token>"`` and the parser goes on behind it.
"""

from __future__ import annotations

import re

from sparkloom.frontends.python_ast import Lowering
from sparkloom.vm.machine import Func

BRACES = ("javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust", "kotlin", "scala", "php")
WORDS = ("lua", "ruby", "pascal")
TOKEN = re.compile(r"""(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?\*/|<\?php|\?>)|(?P<number>\d+\.\d+|\d+)[fFuUlL]*|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>\$?[A-Za-z_]\w*)|(?P<op>===|!==|<=>|\.\.|:=|->|=>|::|\*\*|<<|>>|==|!=|~=|<=|>=|<>|&&|\|\||\+\+|--|[-+*/%&|^.]=|[-+*/%<>=!&|^~?:;,.(){}\[\]\#@])""", re.S)
LEVELS = {"or": 1, "||": 1, "??": 1, "and": 2, "&&": 2, "==": 3, "===": 3, "!=": 3, "!==": 3, "~=": 3, "<>": 3, "<": 4, ">": 4, "<=": 4, ">=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "..": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "mod": 11, "div": 11, "**": 12}
SAME = {"===": "==", "!==": "!=", "<>": "!=", "div": "//", "mod": "%", "||": "or", "&&": "and"}
DECLARE = {"let", "var", "const", "val", "local", "mut"}
DEFINE = {"function", "func", "fn", "fun", "def", "procedure"}
TYPES = {"int", "long", "float", "double", "bool", "boolean", "string", "String", "void", "char", "auto", "object", "short", "unsigned"}
SKIP = {"public", "private", "protected", "static", "final", "export", "pub", "async", "inline", "open", "override", "internal"}


class Parser:
    def __init__(self, source: str, language: str):
        self.language, self.out, self.at = language, Lowering(), 0
        if language in ("lua",):
            source = re.sub(r"--[^\n]*", "", source)
        if language in ("ruby",):
            source = re.sub(r"#[^\n]*", "", source)
        if language == "pascal":
            source = re.sub(r"\{.*?\}|\(\*.*?\*\)", "", source, flags=re.S)
        self.tokens: list[tuple[str, str]] = []
        depth = 0
        for m in TOKEN.finditer(source):
            kind, text = m.lastgroup, m[0]
            if kind == "line" and depth:
                continue
            if kind in ("space", "comment"):
                continue
            depth += (text in "([") - (text in ")]") if kind == "op" else 0
            self.tokens.append((kind, m["number"] if kind == "number" else text))
        self.tokens.append(("end", ""))
        self.word = language in WORDS
        self.closers = {"end", "else", "elseif", "elsif", "until"} if self.word else {"}"}
        self.result = ""

    # tokens
    def peek(self, k: int = 0) -> str:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)][1]

    def kind(self, k: int = 0) -> str:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)][0]

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def eat(self, *texts: str) -> bool:
        if self.peek() in texts and self.kind() != "string":
            self.at += 1
            return True
        return False

    def lines(self) -> None:
        while self.kind() == "line" or self.peek() == ";":
            self.at += 1

    def name(self) -> str:
        return self.take().lstrip("$")

    # blocks and statements
    def program(self) -> list[tuple]:
        while self.kind() != "end":
            before = self.at
            self.statement()
            self.lines()
            if self.at == before:
                self.unsupported()
        return self.out.code

    def unsupported(self) -> str:
        return self.out.emit("SYMBOLIC", f"unsupported:{self.take() or self.kind()}", result=True)

    def block(self) -> None:
        """Statements up to the block's end; a lone statement where there is no opening."""
        self.lines()
        opened = self.eat("{") or self.eat("begin") or (self.word and self.language != "pascal")
        if self.word and self.language != "pascal":
            self.eat("do", "then")
        if not opened:
            self.statement()
            return
        self.lines()
        while self.kind() != "end" and not (self.peek() in self.closers and self.kind() in ("name", "op")):
            before = self.at
            self.statement()
            self.lines()
            if self.at == before:
                self.unsupported()
        if not self.word:
            self.eat("}")
        elif self.language == "pascal":
            self.eat("end")

    def statement(self) -> None:
        self.lines()
        while self.peek() in SKIP:
            self.take()
        t, kind = self.peek(), self.kind()
        if kind == "end":
            return
        if t in ("package", "namespace", "program", "use", "using", "import") or t == "#":
            while self.kind() not in ("line", "end") and self.peek() != ";":
                self.take()
        elif t in DEFINE and kind == "name":
            self.definition()
        elif t == "if":
            self.branch()
        elif t in ("while", "loop"):
            self.loop()
        elif t == "for":
            self.for_()
        elif t in ("return", "exit", "Exit"):
            self.take()
            empty = self.kind() in ("line", "end") or self.peek() in (";", "}", "end")
            self.out.emit("RETURN", self.out.const(None) if empty else self.expression())
        elif t == "break" and self.out.loops:
            self.take()
            self.out.s_Break(None)
        elif t == "continue" and self.out.loops:
            self.take()
            self.out.s_Continue(None)
        elif t in ("{", "begin"):
            self.block()
        elif t in DECLARE and self.language == "pascal":
            self.take()
            while self.kind() in ("name", "line") and self.peek() not in (*DEFINE, "begin"):
                while self.kind() not in ("line", "end") and self.peek() != ";":
                    self.take()
                self.lines()
        elif t in DECLARE:
            self.take()
            self.eat("mut")
            self.declaration()
        elif kind == "name" and self.kind(1) == "name" and self.peek(1) not in ("do", "then", "and", "or", "mod", "div", "end"):
            self.take()  # a type
            while t in TYPES and self.peek() in TYPES:
                self.take()
            if self.peek(1) == "(":
                self.definition(typed=True)
            else:
                self.declaration()
        else:
            self.simple()
        self.eat(";", ".") if self.language == "pascal" else self.eat(";")

    def declaration(self) -> None:
        name = self.name()
        if self.eat(":"):
            self.type_()
        self.out.emit("DECL_VAR", name, self.expression() if self.eat("=", ":=") else self.out.const(None))
        while self.eat(","):
            self.declaration()

    def type_(self) -> None:
        self.take()
        while self.peek() in ("[", "]", "<", ">", "?", "&", "*") and self.kind() == "op":
            self.take()

    def definition(self, typed: bool = False) -> None:
        if not typed:
            self.take()
        name, params = self.name(), []
        if self.eat("("):
            while not self.eat(")"):
                words = []
                while self.peek() not in (",", ")", ";") and self.kind() != "end":
                    words.append(self.take())
                self.eat(",", ";")
                words = [w for w in words if w not in ("mut", "var", "const", "final", "val", "&", "*")]
                if ":" in words:
                    params += [w.lstrip("$") for w in words[: words.index(":")]]
                elif words:
                    first = self.language == "go" or words[0].startswith("$") or len(words) == 1
                    params.append((words[0] if first else words[-1]).lstrip("$"))
        while self.peek() not in ("{", "=", "begin", "var") and self.kind() not in ("line", "end") and not (self.word and self.language != "pascal"):
            self.take()  # the result's type
        self.eat("=")
        o = self.out
        label, end = o.fresh(f"func_{name}"), o.fresh(f"end_{name}")
        o.emit("BRANCH", targets=[end])
        o.label(label)
        for p in params:
            o.emit("DECL_VAR", p, o.emit("SYMBOLIC", f"param:{p}", result=True))
        loops, o.loops = o.loops, []
        outer, self.result = self.result, ""
        if self.language == "pascal":
            o.emit("DECL_VAR", name, o.const(None))
            self.lines()
            while self.peek() == "var":
                self.statement()
                self.lines()
        self.last = ""
        self.block()
        if self.word and self.language != "pascal":
            self.eat("end")
        if self.language == "pascal":
            self.last = o.emit("LOAD_VAR", name, result=True)
        keep = self.last if self.language in ("ruby", "rust", "scala", "pascal") and self.last else o.const(None)
        o.emit("RETURN", keep)
        self.result, o.loops = outer, loops
        o.label(end)
        o.emit("DECL_VAR", name, o.const(Func(label)))

    def condition(self) -> str:
        return self.expression()

    def branch(self) -> None:
        self.take()
        o = self.out
        yes, no, end = o.fresh("if_true"), o.fresh("if_false"), o.fresh("if_end")
        o.emit("BRANCH_IF", self.condition(), targets=[yes, no])
        self.eat("then")
        o.label(yes)
        self.block()
        o.emit("BRANCH", targets=[end])
        o.label(no)
        at = self.at
        self.lines()
        if self.eat("elseif", "elsif"):
            self.at -= 1
            self.branch_again()
        elif self.eat("else"):
            if self.peek() == "if" and not self.word:
                self.branch()
            else:
                self.block()
            if self.word and self.language != "pascal":
                self.eat("end")
        elif self.word and self.language != "pascal":
            self.eat("end")
        else:
            self.at = at
        o.label(end)

    def branch_again(self) -> None:
        self.branch()

    def loop(self) -> None:
        forever = self.take() == "loop"
        o = self.out
        top, body, end = o.fresh("while_cond"), o.fresh("while_body"), o.fresh("while_end")
        o.label(top)
        if not forever:
            o.emit("BRANCH_IF", self.condition(), targets=[body, end])
        self.eat("do")
        o.label(body)
        o.loops.append((top, end))
        self.block()
        o.loops.pop()
        if self.word and self.language != "pascal":
            self.eat("end")
        o.emit("BRANCH", targets=[top])
        o.label(end)

    def for_(self) -> None:
        """C's three parts, a bare condition (Go), or a numeric range (Lua, Pascal)."""
        self.take()
        o = self.out
        top, body, step, end = o.fresh("for_cond"), o.fresh("for_body"), o.fresh("for_step"), o.fresh("for_end")
        load = lambda n: o.emit("LOAD_VAR", n, result=True)
        if self.word:
            name = self.name()
            self.eat("=", ":=")
            o.emit("DECL_VAR", name, self.expression())
            self.eat(",", "to")
            o.emit("DECL_VAR", limit := o.fresh("$limit"), self.expression())
            self.eat("do")
            o.label(top)
            o.emit("BRANCH_IF", o.emit("BINOP", "<=", load(name), load(limit), result=True), targets=[body, end])
            o.label(body)
            o.loops.append((step, end))
            self.block()
            o.loops.pop()
            if self.language != "pascal":
                self.eat("end")
            o.label(step)
            o.emit("STORE_VAR", name, o.emit("BINOP", "+", load(name), o.const(1), result=True))
            o.emit("BRANCH", targets=[top])
            o.label(end)
            return
        paren = self.eat("(")
        three = paren or ";" in [t for _, t in self.tokens[self.at : self.at + 40]][: next((i for i, (_, t) in enumerate(self.tokens[self.at :]) if t == "{"), 40)]
        if three:
            if self.peek() != ";":
                self.header()
            self.eat(";")
        o.label(top)
        o.emit("BRANCH_IF", o.const(True) if self.peek() in (";", "{") else self.expression(), targets=[body, end])
        self.eat(";")
        after = self.at  # the step is read after the body
        depth = 0
        while self.kind() != "end" and not (self.peek() == ")" and depth == 0 if paren else self.peek() == "{"):
            depth += (self.peek() == "(") - (self.peek() == ")")
            self.take()
        if paren:
            self.eat(")")
        o.label(body)
        o.loops.append((step, end))
        self.block()
        o.loops.pop()
        back, self.at = self.at, after
        o.label(step)
        if self.peek() not in (")", "{"):
            self.simple()
        self.at = back
        o.emit("BRANCH", targets=[top])
        o.label(end)

    def header(self) -> None:
        if self.peek() in DECLARE:
            self.take()
            self.declaration()
        elif self.kind() == "name" and self.kind(1) == "name":
            self.take()
            self.declaration()
        else:
            self.simple()

    def simple(self) -> None:
        """An assignment or an expression."""
        o, start = self.out, len(self.out.code)
        target = self.expression()
        place = o.code[-1] if len(o.code) > start else None
        t = self.peek()
        if t in ("=", ":=") or (len(t) == 2 and t[1] == "=" and t[0] in "+-*/%&|^."):
            self.take()
            value = self.expression()
            if t not in ("=", ":="):
                value = o.emit("BINOP", ".." if t[0] == "." else t[0], target, value, result=True)
            self.store(place, value)
        elif t in ("++", "--"):
            self.take()
            self.store(place, o.emit("BINOP", t[0], target, o.const(1), result=True))
        self.last = target

    def store(self, place, value: str) -> None:
        o = self.out
        if place and place[0] == "LOAD_VAR":
            o.emit("STORE_VAR", place[2][0], value)
        elif place and place[0] == "LOAD_FIELD":
            o.emit("STORE_FIELD", place[2][0], place[2][1], value)
        elif place and place[0] == "LOAD_INDEX":
            o.emit("STORE_INDEX", place[2][0], place[2][1], value)

    # expressions
    def expression(self, least: int = 1) -> str:
        left = self.prefix()
        while self.peek() in LEVELS and self.kind() in ("op", "name") and LEVELS[self.peek()] >= least:
            op = self.take()
            while self.kind() == "line":
                self.at += 1
            right = self.expression(LEVELS[op] + (op != "**"))
            name = SAME.get(op, op)
            if op == "/" and self.language in ("java", "c", "cpp", "csharp", "go", "rust", "kotlin", "scala"):
                name = "//"  # whole numbers; of negative ones see the README
            left = self.out.emit("BINOP", name, left, right, result=True)
        if least == 1 and self.peek() == "?" and self.kind() == "op":
            o, name = self.out, self.out.fresh("$if")
            yes, no, end = o.fresh("ternary_true"), o.fresh("ternary_false"), o.fresh("ternary_end")
            self.take()
            o.emit("BRANCH_IF", left, targets=[yes, no])
            o.label(yes)
            o.emit("DECL_VAR", name, self.expression())
            self.eat(":")
            o.emit("BRANCH", targets=[end])
            o.label(no)
            o.emit("DECL_VAR", name, self.expression())
            o.label(end)
            return o.emit("LOAD_VAR", name, result=True)
        return left

    def prefix(self) -> str:
        t, kind, o = self.peek(), self.kind(), self.out
        if kind == "op" and t in ("-", "!", "~", "+", "#") or kind == "name" and t == "not":
            self.take()
            return o.emit("UNOP", "not" if t == "!" else t, self.expression(12), result=True)
        return self.postfix(self.primary())

    def primary(self) -> str:
        t, kind, o = self.peek(), self.kind(), self.out
        if kind == "number":
            self.take()
            return o.const(float(t) if "." in t else int(t))
        if kind == "string":
            self.take()
            return o.const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1]))
        if kind == "name":
            known = {"true": True, "false": False, "True": True, "False": False, "null": None, "nil": None, "None": None, "undefined": None}
            if t in known:
                self.take()
                return o.const(known[t])
            if t == "new":
                self.take()
                return self.primary()
            return o.emit("LOAD_VAR", self.name(), result=True)
        if self.eat("("):
            value = self.expression()
            self.eat(")")
            return value
        if self.eat("["):
            out, i = o.emit("NEW_ARRAY", "Array", result=True), 0
            while not self.eat("]") and self.kind() != "end":
                o.emit("STORE_INDEX", out, o.const(i), self.expression())
                i += 1
                self.eat(",")
            return out
        return self.unsupported()

    def arguments(self) -> list[str]:
        out = []
        while not self.eat(")") and self.kind() != "end":
            out.append(self.expression())
            self.eat(",")
        return out

    def postfix(self, value: str) -> str:
        o = self.out
        while self.kind() == "op":
            if self.peek() == "(":
                self.take()
                callee = o.code[-1]
                if callee[0] == "LOAD_VAR" and callee[1] == value:
                    o.code.pop()
                    value = o.emit("CALL_FUNCTION", callee[2][0], *self.arguments(), result=True)
                elif callee[0] == "LOAD_FIELD" and callee[1] == value:
                    o.code.pop()
                    value = o.emit("CALL_METHOD", callee[2][0], callee[2][1], *self.arguments(), result=True)
                else:
                    value = o.emit("CALL_UNKNOWN", value, *self.arguments(), result=True)
            elif self.peek() == "[":
                self.take()
                value = o.emit("LOAD_INDEX", value, self.expression(), result=True)
                self.eat("]")
            elif self.peek() in (".", "->") and self.kind(1) == "name" and not (self.language == "php" and self.peek() == "."):
                self.take()
                value = o.emit("LOAD_FIELD", value, self.name(), result=True)
            else:
                break
        return value


def lower(source: str, language: str) -> list[tuple]:
    """Rows (opcode, result_reg, operands, label, branch_targets) of a program in one of the languages above."""
    return Parser(source, language).program()
