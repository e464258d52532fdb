"""A frontend for a core of COBOL: data items with values, arithmetic, moves, conditions, paragraphs and PERFORM.

A paragraph ends with RESUME_CONTINUATION of its own name; PERFORM sets that continuation and branches, so
falling through and performing are the same code. Numbers keep their values, text moves are cut or padded to
the receiving picture.
"""

from __future__ import annotations

import re

from sparkloom.frontends.python_ast import Lowering
from sparkloom.functions.pictures import parse_picture

TOKEN = re.compile(r"""'[^']*'|"[^"]*"|\d+\.\d+|\d+|[A-Za-z][\w-]*|\*\*|<=|>=|<>|[-+*/=<>().,]""")
VERBS = {"MOVE", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "COMPUTE", "IF", "PERFORM", "DISPLAY", "STOP", "GOBACK", "GO", "EVALUATE", "CONTINUE", "EXIT", "INITIALIZE", "SET", "END-IF", "ELSE", "END-PERFORM", "WHEN", "END-EVALUATE", "END-COMPUTE", "END-ADD"}
LEVELS = {"OR": 1, "AND": 2, "=": 3, "<>": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "**": 6}


class Parser:
    def __init__(self, source: str):
        lines = [x[6:] if re.match(r"^[\d ]{6}", x) else x for x in source.splitlines()]
        text = "\n".join(x for x in lines if not re.match(r"^\s?[*/]", x))
        data, _, code = re.split(r"(?i)(PROCEDURE\s+DIVISION[^.]*\.)", text + "\nPROCEDURE DIVISION.", maxsplit=1)[:3]
        code = re.split(r"(?i)\nPROCEDURE DIVISION\.$", code)[0]
        self.out, self.at = Lowering(), 0
        self.fields: dict[str, dict] = {}
        for m in re.finditer(r"(?im)^\s*(\d\d)\s+([\w-]+)(?:\s+PIC(?:TURE)?\s+(?:IS\s+)?([^\s.]+(?:\.\d[^\s.]*)?))?(?:[^.]*?\bVALUE\s+(?:IS\s+)?('[^']*'|[-+]?[\d.]*\d|ZEROS?|SPACES?))?[^.]*\.", data):
            if m[3]:
                self.fields[m[2].upper()] = pic = parse_picture(m[3])
                v = m[4] or ""
                value = v[1:-1] if v[:1] == "'" else None
                if value is None:
                    value = (float(v) if "." in v else int(v)) if re.match(r"^[-+]?[\d.]+$", v) else 0 if pic["kind"] != "alphanumeric" else ""
                self.out.emit("DECL_VAR", m[2].upper(), self.out.const(value.ljust(pic["size"]) if isinstance(value, str) else value))
        self.tokens = [t if t[0] in "'\"" else t.upper() for t in TOKEN.findall(code)]
        self.names = {self.tokens[i] for i in range(len(self.tokens) - 1) if self.tokens[i + 1] == "." and self.tokens[i] not in VERBS and (i == 0 or self.tokens[i - 1] == ".") and re.match(r"[A-Z]", self.tokens[i])}

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""

    def eat(self, *words: str) -> bool:
        if self.peek() in words:
            self.at += 1
            return True
        return False

    def program(self) -> list[tuple]:
        o, open_ = self.out, ""
        while self.peek():
            if self.peek() in self.names and self.peek(1) == ".":
                if open_:
                    o.emit("RESUME_CONTINUATION", open_)
                open_ = self.take()
                o.label(f"para_{open_}")
                self.eat(".")
            elif not self.eat("."):
                self.statement()
        if open_:
            o.emit("RESUME_CONTINUATION", open_)
        return o.code

    def body(self, *ends: str) -> None:
        while self.peek() and self.peek() not in (*ends, "."):
            self.statement()

    # values
    def operand(self) -> str:
        t, o = self.take(), self.out
        if t == "(":
            v = self.expression()
            self.eat(")")
            return v
        if t == "-":
            return o.emit("UNOP", "-", self.operand(), result=True)
        if t[:1] in "'\"":
            return o.const(t[1:-1])
        if re.match(r"^\d", t):
            return o.const(float(t) if "." in t else int(t))
        if t in ("ZERO", "ZEROS", "ZEROES"):
            return o.const(0)
        if t in ("SPACE", "SPACES"):
            return o.const("")
        if t == "FUNCTION":
            name, args = self.take(), []
            if self.eat("("):
                while self.peek() and not self.eat(")"):
                    args.append(self.expression())
                    self.eat(",")
            return o.emit("CALL_FUNCTION", name.lower(), *args, result=True)
        return o.emit("LOAD_VAR", t, result=True)

    def expression(self, least: int = 4) -> str:
        left = self.operand()
        while self.peek() in LEVELS and LEVELS[self.peek()] >= least:
            op = self.take()
            left = self.out.emit("BINOP", op, left, self.expression(LEVELS[op] + 1), result=True)
        return left

    def condition(self, least: int = 1) -> str:
        o = self.out
        if self.eat("NOT"):
            return o.emit("UNOP", "not", self.condition(3), result=True)
        if self.peek() == "(":
            self.take()
            left = self.condition()
            self.eat(")")
        else:
            left = self.relation()
        while self.peek() in ("AND", "OR") and LEVELS[self.peek()] >= least:
            op = self.take()
            left = o.emit("BINOP", op.lower(), left, self.condition(LEVELS[op] + 1), result=True)
        return left

    def relation(self) -> str:
        o, left = self.out, self.expression()
        self.eat("IS")
        no = self.eat("NOT")
        words = {"GREATER": ">", "LESS": "<", "EQUAL": "==", "=": "==", "<>": "!="}
        if self.peek() in ("NUMERIC", "POSITIVE", "NEGATIVE"):
            kind = self.take()
            got = o.emit("BINOP", ">" if kind == "POSITIVE" else "<", left, o.const(0), result=True)
        else:
            op = self.take()
            op = words.get(op, op)
            self.eat("THAN", "TO")
            if self.eat("OR"):
                self.eat("EQUAL", "=")
                self.eat("TO")
                op += "="
            right = self.expression()
            got = o.emit("BINOP", op, left, right, result=True)
        return o.emit("UNOP", "not", got, result=True) if no else got

    def store(self, name: str, value: str) -> None:
        pic = self.fields.get(name)
        if pic and pic["kind"] == "alphanumeric":
            value = self.out.emit("CALL_FUNCTION", "__fit", value, self.out.const(pic["size"]), result=True)
        elif pic:
            value = self.out.emit("CALL_FUNCTION", "__cut", value, self.out.const(pic["digits"] - pic["decimals"]), self.out.const(pic["decimals"]), result=True)
        self.out.emit("STORE_VAR", name, value)

    def targets(self) -> list[str]:
        names = []
        while self.peek() and self.peek() not in VERBS and self.peek() not in (".", "GIVING", "ON", "ROUNDED", "REMAINDER"):
            t = self.take()
            if t != ",":
                names.append(t)
        self.eat("ROUNDED")
        return names

    # statements
    def statement(self) -> None:
        o, verb = self.out, self.take()
        if verb == "MOVE":
            v = self.operand()
            self.eat("TO")
            for n in self.targets():
                self.store(n, v)
        elif verb in ("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE"):
            self.arithmetic(verb)
        elif verb == "COMPUTE":
            n = self.take()
            self.eat("ROUNDED")
            self.eat("=")
            self.store(n, self.expression())
        elif verb == "IF":
            yes, no, end = o.fresh("if_true"), o.fresh("if_false"), o.fresh("if_end")
            o.emit("BRANCH_IF", self.condition(), targets=[yes, no])
            self.eat("THEN")
            o.label(yes)
            self.body("ELSE", "END-IF")
            o.emit("BRANCH", targets=[end])
            o.label(no)
            if self.eat("ELSE"):
                self.body("END-IF")
            self.eat("END-IF")
            o.label(end)
        elif verb == "EVALUATE":
            self.evaluate()
        elif verb == "PERFORM":
            self.perform()
        elif verb == "DISPLAY":
            args = []
            while self.peek() and self.peek() not in VERBS and self.peek() != ".":
                args.append(self.operand())
            o.emit("CALL_FUNCTION", "print", *args, result=True)
        elif verb in ("STOP", "GOBACK"):
            self.eat("RUN")
            o.emit("HALT")
        elif verb == "GO":
            self.eat("TO")
            o.emit("BRANCH", targets=[f"para_{self.take()}"])
        elif verb == "INITIALIZE":
            for n in self.targets():
                o.emit("STORE_VAR", n, o.const(0 if self.fields.get(n, {}).get("kind") != "alphanumeric" else " " * self.fields[n]["size"]))
        elif verb == "SET":
            names = [self.take()]
            self.eat("TO")
            self.store(names[0], self.expression())
        elif verb not in ("CONTINUE", "EXIT", ".", "END-COMPUTE", "END-ADD"):
            o.emit("SYMBOLIC", f"unsupported:{verb}", result=True)

    def arithmetic(self, verb: str) -> None:
        o, first = self.out, [self.expression()]
        while self.peek() not in ("TO", "FROM", "BY", "INTO", "GIVING", "."):
            first.append(self.expression())
        word = self.take()
        total = first[0]
        for x in first[1:]:
            total = o.emit("BINOP", "+", total, x, result=True)
        sign = {"ADD": "+", "SUBTRACT": "-", "MULTIPLY": "*", "DIVIDE": "/"}[verb]
        if word == "GIVING":
            for n in self.targets():
                self.store(n, total)
            return
        start = self.at
        right = self.operand()
        if self.eat("GIVING"):
            a, b = (total, right) if verb == "DIVIDE" and word == "BY" else (right, total)
            value = o.emit("BINOP", sign, a, b, result=True)
            for n in self.targets():
                self.store(n, value)
            if self.eat("REMAINDER"):
                self.store(self.take(), o.emit("BINOP", "%", a, b, result=True))
            return
        self.at = start
        for n in self.targets():
            self.store(n, o.emit("BINOP", sign, o.emit("LOAD_VAR", n, result=True), total, result=True))

    def evaluate(self) -> None:
        o, end = self.out, self.out.fresh("evaluate_end")
        subject = None if self.eat("TRUE") else self.expression()
        while self.eat("WHEN"):
            yes, no = o.fresh("when_true"), o.fresh("when_next")
            if self.eat("OTHER"):
                o.emit("BRANCH", targets=[yes])
            else:
                test = self.condition() if subject is None else o.emit("BINOP", "==", subject, self.expression(), result=True)
                if subject is not None and self.eat("THRU", "THROUGH"):
                    low = self.out.code[-1][2][2]
                    test = o.emit("BINOP", "and", o.emit("BINOP", ">=", subject, low, result=True), o.emit("BINOP", "<=", subject, self.expression(), result=True), result=True)
                o.emit("BRANCH_IF", test, targets=[yes, no])
            o.label(yes)
            self.body("WHEN", "END-EVALUATE")
            o.emit("BRANCH", targets=[end])
            o.label(no)
        self.eat("END-EVALUATE")
        o.label(end)

    def call(self, name: str, last: str) -> None:
        back = self.out.fresh("perform_end")
        self.out.emit("SET_CONTINUATION", last, back)
        self.out.emit("BRANCH", targets=[f"para_{name}"])
        self.out.label(back)

    def perform(self) -> None:
        o = self.out
        name = self.take() if self.peek() in self.names else ""
        last = name
        if name and self.eat("THRU", "THROUGH"):
            last = self.take()
        top, body, end = o.fresh("perform_cond"), o.fresh("perform_body"), o.fresh("perform_end")
        step = None
        counted = re.match(r"^\d+$", self.peek()) or self.peek(1) == "TIMES"
        test_after = bool(self.eat("WITH")) and False
        if self.eat("TEST"):
            test_after = self.take() == "AFTER"
        if counted:
            n, k = self.operand(), o.fresh("$times")
            self.eat("TIMES")
            o.emit("DECL_VAR", k, n)
            load = lambda: o.emit("LOAD_VAR", k, result=True)
            o.label(top)
            o.emit("BRANCH_IF", o.emit("BINOP", ">", load(), o.const(0), result=True), targets=[body, end])
            step = lambda: o.emit("STORE_VAR", k, o.emit("BINOP", "-", load(), o.const(1), result=True))
        elif self.peek() in ("UNTIL", "VARYING"):
            if self.eat("VARYING"):
                var = self.take()
                self.eat("FROM")
                o.emit("STORE_VAR", var, self.operand())
                self.eat("BY")
                by = self.operand()
                step = lambda: o.emit("STORE_VAR", var, o.emit("BINOP", "+", o.emit("LOAD_VAR", var, result=True), by, result=True))
            if test_after:
                o.emit("BRANCH", targets=[body])
            o.label(top)
            self.eat("UNTIL")
            o.emit("BRANCH_IF", self.condition(), targets=[end, body])
        else:
            if name:
                self.call(name, last)
            else:
                self.body("END-PERFORM")
                self.eat("END-PERFORM")
            return
        o.label(body)
        if name:
            self.call(name, last)
        else:
            self.body("END-PERFORM")
            self.eat("END-PERFORM")
        if step:
            step()
        o.emit("BRANCH", targets=[top])
        o.label(end)


def lower(source: str) -> list[tuple]:
    return Parser(source).program()
