"""Frontends: source text to the instruction model."""

from __future__ import annotations

LANGUAGES = ("python", "javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust", "kotlin", "scala", "php", "lua", "ruby", "pascal", "cobol")


def lower(source: str, language: str) -> list[tuple]:
    """Rows (opcode, result_reg, operands, label, branch_targets) of a program; an unknown for what cannot be read."""
    if language == "python":
        from sparkloom.frontends.python_ast import lower as python

        try:
            return python(source)
        except SyntaxError:
            return [("LABEL", "", [], "entry", []), ("SYMBOLIC", "%0", ["unsupported:syntax"], "", [])]
    if language == "cobol":
        from sparkloom.frontends.cobol import lower as cobol

        return cobol(source)
    if language in LANGUAGES:
        from sparkloom.frontends.braces import lower as braces

        return braces(source, language)
    return [("LABEL", "", [], "entry", []), ("SYMBOLIC", "%0", [f"unsupported:{language}"], "", [])]
