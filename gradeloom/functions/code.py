"""Checks of candidate code by its syntax tree. Nothing is executed here."""

from __future__ import annotations

import ast
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from gradeloom.functions.words import of_distinct

# Calls and modules that candidate code must not use.
UNSAFE_CALLS = frozenset([
    "eval",
    "exec",
    "compile",
    "__import__",
    "os.system",
    "os.popen",
    "subprocess.run",
    "subprocess.call",
    "subprocess.Popen",
    "shutil.rmtree",
])
UNSAFE_MODULES = frozenset([
    "socket",
    "requests",
    "urllib",
    "http",
    "ftplib",
    "ctypes",
])


def called(node: ast.Call) -> str:
    parts, f = [], node.func
    while isinstance(f, ast.Attribute):
        parts.append(f.attr)
        f = f.value
    return ".".join([f.id if isinstance(f, ast.Name) else "?", *reversed(parts)])


def modules(tree: ast.AST) -> list[str]:
    found: dict[str, None] = {}
    for n in ast.walk(tree):
        names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) and not n.level else []
        found.update(dict.fromkeys(x.split(".")[0] for x in names if x))
    return list(found)


def signature(text: str | None) -> tuple[str, list[str]] | None:
    """Name and arguments of the function that a signature line declares."""
    if not text or not (m := re.search(r"def\s+\w+\s*\(.*", text, re.S)):
        return None
    head = m.group(0).rstrip().rstrip(":")
    try:
        node = ast.parse(f"{head}:\n    pass").body[0]
    except SyntaxError:
        return None
    return (node.name, [a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]]) if isinstance(node, ast.FunctionDef) else None


def preflight(code: str | None, wanted: str | None = None) -> list[str]:
    """What stands against running a piece of code, in order; empty if nothing does."""
    code = code or ""
    if not code.strip():
        return ["EMPTY_CODE"]
    if "```" in code or re.match(r"\s*(here is|sure|the following)\b", code, re.I):
        return ["WRAPPED_IN_TEXT"]
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError) as e:
        return [f"SYNTAX_ERROR:{getattr(e, 'lineno', 0) or 0}"]
    out = []
    target = signature(wanted)
    if target:
        own = next((n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == target[0]), None)
        if own is None:
            out.append("TARGET_FUNCTION_MISSING")
        elif [a.arg for a in [*own.args.posonlyargs, *own.args.args, *own.args.kwonlyargs]] != target[1]:
            out.append("SIGNATURE_MISMATCH")
    out += [f"UNSAFE_CALL:{c}" for c in dict.fromkeys(called(n) for n in ast.walk(tree) if isinstance(n, ast.Call)) if c in UNSAFE_CALLS]
    return out + [f"UNSAFE_IMPORT:{m}" for m in modules(tree) if m in UNSAFE_MODULES]


def path_class(path: str | None) -> str:
    """safe, or why a path isn't: empty, absolute, home, drive, parent."""
    p = (path or "").strip().replace("\\", "/")
    if not p:
        return "empty"
    if p.startswith("/"):
        return "absolute"
    if p.startswith("~"):
        return "home"
    if re.match(r"[A-Za-z]:", p):
        return "drive"
    depth = 0
    for part in p.split("/"):
        depth += -1 if part == ".." else 0 if part in ("", ".") else 1
        if depth < 0:
            return "parent"
    return "safe"


#: Codes whose verdict a worker remembers: cases of many environments often have the same code, and parsing is most of the work.
REMEMBERED = 4096


@lru_cache(REMEMBERED)
def path_references(code: str | None) -> list[str]:
    """Texts in code that are used like paths: first arguments of open and path calls, or texts with a slash and an ending."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError):
        return []
    found: dict[str, None] = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str):
            if called(n).split(".")[-1] in {"open", "Path", "read_csv", "read_text", "write_text", "join", "exists"}:
                found[n.args[0].value] = None
        elif isinstance(n, ast.Constant) and isinstance(n.value, str) and re.fullmatch(r"[\w.~\\-]*[/\\][\w./\\-]*\.\w{1,6}", n.value):
            found[n.value] = None
    return list(found)


@lru_cache(REMEMBERED)
def has_result(code: str | None) -> bool:
    """A name ``result`` is assigned."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError):
        return False
    return any(isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store) and n.id == "result" for n in ast.walk(tree))


@F.pandas_udf(ArrayType(StringType()))
def preflight_failures(code: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([preflight(c, w) for c, w in zip(code, wanted)], dtype=object)


@F.pandas_udf(StringType())
def path_safety(path: pd.Series) -> pd.Series:
    return path.map(path_class)


@F.arrow_udf(ArrayType(StringType()))
def code_paths(code: pa.Array) -> pa.Array:
    return of_distinct(code, path_references, pa.list_(pa.string()))


@F.pandas_udf(ArrayType(StringType()))
def imported_modules(code: pd.Series) -> pd.Series:
    def of(c):
        try:
            return modules(ast.parse(c or ""))
        except (SyntaxError, ValueError):
            return []

    return code.map(of)


@F.arrow_udf(BooleanType())
def assigns_result(code: pa.Array) -> pa.Array:
    """The code assigns a name ``result``."""
    return of_distinct(code, has_result, pa.bool_())
