"""Watched calls in the syntax tree of a text that parses as Python (operators F1, F3)."""

from __future__ import annotations

import ast
import sys
import unicodedata
import warnings

from pyspark import cloudpickle

from riskframe import rules

# A watched call names one of these; identifiers may also be spelled with compatibility
# characters, hence any text beyond ASCII passes and is checked again in normal form.
NAMES = sorted({max(t.split("."), key=len) for t in [*rules.CALL_TARGETS, *rules.CALL_TARGET_MODULES]})

_TARGETS = dict(rules.CALL_TARGETS)
_TARGET_MODULES = dict(rules.CALL_TARGET_MODULES)
_LEAVE = object()

# The Arrow step below is this module's own small code: ship it with the query, so that executors
# need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _dotted(node: ast.expr) -> str:
    """``a.b.c`` for a plain attribute chain, else an empty text."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return ""
    return ".".join([node.id, *reversed(parts)])


def _watched(func: ast.expr) -> str | None:
    name = _dotted(func)
    head, _, member = name.partition(".")
    if member and "." not in member and head in _TARGET_MODULES:
        return _TARGET_MODULES[head]
    return _TARGETS.get(name)


def _outside_data(node: ast.expr, names: set[str]) -> bool:
    """Does an expression carry outside data?  Looks at its top node only."""
    match node:
        case ast.Name(id=name):
            return name in names
        case ast.JoinedStr() | ast.BinOp(op=ast.Add() | ast.Mod()):
            return True
        case ast.Call(func=ast.Name(id="input" | "__import__" | "getenv")):
            return True
        case ast.Call(func=ast.Attribute(value=ast.Name(id="os" | "request" | "sys" | "importlib"))):
            return True
        case ast.Attribute(value=ast.Name(id="request" | "sys" | "os")):
            return True
        case ast.Subscript(value=ast.Attribute(value=ast.Name(id="request" | "os"))):
            return True
        case ast.Subscript(value=ast.Name(id="argv" | "environ")):
            return True
    return False


def _argument_kind(call: ast.Call) -> str:
    if not call.args:
        return "none"
    match call.args[0]:
        case ast.Name():
            return "name"
        case ast.JoinedStr() | ast.BinOp():
            return "built"
        case ast.Constant(value=str()):
            return "literal"
    return "other"


def call_sites(code: str) -> list[dict]:
    """Watched calls of one text in source order; text that does not parse has none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code)
    except Exception:
        return []
    sites: list[dict] = []
    tainted: set[str] = set()
    functions: list[str] = []
    pending: list = [tree]
    while pending:
        node = pending.pop()
        if node is _LEAVE:
            functions.pop()
            continue
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            functions.append(node.name)
            pending.append(_LEAVE)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            if node.value is not None and _outside_data(node.value, tainted):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                tainted.update(t.id for t in targets if isinstance(t, ast.Name))
        elif isinstance(node, ast.Call):
            pattern = _watched(node.func)
            if pattern:
                sites.append({
                    "seq": len(sites), "line": node.lineno, "pattern": pattern,
                    "arg_kind": _argument_kind(node),
                    "arg_tainted": bool(node.args) and _outside_data(node.args[0], tainted),
                    "fn_name": functions[-1] if functions else "",
                })
        pending.extend(reversed(list(ast.iter_child_nodes(node))))
    return sites


def _names_target(code: str) -> bool:
    plain = code if code.isascii() else unicodedata.normalize("NFKC", code)
    return any(name in plain for name in NAMES)


def gated_call_sites(code: str | None) -> list[dict]:
    """The call sites of a text that names a target, else none."""
    return call_sites(code) if code is not None and _names_target(code) else []
