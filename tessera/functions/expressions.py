"""User expressions over columns, translated to SQL after a check of every token; nothing is ever evaluated as code."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Functions that an expression may call, with their SQL names.
FUNCTIONS = {
    "log10": "log10", "log2": "log2", "log": "ln", "exp": "exp", "expm1": "expm1", "sqrt": "sqrt", "abs": "abs", "round": "round",
    "floor": "floor", "ceiling": "ceil", "trunc": "bigint", "pmin": "least", "pmax": "greatest", "is.na": "isnull", "sign": "signum", "log1p": "log1p", "ifelse": "if",
}
_OPERATORS = {"&": " AND ", "&&": " AND ", "|": " OR ", "||": " OR ", "!": " NOT ", "==": " = ", "^": "^"}
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<name>[A-Za-z_][\w.]*)|(?P<str>'[^'\\]*'|\"[^\"\\]*\")|(?P<op>&&|\|\||[<>=!]=|[-+*/^%(),<>&|!]))")


def to_sql(text: str, columns: Iterable[str]) -> str:
    """The SQL of an expression; unknown names and any other character raise ValueError."""
    known = {c.lower(): c for c in columns}
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        at = m.end()
        if m["num"]:
            out.append(m["num"])
        elif m["str"]:
            out.append("'" + m["str"][1:-1].replace("'", "''") + "'")
        elif m["name"]:
            name = m["name"]
            if text[at:].lstrip().startswith("(") and name in FUNCTIONS:
                out.append(FUNCTIONS[name])
            elif name in ("TRUE", "FALSE", "NULL"):
                out.append(name)
            elif name.lower() in known:
                out.append(f"`{known[name.lower()]}`")
            else:
                raise ValueError(f"unknown name {name!r}")
        else:
            out.append(_OPERATORS.get(m["op"], m["op"]))
    parts = "".join(out)
    while "^" in parts:  # a power becomes a call; its operands are a name, a number or a bracket
        m = re.search(r"(`[^`]+`|[\d.]+|\([^()]*\))\^(`[^`]+`|[\d.]+|\([^()]*\))", parts)
        if not m:
            raise ValueError("cannot read the operands of ^")
        parts = parts[: m.start()] + f"power({m[1]},{m[2]})" + parts[m.end() :]
    return parts


def expression(text: str, columns: Iterable[str]) -> Column:
    return F.expr(to_sql(text, columns))


predicate = expression


def threshold(text: str, n: int) -> float:
    """A number from an expression in n, such as ``(n+1)/2``."""
    if not re.fullmatch(r"[\dn+\-*/(). ]+", text):
        raise ValueError(f"cannot read {text!r}")
    stack: list[list] = [[]]
    for token in re.findall(r"\d+\.?\d*|n|[-+*/()]", text):
        if token == "(":
            stack.append([])
        elif token == ")":
            value = _reduce(stack.pop())
            stack[-1].append(value)
        else:
            stack[-1].append(float(n) if token == "n" else float(token) if token[0].isdigit() else token)
    value = _reduce(stack.pop())
    if stack or not math.isfinite(value):
        raise ValueError(f"cannot read {text!r}")
    return value


def _reduce(items: list) -> float:
    for ops in ("*/", "+-"):
        out: list = []
        for x in items:
            if out and isinstance(out[-1], str) and out[-1] in ops and len(out) > 1:
                op, a = out.pop(), out.pop()
                out.append(a * x if op == "*" else a / x if op == "/" else a + x if op == "+" else a - x)
            else:
                out.append(x)
        items = out
    if len(items) != 1 or isinstance(items[0], str):
        raise ValueError("cannot read the expression")
    return items[0]
