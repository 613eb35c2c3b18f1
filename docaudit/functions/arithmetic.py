"""Closed arithmetic in text form ("100 - (60 + 30)"), evaluated in Arrow batches.

Expressions are checked against a whitelist of syntax nodes and then run by Python
with an environment that holds only the listed functions. Literals become floats, so
no power can grow beyond a double.
"""

from __future__ import annotations

import ast
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.constants import DOMAIN_IMPLIES, NONZERO_EPS, SAMPLE_COUNT, SAMPLE_POINTS

RESULT = T.StructType([T.StructField("computed", T.DoubleType()), T.StructField("error", T.StringType())])
SAMPLES = T.StructType(
    [
        T.StructField("n_evaluated", T.LongType()),
        T.StructField("nonzero_fraction", T.DoubleType()),
        T.StructField("max_abs", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)

_NODES = (
    ast.Expression, ast.Constant, ast.BinOp, ast.UnaryOp, ast.Call, ast.Name, ast.Load, ast.List, ast.Tuple,
    ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Pow, ast.UAdd, ast.USub,
)


def _values(args):
    return args[0] if len(args) == 1 and isinstance(args[0], (list, tuple)) else args


def _integral(x):
    return int(x) if isinstance(x, float) and x.is_integer() else x


ENVIRONMENT = {
    "sqrt": math.sqrt, "log": math.log, "ln": math.log, "log10": math.log10, "log2": math.log2,
    "exp": math.exp, "abs": abs, "floor": math.floor, "ceil": math.ceil,
    "round": lambda x, n=None: round(x) if n is None else round(x, _integral(n)),
    "pow": lambda x, y, m=None: x**y if m is None else pow(_integral(x), _integral(y), _integral(m)),
    "min": lambda *a: min(_values(a)),
    "max": lambda *a: max(_values(a)),
    "sum": lambda *a: sum(_values(a)),
    "mean": lambda *a: sum(_values(a)) / len(_values(a)),
}
CONSTANTS = {"pi": math.pi, "e": math.e}

VECTOR_ENVIRONMENT = {
    "sqrt": np.sqrt, "log": lambda x, b=None: np.log(x) if b is None else np.log(x) / np.log(b), "ln": np.log,
    "log10": np.log10, "log2": np.log2, "exp": np.exp, "abs": np.abs, "pow": np.power,
    "sin": np.sin, "cos": np.cos, "tan": np.tan,
}


class NotArithmetic(ValueError):
    """The text is outside the grammar, or has no finite number as its value."""


@lru_cache(maxsize=4096)
def compiled(text: str, symbols: tuple[str, ...] = (), functions: tuple[str, ...] = tuple(ENVIRONMENT)):
    """Checked code object of an expression over ``symbols``."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError, MemoryError, RecursionError) as exc:
        raise NotArithmetic("syntax error") from exc
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    for node in ast.walk(tree):
        if not isinstance(node, _NODES):
            raise NotArithmetic(f"not allowed: {type(node).__name__}")
        if isinstance(node, ast.Constant):
            if isinstance(node.value, bool) or not isinstance(node.value, (int, float)):
                raise NotArithmetic("non-numeric literal")
            try:
                node.value = float(node.value)
            except OverflowError as exc:
                raise NotArithmetic("number too large") from exc
        elif isinstance(node, ast.Call):
            if node.keywords or not isinstance(node.func, ast.Name) or node.func.id not in functions:
                raise NotArithmetic("only listed functions may be called")
        elif isinstance(node, ast.Name) and id(node) not in called:
            if node.id not in CONSTANTS and node.id not in symbols:
                raise NotArithmetic(f"unknown name: {node.id}")
    return compile(tree, "<claim>", "eval")


def evaluate(text: str) -> float:
    if not isinstance(text, str) or not text.strip():
        raise NotArithmetic("empty expression")
    code = compiled(text)
    try:
        value = eval(code, {"__builtins__": {}}, {**ENVIRONMENT, **CONSTANTS})
    except Exception as exc:
        raise NotArithmetic(f"evaluation failed: {type(exc).__name__}") from exc
    number = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if number is None or not np.isfinite(number):
        raise NotArithmetic("result is not a finite number")
    return number


@F.pandas_udf(RESULT)
def evaluate_text(expr: pd.Series) -> pd.DataFrame:
    values, errors = [], []
    for text in expr:
        try:
            values.append(evaluate(text))
            errors.append(None)
        except NotArithmetic as exc:
            values.append(None)
            errors.append(str(exc))
    return pd.DataFrame({"computed": pd.Series(values, dtype="float64"), "error": pd.Series(errors, dtype="object")})


def points_for(rank: int, domain: str | None) -> np.ndarray:
    """Sample values of the ``rank``-th symbol, moved into its domain."""
    base = np.array([p / q for p, q in SAMPLE_POINTS])
    values = base[(np.arange(SAMPLE_COUNT) + rank) % len(base)]
    implied = DOMAIN_IMPLIES.get(domain or "unknown", [])
    if "positive" in implied or "nonnegative" in implied:
        values = np.abs(values)
    if "integer" in implied:
        values = np.where(np.abs(values) >= 1, np.trunc(values), 1.0)
    return values


@F.pandas_udf(SAMPLES)
def sample_residual(lhs: pd.Series, rhs: pd.Series, symbols: pd.Series, domains: pd.Series) -> pd.DataFrame:
    """Residual lhs - rhs at the fixed sample points; points without a finite value are skipped."""
    rows = []
    for left, right, names, kinds in zip(lhs, rhs, symbols, domains):
        ranked = sorted(zip(names, kinds if kinds is not None else [None] * len(names)))
        env = {n: points_for(i, d).astype(complex) for i, (n, d) in enumerate(ranked)}
        functions = tuple(VECTOR_ENVIRONMENT)
        try:
            with np.errstate(all="ignore"):
                sides = [
                    eval(
                        compiled(side, tuple(sorted(env)), functions),
                        {"__builtins__": {}},
                        {**VECTOR_ENVIRONMENT, **CONSTANTS, **env},
                    )
                    for side in (left, right)
                ]
                residual = np.broadcast_to(np.asarray(sides[0] - sides[1], dtype=complex), (SAMPLE_COUNT,))
                size = np.abs(residual)
        except Exception as exc:
            rows.append((0, 0.0, 0.0, str(exc)))
            continue
        size = size[np.isfinite(size)]
        n = int(size.size)
        rows.append((n, float((size > NONZERO_EPS).mean()) if n else 0.0, float(size.max()) if n else 0.0, None))
    return pd.DataFrame(rows, columns=["n_evaluated", "nonzero_fraction", "max_abs", "error"])
