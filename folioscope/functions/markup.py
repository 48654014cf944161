"""Readable text for a subset of LaTeX: a tokeniser and one pass over its tokens with a stack, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.functions.text import collapse_ws

# Markup commands and the glyph each is read as. A deliberate subset.
GLYPHS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ϵ", "theta": "θ", "lambda": "λ",
    "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "ϕ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Sigma": "Σ", "Omega": "Ω",
    "int": "∫", "sum": "∑", "prod": "∏", "partial": "∂", "nabla": "∇", "infty": "∞",
    "cdot": "·", "times": "×", "pm": "±", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠",
    "approx": "≈", "to": "→", "rightarrow": "→", "in": "∈",
    "lim": "lim", "sin": "sin", "cos": "cos", "tan": "tan", "log": "log", "ln": "ln", "exp": "exp",
}
# what a command writes before, between and after its arguments; None leaves the argument out
WRITTEN = {
    **dict.fromkeys(("frac", "dfrac", "tfrac"), ("", "/", "")),
    "sqrt": ("√(", ")"),
    **dict.fromkeys(("text", "mathbb", "mathbf", "mathrm", "mathcal"), ("", "")),
    **dict.fromkeys(("begin", "end"), None),
}
SILENT = {"left", "right", "displaystyle"}

_TOKEN = re.compile(r"\\([A-Za-z]+)|\\(.)|([{}$~])|([^\\{}$~]+)", re.DOTALL)


def read_markup(text: str) -> str | None:
    """The text its markup stands for, blanks as they come; None for braces that do not match, a command without its
    arguments or a lone backslash at the end. Everything is written once, so the time is linear in the text."""
    out: list[str] = []
    open_groups: list[tuple[list | None, int]] = []  # the command a group is an argument of, and where the group began
    waiting: list | None = None  # a command and the number of arguments it has had
    end = 0
    for token in _TOKEN.finditer(text):
        if token.start() != end:
            return None
        end = token.end()
        name, escaped, sign, plain = token.groups()
        if waiting is not None and sign != "{":
            if plain is None or plain.strip():
                return None
            continue
        if sign == "{":
            open_groups.append((waiting, len(out)))
            waiting = None
        elif sign == "}":
            if not open_groups:
                return None
            command, began = open_groups.pop()
            if command is not None:
                written = WRITTEN[command[0]]
                if written is None:
                    del out[began:]
                    out.append(" ")
                else:
                    command[1] += 1
                    out.append(written[command[1]])
                    waiting = command if command[1] < len(written) - 1 else None
        elif name is not None:
            if name in WRITTEN:
                waiting = [name, 0]
                if WRITTEN[name]:
                    out.append(WRITTEN[name][0])
            elif name not in SILENT:
                out.append(GLYPHS.get(name, "\\" + name))
        elif escaped is not None:
            out.append("\\" + escaped if escaped.isalpha() else escaped if escaped in "%$&#_{}" else " ")
        elif plain is not None:
            out.append(plain)
        elif sign == "~":
            out.append(" ")
    return None if open_groups or waiting is not None or end != len(text) else "".join(out)


@F.pandas_udf(StringType())
def _read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else read_markup(t))


def normalize_markup(c: Column) -> Column:
    """Readable text for a subset of LaTeX, nested to any depth, whitespace collapsed; broken markup comes back as it is.

    Only texts with a backslash or a dollar sign are handed to the reader; plain prose stays in the JVM.
    """
    return _normalized(c, collapse_ws(c))


def normalize_marked(c: Column) -> Column:
    """As :func:`normalize_markup`, but text without markup keeps its blanks: for readers to whom they are all one."""
    return _normalized(c, c)


def _normalized(c: Column, plain: Column) -> Column:
    marked = F.contains(c, F.lit("\\")) | F.contains(c, F.lit("$"))
    return F.when(marked, F.coalesce(collapse_ws(_read(F.when(marked, c))), c)).otherwise(plain)
