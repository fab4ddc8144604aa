"""Formulas of the form ``y ~ x + L(x, 1) + D(z, 1) + Lrange(w, 0, 2) + d(v)``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """A column of the design: a variable, its lag (lead if k < 0) or its k-gap difference."""

    var: str
    op: str = ""  # "", "L" or "D"
    k: int = 0

    @property
    def label(self) -> str:
        return f"{self.op}({self.var},{self.k})" if self.op else self.var

    @property
    def column(self) -> str:
        """A name that is safe in Spark."""
        if not self.op:
            return self.var
        return f"{self.var}__{self.op.lower()}{self.k if self.k >= 0 else f'm{-self.k}'}"

    def expr(self, by_unit: WindowSpec) -> Column:
        x = F.col(f"`{self.var}`").cast("double")
        if not self.op or self.op == "L" and self.k == 0:
            return x
        lag = F.lag(x, self.k).over(by_unit)
        return lag if self.op == "L" else x - lag


_CALL = re.compile(r"(L|D|Lrange|d)\s*\(\s*([A-Za-z_.][\w.]*)\s*((?:,\s*[-+]?\d+\s*)*)\)\Z")
_NAME = re.compile(r"[A-Za-z_.][\w.]*\Z")


def parse_term(text: str) -> list[Term]:
    text = text.strip()
    if _NAME.match(text):
        return [Term(text)]
    m = _CALL.match(text)
    if not m:
        raise ValueError(f"unknown term {text!r}: use a column, L(), D(), Lrange() or d()")
    op, var, rest = m.groups()
    args = [int(a) for a in rest.split(",")[1:]]
    if op == "d" and not args:
        return [Term(var, "D", 1)]
    if op in ("L", "D") and len(args) <= 1:
        return [Term(var, op, args[0] if args else 1)]
    if op == "Lrange" and len(args) == 2:
        if args[0] > args[1]:
            raise ValueError(f"Lrange: {args[0]} is larger than {args[1]}")
        return [Term(var, "L", k) if k else Term(var) for k in range(args[0], args[1] + 1)]
    raise ValueError(f"wrong number of arguments in {text!r}")


def _split(text: str) -> list[str]:
    return [p for p in re.split(r"\+(?![^(]*\))", text) if p.strip()]


@dataclass(frozen=True)
class ModelSpec:
    """What to fit: the logical plan that estimators turn into DataFrames."""

    y: Term
    xs: tuple[Term, ...]
    model: str = "cce"
    csa: tuple[str, ...] | None = None  # None: y and all variables on the right; (): none
    csa_lags: int | dict = 0
    csa_from: str = "global"  # "global", "cluster" or "spatial"
    constant: bool = True
    trend: bool = False
    correction: str | None = None  # "jackknife" or "half_panel"
    absorb: tuple[str, ...] = ()
    n_factors: int | None = None
    p_x: int = 3
    options: dict = field(default_factory=dict)

    @property
    def variables(self) -> list[str]:
        """The variables behind the terms, each once, y first."""
        return list(dict.fromkeys([self.y.var, *[t.var for t in self.xs]]))

    @property
    def csa_variables(self) -> list[str]:
        return self.variables if self.csa is None else list(self.csa)

    def lags_of(self, var: str) -> int:
        return self.csa_lags.get(var, 0) if isinstance(self.csa_lags, dict) else self.csa_lags


def parse(formula: str, csa: str | None = "~ .", **params) -> ModelSpec:
    """formula: the model; csa: ``~ .`` for all variables, ``~ a + b`` for some, None for none."""
    left, sep, right = formula.partition("~")
    if not sep or not left.strip() or not right.strip():
        raise ValueError(f"no two-sided formula: {formula!r}")
    y = parse_term(left)
    if len(y) != 1:
        raise ValueError("one dependent variable is needed")
    xs = tuple(dict.fromkeys(t for part in _split(right) for t in parse_term(part)))
    if csa is None:
        chosen: tuple[str, ...] | None = ()
    elif csa.replace("~", "").strip() == ".":
        chosen = None
    else:
        chosen = tuple(dict.fromkeys(t.var for part in _split(csa.replace("~", "")) for t in parse_term(part)))
    return ModelSpec(y[0], xs, csa=chosen, **params)


def classify(spec: ModelSpec) -> tuple[list[Term], dict[str, list[Term]]]:
    """Lags of y, and the other terms by variable, for long-run coefficients."""
    y_lags = [t for t in spec.xs if t.var == spec.y.var and t.op == "L"]
    groups: dict[str, list[Term]] = {}
    for t in spec.xs:
        if t not in y_lags:
            groups.setdefault(t.var, []).append(t)
    return y_lags, groups
