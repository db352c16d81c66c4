"""Strict contracts that the built-in parsers are too lenient for, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types as objects: executors import this module without a session to read type strings.
_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
_LIMITS = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])


def strict_json(raw: str):
    """Parse JSON; duplicate keys, NaN and infinities are errors."""

    def pairs(items: list) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("duplicate key")
        return out

    def constant(name: str):
        raise ValueError(name)

    return json.loads(raw, object_pairs_hook=pairs, parse_constant=constant)


def answer(raw: str | None, finish: str | None, known: list | None, key: str, decisions: str | None = None) -> list | None:
    """The sorted ids of a strict answer {key: [ids]}; None unless it stopped normally, has exactly that key, and lists distinct
    known strings.

    decisions: a second key that must then be there too, with {id, applicable} once for every known id, and with the listed ids alone
    applicable."""
    if raw is None or finish != "stop":
        return None
    try:
        value = strict_json(raw)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict) or set(value) != {key, decisions} - {None}:
        return None
    ids = value[key]
    known = set() if known is None else set(known)
    if not isinstance(ids, list) or not all(isinstance(x, str) and x in known for x in ids) or len(set(ids)) != len(ids):
        return None
    if decisions is not None and not _consistent(value[decisions], set(ids), known):
        return None
    return sorted(ids)


def _consistent(listed: object, ids: set[str], known: set[str]) -> bool:
    shaped = isinstance(listed, list) and all(isinstance(d, dict) and set(d) == {"id", "applicable"} and isinstance(d["id"], str) and isinstance(d["applicable"], bool) for d in listed)
    if not shaped or len({d["id"] for d in listed}) != len(listed):
        return False
    return {d["id"] for d in listed} == known and {d["id"] for d in listed if d["applicable"]} == ids


def parse_answer(key: str = "applicable", decisions: str | None = None):
    @F.pandas_udf(_TEXTS)
    def parse(raw: pd.Series, finish: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([answer(r, f, k, key, decisions) for r, f, k in zip(raw, finish, known, strict=True)], dtype=object)

    return parse


@F.pandas_udf(_TEXT)
def parse_prompt(raw: pd.Series) -> pd.Series:
    """The prompt of {"prompt": text}: one text of 1 to 8000 characters, not blank; else null."""

    def one(x: str | None) -> str | None:
        try:
            value = strict_json(x) if x is not None else None
        except (ValueError, RecursionError):
            return None
        ok = isinstance(value, dict) and list(value) == ["prompt"] and isinstance(value["prompt"], str)
        return value["prompt"] if ok and value["prompt"].strip() and len(value["prompt"]) <= 8000 else None

    return raw.map(one)


def canonical(value) -> str:
    """Sorted keys, no spaces, characters as they are, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(_TEXT)
def canonical_digest(raw: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of a JSON text; null if it is not strict JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else hashlib.sha256(canonical(strict_json(x)).encode()).hexdigest()
        except (ValueError, RecursionError):
            return None

    return raw.map(one)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction (modified Lentz), which takes a number
    of terms that grows with the square root of a + b at most."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):  # the fraction converges fast on the other side
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100 + 20 * math.isqrt(int(a + b) + 1)):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + term * d, 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * out


def beta_point(p: float, a: float, b: float) -> float:
    """The x at which I_x(a, b) is p, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(64):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(a, b, mid) < p else (low, mid)
    return (low + high) / 2


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact limits of a share k of n: points of beta distributions."""
    if n == 0:
        return 0.0, 1.0
    return (beta_point(alpha / 2, k, n - k + 1) if k else 0.0), (beta_point(1 - alpha / 2, k + 1, n - k) if k < n else 1.0)


@F.pandas_udf(_LIMITS)
def exact_limits(k: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clopper_pearson(int(a), int(b), float(c)) for a, b, c in zip(k, n, alpha, strict=True)], columns=["low", "high"])
