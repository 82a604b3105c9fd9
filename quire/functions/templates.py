"""Templates: {{ a.b }} filled from JSON, as JavaScript shows values; one rule for texts in memory and for columns."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_KEY = re.compile(r"\{\{\s*([A-Za-z0-9_.]+)\s*\}\}")


def number_text(x: int | float) -> str:
    """A JSON number as JavaScript writes it: all are doubles."""
    x = float(x)
    if x != x or x in (float("inf"), float("-inf")):
        return {float("inf"): "Infinity", float("-inf"): "-Infinity"}.get(x, "NaN")
    text = repr(x).removesuffix(".0")
    mantissa, e, exponent = ("0" if x == 0 else text).partition("e")
    if not e:
        return mantissa
    power = int(exponent)
    return _plain(text) if -7 < power < 21 else f"{mantissa}e{'+' if power > 0 else '-'}{abs(power)}"


def _plain(text: str) -> str:
    """A number's shortest digits without an exponent."""
    sign, text = ("-", text[1:]) if text.startswith("-") else ("", text)
    mantissa, _, exponent = text.partition("e")
    whole, _, part = mantissa.partition(".")
    power = int(exponent or 0)
    if power >= len(part):
        return sign + whole + part + "0" * (power - len(part))
    if power >= 0:
        return sign + whole + part[:power] + "." + part[power:]
    return sign + "0." + "0" * (-power - 1) + whole + part


def shown(value) -> str:
    """A JSON value as a template shows it."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, list):
        return ",".join(map(shown, value))
    return "[object Object]" if isinstance(value, dict) else str(value)


def _member(value, key: str):
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, str)) and key.isdigit():
        return value[int(key)] if int(key) < len(value) else None
    return len(value) if isinstance(value, (list, str)) and value and key == "length" else None


def fill(text: str, data: dict) -> str:
    """{{ a.b }} by data["a"]["b"], or nothing; what is put in is not searched."""

    def value(m) -> str:
        at = data
        for k in m[1].split("."):
            at = _member(at, k) if at else None
        return shown(at)

    return _KEY.sub(value, text)


def _loaded(data: str | None):
    try:
        return json.loads(data) if data else {}
    except ValueError:
        return {}


@F.arrow_udf(StringType())
def _filled(texts: pa.Array, data: pa.Array) -> pa.Array:
    return pa.array([None if t is None else fill(t, _loaded(d)) for t, d in zip(texts.to_pylist(), data.to_pylist(), strict=True)], pa.string())


def fill_template(text: Column, data: Column) -> Column:
    """text filled from a JSON text; a null or broken one holds nothing, a null text stays null."""
    return _filled(text, data)
