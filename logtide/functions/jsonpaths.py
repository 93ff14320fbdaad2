"""Leaves and pointers of JSON texts.

Spark's own JSON functions change numbers' spelling and take duplicate keys otherwise,
so a small Arrow function parses strictly, once for leaves and errors: one value a line, no NaN,
no number beyond the doubles, no half of a surrogate pair, no more than DEPTH levels, sorted
keys. What breaks one of these is no JSON, with a reason; no line ends the job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import importable

#: Objects and arrays within each other.
DEPTH = 127
PARSED = "struct<leaves: array<struct<path: string, value: string, kind: string>>, error: string>"


def arrow_path(path: str) -> str:
    """a->b as a JSON pointer: /a/b"""
    return "/" + "/".join(path.split("->"))


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON number")


def _number(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return value


_decoder = json.JSONDecoder(parse_constant=_refuse, parse_float=_number)


def parse(line: str):
    """The value of a line; ValueError with a reason if it isn't JSON."""
    try:
        return _decoder.decode(line)
    except RecursionError:
        raise ValueError("recursion limit exceeded") from None


def scalar_text(value) -> str:
    text = value if isinstance(value, str) else json.dumps(value)
    text.encode()  # halves of surrogate pairs can't be
    return text


def walk(value) -> Iterator[tuple[str, str | None, str]]:
    """(path, text, kind) of every scalar, depth first, keys in order; kind: text, number, other.
    An object or array without any has no text, and the kind empty."""
    out: list[tuple[str, str | None, str]] = []
    _add_leaves(out, value)
    return iter(out)


def _add_leaves(out: list[tuple[str, str | None, str]], value, path: str = "", level: int = 0) -> None:
    if not isinstance(value, (dict, list)):
        out.append((path, scalar_text(value), "text" if isinstance(value, str) else "other" if value is None or isinstance(value, bool) else "number"))
        return
    if not value:
        out.append((path, None, "empty"))
    if level == DEPTH:
        raise ValueError("recursion limit exceeded")
    for k, v in sorted(value.items()) if isinstance(value, dict) else enumerate(value):
        if isinstance(value, dict):
            k.encode()
        _add_leaves(out, v, f"{path}/{k}", level + 1)


def taken_apart(line: str | None) -> tuple[list[tuple[str, str | None, str]] | None, str | None]:
    """leaves and error of a line, one of them null; a null line is an empty one."""
    try:
        return list(walk(parse(line or ""))), None
    except UnicodeEncodeError:
        return None, "lone surrogate"
    except ValueError as e:
        return None, str(e)


def _parsed(lines: pa.Array) -> pa.Array:
    all_, ends, errors = [], [0], []
    for line in lines.to_numpy(zero_copy_only=False):
        found, error = taken_apart(line)
        all_ += found or ()
        ends.append(len(all_))
        errors.append(error)
    columns = zip(*all_, strict=True) if all_ else ((), (), ())
    leaf = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "value", "kind"])
    broken = pa.array([e is not None for e in errors], pa.bool_())
    found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), leaf, mask=broken)
    return pa.StructArray.from_arrays([found, pa.array(errors, pa.string())], names=["leaves", "error"])


def parsed(line: Column) -> Column:
    """Leaves (null where the text isn't JSON) and error (null where it is)."""
    importable(SparkSession.active())
    return F.arrow_udf(_parsed, PARSED)(line)


def leaves(line: Column) -> Column:
    """array<struct<path, value, kind>> of the scalars; null where the text isn't JSON."""
    return F.filter(parsed(line)["leaves"], lambda x: x["kind"] != "empty")


def kind_at(leaves: Column, pointer: Column) -> Column:
    """What stands at a pointer: text, number, other (true, false, null) or container; null if nothing does."""
    here = F.try_element_at(F.filter(leaves, lambda x: x["path"] == pointer), F.lit(1))["kind"]
    below = F.exists(leaves, lambda x: F.startswith(x["path"], F.concat(pointer, F.lit("/"))))
    return F.when(here == "empty", "container").when(here.isNotNull(), here).when(below, "container")


def leaf(leaves: Column, pointer: Column | str) -> Column:
    """The text of the leaf at a pointer; null if there is none."""
    hit = F.filter(leaves, lambda x: x["path"] == pointer)
    return F.try_element_at(hit, F.lit(1))["value"]


def at_pointer(line: Column, pointer: str) -> Column:
    """The scalar at the pointer as text; null if there is none."""
    return leaf(leaves(line), pointer)
