"""What a regular expression needs, whatever it matches."""

from __future__ import annotations

import re
from collections.abc import Iterator


#: What Python and Java may read differently: rarer escapes, braces behind a border, classes within classes.
_UNSURE = re.compile(r"\\(?:[^\WbBdDsSwWtnrf]|[bB]\{)|\[[^\]]*\[")


def _runs(parsed) -> Iterator[str | None]:
    """Literals that stand one after another in every match; None where something else may stand between."""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            yield chr(arg)
        elif name == "AT":  # a border takes no room
            continue
        elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
            yield from _runs(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            for _ in range(min(least, 64)):
                yield from _runs(inner)
            if most != least or least > 64:
                yield None
        else:
            yield None


def needed(pattern: str) -> str:
    """The longest literal (the first of several) that every match of the pattern holds; empty if none is sure."""
    if _UNSURE.search(pattern):
        return ""
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, AttributeError, OverflowError, RecursionError):
        return ""
    if parsed.state.flags & ~re.UNICODE:
        return ""
    out, run = "", ""
    for c in [*_runs(parsed), None]:
        run = run + c if c is not None else ""
        out = run if len(run) > len(out) else out
    return out
