"""Formats, rules and thresholds: the values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: must equal what users of the existing tool's formats rely on. ---

#: (name, regular expression, strftime pattern, change of the text before parsing)
TIMESTAMP_FORMATS = (
    ("YYYY-MM-DDTHH:MM:SSZ", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z", "%Y-%m-%dT%H:%M:%S%.fZ", None),
    ("YYYY-MM-DDTHH:MM:SS.SS", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?", "%Y-%m-%dT%H:%M:%S%.f", None),
    ("YYYY-MM-DD HH:MM:SS", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,6})?", "%Y-%m-%d %H:%M:%S%.f", None),
    ("Mon D, YYYY h:MM:SS AM/PM", r"[A-Za-z]{3} \d{1,2}, \d{4} \d{1,2}:\d{2}:\d{2} [AP]M", "%b %e, %Y %l:%M:%S %p", None),
    ("Mon D YYYY HH:MM:SS", r"[A-Za-z]{3} \d{1,2} \d{4} \d{1,2}:\d{2}:\d{2}", "%b %e %Y %H:%M:%S", None),
    ("MM/DD/YYYY hh:MM:SS AM/PM", r"\d{2}/\d{2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M", "%m/%d/%Y %I:%M:%S %p", None),
    ("Epoch Time Seconds", r"\b\d{10}\b", "%s", None),
    ("Epoch Time Milliseconds", r"\b\d{13}\b", "%s", "first_ten_digits"),
    ("date= time=", r"date=\d{4}-\d{2}-\d{2}\s+time=\d{2}:\d{2}:\d{2}", "date=%Y-%m-%d time=%H:%M:%S", None),
    ("Mon D HH:MM:SS", r"\b[A-Za-z]{3} \d{1,2} \d{2}:\d{2}:\d{2}\b", "%Y %b %e %H:%M:%S", "year_1970"),
)

#: (name, regular expression)
REDACTION_RULES = (
    ("Asterisks", r"\*{3,}"),
    ("XXXX", r"X{4,}"),
    ("Sensitive Data Removed", r"<sensitiveDataRemoved>"),
    ("REDACTED", r"\bREDACTED\b"),
    ("REMOVED", r"\bREMOVED( FOR SECURITY)?\b"),
    ("MASKED", r"\b(DATA )?MASKED\b"),
    ("Custom Square Bracketed Token", r"SENSITIVE"),
    ("Base64 Placeholder", r"\bBASE64_REDACTED\b"),
)

#: Kind -> the values of High, Medium and Low
ALERT_THRESHOLDS = {
    "SusTimeGap": (100, 30, 10),
    "SusEventCount": (10_000, 1_000, 100),
    "DupeEvents": (100, 10, 0),
    "RedactionEvents": (100, 10, 0),
}


#: Records among which a CSV header is looked for
HEADER_RECORDS = 7

# --- Settings ------------------------------------------------------------------


@dataclass(frozen=True)
class TimestampFormat:
    name: str
    regex: str
    strftime: str
    change: str | None = None


@dataclass(frozen=True)
class Settings:
    """What a run does; the counterparts of the command line's options."""

    input: str
    output: str | None = None
    timestamp_field: str | None = None
    formats: tuple[TimestampFormat, ...] = field(default_factory=lambda: builtin_formats())
    quick: bool = False
    multipart: bool = False
    #: Blocks a group's records are cut into, so that no task holds a whole group.
    block: int = 1_000_000


def builtin_formats() -> tuple[TimestampFormat, ...]:
    return tuple(TimestampFormat(*f) for f in TIMESTAMP_FORMATS)


def user_formats(path: str) -> tuple[TimestampFormat, ...]:
    """Formats of a YAML list of pretty_format, regex and strftime_format; they replace the built-in ones."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml

        items = yaml.safe_load(text)
    except ImportError:
        items = _plain_yaml(text)
    return tuple(TimestampFormat(i["pretty_format"], i["regex"], i["strftime_format"]) for i in items)


def _plain_yaml(text: str) -> list[dict]:
    """A list of flat mappings with plain or double-quoted values, where no YAML library is installed."""
    import json

    items: list[dict] = []
    for line in text.splitlines():
        if line.strip().startswith("#") or not line.strip():
            continue
        if line.startswith("- "):
            items.append({})
            line = line[2:]
        key, _, value = line.strip().partition(":")
        value = value.strip()
        items[-1][key.strip()] = json.loads(value) if value.startswith('"') else value
    return items
