"""The configuration file: a flat subset of TOML, checked when it is read, and what the command line may add."""

from __future__ import annotations

import math
import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from busframe.errors import BadConfiguration

# The names of message types and buses, and the levels.
TYPE_NAMES = {"MODE_COMMAND": 0x01, "BC_TO_RT": 0x02, "RT_TO_BC": 0x04, "RT_TO_RT": 0x08, "BROADCAST_BC_TO_RT": 0x10, "BROADCAST_RT_TO_RT": 0x18, "SPURIOUS_DATA": 0x20}
BUSES = {"A": 0, "B": 1}
LEVELS = ("DEBUG", "INFO", "WARNING", "WARN", "ERROR", "CRITICAL", "OFF")
MOST_SORT_GROUP = 1 << 20

STRING, NUMBER = r'"(?:[^"\\]|\\.)*"', r"[+-]?(?:\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|inf|nan)"
SCALAR = rf"(?:{STRING}|{NUMBER}|true|false)"
LINE = re.compile(rf"\s*(?:\[\s*[A-Za-z0-9_]+\s*\]|[A-Za-z0-9_]+\s*=\s*(?:{SCALAR}|\[\s*(?:{SCALAR}\s*(?:,\s*{SCALAR}\s*)*,?\s*)?\]))?\s*(?:#.*)?")


def whole(low: int | None = None, high: int | None = None) -> Callable:
    def check(v):
        if isinstance(v, bool) or not isinstance(v, int) or low is not None and v < low or high is not None and v > high:
            raise ValueError("must be a whole number" + f" of {low} or more" * (low is not None) + f" and {high} or less" * (high is not None))
        return v

    return check


def boolean(v):
    if not isinstance(v, bool):
        raise ValueError("must be true or false")
    return v


def choice(*names: str) -> Callable:
    def check(v):
        if not isinstance(v, str) or v.lower() not in names:
            raise ValueError(f"must be one of {', '.join(names)}")
        return v.lower()

    return check


def delimiter(v):
    if not isinstance(v, str) or not v:
        raise ValueError("must be a string that isn't empty")
    return v


def rate(v):
    if isinstance(v, bool) or not isinstance(v, (int, float)) or not (math.isfinite(v) and v > 0):
        raise ValueError("must be a finite number above 0")
    return float(v)


def level(v):
    if not isinstance(v, str) or v.upper() not in LEVELS:
        raise ValueError(f"must be one of {', '.join(LEVELS)}")
    return v.upper()


def message_type(v) -> int:
    """A type by its name or code; a code in a string is hexadecimal."""
    if isinstance(v, str):
        name = v.strip().upper()
        code = TYPE_NAMES.get(name, int(name, 16) if re.fullmatch("0X[0-9A-F]+", name) else -1)
    else:
        code = -1 if isinstance(v, bool) or not isinstance(v, int) else v
    if not 0 <= code <= 255:
        raise ValueError(f"{v!r} is no message type; names are {', '.join(TYPE_NAMES)}")
    return code


def bus(v) -> int:
    if not isinstance(v, str) or v.strip().upper() not in BUSES:
        raise ValueError(f"{v!r} is no bus; they are A and B")
    return BUSES[v.strip().upper()]


def listed(one: Callable) -> Callable:
    def check(v):
        if not isinstance(v, list):
            raise ValueError("must be an array")
        return [one(x) for x in v]

    return check


#: By table and key: the setting, and the check that gives its value.
KEYS: dict[tuple[str, str], tuple[str, Callable]] = {
    ("decode", "time_format"): ("time_format", choice("auto", "irig", "standard")), ("decode", "strict"): ("strict", boolean), ("decode", "error_mode"): ("error_mode", choice("inline", "separate")),
    ("decode", "allow_partial"): ("allow_partial", boolean), ("decode", "detect_records"): ("detect_records", whole(1, 32)), ("decode", "lookahead_records"): ("lookahead_records", whole(1, 32)),
    ("decode", "standard_tick_rate_hz"): ("standard_tick_rate_hz", rate), ("output", "format"): ("format", choice("csv")), ("output", "no_clobber"): ("no_clobber", boolean),
    ("output", "max_sort_group"): ("max_sort_group", whole(1, MOST_SORT_GROUP)), ("mux", "enabled"): ("mux_enabled", boolean), ("mux", "delimiter"): ("mux_delimiter", delimiter), ("mux", "field"): ("mux_field", whole()),
    ("merge", "collapse_duplicates"): ("collapse_duplicates", boolean), ("merge", "collapse_window_us"): ("collapse_window_us", whole(0)), ("merge", "delta_scope"): ("delta_scope", choice("per-file", "global")),
    ("filter", "exclude_types"): ("exclude msg_type", listed(message_type)), ("filter", "exclude_rts"): ("exclude rt", listed(whole(0, 31))), ("filter", "exclude_buses"): ("exclude bus", listed(bus)),
    ("filter", "exclude_subaddresses"): ("exclude sa", listed(whole(0, 31))), ("logging", "level"): ("log_level", level),
}
TABLES = {table for table, _ in KEYS}


@dataclass(frozen=True)
class Settings:
    """What a run may set."""

    time_format: str = "auto"
    strict: bool = False
    allow_partial: bool = False
    detect_records: int = 8
    lookahead_records: int = 2
    standard_tick_rate_hz: float | None = None
    error_mode: str = "inline"
    format: str = "csv"
    no_clobber: bool = False
    max_sort_group: int = 4096
    mux_enabled: bool = True
    mux_delimiter: str = "."
    mux_field: int = 4
    collapse_duplicates: bool = False
    collapse_window_us: int = 0
    delta_scope: str = "per-file"
    log_level: str = "WARNING"
    exclude: dict = field(default_factory=dict)
    include: dict = field(default_factory=dict)

    def __post_init__(self):
        for name, check in KEYS.values():
            value = getattr(self, name, None)
            if value is not None:
                try:
                    object.__setattr__(self, name, check(value))
                except ValueError as e:
                    raise ValueError(f"{name} is {value!r}; it {e}") from None


def load(path: str | None) -> tuple[dict, list[str]]:
    """The settings of a configuration file, with exclude as lists by column, and its unknown keys.

    BadConfiguration if it isn't a readable regular file, uses more of TOML than tables of scalars and arrays on one
    line, names a table or key twice, or has a value that its key doesn't take."""
    out: dict = {"exclude": {}}
    if path is None:
        return out, []
    if not Path(path).is_file():
        raise BadConfiguration(f"{path} is no regular file")
    try:
        text = Path(path).read_text("utf-8")
        for n, line in enumerate(text.splitlines(), 1):
            if not LINE.fullmatch(line):
                raise BadConfiguration(f"{path}, line {n}: not a [table] or a key with a string, number, boolean or array of these")
        data = tomllib.loads(text)
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise BadConfiguration(f"{path}: {e}") from e
    unknown = []
    for table, values in data.items():
        if not isinstance(values, dict):
            if table in TABLES:
                raise BadConfiguration(f"{path}: {table} must be a table")
            unknown.append(f"[] {table}")
            continue
        for key, value in values.items():
            if (table, key) not in KEYS:
                unknown.append(f"[{table}] {key}")
                continue
            name, check = KEYS[table, key]
            try:
                value = check(value)
            except ValueError as e:
                raise BadConfiguration(f"{path}: {table}.{key} {e}") from None
            if name.startswith("exclude "):
                out["exclude"][name.split()[1]] = value
            else:
                out[name] = value
    return out, unknown
