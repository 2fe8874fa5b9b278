"""Rules of a corpus: regular expressions, label maps, marker and keyword lists from a JSON file, as column builders.

The file may be named in an environment variable; where that one can't be read the given default holds. Rules are small
and read on the driver; what runs on the executors are built-in expressions made from them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import warnings
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names the file that takes the place of the default.
VARIABLE = "PAGEMILL_RULES"
_FLAGS = {"IGNORECASE": "i", "MULTILINE": "m", "DOTALL": "s", "I": "i", "M": "m", "S": "s"}


@dataclass(frozen=True)
class RegexRule:
    """A pattern, its replacement (groups as ``\\1`` or ``\\g<1>``) and flags by name."""

    pattern: str
    replacement: str = ""
    flags: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        re.compile(self.pattern)
        if unknown := [x for x in self.flags if x.upper() not in _FLAGS]:
            raise ValueError(f"unknown flags: {unknown}")

    @property
    def java(self) -> str:
        signs = "".join(sorted({_FLAGS[x.upper()] for x in self.flags}))
        return (f"(?{signs})" if signs else "") + self.pattern

    @property
    def to(self) -> str:
        """The replacement in the form of the JVM: dollar signs are literal, groups are ``$1``."""
        return re.sub(r"\\g<(\d+)>|\\(\d)", lambda m: f"${m[1] or m[2]}", self.replacement.replace("$", "\\$"))

    def sub(self, column: Column) -> Column:
        return F.regexp_replace(column, self.java, self.to)

    def override(self, column: Column) -> Column:
        """The replacement in place of the whole text, where the pattern occurs."""
        return F.when(column.rlike(self.java), F.lit(self.replacement)).otherwise(column)


@dataclass(frozen=True)
class Ruleset:
    title_fixes: tuple[RegexRule, ...] = ()
    text_fixes: tuple[RegexRule, ...] = ()
    label_fixes: tuple[RegexRule, ...] = ()
    label_overrides: tuple[RegexRule, ...] = ()
    label_map: dict[str, str] = field(default_factory=dict)
    markers: dict[str, tuple[str, ...]] = field(default_factory=dict)
    keywords: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, data: dict) -> Ruleset:
        if not isinstance(data, dict):
            raise ValueError("a ruleset is a JSON object")
        rules = {k: tuple(RegexRule(x["pattern"], x.get("replacement", ""), tuple([x["flags"]] if isinstance(x.get("flags"), str) else x.get("flags") or ())) for x in data.get(k) or ()) for k in ("title_fixes", "text_fixes", "label_fixes", "label_overrides")}
        lists = {k: {name: tuple([v] if isinstance(v, str) else v) for name, v in (data.get(k) or {}).items()} for k in ("markers", "keywords")}
        return cls(**rules, label_map=dict(data.get("label_map") or {}), **lists)

    def fixed_text(self, column: Column) -> Column:
        for rule in self.text_fixes:
            column = rule.sub(column)
        return column

    def fixed_label(self, column: Column) -> Column:
        for rule in self.label_fixes:
            column = rule.sub(column)
        for rule in self.label_overrides:
            column = rule.override(column)
        return column

    def mapped_label(self, column: Column) -> Column:
        """The text of the first entry whose pattern occurs, else the label itself."""
        out = column
        for pattern, to in reversed(self.label_map.items()):
            out = F.when(column.rlike(pattern), F.lit(to)).otherwise(out)
        return out

    def marked(self, column: Column, name: str) -> Column:
        """Whether a text holds a marker of a list."""
        hit = F.lit(False)
        for term in self.markers.get(name, ()):
            hit = hit | F.contains(column, F.lit(term))
        return hit

    def without_marked_lines(self, column: Column, name: str) -> Column:
        """A text without the lines that hold a marker of a list."""
        return F.array_join(F.filter(F.split(column, "\n"), lambda x: ~self.marked(x, name)), "\n")

    def keyword_hits(self, column: Column, name: str) -> Column:
        """How many keywords of a list a text holds."""
        return sum((F.contains(column, F.lit(k)).cast("int") for k in self.keywords.get(name, ())), F.lit(0))


def load(default: str | dict) -> Ruleset:
    """The rules that the environment names, else the default (a path or the object itself)."""
    named = os.environ.get(VARIABLE, "").strip()
    if named:
        try:
            with open(named, encoding="utf-8") as f:
                return Ruleset.of(json.load(f))
        except (OSError, ValueError, KeyError, TypeError, re.error) as e:
            warnings.warn(f"rules {named} can't be read ({e}); the default holds", stacklevel=2)
    if isinstance(default, dict):
        return Ruleset.of(default)
    with open(default, encoding="utf-8") as f:
        return Ruleset.of(json.load(f))


@dataclass(frozen=True)
class Profile:
    """Settings of a run; ``with_overrides`` takes nested or dotted keys, and equal settings have one hash."""

    chunk_max_tokens: int = 512
    chunk_overlap_tokens: int = 50
    table_min_cells: int = 4
    table_max_cells: int = 200
    table_head_rows: int = 10
    table_tail_rows: int = 5
    scrub_private: bool = True

    def with_overrides(self, overrides: dict) -> Profile:
        flat = {k.rpartition(".")[2]: v for k, v in _flat(overrides).items()}
        if unknown := set(flat) - {f.name for f in fields(self)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **flat)

    @property
    def hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def _flat(x: dict, prefix: str = "") -> dict:
    out = {}
    for k, v in x.items():
        out |= _flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out
