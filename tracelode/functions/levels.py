"""Level names and severities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEVERITIES = {"Verbose": 0, "Debug": 1, "Information": 2, "Warning": 3, "Error": 4, "Fatal": 5}

# Full level name, its severity, and the spellings that mean it.
SPELLINGS = (
    ("Trace", "Verbose", ("t", "tr", "trc", "trce", "trace")),
    ("Verbose", "Verbose", ("v", "ver", "vrb", "verb", "verbose")),
    ("Debug", "Debug", ("d", "de", "dbg", "deb", "dbug", "debu", "debug")),
    ("Information", "Information", ("i", "in", "inf", "info", "information")),
    ("Notice", "Information", ("notice",)),
    ("Warning", "Warning", ("w", "wa", "war", "wrn", "warn", "warning")),
    ("Error", "Error", ("e", "er", "err", "erro", "eror", "error")),
    ("Fatal", "Fatal", ("f", "fa", "ftl", "fat", "fatl", "fatal")),
    ("Critical", "Fatal", ("c", "cr", "crt", "cri", "crit", "critical")),
    ("Emergency", "Fatal", ("emerg",)),
    ("Alert", "Fatal", ("alert",)),
    ("Panic", "Fatal", ("panic",)),
)

#: The same, the spellings of a level as one text.
LEVELS = tuple((name, severity, " ".join(spellings)) for name, severity, spellings in SPELLINGS)


def _literal_map(value_of) -> str:
    """A map literal in SQL text: one expression instead of a call per entry."""
    return "map(" + ", ".join(f"'{s}', {value_of(name, severity)}" for name, severity, spellings in SPELLINGS
                              for s in spellings) + ")"


_NAMES = _literal_map(lambda name, _: f"'{name}'")
_RANKS = _literal_map(lambda _, severity: SEVERITIES[severity])


def normalise_level(level: Column) -> Column:
    """Full level name; an unknown spelling keeps its text."""
    return F.coalesce(F.try_element_at(F.expr(_NAMES), F.lower(level)), level)


def severity_of(level: Column) -> Column:
    """0 (verbose) to 5 (fatal); missing and unknown levels rank as information."""
    return F.coalesce(F.try_element_at(F.expr(_RANKS), F.lower(level)), F.lit(SEVERITIES["Information"]))


def severity_number(name: str) -> int:
    """Severity of a literal level spelling."""
    for full, severity, spellings in SPELLINGS:
        if name.lower() in spellings or name == full:
            return SEVERITIES[severity]
    raise ValueError(f"unknown level: {name}")
