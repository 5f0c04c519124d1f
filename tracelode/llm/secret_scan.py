"""Secrets in texts: three fixed shapes, and random strings that a tokenizer can't compress.

A run of letters, digits and ``+/_=-`` that a byte-pair vocabulary needs many tokens for is random: natural words, names and
paths have three or more characters a token, random letters and digits about one and a half. Runs whose form says what
they are (digests, UUIDs, numbers, words and names joined from words) are left out first. Patterns are first tried on
whole columns of texts, so only texts that have a match of a kind are scanned for it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .blocks import slices, text_array

KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]


def _either_case(words: str) -> str:
    """Only ASCII letters have two cases here: flags of regular expressions would add others that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: Fixed patterns. Matches are leftmost and don't overlap; those that ``passes`` turns down are dropped afterwards.
PATTERNS = {
    "assign": "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{32,}",
    "random": "[A-Za-z0-9+/_=-]{20,}",
}
_LEAST = {"access": 16, "hex": 32}
#: A run is random if it has fewer characters a token than this.
CHARACTERS_A_TOKEN = 1.9
#: Runs are tokenized in stretches of so many characters, so that the cost of a very long one stays linear.
STRETCH = 512
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
_DIGEST = re.compile("|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in DIGEST_LENGTHS))
#: The base64 form of a digest in a lock or integrity file, and a UUID.
_NAMED_DIGEST = re.compile(r"(sha(1|224|256|384|512)|md5)[-=_].+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: The parts of a name: split at marks and before a capital that begins a word. Digits end a part.
_EDGE = re.compile(r"[+/_=-]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_PART = re.compile(r"[A-Z]?[a-z]+[0-9]*|[A-Z]+[0-9]*|[0-9]+")
SPAN = "struct<kind: string, start: bigint, end: bigint>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def _encoding(ranks: bytes):
    import public_tokenizers
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines())
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs})


def is_known(run: str) -> bool:
    """Whether the form of a run says that it is a digest, a UUID, a number, a word or a name joined from words.

    A name of several parts has four characters a part or more: random strings fall into shorter ones.
    """
    if _DIGEST.fullmatch(run) or _NAMED_DIGEST.fullmatch(run) or _UUID.fullmatch(run):
        return True
    parts = [p for p in _EDGE.split(run) if p]
    return all(p.isdigit() for p in parts) or sum(map(len, parts)) >= 4 * len(parts) and all(map(_PART.fullmatch, parts))


def characters_a_token(run: str, encoding) -> float:
    return len(run) / sum(len(encoding.encode_ordinary(run[at:at + STRETCH])) for at in range(0, len(run), STRETCH))


def _base_spans(kind: str, text: str) -> Iterator[tuple[int, int]]:
    for match in _COMPILED[kind].finditer(text):
        if kind == "assign":
            if len(match[2]) >= 8:
                yield match.span()
        elif match.end() - match.start() >= _LEAST[kind]:
            yield match.span()


_COMPILED = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}


def spans_of(text: str, kinds, encoding, threshold: float) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start and kind. A random run that lies in a span of a base kind is not named again."""
    found = sorted((start, KINDS.index(kind), end) for kind in BASE_KINDS if kind in kinds for start, end in _base_spans(kind, text))
    if "random" in kinds:
        extra, i, reach = [], 0, 0
        for match in _COMPILED["random"].finditer(text):
            while i < len(found) and found[i][0] <= match.start():
                reach = max(reach, found[i][2])
                i += 1
            run = match.group()
            if reach < match.end() and not is_known(run) and characters_a_token(run, encoding) < threshold:
                extra.append((match.start(), KINDS.index("random"), match.end()))
        found = sorted(found + extra)
    return [(start, end, KINDS[kind]) for start, kind, end in found]


def find_secrets(documents: DataFrame, vocabulary: str | None = None, threshold: float = CHARACTERS_A_TOKEN) -> DataFrame:
    """All rows and columns of ``documents`` but ``text``, with ``secrets``: an array of (kind, start, end), in code points, end exclusive.

    Kinds are ``assign`` (a value given to a name that says secret), ``access``, ``hex`` and ``random``. A null or
    empty text has none. Texts of any length are scanned whole; a row's array grows with what its text holds.
    Repeated rows are judged one by one. A column ``secrets`` of ``documents`` is replaced. Texts aren't shuffled. ``vocabulary`` is
    read on the driver and sent to the tasks (under a megabyte).
    """
    with open(vocabulary or default_vocabulary(), "rb") as file:
        ranks = file.read()
    carried = [c for c in documents.columns if c.lower() not in ("secrets", "text")]
    source = documents.select(*carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks)
        for batch in batches:
            for part in slices(batch, "text"):
                texts, kinds = text_array(part), {}
                for kind, pattern in PATTERNS.items():
                    for i in pc.indices_nonzero(pc.match_substring_regex(texts, pattern)).to_pylist():
                        kinds.setdefault(i, set()).add(kind)
                rows = [[] for _ in range(len(texts))]
                for i, own in kinds.items():
                    rows[i] = [{"kind": k, "start": a, "end": b} for a, b, k in spans_of(texts[i].as_py(), own, encoding, threshold)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(rows, pa.list_(span))], names=[*carried, "secrets"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name != "text")
    return source.mapInArrow(scan, f"{fields}secrets array<{SPAN}>")


def secret_report(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every row, see :func:`find_secrets`."""

    def joined(kinds) -> "F.Column":
        own = F.filter("secrets", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    found = find_secrets(documents.select("doc_id", "text"), vocabulary)
    return found.select("doc_id", *map(number, BASE_KINDS), F.sha2(joined(BASE_KINDS), 256).alias("base_sha256"),
                        joined(KINDS).alias("spans"), number("random"))
