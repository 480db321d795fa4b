"""Secret scan: fixed patterns, and a token-efficiency test for random strings that no pattern names.

A vocabulary learnt from text spells words in few tokens and random strings in many. Runs of code characters whose characters per token
stay below a ratio are reported as kind `random`, unless their form says that they are public by nature: digests of the usual lengths
(or listed ones) and identifiers (UUIDs, numbers, dates, words and compounds of words).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneatlas.session import ship

#: Kinds in the order in which spans that start together are named.
KINDS = ["assign", "access", "hex", "random"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_HEX_ANY = re.compile(r"[0-9a-f]+|[0-9A-F]+", re.ASCII)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: A part of an identifier: a number, or words in lower case, upper case or camel case of three letters and more each.
_PART = re.compile(r"\d+|[a-z]+|[A-Z]+|[A-Za-z][a-z]{2,}(?:[A-Z][a-z]{2,})*")
_DATE = re.compile(r"\d{4}-?\d{2}-?\d{2}T\d+Z?")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping for each kind; group 2 of an assignment has 6 characters at least."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def is_identifier(run: str) -> bool:
    """UUIDs, dates, numbers, and words or compounds of words and numbers."""
    if _UUID.fullmatch(run) or _DATE.fullmatch(run):
        return True
    return all(_PART.fullmatch(p) for p in re.split(r"[_/+=-]+", run) if p)


def is_digest(run: str, known: frozenset[str] = frozenset()) -> bool:
    """Digests that `known` lists, or hexadecimal in one case of a digest's length."""
    return run in known or len(run) in DIGESTS and _HEX_ANY.fullmatch(run) is not None


class TokenEfficiency:
    """Counts tokens of a run by a tiktoken vocabulary of ranks; longer runs than `piece` are counted piece by piece."""

    def __init__(self, path: str | None = None, pattern: str | None = None, piece: int = 1024) -> None:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = piece

    def ratio(self, run: str) -> float:
        """Characters for each token."""
        n = sum(len(self.encoding.encode_ordinary(run[i : i + self.piece])) for i in range(0, len(run), self.piece))
        return len(run) / max(n, 1)


def random_spans(text: str, ratio: Callable[[str], float], most: float = 2.2, known: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """Runs of 16 characters and more, of at least two of lower case, upper case and digits, with less than `most` characters a token."""
    out = []
    for m in _RUN.finditer(text):
        run = m[0].strip("=-_/+")
        if len(run) < 16 or run.isdigit() or (run.isalpha() and (run.islower() or run.isupper() or run.istitle())):
            continue
        if is_digest(run, known) or is_identifier(run) or ratio(run) >= most:
            continue
        at = m.start() + m[0].index(run)
        out.append(("random", at, at + len(run)))
    return out


def scan(text: str, ratio: Callable[[str], float], most: float = 2.2, known: frozenset[str] = frozenset()) -> tuple[list, list]:
    """(base spans, all spans), each in the order of start and kind. A random run inside a base span is not named again."""
    rank = KINDS.index
    base = sorted(base_spans(text), key=lambda s: (s[1], rank(s[0])))
    added = [s for s in random_spans(text, ratio, most, known) if not any(a <= s[1] and s[2] <= b for _, a, b in base)]
    return base, sorted(base + added, key=lambda s: (s[1], rank(s[0])))


_made: dict[tuple, TokenEfficiency] = {}

FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, most: float = 2.2, known: Iterable[str] = (), vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans (kind:start:end in code points, end exclusive).

    base_sha256 is that of the spans of the fixed patterns alone. One pass without a shuffle; a task holds one Arrow batch. Null texts are empty and have no
    span; repeated rows and null doc_ids are rows of their own; an empty table gives an empty result; further columns are ignored, whatever their names.
    `known` is a list of public digests that every task holds. `vocabulary` is the path of a file of tiktoken ranks.
    """
    ship(docs.sparkSession)
    listed = frozenset(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary,)
        if key not in _made:
            _made[key] = TokenEfficiency(vocabulary)
        ratio = _made[key].ratio
        name = lambda spans: ",".join([f"{k}:{a}:{b}" for k, a, b in spans])
        for batch in batches:
            counts, shas, spans = ([], [], [], []), [], []
            for value in batch.column(1):
                base, every = scan(value.as_py() or "", ratio, most, listed)
                for k, c in zip(KINDS, counts, strict=True):
                    c.append(sum(s[0] == k for s in every))
                shas.append(hashlib.sha256(name(base).encode()).hexdigest())
                spans.append(name(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, FOUND)


def masked(docs: DataFrame, mask: str = "[secret]", text: str = "text", **how) -> DataFrame:
    """docs with every secret of `text` replaced by `mask`; overlapping spans are one. Other columns stay as they are; null texts stay null."""
    ship(docs.sparkSession)
    most, listed, vocabulary = how.get("most", 2.2), frozenset(how.get("known", ())), how.get("vocabulary")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = (vocabulary,)
        if key not in _made:
            _made[key] = TokenEfficiency(vocabulary)
        for texts in batches:
            out = []
            for t in texts:
                if t is None:
                    out.append(None)
                    continue
                parts, at = [], 0
                for a, b in _joined(scan(t, _made[key].ratio, most, listed)[1]):
                    parts += [t[at:a], mask]
                    at = b
                out.append("".join([*parts, t[at:]]))
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text, F.pandas_udf(run, "string")(F.col(text)))


def _joined(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for _, a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
