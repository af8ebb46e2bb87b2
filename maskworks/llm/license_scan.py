"""License scans: ordered signature rules behind a prefilter of literals.

A text is brought to words (see ``WORD_BYTES``) joined by spaces. A rule is tried only where one
of the strings stands in it without which the rule cannot match. Where detections overlap, one contained in another's interval falls to it if
that other has at least its priority; of equal intervals the earlier rule stays. Detections of the
base phrases are never suppressed.
"""

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import BASE_PHRASES, rules

_SEPARATORS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
#: Lower-cases A-Z, then turns every byte outside 0-9, a-z and 0x80-0xFF into a space.
TRANSLATE = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _SEPARATORS else b for b in range(256))


@lru_cache(1)
def _by_needs() -> dict[tuple[bytes, ...], list]:
    """Rules by the strings of which every match of theirs has one; a rule that needs none would be tried everywhere."""
    gates = defaultdict(list)
    for at, rule in enumerate(rules()):
        pattern = re.compile(f"(?<= )(?:{rule.pattern})(?= )".encode())
        gates[tuple(s.encode() for s in rule.needs)].append((at, rule, pattern))
    return dict(gates)


def normal_form(text: str | None) -> tuple[bytes, int]:
    """(words joined and surrounded by spaces, number of words)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TRANSLATE).split()
    return b" " + b" ".join(words) + b" ", len(words)


def _places(norm: bytes, phrase: bytes) -> list[int]:
    """Where a space-surrounded phrase begins, overlapping places too."""
    found, at = [], norm.find(phrase)
    while at >= 0:
        found.append(at + 1)
        at = norm.find(phrase, at + 1)
    return found


def _overlapping(hits: list) -> Iterator[list]:
    """Runs of hits whose intervals overlap; hits of different runs cannot contain each other."""
    group, end = [], -1
    for hit in sorted(hits, key=lambda h: h[:3]):
        if group and hit[0] >= end:
            yield group
            group, end = [], -1
        group.append(hit)
        end = max(end, hit[1])
    if group:
        yield group


def detect(norm: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
    """(base places, kept detections of the rules), each (start byte, end byte, label, ...)."""
    base = [(at, at + len(phrase), label) for label, phrase in BASE_PHRASES for at in _places(norm, f" {phrase} ".encode())]
    hits = []
    for needs, gated in _by_needs().items():
        if not needs or any(s in norm for s in needs):
            hits += [(m.start(), m.end(), at, rule) for at, rule, pattern in gated for m in pattern.finditer(norm)]
    kept: list = []
    for group in _overlapping(hits):
        own = _Intervals([h[0] for h in group])
        for a, b, _, rule in sorted(group, key=lambda h: (h[3].priority, h[0] - h[1], h[2], h[0])):
            if not own.covers(a, b):
                own.add(a, b)
                kept.append((a, b, rule.label, rule.confidence))
    return sorted(base), sorted(kept)


class _Intervals:
    """Intervals that begin at known places, asked whether one of them covers another; each step takes logarithmic time."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.furthest = [-1] * (len(self.starts) + 1)

    def add(self, start: int, stop: int) -> None:
        i = bisect_left(self.starts, start) + 1
        while i < len(self.furthest):
            self.furthest[i] = max(self.furthest[i], stop)
            i += i & -i

    def covers(self, start: int, stop: int) -> bool:
        i = bisect_right(self.starts, start)
        while i:
            if self.furthest[i] >= stop:
                return True
            i -= i & -i
        return False


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, plus the findings of each row.

    New columns: ``n_words``, ``base`` and ``found`` (arrays of structs of word interval and label; ``found``
    also has a confidence), ``score`` (the largest confidence, 1.0 for a base phrase, 0.0 without a finding).
    Null and empty texts have no words and no findings; very long ones take time in proportion to their
    length and findings. Rows are handled one by one: repeated rows, ties,
    null keys and empty tables need no care. Columns with one of the new names are replaced.
    """
    made = "n_words long, base array<struct<start:long,stop:long,label:string>>, found array<struct<start:long,stop:long,label:string,confidence:double>>, score double"
    names = ["n_words", "base", "found", "score"]
    kept = [c for c in docs.columns if c not in names and c != text]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    place = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())])
    finding = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())])

    def run(batches):
        for batch in batches:
            texts, out = batch.column(len(kept)), ([], [], [], [])
            for i in range(len(texts)):
                norm, n_words = normal_form(texts[i].as_py())
                base, found = detect(norm)
                spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32) if base or found else None
                word = lambda at, spaces=spaces: int(np.searchsorted(spaces, at)) - 1
                out[0].append(n_words)
                out[1].append([{"start": word(a), "stop": word(b) + 1, "label": label} for a, b, label in base])
                out[2].append([{"start": word(a), "stop": word(b) + 1, "label": label, "confidence": c} for a, b, label, c in found])
                out[3].append(1.0 if base else max((c for *_, c in found), default=0.0))
            fresh = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(place)), pa.array(out[2], pa.list_(finding)), pa.array(out[3], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + fresh, names=kept + names)

    schema = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in kept) + made
    return source.mapInArrow(run, schema)
