"""License scan with ordered signature rules.

Rules are regular expressions for notices, links, tags, names and fields of licenses, written by hand in ``license_rules``. A
keyword automaton reads each text once; only rules whose own keyword occurs are tried. Detections may overlap: one that lies
inside a detection of a better or equal priority is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlight.llm.batches import record_batch, slices
from spanlight.llm.common import ship
from spanlight.llm.license_rules import COMMON, KINDS

#: Word bytes of the base rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

#: Phrases that always count, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Word characters and gaps are those of the base rule, so every character beyond ASCII belongs to a word.
LETTER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
PARTS = {
    "LIC:": rf"licen[sc]e(?:(?![:=]){GAP})*+[:=]{GAP}++",
    "LIC": "licen[sc]e",
    " VER": rf"(?:{GAP}++(?:v(?:er|ersion)?{GAP}*+)?[0-9]+(?:{GAP}[0-9]+)?)?",
    "NUM": rf"v?[0-9]+(?:{GAP}[0-9]+)?",
}


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    priority: int  # smaller is better
    order: int
    keyword: str
    pattern: re.Pattern
    confidence: float


def signature_pattern(signature: str, link: bool) -> str:
    """The regular expression of a signature: parts filled in, blanks as gaps, whole words."""
    if link:
        return signature
    text = re.sub("LIC: ?|LIC| VER|NUM", lambda m: PARTS[m.group().rstrip() if m.group().startswith("LIC:") else m.group()].replace(" ", "\0"), signature)
    text = text.replace(" ?", f"{GAP}?").replace(" ", f"{GAP}++").replace("\0", " ")
    return rf"(?<!{LETTER}){text}(?!{LETTER})"


def keyword_of(signature: str) -> str:
    """The longest literal that every match contains, if possible one that is no common word."""
    plain = signature
    while plain != (plain := re.sub(r"\((?:[^()])*\)\??", "#", plain)):
        pass
    plain = re.sub(r"\\\.", ".", plain.replace("LIC:", "licen").replace("LIC", "licen").replace(" VER", "").replace("NUM", "#"))
    plain = re.sub(r"\[[^]]*\]|\.\{[^}]*\}\??|.\?|(?<![a-z])\.(?![a-z])", "#", plain)
    words = [w.strip(".-/_") for w in re.findall(r"[a-z0-9./_-]+", plain)]
    return max([w for w in words if w not in COMMON] or words, key=len)


@lru_cache(maxsize=1)
def rules() -> tuple[list[Rule], ahocorasick.Automaton]:
    """All rules in order, and the automaton from keywords to rules."""
    made: list[Rule] = []
    for rank, (kind, table, confidence) in enumerate(KINDS):
        for line in table.strip().splitlines():
            label, signature = line.split(" | ", 1)
            pattern = re.compile(signature_pattern(signature, kind == "link"), re.DOTALL)
            made.append(Rule(label, kind, rank, len(made), keyword_of(signature), pattern, confidence))
    automaton = ahocorasick.Automaton()
    by_word: dict[str, list[int]] = {}
    for k, rule in enumerate(made):
        by_word.setdefault(rule.keyword, []).append(k)
    for keyword, found in by_word.items():
        automaton.add_word(keyword, found)
    automaton.make_automaton()
    return made, automaton


def detections(lowered: str) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) of a lower-cased text, by start; suppressed ones are gone.

    A detection goes if its interval lies inside that of a detection of a better priority, or of a longer one of
    the same priority; of equal intervals the first rule stays.
    """
    made, automaton = rules()
    wanted: set[int] = set()
    for _, found in automaton.iter(lowered):
        wanted.update(found)
    return suppress([(m.start(), m.end(), made[k]) for k in sorted(wanted) for m in made[k].pattern.finditer(lowered)])


def suppress(hits: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Interval containment, in one pass over the hits from the best priority to the worst.

    Kept intervals none of which contains another stay sorted by start and so by end; a hit is inside one
    of them just when it is inside the last that starts at or before it.
    """
    starts: list[int] = []
    ends: list[int] = []
    kept: list[tuple[int, int, Rule]] = []
    for start, end, rule in sorted(hits, key=lambda h: (h[2].priority, h[0] - h[1], h[2].order, h[0])):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, rule))
        # The new interval may contain kept ones; the frontier then keeps only the larger.
        if at and starts[at - 1] == start:
            at -= 1
        upto = at
        while upto < len(starts) and ends[upto] <= end:
            upto += 1
        starts[at:upto], ends[at:upto] = [start], [end]
    return sorted(kept, key=lambda h: (h[0], h[1]))


def base_places(lowered: bytes) -> tuple[list[int], list[str]]:
    """Starts (in words) and labels of the base phrases."""
    words = WORD.findall(lowered)
    at, labels = [], []
    for phrase, label in BASE.items():
        parts = phrase.encode().split()
        for k in [k for k, w in enumerate(words) if w == parts[0]]:
            if words[k : k + len(parts)] == parts:
                at.append(k)
                labels.append(label)
    return at, labels


OUTPUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"
ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_detections", pa.int64())]
)
SPANS = "doc_id long, start long, end long, label string, kind string, confidence double"
SPANS_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("kind", pa.string()), ("confidence", pa.float64())]
)


def ascii_lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: words, base phrase places and labels, all labels, score.

    ``score`` is the best confidence of what was found (base phrases count 0.9), 0 if nothing was. Null text
    counts as empty: 0 words, null places, empty labels. Whole texts are read; there is no shuffle.
    """
    ship(docs.sparkSession)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            rows = []
            for text in texts:
                lowered = ascii_lowered(text)
                n_words = len(lowered.translate(TO_WORDS).split())
                at, base = base_places(lowered) if b"license" in lowered else ([], [])
                found = detections(lowered.decode())
                labels = sorted({r.label for _, _, r in found}.union(base))
                score = max([r.confidence for _, _, r in found] + [0.9] * bool(base), default=0.0)
                rows.append((n_words, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(set(base))), ",".join(labels), score, len(found)))
            columns = dict(zip(ARROW.names[1:], zip(*rows, strict=True), strict=True))
            yield record_batch(ARROW, doc_id=part.column(0), **columns)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUTPUT)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per detection that is not suppressed: doc_id, start and end (characters), label, kind, confidence."""
    ship(docs.sparkSession)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            rows = [
                (i, s, e, r.label, r.kind, r.confidence)
                for i, text in zip(part.column(0).to_pylist(), texts, strict=True)
                for s, e, r in detections(ascii_lowered(text).decode())
            ]
            if rows:
                yield record_batch(SPANS_ARROW, **dict(zip(SPANS_ARROW.names, zip(*rows, strict=True), strict=True)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SPANS)
