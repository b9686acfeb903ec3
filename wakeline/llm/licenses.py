"""Licence scan: an Aho-Corasick automaton over words and tags, a shunting-yard parser for expressions.

One pass over each whole text, row by row in Arrow batches: nothing is shuffled and
no text is cut. Notice phrases are matched on the lower-cased words; identifier tags
are found in the raw text and the expression behind a tag is parsed to postfix form
(WITH before AND before OR) and evaluated against a table of permission levels.

Cases: a null text counts as empty and yields zero counts, null places, empty labels
and score 0; a null identifier stays null; repeated rows each give a row; a broken
expression yields the licences read before the fault and no permission level; an
empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from wakeline.llm.common import id_text, text_batches

# Fixed values of the base scan: phrase and label.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notice phrases: label and confidence that a licence is meant.
NOTICES = {
    "gnu general public license version 2": ("gpl-2", 0.95),
    "gnu general public license version 3": ("gpl-3", 0.95),
    "gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "under the bsd license": ("bsd", 0.9),
    "under the isc license": ("isc", 0.9),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.9),
    "creative commons attribution sharealike": ("cc-by-sa", 0.9),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc0 1 0 universal": ("cc0", 0.9),
    "released into the public domain": ("public-domain", 0.8),
    "all rights reserved": ("all-rights-reserved", 0.5),
}
BASE_CONFIDENCE, TAG_CONFIDENCE = 0.9, 1.0
TAG = "spdx-license-identifier:"
# Permission levels: 1 permissive, 0.6 weak copyleft, 0.3 strong copyleft, 0 restricted. Longest prefix wins.
LEVELS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0,
    "cc-by": 1.0, "cc-by-sa": 0.6, "lgpl": 0.6, "mpl": 0.6, "epl": 0.6, "gpl": 0.3, "agpl": 0.3,
    "cc-by-nc": 0.0, "cc-by-nd": 0.0, "all-rights-reserved": 0.0,
}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
EXPRESSION_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")

# A-Z to a-z, the other ASCII characters that no word holds to a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def level(identifier: str) -> float | None:
    known = [name for name in LEVELS if identifier == name or identifier.startswith((name + "-", name + "+"))]
    return LEVELS[max(known, key=len)] if known else None


def canonical(identifier: str) -> str:
    """Label of an identifier: version suffixes that the labels don't carry are dropped."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier)
    for stem in ("cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by", "mpl", "epl"):
        if name == stem or name.startswith(stem + "-"):
            return stem
    return re.sub(r"^(apache|gpl|lgpl|agpl)-(\d+)(\.0)?$", r"\1-\2", name)


def to_postfix(tokens: list[str]) -> tuple[list[str], bool]:
    """Postfix form of the longest readable expression, and whether it was read whole."""
    output: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in tokens:
        if token == "(" and operand_next:
            stack.append(token)
        elif token == ")" and not operand_next and "(" in stack:
            while stack[-1] != "(":
                output.append(stack.pop())
            stack.pop()
        elif token in PRECEDENCE and not operand_next:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                output.append(stack.pop())
            stack.append(token)
            operand_next = True
        elif token not in PRECEDENCE and token not in "()" and operand_next:
            output.append(token)
            operand_next = False
        else:
            break  # what follows is prose
    whole = not operand_next and "(" not in stack
    output += [token for token in reversed(stack) if token != "("]
    return output, whole


def evaluate(postfix: list[str]) -> tuple[set[str], float | None]:
    """Licences that take part, and the level: the least for AND, the greatest for OR, the licence's own for WITH."""
    stack: list[tuple[set[str], float | None]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append(({canonical(token)}, level(token)))
            continue
        (names, own), (other_names, other) = stack.pop(-2), stack.pop()
        if token == "with":
            stack.append((names, own))  # the exception's name is no licence
        elif own is None or other is None:
            # An unknown licence can only lower AND, and a known one still offers OR.
            known = [x for x in (own, other) if x is not None]
            stack.append((names | other_names, max(known) if known and token == "or" else None))
        else:
            stack.append((names | other_names, (min if token == "and" else max)(own, other)))
    return stack[-1] if stack else (set(), None)


def read_expression(text: str) -> tuple[set[str], float | None]:
    """Licences and level of the expression at the start of a lower-cased line."""
    tokens = EXPRESSION_TOKEN.findall(text)
    postfix, whole = to_postfix(tokens)
    if whole:
        return evaluate(postfix)
    names = {canonical(t) for i, t in enumerate(postfix) if t not in PRECEDENCE}
    return names, None


@lru_cache(maxsize=1)
def automaton():
    """Space-framed phrases over words; texts and phrases are read as Latin-1, a character for each byte."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase, label in BASE_PHRASES.items():
        machine.add_word(f" {phrase} ", (len(phrase) + 2, label, BASE_CONFIDENCE, True))
    for phrase, (label, confidence) in NOTICES.items():
        machine.add_word(f" {phrase} ", (len(phrase) + 2, label, confidence, False))
    machine.make_automaton()
    return machine


@lru_cache(maxsize=1)
def tag_automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    machine.add_word(TAG, len(TAG))
    machine.make_automaton()
    return machine


def scan_text(raw: bytes) -> dict:
    """Counts, base places, spans (label, first word, words, kind) and the evaluated tags of one text."""
    words = raw.translate(_WORD_BYTES).split()
    framed = (b" " + b" ".join(words) + b" ").decode("latin-1")
    spans: list[tuple[str, int, int, str]] = []
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    score, seen, at = 0.0, 0, 0
    hits = sorted((end - size + 1, size, label, confidence, is_base)
                  for end, (size, label, confidence, is_base) in automaton().iter(framed))
    for start, size, label, confidence, is_base in hits:
        seen += framed.count(" ", at, start)  # spaces before the leading one
        at = start
        labels.add(label)
        score = max(score, confidence)
        spans.append((label, seen, framed.count(" ", start, start + size) - 1, "base" if is_base else "notice"))
        if is_base:
            base.append(seen)
            base_labels.add(label)
    lowered = raw.lower()
    levels: list[float] = []
    unknown = False
    if b"spdx" in lowered:
        text = lowered.decode("latin-1")
        for end, _ in tag_automaton().iter(text):
            stop = text.find("\n", end)
            names, own = read_expression(text[end + 1 : stop if stop >= 0 else len(text)])
            labels |= names
            spans += [(name, -1, 0, "tag") for name in sorted(names)]
            if names:
                score = TAG_CONFIDENCE
            unknown |= own is None
            levels += [] if own is None else [own]
    for label in {s[0] for s in spans if s[3] != "tag"}:
        own = level(label)
        unknown |= own is None
        levels += [] if own is None else [own]
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(base) if base else None,
        "last_word": max(base) if base else None, "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(labels)), "score": score,
        "permission": min(levels) if levels and not unknown else None,
        "spans": [dict(zip(("label", "first", "words", "kind"), s)) for s in spans],
    }


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string,"
    " labels string, score double, permission double,"
    " spans array<struct<label:string, first:bigint, words:bigint, kind:string>>"
)
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("kind", pa.string())])
_TYPES = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "permission": pa.float64(),
    "spans": pa.list_(_SPAN),
}


def _scan(batches):
    for ids, texts in text_batches(batches):
        found = [scan_text(text.as_buffer().to_pybytes()) for text in texts]
        yield pa.RecordBatch.from_arrays(
            [ids, *[pa.array([f[name] for f in found], kind) for name, kind in _TYPES.items()]], ["doc_id", *_TYPES]
        )


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, labels, score, permission level and the spans found."""
    return id_text(docs).mapInArrow(_scan, SCHEMA)
