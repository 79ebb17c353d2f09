"""License scans: Aho-Corasick finds identifier tags and notice phrases; licence expressions are parsed and evaluated.

Texts are reduced to lower-case words, and one automaton finds all phrases and tags in a single pass. What follows a tag
on its line is read as an expression of identifiers with and, or, with and parentheses: a shunting-yard parser turns it
into postfix form, which is evaluated against the permissive identifiers. After a tag with a colon any well-formed
identifier is a licence, labelled by its name and not permissive unless listed as such; in prose, without a colon, only
those of IDS are, and an operator in lower case counts only before one of them or a bracket. What follows with has to
be one of EXCEPTIONS.

An expression ends where a licence or a closed bracket is followed by white space or punctuation. One that breaks off
elsewhere (after an operator, in an open bracket, at a slash) is unresolved: it adds the label unknown, and permissive
is null unless another expression is not permissive.

score is 1 less the product of the doubts of all kinds of finds: a tag with a valid expression 0, an unresolved one 0.5,
a notice 0.1, a base phrase 0.2; 0 without finds.

Cases: null and empty texts have no words, no labels ('') and null places. Places may overlap. A tag that no licence
follows adds nothing. Repeated rows are scanned alike, null doc_ids pass through, and long texts are scanned whole, in
time linear in their length. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of words and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "apache license": "apache", "apache software license": "apache", "mit license": "mit", "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "creative commons": "cc", "cc0": "cc0", "isc license": "isc",
    "public domain": "public-domain", "boost software license": "bsl", "unlicense": "unlicense", "artistic license": "artistic", "zlib license": "zlib",
}
TAGS = ["spdx license identifier", "licensed under", "license id"]
PERMISSIVE = ["0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc0-1.0", "isc", "mit", "unlicense", "zlib"]
IDS = [
    *PERMISSIVE, "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "apache-1.1", "artistic-2.0", "cc-by-4.0", "cc-by-nc-4.0", "cc-by-sa-4.0", "cddl-1.0",
    "epl-1.0", "epl-2.0", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "lgpl-2.1", "lgpl-2.1-only",
    "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later", "mpl-1.1", "mpl-2.0",
]
EXCEPTIONS = [
    "389-exception", "autoconf-exception-2.0", "autoconf-exception-3.0", "bison-exception-2.2", "bootloader-exception", "classpath-exception-2.0",
    "clisp-exception-2.0", "digirule-foss-exception", "ecos-exception-2.0", "fawkes-runtime-exception", "fltk-exception", "font-exception-2.0",
    "freertos-exception-2.0", "gcc-exception-2.0", "gcc-exception-3.1", "gnu-javamail-exception", "gpl-3.0-linking-exception",
    "gpl-3.0-linking-source-exception", "gpl-cc-1.0", "i2p-gpl-java-exception", "lgpl-3.0-linking-exception", "libtool-exception",
    "linux-syscall-note", "llvm-exception", "lzma-exception", "mif-exception", "ocaml-lgpl-linking-exception", "openjdk-assembly-exception-1.0",
    "openvpn-openssl-exception", "qt-gpl-exception-1.0", "qt-lgpl-exception-1.1", "qwt-exception-1.0", "swift-exception", "u-boot-exception-2.0",
    "universal-foss-exception-1.0", "wxwindows-exception-3.1",
]
BINDS = {"or": 1, "and": 2, "with": 3}
NO_IDS = ["none", "noassertion"]  # what tags say when they name no licence
UNKNOWN = "unknown"

_words = bytes(0x20 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_id = re.compile(r"(?:documentref-[a-z0-9.-]+:)?[a-z0-9.-]+\+?")
_colon = re.compile(rb"[ \t]*:[ \t]*")
_gap = re.compile(rb"[ \t]*(?:the[ \t]+)?", re.I)
_token = re.compile(rb"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_ended = re.compile(rb"$|[\s,;.)\"'*<>]", re.A)


def postfix(line: bytes, any_id: bool = False, at: int = 0) -> list[str] | None:
    """The expression that begins at a place of line, in postfix form with names in lower case; [] if it is unresolved,
    None if no licence begins there.

    Its licences are those of IDS, or any well-formed identifiers.
    """
    out: list[str] = []
    stack: list[str] = []
    ready, depth, end = False, 0, at  # whether an operand has just ended, open brackets, where

    def licence(name: str) -> bool:
        return name.rstrip("+") in IDS or (any_id and name not in NO_IDS and name not in BINDS and bool(_id.fullmatch(name)))

    def following(at: int) -> bool:
        m = _token.match(line, at)
        return bool(m) and (m[1] == b"(" or licence(_name(m)))

    while m := _token.match(line, at):
        name = _name(m)
        if m[1] == b"(" and not ready:
            stack.append("(")
            depth += 1
        elif m[1] == b")" and ready and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif name in BINDS and ready and (any_id or depth or m[2].isupper() or name == "with" or following(m.end())):
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[name]:
                out.append(stack.pop())
            stack.append(name)
            ready = False
        elif name and not ready and (name in EXCEPTIONS if stack and stack[-1] == "with" else licence(name)):
            out.append(name)
            ready = True
        else:
            break
        at = m.end()
        end = at - (len(m[2]) - len(m[2].rstrip(b".:")) if m[2] else 0)
    if ready and not depth and (_ended.match(line, end) or end < at):
        return out + stack[::-1]
    return [] if out or (stack and any_id) else None


def _name(m: re.Match) -> str:
    return (m[2] or b"").decode().lower().rstrip(".:")


def evaluate(terms: list[str]) -> tuple[bool, set[str]]:
    """Whether the terms of a postfix expression can be met with permissive licences alone, and all its licences."""
    stack: list[tuple[bool, set[str]]] = []
    for x in terms:
        if x == "with":  # an exception only adds permissions
            stack.pop()
        elif x in BINDS:
            (a, left), (b, right) = stack.pop(), stack.pop()
            stack.append((a and b if x == "and" else a or b, left | right))
        else:
            stack.append((x.rstrip("+") in PERMISSIVE, {x.rstrip("+")}))
    return stack[0]


@cache
def _automaton():
    found = ahocorasick.Automaton()
    for phrase in dict.fromkeys([*BASE, *NOTICES, *TAGS]):
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    plain = raw.translate(_words)
    words = plain.split()
    flat = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    places, base, labels, expressions, verdicts, tags = [], set(), set(), [], [], []
    before, at = 0, 0  # words that end before at
    for end, phrase in _automaton().iter(flat):
        before, at = before + flat.count(" ", at, end), end
        first = before - _sizes[phrase]
        if phrase in BASE:
            places.append(first)
            base.add(BASE[phrase])
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
        if phrase in TAGS:
            tags.append(before - 1)
    doubt = (0.2 if base else 1.0) * (0.1 if labels else 1.0)
    if tags:
        there = np.frombuffer(b" " + plain, np.uint8) != 0x20
        begins = np.flatnonzero(there[1:] & ~there[:-1])
        for last in tags:
            at = int(begins[last]) + len(words[last])
            colon = _colon.match(raw, at)
            at = colon.end() if colon else _gap.match(raw, at).end()
            terms = postfix(raw, bool(colon), at)
            if terms:
                ok, names = evaluate(terms)
                labels |= names
                expressions.append(" ".join(terms))
                verdicts.append(ok)
                doubt = 0.0
            elif terms is not None:
                labels.add(UNKNOWN)
                verdicts.append(None)
                doubt *= 0.5
    permissive = False if False in verdicts else None if None in verdicts or not verdicts else True
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)),
            1 - doubt, expressions, permissive)


_sizes = {p: len(p.split()) for p in [*BASE, *NOTICES, *TAGS]}


FIELDS = [
    ("n_words", "long", pa.int64()), ("n_base", "long", pa.int64()), ("first_word", "long", pa.int64()), ("last_word", "long", pa.int64()),
    ("base_labels", "string", pa.string()), ("labels", "string", pa.string()), ("score", "double", pa.float64()),
    ("expressions", "array<string>", pa.list_(pa.string())), ("permissive", "boolean", pa.bool_()),
]


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id and the finds of every row of docs(doc_id, text); expressions are in postfix form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan(x.as_py()) for x in batch.column(1)]
            cols = [pa.array([g[i] for g in got], kind) for i, (_, _, kind) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *(n for n, _, _ in FIELDS)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} {t}" for n, t, _ in FIELDS))


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
