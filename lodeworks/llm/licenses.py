"""Licence scans: notice phrases and identifier tags found by Aho-Corasick, licence expressions
evaluated by a shunting-yard parser.

A text's words are its runs of ASCII letters (lower-cased), digits and non-ASCII characters. All
phrases are sought at once in the words joined by blanks, so a phrase is found wherever its words
stand consecutively. A tag (``SPDX-License-Identifier:``) is followed by an expression of licence
names with AND, OR, WITH and brackets; its licences become labels, and it is permitted where a
choice of its alternatives asks for permitted licences alone. Names are those of the families in
``FAMILIES`` with their versions, and references (``LicenseRef-``); the first other word ends the
expression, with the operator before it.

Defined results: a null or empty text has no words and no labels, nulls for the places and score
0; a malformed expression counts as a tag without licences; repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped

#: The phrases of the base labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Phrases of further labels: label and how sure a phrase makes it.
PHRASES = {
    "mit license": ("mit", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "apache license version 2 0": ("apache-2.0", 0.9),
    "apache license": ("apache", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.7),
    "general public license version 2": ("gpl-2.0", 0.9),
    "general public license version 3": ("gpl-3.0", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons zero": ("cc0", 0.9),
    "released into the public domain": ("public-domain", 0.8),
    "confidential and proprietary": ("proprietary", 0.8),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.9),
    "isc license": ("isc", 0.7),
    "gnu gpl": ("gpl", 0.7),
    "gnu lgpl": ("lgpl", 0.7),
    "gnu agpl": ("agpl", 0.7),
    "gnu free documentation license": ("gfdl", 0.9),
    "boost software license": ("bsl-1.0", 0.9),
    "artistic license": ("artistic", 0.7),
    "zlib license": ("zlib", 0.7),
    "python software foundation license": ("psf-2.0", 0.8),
    "common development and distribution license": ("cddl", 0.9),
    "european union public licence": ("eupl", 0.9),
    "open database license": ("odbl", 0.8),
    "sil open font license": ("ofl", 0.9),
    "do what the fuck you want to public license": ("wtfpl", 0.9),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "without warranties or conditions of any kind either express or implied": ("apache-2.0", 0.6),
    "all rights are reserved": ("reserved", 0.7),
    "no part of this publication may be reproduced": ("reserved", 0.8),
}
#: Families of licence names and, as patterns, what may follow; then the names of exceptions.
FAMILIES = {
    r"a?gpl|lgpl|gfdl": r"-\d+\.\d+(?:-only|-or-later|-invariants-only|-no-invariants-only|\+)?",
    r"apache|mpl|epl|cddl|eupl|osl|afl|artistic|zpl|lppl|php|psf|python|ecl|cecill|w3c|nposl|ms|bsl|upl|sspl|odbl|odc-by|ofl|mulanpsl|polyform|unicode|bittorrent": r"(?:-[a-z0-9.]+)+\+?",
    r"bsd": r"-[0-4]-clause(?:-[a-z]+)*",
    r"cc-by": r"(?:-nc)?(?:-sa|-nd)?-\d\.\d(?:-[a-z]{2,4})?",
    r"cc0": r"-1\.0",
    r"mit": r"(?:-0|-advertising|-cmu|-feh|-modern-variant|-open-group)?",
    r"0bsd|isc|unlicense|zlib|libpng|ncsa|wtfpl|x11|curl|openssl|ruby|vim|w3c|postgresql|cecill-b|beerware|boost|tcl|icu|blessing|gpl|lgpl|agpl": "",
    r"licenseref": r"-[a-z0-9.-]+",
    r"documentref": r"-[a-z0-9.-]+:licenseref-[a-z0-9.-]+",
}
KNOWN = re.compile("|".join(f"(?:{name})(?:{rest})" for name, rest in FAMILIES.items()))
KNOWN_EXCEPTION = re.compile(r"(?:[a-z0-9.]+-)*exception(?:-[a-z0-9.]+)*|linux-syscall-note|bootloader-exception|additionref-[a-z0-9.-]+")
BASE_SURE = 0.7
BASE_WORDS = {label: len(phrase.split()) for phrase, label in BASE_PHRASES.items()}
TAG, TAG_SURE = "spdx license identifier", 0.95
#: Licences that a permitted choice may ask for, by how their names begin.
PERMITTED = ("mit", "bsd", "apache", "isc", "cc0", "cc-by-4", "cc-by-3", "unlicense", "zlib", "0bsd")
_TAG = re.compile(r"SPDX-License-Identifier\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_STRENGTH = {"or": 1, "and": 2, "with": 3}
#: Bytes of other kinds become blanks, capitals small letters.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def in_postfix(expression: str) -> list[str] | None:
    """The leading expression of a line in postfix order, by shunting-yard; None if there is none."""
    out, held, want = [], [], True  # want: an operand comes next
    depth = 0
    for m in _TOKEN.finditer(expression):
        low = m[0].lower()
        if want and low == "(" and "with" not in held[-1:]:
            held.append("(")
            depth += 1
        elif want and (KNOWN_EXCEPTION if held[-1:] == ["with"] else KNOWN).fullmatch(low):
            out.append(low)
            want = False
        elif not want and low in _STRENGTH:
            while held and held[-1] != "(" and _STRENGTH[held[-1]] >= _STRENGTH[low]:
                out.append(held.pop())
            held.append(low)
            want = True
        elif not want and low == ")" and depth:
            while (x := held.pop()) != "(":
                out.append(x)
            depth -= 1
        else:
            break  # what follows belongs to the prose
    while want and held and out:  # so does an operator that no name follows
        x = held.pop()
        depth -= x == "("
        want = x == "("
    if want or depth:
        return None
    return out + held[::-1]


def evaluated(expression: str) -> tuple[set[str], bool] | None:
    """The licences that an expression names, and whether it can be met with permitted ones alone."""
    postfix = in_postfix(expression)
    if postfix is None:
        return None
    stack: list[tuple[set[str], bool]] = []
    for x in postfix:
        if x not in _STRENGTH:
            stack.append(({x}, x.startswith(PERMITTED)))
            continue
        (b, b_ok), (a, a_ok) = stack.pop(), stack.pop()
        if x == "with":
            stack.append(({f"{i}-with-{j}" for i in a for j in b}, a_ok))
        else:
            a.update(b)
            stack.append((a, a_ok or b_ok if x == "or" else a_ok and b_ok))
    return stack[0]


@functools.cache
def automaton() -> ahocorasick.Automaton:
    made: dict[str, list] = {}
    for phrase, label in BASE_PHRASES.items():
        made.setdefault(phrase, []).append((label, BASE_SURE, True))
    for phrase, (label, sure) in PHRASES.items():
        made.setdefault(phrase, []).append((label, sure, False))
    made[TAG] = [(None, TAG_SURE, False)]
    out = ahocorasick.Automaton()
    for phrase, found in made.items():
        out.add_word(f" {phrase} ", found)
    out.make_automaton()
    return out


def scanned(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, permitted of a text (UTF-8)."""
    found = text.translate(_WORD_BYTES).split()
    line = b" " + b" ".join(found) + b" "
    starts, base, labels, sure, tagged = [], set(), {}, {}, False
    at, before = 0, 0  # blanks before ``at``, counted once, as ends of hits only rise
    for end, what in automaton().iter(line.decode("latin-1")):
        for label, weight, is_base in what:
            if is_base:
                before += line.count(b" ", at, end)
                at = end
                starts.append(before - BASE_WORDS[label])
                base.add(label)
            tagged |= label is None
            if label is not None:
                labels[label] = max(weight, labels.get(label, 0))
    permitted = None
    if tagged:
        for line in _TAG.findall(text.decode("utf-8", "replace")):
            got = evaluated(line)
            sure["tag"] = TAG_SURE
            if got:
                labels |= dict.fromkeys(got[0], TAG_SURE)
                permitted = got[1] if permitted is None else permitted and got[1]
    doubt = 1.0
    for x in (*labels.values(), *sure.values()):
        doubt *= 1 - x
    return len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt, permitted


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permitted boolean"


def scans(docs: DataFrame) -> DataFrame:
    """One row per document; nothing is shuffled."""
    shipped(docs.sparkSession)

    def scan(batches):
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
        for batch in batches:
            rows = [scanned(t.as_py() or b"") for t in batch.column("text").cast(pa.large_binary())]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], [x.split()[0] for x in SCANNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCANNED)
