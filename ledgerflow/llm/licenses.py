"""Licence scans: Aho-Corasick over words, and SPDX expressions by shunting-yard.

Texts are turned into one line of lower-case words with single spaces. An
Aho-Corasick automaton finds notice phrases and the tag "SPDX-License-
Identifier" in it. The expressions that stand behind such tags are parsed by a
shunting-yard parser (WITH binds more than AND, AND more than OR) and evaluated
against the set of accepted licences. An expression reaches as far as its grammar
goes on, within its line and however long it is; prose behind it is not read.

The score says what a document's licence is known by: 1 an expression, 0.8 a
phrase of the contract, 0.6 another notice, 0 nothing.

Defined results: null and empty texts have no words, labels or tags and score
0. A malformed expression still gives the labels of its identifiers, and counts
as not accepted. A word that neither belongs to a known family nor looks like an
identifier (LicenseRef-x, Name-1.0, x-exception) is none; a tag before such a
word has no expression. Other columns are not read; repeated documents each get
a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerflow.llm import text as X

#: Phrases of the contract and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices, with labels of the method.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "boost software license": "boost",
    "artistic license": "artistic",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "do what the fuck you want to public license": "wtfpl",
    "python software foundation license": "psf",
    "sil open font license": "ofl",
    "zlib license": "zlib",
    "microsoft public license": "ms-pl",
    "server side public license": "sspl",
    "business source license": "busl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "gnu free documentation license": "gfdl",
    "open database license": "odbl",
    "licensed under the apache license": "apache",
    "licensed under the mit license": "mit",
}
TAG = "spdx license identifier"
#: Beginnings of SPDX identifiers and their labels.
FAMILIES = {
    "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "gfdl": "gfdl", "apache": "apache", "mit": "mit", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "mpl": "mpl", "epl": "epl", "eupl": "eupl", "cddl": "cddl",
    "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc0": "cc0", "unlicense": "public-domain", "zlib": "zlib", "bsl": "boost", "artistic": "artistic", "psf": "psf", "python": "psf",
    "ofl": "ofl", "wtfpl": "wtfpl", "ms-pl": "ms-pl", "sspl": "sspl", "busl": "busl", "odbl": "odbl", "classpath-exception": "classpath-exception", "none": "none", "noassertion": "noassertion",
}
ACCEPTED = frozenset({"apache", "mit", "bsd", "isc", "cc0", "cc-by", "public-domain", "zlib", "boost", "psf", "wtfpl"})

_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.:+-]*")
_TAG = re.compile(r"spdx-license-identifier:[ \t]*", re.IGNORECASE)
_BINDS = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    name = identifier.lower().rstrip("+")
    fits = [k for k in FAMILIES if name == k or name.startswith(f"{k}-")]
    return FAMILIES[max(fits, key=len)] if fits else name


def is_identifier(word: str) -> bool:
    """Whether it is of a known family, named by an owner, an exception, or has a number behind a hyphen."""
    name = word.lower().rstrip("+")
    first, *rest = name.split("-")
    if first in FAMILIES or first in ("licenseref", "documentref", "additionref") and rest or family(word) != name:
        return True
    numbered = any(p[:1].isdigit() or p[:1] == "v" and p[1:2].isdigit() for p in rest)
    return "exception" in rest or numbered and any(c.isalpha() for c in first)


def expressions(text: str) -> list[str]:
    """The expressions behind the tags of a text, each as far as it goes on: a word that fits no place in it ends it.

    Brackets that are not closed, and operators that nothing follows, stay in it.
    Signs at the end of a sentence are no part of an identifier.
    """
    out = []
    for tag in _TAG.finditer(text):
        start = end = at = tag.end()
        operand_next, open_ = True, 0
        while m := _TOKEN.match(text, at):
            word = m[0] if m[0] in "()" else m[0].rstrip(".:-")
            low = word.lower()
            if word == "(" and operand_next:
                open_ += 1
            elif word == ")" and not operand_next and open_:
                open_ -= 1
            elif low in _BINDS and not operand_next:
                operand_next = True
            elif low not in _BINDS and word not in "()" and operand_next and is_identifier(word):
                operand_next = False
            else:
                break
            if word in "()" or low not in _BINDS or word.isupper():
                # small letters may be prose: such an operator counts if an operand follows
                end = m.start() + len(word)
            if len(word) < len(m[0]):
                break
            at = m.end()
            while text.startswith((" ", "\t"), at):
                at += 1
        if end > start:
            out.append(text[start:end])
    return out


def to_postfix(expression: str) -> list[str]:
    """The tokens in postfix order; ValueError where the expression is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if token == "(":
            if not operand_next:
                raise ValueError("operator expected")
            held.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError("operand expected")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("unopened parenthesis")
            held.pop()
        elif word in _BINDS:
            if operand_next:
                raise ValueError("operand expected")
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[word]:
                out.append(held.pop())
            held.append(word)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError("operator expected")
            out.append(token)
            operand_next = False
    if operand_next:
        raise ValueError("operand expected")
    while held:
        if held[-1] == "(":
            raise ValueError("unclosed parenthesis")
        out.append(held.pop())
    return out


def evaluate(expression: str, accepted: frozenset[str] = ACCEPTED) -> tuple[set[str], bool]:
    """The labels of all licences in it, and whether a choice it offers uses accepted ones only."""
    try:
        postfix = to_postfix(expression)
    except ValueError:
        names = [t for t in _TOKEN.findall(expression) if t not in "()" and t.lower() not in _BINDS]
        return {FAMILIES[f] for f in map(family, names) if f in FAMILIES}, False
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in _BINDS and len(stack) >= 2:
            (right, fine_right), (left, fine) = stack.pop(), stack.pop()
            # an exception grants more than the licence alone and is none itself
            if token != "with":
                # the smaller set goes into the larger one, so long expressions take linear time but for a logarithm
                left, right = (left, right) if len(left) >= len(right) else (right, left)
                left |= right
            stack.append((left, fine) if token == "with" else (left, fine and fine_right if token == "and" else fine or fine_right))
        else:
            name = family(token)
            stack.append(({name}, name in accepted))
    return stack[-1]


_automaton = None


def automaton() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for phrase, label in (BASE | NOTICES | {TAG: ""}).items():
            _automaton.add_word(f" {phrase} ", (phrase, label, phrase.count(" ") + 1))
        _automaton.make_automaton()
    return _automaton


def scan(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, str, str]]]]:
    """Words per text; for texts with finds, the places (start word, phrase, label)."""
    words = X.Words(data, offsets, X.LETTERS)
    length = words.end - words.start
    # one line of all words, each followed by a space; a text's end by a second one, which no phrase can cross
    last = np.zeros(len(length), bool)
    full = words.count > 0
    last[words.first[1:][full] - 1] = True
    first = np.zeros(len(length), bool)
    first[words.first[:-1][full]] = True
    room = length + 1 + first + last
    end = np.cumsum(room)
    line = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    begin = end - room + first
    line[X.ragged(begin, length)] = words.data[X.ragged(words.start, length)]
    line[end[last] - 1] = 0x0A
    text = line.tobytes().decode("utf-8", "replace")
    finds: dict[int, list[tuple[int, str, str]]] = {}
    hits = list(automaton().iter(text)) if len(text) else []
    if hits:
        wide = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        # the space that opens a text precedes no word end: words are counted by the letter before a space
        ends = np.flatnonzero((wide[1:] == 0x20) & (wide[:-1] != 0x20) & (wide[:-1] != 0x0A)) + 1
        word = np.searchsorted(ends, [h[0] for h in hits], "right") - 1
        for (_, (phrase, label, many)), w in zip(hits, word):
            doc = int(np.searchsorted(words.first, w, "right")) - 1
            finds.setdefault(doc, []).append((int(w) - many + 1 - int(words.first[doc]), phrase, label))
    return words.count, finds


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_words, places (start word, phrase, label; in order), expressions, labels, accepted (null without expressions), score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "text"):
            count, finds = scan(*X.utf8(batch.column(1)))
            n = batch.num_rows
            places: list = [[] for _ in range(n)]
            tagged: list = [[] for _ in range(n)]
            labels: list = [[] for _ in range(n)]
            accepted: list = [None] * n
            score = [0.0] * n
            for doc, found in finds.items():
                named = {label for _, phrase, label in found if phrase != TAG}
                # a notice counts less than a phrase of the base, and that less than an expression
                score[doc] = 0.8 if any(phrase in BASE for _, phrase, _ in found) else 0.6 if named else 0.0
                if any(phrase == TAG for _, phrase, _ in found):
                    tagged[doc] = expressions(batch.column(1)[doc].as_py() or "")
                    results = [evaluate(x) for x in tagged[doc]]
                    for own, _ in results:
                        named |= own
                    if results:
                        accepted[doc] = all(fine for _, fine in results)
                        score[doc] = 1.0
                places[doc] = [{"start": s, "phrase": p, "label": v} for s, p, v in sorted(found) if p != TAG]
                labels[doc] = sorted(named)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("phrase", pa.string()), ("label", pa.string())]))), pa.array(tagged, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string())), pa.array(accepted, pa.bool_()), pa.array(score, pa.float64())],
                names=["key", "n_words", "places", "expressions", "labels", "accepted", "score"],
            )

    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_words long, places array<struct<start: long, phrase: string, label: string>>, expressions array<string>, labels array<string>, accepted boolean, score double")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(X.table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["phrase"].isin(*BASE))
    return found.withColumn("base", base).select(
        F.col("key").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["start"])).alias("first_word"), F.array_max(F.transform("base", lambda p: p["start"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
        F.array_join("expressions", "; ").alias("expressions"), "accepted",
    )
