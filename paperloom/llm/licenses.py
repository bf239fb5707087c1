"""License scan: ordered signature rules behind a keyword prefilter.

A text becomes its lower-cased words, one space between, so that a signature is a regex over words. Rules are
names with versions (FAMILIES), sentences of license texts and notices, and SPDX identifiers (license_texts). Each rule has a
keyword that must stand in the text before its regex is tried, and a priority (its place in the list). A detection that lies within
another one is suppressed; of two with the same place the one of higher priority stays. Everything is a Spark expression over
one row: no shuffle, no Python.
"""

from __future__ import annotations

import itertools
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii
from .license_texts import IDENTIFIERS, SENTENCES
from .native import sorted_join, spans

#: Characters that are in no word, before and after lower-casing.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Families whose signatures are made by rule: id, keyword (or two), names (regexes over words), versions.
FAMILIES: list[tuple[str, str, tuple[str, ...], tuple[str, ...]]] = [
    ("agpl", "affero general|agpl", (r"gnu affero general public licen[sc]e", r"affero general public licen[sc]e", r"agpl"), ("3.0", "1.0")),
    ("lgpl", "general public|lgpl", (r"gnu (?:lesser|library) general public licen[sc]e", r"(?:lesser|library) general public licen[sc]e", r"lgpl"), ("3.0", "2.1", "2.0")),
    ("gpl", "general public|gpl", (r"gnu general public licen[sc]e", r"general public licen[sc]e", r"gnu gpl", r"gpl"), ("3.0", "2.0", "1.0")),
    ("gfdl", "documentation", (r"gnu free documentation licen[sc]e", r"free documentation licen[sc]e"), ("1.3", "1.2", "1.1")),
    ("apache", "apache", (r"apache licen[sc]e", r"apache software licen[sc]e", r"apache public licen[sc]e"), ("2.0", "1.1", "1.0")),
    ("mpl", "mozilla", (r"mozilla public licen[sc]e",), ("2.0", "1.1", "1.0")),
    ("epl", "eclipse", (r"eclipse public licen[sc]e",), ("2.0", "1.0")),
    ("cddl", "distribution", (r"common development and distribution licen[sc]e",), ("1.1", "1.0")),
    ("eupl", "european", (r"european union public licen[sc]e",), ("1.2", "1.1", "1.0")),
    ("artistic", "artistic", (r"artistic licen[sc]e",), ("2.0", "1.0")),
    ("afl", "academic", (r"academic free licen[sc]e",), ("3.0", "2.1", "2.0")),
    ("osl", "open software", (r"open software licen[sc]e",), ("3.0", "2.1", "2.0")),
    ("ofl", "font", (r"sil open font licen[sc]e", r"open font licen[sc]e"), ("1.1", "1.0")),
    ("bsl", "boost", (r"boost software licen[sc]e",), ("1.0",)),
    ("cecill", "cecill", (r"cecill(?: licen[sc]e)?",), ("2.1", "2.0", "1.0")),
    ("odbl", "database", (r"open database licen[sc]e",), ("1.0",)),
    ("ecl", "educational", (r"educational community licen[sc]e",), ("2.0", "1.0")),
    ("sspl", "server side", (r"server side public licen[sc]e",), ("1.0",)),
    ("busl", "business source", (r"business source licen[sc]e",), ("1.1", "1.0")),
    ("elastic", "elastic", (r"elastic licen[sc]e",), ("2.0", "1.0")),
    ("lppl", "latex", (r"latex project public licen[sc]e",), ("1.3", "1.2", "1.0")),
    ("zpl", "zope", (r"zope public licen[sc]e",), ("2.1", "2.0")),
    ("cpal", "attribution", (r"common public attribution licen[sc]e",), ("1.0",)),
    ("cpl", "common public", (r"common public licen[sc]e",), ("1.0",)),
    ("npl", "netscape", (r"netscape public licen[sc]e",), ("1.1", "1.0")),
    ("qpl", "q public", (r"q public licen[sc]e",), ("1.0",)),
    ("php", "php", (r"php licen[sc]e",), ("3.01", "3.0")),
    ("ms-pl", "microsoft", (r"microsoft public licen[sc]e",), ()),
    ("ms-rl", "microsoft", (r"microsoft reciprocal licen[sc]e",), ()),
    ("mit", "mit|expat", (r"mit licen[sc]e", r"licensed under (?:the )?mit", r"expat licen[sc]e"), ()),
    ("bsd-2-clause", "bsd", (r"bsd 2 clause(?: licen[sc]e)?", r"2 clause bsd(?: licen[sc]e)?", r"simplified bsd licen[sc]e"), ()),
    ("bsd-3-clause", "bsd", (r"bsd 3 clause(?: licen[sc]e)?", r"3 clause bsd(?: licen[sc]e)?", r"(?:new|revised) bsd licen[sc]e"), ()),
    ("bsd-4-clause", "bsd", (r"bsd 4 clause(?: licen[sc]e)?", r"4 clause bsd(?: licen[sc]e)?"), ()),
    ("bsd", "bsd", (r"bsd (?:style )?licen[sc]e",), ()),
    ("isc", "isc", (r"isc licen[sc]e",), ()),
    ("zlib", "zlib", (r"zlib(?: libpng)? licen[sc]e",), ()),
    ("unlicense", "unlicense", (r"(?:the )?unlicense",), ()),
    ("wtfpl", "wtfpl", (r"wtfpl",), ()),
    ("psf", "python", (r"python software foundation licen[sc]e",), ()),
    ("postgresql", "postgresql", (r"postgresql licen[sc]e",), ()),
    ("openssl", "openssl", (r"openssl licen[sc]e",), ()),
    ("ncsa", "ncsa", (r"ncsa open source licen[sc]e",), ()),
    ("cc0", "cc0", (r"cc0(?: 1 0)?",), ()),
    ("cc0", "creative", (r"creative commons (?:cc0|zero)(?: 1 0)?",), ()),
    ("public-domain", "public domain", (r"(?:in|into|to) the public domain",), ()),
    ("proprietary", "proprietary", (r"proprietary and confidential", r"proprietary licen[sc]e"), ()),
]
CC_PARTS = {"by": r"attribution", "sa": r"share ?alike", "nc": r"non ?commercial", "nd": r"no ?deriv(?:ative)?s?(?: works)?"}
CC_KINDS = (("by", "nc", "sa"), ("by", "nc", "nd"), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by",))
CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0")


def _version(v: str) -> str:
    major, _, minor = v.partition(".")
    return rf"(?:(?:version |v ?)?{major} {minor})" if minor.strip("0") else rf"(?:(?:version |v ?)?{major}(?: {minor})?)"


def rules() -> list[dict]:
    """label, keyword and other keyword, pattern (between spaces) and weight, the highest priority first."""
    out = []

    def add(label: str, keyword: str, pattern: str, weight: float) -> None:
        first, _, other = keyword.partition("|")
        out.append({"label": label, "keyword": first, "other": other or first, "pattern": rf"(?<= ){pattern}(?= )", "weight": weight})

    for kinds, version in itertools.product(CC_KINDS, (*CC_VERSIONS, "")):
        tail = rf" {_version(version)}" if version else ""
        label, weight = "-".join(("cc", *kinds, *[version] * bool(version))), 0.95 if version else 0.8
        add(label, "cc by", rf"cc {' '.join(kinds)}{tail}", weight)
        add(label, "creative commons", rf"creative commons {'(?: |)'.join(CC_PARTS[k] for k in kinds)}{tail}", weight)
        add(label, "creativecommons", rf"creativecommons org licenses {' '.join(kinds)}{tail}", weight)
    for label, keyword, names, versions in FAMILIES:
        name = rf"(?:{'|'.join(names)})"
        for version in versions:
            for suffix, words in ((("-or-later", r" (?:or|and) (?:any )?later"), ("-only", r" only"), ("", "")) if "gpl" in label else (("", ""),)):
                add(f"{label}-{version}{suffix}", keyword, rf"{name} {_version(version)}{words}", 0.95)
                if "gpl" in label:
                    add(f"{label}-{version}{suffix}", keyword, rf"{label}v{_version(version)[len('(?:(?:version |v ?)?'):-1]}{words}", 0.95)
        add(label, keyword, name, 0.8)
    for label, keyword, pattern, _ in SENTENCES:
        add(label, keyword, f"(?:{pattern})", 0.9)
    for identifier in IDENTIFIERS:
        add(identifier.lower(), "spdx", f"spdx licen[sc]e identifier {re.sub('[-.]', ' ', identifier.lower())}", 1.0)
    return out


#: Parts of words without one of which (or "cc by") no rule and no base phrase can be found in a text.
HINTS = (
    "licen", "softw", "permi", "distribut", "copyright", "warrant", "creative", "gpl", "cc0", "wtfpl", "cecill", "bsd", "proprietary", "domain", "reserved", "general",
    "consortium", "beer", "derivative", "hereby", "procurement", "library", "interacting", "invariant", "eclipse", "perl", "datenlizenz", "ebook", "research", "parties",
    "engineer", "decompile", "disassemble", "secret", "commercial", "personal", "government", "ruby", "shareware", "unauthorized",
)


def hinted(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(h)) for h in HINTS)) | low.rlike(f"cc{NOT_WORD}+by")


def as_words(text: Column) -> Column:
    """The text's words, lower-cased, with one space between, before and after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), rf"{NOT_WORD}+", " ")), F.lit(" "))


def _word_at(words: Column, char: Column) -> Column:
    head = F.substr(words, F.lit(1), char)
    return (F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit(""))) - 1).cast("long")


def base_places(words: Column) -> Column:
    """array<struct<first (word), label>> of the base phrases; none can overlap another."""
    labels = F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])
    found = spans(words, F.lit(rf"(?<= )(?:{'|'.join(BASE)})(?= )"))
    return F.transform(found, lambda x: F.struct(_word_at(words, x["start"]).alias("first"), F.element_at(labels, x["value"]).alias("label")))


def detections(words: Column, table: list[dict] | None = None) -> Column:
    """array<struct<label, start, end, weight>> of the rules' detections that no other one contains."""
    table = rules() if table is None else table
    schema = "array<struct<label: string, keyword: string, other: string, pattern: string, weight: double, priority: int>>"
    listed = F.from_json(F.lit(json.dumps([r | {"priority": k} for k, r in enumerate(table)])), schema)
    kind = "struct<start: int, last: int, priority: int, end: int, label: string, weight: double>"

    def of_rule(r: Column) -> Column:
        return F.transform(
            spans(words, r["pattern"]),
            lambda x: F.struct(
                x["start"].alias("start"), (-x["end"]).alias("last"), r["priority"].alias("priority"),
                x["end"].alias("end"), r["label"].alias("label"), r["weight"].alias("weight"),
            ),
        )

    possible = F.filter(listed, lambda r: F.contains(words, r["keyword"]) | F.contains(words, r["other"]))
    ordered = F.array_sort(F.flatten(F.transform(possible, of_rule)))  # by start; the longest first, then by priority

    def step(acc: Column, x: Column) -> Column:
        inside = x["end"] <= acc["reach"]
        return F.struct(
            F.greatest(acc["reach"], x["end"]).alias("reach"), F.when(inside, acc["kept"]).otherwise(F.array_append(acc["kept"], x)).alias("kept")
        )

    start = F.struct(F.lit(0).alias("reach"), F.array().cast(f"array<{kind}>").alias("kept"))
    return F.aggregate(ordered, start, step, lambda acc: acc["kept"])


def find_licenses(docs: DataFrame) -> DataFrame:
    """Adds n_words, base (array<struct<first, label>>) and found (array<struct<..., label, start, end, weight>>) to docs.

    A null or empty text has none of either. Every row is kept, with all its columns.
    """
    text = F.coalesce("text", F.lit(""))
    both = let(as_words(text), lambda w: F.struct(base_places(w).alias("base"), detections(w).alias("found")))
    words = F.array_remove(F.split(text, f"{NOT_WORD}+"), "")
    out = docs.withColumn("n_words", F.size(words).cast("long")).withColumn("_both", F.when(hinted(text), both))
    return out.select(*docs.columns, "n_words", F.coalesce("_both.base", F.array()).alias("base"), F.coalesce("_both.found", F.array()).alias("found"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text, ...): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Without a base place first_word and last_word are null; without labels they are empty strings and the score is 0, else it
    is the weight of the surest detection (a base phrase alone has 0.5). Repeated rows give repeated rows.
    """
    found = find_licenses(docs.select(F.col("doc_id").cast("long"), "text"))
    firsts, labels = F.col("base.first"), F.col("base.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        sorted_join(F.array_distinct(labels)).alias("base_labels"),
        sorted_join(F.array_distinct(F.concat(labels, F.col("found.label")))).alias("labels"),
        F.coalesce(F.greatest(F.array_max("found.weight"), F.when(F.size("base") > 0, 0.5)), F.lit(0.0)).alias("score"),
    )
