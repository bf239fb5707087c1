"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a run of at least WINDOW characters of the base64 and URL alphabets that lies in none of the fixed patterns'
spans; one that only overlaps a span, or holds it, is judged whole. A window slides over it; its Shannon entropy is
log2(WINDOW) - S / WINDOW, S being the sum of c * log2(c) over the counts c of its characters; counts and S go along with the
window and are updated for the character that leaves and the one that enters. A
candidate is reported if its highest entropy reaches the threshold of its character class and no allow-list pattern takes
it. Everything is a Spark expression over one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let
from .native import SPAN, spans

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: What must stand in a text before the pattern is tried on it.
ASSIGN_HINT = r"(?i)passw|secret|token|api_?key"
ASSIGN_LEAST = 12
#: A maximal run of enough characters is the same as a match of any length that is long enough.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
#: Bits a character, by class: hexadecimal digits of one case; letters of one case and digits; anything else.
THRESHOLDS = {r"^(?:[0-9a-f]+|[0-9A-F]+)$": 3.0, r"^(?:[0-9a-z]+|[0-9A-Z]+)$": 3.5, r"": 3.7}
ALLOWED = (
    r"^[^0-9]*$",  # no digit: words joined
    r"^[^A-Za-z]*$",  # no letter: numbers, rules
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|lorem|xxxx",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUIDs name things
    r"^(?:[A-Za-z]+[/_=-]+)+[A-Za-z]*[0-9]{0,4}$",  # paths and slugs
    r"(?i)0123456789|abcdefghijkl",
)


#: What a candidate is made of, in an order of its own: a character's count stands at its place.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"


def _bits(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(0.0)


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest entropy of a window over a string of at least `window` characters, all of ALPHABET.

    The counts of a window's characters go along with it: a step takes one from the character that leaves and gives one to the
    character that enters, and the sum of c * log2(c) changes by those two counts.
    """

    def place(at: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substr(text, at, F.lit(1))) - 1

    def counts_of(part: Column) -> Column:
        return F.transform(F.split(F.lit(ALPHABET), ""), lambda c: (F.length(part) - F.length(F.replace(part, c, F.lit("")))).cast("double"))

    def step(acc: Column, at: Column) -> Column:  # at: from 1, where the window stands that loses its first character
        moved = F.struct(acc.alias("acc"), place(at).alias("gone"), place(at + window).alias("new"))

        def now(m: Column) -> Column:
            counts, gone, new = m["acc"]["counts"], m["gone"], m["new"]
            out, into = F.get(counts, gone), F.get(counts, new)
            changed = m["acc"]["sum"] - _bits(out) + _bits(out - 1) - _bits(into) + _bits(into + 1)
            total = F.when(gone == new, m["acc"]["sum"]).otherwise(changed)
            updated = F.when(gone == new, counts).otherwise(
                F.transform(counts, lambda c, k: F.when(k == gone, c - 1).when(k == new, c + 1).otherwise(c))
            )
            return F.struct(updated.alias("counts"), total.alias("sum"), F.least(m["acc"]["least"], total).alias("least"))

        return let(moved, now)

    slide = F.when(F.length(text) > window, F.sequence(F.lit(1), F.length(text) - window)).otherwise(F.array().cast("array<int>"))

    def walked(counts: Column) -> Column:
        begin = F.aggregate(counts, F.lit(0.0), lambda s, c: s + _bits(c))
        start = let(begin, lambda b: F.struct(counts.alias("counts"), b.alias("sum"), b.alias("least")))
        return F.aggregate(slide, start, step, lambda acc: acc["least"])

    return F.log2(F.lit(float(window))) - let(counts_of(F.substring(text, 1, window)), walked) / window


def entropy_spans(text: Column, base: Column) -> Column:
    def suspicious(x: Column) -> Column:
        value = x["value"]
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | value.rlike(pattern)
        threshold = F.coalesce(*[F.when(value.rlike(p), t) for p, t in THRESHOLDS.items()])
        free = ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"]))
        return free & F.when(allowed, False).otherwise(window_entropy(value) >= threshold)

    return F.filter(spans(text, F.lit(CANDIDATE)), suspicious)


def find_secrets(docs: DataFrame, name: str = "found") -> DataFrame:
    """Adds the column `name`, array<struct<start, kind, end>> sorted by start and kind (its number in KINDS), to docs (text, ...).

    A null or empty text has none. Every row is kept, repeated rows too, with all its columns.
    """
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_enough = F.filter(
        F.arrays_zip(spans(text, F.lit(ASSIGN)).alias("span"), values.alias("secret")),
        lambda x: F.length(x["secret"]) >= ASSIGN_LEAST,
    )
    assign = F.when(text.rlike(ASSIGN_HINT), F.transform(long_enough, lambda x: x["span"])).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), spans(text, F.lit(ACCESS))).otherwise(none)
    hexa = F.when(text.rlike(HEX), spans(text, F.lit(HEX))).otherwise(none)

    def tagged(found: Column, kind: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    base = F.concat(tagged(assign, 0), tagged(access, 1), tagged(hexa, 2))

    def all_of(b: Column) -> Column:
        entropy = F.when(text.rlike(CANDIDATE), entropy_spans(text, b)).otherwise(none)
        return F.array_sort(F.concat(b, tagged(entropy, 3)))

    return docs.withColumn(name, let(base, all_of))


def shown(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def _count(kind: int) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == kind))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text, ...): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans are listed in full, also where two kinds overlap; spans has those and the entropy ones. Without any, spans is
    empty and base_sha256 the digest of an empty string. An empty table gives no rows.
    """
    found = find_secrets(docs.select(F.col("doc_id").cast("long"), "text"))
    base = F.filter("found", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id",
        *[_count(k).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in `text` replaced by the mark and n_chars, if there, counted again; overlapping spans are one."""
    text = F.coalesce("text", F.lit(""))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= acc["at"], F.concat(F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    def cleaned(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))

    name = fresh(docs, "found")
    out = find_secrets(docs, name).withColumn("text", F.when(F.size(name) > 0, cleaned(F.col(name))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(name)
