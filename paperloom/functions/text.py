"""Text functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

#: Words that a query's tokens leave out, and the shortest token.
QUERY_STOPWORDS = ["and", "or", "the", "a", "an", "of", "for", "to", "in", "on", "with"]
LEAST_TOKEN = 3
#: Runs that are no language, and paths that are cut.
BASE64_RUN = r"(?U)\b[A-Za-z0-9+/]{60,}={0,2}\b"
NAN_RUN = r"(?i)(?U)\bNaN\b(?:\s*[|,;]\s*\bNaN\b){2,}"
NAN = r"(?i)(?U)\bNaN\b"
LONG_PATH = r"(?:[A-Za-z]:\\|\\\\|SY\d+_PLC\+HMI)[^\s|]{40,}"
#: Latin letters with marks, and the plain ones they are searched as.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorsstuuuzzz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row however often the body uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(value: Column) -> Column:
    """Null for an empty string, as callers take an empty value for a missing one."""
    return F.nullif(value, F.lit(""))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[blank_to_null(v) for v in values])


def collapse(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, most: int, mark: str = "...") -> Column:
    """Collapsed text; one that is longer than `most` is cut to most less the mark, which is added."""
    clean = collapse(text)
    return F.when(F.length(clean) > most, F.concat(F.rtrim(F.substring(clean, 1, most - len(mark))), F.lit(mark))).otherwise(clean)


def clean_markdown(text: Column) -> Column:
    """LF line ends, at most three in a row, an empty line before a heading, one LF at the end."""
    lf = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n{4,}", "\n\n\n")
    spaced = F.regexp_replace(lf, r"\n(#{1,6} )", "\n\n$1")
    return F.concat(F.regexp_replace(spaced, r"^\s+|\s+$", ""), F.lit("\n"))


def yaml_value(value: Column) -> Column:
    """A scalar as YAML: null, a number or a truth value as it is, text in double quotes, escaped."""
    text = value.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.coalesce(F.when(F.typeof(value) != "string", text), quoted, F.lit("null"))


def front_matter(fields: dict[str, Column], body: Column) -> Column:
    """A YAML header of the fields, in their order, before the body."""
    lines = [F.concat(F.lit(f"{name}: "), yaml_value(value)) for name, value in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), body)


def path_tail(path: Column, parts: int = 3) -> Column:
    """.../ and the last parts of a backslash path that has more."""
    split = F.filter(F.split(F.replace(path, F.lit("\\_"), F.lit("_")), r"\\"), lambda x: x != "")
    tail = F.concat(F.lit(".../"), F.array_join(F.slice(split, -parts, parts), "/"))
    return F.when(F.size(split) > parts, tail).otherwise(path)


def _where(there: Callable[[Column], Column], change: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda t: F.when(there(t), change(t)).otherwise(t)


def cleaned(text: Column) -> Column:
    """Text without base64 runs and NaN, with short paths."""

    def cut_paths(t: Column) -> Column:
        paths = F.regexp_extract_all(t, F.lit(LONG_PATH), F.lit(0))
        return F.aggregate(F.array_distinct(paths), t, lambda acc, p: F.replace(acc, p, path_tail(p)))

    # patterns are tried only where a text has what each of their matches has
    steps = [
        (lambda t: t.rlike(BASE64_RUN), lambda t: F.regexp_replace(t, BASE64_RUN, "[base64]")),
        (lambda t: t.rlike(NAN), lambda t: F.regexp_replace(F.regexp_replace(t, NAN_RUN, "[NaN omitted]"), NAN, "")),
        (lambda t: F.contains(t, F.lit("\\")) | F.contains(t, F.lit("_PLC+HMI")), cut_paths),
    ]

    clean = F.coalesce(text, F.lit(""))
    for there, change in steps:
        clean = let(clean, _where(there, change))
    return clean


def searchable(text: Column) -> Column:
    """What is indexed and shown: cleaned, single spaces."""
    return collapse(cleaned(text))


def query_tokens(query: str) -> list[str]:
    """The tokens that a fallback search looks for, one after another, in the query's order."""
    return [t for t in re.findall(r"[a-z0-9_]+", query.lower()) if len(t) >= LEAST_TOKEN and t not in QUERY_STOPWORDS]


def query_tokens_of(text: Column) -> Column:
    """The same for a column."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.filter(words, lambda t: (F.length(t) >= LEAST_TOKEN) & ~t.isin(QUERY_STOPWORDS))


def preview(text: Column, query: str = "", limit: int | None = 220, lead: int = 40) -> Column:
    """The searchable text from a little before the first term of the query on, cut at the limit, if there is one."""
    clean = searchable(text)
    terms = query_tokens(query) or query.split()
    if terms:
        places = F.array(*[F.locate(t.lower(), F.lower(clean)) for t in terms])
        first = F.array_min(F.filter(places, lambda x: x > 0))
        clean = F.when(first > lead + 1, F.concat(F.lit("..."), F.substr(clean, first - lead, F.length(clean)))).otherwise(clean)
    if limit is None:
        return clean
    shown = F.rtrim(F.substring(clean, 1, limit))
    return F.concat(shown, F.when(F.length(clean) > limit, F.lit("...")).otherwise(F.lit("")))


def fold(text: Column) -> Column:
    """Lower case without marks on Latin letters."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def search_terms(text: Column) -> Column:
    """The index's terms: runs of letters and digits, folded, in order."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    folded = let(lower, _where(lambda t: F.octet_length(t) > F.length(t), lambda t: F.translate(t, MARKED, PLAIN)))  # marks are no ASCII
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normal_entity(text: Column) -> Column:
    return collapse(casefold(text))


def classification_text(value: Column) -> Column:
    return F.translate(F.lower(value), "_-", "  ")


def safe_id(value: Column) -> Column:
    return F.regexp_replace(value, r"[^A-Za-z0-9_-]", "_")


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(value), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def entity_id(kind: Column, text: Column) -> Column:
    return F.concat(F.lit("entity:"), kind, F.lit(":"), F.substring(F.sha1(F.concat_ws("|", kind, normal_entity(text)).cast("binary")), 1, 8))


def checksum(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def extension(path: Column) -> Column:
    """Lower-cased suffix without the dot; unknown without one."""
    return F.coalesce(blank_to_null(F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))), F.lit("unknown"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def page_number_of(name: Column) -> Column:
    return F.try_element_at(F.transform(F.regexp_extract_all(name, F.lit(r"(?i)page[_-]?(\d+)"), F.lit(1)), lambda x: x.cast("int")), F.lit(1))


def chunk_title(chunk: dict[str, Column], headings: Column, chunk_id: Column) -> Column:
    """The first name that is filled, else the last heading, else the id."""
    names = [chunk[k] for k in ("slide_title", "topic_label", "batch_id", "section_title", "group_path", "table_name") if k in chunk]
    return first_filled(*names, F.try_element_at(headings, F.lit(-1)), chunk_id)


def image_metrics(markdown: Column) -> dict[str, Column]:
    """missing_assets (image references outside assets/), base64_images."""
    references = F.regexp_extract_all(markdown, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    return {
        "missing_assets": F.size(F.filter(references, lambda x: ~x.startswith("assets/") & ~x.startswith("data:"))).cast("long"),
        "base64_images": F.size(F.filter(references, lambda x: x.startswith("data:image"))).cast("long"),
    }


def first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    return F.coalesce(*[blank_to_null(F.regexp_extract(text, p, group)) for p in patterns])


def needed(pattern: str) -> str | None:
    """A mark that every match of the pattern holds, where one stands in it by itself: in no class, group or choice, and not
    optional."""
    bare, last = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", ".", pattern, flags=re.S), None
    while bare != last:
        bare, last = re.sub(r"\([^()]*\)", ".", bare), bare
    found = None if re.search(r"[()\[\]|]", bare) or re.search(r"\\Q|\(\?\w*x", pattern) else re.search(r"[@:/=<>_&%](?![?*{])", bare)
    return found[0] if found else None


def distinct_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Different matches in the order they are first seen; a text without what every match holds isn't searched."""
    mark = needed(pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if mark:
        found = F.when(text.isNull() | F.contains(text, F.lit(mark)), found).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(found, lambda x: F.trim(x) != ""))


def present(text: Column, names: list[str]) -> Column:
    """Those of the names that stand in the text, whatever the case."""
    return F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower(text), F.lower(n)))


def row_cells(line: Column) -> Column:
    """Cells of a Markdown table row."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))


def key_values(markdown: Column) -> Column:
    """map of two-column table rows; the last of a key wins; the header rule and rows without a key are left out."""
    found = F.filter(F.transform(F.split(markdown, "\n"), row_cells), lambda r: (F.size(r) == 2) & (F.get(r, F.lit(0)) != "") & ~F.get(r, F.lit(0)).rlike("^:?-+:?$"))

    def mapped(rows: Column) -> Column:
        keys = F.array_distinct(F.transform(rows, lambda r: F.get(r, F.lit(0))))
        last = lambda k: F.get(F.try_element_at(F.filter(rows, lambda r: F.get(r, F.lit(0)) == k), F.lit(-1)), F.lit(1))
        return F.map_from_arrays(keys, F.transform(keys, last))

    return let(found, mapped)


def distinct_list(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def json_list(value: Column) -> Column:
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def json_map(value: Column) -> Column:
    return F.coalesce(F.from_json(value, "map<string,string>"), F.create_map().cast("map<string,string>"))


#: What no file name holds, the longest name, the name of what has none.
NAME_MARKS, NAME_CHARS, NO_NAME = r'[\x00-\x1f<>:"/\\|?*]+', 120, "note"


def note_name(value: Column, fallback: str = NO_NAME, most: int = NAME_CHARS) -> Column:
    """A name that any file system takes."""
    bare = lambda x: F.regexp_replace(x, r"^[. ]+|[. ]+$", "")
    clean = F.coalesce(blank_to_null(bare(collapse(F.regexp_replace(F.coalesce(value, F.lit("")), NAME_MARKS, " ")))), F.lit(fallback))
    return F.coalesce(blank_to_null(bare(F.substring(clean, 1, most))), F.lit(fallback))


def limitation(locator: Column, is_noisy: Column) -> Column:
    return blank_to_null(
        F.concat_ws("; ", F.when(F.coalesce(locator, F.lit("")) == "", F.lit("missing locator")), F.when(is_noisy, F.lit("chunk marked noisy")))
    )


def line_window(text: Column, value: str, around: int = 2) -> Column:
    """The lines around the first one that holds the value."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit(value))), True).cast("int")
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.array_join(F.slice(lines, start, at + around - start + 1), "\n")).otherwise("")


def range_locator(numbers: Column, one: str = "Slide", more: str = "Slides") -> Column:
    """A number, one range for numbers without a gap, else a list."""
    own = F.array_sort(F.array_distinct(numbers))
    low, high = F.array_min(own), F.array_max(own)
    listed = F.array_join(F.transform(own, lambda x: x.cast("string")), ", ")
    whole = F.when(F.size(own) == high - low + 1, F.concat(low.cast("string"), F.lit("-"), high.cast("string")))
    return F.when(low == high, F.concat(F.lit(f"{one} "), low.cast("string"))).otherwise(F.concat(F.lit(f"{more} "), F.coalesce(whole, listed)))


def quality_warnings(markdown: Column, chunks: Column) -> Column:
    text = F.trim(F.coalesce(markdown, F.lit("")))
    return F.array_compact(
        F.array(
            F.when(text == "", F.lit("output markdown is empty")),
            F.when((text != "") & (F.length(text) < 20), F.lit("output markdown is very short")),
            F.when(~text.rlike(r"(?m)^#{1,6}\s"), F.lit("no headings detected")),
            F.when(chunks == 0, F.lit("no chunks generated")),
        )
    )


#: Patterns, thresholds, factors and caps of the noise signals; a score of 2 and more is noise.
NOISE_PATHS = r"[A-Za-z]:\\|\\\\|PLC\+HMI|\\Bilder\\|\\Textfeld"
NOISE = {"nan_density": (0.08, 5.0, 3.0), "base64_like": (0.0, 1.5, 4.0), "windows_or_hmi_path_density": (0.03, 5.0, 2.5), "xml_html_tag_density": (0.05, 4.0, 2.0)}
NOISY = 2.0
LOW_ALPHA, LOW_ALPHA_CHARS = 0.15, 200


def noise(text: Column, locator: Column) -> Column:
    """struct<is_noisy, noise_score (three digits), noise_reasons> from six signals."""
    own = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(own, F.lit(p)).cast("double")
    where = lambda there, p: F.when(there, count(p)).otherwise(F.lit(0.0))
    # paths and tags are counted only where a text has what each of them has
    counts = {
        "tokens": F.greatest(count(r"\S+"), F.lit(1.0)), "alpha": count(r"(?U)\b[A-Za-z]{3,}\b"), "nan": count(NAN), "base64": count(BASE64_RUN),
        "paths": where(F.contains(own, F.lit("\\")) | F.contains(own, F.lit("PLC+HMI")), NOISE_PATHS), "tags": where(F.contains(own, F.lit("<")), r"<[^>\n]{2,40}>"),
    }

    def judged(found: Column) -> Column:
        tokens = found["tokens"]
        density = {
            "nan_density": found["nan"] / tokens,
            "base64_like": found["base64"],
            "windows_or_hmi_path_density": found["paths"] / tokens,
            "xml_html_tag_density": found["tags"] / tokens,
        }
        signals = [(name, F.when(density[name] > least, F.least(density[name] * factor, F.lit(cap)))) for name, (least, factor, cap) in NOISE.items()]
        signals.append(("missing_locator", F.when(F.coalesce(locator, F.lit("")) == "", F.lit(1.0))))
        signals.append(("low_natural_language_ratio", F.when((found["alpha"] / tokens < LOW_ALPHA) & (F.length(own) > LOW_ALPHA_CHARS), F.lit(1.0))))
        score = sum((F.coalesce(s, F.lit(0.0)) for _, s in signals), F.lit(0.0))
        reasons = F.array_compact(F.array(*[F.when(s.isNotNull(), F.lit(n)) for n, s in signals]))
        return F.struct((score >= NOISY).alias("is_noisy"), F.round(score, 3).alias("noise_score"), reasons.alias("noise_reasons"))

    return let(F.struct(*[c.alias(name) for name, c in counts.items()]), judged)


def section_title(value: Column) -> Column:
    """A section's title as it is written: single spaces, no dots at the ends, known titles in their spelling."""
    clean = collapse(F.regexp_replace(value, r"^[ .]+|[ .]+$", ""))
    known = F.coalesce(*[F.when(clean == k, F.lit(v)) for k, v in V.SECTION_TITLES.items()])
    return F.coalesce(known, F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1 << 30)))


def repaired(value: Column, spoilt: dict[str, str] = V.SPOILT_TEXT) -> Column:
    """Text that a wrong encoding has spoilt, as it was."""
    for wrong, right in spoilt.items():
        value = F.replace(value, F.lit(wrong), F.lit(right))
    return F.trim(value)
