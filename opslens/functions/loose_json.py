"""JSON of unknown shape as VARIANT: lenient parsing, bounded values, values without empty ones, and all texts of a value.

Levels are walked by nested expressions to a fixed depth, so nothing leaves the JVM. A VARIANT keeps the keys of an object
by name, not as they were written, so "first" keys are the least ones. Null stays null. Give these functions a column of a
table rather than a parsing expression, which each level's expressions would hold again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How deep, wide and long a bounded value is, and what stands for what lies deeper.
DEPTH, KEYS, ITEMS, CHARS, DEEPER = 4, 24, 12, 900, "<truncated>"
# The same for the texts of a value.
SAID_DEPTH, SAID_KEYS, SAID_ITEMS, SAID_CHARS = 3, 24, 120, 4000
#: Writings that are no JSON, and what is meant by them. Each is tried after those before it, where the text doesn't parse yet.
MENDED = (
    (r",\s*([}\]])", "$1"),
    (r"([\[{,:]\s*)True\b", "$1true"),
    (r"([\[{,:]\s*)False\b", "$1false"),
    (r"([\[{,:]\s*)None\b", "$1null"),
    (r"([\[{,:]\s*)'([^'\"\\]*)'(?=\s*[:,}\]])", '$1"$2"'),
    (r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":'),
)


#: A quoted text, what stands between two, or a quote that is never closed. Possessive, so that long texts don't fill the stack.
PIECES = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++|"'


def _outside_quotes(text: Column, pattern: str, meant: str) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.startswith('"'), x).otherwise(F.regexp_replace(x, pattern, meant))), "")


def _closed(text: Column) -> Column:
    """The text with the quote and the brackets that it leaves open closed."""
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))
    state = lambda opened, quoted, escaped: F.struct(opened.alias("open"), quoted.alias("quoted"), escaped.alias("escaped"))

    def step(s, c):
        closes = (c == F.substring(s["open"], 1, 1)) & c.isin("}", "]")
        opened = F.when(c == "{", F.concat(F.lit("}"), s["open"])).when(c == "[", F.concat(F.lit("]"), s["open"])).when(closes, F.substring(s["open"], 2, 1 << 30)).otherwise(s["open"])
        inside = state(s["open"], s["escaped"] | (c != '"'), ~s["escaped"] & (c == "\\"))
        return F.when(s["quoted"], inside).otherwise(state(opened, c == '"', F.lit(False)))

    return F.aggregate(F.split(text, ""), start, step, lambda s: F.concat(text, F.when(s["quoted"], F.lit('"')).otherwise(F.lit("")), s["open"]))


def lenient(text: Column) -> Column:
    """The object that a text holds: from its first to its last brace, without what a model thought and the fence around it.

    Where that is no JSON, trailing commas, words and quotes of Python and bare keys are mended, and what stays open is
    closed. Null where there is no object: no braces, repeated keys, or writing that none of these mends."""
    text = F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
    text = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    tries, mended = [F.try_parse_json(text)], text
    for pattern, meant in MENDED:
        mended = _outside_quotes(mended, pattern, meant)
        tries.append(F.try_parse_json(mended))
    tries.append(F.try_parse_json(_closed(mended)))
    return F.coalesce(*(F.when(fields(t).isNotNull(), t) for t in tries))


def fields(value: Column) -> Column:
    """An object's values by key; null for another value."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def items(value: Column) -> Column:
    """An array's values; null for another value."""
    return F.try_variant_get(value, "$", "array<variant>")


def _first_fields(value: Column, most: int) -> Column:
    held = fields(value)
    keys = F.slice(F.array_sort(F.map_keys(held)), 1, most)
    return F.map_filter(held, lambda k, _: F.array_contains(keys, k))


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _branches(value: Column, on_fields: Column, on_items: Column, on_scalar: Column) -> Column:
    return F.when(fields(value).isNotNull(), on_fields).when(items(value).isNotNull(), on_items).otherwise(on_scalar)


def bounded(value: Column, depth: int = 0) -> Column:
    """The value with texts trimmed and cut at CHARS, the first KEYS keys and ITEMS items, and DEEPER for what lies below DEPTH."""
    if depth >= DEPTH:
        return F.lit(DEEPER).cast("variant")
    text = F.trim(F.try_variant_get(value, "$", "string"))
    cut = F.when(F.length(text) <= CHARS, text).otherwise(F.concat(F.substring(text, 1, CHARS - 1), F.lit("…")))
    return _branches(
        value,
        F.to_variant_object(F.transform_values(_first_fields(value, KEYS), lambda _, v: bounded(v, depth + 1))),
        F.to_variant_object(F.transform(F.slice(items(value), 1, ITEMS), lambda v: bounded(v, depth + 1))),
        F.when(_is_text(value), cut.cast("variant")).otherwise(value),
    )


def without_empty(value: Column, depth: int = 6) -> Column:
    """The value without fields that are null, empty texts, arrays or objects, or objects of such fields only.

    Items of arrays stay, without their empty fields. What lies deeper than `depth` levels stays as it is."""
    if depth <= 0:
        return value
    empty = lambda v: F.is_variant_null(v) | v.isNull() | F.to_json(v).isin('""', "[]", "{}")
    kept = F.map_filter(F.transform_values(fields(value), lambda _, v: without_empty(v, depth - 1)), lambda _, v: ~empty(v))
    return _branches(value, F.to_variant_object(kept), F.to_variant_object(F.transform(items(value), lambda v: without_empty(v, depth - 1))), value)


def texts(value: Column, depth: int = 0) -> Column:
    """The texts of a value, of the first SAID_KEYS keys and SAID_ITEMS items to SAID_DEPTH levels, each cut at SAID_CHARS.

    Numbers and truth values count as texts, null values don't."""
    none = F.array().cast("array<string>")
    if depth > SAID_DEPTH:
        return none
    plain = F.when(_is_text(value), F.substring(F.try_variant_get(value, "$", "string"), 1, SAID_CHARS))
    other = F.to_json(value)
    plain = F.coalesce(plain, F.when(other.isin("true", "false"), F.initcap(other)).otherwise(other))
    within = lambda found: F.flatten(F.transform(found, lambda v: texts(v, depth + 1)))
    held = F.map_entries(_first_fields(value, SAID_KEYS))
    said = _branches(value, within(F.transform(held, lambda e: e["value"])), within(F.slice(items(value), 1, SAID_ITEMS)), F.array(plain))
    return F.when(value.isNull() | F.is_variant_null(value), none).otherwise(said)
