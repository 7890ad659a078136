"""Column functions on text: normalising, tokens, identities, ids and coercions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges of code points that count as white space.
SPACES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
WHITE_SPACE = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SPACES) + "]+"
# What a token is, over lower-case text.
TOKEN = r"([a-z][a-z0-9_.$]*|\p{Nd}+)"
#: Columns of a pair that make its text, in order.
PAIR_TEXT = ("raw_api", "canonical_api", "canonical_owner", "reference", "ku")


def normalize_text(value: Column) -> Column:
    """Runs of white space become one space; none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), WHITE_SPACE, " "))


def pair_text(columns: list[str]) -> Column:
    """The non-empty text columns of a pair that are there, joined and normalised."""
    return normalize_text(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in PAIR_TEXT if c in columns]))


def first_nonempty(columns: list[str], names: tuple[str, ...]) -> Column:
    """The first of the named columns that is there and not empty; blanks count as not empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names if c in columns], F.lit(""))


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Full case folding by the rule of the language's own string type: characters that become one other, those, and what others grow to."""
    folds = {c: c.casefold() for c in map(chr, range(0x110000)) if c.casefold() != c}
    single = [c for c, f in folds.items() if len(f) == 1]
    return "".join(single), "".join(folds[c] for c in single), {c: f for c, f in folds.items() if len(f) > 1}


def casefold(value: Column | str) -> Column:
    """Full Unicode case folding as a column: a look-up for each character, whatever the JVM's own tables know.

    ASCII text, whose length in bytes is that in characters, is only lower-cased. Characters that grow are looked for first;
    ``ß``, which is common, is replaced by itself, others one by one where a text has any.
    """
    value = F.col(value) if isinstance(value, str) else value
    source, target, growing = _folding()
    rare = {c: f for c, f in growing.items() if c != "ß"}
    plain = F.replace(value, F.lit("ß"), F.lit("ss"))
    table = F.create_map(*[F.lit(x) for pair in rare.items() for x in pair])
    letters = F.transform(F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.element_at(table, c), c))
    found = plain.rlike(r"[\x{80}-\x{10FFFF}&&[" + "".join(rare) + "]]")  # the range settles almost all characters
    grown = F.when(found, F.array_join(letters, "")).otherwise(plain)
    return F.when(F.octet_length(value) == F.char_length(value), F.lower(value)).otherwise(F.translate(grown, source, target))


def tokens(value: Column) -> Column:
    """Tokens in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(TOKEN), F.lit(1))


def token_set(value: Column) -> Column:
    return F.array_distinct(tokens(value))


def identity(source: Column, folded: Column) -> Column:
    """A digest of a knowledge unit's source and its normalised, case-folded text."""
    return F.sha2(F.concat(F.coalesce(source, F.lit("")), F.lit("\0"), folded), 256)


def pair_id(number: Column) -> Column:
    return F.format_string("PAIR-%06d", number)


def api_node_id(dataset: Column, api: Column) -> Column:
    return F.concat_ws(":", dataset, F.lit("API"), api)


def ku_node_id(dataset: Column, api: Column, pair: Column) -> Column:
    return F.concat_ws(":", dataset, F.lit("KU"), api, pair)


def split_trimmed(value: Column, separator: str = r"\|") -> Column:
    """Parts between separators, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), separator), normalize_ends), lambda x: x != "")


def normalize_ends(value: Column) -> Column:
    """White space off both ends only."""
    return F.regexp_replace(value, f"^{WHITE_SPACE}|{WHITE_SPACE}$", "")


def clamp(value: Column, top: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(top), F.coalesce(value.try_cast("int"), F.lit(0))))


def json_object(content: Column) -> Column:
    """From the first ``{`` to the last ``}``; null where there is none."""
    return F.nullif(F.regexp_extract(content, r"(?s)\{.*\}", 0), F.lit(""))


def answer_object(content: Column) -> Column:
    """json_object() of a model's answer; an answer that holds no JSON object is an error."""
    body = json_object(content)
    bad = F.from_json(body, "map<string,string>").isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("the answer is no JSON object: "), F.substring(F.coalesce(content, F.lit("null")), 1, 200)))).otherwise(body)


def string_or_list(raw: Column) -> Column:
    """A JSON string as a list of one, a JSON list of strings as it is, anything else as an empty list."""
    trimmed = F.trim(raw)
    listed = F.from_json(trimmed, "array<string>")
    quoted = F.from_json(F.concat(F.lit('{"v":'), trimmed, F.lit("}")), "v string")["v"]
    return F.when(trimmed.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).when(trimmed.startswith('"'), F.array(quoted)).otherwise(
        F.array().cast("array<string>")
    )


def preview(pair: Column, api: Column, score: Column, text: Column) -> Column:
    return F.struct(pair.alias("pair_id"), api.alias("api"), F.bround(score, 6).alias("score"), text.alias("knowledge_unit"))
