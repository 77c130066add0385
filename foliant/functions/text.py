"""Text functions as Column expressions: folding, query terms, word counts, script ratios, relevance."""

from __future__ import annotations

import functools
import operator
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points taken for Han, kana and Hangul.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
KANA = r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}"
HANGUL = r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}"
ALNUM = r"\p{IsAlphabetic}\p{N}"
BREAK = "\u0001"
# Signs that may be Han, or become it by NFKC: all from the radicals on.
HAN_MAYBE = r"[\x{2E80}-\x{10FFFF}]"


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility normalisation, for which Spark has no function; ASCII is normal and stays in the JVM."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, text).otherwise(F.pandas_udf(_nfkc, "string")(F.when(~plain, text)))


def fold(text: Column, normalised: bool = False) -> Column:
    """Search form: NFKC, lower case, runs of other characters as one break. A break between two Han characters goes;
    elsewhere it is a space, and so is every border of Han and other characters. normalised: text is NFKC already.
    ASCII needs one replacement, other text without Han characters one as well."""
    low = F.lower(F.translate(text if normalised else nfkc(text), "Σ", "σ"))
    other = F.trim(F.regexp_replace(low, f"[^{ALNUM}]+", " "))
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(F.length(text) == F.octet_length(text), plain).when(F.rlike(text, F.lit(HAN_MAYBE)), _fold_han(low)).otherwise(other)


def _fold_han(low: Column) -> Column:
    broken = F.regexp_replace(low, f"[^{ALNUM}]+", BREAK)
    joined = F.regexp_replace(broken, f"([{HAN}]){BREAK}(?=[{HAN}])", "$1")
    spaced = F.regexp_replace(joined, f"([{HAN}])(?=[^{HAN}{BREAK}])", "$1 ")
    spaced = F.regexp_replace(spaced, f"([^{HAN}{BREAK} ])(?=[{HAN}])", "$1 ")
    return F.trim(F.translate(spaced, BREAK, " "))


def once(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often use names it; the optimizer can't take it apart."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def terms(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda t: t != "")


def matches_terms(folded_text: Column, folded_terms: list[str]) -> Column:
    """The same for terms known when the plan is made."""
    if not folded_terms:
        return folded_text.isNotNull()
    return F.exists(F.array(folded_text), lambda f: functools.reduce(operator.and_, [F.contains(f, F.lit(t)) for t in folded_terms]))


def strength(folded_text: Column, term: Column) -> Column:
    return F.when(folded_text == term, 3).when(F.startswith(folded_text, term), 2).when(F.contains(folded_text, term), 1).otherwise(0)


def total_strength(folded_text: Column, folded_terms: list[str]) -> Column:
    """How strongly a text matches all terms together: the sum of each, 0 without terms, null for a null text."""
    if not folded_terms:
        return F.when(folded_text.isNotNull(), 0)
    return once(folded_text, lambda f: F.when(f.isNotNull(), functools.reduce(operator.add, [strength(f, F.lit(t)) for t in folded_terms])))


def word_count(text: Column) -> Column:
    """Each Han character is a word; so is each run of other letters and digits."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[{HAN}]|[[{ALNUM}]&&[^{HAN}]]+")), F.lit(0)).cast("long")


def script_counts(text: Column) -> Column:
    count = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")
    return F.struct(count(f"[{ALNUM}]").alias("total"), count(f"[{HAN}]").alias("han"), count(f"[{KANA}]").alias("kana"), count(f"[{HANGUL}]").alias("hangul"))


def guess_language(text: Column) -> Column:
    """ja above 1 % kana, ko above 5 % Hangul, zh above 15 % Han, of all letters and digits; else null."""
    c = script_counts(text)
    share = lambda name: c[name] * 100 / c["total"]
    return F.when(c["total"] == 0, None).when(share("kana") > 1, "ja").when(share("hangul") > 5, "ko").when(share("han") > 15, "zh")


def collapse_blank_lines(text: Column) -> Column:
    """Lines trimmed, at most one blank line in a row, none at either end."""
    lines = F.array_join(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def nocase(text: Column) -> Column:
    """Key of ASCII-case-insensitive vocabularies; other letters keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dedupe_nocase(names: Column) -> Column:
    """Trimmed, without empty ones, the first spelling of each, by key."""
    clean = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")
    first = F.filter(F.transform(clean, lambda x, i: F.struct(nocase(x).alias("key"), x.alias("name"), F.array_position(F.transform(clean, nocase), nocase(x)).alias("at"), (i + 1).alias("own"))), lambda s: s["at"] == s["own"])
    return F.transform(F.array_sort(F.transform(first, lambda s: F.struct(s["key"], s["name"]))), lambda s: s["name"])


def string_array(json: Column) -> Column:
    """A JSON array of strings; anything else gives an empty array."""
    values = F.from_json(json, "array<variant>")
    sound = values.isNotNull() & F.forall(values, lambda v: v.isNotNull() & (F.schema_of_variant(v) == "STRING"))
    return F.when(sound, F.from_json(json, "array<string>")).otherwise(F.array().cast("array<string>"))
