"""Languages, kinds and provenance: fixed codes and what is shown for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language names as pages state them, and their ISO 639-1 codes. Every name that begins with CHINESE is zh.
CHINESE = "中文"
LANGUAGES = {
    "English": "en", "Deutsch": "de", "Français": "fr", "Español": "es", "Italiano": "it", "Português brasileiro": "pt", "Português": "pt", "Русский": "ru", "日本語": "ja", "한국어": "ko", "Bahasa Indonesia": "id", "Bahasa Melayu": "ms",
    "Tiếng Việt": "vi", "ไทย": "th", "Polski": "pl", "Nederlands": "nl", "Svenska": "sv", "Norsk": "no", "Dansk": "da", "Suomi": "fi", "Čeština": "cs", "Slovenčina": "sk", "Magyar": "hu", "Română": "ro", "Български": "bg",
    "Українська": "uk", "Ελληνικά": "el", "Türkçe": "tr", "العربية": "ar", "עברית": "he", "हिन्दी": "hi", "فارسی": "fa", "Català": "ca", "Galego": "gl", "Latin": "la", "Esperanto": "eo",
}
# Names shown for codes that are typed in.
LABELS = {"zh": "中文-普通话 國語", "en": "English", "ja": "日本語", "ko": "한국어", "fr": "Français", "de": "Deutsch", "es": "Español", "ru": "Русский", "pt": "Português", "it": "Italiano"}
# What a relation is stored as.
RELATION_KINDS = {"translation_of": "translation", "translation_into": "translation", "remix_of": "remix", "inspired_by": "related", "related_to": "related"}
STATUSES = ("has_file", "record_only")
# Explanations of a word count's source and of a date's precision.
COUNT_SOURCES = {"ao3": "AO3 给出的官方字数，精确", "manual": "你手动填写的字数", "estimated": "按文本估算的字数，与 AO3 官方值可能有偏差"}
COUNT_UNKNOWN = "字数未知，可以自己填"
PRECISIONS = {"year": "只知道年份", "month": "只知道年月", "day": "完整日期"}
NO_DATE, APPROXIMATE = "没有日期", "数值为估算"


def lookup(key: Column, values: dict[str, str]) -> Column:
    """The value of a key, null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def language_code(label: Column) -> Column:
    name = F.trim(label)
    return F.when(F.startswith(name, F.lit(CHINESE)), "zh").otherwise(lookup(name, LANGUAGES))


def language_label(code: Column) -> Column:
    """Name of a typed code; a code without one stands for itself."""
    key = F.lower(F.trim(code))
    return F.coalesce(lookup(key, LABELS), key)


def relation_kind(kind: Column) -> Column:
    return lookup(kind, RELATION_KINDS)


def count_title(source: Column) -> Column:
    return F.coalesce(lookup(source, COUNT_SOURCES), F.lit(COUNT_UNKNOWN))


def date_title(precision: Column, approximate: Column) -> Column:
    known = F.coalesce(lookup(precision, PRECISIONS), F.lit(NO_DATE))
    return F.when(approximate, F.concat(known, F.lit("，" + APPROXIMATE))).otherwise(known)


def typed_count(text: Column) -> Column:
    """A count as pasted: only its digits count, none are 0."""
    return F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("bigint"), F.lit(0)).cast("bigint")


def typed_position(text: Column) -> Column:
    """A position as typed: its leading whole number, or null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("int")
