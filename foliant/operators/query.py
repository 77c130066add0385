"""Filters, scoped search, weighted relevance, sorting, facets and grouping over works."""

from __future__ import annotations

import functools
import operator
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant import storage
from foliant.functions import text

#: Titles sort as in Chinese libraries: Han by pinyin, then Latin by letters.
TITLE_COLLATION = "zh_Hans_CHN"
SCOPES = ("title", "author", "tag", "comment", "summary", "lang")
# Weight of a match in each scope.
WEIGHTS = {"title": 100, "author": 40, "tag": 30, "lang": 20, "comment": 15, "summary": 10}
COLUMNS = {"title": ("title",), "author": ("author",), "summary": ("summary",), "comment": ("my_comment",), "lang": ("language", "language_label"), "tag": ("tags", "source_tags")}


@dataclass
class Options:
    search: str = ""
    tags: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    include_record_only: bool = False
    sort: str = "published"
    descending: bool = True
    #: observed: undated works change sides with the direction; last: always at the end.
    undated: str = "observed"


def parse_query(raw: str) -> list[tuple[str, str]]:
    """(scope, term) pairs; a bare prefix is a plain term."""
    out = []
    for word in raw.split():
        name, colon, rest = word.partition(":")
        out.append((name.lower(), rest) if colon and rest and name.lower() in SCOPES else ("all", word))
    return out


def fold_literal(term: str) -> str:
    """The folded form of a query term, on the driver: terms are short and few."""
    han = lambda c: any(a <= ord(c) <= b for a, b in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)))
    out, broken = "", False
    for c in unicodedata.normalize("NFKC", term):
        for x in c.lower():
            if not (x.isalpha() or unicodedata.category(x)[0] == "N"):
                broken = bool(out)
                continue
            if out and ((broken and not (han(out[-1]) and han(x))) or han(out[-1]) != han(x)) and out[-1] != " ":
                out += " "
            out, broken = out + x, False
    return out


def scope_text(works: DataFrame, scope: str) -> Column:
    """Folded text of a scope; a column the table lacks counts as empty."""
    parts = []
    for name in COLUMNS[scope]:
        if name in works.columns:
            parts.append(F.array_join(name, " ") if works.schema[name].dataType.typeName() == "array" else F.coalesce(name, F.lit("")))
    return text.fold(F.concat_ws(" ", *parts)) if parts else F.lit("")


def with_folded(works: DataFrame) -> DataFrame:
    """A folded column per scope, for tables that are stored and searched again."""
    return works.select("*", *[scope_text(works, scope).alias(f"_fold_{scope}") for scope in SCOPES])


def searched(search: str) -> list[tuple[tuple[str, ...], str]]:
    """For every term the scopes it may stand in, and its folded form."""
    return [(SCOPES if scope == "all" else (scope,), fold_literal(raw)) for scope, raw in parse_query(search)]


def relevance(folded: Column, search: str) -> Column:
    """The weighted relevance of a row, null if a term is missing. folded: a struct with the folded text of each scope.
    A term of signs only is in no row."""
    hits, scores = [], []
    for scopes, term in searched(search):
        if not term:
            hits.append(F.lit(False))
            continue
        hits.append(functools.reduce(operator.or_, [F.contains(folded[s], F.lit(term)) for s in scopes]))
        scores.append(functools.reduce(operator.add, [text.strength(folded[s], F.lit(term)) * WEIGHTS[s] for s in scopes]))
    return F.when(functools.reduce(operator.and_, hits), functools.reduce(operator.add, scores) if scores else F.lit(0))


def select(works: DataFrame, options: Options) -> DataFrame:
    """Works that pass every filter, with relevance. Folded columns that works has are used, others are made, once."""
    out = works if options.include_record_only else works.filter(F.col("status") != "record_only")
    if options.languages:
        out = out.filter(F.coalesce("language", F.lit("")).isin(*options.languages))
    if options.tags:
        wanted = sorted({t.lower() for t in options.tags})
        out = out.filter(F.size(F.array_intersect(F.transform("tags", F.lower), F.array(*map(F.lit, wanted)))) == len(wanted))
    stored = [f"_fold_{s}" for s in SCOPES]
    if not options.search.strip():
        return out.withColumn("relevance", F.lit(0)).drop(*stored)
    folded = F.struct(*[(F.col(c) if c in works.columns else scope_text(works, s)).alias(s) for s, c in zip(SCOPES, stored, strict=True)])
    # a generator, so that neither the filter nor what reads the relevance folds again
    found = F.filter(F.transform(F.array(folded), lambda f: relevance(f, options.search)), lambda r: r.isNotNull())
    return out.select("*", F.explode(found).alias("relevance")).drop(*stored)


def sort_keys(options: Options) -> list[Column]:
    column = {"published": F.col("published_at"), "words": F.col("word_count"), "added": F.col("id"), "title": F.collate("title", TITLE_COLLATION)}[options.sort]
    down = options.descending
    keys = [F.col("relevance").desc()] if options.search.strip() else []
    if options.sort == "published" and options.undated == "observed":
        keys.append(column.desc_nulls_first() if down else column.asc_nulls_last())
        keys.append(F.when(column.isNull(), F.col("id") * (-1 if down else 1)))
    else:
        keys.append(column.desc_nulls_last() if down else column.asc_nulls_last())
    return [*keys, F.col("id")]


def ranked(works: DataFrame, options: Options) -> DataFrame:
    """Selected works with row_no, all columns kept."""
    return storage.numbered(select(works, options), sort_keys(options), "row_no")


def language_facets(works: DataFrame) -> DataFrame:
    """Per code the number of works, the label of the first one and the place in the list: most works first. One task
    numbers the codes, of which there are hundreds at most."""
    coded = works.filter(F.coalesce("language", F.lit("")) != "")
    found = coded.groupBy("language").agg(F.count("*").alias("n_works"), F.min_by(F.coalesce("language_label", "language"), "id").alias("label"))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.col("n_works").desc(), "language")).cast("long"))


def tag_facets(work_tags: DataFrame) -> DataFrame:
    """Per case-folded tag the number of works, the spelling of the first one and the place in the list."""
    keyed = work_tags.withColumn("tag_key", F.lower("name"))
    per_work = keyed.groupBy("tag_key", "work_id").agg(F.min("name").alias("name"))
    found = per_work.groupBy("tag_key").agg(F.count("*").alias("n_works"), F.min_by("name", "work_id").alias("name"))
    return storage.numbered(found, [F.col("n_works").desc(), F.col("tag_key")], "place")
