"""A small invented library that has every shape the read model knows: a translated pair, a series with a gap, versions,
several formats, an estimated count, an approximate year, and a work without a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WORKS = [
    (1, "The Salt Road", "Mira Holt", "Two carters meet.", "again in winter", "2019-03-04", "day", False, 41200, "ao3", "en", "English", "original", "5101", "has_file", ["Travel", "Snow"]),
    (2, "Die Salzstraße", "Jo Brandt", None, None, "2020-01-01", "year", True, 39800, "ao3", "de", "Deutsch", "translation", "5102", "has_file", ["Travel"]),
    (3, "Harbour Lights", "Mira Holt", "A storm.", None, "2019-06-01", "month", False, 12000, "estimated", "en", "English", None, None, "has_file", []),
    (4, "Harbour Nights", "Mira Holt", None, None, None, None, False, 0, None, "en", "English", None, None, "has_file", []),
    (5, "山中信", "陈安", "山里来信。", None, "2021-12-31", "day", False, 8000, "manual", "zh", "中文-普通话 國語", None, "5105", "has_file", ["书信"]),
    (6, "Lost Letters", None, None, "file is gone", None, None, False, 0, None, None, None, None, "5106", "record_only", []),
]
FILES = [(1, "html", "html", 1, "archived", 900), (1, "html", "html", 2, "current", 950), (1, "pdf", "pdf", 1, "current", 5000), (1, "other", "epub", 1, "current", 3000), (2, "html", "html", 1, "current", 910), (3, "other", "txt", 1, "current", 700), (4, "other", "azw3", 1, "current", 800), (5, "other", "epub", 1, "current", 2100)]
TAGS = [(1, "slow"), (1, "Winter"), (2, "winter"), (5, "letters")]
SERIES = [(1, 1, 1), (3, 1, 3), (4, 1, None), (3, 2, 1)]
NAMES = [(1, "harbour books"), (2, "Coast")]
RELATIONS = [(1, 2)]
PENDING = [("7001", 1, "La route du sel", False), ("7002", 5, None, False), ("7003", 5, "Old", True)]


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "works": spark.createDataFrame(WORKS, "id long, title string, author string, summary string, my_comment string, published_at string, published_prec string, date_is_approx boolean, word_count long, word_count_source string, language string, language_label string, translation_role string, external_id string, status string, source_tags array<string>"),
        "files": spark.createDataFrame(FILES, "work_id long, format_class string, format_detail string, version int, role string, size_bytes long"),
        "work_tags": spark.createDataFrame(TAGS, "work_id long, name string"),
        "works_series": spark.createDataFrame(SERIES, "work_id long, series_id long, position int"),
        "series": spark.createDataFrame(NAMES, "series_id long, name string"),
        "relations": spark.createDataFrame(RELATIONS, "work_a long, work_b long"),
        "pending": spark.createDataFrame(PENDING, "external_id string, from_work_id long, title string, dismissed boolean"),
    }
