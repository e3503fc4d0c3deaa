"""Tables in plain text: found, cut into cells, typed, measured and rendered, over an array of lines.

All but NFKC (which Spark lacks) are Column expressions.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cairn.functions.columns import let

#: Cell separators in order of precedence, and words that mark a table's title.
SEPARATORS = ("|", "┃", "｜", "│", "┆", "┊", "：", ":")
TITLE_MARKERS = (
    "表", "テーブル", "一覧", "比較", "対照", "項目", "リスト", "仕様", "設定", "パラメータ", "オプション", "属性", "定義", "概要", "分類",
    "Table", "List", "Comparison", "Parameters", "Options", "Properties", "Attributes", "Settings",
)
# Patterns of cell types, and characters that a cell normally has.
NUMERIC = r"(?U)^[-+]?\d*\.?\d+$"
DATE = r"(?U)^\d{4}[-/年]\d{1,2}[-/月]\d{1,2}"
CODE = r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*$"
ODD = r"(?U)[^\w\s\-_.,;:()\[\]{}！？、。（）［］｛｝]"
JAPANESE = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
ABOVE_KANA = r"[\x{3041}-\x{10FFFF}]"
THRESHOLD = 0.3


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_line(line: Column) -> Column:
    """Cells of a line: by the first separator (in order of precedence) that it has, else by two or more white spaces."""

    def cut(own: Column) -> Column:
        parts = F.when(own == "", F.array().cast("array<string>"))
        for s in SEPARATORS:
            parts = parts.when(own.contains(s), F.split(own, "\\" + s if s == "|" else s))
        return parts.otherwise(F.split(own, r"(?U)\s{2,}"))

    return let(strip(line), lambda own: F.filter(F.transform(cut(own), strip), lambda c: c != ""))


def line_score(line: Column) -> Column:
    """0 for a blank line; .3 for a separator, .2 for a wide gap, .2 for two cells or more, .1 for a digit."""
    any_sep = reduce(Column.__or__, [line.contains(s) for s in SEPARATORS])
    part = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    total = F.lit(0.0) + part(any_sep, 0.3) + part(line.rlike(r"(?U)\s{2,}"), 0.2) + part(F.size(split_line(line)) >= 2, 0.2) + part(line.rlike(r"(?U)\d"), 0.1)
    return F.when(strip(line) == "", F.lit(0.0)).otherwise(total)


def window_means(scores: Column) -> Column:
    """Means of three neighbours; none for fewer than three."""

    def means(s: Column) -> Column:
        at = lambda i: F.get(s, i)
        return F.when(F.size(s) >= 3, F.transform(F.sequence(F.lit(0), F.size(s) - 3), lambda i: (at(i) + at(i + 1) + at(i + 2)) / 3)).otherwise(F.array().cast("array<double>"))

    return let(scores, means)


def boundary(lines: Column) -> Column:
    """struct(start, end) of the first table (end exclusive); null if there is none."""

    def find(above: Column) -> Column:
        start = F.array_position(above, True).cast("int")
        stop = F.array_position(F.slice(above, F.greatest(start, F.lit(1)), F.size(above)), False).cast("int")
        end = F.when(stop > 0, start - 1 + stop - 1).otherwise(F.size(lines))
        return F.when(start > 0, F.struct((start - 1).alias("start"), end.alias("end")))

    return let(F.transform(window_means(F.transform(lines, line_score)), lambda m: m > THRESHOLD), find)


def nfkc(df: DataFrame, column: str) -> DataFrame:
    """NFKC of a column of strings or of rows of cells; other columns pass as they are."""
    at, names, kind = df.columns.index(column), df.columns, df.schema[column].dataType

    def one(x):
        return None if x is None else unicodedata.normalize("NFKC", x) if isinstance(x, str) else [one(y) for y in x]

    def run(parts):
        for part in parts:
            col = part.column(at)
            done = pa.array([one(x) for x in col.to_pylist()], col.type)
            yield pa.RecordBatch.from_arrays([done if j == at else part.column(j) for j in range(len(names))], names=names)

    assert isinstance(kind, T.StringType | T.ArrayType)
    return df.mapInArrow(run, df.schema)


def padded(cells: Column) -> Column:
    """Rows of one width, white space inside cells collapsed."""
    clean = lambda c: strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return let(F.array_max(F.transform(cells, F.size)), lambda width: F.transform(cells, lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: clean(F.coalesce(F.get(r, i), F.lit(""))))))


def columns_of(cells: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(cells[0]) - 1), lambda i: F.transform(cells, lambda r: F.get(r, i)))


def _count(values: Column, cond) -> Column:
    return F.size(F.filter(values, cond))


def _numeric_or_date(v: Column) -> Column:
    return v.rlike(NUMERIC) | v.rlike(DATE)


def alignment(values: Column) -> Column:
    """right if more than half are numbers or dates, else left."""
    return F.when(_count(values, _numeric_or_date) / F.size(values) > 0.5, F.lit("right")).otherwise(F.lit("left"))


def value_type(v: Column) -> Column:
    """null for blank."""
    return F.when(strip(v) == "", F.lit(None)).when(v.rlike(NUMERIC), F.lit("numeric")).when(v.rlike(DATE), F.lit("date")).when(v.rlike(ABOVE_KANA), F.lit("japanese")).when(v.rlike(CODE), F.lit("code")).otherwise(F.lit("text"))


def content_type(values: Column) -> Column:
    """The commonest type; of equals the one that occurs first; text if all are blank."""

    def vote(kinds: Column) -> Column:
        scored = F.transform(F.array_distinct(kinds), lambda t: F.struct(_count(kinds, lambda k: k == t).alias("n"), (-F.array_position(kinds, t)).alias("first"), t.alias("t")))
        return F.coalesce(F.array_max(scored)["t"], F.lit("text"))

    return let(F.filter(F.transform(values, value_type), lambda t: t.isNotNull()), vote)


def type_matches(v: Column, expected: Column) -> Column:
    hit = F.when(expected == "numeric", v.rlike(NUMERIC)).when(expected == "date", v.rlike(DATE)).when(expected == "japanese", v.rlike(JAPANESE)).when(expected == "code", v.rlike(CODE)).otherwise(F.lit(True))
    return (strip(v) == "") | hit


def is_aligned(v: Column, expected: Column) -> Column:
    return (strip(v) == "") | (expected != "right") | _numeric_or_date(strip(v))


def _mean(values: Column) -> Column:
    return let(values, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)).otherwise(F.lit(0.0)))


def cell_quality(c: Column) -> Column:
    japanese = F.regexp_count(c, F.lit(JAPANESE)) / F.char_length(c)
    size = F.when(F.char_length(c) > 100, F.lit(0.7)).when(F.char_length(c) < 2, F.lit(0.8)).otherwise(F.lit(1.0))
    return size * F.when(c.rlike(ODD), F.lit(0.9)).otherwise(F.lit(1.0)) * F.when((japanese > 0) & (japanese < 1), F.lit(0.95)).otherwise(F.lit(1.0))


def content_quality(cells: Column) -> Column:
    return _mean(F.transform(F.filter(F.flatten(cells), lambda c: strip(c) != ""), cell_quality))


def structure_confidence(cells: Column) -> Column:
    """Mean of each row's share of filled cells and each column's share of cells of its type."""
    filled = F.transform(cells, lambda r: _count(r, lambda c: strip(c) != "") / F.size(r))
    typed = F.transform(columns_of(cells), lambda v: let(content_type(v), lambda t: _count(v, lambda x: type_matches(x, t)) / F.size(v)))
    return _mean(F.concat(filled, typed))


def metrics(cells: Column) -> Column:
    flat = F.flatten(cells)
    layout = _mean(F.transform(columns_of(cells), lambda v: let(alignment(v), lambda side: _count(v, lambda x: is_aligned(x, side)) / F.size(v))))
    ratio = let(F.array_join(flat, ""), lambda text: F.when(F.char_length(text) > 0, F.regexp_count(text, F.lit(JAPANESE)) / F.char_length(text)).otherwise(F.lit(0.0)))
    return F.struct(
        F.size(cells[0]).alias("column_count"), F.size(cells).alias("row_count"), (_count(flat, lambda c: strip(c) != "") / F.size(flat)).alias("data_density"),
        ratio.alias("japanese_ratio"), layout.alias("layout_score"), layout.alias("alignment_score"), structure_confidence(cells).alias("structure_confidence"), content_quality(cells).alias("content_quality"),
    )


def title(before: Column) -> Column:
    """Of the last three lines before a table the nearest that has a marker; '' for none."""
    last = F.reverse(F.slice(before, F.greatest(F.size(before) - 2, F.lit(1)), F.lit(3)))
    hits = F.filter(F.transform(last, strip), lambda c: reduce(Column.__or__, [c.contains(m) for m in TITLE_MARKERS]))
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(""))


def markdown(cells: Column, heading: Column) -> Column:
    """A Markdown table: columns as wide as their widest cell (characters over U+007F count two), 3 to 30; right-aligned ones marked."""
    wide = lambda c: F.char_length(c) + F.regexp_count(c, F.lit(r"[^\x00-\x7F]"))
    shape = F.transform(columns_of(cells), lambda v: F.struct(F.greatest(F.lit(3), F.least(F.array_max(F.transform(v, wide)), F.lit(30))).alias("w"), (alignment(v) == "right").alias("right")))
    pad = lambda c, s: F.when(F.char_length(c) >= s["w"], c).otherwise(F.rpad(c, s["w"], F.lit(" ")))

    def render(sh: Column) -> Column:
        row = lambda r: F.concat(F.lit("| "), F.array_join(F.zip_with(r, sh, pad), " | "), F.lit(" |"))
        dashes = F.transform(sh, lambda s: F.when(s["right"], F.concat(F.repeat(F.lit("-"), s["w"] - 1), F.lit(":"))).otherwise(F.repeat(F.lit("-"), s["w"])))
        head = F.when(heading != "", F.array(F.concat(F.lit("\n**"), heading, F.lit("**\n")))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(head, F.array(row(cells[0]), F.concat(F.lit("| "), F.array_join(dashes, " | "), F.lit(" |"))), F.transform(F.slice(cells, 2, 1 << 30), row)), "\n")

    return let(shape, render)


def analyse(df: DataFrame, lines: str = "lines") -> DataFrame:
    """For each row the first table of its lines: ``start_line, end_line, cells, alignments, content_types, title, metrics, markdown``; null where there is none (fewer than two rows of cells)."""
    ls = F.col(lines)
    a = df.withColumn("__at", boundary(ls))
    a = a.withColumn("__cells", F.filter(F.transform(F.slice(ls, F.col("__at.start") + 1, F.col("__at.end") - F.col("__at.start")), split_line), lambda r: F.size(r) > 0))
    a = nfkc(a.withColumn("cells", padded(F.when(F.size("__cells") >= 2, F.col("__cells")))), "cells")
    c, has = F.col("cells"), F.col("cells").isNotNull()
    head = title(F.slice(ls, F.lit(1), F.col("__at.start")))
    return a.withColumns(
        {
            "start_line": F.when(has, F.col("__at.start")), "end_line": F.when(has, F.col("__at.end")), "alignments": F.when(has, F.transform(columns_of(c), alignment)), "content_types": F.when(has, F.transform(columns_of(c), content_type)),
            "title": F.when(has, head), "metrics": F.when(has, metrics(c)), "markdown": F.when(has, markdown(c, head)),
        }
    ).drop("__at", "__cells")


def text_properties(text: Column) -> Column:
    """Shares of characters: space, then letters, digits, punctuation; what is left and in a Japanese block counts as japanese."""
    n = F.char_length(text)
    share = lambda p: F.when(n > 0, F.regexp_count(text, F.lit(p)) / n).otherwise(F.lit(0.0))
    return F.struct(
        share(r"(?U)\s").alias("space_ratio"), share(r"\p{L}").alias("alpha_ratio"), share(r"\p{Nd}").alias("digit_ratio"), share(r"\p{P}").alias("symbol_ratio"),
        share(r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{FF00}-\x{FFEF}&&[^\p{L}\p{Nd}\p{P}]]").alias("japanese_ratio"),
    )
