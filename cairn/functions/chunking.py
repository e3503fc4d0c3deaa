"""Chunkers as Column expressions: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions import paths
from cairn.functions.columns import let

#: Windows are cut from segments of so many windows, and those from segments of as many segments, as each substring() walks its input from the start.
SEGMENT = 64

# Where a code block begins, by language, as Java patterns with Python's meaning of \w and $.
PY_BLOCK = r"(?mdU)(?=^class \w+[\(\w\)]*:|^def \w+\([^\)]*\):)"
JS_BLOCK = r"(?mdU)(?=^class \w+ \{|^(?:async )?function \w+\([^\)]*\) \{|\b\w+ = (?:\(\) =>|function\([^\)]*\)) \{)"
SECTION = r"(?md)(?=^#{1,3} .+$)"


def newlines(text: Column) -> Column:
    """\\r\\n and \\r become \\n."""
    return F.regexp_replace(text, "\r\n?", "\n")


def fixed_windows(text: Column, size: int = 200, overlap: int = 50) -> Column:
    """Windows of ``size`` code points that begin every ``size - overlap``; the last is the first that reaches the end.

    Null and empty texts have none.  ValueError unless 0 <= overlap < size.
    """
    if not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must be at least 0 and under size {size}")
    step = size - overlap

    def cut(own: Column, count: Column, level: int) -> Column:
        """The first ``count`` windows of a text: from segments of SEGMENT ** level windows, each of which is bound once."""
        if level == 0:
            return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(own, i * F.lit(step) + 1, F.lit(size)))
        each = SEGMENT**level

        def segment(j: Column) -> Column:
            part = F.substring(own, j * F.lit(each * step) + 1, F.lit((each - 1) * step + size))
            left = F.least(F.lit(each), count - j * each)
            return let(part, lambda p: let(left, lambda n: cut(p, n, level - 1)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(count / each).cast("int") - 1), segment))

    def windows(length: Column) -> Column:
        n = F.when(length <= size, F.lit(1)).otherwise(F.ceil((length - size) / step).cast("int") + 1)
        short = F.when(length > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
        return F.when(length > size, let(n, lambda count: cut(text, count, 2))).otherwise(short)

    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(let(F.char_length(text), windows))


def _resplit(parts: Column, size: int, overlap: int) -> Column:
    cut = lambda p: F.when(F.char_length(p) > size, fixed_windows(p, size, overlap)).otherwise(F.array(p))
    return F.flatten(F.transform(F.filter(parts, lambda p: p != ""), cut))


def markdown_chunks(text: Column, size: int = 400, overlap: int = 50) -> Column:
    """Sections that begin at headings of level 1 to 3; longer ones are cut by ``fixed_windows``."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(_resplit(F.split(text, SECTION), size, overlap))


def code_chunks(text: Column, language: Column, size: int = 500, overlap: int = 50) -> Column:
    """Blocks that begin at definitions in column 0; languages without patterns of their own use Python's."""
    parts = F.when(language == "javascript", F.split(text, JS_BLOCK)).otherwise(F.split(text, PY_BLOCK))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(_resplit(parts, size, overlap))


def markdown_title(text: Column) -> Column:
    """The first heading of any level without its marks, else the first line of the stripped text; '' for none."""
    heading = F.regexp_extract(text, r"(?md)^(#+ .+)$", 1)
    first = F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "\n")[0]
    return F.coalesce(F.when(heading != "", F.regexp_replace(heading, "^[# ]+|[# ]+$", "")).otherwise(first), F.lit(""))


def heading_level(chunk: Column) -> Column:
    n = F.length(F.regexp_extract(chunk, r"(?md)^(#+) (.+)$", 1))
    return F.when(n > 0, n)


def section_title(chunk: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(chunk, r"(?md)^(#+) (.+)$", 2), r"(?U)^\s+|\s+$", ""), F.lit(""))


def _symbol(chunk: Column, language: Column) -> tuple[Column, Column]:
    js = language == "javascript"
    first = lambda p, g=1: F.nullif(F.regexp_extract(chunk, p, g), F.lit(""))
    py_class = F.when(F.regexp_like(chunk, F.lit(r"(?mdU)^class \w+[\(\w\)]*:")), first(r"(?mdU)^class (\w+)[\(\w\)]*:"))
    py_def = first(r"(?mdU)^def (\w+)\([^\)]*\):")
    js_class = first(r"(?mdU)^class (\w+) \{")
    js_any = r"(?mdU)^(?:async )?function (\w+)\([^\)]*\) \{|\b(\w+) = (?:\(\) =>|function\([^\)]*\)) \{"
    js_def = F.coalesce(first(js_any, 1), first(js_any, 2))
    cls, fn = F.when(js, js_class).otherwise(py_class), F.when(js, js_def).otherwise(py_def)
    return F.when(cls.isNotNull(), F.lit("class")).when(fn.isNotNull(), F.lit("function")), F.coalesce(cls, fn)


def symbol_type(chunk: Column, language: Column) -> Column:
    """class (which wins), function or null."""
    return _symbol(chunk, language)[0]


def symbol_name(chunk: Column, language: Column) -> Column:
    return _symbol(chunk, language)[1]


def explode_chunks(df: DataFrame, chunks: Column) -> DataFrame:
    """A row for each chunk: ``content, chunk_index, chunk_total`` after the columns of ``df``."""
    own = df.withColumn("__chunks", chunks)
    return own.select(*df.columns, F.size("__chunks").alias("chunk_total"), F.posexplode("__chunks").alias("chunk_index", "content"))


def file_columns(df: DataFrame, path: str = "source", base_dir: str = "") -> DataFrame:
    p = F.col(path)
    return df.withColumns({"relative_path": paths.relative(p, base_dir), "file_name": paths.basename(p), "file_extension": paths.extension(p)})


def chunk_markdown_files(files: DataFrame, base_dir: str = "", size: int = 400, overlap: int = 50) -> DataFrame:
    """files (source, text) -> chunk rows with file, title and section columns."""
    own = file_columns(files.withColumn("text", newlines(F.col("text"))), base_dir=base_dir).withColumns({"source_type": F.lit("markdown"), "title": markdown_title(F.col("text"))})
    out = explode_chunks(own, markdown_chunks(F.col("text"), size, overlap)).drop("text")
    return out.withColumns({"heading_level": heading_level(F.col("content")), "section_title": section_title(F.col("content"))})


def chunk_code_files(files: DataFrame, base_dir: str = "", size: int = 500, overlap: int = 50) -> DataFrame:
    """files (source, text) -> chunk rows with file, language, module and symbol columns; files of unknown language are left out."""
    own = file_columns(files.withColumn("text", newlines(F.col("text"))), base_dir=base_dir).withColumns({"source_type": F.lit("code"), "language": paths.code_language(F.col("source"))}).where("language is not null")
    lang, content = F.col("language"), F.col("content")
    out = explode_chunks(own, code_chunks(F.col("text"), lang, size, overlap)).drop("text")
    return out.withColumns({"module_name": F.when(lang == "python", paths.stem(F.col("source"))), "symbol_type": symbol_type(content, lang), "symbol_name": symbol_name(content, lang)})


def chunk_files(files: DataFrame, base_dir: str = "") -> DataFrame:
    """Markdown and code files by extension, in one pass over ``files``; others give no rows."""
    kind, text = paths.file_kind(F.col("source")), F.col("text")
    own = file_columns(files.where(kind.isin("markdown", "code")).withColumn("text", newlines(text)), base_dir=base_dir).withColumn("source_type", kind)
    md, lang, content = F.col("source_type") == "markdown", F.col("language"), F.col("content")
    own = own.withColumns({"title": F.when(md, markdown_title(text)), "language": F.when(~md, paths.code_language(F.col("source")))}).where(md | lang.isNotNull())
    out = explode_chunks(own, F.when(md, markdown_chunks(text)).otherwise(code_chunks(text, lang))).drop("text")
    out = out.withColumns({"heading_level": F.when(md, heading_level(content)), "section_title": F.when(md, section_title(content))})
    last = {"module_name": F.when(lang == "python", paths.stem(F.col("source"))), "symbol_type": F.when(~md, symbol_type(content, lang)), "symbol_name": F.when(~md, symbol_name(content, lang))}
    return out.select(*[c for c in out.columns if c != "language"], "language", *[c.alias(n) for n, c in last.items()])
