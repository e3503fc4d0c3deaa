"""Merkle trees over a text's sections and paragraphs: roots test equality, differing branches locate edits.

A paragraph is a line, its digest the SHA-256 of it.  A section starts at the first paragraph, at a Markdown heading, after
blank paragraphs, and at each paragraph whose digest begins with 0 (one in 16), so that an edit moves no boundary but those
beside it.  A section's digest is that of its paragraphs' digests, the root that of the sections' digests.

A fingerprint is text: the root, then ``:`` and its paragraphs for each section, which ``,`` parts.  A paragraph is given as
the first 24 bits of the MD5 of each of its pieces (up to 128 characters and the sentence end after them): the interior of
the tree follows from its leaves, and the shares of pieces make a likeness.  It takes about a seventh of the text's room.

All of it is Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cairn.functions.columns import let
from cairn.llm._spark import Scratch

PIECE = r"[^.!?]{1,128}[.!?]*|[.!?]+"
HEADING = r"^#{1,6}\s"
#: Hex digits of a root and of a piece.
ROOT, LEAF = 64, 6


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def _paragraph(line: Column) -> Column:
    return F.concat_ws("", F.transform(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), lambda p: F.substring(F.md5(p), 1, LEAF)))


def _tree(lines: Column, digests: Column) -> Column:
    n = F.size(lines)

    def begins(i: Column) -> Column:
        line = F.get(lines, i)
        return (i == 0) | (F.get(digests, i) < "1") | line.rlike(HEADING) | (_blank(F.get(lines, i - 1)) & ~_blank(line))

    def spans(starts: Column) -> Column:
        return F.transform(starts, lambda s, j: F.struct((s + 1).alias("at"), (F.coalesce(F.get(starts, j + 1), n) - s).alias("n")))

    def written(own: Column) -> Column:
        root = F.sha2(F.concat_ws(";", F.transform(own, lambda x: F.sha2(F.concat_ws(",", F.slice(digests, x["at"], x["n"])), 256))), 256)
        body = F.transform(own, lambda x: F.concat(F.lit(":"), F.concat_ws(",", F.transform(F.slice(lines, x["at"], x["n"]), _paragraph))))
        return F.concat(root, F.concat_ws("", body))

    return let(spans(F.filter(F.sequence(F.lit(0), n - 1), begins)), written)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty, which is one section of one empty paragraph."""
    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda lines: let(F.transform(lines, lambda x: F.sha2(x, 256)), lambda digests: _tree(lines, digests)))


def root(print_: Column) -> Column:
    return F.substring(print_, 1, ROOT)


def _pieces(print_: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.substring(print_, ROOT + 1, 1 << 30), F.lit(f"[0-9a-f]{{{LEAF}}}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """1.0 exactly where the roots are equal, else twice the shared distinct pieces by all distinct pieces of both, under 1.

    0.0 if there are no pieces; null for a null fingerprint.
    """

    def share(x: Column, y: Column) -> Column:
        total = F.size(x) + F.size(y)
        same = F.least(F.size(F.array_intersect(x, y)) * F.lit(2.0), total - F.lit(1.0))
        return F.when(total == 0, F.lit(0.0)).otherwise(same / total)

    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(let(_pieces(a), lambda x: let(_pieces(b), lambda y: share(x, y))))


def edits(a: Column, b: Column) -> Column:
    """Where b differs: ``section, paragraph`` (from 0) of b's paragraphs that a hasn't, searched only in sections that a hasn't.

    Empty where the roots are equal, and where paragraphs only went or changed their places.
    """
    sections = lambda p: F.split(F.substring(p, ROOT + 2, 1 << 30), ":", -1)

    def differing(old: Column, new: Column, known: Column) -> Column:
        def inside(s: Column, i: Column) -> Column:
            own = F.transform(F.split(s, ",", -1), lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), p.alias("p")))
            return F.when(F.array_contains(old, s), F.filter(own, lambda x: F.lit(False))).otherwise(F.filter(own, lambda x: ~F.array_contains(known, x["p"])))

        return F.transform(F.flatten(F.transform(new, inside)), lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph")))

    return let(sections(a), lambda old: let(F.array_distinct(F.flatten(F.transform(old, lambda s: F.split(s, ",", -1)))), lambda known: let(sections(b), lambda new: differing(old, new, known))))


def _next_keys(light: DataFrame, scratch: Scratch, id_col: str) -> DataFrame:
    """(key, id, ...) with distinct keys -> those with ``next``, the key that follows by (id, key); after the last comes the first.

    A range-partitioned sort, a window inside each partition, and one row a partition for what follows its last row.
    """
    n = max(1, int(light.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    table = scratch.table(light.repartitionByRange(n, id_col, "key").withColumn("part", F.spark_partition_id()), "order")
    first = table.groupBy("part").agg(F.min(F.struct(id_col, "key")).alias("first"))
    parts = Window.orderBy("part")
    after = first.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))["key"].alias("after"))
    own = F.lead("key").over(Window.partitionBy("part").orderBy(id_col, "key"))
    return table.withColumn("own", own).join(F.broadcast(after), "part").withColumn("next", F.coalesce("own", "after")).drop("own", "after", "part")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint and that of its edited text, with their likeness and that to the next document's.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id``.  The edited text has its
    last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document.  Null texts are empty;
    null ids come first; rows that share an id follow one another by a digest of their texts, and a repeated row's next is
    its own copy, but for the last of them.  A single document's next is itself.  Other columns are left out.

    Texts are shuffled once (both joins read the same columns of it), by a digest of id and text that also drops copies
    before the shuffle; what a document gives to
    the one before it (its beginning and its fingerprint) is shuffled to that one's place.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.lit(":"), "text"), 256))
    light = rows.select("doc_id", "key", F.char_length("text").alias("n")).groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    follows = scratch.table(_next_keys(light, scratch, "doc_id"), "follows")
    whole = rows.dropDuplicates(["key"])
    quarter = F.floor(F.col("n") / 4).cast("int")
    gives = follows.select(F.col("next").alias("key"), quarter.alias("want"), F.col("key").alias("to"), "copies")
    given = whole.join(gives, "key").select(F.col("to").alias("key"), F.col("doc_id").alias("next_id"), "copies", F.substring("text", F.lit(1), F.col("want")).alias("head"), fingerprint(F.col("text")).alias("next_print"))
    n, size = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    own = whole.join(given, "key").select("doc_id", "text", n.cast("long").alias("n_chars"), size.alias("q"), "copies", "next_id", "head", "next_print", fingerprint(F.col("text")).alias("fingerprint"))
    # the copies before the last are followed by themselves
    self_next = F.struct(F.col("doc_id").alias("next_id"), F.substring("text", F.lit(1), F.col("q")).alias("head"), F.col("fingerprint").alias("next_print"), (F.col("copies") - 1).alias("times"))
    real_next = F.struct("next_id", "head", "next_print", F.lit(1).cast("long").alias("times"))
    variants = own.withColumn("v", F.explode(F.when(F.col("copies") > 1, F.array(real_next, self_next)).otherwise(F.array(real_next))))
    edited = variants.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("q")).cast("int")), "v.head"))
    out = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), F.col("v.next_id").alias("next_id"), F.col("v.next_print").alias("next_print"), F.col("v.times").alias("times"))
    out = out.withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_print"))}).drop("next_print")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("copy", "times")
