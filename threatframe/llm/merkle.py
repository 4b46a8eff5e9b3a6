"""Merkle-tree fingerprints of documents (operator 3).

A text is cut at blank lines into sections, a section at line ends into
paragraphs, a paragraph into runs of LEAF_WORDS words with the white space after
them.  Leaves are hashed with xxhash64; a paragraph, a section and the root are
SHA-256 digests of their children's hashes in order.  Equal texts have equal
roots, and since the cuts keep every character, different texts have different
ones (but for hash collisions).  `likeness` is the Jaccard similarity of the
leaf sets: the branches that two trees share; two empty texts are alike (1).

`edit_positions` descends from differing roots to the differing branches of two
trees: among sections and then among paragraphs, what both have in common at the
start and at the end is passed over by digest, the rest is met place by place, and
each differing paragraph is given with its first differing leaf.  Leaves after an
inserted word shift, so a paragraph's later leaves are not told apart.

`fingerprint_edits` also builds each document's edited text from the document
that follows it in (doc_id, xxhash64 of the text) order, the first one after the
last.  Rows are dealt by ranges of doc_id with literal bounds; the first document
of a range is sent to the range before it as well, so the texts are shuffled
once.  Null text counts as empty, a null doc_id sorts first, repeated rows follow
one another, and a single document follows itself.  An empty table gives no rows.
All rows with one doc_id share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threatframe.llm.common import query, table, whole_text
from threatframe.operators.rank import with_range_bucket

LEAF_WORDS = 4


def sections(text: Column, leaf_words: int = LEAF_WORDS) -> Column:
    """The tree's leaves: array of sections of paragraphs of leaf hashes."""
    runs = F.lit(r"\s*+(?:\S++\s*+){1,%d}|\s++" % leaf_words)

    def paragraph(p):
        return F.transform(F.regexp_extract_all(p, runs, F.lit(0)), lambda x: F.xxhash64(x))

    return F.transform(F.split(text, "\n\n", -1),
                       lambda s: F.transform(F.split(s, "\n", -1), paragraph))


def root(tree: Column) -> Column:
    """Hex root digest of `sections`."""
    def digest(parts):
        return F.sha2(F.array_join(parts, ",").cast("binary"), 256)

    return digest(F.transform(tree, lambda s: digest(F.transform(
        s, lambda p: digest(p.cast("array<string>"))))))


def branches(tree: Column) -> Column:
    """Digests of sections and paragraphs with what is below them, for `edit_positions`."""
    def digest(parts):
        return F.sha2(F.array_join(parts, ",").cast("binary"), 256)

    def section(s):
        parts = F.transform(s, lambda p: F.struct(
            digest(p.cast("array<string>")).alias("digest"), p.alias("below")))
        return _let(parts, lambda x: F.struct(digest(x["digest"]).alias("digest"),
                                              x.alias("below")))

    return F.transform(tree, section)


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first_difference(a: Column, b: Column) -> Column:
    """Place of the first item that differs or is missing; -1: none."""
    return F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int") - 1


def _differing(a: Column, b: Column) -> Column:
    """(place, a, b) of differing branches between the common start and the common end."""
    def found(v):
        def end(x):
            return F.size(x) - v["tail"]

        places = F.transform(F.sequence(v["start"], F.greatest(end(a), end(b)) - 1),
                             lambda k: F.struct(k.alias("place"),
                                                F.when(k < end(a), F.get(a, k)).alias("a"),
                                                F.when(k < end(b), F.get(b, k)).alias("b")))
        return F.when(v["start"] < 0, F.slice(places, 1, 0)).otherwise(
            F.filter(places, lambda x: ~x["a"]["digest"].eqNullSafe(x["b"]["digest"])))

    start = _first_difference(a["digest"], b["digest"])
    back = _first_difference(F.reverse(a["digest"]), F.reverse(b["digest"]))
    return _let(start, lambda s: _let(
        F.struct(s.alias("start"), F.least(back, F.size(a) - s, F.size(b) - s).alias("tail")),
        found))


def edit_positions(a: Column, b: Column) -> Column:
    """Array of (section, paragraph, leaf), from 0, where the trees of two `branches` differ;
    empty if their roots are equal.  A branch that one tree lacks counts as empty there."""
    def below(x, kind):
        return F.coalesce(x["below"], F.array().cast(kind))

    part = "array<struct<digest:string,below:array<bigint>>>"

    def in_section(s):
        return F.transform(_differing(below(s["a"], part), below(s["b"], part)), lambda p: F.struct(
            s["place"].alias("section"), p["place"].alias("paragraph"),
            F.greatest(F.lit(0), _first_difference(below(p["a"], "array<bigint>"),
                                                   below(p["b"], "array<bigint>"))).alias("leaf")))

    return F.flatten(F.transform(_differing(a, b), in_section))


def leaves(tree: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(tree)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two leaf sets."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add `fingerprint` (the root) and `leaves` (distinct leaf hashes)."""
    tree = docs.withColumn("_tree", sections(whole_text(text_col)))
    return tree.withColumn("fingerprint", root(F.col("_tree"))) \
        .withColumn("leaves", leaves(F.col("_tree"))).drop("_tree")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """doc_id, text, edited, fingerprint, edited_fingerprint, leaves, edited_leaves, next_leaves,
    edited_at (the places where text and edited differ)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        whole_text(text_col).alias("text"))
    ranged = with_range_bucket(plain, ["doc_id"], 2 * n, "_range")
    # one row per range
    heads = [(r["_range"], r["first"]) for r in
             ranged.groupBy("_range").agg(F.min(F.struct("doc_id")).getField("doc_id")
                                          .alias("first")).orderBy("_range").collect()]
    # The first document of a range is a guest of the range before (of the last
    # one, if it is the first of all); both lists are indexed by range.
    last = heads[-1][0] if heads else 0
    first_of, before = [""] * (last + 1), [0] * (last + 1)
    for k, (r, first) in enumerate(heads):
        first_of[r] = "" if first is None else str(first)
        before[r] = heads[k - 1][0]

    def listed(values):
        return F.get(F.split(F.lit(",".join(map(str, values))), ","), F.col("_range"))

    guest = F.col("doc_id").eqNullSafe(F.when(listed(first_of) != "",
                                              listed(first_of).cast("long")))
    ranges = F.when(guest, F.array(F.col("_range"), F.bitwise_not(listed(before).cast("int")))) \
        .otherwise(F.array(F.col("_range")))
    dealt = (ranged.withColumn("_to", F.explode(ranges))
             .withColumn("_guest", F.col("_to") < 0)
             .withColumn("_range", F.when(F.col("_guest"), F.bitwise_not("_to"))
                         .otherwise(F.col("_to")))
             .drop("_to").repartition(n, "_range"))
    dealt = fingerprint(dealt)
    follow = Window.partitionBy("_range").orderBy("_guest", "doc_id", F.xxhash64("text"))
    paired = (dealt.withColumn("_next", F.lead("text").over(follow))
              .withColumn("next_leaves", F.lead("leaves").over(follow))
              .filter(~F.col("_guest")))
    size = F.length("text")
    cut = F.floor(size / 4).cast("int")
    edited = paired.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), size - cut),
        F.substring(F.col("_next"), F.lit(1), cut)))
    edited = edited.withColumn("_tree", sections(F.col("edited")))
    return (edited.withColumn("edited_fingerprint", root(F.col("_tree")))
            .withColumn("edited_leaves", leaves(F.col("_tree")))
            .withColumn("_old", branches(sections(F.col("text"))))
            .withColumn("_new", branches(F.col("_tree")))
            .withColumn("edited_at", edit_positions(F.col("_old"), F.col("_new")))
            .drop("_tree", "_next", "_range", "_guest", "_old", "_new"))


@query("op3_merkle")
def op3_merkle(spark, sf_dir):
    return fingerprint_edits(table(spark, sf_dir, "documents")).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        "edited_at")
