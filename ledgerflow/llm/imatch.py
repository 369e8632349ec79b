"""I-Match fingerprints: hashes of randomised subsets of the lexicon's terms.

Lexicon
    Terms are runs of letters and digits in lower case, told apart by their
    XXH64. The lexicon is the terms within the band of inverse document
    frequency, that is those in ``LOW_DOCS`` documents at least and in
    ``HIGH_SHARE`` of all at most; all 64 bits are counted, so a rare term
    stays out however large the corpus. Every document's terms are counted
    once, and no table of all (document, term) pairs is joined with it: the
    few terms above the band go to each task, a term below it is sent to the
    one document that has it, and the terms that only a cut made in an edited
    text (of its last words) are looked up.

Fingerprint
    A text keeps its distinct terms of the lexicon (all its terms, if fewer
    than ``FEW_TERMS`` are left), sorted by hash. Other bits of the hash deal
    each term to one of ``SUBSETS`` random sub-lexicons; at level l only the
    terms whose next l bits are zero are in them, so that a sub-lexicon has
    about one term of the text at the least level that leaves ``SUBSETS``
    terms at most. The fingerprint spells that level and the next one: for
    each sub-lexicon the hash of the text's terms in it, or nothing.
    Likeness of two fingerprints: at a level both have, the share of equal
    ones among the sub-lexicons that have a term in either. Two texts without
    terms are alike by 1; texts without a level in common by 0.

Edited texts
    The successor of each document is found on ids alone: they are dealt out
    by range, numbered rows follow each other within a range and the first of
    the next range follows the last. Texts move once, to the hash of their
    row; the successor's first code points come to them from there.
    Order: ascending doc_id, null ids last, ties by the text's hash; rows
    repeated in full follow each other.

Null text counts as empty. A single document is its own successor. An empty
table gives an empty answer. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import row_key, text_of, written

CLASS_BITS = 20
LOW_DOCS = 2
HIGH_SHARE = 0.1
FEW_TERMS = 8
SUBSETS = 32
SUBSET_BITS = 5
SEPARATORS = r"[^\p{L}\p{N}]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def term_hashes(text: Column) -> Column:
    """array<long> of the hashes of a text's distinct terms."""
    terms = F.split(F.lower(text), SEPARATORS, -1)
    return F.array_distinct(F.array_remove(F.transform(terms, lambda t: F.xxhash64(t)), F.xxhash64(F.lit(""))))


def counted_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, docs, owner): the number of rows with each term, and the hash of the row key of one of them. Written."""
    owner = F.xxhash64(row_key(id_col, text_col)).alias("owner")
    terms = docs.select(owner, F.explode(term_hashes(text_of(text_col))).alias("term"))
    return written(terms.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.min("owner").alias("owner")), "terms")


def _power_of_two(exponent: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), exponent)


def _longs(values: list[int]) -> Column:
    listed = F.split(F.lit(",".join(map(str, values))), ",") if values else F.array()
    return listed.cast("array<bigint>")


def _level(n: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / F.lit(SUBSETS))).cast("int"))


def _at_level(terms: Column, level: Column) -> Column:
    mask = F.call_function("shiftleft", _power_of_two(level) - 1, F.lit(CLASS_BITS + SUBSET_BITS))
    return let(mask, lambda mask: F.filter(terms, lambda t: t.bitwiseAND(mask) == 0))


def thinned(terms: Column) -> Column:
    """struct<n int, terms array<long>>: how many terms there are, and those that a fingerprint of so many or more reads."""
    return F.struct(F.size(terms).alias("n"), _at_level(terms, _level(F.size(terms))).alias("terms"))


def fingerprint(n: Column, terms: Column) -> Column:
    """struct<level int, here array<string>, above array<string>> of ``n`` terms, given thinned."""

    subsets = _longs([subset << CLASS_BITS for subset in range(SUBSETS)])

    def subset_of(term: Column) -> Column:
        return term.bitwiseAND(F.lit((SUBSETS - 1) << CLASS_BITS).cast("bigint"))

    def subset_hashes(terms: Column) -> Column:
        def of_subset(here: Column, subset: Column) -> Column:
            own = F.filter(terms, lambda t: subset_of(t) == subset)
            spelled = F.lpad(F.lower(F.hex(F.xxhash64(own).bitwiseAND(F.lit(0xFFFF)))), 4, "0")
            return F.when(F.array_contains(here, subset), spelled).otherwise(F.lit(""))

        # The subsets that have a term are found first: the others, half of them and more, are not gone through.
        return let(F.transform(terms, subset_of), lambda here: F.transform(subsets, lambda subset: of_subset(here, subset)))

    def of_level(level: Column) -> Column:
        def of_here(here: Column) -> Column:
            above = let(_at_level(here, level + 1), subset_hashes)
            return F.struct(level.alias("level"), subset_hashes(here).alias("here"), above.alias("above"))

        return let(F.array_sort(_at_level(terms, level)), of_here)

    return let(_level(n), of_level)


def _of_document(every: Column, high: Column, rare: Column) -> Column:
    """The terms of a document's fingerprint, thinned: without those above and below the band, or all if too few are left."""
    kept = F.array_except(every, F.concat(high, rare))
    return let(kept, lambda kept: let(F.when(F.size(kept) < FEW_TERMS, every).otherwise(kept), thinned))


def spelled(print_: Column) -> Column:
    """``level:hashes/hashes``, hashes joined by commas."""
    return F.concat(
        print_["level"].cast("string"), F.lit(":"), F.array_join(print_["here"], ","), F.lit("/"), F.array_join(print_["above"], ",")
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes at a common level, 0 to 1."""

    def share(x: Column, y: Column) -> Column:
        def of_marks(marks: Column) -> Column:
            some, equal = F.size(F.array_remove(marks, 0)), F.size(F.filter(marks, lambda m: m == 2))
            return F.when(some == 0, F.lit(1.0)).otherwise(equal / some)

        # Of each sub-lexicon: 0 if neither has a term in it, 2 if the hashes are equal.
        return let(F.zip_with(x, y, lambda p, q: F.when(p != q, 1).when(p == "", 0).otherwise(2)), of_marks)

    def compared(a: Column, b: Column) -> Column:
        return (
            F.when(a["level"] == b["level"], share(a["here"], b["here"]))
            .when(a["level"] + 1 == b["level"], share(a["above"], b["here"]))
            .when(a["level"] == b["level"] + 1, share(a["here"], b["above"]))
            .otherwise(F.lit(0.0))
        )

    return let(a, lambda a: let(b, lambda b: compared(a, b)))


def successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, n_chars, next_key, copies): ``copies`` rows of that key are followed by a row of next_key."""
    spark = docs.sparkSession
    rows = (
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.length(text_of(text_col)).alias("n_chars"))
        .groupBy("doc_id", "row_key", "n_chars")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("row_key").asc()]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that a row's range is settled once.
    ranged = written(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranged")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_key")))
    firsts = ranged.groupBy("range").agg(first.alias("first"))
    by_range = Window.orderBy("range")  # one row per range
    after = firsts.select(
        "range",
        F.coalesce(
            F.lead("first.row_key").over(by_range),
            F.first("first.row_key").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("after"),
    )
    following = ranged.withColumn("next_key", F.lead("row_key").over(Window.partitionBy("range").orderBy(*order))).join(after, "range")
    # Of rows repeated in full all but the last are followed by their like.
    steps = F.array(
        F.struct(F.coalesce("next_key", "after").alias("next_key"), F.lit(1).cast("bigint").alias("copies")),
        F.struct(F.col("row_key").alias("next_key"), (F.col("rows") - 1).alias("copies")),
    )
    return (
        following.select("doc_id", "row_key", "n_chars", F.explode(steps).alias("step"))
        .select("doc_id", "row_key", "n_chars", "step.next_key", "step.copies")
        .where(F.col("copies") > 0)
    )


def imatch_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    if LOW_DOCS > 2:
        raise ValueError("a term below the band is sent to one document only")
    counted = counted_terms(docs, id_col, text_col)
    above = F.col("docs") > F.lit(HIGH_SHARE * docs.count())
    # At most 1 / HIGH_SHARE times the mean number of a document's terms.
    high = _longs([r["term"] for r in counted.where(above).select("term").collect()])
    band = counted.where((F.col("docs") >= LOW_DOCS) & ~above).select("term")
    # Rows whose keys' hashes are equal share a list; a term in it is in one document all the same.
    rare = counted.where(F.col("docs") < LOW_DOCS).groupBy("owner").agg(F.collect_list("term").alias("rare"))
    none = _longs([])

    texts = (
        docs.select(row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text"))
        .groupBy("key")
        .agg(F.first("text").alias("text"))
    )
    steps = successors(docs, id_col, text_col).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    for key, name in (("row_key", "own_rare"), ("next_key", "next_rare")):
        listed = rare.select("owner", F.col("rare").alias(name))
        steps = (
            steps.withColumn("owner", F.xxhash64(key)).join(listed, "owner", "left").drop("owner")
            .withColumn(name, F.coalesce(name, none))
        )
    ending = F.col("text").substr(F.lit(1), F.col("cut"))

    def of_next(every: Column) -> Column:
        def of_ending(ended: Column) -> Column:
            return F.struct(
                _of_document(every, high, F.col("next_rare")).alias("print_terms"),
                F.array_except(ended, every).alias("made"),
                F.array_intersect(F.col("next_rare"), ended).alias("rare"),
            )

        return let(term_hashes(ending), of_ending)

    brought = steps.join(texts, steps["next_key"] == texts["key"]).select(
        "doc_id", "row_key", "n_chars", "cut", "copies", "own_rare", ending.alias("ending"),
        let(term_hashes(F.col("text")), of_next).alias("next"),
    )
    both = brought.join(texts.select("key", "text"), brought["row_key"] == F.col("key"))
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars") - F.col("cut")), F.col("ending"))

    def of_terms(own: Column) -> Column:
        def of_edited(every: Column) -> Column:
            of_either = F.array_except(term_hashes(F.col("ending")), F.col("next.made"))
            made = F.array_except(every, F.concat(own, of_either, high))

            def of_made(made: Column) -> Column:
                kept = F.array_except(every, F.concat(high, F.col("own_rare"), F.col("next.rare"), made))
                return let(kept, lambda kept: F.struct(
                    _of_document(own, high, F.col("own_rare")).alias("own"),
                    made.alias("made"),
                    thinned(kept).alias("edited"),
                    F.when(F.size(kept) < FEW_TERMS, thinned(every)).alias("all_edited"),
                ))

            return let(made, of_made)

        return let(term_hashes(edited), of_edited)

    found = both.select(
        "doc_id", "n_chars", "copies", F.unhex(F.sha2(edited, 256)).alias("edited_sha256"), F.col("next.print_terms").alias("next_terms"),
        let(term_hashes(F.col("text")), of_terms).alias("terms"),
    )
    own_print = fingerprint(F.col("terms.own.n"), F.col("terms.own.terms"))
    next_print = fingerprint(F.col("next_terms.n"), F.col("next_terms.terms"))
    compared = let(own_print, lambda print_: F.struct(print_.alias("print"), likeness(print_, next_print).alias("near_next")))
    # Written, so that a row's number is settled once. Of the own terms only their fingerprint goes on.
    numbered = written(
        found.select("doc_id", "n_chars", "copies", "edited_sha256", F.col("terms").dropFields("own").alias("edited_terms"), compared.alias("compared"))
        .select("doc_id", "n_chars", "copies", "edited_sha256", F.col("edited_terms").alias("terms"), "compared.print", "compared.near_next")
        .withColumn("row", F.monotonically_increasing_id()),
        "edited",
    )
    # A term that many edited texts end in is not gathered: its rows are a skewed side of a join with a unique key.
    looked_up = numbered.select("row", F.explode("terms.made").alias("term")).join(band, "term")
    more = looked_up.groupBy("row").agg(F.collect_list("term").alias("more"))
    whole = numbered.join(more, "row", "left").withColumn("more", F.coalesce("more", none))
    n, all_terms = F.col("terms.edited.n") + F.size("more"), F.col("terms.all_edited")
    few = n < FEW_TERMS
    kept = F.concat(F.col("terms.edited.terms"), F.col("more"))
    printed = whole.select(
        "doc_id", "n_chars", "copies", "edited_sha256", "near_next", "print",
        fingerprint(F.when(few, all_terms["n"]).otherwise(n), F.when(few, all_terms["terms"]).otherwise(kept)).alias("edited_print"),
    )
    return printed.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        spelled(F.col("print")).alias("fingerprint"),
        spelled(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        "near_next",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    ).drop("copy")
