"""SpotSigs fingerprints: chains of content words after common-word anchors.

Anchors are the most common words of four languages.  A spot's signature is the hash of the anchor and the
next ``CHAIN`` content words (anchors between them are skipped, at most ``SKIP``).  A text's fingerprint is
its sorted set of 32-bit signatures, eight hexadecimal digits each.  A text without spots uses
every word as an anchor, one without such chains either is a single signature, a blank text is none.

Likeness is the Jaccard similarity of two sets.  ``near_pairs`` finds the pairs above a threshold:
sets are partitioned by length, so that a set meets its own and the next partition only, candidates
share one of their rarest signatures, and the lengths bound the similarity before sets are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import let
from .store import partitions, stored

#: The anchors, common words of English, German, French and Spanish.
ANCHORS = ("a and in of that the to with das der die mit und von zu de des est et la le les un el en los que se y").split()
CHAIN, SKIP = 2, 20
_L = r"[\p{L}\p{N}]"
_N = r"[^\p{L}\p{N}]"


def _any(words: list[str]) -> str:
    """Words as an alternation that shares prefixes."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[:1], []).append(w[1:])
    end = by_first.pop("", None)
    out = "|".join(c + (_any(rest) if rest != [""] else "") for c, rest in sorted(by_first.items()))
    if not by_first:
        return ""
    return f"(?:{out})" + ("?" if end is not None else "") if len(by_first) > 1 or end is not None else out


_STOP = f"(?:{_any(sorted(ANCHORS))})(?!{_L})"
_STEP = f"{_N}++(?:{_STOP}{_N}++){{0,{SKIP}}}+{_L}++"
SPOT = f"(?<!{_L})({_STOP}(?=((?:{_STEP}){{{CHAIN}}})))"
EVERY = f"(?<!{_L}){_L}++(?=((?:{_N}++{_L}++){{{CHAIN}}}))"


def _short(h: Column) -> Column:
    """The last 32 bits, signed."""
    return F.shiftright(F.shiftleft(h, 32), 32).cast("int")


def signatures(text: Column) -> Column:
    """Sorted distinct 32-bit signatures of a text; null and blank texts have none."""
    def hashed(chains: Column) -> Column:
        words = lambda c: F.regexp_replace(F.regexp_replace(c, f"(?<!{_L}){_STOP}", ""), f"{_N}+", " ")
        return F.transform(chains, lambda c: _short(F.xxhash64(words(c))))

    lower = F.lower(F.coalesce(text, F.lit("")))

    def found(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(SPOT), F.lit(2)), lambda spots: F.when(
            F.size(spots) > 0, hashed(spots)).when(t.rlike(r"^\s*$"), F.array().cast("array<int>")).otherwise(let(
                F.regexp_extract_all(t, F.lit(EVERY), F.lit(1)), lambda every: F.when(F.size(every) > 0, hashed(every)).otherwise(
                    F.array(_short(F.xxhash64(t)))))))

    return F.array_sort(F.array_distinct(let(lower, found)))


def as_text(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures; 1 if both are empty.  Sets of which one is empty, by
    length alone, are not compared."""
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).when(least == 0, 0.0).otherwise(let(
        F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both)))


def near_pairs(sets: DataFrame, threshold: float = 0.75) -> DataFrame:
    """From (id, sigs) the pairs (u, v, likeness) of class representatives at or above the threshold:
    equal sets are one class, of its smallest id (see ``classes``).  Sets without signatures are left out.

    A set of length n meets sets of lengths n to n / threshold, so with partitions whose bounds grow by 1 / threshold its own and
    the next one.  Its floor((1 - threshold) n) + 1 rarest signatures hold one of any such set's."""
    own = classes(sets).where(F.col("id") == F.col("class")).select("id", "sigs")
    own = stored(own.where(F.size("sigs") > 0).withColumn("n", F.size("sigs")).withColumn(
        "part", F.floor(F.log("n") / F.log(F.lit(1.0 / threshold)))), "sets")
    each = own.select("id", "n", "part", F.explode("sigs").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("c", "s"))
    # Signatures of one set alone stand first and meet nothing; they count for the prefix.
    alone = F.col("n") - F.count("*").over(Window.partitionBy("id"))
    prefix = each.join(often, "s").withColumn("r", rank + alone).where(
        F.col("r") <= F.floor((1 - threshold) * F.col("n") + 1e-9) + 1)
    a = prefix.select(F.col("id").alias("u"), F.col("n").alias("nu"), "s", F.col("part").alias("pu"))
    b = prefix.select(F.col("id").alias("v"), F.col("n").alias("nv"), "s", F.explode(F.array("part", F.col("part") - 1)).alias("pu"))
    pairs = a.join(b, ["s", "pu"]).where(
        ((F.col("nu") < F.col("nv")) | ((F.col("nu") == F.col("nv")) & (F.col("u") < F.col("v"))))
        & (F.col("nu") >= threshold * F.col("nv"))).select("u", "v").distinct()
    left = own.select(F.col("id").alias("u"), F.col("sigs").alias("x"))
    right = own.select(F.col("id").alias("v"), F.col("sigs").alias("y"))
    return (pairs.join(left, "u").join(right, "v").withColumn("likeness", likeness(F.col("x"), F.col("y")))
            .where(F.col("likeness") >= threshold).select("u", "v", "likeness"))


def classes(sets: DataFrame) -> DataFrame:
    """``sets`` with class: the smallest id with equal signatures."""
    key = F.struct(F.size("sigs").alias("n"), F.xxhash64("sigs").alias("h")).alias("key")
    first = sets.groupBy(key).agg(F.min("id").alias("class"))
    return sets.withColumn("key", key).join(first, "key").drop("key")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, next_id, next_tie, owner_id, owner_tie, owner_third) for each distinct row by id and text: the
    next row by descending id (null last; then by tie, a hash of the text; after the last: the first), the
    row it is the next of (its owner), and a third of the owner's length.  Range partitions are
    ordered within themselves, and only their first rows among each other."""
    keys = docs.groupBy("doc_id", "tie").agg(F.max("third").alias("third"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    dealt = stored(keys.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()), "order")
    row = F.struct("doc_id", "tie", "third")
    by = Window.partitionBy("part").orderBy(*order)
    inner = dealt.select("part", "doc_id", "tie", "third", F.lead(row).over(by).alias("after"), F.lag(row).over(by).alias("before"))
    # A null id sorts last: the flag makes minima and maxima follow the order.
    rank = F.struct(F.coalesce(F.col("doc_id").isNull().cast("int"), F.lit(0)), -F.coalesce("doc_id", F.lit(0)), F.col("tie"))
    ends = dealt.groupBy("part").agg(F.min_by(row, rank).alias("first"), F.max_by(row, rank).alias("last"))
    over = Window.orderBy("part")
    whole = Window.partitionBy()
    ends = ends.select(
        "part", F.coalesce(F.lead("first").over(over), F.min_by("first", "part").over(whole)).alias("after_part"),
        F.coalesce(F.lag("last").over(over), F.max_by("last", "part").over(whole)).alias("before_part"))
    out = inner.join(F.broadcast(ends), "part")  # a row for each partition
    after, before = F.coalesce("after", "after_part"), F.coalesce("before", "before_part")
    return out.select("doc_id", "tie", after["doc_id"].alias("next_id"), after["tie"].alias("next_tie"),
                      before["doc_id"].alias("owner_id"), before["tie"].alias("owner_tie"), before["third"].alias("owner_third"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per distinct row of ``docs`` by id and text, repeated as often as it occurs: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the
    next document's text.  Null texts count as empty; rows alike in id and text are one document with the same
    next; a null id comes last; an only document follows itself; an empty table gives no rows; other
    columns are not read.

    The texts are shuffled once; what a document needs of the next, a third of its length, is sent to it."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    pointers = stored(with_next(base.select("doc_id", "tie", F.floor(F.length("text") / 3).cast("int").alias("third"))), "next")
    # A null id takes part in equi-joins by a key of two non-null columns.
    key = lambda c: (c.isNull(), F.coalesce(c, F.lit(0)))

    def keyed(df: DataFrame, id_col: str, tie_col: str) -> DataFrame:
        none, value = key(F.col(id_col))
        return df.withColumn("k0", none).withColumn("k1", value).withColumn("k2", F.col(tie_col))

    on = ["k0", "k1", "k2"]
    texts = keyed(base, "doc_id", "tie").select(*on, "text").repartition(partitions(spark), *on)
    own = keyed(pointers, "doc_id", "tie").select(*on, "owner_id", "owner_tie", "owner_third")
    heads = texts.join(own, on).select("owner_id", "owner_tie", F.left("text", F.col("owner_third")).alias("head"))
    heads = keyed(heads, "owner_id", "owner_tie").select(*on, "head").dropDuplicates(on)
    third = F.floor(F.length("text") / 3).cast("int")
    both = texts.join(heads, on).withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.concat(F.left("text", F.length("text") - third), "head"))
    told = stored(both.select(
        *on, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("text")).alias("sigs"),
        signatures(F.col("edited")).alias("edited_sigs")), "sigs")
    given = told.select(*on, "sigs").dropDuplicates(on).join(own.drop("owner_third"), on)
    given = keyed(given, "owner_id", "owner_tie").select(*on, F.col("sigs").alias("next_sigs"))
    return told.join(given, on).select(
        F.when(~F.col("k0"), F.col("k1")).alias("doc_id"), "n_chars", "edited_sha256",
        as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
