"""Document fingerprints by spot signatures.

A text is lower-cased and cut into words (runs of letters and digits). Every common word is an anchor;
its signature is the anchor with the next ``CHAIN`` content words (words that are not common), at most
``GAP`` common words apart from each other. The fingerprint is the set of the signatures' hashes. Common words
stand in running text and hardly in menus or lists, so the set samples what a document says. A text without
any anchored chain takes all chains of ``CHAIN + 1`` words in a row, one of fewer words is a chain by itself, and
one without words is its own hash: no fingerprint is empty, and equal texts have equal fingerprints.

The likeness of two fingerprints is the Jaccard similarity of the sets. ``similar_pairs`` finds all pairs of at least
a threshold: sets are partitioned by length (similar sets lie in the same or the next partition), and within it meet
through an inverted index of the rarest signatures of each; sizes prune before sets are intersected.

``against_next`` compares each text with its edited form and with its successor by id without any global
sort in one task: ids are cut into ranges at quantiles, the first row of each range is also a guest at the end of the
range before (the very first one at the end of the last), and successors are looked up inside ranges.
Texts cross the network once. Everything is built of built-in functions.

Defined cases: a null text is the empty text, its edited text is empty, and its fingerprint the hash of nothing; null
ids order before all others; rows of equal id are ordered by text, and each is the next one's predecessor; the only row is
its own successor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.llm.common import cut, let, written

#: anchors: common words of English, German, French and Spanish
COMMON = """the of and to in a is that it for was on are as with at be this from by an
    der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch
    de la le et les un du une que est pour qui dans par au sur
    el en y los se las con no su al lo del""".split()
CHAIN, GAP = 2, 8
_LEAST = -(1 << 63)


def words(text: Column) -> Column:
    """The words with one blank around each, or one blank for none."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def signatures(text: Column) -> Column:
    """Sorted distinct hashes of the spot signatures of a text."""
    common = "(?:" + "|".join(sorted(set(COMMON), key=lambda w: (-len(w), w))) + ")"
    skip = f"(?:{common} ){{0,{GAP}}}+(?!{common} )"
    chain = " ".join([rf"{skip}[^ ]++"] * CHAIN)
    spots = rf" (?=({common} {chain}) )"
    plain = rf" (?=({' '.join([r'[^ ]++'] * (CHAIN + 1))}) )"

    def hashed(xs: Column) -> Column:
        return F.sort_array(F.array_distinct(xs))

    def anchored(xs: Column) -> Column:
        return hashed(F.transform(xs, lambda s: F.hash(F.regexp_replace(s, f" {common}(?= )", ""))))

    def unanchored(w: Column) -> Column:
        return let(F.regexp_extract_all(w, F.lit(plain), F.lit(1)), lambda xs: F.when(
            F.size(xs) > 0, hashed(F.transform(xs, lambda s: F.hash(F.lit("p"), s)))).otherwise(
            F.array(F.when(F.trim(w) != "", F.hash(F.lit("w"), w)).otherwise(F.hash(F.lit("t"), text)))))

    # runs of blanks cannot occur inside, so one pass over the words finds all anchors
    return let(F.regexp_replace(words(text), "  +", " "), lambda w: let(
        F.regexp_extract_all(w, F.lit(spots), F.lit(1)),
        lambda xs: F.when(F.size(xs) > 0, anchored(xs)).otherwise(unanchored(w))))


def as_text(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), ".")


def jaccard(a: Column, b: Column) -> Column:
    return let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_chars, sigs, fingerprint`` of every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return base.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), signatures(F.col("text")).alias("sigs")) \
        .withColumn("fingerprint", as_text(F.col("sigs")))


# -- neighbours by id -----------------------------------------------------------------------------

def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds that are at most ``key``, in two steps of about sqrt(len) comparisons."""
    if not bounds:
        return F.lit(0)
    m = max(int(math.sqrt(len(bounds))), 1)
    groups = [bounds[i:i + m] for i in range(0, len(bounds), m)]
    heads = F.lit([g[0] for g in groups])
    nested = F.array(*[F.lit(g) for g in groups])
    return let(F.size(F.filter(heads, lambda x: x <= key)), lambda c: F.when(c == 0, F.lit(0)).otherwise(
        (c - 1) * m + F.size(F.filter(F.get(nested, c - 1), lambda x: x <= key))))


def id_ranges(docs: DataFrame, id_col: str = "doc_id", ranges: int | None = None) -> tuple[int | None, list[int]]:
    """The least id, and ids that start the other ranges (present in the table): a few numbers per range."""
    n = ranges or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST))
    r = docs.agg(F.min(key).alias("lo"), F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 50 * n).alias("q")).first()
    return r.lo, sorted({x for x in (r.q or []) if x > r.lo})


def against_next(docs: DataFrame, text: str = "text", id_col: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edited text, and likeness to that and to the next text's."""
    least, bounds = id_ranges(docs, id_col, ranges)
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), key.alias("k"))
    spot = base.withColumn("r", _range_of(F.col("k"), bounds))
    own = F.struct(F.col("r").alias("r"), F.lit(0).alias("guest"))
    before = F.struct((F.col("r") - 1).alias("r"), F.lit(1).alias("guest"))
    last = F.struct(F.lit(len(bounds)).alias("r"), F.lit(1).alias("guest"))
    first_of_all = F.lit(False) if least is None else F.col("k") == least
    starts = F.col("k").isin(bounds) if bounds else F.lit(False)
    seats = F.when(first_of_all, F.array(own, last)).when(starts, F.array(own, before)).otherwise(F.array(own))
    seated = spot.select("doc_id", "text", "k", F.explode(seats).alias("seat")) \
        .select("doc_id", "text", "k", "seat.r", "seat.guest")
    order = ["r", "guest", "k", "text"]
    dealt = seated.repartition("r").sortWithinPartitions(*order).withColumn("sigs", signatures(F.col("text")))
    w = Window.partitionBy("r").orderBy("guest", "k", "text")
    met = dealt.withColumn("nxt", F.lead(F.struct("text", "sigs")).over(w)).where("guest = 0")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = met.select("doc_id", n.cast("bigint").alias("n_chars"), "sigs", F.col("nxt.sigs").alias("next_sigs"),
                        F.concat(F.left("text", n - quarter), F.left("nxt.text", quarter)).alias("edited"))
    signed = edited.withColumn("edited_sigs", signatures(F.col("edited")))
    return signed.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


# -- all similar pairs ------------------------------------------------------------------------------

def similar_pairs(docs: DataFrame, threshold: float = 0.8, text: str = "text",
                  id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(``a, b, likeness`` of all pairs of different fingerprints of at least ``threshold``, ``doc_id, f`` membership).

    ``a`` and ``b`` are ``f`` values: the hash of a fingerprint, one for all texts that have it."""
    prints = written(fingerprints(docs, text, id_col).select("doc_id", F.sha2("fingerprint", 256).alias("f"), "sigs"), "spots")
    sets = cut(prints.dropDuplicates(["f"]).select("f", "sigs", F.size("sigs").alias("len")))
    spread = sets.select("f", "len", F.explode("sigs").alias("s"))
    often = spread.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    # the rarest signatures of a set: any similar set shares at least one of them
    prefix = (F.col("len") - F.ceil(F.col("len") * threshold - 1e-9) + 1).cast("int")
    index = spread.join(often, "s").groupBy("f", "len").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("xs")) \
        .select("f", "len", F.explode(F.slice("xs", F.lit(1), prefix)).alias("x")).where("x.n > 1") \
        .select("f", "len", F.col("x.s").alias("s"), F.floor(F.log("len") / -math.log(threshold) + 1e-9).alias("part"))
    index = cut(index)
    a = index.select("s", "part", F.col("f").alias("a"), F.col("len").alias("la"))
    b = index.select("s", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("f").alias("b"), F.col("len").alias("lb"))
    met = a.join(b, ["s", "part"]).where(((F.col("lb") < F.col("la")) | ((F.col("lb") == F.col("la")) & (F.col("a") < F.col("b"))))
                                         & (F.col("lb") >= threshold * F.col("la") - 1e-9)).select("a", "b").distinct()
    left = sets.select(F.col("f").alias("a"), F.col("sigs").alias("sa"))
    right = sets.select(F.col("f").alias("b"), F.col("sigs").alias("sb"))
    pairs = met.join(left, "a").join(right, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("likeness")) \
        .where(F.col("likeness") >= threshold)
    return pairs, prints.select("doc_id", "f")
