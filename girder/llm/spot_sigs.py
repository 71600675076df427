"""Operator 3: SpotSigs document fingerprints, with DataFrame functions only.

A spot is a common word (the anchor) with the next two content words after it, however far they lie. A document's
fingerprint is the set of its spots' hashes, the first 32 bits of an MD5 (kept as integers, less 2**31). Fingerprints are compared by Jaccard likeness: `near_duplicates` partitions them
by set length (sets whose lengths differ by more than the threshold allows cannot be alike and never meet), looks for
candidates among the rarest spots of each set, prunes by the length bound and verifies the rest exactly.

Defined results: a null text counts as empty; a text without spots has one signature, the hash of its words, so equal texts
always have equal fingerprints; ids are ordered descending, equal ids by text, null ids last and by a hash of the text; the next
document of the last is the first, of a single one itself; repeated rows are documents of their own; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.llm.common import spread_join, stash, text_or_empty

CHAIN = 2  # content words of a spot
BLOCK = 256  # ids of one block of the order
SIMILAR = 0.8

# Common words of the four languages
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you"
    " au aux avec ce ces dans de des du elle en est et il la le les leur mais ne ou par pas pour que qui sa se son sur un une"
    " als am auf aus bei bin das dem den der die ein eine einen einer er es für hat ich im ist mit nach nicht sich sie sind und von war wie zu zum"
    " al con del el ella eran esta la las lo los más me mi muy no para pero por si sin su sus una y"
).split()


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def hashed(spot: Column) -> Column:
    return (F.conv(F.substring(F.md5(spot.cast("binary")), 1, 8), 16, 10).cast("long") - (1 << 31)).cast("int")


def signatures(text: Column) -> Column:
    """The sorted set of 32-bit spot hashes of a text."""
    common = sorted(set(ANCHORS))
    w = words(text)

    def parts(arr: Column) -> Column:
        anchors = F.filter(F.transform(arr, lambda x, i: F.struct(x.alias("word"), i.alias("at"))), lambda a: a["word"].isin(common))
        return F.struct(F.filter(arr, lambda x: ~x.isin(common)).alias("content"), anchors.alias("anchors"))

    def spot(content: Column, a: Column, k: Column) -> Column:
        chain = F.slice(content, a["at"] - k + 1, CHAIN)  # before the k-th anchor lie k anchors, and content otherwise
        return F.when(F.size(chain) == CHAIN, hashed(F.concat_ws(" ", a["word"], chain)))

    # words and parts are bound to a lambda's variable, so that they are computed once a row
    split = F.transform(F.array(w), parts)
    found = F.transform(split, lambda s: F.array_compact(F.transform(s["anchors"], lambda a, k: spot(s["content"], a, k))))
    return F.transform(found, lambda s: F.when(F.size(s) > 0, F.array_sort(F.array_distinct(s))).otherwise(F.array(hashed(F.array_join(w, " ")))))[0]


def written(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x.cast("long") + (1 << 31)), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both).cast("double")


def in_order(documents: DataFrame) -> DataFrame:
    """doc_id, text, sig and next_text, next_sig of the document that follows in descending order of ids.

    Rows are ordered inside blocks of ids. The last row of a block is followed by the top row of the next block that has
    rows; which one that is comes from a two-level walk over block numbers only.
    """
    by_hash = F.shiftrightunsigned(F.xxhash64(text_or_empty()), 48) - (1 << 62)  # the last blocks of all
    documents = documents.select("doc_id", text_or_empty().alias("text")).withColumn("__b", F.coalesce(F.floor(F.col("doc_id") / BLOCK), by_hash))
    rows = documents
    tops = stash(documents.select("doc_id", "__b").groupBy("__b").agg(F.max("doc_id").alias("__top")))
    part = tops.select("__b", F.floor(F.col("__b") / 4096).alias("__p"))
    parts = part.groupBy("__p").agg(F.max("__b").alias("__first"))
    down = Window.orderBy(F.desc("__p"))
    whole = Window.orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = parts.select(F.col("__p").alias("__q"), F.coalesce(F.lead("__first").over(down), F.first("__first").over(whole)).alias("__after"))
    inside = F.lead("__b").over(Window.partitionBy("__p").orderBy(F.desc("__b")))
    follow = part.withColumn("__in", inside).join(after, F.col("__p") == F.col("__q")).select("__b", F.coalesce("__in", "__after").alias("__next"))
    heads = documents.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"), F.col("__b").alias("__h"))
    same = (F.col("__b") == F.col("__h")) & F.col("__top").eqNullSafe(F.col("__id"))
    top_texts = tops.join(heads, same).groupBy(F.col("__b").alias("__t")).agg(F.min("__text").alias("__text"))
    bounds = stash(follow.join(top_texts, F.col("__next") == F.col("__t")).select(F.col("__b").alias("__k"), F.col("__text").alias("__head")))
    bounds = bounds.withColumn("__head_sig", signatures(F.col("__head")))
    order = Window.partitionBy("__b").orderBy(F.desc_nulls_last("doc_id"), "text")
    led = rows.withColumn("sig", signatures(F.col("text"))).withColumns({"__lead": F.lead("text").over(order), "__lead_sig": F.lead("sig").over(order)})
    out = led.join(bounds, F.col("__b") == F.col("__k"), "left")
    last = F.col("__lead").isNull()
    return out.select("doc_id", "text", "sig", F.when(last, F.col("__head")).otherwise(F.col("__lead")).alias("next_text"), F.when(last, F.col("__head_sig")).otherwise(F.col("__lead_sig")).alias("next_sig"))


def digests(documents: DataFrame) -> DataFrame:
    rows = in_order(documents).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("__edited", edited).withColumn("__edited_sig", signatures(F.col("__edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sig")).alias("fingerprint"),
        written(F.col("__edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("__edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def near_duplicates(documents: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id with the class of its fingerprint and its spots, and the pairs of classes at or above the likeness.

    Equal sets are one class, so copies never form pairs. Two sets of likeness t share a spot among the first
    n - ceil(t n) + 1 of each in any common order; the order here is by the spots' frequency, rarest first, and by length
    partition, so only sets of compatible length meet.
    """
    members = stash(documents.select("doc_id", signatures(text_or_empty()).alias("sig")).withColumn("class_id", F.xxhash64("sig")))
    sets = stash(members.groupBy("class_id").agg(F.first("sig").alias("sig")).withColumn("n", F.size("sig")))
    spots = sets.select("class_id", "n", F.explode("sig").alias("spot"))
    frequency = spots.groupBy("spot").agg(F.count("*").alias("df"))
    ranked = spots.join(frequency, "spot").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "spot"))).alias("order"))
    keep = F.col("n") - F.ceil(F.col("n") * similar - 1e-9).cast("int") + 1
    step = F.lit(1.0 / similar).cast("double")
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(step)).cast("int")
    index = stash(ranked.withColumn("part", part).select("class_id", "n", "part", F.explode(F.slice("order", F.lit(1), keep)).alias("o")).select("class_id", "n", "part", F.col("o.spot").alias("spot")))
    a = index.toDF("a", "na", "pa", "spot")
    b = index.withColumn("part", F.explode(F.array("part", F.col("part") + 1))).toDF("b", "nb", "pb", "spot_b")
    fits = (F.col("a") != F.col("b")) & (F.col("nb") <= F.col("na")) & (F.col("nb") >= F.col("na") * similar - 1e-9) & ((F.col("nb") < F.col("na")) | (F.col("b") < F.col("a")))
    pairs = a.join(b, (F.col("spot") == F.col("spot_b")) & (F.col("pa") == F.col("pb")) & fits).select("a", "b").distinct()
    left, right = sets.select(F.col("class_id").alias("a"), F.col("sig").alias("sa")), sets.select(F.col("class_id").alias("b"), F.col("sig").alias("sb"))
    links = pairs.join(left, "a").join(right, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"))).filter(F.col("likeness") >= similar - 1e-12)
    return members.select("doc_id", "class_id", "sig"), links.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "likeness")


def linked(documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (the least doc_id with the same fingerprint), n_spots and n_links: the classes at or above the likeness."""
    members, links = near_duplicates(documents, similar)
    both = links.select(F.col("class_a").alias("class_id")).unionByName(links.select(F.col("class_b").alias("class_id")))
    counts = both.groupBy("class_id").agg(F.count("*").alias("n_links"))
    classes = members.groupBy("class_id").agg(F.min("doc_id").alias("least")).join(counts, "class_id", "left")
    named = stash(classes.select("class_id", "least", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return spread_join(members.select("doc_id", "class_id", F.size("sig").cast("long").alias("n_spots")), named, "class_id").select("doc_id", F.col("least").alias("class_id"), "n_spots", "n_links")


# DuckDB SQL for `digests` over the table documents; the fixed values are those above.
_SIG = r"""
  SELECT {keys}, list_sort(list_distinct(CASE WHEN len(spots) > 0 THEN spots ELSE [substr(md5(array_to_string(w, ' ')), 1, 8)] END)) AS sig
  FROM (SELECT {keys}, w, list_transform(list_filter(range(1, len(pos) + 1), lambda k: pos[k] - k + 2 <= len(c)), lambda k: substr(md5(w[pos[k]] || ' ' || c[pos[k] - k + 1] || ' ' || c[pos[k] - k + 2]), 1, 8)) AS spots
    FROM (SELECT {keys}, w, list_filter(w, lambda x: NOT list_contains({common}, x)) AS c, list_filter(range(1, len(w) + 1), lambda i: list_contains({common}, w[i])) AS pos
      FROM (SELECT {keys}, string_split(trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM {table})))
"""


def _sql() -> str:
    common = "[" + ", ".join(f"'{x}'" for x in sorted(set(ANCHORS))) + "]"
    sig = lambda text, table: _SIG.format(keys="doc_id", common=common, text=text, table=table)
    like = "len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))::DOUBLE"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS nxt_id FROM d WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT doc_id, nxt_id, n, left(text, (n - n // 2)::BIGINT) || left(nxt, (n // 2)::BIGINT) AS edited FROM o),
s AS ({sig("text", "d")}), t AS ({sig("edited", "e")})
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, array_to_string(s.sig, '') AS fingerprint, array_to_string(t.sig, '') AS edited_fingerprint,
  {like.format("s.sig", "t.sig")} AS near_edited, {like.format("s.sig", "x.sig")} AS near_next
FROM e JOIN s USING (doc_id) JOIN t USING (doc_id) JOIN s AS x ON x.doc_id = e.nxt_id"""


SQL = _sql()
