"""Document fingerprints from closed syncmers, by DataFrame functions alone.

The letters are words. A window of ``k`` words is chosen if the smallest hash of its inner ``s``-word substrings
lies at one of its two edges. Whether it is chosen depends on the window alone, so texts that share a
passage choose the same anchors in it, wherever it stands. The fingerprint holds the ``size`` smallest 32-bit
hashes of the chosen windows (all, if fewer); the share of equal ones among the smallest of two fingerprints
together estimates the Jaccard likeness of their anchors, and is exact for texts with few anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegrid.llm.common import range_bounds, range_part

_SPACE = r"[\x20\x09-\x0D]+"
_INTS = "array<int>"


def with_anchors(df: DataFrame, text: str, name: str, k: int = 5, s: int = 2) -> DataFrame:
    """df with ``name``, array of (position, hash): the closed syncmers of a text column, by word position.

    A text of 1 to k - 1 words is one anchor as a whole; null texts and texts without words have none."""
    if not 1 <= s < k:
        raise ValueError("1 <= s < k is needed")
    h, g = f"__{name}_h", f"__{name}_g"
    inner = k - s
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _SPACE), lambda w: w != "")
    df = df.withColumn(h, F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size(h)
    rolled = F.col(h)
    for j in range(1, s):
        rolled = F.zip_with(F.slice(rolled, 1, F.greatest(n - j, F.lit(0))), F.slice(h, j + 1, F.greatest(n - j, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(g, rolled)
    at = lambda i, j: F.get(F.col(g), i + j)
    edges = lambda i: F.least(at(i, 0), at(i, inner))
    inside = lambda i: F.least(*[at(i, j) for j in range(1, inner)]) if inner > 2 else at(i, 1)
    chosen = F.filter(F.sequence(F.lit(0), n - k), (lambda i: edges(i) <= inside(i)) if inner > 1 else (lambda i: F.lit(True)))
    parts = [*range(0, k - s, s), k - s]
    anchors = F.transform(chosen, lambda i: F.struct(i.alias("position"), F.xxhash64(*[at(i, j) for j in parts]).alias("hash")))
    whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(F.col(h), n).alias("hash")))
    none = F.array().cast("array<struct<position:int,hash:bigint>>")
    return df.withColumn(name, F.when(n >= k, anchors).when(n > 0, whole).otherwise(none)).drop(h, g)


def sketch(anchors: Column, size: int = 64) -> Column:
    """The ``size`` smallest distinct 32-bit hashes of anchors, ascending."""
    low = F.transform(anchors, lambda a: F.shiftright(a["hash"], 32).cast("int"))
    return F.slice(F.array_sort(F.array_distinct(low)), 1, size)


def likeness(a: Column, b: Column, size: int = 64) -> Column:
    """Estimated Jaccard likeness of two sketches, 0 to 1; two empty ones are alike."""
    both = F.size(F.array_intersect(F.slice(F.array_sort(F.array_union(a, b)), 1, size), F.array_intersect(a, b)))
    of = F.least(F.size(F.array_union(a, b)), F.lit(size))
    return F.when(of == 0, F.lit(1.0)).otherwise(both / F.greatest(of, F.lit(1)))


def as_text(a: Column) -> Column:
    """A sketch as 8 hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8))), ""))


def next_ids(docs: DataFrame, rows_per_part: int = 50_000) -> DataFrame:
    """doc_id, next_id: the distinct ids in descending order, after the last the first. No part holds more than its range."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    parts = min(4096, max(64, ids.count() // rows_per_part))
    dealt = ids.withColumn("part", range_part(F.col("doc_id"), range_bounds(docs, "doc_id", parts)))
    heads = {r["part"]: r["head"] for r in dealt.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}  # a row a part
    after, head = [None] * (parts + 1), max(heads.values(), default=None)
    for part in range(parts + 1):
        after[part] = head if part in heads and not any(p in heads for p in range(part)) else next((heads[p] for p in range(part - 1, -1, -1) if p in heads), head)
    order = Window.partitionBy("part").orderBy(F.desc("doc_id"))
    return dealt.select("doc_id", F.coalesce(F.lead("doc_id").over(order), F.element_at(F.lit(after).cast("array<bigint>"), F.col("part") + 1)).alias("next_id"))


def edited(docs: DataFrame, k: int = 5, s: int = 2, size: int = 64) -> DataFrame:
    """doc_id, n_chars, edited_text, own, edited, following: sketches of a text, its edited text and the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document
    in descending doc_id, after the last the first. Null texts are empty. Rows that share a doc_id are edited one by one;
    the next document is then the row with the smallest text. A row without a doc_id has no next document.
    """
    docs = docs.select("doc_id", "text") if dict(docs.dtypes)["doc_id"] == "bigint" else docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    every = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = every.where(F.col("doc_id").isNotNull())  # both joins below read the one exchange of it, so anchors come after them
    links = next_ids(docs)
    need = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.floor(F.length("text") / 2).alias("need")).groupBy("doc_id").agg(F.coalesce(F.max("need"), F.lit(0)).cast("int").alias("need"))
    wanted = links.join(need, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("of"), "need")
    lent = with_anchors(own.join(wanted, "doc_id"), "text", "anchors", k, s)
    lent = lent.select(F.col("of").alias("doc_id"), F.substring("text", 1, F.col("need")).alias("lent"), sketch(F.col("anchors"), size).alias("following"))
    lent = lent.groupBy("doc_id").agg(F.min(F.struct("lent", "following")).alias("x")).select("doc_id", "x.lent", "x.following")
    alone = every.where(F.col("doc_id").isNull()).withColumns({"lent": F.lit(""), "following": F.array().cast(_INTS)})
    out = own.join(lent, "doc_id", "left").unionByName(alone).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    text = F.concat(F.substring("text", 1, (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("lent", F.lit("")), 1, half))
    out = with_anchors(out.withColumn("edited_text", text), "text", "anchors", k, s).withColumn("own", sketch(F.col("anchors"), size))
    return with_anchors(out, "edited_text", "anchors", k, s).select("doc_id", "n_chars", "edited_text", "own", sketch(F.col("anchors"), size).alias("edited"), F.coalesce("following", F.array().cast(_INTS)).alias("following"))
