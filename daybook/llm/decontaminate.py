"""Benchmark decontamination: short items found inside long documents by size-partitioned MinHash.

DataFrame functions only. An item's shingles are its runs of width words; an item of fewer words has one
shingle, all of them. Items are partitioned into size classes by the number of their shingles. An item's
signature is its k least shingle hashes, k being one more than the shingles it may miss at the threshold,
so a document that contains enough of the item contains at least one of its k least: the search loses
nothing. A document takes part in the classes that it is long enough for, and offers a class only the
hashes up to the greatest one that a signature there uses. Candidates are then verified by the exact
containment of their shingles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, text_of, with_row_key, without_rows

WIDTH, THRESHOLD = 5, 0.8
#: Signature rows (of 8 bytes and an id) that are broadcast at most; more are joined by a salted shuffle.
BROADCAST_ROWS = 500_000
#: Tasks that share a shingle which very many documents have, where signatures are not broadcast.
SALTS = 16


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(n: Column, width: int, hashed: bool) -> Column:
    none = F.array().cast("array<bigint>" if hashed else "array<string>")
    if hashed:
        made = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get("_h", i + k) for k in range(width))))
    else:
        made = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.array_join(F.slice("_w", i, width), " "))
    return F.when(n >= width, made).otherwise(none)


def with_shingles(df: DataFrame, name: str, hashed: bool, widths: list[int]) -> DataFrame:
    """Adds column name: the runs of each of the widths in words of text, as strings or as xxhash64 of
    their word hashes (no strings are built for the search). Each step is a projection of its own: within
    one expression Spark would evaluate the words anew for every run."""
    df = df.withColumn("_w", words(F.col("text")))
    if hashed:
        df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    n = F.size("_h" if hashed else "_w")
    made = [_runs(n, w, hashed) for w in widths]
    return df.withColumn(name, made[0] if len(made) == 1 else F.concat(*made)).drop("_w", "_h")


def item_shingles(items: DataFrame, hashed: bool, width: int) -> DataFrame:
    """(item_id, width, s): the distinct shingles of each item with words, at the item's own width."""
    items = items.withColumn("_n", F.size(words(F.col("text")))).where("_n > 0").withColumn("width", F.least(F.col("_n"), F.lit(width)))
    parts = [with_shingles(items.where(F.col("width") == w), "s", hashed, [w]).select("item_id", "width", F.array_distinct("s").alias("s")) for w in range(1, width + 1)]
    return reduce(DataFrame.unionByName, parts)


def signatures(items: DataFrame, threshold: float, width: int) -> DataFrame:
    """(item_id, width, n, size_class, hash): the k least hashes of each item of n shingles.

    Size classes are ranges of n that double: 1, 2 to 3, 4 to 7 and so on."""
    hashed = item_shingles(items, True, width).withColumn("h", F.array_sort("s"))
    n = F.size("h")
    k = n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    size_class = F.floor(F.log2(n.cast("double")) + 1e-9).cast("int")
    return hashed.select("item_id", "width", n.alias("n"), size_class.alias("size_class"), F.explode(F.slice("h", F.lit(1), F.least(k, n))).alias("hash"))


def offered_hashes(rows: DataFrame, classes: list, threshold: float, width: int) -> DataFrame:
    """(doc_id, probe): for every size class that a document is long enough for, its shingle hashes up to
    the class's greatest. classes: a row for each width and size class (some tens at most)."""
    parts = []
    for w in sorted({c["width"] for c in classes}):
        own = sorted((c for c in classes if c["width"] == w), key=lambda c: c["size_class"])
        shingled = with_shingles(rows, "_s", True, [w]).withColumn("_s", F.array_distinct("_s"))
        sized = shingled.withColumn("_n", F.size("_s"))

        def offer(c) -> Column:
            held = F.filter("_s", lambda h: h <= c["top"])
            return F.when(F.col("_n") >= c["least"], F.transform(held, lambda h: F.xxhash64(h, F.lit(c["size_class"])))).otherwise(F.array().cast("array<bigint>"))

        parts.append(sized.select("doc_id", F.explode(F.concat(*map(offer, own)) if len(own) > 1 else offer(own[0])).alias("probe")))
    return reduce(DataFrame.unionByName, parts)


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): documents that contain at least threshold of
    an item's distinct word shingles.

    An item of fewer than width words has one shingle, all its words, and is found in every document
    that has these words in a row. Null text counts as empty; an item without words is in no document.
    Repeated rows give one pair, as do rows that share an id (the greatest n_shared of them); rows with
    a null id are left out. Other columns are ignored; an empty table gives an empty result.
    """
    bench = text_of(items, F.col("item_id")).where("item_id is not null").select("item_id", "text")
    sig = materialise(spark, signatures(bench, threshold, width), "item-signatures")
    least = F.ceil(F.min("n") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    classes = sig.groupBy("width", "size_class").agg(F.max("hash").alias("top"), least.alias("least"), F.count("*").alias("rows")).collect()
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").select("doc_id", "text")
    probes = sig.select(F.xxhash64("hash", "size_class").alias("probe"), "item_id").distinct()
    if not classes:
        pairs = rows.select("doc_id").join(probes.select("item_id")).limit(0)
    else:
        offered = offered_hashes(rows, classes, threshold, width)
        if sum(c["rows"] for c in classes) <= BROADCAST_ROWS:
            pairs = offered.join(F.broadcast(probes), "probe")
        else:
            salted = probes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            pairs = offered.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["probe", "salt"])
    pairs = materialise(spark, pairs.select("doc_id", "item_id").distinct(), "candidates")

    full = item_shingles(bench, False, width).select("item_id", "width", F.col("s").alias("item"))
    widths = sorted({c["width"] for c in classes}) or [width]
    texts = with_shingles(rows.join(pairs.select("doc_id").distinct(), "doc_id"), "doc", False, widths).select("doc_id", "doc")
    met = pairs.join(texts, "doc_id").join(full, "item_id")
    shared = F.size(F.array_intersect("item", "doc"))
    out = met.select("doc_id", "item_id", shared.cast("long").alias("n_shared"), F.size("item").cast("long").alias("n_item"))
    out = out.where(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - F.lit(1e-9))
    out = out.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, null_ids: bool = False) -> DataFrame:
    """Rows of docs that contain no item, with all their columns.

    Rows that share an id, and repeated rows, go or stay by their own text. Rows with a null id are
    searched with null_ids, and all stay without. Null and empty texts contain nothing. Columns may
    have any names; an empty table stays empty, and without items all rows stay.
    """
    keyed, row = with_row_key(spark, docs)
    searched = keyed if null_ids else keyed.where(keyed["doc_id"].isNotNull())
    found = contaminated(spark, searched.select(F.col(row).alias("doc_id"), "text"), items, threshold, width)
    return without_rows(spark, keyed, found.select(F.col("doc_id").alias(row)), row).select(*docs.columns)
