"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Built from DataFrame functions only, in one pass over the corpus.  Words are split
once per document; each word is probed against a hash set of anchor words (the longest
word of every benchmark window).  A probe that answers proposes a position, and the
whole window is then compared word by word before it counts.  Documents without
a hit leave the scan as a single row.

The window table is broadcast while it holds at most ``broadcast_bytes``, words and item
ids counted; beyond that the same join runs as a shuffle join on the anchor, whose hot
words adaptive execution splits, and the words of a document are sent only for the
proposed positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTINEL = " "


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z only; null and blank texts have none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, WORD_BREAK, -1), "")


def benchmark_windows(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: gram (array of words), anchor word and its place, item ids."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    grams = items.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, width))).alias("gram"))
    longest = F.array_max(F.transform("gram", lambda x: F.length(x)))
    place = F.filter(F.sequence(F.lit(0), F.size("gram") - 1), lambda i: F.length(F.get("gram", i)) == F.col("longest"))
    return (
        grams.groupBy("gram")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("longest", longest)
        .withColumn("off", F.get(place, F.lit(0)))
        .select("gram", "items", "off", F.get("gram", F.col("off")).alias("anchor"))
    )


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = 128_000_000) -> DataFrame:
    """One row per document key (doc_id, text hash): n_words, spans, items.

    ``spans`` holds distinct (start, length) of verified windows, in word positions.
    Rows that repeat both id and text share a key; ``n_rows`` counts them.
    """
    grams = benchmark_windows(benchmark, width, item_col, item_text)
    is_mark = F.col("anchor") == SENTINEL
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")).alias("crc"), words_of(F.col(text_col)).alias("w"))
    own = ["doc_id", "key", "crc"]
    start = F.col("pos") - F.col("off")
    # The whole window is compared before it counts; its words leave the scan with no row.
    same = (start >= 0) & (F.slice("w", F.greatest(start + 1, F.lit(1)), F.size("gram")) == F.col("gram"))
    span = F.struct(start.alias("start"), F.size("gram").alias("n"))
    merged = [F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")]
    if table_bytes(grams) <= broadcast_bytes:
        # One more word for each row stands for the row itself, so that the scan needs no second pass.
        mark = docs.sparkSession.range(1).select(*[F.lit(SENTINEL if f.name == "anchor" else None).cast(f.dataType).alias(f.name) for f in grams.schema])
        probes = split.select(*own, "w", F.posexplode(F.concat("w", F.array(F.lit(SENTINEL)))).alias("pos", "anchor"))
        found = probes.join(F.broadcast(grams.unionByName(mark)), "anchor").where(is_mark | same)
        rows = found.select(*own, F.when(is_mark, F.size("w")).alias("words"), F.when(is_mark, 1).otherwise(0).alias("mark"), F.when(~is_mark, span).alias("span"), F.explode_outer("items").alias("item"))
        return rows.groupBy(*own).agg(F.max("words").alias("n_words"), F.sum("mark").alias("n_rows"), *merged)
    counted = split.groupBy(*own).agg(F.max(F.size("w")).alias("n_words"), F.count("*").alias("n_rows"))
    proposed = split.select(*own, F.posexplode("w").alias("pos", "anchor")).join(grams.hint("merge"), "anchor")
    right = [F.col(c).alias(f"own_{c}") for c in own]
    words = split.select(*right, "w").dropDuplicates([f"own_{c}" for c in own])
    match = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in own]
    hit = proposed.join(words, match[0] & match[1] & match[2]).where(same).select(*own, span.alias("span"), F.explode("items").alias("item"))
    per = hit.groupBy(*own).agg(*merged).select(*[F.col(c).alias(f"own_{c}") for c in own], "spans", "items")
    out = counted.join(per, match[0] & match[1] & match[2], "left")
    spans, items = per.schema["spans"].dataType, per.schema["items"].dataType
    return out.select(*own, "n_words", "n_rows", F.coalesce("spans", F.array().cast(spans)).alias("spans"), F.coalesce("items", F.array().cast(items)).alias("items"))


def table_bytes(grams: DataFrame) -> int:
    """About what the window table takes in memory: its words, its item ids and their slots."""
    size = F.octet_length(F.array_join("gram", "")) + F.octet_length(F.array_join("items", "")) + 32 * (F.size("gram") + F.size("items")) + 100
    return grams.agg(F.sum(size)).first()[0] or 0


def covered(spans: Column) -> Column:
    """Words covered by the union of sorted (start, n) spans."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["start"] + s["n"]).alias("upto"),
            (a["sum"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["upto"], s["start"]))).alias("sum"),
        ),
        lambda a: a["sum"],
    )


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, **cols: str) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    per = hits(docs, benchmark, width, **cols)
    return per.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("_"),
    ).drop("_")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", **cols: str) -> DataFrame:
    """The documents of ``docs`` without any verified benchmark window, all columns kept."""
    bad = hits(docs, benchmark, width, id_col=id_col, text_col=text_col, **cols).where(F.size("spans") > 0)
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    return marked.join(bad, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("key")), "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", **cols: str) -> DataFrame:
    """doc_id and the normalised words left after every verified window is cut out."""
    per = hits(docs, benchmark, width, id_col=id_col, text_col=text_col, **cols).select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), "spans")
    w = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), words_of(F.col(text_col)).alias("w"))
    both = w.join(per, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")))
    kept = F.filter("w", lambda x, i: ~F.exists("spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["n"])))
    return both.select("doc_id", F.array_join(kept, " ").alias("text"))
