"""Benchmark passages in documents, by winnowing. DataFrame functions only.

A window of ``m`` words has a fingerprint: the least of the hashes of its
``k``-grams, k = (m + 1) // 2. Winnowing a document keeps these least hashes over
all its windows, about 2 in (m - k + 2) of its k-grams, and a window that occurs in
both has its fingerprint in both, at the same offset. So an equi-join on
fingerprints finds every shared window. Each hit carries the words around it and is
extended to, and compared with, the whole window before it counts.

Hash and position share one long: the upper 36 bits are the hash, the lower 28 the
position, so the least value is also the leftmost among equal hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.shared import settle

#: Words of a window.
WINDOW = 10
#: Between words, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The windows' table is broadcast up to this many bytes, else joined by shuffle.
BROADCAST_BYTES = 32 << 20
POSITION_BITS = 28


def words(text: Column) -> Column:
    """Words of a text; null has none. Only A-Z are lower-cased."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, GAP), "")


def _gram(m: int) -> int:
    return (m + 1) // 2


def _pairwise(df: DataFrame, left: str, right: str, shift: int, name: str, f) -> DataFrame:
    """name[i] = f(left[i], right[i + shift]) wherever both exist."""
    n = F.greatest(F.lit(0), F.least(F.size(left), F.size(right) - shift))
    return df.withColumn(name, F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(shift + 1), n), f))


def _power(df: DataFrame, base: str, width: int, f, tag: str) -> DataFrame:
    """Column ``tag``: f folded over every ``width`` neighbours of ``base``, in O(log width) steps."""
    span, have, done = 1, base, None
    todo = width
    while True:
        if todo & 1:
            if done is None:
                done, covered = have, span
            else:
                df = _pairwise(df, done, have, covered, f"{tag}_d{span}", f)
                done, covered = f"{tag}_d{span}", covered + span
        todo >>= 1
        if not todo:
            return df.withColumn(tag, F.col(done))
        df = _pairwise(df, have, have, span, f"{tag}_p{2 * span}", f)
        have, span = f"{tag}_p{2 * span}", 2 * span


def fingerprints(df: DataFrame, m: int) -> DataFrame:
    """Adds ``picked``: the packed fingerprints of all windows of ``m`` of ``words``, each once."""
    keep = list(df.columns)
    mask = (1 << POSITION_BITS) - 1
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    df = _power(df, "h", _gram(m), lambda x, y: F.xxhash64(x, y), "grams")
    df = df.withColumn("packed", F.transform("grams", lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
    df = _power(df, "packed", m - _gram(m) + 1, lambda x, y: F.least(x, y), "least")
    return df.select(*keep, F.array_distinct("least").alias("picked"))


def _marks(p: Column) -> tuple[Column, Column]:
    return F.shiftright(p, POSITION_BITS), p.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")


def _with_words_around(m: int):
    """A fingerprint with all words that a window of ``m`` words holding it can have."""
    reach = m - _gram(m)

    def found(p: Column) -> Column:
        fp, at = _marks(p)
        first = F.greatest(F.lit(0), at - reach)
        return F.struct(F.lit(m).alias("m"), fp.alias("fp"), at.alias("pos"), first.alias("first"), F.slice("words", first + 1, F.lit(m + reach)).alias("near"))

    return found


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``benchmark(item_id, text)`` -> one row per distinct window: m, window, fp, at, items."""
    b = benchmark.select(F.col("item_id").alias("item_id"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    b = b.select("item_id", "ws", F.least(F.size("ws"), F.lit(WINDOW)).alias("m"))
    w = b.select("item_id", "m", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("m") + 1), lambda i: F.slice("ws", i, F.col("m")))).alias("words"))
    w = settle(w.groupBy("m", "words").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "windows")
    sizes = sorted(r.m for r in w.select("m").distinct().collect())  # ten values at most
    parts = []
    for m in sizes:
        fp, at = _marks(F.col("picked")[0])
        parts.append(fingerprints(w.where(F.col("m") == m), m).select("m", F.col("words").alias("window"), fp.alias("fp"), at.alias("at"), "items"))
    if not parts:
        return w.select("m", F.col("words").alias("window"), F.lit(0).cast("long").alias("fp"), F.lit(0).alias("at"), "items")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, keyed: bool = False) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``WINDOW`` consecutive words of an item; an item of fewer words is
    one window. Document words inside any occurrence of a window are hit. One row
    per row of ``docs``, repeated rows and null ids included; a null or empty text
    has no words and no hits. Items without words have no window; an item without
    item_id hits but is not listed. An empty benchmark contaminates nothing, and empty
    docs give no rows. Texts of up to 2^28 words are read whole. Other columns are
    ignored, whatever their names. ``keyed`` adds text_key, the xxhash64 of the text.
    """
    wins = settle(benchmark_windows(benchmark).withColumn("set_id", F.md5(F.to_json("items"))), "fingerprints")
    sets = wins.select("set_id", "items").dropDuplicates(["set_id"])
    total = wins.agg(F.sum(F.length(F.to_json("window")) + 64)).first()[0] or 0
    sizes = sorted(r.m for r in wins.select("m").distinct().collect())  # ten values at most
    side = wins.select("m", "window", "fp", "at", "set_id")
    side = F.broadcast(side) if total <= BROADCAST_BYTES else side

    d = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    picks = []
    for m in sizes:
        d = fingerprints(d, m).withColumnRenamed("picked", f"picked_{m}")
        picks.append(F.transform(f"picked_{m}", _with_words_around(m)))
    # Each document has one row without a window, of a key of its own, so that it is kept without hits.
    none = F.array(F.struct(F.lit(0).alias("m"), F.xxhash64("doc_id", "text_key").alias("fp"), F.lit(0).alias("pos"), F.lit(0).alias("first"), F.array().cast("array<string>").alias("near")))
    rows = d.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(none, *picks)).alias("p")).select("doc_id", "text_key", "n_words", F.col("p.m").alias("pm"), F.col("p.fp").alias("pfp"), "p.pos", "p.first", "p.near")
    start = F.col("pos") - F.col("at")
    same = (F.col("pm") == F.col("m")) & (F.col("pfp") == F.col("fp")) & (start >= 0) & (F.slice("near", F.greatest(F.lit(1), start - F.col("first") + 1), F.col("m")) == F.col("window"))
    hits = rows.join(side, same, "left").where((F.col("pm") == 0) | F.col("set_id").isNotNull())
    by_doc = hits.groupBy("doc_id", "text_key").agg(
        F.count_if(F.col("pm") == 0).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("set_id").isNotNull(), F.struct(start.alias("s"), (start + F.col("m")).alias("e")))).alias("spans"),
        F.collect_set("set_id").alias("set_ids"),
    )
    covered = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("n")),
        lambda a: a["n"],
    )
    by_doc = by_doc.select("doc_id", "text_key", "copies", "n_words", covered.alias("n_hit"), "set_ids")
    listed = by_doc.select("doc_id", "text_key", "copies", "n_words", "n_hit", F.explode_outer("set_ids").alias("set_id")).join(sets, "set_id", "left")
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list("items"))), lambda x: x.cast("string")))
    out = listed.groupBy("doc_id", "text_key", "copies", "n_words", "n_hit").agg(ids.alias("ids"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        *(["text_key"] if keyed else []),
    ).drop("copy")
