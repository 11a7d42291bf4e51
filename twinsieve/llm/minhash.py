"""Near-duplicate documents: similarity sketches, banding, exact verification, components.

1. One pass over the texts gives each row a 128-bit key of its word sequence, the
   size of its shingle set and its band keys.
2. Rows with the same key are one *representative* (least id). Copies therefore
   never meet as pairs, however many there are.
3. Star links: in each band bucket all members are compared with the least member
   on their full shingle sets. Verified links give first labels of connected members.
   Buckets with many members that no link has reached get another leader, the least of
   these, a few times; so a large group that the first leader is no part of is one star too.
4. What is left are members of one bucket with different labels. They meet in
   cells of a bounded number of members (rest x main, rest x rest) with finer
   sketches; a cell keeps a pair only in the first band that it shares and only if
   the fine sketches agree in as many bins as those of a linked pair, less 4.8
   standard deviations. Survivors are verified on full sets too, and the components
   joined.

With 32 bands of 4 bins, a pair at similarity 0.8 shares no band with probability
5e-8; each of the two sketch tests adds less than 1e-6. No pair is linked without the
full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.components import components
from twinsieve.llm.shared import settle
from twinsieve.llm.shingles import Sketcher, WordHashes, overlap, shingle_set, words_of

BINS, BANDS, ROWS = 128, 32, 4
#: Bins of the fine sketch, one byte of each of which is kept, and of its first part, which is tried first.
FINE, COARSE = 1024, 256
#: Most members of one side of a cell.
CELL = 1024
#: Further leaders of a bucket, and the members without a link that it must have for one; what is left meets in cells.
LEADERS, UNREACHED = 3, 64


def _profiles(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher, known = Sketcher(BINS, BANDS, ROWS), WordHashes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                words = words_of(text if isinstance(text, str) else None)
                doc_id = None if doc_id is None or doc_id != doc_id else int(doc_id)
                if not words:
                    out.append((doc_id, None, None, 0, None))
                    continue
                key = xxhash.xxh3_128_intdigest(b" ".join(words))
                s = shingle_set(words, shingle, known)
                signed = np.frombuffer(key.to_bytes(16, "little"), np.int64)
                out.append((doc_id, int(signed[0]), int(signed[1]), len(s), sketcher.band_keys(sketcher.sketch(s)).view(np.int64)))
            frame = pd.DataFrame(out, columns=["doc_id", "k1", "k2", "n", "bands"])
            for c in ("doc_id", "k1", "k2"):
                frame[c] = pd.array(frame[c], dtype="Int64") if frame[c].isna().any() else frame[c].astype("int64")
            yield frame

    return docs.mapInPandas(run, "doc_id long, k1 long, k2 long, n long, bands array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` those whose full sets reach the similarity."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, last = WordHashes(), (None, None)
        for batch in batches:
            keep = []
            for ta, tb in zip(batch["ta"].array, batch["tb"].array, strict=True):
                if last[0] != tb:
                    last = (tb, shingle_set(words_of(tb), shingle, known))
                x, y = shingle_set(words_of(ta), shingle, known), last[1]
                both = overlap(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def _fine(texts: DataFrame, shingle: int) -> DataFrame:
    """``texts(doc_id, text)`` -> (rep, sketch): one byte of each bin of the fine sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher, known = Sketcher(FINE, 1, 1), WordHashes()
        for batch in batches:
            made = [(sketcher.sketch(shingle_set(words_of(t), shingle, known)) & np.uint64(255)).astype(np.uint8).tobytes() for t in batch["text"].array]
            yield pd.DataFrame({"rep": batch["doc_id"], "sketch": made})

    return texts.select("doc_id", "text").mapInPandas(run, "rep long, sketch binary")


def _agreeing(bins: int, percent: int) -> int:
    """Bins that a linked pair's sketches agree in, less 4.8 standard deviations."""
    return math.floor(bins * percent / 100 - 4.8 * math.sqrt(bins * percent / 100 * (1 - percent / 100)))


def _pairs_of(cell: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Pairs of one cell that are worth verifying: (lesser, greater)."""
    least = [(b, _agreeing(b, percent)) for b in (COARSE, FINE)]
    band, own = int(cell["band"].iloc[0]), int(cell["i"].iloc[0])
    is_rest = cell["rest"].to_numpy(bool)
    rest, base = np.flatnonzero(is_rest), np.arange(len(cell)) if own < 0 else np.flatnonzero(~is_rest)
    if not len(rest) or not len(base):
        return []
    ids, comp, n = (cell[c].to_numpy() for c in ("rep", "component", "n"))
    sketch = np.frombuffer(b"".join(cell["sketch"]), np.uint8).reshape(len(cell), FINE)
    bands = np.stack(cell["bands"].to_numpy())[:, :band]
    first = np.ascontiguousarray(sketch[base, :COARSE])
    found = set()
    for r in rest.tolist():
        near = np.flatnonzero((first == sketch[r, :COARSE]).sum(axis=1) >= least[0][1])
        near = base[near]
        near = near[(comp[near] != comp[r]) & (100 * np.minimum(n[near], n[r]) >= percent * np.maximum(n[near], n[r]))]
        if len(near) and band:
            near = near[~(bands[near] == bands[r]).any(axis=1)]
        if len(near):
            near = near[(sketch[near] == sketch[r]).sum(axis=1) >= least[1][1]]
        found.update((min(ids[r], x), max(ids[r], x)) for x in ids[near].tolist() if x != ids[r])
    return sorted(found)


def _cells(members: DataFrame, percent: int) -> DataFrame:
    """Members of buckets that hold several components -> pairs worth verifying."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for batch in chain(batches, [None]):
            last = batch is None
            rows = left if last else batch if left is None else pd.concat([left, batch], ignore_index=True)
            if rows is None or rows.empty:
                continue
            key = rows[["bucket", "i", "j"]].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
            found = [p for a, z in zip(cuts[:-1] if last else cuts[:-2], cuts[1:], strict=False) for p in _pairs_of(rows.iloc[a:z], percent)]
            left = None if last else rows.iloc[cuts[-2] :]
            yield pd.DataFrame({"a": [p[0] for p in found], "b": [p[1] for p in found]}, dtype="int64")

    of = F.pmod(F.xxhash64("rep"), F.lit(1 << 20))
    block = F.when(F.col("rest"), of % F.col("k_rest")).otherwise(of % F.col("k_main"))
    spread = F.when(
        F.col("rest"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("k_main") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"))),
            F.transform(F.sequence(F.lit(0), F.col("k_rest") - 1), lambda j: F.struct((-1 - F.least(j, F.col("block"))).alias("i"), F.greatest(j, F.col("block")).alias("j"))),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("k_rest") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"))))
    dealt = members.withColumn("block", block.cast("int")).withColumn("to", F.explode(spread)).select("bucket", "to.i", "to.j", "band", "rep", "component", "rest", "n", "bands", "sketch")
    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInPandas(run, "a long, b long")


def _labelled(members: DataFrame, star: DataFrame) -> DataFrame:
    """Members with a label, ``component``, and whether it is another one than their bucket's leader has (``rest``).

    A label is a member's least linked leader, or that one's in turn. Equal labels are connected.
    """
    hop = settle(star.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("up")), "hop", narrow=True)
    again = hop.select(F.col("rep").alias("up"), F.col("up").alias("top"))
    first = hop.join(again, "up", "left").select("rep", F.coalesce("top", "up").alias("component"))
    c = settle(members.join(first, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "labelled", narrow=True)
    main = settle(c.where("rep = leader").select("bucket", F.col("component").alias("main")).distinct(), "main", narrow=True)
    return c.join(main, "bucket").withColumn("rest", F.col("component") != F.col("main"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id, kept)``, one row per row.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets
    of ``shingle``-word shingles. ``component_id`` is the least doc_id that links
    reach. Null, empty and blank texts have no shingles and are linked with nothing;
    a row without doc_id is linked with nothing, its component_id is null and it is
    kept. Rows that repeat a doc_id are one document, for which the least of its
    texts stands; each of them gets its result. An empty table gives no rows. Texts of
    any length are read whole. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = rows
    repeated = not rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:
        one = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
        docs = settle(one.unionByName(rows.where("doc_id is null")), "one")
    profiles = settle(_profiles(docs, shingle), "profiles")
    reps = settle(
        profiles.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "reps",
    )
    banded = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    shared = settle(banded.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("bucket", "leader"), "buckets", narrow=True)
    members = settle(banded.join(shared, "bucket"), "members", narrow=True)
    texts = settle(docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    star = settle(_verify(members.where("rep > leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct(), texts, shingle, percent), "star")
    c = _labelled(members, star)
    alone = c.where("rest and component = rep").select("bucket", "rep")
    hot = settle(alone.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > UNREACHED).select("bucket"), "hot", narrow=True)
    if not hot.isEmpty():
        # Only the members of these buckets are looked at again.
        alone = settle(alone.join(hot, "bucket"), "alone", narrow=True)
        for _ in range(LEADERS):
            again = alone.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where(F.col("n") > UNREACHED).select("bucket", "leader")
            again = settle(again, "leaders", narrow=True)
            if again.isEmpty():
                break
            pairs = alone.join(again, "bucket").where("rep > leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
            more = settle(_verify(pairs, texts, shingle, percent), "star")
            star = star.union(more)
            left = alone.join(more.select(F.col("a").alias("rep")).distinct(), "rep", "left_anti").join(again, "bucket").where("rep <> leader")
            alone = settle(left.select("bucket", "rep"), "alone", narrow=True)
        c = c.join(hot, "bucket", "left_anti").unionByName(_labelled(members.join(hot, "bucket", "left_semi"), star))
    sizes = c.groupBy("bucket").agg(F.count_if("rest").alias("n_rest"), F.count_if(~F.col("rest")).alias("n_main")).where("n_rest > 0")
    sizes = sizes.select("bucket", F.ceil(F.col("n_rest") / CELL).cast("int").alias("k_rest"), F.ceil(F.col("n_main") / CELL).cast("int").alias("k_main"))
    sizes = settle(sizes, "sizes", narrow=True)
    open_ = settle(c.select("bucket", "band", "rep", "component", "rest").join(sizes, "bucket"), "open", narrow=True)
    fine = settle(_fine(texts.join(open_.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), shingle), "fine")
    open_ = open_.join(reps.select("rep", "n", "bands"), "rep").join(fine, "rep")
    pairs = settle(_cells(open_, percent).distinct(), "pairs", narrow=True)
    more = settle(_verify(pairs, texts, shingle, percent), "more")

    joined = settle(components(star.union(more)), "components")
    keyed = reps.select("rep", "k1", "k2").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    keyed = settle(keyed, "keyed", narrow=True)
    # Rows without words have no key to match; their first half is a hash of the id, so that they are not one group.
    out = profiles.select("doc_id", F.coalesce("k1", F.xxhash64("doc_id")).alias("k1"), "k2", F.col("n").alias("n_shingles")).join(keyed, ["k1", "k2"], "left")
    cid = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", cid.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    if repeated:
        known = out.where("doc_id is not null")
        out = rows.where("doc_id is not null").select("doc_id").join(known, "doc_id").unionByName(out.where("doc_id is null"))
    return out
