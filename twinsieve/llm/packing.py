"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition tokenizes its documents and packs what is shorter than a sequence by
best-fit decreasing on its own. Bins that are nearly full are done. The others go up
a tree: each node takes the underfull bins of a few children as items of a further
best-fit round, until one node is left. A bin's pieces never part.

Of its bins that are not full a node passes up as many as its level has nodes, those
with the most room, and no more can be needed: after best-fit no two bins of a node fit
into one, so at most one of them is half full or less. Two bins of different nodes fit
into one only if one of them is such a bin, and a merge leaves one less of these, so all
levels above together make fewer merges than this level has nodes. Each takes one bin
of the node at most, and if some bin has room for another's pieces, a roomier one has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm.shared import settle, single_threaded

SEQUENCE, END_ID = 1024, 2
#: Children of a node.
FAN = 8


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """Token ids of texts by a byte-level BPE file of ``tokenizers``.

    The file's vocabulary also drives a faster encoder with the same merges; it is
    used where it gives the same ids for the probe texts, and any text it cannot
    take goes to ``tokenizers``.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    PROBES = ("", " ", "a", "Hello  world\n\n it's 3,5% \t\x00", "Élan déjà — 東京 😀́", "x" * 3000, " \n" * 70, "<|endoftext|> `{}`", "'S'T ’s  z")

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        self.fast = None
        try:
            import tiktoken

            letters = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
            others = [b for b in range(256) if b not in letters]
            byte_of = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(others)}
            special = {t.content for t in self.exact.get_added_tokens_decoder().values()}
            ranks = {bytes(byte_of[c] for c in piece): i for piece, i in self.exact.get_vocab(with_added_tokens=False).items() if piece not in special}
            fast = tiktoken.Encoding("same", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
            if all(fast.encode_ordinary(t) == self._slow(t) for t in self.PROBES):
                self.fast = fast
        except (ImportError, KeyError, ValueError):
            self.fast = None

    def _slow(self, text: str) -> list[int]:
        return self.exact.encode(text, add_special_tokens=False).ids

    def of(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) < 1_000_000:
            try:
                return np.asarray(self.fast.encode_ordinary(text), np.uint32)
            except BaseException as e:  # the encoder's own panic is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                    raise
        return np.asarray(self._slow(text), np.uint32)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit in the given order -> (bin of each item, its offset there, fill of each bin)."""
    room_mask, by_room = 0, [[] for _ in range(capacity + 1)]
    bins, offsets, fill = [], [], []
    for n in lengths:
        fits = room_mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                room_mask ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += n
        left = room - n
        if left:
            by_room[left].append(b)
            room_mask |= 1 << left
    return bins, offsets, fill


def _pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, node, made = None, TaskContext.get().partitionId(), 0
        short: list[tuple] = []
        for batch in batches:
            ids = ids or Ids(tokenizer)
            full = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                doc_id = None if doc_id is None or doc_id != doc_id else int(doc_id)
                tokens = np.append(ids.of(text if isinstance(text, str) else ""), np.uint32(END_ID)).astype("<u4")
                cut, piece = len(tokens) % SEQUENCE, 0
                if cut:
                    short.append((doc_id, 0, 0, cut, zlib.crc32(tokens[:cut].tobytes())))
                    piece = 1
                for start in range(cut, len(tokens), SEQUENCE):
                    full.append((doc_id, piece, start, SEQUENCE, zlib.crc32(tokens[start : start + SEQUENCE].tobytes()), (node << 33) + made, 0, SEQUENCE))
                    made, piece = made + 1, piece + 1
            if full:
                yield _typed(pd.DataFrame(full, columns=columns))
        short.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[4]))
        bins, offsets, fill = best_fit([x[3] for x in short], SEQUENCE)
        for at in range(0, len(short), 50_000):
            part = range(at, min(at + 50_000, len(short)))
            yield _typed(pd.DataFrame([(*short[i], (node << 33) + made + bins[i], offsets[i], fill[bins[i]]) for i in part], columns=columns))

    return docs.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long")


def _typed(frame: pd.DataFrame) -> pd.DataFrame:
    frame["doc_id"] = pd.array(frame["doc_id"], dtype="Int64")
    return frame


def _merge(rows: DataFrame, nodes: int) -> DataFrame:
    """A level of ``nodes`` nodes: rows(leaf, bin, base, fill, node) -> the same, with bins merged, and ``done``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        items = rows.groupby("bin", as_index=False)["fill"].first().sort_values(["fill", "bin"], ascending=[False, True])
        bins, offsets, fill = best_fit(items["fill"].tolist(), SEQUENCE)
        names: dict[int, int] = {}
        for name, b in zip(items["bin"].tolist(), bins, strict=True):
            names.setdefault(b, name)
        to = {name: (names[b], off, fill[b]) for name, b, off in zip(items["bin"].tolist(), bins, offsets, strict=True)}
        roomy = sorted((f, names[b]) for b, f in enumerate(fill) if f < SEQUENCE)[:nodes]
        up = {name for _, name in roomy}
        moved = [to[b] for b in rows["bin"].tolist()]
        return pd.DataFrame({
            "leaf": rows["leaf"], "bin": [m[0] for m in moved], "base": rows["base"] + [m[1] for m in moved],
            "fill": [m[2] for m in moved], "node": key[0], "done": [m[0] not in up for m in moved],
        })

    up = rows.withColumn("node", F.floor(F.col("node") / FAN))
    return up.groupBy("node").applyInPandas(run, "leaf long, bin long, base long, fill long, node long, done boolean")


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and one end id, so a null or empty text is the end
    id alone. One longer than a sequence is cut into whole sequences after a first
    piece of what is left over. One row per piece; repeated rows and rows without
    doc_id are packed like others. Of bins with equal room the one that came to it last
    is taken. No rows give no rows. Texts of any length are read whole. Other columns
    are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = settle(_pieces(docs, tokenizer or default_tokenizer()), "pieces")
    roomy = pieces.where((F.col("offset") == 0) & (F.col("fill") < SEQUENCE))
    rows = settle(roomy.select(F.col("bin").alias("leaf"), "bin", F.lit(0).cast("long").alias("base"), "fill", F.shiftright("bin", 33).alias("node")), "level")
    done, nodes = [], rows.agg(F.max("node")).first()[0]
    if nodes:
        # The leaves are a level too; their bins are merged already.
        order = Window.partitionBy("node").orderBy("fill", "bin")
        ranked = settle(rows.withColumn("place", F.row_number().over(order)), "ranked")
        done.append(ranked.where(F.col("place") > nodes + 1).drop("place"))
        rows = ranked.where(F.col("place") <= nodes + 1).drop("place")
    while nodes:
        nodes = nodes // FAN
        level = settle(_merge(rows, nodes + 1), "level")
        done.append(level.where("done").drop("done"))
        rows = level.where("not done").drop("done")
    for part in done:
        rows = rows.unionByName(part)
    moved = settle(rows.select(F.col("leaf"), F.col("bin").alias("into"), "base"), "moved")
    out = pieces.join(moved, pieces["bin"] == moved["leaf"], "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
