"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and their first 5 letters. Every term of the examples is indexed, and
examples of both labels can be neighbours. The term weights are TF-IDF with a relevance
factor learnt from the labels of the examples: the IDF counts in full if the term is
significantly commoner in toxic examples than in others, and down to ``ORDINARY`` of it
if it is not. The examples, a bounded sample of the labelled rows, stand in an inverted
index. Postings of the commonest terms, which are most of what a query meets, lie in
blocks of examples, as a table, with the largest weight of each term in each block; those
of the others are short and read whole. A query visits the blocks of high upper bounds,
and then those whose bound can still change its nearest examples; queries that visit a
block do so together. What single precision leaves open is compared in double, so the
neighbours are exact. Votes are weighted
by similarity, and calibrated by isotonic regression over labelled rows that are no
examples: they are not in the index and no weight was learnt from them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinsieve.llm.shared import crc_of_id, single_threaded

#: Bounds of the samples of each label: examples, and rows that votes are calibrated on.
EXAMPLES, CALIBRATION = 2000, 500
NEIGHBOURS, BLOCK = 15, 128
#: A query first visits the blocks of at least this part of the highest bound.
HIGH = 0.7
#: Terms whose postings lie in blocks, and the most that a sum over them in single precision is off: vectors have length 1 and no negative weights.
COMMON = 1024
OFF = (COMMON + 8) * 2.0**-24
#: Queries that visit blocks together, and how many characters of texts they have, about, unless one has more.
TOGETHER, CHARACTERS = 128, 1_000_000
WORD = re.compile(r"[^\W\d_]+")
#: What a byte of Latin-1 is among words: itself if it is a letter to ``WORD``, else a blank.
LETTERS = bytes(i if WORD.fullmatch(chr(i)) else 32 for i in range(256))
PREFIXES = (5,)
#: Mass of the prior in a vote, in units of squared similarity.
PRIOR = 0.05
#: What part of its IDF a term keeps that is not commoner in toxic examples, and the log-likelihood gain at which half of the rest counts.
ORDINARY, GAIN = 0.1, 15.0


def words_of(text: str) -> list[str]:
    text = text.lower()
    try:
        return text.encode("latin-1").translate(LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(text)


def word_terms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each a up to its b, one after another, and how many each has."""
    n = b - a
    ends = np.cumsum(n)
    return np.repeat(a - ends + n, n) + np.arange(ends[-1] if len(ends) else 0), n


def together(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, as many as visit blocks together at a time."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if len(some) == TOGETHER or size >= CHARACTERS:
            yield some
            some, size = [], 0
    if some:
        yield some


class _Terms:
    """Ids of the terms of words. No word is remembered: most that are not among the examples' come once."""

    def __init__(self, term: dict[str, int]):
        self.whole = term.get
        self.prefix = [(n, {t[:-1]: i for t, i in term.items() if len(t) == n + 1 and t[-1] == "*"}.get) for n in PREFIXES]

    def ids(self, words: list[str]) -> np.ndarray:
        found = [map(self.whole, words, repeat(-1)), *(map(get, [w[:n] for w in words], repeat(-1)) for n, get in self.prefix)]
        out = np.concatenate([np.fromiter(x, np.int64, len(words)) for x in found])
        return out[out >= 0]


class Examples:
    def __init__(self, texts: list[str], toxic: list[int], share: tuple[float, float], others: list[tuple[str, int]] = ()):  # type: ignore[assignment]
        """share: what part of all rows with label 0, and 1, the examples are. others: (text, label) to calibrate on."""
        bags = [words_of(t) for t in texts]
        pos, neg = Counter(), Counter()
        for bag, label in zip(bags, toxic, strict=True):
            (pos if label else neg).update({t for w in set(bag) for t in word_terms(w)})
        n1, n0 = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
        terms = sorted(pos.keys() | neg.keys())
        self.term = {t: i for i, t in enumerate(terms)}
        weight = np.array([1 / share[0], 1 / share[1]])
        total = n0 * weight[0] + n1 * weight[1]
        a, b = np.array([pos[t] for t in terms], float), np.array([neg[t] for t in terms], float)
        self.idf = np.log(1 + total / (1 + b * weight[0] + a * weight[1])) * self.relevance(a, b, n1, n0)
        self.known = _Terms(self.term)
        vectors = [self.vector(bag) for bag in bags]
        # Examples with the same heaviest term are neighbours in the index, so that bounds of blocks differ.
        order = sorted(range(len(texts)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else -1, i))
        self.y = np.array([toxic[i] for i in order], int)
        self.w = weight[self.y]
        self.vectors = [vectors[i] for i in order]
        self._index(self.vectors)
        self.raw_at, self.score_at = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        y = np.array([label for _, label in others], int)
        self._calibrate(np.array([raw for some in together([t for t, _ in others]) for raw, _ in self.votes([self.vector(words_of(t)) for t in some])]), y, weight[y])

    @staticmethod
    def relevance(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
        """From ``ORDINARY`` to 1, for terms in a of n1 toxic examples and b of n0 others."""
        gain, r = np.zeros(len(a)), (a + b) / (n1 + n0)
        for k, m, x in ((a, n1, r), (n1 - a, n1, 1 - r), (b, n0, r), (n0 - b, n0, 1 - r)):
            on = k > 0
            gain[on] += 2 * k[on] * np.log(k[on] / (m * x[on]))
        gain = np.where(a / n1 > b / n0, np.maximum(gain, 0), 0) ** 2
        return ORDINARY + (1 - ORDINARY) * gain / (gain + GAIN**2)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None, "vectors": []}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, known=_Terms(state["term"]))

    def vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Term ids and weights of unit length; both empty if no term is known."""
        terms = self.known.ids(words)
        if not len(terms):
            return np.zeros(0, int), np.zeros(0)
        ids, many = np.unique(terms, return_counts=True)
        x = (1 + np.log(many)) * self.idf[ids]
        return ids, x / np.sqrt((x * x).sum())

    def _index(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Postings of common terms by block, term and example, those of the others by term and example."""
        n, self.blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
        ids = np.concatenate([v[0] for v in vectors] or [np.zeros(0, int)])
        val = np.concatenate([v[1] for v in vectors] or [np.zeros(0)])
        who = np.repeat(np.arange(n), [len(v[0]) for v in vectors])
        common = np.argsort(-np.bincount(ids, minlength=len(self.term)), kind="stable")[:COMMON]
        self.row = np.full(len(self.term), -1, np.int32)
        self.row[common] = np.arange(len(common))
        on = self.row[ids] >= 0
        # What an example has of common terms, in double precision, and the table of it.
        self.rows, self.values = self.row[ids[on]], val[on]
        self.first = np.searchsorted(who[on], np.arange(n + 1))
        self.table = np.zeros((self.blocks, len(common), BLOCK), np.float32)
        self.table[who[on] // BLOCK, self.rows, who[on] % BLOCK] = self.values
        self.most = np.zeros((len(common), self.blocks))
        np.maximum.at(self.most, (self.rows, who[on] // BLOCK), self.values)
        ids, val, who = ids[~on], val[~on], who[~on]
        order = np.argsort(ids, kind="stable")
        self.weight, self.who = val[order], who[order].astype(np.int32)
        self.start = np.searchsorted(ids[order], np.arange(len(self.term) + 1))

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k nearest examples with a similarity over 0: (similarity, example), exact; ties by example."""
        return self.nearest_of([vector], k)[0]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """``nearest`` of each of some vectors."""
        m, width = len(vectors), self.blocks * BLOCK
        s, common = np.zeros((m, width)), np.zeros((m, len(self.most)))
        for j, (ids, q) in enumerate(vectors):
            row = self.row[ids]
            on = row >= 0
            common[j, row[on]] = q[on]
            ids = ids[~on]
            at, n = ranges(self.start[ids], self.start[ids + 1])
            s[j] = np.bincount(self.who[at], np.repeat(q[~on], n) * self.weight[at], width)
        bound = s.reshape(m, self.blocks, BLOCK).max(axis=2) + common @ self.most
        near, short, open_ = np.zeros((m, width)), common.astype(np.float32), bound > 0
        part = open_ & (bound >= HIGH * bound.max(axis=1, keepdims=True))
        while part.any():
            for b in np.flatnonzero(part.any(axis=0)):
                i, its = np.flatnonzero(part[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                near[i, its] = s[i, its] + short[i] @ self.table[b]
            least = np.partition(near, max(0, width - k), axis=1)[:, max(0, width - k), None]
            open_ &= ~part
            part = open_ & (bound >= least - OFF)
        i, who = np.nonzero((near > 0) & (near >= least - 2 * OFF)) if bound.any() else np.zeros((2, 0), int)
        at, n = ranges(self.first[who], self.first[who + 1])
        each = np.repeat(np.arange(len(who)), n)
        sums = s[i, who] + np.bincount(each, common[i[each], self.rows[at]] * self.values[at], len(who))
        order = np.lexsort((who, -sums, i))
        ends = np.searchsorted(i, np.arange(m + 1))
        sums, who = sums[order].tolist(), who[order].tolist()
        return [list(zip(sums[a:b], who[a:b], strict=True))[:k] for a, b in zip(ends, ends[1:], strict=False)]

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[float, int]]]]:
        out = []
        for near in self.nearest_of(vectors):
            s, i = np.array([x[0] for x in near]) ** 2, [x[1] for x in near]
            mass = s * self.w[i] / self.w.min() if near else s
            out.append((float((mass * self.y[i]).sum() / (mass.sum() + PRIOR)) if near else 0.0, near))
        return out

    def _calibrate(self, raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Pool adjacent violators: the share of toxic rows by raw vote, never falling."""
        if not len(raw):
            return
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []
        for x, y, w in zip(raw[order], labels[order], weights[order], strict=True):
            if pools and pools[-1][3] == x:
                pools[-1][0] += w * y
                pools[-1][1] += w
            else:
                pools.append([w * y, w, x, x])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a, b = pools[-2], pools.pop()
                pools[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
        self.raw_at = np.array([v for p in pools for v in (p[2], p[3])])
        self.score_at = np.array([v for p in pools for v in [p[0] / p[1]] * 2])

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        """The score and the nearest examples of each of some texts."""
        found = self.votes([self.vector(words_of(t or "")) for t in texts])
        p = [0.98 * float(np.interp(raw, self.raw_at, self.score_at)) + 0.02 * raw for raw, _ in found]
        return [(min(1.0, max(0.0, x)), near) for x, (_, near) in zip(p, found, strict=True)]


def examples(docs: DataFrame, labels: DataFrame) -> Examples:
    """The labelled samples: by the hash of doc_id, about ``EXAMPLES`` and ``CALIBRATION`` rows of each label at most, parted 4 to 1 where there are fewer."""
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    one = one.where(F.col("toxic").isin(0, 1) & (F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) != 0))
    counts = {r.toxic: r["count"] for r in one.groupBy("toxic").count().collect()}
    both = EXAMPLES + CALIBRATION
    rate = {y: min(1.0, both / counts[y]) if counts.get(y) else 1.0 for y in (0, 1)}
    limit = F.when(F.col("toxic") == 1, F.lit(int(rate[1] * (1 << 40)))).otherwise(F.lit(int(rate[0] * (1 << 40))))
    # About twice EXAMPLES + CALIBRATION ids: the sample's bound is the bound of this broadcast.
    ids = one.where(key < limit).select("doc_id", "toxic", (key < limit * (EXAMPLES / both)).alias("indexed")).limit(4 * both)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").limit(4 * both).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text, r.toxic))
    seen = {r.text: r.toxic for r in rows if r.indexed}
    others = {r.text: r.toxic for r in rows if not r.indexed and r.text not in seen}
    texts = sorted(seen)
    return Examples(texts, [seen[t] for t in texts], (max(rate[0], 1e-9), max(rate[1], 1e-9)), sorted(others.items()))


def rate_toxicity(docs: DataFrame, labels: DataFrame, evidence: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` and ``labels(doc_id, toxic)`` -> docs with held_out, score, predicted (and evidence).

    Only labels of rows whose crc32(doc_id as text) mod 5 is not 0 are learnt from. A
    null or empty text, and one without known terms, has no neighbours and gets what the
    calibration gives for a vote of 0; without any labels all scores are 0. ``evidence``
    has the nearest examples' labels and similarities, nearest first; of equally near
    ones the first in the index. One row per row: repeated rows and rows without doc_id
    are scored like others, the latter not held out. Of labels that contradict each other
    for one doc_id, 1 holds. An empty table gives no rows. Texts of any length are read
    whole. Columns of docs named like one of the new ones are replaced by it.
    """
    named = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(examples(named, labels))
    docs = docs.drop(*({"held_out", "score", "predicted", "evidence"} & set(docs.columns)))
    held = F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    docs = docs.withColumn("held_out", held)
    columns = docs.columns
    more = "score double, predicted int" + (", evidence array<struct<label: int, similarity: double>>" if evidence else "")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(more).fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        single_threaded()
        m = model.value
        for batch in batches:
            at = 0
            # A lot is scored and given out before the next is looked at.
            for some in together(t.as_py() for t in batch.column(columns.index("text"))):
                found = m.scores(some)
                p = np.array([x[0] for x in found], np.float64)
                new = [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
                if evidence:
                    new.append(pa.array([[{"label": int(m.y[i]), "similarity": s} for s, i in near] for _, near in found], pa.list_(pa.struct([("label", pa.int32()), ("similarity", pa.float64())]))))
                part = batch.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*columns, *["score", "predicted", "evidence"][: len(new)]])

    return docs.mapInArrow(run, schema)
