"""Language of texts: blended-spectrum string kernel, Nystroem landmarks, kernel ridge regression.

The kernel of two texts is the number of n-grams (1 to 4 code points, lower case)
that both have, over the geometric mean of their own numbers of distinct n-grams.
One-versus-rest ridge regression is solved in the space that the landmarks span. As
the kernel is linear in the presence vector, the product (landmarks x coefficients) is
folded into one matrix with a row for every n-gram that a landmark has, and a batch of
texts is scored by one product of its sparse presence matrix with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.shared import crc_of_id, single_threaded
from twinsieve.llm.shingles import mix

#: Bounds of the training sample: rows a language, and landmarks a language.
PER_LANGUAGE, LANDMARKS = 400, 64
#: With more languages than these totals allow for, each has its share of them, and ``FEWEST`` at least.
ROWS, MARKS, FEWEST = 25_600, 2048, 4
LONGEST_GRAM, TABLE_BITS = 4, 20
#: Code points of a text whose n-grams are held at a time.
SEGMENT = 1 << 20
UNDETERMINED = "und"


def grams(text: str) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a whole text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(0, np.uint64)
    for at in range(0, len(c), SEGMENT):
        part = c[at : at + SEGMENT + LONGEST_GRAM - 1].astype(np.uint64) + np.uint64(1)
        codes, code = [], np.zeros(len(part), np.uint64)
        for n in range(1, LONGEST_GRAM + 1):
            if len(part) < n:
                break
            code = code[: len(part) - n + 1] * np.uint64(0x110001) + part[n - 1 :]
            codes.append(code * np.uint64(8) + np.uint64(n))
        found = np.unique(mix(np.concatenate(codes)))
        out = np.union1d(out, found) if at else found
    return out


@dataclass
class Model:
    """keys: sorted n-grams of the landmarks. first: by the leading bits of a hash, the place of the first key with them."""

    languages: list[str]
    keys: np.ndarray
    first: np.ndarray
    folded: np.ndarray
    heat: float

    def present(self, text: str) -> tuple[np.ndarray, int]:
        """Places of the keys that a text has, and the number of all its distinct n-grams."""
        h = grams(text)
        lead = (h >> np.uint64(64 - TABLE_BITS)).astype(np.intp)
        at, end = self.first[lead], self.first[lead + 1]
        found = []
        while True:
            on = at < end
            if not on.any():
                return np.sort(np.concatenate(found)) if found else np.zeros(0, np.intp), len(h)
            h_on, at, end = h[on] if len(found) == 0 else h_on[on], at[on], end[on]
            hit = self.keys[at] == h_on
            found.append(at[hit])
            h_on, at, end = h_on[~hit], at[~hit] + 1, end[~hit]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Decision values, one row per text and one column per language."""
        ids, size = zip(*map(self.present, texts), strict=True)
        n = np.array([len(i) for i in ids])
        out = np.zeros((len(texts), self.folded.shape[1]))
        full = np.flatnonzero(n)
        for part in np.array_split(full, max(1, int(n.sum()) >> 19)):
            if len(part):
                rows = self.folded[np.concatenate([ids[i] for i in part])]
                out[part] = np.add.reduceat(rows, np.cumsum(n[part]) - n[part], axis=0) / np.sqrt(np.array(size)[part])[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        names, p = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if known and self.languages:
            s = self.scores([texts[i] for i in known]) * self.heat
            e = np.exp(s - s.max(axis=1, keepdims=True))
            e /= e.sum(axis=1, keepdims=True)
            best = e.argmax(axis=1)
            for i, b in zip(known, best, strict=True):
                names[i] = self.languages[b]
            p[known] = e[np.arange(len(known)), best]
        return names, p


def lookup(keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(keys >> np.uint64(64 - TABLE_BITS), np.arange((1 << TABLE_BITS) + 1).astype(np.uint64)).astype(np.intp)


def fit(rows: list[tuple[str, str]], ridge: float = 1e-2) -> Model:
    """``rows``: (text, language), in an order that does not depend on either."""
    languages = sorted({y for _, y in rows})
    per = max(FEWEST, min(LANDMARKS, MARKS // max(1, len(languages))))
    marks = [t for y in languages for t in [x for x, z in rows if z == y][:per]]
    keys = np.unique(np.concatenate([*(grams(t) for t in marks), np.zeros(0, np.uint64)]))
    if not len(keys):
        return Model([], keys, lookup(keys), np.zeros((0, 1)), 1.0)
    model = Model(languages, keys, lookup(keys), np.zeros((len(keys), 1)), 1.0)

    found = [model.present(t) for t in marks]
    scale = 1 / np.sqrt([max(1, n) for _, n in found])
    at, who = np.concatenate([i for i, _ in found]), np.repeat(np.arange(len(marks)), [len(i) for i, _ in found])
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    begin = np.searchsorted(at, np.arange(len(keys) + 1))

    def kernel(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(marks)))
        for row, t in zip(out, texts, strict=True):
            i, size = model.present(t)
            n = begin[i + 1] - begin[i]
            ends = np.cumsum(n)
            near = np.repeat(begin[i] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
            row[:] = np.bincount(who[near], minlength=len(marks)) * scale / np.sqrt(max(1, size))
        return out

    value, vector = np.linalg.eigh(kernel(marks))
    keep = value > 1e-6 * value.max(initial=1e-12)
    whiten = vector[:, keep] / np.sqrt(value[keep])
    z = kernel([t for t, _ in rows]) @ whiten
    y = np.array([[1.0 if lang == c else -1.0 for c in languages] for _, lang in rows])
    aside = np.arange(len(rows)) % 5 == 4
    solve = lambda on: np.linalg.solve(z[on].T @ z[on] + ridge * max(1, on.sum()) * np.eye(z.shape[1]), z[on].T @ y[on])
    if aside.any() and len(languages) > 1:
        s, t = z[aside] @ solve(~aside), y[aside].argmax(axis=1)

        def loss(heat: float) -> float:
            e = s * heat
            return float(-(e[np.arange(len(t)), t] - np.log(np.exp(e - e.max(axis=1, keepdims=True)).sum(axis=1)) - e.max(axis=1)).mean())

        model.heat = min((1.0, 2.0, 3.0, 4.0, 6.0, 8.0), key=loss)
    coefficients = (whiten @ solve(np.ones(len(rows), bool))) * scale[:, None]
    model.folded = np.empty((len(keys), len(languages)), np.float32)
    for j in range(len(languages)):
        model.folded[:, j] = np.bincount(at, coefficients[who, j], len(keys))
    return model


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """A sample by the hash of doc_id, at most about ``PER_LANGUAGE`` rows of each language, or its share of ``ROWS``."""
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    fit_rows = docs.where((F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = fit_rows.groupBy("lang").count()
    number = counts.count()
    if not number:
        return []
    per = max(FEWEST, min(PER_LANGUAGE, ROWS // number))
    # One row per language: a rate that draws about ``per`` rows. A language is never left out: of a few rows all are drawn.
    rates = counts.select("lang", F.least(F.lit(1 << 40), (F.lit(float(1 << 40)) * F.lit(per) / F.col("count")).cast("long")).alias("rate"), (F.col("count") > 4 * per).alias("many"))
    rates = F.broadcast(rates) if number <= 10_000 else rates
    near = fit_rows.select("text", "lang", key.alias("key")).join(rates, "lang").where(F.when(F.col("many"), F.col("key") < F.col("rate")).otherwise(F.lit(True)))
    rows = near.select("text", "lang", "key").limit(4 * per * number).collect()
    kept: dict[str, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r.key, r.text)):
        if kept.get(r.lang, 0) < per:
            kept[r.lang] = kept.get(r.lang, 0) + 1
            out.append((r.text, r.lang))
    return out


def identify(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` -> doc_id, held_out, lang_pred, score; one row per row.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out; the model learns from
    the others with a text and a language, and knows every language that these have. A
    null text or one without a letter is ``und`` with score 0, and so is all if there is
    nothing to learn from. Of languages with equal decision values the first by name
    wins. Texts of any length are read whole; repeated rows are rows like others; an
    empty table gives no rows. A row without doc_id is predicted but neither held out
    nor learnt from. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        single_threaded()
        for batch in batches:
            names, p = model.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(p)], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


