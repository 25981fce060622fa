"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

Subwords are runs of 2 to 4 bytes inside a word, one blank on either side counting as part of it; letters are
a-z after lower-casing A-Z and all bytes of non-ASCII characters, anything else is a blank. Their hashes pick
rows of an embedding table; the mean row of a document goes through a linear softmax. Both are trained by
stochastic gradient descent in numpy on a sample of at most about `per_lang` labelled documents a language
(the documented bound); a fifth of it is held back to set the temperature and the two limits of rejection: the least
score, and how unusual the subwords of a text may be (with few languages the best one scores high for any text).
Embedding and softmax are folded into one table of logits for prediction, which reads whole texts.

Defined results: a null text and one without a letter is `und` with score 0; a text of letters gets a learned
language; ties go to the alphabetically first; labels are never read at prediction; no labelled row at all
makes every answer `und`; very long texts are read whole, in pieces; repeated rows get the same answer; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, release, schema_of, steps, text_bytes, text_of, texts, tidy
from .words import lower

BUCKETS, DIM, ORDERS = 1 << 14, 16, (2, 3, 4)
EPOCHS, UPDATES, BATCH, RATE = 12, 400, 32, 0.5  # epochs, and updates at least
#: Labelled documents a language that the model is fitted on, about.
PER_LANG = 400
#: Share of right answers that a threshold may reject, and the upper bound of that of the score.
REJECTS, CEILING = 0.001, 0.35
#: Strangeness shrinks with the root of the subwords, up to so many; allowed is that of the strangest held-back text, or LEAST, times MARGIN.
STEADY, MARGIN, LEAST = 256, 1.5, 12.0
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_PERHAPS_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    r"""Whether a character of \p{L} is there; what the pattern finds besides are numbers such as a half or a Roman four."""
    return any(m[0].isalpha() for m in _PERHAPS_LETTER.finditer(text))


def buckets(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the run of `order` bytes at each byte; BUCKETS where no subword starts."""
    n = max(0, len(data) - order + 1)
    out = np.full(len(data), BUCKETS, np.int32)
    if not n:
        return out
    b = np.where(_LETTER[low := lower(data)], low, 32).astype(np.uint32)
    h = np.full(n, order * 0x01000193, np.uint32)
    for k in range(order):
        h += b[k : k + n] * _FACTORS[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    inner = b != 32
    ok = np.ones(n, bool)
    for k in range(1, order - 1):
        ok &= inner[k : k + n]
    ok &= inner[:n] | inner[order - 1 :]
    if order == 2:
        ok &= inner[:n] & inner[1:]
    for k in range(1, order):  # none crosses the end of a row
        ends = offsets[1:] - k
        ends = ends[(ends >= 0) & (ends < n)]
        ok[ends] = False
    out[:n] = np.where(ok, (h >> np.uint32(32 - 14)).astype(np.int32), BUCKETS)
    return out


def histogram(text: bytes) -> np.ndarray:
    """Subword counts of one text, in pieces of bounded memory."""
    total, data = np.zeros(BUCKETS + 1, np.int64), np.frombuffer(text, np.uint8)
    for a in range(0, len(data), STEP_BYTES):
        part = data[a : a + STEP_BYTES]
        for order in ORDERS:
            total += np.bincount(buckets(part, np.array([0, len(part)]), order), minlength=BUCKETS + 1)
    return total[:BUCKETS]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS + 1, langs): each subword's logits before averaging; the last row is zero
    bias: np.ndarray
    usual: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1, np.float32))  # log2 of each subword's share in training, all languages alike
    temperature: float = 1.0
    threshold: float = 0.0
    common: float = 0.0  # mean of usual in held-back texts
    strange: float = np.inf  # how far below it a text may be, see strangeness

    def strangeness(self, usual: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How unusual texts of n subwords are, whose shares have these means: gibberish and languages never seen are."""
        return (self.common - usual) * np.sqrt(np.minimum(n, STEADY))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, langs) probabilities, and strangeness."""
        rows, k = len(offsets) - 1, len(self.langs)
        total, n, known = np.zeros((rows, k)), np.zeros(rows), np.zeros(rows)
        for i, j in steps(offsets):
            for a in range(int(offsets[i]), int(offsets[j]), STEP_BYTES):  # more than once for a very long row only
                z = min(a + STEP_BYTES, int(offsets[j]))
                part, at = data[a:z], np.clip(offsets[i : j + 1] - a, 0, z - a)
                for order in ORDERS:
                    b = buckets(part, at, order)
                    for c in range(k):
                        run = np.concatenate([[0.0], np.cumsum(self.table[:, c][b], dtype=np.float64)])
                        total[i:j, c] += run[at[1:]] - run[at[:-1]]
                    run = np.concatenate([[0], np.cumsum(b != BUCKETS)])
                    n[i:j] += run[at[1:]] - run[at[:-1]]
                    run = np.concatenate([[0.0], np.cumsum(self.usual[b], dtype=np.float64)])
                    known[i:j] += run[at[1:]] - run[at[:-1]]
        logits = (total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), self.strangeness(known / np.maximum(n, 1), n)


def fit(counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 13) -> Model | None:
    """SGD on (bucket, count) histograms of labelled documents."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    y, k, n = np.searchsorted(langs, labels), len(langs), len(labels)
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    order = rng.permutation(n)
    held, train = order[: n // 5], order[n // 5 :]

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for r, i in enumerate(rows):
            idx, c = counts[i]
            x[r, idx] = c / max(1, c.sum())
        return x

    epochs = max(EPOCHS, -(-UPDATES * BATCH // max(len(train), 1)))
    share = np.bincount(y, minlength=k) / n
    weight = np.minimum(1.0 / (k * np.maximum(share, 1e-9)), 10.0).astype(np.float32)  # rare languages count as much
    for epoch in range(epochs):
        rate = np.float32(RATE * (1 - epoch / epochs))
        rng.shuffle(train)
        for a in range(0, len(train), BATCH):
            rows = train[a : a + BATCH]
            cols = np.flatnonzero(np.bincount(np.concatenate([counts[i][0] for i in rows]), minlength=BUCKETS))
            x = dense(rows)[:, cols]  # only subwords of the batch move
            mean = x @ emb[cols]
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[y[rows]][:, None] / len(rows)
            back = p @ out.T
            out -= rate * 4 * (mean.T @ p)
            bias -= rate * p.sum(axis=0)
            emb[cols] -= rate * 200 * (x.T @ back)  # a subword's share of a document is small, so its step is larger
    seen = np.zeros((k, BUCKETS))
    for i in train:
        np.add.at(seen[y[i]], counts[i][0], counts[i][1])
    shares = ((seen + 0.1) / (seen + 0.1).sum(axis=1, keepdims=True)).mean(axis=0)
    model = Model(langs, np.vstack([emb @ out, np.zeros((1, k), np.float32)]), bias, np.append(np.log2(shares), 0).astype(np.float32))
    if len(held):
        size = np.array([max(1, counts[i][1].sum()) for i in held])
        usual = np.array([(model.usual[counts[i][0]] * counts[i][1]).sum() for i in held]) / size
        model.common = float(np.average(usual, weights=size))
        model.strange = MARGIN * max(LEAST, float(np.quantile(model.strangeness(usual, size), 1 - REJECTS)))
        z = np.concatenate([dense(held[a : a + 256]) @ emb @ out + bias for a in range(0, len(held), 256)])

        def probabilities(t: float) -> np.ndarray:
            p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return p / p.sum(axis=1, keepdims=True)

        loss = {t: -np.log(probabilities(t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in np.geomspace(0.25, 4, 17)}
        model.temperature = float(min(loss, key=loss.get))
        p = probabilities(model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
        model.threshold = float(min(CEILING, np.quantile(right, REJECTS))) if len(right) else 0.0
    return model


def held_out(id_col: str, parts: int = 4, which: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == which, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on a hash-chosen sample of about per_lang documents of each language that are not held out."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    if not sizes:
        return None
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(min(1.0, per_lang / n) * (1 << 30))))])
    sample = usable.where(F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 30)) < F.element_at(share, F.col("lang"))).limit(4 * per_lang * len(sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hist = [histogram(t.as_py().encode("utf-8", "replace")) for t in batch.column(0)]
            idx = [np.flatnonzero(h) for h in hist]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([i.astype(np.int16) for i in idx], pa.list_(pa.int16())), pa.array([h[i].astype(np.int32) for h, i in zip(hist, idx, strict=True)], pa.list_(pa.int32()))], names=["lang", "b", "n"])

    got = sample.select("text", "lang").mapInArrow(tidy(count), "lang string, b array<short>, n array<int>").toPandas()
    order = np.argsort([hash_key(b, n) for b, n in zip(got["b"], got["n"], strict=True)], kind="stable") if len(got) else []
    rows = [(np.asarray(got["b"][i], np.int32), np.asarray(got["n"][i], np.float32)) for i in order]
    model = fit(rows, [got["lang"][i] for i in order])
    del rows, got
    release()
    return model


def hash_key(b: np.ndarray, n: np.ndarray) -> int:
    """Any fixed order of the sample, so that training doesn't depend on the order of tasks."""
    return int(np.dot(np.asarray(b, np.int64) * 2654435761 % 4294967291, np.asarray(n, np.int64)) % (1 << 61))


def predict(docs: DataFrame, model: Model | None, carry: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (or `carry` as row), lang_pred, score, and accepted: it has letters, a score not below the threshold, and usual subwords."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    slim, name = texts(docs, id_col, text_col, carry)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            column = text_of(batch, text_col)
            letters = np.fromiter((bool(t.is_valid and has_letter(t.as_py())) for t in column), bool, batch.num_rows)
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            ok = np.zeros(batch.num_rows, bool)
            if model is not None and batch.num_rows:
                p, strange = model.scores(*text_bytes(column))
                lang = np.where(letters, np.array(model.langs, object)[p.argmax(axis=1)], "und")
                score = np.where(letters, p.max(axis=1), 0.0)
                ok = letters & (score >= model.threshold) & (strange <= model.strange)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], names=[name, "lang_pred", "score", "accepted"])

    return slim.mapInArrow(tidy(scan), schema_of(name, slim.schema[name].dataType, "lang_pred string, score double, accepted boolean"))


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, accepted."""
    return predict(docs, train(docs, per_lang)).withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "lang_pred", "score", "accepted")
