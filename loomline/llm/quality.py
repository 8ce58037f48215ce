"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by class log-count ratios (naive Bayes support vectors).

Indicators: words and pairs of words as they stand; the shapes of words (runs of one kind of character
collapsed) alone, in pairs and in threes; whether a word repeats once, twice or three times in a row. They are hashed into 2**BITS
places. Dual coordinate descent fits the model on about SAMPLE labelled rows, which a hash of the id picks
from all of them; a fifth of these only turns margins into probabilities.

How it scales. The fit is one task of fixed size. Scoring is one pass over the texts without a shuffle; the
weights are 2**BITS numbers, whatever the corpus.

Cases. Null ids stay null and are never labelled; null text counts as empty; a text without words has margin 0 and so the model's base rate. A document
with several labels takes the mean, a null label is none. If only one class is labelled, or none, every score is
that share (0.5 for none). Rows that share an id are scored each by its own text. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrays import U, flat, hashes, mix
from ._lean import lean, lean_group, settle
from ._spark import table, texts, with_nulls
from ._words import blocks, words

BITS, SAMPLE = 18, 12_000
#: Predicted 1 from this score on.
CUT = 0.3
COST, ROUNDS, SMOOTH = 1.0, 12, 1.0


def _kinds() -> np.ndarray:
    """The kind of each byte: lower case (and what is not ASCII), upper case, digit, or the sign itself."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = out[128:] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


KINDS = _kinds()


def indicators(at: np.ndarray, data: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each row's distinct indicators, in order."""
    start, end, row = words(at, data)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        w = hashes(data, start, end)
        kind = KINDS[data]
        new = np.append(True, kind[1:] != kind[:-1])
        new[start] = True
        at_new = np.flatnonzero(new)
        s = hashes(kind[at_new], np.searchsorted(at_new, start), np.searchsorted(at_new, end))
        same = row[1:] == row[:-1]
        three = same[1:] & same[:-1]
        equal = same & (w[1:] == w[:-1])
        again = np.flatnonzero(equal)
        thrice, four = np.flatnonzero(equal[1:] & equal[:-1]), np.flatnonzero(equal[2:] & equal[1:-1] & equal[:-2])
        grams = [
            (row, w * U(3)), (row[1:][same], (w[:-1] * U(5) + w[1:] * U(7))[same]),
            (row, s * U(11)), (row[1:][same], (s[:-1] * U(13) + s[1:] * U(17))[same]),
            (row[2:][three], (s[:-2] * U(19) + s[1:-1] * U(23) + s[2:] * U(29))[three]),
            (row[again], np.full(len(again), 31, U)), (row[thrice], np.full(len(thrice), 37, U)), (row[four], np.full(len(four), 41, U)),
        ]
        place = mix(np.concatenate([g for _, g in grams])) >> U(64 - bits)
        both = np.unique((np.concatenate([r for r, _ in grams]) << bits) | place.astype(np.int64))
    return both >> bits, both & ((1 << bits) - 1)


def _features(bits: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = flat(batch.column("text"))
            for i, j, offsets, part in blocks(at, data):
                row, place = indicators(offsets, part, bits)
                ends = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))], ["doc_id", "label", "places"])

    return go


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, rounds: int) -> np.ndarray:
    """Weights of the hinge-loss model by dual coordinate descent; rows have unit length."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    order = np.arange(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        rng.shuffle(order)
        worst = 0.0
        for k in order.tolist():
            i, x = rows[k], values[k]
            slope = y[k] * (w[i] @ x) - 1
            new = min(max(alpha[k] - slope, 0.0), cost[k])
            if step := new - alpha[k]:
                w[i] += step * y[k] * x
                alpha[k] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) fits labels 0 and 1, smoothed as Platt does."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        step *= min(1, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, held: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(log-count ratios, weights, a, b); ``held`` rows fix a and b only."""
    if y.min(initial=1) == y.max(initial=0):
        share = float(y.mean()) if len(y) else 0.5
        return np.zeros(size), np.zeros(size), 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    train = np.flatnonzero(~held)
    if len(np.unique(y[train])) < 2 or len(np.unique(y[held])) < 2:
        train, held = np.arange(len(y)), np.ones(len(y), bool)
    count = [np.full(size, SMOOTH), np.full(size, SMOOTH)]
    for k in train:
        count[int(y[k])][rows[k]] += 1
    r = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())

    def scaled(i: np.ndarray) -> np.ndarray:
        x = r[i]
        return x / max(np.linalg.norm(x), 1e-12)

    share = y[train].mean()
    cost = COST * np.where(y[train] > 0, 0.5 / share, 0.5 / (1 - share))
    w = descend([rows[k] for k in train], [scaled(rows[k]) for k in train], 2.0 * y[train] - 1, cost, size, ROUNDS)
    margin = np.array([w[rows[k]] @ scaled(rows[k]) for k in np.flatnonzero(held)])
    return r, w, *sigmoid_fit(margin, y[held])


def _fit(bits: int):
    def go(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        lists = t.column("places").combine_chunks()
        ends, flat_places = lists.offsets.to_numpy(), lists.values.to_numpy()
        rows = [flat_places[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        y = np.round(t.column("label").to_numpy()).astype(float)
        held = mix(t.column("doc_id").to_numpy().astype(U)) % U(5) == 0
        r, w, a, b = fit(rows, y, held, 1 << bits)
        return pa.table({"name": ["ratio", "weight", "line"], "values": pa.array([r, w, np.array([a, b])], pa.list_(pa.float64()))})

    return go


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> dict[str, np.ndarray]:
    """The model, from labels (doc_id, label) that a hash of doc_id thins to about ``sample`` rows."""
    labels = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    n = labels.count()
    bar = int(min(1.0, sample / max(n, 1)) * (1 << 30))
    labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bar)
    rows = docs.join(labels, "doc_id").mapInArrow(lean(_features(bits)), "doc_id long, label double, places array<int>")
    got = {x["name"]: np.array(x["values"]) for x in rows.groupBy(F.lit(0).alias("one")).applyInArrow(lean_group(_fit(bits)), "name string, values array<double>").collect()}
    return got or {"ratio": np.zeros(1 << bits), "weight": np.zeros(1 << bits), "line": np.zeros(2)}


def scores(model: dict[str, np.ndarray], spark: SparkSession, bits: int = BITS) -> Callable[[Column], Column]:
    """A function of a text column: the score of each text, null ones as empty."""
    sent = spark.sparkContext.broadcast(model)  # 2**bits numbers

    @F.arrow_udf("double")
    def score(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        settle()
        r, w, (a, b) = (sent.value[k] for k in ("ratio", "weight", "line"))
        both, square = r * w, r * r
        for own in text:
            at, data = flat(own)
            out = [np.zeros(0)]
            for i, j, offsets, part in blocks(at, data):
                row, place = indicators(offsets, part, bits)
                length = np.sqrt(np.bincount(row, square[place], minlength=j - i))
                margin = np.bincount(row, both[place], minlength=j - i) / np.maximum(length, 1e-12)
                out.append(1 / (1 + np.exp(-np.clip(a * margin + b, -700, 700))))
            yield pa.array(np.concatenate(out))
        settle()

    return score


def score(docs: DataFrame, model: dict[str, np.ndarray], keep: str = "doc_id", bits: int = BITS) -> DataFrame:
    """(keep, score) of each row's ``text``; ``keep`` names one column of docs."""
    return docs.select(keep, scores(model, docs.sparkSession, bits)("text").alias("score"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that never saw the held-out fold."""
    docs = texts(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    out = with_nulls(score(docs, train(docs, labels.where(~held_out()))))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
SQL: dict[str, str] = {}
