"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage becomes a feature vector
(character classes, word shape, repetition, hashed letter pairs). A gated
attention network scores each passage, ``a = softmax(w . (tanh(V h) *
sigmoid(U h)))``, the bag is the weighted sum of its encoded passages, and a
logistic layer scores it. Only document labels are used: the attention learns
which passages matter.

Training takes a bounded sample of labelled documents: those with the lowest
digest of doc_id, at most ``max_labelled`` of them and of ``max_passages``
passages in all. It learns from every passage of a document of the sample;
scoring covers every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from inkwell.llm.common import shielded

#: Words in a passage; the last one of a text may be shorter.
PASSAGE_WORDS = 128
#: Buckets of the hashed letter-pair histogram.
PAIRS = 128
THRESHOLD = 0.7
MAX_LABELLED = 6000
#: Passages of all documents of the training sample, at most (whole documents only).
MAX_PASSAGES = 120_000
SEED = 7

_CLASSES = ("lower", "upper", "digit", "stop", "pause", "shout", "symbol", "high", "other")


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"), np.uint8)
    for name, chars in {"lower": "abcdefghijklmnopqrstuvwxyz",
                        "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789",
                        "stop": ".", "pause": ",;:'-\"()", "shout": "!?",
                        "symbol": "#*$%&|<>@^~=_+{}[]\\/"}.items():
        table[[ord(c) for c in chars]] = _CLASSES.index(name)
    table[128:] = _CLASSES.index("high")
    return table


_TABLE = _class_table()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
FEATURES = len(_CLASSES) + 9 + PAIRS
#: Place of the log word count among the features.
_LENGTH = len(_CLASSES) + 7
#: A passage of so few words counts half: short ones say little.
HALF_WORDS = 20.0
#: Weight of the letter pairs against the other features: they tell languages
#: apart more than quality and would be learnt by heart from few documents.
PAIR_WEIGHT = 0.2


def passage_features(text: bytes | None, words: int = PASSAGE_WORDS) -> np.ndarray:
    """(passages, FEATURES) of one text; empty and null texts are one passage
    of zeros but for its emptiness flag."""
    data = np.frombuffer(text or b"", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        out = np.zeros((1, FEATURES), np.float32)
        out[0, len(_CLASSES) + 8] = 1
        return out
    n = -(-len(starts) // words)
    bag = np.zeros(len(data), np.int64)
    bag[starts[words::words]] = 1
    np.cumsum(bag, out=bag)
    inside = ~space
    counts = np.bincount(bag[inside] * len(_CLASSES) + _TABLE[data[inside]],
                         minlength=n * len(_CLASSES)).reshape(n, -1).astype(np.float32)
    chars = np.maximum(counts.sum(1), 1)
    # Words: length, first and last byte, and a weak digest that finds repeats.
    length, of = ends - starts, np.arange(len(starts)) // words
    per = np.bincount(of, minlength=n).astype(np.float32)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int64)
    total = np.concatenate([[0], np.cumsum((lower * 2654435761) % 1000003 * (lower + 7))])
    digest = (total[ends] - total[starts]) * 64 + length
    order = np.lexsort((digest, of))
    d, o = digest[order], of[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[first], minlength=n)
    again = np.zeros(len(digest), bool)
    again[1:] = (digest[1:] == digest[:-1]) & (of[1:] == of[:-1])
    last = data[ends - 1]
    stops = np.bincount(of, weights=last == ord("."), minlength=n)
    odd = np.bincount(of, weights=_TABLE[last] == _CLASSES.index("symbol"), minlength=n)
    lines = np.bincount(bag, weights=data == 10, minlength=n)
    shape = np.stack([
        np.bincount(of, weights=length, minlength=n) / per / 10,
        distinct / per,
        np.bincount(of, weights=again, minlength=n) / per,
        stops / per, odd / per, lines / per,
        np.bincount(of, weights=_TABLE[data[starts]] == _CLASSES.index("upper"), minlength=n) / per,
        np.log1p(per) / 5, np.zeros(n)], axis=1)
    pair = inside[1:] & inside[:-1]
    code = (lower[:-1] * 31 + lower[1:] * 7) % PAIRS
    pairs = np.bincount(bag[1:][pair] * PAIRS + code[pair], minlength=n * PAIRS).reshape(n, PAIRS)
    pairs = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
    return np.concatenate([counts / chars[:, None], shape, pairs], axis=1).astype(np.float32)


# ------------------------------------------------------------------------ model
@dataclass(frozen=True)
class Model:
    """Weights of the gated attention network, a few tens of kilobytes."""

    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    out: np.ndarray
    bias: float

    def scores(self, x: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` bags from stacked passages and their bag numbers."""
        return _forward(self.__dict__, _normal(x, self.mean, self.scale), bag, n)["p"]


def _normal(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Centred and scaled features, drawn towards the mean in short passages."""
    words = np.expm1(5 * x[:, _LENGTH:_LENGTH + 1])
    out = np.clip((x - mean) * scale, -8, 8) * (words / (words + HALF_WORDS))
    out[:, -PAIRS:] *= PAIR_WEIGHT
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _forward(p: dict, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
    h = np.tanh(x @ p["encode"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, bag, e)
    a = np.exp(e - top[bag])
    a = a / np.bincount(bag, weights=a, minlength=n)[bag]
    z = np.zeros((n, h.shape[1]))
    np.add.at(z, bag, a[:, None] * h)
    return dict(x=x, h=h, t=t, g=g, a=a, z=z, p=_sigmoid(z @ p["out"] + p["bias"]))


def _gradients(p: dict, f: dict, bag: np.ndarray, y: np.ndarray) -> dict:
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * p["out"]
    da = (dz[bag] * f["h"]).sum(1)
    mean = np.bincount(bag, weights=f["a"] * da, minlength=len(y))
    de = f["a"] * (da - mean[bag])
    dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
    return {"out": f["z"].T @ d, "bias": d.sum(), "w": (f["t"] * f["g"]).T @ de,
            "V": f["h"].T @ dt, "U": f["h"].T @ dg,
            "encode": f["x"].T @ (dh * (1 - f["h"] ** 2))}


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, attention: int = 12,
          epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-3) -> Model:
    """Fit by Adam on cross-entropy. One class or no bags at
    all give a model that scores everything by that class (none: 0.5)."""
    rng = np.random.default_rng(SEED)
    stack = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    mean = stack.mean(0)
    scale = 1 / (stack.std(0) + 1e-2)
    k = FEATURES
    p = {"encode": rng.normal(0, k ** -0.5, (k, hidden)),
         "V": rng.normal(0, hidden ** -0.5, (hidden, attention)),
         "U": rng.normal(0, hidden ** -0.5, (hidden, attention)),
         "w": rng.normal(0, attention ** -0.5, attention),
         "out": rng.normal(0, hidden ** -0.5, hidden), "bias": np.zeros(())}
    labels = np.asarray(labels, float)
    share = labels.mean() if len(labels) else 0.5
    if not 0 < share < 1:
        level = {0.0: -4.0, 1.0: 4.0}.get(share, 0.0)
        return Model(mean, scale, **{**p, "out": np.zeros(hidden), "bias": level})
    bags = [_normal(b, mean, scale) for b in bags]
    first, second = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            bag = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            f = _forward(p, np.concatenate([bags[i] for i in pick]), bag, len(pick))
            step += 1
            for name, grad in _gradients(p, f, bag, labels[pick]).items():
                grad = grad + decay * p[name]
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad ** 2
                p[name] = p[name] - rate * (first[name] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, **{**p, "bias": float(p["bias"])})


# ------------------------------------------------------------------------ Spark
def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of doc_id as text, modulo 4,
    is 2 (null doc_id: learnt from nothing either, no label matches it)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
        max_passages: int = MAX_PASSAGES) -> Model:
    """Train on a bounded sample of labelled, not held-out documents.

    In the order of the digests of doc_id and text, whole documents are taken
    as long as they are at most ``max_labelled`` and have at most
    ``max_passages`` passages in all; one too long to fit is passed over. Rows
    with a null doc_id, a null label or a label other than 0 and 1 are not used; rows
    equal in doc_id, text and label are one. A document with several labels or
    texts counts with each. Only the features of the sample reach the driver.
    """
    known = (labels.select("doc_id", "quality").where("quality IN (0, 1) AND doc_id IS NOT NULL")
             .where(~held_out(F.col("doc_id"))).distinct().withColumn("_h", F.xxhash64("doc_id")))
    # Digests are spread evenly: about twice the rows wanted lie below this one,
    # so that the tasks do not each send a whole sample to the driver.
    rows = known.count()
    if rows > 4 * max_labelled:
        low = known.where(F.col("_h") <= -(1 << 63) + (1 << 64) * 2 * max_labelled // rows)
        known = low if low.count() >= max_labelled else known
    known = known.orderBy("_h", "doc_id", "quality").limit(max_labelled)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_t")).join(
        F.broadcast(known), "doc_id")
    # The documents of the sample, without their texts: at most max_labelled rows.
    words = F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    size = F.greatest(F.ceil(words / PASSAGE_WORDS), F.lit(1)).cast("long")
    order = ["_h", "doc_id", "quality", "_t"]
    taken = rows.select(*order, size.alias("n")).distinct().orderBy(*order).limit(max_labelled)
    chosen, room = [], max_passages
    for r in taken.orderBy(*order).collect():
        if r["n"] <= room:
            chosen.append((r["doc_id"], r["quality"], r["_t"]))
            room -= r["n"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(chosen, f"doc_id {id_type}, quality int, _t long")
    rows = rows.select("doc_id", "text", "_t").join(F.broadcast(chosen), ["doc_id", "_t"])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [passage_features(t.as_py()).astype("<f4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3).cast(pa.int32()), pa.array(made, pa.binary())],
                ["doc_id", "_t", "quality", "x"])

    rows = rows.select("doc_id", "_t", "text", "quality").dropDuplicates(["doc_id", "_t", "quality"])
    sample = rows.mapInArrow(featured, f"doc_id {id_type}, _t long, quality int, x binary")
    got = sorted((str(r[0]), r[2], bytes(r[3])) for r in sample.toLocalIterator())
    bags = [np.frombuffer(x, "<f4").reshape(-1, FEATURES) for _, _, x in got]
    return train(bags, np.array([q for _, q, _ in got]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` last (0 to 1, higher: label 1 likelier). Null
    and empty texts get the score of an empty passage; ``score`` replaces a
    column of that name."""
    rows = docs.drop("score")
    names = [f.name for f in rows.schema]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.empty(batch.num_rows)
            for low in range(0, batch.num_rows, 64):
                texts = batch.column(at).slice(low, 64).cast(pa.binary())
                bags = [passage_features(t.as_py()) for t in texts]
                bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
                score[low:low + len(bags)] = model.scores(np.concatenate(bags), bag, len(bags))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*names, "score"])

    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier fitted on ``labels`` accepts,
    unchanged: extra and clashing columns stay. Null and empty texts are judged
    as one empty passage, equal texts alike; no rows: none."""
    model = fit(docs, labels)
    return shielded(docs, ("doc_id", "text"),
                    lambda rows: scored(rows, model).where(F.col("score") >= threshold))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op10: score of every document."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
