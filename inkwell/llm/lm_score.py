"""Cross-entropy difference of two n-gram models.

A target model (documents labelled good) and a background model (all
documents) are bigram models of one vocabulary, smoothed alike: counts are
interpolated with the model's own unigrams. A document's score is its mean
loss per token under the target model minus that under the background model;
the lower, the more it reads like the target.

Words are told apart by 64-bit digests. Documents stay in stored chunks. A
chunk sends its distinct words with their counts to ranges of digests, which
add them up and reply with the totals; then its distinct bigrams likewise. It
works out the losses of its own bigrams from the replies, so nobody holds the
whole vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from inkwell.llm.chunks import chunked
from inkwell.llm.common import stored
from inkwell.llm.quality_mil import held_out

#: A word is in the vocabulary if it makes up this share of all words or more;
#: the others are one token. No word is too rare.
WORD_SHARE = 0.0
#: Weight of the unigrams, in counts of the context.
SMOOTHING = 50.0
#: Ids of the unknown word, the start and the end of a text; digests of words follow.
UNKNOWN, START, END = 0, 1, 2
SEED = 42


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return (text or b"").lower().split()


class Digests(dict):
    """Digest of each word, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        made = max(END + 1, xxhash.xxh64_intdigest(word, SEED))
        self[word] = made
        return made


def coded(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words of the texts end to end, and the numbers of words."""
    number = Digests()
    ids = [np.empty(0, np.uint64)]
    for x in table["text"]:
        split = tokens(x.as_py())
        ids.append(np.fromiter(map(number.__getitem__, split), np.uint64, len(split)))
    return np.concatenate(ids), np.array([len(x) for x in ids[1:]], np.int64)


def bigrams(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (context << 32 | token) of all tokens of texts of ``size`` words,
    each with its end, and the numbers of tokens."""
    last = np.cumsum(size + 1) - 1
    token = np.full(len(ids) + len(size), END, np.int64)
    token[np.delete(np.arange(len(token)), last)] = ids
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[last - size] = START
    return context << 32 | token, size + 1


def paired(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Digests of bigrams from the digests of their words."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + token
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Models:
    """Target and background model: what a chunk knows of one vocabulary.

    ``words`` are the digests (sorted) that the chunk needs, the special ids
    first; ``counts`` (2, n) their numbers as contexts, ``total`` (2) all tokens,
    ``size`` the number of words that a model tells apart."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: np.ndarray, size: int):
        self.words, self.counts = words, counts.astype(np.float64)
        self.share = (self.counts + 1) / (np.asarray(total, np.float64)[:, None] + size)

    def placed(self, ids: np.ndarray) -> np.ndarray:
        """Places in ``words``; the place of ``UNKNOWN`` for others."""
        at = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        return np.where(self.words[at] == ids, at, UNKNOWN)

    def digests(self, code: np.ndarray) -> np.ndarray:
        return paired(self.words[code >> 32], self.words[code & 0xFFFFFFFF])

    def losses(self, code: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """(2, n) bits that the target and the background model need for each
        bigram's token, from its counts ``seen`` (2, n)."""
        context, token = code >> 32, code & 0xFFFFFFFF
        share = (seen + SMOOTHING * self.share[:, token]) / (self.counts[:, context] + SMOOTHING)
        return -np.log2(share)


_SENT = pa.schema([("_part", pa.int64()), ("_chunk", pa.int64()), ("code", pa.binary()),
                   ("n", pa.binary())])
_REPLY = pa.schema([("_chunk", pa.int32()), ("_part", pa.int64()), ("total", pa.binary()),
                    ("own", pa.binary()), ("t", pa.int64()), ("n", pa.int64())])


def _packed(n: np.ndarray) -> bytes:
    """Counts (m, 2), column by column, in as few bytes each as all of them fit:
    all lowest bytes first, so that the zeros above them compress well."""
    top = int(n.max(initial=0))
    width = next(k for k in (1, 2, 4, 8) if top >> 8 * k == 0)
    return np.ascontiguousarray(n.T, f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _unpacked(packed: bytes, m: int) -> np.ndarray:
    width = len(packed) // (2 * m)
    planes = np.frombuffer(packed, np.uint8).reshape(width, 2 * m)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(2, m).T.astype(np.int64)


def _ranges(value: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of digests by their ranges, and where the ranges start in it."""
    part = ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) * parts >> 31
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _sent(chunk: int, value: np.ndarray, n: np.ndarray, parts: int) -> pa.Table:
    """Distinct digests and their counts (m, 2), cut by range."""
    order, cut = _ranges(value, parts)
    value, n = value[order], n[order]
    some = np.flatnonzero(cut[1:] > cut[:-1])
    return pa.table([pa.array(x, f.type) for x, f in zip((
        some, [chunk] * len(some), [value[cut[p]:cut[p + 1]].tobytes() for p in some],
        [_packed(n[cut[p]:cut[p + 1]]) for p in some]), _SENT)], schema=_SENT)


def _answers(value: np.ndarray, replies: pa.Table, parts: int) -> np.ndarray:
    """Totals (m, 2) of the digests that the chunk sent, from all ranges' replies."""
    order, cut = _ranges(value, parts)
    out = np.empty((len(value), 2), np.int64)
    for p, total in zip(replies["_part"].to_pylist(), replies["total"].to_pylist()):
        at = order[cut[p]:cut[p + 1]]
        out[at] = _unpacked(total, len(at))
    return out


def _counted(code: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and their numbers (m, 2) among targets and among all."""
    value, at = np.unique(code, return_inverse=True)
    return value, np.stack([np.bincount(at[own], minlength=len(value)),
                            np.bincount(at, minlength=len(value))], axis=1)


def _replied(table: pa.Table, words: bool) -> pa.Table:
    """Totals of one range of digests, for every chunk that sent some, in the
    order in which they came. For ``words``, the first row also has the counts
    of the range's words and their sums."""
    code = [np.frombuffer(x, "<u8") for x in table["code"].to_pylist()]
    n = np.concatenate([_unpacked(x, len(c)) for x, c in zip(table["n"].to_pylist(), code)])
    value, at = np.unique(np.concatenate(code), return_inverse=True)
    total = np.stack([np.bincount(at, weights=n[:, k], minlength=len(value)) for k in (0, 1)], axis=1)
    total = total.astype("<u8")
    cut = np.cumsum([len(x) for x in code])[:-1]
    own, sums = (total[value != UNKNOWN].tobytes(), total.sum(axis=0)) if words else (b"", (0, 0))
    rest = len(code) - 1
    return pa.table([pa.array(x, f.type) for x, f in zip((
        table["_chunk"].to_pylist(), table["_part"].to_pylist(), [_packed(x) for x in np.split(total[at], cut)],
        [own] + [b""] * rest, *([int(x)] + [0] * rest for x in sums)), _REPLY)], schema=_REPLY)


def scored(docs: DataFrame, target: DataFrame, share: float = WORD_SHARE) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every
    document; ``target`` has the doc_ids of the target texts.

    Losses are mean bits per token, the end of the text included, so null and
    empty texts have one token. Rows with a target doc_id are all targets,
    whatever their number; null doc_ids never are. Without target texts the
    target model is uniform. Extra columns are not read. No rows: no output.
    """
    rows, chunks = chunked(docs.select("doc_id", "text"))
    parts = max(16, chunks // 2)
    texts = rows.select("_chunk", "_row", "doc_id", F.col("text").cast("binary").alias("text"))
    chosen = stored(rows.join(target.select("doc_id").distinct(), "doc_id", "left_semi")
                    .select("_chunk", "_row"), "lm-target")

    def picked(table: pa.Table, choice: pa.Table) -> np.ndarray:
        return np.isin(table["_row"].to_numpy(), choice["_row"].drop_null().to_numpy())

    def exchanged(f, told: DataFrame, words: bool) -> DataFrame:
        sent = texts.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(
            f, "_part bigint, _chunk bigint, code binary, n binary")
        return sent.repartition(parts, "_part").groupBy("_part").applyInArrow(
            lambda table: _replied(table, words),
            "_chunk int, _part bigint, total binary, own binary, t bigint, n bigint")

    def own_words(table: pa.Table, choice: pa.Table) -> pa.Table:
        if not len(table):
            return _SENT.empty_table()
        ids, size = coded(table)
        return _sent(table["_chunk"][0].as_py(), *_counted(ids, np.repeat(picked(table, choice), size)), parts)

    words = stored(exchanged(own_words, chosen, True), "lm-words")
    total = [x or 0 for x in words.agg(F.sum("t"), F.sum("n")).first()]
    least = share * total[1]

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8").reshape(-1, 2)
            own = own[own[:, 1] >= least]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(x)], pa.int64()) for x in (len(own), *own.sum(axis=0))], ["words", "t", "n"])

    size, *common = [x or 0 for x in words.select("own").mapInArrow(
        known, "words bigint, t bigint, n bigint").agg(F.sum("words"), F.sum("t"), F.sum("n")).first()]
    texts_in = [chosen.count(), rows.count()]
    special = np.array([np.subtract(total, common), texts_in, texts_in], np.int64)

    def models(ids: np.ndarray, replies: pa.Table) -> Models:
        digest = np.unique(ids)
        counts = _answers(digest, replies, parts)
        fine = (digest != UNKNOWN) & (counts[:, 1] >= least)
        return Models(np.concatenate([np.array([UNKNOWN, START, END], np.uint64), digest[fine]]),
                      np.concatenate([special, counts[fine]]).T, np.add(total, texts_in), size + 2)

    def own_bigrams(table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return _SENT.empty_table()
        ids, n = coded(table)
        model = models(ids, told.filter(pc.is_valid(told["total"])))
        code, length = bigrams(model.placed(ids), n)
        value, n = _counted(code, np.repeat(picked(table, told), length))
        return _sent(table["_chunk"][0].as_py(), model.digests(value), n, parts)

    def rated(table: pa.Table, told: pa.Table) -> pa.Table:
        ids, n = coded(table)
        model = models(ids, told.filter(pc.equal(told["kind"], 1)))
        code, length = bigrams(model.placed(ids), n)
        value, at = np.unique(code, return_inverse=True)
        seen = _answers(model.digests(value), told.filter(pc.equal(told["kind"], 2)), parts)
        each = model.losses(value, seen.T)[:, at].T
        start = np.cumsum(length) - length
        mean = np.add.reduceat(each, start, axis=0) / length[:, None] if len(length) else each[:0]
        return pa.table([table["doc_id"], pa.array(length), pa.array(mean[:, 0]), pa.array(mean[:, 1]),
                         pa.array(mean[:, 0] - mean[:, 1])], names=[f.name for f in schema])

    answers = words.select("_chunk", "_part", "total")
    pairs = exchanged(own_bigrams, answers.withColumn("_row", F.lit(None).cast("bigint")).unionByName(
        chosen, allowMissingColumns=True), False).select("_chunk", "_part", "total")
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType),
                         StructField("n_tokens", LongType())]
                        + [StructField(n, DoubleType()) for n in ("target_loss", "background_loss", "score")])
    told = answers.withColumn("kind", F.lit(1)).unionByName(pairs.withColumn("kind", F.lit(2)))
    return texts.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(rated, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op6: all documents, against those labelled good (held-out rows apart)."""
    good = labels.where(~held_out(F.col("doc_id"))).where("quality = 1")
    return scored(docs, good)
