"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if a string of ``MATCH`` bytes that covers it also starts earlier:
in a document that comes before, or earlier in the same one. Every such string
(window) has an anchor, the leftmost position of its least 32-byte digest, which
depends on its bytes alone; so equal windows have equal anchors at equal
offsets, and only the suffixes that start at anchors need sorting (about one
byte in 35).

1. Documents are kept in chunks. Each chunk tells, by digest range, which
   anchors it has; the ranges reply with the digests that occur twice or more.
   The other anchors have no equal window anywhere and drop out.
2. Each chunk sorts the suffixes of the anchors left (100 bytes from the anchor
   on, then the 68 before it, backwards), keeps the earliest of equal ones and
   sends the sorted runs front-coded: the length shared with the string before,
   and the rest.
3. Each range merges its runs with a loser tree that keeps, for every string,
   the prefix it shares with the last one out: strings are compared by these
   lengths, and bytes are looked at only behind them. The merge yields the
   sorted suffixes with their common prefixes, from which the windows found
   earlier follow.
4. The marks go back to the chunks, which cut the marked bytes out.

Texts are never shuffled: the chunks are buckets of a stored table, and all
exchanges meet them there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from inkwell.llm.chunks import chunked, flat, in_order
from inkwell.llm.common import shielded

MATCH = 100
#: Bytes of an anchor's digest, and positions from which a window picks it.
GRAM = 32
SPAN = MATCH - GRAM + 1
#: A suffix: digest, bytes from the anchor on, bytes before it, their counts.
HEAD, RIGHT, LEFT = 4, MATCH, SPAN - 1
WIDTH = HEAD + RIGHT + LEFT + 2
BLOCK = 1 << 18
LAST = np.iinfo(np.int64).max

_POWERS = [pow(0x9E3779B97F4A7C15, 1 << j, 1 << 64) for j in range(5)]
_BYTES = np.random.default_rng(100).integers(1, 1 << 64, 256, dtype=np.uint64)


# ---------------------------------------------------------------------- anchors
def _digests(data: np.ndarray) -> np.ndarray:
    """64-bit digests of all ``GRAM``-byte strings of ``data``."""
    h = _BYTES[data]
    for j in range(5):
        step = 1 << j
        h = h[:-step] * np.uint64(_POWERS[j]) + h[step:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of documents laid end to end: ``at``, the windows ``low`` to
    ``high`` (starts) that pick each one, and its digest ``id``."""
    edge = np.zeros(len(data) + 1, np.int8)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    real = ends - starts >= MATCH
    np.add.at(edge, starts[real], 1)
    np.add.at(edge, ends[real] - MATCH + 1, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    at, low, high, ids = [], [], [], []
    mask = np.uint64((1 << 24) - 1)
    for begin in range(0, len(data), BLOCK):
        part = data[begin:begin + BLOCK + MATCH - 1]
        if len(part) < MATCH:
            break
        digest = _digests(part)
        least = (digest & ~mask) | np.arange(len(digest), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[:-(SPAN - 64)], least[SPAN - 64:])
        start = np.flatnonzero(valid[begin:begin + len(least)])
        if not len(start):
            continue
        pick = (least[start] & mask).astype(np.int64)
        new = np.flatnonzero(np.r_[True, pick[1:] != pick[:-1]])
        at.append(pick[new] + begin)
        low.append(start[new] + begin)
        high.append(start[np.r_[new[1:] - 1, len(start) - 1]] + begin)
        ids.append(digest[pick[new]])
    if not at:
        none = np.empty(0, np.int64)
        return {"at": none, "low": none, "high": none, "id": none.astype(np.uint64)}
    at, low, high, ids = (np.concatenate(x) for x in (at, low, high, ids))
    # A run that a block cut in two is one again.
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    high = high[np.r_[first[1:] - 1, len(at) - 1]]
    ids = ids[first]
    ids = (ids ^ (ids >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return {"at": at[first], "low": low[first], "high": high, "id": ids ^ (ids >> np.uint64(29))}


def _placed(ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Range (0..parts-1) and 31-bit digest within it. Digests that meet by
    chance only let a few suffixes more through to the exact sort."""
    part = (ids >> np.uint64(33)).astype(np.int64) * parts >> 31
    return part, (ids & np.uint64(0x7FFFFFFF)).astype(np.uint32)


# ------------------------------------------------------------------ sorted runs
def suffixes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray,
             digest: np.ndarray) -> np.ndarray:
    """(n, WIDTH) bytes of the suffixes at ``at``; ``begin`` and ``end`` bound
    each one's document, zeros stand beyond."""
    out = np.zeros((len(at), WIDTH), np.uint8)
    out[:, :HEAD] = digest.astype(">u4").view(np.uint8).reshape(-1, 4)
    right, left = np.minimum(end - at, RIGHT), np.minimum(at - begin, LEFT)
    step = np.arange(RIGHT)
    for low in range(0, len(at), 1 << 14):
        s = slice(low, low + (1 << 14))
        pick = at[s, None] + step
        out[s, HEAD:HEAD + RIGHT] = np.where(
            step < right[s, None], data[np.minimum(pick, len(data) - 1)], 0)
        pick = at[s, None] - 1 - step[:LEFT]
        out[s, HEAD + RIGHT:-2] = np.where(step[:LEFT] < left[s, None], data[np.maximum(pick, 0)], 0)
    out[:, -2], out[:, -1] = right, left
    return out


def _shared(strings: np.ndarray) -> np.ndarray:
    """Length of the prefix that each string shares with the one before."""
    if not len(strings):
        return np.zeros(0, np.int64)
    differ = strings[1:] != strings[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
    return np.concatenate([[0], n])


def front_coded(strings: np.ndarray) -> tuple[bytes, bytes]:
    """(shared lengths, remaining bytes) of sorted strings."""
    shared = _shared(strings)
    rest = strings[np.arange(WIDTH) >= shared[:, None]]
    return shared.astype(np.uint8).tobytes(), rest.tobytes()


class Run:
    """A front-coded run, read string by string."""

    __slots__ = ("shared", "rest", "n", "i", "pos", "text")

    def __init__(self, shared: bytes, rest: bytes):
        self.shared, self.rest, self.n = shared, rest, len(shared)
        self.i, self.pos, self.text = -1, 0, b""

    def advance(self) -> int:
        """Move on; the prefix shared with the string before, -1 at the end."""
        self.i += 1
        if self.i >= self.n:
            return -1
        shared = self.shared[self.i]
        to = self.pos + WIDTH - shared
        self.text = self.text[:shared] + self.rest[self.pos:to]
        self.pos = to
        return shared


def merged(runs: list[Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """All strings of sorted runs in order, as (run, place in it, prefix shared
    with the string before, string). Equal strings come by run.

    Loser tree: node k holds the loser of the match played there and the prefix
    it shares with the winner, which is the last string out when the node is
    next played. The longer of two shared prefixes wins; only equal lengths
    need bytes, from that length on. -1 stands for a run at its end.
    """
    k = 1
    while k < len(runs):
        k *= 2
    count = len(runs)
    loser, shared = [0] * k, [-1] * k

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and its prefix, loser and its prefix."""
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        if la < 0:
            return a, la, b, lb
        x = int.from_bytes(runs[a].text[la:]) ^ int.from_bytes(runs[b].text[la:])
        if not x:
            return (a, la, b, WIDTH) if a < b else (b, la, a, WIDTH)
        at = WIDTH - (x.bit_length() + 7) // 8
        if runs[a].text[at] < runs[b].text[at]:
            return a, la, b, at
        return b, la, a, at

    def seed(node: int) -> tuple[int, int]:
        if node >= k:
            r = node - k
            return r, (runs[r].advance() if r < count else -1)
        w, lw, lo, ll = play(*seed(2 * node), *seed(2 * node + 1))
        loser[node], shared[node] = lo, ll
        return w, lw

    if not count:
        return
    winner, length = seed(1) if k > 1 else (0, runs[0].advance())
    while length >= 0:
        run = runs[winner]
        yield winner, run.i, length, run.text
        length = run.advance()
        node = (k + winner) >> 1
        while node:
            other = shared[node]
            if other > length or (other == length and length >= 0):
                winner, length, loser[node], shared[node] = play(winner, length, loser[node], other)
            node >>= 1


# ---------------------------------------------------------------- found windows
def found_earlier(strings: np.ndarray, shared: np.ndarray, rank: np.ndarray,
                  first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(n, SPAN) flags: the window that starts o bytes before anchor i is also
    found earlier. ``strings`` are distinct and sorted, ``shared`` is the
    prefix shared with the one before, ``rank`` orders the anchors, and each has
    windows at offsets ``first`` to ``last``.

    Windows at offset o are equal if the strings share the digest, the next
    100 - o bytes and the o bytes before: two interval numbers, from the order
    of the suffixes and from that of the backward contexts.
    """
    n = len(strings)
    out = np.zeros((n, SPAN), bool)
    group = np.cumsum(shared < HEAD + GRAM)
    size = np.bincount(group)[group]
    near = np.flatnonzero(size > 1)
    if not len(near):
        return out
    sub, group = strings[near], group[near]
    back = np.ascontiguousarray(sub[:, HEAD + RIGHT:-2])
    order = np.lexsort((back.view(f"S{LEFT}").ravel(), group))
    sorted_ = back[order]
    differ = sorted_[1:] != sorted_[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), LEFT)
    common[group[order][1:] != group[order][:-1]] = -1
    by_rank = np.argsort(rank[near], kind="stable")
    left = np.empty(len(near), np.int64)
    for o in range(SPAN):
        member = (first[near] <= o) & (o <= last[near])
        if member.sum() < 2:
            continue
        # Strings between two that share a prefix share it, too.
        right = np.cumsum(np.minimum(shared, HEAD + RIGHT) < HEAD + MATCH - o)[near]
        left[order] = np.concatenate([[0], np.cumsum(common < o)])
        rows = by_rank[member[by_rank]]
        _, earliest = np.unique(right[rows] * (len(near) + 1) + left[rows], return_index=True)
        later = np.ones(len(rows), bool)
        later[earliest] = False
        out[near[rows[later]], o] = True
    return out


def merge_range(runs: list[dict]) -> list[tuple[int, np.ndarray]]:
    """Marks of one digest range: (chunk, rows of document, first and last
    window start found earlier). A run holds its chunk, the front-coded strings
    and, for each, doc_id, row, document, anchor, first and last offset."""
    trees = [Run(r["shared"], r["rest"]) for r in runs]
    which, place, shared, texts = [], [], [], []
    for w, i, length, text in merged(trees):
        which.append(w)
        place.append(i)
        shared.append(length)
        if length < WIDTH:
            texts.append(text)
    if not which:
        return []
    which, place, shared = np.array(which), np.array(place), np.array(shared)
    start = np.concatenate([[0], np.cumsum([len(r["shared"]) for r in runs])])
    at = start[which] + place
    meta = {k: np.concatenate([r[k] for r in runs])[at] for k in ("doc_id", "row", "doc", "at", "o1", "o2")}
    rank = np.empty(len(at), np.int64)
    rank[np.lexsort((meta["at"], meta["row"], meta["doc_id"]))] = np.arange(len(at))
    # Of equal strings the earliest stands for all; the others are found whole.
    kind = np.cumsum(shared < WIDTH) - 1
    by = np.lexsort((rank, kind))
    best = by[np.r_[True, kind[by][1:] != kind[by][:-1]]]
    whole = np.ones(len(at), bool)
    whole[best] = False
    strings = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, WIDTH)
    flags = found_earlier(strings, shared[shared < WIDTH], rank[best], meta["o1"][best].astype(int),
                          meta["o2"][best].astype(int))
    # Runs of flags, from the largest offset (the earliest start) down.
    pad = np.zeros((len(best), 1), bool)
    step = np.diff(np.concatenate([pad, flags[:, ::-1], pad], axis=1).astype(np.int8), axis=1)
    row, open_ = np.nonzero(step == 1)
    close = np.nonzero(step == -1)[1] - 1
    own = best[row]
    anchor = meta["at"].astype(np.int64)
    pieces = np.concatenate([
        np.stack([which[whole], meta["doc"][whole], anchor[whole] - meta["o2"][whole],
                  anchor[whole] - meta["o1"][whole]], axis=1),
        np.stack([which[own], meta["doc"][own], anchor[own] - (LEFT - open_),
                  anchor[own] - (LEFT - close)], axis=1)])
    pieces = pieces[np.argsort(pieces[:, 0], kind="stable")]
    cut = np.searchsorted(pieces[:, 0], np.arange(len(runs) + 1))
    return [(runs[w]["chunk"], pieces[cut[w]:cut[w + 1], 1:])
            for w in range(len(runs)) if cut[w + 1] > cut[w]]


def cut_out(size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(start, end) of the bytes that windows starting at ``first`` to
    ``last`` cover, as maximal runs."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + MATCH, -1)
    covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    step = np.diff(covered.astype(np.int8))
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1)


# ------------------------------------------------------------------------ Spark
def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


_RUN = StructType([StructField(n, LongType()) for n in ("_part", "_chunk")]
                  + [StructField(n, BinaryType()) for n in
                     ("shared", "rest", "doc_id", "row", "doc", "at", "o1", "o2", "marks")])
_RUN_ARROW = pa.schema([(f.name, pa.int64() if f.name[0] == "_" else pa.binary()) for f in _RUN])
_KINDS = {"doc_id": "<i8", "row": "<i8", "doc": "<u4", "at": "<u4", "o1": "u1", "o2": "u1"}
_MARKS = pa.schema([("_chunk", pa.int64()), ("marks", pa.binary())])


def marked(rows: DataFrame, chunks: int) -> DataFrame:
    """(_chunk, marks): of each chunk's documents, the starts of windows that
    are found earlier, as rows (document, first start, last start)."""
    parts = max(2 * chunks, 16)
    texts = rows.select("_chunk", "_row", F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.col("text").cast("binary").alias("text"))

    def told(table: pa.Table) -> pa.Table:
        data, ends = flat(in_order(table)["text"])
        part, digest = _placed(anchors(data, ends)["id"], parts)
        value, count = np.unique(part.astype(np.uint64) << np.uint64(32) | digest, return_counts=True)
        part = (value >> np.uint64(32)).astype(np.int64)
        sent = (value.astype(np.uint32) << np.uint32(1)) | (count > 1).astype(np.uint32)
        cut = np.searchsorted(part, np.arange(parts + 1))
        some = np.flatnonzero(cut[1:] > cut[:-1])
        return pa.table({
            "_part": pa.array(some, pa.int64()),
            "_chunk": pa.array(np.full(len(some), table["_chunk"][0].as_py()), pa.int64()),
            "sent": pa.array([sent[cut[p]:cut[p + 1]].tobytes() for p in some], pa.binary())})

    def replied(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, "<u4") for x in table["sent"].to_pylist()]
        value, count = np.unique(np.concatenate([x >> 1 for x in sent]), return_counts=True)
        twice = [value[count > 1], *(x[x & 1 == 1] >> 1 for x in sent)]
        twice = np.unique(np.concatenate(twice))
        back = [np.intersect1d(x >> 1, twice, assume_unique=True) for x in sent]
        return pa.table({"_part": table["_part"], "_chunk": table["_chunk"],
                         "back": pa.array([x.astype("<u4").tobytes() for x in back], pa.binary())})

    def sorted_runs(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table) or not len(replies):
            return _RUN_ARROW.empty_table()
        table = in_order(table)
        chunk = table["_chunk"][0].as_py()
        data, ends = flat(table["text"])
        found = anchors(data, ends)
        part, digest = _placed(found["id"], parts)
        kept = [np.uint64(p) << np.uint64(32) | np.frombuffer(b, "<u4").astype(np.uint64)
                for p, b in zip(replies["_part"].to_pylist(), replies["back"].to_pylist())]
        own = np.isin(part.astype(np.uint64) << np.uint64(32) | digest, np.concatenate(kept))
        at, low, high = (found[k][own] for k in ("at", "low", "high"))
        part, digest = part[own], digest[own]
        if not len(at):
            return _RUN_ARROW.empty_table()
        doc = np.searchsorted(ends, at, "right")
        begin = np.concatenate([[0], ends[:-1]])[doc]
        ids = table["doc_id"].combine_chunks().fill_null(LAST)
        ids = np.asarray(ids.to_numpy(zero_copy_only=False), np.int64)[doc]
        row = np.asarray(table["_row"].to_numpy(), np.int64)[doc]
        strings = suffixes(data, begin, ends[doc], at, digest)
        # Sorted by range, then string; of equal ones the earliest comes first.
        order = np.lexsort((at, row, ids))
        order = order[np.lexsort((strings[order].view(f"S{WIDTH}").ravel(), part[order]))]
        strings, part = strings[order], part[order]
        shared = _shared(strings)
        shared[np.flatnonzero(part[1:] != part[:-1]) + 1] = 0
        new = shared < WIDTH
        local = lambda x: (x - begin)[order]
        again = np.stack([doc[order], local(low), local(high)], axis=1)[~new]
        values = {"doc_id": ids[order], "row": row[order], "doc": doc[order], "at": local(at),
                  "o1": (at - high)[order], "o2": (at - low)[order]}
        strings, part = strings[new], part[new]
        cut = np.searchsorted(part, np.arange(parts + 1))
        out: dict[str, list] = {n: [] for n in _RUN_ARROW.names}
        for p in np.flatnonzero(cut[1:] > cut[:-1]):
            s = slice(cut[p], cut[p + 1])
            made = dict(zip(("shared", "rest"), front_coded(strings[s])))
            made |= {k: x[new][s].astype(_KINDS[k]).tobytes() for k, x in values.items()}
            for k, x in (made | {"_part": int(p), "_chunk": chunk, "marks": b""}).items():
                out[k].append(x)
        if len(again):  # decided here; they only pass through the merge
            for k in out:
                out[k].append({"_part": chunk % parts, "_chunk": chunk,
                               "marks": again.astype("<u4").tobytes()}.get(k, b""))
        return pa.table(out, _RUN_ARROW)

    def merge(table: pa.Table) -> pa.Table:
        done, runs = [], []
        for r in table.sort_by("_chunk").to_pylist():
            if r["marks"]:
                done.append((r["_chunk"], r["marks"]))
            else:
                runs.append({"chunk": r["_chunk"], "shared": r["shared"], "rest": r["rest"],
                             **{k: np.frombuffer(r[k], kind) for k, kind in _KINDS.items()}})
        done += [(c, m.astype("<u4").tobytes()) for c, m in merge_range(runs)]
        return pa.table({"_chunk": pa.array([c for c, _ in done], pa.int64()),
                         "marks": pa.array([m for _, m in done], pa.binary())}, _MARKS)

    told_ = texts.groupBy("_chunk").applyInArrow(told, "_part bigint, _chunk bigint, sent binary")
    replied_ = told_.groupBy("_part").applyInArrow(
        replied, "_part bigint, _chunk bigint, back binary")
    replied_ = replied_.withColumn("_chunk", F.col("_chunk").cast("int"))
    runs = (texts.groupBy("_chunk").cogroup(replied_.groupBy("_chunk"))
            .applyInArrow(sorted_runs, _RUN))
    # As many tasks as ranges, so that a task's share does not grow with the input.
    runs = runs.repartition(parts, "_part")
    out = runs.groupBy("_part").applyInArrow(merge, "_chunk bigint, marks binary")
    return out.withColumn("_chunk", F.col("_chunk").cast("int"))


def deduplicated(docs: DataFrame, whole_characters: bool = False) -> DataFrame:
    """``docs`` with ``kept`` (the bytes left of ``text``, as binary) and
    ``spans`` (the removed runs as little-endian 64-bit pairs start, end).
    With ``whole_characters`` a UTF-8 character that loses a byte goes whole.

    Documents are ordered by doc_id (a whole number; nulls last), rows of one
    doc_id by their place in the input. Null and empty texts keep no bytes and
    lose none. Extra columns pass through; ``kept`` and ``spans`` replace
    columns of that name. No rows: no output.
    """
    rows, chunks = chunked(docs.drop("kept", "spans"))
    marks = marked(rows, chunks)
    names = [f for f in rows.schema if f.name not in ("_chunk", "_row")]
    schema = StructType([*names, StructField("kept", BinaryType()), StructField("spans", BinaryType())])
    source = rows.withColumn("_bytes", F.col("text").cast("binary"))

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        table = in_order(table)
        data, ends = flat(table["_bytes"])
        starts = np.concatenate([[0], ends[:-1]])
        got = _joined(found["marks"], "<u4").astype(np.int64).reshape(-1, 3)
        got = got[np.argsort(got[:, 0], kind="stable")]
        to = np.searchsorted(got[:, 0], np.arange(len(ends) + 1))
        kept, spans = [], []
        for d, (a, b) in enumerate(zip(starts, ends)):
            own, text = got[to[d]:to[d + 1]], data[a:b]
            if not len(own):
                kept.append(text.tobytes())
                spans.append(b"")
                continue
            runs = cut_out(len(text), own[:, 1], own[:, 2])
            if whole_characters:
                lead = np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))
                runs[:, 0] = lead[np.searchsorted(lead, runs[:, 0], "right") - 1]
                runs[:, 1] = lead[np.searchsorted(lead, runs[:, 1])]
            edge = np.concatenate([[0], runs.ravel(), [len(text)]])
            kept.append(b"".join(text[x:y].tobytes() for x, y in zip(edge[::2], edge[1::2])))
            spans.append(runs.astype("<i8").tobytes())
        return pa.table([*(table[f.name] for f in names), pa.array(kept, pa.binary()),
                         pa.array(spans, pa.binary())], names=[f.name for f in schema])

    return source.groupBy("_chunk").cogroup(marks.groupBy("_chunk")).applyInArrow(cut, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``, and ``n_chars``,
    if there is one, counted again. Null texts stay null."""
    def work(rows: DataFrame) -> DataFrame:
        out = deduplicated(rows, whole_characters=True)
        new = {"text": F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))}
        if "n_chars" in rows.columns:
            new["n_chars"] = F.length(new["text"]).cast(rows.schema["n_chars"].dataType)
        return out.withColumns(new)

    return shielded(docs, ("doc_id", "text", "n_chars"), work)


def query(docs: DataFrame) -> DataFrame:
    """op4: what is left of every document."""
    out = deduplicated(docs.select("doc_id", "text"))
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return out.select(
        "doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"),
        (F.octet_length("spans") / 16).cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
