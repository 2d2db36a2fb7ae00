"""BPE encoding and decoding with a transducer lexicon.

The corpus's frequent words and their ids are compiled into a minimal acyclic
transducer: a deterministic automaton over the words' bytes whose arcs carry
ids, with outputs pushed towards the root and equal suffix states shared. Its
arrays go to the executors as one file that every worker maps into memory.
A batch's distinct words walk the automaton together; words outside it are
merged exactly, pair by pair in rank order.

The vocabulary is a public ``tokenizers`` file of the word-end kind (NFC,
lower case, white space dropped, ``</w>`` at word ends); its path is a
parameter, read on the driver only.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from inkwell.llm.common import stored

#: Size of the lexicon: the most frequent words that occur at least twice.
MAX_WORDS = 100_000
#: Words of more bytes stay out of the lexicon and of the batched merging.
LONG_WORD = 64
#: Distinct words that a counting task holds before it passes them on.
COUNTED = 400_000
#: Documents encoded together (their distinct words are looked up at once),
#: and the characters after which such a group ends early.
GROUP_DOCS, GROUP_CHARS = 2000, 4_000_000
NONE = 1 << 30
PAD = 0xFFFF


# ------------------------------------------------------------------- vocabulary
class Vocabulary:
    """Tokens, merges and added tokens of the vocabulary's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in chain(vocab.items(), self.added.items()):
            self.tokens[i] = token
        # Bytes stand for characters: printable ones for themselves, the
        # others, in order, for those from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        char = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        end = model["end_of_word_suffix"]
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[char[b] + end] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(key)
        self.pair, self.rank, self.made = key[order], order.astype(np.int32), made[order]

    def arrays(self) -> dict[str, np.ndarray]:
        text = [t.encode() for t in self.tokens]
        ends = np.cumsum([len(t) for t in text])
        return {"inner": self.inner, "final": self.final, "pair": self.pair, "rank": self.rank,
                "made": self.made, "token_end": ends.astype(np.int64),
                "token_text": np.frombuffer(b"".join(text), np.uint8),
                "added": np.frombuffer(json.dumps(self.added).encode(), np.uint8),
                "rules": np.frombuffer(json.dumps(character_rules()).encode(), np.uint8)}


# ------------------------------------------------------------------ exact merges
class Merger:
    """Exact byte-pair merging of words."""

    def __init__(self, a: dict[str, np.ndarray]):
        self.inner, self.final = np.asarray(a["inner"]), np.asarray(a["final"])
        self.pair, self.rank, self.made = (np.asarray(a[k]) for k in ("pair", "rank", "made"))

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no merge) and merged id of pairs of ids."""
        key = left.astype(np.int64) << 16 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.rank[at], NONE), self.made[at]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers; words
        of one length are merged side by side."""
        out = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._one(w).astype("<u4").tobytes()
            elif w:
                by.setdefault(len(w), []).append(i)
        for size, at in by.items():
            block = max(1, 2_000_000 // size)
            for low in range(0, len(at), block):
                part = at[low:low + block]
                raw = np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(-1, size)
                ids, length = self._block(raw)
                flat, step = ids.astype("<u4").tobytes(), 4 * (size + 1)
                for i, low_, n in zip(part, range(0, step * len(part), step), length.tolist()):
                    out[i] = flat[low_:low_ + 4 * n]
        return out

    def _block(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, size = raw.shape
        ids = np.full((n, size + 1), PAD, np.int32)
        ids[:, :size] = self.inner[raw]
        ids[:, size - 1] = self.final[raw[:, -1]]
        length = np.full(n, size)
        if size == 1:
            return ids, length
        rank, made = self._look(ids[:, :-1], ids[:, 1:])
        live, place = np.arange(n), np.arange(size)
        result = ids.copy()
        while len(live):
            best = rank.argmin(axis=1)
            row = np.arange(len(live))
            open_ = rank[row, best] < NONE
            result[live[~open_]] = ids[~open_]
            live, ids, rank, made, best = live[open_], ids[open_], rank[open_], made[open_], best[open_]
            if not len(live):
                break
            row = np.arange(len(live))
            # Put the merged id in place and close the gap behind it.
            ids[row, best] = made[row, best]
            step = place[None, :] + (place[None, :] > best[:, None])
            moved = np.take_along_axis(ids, step, axis=1)
            ids[:, :size] = moved
            ids[:, size] = PAD
            step = np.minimum(step, size - 1)
            rank, made = np.take_along_axis(rank, step, 1), np.take_along_axis(made, step, 1)
            length[live] -= 1
            for near in (best - 1, best):
                ok = near >= 0
                r, m = self._look(ids[row[ok], near[ok]], ids[row[ok], near[ok] + 1])
                rank[row[ok], near[ok]], made[row[ok], near[ok]] = r, m
            rank[row, size - 1] = NONE
        return result, length

    @lru_cache(maxsize=1)
    def _merges(self) -> dict[int, tuple[int, int]]:
        return {int(k): (int(r), int(m)) for k, r, m in zip(self.pair, self.rank, self.made)}

    def _one(self, word: bytes) -> np.ndarray:
        """A long word: linked symbols and a heap of merges by rank, place."""
        known = self._merges()
        ids = [int(x) for x in self.inner[np.frombuffer(word, np.uint8)]]
        ids[-1] = int(self.final[word[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := known.get(ids[i] << 16 | ids[j])):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))
        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)


# ------------------------------------------------------------- transducer lexicon
def compile_lexicon(entries: list[tuple[bytes, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of sorted, distinct (word, ids).

    Each state's common output is moved to the arc that leads to it, then
    states with equal endings are one: built bottom-up over the sorted words,
    a register of state signatures keeps one state of each kind.
    """
    register: dict[tuple, int] = {}

    def common(a: tuple, b: tuple) -> tuple:
        k = 0
        while k < len(a) and k < len(b) and a[k] == b[k]:
            k += 1
        return a[:k]

    def state(low: int, high: int, depth: int) -> tuple[int, tuple]:
        end, arcs = None, []
        if len(entries[low][0]) == depth:
            end, low = entries[low][1], low + 1
        while low < high:
            byte, to = entries[low][0][depth], low + 1
            while to < high and entries[to][0][depth] == byte:
                to += 1
            target, out = state(low, to, depth + 1)
            arcs.append((byte, out, target))
            low = to
        shared = end if end is not None else (arcs[0][1] if arcs else ())
        for _, out, _ in arcs:
            shared = common(shared, out)
        k = len(shared)
        made = (None if end is None else end[k:], tuple((b, out[k:], t) for b, out, t in arcs))
        return register.setdefault(made, len(register)), shared

    root, prefix = state(0, len(entries), 0) if entries else (0, ())
    pool: list[int] = []
    label, target, out_at, out_n = [], [], [], []
    end_at, end_n = np.full(len(register) + 1, -1, np.int64), np.zeros(len(register) + 1, np.int64)

    def put(ids: Iterable[int]) -> int:
        pool.extend(ids)
        return len(pool)
    for (end, arcs), number in register.items():
        if end is not None:
            end_at[number], end_n[number] = len(pool), len(end)
            put(end)
        for byte, out, to in arcs:
            label.append(number << 8 | byte)
            target.append(to)
            out_at.append(len(pool))
            out_n.append(len(out))
            put(out)
    order = np.argsort(np.array(label, np.int64), kind="stable")
    pick = lambda x: np.array(x, np.int64)[order]
    return {"arc": pick(label), "arc_to": pick(target), "arc_out": pick(out_at),
            "arc_n": pick(out_n), "end_out": end_at, "end_n": end_n,
            "pool": np.array(pool, np.int32), "root": np.array([root, len(prefix), *prefix], np.int64)}


def transduce(a: dict[str, np.ndarray], words: list[bytes]) -> list[bytes | None]:
    """Ids of the words the lexicon holds (little-endian unsigned 32-bit), None
    for the others; all words take their k-th step together."""
    n = len(words)
    found: list[bytes | None] = [None] * n
    if not n or not len(a["arc"]):
        return found
    size = np.fromiter(map(len, words), np.int64, n)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    raw = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
    now = np.full(n, a["root"][0])
    alive = size <= LONG_WORD
    prefix = a["root"][2:2 + a["root"][1]]
    pieces: list[list] = []
    for step in range(LONG_WORD):
        at = np.flatnonzero(alive & (size > step))
        if not len(at):
            break
        key = now[at] << 8 | raw[start[at] + step]
        arc = np.minimum(np.searchsorted(a["arc"], key), len(a["arc"]) - 1)
        ok = a["arc"][arc] == key
        alive[at[~ok]] = False
        at, arc = at[ok], arc[ok]
        now[at] = a["arc_to"][arc]
        some = a["arc_n"][arc] > 0
        pieces.append([at[some], a["arc_out"][arc[some]], a["arc_n"][arc[some]]])
    end = a["end_out"][now]
    done = alive & (end >= 0) & (size > 0)
    some = done & (a["end_n"][now] > 0)
    pieces.append([np.flatnonzero(some), end[some], a["end_n"][now[some]]])
    # Outputs of a word in step order: a stable sort by word keeps the steps.
    word, at, count = (np.concatenate(x) for x in zip(*pieces))
    keep = done[word]
    word, at, count = word[keep], at[keep], count[keep]
    by = np.argsort(word, kind="stable")
    word, at, count = word[by], at[by], count[by]
    total = np.concatenate([[0], np.cumsum(count)])
    ids = a["pool"][np.repeat(at - total[:-1], count) + np.arange(total[-1])]
    ids, first = ids.astype("<u4").tobytes(), prefix.astype("<u4").tobytes()
    done = np.flatnonzero(done)
    low = 4 * total[np.searchsorted(word, done)]
    high = 4 * total[np.searchsorted(word, done, "right")]
    for i, x, y in zip(order[done].tolist(), low.tolist(), high.tolist()):
        found[i] = first + ids[x:y]
    return found


# ----------------------------------------------------------------------- encoder
def character_rules() -> dict:
    """Where the installed Unicode tables differ from the library's, taken from
    the library itself: code points that ``regex`` calls letters or numbers and
    it does not, and small letters that ``str.lower`` does not know."""
    from tokenizers import Regex, normalizers, pre_tokenizers
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    drop = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed")
    later, small = [], {}
    lower = normalizers.Lowercase()
    for c in regex.findall(r"[\p{L}\p{N}]", every):
        if unicodedata.category(c) != "Cn":
            continue
        if drop.pre_tokenize_str(c):
            if later and later[-1][1] == ord(c) - 1:
                later[-1][1] = ord(c)
            else:
                later.append([ord(c), ord(c)])
        if (low := lower.normalize_str(c)) != c:
            small[c] = low
    return {"later": later, "small": small}


class Splitter:
    """Words of a text without added tokens: NFC, lower case, the pattern."""

    def __init__(self, rules: dict):
        later = "".join(f"{chr(a)}-{chr(b)}" for a, b in rules["later"])
        known = f"--[{later}]" if later else ""
        # The pattern that the vocabulary's file prescribes (fixed value).
        self.pattern = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}{known}]+|[\p{{N}}{known}]"
            rf"|[^\p{{White_Space}}[[\p{{L}}\p{{N}}]{known}]]+", regex.V1)
        # The same for texts below U+0250, where ``re`` is several times faster.
        few = [chr(c) for c in range(0x250)]
        letter, number, space = ("".join(map(re.escape, regex.findall(rf"\p{{{x}}}", "".join(few))))
                                 for x in ("L", "N", "White_Space"))
        self.common = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]"
                                 rf"|[^{space}{letter}{number}]+")
        self.rare = re.compile("[^\\x00-\u024f]")
        # A capital sigma becomes the plain small one wherever it stands.
        self.small = str.maketrans(rules["small"] | {"\u03a3": "\u03c3"})
        self.capital = re.compile("[" + "".join(map(chr, self.small)) + "]")

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.common.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if not self.rare.search(text):
            text = text.lower()
            # U+0130 becomes an i and a combining dot, which is no longer common.
            return (self.pattern if "\u0307" in text else self.common).findall(text)
        if self.capital.search(text):
            text = text.translate(self.small)
        return self.pattern.findall(text.lower())


class Encoder:
    """Lexicon, merges and tokens over arrays, mapped or in memory."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.merger = Merger(arrays)
        ends = arrays["token_end"].tolist()
        text = bytes(arrays["token_text"])
        self.tokens = [text[a:b].decode() for a, b in zip([0, *ends], ends)]
        self.added: dict[str, int] = json.loads(bytes(arrays["added"]))
        self.words = Splitter(json.loads(bytes(arrays["rules"])))
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(
            self.added, key=len, reverse=True))) + ")") if self.added else None

    def _parts(self, text: str) -> list[str]:
        """Words and added tokens in order (added tokens are found first, in
        the text as it stands; as words they could not hold a letter and a
        sign, so they cannot be mistaken)."""
        if self.split is None or not any(t in text for t in self.added):
            return self.words(text)
        parts: list[str] = []
        for piece in self.split.split(text):
            parts += [piece] if piece in self.added else self.words(piece)
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self._parts(t) for t in texts]
        known = {t: np.uint32(i).tobytes() for t, i in self.added.items()}
        new = list(set(chain.from_iterable(split)) - known.keys())
        raw = [w.encode() for w in new]
        ids = transduce(self.arrays, raw)
        unseen = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(unseen, self.merger.merge([raw[k] for k in unseen])):
            ids[k] = x
        known.update(zip(new, ids))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by blanks (the vocabulary's file names no decoder)."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def save_arrays(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: a header line (name, type, length, offset), then the arrays
    at multiples of 64 bytes, so that they can be mapped."""
    head, at = [], 0
    for name, x in arrays.items():
        head.append([name, x.dtype.str, len(x), at])
        at += -(-x.nbytes // 64) * 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    with open(path, "wb") as f:
        f.write(line)
        for x in arrays.values():
            f.write(x.tobytes().ljust(-(-x.nbytes // 64) * 64, b"\0"))


def map_arrays(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        line = f.readline()
    whole = np.memmap(path, np.uint8, "r")
    return {name: whole[len(line) + at:][:n * np.dtype(kind).itemsize].view(kind)
            for name, kind, n, at in json.loads(line)}


@lru_cache(maxsize=2)
def _mapped(name: str) -> Encoder:
    return Encoder(map_arrays(SparkFiles.get(name)))


# ------------------------------------------------------------------------- Spark
def word_counts(docs: DataFrame, rules: dict) -> DataFrame:
    """(word, count) over all texts; a task passes on partial counts, so its
    memory is bounded, and words meet in one sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words = Counter(), Splitter(rules)
        for batch in batches:
            for t in batch.column(0):
                if (text := t.as_py()):
                    seen.update(words(text))
                if len(seen) >= COUNTED:
                    yield made(seen)
                    seen.clear()
        yield made(seen)

    def made(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    return (docs.select("text").mapInArrow(run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("count")))


def build_encoder(docs: DataFrame, vocabulary: str, max_words: int = MAX_WORDS) -> str:
    """Compile the lexicon of (at most) the ``max_words`` most frequent words of ``docs``
    and ship it with the vocabulary to the executors; returns the file's name.

    The lexicon decides speed only: ids are the same whatever it holds. At
    most ``max_words`` words reach the driver.
    """
    arrays = Vocabulary(vocabulary).arrays()
    words = word_counts(docs, json.loads(bytes(arrays["rules"])))
    words = stored(words.where(f"count > 1 AND octet_length(word) <= {LONG_WORD}"), "bpe-words")
    # Counts in steps of an eighth of a power of two: a few hundred rows tell
    # the least count at which no more than max_words are left.
    level = F.floor(8 * F.log2("count")).cast("int")
    least, left = 0, max_words
    for row in words.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy(
            F.col("l").desc()).collect():
        left -= row.n
        if left < 0:
            least = row.l + 1
            break
    raw = sorted(r[0].encode() for r in words.where(level >= least).select("word").collect())
    ids = Merger(arrays).merge(raw)
    arrays |= compile_lexicon([(w, tuple(np.frombuffer(x, "<u4").tolist()))
                               for w, x in zip(raw, ids)])
    name = f"bpe-lexicon-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="bpe-"), name)
    save_arrays(arrays, path)
    docs.sparkSession.sparkContext.addFile(path)  # Spark's file server hands it out
    return name


def encoded(docs: DataFrame, encoder: str) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and
    ``decoded`` (text of the ids) in place of ``text``.

    Null and empty texts have no ids and decode to the empty text. Extra
    columns pass through; ``ids`` and ``decoded`` replace columns of that name.
    """
    rows = docs.drop("ids", "decoded")
    keep = [f for f in rows.schema if f.name != "text"]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _mapped(encoder)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            low = 0
            while low < len(texts):
                group, chars = [], 0
                while low + len(group) < len(texts) and len(group) < GROUP_DOCS and chars < GROUP_CHARS:
                    group.append(texts[low + len(group)].as_py() or "")
                    chars += len(group[-1])
                ids = own.encode(group)
                columns = [batch.column(batch.schema.get_field_index(n)).slice(low, len(group))
                           for n in names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(ids, pa.binary()),
                     pa.array(map(own.decode, ids), pa.string())], [*names, "ids", "decoded"])
                low += len(group)

    schema = StructType([*keep, StructField("ids", BinaryType()), StructField("decoded", StringType())])
    return rows.mapInArrow(run, schema)


def tokenized(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row; ``ids`` is binary,
    little-endian unsigned 32-bit, as training jobs read it. Null and empty
    texts have no tokens and decode to ''; other columns are not read; repeated
    rows stay; no rows: none."""
    vocabulary = vocabulary or default_vocabulary()
    out = encoded(docs.select("doc_id", "text"), build_encoder(docs, vocabulary))
    n = (F.octet_length("ids") / 4).cast("bigint")
    return out.select("doc_id", n.alias("n_tokens"), "ids", "decoded")


def token_digests(docs: DataFrame, vocabulary: str, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: lowercase
    hex digests of the ids as little-endian unsigned 32-bit numbers and of the
    decoded text. Odd rows as in ``tokenized``."""
    out = encoded(docs.select("doc_id", "text"), build_encoder(docs, vocabulary, max_words))
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def query(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """op7: every document encoded and decoded with the 49k word vocabulary."""
    return token_digests(docs, vocabulary or default_vocabulary())


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
