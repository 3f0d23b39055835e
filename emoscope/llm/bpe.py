"""Operator 8: BPE encoding and decoding with a transducer lexicon.

Frequent words are compiled, with their token ids as output, into a minimal
acyclic automaton that shares prefixes and suffixes; every arc carries how many
words sort before the ones behind it, so a walk ends in the word's number and
the number finds its ids.  The automaton is one block of bytes, broadcast and
memory-mapped by each worker.  A word that the automaton does not hold is
merged exactly, by rank; a bounded table per worker remembers words met before.
Both affect speed only: the ids are those of the vocabulary's merges.

The codec covers byte-level BPE files of the ``tokenizers`` library with the
usual byte-level split into words, no normaliser and added tokens that are
matched as they stand.

Defined results: null text counts as empty and has no tokens; one output row
for each input row, so repeated rows and null ids pass through; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emoscope.llm.common import kept_by_worker, text_of

#: Bytes of the words that a worker remembers, about, in each of two generations.
REMEMBERED_BYTES = 1 << 25
#: Distinct words that a task counts before it passes the counts on.
COUNTED_WORDS = 100_000
_SPREAD = 0x9E3779B1
_MARKS = 1 << 19
_SHORT = 64

# Fixed value: the byte-level split into words, spelled with Unicode white space.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                       r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# The same split for texts whose characters all lie below U+0250, spelled out for the faster engine.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_W = "\\t-\\r \x85\xa0"
_SPLIT_LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer file lies; only the driver reads it."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def split_words(text: str) -> list[str]:
    return (_SPLIT if _BEYOND_LATIN.search(text) else _SPLIT_LATIN).findall(text)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if
    printable, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {chr(b if b in plain else next(other)): b for b in range(256)}


class Vocabulary:
    """Ids and merges of a vocabulary file, read on the driver."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(map(to_byte.__getitem__, s)) for s, i in ids.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of.update({i: s.encode("utf-8") for s, i in self.added.items()})
        self.byte_ids = [0] * 256
        for s, i in ids.items():
            if len(s) == 1:
                self.byte_ids[to_byte[s]] = i
        self.right: list[dict[int, int]] = [{} for _ in range(max(self.bytes_of) + 1)]  # left -> right -> rank
        self.merged: list[int] = []  # by rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.right[ids[a]].setdefault(ids[b], rank)
            self.merged.append(ids[a + b])

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word: always the lowest rank first, leftmost first."""
        ids = [self.byte_ids[b] for b in word]
        return self._merge_short(ids) if len(ids) <= _SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        right, merged, none = self.right, self.merged, 1 << 29
        found = [right[a].get(b, none) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            ids[i] = new = merged[best]
            del ids[i + 1], found[i]
            if i < len(found):
                found[i] = right[new].get(ids[i + 1], none)
            if i:
                found[i - 1] = right[ids[i - 1]].get(new, none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for very long words."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < n:
                rank = self.right[ids[i]].get(ids[after[i]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if ids[i] != a or after[i] >= n or ids[after[i]] != b:
                continue  # one of the two has been merged meanwhile
            gone = after[i]
            ids[i], ids[gone] = self.merged[rank], -1
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


class _Node:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self):
        self.arcs: dict[int, _Node] = {}
        self.final = False
        self.number = -1
        self.words = 0


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal automaton of the words with their ids, as one block:
    header, arc table (open addressing: key, target, words before), finals,
    offsets of the ids, ids, all 64-bit integers; last a bit for the checksum of
    each word, which spares most other words the walk."""
    words = sorted(w for w in entries if w)
    root, register, last = _Node(), {}, b""
    path = [root]

    def freeze(depth: int) -> None:
        """Replace the nodes of the last word below ``depth`` by equal ones met before."""
        while len(path) > depth + 1:
            node = path.pop()
            key = (node.final, tuple((b, id(x)) for b, x in node.arcs.items()))
            path[-1].arcs[last[len(path) - 1]] = register.setdefault(key, node)

    for w in words:
        common = len(os.path.commonprefix([last, w]))
        freeze(common)
        for b in w[common:]:
            node = _Node()
            path[-1].arcs[b] = node
            path.append(node)
        path[-1].final = True
        last = w
    freeze(0)

    order: list[_Node] = []

    def count(start: _Node) -> None:
        stack = [(start, False)]
        while stack:
            node, done = stack.pop()
            if done:
                node.words = node.final + sum(x.words for x in node.arcs.values())
            elif node.number < 0:
                node.number = len(order)
                order.append(node)
                stack.append((node, True))
                stack += [(x, False) for x in node.arcs.values()]

    count(root)
    n_arcs = sum(len(x.arcs) for x in order)
    size = 1 << max(4, (2 * n_arcs).bit_length())
    table = [-1] * (3 * size)
    for node in order:
        skipped = int(node.final)
        for b in sorted(node.arcs):
            to, key = node.arcs[b], node.number << 8 | b
            at = (key * _SPREAD >> 20) & (size - 1)
            while table[3 * at] >= 0:
                at = (at + 1) & (size - 1)
            table[3 * at:3 * at + 3] = [key, to.number, skipped]
            skipped += to.words
    offsets, ids = [0], []
    for w in words:
        ids += entries[w]
        offsets.append(len(ids))
    parts = [[size, len(order), len(words), len(ids)], table, [int(x.final) for x in order], offsets, ids]
    marks = bytearray(_MARKS >> 3)
    for w in words:
        h = zlib.crc32(w) & (_MARKS - 1)
        marks[h >> 3] |= 1 << (h & 7)
    return b"".join(struct.pack(f"<{len(p)}q", *p) for p in parts) + bytes(marks)


class Lexicon:
    """The automaton, memory-mapped from a file that has no name any more."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile(prefix="lexicon-") as f:
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), len(block), access=mmap.ACCESS_READ)
        whole = memoryview(self.map)
        self.marks = whole[len(block) - (_MARKS >> 3):]
        view = whole[:len(block) - (_MARKS >> 3)].cast("q")
        self.size, states, words, n_ids = view[:4]
        cuts = [4]
        for n in (3 * self.size, states, words + 1, n_ids):
            cuts.append(cuts[-1] + n)
        self.table, self.final, self.offsets, self.ids = (view[a:b] for a, b in zip(cuts, cuts[1:]))

    def find(self, word: bytes) -> list[int] | None:
        """Token ids of a word, or None if the automaton does not accept it."""
        h = zlib.crc32(word) & (_MARKS - 1)
        if not self.marks[h >> 3] >> (h & 7) & 1:
            return None
        state = number = 0
        table, mask = self.table, self.size - 1
        for b in word:
            key = state << 8 | b
            at = (key * _SPREAD >> 20) & mask
            while table[3 * at] != key:
                if table[3 * at] < 0:
                    return None
                at = (at + 1) & mask
            state = table[3 * at + 1]
            number += table[3 * at + 2]
        if not self.final[state]:
            return None
        return self.ids[self.offsets[number]:self.offsets[number + 1]].tolist()


class _Remembered(dict):
    """Words met lately by this worker; asks the words met before, the automaton,
    then the merges.  Two generations bound it and keep the frequent words."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.before: dict[str, tuple[int, ...]] = {}
        self.bytes = 0

    def age(self) -> None:
        self.before = dict(self)
        self.clear()
        self.bytes = 0

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.before.get(word)
        if ids is None:
            data = word.encode("utf-8")
            ids = self.lexicon.find(data)
            if ids is None:
                ids = self.vocabulary.merge(data)
            ids = tuple(ids)
        self[word] = ids
        self.bytes += 200 + 2 * len(word) + 16 * len(ids)
        return ids


class Codec:
    def __init__(self, vocabulary: Vocabulary, block: bytes):
        self.words = _Remembered(vocabulary, Lexicon(block))
        top = max(vocabulary.bytes_of) + 1
        self.bytes_of = [vocabulary.bytes_of.get(i, b"") for i in range(top)]
        self.added = vocabulary.added
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")"
                              ) if self.added else None

    def encode(self, text: str) -> list[int]:
        if self.words.bytes > REMEMBERED_BYTES:
            self.words.age()
        if self.cut is None or not any(s in text for s in self.added):
            return list(chain.from_iterable(map(self.words.__getitem__, split_words(text))))
        ids: list[int] = []
        for part in self.cut.split(text):
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                ids += chain.from_iterable(map(self.words.__getitem__, split_words(part)))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, sample_docs: int | None = None, most: int = 20_000) -> list[str]:
    """The ``most`` frequent words of all documents (of ``sample_docs`` of them,
    chosen by a hash of the id, if a caller asks for it), counted per Arrow batch
    and then by Spark.  They set the automaton's size and speed, not the ids."""
    chosen = docs
    if sample_docs is not None:
        ids = (docs.select("doc_id").filter("doc_id is not null").distinct()
               .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
        chosen = docs.join(F.broadcast(ids), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                             names=["w", "n"])
            seen.clear()
            return out

        for batch in batches:
            for x in batch.column(0):
                seen.update(split_words(x.as_py()))
                if len(seen) > COUNTED_WORDS:
                    yield rows()
        yield rows()

    counts = chosen.select(text_of().alias("text")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [r.w for r in counts.orderBy(F.col("n").desc(), "w").limit(most).collect()]


class SharedCodec:
    """Vocabulary and automaton as broadcasts; ``get`` opens them once per worker."""

    def __init__(self, docs: DataFrame, path: str, **how):
        vocabulary = Vocabulary(path)
        words = [w.encode("utf-8") for w in frequent_words(docs, **how)]
        block = compile_lexicon({w: vocabulary.merge(w) for w in words})
        self.key = hashlib.sha256(block).hexdigest() + path
        context = docs.sparkSession.sparkContext
        self.parts = context.broadcast((vocabulary, block))

    def get(self) -> Codec:
        return kept_by_worker(self.key, lambda: Codec(*self.parts.value))


def encode_texts(docs: DataFrame, shared: SharedCodec) -> DataFrame:
    """``doc_id, ids``: token ids of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.get()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [codec.encode(x.as_py() or "") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))],
                                                 names=["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, shared: SharedCodec) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.get()
        for batch in batches:
            texts = [codec.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoded(docs: DataFrame, path: str, **how) -> DataFrame:
    """Encode and decode every whole text in one pass: ``doc_id, ids, decoded,
    decodes``, the last true where the decoded text equals the text (null is empty)."""
    shared = SharedCodec(docs, path, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.get()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [x.as_py() or "" for x in part.column(1)]
                ids = [codec.encode(t) for t in texts]
                back = [codec.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string()),
                     pa.array([a == b for a, b in zip(texts, back)], pa.bool_())],
                    names=["doc_id", "ids", "decoded", "decodes"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids array<int>, decoded string, decodes boolean")


def with_digests(rows: DataFrame) -> DataFrame:
    """``rows`` of ``encoded`` plus ``n_tokens, ids_sha256, decoded_sha256``."""
    return rows.select("*", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def bpe_codec(docs: DataFrame, path: str, **how) -> DataFrame:
    """Digests of the ids and decoded texts of ``encoded``:
    ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return with_digests(encoded(docs, path, **how)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def tokenised(docs: DataFrame, path: str, **how) -> DataFrame:
    """The tokenised corpus: ``doc_id, ids, decodes, n_tokens, ids_sha256, decoded_sha256``."""
    return with_digests(encoded(docs, path, **how)).drop("decoded")
