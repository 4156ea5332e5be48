"""N-gram language model in Elias-Fano tries.

Level 1 is the vocabulary: sorted 64-bit word hashes with their counts.  Level k
holds, for every node of level k - 1 (a (k-1)-gram, numbered in order), its
successors' word numbers as one Elias-Fano sequence of ``node * V + word``, monotone
pointers to where a node's successors begin, an 8-bit logarithm of each n-gram's
discounted share, and an 8-bit logarithm of what the node leaves to shorter
contexts.  N-grams seen fewer than ``min_count`` times are left out; their mass stays
with the shorter contexts:

    p_k(w | c) = max(count(c w) - D, 0) / count(c) + left(c) * p_{k-1}(w | shorter c)
    p_1(w) = (count(w) + 0.5) / (N + 0.5 * (V + 1))

A level is cut into shards by node; they are files in the shared folder, which the
tasks map into memory, so a model takes page cache but no heap.
"""

from __future__ import annotations

import mmap
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import elias_fano
from ._shared import arrow_schema, batch, docs_view, fresh_path, persist, struct_of, text_slices, write_blobs
from .elias_fano import EliasFano

END = b"\n"  # the end token's key; no word holds white space
DISCOUNT = 0.75
#: 8-bit code q stands for 10 ** -(q / steps); 255 for nothing.  A level has STEPS steps a
#: decade, or as many as its smallest share leaves.
STEPS = 40.0
SHARD_ENTRIES = 500_000
#: Words whose numbers a process remembers.
MOST_CACHED = 250_000
#: Different n-grams that a task counts before it hands them on.
PAIRS_HELD = 1_000_000
#: Bytes of text that a task looks up together.
SLICE = 3 << 20
_BLOB = struct_of("blob binary")
#: Slots of each level's table of latest searches.
_SLOTS, _MIX = 1 << 20, 0x9E3779B97F4A7C15 - (1 << 64)
_MAPS: dict[str, mmap.mmap] = {}


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case."""
    return (text or "").encode().lower().split()


def _split(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The texts' words as ``words_of`` gives them, one text after another, and how many
    each has; different words are told apart in Arrow, and Python meets each once."""
    column = pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string()))
    pieces = pc.ascii_split_whitespace(column)
    words = pieces.flatten()
    some = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty word
    before = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    return words.filter(some).cast(pa.large_binary()).dictionary_encode(), np.diff(before[np.asarray(pieces.offsets)])


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _steps(most: int) -> float:
    """Steps a decade of a level whose contexts are counted at most ``most`` times: code
    254 reaches DISCOUNT / most, below which no share and no rest lies."""
    return min(STEPS, 254 / float(np.log10(max(most, 2) / DISCOUNT)))


def _quantise(log10: np.ndarray, steps: float) -> np.ndarray:
    return np.clip(np.rint(-log10 * steps), 0, 254).astype(np.uint8)


@dataclass(frozen=True)
class Model:
    """What a task needs: counts, and the files of each level (level 1 first)."""

    n_tokens: int
    n_words: int
    files: tuple[tuple[str, ...], ...]
    widths: tuple[int, ...]  # nodes a shard; at level 1 the bits that a shard's hashes share
    steps: tuple[float, ...] = (STEPS,)  # of each level's codes; level 1 has none
    sizes: tuple[int, ...] = ()  # n-grams of levels 2 and on
    min_count: int = 1
    open: bool = False  # another level will follow: the last one keeps its counts

    def n_nodes(self, k: int) -> int:
        return self.n_words if k == 1 else self.sizes[k - 2]


def _map(uri: str) -> mmap.mmap:
    """The file's memory map.  A ``file:`` folder is shared as it is; files of other
    stores were handed to ``SparkContext.addFile`` and lie in the executor's folder."""
    if uri not in _MAPS:
        path = uri.removeprefix("file:") if uri.startswith("file:") else SparkFiles.get(uri.rpartition("/")[2])
        with open("/" + path.lstrip("/") if uri.startswith("file:") else path, "rb") as f:
            _MAPS[uri] = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return _MAPS[uri]


def _publish(spark: SparkSession, path: str) -> tuple[str, ...]:
    names = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # one a shard file
    for name in names:
        if not name.startswith("file:"):
            spark.sparkContext.addFile(name)
    return tuple(sorted(names))


def _blobs(uri: str):
    """(shard, map, offset of the payload) of the blobs in a file: 8 bytes of length, 8
    of shard, payload, newline."""
    data, at = _map(uri), 0
    while at < len(data):
        size, shard = struct.unpack_from("<QQ", data, at)
        yield shard, data, at + 16
        at += 16 + size + 1


def _blob(shard: int, payload: bytes) -> bytes:
    return struct.pack("<QQ", len(payload), shard) + payload


class Vocabulary:
    """Word hash -> number and count."""

    def __init__(self, model: Model):
        self.bits = model.widths[0]
        shards = sorted((s, d, o) for uri in model.files[0] for s, d, o in _blobs(uri))
        self.shards, at = {}, 0
        for shard, data, offset in shards:
            keys = EliasFano(data, offset)
            counts = np.frombuffer(data, dtype="<u8", count=keys.n, offset=keys.end)
            self.shards[shard] = (at, keys, counts)
            at += keys.n
        self.order = list(self.shards)
        self.bases = [self.shards[x][0] for x in self.order]
        self.cache: dict[bytes, int] = {}

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        ids = np.full(len(hashes), -1, dtype=np.int64)
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), dtype=np.int64)
        low = hashes & np.uint64((1 << (64 - self.bits)) - 1)
        for s, rows in _by_shard(shard):
            if s in self.shards:
                base, keys, _ = self.shards[s]
                at = keys.find(low[rows])
                ids[rows[at >= 0]] = at[at >= 0] + base
        return ids

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts."""
        cache = self.cache
        fresh = list(set(words).difference(cache))
        if len(cache) + len(fresh) > MOST_CACHED and cache:  # frequent words come back soon
            cache.clear()
            fresh = list(set(words))
        if fresh:
            hashes = _hashes(fresh)
            order = np.argsort(hashes)  # what lies together is read together
            ids = np.empty(len(fresh), dtype=np.int64)
            ids[order] = self._find(hashes[order])
            cache.update(zip(fresh, ids.tolist()))
        ids = np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words))
        return ids, self.counts_of(ids)

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), dtype=np.int64)
        known = np.flatnonzero(ids >= 0)
        for i, rows in _by_shard(np.searchsorted(self.bases, ids[known], side="right") - 1):
            base, _, counts = self.shards[self.order[i]]
            out[known[rows]] = counts[ids[known[rows]] - base].astype(np.int64)
        return out


class Level:
    """Successors of the nodes of the level above.

    A search begins at its context: the node's two pointers bound the places of its
    successors, and the word is searched between them.  Values, pointers and codes are
    read where the files are mapped; the heap holds a table of the latest searches."""

    def __init__(self, model: Model, k: int):
        self.width, self.v = model.widths[k - 1], model.n_words
        self.value = np.concatenate((10 ** (-np.arange(255) / model.steps[k - 1]), [0.0]))
        self.shards, self.bases, at = {}, [], 0
        for shard, data, offset in sorted((s, d, o) for uri in model.files[k - 1] for s, d, o in _blobs(uri)):
            values = EliasFano(data, offset)
            pointers = EliasFano(data, values.end)
            share = np.frombuffer(data, dtype=np.uint8, count=values.n, offset=pointers.end)
            left = np.frombuffer(data, dtype=np.uint8, count=pointers.n - 1, offset=pointers.end + values.n)
            counts = np.frombuffer(data, dtype="<u4", count=values.n, offset=pointers.end + values.n + len(left)) if k < len(model.files) or model.open else None
            self.shards[shard] = (at, values, pointers, share, left, counts)
            self.bases.append(at)
            at += values.n
        self.order = list(self.shards)  # of the bases
        # the latest searches by slot: context and word in one number, and what was found
        self.keys, self.at = np.full(_SLOTS, -1, dtype=np.int64), np.full(_SLOTS, -1, dtype=np.int64)
        self.codes = np.zeros((2, _SLOTS), dtype=np.uint8)
        self.fits = model.n_nodes(k - 1) * (self.v + 1) < 1 << 63

    def _search(self, nodes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each context and word (-1: none): the n-gram's number or -1, the code of its
        share and the code of what the context leaves (0: it has no successors)."""
        at, share, left = np.full(len(nodes), -1, dtype=np.int64), np.full(len(nodes), 255, dtype=np.uint8), np.zeros(len(nodes), dtype=np.uint8)
        for s, rows in _by_shard(nodes // self.width):
            if s not in self.shards:
                continue
            base, values, pointers, shares, lefts, _ = self.shards[s]
            local = nodes[rows] - s * self.width
            left[rows] = lefts[local]
            some = np.flatnonzero((left[rows] > 0) & (words[rows] >= 0))
            rows, local = rows[some], local[some]
            first, end = pointers.pair(local)
            i = values.find(local.astype(np.uint64) * np.uint64(self.v) + words[rows].astype(np.uint64), first.astype(np.int64), end.astype(np.int64))
            hit = np.flatnonzero(i >= 0)
            at[rows[hit]] = i[hit] + base
            share[rows[hit]] = shares[i[hit]]
        return at, share, left

    def lookup(self, nodes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each context node and word (-1: none): the n-gram's own node (-1: not
        kept), its discounted share, and what the context leaves to shorter ones."""
        node, share, left = np.full(len(nodes), -1, dtype=np.int64), np.zeros(len(nodes)), np.ones(len(nodes))
        rows = np.flatnonzero(nodes >= 0)
        n, w = nodes[rows], words[rows]
        if self.fits:
            keys = n * np.int64(self.v + 1) + w + 1
            slot = ((keys * np.int64(_MIX)) >> 44) & (_SLOTS - 1)
            at, codes = self.at[slot], self.codes[:, slot]
            miss = np.flatnonzero(self.keys[slot] != keys)
            # each search once, in the files' order
            miss = miss[np.argsort(keys[miss])]
            new = np.concatenate((np.ones(min(1, len(miss)), dtype=bool), np.diff(keys[miss]) != 0))
            first, same = miss[new], np.cumsum(new) - 1
            got = self._search(n[first], w[first])
            at[miss], codes[0, miss], codes[1, miss] = (x[same] for x in got)
            # of two in one slot the later stays, in all arrays
            self.keys[slot[first]], self.at[slot[first]], self.codes[0, slot[first]], self.codes[1, slot[first]] = keys[first], *got
        else:
            at, *codes = self._search(n, w)
        node[rows], share[rows], left[rows] = at, self.value[codes[0]], self.value[codes[1]]
        return node, share, left

    def successors(self, node: int) -> np.ndarray:
        """Word numbers that follow a node, by its pointers."""
        _, values, pointers, *_ = self.shards[node // self.width]
        local = node % self.width
        lo, hi = (int(x[0]) for x in pointers.pair(np.array([local])))
        return (values.access(np.arange(lo, hi)) - np.uint64(local * self.v)).astype(np.int64)

    def counts_of(self, nodes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(nodes), dtype=np.int64)
        for i, rows in _by_shard(np.searchsorted(self.bases, nodes, side="right") - 1):
            base, *_, counts = self.shards[self.order[i]]
            out[rows] = counts[nodes[rows] - base]
        return out


def _by_shard(shard: np.ndarray):
    """(shard, rows) of the shards that occur."""
    if not len(shard):
        return
    if shard.min() == shard.max():
        yield int(shard[0]), np.arange(len(shard))
        return
    order = np.argsort(shard, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) != 0)))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        yield int(shard[order[lo]]), order[lo:hi]


_OPEN: dict[tuple, list] = {}


def opened(model: Model) -> list:
    """[Vocabulary, Level 2, ...] of this process; levels that stay the same stay open."""
    key = (model.files, model.open)
    if _OPEN.get("key") != key:
        old = _OPEN.get("key")
        first = _OPEN["levels"][0] if old and old[0][0] == model.files[0] else Vocabulary(model)
        _OPEN["levels"] = [first, *[Level(model, k) for k in range(2, len(model.files) + 1)]]
        _OPEN["key"] = key
    return _OPEN["levels"]


def _unigrams(train: DataFrame) -> DataFrame:
    """h, c: counts of word hashes; a task adds up its words before they are dealt."""
    out = struct_of("h bigint, c bigint")
    schema = arrow_schema(out)

    def merged(held):
        h, c = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h)
        h = h[order]
        new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return batch(schema, [h[new].view(np.int64), np.add.reduceat(c[order], new)])

    def run(batches):
        held, size = [], 0
        for _, texts in text_slices(batches, SLICE):
            words, _ = _split(texts)
            names = [*words.dictionary.to_numpy(zero_copy_only=False).tolist(), END]
            counts = np.append(np.bincount(np.asarray(words.indices), minlength=len(names) - 1), len(texts))
            held.append((_hashes(names), counts.astype(np.int64)))
            size += len(names)
            if size > PAIRS_HELD:
                yield merged(held)
                held, size = [], 0
        if held:
            yield merged(held)

    return train.mapInArrow(run, out).groupBy("h").agg(F.sum("c").alias("c"))


def _write_vocabulary(words: DataFrame, n_words: int) -> tuple[str, int]:
    bits = max(0, (n_words // SHARD_ENTRIES).bit_length())
    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("bigint")
    schema = arrow_schema(_BLOB)

    def run(batches):
        for shard, cols in _groups(batches):
            order = np.argsort(cols[0].view(np.uint64))
            low = cols[0].view(np.uint64)[order] & np.uint64((1 << (64 - bits)) - 1)
            payload = elias_fano.encode(low, 1 << (64 - bits)) + cols[1][order].astype("<u8").tobytes()
            yield batch(schema, [[_blob(shard, payload)]])

    path = fresh_path(words.sparkSession, "lm-level1")
    rows = words.select(shard.alias("shard"), "h", "c").repartition(1 << bits, "shard").sortWithinPartitions("shard")
    write_blobs(rows.mapInArrow(run, _BLOB), "blob", path)
    return path, bits


def _groups(batches):
    """(shard, columns) of rows sorted by their first column; a shard's size is bounded."""
    held: list[list[np.ndarray]] = []
    now = None
    for b in batches:
        keys = np.asarray(b.column(0))
        if not len(keys):
            continue
        cols = [np.asarray(b.column(i)) for i in range(1, b.num_columns)]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        for lo, hi in zip(starts, [*starts[1:], len(keys)]):
            if held and keys[lo] != now:
                yield int(now), [np.concatenate(c) for c in zip(*held)]
                held = []
            now = keys[lo]
            held.append([c[lo:hi] for c in cols])
    if held:
        yield int(now), [np.concatenate(c) for c in zip(*held)]


def _nodes(levels: list, ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Node of the k-gram that ends at each token, for every level; ``first`` marks a
    document's start token, which no k-gram crosses."""
    out = [ids]
    for k, level in enumerate(levels[1:], 2):
        before = np.concatenate(([-1], out[-1][:-1]))
        before[first] = -1
        out.append(level.lookup(before, ids)[0])
    return out


def _sequence(vocabulary: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and counts of all texts' tokens with END before and after each; where each
    text starts; lengths (words and one end)."""
    words, n = _split(texts)
    names = [*words.dictionary.to_numpy(zero_copy_only=False).tolist(), END]
    ids, counts = vocabulary.lookup(names)
    lengths = n.astype(np.int64) + 1
    starts = np.cumsum(lengths + 1) - lengths - 1
    place = np.full(int((lengths + 1).sum()), len(names) - 1)
    body = np.ones(len(place), dtype=bool)
    body[starts] = body[starts + lengths] = False
    place[body] = np.asarray(words.indices)
    return ids[place], counts[place], starts, lengths


def _counted(node: np.ndarray, word: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs with their numbers (or the sums of ``c``), in order."""
    if len(node) and node.max() < 1 << 31 and word.max() < 1 << 32:
        keys = node << 32 | word
        order = np.argsort(keys, kind="stable") if c is not None else None  # merges sorted runs
        keys = keys[order] if c is not None else np.sort(keys)
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        node, word = keys[new] >> 32, keys[new] & 0xFFFFFFFF
    else:
        order = np.lexsort((word, node))
        node, word = node[order], word[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(node)), dtype=bool), (node[1:] != node[:-1]) | (word[1:] != word[:-1]))))
        keys, node, word = node, node[new], word[new]
    n = np.diff(np.concatenate((new, [len(keys)]))) if c is None else np.add.reduceat(c[order], new) if len(new) else new
    return node, word, n


def _ngrams(train: DataFrame, model: Model, k: int, min_count: int) -> DataFrame:
    """node, word, c: counts of k-grams whose (k-1)-gram prefix and suffix are kept,
    which leaves out none that reaches the least count."""
    out = struct_of("node bigint, word bigint, c bigint")
    schema = arrow_schema(out)

    def merged(held):
        return batch(schema, list(_counted(*(np.concatenate(x) for x in zip(*held)))))

    def run(batches):
        levels, held, size = opened(model), [], 0
        for _, texts in text_slices(batches, SLICE):
            if not texts:
                continue
            ids, counts, starts, _ = _sequence(levels[0], texts)
            first = np.zeros(len(ids), dtype=bool)
            first[starts] = True
            nodes = _nodes(levels[: k - 1], ids, first)
            at = np.flatnonzero(~first[1:]) + 1
            ok = (nodes[k - 2][at - 1] >= 0) & (counts[at] >= min_count) & (counts[at - 1] >= min_count)
            if k > 2:
                ok &= nodes[k - 2][at] >= 0
            at = at[ok]
            if len(at):
                held.append(_counted(nodes[k - 2][at - 1], ids[at]))
                size += len(held[-1][0])
            if size > PAIRS_HELD:
                yield merged(held)
                held, size = [], 0
        if held:
            yield merged(held)

    return train.mapInArrow(run, out).groupBy("node", "word").agg(F.sum("c").alias("c"))


def _write_level(kept: DataFrame, model: Model, k: int, n_nodes: int, n_kept: int, most: int, counted: bool) -> tuple[str, int]:
    n_shards = max(1, -(-n_kept // SHARD_ENTRIES))
    width = max(1, -(-n_nodes // n_shards))
    v, steps, least = model.n_words, _steps(most), DISCOUNT / max(most, 2)
    schema = arrow_schema(_BLOB)

    def run(batches):
        levels = opened(model)
        for shard, (node, word, c) in _groups(batches):
            order = np.lexsort((word, node))
            node, word, c = node[order], word[order], c[order]
            local, size = node - shard * width, min(width, n_nodes - shard * width)
            total = levels[k - 2].counts_of(node).astype(np.float64)
            share = (c - DISCOUNT) / total
            taken = np.bincount(local, weights=share, minlength=size)
            degree = np.bincount(local, minlength=size)
            # at least code 1 where there are successors: 0 says that there are none
            left = np.where(degree > 0, np.maximum(_quantise(np.log10(np.maximum(1 - taken, least)), steps), 1), 0).astype(np.uint8)
            ends = np.concatenate(([0], np.cumsum(degree)))
            values = local.astype(np.uint64) * np.uint64(v) + word.astype(np.uint64)
            payload = elias_fano.encode(values, size * v) + elias_fano.encode(ends, len(node) + 1) + _quantise(np.log10(share), steps).tobytes() + left.tobytes()
            if counted:  # the next level's shares are made of them
                payload += np.minimum(c, 2**32 - 1).astype("<u4").tobytes()
            yield batch(schema, [[_blob(shard, payload)]])

    path = fresh_path(kept.sparkSession, f"lm-level{k}")
    rows = kept.select(F.floor(F.col("node") / width).cast("bigint").alias("shard"), "node", "word", "c")
    write_blobs(rows.repartition(n_shards, "shard").sortWithinPartitions("shard").mapInArrow(run, _BLOB), "blob", path)
    return path, width


def train_model(docs: DataFrame, order: int = 2, min_count: int = 1) -> Model:
    """Counts the n-grams of all texts of ``docs`` (column text; null: empty) and
    writes the trie of orders 1 to ``order``.  N-grams counted fewer than ``min_count``
    times are left out of levels 2 and on; an empty table gives an empty model."""
    spark, train = docs.sparkSession, docs_view(docs, "text")
    words = persist(_unigrams(train).where("c > 0"), "lm-words")
    n_words, n_tokens, most = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    path, bits = _write_vocabulary(words, n_words)
    model = Model(n_tokens, n_words, (_publish(spark, path),), (bits,), min_count=min_count, open=order > 1)
    n_nodes = n_words
    for k in range(2, order + 1):
        kept = persist(_ngrams(train, model, k, min_count).where(F.col("c") >= min_count), f"lm-counts{k}")
        n_kept, most_kept = kept.agg(F.count("*"), F.coalesce(F.max("c"), F.lit(0))).first()
        path, width = _write_level(kept, model, k, n_nodes, n_kept, most, k < order)
        model = Model(n_tokens, n_words, (*model.files, _publish(spark, path)), (*model.widths, width), (*model.steps, _steps(most)), (*model.sizes, n_kept), min_count, k < order)
        n_nodes, most = n_kept, most_kept
    return model


_SCORE = struct_of("n_tokens bigint, n_known bigint, base_score double, score double")


def score_texts(model: Model, texts: list[str | None]) -> list[np.ndarray]:
    """n_tokens, n_known, base_score, score of each text."""
    levels = opened(model)
    ids, counts, starts, lengths = _sequence(levels[0], texts)
    first = np.zeros(len(ids), dtype=bool)
    first[starts] = True
    p = (counts + 0.5) / (model.n_tokens + 0.5 * (model.n_words + 1))
    base = np.log10(p)
    node, often = ids, np.where(counts >= model.min_count, ids, -1)  # a rarer word ends no kept n-gram
    for level in levels[1:]:
        before = np.concatenate(([-1], node[:-1]))
        before[first] = -1
        node, share, left = level.lookup(before, often)
        p = share + left * p
    own = np.log10(p)
    own[first] = base[first] = 0.0
    known = (counts > 0) & ~first
    return [lengths, np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(own, starts)]


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` with n_tokens (words and the end), n_known (of those, seen
    in training), base_score (unigrams) and score (the model), both log10, of each text.

    Null and empty texts are the end alone; repeated rows give repeated rows; an empty
    table gives none; other columns are ignored; a very long text is scored whole, in a
    slice of its own."""
    keep = tuple(c for c in keep if c not in _SCORE.names)  # the results replace them
    out = T.StructType(docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields + _SCORE.fields)
    frame = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("text"))
    schema = arrow_schema(out)

    def run(batches):
        for rows, texts in text_slices(batches, SLICE):
            if texts:
                yield batch(schema, [*[rows.column(i) for i in range(len(keep))], *[pa.array(x) for x in score_texts(model, texts)]])

    return frame.mapInArrow(run, out)
