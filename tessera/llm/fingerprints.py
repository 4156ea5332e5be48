"""Document fingerprints from prefix polynomial hashes.

For code points s the prefix array is S[i] = sum of s[k] * B^k for k < i, mod
2^31 - 1, with two bases.  The hash of any span, brought to the origin by a power
of the inverse of B, follows from two entries; so span equality costs O(1) and
longest common extensions a binary search.  A fingerprint is the hash of the whole
text and the smallest hashes of all its 24-character spans (a bottom sketch, whose
overlap estimates how much two texts share).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_schema, batch, docs_view, struct_of

P31 = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
SPAN, SKETCH = 24, 48
_P = np.uint64(P31)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1 for any 64-bit x, by folding; stays below the modulus."""
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    return np.where(x >= _P, x - _P, x)


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, P31))
        m = min(done, n - done)
        out[done : done + m] = _mod(out[:m] * step)
        done += m
    return out


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0.. and B^-0.., at least n of each; grown by doubling and kept."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        base = BASES[which]
        have = _POWERS[which] = (_power_table(base, size), _power_table(pow(base, P31 - 2, P31), size))
    return have


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.sums = []
        for which in (0, 1):
            terms = _mod((codes.astype(np.uint64) + np.uint64(1)) * powers(which, self.n + 1)[0][: self.n])
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(_mod(sums))

    @classmethod
    def of(cls, text: str) -> "PrefixHash":
        return cls(codes_of(text))

    def span(self, start: int, stop: int) -> tuple[int, int]:
        """Hash of characters [start, stop); equal spans have equal hashes."""
        out = []
        for which in (0, 1):
            s = self.sums[which]
            out.append((int(s[stop]) - int(s[start])) * int(powers(which, self.n + 1)[1][start]) % P31)
        return out[0], out[1]

    def equal(self, start: int, other: "PrefixHash", at: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(at, at + length)

    def extension(self, start: int, other: "PrefixHash", at: int) -> int:
        """Length of the longest common extension of the suffixes from two places."""
        lo, hi = 0, min(self.n - start, other.n - at)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.equal(start, other, at, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def whole(self) -> str:
        """Hex of the whole text's length and hash: 8 digits each part."""
        a, b = self.span(0, self.n)
        return f"{self.n:08x}{a:08x}{b:08x}"

    def windows(self, width: int = SPAN, which: int = 0) -> np.ndarray:
        """Hashes of all spans of ``width`` characters (of the whole text, if shorter)."""
        width = min(width, self.n)
        if width == 0:
            return np.zeros(0, dtype=np.uint64)
        s = self.sums[which]
        diff = s[width:] + _P - s[:-width]
        return _mod(_mod(diff) * powers(which, self.n + 1)[1][: self.n - width + 1])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads hashes over 32 bits, so that the smallest are a fair sample."""
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)


def sketch(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The ``size`` smallest distinct mixed hashes."""
    h = _mixed(hashes)
    if len(h) > 16 * size:
        few = h[h < np.uint64(min((1 << 32) - 1, int((1 << 32) * 6 * size / len(h))))]
        few = np.unique(few)
        if len(few) >= size:
            return few[:size]
    return np.unique(h)[:size]


def fingerprint(prefix: PrefixHash, smallest: np.ndarray) -> str:
    return prefix.whole() + "".join(f"{int(x):08x}" for x in smallest)


def likeness(a: str, b: str) -> float:
    """Estimated share (0 to 1) of common spans of two fingerprinted texts: among the
    smallest hashes of both sketches together, those that both have.  Equal
    fingerprints give 1; an empty text is like an empty text only."""
    if a == b:
        return 1.0
    x, y = ({f[i : i + 8] for i in range(24, len(f), 8)} for f in (a, b))
    if not x or not y:
        return 0.0
    both = sorted(x | y)[: SKETCH if max(len(x), len(y)) >= SKETCH else len(x | y)]
    return sum(h in x and h in y for h in both) / len(both)


_OUT = struct_of(
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix_edited bigint, common_prefix_next bigint"
)


#: Buckets follow the table's bytes up to this many, which bounds what the driver and each
#: task know of them (a place and a number each); beyond, buckets grow, and tasks read them as streams.
MOST_BUCKETS = 16_384
_PLACE = np.dtype([("none", "<i8"), ("down", "<i8"), ("tie", "<i8")])


def _places(ids: np.ndarray, null: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Places in the order, smaller first: null ids last, larger ids first, then the tie."""
    out = np.zeros(len(ids), dtype=_PLACE)
    out["none"], out["down"], out["tie"] = null, np.where(null, 0, ~ids), ties
    return out


def _cuts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Places of rows that begin buckets, the first row of all among them.

    They are drawn from rows whose hash falls below a bound that leaves about 16 a bucket;
    each is a row's own place, so a bucket's first row is known before any is moved."""
    named = rows.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")
    n = rows.count()
    bound = min(1.0, 16 * buckets / max(1, n)) * (1 << 30)
    drawn = named.where(F.pmod(F.xxhash64("tie", "id", F.lit(3)), F.lit(1 << 30)) < int(bound)).distinct() if buckets > 1 else named.limit(0)
    top = named.orderBy("none", F.desc("id"), "tie").limit(1)
    got = [(r["none"], r["id"], r["tie"]) for r in drawn.union(top).collect()]
    none, ids, ties = (np.array(c, dtype=k) for c, k in zip(zip(*got), (bool, np.int64, np.int64))) if got else (np.zeros(0, dtype=k) for k in (bool, np.int64, np.int64))
    places = np.unique(_places(ids, none, ties))
    at = np.unique(np.linspace(0, len(places), buckets, endpoint=False).astype(np.int64)) if len(places) else []
    return places[at]


def _followers(docs: DataFrame, group_bytes: int = 8 << 20) -> DataFrame:
    """Each document together with the next in descending doc_id order: rows of b, role,
    doc_id, text (packed), n; a bucket b holds neighbouring documents and, last, a copy of
    the next bucket's first (role 1).

    Buckets are ranges of (doc_id, hash of the text), so ids that many rows share, or that
    are null, do not meet in one task.  Rows equal in both are counted (n) before they are
    moved, batch by batch.  One shuffle of compressed texts does it; only a bucket's first
    document travels twice."""
    rows = docs_view(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cuts = _cuts(rows.select("doc_id", "tie"), max(1, min(int(size // group_bytes), MOST_BUCKETS)))
    packed = struct_of("b bigint, role int, doc_id bigint, tie bigint, text binary, n bigint")
    schema = arrow_schema(packed)

    def shrink(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            if not b.num_rows:
                continue
            null, ties = np.asarray(pa.compute.is_null(b.column(0))), np.asarray(b.column(2))
            places = _places(np.asarray(pa.compute.fill_null(b.column(0), 0)), null, ties)
            _, first, n = np.unique(places, return_index=True, return_counts=True)
            bucket = np.searchsorted(cuts, places[first], side="right") - 1
            texts = [t.as_buffer() for t in b.column(1).take(pa.array(first))]
            texts = [z.compress(t) if len(t) else b"" for t in texts]
            ahead = np.flatnonzero(cuts[bucket] == places[first])  # these begin a bucket: the one before reads them too
            rows = np.concatenate((np.arange(len(first)), ahead))
            to = np.concatenate((bucket, (bucket[ahead] - 1) % len(cuts)))
            role = np.concatenate((np.zeros(len(first)), np.ones(len(ahead)))).astype(np.int32)
            yield batch(schema, [to, role, b.column(0).take(pa.array(first[rows])), ties[first][rows], pa.array([texts[i] for i in rows.tolist()], pa.binary()), np.where(role == 1, 1, n[rows])])

    small = rows.mapInArrow(shrink, packed)
    order = [F.col("b"), F.col("role"), F.col("doc_id").desc_nulls_last(), F.col("tie").asc()]
    return small.repartitionById(max(1, len(cuts)), F.col("b").cast("int")).sortWithinPartitions(*order).select("b", "role", "doc_id", "text", "n")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts (null: empty) and of edited texts, in which the
    last half (rounded down) gives way to as much of the start of the next document.

    The next is that of the next smaller doc_id (ties by the text's hash; null ids
    come last); after the last comes the first.  A table's only document follows
    itself; an empty table gives no rows; repeated rows follow each other; extra
    columns are ignored; a very long text is held whole, one at a time with the one
    before.  common_prefix_* are longest common prefixes in characters, found by binary
    search over the prefix arrays.
    """
    counted = struct_of(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _OUT.fields) + ", n bigint")
    schema = arrow_schema(counted)

    def run(batches):
        z = zstandard.ZstdDecompressor()
        held = None  # bucket, doc_id, text, its prefix hash and print, rows like it

        def row(prev, text, own, mark, n):
            _, doc, old, prefix, old_mark, _ = prev
            half = prefix.n // 2
            edited = old[: prefix.n - half] + text[:half]
            e = PrefixHash.of(edited)
            e_mark = fingerprint(e, sketch(e.windows()))
            return (doc, prefix.n, hashlib.sha256(edited.encode()).hexdigest(), old_mark, e_mark, likeness(old_mark, e_mark), likeness(old_mark, mark), prefix.extension(0, e, 0), prefix.extension(0, own, 0), n)

        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for bucket, role, doc, raw, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist()):
                raw = raw.as_buffer()
                text = z.decompress(raw).decode() if len(raw) else ""
                own = PrefixHash.of(text)
                mark = fingerprint(own, sketch(own.windows()))
                found = []
                if held and held[0] == bucket:
                    found.append(row(held, text, own, mark, 1))
                if n > 1 and not role:  # all but the last of equal rows follow themselves
                    found.append(row((bucket, doc, text, own, mark, n), text, own, mark, n - 1))
                for r in found:
                    for c, v in zip(cols, r):
                        c.append(v)
                held = None if role else (bucket, doc, text, own, mark, n)
            yield batch(schema, cols)

    found = _followers(docs).mapInArrow(run, counted)
    # n is at most a batch's rows
    return found.select(*_OUT.names, F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("_")).drop("_")
