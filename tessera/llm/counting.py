"""Token counts that follow edits.

A document keeps a segment tree over its pre-token pieces (space-separated, since
the tokenizer drops white space): leaves hold blocks of pieces with their token
counts, inner nodes hold sums.  An edit re-encodes the blocks that it touches,
with the rest of the words cut at its edges, and adds the difference along the
path to the root; everything else keeps its counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ._shared import arrow_schema, batch, docs_view, struct_of, text_slices
from .tokens import WordEncoder


#: A leaf takes up to so many blocks before leaves are made anew.
LEAF_GROWTH = 4


class TokenTree:
    """Token counts of a text under edits.  ``leaf_chars``: a leaf's usual length.

    Leaves keep their number while an edit leaves at most ``LEAF_GROWTH`` blocks to each
    that it touches (one that lost its text is empty); the tree is made again, from counts
    that are known, only after an insertion of more than that."""

    def __init__(self, text: str, encoder: WordEncoder, leaf_chars: int = 512):
        self.encoder, self.leaf_chars = encoder, leaf_chars
        self.encoded_chars = 0
        self.blocks = self._split(text)
        self.counts = [self._count(b) for b in self.blocks]
        self._build()

    def _split(self, text: str) -> list[str]:
        """Blocks that end just after a space or newline, so no word crosses them."""
        if not self.encoder.word_wise:
            return [text]
        out, at = [], 0
        while len(text) - at > self.leaf_chars:
            cuts = [p for p in (text.find(" ", at + self.leaf_chars), text.find("\n", at + self.leaf_chars)) if p >= 0]
            if not cuts:
                break
            out.append(text[at : min(cuts) + 1])
            at = min(cuts) + 1
        return [*out, text[at:]]

    def _count(self, block: str) -> int:
        self.encoded_chars += len(block)
        return sum(map(len, self.encoder.encode_pieces(self.encoder.pieces(block)))) // self.encoder.dtype.itemsize

    def _build(self) -> None:
        """Sums over a power of two of leaves: node i has children 2i and 2i + 1."""
        size = 1
        while size < len(self.blocks):
            size *= 2
        self.size = size
        self.sums = [0] * size + self.counts + [0] * (size - len(self.counts))
        self.chars = [0] * size + [len(b) for b in self.blocks] + [0] * (size - len(self.blocks))
        for i in range(size - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.blocks)

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """Leaf that holds a character (the last, at the text's end), and its start."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if char >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def tokens_before_leaf(self, leaf: int) -> int:
        """Tokens of all leaves before one, from the sums on its path."""
        node, total = leaf + self.size, 0
        while node > 1:
            if node & 1:
                total += self.sums[node - 1]
            node //= 2
        return total

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace characters [start, stop) by ``new``; returns the new total.

        The touched leaves are joined with what they keep; if the last of them no
        longer ends at a word's end, the next leaf comes along."""
        start = min(max(start, 0), self.n_chars)
        stop = min(max(stop, start), self.n_chars)
        lo, lo_at = self._leaf_at(start)
        hi, hi_at = self._leaf_at(max(start, stop - 1))
        hi_end = hi_at + len(self.blocks[hi])
        joined = self.blocks[lo][: start - lo_at] + new + self.blocks[hi][stop - hi_at :] if hi_end >= stop else ""
        while joined and joined[-1] not in " \n" and hi + 1 < len(self.blocks):
            hi += 1
            joined += self.blocks[hi]
        fresh, room = self._split(joined), hi - lo + 1
        share = -(-len(fresh) // room)
        if share <= LEAF_GROWTH:  # the touched leaves take the new blocks between them; sums change on their paths alone
            for i in range(room):
                mine = fresh[i * share : (i + 1) * share]
                self._set(lo + i, "".join(mine), sum(map(self._count, mine)))
        else:  # much new text: new leaves, whose counts join those of the others
            self.blocks[lo : hi + 1] = fresh
            self.counts[lo : hi + 1] = map(self._count, fresh)
            self._build()
        return self.total

    def _set(self, leaf: int, block: str, count: int) -> None:
        self.blocks[leaf], self.counts[leaf] = block, count
        node, dt, dc = leaf + self.size, count - self.sums[leaf + self.size], len(block) - self.chars[leaf + self.size]
        while node:
            self.sums[node] += dt
            self.chars[node] += dc
            node //= 2


def edits_of(text: str) -> list[tuple[int, int, str]]:
    """The registered query's edits, each on the text that the one before left: a
    word put into the middle, the second tenth deleted, and the last 40 characters
    replaced by the first 40."""
    n = len(text)
    out = [(n // 2, n // 2, " inserted ")]
    n += 10
    lo, hi = n // 10, n // 5
    out.append((lo, hi, ""))
    n -= hi - lo
    out.append((max(0, n - 40), n, text[:40]))
    return out


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    for start, stop, new in edits:
        text = text[:start] + new + text[stop:]
    return text


_COUNTS = struct_of("doc_id bigint, n_chars bigint, n_tokens bigint, n_tokens_edited bigint, reencoded_chars bigint, n_leaves bigint")


def count_edits(docs: DataFrame, tokenizer: str, edits=edits_of, leaf_chars: int = 512) -> DataFrame:
    """Per document: doc_id, n_chars, n_tokens of the whole text, n_tokens_edited
    after ``edits(text)``, reencoded_chars that the edits cost, n_leaves.

    Null texts count as empty; an empty table gives no rows; repeated rows give a
    row each; a text without spaces is one leaf, and a very long one a tree of many;
    extra columns are ignored, whatever their names."""
    schema = arrow_schema(_COUNTS)

    def run(batches):
        enc = WordEncoder.open(tokenizer)
        for rows, texts in text_slices(batches):
            cols: list[list] = [[] for _ in range(5)]
            with enc.loaded(texts):
                for text in texts:
                    tree = TokenTree(text or "", enc, leaf_chars)
                    before, built, n = tree.total, tree.encoded_chars, tree.n_chars
                    for edit in edits(text or ""):
                        tree.edit(*edit)
                    for c, v in zip(cols, (n, before, tree.total, tree.encoded_chars - built, len(tree.blocks))):
                        c.append(v)
            yield batch(schema, [rows.column(0), *cols])

    return docs_view(docs, "doc_id", "text").mapInArrow(run, _COUNTS)
