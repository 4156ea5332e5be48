"""Exact token ids, fast: texts are encoded word by word through a bounded cache."""

from __future__ import annotations

import json
import re
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._shared import quiet_env

_PROBES = ("ab cd", "It's 12 o'clock\nnow", "x  y\n\nz ", "á b ́c", "(a) <|b|> c")
_OPEN: dict[str, "WordEncoder"] = {}


#: Stands between words that are encoded together; words whose ids hold its id too are encoded alone.
_BETWEEN, _TOGETHER = "~", 128
#: Different words whose parts are held together.
_AT_ONCE = 1 << 15

#: The normalizer and the split that ``_PART`` repeats for words of printable ASCII and Latin
#: letters, none of which composes with another or has a lower case elsewhere or of several
#: characters (U+0130 has one, and is left out; those from U+0180 on may have either).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ {_LETTERS}0-9]+| ")


class WordEncoder:
    """Encodes with a ``tokenizers`` file.

    A tokenizer that drops white space gives, for a text, the ids of its
    space-separated pieces one after another; then each distinct piece is encoded
    once and looked up afterwards.  Whether that holds is probed when the file is
    opened; otherwise whole texts are encoded.  Between batches the cache keeps
    pieces that came twice in a batch and have at most ``max_piece`` characters; it
    is emptied at ``limit`` pieces.  If the file splits words as ``_PART`` does, pieces
    of plain characters are put together from their parts (a word, the comma after it),
    which are far fewer and are kept in the same bounds; batches then need no other cache.
    """

    def __init__(self, path: str, limit: int = 200_000, max_piece: int = 48):
        quiet_env()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.limit, self.max_piece = limit, max_piece
        self.cache: dict[str, bytes] = {"": b""}
        self.word_wise = all(
            self._raw([p])[0] == b"".join(self._raw([w for w in p.replace("\n", " ").split(" ") if w])) for p in _PROBES
        )
        mark = np.frombuffer(self._raw([_BETWEEN])[0], dtype=self.dtype)
        self.mark = int(mark[0]) if self.word_wise and len(mark) == 1 else None
        # ids of parts; between pieces stands a number that is no id
        self.gap = int(np.iinfo(self.dtype).max)
        self.parts = {" ": np.array([self.gap], dtype=self.dtype).tobytes()}
        self.plain = self._plain() if self.mark is not None else None

    def _plain(self) -> np.ndarray | None:
        """Which code points a piece may have to be split by ``_PART``; None if the file splits
        otherwise.  Characters that begin an added token are not plain.  Opens ``quick``, the
        file's model without what ``_PART`` does, and ``ends``, the ids that end a part."""
        file = json.loads(self.tok.to_str())
        model, added, suffix = file["model"], file["added_tokens"], file["model"].get("end_of_word_suffix")
        if (file["normalizer"], file["pre_tokenizer"]) != (_NORMALIZER, {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}):
            return None
        if file["post_processor"] or model["type"] != "BPE" or not suffix or self.tok.get_vocab_size(with_added_tokens=True) > self.gap:
            return None
        self.ends = np.zeros(self.gap + 1 if self.dtype.itemsize == 2 else max(model["vocab"].values()) + 1, dtype=bool)
        self.ends[[i for w, i in model["vocab"].items() if w.endswith(suffix)]] = True
        file |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _BYTES]}}
        self.quick = type(self.tok).from_str(json.dumps(file))
        first = {t["content"][:1] for t in added}
        barred = {x for c in first for x in (c, c.lower(), c.upper())}
        return np.array([re.match(f"[ -~{_LETTERS}]", chr(c)) is not None and chr(c) not in barred for c in range(0x180)] + [False])

    @classmethod
    def open(cls, path: str) -> "WordEncoder":
        """One encoder a process and file, so that Python workers keep their cache."""
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def _raw(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _many(self, pieces: list[str]) -> list[bytes]:
        """Ids of many pieces without spaces."""
        if self.plain is None or not pieces:
            return self._marked(pieces)
        ids, ends, rest = self._spelled(pieces)
        raw, ends = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
        out = [raw[a:b] for a, b in zip(ends, ends[1:])]
        for i, x in zip(rest, self._marked([pieces[i] for i in rest])):
            out[i] = x
        return out

    def _spelled(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids of many pieces without spaces, one after another, by their parts; where each
        begins, and the end; the numbers of those that are not plain, which are left out."""
        codes = np.frombuffer(" ".join(pieces).encode("utf-32-le"), dtype="<u4")
        odd = np.flatnonzero(~self.plain[np.minimum(codes, len(self.plain) - 1)])
        rest = np.unique(np.searchsorted(np.flatnonzero(codes == 32), odd)).tolist()
        if rest:
            pieces = list(pieces)
            for i in rest:
                pieces[i] = ""
        known, flat = self.parts, _PART.findall(" ".join(pieces).lower())
        fresh = list(set(flat).difference(known))
        known.update(zip(fresh, self._parts(fresh)))
        ids = np.frombuffer(b"".join(map(known.__getitem__, flat)), dtype=self.dtype)
        for w in fresh:
            if len(w) > self.max_piece:
                del known[w]
        if len(known) > self.limit:
            self.parts = {" ": known[" "]}
        gaps = np.flatnonzero(ids == self.gap)
        ids = ids[ids != self.gap]
        return ids, np.concatenate(([0], gaps - np.arange(len(gaps)), [len(ids)])), rest

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of many parts, of which each ends with an id that ends a word."""
        out: list[bytes] = []
        groups = [parts[i : i + 2 * _TOGETHER] for i in range(0, len(parts), 2 * _TOGETHER)]
        for at in range(0, len(groups), 64):
            some = groups[at : at + 64]
            for group, e in zip(some, self.quick.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)):
                ids = np.array(e.ids, dtype=self.dtype)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(group):
                    raise ValueError("a part of a word does not end where its ids do")
                raw, last = ids.tobytes(), 0
                for c in (cuts * self.dtype.itemsize).tolist():
                    out.append(raw[last:c])
                    last = c
        return out

    def _marked(self, pieces: list[str]) -> list[bytes]:
        """Ids of many pieces without spaces, encoded by groups with a mark between."""
        if self.mark is None:
            return self._raw(pieces)
        out: list[bytes] = []
        groups = [pieces[i : i + _TOGETHER] for i in range(0, len(pieces), _TOGETHER)]
        between = f" {_BETWEEN} "
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            for group, e in zip(part, self.tok.encode_batch_fast([between.join(g) for g in part], add_special_tokens=False)):
                ids = np.array(e.ids, dtype=self.dtype)
                cuts = np.flatnonzero(ids == self.mark)
                if len(cuts) != len(group) - 1:
                    out += self._raw(group)
                    continue
                raw, size, last = ids.tobytes(), self.dtype.itemsize, 0
                for c in (cuts * size).tolist():
                    out.append(raw[last:c])
                    last = c + size
                out.append(raw[last:])
        return out

    def pieces(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ") if self.word_wise else [text]

    @contextmanager
    def loaded(self, texts: list[str | None]):
        """While open, all pieces of the texts are in the cache; gives their lists."""
        lists = [self.pieces(t or "") for t in texts]
        counts: Counter = Counter()
        for pieces in lists:
            counts.update(pieces)
        cache = self.cache
        fresh = [w for w in counts if w not in cache]
        cache.update(zip(fresh, self._many(fresh) if self.word_wise else self._raw(fresh)))
        try:
            yield lists
        finally:
            for w in fresh:
                if counts[w] == 1 or len(w) > self.max_piece:
                    del cache[w]
            if len(cache) > self.limit:
                cache.clear()
                cache[""] = b""

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as bytes of ``dtype``; those not in the cache are not kept."""
        cache = self.cache
        missing = [w for w in pieces if w not in cache]
        if not missing:
            return list(map(cache.__getitem__, pieces))
        new = dict(zip(missing, self._raw(missing)))
        return [new[w] if w in new else cache[w] for w in pieces]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null counts as empty."""
        return np.frombuffer(b"".join(self.encode_pieces(self.pieces(text or ""))), dtype=self.dtype)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """As ``encode`` of each text."""
        if self.plain is None:
            with self.loaded(texts) as lists:
                get = self.cache.__getitem__
                return [np.frombuffer(b"".join(map(get, pieces)), dtype=self.dtype) for pieces in lists]
        if not texts:
            return []
        column = pa.array([t or "" for t in texts], pa.large_string())
        pieces = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        words = pieces.flatten().dictionary_encode()
        size = self.dtype.itemsize
        tables, place = [], np.arange(len(words.dictionary))
        for at in range(0, len(place), _AT_ONCE):
            names = words.dictionary[at : at + _AT_ONCE].to_pylist()
            ids, ends, rest = self._spelled(names)
            place[at : at + _AT_ONCE] += sum(map(len, tables)) - at
            tables.append(pa.Array.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer((ends * size).astype("<i8")), pa.py_buffer(ids)]))
            if rest:
                place[at + np.array(rest)] = sum(map(len, tables)) + np.arange(len(rest))
                tables.append(pa.array(self._marked([names[i] for i in rest]), pa.large_binary()))
        table = pa.concat_arrays(tables)
        found = table.take(pa.array(place[np.asarray(words.indices)]))
        places = np.frombuffer(found.buffers()[1], dtype="<i8", count=len(found) + 1)[np.asarray(pieces.offsets)] // size
        flat = np.frombuffer(found.buffers()[2] or b"", dtype=self.dtype, count=int(places[-1]))
        return [flat[a:b] for a, b in zip(places.tolist(), places[1:].tolist())]
