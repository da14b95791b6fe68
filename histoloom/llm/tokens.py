"""Token ids of whole texts, by the ``tokenizers`` library.

:class:`WordMemo` encodes each distinct space-separated chunk once and reuses
its ids. For a vocabulary whose pre-tokenizer never joins characters across
white space (``word_bpe_49k.json``: NFC, white space to one space, lower case,
letter / digit / symbol runs) the ids of a text are exactly the ids of its
chunks in order, since no rule of NFC composes a character with a space before
it; ``tests/llm/test_tokens.py`` holds it against whole-text encoding. Pass
``memo=False`` for tokenizers for which that does not hold.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from histoloom.llm import memos

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: ASCII symbols but the apostrophe, which may begin a contraction.
_SYMBOL = r"[!-&(-/:-@\[-`{-~]"
#: Lower-case letters that no normalizing changes.
_LETTER = "[a-zß-öø-ÿ]"
#: What byte-level models call each byte: itself if it prints, else the next
#: character from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: chr(b) if b in _SHOWN else chr(256 + b - sum(x < b for x in _SHOWN)) for b in range(256)}
_open: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


class _Codes(dict):
    """Chunk to code; unknown chunks get the next code and are listed."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        code = self[chunk] = len(self)
        self.fresh.append(chunk)
        return code

    def of(self, chunks: pa.Array) -> np.ndarray:
        """Codes of chunks without nulls; numpy's strings take an eighth of the time of Arrow's list."""
        return np.fromiter(map(self.__getitem__, chunks.to_numpy(zero_copy_only=False)), np.int64, len(chunks))


class WordMemo:
    """Encodes texts to one flat id array with document lengths.

    ``limit`` bounds the chunks that are remembered (about 250 bytes each); beyond
    it, the rarer ones are forgotten. Only parts of unknown chunks that are
    unknown too are encoded.
    """

    def __init__(self, path: str, memo: bool = True, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo, self.limit = memo, limit
        # A special token keeps apart what stands before and after it, so many
        # chunks can be encoded at once with it between them.
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized}
        self.mark_id, self.mark = max(special.items(), default=(None, None))
        self.marks = tuple(special.values())
        self.codes = _Codes()
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.start, self.count, self.seen = (np.zeros(1 << 18, np.int32) for _ in range(3))

    def _forget(self) -> None:
        """Keeps the chunks that have come most often, half the limit at most."""
        seen, least = self.seen[: len(self.codes)], 1
        while (often := seen > least).sum() > self.limit // 2:
            least *= 2
        # In place, so that there are never two of them.
        for chunk in [chunk for chunk, keep in zip(self.codes, often.tolist(), strict=True) if not keep]:
            del self.codes[chunk]
        kept = list(self.codes)
        self.codes.update(zip(kept, range(len(kept)), strict=True))
        starts, counts = self.start[: len(often)][often], self.count[: len(often)][often]
        ids = self.ids[_spans(starts, counts)]
        self.used = len(ids)
        self.ids[: self.used] = ids
        self.start[: len(kept)], self.count[: len(kept)] = np.cumsum(counts) - counts, counts
        self.seen[:] = 0

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another, and each one's number."""
        encode = self.tokenizer.encode_batch_fast
        if self.mark and not any(m in x for x in chunks for m in self.marks):
            joint = f" {self.mark} "
            found = encode([joint.join(chunks[i : i + 500]) for i in range(0, len(chunks), 500)], add_special_tokens=False)
            flat = np.concatenate([np.array([*x.ids, self.mark_id], np.uint32) for x in found])
            ends = np.flatnonzero(flat == self.mark_id)
            return flat[flat != self.mark_id], np.diff(ends, prepend=-1) - 1
        found = [x.ids for x in encode(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces of plain lower-case letters or of ASCII symbols:
        normalizing and splitting leave them as they are, so the model's merges
        are all there is to do."""
        shown = [x if x.isascii() else x.encode().decode("latin-1").translate(_BYTES) for x in pieces]
        found = list(map(self.tokenizer.model.tokenize, shown))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((t.id for x in found for t in x), np.uint32, int(sizes.sum())), sizes

    def _room(self, ids: int, codes: int) -> None:
        while self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while codes > len(self.start):
            self.start, self.count, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.seen))

    def _parts(self, chunks: list[str]) -> pa.ListArray:
        """Each chunk's parts, that are pieces of their own wherever they stand.

        Case of ASCII letters does not matter, and a run of letters ends before
        and after every ASCII symbol but the apostrophe. Chunks that would hold a
        special token are one part, as are those where a mark may follow an I,
        whose dot then depends on the case.
        """
        given = pa.array(chunks, pa.string())
        lower = pc.ascii_lower(given)
        cut = pc.replace_substring_regex(pc.replace_substring_regex(lower, f"({_LETTER})({_SYMBOL})", r"\1 \2"), f"({_SYMBOL})({_LETTER})", r"\1 \2")
        cut = pc.if_else(pc.match_substring_regex(given, r"I[^\x00-\x7f]"), given, cut)
        for mark in self.marks:
            cut = pc.if_else(pc.match_substring(lower, mark), given, cut)
        return pc.split_pattern(cut, " ")

    def _learn(self, at: int) -> None:
        """Ids of the chunks whose codes begin at ``at``, put together from those
        of their parts, which may be known."""
        codes = self.codes
        fresh, codes.fresh = codes.fresh, []
        if not fresh:
            return
        lists = self._parts(fresh)
        merged = lists.flatten().dictionary_encode()
        parts = codes.of(merged.dictionary)[merged.indices.to_numpy(zero_copy_only=False)]
        added, codes.fresh = codes.fresh, []
        first = at + len(fresh)
        numbers = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(at, first), numbers)
        whole = np.zeros(len(fresh), bool)  # chunks that are their own only part
        whole[of[of == parts] - at] = True
        own = np.concatenate([np.flatnonzero(whole) + at, np.arange(first, first + len(added))])
        chunks = [fresh[c] for c in np.flatnonzero(whole).tolist()] + added
        self._room(0, first + len(added))
        simple = pc.match_substring_regex(pa.array(chunks, pa.string()), f"^(?:{_LETTER}+|{_SYMBOL}+)$").to_numpy(zero_copy_only=False)
        for encode, some in ((self._merged, np.flatnonzero(simple)), (self._encoded, np.flatnonzero(~simple))):
            for i in range(0, len(some), 20_000):
                few = some[i : i + 20_000]
                self._keep(own[few], *encode([chunks[c] for c in few.tolist()]))
        joint = ~whole[of - at]
        pieces = parts[joint]
        self.seen[: first + len(added)] += np.bincount(pieces, minlength=first + len(added))
        sizes = np.bincount(of[joint] - at, self.count[pieces], len(fresh)).astype(np.int64)
        self._keep(np.flatnonzero(~whole) + at, self.ids[_spans(self.start[pieces], self.count[pieces])], sizes[~whole])

    def _keep(self, codes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self._room(len(ids), 0)
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[codes] = self.used + np.cumsum(sizes) - sizes
        self.count[codes] = sizes
        self.used += len(ids)

    def encode(self, texts: Sequence[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and each text's number.

        Texts are split, and equal chunks merged, by Arrow; Python sees each
        distinct chunk of a call once. A null text counts as empty.
        """
        body = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.memo:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(body.to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes
        if len(self.codes) > self.limit:
            self._forget()
        known = len(self.codes)
        lists = pc.split_pattern(pc.replace_substring(body, "\n", " "), " ")
        merged = lists.flatten().dictionary_encode()
        codes = self.codes.of(merged.dictionary)
        self._learn(known)
        of = merged.indices.to_numpy(zero_copy_only=False)
        self.seen[codes] += np.bincount(of, minlength=len(codes))
        sizes = self.count[codes][of]
        stop = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
        out = self.ids[_spans(self.start[codes][of], sizes)], np.diff(stop[ends], prepend=0)
        del lists, merged
        pa.default_memory_pool().release_unused()
        return out


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each span, one span after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    out = np.arange(total, dtype=np.int32 if total < 1 << 31 else np.int64)
    out += np.repeat((starts - (ends - sizes)).astype(out.dtype), sizes)
    return out


def opened(path: str, memo: bool = True) -> WordMemo:
    """One per worker process; a reused worker keeps what it has learned."""
    memos.only("tokens")
    memos.remember("tokens", _open.clear)
    key = path, memo
    if key not in _open:
        _open[key] = WordMemo(path, memo)
    return _open[key]


def slices(lengths: Sequence[int], most: int = 3_000_000):
    """Ranges of consecutive texts of about ``most`` characters together."""
    first = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(lengths):
        yield first, len(lengths)


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with id ``end`` after each text; offsets have one more entry."""
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(offsets[-1]), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = ids
    return out, offsets


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
