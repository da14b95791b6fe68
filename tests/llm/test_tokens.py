import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from histoloom.llm import idfiles, packing, tokens


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_memo_is_whole_text_encoding(cases, whole):
    memo = tokens.WordMemo(tokens.default_path(), limit=200)
    for _ in range(3):
        for i in range(0, len(cases), 7):
            texts = [c[1] or "" for c in cases[i : i + 7]]
            ids, sizes = memo.encode(texts)
            assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == whole(texts[0])
            assert ids.tolist() == [x for t in texts for x in whole(t)]


MEMO = tokens.WordMemo(tokens.default_path())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_memo_on_any_text(whole, text):
    ids, sizes = MEMO.encode([text, "x " + text])
    assert ids.tolist() == whole(text) + whole("x " + text)


ODD = ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "a'", "é.", "(é", "é", "≠", "İ", "I\u0307", "\u0338", "Å", "K", " ", "\n", *"aAzZÉßøÜ'’.,-_|<>#d9½字!?\u00ad\u200d"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=14).map("".join))
def test_memo_on_cut_chunks(whole, text):
    ids, sizes = MEMO.encode([text, None, text.upper()])
    assert ids.tolist() == whole(text) + whole(text.upper()) and sizes[1] == 0


def test_codes_of_chunks():
    codes = tokens._Codes()
    chunks = ["a", "", "nul\x00", "\x00", "é", "e\u0301", "\U0001f600", "a" * 70_000]
    for given_ in (pa.array(chunks, pa.string()), pa.array(["no", *chunks], pa.string())[1:], pa.array(chunks, pa.string()).dictionary_encode().dictionary):
        assert codes.of(given_).tolist() == list(range(len(chunks)))
    assert codes.fresh == chunks == list(codes) and all(type(x) is str for x in codes)
    assert codes.of(pa.array(["é", "new", "a"], pa.string())).tolist() == [4, len(chunks), 0]
    assert codes.of(pa.array([], pa.string())).tolist() == []


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_variable_length_round_trip(values):
    control, data = idfiles.encode_ranks(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert idfiles.decode_ranks(control, data, len(values)).tolist() == values


def test_ranks_follow_frequency():
    block = idfiles.encode_block(np.array([7, 7, 7, 3, 3, 900], np.uint32))
    assert np.frombuffer(block["ranks"], "<u4").tolist() == [7, 3, 900]
    assert idfiles.decode_block(**block, n=6).tolist() == [7, 7, 7, 3, 3, 900]


def test_id_files(docs, cases, whole, no_docs):
    got = idfiles.through_files(docs, tokens.default_path(), 2).collect()
    order = sorted(cases, key=lambda c: (c[0] is not None, c[0] or 0, c[1] is not None, (c[1] or "").encode()))
    at, want = 0, []
    for c in order:
        ids = np.array([*whole(c[1]), 2], "<u4")
        want.append((c[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert Counter(map(tuple, got)) == Counter(want)
    assert idfiles.through_files(no_docs, tokens.default_path(), 2).count() == 0


def test_cut_lengths():
    for n in range(1, 5000):
        lengths = packing.cut_lengths(n, 2048)
        assert sum(lengths) == n and all(0 < x <= 2048 for x in lengths)


def test_packing(docs, cases, whole, no_docs):
    rows = packing.pack(docs, tokens.default_path(), 1, 256).collect()
    want = Counter()
    for c in cases:
        want[c[0], len(whole(c[1])) + 1] += len(whole(c[1])) + 1
    got = Counter()
    bins = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    padding = 0
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding < 0.02 * sum(want.values())
    by_doc = defaultdict(list)
    for r in rows:
        if r.doc_id == 16:
            by_doc[r.doc_id].append(r)
    text = next(c[1] for c in cases if c[0] == 16)
    ids = np.array([*whole(text), 1], "<u4")
    for r in by_doc[16]:
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack(no_docs, tokens.default_path(), 1).count() == 0
