import hashlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from histoloom.llm import prefixhash
from histoloom.llm.prefixhash import PrefixHash, fingerprint, likeness, parse

TEXT = st.text(st.sampled_from("ab\U0001f600"), max_size=60)


@settings(deadline=None, max_examples=150)
@given(TEXT, TEXT, st.data())
def test_spans_and_extensions(x, y, data):
    a, b = data.draw(st.integers(0, len(x))), data.draw(st.integers(0, len(y)))
    n = data.draw(st.integers(0, 10))
    p, q = PrefixHash(x), PrefixHash(y)
    assert p.same(a, q, b, n) == (x[a : a + n] == y[b : b + n] and a + n <= len(x) and b + n <= len(y))
    common = 0
    while a + common < len(x) and b + common < len(y) and x[a + common] == y[b + common]:
        common += 1
    assert p.common_extension(a, q, b) == common


@settings(deadline=None, max_examples=100)
@given(st.text(max_size=900), st.text(max_size=900))
def test_likeness(x, y):
    a, b = (parse(fingerprint(PrefixHash(t))) for t in (x, y))
    assert likeness(a, b) == likeness(b, a)
    assert (likeness(a, b) == 1) == (x == y)
    both = parse(fingerprint(PrefixHash(x + y)))
    if x or y:
        step = 1 << max(a[1], both[1])
        assert likeness(a, both) >= (len(x) - step) / len(x + y)


def test_compare(spark, docs, cases, no_docs):
    ordered = sorted(cases, key=lambda c: (c[0] is None, -(c[0] or 0), (c[1] or "").encode()))
    want = Counter()
    for i, c in enumerate(ordered):
        x, y = c[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(x) // 3
        edited = x[: len(x) - cut] + y[:cut]
        marks = [fingerprint(PrefixHash(t)) for t in (x, edited, y)]
        parsed = [parse(m) for m in marks]
        want[c[0], len(x), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], likeness(parsed[0], parsed[1]), likeness(parsed[0], parsed[2])] += 1
    for rows in (4_000, 5, 1):
        assert Counter(map(tuple, prefixhash.compare(docs, rows).collect())) == want
    assert prefixhash.compare(no_docs).count() == 0
    one = docs.where("doc_id = 3")
    assert prefixhash.compare(one).first().near_next == 1.0
    assert prefixhash.compare(docs.where("doc_id is null")).count() == 1
