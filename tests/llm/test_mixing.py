import re
from collections import defaultdict

import pytest

from histoloom.llm import mixing


def shared_out(sizes, share, most):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    for _ in range(100):
        free = [s for s in order if target[s] < most * sizes[s]]
        if left < 1e-9 or not free:
            break
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in free:
            left += max(0.0, target[s] - most * sizes[s])
            target[s] = min(target[s], most * sizes[s])
    return target


def test_mix(docs, cases, no_docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(cases)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_id = {(c[0], c[1]): size(c[1]) for c in cases}
    totals, taken, least, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for c in cases:
        totals[c[3]] += size(c[1])
    want = shared_out(totals, 1.5, 2.0)
    for r in rows:
        assert r["size"] == by_id[r.doc_id, r.text] and r.source_size == totals[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken % max(1, r["size"]) == 0 and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        if r["size"]:
            least[r.source] = min(least.get(r.source, 1 << 60), r["size"])
            most[r.source] = max(most[r.source], r["size"])
    for s, t in want.items():
        # Two rows of one doc_id turn together, so twice the smallest size; a
        # document of most of its source's words can only be taken whole.
        whole = most[s] / 2 if most[s] > totals[s] / 2 else 0
        assert abs(taken[s] - t) <= max(2 * least.get(s, 0), 0.02 * t, whole)
    assert sorted((str(r.doc_id), r.taken) for r in rows) == sorted((str(r.doc_id), r.taken) for r in mixing.mix(docs.repartition(5)).collect())
    assert mixing.mix(no_docs).count() == 0


def test_tilts_solve_the_dual(spark, docs):
    cells = spark.createDataFrame([(0, n, 3) for n in range(1, 200, 7)] + [(1, 5, 10), (1, 900, 1)], "sid long, size long, n long")
    total = {0: sum(3 * n for n in range(1, 200, 7)), 1: 950}
    for share in (0.1, 0.5, 1.0, 1.4, 1.99, 2.0):
        sources = spark.createDataFrame([(s, t, share * t) for s, t in total.items()], "sid long, source_size long, target double")
        got = {r.sid: r for r in mixing.tilts(cells, sources, 2.0).collect()}
        from math import exp

        for s in total:
            f = sum(r.n * r["size"] * min(2.0, exp(min(20.0, got[s].tilt * r["size"] / got[s].longest))) for r in cells.collect() if r.sid == s)
            assert f == pytest.approx(share * total[s], rel=1e-5)


def test_copies_are_whole_rows(docs):
    plain = {(r.doc_id, r.text): r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed_copies(docs)
    assert out.columns == docs.columns
    assert {r["size"] for r in out.collect()} == {"clash"}
    assert out.where("doc_id = 16").count() == next(v for k, v in plain.items() if k[0] == 16)


def test_rows_without_ids_meet_their_targets(spark):
    rows = [(None if i % 3 else 5, " ".join(["w"] * (5 + i % 40)) + f" t{i}", "s" if i % 2 else None) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 6 for r in got)


def test_flips_take_what_fits(spark):
    rows = [(i, 0, size, 1) for i, size in enumerate([1000] + [7] * 500 + [3] * 500)]
    frame = spark.createDataFrame(rows, "mark long, sid long, size long, copies long")
    for target in (6000, 6703, 5290, 2, 0, 11_111):
        got = mixing.flips(frame, spark.createDataFrame([(0, float(target))], "sid long, target double"), 2.0)
        cells = {(r["size"], r.copies): r for r in got.collect()}
        unit = frame.select("mark", "size", "copies", mixing._unit(frame.mark, 2).alias("unit")).collect()
        taken = sum(r["size"] * (r.copies + (cells[r["size"], r.copies].sign if (r["size"], r.copies) in cells and r.unit <= cells[r["size"], r.copies].until else 0)) for r in unit)
        assert abs(taken - target) < 3


def test_intermediate_tables_go(spark, docs):
    import os

    from histoloom.llm import shared

    top = f"{shared.shared_dir(spark)}/histoloom".removeprefix("file://")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    mixing.mix(docs)
    left = {x.rpartition("-")[0] for x in set(os.listdir(top)) - before}
    assert left <= {"known", "flips"}
