"""Crowds of texts that share shingles but are no near copies: they cost no comparison of sets, and no link is lost."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from trafficward.llm import graph, simhash


def shingles(text: str) -> set:
    words = text.lower().split()
    return set(zip(*[words[i:] for i in range(5)]))


def test_marks_bound_the_difference():
    random.seed(3)
    for shared, one, two in ((200, 20, 0), (60, 0, 0), (10, 700, 650), (3000, 90, 120)):
        common = [random.getrandbits(64) for _ in range(shared)]
        sets = [common + [random.getrandbits(64) for _ in range(k)] for k in (one, two)]
        values = np.array(sets[0] + sets[1], np.uint64)
        owner = np.repeat([0, 1], [len(sets[0]), len(sets[1])])
        marks = simhash._marks(values, owner, 2)
        differ = sum(int(x).bit_count() for x in (marks[0] ^ marks[1]).view(np.uint64))
        assert marks.shape == (2, simhash.MARKS) and differ <= one + two
        assert bool(differ) == bool(one + two)


def test_crowds_cost_no_comparisons_of_unlike_texts(spark, monkeypatch):
    """Texts of two out of twelve lines share crowded shingles; only the planted near copies are alike."""
    random.seed(5)
    line = lambda: " ".join(f"w{random.randrange(10**9)}" for _ in range(30))
    lines = [line() for _ in range(12)]
    texts = [f"{a} {b}" for a, b in itertools.combinations(lines, 2)]
    texts += [f"{t} end{i}" for i, t in enumerate(texts[:10])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = simhash._signatures(df.select(F.xxhash64("text").alias("tag"), F.col("doc_id").alias("key"), "text"), 5).localCheckpoint()
    compared, alike = [], simhash._alike

    def counted(pairs, sets):
        compared.append(pairs.count())
        return alike(pairs, sets)

    monkeypatch.setattr(simhash, "_alike", counted)
    roots = graph.components(simhash.similar_links(nodes, crowd=4))
    name = {r.tag: r.least for r in nodes.collect()}
    groups = {}
    for r in roots.collect():
        groups.setdefault(r.root, set()).add(name[r.node])
    sets = [shingles(t) for t in texts]
    pairs = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert pairs == {(i, 66 + i) for i in range(10)}
    assert sorted(map(sorted, groups.values())) == sorted(map(list, pairs))
    assert sum(compared) <= 4 * len(pairs)


def test_near_copies_of_a_crowd_are_linked_without_pairing_all(spark):
    """Groups of near copies: their kinds link them with pairs in proportion to the texts, not to the square of a group."""
    random.seed(11)
    draw = lambda k: [random.getrandbits(64) for _ in range(k)]
    rows, size = [], 60
    for g in range(4):
        common = draw(200)
        rows += [(g * size + i, np.array(sorted(common + draw(8)), np.uint64).tobytes()) for i in range(size)]
    sets = spark.createDataFrame([(t, bytearray(s)) for t, s in rows], "tag long, shingles binary")
    links = simhash._kin(sets)
    assert links.count() <= 2 * 16 * len(rows) / 4
    roots = {r.node: r.root for r in graph.components(links).collect()}
    assert [roots.get(t) for t, _ in rows] == [t // size * size for t, _ in rows]


def test_shingles_of_the_same_texts_are_joined_once(spark):
    rows = [(token, tag) for token in range(10) for tag in range(5)] + [(token, tag) for token in (20, 21) for tag in range(3)] + [(30, 1), (30, 7)]
    merged = simhash._merged(spark.createDataFrame(rows, "token long, tag long")).collect()
    assert sorted({(r.token, r.times) for r in merged}) == [(0, 10), (20, 2), (30, 1)]
    held = {}
    for r in merged:
        held[r.tag] = held.get(r.tag, 0) + r.times
    assert held == {tag: sum(t == tag for _, t in rows) for tag in {t for _, t in rows}}
