"""Line dedup, collocations and centroid clustering against brute force on small fixtures."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from trafficward.llm import centroids, collocations, lines

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
BLANKS = " \t\n\x0b\x0c\r"
NATIVE_BREAKERS = ("Python", "Arrow", "Pandas")
# extra columns whose names the operators also use inside
LINE_SCHEMA = "doc_id long, text string, id string, tag string, pos string, gone string, lines string, its_id string"


def make_lines() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    common = ["The Same Footer Line", "  the same footer line\t", "THE SAME FOOTER LINE\r", "Éric ÉTAIT ici même", "éric était ici même", "short one", "exactly 10"]
    rows: list[tuple[int | None, str | None]] = [
        (5, None), (3, ""), (9, "\n"), (8, "\n\n"), (11, "one"), (None, "the same footer line\nno id"), (None, "another without id, long\nÉric ÉTAIT ici même"),
        (2, "twice in one text\nTwice in one text \nonce only in all"), (40, "a copy of this line\nand of that line"),
        (41, "a copy of this line\nand of that line"), (41, "a copy of this line\nand of that line"), (41, "of the same id, other text\na copy of this line"),
        (7, "x" * 50_000 + "\n" + "\n".join(f"line number {i % 97}" for i in range(3000))), (6, "\n".join(f"line number {i}" for i in range(60))),
    ]
    for i in range(100, 160):
        rows.append((i, "\n".join(rng.choice([*common, "", f"own line of {i}", f"shared by few {i % 9}"]) for _ in range(rng.randint(1, 12)))))
    return rows


def brute_lines(rows, min_documents, min_chars):
    order = lambda i: (i is not None, i or 0)
    holders = collections.defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    first = {k: min(v, key=order) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_documents}
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [line for line in all_lines if key(line) not in first or first[key(line)] == i]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("min_documents", [2, 4])
def test_kept_lines(spark, min_documents):
    rows = make_lines()
    df = spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], LINE_SCHEMA).repartition(3)
    got = [tuple(r) for r in lines.kept_lines(df, min_documents=min_documents).collect()]
    expected = brute_lines(rows, min_documents, 10)
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert any(r[2] for r in expected)
    digests = {(r.doc_id, r.kept_sha256) for r in lines.kept_digests(df, min_documents=min_documents).collect()}
    assert digests == {(r[0], hashlib.sha256(r[3].encode()).hexdigest()) for r in expected}
    left = lines.without_repeated_lines(df, min_documents=min_documents)
    assert left.columns == df.columns
    texts = collections.Counter((r.doc_id, r.text or "") for r in left.collect())
    assert texts == collections.Counter((r[0], r[3]) for r in expected)


def test_lines_of_a_hot_key_and_of_no_rows(spark):
    rows = [(i, f"The line of all texts\nown text of {i // 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_dropped) for r in lines.kept_lines(df).collect()}
    assert got == {(i, (i > 0) + (i % 3 > 0)) for i in range(3000)}
    nothing = spark.createDataFrame([], LINE_SCHEMA)
    assert lines.kept_digests(nothing).collect() == [] and lines.without_repeated_lines(nothing).collect() == []


def test_line_dedup_stays_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = lines.kept_digests(df)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in NATIVE_BREAKERS)


# ---------------------------------------------------------------- collocations

PIECE = re.compile(r"[.,;:!?\x0a-\x0d]")
WORD = re.compile(r"[^\x20\x09]+")


def brute_counts(rows, longest):
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(LOWER)):
            ws = WORD.findall(piece)
            if ws:
                totals[lang] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    counts[lang, " ".join(ws[i : i + m])] += 1
    return counts, totals


def brute_collocations(rows, longest, least, share, top):
    counts, totals = brute_counts(rows, longest)
    often = {k: v for k, v in counts.items() if v >= least}
    out = collections.defaultdict(list)
    for (lang, phrase), a in often.items():
        ws = phrase.split(" ")
        if len(ws) < 2:
            continue
        if any(l == lang and len(p) > len(phrase) and f" {phrase} " in f" {p} " and 100 * f >= share * a for (l, p), f in often.items()):
            continue
        n = totals[lang]
        score, _, l, r = min(
            (1000 * a * n // (counts[lang, " ".join(ws[:k])] * counts[lang, " ".join(ws[k:])]), k, counts[lang, " ".join(ws[:k])], counts[lang, " ".join(ws[k:])])
            for k in range(1, len(ws))
        )
        out[lang].append((-score, -a, phrase.encode(), phrase, a, l, r, n, score))
    return sorted((lang, rank, *row[3:]) for lang, found in out.items() for rank, row in enumerate(sorted(found)[:top], 1))


def make_prose() -> list[tuple[str | None, str | None]]:
    rng = random.Random(5)
    words = ["the", "of", "É", "New", "york", "ab c", "x\x1cy", "naïve", "中文", "to", "be", "or", "not"]
    rows: list[tuple[str | None, str | None]] = [(None, "en"), ("", "en"), (" \t\n.,;", None), ("lone", "zz"), ("a a a a a a a", "en")]
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 40)):
            kind = rng.random()
            if kind < 0.2:
                parts.append("New\tYork City Hall Of Records")
            elif kind < 0.3:
                parts.append("To be or not to be, that")
            else:
                parts.append(rng.choice(words) if kind < 0.9 else f"rare{rng.randint(0, 400)}")
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r"]))
        rows.append(("".join(parts), rng.choice(["en", "en", "fr", None])))
    rows.append((" ".join(rng.choice(words) for _ in range(4000)), "en"))
    rows += [rows[20]] * 30
    return rows


PROSE_SCHEMA = "text string, lang string, phrase string, words string, n string, f string, part string"


@pytest.mark.parametrize("longest,least,share,top", [(5, 6, 100, 40), (5, 25, 80, 2000), (3, 3, 100, 2000), (2, 10, 100, 5)])
def test_collocations(spark, longest, least, share, top):
    rows = make_prose()
    df = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], PROSE_SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, longest=longest, least=least, share=share, top=top).collect())
    expected = brute_collocations(rows, longest, least, share, top)
    assert got == expected and got


@pytest.mark.parametrize("bits", [14, 22])
def test_counts_are_exact_however_full_the_filter(spark, bits):
    rows = make_prose()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    phrases, totals = collocations.phrase_graph(df, least=4, bits=bits)
    counts, all_words = brute_counts(rows, 5)
    assert {(r.lang, r.phrase): r.f for r in phrases.collect()} == {k: v for k, v in counts.items() if v >= 4}
    assert {r.lang: r.n for r in totals.collect()} == dict(all_words)


def test_scores_are_exact_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("x", "a b", 2, 10**12 + 7), ("x", "a", 1, 10**13 + 1), ("x", "b", 1, 10**14 + 3)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("x", 10**16 + 9)], "lang string, n long")
    row = collocations.scored_phrases(phrases, totals, phrases.where("words = 2")).first()
    assert row.score == 1000 * (10**12 + 7) * (10**16 + 9) // ((10**13 + 1) * (10**14 + 3))


def test_collocations_of_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], PROSE_SCHEMA)).collect() == []
    blank = spark.createDataFrame([(None, None, *[None] * 5)], PROSE_SCHEMA)
    assert collocations.collocations(blank, least=1).collect() == []


# ---------------------------------------------------------------- centroids


def make_vectors(d: int):
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(5, d))
    rows = [(int(i), (middles[i % 5] + 0.3 * rng.normal(size=d)).round(3).tolist()) for i in range(180)]
    rows += [(7, rows[7][1]), (500, rows[7][1]), (501, rows[7][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(600, None), (601, []), (602, rows[0][1][:-1]), (603, rows[0][1] + [0.0]), (604, [None] + rows[0][1][1:])]
    rows += [(605, [math.nan] + rows[0][1][1:]), (606, [math.inf] + rows[0][1][1:]), (607, [-math.inf] * d)]
    return rows


def brute_clusters(rows, d, scale, k, rounds):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    middles = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((far(v, m), c) for c, m in enumerate(middles))[::-1] for _, v in kept]

    for _ in range(rounds):
        where = assign()
        for c in range(len(middles)):
            mine = [v for (_, v), (w, _) in zip(kept, where) if w == c]
            if mine:
                middles[c] = [sum(column) // len(mine) for column in zip(*mine)]
    where = assign()
    spread = collections.Counter()
    for c, dist in where:
        spread[c] += dist
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles]
    return [(i, c, dist, spread[c], sum(spread.values()), digest[c]) for (i, _), (c, dist) in zip(kept, where)]


@pytest.mark.parametrize("k,rounds", [(16, 3), (4, 0), (400, 2)])
def test_clusters(spark, k, rounds):
    d = 12
    rows = make_vectors(d)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<double>, v string, cluster string").repartition(3)
    got = [tuple(r) for r in centroids.clustered(df, dimensions=d, scale=64, k=k, rounds=rounds).collect()]
    assert sorted(got, key=repr) == sorted(brute_clusters(rows, d, 64, k, rounds), key=repr)


def test_looked_up_distances_are_squared_differences():
    rng = np.random.default_rng(2)
    v, c = rng.integers(-300, 300, (500, 7)).astype(np.int32), rng.integers(-300, 300, (9, 7))
    assert (centroids.distances(v, c) == ((v[:, None].astype(int) - c[None]) ** 2).sum(axis=2)).all()
    assert centroids.nearest(np.zeros((1, 2), np.int32), np.array([[3, 1], [1, 3], [1, -3]]))[0][0] == 0


def test_clusters_without_vectors_and_with_huge_ones(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.clustered(spark.createDataFrame([], schema)).collect() == []
    assert centroids.clustered(spark.createDataFrame([(1, None), (2, [1.0])], schema)).collect() == []
    huge = spark.createDataFrame([(1, [1e30] * 64)], schema)
    with pytest.raises(Exception, match="would not fit 64 bits"):
        centroids.clustered(huge).collect()


def test_an_empty_cluster_keeps_its_centroid(spark):
    # all ids but one hash to first centroids that coincide, so the later copies stay empty
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "vec_id long, embedding array<float>")
    got = centroids.clustered(df, dimensions=2, k=3, rounds=2)
    assert {(r.cluster, r.distance) for r in got.collect()} == {(0, 0)}
    vectors = centroids.integer_vectors(df, dimensions=2)
    assert centroids.fit_centroids(vectors, 3, 2).tolist() == [[64, 128]] * 3
