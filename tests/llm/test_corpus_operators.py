"""The ten operators against brute force on small fixtures with nulls, empty and long texts, copies and ties."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trafficward.llm import (
    blocks, brown, encoder, fingerprints, graph, packing, quality, repeats, replies, sharding, simhash, unigram,
)
from trafficward.llm.common import numbered, successors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
# extra columns whose names the operators also use inside
SCHEMA = "doc_id long, text string, tag string, part string, key string, shard string, n string, piece string, word string, root string"


def make_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = words(60)
    rows = [
        (5, None), (3, ""), (9, " \t\n\r\x0b\x0c "), (11, "one"), (12, "Two words"), (1, "a\n\nb\n\nb"),
        (20, " ".join(words(80))), (21, " ".join(words(40) + passage + words(30))),
        (22, " ".join(words(7) + passage[:50] + words(9))), (23, "  ".join(words(33))),
        (24, "the " * 120), (25, " ".join(["x", "y"] * 60)), (26, "x\x1cy \x85z\xa0w ²½٣ é " * 9),
        (-4, "中文字 テスト 😀😀 " * 20), (30, " ".join(words(3000))), (None, "no id " * 40), (None, None),
        (31, "\n".join(" ".join(words(12)) for _ in range(30))), (32, "| cell | cell | %%% ### $$$\n" * 5),
    ]
    rows += [(40, rows[6][1]), (41, rows[6][1]), (6, rows[6][1]), (20, rows[6][1]), (20, "another text of one id")]
    return rows


TEXTS = make_texts()


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, *["clash"] * 8) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, F.xxhash64("doc_id", "text")).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(df, documents, column="doc_id"):
    """Rows as a list of dicts."""
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- shared helpers


def test_successors_and_numbers(spark):
    keys = spark.createDataFrame([(k,) for k in (7, -3, 9, 100, 12)], "key long")
    assert {r.key: r.next for r in successors(keys).collect()} == {-3: 7, 7: 9, 9: 12, 12: 100, 100: -3}
    rows = spark.createDataFrame([(i % 3, i % 7, i) for i in range(500)], "g int, a int, b int")
    got = numbered(rows, "g", ["a", "b"], "at").collect()
    for g in range(3):
        mine = sorted((r.at, r.a, r.b) for r in got if r.g == g)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = list(range(2000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---------------------------------------------------------------- 1 fingerprints


def python_fingerprint(text: str) -> list[int]:
    signed = lambda h: h
    digest = lambda s, seed: xxhash.xxh64_intdigest(s.encode(), seed)

    def chained(s: str, i: int) -> int:  # Spark hashes the second column with the first hash as seed
        return xxhash.xxh64_intdigest(i.to_bytes(4, "little"), digest(s, 42))

    paragraphs = (text or "").split("\n")
    piece = re.compile(r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){1,8}")
    pieces = [p for x in paragraphs for p in piece.findall(x)]
    wide = [sum(chained(p, i) & (2**62 - 1) for p in paragraphs) % 2**62 for i in range(4)]
    narrow = []
    for hashes in ([digest(p, 42) for p in pieces], [chained(p, 1) for p in pieces]):
        for i in range(21):
            lanes = [sum(h >> (i + s) & 1 for h in hashes) % 2**20 for s in (0, 21, 42)]
            narrow.append(lanes[0] | lanes[1] << 21 | lanes[2] << 42)
    return [signed(x) for x in (*wide, len(pieces), *narrow)]


def test_fingerprints(documents, nothing):
    got = fingerprints.edited_fingerprints(documents).collect()
    assert len(got) == len(TEXTS)
    smallest = {}
    for i, t in TEXTS:
        smallest.setdefault(i, []).append(t or "")
    order = sorted(smallest, key=lambda i: -(2**63) if i is None else i)
    hexed = lambda t: "".join(f"{x:016x}" for x in python_fingerprint(t))
    wanted = []
    for i, t in TEXTS:
        t = t or ""
        need = max(len(x) // 4 for x in smallest[i])
        after = order[(order.index(i) + 1) % len(order)]
        follow = min(smallest[after], key=lambda x: (x[:need].encode(), python_fingerprint(x)))
        k = len(t) // 4
        edited = t[: len(t) - k] + follow[:need][:k]
        wanted.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(t), hexed(edited)))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(wanted, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 5000 and r.doc_id == 30][0]
    assert 0.6 < long.near_edited < 0.9 and long.near_next < 0.35
    assert fingerprints.edited_fingerprints(nothing).collect() == []


def test_fingerprints_add_and_remove(spark):
    a, b = "one two\nthree\nfour", "three\nfive six seven"
    df = spark.createDataFrame([(a, b, a + "\n" + b, "four\nthree\none two")], "a string, b string, ab string, mixed string")
    for c in df.columns:
        df = fingerprints.with_fingerprint(df, c, f"f_{c}")
    row = df.select(
        (fingerprints.combine(F.col("f_a"), F.col("f_b")) == F.col("f_ab")).alias("added"),
        (fingerprints.remove(F.col("f_ab"), F.col("f_b")) == F.col("f_a")).alias("removed"),
        (F.col("f_mixed") == F.col("f_a")).alias("order"),
    ).first()
    assert row.added and row.removed and row.order


# ---------------------------------------------------------------- 2 sharding


def python_jump(key: int, shards: int) -> int:
    key &= 2**64 - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_shards(spark):
    rng = random.Random(1)
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 25, 300):
        got = {r.k: r.s for r in df.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()}
        assert got == {k: python_jump(k, n) for k in keys}


def test_assigned_shards(documents, nothing, tmp_path):
    got = sharding.assign_shards(documents, 24).collect()
    assert len(got) == len(TEXTS)
    key = lambda r: tuple(map(str, r))
    wanted = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", python_jump(i or 0, 24), python_jump(i or 0, 25)) for i, t in TEXTS]
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got), key=key) == sorted(wanted, key=key)
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert sharding.assign_shards(nothing, 24).collect() == []
    sharding.write_shards(documents.select("doc_id", "text"), str(tmp_path / "shards"), 24)
    assert documents.sparkSession.read.parquet(str(tmp_path / "shards")).count() == len(TEXTS)


# ---------------------------------------------------------------- 3 and 8 tokens


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_equals_the_library(name, spaced):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(5)
    letters = " \n\t\rİ\u3000\x0b\x1c\x1f\x85\xa0  aAbBé'stdmllveIΣσς.,!?01²٣中字́̈😀_-#<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [t for _, t in TEXTS] + ["it's I'LL 'sample <|endoftext|>x  <|startoftext|>", "a" * 5000]
    texts += ["DEVRİ!", "İ.", "tİ-a", "a İ'b", "İ,x <|ENDOFTEXT|>", "a <|endoftext|> b", " \n", "x  \u3000y", "a\n\n b \n\tc", "\u2003"]
    for keep in (10**6, 50):
        own = encoder.UnitEncoder(name, spaced, keep)
        ids, per_text = own.encode(texts, end=1)
        wanted = [e.ids + [1] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert per_text.tolist() == list(map(len, wanted))
        assert ids.tolist() == [i for x in wanted for i in x]


def test_encoder_remembers_units_in_arrays():
    own = encoder.UnitEncoder("byte_bpe_50k.json", True)
    texts = [" ".join(f"q{i * 7919 % 100003:x}z" for i in range(a, a + 500)) for a in range(0, 20000, 400)]
    for t in texts:
        assert own.encode([t])[0].tolist() == own.library.encode(t, add_special_tokens=False).ids
    held = sum(x.nbytes for x in vars(own).values() if isinstance(x, np.ndarray))
    assert not any(isinstance(x, dict) and len(x) > 1000 for x in vars(own).values())
    assert len(own.names) > 20000 and held < 64 * len(own.names) and (np.diff(own.names.astype(float)) >= 0).all()


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    cases = [np.zeros(0), np.array([5]), np.arange(128), np.full(1000, 7), rng.integers(0, 2**32, 3000), rng.zipf(1.2, 5000) % 2**32]
    spiky = rng.integers(100, 140, 2000)
    spiky[rng.integers(0, 2000, 90)] = 2**32 - 1
    for ids in [*cases, spiky]:
        ids = ids.astype(np.uint32)
        for share in (0.5, 0.9, 1.0):
            data = memoryview(blocks.pack_blocks(ids, share))
            assert (blocks.unpack_blocks(data, len(ids)) == ids).all()
            for a, b in ((0, 1), (len(ids) // 3, len(ids) // 2), (max(0, len(ids) - 1), len(ids))):
                b = min(b, len(ids))
                assert (blocks.unpack_blocks(data, len(ids), a, b) == ids[a:b]).all()
    assert len(blocks.pack_blocks(spiky.astype(np.uint32))) < 2000 * 4 / 2


def library_ids(name: str, end: int) -> list[list[int]]:
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids + [end] for e in library.encode_batch([t or "" for _, t in TEXTS], add_special_tokens=False)]


def test_token_table(documents, nothing):
    got = sorted(blocks.encoded_documents(documents).collect(), key=lambda r: r.start)
    ids = library_ids("word_bpe_49k.json", 1)
    order = sorted(range(len(TEXTS)), key=lambda i: (TEXTS[i][0] is not None, TEXTS[i][0] or 0, TEXTS[i][1] is not None, (TEXTS[i][1] or "").encode()))
    at, wanted = 0, []
    for i in order:
        wanted.append((TEXTS[i][0], at, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        at += len(ids[i])
    assert [tuple(r) for r in got] == wanted
    assert blocks.encoded_documents(nothing).collect() == []


@pytest.mark.parametrize("open_bins", [1, 4, 64])
def test_best_fit_keeps_its_rules(open_bins):
    rng = random.Random(4)
    lengths = [rng.randint(1, 100) for _ in range(3000)]
    fill, changed, open_now = {}, {}, set()
    for step, (length, (number, offset)) in enumerate(zip(lengths, packing.best_fit(lengths, 100, open_bins))):
        fits = [b for b in open_now if fill[b] + length <= 100]
        if number in fill:
            assert number in open_now and offset == fill[number] == max(fill[b] for b in fits)  # the tightest
        else:
            assert not fits and offset == 0
            if len(open_now) == open_bins and length < 100:  # the fullest closes, of equals the last one filled
                open_now.remove(max(open_now, key=lambda b: (fill[b], changed[b])))
            open_now.add(number)
        fill[number], changed[number] = offset + length, step
        if fill[number] == 100:
            open_now.remove(number)
    assert len(open_now) <= open_bins and sum(fill.values()) == sum(lengths)
    if open_bins == 64:
        assert len(fill) <= math.ceil(sum(lengths) / 100) * 1.03


def test_packed_documents(documents, nothing):
    got = packing.packed_documents(documents, capacity=256).collect()
    rows = collections.defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for held in rows.values():
        held.sort()
        assert [a for a, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1].tolist()] and sum(n for _, n in held) <= 256
    wanted = []
    for (i, _), ids in zip(TEXTS, library_ids("byte_bpe_50k.json", 0)):
        edges = [0, *range(len(ids) % 256 or 256, len(ids), 256), len(ids)]
        wanted += [(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(edges, edges[1:]))]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(wanted, key=key)
    assert packing.packed_documents(nothing).collect() == []
    whole = packing.sequences(documents, capacity=256).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole) and sum(r.n_tokens for r in whole) == sum(w[3] for w in wanted)


# ---------------------------------------------------------------- 4 class bigrams


def test_brown(documents, nothing):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = brown.scored_documents(documents, held, classes=6, frequent=64, rounds=6).collect()
    tokens = [(i, WORD.findall((t or "").translate(LOWER)) + [None]) for i, t in TEXTS]
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, x in tokens if not is_held(i) for w in x)
    n, v = sum(counts.values()), len(counts)
    wanted = sorted((str(i), is_held(i), len(x), sum(counts[w] > 0 for w in x), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), 6)) for i, x in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == wanted
    assert all(r.score < 0 and r.perplexity > 1 for r in got)
    assert brown.scored_documents(nothing, held).collect() == []


def test_brown_finds_the_classes_and_sums_to_one(spark):
    rng = random.Random(2)
    # words of two alternating kinds: the class before tells the class
    texts = [" ".join(w for _ in range(30) for w in (f"a{rng.randint(0, 20)}", f"b{rng.randint(0, 20)}")) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chunks = brown.stored(brown.code_corpus(df, F.col("doc_id") % 5 == 0), "chunks")
    model = brown.fit(chunks, classes=3, frequent=50, rounds=12)
    got = brown.score(chunks, model).where("held_out").collect()
    assert all(r.score > r.base_score * 0.87 for r in got)  # half of the words can follow: log(1/21) / log(1/42) = 0.81
    assert model.classes == 4  # one for the words that no neighbour places
    moves = np.random.default_rng(3).integers(0, 99, (4, 4)).astype(float)
    moves[:, model.tokens == 0] = 0  # nothing moves to a class without words
    table = brown.step_table(moves, model)
    mass = model.tokens - model.discount * model.types
    assert 10 ** table[:, :4] @ mass + 10 ** table[:, brown.UNKNOWN] == pytest.approx(np.ones(5))


def test_brown_gain_is_the_true_gain():
    """The proposed class and its gain against the likelihood of every move, from words that should move and words that should stay."""
    rng = np.random.default_rng(1)
    moving = 0
    for _ in range(40):
        after, before, own = rng.integers(0, 9, 4).astype(float), rng.integers(0, 9, 4).astype(float), float(rng.integers(0, 4))
        now = int(rng.integers(0, 4))
        rest = rng.integers(0, 30, (4, 4)).astype(float)

        def placed(c):
            g = rest.copy()
            g[c] += after
            g[:, c] += before
            g[c, c] += own
            return g

        value = [brown.likelihood(placed(c)) for c in range(4)]
        best, gain = brown.best_class(placed(now), now, after, before, own)
        assert best == int(np.argmax(value)) and gain == pytest.approx(max(value) - value[now], abs=1e-6)
        moving += best != now
    assert 5 < moving < 40


def test_brown_score_is_recomputed(spark):
    """Every score again, word by word, from the fitted classes."""
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randint(0, 40))) for _ in range(50)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chunks = brown.stored(brown.code_corpus(df, F.col("doc_id") % 5 == 0, chunk_tokens=200), "chunks")
    model = brown.fit(chunks, classes=4, frequent=10, rounds=6)
    of = {r.word: (r.n, r["class"]) for r in model.vocabulary.collect()}
    name = lambda w: int(brown.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)])).view(np.int64)[0])
    coded = {i: [of.get(name(w)) for w in (t or "").split()] + [of[brown.END]] for i, t in enumerate(texts)}
    start, tokens, types, moves = of[brown.END][1], collections.Counter(), collections.Counter(), collections.Counter()
    for n, c in of.values():
        tokens[c] += n
        types[c] += 1
    for i, words in coded.items():
        if i % 5:
            for a, b in zip([start] + [w[1] for w in words], words):
                moves[a, b[1]] += 1
    total, d, lam = sum(tokens.values()), model.discount, model.smoothing
    share = [tokens[c] / total for c in range(5)]

    def move(a, b):
        return share[b] if a is None else (moves[a, b] + lam * share[b]) / (sum(moves[a, c] for c in range(5)) + lam)

    for r in brown.score(chunks, model).collect():
        wanted, a = 0.0, start
        for w in coded[r.doc_id]:
            if w is None:
                wanted += math.log10(sum(move(a, c) * d * types[c] / tokens[c] for c in range(5) if tokens[c]))
            else:
                wanted += math.log10(move(a, w[1]) * (w[0] - d) / tokens[w[1]])
            a = w and w[1]
        assert r.score == pytest.approx(wanted, abs=1e-6)


# ---------------------------------------------------------------- 5 SimHash


def python_simhash(text: str | None) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(documents, nothing):
    got = simhash.near_duplicates(documents).collect()
    prints = [python_simhash(t) for _, t in TEXTS]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{p:016x}") for (i, _), p in zip(TEXTS, prints))
    same = collections.defaultdict(set)
    for r in got:
        same[r.fingerprint].add(r.component_id)
    assert all(len(x) == 1 for x in same.values())
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {3}
    assert simhash.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("crowd", [512, 3])
def test_near_links_lose_nothing(spark, crowd):
    rng = random.Random(9)
    values = {0, 2**64 - 1, 2**63}
    for _ in range(25):
        seed = rng.getrandbits(64)
        for _ in range(12):
            x = seed
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    links = simhash.near_links(spark.createDataFrame([(signed(v),) for v in values], "fingerprint long"), crowd=crowd)
    links = [(a % 2**64, b % 2**64) for a, b in links.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)

    def groups(pairs):
        parent = {v: v for v in values}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return {v: find(v) for v in values}

    every = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2]
    assert groups(links) == groups(every)


def test_one_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, groups, number = [], [], 0
    for _ in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(120, 400))]
        group = []
        for _ in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(len(words) // 150):  # likeness above 0.8
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((number, " ".join(copy), "x"))
            group.append(number)
            number += 1
        groups.append(group)
    rows += [(0, rows[0][1], "x"), (None, rows[0][1], "x"), (900, None, "x"), (901, "", "x")]
    for crowd in (1024, 2):
        df = spark.createDataFrame(rows, "doc_id long, text string, _tag string")
        kept = [r.doc_id for r in simhash.without_near_copies(df).collect()]
        wanted = [None, 900] + [g[0] for g in groups[1:]]
        assert sorted(kept, key=str) == sorted(wanted, key=str)
    nodes = simhash._signatures(df.where("doc_id < 500").select(F.xxhash64("text").alias("tag"), F.col("doc_id").alias("key"), "text"), 5)
    few, many = (graph.components(simhash.similar_links(nodes, crowd=c)).collect() for c in (2, 1024))
    assert sorted(few) == sorted(many)


def test_simhash_gives_the_first_candidates(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for number in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(1500)]
        rows.append((2 * number, " ".join(words)))
        rows.append((2 * number + 1, " ".join([*words[:-1], "other"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = simhash._signatures(df.select(F.xxhash64("text").alias("tag"), F.col("doc_id").alias("key"), "text"), 5)
    prints = {r.least: r.fingerprint % 2**64 for r in nodes.collect()}
    near = {i for i in range(0, 80, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 2}
    assert len(near) > 30 and len(set(prints.values())) > 35
    keys = nodes.select("tag", F.col("least").alias("key"))
    pairs = simhash.print_candidates(nodes).join(keys.toDF("a", "i"), "a").join(keys.toDF("b", "j"), "b").select("i", "j").collect()
    assert {tuple(sorted(p)) for p in pairs} == {(i, i + 1) for i in near}
    given = []
    candidates = simhash.print_candidates
    monkeypatch.setattr(simhash, "print_candidates", lambda n: given.append(1) or candidates(n))
    assert sorted(r.doc_id for r in simhash.without_near_copies(df).collect()) == list(range(0, 80, 2))
    assert given


def test_majority_of_a_long_text_is_counted_in_slices(monkeypatch):
    rng = np.random.default_rng(4)
    shingles, owner = rng.integers(0, 2**64, 1000, np.uint64), np.sort(rng.integers(0, 7, 1000))
    n = np.bincount(owner, minlength=8)
    whole = simhash._majority(shingles, owner, n)
    monkeypatch.setattr(simhash, "_SLICE", 64)
    assert (simhash._majority(shingles, owner, n) == whole).all() and whole[7] == 0
    for i in range(7):
        mine = [int(x) for x in shingles[owner == i]]
        assert whole[i] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mine) > len(mine))


def alike(one: str, two: str) -> float:
    a, b = (set(zip(*[t.split()[i:] for i in range(5)])) for t in (one, two))
    return len(a & b) / len(a | b)


def test_passages_replaced_and_tails_cut_are_near_copies(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(300)]
    rows, wanted, low, high = [], [], 0, 0
    for number in range(300):
        words = [rng.choice(common) if rng.random() < 0.5 else f"v{rng.randrange(20000)}" for _ in range(rng.randint(60, 500))]
        n = len(words) - 4
        likeness = 0.76 + 0.11 * rng.random()
        if number % 2:
            copy = words[: round(n * likeness) + 4]
        else:
            size = max(1, round(n * (1 - likeness) / (1 + likeness)) - 4)
            at = rng.randrange(1, len(words) - size)
            copy = words[:at] + [rng.choice(common) for _ in range(size)] + words[at + size :]
        one, two = " ".join(words), " ".join(copy)
        near = alike(one, two) >= 0.8
        low, high = low + (not near), high + near
        rows += [(2 * number, one), (2 * number + 1, two)]
        wanted += [2 * number] if near else [2 * number, 2 * number + 1]
    assert low > 60 and high > 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.without_near_copies(df).collect()) == wanted


def test_crowds_of_near_copies_connect_as_all_pairs_do(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for number in range(120):
        words = list(base)
        at, size = rng.randrange(110), rng.randint(1, 24)
        words[at : at + size] = [f"x{number}.{i}" for i in range(size)]
        rows.append((number, " ".join(words)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if alike(a, rows[j][1]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.without_near_copies(df).collect()) == sorted({find(i) for i in range(len(rows))})


def test_a_line_repeated_within_texts_makes_no_near_copies(spark):
    rng = random.Random(3)
    line = " ".join(f"licence{i}" for i in range(12))
    rows = []
    for number in range(40):
        parts = []
        for _ in range(rng.randint(16, 25)):
            parts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(13, 20))), line]
        rows.append((number, "\n".join(parts)))
    assert max(alike(a, b) for (_, a), (_, b) in zip(rows, rows[1:])) < 0.05
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.without_near_copies(df).count() == len(rows)


# ---------------------------------------------------------------- 6 quality


def test_quality_counts(documents, spark, nothing):
    labels = spark.createDataFrame([(20, 1, 0), (21, 1, 0), (30, 1, 0), (31, 1, 0), (24, 0, 0), (None, 1, 0), (25, None, 0)], "doc_id long, quality int, toxic int")
    ratio = quality.fit_ratio(documents, labels)
    got = quality.judged(documents, ratio).collect()
    wanted = []
    for i, t in TEXTS:
        t = t or ""
        words = WORD.findall(t)
        triples = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        wanted.append((str(i), len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)))
    assert sorted((str(r.doc_id), *list(r)[1:7]) for r in got) == sorted(wanted)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judged(nothing, quality.fit_ratio(nothing, labels)).collect() == []
    alone = quality.fit_ratio(documents, labels.where("false"))
    assert all(r.kept != r.base_failed for r in quality.judged(documents, alone).collect())
    kept = quality.kept_documents(documents, ratio)
    assert kept.columns == documents.columns and kept.count() == sum(r.kept for r in got)


def test_ratio_tells_junk_from_prose(spark):
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choice("the of and river stone walks under bright morning light slowly home again".split()) + rng.choice(["", "s"]) for _ in range(90))
    junk = lambda: " ".join(f"{rng.randint(0, 99999)}%%%" for _ in range(90))
    rows = [(i, junk() if i % 4 == 0 else prose()) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 200, 3)], "doc_id long, quality int")
    got = quality.judged(df, quality.fit_ratio(df, labels)).where("NOT base_failed").collect()
    assert len(got) > 150 and all(r.kept == (r.doc_id % 4 != 0) for r in got)


# ---------------------------------------------------------------- 7 reply trees


def test_template_is_reversible():
    rng = random.Random(6)
    bits = ["\\", "#", "### ", " ", "</turn>", " </turn>\n", ": ", ":", "\n", "x", "é", "Assistant", "<", "/turn>"]
    for _ in range(3000):
        turns = [("".join(rng.choices(bits, k=rng.randint(0, 5))), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for _ in range(rng.randint(1, 4))]
        turns += [("assistant", "".join(rng.choices(bits, k=6)))]
        text, spans = replies.format_turns(turns)
        assert replies.read_turns(text) == turns
        assert [replies.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_reply_paths_and_ranks(spark):
    rng = random.Random(8)
    rows, parents = [], {}
    for tree in range(6):
        for m in range(40):
            p = None if m == 0 else rng.randrange(max(0, m - 6), m)
            parents[tree, m] = p
            rows.append((tree, m, p, "user" if m % 2 else "assistant", f"t{tree} m{m}", float(rng.randint(0, 5))))
    rows += [(7, i, i - 1 if i else None, "user", "chain", None) for i in range(70)]
    parents |= {(7, i): (i - 1 if i else None) for i in range(70)}
    rows += [(8, 1, 2, "user", "circle", 1.0), (8, 2, 1, "user", "circle", 1.0), (8, 3, 1, "user", "tail", 1.0), (9, 5, 77, None, None, None)]
    parents[9, 5] = None
    df = spark.createDataFrame(rows, "tree long, message long, parent long, role string, text string, score double")
    got = collections.defaultdict(dict)
    for r in replies.message_paths(df).collect():
        got[r.tree, r.leaf][r.place] = r.message
    inner = {(t, p) for (t, _), p in parents.items() if p is not None}
    wanted = {}
    for t, m in parents:
        if (t, m) not in inner:
            path = [m]
            while parents[t, path[-1]] is not None:
                path.append(parents[t, path[-1]])
            wanted[t, m] = dict(enumerate(reversed(path)))
    assert dict(got) == wanted
    best = {r.tree: r for r in replies.formatted_branches(df, best=1).collect()}
    assert set(best) == {0, 1, 2, 3, 4, 5, 7, 9}
    scores = {(r[0], r[1]): r[5] or 0.0 for r in rows}
    for t in range(6):
        mean = {leaf: np.mean([scores[t, m] for m in path.values()]) for (tree, leaf), path in wanted.items() if tree == t}
        top = min(leaf for leaf in mean if abs(mean[leaf] - max(mean.values())) < 1e-12)
        assert best[t].leaf == top
    assert replies.read_turns(best[9].formatted) == [("", "")]


def test_conversations(spark):
    odd = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", odd), (1, 1, "assistant", None), (1, 5, None, "x"), (None, 0, "assistant", ""), (2, None, "user", "late"), (2, 0, "assistant", "a\nb")]
    got = {r.conv_id: r for r in replies.conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:])
    for c in (1, 2, None):
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        learnt = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learnt))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert r.formatted_chars == len(replies.format_turns(turns)[0])
    assert replies.conversation_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# ---------------------------------------------------------------- 9 unigram pieces


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load_vocabulary()


def brute_best(v, pieces: dict[bytes, int], unit: bytes) -> float:
    best = {0: 0.0}
    text = unit.decode()
    ends = np.cumsum([0] + [len(c.encode()) for c in text]).tolist()
    for i in ends:
        if i not in best:
            continue
        for j in ends:
            if j > i and unit[i:j] in pieces:
                best[j] = max(best.get(j, -math.inf), best[i] + v.scores[pieces[unit[i:j]]])
        j = next((e for e in ends if e > i), None)
        if j is not None and unit[i:j] not in pieces:
            best[j] = max(best.get(j, -math.inf), best[i] + v.unknown)
    return best[len(unit)]


def test_unigram_is_the_best_path(vocabulary):
    import public_tokenizers
    import sentencepiece

    source = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    normal = [i for i in range(source.get_piece_size()) if not (source.is_byte(i) or source.is_control(i) or source.is_unknown(i))]
    pieces = {source.id_to_piece(i).encode(): i for i in normal}
    back = {i: p for p, i in pieces.items()}
    rng = random.Random(1)
    units = ["".join(rng.choice("▁thenioSéß中😀①#%") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    coded = [u.encode() for u in units]
    found = unigram.viterbi(vocabulary, coded)
    assert found == [unigram._viterbi_long(vocabulary, u) for u in coded]
    byte_of = {int(i): b for b, i in enumerate(vocabulary.byte_ids)}
    for unit, ids in zip(coded, found):
        assert b"".join(back[i] if i in back else bytes([byte_of[i]]) for i in ids) == unit
        unknown = len(b"".join(bytes([byte_of[i]]) for i in ids if i in byte_of).decode())
        score = sum(vocabulary.scores[i] for i in ids if i in back) + unknown * vocabulary.unknown
        assert score == pytest.approx(brute_best(vocabulary, pieces, unit), abs=1e-3)


def test_unigram_round_trips(documents, vocabulary, nothing):
    got = unigram.round_trips(documents, vocabulary).collect()
    assert len(got) == len(TEXTS) and all(r.same for r in got)
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in TEXTS)
    there = unigram.encoded(documents, vocabulary)
    again = unigram.decoded(there, vocabulary)
    assert sorted(r.text for r in again.collect()) == sorted(t or "" for _, t in TEXTS)
    assert unigram.round_trips(nothing, vocabulary).collect() == []
    assert unigram.decode_ids(vocabulary, np.zeros(0, np.int64), np.zeros(2, np.int64)) == ["", ""]


# ---------------------------------------------------------------- 10 repeats


def python_removed(texts: list[str], window: int) -> list[tuple[int, int, str]]:
    words = [WORD.findall(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 12, 5, 4])
def test_repeats(documents, nothing, window):
    got = repeats.removal_report(documents, window=window).collect()
    wanted = python_removed([t or "" for _, t in TEXTS], window)
    assert sorted((str(r.doc_id), *list(r)[1:]) for r in got) == sorted((str(i), *w) for (i, _), w in zip(TEXTS, wanted))
    assert repeats.removal_report(nothing, window=window).collect() == []


def test_repeats_with_hot_passages(spark, monkeypatch):
    rng = random.Random(13)
    common = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(300):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(rng.randint(20, 90))]
        if i % 3 == 0:
            a = rng.randrange(20)
            at = rng.randrange(len(words))
            words[at:at] = common[a : a + rng.randint(10, 40)]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = sorted((i, *w) for (i, _), w in zip(rows, python_removed([t for _, t in rows], 12)))
    assert sorted(map(tuple, repeats.removal_report(df, window=12).collect())) == wanted
    # the same with every key that is met twice dealt as a hot one, and small batches of rows
    hot = repeats._hot_keys
    monkeypatch.setattr(repeats, "_hot_keys", lambda t, w, h: hot(t, w, 50, share=1, least=2))
    tagged = df.withColumn("tag", F.xxhash64("text"))
    changed = {r.tag: r.kept for r in repeats.stripped(tagged.select("tag", "text"), window=12, held=50).collect()}
    got = sorted((r.doc_id, hashlib.sha256(changed.get(r.tag, r.text).encode()).hexdigest()) for r in tagged.collect())
    assert got == [(w[0], w[3]) for w in wanted]


def test_rows_keep_their_columns(documents):
    left = repeats.without_repeats(documents, window=35)
    assert left.columns == documents.columns and left.count() == len(TEXTS)
    assert {r.doc_id for r in left.where("text = ''").collect()} >= {3, 6, 40, 41}
