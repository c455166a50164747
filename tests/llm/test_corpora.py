"""Operators across documents: near-duplicates, decontamination, language model and the pipeline."""

import collections
import math
import os
import random
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline
from spanfold.llm import decontamination, embeddings, hmm, jaccard, packing, secrets, tokens
from spanfold.llm.common import Scratch, WordIds, connected_components, shingles, split_words

SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    wide = [(i, t, 7, 8, "a") for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, n long, component long, token string")


def least_reached(nodes, links):
    best = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            changed |= best[a] != low or best[b] != low
            best[a] = best[b] = low
    return best


# Shared parts


def test_words_and_shingles():
    assert split_words("ÀB\x1cc\u00a0D \x0b\tE\u2003f") == ["Àb\x1cc\u00a0d".encode(), "e\u2003f".encode()]
    ids = WordIds()
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert len(shingles(ids.array(words))) == len(want)


@pytest.mark.parametrize("kind", ["path", "random", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(kind)
    n = 400
    links = {
        "path": [(i, i + 1) for i in range(n - 1)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(300)],
        "star": [(i, n - 1) for i in range(n - 1)],
        "none": [],
    }[kind]
    rng.shuffle(links)
    got = {r.node: r.component for r in connected_components(Scratch(spark), spark.createDataFrame(links, "a long, b long")).collect()}
    links = [(a, b) for a, b in links if a != b]
    nodes = {x for l in links for x in l}
    assert got == least_reached(nodes, links)


# Embeddings


def brute_vectors(rows, t=0.95):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            good[k] = np.array(v) / np.linalg.norm(v)
    links = [(a, b) for a in good for b in good if a != b and good[a] @ good[b] >= t]
    n = collections.Counter(a for a, _ in links)
    best = least_reached([i for i, _ in rows if i is not None], [(rows[a][0], rows[b][0]) for a, b in links])
    return sorted((-1 if i is None else i, n[k], -1 if i is None else best[i]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block", [16, 2048])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)  # many cells and blocks on few rows
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    rows = [(1000 - i, (base[i % 60] + rng.normal(size=8) * rng.choice([0, 0.1, 0.35])).tolist()) for i in range(400)]
    rows += [(2000 + i, base[0].tolist()) for i in range(40)] + [(3000, None), (3001, []), (3002, [0.0] * 8), (3003, [None] + [1.0] * 7), (3004, [float("nan")] * 8), (3005, (base[0] * 3).tolist()), (None, base[0].tolist()), (5, base[1].tolist()), (5, base[1].tolist())]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<double>, label int, key string")
    got = embeddings.near_duplicates(df).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.vec_id is None else r.component_id) for r in got) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_widths_and_magnitudes_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(4)
    rows = []
    for width, many in ((2, 30), (3, 50), (16, 40)):
        base = rng.normal(size=(8, width))
        rows += [(len(rows) + i, (base[i % 8] + rng.normal(size=width) * 0.1).tolist()) for i in range(many)]
    rows += [(500, [1e200, 0.0, 1e200]), (501, [1e-200, 0.0, 1e-200]), (502, [5e-324, 0.0]), (503, [1.0, 0.0]), (504, [7.0]), (505, [1e300]), (506, [-2.0])]

    def cosine(a, b):
        a, b = (np.array(x) / np.abs(x).max() for x in (a, b))
        return a @ b / np.sqrt((a @ a) * (b @ b))

    links = [(i, j) for i, a in rows for j, b in rows if i != j and len(a) == len(b) and cosine(a, b) >= 0.95]
    n, best = collections.Counter(i for i, _ in links), least_reached([i for i, _ in rows], links)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted((i, n[i], best[i]) for i, _ in rows)
    assert n[500] and n[504] == 1 and not n[506]


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embeddings.near_duplicates(df).collect()] == [(1, 0, 1, True)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


# Near copies


def brute_jaccard(rows):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    links = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links.append((rows[a][0], rows[b][0]))
    best = least_reached([i for i, _ in rows if i is not None], [l for l in links if None not in l])
    return sorted((-1 if i is None else i, len(sets[k]), -1 if i is None else best[i]) for k, (i, _) in enumerate(rows))


def near_copies(seed, many=250):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    rows, texts = [], []
    for i in range(many):
        if texts and rng.random() < 0.6:  # edits around the threshold
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(t) // 20))):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 2)] = rng.choices(words, k=rng.randint(0, 2))
        else:
            t = rng.choices(words, k=rng.randint(1, 120))
        if rng.random() < 0.3:
            t = t + passage
        texts.append(t or ["x"])
        rows.append((10 * many - 7 * i, rng.choice([" ", "  ", "\n"]).join(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "_PER_HUB", 16)
    rows = near_copies(seed) + [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  B"), (6, "a"), (None, "a"), (6, "a"), (99_999, "long " * 20_000)]
    got = jaccard.components(docs(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute_jaccard(rows)


def test_matrix_finds_links_without_the_first_round(spark, monkeypatch):
    """The bound and the opened groups alone must lose no link."""
    rows = near_copies(3, 160)
    first = []
    verified = jaccard._verified

    def later_only(scratch, texts, sizes, pairs, width):
        first.append(1)
        return verified(scratch, texts, sizes, pairs.limit(0) if len(first) == 1 else pairs, width)




    monkeypatch.setattr(jaccard, "_verified", later_only)
    got = jaccard.components(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_jaccard(rows)


def test_first_of_each_group_stays(spark):
    same = "a b c d e f g h"
    rows = [(3, same), (1, same), (2, "other"), (4, None), (5, ""), (5, ""), (6, ""), (7, "of its own"), (7, "of its own"), (7, "and another text")]
    kept = jaccard.deduplicated(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    want = [(1, same), (2, "other"), (4, None), (5, ""), (6, ""), (7, "and another text"), (7, "of its own")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    # Rows without an id are copies as well: of a row with one, and of each other.
    rows += [(None, same), (None, "no id"), (None, "no id"), (None, None)]
    got = jaccard.deduplicated(docs(spark, rows * 2)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([*want, (None, "no id"), (None, None)], key=str)
    assert jaccard.components(docs(spark, [])).count() == 0 == jaccard.deduplicated(docs(spark, [])).count()


@pytest.mark.parametrize("seed", [5, 6])
def test_slices_of_frequent_tokens_lose_no_link(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "HOT_RANK", 1)  # a token counted four times is dealt to two slices or more
    monkeypatch.setattr(jaccard, "COPY_SALTS", 3)
    rows = near_copies(seed, 200) + [(10_000 + i, "one text that comes again and again and again") for i in range(40)]
    got = jaccard.components(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_jaccard(rows)


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 500)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, rng.integers(1, 3000)).astype(np.uint64)]))
        assert jaccard._differences(jaccard._bitmap(a), jaccard._bitmap(b)) <= len(np.setxor1d(a, b))
        assert jaccard._differences(jaccard._bitmap(a), jaccard._bitmap(a)) == 0


# Decontamination


def brute_tiles(item, doc, least):
    """Greedy string tiling by all longest matches, each time anew, ties by place."""
    a, b, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(item)):
            for t in range(len(doc)):
                k = 0
                while p + k < len(item) and t + k < len(doc) and item[p + k] == doc[t + k] > 0 and a[p + k] and b[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        k, p, t = best
        if k < least:
            return tiles
        for i in range(k):
            a[p + i] = b[t + i] = False
        tiles.append((p, t, k))


def test_tiles_are_those_of_plain_greedy_tiling():
    rng = random.Random(4)
    for n in range(300):
        words = rng.choice([2, 3, 9])  # few words give many ties
        item = [rng.randint(0 if n % 5 == 0 else 1, words) for _ in range(rng.randint(0, 30))]
        doc = [rng.randint(1, words) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3) if item else 0):
            at = rng.randrange(len(item))
            doc += item[at : at + rng.randint(3, 15)] + [rng.randint(1, words)]
        least = rng.choice([1, 2, 3, 5])
        assert decontamination.tiling(item, doc, least) == brute_tiles(item, doc, least)


def test_repeated_words_take_no_long():
    items = decontamination.Items([(1, "a " * 300), (2, "x y " * 150), (3, "tiny one")])
    began = time.process_time()
    assert items.overlaps(("a " * 299 + "b ") * 70) == [(0, 300, 299, 1)]
    assert items.overlaps("x y " * 10_000) == [(1, 300, 300, 1)]
    assert time.process_time() - began < 5
    assert items.overlaps("such a tiny one here") == [(2, 2, 2, 1)] and items.overlaps("tiny and one") == []


def test_leaks_against_brute_force(spark):
    rng = random.Random(12)
    words = [f"v{i}" for i in range(25)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([2, 4, 8, 20])))) for i in range(12)]
    rows = []
    for d in range(120):
        text = rng.choices(words, k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            piece = rng.choice(items)[1].split()
            at = rng.randrange(len(piece))
            text += piece[at:] + rng.choices(words, k=rng.randint(0, 3)) + piece[:at]
        rows.append((d, rng.choice([" ", ", "]).join(text)))
    want = []
    for d, text in rows:
        for i, item in items:
            a, b = decontamination.tokens(item), decontamination.tokens(text)
            ids = {w: n + 1 for n, w in enumerate(dict.fromkeys(a))}
            tiles = brute_tiles([ids[w] for w in a], [ids.get(w, 0) for w in b], min(5, len(a)))
            covered = sum(t[2] for t in tiles)
            if covered >= 0.5 * len(a):
                want.append((d, i, len(a), covered, len(tiles)))
    got = decontamination.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.item_tokens, r.covered_tokens, r.n_tiles) for r in got.collect()) == sorted(want) and len(want) > 20


def test_leaks(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(20)]
    filler = lambda n: " ".join(rng.choices(words, k=n))
    turned = items[3][1].split()
    rows = [
        (1, filler(500) + " " + items[0][1] + " " + filler(500)),
        (2, " ".join([*turned[20:], "x", *turned[10:20], "y", *turned[:10]])),
        (3, items[1][1].upper().replace(" ", ", ")),
        (4, " ".join(items[2][1].split()[:10])),
        (5, filler(20_000)),
        (6, None),
        (7, ""),
        (None, items[5][1]),
        (8, items[6][1]),
        (8, items[6][1]),
    ]
    bench = spark.createDataFrame([*items, (50, None), (51, "too short"), (None, items[7][1])], "item_id long, text string").selectExpr("*", "1 AS n")
    for size in (decontamination.BLOCK_BYTES, 500):  # one block of items, and many
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        got = decontamination.leaks(docs(spark, rows), bench)
        assert sorted((r.doc_id or -1, r.item_id) for r in got.collect()) == [(-1, 5), (1, 0), (2, 3), (3, 1), (8, 6), (8, 6)]
        clean = decontamination.decontaminated(docs(spark, rows), bench)
        assert sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 7] and clean.columns == docs(spark, rows).columns
    assert decontamination.leaks(docs(spark, []), bench).count() == 0
    assert decontamination.leaks(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontamination.decontaminated(docs(spark, rows), bench.limit(0)).count() == len(rows)


# Language model


def random_parameters(states, rng):
    emit = rng.random((hmm.WIDTH, states)) + 0.01
    move, start = rng.random((states, states)), rng.random(states)
    return hmm.Parameters(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def test_forward_is_the_sum_over_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    p = random_parameters(3, rng)
    sequences = sorted(([rng.integers(0, 9, n) for n in (1, 2, 5, 4, 5)]), key=lambda s: -len(s))
    for s, got in zip(sequences, hmm.forward(p, sequences), strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            x = p.start[path[0]] * p.emit[s[0], path[0]]
            for t in range(1, len(s)):
                x *= p.move[path[t - 1], path[t]] * p.emit[s[t], path[t]]
            total += x
        assert math.isclose(got, math.log(total), rel_tol=1e-9)


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    p = random_parameters(8, rng)
    p.move[:] = rng.random((8, 8)) ** 4 + 1e-3  # states that last
    p.move /= p.move.sum(1, keepdims=True)
    texts = [rng.integers(0, hmm.WIDTH, n) for n in (1, 5, 700, 30, 2500, 64, 65, 128, 129, 3)]
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    want = hmm.Counts.zero(8)
    hmm.expect(p, [texts[i] for i in order], want)
    plain = hmm.forward(p, [texts[i] for i in order])
    for piece, chunk in ((64, 300), (64, 3000), (7, 100)):
        monkeypatch.setattr(hmm, "_PIECE", piece)
        monkeypatch.setattr(hmm, "_WHOLE", 2 * piece)
        monkeypatch.setattr(hmm, "_CHUNK", chunk)
        got = hmm.Counts.zero(8)
        hmm.expect_all(p, texts, got)
        assert np.allclose(got.start, want.start) and np.allclose(got.move, want.move) and np.allclose(got.emit, want.emit) and math.isclose(got.log_likelihood, want.log_likelihood)
        assert np.allclose(hmm.likelihoods(p, texts)[order], plain)


def test_expected_counts_are_the_sum_over_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    p = random_parameters(2, rng)
    sequences = sorted(([rng.integers(0, 4, n) for n in (1, 4, 3)]), key=lambda s: -len(s))
    got, want = hmm.Counts.zero(2), hmm.Counts.zero(2)
    hmm.expect(p, sequences, got)
    for s in sequences:
        weights = {}
        for path in itertools.product(range(2), repeat=len(s)):
            x = p.start[path[0]] * p.emit[s[0], path[0]]
            for t in range(1, len(s)):
                x *= p.move[path[t - 1], path[t]] * p.emit[s[t], path[t]]
            weights[path] = x
        total = sum(weights.values())
        for path, x in weights.items():
            want.start[path[0]] += x / total
            for t, k in enumerate(path):
                want.emit[s[t], k] += x / total
                if t:
                    want.move[path[t - 1], k] += x / total
    assert np.allclose(got.start, want.start) and np.allclose(got.move, want.move) and np.allclose(got.emit, want.emit)


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HELD", 50)  # most words come by the table of counts
    monkeypatch.setattr(hmm, "_CHUNK", 200)
    monkeypatch.setattr(hmm, "_WHOLE", 5000)  # the last text goes in pieces
    rng = random.Random(6)
    tongues = [[f"{p}{i}{e}" for i in range(60)] for p, e in (("a", "ing"), ("b", "ez"), ("c", "um"))]
    rows = []
    for i in range(400):
        words = rng.choices(tongues[i % 3], k=rng.randint(0, 60))
        rows.append((i, " ".join(words) if i % 50 else "  "))
    rows += [(1000, None), (1001, ""), (None, "aone new"), (3, rows[3][1]), (2000, "never seen words"), (2001, "a1ing b2ez " * 6000)]
    got = hmm.scores(docs(spark, rows), rounds=3).collect()
    counts = collections.Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update((t or "").encode().lower().split())
            counts[b"\n"] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        held = i is None or zlib.crc32(str(i).encode()) % 10 == 0
        want.append((i if i is not None else -1, held, len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_likelihood_rises_and_words_sum_to_one(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices([f"{'ab'[i % 2]}{k}" for k in range(30)], k=20))) for i in range(200)]
    scratch = Scratch(spark)
    frame = docs(spark, rows).selectExpr("doc_id", "text", "false AS held_out")
    v = hmm.vocabulary(frame, scratch)
    p, seen = hmm.baum_welch(hmm.encode(frame, v, scratch), v, states=4, rounds=4)
    assert all(b > a - 1e-6 * abs(a) for a, b in zip(seen, seen[1:], strict=False))
    # One-word texts: every known word, and an unseen one for each class, share the probability of a first token.
    words = sorted({w for _, t in rows for w in t.split()})
    text_of = [(k, w) for k, w in enumerate(words)]
    frame = docs(spark, text_of).selectExpr("doc_id", "text", "true AS held_out")
    scored = hmm.score(hmm.encode(frame, v, scratch), p, v).collect()
    assert sum(10**r.score for r in scored) < 1


def test_pairs_are_fitted():
    rng = np.random.default_rng(11)
    emit, joint = rng.dirichlet(np.full(12, 0.3), 3), rng.dirichlet(np.ones(9)).reshape(3, 3)
    pairs = 1e6 * (emit.T @ joint @ emit)
    log_of = lambda e, j: (pairs * np.log(e.T @ j @ e)).sum()
    begin, flat = rng.dirichlet(np.ones(12), 3), np.full((3, 3), 1 / 9)
    seen = [log_of(*hmm.follow(pairs, begin, flat, least=0, most=n)) for n in (0, 1, 2, 5, 20, 300)]
    assert all(b > a for a, b in zip(seen, seen[1:], strict=False))
    assert seen[-1] <= log_of(emit, joint) and (log_of(emit, joint) - seen[-1]) < 0.02 * (log_of(emit, joint) - seen[0])
    # One round of a small case, counted pair by pair and state by state.
    e, j = begin / begin.sum(1, keepdims=True), flat
    want_e, want_j = np.tile(e.mean(0), (3, 1)), np.full((3, 3), 0.1)
    for a in range(12):
        for b in range(12):
            whole = sum(j[k, l] * e[k, a] * e[l, b] for k in range(3) for l in range(3))
            for k in range(3):
                for l in range(3):
                    x = pairs[a, b] * j[k, l] * e[k, a] * e[l, b] / whole
                    want_j[k, l] += x
                    want_e[k, a] += x
                    want_e[l, b] += x
    got_e, got_j = hmm.follow(pairs, begin, flat, most=1)
    assert np.allclose(got_e, want_e / want_e.sum(1, keepdims=True)) and np.allclose(got_j, want_j / want_j.sum())
    assert np.allclose(hmm.follow(np.zeros((12, 12)), begin, flat)[0], begin)


def test_no_texts(spark):
    assert hmm.scores(docs(spark, [])).count() == 0
    (r,) = hmm.scores(docs(spark, [(None, None)])).collect()
    assert r.n_tokens == 1 and r.train_tokens == 0 and math.isfinite(r.score)


# Pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_stages(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    frame, scratch, ids = source, Scratch(spark), []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
        frame = scratch.write(stage(spark, frame, SF), name)
        if name == "packing":
            count = tokens.counter(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
            rows = frame.collect()
            assert sum(r.n_tokens for r in rows) == sum(count(list(before.values()))) + len(before) and {i for r in rows for i in r.doc_ids} == set(before)
            assert all(r.capacity in packing.CAPACITIES for r in rows)
            break
        assert frame.columns == source.columns and frame.schema.simpleString() == source.schema.simpleString()
        after = {r.doc_id: r for r in frame.collect()}
        ids.append(set(after))
        if name == "ngram_jaccard":
            want = {c for _, _, c in brute_jaccard(list(before.items()))}
            assert set(after) == want
        if name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            whole = {i for i, t in before.items() for _, b in bench if b in t}
            assert not whole & set(after) and len(before) - len(after) <= len(whole) + 2
        if name == "secrets":
            scan = secrets.scanner()
            assert set(after) == set(before)
            assert {i for i, t in before.items() if scan(t)} == {i for i, r in after.items() if "[SECRET]" in r.text}
            assert not any(scan(r.text) for r in after.values()) and all(r.n_chars == len(r.text) for r in after.values())
    assert len(ids[0]) < source.count()


def test_pipeline_run(spark):
    assert [s[0] for s in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "secrets", "packing"]
    if os.path.isdir(SF):
        assert corpus_pipeline.run(spark, SF).count() > 0
