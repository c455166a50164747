"""Operators on single texts: tokens, secrets, toxicity, chat, shards and packing."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanfold.llm import chat, packing, secrets, sharding, tokens, toxicity

SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Rows of (doc_id, text), with columns whose names clash with the operators' own."""
    wide = [(i, t, "x", 1, 2.0) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, spans string, n_tokens int, toxicity double")


EDGE = [(1, None), (2, ""), (None, "no id here"), (3, "same text"), (3, "same text"), (4, " \t\n"), (5, "word " * 30_000)]


# Token counts


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def plain_tokenizer(path):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def test_token_counts_of_edge_cases(spark, vocabulary):
    t = plain_tokenizer(vocabulary)
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs(spark, EDGE), vocabulary).collect())
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in EDGE]
    assert got == sorted((len((x or "").encode()), n, n > 2048) for (_, x), n in zip(EDGE, want, strict=True))
    assert tokens.token_counts(docs(spark, EDGE).limit(0), vocabulary).count() == 0


pieces = st.lists(st.sampled_from(["word", "Don't", " ", "\n", "\u00a0", "\u2003", "e\u0301", "\u0301", "<|endoftext|>", "<|end", "12", "ß!?", "…", "日本", "'s", "\x1c", "x" * 40, "É", "œuvre,", "ß", "İ", "\u0149", "\u017f", "(x)", "--", "WORD", "3rd", "…%", "×", "\u212a"]), max_size=120).map("".join)


@settings(max_examples=60, deadline=None)
@given(pieces)
def test_counts_and_splices_equal_the_library(vocabulary, text):
    t = plain_tokenizer(vocabulary)
    whole = t.encode(text, add_special_tokens=False)
    assert tokens.counter(vocabulary)([text]) == [len(whole.ids)]

    def encode(x):
        e = t.encode(x, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    assert [x[0] for x in tokens.splice(text, encode, chunk=24, overlap=4)] == whole.ids


def test_overlaps_widen_over_an_endless_word():
    text = "a " * 30 + "b" * 100 + " c" * 30
    calls = []

    def encode(x):
        calls.append(len(x))
        return [(hash(m[0]), m.start(), m.end()) for m in re.finditer(r"\S+", x)]

    assert tokens.splice(text, encode, chunk=40, overlap=8) == encode(text) and max(calls[:-1]) > 80


# Secrets


def brute_spans(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate(secrets.RULES):
        flags = re.ASCII | (re.IGNORECASE if kind == "assign" else 0)
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return ",".join(x[2] for x in sorted(found))


HIDDEN = [
    "password = 'hunter22' and token:short",
    "API_KEY=abcdef TOKEN := x1y2z3 apikey: \"zz_zz-zz\"",
    "AKIA" + "A1" * 8 + " AKIAshort AKIA" + "B" * 30,
    "ſecret=abcdefgh pa\u212assword=1234567",
    "deadbeef" * 3 + " " + "0" * 23 + " g" + "a" * 40,
    "secret=" + "0123456789abcdef" * 2,
]


def test_spans(spark, tmp_path):
    rows = EDGE + [(10 + i, t) for i, t in enumerate(HIDDEN * 2)]
    got = secrets.scan_documents(docs(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.secret_spans) for r in got) == sorted((i or -1, brute_spans(t or "")) for i, t in rows)
    assert "spans" in got[0].asDict() and got[0].n_tokens == 1
    assert secrets.scan_documents(docs(spark, rows).limit(0)).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    first = docs(spark, [(1, HIDDEN[0]), (2, HIDDEN[0]), (3, "clean")])
    secrets.scan_documents(first, ledger).collect()
    assert spark.read.parquet(ledger).count() == 2
    spark.createDataFrame([(hashlib.sha256(b"clean").hexdigest(), "old rules", "hex:0:5")], "blob string, rules string, spans string").write.mode("append").parquet(ledger)
    known = spark.read.parquet(ledger)
    assert secrets.scan_blobs(docs(spark, [(9, HIDDEN[0]), (10, "new")]), known).count() == 1
    got = {r.doc_id: r.secret_spans for r in secrets.scan_documents(docs(spark, [(4, HIDDEN[0]), (5, HIDDEN[2]), (6, "clean")]), ledger).collect()}
    assert got == {4: brute_spans(HIDDEN[0]), 5: brute_spans(HIDDEN[2]), 6: ""}
    assert spark.read.parquet(ledger).where("rules != 'old rules'").count() == 3


def test_increments_scan_only_unseen_blobs(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ledger"
    halves = [(i, HIDDEN[i % 6] if i % 2 else f"clean {i % 4}") for i in range(40)], [(i, HIDDEN[i % 6] if i % 3 else "new") for i in range(40, 80)]
    seen = set()
    for rows in halves:
        before = len(seen)
        seen |= {t for _, t in rows}
        secrets.add_to_ledger(docs(spark, rows), path)
        assert spark.read.parquet(path).count() == len(seen) > before
    secrets.add_to_ledger(docs(spark, halves[0]), path)
    assert spark.read.parquet(path).count() == len(seen)
    wide = docs(spark, halves[0] + halves[1]).selectExpr("*", "'x' AS __blob", "'old' AS secret_spans")
    got = secrets.findings(wide, path)
    assert sorted((r.doc_id, r.secret_spans) for r in got.collect()) == sorted((i, brute_spans(t)) for i, t in halves[0] + halves[1])
    assert got.columns == wide.columns


def test_redaction(spark):
    df = secrets.scan_documents(docs(spark, [(1, HIDDEN[5] + " end"), (2, None), (3, "clean")]))
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert got == {1: "[SECRET] end", 2: None, 3: "clean"}
    assert secrets.masked("abcdef", "hex:1:3,assign:2:5", "#") == "a#f"


# Toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    bad = ["idiot", "moron", "zorblat", "zorblath"]
    rows, labels = [], []
    for i in range(900):
        text = rng.choices(words, k=rng.randint(5, 120))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 0, 1), (7, None, None), (10**6, 1, 1)]
    table = docs(spark, rows + [(5000, None), (5001, "")])
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.toxicity for r in toxicity.scored(table, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    wrong = [i for i in held if (got[i] >= toxicity.THRESHOLD) != (i % 6 == 0)]
    assert len(held) > 150 and len(wrong) <= 0.03 * len(held)
    assert got[5000] == got[5001] and all(0 <= x <= 1 for x in got.values())
    assert got[5000] < toxicity.THRESHOLD


def test_the_sample_does_not_depend_on_the_partitioning(spark):
    rows = [(i, f"text {i % 40}") for i in range(200)]
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    found = [sorted(map(tuple, toxicity.labelled_sample(docs(spark, rows).repartition(n), labels).collect())) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and len({r[0] for r in found[0]}) == len(found[0]) > 30
    want = {}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            want.setdefault(t, []).append((i, int(i % 3 == 0)))
    assert {r[0]: (r[1], r[2]) for r in found[0]} == {t: (min(i for i, _ in v), max(x for _, x in v)) for t, v in want.items()}


def plain_trees(x, y, trees):
    """The same boosted trees, a row and a split at a time."""
    binned = [[int(np.searchsorted(e, row[j])) for j, e in enumerate(trees.edges)] for row in x]
    score = [trees.start] * len(x)
    for _ in range(trees.rounds):
        p = [1 / (1 + np.exp(-s)) for s in score]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        nodes = {0: list(range(len(x)))}
        for _ in range(trees.depth):
            split = {}
            for node, some in nodes.items():
                best, at = 1e-6, None
                for j in range(len(trees.edges)):
                    for cut in range(trees.bins):
                        left = [i for i in some if binned[i][j] <= cut]
                        right = [i for i in some if binned[i][j] > cut]
                        gl, hl, gr, hr = (sum(v[i] for i in side) for side in (left, right) for v in (g, h))
                        if hl < 1e-3 or hr < 1e-3:
                            continue
                        gain = gl**2 / (hl + trees.ridge) + gr**2 / (hr + trees.ridge) - (gl + gr) ** 2 / (hl + hr + trees.ridge)
                        if gain > best + 1e-12:
                            best, at = gain, (j, cut)
                for i in some:
                    split.setdefault(2 * node + (at is not None and binned[i][at[0]] > at[1]), []).append(i)
            nodes = split
        for some in nodes.values():
            value = -trees.rate * sum(g[i] for i in some) / (sum(h[i] for i in some) + trees.ridge)
            for i in some:
                score[i] += value
    return score


def test_trees_equal_plain_ones():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    y = np.clip((x[:, 0] + x[:, 1] ** 2 > 0.5) * 0.8 + rng.random(60) * 0.2, 0, 1)  # no two labels are equal, so no splits tie
    trees = toxicity.Trees(rounds=4, depth=2, bins=8).fit(x, y)
    assert np.allclose(trees.margin(x), plain_trees(x, y, trees), atol=1e-8)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = docs(spark, EDGE)
    assert {r.toxicity for r in toxicity.scored(table, toxicity.fit(table, none)).collect()} == {0.0}


def test_features_see_hidden_insults():
    reader = toxicity.Reader({"zorblat": 6.0, "zorb*": 1.6})
    at = toxicity.FEATURES.index
    x = reader.features("You Z0RBL4T! z-o-r-b-l-a-t zorbing")
    assert x[at("obfuscated")] > 0 and x[at("near_you")] > 0 and x[at("mild")] > 0 and x[at("capital_words")] > 0
    assert reader.features(None) == reader.features(" ") == [0.0] * len(toxicity.FEATURES)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=1, max_size=40))
def test_isotonic_is_the_least_squares_fit(points):
    x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points])
    at, value = toxicity.isotonic(x, y)
    fit = np.interp(np.unique(x), at, value)
    assert (np.diff(at) >= 0).all() and (np.diff(value) >= -1e-12).all()
    # Max-min formula over groups of equal x, the two added rows included.
    groups = [(1.0, y.mean()), *[(float((x == v).sum()), y[x == v].mean()) for v in np.unique(x)], (1.0, y.mean())]
    mean = lambda a, b: sum(w * m for w, m in groups[a:b]) / sum(w for w, _ in groups[a:b])
    want = [max(min(mean(a, b) for b in range(i + 1, len(groups) + 1)) for a in range(i + 1)) for i in range(1, len(groups) - 1)]
    assert np.allclose(fit, want)


# Chat


def test_best_branch_of_a_tree(spark):
    rows = [("t", "a", None, "user", "q", 0.0), ("t", "b", "a", "assistant", "weak", 0.1), ("t", "c", "a", "assistant", "good", 0.9), ("t", "d", "c", "user", "more", None), ("t", "e", "lost", "user", "orphan", 1.0), ("t", "x", "y", "user", "ring", 1.0), ("t", "y", "x", "user", "ring", 1.0)]
    df = spark.createDataFrame(rows, "tree string, id string, parent string, role string, text string, score double")
    got = [(r.leaf, r.depth, r.text) for r in chat.branches(df).orderBy("leaf", "depth").collect()]
    assert got == [("d", 0, "q"), ("d", 1, "good"), ("d", 2, "more"), ("e", 0, "orphan")]
    both = chat.branches(df, top=2)
    assert {r.leaf for r in both.collect()} == {"b", "d", "e"}
    assert chat.branches(df.limit(0)).count() == 0


def test_long_thread(spark):
    rows = [("t", str(i), str(i - 1) if i else None, "user" if i % 2 else "assistant", f"m{i}", 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "tree string, id string, parent string, role string, text string, score double")
    assert [r.text for r in chat.branches(df).orderBy("depth").collect()] == [f"m{i}" for i in range(300)]


NASTY = ["", "a: b", "</turn>\n### user: x", "\\", "\\\\### ", "###", "\\</turn>\\", "日本 <é>\n:"]


def test_formatting_reads_back(spark):
    rows = [(i % 3, i, ["user", "assistant", "sys:tem\\#"][i % 3 if i % 5 else 1], t) for i, t in enumerate(NASTY * 2)] + [(0, 99, None, None), (0, 99, None, None), (None, 1, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_branches(chat.branches(chat.reply_tree(df)))).collect()
    want = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        want.setdefault("" if c is None else str(c), []).append((role or "", text or ""))
    assert {r.tree: [(t.role, t.text) for t in r.turns] for r in back} == want
    assert {r.tree: r.learned for r in back} == {k: [t for role, t in v if role == "assistant"] for k, v in want.items()}


# Shards


def test_shards(spark):
    rows = [(i, "x" * (i % 50)) for i in range(3000)] + [(None, "a"), (None, None), (7, "x" * 7)]
    tree = sharding.balanced_tree(40)
    got = sharding.assign(docs(spark, rows), tree, sharding.with_shard(tree, 40)).collect()
    assert len(got) == len(rows) and {r.shard for r in got} == set(range(40))
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())
    (r,) = [r for r in got if r.doc_id == 49]
    assert (r["size"], r.text_crc32) == (49 + 16, zlib.crc32(b"x" * 49))
    moved = sum(r.grown_shard == 40 for r in got) / len(got)
    assert 0.01 < moved < 0.045
    assert sharding.assign(docs(spark, []), tree).count() == 0


def test_descent_equals_a_plain_one(spark):
    tree = sharding.Tree((("a", "k", 0, 1.0), ("a", "k", 1, 3.0), ("a", "m", 2, 2.0), ("b", "k", 3, 2.0)))
    kids = tree.children()

    def descend(key):
        node, shard = "root", -1
        while shard < 0:
            draws = []
            for name, weight, s in kids[node]:
                bits = int(hashlib.md5(f"{key}|{name}".encode()).hexdigest()[:12], 16)
                draws.append((-np.log((bits + 0.5) / 2**48) / weight, name, s))
            _, node, shard = min(draws)
        return shard

    df = spark.range(4000).withColumn("s", sharding.place(tree, F.col("id")))
    got = {r.id: r.s for r in df.collect()}
    assert got == {i: descend(i) for i in range(4000)}
    share = Counter(got.values())
    assert all(abs(share[s] / 4000 - w / 8) < 0.03 for _, _, s, w in tree.shards)


def test_movement_stays_in_the_changed_subtree(spark):
    before = sharding.Tree((("a", "k", 0, 1.0), ("a", "m", 1, 1.0), ("b", "k", 2, 1.0), ("c", "k", 3, 1.0)))
    after = sharding.Tree((*before.shards[:3], ("c", "k", 3, 2.0)))
    df = spark.range(3000).select(sharding.place(before, F.col("id")).alias("x"), sharding.place(after, F.col("id")).alias("y"))
    assert {r.y for r in df.where("x != y").collect()} == {3}


def test_written_shards(spark, tmp_path):
    tree = sharding.balanced_tree(8, 2, 2)
    df = docs(spark, [(i, f"t{i}") for i in range(50)])
    sharding.write_shards(df, tree, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    want = {r.doc_id: r.s for r in df.select("doc_id", sharding.place(tree, F.col("doc_id")).alias("s")).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want


# Packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit(lengths):
    bin_of, size = packing.best_fit(lengths, (8, 16, 64))
    used = Counter()
    for i, b in enumerate(bin_of):
        used[b] += lengths[i]
    assert sorted(used) == list(range(len(size)))
    assert all(size[b] == min(c for c in (8, 16, 64) if c >= u) for b, u in used.items())
    # No two bins fit into one of the size of the larger: best fit would have joined them.
    assert sum(u <= 32 for u in used.values()) <= 1 + sum(64 not in (c,) for c in size)


def test_best_fit_is_near_the_bound():
    rng = random.Random(3)
    lengths = [rng.randint(1, 5000) for _ in range(4000)]
    _, size = packing.best_fit(lengths)
    assert sum(size) < 1.03 * sum(lengths)


def plain_best_fit(lengths, capacities):
    """Best fit as it is defined, with plain lists: the open bin with the least room, the last touched among equals."""
    cost, bins, left = packing.cost, [], sorted(lengths, reverse=True)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bin_of, touched = [0] * len(lengths), 0

    def filled(space):
        total, counts = 0, Counter(left)
        for _ in range(64):
            fits = [n for n in counts if n <= space and counts[n]]
            if not fits:
                break
            n = max(fits)
            take = min(space // n, counts[n])
            counts[n] -= take
            total, space = total + take * n, space - take * n
        return total

    for i in order:
        n = lengths[i]
        left.remove(n)
        touched += 1
        open_bins = [b for b in bins if b["size"] - b["used"] >= n]
        if open_bins:
            b = min(open_bins, key=lambda b: (b["size"] - b["used"], -b["at"]))
        else:
            best = None
            for c in sorted(c for c in capacities if c >= n):
                tokens = n + filled(c - n)
                price = cost(min(k for k in capacities if k >= tokens)) / tokens
                if best is None or price < best[0]:
                    best = (price, c)
            b = {"size": best[1], "used": 0, "no": len(bins)}
            bins.append(b)
        b["used"] += n
        b["at"] = touched
        bin_of[i] = b["no"]
    return bin_of, [min(c for c in capacities if c >= b["used"]) for b in bins]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_equals_a_plain_one(lengths):
    assert packing.best_fit(lengths, (8, 16, 64)) == plain_best_fit(lengths, (8, 16, 64))


@settings(max_examples=60, deadline=None)
@given(text=pieces, largest=st.integers(2, 9))
def test_pieces_have_the_tokens_of_the_whole(vocabulary, text, largest):
    count = tokens.counter(vocabulary)
    sizes, cuts = packing.cut(text, largest, count)
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    assert "".join(parts) == text and len(parts) == len(sizes) and all(0 < n <= largest for n in sizes)
    assert sum(sizes) == count([text])[0] + 1
    if max(count.by_run(text), default=0) <= largest:  # no run had to be cut inside
        assert [n - (k == len(sizes) - 1) for k, n in enumerate(sizes)] == count(parts)


def test_pack_by_tokens(spark, vocabulary):
    rows = EDGE + [(100 + i, "word, Don't " * i) for i in range(60)] + [(999, "x" * 30_000)]
    out = packing.pack(docs(spark, rows), (64, 512), block=20, with_text=True, tokenizer=vocabulary).collect()
    t = plain_tokenizer(vocabulary)
    want, seen = Counter(), Counter()
    for i, text in rows:
        want[i] += len(t.encode(text or "", add_special_tokens=False).ids) + 1
    for r in out:
        assert r.n_tokens == sum(p.n_tokens for p in r.pieces) <= r.capacity in (64, 512)
        for p in r.pieces:
            seen[p.doc_id] += p.n_tokens
    assert seen == want


def test_blocks_are_bounded_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "BLOCK_BYTES", 1000)
    batch = pa.RecordBatch.from_pydict({"sizes": [[1]] * 30, "text": ["x" * 300] * 30})
    assert [len(b["sizes"]) for b in packing._blocks(iter([batch]), 1000)] == [3] * 10
    assert [len(b["sizes"]) for b in packing._blocks(iter([batch]), 2)] == [2] * 15


def test_pack(spark):
    rows = EDGE + [(100 + i, "w " * i) for i in range(200)]
    out = packing.pack(docs(spark, rows), (64, 512, 4096), block=50, with_text=True).collect()
    assert len({r.seq_id for r in out}) == len(out)
    seen = Counter()
    for r in out:
        assert r.n_tokens == sum(p.n_tokens for p in r.pieces) <= r.capacity and r.capacity in (64, 512, 4096)
        for p in r.pieces:
            seen[p.doc_id] += p.n_tokens
    want = Counter()
    for i, t in rows:
        want[i] += len((t or "").split()) + 1
    assert seen == want
    words = Counter(w for r in out for w in r.text.split())
    assert words == Counter(w for _, t in rows for w in (t or "").split())
    big = sorted((p.piece, p.start, p.n_tokens) for r in out for p in r.pieces if p.doc_id == 5)
    assert big == [(k, k * 4096, min(4096, 30001 - k * 4096)) for k in range(8)]
    assert packing.pack(docs(spark, [])).count() == 0


def test_a_cut_text_is_whole():
    text = "  a bb\tccc d "
    for size in (1, 2, 3, 4, 5):
        sizes, cuts = packing.cut(text, size)
        assert cuts[0] == 0 and cuts[-1] == len(text) and sorted(cuts) == cuts and sum(sizes) == 5 and len(sizes) == -(-5 // size)
        assert [len(text[a:b].split()) for a, b in zip(cuts, cuts[1:], strict=False)][:-1] == sizes[:-1]
    assert packing.cut("x", 1) == ([1, 1], [0, 1, 1]) and packing.cut("", 4) == ([1], [0, 0])


# Chat, long and odd


def test_chat_of_long_and_odd_conversations(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"m{i} <b> \\") for i in range(3000)] + [(2, 1, "assistant", "long " * 50_000)]
    wide = spark.createDataFrame([(c, t, r, x, "clash", 1.0) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, tree string, score double")
    back = {r.tree: r for r in chat.read_back(chat.format_branches(chat.branches(chat.reply_tree(wide)))).collect()}
    assert [t.text for t in back["1"].turns] == [r[3] for r in rows[:3000]] and back["1"].learned == [r[3] for r in rows[:3000:2]]
    assert back["2"].learned == ["long " * 50_000]
    assert chat.format_branches(chat.branches(chat.reply_tree(wide.limit(0)))).count() == 0
