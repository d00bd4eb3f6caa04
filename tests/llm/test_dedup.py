"""Line dedup, MinHash, embeddings and components against brute force."""

import itertools
import random

import numpy as np
import pytest

from spanlake.llm import components, embedding_dedup, line_dedup, minhash
from spanlake.llm.common import Workspace

DOCS = "doc_id long, text string, kept string, n_shingles int, component_id string"


def closure(nodes, edges):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (3, 3)]
    df = spark.createDataFrame([*edges, (None, 4), (9, None), *edges[:5]], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(Workspace(spark, "t"), df).collect()}
    linked = {n for e in edges if e[0] != e[1] for n in e}
    assert got == closure(linked, [e for e in edges if e[0] != e[1]])
    assert components.connected_components(Workspace(spark, "t"), spark.createDataFrame([(1, 1)], "a long, b long")) is None


def shingle_set(text, k):
    w = minhash.split_words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_near(docs, k):
    sets = {d: shingle_set(t, k) for d, t in docs}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in closure(sets, edges).items()}


def mutated(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(spark, k):
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(3000)]
    docs, ids = [], itertools.count(1000)
    for size in (1, 1, 2, 3, 60):  # the large group straddles the threshold: copies of copies with 1 to 7 words changed
        base = rng.choices(vocab, k=120)
        docs += [(next(ids), mutated(rng, base, rng.randrange(8) if size > 1 else 0)) for _ in range(size)]
    same = " ".join(rng.choices(vocab, k=50))
    docs += [(next(ids), same) for _ in range(20)] + [(next(ids), same.upper()), (next(ids), same.replace(" ", " \n\t"))]
    docs += [(next(ids), "a b c"), (next(ids), "a b c"), (next(ids), "A  b\tc"), (next(ids), ""), (next(ids), " \n"), (next(ids), "x"), (next(ids), "é É")]
    chain = rng.choices(vocab, k=200)
    for i in range(6):
        docs.append((next(ids), " ".join(chain[i * 10 : 150 + i * 10])))
    docs.append((next(ids), " ".join(rng.choices(vocab, k=20_000))))
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in docs], DOCS).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, minhash.NearDup(words=k)).collect()}
    assert got == {d: (n, c, d == c) for d, (n, c) in brute_near(docs, k).items()}


def test_near_duplicates_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert minhash.near_duplicates(empty).collect() == [] and minhash.keep_one(empty).columns == empty.columns
    t = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, t, None, None, None), (1, t, None, None, None), (2, t, "k", 3, ""), (None, t, "n", 1, ""), (None, None, "m", 1, ""), (4, None, "", 1, ""), (5, None, "", 1, "")], DOCS)
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (None, 4, None, True), (None, 0, None, True), (4, 0, 4, True), (5, 0, 5, True)], key=str)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 4, 5]


def test_all_texts_of_a_repeated_id_are_linked(spark):
    """The links of every text of an id count, whichever of them its class stands for; rows without words go with the id."""
    rng = random.Random(4)
    a, b, c = (rng.choices([f"w{i}" for i in range(500)], k=60) for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "changed"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (0, near(c)), (4, ""), (4, None), (5, "alone"), (5, "alone"), (6, "")]
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], DOCS).repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    want = {1: 1, 2: 1, 3: 1, 4: 0, 0: 0, 5: 5, 6: 6}
    assert got == sorted((d, want[d], d == want[d]) for d, _ in rows)


def test_components_go_on_from_known_ones(spark):
    rng = random.Random(5)
    first, more = ([(rng.randrange(80), rng.randrange(80)) for _ in range(n)] for n in (30, 25))
    df = lambda e: spark.createDataFrame(e, "a long, b long")
    ws = Workspace(spark, "t")
    got = components.extended_components(ws, components.connected_components(ws, df(first)), df(more))
    edges = [e for e in first + more if e[0] != e[1]]
    assert {r.node: r.component for r in got.collect()} == closure({n for e in edges for n in e}, edges)


def test_prefix_join_alone_is_exact(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(40)]
    sets = {i: sorted(rng.sample(range(60), rng.randrange(4, 30))) for i in range(60)}
    sets |= {100 + i: sets[i] + [1000 + i] for i in range(20)}
    df = spark.createDataFrame(list(sets.items()), "rep long, s array<long>")
    comp = spark.createDataFrame([(i, i) for i in sets], "rep long, c long")
    p = minhash.NearDup()
    found = minhash._linked(minhash._prefix_pairs(df, comp, p), df, p)
    want = {(max(a, b), min(a, b)) for a, b in itertools.combinations(sets, 2) if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert {tuple(r) for r in found.collect()} == want and len(want) >= 10 and vocab


def brute_lines(docs, p):
    """Windows, grams and minima told anew, over line texts."""
    first, plan = {}, {}
    for d, t in sorted(docs):
        lines = [(i, x.strip()) for i, x in enumerate((t or "").split("\n")) if x.strip()]
        n = [len(x.split()) for _, x in lines]

        def end(i, least):
            total = 0
            for j in range(i, len(lines)):
                total += n[j]
                if total >= least:
                    return j + 1
            return None

        grams = {i: (end(i, p.gram_words), tuple(x for _, x in lines[i : end(i, p.gram_words)])) for i in range(len(lines)) if end(i, p.gram_words)}
        hashes = dict(zip(*[a.tolist() for a in line_dedup.grams(line_dedup.line_hashes([(i, x, k) for (i, x), k in zip(lines, n)]), np.array(n, np.int64), p)])) if lines else {}
        chosen = set()
        for i in range(len(lines)):
            stop = end(i, p.window_words)
            if stop:
                inside = [j for j in range(i, stop) if j in grams and grams[j][0] <= stop]
                if inside:
                    low = min(hashes[j] for j in inside)
                    chosen.add(max(j for j in inside if hashes[j] == low))
        plan[d] = (lines, chosen, grams)
        for j in sorted(chosen):
            first.setdefault(grams[j][1], (d, j))
    out = {}
    for d, t in docs:
        lines, chosen, grams = plan[d]
        gone = set()
        for j in chosen:
            other, k = first[grams[j][1]]
            if (other, k) != (d, j):
                for step in (-1, 1):
                    a, b = j, k
                    while 0 <= a < len(lines) and 0 <= b < len(plan[other][0]) and lines[a][1] == plan[other][0][b][1]:
                        gone.add(lines[a][0])
                        a, b = a + step, b + step
        out[d] = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 3, 6, 12, 30]))) + f" {i}" for i in range(60)] + ["", "  "]
    runs = [rng.sample(lines, 6) for _ in range(5)]
    docs = [(i, "\n".join(sum((rng.choice(runs) if rng.random() < 0.5 else [rng.choice(lines)] for _ in range(rng.randrange(8))), []))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[3][1]), (104, "\n".join(["same line with eleven words a b c d e f g"] * 30)), (105, "\n".join(f"line {i % 7} of many words a b c d e f g" for i in range(1500)))]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, gone int").repartition(3)
    for p in (line_dedup.Winnow(), line_dedup.Winnow(4, 9)):
        got = line_dedup.dedup_lines(df, p, count_col="n")
        assert got.columns == ["doc_id", "text", "gone", "n"]
        assert {r.doc_id: r.text for r in got.collect()} == brute_lines(docs, p)


def test_long_repeats_always_go_and_clean_texts_stay(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passage = "\n".join(fresh(9) for _ in range(7))  # 63 words in short lines
    docs = [(i, f"{fresh(30)}\n{passage}\n{fresh(30)}") for i in range(10)] + [(50, fresh(500))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1] and got[50] == docs[-1][1]
    assert all(passage not in got[i] and len(got[i].split()) == 60 for i in range(1, 10))


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    t = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(7, t), (7, t), (None, t), (3, f"{t}\nx")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(df).collect()) == [(0, ""), (3, f"{t}\nx"), (7, ""), (7, "")]


def test_every_repeated_line_goes(spark):
    """Short lines in different surroundings, copies of short texts, and runs that differ from their first place."""
    rng = random.Random(8)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 2, 5, 9, 12, 19, 30]))) for _ in range(80)] + ["", " "]
    docs = [(i, "\n".join([f"own {i}", "hot line", *rng.choices(lines, k=rng.randrange(8)), f"end {i}"])) for i in range(150)] + [(200 + i, "a short copy") for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got, seen = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}, set()
    for d, t in docs:
        want = []
        for x in t.split("\n"):
            if not x.strip() or x.strip() not in seen:
                want.append(x)
            seen.add(x.strip())
        assert got[d] == "\n".join(want)


def test_long_runs_go_by_windows_and_extension(spark, monkeypatch):
    rng = random.Random(9)
    passage = [" ".join(rng.choices("abcdefghijkl", k=rng.randint(3, 7))) + f" p{i}" for i in range(40)]
    docs = [(i, "\n".join([f"own {i}", *passage, f"end {i}", "short"])) for i in range(5)]
    found, extended = [], line_dedup._extended
    monkeypatch.setattr(line_dedup, "_extended", lambda sk, matches, place: found.append((matches.count(), out := extended(sk, matches, place))) or out)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: docs[0][1]} | {i: f"own {i}\nend {i}" for i in range(1, 5)}
    ((n, gone),) = found
    # fewer fingerprints than lines, and the extension deletes the whole run
    assert 0 < n < 4 * 40
    assert {(r.d, i) for r in gone.collect() for i in r.gone} == {(d, i) for d in range(1, 5) for i in range(1, 41)}


def brute_vectors(vectors):
    ok = {i: np.array(v, float) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    pairs = [(a, b) for a, b in itertools.combinations(ok, 2) if ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.9]
    n = {i: 0 for i, _ in vectors}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], c, c == i) for i, c in closure(n, pairs).items()}


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_match_brute_force(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    vectors = [base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.02, 0.25, 0.4]) for _ in range(250)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [float("inf")] * 16), (2005, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df, embedding_dedup.SignTables(block=block, bucket=20)).collect()}
    assert got == brute_vectors(rows)


def test_vectors_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).collect() == []
    one = embedding_dedup.near_vectors(spark.createDataFrame([(4, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0])], schema)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in one if r.vec_id) == [(2, 1, 2, True), (4, 1, 2, False)]


def test_table_sizes_reach_the_wanted_recall():
    for n in (10, 10**4, 10**6, 10**9):
        bits, tables = embedding_dedup.SignTables().sizes(n)
        assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables <= 1e-4


def test_vectors_of_several_lengths(spark):
    """Vectors of each length link among themselves, whatever the longest is."""
    rng = np.random.default_rng(4)
    base = {n: rng.normal(size=(4, n)) for n in (8, 16)}
    rows = [(i * 2 + (n == 16), [float(np.float32(x)) for x in base[n][i % 4] + rng.normal(size=n) * 0.05]) for n in (8, 16) for i in range(40)] + [(500, [1.0] * 17)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()}
    want = {500: (0, 500, True)}
    for n in (8, 16):
        want |= brute_vectors([r for r in rows if len(r[1]) == n])
    assert got == want


def test_maps_read_bounded_runs_of_texts_and_lists():
    import pyarrow as pa

    from spanlake.llm.common import small_slices

    texts = [None, "", "x" * 700, "y" * 5000, *["z" * 400] * 9]
    lists = [None, [], list(range(90)), list(range(900)), *[[1] * 50] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(lists, pa.list_(pa.int64()))], ["text", "lines"])
    for column, rows, size in (("text", texts, 1), ("lines", lists, 8)):
        got = [b.column(column).to_pylist() for b in small_slices([batch, batch.slice(0, 0)], column, 1000)]
        assert [x for run in got for x in run] == rows
        assert all(len(run) == 1 or sum(size * len(x or "") for x in run) <= 1000 for run in got)
