import hashlib
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.fixtures import documents, empty, got, prose, rows, wanted
from tidewatch.llm import jaccard_join, lyndon, suffix_dedup
from tidewatch.llm.common import Work
from tidewatch.llm.components import components


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 7, 50])
        x = [rng.randrange(k) for _ in range(rng.randrange(0, 60))]
        assert lyndon.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])
    for x in (b"mississippi", b"abab" * 30, b"a" * 100, bytes(range(255, -1, -1))):
        assert lyndon.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_repeated():
    rng = random.Random(2)
    for _ in range(300):
        x = [rng.randrange(2) for _ in range(40)]
        starts = sorted(rng.sample(range(40), 20))
        runs = Counter(tuple(x[s : s + 4]) for s in starts if s + 4 <= 40)
        assert lyndon.repeated(x, starts, 4) == [s + 4 <= 40 and runs[tuple(x[s : s + 4])] > 1 for s in starts]


def cut(texts, length):
    """For each text of bytes: its runs under windows that start anywhere else too."""
    seen = Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    return [suffix_dedup.cover([(i, i) for i in range(len(x) - length + 1) if seen[x[i : i + length]] > 1], length) for x in texts]


def corpus(seed, n=40):
    rng = random.Random(seed)
    shared = [prose(rng, rng.randrange(3, 30)) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else prose(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(0, 6))]
        out.append("".join(parts))
    return out + ["é" * 100, "é" * 70 + "x", "ab" * 120, "aab" * 50, out[3], "", None]


@pytest.mark.parametrize(("length", "gram", "step", "most"), [(40, 8, 8, 8192), (40, 16, 16, 2), (64, 32, 5, 4), (25, 4, 1, 8192)])
def test_repeats_against_brute_force(spark, length, gram, step, most):
    texts = corpus(length + step)
    raw = [(x or "").encode() for x in texts]
    want = []
    for i, (x, spans) in enumerate(zip(raw, cut(raw, length))):
        edges = [0, *(y for s in spans for y in s), len(x)]
        kept = b"".join(x[a:b] for a, b in zip(edges[::2], edges[1::2]))
        want.append((i, len(x), len(x) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    df = spark.createDataFrame([(i, x, 1, "clash") for i, x in enumerate(texts)], "doc_id long, text string, key int, t1 string").repartition(3)
    assert got(suffix_dedup.digest(df, length=length, gram=gram, step=step, most=most), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == wanted(want)


def test_cover_of_arrays():
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        own = [(x, x + rng.randrange(0, 4)) for x in (rng.randrange(60) for _ in range(rng.randrange(0, 12)))]
        first, last = (np.array([x[i] for x in own], np.int64) for i in (0, 1))
        assert suffix_dedup.covered(first, last, 5) == suffix_dedup.cover(own, 5)


def test_words_of_passages(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (8, 9, 10, 15, 40)]
    texts = [" ".join(rng.choice(shared) if rng.random() < 0.5 else text(rng.randrange(1, 12)) for _ in range(rng.randrange(0, 6))).replace(" ", rng.choice([" ", "\n", "  "])) for _ in range(40)]
    texts += [texts[3], texts[4] + " ", "", None, text(9), "a b " * 20]
    words = [(x or "").split() for x in texts]
    seen = Counter(tuple(w[i : i + 25]) for w in words for i in range(len(w) - 24))
    want = [(k, len({i + j for i in range(len(w) - 24) if seen[tuple(w[i : i + 25])] > 1 for j in range(25)})) for k, w in enumerate(words)]
    assert len({n for _, n in want}) > 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert got(suffix_dedup.digest(df, words=25), "doc_id", "n_passage_words") == wanted(want)


def test_repeat_edges(spark):
    out = suffix_dedup.digest(documents(spark))
    raw = [(r[1] or "").encode() for r in rows()]
    want = []
    for r, x, spans in zip(rows(), raw, cut(raw, 400)):
        edges = [0, *(y for s in spans for y in s), len(x)]
        kept = b"".join(x[a:b] for a, b in zip(edges[::2], edges[1::2]))
        want.append((r[0], len(x), len(x) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == wanted(want)
    assert suffix_dedup.digest(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.digest(empty(spark), gram=60)


def test_runs_across_parts(monkeypatch):
    import numpy as np

    b = np.frombuffer(prose(random.Random(3), 900).encode(), np.uint8)
    whole = suffix_dedup.runs(b, 60, 8)
    monkeypatch.setattr(suffix_dedup, "PART", 100)
    assert suffix_dedup.runs(b, 60, 8) == whole
    assert [x[2] for x in whole[1:]] == [x[3] + 1 for x in whole[:-1]] and whole[-1][3] == len(b) - 60


@pytest.mark.parametrize("part", [1, 7, 100, 1 << 22])
@pytest.mark.parametrize("gram", [4, 16])
def test_runs_of_many_texts_in_one_pass(monkeypatch, gram, part):
    import numpy as np

    rng = random.Random(part + gram)
    texts = [x.encode()[: rng.choice([39, 40, 41, 400])] for x in corpus(part) if x is not None] + [b"", b"a" * 39, b"a" * 40, b"a" * 300]
    bounds = np.cumsum([0, *map(len, texts)])
    want = [(key, a + at, low + at, high + at) for x, at in zip(texts, bounds.tolist()) if len(x) >= 40 for key, a, low, high in suffix_dedup.runs(np.frombuffer(x, np.uint8), 40, gram)]
    monkeypatch.setattr(suffix_dedup, "PART", part)
    calls, hashes = [], suffix_dedup.gram_hashes
    monkeypatch.setattr(suffix_dedup, "gram_hashes", lambda *x: calls.append(1) or hashes(*x))
    assert list(zip(*(x.tolist() for x in suffix_dedup.run_columns(np.frombuffer(b"".join(texts), np.uint8), bounds, 40, gram)))) == want
    assert part < 1 << 22 or len(calls) == 1


def test_windows_that_repeat_are_told_as_ranges():
    assert [suffix_dedup.stretches(x) for x in (0, 1, 0b1101110, (1 << 70) - 1)] == [[], [(0, 0)], [(1, 3), (5, 6)], [(0, 69)]]
    same = [(b"abc", b"xyz", [(1, 2, 10), (3, 4, 0)])]  # two runs with one block, of 4 windows of 4 symbols
    near = [(b"abc", b"xyz", [(5, 6, 0)]), (b"bbc", b"xyy", [(7, 8, 20)])]  # alike from the second window to the third
    assert sorted(suffix_dedup.mark([same, near], 4)) == [(1, 2, 10, 13), (3, 4, 0, 3), (5, 6, 1, 2), (7, 8, 21, 22)]


def test_cut_texts_keep_whole_characters(spark):
    same = "é" * 40
    df = spark.createDataFrame([(1, "x" + same + "end", 3, "k"), (2, "yé" + same, 4, "k"), (3, None, None, None), (4, "short", 5, "k")], "doc_id long, text string, n_chars long, __kept2 string")
    out = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.cut_repeats(df, length=20, gram=8, step=4).collect()}
    assert out == {1: ("xend", 4), 2: ("y", 1), 3: (None, None), 4: ("short", 5)}


@pytest.mark.parametrize("n", [51, 55, 60])
def test_pipeline_cuts_passages_of_over_fifty_short_words(spark, n):
    rng = random.Random(n)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    text = lambda m, k: " ".join(word(k) for _ in range(m))
    shared, line = text(n, 2), text(20, 6)  # the line repeats too, but is no passage of over 50 words
    assert len(shared) < 400
    around = [(text(90, 7), text(80, 7)) for _ in range(6)]
    alone = text(150, 7) + " " + line
    texts = [f"{a} {shared if i % 2 else shared.replace(' ', chr(10), 3)} {b} {line}" for i, (a, b) in enumerate(around)]
    texts[4] = f"{around[4][0]} é{shared}x {around[4][1]}"  # glued to other letters on both sides
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, alone, "few words only", "", line, line])] + [(99, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_strings(spark, df, "").collect()}
    for i, (a, b) in enumerate(around):
        left = f"{a} é{shared.split()[0]}  {shared.split()[-1]}x {b}" if i == 4 else f"{a}  {b} {line}"
        assert out[i] == (left, len(left))
    assert out[9][0] == out[10][0] == line  # copies of fewer words and bytes
    assert out[6][0] == alone and out[7][0] == "few words only" and out[8][0] == "" and out[99][0] is None


# -- joins --


def brute_classes(texts):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for x in texts:
        w = [y for y in (x or "").translate(upper).encode().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(sets)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                group[y] = x
    return sets, [find(i) for i in range(len(sets))]


def brute_links(sets):
    """For each set the number of others that it links with."""
    return [sum(1 for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b)) for i, a in enumerate(sets)]


@pytest.mark.parametrize(("block", "load"), [(jaccard_join.BLOCK, jaccard_join.LOAD), (2, 300)])
def test_links_against_brute_force(spark, block, load):
    rng = random.Random(11)
    base = [[rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(5, 120))] for _ in range(12)]
    texts = ["", None, "one two", "ONE  two", "one two three", "a b c d e", "A B c d E"]
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice("abcdefghij")
        texts.append(rng.choice([" ", "\n"]).join(w + (["tail"] if rng.random() < 0.2 else [])))
    sets, group = brute_classes(texts)
    df = spark.createDataFrame([(i, x, "clash", 2) for i, x in enumerate(texts)], "doc_id long, text string, set string, size int").repartition(3)
    out = jaccard_join.link(df, sketch_bits=8, block=block, load=load)
    assert got(out, "doc_id", "n_shingles", "component_id", "n_links") == wanted((i, len(s), g, n) for i, (s, g, n) in enumerate(zip(sets, group, brute_links(sets))))
    kept = jaccard_join.keep_one(df, sketch_bits=8)
    assert kept.columns == df.columns
    assert got(kept, "doc_id") == wanted((g,) for g in set(group))


def test_link_edges(spark):
    data = [r for r in rows() if r[0] is not None]
    out = jaccard_join.link(documents(spark), sketch_bits=8)
    sets, group = brute_classes([r[1] for r in data])
    least = defaultdict(list)
    for r, g in zip(data, group):
        least[g].append(r[0])
    want = Counter((r[0], len(s), min(least[g]) if s else r[0]) for r, s, g in zip(data, sets, group))
    have = Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect() if r.doc_id is not None)
    assert have == want
    nulls = [(r.n_shingles, r.component_id) for r in out.where("doc_id is null").collect()]
    assert len(nulls) == 3 and (0, None) in nulls
    assert jaccard_join.link(empty(spark)).count() == 0
    kept = jaccard_join.keep_one(documents(spark), sketch_bits=8)
    ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and kept.where("doc_id is null").count() == 3


def test_trees_lose_no_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    sets = []
    for size in [200] * 140 + [3000] * 10:
        base = rng.integers(0, 1 << 62, rng.integers(5, size), dtype=np.uint64)
        sets.append(np.unique(base))
        sets.append(np.unique(np.concatenate([base[rng.integers(0, 3) :], rng.integers(0, 1 << 62, rng.integers(0, 4), dtype=np.uint64)])))
    for n in (1020, 1024, 1028, 2050):  # about where bitmaps double
        sets.extend(np.unique(np.append(np.arange(n, dtype=np.uint64) * np.uint64(7919), rng.integers(0, 1 << 62, 9, dtype=np.uint64))) for _ in range(3))
    maps = jaccard_join.bitmaps(sets)
    sizes, comps = np.array([len(x) for x in sets]), rng.integers(0, 200, len(sets))
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (sizes[i] + sizes[j] - n)}
    ids = np.arange(len(sets))
    planted = lambda h: jaccard_join.plant(ids[h], sizes[h], [maps[i] for i in ids[h]], comps[h])
    one = planted(ids >= 0)
    assert len(one) > 2
    for apart in (True, False):
        want = {(i, j) for i, j in linked if not apart or comps[i] != comps[j]}
        found = [(max(a, b), min(a, b)) for x, y in jaccard_join.meet(one, one, 80, apart) for a, b in zip(x.tolist(), y.tolist())]
        assert want <= set(found) and len(found) == len(set(found)) and len(found) < len(want) + 200
        half = ids % 3 > 0
        two = [planted(h) for h in (half, ~half)]
        across = {(max(a, b), min(a, b)) for x, y in jaccard_join.meet(*two, 80, apart) for a, b in zip(x.tolist(), y.tolist())}
        assert {p for p in want if half[p[0]] != half[p[1]]} <= across


def test_lists_of_the_same_sets_are_searched_once(spark):
    """Documents that share a passage but don't link meet in the lists of all its prefix shingles; their pairs are made by few of them."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = " ".join(word() for _ in range(200))
    df = spark.createDataFrame([(i, passage + " " + " ".join(word() for _ in range(52))) for i in range(12)], "doc_id long, text string")
    made = []
    kept = jaccard_join.tree_pairs
    jaccard_join.tree_pairs = lambda *a, **k: made.append(kept(*a, **k)) or made[0]
    try:
        work = jaccard_join.Work.drop
        jaccard_join.Work.drop = lambda self, name="": None
        out = jaccard_join.link(df)
        assert {(r.doc_id, r.component_id, r.n_links) for r in out.collect()} == {(i, i, 0) for i in range(12)}
        pairs = made[0]
        assert pairs.count() == pairs.distinct().count() <= 55
    finally:
        jaccard_join.tree_pairs, jaccard_join.Work.drop = kept, work


def test_a_group_and_its_neighbours_meet_as_components(spark):
    """Texts near a large group of near copies, but not linked with it, don't make a row for each of its members and each shared list."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(516)]
    texts = []
    for changes in [1] * 40 + [13] * 12 + [10] * 4:
        w = list(base)
        for i in rng.sample(range(5, 511), changes):
            w[i] = word()
        texts.append(" ".join(w))
    sets, group = brute_classes(texts)
    assert len(set(group)) == 13
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made, kept, drop = [], jaccard_join.tree_pairs, Work.drop
    jaccard_join.tree_pairs = lambda *a, **k: made.append(kept(*a, **k)) or made[0]
    Work.drop = lambda self, name="": None
    try:
        for load in (jaccard_join.LOAD, 2000):
            out = jaccard_join.link(df, load=load)
            assert got(out, "doc_id", "n_shingles", "component_id", "n_links") == wanted((i, len(s), g, n) for i, (s, g, n) in enumerate(zip(sets, group, brute_links(sets))))
        assert 0 < made[0].count() <= 100
    finally:
        jaccard_join.tree_pairs, Work.drop = kept, drop


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    group = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    out = components(spark.createDataFrame(edges, "u long, v long"), Work(spark, "test"), "c")
    assert got(out, "node", "component") == wanted((x, group[x]) for x in linked)
