"""Manifests, nearest neighbours and token alignment against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, empty, rows
from tidewatch.llm import alignment, ann, common, merkle

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
H = lambda x: hashlib.sha256(x.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    """(before, after) of each level."""
    for nodes in tree[:-1]:
        a = i // 3 * 3
        yield "".join(nodes[a:i]), "".join(nodes[i + 1 : a + 3])
        i //= 3


def manifest(table):
    def leaf(r, text):
        return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text)))

    by = defaultdict(list)
    for r in table:
        by[r[3]].append((r[0] is not None, r[0], leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, key, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = [*siblings(trees[s], i), *siblings(top, k)]
            now = leaf(r, r[1] if r[1] is None or key is None or zlib.crc32(str(key).encode()) % 2 else r[1].replace("\n", ""))
            for a, b in steps:
                now = H(a + now + b)
            out.append((key, own, trees[s][-1][0], top[-1][0], H("".join(a + b for a, b in steps)), now, now == top[-1][0]))
    return out


def some(n=60):
    out = rows()
    for i in range(n):
        out.append((1000 + i, f"a\nb {i}" if i % 3 else f"c {i}", None, ["hot", "", None, "é", "z"][0 if i % 2 else i % 5], i, None, None, None, None))
    return out


@pytest.mark.parametrize("small", [common.SMALL, 40])
def test_manifest(spark, monkeypatch, small):
    monkeypatch.setattr(merkle, "SMALL", small)  # few nodes are broadcast, most proofs come by a shuffle
    table = some()
    have = merkle.prove(documents(spark, table), changed=merkle.newline_free()).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, have), key=key) == sorted(manifest(table), key=key)
    assert {x.verified for x in have} == {True, False}
    assert all(x.verified for x in merkle.prove(documents(spark, table)).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 800])
def test_manifest_of_one_group(spark, n):
    table = [(i, f"t{i}", "en", "only", 1, None, None, None, None) for i in range(n)]
    have = merkle.prove(documents(spark, table)).collect()
    assert sorted(map(tuple, have)) == sorted((*r[:5], r[3], True) for r in manifest(table))


def test_nothing_to_prove_or_align(spark):
    assert merkle.prove(empty(spark), changed=merkle.newline_free()).collect() == []
    assert alignment.align(empty(spark), A, B).collect() == []
    vectors = spark.createDataFrame([(0, None), (50, [0.0, 0.0]), (100, [float("nan"), 1.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(vectors).collect() == []
    assert ann.nearest(vectors.limit(0)).collect() == []


def cosines(table, k=5):
    use = {(i, tuple(np.float32(v).tolist())) for i, v in table if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q, u in use:
        if q % 50 == 0:
            scores = [(-(np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v))), i) for i, v in use if i != q]
            out[q] = sorted(scores)[:k]
    return out


def vectors(n=700, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal(16)
    table = [(i, [float(x) for x in np.float32(centre + 0.02 * rng.standard_normal(16) if i % 3 == 0 else rng.standard_normal(16))]) for i in range(n)]
    table += [(n + i, table[5][1]) for i in range(40)]  # equal vectors
    table += [table[7], (5000, table[5][1]), (5050, None), (5100, [0.0] * 16), (5150, [1.0] * 15), (5200, [1.0, None] + [0.0] * 14), (None, table[1][1]), (5250, [float("inf")] * 16)]
    return table


@pytest.mark.parametrize("group", [ann.GROUP, 16])
def test_neighbours(spark, monkeypatch, group):
    monkeypatch.setattr(ann, "GROUP", group)
    table = vectors()
    frame = spark.createDataFrame([(i, v, "clash", "clash") for i, v in table], "vec_id long, embedding array<float>, score string, leaves string")
    want = cosines(table)
    exact = defaultdict(list)
    for r in ann.nearest(frame, leaf=32, slack=1.0).orderBy("query_id", "rank").collect():
        exact[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(exact) == set(want)
    for q, found in exact.items():
        assert [x[0] for x in found] == list(range(1, 6))
        assert np.allclose([x[2] for x in found], [-s for s, _ in want[q]], atol=1e-12)
    # equal vectors: ties go to the smaller id, and the query itself is left out
    assert [x[1] for x in exact[5000]] == [5, 700, 701, 702, 703]
    assert [x[1] for x in exact[700]] == [5, 701, 702, 703, 704]
    near = ann.nearest(frame, leaf=32).collect()
    hits = sum(any(r.score >= -s - 1e-12 for s, _ in want[r.query_id][-1:]) for r in near)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(frame).orderBy("rank").collect()] == [(0, 1, 1, 0.707107), (0, 2, 2, 0.0)]
    text = spark.createDataFrame([("q", [1.0, 0.0]), ("a", [1.0, 1.0])], "name string, v array<double>")
    assert [r.name for r in ann.nearest(text, F.col("name") == "q", id_col="name", vector_col="v").withColumnRenamed("vec_id", "name").collect()] == ["a"]


def aligned(table):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own, names = alignment.byte_of(), {i: x for x, i in a.get_vocab().items()}
    texts, counts = [], Counter()
    for key, text in table:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xs = [bytes(own[c] for c in names[i]) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or not b"".join(xs) == b"".join(ys) == (" " + text).encode():
            texts.append((key, [], [], [], []))
            continue
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (xs, ys)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        group = lambda ids, stop: [[i for i, e in zip(ids, stop) if lo < e <= hi] for lo, hi in zip([0, *cuts], cuts)]
        links = [(i, j) for i, e, t in zip(x, ends[0], xs) for j, f, u in zip(y, ends[1], ys) if e - len(t) < f and f - len(u) < e]
        counts.update(set(links))
        texts.append((key, x, y, list(zip(group(x, ends[0]), group(y, ends[1]))), links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    for key, x, y, groups, links in texts:
        told = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        yield key, len(x), len(y), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), H(told) if x else ""


ODD = ["\n  two\n\n three", "a b 　c d", "▁", "x ▁y", "tab\tand  \n", " ", "   lead", "don't we'll'S", "emoji 🙂🙃x", "漢字かな交じり", "İ̀ é", "a\x00b\x1cc\x1fd\x85e", "<|endoftext|> <s></s><unk> <0x0A>", "1234567 89.5%", "x" * 700, "ſ's", "﻿bom", "\r\n\r\n"]


@pytest.mark.parametrize("hot", [alignment.HOT, 5, 0])
def test_alignment(spark, hot):
    table = [(r[0], r[1]) for r in rows()] + [(2000 + i, x) for i, x in enumerate(ODD)]
    have = alignment.align(documents(spark, [(k, t, None, None, None, "clash", "clash", None, None) for k, t in table]), A, B, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken") if hot else None, hot=hot)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, have.collect()), key=key) == sorted(aligned(table), key=key)


def test_groups_of_a_text(monkeypatch):
    one = alignment.groups("naïve tokens", A, B)
    assert [sum((g[s] for g in one), []) for s in (0, 1)] == [alignment.aligner(A, B).a.encode(" naïve tokens").ids, alignment.aligner(A, B).b.encode("naïve tokens")]
