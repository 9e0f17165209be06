import hashlib
from pathlib import Path

import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.fixtures import got, wanted
from tests.llm.test_quality_leaks import ITEMS, brute
from tests.llm.test_repeats_joins import brute_classes, cut
from tidewatch.llm import decontam, pieces
from tidewatch.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("bdlnrstv") for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, docs = text(110), []
    for i in range(40):
        t = text(rng.randrange(60, 200))
        docs.append(t if i % 4 else f"{t} {shared} {text(90)}")
    docs += [docs[1], docs[2] + " more", "short one", None, "", "same words again " * 60, f"{text(60)} {ITEMS[0][1]} {text(40)}", f"{text(80)} {ITEMS[1][1].upper()}"]
    base = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, docs


def test_stages_against_brute_force(spark, folder):
    base, docs = folder
    model = pieces.load(public_tokenizers.path(corpus_pipeline.PIECES))
    left = {i: t for i, t in enumerate(docs) if brute(t, "en", model)[6]}
    _, group = brute_classes(list(left.values()))
    left = {i: t for k, (i, t) in enumerate(left.items()) if group[k] == k}
    spans = cut([t.encode() for t in left.values()], 400)
    for (i, t), own in zip(list(left.items()), spans):
        edges = [0, *(y for s in own for y in s), len(t.encode())]
        left[i] = "".join(t.encode()[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2]))
    patterns = decontam.Patterns(ITEMS)
    kept = {i: t for i, t in left.items() if not any(decontam.normal(x[1]) in decontam.normal(t) for x in ITEMS[:2])}
    assert {i for i in left if not patterns.find(left[i])} == set(kept) and len(kept) < len(left) < len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in kept.items():
        ids = model.encode(t)
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    assert any(own for own in spans)
    assert got(corpus_pipeline.run(spark, base), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == wanted(want)


def test_stages_keep_the_columns(spark, folder):
    base, _ = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, base)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, base).count() == 0


def test_every_operator_has_a_query():
    assert {x.split("_")[0] for x in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_operators_swallow_no_import_error():
    root = Path(corpus_pipeline.__file__).parent
    for p in [root / "corpus_pipeline.py", *(root / "tidewatch" / "llm").glob("*.py")]:
        assert "ImportError" not in p.read_text()
