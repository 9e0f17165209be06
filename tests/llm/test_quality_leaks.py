import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, empty, got, prose, rows, wanted
from tidewatch.llm import decontam, pieces, quality

PIECE = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, lang, model, bands=quality.BANDS):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    cover = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    ids = Counter(i for w in words for i in model.encode(w))
    n, n_bytes = sum(ids.values()), sum(k for i, k in ids.items() if model.is_byte(i))
    entropy = -sum(k / n * math.log2(k / n) for k in ids.values()) if n else 0.0
    band = bands.get(lang or "") or bands[quality.script(text or "")]
    kept = not failed and band.keeps(sum(map(len, words)), n, n_bytes, entropy)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed, kept, n, n_bytes, entropy


def test_measures(spark):
    model = pieces.load(PIECE)
    out = quality.score(documents(spark), PIECE)
    names = [x for x, _ in quality.COLUMNS]
    rounded = lambda r: (*r[:-1], round(r[-1], 9))
    assert wanted(map(rounded, got(out, "doc_id", *names))) == wanted(rounded((r[0], *brute(r[1], r[2], model))) for r in rows())
    assert quality.score(empty(spark), PIECE).count() == 0


def test_keep_returns_the_rows_alone(spark):
    df = documents(spark)
    kept = quality.score(df, PIECE, keep=True)
    assert kept.columns == df.columns
    model = pieces.load(PIECE)
    assert got(kept, *df.columns) == wanted(r for r in rows() if brute(r[1], r[2], model)[6])


def test_bands_reject_what_the_vocabulary_cannot_spell():
    rng = random.Random(2)
    words = quality.Words(PIECE)
    clean = " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(200))
    noise = " ".join("".join(chr(rng.randrange(0x1F000, 0x1FA00)) for _ in range(5)) for _ in range(200))
    # Few tokens, but no repeated window of three words.
    dull = " ".join("ab" * (1 + i % 7) if i % 2 else "ba" * (1 + (i * i) % 11) for i in range(60))
    out = quality.measure_all([clean, noise, dull], ["en", "en", None], words, quality.BANDS)
    assert [x[6] for x in out[:2]] == [True, False] and out[1][8] > 0.5 * out[1][7]
    assert out[2][9] < 4.0


def test_repeated_words():
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.randrange(4) for _ in range(rng.randrange(0, 40))]
        g = Counter(zip(ids, ids[1:], ids[2:]))
        want = len({j for i, x in enumerate(zip(ids, ids[1:], ids[2:])) if g[x] > 1 for j in (i, i + 1, i + 2)})
        assert quality.repeated_words(__import__("numpy").array(ids, "int64")) == want


# -- benchmark leaks --


def test_bands_reject_junk_and_keep_prose(spark):
    import base64

    rng = random.Random(6)
    some = lambda make: " ".join(make() for _ in range(80))
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    plain = "In the beginning was the Word and the Word was with God and the Word was God The same was in the beginning with God All things were made by him and without him was not any thing made that was made In him was life and the life was the light of men And the light shineth in darkness"
    greek = "Εν αρχή ήτο ο Λόγος και ο Λόγος ήτο παρά τω Θεώ και Θεός ήτο ο Λόγος Ούτος ήτο εν αρχή παρά τω Θεώ Πάντα δι αυτού έγειναν και χωρίς αυτού δεν έγεινεν ουδέ εν το οποίον έγεινεν Εν αυτώ ήτο ζωή και η ζωή ήτο το φως των ανθρώπων Και το φως εν τη σκοτία φέγγει"
    texts = [
        (1, plain, "en", True), (2, greek, None, True), (3, greek, "en", False),
        (4, some(lambda: base64.b64encode(rng.randbytes(12)).decode()), "en", False), (5, some(lambda: rng.randbytes(8).hex()), None, False),
        (6, some(lambda: of("\ue000\ue001\ue002\ue003\ue123\ue234", 5)), "xx", False), (7, some(lambda: of("🙂🙃😀😁🎉🚀", 3)), None, False), (8, some(lambda: of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 7)), "en", False),
    ]
    df = spark.createDataFrame([x[:3] for x in texts], "doc_id long, text string, lang string")
    out = {r.doc_id: (r.base_failed, r.kept) for r in quality.score(df, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert out == {i: (False, kept) for i, _, _, kept in texts}


def edits(rng, text, k):
    x = list(text)
    for _ in range(k):
        i = rng.randrange(len(x))
        if x[i] != " ":
            x[i] = "#"
    return "".join(x)


def least_edits(pattern, text):
    """Least edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog near the old river bank today."), (2, "Señor Ünal walked   along\nthe árbol for naïve reasons, and then he left at once for good."), (3, "too short"), (4, None), (5, "z" * 700), (6, "0123456789 " * 60)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    fill = lambda n: prose(rng, n, "some other words that tell nothing of the kind".split())
    docs, want = [], []
    for i in range(80):
        item = rng.choice(ITEMS[:2])
        body = decontam.normal(item[1])
        k = rng.randrange(0, 9)
        text = f"{fill(20)} {edits(rng, body, k)} {fill(20)}"
        docs.append((i, text))
        allowed = {n: len(decontam.normal(t)) * decontam.EDITS // 100 for n, t in ITEMS[:2]}
        hits = sorted((e, n) for n, t in ITEMS[:2] if (e := least_edits(decontam.normal(t), decontam.normal(text))) <= allowed[n])
        want.append((i, bool(hits), len(hits), hits[0][1] if hits else None, hits[0][0] if hits else None))
    items = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, n_items int")
    df = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    for limit in (decontam.BLOCK, 300):  # in one pass, and in blocks
        assert got(decontam.find_leaks(df, items, limit=limit), "doc_id", "contaminated", "n_items", "item_id", "edits") == wanted(want)
    assert got(decontam.find_leaks(df, items, keep=True), "doc_id") == wanted((x[0],) for x in want if not x[1])


def test_leak_edges(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = {r.doc_id: r for r in decontam.find_leaks(documents(spark), items).collect()}
    assert not any(r.contaminated for r in out.values())  # "too short" is in none of them
    long = spark.createDataFrame([(1, "a " + "z" * 800), (2, "z" * 300), (3, ITEMS[5][1][5:640]), (4, None), (5, ITEMS[5][1][5:600])], "doc_id long, text string")
    hit = {r.doc_id: (r.contaminated, r.item_id) for r in decontam.find_leaks(long, items).collect()}
    assert hit == {1: (True, 5), 2: (False, None), 3: (True, 6), 4: (False, None), 5: (False, None)}  # whole items, within their edits
    half = spark.createDataFrame([(1, ITEMS[5][1][:400])], "doc_id long, text string")
    assert not decontam.find_leaks(half, items).first().contaminated
    assert decontam.find_leaks(empty(spark), items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(documents(spark), none).where("contaminated").count() == 0


def test_short_null_and_repeated_items(spark):
    items = [(None, "a wholly nameless item of forty and more characters"), (None, "too short"), (7, "Why?"), (7, "who is the man there"), (8, "who is the man there"), (9, ""), (10, " \n"), (7, "Why?")]
    docs = [(1, "so why? because"), (2, "so whywhy? because"), (3, "who is  the man\nthere"), (4, "who is the man thereof"), (5, "who is the men there"), (6, "TOO SHORT"), (7, "it is a wholly nameless item of forty and more characters and too short, why?"), (8, None), (8, "why?")]
    want = [(1, True, 1, 7, 0), (2, False, 0, None, None), (3, True, 2, 7, 0), (4, True, 2, 7, 0), (5, True, 2, 7, 1), (6, True, 1, None, 0), (7, True, 2, 7, 0), (8, False, 0, None, None), (8, True, 1, 7, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    held = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontam.BLOCK, 30):
        assert got(decontam.find_leaks(df, held, limit=limit), "doc_id", "contaminated", "n_items", "item_id", "edits") == wanted(want)
    assert got(decontam.find_leaks(df, held, keep=True), "doc_id") == [(2,), (8,)]


def test_short_items_have_their_edits(spark):
    """All items of 10 to 60 characters with as many edits as the rule allows, glued to letters or not, and none with one more."""
    rng = random.Random(8)
    items = [(f"i{n:02}", "".join(rng.choice("abcdefghijklmnop") for _ in range(n))) for n in range(10, 61)]
    docs = [(f"{k}{glue}{over}", f"{'some text before':>30}{glue}{body}{glue}and after it") for k, t in items for glue in (" ", "q") for over in (0, 1) for body in ["".join("z" if i in set(range(3, len(t), 7)[: len(t) * 5 // 100 + over]) else c for i, c in enumerate(t))]]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    out = decontam.find_leaks(df, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {r.doc_id: r.item_id for r in out} == {d: (d[:3] if d.endswith("0") else None) for d, _ in docs}


def test_places_do_not_depend_on_the_order_of_rows(spark):
    text = "x" * 40 + " the river of stones ran slowly past the tall old mill house " + "y" * 40 + " a second text of the same item that is here as well for all to see"
    both = ["the river of stones ran slowly past the tall old mill house", "a second text of the same item that is here as well for all to see"]
    found = [decontam.Patterns([(1, x) for x in some]).find(text) for some in (both, both[::-1])]
    assert found[0] == found[1] == [(1, 0, 41, 100)]


@pytest.mark.parametrize("q", [1, 2, 3, 5, 8, 12, 13])
def test_grams(q):
    c = decontam.codes("abracadabra abracadabra")
    g = decontam.grams(c, q)
    text = "abracadabra abracadabra"
    assert len(g) == len(text) - q + 1
    assert len(set(g.tolist())) == len({text[i : i + q] for i in range(len(g))})


def test_align():
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("ab ") for _ in range(60))
        at = rng.randrange(0, 30)
        pattern = edits(rng, text[at : at + 25], rng.randrange(0, 3))
        found = decontam.align(decontam.codes(pattern), decontam.codes(text), -30, 100, 25)
        assert found and found[0] == least_edits(pattern, text)
        assert least_edits(pattern, text[found[1] : found[2]]) == found[0]


def test_columns_of_our_own_names_stay(spark):
    from tidewatch.llm import suffix_dedup

    long = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(1, long, "keepme", "a", "b", "c"), (2, long + " more", "this", "d", "e", "f"), (3, "short", "too", "g", "h", "i")], "doc_id long, text string, __lang string, __t1 string, __t2 string, __KEPT string")
    own = ["doc_id", "__lang", "__t1", "__t2", "__KEPT"]
    assert got(suffix_dedup.cut_repeats(df), *own) == got(df, *own)
    kept = quality.score(df.withColumn("text", F.lit(long)), PIECE, keep=True)
    assert kept.columns == df.columns and got(kept, *own) in (got(df, *own), [])
