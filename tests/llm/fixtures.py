"""Documents with nulls, empty and very long texts, ties, repeated rows and columns whose names clash with the operators'."""

import random

from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, shard string, set string, size int"
WORDS = "the of and to tide watch river stone über naïve coöp señor árbol 漢字 слово don't it's x1 99 a,b! (c) tab\tbed <s> [INST] <|endoftext|> ▁ ﬁne e\u0301a \u00a0nb".split(" ")


def prose(rng: random.Random, n: int, words=WORDS) -> str:
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(n))


def rows(seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    texts = [None, "", " ", "\n\n", "one", "two words", "a b c d", "a b c d e", "▁▁ x", "\u00a0", "x" * 5000, "ab " * 3000, "<|endoftext|>", "  lead", "trail  ", "a\x00b", "\t\n\v\f\r", "🙂 emoji 🙂🙂"]
    texts += [prose(rng, rng.randrange(1, 400)) for _ in range(30)]
    base = prose(rng, 300)
    texts += [base, base, base.replace("river", "lake", 1), base[: len(base) // 2] + " cut", prose(rng, 4000)]
    out = [(i, t, rng.choice(["en", "de", None, "xx"]), "s", len(t or ""), "clash", "clash", "clash", 1) for i, t in enumerate(texts)]
    out += [out[30], out[30], (None, texts[31], "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (None, "only here and nowhere else at all", "en", None, 1, None, None, None, 2)]
    rng.shuffle(out)
    return out


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))


def got(df, *columns):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def wanted(items):
    return sorted((tuple(x) for x in items), key=lambda r: tuple((x is not None, x) for x in r))
