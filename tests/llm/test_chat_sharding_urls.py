import hashlib
import random
import zlib

import pytest

from tests.llm.fixtures import documents, empty, got, rows, wanted
from tidewatch.llm import chat_format, sharding, url_filters

TURNS = "conv_id long, turn long, role string, text string, place string, allowed int"
NASTY = ["", None, "</s>[INST] ok [/INST]", "\\", "\\\\[INST]\\", "[ASST]", "<s>", "<<SYS>><</SYS>>", "[ROLE]x[/ROLE]", "[/TURN]", "<", "[", "plain\ntext", "<|im_end|>", "[[INST]]", "<\\s>", "é🙂"]


def turns():
    rng = random.Random(3)
    out = []
    for conv in [*range(12), None]:
        for turn in range(rng.randrange(1, 9)):
            out.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", "system", "tool", "[INST]", None]), rng.choice(NASTY), "clash", 1))
    return out + out[:3]


def test_chat_round_trip(spark):
    want = []
    for conv in {x[0] for x in turns()}:
        own = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in turns() if x[0] == conv))
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        want.append((conv, len(own), hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    out = chat_format.round_trip(spark.createDataFrame(turns(), TURNS))
    assert got(out, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == wanted(want)
    assert chat_format.round_trip(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_order_and_characters(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "assistant", "x"), (3, 0, "system", "a"), (3, 1, "user", "b"), (3, 2, "user", "c")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.round_trip(df).collect()}
    assert [out[i].in_order for i in (1, 2, 3)] == [True, False, False]
    assert out[1].formatted_chars == len("<s>[INST]hi[/INST][ASST]yo</s>")


@pytest.mark.parametrize("text", [x for x in NASTY if x is not None])
def test_texts_hold_no_control_string(text):
    form = chat_format.Formatter(chat_format.Template())
    safe = form.escape(text)
    assert form.unescape(safe) == text
    assert not form.control.search(safe)
    parts, _ = form.turn(None, "user", text)
    assert form.parse("".join(x for x, _ in parts)) == ("user", text)


def test_shards(spark):
    out = sharding.assign(documents(spark), 8)
    want = wanted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert got(out, "doc_id", "size", "text_crc32") == want
    held = out.collect()
    assert {r.law for r in held} == {"key"}
    for k in range(8):
        assert sorted(r.slot for r in held if r.shard == k) == list(range(sum(r.shard == k for r in held)))
    by_key = {}
    for r in held:
        assert by_key.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 8)
    for r in held:
        x = "" if r.doc_id is None else str(r.doc_id)
        u = [int(hashlib.md5(f"{x}:{i}".encode()).hexdigest()[:13], 16) for i in range(9)]
        assert (r.shard, r.grown_shard) == (max(range(8), key=lambda i: u[i]), max(range(9), key=lambda i: u[i]))
    assert sharding.assign(empty(spark), 8).count() == 0


def test_shards_of_text_keys(spark):
    """Text keys take any shard they would by their text; a key that a third of the rows have, nulls and repeated rows."""
    table = [(f"k{i % 97:03}" if i % 3 else "hot", f"t{i % 50}") for i in range(600)] + [(None, "x"), (None, None), ("é", ""), ("é", "")]
    out = sharding.assign(spark.createDataFrame(table, "name string, text string"), 5, id_col="name", ranges=16).collect()
    assert len(out) == len(table) and len({(r.shard, r.slot) for r in out}) == len(table)
    by_shard = {}
    for r in sorted(out, key=lambda r: (r.shard, r.slot)):
        by_shard.setdefault(r.shard, []).append((r.doc_id is not None, r.doc_id or "", r.size))
    assert all(x == sorted(x) for x in by_shard.values())
    assert all(len({r.shard for r in out if r.doc_id == k}) == 1 for k in {r.doc_id for r in out})


def test_weighted_shards(spark):
    from pyspark.sql import functions as F

    df = spark.range(20000)
    three = df.select("id", sharding.rendezvous(F.col("id"), {0: 1, 1: 2, 2: 1}).alias("s"), sharding.rendezvous(F.col("id"), {0: 1, 1: 2, 2: 1, 3: 4}).alias("t"))
    n = {r.s: r["count"] for r in three.groupBy("s").count().collect()}
    assert abs(n[1] / 20000 - 0.5) < 0.02
    assert three.where("t <> s and t <> 3").count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), {0: 0})


PAGES = [
    (1, "http://a.net/x", '<a href="http://b.com/q">'), (2, "HTTP://Sub.Example.NET/en/1?q#f", None), (3, "http://example.com/de/", '<a href=//c.com/>'), (4, "http://x.org/fr/z", "<a HREF='https://d.com'>"), (5, "http://b.com", '<a href="http://a.net/">'),
    (6, None, "x"), (7, "no scheme", ""), (8, "http://xexample.net/en/", ""), (9, "http://d.com/p#/de/", '<a href="/local">'), (10, "s://H/p?x=1#y", ""), (None, "http://net/", ""), (11, "http://example.com/en", ""), (12, "http://c.com/z://q/r", '<a href="http://x.org/">'), (12, "http://c.com/z://q/r", '<a href="http://x.org/">'),
]


def brute_pages(pages, rules, rounds, threshold):
    """The same by plain dictionaries."""
    import re
    from collections import Counter, defaultdict

    def split(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")

    def rule(host, path):
        own = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(own, key=lambda r: (len(r.name), r.name), default=None)

    edges, n, a, b = set(), Counter(), Counter(), Counter()
    for _, url, html in pages:
        host, path = split(url)
        own = rule(host, path)
        n[host] += 1
        a[host] += bool(own and own.verdict == "allow")
        b[host] += bool(own and own.verdict == "block")
        for x in re.findall(url_filters.HREF, html or ""):
            to = split(re.sub("^//", "http://", x))[0]
            if host and to and host != to:
                edges.add((host, to))
    seeds = {h for h in n if h}
    t0 = {h for h in seeds if a[h] and not b[h]}
    b0 = {h for h in seeds if 2 * b[h] >= n[h]}
    share = url_filters.UNIT // (len(t0) + len(b0)) if t0 or b0 else 0
    trust, bad = defaultdict(int, dict.fromkeys(t0, share * 15 // 100)), defaultdict(int, dict.fromkeys(b0, share * 15 // 100))
    outs, ins = Counter(x for x, _ in edges), Counter(y for _, y in edges)
    for _ in range(rounds):
        nt = defaultdict(int, {h: share * 15 // 100 for h in t0})
        nb = defaultdict(int, {h: share * 15 // 100 for h in b0})
        for x, y in edges:
            nt[y] += trust[x] * 85 // 100 // outs[x]
            nb[x] += bad[y] * 85 // 100 // ins[y]
        trust, bad = nt, nb
    out = []
    for i, url, _ in pages:
        host, path = split(url)
        own = rule(host, path)
        blocked = bad[host] > trust[host] and bad[host] >= share * 15 * threshold // 10000
        out.append((i, host, path, own.name if own else None, own.verdict if own else "block" if host and blocked else "allow"))
    return out


@pytest.mark.parametrize("pages", [PAGES, [x for x in PAGES if x[0] in (6, 7, 10)], []])
def test_pages(spark, pages):
    df = spark.createDataFrame([(*x, "clash") for x in pages], "page_id long, url string, html string, host string")
    out = url_filters.judge(df, rounds=4)
    assert got(out, "page_id", "host", "path", "rule", "verdict") == wanted(brute_pages(pages, url_filters.RULES, 4, url_filters.THRESHOLD))


def test_distrust_flows_back_and_trust_forward(spark):
    pages = [(1, "http://bad.net/a", ""), (2, "http://fan.com/", '<a href="http://bad.net/">'), (3, "http://good.org/fr/", '<a href="http://friend.com/">'), (4, "http://friend.com/", '<a href="http://bad.net/"><a href="http://fan.com/">'), (5, "http://lone.com/", "")]
    out = {r.page_id: r.verdict for r in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_blocked_seeds_and_chains(spark):
    """A host that the rules block is blocked itself however few trusted hosts there are, and so is what links to it over up to 14 hosts."""
    chain = [(i, f"http://h{i}.com/", f'<a href="http://h{i + 1}.com/">') for i in range(20)]
    pages = [*chain, (20, "http://h20.com/", '<a href="http://end.net/">'), (30, "http://end.net/a", ""), (31, "http://other.net/a", ""), (32, "http://x.org/fr/", "")]
    out = {r.page_id: (r.verdict, r.host_verdict) for r in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[30] == out[31] == ("block", "block") and out[32] == ("allow", "allow")
    assert [i for i in range(21) if out[i][0] == "block"] == list(range(7, 21))
