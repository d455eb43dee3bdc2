"""The corpus operators against brute force on small fixtures: nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from propspark.llm import cotrain, decontaminate, lm, packing, secrets, shard, simhash, spotsigs, toolcalls, urlfilter
from propspark.llm.common import components
from propspark.llm.queries import QUERIES, SQL
from tests.oracle_compare import compare, duck

LONG = " ".join(f"w{i % 977}x" for i in range(30_000))
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
KEY = "AKIA" + "B7" * 8
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 3), (2, "The quick brown fox jumps over the lazy dog. " * 3), (3, None), (4, ""),
    (5, LONG), (6, "intro " + ITEM.upper() + " outro"), (7, f"id {KEY} then password = \"hunter2hunter2\" at https://db.example.org/x end"),
    (8, "short item here"), (8, "short item here"), (None, "no id at all but words"), (9, "a \n  b\tc  d"), (10, "Ünï çödé 漢字 😀 the end of it"),
    (11, "client_id: abcdef1 alone"), (12, " lead and trail "), (13, "deadbeef" * 4), (14, "idiot " * 5 + ITEM + " " + ITEM)]


CLASHES = ["text_hash", "cuts", "tail", "copies", "copy", "words", "window_id", "start", "stop", "kind", "spans", "items", "fp", "node", "root", "set_id", "key", "row",
           "score", "keep", "part", "__id", "__hash", "__text", "__row", "features", "fold", "base", "found", "size", "shard", "slot", "sigs", "next_id"]


@pytest.fixture(scope="module")
def docs(spark):
    # The other columns bear names that the operators use themselves.
    rows = [(i, t, "x", "y", 0, "pos", 1, *["c"] * len(CLASHES)) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, word string, pair int, " + ", ".join(f"{c} string" for c in CLASHES))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    assert compare(spark, duck(sf), QUERIES[name], SQL[name], sf) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 20: 20}


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, ITEM), (2, "Short ITEM"), (2, "Short ITEM"), (3, None), (4, "..."), (None, "lazy dog")], "item_id long, text string")
    every = decontaminate.contamination(docs, items).collect()
    assert Counter(r.doc_id for r in every) == Counter(i for i, _ in TEXTS)
    got = {(r.doc_id, r.text_hash): r for r in every}
    by_id = {r.doc_id: r for r in got.values()}
    assert len(got) == len(set(TEXTS))
    assert by_id[6].n_hit == 11 and by_id[6]["items"] == ["1"] and by_id[14].n_hit == 22
    assert by_id[8].n_hit == 2 and by_id[8]["items"] == ["2"]
    assert by_id[1].n_hit == 6 and by_id[1]["items"] == []
    assert by_id[3].n_words == 0 and by_id[5].n_words == 30_000 and by_id[None].n_words == 6
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns and {1, 2, 6, 8, 14}.isdisjoint({r.doc_id for r in left.collect()}) and left.count() == 10
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.decontaminate(docs, items.where("false")).count() == docs.count()


def test_decontaminate_without_broadcast(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, ITEM), (2, "short item")], "item_id long, text string")
    want = sorted(map(str, decontaminate.contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(str, decontaminate.contamination(docs, items).collect())) == want


def test_url_parts_and_cascade(spark):
    urls = ["http://A.Example.ORG/es/x", "ftp://example.org/en/12?q", "no scheme", None, "http://h.com", "http://m.ads.com/z#f", "http://xads.com/z", "x://a.com/de/://b/fr/"]
    pages = spark.createDataFrame([(i, u, "key", 1) for i, u in enumerate(urls)], "page_id long, url string, key string, rule int")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "com", "/de/")]
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(pages, rules, ["ads.com"]).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == got[3] == ("", "", None, "allow") and got[4] == ("h.com", "", None, "allow")
    assert got[5][3] == "block" and got[6][3] == "allow" and got[7] == ("a.com", "/de/://b/fr/", "com/de/", "block")
    assert urlfilter.judge(pages.where("false"), rules, ["ads.com"]).count() == 0
    keys = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    cascade = urlfilter.Cascade.build(keys, keys.where("key like '%7%'"))
    assert len(cascade.levels) > 1
    assert keys.where(cascade.contains(keys["key"]) != keys["key"].contains("7")).count() == 0


def brute_fingerprint(text):
    s = simhash.shingles(text or "", 3)
    counts = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x, seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(s))


def brute_roots(values, radius):
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash(docs, none):
    rows = simhash.simhash_groups(docs).collect()
    assert len(rows) == len(TEXTS) and simhash.simhash_groups(none).count() == 0
    want = Counter((i, f"{brute_fingerprint(t):016x}") for i, t in TEXTS)
    assert Counter((r.doc_id, r.fingerprint) for r in rows) == want
    group = {r.doc_id: r.component_id for r in rows}
    assert group[1] == group[2] == 1 and group[3] == group[4] == 3
    assert simhash.keep_one(docs).count() < docs.count() and simhash.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("rows", [simhash.TILE_ROWS, 8])
def test_simhash_links(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "TILE_ROWS", rows)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, dtype=np.int64)
    values = sorted({int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 63, (6, 2))})
    keys = simhash.block_keys(2)
    data = [(i, v.to_bytes(8, "big"), v.bit_count(), keys(None, v.to_bytes(8, "big"))) for i, v in enumerate(values)]
    nodes = spark.createDataFrame(data, "node long, fp binary, pop int, keys array<long>")
    got = {r.node: r.root for r in components(simhash.links(nodes, 2)).collect()}
    assert [got.get(i, i) for i in range(len(values))] == brute_roots(values, 2)


def brute_kept(rows, least=0.8, size=5):
    """Kept ids of (doc_id, text): all pairs that share a shingle, compared as sets of shingles."""
    sets, holders = {}, defaultdict(list)
    for i, text in rows:
        words = text.encode().lower().split()
        sets[i] = {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))}
        for s in sets[i]:
            holders[s].append(i)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    shared = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1:])
    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= least:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {i for i in sets if top(i) == i}


def test_keep_one_is_exact(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in given.collect())
    assert {r.doc_id for r in simhash.keep_one(given).collect()} == brute_kept(rows)


@pytest.mark.parametrize("rows", [simhash.TILE_ROWS, 4])
def test_keep_one_on_both_sides_of_the_similarity(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "TILE_ROWS", rows)
    rng = np.random.default_rng(5)
    made = []
    for base in range(6):
        words = [f"b{base}w{k}" for k in range(int(rng.integers(6, 150)))]
        for copy in range(20):
            cut = len(words) - int(rng.integers(0, 1 + len(words) // 2)) if copy % 2 else len(words)
            tail = [f"c{base}x{copy}x{k}" for k in range(int(rng.integers(0, 1 + len(words) // 5)))]
            made.append((len(made), " ".join(words[:cut] + tail)))
    # One shingle that is most of the repeats decides no fingerprint of distinct shingles.
    made += [(1000 + k, "a " * 400 + " ".join(f"r{k}s{n}" for n in range(40))) for k in range(3)]
    table = spark.createDataFrame(made, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(table).collect()} == brute_kept(made)


def test_shard(docs, none):
    leaves = shard.tree()
    rows = shard.assign(docs, leaves).collect()
    assert len(rows) == len(TEXTS) and shard.assign(none).count() == 0
    for r in rows:
        assert r.grown_shard in (r.shard, 16)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows}[10] == (len(TEXTS[11][1].encode()) + 1, zlib.crc32(TEXTS[11][1].encode()))


def test_shard_weights(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    leaves = shard.tree()
    heavier = [shard.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 0 else 1.0) for x in leaves]
    both = shard.with_shard(shard.with_shard(ids, ids["doc_id"], leaves, "a"), ids["doc_id"], heavier, "b")
    n = Counter(r.a for r in both.collect())
    assert len(n) == 16 and max(n.values()) < 1.2 * min(n.values())
    # only the rack and region of shard 0 gained weight: nothing moves inside the other region
    assert both.where("a >= 8 and b >= 8 and a != b").count() == 0
    steps = ids
    for k, tree in enumerate([leaves, shard.grown(leaves), shard.grown(shard.grown(leaves))]):
        steps = shard.with_shard(steps, steps["doc_id"], tree, f"s{k}")
    assert steps.where("s0 != s1 and s1 != 16 or s1 != s2 and s2 != 17").count() == 0


PATTERNS = [("assign", re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 12),
            ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]


def test_secrets(spark, docs, none):
    more = spark.createDataFrame([(50, "token: secret: abcdefghijklmnopq"), (51, "😀 API_KEY='aaaaaaaaaaaa' Secret=bbbbbbbbbbbbbb"), (52, f"{KEY}{'0' * 16}")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    texts = {(r.doc_id, r.text or "") for r in every.collect()}
    found = secrets.report(every).collect()
    assert len(found) == every.count() and secrets.report(none).count() == 0
    by_id = {r.doc_id: [tuple(s) for s in r.spans] for r in found}
    for i, text in texts:
        want = sorted((m.start(), k, name, m.end()) for k, (name, p, g, least) in enumerate(PATTERNS) for m in p.finditer(text) if len(m.group(g)) >= least)
        assert [s for s in by_id[i] if s[1] < 3] == want
    assert "endpoint" in [s[2] for s in by_id[7]] and by_id[11] == []
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).count() == len(TEXTS)
    assert clean[7].text == "id [SECRET] then [SECRET]\" at [SECRET] end" and clean[7].n_chars == len(clean[7].text)
    assert clean[3].text is None and clean[5].text == LONG and clean[13].text == "[SECRET]"


def test_spotsigs(docs, none):
    texts = {}
    for i, t in TEXTS:
        texts[i] = t or ""
    order = sorted((i for i in texts if i is not None), reverse=True) + [None]
    rows = {r.doc_id: r for r in spotsigs.edited_pairs(docs).collect()}
    assert set(rows) == set(texts) and spotsigs.edited_pairs(none).count() == 0
    for at, i in enumerate(order):
        after = order[(at + 1) % len(order)]
        half = len(texts[i]) // 2
        edited = texts[i][:len(texts[i]) - half] + texts[after][:half]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].next_id == after
    assert rows[1].sigs == rows[2].sigs and rows[3].sigs == []
    assert Counter(r.doc_id for r in spotsigs.edited_pairs(docs).collect()) == Counter(i for i, _ in TEXTS)


def test_spotsigs_without_common_words(spark):
    long = [f"sana{k}kin" for k in range(200)]
    cjk = [f"第{k}章天気晴朗" for k in range(200)]
    pairs = [(k, " ".join(w), " ".join(w[:100] + [f"muu{n}" for n in range(100)])) for k, w in enumerate((long, cjk))]
    pairs.append((2, "the start of it " + " ".join(long), "the start of it " + " ".join(long[::-1])))
    made = spark.createDataFrame(pairs, "doc_id long, a string, b string")
    a, b = spotsigs.signatures(made["a"]), spotsigs.signatures(made["b"])
    for r in made.select("doc_id", a.alias("a"), spotsigs.likeness(a, b).alias("near"), spotsigs.likeness(a, a).alias("same")).collect():
        assert len(r.a) > 20 and r.same == 1 and r.near < 0.6
        assert r.near > 0.2 or r.doc_id == 2


def test_lm(docs, none):
    rows = lm.score(docs).collect()
    assert len(rows) == len(TEXTS) and lm.score(none).count() == 0
    counts, tokens = Counter(), {}
    for i, t in TEXTS:
        tokens[i] = [*(t or "").encode().lower().split(), None]
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            counts.update(tokens[i])
    total, distinct = sum(counts.values()), len(counts)
    for r in rows:
        want = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens[r.doc_id])
        assert r.base_score == pytest.approx(want) and r.n_known == sum(counts[w] > 0 for w in tokens[r.doc_id])
        assert r.n_tokens == len(tokens[r.doc_id]) and r.train_tokens == total and r.score <= 0
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].score == by_id[2].score


def lm_blocks(counts, size):
    """Blocks of (word, kind) counts, ``size`` words each, with their borders."""
    words = sorted({w for w, _ in counts}, key=lambda w: ((w + b" ")[:lm.REACH + 1], w))
    blocks = []
    for at in range(0, len(words), size):
        part = words[at:at + size]
        pairs = sorted((k, part.index(w), n) for (w, k), n in counts.items() if w in part)
        blocks.append(lm.Block(np.frombuffer(b"".join(part), np.uint8), np.array([len(w) for w in part]), np.array([r for _, r, _ in pairs]),
                               np.array([k for k, _, _ in pairs]), np.array([n for _, _, n in pairs])))
    return words, blocks


@pytest.mark.parametrize("size", [1000, 7, 1])
def test_lm_counts_of_beginnings(size):
    rng = np.random.default_rng(2)
    counts = Counter()
    for _ in range(300):
        word = bytes(rng.choice(list(b"abz\xc3\x00"), int(rng.integers(1, 5)))) + b"q" * int(rng.choice([0, 0, 30]))
        counts[word, int(rng.integers(0, 3))] += int(rng.integers(0, 4))
    _, blocks = lm_blocks(counts, size)
    bits = defaultdict(int)
    for (w, k), n in counts.items():
        text = "".join(f"{x:08b}" for x in (w + b" ")[:lm.REACH + 1])
        for d in range(len(text) + 1):
            bits[text[:d], k] += n
    kinds = sorted({k for _, k in counts})
    for block, left, right in zip(blocks, *lm.beside(blocks)):
        for p, j, pairs, group, first, own, same, other, k_same, k_other in block.beginnings(left, right):
            for g in range(len(first)):
                mine = pairs[group == g]
                text = "".join(f"{x:08b}" for x in block.rows[first[g]])[:8 * p + j + 1]
                flip, kind = text[:-1] + "10"[int(text[-1])], block.kind[mine[0]]
                assert (k_same[g], k_other[g]) == (bits[text, kind], bits[flip, kind]) and own[g] == block.n[mine].sum()
                assert (same[g], other[g]) == (sum(bits[text, k] for k in kinds), sum(bits[flip, k] for k in kinds))


def test_lm_is_a_distribution():
    counts = Counter({(w, k): n for w, k, n in ((b"some", 1, 3), (b"words", 1, 4), (b"so", 2, 1), (b"w", 1, 1))})
    # every byte that could follow "wo" stands in the list with no occurrence, as words of held-out texts do
    for byte in range(256):
        counts.setdefault((b"wo" + bytes([byte]), 1), 0)
    words, blocks = lm_blocks(counts, 10_000)
    block, bits = blocks[0], lm.table_bits(10)
    tables = lm.empty_tables(bits, np.int64)
    block.add(tables, bits)
    model = lm.Model([lm.squeezed(t) for t in tables], bits)
    none = np.zeros((lm.DEPTHS, lm.KINDS), np.int64)
    third, totals = {}, np.zeros(len(block.row))
    for (p, j, pairs, group, *_), (args, *_) in zip(block.beginnings(none, none), model.block_bits(block, none, none)):
        if p == 2:
            totals[pairs] += model.costs(*args)[group]
    for at, (row, kind) in enumerate(zip(block.row, block.kind)):
        if kind == 1 and bytes(block.rows[row, :2]) == b"wo":
            third[int(block.rows[row, 2])] = totals[at]
    assert len(third) == 256 and sum(2.0 ** -c for c in third.values()) == pytest.approx(1)


@pytest.mark.parametrize("scale", ["0.01"])
def test_lm_beats_its_base(spark, scale):
    rows = lm.score(spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet")).where("held_out").selectExpr("sum(score) a", "sum(base_score) b").first()
    assert rows.a > rows.b


def test_toolcalls(spark):
    calls = spark.createDataFrame([(1, 5, "a", "f", '{"y": 2.0, "x": 1}'), (1, 2, "b", "f", '{"x":"$a"}'), (1, 6, "a", "f", "{}"), (1, 7, "c", "g", "nope"),
                                   (2, 1, "p", "f", '{"x":"$q"}'), (2, 2, "q", "f", '{"x":"$p"}'), (None, 1, "z", "f", None)], "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 3, "a", "out"), (1, 9, "x", None)], "conv_id long, turn long, call_id string, content string")
    schema = [toolcalls.Param("f", "x", "integer", least=1, most=3), toolcalls.Param("f", "y", "number", required=False)]
    rows = {(r.conv_id, r.turn, r.kind): r for r in toolcalls.link(calls, results, schema).collect()}
    assert len(rows) == 9
    first = rows[1, 5, "call"]
    assert first.linked and first.valid and json.loads(first.json)["arguments"] == {"x": 1, "y": 2} and first.json.index('"x"') < first.json.index('"y"')
    answer, waits = rows[1, 3, "result"], rows[1, 2, "call"]
    assert (first.order_turn, first.level) < (answer.order_turn, answer.level) < (waits.order_turn, waits.level)
    assert "x: not integer" in waits.problems and "identifier repeated" in rows[1, 6, "call"].problems and "x: missing" in rows[1, 6, "call"].problems
    assert "unknown tool" in rows[1, 7, "call"].problems and not rows[1, 9, "result"].linked
    assert "waits for itself" in rows[2, 1, "call"].problems and rows[2, 1, "call"].level is None
    assert "no identifier" in rows[None, 1, "call"].problems
    assert toolcalls.link(calls.where("false"), results.where("false"), schema).count() == 0


def test_toolcalls_parallel_and_chained(spark):
    rows = [(1, 1, "a", "f", '{"x":1}'), (1, 1, "a", "f", '{"x":1}'), (1, 1, "a", "f", '{"x":2}'), (1, 3, "b", "f", '{"x":"\\u0024a","$c":0}')]
    rows += [(2, k, f"k{k}", "f", json.dumps({"x": f"$k{k - 1}", "y": [f"$k{k - 2}"]})) for k in range(12)]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 9, "a", "late")], "conv_id long, turn long, call_id string, content string")
    found = toolcalls.link(calls, results, []).collect()
    assert len(found) == len(rows) + 1
    assert sum("identifier repeated" in r.problems for r in found if r.call_id == "a") == 2
    b = next(r for r in found if r.call_id == "b")
    assert b.level == 2 and b.order_turn == 9 and "unknown reference" not in b.problems
    assert [r.level for r in sorted((r for r in found if r.conv_id == 2), key=lambda r: r.turn)] == [2 * k for k in range(12)]


def test_cotrain(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert cotrain.classify(docs, empty).where("keep and score = 1").count() == len(TEXTS)
    assert cotrain.accept(docs, empty).columns == docs.columns
    rows = [(i, "good words are here to read " * 3 + (" $$$ @@@ ###" * 20 if i % 3 == 0 else "") + (" scum" if i % 7 == 0 else ""), f"s{i % 5}") for i in range(600)]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = made.selectExpr("doc_id", "cast(doc_id % 3 != 0 as int) quality", "cast(doc_id % 7 = 0 as int) toxic").where("doc_id % 2 = 0")
    kept = {r.doc_id for r in cotrain.accept(made, labels).collect()}
    want = {i for i in range(600) if i % 3 and i % 7}
    assert len(kept ^ want) <= 6
    assert cotrain.classify(none, labels).count() == 0


def test_accept_decides_row_by_row(spark):
    good, bad = "good words are here to read " * 3, "$$$ @@@ ### " * 20
    rows = [(i, (bad if i % 3 == 0 else good) + f"n{i}", f"s{i % 5}") for i in range(300)]
    rows += [(None, (bad if i % 3 == 0 else good) + f"null{i}", None) for i in range(60)]
    rows += [(7, bad + "again", "s1"), (9, good + "again", "s1"), (7, None, "s1")]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    kept = Counter((r.doc_id, r.text) for r in cotrain.accept(made, labels).collect() if r.text)
    assert kept == Counter((i, t) for i, t, _ in rows if t and t.startswith("good"))
    assert cotrain.classify(made, labels).columns == ["doc_id", "text_score", "meta_score", "score", "keep"]


def check_packing(rows, tokens):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    for i, ids in tokens.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert r.piece == k and r.start == at and r.ids_crc32 == zlib.crc32(np.asarray(ids[at:at + r.length], "<u4").tobytes())
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(ids)
    return by_seq


def test_packing(docs, none):
    exact = packing.encoder(packing.TOKENIZER).exact
    unique = docs.dropDuplicates(["doc_id"])
    tokens = {i: exact.encode(t or "", add_special_tokens=False).ids + [2] for i, t in TEXTS}
    check_packing(packing.pack(unique).collect(), tokens)
    assert packing.pack(none).count() == 0 and packing.pack(docs).where("doc_id = 8").count() == 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab1é.,'’ \n\t\u00a0ßЖ漢<|>") + ["  ", "'s", " word", "<|endoftext|>"]), max_size=40))
def test_encoder(parts):
    text = "".join(parts)
    code = packing.encoder(packing.TOKENIZER)
    assert code.ids(text) == np.asarray(code.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 8))
def test_best_fit(lengths, most):
    bins, used = packing.BestFit(64, most), Counter()
    for n in lengths:
        number, offset = bins.place(n)
        assert offset == used[number]
        used[number] += n
        assert bins.open <= most
    assert all(v <= 64 for v in used.values())


def plain_best_fit(lengths, size):
    """Number of bins when each piece goes to the fullest bin that has room, all bins staying open."""
    free = []
    for n in lengths:
        room = [f for f in free if f >= n]
        if room:
            free.remove(min(room))
            free.append(min(room) - n)
        else:
            free.append(size - n)
    return len(free)


def test_packing_is_close_to_plain_best_fit(spark, sf):
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    plain = plain_best_fit([r.length for r in rows], 1024)
    assert len({r.sequence_id for r in rows}) <= 1.05 * plain + 1


def brute_words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_pipeline(spark, sf):
    """Every stage on what the stage before it kept, against brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "benchmark_passages", "secret_spans", "packed"]
    stages = dict(corpus_pipeline.STAGES)
    good = corpus_pipeline.stored(stages["quality"](spark, docs, sf))
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0 or toxic = 1").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and len(kept & bad) <= 0.1 * len(bad) and len(kept) > 0.5 * docs.count()
    single = corpus_pipeline.stored(stages["near_duplicates"](spark, good, sf))
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == brute_kept(rows)
    clean = corpus_pipeline.stored(stages["benchmark_passages"](spark, single, sf))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = brute_words(r.text)
        windows |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = {r.doc_id for r in single.collect() for w in [brute_words(r.text)] for n in sizes for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in windows}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - hit
    hidden = corpus_pipeline.stored(stages["secret_spans"](spark, clean, sf))
    assert hidden.columns == docs.columns and hidden.count() == clean.count()
    for r in hidden.collect():
        assert not any(len(m.group(g)) >= least for _, p, g, least in PATTERNS for m in p.finditer(r.text or ""))
    exact = packing.encoder(packing.TOKENIZER).exact
    tokens = {r.doc_id: exact.encode(r.text or "", add_special_tokens=False).ids + [2] for r in hidden.collect()}
    check_packing(stages["packed"](spark, hidden, sf).collect(), tokens)
    assert corpus_pipeline.run(spark, sf).count() > 0
