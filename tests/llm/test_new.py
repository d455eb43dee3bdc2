"""Personal data, whitening and the Merkle manifest against brute force; nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from propspark.llm import merkle, pii, whiten
from propspark.llm.queries import QUERIES

DIGEST = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


PII_PATTERNS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(v) <= 255 for v in m.group().split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m.group())) <= 15)]


def brute_base(text):
    return sorted((m.start(), k, m.end()) for k, (p, fine) in enumerate(PII_PATTERNS) for m in re.finditer(p, text) if fine(m))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "x_", "-", " ", "0", "255", "256", "1.2.3.4", "4845168114407329", "4111 1111 1111 1111", "+", "+1 (487) 555-7209",
                                 "(", ")", "é", "😀", "%", "00255", "7", "at", "[at]", "\n"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute_base(text)
    for kind, start, end in pii.proposals(text):
        assert 0 <= start < end <= len(text) and kind in range(4)


def test_pii_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_base(texts[r.doc_id])
        written = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == DIGEST(",".join(written)) and set(written) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        ends = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert ends == sorted(ends)


def test_pii_adds_what_looks_alike(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        a, b, c = (int(v) for v in rng.integers(100, 999, 3))
        rows.append((i, f"please call +1 ({a}) {b}-{c}7 or write to some.name{i}@mail{a}.example.com today, item {a}{b} of {c}", "s", 1))
    # the same forms, which the fixed patterns miss
    rows += [(1000, "please call 1 (222) 333-4447 or write later", "s", 1), (1001, "please write to some.name555[at]mail444.example.com today", "s", 1),
             (1002, "nothing personal in 12 words and 2024", "s", 1), (1003, None, "s", 1), (1004, "", "s", 1), (None, "no id +1 (487) 555-7209", "s", 1),
             (7, rows[7][1], "s", 1), (1005, "9" * 50_000 + "a" * 50_000 + "@", "s", 1), (1006, "1 2 3 4 5 6 7 8 9 " * 3000, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, row int")
    found = pii.detect(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: [tuple(s) for s in r.spans] for r in found}
    assert [(s[1], s[0], s[2]) for s in by_id[1000]] == [(3, 12, 28)] and by_id[1000][0][3] > 0.5
    assert [s[1] for s in by_id[1001]] == [0]
    assert by_id[1002] == by_id[1003] == by_id[1004] == [] and len(by_id[None]) == 1
    assert all(len(by_id[i]) == 2 for i in range(900))
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns and clean[1003].text is None and clean[1002].text == rows[902][1]
    assert clean[1000].text == "please call [PHONE] or write later" and clean[None].text == "no id [PHONE]"


def test_pii_without_spans(spark):
    docs = spark.createDataFrame([(1, "words only"), (2, None)], "doc_id long, text string")
    assert [r.spans for r in pii.detect(docs).collect()] == [[], []]
    assert pii.detect(docs.where("false")).count() == 0
    only = spark.createDataFrame([(1, "at 10.0.0.1")], "doc_id long, text string")
    assert [tuple(s)[:3] for s in pii.detect(only).first().spans] == [(3, 1, 11)]


def test_thresholds():
    assert pii.rising([(1, 2), (0, 2), (3, 4), (0, 0)]) == [0.25, 0.25, 0.75, 0.0] or pii.rising([(1, 2), (0, 2), (3, 4)]) == [0.25, 0.25, 0.75]
    counts = [(0, 90, 50.0, 50.0), (0, 50, 10.0, 40.0), (1, 99, 3.0, 3.0), (2, 80, 50.0, 100.0)]
    assert pii.thresholds(counts) == {0: 0.9}


def brute_whitened(x, wanted):
    c = x - x.mean(axis=0)
    values, basis = np.linalg.eigh(c.T @ c / len(x))
    order = np.argsort(-values)[:wanted]
    return values[order], c @ basis[:, order] / np.sqrt(values[order]), np.trace(c.T @ c) / len(x)


def check_whitened(rows, ids, x, wanted=8):
    values, white, trace = brute_whitened(x.astype(float), wanted)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(ids) * len(values) and len(got) == len(rows)
    total = [int(v) for v in x.sum(axis=0)]
    for k in range(len(values)):
        mine = np.array([got[i, k + 1].whitened for i in ids])
        assert min(np.abs(mine - white[:, k]).max(), np.abs(mine + white[:, k]).max()) < 1e-8
    for i, row in zip(ids, x.tolist()):
        r = got[i, 1]
        assert r.n == len(ids) and r.deviation == sum((len(ids) * v - s) ** 2 for v, s in zip(row, total))
        assert r.explained == pytest.approx(values[0] / trace, rel=1e-10) and r.identity_error < 1e-9


def test_whiten_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64) + 100_000
    check_whitened(QUERIES["op12_whiten"](spark, sf).collect(), [r.vec_id for r in rows], x)


def test_whiten_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = rng.standard_normal((40, 3)).round(3)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(good)]
    rows += [(100, None, 0), (101, [1.0, None, 2.0], 0), (102, [1.0, float("nan"), 0.0], 0), (103, [float("inf"), 1.0, 1.0], 0), (104, [1.0], 0), (105, [], 0), (106, [1e300, 0.0, 0.0], 0)]
    given_ = spark.createDataFrame(rows, "vec_id int, embedding array<double>, x int").repartition(3)
    found = whiten.whiten(given_)
    assert found.schema["vec_id"].dataType.typeName() == "integer"
    check_whitened(found.collect(), list(range(40)), np.floor(1024 * good).astype(np.int64) + 100_000)
    assert whiten.whiten(given_.where("false")).count() == 0 and whiten.whiten(given_.where("vec_id > 103")).count() == 0
    assert whiten.whiten(given_.where("vec_id = 3")).count() == 0  # no variance
    twice = given_.where("vec_id < 2").unionByName(given_.where("vec_id < 2"))
    assert whiten.whiten(twice).count() == 4  # one component with variance
    far = spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 5.0])], "vec_id int, embedding array<double>")
    assert all(r.deviation is None for r in whiten.whiten(far).collect() if r.vec_id < 3)


@pytest.mark.parametrize("n,d,flat", [(400, 150, True), (400, 150, False), (60, 9, True)])
def test_jacobi_davidson(n, d, flat):
    x = np.random.default_rng(1).standard_normal((n, d)) * (1 if flat else 1 / np.arange(1, d + 1))
    c = x - x.mean(axis=0)
    v = c.T @ c / n
    values, basis = whiten.jacobi_davidson(lambda b: c.T @ (c @ b) / n, d, 8)
    want = np.linalg.eigvalsh(v)[::-1][:8]
    assert np.allclose(values, want, rtol=1e-12) and np.linalg.norm(v @ basis - basis * values, axis=0).max() < 1e-12 * want[0]


def brute_tree(digests):
    """Root and, for every leaf, its siblings level by level with its place among them."""
    proofs, places, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(places):
            run = level[p // 3 * 3:p // 3 * 3 + 3]
            proofs[i].append((run[:p % 3], run[p % 3 + 1:]))
        level = [DIGEST(*level[k:k + 3]) for k in range(0, len(level), 3)]
        places = [p // 3 for p in places]
    return level[0], proofs


@pytest.mark.parametrize("levels", [1, 2, 5])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100])
def test_sweeps(monkeypatch, levels, n):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    leaves = [DIGEST(str(k)) for k in range(n)]
    root, want = brute_tree(leaves)
    rounds, size = [leaves], n
    while len(rounds[-1]) > 1:
        step = 3 ** levels
        rounds.append([merkle.forward(rounds[-1][k:k + step], k, len(rounds[-1]), levels)[0] for k in range(0, len(rounds[-1]), step)])
    assert rounds[-1] == [root]
    above = [[]]
    for nodes in reversed(rounds[:-1]):
        step, below = 3 ** levels, []
        for k in range(0, len(nodes), step):
            below += merkle.backward(merkle.forward(nodes[k:k + step], k, len(nodes), levels)[1], k, above[k // step])
        above = below
    assert [[(s["left"], s["right"]) for s in p] for p in above] == [[("".join(a), "".join(b)) for a, b in p] for p in want]


def brute_manifest(rows):
    def leaf(r, text):
        return DIGEST(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))) for s in sources}
    subs = {s: brute_tree([leaf(r, r["text"]) for r in trees[s]]) for s in sources}
    root, upper = brute_tree([subs[s][0] for s in sources])
    for at, s in enumerate(sources):
        for r, proof in zip(trees[s], subs[s][1]):
            path = proof + upper[at]
            own = leaf(r, r["text"])
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            value = leaf(r, r["text"].replace("\n", "")) if hit else own
            for left, right in path:
                value = DIGEST(*left, value, *right)
            yield (r["doc_id"], own, subs[s][0], root, DIGEST(*("".join(left + right) for left, right in path)), value, value == root)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_merkle_query(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_merkle"](spark, sf).collect()) == Counter(brute_manifest(rows))


@pytest.mark.parametrize("levels", [2, 5])
def test_merkle_odd_rows(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(i, f"text {i}\nmore", "en", "hot" if i % 3 else f"s{i % 7}", i) for i in range(200)]
    rows += [(None, "null id\n", "en", "hot", 1)] * 4 + [(5, "other\n", None, "hot", None), (5, "other\n", None, "hot", None), (900, None, "de", None, 0),
             (901, "", "de", "", 0), (902, "é😀\n", "de", "lone", 3)]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tree_no string, pos int, digest string").repartition(5)
    given_ = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]
    got = Counter(tuple(r[c] for c in COLUMNS) for r in merkle.verified(merkle.manifest(docs)).collect())
    assert got == Counter(brute_manifest(given_))
    one = docs.where("doc_id = 902")
    assert Counter(tuple(r[c] for c in COLUMNS) for r in merkle.verified(merkle.manifest(one)).collect()) == Counter(brute_manifest([g for g in given_ if g["doc_id"] == 902]))
    assert merkle.verified(merkle.manifest(docs.where("false"))).count() == 0
