"""Mixing, vector codes and the prefix trie against plain loops, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixweave.llm import codes, mixing, trie

DOCS = "doc_id long, text string, source string, size string, copies string, rank int, weight double"


def count(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def make_docs(n=300, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 5, 20, 60, 300])), rng.choice(["a", "a", "a", "a", "b", "c", None]), "x", "y", 1, rng.choice([0.2, 1.0, 3.0])) for i in range(n)]
    rows += [(n, None, "a", "x", "y", 1, 1.0), (n + 1, "", "b", "x", "y", 1, 1.0), (None, "one two", "a", "x", "y", 1, 1.0), (n + 2, "q " * 5000, "c", "x", "y", 1, 1.0), (n + 3, None, "empty", None, None, None, None)]
    return rows + [rows[0], rows[0], (5, "another text", "a", "x", "y", 1, 1.0), (n + 4, "z", "\U0001f600", "x", "y", 1, None), (n + 5, "z", "￿", "x", "y", 1, -2.0)]


def plain_targets(sizes, weights, cap, total=None):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, full = (sum(sizes.values()) if total is None else total), {}
    while True:
        rest = [s for s in order if s not in full]
        level = (left - sum(full.values())) / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if level * w[s] > cap * sizes[s]]
        if not over:
            return {s: full.get(s, level * w[s]) for s in order}
        full |= {s: float(cap * sizes[s]) for s in over}


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(make_docs(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def whole_mix(spark, mixed):
    return mixing.mix(spark, mixed, keep=("size", "text")).toDF("doc_id", "source", "size", "source_size", "target", "copies", "kept", "text").cache()


def test_targets_stop_at_the_cap(whole_mix):
    got = whole_mix.collect()
    sizes = Counter()
    for r in make_docs():
        sizes[r[2]] += count(r[1])
    want = plain_targets(sizes, (5, 2, 1), 3)
    assert {r.source: r.source_size for r in got} == dict(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
    assert len(got) == len(make_docs())
    assert sum(want.values()) == pytest.approx(sum(sizes.values())) and want["\U0001f600"] == 3.0


def test_words_come_near_their_targets(whole_mix):
    of = defaultdict(list)
    for r in whole_mix.collect():
        of[r.source].append(r)
    for rows in of.values():
        copies = {r.copies for r in rows}
        assert max(copies) - min(copies) <= 1
        # no document that was left out would bring the words nearer
        off = rows[0].target - sum(r.size * r.copies for r in rows)
        spare = [r.size for r in rows if r.copies == min(copies)]
        assert len(copies) == 1 or abs(off) <= min(spare, default=0) / 2 + 1 or off < 0


def test_order_sampling_equals_a_plain_loop(whole_mix):
    """A source in one task: by odds, what fits, and the nearest at last."""
    got = Counter((r.doc_id, r.size, r.copies) for r in whole_mix.where("source = 'a'").collect())
    rows = [r for r in make_docs() if r[2] == "a"]
    total = sum(count(r[1]) for r in rows)
    target = whole_mix.where("source = 'a'").first().target
    sure, rest = math.floor(target / total), round(target) - math.floor(target / total) * total
    u = lambda i: int(hashlib.md5(f"mix|{'' if i is None else i}".encode()).hexdigest()[:12], 16)
    want, spare = [], None
    for r in sorted(rows, key=lambda r: (u(r[0]), count(r[1]))):
        n = count(r[1])
        if n <= rest:
            want.append([r[0], n, sure + 1])
            rest -= n
        else:
            want.append([r[0], n, sure])
            spare = want[-1] if spare is None or n < spare[1] else spare
    if spare and spare[1] - rest < rest:
        spare[2] += 1
    differ = [x for x in (Counter(map(tuple, want)) - got) if x[0] not in (5, 0)]  # ties of u go by a hash of the text
    assert not differ


def test_mixing_agrees_with_itself_and_keeps_columns(spark, mixed, whole_mix):
    again = mixing.mix(spark, mixed.repartition(2), keep=("size", "text"))
    assert again.columns[-2:] == ["size", "text"]
    assert sorted(map(repr, map(tuple, again.collect()))) == sorted(map(repr, map(tuple, whole_mix.collect())))
    assert mixing.repeated(whole_mix).count() == whole_mix.agg(F.sum("copies")).first()[0]


def test_document_weights_make_unequal_probabilities(spark):
    rows = [(i, "w " * 10, "a", "", "", 1, [0.5, 1.0, 4.0][i % 3]) for i in range(900)]
    got = mixing.mix(spark, spark.createDataFrame(rows, DOCS), weights=(1,), cap=2, total=9000, weight="weight", group=16).collect()
    each = defaultdict(list)
    for r in got:
        each[r.doc_id % 3].append(r.copies)
    # 300 documents of each weight: weight 4 is full (2 copies), the others share 3000 words by 1 to 2
    assert set(each[2]) == {2}
    assert abs(sum(sum(v) for v in each.values()) - 900) <= 1
    assert 60 <= sum(each[0]) <= 140 and 160 <= sum(each[1]) <= 240


def test_mixing_edge_cases(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.mix(spark, none).count() == 0
    same = spark.createDataFrame([(1, "a b c", "s", "", "", 1, 1.0)] * 90 + [(2, "d e f", "t", "", "", 1, 1.0)] * 10, DOCS)
    got = mixing.mix(spark, same, weights=(1, 1), group=4).groupBy("source").agg(F.sum("copies").alias("n"), F.min("copies").alias("low"), F.max("copies").alias("high")).collect()
    assert {(r.source, r.n, r.low, r.high) for r in got} == {("s", 70, 0, 1), ("t", 30, 3, 3)}


# ---------------------------------------------------------------- vector codes


def plain_codes(data, parts, entries, rounds, scale=256):
    rows = [(i, lab, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v, lab in data if v and all(c is not None and math.isfinite(c) for c in v)]
    first = {}
    for i, _, v in rows:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    dim = len(first[min(first)])
    rows = [r for r in rows if len(r[2]) == dim]
    width = -(-dim // parts)
    cut = lambda v, p: (v + [0] * (parts * width - dim))[p * width : (p + 1) * width]
    heads = [first[i] for i in sorted(i for i in first if len(first[i]) == dim)][:entries]
    books = [[cut(v, p) for v in heads] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((dist(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for _, _, v in rows:
                got[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(got[k]) for c in zip(*got[k], strict=True)] if k in got else e for k, e in enumerate(books[p])]
    out, label = [], Counter()
    for i, lab, v in rows:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
        label[lab] += out[-1][3]
    return [(i, c, e, label[lab]) for i, lab, c, e in out], books


@pytest.mark.parametrize("dim,parts,entries", [(8, 4, 7), (6, 4, 64), (3, 1, 2)])
def test_codes_equal_a_full_search(spark, dim, parts, entries):
    rng = np.random.default_rng(dim)
    data = [(i, [float(x) for x in rng.integers(-2, 3, dim) * (0.1 if i % 3 else 0.01)], None if i % 7 == 0 else i % 4) for i in range(120)]
    data += [(500, None, 1), (501, [1.0] * (dim - 1) + [None], 1), (502, [float("inf")] * dim, 1), (503, [], 1), (504, [1.0] * (dim + 1), 1), (None, [0.5] * dim, 2), (3, data[4][1], 1), (7, data[7][1], 1)]
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    got, books = codes.compress(spark, df, parts=parts, entries=entries)
    want, plain = plain_codes(data, parts, entries, 2)
    assert books.tolist() == plain
    assert sorted(map(repr, ((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()))) == sorted(map(repr, want))


def test_partial_distances_keep_ties():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, book = rng.integers(-3, 4, (200, 4)), rng.integers(-3, 4, (20, 4))
        k, d = codes.nearest(x, book)
        full = np.square(x[:, None] - book[None]).sum(2)
        assert (k == full.argmin(1)).all() and (d == full.min(1)).all()


def test_codes_edge_cases(spark):
    kind = "vec_id long, embedding array<float>, label int"
    none, books = codes.compress(spark, spark.createDataFrame([], kind))
    assert none.count() == 0 and books.size == 0 and none.columns == ["vec_id", "label", "code", "error", "label_error"]
    far = [(1, [3.0e38] * 16, 1), (2, [1.0] * 16, None), (3, [-1.0] * 16, None), (3, [-1.0] * 16, None)]
    got, books = codes.compress(spark, spark.createDataFrame(far, kind))
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()) == [(2, "00" * 16, 0, 0), (3, "01" * 16, 0, 0), (3, "01" * 16, 0, 0)]
    assert codes.books_sha256(books) == hashlib.sha256(",".join(["256", "-256"] * 16).encode()).hexdigest()
    with pytest.raises(ValueError):
        codes.compress(spark, spark.createDataFrame(far, kind), entries=300)


# ---------------------------------------------------------------- prefix trie


def plain_trie(rows, group=20, most=4):
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    new = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        new[c] = convs.get(c - int(math.fmod(c, group)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for path, m in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        saved = sum((len(members[p]) - 1) * count(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in m if len(new[c]) == len(path))))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def make_turns(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 70), -25, -20, 400, 401]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["hi there", "yes", "no no no"]), "x", 1))
    for c in (100, 103, 107, 111, 119, 131):  # copies
        rows += [(c, t, "user", f"turn {t} of many", "x", 1) for t in range(10)]
    rows += [(200, None, None, None, "x", 1), (200, 3, "user", "", "x", 1), (200, 3, "user", "", "x", 1), (201, None, "", "", None, None), (None, 1, "user", "lost", "x", 1), (301, 0, "a", "w " * 9000, "x", 1), (305, -5, "b", "é ü", "x", 1)]
    return rows


@pytest.mark.parametrize("few", [1024, 4])
def test_trie_equals_brute_force(spark, few):
    rows = make_turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string, key int").repartition(7)
    got = trie.prefix_trie(spark, *trie.rebuilt(spark, trie.turns(spark, df)), few=few)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_trie(rows)))


def test_trie_of_copies_and_of_nothing(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark, *trie.rebuilt(spark, trie.turns(spark, spark.createDataFrame([], kind)))).count() == 0
    rows = [(c, t, "user", f"t{t} and more") for c in range(0, 3000, 20) for t in range(3)]
    got = trie.prefix_trie(spark, *trie.rebuilt(spark, trie.turns(spark, spark.createDataFrame(rows, kind))), few=16).collect()
    assert sorted((r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got) == [(0, 150, 1, 1, 149 * 9), (1, 150, 1, 1, 149 * 9), (2, 150, 1, 1, 149 * 6), (3, 150, 0, 1, 149 * 3)]
    ends = {r.depth: r.ends_sha256 for r in got}
    assert ends[3] == hashlib.sha256(",".join(map(str, range(0, 3000, 20))).encode()).hexdigest() and ends[0] == trie.NOTHING
