"""Edge cases and small brute-force comparisons of the corpus operators."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixweave.llm import common as C
from helixweave.llm import decontam, html, langid, linededup, lmscore, ngramjoin, packing, substring, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 7))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def make_rows():
    out = [(1, None), (2, ""), (3, "one"), (4, "two words"), (5, " \t\n"), (6, "é ü ñ."), (7, "one"), (None, "one two three four five six"), (8, "a " * 3000)]
    base = prose(120)
    out += [(10, base), (11, base), (12, base + " tail"), (13, prose(40) + " " + base), (14, base.replace(WORDS[0], "zzz")), (11, base)]
    w = base.split()
    for k in range(12):
        v = list(w)
        for _ in range(k // 3):
            v[RNG.randrange(len(v))] = "edit" + str(k)
        out.append((20 + k, " ".join(v)))
    out += [(40 + k, prose(RNG.randint(1, 60))) for k in range(20)]
    return [(i, t, "ab"[(i or 0) % 2], "s", len(t or ""), 1) for i, t in out]


ROWS = make_rows()


def rows():
    return ROWS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return (t or "").encode().split()


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["A b  c", "", None, "b\x0bA x", "aa a aaa"]
    w = C.Words(*C.raw(pa.array([t.encode() if t is not None else None for t in texts], pa.binary())))
    flat = [x.lower() for t in texts for x in words(t)]
    assert w.counts().tolist() == [len(words(t)) for t in texts]
    assert len(set(zip(flat, w.hash.tolist(), strict=True))) == len(set(flat)) == len(set(w.hash.tolist()))
    assert w.runs(2).tolist() == [0, 1, 3, 5, 6][: len(w.runs(2))]


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(80)]
    data += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, []), (104, [1.0, 2.0]), (None, [1.0] * 6), (60, data[60][1]), (7, data[8][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    v = topk.quantised(df)
    got = topk.exact_topk(spark, v, v.where("id % 20 = 0"), k=5).orderBy("query_id", "rank").collect()
    q = {}
    vec = [(i, [math.floor(64 * float(np.float32(c))) for c in x]) for i, x in data if i is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    for i, x in vec:
        if i % 20 == 0:
            q[i] = max(q.get(i, x), x)
    want = []
    for i in sorted(q):
        s = sorted((-sum(a * b for a, b in zip(q[i], x, strict=True)), j) for j, x in vec if j != i and len(x) == len(q[i]))[:5]
        want += [(i, r + 1, j, -n) for r, (n, j) in enumerate(s)]
    assert [tuple(r) for r in got] == want
    none = v.where("id < 0")
    assert topk.exact_topk(spark, none, none).count() == 0
    assert topk.exact_topk(spark, v, v.where("id = 104")).count() == 0


def test_substring_dedup_equals_brute_force(spark, docs, nothing):
    seen = {}
    data = rows()
    for i, t, *_ in data:
        w = words(t)
        for a in range(len(w) - 12):
            if i is not None:
                seen[tuple(w[a : a + 13])] = min(seen.get(tuple(w[a : a + 13]), i), i)
    want = []
    for i, t, *_ in data:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - 12):
            if i is not None and seen[tuple(w[a : a + 13])] < i:
                gone[a : a + 13] = [True] * 13
        want.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    got = substring.substring_dedup(spark, docs).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got))) == sorted(map(repr, want))
    assert all(sum(s.stop - s.start for s in r.removed) == r.n_removed for r in got)
    assert substring.substring_dedup(spark, nothing).count() == 0


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, docs, nothing, n, percent):
    sets = {}
    for i, t, *_ in rows():
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                o = len(sets[i] & sets[j])
                if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o) and comp[i] != comp[j]:
                    a, b = sorted((comp[i], comp[j]))
                    comp = {k: a if c == b else c for k, c in comp.items()}
    for cap in (4096, 3):
        ngramjoin.CAP = cap
        try:
            got = ngramjoin.jaccard_components(spark, docs, n, percent).collect()
        finally:
            ngramjoin.CAP = 4096
        assert len(got) == len(rows())
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None
            else:
                assert (r.component_id, r.n_shingles) == (comp[r.doc_id], len(sets[r.doc_id]))
    assert ngramjoin.jaccard_components(spark, nothing, n, percent).count() == 0


def test_jaccard_of_many_repeated_rows(spark):
    base = prose(60)
    near = base + " tail"
    data = [(1, base)] * 3000 + [(2, near)] * 2 + [(3, prose(50))] * 500 + [(2, prose(45))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    got = Counter((r.doc_id, r.component_id) for r in ngramjoin.jaccard_components(spark, df).collect())
    assert got == {(1, 1): 3000, (2, 1): 3, (3, 3): 500}


def test_jaccard_ids_with_several_texts_are_one_node(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(60, rng) for _ in range(4))
    data = [(1, a), (1, b), (3, b + " tail"), (7, a), (7, c), (9, c + " end"), (20, d), (21, d), (30, ""), (30, d + " x"), (4, a + " more")]
    for order in (data, data[::-1]):
        got = ngramjoin.jaccard_components(spark, spark.createDataFrame(order, "doc_id long, text string").repartition(3), 3, 90).collect()
        assert {(r.doc_id, r.component_id) for r in got if r.n_shingles} == {(1, 1), (3, 1), (7, 1), (9, 1), (20, 20), (21, 20), (30, 20), (4, 1)} and len(got) == len(data)


def test_patience_matches_rise():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(9))] for _ in range(2))
        m = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:], strict=False))
        if a == b:
            assert len(m) == len(a)


def test_line_dedup(spark, nothing):
    long = ["line %d with enough characters to count for a block" % k for k in range(9)]
    data = [(1, "\n".join(long[:3])), (2, "\n".join(["own", *long[:3], "end"])), (3, "\n".join(long[:3])), (4, "short\nlines"), (5, "short\nlines"), (6, None), (7, ""), (None, long[0]), (8, "x\n\n" + long[1] + "\ny"), (9, long[1] + "\n" + long[1])]
    data += [(20 + k, f"start {k}\n{long[5]}") for k in range(15)]
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, gone int")
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in linededup.line_dedup(spark, df).collect()}
    assert got[1][1] == 0 and got[2] == ("own\nend", 3) and got[3] == ("", 3)
    assert got[4] == got[5] == ("short\nlines", 0) and got[6] == (None, 0) and got[7] == ("", 0) and got[None] == (long[0], 0)
    assert got[8] == ("x\n\ny", 1)
    assert got[20][1] == 0 and all(got[20 + k] == (f"start {k}", 1) for k in range(1, 15))
    assert linededup.line_dedup(spark, nothing).count() == 0


def test_line_dedup_trims_and_keeps_columns(spark):
    block = ["a block of a line that has over forty characters", "and the next"]
    data = [(1, "\n".join(block), "p", 7, 9), (2, "own\r\n\t" + "\r\n ".join(block) + "\r\nend", "q", 8, 9), (2, "other\n" + block[0], None, 8, 9), (3, "x\n" * 30_000 + block[0], "r", 1, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, _name string, n_lines_removed int, _row int")
    got = [tuple(r) for r in linededup.line_dedup(spark, df).collect()]
    assert {(r[0], r[2], r[3], r[4]) for r in got} == {(1, "p", 9, 0), (2, "q", 9, 2), (2, None, 9, 1), (3, "r", None, 1)}
    assert {r[1] for r in got} == {"\n".join(block), "own\r\nend", "other", "x\n" * 29_999 + "x"}


def test_line_dedup_meets_every_earlier_holder(spark):
    """Frequent lines, against all pairs: by all their lines, and by the lines above each level alone."""
    rng = random.Random(4)
    short, long = [f"short line {k}" for k in range(8)], [f"frequent line {k} of more than forty characters" for k in range(5)]
    own = (f"own {k}" for k in range(10**6))
    texts = []
    for x in (short[0], short[1], short[2], short[3], short[0]):  # (a) each line of a short-lined block has another first holder
        texts += [[next(own), x, next(own)] for _ in range(3)]
    texts += [[next(own), *short[:4], next(own)] for _ in range(2)]
    texts += [[long[1], next(own), long[0]], [next(own), long[0], next(own), long[1], next(own)]] + [[next(own), long[0], next(own), long[1], next(own)] for _ in range(8)]  # (b) another order
    texts += [[next(own), long[2], next(own), long[2], next(own)]] + [[next(own), long[2], next(own)] for _ in range(9)]  # (c) repeated in the first holder
    texts += [[rng.choice([next(own), next(own), "", *short[4:], *long[3:]]) for _ in range(rng.randrange(1, 7))] for _ in range(120)]
    texts = [t for k, t in enumerate(texts) if t not in texts[:k]]
    held = Counter(x for t in texts for x in set(t) if x)

    def gone(early, late, above):
        a, b = ([x if not x or held[x] > above else (side, k) for k, x in enumerate(t)] for side, t in enumerate((early, late)))
        return linededup.common_blocks(a, b, [len(x) for x in late], 40)

    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for rare in (6, 2):
        levels = [rare * 8**k for k in range(4)]
        got = {r.doc_id: r for r in linededup.line_dedup(spark, df, rare=rare).collect()}
        for i, t in enumerate(texts):
            plain = {k for e in texts[:i] for k in gone(e, t, 0)}
            want = plain | {k for e in texts[:i] for above in levels for k in gone(e, t, above) if any(above < held[x] <= above * 8 for x in {*e} & {*t} - {""})}
            assert plain <= want and (got[i].n_lines_removed, got[i].text) == (len(want), "\n".join(x for k, x in enumerate(t) if k not in want)), (rare, i)
        assert got[15].n_lines_removed == 0 and got[16].n_lines_removed == 4
        assert [got[k].n_lines_removed for k in range(19, 27)] == [2] * 8 and [got[k].n_lines_removed for k in range(29, 37)] == [1] * 8


def test_line_dedup_does_not_depend_on_other_holders(spark):
    """Blocks that changed places go, however many others hold their lines."""
    r, f = ([f"{c} line {k} of a block with a good number of characters" for k in range(3)] for c in "rf")
    for others in (0, 3, 4, 5, 6, 7, 60):
        data = [(1, "\n".join(r + f)), (2, "\n".join(f + r))] + [(10 + k, "\n".join([f"own {k}", *f, f"end {k}"])) for k in range(others)]
        got = {x.doc_id: x for x in linededup.line_dedup(spark, spark.createDataFrame(data, "doc_id long, text string")).collect()}
        assert (got[2].n_lines_removed, got[2].text) == (6, ""), others
        assert all(got[10 + k].n_lines_removed == 3 for k in range(others))


def test_decontamination_equals_brute_force(spark, nothing):
    items = [(k, prose(12 + k)) for k in range(6)] + [(6, "too short"), (7, None), (8, "")]
    data = [(1, prose(50) + " " + items[0][1].upper() + " " + prose(20)), (2, prose(30) + " " + items[1][1] + "."), (3, prose(80)), (4, None), (5, ""), (None, items[2][1])]
    w = items[5][1].split()
    data += [(6, " ".join(w[:8] + ["other"] + w[9:])), (7, items[3][1]), (8, items[3][1] + " " + items[4][1])]
    import re

    split = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    grams = lambda t: [tuple(split(t)[a : a + 5]) for a in range(len(split(t)) - 4)]
    want = {}
    for i, t in data:
        for k, it in items:
            g, h = grams(t), grams(it)
            for a in range(len(g) - len(h) + 1 if i is not None and h else 0):
                o = sum((Counter(g[a : a + len(h)]) & Counter(h)).values())
                s = o / (2 * len(h) - o)
                if s >= 0.8 and s > want.get((i, k), (0,))[0]:
                    want[(i, k)] = (s, a)
    df = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.word) for r in decontam.contaminated(spark, df, bench).collect()}
    assert got == want and len(want) >= 5
    assert decontam.contaminated(spark, nothing, bench).count() == 0


def test_decontamination_of_documents_shorter_than_the_item(spark):
    w = [f"w{k}" for k in range(59)]
    data = {1: w[:-1], 2: w[2:], 3: w[:51], 4: w[8:-1], 5: [*w[:54], "x"], 6: w[:8], 7: w}
    grams = lambda x: [tuple(x[a : a + 5]) for a in range(len(x) - 4)]
    want = {}
    for i, t in data.items():
        o = sum((Counter(grams(t)) & Counter(grams(w))).values())
        if (s := o / (len(grams(t)) + len(grams(w)) - o)) >= 0.8:
            want[i] = (s, 0)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in data.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    assert {r.doc_id: (r.similarity, r.word) for r in decontam.contaminated(spark, df, bench).collect()} == want
    assert {1, 2, 3, 5, 7} <= set(want) and not {6} & set(want)


def test_packing(spark, docs, nothing):
    got = packing.pack(spark, docs, max_len=50, buckets=4, budget=200).collect()
    n = Counter()
    for r in got:
        n[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.bucket_len
    want = Counter()
    for i, t, *_ in rows():
        want[i] += len(words(t)) + 1
    assert n == want
    cells = Counter((r.bucket_len, r.batch) for r in got)
    assert all(b * c <= max(200, b) for (b, _), c in cells.items()) and len({r.bucket_len for r in got}) <= 4
    assert len({(r.bucket_len, r.batch, r.slot) for r in got}) == len(got)
    # placement by brute force: what is in a bucket fills batch after batch
    lens = sorted({r.bucket_len for r in got})
    assert lens == packing.boundaries(*map(list, zip(*sorted(Counter(r.n_tokens for r in got).items()), strict=True)), 4)
    for size in lens:
        inside = [r for r in got if r.bucket_len == size]
        assert all(min(e for e in lens if e >= r.n_tokens) == size for r in inside)
        room = max(1, 200 // size)
        assert sorted((r.batch, r.slot) for r in inside) == [(k // room, k % room) for k in range(len(inside))]
    # the spans of a text's parts join to the whole text, with one end
    spans = defaultdict(list)
    for r in got:
        assert r.n_tokens == r.n_words + r.ends
        spans[r.doc_id].append((r.first_word, r.n_words, r.ends))
    for i, t, *_ in rows():
        if sum(x[0] == i for x in rows()) == 1:
            at = 0
            for first, n, end in sorted(spans[i]):
                assert first == at and (not end or first + n == len(words(t)))
                at += n
            assert at == len(words(t)) and sum(x[2] for x in spans[i]) == 1
    assert packing.pack(spark, nothing).count() == 0


def test_packing_places_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, "w " * rng.randrange(1, 60)) for k in range(1500)], "doc_id long, text string")
    old, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 9):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(tuple, packing.pack(spark, df.repartition(n)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1] and len(got[0]) == 1500


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(2)
    for _ in range(30):
        x = sorted(rng.sample(range(1, 40), 7))
        c = [rng.randint(1, 9) for _ in x]

        def waste(ends, x=x, c=c):
            return sum((min(e for e in ends if e >= a) - a) * k for a, k in zip(x, c, strict=True))

        best = min(waste([*e, x[-1]]) for e in combinations(x[:-1], 2))
        assert waste(packing.boundaries(x, c, 3)) == best


def test_toxicity_learns_a_word(spark, nothing):
    data = [(i, prose(20) + (" vile" if i % 4 == 0 else "")) for i in range(400)] + [(900, None), (901, ""), (902, "vile " * 9000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, None if i == 5 else int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(spark, df, labels, ~C.held_out()).collect()}
    assert sum(got[i].predicted == (i % 4 == 0) for i in range(400)) > 380 and got[902].predicted == 1
    assert 0 <= got[900].score == got[901].score < 0.5
    assert toxicity.toxicity(spark, nothing, labels, ~C.held_out()).count() == 0
    assert {r.predicted for r in toxicity.toxicity(spark, df, labels.where("toxic > 5"), ~C.held_out()).collect()} == {0}


def test_language_id(spark, docs, nothing):
    rng = random.Random(3)
    data = [(i, " ".join(rng.choice(["tha", "the", "ing"] if i % 2 else ["der", "die", "und"]) for _ in range(30)), "en" if i % 2 else "de") for i in range(120)]
    df = spark.createDataFrame([*data, (200, None, "en"), (201, "123 ...", "de"), (202, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_id(spark, df, ~C.held_out()).collect()}
    assert all(got[i].lang_pred == k for i, _, k in data) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3
    assert langid.language_id(spark, nothing, ~C.held_out()).count() == 0
    assert {r.lang_pred for r in langid.language_id(spark, df.withColumn("lang", F.lit(None).cast("string")), ~C.held_out()).collect()} == {"und"}


def test_language_id_learns_every_language(spark, monkeypatch):
    monkeypatch.setattr(langid.fit, "__defaults__", (3, 5))
    data = [(200 * k + i, f"word{k}", f"lang{k:02}") for k in range(70) for i in range(1 + k % 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    langs, w = langid.train(df, F.lit(True))
    assert langs == [f"lang{k:02}" for k in range(70)] and len(w["bias"]) == 70


def test_language_gradients():
    w, rng = langid.new_weights(3, 4), np.random.default_rng(0)
    x, y = rng.integers(97, 110, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, g = langid.gradients(w, x, y)
    for k, a in w.items():
        i = np.unravel_index(np.abs(g[k]).argmax(), a.shape)
        old = a[i]
        a[i] = old + 0.01
        up = langid.gradients(w, x, y)[0]
        a[i] = old - 0.01
        down = langid.gradients(w, x, y)[0]
        a[i] = old
        assert abs((up - down) / 0.02 - g[k][i]) < 2e-3


def test_lm_base_and_model(spark, docs, nothing):
    lmscore.ROUNDS, old = 40, lmscore.ROUNDS
    try:
        held = C.held_out(mod=7, rest=2)
        got = lmscore.lm_scores(spark, docs, held).collect()
        flag = {r.doc_id: r.h for r in docs.select("doc_id", held.alias("h")).collect()}
        count = Counter()
        for i, t, *_ in rows():
            if not flag[i]:
                count.update([*(t or "").encode().lower().split(), b" "])
        n, v = sum(count.values()), len(count)
        base = defaultdict(list)
        for i, t, *_ in rows():
            w = [*(t or "").encode().lower().split(), b" "]
            base[i].append((len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)))
        assert len(got) == len(rows())
        for r in got:
            assert r.train_tokens == n and r.held_out == flag[r.doc_id] and r.score < 0
            assert any(a == r.n_tokens and b == r.n_known and abs(c - r.base_score) < 1e-6 * abs(c) for a, b, c in base[r.doc_id])
        assert lmscore.lm_scores(spark, nothing, held).count() == 0
    finally:
        lmscore.ROUNDS = old


def test_lm_counts_every_subword_of_the_training_texts(spark, monkeypatch):
    rng, seen = random.Random(8), []
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + rng.choice("bdlmnrst") + rng.choice(["", "er", "ing"]) for _ in range(2)) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keep = lmscore.emission
    monkeypatch.setattr(lmscore, "emission", lambda *a: seen.append(a) or keep(*a))
    monkeypatch.setattr(lmscore, "ROUNDS", 5)
    assert lmscore.lm_scores(spark, df, F.lit(False)).where("score < 0").count() == len(texts)
    with open(lmscore.VOCABULARY, "rb") as f:
        ids, _ = lmscore._encode([w for t in texts for w in t.encode().split()], f.read())
    want = Counter(ids.tolist())
    count, _, compact = seen[0]
    assert {i: int(count[:, compact[i]].sum()) for i in want} == want
    assert len({int(compact[i]) for i in want}) == len(want)


def test_lm_weights_learn_from_every_symbol(spark, monkeypatch):
    rng, windows = random.Random(9), []
    texts = [prose(n, rng) for n in (0, 1, 31, 32, 33, 64, 500, 3000)] + ["", "again", "again"]
    monkeypatch.setattr(lmscore, "ROUNDS", 1)
    monkeypatch.setattr(lmscore, "TRAIN_BATCH", 1)
    monkeypatch.setattr(lmscore, "trained", lambda spark, w, cls, compact, symbols: windows.extend(w.collect()) or lmscore.new_weights(symbols))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert lmscore.lm_scores(spark, df, F.lit(False)).count() == len(texts)
    with open(lmscore.VOCABULARY, "rb") as f:
        ids, _ = lmscore._encode([w.lower() for t in texts for w in t.encode().split()], f.read())
    got = Counter(i for r in windows for row in [np.frombuffer(r.window, np.uint16)] for i in row[2 : row[0] + 1].tolist())
    assert got == Counter(ids.tolist()) + Counter({lmscore.END: len(texts)})


def test_lm_windows_travel_one_a_row(spark, monkeypatch):
    """However long a text is: rows of all its windows fill the executors' heaps."""
    rng, cuts, keep = random.Random(10), [], lmscore.cut
    monkeypatch.setattr(lmscore, "cut", lambda df, s: cuts.append(keep(df, s)) or cuts[-1])
    monkeypatch.setattr(lmscore, "ROUNDS", 1)
    monkeypatch.setattr(lmscore, "TRAIN_BATCH", 1)
    monkeypatch.setattr(lmscore, "SOME", 100, raising=False)
    monkeypatch.setattr(lmscore, "trained", lambda spark, w, cls, compact, symbols: lmscore.new_weights(symbols))
    df = spark.createDataFrame([(1, prose(20_000, rng)), (2, "short"), (3, None)], "doc_id long, text string")
    assert lmscore.lm_scores(spark, df, F.lit(False)).count() == 3
    rows = [[v for v in r if isinstance(v, (bytes, bytearray))] for c in cuts if "kind" in c.columns for r in c.where("kind = 5").collect()]
    assert len(rows) > 20_000 // lmscore.WINDOW and {sum(map(len, r)) for r in rows} == {2 * (lmscore.WINDOW + 2)}


def test_lm_windows_grow_with_the_texts():
    assert lmscore.windows_wanted(10**6) == lmscore.ROUNDS * lmscore.TRAIN_BATCH and lmscore.windows_wanted(10**12) > 90 * lmscore.windows_wanted(10**10)
    bounds = np.array([0, 2, 200])
    got = lmscore.drawn(np.arange(200, dtype=np.uint16), bounds, 0.5, np.array([1, 2]))
    assert 98 <= len(got) <= 101 and all(n >= 2 and (r[:n] == r[0] + np.arange(n)).all() and (r[0] == 0) == (r[0] + n <= 2) for n, *r in ((int(x[0]), *x[1:].astype(int)) for x in got) for r in [np.array(r)])


def test_html_text(spark):
    cases = {
        "<p>a<p>b <b>c</b>": "a\n\nb c",
        "<ul><li>x<li>y<ol start=3><li>q</ol></ul>z": "- x\n- y\n  3. q\n\nz",
        "<table><tr><th>aa<td>b<tr><td>c<td>ddd</table>": "aa  b\nc   ddd",
        "a<script>if(a<b)x('</p>')</script><style>.h{display:none}</style><i class=h>no</i>b": "ab",
        "<div hidden>x</div><div style='display: none'>y</div>&amp;&lt;x&gt;&nbsp;&bogus;": "&<x>\xa0&bogus;",
        "<pre>\n  a\n b</pre>": "  a\n b",
        "one<br>two<br/>three": "one\ntwo\nthree",
        "<!-- c --><!DOCTYPE html><head><title>t</title></head>text": "text",
        "<b>unclosed <i>x</b> y</i></p>": "unclosed x y",
        "": "",
        "plain < text & more": "plain < text & more",
    }
    for page, want in cases.items():
        assert html.visible_text(page) == want, page
    assert html.visible_text(None) is None
    assert html.visible_text("<div>" * 5000 + "deep").strip() == "deep"
    df = spark.createDataFrame([(1, "u", "<p>x"), (2, "u", None), (3, None, "")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.html_text(df).collect()} == {1: "x", 2: None, 3: ""}


def test_html_odd_attribute_values():
    """Whatever an attribute holds, the page's text comes out."""
    rng = random.Random(11)
    odd = ["", "²", "٣", "3", " 2", "-4", "0", "9" * 5000, "9" * 4300, "1e3", "2.5", "\x00", "½", "３", "+1", "99999", "-" + "9" * 5000, "NaN", "\ud800"]
    for v in odd + ["".join(rng.choice("0123456789-+. ²٣xé") for _ in range(rng.randrange(1, 12))) for _ in range(300)]:
        for page in (f'<table><tr><td colspan="{v}">a<td>b<tr><td rowspan="{v}">c</table>', f'<ol start="{v}"><li>a<li>b</ol>c', f'<div class="{v}" id="{v}" style="{v}">a</div>b c'):
            got = html.visible_text(page)
            assert "a" in got and "b" in got and "c" in got, page
    assert html.visible_text("<ol start=-1><li>x<li>y</ol>") == "-1. x\n0. y"
    assert html.visible_text("<ol start='٣'><li>x</ol>") == "1. x"


def test_html_visibility_is_inherited_and_may_return():
    assert html.visible_text("a<span style='visibility:hidden'>b<i>c</i><b style='visibility: visible'>d</b>e</span>f") == "adf"
    assert html.visible_text("<style>.v{visibility:hidden}.s{visibility:visible}</style><p class=v>x <span class=s>y</span><p>z") == "y\n\nz"
    assert html.visible_text("<div style='visibility:collapse'>x<input value=q><p>y</div>z").strip() == "z"
    assert html.visible_text("<div style='display:none'><b style='visibility:visible'>x</b></div>z").strip() == "z"


def test_html_media_rules_and_xmp():
    x = "<p class=x>a</p>"
    for media in ("print", "screen and (max-width: 9px)", "(max-width:9px)", "not all", "print, (color)"):
        assert html.visible_text(f"<style>@media {media}{{.y{{color:red}} .x{{display:none}}}} .z{{display:none}}</style>{x}<p class=z>b</p>").strip() == "a", media
    for media in ("screen", "all", "print, Screen", "only screen"):
        assert html.visible_text(f"<style>@media {media}{{.x{{display:none}}}}</style>{x}b").strip() == "b", media
    assert html.visible_text("a<xmp><b>1  &amp;\n 2</b></xmp>c") == "a\n\n<b>1  &amp;\n 2</b>\n\nc"


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (8, 2), (2, 9)], "a long, b long")
    assert {(r.node, r.component) for r in C.components(e, spark).collect()} == {(5, 1), (4, 1), (3, 1), (1, 1), (9, 2), (8, 2), (2, 2)}


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(9)
    base = [prose(60, rng) for _ in range(40)]
    data = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    data += [(100, base[3], "en", "s", 1), (101, base[4] + " tail words here", "en", "s", 1), (102, prose(10, rng) + " " + " ".join(base[0].split()[:1]), "en", "s", 1)]
    bench = prose(20, rng)
    data += [(103, prose(30, rng) + " " + bench, "en", "s", 1), (104, None, "en", "s", None), (105, "", "en", "s", 0)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in P.run(spark, str(tmp_path)).collect()}
    assert set(range(40)) <= kept and not kept & {100, 103} and {102, 104, 105} <= kept
    assert 101 not in kept


def test_pipeline_edge_cases(spark, tmp_path):
    """Nulls in any column, repeated and very long rows, clashing names, and empty tables, stage by stage."""
    import corpus_pipeline as P

    rng = random.Random(19)
    long = "\n".join(prose(12, rng) for _ in range(3000))
    same = prose(50, rng)
    data = [(1, same, 3, 0.5, "x"), (1, same, 3, 0.5, "x"), (2, None, None, None, None), (None, prose(30, rng), 1, 0.1, "n"), (None, None, None, None, None), (3, "", 0, 1.0, ""), (4, long, len(long), 2.0, "l"), (5, "own\r\n" + prose(20, rng), 1, 0.0, "\t"), (6, same + " z", 1, 0.0, "y")]
    kind = "doc_id long, text string, n_lines_removed int, score double, component_id string"
    for name, rows_ in (("full", data), ("empty", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(rows_, kind).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 0), (None, 1), (2, None)][: len(rows_)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, prose(20, rng)), (2, None), (None, "")][: len(rows_)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for stage, f in P.STAGES[:-1]:
            got = f(spark, docs, d)
            assert got.columns == docs.columns, stage
            rank = lambda rows: sorted(map(repr, (tuple(r) for r in rows)))
            want = [r for r in rows_ if stage != "ngram_jaccard" or r[0] != 6]
            if stage == "line_dedup":
                # equal rows are one document; nothing else shares a line
                assert rank(got.collect()) == rank(want)
            else:
                assert rank(got.collect()) == rank(want), stage
        assert P.run(spark, d).count() == (0 if not rows_ else P.run(spark, d).select("doc_id", "part", "slot", "batch", "bucket_len").distinct().count())


def test_lm_tables_give_the_logits_of_attention():
    w, x = lmscore.new_weights(50), np.random.default_rng(0).integers(0, 50, (7, lmscore.WINDOW))
    assert np.abs(lmscore.attend(w, x)[0] - lmscore.class_logits(lmscore.tables(w), x)).max() < 1e-5


def test_lm_gradients():
    w, rng = {k: a.astype(float) for k, a in lmscore.new_weights(9).items()}, np.random.default_rng(0)
    x, y = rng.integers(0, 9, (3, lmscore.WINDOW)), rng.integers(0, lmscore.CLASSES, (3, lmscore.WINDOW))
    use = rng.random(x.shape) < 0.7
    _, g = lmscore.gradients(w, x, y, use)
    for k, a in w.items():
        i = np.unravel_index(np.abs(g[k]).argmax(), a.shape)
        old, loss = a[i], []
        for d in (1e-4, -1e-4):
            a[i] = old + d
            loss.append(lmscore.gradients(w, x, y, use)[0])
        a[i] = old
        assert abs((loss[0] - loss[1]) / 2e-4 - g[k][i]) < 1e-4, k


def test_lm_probabilities_sum_to_one():
    """Over all next symbols after any history, and over all that begin a word where one begins."""
    rng = np.random.default_rng(4)
    ids = rng.choice(lmscore.IDS - 1, 300, replace=False)
    begins = np.zeros(lmscore.IDS, bool)
    begins[ids[:120]] = begins[lmscore.END] = True
    count = np.zeros(lmscore.IDS, np.int64)
    count[ids] = rng.integers(1, 900, 300)
    count[lmscore.END] = 50
    held, after = rng.integers(-9, 9, (lmscore.IDS, lmscore.HELD)), rng.integers(0, 9, (lmscore.IDS, lmscore.NEXT))
    cls, compact, symbols, split = lmscore.new_classes(count, held, after, begins)
    assert (cls[begins] < split).all() and (cls[~begins] >= split).all() and cls.max() < lmscore.CLASSES
    pair = rng.integers(0, 5, (lmscore.n_contexts(symbols), symbols)).astype(np.float32)
    em = lmscore.emission(pair, cls, compact)
    w = {k: 3 * a for k, a in lmscore.new_weights(symbols).items()}
    past = np.array([lmscore.END, ids[3], ids[200], ids[7], ids[250]], np.uint16)
    x = np.concatenate([compact[past], np.full(lmscore.WINDOW - len(past), compact[lmscore.END])])[None]
    z = lmscore._log_softmax(lmscore.attend(w, x)[0])[0, len(past) - 1]
    row = np.where(begins, len(em) - 1, lmscore.contexts(cls, compact, symbols)[past[-1]])
    p = np.exp(z[cls].astype(float)) * 10.0 ** em[row, compact]
    assert abs(p.sum() - 1) < 1e-3 and p[begins].sum() < 1
    # the score of a text is that product: of its words and its end, symbol by symbol
    out = np.append(past, lmscore.END).astype(np.uint16)
    first = begins[out]
    words, end = lmscore.score_words(w, em, cls, compact, split, out, first, np.array([0, len(out)]))
    total = 0.0
    for k in range(1, len(out)):
        x = np.concatenate([compact[out[:k]], np.full(lmscore.WINDOW - k, compact[lmscore.END])])[None]
        lp = lmscore._log_softmax(lmscore.attend(w, x)[0])[0, k - 1].astype(float)
        r = len(em) - 1 if first[k] else lmscore.contexts(cls, compact, symbols)[out[k - 1]]
        total += lp[cls[out[k]]] / math.log(10) + em[r, compact[out[k]]]
        if k == 1:  # a text begins with a word or ends: that much is given
            total -= math.log10(np.exp(lp[:split]).sum())
    assert len(words) == 2 and abs(words.sum() + end.sum() - total) < 1e-4


def test_lm_scores_follow_rows_not_partitions(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "ROUNDS", 20)
    rng = random.Random(21)
    data = [(i, prose(rng.randint(0, 80), rng)) for i in range(60)]
    data += [(1, data[1][1]), (1, data[1][1]), (2, "other words of id two"), (2, "other words of id two"), (None, "no id"), (70, None), (71, "long " * 40_000)]
    held = C.held_out(mod=7, rest=2)
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("score", F.lit("x"))
    rank = lambda rows: sorted(rows, key=lambda r: (r.doc_id or -1, r.n_tokens, r.score))
    a = rank(lmscore.lm_scores(spark, df.repartition(1, F.rand(1)), held).collect())
    monkeypatch.setattr(lmscore, "HOT", 40)  # more words go by hash
    b = rank(lmscore.lm_scores(spark, df.repartition(5, F.rand(5)), held).collect())
    assert len(a) == len(b) == len(data)
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5] and abs(x.score - y.score) < 1e-4 * abs(x.score) and abs(x.base_score - y.base_score) < 1e-6 * abs(x.base_score)
    n = Counter(r.doc_id for r in a)
    assert n[1] == n[2] == 3 and all(r.n_known <= r.n_tokens for r in a)
    assert len({round(r.score, 3) for r in a if r.doc_id == 1}) == 1 and [r.n_tokens for r in a if r.doc_id == 70] == [1]


def test_lm_shards_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "ROUNDS", 2)
    rng, cls = np.random.default_rng(2), np.zeros(lmscore.IDS, np.uint8)
    rows = [(bytes(np.concatenate([[lmscore.WINDOW + 1], rng.integers(0, 40, lmscore.WINDOW + 1)]).astype(np.uint16)),) for _ in range(5 * 2 * 2 * lmscore.TRAIN_BATCH)]
    cls[:40], compact = np.arange(40) % 5, np.minimum(np.arange(lmscore.IDS), 40).astype(np.uint16)
    df = spark.createDataFrame(rows, "window binary")
    a, b = (lmscore.trained(spark, df.repartition(n), cls, compact, 41) for n in (2, 6))
    assert all(np.allclose(a[k], b[k]) and np.isfinite(a[k]).all() for k in a) and np.abs(a["emb"] - lmscore.new_weights(41)["emb"]).max() > 1e-3


def test_kept_columns_may_clash(spark, nothing):
    """Columns called like inner ones pass through the operators that keep columns."""
    docs = spark.createDataFrame([(1, "the text one", "en", 0.5, "p"), (2, None, "en", 0.5, "q"), (2, "le texte deux", "fr", 0.5, "r")], "doc_id long, text string, lang string, score double, k0 string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(spark, docs, labels, F.lit(True), ("k0", "doc_id", "text")).collect()
    assert sorted((r.k0, r.doc_id, r.text) for r in got) == [("p", 1, "the text one"), ("q", 2, None), ("r", 2, "le texte deux")]
    got = langid.language_id(spark, docs, F.lit(False), ("text", "k0")).collect()
    assert sorted((r.k0, r.text, r.lang_pred) for r in got) == [("p", "the text one", "und"), ("q", None, "und"), ("r", "le texte deux", "und")]
    pages = spark.createDataFrame([(1, "t", "<p>x"), (1, "t", "<p>x"), (2, None, "<i>" + "long " * 50_000), (None, "u", None)], "page_id long, text string, html string")
    got = html.html_text(pages, ("page_id", "text", "html")).collect()
    assert sorted(map(repr, ((r.page_id, r.text_in, r.html, r.text) for r in got))) == sorted(map(repr, [(1, "t", "<p>x", "x"), (1, "t", "<p>x", "x"), (2, None, "<i>" + "long " * 50_000, ("long " * 50_000).strip()), (None, "u", None, None)]))
    assert html.html_text(pages.where("page_id > 5"), ("page_id",)).count() == 0


def test_packed_features_come_back():
    for x in ([0], [0, 5, 70_000], [0, 70_000, 70_001], list(range(0, 2**20, 65_535))):
        assert toxicity.unpacked(toxicity.packed(np.array(x))).tolist() == x


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    data = [(int(rng.random() < 0.4), np.unique(np.append(rng.integers(1, 60, rng.integers(0, 9)), 0)).astype(np.uint32)) for _ in range(300)]
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        sparse = toxicity.L1 if k else 0.0
        return 0.0 if abs(z[k]) <= sparse else -(z[k] - math.copysign(sparse, z[k])) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    for y, idx in data:
        w = {int(k): weight(int(k)) for k in idx}
        g = (1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - y) * (toxicity.TOXIC if y else 1)
        for k in w:
            s = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA
            z[k] += g - s * w[k]
            n[k] += g * g
    got = toxicity.ftrl(iter(data))
    assert np.allclose(got[:60], [weight(k) for k in range(60)], atol=1e-5) and not got[60:].any() and got[:60].any()


def test_topk_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(90)] + [(200, [1.0, 2.0]), (202, [3.0, 1.0])], "vec_id long, embedding array<float>")
    v = topk.quantised(df)
    one = topk.exact_topk(spark, v, v.where("id % 4 = 0"), k=3).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    assert topk.exact_topk(spark, v, v.where("id % 4 = 0"), k=3).orderBy("query_id", "rank").collect() == one and len(one) == 70
    assert topk.exact_topk(spark, v.where("id < 0"), v.where("id % 4 = 0"), k=3).count() == 0
