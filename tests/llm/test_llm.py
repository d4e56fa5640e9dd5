import base64
import collections
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import quota
from terrane.llm import mixing, raking, sketch, subjects, tokens, topn
from terrane.llm.bpe import Encoder

VOCABULARY = tokens.vocabulary()
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


# 1: top n


def test_top_n_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "b", None]), r.choice(["x", "y"]), r.choice([None, float("nan"), float("inf"), -1.0, 0.5, 0.5, r.random()])) for i in range(3000)]
    rows += [(10_000, "c", "x", 1.0)] * 50 + [(10_001, "c", "x", 1.0), (10_002, "c", "x", 0.0), (None, "c", "x", 9.0)]
    d = spark.createDataFrame(rows, "id long, g string, h string, v double").withColumns({"rank": F.lit("clash"), "n": F.lit(1)})
    got = {(x.g, x.h): [] for x in topn.top_n(d, ["g", "h"], "v", "id", 5).collect()}
    for x in topn.top_n(d, ["g", "h"], "v", "id", 5, per=100).orderBy("rank").collect():
        got[x.g, x.h].append(x.id)
    want = collections.defaultdict(set)
    for i, g, h, v in rows:
        if None not in (i, g, v) and v == v and abs(v) != float("inf"):
            want[g, h].add((-v, i))
    assert got == {k: [i for _, i in sorted(s)[:5]] for k, s in want.items()}
    assert topn.top_n(d.limit(0), ["g"], "v", "id", 5).count() == 0


def test_top_n_counts_a_key_of_many_scores_once(spark):
    d = spark.createDataFrame([("g", "a", float(v)) for v in range(5, 11)] + [("g", "b", 1.0), ("g", "c", 0.5)], "g string, id string, v double")
    for per in (10**6, 4, 1):
        got = topn.top_n(d, ["g"], "v", "id", 3, per=per).orderBy("rank").collect()
        assert [(r.id, r.v) for r in got] == [("a", 10.0), ("b", 1.0), ("c", 0.5)]


# 3: percentiles


def test_codes_order_as_doubles():
    v = np.array([-1e300, -5.0, -1e-300, -0.0, 0.0, 1e-300, 0.1, 5.0, 1e300])
    c = sketch.encode(v)
    assert (np.diff(c.astype(np.int64)) >= 0).all() and c[3] == c[4]
    for x, k in zip(v, c):
        low, high = sketch.decode(k)
        assert low <= x <= high


def test_sketch_ranks_merging_and_deletion():
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0, 1, 60_000), rng.lognormal(3, 2, 60_000), np.zeros(30_000)])
    rng.shuffle(v)
    one = sketch.Dyadic().add(v)
    parts = sketch.Dyadic()
    for p in np.array_split(v, 7):
        parts.merge(sketch.Dyadic.unpack(sketch.Dyadic().add(p).pack()))
    assert (parts.rows == one.rows).all() and (parts.exact == one.exact).all()
    few = sketch.Dyadic().add(v[:1000]).merge(sketch.Dyadic().add(v[500:1000]), -1)
    assert few.rows is None and few.n == 500 and sketch.Dyadic.unpack(few.pack()).quantile(0.5)[0] <= np.median(v[:500]) + 1e-9
    assert sketch.Dyadic.unpack(few.pack()).merge(one).n == len(v) + 500
    parts.merge(sketch.Dyadic().add(v[:50_000]), -1)
    for s, left in ((one, np.sort(v)), (parts, np.sort(v[50_000:]))):
        for p in (0.001, 0.05, 0.25, 0.5, 0.9, 0.975, 0.999):
            low, high = s.quantile(p)
            below, upto = np.searchsorted(left, low) / len(left), np.searchsorted(left, high, "right") / len(left)
            assert below - 0.002 <= p <= upto + 0.002
    assert sketch.Dyadic().quantile(0.5) is None


def batches(spark, rows):
    return spark.createDataFrame(rows, "batch_id long, context_id long, name string, values array<double>, loaded_at int")


def test_outlying_batches(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, 1, "n", [float(x) for x in rng.normal(0, 1, 101)], 1) for i in range(40)]
    rows += [(100, 1, "n", [9.0, None, float("nan"), float("inf"), 9.5], 1), (101, 1, "n", [-9.0] * 4, 1), (101, 1, "n", [-9.0] * 4, 2)]
    rows += [(102, 1, None, [99.0], 1), (103, 1, "n", [], 1), (104, 1, "n", None, 1), (105, 2, "n", [1.0], 1), (106, None, "n", [1.0], 1), (None, 1, "n", [50.0], 1), (107, 1, "one", [3.0], 1)]
    contexts = spark.createDataFrame([(1, 0.95), (2, None)], "context_id long, nt2_quantile double")
    for task, sparse in ((10**6, 10**6), (500, 10**6), (500, 100)):  # a group in one task, spread over several, and by counters
        monkeypatch.setattr(sketch, "TASK", task)
        monkeypatch.setattr(sketch, "SPARSE", sparse)
        got = {r.batch_id: (r.side, r.median) for r in sketch.outlying(batches(spark, rows).withColumn("n", F.lit(0)), contexts).collect()}
        assert {k: v for k, v in got.items() if v[0]} == {100: ("above", 9.25), 101: ("below", -9.0)}
        assert set(got) == {*range(40), 100, 101, 107}
    assert sketch.outlying(batches(spark, []), contexts).count() == 0


# 4: shares


def test_raking_moves_observed_counts_to_margins():
    """Counts far from the targets are moved to them, and where a cell is short, its source, semester and year keep theirs."""
    have = np.array([100, 900, 500, 500])
    target, margins = np.array([0.4, 0.1, 0.3, 0.2]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    share, gap = raking.rake(have, target, margins)
    assert gap < 1e-9 and np.allclose(share, target)
    short, gap = raking.rake(have, target, margins, size=500)  # the first cell has 100 rows, half of what it should give
    assert share.sum() == pytest.approx(1) and short[0] <= 0.2 and gap < 0.005
    assert np.bincount(margins[0], short) == pytest.approx([0.5, 0.5], abs=0.005) and np.bincount(margins[1], short) == pytest.approx([0.7, 0.3], abs=0.005)


def test_raking_without_rows():
    have = np.array([10, 0, 5, 7])
    share, gap = raking.rake(have, np.array([0.4, 0.1, 0.3, 0.2]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])])
    assert share[1] == 0 and abs(share.sum() - 1) < 1e-9 and gap < 0.15
    assert raking.rake(np.zeros(2, int), np.array([0.5, 0.5]), [np.array([0, 1])])[1] == 0.5


def test_sample_meets_shares_and_reports(spark):
    rows, i = [], 0
    for src, sem, n in (("A", "2020-Winter", 4000), ("A", "2021-Winter", 500), ("B", "2020-Winter", 2000), ("B", "2021-Winter", 3)):
        for _ in range(n):
            rows.append((i, f" {src.lower()} ", sem.upper(), int(sem[:4])))
            i += 1
    rows += [(0, "a", "2020-Winter", 2020), (i, "A", "2020-Winter", 2019), (i + 1, None, "2020-Winter", 2020), (i + 2, "C", "2020-Winter", 2020), (None, "A", "2020-Winter", 2020), (i + 3, "A", "unknown", None)]
    p = spark.createDataFrame(rows, T.StructType([T.StructField("occ_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("semester", T.StringType()), T.StructField("year-int", T.IntegerType())])).withColumn("weight", F.lit("clash"))
    t = spark.createDataFrame([("A", "2020-Winter", 5000, 1), ("A", "2021-Winter", 1500, 5), ("B", "2020-Winter", 3400, 5), ("B", "2021-Winter", 100, 2)], "source string, semester string, target_per_10k int, min_rows int")
    got, report = raking.sample(p, t)
    rep = {(r.source, r.semester): r for r in report.collect()}
    assert {k for k, r in rep.items() if r.unmet} == {("B", "2021-Winter")}
    drawn = collections.Counter((r.source, r.semester) for r in got.collect())
    size = 6503 // 4
    assert sum(drawn.values()) == size and got.select("occ_id").distinct().count() == size
    assert drawn["B", "2021-Winter"] >= 2
    for k, r in rep.items():
        assert r.rows == drawn[k] and r.repaired == min(r.available, max(r.drawn, r.needed)) and r.gap == r.needed - min(r.repaired, r.needed)
    assert sum(r.drawn for r in rep.values()) == size
    assert abs(drawn["A", "2020-Winter"] / size - 0.5) < 0.05
    empty, report = raking.sample(p.limit(0), t)
    assert empty.count() == 0 and report.filter("unmet").count() == 4


def test_sample_keeps_margins_where_cells_are_short(spark):
    """A and B lack rows in one semester each and have enough in the other; C has no target but a minimum."""
    told = {("A", "2020-Winter"): (200, 3000, 1), ("A", "2021-Winter"): (3000, 2000, 1), ("B", "2020-Winter"): (3000, 2000, 1), ("B", "2021-Winter"): (200, 3000, 1), ("C", "2020-Winter"): (50, 0, 7)}
    rows = [(src, sem, int(sem[:4])) for (src, sem), (n, _, _) in told.items() for _ in range(n)]
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "occ_id long, source string, semester string, `year-int` int")
    t = spark.createDataFrame([(*k, per, least) for k, (_, per, least) in told.items()], "source string, semester string, target_per_10k int, min_rows int")
    got, report = raking.sample(p, t)
    size, report = len(rows) // 4, report.collect()
    drawn = collections.Counter((r.source, r.semester) for r in got.collect())
    assert sum(drawn.values()) == size and all(drawn[r.source, r.semester] == r.rows for r in report)
    assert drawn["A", "2020-Winter"] == drawn["B", "2021-Winter"] == 200 and drawn["C", "2020-Winter"] == 7
    for i, name in ((0, "A"), (0, "B"), (1, "2020-Winter"), (1, "2021-Winter")):
        assert abs(sum(n for k, n in drawn.items() if k[i] == name) / size - 0.5) < 0.005, name
    shares = [collections.Counter(), collections.Counter()]
    for k, n in drawn.items():
        for s, name in zip(shares, k):
            s[name] += n / size
    worst = max(abs(s[name] - sum(per for k, (_, per, _) in told.items() if name in k) / 10000) for s in shares for name in s)
    assert abs(report[0].margin_gap - worst) < 1e-9


def test_whole_rows_keep_bounds_and_size():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        have, per = rng.integers(0, 300, n), rng.multinomial(10000, rng.dirichlet(np.ones(n)))
        size = int(have.sum()) // 4
        low = raking.minima(rng.integers(0, 9, n), per, have, size)
        margins = [rng.integers(0, 3, n), rng.integers(0, 5, n)]
        rows = raking.whole(raking.rake(have, per / 10000, margins, size=size, least=low)[0], have, low, size) if size else low
        assert (rows <= have).all() and (rows >= low).all()
        assert rows.sum() == max(low.sum(), min(size, have[(per > 0) | (low > 0)].sum()))


def test_take_stays_in_the_quota(spark):
    d = spark.range(5000).select("id", F.when(F.col("id") < 4000, "big").otherwise("small").alias("g"), ((F.col("id") * 7919 % 5003) / 5003).alias("k"), (F.col("id") % 5 + 1).alias("w"))
    q = spark.createDataFrame([("big", 3000), ("small", 10**6)], "g string, q long")
    got = quota.take(d, q, ["g"], "k", ["id"], F.col("w"), "q").collect()
    big = sorted((r.k, r.id, r.w) for r in d.filter("g = 'big'").collect())
    want, total = [], 0
    for k, i, w in big:
        total += w
        if total > 3000:
            break
        want.append(i)
    assert sorted(r.id for r in got if r.g == "big") == sorted(want)
    assert sum(r.g == "small" for r in got) == 1000


def test_take_passes_over_what_does_not_fit(spark):
    """A row larger than what is left doesn't keep those behind it out."""
    rows = [(0, "g", 0.0, 5000)] + [(i, "g", i / 1000, 10) for i in range(1, 899)] + [(2000, "h", 0.1, 700), (2001, "h", 0.2, 400), (2002, "h", 0.3, 250), (2003, "h", 0.4, 60)]
    d = spark.createDataFrame(rows, "id long, g string, k double, w long")
    q = spark.createDataFrame([("g", 3000), ("h", 1000), ("none", 5)], "g string, q long")
    got = quota.take(d, q, ["g"], "k", ["id"], F.col("w"), "q", rounds=8, slack=0.0).collect()
    assert sorted(r.id for r in got if r.g == "g") == list(range(1, 301))
    assert sorted(r.id for r in got if r.g == "h") == [2000, 2002]
    assert quota.take(d.limit(0), q, ["g"], "k", ["id"], F.col("w"), "q", rounds=8).count() == 0


def test_smallest(spark):
    d = spark.range(20_000).select("id", ((F.col("id") * 7919 % 20_011) / 20_011).alias("k"))
    want = sorted((r.k, r.id) for r in d.collect())[:5000]
    assert sorted(r.id for r in quota.smallest(d, 5000, "k", ["id"]).collect()) == sorted(i for _, i in want)
    assert quota.share_of(d, 0.25, "k", ["id"]).count() == 5000 and quota.share_of(d.limit(0), 0.25, "k", ["id"]).count() == 0


# 6: tokens


@needs_vocabulary
def test_ids_are_those_of_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    r = random.Random(7)
    texts = [None, "", " ", "\t\n", "<|endoftext|> it's", "a" * 30_000, " " * 5000 + "x", "été 漢字 👩‍🚒​﻿\x00\x85", "don't  you'll\r\n\r\n  we'VE", *["".join(r.choice("abcde ABC01'’-—é\n\t ") for _ in range(r.randint(0, 200))) for _ in range(400)]]
    d = spark.createDataFrame(list(enumerate(texts)) + [(5, "again")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = tokens.encoded(d, "doc_id", "text")
    assert got.schema["ids"].dataType == T.ArrayType(T.LongType())
    rows = got.collect()
    assert len(rows) == len(texts) + 1
    by = {x.doc_id: list(x.ids) for x in rows if x.doc_id != 5}
    for i, text in enumerate(texts):
        if i != 5:
            assert by[i] == t.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert {x.doc_id: x.n_tokens for x in tokens.encoded(d, "doc_id", "text", ids=False).filter("doc_id <> 5").collect()} == {i: len(x) for i, x in by.items()}
    assert tokens.encoded(d.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
def test_ids_spell_the_text():
    e = Encoder(open(VOCABULARY, "rb").read())
    path = tokens.vocabulary("byte_bpe_50k.tiktoken")
    if os.path.exists(path):
        spelled = {int(n): base64.b64decode(t) for t, n in map(bytes.split, open(path, "rb"))}
        for text in ("Tracks in the mud", "ĉu ŝi?   ½ km"):
            assert b"".join(spelled[i] for i in e.encode(text)) == text.encode()


# 7: mixing


@needs_vocabulary
def test_mix(spark):
    word = "wetland " * 20
    rows = [(i, word * (1 + i % 5), "Big" if i % 2 else " big ") for i in range(600)] + [(1000 + i, word, "small") for i in range(30)] + [(2000, None, "big"), (2001, "", "big"), (2002, word, None), (2003, word, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", F.lit("clash"))
    targets = spark.createDataFrame([("BIG", 6000, 1), ("small", 2500, 2), ("none", 1500, 4)], "source string, target_per_10k int, max_repeats int")
    sample, report = mixing.mix(docs, targets)
    rep = {r.source: r for r in report.collect()}
    t = {s: rep[s].available for s in rep}
    total = sum(t.values())
    assert t["none"] == 0 and {s for s, r in rep.items() if r.short} == {s for s, share, cap in (("BIG", 6000, 1), ("small", 2500, 2), ("none", 1500, 4)) if cap * t[s] < share / 10000 * total}
    got = sample.collect()
    assert len({r.doc_id for r in got}) == len(got) and all(r.copies <= {"BIG": 1, "small": 2}[r.source] for r in got)
    for s in ("BIG", "small"):
        given = sum(r.n_tokens * r.copies for r in got if r.source == s)
        assert given == rep[s].given and given <= max(rep[s].wanted, 0)
    assert rep["BIG"].given > 0.97 * rep["BIG"].wanted
    assert rep["small"].given == 2 * t["small"] and rep["small"].missing == rep["small"].wanted - rep["small"].given
    # one document longer than all that is wanted of its source doesn't keep the others out
    long = docs.unionByName(spark.createDataFrame([(5000 + i, word * 3000, "other", "x") for i in range(2)] + [(6000 + i, word, "other", "x") for i in range(3000)], docs.schema))
    more = spark.createDataFrame([("BIG", 9000, 9), ("other", 1000, 1)], "source string, target_per_10k int, max_repeats int")
    for seed in range(3):
        got = {r.source: r for r in mixing.mix(long, more, seed=seed)[1].collect()}["other"]
        assert not got.short and got.given > 0.99 * got.wanted
    sample, report = mixing.mix(docs.limit(0), targets)
    assert sample.count() == 0 and report.filter("short").count() == 0


def test_inclusion_sums_to_the_tokens_wanted(spark):
    r = random.Random(3)
    for part in (500, 20_000, 90_000):
        sizes = [int(r.lognormvariate(4, 1.2)) + 1 for _ in range(1000)]
        rows = spark.createDataFrame([("s", n, part) for n in sizes], "source string, n_tokens long, part long")
        c = mixing.inclusion(rows).first()[1]
        assert sum(min(1.0, c / n**0.5) * n for n in sizes) == pytest.approx(min(part, sum(sizes)), rel=0.03)


# 8: subjects


def test_hashed_words_pairs_and_sentences():
    texts = ["One two, three. Two!\r\n\r\nSee 3: x? And so on", None, "", " \n", "two", "O’Neill's — dos"]
    words, ends, word_ends, sentence_ends = subjects.hashed(texts, 15)
    assert list(np.diff(word_ends, prepend=0)) == [9, 0, 0, 0, 1, 2] and list(np.diff(sentence_ends, prepend=0)) == [4, 0, 0, 0, 1, 1]
    assert list(ends[:4]) == [3, 4, 6, 9] and list(ends[4:]) == [1, 2]
    term, pair = subjects._terms(words)
    assert term[1] == term[3] == term[9] and len(set(term[[0, 1, 2]])) == 3  # "two" wherever it stands
    none = pair == 1 << 15
    assert list(none[:9]) == [True, False, True, True, True, True, True, False, False]  # none across a comma or an end


def test_decomposition_over_many_tasks(spark):
    """Sums of 40 tasks, added in several steps, give the leading directions of the whole matrix."""
    r = random.Random(4)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("ash", "bee", "cod")]
    docs = [(i, " ".join(r.choices(topics[i % 3], k=30)) + ". " + " ".join(r.choices(sum(topics, []), k=3))) for i in range(400)] + [(1000, None), (1001, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    s = subjects.Settings(bits=8, dims=3, passes=4)
    told = subjects.features(d, "doc_id", "text", s.bits)
    basis = subjects.decomposed(told, np.ones(256, np.float32), s)
    a = np.zeros((len(docs), 257))
    for k, (_, text) in enumerate(docs):
        for t in subjects._terms(subjects.hashed([text], s.bits)[0]):
            np.add.at(a[k], t, 1)
    a = a[:, :256] / np.maximum(np.linalg.norm(a[:, :256], axis=1, keepdims=True), 1e-9)
    want = np.linalg.svd(a, full_matrices=False)[2][:3].T
    assert np.linalg.svd(want.T @ basis)[1].min() > 0.99  # both span the same space
    assert subjects.occurrences(told, 256).sum() == sum((t < 256).sum() for _, text in docs for t in subjects._terms(subjects.hashed([text], s.bits)[0]))


def made(n, seed):
    r = random.Random(seed)
    words = {"sport": ["goal", "match", "team", "coach"], "law": ["court", "judge", "appeal", "permit"], "food": ["bread", "soup", "oven", "salt"]}
    docs, labels = [], []
    for i in range(n):
        own = r.sample(sorted(words), r.choice([0, 1, 1, 2]))
        text = ["Thanks to everybody who helped.", "The list is not complete."]
        for s in own:
            text += [f"We saw the {r.choice(words[s])} near the {r.choice(words[s])} in {r.randint(2000, 2024)}." for _ in range(r.randint(2, 4))]
        text += [f"Unlike the {r.choice(words[s])} mentioned elsewhere, this is another matter." for s in words if s not in own and r.random() < 0.4]
        r.shuffle(text)
        docs.append((i, " ".join(text)))
        labels += [(i, s) for s in own] or [(i, None)]
    return docs, labels


def test_subjects_on_held_out_documents(spark):
    docs, labels = made(600, 5)
    docs += [(9000, None), (9001, ""), (9002, " \n"), (None, "the judge and the court."), (9003, "the goal. " * 20_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"ids": F.lit(1), "subject": F.lit("clash")})
    known = spark.createDataFrame([x for x in labels if x[0] < 300], "doc_id long, subject string")
    s = spark.createDataFrame([("sport", "Goals and matches of a team."), ("law", "Courts and permits."), ("food", "Bread and soup.")], "subject string, description string")
    got = subjects.assigned(d, s, known).collect()
    assert len(got) == len(set(map(tuple, got)))
    have, want = {tuple(r) for r in got if 300 <= r.doc_id < 600}, {x for x in labels if x[0] >= 300 and x[1]}
    assert len(have & want) > 0.95 * len(want) and len(have & want) > 0.95 * len(have)
    assert not {r.doc_id for r in got} & {9000, 9001, 9002, None}
    assert subjects.assigned(d.limit(0), s, known).count() == 0
    assert subjects.assigned(d, s.limit(0), known).count() == 0
    none = subjects.assigned(d, s, known.limit(0))
    assert none.columns == ["doc_id", "subject"] and none.count() >= 0
