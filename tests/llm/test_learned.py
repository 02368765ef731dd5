"""Near duplicates, language identification and quality selection: brute force, held-out accuracy, odd rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from propgraph.llm import langid, minhash, quality
from propgraph.llm.words import shingle_set, word_hashes
from tests.llm.test_pipeline import near_kept, words


def test_words_are_those_of_the_pattern():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aB é\t\n\x0b\x0c\r\x1c\x85\xa0ß日") for _ in range(rng.randrange(40)))
        hashes, start, end = word_hashes(text)
        data = text.encode()
        assert [data[a:b].lower().decode() for a, b in zip(start, end, strict=True)] == words(text)
        assert len(set(hashes.tolist())) == len(set(words(text)))
    assert len(shingle_set("a b c")) == 1 and len(shingle_set("")) == 0 and len(shingle_set("A b C d e f")) == 2
    assert (shingle_set("A b") == shingle_set("a\nb")).all() and not (shingle_set("a b") == shingle_set("b a")).any()


def variants(rng, base, n, rate):
    out = []
    for _ in range(n):
        w = list(base)
        for k in range(len(w)):
            if rng.random() < rate:
                w[k] = f"n{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for g in range(25):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(20, 160))]
        texts += [" ".join(base)] * rng.randrange(1, 4) + variants(rng, base, 6, rng.choice([0.005, 0.02, 0.04, 0.06]))
    texts += ["", None, " \n", "one two", "ONE  two", "one two three", "x" * 100_000, "w " * 30_000]
    rng.shuffle(texts)
    rows = [(1000 - 3 * k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("n", F.lit("clash")).withColumn("component_id", F.lit(2)).repartition(3)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r.id for r in got if r.kept} == near_kept(df.collect())
    sets = dict(rows)
    for r in got:
        w = words(sets[r.id])
        assert r.n_shingles == (len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)


def test_near_duplicates_of_a_hot_group_and_chains(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    hot = variants(rng, base, 300, 0.012)
    chain = [" ".join(f"c{k}" for k in range(a, a + 100)) for a in range(0, 120, 12)]  # neighbours are near, ends are not
    rows = list(enumerate(hot + chain))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id for r in got if r.kept} == near_kept(spark.createDataFrame(rows, "doc_id long, text string").collect())


def test_near_duplicates_repeated_null_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (5, text + " more"), (None, None)], "doc_id long, text string")
    got = sorted(((r.id or -1, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 3, True), (3, 3, True), (-1, None, True), (5, 3, False), (-1, None, True)], key=str)
    assert minhash.near_duplicates(df.filter("doc_id = 9")).count() == 0


def test_bayesian_bounds():
    bounds = minhash.least_matches(75)
    assert [n for n, _ in bounds] == list(range(25, 201, 25)) and all(a[1] < b[1] for a, b in zip(bounds, bounds[1:], strict=False))
    t = 0.75 + 0.25 / 256
    for n, need in bounds:  # a pair at the threshold is lost with a small probability at each batch
        assert sum(math.comb(n, m) * t**m * (1 - t) ** (n - m) for m in range(need)) < 1e-4
    a = np.zeros((2, 200), dtype=np.uint8)
    b = a.copy()
    b[1, ::2] = 1
    assert minhash.survives(a, b, bounds).tolist() == [0]


def test_language_held_out_accuracy(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang")
    found = langid.langid_query(spark, medium).join(docs, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == docs.count() and 100 < len(held) < 320
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_mixtures_and_odd_rows(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    model = langid.fit(docs)
    en, de = (" ".join(r.text for r in docs.filter(F.col("lang") == x).limit(6).collect())[:6000] for x in ("en", "de"))
    lang, share, shares = model.infer(langid.trigrams(en + " " + de))
    assert set(shares) == {"en", "de"} and 0.3 < shares["de"] < 0.7 and share == max(shares.values())
    assert model.infer(langid.trigrams(en))[0] == "en" and model.infer(langid.trigrams(de + en[:300]))[0] == "de"
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? 😀"), (4, en[:400]), (4, en[:400]), (None, de * 30)], "doc_id long, text string").withColumn("lang_pred", F.lit(5)).withColumn("_lang", F.lit("clash"))
    rows = langid.identify(odd.drop("_lang"), model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in rows) == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.filter("doc_id = 77"), model).count() == 0


def test_quality_selects_good_documents(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    rows = quality.quality_query(spark, medium)
    n = rows.count()
    share = labels.agg(F.avg("quality")).head()[0]
    assert abs(rows.filter("selected").count() - round(share * n)) <= 1
    by = {r.quality: r.s for r in rows.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("selected").cast("double")).alias("s")).collect()}
    assert by[1] > 0.93 and by[0] < 0.35
    again = quality.quality_query(spark, medium).filter("selected").select("doc_id").exceptAll(rows.filter("selected").select("doc_id"))
    assert again.isEmpty()


def test_quality_against_brute_force_and_odd_rows(spark):
    docs = [(k, " ".join(f"{'good' if k % 2 else 'bad'}{(k * j) % 17}" for j in range(1, 40))) for k in range(60)] + [(100, None), (101, " "), (None, "good1 good2"), (7, "good7 " * 39)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("good", F.lit(1))
    labels = spark.createDataFrame([(k, k % 2 == 1) for k in range(20)] + [(3, None), (None, True)], "id long, good boolean")
    raw, target = np.full(quality.BUCKETS, 1.0), np.full(quality.BUCKETS, 1.0)
    for i, t in docs:
        counts = np.bincount(quality.features(t), minlength=quality.BUCKETS)
        raw += counts
        if i is not None and i < 20 and i % 2:
            target += counts
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    rows = quality.resample(df, labels, 0.4).collect()
    want = sorted(round(float(ratio[quality.features(t)].mean()), 9) if len(quality.features(t)) else 0.0 for _, t in docs)
    assert sorted(round(r.log_ratio, 9) for r in rows) == want
    assert sum(r.selected for r in rows) == round(0.4 * len(docs)) and not any(r.selected for r in rows if r.n_grams == 0)
    keys = sorted((r.key for r in rows if r.n_grams), reverse=True)
    assert {r.key for r in rows if r.selected} == set(keys[: round(0.4 * len(docs))])
    assert quality.resample(df.filter("doc_id = 999"), labels, 0.4).count() == 0
    assert {r.log_ratio for r in quality.resample(df, labels.filter("false"), 0.4).collect()} == {0.0}


def test_ids_beyond_doubles_beside_null(spark):
    big = [2**53 + 1, 2**53 + 3, 2**63 - 1, None]
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(i, f"{text} {'more' * k}") for k, i in enumerate(big)], "doc_id long, text string").coalesce(1)
    near = {r.id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert near == {big[0]: big[0], big[1]: big[0], big[2]: big[0], None: None}
    labels = spark.createDataFrame([(big[0], True)], "id long, good boolean")
    assert {r.id for r in quality.resample(df, labels, 0.5).collect()} == set(big)
    model = langid.fit(df.withColumn("lang", F.lit("x")))
    assert {r.doc_id for r in langid.identify(df, model).collect()} == set(big)


def test_many_unlinked_members_of_one_bucket(spark):
    """Members that share half of their shingles meet in buckets and are not linked; a few pairs among them are."""
    rng = random.Random(8)
    core = [f"c{k}" for k in range(90)]
    rows = [(k, " ".join([*core, *(f"x{rng.randrange(10**9)}" for _ in range(34))])) for k in range(1500)]
    rows += [(10_000 + k, rows[k * 7][1] + " tail") for k in range(20)]
    got = {r.id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, c in got.items() if i != c} == {10_000 + k: k * 7 for k in range(20)}


def test_large_blocks_lose_no_link(spark, monkeypatch):
    """The same members with blocks so small that buckets are cut into many, and into large ones beyond a few."""
    monkeypatch.setattr(minhash, "BLOCK", 20)
    monkeypatch.setattr(minhash, "SPREAD", 3)
    monkeypatch.setattr(minhash, "LARGE_BLOCK", 60)
    parts = spark.range(1).select(*[minhash._parts(F.lit(n)) for n in (10, 40, 60, 180, 600)]).head()
    assert list(parts) == [0.5, 2, 3, 3, 10]
    test_many_unlinked_members_of_one_bucket(spark)


def em_by_hand(logs, grams, rounds):
    """Proportions and log likelihood over all columns of ``logs``, gram by gram."""
    k = len(logs[0])
    share = [1 / k] * k
    like = [[math.exp(x) for x in logs[g]] for g in grams]
    for _ in range(rounds):
        new = [0.0] * k
        for row in like:
            total = sum(s * x for s, x in zip(share, row, strict=True))
            for j in range(k):
                new[j] += share[j] * row[j] / total / len(grams)
        moved = max(abs(a - b) for a, b in zip(new, share, strict=True))
        share = new
        if moved < langid.TOLERANCE:
            break
    return share, sum(math.log(sum(s * x for s, x in zip(share, row, strict=True))) for row in like)


def test_mixtures_against_expectation_maximisation_by_hand():
    """The set of languages is what taking the least one away, as long as the penalised likelihood does not fall, leaves."""
    rng = random.Random(2)
    raw = np.array([[rng.random() ** 3 + 1e-3 for _ in range(4)] for _ in range(40)])
    logs = np.log(raw / raw.sum(axis=0))
    model = langid.Model(["a", "b", "c", "d"], logs)
    seen = set()
    for case in range(30):
        of = rng.sample(range(4), 1 + case % 3)
        grams = np.array([rng.choices(range(40), weights=np.exp(logs[:, rng.choice(of)]))[0] for _ in range(400)])
        cost = 0.5 * math.log(len(grams)) + langid.PENALTY * len(grams)
        chosen = [0, 1, 2, 3]
        share, fit = em_by_hand(logs[:, chosen].tolist(), grams, langid.ROUNDS)
        while len(chosen) > 1:
            least = min(range(len(chosen)), key=lambda j: share[j])
            rest = [c for j, c in enumerate(chosen) if j != least]
            fewer, fit_fewer = em_by_hand(logs[:, rest].tolist(), grams, langid.ROUNDS)
            if fit - fit_fewer >= cost:
                break
            chosen, share, fit = rest, fewer, fit_fewer
        lang, score, shares = model.infer(grams)
        assert set(shares) == {"abcd"[c] for c in chosen}
        assert all(abs(shares["abcd"[c]] - s) < 1e-6 for c, s in zip(chosen, share, strict=True))
        assert lang == "abcd"[chosen[share.index(max(share))]] and abs(score - max(share)) < 1e-6
        seen.add(len(chosen))
    assert seen >= {1, 2}


def test_language_ties_go_to_the_first():
    model = langid.Model(["a", "b"], np.log(np.full((4, 2), 0.25)))
    assert model.infer(np.array([0, 1, 2, 3]))[:2] == ("a", 1.0)


def test_near_duplicates_broadcasts_nothing_before_its_last_join(spark):
    def broadcasts(since):
        runs = spark._jsparkSession.sharedState().statusStore().executionsList()
        runs = [runs.apply(k) for k in range(runs.size())]
        return max(x.executionId() for x in runs), sum("BroadcastExchange" in x.physicalPlanDescription() for x in runs if x.executionId() > since)

    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, *([f"x{i}"] if i % 2 else [])])) for i in range(8)] + [(8, "quite another text of seven words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.count()
    began, _ = broadcasts(-1)
    out = minhash.near_duplicates(docs)
    assert broadcasts(began)[1] == 0
    assert {r["id"]: r["component_id"] for r in out.collect()} == {**dict.fromkeys(range(8), 0), 8: 8}
