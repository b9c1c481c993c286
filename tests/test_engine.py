import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from matchloom.functions import kernels, similarity as sim, text as tx, udfs
from matchloom.operators import blocking as bl, context as cx, decision as de, features as fe, features_full as ff, training as tr
from matchloom.plans import pipeline as pl
from matchloom.sources import shared, tables as tb
from matchloom.streaming import incremental

ENTITY = "entity_id string, row_pos long, business_name string, business_address string, country string"
# Records that belong together in pairs: accents, legal forms, abbreviations, word order.
RECORDS = [
    ("S1-1", 1, "Sri Lakshmi Traders Pvt. Ltd.", "12 M.G. Road, 560001", "India"),
    ("S2-1", 2, "SRI LAKSHMI TRADERS", "12 Mahatma Gandhi Rd 560001", "india "),
    ("S1-2", 3, "Café Délice SARL", "5 Rue de l'Église", "France"),
    ("S3-2", 4, "Cafe Delice", "5 rue de l'eglise", "FRANCE"),
    ("S1-3", 5, None, None, None),
    ("S2-3", 6, "Apple Incorporated", "1 Infinite Loop, Ste 95014", "US"),
]


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame(RECORDS, ENTITY)


def values(spark, column, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in "xyz"[: len(rows[0])]))
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_normal_forms(spark, entities):
    out = {r.entity_id: r for r in entities.select(
        "entity_id", tx.normalize_name(F.col("business_name")).alias("n"), tx.normalize_address(F.col("business_address")).alias("a"), tx.normalize_country(F.col("country")).alias("c")
    ).collect()}
    assert (out["S1-1"].n, out["S1-1"].a) == ("lakshmi", "12 mahatma gandhi road 560001")
    assert out["S2-1"].n == "lakshmi" and out["S2-1"].c == "india"
    assert out["S1-2"].n == "cafe delice" and out["S1-2"].a == "5 rue de l eglise"
    assert (out["S1-3"].n, out["S1-3"].a, out["S1-3"].c) == ("", "", "unknown")
    assert out["S2-3"].n == "apple" and out["S2-3"].a == "1 infinite loop suite 95014"


def test_ascii_fold_follows_unicode(spark):
    chars = [chr(c) for c in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFF01, 0xFF5F), 0x4E2D]]
    want = [unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in chars]
    assert values(spark, tx.ascii_fold(F.col("x")), *[(c,) for c in chars]) == want
    assert values(spark, udfs.ascii_fold_exact("x"), *[(c,) for c in chars]) == want


def test_set_similarities(spark):
    a, b = tx.tokens(F.col("x")), tx.tokens(F.col("y"))
    rows = [("", ""), ("a", ""), ("a b", "b c"), ("a a b", "a b c d")]
    assert values(spark, sim.jaccard(a, b), *rows) == [1.0, 0.0, 1 / 3, 0.5]
    assert values(spark, sim.overlap(a, b), *rows) == [0.0, 0.0, 0.5, 1.0]
    assert values(spark, sim.overlap(a, b, 1.0), *rows)[0] == 1.0
    assert values(spark, sim.dice(a, b), *rows) == pytest.approx([1.0, 0.0, 0.5, 4 / 6])
    assert values(spark, sim.set_cosine(a, b), *rows) == pytest.approx([1.0, 0.0, 0.5, 2 / math.sqrt(8)])
    assert values(spark, sim.common_prefix(F.col("x"), F.col("y")), ("abc", "abd"), ("", "x"), ("a", "a")) == [2, 0, 1]
    assert values(spark, sim.postal_match(sim.postal(F.col("x")), sim.postal(F.col("y"))), ("p 12345", "12345 q"), ("12345", "54321"), ("1", "12345")) == [1.0, 0.0, 0.5]
    assert values(spark, sim.initialism(F.col("x"), F.col("y"), a, b), ("ibm", "intl business machines"), ("x", "xray yankee"), ("ab", "a")) == [1.0, 0.0, 0.0]
    assert values(spark, F.size(tx.grams(F.col("x"), 3)), ("ab",), ("aaaa",), ("abcd",)) == [0, 1, 2]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_kernels():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        assert kernels.subsequence(a, b) == lcs(a, b)
        assert kernels.substring(a, b) == max([j - i for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b] or [0])
        for f in (kernels.indel, kernels.jaro_winkler, kernels.partial, kernels.token_sort):
            assert 0 <= f(a, b) <= 1 and f(a, a) == 1 and f(a, b) == pytest.approx(f(b, a))
    assert kernels.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert kernels.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert kernels.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert [kernels.metaphone(w) for w in ("Knight", "Physics", "Wright", "Shoe", "Thumb", "")] == ["NT", "FSKS", "RT", "X", "0M", ""]


def test_features_have_fixed_shapes(spark, entities):
    s1, other = entities.where("entity_id like 'S1%'"), entities.where("entity_id not like 'S1%'")
    pairs = s1.crossJoin(other.select(F.col("entity_id").alias("o"))).select(F.col("entity_id").alias("s1"), "o")
    assert len(fe.features_21(pairs, s1, other).columns) == 23
    assert len(ff.feature_names()) == 150 and len(set(ff.feature_names())) == 150
    rows = {(r.s1, r.o): r for r in ff.features_150(pairs, s1, other).collect()}
    assert len(rows) == 9 and all(v is not None for r in rows.values() for v in r)
    same = rows["S1-2", "S3-2"]
    assert same.name_first_word_exact == 0 and same.addr_house_num_exact == 1 and same.cand_is_source_3 == 1
    middle = {(r.s1, r.o): r for r in fe.features_56(pairs, s1, other).collect()}
    assert len(middle["S1-1", "S2-1"]) == 58 and middle["S1-1", "S2-1"].name_jaccard == 1 and middle["S1-1", "S2-1"].addr_pincode_match == 1
    native = {(r.s1, r.o): r for r in fe.features_56(pairs, s1, other, native=True).collect()}
    assert all(native[k][c] == middle[k][c] for k in native for c in native[k].asDict())


def test_deterministic_caps(spark):
    other = spark.createDataFrame([(f"S2-{i}", i, "alpha beta gamma", f"{i} long street", "x") for i in range(30)], ENTITY)
    s1 = spark.createDataFrame([("S1-0", 0, "alpha beta gamma", "3 long street", "x"), ("S1-1", 1, "", "", "")], ENTITY)
    assert bl.block_deterministic(s1, other, 150, 5, 80).count() == 5 + 0  # the first five by row order; house 3 is one of them
    assert bl.block_deterministic(s1, other, 10, 5, 80).collect()[0].o == "S2-3"
    stats = bl.candidate_stats(bl.block_deterministic(s1, other), s1).first()
    assert stats.n_entities == 2 and stats.n_empty == 1


def test_sorted_neighbours_match_a_window(spark):
    rng = random.Random(2)
    rows = [(f"S{1 + i % 3}-{i}", i, "".join(rng.choice("ab c") for _ in range(4)), "", rng.choice(["x", None])) for i in range(120)]
    e = spark.createDataFrame(rows, ENTITY)
    got = {(r.s1, r.o) for r in bl.block_sorted_neighbourhood(e.where("entity_id like 'S1%'"), e.where("entity_id not like 'S1%'"), 3).collect()}
    order = [r[0] for r in sorted(rows, key=lambda r: ((r[4] or "") + "|" + r[2].replace(" ", ""), r[0]))]
    want = {(a, b) for i, a in enumerate(order) if a[:2] == "S1" for b in order[max(0, i - 3) : i + 4] if b[:2] != "S1"}
    assert got == want


def test_greedy_equals_the_sequential_loop(spark):
    rng = random.Random(5)
    edges = {(f"S1-{rng.randrange(12)}", f"S{rng.choice([2, 3])}-{rng.randrange(12)}"): rng.randrange(6) / 5 for _ in range(70)}
    used, slots, want = set(), set(), set()
    for (s, o), w in sorted(edges.items(), key=lambda x: (-x[1], x[0])):
        if w >= 0.2 and o not in used and (s, o[:2]) not in slots:
            used.add(o), slots.add((s, o[:2])), want.add((s, o))
    df = spark.createDataFrame([(s, o, w) for (s, o), w in edges.items()], "s1 string, o string, score double")
    assert {(r.s1, r.o) for r in de.greedy(df, 0.2).collect()} == want
    two = de.two_step(df, 0.2).collect()
    assert len({r.o for r in two}) == len(two) == len({(r.s1, r.o[:2]) for r in two})


def test_metrics(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "s1 string, o string")
    spine = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    truth = pairs(("a", "x"), ("a", "y"), ("b", "z"))
    got = de.f05_macro(pairs(("a", "x"), ("b", "w")), truth, spine).first()
    assert got.f05 == pytest.approx((1.25 * 0.5 / 0.75 + 0 + 1) / 3, abs=1e-6) and got.recall == pytest.approx(0.5)
    recall = {r.scope: r.recall for r in de.blocking_recall(pairs(("a", "x")), truth).collect()}
    assert recall["all"] == pytest.approx(1 / 3, abs=1e-6)
    scores = spark.createDataFrame([("a", "x", 0.9), ("b", "w", 0.4)], "s1 string, o string, score double")
    sweep = {r.threshold: r.f05 for r in de.threshold_sweep(scores, truth, spine, [0.3, 0.5, 0.95]).collect()}
    assert sweep[0.5] == pytest.approx((1.25 * 0.5 / 0.75 + 0 + 1) / 3, abs=1e-6) and sweep[0.95] == pytest.approx(1 / 3, abs=1e-6)
    assert de.best_threshold(de.threshold_sweep(scores, truth, spine, [0.3, 0.5]))[0] == 0.3


def test_exports_and_truth(spark, tmp_path, entities):
    s1 = entities.where("entity_id like 'S1%'")
    pairs = spark.createDataFrame([("S1-1", "S2-3"), ("S1-1", "S2-1"), ("S1-1", "S2-1")], "s1 string, o string")
    out = tb.export_matches(pairs, s1)
    tb.write_tsv(out, str(tmp_path / "m"))
    back = tb.read_tsv(spark, str(tmp_path / "m"), tb.TRUTH)
    assert {(r[0], r[1] or "") for r in back.collect()} == {("S1-1", "S2-1,S2-3"), ("S1-2", ""), ("S1-3", "")}
    assert {tuple(r) for r in tb.parse_truth(back).collect()} == {("S1-1", "S2-1"), ("S1-1", "S2-3")}
    assert tuple(tb.check_export(out, s1, entities, "matched_entity_ids").first()) == (0, 0, 0)


def test_samples_do_not_depend_on_partitions(spark):
    ids = spark.range(500).select(F.concat(F.lit("S1-"), F.col("id").cast("string")).alias("entity_id"))
    one = {r[0] for r in tr.sample_exact(ids.repartition(1), 40, 3, "entity_id").collect()}
    assert one == {r[0] for r in tr.sample_exact(ids.repartition(7), 40, 3, "entity_id").collect()} and len(one) == 40
    train, val = tr.split_val(ids, 0.2)
    assert train.count() + val.count() == 500 and train.intersect(val).isEmpty()
    parts = [tb.shard_rows(ids, "entity_id", k, 3).count() for k in (1, 2, 3)]
    assert parts == [166, 166, 168]


def test_stream_matches_batches(spark, tmp_path, entities):
    s1, other = entities.where("entity_id like 'S1%'"), entities.where("entity_id not like 'S1%'")
    s1.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(entities.schema).parquet(str(tmp_path / "in"))
    incremental.match_batches(stream, other, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.s1, r.o) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.s1, r.o) for r in bl.block_deterministic(s1, other).collect()} and ("S1-1", "S2-1") in got


def test_training_run(spark):
    rng = random.Random(8)
    name = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3))
    rows, truth = [], []
    for i in range(60):
        n, a = name(), f"{rng.randrange(90)} {name()} {10000 + i}"
        rows.append((f"S1-{i}", i, n, a, "x"))
        if i % 3:
            rows.append((f"S2-{i}", 1000 + i, n.replace("a", "b", 1), a, "x"))
            truth.append((f"S1-{i}", f"S2-{i}"))
    e = spark.createDataFrame(rows, ENTITY)
    s1, other = e.where("entity_id like 'S1%'"), e.where("entity_id like 'S2%'")
    config = pl.Config(val_share=0.3, skip_tfidf=True, trees=3, window=2)
    model, names, threshold, f05 = pl.train_and_tune(s1, other, spark.createDataFrame(truth, "s1 string, o string"), config)
    assert f05 > 0.8 and len(tr.importances(model, names)) == len(names)
    matched = pl.match(model, threshold, s1, other, config)
    assert matched.count() == 60
    assert cx.context_columns(cx.candidate_scores(pl.block_one_source(s1, other, config), s1, other)).where("rank = 0").count() <= 60


def test_super_hard_negatives_look_at_the_whole_country(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("abcde") for _ in range(9)) for _ in range(60)]
    s1 = spark.createDataFrame([(f"S1-{i}", i, n, "", "xy"[i % 2]) for i, n in enumerate(names[:12])], ENTITY)
    other = spark.createDataFrame([(f"S2-{i}", i, n, "", "xy"[i % 2]) for i, n in enumerate(names[12:])], ENTITY)
    truth = spark.createDataFrame([("S1-0", "S2-0"), ("S1-0", "S2-2"), ("S1-3", "S2-1")], "s1 string, o string")
    known = {(r.s1, r.o) for r in truth.collect()}
    want = {}
    for i, x in enumerate(names[:12]):
        near = [(round(kernels.jaro_winkler(x, y), 6), f"S2-{j}") for j, y in enumerate(names[12:]) if i % 2 == j % 2]
        near = sorted((v for v in near if v[0] >= 0.6 and (f"S1-{i}", v[1]) not in known), reverse=True)[:6]
        want |= {(f"S1-{i}", o): v for v, o in near}
    for extra in ({}, {"block": 5}):
        got = tr.super_hard_negatives(s1, other, truth, pool=6, n=6, **extra)
        assert {(r.s1, r.o): r.name_sim for r in got.collect()} == want


def test_partial_ratio_matches_brute_force():
    rng = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randrange(9))) for _ in range(2))
        pairs = [(a, b), (b, a)] if len(a) == len(b) else [(min(a, b, key=len), max(a, b, key=len))]
        best = 0.0
        for x, y in pairs:
            n = len(x)
            windows = {y[i : i + n] for i in range(len(y) - n + 1)} | {y[:i] for i in range(1, n)} | {y[-i:] for i in range(1, n)}
            best = max([best, *(kernels.indel(x, w) for w in windows)] if x else [best, float(not y)])
        assert kernels.partial(a, b) == best, (a, b)


def test_scores_and_maps_take_defaults(spark):
    pairs = spark.createDataFrame([("a", "x"), ("a", "y")], "s1 string, o string")
    scores = spark.createDataFrame([("a", "x", 0.7), ("b", "x", 0.1)], "s1 string, o string, score double")
    assert sorted(r.score for r in de.with_default(pairs, scores, 0.2).collect()) == [0.2, 0.7]
    one = spark.createDataFrame([("k",), ("z",), (None,)], "v string")
    assert [r[0] for r in one.select(de.replaced(one["v"], {"k": 3}, 0)).collect()] == [3, 0, 0]


def test_numbers_in_words():
    words = {0: "zero", 21: "twenty-one", 100: "one hundred", 342: "three hundred and forty-two", 1001: "one thousand and one"}
    words |= {1100: "one thousand, one hundred", 123_456: "one hundred and twenty-three thousand, four hundred and fifty-six", 10**6 + 7: "one million and seven"}
    assert {n: kernels.number_words(n) for n in words} == words
    assert kernels.spelled_numbers("a 12 b3 7") == "a twelve b3 seven" and kernels.spelled_numbers("9" * 40) == "9" * 40


def test_product_texts(spark):
    rows = ["Item Name: A \U0001f600B\nBullet Point 1: Red\nBullet Point 2: Big\nValue: 12\nUnits: Oz", "Product Description: One\ntwo\nValue: 3", "", None]
    one = [(x,) for x in rows]
    assert values(spark, tx.product_text(F.col("x")), *one) == ["Units: oz\nValue: 12\nItem Name: a b", "Units: \nValue: 3\nItem Name: ", "Units: \nValue: \nItem Name: ", ""]
    blank = "Item Name: \nValue: \nUnits: "
    assert values(spark, tx.product_text_described(F.col("x")), *one) == [
        "Item Name: a b\nValue: 12\nUnits: oz\nBullet Points 1: red\nBullet Points 2: big", "Item Name: \nValue: 3\nUnits: \nDescription: one\ntwo", blank, blank,
    ]
    assert values(spark, tx.product_text_described(F.col("x"), udfs.spelled_numbers), *one)[0] == "Item Name: a b\nValue: twelve\nUnits: oz"


def test_vector_cells(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, 16))[rng.integers(6, size=600)] + rng.normal(size=(600, 16)) * 0.3
    x[200:400] = x[3]  # a common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries, centres = v.where("vec_id % 20 = 0"), bl.vector_cells(v, 6)
    exact = {tuple(r) for r in bl.block_vector(queries.where("embedding is not null"), v.where("embedding is not null"), 10).collect()}
    assert {tuple(r) for r in bl.block_vector_cells(queries, v, centres, 10, 6, block=50).collect()} == exact
    found = {tuple(r) for r in bl.block_vector_cells(queries, v, centres, 10, 2, block=50).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_sinks_and_paths(spark, tmp_path, entities):
    tb.write_parameters(spark, {"threshold": 0.55}, str(tmp_path / "p"))
    assert tb.read_parameters(spark, str(tmp_path / "p")) == {"threshold": 0.55}
    assert shared.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "p")]) == str(tmp_path / "p")
    with pytest.raises(FileNotFoundError):
        shared.first_existing(spark, [str(tmp_path / "none")])
    s1, other = entities.where("entity_id like 'S1%'"), entities.where("entity_id not like 'S1%'")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S3-2")], "s1 string, o string")
    report = pl.timed_report(s1, other, truth, pl.Config(skip_tfidf=True), path=str(tmp_path / "r"))
    assert [r.method for r in report.collect()] == ["deterministic", "sorted_neighbourhood", "final_union"]
    back = tb.read_csv(spark, str(tmp_path / "r"), report.schema)
    assert back.columns == report.columns and back.where("time_sec >= 0 and recall = 1 and method = 'final_union'").count() == 1
    rows = spark.createDataFrame([(i % 7 / 7, i % 2) for i in range(200)], "x double, label int")
    model = tr.train_boosted(rows, ["x"], trees=2, depth=2)
    tr.save_model(model, str(tmp_path / "m"))
    one, two = (tr.predict_proba(m, rows).agg(F.sum("score")).first()[0] for m in (model, tr.load_model(str(tmp_path / "m"))))
    assert one == two


def test_slices_and_sql_functions(spark):
    rows = spark.range(100).select((F.col("id") * 37 % 101).alias("k"))
    order = sorted(i * 37 % 101 for i in range(100))
    assert sorted(r.k for r in tb.slice_rows(rows, [F.col("k")], 10, 25).collect()) == order[10:35]
    assert tb.slice_rows(rows.limit(0), [F.col("k")], 0, 5).count() == 0
    udfs.register(spark)
    assert spark.sql("SELECT round(jaro_winkler('martha', 'marhta'), 4), metaphone('smith'), spelled_numbers('7')").first()[0] == 0.9611
    scores = spark.createDataFrame([("a", "x", 0.9, 1), ("a", "y", 0.8, 0), ("b", "y", 0.2, 0)], "s1 string, o string, score double, label int")
    t = de.fit_temperature(scores)
    after = [r.score for r in de.calibrate(scores, t).orderBy("o", "s1").collect()]
    assert t > 0 and all(0 < p < 1 for p in after) and de.calibrate(scores, 1.0).where("abs(score - 0.9) < 1e-9").count() == 1


def test_models_without_rows(spark):
    rows = spark.createDataFrame([("a", "x", 1, 1.0), ("a", "y", 0, 0.0)], "s1 string, o string, label int, m double")
    for train in (tr.train_boosted, tr.train_stacker):
        model = train(rows.limit(0), ["m"])
        assert [r.score for r in tr.predict_proba(model, rows).collect()] == [0.5, 0.5]
        assert tr.predict_proba(model, rows.limit(0)).count() == 0
    # All pairs are in one fold, so the model of that fold has none to learn from.
    out = tr.out_of_fold(tr.group_folds(rows, 3), ["m"], 3, trees=2, depth=2).collect()
    assert sorted((r.s1, r.o, r.score) for r in out) == [("a", "x", 0.5), ("a", "y", 0.5)]
    assert tr.out_of_fold(tr.group_folds(rows.limit(0), 3), ["m"], 3, trees=2, depth=2).count() == 0


def _brute_vectors(rows, queries, k):
    def product(x, y):
        if x is None or y is None or len(x) != len(y) or None in x or None in y:
            return None
        total = 0.0
        for a, b in zip(x, y, strict=True):
            total += a * b
        return total if math.isnan(total) else round(total, 6) + 0.0

    out = set()
    for i in queries:
        mine = [(j, product(rows[i], y)) for j, y in rows.items() if j != i]
        mine.sort(key=lambda p: (p[1] is None, 0 if p[1] is None else -math.inf if math.isnan(p[1]) else -p[1], p[0]))
        out |= {(i, j, str(s)) for j, s in mine[:k]}
    return out


def test_block_vector_in_blocks_of_odd_rows(spark, capsys):
    draw = random.Random(3)
    rows = {i: [draw.choice([-1.0, 0.5, 0.25, draw.random()]) for _ in range(8)] for i in range(150)}
    rows |= {i: rows[3] for i in range(150, 220)}  # copies of one vector
    rows |= {300: None, 305: [1.0, None, *[0.0] * 6], 310: [1.0] * 3, 315: [0.5] * 3, 320: [math.nan] * 8, 325: [], 330: [0.0] * 8}
    v = spark.createDataFrame([*rows.items()], "vec_id long, embedding array<double>")
    for k, block in ((5, 40), (5, 10_000), (230, 60)):
        found = bl.block_vector(v.where("vec_id % 5 = 0"), v, k, block)
        assert {(r.s1, r.o, str(r.sim)) for r in found.collect()} == _brute_vectors(rows, [i for i in rows if i % 5 == 0], k)
    found.explain()
    assert "Join" not in capsys.readouterr().out  # pairs are not rows


def test_vector_cells_in_blocks(spark, capsys):
    draw = random.Random(4)
    rows = {i: [draw.random() for _ in range(8)] for i in range(200)} | {i: [0.5] * 8 for i in range(200, 300)}
    v = spark.createDataFrame([*rows.items(), (900, None)], "vec_id long, embedding array<double>")
    found = bl.block_vector_cells(v.where("vec_id % 5 = 0"), v, bl.vector_cells(v, 4), 7, 4, block=20)
    assert {(r.s1, r.o, str(r.sim)) for r in found.collect()} == _brute_vectors(rows, range(0, 300, 5), 7)
    found.explain()
    assert "FlatMapCoGroupsInArrow" in capsys.readouterr().out


def test_tfidf_in_blocks(spark, capsys):
    draw = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "kilo", "lima", "x", "alphabet", "deltas", "be", "gam", "limabeta"]
    text = lambda: " ".join(draw.choice(words) for _ in range(draw.randint(0, 4)))
    texts = [text() for _ in range(40)] + ["alpha beta"] * 25
    rows = [(f"S{1 + i % 3}-{i}", i, draw.choice(texts), "", "x") for i in range(400)] + [("S1-900", 900, "", "", "x"), ("S2-901", 901, None, "", "x")]
    e = spark.createDataFrame(rows, ENTITY)
    s1, other = e.where("entity_id like 'S1%'"), e.where("entity_id not like 'S1%'")
    side = lambda d: bl.gram_counts(d.select(F.col("entity_id").alias("id"), F.coalesce("business_name", F.lit("")).alias("text")))
    for k, floor, block in ((5, 0.12, 7), (150, 0.12, 10_000), (4, 0.99, 9), (60, 0.5, 9)):
        vocab = bl.vocabulary(side(other), other.count(), 3, 0.9)
        want = bl.cosine_top_k(bl.weights(side(s1), vocab), bl.weights(side(other), vocab), k, floor)
        want = {tuple(r) for r in want.collect()}
        found = bl.block_tfidf(s1, other, F.coalesce("business_name", F.lit("")), k, floor, max_df=0.9, ask_block=block, there_block=block)
        assert {tuple(r) for r in found.collect()} == want and want
    found.explain()
    plan = capsys.readouterr().out
    assert "FlatMapCoGroupsInArrow" in plan and "gram" not in plan.partition("FlatMapCoGroupsInArrow")[0]  # no join on grams
