"""Registered queries against their SQL, statistics against golden values, and edge cases."""

import gzip
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import connect, difference
from passagemill.functions import outputs, student
from passagemill.functions import text as tx
from passagemill.functions import vectors as vx
from passagemill.operators import agreement as ag
from passagemill.operators import comparison as cp
from passagemill.operators import effectiveness as ef
from passagemill.operators import history, pruning, ranking, retrieval, scaling, scorers
from passagemill.operators import reports as rp
from passagemill.plans import registry
from passagemill.sources import corpus as src
from passagemill.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_queries_match_sql(spark):
    con = connect(SF)
    bad = {n: r for n, sql in registry.ORACLE_SQL.items() if (r := difference(con, sql, registry.QUERIES[n](spark, SF)))}
    assert not bad


def test_student_t():
    assert student.t_upper_tail(0, 5) == pytest.approx(0.5)
    assert student.t_upper_tail(2.015048372669157, 5) == pytest.approx(0.05, rel=1e-9)
    assert student.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert student.t_upper_tail(math.inf, 3) == 0


def test_noninferiority_edges(spark):
    rows = [("same", 0.5, 0.5), ("same", 0.4, 0.4), ("bad", 0.5, 0.3), ("bad", 0.5, 0.31), ("one", 0.1, 0.1)]
    got = {r["s"]: r for r in cp.noninferiority(spark.createDataFrame(rows, "s string, value_full double, value_pruned double"), ["s"]).collect()}
    assert set(got) == {"same", "bad"} and got["same"]["passes"] and not got["bad"]["passes"] and got["same"]["p_noninferiority"] == 0


#: Published results of the test, n, mean, mean difference, interval, t, p.
PUBLISHED = [
    (97, 0.7986786123384061, 0.0072614956635575, -0.0485831587023937, 0.0631061500295087, 1.6775496563890568, 0.0483440579338818),
    (97, 0.9354933726067748, 0.0056128293241695, -0.028200312094712, 0.039425970743051, 3.075383037377125, 0.001369174174751),
    (6980, 0.3472977213808159, -0.0072142629735752, -0.0100451071625196, -0.0043834187846309, 7.029106974264288, 1.137779813889855e-12),
    (97, 0.697936757957595, -0.0228450426295011, -0.0355752424557815, -0.0101148428032208, 1.879202593829597, 0.0316251269796488),
    (97, 0.7986786123384061, 0.0045000818196694, -0.0476338841165077, 0.0566340477558466, 1.691811010368574, 0.046962852406352),
]


def test_published_noninferiority():
    for n, mean, diff, low, high, t, p in PUBLISHED:
        error = (diff + 0.05 * mean) / t
        half = student.t_quantile(0.975, n - 1) * error
        assert (diff - half, diff + half) == pytest.approx((low, high), rel=1e-6)
        assert student.t_upper_tail(t, n - 1) == pytest.approx(p, rel=1e-6)


def test_published_noninferiority_from_pairs(spark):
    """Pairs with just the published means and deviations, through the operator."""
    rows = []
    for i, (n, mean, diff, _, _, t, _) in enumerate(PUBLISHED):
        sd = (diff + 0.05 * mean) / t * math.sqrt(n)
        z = np.arange(n) - (n - 1) / 2
        z = z / z.std(ddof=1)
        rows += [(i, mean, float(mean + diff + sd * v)) for v in z]
    got = {r["s"]: r for r in cp.noninferiority(spark.createDataFrame(rows, "s int, value_full double, value_pruned double"), ["s"]).collect()}
    for i, (n, mean, diff, low, high, t, p) in enumerate(PUBLISHED):
        r = got[i]
        assert r["n_queries"] == n and r["passes"] == (p < 0.05) and r["margin_respected_by_ci"] == (low > -0.05 * mean)
        assert [r[c] for c in ("mean_full", "mean_diff", "ci95_low", "ci95_high", "t_noninferiority", "p_noninferiority")] == pytest.approx([mean, diff, low, high, t, p], rel=1e-6)


def test_ranks_with_nulls_and_many_ties(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS", 1000)
    n = 100_000
    rows = spark.range(n).select(F.format_string("passage-%012d", "id").alias("docno"), F.when(F.col("id") % 10 < 7, 0.5).when(F.col("id") % 1000 != 999, F.rand(3)).alias("quality"))
    rows = pruning.written(rows)
    sizes = [r["count"] for r in ranking.ranged(rows, [F.col("quality").asc_nulls_last(), F.col("docno")]).groupBy("_range").count().collect()]
    assert len(sizes) > 90 and max(sizes) <= 2 * ranking.ROWS  # the ties are cut, too
    got = ranking.global_rank(rows, "quality", "docno").toPandas()
    want = rows.toPandas().sort_values(["quality", "docno"], na_position="last").reset_index(drop=True)
    assert dict(zip(got["docno"], got["rank"], strict=True)) == {d: i + 1 for i, d in enumerate(want["docno"])}
    down = ranking.global_rank(rows, "quality", "docno", ascending=False).toPandas()
    want = rows.toPandas().sort_values(["quality", "docno"], ascending=[False, True], na_position="last").reset_index(drop=True)
    assert dict(zip(down["docno"], down["rank"], strict=True)) == {d: i + 1 for i, d in enumerate(want["docno"])}
    for q in (0.0, 0.3, 0.5, 0.97, 1.0):
        assert ranking.quantile(rows, "quality", q, "t").first()["t"] == pytest.approx(want["quality"].quantile(q), rel=1e-12)


def test_ranks_of_small_tables(spark):
    rows = spark.createDataFrame([("a", None), ("b", 2.0), ("c", 1.0)], "docno string, quality double")
    assert {r["docno"]: r["rank"] for r in ranking.global_rank(rows, "quality", "docno").collect()} == {"c": 1, "b": 2, "a": 3}
    assert ranking.global_rank(rows.limit(0), "quality", "docno").count() == 0
    assert ranking.quantile(rows.limit(0), "quality", 0.5, "t").first()["t"] is None


def test_repeated_docnos_are_scored_row_by_row(spark):
    docs = spark.createDataFrame([("a", "x y"), ("a", "z z z")], "docno string, text string")
    assert sorted(r["length_tokens"] for r in scorers.lexical_features(docs).collect()) == [2, 3]
    assert sorted(r["quality"] for r in scorers.itn(docs).collect()) == pytest.approx([1 / 3, 1])
    assert scorers.cdd(docs).count() == 2 == scorers.cdd(docs, stemmed=True).count()


def test_close_flags_take_repeated_rows_apart(spark):
    rows = spark.createDataFrame([("s", 0.3), ("s", 0.3), ("s", 0.5), ("t", 0.3)], "scorer string, threshold double")
    flags = spark.createDataFrame([("s", 0.3 + 1e-10, True)], "scorer string, threshold double, equivalent boolean")
    got = sorted((r["scorer"], r["threshold"], r["equivalent"]) for r in cp.with_close_flags(rows, flags, ["scorer"]).collect())
    assert [x[2] for x in got] == [True, True, None, None]


def test_targeted_validation_and_bounded_scan(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 0)], "docno string, target int")
    assert src.validate_targeted(rows, rows).first()["positives"] == 1
    for bad in (rows.where("target = 1"), rows.union(rows.limit(1)), rows.withColumn("target", F.lit(2))):
        with pytest.raises(Exception, match="target|differ"):
            src.validate_targeted(bad, rows).collect()
    assert [r["docno"] for r in src.window_of(rows, ["docno"], 1, 5).collect()] == ["b"]


def test_boolean_words(spark):
    r = spark.range(1).select(*(tx.parse_boolean(F.lit(x)).alias(f"c{i}") for i, x in enumerate(("Sì", "", "nan", "None", "perhaps")))).first()
    assert tuple(r) == (True, False, False, False, None)


def test_lexical_edges(spark):
    docs = spark.createDataFrame([("d0", ""), ("d1", "a a a a"), ("d2", "a b c d"), ("d3", "été naïve"), ("d4", None)], "docno string, text string")
    x = {r["docno"]: r for r in scorers.lexical_features(docs).collect()}
    assert x["d0"]["length_tokens"] == 0 == x["d4"]["lexical_entropy"]
    assert x["d1"]["unique_token_ratio"] == 0.25 and x["d1"]["repetition_ratio"] == 0.75 and x["d1"]["lexical_entropy"] == 0
    assert x["d2"]["lexical_entropy"] == pytest.approx(2) and x["d3"]["length_tokens"] == 2
    assert {r["docno"]: r["quality"] for r in scorers.cdd(docs).collect()}["d0"] == scorers.NO_TERMS


def test_cut_has_exact_size_and_ties_by_docno(spark):
    scored = spark.createDataFrame([(f"d{i}", 0.5 if i < 6 else 1.0) for i in range(10)], "docno string, quality double")
    kept = {r["docno"] for r in pruning.prune_fraction(scored, 0.3).collect()}
    assert kept == {f"d{i}" for i in range(3, 10)}
    assert pruning.prune_fraction(scored, 0.25).count() == 8 and pruning.prune_fraction(scored, 1.0).count() == 0
    ranks = [r["rank"] for r in ranking.global_rank(scored, "quality", "docno").orderBy("quality", "docno").collect()]
    assert ranks == list(range(1, 11))


def test_auc_counts_ties_half_and_one_label_is_null(spark):
    rows = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "quality double, label int")
    assert pruning.auc(rows).first()["auc"] == pytest.approx(0.875)
    assert pruning.auc(rows.where("label = 1")).first()["auc"] is None


def test_safety_and_front(spark):
    rows = spark.createDataFrame([("s", 15.0, 1.0), ("s", 30.0, 0.5), ("s", 45.0, 1.0), ("s", 45.0, 1.0)], "scorer string, pruning_percent double, value double")
    safe = cp.safe_pruning(rows, ["scorer"], F.col("value") >= 0.9).first()
    assert (safe["max_any"], safe["max_contiguous"]) == (45.0, 15.0)
    assert cp.pareto_front(rows, ["scorer"]).count() == 2


def test_scaler_and_history(spark):
    x = spark.createDataFrame([("a", 3.0), ("b", 3.0)], "docno string, f double")
    s = scaling.fit(x, {"f": "zscore"})
    assert s.first()["std"] == 1 and {r["f"] for r in scaling.apply(x, s, {"f": "zscore"}).collect()} == {0.0}
    runs = spark.createDataFrame([("r", i, v, t, 1 - v) for i, (v, t) in enumerate([(1.0, 1.0), (0.8, 0.8), (0.9, 0.7), (1.1, 0.6)])], "run string, step long, validation_loss double, training_loss double, metric double")
    seen = history.streaks(history.trajectory(runs)).orderBy("step").collect()
    assert [r["streak"] for r in seen] == [0, 0, 1, 2] and history.best_step(runs).first()["best_step"] == 1


def test_text_functions(spark):
    assert [tx.porter_stem(w) for w in ("caresses", "ponies", "relational", "hopping", "happy", "generalization")] == ["caress", "poni", "relat", "hop", "happi", "gener"]
    r = spark.range(1).select(tx.clean_query(F.lit("a (b) c-d?")).alias("q"), tx.parse_boolean(F.lit(" Si ")).alias("t"), tx.parse_boolean(F.lit("maybe")).alias("m")).first()
    assert (r["q"], r["t"], r["m"]) == ("a b c d", True, None)


def test_sources(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\ta\textra\nbroken\n")
    rows = src.collection_tsv(spark, str(tmp_path / "c.tsv")).collect()
    assert [r["malformed"] for r in rows] == [False, True]
    name = spark.range(1).select(*src.run_keys(F.lit("compare_all_x_dev.small_0.3_perquery_wide.csv"))).first()
    assert (name["experiment"], name["qrels_variant"], name["threshold"]) == ("x", "dev.small", 0.3)
    name = spark.range(1).select(*src.run_keys(F.lit("compare_all_x_dev_small_0.3.csv"))).first()
    assert name["qrels_variant"] == "dev.small"
    with pytest.raises(Exception, match="not a result file's name"):
        spark.createDataFrame([("other.csv",)], "n string").select(*src.run_keys(F.col("n"))).collect()
    cache = str(tmp_path / "cache")
    scored = spark.createDataFrame([("a", 1.0)], "docno string, quality double")
    src.write_quality(scored, cache, "itn")
    src.write_quality(scored, cache, "cdd")
    assert src.read_quality(spark, cache, "itn").count() == 1
    with pytest.raises(ValueError):
        src.resolve(scored, "text")


def test_model_adapter(spark):
    docs = spark.createDataFrame([("a", "xx"), ("b", "yyyy")], "docno string, text string")
    got = {r["docno"]: r["quality"] for r in scorers.model_scorer(lambda texts: [float(len(t)) for t in texts], batch=1)(docs).collect()}
    assert got["b"] - got["a"] == 2


def one(df):
    return tuple(df.first())


def test_scalar_functions(spark):
    x = spark.range(1)
    assert one(x.select(tx.safe_file_name(F.lit(" a/b c.x ")), tx.config_id(F.lit("s"), F.lit("m"), threshold=F.lit(0.3)), tx.system_family(F.lit("BM25 Full"))["family"])) == ("a_b_c.x", "s | m | thr=0.3", "BM25")
    a, b, c = one(x.select(vx.log_prob_true(F.lit(0.0), F.lit(0.0)), vx.log_prob_true(F.lit(-1000.0), F.lit(0.0)), vx.log_prob_true(F.lit(1000.0), F.lit(0.0))))
    assert a == pytest.approx(math.log(0.5)) and b == -1000 and c == 0
    assert one(x.select(scorers.oriented(F.lit(2.0), False), scorers.oriented(F.lit(2.0), True))) == (-2.0, 2.0)
    states = F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(5.0), F.lit(7.0)))
    masked = lambda *m: vx.pooled(states, F.array(*map(F.lit, m)))
    assert one(x.select(vx.pooled(states), masked(0, 1), masked(0, 0), masked(1))) == ([3.0, 5.0], [5.0, 7.0], [0.0, 0.0], [1.0, 3.0])


def test_model_outputs():
    half = math.log(0.5)
    pair, words = np.array([[0.0, 0.0], [1000.0, 0.0]]), np.zeros((2, 3, 5))
    for output in ({"pair_logits": pair}, (pair,), {"logits": pair}, {"logits_true": pair[:, 0], "logits_false": pair[:, 1]}):
        assert outputs.log_prob_true(output, 1, 4) == pytest.approx([half, 0.0])
    assert outputs.log_prob_true({"decoder_logits": words}, 1, 4) == pytest.approx([half, half])
    assert outputs.log_prob_true({"score": [[-1.0], [-2.0]]}, 1, 4).tolist() == [-1.0, -2.0] == outputs.log_prob_true(np.array([-1.0, -2.0]), 1, 4).tolist()
    for bad in ({"x": 1}, {"logits": np.zeros((2, 3))}, "text"):
        with pytest.raises(ValueError):
            outputs.log_prob_true(bad, 1, 4)


def test_model_adapter_with_features(spark):
    docs = spark.createDataFrame([("a", "x", 2.0, 1.0), ("b", "y", 3.0, None)], "docno string, text string, f double, g double")
    got = {r["docno"]: r["quality"] for r in scorers.model_scorer(lambda texts, x: np.nan_to_num(x).sum(axis=1).tolist(), 1, features=("f", "g"))(docs).collect()}
    assert got == {"a": 3.0, "b": 3.0}


def test_pairs_without_scores_and_empty(spark):
    pairs = spark.createDataFrame([("q", "a", "b"), ("q", "a", "c"), ("q", "b", None), ("q", "zz", "a")], "qid string, pos_pid string, neg_pid string")
    s = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", float("nan"))], "docno string, quality double")
    t = s.withColumn("quality", -F.col("quality"))
    x = ag.pair_scores(pairs, {"s": s, "t": t})
    got = {r["scorer"]: r for r in ag.pairwise_summary(x, ["s", "t"]).collect()}
    assert (got["s"]["valid_pairs"], got["s"]["invalid_pairs"], got["s"]["pairwise_accuracy"], got["t"]["pairwise_accuracy"]) == (1, 3, 1.0, 0.0)
    assert sorted((r["s_margin_minus_t"] for r in ag.with_differences(x, ["s", "t"], "t").collect()), key=lambda v: (v is None, v)) == [1.0, None, None, None]
    assert ag.pairwise_agreement(x, "s", "t").first()["pairwise_agreement"] == 0.0
    empty = ag.pairwise_summary(x.limit(0), ["s"]).first()
    assert (empty["valid_pairs"], empty["pairwise_accuracy"]) == (0, None)


def test_reproduction_verdicts(spark):
    a = spark.range(200).select(F.format_string("d%03d", "id").alias("docno"), F.col("id").cast("double").alias("quality"))
    verdict = lambda x, y: ag.reproduction(x, y).first()["verdict"]
    assert verdict(a, a) == "same" and verdict(a, a.where("quality < 150")) == "length"
    assert verdict(a, a.withColumn("docno", F.concat("docno", F.lit("x")))) == "length"
    assert verdict(a, a.withColumn("quality", F.lit(1.0))) == "none" and verdict(a, a.withColumn("quality", -F.col("quality"))) == "different"
    assert verdict(a, a.withColumn("quality", F.col("quality") + 40 * (F.col("quality") % 2))) == "close"
    assert ag.reproduction(a, a.withColumn("quality", F.lit(float("inf")))).first()["official_finite"] == 0


def test_variants_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("fam", "A_dev_small"), ("fam", "AB_test-2019"), ("fam", "test-2019"), ("x", "A_y"), ("fam", None)], "scorer string, qrels_variant string")
    got = [tuple(r) for r in rp.split_variants(rows, "fam", {"A": "fam_a", "AB": "fam_ab"}).collect()]
    assert got == [("fam_a", "dev.small"), ("fam_ab", "test-2019"), ("fam", "test-2019"), ("x", "A_y"), ("fam", None)]
    files = spark.createDataFrame([("msm_itn.cache",), ("other.cache",)], "file_name string")
    table = spark.createDataFrame([(1, "itn", "Information to noise", ["ITN"], ["{dataset_name}_itn.cache"], "lexical", True, True), (2, "cdd", None, [], ["{dataset_name}_itn.cache"], "lexical", True, True)], rp.SCORER_TABLE)
    assert {r["file_name"]: r["scorer"] for r in rp.scorer_of_cache(files, table, "msm").collect()} == {"msm_itn.cache": "itn", "other.cache": None}
    x = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), (None, 3), ("a", None)], "k string, n int")
    assert [tuple(r) for r in rp.sorted_report(x, ["k", "-n"]).collect()] == [("a", 2), ("a", 1), ("a", None), ("b", 1), (None, 3)]
    assert sorted(r["json"] for r in rp.as_json(x.where("k = 'b' or n is null")).collect()) == ['{"k":"a","n":null}', '{"k":"b","n":1}']
    for kind in ("csv", "tsv", "json", "parquet", "orc"):
        path = str(tmp_path / f"r.{kind}")
        rp.write_report(x, path, kind)
        assert src.table(spark, path).count() == 5
        with pytest.raises(Exception, match="(?i)exists"):
            rp.write_report(x, path, kind)
        rp.write_report(x.limit(1), path, kind, force=True)
        assert src.table(spark, path).count() == 1
    rp.write_bundle({"roc": x, "scaler": x.limit(2)}, str(tmp_path / "bundle"))
    assert {n: t.count() for n, t in rp.read_bundle(spark, str(tmp_path / "bundle"), ["roc", "scaler"]).items()} == {"roc": 5, "scaler": 2}
    config = {"levels": [0.15, 0.3], "name": "è\n", "none": None}
    rp.write_config(spark, config, str(tmp_path / "c.yaml"))
    assert rp.read_config(spark, str(tmp_path / "c.yaml")) == config
    name = spark.range(1).select(rp.result_file(F.lit("x_y"), F.lit("test-2019_test-2020"), F.lit(0.6), "perquery_wide").alias("n"), rp.run_folder("/runs/", F.lit("BM25 Full"), F.lit("a/b")).alias("f"))
    assert one(name) == ("compare_all_x_y_test-2019_test-2020_0.6_perquery_wide.csv", "/runs/BM25_Full/a_b")
    assert one(name.select(*src.run_keys(F.col("n")))) == ("x_y", "test-2019_test-2020", 0.6)


def test_result_files_and_flags(spark, tmp_path):
    for name, value in (("compare_all_x_dev.small_0.3.csv", 1), ("compare_all_x_dev.small_0.3_perquery_wide.csv", 2), ("compare_all_y_test-2019_0.45.csv", 3)):
        (tmp_path / name).write_text(f"scorer,value\ns,{value}\n")
    got = src.results_csv(spark, str(tmp_path / "*.csv"))
    assert sorted((r["experiment"], r["qrels_variant"], r["threshold"], r["value"]) for r in got.collect()) == [("x", "dev.small", 0.3, 1), ("y", "test-2019", 0.45, 3)]
    results = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "scorer string, value double")
    flags = spark.createDataFrame([("a", True)], "scorer string, equivalent boolean")
    assert sorted(map(tuple, cp.with_flags(results, flags, ["scorer"]).collect())) == [("a", 1.0, True, True), ("b", 2.0, False, False)]
    with pytest.raises(Exception, match="several tests"):
        cp.with_flags(results, flags.union(flags), ["scorer"]).collect()


def test_triple_sources(spark, tmp_path):
    docs = spark.createDataFrame([("1", "one"), ("2", "two"), ("2", "also two"), ("3", "")], "docno string, text string")
    with gzip.open(tmp_path / "t.tsv.gz", "wb") as f:
        f.write(b"query\tgood \xff\tbad\textra\nbroken\tline\n")
    (tmp_path / "i.tsv").write_text("q\t1\t2\nq\t1\t9\nq\t3\t1\nq\n")
    text = src.triple_source(spark, "text", str(tmp_path / "t.tsv.gz"))
    assert sorted((r["passage"], r["label"]) for r in text.collect()) == [("bad", 0), ("good \ufffd", 1)]
    ids = src.triple_source(spark, "id", str(tmp_path / "i.tsv"), docs)
    assert sorted(map(tuple, ids.collect())) == [("1", "one", 1), ("2", "also two", 0)]
    pairs = spark.createDataFrame([("2", "1"), ("1", "2"), (None, "1")], "pos_pid string, neg_pid string")
    assert src.triple_source(spark, "pairs", pairs, docs).count() == 4 and src.triple_source(spark, "pairs", pairs, docs, 2).count() == 2
    stats = src.triple_statistics(src.hydrate_triples(pairs, docs)).first()
    assert (stats["triples"], stats["valid"], stats["malformed"], stats["missing_pos"]) == (3, 2, 1, 1)
    for source, corpus in (("ftp", docs), ("pairs", None)):
        with pytest.raises(ValueError):
            src.triple_source(spark, source, pairs, corpus)


def test_lists_tables_and_lookups(spark, tmp_path):
    (tmp_path / "x.txt").write_text(" a \n\nb\n")
    (tmp_path / "x.csv").write_text("n,docno\n1,a\n")
    assert [sorted(r["docno"] for r in src.exclusions(spark, str(tmp_path / f)).collect()) for f in ("x.txt", "x.csv")] == [["a", "b"], ["a"]]
    x = spark.createDataFrame([("a", 1.0), ("b", None)], "docno string, f double")
    src.write_tsv(x, str(tmp_path / "o.tsv"))
    assert src.table(spark, str(tmp_path / "o.tsv")).columns == ["docno", "f"] == src.require(x, ["f"]).columns
    with pytest.raises(ValueError, match="zz"):
        src.require(x, ["zz"])
    assert {r["docno"]: r["f"] for r in scaling.lookup(x.select("docno"), x, ["f"], allow_missing=True).collect()} == {"a": 1.0, "b": 0.0}
    with pytest.raises(Exception, match="no f for b"):
        scaling.lookup(x.select("docno"), x, ["f"]).collect()
    assert [r["docno"] for r in ef.shared_ids(x.union(x), x.limit(1)).collect()] == ["a"]
    assert {r["docno"]: r["freq"] for r in scaling.first_examples(x.union(x), ["docno"], 3).collect()} == {"a": 2, "b": 1}


def test_history_tables(spark):
    old = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.4)], "run string, step long, loss double")
    new = spark.createDataFrame([("r", 2, 0.1), ("r", 3, 0.2)], "run string, step long, loss double")
    assert [r["loss"] for r in history.upsert(old, new, ["run", "step"]).orderBy("step").collect()] == [0.5, 0.1, 0.2]
    losses = spark.createDataFrame([("r", i, float(i)) for i in range(1, 7)], "run string, at long, loss double")
    evaluations = spark.createDataFrame([("r", 2), ("r", 5)], "run string, step long")
    assert [r["mean_loss"] for r in history.mean_loss_between(losses, evaluations).orderBy("step").collect()] == [1.5, 4.0]
    assert ef.timings("x", 10, 2.0)["ms_per_query"] == 200 and ef.timings("x", 0, 2.0)["ms_per_query"] is None


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", "x x x x"), ("b", "x y z"), ("c", None)], "docno string, text string").write.parquet(str(tmp_path / "p"))
    stream = ingest.keep_informative(spark.readStream.schema("docno string, text string").parquet(str(tmp_path / "p")), 0.5)
    q = stream.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "k1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and [r["docno"] for r in spark.table("kept").collect()] == ["b"]
    at = "timestamp'2026-01-0{} 0{}:10:00' as ts"
    for i, (day, hour) in enumerate([(1, 1), (1, 1), (1, 2), (2, 2), (1, 1)]):  # the last one is late
        spark.range(1).selectExpr(at.format(day, hour), "'e' as event_type", "1.0D as value").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        for f in sorted(os.listdir(tmp_path / "e")):
            if f.startswith("part-") and f.endswith(".parquet"):
                os.utime(tmp_path / "e" / f, (1_000_000 + i, 1_000_000 + i)) if os.stat(tmp_path / "e" / f).st_mtime > 2_000_000 else None
    events = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    out = ingest.windowed_counts(events).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "k2")).trigger(availableNow=True).start()
    assert out.awaitTermination(120)
    assert sorted((r["window"]["start"].hour, r["n"]) for r in spark.table("counts").collect()) == [(1, 2), (2, 1)]


def test_best_of_each_run(spark, monkeypatch):
    n = 3000
    x = spark.range(n).select((F.col("id") % 2).cast("string").alias("qid"), F.col("id").cast("string").alias("docno"), F.round(F.rand(1), 2).alias("a"), F.when(F.col("id") % 3 == 0, F.lit(1.0)).alias("b"), F.when(F.col("id") < 4, F.col("id") * 1.0).alias("c"))
    x = pruning.written(x)
    rows = x.toPandas()
    for cells in (1, 64, 4096):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        got = {(r["g"], r["qid"], r["rank"]): r["docno"] for r in retrieval.top_k_of_each(x, {"A": "a", "B": "b", "C": "c"}, 10).collect()}
        want = {}
        for g, col in (("A", "a"), ("B", "b"), ("C", "c")):
            for q, part in rows.dropna(subset=[col]).groupby("qid"):
                for i, doc in enumerate(part.sort_values([col, "docno"], ascending=[False, True])["docno"].head(10)):
                    want[g, q, i + 1] = doc
        assert got == want


def test_best_of_each_run_by_a_part_of_the_documents(spark):
    x = spark.range(4000).select((F.col("id") % 2).cast("string").alias("qid"), F.col("id").cast("string").alias("docno"), F.round(F.rand(1), 2).alias("a"), F.when(F.col("id") < 4, F.col("id") * 1.0).alias("c"))
    x = pruning.written(x)
    rows = lambda df: sorted((r["g"], r["qid"], r["rank"], r["docno"]) for r in df.collect())
    part = x.where(F.pmod(F.hash("docno"), F.lit(retrieval.PARTS)) == 0).withColumn("_cell", retrieval.cell_of(F.col("docno"), 10))
    least = retrieval.least_of_best(part, ["a", "c"], 10)
    assert least.where("_least_a > 0 AND _least_c IS NULL").count() == 2
    want = rows(retrieval.top_k_of_each(x, {"A": "a", "C": "c"}, 10))
    assert rows(retrieval.top_k_of_each(x, {"A": "a", "C": "c"}, 10, least)) == want
    assert rows(retrieval.top_k_of_each(x, {"A": "a", "C": "c"}, 10, least.where("qid = '0'"))) == want  # no bound for a query


def test_scores_of_all_topics_and_documents_are_never_written(spark, monkeypatch):
    from passagemill.plans import registry

    written = []
    monkeypatch.setattr(registry, "materialize", lambda df, name, make=registry.materialize: written.append(name) or make(df, name))
    assert registry.runs_long(spark, "/root/testdata/sf0.001", ("itn",), (0.3,)).count() > 0
    assert "sums" not in written and "runs" in written
