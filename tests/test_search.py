import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridrank.functions import vectors as V
from hybridrank.operators import families as M
from hybridrank.operators import fusion as G
from hybridrank.operators import fuzzy as Z
from hybridrank.operators import lexical as L
from hybridrank.operators import metrics as H
from hybridrank.operators import segment as W
from hybridrank.operators import vectors as D
from hybridrank.sources import formats
from hybridrank.sources import validate as C
from hybridrank.streaming import limits as K


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_distances_against_brute_force():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    pairs = [(word(rng.randint(1, 32)), word(rng.randint(0, 60))) for _ in range(500)]
    best, _ = Z.substring_distances([p for p, _ in pairs], [t for _, t in pairs])
    assert best.tolist() == [distance(p, t) for p, t in pairs]


@pytest.mark.parametrize("threshold", [0.2, 0.24, 0.4])
def test_candidates_lose_nothing(spark, threshold):
    rng = random.Random(int(threshold * 100))
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    texts, queries = sorted({word(rng.randint(3, 40)) for _ in range(60)}), sorted({word(rng.randint(1, 70)) for _ in range(30)} - {""})
    tdf = spark.createDataFrame([(t,) for t in texts], "text string")
    c = Z.chunks(spark.createDataFrame([(q, q) for q in queries], "query string, pattern string"), threshold)
    got = {(r["chunk"], r["text"]) for r in Z.candidates(c, tdf).collect()}
    for r in c.collect():
        m, e = len(r["chunk"]), r["e"]
        assert e == max(x for x in range(m) if x == 0 or x / m <= threshold)
        for t in texts:
            if distance(r["chunk"], t) <= e:
                assert (r["chunk"], t) in got


def test_fuzzy_search_scores(spark):
    corpus = spark.createDataFrame([(0, "kitten", ["x", "sitting"]), (1, "kitchen sink", None), (2, "dog", [" "])], "pos long, title string, tags array<string>")
    q = spark.createDataFrame([("kitten", "kitten")], "query string, pattern string")
    rows = Z.fuzzy_search(corpus, q, Z.Profile({"title": 0.5, "tags": 0.2}, 0.4)).collect()
    assert [r["pos"] for r in sorted(rows, key=lambda r: r["rank"])] == [0, 1]
    assert rows[0]["score"] == pytest.approx(Z.EPSILON**0.5 * (2 / 6) ** 0.2)
    assert Z.fuzzy_search(corpus, q.limit(0), Z.Profile({"title": 0.5})).count() == 0


def test_entries_of_evidence_without_weight_fill_places(spark):
    rows = [(i, "lanterns", None, None, None) for i in (1, 2)] + [(3, "river", None, None, None)]
    corpus = spark.createDataFrame(rows, "pos long, meaning string, literal string, example string, tags array<string>")
    asked = L.asked(spark.createDataFrame([("lant",)], "query string"))
    got = L.token_topk(L.TokenIndex(corpus), asked, 3, L.TokenWeights(fuzzy_prefix=0.0, fuzzy_contains=0.0)).collect()
    assert sorted((r["rank"], r["pos"], r["score"]) for r in got) == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 8))
    df = spark.createDataFrame([(i, f"i{i}", "x", [float(x) for x in r]) for i, r in enumerate(m)], "pos long, id string, chengyu string, vec array<float>")
    index = df.select("pos", V.unit(F.col("vec")).alias("vec"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("prior"))
    got = D.scan(index, df.where("pos = 3").select(F.col("pos").alias("query_id"), "vec"), 5).first()
    f = m.astype(np.float32).astype(float)
    cos = f @ f[3] / np.linalg.norm(f, axis=1) / np.linalg.norm(f[3])
    assert [b["pos"] for b in got["best"]] == np.argsort(-cos)[:5].tolist()
    assert got["mean"] == pytest.approx(cos.mean(), abs=1e-6) and got["std"] == pytest.approx(cos.std(), abs=1e-6)
    for kind in ("f32", "i8"):
        path = str(tmp_path / kind)
        formats.write_packed(df, path, kind)
        back = {r["id"]: r for r in formats.read_packed(spark, path).collect()}
        assert len(back) == 40
        a, b = np.array(back["i3"]["vec"]), f[3]
        assert a @ b / np.linalg.norm(a) / np.linalg.norm(b) > 0.999


LINKS = [(1, "a", "b", "same", "a"), (2, "b", "c", " SAME ", "b"), (3, "c", "long", "full_form", None), (4, "x", "y", "same", "equal"), (5, "x", None, "same", "a"), (6, "a", "a", "same", "a"), (7, "a", "z", "related", "a")]


def test_families_and_collapse(spark):
    links = M.clean_links(spark.createDataFrame(LINKS, "link_no long, a string, b string, relation string, common string"))
    c = M.clusters(links)
    assert {r["headword"]: r["cluster"] for r in c.collect()} == {"a": "a", "b": "a", "c": "a", "long": "long", "x": "x", "y": "x"}
    tied = M.cluster_links(links, c)
    assert {(r["cluster"], r["other"]) for r in tied.collect()} == {("a", "long"), ("long", "a")}
    assert {r["cluster"]: r["common"] for r in M.common_forms(links, c).collect()} == {"a": "a", "x": "x", "long": "long"}
    ranked = spark.createDataFrame([("q", i, h) for i, h in enumerate(["b", "b", "a", "k", "long", "x", "y"], 1)], "query string, rank int, headword string")
    kept = [r["headword"] for r in sorted(M.collapse(ranked, c, tied).collect(), key=lambda r: r["rank"])]
    assert kept == ["b", "b", "k", "x"]


def test_fusion_of_single_channels(spark):
    s = spark.createDataFrame([("q", 1, 0.6, 1)], "query string, pos long, score double, rank int")
    k = spark.createDataFrame([("q", 2, 0.9, 1)], "query string, pos long, score double, rank int")
    x = spark.createDataFrame([("q", 3)], "query string, pos long")
    t = spark.createDataFrame([("q", "literal")], "query string, query_type string")
    got = {r["pos"]: r["score"] for r in G.fuse(s, k, x, t).collect()}
    assert got == {1: 0.51, 2: 0.135, 3: 11.0}
    with pytest.raises(ValueError):
        G.page(s, 45, 10)


def test_limits_batch(spark):
    rows = [(i, "c", t, ok) for i, (t, ok) in enumerate([(0, True), (1, False), (2, False), (61, True), (62, True)])]
    e = spark.createDataFrame(rows, "n long, client string, s int, ok boolean").withColumn("at", F.timestamp_seconds("s"))
    said = lambda rule, ok=None: [r["admitted"] for r in sorted(K.decide(e, rule, ["client"], "at", "n", ok).collect(), key=lambda r: r["n"])]
    assert said(K.FixedWindow(2, 60)) == [True, True, False, True, True]
    assert said(K.Breaker(2, 30), "ok") == [True, True, True, True, True]
    assert said(K.TokenBucket(1, 86400 / 60)) == [True, False, False, True, False]


def test_limits_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"c{i % 3}", i * 7) for i in range(60)]
    e = spark.createDataFrame(rows, "n long, client string, s int").withColumn("at", F.timestamp_seconds("s"))
    for half in (0, 1):
        e.where(f"n div 30 = {half}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rule = K.FixedWindow(3, 100)
    q = K.decide_stream(stream, rule, ["client"], "at", "n").writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["n"]: r["admitted"] for r in spark.table("limits").collect()}
    assert got == {r["n"]: r["admitted"] for r in K.decide(e, rule, ["client"], "at", "n").collect()}


def test_ndcg_and_holdout(spark):
    res = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, item string, rank int")
    lab = spark.createDataFrame([("q", "b", 3.0), ("q", "c", 1.0), ("z", "c", 0.0)], "query string, item string, relevance double")
    got = {r["query"]: r["ndcg"] for r in H.ndcg(res, lab).collect()}
    assert got["q"] == pytest.approx((3 / np.log2(3)) / (3 + 1 / np.log2(3))) and got["z"] == 0
    cases = spark.createDataFrame([(t, f"{t}{i}") for t in "ab" for i in range(4)] + [("c", "c0")], "kind string, key string")
    held = H.holdout(cases, "kind", "key").where("held_out").groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in held} == {"a": 1, "b": 1}


def test_segmentation():
    words = {"山": 1, "山水": 1, "水": 2, "山高水长": 1, "高": 1}
    assert W.best_path("山水高A", words, frozenset(), 4) == [("山水", "word"), ("高", "word"), ("A", "other")]
    assert W.best_path("山高水长", words, frozenset(["山高水长"]), 4) == [("山高水长", "word")]
    assert W.best_path("龙", {}, frozenset(), 1) == [("龙", "uncovered")]
    assert W.word_parts("山水高", frozenset(["山水", "山水高"])) == ["山水", "高"]


def test_migration(spark):
    saved = spark.createDataFrame([(1, "old1"), (2, "new"), (3, "new"), (4, "old2"), (5, "old3")], "n long, id string")
    alias = spark.createDataFrame([("old1", "new"), ("old2", "gone"), ("old3", "gone")], "old string, new string")
    assert {r["id"]: r["n"] for r in C.migrated(saved, alias).collect()} == {"new": 2, "gone": 5}


def test_converter(spark):
    c = W.Converter({"山峰", "头发"}, {"皇后": "皇后"}, {"頭髮": "头发", "以後": "以后"}, {"頭": "头", "髮": "发", "後": "后"})
    df = spark.createDataFrame([("以後頭髮",), ("皇后",), (None,), ("",)], "q string")
    assert [r["q"] for r in W.converted(df, "q", c).collect()] == ["以后头发", "皇后", None, ""]
    with pytest.raises(ValueError):
        W.Converter(set(), {}, {}, {"a": "b", "b": "a"})("a")


def test_blend_and_rerank(spark):
    ranked = spark.createDataFrame([("q", 1, 0.9, 1), ("q", 2, 0.8, 2), ("q", 3, 0.7, 3)], "query string, pos long, score double, rank int")
    raw = spark.createDataFrame([("q", 1, 0.0), ("q", 2, 4.0)], "query string, pos long, raw double")
    got = {r["pos"]: (r["rank"], r["score"]) for r in G.minmax_rerank(ranked, raw, 2, 0.5).collect()}
    assert got[2] == (1, pytest.approx(0.9)) and got[1] == (2, pytest.approx(0.45)) and got[3][0] == 3 and got[3][1] < 0.45
    scores = spark.createDataFrame([([2.0],), ([1.0, 4.0],)], "s array<double>")
    assert [r[0] for r in scores.select(G.logit(F.col("s"))).collect()] == [2.0, 3.0]


def test_feature_rerank_makes_no_row_for_every_word_of_a_pair(spark):
    from hybridrank.operators import fusion as G

    ranked = spark.createDataFrame([("a b b", 1, 0.9, 1), ("a b b", 2, 0.8, 2), ("a b b", 3, 0.7, 3)], "query string, pos long, score double, rank int")
    asked = spark.createDataFrame([("a b b", ["a", "b", "b"])], "query string, tokens array<string>")
    texts = {1: ["c"], 2: ["a", "b", "b", "c"], 3: ["b", "c", "c"]}
    rows = [(p, c, c, "", "", "") for p, c in texts.items()]
    feats = spark.createDataFrame(rows, "pos long, concept array<string>, fields array<string>, literal_text string, meaning_text string, example_text string")
    idf = spark.createDataFrame([("a", 2.0), ("b", 0.5)], "token string, idf double")
    got = G.feature_rerank(ranked, asked, feats, idf, 3, 0.5, {"jaccard": 1.0})
    assert "explode(array_distinct(concat(tokens" not in got._jdf.queryExecution().optimizedPlan().toString()
    # Shared over all weight: 0 of 4; 3 of 4; 0.5 of 2 + 1 + 2.
    new = {1: 0.45, 2: 0.8 * 0.5 + 0.5, 3: 0.7 * 0.5 + 0.1 / 0.75 * 0.5}
    assert {r["pos"]: (r["score"], r["rank"]) for r in got.collect()} == {p: (round(s, 9), sorted(new.values(), reverse=True).index(s) + 1) for p, s in new.items()}


def test_rankings_that_are_read_twice_are_made_once(spark):
    import __spark_entry__

    plan = lambda name: __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CoGroups" not in plan("minmax_rerank") and "CoGroups" not in plan("feature_rerank")


def test_links_are_tied_in_tasks_first_and_lists_walked_without_a_frame_each(spark, monkeypatch):
    rng = random.Random(15)
    chain = [f"h{i:03d}" for i in rng.sample(range(90), 90)]
    pairs = [*zip(chain[:60], chain[1:60]), *zip(chain[60:], chain[61:])]
    links = spark.createDataFrame([(i, a, b, "same", None) for i, (a, b) in enumerate(pairs)], "link_no long, a string, b string, relation string, common string")
    want = {h: min(part) for part in (chain[:60], chain[60:]) for h in part}
    for most in (1_000, 20):
        monkeypatch.setattr(M, "LINKS_PER_TASK", most)
        assert {r["headword"]: r["cluster"] for r in M.clusters(links).collect()} == want
    ranked = spark.createDataFrame([(f"q{q % 7}", r, chain[(q * 31 + r * 17) % 90]) for q in range(7) for r in range(1, 12)], "query string, rank int, headword string")
    got = M.collapse(ranked, M.clusters(links), spark.createDataFrame([], "cluster string, other string"))
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    firsts = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["query"], r["rank"])):
        firsts.setdefault((r["query"], want[r["headword"]]), (r["rank"], r["headword"]))
    assert {(r["query"], want[r["headword"]]): (r["rank"], r["headword"]) for r in got.collect()} == firsts
