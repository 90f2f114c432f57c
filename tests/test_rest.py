import random
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hybridrank import runtime
from hybridrank.functions import text as X
from hybridrank.operators import experiments as N
from hybridrank.operators import families as M
from hybridrank.operators import fusion as G
from hybridrank.operators import grams as J
from hybridrank.operators import lexical as L
from hybridrank.operators import metrics as H
from hybridrank.operators import segment as W
from hybridrank.plans import search as P
from hybridrank.sources import export, formats
from hybridrank.sources import validate as C
from hybridrank.streaming import limits as K


def test_containing_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab山") for _ in range(n))
    patterns, texts = sorted({word(rng.randint(1, 6)) for _ in range(40)}), sorted({word(rng.randint(1, 30)) for _ in range(60)})
    p = spark.createDataFrame([(x, 1) for x in [*patterns, "", patterns[0]]], "p string, gram int")
    t = spark.createDataFrame([(i, x, 2) for i, x in enumerate([*texts, "", "x" * 50_000])], "k long, t string, gram int")
    got = {(r["p"], r["k"]) for r in J.containing(p, "p", t, "k", "t").collect()}
    assert got == {(a, i) for a in patterns for i, b in enumerate(texts) if a in b}
    assert J.containing(p.limit(0), "p", t, "k", "t").count() == 0 and J.containing(p, "p", t.limit(0), "k", "t").count() == 0


def test_entries_are_whole_rows(spark):
    rows = spark.createDataFrame([(1, "b", "x", ["t"], None), (1, "a", "y", None, None), (1, "a", "y", None, None)], "pos long, id string, meaning string, tags array<string>, loaded_at timestamp")
    assert [tuple(r) for r in L.entries(rows).select("pos", "id", "meaning", "tags").collect()] == [(1, "a", "y", None)]


def test_numbered(spark):
    df = spark.createDataFrame([(x, x % 7) for x in random.Random(1).sample(range(5000), 3000)], "x long, y long")
    got = [r["place"] for r in runtime.numbered(df.repartition(5), [F.col("y"), F.col("x")], "place").orderBy("y", "x").collect()]
    assert got == list(range(1, 3001))
    assert runtime.numbered(df.limit(0), [F.col("x")], "place").count() == 0


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        runtime.shared_dir(Session())


def test_templates_and_reranker_texts(spark):
    e = spark.createDataFrame(
        [(1, "山水", "shān shuǐ", " a  view ", "hills", "ex", ["x", "y"], None), (2, "水", None, None, "lit", None, None, "m"), (3, "火", None, "", None, None, [], None)],
        "pos long, chengyu string, pinyin string, meaning string, literal string, example string, tags array<string>, meaning_zh string",
    )
    got = {r["pos"]: r for r in e.select("pos", *[export.template(n).alias(n) for n in export.TEMPLATES], export.reranker_text().alias("rr"), export.bilingual_text().alias("bi")).collect()}
    assert len(export.TEMPLATES) == 11
    assert got[1]["rich"] == "Chinese idiom: 山水. Pinyin: shān shuǐ. Meaning: a view. Literal: hills. Tags: x, y"
    assert got[1]["query-style"] == "a view hills x y" and got[1]["meaning-boosted"] == "a view. a view. Literally: hills"
    assert got[2]["meaning-only"] == "lit" and got[2]["literal-first"] == "lit. Meaning:" and got[3]["literal-only"] == "火"
    assert got[1]["rr"] == "Meaning:  a  view . Literal: hills. Example: ex. Topics: x, y" and got[2]["rr"] == "Literal: lit" and got[3]["rr"] == ""
    assert got[2]["bi"] == "水. Meaning: . Literal: lit. Topics: \n释义：m" and got[1]["bi"].endswith("释义：ex")


def test_text_functions(spark):
    df = spark.createDataFrame([("CL:個|个[ge4], old (variant of 山) peak [shan1];",)], "s string")
    assert df.select(X.character_sense(F.col("s"))).first()[0] == "peak"
    z = spark.createDataFrame([("春天到了，他说山水好", "山水"), ("山水好", "山水"), ("他说山水", "山水")], "zh string, h string")
    assert [r[0] for r in z.select(X.example_preview(F.col("zh"), F.col("h"), 5)).collect()] == ["…他说山水好", "山水好", "他说山水"]
    assert spark.range(1).select(X.fnv1a(F.lit("𠀀"))).first()[0] == _fnv([0xD840, 0xDC00])
    r = spark.createDataFrame([(1, 100, "pinyin"), (2, 100, "pinyin"), (1, 99, "pinyin"), (1, 100, "literal")], "rank int, p int, t string")
    assert [x[0] for x in r.select(X.exact_match(F.col("rank"), F.col("p"), F.col("t"))).collect()] == [True, False, False, False]
    assert tuple(spark.range(1).select(X.has_han_script(F.lit("㐀")), X.has_han_script(F.lit("aカ"))).first()) == (True, False)


def _fnv(units):
    h = 2166136261
    for u in units:
        h = ((h ^ u) * 16777619) % 2**32
    return h


def test_packed_files_begin_with_their_magic(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", [1.0, 0.0])], "id string, chengyu string, vec array<double>")
    formats.write_packed(df, str(tmp_path / "v"))
    [f] = (tmp_path / "v").glob("*.vec")
    assert f.read_bytes().startswith(formats.MAGIC)
    bad = tmp_path / "bad.vec"
    bad.write_bytes(b"SOMETHING ELSE\n" + struct.pack("<I", 0))
    with pytest.raises(ValueError):
        formats._Reader(str(bad)).partitions()
    (tmp_path / "a.json").write_text('{"version": 1, "model": "m", "dimensions": 2, "embeddings": [{"id": "a", "chengyu": "x", "embedding": [1, 0]}]}')
    meta, vecs = formats.read_artifact(spark, str(tmp_path / "a.json"))
    assert meta.first()["model"] == "m" and vecs.first()["vec"] == [1.0, 0.0]
    (tmp_path / "d.u8").write_text("# c\n山水 山水 [shan1 shui3] /view/land/\nbad line\n綠 绿 [lu:4] /green/\r\n")
    got = {r["simplified"]: (r["pinyin"], r["definitions"]) for r in formats.read_dictionary(spark, str(tmp_path / "d.u8")).collect()}
    assert got == {"山水": ("shan1 shui3", ["view", "land"]), "绿": ("lü4", ["green"])}
    e = spark.createDataFrame([(1, "山", None, None, "shan1", "a\tb", None, None, ["t"], None)], "pos long, chengyu string, simplified string, traditional string, pinyin string, meaning string, literal string, example string, tags array<string>, formality string")
    export.write_flash_cards(e, str(tmp_path / "cards"))
    lines = [x for f in (tmp_path / "cards").glob("part*") for x in f.read_text().split("\n") if x]
    assert "#separator:tab" in lines and any(x.startswith("山\t山\t山\tshan1\tshān") or x.startswith("山\t山\t山\tshan1\tsh") for x in lines)


def test_families_for_display(spark):
    links = M.clean_links(spark.createDataFrame([(1, "甲", "乙", "same", "b"), (2, "乙", "甲乙丙", "full_form", None)], "link_no long, a string, b string, relation string, common string"))
    c = M.clusters(links)
    tied, common = M.cluster_links(links, c), M.common_forms(links, c)
    preferred = M.preferred_forms(common, c, tied, spark.createDataFrame([("乙", "甲乙丙")], "short string, full string"))
    assert {r["cluster"]: r["preferred"] for r in preferred.collect()} == {"乙": "乙", "甲乙丙": "乙"}
    corpus = spark.createDataFrame([(1, "甲", "jiǎ"), (2, "乙", "yǐ"), (3, "甲乙丙", None), (4, "独", None)], "pos long, chengyu string, pinyin string").withColumns({"simplified": F.lit(None).cast("string"), "traditional": F.lit(None).cast("string")})
    rows = spark.createDataFrame([("q", 1), ("甲", 1), ("jia", 1), ("q", 3), ("q", 4)], "query string, pos long")
    got = {(r["query"], r["pos"]): r["shown"] for r in M.display_entries(rows, c, preferred, corpus).collect()}
    assert got == {("q", 1): 2, ("甲", 1): 1, ("jia", 1): 1, ("q", 3): 2, ("q", 4): 4}
    kinds = M.variant_groups(M.related_of(corpus.select(F.col("chengyu").alias("headword")), c, tied), c, common)
    assert {(r["headword"], r["other"], r["kind"]) for r in kinds.collect()} == {("甲", "乙", "same"), ("乙", "甲", "same"), ("甲", "甲乙丙", "full"), ("乙", "甲乙丙", "full"), ("甲乙丙", "乙", "short")}


def test_descriptions_and_their_status(spark):
    corpus = spark.createDataFrame([(1, "山高水长", None, "山高水長")], "pos long, chengyu string, simplified string, traditional string")
    q = spark.createDataFrame([("", "english_meaning"), ("shan gao", "pinyin"), ("山高水长", "chinese_exact"), ("山高", "chinese_exact"), ("形容友谊长久的话", "chinese_exact"), ("a long friendship", "english_meaning")], "query string, query_type string")
    norm = spark.createDataFrame([("山高水长", "山高水长"), ("山高", "山高"), ("形容友谊长久的话", "形容友谊长久的话")], "query string, normalized string")
    d = L.described(q, corpus, norm)
    assert {r["query"] for r in d.where("described").collect()} == {"形容友谊长久的话", "a long friendship"}
    vectors = spark.createDataFrame([("a long friendship", None)], "query string, reason string")
    got = {r["query"]: (r["status"], r["path"]) for r in L.hosted_status(d, vectors).collect()}
    assert got["a long friendship"] == ("complete", "meaning") and got["形容友谊长久的话"] == ("unavailable", None) and got["山高"] == ("complete", "routed")
    waiting = spark.createDataFrame([("a long friendship", "timeout"), ("形容友谊长久的话", "budget")], "query string, reason string")
    assert {r["query"]: r["status"] for r in L.hosted_status(d, waiting).collect()}["a long friendship"] == "pending"


def test_refreshed_bookmarks(spark):
    corpus = spark.createDataFrame([("i1", "山", "shān"), ("i2", "水", "shuǐ"), ("i3", "水", "shuì")], "id string, chengyu string, pinyin string")
    saved = spark.createDataFrame([(1, "i1", None, None), (2, "gone", "山", "shān"), (3, None, "山", " "), (4, None, "水", "shuì"), (5, None, "水", None), (6, None, None, None)], "n long, id string, chengyu string, pinyin string")
    assert {r["n"]: r["id"] for r in C.refreshed(saved, corpus).collect()} == {1: "i1", 2: None, 3: "i1", 4: "i3", 5: None, 6: None}


def test_labels_reports_and_parity(spark):
    labels = spark.createDataFrame([("q", "a", 3.0)], "query string, item string, relevance double")
    more = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("q", "c", 9)], "query string, item string, grade int")
    assert {(r["item"], r["relevance"]) for r in H.with_supplement(labels, more).collect()} == {("a", 3.0), ("b", 1.5)}
    board = H.leaderboard(spark.createDataFrame([("x", 0.5), ("y", None), ("z", 0.9)], "mode string, ndcg double"), ["ndcg"])
    assert {r["mode"]: r["place"] for r in board.collect()} == {"z": 1, "x": 2, "y": 3}
    a = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.4)], "query string, pos int, score double")
    assert H.parity(a, a, ["query", "pos"], "score").count() == 0 and H.parity(a, a.where("pos = 1"), ["query", "pos"], "score").count() == 1
    assert {r["pos"]: r["score"] for r in G.best_of(a, a.withColumn("score", F.lit(0.45))).collect()} == {1: 0.5, 2: 0.45}
    tokens = spark.createDataFrame([("山", "word"), ("x", "other"), ("水", "word")], "token string, kind string")
    best = spark.createDataFrame([("山", 1), ("水", 2), ("x", 3)], "simplified string, entry_no int")
    own = spark.createDataFrame([("水", 9)], "token string, entry_no int")
    assert {r["token"]: r["entry_no"] for r in W.annotated(tokens, best, own).collect()} == {"山": 1, "x": None, "水": 9}
    assert {r["query"]: r["error"] for r in P.refused(spark.createDataFrame([(" ",), ("x" * 501,), ("ok",)], "query string")).collect()} == {" ": "blank", "x" * 501: "too long"}


def test_segmentation_with_reach_equals_without():
    rng = random.Random(3)
    words = {"".join(rng.choice("山水人") for _ in range(rng.randint(1, 5))): rng.randint(1, 4) for _ in range(30)}
    idioms = frozenset(list(words)[:4])
    for _ in range(200):
        t = "".join(rng.choice("山水人火a") for _ in range(rng.randint(0, 14)))
        assert W.best_path(t, words, idioms, 5) == W.best_path(t, words, idioms, 5, W.reaches(words))


def test_sweep_weighs_the_same_evidence(spark):
    parts = spark.createDataFrame([("q", "literal", 1, 3.0, 0.0), ("q", "literal", 2, 0.0, 1.0)], "query string, query_type string, pos long, token double, similarity double")
    got = {(r["profile"], r["pos"]): r["score"] for r in N.sweep(parts).collect()}
    assert got["current", 1] == 0.65 and got["literal-token-heavy", 1] == 0.75 and got["semantic-heavy", 2] == 0.4 and len(N.PROFILES) == 6 and len(N.RERANKERS) == 4


def test_streams_of_counters(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "/a", 200), (1, 0, "/a", 200), (2, 10, "/a", 500), (3, 400, "/b", 200)], "n long, s long, endpoint string, status_code int").withColumn("at", F.timestamp_seconds(F.col("s") + 1_000_000))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("counted", K.counters_stream(stream(), "at"), "complete"), ("once", K.deduplicated_stream(stream(), "n", "at"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r["endpoint"], r["requests"], r["failed"]) for r in spark.table("counted").collect()} == {("/a", 3, 1), ("/b", 1, 0)}
    assert sorted(r["n"] for r in spark.table("once").collect()) == [1, 2, 3]


def test_limits_of_a_null_and_a_hot_key(spark):
    rows = [(i, None if i % 3 == 0 else "c", i) for i in range(30)]
    e = spark.createDataFrame(rows, "n long, client string, s int").withColumn("at", F.timestamp_seconds("s"))
    got = {r["n"] for r in K.decide(e, K.FixedWindow(2, 1000), ["client"], "at", "n").where("admitted").collect()}
    assert got == {0, 3, 1, 2} and K.decide(e.limit(0), K.FixedWindow(2, 10), ["client"], "at", "n").count() == 0
    assert K.FixedWindow(2, 10).lasts() == 10 and K.TokenBucket(1, 86400).lasts() == 1 and K.Breaker().lasts() is None


def test_segmentation_hands_tokens_on_in_bounded_blocks(spark):
    texts = [(i, "山水火人" * 3_000) for i in range(4)]
    frames = [pd.DataFrame(texts, columns=["key", "text"])]
    blocks = list(W._cut(iter(frames), {"山水": 1, "人": 2}, frozenset(["山水"])))
    assert max(map(len, blocks)) <= W.BLOCK_TOKENS < sum(map(len, blocks)) == 36_000
    df = spark.createDataFrame([*texts, (4, None), (5, "")], "k long, t string")
    words = spark.createDataFrame([("山水",), ("人",), ("人",)], "w string")
    got = W.segmented(df, "k", "t", words, "w", words.where("w = '山水'").select(F.col("w").alias("word"))).toPandas().sort_values(["key", "n"])
    assert got.values.tolist() == pd.concat(blocks).sort_values(["key", "n"]).values.tolist()
