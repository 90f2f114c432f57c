import re

import numpy as np
import pandas as pd
import pytest

from hybridrank.llm import lookalike as A
from hybridrank.llm import mojibake as B
from hybridrank.llm.mixing import mix, sainte_lague, shares
from hybridrank.llm.packing import bucket_ends, pack, plan_batches

KINDS = {"chengyu": "headword", "pinyin": "pinyin"}
NONE = A.Speller(np.zeros(A.ROWS * A.PLACES, np.float32))


def head(t):
    return NONE.form(t, "headword")


def read(t):
    return NONE.form(t, "pinyin")


def speller(texts, kind):
    counts = np.zeros(A.ROWS * A.PLACES, np.float32)
    for f in A._Count({"t": kind})(iter([pd.DataFrame({"t": texts})])):
        counts[f["place"].to_numpy()] = f["n"].to_numpy()
    return A.Speller(counts)


def first_readings(t, kind):
    return " ".join("".join(p[1][0] for p in token) for token in A.lattices(t, kind))


def test_consistent_forms():
    assert head("山​水︀") == head("　山水 ") == head("⼭⽔") == "山水"
    assert head("风，飞") == head("⻛,⻜") == "风，飞" and head("ＡＢ１") == head("АВ1") == "AB1"
    assert head("己") != head("已") and head("国") != head("國") and head("a") != head("A")
    forms = ["lǜ hǎi, mén", "lǜ hǎi, mén", "lù̈ hăi, mén", "ｌǜ һǎi， mén ", "l⁠ǜ hǎі, mén"]
    assert {read(f) for f in forms} == {"lǜ hǎi, mén"}
    assert read("má") != read("mà") and read("Má") != read("má") and read("mu") != read("mü")
    assert head("＾Ο") == "^O" and head("＾A") == "^A" and read("") == "" and head("​ ") == ""


def test_look_alikes_are_readings_in_both_directions():
    for typed in ("a", "а", "ɑ"):
        assert {"a", "а", "ɑ"} <= set(A._headword_place(typed)[1])
    assert {"口", "囗", "ロ"} <= set(A._headword_place("ロ")[1]) and "口" not in A._headword_place("囗")[1]
    assert {"ā", "а̄"} <= set(A._pinyin_place("а", "̄")[1])


#: What is meant, and typed with look-alikes that stand for more than one letter.
MEANT = ["人囗学", "口福", "204", "AO", "A204", "MOVIE", "lín", "jī", "xiǎo", "москва", "дно", "она", "сад", "ложка"]
TYPED = ["人ロ学", "ロ福", "2О4", "АО", "А2О4", "МОVІЕ", "ӏín", "jı̄", "хıǎо", "mocквa", "днo", "oнa", "caд", "лoжкa"]


def test_the_path_decides_where_first_readings_are_wrong():
    corpus = ["人囗学", "大囗学", "口福", "口气", "2024", "1204", "A204", "AO", "MOVIE", "MOON", "lín lì", "jī qǐ xiǎo", "она сидела в саду", "сад и дно озера", "ложка и нож", "москва и дно", "вода несла она", "молодой мол, и сквозь дождь"] * 3
    by_path = speller(corpus, "pinyin")
    good = [by_path.form(t, "pinyin") == m for t, m in zip(TYPED, MEANT)]
    first = [first_readings(t, "pinyin") == m for t, m in zip(TYPED, MEANT)]
    assert all(good), [(t, by_path.form(t, "pinyin")) for t, g in zip(TYPED, good) if not g]
    assert sum(first) <= len(MEANT) // 2
    # Typed as meant, the same form comes out: the pair is found, and by first readings it is lost.
    lost = [m for t, m in zip(TYPED, MEANT) if first_readings(t, "pinyin") != first_readings(m, "pinyin")]
    assert [by_path.form(m, "pinyin") for m in MEANT] == MEANT and "204" in lost and "人囗学" in lost


def test_viterbi_against_all_paths():
    import itertools

    sp = speller(["lín lì", "2024", "AO", "AIL", "она сад дно и"] * 5, "pinyin")
    for t in ("ӏí", "А2О", "ОІl", "оna", "О", "саа"):
        for token in A.lattices(t, "pinyin"):
            score = lambda letters: sum(sp.step(a, b) for a, b in zip([A.END, *letters], [*letters, A.END]))
            assert score(max(itertools.product(*[p[1] for p in token]), key=score)) == pytest.approx(score([x for x in re.findall(".[̀-ͯ]*", sp.spelled(token))]))


def test_viterbi_prefers_one_script(spark):
    df = spark.createDataFrame([("O", "lín lì"), ("Х20О", "lín")] * 20 + [("2О4", "cһī"), ("AОX", "lıng")], "chengyu string, pinyin string")
    rows = A.unify(df, KINDS).collect()
    by = {(r["chengyu"], r["pinyin"]): (r["chengyu_form"], r["pinyin_form"]) for r in rows}
    assert by["AОX", "lıng"] == ("AOX", "ling") and by["2О4", "cһī"][1] == "chī"


def test_pairs(spark, monkeypatch):
    monkeypatch.setattr(A, "PART", 2)
    rows = [(1, "山水", "shān"), (1, "山水", "shān"), (2, "山​水", "shān"), (3, "山水", "shān"), (4, "山水", None), (5, "山水 ", None), (6, None, None), (7, "", ""), (8, "​", ""), (None, "⼭水", "shān")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "pos long, chengyu string, pinyin string, form string, stored string")
    got = {(r["a"], r["b"]) for r in A.lookalike_pairs(df, "pos", KINDS).collect()}
    assert got == {(1, 2), (2, 3), (4, 5), (7, 8)}
    assert {(r["key"], r["head"]) for r in A.lookalike_members(df, "pos", KINDS).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7), (8, 7)}
    assert A.lookalike_pairs(df.limit(0), "pos", KINDS).count() == 0
    long = spark.createDataFrame([("山" * 50_000 + "​", "ā " * 20_000)], "chengyu string, pinyin string")
    assert len(A.unify(long, KINDS).first()["chengyu_form"]) == 50_000


SAYINGS = ["The saying isn’t about a café, yet we’d “use” it.", "Übung macht für größere Brücken müde.", "Рассказ звучит мягко, но вывод довольно строгий.", "这句话语气比较安静，书面语里更多见。", "編輯在頁邊寫道：此處的燈籠應改為漁網。"]
LANGS = ["en", "de", "ru", "zh", "zh-TW"]


@pytest.fixture(scope="module")
def restorer():
    extra = ["One careful reader kept the lantern.", "Ähnlich, aber schärfer, klingt es.", "Ученики часто путают ударение.", "两位老师为这个词争论了很久。", "學生問老師：“傍晚誰來？”"]
    return B.Restorer(*B.train({lang: [s + " " + e] * 40 for lang, s, e in zip(LANGS, SAYINGS, extra)}))


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "koi8-r", "cp437", "cp850", "mac_roman", "cp1251"])
def test_round_trips(restorer, read):
    for t in SAYINGS:
        half = B.HALVES[read]
        garbled = "".join(chr(b) if b < 0x80 else half[b - 0x80] for b in t.encode())
        assert restorer.restore(garbled)[0] == t


def test_other_chains(restorer):
    assert restorer.restore(SAYINGS[2].encode("koi8-r").decode("cp1251"))[0] == SAYINGS[2]
    assert restorer.restore(SAYINGS[3].encode("gbk").decode("latin-1"))[0] == SAYINGS[3]
    twice = SAYINGS[0].encode().decode("latin-1").encode().decode("latin-1")
    assert restorer.restore(twice)[0] == SAYINGS[0]
    for t in [*SAYINGS, "Ångström, naïve, 簋匜罍, ┌──┐ 80°C ± 2°", "", "plain"]:
        assert restorer.restore(t) == (t, "", 0)


def test_restore_rows(spark):
    bad = SAYINGS[3].encode().decode("latin-1")
    rows = [(i, s, lang, "x") for i, (s, lang) in enumerate(zip(SAYINGS * 20, LANGS * 20))] + [(200, bad, None, "x"), (200, bad, None, "x"), (201, None, "en", "x"), (202, "", None, None), (203, "lost �", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, chain string")
    got = B.restore_texts(df).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got if r["repair"] and r["repair"]["garbled"]} == {200, 203}
    assert {r["repair"]["text"] for r in got if r["doc_id"] == 200} == {SAYINGS[3]}
    assert [r["repair"] for r in got if r["doc_id"] == 201] == [None]
    assert B.restore_texts(df.limit(0)).count() == 0
    assert B.restore_texts(spark.createDataFrame([("é" * 200_000, None)], "text string, lang string")).first()["repair"]["garbled"] is False


def test_few_readings_are_compressed():
    """Neither sound text with accents nor text that is UTF-8 throughout is compressed in every recoding there is."""
    pinyin = ["Say zhé zhòng tiè féng sàn slowly, and mind the tone of lóng hǔ.", "Between dài lái and yú there is a tone, as in jiàn qín zài ròu."]
    greek = ["Ο τόνος της τελευταίας συλλαβής αλλάζει όλη τη σημασία."]
    met = frozenset(c for half in B.HALVES.values() for c in half if c.isalpha())
    made = B.Restorer(*B.train({**{lang: [s] * 40 for lang, s in zip(LANGS, SAYINGS)}, "en": pinyin * 300, "el": greek * 30}), met)
    calls = []

    class Counting:
        def __init__(self, packer):
            self.packer = packer

        def compress(self, raw):
            calls.append(raw)
            return self.packer.compress(raw)

    made.packers = [(chars, Counting(packer)) for chars, packer in made.packers]
    for t in pinyin:
        assert made.restore(t) == (t, "", 0)
    assert len(set(calls)) < 5
    calls.clear()
    assert made.restore(SAYINGS[3].encode().decode("latin-1"))[0] == SAYINGS[3]
    assert len(set(calls)) < 10
    # A language that is rare beside the others is read right all the same.
    assert made.restore(greek[0].encode("cp1253").decode("latin-1"))[0] == greek[0]
    assert made.restore(greek[0].encode("cp1253").decode("cp1251"))[0] == greek[0]


def test_texts_at_once_are_as_one_by_one(restorer):
    texts = [*SAYINGS, "plain", "", SAYINGS[3].encode().decode("latin-1"), SAYINGS[2].encode("koi8-r").decode("cp1251"), SAYINGS[3].encode().decode("latin-1")]
    assert restorer.restore_all(texts) == [restorer.restore(t) for t in texts]
    assert [len(x) for x in B._portions(["ab", None, "c", "", "d"], 3)] == [3, 2] and list(B._portions([])) == []


def test_runs_are_decoded_apart():
    rng = np.random.default_rng(4)
    for w in [*B.DOUBLE, "utf-8", "cp1251", "koi8-r"]:
        for _ in range(300):
            raws = [bytes(rng.choice(np.r_[33:127, 128:256, 128:256], n).astype(np.uint8)) for n in rng.integers(1, 9, 4)]
            assert B._decoded(raws, w) == [raw.decode(w, errors="replace") for raw in raws]


def test_rare_characters_are_restored(spark, restorer):
    rare = "簋匜罍觚，爵斝盉卣"
    for read in ("latin-1", "cp1252", "cp437"):
        half = B.HALVES[read]
        garbled = "".join(chr(b) if b < 0x80 else half[b - 0x80] for b in rare.encode())
        assert restorer.restore(garbled)[0] == rare
    # Known from all texts, although too rare in the sample's sentences.
    rows = [(s, lang) for s, lang in zip(SAYINGS * 150, LANGS * 150)] + [(f"{rare}{i}", "und") for i in range(3)] + [("簠", "und")] * 2
    met = B.met_characters(spark.createDataFrame(rows, "text string, lang string"), "text")
    assert set(rare) <= met and "簠" not in met
    assert not restorer.readings.plausible(rare, set()) and B.Readings(frozenset(), {}, met).plausible(rare, set())


def test_bucket_ends_are_optimal():
    counts = np.zeros(13, np.int64)
    counts[[1, 2, 5, 6, 7, 12]] = [5, 1, 4, 2, 9, 1]
    import itertools

    lengths = [1, 2, 5, 6, 7, 12]

    def padding(ends):
        return sum(counts[n] * (min(e for e in ends if e >= n) - n) for n in lengths)

    for b in (1, 2, 3, 4):
        best = min(padding([*c, 12]) for c in itertools.combinations(lengths[:-1], b - 1))
        assert padding(bucket_ends(counts, b)) == best


def test_bucket_ends_against_the_matrix():
    rng = np.random.default_rng(8)
    for n, b in ((60, 5), (90, 20), (120, 3)):
        counts = np.zeros(n, np.int64)
        counts[rng.choice(np.arange(1, n), n // 2, replace=False)] = rng.integers(1, 1000, n // 2)
        lengths = np.flatnonzero(counts)
        best = {0: 0.0}
        for _ in range(b):
            best = {j: min(v + sum(counts[x] * (lengths[j - 1] - x) for x in lengths[i:j]) for i, v in best.items() if i < j or j == 0) if j else 0.0 for j in range(len(lengths) + 1)}
        ends = bucket_ends(counts, b)
        assert len(ends) <= b and ends[-1] == lengths[-1]
        assert sum(counts[x] * (min(e for e in ends if e >= x) - x) for x in lengths) == best[len(lengths)]


def test_bucket_ends_of_many_lengths():
    import time
    import tracemalloc

    rng = np.random.default_rng(3)
    counts = np.concatenate([[0], rng.integers(1, 10**6, 65_536)])
    tracemalloc.start()
    began = time.process_time()
    ends = bucket_ends(counts, 256)
    took, (_, most) = time.process_time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(ends) == 256 and took < 10 and most < 1 << 30


def test_partitioning_makes_no_difference(spark):
    rng = np.random.default_rng(12)
    rows = [(i, "big" if i % 3 else "small", int(n)) for i, n in enumerate(rng.integers(5, 60, 4000))]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 3)], "source string, target_share double, max_repeats int")
    mixes = [{(r["doc_id"], r["times"]) for r in mix(df.repartition(p), "source", "n", targets).collect()} for p in (1, 8)]
    packs = [{(r["key"], r["container"]) for r in pack(df.repartition(p), "doc_id", "n", 100).collect()} for p in (1, 8)]
    assert mixes[0] == mixes[1] and packs[0] == packs[1]


def test_plan_covers_every_rank():
    plan, used = plan_batches(100, [10, 35, 60, 100], [57, 40, 13, 4])
    room = {}
    for b, (end, n) in enumerate(zip([10, 35, 60, 100], [57, 40, 13, 4])):
        ranks = []
        for pb, first, items, container, each in plan:
            if pb == b:
                for i in range(items):
                    ranks.append(first + i)
                    room[container + i // each] = room.get(container + i // each, 0) + end
        assert sorted(ranks) == list(range(n))
    assert set(room) == set(range(used)) and max(room.values()) <= 100


def test_pack(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(n), "x") for i, n in enumerate(rng.integers(1, 90, 400))] + [(1000, 250, "x"), (1001, 0, "x"), (1002, None, None), (3, 40, "x"), (3, 40, "x"), (None, 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n long, container string")
    got = pack(df, "doc_id", "n", 100, buckets=32).toPandas()
    real = got[got.container.notna()]
    assert real.n_tokens.sum() == sum(r[1] or 0 for r in rows) and real.groupby("container").n_tokens.sum().max() <= 100
    assert got[got.container.isna()].key.tolist() in ([1001, 1002], [1002, 1001])
    assert sorted(got[got.key == 1000].n_tokens) == [50, 100, 100] and (got[got.key == 3].shape[0]) == 3
    whole = pack(df, "doc_id", "n", 100).where("container is not null").toPandas()
    assert whole.groupby("container").n_tokens.sum().mean() > 93 and len(whole) == len(real)
    assert pack(df.limit(0), "doc_id", "n", 100).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", "n", 0)


def test_sainte_lague():
    assert sainte_lague([53, 24, 23], 7) == [3, 2, 2]
    assert sainte_lague([1, 1], 3) == [2, 1] and sainte_lague([5, 1], 10, [2, 3]) == [2, 3] and sainte_lague([0, 0], 4) == [0, 0]


def test_sainte_lague_at_once_equals_one_by_one():
    import random

    def slow(weights, seats, most):
        given = [0] * len(weights)
        for _ in range(seats):
            free = [i for i, w in enumerate(weights) if w > 0 and given[i] < most[i]]
            if not free:
                break
            given[max(free, key=lambda i: (weights[i] / (2 * given[i] + 1), -i))] += 1
        return given

    rng = random.Random(4)
    for _ in range(200):
        w = [rng.choice([0, 1, 3, 7, 20, 20.5, 400]) for _ in range(rng.randint(1, 7))]
        most = [rng.choice([0, 5, 40, 1000]) for _ in w]
        seats = rng.randint(0, 300)
        assert sainte_lague(w, seats, most) == slow(w, seats, most)
    assert sum(sainte_lague([1.0] * 1000, 1_000_000)) == 1_000_000


def test_mix_of_many_shards(spark, monkeypatch):
    from hybridrank.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_TOKENS", 2_000)
    rng = np.random.default_rng(16)
    df = spark.createDataFrame([(i, "ab"[i % 2], int(n)) for i, n in enumerate(rng.integers(5, 60, 4000))], "doc_id long, source string, n long")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in shares(mix(df, "source", "n", targets), "source", "n", targets).collect()}
    assert abs(got["a"]["actual_share"] - 0.7) < 0.01 and got["a"]["most_times"] <= 2 and got["b"]["most_times"] == 1


def test_mix(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "big" if i % 3 else "small", int(n), "x") for i, n in enumerate(rng.integers(5, 60, 3000))] + [(9001, None, 10, "x"), (9002, "other", 10, "x"), (9003, "big", None, "x"), (9004, "big", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long, s string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 3), ("gone", 0.2, 1)], "source string, target_share double, max_repeats int")
    m = mix(df, "source", "n", targets)
    got = {r["source"]: r for r in shares(m, "source", "n", targets).collect()}
    assert abs(got["big"]["actual_share"] - 0.4) < 0.01 and abs(got["small"]["actual_share"] - 0.6) < 0.01
    assert got["small"]["most_times"] <= 3 and got["big"]["most_times"] == 1 and got["gone"]["tokens"] == 0
    assert m.count() == m.select("doc_id").distinct().count() and not {9001, 9002, 9003, 9004} & {r["doc_id"] for r in m.collect()}
    assert {r["doc_id"] for r in m.collect()} == {r["doc_id"] for r in mix(df, "source", "n", targets).collect()}
    assert mix(df.limit(0), "source", "n", targets).count() == 0
    capped = {r["source"]: r["tokens"] for r in shares(mix(df, "source", "n", targets, total=10**7), "source", "n", targets).collect()}
    whole = {s: sum(r[2] for r in rows[:3000] if r[1] == s) for s in ("big", "small")}
    assert capped["big"] == whole["big"] and capped["small"] == 3 * whole["small"]
