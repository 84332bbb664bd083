from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandloom.common import table
from bandloom.llm import canon, encoding, leaks, matching, mixing, neighbours, queries, reading


# --- free values to a list ---------------------------------------------------


def terms(spark):
    return spark.createDataFrame([(1, "instrument", "Veltor FieldSpan 350", None), (2, "instrument", "Veltor FieldSpan 2500", None), (3, "spectrometer", "KYRIO6", "Kyriome orbiter, visible channel"), (4, "yunit", "reflectance (percent)", None), (5, "yunit", "reflectance (fraction)", None)], "termid long, field string, term string, detail string")


@pytest.mark.parametrize(
    ("field", "value", "want"),
    [("instrument", "Vletor_fieldspan 350", 1), ("instrument", "FieldSpan 2500 by Veltor", 2), ("instrument", "inst=Ve1t0r FieldSpan 350 s/n 2500", 1), ("instrument", "Dravit 350", 0), ("instrument", "", 0), ("instrument", "?", 0), ("spectrometer", "KYR106", 3), ("spectrometer", "*kyro6]", 3), ("spectrometer", "Kyriome orbiter (6)", 3), ("yunit", "Percent refl..", 4), ("yunit", "Réflectance (%)", 4), ("yunit", "percent", 0), ("yunit", "R 0-1", 5), ("unknown field", "x", 0), ("instrument", "FieldSpan 350 " + " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}xq" for i in range(5000)), 0)],
)
def test_values(spark, field, value, want):
    got = canon.map_to_terms(spark.createDataFrame([(field, value)] * 2 + [(None, "x"), (field, None)], "field string, value string"), terms(spark)).collect()
    assert [(r["value"], r["termid"]) for r in got] == [(value, want)]


def test_values_against_all_pairs(spark, sf):
    """Whatever Jaccard alone would find among all pairs, the prefix join finds."""
    vals = table(spark, sf, "spectra").select(F.lit("instrument").alias("field"), F.col("instrument").alias("value")).where("value is not null").distinct()
    t = table(spark, sf, "canon_terms")
    got = {r["value"]: (r["termid"], round(r["similarity"], 6)) for r in canon.map_to_terms(vals, t).collect()}
    spelled = [(r["termid"], set(canon.tokens(r["field"], s)), set(canon.tokens(r["field"], a)), set(canon.tokens(r["field"], b))) for r in t.collect() if r["field"] == "instrument" for s, (a, b) in dict(canon.spellings(r["field"], r["term"], r["detail"])).items()]
    for v, (termid, sim) in got.items():
        x = set(canon.tokens("instrument", v))
        best = {}
        for k, y, a, b in spelled:
            j = len(x & y) / len(x | y)
            if j >= 0.45 and len(x & a) >= len(a) / 2 and len(x & b) >= len(b) / 2 and not {w for w in y if w[0] == "#"} - x:
                best[k] = max(j, best.get(k, 0))
        top = max(best.values(), default=0)
        winners = [k for k, j in best.items() if j >= top - 1e-9]
        assert (termid, sim) == ((winners[0] if len(winners) == 1 else 0), round(top, 6)), v


# --- nearest vectors -----------------------------------------------------------


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist(), "clash") for i, v in zip(ids or range(len(x)), x, strict=True)], "vid long, v array<float>, id string")


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k]}


def test_nearest_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.random((400, 32)) + 0.2
    x = np.concatenate([base, base + rng.normal(0, 0.02, base.shape)])
    got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(vectors(spark, x), "vid", "v", k=3, tables=12, block=128).collect()}
    want = brute(x, 1)
    assert len(want & got) / len(want) >= 0.9
    exact = {(r["id"], r["neighbour"]) for r in neighbours.nearest(vectors(spark, x[:300]), "vid", "v", k=4, tables=1, block=1000).collect()}
    assert len(exact & brute(x[:300], 4)) / 1200 >= 0.99


def test_nearest_of_far_vectors_is_exact(spark, monkeypatch):
    """Without a least similarity even far neighbours count: none is lost, whatever the buckets; repeated ids count once."""
    monkeypatch.setattr(neighbours, "PART", 400)
    x = np.random.default_rng(8).normal(size=(2000, 64)).astype(np.float32)
    df = vectors(spark, x)
    rows = neighbours.nearest(df.unionByName(df.limit(50)), "vid", "v", k=5, tables=16, block=16).collect()
    assert len(rows) == 10000 and {(r["id"], r["neighbour"]) for r in rows} == brute(x.astype(np.float64), 5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(r["similarity"] - u[r["id"]] @ u[r["neighbour"]]) < 1e-5 for r in rows)


def test_nearest_of_an_id_with_two_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [1.0, 0.5])], "vid long, v array<float>")
    got = [(r["id"], r["neighbour"]) for r in neighbours.nearest(df, "vid", "v", k=2).orderBy("id", "rank").collect()]
    assert got == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 2), (3, 1)]


def test_block_bounds_are_safe():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 20)).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(300)
    a, b = neighbours.best_in_block(ids, neighbours.quantise(u), ids, neighbours.quantise(u), 5, -1.0)
    assert len(set(zip(a.tolist(), b.tolist(), strict=True)) & brute(x, 5)) / 1500 >= 0.99


def test_nearest_hot_group(spark, monkeypatch):
    """A bucket with far more rows than a block: split, with nothing lost and ties to the smaller id."""
    monkeypatch.setattr(neighbours, "PART", 40)
    x = np.ones((200, 8)) + np.eye(200, 8) * 1e-9
    rows = neighbours.nearest(vectors(spark, x), "vid", "v", k=2, min_similarity=0.9, tables=1).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert len(got) == 200 and got[5] == [0, 1] and got[0] == [1, 2]


@pytest.mark.parametrize("least", [None, 0.9])
def test_nearest_among_copies(spark, least):
    """A third of all rows are copies of one vector; some ids have two vectors; all as if every pair were compared."""
    rng = np.random.default_rng(9)
    x = rng.random((60, 6)) + 1
    x[20:40] = x[5]
    x[50] = x[51]
    df = vectors(spark, x).unionByName(vectors(spark, x[[51, 30]]).withColumn("vid", F.col("vid") + 7))
    got = {}
    for r in neighbours.nearest(df, "vid", "v", k=3, min_similarity=least, tables=1).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    vs = {i: [x[i].astype(np.float32).astype(float)] for i in range(60)}
    vs[7].append(vs[51][0])
    vs[8].append(vs[30][0])
    cos = lambda i, j: round(max(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) for a in vs[i] for b in vs[j]), 12)
    for i in range(60):
        want = [j for c, j in sorted((-cos(i, j), j) for j in range(60) if j != i) if least is None or -c >= least][:3]
        assert [got[i][r] for r in sorted(got[i])] == want, i


def test_nearest_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vid long, v array<float>")
    assert {(r["id"], r["neighbour"]) for r in neighbours.nearest(df, "vid", "v").collect()} == {(1, 2), (2, 1)}
    assert neighbours.nearest(df.limit(0), "vid", "v").count() == 0


# --- garbled text ---------------------------------------------------------------


def test_garbled(spark):
    clean = ["método", "Größe", "außen", "pequeña", "région", "très", "prélevé"]
    rows = [(i, f"word {w} here") for i, w in enumerate(clean * 8)]
    bad = [encoding.garble(w, "utf-8", "cp1252") for w in clean] + [encoding.garble(encoding.garble("très", "utf-8", "latin-1"), "utf-8", "latin-1"), encoding.garble("Mérland", "utf-8", "cp1252"), "lo�st"]
    rows += [(1000 + i, f"word {w} here") for i, w in enumerate(bad)] + [(5000, None), (5001, ""), (5002, "plain"), (1000, f"word {bad[0]} here")]
    got = {r["k"]: (r["restored"], r["restorable"]) for r in encoding.find_garbled(spark.createDataFrame(rows, "k long, text string"), ["k"]).collect()}
    assert set(got) == {1000 + i for i in range(len(bad))}
    assert got[1000] == ("word método here", True) and got[1008][0] == "word Mérland here" and got[1009][1] is False
    assert encoding.find_garbled(spark.createDataFrame([], "k long, text string"), ["k"]).count() == 0


@pytest.mark.parametrize("second", ["cp1250", "koi8-r", "cp866"])
def test_garbled_twice_in_two_ways(spark, second):
    """Any second confusion is learned and undone, also in words that no twin shows."""
    clean = ["método", "Größe", "außen", "pequeña", "région", "très", "prélevé"]
    twice = lambda w: encoding.garble(encoding.garble(w, "utf-8", "cp1252"), "utf-8", second)
    assert encoding.explain("prélevé", twice("prélevé")).startswith("utf-8>cp1252|utf-8>")
    rows = [(i, f"word {w} here") for i, w in enumerate(clean * 8)] + [(1000 + i, f"word {twice(w)} here") for i, w in enumerate(clean)] + [(2000, f"see {twice('Mérland')} twice {twice('très')}")]
    got = {r["k"]: (r["restored"], r["restorable"]) for r in encoding.find_garbled(spark.createDataFrame(rows, "k long, text string"), ["k"]).collect()}
    assert got == {1000 + i: (f"word {w} here", True) for i, w in enumerate(clean)} | {2000: ("see Mérland twice très", True)}


def test_alignment():
    assert encoding.aligned("prélevé", "PrÃ©levÃ©") == [("é", "Ã©"), ("é", "Ã©")]
    assert encoding.aligned("prélevé", "prelevé") == [] and encoding.explain("é", "é") is None
    mender = encoding.Mender(["utf-8>cp1252"], frozenset("é"), mapped={"Ð¸Ð·": "из"})
    assert mender.mend("a Ð¸Ð· b") == (True, "a из b")


def test_garbled_signs_that_stand_alone(spark):
    clean = ["método", "Größe", "pequeña", "région", "très", "prélevé"]
    rows = [(i, f"word {w} here") for i, w in enumerate(clean * 8)] + [(100 + i, f"{i} – {i}, № {i}, 63–{i}") for i in range(8)]
    rows += [(1000 + i, f"word {encoding.garble(w, 'utf-8', 'cp1252')} here") for i, w in enumerate(clean)]
    rows += [(2000 + i, f"plain {encoding.garble(w, 'utf-8', 'cp1252')} end") for i, w in enumerate(["–", "63–150", "№"])] + [(3000, f"word {encoding.garble('très ‰', 'utf-8', 'cp1252')}"), (3001, "word \ufffd end")]
    got = {r["k"]: (r["restored"], r["restorable"]) for r in encoding.find_garbled(spark.createDataFrame(rows, "k long, text string"), ["k"]).collect()}
    assert {k: v for k, v in got.items() if k >= 2000} == {2000: ("plain – end", True), 2001: ("plain 63–150 end", True), 2002: ("plain № end", True), 3000: ("word très ‰", True), 3001: ("word \ufffd end", False)}
    mender = encoding.Mender(["utf-8>cp1252"], frozenset("éè"), frozenset("–"))
    assert not mender.whole("word " + encoding.garble("‰", "utf-8", "cp1252")) and mender.whole("très – clean")
    assert len(got) == 11


def test_lost_characters_told_by_a_clean_twin(spark):
    """Only where one frequent twin fits; each of several words of a text."""
    rows = [(i, f"word {w} here") for i, w in enumerate(["prélevé", "côte", "pâté", "pâtè"] * 8)]
    rows += [(100, "see pr\ufffdlev\ufffd, (c\ufffd\ufffdte)."), (101, "a p\ufffdt\ufffd"), (102, "a x\ufffdyz")]
    got = {r["k"]: (r["restored"], r["restorable"]) for r in encoding.find_garbled(spark.createDataFrame(rows, "k long, text string"), ["k"]).collect()}
    assert got == {100: ("see prélevé, (côte).", True), 101: ("a p\ufffdt\ufffd", False), 102: ("a x\ufffdyz", False)}


# --- leaks ------------------------------------------------------------------------


def test_leaks_against_all_spans(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    spans = {}
    for r in items.collect():
        for p in (r["passage"], r["question"]):
            w = leaks._WORD.findall(p.lower())
            for i in range(len(w) - 11):
                spans.setdefault(tuple(w[i : i + 12]), set()).add(r["item_id"])
    want = set()
    for r in docs.collect():
        w = leaks._WORD.findall((r["text"] or "").lower())
        for i in range(len(w) - 11):
            want |= {(r["doc_id"], k) for k in spans.get(tuple(w[i : i + 12]), ())}
    for held in (leaks.HELD_FINGERPRINTS, 0):
        got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, items, held=held).collect()}
        assert got == want and want


def test_leaks_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(1, text, None), (1, text, None), (2, "", "short one")], "item_id long, passage string, question string")
    docs = spark.createDataFrame([(7, "x " * 5000 + "-".join(text.upper().split()[5:17])), (8, " ".join(text.split()[:11])), (9, None), (None, text)], "doc_id long, text string")
    got = leaks.find_leaks(docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["n_words"]) for r in got] == [(7, 1, 12)]
    assert leaks.find_leaks(docs.limit(0), items).count() == 0 and leaks.find_leaks(docs, items.limit(0)).count() == 0


# --- mixing ----------------------------------------------------------------------


def test_mixture(spark):
    docs = spark.createDataFrame([(i, f"{'alpha' if i % 3 else 'beta'} text number {i} " * 5, ("a" if i % 3 else "b") if i % 10 else None, 1) for i in range(600)] + [(5, "dup", "a", 1), (None, "x", "a", 1), (9000, "", "a", 1), (9001, "x", "other", 1)], "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, targetshare double, maxrepeats int")
    m = mixing.mix(docs, targets).cache()
    assert m.select("doc_id").distinct().count() == m.count() == 600
    assert m.where("source = 'a' and copies > 1").count() == 0 and m.where("copies > 3").count() == 0
    got = {r["source"]: r["share"] for r in mixing.shares(m, targets).collect()}
    assert abs(got["a"] - 0.5) < 0.03 and abs(got["b"] - 0.5) < 0.03
    unsure = m.where("source is null").select((F.col("doc_id") % 3 == 0).alias("b"), F.get("member", F.lit(1)).alias("p")).collect()
    assert np.mean([(r["p"] > 0.5) == r["b"] for r in unsure]) > 0.9
    assert mixing.mix(docs, targets.limit(0)).count() == 0 and mixing.mix(docs.limit(0), targets).count() == 0


# --- reading levels ---------------------------------------------------------------


def test_levels_of_held_out_documents(spark, sf):
    d = sf.replace("0.001", "0.01")
    grades = table(spark, d, "level_labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = reading.reading_levels(table(spark, d, "documents"), grades.where(~held))
    true = grades.where(held).groupBy("doc_id").agg(F.avg("level").alias("g"))
    rows = got.join(true, "doc_id").collect()
    assert np.mean([abs(r["level"] - r["g"]) for r in rows]) < 0.7


def test_level_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Home | News | About"), (4, "Der Hund ist nicht in dem Haus und die Katze ist auf der Bank.")], "doc_id long, text string")
    grades = spark.createDataFrame([(1, 3)], "doc_id long, level int")
    assert reading.reading_levels(docs, grades).count() == 0
    assert reading.running_text("A title without end\nHome | News | About | Shop\nThis is a sentence of text.") == ["This is a sentence of text."]


def test_level_states_are_deleted(spark, sf, monkeypatch):
    """What each turn broadcasts leaves the disk with the turn, and the last state with the scores."""
    folder = Path(spark.sparkContext._temp_dir)

    def size():
        return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())

    sums, before, left = reading._sums, size(), []
    monkeypatch.setattr(reading, "_sums", lambda *a: (sums(*a), left.append(size() - before))[0])
    levels = reading.reading_levels(table(spark, sf, "documents"), table(spark, sf, "level_labels"))
    assert len(left) > 3 and set(left) == {0} and size() == before
    assert levels.count() > 0


# --- matching ---------------------------------------------------------------------


@pytest.mark.parametrize(("text", "want"), [("MZQ-443219", ("mzq", "443219", "")), ("471663KVE/C", ("kve", "471663", "c")), ("No. TRR/264327", ("trr", "264327", "")), ("KVR00740842", ("kvr", "740842", "")), ("SDE_977827_B", ("sde", "977827", "b")), ("kvs433390c", ("kvs", "433390", "c")), ("none", ("", "", "")), (None, ("", "", "")), ("WFE/911137(c)", ("wfe", "911137", "c"))])
def test_numbers(text, want):
    assert matching.number_parts(text) == want


def test_matching(spark):
    places = ["Veldhaven", "Tirmoor", "Skaneby", "Orlund", "Pelgrove", "Quinfell", "Brastead", "Yarholt", "Zondale", "Fenwick"]
    stones = ["granite", "basalt", "gypsum", "chert", "slate", "marble"]
    a = [(i, f"fresh pink {stones[i % 6]}", f"ABC-{100000 + i * 37}" if i % 4 else None, f"{places[i % 10]}{chr(97 + i // 10)}ton Quarry, Norvania") for i in range(60)]
    b = [(1000 + i, f"{stones[i % 6].upper()} (FRESH, PINK)", f"{100000 + i * 37}abc" if i % 4 else "", f"near {places[i % 10]}{chr(97 + i // 10)}ton") for i in range(60)]
    cols = "key long, name string, num string, origin string"
    m = matching.match(spark.createDataFrame([*a, (0, *a[0][1:]), (None, "x", None, None), (500, None, None, None)], cols), spark.createDataFrame(b, cols), "key", "name", "num", "origin")
    rows = m.collect()
    got = {(r["key_a"], r["key_b"]) for r in rows}
    want = {(i, 1000 + i) for i in range(60)}
    assert len(got & want) >= 54 and len(got - want) <= 3
    assert all(0 <= r["confidence"] <= 1 for r in rows)


def test_matches_do_not_depend_on_the_number_of_neighbours(spark):
    """A lot of 60 look-alikes in each catalogue, and misspelt places without a number: with one neighbour each, all are found."""
    cols = "key long, name string, num string, origin string"
    a = [(i, "fresh pink granite", f"ABC-{100000 + i * 37}", "Veldhaven Quarry, Norvania") for i in range(60)]
    b = [(1000 + i, "GRANITE (FRESH, PINK)", f"{100000 + i * 37}abc", "near Veldhaven") for i in range(60)]
    lone = ["Xarbelquist", "Ombrestrand", "Wuthergonel", "Pliskadrome"]
    a += [(200 + i, "fresh pink granite", f"DEF-{300000 + i}", f"{w} Quarry, Norvania") for i, w in enumerate(lone)]
    b += [(1200 + i, "granite, pink", None, f"{w[0]}{w[2]}{w[1]}{w[3:]}") for i, w in enumerate(lone)]
    m = matching.match(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), "key", "name", "num", "origin", neighbours=1, tables=2).cache()
    assert m.count() == m.select("key_a", "key_b").distinct().count()
    assert {(r["key_a"], r["key_b"]) for r in m.collect()} == {(i, 1000 + i) for i in [*range(60), *range(200, 204)]}


def test_matching_edges(spark):
    """Empty tables, nothing told, repeated rows, clashing column names; look-alikes without a number match none."""
    cols = "key long, name string, num string, origin string, side int, rec string"
    a = spark.createDataFrame([(1, "granite", "ABC-100", "Veld", 1, "x"), (2, None, "none", "", 0, "y"), (3, "slate", None, "Orlund", 0, ""), (4, "slate", "n/a", "Orlund", 0, "")], cols)
    b = spark.createDataFrame([(11, None, None, None, 1, "x"), (12, "slate", "", "Orlund", 1, "")], cols)
    names = ("key", "name", "num", "origin")
    assert matching.match(a.limit(0), b, *names).count() == 0
    assert matching.match(a, b.limit(0), *names).count() == 0
    assert matching.match(a.unionByName(a), b, *names).count() == 0
    assert matching.words(" Unknown ") == [] and matching.words("Gr\u00e8s, gr\u00e8s!") == ["gres"]
    assert matching.pieces("0:ab12") == ["0:ab12", "d:12", "v:1", "v:2"]


def test_matching_same_for_any_partitions(spark, sf):
    a, b = table(spark, sf, "samples"), table(spark, sf, "ecostress_samples")
    names = ("sampleid", "name", "samplenum", "origin")
    one = matching.match(a, b, *names).select("key_a", "key_b").toPandas()
    n = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        two = matching.match(a.repartition(5), b.repartition(2), *names).select("key_a", "key_b").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert set(map(tuple, one.to_numpy())) == set(map(tuple, two.to_numpy()))


def test_candidates_against_all_pairs(spark, sf):
    """Of the pairs of equal number and piece, which all pairs would show, the buckets show nine in ten or more."""
    pairs, _, records, _ = matching.compared(table(spark, sf, "samples"), table(spark, sf, "ecostress_samples"), "sampleid", "name", "samplenum", "origin", 6, 4, 64, 3, 2)
    side = lambda s: records.where(f"side = {s} and digits <> ''").select(F.col("rec").alias(f"rec_{'ab'[s]}"), "letters", "digits", "piece")
    equal = {tuple(r) for r in side(0).join(side(1), ["letters", "digits", "piece"]).select("rec_a", "rec_b").collect()}
    got = {tuple(r) for r in pairs.select("rec_a", "rec_b").collect()}
    assert len(equal & got) >= 0.9 * len(equal) > 0


def by_rows(group, steps, first, cosine, rounds=60):
    """The mixture fitted in memory to every row, nothing counted together; steps are (number, piece, origin, name)."""
    cells = np.stack([x.ravel() for x in np.indices((12, 3, 12, 12))], axis=1)
    flat = lambda s: ((s[:, 0] * 3 + s[:, 1]) * 12 + s[:, 2]) * 12 + s[:, 3]
    stratum = lambda s: np.where(s[:, 0] == 11, 0, np.where(s[:, 0] == 0, 1, np.where(s[:, 1] == 0, 2, 3)))
    views = ((lambda s: s[:, 0] * 3 + s[:, 1], 36), (lambda s: s[:, 2], 12), (lambda s: s[:, 3], 12))

    def share(view, weight):
        c = np.bincount(view[0](steps), weight, view[1]) + 0.05
        return (c / c.sum())[view[0](cells)]

    def other(view, weight):
        whole = np.bincount(view[0](steps), weight, view[1]) + 0.5
        c = np.array([np.bincount(view[0](steps)[k], weight[k], view[1]) for k in (stratum(steps) == z for z in range(4))]) + 5 * whole / whole.sum()
        return (c / c.sum(axis=1, keepdims=True))[stratum(cells), view[0](cells)]

    can = steps[:, 0] > 0
    post = np.where(first & can, np.where(cosine >= 0.8, 0.9, 0.5), 0.0)
    sure = (~first | ~can).astype(float)
    for _ in range(rounds):
        yes = np.prod([share(v, post) for v in views], axis=0) * post.sum()
        no = share(views[0], 1 - post) * other(views[1], sure) * other(views[2], sure) * (1 - post).sum()
        odds = np.where(cells[:, 0] > 0, np.log(yes / no), -50.0)
        e = np.where(can, np.exp(np.minimum(odds[flat(steps)], 50)), 0.0)
        post = e / (1 + np.bincount(group, e))[group]
    return odds


def test_mixture_is_fitted_to_all_records(spark):
    """Of 24,000 records none is left out: equal to a fit row by row, whatever keys they have, and by tasks as on the driver."""
    r, n = np.random.default_rng(5), 24_000
    same = np.tile([True, False, False], n) & np.repeat(r.random(n) < 0.7, 3)
    draw = lambda likely, usual: np.where(same, r.choice(12, 3 * n, p=likely), r.choice(12, 3 * n, p=usual))
    towards = lambda k: (p := 0.6 ** abs(np.arange(12) - k)) / p.sum()
    number, origin, name = draw(towards(10), towards(1)), draw(towards(8), towards(3)), draw(towards(7), towards(4))
    piece = np.where(number == 11, 2, r.integers(0, 2, 3 * n) | same)
    cosine = np.round((number + origin + name) % 12 / 12 + r.random(3 * n) / 20, 4)
    rows = pd.DataFrame({"rec_a": np.tile([1, 2, 3], n), "rec_b": np.repeat(np.arange(n), 3), "cosine": cosine, "s_number": number, "s_piece": piece, "s_origin": origin, "s_name": name})
    got = matching._fitted(spark.createDataFrame(rows))
    first = np.zeros(3 * n, bool)
    first[np.arange(n) * 3 + cosine.astype(np.float32).reshape(n, 3).argmax(axis=1)] = True
    want = by_rows(rows["rec_b"].to_numpy(), np.stack([number, piece, origin, name], axis=1), first, cosine.astype(np.float32))
    assert np.allclose(got, want, atol=1e-3)
    moved = spark.createDataFrame(rows.assign(rec_b=rows["rec_b"] * 7 + 10**6)).repartition(3)
    assert np.array_equal(matching._fitted(moved, 0), got)


def test_queries_have_columns(spark, sf):
    want = {"p3_found": ["tab", "recordid", "field", "termid"], "p4_found": ["spectrumid_a", "spectrumid_b"], "p6_found": ["tab", "sampleid", "field"], "p7_found": ["item_id", "doc_id"], "p9_found": ["doc_id"]}
    for name, cols in want.items():
        df = queries.QUERIES[name](spark, sf)
        assert df.columns == cols and df.count() == df.distinct().count()
