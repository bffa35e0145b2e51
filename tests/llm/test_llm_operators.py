import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgrain.llm.encode import decode_corpus, encode_corpus
from newsgrain.llm.fold import word_strings
from newsgrain.llm.grid_clusters import group_pairs, group_report, occurrence_groups, spread_labels
from newsgrain.llm.leaks import leaked_spans, leaks
from newsgrain.llm.lookalike import look_classes, look_pairs, one_form
from newsgrain.llm.near_dups import classes, near_duplicates, row_pairs
from newsgrain.llm.permutation_index import nearest, similar_pairs
from newsgrain.llm.personal import personal_data, redacted, train_names
from newsgrain.llm.ranking import combined_ranking, weighting_report
from newsgrain.llm.site_lines import confirmed_set, marked_lines, remove_lines, repeated_lines

WORDS = "alfa beta gama delta epsilon zeta eta teta iota capa lambda miu niu csi omicron pi ro sigma tau ipsilon".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


# --- repeated lines ---------------------------------------------------------------------------------------------------


def lines_df(spark):
    wide = "Toate drepturile rezervate acestui site"
    rows = [(i, f"Titlu {i}\n{wide if i % 2 else wide.upper() + '!'}\n\nrând propriu numărul {text(random.Random(i), 4)}", "a.md", i, 1) for i in range(6)]
    rows += [(100 + i, f"{wide}\nscurt\nscurt", "b.md", 0, 1) for i in range(4)]
    rows += [(200, None, "a.md", 0, 1), (201, "", "a.md", 0, 1), (202, wide, None, 0, 1), (203, f"{wide}\n{wide}", "a.md", 0, 1)]
    return spark.createDataFrame(rows, "row_idx long, document string, source_domain string, line long, n long")


@pytest.mark.parametrize("counters", [4096, 1])
def test_lines_exact_with_any_number_of_counters(spark, counters):
    got = {tuple(r) for r in marked_lines(lines_df(spark), counters=counters).collect()}
    assert got == {(i, 1) for i in range(6)} | {(203, 0), (203, 1)}


def test_lines_removed(spark):
    out = {r["row_idx"]: r["bare_text"] for r in remove_lines(lines_df(spark)).collect()}
    assert out[0].split("\n")[:2] == ["Titlu 0", ""] and out[100].startswith("Toate") and out[200] is None and out[203] == ""


def test_lines_of_nothing(spark):
    assert marked_lines(lines_df(spark).where("false")).count() == 0


# --- near duplicates --------------------------------------------------------------------------------------------------


def shingles(t, n):
    w = word_strings([t])[0]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_rows():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base = text(rng, 60)
        rows.append((len(rows), base))
        if i % 3 == 0:
            w = base.split()
            w[rng.randrange(60)] = "schimbat"
            rows.append((len(rows), " ".join(w).upper()))
        if i % 5 == 0:
            rows.append((len(rows), base + "!"))
    rows += [(1000, None), (1001, ""), (1002, "   "), (1003, "unu doi"), (1004, text(rng, 20_000))]
    return rows


@pytest.mark.parametrize("run,threshold", [(3, 0.5), (5, 0.8)])
def test_near_duplicates_equal_brute_force(spark, run, threshold):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "k", 1.0) for i, t in rows], "id long, text string, key string, jaccard double").repartition(3)
    pairs, members = near_duplicates(df, "id", "text", run=run, threshold=threshold)
    got = [tuple(r) for r in row_pairs(pairs, members).collect()]
    sets = {i: shingles(t or "", run) for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    from newsgrain.llm import near_dups

    rng = random.Random(1)
    base = text(rng, 80).split()
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in ((i, rng.randrange(80)) for i in range(40))]
    df = spark.createDataFrame(rows, "id long, text string")
    whole = {tuple(r) for r in row_pairs(*near_duplicates(df, "id", "text", 3, 0.5)).collect()}
    monkeypatch.setattr(near_dups, "HOT_KEY", 10)
    assert {tuple(r) for r in row_pairs(*near_duplicates(df, "id", "text", 3, 0.5)).collect()} == whole and len(whole) == 780


def test_copies_form_one_class(spark):
    t = text(random.Random(0), 30)
    df = spark.createDataFrame([(i, t) for i in (5, 3, 9, 9)], "id long, text string")
    pairs, members = near_duplicates(df, "id", "text")
    assert pairs.count() == 0 and {tuple(r) for r in members.collect()} == {(3, 3), (3, 5), (3, 9)}
    assert {tuple(r) for r in row_pairs(pairs, members).collect()} == {(3, 5), (3, 9), (5, 9)}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert row_pairs(*near_duplicates(df, "id", "text")).count() == 0


# --- look-alikes ------------------------------------------------------------------------------------------------------


def test_one_form(spark):
    same = ["Știri – fină", "Știri ‑ ﬁnă", "Ştiri - fină", "Știri\xa0– fi​nă", "Ştіri - ｆіnă"]
    other = ["Stiri - fină", "știri - fină", "Știri - fină.", "Știri  - fină"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(same + other)] + [(50, None, ""), (51, "", "​"), (52, " ", "\xa0")], "id long, t string, l string")
    out = {r["id"]: r["t_look"] for r in one_form(df, ["t"]).collect()}
    assert len({out[i] for i in range(5)}) == 1 and len(set(out[i] for i in range(9))) == 5 and out[50] is None and out[51] == ""
    pairs = [tuple(r) for r in look_pairs(df, "id", ["t", "l"]).collect()]
    assert sorted(pairs) == [("t", a, b) for a in range(5) for b in range(a + 1, 5)]


def test_equal_strings_are_no_pair(spark):
    df = spark.createDataFrame([(1, "aă"), (2, "aă"), (3, "aă"), (3, "aă")], "id long, t string")
    assert sorted(map(tuple, look_pairs(df, "id", ["t"]).collect())) == [("t", 1, 3), ("t", 2, 3)]
    assert look_pairs(df.where("false"), "id", ["t"]).count() == 0


def test_large_classes_are_divided_without_loss(spark, monkeypatch):
    from newsgrain.llm import blocks

    rng = random.Random(4)
    forms = ["Știri – fină", "Știri ‑ fină", "Ştiri - fină"]
    df = spark.createDataFrame([(i, forms[rng.randrange(3)] if i < 60 else f"alt {i % 4}", 1) for i in range(80)], "id long, t string, value int")
    whole = sorted(map(tuple, look_pairs(df, "id", ["t"]).collect()))
    rows = {r["id"]: r["t"] for r in df.collect()}
    assert whole == sorted(("t", a, b) for a in range(60) for b in range(a + 1, 60) if rows[a] != rows[b])
    groups = df.select((F.col("id") % 3).alias("grp"), "id")
    pairs = sorted(map(tuple, group_pairs(groups).collect()))
    assert pairs == sorted((a, b) for a in range(80) for b in range(a + 1, 80) if a % 3 == b % 3)
    monkeypatch.setattr(blocks, "BLOCK", 5)
    assert sorted(map(tuple, look_pairs(df, "id", ["t"]).collect())) == whole
    assert sorted(map(tuple, group_pairs(groups).collect())) == pairs


def test_classes_count_links(spark):
    t = text(random.Random(0), 30)
    df = spark.createDataFrame([(1, t), (2, t), (5, t + " plus"), (7, "cu totul altceva aici")], "id long, text string")
    got = {tuple(r) for r in classes(*near_duplicates(df, "id", "text", 3, 0.5)).collect()}
    assert got == {(1, 1, 2, 1), (2, 1, 2, 1), (5, 5, 1, 1)}
    look = spark.createDataFrame([(1, "a\u0103"), (2, "aa\u0306"), (3, "a\u0103"), (4, "b")], "id long, t string")
    assert {tuple(r) for r in look_classes(look, "id", ["t"]).collect()} == {("t", 1, 1, 3, 1), ("t", 2, 1, 3, 2), ("t", 3, 1, 3, 1)}


def test_weightings_compared(spark):
    df = spark.createDataFrame([(i, float(i), float(-i) if i % 7 else None, 1.0) for i in range(100)], "id long, x double, y double, one double")
    rows = {r["score"]: r for r in weighting_report(df, "id", ["x", "y", "one"]).collect()}
    assert sum(r["turned"] for r in rows.values()) == 1 and rows["one"]["loading"] == 0 and -1 <= rows["x"]["rank_correlation"] <= 1


# --- ranking ----------------------------------------------------------------------------------------------------------


def test_ranking_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    n = 200
    a, b = np.round(rng.exponential(3, n)), rng.normal(size=n)
    a[:20] = np.nan
    rows = [(i, None if i % 17 == 0 else float(a[i]), float(b[i] + (a[i] if a[i] == a[i] else 0)), 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x double, y double, one double").repartition(5)
    low = lambda v: -np.inf if v is None or v != v else v
    cols = [[low(r[k]) for r in rows] for k in (1, 2)]
    stand = np.array([[sum(o < v for o in c) / n for v in c] for c in cols]).T
    out = {r["id"]: r for r in combined_ranking(df, "id", ["x", "y"], weights="equal").collect()}
    assert np.allclose([[out[i]["x_standing"], out[i]["y_standing"]] for i in range(n)], stand)
    order = sorted(range(n), key=lambda i: (-stand[i].mean(), i))
    assert [out[i]["place"] for i in order] == list(range(1, n + 1))
    pc = {r["id"]: r["projection"] for r in combined_ranking(df, "id", ["x", "y", "one"], [1, 1, 1]).collect()}
    z = (stand - stand.mean(axis=0)) / stand.std(axis=0)
    v = np.linalg.eigh(np.corrcoef(stand.T))[1][:, -1]
    assert np.allclose([pc[i] for i in range(n)], z @ np.abs(v), atol=1e-9)
    assert combined_ranking(df.where("false"), "id", ["x", "y"]).count() == 0


# --- vectors ----------------------------------------------------------------------------------------------------------


def vector_rows(seed=0, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * 0.35
    x *= rng.uniform(0.5, 4, (n, 1))
    return x.astype(np.float32)


def brute_neighbours(x, k, least):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 7)
    np.fill_diagonal(s, -2)
    return {i: [int(j) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k] if s[i, j] >= least] for i in range(len(x))}


def test_nearest_recall(spark):
    x = vector_rows()
    df = spark.createDataFrame([("g", i, v.tolist(), 0.5) for i, v in enumerate(x)] + [("g", 900, None, 0.0), ("g", 901, [0.0] * 16, 0.0), ("g", 902, [1.0, 2.0], 0.0), (None, 903, x[0].tolist(), 0.0)], "g string, id long, v array<float>, cos double").repartition(3)
    out = nearest(df, "id", "v", "g", k=5, least=0.8, dim=16).collect()
    want = brute_neighbours(x, 5, 0.8)
    got = {i: [] for i in want}
    for r in sorted(out, key=lambda r: r["place"]):
        got[r["id"]].append(r["neighbour"])
    hit = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hit >= 0.97 * sum(map(len, want.values())) and sum(map(len, want.values())) > 400


def test_hot_files_are_split_without_loss(spark, monkeypatch):
    from newsgrain.llm import permutation_index

    x = vector_rows(2)
    df = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "g string, id long, v array<float>")
    whole = {tuple(r) for r in similar_pairs(df, "id", "v", "g", dim=16).collect()}
    monkeypatch.setattr(permutation_index, "HOT_FILE", 30)
    assert {tuple(r) for r in similar_pairs(df, "id", "v", "g", dim=16).collect()} == whole and whole


def test_large_groups_are_divided_into_regions(spark, monkeypatch):
    from newsgrain.llm import permutation_index

    x = vector_rows(4)
    df = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "g string, id long, v array<float>")
    monkeypatch.setattr(permutation_index, "REGION_ROWS", 200)
    monkeypatch.setattr(permutation_index, "CHUNK_ROWS", 50)
    got = {}
    for r in nearest(df, "id", "v", "g", k=5, least=0.8, dim=16).collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    want = brute_neighbours(x, 5, 0.8)
    assert sum(len(set(got.get(i, [])) & set(want[i])) for i in want) >= 0.95 * sum(map(len, want.values()))
    assert all(len(v) == len(set(v)) for v in got.values())


def test_copies_and_ties_go_to_smaller_ids(spark):
    x = vector_rows(1, 60)
    rows = [("g", i, v.tolist()) for i, v in enumerate(x)] + [("g", 100 + i, (x[7] * (1 + i)).tolist()) for i in range(30)] + [("g", 100, x[7].tolist())]
    out = nearest(spark.createDataFrame(rows, "g string, id long, v array<float>"), "id", "v", "g", k=10, least=0.85, dim=16).collect()
    of = {}
    for r in sorted(out, key=lambda r: r["place"]):
        of.setdefault(r["id"], []).append(r["neighbour"])
    assert of[120] == [7, *range(100, 109)] and of[7] == list(range(100, 110)) and of[100] == [7, *range(101, 110)]


def test_nearest_of_little(spark):
    df = spark.createDataFrame([], "g string, id long, v array<float>")
    assert nearest(df, "id", "v", "g", dim=2).count() == 0
    one = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 2, [2.0, 0.0])], "g string, id long, v array<float>")
    assert {(r["id"], r["neighbour"]) for r in nearest(one, "id", "v", "g", dim=2).collect()} == {(1, 2), (2, 1)}


# --- occurrences ------------------------------------------------------------------------------------------------------


def article(rng, place, body, person):
    s = [f"În {place}, votul a costat {rng.randrange(900)} lei.", f"{body} a cerut bani aproape de {place}.", f"Ieri, {person} a vorbit la {place}.", f"Potrivit surselor, {body} a refuzat.", f"„Nu”, a zis {person}, primarul din {place}."]
    return " ".join(rng.choice(s) for _ in range(8))


def test_occurrences(spark):
    rng = random.Random(0)
    events = [("Belveaia", "Compania Nordică Olveiș", "Elena Popescu"), ("Belveaia", "Regia Civică Molcăuța", "Radu Moraru"), ("Tigmara", "Alianța Verde Corbeni", "Maria Lupu"), ("Rarita", "Uniunea Nouă Zavoaia", "Tudor Burlacu")]
    rows = [(100 * k + i, article(rng, *e), 0.1 * i, "x") for k, e in enumerate(events) for i in range(12 if k < 3 else 3)]
    rows += [(900, None, 1.0, "x"), (901, "", 1.0, "x"), (902, "fără nume", None, "x"), (903, "În Tigmara plouă.", 1.0, "x")]
    df = spark.createDataFrame(rows, "id long, document string, strength double, cell string").repartition(3)
    groups = occurrence_groups(df, "id", "document")
    pairs = {tuple(r) for r in group_pairs(groups).collect()}
    true = {(a, b) for k in range(3) for a, b in itertools.combinations(range(100 * k, 100 * k + 12), 2)}
    assert pairs <= true and len(pairs) >= 0.8 * len(true)
    report = group_report(groups, df.select("id", "strength")).collect()
    assert len(report) == 3 and all(r["size"] >= 5 and len(r["typical"]) == 3 for r in report)
    assert occurrence_groups(df.where("false"), "id", "document").count() == 0


def test_labels_reach_the_end_of_a_chain(spark):
    n = 40
    nodes = spark.range(n + 3).select(F.col("id").alias("node"))
    e = [(i, i + 1) for i in range(n - 1)]
    edges = spark.createDataFrame(e + [(b, a) for a, b in e], "a long, b long")
    out = dict(map(tuple, spread_labels(nodes, edges).collect()))
    assert all(out[i] == 0 for i in range(n)) and all(out[i] == i for i in range(n, n + 3))


# --- tokens, leaks, personal data -------------------------------------------------------------------------------------


def test_encode_round_trip(spark):
    texts = [None, "", " ", "În casă, 12'll", text(random.Random(0), 30_000), "În casă, 12'll"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    ids = encode_corpus(df)
    out = {r["id"]: r["ids"] for r in ids.collect()}
    assert out[0] == out[1] == [] and out[3] == out[5]
    back = {r["id"]: r["text"] for r in decode_corpus(ids).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encode_corpus(df.where("false")).count() == 0


def test_leaks_equal_brute_force(spark, monkeypatch):
    from newsgrain.llm import leaks as module

    rng = random.Random(5)
    items = [(i, text(rng, 25)) for i in range(8)] + [(8, items_short := "prea scurt"), (9, None), (10, "")]
    assert items_short
    docs = []
    for i in range(80):
        w = text(rng, 30).split()
        if i % 3 == 0:
            source = items[rng.randrange(8)][1].split()
            n = rng.choice([9, 11, 12, 13, 25])
            at = rng.randrange(len(source) - n + 1)
            w[5:5] = source[at : at + n]
        docs.append((i, " ".join(w).upper().replace(" ", "\n", 3)))
    docs += [(500, None), (501, ""), (502, items[0][1]), (503, items[0][1])]
    want = set()
    for d, t in docs:
        for it, s in items:
            if s and t and shingles(t, 12) & shingles(s, 12):
                want.add((d, it))
    df, it = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item long"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in leaks(df, it).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    monkeypatch.setattr(module, "ITEM_BLOCK", 3)
    assert {tuple(r) for r in leaks(df, it).collect()} == want
    spans = {(r["doc"], r["item"]): r["n_words"] for r in leaked_spans(df, it).collect()}
    assert spans[(502, 0)] == 25
    assert leaks(df.where("false"), it).count() == 0 and leaks(df, it.where("false")).count() == 0


def test_personal_data_and_redaction(spark):
    model = train_names([f"Ieri, ministrul {g} {f} a vorbit. În Belveaia, {g} {f} a tăcut. Compania Nordică Olveiș a plecat." for g in ("Elena", "Radu", "Maria") for f in ("Popescu", "Moraru", "Stanceanu")] * 5)
    docs = spark.createDataFrame([(1, "Ana Popescu, tel. 0709350198, x@y.example și x@y.example.", "z"), (2, None, "z"), (3, "", "z"), (4, "Nimic aici.", "z")], "doc_id long, text string, kind string")
    assert {tuple(r) for r in personal_data(docs, model=model).collect()} == {(1, "name", "Ana Popescu"), (1, "phone", "0709350198"), (1, "email", "x@y.example")}
    out = {r["doc_id"]: r["redacted"] for r in redacted(docs, model=model).collect()}
    assert out == {1: "[NAME], tel. [PHONE], [EMAIL] și [EMAIL].", 2: None, 3: "", 4: "Nimic aici."}
    assert personal_data(docs.where("false")).count() == 0


def test_confirmed_set_is_sorted(spark):
    _, confirmed = repeated_lines(lines_df(spark))
    lines = confirmed_set(confirmed).value
    assert (np.diff(lines.astype(np.float64)) >= 0).all() and len(lines) == 1
