"""What is learnt comes from all documents of a corpus, also the long ones."""

import random

import numpy as np

from newsgrain.llm import personal
from newsgrain.llm.given_names import corpus_given_names, learnt_given_names
from newsgrain.llm.grid_clusters import group_pairs, occurrence_groups
from newsgrain.llm.personal import personal_data, redacted, train_names

FIRST, STEMS, ENDS = ["Belzuna", "Corvadin", "Telmira"], ["Pop", "Mor", "Ciul", "Bur", "Vran", "Lup", "Tal", "Dor"], ["escu", "eanu", "aru"]


def lessons(n, fill=0):
    """Documents that teach given names no list holds, with so many words of filling."""
    rng = random.Random(5)
    names = [f"{rng.choice(FIRST)} {rng.choice(STEMS)}{rng.choice(ENDS)}" for _ in range(n)]
    return [f"Luni, ministrul {x} a spus. Compania Nordică {rng.choice(['Olveiș', 'Mureza'])} a cerut bani. „Nu”, a zis {x}." + " apoi" * fill for x in names]


def test_corpus_names_equal_those_of_a_list(spark):
    texts = lessons(120)
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate([*texts, None, "", "fără nume"])], "id long, text string, word string").repartition(5)
    want = learnt_given_names(texts, frozenset())
    assert corpus_given_names(df, "text", str, frozenset()) == want == {"belzuna", "corvadin", "telmira"}
    assert corpus_given_names(df.where("id > 120"), "text", str, frozenset({"ana"})) == {"ana"}


def test_occurrences_learn_names_from_long_documents(spark):
    told = ["Belzuna Vranescu", "Vranescu Belzuna"]
    rows = [(i, f"{told[i % 2]} a vorbit în Tigmara. Apoi {told[i % 2]} a plecat din Tigmara.") for i in range(6)]
    rows += [(100 + i, t) for i, t in enumerate(lessons(60, 4_100))]
    assert min(len(t) for _, t in rows[6:]) > 20_000
    pairs = group_pairs(occurrence_groups(spark.createDataFrame(rows, "id long, document string").repartition(3), "id", "document")).collect()
    assert {tuple(r) for r in pairs} == {(a, b) for a in range(6) for b in range(a + 1, 6)}


def test_field_learns_from_long_documents(spark):
    rows = [(100 + i, t) for i, t in enumerate(lessons(60, 4_100))] + [(1, "Ieri, ministrul Belzuna Vranescu a plecat."), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {tuple(r) for r in personal_data(docs).where("id < 100").collect()}
    assert found == {(1, "name", "Belzuna Vranescu")}
    assert redacted(docs).where("doc_id = 1").first()["redacted"] == "Ieri, ministrul [NAME] a plecat."


def test_field_of_a_table_equals_that_of_a_list(spark):
    texts = lessons(90)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    # the order in which every third text is one whose hash is a multiple of three
    low = {r["doc_id"]: r["low"] for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id), 3) = 0 AS low").collect()}
    kept = [i for i in low if low[i]][:20]
    other = [i for i in low if not low[i]][: 2 * len(kept)]
    order = [i for k, x in enumerate(kept) for i in (x, other[2 * k], other[2 * k + 1])]
    want = train_names([texts[i] for i in order])
    got = personal._model(df.where(f"doc_id in ({','.join(map(str, order))})"), "doc_id", "text")
    assert got.given == want.given and len(order) == 60
    assert np.abs(got.weights - want.weights).max() < 1e-3 and np.abs(want.weights).max() > 0.1
    assert all(np.abs(a - b).max() < 1e-3 for a, b in zip(got.potentials, want.potentials))
