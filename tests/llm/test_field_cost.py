"""What makes the field cheaper changes nothing that it learns or finds."""

import gc

import numpy as np

from newsgrain.llm import personal
from newsgrain.llm.arrowio import caches_kept
from newsgrain.llm.skip_chain import LABELS, Graph, Model, gradient, graph_of

LEX = personal.lexicon(frozenset({"elena", "ana"}))


def test_equal_runs_share_their_rows():
    batch = personal.Batch(["Elena Popescu a venit. Elena Popescu a plecat.", "Apoi Elena Popescu."], LEX)
    assert len(batch.rows) == 7 and len(batch.features) == 5
    assert batch.rows[:4].tolist() == [0, 1, 0, 1] and [e.tolist() for e in batch.edges[:2]] == [[[0, 1], [2, 3], [4, 5], [5, 6]], [[0, 2], [1, 3]]]
    assert batch.names(np.array([1, 2, 1, 2, 0, 1, 2]), LEX) == [(0, 0, 13), (0, 23, 36), (1, 5, 18)]


def test_gradient_of_shared_rows_equals_that_of_nodes():
    rng = np.random.default_rng(3)
    features, rows, labels = rng.integers(0, 50, (4, 6)), rng.integers(0, 4, 30), rng.integers(0, LABELS, 30)
    edges = [np.stack((np.arange(0, 29, k), np.arange(1, 30, k)), axis=1) for k in (1, 3, 5)]
    model = Model(rng.normal(size=(1 << 16, LABELS)), [rng.normal(size=(LABELS, LABELS)) for _ in range(3)])
    shared, apart = graph_of(features, rows, labels, edges), graph_of(features[rows], np.arange(30), labels, edges)
    for joint in (False, True):
        assert all(np.abs(a - b).max() < 1e-4 for a, b in zip(gradient(model, shared, joint), gradient(model, apart, joint)))
    # the regression needs no nodes
    bare = Graph(shared.features, shared.told, np.empty(0, np.int64), [], shared.pairs)
    assert np.array_equal(gradient(model, bare, False)[0], gradient(model, shared, False)[0])
    packed = [memoryview(x) for x in personal._packed(shared)]
    again = personal._unpacked(*packed)
    assert all(np.array_equal(a, b) for a, b in zip((again.features, again.told, again.rows, *again.edges, *again.pairs), (features, shared.told, rows, *edges, *shared.pairs)))


def test_pieces_show_what_a_text_holds():
    texts = ["vorbit cu ana  popescu", "ana\npopescu", "dl ana-ana ion, „ana” x", "scris:ana/ana vasile ana", "popescu ana", ""]
    want = [["cu ana"], ["ana"], ["dl ana-ana ion", "ana"], ["ana", "ana vasile ana"], ["popescu ana"], []]
    assert [[t[a:b] for a, b in LEX.unmarked(t, [])] for t in texts] == want
    t = "Strada Lungă nr. 5. Tel. (0709) 34 73 50, a@b.example, seria ZW nr 648779"
    assert sorted(kind for _, _, kind in personal.written_forms(t)) == ["address", "email", "id_number", "phone"]
    assert personal.written_forms(t, [LEX.bits[x] for x in t.split(" ")]) == personal.written_forms(t)


def test_caches_are_not_looked_through():
    before = gc.get_freeze_count()
    with caches_kept():
        assert not gc.isenabled()
        cache = [[k] for k in range(1000)]
    assert gc.isenabled() and gc.get_freeze_count() >= before + len(cache)
    gc.unfreeze()
