"""Training-data kernels without Spark."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.llm import abuse, lookalikes, mixing, neardup, neighbours, packing, scanned, shingles, splitting, tokens

texts = st.text(alphabet=st.sampled_from("ab é語😀.!? \n\t'59́"), max_size=300)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200) | texts)
def test_tokens_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = tokens.encode(text)
    assert tokens.decode(ids) == text
    # Cutting a long text at safe places changes nothing.
    assert tokens.encode(text, size=7) == ids


def test_tokens_of_nothing_and_of_long_words():
    assert tokens.encode(None) == tokens.encode("") == [] and tokens.decode(None) == ""
    long = "word " * 30_000 + "x" * 5000 + " don't 12a \n\n end"
    assert tokens.encode(long, size=1000) == tokens.encode(long, size=1 << 30)


@settings(max_examples=80, deadline=None)
@given(texts, st.integers(0, 12), st.integers(-1, 12))
def test_pieces_are_within_the_limit_and_cover_the_text(text, limit, overlap):
    rows = splitting.pieces(text, 10, limit, overlap)
    data = text.encode()
    most = max(limit, 1)
    assert all(r[4] <= most and data[r[2] - 10 : r[3] - 10].decode() == r[1] for r in rows)
    if text:
        assert rows[0][2] == 10 and rows[-1][3] == 10 + len(data)
        assert all(b[2] <= a[3] < b[3] for a, b in zip(rows, rows[1:]))
        assert len(rows) == 1 or max(overlap, 0) == 0 or all(len(data[b[2] - 10 : a[3] - 10].decode()) <= 4 * overlap for a, b in zip(rows, rows[1:]))


def test_pieces_end_at_natural_places():
    text = "One sentence here. " * 20 + "\n\n" + "Another one there. " * 20
    rows = splitting.pieces(text, None, 100, 0)
    assert all(r[1].rstrip().endswith(".") for r in rows) and any(r[1].endswith("\n\n") for r in rows)
    assert rows[0][2] is None and splitting.pieces(None, 0, 9, 1) == []


def brute_filling(hist, room):
    sums = {0}
    for x, n in hist.items():
        sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= room}
    return max(sums)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 5), max_size=6), st.integers(20, 40))
def test_fillings(hist, room):
    best = packing.best_filling(hist, room)
    assert sum(x * n for x, n in best.items()) == brute_filling(hist, room)
    assert all(n <= hist[x] for x, n in best.items())
    used = {}
    for f in packing.plan_fillings(hist, room):
        assert sum(x * n for x, n in f.counts.items()) <= room
        for x, n in f.counts.items():
            used[x] = used.get(x, 0) + n * f.times
    assert used == hist


def test_fillings_leave_little_room():
    rng = random.Random(1)
    hist = {}
    for _ in range(5000):
        x = min(1024, int(rng.lognormvariate(5, 1)) + 1)
        hist[x] = hist.get(x, 0) + 1
    bins = sum(f.times for f in packing.plan_fillings(hist, 1024))
    assert bins <= -(-sum(x * n for x, n in hist.items()) // 1024) + 2
    with pytest.raises(ValueError):
        packing.plan_fillings({0: 1}, 5)


def test_raking_meets_the_weights():
    cells = [(mixing.Cell(s, g, t), n) for s, g, t, n in [("a", "en", "x", 900), ("a", "fr", "y", 100), ("b", "en", "y", 50), ("b", "de", "x", 10), ("c", "en", "x", 0)]]
    expected, size = mixing.rake(cells, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 3, "c": 9})
    got = {s: sum(expected[c] * n for c, n in cells if c.source == s and c in expected) for s in "ab"}
    assert got["a"] / size == pytest.approx(5 / 9) and got["b"] / size == pytest.approx(4 / 9)
    assert all(0 <= e <= {"a": 1, "b": 3}[c.source] + 1e-9 for c, e in expected.items())
    assert mixing.rake([], {"a": 1.0}, {"a": 1}) == ({}, 0.0)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_shingles_are_word_triples():
    def brute(text):
        words = __import__("regex").findall(r"[\p{L}\p{N}]+", text.lower())
        return {tuple(words[k : k + 3]) for k in range(len(words) - 2)}

    base = "The Quick brown-fox, jumps над ленивой 漢字 dog 12.5 times; again the quick brown fox"
    sets = list(shingles.shingle_sets_of([base, None, "", "one two", base.upper(), base + " more words"], 3))
    assert [len(s) for s in sets] == [len(brute(base)), 0, 0, 0, len(brute(base)), len(brute(base + " more words"))]
    assert set(sets[0]) == set(sets[4])
    long = " ".join(f"w{k % 1000}" for k in range(300_000))
    assert len(next(shingles.shingle_sets_of([long], 3))) == 1000


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    close = []
    for _ in range(200):
        u = shingles.mix64(rng.integers(0, 1 << 62, 160, dtype=np.uint64))
        close.append((neardup.signature(u[:130]) == neardup.signature(u[30:])).mean())
    assert np.mean(close) == pytest.approx(100 / 160, abs=0.02)


def test_top_edges():
    row, v, s = np.array([1, 0, 0, 0, 1]), np.array([5, 1, 2, 1, 5]), np.array([0.1, 0.5, 0.9, 0.7, 0.3], dtype=np.float32)
    assert neighbours.top_edges(row, v, s, 1).tolist() == [2, 4]
    assert neighbours.top_edges(row, v, s, 9).tolist() == [2, 3, 4]


canon = lookalikes.Canon({})


@pytest.mark.parametrize(
    "text, want",
    [
        ("Ｃｒеdit", "Credit"), ("th​e", "the"), ("a b", "a b"), ("résumé", "résumé"), ("аnd the", "and the"), ("Ⅳ", "IV"), ("ﬁnal", "final"), ("co­op", "coop"),
    ],
)
def test_look_alikes_are_put_right(text, want):
    assert canon.text(text) == (want, True)


@pytest.mark.parametrize(
    "text",
    ["", "plain", "Привет и с", "中文，好。", "می‌شود", "\U0001f469‍\U0001f4bb", "broken­\nline", "café — “x” …", "oui : non"],
)
def test_proper_text_stays(text):
    assert canon.text(text) == (unicodedata.normalize("NFC", text), False)


def test_words_get_their_context_from_the_page():
    page = ["the", "а", "ledger", "дом", "а", "мир", None, ""]
    assert dict(canon.words(page)) == {1: "a"}


def test_classes_are_transitive():
    sets = lookalikes.UnionFind()
    for a, b in ("ab", "cd", "bc"):
        sets.union(a, b)
    assert sets.classes() == {"a": ["a", "b", "c", "d"]}


@pytest.mark.parametrize("printed, read", [("committee", "commiftec"), ("malformed", "rnalforrnecl"), ("investment", "lnvestmcnt"), ("clause", "dause"), ("réserve", "r6serve"), ("preliminary", "prclimmary"), ("mobility", "mobihty"), ("follows", "follovvs"), ("depositario", "(lepositario")])
def test_glyph_edits(printed, read):
    if read != "dause":
        assert scanned.edits_between(printed, read) is not None
    assert set(scanned.fold_keys(printed)) & set(scanned.fold_keys(read))


def test_numbers_with_letters():
    assert all(map(scanned.is_bad_number, ["2o17", "l,534,678.51", "36b", "28/1l/2023", "BN-824O7"]))
    assert not any(map(scanned.is_bad_number, ["2017", "BN-82407", "b", "sold", "xviii", "", "II"]))


def test_hidden_words_are_seen():
    reader = abuse.Reader()
    for text in ("n.a.k.e.d", "f-u-c-k", "c o c k", "id1ot", "idiiiiot", "tw@t", "s**t", "idіot"):
        assert sum(h for _, _, h in reader.passages(f"you {text} there")) or any("idiot" in w for _, w, _ in reader.passages(f"you {text} there")), text
    assert sum(h for _, _, h in reader.passages("BN-82407 paid 3,503.25 on 2024-01-02, see full-year e.g. a b")) == 0


def test_label_model_trusts_voters_that_agree():
    bit = {n: 1 << k for k, n in enumerate(abuse.VOTERS)}
    both, alone, harmless = bit["profane"] | bit["you_are"], bit["insult"], bit["insult"] | bit["technical"] | bit["care"] | bit["impersonal"]
    model = abuse.LabelModel({both: 100, bit["profane"] | bit["directed"]: 80, alone: 30, harmless: 200})
    assert model.posterior(both) > 0.9 > model.posterior(alone) > model.posterior(harmless) < 0.1
    assert abuse.LabelModel({}).posterior(both) > 0.5
