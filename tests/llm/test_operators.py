"""Training-data operators on small tables, against brute force where SQL can't say it."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.llm import abuse, lookalikes, mixing, neardup, neighbours, packing, scanned, splitting, tokens

WORDS = "array<struct<text:string,box:struct<x0:double,y0:double,x1:double,y1:double>,block:int,line:int,conf:int>>"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_token_ids(spark):
    df = spark.createDataFrame([(1, "Hello world", 7), (2, "", 7), (3, None, 7), (3, None, 7)], "doc_id bigint, text string, ids int")
    got = tokens.encode_frame(df)
    assert rows(got, "doc_id", F.size("ids")) == [(1, 2), (2, 0), (3, 0), (3, 0)]
    assert rows(tokens.count_frame(df, keep=["doc_id"]), "doc_id", "tokens") == [(1, 2), (2, 0), (3, 0), (3, 0)]
    assert rows(tokens.decode_frame(got), "text") == [("",), ("",), ("",), ("Hello world",)]
    assert tokens.encode_frame(df.limit(0)).count() == 0


def vectors(spark, values):
    return spark.createDataFrame([(p, None if v is None else [float(x) for x in v]) for p, v in values], "pos bigint, vector array<float>")


def brute_pairs(values, k, least):
    pos = [p for p, _ in values]
    unit = np.array([np.array(v) / np.linalg.norm(v) for _, v in values])
    found = set()
    for i in range(len(pos)):
        s = [(-round(float(unit[i] @ unit[j]), 12), pos[j]) for j in range(len(pos)) if j != i]
        found |= {(min(pos[i], p), max(pos[i], p)) for c, p in sorted(s)[:k] if -c >= least}
    return found


def test_similar_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8))
    values = [(k, (centres[k % 40] + 0.15 * rng.normal(size=8)).astype(np.float32)) for k in range(300)]
    values += [(1000 + k, values[0][1]) for k in range(30)]  # a group of copies
    odd = [(2000, None), (2001, [0] * 8), (2002, [1] * 7), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (0, values[0][1])]
    graph = neighbours.NeighbourGraph(vectors(spark, values + odd), dims=8)
    want = brute_pairs(values, 5, 0.9)
    got = set(rows(graph.similar_pairs(5, 0.9), "a", "b"))
    assert len(got & want) / len(want) > 0.97 and len(got - want) / len(got) < 0.05
    copies = rows(graph.neighbours(5).filter("pos = 1005"), "rank", "neighbour", F.round("cosine", 6))
    assert copies == [(k + 1, p, 1.0) for k, p in enumerate([0, 1000, 1001, 1002, 1003])]
    asked = spark.createDataFrame([(9, [float(x) for x in values[7][1]]), (10, None)], "id bigint, vector array<float>")
    assert graph.search(asked, 1).first().neighbour == 7
    empty = neighbours.NeighbourGraph(vectors(spark, odd[:5]), dims=8)
    assert empty.neighbours(5).count() == empty.similar_pairs(5, 0.5).count() == empty.search(asked, 3).count() == 0


@pytest.mark.parametrize("name", ["p1_neighbours", "p1_search"])
def test_graphs_grow_with_the_table(spark, monkeypatch, tmp_path, name):
    from docflow.llm import queries

    made = []

    class Spied(neighbours.NeighbourGraph):
        def _start(self):
            made.append((self.keep, getattr(self, "orders", neighbours.ORDERS)))
            return super()._start()

    monkeypatch.setattr(neighbours, "NeighbourGraph", Spied)
    monkeypatch.setattr(neighbours, "GROWN_FROM", 120, raising=False)
    x = np.random.default_rng(8).normal(size=(1200, 64))
    vectors(spark, list(enumerate(x))).write.parquet(str(tmp_path / "records.parquet"))
    got = queries.queries()[name](spark, str(tmp_path)).collect()
    assert made == [(44, 12)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    if name == "p1_neighbours":
        np.fill_diagonal(s, -2)
    k = 5 if name == "p1_neighbours" else 6
    best = np.argsort(-s, axis=1)[:, :k]
    found = {(r[0], r.neighbour) for r in got}
    asked = range(1200) if name == "p1_neighbours" else range(0, 1200, 100)
    assert len({(i, int(j)) for i in asked for j in best[i]} & found) >= 0.9 * k * len(asked)


def test_packing_places_everything_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 50)  # one length holds most rows and is split over tasks
    sizes = [(k, 10 if k % 3 else k % 40) for k in range(400)] + [(1000, 95), (1001, 64), (1002, None), (1003, 0)]
    out = packing.pack(spark.createDataFrame(sizes, "pos bigint, n int"), ["pos"], "n", 32).collect()
    batches = {}
    for r in out:
        batches.setdefault(r.batch_id, []).append(r["size"])
    assert all(sum(b) <= 32 for b in batches.values()) and sorted(batches) == list(range(len(batches)))
    total = {}
    for r in out:
        total[r.pos] = total.get(r.pos, 0) + r["size"]
    assert total == {p: max(n or 1, 1) for p, n in sizes}
    assert {r.pos: r.pieces for r in out if r.pieces > 1} == {1000: 3, 1001: 2} | {p: 2 for p, n in sizes if n and 32 < n <= 64}
    assert sum(total.values()) / (32 * len(batches)) > 0.96


def test_packing_of_inputs(spark):
    data = [(1, "s", "a", ("x" * 20, 0, 9)), (1, "s", "a", ("x" * 20, 0, 9)), (2, "", "a", ("x", 0, 1)), (3, "s", None, ("x", 0, 1)), (4, "s", "a", ("  ", 0, 1)), (5, "s", "a", ("x", -1, 1)), (None, "s", "a", ("x", 0, 1)), (6, "s", "a", None)]
    inputs = spark.createDataFrame(data, "pos bigint, source_id string, artifact_id string, chunk struct<text:string,index:int,token_count:int>")
    limits = spark.createDataFrame([(3,)], "max_batch_tokens int")
    assert rows(packing.pack_inputs(inputs, limits), "pos", "piece", "pieces", "size") == [(1, 0, 2, 3), (1, 1, 2, 2)]
    empty = packing.pack_inputs(inputs.limit(0), limits)
    report = packing.fill_report(empty, 3).first()
    assert empty.count() == 0 and (report.batches, report.fill) == (0, None)
    with pytest.raises(ValueError):
        packing.capacity_of(limits.limit(0))


def page(lines, conf=90, top="Running Title", number=None):
    words, block, y = [], 0, 60.0
    for k, line in enumerate([top, *lines, *([str(number)] if number else [])]):
        last = number and k == len(lines) + 1
        y = 740.0 if last else y + 20
        block = block + 1 if k in (1,) or last else block
        for j, w in enumerate(line.split(" ")):
            words.append((w, (70.0 + 30 * j, y, 95.0 + 30 * j, y + 10), block, k, conf))
    return words


def test_scanned_pages(spark):
    body = ["the annual report confirms the committee and the balance of the fund", "the committee confirms the annual balance of the report and the fund"] * 6
    pages = [("s", n, page([*body, "the cornmittee confirms the ba-", "lance of the fund"] if n == 2 else body, number=n)) for n in range(1, 6)]
    pages += [("t", 1, []), ("t", 2, None), ("s", 1, pages[0][2])]
    found = scanned.ScannedPages(spark.createDataFrame(pages, f"source_id string, page_no int, words {WORDS}"))
    got = {(r.page_no, pages[1][2][r.word_no][0]): (r.kind, r.printed) for r in found.findings.filter("source_id = 's' and page_no = 2").collect()}
    assert got == {(2, "Running"): ("furniture", None), (2, "Title"): ("furniture", None), (2, "2"): ("furniture", None), (2, "cornmittee"): ("misread", "committee"), (2, "ba-"): ("hyphen", "balance")}
    assert found.findings.filter("source_id = 't'").count() == 0
    text = " ".join(r.text for r in found.paragraphs().filter("source_id = 's'").orderBy("page_no", "paragraph_no").collect())
    assert "committee confirms the balance of the fund" in text and "Running" not in text and "ba-" not in text
    layer = scanned.ScannedPages(spark.createDataFrame([("s", n, page(["thc fund", *body], conf=100)) for n in (1, 2)], f"source_id string, page_no int, words {WORDS}"))
    assert layer.findings.filter("kind = 'misread'").count() == 0
    empty = scanned.ScannedPages(spark.createDataFrame([], f"source_id string, page_no int, words {WORDS}"))
    assert empty.findings.count() == empty.paragraphs().count() == 0


def test_links_come_from_the_vectors(spark):
    """The same pages with vectors of zeros have no misread words: links need neighbours."""
    body = ["the annual report confirms the committee and the balance of the fund", "the committee confirms the annual balance of the report and the fund"] * 6
    pages = [("s", n, page([*body, "the cornmittee confirms the balancc of the rcport", "and the balance of the fnnd"] if n % 3 == 0 else body, number=n)) for n in range(1, 13)]
    df = spark.createDataFrame(pages, f"source_id string, page_no int, words {WORDS}")
    words = lambda found: {r.printed for r in found.findings.filter("kind = 'misread'").collect()}
    assert words(scanned.ScannedPages(df)) >= {"committee", "balance", "report"}
    nothing = scanned.SkipGram(*(np.zeros((scanned.BUCKETS, scanned.DIMENSIONS)) for _ in range(2)))
    assert words(scanned.ScannedPages(df, model=nothing)) == set()


def test_a_form_in_other_contexts_is_a_word(spark):
    """``fond`` is an edit away from ``fund`` but stands among other words; ``fnnd`` stands where ``fund`` does."""
    money = ["the committee of the fund reports the balance of the fund each year"] * 40
    cooking = ["we are fond again and again and we are fond again"] + ["lamb stews simmer slowly while onions soften gently under butter"] * 40
    rows = [("s", n, page([*money, "the committee of the fnnd reports the balance"] if n == 1 else money)) for n in range(1, 4)] + [("t", n, page(cooking)) for n in range(1, 3)]
    found = scanned.ScannedPages(spark.createDataFrame(rows, f"source_id string, page_no int, words {WORDS}"))
    links = {(r.word, c.printed) for r in found.forms.filter("candidates is not null").collect() for c in r.candidates}
    assert ("fnnd", "fund") in links
    assert {r.printed for r in found.findings.filter("kind = 'misread'").collect()} == {"fund"}


def test_halves_over_blank_and_furniture_pages(spark):
    body = ["the annual report confirms the balance of the fund"] * 6
    only_header = page([], number=None)
    rows = [("s", 1, page([*body, "the committee confirms the ba-"])), ("s", 2, []), ("s", 3, None), ("s", 4, only_header), ("s", 5, page(["lance of the fund", *body])),
            ("u", 1, page([*body, "the committee confirms the ba-"])), ("u", 3, page(["lance of the fund", *body]))]
    found = scanned.ScannedPages(spark.createDataFrame(rows, f"source_id string, page_no int, words {WORDS}"))
    got = [(r.source_id, r.page_no, r.printed) for r in found.findings.filter("kind = 'hyphen'").collect()]
    assert got == [("s", 1, "balance")]  # page 2 of the other source is missing, so what follows isn't known


def test_many_stray_numbers_at_one_edge(spark):
    """Lines of one level with all different numbers meet one row each, however many there are."""
    pages = [("s", n, page(["the fund reports a balance this year and the next"] * 4, top=f"Account Statement {n * n * 37 % 9973}")) for n in range(1, 120)]
    found = scanned.ScannedPages(spark.createDataFrame(pages, f"source_id string, page_no int, words {WORDS}"))
    assert found.findings.count() >= 0


def brute_near(docs, width, threshold, least):
    def shingles(t):
        w = __import__("regex").findall(r"[\p{L}\p{N}]+", t.lower())
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}

    sets = {k: shingles(t) for k, t in docs.items() if t}
    sets = {k: s for k, s in sets.items() if len(s) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("hot", [200, 3])
def test_near_duplicates(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT_BUCKET", hot)
    rng = np.random.default_rng(5)
    docs = {}
    for c in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        for v in range(6):
            words = list(base)
            for _ in range(v):
                words[int(rng.integers(0, 60))] = f"v{rng.integers(0, 9999)}"
            docs[f"d{c:02}{v}"] = " ".join(words)
        docs[f"d{c:02}x"] = docs[f"d{c:02}0"].upper() + "!"
    odd = [(0, "null", None), (0, "empty", ""), (0, "short", "a b c d"), (0, None, docs["d000"]), (0, "d000", docs["d000"]), (1, "other", docs["d000"])]
    df = spark.createDataFrame([(0, k, t) for k, t in docs.items()] + odd, "field int, key string, text string")
    near = neardup.NearDuplicates(df, width=3, threshold=0.6, least=20)
    want = brute_near(docs, 3, 0.6, 20)
    got = {(r.a, r.b) for r in near.pairs().collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    groups = {r.key: r for r in near.groups().filter("field = 0").collect()}
    assert set(groups) == set(docs) and groups["d00x"].group_key == groups["d001"].group_key == "d000" and groups["d00x"].copies == 2
    from docflow.llm.lookalikes import UnionFind

    sets = UnionFind()
    for a, b in [*got, *((k, k) for k in docs)]:
        sets.union(a, b)
    assert {k: r.group_key for k, r in groups.items()} == {k: sets.find(k) for k in docs}
    nothing = neardup.NearDuplicates(df.limit(0), width=5, threshold=0.8)
    assert nothing.pairs().count() == nothing.groups().count() == 0


def test_components_of_a_long_chain(spark):
    from docflow.session import Stage

    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 99), (5, 5)], "a bigint, b bigint")
    got = dict(rows(neardup.components(edges, Stage(spark)), "cid", "root"))
    assert got == {k: 0 for k in range(61)} | {99: 99, 100: 99}


def test_oversized_chunks(spark):
    artifacts = spark.createDataFrame([("a", " Text/Plain; x=y"), ("a", " Text/Plain; x=y"), ("b", None), ("c", "text/vtt")], "id string, media_type string")
    limits = spark.createDataFrame([("text/plain", 10, 2), ("*", 20, None)], "media_type string, max_tokens int, overlap_tokens int")
    long = "word " * 15  # 75 characters, 19 tokens
    chunks = spark.createDataFrame([("a", 0, long, 100), ("a", 0, long, 100), ("a", 1, "short", 0), ("b", 0, long, 0), ("zzz", 0, long * 2, None), ("c", 0, None, 0), ("c", 1, "", 0)], "artifact_id string, chunk_index int, text string, start_byte int")
    got = splitting.split_oversized(chunks, artifacts, limits)
    assert {(r.artifact_id, r.chunk_index) for r in got.collect()} == {("a", 0), ("zzz", 0)}
    first = got.filter("artifact_id = 'a' and piece_no = 0").first()
    assert first.start_byte == 100 and got.filter("artifact_id = 'zzz'").first().start_byte is None
    assert splitting.split_oversized(chunks, artifacts, limits.limit(0)).count() == splitting.split_oversized(chunks.limit(0), artifacts, limits).count() == 0


def test_look_alikes(spark):
    artifacts = spark.createDataFrame([("a", "plain"), ("b", "thе lеdger"), ("b", "thе lеdger"), ("c", None), ("d", ""), ("e", "café")], "id string, text string")
    word = lambda t: (t, (0.0, 0.0, 1.0, 1.0), 0, 0, 9)
    pages = spark.createDataFrame([("s", 1, [word("the"), word("fｕnd"), word(None)]), ("s", 2, []), ("s", 3, None), ("s", 1, [word("the"), word("fｕnd"), word(None)])], f"source_id string, page_no int, words {WORDS}")
    assert rows(lookalikes.found(artifacts, pages), "field", "id", "page_no", "word_no") == [("artifact", "b", 0, 0), ("word", "s", 1, 1)]
    counts = lookalikes.character_counts(artifacts, pages)
    assert rows(lookalikes.canonical_texts(artifacts, "text", counts, ["id"]).distinct(), "id", "text") == sorted([("a", "plain"), ("b", "the ledger"), ("c", None), ("d", ""), ("e", "café")], key=repr)
    whole = lookalikes.canonical_words(pages, counts, ["source_id", "page_no"], only_changed=False).distinct()
    assert rows(whole, "page_no", "words") == [(1, ["the", "fund", None]), (2, []), (3, [])]
    assert lookalikes.found(artifacts.limit(0), pages.limit(0)).count() == 0


def test_mixture(spark):
    docs = [(k, "word " * (5 + k % 30), "en" if k % 3 else "fr", ("A-b", "a_b ", "C")[k % 3] if k % 50 else None) for k in range(600)]
    docs += [(1000, None, None, "c"), (1001, "", "xx", "C"), (1002, "x y", None, "elsewhere")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    targets = spark.createDataFrame([("a_b", 0.3, 1), ("c", 0.6, 3), ("none", 0.1, 2), ("c", 0.6, 3)], "source string, weight double, max_repeats int")
    mixture, sizes = mixing.mixture_stages(df, targets)
    report = {r.source: r for r in mixing.shares(mixture, sizes, targets).collect()}
    assert report["a_b"].share == pytest.approx(1 / 3, abs=0.01) and report["c"].share == pytest.approx(2 / 3, abs=0.01) and report["none"].share == 0
    assert report["a_b"].most_copies == 1 and report["c"].most_copies <= 3
    assert mixture.count() == mixture.select("doc_id").distinct().count() and mixture.filter("copies < 1 or tokens < 1").count() == 0
    assert mixing.margins(mixture, sizes, targets).filter("axis = 'lang'").count() == 2
    for none in (mixing.mixture_stages(df.limit(0), targets), mixing.mixture_stages(df, targets.limit(0))):
        assert none[0].count() == 0


def test_each_source_ends_within_a_document_of_its_weight(spark):
    rng = np.random.default_rng(8)
    docs = [(k, "word " * int(min(1500, rng.pareto(1.1) * 20 + 1)), "en", "abc"[k % 3]) for k in range(900)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 2)], "source string, weight double, max_repeats int")
    mixture, sizes = mixing.mixture_stages(df, targets)
    got = {r.source: r for r in mixing.shares(mixture, sizes, targets).collect()}
    largest, whole = sizes.agg({"tokens": "max"}).first()[0], sum(r.tokens for r in got.values())
    for r in got.values():
        assert abs(r.tokens - r.weight * whole) <= 2 * largest and r.most_copies <= r.max_repeats
    # The source that bounds the mixture gives all it has.
    assert any(r.tokens == r.available * r.max_repeats for r in got.values())


def test_topics_are_clusters_of_the_documents(spark):
    themes = {"cook": "onion butter stew simmer garlic lamb oven flour", "sail": "harbour anchor mast wind rudder deck tide sail", "tax": "levy audit ledger duty revenue refund assessor bracket"}
    rng = np.random.default_rng(3)
    docs = []
    for k in range(240):
        theme = list(themes)[k % 3]
        words = rng.choice(themes[theme].split(), 30).tolist() + rng.choice("the of and a to in".split(), 30).tolist()
        docs.append((k, " ".join(words), "en" if k % 2 else "fr", theme))
    docs += [(900, None, "en", "none"), (901, "", None, "none")]
    sizes = mixing.measured(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")).cache()
    topics = {r.doc_id: r.topic for r in mixing.Topics(sizes).of(sizes).collect()}
    assert topics[900] == topics[901] == "none"
    for theme in range(3):  # each cluster has documents of one theme only, of both languages
        own = {topics[k] for k in range(theme, 240, 3)}
        assert own.isdisjoint({topics[k] for k in range(240) if k % 3 != theme})
    assert mixing.Topics(sizes.limit(0)).of(sizes.limit(0)).count() == 0


def test_topics_come_from_every_document(spark):
    order = [r.id for r in spark.range(20_400).orderBy(F.xxhash64("id"), "id").collect()]
    x = np.random.default_rng(1).random((len(order), mixing.SKETCH), dtype=np.float32)
    docs = [(k, "s", "en" if at < 20_000 else "zz", 1, bytearray(x[at].tobytes())) for at, k in enumerate(order)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, source string, lang string, tokens int, sketch binary").cache()
    topics = mixing.Topics(sizes)
    assert set(topics.means) == {"en", "zz"}
    assert topics.means["en"] == pytest.approx(x[:20_000].mean(axis=0), abs=1e-5) and topics.means["zz"] == pytest.approx(x[20_000:].mean(axis=0), abs=1e-5)
    assert (mixing.Topics(sizes).centres == topics.centres).all()
    assert topics.of(sizes).select("topic").distinct().count() == mixing.TOPICS


def test_abuse(spark):
    calm = ["The fund reports a balance of {} as of page 4.", "Thanks, page {} looks fine now.", "This scan is terrible and I am angry about it, see {}.", "The pig farm and the cow shed were valued at {}.", "My stupid mistake, page {} was upside down."]
    bad = ["You are a worthless idiot and everyone knows it.", "Go f-u-c-k yourself, you tw@t.", "I will burn your house down, you scumbag.", "Immigrants are vermin and should be locked up.", "Halt die Fresse, du Wichser."]
    docs = [(k, " ".join(c.format(k) for c in calm[: 1 + k % 5]), "x") for k in range(200)]
    docs += [(1000 + k, calm[k % 5].format(k) + " " + bad[k % 5], "X ") for k in range(60)] + [(5000, None, None), (5001, "", "x"), (5002, " \n", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    scored = abuse.Detector(df).scores(df, ["doc_id", "source"])
    found = {r.doc_id for r in scored.filter("score >= 0.5").collect()}
    truth = set(range(1000, 1060))
    assert len(found & truth) >= 57 and len(found - truth) <= 4
    assert scored.filter("doc_id in (5000, 5001)").select("score").distinct().first().score == 0.0
    rates = {r.source: r for r in abuse.source_rates(scored).collect()}
    assert rates["x"].documents == 262 and rates[None].documents == 1
    labels = spark.createDataFrame([(1000, "r", 1), (1000, "r", 1), (1, "r", 0), (2, "r", 1), (2, "s", 0), (None, "r", 1)], "doc_id bigint, rater string, abusive int")
    assert rows(abuse.agreement(scored, labels), "reviewed", "detected", "documents") == [(False, False, 1), (True, True, 1)]
    assert abuse.Detector(df.limit(0)).scores(df.limit(0), ["doc_id"]).count() == 0
    odd = df.limit(5).withColumns({"passages": df.doc_id, "masks": df.source, "score_": df.text})
    assert abuse.Detector(odd).scores(odd, ["doc_id", "passages", "masks"]).columns == ["doc_id", "passages", "masks", "score"]


def test_judgements_teach_the_detector_and_move_scores(spark):
    # What is abusive here only reviewers know: no voter has a word of it.
    calm = "The {} of page {} is filed."
    docs = [(k, calm.format("ledger vault index annex".split()[k % 4], k) + (f" Grobnik zarf {k}." if k % 8 == 0 else "")) for k in range(400)]
    docs += [(900, "Nothing of note."), (901, None), (902, "The ledger of page 3 is filed.")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = [(k, "r", int(k % 8 == 0)) for k in range(0, 200)] + [(k, "s", int(k % 8 == 0)) for k in range(0, 200, 5)]
    labels += [(900, "r", 0), (901, "r", 1), (902, "r", 1), (902, "r", 1), (902, "s", 1), (None, "r", 1), (3, "r", None), (7777, "r", 1)]
    reviewed = spark.createDataFrame(labels, "doc_id bigint, rater string, abusive int")
    scored = abuse.Detector(df, review_labels=reviewed).scores(df, ["doc_id"])
    score = {r.doc_id: r.score for r in scored.collect()}
    assert scored.columns == ["doc_id", "score"] and len(score) == len(docs)
    unseen = [k for k in range(200, 400)]
    assert [k for k in unseen if score[k] >= 0.5] == [k for k in unseen if k % 8 == 0]
    # Two judgements raise the score of a text like others, one of harmlessness lowers it; no text stays 0.
    assert score[902] > 10 * score[201] and score[901] == 0.0 and score[900] < 0.5
    none = abuse.Detector(df, review_labels=reviewed.limit(0)).scores(df, ["doc_id"])
    assert none.filter("score >= 0.5").count() == 0
    assert abuse.evidence_of(abuse.judgements(reviewed.limit(0))) > 1


def test_unknown_words_contradict_no_judgement():
    # Harmless rows are many, as in the tables, so that of unknown words the model believes harmlessness.
    known = [(f"the {n}{k} is filed".split(), 0, 0.0, 1.0) for n in "abcdefghijklmnop" for k in "uvwxyz"] + [(f"grobnik {n}".split(), 0, 0.9, 1.0) for n in "abcdefghijklmnop"]
    odd = [("the w is filed".split(), 0, 0.9, 1.0), ("plonzig frast".split(), 0, 0.9, 1.0), ("grobnik w".split(), 0, 0.0, 0.4), ("calm day".split(), 0, 0.0, 0.4)]
    n = len(known)
    kept = abuse.cleaned(known + odd, {n + 2, n + 3}, {n, n + 1})
    assert kept == [*known, odd[1], odd[3]]
    assert abuse.cleaned([], set(), set()) == []


@pytest.mark.parametrize(
    ("text", "voter"),
    [
        ("i will kill you", "threat"), ("ich schlage dir die zähne ein", "threat"), ("je vais te tuer", "threat"), ("i hope you die", "curse"), ("ojalá te mueras", "curse"),
        ("fuck you", "directed"), ("you are an idiot", "you_are"), ("du bist so dumm", "you_are"), ("the migrants are parasites", "group_is"), ("les migrants sont des rats", "group_is"),
        ("gays should be banned", "exclusion"), ("los inmigrantes son una plaga y hay que echarlos", "exclusion"), ("people like you", "alike"), ("halt die klappe", "idiom"),
        ("he is a moron", "they_are"), ("i want to lick your thighs", "explicit"), ("m0r0n", "hidden"), ("this form forbids insults like moron", "reporting"), ("what a moron i am", "self"),
    ],
)
def test_voters_are_grammar_over_classes(text, voter):
    passage, words, hidden = abuse.Reader.read(text)
    assert abuse.Reader.votes(passage, words, hidden) & 1 << abuse.VOTERS.index(voter), abuse.class_string(words)


@pytest.mark.parametrize("text", ["die fonds sind in der bilanz", "con el saldo de la cuenta", "the gross amount is in the queue", "we hate to ask", "the report is attached", "3,503.25 on 2024-01-02"])
def test_everyday_words_have_no_vote(text):
    passage, words, hidden = abuse.Reader.read(text)
    assert not abuse.Reader.votes(passage, words, hidden)


def test_long_sentences_are_read_in_windows():
    reader = abuse.Reader()
    text = " ".join(f"w{k}x" for k in range(500)) + " you are an idiot"
    passages = list(reader.passages(text))
    assert max(len(w) for _, w, _ in passages) <= abuse.WINDOW and sum(bool(reader.votes(*x)) for x in passages) >= 1
    assert {w for _, ws, _ in passages for w in ws} >= {"idiot", *(f"w{k}x" for k in range(500))}


def test_few_pairs_at_the_threshold_share_no_band():
    rng = np.random.default_rng(4)
    lost, pairs = 0, 8000
    multipliers = neardup._multipliers()
    for _ in range(pairs):
        x = rng.integers(0, 1 << 64, 100, dtype=np.uint64)
        signed = np.stack([neardup.signature(part, multipliers) for part in (x[:80], x[20:])])
        keys = neardup.band_keys(signed, np.zeros(2, dtype=np.int64))
        lost += not np.any(keys[0] == keys[1])
    assert lost / pairs <= 1 / 500
