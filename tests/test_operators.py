"""Operators on small tables: odd rows, nulls, empty tables, clashing names."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from docflow.functions import pdf as page
from docflow.functions import text as tx
from docflow.functions.media import canonical
from docflow.kernels.embedding import EmbedConfig, HashEmbedder, RunCancelled, pack_batches
from docflow.operators import chunk as ch
from docflow.operators import content as ct
from docflow.operators import embed as em
from docflow.operators import extract as ex
from docflow.operators import pdf as pd
from docflow.session import Stage, broadcast_if_small
from docflow.sources import files, objects as ob


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def one(spark, column, **fields):
    names = ", ".join(f"{k} {t}" for k, (t, _) in fields.items())
    return spark.createDataFrame([tuple(v for _, v in fields.values())], names).select(column).first()[0]


def test_text_functions(spark):
    for text, want in ((None, None), ("", ""), ("  a  \n  b  ", "a\nb"), ("a\n\n\n\nb", "a\n\nb"), ("\n  \n\t\n", ""), ("\u2003x\u3000", "x"), ("\x1cx", "\x1cx")):
        assert one(spark, tx.normalize_whitespace(F.col("t")), t=("string", text)) == want
    for text, n in (("", 0), ("a", 1), ("12345", 2), ("語" * 8, 2), (None, None)):
        assert one(spark, tx.estimate_tokens(F.col("t")), t=("string", text)) == n
    for text, want in (
        ("---\ntitle: Hello\ntags: [a, b]\n---\n# Body\n\ntext\n", "# Body\n\ntext\n"), ('+++\ntitle = "x"\n+++\nbody\n', "body\n"), ("----\nx\n----\nbody\n", "----\nx\n----\nbody\n"),
        ("---\n---\n", ""), ("---\nopen\n", "---\nopen\n"), ("---\r\na\r\n---\r\nb", "b"), (" ---\na\n---\nb", " ---\na\n---\nb"), ("---\na\n---", ""),
    ):
        assert one(spark, tx.strip_front_matter(F.col("t")), t=("string", text)) == want
    for kind, want in (("Text/Plain", "text/plain"), ("text/plain; charset=utf-8", "text/plain"), ("  text/plain  ", "text/plain"), ("not a media type", None), ("", None), (None, None), ("text", "text"), ("a/b; x", None)):
        assert one(spark, canonical(F.col("t")), t=("string", kind)) == want


def test_white_space_takes_linear_time(spark):
    import time

    rows = [("\n\n".join(" line %d " % k for k in range(20_000)),), ("a" + " " * 200_000 + "b",), ("x" + " \n" * 100_000 + "y",)]
    df = spark.createDataFrame(rows, "t string")
    start = time.perf_counter()
    got = [r[0] for r in df.select(tx.normalize_whitespace(F.col("t"))).collect()]
    assert time.perf_counter() - start < 20
    assert got[0] == "\n\n".join("line %d" % k for k in range(20_000)) and got[1] == rows[1][0] and got[2] == "x\n\ny"


@pytest.mark.parametrize("seed", range(3))
def test_white_space_is_that_of_lines(spark, seed):
    import random

    from docflow.kernels.text_norm import normalize_whitespace

    r = random.Random(seed)
    texts = ["".join(r.choice(["a", "b", " ", "\n", "\n", "\t", "\r", "\u2003", "\u2028", "\x85"]) for _ in range(r.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalize_whitespace(F.col("t")).alias("n"))
    for row in df.collect():
        assert row.n == normalize_whitespace(row.t)


def test_page_functions(spark):
    sizes = [((612.0, 792.0, 72.0, 2048), (612, 792)), ((612.0, 792.0, 150.0, 2048), (1275, 1650)), ((612.0, 792.0, 300.0, 2048), (1583, 2048)), ((792.0, 612.0, 300.0, 1000), (1000, 773)),
             ((500.0, 500.0, 1000.0, 100), (100, 100)), ((612.0, 792.0, 0.01, 2048), (1, 1)), ((1.0, 10000.0, 72.0, 2048), (1, 2048))]
    for (w, h, d, m), want in sizes:
        got = one(spark, page.pixel_size(*(F.col(c) for c in "whdm")), w=("double", w), h=("double", h), d=("double", d), m=("int", m))
        assert tuple(got) == want == pd.pixels_of(w, h, d, m)
    assert [one(spark, page.rotation(F.col("r")), r=("int", r)) for r in (0, 90, -90, 450, 45)] == [0, 90, 270, 90, None]
    assert one(spark, page.box_size(F.col("b")), b=("string", "0 0 nan 9")) is None
    assert [tuple(x) for x in one(spark, page.split_pages(F.col("t")), t=("string", "alpha\f\fcharlie\f"))] == [(1, "alpha"), (2, ""), (3, "charlie")]
    assert one(spark, page.split_pages(F.col("t")), t=("string", "")) == []


def artifacts(spark, rows):
    return spark.createDataFrame([(i, m, p, t, None, None) for i, m, p, t in rows], ct.ARTIFACT)


def test_content(spark):
    a = artifacts(spark, [("a", "text/plain", "s", "x"), ("b", "text/plain", "a", ""), ("c", "", "b", None), ("", None, None, "y"), ("d", "text/plain", "", "z"), ("e", "x", "f", "t"), ("f", "x", "e", "t")])
    assert values(ct.validate_artifacts(a), "id", "error") == sorted([("a", None), ("b", None), ("c", "MISSING_MEDIA_TYPE"), ("", "MISSING_ID"), ("d", "MISSING_PARENT"), ("e", None), ("f", None)], key=repr)
    assert values(ct.provenance(a), "id", "root", "depth") == sorted([("a", "s", 1), ("b", "s", 2), ("c", "s", 3), ("d", "", 1), ("e", None, None), ("f", None, None)], key=repr)
    single = values(ct.single_text_artifact(artifacts(spark, [("a", "x", "s", "t"), ("b", "x", "s", ""), ("c", "x", "p", "u"), ("d", "x", "p", "v"), ("e", "x", "q", None)])), "derived_from", "n", "text", "error")
    assert single == sorted([("s", 1, "t", None), ("p", 2, None, "MULTIPLE_TEXT_ARTIFACTS"), ("q", 0, None, "NO_TEXT_ARTIFACT")], key=repr)
    assert ct.provenance(a.limit(0)).count() == ct.children(a.limit(0)).count() == 0


def test_provenance_of_long_chains_and_cycles(spark):
    chain = [(f"n{k}", "x", f"n{k + 1}" if k < 299 else "source", None) for k in range(300)]
    ring = [("r0", "x", "r1", None), ("r1", "x", "r2", None), ("r2", "x", "r0", None), ("in", "x", "r1", None), ("self", "x", "self", None)]
    got = {r.id: (r.root, r.depth) for r in ct.provenance(artifacts(spark, chain + ring)).collect()}
    assert got == {f"n{k}": ("source", 300 - k) for k in range(300)} | {i: (None, None) for i in ("r0", "r1", "r2", "in", "self")}


def test_running_total(spark):
    rows = [("a", k, k % 7 if k % 5 else None) for k in range(50)] + [("b", 3, 9), (None, 1, 2), (None, 4, 5)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(r.k, r.o): r.before for r in ct.running_total(df, ["k"], "o", "v", "before", width=8).filter("k is not null").collect()}
    want, total = {("b", 3): 0}, 0
    for k in range(50):
        want["a", k] = total
        total += k % 7 if k % 5 else 0
    assert got == want


def sources(spark, rows):
    return spark.createDataFrame([(i, m, None if c is None else bytearray(c), "clash") for i, m, c in rows], "id string, media_type string, content binary, text string")


def test_extract_guards_in_order(spark):
    registry = ex.preset(max_bytes=8)
    rows = [("", "not a media type", b""), ("a", "not a media type", b""), ("b", "image/png", b"x" * 99), ("c", "Text/Plain", b"123456789"), ("d", "text/plain", b"12345678"),
            ("e", "text/plain", b" \n "), ("f", "text/html", b""), ("g", "application/pdf", b"%PDF"), ("h", "text/plain", b"a\xff\xffb"), ("i", "text/markdown", None), ("j", None, b"x")]
    out = ex.extract(sources(spark, rows), registry)
    want = [("", "MISSING_PARENT_ID", None), ("a", "INVALID_MEDIA_TYPE", None), ("b", "UNSUPPORTED_MEDIA_TYPE", None), ("c", "SOURCE_TOO_LARGE", None), ("d", None, "12345678"),
            ("e", "NO_CONTENT", None), ("f", "NO_CONTENT", None), ("g", "NO_ENGINE", None), ("h", None, "a\ufffdb"), ("i", "NO_CONTENT", None), ("j", "INVALID_MEDIA_TYPE", None)]
    assert values(out, "derived_from", "error", "text") == sorted(want, key=repr)
    assert ex.extract(sources(spark, []), registry).count() == 0


def test_registry_mistakes_fail_at_once(spark):
    with pytest.raises(ValueError):
        ex.preset().register("text/plain", ex.extract_text)
    with pytest.raises(ValueError):
        ex.Registry().register("", ex.extract_text)
    with pytest.raises(ValueError):
        ex.Registry().register("x/y", None)
    with pytest.raises(ValueError):
        ex.Registry(max_bytes=0)
    assert ex.preset().supported() == sorted(ex.preset().supported())


class TwoPages:
    name, mode = "fake", "raw"

    def pages(self, data):
        return [(1, " one "), (2, " \n "), (3, "three")]


def test_pdf_pages_become_artifacts(spark):
    out = ex.extract(sources(spark, [("a", "application/pdf", b"x")]), ex.preset(TwoPages()))
    assert values(out.select("ordinal", "text", F.col("metadata")["pdf.page"].alias("p"), F.col("metadata")["pdf.mode"].alias("m")), "ordinal", "text", "p", "m") == [(0, "one", "1", "raw"), (1, "three", "3", "raw")]


def test_chunk_keeps_clashing_keys(spark):
    df = spark.createDataFrame([("k", 7, "a b\n\nc d"), ("k", 7, None), ("l", None, " ")], "text string, chunk_index int, body string")
    out = ch.chunk(df, ["text", "chunk_index"], "body", max_tokens=1, no_overlap=True)
    assert out.columns == ["text", "chunk_index", "chunk_index", "text", "start_byte", "end_byte", "token_count"]
    assert out.count() >= 2
    with pytest.raises(KeyError):
        ch.chunk(df, ["text"], "body", boundaries="nothing")


def test_turns_as_units(spark):
    df = spark.createDataFrame([("a", 2, "two"), ("a", 1, "öne"), ("a", 3, ""), ("b", 1, None)], "k string, n int, t string")
    units = ch.turn_units(df, "k", "n", "t")
    row = units.filter("k = 'a'").first()
    assert [row.text.encode()[u["start"] : u["end"]].decode() for u in row.units] == ["öne", "two"]
    assert ch.chunk(units, ["k"], max_tokens=1, no_overlap=True, units="units").count() == 2


def inputs(spark, rows):
    return spark.createDataFrame([(p, s, a, (t, i, n), None, None) for p, s, a, t, i, n in rows], ct.INPUT)


def test_sizes_are_the_callers(spark):
    df = spark.createDataFrame([("a", "one two three four")], "k string, t string")
    words = lambda data: len(data.split())
    assert [r.token_count for r in ch.chunk(df, ["k"], "t", max_tokens=4, no_overlap=True, estimate=words).collect()] == [4]
    assert ch.chunk(df, ["k"], "t", max_tokens=2, no_overlap=True, estimate=words).count() > 1
    inputs = spark.createDataFrame([(1, "s", "a", ("one two", 0, 0), None, None), (2, "s", "a", ("one", 0, 7), None, None)], ct.INPUT)
    run = em.embed_run(inputs, lambda: HashEmbedder(2), EmbedConfig(estimate=lambda t: F.size(F.split(t, " "))))
    assert values(run.records, "pos", "token_count") == [(1, 2), (2, 7)]


@pytest.mark.parametrize("cfg", [EmbedConfig(3, 1 << 30), EmbedConfig(100, 40), EmbedConfig(7, 60)])
def test_calls_are_the_batches_of_the_whole_order(spark, tmp_path, cfg):
    """Each call's inputs are written down; together they must be the batches of one pass over all positions."""
    import os
    import uuid

    log = str(tmp_path)

    class Logged(HashEmbedder):
        def embed(self, request):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write(" ".join(i.removeprefix("in-") for i, _, _ in request.inputs))
            return super().embed(request)

    rows = [(k * 3, "s", "a", ("x" * (k * 7919 % 150 + 1), 0, 0), None, None) for k in range(400)]
    em.embed_run(spark.createDataFrame(rows, ct.INPUT), lambda: Logged(2), cfg)
    calls = sorted(([int(x) for x in p.read_text().split()] for p in tmp_path.iterdir()), key=min)
    want = {}
    for pos, batch in pack_batches([(k * 3, -(-(k * 7919 % 150 + 1) // 4)) for k in range(400)], cfg):
        want.setdefault(batch, []).append(pos)
    assert calls == list(want.values())


def test_embed_run(spark):
    rows = [(0, "s", "a", "good", 0, 1), (1, "s", "", "x", 0, 1), (2, "", "a", "x", 0, 1), (3, "s", "a", " \u2003", 0, 1), (4, "s", "a", "x", -1, 1), (5, "s", "a", "good", 1, None), (5, "s", "a", "good", 1, None)]
    run = em.embed_run(inputs(spark, rows), lambda: HashEmbedder(4))
    assert values(run.records, "pos", "token_count", F.size("vector")) == [(0, 1, 4), (5, 1, 4)]
    codes = ["EMBED_MISSING_ARTIFACT_ID", "EMBED_MISSING_SOURCE_ID", "EMBED_EMPTY_TEXT", "EMBED_NEGATIVE_INDEX"]
    assert values(run.failures, "first_pos", "error_code", "retryable") == [(k + 1, c, False) for k, c in enumerate(codes)]
    assert em.embed_run(inputs(spark, rows), lambda: HashEmbedder(4), EmbedConfig(max_batch_inputs=2), scope="block").records.count() == 2
    empty = em.embed_run(inputs(spark, rows).limit(0), lambda: HashEmbedder(4))
    assert empty.records.count() == empty.failures.count() == 0 and not empty.cancelled
    assert em.embed_run(inputs(spark, rows), lambda: HashEmbedder(fail=lambda r: RunCancelled())).cancelled


@pytest.mark.parametrize("stretch, cfg", [(7, EmbedConfig(4, 30)), (3, EmbedConfig(5, 1000)), (1000, EmbedConfig(4, 30)), (5, EmbedConfig(96, 25))])
def test_batches_over_stretches_are_those_of_one_pass(spark, monkeypatch, stretch, cfg):
    monkeypatch.setattr(em, "STRETCH", stretch)
    sizes = [(k * 3, (k * 7919) % 23 + 1 + 40 * (k % 17 == 0)) for k in range(150)]
    got = em.batch_ids(spark.createDataFrame(sizes, "pos bigint, tokens int"), cfg)
    assert values(got, "pos", "batch_id") == sorted(pack_batches(sizes, cfg), key=repr)


def test_object_store(spark):
    store = spark.createDataFrame([("u/a/1", b"x"), ("u/a/0", b"xy"), ("u/b/0", b""), ("v/0", b"0123456789")], "key string, content binary")
    assert [r.key for r in ob.list_objects(store, "u/a/").collect()] == ["u/a/0", "u/a/1"]
    assert [r.key for r in ob.list_objects(store, "", 2).collect()] == ["u/a/0", "u/a/1"]
    keys = spark.createDataFrame([("v/0",), ("nope",)], "key string")
    assert values(ob.exists(keys, store), "key", "exists") == [("nope", False), ("v/0", True)]
    assert values(ob.get(keys, store), "key", "error") == [("nope", "OBJECT_NOT_FOUND"), ("v/0", None)]
    left, missing = ob.delete(store, keys)
    assert left.count() == 3 and values(missing, "key") == [("nope",)] and ob.delete_if_exists(store, keys).count() == 3
    assert values(ob.put(store, spark.createDataFrame([("v/0", b"new"), ("w", b"w")], store.schema)).filter("key >= 'v'"), "key", "content") == [("v/0", b"new"), ("w", b"w")]
    ranges = [(2, 3, b"234", None), (7, -1, b"789", None), (8, 10, b"89", None), (4, 0, b"", None), (10, 1, None, "RANGE_NOT_SATISFIABLE"), (-1, 1, None, "INVALID_ARGUMENT"), (1, 2**62, b"123456789", None)]
    for offset, length, want, error in ranges:
        row = store.filter("key = 'v/0'").select(
            ob.range_bytes(F.col("content"), F.lit(offset), F.lit(length)), ob.range_error(F.octet_length("content"), F.lit(offset), F.lit(length))
        ).first()
        assert (None if row[0] is None else bytes(row[0]), row[1]) == (want, error)
    asks = [("d", k, s) for k, s in enumerate(["u/a/0", "v/0", "u/a/0"])] + [("m", 0, "nope"), ("m", 1, "v/0")] + [("big", k, "u/a/1") for k in range(33)] + [("full", k, "u/a/1") for k in range(32)]
    done, failed = ob.compose(store, spark.createDataFrame(asks, "key string, ord int, src string"))
    assert values(done, "key", "content") == [("d", b"xy0123456789xy"), ("full", b"x" * 32)]
    assert values(failed, "key", "error") == [("big", "INVALID_ARGUMENT"), ("m", "OBJECT_NOT_FOUND")]
    parts = spark.createDataFrame([("k", n, bytes([65 + n % 26])) for n in range(1100)], "key string, ord int, content binary")
    assert bytes(ob.compose_levels(parts).first().content) == bytes(65 + n % 26 for n in range(1100))


def test_compose_counts_sources_and_not_their_numbers(spark):
    objects = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "key string, content binary")
    asked = [("far", 90, "b"), ("far", 40, "a"), ("gone", 0, "a"), ("gone", 1, "z")] + [("many", k, "a") for k in range(33)]
    done, failed = ob.compose(objects, spark.createDataFrame(asked, "key string, ord int, src string"))
    assert [(r.key, bytes(r.content)) for r in done.collect()] == [("far", b"12")]
    assert values(failed, "key", "error") == [("gone", "OBJECT_NOT_FOUND"), ("many", "INVALID_ARGUMENT")]


def test_listing_ends_with_its_callback(spark):
    objects = spark.createDataFrame([(f"p/{k:02d}", k) for k in range(20)] + [("q", 1)], "key string, size int")
    seen = []

    def call(row):
        seen.append(row.key)
        if len(seen) == 3:
            raise StopIteration("enough")

    with pytest.raises(StopIteration, match="enough"):
        ob.each_object(objects, "p/", call)
    assert seen == ["p/00", "p/01", "p/02"]


def test_memory_store_and_reads(spark):
    import io
    from datetime import datetime, timedelta, timezone

    from docflow.errors import DocflowError
    from docflow.kernels.process import Cancelled
    from docflow.sources import stores

    clock = iter(datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=k) for k in range(9))
    store = stores.MemoryStore(lambda: next(clock))
    store.put("a", b"hello")
    store.put("b", b" you")
    store.compose("c", ["a", "b", "a"])
    assert store.get("c") == b"hello youhello" and store.get_range("a", 1, -1) == b"ello" and store.get_range("a", 1, 2) == b"el"
    for call, code in ((lambda: store.get("x"), "OBJECT_NOT_FOUND"), (lambda: store.delete("x"), "OBJECT_NOT_FOUND"), (lambda: store.get_range("a", -1, 1), "INVALID_ARGUMENT"),
                       (lambda: store.get_range("a", 5, 1), "RANGE_NOT_SATISFIABLE"), (lambda: store.compose("d", []), "INVALID_ARGUMENT"), (lambda: store.compose("d", ["a", "x"]), "OBJECT_NOT_FOUND")):
        with pytest.raises(DocflowError) as e:
            call()
        assert e.value.code == code
    store.delete("b")
    rows = ob.list_objects(store.table(spark)).collect()
    assert [(r.key, r.size) for r in rows] == [("a", 5), ("c", 14)] and rows[1].created - rows[0].created == timedelta(hours=2)
    assert not store.exists("b") and stores.read_all(io.BytesIO(b"12345"), 5) == b"12345"
    with pytest.raises(DocflowError):
        stores.read_all(io.BytesIO(b"123456"), 5)
    asked = iter([False, True])
    with pytest.raises(Cancelled):
        stores.read_all(io.BytesIO(b"x" * 10), None, lambda: next(asked))
    for wrong in (lambda: stores.Store("", spark), lambda: stores.Store("b", None), lambda: stores.connect(""), lambda: stores.connect_emulator("b", ""), lambda: stores.Store("b", spark, "ftp")):
        with pytest.raises(ValueError):
            wrong()
    shared = stores.Store("bucket", spark)
    shared.close()
    assert shared.uri("k y") == "gs://bucket/k%20y" and shared.spark.range(1).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"hello")
    (tmp_path / "in" / "b.txt").write_bytes(b"x" * 100)
    fine, large = files.scan(spark, str(tmp_path / "in"), max_bytes=10)
    assert [r.size for r in fine.collect()] == [5] and [r.error for r in large.collect()] == ["SOURCE_TOO_LARGE"]
    assert files.listing(spark, str(tmp_path / "in")).count() == 2
    plan = fine._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10)" in plan
    for n in (1, 2):
        files.replace_table(spark.range(n), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
    assert files.store_uri("gcs", "b", "/k/x y") == "gs://b/k/x%20y" and files.store_uri("s3", "b") == "s3a://b/"
    for bad in (("gcs", ""), ("ftp", "b")):
        with pytest.raises(ValueError):
            files.store_uri(*bad)
    with pytest.raises(ValueError):
        files.emulator_conf("")


def tool(tmp_path, name, body):
    path = tmp_path / name
    path.write_text(f"#!/bin/sh\n{body}\n")
    path.chmod(0o755)
    return str(path)


def test_engine_with_fake_programs(spark, tmp_path):
    header = "\t".join(pd.pdf_layout.TSV_HEADER)
    (tmp_path / "tsv").write_text(f"{header}\n1\t1\t0\t0\t0\t0\t0\t0\t612\t792\t-1\t###\n5\t1\t0\t0\t0\t0\t1\t2\t3\t4\t90\thi\n")
    text = tool(tmp_path, "text", f'case "$*" in *-tsv*) cat {tmp_path}/tsv;; *) printf "one\\fthree\\f";; esac')
    info = tool(tmp_path, "info", 'printf "Pages: 1\\nPage 1 rot: 90\\nPage 1 CropBox: 0 0 612 792\\n"')
    image = tool(tmp_path, "image", "printf '\\211PNG\\r\\n\\032\\n\\000\\000\\000\\015IHDR\\000\\000\\003\\030\\000\\000\\002\\144'")
    engine = pd.PopplerEngine(text_program=text, info_program=info, image_program=image)
    df = sources(spark, [("a", "application/pdf", b"%PDF")])
    layout = pd.layouts(df, ["id"], engine).first()
    assert layout.error is None and layout.layout.pages[0].width == 792 and layout.layout.pages[0].words[0].text == "hi"
    picture = pd.renders(df, ["id"], engine, 1, dpi=72.0).first()
    assert picture.error is None and (picture.image.width, picture.image.height) == (792, 612) and picture.image.scale_x == 1.0
    assert pd.renders(df, ["id"], engine, 2).first().error == "PAGE_OUT_OF_RANGE"
    assert pd.renders(df, ["id"], engine, 0).first().error == "INVALID_OPTIONS"
    assert ex.extract(df, ex.preset(engine)).count() == 2
    gone = pd.PopplerEngine(text_program="no-such-program")
    assert ex.extract(df, ex.preset(gone)).first().error == "ENGINE_UNAVAILABLE"


@pytest.mark.parametrize(
    ("call", "want"),
    [
        ("pages(b'P:one\\x0c\\nP:two\\x0c')", "[(1, 'one'), (2, '\\ntwo')]"),
        ("geometry(b'I:Pages: 2\\nI:Page 1 rot: 0\\nI:Page 1 CropBox: 0 0 3 4\\nI:Page 2 rot: 90', 1, 1)", "(2, [{'number': 1, 'width': 3.0, 'height': 4.0, 'rotation': 0}])"),
        ("render(b'I:Pages: 1\\nI:Page 1 rot: 0\\nI:Page 1 CropBox: 0 0 612 792', 1, dpi=72.0)['height']", "792"),
    ],
)
def test_standins_need_no_executable_files(tmp_path, call, want):
    root = os.path.dirname(os.path.dirname(os.path.abspath(pd.__file__)))
    shutil.copytree(root, tmp_path / "docflow", copy_function=shutil.copyfile)  # copies no rights
    code = f"from docflow.plans.queries import _engine; print(_engine().{call})"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert ran.stdout.strip().split("\n")[-1] == want, ran.stderr


def test_reading_order_passes_over_empty_words(spark):
    w = lambda t, b, ln: (t, (0.0, 0.0, 1.0, 1.0), b, ln, 1)
    rows = [("p", [w("a", 0, 0), w("", 1, 1), w("b", 1, 1), w("c", 1, 2), w(None, 1, 2), w("d", 1, 2)]), ("q", []), ("r", None)]
    pages = spark.createDataFrame(rows, "id string, words array<struct<text:string,box:struct<x0:double,y0:double,x1:double,y1:double>,block:int,line:int,conf:int>>")
    native = values(pd.reading_order_text(pages, ["id"]), "id", "text")
    assert native == [("p", "a\n\nb\nc d"), ("q", ""), ("r", "")]
    assert values(pd.assembled(pages, ["id"]), "id", "text") == native


def test_session_helpers(spark):
    stage = Stage(spark)
    small = stage.put(spark.range(10))
    assert small.count() == 10 and "broadcast" in broadcast_if_small(small)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(small, 1)._jdf.queryExecution().logical().toString().lower()
    stage.drop(small)
    stage.clear()
