"""Kernels without Spark: golden vectors and properties."""

import io
import math
import struct
import sys
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.errors import DocflowError
from docflow.kernels import chunking as ck
from docflow.kernels import embedding as emb
from docflow.kernels import images, ooxml, pdf_layout, pdf_reader, process
from docflow.kernels.html_text import html_text
from docflow.kernels.text_norm import normalize_whitespace
from docflow.kernels.utf8 import decode_lossy


def spans(text, *args, units=None, **kw):
    return [(c.start_byte, c.end_byte, c.token_count) for c in ck.split(text, ck.ChunkConfig(*args, **kw), units)]


def test_chunk_vectors():
    text = "alpha alpha\n\nbravo bravo\n\ncharlie charlie\n\ndelta delta"
    assert spans(text, 8, 4) == [(0, 26, 8), (13, 26, 4), (26, 54, 8)]
    assert spans(text, 8, no_overlap=True) == [(0, 26, 8), (26, 54, 8)]
    bars = lambda d: [(0, 5), (5, 10), (10, 15), (15, 19)]
    assert spans("aaaa|bbbb|cccc|dddd", 3, no_overlap=True, boundaries=bars) == [(0, 5, 2), (5, 10, 2), (10, 19, 3)]
    cuts = [0, 149, 299, 449, 599, 749, 899]
    assert [s[:2] for s in spans(("sentence here. " * 60).strip(), 40, no_overlap=True)] == list(zip(cuts, cuts[1:]))
    assert spans("語" * 20, 1, no_overlap=True) == [(k, k + 12, 1) for k in range(0, 60, 12)]
    assert spans("   hello world   ") == [(3, 14, 3)]
    assert spans("") == spans(None) == spans(" \n\u2003 ") == []


def test_segmentations():
    assert len(ck.headings(b"# A\nalpha\n\n## B\nbeta\n\n# C\ngamma\n")) == 3
    text = b"preamble\n\nTitle\n=====\nbody text\n\n## Sub\nmore\n"
    assert [text[a:b].split(b"\n")[0] for a, b in ck.headings(text)] == [b"preamble", b"Title", b"## Sub"]
    assert len(ck.headings(b"```\n# a\n# b\n```\nx")) == 1
    assert ck.headings(b"####### seven\n    # indented\n") == ck.paragraphs(b"####### seven\n    # indented\n")
    assert len(ck.paragraphs(b"first\n\nsecond\n\n\nthird")) == len(ck.paragraphs(b"first\r\n\nsecond\n\r\nthird")) == 3
    assert ck.headings(b"") == ck.paragraphs(b"") == []
    # Spans that aren't valid count as one unit.
    assert spans("añb", 9, units=[(0, 2)]) == spans("añb", 9, units=[(2, 1)]) == spans("añb", 9, units=[]) == [(0, 4, 1)]


def test_fenced_code_is_cut_at_lines():
    code = "```\n" + "".join(f"line {k} of code\n" for k in range(30)) + "```\n"
    found = ck.split("intro\n" + code + "outro", ck.ChunkConfig(20, no_overlap=True))
    assert "".join(c.text for c in found) == "intro\n" + code + "outro"
    assert all(c.text.endswith("\n") for c in found[:-1])


@settings(max_examples=120, deadline=None)
@given(
    st.text(alphabet=st.sampled_from("ab é語😀.!?\n\r\t `#-= "), max_size=400),
    st.integers(1, 30), st.integers(0, 20), st.sampled_from(list(ck.BOUNDARIES.values())),
)
def test_chunk_properties(text, budget, overlap, boundaries):
    data = text.encode()
    cfg = ck.ChunkConfig(budget, overlap, overlap == 0, boundaries)
    found = ck.split(text, cfg)
    starts = [c.start_byte for c in found]
    assert [c.chunk_index for c in found] == list(range(len(found)))
    assert all(data[c.start_byte : c.end_byte].decode() == c.text for c in found)
    assert all(a < b for a, b in zip(starts, starts[1:]))
    if overlap == 0 and found:
        trimmed = normalize_edges(text)
        assert "".join(c.text for c in found) == trimmed


def normalize_edges(text):
    from docflow.kernels.text_norm import utrim

    return utrim(text)


def test_text_kernels():
    assert normalize_whitespace("  hello  \n\n\n  world  ") == "hello\n\nworld"
    assert normalize_whitespace("\n  \n\t\n") == ""
    assert decode_lossy(b"\xff\xffA\xe4\xb8") == "\ufffdA\ufffd"
    seen = lambda h: normalize_whitespace(html_text(h))
    assert seen("<h1>Title</h1><p>First para.</p><p>Second para.</p>") == "Title\n\nFirst para.\n\nSecond para."
    assert seen("<p>line one<br>line two</p>") == "line one\nline two"
    assert seen("<p><b>Hello</b>world</p>") == "Hello world"
    assert seen("<p>a <b>b</b> c</p>") == "a  b  c"
    assert seen("") == seen(None) == seen("<head><title>x</title></head>") == seen("<script>x='</p>'</script>") == ""
    assert seen("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>") == "a\n\nb\n\n1 2\n\n3"
    assert seen("<p>a<!-- c -->b</p>") == "a b"
    assert seen("a &amp; b &copy;</div>") == "a & b ©"


def archive(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return data.getvalue()


def slide(text):
    return f'<s xmlns:a="u"><a:p><a:t>{text}</a:t></a:p></s>'


def deck(order, files, extra=None):
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    ids = "".join(f'<p:sldId r:id="r{k}"/>' for k in order)
    rels = "".join(f'<Relationship Id="r{k}" Type="t" Target="slides/slide{k}.xml"/>' for k in order)
    parts = {f"ppt/slides/slide{k}.xml": slide(t) for k, t in files.items()}
    if order:
        parts["ppt/presentation.xml"] = f'<p:presentation xmlns:p="p" xmlns:r="{office}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>'
        parts["ppt/_rels/presentation.xml.rels"] = f"<Relationships>{rels}</Relationships>"
    return archive(parts | (extra or {}))


def test_office_archives():
    doc = archive({"word/document.xml": slide("First")[:-4] + "<a:p xmlns:a='u'><a:r><a:t>Sec</a:t></a:r><a:t>ond</a:t></a:p></s>"})
    assert ooxml.docx_text(doc) == "First\n\nSecond"
    assert ooxml.docx_text(archive({"word/document.xml": ""})) == ""
    assert ooxml.pptx_text(deck([], {10: "ten", 2: "two", 1: "one"})) == "one\n\ntwo\n\nten"
    assert ooxml.pptx_text(deck([3, 1, 2], {1: "alpha", 2: "bravo", 3: "charlie"})) == "charlie\n\nalpha\n\nbravo"
    assert ooxml.pptx_text(deck([2, 1], {1: "alpha", 2: "bravo", 3: "orphan"})) == "bravo\n\nalpha\n\norphan"
    notes = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/notesSlide"
    dangling = {"ppt/slides/_rels/slide1.xml.rels": f'<Relationships><Relationship Id="n" Type="{notes}" Target="../gone.xml"/></Relationships>'}
    for broken in (b"no zip", archive({"x": "y"}), archive({"word/document.xml": "<a><b>"})):
        with pytest.raises(DocflowError) as e:
            ooxml.docx_text(broken)
        assert e.value.is_malformed
    for data, budget in ((deck([1], {1: "a"}, dangling), 1 << 20), (deck([1], {1: "a" * 100}), 50), (archive({"x": "y"}), 9)):
        with pytest.raises(DocflowError):
            ooxml.pptx_text(data, budget)


HEADER = "\t".join(pdf_layout.TSV_HEADER)


def tsv(*rows):
    return "\n".join([HEADER, *("\t".join(map(str, r)) for r in rows)]) + "\n"


def word_row(par, block, line, text="w", page=1, conf=90):
    return (5, page, par, block, line, 0, 1, 2, 3, 4, conf, text)


PAGE_ROW = (1, 1, 0, 0, 0, 0, 0, 0, 612, 792, -1, "x")


def test_word_tables():
    rows = [PAGE_ROW, word_row(0, 0, 0), word_row(0, 0, 1), word_row(0, 1, 0), word_row(1, 0, 0, "a\tb")]
    words = pdf_layout.parse_tsv(tsv(*rows))[0][1]
    assert [(w["block"], w["line"]) for w in words] == [(0, 0), (0, 1), (1, 2), (2, 3)] and words[-1]["text"] == "a\tb"
    assert [pdf_layout.clamp_conf(x) for x in (-1, 87.6, 1e300)] == [-1, 88, 100]
    bad = ["", "x\n", tsv((9, *PAGE_ROW[1:])), tsv(word_row(0, 0, 0)), tsv((1, 2, *PAGE_ROW[2:])), tsv(PAGE_ROW, PAGE_ROW), tsv(PAGE_ROW, (5, 2, 3))]
    bad += [tsv(PAGE_ROW, word_row(0, 0, 0, conf=c)) for c in ("nan", "inf", "1_0", " 1", "x")] + [tsv(PAGE_ROW, word_row("1.0", 0, 0))]
    bad += [tsv(PAGE_ROW, (5, 1, 0, 0, 0, 0, 1, 2, -3, 4, 9, "w")), tsv(PAGE_ROW, (5, 1, 0, 0, 0, 0, 1e308, 2, 1e308, 4, 9, "w"))]
    for text in bad:
        with pytest.raises(ValueError):
            pdf_layout.parse_tsv(text)


def test_geometry():
    def info(*turns, boxes=None):
        lines = [f"Pages: {len(turns)}"]
        for k, t in enumerate(turns, 1):
            lines += [f"Page {k} rot: {t}", f"Page {k} CropBox: {(boxes or {}).get(k, '0 0 612 792')}"]
        return "\n".join(lines)

    turns = (0, 90, -90, 450, -180, 720, 270)
    _, pages = pdf_layout.parse_geometry(info(*turns), 1, 99)
    assert [p["rotation"] for p in pages] == [0, 90, 270, 90, 180, 0, 270]
    assert [p["width"] for p in pages] == [612, 792, 792, 792, 612, 612, 792]
    bad = ["", info(0) + "\nPages: 1", info(0) + "\nPage 1 rot: 0", info(45), info("x"), info(0, boxes={1: "0 0 0 9"}), info(0, boxes={1: "0 0 nan 9"}), "Pages: 2\nPage 1 rot: 0\nPage 1 CropBox: 0 0 9 9"]
    for text in bad:
        with pytest.raises(ValueError):
            pdf_layout.parse_geometry(text, 1, 99)
    assert pdf_layout.split_pages("alpha\f\fcharlie\f") == [(1, "alpha"), (2, ""), (3, "charlie")]
    assert pdf_layout.split_pages("alpha\fbravo") == [(1, "alpha"), (2, "bravo")] and pdf_layout.split_pages("") == []


def word(text, x0, y0, x1, y1, block=0, line=0):
    return {"text": text, "box": {"x0": x0, "y0": y0, "x1": x1, "y1": y1}, "block": block, "line": line, "conf": 90}


coordinate = st.one_of(st.floats(-100, 700), st.sampled_from([math.nan, math.inf, -math.inf, 1e300]))


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.builds(word, st.text(max_size=5), coordinate, coordinate, coordinate, coordinate, st.integers(0, 2), st.integers(0, 3)), max_size=12),
    st.sampled_from([0.25, 0.5, 1, 5, -1, math.nan]), st.sampled_from([0, 1, 8, 99]),
)
def test_assembly_finds_every_word(words, overlap, gap):
    for text, spans in (
        pdf_layout.assemble_reading_order(words),
        pdf_layout.assemble_rows(words, pdf_layout.AssembleOptions(overlap, gap)),
    ):
        data = text.encode("utf-8", "surrogatepass")
        assert [data[s["start"] : s["end"]].decode("utf-8", "surrogatepass") for s in spans] == [w["text"] for w in words]
        assert len(text) <= sum(len(w["text"]) for w in words) + 34 * len(words)


def test_rows():
    words = [word("Beginning", 0, 0, 45, 10), word("balance", 50, 0, 85, 10), word("Ending", 0, 20, 30, 30), word("1,000.00", 300, 1, 340, 11, 1, 1)]
    assert pdf_layout.assemble_rows(words)[0] == "Beginning balance" + " " * 8 + "1,000.00\nEnding"
    assert pdf_layout.assemble_rows([word("a", 0, 0, 9, 10), word("b", 20, 7, 29, 17)])[0] == "a\nb"
    wide = pdf_layout.AssembleOptions(0.25)
    assert "\n" not in pdf_layout.assemble_rows([word("a", 0, 0, 9, 10), word("b", 20, 7, 29, 17)], wide)[0]


def test_each_row_has_its_own_unit():
    title = [word("GREAT", 0, 0, 150, 40), word("TITLE", 210, 0, 360, 40)]  # 30 points a character
    body = [word("small", 0, 60, 25, 70), word("print", 65, 60, 90, 70)]  # 5 points a character
    assert pdf_layout.units_of(title + body) == [30.0, 5.0]
    assert pdf_layout.assemble_rows(title + body)[0] == "GREAT  TITLE\nsmall" + " " * 8 + "print"
    assert pdf_layout.char_unit([word("ab", math.nan, 0, 20, 9), word("c", 0, 0, math.inf, 9), word("", 0, 0, 9, 9)]) == 10.0


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + b"\x08\x02\0\0\0"


def test_images():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\x03"
    assert images.header(png(3, 4)) == ("png", 3, 4) and images.header(jpeg) == ("jpeg", 40, 30)
    assert images.check_header(png(100, 50), "png", 101, 50, 100) == (100, 50)
    for args in ((b"", "png", 1, 1, 9), (png(10, 5), "jpeg", 10, 5, 99), (png(10, 5), "png", 12, 5, 99), (png(10, 5), "png", 10, 5, 9)):
        with pytest.raises(ValueError):
            images.check_header(*args)


def script(tmp_path, body):
    path = tmp_path / "tool"
    path.write_text(f"#!/bin/sh\n{body}\n")
    path.chmod(0o755)
    return str(path)


@pytest.mark.parametrize(
    "body, code",
    [("echo bad >&2; exit 3", "MALFORMED_SOURCE"), ("kill -ABRT $$", "ENGINE_CRASHED"), ("yes", "OUTPUT_TOO_LARGE"), ("sleep 9", "MALFORMED_SOURCE"), (None, "ENGINE_UNAVAILABLE")],
)
def test_process_outcomes(tmp_path, body, code):
    program = script(tmp_path, body) if body else "no-such-program"
    with pytest.raises(DocflowError) as e:
        process.run(process.Run(program, [], b"in", timeout=1.0, max_output=1000))
    assert e.value.code == code


def test_process_success_and_order(tmp_path):
    assert process.run(process.Run(script(tmp_path, "cat; echo end"), [], b"in ")) == b"in end\n"
    with pytest.raises(process.Cancelled):
        process.run(process.Run(script(tmp_path, "sleep 9"), [], cancelled=lambda: True))
    with pytest.raises(KeyError):
        process.run(process.Run(script(tmp_path, "yes"), [], max_output=1 << 30), lambda block: {}["x"])


def test_plain_reader():
    stream = zlib.compress(b"BT (Hello \\(x\\)) Tj 0 -12 Td [(Wor) -20 (ld)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R 5 0 R]>>endobj 3 0 obj<</Type/Page/Contents 4 0 R>>endobj 5 0 obj<</Type/Page>>endobj 4 0 obj<</Filter/FlateDecode>>stream\n" + stream + b"\nendstream endobj"
    assert pdf_reader.read_pages(pdf) == [(1, "Hello (x)\nWorld\n")]
    with pytest.raises(ValueError):
        pdf_reader.read_pages(b"nothing")


def batches(n, cfg, client):
    groups = {}
    for pos, b in emb.pack_batches(((k, 100) for k in range(n)), cfg):
        groups.setdefault(b, []).append((pos, "POISON" if pos == 2 else f"t{pos}", ""))
    out = emb.BatchResult()
    for g in groups.values():
        emb.embed_batch(client, g, cfg, out)
    return [len(g) for g in groups.values()], out


def test_embedding_batches():
    assert batches(5, emb.EmbedConfig(max_batch_inputs=2), emb.HashEmbedder())[0] == [2, 2, 1]
    assert batches(5, emb.EmbedConfig(max_batch_tokens=250), emb.HashEmbedder())[0] == [2, 2, 1]
    refuse = lambda r: emb.ClientError("no", True) if any(t == "POISON" for _, t, _ in r.inputs) else None
    _, out = batches(4, emb.EmbedConfig(), emb.HashEmbedder(fail=refuse))
    assert sorted(out.vectors) == [0, 1, 3] and out.failures == [([2], "CLIENT_ERROR", "no", True)]
    _, out = batches(3, emb.EmbedConfig(disable_bisect=True), emb.HashEmbedder(fail=refuse))
    assert not out.vectors and out.failures[0][0] == [0, 1, 2]
    for corrupt in (lambda a: a[1:], lambda a: a + a[:1], lambda a: [("in-9", a[0][1]), *a[1:]]):
        _, out = batches(2, emb.EmbedConfig(), emb.HashEmbedder(corrupt=corrupt))
        assert [f[1] for f in out.failures] == ["EMBED_RESPONSE_MISMATCH"] and out.calls == 1
    assert emb.hash_vector("a") == emb.hash_vector("a") != emb.hash_vector("b")
    assert all(-1 <= x < 1 for x in emb.hash_vector("x", 64))


assert sys.version_info >= (3, 10)
