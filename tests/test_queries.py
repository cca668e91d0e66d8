"""Registered queries against their SQL, on the smallest tables where there are any."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from docflow.plans import standins
from docflow.plans.oracles import SQL
from docflow.plans.queries import QUERIES

DATA = os.environ.get("DOCFLOW_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = db.sql(SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[k]) for k in at)) for r in result.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_pdf_extract_takes_every_document(spark, db):
    got = sorted(r.id for r in QUERIES["pdf_extract"](spark, DATA).select("id").distinct().collect())
    assert got == sorted(str(x) for (x,) in db.sql("select doc_id from documents").fetchall())


def test_a_volume_without_layout_is_a_row_with_its_error(spark, monkeypatch):
    monkeypatch.setattr(standins, "INFO", ("no-such-program",))
    got = QUERIES["pdf_program_layout"](spark, DATA).collect()
    assert got and {(r.error, r.page) for r in got} == {("ENGINE_UNAVAILABLE", None)}


def naive_chunks(text, budget, overlap):
    """Chunks by plain loops: paragraphs packed, those over the budget cut at a sentence, a blank or a character."""
    size = lambda b: (len(b.decode()) + 3) // 4
    whole = text.encode()
    data = text.strip().encode()
    off = len(whole) - len(text.lstrip().encode())
    units, at = [], 0
    while at < len(data):
        end = data.find(b"\n\n", at)
        end = len(data) if end < 0 else end + 2
        while end < len(data) and data[end : end + 1] == b"\n":
            end += 1
        units.append((at, end))
        at = end
    sizes = [size(data[a:b]) for a, b in units]
    out, i = [], 0
    while i < len(units):
        a, b = units[i]
        if sizes[i] > budget:
            ratio = (b - a) / sizes[i]
            window, back, at = int(budget * ratio), int(overlap * ratio), a
            while at < b:
                stop = at + window
                if stop >= b:
                    stop = b
                else:
                    low = stop - (stop - at) // 4
                    marks = [k for k in range(low, stop - 1) if data[k : k + 1] in (b".", b"!", b"?") and data[k + 1 : k + 2] == b" "]
                    blanks = [k for k in range(low, stop) if data[k : k + 1] in (b" ", b"\n")]
                    stop = marks[-1] + 1 if marks else blanks[-1] if blanks else stop
                while stop < len(data) and data[stop] & 0xC0 == 0x80:
                    stop -= 1
                out.append((at + off, stop + off, size(data[at:stop])))
                if stop == b:
                    break
                at = max(stop - back, at + 1)
                while data[at] & 0xC0 == 0x80:
                    at += 1
            i += 1
            continue
        j = i
        while j + 1 < len(units) and sum(sizes[i : j + 2]) <= budget:
            j += 1
        out.append((a + off, units[j][1] + off, sum(sizes[i : j + 1])))
        if j == len(units) - 1:
            break
        i, last = j + 1, i
        while i - 1 > last and sum(sizes[i - 1 : j + 1]) <= overlap:
            i -= 1
    return out


@pytest.mark.parametrize(("name", "overlap"), [("chunk_pack", 0), ("chunk_pack_overlap", 150)])
def test_texts_with_large_paragraphs_are_packed_whole(spark, tmp_path, name, overlap):
    small = lambda n: "wörd " * (n - 1) + "end."
    large = "Ein Satz über nichts. " * 150
    solid = "é" * 2500 + "x" * 801
    texts = {
        "before": "\n\n".join([small(60), small(70), large.strip(), small(50), small(40)]),
        "twice": "  " + "\n\n".join([large.strip(), solid, small(90), small(90), small(90), small(300), small(200), large.strip()]) + "\n ",
        "only": solid,
        "words": "\n\n\n".join([small(30), "word " * 900, small(30)]),
        "small": "\n\n".join(small(80) for _ in range(9)),
        "blank": " \n ",
    }
    rows = [(k, t) for k, t in texts.items()] + [("before", texts["before"]), (None, "x"), ("none", None)]
    spark.createDataFrame(rows, "id string, text string").write.parquet(str(tmp_path / "artifacts.parquet"))
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    want = sorted((k, n, a, b, t) for k, text in texts.items() if text.strip() for n, (a, b, t) in enumerate(naive_chunks(text, 400, overlap)))
    assert got == want
