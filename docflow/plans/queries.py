"""Registered queries over the project's tables: name -> (spark, folder) -> DataFrame.

Each has its SQL in :mod:`docflow.plans.oracles` under the same name where SQL can express it.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.functions import pdf as page
from docflow.functions import text as tx
from docflow.functions.media import canonical, is_valid
from docflow.kernels.chunking import atx_level, fence_of, is_setext
from docflow.kernels.embedding import ClientError, EmbedConfig, HashEmbedder, hash_vector
from docflow.kernels.ooxml import DOCX, PPTX, Archive, slide_names
from docflow.kernels.pdf_layout import TSV_HEADER
from docflow.operators import chunk as ch
from docflow.operators import content as ct
from docflow.operators import embed as em
from docflow.operators import extract as ex
from docflow.operators import pdf as pd
from docflow.plans import standins
from docflow.session import broadcast_if_small, table
from docflow.sources import objects as ob

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *(columns or ("text",)))


def store(spark: SparkSession, d: str) -> DataFrame:
    """Distinct objects, the latest listing of each key."""
    rows = table(spark, d, "store_objects").filter("object_key is not null")
    return rows.groupBy(F.col("object_key").alias("key")).agg(F.max("size").alias("size"), F.max("created").alias("created"))


def source_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").filter("raw.key is not null").select(F.col("raw.key").alias("key")).distinct()


# -- scalar functions ----------------------------------------------------------------------------------


@query
def content_hash(spark, d):
    return ct.hashed(docs(spark, d)).select("doc_id", "hash", F.col("n_bytes").cast("bigint").alias("n_bytes"))


@query
def token_estimate(spark, d):
    return docs(spark, d).select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query
def media_canonical(spark, d):
    kinds = table(spark, d, "sources").select("media_type").union(table(spark, d, "artifacts").select("media_type")).distinct()
    return kinds.select("media_type", canonical(F.col("media_type")).alias("canonical"), is_valid(F.col("media_type")).alias("valid"))


@query
def normalize_whitespace(spark, d):
    return docs(spark, d).select("doc_id", tx.normalize_whitespace(F.col("text")).alias("normal"))


@query
def front_matter(spark, d):
    """Front matter of either kind before every third document, unclosed before another third."""
    head = F.when(F.col("doc_id") % 3 == 0, "---\ntitle: x\n---\n").when(F.col("doc_id") % 3 == 1, "+++\nopen\n").otherwise("+++ \na = 1\n+++\n")
    made = docs(spark, d).filter("text is not null").select("doc_id", F.concat(head, "text").alias("t"))
    return made.select("doc_id", tx.strip_front_matter(F.col("t")).alias("body"))


@query
def bom_strip(spark, d):
    made = docs(spark, d).select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "\ufeff").otherwise(""), "text").alias("t"))
    return made.select("doc_id", F.char_length(tx.strip_bom(F.col("t"))).alias("n"))


@query
def request_ids(spark, d):
    return em.distinct_inputs(table(spark, d, "inputs")).select("pos", tx.request_id(F.col("pos")).alias("request_id"))


@query
def utf8_repair(spark, d):
    """Texts with broken bytes between them come out with one mark for each break."""
    rows = docs(spark, d).filter("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.lit("text/plain").alias("media_type"), "text")
    broken = rows.withColumn("content", F.concat(F.lit(b"a\xff\xfe"), F.col("text").cast("binary"), F.lit(b"\xe4\xb8 z")))
    out = ex.extract(broken, ex.preset())
    return out.select(F.col("derived_from").alias("id"), tx.sha256_hex(F.col("text")).alias("hash"))


# -- validation and provenance -------------------------------------------------------------------------


@query
def source_validate(spark, d):
    return ct.validate_sources(table(spark, d, "sources")).groupBy("error").agg(F.count("*").alias("n"))


@query
def artifact_validate(spark, d):
    return ct.validate_artifacts(table(spark, d, "artifacts")).select("id", "error").distinct()


@query
def text_artifacts(spark, d):
    return ct.text_artifacts(table(spark, d, "artifacts")).select("id").distinct()


@query
def text_artifact(spark, d):
    """Each document's text as an artifact of a parent that is named after it."""
    made = docs(spark, d).filter("text is not null").select(ct.text_artifact(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("text")).alias("a"))
    return made.select("a.derived_from", "a.id", "a.media_type", F.col("a.blob").isNull().alias("no_blob"), F.char_length("a.text").alias("length"))


@query
def single_text_artifact(spark, d):
    artifacts = table(spark, d, "artifacts").dropDuplicates(["id"])
    return ct.single_text_artifact(artifacts).select("derived_from", "n", F.char_length("text").alias("length"), "error")


@query
def provenance_children(spark, d):
    return ct.children(table(spark, d, "artifacts"))


@query
def provenance_roots(spark, d):
    return ct.provenance(table(spark, d, "artifacts"))


@query
def provenance_sources(spark, d):
    """Artifacts whose direct parent is a source, and those whose parent is unknown."""
    arts = table(spark, d, "artifacts").select("id", "derived_from").distinct()
    known = table(spark, d, "sources").select(F.col("id").alias("derived_from")).distinct().withColumn("is_source", F.lit(True))
    joined = arts.join(known, "derived_from", "left")
    return joined.select("id", F.coalesce("is_source", F.lit(False)).alias("from_source"))


# -- extraction ----------------------------------------------------------------------------------------


@query
def registry_supports(spark, d):
    registry = ex.preset()
    return table(spark, d, "sources").select("id", registry.supports(F.col("media_type")).alias("supported")).distinct()


@query
def registry_dispatch(spark, d):
    """The guard's verdict on every source, by its stored size: a join with the listing."""
    registry = ex.preset(max_bytes=4_000_000)
    sizes = store(spark, d).select(F.col("key").alias("raw_key"), "size")
    rows = table(spark, d, "sources").select("id", "media_type", F.col("raw.key").alias("raw_key")).distinct()
    joined = rows.join(broadcast_if_small(sizes), "raw_key", "left")
    return joined.select("id", "media_type", ex.guard(F.col("id"), F.col("media_type"), F.col("size"), registry).alias("error")).distinct()


@query
def size_guard(spark, d):
    return docs(spark, d).filter(F.octet_length("text") > 4096).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))


def _as_sources(spark, d, media_type: str, content) -> DataFrame:
    return docs(spark, d).filter("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.lit(media_type).alias("media_type"), content.alias("content"))


@query
def text_extract(spark, d):
    out = ex.extract(_as_sources(spark, d, "Text/Plain; charset=utf-8", F.col("text")), ex.preset())
    return out.select(F.col("derived_from").alias("id"), "text", "error")


@query
def markdown_extract(spark, d):
    content = F.concat(F.lit("\ufeff---\nk: v\n---\n"), "text")
    out = ex.extract(_as_sources(spark, d, "text/markdown", content), ex.preset())
    return out.select(F.col("derived_from").alias("id"), "media_type", "text", "error")


@query
def html_extract(spark, d):
    """Documents set as pages, every line a paragraph; the text comes back line by line."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f]", " "), "&", "&amp;"), "<", "&lt;")
    lines = F.transform(F.split(safe, "\n", -1), lambda x: F.concat(F.lit("<p>"), x))
    body = F.array_join(lines, "</p>\n")
    html = F.concat(F.lit("<!doctype html><html><head><title>t</title><style>p{}</style></head><body><script>var x = '</p>';</script>"), body, F.lit("</body></html>"))
    out = ex.extract(_as_sources(spark, d, "text/html", html), ex.preset())
    return out.select(F.col("derived_from").alias("id"), F.md5(F.encode(F.regexp_replace("text", r"\s+", ""), "utf-8")).alias("letters"), "error")


def _archives(spark, d, media_type: str, build) -> DataFrame:
    rows = docs(spark, d).filter("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.regexp_replace("text", r"[^\x09\x0a\x20-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]", " ").alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([build(t) for t in batch.column("text").to_pylist()], pa.binary())], names=["id", "content"])

    made = rows.mapInArrow(run, "id string, content binary")
    out = ex.extract(made.withColumn("media_type", F.lit(media_type)), ex.preset())
    return out.select(F.col("derived_from").alias("id"), tx.sha256_hex(F.col("text")).alias("hash"), "error")


def _zip(parts: dict[str, str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return data.getvalue()


def _runs(text: str) -> str:
    return "".join(f"<a:p><a:r><a:t>{escape(line)}</a:t></a:r></a:p>" for line in text.split("\n"))


@query
def docx_extract(spark, d):
    return _archives(spark, d, DOCX, lambda t: _zip({"word/document.xml": f'<a:document xmlns:a="urn:w"><a:body>{_runs(t)}</a:body></a:document>'}))


@query
def pptx_extract(spark, d):
    """The second line is on the second slide, whose file comes first; the notes hold the rest."""

    def build(text: str) -> bytes:
        lines = text.split("\n")
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        rel = lambda i, t, to: f'<Relationship Id="{i}" Type="{office}/{t}" Target="{to}"/>'
        sheet = lambda t: f'<s xmlns:a="urn:a">{_runs(t)}</s>'
        return _zip(
            {
                "ppt/presentation.xml": f'<p:presentation xmlns:p="urn:p" xmlns:r="{office}"><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
                "ppt/_rels/presentation.xml.rels": f"<Relationships>{rel('r1', 'slide', 'slides/slide1.xml')}{rel('r2', 'slide', 'slides/slide2.xml')}</Relationships>",
                "ppt/slides/slide2.xml": sheet(lines[0]),
                "ppt/slides/slide1.xml": sheet("\n".join(lines[1:2])),
                "ppt/slides/_rels/slide1.xml.rels": f"<Relationships>{rel('n', 'notesSlide', '../notesSlides/notesSlide1.xml')}</Relationships>",
                "ppt/notesSlides/notesSlide1.xml": sheet("\n".join(lines[2:])),
            }
        )

    return _archives(spark, d, PPTX, build)


@query
def pdf_extract(spark, d):
    """Pages of documents generated from every row, read by the built-in engine; a null text makes an empty page."""

    def build(text: str) -> bytes:
        shown = text.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")
        stream = b"BT " + b" ".join(b"(%s) Tj T*" % ln for ln in shown.split(b"\n")) + b" ET"
        return b"%%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]>>endobj\n3 0 obj<</Type/Page/Contents 4 0 R>>endobj\n4 0 obj<</Length %d>>stream\n%s\nendstream endobj\n%%%%EOF" % (len(stream), stream)

    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([build(t) for t in batch.column("text").to_pylist()], pa.binary())], names=["id", "content"])

    made = rows.mapInArrow(run, "id string, content binary").withColumn("media_type", F.lit("application/pdf"))
    out = ex.extract(made, ex.preset(pd.PlainEngine()))
    return out.select(F.col("derived_from").alias("id"), F.col("metadata")["pdf.page"].alias("page"), F.char_length("text").alias("length"), "error")


# -- chunking ------------------------------------------------------------------------------------------


def _texts(spark, d) -> DataFrame:
    """Artifacts' texts, one a key."""
    return table(spark, d, "artifacts").filter("text is not null and id is not null").groupBy("id").agg(F.min("text").alias("text"))


@query
def paragraph_units(spark, d):
    return ch.segments(_texts(spark, d), ["id"])


@query
def heading_units(spark, d):
    return ch.segments(_texts(spark, d), ["id"], boundaries="headings")


@query
def line_marks(spark, d):
    return ch.line_marks(_texts(spark, d), ["id"])


@query
def line_marks_kernel(spark, d):
    """The same marks by the chunking kernel."""
    lines = _texts(spark, d).select("id", F.posexplode(F.split("text", r"\r?\n", -1)).alias("n", "line"))

    def run(batches):
        for b in batches:
            lines = [x.encode() for x in b.column("line").to_pylist()]
            columns = [pa.array([atx_level(x) for x in lines], pa.int32()), pa.array([is_setext(x) for x in lines]), pa.array([fence_of(x) is not None for x in lines])]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), *columns], names=["id", "n", "atx", "setext", "fence"])

    return lines.mapInArrow(run, "id string, n int, atx int, setext boolean, fence boolean").filter("atx > 0 or setext or fence")


def _spans(df: DataFrame) -> DataFrame:
    return df.select("id", "chunk_index", "start_byte", "end_byte", "token_count")


@query
def chunk_pack(spark, d):
    """Paragraphs packed without overlap, those over the budget cut."""
    return _spans(ch.chunk(_texts(spark, d), ["id"], max_tokens=400, no_overlap=True))


@query
def chunk_pack_overlap(spark, d):
    return _spans(ch.chunk(_texts(spark, d), ["id"], max_tokens=400, overlap_tokens=150))


@query
def chunk_small(spark, d):
    small = ch.small_chunks(docs(spark, d).filter(~tx.is_blank(F.col("text"))), max_tokens=384)
    out = ch.chunk(small.withColumn("text", tx.normalize_whitespace(F.col("text"))), ["doc_id"], boundaries="paragraphs")
    return out.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("end_byte").alias("end_byte"))


@query
def chunk_hard_split(spark, d):
    """Texts without paragraphs, cut at sentences and words."""
    flat = docs(spark, d).select("doc_id", F.regexp_replace("text", r"\n+", " ").alias("text"))
    return ch.chunk(flat, ["doc_id"], max_tokens=96, overlap_tokens=16)


@query
def chunk_defaults(spark, d):
    """Documents under the default budget and overlap."""
    return ch.chunk(docs(spark, d), ["doc_id"]).select("doc_id", "chunk_index", "start_byte", "end_byte", "token_count")


@query
def chunk_headings(spark, d):
    return ch.chunk(_texts(spark, d), ["id"], max_tokens=256, overlap_tokens=32, boundaries="headings")


@query
def chunk_fenced(spark, d):
    """Code around and within fences, cut at lines."""
    code = F.concat(F.lit("intro\n```\n"), F.regexp_replace("text", r"(?<=[.;]) ", "\n"), F.lit("\n```\nend"))
    return ch.chunk(docs(spark, d).select("doc_id", code.alias("text")), ["doc_id"], max_tokens=64, overlap_tokens=8)


@query
def chunk_pages(spark, d):
    """Pages as the caller's own units."""
    pages = _page_texts(spark, d).filter(~tx.is_blank(F.col("text")))
    units = ch.turn_units(pages.select(_volume(), "page_no", tx.utrim(F.col("text")).alias("text")), "source_id", "page_no", "text")
    return ch.chunk(units, ["source_id"], max_tokens=900, no_overlap=True, units="units").select("source_id", "chunk_index", "start_byte", "end_byte", "token_count")


@query
def chunk_integrity(spark, d):
    """Stored chunks held against their artifacts: whether the bytes of the span are the text."""
    chunks = table(spark, d, "chunks").dropDuplicates(["artifact_id", "chunk_index"])
    return ch.integrity(chunks, _texts(spark, d))


# -- embedding -----------------------------------------------------------------------------------------


@query
def embed_validate(spark, d):
    return em.distinct_inputs(table(spark, d, "inputs")).select("pos", em.input_error().alias("error"))


@query
def embed_tokens(spark, d):
    return em.distinct_inputs(table(spark, d, "inputs")).filter(em.input_error().isNull()).select("pos", em.input_tokens().cast("int").alias("tokens"))


def _valid_sizes(spark, d) -> DataFrame:
    return em.distinct_inputs(table(spark, d, "inputs")).filter(em.input_error().isNull()).select("pos", em.input_tokens().alias("tokens"))


@query
def embed_batches(spark, d):
    return em.batch_ids(_valid_sizes(spark, d)).select("pos", "batch_id")


@query
def embed_batches_by_count(spark, d):
    return em.batch_ids(_valid_sizes(spark, d), EmbedConfig(max_batch_inputs=32, max_batch_tokens=1 << 40)).select("pos", "batch_id")


def _embedder():
    return HashEmbedder(8)


def _poisoned():
    refused = lambda r: ClientError("refused", retryable=True) if any(len(t) % 97 == 0 for _, t, _ in r.inputs) else None
    return HashEmbedder(8, fail=refused)


def _mismatched():
    return HashEmbedder(8, corrupt=lambda answer: answer[1:])


@query
def embed_records(spark, d):
    run = em.embed_run(table(spark, d, "inputs"), _embedder)
    return run.records.select("pos", "source_id", "artifact_id", "chunk_index", F.size("vector").alias("dims"), "token_count", "model.provider", "model.name")


@query
def embed_vectors(spark, d):
    return em.embed_run(table(spark, d, "inputs"), _embedder).records.select("pos", "vector")


@query
def embed_dimensions(spark, d):
    """The number of dimensions that is asked for reaches the client."""
    run = em.embed_run(table(spark, d, "inputs"), _embedder, EmbedConfig(dimensions=5, task="retrieval"))
    return run.records.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"))


@query
def embed_block_records(spark, d):
    """Batches by blocks of positions give the same records."""
    run = em.embed_run(table(spark, d, "inputs"), _embedder, EmbedConfig(max_batch_inputs=16), scope="block")
    return run.records.select("pos", "source_id", "artifact_id", "chunk_index", F.size("vector").alias("dims"), "token_count")


@query
def embed_poison_records(spark, d):
    return em.embed_run(table(spark, d, "inputs"), _poisoned).records.select("pos")


@query
def embed_poison_failures(spark, d):
    fails = em.embed_run(table(spark, d, "inputs"), _poisoned).failures
    return fails.select("first_pos", F.size("inputs").alias("n"), F.when(F.col("error_code") == "CLIENT_ERROR", "refused").otherwise(F.col("error_code")).alias("code"), "retryable")


@query
def embed_mismatch(spark, d):
    cfg = EmbedConfig(max_batch_inputs=50)
    fails = em.embed_run(table(spark, d, "inputs").filter(em.input_error().isNull()), _mismatched, cfg).failures
    return fails.groupBy("error_code", "retryable").agg(F.sum(F.size("inputs")).alias("inputs"))


@query
def embed_response_match(spark, d):
    """Stored records joined to their inputs by request id; each side's rows without the other are reported."""
    left = em.distinct_inputs(table(spark, d, "inputs")).select(tx.request_id(F.col("pos")).alias("request_id"), F.lit(1).alias("asked"))
    right = table(spark, d, "records").select(tx.request_id(F.col("pos")).alias("request_id")).distinct().withColumn("answered", F.lit(1))
    return left.join(right, "request_id", "full").groupBy("asked", "answered").agg(F.count("*").alias("n"))


@query
def fake_vectors(spark, d):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([hash_vector(t or "", 8) for t in b.column("text").to_pylist()], pa.list_(pa.float32()))], names=["doc_id", "vector"])

    return docs(spark, d).mapInArrow(run, "doc_id bigint, vector array<float>")


# -- object store --------------------------------------------------------------------------------------


@query
def store_get(spark, d):
    return ob.get(source_keys(spark, d), store(spark, d)).select("key", "size", "error")


@query
def store_exists(spark, d):
    return ob.exists(source_keys(spark, d), store(spark, d))


@query
def store_put(spark, d):
    new = source_keys(spark, d).select("key", F.char_length("key").cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("created"))
    return ob.put(store(spark, d), new).select("key", "size")


@query
def store_delete(spark, d):
    left, missing = ob.delete(store(spark, d), source_keys(spark, d))
    return left.select("key", F.lit("left").alias("state")).union(missing.select("key", F.lit("missing").alias("state")))


@query
def store_delete_if_exists(spark, d):
    return ob.delete_if_exists(store(spark, d), source_keys(spark, d)).select("key")


@query
def store_list(spark, d):
    return ob.list_objects(store(spark, d), "raw/0").select("key", "size")


@query
def store_range(spark, d):
    """Ranges of every document, some outside of it."""
    offset = (F.col("doc_id") * 37) % 900 - 20
    length = (F.col("doc_id") * 11) % 120 - 5
    rows = docs(spark, d).select("doc_id", F.col("text").cast("binary").alias("content"), offset.alias("offset"), length.alias("length"))
    error = ob.range_error(F.octet_length("content"), F.col("offset"), F.col("length"))
    return rows.select("doc_id", error.alias("error"), F.lower(F.hex(ob.range_bytes(F.col("content"), F.col("offset"), F.col("length")))).alias("bytes"))


def _compose(spark, d):
    """Chunks of an artifact composed in order; artifacts of more than 32 chunks are refused."""
    parts = table(spark, d, "chunks").dropDuplicates(["artifact_id", "chunk_index"])
    objects = parts.select(F.concat_ws("#", "artifact_id", F.col("chunk_index").cast("string")).alias("key"), F.col("text").alias("content"))
    requests = parts.select(F.col("artifact_id").alias("key"), F.col("chunk_index").alias("ord"), F.concat_ws("#", "artifact_id", F.col("chunk_index").cast("string")).alias("src"))
    return ob.compose(objects, requests)


@query
def store_compose(spark, d):
    done, failed = _compose(spark, d)
    rows = done.select("key", F.sha2("content", 256).alias("hash"), F.lit(None).cast("string").alias("error"))
    return rows.unionByName(failed.select("key", F.lit(None).cast("string").alias("hash"), "error"))


@query
def store_compose_levels(spark, d):
    parts = table(spark, d, "chunks").dropDuplicates(["artifact_id", "chunk_index"])
    whole = ob.compose_levels(parts.select(F.col("artifact_id").alias("key"), F.col("chunk_index").alias("ord"), F.col("text").alias("content")))
    return whole.select("key", F.sha2("content", 256).alias("hash"))


# -- pages ---------------------------------------------------------------------------------------------


def _layouts(spark, d) -> DataFrame:
    return table(spark, d, "page_layouts").groupBy("source_id", "page_no").agg(F.max(F.struct("width", "height", "rotation", "words")).alias("p")).select("source_id", "page_no", "p.*")


#: Pages of a source that are one document: of a source with more each further thousand is a volume of its own.
VOLUME = 1000


def _volume():
    return F.concat_ws("#", "source_id", F.floor(F.col("page_no") / VOLUME).cast("string")).alias("source_id")


def _page_texts(spark, d) -> DataFrame:
    return table(spark, d, "page_texts").groupBy("source_id", "page_no").agg(F.max("text").alias("text"))


@query
def pdf_split_pages(spark, d):
    """Volumes' pages joined by form feeds and split again."""
    split = _printed(spark, d).select("source_id", F.explode(page.split_pages(F.col("out"))).alias("p"))
    return split.select("source_id", F.col("p.number").alias("number"), F.sha2("p.text", 256).alias("hash"))


def _printed(spark, d) -> DataFrame:
    pages = _page_texts(spark, d).select(_volume(), "page_no", "text")
    whole = pages.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return whole.select("source_id", F.concat(F.array_join(F.col("p.text"), "\f", ""), F.lit("\f")).alias("out"))


def _numbered(spark, d) -> DataFrame:
    """Layouts of volumes, their pages numbered from 1."""
    pages = _layouts(spark, d).filter("words is not null").select(_volume(), "page_no", "width", "height", "rotation", "words")
    return pages.withColumn("number", F.row_number().over(Window.partitionBy("source_id").orderBy("page_no")))


def _tables(spark, d) -> DataFrame:
    """Word tables as a program would print them."""
    pages = _numbered(spark, d)
    show = lambda *xs: F.concat_ws("\t", *(x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs))
    head = show(F.lit(1), F.col("number"), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"), F.lit(-1), "###PAGE###")
    row = lambda w, k: show(
        F.lit(5), F.col("number"), w.block % 2, w.block, w.line, k, w.box.x0, w.box.y0, w.box.x1 - w.box.x0, w.box.y1 - w.box.y0, w.conf, w.text
    )
    body = pages.select("source_id", "number", F.array_join(F.concat(F.array(head), F.transform("words", row)), "\n").alias("t"))
    joined = body.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("number", "t"))).alias("x"))
    return joined.select("source_id", F.concat(F.lit("\t".join(TSV_HEADER) + "\n"), F.array_join(F.col("x.t"), "\n"), F.lit("\n")).alias("tsv"))


# -- Poppler's programs, for which stand-ins print what is marked for them in a document -----------------

def _engine() -> pd.PopplerEngine:
    return pd.PopplerEngine(text_program=standins.TEXT, info_program=standins.INFO, image_program=standins.IMAGE)


def _marked(text, mark: str):
    return F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)))


def _sizes(spark, d) -> DataFrame:
    line = F.format_string(
        "I:Page %4d rot:  %d\nI:Page %4d CropBox: 0.00 0.00 %s %s", "number", F.coalesce("rotation", F.lit(0)), "number", F.col("width").cast("string"), F.col("height").cast("string")
    )
    pages = _numbered(spark, d).select("source_id", "number", line.alias("line"))
    lists = pages.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("number", "line"))).alias("l"))
    return lists.select("source_id", F.concat(F.lit("I:Pages: "), F.size("l").cast("string"), F.lit("\n"), F.array_join(F.col("l.line"), "\n")).alias("sizes"))


@query
def pdf_program_pages(spark, d):
    """Volumes' texts through the text program and extraction: one artifact a page that isn't blank."""
    made = _printed(spark, d).select(F.col("source_id").alias("id"), F.lit("application/pdf").alias("media_type"), _marked(F.col("out"), "P:").alias("content"))
    out = ex.extract(made, ex.preset(_engine())).filter("error is null or error != 'NO_CONTENT'")
    return out.select(F.col("derived_from").alias("source_id"), F.col("metadata")["pdf.page"].cast("int").alias("page"), tx.sha256_hex(F.col("text")).alias("hash"), "error")


@query
def pdf_program_layout(spark, d):
    """Words and sizes of volumes through the table and information programs; a volume that fails is a row with its error."""
    made = _tables(spark, d).join(_sizes(spark, d), "source_id").select("source_id", F.concat(_marked(F.regexp_replace("tsv", r"\n\z", ""), "T:"), F.lit("\n"), F.col("sizes")).alias("content"))
    pages = pd.layouts(made, ["source_id"], _engine()).select("source_id", "error", F.explode_outer("layout.pages").alias("p"))
    return pages.select(
        "source_id", F.col("p.number").alias("page"), F.col("p.width").alias("width"), F.col("p.height").alias("height"), F.col("p.rotation").alias("rotation"),
        F.size("p.words").alias("words"), F.sha2(F.array_join(F.col("p.words.text"), " "), 256).alias("hash"), "error",
    )


@query
def pdf_program_render(spark, d):
    """The first page of each volume through the rendering program."""
    made = _sizes(spark, d).select("source_id", F.col("sizes").alias("content"))
    image = pd.renders(made, ["source_id"], _engine(), 1, dpi=300.0, max_pixels=2000)
    return image.select("source_id", F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.round("image.scale_x", 6).alias("scale_x"), "error")


@query
def pdf_tsv_words(spark, d):
    out = pd.tsv_words(_tables(spark, d), "source_id")
    return out.select("source_id", "page", "word_no", "text", F.round("x1", 4).alias("x1"), "block", "line", "conf")


@query
def pdf_tsv_kernel(spark, d):
    """The same words by the strict kernel."""
    from docflow.kernels.pdf_layout import parse_tsv

    def run(batches):
        for b in batches:
            for source, tsv in zip(b.column("source_id").to_pylist(), b.column("tsv").to_pylist()):
                rows = [(source, n, k, w["text"], round(w["box"]["x1"], 4), w["block"], w["line"], w["conf"]) for n, words in parse_tsv(tsv) for k, w in enumerate(words)]
                types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                names = ["source_id", "page", "word_no", "text", "x1", "block", "line", "conf"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names=names)

    return _tables(spark, d).mapInArrow(run, "source_id string, page int, word_no int, text string, x1 double, block int, line int, conf int")


@query
def pdf_geometry(spark, d):
    """Page sizes from listings; a page whose rotation isn't a quarter turn has none."""
    turn = (F.col("page_no") % 6) * 90 - 180 + F.when(F.col("page_no") % 11 == 0, 45).otherwise(0)
    line = F.format_string(
        "Page %4d rot:  %d\nPage %4d CropBox: %s %s %s %s", "page_no", turn, "page_no", F.lit("0.00"), F.lit("0.00"), F.col("width").cast("string"), F.col("height").cast("string")
    )
    pages = _layouts(spark, d).select(_volume(), "page_no", line.alias("line"))
    info = pages.groupBy("source_id").agg(F.concat(F.lit("Title: x\nPages:          9\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("info"))
    return pd.geometry_rows(info, "source_id")


@query
def pdf_reading_order(spark, d):
    """Assembled pages, natively."""
    out = pd.reading_order_text(_layouts(spark, d).filter("words is not null"), ["source_id", "page_no"])
    return out.select("source_id", "page_no", F.sha2("text", 256).alias("hash"))


@query
def pdf_reading_order_kernel(spark, d):
    out = pd.assembled(_layouts(spark, d).filter("words is not null"), ["source_id", "page_no"])
    return out.select("source_id", "page_no", F.sha2("text", 256).alias("hash"), F.size("spans").alias("words"))


@query
def pdf_spans(spark, d):
    """The bytes of every word in its page, assembled by rows."""
    out = pd.assembled(_layouts(spark, d).filter("words is not null"), ["source_id", "page_no"], strategy="rows")
    spans = out.select("source_id", "page_no", F.posexplode("spans").alias("word_no", "s"))
    return spans.select("source_id", "page_no", "word_no", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query
def pdf_rows(spark, d):
    out = pd.assembled(_layouts(spark, d).filter("words is not null"), ["source_id", "page_no"], strategy="rows")
    return out.select("source_id", "page_no", F.sha2("text", 256).alias("hash"), F.char_length("text").alias("length"))


@query
def pdf_char_unit(spark, d):
    """Median width of a character of each row."""
    units = pd.row_units(_layouts(spark, d), ["source_id", "page_no"])
    return units.select("source_id", "page_no", "row", F.round("unit", 6).alias("unit"))


@query
def pdf_gap_spaces(spark, d):
    """Blanks for the gap to the word before on the same line."""
    return pd.line_gaps(_layouts(spark, d), ["source_id", "page_no"], 5.0, 8)


@query
def word_conf(spark, d):
    words = _layouts(spark, d).select("source_id", "page_no", F.posexplode("words").alias("word_no", "w"))
    return words.select("source_id", "page_no", "word_no", page.clamp_conf(F.col("w.conf") * 1.5 - 0.5).alias("conf"))


@query
def render_pixel_size(spark, d):
    pages = _layouts(spark, d).select("source_id", "page_no", "width", "height")
    dpi = F.element_at(F.array(F.lit(72.0), F.lit(150.0), F.lit(300.0), F.lit(0.01)), (F.col("page_no") % 4 + 1).cast("int"))
    size = page.pixel_size(F.col("width"), F.col("height"), dpi, F.lit(2048))
    return pages.select("source_id", "page_no", size["width"].alias("w"), size["height"].alias("h"))


@query
def render_options(spark, d):
    pages = _layouts(spark, d).select("source_id", "page_no").withColumn("k", F.col("page_no") % 7)
    options = page.render_options(
        F.when(F.col("k") == 1, 0).otherwise(F.col("page_no")), F.when(F.col("k") == 2, 9).otherwise(F.col("k") % 2),
        F.when(F.col("k") == 3, -1.0).otherwise(0.0), F.when(F.col("k") == 4, 20_000).otherwise(0), F.when(F.col("k") == 5, 101).otherwise(0),
    )
    rows = pages.select("source_id", "page_no", options.alias("o"))
    return rows.select(
        "source_id", "page_no", F.col("o.dpi").alias("dpi"), F.col("o.max_pixels").alias("pixels"), F.col("o.quality").alias("quality"), F.col("o.error").alias("error"),
        page.format_name(F.col("o.format")).alias("format"), page.format_media_type(F.col("o.format")).alias("media"),
    )


@query
def layout_json(spark, d):
    """Layouts to JSON and back."""
    pages = _layouts(spark, d).select(
        _volume(), F.struct(F.col("page_no").alias("number"), "width", "height", "rotation", F.coalesce("words", F.array().cast(ct.PAGE_LAYOUT["words"].dataType)).alias("words")).alias("p")
    )
    layout = pages.groupBy("source_id").agg(F.sort_array(F.collect_list("p")).alias("pages"))
    made = layout.select("source_id", F.struct(F.lit(1).alias("version"), F.lit("pdftotext").alias("engine"), F.lit("crop").alias("box"), "pages").cast(ct.LAYOUT).alias("layout"))
    back = made.select("source_id", F.explode(pd.parse_layout_json(pd.layout_json(F.col("layout")))["pages"]).alias("p"))
    return back.select(
        "source_id", F.col("p.number").alias("page_no"), F.col("p.width").alias("width"), F.sha2(F.array_join(F.col("p.words.text"), " "), 256).alias("hash"),
        F.coalesce(F.round(F.aggregate("p.words", F.lit(0.0), lambda a, w: a + w.box.x1 + w.conf), 3), F.lit(0.0)).alias("sum"),
    )


@query
def page_zip(spark, d):
    """Layout and text of a page by its number; pages that only one side has are named."""
    return pd.zip_pages(_layouts(spark, d), table(spark, d, "page_texts"))


@query
def page_citation(spark, d):
    """The page of a source's joined text in which every 500th byte lies."""
    return pd.citations(_page_texts(spark, d), 500)


@query
def slide_order(spark, d):
    """Slides of a deck a document: named ones in the presentation's order (downwards, every third left out), then
    the others by number."""
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def deck(n: int) -> Archive:
        named = [k for k in range(n, 0, -1) if k % 3]
        order = "".join(f'<p:sldId r:id="r{k}"/>' for k in named)
        rels = "".join(f'<Relationship Id="r{k}" Type="{office}/slide" Target="slides/slide{k}.xml"/>' for k in named)
        parts = {f"ppt/slides/slide{k}.xml": "<s/>" for k in range(1, n + 1)} | {
            "ppt/presentation.xml": f'<p:presentation xmlns:p="urn:p" xmlns:r="{office}"><p:sldIdLst>{order}</p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": f"<Relationships>{rels}</Relationships>",
        }
        return Archive(_zip(parts), PPTX)

    def run(batches):
        for b in batches:
            names = [slide_names(deck(n)) for n in b.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "names"])

    decks = docs(spark, d, "n_chars").select("doc_id", (F.coalesce("n_chars", F.lit(0)) % 12 + 1).cast("int").alias("n"))
    return decks.mapInArrow(run, "doc_id bigint, names array<string>").select("doc_id", F.posexplode("names").alias("rank", "name"))


# -- the chain -----------------------------------------------------------------------------------------


@query
def flagship(spark, d):
    """Documents extracted, chunked, batched and embedded: the records."""
    sources = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("media_type", F.lit("text/plain")).alias("media_type"), F.col("text").alias("content"))
    artifacts = ex.extract(sources, ex.preset()).filter("error is null")
    named = artifacts.withColumn("artifact_id", F.concat_ws("#", "derived_from", F.col("ordinal").cast("string")))
    chunks = ch.chunk(named, ["derived_from", "artifact_id"], boundaries="headings")
    # Positions come from keys, so they are the same on every run: a document has fewer than 2**20 chunks.
    pos = F.col("derived_from").cast("bigint") * (1 << 20) + F.col("chunk_index")
    inputs = chunks.select(
        pos.alias("pos"), F.col("derived_from").alias("source_id"), "artifact_id", F.struct("text", F.col("chunk_index").alias("index"), "token_count").alias("chunk"),
        F.lit("").alias("title"), F.lit(None).cast("map<string,string>").alias("metadata"),
    )
    run = em.embed_run(inputs, _embedder)
    return run.records.select("pos", "source_id", "artifact_id", "chunk_index", "token_count", F.size("vector").alias("dims"))
