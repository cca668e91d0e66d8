"""The registered queries of this subpackage and their SQL, problem by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import abuse, lookalikes, mixing, neardup, neighbours, packing, scanned, splitting, tokens
from docflow.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _graph(spark: SparkSession, sf_dir: str, **options) -> neighbours.NeighbourGraph:
    return neighbours.NeighbourGraph(table(spark, sf_dir, "records").select("pos", "vector"), **options)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).similar_pairs(5, 0.85)


P1_FOUND = """
with usable as (
  select pos, min(vector) as v from records
  where pos is not null and len(vector) = 64 and list_bool_and(list_transform(vector, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(vector, lambda x: x <> 0)) group by pos
), pairs as (
  select x.pos as x, y.pos as y, round(list_cosine_similarity(x.v::double[], y.v::double[]), 10) as c from usable x join usable y on x.pos <> y.pos
), ranked as (select x, y, c, row_number() over (partition by x order by c desc, y) as n from pairs)
select distinct least(x, y) as a, greatest(x, y) as b from ranked where n <= 5 and c >= 0.85
"""


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, keep=None, orders=None).neighbours(5)


def p1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose pos is divisible by 100, searched as if they weren't known; each finds itself first."""
    asked = table(spark, sf_dir, "records").filter("pos % 100 = 0").select(F.col("pos").alias("id"), "vector")
    return _graph(spark, sf_dir, keep=None, orders=None).search(asked, 6)


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_inputs(table(spark, sf_dir, "inputs"), table(spark, sf_dir, "pack_limits"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).filter((F.col("pieces") > 1) & (F.col("piece") == 0)).select("pos")


P2_FOUND = """
select distinct pos from inputs, (select min(max_batch_tokens) as room from pack_limits)
where coalesce(source_id, '') <> '' and coalesce(artifact_id, '') <> '' and coalesce(chunk."index", 0) >= 0
  and (length(chunk.text) + 3) // 4 > room
"""


def p2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir)


def p2_record_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_records(table(spark, sf_dir, "records"), table(spark, sf_dir, "pack_limits"))


def p2_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    room = packing.capacity_of(table(spark, sf_dir, "pack_limits"))
    return packing.fill_report(_batches(spark, sf_dir), room)


def _pages(spark: SparkSession, sf_dir: str) -> scanned.ScannedPages:
    return scanned.ScannedPages(table(spark, sf_dir, "page_layouts").select("source_id", "page_no", "words"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).findings.select("source_id", "page_no", "word_no", "kind")


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).paragraphs()


def p3_text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of the pages, ``field`` naming which, repaired together: what one says helps to read the other."""
    texts = table(spark, sf_dir, "page_texts")
    both = [texts.select(F.concat_ws(":", F.lit(c), "source_id").alias("source_id"), "page_no", F.col(c).alias("body")) for c in ("raw_text", "text")]
    pages = scanned.pages_of_texts(both[0].unionByName(both[1]).filter("body is not null"), "body")
    found = scanned.ScannedPages(pages, own_blocks=False).paragraphs()
    field, source = F.substring_index("source_id", ":", 1), F.expr("substring(source_id, instr(source_id, ':') + 1)")
    return found.select(field.alias("field"), source.alias("source_id"), "page_no", "paragraph_no", "text")


def _near(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    """The similarity of problem 4 as stated: triples of words, at least 20 of them, 0.6 of either's."""
    docs = neardup.artifact_and_chunk_texts(table(spark, sf_dir, "artifacts"), table(spark, sf_dir, "chunks"))
    return neardup.NearDuplicates(docs, width=3, threshold=0.6, least=20)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _near(spark, sf_dir).pairs()
    return pairs.select(neardup.field_name(F.col("field")).alias("field"), "a", "b")


P4_FOUND = r"""
with texts as (
  select 'artifact' as field, id as key, text from artifacts
  union select 'chunk', artifact_id || '#' || chunk_index, text from chunks
), words as (
  select field, key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from texts where text is not null
), triples as (
  select distinct field, key, unnest(list_transform(range(1, len(w) - 1),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as t from words where len(w) >= 22
), sizes as (select field, key, count(*) as n from triples group by all having n >= 20
), pairs as (
  select x.field, x.key as a, y.key as b, count(*) as both
  from triples x join triples y on x.field = y.field and x.t = y.t and x.key < y.key group by all
)
select p.field, p.a, p.b from pairs p
join sizes s on s.field = p.field and s.key = p.a join sizes r on r.field = p.field and r.key = p.b
where p.both >= 0.6 * (s.n + r.n - p.both)
"""


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).groups().withColumn("field", neardup.field_name(F.col("field")))


P4_GROUPS = P4_FOUND.split("select p.field")[0].replace("with texts", "with recursive texts") + """
, near as (
  select p.field, p.a, p.b from pairs p join sizes s on s.field = p.field and s.key = p.a join sizes r on r.field = p.field and r.key = p.b
  where p.both >= 0.6 * (s.n + r.n - p.both)
), sets as (select t.field, t.key, md5(string_agg(t.t, chr(1) order by t.t)) as c from triples t join sizes s on s.field = t.field and s.key = t.key group by all
), classes as (select field, c, min(key) as class_key, count(*) as copies from sets group by all
), half as (select n.field, x.c as a, y.c as b from near n join sets x on x.field = n.field and x.key = n.a join sets y on y.field = n.field and y.key = n.b where x.c <> y.c
), links as (select field, a, b from half union select field, b, a from half
), degree as (select field, a as c, count(*) as links from links group by all
), reach(field, c, other) as (select field, c, c from classes union select r.field, r.c, l.b from reach r join links l on l.field = r.field and l.a = r.other
), tops as (select r.field, r.c, min(k.class_key) as group_key from reach r join classes k on k.field = r.field and k.c = r.other group by all)
select s.field, s.key, k.class_key, t.group_key, k.copies, coalesce(d.links, 0) as links
from sets s join classes k on k.field = s.field and k.c = s.c join tops t on t.field = s.field and t.c = s.c left join degree d on d.field = s.field and d.c = s.c
"""


def _split_args(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("chunks", "artifacts", "chunk_limits")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(*_split_args(spark, sf_dir))
    return pieces.filter("piece_no = 0").select("artifact_id", "chunk_index")


P5_FOUND = """
with types as (select id, min(trim(lower(split_part(media_type, ';', 1)))) as kind from artifacts group by id)
select distinct c.artifact_id, c.chunk_index
from chunks c
left join types t on t.id = c.artifact_id
left join chunk_limits own on own.media_type = t.kind
join chunk_limits other on other.media_type = '*'
where (length(c.text) + 3) // 4 > coalesce(own.max_tokens, other.max_tokens)
"""


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(*_split_args(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.found(table(spark, sf_dir, "artifacts"), table(spark, sf_dir, "page_layouts"))


def _counts(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return lookalikes.character_counts(table(spark, sf_dir, "artifacts"), table(spark, sf_dir, "page_layouts"))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = table(spark, sf_dir, "artifacts")
    return lookalikes.canonical_texts(artifacts, "text", _counts(spark, sf_dir), ["id"]).distinct()


def p6_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "page_layouts")
    keys = ["source_id", "page_no"]
    return lookalikes.canonical_words(pages, _counts(spark, sf_dir), keys, only_changed=False).distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.encode_frame(docs)


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids decoded again: the code points of the decoded text and whether it is the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("original"))
    ids = tokens.encode_frame(docs)
    back = tokens.decode_frame(ids, out="back")
    return back.select(
        "doc_id",
        F.char_length("back").cast("bigint").alias("n_chars"),
        (F.col("back") == F.coalesce("original", F.lit(""))).alias("same"),
    )


P7_ROUNDTRIP = """
select doc_id, cast(coalesce(length(text), 0) as bigint) as n_chars, true as same from documents
"""


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture, _ = mixing.mixture_stages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return mixture


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(*mixing.mixture_stages(table(spark, sf_dir, "documents"), targets), targets)


def p8_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.margins(*mixing.mixture_stages(table(spark, sf_dir, "documents"), targets), targets)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return abuse.Detector(docs, review_labels=table(spark, sf_dir, "review_labels")).scores(docs, ["doc_id", "source"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "score")


def p9_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.source_rates(_scored(spark, sf_dir))


def p9_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each half of the judgements against a detector that had only the other half."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    scored = [abuse.Detector(docs, review_labels=labels.filter(half != k)).scores(docs, ["doc_id"]).filter(half == k) for k in (0, 1)]
    return abuse.agreement(scored[0].unionByName(scored[1]), labels)


QUERIES = (
    p1_found, p1_neighbours, p1_search,
    p2_found, p2_batches, p2_record_batches, p2_fill,
    p3_found, p3_paragraphs, p3_text_paragraphs,
    p4_found, p4_groups,
    p5_found, p5_pieces,
    p6_found, p6_texts, p6_words,
    p7_ids, p7_roundtrip,
    p8_mixture, p8_shares, p8_margins,
    p9_found, p9_scores, p9_source_rates, p9_agreement,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p4_found": P4_FOUND, "p4_groups": P4_GROUPS, "p5_found": P5_FOUND, "p7_roundtrip": P7_ROUNDTRIP}
