"""PDF engines and operators: pages, layouts, assembled text, rendering."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from docflow.errors import DocflowError, malformed
from docflow.functions.pdf import box_size, clamp_conf, displayed, gap_spaces, rotation
from docflow.kernels import images, pdf_layout, pdf_reader
from docflow.kernels.process import DEFAULT_TIMEOUT, Run, run
from docflow.operators.content import LAYOUT, PAGE_TEXT, running_total

# Limits of the programs' output, the newest layout format.
MAX_TEXT, MAX_TSV, MAX_INFO = 64 << 20, 128 << 20, 16 << 20
LAST_PAGE = 1_000_000
LAYOUT_VERSION = 1


class Engine(Protocol):
    """Reads the text of a document's pages."""

    name: str

    def pages(self, data: bytes) -> list[tuple[int, str]]: ...


@dataclass(frozen=True)
class PopplerEngine:
    """Poppler's programs, run on the executors, each alone or with its first arguments; ``mode`` is ``raw`` or ``layout``."""

    mode: str = "raw"
    timeout: float = DEFAULT_TIMEOUT
    text_program: str | tuple[str, ...] = "pdftotext"
    info_program: str | tuple[str, ...] = "pdfinfo"
    image_program: str | tuple[str, ...] = "pdftoppm"
    name: str = "pdftotext"

    def pages(self, data: bytes) -> list[tuple[int, str]]:
        args = ["-layout"] * (self.mode == "layout") + ["-enc", "UTF-8", "-q", "-", "-"]
        out = run(Run(self.text_program, args, data, self.timeout, MAX_TEXT))
        return pdf_layout.split_pages(out.decode("utf-8", "replace"))

    def geometry(self, data: bytes, first: int, last: int) -> tuple[int, list[dict]]:
        out = run(Run(self.info_program, ["-f", str(first), "-l", str(last), "-box", "-"], data, self.timeout, MAX_INFO))
        try:
            return pdf_layout.parse_geometry(out.decode("utf-8", "replace"), first, last)
        except ValueError as e:
            raise malformed("application/pdf", e) from e

    def layout(self, data: bytes) -> dict:
        """Words with places on every page, in points from the crop box's upper left corner."""
        total, sizes = self.geometry(data, 1, LAST_PAGE)
        if total > LAST_PAGE:
            raise malformed("application/pdf", f"{total} pages")
        out = run(Run(self.text_program, ["-tsv", "-cropbox", "-enc", "UTF-8", "-q", "-", "-"], data, self.timeout, MAX_TSV))
        try:
            tables = pdf_layout.parse_tsv(out.decode("utf-8", "replace"))
        except ValueError as e:
            raise malformed("application/pdf", e) from e
        if len(tables) != len(sizes):
            raise malformed("application/pdf", f"{len(tables)} pages of words, {len(sizes)} of sizes")
        pages = [size | {"words": words} for size, (_, words) in zip(sizes, tables)]
        return {"version": LAYOUT_VERSION, "engine": self.name, "box": "crop", "pages": pages}

    def render(self, data: bytes, page: int, fmt: int = 0, dpi: float = 0, max_pixels: int = 0, quality: int = 0) -> dict:
        """One page as an image of an exact size in pixels."""
        options = normalize_options(page, fmt, dpi, max_pixels, quality)
        total, sizes = self.geometry(data, 1, page)
        if page > total:
            raise DocflowError("PAGE_OUT_OF_RANGE", f"page {page} of {total}")
        size = sizes[-1]
        width, height = pixels_of(size["width"], size["height"], options["dpi"], options["max_pixels"])
        kind = images.FORMATS[fmt][0]
        args = ["-f", str(page), "-l", str(page), "-singlefile", "-cropbox", "-scale-to-x", str(width), "-scale-to-y", str(height), f"-{kind}"]
        args += ["-jpegopt", f"quality={options['quality']}"] * (kind == "jpeg") + ["-q", "-"]
        out = run(Run(self.image_program, args, data, self.timeout, 4 * (options["max_pixels"] ** 2) + (1 << 20)))
        try:
            w, h = images.check_header(out, kind, width, height, options["max_pixels"])
        except ValueError as e:
            raise malformed("application/pdf", e) from e
        shown = {"page_width": size["width"], "page_height": size["height"], "scale_x": w / size["width"], "scale_y": h / size["height"]}
        return {"data": out, "width": w, "height": h} | shown


@dataclass(frozen=True)
class PlainEngine:
    """The built-in reader, for trusted documents: no program needed, simple fonts only."""

    name: str = "plain"

    def pages(self, data: bytes) -> list[tuple[int, str]]:
        try:
            return pdf_reader.read_pages(data)
        except Exception as e:
            raise malformed("application/pdf", e) from e


def normalize_options(page: int, fmt: int, dpi: float, max_pixels: int, quality: int) -> dict:
    dpi, max_pixels, quality = dpi or images.DEFAULT_DPI, max_pixels or images.DEFAULT_PIXELS, quality or images.DEFAULT_QUALITY
    for fine, what in (
        (1 <= page <= images.MAX_PAGES, f"page {page}"),
        (fmt in images.FORMATS, f"format {fmt}"),
        (0 < dpi < float("inf"), f"{dpi} dpi"),
        (1 <= max_pixels <= images.MAX_PIXELS, f"{max_pixels} pixels"),
        (1 <= quality <= 100, f"quality {quality}"),
    ):
        if not fine:
            raise DocflowError("INVALID_OPTIONS", what)
    return {"dpi": dpi, "max_pixels": max_pixels, "quality": quality}


def pixels_of(width: float, height: float, dpi: float, most: int) -> tuple[int, int]:
    scale = min(dpi / 72, most / max(width, height))
    return tuple(min(max(pdf_layout.round_half_away(x * scale), 1), most) for x in (width, height))


# -- DataFrames ----------------------------------------------------------------------------------------

_LAYOUT_RESULT = StructType([StructField("layout", LAYOUT), StructField("error", StringType()), StructField("message", StringType())])
_IMAGE = StructType(
    [StructField("data", BinaryType()), StructField("width", IntegerType()), StructField("height", IntegerType())]
    + [StructField(n, DoubleType()) for n in ("page_width", "page_height", "scale_x", "scale_y")]
)
_IMAGE_RESULT = StructType([StructField("image", _IMAGE), StructField("error", StringType()), StructField("message", StringType())])


def _with_engine(df: DataFrame, key: list[str], content: str, call, result: StructType, value: str) -> DataFrame:
    """One call an input row, with its failure as a value; one document at a time in memory."""
    schema = StructType([*df.select(*key).schema.fields, *result.fields])

    def step(batches: Iterator[pa.RecordBatch]):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                try:
                    out = (call(row.column("__data")[0].as_py() or b""), None, None)
                except DocflowError as e:
                    out = (None, e.code, e.message)
                kinds = [to_arrow_type(f.dataType) for f in result]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in key), *(pa.array([o], t) for o, t in zip(out, kinds))], names=schema.names)

    return df.select(*key, F.col(content).cast("binary").alias("__data")).mapInArrow(step, schema)


def layouts(df: DataFrame, key: list[str], engine: PopplerEngine, content: str = "content") -> DataFrame:
    """``key, layout, error, message`` of each document."""
    return _with_engine(df, key, content, engine.layout, _LAYOUT_RESULT, "layout")


def renders(df: DataFrame, key: list[str], engine: PopplerEngine, page: int, content: str = "content", **options) -> DataFrame:
    """``key, image, error, message``: one page of each document rendered."""
    return _with_engine(df, key, content, lambda data: engine.render(data, page, **options), _IMAGE_RESULT, "image")


def assembled(pages: DataFrame, key: list[str], words: str = "words", *, strategy: str = "reading_order", options=pdf_layout.AssembleOptions()) -> DataFrame:
    """``key, text, spans``: each page's text with the bytes of every word in it."""
    build = {"reading_order": pdf_layout.assemble_reading_order, "rows": lambda w: pdf_layout.assemble_rows(w, options)}[strategy]
    schema = StructType([*pages.select(*key).schema.fields, *PAGE_TEXT.fields])

    def step(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                out = [build([w | {"text": w["text"] or ""} for w in ws or []]) for ws in batch.column("__words").to_pylist()]
                texts = pa.array([t for t, _ in out], pa.string())
                spans = pa.array([s for _, s in out], to_arrow_type(PAGE_TEXT["spans"].dataType))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), texts, spans], names=schema.names)

    return pages.select(*key, F.col(words).alias("__words")).mapInArrow(step, schema)


def row_units(pages: DataFrame, key: list[str], words: str = "words", options=pdf_layout.AssembleOptions()) -> DataFrame:
    """``key, row, unit``: the width of a character in each row of a page, rows numbered from the top."""
    numbers = [StructField("row", IntegerType()), StructField("unit", DoubleType())]
    schema = StructType([*pages.select(*key).schema.fields, *numbers])

    def step(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                found = [(i, r, u) for i, ws in enumerate(batch.column("__words").to_pylist()) for r, u in enumerate(pdf_layout.units_of([w | {"text": w["text"] or ""} for w in ws or []], options))]
                places, rows, units = zip(*found) if found else [()] * 3
                keys = [batch.column(c).take(pa.array(places, pa.int64())) for c in key]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(rows, pa.int32()), pa.array(units, pa.float64())], names=schema.names)

    return pages.select(*key, F.col(words).alias("__words")).mapInArrow(step, schema)


def line_gaps(pages: DataFrame, key: list[str], unit: float, most: int, words: str = "words") -> DataFrame:
    """``key, k, spaces``: blanks for the gap between each word and the one before on its line."""
    each = pages.select(*key, F.posexplode(words).alias("k", "w"))
    rows = each.select(*key, "k", F.col("w.line").alias("line"), F.col("w.box.x0").alias("x0"), F.col("w.box.x1").alias("x1"))
    before = F.lag("x1").over(Window.partitionBy(*key, "line").orderBy("k"))
    gaps = rows.withColumn("gap", F.col("x0") - before).filter("gap is not null")
    return gaps.select(*key, "k", gap_spaces(F.col("gap"), F.lit(unit), F.lit(most)).alias("spaces"))


def zip_pages(layouts: DataFrame, texts: DataFrame) -> DataFrame:
    """``source_id, page_no, words, spans, agree``: numbers of words and of spans of a page; of a page that only
    one side has the other's number is null."""
    left = layouts.select("source_id", "page_no", F.size("words").alias("words"))
    right = texts.groupBy("source_id", "page_no").agg(F.max(F.size("spans")).alias("spans"))
    both = left.join(right, ["source_id", "page_no"], "full")
    return both.select("source_id", "page_no", "words", "spans", F.col("words").eqNullSafe(F.col("spans")).alias("agree"))


def citations(pages: DataFrame, every: int) -> DataFrame:
    """``source_id, page_no, byte``: the page of a source's joined text in which every ``every``-th byte lies."""
    size = pages.select("source_id", "page_no", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n"))
    spans = running_total(size, ["source_id"], "page_no", "n", "start").filter("n > 0")
    first, last = F.ceil(F.col("start") / every).cast("bigint"), F.floor((F.col("start") + F.col("n") - 1) / every).cast("bigint")
    hits = spans.withColumns({"a": first, "b": last}).filter("a <= b")
    return hits.select("source_id", "page_no", F.explode(F.sequence("a", "b")).alias("k")).select("source_id", "page_no", (F.col("k") * every).alias("byte"))


def reading_order_text(pages: DataFrame, key: list[str], words: str = "words") -> DataFrame:
    """``key, text`` of each page's words in reading order, by relational means.

    Empty words write nothing, but the strongest of the changes of line or block since the last word that
    isn't empty separates. A page is ordered within one task; pages without words have an empty text.
    """
    each = pages.select(*key, F.posexplode_outer(words).alias("k", "w"))
    page = Window.partitionBy(*key).orderBy("k")
    block, line = F.col("w.block"), F.col("w.line")
    step = F.when(F.lag(block).over(page) != block, 2).when(F.lag(line).over(page) != line, 1).otherwise(0)
    text = F.coalesce(F.col("w.text"), F.lit(""))
    written = F.coalesce(F.sum((text != "").cast("int")).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = each.select(*key, "k", text.alias("t"), step.alias("step"), written.alias("g"))
    strongest = F.max("step").over(Window.partitionBy(*key, "g"))
    separator = F.when(F.col("g") == 0, "").when(strongest == 2, "\n\n").when(strongest == 1, "\n").otherwise(" ")
    pieces = rows.select(*key, "k", F.when(F.col("t") != "", F.concat(separator, "t")).alias("p"))
    lists = pieces.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("k", "p")))).alias("l"))
    return lists.select(*key, F.array_join(F.col("l.p"), "").alias("text"))


def tsv_words(tables: DataFrame, key: str, tsv: str = "tsv") -> DataFrame:
    """Words of word tables by relational means: ``key, page, word_no, text, x0..y1, block, line, conf``.

    For tables known to be well-formed; the kernel is the one that refuses what can't be trusted.
    """
    lines = tables.select(key, F.posexplode(F.split(F.regexp_replace(tsv, "\r\n", "\n"), "\n")).alias("pos", "line"))
    f = F.split("line", "\t", 12)
    part = lambda k, kind: F.get(f, F.lit(k)).try_cast(kind)
    rows = lines.filter(part(0, "int") == 5).select(
        key, "pos", part(1, "int").alias("page"), part(2, "int").alias("par"), part(3, "int").alias("b"), part(4, "int").alias("l"),
        *(part(6 + k, "double").alias(n) for k, n in enumerate(("left", "top", "width", "height", "cf"))), F.get(f, F.lit(11)).alias("text"),
    )
    page = Window.partitionBy(key, "page")
    rows = rows.withColumns({
        "fb": F.min("pos").over(Window.partitionBy(key, "page", "par", "b")),
        "fl": F.min("pos").over(Window.partitionBy(key, "page", "par", "b", "l")),
    })
    return rows.select(
        key, "page", (F.row_number().over(page.orderBy("pos")) - 1).alias("word_no"), "text",
        F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"),
        (F.dense_rank().over(page.orderBy("fb")) - 1).alias("block"), (F.dense_rank().over(page.orderBy("fl")) - 1).alias("line"),
        clamp_conf(F.col("cf")).alias("conf"),
    )


def geometry_rows(infos: DataFrame, key: str, info: str = "info") -> DataFrame:
    """Pages of page-size listings by relational means: ``key, number, width, height, rotation``.

    Only pages that have just one line of either kind and whose lines can be read.
    """
    lines = infos.select(key, F.explode(F.split(info, "\n")).alias("line"))
    pattern = r"^Page\s+(\d+)\s+(rot|CropBox):\s+(.*?)\s*$"
    rows = lines.filter(F.col("line").rlike(pattern)).select(
        key, F.regexp_extract("line", pattern, 1).cast("int").alias("number"), F.regexp_extract("line", pattern, 2).alias("kind"), F.regexp_extract("line", pattern, 3).alias("value")
    )
    is_rot = F.col("kind") == "rot"
    pages = rows.groupBy(key, "number").agg(
        F.sum(F.when(is_rot, 1).otherwise(0)).alias("rots"),
        F.sum(F.when(is_rot, 0).otherwise(1)).alias("boxes"),
        rotation(F.max(F.when(is_rot, F.col("value"))).try_cast("int")).alias("rotation"),
        box_size(F.max(F.when(~is_rot, F.col("value")))).alias("size"),
    )
    fine = pages.filter("rots = 1 and boxes = 1 and rotation is not null and size is not null")
    shown = displayed(F.col("size"), F.col("rotation"))
    return fine.select(key, "number", shown["width"].alias("width"), shown["height"].alias("height"), "rotation")


def layout_json(layout: Column) -> Column:
    """A layout as JSON, the form in which it is kept."""
    return F.to_json(layout)


def parse_layout_json(text: Column) -> Column:
    return F.from_json(text, json.dumps(LAYOUT.jsonValue()))


PAGES = ArrayType(StructType([StructField("number", IntegerType()), StructField("text", StringType())]))
