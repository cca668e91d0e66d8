"""Extraction: sources (bytes) to text artifacts, dispatched on the canonical media type.

Checks that need no content run as native expressions below the Python step, in a fixed order: parent missing,
media type invalid, media type unsupported, source too large. Plain text and Markdown that are valid UTF-8 never
leave the JVM; the rest goes through one Arrow pass. Failures are rows with an ``error``, never lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from docflow.errors import DocflowError, error_column, malformed
from docflow.functions.media import canonical
from docflow.functions.text import is_blank, normalize_whitespace, strip_bom, strip_front_matter
from docflow.kernels import html_text, ooxml
from docflow.kernels.text_norm import normalize_whitespace as normalize
from docflow.kernels.text_norm import utrim
from docflow.kernels.utf8 import decode_lossy

#: Fixed value: a source may have so many bytes unless the caller says otherwise.
MAX_SOURCE_BYTES = 32 << 20

#: An extractor takes a source's bytes and yields ``(media_type, text, metadata)``.
Extractor = Callable[[bytes], list[tuple[str, str, dict[str, str] | None]]]

_ITEM = StructType([StructField("media_type", StringType()), StructField("text", StringType()), StructField("metadata", MapType(StringType(), StringType()))])
_RESULT = StructType([StructField("items", ArrayType(_ITEM)), StructField("code", StringType()), StructField("message", StringType())])


def _one(media_type: str, text: str) -> list[tuple[str, str, None]]:
    if not text:
        raise DocflowError("NO_CONTENT")
    return [(media_type, text, None)]


def extract_text(data: bytes):
    return _one("text/plain", normalize(decode_lossy(data)))


def extract_markdown(data: bytes):
    import re

    text = decode_lossy(data.removeprefix(b"\xef\xbb\xbf"))
    text = re.sub(r"\A(---|\+\+\+)[ \t\r]*\n(?:.*?\n)??\1[ \t\r]*(?:\n|\Z)", "", text, count=1, flags=re.S)
    return _one("text/markdown", text if utrim(text) else "")


def extract_html(data: bytes):
    return _one("text/plain", normalize(html_text.html_text(data.decode("utf-8", "replace"))))


def extract_docx(data: bytes):
    return _one("text/plain", ooxml.docx_text(data))


def extract_pptx(data: bytes):
    return _one("text/plain", ooxml.pptx_text(data))


def pdf_extractor(engine) -> Extractor:
    """One artifact for each page that isn't blank, with the page's number and the engine's name.

    ``engine`` has ``name``, ``pages(data) -> [(number, text)]`` and may have ``mode``.
    """

    def run(data: bytes):
        if engine is None:
            raise DocflowError("NO_ENGINE")
        found = []
        mode = getattr(engine, "mode", None)
        for number, text in engine.pages(data):
            text = normalize(text)
            if text:
                metadata = {"pdf.page": str(number), "pdf.engine": engine.name} | ({"pdf.mode": mode} if mode else {})
                found.append(("text/plain", text, metadata))
        if not found:
            raise DocflowError("NO_CONTENT")
        return found

    return run


@dataclass
class Registry:
    """Extractors by canonical media type. Wiring mistakes fail at once, on the driver."""

    max_bytes: int = MAX_SOURCE_BYTES
    extractors: dict[str, Extractor] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.max_bytes <= 0:
            raise ValueError("max_bytes must be positive")

    def register(self, media_type: str, extractor: Extractor) -> Registry:
        kind = utrim(media_type or "").partition(";")[0].strip().lower()
        if not kind or extractor is None:
            raise ValueError("a media type and an extractor are needed")
        if kind in self.extractors:
            raise ValueError(f"{kind} is registered already")
        self.extractors[kind] = extractor
        return self

    def supported(self) -> list[str]:
        return sorted(self.extractors)

    def supports(self, media_type: Column) -> Column:
        """Whether a type, in whatever spelling, has an extractor."""
        return F.coalesce(canonical(media_type).isin(*self.extractors), F.lit(False))


def preset(pdf_engine=None, max_bytes: int = MAX_SOURCE_BYTES) -> Registry:
    """All built-in formats; PDF through ``pdf_engine``."""
    registry = Registry(max_bytes)
    for media_type, extractor in (
        ("text/plain", extract_text),
        ("text/html", extract_html),
        ("application/pdf", pdf_extractor(pdf_engine)),
        (ooxml.DOCX, extract_docx),
        (ooxml.PPTX, extract_pptx),
        ("text/markdown", extract_markdown),
        ("text/x-markdown", extract_markdown),
    ):
        registry.register(media_type, extractor)
    return registry


def guard(parent: Column, media_type: Column, size: Column, registry: Registry, max_bytes: int | None = None) -> Column:
    """The code of what is wrong before any content is read, or null."""
    limit = registry.max_bytes if max_bytes is None else max_bytes
    if limit <= 0:
        raise ValueError("max_bytes must be positive")
    kind = canonical(media_type)
    return error_column(
        (F.coalesce(parent, F.lit("")) == "", "MISSING_PARENT_ID"),
        (kind.isNull(), "INVALID_MEDIA_TYPE"),
        (~kind.isin(*registry.extractors), "UNSUPPORTED_MEDIA_TYPE"),
        (size > limit, "SOURCE_TOO_LARGE"),
    )


def native_text(text: Column) -> Column:
    """Plain text extracted, in the JVM."""
    return normalize_whitespace(text)


def native_markdown(text: Column) -> Column:
    """Markdown extracted, in the JVM: byte-order mark and front matter gone, the rest as it is."""
    body = strip_front_matter(strip_bom(text))
    return F.when(is_blank(body), "").otherwise(body)


def extract(
    sources: DataFrame, registry: Registry, *, parent: str = "id", media_type: str = "media_type", content: str = "content", max_bytes: int | None = None
) -> DataFrame:
    """Artifacts of ``sources``: derived_from, ordinal, media_type, text, metadata, error, message.

    A failed source is one row with an ``error`` and null text. ``content`` is binary or string; a null one
    counts as empty. Artifacts have no id; the caller gives one, for example from derived_from and ordinal.
    """
    limit = registry.max_bytes if max_bytes is None else max_bytes
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    rows = sources.select(F.col(parent).alias("derived_from"), F.col(media_type).alias("__type"), data.alias("__data"))
    rows = rows.select(
        "derived_from",
        canonical(F.col("__type")).alias("__kind"),
        "__data",
        guard(F.col("derived_from"), F.col("__type"), F.octet_length("__data"), registry, limit).alias("error"),
    )
    text = F.when(F.is_valid_utf8(F.col("__data").cast("string")), F.col("__data").cast("string"))
    natives = {"text/plain": (extract_text, native_text, "text/plain")}
    natives |= {t: (extract_markdown, native_markdown, "text/markdown") for t in ("text/markdown", "text/x-markdown")}
    native_kinds = [t for t, (f, _, _) in natives.items() if registry.extractors.get(t) is f]
    is_native = F.col("error").isNull() & F.col("__kind").isin(*native_kinds) & text.isNotNull() if native_kinds else F.lit(False)
    failed = rows.filter(F.col("error").isNotNull()).select(
        "derived_from", F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("media_type"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("map<string,string>").alias("metadata"), "error",
        F.when(F.col("error") == "SOURCE_TOO_LARGE", f"source is over {limit} bytes").otherwise(F.col("error")).alias("message"),
    )
    body = F.lit(None).cast("string")
    kind = F.lit(None).cast("string")
    for t in native_kinds:
        body = F.when(F.col("__kind") == t, natives[t][1](text)).otherwise(body)
        kind = F.when(F.col("__kind") == t, natives[t][2]).otherwise(kind)
    native = rows.filter(is_native).select("derived_from", body.alias("text"), kind.alias("media_type"))
    blank = F.col("text") == ""
    native = native.select(
        "derived_from", F.lit(0).alias("ordinal"), F.when(~blank, F.col("media_type")).alias("media_type"), F.when(~blank, F.col("text")).alias("text"),
        F.lit(None).cast("map<string,string>").alias("metadata"), F.when(blank, "NO_CONTENT").alias("error"), F.when(blank, "NO_CONTENT").alias("message"),
    )
    other = rows.filter(F.col("error").isNull() & ~is_native).select("derived_from", "__kind", "__data")
    return native.unionByName(failed).unionByName(_python(other, registry))


def _python(rows: DataFrame, registry: Registry) -> DataFrame:
    schema = StructType(rows.select("derived_from").schema.fields).add("r", _RESULT)
    extractors = dict(registry.extractors)

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark.sql.pandas.types import to_arrow_type

        for whole in batches:
            # Few sources at a time: their bytes and texts may be large.
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                results = [_attempt(extractors[k], k, d) for k, d in zip(batch.column("__kind").to_pylist(), batch.column("__data").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("derived_from"), pa.array(results, to_arrow_type(_RESULT))], names=["derived_from", "r"])

    done = rows.mapInArrow(run, schema)
    return done.select("derived_from", "r.code", "r.message", F.posexplode_outer("r.items").alias("ordinal", "item")).select(
        "derived_from", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), "item.media_type", "item.text", "item.metadata", F.col("code").alias("error"), "message"
    )


def _attempt(extractor: Extractor, kind: str, data: bytes) -> dict:
    try:
        items = [{"media_type": m, "text": t, "metadata": None if x is None else list(x.items())} for m, t, x in extractor(data)]
        return {"items": items, "code": None, "message": None}
    except DocflowError as e:
        return {"items": None, "code": e.code, "message": e.message}
    except (RecursionError, MemoryError):
        raise
    except Exception as e:  # a parser's own failure means that the source can't be read
        e = malformed(kind, e)
        return {"items": None, "code": e.code, "message": e.message}
