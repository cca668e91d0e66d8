"""Expressions over page geometry, confidences and rendering options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.errors import error_column
from docflow.kernels.images import DEFAULT_DPI, DEFAULT_PIXELS, DEFAULT_QUALITY, MAX_PAGES, MAX_PIXELS


def split_pages(text: Column) -> Column:
    """``array<struct<number, text>>``: pages by form feeds; an empty last one isn't a page."""
    parts = F.split(text, "\f", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x, i: F.struct((i + 1).alias("number"), x.alias("text")))


def clamp_conf(conf: Column) -> Column:
    return F.when(conf < 0, -1).when(conf > 100, 100).otherwise(F.round(conf)).cast("int")


def rotation(turn: Column) -> Column:
    """0, 90, 180 or 270; null where the turn isn't a multiple of 90."""
    return F.when(turn % 90 == 0, F.pmod(turn, F.lit(360))).cast("int")


def box_size(box: Column) -> Column:
    """``struct<width, height>`` of four numbers in a string; null where they aren't finite or have no extent."""
    fields = F.transform(F.split(F.trim(box), r"\s+"), lambda x: x.try_cast("double"))
    number = lambda k: F.get(fields, k)
    width, height = F.abs(number(2) - number(0)), F.abs(number(3) - number(1))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    return F.when((F.size(fields) == 4) & fine(width) & fine(height), F.struct(width.alias("width"), height.alias("height")))


def displayed(size: Column, turn: Column) -> Column:
    """Width and height as shown: swapped by a quarter turn."""
    turned = F.struct(size["height"].alias("width"), size["width"].alias("height"))
    return F.when(turn.isin(90, 270), turned).otherwise(size)


def pixel_size(width: Column, height: Column, dpi: Column, most: Column) -> Column:
    """``struct<width, height>`` in pixels of a page in points: at ``dpi``, or less so that neither is over ``most``."""
    scale = F.least(dpi / 72.0, most / F.greatest(width, height))
    side = lambda x: F.least(F.greatest(F.round(x * scale), F.lit(1.0)), most.cast("double")).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def render_options(page: Column, fmt: Column, dpi: Column, pixels: Column, quality: Column) -> Column:
    """Options with defaults for zeros and ``error``, the first of page, format, dpi, pixels, quality at fault."""
    full_dpi = F.when(dpi == 0, DEFAULT_DPI).otherwise(dpi)
    full_pixels = F.when(pixels == 0, DEFAULT_PIXELS).otherwise(pixels)
    full_quality = F.when(quality == 0, DEFAULT_QUALITY).otherwise(quality)
    invalid = "INVALID_OPTIONS"
    error = error_column(
        ((page < 1) | (page > MAX_PAGES), invalid),
        (~fmt.isin(0, 1), invalid),
        (F.isnan(dpi) | (full_dpi <= 0) | (full_dpi == float("inf")), invalid),
        ((full_pixels < 1) | (full_pixels > MAX_PIXELS), invalid),
        ((full_quality < 1) | (full_quality > 100), invalid),
    )
    return F.struct(
        page.alias("page"), fmt.alias("format"), full_dpi.alias("dpi"), full_pixels.alias("max_pixels"), full_quality.alias("quality"), error.alias("error")
    )


def format_name(fmt: Column) -> Column:
    return F.when(fmt == 0, "png").when(fmt == 1, "jpeg").otherwise(F.concat(F.lit("Format("), fmt.cast("string"), F.lit(")")))


def format_media_type(fmt: Column) -> Column:
    return F.when(fmt == 0, "image/png").when(fmt == 1, "image/jpeg").otherwise("")


def gap_spaces(gap: Column, unit: Column, most: Column) -> Column:
    """Blanks for a gap in proportion to the character's width, 1 to ``most``; 1 for no number."""
    ratio = F.try_divide(gap, unit)
    spaces = F.least(F.greatest(F.round(ratio), F.lit(1.0)), most.cast("double"))
    return F.when(ratio.isNull() | F.isnan(ratio), 1).otherwise(spaces).cast("int")


def finite(x: Column) -> Column:
    """0 for no number."""
    return F.nanvl(x, F.lit(0.0))
