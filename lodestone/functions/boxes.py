"""Box geometry: expressions over coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page-layout classes by number (fixed values).
CLASSES = [
    "Question", "Paragraph", "Answer", "List", "Title", "Section-title", "Equation", "Table", "Diagram", "Image", "MCQ", "Infobox",
    "Sub-section-title", "Expression", "Image-caption", "Placeholder-text", "Chart", "Solved-example", "Footnote", "Table-caption",
    "Sub-sub-section-title", "Footer", "Header", "Code", "Page-number", "Chapter-title", "Chapter-end-section", "Folio", "Reference",
    "Table-of-contents", "Index", "Advertisement", "Author", "Dateline", "Contact-info", "Website-link", "Flag",
]
# Type of a label, in lower case; any other is Text (fixed values).
TYPES = {
    "table": "Table", "table-caption": "Caption", "equation": "Equation", "expression": "Equation", "diagram": "Figure", "chart": "Figure",
    "image": "Picture", "image-caption": "Caption", "title": "Title", "chapter-title": "Title", "section-title": "SectionHeader",
    "sub-section-title": "SectionHeader", "sub-sub-section-title": "SectionHeader", "header": "PageHeader", "footer": "PageFooter",
    "page-number": "PageNumber", "folio": "PageNumber", "footnote": "Footnote",
}
# Labels that are not transcribed, in lower case; marginal labels and those of one block a page (fixed values).
UNTRANSCRIBED = {"header", "footer", "diagram", "image", "chart", "advertisement"}
MARGINAL = {"Header", "Footer", "Page-number", "Folio"}
ONE_A_PAGE = {"Header", "Footer"}
PICTORIAL = {"Figure", "Picture"}
TEXT_LIKE = {"Text", "Title", "SectionHeader", "Caption", "Footnote"}

EDGES = ("x0", "y0", "x1", "y1")


def of(prefix: str = "") -> tuple[Column, ...]:
    """The four edges of a box, by column names with a prefix."""
    return tuple(F.col(prefix + e) for e in EDGES)


def _zero(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def area(b) -> Column:
    return _zero(b[2] - b[0]) * _zero(b[3] - b[1])


def overlap(a, b) -> Column:
    return _zero(F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * _zero(F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a, b) -> Column:
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def contained(inner, outer) -> Column:
    """Share of the inner box that lies in the outer one."""
    size = area(inner)
    return F.when(size > 0, overlap(inner, outer) / size).otherwise(0.0)


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def clamped(b, width: Column, height: Column) -> tuple[Column, ...]:
    return _zero(b[0]), _zero(b[1]), F.least(width, b[2]), F.least(height, b[3])


def normalised(y0: Column, x0: Column, y1: Column, x1: Column) -> Column:
    """A box, y first and of thousandths, as struct (cx, cy, w, h); null if it is not one."""
    y0, x0, y1, x1 = (F.try_divide(c.try_cast("double"), F.lit(1000.0)) for c in (y0, x0, y1, x1))
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    cx, cy = inside((x0 + x1) / 2), inside((y0 + y1) / 2)
    fit = lambda size, c: F.least(size, 2 * F.least(c, 1 - c))
    box = F.struct(cx.alias("cx"), cy.alias("cy"), fit(x1 - x0, cx).alias("w"), fit(y1 - y0, cy).alias("h"))
    return F.when((x1 - x0 > 1e-3) & (y1 - y0 > 1e-3), box)


def box_of(values: Column) -> Column:
    """The same for an array of strings; arrays of another length give null."""
    return F.when(F.size(values) == 4, normalised(*(F.get(values, i) for i in range(4))))


def type_of(label: Column) -> Column:
    types = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    return F.coalesce(types[F.lower(F.trim(label))], F.lit("Text"))


def transcribed(label: Column) -> Column:
    return ~F.lower(F.trim(label)).isin(*sorted(UNTRANSCRIBED))


def crop(b, width: Column, height: Column, least: float, most: float) -> tuple[Column, Column]:
    """Pixel size of a box's crop, scaled so its area lies between the bounds."""
    x0, y0, x1, y1 = clamped(b, width, height)
    w, h = F.greatest(F.lit(1.0), F.bround(x1) - F.bround(x0)), F.greatest(F.lit(1.0), F.bround(y1) - F.bround(y0))
    size = w * h
    scale = F.when(size > most, F.sqrt(most / size)).when(size < least, F.sqrt(least / size)).otherwise(1.0)
    side = lambda x: F.greatest(F.lit(1), F.bround(x * scale).cast("int"))
    return side(w), side(h)
