"""Content types: coercion, inference and extractor routing."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import strip
from gleanery.schema import DOCUMENT_TYPES, MIME_BY_EXTENSION, MIME_BY_TYPE


def coerce_content_type(content_type: Column) -> Column:
    lowered = F.lower(content_type)
    return F.when(lowered.isin(DOCUMENT_TYPES), lowered).otherwise("text")


def infer_document_type(content_type: Column, url: Column) -> Column:
    """Type by the first rule that fits; the rules and their order are fixed values."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    u = F.lower(url)
    is_web = url.startswith("http://") | url.startswith("https://")
    return (
        F.when(ct.contains("text/html") | ((ct == "") & is_web), "web_page")
        .when(ct.contains("application/pdf") | u.endswith(".pdf"), "pdf")
        .when(u.endswith(".py"), "python")
        .when(u.endswith(".cs"), "csharp")
        .when(u.endswith(".md") | ct.contains("markdown"), "markdown")
        .when(ct.contains("json") | u.endswith(".json"), "json")
        .when(ct.contains("xml") | u.endswith(".xml"), "xml")
        .otherwise("text")
    )


def extension_to_mime(name: Column) -> Column:
    """MIME type of a file name, by its last extension; null when unknown."""
    return lookup(MIME_BY_EXTENSION, F.lower(F.regexp_extract(name, r"\.[^./\\]*$", 0)))


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a key in a small fixed table; null when it is not there."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def type_of_mime(mime: Column) -> Column:
    """Document type of a MIME string; a plain type name passes through, null is text."""
    types = {value: kind for kind, value in MIME_BY_TYPE.items()} | {kind: kind for kind in DOCUMENT_TYPES}
    return F.coalesce(lookup(types, F.lower(mime)), F.lit("text"))


def route_extractor(mime: Column, known: list[str] | None = None) -> Column:
    """The registered MIME type whose extractor handles ``mime``."""
    known = list(MIME_BY_TYPE.values()) if known is None else known
    name = F.lower(strip(F.split_part(mime, F.lit(";"), F.lit(1))))
    routed = F.when(mime.isNull() | (mime == ""), "text/plain").when(name.isin(known), name)
    for key in known:
        routed = routed.when(name.contains(key) | F.lit(key).contains(name), key)
    return routed.otherwise(F.coalesce(extension_to_mime(name), F.lit("text/plain")))


class ExtractorRegistry:
    """MIME type to extractor, an extractor being a function Column -> Column.

    Registered extractors become branches of one ``when`` expression, so the
    routing and the extraction are part of a single JVM-side projection.
    """

    def __init__(self) -> None:
        self._by_mime: dict[str, Callable[[Column], Column]] = {
            mime: (lambda text: text) for mime in MIME_BY_TYPE.values()
        }

    def register(self, mime: str, extractor: Callable[[Column], Column]) -> None:
        """Add an extractor, replacing the one of the same MIME type."""
        if not isinstance(mime, str) or not callable(extractor):
            raise TypeError("an extractor needs a MIME string and a function Column -> Column")
        self._by_mime[mime.lower()] = extractor

    def extract(self, mime: Column, text: Column) -> Column:
        routed = route_extractor(mime, list(self._by_mime))
        result = F.lit(None).cast("string")
        for key, extractor in self._by_mime.items():
            result = F.when(routed == key, extractor(text)).otherwise(result)
        return F.coalesce(result, F.lit(""))
