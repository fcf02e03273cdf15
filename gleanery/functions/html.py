"""HTML pages: metadata, links, element stripping and conversion to text.

Pages are whole-text rows. Elements are removed by a scanner that is linear on any
page (``tags``); the rest is a chain of regular expressions in the JVM, each applied only up to
the last place where it can match, so that what is left open costs nothing.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.tags import ELEMENTS, remove_elements

#: The kinds of elements a caller may keep or remove; the head is removed for text only.
ELEMENT_KINDS = tuple(kind for kind in ELEMENTS if kind != "head")
# What a page keeps unless the caller says otherwise (fixed values)
KEPT_BY_DEFAULT = {"links", "tables", "meta", "structured_data"}

# Named entities decoded in text (fixed values); &amp; comes last on purpose.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&apos;": "'", "&#39;": "'",
    "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·",
    "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&amp;": "&",
}


def decode_entities(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _first(html: Column, pattern: str) -> Column:
    return F.trim(decode_entities(F.regexp_extract(html, pattern, 1)))


def page_title(html: Column) -> Column:
    return _first(html, r"(?is)<title[^>]*>(.*?)</title\s*>")


def page_description(html: Column) -> Column:
    name_first = _first(html, r"""(?is)<meta\b[^>]*name\s*=\s*["']description["'][^>]*content\s*=\s*["']([^"']*)["']""")
    content_first = _first(html, r"""(?is)<meta\b[^>]*content\s*=\s*["']([^"']*)["'][^>]*name\s*=\s*["']description["']""")
    return F.coalesce(F.nullif(name_first, F.lit("")), content_first)


def page_language(html: Column) -> Column:
    return F.lower(_first(html, r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)"""))


def page_encoding(html: Column) -> Column:
    found = F.lower(_first(html, r"""(?is)<meta\b[^>]*charset\s*=\s*["']?([A-Za-z0-9_-]+)"""))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("utf-8"))


def page_links(html: Column) -> Column:
    """Array of hrefs in page order; an anchor without href contributes ''."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a(?:\s[^>]*)?>"), F.lit(0))
    return F.transform(
        anchors,
        lambda tag: decode_entities(
            F.regexp_extract(tag, r"""(?is)\shref\s*=\s*["']?([^"'\s>]*)""", 1)
        ),
    )


def strip_html_elements(html: Column, keep: set[str] = frozenset(KEPT_BY_DEFAULT)) -> Column:
    """Remove every element kind whose name is not in ``keep``, in one pass over the page."""
    unknown = set(keep) - set(ELEMENT_KINDS)
    if unknown:
        raise ValueError(f"unknown element kinds: {sorted(unknown)}")
    return remove_elements(html, set(ELEMENT_KINDS) - set(keep))


_LINK_RULE = (r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>""", "[$2]($1)")
_MARKDOWN_RULES = (
    [(rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)]
    + [
        (r"(?i)</h[1-6]\s*>", "\n\n"),
        _LINK_RULE,
        (r"(?i)</?(?:b|strong)\s*>", "**"),
        (r"(?i)</?(?:i|em)\s*>", "*"),
        (r"(?i)</?code\s*>", "`"),
        (r"(?i)<li\b[^>]*>", "\n- "),
        (r"(?i)<br\s*/?>", "\n"),
    ]
)
_TEXT_RULES = [
    (r"(?i)</?(?:p|div|h[1-6]|article|section|ul|ol|table|nav|footer|header)\b[^>]*>", "\n\n"),
    (r"(?i)<(?:br|li|tr)\b[^>]*>", "\n"),
]
_TAG_RULES = [(r"(?s)<[^>]*>", "")]
_SPACE_RULES = [
    (r"[ \t]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n{3,}", "\n\n"),
]
_SPACE = " \t\n\x0b\f\r"


def _visible(html: Column) -> Column:
    """Drop what no reader sees, including the head."""
    return remove_elements(html, {"comments", "structured_data", "scripts", "styles", "head"})


def _up_to(text: Column, last: str, change) -> Column:
    """``change`` applied up to the last match of ``last``; what follows stays."""
    first = F.regexp_extract(text, f"(?is)^.*{last}", 0)
    return F.concat(change(first), F.substr(text, F.length(first) + 1))


def _apply(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        if (pattern, replacement) == _LINK_RULE:
            text = _up_to(text, r"</a\s*>", lambda t: F.regexp_replace(t, *_LINK_RULE))
        else:
            text = F.regexp_replace(text, pattern, replacement)
    return text


def _as_text(html: Column, rules: list[tuple[str, str]]) -> Column:
    """Rules for tags up to the last ">", then spaces and entities of the whole."""
    text = _up_to(_visible(html), ">", lambda t: _apply(t, rules + _TAG_RULES))
    return F.btrim(decode_entities(_apply(text, _SPACE_RULES)), F.lit(_SPACE))


def html_to_markdown(html: Column) -> Column:
    return _as_text(html, _MARKDOWN_RULES + _TEXT_RULES)


def html_to_plain_text(html: Column) -> Column:
    return _as_text(html, _TEXT_RULES)


def prefer(*candidates: Column) -> Column:
    """First non-empty candidate, '' when there is none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def html_to_text(html: Column) -> Column:
    """What the HTML extractor stores: Markdown if there is any, else plain text."""
    return prefer(html_to_markdown(html), html_to_plain_text(html))
