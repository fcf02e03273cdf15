"""One pass over a page that removes whole elements, however they are nested or left open.

Every place is looked at a bounded number of times: the next ">", "-->" and closing
tag of each name are found once and kept until the pass is beyond them, and one that is
not there is not looked for again.
"""

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# What belongs to each kind of element (fixed values): "pairs" go with their content and can
# hold each other, "raw" ones hold text that is no markup, "tags" go alone, "both" are
# removed as opening and closing tags while their content stays.
ELEMENTS = {
    "comments": {},
    "structured_data": {"raw": ["script"]},
    "scripts": {"raw": ["script"], "pairs": ["noscript"]},
    "styles": {"raw": ["style"], "tags": ["link"]},
    "meta": {"tags": ["meta"]},
    "iframes": {"pairs": ["iframe"]},
    "embeds": {"pairs": ["object"], "both": ["embed"]},
    "media": {"pairs": ["video", "audio"], "tags": ["source", "track"]},
    "images": {"pairs": ["picture", "svg"], "tags": ["img"]},
    "tables": {"pairs": ["table"]},
    "forms": {"both": ["form"]},
    "buttons": {"pairs": ["button"]},
    "inputs": {"raw": ["textarea"], "pairs": ["select"], "tags": ["input"]},
    "links": {"both": ["a"]},
    "head": {"pairs": ["head"]},
}
#: Elements whose content is text up to their own closing tag, removed or not.
RAW = ("script", "style", "textarea")

_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:_-]*)")
_CLOSING = {name: re.compile(rf"</{name}[ \t\n\x0b\f\r]*>", re.IGNORECASE) for name in RAW}


def removed_ranges(html: str, kinds: frozenset[str]) -> list[tuple[int, int]]:
    """Ranges of the elements of ``kinds``, by their ends; a range may lie in a later one.

    An element that is never closed stays, and so does its content but for elements in it
    that are closed. Of elements that cross, the one that is closed first ends those
    opened inside it.
    """
    named = lambda part: {name for kind in kinds for name in ELEMENTS[kind].get(part, ())}
    pairs, alone, both = named("pairs"), named("tags"), named("both")
    raw = named("raw")
    ranges, open_, depth = [], [], {}
    ahead = {}  # where the next of a kind of mark is, from the place last asked for

    def following(mark: str, at: int, search) -> tuple[int, int] | None:
        found = ahead.get(mark, (-1, -1))
        if found is not None and found[0] < at:
            found = ahead[mark] = search(at)
        return found

    def literal(text: str):
        def search(at: int):
            place = html.find(text, at)
            return None if place < 0 else (place, place + len(text))

        return search

    def closing(name: str):
        def search(at: int):
            found = _CLOSING[name].search(html, at)
            return None if found is None else found.span()

        return search

    gt, comment, close_of = literal(">"), literal("-->"), {name: closing(name) for name in RAW}
    at = html.find("<")
    while at >= 0:
        after = at + 1
        if html.startswith("!--", after):
            end = following("-->", at + 4, comment)
            if end is not None:
                if "comments" in kinds:
                    ranges.append((at, end[1]))
                after = end[1]
        elif tag := _NAME.match(html, after):
            end = following(">", tag.end(), gt)
            if end is None:
                break  # no tag ends any more
            name, after = tag[1].lower(), tag.end()
            if html[at + 1] == "/":
                if name in both:
                    ranges.append((at, end[1]))
                elif depth.get(name):
                    while True:
                        inner, start = open_.pop()
                        depth[inner] -= 1
                        if inner == name:
                            break
                    ranges.append((start, end[1]))
            elif name in RAW:
                close = following(name, end[1], close_of[name])
                if close is not None:
                    kind = "structured_data" if name == "script" and "application/ld+json" in html[at : end[1]].lower() else "scripts"
                    if name in raw and (name != "script" or kind in kinds):
                        ranges.append((at, close[1]))
                    after = close[1]
            elif name in pairs:
                open_.append((name, at))
                depth[name] = depth.get(name, 0) + 1
                after = end[1]
            elif name in both or name in alone:
                if name != "link" or "stylesheet" in html[at : end[1]].lower():
                    ranges.append((at, end[1]))
                after = end[1]
        at = html.find("<", after)
    return ranges


def without_elements(html: str, kinds: frozenset[str]) -> str:
    out, at = [], 0
    for start, end in sorted(removed_ranges(html, kinds)):
        if start > at:
            out.append(html[at:start])
        at = max(at, end)
    out.append(html[at:])
    return "".join(out)


@cache
def _remover(kinds: frozenset[str]):
    @F.arrow_udf("string")
    def remove(pages: pa.Array) -> pa.Array:
        return pa.array([None if page is None else without_elements(page, kinds) for page in pages.to_pylist()], pa.string())

    return remove


def remove_elements(html: Column, kinds: set[str]) -> Column:
    return _remover(frozenset(kinds))(html) if kinds else html
