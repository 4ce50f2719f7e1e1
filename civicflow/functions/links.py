"""Links and paths out of stored web pages (G-HTML, G-URL, G-DATE)."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.functions.text import before, blank, col, let, stripped

_ANCHOR_START = r"(?i)<a(?=\s)"
_ANCHOR_END = r"(?i)</a\s*>"
# The inside of a tag, in which a quoted value may hold a closing bracket.
_INSIDE = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_ATTRIBUTE = r"[^\s=/\"'>]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
_TAG = rf"<[a-zA-Z/!?]{_INSIDE}>|<[a-zA-Z/!?][^>]*+(?:>|$)"
# What a browser neither shows nor follows.
_HIDDEN = r"(?is)<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)"
_REST = r"(?:#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"
# Character by entity name, by the public HTML table, as one constant.
_ENTITIES = json.dumps({name[:-1]: char for name, char in html5.items() if name.endswith(";")}, ensure_ascii=False)


def _named(name: Column) -> Column:
    """Character of an entity name; NULL if unknown."""
    return F.try_element_at(F.from_json(F.lit(_ENTITIES), "map<string,string>"), name)


def _character(code: Column) -> Column:
    """Character of a code point, NULL beyond Unicode: its UTF-32 bytes, read as text."""
    legal = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(legal, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def unescape(c) -> Column:
    """Plain text of numeric and named character entities; unknown ones stay.

    Text without an ampersand is left alone, which is nearly all of it.
    """

    def read(part: Column) -> Column:
        found = F.regexp_extract(part, "^(" + _REST + ")", 1)
        name = F.regexp_replace(found, "^#|;$", "")
        hexadecimal = F.conv(F.regexp_replace(name, "^[xX]0*", ""), 16, 10).try_cast("int")
        number = F.when(F.lower(F.left(name, F.lit(1))) == "x", hexadecimal).otherwise(name.try_cast("int"))
        char = F.when(found.startswith("#"), _character(number)).otherwise(_named(name))
        tail = F.substr(part, F.length(found) + 1)
        return F.when((found != "") & char.isNotNull(), F.concat(char, tail)).otherwise(F.concat(F.lit("&"), part))

    def decoded(text: Column) -> Column:
        parts = F.split(text, "&")
        rest = F.array_join(F.transform(_after_first(parts), read), "")
        return F.when(text.contains("&"), F.concat(F.get(parts, F.lit(0)), rest)).otherwise(text)

    return let(col(c), decoded)


def visible(html) -> Column:
    """A page without its comments, scripts and styles."""
    return F.regexp_replace(blank(html), _HIDDEN, "")


def _after_first(parts: Column) -> Column:
    return let(parts, lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))


def anchors(html) -> Column:
    """Array of (href, text), one for each anchor with a target (G-HTML).

    The page is cut at every anchor start, so the work is linear in its length.
    """
    return _anchors_in(visible(html))


def _anchors_in(shown: Column) -> Column:
    return F.filter(F.transform(_after_first(F.split(shown, _ANCHOR_START)), _anchor), lambda a: a["href"].isNotNull())


def _head(piece: Column) -> Column:
    """What a tag holds after its name; quoted brackets are inside, unless a quote is never closed."""
    quoted = F.regexp_extract(piece, rf"^({_INSIDE})>", 1)
    return F.when(piece.rlike(rf"^{_INSIDE}>"), quoted).otherwise(F.regexp_extract(piece, "^([^>]*)", 1))


def _anchor(piece: Column) -> Column:
    """(href, text) of the page from within an anchor's tag on; ``href`` is NULL if it has no target."""

    def read(head: Column) -> Column:
        attributes = F.regexp_extract_all(head, F.lit(f"({_ATTRIBUTE})"), F.lit(1))
        own = F.get(F.filter(attributes, lambda a: a.rlike(r"(?is)^href\s*=")), F.lit(0))
        value = F.regexp_replace(own, r"(?is)^href\s*=\s*", "")
        bare = F.when(value.rlike("^[\"']"), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        body = F.get(F.split(F.substr(piece, F.length(head) + 2), _ANCHOR_END, 2), F.lit(0))
        shown = F.regexp_replace(body, _TAG, "")
        return F.struct(unescape(bare).alias("href"), F.when(own.isNotNull(), stripped(unescape(shown))).alias("text"))

    return let(_head(piece), read)


def explode_anchors(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per anchor with its position on the page (G-HTML)."""
    keep = [c for c in pages.columns if c != html] if keep is None else keep
    found = pages.select(*keep, F.posexplode(anchors(html)).alias("pos", "anchor"))
    return found.select(*keep, "pos", F.col("anchor.href").alias("href"), F.col("anchor.text").alias("text"))


def listing(html) -> Column:
    """What stands in the page's first table of class ``dataTable``, tables in it included; NULL without one.

    The page is cut where tables begin and end, and a running depth tells which end is the listing's own.
    """
    page = F.get(F.split(visible(html), _LISTING, 2), F.lit(1))
    cut = F.split(page, r"(?i)(?=</?table[\s>])")
    kind = "struct<depth:int,body:array<string>>"

    def walk(state: Column, piece: Column) -> Column:
        turn = F.when(piece.rlike(r"(?i)^<table[\s>]"), 1).when(piece.rlike(r"(?i)^</table[\s>]"), -1).otherwise(0)

        def on(depth: Column) -> Column:
            body = F.when(depth > 0, F.concat(state["body"], F.array(piece))).otherwise(state["body"])
            return F.struct(depth.alias("depth"), body.alias("body")).cast(kind)

        # Once the listing has ended, the depth stays at 0.
        return F.when(state["depth"] > 0, let(state["depth"] + turn, on)).otherwise(state)

    begin = F.struct(F.lit(1).alias("depth"), F.array().cast("array<string>").alias("body")).cast(kind)
    return F.when(page.isNotNull(), F.array_join(F.aggregate(cut, begin, walk, lambda s: s["body"]), ""))


def cell_anchor(html) -> Column:
    """Array of (href, text): the first anchor of each cell of the listing (G-HTML).

    The listing is the page's first table of class ``dataTable``; links of other tables, such as menus, do not count.
    A cell reaches to its own end, so a cell that holds a table begins with the first anchor of that one, and that
    one's cells have theirs too.
    """
    pieces = _after_first(F.split(blank(listing(html)), r"(?i)<td(?=[\s>])"))

    def closings(text: Column) -> Column:
        return F.size(F.split(text, r"(?i)</td\s*>")) - 1

    def own(piece: Column) -> Column:
        first = F.get(_anchors_in(piece), F.lit(0))
        until = F.get(F.split(piece, _ANCHOR_START, 2), F.lit(0))
        return F.struct(first.alias("anchor"), closings(until).alias("before"), closings(piece).alias("all"))

    # From the last cell to the first: the next anchor, and how many cells end on the way to it.
    kind = "struct<anchor:struct<href:string,text:string>,ends:int,found:array<struct<href:string,text:string>>>"
    nothing = F.struct(
        F.lit(None).cast("struct<href:string,text:string>").alias("anchor"), F.lit(0).alias("ends"),
        F.array().cast("array<struct<href:string,text:string>>").alias("found"),
    ).cast(kind)

    def back(state: Column, cell: Column) -> Column:
        here = cell["anchor"].isNotNull()
        anchor = F.when(here, cell["anchor"]).otherwise(state["anchor"])
        ends = F.when(here, cell["before"]).otherwise(F.greatest(cell["all"], cell["all"] - 1 + state["ends"]))
        found = F.when(anchor.isNotNull() & (ends <= 0), F.concat(F.array(anchor), state["found"])).otherwise(state["found"])
        return F.struct(anchor.alias("anchor"), ends.alias("ends"), found.alias("found")).cast(kind)

    return F.aggregate(F.reverse(F.transform(pieces, own)), nothing, back, lambda s: s["found"])


_LISTING = rf"(?is)<table(?=\s)(?=(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*?\sclass\s*=\s*(?:\"[^\"]*\bdataTable\b|'[^']*\bdataTable\b|dataTable\b)){_INSIDE}>"


def readable(url) -> Column:
    """Percent-decoded address; the input when it cannot be decoded (G-URL).

    A plus sign is a plus sign here, not a space.
    """
    kept = F.replace(col(url), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(kept), col(url))


def path_parts(url) -> Column:
    """Parts between slashes, empty ones dropped, query tail cut at & (G-URL)."""
    parts = F.split(before(url, "&"), "/+")
    return F.filter(parts, lambda p: p != "")


def path_part(url, index: int) -> Column:
    """Zero-based part of the path, NULL when the path is shorter (G-URL)."""
    return F.get(path_parts(url), F.lit(index))


# The months by their first three letters, in order, and words that count as a month.
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?"
)
# A token of a date: a month's word, a number with or without an ordinal's ending, or numbers joined by one mark.
_DATE_TOKEN = (
    rf"(?i)(?<![a-z0-9])(?:{_MONTH})(?![a-z])|(?<![0-9])[0-9]{{1,4}}(?<mark>[-/._])[0-9]{{1,2}}\k<mark>[0-9]{{2,4}}(?![0-9])"
    r"|(?<![0-9])[0-9]{1,2}(?:st|nd|rd|th)(?![a-z])|(?<![0-9])[0-9]{1,2}(?![0-9])|(?<![0-9])[0-9]{4}(?![0-9])"
)


def date_in(text) -> Column:
    """The first full date of a text, in any usual spelling; NULL if it has none (G-DATE).

    The text is cut into tokens with roles: the word of a month, a day (one or two digits, or an ordinal), a year (four
    digits), and numbers joined by one mark.  A month's word takes the day and the year next to it, in the order month
    day year, day month year or year month day.  Joined numbers begin with the year if that has four digits, and else
    are month, day and year, or day and month where the first cannot be a month; years of two digits turn at 69.
    """
    tokens = F.filter(F.regexp_extract_all(F.lower(col(text)), F.lit(f"({_DATE_TOKEN})"), F.lit(1)), lambda t: t != "")

    def number(c: Column) -> Column:
        return F.regexp_extract(blank(c), "^([0-9]+)", 1).try_cast("int")

    def day_of(year: Column, month: Column, day: Column) -> Column:
        whole = F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(year)
        shown = F.concat_ws("-", F.lpad(whole.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
        return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_date(shown, "yyyy-MM-dd"))

    def joined(token: Column) -> Column:
        parts = F.split(token, "[-/._]")
        a, b, c = (F.get(parts, F.lit(k)).try_cast("int") for k in range(3))
        long = F.length(F.get(parts, F.lit(0))) == 4
        plain = F.when(a > 12, day_of(c, b, a)).otherwise(day_of(c, a, b))
        return F.when(long, day_of(a, b, c)).otherwise(plain)

    def at(k: Column) -> Column:
        token = F.get(tokens, k)
        month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.left(token, F.lit(3))).try_cast("int")
        before, after, next_ = (number(F.get(tokens, F.when(k + d >= 0, k + d))) for d in (-1, 1, 2))
        earlier = number(F.get(tokens, F.when(k >= 1, k - 1)))
        spelled = F.coalesce(
            F.when((after <= 31) & (next_ >= 1000), day_of(next_, month, after)),
            F.when((before <= 31) & (after >= 1000), day_of(after, month, before)),
            F.when((earlier >= 1000) & (after <= 31), day_of(earlier, month, after)),
        )
        return F.when(token.rlike("^[a-z]"), spelled).when(token.rlike("^[0-9]+[-/._]"), joined(token))

    places = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))), at)
    return F.get(F.filter(places, lambda d: d.isNotNull()), F.lit(0))


def first_date_in_path(url, stop: str = "Public Notice") -> Column:
    """First date in a path part, such as 'October 22, 2019', NULL when none (G-DATE).

    A part without a day, a month and a year has no date.
    """
    parts = path_parts(before(before(url, "&"), stop))
    return F.get(F.filter(F.transform(parts, date_in), lambda d: d.isNotNull()), F.lit(0))
