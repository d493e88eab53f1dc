"""Pages, chapters and overviews of extracted text, as column expressions.

A scan's text has pages apart by form feeds; ``array<struct(page, text)>`` is the common
shape.  Extraction from PDF files is a provider's business (``sources.providers``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.functions.text import bound, first_group, words

# Phrases of front matter, and the pattern of a chapter heading, which must
# not end as a line of a table of contents does.
FRONT_PHRASES = (
    "advance praise|praise for|acknowledgments|acknowledgements|danksagung|copyright|all rights reserved|alle rechte vorbehalten|dedication|widmung"
    "|table of contents|contents|inhaltsverzeichnis|inhalt|foreword|vorwort|preface|geleitwort|about the author|über den autor|über die autorin|isbn"
)
FRONT = rf"(?iu)\b(?:{FRONT_PHRASES})\b"
_NUMBER = (
    r"(\d{1,2}(?:\.\d{1,2})*|[IVX]{1,4}"
    r"|(?i:eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zehn|one|two|three|four|five|six|seven|eight|nine|ten))"
)
_CONTENTS_LINE = r"(?:\.{2,}|\s{3,}|\t)\s*\d{1,4}\s*$"
CHAPTER = rf"(?m)^\s*(?:Kapitel|Chapter|Teil|Part|Beitrag|Section)?\s*{_NUMBER}[.:]?\s+([A-ZÄÖÜ][^\n]{{3,120}})\s*$"
MARKER = r"\[S\. (\d+)\]"
CHUNK_WORDS = 3000
MAX_DROPPED = 0.5
_CUT = "\x01"


def is_scanned(text: Column) -> Column:
    """No text at all: a scan that needs recognition."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.lit(True))


def usable_labels(labels: Column) -> Column:
    """Print-page labels, or null unless all are numbers that strictly increase."""
    numbers = F.transform(labels, lambda x: F.when(x.rlike(r"^\d+$"), x.cast("int")))
    ordered = F.array_sort(F.array_distinct(numbers))
    return F.when((F.size(labels) > 0) & F.forall(numbers, lambda n: n.isNotNull()) & (ordered == numbers), labels)


def numbered(texts: Column, labels: Column) -> Column:
    """Pages by label where the list has one, else by place from 1."""
    return F.transform(
        texts,
        lambda t, i: F.struct(F.coalesce(F.when(F.get(labels, i).rlike(r"^\d+$"), F.get(labels, i)).cast("int"), i + 1).alias("page"), t.alias("text")),
    )


def scan_pages(text: Column, labels: Column | None = None) -> Column:
    """Pages of a scan without blank ones; only usable labels number pages, before blanks drop."""
    raw = F.split(text, "\f")
    filled = F.filter(raw, lambda p: ~is_scanned(p))
    plain = F.transform(filled, lambda p, i: F.struct((i + 1).alias("page"), p.alias("text")))
    if labels is None:
        return plain
    usable = usable_labels(labels)
    return F.when(usable.isNull(), plain).otherwise(F.filter(numbered(raw, usable), lambda p: ~is_scanned(p["text"])))


def marked_text(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p: F.concat(F.lit("\n\n[S. "), p["page"].cast("string"), F.lit("]\n\n"), p["text"])), "")


def page_range(text: Column) -> Column:
    """struct(first, last) of the page markers in a text, null without any."""
    found = F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda x: x.cast("int"))
    return F.struct(F.array_min(found).alias("first"), F.array_max(found).alias("last"))


def is_chapter(heading: Column) -> Column:
    """Whether a heading match is one, and no line of a table of contents."""
    return heading.rlike(CHAPTER) & ~heading.rlike(_CONTENTS_LINE)


def headings(text: Column) -> Column:
    """Chapter headings of a text, as matched."""
    return F.filter(F.regexp_extract_all(text, F.lit(CHAPTER), F.lit(0)), lambda h: ~h.rlike(_CONTENTS_LINE))


def heading_title(heading: Column) -> Column:
    return F.trim(F.regexp_extract(heading, CHAPTER, 2))


def body_pages(pages: Column) -> Column:
    """Pages without the front matter: those before the first chapter go where one of them
    has a phrase of front matter and they are half of all at most.  A chapter whose title is
    such a phrase is front matter itself."""
    opens = F.transform(pages, lambda p: F.exists(headings(p["text"]), lambda h: ~heading_title(h).rlike(FRONT)))
    at = F.coalesce(F.array_position(opens, True), F.lit(0)).cast("int") - 1
    before = F.slice(pages, 1, F.greatest(at, F.lit(0)))
    drop = (at > 0) & F.exists(before, lambda p: p["text"].rlike(FRONT)) & (at <= MAX_DROPPED * F.size(pages))
    return F.when(drop, F.slice(pages, at + 1, F.greatest(F.size(pages) - at, F.lit(0)))).otherwise(pages)


def word_chunks(text: Column, size: int = CHUNK_WORDS) -> Column:
    """array<struct(title, text, first, last)> of runs of words."""
    w = words(text)
    n = F.ceil(F.size(w) / F.lit(size)).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * size + 1, F.lit(size)), " ")))
    return F.transform(
        F.coalesce(parts, F.array().cast("array<string>")),
        lambda t, i: F.struct(
            F.concat(F.lit("Abschnitt "), (i + 1).cast("string")).alias("title"), t.alias("text"), page_range(t)["first"].alias("first"), page_range(t)["last"].alias("last")
        ),
    )


def chapters(text: Column) -> Column:
    """Chunks from heading to heading; a text with fewer than two headings is cut by words.

    A chapter's first page may be the last marker before it."""
    # A control character goes before each heading; lines of a table of contents have none.
    cut = F.regexp_replace(F.translate(text, _CUT, ""), CHAPTER.replace("(?m)^", "(?m)^(?![^\\n]*" + _CONTENTS_LINE.replace("$", "(?:\\n|\\z)") + ")"), _CUT + "$0")
    pages_of = lambda p: F.transform(F.regexp_extract_all(p, F.lit(MARKER), F.lit(1)), lambda x: x.cast("int"))

    def chapter(part: Column, earlier: Column) -> Column:
        own = F.concat(F.slice(earlier, -1, 1), pages_of(part))
        title = F.concat(F.regexp_extract(part, CHAPTER, 1), F.lit(" "), heading_title(part))
        trimmed = F.regexp_replace(part, r"\A\s+|\s+\z", "")
        return F.struct(title.alias("title"), trimmed.alias("text"), F.array_min(own).alias("first"), F.array_max(own).alias("last"))

    def of_parts(parts: Column) -> Column:
        n = F.size(parts) - 1
        seen = lambda markers: F.transform(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: bound(F.flatten(F.slice(markers, 1, i)), lambda m: chapter(F.get(parts, i), F.when(F.size(m) > 0, m).otherwise(F.array(F.lit(None).cast("int")))))
        )
        return F.when(n >= 2, bound(F.transform(parts, pages_of), seen))

    return F.coalesce(bound(F.split(cut, _CUT), of_parts), word_chunks(text))


def overview(text: Column, limit: int = 1500) -> Column:
    """Opening, chapters' beginnings (or samples of a long text) and end, within a budget of words."""
    return bound(words(text), lambda w: bound(F.slice(chapters(text), 2, 1_000_000), lambda later: _overview(w, later, limit)))


def _overview(w: Column, later: Column, limit: int) -> Column:
    n = F.size(w)
    opening = min(600, limit // 3)
    ending = F.when(n > opening + 300, min(300, limit // 5)).otherwise(0)
    middle = F.greatest(F.lit(0), limit - opening - ending)
    run = lambda a, k: F.array_join(F.slice(w, a + 1, F.greatest(k, F.lit(0))), " ")
    each = F.greatest(F.lit(50), F.floor(middle / F.greatest(F.size(later), F.lit(1))).cast("int"))
    begins = F.transform(later, lambda c: F.concat(F.lit("=== "), c["title"], F.lit(" ===\n"), F.array_join(F.slice(words(c["text"]), 1, each), " ")))
    step = 1500
    samples = F.floor((n - opening - ending + step - 1) / F.lit(step)).cast("int")
    take = F.greatest(F.lit(100), F.floor(middle / F.greatest(F.lit(1), F.floor((n - opening) / F.lit(step)))).cast("int"))
    # Samples of one size follow until the budget is used; the last may be shorter.
    taken = F.transform(
        F.sequence(F.lit(0), F.greatest(samples - 1, F.lit(0))), lambda i: F.struct((opening + i * step).alias("a"), F.least(take, middle - i * take).alias("k"))
    )
    texts = F.transform(F.filter(taken, lambda s: s["k"] > 0), lambda s: run(s["a"], s["k"]))
    inner = F.when(F.size(later) > 0, F.concat(F.lit("[Kapitel-Überblick:]\n"), F.array_join(begins, "\n\n"))).when(
        (n > 3000) & (samples > 0), F.concat(F.lit("[Stichproben:]\n"), F.array_join(texts, "\n\n[...]\n\n"))
    )
    end = F.when(ending > 0, F.concat(F.lit("[Ende:]\n"), run(n - ending, ending)))
    return F.concat_ws("\n\n", run(F.lit(0), F.lit(opening)), inner, end)


def info_fields(output: Column) -> Column:
    """Fields of an info listing.  Title, Subject and Pages may be cited; the file's author and
    creation year only describe the file and come under other names."""
    field = lambda k: F.nullif(F.trim(F.try_element_at(F.regexp_extract_all(output, F.lit(rf"(?m)^{k}:(.*)$"), F.lit(1)), F.lit(-1))), F.lit(""))
    return F.struct(
        field("Title").alias("title"),
        field("Subject").alias("subject"),
        field("Pages").alias("pages"),
        field("Author").alias("info_author"),
        first_group(field("CreationDate"), r"\b((?:19|20)\d{2})\b").alias("info_year"),
    )


def anchor_page(has_text: Column, index: Column, labels: Column) -> Column:
    """The page by which the sheet at ``index`` (from 0) is cited: its numeric label, else its
    place among the sheets with text; null for a sheet without text."""
    label = F.trim(F.get(labels, index))
    so_far = F.size(F.filter(F.slice(has_text, 1, F.greatest(index + 1, F.lit(0))), lambda x: x))
    return F.when(F.get(has_text, index), F.coalesce(F.when(label.rlike(r"^\d+$"), label.cast("int")), so_far))


# The openings of figure captions and of table captions, and the page classes.
CAPTION = r"(?iu)^\s*((?:Abbildung|Abb\.|Figure|Fig\.)\s*\d+[A-Za-z]?)\s*[:.\-]\s*(.+?)\s*$"
TABLE_CAPTION = r"(?iu)^\s*(?:Tabelle|Table)\s+\d+\b"


def captions(page_text: Column) -> Column:
    """array<struct(line, label, text)> of numbered figure captions that open a line."""
    lines = F.transform(F.split(page_text, "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.trim(F.regexp_replace(x, r"\s+", " ")).alias("text")))
    found = F.filter(lines, lambda x: x["text"].rlike(CAPTION) & ~x["text"].rlike(TABLE_CAPTION))
    return F.transform(found, lambda x: F.struct(x["line"].alias("line"), F.regexp_extract(x["text"], CAPTION, 1).alias("label"), x["text"].alias("text")))


def page_signal(has_caption: Column, has_raster: Column) -> Column:
    """Four classes of a page by what it shows."""
    return (
        F.when(has_caption & has_raster, "captioned_raster")
        .when(has_caption, "captioned_no_raster")
        .when(has_raster, "raster_uncaptioned")
        .otherwise("no_signal")
    )
