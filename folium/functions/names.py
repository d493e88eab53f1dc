"""Authors, titles, file names and source labels, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.functions.text import RESERVED_STEMS, first_group

# Words of institutions, placeholder authors and titles, and unsafe characters.
INSTITUTION = (
    r"(?iu)\b(universi(?:ty|t[äa]t|dad|t[ée]|t[àa])|institut(?:e|o|ion)?|department|fakult[äa]t|faculty|hochschule|polytechnic|academy|akademie|laborator(?:y|ies)"
    r"|laboratoire|hospital|klinik|clinic|minist(?:ry|erium|ère)|foundation|stiftung|society|gesellschaft|associat(?:ion|ed)|verband|council|committee|kommission"
    r"|commission|corporation|incorporated|gmbh|inc|ltd|llc|plc|centre|center|zentrum|bureau|agency|agentur|organi[sz]ation)\b"
)
GARBAGE_AUTHORS = "someauthor author unknown user administrator admin root owner creator microsoft adobe none n/a anonymous null".split()
GARBAGE_TITLE = r"(?i)^(endnotes?[\s\d]|sometitle|untitled|document\b)"
TITLE_FILE = r"(?i)\.(pdf|docx?|odt|pptx?)$"
UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'
SEPARATOR = r"(?i)\s*;\s*|\s+und\s+|\s+and\s+|\s*&\s*"
AUTHOR_YEAR_TITLE = r"^(.+?)\s+-\s+(\d{4})\s+-\s+(.+)$"
AUTHOR_TITLE = r"^(.+?)\s+-\s+(.+?)$"
NO_YEAR = r"^([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s,\.]+?)\s+-\s+([A-Z].{10,})$"
YEAR = r"(?<![0-9])(1[89]\d{2}|20[012]\d)(?![0-9])"
MIN_SHARED, MIN_FORWARD, MIN_REVERSE = 2, 0.5, 0.6

# Letters with marks and what they are without; built from the character database.
_FOLD = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(c))) > 1}


def folded(text: Column) -> Column:
    """Lower case, Latin letters without their marks."""
    low = F.regexp_replace(F.lower(text), r"[̀-ͯ]", "")
    return F.translate(low, "".join(_FOLD), "".join(_FOLD.values()))


def without_markup(text: Column) -> Column:
    """Entities decoded, then tags gone."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(text, "<[^>]+>", " ")


def significant_tokens(title: Column) -> Column:
    """Distinct words of four letters or more, without markup, marks and digits."""
    words = F.regexp_extract_all(folded(without_markup(F.coalesce(title, F.lit("")))), F.lit(r"\p{L}+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.char_length(w) >= 4))


def titles_match(query: Column, result: Column) -> Column:
    """Whether a found title is the one asked for: two words shared, half of the query in it, six
    tenths of its main part from the query; a main part that says less than the query is not
    enough where the whole title lacks a word of the query."""
    q, full = significant_tokens(query), significant_tokens(result)
    main = significant_tokens(F.get(F.split(result, r":\s*|\s+[–—-]\s+"), F.lit(0)))
    with_main, with_full = F.size(F.array_intersect(q, main)), F.size(F.array_intersect(q, full))
    less = (with_main == F.size(main)) & (F.size(main) < F.size(q)) & (with_full < F.size(q))
    enough = (with_main >= MIN_SHARED) & (with_full >= MIN_FORWARD * F.size(q)) & (with_main >= MIN_REVERSE * F.size(main))
    return (F.size(q) > 0) & (F.size(main) > 0) & ~less & enough


def table_cell(text: Column) -> Column:
    """A text as a cell of a markdown table."""
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("\n", " "), ("\r", " ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(text)


def plausible_author(author: Column) -> Column:
    a = F.trim(author)
    return (F.char_length(a) >= 2) & ~F.lower(a).isin(GARBAGE_AUTHORS) & ~F.startswith(a, F.lit("(")) & ~F.endswith(a, F.lit(")")) & ~a.rlike(r"^[A-Z]\.?$")


def plausible_title(title: Column) -> Column:
    t = F.trim(title)
    return (F.char_length(t) >= 3) & ~t.rlike(GARBAGE_TITLE) & ~t.rlike(TITLE_FILE)


def is_institution(segment: Column) -> Column:
    """Two words or more, one of them of an institution (a single word may be a surname)."""
    return (F.size(F.filter(F.split(segment, r"\s+"), lambda w: w != "")) >= 2) & segment.rlike(INSTITUTION)


def persons(author: Column) -> Column:
    """An author field without institutions beside persons; the first separator joins them."""
    parts = F.filter(F.transform(F.split(author, SEPARATOR), lambda p: F.trim(p)), lambda p: p != "")
    people = F.filter(parts, lambda p: ~is_institution(p))
    mixed = (F.size(people) > 0) & (F.size(people) < F.size(parts))
    return F.when(mixed, _joined(people, author)).otherwise(author)


def _joined(parts: Column, author: Column) -> Column:
    sep = F.regexp_extract(author, r"(?i)(\s*;\s*|\s+und\s+|\s+and\s+|\s*&\s*)", 1)
    tail = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), lambda s, p: F.concat(s, sep, p))
    return F.concat(F.get(parts, F.lit(0)), tail)


def stem(file: Column) -> Column:
    """A file name without folders and its last extension."""
    name = F.substring_index(file, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def _without_et_al(author: Column) -> Column:
    return F.trim(F.regexp_replace(author, r"(?i)\s+et al\.?$", ""))


def strict_name(file: Column) -> Column:
    """struct(author, year, title) of ``Author - Year - Title`` or ``Author - Title``, else null."""
    s = stem(file)
    full, short = s.rlike(AUTHOR_YEAR_TITLE), s.rlike(AUTHOR_TITLE)
    part = lambda p, k: F.trim(F.regexp_extract(s, p, k))
    return F.when(
        full, F.struct(persons(part(AUTHOR_YEAR_TITLE, 1)).alias("author"), part(AUTHOR_YEAR_TITLE, 2).alias("year"), part(AUTHOR_YEAR_TITLE, 3).alias("title"))
    ).when(short, F.struct(persons(part(AUTHOR_TITLE, 1)).alias("author"), F.lit(None).cast("string").alias("year"), part(AUTHOR_TITLE, 2).alias("title")))


def dynamic_name(file: Column) -> Column:
    """struct(author, year, title) by the first form that fits: author, year and title apart by
    dashes; a year anywhere with author and title around it; author and title without a year."""
    s = stem(file)
    row = lambda a, y, t: F.struct(a.alias("author"), y.cast("int").alias("year"), t.alias("title"))
    edge = F.lit(" -_")
    whole = row(persons(_without_et_al(F.trim(F.regexp_extract(s, AUTHOR_YEAR_TITLE, 1)))), F.regexp_extract(s, AUTHOR_YEAR_TITLE, 2), F.trim(F.regexp_extract(s, AUTHOR_YEAR_TITLE, 3)))
    around = rf"(?s)^(.*?){YEAR}(.*)$"
    before, after = F.btrim(F.regexp_extract(s, around, 1), edge), F.btrim(F.regexp_extract(s, around, 3), edge)
    # A year that comes first is followed by the author, up to a dash or underscore.
    led = (before == "") & after.rlike("[-_]")
    author = F.when(led, F.trim(F.regexp_extract(after, r"^([^-_]*)[-_]", 1))).otherwise(before)
    title = F.when(led, F.btrim(F.regexp_replace(after, r"^[^-_]*[-_]", ""), edge)).otherwise(after)
    spaced = lambda x: F.trim(F.replace(x, F.lit("_"), F.lit(" ")))
    last = F.try_element_at(F.filter(F.split(persons(_without_et_al(spaced(author))), r"\s+"), lambda w: w != ""), F.lit(-1))
    anchored = row(F.coalesce(last, F.lit("")), F.regexp_extract(s, around, 2), spaced(title))
    plain = row(persons(_without_et_al(F.trim(F.regexp_extract(s, NO_YEAR, 1)))), F.lit(None), F.trim(F.regexp_extract(s, NO_YEAR, 2)))
    return (
        F.when(s.rlike(AUTHOR_YEAR_TITLE), whole)
        .when(s.rlike(YEAR) & (F.char_length(author) >= 2) & (F.char_length(title) >= 4), anchored)
        .when(s.rlike(NO_YEAR), plain)
    )


def confirms(file: Column, author: Column) -> Column:
    """Whether a file name's surname is that of an embedded author, not a part of it."""
    last = lambda a: F.lower(F.try_element_at(F.filter(F.split(F.trim(a), r"[\s,]+"), lambda w: w != ""), F.lit(-1)))
    return F.coalesce(last(dynamic_name(file)["author"]) == last(author), F.lit(False))


def complete(author: Column, title: Column) -> Column:
    return (F.trim(F.coalesce(author, F.lit(""))) != "") & (F.trim(F.coalesce(title, F.lit(""))) != "")


def file_name(author: Column, year: Column, title: Column, longest: int = 80, longest_author: int = 40) -> Column:
    """``Author - Year - Title.pdf``; a long title ends at a word."""
    clean = lambda x, d: F.coalesce(F.nullif(F.trim(F.regexp_replace(x, UNSAFE, "")), F.lit("")), F.lit(d))
    t = clean(title, "Untitled")
    cut = F.substring(t, 1, longest)
    t = F.when(F.char_length(t) > longest, F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)).otherwise(t)
    return F.concat(F.substring(clean(author, "Unknown"), 1, longest_author), F.lit(" - "), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(" - "), t, F.lit(".pdf"))


def authors_of(author: Column) -> Column:
    """Author fields apart at semicolons, und and and."""
    return F.filter(F.transform(F.split(author, r"\s*;\s*|\s+(?:und|and)\s+"), lambda p: F.trim(p)), lambda p: p != "")


def surname(author: Column) -> Column:
    """What stands before a comma, else the last word."""
    last = F.try_element_at(F.filter(F.split(author, r"\s+"), lambda w: w != ""), F.lit(-1))
    return F.when(F.contains(author, F.lit(",")), F.trim(F.substring_index(author, ",", 1))).otherwise(last)


def short_author(author: Column) -> Column:
    """A; A & B; A et al."""
    a = F.transform(authors_of(F.coalesce(author, F.lit(""))), surname)
    return F.when(F.size(a) == 0, "Autor").when(F.size(a) == 1, a[0]).when(F.size(a) == 2, F.concat(a[0], F.lit(" & "), a[1])).otherwise(F.concat(a[0], F.lit(" et al.")))


def short_label(author: Column, year: Column, file: Column) -> Column:
    """Surname (et al.) and year; the file name's year comes first, its stem stands in for an author."""
    named = strict_name(file)
    a = F.trim(F.coalesce(F.nullif(author, F.lit("")), named["author"], F.lit("")))
    y = F.trim(F.coalesce(named["year"], year, F.lit("")))
    parts = authors_of(a)
    label = F.concat(surname(F.get(parts, F.lit(0))), F.when(F.size(parts) > 1, " et al.").otherwise(""), F.lit(" "), y)
    return F.when(F.size(parts) == 0, stem(file)).otherwise(F.trim(label))


def primary_authors(author: Column) -> Column:
    """Surnames of an author field, without initials."""
    raw = F.trim(F.regexp_replace(author, r"(?i)\s*,?\s*et\s+al\.?", ""))
    parts = F.filter(F.transform(F.split(raw, r"\s*(?:&|and|;)\s*|\s*,\s*(?=[A-Z])"), lambda p: F.trim(p)), lambda p: p != "")
    names = F.filter(F.transform(parts, surname), lambda n: (n != "") & ~n.rlike(r"^[A-Za-z]\.?$"))
    return F.when(author.isNull() | F.trim(author).isin("?", "unknown", ""), F.array().cast("array<string>")).otherwise(names)


def page_list(pages: Column) -> Column:
    """Distinct page references without their S., in the order of their first numbers."""
    bare = F.transform(pages, lambda p: F.trim(F.regexp_replace(F.trim(p), r"(?i)^\s*S\.\s*", "")))
    kept = F.array_distinct(F.filter(bare, lambda p: p.isNotNull() & ~F.lower(p).isin("", "none", "null")))
    keyed = F.transform(kept, lambda p: F.struct(F.coalesce(F.nullif(F.regexp_extract(p, r"^(\d+)", 1), F.lit("")).cast("long"), F.lit(10**9)).alias("n"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def sources_block(author: Column, year: Column, title: Column, file: Column, pages: Column, held: Column) -> Column:
    """The sources section of a note: a link where the file is held and its name is safe."""
    named = strict_name(file)
    bad = F.coalesce(F.trim(title), F.lit("")).rlike(r"^$|^[\d\s.\-]+$|^Microsoft Word")
    shown = F.coalesce(F.when(~bad, F.trim(title)), named["title"], F.nullif(F.trim(title), F.lit("")), stem(file))
    who = F.coalesce(F.nullif(F.trim(author), F.lit("")), named["author"], stem(file))
    short = short_label(who, year, file)
    link = F.when(held & ~file.rlike(r"[|#\[\]]"), F.concat(F.lit("[["), file, F.lit("|"), short, F.lit("]]"))).otherwise(short)
    p = F.array_join(page_list(pages), ", ")
    return F.concat(F.lit("## Quellen\n\n*Quelle: "), link, F.lit(": "), shown, F.when(p != "", F.concat(F.lit(", S. "), p)).otherwise(""), F.lit("*\n"))


def _dashed(raw: Column) -> Column:
    name = F.trim(F.replace(raw, F.lit(".pdf"), F.lit("")))
    return F.transform(F.split(name, " - "), lambda p: F.trim(p))


def pdf_short_name(raw: Column) -> Column:
    """``Author (Year)``, else the first part, else up to 45 characters."""
    p = _dashed(raw)
    plain = F.substring(F.trim(F.regexp_replace(p[0], r"^\d+\.", "")), 1, 45)
    return F.when(F.size(p) < 2, plain).when(F.get(p, F.lit(1)).rlike(r"^\d+$"), F.concat(p[0], F.lit(" ("), F.get(p, F.lit(1)), F.lit(")"))).otherwise(p[0])


def pdf_filter_key(raw: Column) -> Column:
    p = _dashed(raw)
    return F.when(F.size(p) < 2, p[0]).otherwise(F.concat(p[0], F.lit(" - "), F.get(p, F.lit(1))))


def clean_link(text: Column) -> Column:
    """A link's inside: brackets go from both ends as long as both have one."""
    t = F.trim(F.coalesce(text, F.lit("")))
    # Each pass takes one pair, so half the length is enough.
    passes = F.sequence(F.lit(0), F.floor(F.char_length(t) / F.lit(2)).cast("int"))
    return F.aggregate(passes, t, lambda x, _: F.trim(F.regexp_replace(x, r"(?s)\A\[(.*)\]\z", "$1")))


def link_targets(raw: Column) -> Column:
    """Stems of a list of link targets: no brackets, aliases, folders or extension."""
    parts = F.transform(F.split(clean_link(raw), ","), lambda p: F.trim(F.substring_index(p, "|", 1)))
    return F.filter(F.transform(parts, stem), lambda s: s != "")


def display_file(file: Column) -> Column:
    """A file name whose author field has persons only; other names stay."""
    n = strict_name(file)
    extension = F.regexp_extract(file, r"(\.[^.]*)$", 1)
    return F.when(n.isNull(), file).otherwise(F.concat(F.concat_ws(" - ", n["author"], n["year"], n["title"]), extension))


def citation(author: Column, year: Column, file: Column) -> Column:
    """struct(author, year): a missing author comes from the file name, whose year overrides."""
    n = strict_name(file)
    return F.struct(F.coalesce(F.nullif(author, F.lit("")), n["author"]).alias("author"), F.coalesce(n["year"], year).alias("year"))


def doi_of_name(file_stem: Column) -> Column:
    """A DOI in a file name: its first underscore is a slash."""
    found = F.regexp_extract(file_stem, r"^(10[._]\d{4,9}[._]\S{3,})", 1)
    doi = F.rtrim(F.regexp_replace(found, r"^([^_]*)_", "$1/"), F.lit("."))
    return F.when(F.startswith(doi, F.lit("10.")), doi)


def arxiv_of_name(file_stem: Column) -> Column:
    return first_group(file_stem, r"^(\d{4}\.\d{4,5})(?:v\d+)?$")


def note_file(title: Column) -> Column:
    """A note's file name: unsafe characters become dashes, the letters stay."""
    s = F.btrim(F.trim(F.regexp_replace(F.regexp_replace(title, r'[<>:"/\\|?*#]', "-"), r"\s+", " ")), F.lit("."))
    return F.concat(s, F.lit(".md"))


def hub_file(title: Column) -> Column:
    return F.concat(F.lit("MoC-"), F.btrim(F.trim(F.regexp_replace(title, r'[<>:"/\\|?*#]', "-")), F.lit(".")), F.lit(".md"))


def slug(text: Column) -> Column:
    """A label's slug of sixty characters: no folder prefix, extension or marks."""
    t = F.regexp_replace(F.regexp_replace(text, "^(inbox|vault)__", ""), r"\.md$", "")
    t = F.btrim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_\s-]", ""), r"\s+", "-"), F.lit("-"))
    return F.rtrim(F.substring(t, 1, 60), F.lit("-"))


def inside_folder(name: Column) -> Column:
    """Whether a file name stays in its folder: no separator, no dots alone, no device, no zero."""
    upper = F.upper(F.substring_index(name, ".", 1))
    return ~name.rlike(r"[/\\\x00]") & ~F.trim(name).isin("", ".", "..") & ~upper.isin(RESERVED_STEMS)


def path_title(path: Column) -> Column:
    """The title that a path stands for: a sibling's pseudo path names it, else the file's stem."""
    return F.coalesce(first_group(path, r"^<sibling:(.+)>$"), stem(path))
