"""Parsers of sentinel-marked model output, as column expressions.

A text is cut at lines that hold one known sentinel ``<!--NAME-->``.  Cutting is one
``regexp_replace`` that turns each sentinel line into control characters, and ``split``s on
those; blocks are nested splits (a note's sections, an anchor's quote), so no state is
carried from line to line.  Control characters \\x01 and \\x02 in the input are dropped.

Every parser returns a struct with ``warnings``, an array of what was left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.functions.text import csv_items, null_word

# The sentinels of the format, and the accepted words of two fields.
SENTINELS = ["NOTE", "BODY", "ANCHOR", "QUOTE", "REVISION_HINT", "CONCEPT", "CONTRADICTION", "RELATED", "END"]
CATEGORIES = ["architectural", "operational", "conceptual"]
ORIGINS = ["primary", "extension", "secondary_mention"]
YES = ["true", "yes", "1", "t", "y"]
_OPEN, _CLOSE = "\x01", "\x02"
_LINE = r"(?m)^[^\S\n]*<!--(" + "|".join(SENTINELS) + r")-->[^\S\n]*$\n?"
_EMPTY = "array<string>"


def yes(value: Column) -> Column:
    """Whether a value is a word for yes; null is no."""
    return F.coalesce(F.lower(F.trim(value)).isin(YES), F.lit(False))


def first_int(value: Column, default: int = 0) -> Column:
    """The first whole number in a value."""
    return F.coalesce(F.nullif(F.regexp_extract(value, r"(-?\d+)", 1), F.lit("")).cast("int"), F.lit(default))


def marked(text: Column) -> Column:
    """A text up to its END, with sentinels as control characters."""
    plain = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, ""), r"\r\n?", "\n")
    cut = F.regexp_replace(plain, _LINE, _OPEN + "$1" + _CLOSE)
    return F.get(F.split(cut, f"{_OPEN}END{_CLOSE}"), F.lit(0))


def preamble(cut: Column) -> Column:
    return F.get(F.split(cut, _OPEN), F.lit(0))


def sections(cut: Column) -> Column:
    """array<struct(name, content)> of a marked text, without the preamble."""
    parts = F.split(cut, _OPEN)
    return F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(F.substring_index(p, _CLOSE, 1).alias("name"), F.substring_index(p, _CLOSE, -1).alias("content")),
    )


def split_sections(text: Column) -> Column:
    """The sections of a text; what stands before the first sentinel has a null name."""
    cut = marked(text)
    head = F.struct(F.lit(None).cast("string").alias("name"), preamble(cut).alias("content"))
    return F.concat(F.array(head), sections(cut))


def headers(content: Column) -> Column:
    """The ``key: value`` lines of a block as a map; the last value of a key counts."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"^[a-z][a-z_-]*:"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.replace(F.substring_index(x, ":", 1), F.lit("-"), F.lit("_")).alias("k"), null_word(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")
        ),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def header(content: Column, key: str) -> Column:
    """One header's value: the last line of that key, hyphens and underscores alike."""
    found = F.regexp_extract_all(content, F.lit(rf"(?m)^{key.replace('_', '[_-]')}:[^\S\n]*(.*)$"), F.lit(1))
    return null_word(F.try_element_at(found, F.lit(-1)))


def heredoc(content: Column) -> Column:
    """A free text: blank lines at its ends go, inner white space stays."""
    return F.regexp_replace(content, r"\A\n+|\n+\z", "")


def _of(block: Column, name: str) -> Column:
    """Contents of the named sections of a block."""
    found = F.filter(F.split(block, _OPEN), lambda p: F.startswith(p, F.lit(name + _CLOSE)))
    return F.transform(found, lambda p: F.substring_index(p, _CLOSE, -1))


def _blocks(cut: Column, name: str) -> Column:
    """Texts from each named sentinel to the next of its kind."""
    parts = F.split(cut, _OPEN + name + _CLOSE)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _lead(block: Column) -> Column:
    """What stands in a block before its first inner section."""
    return F.get(F.split(block, _OPEN), F.lit(0))


def _warn(*cases: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(when, F.lit(text)) for when, text in cases]))


def _anchor(block: Column) -> Column:
    quotes = _of(block, "QUOTE")
    return F.struct(
        header(_lead(block), "page").alias("page"),
        F.nullif(heredoc(_last(quotes)), F.lit("")).alias("quote"),
        yes(header(_lead(block), "verified")).alias("verified"),
    )


def notes(text: Column) -> Column:
    """struct(notes, warnings) of NOTE blocks with body and quoted anchors."""
    cut = marked(text)

    def note(block: Column) -> Column:
        head = _lead(block)
        items = lambda k: F.coalesce(csv_items(header(head, k)), F.array().cast(_EMPTY))
        anchors = F.filter(F.transform(_blocks(block, "ANCHOR"), _anchor), lambda a: a["quote"].isNotNull())
        return F.struct(
            header(head, "title").alias("title"),
            items("aliases").alias("aliases"),
            items("tags").alias("tags"),
            items("proposed_tags").alias("proposed_tags"),
            header(head, "synthesis_confidence").alias("synthesis_confidence"),
            header(head, "action").alias("action"),
            header(head, "extend_path").alias("extend_path"),
            heredoc(_last(_of(block, "BODY"))).alias("body"),
            F.transform(anchors, lambda a: F.struct(a["page"].alias("page"), a["quote"].alias("quote"))).alias("source_anchors"),
        )

    blocks = _blocks(cut, "NOTE")
    found = F.transform(blocks, note)
    named = F.filter(found, lambda n: n["title"].isNotNull())
    before = F.get(F.split(cut, f"{_OPEN}NOTE{_CLOSE}"), F.lit(0))
    lost = F.exists(blocks, lambda b: F.exists(F.transform(_blocks(b, "ANCHOR"), _anchor), lambda a: a["quote"].isNull()))
    warnings = _warn(
        (F.size(named) < F.size(found), "a note without a title was dropped"),
        (F.contains(before, F.lit(_OPEN)), "a section before the first note was dropped"),
        (F.exists(blocks, lambda b: F.size(_of(b, "BODY")) > 1), "a note has several bodies, the last counts"),
        (lost, "an anchor without a quote was dropped"),
    )
    return F.struct(named.alias("notes"), warnings.alias("warnings"))


def one_note(text: Column) -> Column:
    """struct(note, warnings): the first note; none and several are warned of."""
    parsed = notes(text)
    n = F.size(parsed["notes"])
    more = _warn((n == 0, "no note"), (n > 1, "several notes, the first counts"))
    return F.struct(F.get(parsed["notes"], F.lit(0)).alias("note"), F.concat(parsed["warnings"], more).alias("warnings"))


def concept_plan(text: Column) -> Column:
    """struct(source_title, source_summary, concepts, warnings); fields have defaults."""
    cut = marked(text)
    top = preamble(cut)
    word = lambda b, k, d: F.lower(F.coalesce(header(b, k), F.lit(d)))
    known = lambda v, among, d: F.when(v.isin(among), v).otherwise(d)

    def concept(block: Column) -> Column:
        b = _lead(block)
        return F.struct(
            header(b, "title").alias("title"),
            word(b, "priority", "medium").alias("priority"),
            F.coalesce(header(b, "chapter"), F.lit("")).alias("chapter"),
            word(b, "action", "create").alias("action"),
            header(b, "extend_path").alias("extend_path"),
            known(word(b, "category", "conceptual"), CATEGORIES, "conceptual").alias("category"),
            known(word(b, "origin", "primary"), ORIGINS, "primary").alias("origin"),
            F.coalesce(csv_items(header(b, "cited_authors")), F.array().cast(_EMPTY)).alias("cited_authors"),
        )

    blocks = _blocks(cut, "CONCEPT")
    found = F.transform(blocks, concept)
    named = F.filter(found, lambda c: c["title"].isNotNull())
    odd = lambda k, d, among: F.exists(blocks, lambda b: header(_lead(b), "title").isNotNull() & ~word(_lead(b), k, d).isin(among))
    warnings = _warn(
        (F.size(named) < F.size(found), "a concept without a title was dropped"),
        (odd("category", "conceptual", CATEGORIES), "an unknown category became conceptual"),
        (odd("origin", "primary", ORIGINS), "an unknown origin became primary"),
    )
    text_of = lambda k: F.coalesce(header(top, k), F.lit(""))
    return F.struct(
        text_of("source_title").alias("source_title"), text_of("source_summary").alias("source_summary"), named.alias("concepts"), warnings.alias("warnings")
    )


def verification(text: Column) -> Column:
    """struct(all_verified, anchors, warnings); an anchor counts even without a quote."""
    cut = marked(text)
    before = F.get(F.split(cut, f"{_OPEN}ANCHOR{_CLOSE}"), F.lit(0))
    warnings = _warn((F.size(_of(before, "QUOTE")) > 0, "a quote before the first anchor was dropped"))
    return F.struct(
        yes(header(preamble(cut), "all_verified")).alias("all_verified"), F.transform(_blocks(cut, "ANCHOR"), _anchor).alias("anchors"), warnings.alias("warnings")
    )


TESTS = ["title_test", "glance_test", "future_self_test", "quellen_test", "deletion_test"]


def critique(text: Column) -> Column:
    """Five tests, a score from 0 to 5 and a hint; what is missing is false, 0 and null."""
    cut = marked(text)
    top = preamble(cut)
    score = F.greatest(F.lit(0), F.least(F.lit(5), first_int(header(top, "score"))))
    hint = F.nullif(heredoc(_last(_of(cut, "REVISION_HINT"))), F.lit(""))
    return F.struct(*[yes(header(top, t)).alias(t) for t in TESTS], score.alias("score"), hint.alias("revision_hint"))


def cross_reference(text: Column) -> Column:
    """struct(duplicate_risk, duplicate_path, contradictions, related, warnings).

    A related line is one plain wiki link; other lines are left out."""
    cut = marked(text)
    top = preamble(cut)
    against = F.filter(F.transform(_of(cut, "CONTRADICTION"), heredoc), lambda c: c != "")
    lines = F.filter(F.transform(F.flatten(F.transform(_of(cut, "RELATED"), lambda c: F.split(c, "\n"))), lambda x: F.trim(x)), lambda x: x != "")
    links = F.filter(lines, lambda x: x.rlike(r"^\[\[[^\[\]]+\]\]$"))
    return F.struct(
        F.coalesce(header(top, "duplicate_risk"), F.lit("none")).alias("duplicate_risk"),
        header(top, "duplicate_path").alias("duplicate_path"),
        against.alias("contradictions"),
        links.alias("related"),
        _warn((F.size(links) < F.size(lines), "a related line is no plain link")).alias("warnings"),
    )


def background(text: Column) -> Column:
    """map of concept -> its claims: blocks of a title line and ``- `` lines from CLAIMS to END.

    A block without a title or without claims is left out; of equal titles the last counts."""
    pairs = F.transform(
        F.split(text, "<!--CONCEPT-->"),
        lambda b: F.struct(
            F.trim(F.regexp_extract(b, r"(?m)^title:\s*(.+)$", 1)).alias("k"),
            F.filter(
                F.transform(
                    F.regexp_extract_all(F.regexp_extract(b, r"(?s)<!--CLAIMS-->(.*?)<!--END-->", 1), F.lit(r"(?m)^[^\S\n]*-(.*)$"), F.lit(1)),
                    lambda x: F.trim(F.ltrim(x, F.lit("- "))),
                ),
                lambda x: x != "",
            ).alias("v"),
        ),
    )
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & (F.size(p["v"]) > 0))
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"])))


def json_array(text: Column, schema: str) -> Column:
    """An array from a text that is one, else from its outermost brackets, else null."""
    inner = F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))
    ok = lambda t: F.when(t.rlike(r"(?s)^\s*\[.*\]\s*$"), F.from_json(t, schema))
    return F.coalesce(ok(text), ok(inner))
