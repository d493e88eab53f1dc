"""Sentences, anchors, footnotes and links of note bodies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.functions.acronyms import quoted
from folium.functions.text import strip, words

# A page anchor with ranges and lists, and what opens a block that is no prose.
ANCHOR = r"\(S\.\s*\d+(?:\s*[\-–,]\s*(?:S\.\s*)?\d+)*\)"
BLOCK = r"^(- |\* |> |#|\|)"
TRAILING = 240
_EDGE = r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])"
_EDGE_QUOTED = r"(?<=[.!?])\s+(?=[A-ZÄÖÜ\"„])"


def blocks(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, "\n\n"), strip), lambda b: b != "")


def sentences(body: Column) -> Column:
    """Sentences of prose; lists, quotes, headings and tables are one piece each."""
    cut = F.transform(blocks(body), lambda b: F.when(b.rlike(BLOCK), F.array(b)).otherwise(F.split(b, _EDGE)))
    return F.filter(F.transform(F.flatten(cut), strip), lambda s: s != "")


def short_pieces(body: Column) -> Column:
    """Sentences and lines for an encoder, without list and emphasis marks at their ends."""
    cut = F.flatten(F.transform(F.split(body, r"(?<=[.!?…])\s+"), lambda s: F.split(strip(s), "\n")))
    return F.filter(F.transform(cut, lambda p: F.btrim(p, F.lit("*-> \t"))), lambda p: p != "")


def sentence_key(sentence: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(sentence, r"\s*\(S\.?\s*\d+(?:[–\-]\d+)?\)", ""), r"\s+", " ")))


def without_sentences(body: Column, keys: Column) -> Column:
    """A body without the sentences of some keys, a blank line between the others."""
    return strip(F.array_join(F.filter(sentences(body), lambda s: ~F.array_contains(keys, sentence_key(s))), "\n\n"))


def last_anchor(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(0)), F.lit(-1))


def with_trailing_anchors(body: Column) -> Column:
    """Paragraphs whose last sentence has no anchor take that of the sentence before it.

    A last sentence of over 240 characters, and blocks that are no prose, stay."""

    def repaired(paragraph: Column) -> Column:
        p = strip(paragraph)
        cut = F.split(p, _EDGE_QUOTED)
        n = F.size(cut)
        last, anchor = strip(F.try_element_at(cut, F.lit(-1))), last_anchor(F.get(cut, n - 2))
        apply = ~p.rlike(BLOCK) & (n >= 2) & (last != "") & (F.char_length(last) <= TRAILING) & ~last.rlike(ANCHOR) & anchor.isNotNull()
        end = F.regexp_extract(last, r"([.!?]\"?\s*)$", 1)
        head = F.rtrim(F.regexp_replace(last, r"[.!?]\"?\s*$", ""))
        made = F.concat(head, F.lit(" "), anchor, end)
        before = F.transform(F.slice(cut, 1, F.greatest(n - 1, F.lit(1))), strip)
        return F.when(apply, F.array_join(F.array_append(before, made), " ")).otherwise(paragraph)

    return F.array_join(F.transform(F.split(body, "\n\n"), repaired), "\n\n")


def inline_footnotes(body: Column, source: Column) -> Column:
    """Each anchor becomes a footnote of its own, numbered as they come; quote lines stay."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.struct(x.alias("t"), F.when(F.ltrim(x).rlike("^>"), 0).otherwise(F.regexp_count(x, F.lit(ANCHOR))).alias("n")))

    def add(state: Column, line: Column) -> Column:
        cut = F.split(line["t"], r"\s*" + ANCHOR)
        marked = F.transform(cut, lambda p, i: F.when(i < line["n"], F.concat(p, F.lit("[^"), (state["n"] + i + 1).cast("string"), F.lit("]"))).otherwise(p))
        text = F.when(line["n"] > 0, F.array_join(marked, "")).otherwise(line["t"])
        return F.struct((state["n"] + line["n"]).alias("n"), F.array_append(state["out"], text).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(lines, start, add)
    pages = F.flatten(F.transform(F.filter(lines, lambda x: x["n"] > 0), lambda x: F.regexp_extract_all(x["t"], F.lit(r"\(S\.\s*(\d+(?:\s*[\-–,]\s*(?:S\.\s*)?\d+)*)\)"), F.lit(1))))
    notes = F.transform(pages, lambda p, i: F.concat(F.lit("[^"), (i + 1).cast("string"), F.lit("]: "), source, F.lit(", S. "), p))
    return F.concat(F.array_join(done["out"], "\n"), F.when(F.size(notes) > 0, F.concat(F.lit("\n\n"), F.array_join(notes, "\n"))).otherwise(""))


def renumbered_footnotes(text: Column) -> Column:
    """Footnotes numbered in the order of their first use; notes that nothing uses go."""
    used = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\^(\d+)\](?!:)"), F.lit(1)))
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\[\^\d+\]:") | F.array_contains(used, F.regexp_extract(x, r"^\[\^(\d+)\]:", 1)))
    # A number is first marked as done, so that no new number is replaced again.
    named = F.transform(used, lambda u, i: F.struct(u.alias("a"), (i + 1).cast("string").alias("b")))
    step = lambda t, u: F.replace(t, F.concat(F.lit("[^"), u["a"], F.lit("]")), F.concat(F.lit("[^\x01"), u["b"], F.lit("]")))
    return F.replace(F.aggregate(named, F.array_join(kept, "\n"), step), F.lit("[^\x01"), F.lit("[^"))


def with_links(body: Column, mentions: Column) -> Column:
    """The first bare occurrence of each mention (key, title) becomes a link; links stay as they are.

    Mentions come longest key first and a title is linked once."""

    def add(state: Column, m: Column) -> Column:
        bare = F.concat(F.lit(r"(?isu)\A(.*?)(?<!\[)(?<![\p{L}\p{N}_])"), quoted(m["key"]), F.lit(r"(?![\p{L}\p{N}_])(?!\])"))
        hit = F.rlike(state["t"], bare) & ~F.array_contains(state["done"], m["title"])
        text = F.regexp_replace(state["t"], bare, F.concat(F.lit("$1[["), F.regexp_replace(m["title"], r"([\\$])", r"\\$1"), F.lit("]]")))
        return F.struct(F.when(hit, text).otherwise(state["t"]).alias("t"), F.when(hit, F.array_append(state["done"], m["title"])).otherwise(state["done"]).alias("done"))

    return F.aggregate(mentions, F.struct(body.alias("t"), F.array().cast("array<string>").alias("done")), add, lambda s: s["t"])


def heading_description(body: Column) -> Column:
    """What follows ``: `` in a first line that is a top heading."""
    first = F.trim(F.substring_index(F.regexp_replace(body, r"\A\s+", ""), "\n", 1))
    return F.when(first.rlike("^# .*: "), F.trim(F.regexp_replace(first, r"^.*?: ", ""))).otherwise("")


def quoted_anchors(body: Column) -> Column:
    """array<struct(quote, page)>: quotes in a body that an anchor follows within 120 characters."""
    pattern = r'[„“"]([^„“”"]{10,}?)[“”"](?:(?![„“”"])[\s\S]){0,120}?\(S\.\s*(\d+(?:[-–]\d+)?)\)'
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("quote"), F.concat(F.lit("S. "), F.regexp_extract(m, pattern, 2)).alias("page"))))


def footnote_anchors(note: Column) -> Column:
    """array<struct(sentence, page)>: sentences with a footnote whose note names a page."""
    listed = F.transform(
        F.regexp_extract_all(note, F.lit(r"(?m)^\[\^\d+\]:.*?S\.\s*\d+"), F.lit(0)),
        lambda d: F.struct(F.regexp_extract(d, r"^\[\^(\d+)\]", 1).alias("k"), F.regexp_extract(d, r"S\.\s*(\d+)$", 1).cast("int").alias("v")),
    )
    keys = F.transform(listed, lambda d: d["k"])
    notes = F.map_from_entries(F.filter(listed, lambda d, i: F.array_position(keys, d["k"]) == i + 1))
    body = F.regexp_replace(note, r"(?m)^\[\^\d+\]:.*$", "")
    rows = F.flatten(
        F.transform(
            F.split(body, r"(?<=[.!?\]])\s+"),
            lambda s: F.transform(
                F.regexp_extract_all(s, F.lit(r"\[\^(\d+)\]"), F.lit(1)),
                lambda k: F.struct(F.trim(F.regexp_replace(s, r"\[\^\d+\]", "")).alias("sentence"), F.try_element_at(notes, k).alias("page")),
            ),
        )
    )
    return F.array_distinct(F.filter(rows, lambda r: r["page"].isNotNull() & (F.char_length(r["sentence"]) > 0)))


def perturbed(body: Column, claim: Column, other: Column) -> Column:
    """A body with a claim's first occurrence replaced, white space apart; null where it does not occur."""
    loose = F.array_join(F.transform(words(claim), quoted), r"\\s+")
    pattern = F.concat(F.lit(r"(?s)\A(.*?)"), F.replace(loose, F.lit(r"\\s+"), F.lit(r"\s+")))
    return F.when(F.rlike(body, pattern), F.regexp_replace(body, pattern, F.concat(F.lit("$1"), F.regexp_replace(other, r"([\\$])", r"\\$1"))))


def trimmed(text: Column, radius: int = 500) -> Column:
    """The middle of a text, with an ellipsis where it is cut."""
    n = F.char_length(text)
    start = F.greatest(F.lit(0), F.floor(n / F.lit(2)).cast("int") - radius)
    end = F.least(n, F.floor(n / F.lit(2)).cast("int") + radius)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), strip(F.substring(text, start + 1, end - start)), F.when(end < n, "…").otherwise(""))
    return F.when(n <= 2 * radius, strip(text)).otherwise(cut)
