"""Markdown rendering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_anchor(sentence: Column, page: Column) -> Column:
    """A sentence with its page."""
    return F.concat(sentence, F.lit(" (S. "), page.cast("string"), F.lit(")"))


def page_anchors(sentences: Column, pages: Column) -> Column:
    """Sentences with their pages; those beyond the list take the last page."""
    return F.transform(sentences, lambda s, i: page_anchor(s, F.get(pages, F.least(i, F.size(pages) - 1))))


def strip_anchors(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*\(S\. \d+(?:-\d+)?\)", "")


def yaml_list(items: Column) -> Column:
    quoted = F.transform(items, lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def footnotes_by_page(sentences: Column, pages: Column) -> Column:
    """Sentences with footnote marks and the notes below; equal pages share a number."""
    distinct = F.array_distinct(pages)
    marked = F.zip_with(
        sentences, pages, lambda s, p: F.concat(s, F.lit("[^"), F.array_position(distinct, p).cast("string"), F.lit("]"))
    )
    notes = F.transform(distinct, lambda p, i: F.concat(F.lit("[^"), (i + 1).cast("string"), F.lit("]: S. "), p.cast("string")))
    return F.concat(F.array_join(marked, " "), F.lit("\n\n"), F.array_join(notes, "\n"))


def note(title: Column, tags: Column, body: Column) -> Column:
    """A note with frontmatter, and the hash of its content in it."""
    return with_hash(F.concat(F.lit("---\ntitle: "), title, F.lit("\ntags: "), yaml_list(tags), F.lit("\n---\n\n# "), title, F.lit("\n\n"), body, F.lit("\n")))


def with_hash(plain: Column) -> Column:
    """A note with the hash of its content as the first line of its frontmatter."""
    h = F.substring(F.sha2(plain, 256), 1, 16)
    return F.regexp_replace(plain, r"\A---\n", F.concat(F.lit("---\ncontent_hash: "), h, F.lit("\n")))


def stored_hash(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, r"(?m)^content_hash: (\w+)$", 1), F.lit(""))


def merge_stub(title: Column, target: Column, body: Column) -> Column:
    """A note that points at the one it is to be merged with."""
    link = F.concat(F.lit("[["), target, F.lit("]]"))
    head = F.concat(F.lit('---\ntype: merge-stub\nmerge-target: "'), link, F.lit('"\n---\n\n# '), title)
    return F.concat(head, F.lit("\n\n- Bestehend: "), link, F.lit("\n- Neu: "), title, F.lit("\n\n"), body, F.lit("\n"))


#: A paragraph with so many links to components and so few words a link only lists them.
LISTED, WORDS_A_LINK = 3, 25


def hub(title: Column, body: Column, subs: Column) -> Column:
    """A hub note: prose, then the components (title, description) as a numbered list.

    A paragraph that enumerates the components goes."""
    links = lambda p: F.size(F.filter(subs, lambda s: F.contains(p, F.concat(F.lit("[["), s["title"]))))
    words = lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))
    prose = F.filter(F.split(body, "\n\n"), lambda p: ~((links(p) >= LISTED) & (words(p) <= WORDS_A_LINK * links(p))))
    item = lambda s, i: F.concat(
        (i + 1).cast("string"), F.lit(". [["), s["title"], F.lit("]]"), F.when(s["description"] != "", F.concat(F.lit(": "), s["description"])).otherwise("")
    )
    listed = F.array_join(F.transform(subs, item), "\n")
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(prose, "\n\n"), F.lit("\n\n## Komponenten\n\n"), listed, F.lit("\n"))


def tag_list(near: Column, rest: Column) -> Column:
    """Tags as bullets, those near the source first; each part in name order."""
    bullets = lambda tags: F.array_join(F.transform(F.array_sort(tags), lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.concat_ws(
        "\n\n",
        F.when(F.size(near) > 0, F.concat(F.lit("**Nah:**\n"), bullets(near))),
        F.when(F.size(rest) > 0, F.concat(F.lit("**Übrige:**\n"), bullets(rest))),
    )


def pristine(content: Column) -> Column:
    """Whether a note still has the content that its hash was made of; none says no."""
    stored = F.regexp_extract(content, r"(?m)^content_hash: (\w+)$", 1)
    plain = F.regexp_replace(content, r"(?m)^content_hash: .*\n", "")
    return F.coalesce(stored == F.substring(F.sha2(plain, 256), 1, 16), F.lit(False))


def write_notes(rows: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """Note files as rows (name, content) of a table that is partitioned by name's first letter.

    One table instead of a file for each note: small files do not scale."""
    letter = F.lower(F.substring(name, 1, 1))
    rows.select(name, content, letter.alias("letter")).write.mode("overwrite").partitionBy("letter").parquet(path)
