"""Plans over note bodies: sentences, anchors, footnotes and links.

Bodies are made from the rows of the tables, so what is found again is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import markdown as M
from folium.functions import text as T
from folium.operators import render
from folium.plans.registry import Registry
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def parts(spark, sf_dir):
    """(p_partkey, name, brand, kind, size)"""
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))


def say(*values):
    return F.concat(*[F.col(v[1:]) if v.startswith("$") else F.lit(v) for v in values])


_SPLIT = r"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\s+([A-ZÄÖÜ])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query("f4_markdown_sentences", rf"""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS b, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, i, regexp_replace(CASE WHEN i % 3 = 0 THEN '- ' || b WHEN i % 3 = 1 THEN '> ' || b ELSE b END, '^\s+|\s+$', '', 'g') AS b FROM b),
s AS (SELECT doc_id, i, unnest(CASE WHEN regexp_matches(b, '^(- |\* |> |#|\|)') THEN [b] ELSE {_SPLIT.format(t="b")} END) AS s FROM t WHERE b <> '') SELECT doc_id, count(*) AS n, sha256(string_agg(s, '|' ORDER BY i)) AS h FROM (SELECT doc_id, i, string_agg(s, '|') AS s FROM s GROUP BY ALL) GROUP BY doc_id""".replace("count(*) AS n, ", ""))
def markdown_sentences(spark, sf_dir):
    """Blocks that are lists or quotes are one piece, prose is cut into sentences."""
    mark = lambda i: F.when((i + 1) % 3 == 0, "- ").when((i + 1) % 3 == 1, "> ").otherwise("")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda b, i: F.concat(mark(i), b)), "\n\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", M.sentences(body).alias("s"))
    return rows.select("doc_id", F.sha2(F.array_join("s", "|"), 256).alias("h"))


@query("f7_short_pieces", r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)
SELECT doc_id, sha256(array_to_string(list_filter(flatten(list_transform(s, lambda x: list_transform(string_split(regexp_replace(x, '^\s+|\s+$', '', 'g'), chr(10)), lambda p: trim(p, E'*-> \t')))), lambda p: p <> ''), '|')) AS h FROM s""")
def short_pieces(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(M.short_pieces(F.col("text")), "|"), 256).alias("h"))


@query("f104_strip_sentences", "SELECT p_partkey, 'First of ' || p_name || '.' || chr(10) || chr(10) || '- a list. of ' || p_brand AS body FROM part")
def strip_sentences(spark, sf_dir):
    body = say("First of ", "$name", ".  A Shared one (S. 4).\n\n- a list. of ", "$brand", "\n\nA shared  one.")
    return parts(spark, sf_dir).select("p_partkey", M.without_sentences(body, F.array(F.lit("a shared one."))).alias("body"))


@query("w36_last_anchor", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '(S. 7, S. 9)' END AS anchor FROM part")
def last_anchor(spark, sf_dir):
    t = F.when(F.col("size") % 2 == 0, say("$name", " (S. 3) and (S. 7, S. 9) end")).otherwise(say("$name", " (S 3)"))
    return parts(spark, sf_dir).select("p_partkey", M.last_anchor(t).alias("anchor"))


@query("w28_trailing_anchor", """SELECT p_partkey, 'One of ' || p_name || ' (S. 3–4). Two of it (S. 3–4).' || chr(10) || chr(10) || '- a list (S. 5). No more.' || chr(10) || chr(10) || 'No anchor. Here neither.' || chr(10) || chr(10) || 'Held (S. 6). Own (S. 8).' AS body FROM part""")
def trailing_anchor(spark, sf_dir):
    """A second pass changes nothing."""
    body = say("One of ", "$name", " (S. 3–4). Two of it.\n\n- a list (S. 5). No more.\n\nNo anchor. Here neither.\n\nHeld (S. 6). Own (S. 8).")
    return parts(spark, sf_dir).select("p_partkey", M.with_trailing_anchors(M.with_trailing_anchors(body)).alias("body"))


@query("f15_page_anchors", "SELECT p_partkey, [p_name || '. (S. 1)', p_brand || '. (S. 2)', p_type || '. (S. 2)'] AS s FROM part")
def page_anchors(spark, sf_dir):
    """Sentences with their pages; more sentences than pages take the last page."""
    given = F.array(say("$name", "."), say("$brand", "."), say("$kind", "."))
    return parts(spark, sf_dir).select("p_partkey", render.page_anchors(given, F.array(F.lit(1), F.lit(2))).alias("s"))


@query("f16_footnotes_by_page", "SELECT p_partkey, p_name || '[^1] ' || p_brand || '[^2] x[^1]' || chr(10) || chr(10) || '[^1]: S. ' || p_size || chr(10) || '[^2]: S. 99' AS t FROM part")
def footnotes_by_page(spark, sf_dir):
    pages = F.array(F.col("size").cast("int"), F.lit(99), F.col("size").cast("int"))
    return parts(spark, sf_dir).select("p_partkey", render.footnotes_by_page(F.array("name", "brand", F.lit("x")), pages).alias("t"))


@query("f17_inline_footnotes", """SELECT p_partkey, p_name || '[^1] and[^2].' || chr(10) || '> quoted (S. 5)' || chr(10) || 'end[^3]' || chr(10) || chr(10) || '[^1]: Lee 2001, S. 3' || chr(10) || '[^2]: Lee 2001, S. 4–5' || chr(10) || '[^3]: Lee 2001, S. 3' AS t FROM part""")
def inline_footnotes(spark, sf_dir):
    body = say("$name", " (S. 3) and (S. 4–5).\n> quoted (S. 5)\nend (S. 3)")
    return parts(spark, sf_dir).select("p_partkey", M.inline_footnotes(body, F.lit("Lee 2001")).alias("t"))


@query("f18_renumber_footnotes", """SELECT p_partkey, p_name || '[^1] and [^2] and [^1].' || chr(10) || '[^2]: b' || chr(10) || '[^1]: a' AS t FROM part""")
def renumber_footnotes(spark, sf_dir):
    body = say("$name", "[^7] and [^1] and [^7].\n[^1]: b\n[^3]: unused\n[^7]: a")
    return parts(spark, sf_dir).select("p_partkey", M.renumbered_footnotes(body).alias("t"))


@query("f58_wikilinks", """SELECT p_partkey, '[[' || p_brand || ']] and X' || p_name || ' then [[' || p_name || ' Title]], again ' || p_name || ' long and [[old]] old' AS t FROM part""")
def wikilinks(spark, sf_dir):
    """The longest key first, a title once, links untouched."""
    key = F.upper("name")
    mentions = F.array(
        F.struct(F.concat(key, F.lit(" LONG")).alias("key"), F.lit("never").alias("title")), F.struct(key.alias("key"), F.concat("name", F.lit(" Title")).alias("title")),
        F.struct(F.col("name").alias("key"), F.concat("name", F.lit(" Title")).alias("title")), F.struct(F.lit("old").alias("key"), F.lit("Old").alias("title")),
    )
    body = say("[[", "$brand", "]] and X", "$name", " then ", "$name", ", again ", "$name", " long and [[old]] old")
    chosen = F.filter(mentions, lambda m: ~m["title"].isin("never", "Old"))
    return parts(spark, sf_dir).select("p_partkey", M.with_links(body, chosen).alias("t"))


@query("f59_heading_description", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || ': more' ELSE '' END AS d FROM part")
def heading_description(spark, sf_dir):
    body = F.when(F.col("size") % 2 == 0, say("\n# ", "$name", ": ", "$brand", ": more \ntext: no")).otherwise(say("# ", "$name", "\nx: y"))
    return parts(spark, sf_dir).select("p_partkey", M.heading_description(body).alias("d"))


@query("f65_quoted_anchors", "SELECT p_partkey, p_name || ' is what it says' AS quote, 'S. ' || p_size AS page FROM part")
def quoted_anchors(spark, sf_dir):
    body = say("Lee: „", "$name", " is what it says“, so it is (S. ", "$size", "). And „far away from any page“ ")
    body = F.concat(body, F.repeat(F.lit("word "), F.lit(40)), F.lit("(S. 9)"))
    return parts(spark, sf_dir).select("p_partkey", F.explode(M.quoted_anchors(body)).alias("a")).select("p_partkey", "a.quote", "a.page")


@query("f89_footnote_anchors", "SELECT p_partkey, unnest(['A claim of ' || p_name || '.', 'Two.']) AS sentence, unnest([p_size, 12])::INT AS page FROM part")
def footnote_anchors(spark, sf_dir):
    note = say("A claim of ", "$name", ".[^1] Two.[^2] No page.[^3]\n\n[^1]: Lee 2001, S. ", "$size", "\n[^2]: Lee, S. 12\n[^3]: Lee")
    rows = parts(spark, sf_dir).select("p_partkey", F.explode(M.footnote_anchors(note)).alias("a"))
    return rows.select("p_partkey", "a.sentence", "a.page")


@query("f84_perturb_body", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Say: ' || p_type || ' $1 changed, and ' || p_name || ' is here' END AS t FROM part")
def perturb_body(spark, sf_dir):
    """The first occurrence, white space apart; null where the claim is not in the body."""
    body = F.when(F.col("size") % 2 == 0, say("Say: ", "$name", "\n  is   here, and ", "$name", " is here")).otherwise(F.lit("nothing"))
    return parts(spark, sf_dir).select("p_partkey", M.perturbed(body, say("$name", " is here"), say("$kind", " $1 changed")).alias("t"))


@query("f67_trim_context", "SELECT doc_id, CASE WHEN length(text) <= 1000 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE '…' || regexp_replace(text[length(text) // 2 - 499:length(text) // 2 + 500], '^\\s+|\\s+$', '', 'g') || '…' END AS t FROM documents")
def trim_context(spark, sf_dir):
    """The middle thousand characters (the operator's own limit)."""
    return table(spark, sf_dir, "documents").select("doc_id", M.trimmed(F.col("text")).alias("t"))


@query("f11_evidence_key", r'''SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(regexp_replace(translate(regexp_replace(text || ' ﬁ-x', '(\w)-\n(\w)', '\1\2', 'g'), '„“”', '"""'), '\s+', ' ', 'g')), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '-\s+', '', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS k FROM documents''')
def evidence_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.evidence_key(F.concat("text", F.lit(" ﬁ-x"))).alias("k"))


@query("s34_note_render", """WITH p AS (SELECT p_partkey, '---' || chr(10) || 'title: ' || p_name || chr(10) || 'tags: ["' || p_type || '", "' || p_brand || '"]' || chr(10) || '---' || chr(10) || chr(10) || '# ' || p_name || chr(10) || chr(10) || 'Body.' || chr(10) AS plain FROM part)
SELECT p_partkey, replace(plain, '---' || chr(10) || 'title', '---' || chr(10) || 'content_hash: ' || substr(sha256(plain), 1, 16) || chr(10) || 'title') AS note FROM p""")
def note_render(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", render.note(F.col("name"), F.array("kind", "brand"), F.lit("Body.")).alias("note"))


@query("p41_pristine", "SELECT p_partkey, p_size % 3 = 0 AS pristine FROM part")
def pristine(spark, sf_dir):
    """A note as rendered, one that was edited, and one without a hash."""
    note = render.note(F.col("name"), F.array("kind"), F.lit("Body."))
    kind = F.col("size") % 3
    given = F.when(kind == 0, note).when(kind == 1, F.concat(note, F.lit("more"))).otherwise("# no hash")
    return parts(spark, sf_dir).select("p_partkey", render.pristine(given).alias("pristine"))


@query("f114_content_hash_line", "SELECT p_partkey, substr(sha256('---' || chr(10) || 'title: ' || p_name || chr(10) || '---' || chr(10) || 'x'), 1, 16) AS h FROM part")
def content_hash_line(spark, sf_dir):
    """The hash line that is put into a note is found again, and is that of the note without it."""
    given = say("---\ntitle: ", "$name", "\n---\nx")
    return parts(spark, sf_dir).select("p_partkey", render.stored_hash(render.with_hash(given)).alias("h"))


@query("s33_merge_stub", "SELECT p_partkey, '---' || chr(10) || 'type: merge-stub' || chr(10) || 'merge-target: \"[[' || p_brand || ']]\"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || p_name || chr(10) || chr(10) || '- Bestehend: [[' || p_brand || ']]' || chr(10) || '- Neu: ' || p_name || chr(10) || chr(10) || 'Body.' || chr(10) AS note FROM part")
def merge_stub(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", render.merge_stub(F.col("name"), F.col("brand"), F.lit("Body.")).alias("note"))


@query("s35_hub_render", "SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || 'Kept prose.' || chr(10) || chr(10) || '## Komponenten' || chr(10) || chr(10) || '1. [[A]]: first' || chr(10) || '2. [[B]]' || chr(10) || '3. [[C]]: third' || chr(10) AS note FROM part")
def hub_render(spark, sf_dir):
    """A numbered list of components; a paragraph that only lists them goes."""
    subs = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(d).alias("description")) for t, d in (("A", "first"), ("B", ""), ("C", "third"))])
    body = F.lit("Kept prose.\n\nThere are [[A]], [[B]] and [[C]].")
    return parts(spark, sf_dir).select("p_partkey", render.hub(F.col("name"), body, subs).alias("note"))


@query("f115_tag_list", "SELECT p_partkey, '**Nah:**' || chr(10) || '- ' || p_brand || chr(10) || chr(10) || '**Übrige:**' || chr(10) || '- ' || least(p_name, p_type) || chr(10) || '- ' || greatest(p_name, p_type) AS t FROM part")
def tag_list(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", render.tag_list(F.array("brand"), F.array("name", "kind")).alias("t"))
