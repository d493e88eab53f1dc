"""Text plans over documents: tokens, sentences, chunks, identifiers, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.plans.registry import Registry
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(columns or ("text",)))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOKENS = r"list_filter(list_distinct(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+')), lambda w: length(w) >= 3 AND w NOT IN (" + _STOP + "))"


@query("f1_content_tokens", f"SELECT doc_id, len(toks) AS n, sha256(array_to_string(list_sort(toks), ' ')) AS h FROM (SELECT doc_id, {_TOKENS.format(t='text')} AS toks FROM documents)")
def content_tokens(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.array_sort(T.content_tokens(F.col("text"))).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("h"))


@query("f2_title_key", r"SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), ' ') AS k FROM documents")
def title_key(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.title_key(F.col("text")).alias("k"))


_ENDS = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)


def split_sql(t: str) -> str:
    """Marks go to every candidate end, and from those that are held."""
    t = rf"regexp_replace({t}, '([.!?])(\s+)', '\1' || chr(1) || '\2', 'g')"
    t = rf"regexp_replace({t}, '({_ENDS}|(?:^|[^\p{{L}}\p{{N}}_])[A-Z]\.)' || chr(1), '\1', 'g')"
    return rf"list_filter(list_transform(string_split({t}, chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query("f5_sentences", f"SELECT doc_id, len(s) AS n, list_aggregate(list_transform(s, lambda x: length(x)), 'max') AS longest FROM (SELECT doc_id, {split_sql('text')} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    longest = F.array_max(F.transform("s", F.char_length))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), longest.cast("long").alias("longest"))


# A note about each text: callouts, footnotes, links, repeats and citations are added.
_NOTE_SQL = r"""'# Head ' || source || chr(10) || '> [!quote] said' || chr(10) || '> a quoted sentence of more than thirty characters.' || chr(10) || '[^1]: S. 4' || chr(10) || text || '[^1] '
  || chr(10) || 'A claim with [[Target|the shown words]] in more than thirty characters. A CLAIM with [[Target|the shown words]] in more than thirty characters. Schlebbe und Greifeneder et al. 2022, S. 145.'"""


def note_of():
    return F.concat(
        F.lit("# Head "), "source", F.lit("\n> [!quote] said\n> a quoted sentence of more than thirty characters.\n[^1]: S. 4\n"), "text",
        F.lit("[^1] \nA claim with [[Target|the shown words]] in more than thirty characters. A CLAIM with [[Target|the shown words]] in more than thirty characters. Schlebbe und Greifeneder et al. 2022, S. 145."),
    )


_PLAIN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^[^\S\n]*> \[!quote\][^\n]*(?:\n[^\S\n]*>[^\n]*)*\n?', '', 'g'), '(?m)^\[\^\d+\]:.*$|\[\^\d+\]|(?m:^#+\s+)', '', 'g'), '[*_`>#-]+', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"""


@query("f9_without_callouts", r"SELECT doc_id, sha256(regexp_replace(t, '(?m)^[^\S\n]*> \[!quote\][^\n]*(?:\n[^\S\n]*>[^\n]*)*\n?', '', 'g')) AS h FROM (SELECT doc_id, " + _NOTE_SQL + " AS t FROM documents)")
def callouts_dropped(spark, sf_dir):
    return docs(spark, sf_dir, "source", "text").select("doc_id", F.sha2(T.without_callouts(note_of()), 256).alias("h"))


_CLAIMS_SQL = rf"""n AS (SELECT doc_id, {_NOTE_SQL} AS t FROM documents), b AS (SELECT doc_id, {_PLAIN_SQL} AS t FROM n),
s AS (SELECT doc_id, list_filter(list_transform({split_sql("t")}, lambda x: trim(x, E' \t\r\n:;,-')), lambda x: length(x) >= 30) AS s FROM b),
r AS (SELECT doc_id, unnest(s) AS c, generate_subscripts(s, 1) AS pos FROM s), f AS (SELECT doc_id, arg_min(c, pos) AS c FROM r GROUP BY doc_id, lower(c)),
v AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(c, '\[\[[^\]|]*\|([^\]]*)\]\]', '\1', 'g'), '\[\[([^\]]*)\]\]', '\1', 'g'), '\s+', ' ', 'g'), E' \t\r\n:;,-') AS c FROM f WHERE NOT regexp_matches(c, '^\s*\[\[[^\]]*\]\]\s*\d*\.?\s*$')),
claims AS (SELECT doc_id, c FROM v WHERE length(c) >= 30 AND NOT regexp_matches(c, '{T.META}')
  AND NOT regexp_matches(c, '{T.CITATION}'))"""


@query("f8_claims", f"WITH {_CLAIMS_SQL} SELECT doc_id, c AS claim FROM claims")
def claim_extraction(spark, sf_dir):
    """One row per claim, whole."""
    return docs(spark, sf_dir, "source", "text").select("doc_id", F.explode(T.claims(note_of())).alias("claim"))


@query("p6_meta_claims", """WITH c AS (SELECT p_partkey, unnest(['[[' || p_name || ']] 2.', 'see [[x|' || p_name || ']] for what is said about ' || p_brand, 'Merge stub: die bestehende Note existiert schon lange', 'Bates et al. 1999, Kuhlthau & Belkin 2004, S. 12-14', p_name]) AS c FROM part)
SELECT p_partkey, 'see ' || p_name || ' for what is said about ' || p_brand AS claim FROM part""")
def meta_claims(spark, sf_dir):
    """Of five claims the one about content stays, its link shown by its alias."""
    found = F.array(
        F.concat(F.lit("[["), "p_name", F.lit("]] 2.")), F.concat(F.lit("see [[x|"), "p_name", F.lit("]] for what is said about "), "p_brand"),
        F.lit("Merge stub: die bestehende Note existiert schon lange"), F.lit("Bates et al. 1999, Kuhlthau & Belkin 2004, S. 12-14"), F.col("p_name"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(T.content_claims(found)).alias("claim"))


def _language_sql(t: str) -> str:
    count = lambda words: f"len(list_filter(string_split_regex(lower({t}[1:2000]), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({words})))"
    german = count("'der','die','das','und','ist','werden','nicht','eine','einer'")
    english = count("'the','and','is','are','not','with','from','this','that'")
    return f"CASE WHEN regexp_matches({t}, '[äöüßÄÖÜ]') OR {german} >= {english} THEN 'DE' ELSE 'EN' END"


@query("f34_language_pair", f"""SELECT d.doc_id, {_language_sql("s.text")} || '→' || {_language_sql("d.text")} AS pair FROM documents d JOIN benchmark s ON s.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")
def language_pair(spark, sf_dir):
    """The languages of a source (here: a benchmark text) and of a note."""
    sources = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("source"))
    n = F.broadcast(sources.agg(F.count("*").alias("n")))  # one row
    rows = docs(spark, sf_dir).crossJoin(n).withColumn("item_id", F.col("doc_id") % F.col("n")).join(sources, "item_id")
    return rows.select("doc_id", T.language_pair(F.col("text"), F.col("source")).alias("pair"))


@query("f33_language_pair_v1", "SELECT doc_id, CASE WHEN regexp_matches(text[1:500], '[äöüßÄÖÜ]') THEN 'DE' ELSE 'EN' END AS guess FROM documents")
def language_pair_v1(spark, sf_dir):
    """The older rule: an umlaut among the first 500 characters (its own limit)."""
    return docs(spark, sf_dir).select("doc_id", F.when(F.substring("text", 1, 500).rlike("[äöüßÄÖÜ]"), "DE").otherwise("EN").alias("guess"))


# Identifiers of several shapes are put into the running text of each document.
_IDS_SQL = r"""text || CASE doc_id % 4 WHEN 0 THEN ' see doi:10.1000/ab' || doc_id || '). ' WHEN 1 THEN ' https://doi.org/10.12345/x.' || doc_id || ', and ' WHEN 2 THEN ' DOI 10.5555/(' || source || ')' || ';' ELSE ' no 10.1/x ' END
  || CASE doc_id % 3 WHEN 0 THEN ' ISBN-13: 978-3-16-148410-0 ' WHEN 1 THEN ' isbn 316148410X' ELSE ' ISBN none ' END
  || CASE doc_id % 3 WHEN 0 THEN ' arXiv: 2101.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') WHEN 1 THEN ' arxiv:math.GT/0309136 ' ELSE ' arXiv 21.1 ' END || CASE WHEN doc_id % 2 = 0 THEN ' PMID: ' || (1000000 + doc_id) ELSE ' PMID 12' END"""


def with_identifiers():
    d = F.col("doc_id")
    key = F.lpad((d % 100000).cast("string"), 5, "0")
    return F.concat(
        F.col("text"),
        F.when(d % 4 == 0, F.concat(F.lit(" see doi:10.1000/ab"), d, F.lit("). "))).when(d % 4 == 1, F.concat(F.lit(" https://doi.org/10.12345/x."), d, F.lit(", and ")))
        .when(d % 4 == 2, F.concat(F.lit(" DOI 10.5555/("), "source", F.lit(");"))).otherwise(" no 10.1/x "),
        F.when(d % 3 == 0, " ISBN-13: 978-3-16-148410-0 ").when(d % 3 == 1, " isbn 316148410X").otherwise(" ISBN none "),
        F.when(d % 3 == 0, F.concat(F.lit(" arXiv: 2101."), key)).when(d % 3 == 1, " arxiv:math.GT/0309136 ").otherwise(" arXiv 21.1 "),
        F.when(d % 2 == 0, F.concat(F.lit(" PMID: "), (d + 1000000).cast("string"))).otherwise(" PMID 12"),
    )


def _identifier(name: str, rule, pattern: str, fold: str = "{x}"):
    found = fold.format(x=f"regexp_extract(t, '{pattern}', 1)")

    @query(name, f"SELECT doc_id, nullif({found}, '') AS id FROM (SELECT doc_id, {_IDS_SQL} AS t FROM documents)")
    def one(spark, sf_dir):
        return docs(spark, sf_dir, "source", "text").select("doc_id", rule(with_identifiers()).alias("id"))


_identifier("f41_doi", T.doi, r"""(?i)(?:doi[:\s./]*|https?://doi\.org/)(10\.\d{{4,9}}/[^\s"''<>]+)""".replace("{{", "{").replace("}}", "}"), "rtrim({x}, '.,;)')")
_identifier("f42_isbn", T.isbn, r"(?i)ISBN(?:-1[03])?[:\s]*((?:97[89][- ]?)?(?:\d[- ]?){9}[\dX])", "regexp_replace({x}, '[^0-9X]', '', 'g')")
_identifier("f43_arxiv", T.arxiv, r"(?i)arXiv[:\s]+(\d{4}\.\d{4,5}|[a-z\-]+(?:\.[A-Z]{2})?/\d{7})")
_identifier("f44_pmid", T.pmid, r"(?i)PMID[:\s]+(\d{6,9})")


@query("f60_acronym_shape", r"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS w FROM documents)
SELECT w, length(w) BETWEEN 2 AND 10 AND length(regexp_replace(w, '[^\p{Lu}]', '', 'g')) >= 2
  AND 2 * length(regexp_replace(w, '[^\p{Lu}]', '', 'g')) >= length(regexp_replace(w, '[^\p{L}]', '', 'g')) AS ok FROM w WHERE w <> ''""")
def acronym_shape(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    return rows.select("w", T.acronym_shape(F.col("w")).alias("ok"))


@query("f70_content_hash", "SELECT doc_id, substr(sha256(regexp_replace(text, '(?m)^content_hash:.*$', '', 'g')), 1, 16) AS h FROM documents")
def content_hash(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "doc_id", F.substring(F.sha2(F.regexp_replace("text", r"(?m)^content_hash:.*$", ""), 256), 1, 16).alias("h")
    )


@query("s43_cache_key", "SELECT doc_id, substr(sha256('ns' || chr(0) || lang || chr(0) || source || chr(0) || text), 1, 16) AS k FROM documents")
def cache_key(spark, sf_dir):
    key = T.cache_key(F.lit("ns"), F.col("lang"), F.col("source"), F.col("text"))
    return docs(spark, sf_dir, "lang", "source", "text").select("doc_id", key.alias("k"))


@query("f19_file_stem", r"""WITH a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), ' ', '-'), '[<>:"/\\|?*\x00-\x1f]+', '-', 'g'), '-+', '-', 'g'), ' .-_') AS s FROM documents),
b AS (SELECT doc_id, trim((CASE WHEN s = '' THEN 'note' ELSE s END)[1:60], ' .-_') AS s FROM a)
SELECT doc_id, CASE WHEN s = '' THEN 'note' ELSE s END AS stem FROM b""")
def file_stem(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.file_stem(F.col("text")).alias("stem"))


@query("f102_excerpt", r"SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:150], ' ') AS excerpt FROM documents")
def excerpt(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.slice(T.words(F.col("text")), 1, 150), " ").alias("excerpt"))


@query("p3_text_quality", r"""SELECT doc_id, n, n // pages AS words_per_page, n = 0 AS is_empty, n // pages < 50 AS is_thin FROM (
  SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n, 1 + n_chars // 3000 AS pages FROM documents)""")
def text_quality(spark, sf_dir):
    rows = docs(spark, sf_dir, "text", "n_chars").select(
        "doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n"), F.expr("1 + n_chars div 3000").alias("pages")
    )
    wpp = F.expr("n div pages")
    return rows.select("doc_id", "n", wpp.alias("words_per_page"), (F.col("n") == 0).alias("is_empty"), (wpp < 50).alias("is_thin"))


@query("p13_future_self", r"""SELECT doc_id, regexp_matches(text, '(?i)\b(siehe|vgl\.?|in)\s+(Abschnitt|Kapitel|Section|Chapter|S\.?)\s*\d+') AS doc_ref,
  regexp_matches(text, '(?i)\b(recently|currently|nowadays|heutzutage|aktuell\w*|derzeit\w*)\b') AS deixis,
  regexp_matches(text, '(?m)^\s*(Dieser|Jener|Diese|Jene|Dieses|Jenes)\s+(Ansatz|Punkt|Aspekt|Begriff|Autor|Autorin|Modell|Theorie|Konzept)\b') AS dangling FROM documents""")
def future_self(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id",
        t.rlike(r"(?i)\b(siehe|vgl\.?|in)\s+(Abschnitt|Kapitel|Section|Chapter|S\.?)\s*\d+").alias("doc_ref"),
        t.rlike(r"(?i)\b(recently|currently|nowadays|heutzutage|aktuell\w*|derzeit\w*)\b").alias("deixis"),
        t.rlike(r"(?m)^\s*(Dieser|Jener|Diese|Jene|Dieses|Jenes)\s+(Ansatz|Punkt|Aspekt|Begriff|Autor|Autorin|Modell|Theorie|Konzept)\b").alias("dangling"),
    )


@query("p19_complete_body", r"SELECT doc_id, right(rtrim(text, E' \n'), 1) IN ('.', '!', '?', ')', '""', '”', ':') AS complete FROM documents".replace('""', '"'))
def complete_body(spark, sf_dir):
    last = F.right(F.rtrim("text", F.lit(" \n")), F.lit(1))
    return docs(spark, sf_dir).select("doc_id", last.isin(".", "!", "?", ")", '"', "”", ":").alias("complete"))


@query("p40_cross_language", "SELECT doc_id, regexp_matches(text, '[äöüßÄÖÜ]') AND NOT regexp_matches(text[1:500], '[äöüßÄÖÜ]') AS crosses FROM documents")
def cross_language(spark, sf_dir):
    mark = "[äöüßÄÖÜ]"
    return docs(spark, sf_dir).select("doc_id", (F.col("text").rlike(mark) & ~F.substring("text", 1, 500).rlike(mark)).alias("crosses"))


SIZE, OVERLAP = 100, 20


def chunk_spans(n: F.Column, size: int = SIZE, overlap: int = OVERLAP) -> F.Column:
    """Word spans [start, stop) of a text of n words; the last one reaches its end."""
    stride = max(1, size - overlap)
    count = F.when(n <= size, F.when(n > 0, 1).otherwise(0)).otherwise(1 + F.ceil((n - size) / stride))
    starts = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct((i * stride).alias("start"), F.least(i * stride + size, n).alias("stop")))


_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
_CHUNKS_SQL = f"""w AS (SELECT doc_id, {_WORDS} AS w FROM documents), n AS (SELECT doc_id, w, len(w) AS n FROM w),
spans AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n = 0 THEN 0 WHEN n <= {SIZE} THEN 1 ELSE 1 + CAST(ceil((n - {SIZE}) / {float(SIZE - OVERLAP)}) AS BIGINT) END)) AS i FROM n)"""


@query("w10_chunk_spans", f"WITH {_CHUNKS_SQL} SELECT doc_id, i, i * {SIZE - OVERLAP} AS start, least(i * {SIZE - OVERLAP} + {SIZE}, n) AS stop FROM spans")
def chunk_span_rows(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.size(T.words(F.col("text"))).alias("n"))
    out = rows.select("doc_id", F.posexplode(chunk_spans(F.col("n"))).alias("i", "s"))
    return out.select("doc_id", F.col("i").cast("long").alias("i"), F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"))


def sentence_ends(words: F.Column) -> F.Column:
    """Stops of the sentences in word positions; the rest of a text ends one too."""
    n = F.size(words)
    ends = F.filter(
        F.transform(words, lambda w, i: F.when(w.rlike("[.!?]$"), i + 1)), lambda e: e.isNotNull()
    )
    return F.when((n > 0) & (F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) < n), F.array_append(ends, n)).otherwise(ends)


@query("w11_sentence_spans", f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
e AS (SELECT doc_id, len(w) AS n, list_filter(list_transform(w, lambda x, i: CASE WHEN regexp_matches(x, '[.!?]$') THEN i END), lambda x: x IS NOT NULL) AS e FROM w)
SELECT doc_id, len(e) + (n > 0 AND coalesce(e[-1], 0) < n)::INT AS n_sentences, coalesce(e[1], n) AS first_stop FROM e""")
def sentence_spans(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n"), sentence_ends(F.col("w")).alias("e"))
    return rows.select("doc_id", F.size("e").cast("long").alias("n_sentences"), F.coalesce(F.get("e", F.lit(0)), F.col("n")).cast("long").alias("first_stop"))


@query("a42_straddle", f"""WITH {_CHUNKS_SQL},
e AS (SELECT doc_id, n, list_filter(list_transform(w, lambda x, i: CASE WHEN regexp_matches(x, '[.!?]$') OR i = n THEN i END), lambda x: x IS NOT NULL) AS e FROM n),
s AS (SELECT doc_id, unnest(e) AS stop, unnest(list_prepend(0, e[:-2])) AS start FROM e WHERE n > 0),
h AS (SELECT s.doc_id, s.start, s.stop, bool_or(s.start >= i * {SIZE - OVERLAP} AND s.stop <= least(i * {SIZE - OVERLAP} + {SIZE}, n)) AS held FROM s JOIN spans USING (doc_id) GROUP BY ALL)
SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (WHERE NOT held) AS n_straddling FROM h GROUP BY doc_id""")
def straddle(spark, sf_dir):
    """Sentences that no word chunk holds whole: arithmetic on the spans, no join.

    The last chunk that starts at or before the sentence reaches furthest, so it decides."""
    rows = docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n"), sentence_ends(F.col("w")).alias("e"))
    stride = SIZE - OVERLAP
    last = F.when(F.col("n") <= SIZE, 0).otherwise(F.ceil((F.col("n") - SIZE) / F.lit(stride)))
    spans = F.zip_with(F.concat(F.array(F.lit(0)), F.slice("e", 1, F.greatest(F.size("e") - 1, F.lit(0)))), F.col("e"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = F.filter(spans, lambda s: s["b"] > F.least(F.least(F.floor(s["a"] / F.lit(stride)), last) * stride + SIZE, F.col("n")))
    return rows.where("n > 0").select("doc_id", F.size("e").cast("long").alias("n_sentences"), F.size(out).cast("long").alias("n_straddling"))


@query("w5_word_split", f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id, i AS chunk, array_to_string(w[i * 300 + 1:(i + 1) * 300], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 299) // 300)) AS i FROM w)""")
def word_split(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr("(size(w) - 1) div 300").cast("int"))))
    return rows.select("doc_id", F.col("chunk").cast("long"), F.array_join(F.slice("w", F.col("chunk") * 300 + 1, F.lit(300)), " ").alias("text"))


@query("a21_recurring_lines", """WITH l AS (SELECT DISTINCT source, doc_id, trim(x, ' ') AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)),
p AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT source, line, count(*) AS pages FROM l JOIN p USING (source) WHERE line <> '' AND length(line) <= 80 GROUP BY source, line, n HAVING count(*) >= greatest(3, CAST(floor(0.2 * n) AS BIGINT))""")
def recurring_lines(spark, sf_dir):
    """Short lines on many pages of a source; lines are counted once a page in the row."""
    rows = docs(spark, sf_dir, "source", "text")
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (F.char_length(x) <= 80)))
    counted = rows.select("source", F.explode(lines).alias("line")).groupBy("source", "line").agg(F.count("*").alias("pages"))
    totals = rows.groupBy("source").agg(F.count("*").alias("n"))
    need = F.greatest(F.lit(3), F.floor(F.lit(0.2) * F.col("n")))
    return counted.where("pages >= 3").join(totals, "source").where(F.col("pages") >= need).select("source", "line", "pages")


_ANCHORED = "regexp_replace(text, '([.!?]) ', ' (S. ' || (doc_id % 90 + 1) || ')\\1 ')"


@query("a39_anchor_coverage", rf"""WITH t AS (SELECT doc_id, {_ANCHORED} AS t FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^(- |\* |#|> |\|)')) AS p FROM t),
s AS (SELECT doc_id, list_filter(flatten(list_transform(p, lambda x: string_split_regex(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda x: length(trim(x, ' ')) >= 40) AS s FROM p)
SELECT doc_id, CASE WHEN len(s) = 0 THEN 0.0 ELSE CAST(len(list_filter(s, lambda x: regexp_matches(x, '\(S\. \d+(-\d+)?\)'))) AS DOUBLE) / len(s) END AS coverage FROM s""")
def anchor_coverage(spark, sf_dir):
    """Share of prose sentences of 40 characters or more that carry a page anchor."""
    # The corpus has no anchors: the first sentence of each text is given one.
    mark = F.concat(F.lit(" (S. "), F.col("doc_id") % 90 + 1, F.lit(")"))
    at = F.regexp_instr("text", F.lit("[.!?] "))
    t = F.when(at > 0, F.concat(F.expr("substring(text, 1, regexp_instr(text, '[.!?] ') - 1)"), mark, F.expr("substring(text, regexp_instr(text, '[.!?] '))"))).otherwise(F.col("text"))
    prose = F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^(- |\* |#|> |\|)"))
    s = F.filter(F.flatten(F.transform(prose, lambda x: F.split(x, r"(?<=[.!?])\s+"))), lambda x: F.char_length(F.trim(x)) >= 40)
    rows = docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", s.alias("s"))
    hits = F.size(F.filter("s", lambda x: x.rlike(r"\(S\. \d+(-\d+)?\)")))
    return rows.select("doc_id", F.when(F.size("s") == 0, 0.0).otherwise(hits / F.size("s")).alias("coverage"))


@query("s7_marked_text", "SELECT source, doc_id, chr(10) || chr(10) || '[S. ' || doc_id || ']' || chr(10) || chr(10) || text AS marked FROM documents")
def marked_text(spark, sf_dir):
    """Every page of a source after its marker, in pieces with their order; no source is gathered."""
    marked = F.concat(F.lit("\n\n[S. "), F.col("doc_id"), F.lit("]\n\n"), F.col("text"))
    return docs(spark, sf_dir, "source", "text").select("source", "doc_id", marked.alias("marked"))


@query("w26_page_marker_asof", r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), m AS (SELECT doc_id, array_to_string(list_transform(p, lambda x, i: '[S. ' || (2 * i) || ']' || x), '') AS t, p FROM t),
q AS (SELECT doc_id, t, right(trim(x, ' '), 25) AS quote, 2 * i AS page FROM (SELECT doc_id, t, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM m) WHERE length(trim(x, ' ')) >= 25)
SELECT doc_id, quote, max(CAST(k AS INT)) AS page FROM (SELECT doc_id, quote, unnest(regexp_extract_all(t[1:strpos(t, quote) - 1], '\[S\. (\d+)\]', 1)) AS k FROM (SELECT DISTINCT doc_id, t, quote FROM q)) GROUP BY ALL""")
def page_marker_asof(spark, sf_dir):
    """The last marker before the first exact occurrence of a quote in a marked text."""
    pages = F.split("text", "\n")
    marked = F.array_join(F.transform(pages, lambda x, i: F.concat(F.lit("[S. "), (2 * (i + 1)).cast("string"), F.lit("]"), x)), "")
    quotes = F.filter(F.transform(pages, lambda x: F.trim(x)), lambda x: F.char_length(x) >= 25)
    rows = docs(spark, sf_dir).select("doc_id", marked.alias("t"), F.explode(F.array_distinct(F.transform(quotes, lambda x: F.right(x, F.lit(25))))).alias("quote"))
    return rows.select("doc_id", "quote", T.marker_before(F.col("t"), F.expr("instr(t, quote)")).alias("page"))
