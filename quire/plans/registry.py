"""All named queries of the engine, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import markdown, outline, postings, search
from quire.sources import csv_pages, html, sheets, text_pages

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: What the search queries ask; "ing" and "ion" are found inside many terms.
ASKED = "Erble thonan the inst ion"


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql.strip()
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- keywords and search


def document_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Each document is a flat section of the document that its source is."""
    docs = _table(spark, d, "documents")
    no = F.col("doc_id")
    return docs.select(F.col("source").alias("doc_id"), no.alias("node_seq"), F.concat(F.lit("sec_"), no).alias("node_id"), F.concat(F.lit("Doc "), no).alias("title"), no.alias("start_index"), no.alias("end_index"), "text")


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_TOKENS = r"""
nodes AS (SELECT source AS doc_id, doc_id AS node_seq, 'Doc ' || doc_id AS title, text FROM documents),
raw AS (
  SELECT doc_id, node_seq, title, unnest(l) AS t, unnest(range(len(l))) AS ix
  FROM (SELECT *, string_split_regex(regexp_replace(lower(concat_ws(' ', title, title, text)), '[^\w\s-]', ' ', 'g'), '\s+') AS l FROM nodes)
),
tok AS (SELECT doc_id, node_seq, title, ix, regexp_replace(t, '^-+|-+$', '', 'g') AS term FROM raw)"""
_TF = (
    "WITH "
    + _TOKENS
    + f""",
tf AS (
  SELECT doc_id, node_seq, term, count(*) AS tf, min(ix) AS first_pos FROM tok
  WHERE length(term) >= 3 AND term NOT IN ({_STOP}) AND NOT regexp_matches(term, '^[0-9]+$')
  GROUP BY ALL
)"""
)
_POSTINGS = (
    _TF
    + """,
ranked AS (
  SELECT *, max(tf) OVER (PARTITION BY node_seq) AS top, row_number() OVER (PARTITION BY node_seq ORDER BY tf DESC, first_pos) AS rank FROM tf
),
postings AS (SELECT doc_id, node_seq, term, tf, CAST(rank AS INT) AS rank, ln(1 + tf) / ln(1 + top) AS score FROM ranked WHERE rank <= 10)"""
)


@_query(f"WITH {_TOKENS} SELECT node_seq, count(*) AS n_tokens, count(DISTINCT term) AS n_distinct, max(length(term)) AS longest FROM tok WHERE term <> '' GROUP BY node_seq")
def kw_tokens(spark, d):
    body = X.tokens(postings.node_text(F.col("title"), F.lit(None), F.lit(None), F.col("text")))
    t = document_nodes(spark, d).select("node_seq", body.alias("t"))
    # Counted in each row: no shuffle.
    return t.where(F.size("t") > 0).select("node_seq", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_max(F.transform("t", F.length)).cast("long").alias("longest"))


@_query(_TF + " SELECT node_seq, term, tf FROM tf")
def kw_term_freq(spark, d):
    return postings.term_frequencies(document_nodes(spark, d)).select("node_seq", "term", "tf")


@_query(_POSTINGS + " SELECT node_seq, term, rank, round(score, 6) AS score FROM postings")
def kw_postings_topk(spark, d):
    return postings.build_keywords(document_nodes(spark, d)).select("node_seq", "term", "rank", F.round("score", 6).alias("score"))


@_query(_POSTINGS + " SELECT p.doc_id, p.total_terms, n.total_nodes, 'keyword' AS mode FROM (SELECT doc_id, count(DISTINCT term) AS total_terms FROM postings GROUP BY 1) p JOIN (SELECT doc_id, count(*) AS total_nodes FROM nodes GROUP BY 1) n USING (doc_id)")
def kw_index_stats(spark, d):
    nodes = document_nodes(spark, d)
    return postings.stats(nodes, postings.build_keywords(nodes)).drop("indexed_at")


def _found(query: str, keep: str = "TRUE", k: int | None = 10) -> str:
    words = [w for w in query.lower().split() if len(w) >= 2 and w not in X.STOPWORDS]
    asked = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    limit = f"WHERE rank <= {k}" if k else ""
    return (
        _POSTINGS
        + f""",
q(q_idx, q) AS (VALUES {asked}),
firsts AS (SELECT doc_id, node_seq, term, rank, row_number() OVER (PARTITION BY term ORDER BY doc_id, node_seq, rank) AS r FROM postings),
seqs AS (SELECT term, doc_id AS s1, node_seq AS s2, rank AS s3 FROM firsts WHERE r = 1),
hits AS (
  SELECT p.*, q.q_idx, q.q, p.term <> q.q AS late, CASE WHEN p.term = q.q THEN p.score ELSE p.score * 0.6 END AS hit,
    row_number() OVER (PARTITION BY node_seq ORDER BY q_idx, p.term <> q.q, CASE WHEN p.term <> q.q THEN s1 END, CASE WHEN p.term <> q.q THEN s2 END, CASE WHEN p.term <> q.q THEN s3 END) AS own,
    row_number() OVER (ORDER BY q_idx, p.term <> q.q, CASE WHEN p.term <> q.q THEN s1 END, CASE WHEN p.term <> q.q THEN s2 END, CASE WHEN p.term <> q.q THEN s3 END, -p.score, p.doc_id, p.node_seq) AS seq
  FROM postings p JOIN q ON contains(p.term, q.q) JOIN seqs USING (term)
  WHERE {keep}
),
best AS (SELECT *, row_number() OVER (PARTITION BY node_seq ORDER BY hit DESC, seq) AS b FROM hits),
merged AS (
  SELECT node_seq, round(sum(hit), 9) AS total, max(hit) AS score, min(seq) AS first_hit, max(CASE WHEN b = 1 THEN q END) AS matched_term
  FROM best GROUP BY node_seq
),
results AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY total DESC, first_hit) AS INT) AS rank FROM merged) {limit})"""
    )


_SHOW = " SELECT rank, node_seq, 'sec_' || node_seq AS node_id, matched_term, round(score, 6) AS score, round(total, 6) AS total_score FROM results"


def _search(spark, d, query: str, k: int = 10) -> DataFrame:
    asked = spark.createDataFrame([(0, query)], "query_id int, query string")
    return search.search(postings.build_keywords(document_nodes(spark, d)), asked, k)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("rank", "node_seq", "node_id", "matched_term", F.round("score", 6).alias("score"), F.round("total_score", 6).alias("total_score"))


@_query(_POSTINGS + " SELECT node_seq, term, round(score, 6) AS hit_score FROM postings WHERE term = 'erble'")
def search_exact(spark, d):
    terms = search.query_terms(spark.createDataFrame([(0, "erble")], "query_id int, query string"))
    found = search.hits(postings.build_keywords(document_nodes(spark, d)), terms)
    return found.where("exact").select("node_seq", "term", F.round("hit_score", 6).alias("hit_score"))


@_query(_found("ing", "p.term <> q.q") + " SELECT node_seq, term, round(hit, 6) AS hit_score FROM hits")
def search_partial(spark, d):
    terms = search.query_terms(spark.createDataFrame([(0, "ing")], "query_id int, query string"))
    found = search.hits(postings.build_keywords(document_nodes(spark, d)), terms)
    return found.where("not exact").select("node_seq", "term", F.round("hit_score", 6).alias("hit_score"))


@_query(_found(ASKED) + _SHOW)
def search_multi_term(spark, d):
    return _shown(_search(spark, d, ASKED))


@_query(_found(ASKED, k=20) + " SELECT rank, node_seq, CASE WHEN floor(total * 100 + 0.5) >= 80 THEN 'High' WHEN floor(total * 100 + 0.5) >= 50 THEN 'Medium' ELSE 'Low' END AS band FROM results")
def search_relevance_band(spark, d):
    return _search(spark, d, ASKED, 20).select("rank", "node_seq", X.band(F.col("total_score")).alias("band"))


@_query(
    _found(ASKED, k=5)
    + r""" SELECT string_agg('[Doc ' || node_seq || ' | pages ' || node_seq || '–' || node_seq || ' | score: ' || printf('%.2f', total) || ']' || chr(10) || substr(text, 1, 1200), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM results JOIN nodes USING (node_seq)"""
)
def chat_context(spark, d):
    pages = document_nodes(spark, d).select("doc_id", F.col("node_seq").alias("page_no"), "text")
    return search.context(_search(spark, d, ASKED, 5), pages).select("context")


@_query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 10")
def chat_history_last10(spark, d):
    return search.last_messages(_table(spark, d, "conversations")).drop("back")


@_query(
    r"""WITH t AS (SELECT doc_id, [lower(source), 'lang ' || lang, 'n' || doc_id % 5] AS ts FROM documents)
SELECT doc_id AS node_seq, term, CAST(ix + 1 AS INT) AS rank, round(1 - ix / 3, 6) AS score FROM (SELECT doc_id, unnest(ts) AS term, unnest(range(3)) AS ix FROM t)"""
)
def llm_terms_rank_score(spark, d):
    docs = _table(spark, d, "documents").withColumn("reply", F.concat(F.lit('Terms: ["'), F.upper("source"), F.lit('", " Lang '), "lang", F.lit(' ", "x", "n'), F.col("doc_id") % 5, F.lit('"] done')))
    nodes = document_nodes(spark, d).join(docs.select(F.col("doc_id").alias("node_seq"), postings.llm_terms(F.col("reply")).alias("terms")), "node_seq")
    return postings.build_from_terms(nodes).select("node_seq", "term", "rank", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- text helpers


@_query("SELECT doc_id, CAST(ceil(length(text) / 4) AS INT) AS token_count FROM documents")
def token_count(spark, d):
    return _table(spark, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("token_count"))


@_query(r"SELECT doc_id, regexp_replace(regexp_replace(s, '\.{5,}', ': ', 'g'), '(?:\. ){5,}\.?', ': ', 'g') AS line FROM (SELECT doc_id, text || repeat('.', CAST(doc_id % 9 AS INT)) || ' 12 ' || repeat('. ', CAST(doc_id % 8 AS INT)) || '7' AS s FROM documents)")
def dot_leader_normalise(spark, d):
    """Whole texts, with dot leaders added to them."""
    line = F.concat("text", F.expr("repeat('.', cast(doc_id % 9 as int))"), F.lit(" 12 "), F.expr("repeat('. ', cast(doc_id % 8 as int))"), F.lit("7"))
    return _table(spark, d, "documents").select("doc_id", X.without_leaders(line).alias("line"))


@_query(
    r"""SELECT doc_id, TRY_CAST(nullif(regexp_extract(s, 'physical_index_(\d+)', 1), '') AS INT) AS physical_index, TRY_CAST(nullif(regexp_extract(p, '^\s*([+-]?\d+)', 1), '') AS INT) AS page
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE '<physical_index_' || doc_id || '>' END AS s, CASE doc_id % 4 WHEN 0 THEN ' ' || doc_id || ' ff' WHEN 1 THEN '-' || doc_id WHEN 2 THEN 'p. ' || doc_id ELSE doc_id || '.5' END AS p FROM documents)"""
)
def physical_index_parse(spark, d):
    s = F.expr("CASE WHEN doc_id % 3 = 0 THEN source ELSE '<physical_index_' || doc_id || '>' END")
    p = F.expr("CASE doc_id % 4 WHEN 0 THEN ' ' || doc_id || ' ff' WHEN 1 THEN '-' || doc_id WHEN 2 THEN 'p. ' || doc_id ELSE doc_id || '.5' END")
    return _table(spark, d, "documents").select("doc_id", X.physical_index(s).alias("physical_index"), X.page_number(p).alias("page"))


_NAMES = "'file' || doc_id || CASE doc_id % 11 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.x.csv' WHEN 3 THEN '.xls' WHEN 4 THEN '.ods' WHEN 5 THEN '.Markdown' WHEN 6 THEN '.md' WHEN 7 THEN '.htm' WHEN 8 THEN '.txt' WHEN 9 THEN '.zip' ELSE '' END"
_CASE = "CASE WHEN e IN ('pdf', 'docx', 'csv', 'xlsx', 'md') THEN e WHEN e IN ('xls', 'ods') THEN 'xlsx' WHEN e = 'markdown' THEN 'md'"


@_query(f"SELECT doc_id, {_CASE} END AS kind, {_CASE} WHEN e IN ('html', 'htm') THEN 'html' WHEN e = 'txt' THEN 'txt' END AS web_kind FROM (SELECT doc_id, lower(list_extract(string_split({_NAMES}, '.'), -1)) AS e FROM documents)")
def file_type_dispatch(spark, d):
    name = F.expr(_NAMES)
    return _table(spark, d, "documents").select("doc_id", X.file_type(name).alias("kind"), X.file_type(name, web=True).alias("web_kind"))


@_query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE '{"a":' || doc_id || ',"b":null,"c":[1,2]}' END AS json FROM documents"""
)
def json_repair(spark, d):
    reply = F.expr(
        r"""CASE doc_id % 4 WHEN 0 THEN 'Sure: ```json\n{"a":' || doc_id || ',"b":None,"c":[1,2]}\n``` bye' WHEN 1 THEN '{"a":' || doc_id || ', "b":null,"c":[1,2,],}' WHEN 2 THEN '```json {"a":' || doc_id || ',\n"b":None,\n"c":[1,2]}' ELSE 'no json {' END"""
    )
    fixed = X.repaired_json(reply)
    return _table(spark, d, "documents").select("doc_id", F.to_json(F.try_parse_json(fixed)).alias("json"))


# ---------------------------------------------------------------- CSV, sheets, pages of text


@_query(
    """WITH f AS (SELECT o_orderkey AS doc_id, list_extract([',', ';', chr(9), '|'], CAST(o_orderkey % 4 + 1 AS INT)) AS s, o_orderstatus, o_orderpriority FROM orders)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ',' ELSE s END AS delimiter FROM f"""
)
def csv_sniff(spark, d):
    sign = F.expr("element_at(array(',', ';', '\\t', '|'), cast(o_orderkey % 4 + 1 as int))")
    line = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).otherwise(F.concat_ws(" ", F.concat("o_orderkey", sign, "o_orderstatus"), F.concat(sign, "o_orderpriority")))
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), csv_pages.sniff(F.concat(line, F.lit("\na,b,c,d;e;f;g;h|||"))).alias("delimiter"))


def _customer_rows(spark, d) -> DataFrame:
    """A table file for each nation: a header, then its customers in order."""
    from pyspark.sql import Window

    c = _table(spark, d, "customer")
    no = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    body = c.select(F.col("c_nationkey").alias("doc_id"), no.cast("long").alias("row_no"), F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("fields"))
    head = c.select(F.col("c_nationkey").alias("doc_id")).distinct().select("doc_id", F.lit(0).cast("long").alias("row_no"), F.array(F.lit("id"), F.lit("name"), F.lit("segment")).alias("fields"))
    return head.unionByName(body)


_ROWS = "rows AS (SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row_no, CAST(c_custkey AS VARCHAR) AS a, c_name AS b, c_mktsegment AS c FROM customer)"


@_query(
    f"""WITH {_ROWS},
p AS (SELECT doc_id, CAST((row_no - 1) // 10 + 1 AS INT) AS page_no, count(*) AS n, string_agg(a || ' | ' || b || ' | ' || c, chr(10) ORDER BY row_no) AS body FROM rows GROUP BY 1, 2),
t AS (SELECT *, max(page_no) OVER (PARTITION BY doc_id) AS n_pages FROM p),
x AS (SELECT doc_id, page_no, printf('[CSV Data — Rows %d–%d of total, Page %d/%d]', (page_no - 1) * n + 1, (page_no - 1) * n + n, page_no, n_pages) || chr(10) || chr(10) || 'id | name | segment' || chr(10) || '----|------|--------' || chr(10) || body AS text FROM t)
SELECT doc_id, page_no, text, CAST(ceil(length(text) / 4) AS INT) AS token_count FROM x"""
)
def csv_page_text(spark, d):
    return csv_pages.pages(_customer_rows(spark, d), 10)


@_query(
    f"""WITH {_ROWS},
p AS (SELECT doc_id, CAST((row_no - 1) // 20 + 1 AS INT) AS part_no, row_no, a, b, c FROM rows),
w AS (SELECT doc_id, part_no, CAST(least(40, greatest(2, max(length(a)))) AS INT) AS wa, CAST(least(40, greatest(4, max(length(b)))) AS INT) AS wb, CAST(least(40, greatest(7, max(length(c)))) AS INT) AS wc, max(max(part_no)) OVER (PARTITION BY doc_id) AS n_parts FROM p GROUP BY 1, 2),
x AS (SELECT p.doc_id, p.part_no, '=== Sheet: S (Part ' || p.part_no || '/' || any_value(n_parts) || ') ===' || chr(10) || chr(10) || any_value(rpad('id', wa, ' ') || ' | ' || rpad('name', wb, ' ') || ' | ' || rpad('segment', wc, ' ')) || chr(10) || any_value(repeat('-', wa) || '-|-' || repeat('-', wb) || '-|-' || repeat('-', wc)) || chr(10) || string_agg(rpad(a, wa, ' ') || ' | ' || rpad(b, wb, ' ') || ' | ' || rpad(c, wc, ' '), chr(10) ORDER BY row_no) AS text FROM p JOIN w USING (doc_id, part_no) GROUP BY 1, 2)
SELECT doc_id, part_no, text, CAST(ceil(length(text) / 4) AS INT) AS token_count FROM x"""
)
def sheet_page_text(spark, d):
    rows = _customer_rows(spark, d).select("doc_id", F.lit(0).alias("sheet_no"), F.lit("S").alias("sheet"), "row_no", F.col("fields").alias("cells"))
    return sheets.pages(rows, 20).drop("sheet_no")


@_query(
    r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\n+'), lambda p: trim(p) <> '') AS ps FROM documents),
f AS (
  SELECT doc_id, 1 AS i, 1 AS page, CAST(ceil(length(ps[1]) / 4) AS BIGINT) AS n, ps FROM d WHERE len(ps) > 0
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN n + ceil(length(ps[i + 1]) / 4) > 600 THEN page + 1 ELSE page END, CAST(CASE WHEN n + ceil(length(ps[i + 1]) / 4) > 600 THEN 0 ELSE n END + ceil(length(ps[i + 1]) / 4) AS BIGINT), ps FROM f WHERE i < len(ps)
),
g AS (SELECT doc_id, page AS page_no, string_agg(ps[i], chr(10) || chr(10) ORDER BY i) AS text FROM f GROUP BY 1, 2)
SELECT doc_id, page_no, text, CAST(ceil(length(text) / 4) AS INT) AS token_count FROM g"""
)
def text_chunks(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return text_pages.chunk(docs)


@_query("SELECT doc_id, CAST(0 AS INT) AS node_seq, 'sec_1' AS node_id, 'Section 1' AS title, 1 AS start_index, 1 AS end_index, length(text) AS n_chars FROM documents")
def flat_nodes(spark, d):
    pages = _table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_no"), "text")
    return text_pages.flat_nodes(pages).withColumn("n_chars", F.length("text").cast("long")).drop("text")


# ---------------------------------------------------------------- HTML

_STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<br\s*/?>', chr(10), 'gi'), '</p>', chr(10), 'gi'), '</li>', chr(10), 'gi'), '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12) || chr(160))"""


@_query(f"SELECT page_id, {_STRIP.format('html')} AS text FROM pages")
def html_strip(spark, d):
    return _table(spark, d, "pages").select("page_id", html.strip_tags(F.col("html")).alias("text"))


@_query(
    r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<h1[^>]*>.*?</h1>|<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>|<h4[^>]*>.*?</h4>|<h5[^>]*>.*?</h5>|<h6[^>]*>.*?</h6>')) AS n_headings
FROM pages WHERE regexp_matches(html, '(?is)<h1[^>]*>.*?</h1>|<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>|<h4[^>]*>.*?</h4>|<h5[^>]*>.*?</h5>|<h6[^>]*>.*?</h6>')"""
)
def html_section_counts(spark, d):
    pages = _table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html")
    lead = pages.select("doc_id", (html.strip_tags(F.regexp_extract("html", r"(?is)^(.*?)<h[1-6]", 1)) != "").cast("long").alias("lead"))
    n = html.sections(pages).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.join(lead, "doc_id").select(F.col("doc_id").alias("page_id"), (F.col("n") - F.col("lead")).alias("n_headings"))


@_query()
def html_sections(spark, d):
    return html.section_pages(_table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html"))


@_query()
def html_markdown(spark, d):
    return _table(spark, d, "pages").select("page_id", html.to_markdown("html").alias("markdown"))


# ---------------------------------------------------------------- Markdown


def markdown_docs(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown text for each conversation: a heading for each turn, levels by turn, fences around some texts."""
    c = _table(spark, d, "conversations")
    part = F.concat(
        F.expr("repeat('#', cast(1 + (turn * 7 + conv_id) % 4 as int))"), F.lit(" "), "role", F.lit(" "), "turn", F.lit("\n"),
        F.when(F.col("turn") % 3 == 1, F.concat(F.lit("```\n# no heading\n"), "text", F.lit("\n```"))).otherwise(F.concat("text", F.lit("\n  # indented\n####### seven"))),
    )
    packed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("ps"))
    return packed.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("before\n"), F.array_join(F.transform("ps", lambda x: x.p), "\n")).alias("content"))


_MD = r"""
docs AS (
  SELECT conv_id AS doc_id, 'before' || chr(10) || string_agg(repeat('#', CAST(1 + (turn * 7 + conv_id) % 4 AS INT)) || ' ' || role || ' ' || turn || chr(10) ||
    CASE WHEN turn % 3 = 1 THEN '```' || chr(10) || '# no heading' || chr(10) || text || chr(10) || '```' ELSE text || chr(10) || '  # indented' || chr(10) || '####### seven' END, chr(10) ORDER BY turn) AS content
  FROM conversations GROUP BY 1
),
ls AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) + 1 AS line_no FROM (SELECT doc_id, string_split(content, chr(10)) AS l FROM docs)),
fenced AS (SELECT *, trim(line) AS bare, sum(CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM ls),
marked AS (SELECT *, NOT starts_with(bare, '```') AND fences % 2 = 0 AND regexp_matches(bare, '^#{1,6}\s+.+$') AS heading FROM fenced),
numbered AS (SELECT *, sum(CASE WHEN heading AND line LIKE '#%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS seq FROM marked),
sections AS (
  SELECT doc_id, CAST(seq AS INT) AS node_seq, CAST(min(line_no) AS INT) AS line_no, CAST(min(CASE WHEN heading AND line LIKE '#%' THEN length(regexp_extract(line, '^(#{1,6})', 1)) END) AS INT) AS level,
    min(CASE WHEN heading AND line LIKE '#%' THEN trim(regexp_extract(bare, '^#{1,6}\s+(.+)$', 1)) END) AS title, trim(string_agg(line, chr(10) ORDER BY line_no), ' ' || chr(10)) AS text
  FROM numbered WHERE seq >= 0 GROUP BY 1, 2
),
tree AS (
  SELECT s.*, (SELECT max(p.node_seq) FROM sections p WHERE p.doc_id = s.doc_id AND p.node_seq < s.node_seq AND p.level < s.level) AS parent_seq,
    CAST(coalesce((SELECT min(p.node_seq) FROM sections p WHERE p.doc_id = s.doc_id AND p.node_seq > s.node_seq AND p.level <= s.level), (SELECT count(*) FROM sections p WHERE p.doc_id = s.doc_id)) AS INT) AS subtree_end
  FROM sections s
),
totals AS (SELECT t.doc_id, t.node_seq, CAST(ceil((sum(length(c.text)) + count(*) - 1) / 4) AS INT) AS subtree_tokens FROM tree t JOIN sections c ON c.doc_id = t.doc_id AND c.node_seq >= t.node_seq AND c.node_seq < t.subtree_end GROUP BY 1, 2)"""


@_query(f"WITH {_MD} SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(CASE WHEN line LIKE '#%' THEN length(regexp_extract(line, '^(#{{1,6}})', 1)) END AS INT) AS level, trim(regexp_extract(bare, '^#{{1,6}}\\s+(.+)$', 1)) AS title FROM marked WHERE heading")
def md_headings(spark, d):
    return markdown.headings(markdown_docs(spark, d))


@_query(f"WITH {_MD} SELECT doc_id, node_seq, line_no, level, title, text FROM sections")
def md_sections(spark, d):
    return markdown.sections(markdown_docs(spark, d))


def _tree(spark, d) -> DataFrame:
    return markdown.with_tree(markdown.sections(markdown_docs(spark, d)))


@_query(f"WITH {_MD} SELECT doc_id, node_seq, level, parent_seq, subtree_end FROM tree")
def md_tree_parent(spark, d):
    return _tree(spark, d).select("doc_id", "node_seq", "level", "parent_seq", "subtree_end")


@_query(f"WITH {_MD} SELECT doc_id, node_seq, subtree_tokens FROM totals")
def md_subtree_tokens(spark, d):
    return markdown.with_subtree_tokens(_tree(spark, d)).select("doc_id", "node_seq", "subtree_tokens")


@_query(
    f"""WITH {_MD},
x AS (SELECT tree.*, subtree_tokens, subtree_tokens < 150 AS small FROM tree JOIN totals USING (doc_id, node_seq)),
y AS (SELECT *, EXISTS (SELECT 1 FROM x a WHERE a.doc_id = x.doc_id AND a.small AND a.node_seq < x.node_seq AND a.subtree_end > x.node_seq) AS gone FROM x)
SELECT doc_id, node_seq, level, title, CASE WHEN small THEN (SELECT string_agg(c.text, chr(10) || chr(10) ORDER BY c.node_seq) FROM sections c WHERE c.doc_id = y.doc_id AND c.node_seq >= y.node_seq AND c.node_seq < y.subtree_end) ELSE text END AS text FROM y WHERE NOT gone"""
)
def md_thinned(spark, d):
    return markdown.thin(_tree(spark, d), 150).select("doc_id", "node_seq", "level", "title", "text")


@_query(f"WITH {_MD} SELECT doc_id, node_seq, CASE WHEN length(CAST(node_seq AS VARCHAR)) >= 4 THEN CAST(node_seq AS VARCHAR) ELSE lpad(CAST(node_seq AS VARCHAR), 4, '0') END AS node_id FROM sections")
def node_ids_preorder(spark, d):
    return markdown.with_ids(markdown.sections(markdown_docs(spark, d))).select("doc_id", "node_seq", "node_id")


@_query(f"WITH {_MD} SELECT doc_id, node_seq, title FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.doc_id = t.doc_id AND c.parent_seq = t.node_seq)")
def leaf_nodes(spark, d):
    return _tree(spark, d).where("is_leaf").select("doc_id", "node_seq", "title")


@_query(
    f"""WITH RECURSIVE {_MD},
p AS (SELECT doc_id, node_seq, [node_seq] AS path, parent_seq AS up FROM tree UNION ALL SELECT p.doc_id, p.node_seq, list_prepend(t.node_seq, p.path), t.parent_seq FROM p JOIN tree t ON t.doc_id = p.doc_id AND t.node_seq = p.up)
SELECT doc_id, node_seq, CAST(len(path) AS INT) AS depth, array_to_string(path, '.') AS path FROM p WHERE up IS NULL"""
)
def md_paths(spark, d):
    return markdown.with_paths(_tree(spark, d)).select("doc_id", "node_seq", "depth", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


@_query(
    f"""WITH {_MD}
SELECT doc_id, node_seq, CASE WHEN leaf THEN s END AS summary, CASE WHEN NOT leaf THEN s END AS prefix_summary
FROM (SELECT doc_id, node_seq, subtree_end = node_seq + 1 AS leaf, CASE WHEN ceil(length(text) / 4) < 60 THEN text ELSE 'About ' || title END AS s FROM tree)"""
)
def md_summaries(spark, d):
    out = markdown.summary_columns(_tree(spark, d), F.concat(F.lit("About "), "title"), 60)
    return out.select("doc_id", "node_seq", "summary", "prefix_summary")


# ---------------------------------------------------------------- tables of contents and page ranges


def toc_items(spark: SparkSession, d: str) -> DataFrame:
    """An outline of ten items for every ten documents, with gaps, repeats and pages beyond the end."""
    return _table(spark, d, "documents").selectExpr(*_ITEM_COLUMNS)


_ITEM_COLUMNS = [
    "doc_id DIV 10 AS doc_id",
    "cast(doc_id % 10 as int) AS list_index",
    "CASE WHEN doc_id % 10 IN (0, 4, 7) THEN cast(doc_id % 10 as string) WHEN doc_id % 10 < 4 THEN '0.' || doc_id % 10 WHEN doc_id % 10 = 6 THEN '4.5.1' WHEN doc_id % 10 = 5 THEN '4.5' ELSE '7.' || doc_id % 10 END AS structure",
    "'T' || doc_id % 7 AS title",
    "cast(CASE WHEN doc_id % 13 = 3 THEN NULL ELSE 1 + doc_id % 10 END as int) AS page",
    "cast(CASE WHEN doc_id % 5 = 3 THEN NULL WHEN doc_id % 17 = 6 THEN 30 ELSE 2 + doc_id % 10 - doc_id % 2 END as int) AS physical_index",
    "CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END AS appear_start",
]


def toc_pages_table(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").selectExpr("doc_id DIV 10 AS doc_id", "cast(doc_id % 10 + 1 as int) AS page_no", "text")
    return docs.withColumn("token_count", X.token_count(F.col("text")))


def _page_counts(spark, d) -> DataFrame:
    return toc_pages_table(spark, d).groupBy("doc_id").agg(F.max("page_no").alias("n_pages"))


_ITEMS = (
    "items AS (SELECT "
    + ", ".join(_ITEM_COLUMNS).replace("doc_id DIV 10", "doc_id // 10").replace("as string", "as varchar")
    + " FROM documents), pgs AS (SELECT doc_id // 10 AS doc_id, CAST(doc_id % 10 + 1 AS INT) AS page_no, text, CAST(ceil(length(text) / 4) AS INT) AS token_count FROM documents), cnt AS (SELECT doc_id, max(page_no) AS n_pages FROM pgs GROUP BY 1)"
)
_PAIRS = _ITEMS + ", pairs AS (SELECT a.doc_id, a.list_index, a.title, a.page, b.physical_index FROM items a JOIN items b USING (doc_id, title) WHERE b.physical_index >= 2)"
_VOTE = _PAIRS + ", votes AS (SELECT doc_id, physical_index - page AS diff, count(*) AS n, min(list_index) AS f FROM pairs WHERE physical_index - page IS NOT NULL GROUP BY 1, 2), offs AS (SELECT doc_id, diff AS \"offset\" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, diff < 0, CASE WHEN diff >= 0 THEN diff ELSE f END) AS r FROM votes) WHERE r = 1)"
_CUT = ", cut AS (SELECT items.* EXCLUDE (physical_index), CASE WHEN physical_index <= n_pages THEN physical_index END AS physical_index, n_pages FROM items JOIN cnt USING (doc_id))"
_RANGES = _ITEMS + _CUT + ", ok AS (SELECT * FROM cut WHERE physical_index IS NOT NULL), rng AS (SELECT doc_id, list_index, structure, title, physical_index AS start_index, CASE WHEN lead(1) OVER w IS NULL THEN n_pages WHEN coalesce(lead(appear_start) OVER w = 'yes', FALSE) THEN lead(physical_index) OVER w - 1 ELSE lead(physical_index) OVER w END AS end_index FROM ok WINDOW w AS (PARTITION BY doc_id ORDER BY list_index))"


def _pairs(spark, d) -> DataFrame:
    items = toc_items(spark, d)
    return outline.located_pairs(items, items, 2)


@_query(f"WITH {_PAIRS} SELECT * FROM pairs")
def toc_title_join(spark, d):
    return _pairs(spark, d)


@_query(f"WITH {_VOTE} SELECT * FROM offs")
def toc_offset_vote(spark, d):
    return outline.page_offset(_pairs(spark, d))


@_query(f"WITH {_VOTE} SELECT doc_id, list_index, CASE WHEN page IS NOT NULL THEN page + \"offset\" ELSE physical_index END AS physical_index FROM items LEFT JOIN offs USING (doc_id)")
def toc_apply_offset(spark, d):
    return outline.apply_offset(toc_items(spark, d), outline.page_offset(_pairs(spark, d))).select("doc_id", "list_index", "physical_index")


def _cut(spark, d) -> DataFrame:
    return outline.drop_beyond(toc_items(spark, d), _page_counts(spark, d))


@_query(f"WITH {_ITEMS}{_CUT} SELECT doc_id, list_index, physical_index FROM cut")
def toc_truncate(spark, d):
    return _cut(spark, d).select("doc_id", "list_index", "physical_index")


@_query(
    f"""WITH {_ITEMS}{_CUT}
SELECT doc_id, list_index, coalesce(last_value(physical_index IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY list_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_index,
  coalesce(first_value(physical_index IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY list_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n_pages) AS next_index FROM cut"""
)
def toc_neighbour_bounds(spark, d):
    return outline.neighbour_bounds(_cut(spark, d), _page_counts(spark, d)).select("doc_id", "list_index", "prev_index", "next_index")


def _ranged(spark, d) -> DataFrame:
    return outline.ranges(_cut(spark, d).where("physical_index is not null"), _page_counts(spark, d))


@_query(f"WITH {_RANGES} SELECT doc_id, list_index, start_index, end_index FROM rng")
def toc_ranges(spark, d):
    return _ranged(spark, d).select("doc_id", "list_index", "start_index", "end_index")


@_query(
    f"""WITH RECURSIVE {_RANGES},
par AS (SELECT c.doc_id, c.list_index, (SELECT max(p.list_index) FROM rng p WHERE p.doc_id = c.doc_id AND p.list_index < c.list_index AND contains(c.structure, '.') AND p.structure = regexp_replace(c.structure, '\\.[^.]*$', '')) AS up FROM rng c),
path AS (SELECT doc_id, list_index, up, [list_index] AS path FROM par UNION ALL SELECT x.doc_id, x.list_index, par.up, list_prepend(par.list_index, x.path) FROM path x JOIN par ON par.doc_id = x.doc_id AND par.list_index = x.up)
SELECT doc_id, list_index, array_to_string(path, '.') AS path, lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS VARCHAR), 4, '0') AS node_id FROM path WHERE up IS NULL"""
)
def toc_tree_paths(spark, d):
    out = outline.with_paths(outline.with_parents(_ranged(spark, d)))
    return out.select("doc_id", "list_index", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "node_id")


@_query(f"WITH {_RANGES} SELECT r.doc_id, r.list_index, coalesce(string_agg(p.text, '' ORDER BY p.page_no), '') AS text FROM rng r LEFT JOIN pgs p ON p.doc_id = r.doc_id AND p.page_no BETWEEN r.start_index AND r.end_index GROUP BY 1, 2")
def node_page_text(spark, d):
    return outline.range_text(_ranged(spark, d), toc_pages_table(spark, d))


@_query(
    f"""WITH {_RANGES} SELECT r.doc_id, r.list_index, coalesce(string_agg('<physical_index_' || p.page_no || '>' || chr(10) || p.text || chr(10) || '<physical_index_' || p.page_no || '>' || chr(10) || chr(10), '' ORDER BY p.page_no), '') AS text FROM rng r LEFT JOIN pgs p ON p.doc_id = r.doc_id AND p.page_no BETWEEN r.start_index AND r.end_index GROUP BY 1, 2"""
)
def node_page_text_tagged(spark, d):
    return outline.range_text(_ranged(spark, d), toc_pages_table(spark, d), tagged=True)


_SUMS = _RANGES + ", sums AS (SELECT r.doc_id, r.list_index, r.start_index, r.end_index, CAST(coalesce(sum(p.token_count), 0) AS BIGINT) AS tokens FROM rng r LEFT JOIN pgs p ON p.doc_id = r.doc_id AND p.page_no BETWEEN r.start_index AND r.end_index GROUP BY 1, 2, 3, 4)"


@_query(f"WITH {_SUMS} SELECT doc_id, list_index, tokens FROM sums")
def node_token_sum(spark, d):
    return outline.range_tokens(_ranged(spark, d), toc_pages_table(spark, d)).select("doc_id", "list_index", "tokens")


@_query(f"WITH {_SUMS} SELECT doc_id, list_index, tokens FROM sums WHERE end_index - start_index > 1 AND tokens >= 800")
def large_nodes(spark, d):
    return outline.large(_ranged(spark, d), toc_pages_table(spark, d), 1, 800).select("doc_id", "list_index", "tokens")


@_query(f"WITH {_ITEMS} SELECT doc_id, list_index, structure, title, physical_index FROM items UNION ALL SELECT doc_id, -1, '0', 'Preface', 1 FROM items WHERE list_index = 0 AND physical_index > 1")
def preface_insert(spark, d):
    return outline.with_preface(toc_items(spark, d)).select("doc_id", "list_index", "structure", "title", "physical_index")


@_query(
    f"""WITH RECURSIVE {_ITEMS},
tot AS (SELECT doc_id, sum(token_count) AS total, ceil((sum(token_count) / ceil(sum(token_count) / 1500) + 1500) / 2) AS av, list(token_count ORDER BY page_no) AS ts, list(page_no ORDER BY page_no) AS ns FROM pgs GROUP BY 1),
f AS (
  SELECT doc_id, 1 AS i, [CAST(i AS INT) FOR i IN []] AS cur, CAST(0 AS BIGINT) AS n, CAST(NULL AS INT[]) AS emitted, ts, ns, av FROM tot WHERE total > 1500
  UNION ALL
  SELECT doc_id, i + 1,
    CASE WHEN n + ts[i] > av THEN CASE WHEN i > 1 THEN [ns[i - 1], ns[i]] ELSE [ns[i]] END ELSE list_append(cur, ns[i]) END,
    CAST(CASE WHEN n + ts[i] > av THEN CASE WHEN i > 1 THEN ts[i - 1] ELSE 0 END + ts[i] ELSE n + ts[i] END AS BIGINT),
    CASE WHEN n + ts[i] > av THEN cur END, ts, ns, av
  FROM f WHERE i <= len(ts)
),
g AS (
  SELECT doc_id, i, emitted AS ps FROM f WHERE emitted IS NOT NULL
  UNION ALL SELECT doc_id, 1000000, cur FROM f WHERE i = len(ts) + 1 AND len(cur) > 0
  UNION ALL SELECT doc_id, 0, ns FROM tot WHERE total <= 1500
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS group_no, array_to_string(ps, ',') AS page_nos FROM g"""
)
def page_groups_overlap(spark, d):
    out = outline.page_groups(toc_pages_table(spark, d), 1500)
    return out.select("doc_id", "group_no", F.array_join(F.col("page_nos").cast("array<string>"), ",").alias("page_nos"))


@_query("SELECT doc_id // 10 AS doc_id, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS accuracy FROM labels GROUP BY 1")
def verification_accuracy(spark, d):
    checks = _table(spark, d, "labels").selectExpr("doc_id DIV 10 AS doc_id", "CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS answer")
    return outline.accuracy(checks)


@_query(f"WITH {_ITEMS} SELECT doc_id, max_by(physical_index, list_index) AS last_page FROM items WHERE physical_index IS NOT NULL GROUP BY 1")
def toc_last_page(spark, d):
    return outline.last_page(toc_items(spark, d))


@_query(
    f"""WITH {_ITEMS}, flags AS (SELECT doc_id, page_no, CASE WHEN token_count % 3 > 0 THEN 'yes' ELSE 'no' END AS answer FROM pgs),
st AS (SELECT doc_id, min(page_no) AS f FROM flags WHERE answer = 'yes' AND page_no <= 4 GROUP BY 1)
SELECT doc_id, page_no FROM flags JOIN st USING (doc_id) WHERE page_no >= f AND NOT EXISTS (SELECT 1 FROM flags x WHERE x.doc_id = flags.doc_id AND x.answer = 'no' AND x.page_no BETWEEN f AND flags.page_no)"""
)
def toc_page_run(spark, d):
    flags = toc_pages_table(spark, d).withColumn("answer", F.when(F.col("token_count") % 3 > 0, "yes").otherwise("no"))
    return outline.toc_pages(flags, 4)


_WRONG = "(doc_id * 3 + list_index) % 4 = 1"


@_query(
    f"""WITH {_ITEMS}{_CUT}, m AS (SELECT *, CASE WHEN NOT ({_WRONG}) THEN physical_index END AS sure FROM cut), b AS (
SELECT doc_id, list_index, {_WRONG} AS wrong, coalesce(last_value(sure IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY list_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_index,
  coalesce(first_value(sure IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY list_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n_pages) AS next_index FROM m)
SELECT doc_id, list_index, prev_index, next_index FROM b WHERE wrong"""
)
def toc_correct_bounds(spark, d):
    """Where a wrong item can be: between the nearest items that are right."""
    x = outline.neighbour_bounds(_cut(spark, d), _page_counts(spark, d), usable=~F.expr(_WRONG))
    return x.where(_WRONG).select("doc_id", "list_index", "prev_index", "next_index")


@_query(f"WITH {_ITEMS} SELECT doc_id, list_index, CASE WHEN {_WRONG} THEN list_index + 1 ELSE physical_index END AS physical_index FROM items")
def toc_put_back(spark, d):
    items = toc_items(spark, d)
    fixes = items.where(_WRONG).select("doc_id", "list_index", (F.col("list_index") + 1).alias("physical_index"))
    return outline.put_back(items, fixes).select("doc_id", "list_index", "physical_index")


@_query(f"WITH {_MD} SELECT doc_id, count(*) AS n_nodes, count(*) FILTER (WHERE parent_seq IS NULL) AS n_roots FROM tree GROUP BY 1")
def node_counts(spark, d):
    return _tree(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.count(F.when(F.col("parent_seq").isNull(), 1)).alias("n_roots"))


@_query(
    f"""WITH {_MD} SELECT doc_id, '[' || string_agg('{{"title":' || to_json(title) || ',"node_id":"' || lpad(CAST(node_seq AS VARCHAR), 4, '0') || '","level":' || level || '}}', ',' ORDER BY node_seq) || ']' AS tree FROM sections GROUP BY 1"""
)
def tree_json(spark, d):
    """Titles, ids and levels of each document in pre-order, as JSON."""
    x = markdown.with_ids(markdown.sections(markdown_docs(spark, d)))
    packed = x.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_seq", F.struct("title", "node_id", "level").alias("n")))).alias("ns"))
    return packed.select("doc_id", F.to_json(F.transform("ns", lambda n: n.n)).alias("tree"))


@_query(
    """SELECT conv_id, turn, CASE WHEN length(text) > 0 THEN 'Relevant sections:' || chr(10) || chr(10) || text ELSE 'No section matches closely. Answer from what is known of the document''s structure, if possible.' END || chr(10) || chr(10) || 'Question: ' || role AS turn_text FROM conversations"""
)
def chat_user_turn(spark, d):
    """Every turn of every conversation."""
    return _table(spark, d, "conversations").select("conv_id", "turn", search.user_turn(F.col("text"), F.col("role")).alias("turn_text"))


@_query(
    """SELECT a.conv_id, a.turn, count(b.turn) AS n_before, string_agg(b.role || ': ' || b.text, chr(10) ORDER BY b.turn) AS history
FROM conversations a LEFT JOIN (SELECT *, 1 AS one FROM conversations) b ON a.conv_id = b.conv_id AND b.turn < a.turn AND (SELECT count(*) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < a.turn AND c.turn > b.turn) < 10
GROUP BY 1, 2"""
)
def chat_history_of_turns(spark, d):
    """For every turn, the ten messages before it as a model is given them."""
    chat = _table(spark, d, "conversations")
    found = search.with_history(chat.select("conv_id", "turn"), chat)
    text = F.array_join(F.transform("history", lambda x: F.concat(x.role, F.lit(": "), x.content)), "\n")
    return found.select("conv_id", "turn", F.size("history").cast("long").alias("n_before"), F.when(F.size("history") > 0, text).alias("history"))


@_query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'What crops are grown in clay soil?' WHEN doc_id % 3 = 1 THEN 'What was the revenue?' ELSE 'What is this document about?' END AS first_question FROM documents"""
)
def chat_suggested_questions(spark, d):
    name = F.expr("element_at(array('Farmer data.csv', 'ANNUAL Report.pdf', 'notes.md'), cast(doc_id % 3 + 1 as int))")
    return _table(spark, d, "documents").select("doc_id", X.suggested_questions(name)[0].alias("first_question"))


def numbered_pages(spark: SparkSession, d: str) -> DataFrame:
    """Ten pages for every ten documents, each under a numbered title line."""
    title = F.concat(F.col("page_no"), F.lit(" Part "), F.col("page_no"), F.lit("\n"))
    return toc_pages_table(spark, d).withColumn("text", F.concat(title, "text"))


@_query("SELECT doc_id // 10 AS doc_id, CAST(doc_id % 10 AS INT) AS list_index, CAST(doc_id % 10 + 1 AS VARCHAR) AS structure, 'Part ' || (doc_id % 10 + 1) AS title, CAST(doc_id % 10 + 1 AS INT) AS physical_index, 'yes' AS appear_start FROM documents")
def outline_by_rules(spark, d):
    """The whole ladder of outline strategies, with the rule-based provider."""
    from quire.plans import structure
    from quire.plans.provider import RuleProvider

    return structure.outline_items(numbered_pages(spark, d), RuleProvider(), structure.Options(max_tokens_each_node=10**9))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to sections, postings and a ranked, cited search."""
    return search_multi_term(spark, sf_dir)
