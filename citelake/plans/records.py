"""Queries on text, identifiers, markers and records, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.functions import identifiers as I
from citelake.functions import markers as M
from citelake.functions import papers as P
from citelake.functions import text as T
from citelake.operators import records as R
from citelake.sources import tables
from citelake.sources.tables import SQL

from .citations import query

_LETTERS = list(T.LETTERS.items())


def _fold(x: str) -> str:
    out = f"lower(coalesce({x}, ''))"
    for a, b in _LETTERS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"strip_accents({out})"


def _wide(x: str) -> str:
    out = f"lower(coalesce({x}, ''))"
    for a, b in T.UMLAUTS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return _fold(out)


def docs(spark, d):
    return tables.table(spark, d, "documents")


@query("fold_text", f"SELECT doc_id, sha256({_fold('text')}) AS folded FROM documents")
def fold_text(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"))


@query("umlaut_variants", f"SELECT doc_id, sha256({_fold('text')}) <> sha256({_wide('text')}) AS two, length({_wide('text')}) AS wide FROM documents")
def umlaut_variants(spark, d):
    wide = T.expand_umlauts(F.col("text"))
    return docs(spark, d).select("doc_id", (T.fold(F.col("text")) != wide).alias("two"), F.length(wide).cast("long").alias("wide"))


_SEARCH = f"CASE WHEN {_fold('text')} = {_wide('text')} THEN {_fold('text')} ELSE {_fold('text')} || ' ' || {_wide('text')} END"
for _name, _text in (("words", "für DIE erüber"), ("phrase", '"licensed under" MIT'), ("open_quote", 'der "sich ist')):
    _fits = " AND ".join("(" + " OR ".join(f"contains(s, '{v}')" for v in T.query_variants(t, q)) + ")" for t, q in T.query_tokens(_text))

    @query(f"text_filter_{_name}", f"WITH x AS (SELECT doc_id, {_SEARCH} AS s FROM documents) SELECT doc_id FROM x WHERE {_fits}")
    def _filter(spark, d, text=_text):
        return R.text_filter(docs(spark, d).withColumn("search_text", T.search_text(F.col("text"))), text).select("doc_id")


@query("note_text", r"""SELECT page_id, sha256(lower(trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  coalesce(html, ''), '<[^>]+>', ' ', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&quot;', '"', 'g'), '(?i)&apos;', '''', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', chr(1), 'g'), '(?i)&[a-z]+;', ' ', 'g'), chr(1), '&'),
  '[–—]', '-', 'g'), '[\s\x0b\x{00a0}]+', ' ', 'g'), ' '))) AS note FROM pages""")
def note_text(spark, d):
    return tables.table(spark, d, "pages").select("page_id", F.sha2(T.note_text(F.col("html")), 256).alias("note"))


@query("record_numbers", r"SELECT page_id, nullif(regexp_extract(url, '^[^?#]*/(\d+)(?:\.[a-z]+)?/?(?:[?#].*)?$', 1), '') AS record FROM pages")
def record_numbers(spark, d):
    return tables.table(spark, d, "pages").select("page_id", I.record_number(F.col("url")).alias("record"))


#: Written forms of a paper's arXiv id, by its number.
_FORM = "CASE recid % 5 WHEN 0 THEN 'arXiv:' || arxiv_id WHEN 1 THEN 'https://arxiv.org/abs/' || arxiv_id || 'v2' WHEN 2 THEN ' ' || arxiv_id || '.pdf ' WHEN 3 THEN 'hep-th/' || substr(arxiv_id, 1, 4) || '123' ELSE 'see ' || arxiv_id END"


@query("arxiv_ids", SQL + f", f AS (SELECT recid, lower(trim({_FORM})) AS x FROM papers)" + r""", g AS (SELECT recid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/', ''), '^arxiv\s*:\s*', ''), 'v\d{1,2}$', ''), '\.pdf$', '') AS x FROM f)
SELECT recid, CASE WHEN regexp_matches(x, '^\d{4}\.\d+|^[a-z-]+/\d+') THEN x END AS arxiv FROM g""")
def arxiv_ids(spark, d):
    return tables.papers(spark, d).select("recid", I.arxiv_id(F.expr(_FORM)).alias("arxiv"))


_DOI = "'10.1000/' || CASE recid % 3 WHEN 0 THEN 'ABC.' || recid || '.' WHEN 1 THEN 'abc.' || recid || ');' ELSE 'Abc.' || recid END"


@query("dois", SQL + f"SELECT recid, nullif(trim(regexp_replace(lower({_DOI}), '[),.;]+$', '')), '') AS doi FROM papers")
def dois(spark, d):
    return tables.papers(spark, d).select("recid", I.doi(F.expr(_DOI)).alias("doi"))


@query("arxiv_sort_keys", SQL + ", f AS (SELECT recid, CASE WHEN recid % 4 = 0 THEN 'hep-ph/' || substr(arxiv_id, 1, 4) || '012' ELSE arxiv_id || 'v3' END AS x FROM papers), g AS (SELECT recid, regexp_replace(coalesce(x, ''), 'v\\d+$', '') AS x FROM f), h AS (SELECT recid, x, CASE WHEN x LIKE '%/%' THEN substr(x, 8, 4) ELSE x[1:4] END AS ym, CASE WHEN x LIKE '%/%' THEN substr(x, 12, 3) ELSE x[6:] END AS n FROM g) SELECT recid, CASE WHEN x = '' THEN '' ELSE CASE WHEN CAST(ym[1:2] AS INT) >= 91 THEN '19' ELSE '20' END || ym || lpad(n, 6, '0') END AS key FROM h")
def arxiv_sort_keys(spark, d):
    form = F.expr("CASE WHEN recid % 4 = 0 THEN 'hep-ph/' || substr(arxiv_id, 1, 4) || '012' ELSE arxiv_id || 'v3' END")
    return tables.papers(spark, d).select("recid", I.arxiv_sort_key(form).alias("key"))


@query("count_sort_keys", SQL + "SELECT recid, lpad(CAST(citation_count AS VARCHAR), 10, '0') AS key FROM papers")
def count_sort_keys(spark, d):
    return tables.papers(spark, d).select("recid", I.padded(F.col("citation_count")).alias("key"))


@query("first_identifiers", SQL + "SELECT recid, CASE WHEN recid % 4 = 0 THEN 'doi' WHEN arxiv_id IS NOT NULL THEN 'arxiv' ELSE 'recid' END AS kind, CASE WHEN recid % 4 = 0 THEN '10.1/' || recid WHEN arxiv_id IS NOT NULL THEN arxiv_id ELSE CAST(recid AS VARCHAR) END AS value FROM papers")
def first_identifiers(spark, d):
    doi = F.when(F.col("recid") % 4 == 0, F.concat(F.lit("10.1/"), F.col("recid").cast("string")))
    best = I.first_identifier(("doi", doi), ("arxiv", F.col("arxiv_id")), ("recid", F.col("recid").cast("string")))
    return tables.papers(spark, d).select("recid", best.alias("b")).select("recid", "b.*")


@query("find_duplicates", SQL + """, it AS (SELECT recid + 1 AS item_id, CASE WHEN recid % 9 <> 0 THEN recid END AS recid, arxiv_id, CASE WHEN recid % 2 = 0 THEN '10.1/' || (recid // 2) END AS doi FROM papers WHERE recid % 3 = 0),
en AS (SELECT recid AS id, CASE WHEN recid % 2 = 0 THEN recid END AS recid, arxiv_id, '10.1/' || recid AS doi FROM papers),
m AS (SELECT id, 0 AS o, 'recid' AS match, min(item_id) AS item_id FROM en JOIN it ON en.recid = it.recid GROUP BY id UNION ALL SELECT id, 1, 'arxiv_id', min(item_id) FROM en JOIN it ON en.arxiv_id = it.arxiv_id GROUP BY id
  UNION ALL SELECT id, 2, 'doi', min(item_id) FROM en JOIN it ON en.doi = it.doi GROUP BY id)
SELECT id, item_id, match FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS r FROM m) WHERE r = 1""")
def find_duplicates(spark, d):
    p = tables.papers(spark, d)
    items = p.filter("recid % 3 = 0").selectExpr("recid + 1 AS item_id", "CASE WHEN recid % 9 <> 0 THEN recid END AS recid", "arxiv_id", "CASE WHEN recid % 2 = 0 THEN '10.1/' || (recid div 2) END AS doi")
    entries = p.selectExpr("recid AS id", "CASE WHEN recid % 2 = 0 THEN recid END AS recid", "arxiv_id", "'10.1/' || recid AS doi")
    return R.find_duplicates(entries, items, ["recid", "arxiv_id", "doi"])


_CAP = "SELECT o_orderkey AS recid, 0 AS pos, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT DISTINCT l_orderkey, l_suppkey + 1, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"


@query("capped_authors", f"WITH a AS ({_CAP}), r AS (SELECT *, row_number() OVER (PARTITION BY recid ORDER BY pos) AS k, count(*) OVER (PARTITION BY recid) AS n FROM a) SELECT recid, max(n) AS total, string_agg(name, '; ' ORDER BY k) FILTER (k <= CASE WHEN n > 5 THEN 1 ELSE 3 END) AS authors FROM r GROUP BY recid")
def capped_authors(spark, d):
    """The first three authors, of more than five only the first (the reference's bounds are 10 and 20; orders have few)."""
    t = lambda n: tables.table(spark, d, n)
    first = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("recid"), F.lit(0).cast("long").alias("pos"), F.col("c_name").alias("name"))
    rest = t("lineitem").select("l_orderkey", "l_suppkey").distinct().join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("l_orderkey", (F.col("l_suppkey") + 1).alias("pos"), F.col("s_name").alias("name"))
    names = first.union(rest).groupBy("recid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    cap = F.when(F.size("names") > 5, 1).otherwise(3)
    return names.select("recid", F.size("names").cast("long").alias("total"), F.array_join(F.slice("names", F.lit(1), cap), "; ").alias("authors"))


@query("publication_summaries", SQL + "SELECT recid, trim(concat_ws(' ', regexp_replace(journal_title, '#', '. ', 'g'), '(' || year || ')', CASE WHEN arxiv_id IS NOT NULL THEN '[arXiv:' || arxiv_id || ']' END)) AS summary FROM papers")
def publication_summaries(spark, d):
    parts = F.concat_ws(" ", F.regexp_replace("journal_title", "#", ". "), F.concat(F.lit("("), "year", F.lit(")")), F.when(F.col("arxiv_id").isNotNull(), F.concat(F.lit("[arXiv:"), "arxiv_id", F.lit("]"))))
    return tables.papers(spark, d).select("recid", F.trim(parts).alias("summary"))


@query("fractional_years", SQL + "SELECT recid, CASE recid % 3 WHEN 0 THEN round(CAST(year AS INT) + 0.5::DOUBLE, 6) WHEN 1 THEN round(CAST(year AS INT) + ((CAST(earliest_date[6:7] AS INT) - 1) * 30.44::DOUBLE + 15) / 365, 6) ELSE round(CAST(year AS INT) + ((CAST(earliest_date[6:7] AS INT) - 1) * 30.44::DOUBLE + CAST(earliest_date[9:10] AS INT)) / 365, 6) END AS time FROM papers")
def fractional_years(spark, d):
    date = F.expr("substr(earliest_date, 1, CASE recid % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END)")
    return tables.papers(spark, d).select("recid", F.round(P.fractional_year(date), 6).alias("time"))


#: A line item as a sentence with citation markers.
_MARK = "'see [' || l_partkey || ', ' || l_suppkey || '-' || (l_suppkey + l_linenumber) || '] and [' || (l_partkey + 200) || '-' || l_linenumber || ']'"


@query("marker_labels", f"""WITH t AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
x AS (SELECT rid, 1 AS o, l_partkey AS v FROM t UNION ALL SELECT rid, 2 + unnest(range(l_suppkey, l_suppkey + l_linenumber + 1)) - l_suppkey, unnest(range(l_suppkey, l_suppkey + l_linenumber + 1)) FROM t
  UNION ALL SELECT rid, 100, l_partkey + 200 FROM t UNION ALL SELECT rid, 101, l_linenumber FROM t),
f AS (SELECT rid, v, min(o) AS o FROM x GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, string_agg(CAST(v AS VARCHAR), ',' ORDER BY o) AS labels FROM t JOIN f USING (rid) GROUP BY rid, l_orderkey, l_linenumber""")
def marker_labels(spark, d):
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(M.bracket_labels(F.expr(_MARK)), ",").alias("labels"))


@query("lost_ranges", "WITH t AS (SELECT DISTINCT l_partkey AS n FROM lineitem WHERE l_partkey BETWEEN 1000 AND 9999), x AS (SELECT n, CAST(n AS VARCHAR) AS s FROM t), y AS (SELECT n, s, i, CAST(s[1:i] AS INT) AS a, CAST(s[i + 1:] AS INT) AS b FROM x, range(1, 4) r(i) WHERE n NOT BETWEEN 1500 AND 2099 AND (length(s) - i = 1 OR s[i + 1:i + 1] <> '0')), z AS (SELECT n, a, b, row_number() OVER (PARTITION BY n ORDER BY i) AS k FROM y WHERE a >= 1 AND a < b AND a < 100 AND b < 100 AND b - a <= 50) SELECT t.n, CASE WHEN a IS NOT NULL THEN array_to_string(range(a, b + 1), ',') END AS labels FROM t LEFT JOIN z ON z.n = t.n AND k = 1")
def lost_ranges(spark, d):
    n = tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("n")).filter("n BETWEEN 1000 AND 9999").distinct()
    return n.select("n", F.array_join(M.lost_range(F.col("n").cast("string")), ",").alias("labels"))


@query("superscripts", "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) || ',' || CAST(l_linenumber AS VARCHAR) AS labels FROM lineitem")
def superscripts(spark, d):
    raised = lambda c: F.translate(F.col(c).cast("string"), "0123456789", M.SUPERSCRIPTS)
    text = F.concat(F.lit("as shown"), raised("l_partkey"), F.lit(" before"), raised("l_linenumber"))
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(M.superscripts(text), ",").alias("labels"))


@query("citation_formats", "SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N') AS author_year, count(*) FILTER (l_returnflag = 'N') AS numbered, CASE WHEN count(*) >= 3 AND count(*) FILTER (l_returnflag <> 'N') / count(*) >= 0.5 THEN 'author-year' ELSE 'numeric' END AS format FROM lineitem GROUP BY l_orderkey")
def citation_formats(spark, d):
    line = tables.table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "N", F.concat(F.lit("seen [" ), "l_partkey", F.lit("] here"))).otherwise(F.lit("seen by Smith et al. (1998) here")).alias("t"))
    counted = line.select("l_orderkey", F.regexp_count("t", F.lit(M.BRACKETS)).alias("n"), F.regexp_count("t", F.lit(M.AUTHOR_YEAR)).alias("a")).groupBy("l_orderkey").agg(F.sum("a").alias("author_year"), F.sum("n").alias("numbered"))
    return counted.withColumn("format", M.format_vote(F.col("numbered"), F.col("author_year")))


#: A library's copy of the orders, some fields blank, old or written otherwise.
_LOCAL = {"status": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE lower(o_orderstatus) END", "priority": "CASE WHEN o_orderkey % 4 = 0 THEN ' ' || o_orderpriority || '  ' ELSE o_orderpriority END", "owner": "CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END"}
_REMOTE = {"status": "o_orderstatus", "priority": "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END", "owner": "o_custkey"}
_CHANGES = "WITH c AS (" + " UNION ALL ".join(f"SELECT o_orderkey AS recid, '{f}' AS field, CAST({_LOCAL[f]} AS VARCHAR) AS local_value, CAST({_REMOTE[f]} AS VARCHAR) AS remote_value FROM orders" for f in _LOCAL) + "), n AS (SELECT *, lower(trim(coalesce(local_value, ''))) AS a, lower(trim(coalesce(remote_value, ''))) AS b FROM c), ch AS (SELECT recid, field, local_value, remote_value, a = '' AS was_empty FROM n WHERE b <> '' AND a <> b)"


def _changes(spark, d):
    o = tables.table(spark, d, "orders")
    local = o.select(F.col("o_orderkey").alias("recid"), *(F.expr(x).alias(f) for f, x in _LOCAL.items()))
    remote = o.select(F.col("o_orderkey").alias("recid"), *(F.expr(x).alias(f) for f, x in _REMOTE.items()))
    return R.field_changes(local, remote, "recid", list(_LOCAL))


@query("field_changes", _CHANGES + " SELECT * FROM ch")
def field_changes(spark, d):
    return _changes(spark, d)


@query("protected_changes", _CHANGES + " SELECT * FROM ch WHERE NOT (field = 'owner' AND NOT was_empty)")
def protected_changes(spark, d):
    return R.protect(_changes(spark, d), ["owner"])


@query("unpublished_flags", """SELECT o_orderkey AS recid, CASE WHEN o_orderpriority = '5-LOW' THEN false WHEN o_orderkey % 2 = 0 THEN NOT (o_orderkey % 3 <> 0 AND o_orderstatus = 'F' AND o_orderkey % 5 <> 0) WHEN o_orderkey % 4 = 1 THEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 ELSE false END AS unpublished FROM orders""")
def unpublished_flags(spark, d):
    o = tables.table(spark, d, "orders").selectExpr(
        "o_orderkey AS recid", "CASE WHEN o_orderpriority = '5-LOW' THEN 'book' ELSE 'journalArticle' END AS kind", "CASE WHEN o_orderkey % 2 = 0 THEN 'arXiv:' || o_orderkey WHEN o_orderkey % 4 = 1 THEN '' ELSE 'J. Phys.' END AS journal",
        "CASE WHEN o_orderkey % 3 = 0 THEN '10.48550/arXiv.' || o_orderkey ELSE '10.1/' || o_orderkey END AS doi", "CASE WHEN o_orderkey % 7 = 0 THEN 'arXiv:1234.5678' ELSE '' END AS extra", "CASE WHEN o_orderstatus = 'F' THEN '12' END AS volume", "CASE WHEN o_orderkey % 5 <> 0 THEN '1-9' END AS pages",
    )
    c = F.col
    return o.select("recid", R.is_unpublished(c("kind"), c("journal"), c("doi"), c("extra"), c("volume"), c("pages")).alias("unpublished"))


@query("status_summary", "SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS items FROM events GROUP BY 1")
def status_summary(spark, d):
    return tables.table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("items"))


@query("watch_upsert", "WITH l AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type FROM l WHERE k = 1 AND event_type <> 'purchase'")
def watch_upsert(spark, d):
    e = tables.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    half = F.col("event_id") % 2 == 0
    out = R.upsert(e.filter(half), e.filter(~half), "user_id", ["ts", "event_id"], ["event_id", "event_type", "ts"], F.col("event_type") == "purchase")
    return out.select("user_id", "event_id", "event_type")


_CACHE = "SELECT event_id, CASE event_type WHEN 'click' THEN 'refs' WHEN 'view' THEN 'graph' WHEN 'signup' THEN 'profile' ELSE 'cited' END AS kind, CASE WHEN event_id % 13 = 0 THEN 1 ELSE 2 END AS version, event_id % 17 <> 0 AS complete, event_id % 50 AS total, event_id % 60 AS n_rows, ts FROM events"
_STATUS = f"""WITH c AS ({_CACHE}), a AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3600000000 AS age, CASE kind WHEN 'refs' THEN -1 WHEN 'graph' THEN -1 WHEN 'profile' THEN 2 ELSE 400 END AS ttl FROM c),
s AS (SELECT event_id, kind, CAST(floor(age + 0.5) AS BIGINT) AS age_hours, CASE WHEN version <> 2 OR NOT complete THEN 'bad' WHEN ttl > 0 AND age > ttl THEN 'expired' ELSE 'valid' END AS status, total <= n_rows AS whole FROM a)"""


def _entries(spark, d):
    kind = F.expr("CASE event_type WHEN 'click' THEN 'refs' WHEN 'view' THEN 'graph' WHEN 'signup' THEN 'profile' ELSE 'cited' END")
    return tables.table(spark, d, "events").select("event_id", kind.alias("kind"), F.expr("CASE WHEN event_id % 13 = 0 THEN 1 ELSE 2 END").alias("version"), (F.col("event_id") % 17 != 0).alias("complete"), (F.col("event_id") % 50).alias("total"), (F.col("event_id") % 60).alias("n_rows"), F.col("ts").cast("timestamp").alias("ts"))


@query("cache_status", _STATUS + " SELECT * FROM s")
def cache_status(spark, d):
    return R.cache_status(_entries(spark, d), F.expr("timestamp'2024-01-31 00:00:00 UTC'"), 400).select("event_id", "kind", "age_hours", "status", "whole")


@query("cache_purge", _STATUS + " SELECT event_id, kind FROM s WHERE status = 'valid'")
def cache_purge(spark, d):
    return R.purge(_entries(spark, d), F.expr("timestamp'2024-01-31 00:00:00 UTC'"), 400).select("event_id", "kind")


#: References as a reader might have parsed them from a paper, with ids, names and journals written in several ways and parts missing or off, and the entries of its list.
_SCORE_SQL = """, met AS (SELECT e.citing AS doc, e.cited, p.* FROM edges e JOIN papers p ON p.recid = e.cited),
pr AS (SELECT doc, cited AS ref, CASE WHEN cited % 6 = 0 THEN arxiv_id END AS arxiv, CASE WHEN cited % 15 = 0 THEN '10.1/a' || cited END AS doi,
  CASE cited % 4 WHEN 0 THEN 'fam' || owner % 50 WHEN 1 THEN 'fam' WHEN 2 THEN 'zed' || recid % 4 END AS author, CAST(year AS INT) + cited % 5 AS year,
  CASE WHEN cited % 2 = 0 THEN CAST(recid % 90 AS VARCHAR) END AS page, CASE WHEN cited % 3 < 2 THEN nullif(regexp_replace(lower(journal_title), '[^a-z0-9]+', '', 'g'), '') END AS journal, CAST(recid % 20 + CASE WHEN cited % 11 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS volume FROM met),
en AS (SELECT doc, cited AS entry, arxiv_id AS arxiv, CASE WHEN cited % 5 = 0 THEN '10.1/a' || cited END AS doi, 'fam' || owner % 50 AS author, 'giv-n. fam' || owner % 50 || ', b. zed' || recid % 4 AS line, CAST(year AS INT) AS year,
  CASE WHEN recid % 7 > 0 THEN CAST(recid % 90 AS VARCHAR) END AS page, nullif(regexp_replace(lower(journal_title), '[^a-z0-9]+', '', 'g'), '') AS journal, CAST(recid % 20 AS VARCHAR) AS volume FROM met),
pa AS (SELECT a.doc, a.ref, b.entry, coalesce(a.arxiv = b.arxiv, false) AS same_arxiv, coalesce(a.doi = b.doi, false) AS same_doi,
  CASE WHEN a.author IS NULL THEN 0 WHEN a.author = b.author THEN 4 WHEN contains(a.author, b.author) OR contains(b.author, a.author) THEN 3 WHEN contains(b.line, a.author) THEN 2 ELSE 0 END AS author,
  CASE abs(a.year - b.year) WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0.0 END AS year, coalesce(a.page = b.page, false) AS same_page, a.page IS NULL OR b.page IS NULL AS no_page, a.volume = b.volume AS same_volume,
  a.journal IS NOT NULL AS has_journal, coalesce(a.journal = b.journal OR (least(length(a.journal), length(b.journal)) >= 6 AND left(a.journal, least(length(a.journal), length(b.journal)) - 2) = left(b.journal, least(length(a.journal), length(b.journal)) - 2)), false) AS alike
  FROM pr a JOIN en b ON a.doc = b.doc),
m AS (SELECT doc, ref, entry, CASE WHEN same_arxiv THEN 10.0 WHEN same_doi THEN 9.0 ELSE author + year + CASE WHEN same_page THEN 2 ELSE 0 END + CASE WHEN has_journal AND same_volume AND (same_page OR (alike AND no_page)) THEN 4 ELSE 0 END END AS score FROM pa)
SELECT doc, ref, entry, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc, ref ORDER BY score DESC, entry) AS r FROM m) WHERE r = 1 AND score >= 3"""


@query("best_matches", SQL + _SCORE_SQL)
def best_matches(spark, d):
    p = tables.papers(spark, d, "recid", "owner", "year", "arxiv_id", "journal_title")
    met = tables.edges(spark, d).join(p.withColumnRenamed("recid", "cited"), "cited").withColumnRenamed("citing", "doc")
    parsed = met.selectExpr(
        "doc", "cited AS ref", "CASE WHEN cited % 12 = 0 THEN concat('arXiv:', arxiv_id, 'v2') WHEN cited % 6 = 0 THEN concat('https://arxiv.org/abs/', arxiv_id) END AS arxiv", "CASE WHEN cited % 15 = 0 THEN concat('10.1/A', cited, '.') END AS doi",
        "CASE cited % 4 WHEN 0 THEN concat('F-am', owner % 50) WHEN 1 THEN 'FAM' WHEN 2 THEN concat('Z.ed', cited % 4) ELSE '' END AS author", "cast(year as int) + cast(cited % 5 as int) AS year", "CASE WHEN cited % 2 = 0 THEN cast(cited % 90 as string) ELSE '' END AS page",
        "CASE cited % 3 WHEN 0 THEN journal_title WHEN 1 THEN concat(upper(journal_title), '. (Ser. A)') END AS journal", "cast(cited % 20 + CASE WHEN cited % 11 = 0 THEN 1 ELSE 0 END as string) AS volume",
    )
    entries = met.selectExpr(
        "doc", "cited AS entry", "arxiv_id AS arxiv", "CASE WHEN cited % 5 = 0 THEN concat('10.1/a', cited) END AS doi", "concat('Fam', owner % 50, ', Giv-N.') AS author", "concat('Giv-N. Fam', owner % 50, ', B. Zed', cited % 4) AS line", "cast(year as int) AS year",
        "CASE WHEN cited % 7 > 0 THEN cast(cited % 90 as string) END AS page", "journal_title AS journal", "cast(cited % 20 as string) AS volume",
    )
    return R.best_matches(parsed, entries)


@query("alignment", SQL + ", o AS (SELECT citing, cited, row_number() OVER (PARTITION BY citing ORDER BY cited) AS k, row_number() OVER (PARTITION BY citing ORDER BY cited % 100, cited) AS j FROM edges), r AS (SELECT citing, avg(CASE WHEN k = j THEN 1.0 ELSE 0.0 END) AS rate FROM o GROUP BY citing) SELECT citing, round(rate, 6) AS rate, CASE WHEN rate >= 0.95 THEN 'aligned' WHEN rate >= 0.7 THEN 'mostly' WHEN rate >= 0.3 THEN 'partly' ELSE 'unaligned' END AS advice FROM r")
def alignment(spark, d):
    from pyspark.sql import Window

    e = tables.edges(spark, d)
    at = lambda *keys: F.row_number().over(Window.partitionBy("citing").orderBy(*keys))
    placed = e.select("citing", (at("cited") == at(F.col("cited") % 100, "cited")).cast("double").alias("hit"))
    rate = F.col("rate")
    out = placed.groupBy("citing").agg(F.avg("hit").alias("rate"))
    return out.select("citing", F.round("rate", 6).alias("rate"), F.when(rate >= 0.95, "aligned").when(rate >= 0.7, "mostly").when(rate >= 0.3, "partly").otherwise("unaligned").alias("advice"))


@query("merged_creators", "WITH r AS (SELECT DISTINCT l_orderkey AS item, l_suppkey AS pos FROM lineitem) SELECT item, pos, CASE WHEN pos % 4 = 0 THEN 'Müller ' || pos WHEN pos % 4 = 1 THEN 'PROTECTED ' || pos ELSE 'Muller ' || pos END AS name, pos % 4 = 0 OR (pos % 4 = 1 AND pos = 1) AS kept FROM r WHERE pos % 4 <> 1 OR pos = 1 UNION ALL SELECT item, pos, 'protected ' || pos, false FROM r WHERE pos % 4 = 1 AND pos <> 1")
def merged_creators(spark, d):
    r = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("pos")).distinct()
    name = lambda m, p: F.concat(F.when(F.col("pos") % 4 == 1, p).otherwise(m), F.lit(" "), F.col("pos").cast("string"))
    local = r.withColumn("name", F.when(F.col("pos") % 4 == 0, name(F.lit("Müller"), F.lit("x"))).otherwise(name(F.lit("muller"), F.lit("PROTECTED"))))
    return R.merge_creators(local, r.withColumn("name", name(F.lit("Muller"), F.lit("protected"))), ["Protected 1"])
