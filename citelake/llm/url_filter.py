"""URL filter: host and path rules, and a character language-model ratio for all URLs that no rule decides.

Two smoothed variable-order Markov models, of the URLs that rules allow and of those that rules block, are learned from all rows. Both
work on a URL's model string: what follows `://`, A-Z in lower case and every other character as it is, with start and end marks. A
character's probability after its context of ORDER characters is interpolated with those after ever shorter ones (Witten-Bell). A URL's score is
the mean of ln(P blocked / P allowed) over its positions.

The threshold is calibrated on the rule-decided URLs by scores that they get unseen: the strings fall into two folds by their MD5, and each
fold is scored by the models of the other. It lies between the classes' mean scores, as far from each, in its standard deviations, as from the
other. Where a class hardly varies (deviation below LEAST_SPREAD) that says nothing; there it is 0, or halfway if both means are of one sign.

Distinct model strings are counted and scored once each. All grams are counted from the distinct windows of ORDER + 1 characters; these tables
grow with the URLs and are only joined by shuffles, on keys that at most one row for each character shares. Windows meet
the strings' positions by a broadcast of the HEAD most frequent ones (bounded), so that no hot window enters the shuffle in which
the others do. Everything is DataFrame functions.

Defined results: a null URL, or one without `://`, has an empty host, path and model string; the empty string is scored like any other.
If no URL is allowed by a rule, or none is blocked, every score is 0 and the method allows. Very long URLs are a row for each character while
they are scored. Rows that repeat are judged row by row; other columns are passed through, those named like added ones are replaced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, durable, forget, packed

#: (verdict, host and path): fits the host and its subdomains where the path starts with the rule's.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Longest context, windows that are broadcast, and the deviation below which a class's scores count as equal.
ORDER, HEAD, LEAST_SPREAD = 5, 65_536, 0.05
#: Marks before and after a model string.
START, END = "\x02", "\x03"
ADDED = ["host", "path", "rule", "verdict", "score"]


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))


def _parsed(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(row, host, path, _rule, _s): the caller's columns, the parts, struct verdict, rule (null if none fits), the model string."""
    rest = pages.select(packed(pages, ADDED), F.coalesce(_rest(F.col("url")), F.lit("")).alias("_rest"))
    out = rest.withColumn("host", ascii_lower(F.regexp_extract("_rest", r"^[^/?#]*", 0))).withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
    fitting = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(f"/{path}"))
        fitting.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    s = F.concat(F.lit(START * ORDER), ascii_lower("_rest"), F.lit(END))
    return out.select("row", "host", "path", F.coalesce(*fitting).alias("_rule"), s.alias("_s"))


#: Of a class (a: allowed, r: blocked): URLs in fold 0, in fold 1, and in both.
COUNTS = [f"{x}{k}" for x in "ar" for k in "01w"]


def _positions(strings: DataFrame) -> DataFrame:
    """A row for each modelled position of each string: its window, the character with ORDER ones before it."""
    at = strings.withColumn("pos", F.explode(F.sequence(F.lit(ORDER + 1), F.length("s"))))
    return at.withColumn("window", F.substring("s", F.col("pos") - ORDER, F.lit(ORDER + 1))).drop("s", "pos")


def window_scores(strings: DataFrame) -> DataFrame:
    """(window, n, l0, l1, lw): ln(P blocked / P allowed) of each window's last character, by the models of fold 0, fold 1 and both.

    strings: (s, fold, allowed, blocked), the counts of URLs; n is the number of positions."""
    of = {"a": "allowed", "r": "blocked"}
    by_fold = [F.sum(F.when(F.col("fold") == k, F.col(of[x])).otherwise(0) if k != "w" else F.col(of[x])).alias(f"{x}{k}") for x in "ar" for k in (0, 1, "w")]
    windows = durable(_positions(strings).groupBy("window").agg(F.count("*").alias("n"), *by_fold))
    before = None
    for m in range(1, ORDER + 2):
        gram = F.substring("window", ORDER + 2 - m, m)
        own = windows if m == ORDER + 1 else windows.groupBy(gram.alias("window")).agg(*(F.sum(c).alias(c) for c in COUNTS))
        ctx = own.groupBy(F.substring("window", 1, m - 1).alias("_ctx")).agg(*(F.sum(c).alias(f"n_{c}") for c in COUNTS), *(F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in COUNTS))
        own = own.join(ctx, F.substring("window", 1, m - 1) == F.col("_ctx"))
        if before is None:
            characters = own.count()
            own = own.withColumns({f"q_{c}": F.lit(1 / max(1, characters)) for c in COUNTS})
        else:
            own = own.join(before, F.substring("window", 2, m - 1) == F.col("_shorter"))
        p = [F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"q_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"q_{c}")) for c in COUNTS]
        if m <= ORDER:
            before = own.select(F.col("window").alias("_shorter"), *(x.alias(f"q_{c}") for x, c in zip(p, COUNTS, strict=True)))
    p = dict(zip(COUNTS, p, strict=True))
    out = durable(own.select("window", "n", *((F.log(p[f"r{k}"]) - F.log(p[f"a{k}"])).alias(f"l{k}") for k in "01w")))
    forget(windows)
    return out


def string_scores(strings: DataFrame, windows: DataFrame, head: int = HEAD) -> DataFrame:
    """(key, allowed, blocked, score, unseen): the mean log ratio of a string's positions, by all strings and by the other fold's."""
    values = ["l0", "l1", "lw"]
    hot = durable(windows.orderBy(F.desc("n"), "window").limit(head).select(F.col("window").alias("_hot"), *(F.col(c).alias(f"h{c}") for c in values)))
    cold = windows.join(F.broadcast(hot.select("_hot")), F.col("window") == F.col("_hot"), "left_anti").select(F.col("window").alias("_cold"), *values)
    at = _positions(strings).join(F.broadcast(hot), F.col("window") == F.col("_hot"), "left")
    known = at.filter("_hot IS NOT NULL").select("key", "fold", "allowed", "blocked", *(F.col(f"h{c}").alias(c) for c in values))
    rest = at.filter("_hot IS NULL").select("key", "fold", "allowed", "blocked", "window").join(cold, F.col("window") == F.col("_cold"))
    both = known.unionByName(rest.select(*known.columns))
    other = F.when(F.col("fold") == 0, F.col("l1")).otherwise(F.col("l0"))
    return both.groupBy("key", "allowed", "blocked").agg(F.avg("lw").alias("score"), F.avg(other).alias("unseen"))


def threshold_of(scored: DataFrame) -> float:
    """The score above which a URL is blocked (see above), from the rule-decided strings' unseen scores."""
    classes = ("allowed", "blocked")
    n = scored.agg(*(F.sum(F.col("unseen") * F.col(c)) / F.sum(c) for c in classes)).first()
    spread = scored.agg(*(F.sqrt(F.sum((F.col("unseen") - m) * (F.col("unseen") - m) * F.col(c)) / F.sum(c)) for c, m in zip(classes, n, strict=True))).first()
    (ma, mb), (sa, sb) = n, spread
    if min(sa, sb) < LEAST_SPREAD:
        return 0.0 if ma < 0 < mb else (ma + mb) / 2
    return (ma * sb + mb * sa) / (sa + sb)


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """The rows of `pages` with the added columns host, path, rule, verdict and score (null where a rule decides)."""
    parsed = _parsed(pages, rules)
    is_ = lambda v: F.coalesce(F.col("_rule.verdict") == v, F.lit(False)).cast("long")
    key, fold = F.unhex(F.md5("_s")).alias("key"), F.when(F.substring(F.md5("_s"), 1, 1) < "8", 0).otherwise(1).alias("fold")
    strings = durable(parsed.groupBy(key, fold, F.col("_s").alias("s")).agg(F.sum(is_("allow")).alias("allowed"), F.sum(is_("block")).alias("blocked")))
    seen = strings.agg(F.sum("allowed"), F.sum("blocked")).first()
    own = ["row.*", "host", "path", F.col("_rule.rule").alias("rule")]
    if not seen[0] or not seen[1]:
        verdict, score = F.coalesce(F.col("_rule.verdict"), F.lit("allow")), F.when(F.col("_rule").isNull(), F.lit(0.0))
        return parsed.select(*own, verdict.alias("verdict"), score.alias("score"))
    windows = window_scores(strings)
    scored = durable(string_scores(strings, windows))
    threshold = threshold_of(scored)
    forget(strings), forget(windows)
    met = parsed.withColumn("_md5", F.unhex(F.md5("_s"))).join(scored.select(F.col("key").alias("_key"), F.col("score").alias("_score")), F.col("_md5") == F.col("_key"), "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_score") > threshold, "block").otherwise("allow"))
    return met.select(*own, verdict.alias("verdict"), F.when(F.col("_rule").isNull(), F.col("_score")).alias("score"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def _oracle() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    levels = []
    for m in range(1, ORDER + 2):
        before = "1.0::DOUBLE / (SELECT count(*) FROM g1)" if m == 1 else "p.p_{c}"
        p = ", ".join(f"CASE WHEN c.n_{c} > 0 THEN (g.{c} + c.t_{c} * {before.format(c=c)}) / (c.n_{c} + c.t_{c}) ELSE {before.format(c=c)} END AS p_{c}" for c in COUNTS)
        levels.append(f"""
g{m} AS (SELECT right(gram, {m}) AS gram, {', '.join(f'sum({c}) AS {c}' for c in COUNTS)} FROM g GROUP BY 1),
c{m} AS (SELECT left(gram, {m - 1}) AS ctx, {', '.join(f'sum({c}) AS n_{c}, count(*) FILTER ({c} > 0) AS t_{c}' for c in COUNTS)} FROM g{m} GROUP BY 1),
p{m} AS (SELECT g.gram, {p} FROM g{m} g JOIN c{m} c ON left(g.gram, {m - 1}) = c.ctx""" + (f" JOIN p{m - 1} p ON substr(g.gram, 2) = p.gram" if m > 1 else "") + "),")
    sums = ", ".join(f"sum({'allowed' if c[0] == 'a' else 'blocked'}){'' if c[1] == 'w' else f' FILTER (fold = {c[1]})'} AS {c}" for c in COUNTS)
    zeros = ", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTS)
    return rf"""
WITH rules(verdict, rule, rhost, rpath) AS (VALUES {rules}),
u AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, rid, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         repeat('{START}', {ORDER}) || translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '{END}' AS s
  FROM u),
f AS (
  SELECT h.rid, arg_max(verdict, length(rule)) AS verdict, arg_max(rule, length(rule)) AS rule
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY h.rid),
st AS (SELECT s, CASE WHEN left(md5(s), 1) < '8' THEN 0 ELSE 1 END AS fold, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'block') AS blocked FROM h LEFT JOIN f USING (rid) GROUP BY s),
x AS (SELECT s, fold, allowed, blocked, substr(s, pos - {ORDER}, {ORDER + 1}) AS gram FROM (SELECT *, unnest(range({ORDER + 1}, length(s) + 1)) AS pos FROM st)),
g AS (SELECT gram, {zeros} FROM (SELECT gram, {sums} FROM x GROUP BY gram)),{''.join(levels)}
sc AS (
  SELECT x.s, any_value(allowed) AS allowed, any_value(blocked) AS blocked, avg(ln(p_rw) - ln(p_aw)) AS score, avg(CASE WHEN fold = 0 THEN ln(p_r1) - ln(p_a1) ELSE ln(p_r0) - ln(p_a0) END) AS unseen
  FROM x JOIN p{ORDER + 1} p USING (gram) GROUP BY x.s),
mm AS (SELECT sum(allowed) AS n1, sum(blocked) AS n2, sum(allowed * unseen) / sum(allowed) AS ma, sum(blocked * unseen) / sum(blocked) AS mb FROM sc),
ss AS (SELECT sqrt(sum(allowed * (unseen - ma) * (unseen - ma)) / sum(allowed)) AS sa, sqrt(sum(blocked * (unseen - mb) * (unseen - mb)) / sum(blocked)) AS sb FROM sc, mm),
th AS (
  SELECT n1 > 0 AND n2 > 0 AS fitted, CASE WHEN least(sa, sb) >= {LEAST_SPREAD} THEN (ma * sb + mb * sa) / (sa + sb) WHEN ma < 0 AND mb > 0 THEN 0.0 ELSE (ma + mb) / 2 END AS t
  FROM mm, ss)
SELECT h.page_id, h.host, h.path, f.rule,
       coalesce(f.verdict, CASE WHEN th.fitted AND sc.score > th.t THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN f.rule IS NULL THEN CASE WHEN th.fitted THEN round(sc.score, 6) ELSE 0.0 END END AS score
FROM h JOIN sc USING (s) LEFT JOIN f USING (rid), th
"""


ORACLE_OP2 = _oracle()
