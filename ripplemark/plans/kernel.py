"""The relational operators as queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, bits, text
from ..operators import asof, closure, dedup, lookup, sequence, stats
from ..storage import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _sql_string(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_BLANKS = " || ".join(f"chr({ord(c)})" for c in text.BLANKS)
_SIGNUPS = "SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY user_id, ts"


def _asof(spark: SparkSession, sf_dir: str, default_first: bool) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    left = events.where("event_type <> 'signup'")
    right = events.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    return asof.asof_preceding(left, right, ["user_id"], "ts", "event_id", "signup_id", default_first).select("event_id", "user_id", "event_type", "signup_id")


@_query(f"""
SELECT l.event_id, l.user_id, l.event_type, r.event_id AS signup_id
FROM (SELECT * FROM events WHERE event_type <> 'signup') l
ASOF LEFT JOIN ({_SIGNUPS}) r ON l.user_id = r.user_id AND l.ts > r.ts
""")
def asof_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's nearest strictly earlier signup of the same user."""
    return _asof(spark, sf_dir, False)


@_query(f"""
SELECT l.event_id, l.user_id, l.event_type, coalesce(r.event_id, f.event_id) AS signup_id
FROM (SELECT * FROM events WHERE event_type <> 'signup') l
ASOF LEFT JOIN ({_SIGNUPS}) r ON l.user_id = r.user_id AND l.ts > r.ts
LEFT JOIN (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'signup' GROUP BY user_id) f ON l.user_id = f.user_id
""")
def asof_default_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the user's first signup where none is earlier."""
    return _asof(spark, sf_dir, True)


@_query(f"""
WITH a AS (SELECT l.event_type, r.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type <> 'signup') l
           ASOF LEFT JOIN ({_SIGNUPS}) r ON l.user_id = r.user_id AND l.ts > r.ts)
SELECT CASE WHEN signup_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS bucket, event_type, count(*) AS n FROM a GROUP BY 1, 2
UNION ALL SELECT CASE WHEN signup_id IS NULL THEN 'unresolved' ELSE 'resolved' END, NULL, count(*) FROM a GROUP BY 1
UNION ALL SELECT 'selected', event_type, count(*) FROM a GROUP BY 2
UNION ALL SELECT 'selected', NULL, count(*) FROM a
""")
def resolution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of each type the as-of lookup resolves, and in all."""
    found = _asof(spark, sf_dir, False).withColumn("outcome", F.when(F.col("signup_id").isNull(), "unresolved").otherwise("resolved"))
    return stats.outcome_buckets(found, "outcome", "event_type", {"resolved": ["selected"], "unresolved": ["selected"]})


@_query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return dedup.last_wins(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


_LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@_query(f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LINE)}) = 1")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_wins(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE)


@_query("""
WITH n AS (SELECT s_nationkey, min(s_suppkey) AS v FROM supplier WHERE s_acctbal > 0 GROUP BY 1),
g AS (SELECT n_regionkey, min(s_suppkey) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT c_custkey, coalesce(d.s_suppkey, n.v, g.v, -1::BIGINT) AS supplier_key,
       CASE WHEN d.s_suppkey IS NOT NULL THEN 'direct' WHEN n.v IS NOT NULL THEN 'nation' WHEN g.v IS NOT NULL THEN 'region' ELSE 'none' END AS resolution
FROM customer LEFT JOIN supplier d ON c_custkey = d.s_suppkey LEFT JOIN n ON c_nationkey = n.s_nationkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN g ON nation.n_regionkey = g.n_regionkey
""")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier for each customer: of the same number, else the first solvent one of the nation, else the first of the region."""
    supplier = read(spark, sf_dir, "supplier")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    base = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    regional = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("rk"), "s_suppkey")
    steps = [
        lookup.Step("direct", supplier.select("s_suppkey", F.col("s_suppkey").alias("v")), "s_suppkey", "v", F.col("c_custkey")),
        lookup.Step("nation", supplier.where("s_acctbal > 0"), "s_nationkey", "s_suppkey", F.col("c_nationkey")),
        lookup.Step("region", regional, "rk", "s_suppkey", F.col("n_regionkey")),
    ]
    out = lookup.fallback_chain(base, steps, "supplier_key", "resolution", F.lit(-1).cast("bigint"))
    return out.select("c_custkey", "supplier_key", "resolution")


@_query("""
SELECT l_orderkey, arg_min(l_returnflag, k) AS l_returnflag, arg_min(l_partkey, k) AS part_key
FROM (SELECT *, (CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_linenumber, l_partkey) AS k FROM lineitem WHERE l_returnflag IN ('R', 'A', 'N'))
GROUP BY 1
""")
def priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.priority_pick(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ["R", "A", "N"], "l_partkey", ["l_linenumber"], "part_key")


@_query("""
WITH d AS (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
p AS (SELECT c_custkey, s_suppkey, (CASE WHEN c_nationkey = s_nationkey THEN 400 ELSE 0 END + CASE WHEN c_acctbal > 0 AND s_acctbal > 0 THEN 250 ELSE 0 END
           + greatest(0, 40 - least(abs(c_custkey % 100 - s_suppkey), 40)) + CASE WHEN s_suppkey < c_custkey THEN 5 ELSE 0 END)::INTEGER AS score
           FROM d JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second, count(*) OVER (PARTITION BY c_custkey) AS n
      FROM p WINDOW w AS (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey))
SELECT c_custkey, CASE WHEN n = 1 OR score > second THEN s_suppkey END AS supplier_key, score, n AS n_candidates FROM r WHERE rank = 1
""")
def scored_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's best supplier among those that delivered to them: no more pairs than lines."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    lines = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    deals = lines.select("o_custkey", "l_suppkey").distinct()
    pairs = deals.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    near = F.greatest(F.lit(0), 40 - F.least(F.abs(F.col("c_custkey") % 100 - F.col("s_suppkey")), F.lit(40)))
    home = F.when(F.col("c_nationkey") == F.col("s_nationkey"), 400).otherwise(0)
    score = home + F.when((F.col("c_acctbal") > 0) & (F.col("s_acctbal") > 0), 250).otherwise(0) + near + F.when(F.col("s_suppkey") < F.col("c_custkey"), 5).otherwise(0)
    return lookup.scored_match(pairs, "c_custkey", "s_suppkey", score.cast("int"), "supplier_key")


_REASONS_SQL = """
WITH d AS (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS seen FROM documents),
r AS (SELECT CASE WHEN seen > 1 THEN 'duplicate' WHEN l.doc_id IS NULL THEN 'unlabeled' WHEN quality = 0 THEN 'filtered_by_option'
             WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 200 THEN 'trivial' END AS reason
      FROM d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("hash"))
    docs = docs.withColumn("seen", F.row_number().over(Window.partitionBy("hash").orderBy("doc_id")))
    labels = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled")
    both = docs.join(labels, F.col("doc_id") == F.col("labelled"), "left")
    checks = [("duplicate", F.col("seen") > 1), ("unlabeled", F.col("labelled").isNull()), ("filtered_by_option", F.col("quality") == 0), ("toxic", F.col("toxic") == 1), ("trivial", F.col("n_chars") < 200)]
    return both.select("doc_id", stats.first_reason(checks).alias("reason"))


@_query(_REASONS_SQL + "SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1")
def drop_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first check that drops them."""
    return _reasons(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@_query(_REASONS_SQL + "SELECT string_agg(reason || ':' || n, ', ' ORDER BY reason) AS summary FROM (SELECT coalesce(reason, 'null') AS reason, count(*) AS n FROM r GROUP BY 1)")
def drop_reason_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(_reasons(spark, sf_dir), "reason")


_PARENTS = {"error": ["skipped", "selected"], "view": ["extracted", "selected"], "click": ["extracted", "selected"], "purchase": ["extracted", "selected"], "signup": ["selected"]}


@_query(
    "WITH s AS ("
    + " UNION ALL ".join(["SELECT event_type AS bucket, user_id FROM events", *[f"SELECT '{p}', user_id FROM events WHERE event_type = '{e}'" for e, ps in _PARENTS.items() for p in ps]])
    + ") SELECT bucket, user_id::VARCHAR AS kind, count(*) AS n FROM s GROUP BY 1, 2 UNION ALL SELECT bucket, NULL, count(*) FROM s GROUP BY 1"
)
def outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("kind"))
    return stats.outcome_buckets(events, "event_type", "kind", _PARENTS)


@_query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_suppliers, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS only_supplier FROM lineitem GROUP BY 1")
def unique_vs_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.unique_values(read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "n_suppliers", "only_supplier")


@_query("SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events UNION SELECT c_custkey FROM customer")
def union_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that any of three tables names."""
    parts = [(read(spark, sf_dir, t), c) for t, c in (("orders", "o_custkey"), ("events", "user_id"), ("customer", "c_custkey"))]
    return stats.union_distinct(parts, "id")


@_query("""
WITH o AS (SELECT doc_id, text FROM documents ANTI JOIN labels USING (doc_id)),
t AS (SELECT sha256(text) AS h, min(doc_id) AS owner FROM documents SEMI JOIN labels USING (doc_id) GROUP BY 1)
SELECT o.doc_id, coalesce(t.owner, o.doc_id) AS resolved_id, t.owner IS NULL AS is_orphan FROM o LEFT JOIN t ON sha256(o.text) = t.h
""")
def orphan_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label go to the labelled document with their text, else to themselves as orphans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    labels = read(spark, sf_dir, "labels").select("doc_id")
    owned = docs.join(labels.distinct(), "doc_id", "left_semi").select(F.col("hash").alias("h"), F.col("doc_id").alias("owner"))
    out = lookup.fallback_chain(lookup.orphans(docs, labels, "doc_id"), [lookup.Step("text", owned, "h", "owner", F.col("hash"))], "resolved_id", "by", F.col("doc_id"))
    return out.select("doc_id", "resolved_id", (F.col("by") == "none").alias("is_orphan"))


@_query("""
WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders),
b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS position FROM customer)
SELECT position, o_orderkey, c_custkey FROM a LEFT JOIN b USING (position)
""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    customer = read(spark, sf_dir, "customer").select("c_acctbal", "c_custkey")
    return sequence.positional_zip(orders, ["o_totalprice", "o_orderkey"], customer, ["c_acctbal", "c_custkey"]).select("position", "o_orderkey", "c_custkey")


@_query("""
SELECT coalesce(c_custkey, s_suppkey) AS id,
       CASE WHEN c_name IS NULL OR c_name = '' THEN coalesce(s_name, c_name) ELSE c_name END AS name,
       CASE WHEN c_nationkey IS NULL OR c_nationkey = 0 THEN coalesce(s_nationkey, c_nationkey) ELSE c_nationkey END AS nation,
       coalesce(s_acctbal, c_acctbal) AS balance
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey
""")
def merge_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda t, p, k: read(spark, sf_dir, t).select(F.col(k).alias("id"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_acctbal").alias("balance"))
    return lookup.merge_with_defaults(named("customer", "c", "c_custkey"), named("supplier", "s", "s_suppkey"), "id", ["name", "nation", "balance"], ("balance",))


def _normal_sql(column: str) -> str:
    return f"trim(replace(replace(replace({column}, chr(0), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), {_BLANKS})"


@_query(f"""
WITH p AS (SELECT doc_id, sha256(text) AS v FROM documents SEMI JOIN labels USING (doc_id)),
c AS (SELECT doc_id, sha256({_normal_sql('text')}) AS v FROM documents)
SELECT coalesce(c.doc_id, p.doc_id) AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'new' WHEN c.doc_id IS NULL THEN 'removed' WHEN c.v IS NOT DISTINCT FROM p.v THEN 'unchanged' ELSE 'changed' END AS status
FROM c FULL JOIN p ON c.doc_id = p.doc_id
""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents' texts as a previous run against all documents' normalised texts."""
    docs = read(spark, sf_dir, "documents")
    previous = docs.join(read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("hash"))
    current = docs.select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("hash"))
    return lookup.incremental_diff(current, previous, "doc_id", "hash")


@_query("SELECT doc_id, sha256(text) AS checksum, 'header:' || substr(sha256(text || source || lang), 1, 8) AS header FROM documents")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("checksum"), F.concat(F.lit("header:"), F.substring(F.sha2(F.concat("text", "source", "lang"), 256), 1, 8)).alias("header"))


@_query("SELECT l_orderkey, sha256(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS fingerprint FROM lineitem GROUP BY 1")
def group_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash over the members of a group in ascending order."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    parts = F.transform(lines, lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_suppkey"].cast("string")))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.array_join(parts, ","), 256).alias("fingerprint"))


@_query(f"SELECT doc_id, {_normal_sql('text')} AS text FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@_query(rf"""
SELECT doc_id, '{{\rtf1\ansi\deff0 {{\fonttbl {{\f0 Courier;}}}}' || chr(10) || replace(replace(replace(replace({_normal_sql('text')}, '\', '\\'), '{{', '\{{'), '}}', '\}}'), chr(10), '\par' || chr(10)) || chr(10) || '}}' AS rtf FROM documents
""")
def rtf_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.rtf(text.normalize_text(F.col("text"))).alias("rtf"))


@_query(f"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, {_BLANKS}) <> ''))::INTEGER AS n_lines FROM documents")
def semantic_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(text.filled_lines(F.col("text"))).alias("n_lines"))


@_query("""
SELECT page_id, len(r)::INTEGER AS n_runs, sha256(array_to_string(r, chr(10))) AS runs_hash FROM (
    SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '[\\x20-\\x7E]{3,}'), lambda x: trim(x)), lambda x: x <> '') AS r FROM pages)
""")
def printable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = text.printable_runs(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", runs.alias("r")).select("page_id", F.size("r").alias("n_runs"), F.sha2(F.array_join("r", "\n"), 256).alias("runs_hash"))


@_query(r"SELECT page_id, regexp_replace(list_last(string_split(translate(url, ':\', '//'), '/')), '\.(cst|cct|dcr|dir)$', '', 'i') AS stem FROM pages")
def path_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("stem"))


@_query(r"""
SELECT page_id, CASE WHEN coalesce(s, '') = '' THEN 'artifact' ELSE s END AS file_name
FROM (SELECT page_id, trim(regexp_replace(url, '[/\\?%*:|"<>]', '_', 'g')) AS s FROM pages)
""")
def sanitize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.sanitize(F.col("url")).alias("file_name"))


@_query("""
WITH RECURSIVE e AS (
    SELECT DISTINCT src, dst FROM (SELECT n_nationkey AS src, c_custkey AS dst FROM nation JOIN customer ON c_nationkey = n_nationkey
    UNION ALL SELECT c_custkey + 1000000, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey
    UNION ALL SELECT c_custkey, c_custkey + 1000000 FROM customer)),
r(node) AS (SELECT n_nationkey::BIGINT FROM nation WHERE n_regionkey = 0 UNION SELECT dst FROM r JOIN e ON r.node = e.src)
SELECT node FROM r
""")
def link_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a region's nations lead to: their customers, and those customers' orders, and where equal numbers lead on."""
    nation, customer, orders = (read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    far = F.col("c_custkey") + 1000000
    edges = nation.join(customer, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").cast("bigint").alias("src"), F.col("c_custkey").alias("dst"))
    edges = edges.unionByName(customer.join(orders, F.col("o_custkey") == F.col("c_custkey")).select(far.alias("src"), F.col("o_orderkey").alias("dst")))
    edges = edges.unionByName(customer.select(F.col("c_custkey").alias("src"), far.alias("dst")))
    roots = nation.where("n_regionkey = 0").select(F.col("n_nationkey").cast("bigint").alias("node"))
    return closure.reachable(edges, roots).select("node")


@_query(r"""
WITH RECURSIVE h AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages),
e AS (SELECT DISTINCT 'p' || page_id AS src, 'h' || href AS dst FROM h
      UNION SELECT DISTINCT 'h' || h.href, 'p' || p.page_id FROM h JOIN pages p ON ends_with(p.url, h.href)),
r(node) AS (SELECT DISTINCT 'p' || page_id FROM pages WHERE starts_with(url, 'https://') UNION SELECT dst FROM r JOIN e ON r.node = e.src)
SELECT node FROM r
""")
def page_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that secure pages lead to, and pages whose address ends with such a link."""
    pages = read(spark, sf_dir, "pages")
    page = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    links = pages.select(page.alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    # A link that ends an address equals one of the address's suffixes: an equi-join instead of a pairwise test.
    suffixes = pages.select(page.alias("dst"), "url", F.explode(F.sequence(F.lit(1), F.length("url"))).alias("i")).select("dst", F.expr("substring(url, i)").alias("href"))
    back = links.select("href").distinct().join(suffixes, "href").select(F.concat(F.lit("h"), "href").alias("src"), "dst")
    edges = links.select("src", F.concat(F.lit("h"), "href").alias("dst")).unionByName(back)
    return closure.reachable(edges, pages.where("url like 'https://%'").select(page.alias("node"))).select("node")


@_query("""
WITH RECURSIVE t AS (SELECT c_custkey AS k, CASE WHEN c_custkey >= 2 THEN c_custkey // 2 END AS p, c_acctbal > 9000 AS ok FROM customer),
c(start, k, depth) AS (SELECT k, k, 0 FROM t UNION ALL
  SELECT c.start, t.p, depth + 1 FROM c JOIN t ON c.k = t.k WHERE NOT t.ok AND t.p IS NOT NULL AND depth < 10),
l AS (SELECT start, arg_max(k, depth) AS k, max(depth) AS depth FROM c GROUP BY 1)
SELECT start AS c_custkey, CASE WHEN ok THEN t.k END AS found, depth::INTEGER AS depth, CASE WHEN ok THEN 'found' WHEN p IS NULL THEN 'broken' ELSE 'too deep' END AS outcome
FROM l JOIN t ON l.k = t.k
""")
def bounded_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer borrows from the one of half its number until a rich one is found, ten times at most."""
    key = F.col("c_custkey")
    items = read(spark, sf_dir, "customer").select("c_custkey", F.when(key >= 2, F.floor(key / 2)).cast("bigint").alias("parent"), (F.col("c_acctbal") > 9000).alias("rich"))
    return closure.bounded_chain(items, "c_custkey", "parent", "rich", 10)


@_query("""
SELECT o_custkey, o_orderkey AS "start", coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), (SELECT max(o_orderkey) + 1 FROM orders)) AS "end" FROM orders
""")
def next_offset_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    total = orders.agg((F.max("o_orderkey") + 1).alias("total"))
    return sequence.slices(orders.crossJoin(F.broadcast(total)), "o_custkey", "o_orderkey", "total")


@_query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM events
""")
def forward_fill_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("delta"))
    return sequence.carry_forward(events, ["user_id"], ["ts", "event_id"], "delta", "state").select("event_id", "user_id", "state")


@_query("""
SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding)), lambda i: abs(embedding[i + 1]::DOUBLE - embedding[i]::DOUBLE))) / (len(embedding) - 1), 6) AS score FROM embeddings
""")
def smoothness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.smoothness(F.col("embedding")), 6).alias("score"))


@_query("""
SELECT vec_id, len(list_filter(range(1, len(embedding) // 2 + 1), lambda i: (embedding[i] > 0) = (embedding[i + len(embedding) // 2] > 0)))::DOUBLE / (len(embedding) // 2) AS similarity FROM embeddings
""")
def half_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", arrays.half_similarity(F.col("embedding"), lambda a, b: (a > 0) == (b > 0)).alias("similarity"))


@_query("""
SELECT p_partkey, (ceil(ceil(p_size / 4.0) * 4 * 8 / 8))::BIGINT AS row_bytes,
       ((p_partkey >> 10) & 31) << 3 AS r, ((p_partkey >> 5) & 31) << 3 AS g, (p_partkey & 31) << 3 AS b,
       CASE WHEN p_size & 8 <> 0 THEN 2 WHEN p_size & 4 <> 0 THEN 1 WHEN p_size & 2 <> 0 THEN 3 ELSE 0 END AS kind
FROM (SELECT p_partkey::INTEGER AS p_partkey, p_size FROM part)
""")
def bit_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row alignment, 5-5-5 colours and flag decoding."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("p_partkey"), "p_size")
    return part.select("p_partkey", bits.row_bytes(F.col("p_size"), F.lit(8), F.lit(4)).alias("row_bytes"), bits.rgb555(F.col("p_partkey")).alias("c"), bits.script_kind(F.col("p_size")).alias("kind")).select("p_partkey", "row_bytes", "c.*", "kind")


@_query("""
WITH c AS (SELECT * FROM (VALUES (1, 32), (2, 16), (3, 8), (4, 4), (5, 2), (6, 1)) d(rank, depth), (VALUES (1), (2), (4), (16)) a(align))
SELECT p_partkey, depth, align, ceil(ceil(p_size / align) * align * depth / 8)::BIGINT AS row_bytes
FROM (SELECT p_partkey, p_size::DOUBLE AS p_size, floor(p_retailprice)::BIGINT AS len FROM part), c
WHERE len % ceil(ceil(p_size / align) * align * depth / 8)::BIGINT = 0
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY rank, align) = 1
""")
def candidate_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pixel depth and alignment whose rows divide a payload's length."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.floor("p_retailprice").cast("bigint").alias("len"))
    dims = spark.createDataFrame([(i + 1, d, a) for i, d in enumerate((32, 16, 8, 4, 2, 1)) for a in (1, 2, 4, 16)], "rank int, depth int, align int")
    size = bits.row_bytes(F.col("p_size"), F.col("depth"), F.col("align"))
    return lookup.enumerate_candidates(part, ["p_partkey"], dims, ["rank", "align"], F.col("len") % size == 0).select("p_partkey", "depth", "align", size.alias("row_bytes"))


@_query("SELECT string_agg(event_type || ':' || n, ', ' ORDER BY event_type) AS summary FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def tag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(read(spark, sf_dir, "events"), "event_type")


@_query("""
WITH m AS (SELECT l_orderkey, list({'id': l_linenumber, 'part': l_partkey, 'flag': l_returnflag} ORDER BY l_linenumber, l_partkey, l_returnflag) AS members FROM lineitem GROUP BY 1)
SELECT o_orderkey, to_json({'order': o_orderkey, 'status': o_orderstatus, 'priority': o_orderpriority, 'members': members})::VARCHAR AS manifest
FROM orders JOIN m ON o_orderkey = l_orderkey
""")
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON manifest an order with its lines in order."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag")))).alias("members"))
    orders = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "members")).alias("manifest"))
