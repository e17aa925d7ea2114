"""Virtual collections: projections of the driver's tables that stand for real collections.

Each is one SQL text that Spark and DuckDB both read (``SHA256(x)`` is spelled
per dialect), so the same rows are built for a query and for its check.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

#: One file a document, sixteen shapes of path.
FILES = """
SELECT CASE doc_id % 16
    WHEN 0 THEN 'src/screens/Area' || k || '/Home' || id || 'Screen.tsx' WHEN 1 THEN 'docs/guide' || k || '/page' || id || '.md'
    WHEN 2 THEN 'src/hooks/useThing' || id || '.ts' WHEN 3 THEN 'pkg' || id || '/package.json'
    WHEN 4 THEN 'logs/run' || id || '.log' WHEN 5 THEN 'assets/img' || id || '.png'
    WHEN 6 THEN 'svc' || id || '/poetry.lock' WHEN 7 THEN 'misc/blob' || id || '.blob'
    WHEN 8 THEN 'src/modules/billing' || k || '/api/client' || id || '.ts' WHEN 9 THEN 'src/store/userSlice' || id || '.ts'
    WHEN 10 THEN 'tests/test_unit' || id || '.py' WHEN 11 THEN 'lib/feature' || k || '/core' || id || '.py'
    WHEN 12 THEN 'src/components/Card' || k || '/Card' || id || '.styles.ts' WHEN 13 THEN 'generated/schema' || id || '.ts'
    WHEN 14 THEN 'project' || id || '/README.md' ELSE 'src/navigation/AppRouter' || id || '.tsx' END AS path,
  n_chars AS size, SHA256(text) AS sha256, doc_id AS nth
FROM (SELECT doc_id, CAST(doc_id AS VARCHAR(20)) AS id, CAST(doc_id % 37 AS VARCHAR(20)) AS k, coalesce(n_chars, 0) AS n_chars, coalesce(text, '') AS text FROM documents)
"""

#: Each file imports the one after it, and most one further on.
IMPORTS = f"""
SELECT 'import-' || a.path || '-' || b.path AS id, a.path AS a, b.path AS b FROM ({FILES}) a JOIN ({FILES}) b ON b.nth = a.nth + 1
UNION ALL SELECT 'import-' || a.path || '-' || b.path, a.path, b.path FROM ({FILES}) a JOIN ({FILES}) b ON b.nth = a.nth + 2 + a.nth % 97
"""

#: Notes, one file a brand: headings, links, references, footnotes, concepts, claims.
NOTES = """
SELECT 'notes/' || replace(p_brand, '#', '-') || '.md' AS path,
  CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS line_number,
  CASE p_partkey % 8
    WHEN 0 THEN CASE WHEN p_partkey % 3 = 0 THEN '# ' WHEN p_partkey % 3 = 1 THEN '## ' ELSE '#### ' END || p_name || ' ' || id || '  '
    WHEN 1 THEN 'See [' || p_name || '](parts/' || id || '.md) and ![picture](img/' || p_type || '.png).'
    WHEN 2 THEN 'The **' || p_name || ' concept** supports #' || p_type || '-' || id || ' and `method` or `Grid ' || p_type || ' topics`.'
    WHEN 3 THEN '[ref' || id || ']: https://example.org/p/' || id || CASE WHEN p_partkey % 16 = 3 THEN ' "About ' || p_name || '"' ELSE '' END
    WHEN 4 THEN 'This ' || p_name || ' depends on **' || p_type || '** results[^n' || CAST(p_size AS VARCHAR(20)) || '] and [^n1]'
    WHEN 5 THEN 'Compare [' || p_name || '][ref' || CAST(p_partkey - 2 AS VARCHAR(20)) || '], [ref' || id || '][] and ![x][]'
    WHEN 6 THEN '[^n' || CAST(p_size AS VARCHAR(20)) || ']: footnote about ' || p_name || ' ' || p_type
    ELSE p_name || ' contradicts what ' || p_type || ' requires' END AS line
FROM (SELECT *, CAST(p_partkey AS VARCHAR(20)) AS id FROM part)
"""

LOGS = """
SELECT 'logs/user-' || CAST(user_id % 10 AS VARCHAR(20)) || '.log' AS path,
  CAST(row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS BIGINT) AS line_number,
  CASE event_type WHEN 'error' THEN 'ERROR failed, was INFO' WHEN 'signup' THEN 'info new user' WHEN 'view' THEN '[DEBUG] seen'
    WHEN 'click' THEN 'TRACE: click' ELSE 'WARNING bought' END || ' ' || CAST(event_id AS VARCHAR(20)) AS line
FROM events
"""

CONF = """
SELECT 'conf/nation-' || CAST(nationkey AS VARCHAR(20)) || '.toml' AS path,
  CAST(row_number() OVER (PARTITION BY nationkey ORDER BY what, id) AS BIGINT) AS line_number,
  CASE id % 4 WHEN 0 THEN '  "' || what || '.' || CAST(id AS VARCHAR(20)) || '": 1,' WHEN 1 THEN what || '_' || CAST(id AS VARCHAR(20)) || ' = "x"'
    WHEN 2 THEN '{"' || what || '": {}}' ELSE '# ' || what || ' note' END AS line
FROM (SELECT s_nationkey AS nationkey, 'supplier' AS what, s_suppkey AS id FROM supplier
  UNION ALL SELECT c_nationkey, 'customer', c_custkey FROM customer)
"""

#: Import lines, one file an order; the specifiers are relative, aliased or external.
CODE = """
SELECT 'src/screens/Order' || CAST(l_orderkey AS VARCHAR(20)) || '/OrderScreen.tsx' AS path,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS line_number,
  CASE l_linenumber % 4
    WHEN 0 THEN 'import Part' || p || ' from "../../components/Part' || p || '/Part' || p || '";'
    WHEN 1 THEN 'import { Part' || p || ' as P' || p || ', helper } from ''@/components/Part' || p || '/Part' || p || ''';'
    WHEN 2 THEN 'import Kit' || p || ' from "kit-' || p || '";'
    ELSE 'export function View' || p || '() { return <P' || p || ' size="1"><Part' || p || '/></P' || p || '>; }' END AS line
FROM (SELECT *, CAST(l_partkey AS VARCHAR(20)) AS p FROM lineitem)
"""
COMPONENTS = "SELECT 'src/components/Part' || CAST(p_partkey AS VARCHAR(20)) || '/Part' || CAST(p_partkey AS VARCHAR(20)) || CASE WHEN p_partkey % 2 = 0 THEN '.tsx' ELSE '.ts' END AS path FROM part WHERE p_partkey % 5 <> 0"

NODES = """
SELECT 'file:src/o/' || CAST(o_orderkey AS VARCHAR(20)) || '.ts' AS id, 'file' AS kind, 'Order ' || CAST(o_orderkey AS VARCHAR(20)) AS label,
  'src/o/' || CAST(o_orderkey AS VARCHAR(20)) || '.ts' AS source_path FROM orders
UNION ALL SELECT 'module:kit-' || CAST(p_partkey AS VARCHAR(20)), 'module', 'kit-' || CAST(p_partkey AS VARCHAR(20)), CAST(NULL AS VARCHAR(20)) FROM part WHERE p_partkey % 89 <> 0
UNION ALL SELECT 'symbol:s/' || CAST(s_suppkey AS VARCHAR(20)), CASE WHEN s_suppkey % 3 = 0 THEN 'class' ELSE 'function' END, s_name, 's/' || CAST(s_suppkey AS VARCHAR(20)) FROM supplier
UNION ALL SELECT 'feature:' || n_name, 'feature', n_name, CAST(NULL AS VARCHAR(20)) FROM nation
UNION ALL SELECT 'area:' || r_name, 'area', r_name, CAST(NULL AS VARCHAR(20)) FROM region
UNION ALL SELECT DISTINCT 'role:' || o_orderpriority, 'role', o_orderpriority, CAST(NULL AS VARCHAR(20)) FROM orders
UNION ALL SELECT 'concept:' || CAST(c_custkey AS VARCHAR(20)), 'concept', c_name, CAST(NULL AS VARCHAR(20)) FROM customer
"""
_FACTS = """
SELECT 'contains' AS kind, 'area:' || r_name AS src, 'feature:' || n_name AS dst, 'PROVEN' AS confidence, CAST(NULL AS VARCHAR(20)) AS locator FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT CASE WHEN l_linenumber = 1 THEN 'calls' WHEN l_linenumber = 2 THEN 'references' ELSE 'imports' END, 'file:src/o/' || CAST(l_orderkey AS VARCHAR(20)) || '.ts',
  CASE WHEN l_linenumber = 1 THEN 'symbol:s/' || CAST(l_suppkey AS VARCHAR(20)) ELSE 'module:kit-' || CAST(l_partkey AS VARCHAR(20)) END,
  CASE l_linenumber % 4 WHEN 0 THEN 'INFERRED' WHEN 1 THEN 'PROVEN' WHEN 2 THEN 'DERIVED' ELSE 'PROVEN' END,
  CASE WHEN l_suppkey % 50 = 0 THEN CAST(NULL AS VARCHAR(20)) ELSE CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) || '-' || CAST(l_partkey AS VARCHAR(20)) || '-' || CAST(l_suppkey AS VARCHAR(20)) END FROM lineitem
UNION ALL SELECT 'belongs_to', 'file:src/o/' || CAST(o_orderkey AS VARCHAR(20)) || '.ts', 'feature:' || n_name, 'INFERRED', 'b-' || CAST(o_orderkey AS VARCHAR(20)) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'categorized_as', 'file:src/o/' || CAST(o_orderkey AS VARCHAR(20)) || '.ts', 'role:' || o_orderpriority, 'INFERRED', 'c-' || CAST(o_orderkey AS VARCHAR(20)) FROM orders
UNION ALL SELECT 'depends_on', 'file:src/o/' || CAST(o_orderkey AS VARCHAR(20)) || '.ts', 'file:src/o/' || CAST(o_orderkey - o_orderkey % 9 AS VARCHAR(20)) || '.ts', 'DERIVED', 'd-' || CAST(o_orderkey AS VARCHAR(20)) FROM orders
"""
EDGES = f"""
SELECT 'edge:' || substring(SHA256(kind || '|' || src || '|' || dst || '|' || confidence || '|' || coalesce('evidence:' || locator, '')), 1, 24) AS id,
  kind, src, dst, confidence, 'evidence:' || locator AS evidence_id
FROM ({_FACTS})
"""
EVIDENCE = f"SELECT 'evidence:' || locator AS id, 'tables' AS extractor, kind AS method, locator AS source_locator, confidence FROM ({_FACTS}) WHERE locator IS NOT NULL AND src NOT LIKE '%97.ts'"

#: Two states of one inventory.
BEFORE = "SELECT 'o/' || CAST(o_orderkey AS VARCHAR(20)) AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderkey * 1000 AS mtime_ns, SHA256(o_orderpriority || CASE WHEN o_orderkey % 7 = 0 THEN 'old' ELSE '' END) AS sha256 FROM orders WHERE o_orderkey % 10 <> 0"
AFTER = "SELECT 'o/' || CAST(o_orderkey AS VARCHAR(20)) AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderkey * 1000 + CASE WHEN o_orderkey % 21 = 0 THEN 1 ELSE 0 END AS mtime_ns, SHA256(o_orderpriority) AS sha256 FROM orders WHERE o_orderkey % 11 <> 0"

COLLECTIONS = {
    "files": FILES, "imports": IMPORTS, "notes": NOTES, "logs": LOGS, "conf": CONF, "code": CODE, "components": COMPONENTS,
    "nodes": NODES, "edges": EDGES, "evidence": EVIDENCE, "before": BEFORE, "after": AFTER,
}


def collection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = re.sub(r"SHA256\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", COLLECTIONS[name])
    used = [t for t in TABLES if re.search(rf"(?:FROM|JOIN) {t}\b", text)]
    text = re.sub(rf"(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", text.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def check_sql(query: str) -> str:
    """A DuckDB query over collections, with those it names put before it."""
    used = [n for n in COLLECTIONS if re.search(rf"\bvc_{n}\b", query)]
    head = ", ".join(f"vc_{n} AS ({COLLECTIONS[n]})" for n in used)
    recursive = query.lstrip().startswith("WITH RECURSIVE")
    body = re.sub(r"^\s*WITH( RECURSIVE)? ", "", query, count=1)
    more = body is not query and body != query
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' if more else ' '}{body}"
