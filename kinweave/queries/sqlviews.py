"""The derived logs once more, as SQL common table expressions for the twins."""

TECH = """tech_log AS (
  SELECT 'proj' || (l_suppkey % 10) AS project, l_shipdate AS ts, 'dev' || (o_custkey % 25) AS sender,
         'src/m' || (l_partkey % 7) || '/f' || (l_partkey % 50)
           || CASE l_partkey % 4 WHEN 0 THEN '.java' WHEN 1 THEN '.py' WHEN 2 THEN '.md' ELSE '.json' END AS file,
         CAST(l_quantity AS INTEGER) AS added, CAST(l_linenumber AS INTEGER) AS deleted,
         CAST(l_orderkey AS VARCHAR) AS commit_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""

SOCIAL = """social_log AS (
  SELECT 'proj' || (o_orderkey % 10) AS project, o_orderdate AS ts, 'dev' || (o_custkey % 25) AS sender,
         o_orderpriority AS subject, '<' || o_orderkey || '>' AS message_id
  FROM orders)"""

EVENTS = """event_log AS (
  SELECT event_type AS project, ts, 'user' || (user_id % 30) AS sender,
         CAST(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) % 5 AS VARCHAR) AS subject,
         '<' || event_id || '>' AS message_id,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS month
  FROM events)"""

STATUS = """status AS (
  SELECT DISTINCT 'proj' || (s_suppkey % 10) AS project,
         CASE WHEN s_suppkey % 2 = 0 THEN 'graduated' ELSE 'retired' END AS status
  FROM supplier)"""

MEMBERS = """members AS (
  SELECT s_name AS project,
         CASE WHEN s_nationkey % 3 = 0 THEN 'retired' WHEN s_nationkey % 3 = 1 THEN 'graduated'
              WHEN s_nationkey % 6 = 2 THEN 'graduated' ELSE 'incubating' END AS status
  FROM supplier)"""

PERSONS = """persons AS (
  SELECT 'proj' || ((p_partkey // 5) % 10) AS project,
         CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || 's' WHEN 2 THEN p_name || '@example.org'
              WHEN 3 THEN p_name || ' (' || p_brand || ')'
              ELSE upper(left(p_name, 1)) || substr(p_name, 2) || 'er' END AS name, p_partkey, p_size
  FROM part)"""

def predictions_sql(name: str = "predictions", cut: int = 800) -> str:
    from kinweave.sources.views import STRATEGIES

    strategy = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(STRATEGIES))
    return f"""{name} AS (
  SELECT d.doc_id, CASE CAST(substr(d.source, 4) AS INTEGER) % {len(STRATEGIES)} {strategy} END AS transfer_strategy, d.lang AS model_arch,
         CASE WHEN d.doc_id % 5 = 0 THEN 'all' ELSE (d.doc_id % 5) || '-months' END AS month,
         CASE WHEN d.n_chars > {cut} THEN 1 ELSE 0 END AS pred, l.quality AS target
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def with_ctes(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
