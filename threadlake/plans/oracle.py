"""The same queries as DuckDB SQL over the supplied tables."""

from __future__ import annotations

from . import fixtures as fx
from .queries import BASE_URL, BEFORE, REFRESH_DAYS, SINCE

_POSTS = """
fx_posts AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS subreddit,
    CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_utc, 'u' || o_custkey AS author,
    'order ' || o_orderkey AS title,
    CASE WHEN o_orderkey % 50 = 1 THEN '' WHEN o_orderkey % 50 <> 0
      THEN '/c/' || o_orderkey || '/' END AS permalink,
    'https://archive.example/c/' || o_orderkey AS url,
    CAST(floor(o_totalprice) AS BIGINT) AS score, o_orderkey % 100 AS num_comments,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_self,
    '{"id": "' || o_orderkey || '", "created_utc": '
      || CAST(floor(epoch(o_orderdate)) AS BIGINT) || ', "title": "order ' || o_orderkey || '"}'
      AS archive_json,
    CAST(floor(epoch(o_orderdate)) AS BIGINT) + 60 AS fetched_at,
    o_orderkey AS k, o_custkey AS custkey, o_orderstatus AS status
  FROM orders)"""

_RAW_COMMENTS = """
fx_line AS (
  SELECT *, l_orderkey AS k, l_linenumber AS n, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fx_named AS (
  SELECT *, k || '-' || n AS id, 't3_' || k AS link_id,
    CASE WHEN k % 97 = 0 AND n = 1 THEN 't1_' || k || '-2' WHEN n = 1 THEN 't3_' || k
      ELSE 't1_' || k || '-' || (CASE WHEN k % 2 = 1 THEN n // 2 ELSE n - 1 END) END AS parent_id,
    CASE WHEN (k + n) % 10 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS subreddit,
    t AS created_utc, 'u' || l_suppkey AS author,
    CASE CASE WHEN k % 4 = 1 THEN n % 4 ELSE 3 END WHEN 1 THEN ', "edited": 1e2' WHEN 2 THEN ', "z": ' || t || '.0, "a": [1.50, {"replies": 2}]'
      ELSE '' END AS kept,
    CASE CASE WHEN k % 4 = 1 THEN n % 4 ELSE 3 END WHEN 0 THEN ', "replies": ""' WHEN 1 THEN
      ', "replies": {"kind": "Listing", "data": [{"body": "a \\"]} b", "replies": {}}, 1.50]}' ELSE '' END AS cut,
    CAST(floor(l_quantity) AS BIGINT) - 10 AS score, 'line ' || n || ' of order ' || k AS body
  FROM fx_line),
fx_raw AS (
  SELECT id, link_id, parent_id, subreddit, created_utc, author, score, body,
    '{"id": "' || id || '", "link_id": "' || link_id || '", "parent_id": "' || parent_id
      || '", "subreddit": "' || subreddit || '", "created_utc": ' || created_utc
      || kept || cut || ', "author": "' || author || '", "score": ' || score || ', "body": "' || body || '"}'
      AS archive_json, cut,
    created_utc + 60 AS fetched_at, k, o_custkey AS custkey,
    row_number() OVER (PARTITION BY id ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS copy
  FROM fx_named)"""

_COMMENTS = _RAW_COMMENTS + f""",
fx_comments AS (SELECT * FROM fx_raw WHERE copy = 1),
fx_stored AS (SELECT * FROM fx_comments WHERE created_utc < {fx.SPLIT})"""

_TREES = """
fx_trees AS (
  SELECT id AS link_id, subreddit, '[' || id || ']' AS tree_json, fetched_at
  FROM fx_posts WHERE status = 'F')"""

_REQUESTS = f"""
fx_customer AS (
  SELECT c_custkey AS c, 'C' || c_custkey AS subreddit, kind,
    (c_custkey + CASE kind WHEN 'posts' THEN 0 ELSE 1 END) % 5 AS case_no,
    CAST({fx.FIRST} + (c_custkey % 7) * {fx.HALF_YEAR} AS BIGINT) AS since,
    CAST({fx.LAST} - (c_custkey % 11) * {fx.QUARTER} AS BIGINT) AS before
  FROM customer, (VALUES ('posts'), ('comments')) AS kinds(kind)),
fx_covered AS (
  SELECT subreddit, kind, CASE WHEN case_no IN (0, 1) THEN since + {fx.GAP}
      WHEN case_no = 3 AND c % 10 = 8 THEN before + 1000 ELSE since END AS since,
    CASE WHEN case_no IN (0, 2) THEN before - {fx.GAP}
      WHEN case_no = 3 AND c % 10 = 8 THEN before + 2000 ELSE before END AS until,
    CAST(1 AS BIGINT) AS updated_at
  FROM fx_customer WHERE case_no <> 4),
fx_plan AS (
  SELECT r.subreddit, r.kind, 'full' AS window_type, r.since, r.before
  FROM fx_customer r LEFT JOIN fx_covered v USING (subreddit, kind) WHERE v.since IS NULL
  UNION ALL
  SELECT r.subreddit, r.kind, 'older', r.since, v.since
  FROM fx_customer r JOIN fx_covered v USING (subreddit, kind) WHERE r.since < v.since
  UNION ALL
  SELECT r.subreddit, r.kind, 'tail', v.until, r.before
  FROM fx_customer r JOIN fx_covered v USING (subreddit, kind) WHERE r.before > v.until)"""

_LIVE = """
fx_live AS (
  SELECT id, k, status, '1' AS score_text, '1' AS comments_text, CAST(100 AS BIGINT) AS refreshed_at
  FROM fx_posts
  UNION ALL
  SELECT id, k, status, CASE k % 7 WHEN 0 THEN '12' WHEN 1 THEN '-3' WHEN 2 THEN '1.2k' WHEN 3 THEN NULL
      WHEN 4 THEN '--5' WHEN 5 THEN ' 5' ELSE id END,
    CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '-4' ELSE CAST(k % 300 AS VARCHAR) END, 200
  FROM fx_posts)"""

_OUTCOME = f"""
fx_outcome AS (
  SELECT id, subreddit, CASE WHEN ok THEN 'refreshed' ELSE 'failed' END AS outcome,
    CASE WHEN ok AND regexp_full_match(score_text, '-?[0-9]+')
      THEN TRY_CAST(score_text AS BIGINT) END AS live_score,
    CASE WHEN ok AND regexp_full_match(comments_text, '[0-9]+')
      THEN TRY_CAST(comments_text AS BIGINT) END AS live_num_comments,
    CASE WHEN ok THEN refreshed_at END AS live_refreshed_at
  FROM (
    SELECT p.id, p.subreddit, v.score_text, v.comments_text, v.refreshed_at,
      coalesce(p.permalink <> '' AND v.score_text IS NOT NULL
        AND NOT regexp_full_match(v.score_text, '--+[0-9]+'), false) AS ok
    FROM fx_posts p LEFT JOIN fx_live v
      ON v.id = p.id AND v.refreshed_at = 200 AND v.status <> 'P'
    WHERE p.created_utc >= {fx.NOW - REFRESH_DAYS * 86400}))"""

_JOBS = """
fx_jobs AS (
  SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
fx_specs AS (
  SELECT k,
    CASE k % 12 WHEN 0 THEN NULL WHEN 1 THEN 'all' WHEN 2 THEN ' NOW ' WHEN 3 THEN '' || k * 1000
      WHEN 4 THEN (k % 20) || 'y' WHEN 5 THEN (k % 200) || ' M' WHEN 6 THEN '  ' || (k % 900) || 'D '
      WHEN 7 THEN k || 'h' WHEN 8 THEN day WHEN 9 THEN replace(day, '-0', '-')
      WHEN 10 THEN '2023-02-' || (k % 40) ELSE k || 'w' END AS since_spec,
    CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'now' WHEN 2 THEN 'ALL' WHEN 3 THEN (k % 400) || 'd'
      ELSE day END AS until_spec
  FROM fx_jobs)"""


def _resolve(spec: str, open_end: int) -> str:
    s = f"lower(trim({spec}))"
    amount = f"TRY_CAST(regexp_extract({s}, '^([0-9]+)', 1) AS BIGINT)"
    unit = f"right({s}, 1)"
    return f"""CASE WHEN {spec} IS NULL OR {s} = 'all' THEN {open_end}
      WHEN {s} = 'now' THEN {fx.NOW}
      WHEN regexp_full_match({s}, '[0-9]+') THEN TRY_CAST({s} AS BIGINT)
      WHEN regexp_full_match({s}, '[0-9]+ *[ymdh]') THEN {fx.NOW} - {amount} * CASE {unit}
        WHEN 'y' THEN 365 * 86400 WHEN 'm' THEN 30 * 86400 WHEN 'd' THEN 86400 ELSE 3600 END
      WHEN regexp_full_match({s}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}')
        THEN CAST(epoch(try_strptime({s}, '%Y-%m-%d')) AS BIGINT) END"""


_WINDOWS = _JOBS + f""",
fx_windows AS (
  SELECT k, CAST({_resolve('since_spec', 1119225600)} AS BIGINT) AS since,
    CAST({_resolve('until_spec', fx.NOW)} AS BIGINT) AS before
  FROM fx_specs)"""

_THREADS = _COMMENTS + """,
fx_folded AS (SELECT * REPLACE (lower(subreddit) AS subreddit) FROM fx_comments),
fx_parent AS (
  SELECT c.subreddit, c.link_id, c.id, c.created_utc, p.id AS parent,
    c.parent_id LIKE 't1\\_%' ESCAPE '\\' AND p.id IS NULL AS is_orphan
  FROM fx_folded c LEFT JOIN fx_folded p
    ON p.subreddit = c.subreddit AND p.link_id = c.link_id AND c.parent_id = 't1_' || p.id),
fx_tree AS (
  SELECT subreddit, link_id, id, parent, id AS root_id, 0 AS depth,
    [lpad(CAST(created_utc AS VARCHAR), 12, '0') || '|' || id] AS path
  FROM fx_parent WHERE parent IS NULL
  UNION ALL
  SELECT c.subreddit, c.link_id, c.id, c.parent, t.root_id, t.depth + 1,
    list_append(t.path, lpad(CAST(c.created_utc AS VARCHAR), 12, '0') || '|' || c.id)
  FROM fx_parent c JOIN fx_tree t
    ON c.subreddit = t.subreddit AND c.link_id = t.link_id AND c.parent = t.id),
fx_nodes AS (
  SELECT subreddit, link_id, id, parent, root_id, depth,
    row_number() OVER (PARTITION BY subreddit, link_id ORDER BY path) AS pos
  FROM fx_tree),
fx_unplaced AS (
  SELECT subreddit, link_id, id FROM fx_folded c
  WHERE NOT EXISTS (SELECT 1 FROM fx_nodes n WHERE n.id = c.id))"""

_RAW_POSTS = """
fx_landed AS (
  SELECT o_orderkey AS k, o_orderpriority AS requested, arrival,
    CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t, o_custkey,
    CASE arrival WHEN 1 THEN 'order ' ELSE 'edited ' END || o_orderkey AS name
  FROM orders, (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) AS copies(arrival)
  WHERE arrival = 1 OR o_orderstatus = 'P'),
fx_rows AS (
  SELECT CAST(k AS VARCHAR) AS id, requested AS subreddit,
    CASE WHEN k % 7 = 2 THEN 0 ELSE t END AS created_utc, 'u' || o_custkey AS author,
    name || ' "q" é' AS title, CAST(NULL AS VARCHAR) AS permalink, CAST(NULL AS VARCHAR) AS url,
    CASE WHEN k % 13 <> 0 THEN k % 1000 - 500 END AS score, CAST(NULL AS BIGINT) AS num_comments,
    CASE WHEN k % 9 IN (0, 2, 4, 7) THEN 1 ELSE 0 END AS is_self,
    '{"id": "' || k || '"'
      || CASE k % 11 WHEN 0 THEN '' WHEN 1 THEN ', "subreddit": null' WHEN 2 THEN ', "subreddit": ""'
        ELSE ', "subreddit": "' || requested || '"' END
      || ', "created_utc": '
      || CASE k % 7 WHEN 0 THEN '"' || t || '"' WHEN 1 THEN t || '.75' WHEN 2 THEN 'null'
        ELSE CAST(t AS VARCHAR) END
      || ', "author": "u' || o_custkey || '", "title": "' || name || ' \\"q\\" é", "score": '
      || CASE WHEN k % 13 = 0 THEN '"n/a"' ELSE CAST(k % 1000 - 500 AS VARCHAR) END
      || ', "is_self": '
      || CASE k % 9 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN '0'
        WHEN 4 THEN '"false"' WHEN 5 THEN '""' WHEN 6 THEN '[]' WHEN 7 THEN '{"a": 1}'
        ELSE 'null' END
      || '}' AS archive_json, arrival
  FROM fx_landed)"""

_NAMES = """
fx_names AS (
  SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 't3_'
      WHEN 3 THEN '' || o_orderkey WHEN 4 THEN 't1_' || o_orderkey || '_x' WHEN 5 THEN '_' || o_orderkey
      WHEN 6 THEN 't1_' || o_orderkey ELSE 't3_' || o_orderkey END AS fullname
  FROM orders)"""

_EVENTS = """
fx_events AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_type AS subreddit,
    CAST(floor(epoch(ts)) AS BIGINT) AS created_utc, props AS archive_json, event_id AS k, value
  FROM events)"""


def _sql(select: str, *views: str, recursive: bool = False) -> str:
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(views) if views else ""
    # A select starting with a comma brings further views of its own.
    return f"{head}{select}" if select.startswith(",") else f"{head}\n{select}"


def _threads(select: str) -> str:
    return _sql(select, _THREADS, recursive=True)


_STORES = (_POSTS, _COMMENTS, _TREES)
_TAGGED = """(SELECT subreddit, 'p' AS t FROM fx_posts
  UNION ALL SELECT subreddit, 'c' FROM fx_comments
  UNION ALL SELECT subreddit, 't' FROM fx_trees)"""
_COUNTS = """count(*) FILTER (t = 'p') AS posts, count(*) FILTER (t = 'c') AS comments,
  count(*) FILTER (t = 't') AS comment_trees"""
_WORK = f"""SELECT id, subreddit, permalink, created_utc,
  CASE WHEN permalink <> '' THEN '{BASE_URL}' || permalink END AS url
FROM fx_posts WHERE created_utc >= {fx.NOW - REFRESH_DAYS * 86400}"""
_IN_WINDOW = f"created_utc >= {SINCE} AND created_utc < {BEFORE}"

ORACLE: dict[str, str] = {
    "scan_posts_page": _sql(
        f"""SELECT id, subreddit, created_utc, title FROM fx_posts
        WHERE lower(subreddit) = '1-urgent' AND {_IN_WINDOW} ORDER BY created_utc, id LIMIT 100""",
        _POSTS,
    ),
    "scan_comments_page": _sql(
        f"""SELECT id, link_id, subreddit, created_utc, body FROM fx_comments
        WHERE lower(subreddit) = '1-urgent' AND {_IN_WINDOW}
        ORDER BY created_utc DESC, id DESC LIMIT 50""",
        _COMMENTS,
    ),
    "scan_window": _sql(
        f"""SELECT id, subreddit, created_utc, archive_json FROM fx_posts
        WHERE lower(subreddit) IN ('1-urgent', '5-low') AND {_IN_WINDOW}""",
        _POSTS,
    ),
    "rows_by_subreddit": _sql(
        """SELECT id, created_utc, author, score FROM fx_posts
        WHERE lower(subreddit) = '2-high' ORDER BY created_utc, id""",
        _POSTS,
    ),
    "comments_grouped": _sql(
        """SELECT link_id, created_utc, id, archive_json FROM fx_comments
        WHERE lower(subreddit) = '2-high' ORDER BY link_id, created_utc, id""",
        _COMMENTS,
    ),
    "page_attr_extract": """SELECT page_id,
        nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
        nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset FROM pages""",
    "normalize_posts": _sql(f"SELECT *, CAST({fx.NOW} AS BIGINT) AS fetched_at FROM fx_rows", _RAW_POSTS),
    "normalize_comments": _sql(
        f"""SELECT id, link_id, parent_id, subreddit, created_utc, author, score, body, archive_json,
          CAST({fx.NOW} AS BIGINT) AS fetched_at FROM fx_raw""",
        _RAW_COMMENTS,
    ),
    "dedup_first_wins": _sql(
        "SELECT id, link_id, subreddit, created_utc, author, score FROM fx_comments", _COMMENTS
    ),
    "set_aside_rows": _sql(
        """SELECT k, CASE k % 11 WHEN 2 THEN 'no json ' || k ELSE '{"id": "' || k || '"'
            || CASE k % 11 WHEN 4 THEN '' WHEN 5 THEN ', "subreddit": ""' ELSE ', "subreddit": "s"' END
            || ', "created_utc": ' || CASE k % 11 WHEN 0 THEN 'null' WHEN 1 THEN '"soon"' WHEN 3 THEN t || '000000'
              WHEN 6 THEN '-5' WHEN 7 THEN '"NaN"' ELSE t END || '}' END AS value,
          CASE WHEN k % 11 IN (0, 1, 7) THEN 'no time' WHEN k % 11 = 2 THEN 'no json'
            WHEN k % 11 IN (3, 6) THEN 'time out of range' ELSE 'no community' END AS problem
        FROM (SELECT k, CAST(created_utc AS VARCHAR) AS t FROM fx_posts) WHERE k % 11 < 8""",
        _POSTS,
    ),
    "existing_ids": _sql(
        "SELECT DISTINCT id FROM fx_raw r WHERE EXISTS (SELECT 1 FROM fx_stored s WHERE s.id = r.id)",
        _COMMENTS,
    ),
    "fresh_records": _sql(
        """SELECT id, link_id, created_utc, archive_json FROM fx_comments c
        WHERE NOT EXISTS (SELECT 1 FROM fx_stored s WHERE s.id = c.id)""",
        _COMMENTS,
    ),
    "upsert_posts": _sql(
        f"""SELECT id, subreddit, created_utc, title, is_self, fetched_at FROM fx_posts
        WHERE created_utc < {fx.SPLIT}
        UNION ALL
        SELECT id, subreddit, created_utc, title, is_self, {fx.NOW} FROM fx_rows
        WHERE arrival = 1 AND id NOT IN (SELECT id FROM fx_posts WHERE created_utc < {fx.SPLIT})""",
        _POSTS,
        _RAW_POSTS,
    ),
    "upsert_comments": _sql(
        f"""SELECT id, link_id, parent_id, subreddit, created_utc,
          CASE WHEN created_utc < {fx.SPLIT} THEN 'stored' ELSE author END AS author, body FROM fx_comments""",
        _COMMENTS,
    ),
    "merge_trees": _sql(
        """SELECT id AS link_id,
          CASE WHEN status = 'F' THEN subreddit ELSE lower(subreddit) END AS subreddit,
          CASE WHEN score <= 200000 THEN '[' || id || ']' WHEN num_comments < 50
            THEN '[' || id || ',2]' ELSE '[' || id || ',1]' END AS tree_json,
          fetched_at + CASE WHEN score <= 200000 THEN 0 WHEN num_comments < 50 THEN 2 ELSE 1 END
            AS fetched_at
        FROM fx_posts WHERE status = 'F' OR score > 200000""",
        _POSTS,
    ),
    "subreddit_meta": f"""WITH fx_meta AS (
        SELECT c_mktsegment || '/' || c_nationkey AS subreddit, c_custkey AS c, c_custkey // 300 AS response
        FROM customer),
      fx_heads AS (
        SELECT *, row_number() OVER (PARTITION BY subreddit, response ORDER BY c) AS a FROM fx_meta),
      fx_last AS (
        SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY response DESC) AS b
        FROM fx_heads WHERE a = 1),
      fx_facts AS (
        SELECT subreddit, c,
          CASE WHEN c % 3 = 1 THEN '1600' || lpad(CAST(c AS VARCHAR), 6, '0') END AS created
        FROM fx_last WHERE b = 1)
      SELECT subreddit, c AS subscribers, CAST(created AS BIGINT) AS created_utc,
        CASE WHEN c % 4 <> 0 THEN 'about ' || c END AS public_description,
        '{{"display_name": "' || subreddit || '", "subscribers": ' || c || ', "created_utc": '
          || CASE WHEN c % 3 = 0 THEN '0' ELSE coalesce(created, 'null') END
          || ', "public_description": '
          || CASE WHEN c % 4 = 0 THEN 'null' ELSE '"about ' || c || '"' END || '}}' AS meta_json,
        CAST({fx.NOW} AS BIGINT) AS fetched_at
      FROM fx_facts""",
    "missing_trees": _sql(
        """SELECT p.id, p.subreddit, p.created_utc FROM fx_posts p
        LEFT JOIN fx_trees t ON t.link_id = p.id WHERE t.link_id IS NULL""",
        _POSTS,
        _TREES,
    ),
    "has_tree_flag": _sql(
        "SELECT id, EXISTS (SELECT 1 FROM fx_trees t WHERE t.link_id = p.id) AS has_tree FROM fx_posts p",
        _POSTS,
        _TREES,
    ),
    "csv_posts": _sql(
        """SELECT id, subreddit, created_utc, author, title, permalink, url, score, num_comments,
          is_self, CAST(NULL AS BIGINT) AS live_score, CAST(NULL AS BIGINT) AS live_num_comments,
          CAST(NULL AS BIGINT) AS live_refreshed_at FROM fx_posts""",
        _POSTS,
    ),
    "csv_comments": _sql(
        "SELECT id, link_id, parent_id, subreddit, created_utc, author, score, body FROM fx_comments",
        _COMMENTS,
    ),
    "csv_counts": _sql(
        """SELECT lower(subreddit) AS subreddit, 'posts' AS export, count(*) AS n_rows FROM fx_posts GROUP BY 1
        UNION ALL SELECT lower(subreddit), 'comments', count(*) FROM fx_comments GROUP BY 1""",
        _POSTS,
        _COMMENTS,
    ),
    "coverage_plan": _sql("SELECT * FROM fx_plan", _REQUESTS),
    "coverage_commit": _sql(
        f"""SELECT subreddit, kind,
          CASE WHEN cs IS NULL THEN since WHEN older THEN since ELSE cs END AS since,
          CASE WHEN cs IS NULL THEN before WHEN tail THEN before ELSE cu END AS until,
          CAST(CASE WHEN cs IS NULL OR older OR tail THEN {fx.NOW} ELSE 1 END AS BIGINT) AS updated_at
        FROM (
          SELECT r.subreddit, r.kind, r.since, r.before, v.since AS cs, v.until AS cu,
            r.c % 6 <> 0 AND r.c % 4 <> 0 AS full_ok,
            (r.c + 1) % 6 <> 0 AND (r.c + 1) % 4 <> 0 AND r.since < v.since AS older,
            (r.c + 2) % 6 <> 0 AND (r.c + 2) % 4 <> 0 AND r.before > v.until AS tail
          FROM fx_customer r LEFT JOIN fx_covered v USING (subreddit, kind))
        WHERE cs IS NOT NULL OR full_ok""",
        _REQUESTS,
    ),
    "incremental_load": _sql(
        """SELECT a.kind, a.subreddit, a.id, a.created_utc, p.window_type FROM (
          SELECT 'posts' AS kind, 'c' || custkey AS subreddit, id, created_utc FROM fx_posts
          UNION ALL SELECT 'comments', 'c' || custkey, id, created_utc FROM fx_raw) a
        JOIN fx_plan p ON lower(p.subreddit) = a.subreddit AND p.kind = a.kind
          AND a.created_utc >= p.since AND a.created_utc < p.before""",
        _POSTS,
        _RAW_COMMENTS,
        _REQUESTS,
    ),
    "shard_bounds": _sql(
        """SELECT subreddit, i AS shard, CAST(since + i * step AS BIGINT) AS start,
          CAST(CASE WHEN i = m - 1 THEN before ELSE since + (i + 1) * step END AS BIGINT) AS end
        FROM (
          SELECT *, unnest(range(m)) AS i, (before - since) // m AS step FROM (
            SELECT subreddit, since, before,
              CASE WHEN n <= 1 OR before <= since THEN 1 ELSE n END AS m
            FROM (
              SELECT subreddit, since, c % 9 AS n,
                CASE WHEN c % 13 = 0 THEN since - c % 2 ELSE before END AS before
              FROM fx_customer)))""",
        _REQUESTS,
    ),
    "slice_plan": _sql(
        f"""SELECT row_number() OVER (ORDER BY first) - 1 AS slice,
          CAST(CASE WHEN row_number() OVER (ORDER BY first) = 1 THEN {SINCE} ELSE first * 86400 END AS BIGINT) AS start,
          CAST(coalesce(lead(first) OVER (ORDER BY first) * 86400, {BEFORE}) AS BIGINT) AS end, n_rows
        FROM (SELECT part, min(day) AS first, CAST(sum(n) AS BIGINT) AS n_rows FROM (
            SELECT day, n, (sum(n) OVER (ORDER BY day) - n) * 8 // sum(n) OVER () AS part
            FROM (SELECT created_utc // 86400 AS day, count(*) AS n FROM fx_posts WHERE {_IN_WINDOW} GROUP BY 1))
          GROUP BY part)""",
        _POSTS,
    ),
    "shard_assign": _sql(
        f"""SELECT id, created_utc, CAST(CASE WHEN {_IN_WINDOW}
          THEN least((created_utc - {SINCE}) // (({BEFORE} - {SINCE}) // 8), 7) END AS BIGINT) AS shard
        FROM fx_posts""",
        _POSTS,
    ),
    "keyset_pages": _sql(
        """, ranked AS (
          SELECT lower(subreddit) AS subreddit, created_utc, (row_number() OVER (
            PARTITION BY lower(subreddit) ORDER BY created_utc, id) - 1) // 100 AS page FROM fx_posts),
        crowded AS (
          SELECT subreddit, max(page) AS page FROM ranked GROUP BY subreddit, created_utc
          HAVING count(*) > 100)
        SELECT subreddit, page, count(*) AS n_rows, max(created_utc) AS last_created_utc,
          count(*) < 100 AS is_short,
          (SELECT count(*) FROM crowded c WHERE c.subreddit = r.subreddit AND c.page = r.page)
            AS full_seconds
        FROM ranked r GROUP BY subreddit, page""",
        _POSTS,
    ),
    "timespec_parse": _sql(
        "SELECT k, since, before AS until, since IS NOT NULL AS since_valid FROM fx_windows", _WINDOWS
    ),
    "request_windows": _sql(
        """SELECT k, since, before, coalesce(before > since, false) AS is_valid,
          CAST(floor((before - since) / 86400) AS BIGINT) AS days,
          CAST(DATE '1970-01-01' + CAST(floor(since / 86400) AS INTEGER) AS VARCHAR) AS since_date,
          CAST(DATE '1970-01-01' + CAST(floor(before / 86400) AS INTEGER) AS VARCHAR) AS before_date
        FROM fx_windows""",
        _WINDOWS,
    ),
    "expand_requests": _sql(
        """SELECT DISTINCT name AS subreddit, kind, since, before FROM (
          SELECT k, since, before, unnest(['a' || k % 97, 'b' || k % 89]) AS name FROM fx_windows
          WHERE before > since),
          (VALUES ('posts', 2), ('comments', 3), ('trees', 5), ('meta', 7)) AS kinds(kind, m)
        WHERE k % m = 0""",
        _WINDOWS,
    ),
    "thread_parents": _threads("SELECT subreddit, link_id, id, created_utc, parent FROM fx_parent"),
    "thread_orphans": _threads("SELECT subreddit, link_id, id, created_utc FROM fx_parent WHERE is_orphan"),
    "thread_nodes": _threads("SELECT * FROM fx_nodes"),
    "sibling_rank": _threads(
        """SELECT subreddit, link_id, id, created_utc, parent, row_number() OVER (
          PARTITION BY subreddit, link_id, parent ORDER BY created_utc, id) AS sibling FROM fx_parent"""
    ),
    "thread_unplaced": _threads("SELECT *, 'cycle' AS reason FROM fx_unplaced"),
    "thread_json": _threads(
        """, shaped AS (
          SELECT n.*, replace(c.archive_json, c.cut, '') AS archive_json, lag(n.depth) OVER w AS before, lead(n.depth) OVER w AS after
          FROM fx_nodes n JOIN fx_comments c USING (id)
          WINDOW w AS (PARTITION BY n.subreddit, n.link_id ORDER BY n.pos)),
        heads AS (
          SELECT DISTINCT subreddit, link_id,
            '{"link_id": "' || substr(link_id, 4) || '", "tree": [' AS head FROM fx_folded)
        SELECT subreddit, link_id, coalesce(pos, 1) AS pos,
          CASE WHEN pos IS NULL THEN head || ']}' || chr(10) ELSE
            CASE WHEN pos = 1 THEN head WHEN before >= depth THEN ', ' ELSE '' END
            || rtrim(archive_json, '}') || ', "replies": [' || repeat(']}', CAST(greatest(
              depth - coalesce(after, 0) + 1, 0) AS BIGINT))
            || CASE WHEN after IS NULL THEN ']}' || chr(10) ELSE '' END END AS text
        FROM heads LEFT JOIN shaped USING (subreddit, link_id)"""
    ),
    "thread_totals": _threads(
        """SELECT subreddit, CAST(grouping(subreddit) AS INTEGER) AS is_overall,
          count(DISTINCT link_id) AS posts_with_threads, count(*) AS comments_total,
          count(*) FILTER (id IN (SELECT id FROM fx_nodes)) AS comments_in_tree
        FROM fx_folded GROUP BY ROLLUP (subreddit)"""
    ),
    "thread_chains": """SELECT 'talk' AS subreddit, 't3_' || conv_id AS link_id,
          conv_id || '-' || turn AS id,
          CASE WHEN turn > first_turn THEN conv_id || '-' || (turn - 1) END AS parent,
          conv_id || '-' || first_turn AS root_id, CAST(turn - first_turn AS INTEGER) AS depth,
          turn - first_turn + 1 AS pos
        FROM (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS first_turn
          FROM (SELECT DISTINCT conv_id, turn FROM conversations))""",
    "parse_counts": _sql(
        """SELECT id, refreshed_at,
          CASE WHEN regexp_full_match(score_text, '-?[0-9]+') THEN TRY_CAST(score_text AS BIGINT) END AS score,
          coalesce(regexp_full_match(score_text, '--+[0-9]+'), false) AS score_broken,
          CASE WHEN regexp_full_match(comments_text, '[0-9]+')
            THEN TRY_CAST(comments_text AS BIGINT) END AS comments
        FROM fx_live""",
        _POSTS,
        _LIVE,
    ),
    "refresh_worklist": _sql(_WORK + " AND subreddit IN ('1-URGENT', '3-MEDIUM')", _POSTS),
    "refresh_topk": _sql(_WORK + " ORDER BY created_utc DESC, id DESC LIMIT 100", _POSTS),
    "refresh_outcome": _sql("SELECT * FROM fx_outcome", _POSTS, _LIVE, _OUTCOME),
    "refresh_totals": _sql(
        """SELECT subreddit, count(*) FILTER (outcome = 'refreshed') AS refreshed,
          count(*) FILTER (outcome = 'failed') AS failed, count(*) AS total
        FROM fx_outcome GROUP BY ROLLUP (subreddit)""",
        _POSTS,
        _LIVE,
        _OUTCOME,
    ),
    "merge_live_counts": _sql(
        """SELECT p.id, p.score,
          CASE WHEN o.outcome = 'refreshed' THEN o.live_score ELSE 7 END AS live_score,
          CASE WHEN o.outcome = 'refreshed' THEN o.live_num_comments ELSE 7 END AS live_num_comments,
          o.live_refreshed_at
        FROM fx_posts p LEFT JOIN fx_outcome o USING (id)""",
        _POSTS,
        _LIVE,
        _OUTCOME,
    ),
    "stats_overall": _sql(f"SELECT {_COUNTS} FROM {_TAGGED}", *_STORES),
    "stats_by_subreddit": _sql(
        f"SELECT lower(subreddit) AS subreddit, {_COUNTS} FROM {_TAGGED} GROUP BY 1", *_STORES
    ),
    "stats_rollup": _sql(
        f"""SELECT name AS subreddit, CAST(grouping(name) AS INTEGER) AS is_overall, {_COUNTS}
        FROM (SELECT *, lower(subreddit) AS name FROM {_TAGGED}) GROUP BY ROLLUP (name)""",
        *_STORES,
    ),
    "ingest_report": _sql(
        """SELECT lower(subreddit) AS subreddit, 'comments' AS kind, count(*) AS fetched,
          count(DISTINCT CASE WHEN k % 101 <> 0 THEN id END) AS distinct_ids,
          count(DISTINCT id) FILTER (k % 101 <> 0 AND id NOT IN (SELECT id FROM fx_stored)) AS new_rows
        FROM fx_raw GROUP BY 1
        UNION ALL SELECT lower(subreddit), 'posts', count(*), count(*), count(*) FROM fx_posts GROUP BY 1""",
        _POSTS,
        _COMMENTS,
    ),
    "late_records": _sql(
        """SELECT e.subreddit, count(*) AS n_late, min(e.created_utc) AS oldest
        FROM fx_events e JOIN (
          SELECT subreddit, max(created_utc) - 86400 AS until FROM fx_events WHERE value < 30 GROUP BY 1) v
          ON v.subreddit = e.subreddit AND e.created_utc < v.until
        WHERE e.value >= 30 GROUP BY 1""",
        _EVENTS,
    ),
    "strip_fullname": _sql(
        """SELECT k, CASE WHEN fullname <> '' THEN substr(fullname, strpos(fullname, '_') + 1) END AS bare
        FROM fx_names""",
        _NAMES,
    ),
    "parent_kind": _sql(
        "SELECT k, split_part(coalesce(fullname, ''), '_', 1) AS kind FROM fx_names", _NAMES
    ),
    "epoch_date": _sql(
        """SELECT id, CAST(DATE '1970-01-01' + CAST(floor(created_utc / 86400) AS INTEGER) AS VARCHAR) AS day,
          strftime(DATE '1970-01-01' + CAST(floor((created_utc - k * 400000) / 86400) AS INTEGER), '%Y-%m-%d')
            AS moved_day
        FROM fx_posts""",
        _POSTS,
    ),
    "json_path_default": _sql(
        """SELECT id, CASE WHEN k % 4 = 0 THEN json_extract_string(archive_json, '$.k') ELSE 'x' END AS found,
          CAST(NULL AS VARCHAR) AS missing FROM fx_events""",
        _EVENTS,
    ),
    "json_roundtrip": "SELECT conv_id, turn, role, text FROM conversations",
}
