"""The same views as common table expressions for DuckDB."""

from __future__ import annotations

from ..sources.projection import FORMATS, INVERSE

_case = lambda column, mapping: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"

VIEWS = {
    "list_entry": """SELECT user_id, item_id, score, status, rated_at FROM (
        SELECT o_custkey AS user_id, l_partkey AS item_id, CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(ceil(l_quantity / 5) AS INTEGER) END AS score,
               CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linestatus = 'F') THEN 'completed' WHEN l_returnflag = 'R' THEN 'dropped' WHEN l_linestatus = 'F' THEN 'on_hold' ELSE 'plan_to_watch' END AS status,
               l_shipdate AS rated_at, row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1""",
    "rated": "SELECT * FROM list_entry WHERE score > 0",
    "item": f"""SELECT p_partkey AS item_id, p_name AS title, p_brand AS studio, {_case('p_type', FORMATS)} AS media_type, string_split(p_name, ' ') AS genres, 1960 + p_size AS season_year, p_size AS num_episodes,
        make_date(1960 + p_size, CAST(p_partkey % 12 + 1 AS INTEGER), 1) AS start_date,
        CASE WHEN make_date(1960 + p_size, CAST(p_partkey % 12 + 1 AS INTEGER), 1) <= DATE '2002-01-01' THEN 'finished_airing' ELSE 'not_yet_aired' END AS status,
        CASE WHEN p_partkey % 13 = 0 THEN 'black' ELSE 'white' END AS nsfw FROM part""",
    "item_stats": """SELECT *, row_number() OVER (ORDER BY members DESC, item_id) AS popularity FROM (
        SELECT item_id, count(*) AS members, count(*) FILTER (WHERE score > 0) AS scorers, avg(score) FILTER (WHERE score > 0) AS mean FROM list_entry GROUP BY item_id)""",
    "links": """SELECT src, dst, CASE WHEN dst % 5 = 0 THEN 'side_story' WHEN dst % 7 = 0 THEN 'spin_off' ELSE 'sequel' END AS relation_type FROM (
        SELECT p_partkey AS src, lead(p_partkey) OVER (PARTITION BY p_brand, p_partkey % 6 ORDER BY p_partkey) AS dst FROM part) WHERE dst IS NOT NULL""",
    "relation": f"SELECT * FROM links UNION ALL SELECT dst, src, {_case('relation_type', INVERSE)} FROM links",
    "prequel": "SELECT src AS item_id, dst AS prequel_id FROM relation WHERE relation_type = 'prequel'",
    "rec_edge": """SELECT src, dst, votes, sqrt(votes) * votes / sum(votes) OVER (PARTITION BY src) AS weight FROM (
        SELECT a.p AS src, b.p AS dst, count(*) AS votes FROM (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem) b USING (l_orderkey)
        WHERE a.p <> b.p GROUP BY 1, 2)""",
    "item_staff": "SELECT DISTINCT l_partkey AS item_id, l_suppkey AS staff_id FROM lineitem",
    "ev": "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events",
    "feedback": "SELECT user_id, item_id, CASE event_type WHEN 'error' THEN 'not_interested' ELSE 'queued' END AS action, ts AS created_at FROM ev WHERE event_type IN ('error', 'purchase')",
    "rec_log": "SELECT event_id AS log_id, user_id, CASE WHEN item_id % 2 = 0 THEN 'safe_bets' ELSE 'discover' END AS surface, item_id, item_id % 50 + 1 AS rank, value AS predicted, ts AS shown_at FROM ev WHERE event_type = 'view'",
    "list_event": "SELECT user_id, item_id, list_extract(['plan_to_watch', 'watching', 'completed', 'dropped'], item_id % 4 + 1) AS status, CAST(event_id % 11 AS INTEGER) AS score, ts AS at_ts FROM ev WHERE event_type IN ('click', 'signup')",
    "tag_vector": "SELECT vec_id AS item_id, embedding AS vec, label FROM embeddings",
    "weighted": "SELECT *, 0.05 + 0.95 * pow(0.5, greatest((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(rated_at)) / 1e6 / 31557600, 0) / 0.5) AS w FROM rated",
    "user_mean": "SELECT user_id, sum(score * w) / nullif(sum(w), 0) AS mu, count(*) AS n FROM weighted GROUP BY user_id",
}
NEEDS = {
    "rated": ["list_entry"], "item_stats": ["list_entry"], "relation": ["links"], "prequel": ["relation"], "feedback": ["ev"], "rec_log": ["ev"], "list_event": ["ev"], "weighted": ["rated"], "user_mean": ["weighted"],
}


def oracle(body: str, *views: str, **extra: str) -> str:
    """A query over the named views, with further expressions of its own, in the order given."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        out.setdefault(name, VIEWS[name])

    for v in views:
        add(v)
    out |= extra
    return ("WITH " + ",\n".join(f"{k} AS ({v})" for k, v in out.items()) + "\n" if out else "") + body
