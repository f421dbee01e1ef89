"""SQL text of the adapters."""

from .base import cte

cte("slog0", """
SELECT l_suppkey, year(l_shipdate)::INT AS season, month(l_shipdate)::INT AS period,
  floor(sum(CAST(floor(l_extendedprice*(1-l_discount)*10000+0.5) AS BIGINT))/10000000.0*64+0.5)/64.0 AS value,
  floor(sum(CAST(floor(l_extendedprice*(1-l_discount)*(1-l_tax)*10000+0.5) AS BIGINT))/10000000.0*64+0.5)/64.0 AS value_base,
  sum(CASE WHEN l_returnflag='A' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS attempts,
  sum(CASE WHEN l_returnflag='A' AND l_linestatus='F' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS completions,
  sum(CASE WHEN l_returnflag='A' THEN floor(l_extendedprice/100)::BIGINT ELSE 0 END)::BIGINT AS passing_yards,
  count(*) FILTER (l_returnflag='A' AND l_quantity>=45) AS passing_tds,
  count(*) FILTER (l_returnflag='A' AND l_quantity<=2) AS interceptions,
  count(*) FILTER (l_returnflag='A' AND l_linenumber=7) AS sacks_taken,
  count(*) FILTER (l_returnflag='A' AND l_discount<CAST(0.02 AS DOUBLE)) AS sack_fumbles_lost,
  sum(CASE WHEN l_returnflag='A' THEN l_linenumber ELSE 0 END)::BIGINT AS passing_air_yards,
  count(*) FILTER (l_returnflag='A' AND l_quantity>=25) AS passing_first_downs,
  count(*) FILTER (l_returnflag='A' AND l_quantity=50) AS passing_2pt,
  sum(CASE WHEN l_returnflag='N' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS carries,
  sum(CASE WHEN l_returnflag='N' THEN floor(l_extendedprice/100)::BIGINT ELSE 0 END)::BIGINT AS rushing_yards,
  count(*) FILTER (l_returnflag='N' AND l_quantity>=45) AS rushing_tds,
  count(*) FILTER (l_returnflag='N' AND l_discount<CAST(0.02 AS DOUBLE)) AS rushing_fumbles_lost,
  count(*) FILTER (l_returnflag='N' AND l_quantity>=25) AS rushing_first_downs,
  count(*) FILTER (l_returnflag='N' AND l_quantity=50) AS rushing_2pt,
  sum(CASE WHEN l_returnflag='R' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS targets,
  count(*) FILTER (l_returnflag='R' AND l_linestatus='F') AS receptions,
  sum(CASE WHEN l_returnflag='R' THEN floor(l_extendedprice/100)::BIGINT ELSE 0 END)::BIGINT AS receiving_yards,
  count(*) FILTER (l_returnflag='R' AND l_quantity>=45) AS receiving_tds,
  count(*) FILTER (l_returnflag='R' AND l_discount<CAST(0.02 AS DOUBLE)) AS receiving_fumbles_lost,
  sum(CASE WHEN l_returnflag='R' THEN l_linenumber ELSE 0 END)::BIGINT AS receiving_air_yards,
  sum(CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN l_linenumber ELSE 0 END)::BIGINT AS receiving_yac,
  count(*) FILTER (l_returnflag='R' AND l_quantity>=25) AS receiving_first_downs,
  count(*) FILTER (l_returnflag='R' AND l_quantity=50) AS receiving_2pt,
  count(*) FILTER (l_linenumber=1 AND l_quantity=50) AS special_teams_tds
FROM lineitem GROUP BY ALL""")

cte("smet", """
SELECT l_suppkey, season, period, opponent FROM (
  SELECT l_suppkey, season, period, n_name AS opponent,
    row_number() OVER (PARTITION BY l_suppkey, season, period ORDER BY count(*) DESC, n_name DESC) AS rn
  FROM (SELECT *, year(l_shipdate)::INT AS season, month(l_shipdate)::INT AS period FROM lineitem)
  JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
  JOIN nation ON c_nationkey=n_nationkey
  GROUP BY l_suppkey, season, period, n_name) WHERE rn=1""")

cte("slog", """
SELECT s_suppkey AS entity, s_name AS entity_name, r_name AS grp, n_name AS team, opponent,
  CASE WHEN attempts+carries+targets=0 THEN NULL
       ELSE targets::DOUBLE/(attempts+carries+targets) END AS target_share, slog0.*
FROM slog0 JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey
JOIN region ON n_regionkey=r_regionkey
LEFT JOIN smet ON smet.l_suppkey=slog0.l_suppkey AND smet.season=slog0.season
  AND smet.period=slog0.period""")

cte("cust", """
SELECT c_custkey AS entity, c_name AS entity_name, c_mktsegment AS grp, n_name AS team,
  c_acctbal AS acctbal FROM customer JOIN nation ON c_nationkey=n_nationkey""")

cte("cseason", """
SELECT cust.entity, entity_name, grp, team, season, value, value AS value_base, games FROM cust JOIN (
  SELECT o_custkey AS entity, year(o_orderdate)::INT AS season,
    floor(sum(CAST(floor(o_totalprice*10000+0.5) AS BIGINT))/10000000.0*64+0.5)/64.0 AS value,
    count(DISTINCT month(o_orderdate)) AS games
  FROM orders GROUP BY ALL) t ON t.entity=cust.entity""")

cte("clog", """
SELECT cust.entity, entity_name, grp, team, season, period, value, n_orders AS orders FROM cust JOIN (
  SELECT o_custkey AS entity, year(o_orderdate)::INT AS season, month(o_orderdate)::INT AS period,
    floor(sum(CAST(floor(o_totalprice*10000+0.5) AS BIGINT))/10000000.0*64+0.5)/64.0 AS value,
    count(*) AS n_orders
  FROM orders GROUP BY ALL) t ON t.entity=cust.entity""")

cte("ulog", """
SELECT user_id AS entity, (user_id % 4)::INT AS grp, weekofyear(ts)::INT AS season,
  isodow(ts)::INT AS period,
  floor(sum(CAST(floor(value*10000+0.5) AS BIGINT))*1000/10000000.0*64+0.5)/64.0 AS value,
  count(*) FILTER (event_type='click') AS click, count(*) FILTER (event_type='error') AS error,
  count(*) FILTER (event_type='purchase') AS purchase,
  count(*) FILTER (event_type='signup') AS signup, count(*) FILTER (event_type='view') AS "view"
FROM events GROUP BY ALL""")

cte("orec", """
SELECT o_custkey AS entity, o_orderkey AS record, o_orderdate::DATE AS as_of_date,
  substr(o_orderpriority,1,1)::INT AS rank, o_totalprice AS amount, o_orderstatus AS status
FROM orders""")

cte("plays", """
SELECT CASE WHEN l_returnflag='R' THEN l_suppkey END AS receiver_id,
  CASE WHEN l_returnflag<>'R' THEN l_suppkey END AS rusher_id, year(l_shipdate)::INT AS season,
  n_name AS team, l_quantity AS air_yards, floor(l_discount*1000+0.5) AS yardline_100,
  floor(l_tax*64) AS pass_oe
FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey""")
