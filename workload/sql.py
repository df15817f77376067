"""Conformance queries over the given tables, in Spark SQL and in the check's dialect.

A plain string serves both; a pair holds the Spark text and the other one.
"""

SQL = {
    "sql_list_customers": "SELECT * FROM customer",
    "sql_orders_for_customer": "SELECT * FROM orders WHERE o_custkey = 5",
    "sql_expensive_parts": "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice > 950",
    "sql_or_filter": """
        SELECT p_partkey, p_name, p_size FROM part
        WHERE p_size >= 45 OR p_retailprice >= 990 OR p_type = 'ECONOMY'""",
    "sql_fk_join": """
        SELECT n_name, count(*) AS n_lines,
               CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
        FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name""",
    # Every nation with every segment, also where no customer is. The customers are
    # counted first, so what is joined is nations times segments.
    "sql_cross_left_count": (
        """
        WITH counts AS (
          SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2
        )
        SELECT n_name, s.c_mktsegment AS segment, coalesce(n, 0) AS n_customers
        FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM counts) s
        LEFT JOIN counts c ON c.c_nationkey = n_nationkey AND c.c_mktsegment = s.c_mktsegment""",
        """
        SELECT n_name, s.c_mktsegment AS segment, count(c.c_custkey) AS n_customers
        FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s
        LEFT JOIN customer c ON c.c_nationkey = n_nationkey AND c.c_mktsegment = s.c_mktsegment
        GROUP BY n_name, s.c_mktsegment""",
    ),
    "sql_semi": """
        SELECT c_custkey, c_name FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    "sql_anti": """
        SELECT c_custkey, c_name FROM customer
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    # The ranges are one row per order priority, so the other side is never moved.
    "sql_range_join": """
        WITH bands AS (
          SELECT o_orderpriority AS band, min(o_totalprice) AS lo, (min(o_totalprice) + max(o_totalprice)) / 2 AS hi
          FROM orders GROUP BY o_orderpriority
        )
        SELECT band, count(*) AS n_orders, min(o_totalprice) AS lowest, max(o_totalprice) AS highest
        FROM orders JOIN bands ON o_totalprice >= lo AND o_totalprice < hi
        GROUP BY band""",
    "sql_group_having": """
        SELECT l_suppkey, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts,
               max(l_extendedprice) AS dearest
        FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10""",
    "sql_top3_per_group": """
        SELECT * FROM (
          SELECT o_custkey, o_orderkey, o_totalprice,
                 CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS place
          FROM orders) ranked
        WHERE place <= 3""",
    "sql_top_k": """
        SELECT o_orderkey, o_totalprice FROM orders
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5""",
    "sql_set_ops": """
        (SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier)
        INTERSECT
        (SELECT n_nationkey FROM nation EXCEPT SELECT r_regionkey FROM region)""",
    "sql_cte": """
        WITH spent AS (
          SELECT o_custkey, max(o_totalprice) AS dearest FROM orders GROUP BY o_custkey
        )
        SELECT c_custkey, dearest,
               (SELECT max(dearest) FROM spent) AS dearest_of_all,
               (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders
        FROM customer JOIN spent ON o_custkey = c_custkey""",
    "sql_scalars": (
        """
        SELECT o_orderkey, upper(substr(o_orderpriority, 3)) AS priority, CAST(length(o_orderpriority) AS BIGINT) AS n,
               o_orderstatus || '-' || CAST(o_custkey AS STRING) AS tag,
               CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
               date_format(o_orderdate, 'yyyy-MM-dd') AS day,
               CAST(floor(o_totalprice / 7) AS DOUBLE) AS seventh, abs(o_totalprice - 1000) AS off,
               CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 1000 THEN 'mid' ELSE 'low' END AS band,
               coalesce(nullif(o_orderstatus, 'O'), 'open') AS state
        FROM orders""",
        """
        SELECT o_orderkey, upper(substr(o_orderpriority, 3)) AS priority, CAST(length(o_orderpriority) AS BIGINT) AS n,
               o_orderstatus || '-' || CAST(o_custkey AS VARCHAR) AS tag,
               CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
               strftime(o_orderdate, '%Y-%m-%d') AS day,
               CAST(floor(o_totalprice / 7) AS DOUBLE) AS seventh, abs(o_totalprice - 1000) AS off,
               CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 1000 THEN 'mid' ELSE 'low' END AS band,
               coalesce(nullif(o_orderstatus, 'O'), 'open') AS state
        FROM orders""",
    ),
    "sql_json": (
        """
        SELECT event_type, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, count(*) AS n
        FROM events GROUP BY 1, 2""",
        """
        SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n
        FROM events GROUP BY 1, 2""",
    ),
    "execute_query": (
        """
        WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
        SELECT c_mktsegment, sum(n) AS n_orders FROM big JOIN customer ON c_custkey = o_custkey
        GROUP BY c_mktsegment;
        """,
        """
        SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n_orders
        FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""",
    ),
}


def spark_sql(key: str) -> str:
    text = SQL[key]
    return text if isinstance(text, str) else text[0]


def check_sql(key: str) -> str:
    text = SQL[key]
    return text if isinstance(text, str) else text[1]
