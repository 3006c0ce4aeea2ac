"""Registry of named queries, each with an equivalent SQL text where SQL can express it, and the
domain views (tenders, budget lines, source runs) the queries see over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deltion.functions.text import WS
from deltion.session import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]

# Domain views in SQL both engines read; {name} stands for a given table.
VIEWS = {
    # Notices: an order is a tender of a customer's authority; the priority tells the source.
    "tenders": """
        SELECT o_orderkey AS tender_no, source, source = 'ESHIDIS' AS official,
          CASE WHEN source = 'ESHIDIS' THEN id WHEN source = 'KIMDIS' THEN 'KIMDIS:' || id ELSE 'AUTHORITY:' || id END AS row_key,
          id AS official_id, CASE WHEN source = 'ESHIDIS' THEN id END AS registry_id,
          CASE WHEN source = 'ESHIDIS' THEN CAST(NULL AS STRING) ELSE CAST(o_orderkey - o_orderkey % 5 AS STRING) END AS linked_id,
          CASE WHEN source = 'ESHIDIS' THEN 'ESHIDIS' WHEN o_orderstatus = 'F' THEN 'PROC' WHEN o_orderstatus = 'O' THEN 'AWRD' ELSE 'SYMV' END AS record_type,
          c_mktsegment || ' works at site ' || CAST(o_custkey % 40 AS STRING) AS title, n_name || ' municipality' AS authority, r_name AS place,
          CAST(o_totalprice AS DECIMAL(18,2)) AS budget, day AS deadline_iso,
          substr(day, 9, 2) || '-' || substr(day, 6, 2) || '-' || substr(day, 1, 4) AS deadline,
          o_custkey AS customer_no, o_orderstatus AS order_status, c_mktsegment AS segment, o_orderpriority AS priority
        FROM (SELECT *, CAST(o_orderkey AS STRING) AS id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day,
            CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'ESHIDIS' WHEN o_orderpriority = '3-MEDIUM' THEN 'KIMDIS' ELSE 'AUTHORITY' END AS source
          FROM {orders}) o
        JOIN {customer} c ON o_custkey = c_custkey JOIN {nation} n ON c_nationkey = n_nationkey JOIN {region} r ON n_regionkey = r_regionkey""",
    # Budget lines: the order is the project, the supplier the document, some prices do not add up.
    "lines": """
        SELECT l_orderkey AS project, l_linenumber AS row_number, l_suppkey AS document_no,
          CASE l_suppkey % 5 WHEN 0 THEN 'ΠΡΟΥΠΟΛΟΓΙΣΜΟΣ ' WHEN 1 THEN 'Οικονομική προσφορά ' WHEN 2 THEN 'Τεχνική έκθεση ' WHEN 3 THEN 'Τιμολόγιο ' ELSE 'Σχέδιο ' END
            || CAST(l_suppkey AS STRING) || '.pdf' AS source_document,
          'Β-' || CAST(l_partkey % 90 + 10 AS STRING) || '.' || CAST(l_linenumber AS STRING) AS article_code, p_name AS description,
          CASE WHEN l_returnflag = 'N' THEN CAST(NULL AS STRING) ELSE 'm' || CAST(l_partkey % 2 + 2 AS STRING) END AS unit,
          CAST(l_quantity AS DECIMAL(24,6)) AS quantity,
          CAST(CASE WHEN l_discount > 0.09 THEN NULL ELSE FLOOR(l_extendedprice / l_quantity * CASE WHEN l_returnflag = 'R' THEN 150 ELSE 100 END) / 100 END AS DECIMAL(24,6)) AS unit_price,
          CAST(l_extendedprice AS DECIMAL(24,6)) AS amount, CASE WHEN l_linestatus = 'O' THEN 0.9 ELSE 0.7 END AS confidence,
          CAST(l_partkey AS BIGINT) * 100000000 + CAST(FLOOR(l_extendedprice * 100 + 0.5) AS BIGINT) AS line_id, l_partkey AS part_no, l_returnflag AS flag
        FROM {lineitem} l JOIN {part} p ON l_partkey = p_partkey""",
    # Source checks: a user is a source, an error event a failed check.
    "runs": """
        SELECT event_id AS run_no, 'src' || CAST(user_id AS STRING) AS source_id, event_type AS family, ts, value,
          CAST(FLOOR(value * 100 + 0.5) AS BIGINT) AS cents, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'SKIPPED_UNCHANGED' ELSE 'CHANGED' END AS status,
          CASE WHEN event_type = 'error' THEN 'timeout' END AS error, CAST(CAST(ts AS DATE) AS STRING) AS day, user_id, props
        FROM {events}""",
    # Labels of documents with a triage decision.
    "triage": """
        SELECT doc_id, quality, toxic,
          CASE WHEN toxic = 1 THEN 'DROP_ADMIN' WHEN quality = 1 AND doc_id % 3 = 0 THEN 'KEEP_ACTIVE_TENDER' WHEN quality = 1 THEN 'REVIEW_TENDER_CANDIDATE'
            WHEN doc_id % 2 = 0 THEN 'DROP_NOT_PUBLIC_WORKS' ELSE 'DROP_OUT_OF_SCOPE_SUPPLY_SERVICE' END AS decision,
          CAST((doc_id % 10) AS DOUBLE) / 10 AS confidence, quality = 1 AND toxic = 0 AS keep
        FROM {labels}""",
}

_USES = {name: [t for t in TABLES if "{" + t + "}" in sql] for name, sql in VIEWS.items()}


class Tables:
    """Lazy access to the given tables and the domain views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.spark.sql(VIEWS[name], **{t: getattr(self, t) for t in _USES[name]})
        if name in TABLES:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(table) if name in ("documents", "pages") else table
        raise AttributeError(name)

    def sql(self, text: str, **extra: DataFrame) -> DataFrame:
        """Input preparation in SQL; {name} refers to a table, a view or an extra frame."""
        names = [n for n in [*TABLES, *VIEWS] if "{" + n + "}" in text and n not in extra]
        return self.spark.sql(text, **{n: getattr(self, n) for n in names}, **extra)


def cte(*names: str) -> str:
    """WITH clause of the domain views for the SQL side."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in _USES[n]})})" for n in names)


def plain(text: str) -> str:
    """The SQL side of an input prepared with `Tables.sql`."""
    return text.format(**{n: n for n in [*TABLES, *VIEWS]})


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(t: Tables) -> DataFrame` under a name, with its SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


# SQL spellings of the text functions.


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_chars(x: str) -> str:
    return f"replace(strip_accents(lower({x})), 'ς', 'σ')"


def sql_fold(x: str) -> str:
    return sql_clean(sql_chars(x))


def sql_hits(h: str, terms, labels=None, sep: str = ",") -> str:
    """Joined list of the terms a folded expression contains, in order."""
    parts = ", ".join(f"CASE WHEN contains({h}, '{t}') THEN '{name}' END" for t, name in zip(terms, labels or terms))
    return f"concat_ws('{sep}', {parts})"


def sql_any(h: str, terms) -> str:
    return "(" + " OR ".join(f"contains({h}, '{t}')" for t in terms) + ")"
