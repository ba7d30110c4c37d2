"""Registry, and the given tables seen as the business tables that the rules speak of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from auditlens.session import tune
from auditlens.sources.catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STATUS = "CASE l_linestatus WHEN 'F' THEN 'V' ELSE 'P' END"


@dataclass(frozen=True)
class Mapped:
    """A business table as a projection of a given one; the text is valid in both engines."""

    source: str
    columns: dict[str, str]
    where: str | None = None

    def sql(self) -> str:
        cells = ", ".join(f"{expr} AS {name}" for name, expr in self.columns.items())
        return f"SELECT {cells} FROM {self.source}" + (f" WHERE {self.where}" if self.where else "")


MAPPED: dict[str, Mapped] = {
    "dak": Mapped("orders", {
        "id": "o_orderkey", "list_date": "o_orderdate", "amount": "o_totalprice",
        "record_status": "o_orderstatus", "priority": "o_orderpriority", "fk_vendor": "o_custkey",
    }),
    "bill": Mapped("lineitem", {
        "fk_dak": "l_orderkey", "invoice_no": "l_partkey", "invoice_date": "l_shipdate",
        "record_status": STATUS, "amount": "l_extendedprice", "quantity": "l_quantity",
        "line": "l_linenumber",
    }),
    "cheque_slip": Mapped("lineitem", {
        "fk_dak": "l_orderkey", "record_status": STATUS, "approved": "l_returnflag = 'A'",
        "fk_ecs_payment_mode": "l_linenumber", "fk_aao": "nullif(l_suppkey % 5, 0)",
        "fk_ao": "nullif(l_suppkey % 3, 0)", "fk_auditor": "nullif(l_suppkey % 2, 0)",
        "amount": "l_extendedprice",
    }, "l_returnflag <> 'R'"),
    "schedule3": Mapped("lineitem", {
        "fk_dak": "l_orderkey", "record_status": "CASE l_linestatus WHEN 'F' THEN 'V' ELSE 'X' END",
        "schedule3_amount": "l_extendedprice",
    }, "l_returnflag = 'R'"),
    "ecs": Mapped("lineitem", {
        "fk_dak": "l_orderkey", "payment_reference_no": "l_orderkey",
    }, "l_returnflag = 'R'"),
    "cmp_scroll": Mapped("orders", {
        "payment_reference_no": "o_orderkey",
        "cda_name": "CASE o_orderpriority WHEN '1-URGENT' THEN 'CDA- Main Office Jabalpur' "
                    "ELSE 'Other office' END",
    }),
    "open_orders": Mapped("orders", {
        "id": "nullif(o_orderkey, 5)", "amount": "o_totalprice",
    }, "o_orderstatus <> 'F'"),
    # The result table: one anomaly candidate per order.
    "results": Mapped("orders", {
        "id": "o_orderkey",
        "selected_tables": "CASE o_orderpriority WHEN '1-URGENT' THEN 'dak.bill' "
                           "WHEN '2-HIGH' THEN 'dak.null.bill' WHEN '3-MEDIUM' THEN 'dak_info' "
                           "WHEN '5-LOW' THEN 'null' ELSE 'dak.cheque_slip.schedule3' END",
        "user_rule_name": "CASE WHEN o_totalprice > 450000 THEN 'RULE::Large_amount_of_payment' "
                          "WHEN o_totalprice > 400000 THEN 'duplicate  invoice' END",
        "user_rule": "o_totalprice > 400000",
        "isolation_rule": "o_orderstatus = 'F'",
        "ml_if_score": "o_totalprice / CAST(600000 AS DOUBLE)",
        "ml_threshold": "CAST(0.55 AS DOUBLE)",
        "ml_run_id": "CAST(year(o_orderdate) AS INT)",
        "fk_dak": "o_custkey",
        "feedback_score": "CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' "
                          "THEN 0.5 WHEN '3-MEDIUM' THEN 0.0 END AS DOUBLE)",
        "amount": "o_totalprice",
        "detected": "CAST(o_orderdate AS STRING)",
    }),
    "feedback_log": Mapped("events", {
        "record_id": "user_id", "at": "ts", "sequence": "event_id",
        "feedback": "CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' "
                    "WHEN 'view' THEN 'maybe' END",
    }, "event_type IN ('purchase', 'error', 'view')"),
}


class Tables:
    """Given and mapped tables of one scale factor, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        mapped = MAPPED.get(name)
        source = self.spark.read.parquet(f"{self.folder}/{mapped.source if mapped else name}.parquet")
        if mapped is None:
            return source
        kept = source.where(mapped.where) if mapped.where else source
        return kept.selectExpr(*[f"{expr} AS {n}" for n, expr in mapped.columns.items()])

    def catalog(self, *names: str, **renamed: str) -> Catalog:
        """Catalog of mapped tables; keywords give a table under another name."""
        return Catalog({**{n: getattr(self, n) for n in names},
                        **{alias: getattr(self, n) for alias, n in renamed.items()}})


def over(sql: str, *names: str, **more: str) -> str:
    """SQL with the named mapped tables, and further named subqueries, as its first CTEs."""
    parts = [f"{n} AS ({MAPPED[n].sql()})" for n in names]
    parts += [f"{n} AS ({text})" for n, text in more.items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"Query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
