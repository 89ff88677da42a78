"""A read-only SQL surface over registered tables: Spark parses a statement, and only queries pass."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from tessella.session import TABLES, table

#: Nodes that a query may consist of; whatever else a statement holds, at any depth, is refused.
_QUERY_NODES = frozenset(
    """
    Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join LateralJoin AsOfJoin Union Intersect Except Distinct SubqueryAlias
    UnresolvedRelation UnresolvedWith UnresolvedInlineTable LocalRelation OneRowRelation Generate UnresolvedHaving
    UnresolvedSubqueryColumnAliases WithWindowDefinition Window UnresolvedTableValuedFunction Pivot UnresolvedPivot Unpivot
    UnresolvedHint RepartitionByExpression Repartition Sample ResolvedInlineTable UnresolvedTVFAliases
    """.split()
)
_SHOWS = re.compile(r"ShowTables|ShowTablesCommand|ShowColumns|ShowColumnsCommand|DescribeRelation|DescribeColumn|DescribeQueryCommand|ShowNamespaces")
_SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")
#: Functions that run code of the machine.
_FUNCTIONS = {"java_method", "reflect", "try_reflect"}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_ON_FILES = "spark.sql.runSQLOnFiles"


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check(spark: SparkSession, plan) -> None:
    """Raise unless the parsed statement is a query throughout: its nodes, those in WITH and in subqueries, its functions.
    A name of several parts must be a table of the catalog: any other may be a data source and a path."""
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name not in _QUERY_NODES:
            raise ValueError(f"only queries are allowed, not {name}")
        todo += _items(node.children())
        if name == "UnresolvedWith":
            todo += _items(node.innerChildren())
        if name == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            if len(parts) > 1 and not spark.catalog.tableExists(".".join("`" + x.replace("`", "``") + "`" for x in parts)):
                raise ValueError(f"{'.'.join(parts)} is no table of the catalog")
        expressions = _items(node.expressions())
        while expressions:
            e = expressions.pop()
            kind = e.getClass().getSimpleName()
            if kind in _SUBQUERIES:
                todo.append(e.plan())
            elif kind == "UnresolvedFunction" and _items(e.nameParts())[-1].lower() in _FUNCTIONS:
                raise ValueError("a function that runs code of the machine")
            elif kind in ("CallMethodViaReflection", "TryReflect"):
                raise ValueError("a function that runs code of the machine")
            expressions += _items(e.children())


def validated(spark: SparkSession, statement: str) -> str:
    """The statement without its last semicolon, if it is one query, explains one, or shows or describes something; else a ValueError."""
    text = statement.strip().rstrip(";").strip()
    if not text:
        raise ValueError("an empty statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise ValueError(f"not one statement of SQL: {e}") from e
    except Exception as e:
        raise ValueError(f"not one statement of SQL: {str(e).splitlines()[0]}") from e
    kind = plan.getClass().getSimpleName()
    if kind == "ExplainCommand":
        _check(spark, plan.logicalPlan())
    elif not _SHOWS.fullmatch(kind):
        _check(spark, plan)
    return text


def attach(spark: SparkSession, sf_dir: str) -> None:
    """The tables below a folder as temporary views."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def run(spark: SparkSession, statement: str) -> DataFrame:
    """The lazy result of a validated statement. No path is a table while Spark looks its names up."""
    text, before = validated(spark, statement), spark.conf.get(_ON_FILES)
    spark.conf.set(_ON_FILES, "false")
    try:
        return spark.sql(text)
    finally:
        spark.conf.set(_ON_FILES, before)


def run_limited(spark: SparkSession, statement: str, seconds: int = 60, rows: int = 50) -> list:
    """At most ``rows`` rows; jobs that take longer than 1 to 600 seconds are cancelled by their tag."""
    import threading

    tag = f"sql-{uuid.uuid4().hex}"
    timer = threading.Timer(min(600, max(1, seconds)), lambda: spark.interruptTag(tag))
    spark.addTag(tag)
    timer.start()
    try:
        return run(spark, statement).limit(rows).collect()
    finally:
        timer.cancel()
        spark.removeTag(tag)


def formatted(columns: list[str], rows: list, width: int = 50, most_chars: int = 10_000) -> str:
    """A markdown table; cells are cut at ``width``, and rows end with the budget of characters."""
    cell = lambda v: (s if len(s := str(v).replace("\n", " ").replace("|", "\\|")) <= width else s[: width - 3] + "...")
    out = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    size = sum(map(len, out))
    for i, row in enumerate(rows):
        line = "| " + " | ".join(cell(v) for v in row) + " |"
        if size + len(line) > most_chars:
            out.append(f"({len(rows) - i} more rows)")
            break
        out.append(line)
        size += len(line)
    return "\n".join(out)


def describe(spark: SparkSession, name: str) -> DataFrame:
    """(name, type, nullable) of a table's columns."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no table name")
    fields = spark.table(name).schema.fields
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in fields], "name string, type string, nullable boolean")
