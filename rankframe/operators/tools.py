"""The interactive tool layer over tables, graphs and texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankframe.functions.arithmetic import calculate

#: Rows that an observation can show: it has room for as many characters.
SHOWN = 3000
#: Numbers the rows of a loaded table as they come.
ROW = "__row"
OPERATORS = (">=", "<=", ">", "<", "=")
HELP = "Invalid Action. Valid actions are Calculate, RetrieveAgenda, RetrieveScirex, LoadDB, FilterDB, GetValue, LoadGraph, NeighbourCheck, NodeCheck, EdgeCheck, SQLInterpreter and Finish."


def as_strings(df: DataFrame) -> DataFrame:
    """Every column a string; a missing value is ``nan``."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in df.columns])


def unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'" else value


def parse_condition(clause: str) -> tuple[str, str, str] | None:
    """Column (kept as written), operator and value of a clause; None without an operator."""
    for op in OPERATORS:
        if op in clause:
            column, value = clause.split(op, 1)
            return column, op, unquoted(value)
    return None


def condition(clause: str) -> Column | None:
    """String comparison of a clause as a column."""
    parsed = parse_condition(clause)
    if parsed is None:
        return None
    column, op, value = parsed
    left, right = F.col(f"`{column}`"), F.lit(value)
    return {">=": left >= right, "<=": left <= right, ">": left > right, "<": left < right, "=": left == right}[op]


def filter_db(df: DataFrame, argument: str) -> tuple[DataFrame, str]:
    """Apply ``c1, c2, ...`` one after another. A clause that leaves nothing undoes the whole
    call; an unknown column keeps what was filtered so far; a clause without an operator does
    nothing. Only emptiness is asked of Spark on the way."""
    now = df
    for clause in argument.split(", "):
        parsed = parse_condition(clause)
        if parsed is not None:
            if parsed[0] not in now.columns:
                return now, f"We have failed when conducting the {clause} command. Please make changes."
            now = now.filter(condition(clause))
        if now.isEmpty():
            return df, f"The filtering query {clause} is incorrect. Please modify the condition."
    return now, f"We have successfully filtered the data ({now.count()} rows)."


def get_value(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """``value``: the column's values in order, joined by commas."""
    values = F.collect_list(F.struct(F.col(order or column).alias("o"), F.col(column).cast("string").alias("v")))
    return df.agg(F.array_join(F.transform(F.array_sort(values), lambda x: x["v"]), ", ").alias("value"))


def values_by(df: DataFrame, key: str, column: str, order: str | None = None) -> DataFrame:
    """``key, value``: the same for every value of ``key``."""
    values = F.collect_list(F.struct(F.col(order or column).alias("o"), F.col(column).cast("string").alias("v")))
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(values), lambda x: x["v"]), ", ").alias("value"))


def rewrite_sql(sql: str) -> str:
    """Dotted table names (``x.y_data``) become the names of the registered views."""
    return re.sub(r"\b(\w+)\.\w+_data\b", r"\1_data", sql)


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(rewrite_sql(sql))


def formatted_rows(df: DataFrame) -> DataFrame:
    """``row``: ``column: value`` pairs of each row."""
    return df.select(F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None"))) for c in df.columns]).alias("row"))


def neighbours(nodes: DataFrame, edges: DataFrame, name: str | None = None) -> DataFrame:
    """``name, neighbour`` over undirected edges, of one node or of all."""
    both = edges.select("graph", "src", "dst").union(edges.select("graph", F.col("dst"), F.col("src"))).distinct()
    start = nodes if name is None else nodes.filter(F.col("name") == name)
    start = start.select("graph", F.col("id").alias("src"), F.col("name"))
    return both.join(start, ["graph", "src"]).join(nodes.select("graph", F.col("id").alias("dst"), F.col("name").alias("neighbour")), ["graph", "dst"]).select("graph", "name", "neighbour")


def node_attributes(nodes: DataFrame, graph: str | None = None, name: str | None = None) -> DataFrame:
    """``graph, name, attrs`` of one node, of a graph's nodes, or of all."""
    if graph is not None:
        nodes = nodes.filter(F.col("graph") == graph)
    if name is not None:
        nodes = nodes.filter(F.col("name") == name)
    return nodes.select("graph", "name", "attrs")


def edges_between(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``graph, a, b, attrs`` of the edges between named nodes ``asked(graph, a, b)``,
    whichever way they were stored."""
    ids = nodes.select("graph", "name", "id")
    ends = asked.join(ids.withColumnsRenamed({"name": "a", "id": "src"}), ["graph", "a"]).join(ids.withColumnsRenamed({"name": "b", "id": "dst"}), ["graph", "b"])
    both = edges.select("graph", "src", "dst", "attrs").union(edges.select("graph", F.col("dst"), F.col("src"), "attrs"))
    return ends.join(both, ["graph", "src", "dst"]).select("graph", "a", "b", "attrs")


def edge_attributes(nodes: DataFrame, edges: DataFrame, graph: str, a: str, b: str) -> DataFrame:
    """Attributes of the edge between two named nodes."""
    asked = nodes.sparkSession.createDataFrame([(graph, a, b)], "graph string, a string, b string")
    return edges_between(nodes, edges, asked).select("a", "b", "attrs").limit(1)


def titled_papers(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges whose ``papers`` array of ids becomes an array of titles in the same order. ``papers(id, title)``."""
    each = rows.select("a", "b", F.posexplode("papers").alias("i", "id")).join(papers, "id")
    titles = F.transform(F.array_sort(F.collect_list(F.struct("i", "title"))), lambda x: x["title"])
    return each.groupBy("a", "b").agg(titles.alias("papers"))


class ToolSession:
    """One conversation with the tools: dispatches ``Type[argument]`` and gives an observation.

    ``load(name)`` returns a table, ``graph(name)`` its ``(nodes, edges)``, ``retrieve(name,
    question)`` a text. Code execution isn't offered.
    """

    def __init__(self, spark: SparkSession, load: Callable[[str], DataFrame], graph: Callable[[str], tuple[DataFrame, DataFrame]] | None = None, retrieve: Callable[[str, str], str] | None = None):
        self.spark, self._load, self._graph, self._retrieve = spark, load, graph, retrieve
        self._views: set[str] = set()
        self.reset()

    def reset(self) -> None:
        """Forget the table and the graph; registered SQL views stay."""
        self.table: DataFrame | None = None
        self.net: tuple[DataFrame, DataFrame] | None = None

    def execute(self, action: str | None) -> str:
        if not action or not action.strip():
            return "Your action is empty. Please take the action again."
        if "], " in action:
            return "You are sending multiple actions at once. Please send one action at a time."
        m = re.match(r"(?s)^(\w+)\[(.+)\]$", action.strip())
        run = getattr(self, f"_do_{m[1].lower()}", None) if m else None
        if run is None:
            return HELP
        try:
            return run(m[2])
        except Exception as e:  # an observation reports what went wrong
            return f"Error executing {m[1]}: {e}"

    def _do_finish(self, argument: str) -> str:
        return argument

    def _do_calculate(self, argument: str) -> str:
        return calculate(argument)

    def _do_loaddb(self, name: str) -> str:
        table = as_strings(self._load(name))
        self.table = table.withColumn(ROW, F.monotonically_increasing_id())
        if name not in self._views:
            table.createOrReplaceTempView(f"{name}_data")
            self._views.add(name)
        return f"We have successfully loaded the {name} database, including the following columns: {', '.join(table.columns)}."

    def _do_filterdb(self, argument: str) -> str:
        self.table, said = filter_db(self.table, argument)
        return said

    # an observation keeps 3,000 characters, so no more rows than that are asked for

    def _do_getvalue(self, column: str) -> str:
        rows = self.table.select(ROW, F.col(f"`{column}`").cast("string").alias("v")).orderBy(ROW).limit(SHOWN).collect()
        return ", ".join(r["v"] for r in rows if r["v"] is not None)

    def _do_sqlinterpreter(self, sql: str) -> str:
        return "\n".join(r["row"] for r in formatted_rows(run_sql(self.spark, sql)).limit(SHOWN).collect())

    def _do_loadgraph(self, name: str) -> str:
        if name != "dblp" or self._graph is None:
            raise ValueError(f"unknown graph {name}")
        self.net = self._graph(name)
        return "DBLP data is loaded, including two graphs: AuthorNet and PaperNet."

    def _do_neighbourcheck(self, argument: str) -> str:
        graph, name = argument.split(", ", 1)
        nodes, edges = self.net
        rows = neighbours(nodes.filter(F.col("graph") == graph), edges.filter(F.col("graph") == graph), name)
        return str([r["neighbour"] for r in rows.select("neighbour").orderBy("neighbour").limit(SHOWN).collect()])

    def _do_nodecheck(self, argument: str) -> str:
        return str(node_attributes(self.net[0], *argument.split(", ", 1)).first()["attrs"])

    def _do_edgecheck(self, argument: str) -> str:
        return str(edge_attributes(*self.net, *argument.split(", ", 2)).first()["attrs"])

    def _do_retrieveagenda(self, question: str) -> str:
        return self._retrieve("agenda", question)

    def _do_retrievescirex(self, question: str) -> str:
        return self._retrieve("scirex", question)
