"""What a query may reach: an allow-list over its parsed tree.

Texts that a model writes from users' questions are not to be trusted. Before anything of such a
text is resolved, since resolving a file already reads it, its parsed tree is walked node by node,
through every field: only known kinds of plan nodes and expressions may stand there, relations must be
tables and views that the session knows, and routines those built into Spark, without the ones
that call other code, or registered in the session by name. A name made by ``IDENTIFIER`` is
looked at like any other if it is a text, and refused if it would have to be computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

from py4j.java_gateway import JavaObject
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

# The plan nodes of queries as they are parsed.
PLANS = frozenset(
    """
    Project Filter Aggregate Sort Join LateralJoin Union Intersect Except Distinct Deduplicate
    GlobalLimit LocalLimit Offset SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedInlineTable
    ResolvedInlineTable LocalRelation UnresolvedRelation UnresolvedTableValuedFunction
    UnresolvedTVFAliases UnresolvedWith UnresolvedHaving UnresolvedHint WithWindowDefinition
    Generate Pivot Unpivot OneRowRelation Sample PipeOperator PlanWithUnresolvedIdentifier
    """.split()
)

# Expressions of the parser that are not resolved yet.
UNRESOLVED = frozenset(
    """
    UnresolvedAttribute UnresolvedFunction UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedAlias UnresolvedExtractValue
    UnresolvedRegex UnresolvedOrdinal UnresolvedSubqueryColumnAliases UnresolvedGenerator
    UnresolvedInlineTable UnresolvedWindowExpression MultiAlias GetViewColumnByNameAndOrdinal
    ExpressionWithUnresolvedIdentifier UnresolvedCollation UnresolvedDatetimeLiteral
    """.split()
)

# Expressions that call other code, and functions that make them.
CALLS = frozenset("CallMethodViaReflection ScalaUDF PythonUDF PythonUDAF PythonUDTF Invoke StaticInvoke NewInstance".split())
REFLECTION = frozenset("java_method reflect try_reflect".split())

# Functions that may stand in FROM.
TABLE_FUNCTIONS = frozenset(
    "range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer".split()
)

_EXPRESSIONS = ("org.apache.spark.sql.catalyst.expressions.", "org.apache.spark.sql.catalyst.expressions.aggregate.")
_TYPES = "org.apache.spark.sql.types."
_EMPTY = "scala.collection.immutable.Nil$"


class RefusedQuery(PySparkException):
    """A text that is a query but reaches beyond the tables."""

    def __init__(self, reason: str) -> None:
        super().__init__(message=f"Refused: {reason}")


class _Kind(NamedTuple):
    """What is known of a class of the objects in a plan."""

    name: str
    simple_name: str
    is_iterable: bool
    is_node: bool
    is_plan: bool
    n_fields: int


class _Tree:
    """The nodes of a parsed plan, seen from Python, where every look at an object is a message to the JVM."""

    kinds: dict[str, _Kind] = {}

    def __init__(self, spark: SparkSession) -> None:
        self.spark, jvm = spark, spark._jvm
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()

        def named(name: str) -> JavaObject:
            return loader.loadClass(name)

        self.node = named("org.apache.spark.sql.catalyst.trees.TreeNode")
        self.plan = named("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
        self.iterable, self.product = named("scala.collection.Iterable"), named("scala.Product")
        self.parser = spark._jsparkSession.sessionState().sqlParser()
        self.builtin = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        self.identifier = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def kind(self, found: JavaObject) -> _Kind:
        """All that an object's class says, asked once for each class."""
        own = found.getClass()
        name = own.getName()
        if name not in self.kinds:
            is_iterable = self.iterable.isInstance(found)
            n_fields = found.productArity() if not is_iterable and self.product.isInstance(found) else 0
            is_node = not is_iterable and self.node.isInstance(found)
            self.kinds[name] = _Kind(name, own.getSimpleName().rstrip("$"), is_iterable, is_node, self.plan.isInstance(found), n_fields)
        return self.kinds[name]

    def nodes(self, root: JavaObject) -> Iterator[tuple[JavaObject, _Kind]]:
        """All nodes, plans and expressions, that a plan holds in any of its fields."""
        waiting: list[Any] = [root]
        while waiting:
            found = waiting.pop()
            if not isinstance(found, JavaObject):
                continue
            kind = self.kind(found)
            if kind.name.startswith(_TYPES) or kind.name == _EMPTY:
                continue
            if kind.is_iterable:
                waiting += _items(found.iterator())
            else:
                if kind.is_node:
                    yield found, kind
                waiting += [found.productElement(i) for i in range(kind.n_fields)]

    def is_builtin(self, name: str) -> bool:
        return self.builtin.functionExists(self.identifier(name, self.spark._jvm.scala.Option.empty()))

    def parts(self, name: str) -> list[str]:
        return _items(self.parser.parseMultipartIdentifier(name).iterator())


def _items(iterator: JavaObject) -> list[Any]:
    found = []
    while iterator.hasNext():
        found.append(iterator.next())
    return found


def _quoted(parts: list[str]) -> str:
    return ".".join("`%s`" % part.replace("`", "``") for part in parts)


def _check_relation(tree: _Tree, parts: list[str]) -> None:
    """A name of several parts that the session does not know could only be a path."""
    if len(parts) > 1 and not tree.spark.catalog.tableExists(_quoted(parts)):
        raise RefusedQuery(f"no table {_quoted(parts)}.")


def _check_function(tree: _Tree, parts: list[str]) -> None:
    name = parts[-1].lower()
    if name in REFLECTION:
        raise RefusedQuery("it calls code by reflection.")
    if len(parts) > 1 or not (tree.is_builtin(name) or tree.spark.catalog.functionExists(name)):
        raise RefusedQuery(f"no function {_quoted(parts)}.")


def _written_name(tree: _Tree, node: JavaObject) -> list[str]:
    """The parts of a name given as a text to IDENTIFIER."""
    given = node.identifierExpr()
    if given.getClass().getSimpleName() != "Literal" or given.value() is None:
        raise RefusedQuery("it computes a name.")
    return tree.parts(given.value().toString() if isinstance(given.value(), JavaObject) else str(given.value()))


def _check_plan(tree: _Tree, node: JavaObject, kind: str) -> None:
    if kind not in PLANS:
        raise RefusedQuery("it runs a command." if kind == "ScriptTransformation" else f"{kind} has no place in a query.")
    if kind == "UnresolvedRelation":
        if node.isStreaming():
            raise RefusedQuery("it reads a stream.")
        _check_relation(tree, _items(node.multipartIdentifier().iterator()))
    elif kind == "UnresolvedTableValuedFunction":
        parts = _items(node.name().iterator())
        if len(parts) > 1 or parts[0].lower() not in TABLE_FUNCTIONS:
            raise RefusedQuery(f"no table function {_quoted(parts)}.")
    elif kind == "PlanWithUnresolvedIdentifier":
        parts = _written_name(tree, node)
        is_known = tree.spark.catalog.tableExists(_quoted(parts)) or (len(parts) == 1 and parts[0].lower() in TABLE_FUNCTIONS)
        if not is_known:
            raise RefusedQuery(f"no table {_quoted(parts)}.")


def _check_expression(tree: _Tree, node: JavaObject, name: str, kind: str) -> None:
    package = name.rstrip("$")[: -len(kind)]
    if kind in CALLS or not (package in _EXPRESSIONS or kind in UNRESOLVED):
        raise RefusedQuery(f"{kind} has no place in a query.")
    if kind == "UnresolvedFunction":
        _check_function(tree, _items(node.nameParts().iterator()))
    elif kind == "ExpressionWithUnresolvedIdentifier":
        # a column or a function: what could be a function must be one that may be called
        parts = _written_name(tree, node)
        last = parts[-1].lower()
        if last in REFLECTION or tree.is_builtin(last) or tree.spark.catalog.functionExists(_quoted(parts)):
            _check_function(tree, parts)


def refuse_unknown(spark: SparkSession, text: str) -> None:
    """Fail for a query that reaches beyond the session's tables and Spark's own functions.

    Settings and variables of the machine, which a text can name in ``${..}``, are put in its place
    before it is parsed, so such a text is refused while that is switched on.
    """
    if "${" in text and spark.conf.get("spark.sql.variable.substitute", "true").lower() == "true":
        raise RefusedQuery("it names a setting.")
    tree = _Tree(spark)
    for node, kind in tree.nodes(tree.parser.parsePlan(text)):
        if kind.is_plan:
            _check_plan(tree, node, kind.simple_name)
        else:
            _check_expression(tree, node, kind.name, kind.simple_name)


def relations(spark: SparkSession, text: str) -> set[str]:
    """The names, in lower case, of the tables that a query names by one word."""
    tree = _Tree(spark)
    named = [
        _items(node.multipartIdentifier().iterator())
        for node, kind in tree.nodes(tree.parser.parsePlan(text))
        if kind.is_plan and kind.simple_name == "UnresolvedRelation"
    ]
    return {parts[0].lower() for parts in named if len(parts) == 1}
