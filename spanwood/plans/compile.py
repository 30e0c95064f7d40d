"""Path trees to DataFrame plans over the flattened node table.

A node set is a DataFrame of node rows with `seq`, an array whose order is the set's; it is a bag. Plans are plain
filters, equi-joins on (document, parent) and windows within a document, so Catalyst sees names, types and values as
ordinary predicates. Rewrites made here: a chain of names from the root is one filter on `path`; ``//name`` is a filter;
all children that a predicate names come from one grouped pass; positions are numbered only where a predicate asks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import DOCUMENT, NODES, kind_of
from . import values as V
from .syntax import ARITHMETIC, Attribute, Binary, Count, Fault, Filter, Literal, Merge, Not, PathError, Root, Step, parse

COLUMNS = NODES.fieldNames()
_KIND_COLUMNS = ("u", "i", "f", "s")


def select(nodes: DataFrame, path: str, strict_less: bool = False, kinds: dict[str, set[str]] | None = None) -> DataFrame:
    """The nodes that a path finds, with `seq`. Order by DOCUMENT and seq to have them in order.

    kinds: for names whose nodes' kinds of value are known, those kinds; the coercions of others aren't planned.
    """
    return _Plan(nodes, path, strict_less, kinds or {}).of(parse(path))


class _Plan:
    def __init__(self, nodes: DataFrame, path: str, strict_less: bool, kinds: dict[str, set[str]]):
        self.nodes, self.path, self.strict_less, self.kinds = nodes, path, strict_less, kinds
        self.own = set("uifs")  # kinds that @data may have in the predicate at hand

    def of(self, tree) -> DataFrame:
        match tree:
            case Root():
                return self._first(self.nodes.where("depth = 0"))
            case Step(None, "//", name):
                return self._first(self._named(self.nodes, name))
            case Step():
                chain = self._chain(tree)
                if chain:
                    return self._first(self._by_path(chain))
                return self._children(self.of(tree.left), tree.name)
            case Filter(left, expr):
                return self._filter(self.of(left), expr, left)
            case Merge("union", left, right):  # the right operand's nodes come first
                a, b = (self.of(x).withColumn("seq", F.concat(F.array(F.lit(i).cast("long")), "seq")) for i, x in ((0, right), (1, left)))
                return a.unionByName(b)
            case Merge("intersect", left, right):
                there = self.of(right).select(*DOCUMENT, "text").distinct()
                return self.of(left).join(there, [*DOCUMENT, "text"], "left_semi").select(*COLUMNS, "seq")
        raise PathError(f"can't plan {tree}")

    @staticmethod
    def _first(df: DataFrame) -> DataFrame:
        return df.withColumn("seq", F.array("node_id"))

    @staticmethod
    def _named(df: DataFrame, name: str) -> DataFrame:
        return df if name == "*" else df.where(F.col("name") == name)

    @staticmethod
    def _chain(tree) -> list[str] | None:
        names = []
        while isinstance(tree, Step) and tree.axis == "/":
            names.append(tree.name)
            if tree.left is None:
                return names[::-1]
            tree = tree.left
        return None

    def _by_path(self, chain: list[str]) -> DataFrame:
        out = self._named(self.nodes.where(F.col("depth") == len(chain) - 1), chain[-1])
        for i, name in enumerate(chain[:-1]):
            if name != "*":
                out = out.where(F.element_at("path", i + 1) == name)
        return out

    def _children(self, left: DataFrame, name: str) -> DataFrame:
        parents = left.select(*DOCUMENT, F.col("node_id").alias("parent_id"), F.col("seq").alias("above"))
        found = self._named(self.nodes, name).join(parents, [*DOCUMENT, "parent_id"])
        return found.select(*COLUMNS, F.concat("above", F.array("node_id")).alias("seq"))

    # predicates

    def _filter(self, df: DataFrame, expr, left) -> DataFrame:
        names = sorted(_words(expr))
        if names:
            df = self._with_children(df, names)
        counts = _counts(expr)
        whole = Window.partitionBy(*DOCUMENT)
        if "position" in counts or _numeric(expr):
            df = df.withColumn("at_", F.row_number().over(whole.orderBy("seq")).cast("decimal(20,0)"))
        if counts & {"last", "count"}:
            df = df.withColumn("of_", F.count("*").over(whole).cast("decimal(20,0)"))
        self.own = self._kinds_of(left)
        return df.where(self._top(expr)).select(*COLUMNS, "seq")

    def _kinds_of(self, tree) -> set[str]:
        match tree:
            case Step(_, _, name) if name != "*":
                return self.kinds.get(name, set("uifs"))
            case Filter(left):
                return self._kinds_of(left)
            case Merge("union", left, right):
                return self._kinds_of(left) | self._kinds_of(right)
            case Merge(_, left):
                return self._kinds_of(left)
        return set("uifs")

    def _with_children(self, df: DataFrame, names: list[str]) -> DataFrame:
        """The first child of each name as struct columns c_0, c_1, ..."""
        own = self.nodes.where(F.col("name").isin(names)).select(*DOCUMENT, F.col("parent_id").alias("of_parent"), "name", "child_ord", F.struct(kind_of(F.col("type")).alias("k"), *_KIND_COLUMNS).alias("v"))
        first = [F.min_by(F.when(F.col("name") == n, F.col("v")), F.when(F.col("name") == n, F.col("child_ord"))).alias(f"c_{i}") for i, n in enumerate(names)]
        found = own.groupBy(*DOCUMENT, "of_parent").agg(*first)
        self.children = {n: f"c_{i}" for i, n in enumerate(names)}
        return df.join(found.withColumnRenamed("of_parent", "node_id"), [*DOCUMENT, "node_id"], "left")

    def _fault(self, message: str, kind: str = "boolean") -> Column:
        text = message if message.startswith("invalid") or message.startswith("unparsed") else f'invalid predicate: {message} in "{self.path}"'
        return F.raise_error(F.lit(text)).cast(kind)

    def _top(self, e) -> Column:
        match e:
            case Fault(message):
                return self._fault(message)
            case Literal("b") | Not() | Binary() if _boolean(e):
                return self._test(e)
            case Literal("i") | Count() | Binary():
                return V.at_position(self._number(e), F.col("at_"))
            case Literal(_, _, shown):
                return self._fault(f"unrecognized token '{shown}'")
            case Attribute(name):
                return self._fault(f"unrecognized token '{name}'")
        raise PathError(f"can't plan {e}")

    def _test(self, e) -> Column:
        """A boolean operand."""
        match e:
            case Fault(message):
                return self._fault(message)
            case Literal("b", value):
                return F.lit(value)
            case Not(inner):
                return ~self._test(inner)
            case Binary("and", left, right):
                return self._test(left) & self._test(right)
            case Binary("or", left, right):
                return self._test(left) | self._test(right)
            case Binary("=" | "!=" as op, left, right):
                same = V.equal(self._operand(left), self._operand(right))
                return same if op == "=" else ~same
            case Binary("<" | "<=" | ">" | ">=" as op, left, right):
                l, r = self._comparable(left), self._comparable(right)
                out = V.ordered(l, r, op[0] == "<", self.strict_less)
                return out | V.equal(l, r) if op[1:] else out
            case Count(name) | Attribute(name):
                return self._fault(f"expect boolean, got '{name}'")
            case Literal(_, _, shown):
                return self._fault(f"expect boolean, got '{shown}'")
            case Binary(op):
                return self._fault(f"expect boolean, got '{op}'")
        raise PathError(f"can't plan {e}")

    def _comparable(self, e) -> V.Val:
        if isinstance(e, Literal) and e.kind == "b" or isinstance(e, Not) or isinstance(e, Binary) and _boolean(e):
            return V.Val({"s": self._fault(f"expected comparable type, got {getattr(e, 'op', getattr(e, 'shown', 'not'))}", "string")})
        return self._operand(e)

    def _operand(self, e) -> V.Val:
        """A value in a comparison; a bare word is the first child of that name, or else a string."""
        match e:
            case Literal("s", value):
                return V.Val({"s": V.text(value)})
            case Literal("word", value):
                return self._child(value, V.text(value))
            case Literal("b", value):
                return V.Val({"b": F.lit(value)})
            case Not() | Binary("=" | "!="):
                return V.Val({"b": self._test(e)})
            case Binary(op) if op not in ARITHMETIC:
                return V.Val({"b": self._fault(f"expected iEqualer type, got {op}")})
            case Attribute("name"):
                return V.Val({"s": F.col("name")})
            case Attribute("name_hex"):
                return V.Val({"s": F.format_string("0x%08X", "name_u32")})
            case Attribute("type"):
                return V.Val({"s": F.col("type")})
        return self._number(e)

    def _child(self, name: str, missing: Column) -> V.Val:
        c, kinds = F.col(self.children[name]), self.kinds.get(name, set("uifs"))
        columns = {k: c[k] for k in "uif" if k in kinds}
        columns["s"] = F.when(c.isNull(), missing).otherwise(c["s"]) if "s" in kinds else missing
        return V.Val(columns, F.coalesce(c["k"], F.lit("s")))

    def _number(self, e) -> V.Val:
        """A value in arithmetic."""
        match e:
            case Fault(message):
                return V.Val({"i": self._fault(message, "bigint")})
            case Literal("i", value):
                return V.Val({"i": F.lit(value).cast("bigint")})
            case Literal("f", value):
                return V.Val({"f": F.lit(value)})
            case Count(name):
                return V.Val({"u": F.col("at_" if name == "position" else "of_")})
            case Attribute("data"):
                kinds = {"u": F.col("u"), "i": F.col("i"), "f": F.col("f"), "s": F.col("s")}
                return V.Val({k: c for k, c in kinds.items() if k in self.own}, kind_of(F.col("type")))
            case Binary(op, left, right) if op in ARITHMETIC:
                return V.arithmetic(op, self._number(left), self._number(right))
            case Literal("word", value):
                bad = self._fault(f"expect number, got {value}", "string")
                out = self._child(value, bad)
                out.columns["s"] = bad
                return out
            case Literal() | Attribute():
                return V.Val({"i": self._fault("expected numeric value", "bigint")})
        return V.Val({"i": self._fault(f"expect number, got {getattr(e, 'op', 'not')}", "bigint")})


def _boolean(e) -> bool:
    return isinstance(e, Not) or isinstance(e, Literal) and e.kind == "b" or isinstance(e, Binary) and e.op not in ARITHMETIC


def _numeric(e) -> bool:
    """Whether a whole predicate is a number, which is then compared with the position."""
    return isinstance(e, Count) or isinstance(e, Literal) and e.kind == "i" or isinstance(e, Binary) and e.op in ARITHMETIC


def _parts(e) -> list:
    match e:
        case Not(inner):
            return [inner]
        case Binary(_, left, right):
            return [left, right]
    return []


def _words(e) -> set[str]:
    own = {e.value} if isinstance(e, Literal) and e.kind == "word" else set()
    return own.union(*map(_words, _parts(e)))


def _counts(e) -> set[str]:
    own = {e.name} if isinstance(e, Count) else set()
    return own.union(*map(_counts, _parts(e)))

