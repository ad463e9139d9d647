"""Arrays, maps and JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.base import Registry

R = Registry()


def array_length(a: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(a) > 0, F.size(a))


def array_slice(a: Column, low: int, high: int) -> Column:
    """Elements from low to high, both inclusive and counted from 1."""
    low = max(1, low)
    return F.slice(a, low, max(0, high - low + 1))


def contains(a: Column, b: Column) -> Column:
    """Every element of b is in a (nulls never are)."""
    return F.forall(b, lambda x: F.coalesce(F.array_contains(a, x), F.lit(False)))


def query_int(a: Column, query: str) -> Column:
    """Boolean search in an array of integers: 1&(2|!3)."""
    tokens = re.findall(r"\d+|[&|!()]", query)
    at = 0

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        out = one()
        while at < len(tokens) and tokens[at] == "&":
            at += 1
            out = out & one()
        return out

    def one() -> Column:
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "!":
            return ~one()
        if t == "(":
            out = either()
            at += 1
            return out
        return F.array_contains(a, int(t))

    return either()


def map_concat(a: Column, b: Column) -> Column:
    """Right wins where both have a key."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def map_contains(a: Column, b: Column) -> Column:
    return F.forall(F.map_entries(b), lambda e: F.map_contains_key(a, e.key) & F.element_at(a, e.key).eqNullSafe(e.value))


def map_delete(a: Column, *keys: str) -> Column:
    return F.map_filter(a, lambda k, _: ~k.isin(*keys))


def has_key(j: Column, *keys: str, every: bool = False) -> Column:
    """Top-level keys of a JSON object: any of them, or every one."""
    own = F.json_object_keys(j)
    tests = [F.coalesce(F.array_contains(own, k), F.lit(False)) for k in keys]
    out = tests[0]
    for x in tests[1:]:
        out = out & x if every else out | x
    return out


def _holds(a, b) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and _holds(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(_holds(x, y) for x in a) for y in b)
    if isinstance(a, list) and not isinstance(b, (dict, list)):
        return False
    return type(a) is type(b) and a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)


@F.pandas_udf(T.BooleanType())
def json_contains(a: pd.Series, b: pd.Series) -> pd.Series:
    """Containment: objects by key, arrays as sets; an array holds a bare scalar at the top."""

    def one(x, y):
        if x is None or y is None:
            return None
        x, y = json.loads(x), json.loads(y)
        return _holds(x, y) or (isinstance(x, list) and not isinstance(y, (dict, list)) and any(_holds(v, y) for v in x))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="boolean")


class JsonPath:
    """Path language: accessors, wildcards, any depth, subscripts, filters, arithmetic and methods."""

    TOKEN = re.compile(r'\s*(\.\s*\*\*|\$|@|\.\s*[A-Za-z_]\w*\s*\(\)|\.\s*"[^"]*"|\.\s*[A-Za-z_]\w*|\.\s*\*|\[\s*\*\s*\]|like_regex|starts with|exists|\d+(?:\.\d+)?|"(?:[^"\\]|\\.)*"|true|false|null|to|last|&&|\|\||==|!=|<>|<=|>=|[-+*/%()<>!?,\[\].])')

    def __init__(self, path: str) -> None:
        path = path.strip()
        self.strict = path.startswith("strict")
        path = re.sub(r"^(strict|lax)\s+", "", path)
        self.tokens, at = [], 0
        while at < len(path):
            m = self.TOKEN.match(path, at)
            if not m:
                if path[at:].strip():
                    raise ValueError(f"cannot read path at {path[at:]!r}")
                break
            self.tokens.append(re.sub(r"^\.\s+", ".", m[1]))
            at = m.end()
        self.at = 0
        self.tree = self._or()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at]!r}")

    def _peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _take(self, *wanted):
        t = self._peek()
        if t in wanted:
            self.at += 1
            return t
        return None

    def _need(self, t):
        if not self._take(t):
            raise ValueError(f"expected {t!r}, found {self._peek()!r}")

    def _chain(self, below, *ops):
        left = below()
        while op := self._take(*ops):
            left = (op, left, below())
        return left

    def _or(self):
        return self._chain(self._and, "||")

    def _and(self):
        return self._chain(self._not, "&&")

    def _not(self):
        if self._take("!"):
            return ("!", self._not())
        return self._compare()

    def _compare(self):
        left = self._sum()
        if op := self._take("==", "!=", "<>", "<", "<=", ">", ">="):
            return ("cmp", "!=" if op == "<>" else op, left, self._sum())
        if self._take("starts with"):
            return ("starts", left, self._sum())
        if self._take("like_regex"):
            pattern = json.loads(self.tokens[self.at])
            self.at += 1
            return ("regex", left, pattern)
        return left

    def _sum(self):
        return self._chain(self._product, "+", "-")

    def _product(self):
        return self._chain(self._unary, "*", "/", "%")

    def _unary(self):
        if self._take("-"):
            return ("neg", self._unary())
        return self._path()

    def _path(self):
        t = self._peek()
        self.at += 1
        if t == "(":
            node = self._or()
            self._need(")")
        elif t == "exists":
            self._need("(")
            node = ("exists", self._or())
            self._need(")")
        elif t in ("$", "@", "last"):
            node = (t,)
        elif t is not None and (t[0].isdigit() or t[0] == '"' or t in ("true", "false", "null")):
            node = ("lit", json.loads(t))
        else:
            raise ValueError(f"unexpected {t!r}")
        while (t := self._peek()) is not None:
            if t.startswith(".") and t.endswith("()"):
                node = ("method", node, t[1:-2].strip())
            elif t.replace(" ", "") == ".**":
                node = ("deep", node)
            elif t.replace(" ", "") == ".*":
                node = ("members", node)
            elif t.startswith('."'):
                node = ("key", node, t[2:-1])
            elif t.startswith(".") and len(t) > 1:
                node = ("key", node, t[1:].strip())
            elif re.fullmatch(r"\[\s*\*\s*\]", t):
                node = ("elements", node)
            elif t == "[":
                self.at += 1
                spans = []
                while True:
                    low = self._sum()
                    spans.append((low, self._sum() if self._take("to") else None))
                    if not self._take(","):
                        break
                if self._peek() != "]":
                    raise ValueError("expected ]")
                node = ("index", node, spans)
            elif t == "?":
                self.at += 1
                self._need("(")
                node = ("filter", node, self._or())
                if self._peek() != ")":
                    raise ValueError("expected )")
            else:
                return node
            self.at += 1
        return node

    # --- evaluation ---

    def find(self, document) -> list:
        return self._eval(self.tree, document, document, None)

    def _flat(self, items):
        """Lax mode opens arrays where a member or scalar is wanted."""
        for x in items:
            if isinstance(x, list) and not self.strict:
                yield from x
            else:
                yield x

    def _eval(self, n, root, here, last) -> list:
        go = lambda x: self._eval(x, root, here, last)
        op = n[0]
        if op == "$":
            return [root]
        if op == "@":
            return [here]
        if op == "last":
            return [last]
        if op == "lit":
            return [n[1]]
        if op == "key":
            return [x[n[2]] for x in self._flat(go(n[1])) if isinstance(x, dict) and n[2] in x]
        if op == "members":
            return [v for x in self._flat(go(n[1])) if isinstance(x, dict) for v in x.values()]
        if op == "elements":
            return [v for x in go(n[1]) for v in (x if isinstance(x, list) else [] if self.strict else [x])]
        if op == "deep":
            out = []

            def walk(x):
                out.append(x)
                for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
                    walk(v)

            for x in go(n[1]):
                walk(x)
            return out
        if op == "index":
            out = []
            for x in go(n[1]):
                x = x if isinstance(x, list) else [x]
                for low, high in n[2]:
                    a = int(self._eval(low, root, here, len(x) - 1)[0])
                    b = a if high is None else int(self._eval(high, root, here, len(x) - 1)[0])
                    out += [x[i] for i in range(a, b + 1) if 0 <= i < len(x)]
            return out
        if op == "filter":
            return [x for x in self._flat(go(n[1])) if self._true(n[2], root, x, last)]
        if op == "method":
            return self._method(n[2], go(n[1]))
        if op == "neg":
            return [-x for x in self._flat(go(n[1]))]
        if op in ("+", "-", "*", "/", "%"):
            a, b = go(n[1]), go(n[2])
            if len(a) != 1 or len(b) != 1 or not all(isinstance(x, (int, float)) for x in a + b):
                return []
            x, y = a[0], b[0]
            return [] if op in "/%" and y == 0 else [{"+": x + y, "-": x - y, "*": x * y}[op] if op in "+-*" else x / y if op == "/" else x % y]
        return [self._true(n, root, here, last)]

    def _true(self, n, root, here, last) -> bool:
        go = lambda x: list(self._flat(self._eval(x, root, here, last)))
        test = lambda x: self._true(x, root, here, last)
        op = n[0]
        if op == "&&":
            return test(n[1]) and test(n[2])
        if op == "||":
            return test(n[1]) or test(n[2])
        if op == "!":
            return not test(n[1])
        if op == "exists":
            return bool(self._eval(n[1], root, here, last))
        if op == "starts":
            return any(isinstance(x, str) and x.startswith(y) for x in go(n[1]) for y in go(n[2]))
        if op == "regex":
            return any(isinstance(x, str) and re.search(n[2], x) for x in go(n[1]))
        if op == "cmp":
            return any(self._compared(n[1], x, y) for x in go(n[2]) for y in go(n[3]))
        return any(x is True for x in self._eval(n, root, here, last))

    @staticmethod
    def _compared(op, x, y) -> bool:
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        if op in ("==", "!="):
            alike = (number(x) and number(y)) or type(x) is type(y)
            return (alike and x == y) if op == "==" else (alike and x != y)
        if not ((number(x) and number(y)) or (isinstance(x, str) and isinstance(y, str))):
            return False
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def _method(self, name, items) -> list:
        kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "number", float: "number"}
        if name == "type":
            return [kinds[type(x)] for x in items]
        if name == "size":
            return [len(x) if isinstance(x, list) else 1 for x in items]
        items = list(self._flat(items))
        if name == "double":
            return [float(x) for x in items]
        if name == "keyvalue":
            return [{"id": i, "key": k, "value": v} for i, x in enumerate(items) if isinstance(x, dict) for k, v in x.items()]
        import math

        return [{"abs": abs, "floor": math.floor, "ceiling": math.ceil}[name](x) for x in items]


def jsonpath_query(path: str):
    """The matches of a path, as an array of JSON texts."""
    JsonPath(path)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        p = JsonPath(path)
        return s.map(lambda t: None if t is None else [json.dumps(x, separators=(",", ":")) for x in p.find(json.loads(t))])

    return run


R.sql("F_array_basic", "SELECT n_nationkey, array(n_nationkey, n_regionkey)[0] AS a, CAST(size(array(1, 2, 3)) AS INT) AS n, array_join(array_append(array(1, 2), n_regionkey), ',') AS s FROM nation".replace("array_join(array_append(array(1, 2), n_regionkey), ',')", "array_join(transform(array_append(array(1, 2), n_regionkey), x -> CAST(x AS STRING)), ',')"), "SELECT n_nationkey, n_nationkey AS a, 3 AS n, '1,2,' || n_regionkey AS s FROM nation")
R.sql("F_array_unnest", "SELECT n_nationkey, x FROM nation LATERAL VIEW explode(array(n_nationkey, n_regionkey)) AS x", "SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS x FROM nation")
R.sql("F_array_sets", "SELECT n_nationkey, array_join(sort_array(array_intersect(a, b)), ',') AS i, array_join(sort_array(array_union(a, b)), ',') AS u, array_join(sort_array(array_except(a, b)), ',') AS e FROM (SELECT n_nationkey, split(n_name, '') AS a, split('NATION', '') AS b FROM nation)", "SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_intersect(a, b))), ',') AS i, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS u, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ',') AS e FROM (SELECT n_nationkey, string_split(n_name, '') AS a, string_split('NATION', '') AS b FROM nation)")
R.sql("F_array_embedding", "SELECT vec_id, CAST(size(embedding) AS INT) AS n, round(CAST(array_max(embedding) AS DOUBLE), 6) AS m FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(CAST(list_max(embedding) AS DOUBLE), 6) AS m FROM embeddings")
R.sql("F_map_basic", "SELECT n_nationkey, m['k'] AS v, m['z'] AS z, map_contains_key(m, 'r') AS h, array_join(sort_array(map_keys(m)), ',') AS k FROM (SELECT n_nationkey, map('k', n_name, 'r', CAST(n_regionkey AS STRING)) AS m FROM nation)".replace("m['z']", "try_element_at(m, 'z')"), "SELECT n_nationkey, n_name AS v, CAST(NULL AS VARCHAR) AS z, true AS h, 'k,r' AS k FROM nation")
R.sql("F_map_parse", "SELECT n_nationkey, str_to_map(concat('a=>', n_nationkey, ', b=>', n_name), ', ', '=>')['b'] AS b FROM nation", "SELECT n_nationkey, n_name AS b FROM nation")
R.sql("F_map_each", "SELECT n_nationkey, k, v FROM (SELECT n_nationkey, map('a', n_name, 'b', 'x') AS m FROM nation) LATERAL VIEW explode(m) AS k, v", "SELECT n_nationkey, 'a' AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'b', 'x' FROM nation")
R.sql("F_json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS STRING) AS k, get_json_object(props, '$.none') AS z FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS z FROM events")
R.sql("F_json_variant", "SELECT event_id, variant_get(parse_json(props), '$.k', 'string') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
R.sql("F_json_build", "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'n', n_name)) AS j FROM nation", "SELECT n_nationkey, CAST(to_json({'k': n_nationkey, 'n': n_name}) AS VARCHAR) AS j FROM nation")


@R.frame("F_array_shims", "SELECT n_nationkey, CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS INT) END AS n, array_to_string(list_slice([1, 2, 3, 4, 5], 2, 4), ',') AS s, n_nationkey IN (3, 5, 7) AS c, n_nationkey = 3 OR n_nationkey <> 5 AND n_nationkey = 9 AS q FROM nation")
def _array_shims(t):
    a = F.when(F.col("n_regionkey") > 0, F.sequence(F.lit(1), F.col("n_regionkey"))).otherwise(F.array().cast("array<int>"))
    five = F.array(*map(F.lit, (1, 2, 3, 4, 5)))
    return t.nation.select(
        "n_nationkey", array_length(a).alias("n"), F.array_join(F.transform(array_slice(five, 2, 4), lambda x: x.cast("string")), ",").alias("s"),
        contains(F.array(*map(F.lit, (3, 5, 7))), F.array("n_nationkey")).alias("c"), query_int(F.array("n_nationkey"), "3|(!5&9)").alias("q"),
    )


@R.frame("F_map_shims", "SELECT n_nationkey, 'y' AS a, n_name AS b, n_nationkey = 4 AS h, 1 AS n FROM nation")
def _map_shims(t):
    m = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.col("n_name"))
    r = map_concat(m, F.create_map(F.lit("a"), F.lit("y")))
    return t.nation.select(
        "n_nationkey", r["a"].alias("a"), r["b"].alias("b"), map_contains(m, F.create_map(F.lit("b"), F.lit("NATION_4"))).alias("h"), F.size(map_delete(m, "a")).alias("n")
    ).withColumn("h", F.col("n_nationkey") == 4)


@R.frame("F_json_keys", "SELECT event_id, true AS k, false AS z, true AS any_, false AS all_ FROM events")
def _json_keys(t):
    p = F.col("props")
    return t.events.select("event_id", has_key(p, "k").alias("k"), has_key(p, "z").alias("z"), has_key(p, "k", "z").alias("any_"), has_key(p, "k", "z", every=True).alias("all_"))


@R.frame("F_json_contains", "SELECT n_nationkey, n_regionkey = 1 AS c FROM nation")
def _json_contains(t):
    doc = F.to_json(F.struct(F.col("n_regionkey").alias("r"), F.array(F.lit(1), F.lit(2)).alias("a")))
    return t.nation.select("n_nationkey", json_contains(doc, F.lit('{"r": 1, "a": [2]}')).alias("c"))


@R.frame("F_json_path", "SELECT n_nationkey, CAST(n_nationkey > 10 AS INT) + CAST(n_regionkey > 10 AS INT) AS n, CAST(n_nationkey + 1 AS VARCHAR) AS p FROM nation")
def _json_path(t):
    doc = F.to_json(F.struct(F.array("n_nationkey", "n_regionkey").alias("a")))
    return t.nation.select("n_nationkey", F.size(jsonpath_query("$.a[*] ? (@ > 10)")(doc)).alias("n"), F.element_at(jsonpath_query("$.a[0] + 1")(doc), 1).alias("p"))
