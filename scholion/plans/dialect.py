"""One query text, two engines: the few spellings in which Spark SQL and DuckDB differ."""


class Spark:
    name = "spark"

    def s(self, pattern):
        return f"r'{pattern}'"

    def ra(self, x, pattern, to):
        return f"regexp_replace({x}, {self.s(pattern)}, '{to}')"

    def rx(self, x, pattern, group=0):
        return f"regexp_extract({x}, {self.s(pattern)}, {group})"

    def rxall(self, x, pattern):
        return f"regexp_extract_all({x}, {self.s(pattern)}, 0)"

    def has(self, x, pattern):
        return f"regexp_like({x}, {self.s(pattern)})"

    def tail(self, x, chars):
        return f"trim(trailing '{chars}' from {x})"

    def map(self, x, var, e):
        return f"transform({x}, {var} -> {e})"

    def keep(self, x, var, e):
        return f"filter({x}, {var} -> {e})"

    def any(self, x, var, e):
        return f"exists({x}, {var} -> {e})"

    def explode(self, x):
        return f"explode({x})"

    def pos(self, table, x, cols="pos, item"):
        return f"{table} lateral view posexplode({x}) pe as {cols}"

    def at(self, x, i):
        return f"element_at({x}, {i})"

    def split(self, x, sep):
        return f"split({x}, {self.s(sep)})"

    def join(self, x, sep):
        return f"array_join({x}, '{sep}')"

    def size(self, x):
        return f"size({x})"

    def arr(self, *x):
        return f"array({', '.join(x)})"

    def cut(self, x, a, n):
        return f"slice({x}, {a}, {n})"

    def seq(self, a, b):
        return f"sequence({a}, {b})"

    def sha(self, x):
        return f"sha2({x}, 256)"

    def both(self, a, b):
        return f"array_intersect({a}, {b})"

    def union(self, a, b):
        return f"array_union({a}, {b})"

    def distinct(self, x):
        return f"array_distinct({x})"

    def listagg(self, x, order):
        key = order.removesuffix(" desc")
        inner = f"array_sort(collect_list(struct({key} as k, {x} as v)))"
        return f"transform({'reverse(' if order.endswith(' desc') else ''}{inner}{')' if order.endswith(' desc') else ''}, s -> s.v)"

    def int(self, x):
        return f"try_cast({x} as int)"

    def count_if(self, x):
        return f"count_if({x})"

    def any_true(self, x):
        return f"bool_or({x})"

    def min_by(self, a, b):
        return f"min_by({a}, {b})"

    def cat(self, a, b):
        return f"concat({a}, {b})"


class Duck(Spark):
    name = "duckdb"

    def s(self, pattern):
        return f"'{pattern}'"

    def ra(self, x, pattern, to):
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    def rxall(self, x, pattern):
        return f"regexp_extract_all({x}, '{pattern}')"

    def has(self, x, pattern):
        return f"regexp_matches({x}, '{pattern}')"

    def tail(self, x, chars):
        return f"rtrim({x}, '{chars}')"

    def map(self, x, var, e):
        return f"list_transform({x}, lambda {var}: {e})"

    def keep(self, x, var, e):
        return f"list_filter({x}, lambda {var}: {e})"

    def any(self, x, var, e):
        return f"(len(list_filter({x}, lambda {var}: {e})) > 0)"

    def explode(self, x):
        return f"unnest({x})"

    def pos(self, table, x, cols="pos, item"):
        a, b = (c.strip() for c in cols.split(","))
        return f"(select *, unnest(range(len({x}))) as {a}, unnest({x}) as {b} from {table})"

    def at(self, x, i):
        return f"list_extract({x}, {i})"

    def split(self, x, sep):
        return f"regexp_split_to_array({x}, '{sep}')"

    def join(self, x, sep):
        return f"array_to_string({x}, '{sep}')"

    def size(self, x):
        return f"cast(len({x}) as int)"

    def arr(self, *x):
        return f"[{', '.join(x)}]"

    def cut(self, x, a, n):
        return f"list_slice({x}, {a}, ({a}) + ({n}) - 1)"

    def seq(self, a, b):
        return f"range({a}, ({b}) + 1)"

    def sha(self, x):
        return f"sha256({x})"

    def both(self, a, b):
        return f"list_intersect({a}, {b})"

    def union(self, a, b):
        return f"list_distinct(list_concat({a}, {b}))"

    def distinct(self, x):
        return f"list_distinct({x})"

    def listagg(self, x, order):
        return f"list({x} order by {order})"

    def count_if(self, x):
        return f"cast(count(*) filter (where {x}) as bigint)"

    def min_by(self, a, b):
        return f"arg_min({a}, {b})"


SPARK, DUCK = Spark(), Duck()
