"""One query text for two engines: Spark, which runs it, and DuckDB, which checks it.

The engines differ in a few function names and in how they write strings; a Dialect hides that, and the
base tables (tokens, shingles, ...) are built by each engine in its own way.
"""

from __future__ import annotations

import re


class Dialect:
    spark = False

    def t(self, name: str) -> str:
        """A table or base table."""
        return name

    def lit(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def rr(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(re.sub(r'[$](\d)', lambda m: chr(92) + m[1], by))}, 'g')"

    def rcount(self, x: str, pattern: str) -> str:
        return f"len(regexp_extract_all({x}, {self.lit(pattern)}))"

    def rlike(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def rx(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def rall(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)})"

    def size(self, x: str) -> str:
        return f"len({x})"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def h60(self, x: str) -> str:
        """60 bits of md5, equal in both engines."""
        return f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def agg_text(self, x: str, sep: str, order: str) -> str:
        return f"string_agg({x}, {self.lit(sep)} ORDER BY {order})"

    def explode(self, array: str) -> str:
        return f"unnest({array})"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.lit(sep)})"

    def at(self, array: str, i: int) -> str:
        """The i-th entry, from 1; null if there is none."""
        return f"list_extract({array}, {i})"

    def concat_arrays(self, a: str, b: str) -> str:
        return f"list_concat({a}, {b})"

    def explode_with(self, keep: str, array: str, item: str, number: str) -> str:
        """SELECT of keep, one entry of the array a row, and its number, from 0; a FROM follows."""
        return f"SELECT {keep}, unnest({array}) AS {item}, generate_subscripts({array}, 1) - 1 AS {number}"

    def filter(self, array: str, x: str, test: str) -> str:
        return f"list_filter({array}, lambda {x}: {test})"

    def transform(self, array: str, x: str, to: str) -> str:
        return f"list_transform({array}, lambda {x}: {to})"

    def slice(self, array: str, start: str, size: str) -> str:
        """size entries from the start-th (from 1) on."""
        return f"list_slice({array}, {start}, {start} + {size} - 1)"

    def entry(self, array: str, i: str) -> str:
        """The i-th entry, from 1; null if there is none."""
        return f"list_extract({array}, {i})"

    def total(self, array: str) -> str:
        return f"coalesce(list_sum({array}), 0)"

    def distinct(self, array: str) -> str:
        return f"list_distinct({array})"

    def sorted(self, array: str) -> str:
        return f"list_sort({array})"

    def flat(self, array: str) -> str:
        return f"flatten({array})"

    def hold(self, x: str, name: str) -> str:
        """x AS name, worked out once a row: one engine would otherwise work it out again wherever a lambda uses it."""
        return f"{x} AS {name}"

    def numbers(self, a: str, b: str) -> str:
        """a to b; none if b is less."""
        return f"generate_series(CAST({a} AS INT), CAST({b} AS INT))"

    def row(self, **fields: str) -> str:
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + ")"

    def join(self, array: str, sep: str) -> str:
        return f"array_to_string({array}, {self.lit(sep)})"

    def list_(self, *items: str) -> str:
        return "[" + ", ".join(items) + "]"

    def series(self, a: str, b: str) -> str:
        return f"generate_series({a}, {b})"

    def ts(self, x: str) -> str:
        return f"epoch({x})"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '$.{path}')"


class SparkDialect(Dialect):
    spark = True

    def t(self, name: str) -> str:
        return f"fs_{name}"

    def lit(self, text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def rr(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)})"

    def rcount(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, {self.lit(pattern)})"

    def rlike(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.lit(pattern)})"

    def rall(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, 0)"

    def size(self, x: str) -> str:
        return f"size({x})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def h60(self, x: str) -> str:
        return f"CAST(conv(substring(md5({x}), 1, 15), 16, 10) AS BIGINT)"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def agg_text(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, {self.lit(sep)}) WITHIN GROUP (ORDER BY {order})"

    def explode(self, array: str) -> str:
        return f"explode({array})"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit(re.escape(sep))})"

    def at(self, array: str, i: int) -> str:
        return f"get({array}, {i - 1})"

    def concat_arrays(self, a: str, b: str) -> str:
        return f"concat({a}, {b})"

    def explode_with(self, keep: str, array: str, item: str, number: str) -> str:
        return f"SELECT {keep}, posexplode({array}) AS ({number}, {item})"

    def filter(self, array: str, x: str, test: str) -> str:
        return f"filter({array}, {x} -> {test})"

    def transform(self, array: str, x: str, to: str) -> str:
        return f"transform({array}, {x} -> {to})"

    def slice(self, array: str, start: str, size: str) -> str:
        return f"slice({array}, {start}, {size})"

    def entry(self, array: str, i: str) -> str:
        return f"get({array}, {i} - 1)"

    def total(self, array: str) -> str:
        return f"aggregate({array}, CAST(0 AS DOUBLE), (s_, x_) -> s_ + x_)"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})"

    def hold(self, x: str, name: str) -> str:
        return f"explode(array({x})) AS {name}"

    def sorted(self, array: str) -> str:
        return f"array_sort({array})"

    def numbers(self, a: str, b: str) -> str:
        return f"if({b} < {a}, CAST(array() AS ARRAY<INT>), sequence(CAST({a} AS INT), CAST({b} AS INT)))"

    def row(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def join(self, array: str, sep: str) -> str:
        return f"array_join({array}, {self.lit(sep)})"

    def list_(self, *items: str) -> str:
        return "array(" + ", ".join(items) + ")"

    def series(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def ts(self, x: str) -> str:
        return f"(unix_micros(CAST({x} AS TIMESTAMP)) / 1000000D)"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '$.{path}')"


DUCK, SPARK = Dialect(), SparkDialect()
