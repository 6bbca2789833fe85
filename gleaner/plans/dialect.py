"""Plans are SQL text; the few things that engines spell differently are asked of a dialect."""

from __future__ import annotations


class Spark:
    name = "spark"

    def p(self, x: str) -> str:
        """The stub judge's probability for a text: the first 16 bits of its MD5."""
        return f"(CAST(conv(substr(md5({x}), 1, 4), 16, 10) AS INT) / CAST(65535 AS DOUBLE))"

    def lines(self) -> str:
        return "SELECT doc_id AS page_id, CAST(pos AS INT) AS sent_id, line AS text FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, line) FROM documents) WHERE line <> ''"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}')"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE '{pattern}')"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def found(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, '{pattern}', {group})"

    def count(self, x: str, pattern: str) -> str:
        return f"CAST(regexp_count({x}, '{pattern}') AS BIGINT)"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, '[{by}]')"

    def size(self, x: str) -> str:
        return f"CAST(size({x}) AS BIGINT)"

    def unnest(self, x: str, source: str, keep: str, name: str = "item") -> str:
        return f"SELECT {keep}, CAST(pos AS BIGINT) AS pos, {name} FROM (SELECT {keep}, posexplode({x}) AS (pos, {name}) FROM {source})"

    def joined(self, x: str, by: str, order: str) -> str:
        return f"listagg({x}, '{by}') WITHIN GROUP (ORDER BY {order})"

    def seconds(self, a: str, b: str) -> str:
        return f"(CAST({self.micros(a)} - {self.micros(b)} AS DOUBLE) / 1000000)"

    def micros(self, x: str) -> str:
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {x})"

    def literal(self, pattern: str) -> str:
        """A pattern with backslashes as it stands inside quotes."""
        return pattern.replace(chr(92), chr(92) * 2)

    def script(self, name: str) -> str:
        """A script as part of a class of characters."""
        return rf"\p{{Is{name}}}"

    def newline(self) -> str:
        return "'\\n'"

    def hex_div(self) -> str:
        return "div"

    def any_(self, x: str) -> str:
        return f"bool_or({x})"

    def filter_len(self, x: str, var: str, cond: str) -> str:
        return f"CAST(size(filter({x}, {var} -> {cond})) AS BIGINT)"

    def luhn(self, digits: str) -> str:
        return f"luhn_check({digits})"

    def mod97(self, x: str) -> str:
        """The remainder by 97 of a number whose letters stand for 10 to 35."""
        return f"aggregate(split({x}, ''), 0, (a, c) -> CASE WHEN c RLIKE '[A-Z]' THEN (a * 100 + ascii(c) - 55) % 97 ELSE (a * 10 + coalesce(try_cast(c AS INT), 0)) % 97 END)"

    def json_number(self, x: str, key: str) -> str:
        return f"try_cast(get_json_object({x}, '$.{key}') AS DOUBLE)"

    def locate(self, part: str, whole: str) -> str:
        return f"locate({part}, {whole})"

    def has(self, array: str, x: str) -> str:
        return f"array_contains({array}, {x})"

    def contains(self, whole: str, part: str) -> str:
        return f"contains({whole}, {part})"


class Duck(Spark):
    name = "duckdb"

    def p(self, x: str) -> str:
        return f"(CAST(('0x' || substr(md5({x}), 1, 4)) AS INT) / CAST(65535 AS DOUBLE))"

    def lines(self) -> str:
        return "SELECT page_id, sent_id, text FROM (SELECT doc_id AS page_id, CAST(unnest(range(len(l))) AS INT) AS sent_id, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) a) b WHERE text <> ''"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def count(self, x: str, pattern: str) -> str:
        return self.size(self.found(x, pattern))

    def split(self, x: str, by: str) -> str:
        return f"string_split_regex({x}, '[{by}]')"

    def size(self, x: str) -> str:
        return f"CAST(len({x}) AS BIGINT)"

    def unnest(self, x: str, source: str, keep: str, name: str = "item") -> str:
        return f"SELECT {keep}, CAST(pos AS BIGINT) AS pos, {name} FROM (SELECT {keep}, unnest(range(len(l))) AS pos, unnest(l) AS {name} FROM (SELECT {keep}, {x} AS l FROM {source}) u0) u1"

    def joined(self, x: str, by: str, order: str) -> str:
        by = "chr(10)" if by == "\\n" else f"'{by}'"
        return f"string_agg({x}, {by} ORDER BY {order})"

    def seconds(self, a: str, b: str) -> str:
        return f"(CAST({self.micros(a)} - {self.micros(b)} AS DOUBLE) / 1000000)"

    def micros(self, x: str) -> str:
        return f"epoch_us({x})"

    def literal(self, pattern: str) -> str:
        return pattern

    def script(self, name: str) -> str:
        return rf"\p{{{name}}}"

    def newline(self) -> str:
        return "chr(10)"

    def hex_div(self) -> str:
        return "//"

    def filter_len(self, x: str, var: str, cond: str) -> str:
        return f"CAST(len(list_filter({x}, lambda {var}: {cond})) AS BIGINT)"

    def luhn(self, digits: str) -> str:
        doubled = f"list_transform(range(len({digits})), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(substr({digits}, len({digits}) - i, 1) AS INT) > 4 THEN CAST(substr({digits}, len({digits}) - i, 1) AS INT) * 2 - 9 ELSE CAST(substr({digits}, len({digits}) - i, 1) AS INT) * 2 END ELSE CAST(substr({digits}, len({digits}) - i, 1) AS INT) END)"
        return f"(list_sum({doubled}) % 10 = 0)"

    def mod97(self, x: str) -> str:
        # in pieces that fit a number: letters become two digits first
        digits = f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"
        return f"CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split({digits}, ''), lambda c: CAST(c AS BIGINT))), lambda a, c: (a * 10 + c) % 97) AS INT)"

    def json_number(self, x: str, key: str) -> str:
        return f"try_cast(json_extract_string({x}, '$.{key}') AS DOUBLE)"

    def locate(self, part: str, whole: str) -> str:
        return f"CAST(strpos({whole}, {part}) AS INT)"

    def has(self, array: str, x: str) -> str:
        return f"list_contains({array}, {x})"
