"""Pieces of the SQL that the registered queries are held against."""

from __future__ import annotations

SPACE = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def check13(code: str) -> str:
    return f"CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({code}, i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS VARCHAR)"


def check10(code: str) -> str:
    r = f"(11 - list_sum(list_transform(range(1, 10), lambda i: CAST(substr({code}, i, 1) AS INTEGER) * (11 - i))) % 11) % 11"
    return f"CASE WHEN {r} = 10 THEN 'X' ELSE CAST({r} AS VARCHAR) END"


def isbn13(nine: str) -> str:
    return f"'978' || {nine} || {check13(f"('978' || {nine})")}"


def key(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def grams(k: str) -> str:
    return f"CASE WHEN length({k}) >= 2 THEN list_transform(range(1, length({k})), lambda i: substr({k}, i, 2)) WHEN length({k}) = 1 THEN [{k}] ELSE CAST([] AS VARCHAR[]) END"


def dice(a: str, b: str) -> str:
    shared = f"list_sum(list_transform(list_distinct({a}), lambda g: least(len(list_filter({a}, lambda x: x = g)), len(list_filter({b}, lambda y: y = g)))))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST(2.0 * {shared} AS DOUBLE) / (len({a}) + len({b})) END"


def lev(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END"


def contain(a: str, b: str) -> str:
    inside = f"(contains({a}, {b}) OR contains({b}, {a}))"
    return f"CASE WHEN least(length({a}), length({b})) >= 2 AND {inside} THEN least(1.0, CAST(least(length({a}), length({b})) AS DOUBLE) / greatest(4, length({a}), length({b}))) ELSE 0.0 END"


def title(a: str, b: str, ga: str, gb: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE least(1.0, greatest(CAST(0.65 AS DOUBLE) * ({dice(ga, gb)}) + CAST(0.35 AS DOUBLE) * ({lev(a, b)}), CAST(0.9 AS DOUBLE) * ({contain(a, b)}))) END"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '\\r?\\n'), lambda l: trim(regexp_replace(l, '{SPACE}', ' ', 'g'))), lambda l: l <> '')"


def publisher(x: str) -> str:
    return f"(length({x}) <= 16 AND regexp_matches(lower({x}), 'press|publish|books?$'))"


def csv(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '[",\\r\\n]') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""


def average_hash(g: str) -> str:
    nibble = " + ".join(f"CASE WHEN {g}[4 * k + {j + 1}] * 64 >= list_sum({g}) THEN {8 >> j} ELSE 0 END" for j in range(4))
    return f"array_to_string(list_transform(range(16), lambda k: substr('0123456789abcdef', {nibble} + 1, 1)), '')"


def hamming(a: str, b: str) -> str:
    digit = lambda h: f"CAST(strpos('0123456789abcdef', substr({h}, i, 1)) - 1 AS INTEGER)"
    return f"CAST(list_sum(list_transform(range(1, 17), lambda i: bit_count(xor({digit(a)}, {digit(b)})))) AS BIGINT)"
