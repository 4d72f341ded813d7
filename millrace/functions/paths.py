"""Field access in open JSON records held as VARIANT."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from millrace.functions.text import SPACES, let, strip


def parse(line: Column) -> Column:
    """JSON text to VARIANT; null when it does not parse."""
    return F.try_parse_json(line)


def _step(key: str) -> str:
    """One key of a path, in the quotes that it doesn't hold itself."""
    return f"['{key}']" if "'" not in key else f'["{key}"]' if '"' not in key else f".{key}"


def _steps(path: str) -> str:
    return "$" + "".join(map(_step, path.split("."))) if path else "$"


def _clean(path: str) -> str:
    return re.sub(r" \[список.*?\]$", "", path or "").strip()


def get(record: Column, path: str, lenient: bool = False) -> Column:
    """Value at ``a.b``, ``a[2].b`` or ``a[].b`` as VARIANT; null when any step is missing.

    ``a[].b`` gives the list of ``b`` of every element. With ``lenient`` a numeric key also indexes a
    list, and elements that are not objects are left out of ``a[].b``.
    """
    path = _clean(path)
    if not path:
        return F.lit(None).cast("variant")
    if "[]." in path:
        outer, inner = path.split("[].", 1)
        items = F.try_variant_get(get(record, outer, lenient), "$", "array<variant>")
        if lenient:
            items = F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
        return F.to_variant_object(F.transform(items, lambda x: get(x, inner, lenient)))
    found = re.search(r"\[(\d+)\]", path)
    if found:
        base, tail = path[:found.start()], path[found.end():].removeprefix(".")
        element = F.try_variant_get(record, f"{_steps(base)}[{found.group(1)}]", "variant")
        return get(element, tail, lenient) if tail else element
    value = F.try_variant_get(record, _steps(path), "variant")
    if lenient and any(k.isdigit() for k in path.split(".")):
        by_index = "$" + "".join(f"[{k}]" if k.isdigit() else _step(k) for k in path.split("."))
        value = F.coalesce(value, F.try_variant_get(record, by_index, "variant"))
    return value


def float_text(x: Column) -> Column:
    """A double as Python prints it: the JVM's digits, exponents only below 1e-4 and from 1e16 on."""
    def plain(parts):
        digits, power = F.concat(parts["a"], parts["b"]), parts["e"]
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        short = F.size(F.split(digits, "")) <= power + 1
        large = F.when(short, F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0"))).otherwise(
            F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
        sign = F.when(power < 0, "-").otherwise("+")
        exponent = F.concat(sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
        far = F.concat(parts["a"], F.when(parts["b"] != "", F.concat(F.lit("."), parts["b"])).otherwise(""), F.lit("e"), exponent)
        return F.concat(parts["sign"], F.when(power.between(-4, -1), small).when(power.between(0, 15), large).otherwise(far))

    def by_exponent(s):
        form = r"(-?)(\d)\.(\d+)E(-?\d+)"
        parts = F.struct(F.regexp_extract(s, form, 1).alias("sign"), F.regexp_extract(s, form, 2).alias("a"),
                         F.regexp_replace(F.regexp_extract(s, form, 3), r"\A0\z", "").alias("b"), F.regexp_extract(s, form, 4).try_cast("int").alias("e"))
        return (F.when(s.contains("E"), let(parts, plain)).when(s == "Infinity", "inf").when(s == "-Infinity", "-inf").when(s == "NaN", "nan").otherwise(s))

    return let(x.cast("string"), by_exponent)


def _number_text(kind: Column, v: Column) -> Column:
    """Whole numbers as they are; a number written with a point or exponent as a float. Texts of more than 18 digits without a
    fraction can't be told apart in a VARIANT and count as whole."""
    whole = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | F.regexp_extract(kind, r"DECIMAL\((\d+),0\)", 1).try_cast("int").between(19, 38)
    return F.when(whole, F.try_variant_get(v, "$", "string")).otherwise(float_text(F.try_variant_get(v, "$", "double")))


# A JSON text in pieces: strings, numbers, words, marks.
_JSON_PIECES = r'"[^"\\]*(?:\\.[^"\\]*)*"|-?\d[\d.eE+-]*|[a-z]+|[\[\]{}:,]'


def _literal(json: Column) -> Column:
    """JSON as the literal that Python prints for the same value."""
    def piece(p):
        body = F.substring(p, F.lit(2), F.length(p) - 2)
        inner = F.replace(F.replace(body, F.lit('\\"'), F.lit('"')), F.lit("\\/"), F.lit("/"))
        double = inner.contains("'") & ~inner.contains('"')
        text = F.when(double, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'")))
        real = p.rlike(r"\A-?\d") & p.rlike("[.eE]")
        return (F.when(p.startswith('"'), text).when(real, float_text(p.try_cast("double"))).when(p == ",", ", ").when(p == ":", ": ")
                .when(p == "true", "True").when(p == "false", "False").when(p == "null", "None").otherwise(p))

    return F.array_join(F.transform(F.regexp_extract_all(json, F.lit(_JSON_PIECES), F.lit(0)), piece), "")


def _scalar(v: Column) -> Column:
    """Text of one value, as Python prints it; null stays null."""
    def by_kind(t):
        kind, v = t["k"], t["v"]
        number = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return (F.when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "boolean").cast("string")))
                .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), _literal(F.to_json(v)))
                .when(number, _number_text(kind, v)).otherwise(F.try_variant_get(v, "$", "string")))

    return let(F.struct(F.schema_of_variant(v).alias("k"), v.alias("v")), by_kind)


def as_text(v: Column) -> Column:
    """Text of a value: null is empty, a list joins its non-blank items by line breaks."""
    items = F.try_variant_get(v, "$", "array<variant>")
    texts = F.filter(F.transform(items, _scalar), lambda s: s.isNotNull() & (F.trim(s, F.lit(SPACES)) != ""))
    return F.coalesce(F.when(items.isNotNull(), F.array_join(texts, "\n")).otherwise(_scalar(v)), F.lit(""))


def text_at(record: Column, path: str) -> Column:
    return as_text(get(record, path))


def has_key(record: Column, key: str) -> Column:
    """Whether the key is present, even with a JSON null."""
    return F.try_variant_get(record, _steps(key), "variant").isNotNull()


def truthy_text(v: Column) -> Column:
    """``str(v) if v else ''``: null, false, zero and empty values give the empty text."""
    s = _scalar(v)
    empty = s.isin("", "False", "0", "0.0", "[]", "{}") & (F.schema_of_variant(v) != "STRING")
    return F.coalesce(F.when(empty, "").otherwise(s), F.lit(""))


__all__ = ["parse", "get", "as_text", "text_at", "has_key", "truthy_text", "strip"]
