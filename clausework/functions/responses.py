"""Reading model replies: cleaning, class values, labels and product lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions.expr import once
from clausework.functions.text import strip
from clausework.schemas import PAYMENT_PAGE


def clean_response(text: Column) -> Column:
    """Drop newlines, backticks, commas and the word ``json``; single quotes become double quotes."""
    stripped = F.translate(strip(text), "\n`,", "")
    return F.replace(F.replace(stripped, F.lit("'"), F.lit('"')), F.lit("json"), F.lit(""))


def _parsed(text: Column) -> Column:
    """The JSON value of ``text`` as a one-element variant array; null when the text is not one JSON value.

    The parser stops after the first value. Inside brackets, text after it is an error.
    """

    def single(value: Column) -> Column:
        first, second = (F.try_variant_get(value, f"$[{i}]", "variant") for i in (0, 1))
        return F.when(first.isNotNull() & second.isNull(), value)

    return once(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), single)


def _raw(parsed: Column, key: str, unwrap: bool = False) -> Column:
    """JSON text of ``key`` in the parsed object; null when the key or the object is missing."""
    found = F.to_json(F.try_variant_get(parsed, f"$[0].{key}", "variant"))
    if unwrap:
        found = F.coalesce(found, F.to_json(F.try_variant_get(parsed, f"$[0][0].{key}", "variant")))
    return found


def _class_value(raw: Column) -> Column:
    """Integer class of a JSON scalar.

    Numbers and booleans keep their value. Other empty values are 0 and other non-empty ones -1:
    neither counts as class 1, and only the second passes a truth test.
    """

    def of_number(number: Column) -> Column:
        return F.when(number == F.floor(number), number.cast("int")).when(number.isNotNull(), F.lit(-1))

    def value(text: Column) -> Column:
        number = F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).otherwise(text.try_cast("double"))
        empty = F.when(text.isin("null", '""', "[]", "{}"), F.lit(0))
        return F.when(text.isNotNull(), F.coalesce(empty, once(number, of_number), F.lit(-1)))

    return once(raw, value)


def parse_site_class(text: Column) -> tuple[Column, Column]:
    """Class and error flag of a site reply.

    Text that is not JSON gives class -1. JSON without the key gives a null class and an error.
    A null reply gives null for both.
    """
    parsed = _parsed(clean_response(text))
    value = once(
        parsed, lambda p: F.when(p.isNull(), F.lit(-1)).otherwise(_class_value(_raw(p, "is_shopping")))
    )
    class_value = F.when(text.isNotNull(), value)
    return class_value, F.when(text.isNotNull(), class_value.isNull())


def _string_value(raw: Column) -> Column:
    return once(
        raw, lambda r: F.when(r.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), r, F.lit("}")), "v string")["v"])
    )


def parse_financial(text: Column, unwrap: bool = False) -> tuple[Column, Column]:
    """``classification`` and ``confidence`` of a reply; nulls when it cannot be read.

    The prompt shows an object but also asks for an array. An array counts as unreadable
    unless ``unwrap`` is set; then its first element is read.
    """
    parsed = _parsed(text)
    return (
        once(parsed, lambda p: _class_value(_raw(p, "classification", unwrap))),
        once(parsed, lambda p: _raw(p, "confidence", unwrap).try_cast("double")),
    )


def parse_category(text: Column, unwrap: bool = False) -> tuple[Column, Column]:
    """``category`` and ``confidence`` of a reply; the category is null unless it is a JSON string."""
    parsed = _parsed(text)
    return (
        once(parsed, lambda p: _string_value(_raw(p, "category", unwrap))),
        once(parsed, lambda p: _raw(p, "confidence", unwrap).try_cast("double")),
    )


def parse_annotation(text: Column) -> tuple[Column, Column]:
    """``topic_classification`` as an array and ``has_financial_term``; one topic may come as a plain string."""

    def topics(raw: Column) -> Column:
        many = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v array<string>")["v"]
        return F.when(raw.startswith("["), many).when(raw.startswith('"'), F.array(_string_value(raw)))

    parsed = _parsed(text)
    return once(_raw(parsed, "topic_classification"), topics), _class_value(_raw(parsed, "has_financial_term"))


def parse_products(text: Column) -> Column:
    """Payment-page reply as a struct with its product list; prices stay strings."""
    return F.from_json(text, PAYMENT_PAGE)
