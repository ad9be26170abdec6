"""Explicit schemas of the stage tables."""

from __future__ import annotations

from pyspark.sql import types as T

RANKED_DOMAINS = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("domain", T.StringType())])

SITES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("is_shopping", T.IntegerType()),
        T.StructField("html", T.StringType()),
    ]
)

LINKS = T.ArrayType(
    T.StructType([T.StructField("href", T.StringType()), T.StructField("onclick", T.StringType())])
)

PARAGRAPHS = T.StructType([T.StructField("url", T.StringType()), T.StructField("paragraph", T.StringType())])

CLUSTER_MAP = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

LABELLED = T.StructType(
    [
        T.StructField("cluster_id", T.StringType()),
        T.StructField("paragraphs", T.ArrayType(T.StringType())),
        T.StructField("category", T.StringType()),
    ]
)

PAYMENT_PAGE = T.StructType(
    [
        T.StructField("is_payment_page", T.StringType()),
        T.StructField(
            "products",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(name, T.StringType())
                        for name in ("name", "type", "category", "price", "shipping_charge")
                    ]
                )
            ),
        ),
    ]
)
