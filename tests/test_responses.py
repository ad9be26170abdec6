import json

from pyspark.sql import functions as F

from clausework.functions import prompts, responses
from clausework.operators import sites as S


def run(spark, values, *exprs):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [tuple(r) for r in df.orderBy("i").select(*exprs).collect()]


SITE = [
    ('```json\n{"is_shopping": 1}\n```', 1, False),
    ("{'is_shopping': 0}", 0, False),
    ('{"is_shopping": 1,}', 1, False),
    ("Sorry, I cannot", -1, False),
    ('{"shop": 1}', None, True),
    ('{"is_shopping": 1} or not', -1, False),
    ('{"is_shopping": true}', 1, False),
    ('{"is_shopping": 1.0}', 1, False),
    ('{"is_shopping": 1.5}', -1, False),
    ('{"is_shopping": "1"}', -1, False),
    ('{"is_shopping": ""}', 0, False),
    ('{"is_shopping": null}', 0, False),
    ('[{"is_shopping": 1}]', None, True),
    ("1", None, True),
    ("", -1, False),
    (None, None, None),
]


def test_site_class(spark):
    value, error = responses.parse_site_class(F.col("t"))
    assert run(spark, [s[0] for s in SITE], value, error) == [s[1:] for s in SITE]


def spec_clean(text):
    return text.strip().replace("\n", "").replace("`", "").replace("'", '"').replace(",", "").replace("json", "")


def test_clean(spark):
    values = [s[0] for s in SITE if s[0] is not None] + ["  `a`,\n'json' \t"]
    assert [r[0] for r in run(spark, values, responses.clean_response(F.col("t")))] == [spec_clean(v) for v in values]


def test_gates(spark):
    df = spark.createDataFrame([(1,), (0,), (-1,), (None,)], "is_shopping int")
    assert [r[0] for r in S.shopping_gate(df).collect()] == [1]
    assert sorted(r[0] for r in S.shopping_gate(df, "truthy").collect()) == [-1, 1]


def test_labels(spark):
    values = [
        '{"classification": 1, "confidence": 0.9}', '[{"classification": 1, "confidence": 0.5}]', '{"confidence": 1}',
        '{"classification": "1"}', '{"classification": 1,}', "error", '{"classification": 1} {"classification": 0}', None,
        '{"classification": 0, "classification": 1}',
    ]
    plain, confidence = responses.parse_financial(F.col("t"))
    unwrapped, _ = responses.parse_financial(F.col("t"), unwrap=True)
    got = run(spark, values, plain, confidence, unwrapped)
    assert [g[0] for g in got] == [1, None, None, -1, None, None, None, None, 1]
    assert [g[2] for g in got] == [1, 1, None, -1, None, None, None, None, 1]
    assert [g[1] for g in got] == [0.9, None, 1.0, None, None, None, None, None, None]


def test_category(spark):
    values = ['{"category": "No \\"Refund\\"", "confidence": 1}', '{"category": 3}', '{"category": null}', "[]", "benign"]
    value, _ = responses.parse_category(F.col("t"))
    assert [g[0] for g in run(spark, values, value)] == ['No "Refund"', None, None, None, None]


def test_annotation(spark):
    values = ['{"topic_classification": "Warranty", "has_financial_term": 0}', '{"topic_classification": ["A", "B"], "has_financial_term": 1}', "x"]
    topics, financial = responses.parse_annotation(F.col("t"))
    assert run(spark, values, topics, financial) == [(["Warranty"], 0), (["A", "B"], 1), (None, None)]


def test_products(spark):
    product = {"name": "n", "type": "t", "category": "c", "price": "$1", "shipping_charge": "free"}
    values = [json.dumps({"is_payment_page": "1", "products": [product, product]}), '{"is_payment_page": "0", "products": []}', "x"]
    parsed = [r[0] for r in run(spark, values, responses.parse_products(F.col("t")))]
    assert [len(p["products"] or []) if p else None for p in parsed[:2]] == [2, 0]
    assert parsed[0]["products"][0].asDict() == product


def test_prompt(spark):
    template = 'A {0} {{"k": 1}} {0}{1}'
    got = run(spark, ["x{y}", "z"], prompts.build_prompt(template, F.col("t"), "!"), prompts.build_prompt("{taxonomy}|{d}", taxonomy="t", d=F.col("t")))
    assert got == [(template.format(v, "!"), f"t|{v}") for v in ("x{y}", "z")]
