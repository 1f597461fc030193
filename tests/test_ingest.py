from salescast.sources import ingest


def _text(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_validation_reasons(spark):
    lines = [
        '{"datum":"2025-06-30","sales":{"M01AB":5.2,"N02BA":4.5}}',
        '{"datum":"2025-06-30","sales":{"M01AB":1.0,"XXX":2.0}}',
        '{"sales":{"M01AB":1.0}}',
        '{"datum":"2025-06-31","sales":{"M01AB":1.0}}',
        '{"datum":"2025-07-01"}',
        '{"datum":"2025-07-02","sales":{"M01AB":-3.0}}',
        'not json',
    ]
    prods = spark.createDataFrame([("M01AB",), ("N02BA",)], "code string")
    v = ingest.parse_payloads(_text(spark, lines))
    got = {r.raw: r.reason for r in v.collect()}
    assert [got[x] for x in lines] == [None, None, "missing_datum", "bad_datum", "missing_sales", None, "malformed_json"]
    assert [tuple(r) for r in ingest.unknown_codes(v, prods).select("code", "value").collect()] == [("XXX", 2.0)]
    totals = sorted(r.total for r in ingest.payload_total(v.where("reason is null"), ["M01AB", "N02BA"]).collect())
    assert totals == [-3.0, 1.0, 9.7]


def test_explode_missing_product_is_zero(spark):
    prods = spark.createDataFrame([("A",), ("B",)], "code string")
    v = ingest.parse_payloads(_text(spark, ['{"datum":"2025-01-01","sales":{"A":2.5}}']))
    ok, bad = ingest.split_valid(v)
    got = sorted((r.series, r.value) for r in ingest.explode_payloads(ok, ["A", "B"]).collect())
    assert got == [("A", 2.5), ("B", 0.0)] and bad.count() == 0


def test_duplicate_and_out_of_order_days_are_kept(spark):
    lines = ['{"datum":"2025-01-02","sales":{"A":1}}', '{"datum":"2025-01-01","sales":{"A":2}}',
             '{"datum":"2025-01-02","sales":{"A":3}}']
    prods = spark.createDataFrame([("A",)], "code string")
    v = ingest.parse_payloads(_text(spark, lines))
    assert v.where("reason is null").count() == 3


def test_records_json(spark):
    import datetime as dt
    df = spark.createDataFrame([("A", dt.date(2020, 1, 2), 12.0)], "series string, datum date, value double")
    assert ingest.records_json(df).first().json == '{"series":"A","datum":"2020-01-02","value":12.0}'
