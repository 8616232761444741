import pytest
from pyspark.sql import functions as F

from quarry.functions import scalar as S


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_strings(spark):
    s = F.lit("josé x")
    r = one(spark, a=S.substring(s, -3, 2), b=S.left(s, -2), c=S.right(s, -4), d=S.left(s, -99), e=S.substring_match(s, "z"), f=S.quote_literal(F.lit("a'b\\")), g=S.substring(s, 99))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("jo", "josé", " x"[-2:], "", None, "E'a''b\\\\'", "")


def test_domains(spark):
    assert one(spark, a=S.strict_ln(F.lit(None).cast("double"))).a is None
    for bad in (S.strict_ln(F.lit(-1.0)), S.strict_sqrt(F.lit(-1.0))):
        with pytest.raises(Exception, match="number"):
            one(spark, a=bad)


def test_geography(spark):
    # the textbook line from Flinders Peak to Buninyong: 54,972.271 m
    at = [F.lit(x) for x in (-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777)]
    r = one(spark, v=S.vincenty_km(*at), h=S.haversine_km(*at), same=S.vincenty_km(at[0], at[1], at[0], at[1]))
    assert r.v == pytest.approx(54.972271, abs=0.002) and r.h == pytest.approx(54.9, abs=0.3) and r.same == pytest.approx(0, abs=1e-9)
    m = one(spark, m=S.midpoint(*at)).m
    assert one(spark, d=S.haversine_km(at[0], at[1], F.lit(m.lat), F.lit(m.lon))).d == pytest.approx(r.h / 2, rel=1e-6)


def test_money_and_json(spark):
    r = one(spark, m=S.money(F.lit("12.340 EUR")), a=S.json_typeof(F.lit("[1]")), b=S.json_typeof(F.lit("{")), c=S.json_typeof(F.lit(" -1.5 ")))
    assert tuple(r.m) == ("EUR", 12340, 3) and (r.a, r.b, r.c) == ("array", None, "number")
