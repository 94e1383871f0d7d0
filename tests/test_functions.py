import math

from pyspark.sql import Row
from pyspark.sql import functions as F

from quarrylake.functions import numeric as N
from quarrylake.functions import text as X


def one(spark, *columns, **values):
    return spark.createDataFrame([Row(**values)]).select(*columns).first()


def test_text(spark):
    c = F.col("v")
    assert one(spark, X.keep_value(c), v=" ab ")[0] is False
    assert one(spark, X.keep_value(c), v=" é1")[0] is True
    assert [one(spark, X.is_numeric(c), v=v)[0] for v in ("12", "1.5", "-1", "1e3", "1.")] == [True, True, False, False, False]
    assert one(spark, X.words_from_line(c), v="A1b c!")[0] == ["a", "b c", ""]
    assert one(spark, X.get_words(c), v="The 2nd-Best of all")[0] == ["the", "best", "all"]
    assert one(spark, X.entity_words(c), v="New_York (City) U.S.A x")[0] == ["new", "york", "usa"]
    assert one(spark, X.tokens(c), v=" (Red), blue. ")[0] == ["red", "blue"]
    assert one(spark, X.tokens(c), v="a b c d e f")[0] is None
    assert one(spark, X.cell_entity(c), v='<a href="http://w.org/wiki/Rome">x</a>')[0] == "Rome"


def test_dice(spark):
    f = lambda a, b: one(spark, X.dice(F.col("a"), F.col("b")), a=a, b=b)[0]
    assert f("abc", "ABC") == 1.0
    assert f("a", "b") is None
    assert abs(f("night", "nacht") - 0.25) < 1e-9


def test_edit_steps(spark):
    f = lambda a, b: one(spark, X.edit_steps(F.col("a"), F.col("b")), a=a, b=b)[0]
    assert f(["a", "b", "c"], ["A", "x", "c"]) == 1
    assert f(["a"], ["b", "a", "c"]) == 2


def test_same_domain_probability(spark):
    f = lambda j, a, b: one(spark, N.same_domain_probability(F.lit(float(j)), F.lit(a), F.lit(b)), v=1)[0]
    assert abs(f(0, 5, 5) - 1 / 252) < 1e-9
    assert abs(f(1, 5, 5) - 1) < 1e-9
    assert abs(f(0.2857, 100, 80) - 0.067756) < 1e-5
    assert abs(f(0.2, 20, 160) - 1) < 1e-9


def test_ln_factorial(spark):
    got = spark.range(400).select("id", N.ln_factorial(F.col("id")).alias("x")).collect()
    assert all(abs(r.x - math.lgamma(r.id + 1)) < 1e-9 * max(1, r.x) for r in got)
