"""NFKC of names, with Python only where a name needs it."""

import re
import unicodedata

from pyspark.sql import functions as F

from freightspark.functions import names, scalars

SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f"


def test_plain_characters_are_their_own_form():
    plain = re.compile(f"[{names.PLAIN}]")
    for code in range(0x10000):
        c = chr(code)
        if plain.match(c) and c not in SPACES and not "\u2010" <= c <= "\u2015":
            assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c), hex(code)
    assert all(unicodedata.normalize("NFKC", c) == " " for c in SPACES)


def test_compatibility_forms(spark):
    texts = ["\uff2d\uff4f\uff53\uff4b\uff56\uff41", "\ufb01eld", "\u2116 5", "И\u0306ошкар-Ола", " Нижний\u00a0Новгород ", "Орёл\u2011Город", "", None, "e\u0301", "\u00b2", "a\u3000b", "\u1e9b\u0323", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in names.with_normal_name(df, "t", "n").collect()}
    rule = {r.i: r.n for r in spark.createDataFrame([(i, None if t is None else unicodedata.normalize("NFKC", t)) for i, t in enumerate(texts)], "i int, t string").select("i", scalars.normalize_name(F.col("t")).alias("n")).collect()}
    assert got == rule and got[0] == "moskva" and got[3] == "йошкар-ола" and got[4] == "нижний новгород" and got[7] is None


def test_plain_rows_do_not_reach_python(spark):
    df = spark.createDataFrame([("Тверь",), ("Псков",)], "t string")
    out = names.with_normal_name(df, "t", "n")
    assert sorted(r.n for r in out.collect()) == ["псков", "тверь"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    branches = plan.split("Union")[1]
    # one branch without Python, and in the other the filter stands below the Python node
    assert branches.count("ArrowEvalPython") == 1 and branches.index("Project") < branches.index("ArrowEvalPython")
    assert "Filter" in branches[branches.index("ArrowEvalPython"):]
