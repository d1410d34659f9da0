import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kinlink.config import Decision, MatchConfig, Rule, Side, SourceFilter, from_dict
from kinlink.errors import ConfigError
from kinlink.functions import matchers
from kinlink.plans import matching


def side(*c, **k):
    return Side(columns=c, **k)


def rule(i, c, m="exact", w=100, **k):
    return Rule(i, side(c), side(c), m, w, **k)


def table(spark, rows, columns):
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], ", ".join(f"{c} string" for c in columns) + ", row_ordinal int")


def run(spark, rules, src, tgt, columns, **k):
    cfg = MatchConfig(rules=tuple(rules), group_code_column="code", **k)
    i, c = matching.match(table(spark, src, columns), table(spark, tgt, [*columns, "code"]), cfg)
    return {r["s_ord"]: r for r in i.collect()}, sorted(c.collect(), key=lambda r: (r["s_ord"], r["rank"]))


def test_missing_fields_leave_the_weights(spark):
    i, c = run(spark, [rule("weak", "a", w=10), rule("strong", "b", w=90)], [("x", "")], [("x", None, "G")], ["a", "b"])
    assert (i[1]["top1_score"], c[0]["coverage"], i[1]["status"]) == (100.0, 0.1, "MATCHED")


def test_gap_and_ties(spark):
    i, c = run(spark, [rule("a", "a", w=90), rule("b", "b", w=10)], [("x", "y")], [("x", "z", "G2"), ("x", "y", "G1")], ["a", "b"])
    assert (i[1]["top1_score"], i[1]["second_score"], i[1]["score_gap"], i[1]["final_group_code"]) == (100.0, 90.0, 10.0, "G1")
    i, c = run(spark, [rule("a", "a")], [("x",)], [("x", "G9"), ("x", "G1")], ["a"])
    assert [r["group_code"] for r in c] == ["G9", "G1"] and i[1]["final_group_code"] == "G9"


def test_veto(spark):
    veto = dict(m="contains", w=100, matcher_options={"contains_score": 0.5})
    for least, score in ((60, 0.0), (50, 50.0)):
        i, _ = run(spark, [rule("a", "a", veto_threshold=least, **veto)], [("ab",)], [("abc", "G")], ["a"])
        assert i[1]["top1_score"] == score
    i, _ = run(spark, [rule("a", "a"), rule("b", "b", w=0, veto_threshold=10)], [("x", "p")], [("x", "q", "G")], ["a", "b"])
    assert (i[1]["top1_score"], i[1]["status"]) == (0.0, "UNMATCHED")
    with pytest.raises(ConfigError):
        rule("s", "a", "semantic", veto_threshold=99)


def test_value_mapping(spark):
    r = Rule("o", side("a", processors=({"op": "trim"},)), side("a"), "exact", 100, value_mapping={"10": "国产", "11": "进口"})
    i, _ = run(spark, [r], [(" 10 ",), ("12",)], [("国产", "G")], ["a"])
    assert (i[1]["top1_score"], i[2]["top1_score"]) == (100.0, 0.0)


def test_source_filter_keeps_null_when_excluding(spark):
    df = spark.createDataFrame([("Z001",), (" Z001 ",), ("Z0019",), (None,)], "t string")
    n = lambda *a: df.where(matching.source_predicate(SourceFilter("t", *a))).count()
    assert (n(("Z001",)), n(("Z001",), "exclude"), n(("Z001",), "include", "contains"), n(("Z001", " "), "exclude", "contains"), n((" ",)), n((" ",), "exclude")) == (2, 2, 3, 1, 0, 4)


def test_no_codes_no_candidates(spark):
    i, c = run(spark, [rule("a", "a")], [("x",)], [("x", ""), ("x", None)], ["a"])
    assert not c and i[1]["status"] == "UNMATCHED" and i[1]["final_group_code"] is None


def test_best_of_and_fixed(spark):
    both = side("a", "b", combine="best_of")
    i, _ = run(spark, [Rule("x", both, both, "fuzzy", 100)], [("abc", "zzz")], [("q", "abd", "G")], ["a", "b"])
    assert i[1]["top1_score"] == round(SequenceMatcher(None, "abc", "abd", autojunk=False).ratio() * 100, 4)
    i, _ = run(spark, [Rule("x", side("a"), Side(fixed_value="x"), "exact", 100)], [("x",)], [("q", "G")], ["a"])
    assert i[1]["top1_score"] == 100.0


def test_fuzzy_is_ratcliff_obershelp(spark):
    r = random.Random(2)
    v = [("".join(r.choices("abcd", k=r.randint(0, 9))), "".join(r.choices("abcd", k=r.randint(0, 9)))) for _ in range(300)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(v)], "i int, s string, t string")
    got = sorted(df.select("i", matchers.fuzzy(F.col("s"), F.col("t"))).collect())
    assert [x[1] for x in got] == [SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in v]


def test_numeric_texts(spark):
    v = ["1", " 1.5 ", "1_000", "1e3", "1d", "", "nan", "inf", ".5", "5.", "_1", "0x1"]
    want = []
    for x in v:
        try:
            want.append(str(float(x)))
        except ValueError:
            want.append(None)
    got = [r[1] for r in sorted(spark.createDataFrame(list(enumerate(v)), "i int, v string").select("i", matchers.number(F.col("v"))).collect())]
    assert [None if x is None else str(x) for x in got] == want
    nan = spark.createDataFrame([("nan", "nan")], "s string, t string").select(matchers.numeric(F.col("s"), F.col("t"), {"mode": "exact"})).first()[0]
    assert nan == 0.0


def test_config():
    with pytest.raises(ConfigError):
        MatchConfig(rules=(rule("a", "a", w=0),), group_code_column="c")
    with pytest.raises(ConfigError):
        Decision(success_threshold=0)
    cfg = MatchConfig(rules=(rule("a", "a"),), group_code_column="c")
    import json

    assert from_dict(MatchConfig, json.loads(cfg.to_json())).sha256() == cfg.sha256()


def test_missing_column(spark):
    with pytest.raises(ConfigError, match="COLUMN_NOT_FOUND"):
        run(spark, [rule("a", "nope")], [("x",)], [("x", "G")], ["a"])
