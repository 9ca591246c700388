import os

import pytest
from pyspark.sql import functions as F

from hushlens.llm import mix, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZERS), reason="no tokenizer files")


def test_spellings(spark):
    names = ["Note Conseiller", " note_conseiller", "NOTE-CONSEILLER ", "note__conseiller"]
    got = spark.createDataFrame([(n,) for n in names], "s string").select(mix.source_key(F.col("s")).alias("k")).collect()
    assert {r.k for r in got} == {"note_conseiller"}


def test_positions_invert_demand(spark):
    for tilt in (-0.9, 0.0, 0.4, 1.0):
        rows = spark.range(101).select((F.col("id") / 100).alias("t"))
        rows = rows.withColumn("c", 1000 * 0.25 * ((1 + tilt) * F.col("t") - tilt * F.col("t") ** 2)).withColumn("back", mix.position(F.col("c"), F.lit(0.25), F.lit(1000), tilt))
        assert all(abs(r.t - r.back) < 1e-6 for r in rows.collect())


def test_mix(spark):
    rows = [(i, "mot " * (20 + i % 7), "Big") for i in range(400)] + [(1000 + i, "mot " * 25, " small-one") for i in range(20)] + [(2000 + i, "mot " * 25, "other") for i in range(30)]
    rows += [(3000, None, "big"), (3001, "", "big"), (3002, "mot", None), (None, "mot mot", "big"), (5, "mot " * 25, "big"), (5, "mot " * 25, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as tokens", "2 as _block")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small_one", 0.3, 3), ("empty", 0.2, 4), ("none", None, None)], "source string, target_share double, max_repeats int")
    chosen, report = mix.mix(df, targets, tilt={"big": 0.5}, block_rows=50)
    by = {r.source: r for r in report.collect()}
    assert by["small_one"].short and by["empty"].short and not by["big"].short and not by["none"].short
    assert by["small_one"].used_records == 60 and by["small_one"].most_repeats == 3
    assert abs(by["big"].share_of_budget - 0.5) < 0.01 and by["empty"].used_tokens == 0
    got = chosen.collect()
    assert {r.source for r in got} == {"big", "small_one"} and all(0 <= r.position <= 1 for r in got)
    positions = [r.position for r in got]
    assert positions == sorted(positions)
    assert max(sum(1 for r in got if (r.doc_id, r.repeat, r.source) == k) for k in {(r.doc_id, r.repeat, r.source) for r in got if r.doc_id != 5}) == 1
    early = sum(r.tokens for r in got if r.source == "big" and r.position < 0.5)
    assert early > 0.55 * by["big"].used_tokens  # tilted to the beginning
    again = mix.mix(df, targets, tilt={"big": 0.5}, block_rows=7)[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, got))  # blocks don't change the result


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mix.mix(df, targets)
    assert chosen.count() == 0 and report.first().own_tokens == 0
    assert mix.mix(df, targets.limit(0))[1].count() == 0
