from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.sentiment import mood_asof, order_flow_asof

START = 1704067200


@pytest.fixture(scope="module")
def mood(spark):
    rng = np.random.default_rng(6)
    n = 400
    # Many samples in few seconds, with fractions of a second, ties, gaps and unknown ratios.
    at = np.round(np.concatenate([rng.integers(0, 900, n // 2) + rng.choice([0, 0.25, 0.5], n // 2), rng.uniform(3_000, 6_000, n // 2)]), 2)
    samples = pd.DataFrame({"key": rng.choice(["a", "b"], n), "ts": pd.to_datetime(START + at, unit="s"), "seq": np.arange(n), "ratio": rng.random(n)})
    samples.loc[samples["seq"] % 7 == 0, "ratio"] = None
    bars = pd.DataFrame([(k, pd.to_datetime(START + x, unit="s")) for k in "abc" for x in range(-60, 7_000, 60)], columns=["key", "end"])
    made = mood_asof(spark.createDataFrame(bars), spark.createDataFrame(samples).withColumn("ratio", F.expr("nullif(ratio, 'NaN')")), "end", max_age=60, trail=240, history=12, block_seconds=1_000)
    return samples, bars, made


def test_mood_of_a_trailing_range_against_brute_force(mood):
    samples, bars, made = mood
    got = {(r["key"], r["end"]): r for r in made.toPandas().to_dict("records")}
    assert len(got) == len(bars)
    moved = 0
    for key, end in bars.itertuples(index=False):
        own = samples[samples["key"] == key].sort_values(["ts", "seq"]).reset_index(drop=True)
        before = own[own["ts"] <= end]
        age = (end.floor("s") - own["ts"].dt.floor("s")).dt.total_seconds()
        inside = own[(age >= 0) & (age <= 240) & own["ratio"].notna()]
        row = got[key, end]
        want = 0.0
        if len(before) >= 5 and len(inside) >= 2:
            first = own["ratio"][len(before) - 12] if len(inside) > 12 and len(before) >= 12 else None if len(inside) > 12 else inside["ratio"].iloc[0]
            want = np.nan if first is None else before["ratio"].iloc[-1] - first
            moved += 1
        assert (pd.isna(row["velocity"]) and pd.isna(want)) or np.isclose(row["velocity"], want), (key, end)
        last = before["ratio"].iloc[-1] if len(before) else np.nan
        assert np.isclose(row["buyer_ratio"], 0.5 if pd.isna(last) else last)
    assert moved > 40


def test_mood_does_not_slide_over_the_samples_of_a_range(mood):
    """A frame between two values is evaluated anew for every row, over all samples in it."""
    plan = mood[2]._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"RangeFrame, ([^,]+), ([^)]+)\)", plan)
    assert all(lower == "unboundedpreceding$()" for lower, _ in frames)


def test_messages_are_parsed_once(spark):
    bars = spark.createDataFrame([("a", START + 60 * k) for k in range(10)], "key string, s bigint").select("key", F.timestamp_seconds("s").alias("end"))
    raw = spark.range(200).select(F.lit("a").alias("key"), F.timestamp_seconds(F.lit(START) + F.col("id")).alias("ts"), F.col("id").alias("seq"), (F.col("id") / 200).alias("x"))
    for join, names in ((mood_asof, ["ratio"]), (order_flow_asof, ["buy", "sell"])):
        read = spark.sparkContext.accumulator(0)

        def parse(batches, read=read, names=names):
            for b in batches:
                read.add(len(b))
                yield b.assign(**{name: b["x"] for name in names})[["key", "ts", "seq", *names]]

        parsed = raw.mapInPandas(parse, "key string, ts timestamp, seq bigint, " + ", ".join(f"{name} double" for name in names))
        assert join(bars, parsed, "end").count() == len(join(bars, raw.withColumns(dict.fromkeys(names, F.col("x"))).drop("x"), "end").collect()) == 10
        assert read.value == 200
