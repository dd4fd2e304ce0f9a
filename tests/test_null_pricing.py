import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import finance
from tidemark.operators import null, pricing


def _draws(seed, n):
    """mulberry32, one draw after the other."""
    out = []
    for k in range(n):
        x = (seed + (k + 1) * 0x6D2B79F5) % 2**32
        x = (x ^ x >> 15) * (x | 1) % 2**32
        x ^= (x + (x ^ x >> 7) * (x | 61)) % 2**32
        out.append((x ^ x >> 14) / 2**32)
    return out


def test_bootstrap_is_as_drawn_in_sequence(spark):
    r = [0.01, -0.004, 0.006, -0.002, 0.005, -0.001, 0.003]
    got = null.block_bootstrap(spark, spark.createDataFrame(list(enumerate(r)), "i int, r double"), 64, 3, 42)
    mean, draws, n = sum(r) / len(r), iter(_draws(42, 64 * 3)), len(r)
    want = []
    for k in range(64):
        values = []
        while len(values) < n:
            start = int(next(draws) * n)
            values += [r[(start + j) % n] - mean for j in range(3)]
        want += [(k, p, round(v, 12)) for p, v in enumerate(values[:n])]
    assert sorted((x[0], x[1], round(x[2], 12)) for x in got.collect()) == want
    with pytest.raises(ValueError, match="returns"):
        null.block_bootstrap(spark, spark.createDataFrame([], "i int, r double"), 64, 3, 42)


def test_sign_flips_and_p_value(spark):
    got = null.sign_flips(spark, spark.createDataFrame([(0, 1.0), (1, 2.0)], "i int, r double"), 2)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 1.0), (0, 1, -2.0), (1, 0, -1.0), (1, 1, 2.0)]
    assert null.p_value(got, "value", 1.0).first()["p_value"] == 3 / 5


def test_inverse_normal_and_deflation(spark):
    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.9999]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(finance.inverse_normal_cdf(F.col("p"))).collect()]
    assert all(math.isclose(a, statistics.NormalDist().inv_cdf(x), abs_tol=1e-6) for a, x in zip(got, p, strict=True))
    v = F.lit(0.01)
    few, many = spark.range(1).select(finance.deflated_sharpe(F.lit(0.2), v, F.lit(1)), finance.deflated_sharpe(F.lit(0.2), v, F.lit(100))).first()
    assert few > 0.9 > 0.5 > many


def _market(spark, names, masked=()):
    rows = [(0, t, e, float(p), (e, t) not in masked, float(s)) for e, (prices, s) in names.items() for t, p in enumerate(prices)]
    return spark.createDataFrame(rows, "fold int, t int, entity bigint, price double, tradable boolean, score double")


def test_long_only_prices_from_the_close_before(spark):
    rows = _market(spark, {1: ([8, 10, 12.5], 1), 2: ([20, 20, 20], 0)})
    got = pricing.fold_returns(rows, 2, 1, 0.5, long_short=False).orderBy("t").collect()
    assert [(r["held"], r["gross"]) for r in got] == [(0, 0.0), (1, 0.25), (1, 0.25)]
    assert [tuple(r) for r in pricing.fold_trades(rows, 2, 1, 0.5, long_short=False).collect()] == [(0, 1, 1, 0.0, 1.0, 1.0)]


def test_a_masked_position_is_carried_and_the_rest_scaled(spark):
    names = {1: ([10] * 4, 4), 2: ([10] * 4, 3), 3: ([10] * 4, 2), 4: ([10] * 4, 1)}
    trades = pricing.fold_trades(_market(spark, names, {(1, 2)}), 1, 1, 0.25).collect()
    # at session 2 entity 1 stays long by all of that side's budget; nothing else may be bought on it
    assert [(r["t"], r["entity"], r["change"]) for r in trades] == [(1, 1, 0.5), (1, 4, -0.5)]
    with pytest.raises(pricing.PricingError, match="later"):
        pricing.fold_returns(_market(spark, names), 1, 0, 0.25)


def target_book(scores: pd.Series, quantile: float, long_short: bool) -> dict[int, float]:
    """Weights by entity: best scores first, ties by entity; equal sizes within a side."""
    order = scores.reset_index().sort_values([scores.name, scores.index.name], ascending=[False, True])[scores.index.name].tolist()
    k = min(max(1, int(len(order) * quantile)), len(order) // 2 if long_short else len(order))
    if not k:
        return {}
    if not long_short:
        return dict.fromkeys(order[:k], 1 / k)
    return dict.fromkeys(order[:k], 0.5 / k) | dict.fromkeys(order[-k:], -0.5 / k)


def executable_book(scores: pd.Series, tradable: pd.Series, positions: dict[int, float], quantile: float, long_short: bool) -> dict[int, float]:
    """The target among what is tradable, scaled to the budget that carried positions leave, and those positions."""
    may = set(tradable.index[tradable])
    carried = {e: w for e, w in positions.items() if e not in may}
    sides = ((1, 0.5 if long_short else 1.0), (-1, 0.5 if long_short else 0.0))
    scale = {}
    for sign, budget in sides:
        used = sum(abs(w) for w in carried.values() if w * sign > 0)
        if used > budget + 2.0**-52:
            raise pricing.PricingError("carried positions exceed their side's budget")
        scale[sign] = max(0.0, budget - used) / budget if budget else 0.0
    wanted = target_book(scores[scores.index.isin(may)], quantile, long_short)
    return {e: w * scale[1 if w > 0 else -1] for e, w in wanted.items()} | carried


def _walk(fold: int, rows: pd.DataFrame, hold: int, lag: int, quantile: float, long_short: bool) -> tuple[list, list]:
    sessions = {t: x.set_index("entity") for t, x in rows.groupby("t")}
    times, positions, trades, returns = sorted(sessions), {}, [], []
    for offset, t in enumerate(times):
        now, signal_at = sessions[t], offset - lag
        if signal_at >= 0 and signal_at % hold == 0:
            target = executable_book(sessions[times[signal_at]]["score"].dropna(), now["tradable"], positions, quantile, long_short)
            for e in sorted(positions.keys() | target.keys()):
                before, after = positions.get(e, 0.0), target.get(e, 0.0)
                if after != before:
                    trades.append((fold, t, e, before, after, after - before))
            positions = target
        gross = 0.0
        if positions:
            past = sessions[times[offset - 1]]["price"] if offset else pd.Series(dtype=float)
            for e, w in sorted(positions.items()):
                if e not in past.index or e not in now.index:
                    raise pricing.PricingError(f"fold {fold}, session {t}: no close for a held position")
                gross += w * (now.at[e, "price"] / past[e] - 1)
        returns.append((fold, t, len(positions), gross))
    return trades, returns


@pytest.mark.parametrize("long_short", [True, False])
def test_steps_for_all_folds_are_as_the_walk_of_each(spark, long_short):
    rng = np.random.default_rng(3)
    rows = [(f, t, e, float(rng.uniform(5, 15)), bool(rng.random() > 0.3), float(rng.integers(6)) if rng.random() > 0.1 else None) for f, n in ((0, 11), (1, 8), (2, 1)) for t in range(n) for e in range(23)]
    df = spark.createDataFrame(rows, "fold int, t int, entity bigint, price double, tradable boolean, score double")
    walks = [_walk(int(f), x, 2, 1, 0.2, long_short) for f, x in pd.DataFrame(rows, columns=df.columns).groupby("fold")]
    returns, trades = pricing.fold_returns(df, 2, 1, 0.2, long_short), pricing.fold_trades(df, 2, 1, 0.2, long_short)
    for got, part, keys in ((returns, 1, 2), (trades, 0, 3)):
        assert "Pandas" not in got._jdf.queryExecution().toString()
        found, want = sorted(map(tuple, got.collect())), sorted(y for w in walks for y in w[part])
        assert [r[:keys] for r in found] == [r[:keys] for r in want]
        assert np.allclose([r[keys:] for r in found], [r[keys:] for r in want], rtol=0, atol=1e-12)


def _sized_walk(rows: pd.DataFrame, hold: int, lag: int, quantile: float) -> list:
    """Net returns of long-short books by size, session after session; half a spread of 7 % entity and 2 basis points."""
    times, positions, out = sorted(rows["t"].unique()), {}, []
    at = {t: rows[rows["t"] == t].set_index("entity") for t in times}
    for i, t in enumerate(times):
        change = {}
        if i >= lag and (i - lag) % hold == 0:
            signal, may = at[times[i - lag]], set(at[t].index[at[t]["tradable"]])
            names = sorted((e for e in signal.index if e in may and not np.isnan(signal.at[e, "score"])), key=lambda e: (-signal.at[e, "score"], e))
            k, kept = min(max(1, int(len(names) * quantile)), len(names) // 2), {e: w for e, w in positions.items() if e not in may}
            target = dict(kept)
            for sign, part in ((1, names[:k]), (-1, names[len(names) - k :])):
                left, total = 0.5 - sum(abs(w) for w in kept.values() if w * sign > 0), sum(signal.at[e, "size"] for e in part)
                target |= {e: sign * max(0.0, left) * signal.at[e, "size"] / total for e in part}
            change = {e: target.get(e, 0.0) - positions.get(e, 0.0) for e in target.keys() | positions.keys()}
            positions = target
        gross = sum(w * (at[t].at[e, "price"] / at[times[i - 1]].at[e, "price"] - 1) for e, w in positions.items())
        cost = sum(abs(d) * (e % 7 / 2 + 2) / 1e4 for e, d in change.items())
        out.append((t, len(positions), gross, sum(map(abs, change.values())), cost, gross - cost))
    return out


def test_net_returns_are_as_a_walk_with_sizes_and_costs(spark):
    rng = np.random.default_rng(5)
    rows = [(0, t, e, float(rng.uniform(5, 15)), bool(rng.random() > 0.3), float(rng.integers(6)), float(rng.uniform(1, 3)), float(e % 7)) for t in range(10) for e in range(19)]
    df = spark.createDataFrame(rows, "fold int, t int, entity bigint, price double, tradable boolean, score double, size double, spread double")
    got = pricing.net_returns(df, 2, 1, 0.2, pricing.spread_and_impact("spread", 2.0), market=("spread",)).orderBy("t").drop("fold").collect()
    assert np.allclose([tuple(r) for r in got], _sized_walk(pd.DataFrame(rows, columns=df.columns), 2, 1, 0.2), rtol=0, atol=1e-12)
    for bad, message in ((df.withColumn("size", F.when(F.col("entity") == 4, 0.0).otherwise(1.0)).withColumn("score", F.col("entity").cast("double") * -1).withColumn("tradable", F.lit(True)).where("entity >= 4"), "size"), (df.withColumn("price", F.when((F.col("entity") == 3) & (F.col("t") == 5), 0.0).otherwise(F.col("price"))), "price")):
        with pytest.raises(Exception, match=f"a {message} is not a number above 0"):
            pricing.net_returns(bad, 2, 1, 0.2, pricing.by_trade(lambda c: finance.linear_cost(c, 10.0))).collect()


def test_each_trade_has_one_charge(spark):
    trades = spark.createDataFrame([(0, 1, 1, 0.0, 0.5, 0.5), (0, 1, 2, 0.0, -0.5, -0.5)], "fold int, t int, entity bigint, previous double, target double, change double")
    model = pricing.by_trade(lambda c: finance.linear_cost(c, 10.0))
    assert sorted(r["charge"] for r in pricing.charged(trades, model).collect()) == [0.0005, 0.0005]
    for cost, message in (
        (lambda t: model(t.where("entity = 1")), "needs one charge"),
        (lambda t: model(t).unionByName(model(t)), "needs one charge"),
        (lambda t: model(t).unionByName(model(t).withColumn("entity", F.col("entity") + 9)), "without a trade"),
        (lambda t: t.select(*pricing.TRADE, F.col("change").alias("charge")), "number from 0"),
        (lambda t: t.select(*pricing.TRADE, F.lit(None).cast("double").alias("charge")), "number from 0"),
        (lambda t: t.select(*pricing.TRADE, F.lit(float("nan")).alias("charge")), "number from 0"),
    ):
        with pytest.raises(Exception, match=message):
            pricing.charged(trades, cost).collect()


def test_generated_null_series_are_checked(spark):
    series = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, -1.0)], "i int, r double")
    flips = lambda n: lambda s: null.sign_flips(spark, s, n)
    assert null.generated(series, flips(32)).count() == 96
    whole = null.sign_flips(spark, series, 32)
    for generate, message in (
        (flips(31), "31 replications"),
        (lambda s: whole.where("replication < 31 or place > 0"), "finite number"),
        (lambda s: whole.unionByName(whole.where("replication = 3 and place = 1")), "finite number"),
        (lambda s: whole.withColumn("value", F.when(F.col("place") == 1, float("nan")).otherwise(1.0)), "finite number"),
        (lambda s: whole.withColumn("value", F.lit(None)), "finite number"),
    ):
        with pytest.raises(ValueError, match=message):
            null.generated(series, generate)
