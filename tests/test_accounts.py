"""Stress scenarios, account rules, the journal, evidence and the calendar on cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import accounts, evidence, journal, risk, stress
from tidemark.operators.operations import clock_offset
from tidemark.sources import calendar_feed

ACCOUNT = "account string, trades int, wins int, average_win_r double, average_loss_r double, calibrated boolean, r_value_pct double, current_drawdown_pct double, open_risks array<double>, correlation double, trades_per_day int"


def measured(name="a", **changes):
    base = {"account": name, "trades": 200, "wins": 110, "average_win_r": 1.5, "average_loss_r": 1.0, "calibrated": True, "r_value_pct": 0.004, "current_drawdown_pct": 0.0, "open_risks": [], "correlation": None, "trades_per_day": 2}
    return tuple((base | changes).values())


def evaluated(spark, *rows):
    return {(r["account"], r["scenario"]): r.asDict() for r in stress.evaluate(spark.createDataFrame(list(rows), ACCOUNT)).collect()}


def chance(win, length, trades):
    """Brute force over the run-length chain."""
    states, hit = [1.0] + [0.0] * (length - 1), 0.0
    for _ in range(trades):
        hit += states[-1] * (1 - win)
        states = [math.fsum(states) * win] + [s * (1 - win) for s in states[:-1]]
    return hit


def test_losing_runs_equal_the_chain(spark):
    rows = spark.createDataFrame([(w / 20, k) for w in range(21) for k in (0, 1, 2, 5, 20, 21)], "w double, k int")
    for r in rows.select("w", "k", stress.run_probability(F.col("w"), F.col("k"), 20).alias("p")).collect():
        want = None if r["k"] < 1 else 0.0 if r["k"] > 20 else chance(r["w"], r["k"], 20)
        assert r["p"] is None if want is None else abs(r["p"] - want) < 1e-12
    for r in rows.select("w", *[stress.longest_run(F.col("w"), 20, p).alias(f"l{i}") for i, p in enumerate((0.5, 0.05))]).distinct().collect():
        for i, p in enumerate((0.5, 0.05)):
            assert r[f"l{i}"] == (20 if r["w"] <= 0 else max([k for k in range(1, 21) if chance(r["w"], k, 20) >= p], default=0))


def test_size_decides_survival_and_the_suggested_size_survives(spark):
    got = evaluated(spark, measured("small", r_value_pct=0.001), measured("large", r_value_pct=0.012), measured("booked", r_value_pct=0.008, open_risks=[2.0], correlation=0.0), measured("wounded", current_drawdown_pct=0.085))
    assert got["small", "extreme"]["survives"] and not got["large", "extreme"]["survives"] and got["large", "extreme"]["verdict"] == "block"
    again = evaluated(spark, *[measured(n, r_value_pct=got[n, "extreme"]["survivable_pct"], **more) for n, more in (("large", {}), ("booked", {"open_risks": [2.0], "correlation": 0.0}))])
    assert again["large", "extreme"]["survives"] and again["booked", "extreme"]["survives"]
    drawdowns = [got["booked", s]["projected_r"] for s in stress.SCENARIOS]
    assert drawdowns == sorted(drawdowns)
    assert not got["wounded", "stress"]["survives"]
    row = got["small", "stress"]
    assert row["severe_streak"] > row["typical_streak"] and abs(row["streak_r"] - row["severe_streak"] * row["assumed_loss_r"]) < 1e-9


def test_what_is_unknown_is_no_approval(spark):
    got = evaluated(spark, measured("nobook", open_risks=None), measured("half", open_risks=[1.0, None]), measured("few", trades=29, wins=20), measured("noloss", average_loss_r=None), measured("badr", r_value_pct=0.0), measured("full", current_drawdown_pct=0.1), measured("young", calibrated=False))
    for name in ("nobook", "half"):
        assert got[name, "base"]["survives"] is None and got[name, "base"]["verdict"] == "reduce" and got[name, "base"]["drawdown_probability"] is None
    assert got["few", "base"]["refused"] == "trades" and got["few", "base"]["verdict"] == "reduce" and got["few", "base"]["ruin_state"] is None
    assert got["noloss", "base"]["refused"] == "average_loss" and got["badr", "base"]["refused"] == "inputs"
    assert got["full", "base"]["breaches"] == ["ceiling"] and got["full", "base"]["verdict"] == "block"
    assert got["young", "base"]["ruin_state"] == "refused" and got["young", "base"]["ruin_probability"] is None


def test_ruin_is_certain_negligible_or_a_number(spark):
    got = evaluated(spark, measured("losing", average_win_r=0.5), measured("deep", r_value_pct=0.0005), measured("bold", r_value_pct=0.2))
    assert got["losing", "base"]["ruin_state"] == "certain" and got["losing", "base"]["ruin_probability"] == 1.0 and "expectancy" in got["losing", "base"]["warnings"]
    assert got["deep", "base"]["ruin_state"] == "negligible" and got["deep", "base"]["ruin_probability"] is None
    assert got["bold", "base"]["ruin_state"] == "measured" and 0 < got["bold", "base"]["ruin_probability"] < 1


def test_the_report_takes_the_worst(spark):
    frame = spark.createDataFrame([measured("fine", r_value_pct=0.0005), measured("block", r_value_pct=0.02)], ACCOUNT)
    got = {r["account"]: r for r in stress.report(stress.evaluate(frame)).collect()}
    assert got["fine"]["cleared"] and got["block"]["verdict"] == "block" and not got["block"]["cleared"]


STATE = {
    "account": "a", "day": "2024-01-05", "starting_balance": 100_000.0, "balance": None, "equity": 100_000.0, "day_balance": None, "day_equity": 100_000.0, "days_traded": 5, "peak_balance": 100_000.0, "peak_equity": 100_000.0, "profit_total": 0.0, "profit_best": 0.0,
    "open_positions": 0, "leverage_now": 1.0, "in_news_window": False, "weekend_ahead": False, "currency_per_r": 1000.0, "proposed_r": 1.0, "basis": "equity", "allowance_basis": "starting", "trailing": False,
}
NOT_IMPOSED, UNKNOWN = (False, None), (True, None)


def checked(spark, rules, **state):
    row = STATE | state
    kinds = ", ".join(f"{k} {'string' if isinstance(STATE[k], str) else 'boolean' if isinstance(STATE[k], bool) else 'int' if isinstance(STATE[k], int) else 'double'}" for k in row)
    given = {n: NOT_IMPOSED for n in accounts.RULES} | rules
    frame = spark.createDataFrame([(*row.values(), *given.values())], kinds + "".join(f", {n} struct<imposed:boolean,value:double>" for n in given))
    return accounts.check(frame).first().asDict()


DRAWDOWNS = {"daily_drawdown": (True, 0.05), "total_drawdown": (True, 0.10)}


def test_unknown_and_not_imposed_are_opposites(spark):
    assert checked(spark, {})["verdict"] == "approve" and checked(spark, {})["most_additional_r"] is None
    blocked = checked(spark, {n: UNKNOWN for n in accounts.RULES})
    assert blocked["verdict"] == "block" and not blocked["allowed"] and "daily_drawdown" in blocked["unchecked"]
    assert checked(spark, {"daily_drawdown": (True, 0.0)})["verdict"] == "block"


def test_anchors_of_the_total_drawdown(spark):
    at = {"equity": 105_000.0, "peak_equity": 108_000.0, "day_equity": 105_000.0}
    floors = [checked(spark, DRAWDOWNS, **at, trailing=t)["total_floor"] for t in (False, True, None)]
    assert floors == [90_000.0, 98_000.0, 98_000.0]
    assert checked(spark, DRAWDOWNS, equity=106_000.0, day_equity=106_000.0, trailing=True)["total_floor"] == 96_000.0  # a stale peak gives no rope
    assert checked(spark, DRAWDOWNS, equity=89_000.0, day_equity=89_500.0)["status"] == "failed"


def test_a_loss_in_full_is_projected_first(spark):
    found = checked(spark, DRAWDOWNS, equity=95_600.0)
    assert found["survivable"] is False and found["verdict"] == "reduce" and "daily_spent" in found["warnings"] and abs(found["most_additional_r"] - 0.54) < 1e-9
    assert checked(spark, DRAWDOWNS, currency_per_r=None)["verdict"] == "block"
    assert checked(spark, DRAWDOWNS, proposed_r=None)["verdict"] == "approve" and checked(spark, DRAWDOWNS, proposed_r=-1.0)["verdict"] == "block"
    assert checked(spark, DRAWDOWNS, basis="balance")["gates"] == ["daily_unmeasured", "total_unmeasured"]


def test_gates_targets_and_consistency(spark):
    assert checked(spark, {"news": (True, 0.0)}, in_news_window=None)["gates"] == ["news"] and checked(spark, {"positions": (True, 3.0)}, open_positions=3)["gates"] == ["position_cap"]
    assert checked(spark, {"positions": (True, 3.0)}, open_positions=4)["status"] == "failed"
    done = {"target": (True, 0.1), "least_days": (True, 4.0)}
    assert checked(spark, done, balance=110_000.0)["status"] == "passed" and checked(spark, done, balance=110_000.0, days_traded=3)["status"] == "in_progress"
    fair = done | {"day_share": (True, 0.5)}
    assert checked(spark, fair, balance=110_000.0, profit_total=10_000.0, profit_best=6_000.0)["status"] == "in_progress"
    assert checked(spark, fair, balance=110_000.0, profit_total=10_000.0, profit_best=4_000.0)["status"] == "passed"
    assert checked(spark, {}, starting_balance=0.0)["verdict"] == "block"


def test_rates_of_the_journal_need_samples_about_it(spark):
    def rows(*groups):
        return [(f'{{"outcome":"{o}","r_multiple":{r},"invalidation_triggered":{i}}}',) for n, o, r, i in groups for _ in range(n)]

    def summary(*groups):
        return journal.summarise(journal.opened(spark.createDataFrame(rows(*groups) + [(None,), ("{broken",)], "after string"))).first()

    few = summary((19, "win", 1.0, "true"))
    assert not few["available"] and few["entries"] == 21 and few["open_entries"] == 2
    mixed = summary((15, "win", 2.0, "true"), (5, "loss", -1.0, "false"), (10, "abandoned", "null", "null"))
    assert mixed["win_rate"] == 0.75 and mixed["average_r"] == 1.25 and mixed["average_r_coverage"] == 1.0 and mixed["triggered_share"] == 0.75 and mixed["unanticipated_losses"] == 5
    thin = summary((60, "win", "null", "null"), (20, "win", 1.0, "true"))
    assert thin["average_r"] is None and thin["triggered_share"] is None and thin["win_rate"] == 1.0
    assert not summary((25, "abandoned", "null", "null"))["available"]


def test_claims_need_all_five(spark):
    kinds = "trials int, hit_rate double, control_hit_rate double, expectancy_r double, control_expectancy_r double, cost_r double, comparisons int, measured_z double, pre_registered boolean, registered_on int, data_ends int"
    good = (1000, 0.6, 0.5, 0.3, 0.0, 0.05, 1, None, True, 1, 2)
    rows = [good, (*good[:7], 1.0, *good[8:]), (*good[:5], 0.5, *good[6:]), (*good[:8], False, 1, 1), (0, 0.6, 0.5, 0.3, 0.0, 0.05, 3, None, True, 1, 2)]
    got = [(r["proven"], r["failures"]) for r in evidence.gate(spark.createDataFrame(rows, kinds)).collect()]
    assert got == [(True, []), (False, ["significance"]), (False, ["costs"]), (False, ["registered", "forward"]), (False, ["significance"])]


@pytest.mark.parametrize(("date", "clock", "want"), [("08-16-2026", "10:30pm", "2026-08-16 22:30:00"), ("8-6-2026", " 12:05AM ", "2026-08-06 00:05:00"), ("08-16-2026", "12:00pm", "2026-08-16 12:00:00"), ("08-16-2026", "All Day", None), ("08-16-2026", "", None), ("2026-08-16", "1:00am", None), ("13-40-2026", "1:00am", None), ("08-16-2026", "13:00pm", None), (None, None, None)])
def test_release_times(spark, date, clock, want):
    row = spark.createDataFrame([(date, clock)], "d string, c string").select(calendar_feed.release_time(F.col("d"), F.col("c")).cast("string").alias("at")).first()
    assert row["at"] == want


def test_feed_reads_cdata_and_leaves_blank_titles_out(spark, tmp_path):
    (tmp_path / "w.xml").write_text("<weeklyevents><event><title><![CDATA[Rate & talk]]></title><country>usd</country><date>08-16-2026</date><time>8:30am</time><impact></impact><forecast></forecast></event><event><title> </title></event><event><title>Holiday</title><country>EUR</country><date>08-17-2026</date><time>All Day</time></event></weeklyevents>")
    got = [(r["title"], r["currency"], r["impact"], r["forecast"], r["all_day"]) for r in calendar_feed.releases(spark, str(tmp_path)).orderBy(F.col("at").asc_nulls_last()).collect()]
    assert got == [("Rate & talk", "USD", "Low", None, False), ("Holiday", "EUR", "Low", None, True)]


def test_orders_move_as_the_rules_say(spark):
    moves = {1: ["draft", "submitted", "unknown", "partially_filled", "filled"], 2: ["submitted"], 3: ["draft", "filled"], 4: ["draft", "submitted", "accepted", "rejected", "accepted"], 5: ["draft", "submitted", "filled"]}
    rows = spark.createDataFrame([(o, i, s) for o, states in moves.items() for i, s in enumerate(states)], "order_id int, at int, state string")
    assert sorted((r["order_id"], r["before"], r["state"]) for r in risk.illegal_moves(rows).collect()) == [(2, None, "submitted"), (3, "draft", "filled"), (4, "rejected", "accepted")]


def test_routing_counts_what_routes_list(spark):
    accounts_ = spark.createDataFrame([(1, False, True, [], 1.0), (2, False, True, ["X"], 0.5), (3, True, True, [], 9.0), (4, False, False, ["X"], 9.0), (5, False, True, ["Y"], 9.0), (6, None, True, None, 9.0), (7, False, True, None, 2.0)], "account int, killed boolean, enabled boolean, permitted array<string>, max_risk_r double")
    intents = spark.createDataFrame([(1, "X", 1.0), (2, "Y", 0.5), (3, "Z", 3.0)], "intent int, symbol string, risk_r double")
    got = {r["intent"]: tuple(r)[1:] for r in risk.routing(intents, accounts_).select("intent", "routed", *risk.SKIPS).collect()}
    assert got == {1: (2, 2, 1, 1, 1), 2: (3, 2, 1, 1, 0), 3: (0, 2, 1, 2, 2)}
    pairs = {(r["intent"], r["account"]): r["skipped"] for r in risk.route(intents, accounts_).collect()}
    assert pairs == {(1, 1): None, (1, 2): "ceiling", (1, 7): None, (2, 1): None, (2, 5): None, (2, 7): None, (3, 1): "ceiling", (3, 7): "ceiling"}


def test_clock_offsets_of_flat_and_lonely_series(spark):
    start = 1_700_000_000 // 3600 * 3600
    hours = lambda n, f: [("X", start + 3600 * i, f(i)) for i in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, "symbol string, s long, close double").select("symbol", F.timestamp_seconds("s").alias("event_time"), "close")
    flat = clock_offset(frame(hours(300, lambda i: 1.0)), frame(hours(300, lambda i: 1.0)), 3600).first()
    assert flat["lag"] is None and flat["certain"] is False
    moved = frame([("X", s + 2 * 3600, c) for _, s, c in hours(300, lambda i: float(i * i % 97))])
    found = clock_offset(frame(hours(300, lambda i: float(i * i % 97))), moved, 3600).first()
    assert found["lag"] == 2 and found["certain"] is True
    one = clock_offset(frame(hours(300, float)), moved, 3600, lags=range(2, 3)).first()
    assert one["lag"] == 2 and one["certain"] is True
