"""Queries over accounts: stress scenarios, survivable size, account rules and the decision journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as rules
from ..operators import journal, risk, stress
from ..sources import bars as B
from ..sources import calendar_feed
from ..sources.shared import fresh_folder
from .registry import query, rounded

# Accounts are nations: their orders are trades, won above and lost below a price; what is known of them differs by number.
_ACCOUNTS = """t AS (SELECT c_nationkey AS n, (o_totalprice - 120000) / 60000 AS r FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % (1 + c_nationkey % 4) = 0),
ac AS (SELECT concat('N', n) AS account, count(*) AS trades, count(CASE WHEN r > 0 THEN 1 END) AS wins, avg(CASE WHEN r > 0 THEN r END) AS average_win_r, -avg(CASE WHEN r < 0 THEN r END) AS average_loss_r, n % 4 <> 3 AS calibrated, CASE WHEN n = 24 THEN 0.0 ELSE 0.001 + n % 5 * 0.002 END AS r_value_pct, n % 11 * 0.01 AS current_drawdown_pct,
 CASE WHEN n % 6 = 0 THEN NULL WHEN n % 6 = 1 THEN [1.0::DOUBLE, NULL] ELSE list_transform(range(n % 4), lambda i: CAST(0.5 * (i + 1) AS DOUBLE)) END AS open_risks, CASE WHEN n % 3 <> 0 THEN 0.2 END AS correlation, CASE WHEN n % 5 <> 0 THEN 2 + n % 3 END AS trades_per_day FROM t GROUP BY n)"""


def accounts(spark, sf_dir):
    n = F.col("n")
    trades = B.table(spark, sf_dir, "orders").join(B.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n")), F.col("o_custkey") == F.col("c_custkey"))
    trades = trades.where(F.col("o_orderkey") % (1 + n % 4) == 0).select("n", ((F.col("o_totalprice") - 120000) / 60000).alias("r"))
    r = F.col("r")
    rows = trades.groupBy("n").agg(F.count(F.lit(1)).alias("trades"), F.count_if(r > 0).alias("wins"), F.avg(F.when(r > 0, r)).alias("average_win_r"), (-F.avg(F.when(r < 0, r))).alias("average_loss_r"))
    book = F.when(n % 6 == 0, None).when(n % 6 == 1, F.array(F.lit(1.0), F.lit(None))).when(n % 4 > 0, F.transform(F.sequence(F.lit(1), (n % 4).cast("int")), lambda i: i * 0.5)).otherwise(F.array().cast("array<double>"))
    return rows.select(F.concat(F.lit("N"), n.cast("string")).alias("account"), "trades", "wins", "average_win_r", "average_loss_r", (n % 4 != 3).alias("calibrated"), F.when(n == 24, 0.0).otherwise(0.001 + n % 5 * 0.002).alias("r_value_pct"), (n % 11 * 0.01).alias("current_drawdown_pct"), book.cast("array<double>").alias("open_risks"), F.when(n % 3 != 0, 0.2).alias("correlation"), F.when(n % 5 != 0, 2 + n % 3).cast("int").alias("trades_per_day"))


_SCENARIO_ROWS = ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, (a, b, c, d) in stress.SCENARIOS.items())
_STRESS = f"""{_ACCOUNTS}, sc(scenario, times, less, shock, chance) AS (VALUES {_SCENARIO_ROWS}),
e0 AS (SELECT ac.*, sc.*, open_risks IS NOT NULL AND len(list_filter(open_risks, lambda x: x IS NULL)) = 0 AS known, {stress.CEILING} - current_drawdown_pct AS remaining, CASE WHEN trades >= {stress.LEAST_TRADES} THEN wins / trades END AS win FROM ac, sc),
e1 AS (SELECT *, CASE WHEN known THEN coalesce(list_sum(open_risks), 0.0) END AS gross, CASE WHEN known THEN coalesce(list_sum(list_transform(open_risks, lambda x: x * x)), 0.0) END AS squares, CASE WHEN len(open_risks) >= 2 AND correlation IS NOT NULL THEN correlation + shock * (1 - correlation) ELSE 1.0 END AS rho,
 CASE WHEN r_value_pct <= 0 THEN 'inputs' WHEN win IS NULL THEN 'trades' WHEN average_loss_r IS NULL THEN 'average_loss' END AS refused FROM e0),
e2 AS (SELECT *, round(gross * times, 6) AS open_loss_r, round(sqrt((1 - rho) * squares + rho * gross * gross) * times, 6) AS correlated_loss_r, CASE WHEN refused IS NULL THEN least(1.0, greatest(0.0, win + less)) END AS aw, CASE WHEN refused IS NULL THEN average_loss_r * times END AS al FROM e1),
dp AS (SELECT account, scenario, aw, s, 0 AS step, list_transform(range(s), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS run, 0.0::DOUBLE AS hit FROM e2, LATERAL (SELECT unnest(range(1, {stress.HORIZON + 1})) AS s) WHERE aw IS NOT NULL
 UNION ALL SELECT account, scenario, aw, s, step + 1, list_prepend(list_sum(run) * aw, list_transform(run[1:s - 1], lambda x: x * (1 - aw))), hit + run[s] * (1 - aw) FROM dp WHERE step < {stress.HORIZON}),
pr AS (SELECT account, scenario, s, hit FROM dp WHERE step = {stress.HORIZON}),
lo AS (SELECT account, scenario, coalesce(max(CASE WHEN hit >= {stress.TYPICAL_P} THEN s END), 0) AS typical_streak, coalesce(max(CASE WHEN hit >= {stress.SEVERE_P} THEN s END), 0) AS severe_streak FROM pr GROUP BY 1, 2),
e3 AS (SELECT e2.*, typical_streak, severe_streak, CASE WHEN chance = {stress.TYPICAL_P} THEN typical_streak ELSE severe_streak END * al AS streak_r, remaining / nullif(r_value_pct, 0) - coalesce(open_loss_r, 0.0) AS room FROM e2 LEFT JOIN lo USING (account, scenario)),
e4 AS (SELECT e3.*, streak_r + open_loss_r AS projected_r, (streak_r + open_loss_r) * r_value_pct AS projected_pct, CASE WHEN open_loss_r IS NULL THEN CASE WHEN streak_r * r_value_pct >= remaining THEN false END ELSE (streak_r + open_loss_r) * r_value_pct < remaining END AS survives,
 CASE WHEN refused IS NULL THEN CASE WHEN room <= 0 THEN 1.0 WHEN ceil(room / al) > {stress.HORIZON} THEN 0.0 ELSE hit END END AS reach FROM e3 LEFT JOIN pr ON pr.account = e3.account AND pr.scenario = e3.scenario AND pr.s = CAST(ceil(room / al) AS BIGINT)),
dl AS (SELECT account, scenario, least(1.0, sum(CASE WHEN (trades_per_day - k) * average_win_r - k * al <= -{stress.DAILY_LIMIT_R} THEN factorial(CAST(trades_per_day AS INTEGER)) / (factorial(CAST(k AS INTEGER)) * factorial(CAST(trades_per_day - k AS INTEGER))) * pow(aw, trades_per_day - k) * pow(1 - aw, k) ELSE 0.0 END)) AS daily FROM e4, LATERAL (SELECT unnest(range(trades_per_day + 1)) AS k) WHERE aw IS NOT NULL AND average_win_r > 0 GROUP BY 1, 2),
rb AS (SELECT account, scenario, aw, average_win_r / al AS b, 0.0::DOUBLE AS lo, (1 - 1e-9)::DOUBLE AS hi, 0 AS k FROM e4 WHERE aw IS NOT NULL AND average_win_r > 0 UNION ALL SELECT account, scenario, aw, b, CASE WHEN aw * pow((lo + hi) / 2, 1 + b) - (lo + hi) / 2 + (1 - aw) > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN aw * pow((lo + hi) / 2, 1 + b) - (lo + hi) / 2 + (1 - aw) > 0 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM rb WHERE k < 100),
rr AS (SELECT account, scenario, b, (lo + hi) / 2 AS root FROM rb WHERE k = 100),
e5 AS (SELECT e4.*, CASE WHEN known THEN reach END AS drawdown_probability, daily, CASE WHEN refused IS NULL THEN CASE WHEN NOT calibrated OR b IS NULL OR aw >= 1 THEN 'refused' WHEN aw * b - (1 - aw) <= 0 THEN 'certain' WHEN (1 - current_drawdown_pct) / (r_value_pct * al) * ln(root) < ln({stress.LEAST_RUIN}) THEN 'negligible' ELSE 'measured' END END AS ruin_state, least(1.0, exp((1 - current_drawdown_pct) / (nullif(r_value_pct, 0) * al) * ln(root))) AS rp,
 survives = false AND open_loss_r IS NOT NULL AND streak_r > 0 AS asked, remaining - open_loss_r * r_value_pct AS spare FROM e4 LEFT JOIN dl USING (account, scenario) LEFT JOIN rr USING (account, scenario)),
e6 AS (SELECT *, CASE ruin_state WHEN 'certain' THEN 1.0 WHEN 'measured' THEN rp END AS ruin_probability, CASE WHEN asked AND spare > 0 AND floor(spare * {stress.SURVIVABLE_MARGIN} / streak_r * 1000000) > 0 THEN floor(spare * {stress.SURVIVABLE_MARGIN} / streak_r * 1000000) / 1000000 END AS survivable_pct FROM e5),
e7 AS (SELECT *, list_filter([CASE WHEN refused IS DISTINCT FROM 'inputs' AND remaining <= 0 THEN 'ceiling' END, CASE WHEN refused IS DISTINCT FROM 'inputs' AND remaining > 0 AND open_loss_r * r_value_pct >= remaining THEN 'open_book' END, CASE WHEN NOT survives AND remaining > 0 THEN 'projection' END], lambda x: x IS NOT NULL) AS breaches,
 list_filter([CASE WHEN len(open_risks) >= 2 AND correlation IS NULL THEN 'correlation' END, CASE WHEN NOT known THEN 'book' END, CASE WHEN list_max(open_risks) / nullif(gross, 0) > {stress.MOST_SHARE} THEN 'concentration' END, CASE WHEN refused IS NULL AND average_win_r / average_loss_r * win <= 1 - win THEN 'expectancy' END, CASE WHEN reach >= {stress.DRAWDOWN_WARNING} THEN 'drawdown' END,
  CASE WHEN refused IS NULL AND (trades_per_day IS NULL OR average_win_r IS NULL) THEN 'daily_unknown' END, CASE WHEN daily >= {stress.DAILY_WARNING} THEN 'daily' END, CASE WHEN ruin_state = 'measured' AND rp >= {stress.RUIN_WARNING} THEN 'ruin' END, CASE WHEN asked AND survivable_pct IS NULL THEN 'no_size' END], lambda x: x IS NOT NULL) AS warnings FROM e6),
e8 AS (SELECT *, CASE WHEN len(breaches) > 0 THEN 'block' WHEN refused IS NOT NULL OR len(warnings) > 0 OR survives IS NULL THEN 'reduce' ELSE 'approve' END AS verdict FROM e7)"""
_STRESS_ROUND = ("assumed_win_rate", "assumed_loss_r", "streak_r", "projected_r", "projected_pct", "drawdown_probability", "daily_loss_probability", "ruin_probability")


@query(f"""WITH RECURSIVE {_STRESS} SELECT account, scenario, verdict, refused IS NULL AS available, refused, round(aw, 6) AS assumed_win_rate, round(al, 6) AS assumed_loss_r, CAST(typical_streak AS INTEGER) AS typical_streak, CAST(severe_streak AS INTEGER) AS severe_streak, round(streak_r, 6) AS streak_r, open_loss_r, correlated_loss_r, round(projected_r, 6) AS projected_r, round(projected_pct, 6) AS projected_pct, survives,
 round(drawdown_probability, 6) AS drawdown_probability, round(daily, 6) AS daily_loss_probability, ruin_state, round(ruin_probability, 6) AS ruin_probability, array_to_string(breaches, ',') AS breaches, array_to_string(warnings, ',') AS warnings FROM e8""")
def stress_scenarios(spark, sf_dir):
    out = stress.evaluate(accounts(spark, sf_dir)).withColumns({c: F.array_join(c, ",") for c in ("breaches", "warnings")})
    return rounded(out.drop("survivable_pct"), *_STRESS_ROUND)


@query(f"""WITH RECURSIVE {_STRESS} SELECT account, CASE WHEN bool_or(verdict = 'block') THEN 'block' WHEN bool_or(verdict = 'reduce') THEN 'reduce' ELSE 'approve' END AS verdict, bool_and(refused IS NULL AND coalesce(survives, false) AND len(breaches) = 0) AS cleared, min(survivable_pct) AS survivable_pct FROM e8 GROUP BY account""")
def survivable_size(spark, sf_dir):
    """Per account: the worst verdict, whether all scenarios are survived, and the size that survives the hardest."""
    return stress.report(stress.evaluate(accounts(spark, sf_dir)))


# Account days are days on which a customer ordered; what its rulebook says differs by customer.
def account_days(spark, sf_dir):
    c, n = F.col("c"), F.col("orders")
    orders = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c"), F.col("o_orderdate").cast("date").alias("day")).agg(F.sum(F.floor((F.col("o_totalprice") - 140000) / 100)).cast("double").alias("profit"), F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("k"))
    start = F.when(c % 50 == 0, 0.0).otherwise(10000.0)
    from pyspark.sql import Window

    w = Window.partitionBy("c").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = orders.withColumn("starting_balance", start).withColumn("balance", F.col("starting_balance") + F.sum("profit").over(w)).withColumn("day_balance", F.col("balance") - F.col("profit"))
    days = days.withColumn("equity", F.col("balance") + (F.col("k") % 7 - 3) * 50).withColumn("day_equity", F.col("day_balance") + (F.col("k") % 5 - 2) * 40).withColumn("account", c)
    days = rules.with_history(days).withColumn("balance", F.when(c % 17 != 0, F.col("balance")))
    rule = rules.rule
    return days.withColumns({
        "open_positions": (F.col("k") % 5).cast("int"), "leverage_now": F.when(c % 9 != 0, (F.col("k") % 33).cast("double")), "in_news_window": F.when(F.col("k") % 8 != 0, F.col("k") % 4 == 1), "weekend_ahead": F.when(F.col("k") % 10 != 0, F.dayofweek("day") == 6), "currency_per_r": F.when(c % 8 != 0, 100.0),
        "proposed_r": F.when(c % 6 != 0, 0.5 + c % 3 * 2.5), "basis": F.when(c % 2 == 0, "balance").otherwise("equity"), "allowance_basis": F.when(c % 3 == 0, "starting").when(c % 3 == 1, "current"), "trailing": F.when(c % 5 < 2, True).when(c % 5 < 4, False),
        "daily_drawdown": rule(F.when(c % 13 != 0, 0.05), c % 12 != 0), "total_drawdown": rule(F.when(c % 14 != 0, 0.10), c % 4 != 1), "leverage": rule(F.when(c % 15 != 0, 30.0), c % 2 == 0), "positions": rule(F.lit(3), c % 3 != 0), "news": rule(F.lit(0), c % 4 == 0), "weekend": rule(F.lit(0), c % 5 == 0),
        "least_days": rule(F.lit(4)), "most_days": rule(F.when(c % 16 != 0, 12), c % 3 == 1), "target": rule(F.lit(0.1)), "day_share": rule(F.lit(0.5), c % 2 == 1),
    })


_DAYS = f"""d0 AS (SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS day, CAST(sum(floor((o_totalprice - 140000) / 100)) AS DOUBLE) AS profit, max(o_orderkey) AS k FROM orders GROUP BY 1, 2),
d1 AS (SELECT *, CASE WHEN c % 50 = 0 THEN 0.0 ELSE 10000.0 END::DOUBLE AS start, sum(profit) OVER w AS cum, count(*) OVER w AS days_traded, max(profit) OVER w AS best FROM d0 WINDOW w AS (PARTITION BY c ORDER BY day ROWS UNBOUNDED PRECEDING)),
d2 AS (SELECT *, start + cum AS bal, start + cum - profit AS day_balance, start + cum + (k % 7 - 3) * 50 AS equity, start + cum - profit + (k % 5 - 2) * 40 AS day_equity FROM d1),
d3 AS (SELECT *, coalesce(max(bal) OVER w, start) AS peak_b, coalesce(max(equity) OVER w, start) AS peak_e, CASE WHEN c % 17 <> 0 THEN bal END AS balance FROM d2 WINDOW w AS (PARTITION BY c ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d4 AS (SELECT *, CASE WHEN c % 2 = 0 THEN balance ELSE equity END AS ref, CASE WHEN c % 2 = 0 THEN day_balance ELSE day_equity END AS opening, CASE WHEN c % 2 = 0 THEN peak_b ELSE peak_e END AS peak0, c % 12 <> 0 AS di, c % 4 <> 1 AS ti, CASE WHEN c % 13 <> 0 THEN 0.05 END::DOUBLE AS dp, CASE WHEN c % 14 <> 0 THEN 0.10 END::DOUBLE AS tp, k % 5 AS pos, CASE WHEN c % 9 <> 0 THEN k % 33 END AS lev, c % 2 = 0 AND c % 15 <> 0 AS li, c % 3 = 1 AND c % 16 <> 0 AS mi,
 CASE WHEN c % 6 <> 0 THEN 0.5 + c % 3 * 2.5 END::DOUBLE AS ask, c % 8 <> 0 AS priced FROM d3),
d5 AS (SELECT *, greatest(peak0, ref) AS peak, CASE WHEN c % 3 = 0 THEN start WHEN c % 3 = 1 THEN coalesce(ref, start) ELSE least(start, ref) END AS base FROM d4),
d6 AS (SELECT *, CASE WHEN c % 5 < 2 THEN peak WHEN c % 5 < 4 THEN start ELSE greatest(peak, start) END AS anchor, CASE WHEN di AND dp IS NOT NULL AND ref IS NOT NULL THEN round_even(dp * base, 2) END AS da, CASE WHEN ti AND tp IS NOT NULL AND ref IS NOT NULL THEN round_even(tp * base, 2) END AS ta FROM d5),
d7 AS (SELECT *, CASE WHEN da IS NOT NULL THEN round_even(opening - da, 2) END AS df, CASE WHEN ta IS NOT NULL THEN round_even(anchor - ta, 2) END AS tf FROM d6),
d8 AS (SELECT *, greatest(0.0, ref - df) AS dr, CASE WHEN tf IS NOT NULL THEN greatest(0.0, ref - tf) END AS tr, di AND df IS NULL AS dopen, ti AND tf IS NULL AS topen, round_even(balance, 2) >= round_even(start * 1.1, 2) AS met, CASE WHEN c % 2 = 1 AND days_traded >= {rules.CONSISTENCY_DAYS} AND cum > 0 THEN best / cum <= 0.5 END AS fair FROM (SELECT * REPLACE (CASE WHEN df IS NULL THEN NULL ELSE df END AS df) FROM d7)),
d9 AS (SELECT *, CASE WHEN df IS NOT NULL THEN dr END AS daily_room, list_filter([CASE WHEN ref < df THEN 'daily' END, CASE WHEN ref < tf THEN 'total' END, CASE WHEN li AND lev > 30 THEN 'leverage' END, CASE WHEN c % 3 <> 0 AND pos > 3 THEN 'positions' END, CASE WHEN mi AND days_traded > 12 THEN 'days' END], lambda x: x IS NOT NULL) AS breaches,
 list_filter([CASE WHEN dopen THEN 'daily_unmeasured' END, CASE WHEN topen THEN 'total_unmeasured' END, CASE WHEN li AND lev IS NULL THEN 'leverage_unmeasured' END, CASE WHEN li AND lev = 30 THEN 'leverage_cap' END, CASE WHEN c % 3 <> 0 AND pos = 3 THEN 'position_cap' END, CASE WHEN c % 4 = 0 AND (k % 8 = 0 OR k % 4 = 1) THEN 'news' END, CASE WHEN c % 5 = 0 AND (k % 10 = 0 OR isodow(day) = 5) THEN 'weekend' END], lambda x: x IS NOT NULL) AS gates,
 list_filter([CASE WHEN NOT coalesce(ref < df, false) AND (opening - ref) / nullif(da, 0) >= {rules.SPENT_WARNING} AND da > 0 THEN 'daily_spent' END, CASE WHEN NOT coalesce(ref < tf, false) AND (anchor - ref) / nullif(ta, 0) >= {rules.SPENT_WARNING} AND ta > 0 THEN 'total_spent' END, CASE WHEN li AND lev < 30 AND lev >= 22.5 THEN 'leverage_near' END, CASE WHEN c % 5 = 0 AND k % 10 <> 0 AND isodow(day) = 5 AND pos > 0 THEN 'weekend_close' END, CASE WHEN mi AND days_traded = 12 THEN 'last_day' END, CASE WHEN met THEN 'target_met' END, CASE WHEN NOT fair THEN 'inconsistent' END], lambda x: x IS NOT NULL) AS warnings,
 list_filter([CASE WHEN di AND dp IS NULL THEN 'daily_drawdown' END, CASE WHEN ti AND tp IS NULL THEN 'total_drawdown' END, CASE WHEN c % 2 = 0 AND c % 15 = 0 THEN 'leverage' END, CASE WHEN c % 3 = 1 AND c % 16 = 0 THEN 'most_days' END], lambda x: x IS NOT NULL) AS unchecked,
 CASE WHEN ask IS NULL THEN NULL WHEN NOT di AND NOT ti THEN true WHEN NOT priced OR ref IS NULL THEN NULL WHEN coalesce(ref - ask * 100 < df, false) OR coalesce(ref - ask * 100 < tf, false) THEN false WHEN dopen OR topen THEN NULL ELSE true END AS survivable, start <= 0 AS void FROM d8),
d10 AS (SELECT *, NOT (dopen OR topen OR (least(daily_room, tr) IS NOT NULL AND NOT priced)) AS measurable, CASE WHEN NOT (dopen OR topen) AND priced THEN least(daily_room, tr) * {rules.SLIPPAGE_ROOM} / 100 END AS cap FROM d9),
d11 AS (SELECT *, CASE WHEN void OR len(breaches) > 0 OR len(gates) > 0 OR NOT measurable THEN 'block' WHEN ask IS NULL THEN 'approve' WHEN survivable IS NULL THEN 'block' WHEN NOT survivable THEN CASE WHEN cap > 0 THEN 'reduce' ELSE 'block' END WHEN cap IS NULL THEN 'approve' WHEN cap <= 0 THEN 'block' WHEN cap < ask THEN 'reduce' ELSE 'approve' END AS verdict FROM d10)"""


@query(f"""WITH {_DAYS} SELECT c AS account, day, CASE WHEN void THEN 'in_progress' WHEN len(breaches) > 0 THEN 'failed' WHEN met AND days_traded >= 4 AND (c % 2 = 0 OR coalesce(fair, false)) THEN 'passed' ELSE 'in_progress' END AS status, verdict <> 'block' AS allowed, verdict, round(CASE WHEN verdict = 'block' THEN 0.0 ELSE cap END, 6) AS most_additional_r,
 CASE WHEN NOT void THEN round(df, 6) END AS daily_floor, CASE WHEN NOT void THEN round(tf, 6) END AS total_floor, CASE WHEN NOT void THEN survivable END AS survivable, CASE WHEN void THEN '' ELSE array_to_string(breaches, ',') END AS breaches, CASE WHEN void THEN '' ELSE array_to_string(gates, ',') END AS gates, CASE WHEN void THEN '' ELSE array_to_string(warnings, ',') END AS warnings, CASE WHEN void THEN '' ELSE array_to_string(unchecked, ',') END AS unchecked FROM d11""")
def account_rules(spark, sf_dir):
    """The rulebook's verdict on every account on each of its days."""
    out = rules.check(account_days(spark, sf_dir)).drop("daily_room", "total_room").withColumns({c: F.array_join(c, ",") for c in ("breaches", "gates", "warnings", "unchecked")})
    return rounded(out, "most_additional_r", "daily_floor", "total_floor")


_AFTER = """j AS (SELECT o_orderpriority AS source, o_orderkey % 10 AS m, (o_totalprice - 140000) / 60000 AS r, o_orderkey % 4 = 0 OR o_orderpriority > '3' AS has_r, o_orderkey % 3 = 0 OR o_orderpriority < '3' AS seen, o_orderkey % 6 < 3 AS fired FROM orders WHERE o_orderkey % 10 <> 8 OR o_orderpriority <> '5-LOW'),
a AS (SELECT source, m < 9 AS closed, CASE WHEN m < 4 THEN 'win' WHEN m < 7 THEN 'loss' WHEN m = 7 THEN 'breakeven' WHEN m = 8 THEN 'abandoned' END AS outcome, CASE WHEN m < 8 AND has_r THEN r END AS r, CASE WHEN m < 9 AND seen THEN fired END AS fired FROM j),
g AS (SELECT source, count(*) AS entries, count(*) FILTER (closed) AS closed, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'breakeven') AS breakeven, count(*) FILTER (outcome = 'abandoned') AS abandoned, count(r) AS r_sample, avg(r) AS ar, count(fired) AS assessed, count(*) FILTER (fired) AS fired, count(*) FILTER (outcome = 'loss' AND fired IS NOT NULL) AS la, count(*) FILTER (outcome = 'loss' AND NOT fired) AS ua FROM a GROUP BY 1),
q AS (SELECT *, closed >= 20 AND wins + losses >= 20 AS q1, closed >= 20 AND r_sample >= 20 AND coalesce(r_sample / nullif(closed - abandoned, 0) >= 0.5, false) AS q2, closed >= 20 AND assessed >= 20 AND assessed / closed >= 0.5 AS q3 FROM g)"""


@query(f"""WITH {_AFTER} SELECT source, entries, closed, wins, losses, breakeven, abandoned, r_sample, assessed AS invalidation_assessed, fired AS invalidation_triggered, la AS losses_assessed, ua AS unanticipated_losses, entries - closed AS open_entries, wins + losses AS decided, CASE WHEN q1 THEN round(wins / (wins + losses), 4) END AS win_rate, CASE WHEN q1 THEN round((wins + losses) / closed, 4) END AS win_rate_coverage,
 CASE WHEN q2 THEN round(ar, 4) END AS average_r, CASE WHEN q2 THEN round(r_sample / (closed - abandoned), 4) END AS average_r_coverage, CASE WHEN q3 THEN round(fired / assessed, 4) END AS triggered_share, CASE WHEN q3 THEN round(assessed / closed, 4) END AS triggered_coverage, q1 OR q2 OR q3 AS available FROM q""")
def journal_summary(spark, sf_dir):
    """Gated rates of a journal whose closings are JSON payloads, by where its prices come from."""
    k, source = F.col("o_orderkey"), F.col("o_orderpriority")
    m = k % 10
    outcome = F.when(m < 4, "win").when(m < 7, "loss").when(m == 7, "breakeven").otherwise("abandoned")
    fields = F.concat_ws(
        ",", F.concat(F.lit('"outcome":"'), outcome, F.lit('"')), F.when((m < 8) & ((k % 4 == 0) | (source > "3")), F.concat(F.lit('"r_multiple":'), ((F.col("o_totalprice") - 140000) / 60000).cast("string"))).otherwise('"r_multiple":"none"'),
        F.when((k % 3 == 0) | (source < "3"), F.concat(F.lit('"invalidation_triggered":'), (k % 6 < 3).cast("string"))),
    )
    rows = B.table(spark, sf_dir, "orders").where((m != 8) | (source != "5-LOW"))
    entries = rows.select(source.alias("source"), F.when(m < 9, F.concat(F.lit("{"), fields, F.lit("}"))).when(k % 20 == 9, "not json").alias("after"))
    return journal.summarise(journal.opened(entries), "source")


_FEED = """f AS (SELECT CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_type < 'd' THEN date_trunc('day', ts) + to_hours(CAST(8 + hour(ts) % 4 AS BIGINT)) + to_minutes(CAST(minute(ts) AS BIGINT)) ELSE date_trunc('minute', ts) END END AS released_at, concat('Release ', event_id) AS title, upper(event_type) AS currency,
 CASE WHEN event_id % 5 = 0 THEN 'Low' ELSE 'High' END AS impact, CASE WHEN event_id % 4 <> 0 THEN concat(event_id % 100, '%') END AS forecast FROM events WHERE event_id % 11 <> 0)"""


def feed(spark, sf_dir):
    """XML files of releases made from events, and read again."""
    n, at = F.col("event_id"), F.col("at")
    moved = F.timestamp_seconds(F.unix_timestamp(F.date_trunc("day", "ts")) + (8 + F.hour("ts") % 4) * 3600 + F.minute("ts") * 60)
    rows = B.table(spark, sf_dir, "events").withColumn("at", F.when(F.col("event_type") < "d", moved).otherwise(F.col("ts").cast("timestamp")))
    clock = F.when(n % 7 == 0, "All Day").otherwise(F.concat(F.lit(" "), F.lower(F.date_format(at, "h:mma"))))
    rows = rows.select(F.when(n % 11 != 0, F.concat(F.lit(" Release "), n.cast("string"))).otherwise(" ").alias("title"), F.col("event_type").alias("country"), F.date_format(at, "MM-dd-yyyy").alias("date"), clock.alias("time"), F.when(n % 5 == 0, "").otherwise("High").alias("impact"), F.when(n % 4 != 0, F.concat((n % 100).cast("string"), F.lit("%"))).otherwise("").alias("forecast"))
    path = fresh_folder(spark, "calendar")
    rows.write.format("xml").option("rootTag", "weeklyevents").option("rowTag", "event").save(path)
    return calendar_feed.releases(spark, path)


@query(f"WITH {_FEED} SELECT released_at, title, currency, impact, forecast, released_at IS NULL AS all_day FROM f")
def calendar_releases(spark, sf_dir):
    return feed(spark, sf_dir).drop("previous", "url").withColumnRenamed("at", "released_at")


@query(f"WITH {_FEED} SELECT currency, count(released_at) AS timed, count(DISTINCT hour(released_at)) AS hours, count(released_at) >= 20 AND count(DISTINCT hour(released_at)) < 6 AS doubtful FROM f GROUP BY 1")
def calendar_doubts(spark, sf_dir):
    return calendar_feed.clock_doubts(feed(spark, sf_dir), "currency")


_PLACES = ", ".join(f"('{n}', {h})" for n, h in calendar_feed.PLACES.items())


@query(f"WITH h AS (SELECT DISTINCT date_trunc('hour', ts) AS moment FROM events), p(name, o) AS (VALUES {_PLACES}, ('Broker server', 0.0)) SELECT moment, name, CAST(o AS DOUBLE) AS hours, strftime(moment + to_minutes(CAST(o * 60 AS BIGINT)), '%Y-%m-%d %H:%M') AS local FROM h, p WHERE name <> 'Broker server' OR hour(moment) % 2 = 0")
def zone_times(spark, sf_dir):
    hours = B.table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp").alias("moment")).distinct()
    each = hours.select("moment", F.explode(calendar_feed.local_times(F.col("moment"), F.when(F.hour("moment") % 2 == 0, 0.0))).alias("p"))
    return each.select("moment", "p.name", F.col("p.offset").alias("hours"), "p.local")


# Orders as intents: their numbers say which switch, approval or time is amiss.
@query("""WITH i AS (SELECT o_orderkey AS intent, o_orderkey % 31 <> 0 AS enabled, o_orderkey % 37 = 0 AS killed, o_orderkey % 41 <> 0 AS auth, o_orderkey % 6 AS m, o_orderkey % 9 - 1 AS age, 0.5 + o_orderkey % 3 * 0.5 AS risk_r, CASE WHEN o_orderkey % 43 = 0 THEN 'earlier' END AS earlier FROM orders),
b AS (SELECT intent, list_filter([CASE WHEN NOT enabled THEN 'execution_enabled' END, CASE WHEN killed THEN 'kill_switch_clear' END, CASE WHEN NOT auth THEN 'auth_required' END, CASE WHEN m = 1 THEN 'approved_by_portfolio' END, CASE WHEN m = 2 THEN 'approved_by_challenge' END, CASE WHEN age < -1 THEN 'authorisation_not_future_dated' END, CASE WHEN age > 5 THEN 'authorisation_fresh' END, CASE WHEN m = 3 THEN 'risk_approval_fresh' END, CASE WHEN risk_r > 1 THEN 'size_within_ceiling' END, CASE WHEN earlier IS NOT NULL THEN 'not_a_duplicate' END], lambda x: x IS NOT NULL) AS blocks FROM i)
SELECT intent, len(blocks) = 0 AS cleared, array_to_string(blocks, ',') AS blocks FROM b""")
def preflight_checks(spark, sf_dir):
    k, now = F.col("o_orderkey"), F.lit("2024-01-20 00:00:00").cast("timestamp")
    m, before = k % 6, lambda s: F.timestamp_seconds(F.unix_timestamp(now) - s)
    layer = lambda name, approved, late: F.struct(F.lit(name).alias("key"), F.struct(approved.alias("approved"), before(F.when(late, 60).otherwise(1)).alias("at")).alias("value"))
    yes, no = F.lit(True), F.lit(False)
    entries = F.array_compact(F.array(layer("risk", yes, m == 3), F.when(m != 1, layer("portfolio", yes, no)), layer("challenge", m != 2, no), layer("stress", yes, no)))
    rows = B.table(spark, sf_dir, "orders").select(k.alias("intent"), (k % 31 != 0).alias("enabled"), (k % 37 == 0).alias("killed"), (k % 41 != 0).alias("require_auth"), F.map_from_entries(entries).alias("approvals"), before(k % 9 - 1).alias("authorised_at"), (0.5 + k % 3 * 0.5).alias("risk_r"), F.lit(1.0).alias("max_risk_r"), F.when(k % 43 == 0, "earlier").alias("submitted_as"))
    return risk.preflight(rows, now).select("intent", "cleared", F.array_join("blocks", ",").alias("blocks"))
