"""Regime co-occurrence and scenario selection.

Regimes are long: (s, d, variable, state). Pair counts come from one self-join on the date; a pair
of variables is counted once, in name order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import align

POSSIBLE, AMBIGUITY = "Possible", "Ambiguity"

#: At most so many scenarios are broadcast.
BROADCAST_SCENARIOS = 10_000


def tercile_states(df: DataFrame, value: str, variable: str, by: Sequence[str] = ("s",)) -> DataFrame:
    """States 0, 1, 2 by the terciles of each series, as long regimes."""
    cuts = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_q"))
    x, q = F.col(value), F.col("_q")
    state = F.when(x <= q[0], 0).when(x <= q[1], 1).when(x.isNotNull(), 2)
    return df.join(cuts, list(by)).select(*by, "d", F.lit(variable).alias("variable"), state.alias("state")).filter("state is not null")


def lift_grade(n_ab: Column, lift: Column) -> Column:
    """Empirical support of a pair of states: none where they never meet, strong from a lift of 1."""
    return F.when(n_ab == 0, "none").when(lift.isNull(), "n/a").when(lift >= 1.0, "strong").otherwise("weak")


def pairwise_lift(regimes: DataFrame, key: Sequence[str] = ("s", "d")) -> DataFrame:
    """n_a, n_b, n_ab, t, lift and grade of every pair of states of every pair of variables.

    Pairs of observed states that never meet are there with a count of zero.
    """
    a = regimes.select(*key, F.col("variable").alias("var_a"), F.col("state").alias("state_a"))
    b = regimes.select(*key, F.col("variable").alias("var_b"), F.col("state").alias("state_b"))
    met = a.join(b, list(key)).filter("var_a < var_b").groupBy("var_a", "state_a", "var_b", "state_b").agg(F.count("*").alias("n_ab"))
    left = met.groupBy("var_a", "var_b", "state_a").agg(F.sum("n_ab").alias("n_a"))
    right = met.groupBy("var_a", "var_b", "state_b").agg(F.sum("n_ab").alias("n_b"))
    total = met.groupBy("var_a", "var_b").agg(F.sum("n_ab").alias("t"))
    every = left.join(right, ["var_a", "var_b"]).join(total, ["var_a", "var_b"])  # states x states of a pair, a few rows
    out = every.join(met, ["var_a", "state_a", "var_b", "state_b"], "left").withColumn("n_ab", F.coalesce("n_ab", F.lit(0)))
    lift = F.col("n_ab") * F.col("t") / (F.col("n_a") * F.col("n_b"))
    return out.withColumns({"lift": lift, "p_b_a": F.col("n_ab") / F.col("n_a"), "p_a_b": F.col("n_ab") / F.col("n_b")}).withColumn("grade", lift_grade(F.col("n_ab"), F.col("lift")))


def wide(regimes: DataFrame, variables: Sequence[str], key: Sequence[str] = ("s", "d")) -> DataFrame:
    """One column per variable; rows with a missing state are dropped."""
    return regimes.groupBy(*key).pivot("variable", list(variables)).agg(F.max("state")).dropna(subset=list(variables))


def joint_frequency(table: DataFrame, variables: Sequence[str]) -> DataFrame:
    """n and share of each combination of states that occurs."""
    n = table.groupBy(*variables).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")  # one row


def enumerate_combos(states: Mapping[str, Sequence[int]], spark) -> DataFrame:
    """Every combination of states: the label sets are small and given."""
    out = None
    for name, values in states.items():
        side = spark.createDataFrame([(int(v),) for v in values], f"{name} int")
        out = side if out is None else out.crossJoin(F.broadcast(side))
    return out


def pairs_of(combos: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Long (combo columns, var_a, state_a, var_b, state_b): the pairs of each combination."""
    names = sorted(variables)
    cells = [F.struct(F.lit(a).alias("var_a"), F.col(a).alias("state_a"), F.lit(b).alias("var_b"), F.col(b).alias("state_b")) for i, a in enumerate(names) for b in names[i + 1 :]]
    return combos.select(*variables, F.explode(F.array(*cells)).alias("p")).select(*variables, "p.*")


def complete_lifts(table: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Lifts of all pairs of observed states on the rows of a wide table, which are complete in all variables.

    One pass: the states of a row are unpivoted into its pairs, and marginals are sums of pair counts.
    """
    met = pairs_of(table, variables).groupBy("var_a", "state_a", "var_b", "state_b").agg(F.count("*").alias("n_ab"))
    left = met.groupBy("var_a", "var_b", "state_a").agg(F.sum("n_ab").alias("n_a"))
    right = met.groupBy("var_a", "var_b", "state_b").agg(F.sum("n_ab").alias("n_b"))
    total = met.groupBy("var_a", "var_b").agg(F.sum("n_ab").alias("t"))
    every = left.join(right, ["var_a", "var_b"]).join(total, ["var_a", "var_b"])  # states x states of a pair, a few rows
    out = every.join(met, ["var_a", "state_a", "var_b", "state_b"], "left").withColumn("n_ab", F.coalesce("n_ab", F.lit(0)))
    return out.withColumn("lift", F.col("n_ab") * F.col("t") / (F.col("n_a") * F.col("n_b")))


def translated(rows: DataFrame, columns: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """The rows with the labels of `columns` by their names in `names`; a label without one stays."""
    if not names:
        return rows
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return rows.withColumns({c: F.coalesce(F.try_element_at(table, F.col(c)), F.col(c)) for c in columns})


def combo_label(variables: Sequence[str]) -> Column:
    """The labels of a combination in one text."""
    return F.concat_ws("-", *(F.col(v).cast("string") for v in variables))


def both_ways(judgements: DataFrame) -> DataFrame:
    """Judged pairs (var_a, state_a, var_b, state_b, judgement) and the same with both sides changed."""
    swapped = judgements.select(F.col("var_b").alias("var_a"), F.col("state_b").alias("state_a"), F.col("var_a").alias("var_b"), F.col("state_a").alias("state_b"), "judgement")
    key = ["var_a", "state_a", "var_b", "state_b"]
    return judgements.select(*key, "judgement").unionByName(swapped).groupBy(*key).agg(F.min("judgement").alias("judgement"))  # of several, Ambiguity


def classify(combos: DataFrame, lifts: DataFrame, variables: Sequence[str], judgements: DataFrame | None = None) -> DataFrame:
    """mean_lift and class of each combination.

    With judged pairs, in either direction, a combination is Possible if all its pairs are judged
    so; a pair that is not listed is ambiguous, and the mean lift is for information. Without
    them, it is Possible from a mean lift of 1 on. Pairs without a lift are left out of the mean.
    """
    key = ["var_a", "state_a", "var_b", "state_b"]
    rows = pairs_of(combos, variables).join(lifts.select(*key, "lift"), key, "left")
    if judgements is None:
        good = F.coalesce(F.avg("lift") >= 1.0, F.lit(False))
    else:
        rows = rows.join(both_ways(judgements), key, "left")
        good = F.bool_and(F.coalesce(F.col("judgement") == POSSIBLE, F.lit(False)))
    return rows.groupBy(*variables).agg(F.avg("lift").alias("mean_lift"), F.when(good, POSSIBLE).otherwise(AMBIGUITY).alias("class"))


def rank_combos(classified: DataFrame, frequency: DataFrame, variables: Sequence[str]) -> DataFrame:
    """All combinations with n (zero if not seen), numbered by class, then frequency, then states."""
    out = classified.join(frequency.select(*variables, "n"), list(variables), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.orderBy("class", F.desc("n"), *variables)  # a table of label combinations, some dozens of rows
    return out.withColumn("no", F.row_number().over(w))


def greedy_diversity(ranked: DataFrame, variables: Sequence[str], most_shared: int | None = None, least: int = 1) -> DataFrame:
    """Scenarios S01, S02, ...: Possible combinations seen `least` times at least, the most frequent first.

    With `most_shared`, one is taken if it shares at most so many states with every one taken
    before; without it, all are. The rows are the combinations of a few labels.
    """
    ranked = ranked.filter(F.col("n") >= least)
    most_shared = len(variables) if most_shared is None else most_shared
    item = F.struct(F.col("no").alias("no"), F.array(*variables).alias("states"))
    rows = ranked.filter(F.col("class") == POSSIBLE).agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = "array<struct<no:int,states:array<int>>>"

    def shared(a: Column, b: Column) -> Column:
        return F.size(F.filter(F.zip_with(a["states"], b["states"], lambda x, y: x == y), lambda e: e))

    def step(taken: Column, one: Column) -> Column:
        fits = F.forall(taken, lambda old: shared(old, one) <= most_shared)
        return F.when(fits, F.concat(taken, F.array(one))).otherwise(taken)

    taken = rows.select(F.posexplode(F.aggregate("all", F.array().cast(kind), step)).alias("i", "p"))
    return taken.select(F.concat(F.lit("S"), F.lpad((F.col("i") + 1).cast("string"), 2, "0")).alias("scenario_id"), *(F.col("p.states")[k].alias(v) for k, v in enumerate(variables)))


def scenario_days(table: DataFrame, scenarios: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Rows of the wide table with the scenarios they match; a null state in a scenario is no constraint.

    A selection is broadcast. Of more scenarios, a row is sent once for each set of variables that
    any scenario constrains (at most two to the number of variables), and meets them by its states there.
    """
    s = scenarios.select("scenario_id", *(F.col(v).alias(f"_{v}") for v in variables))
    if s.limit(BROADCAST_SCENARIOS + 1).count() > BROADCAST_SCENARIOS:
        return _days_by_constraint(table, s, variables)
    on = None
    for v in variables:
        one = F.col(f"_{v}").isNull() | (F.col(f"_{v}") == F.col(v))
        on = one if on is None else on & one
    return table.join(F.broadcast(s), on).select(*table.columns, "scenario_id")


def _days_by_constraint(table: DataFrame, s: DataFrame, variables: Sequence[str]) -> DataFrame:
    bits = [F.when(F.col(f"_{v}").isNotNull(), 1 << i).otherwise(0) for i, v in enumerate(variables)]
    s = s.withColumn("_set", sum(bits[1:], bits[0]))
    sets = sorted(r["_set"] for r in s.select("_set").distinct().collect())  # at most two to the number of variables
    held = lambda i: F.col("_set").bitwiseAND(F.lit(1 << i)) != 0
    named = [f"_k{i}" for i in range(len(variables))]
    given = s.select("scenario_id", "_set", *(F.coalesce(F.col(f"_{v}"), F.lit(0)).alias(k) for v, k in zip(variables, named, strict=True)))
    rows = table.withColumn("_set", F.explode(F.array(*map(F.lit, sets))))
    for i, v in enumerate(variables):  # a day without a state matches no scenario that constrains it
        rows = rows.filter(~held(i) | F.col(v).isNotNull()).withColumn(named[i], F.when(held(i), F.col(v)).otherwise(0))
    return rows.join(given, ["_set", *named]).select(*table.columns, "scenario_id")


def scenario_diff(current: DataFrame, previous: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key and change (added, removed, changed, same) of two versions of a table."""
    c = current.select(F.col(key), F.struct(*columns).alias("_c"))
    p = previous.select(F.col(key), F.struct(*columns).alias("_p"))
    change = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.col("_c") == F.col("_p"), "same").otherwise("changed")
    return c.join(p, key, "full_outer").select(key, change.alias("change"))


def states_from_labels(rows: DataFrame, labels: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Scenario rows (scenario_id, one label column per variable) as states; rows with an unknown or missing label go.

    `labels` is (variable, label, state), the label sets of the fitted state counts.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("label")) for v in variables))).alias("p")
    found = rows.select("scenario_id", cells).select("scenario_id", "p.*").join(F.broadcast(labels), ["variable", "label"])  # a few labels a variable
    wide_rows = found.groupBy("scenario_id").pivot("variable", list(variables)).agg(F.max("state"))
    return wide_rows.dropna(subset=list(variables))


def regime_calendar(calendar: DataFrame, daily_states: DataFrame, weekly_states: DataFrame, variables: Sequence[str], by: Sequence[str] = ("s",)) -> DataFrame:
    """One state column per variable on a daily calendar: daily states by date, weekly ones as of the week before or at it."""
    out = calendar.select(*by, "d")
    for v in variables:
        day = daily_states.filter(F.col("variable") == v).select(*by, "d", F.col("state").alias(v))
        week = weekly_states.filter(F.col("variable") == v).select(*by, "d", F.col("state").alias(f"_{v}"))
        out = out.join(day, [*by, "d"], "left").join(align.asof_backward(calendar, week, f"_{v}", by), [*by, "d"], "left")
        out = out.withColumn(v, F.coalesce(v, f"_{v}")).drop(f"_{v}")
    return out


# The names of the states of a variable by their number; residuals have names of their own.
STATE_NAMES = {2: ("Low", "High"), 3: ("Low", "Mid", "High")}
RESIDUAL_NAMES = {2: ("Normal", "Extreme"), 3: ("Low", "Normal", "Extreme")}


def label_table(states: DataFrame, residuals: Sequence[str] = ()) -> DataFrame:
    """(variable, state, label) for the number of states that each variable has in long regimes; S0, S1, ... for other numbers."""
    out = None
    for kind, names in ((F.col("variable").isin(list(residuals)) if residuals else F.lit(False), RESIDUAL_NAMES), (~F.col("variable").isin(list(residuals)) if residuals else F.lit(True), STATE_NAMES)):
        k = states.filter(kind & F.col("state").isNotNull()).groupBy("variable").agg(F.count_distinct("state").alias("k"))
        table = F.create_map(*(x for n, labels in names.items() for x in (F.lit(n).cast("bigint"), F.array(*map(F.lit, labels)))))
        rows = k.select("variable", F.coalesce(F.try_element_at(table, F.col("k")), F.transform(F.sequence(F.lit(0), F.col("k").cast("int") - 1), lambda i: F.concat(F.lit("S"), i.cast("string")))).alias("labels"))
        part = rows.select("variable", F.posexplode("labels").alias("state", "label"))
        out = part if out is None else out.unionByName(part)
    return out


def labelled(table: DataFrame, labels: DataFrame, variables: Sequence[str]) -> DataFrame:
    """A wide table of states as labels; rows that lack a state go."""
    for v in variables:
        one = labels.filter(F.col("variable") == v).select(F.col("state").alias(v), F.col("label").alias("_label"))
        table = table.join(F.broadcast(one), v).withColumn(v, F.col("_label")).drop("_label")  # a few states
    return table.dropna(subset=list(variables))


def invalid_scenarios(scenarios: DataFrame, counts: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(scenario_id, variable, problem) of states that are missing, of an unknown variable, or outside 0 .. k - 1; `counts` is (variable, k)."""
    cells = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("state")) for v in variables))).alias("p")
    rows = scenarios.select("scenario_id", cells).select("scenario_id", "p.*").join(F.broadcast(counts), "variable", "full_outer")  # a row a variable
    problem = F.when(F.col("k").isNull(), "unknown variable").when(F.col("state").isNull(), "missing").when((F.col("state") < 0) | (F.col("state") >= F.col("k")), "out of range")
    return rows.select("scenario_id", "variable", problem.alias("problem")).filter("problem is not null")


def emissions(scenarios: DataFrame, fits: DataFrame, variables: Sequence[str], inverse: Mapping[str, str] | None = None) -> DataFrame:
    """(scenario_id, variable, mu, sigma, inverse): the emission of the state that a scenario names for each variable; `fits` is (variable, mu, sigma), lists by state."""
    names = F.create_map(*(F.lit(x) for v in variables for x in (v, (inverse or {}).get(v, "none"))))
    cells = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("state")) for v in variables))).alias("p")
    rows = scenarios.select("scenario_id", cells).select("scenario_id", "p.*").filter("state is not null").join(F.broadcast(fits.select("variable", F.col("mu").alias("_mu"), F.col("sigma").alias("_sigma"))), "variable")
    at = lambda c: F.try_element_at(F.col(c), F.col("state").cast("int") + 1)
    return rows.select("scenario_id", "variable", at("_mu").alias("mu"), at("_sigma").alias("sigma"), F.element_at(names, F.col("variable")).alias("inverse")).filter("mu is not null")


def comparison_table(rows: DataFrame, base: DataFrame) -> DataFrame:
    """The results of the scenarios (scenario_id and figures), rounded to 6 digits, with the base on top; position gives the order."""
    both = base.withColumns({"scenario_id": F.lit("Base"), "_n": F.lit(0)}).unionByName(rows.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    figures = [c for c, kind in both.dtypes if kind == "double"]
    w = Window.orderBy("_n", "scenario_id")  # a row a scenario
    return both.withColumn("position", F.row_number().over(w)).withColumns({c: F.round(c, 6) for c in figures}).drop("_n")


def summary_by_scenario(paths: DataFrame) -> DataFrame:
    """Mean and population deviation of every series of every scenario."""
    return paths.groupBy("scenario_id", "series").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
