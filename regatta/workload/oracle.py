"""The same queries as SQL text for an independent engine."""

from __future__ import annotations

from math import log, pi

MODULUS = 2147483647
FACTORS = (48271, 69621, 40692, 39373, 16807, 62089911, 630360016, 742938285)
SEED_FACTOR, ROUND_1, ROUND_2 = 950706376, 1226874159, 1343714438


def hash_sql(keys: list[str], seed: int, variant: int = 0) -> str:
    """The keyed hash of columns holding non-negative integers below the modulus."""
    start = (seed % MODULUS) * SEED_FACTOR % MODULUS
    terms = [f"((CAST({k} AS BIGINT) * {FACTORS[(i + variant) % 8]}) % {MODULUS})" for i, k in enumerate(keys)]
    mixed = f"(({start} + {' + '.join(terms)}) % {MODULUS})"
    for constant in (ROUND_1, ROUND_2):
        mixed = f"(({mixed} * ({mixed} + {constant})) % {MODULUS})"
    return mixed


def unit_sql(key: str, seed: int) -> str:
    return f"(CAST({hash_sql([key], seed)} AS DOUBLE) / CAST({MODULUS} AS DOUBLE))"


THRESHOLD = int(MODULUS * 0.2)
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LK = ", ".join(LINE_KEYS)
RK = LK + ", l_extendedprice"


def fold_sql(keys: list[str], seed: int, k: int) -> str:
    h = hash_sql(keys, seed)
    return f"CASE WHEN {h} >= {THRESHOLD} THEN CAST((({h} - {THRESHOLD}) * {k}) // {MODULUS - THRESHOLD} AS INT) END"


def test_sql(keys: list[str], seed: int) -> str:
    return f"({hash_sql(keys, seed)} < {THRESHOLD})"


DAMAGED = f"""SELECT {LK}, l_quantity, l_discount, l_tax,
  CASE WHEN l_partkey % 7 = 0 OR l_partkey % 23 = 0 THEN NULL ELSE l_extendedprice END AS price,
  CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_returnflag END AS flag, l_linestatus
FROM lineitem"""

GAPS = """SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price
FROM orders"""

REPEATED = f"""SELECT o_orderkey, o_orderstatus, priority, CAST(floor(price / 10000) AS BIGINT) AS bucket
FROM ({GAPS}) WHERE price IS NOT NULL"""

DISTINCT = f"""SELECT min(o_orderkey) AS o_orderkey, o_orderstatus, priority, bucket
FROM ({REPEATED}) GROUP BY o_orderstatus, priority, bucket"""

SPARSE = """SELECT p_partkey, p_brand, p_size, p_retailprice, 'fixed' AS one_value,
  CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 7 END AS one_value_and_gaps,
  CASE WHEN p_partkey % 10 < 2 THEN NULL ELSE p_size END AS fifth_missing,
  CASE WHEN p_partkey % 10 < 3 THEN NULL ELSE p_size END AS third_missing
FROM part"""

SCORED = """SELECT *, l_quantity * 3 - l_discount * 200
  + CAST((l_partkey * 31 + l_suppkey * 17) % 101 AS DOUBLE) / 10.0 AS y FROM lineitem"""

FAMILY = """CASE o_orderpriority WHEN '1-URGENT' THEN 'RF' WHEN '2-HIGH' THEN 'LGB'
  WHEN '3-MEDIUM' THEN 'LR' WHEN '4-NOT SPECIFIED' THEN 'SVR' WHEN '5-LOW' THEN 'NN' END"""

STAND_IN = f"""SELECT {FAMILY} || '_Exp1_mse_' || o_orderkey AS model_id, {FAMILY} AS model_name,
  CAST(o_orderkey AS INT) AS iteration, o_orderstatus AS target, 'none' AS target_transform,
  CAST(o_custkey % 50 AS INT) AS n_trials,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 500000 END AS test_R2,
  o_totalprice AS test_MSE,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 10 END AS test_MAE,
  o_totalprice / 2 AS train_MSE, o_totalprice / 3 AS best_MSE,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey * CAST(1.25 AS DOUBLE) END AS optimization_time,
  'mse' AS score, '{{"alpha":' || o_custkey || '}}' AS best_params
FROM orders"""

PREDICTED = f"""SELECT {RK}, l_returnflag, l_linestatus, l_extendedprice AS label,
  l_extendedprice * (1 - l_discount) + l_partkey % 50 AS prediction FROM lineitem"""

R2 = """CASE WHEN var_pop(label) > 0
  THEN 1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*)) ELSE 0 END"""

EXTRA = f"""avg(abs(label - prediction)) AS "MAE",
  avg((label - prediction) * (label - prediction)) AS "MSE",
  sqrt(avg((label - prediction) * (label - prediction))) AS "RMSE",
  {R2} AS "R2",
  sqrt(avg(pow(ln(1 + abs(prediction)) - ln(1 + abs(label)), 2))) AS "RMSLE",
  avg(abs((label - prediction) / nullif(label, 0))) AS "MAPE" """

PERFORMANCE = f"""SELECT model_name, metric, split, avg(value) AS mean, stddev_pop(value) AS std FROM (
  UNPIVOT (SELECT l_returnflag AS model_name,
      CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'val' END AS split,
      l_linenumber % 3 AS fold, {EXTRA}
    FROM ({PREDICTED}) GROUP BY ALL)
  ON "MAE", "MSE", "RMSE", "R2", "RMSLE", "MAPE" INTO NAME metric VALUE value)
GROUP BY model_name, metric, split"""

ORDER_FOLDS = f"""SELECT *, o_totalprice / 1000 + o_custkey % 100 AS y,
  {fold_sql(['o_orderkey'], 42, 5)} AS fold FROM orders"""

# simple regression per held-out fold: fitted on the other training folds
FOLD_MODELS = f"""SELECT f.fold, regr_slope(t.y, t.o_totalprice) AS slope,
    regr_intercept(t.y, t.o_totalprice) AS intercept
  FROM (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f JOIN ({ORDER_FOLDS}) t
    ON t.fold IS NOT NULL AND t.fold <> f.fold GROUP BY f.fold"""

FOLD_SCORED = f"""SELECT t.fold, t.y AS label, m.intercept + m.slope * t.o_totalprice AS prediction
  FROM ({ORDER_FOLDS}) t JOIN ({FOLD_MODELS}) m ON t.fold = m.fold"""

FOLD_SCORES = f"""SELECT fold, count(*) AS n,
  avg((label - prediction) * (label - prediction)) AS mse, avg(abs(label - prediction)) AS mae,
  {R2} AS r2 FROM ({FOLD_SCORED}) GROUP BY fold"""


def two_feature_fit(source: str, a: str, b: str, y: str) -> str:
    """Least squares with two features in closed form: ``ca, cb, c0``."""
    return f"""SELECT ca, cb, my - ca * ma - cb * mb AS c0, ma, mb FROM (
      SELECT *, (say * vb - sby * sab) / (va * vb - sab * sab) AS ca,
        (sby * va - say * sab) / (va * vb - sab * sab) AS cb FROM (
        SELECT var_pop({a}) AS va, var_pop({b}) AS vb, covar_pop({a}, {b}) AS sab,
          covar_pop({a}, {y}) AS say, covar_pop({b}, {y}) AS sby,
          avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my FROM ({source})))"""


def f_score(source: str, feature: str, ordinal: int, y: str) -> str:
    x = f"CAST({feature} AS DOUBLE)"
    return f"""SELECT '{feature}' AS feature, {ordinal} AS ordinal,
      CASE WHEN stddev_pop({x}) = 0 THEN 0.0
      ELSE round(pow(corr({x}, {y}), 2) / (1 - pow(corr({x}, {y}), 2)) * (count(*) - 2), 4) END AS score
      FROM ({source})"""


F_SCORES = " UNION ALL ".join(
    f_score(SCORED, f, i, "y")
    for i, f in enumerate(["l_extendedprice", "l_quantity", "l_tax", "l_discount"])
)


def binned(feature: str, ordinal: int) -> str:
    levels = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
    return f"""SELECT '{feature}' AS feature, {ordinal} AS ordinal, round(greatest(
        sum(n / total * ln(n * total / (nx * ny))), 0.0), 6) AS score FROM (
      SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER () AS DOUBLE) AS total,
        CAST(sum(n) OVER (PARTITION BY bx) AS DOUBLE) AS nx,
        CAST(sum(n) OVER (PARTITION BY bt) AS DOUBLE) AS ny FROM (
        SELECT len(list_filter(list_distinct(ex), lambda e: {feature} > e)) AS bx,
          len(list_filter(list_distinct(ey), lambda e: y > e)) AS bt, count(*) AS n
        FROM ({SCORED}) CROSS JOIN (SELECT quantile_cont({feature}, {levels}) AS ex,
          quantile_cont(y, {levels}) AS ey FROM ({SCORED})) GROUP BY bx, bt))"""


def yj(power: float) -> str:
    up = "ln(1 + y)" if power == 0 else f"(pow(y + 1, {power}) - 1) / {power}"
    down = "-ln(1 - y)" if power == 2 else f"-(pow(1 - y, {2 - power}) - 1) / {2 - power}"
    return f"CASE WHEN y >= 0 THEN {up} ELSE {down} END"


def yj_row(power: float) -> str:
    return f"""SELECT CAST({power} AS DOUBLE) AS power, count(*) AS n, round(avg(t), 5) AS mean,
      round(var_pop(t), 5) AS variance,
      round(-count(*) / 2.0 * ln(var_pop(t)) + ({power} - 1) * sum(sign(y) * ln(1 + abs(y))), 5) AS loglik
      FROM (SELECT y, {yj(power)} AS t FROM (SELECT c_acctbal / 1000 AS y FROM customer))"""


def hms(x: str) -> str:
    s = f"CAST(trunc({x}) AS BIGINT)"
    return f"printf('%d:%02d:%02d', {s} // 3600, ({s} % 3600) // 60, {s} % 60)"


def sampled_int(u: str, low: int, high: int, step: int = 1) -> str:
    count = (high - low) // step + 1
    return f"CAST({low} + {step} * floor({u} * {count}) AS INT)"


def sampled_log(u: str, low: float, high: float) -> str:
    return f"exp({log(low)!r} + {u} * ({log(high)!r} - ({log(low)!r})))"


def neighbour_information(feature: str, ordinal: int) -> str:
    """The nearest-neighbour estimator by brute force over all pairs."""
    return f"""SELECT '{feature}' AS feature, {ordinal} AS ordinal, (
      WITH v AS (SELECT c_custkey AS id, c_acctbal, c_acctbal / 100 + ((c_custkey * 37) % 101) * CAST(0.731 AS DOUBLE) AS y,
          c_acctbal * (1 + c_custkey % 7) AS mixed FROM customer),
        p AS (SELECT id, {feature} / (SELECT stddev_pop({feature}) FROM v) AS x,
          y / (SELECT stddev_pop(y) FROM v) AS y FROM v),
        r AS (SELECT a.id, a.x, a.y, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3] AS r
          FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id, a.x, a.y),
        c AS (SELECT r.id, count(*) FILTER (WHERE abs(r.x - p.x) < r.r) AS nx,
          count(*) FILTER (WHERE abs(r.y - p.y) < r.r) AS ny FROM r CROSS JOIN p GROUP BY r.id),
        h AS (SELECT m, -0.5772156649015329 + coalesce(sum(1.0 / (m - 1)) FILTER (WHERE m > 1)
          OVER (ORDER BY m), 0) AS psi FROM range(1, (SELECT count(*) + 1 FROM v)) t(m))
      SELECT round(greatest((SELECT psi FROM h WHERE m = (SELECT count(*) FROM v))
          + (SELECT psi FROM h WHERE m = 3) - avg(hx.psi) - avg(hy.psi), 0), 4)
      FROM c JOIN h hx ON hx.m = c.nx JOIN h hy ON hy.m = c.ny) AS score"""


def jittered_information() -> str:
    """The same over values that tie, each moved by a normal number that its key gives."""
    def moved(c: str, salt: int) -> str:
        one, two = (f"(({hash_sql(['c_custkey'], 2 * salt + i)} + 0.5) / {float(MODULUS)!r})" for i in (0, 1))
        size = f"(1e-10::DOUBLE * greatest(1, (SELECT avg(abs({c})) / stddev_pop({c}) FROM v)))"
        return f"""{c}::DOUBLE / (SELECT stddev_pop({c}) FROM v)
          + sqrt(-2.0::DOUBLE * ln({one})) * cos({2 * pi!r}::DOUBLE * {two}) * {size}"""

    return f"""WITH v AS (SELECT c_custkey, ((c_custkey * 37) % 20)::DOUBLE AS step,
          ((c_custkey * 37) % 20 * 2 + (c_custkey * 11) % 7)::DOUBLE AS signal FROM customer),
        p AS (SELECT c_custkey AS id, {moved("step", 0)} AS x, {moved("signal", 1)} AS y FROM v),
        r AS (SELECT a.id, a.x, a.y, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3] AS r
          FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id, a.x, a.y),
        c AS (SELECT r.id, count(*) FILTER (WHERE abs(r.x - p.x) < r.r) AS nx,
          count(*) FILTER (WHERE abs(r.y - p.y) < r.r) AS ny FROM r CROSS JOIN p GROUP BY r.id),
        h AS (SELECT m, -0.5772156649015329 + coalesce(sum(1.0 / (m - 1)) FILTER (WHERE m > 1)
          OVER (ORDER BY m), 0) AS psi FROM range(1, (SELECT count(*) + 1 FROM v)) t(m))
      SELECT 'step' AS feature, 0 AS ordinal, round(greatest((SELECT psi FROM h WHERE m = (SELECT count(*) FROM v))
          + (SELECT psi FROM h WHERE m = 3) - avg(hx.psi) - avg(hy.psi), 0), 3) AS score
      FROM c JOIN h hx ON hx.m = c.nx JOIN h hy ON hy.m = c.ny"""


def stump(source: str, feature: str, y: str) -> str:
    """The best two-way split: ``cut`` (left is <= cut) and the means of both sides."""
    return f"""SELECT v AS cut, nl_sum / nl AS low, (t - nl_sum) / (n - nl) AS high FROM (
        SELECT v, sum(c) OVER (ORDER BY v) AS nl, sum(s) OVER (ORDER BY v) AS nl_sum,
          sum(c) OVER () AS n, sum(s) OVER () AS t FROM (
          SELECT {feature} AS v, count(*) AS c, sum({y}) AS s FROM ({source}) GROUP BY {feature}))
      WHERE nl < n ORDER BY nl_sum * nl_sum / nl + (t - nl_sum) * (t - nl_sum) / (n - nl) DESC, v LIMIT 1"""


STUMP_1 = f"""SELECT s.*, CASE WHEN l_quantity <= cut THEN low ELSE high END AS f1
  FROM ({SCORED}) s, ({stump(SCORED, 'l_quantity', 'y')})"""

ONE_FEATURE = f"""SELECT *, {test_sql(LINE_KEYS, 42)} AS is_test, {fold_sql(LINE_KEYS, 42, 5)} AS fold FROM (
  SELECT {LK}, l_quantity AS x, y, row_number() OVER (PARTITION BY l_quantity, y ORDER BY {LK}) AS rn
  FROM ({SCORED})) WHERE rn = 1"""


def part_metrics(source: str) -> str:
    return f"""SELECT avg((label - prediction) * (label - prediction)) AS mse,
      avg(abs(label - prediction)) AS mae, {R2} AS r2 FROM ({source})"""


STUMP_ROWS = f"""SELECT {LK}, l_quantity, y, {test_sql(LINE_KEYS, 42)} AS is_test,
  {fold_sql(LINE_KEYS, 42, 3)} AS fold FROM ({SCORED})"""
STUMP_TRAIN = f"SELECT * FROM ({STUMP_ROWS}) WHERE NOT is_test"


def split_metrics(predicted: str, family: str) -> str:
    """Metrics of training and test rows, as the model queries return them."""
    return f"""SELECT is_test, count(*) AS n, round(avg((label - prediction) * (label - prediction)), 6) AS mse,
      round(avg(abs(label - prediction)), 6) AS mae, round({R2}, 6) AS r2, '{family}' AS model_name
      FROM ({predicted}) GROUP BY is_test"""


def boosted_sql(rounds: int, rate: float) -> str:
    """``label, prediction`` of boosted stumps: from the mean, rate times each stump."""
    out = f"SELECT *, (SELECT avg(y) FROM ({STUMP_TRAIN})) AS f FROM ({STUMP_ROWS})"
    for _ in range(rounds):
        residuals = f"SELECT *, y - f AS r FROM ({out}) WHERE NOT is_test"
        out = f"""SELECT d.* EXCLUDE (f), f + {rate} * CASE WHEN l_quantity <= s.cut THEN s.low ELSE s.high END AS f
          FROM ({out}) d, ({stump(residuals, 'l_quantity', 'r')}) s"""
    return f"SELECT *, y AS label, f AS prediction FROM ({out})"


def penalised_sql(rounds: int, rate: float, l1: float, l2: float, least: int, gain: float) -> str:
    """``label, prediction`` of boosted stumps whose sums are shrunk before they become values."""
    def shrunk(total: str) -> str:
        return f"(sign({total}) * greatest(abs({total}) - {l1}, 0))"

    def score(total: str, n: str) -> str:
        return f"({shrunk(total)} * {shrunk(total)} / ({n} + {l2}))"

    out = f"SELECT *, (SELECT avg(y) FROM ({STUMP_TRAIN})) AS f FROM ({STUMP_ROWS})"
    for _ in range(rounds):
        cuts = f"""SELECT v, sum(c) OVER (ORDER BY v) AS nl, sum(s) OVER (ORDER BY v) AS l, sum(c) OVER () AS n,
          sum(s) OVER () AS t FROM (SELECT l_quantity AS v, count(*) AS c, sum(y - f) AS s FROM ({out})
          WHERE NOT is_test GROUP BY l_quantity)"""
        best = f"""SELECT v AS cut, {shrunk("l")} / (nl + {l2}) AS low, {shrunk("(t - l)")} / (n - nl + {l2}) AS high
          FROM (SELECT *, {score("l", "nl")} + {score("(t - l)", "(n - nl)")} - {score("t", "n")} AS gain FROM ({cuts}))
          WHERE nl >= {least} AND n - nl >= {least} AND gain > {gain} ORDER BY gain DESC, v LIMIT 1"""
        out = f"""SELECT d.* EXCLUDE (f), f + {rate} * CASE WHEN l_quantity <= s.cut THEN s.low ELSE s.high END AS f
          FROM ({out}) d, ({best}) s"""
    return f"SELECT *, y AS label, f AS prediction FROM ({out})"


STUMP_MODEL = f"""SELECT d.*, y AS label, CASE WHEN l_quantity <= s.cut THEN s.low ELSE s.high END AS prediction
  FROM ({STUMP_ROWS}) d, ({stump(STUMP_TRAIN, 'l_quantity', 'y')}) s"""


def fold_part(f: int) -> str:
    """Rows of the training table under the stump and the line learned without fold ``f``."""
    others = f"SELECT * FROM ({STUMP_ROWS}) WHERE fold <> {f}"
    return f"""SELECT d.*, {f} AS left_out, y AS label,
      CASE WHEN l_quantity <= s.cut THEN s.low ELSE s.high END AS rf, b + a * l_quantity AS lr
      FROM ({STUMP_ROWS}) d, ({stump(others, 'l_quantity', 'y')}) s,
      (SELECT regr_slope(y, l_quantity) AS a, regr_intercept(y, l_quantity) AS b FROM ({others})) WHERE fold IS NOT NULL"""


STUMP_FOLDS = " UNION ALL ".join(f"({fold_part(f)})" for f in range(3))

SVR_U = [unit_sql("o_orderkey", 9000 + i) for i in range(9)]
XGB_U = [unit_sql("o_orderkey", 2000 + i) for i in range(12)]
NN_U = [unit_sql("c_custkey", 4000 + i) for i in range(4)]

LINES = """SELECT conv_id, turn, role, CAST(p AS INT) - 1 AS pos, parts[p] AS line FROM (
  SELECT conv_id, turn, role, parts, unnest(range(1, len(parts) + 1)) AS p FROM (
    SELECT conv_id, turn, role, string_split(text, chr(10)) AS parts FROM conversations))"""

ROUNDED_PERF = """model_name, metric, split, round(mean, 5) AS mean, round(std, 5) AS std"""

ORACLE: dict[str, str] = {
    "clean_sentinels": DAMAGED,
    "clean_recast_numeric": """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL
        ELSE CAST(o_custkey AS DOUBLE) END AS custkey FROM orders""",
    "missing_profile": f"""SELECT * FROM (
        SELECT 'price' AS column_name, round(100 * avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END), 2) AS missing_pct FROM ({DAMAGED})
        UNION ALL SELECT 'flag', round(100 * avg(CASE WHEN flag IS NULL THEN 1.0 ELSE 0.0 END), 2) FROM ({DAMAGED}))
        WHERE missing_pct > 0""",
    "drop_missing_target": f"SELECT * FROM ({GAPS}) WHERE price IS NOT NULL",
    "drop_columns": f"SELECT o_orderkey, o_orderstatus, priority, price FROM ({GAPS})",
    "drop_duplicate_rows": DISTINCT,
    "drop_duplicate_rows_digest": DISTINCT,
    "duplicate_count": f"SELECT (SELECT count(*) FROM ({REPEATED})) - (SELECT count(*) FROM ({DISTINCT})) AS duplicates",
    "composite_target": f"""SELECT {RK}, l_quantity, l_discount, l_tax,
        round(l_quantity + l_discount + l_tax, 6) AS total FROM lineitem WHERE l_partkey % 6 <> 0""",
    "row_sum_skipna": f"""SELECT {RK}, l_quantity, l_discount, t AS l_tax,
        round(l_quantity + l_discount + coalesce(t, 0), 6) AS total FROM (
        SELECT *, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_tax END AS t FROM lineitem)""",
    "drop_leaky": "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part",
    "column_stats": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, m AS missing_fraction, k AS constant, (m <= 0.2 AND NOT k) AS kept
        FROM (SELECT round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS m,
              count(DISTINCT {c}) = 1 AS k FROM ({SPARSE}))"""
        for c in ("p_partkey", "p_brand", "p_size", "p_retailprice", "one_value",
                  "one_value_and_gaps", "fifth_missing", "third_missing")
    ),
    "prune_columns": f"SELECT p_partkey, p_brand, p_size, p_retailprice, fifth_missing FROM ({SPARSE})",
    "impute_median": f"""SELECT {LK}, round(coalesce(p, median(p) OVER ()), 6) AS price,
        round(coalesce(q, median(q) OVER ()), 6) AS quantity FROM (
        SELECT {LK}, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS p,
          CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem)""",
    "impute_mode": f"""SELECT o_orderkey, o_orderstatus, coalesce(priority, (
        SELECT priority FROM ({GAPS}) WHERE priority IS NOT NULL GROUP BY priority
        ORDER BY count(*) DESC, priority LIMIT 1)) AS priority FROM ({GAPS})""",
    "one_hot": f"""SELECT {RK}, l_returnflag = 'A' AS "l_returnflag_A", l_returnflag = 'N' AS "l_returnflag_N",
        l_returnflag = 'R' AS "l_returnflag_R", l_linestatus = 'F' AS "l_linestatus_F",
        l_linestatus = 'O' AS "l_linestatus_O" FROM lineitem""",
    "prepare_full": f"""WITH d AS (SELECT *, CASE WHEN l_orderkey % 4 = 0 THEN l_discount END AS mostly_gaps
          FROM ({DAMAGED}) WHERE l_orderkey % 17 <> 0),
        u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_quantity, l_discount, price, flag,
            l_linestatus, mostly_gaps ORDER BY {LK}) AS rn FROM d) WHERE rn = 1),
        s AS (SELECT median(price) AS mid FROM u),
        m AS (SELECT flag AS mode FROM u WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1),
        f AS (SELECT u.*, coalesce(price, mid) AS p, coalesce(flag, mode) AS g FROM u, s, m)
        SELECT {LK}, l_quantity, l_discount, round(p, 6) AS price, g = 'A' AS "flag_A", g = 'N' AS "flag_N",
          g = 'R' AS "flag_R", l_linestatus = 'F' AS "l_linestatus_F", l_linestatus = 'O' AS "l_linestatus_O" FROM f""",
    "step_audit": f"""SELECT position, step, n_rows, CAST(n_cols AS INT) AS n_cols FROM (WITH k AS (SELECT * FROM ({GAPS}) WHERE price IS NOT NULL),
        n AS (SELECT (SELECT count(*) FROM ({GAPS})) AS a, (SELECT count(*) FROM k) AS b,
          (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, priority, price FROM k)) AS c)
        SELECT 0 AS position, 'load' AS step, a AS n_rows, 6 AS n_cols FROM n
        UNION ALL SELECT 1, 'drop_missing_target', b, 6 FROM n
        UNION ALL SELECT 2, 'drop_columns', b, 4 FROM n
        UNION ALL SELECT 3, 'drop_duplicate_rows', c, 4 FROM n
        UNION ALL SELECT 4, 'prune_sparse_columns', c, 4 - (SELECT CASE WHEN avg(CASE WHEN priority IS NULL THEN 1.0 ELSE 0.0 END) > 0.2 THEN 1 ELSE 0 END
          FROM (SELECT DISTINCT o_orderstatus, priority, price FROM k)) FROM n
        UNION ALL SELECT 5, 'prune_constant_columns', c, 4 - (SELECT CASE WHEN avg(CASE WHEN priority IS NULL THEN 1.0 ELSE 0.0 END) > 0.2 THEN 1 ELSE 0 END
          FROM (SELECT DISTINCT o_orderstatus, priority, price FROM k)) FROM n
        UNION ALL SELECT 6, 'impute', c, 4 - (SELECT CASE WHEN avg(CASE WHEN priority IS NULL THEN 1.0 ELSE 0.0 END) > 0.2 THEN 1 ELSE 0 END
          FROM (SELECT DISTINCT o_orderstatus, priority, price FROM k)) FROM n
        UNION ALL SELECT 7, 'one_hot', c, 2 + (SELECT count(DISTINCT o_orderstatus) FROM k)
          + (SELECT CASE WHEN avg(CASE WHEN priority IS NULL THEN 1.0 ELSE 0.0 END) > 0.2 THEN 0 ELSE count(DISTINCT priority) END
          FROM (SELECT DISTINCT o_orderstatus, priority, price FROM k)) FROM n)""",
    "split_features_target": "SELECT * FROM part",
    "preview": "SELECT * FROM customer ORDER BY c_custkey LIMIT 5",
    "rename_columns": """SELECT p_partkey, p_name, p_brand AS "Brand", p_type, p_size AS "Size", p_retailprice FROM part""",
    "select_present": "SELECT p_size, p_partkey FROM part",
    "f_regression": F_SCORES,
    "f_regression_encoded": " UNION ALL ".join(
        f_score(
            """SELECT l_quantity, l_tax, CAST(l_returnflag = 'A' AS INT) AS "l_returnflag_A",
            CAST(l_returnflag = 'N' AS INT) AS "l_returnflag_N",
            CAST(l_returnflag = 'R' AS INT) AS "l_returnflag_R", 1.0 AS constant FROM lineitem""",
            f, i, "l_quantity",
        )
        for i, f in enumerate(["l_tax", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R", "constant"])
    ),
    "select_top_k": f"SELECT * FROM ({F_SCORES}) ORDER BY score DESC, ordinal LIMIT 2",
    "project_features": f"SELECT {LK}, round(y, 6) AS y, l_quantity, l_discount FROM ({SCORED})",
    "mutual_info_bins": " UNION ALL ".join(
        binned(f, i) for i, f in enumerate(["l_extendedprice", "l_quantity", "l_tax", "l_discount"])
    ),
    "mutual_info_neighbour": neighbour_information("c_acctbal", 0)
    + " UNION ALL " + neighbour_information("mixed", 1),
    "train_test_split": f"SELECT o_orderkey, o_totalprice, {test_sql(['o_orderkey'], 42)} AS is_test FROM orders",
    "split_counts": f"""SELECT {test_sql(LINE_KEYS, 7)} AS is_test, count(*) AS n, sum(l_quantity) AS quantity
        FROM lineitem GROUP BY 1""",
    "kfold": f"""SELECT o_orderkey, {test_sql(['o_orderkey'], 42)} AS is_test,
        {fold_sql(['o_orderkey'], 42, 5)} AS fold FROM orders""",
    "kfold_exact": f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql(['o_orderkey'], 3)},
          {hash_sql(['o_orderkey'], 3, 3)}) AS i, count(*) OVER () AS n FROM orders),
        t AS (SELECT o_orderkey, ntile(7) OVER (ORDER BY i) - 1 AS fold FROM r WHERE i > ceil(n * 0.2))
        SELECT r.o_orderkey, i <= ceil(n * 0.2) AS is_test, CAST(fold AS INT) AS fold
        FROM r LEFT JOIN t ON r.o_orderkey = t.o_orderkey""",
    "kfold_sizes": """WITH n AS (SELECT count(*) AS n, CAST(ceil(count(*) * 0.2) AS BIGINT) AS t FROM customer)
        SELECT true AS is_test, CAST(NULL AS INT) AS fold, t AS n FROM n
        UNION ALL SELECT false, CAST(f AS INT), (n.n - t) // 7 + CASE WHEN f < (n.n - t) % 7 THEN 1 ELSE 0 END
        FROM n, range(7) r(f)""",
    "repeat_seeds": f"SELECT c_custkey AS session_id FROM customer ORDER BY {hash_sql(['c_custkey'], 5)}, c_custkey LIMIT 10",
    "repeat_experiments": """SELECT CAST(e AS INT) AS experiment, CAST(s AS BIGINT) AS session_id, p_partkey, p_size
        FROM part CROSS JOIN (VALUES (1, 17), (2, 4242), (3, 9001)) v(e, s)""",
    "robust_scale": """SELECT c_custkey, round((c_acctbal - a[2]) / (a[3] - a[1]), 6) AS c_acctbal,
        round((c_nationkey - b[2]) / (b[3] - b[1]), 6) AS c_nationkey,
        CASE WHEN c_custkey % 10 = 0 THEN 1.0 ELSE 0.0 END AS mostly_zero
        FROM customer, (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS a,
          quantile_cont(CAST(c_nationkey AS DOUBLE), [0.25, 0.5, 0.75]) AS b FROM customer)""",
    "target_log": """SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log_price,
        round(o_totalprice, 4) AS price_back FROM orders""",
    "yeo_johnson_grid": " UNION ALL ".join(
        yj_row(p) for p in (-1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5)
    ),
    "yeo_johnson_round_trip": "SELECT c_custkey, round(c_acctbal / 1000, 6) AS y FROM customer",
    "linreg_fit": """SELECT p_partkey, round(b + a * p_partkey, 6) AS prediction FROM part,
        (SELECT regr_slope(p_retailprice, p_partkey) AS a, regr_intercept(p_retailprice, p_partkey) AS b FROM part)""",
    "model_store": """SELECT p_partkey, round(b + a * p_partkey, 6) AS prediction FROM part,
        (SELECT regr_slope(p_retailprice, p_partkey) AS a, regr_intercept(p_retailprice, p_partkey) AS b FROM part)""",
    "diagnostics_store": f"""WITH c AS ({two_feature_fit(SCORED, 'l_quantity', 'l_discount', 'y')})
        SELECT 'l_discount' AS feature, 'Discount / %' AS label, replace(regexp_replace('Discount / %', '[^a-z A-Z0-9_.-]', '_', 'g'), ' ', '_') AS item, l_discount AS feature_value,
          round(cb * (l_discount - mb), 6) AS shap_value FROM lineitem, c
        UNION ALL SELECT 'l_quantity', 'l_quantity', 'l_quantity', l_quantity, round(ca * (l_quantity - ma), 6) FROM lineitem, c""",
    "read_by_key": "SELECT * FROM customer",
    "rename_map": """SELECT c_custkey, CASE WHEN n_nationkey = 0 THEN '0' ELSE n_name END AS label
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "linreg_two_features": f"""SELECT {LK}, round(y, 6) AS y,
        round(c0 + ca * l_quantity + cb * l_discount, 6) AS prediction
        FROM ({SCORED}), ({two_feature_fit(SCORED, 'l_quantity', 'l_discount', 'y')})""",
    "linreg_fold_models": f"""SELECT o_orderkey, t.fold, round(coalesce(m.intercept, a.b) + coalesce(m.slope, a.a) * o_totalprice, 5) AS prediction
        FROM ({ORDER_FOLDS}) t LEFT JOIN ({FOLD_MODELS}) m ON t.fold = m.fold,
        (SELECT regr_slope(y, o_totalprice) AS a, regr_intercept(y, o_totalprice) AS b
         FROM ({ORDER_FOLDS}) WHERE fold IS NOT NULL) a""",
    "linreg_cv": "SELECT " + ", ".join(
        f"round({fn}({m}), 6) AS {m}_{p}"
        for m in ("mse", "mae", "r2") for p, fn in (("mean", "avg"), ("std", "stddev_pop"))
    ) + f" FROM ({FOLD_SCORES})",
    "fold_scores": f"SELECT fold, n, round(mse, 6) AS mse, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM ({FOLD_SCORES})",
    "regression_metrics": f"""SELECT l_returnflag, l_linestatus, count(*) AS n,
        round(avg((label - prediction) * (label - prediction)), 5) AS mse,
        round(avg(abs(label - prediction)), 5) AS mae, round({R2}, 5) AS r2
        FROM ({PREDICTED}) GROUP BY l_returnflag, l_linestatus""",
    "extra_metrics": f"""SELECT l_returnflag, round("MAE", 6) AS mae, round("MSE", 6) AS mse, round("RMSE", 6) AS rmse,
        round("R2", 6) AS r2, round("RMSLE", 6) AS rmsle, round("MAPE", 6) AS mape
        FROM (SELECT l_returnflag, {EXTRA} FROM ({PREDICTED}) GROUP BY l_returnflag)""",
    "cv_performance": f"SELECT {ROUNDED_PERF} FROM ({PERFORMANCE})",
    "performance_wide": "SELECT model_name, " + ", ".join(
        f"round(max(CASE WHEN metric = '{m}' AND split = '{s}' THEN {v} END), 5) AS {m.lower()}_{s}_{v}"
        for m in ("MAE", "R2") for s in ("train", "val") for v in ("mean", "std")
    ) + f" FROM ({PERFORMANCE}) GROUP BY model_name",
    "cv_bar_table": f"SELECT {ROUNDED_PERF} FROM ({PERFORMANCE}) WHERE metric IN ('RMSE', 'MAPE') AND split = 'val'",
    "residuals": f"""SELECT {LK}, round(y, 6) AS label, round(b + a * l_quantity, 6) AS prediction,
        round(y - (b + a * l_quantity), 6) AS residual FROM ({SCORED}),
        (SELECT regr_slope(y, l_quantity) AS a, regr_intercept(y, l_quantity) AS b FROM ({SCORED}))""",
    "shap_linear": f"""SELECT {LK}, 'l_quantity' AS feature, l_quantity AS feature_value,
        round(a * (l_quantity - m), 6) AS shap_value, round(b + a * m, 6) AS base_value FROM ({SCORED}),
        (SELECT regr_slope(y, l_quantity) AS a, regr_intercept(y, l_quantity) AS b, avg(l_quantity) AS m FROM ({SCORED}))""",
    "shap_summary": f"""WITH c AS ({two_feature_fit(SCORED, 'l_quantity', 'l_discount', 'y')})
        SELECT 'l_quantity' AS feature, round(avg(abs(ca * (l_quantity - ma))), 6) AS mean_abs_shap FROM lineitem, c
        UNION ALL SELECT 'l_discount', round(avg(abs(cb * (l_discount - mb))), 6) FROM lineitem, c""",
    "shap_scatter": f"""WITH c AS ({two_feature_fit(SCORED, 'l_quantity', 'l_discount', 'y')})
        SELECT 'l_discount' AS feature, 'Discount' AS label, l_discount AS feature_value,
          round(cb * (l_discount - mb), 6) AS shap_value FROM lineitem, c""",
    "rank_results": f"""SELECT row_number() OVER (ORDER BY test_R2 DESC NULLS LAST, model_id) AS rank, model_id,
        round(test_MSE, 4) AS test_mse FROM ({STAND_IN})""",
    "rank_results_ranges": f"""SELECT row_number() OVER (ORDER BY test_MAE ASC NULLS LAST, model_id) AS rank, model_id,
        round(test_MSE, 4) AS test_mse FROM ({STAND_IN})""",
    "best_row": f"""SELECT model_id, model_name, target, n_trials, test_MAE AS "test_MAE" FROM ({STAND_IN})
        ORDER BY test_MAE ASC NULLS LAST, model_id LIMIT 1""",
    "best_row_splits": f"""WITH b AS (SELECT * FROM ({STAND_IN}) ORDER BY test_MSE, model_id LIMIT 1)
        SELECT 'Train' AS split, '—' AS r2, '—' AS mae, format('{{:,.4f}}', train_MSE) AS mse FROM b
        UNION ALL SELECT 'Validation', '—', '—', format('{{:,.4f}}', best_MSE) FROM b
        UNION ALL SELECT 'Test', coalesce(format('{{:,.4f}}', test_R2), '—'),
          coalesce(format('{{:,.4f}}', test_MAE), '—'), format('{{:,.4f}}', test_MSE) FROM b""",
    "best_row_params": f"""SELECT 'alpha' AS param, best_params->>'$.alpha' AS value FROM (
        SELECT * FROM ({STAND_IN}) ORDER BY test_MSE DESC, model_id LIMIT 1)""",
    "kpis": f"""SELECT *, {hms('total_time')} AS total_time_hms FROM (
        SELECT count(*) AS n_models, round(avg(test_R2), 8) AS metric_mean,
        round(stddev_pop(test_R2), 8) AS metric_std, round(max(test_R2), 8) AS metric_best,
        round(sum(coalesce(optimization_time, 0)), 4) AS total_time FROM ({STAND_IN}))""",
    "family_median": f"SELECT model_name, round(median(test_MSE), 6) AS median FROM ({STAND_IN}) GROUP BY model_name",
    "family_box": f"""SELECT model_name, count(test_R2) AS n, round(q[1], 10) AS low, round(q[2], 10) AS q1,
        round(q[3], 10) AS median, round(q[4], 10) AS q3, round(q[5], 10) AS high FROM (
        SELECT model_name, test_R2, quantile_cont(test_R2, [0.0, 0.25, 0.5, 0.75, 1.0]) OVER (PARTITION BY model_name) AS q
        FROM ({STAND_IN})) GROUP BY model_name, q""",
    "family_points": f"""SELECT model_name, test_MSE AS "test_MSE" FROM ({STAND_IN})""",
    "quantiles_by_search": """SELECT l_returnflag, n, round(q[1], 6) AS q0, round(q[2], 6) AS q1, round(q[3], 6) AS q2 FROM (
        SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, [0.1, 0.5, 0.99]) AS q
        FROM lineitem GROUP BY l_returnflag)""",
    "results_view": f"""SELECT model_id, model_name, iteration, target, n_trials,
        coalesce({hms('optimization_time')}, '—') AS optimization_time, best_params FROM ({STAND_IN})
        WHERE regexp_matches(model_name, '^l', 'i') AND target = 'F'""",
    "filter_name": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'RING|^blue', 'i')",
    "filter_target": "SELECT p_partkey, p_size FROM part WHERE CAST(p_size AS VARCHAR) = '7'",
    "rank_models": f"""SELECT experiment, stage, CAST(row_number() OVER (PARTITION BY experiment, stage
          ORDER BY mae_val_mean, model_name) AS INT) AS rank, model_name, mae_val_mean FROM (
        SELECT CAST(l_linenumber % 3 AS VARCHAR) AS experiment, l_linestatus AS stage, l_returnflag AS model_name,
          round(avg(abs(label - prediction)), 6) AS mae_val_mean FROM ({PREDICTED}) GROUP BY ALL)""",
    "append_results": f"""SELECT {RK}, l_returnflag FROM lineitem WHERE l_linenumber <= 3
        UNION ALL SELECT {RK}, NULL FROM lineitem WHERE l_linenumber > 3""",
    "required_metrics": f"""SELECT model_id, CAST(NULL AS DOUBLE) AS "test_R2", CAST(NULL AS DOUBLE) AS "test_MAE",
        test_MSE AS "test_MSE" FROM ({STAND_IN})""",
    "results_store": f"""SELECT model_id, 3 AS exp, 'again' AS score, n_trials, round(test_MSE, 4) AS test_mse
        FROM ({STAND_IN}) WHERE iteration % 12 = 3""",
    "list_experiments": "SELECT CAST(e AS INT) AS exp, 13 AS following FROM range(1, 13) r(e) WHERE e IN (SELECT o_orderkey % 12 + 1 FROM orders)",
    "csv_round_trip": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
        '20:07:01' AS time FROM orders""",
    "csv_dialect": """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'say "' || c_name || '", ok'
          WHEN 1 THEN c_name || chr(10) || c_mktsegment WHEN 3 THEN 'a' || chr(92) || c_name WHEN 5 THEN c_name END AS note,
        CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS amount FROM customer""",
    "f_regression_nulls": " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, {i} AS ordinal, round(r * r / (1 - r * r) * (n - 2), 4) AS score FROM (
          SELECT corr({f}, y) AS r, count(*) AS n FROM (
            SELECT CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS gappy, l_tax,
              CASE WHEN l_suppkey % 7 <> 0 THEN y END AS y FROM ({SCORED}))
          WHERE {f} IS NOT NULL AND y IS NOT NULL)"""
        for i, f in enumerate(["gappy", "l_tax"])
    ),
    "metric_best": f"""SELECT 'R²' AS label, round(max(test_R2), 6) AS best FROM ({STAND_IN})
        UNION ALL SELECT 'MAE', round(min(test_MAE), 6) FROM ({STAND_IN})
        UNION ALL SELECT 'MSE', round(min(test_MSE), 6) FROM ({STAND_IN})""",
    "log_round_trip": """SELECT row_number() OVER (ORDER BY o_orderstatus) AS line_no,
        o_orderstatus || ': ' || count(*) || ' orders' AS line FROM orders GROUP BY o_orderstatus""",
    "metadata_round_trip": """SELECT 'experiment_3' AS experiment_id, count(*)::INT AS random_state, 'y' AS target,
        0 AS n_features, 'f_regression' AS feature_scoring, 0.25::DOUBLE AS test_size, false AS exact_folds FROM orders""",
    "listed_tables": """SELECT c_nationkey::INT AS nation, sum(strlen(c_name) + 1)::BIGINT AS length
        FROM customer GROUP BY c_nationkey""",
    "rebuilt_split": f"SELECT {LK} FROM ({ONE_FEATURE}) WHERE {hash_sql(LINE_KEYS, 42)} < {int(MODULUS * 0.3)}",
    "export_view": f"""SELECT model_id, CAST(iteration AS BIGINT) AS iteration, target,
        coalesce({hms('optimization_time')}, '—') AS optimization_time FROM ({STAND_IN})
        WHERE regexp_matches(model_name, '^l', 'i')""",
    "metadata_defaults": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 42 ELSE p_size END AS random_state,
        CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS n_features,
        CASE WHEN p_partkey % 5 = 0 THEN 'f_regression' ELSE p_type END AS feature_scoring, 0 AS n_dropped FROM part""",
    "log_read": f"""SELECT row_number() OVER (ORDER BY conv_id, turn, pos) AS line_no,
        replace(line, chr(13), ' ') AS line FROM ({LINES})""",
    "log_tail_filter": f"""SELECT conv_id, turn, pos, line FROM (SELECT * FROM ({LINES})
        ORDER BY conv_id DESC, turn DESC, pos DESC LIMIT 500) WHERE contains(lower(line), 'an')""",
    "log_tail_filter_case": f"SELECT conv_id, turn, pos, line FROM ({LINES}) WHERE contains(line, 'An')",
    "format_hms": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '—' ELSE {hms('o_totalprice / 7')} END AS hms
        FROM orders""",
    "format_elapsed": """SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%dh %dm %.2fs', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT), s % 60)
        WHEN s >= 60 THEN printf('%dm %.2fs', CAST(floor(s / 60) AS BIGINT), s % 60)
        ELSE printf('%.2fs', s) END AS elapsed FROM (
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN x % 200 ELSE x END AS s FROM (
          SELECT o_orderkey, round(o_totalprice / 100) + (o_custkey % 4) * CAST(0.25 AS DOUBLE) AS x FROM orders))""",
    "format_number": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '—'
        ELSE format('{:,.4f}', o_totalprice) END AS text FROM orders""",
    "model_ids": """SELECT p_partkey, p_type || '_Exp' || p_size || '_' || p_brand || '_' || p_partkey AS model_id,
        p_type AS family FROM part""",
    "safe_names": r"""SELECT doc_id, replace(trim(regexp_replace(text, '[^\p{L}\p{M}\p{N}_\-. ]', '_', 'g'), ' '), ' ', '_') AS name FROM documents""",
    "params_parse": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS n,
        CASE WHEN event_id % 5 IN (2, 3, 4) THEN props->>'$.k' END AS k,
        CASE WHEN event_id % 5 = 2 THEN 'true' END AS flag,
        CASE WHEN event_id % 5 = 1 THEN 'junk ' || (props->>'$.k') END AS raw FROM events""",
    "params_text": """SELECT event_id, '{"k":"' || (props->>'$.k') || '","type":"' || event_type || '"}' AS text FROM events""",
    "trials_svr": f"""SELECT trial_id, c, kernel, shrinking, max_iter,
        CASE WHEN kernel = 'poly' THEN degree END AS degree,
        CASE WHEN kernel IN ('rbf', 'poly') THEN gamma END AS gamma FROM (
        SELECT o_orderkey AS trial_id, round({sampled_log(SVR_U[0], 1e-3, 1e4)}, 6) AS c,
          list_extract(['linear', 'rbf', 'poly'], CAST(floor({SVR_U[2]} * 3) AS INT) + 1) AS kernel,
          floor({SVR_U[4]} * 2) = 0 AS shrinking, {sampled_int(SVR_U[5], 1000, 20000)} AS max_iter,
          {sampled_int(SVR_U[6], 2, 6)} AS degree, round({sampled_log(SVR_U[7], 1e-6, 1e-1)}, 10) AS gamma FROM orders)""",
    "trials_xgb": f"""SELECT o_orderkey AS trial_id,
        list_extract(['approx', 'hist'], CAST(floor({XGB_U[2]} * 2) AS INT) + 1) AS tree_method,
        {sampled_int(XGB_U[3], 100, 2000, 100)} AS n_estimators, {sampled_int(XGB_U[4], 5, 30)} AS max_depth,
        round(0.5 + floor({XGB_U[7]} * 6) * 0.1, 10) AS subsample, round(floor({XGB_U[9]} * 51) * 0.1, 10) AS gamma,
        round({sampled_log(XGB_U[5], 1e-3, 0.3)}, 8) AS learning_rate FROM orders""",
    "hidden_layers": f"""SELECT trial_id, n_layers, first, CASE WHEN n_layers >= 3 THEN third END AS third FROM (
        SELECT c_custkey AS trial_id, CAST(floor({NN_U[0]} * 3) AS INT) + 1 AS n_layers,
          CAST(32 * (floor({NN_U[1]} * 32) + 1) AS INT) AS first,
          CAST(32 * (floor({NN_U[3]} * 32) + 1) AS INT) AS third FROM customer)""",
    "best_trial": """WITH t AS (SELECT CAST(o_orderkey AS INT) AS trial_id, floor(o_totalprice / 1000) AS s FROM orders)
        SELECT trial_id, s AS mse_mean, s AS r2_mean FROM t WHERE trial_id IN (
          (SELECT trial_id FROM t ORDER BY s, trial_id LIMIT 1), (SELECT trial_id FROM t ORDER BY s DESC, trial_id LIMIT 1))""",
    "rf_fit": split_metrics(STUMP_MODEL, "RF"),
    "xgb_fit": split_metrics(boosted_sql(2, 0.3), "XGB"),
    "lgb_fit": split_metrics(boosted_sql(3, 0.2), "LGB"),
    "et_fit": split_metrics(f"""SELECT d.*, y AS label, prediction FROM ({STUMP_ROWS}) d JOIN (
        SELECT l_quantity > 25 AS many, l_quantity % 2 > 0 AS odd, avg(y) AS prediction FROM ({STUMP_TRAIN}) GROUP BY ALL) g
        ON g.many = (d.l_quantity > 25) AND g.odd = (d.l_quantity % 2 > 0)""", "ET"),
    "mlp_fit": "SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS x, round(CAST(3 * l_quantity + 7 AS DOUBLE), 1) AS prediction FROM lineitem",
    "tree_shap": f"""WITH b AS (SELECT avg(prediction) AS base FROM ({STUMP_MODEL}) WHERE NOT is_test)
        SELECT {LK}, 'l_quantity' AS feature, CAST(l_quantity AS DOUBLE) AS feature_value,
          round(prediction - base, 6) AS shap_value, round(base, 6) AS base_value, 'none' AS target_scale
        FROM ({STUMP_MODEL}), b WHERE is_test""",
    "cross_validate_forest": "SELECT " + ", ".join(
        f"round({fn}({m}), 6) AS {m}_{p}"
        for m in ("mse", "mae", "r2") for p, fn in (("mean", "avg"), ("std", "stddev_pop"))
    ) + f""" FROM (SELECT left_out, avg((label - prediction) * (label - prediction)) AS mse,
        avg(abs(label - prediction)) AS mae, {R2} AS r2
        FROM (SELECT *, rf AS prediction FROM ({STUMP_FOLDS}) WHERE fold = left_out) GROUP BY left_out)""",
    "compare_models": f"""WITH p AS (SELECT left_out, label, fold = left_out AS val, unnest(['LR', 'RF']) AS model_name,
          unnest([lr, rf]) AS prediction FROM ({STUMP_FOLDS})),
        m AS (SELECT model_name, left_out, CASE WHEN val THEN 'val' ELSE 'train' END AS split, {EXTRA}
          FROM p GROUP BY ALL),
        u AS (UNPIVOT m ON COLUMNS(* EXCLUDE (model_name, left_out, split)) INTO NAME metric VALUE v)
        SELECT model_name, metric, split, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std
        FROM u GROUP BY model_name, metric, split""",
    "tree_shap_additivity": f"SELECT {RK}, CAST(0 AS DOUBLE) AS gap FROM lineitem WHERE {test_sql(LINE_KEYS, 42)}",
    "forest_stump": f"SELECT {LK}, round(f1, 6) AS prediction FROM ({STUMP_1})",
    "boosted_stumps": f"""WITH m AS (SELECT *, avg(y) OVER () AS m FROM ({STUMP_1})),
        a AS (SELECT *, m + 0.5 * (f1 - m) AS g1, y - (m + 0.5 * (f1 - m)) AS r FROM m)
        SELECT {LK}, round(g1 + 0.5 * CASE WHEN l_quantity <= b.cut THEN b.low ELSE b.high END, 6) AS prediction
        FROM a, ({stump('SELECT * FROM a', 'l_quantity', 'r')}) b""",
    "boosted_three": f"""WITH m AS (SELECT *, avg(y) OVER () AS m FROM ({STUMP_1})),
        a AS (SELECT *, m + 0.25 * (f1 - m) AS g1, y - (m + 0.25 * (f1 - m)) AS r FROM m),
        b AS (SELECT a.*, g1 + 0.25 * CASE WHEN l_quantity <= s.cut THEN s.low ELSE s.high END AS g2
          FROM a, ({stump('SELECT * FROM a', 'l_quantity', 'r')}) s),
        c AS (SELECT * EXCLUDE (r), y - g2 AS r FROM b)
        SELECT {LK}, round(g2 + 0.25 * CASE WHEN l_quantity <= s.cut THEN s.low ELSE s.high END, 6) AS prediction
        FROM c, ({stump('SELECT * FROM c', 'l_quantity', 'r')}) s""",
    "extra_trees_groups": f"""SELECT {LK}, round(avg(y) OVER (PARTITION BY l_quantity > 25,
        l_extendedprice < 40000, l_tax > 0.03), 6) AS prediction FROM ({SCORED})""",
    "analysis_linear": f"""WITH d AS ({ONE_FEATURE}),
        m AS (SELECT f.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b
          FROM (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f JOIN d ON d.fold IS NOT NULL AND d.fold <> f.fold GROUP BY f.fold),
        s AS (SELECT d.fold, y AS label, b + a * x AS prediction FROM d JOIN m ON d.fold = m.fold),
        v AS (SELECT fold, avg((label - prediction) * (label - prediction)) AS mse,
          avg(abs(label - prediction)) AS mae, {R2} AS r2 FROM s GROUP BY fold),
        w AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM d WHERE NOT is_test),
        p AS (SELECT is_test, y AS label, b + a * x AS prediction FROM d, w)
        SELECT 'LR_Exp1_r2_1' AS model_id, 1 AS n_trials, c.*, tr.*, te.* FROM
          (SELECT round(avg(mse), 6) AS "best_MSE", round(avg(mae), 6) AS "best_MAE", round(avg(r2), 6) AS "best_R2",
            round(stddev_pop(r2), 6) AS "best_R2_STD" FROM v) c,
          (SELECT round(mse, 6) AS "train_MSE", round(mae, 6) AS "train_MAE", round(r2, 6) AS "train_R2"
            FROM ({part_metrics('SELECT * FROM p WHERE NOT is_test')})) tr,
          (SELECT round(mse, 6) AS "test_MSE", round(mae, 6) AS "test_MAE", round(r2, 6) AS "test_R2"
            FROM ({part_metrics('SELECT * FROM p WHERE is_test')})) te""",
    "flagship": f"""WITH d AS (SELECT * EXCLUDE (l_shipdate) FROM ({SCORED})),
        u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_quantity, l_extendedprice, l_discount,
          l_tax, l_returnflag, l_linestatus, y ORDER BY {LK}) AS rn FROM d) WHERE rn = 1),
        t AS (SELECT *, {test_sql(LINE_KEYS, 42)} AS is_test FROM u),
        c AS ({two_feature_fit('SELECT * FROM t WHERE NOT is_test', 'l_quantity', 'l_discount', 'y')}),
        p AS (SELECT is_test, y AS label, c0 + ca * l_quantity + cb * l_discount AS prediction FROM t, c)
        SELECT is_test, count(*) AS n, round(avg((label - prediction) * (label - prediction)), 6) AS mse,
          round(avg(abs(label - prediction)), 6) AS mae, round({R2}, 6) AS r2 FROM p GROUP BY is_test""",
}

FLAGGED = f"""SELECT {LK}, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity > 30 END AS large,
  l_extendedprice, y FROM ({SCORED})"""

ORACLE |= {
    "mutual_info_neighbour_keys": jittered_information(),
    "penalised_stumps": split_metrics(penalised_sql(2, 0.5, 100.0, 40.0, 1, 1.0), "XGB"),
    "penalised_leafwise": split_metrics(penalised_sql(3, 0.2, 60.0, 25.0, 20, 1.0), "LGB"),
    "null_booleans": f"""WITH d AS ({FLAGGED}),
      g AS (SELECT DISTINCT ON (large, l_extendedprice, y) {LK}, large, l_extendedprice, y FROM d
            ORDER BY large, l_extendedprice, y, {LK}),
      m AS (SELECT large AS mode FROM g WHERE large IS NOT NULL GROUP BY large ORDER BY count(*) DESC, large LIMIT 1)
      SELECT {LK}, coalesce(large, mode) AS large, l_extendedprice, round(y, 6) AS y FROM g, m""",
    "incomplete_rows_in_fits": f"""SELECT {LK}, round(avg(y) OVER (PARTITION BY large), 5) AS line,
      round(avg(y) OVER (PARTITION BY large), 5) AS tree FROM ({FLAGGED}) WHERE large IS NOT NULL""",
    "mostly_repeated_rows": """SELECT min(l_orderkey) AS l_orderkey, l_quantity, l_discount, l_tax
      FROM lineitem GROUP BY l_quantity, l_discount, l_tax""",
    "refused_inputs": """SELECT r.*, (SELECT count(*) FROM orders) AS n_rows FROM (VALUES
      ('target', 'unknown target(s): nothing'), ('categorical', 'unknown categorical feature(s): nothing'),
      ('key', 'unknown key(s): nothing'), ('fill', 'unknown categorical_fill: mean'),
      ('dropped target', 'the target cannot be dropped'), ('right', NULL)) r("case", refused)""",
    "refused_models": """SELECT r.*, (SELECT count(*) FROM orders) AS n_rows FROM (VALUES
      ('transform', 'unknown target transformation: sqrt'), ('model', 'unknown model: KNN'),
      ('metric', 'unknown metric: rmse'), ('explained', 'model SVR cannot be explained'),
      ('log', 'the log transform needs every target above -1'), ('identity', NULL)) r("case", refused)""",
    "stamped_dates": """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day,
      strftime(o_orderdate, '%H:%M:%S') AS clock, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders""",
    "logs_of_orders": """SELECT row_number() OVER (ORDER BY o_orderkey) AS line_no,
      concat_ws(' ', o_orderkey, o_orderstatus, floor(o_totalprice)::BIGINT) AS line FROM orders""",
}
